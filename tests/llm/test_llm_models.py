"""Language ID, URL filter, licence scan and page extraction."""

import html as entities
import math
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clinfeat.llm import html, langid, licenses, urls

FOLDER = "/root/testdata/sf0.01"


def test_forward_backward_is_exact():
    """Against the sum over all label sequences, across chunks and text beginnings."""
    rng = np.random.default_rng(1)
    field = langid.Field(["a", "b", "c"])
    field.transition, field.first = rng.normal(size=(3, 3)), rng.normal(size=3)
    emission = rng.normal(size=(150, 3)) * 2
    begins = np.zeros(150, bool)
    begins[[0, 5, 6, 70, 149]] = True
    share, moves = field.marginals(emission, begins)
    for a, b in ((0, 5), (5, 6), (6, 70), (70, 149), (149, 150)):
        e = emission[a:b]
        f = [field.first + e[0]]
        for row in e[1:]:
            f.append(np.logaddexp.reduce(f[-1][:, None] + field.transition, 0) + row)
        g = [np.zeros(3)]
        for row in e[:0:-1]:
            g.append(np.logaddexp.reduce(field.transition + row + g[-1], 1))
        both = np.array(f) + np.array(g[::-1])
        both = np.exp(both - both.max(1, keepdims=True))
        assert np.allclose(share[a:b], both / both.sum(1, keepdims=True))
    assert math.isclose(moves.sum(), 150 - 5)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def test_language_on_held_out_documents(spark, documents):
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    field = langid.fit(documents.where(~held))
    found = langid.predict(documents.where(held).select("doc_id", "text", "lang"), field)
    right = found.agg(F.avg((F.col("lang") == F.col("_lang")).cast("int"))).first()[0]
    assert right > 0.97
    texts = {r.lang: r.text for r in documents.where("length(text) > 400").dropDuplicates(["lang"]).collect()}
    odd = [(1, None), (2, ""), (3, "12 — 34 %%%"), (4, texts["fr"]), (5, texts["fr"]), (6, "ß"), (7, "漢字"), (8, texts["de"] * 400)]
    df = spark.createDataFrame(odd, "doc_id long, text string").withColumn("share", F.lit("clash"))
    got = {r.doc_id: (r._lang, r._score) for r in langid.predict(df, field).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0)
    assert got[4] == got[5] and got[4][0] == "fr" and got[8][0] == "de" and got[7][0] in field.labels
    assert all(0 <= s <= 1 for _, s in got.values())
    # Words of a text that changes its language in the middle.
    mixed = " ".join(texts["en"].split()[:40] + texts["es"].split()[:40])
    (block, share), = langid.labelled_words(field, pa.array([mixed]))
    label = np.array(field.labels)[share.argmax(1)]
    half = int((block.starts < len(" ".join(texts["en"].split()[:40]).encode())).sum())
    assert (label[:half] == "en").mean() > 0.85 and (label[half:] == "es").mean() > 0.85
    assert langid.predict(df.limit(0), field).count() == 0


def test_language_without_labels(spark):
    df = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    field = langid.fit(df)
    assert field.labels == [] and langid.predict(df, field).first()._lang == "und"


def test_url_parts_and_rules(spark):
    cases = {
        "http://WWW.Example.com/en/1?x#y": ("www.example.com", "/en/1", "www.example.com/en/"),
        "https://a.www.example.com/en/": ("a.www.example.com", "/en/", "www.example.com/en/"),
        "https://blog.example.com/en/2": ("blog.example.com", "/en/2", "example.com/en/"),
        "https://blog.example.com/en": ("blog.example.com", "/en", "com/"),
        "http://notexample.com/en/2": ("notexample.com", "/en/2", "com/"),
        "http://x.net/es/9": ("x.net", "/es/9", "net/es/"), "http://net/fr/": ("net", "/fr/", "net/fr/"),
        "http://x.net/en/9": ("x.net", "/en/9", None), "http://x.com": ("x.com", "", None), "http://x.com?/en/": ("x.com", "", None),
        "com/x": ("", "", None), "": ("", "", None), None: ("", "", None), "a://b://c.com/d": ("b:", "//c.com/d", None),
        "x\ny://É.COM/": ("É.com", "/", "com/"),
    }
    rows = [(i, u, "h") for i, u in enumerate(cases)]
    df = spark.createDataFrame(rows * 2, "page_id long, url string, host string")
    got = urls.judge(df).collect()
    assert len(got) == 2 * len(rows) and all(r.host == "h" for r in got)
    says = dict(urls.RULES)
    for r in got:
        host, path, rule = cases[r.url]
        assert (r._host, r._path, r._rule) == (host, path, rule), r.url
        assert r._verdict == says[rule] if rule else r._verdict in ("allow", "block")
    assert urls.judge(df.limit(0)).count() == 0
    alone = urls.judge(df.where("url = 'http://x.net/en/9' OR url = 'http://x.net/es/9'")).collect()
    assert {r._verdict for r in alone} == {"block"}


def test_url_features_and_trees(spark):
    url = "http://ab.example.net/x1/y2?a=1&b=22#f"
    df = spark.createDataFrame([(url,)], "_url string")
    host, path = urls.parts(F.col("_url"))
    r = urls.lexical(df.withColumns({"_host": host, "_path": path})).first()
    share = [url.count(c) / len(url) for c in set(url)]
    assert math.isclose(r.entropy, -sum(p * math.log2(p) for p in share), abs_tol=1e-8)
    assert (r.depth, r.labels, r.parameters, r.query_chars, r.has_fragment) == (2, 2, 2, 8, 1) and r.digit_ratio == 5 / len(url)
    rng = random.Random(4)
    rows = [(f"http://h{rng.randrange(50)}.net/es/{'9' * rng.randrange(8, 20)}",) for _ in range(200)]
    rows += [(f"http://h{rng.randrange(50)}.com/about/us",) for _ in range(200)]
    rows += [("http://h1.org/zz/99999999999999",), ("http://h1.org/about/us",)]
    got = {r.url: r._verdict for r in urls.judge(spark.createDataFrame(rows, "url string")).collect()}
    assert got["http://h1.org/zz/99999999999999"] == "block" and got["http://h1.org/about/us"] == "allow"


def test_url_statistics_count_all_labelled_urls(spark):
    """Not only the sample; and a URL that fills a third of the rows comes into the sample by its share."""
    rows = [(i, f"http://h{i}.net/{'es' if i % 2 else 'fr'}/{i}") for i in range(300)] + [(300 + i, "http://hot.com/a") for i in range(150)]
    host, path = urls.parts(F.col("_url"))
    df = spark.createDataFrame(rows, "_id long, _url string").withColumns({"_host": host, "_path": path, "_label": F.col("_url").contains("/es/").cast("int")})
    _, tables = urls.fit(df, sample=100)
    got = {r._domain: ((r._domain_blocked + 1) / (r._domain_n + 2), math.log1p(r._domain_n)) for r in tables["domain"].collect()}
    assert len(got) == 301 and got["hot.com"] == (1 / 152, math.log1p(150)) and got["h7.net"] == (2 / 3, math.log1p(1))
    assert {r._suffix: (r._suffix_blocked + 1) / (r._suffix_n + 2) for r in tables["suffix"].collect()} == {"net": 151 / 302, "com": 1 / 152}


@pytest.mark.parametrize("hot", range(4))
def test_url_sample_is_not_one_url(spark, monkeypatch, hot):
    """Rows of one URL are chosen by their page."""
    seen = []
    lexical = urls.lexical

    def watched(df):
        if "_label" in df.columns:
            seen.append(df.count())
        return lexical(df)

    monkeypatch.setattr(urls, "lexical", watched)
    rows = [(i, f"http://hot{hot}.com/a") for i in range(2000)]
    urls.judge(spark.createDataFrame(rows, "page_id long, url string"), sample=200).count()
    assert 120 <= seen[0] <= 280


def test_license_calibration_reads_all_held_out_rows(spark, monkeypatch):
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefghijklmnop", k=9)) for _ in range(500)]
    docs = spark.createDataFrame([(" ".join(rng.choices(words, k=9000)),) for _ in range(60)], "text string")
    rows = []
    logits = licenses.Scanner.logits

    def counted(self, lines):
        rows.append(lines.rows)
        return logits(self, lines)

    monkeypatch.setattr(licenses.Scanner, "logits", counted)
    licenses.fit(docs)
    templates = sum(map(len, licenses.TEMPLATES.values()))
    assert len(rows) > 1 and sum(rows) > 0.15 * templates * licenses.VARIANTS


def test_license_scan(spark, documents):
    scanner = licenses.fit(documents.select("text"))
    rows = [
        (1, "Some words here.\nReleased under the MIT License.\nmore of it"), (2, None), (3, ""), (4, "\n\n"), (5, "Mit und."),
        (6, "This work is licensed under the GNU General Public License, version 3."), (None, "All rights reserved."),
        (7, "x " * 50_000 + "\nLicensed under the Apache License, Version 2.0."), (7, "Licensed under CC BY-NC 4.0."),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("family", F.lit("clash"))
    got = {(r.doc_id, r.paragraph, r.family) for r in licenses.scan(df, scanner).collect() if r.confirmed}
    assert got == {(1, 1, "mit"), (6, 0, "gpl"), (None, 0, "all-rights-reserved"), (7, 1, "apache-2.0"), (7, 0, "cc-by-nc")}
    assert licenses.scan(df.limit(0), scanner).count() == 0
    # All planted statements are found, and nothing else is confirmed.
    lines = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("paragraph", "line"))
    planted = lines.where(F.col("line").rlike("^(This work is licensed|Licensed under|Released under|All rights reserved)"))
    found = licenses.scan(documents, scanner).where("confirmed")
    assert planted.count() == found.count() == planted.join(found, ["doc_id", "paragraph"]).count() > 0


def held_out_share(spark, monkeypatch, features):
    """Share of the URLs decided by a rule, but kept from the trees and the statistics, that the trees judge as the rule does."""
    monkeypatch.setattr(urls, "FEATURES", features)
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    host, path = urls.parts(F.col("url"))
    rule, verdict = urls.matched(host, path, urls.RULES)
    rows = pages.select(
        F.col("page_id").cast("string").alias("_id"), F.col("url").alias("_url"), host.alias("_host"), path.alias("_path"), (verdict == "block").cast("int").alias("_label")
    ).where("_label IS NOT NULL").withColumn("held", F.crc32(F.col("_id")) % 4 == 2)
    model, tables = urls.fit(rows.where("NOT held"))
    from pyspark.ml.feature import VectorAssembler

    asked = urls._with_statistics(urls.lexical(rows.where("held")), tables)
    scored = model.transform(VectorAssembler(inputCols=features, outputCol="_features").transform(asked))
    found = scored.agg(F.avg((F.col("prediction") == F.col("_label")).cast("double")), F.avg(F.col("_label").cast("double")), F.count("*")).first()
    print(features[-1], found)
    return found[0], max(found[1], 1 - found[1])


def test_held_out_urls_with_and_without_the_labels_statistics(spark, monkeypatch):
    """The trees do better than the commoner verdict, also by the text of the URL alone."""
    rates = {"suffix_rate", "suffix_count", "domain_rate", "domain_count"}
    full, plain = list(urls.FEATURES), [x for x in urls.FEATURES if x not in rates]
    assert len(full) == len(plain) + 4
    for features in (full, plain):
        share, commoner = held_out_share(spark, monkeypatch, features)
        assert share > commoner


def test_rows_do_not_count_their_fold(spark):
    table = {"suffix": spark.createDataFrame([("com", 3, 5)], "_suffix string, _suffix_blocked long, _suffix_n long")}
    folded = {"suffix": spark.createDataFrame([("com", 0, 2, 3)], "_suffix string, _fold long, _suffix_blocked long, _suffix_n long")}
    rows = spark.createDataFrame([("com", 0), ("com", 1), ("org", 1)], "_suffix string, _fold long")
    found = {(r._suffix, r._fold): (r.suffix_rate, r.suffix_count) for r in urls._with_statistics(rows, table, folded).collect()}
    assert found == {("com", 0): (2 / 4, pytest.approx(math.log1p(2))), ("com", 1): (4 / 7, pytest.approx(math.log1p(5))), ("org", 1): (0.5, 0.0)}


def article(page):
    """The marked content of a generated page, read plainly."""
    import re

    inner = page[page.index("<article>") + 9:page.index("</article>")]
    return " ".join(entities.unescape(re.sub("</?b>", "", re.sub("</?(p|br|h1)>", " ", inner))).split())


def test_main_text_of_all_pages(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet").withColumn("inside", F.lit("clash"))
    got = html.extract(pages).collect()
    assert len(got) == pages.count()
    for r in got:
        assert r._main_text == article(r.html) and r._n_chars == len(r._main_text), r.page_id


def test_weights_are_counted_where_few_pages_are_labelled(spark):
    marked = [(f"<body><nav>menu {i}</nav><MAIN><p>some words of text {i}</p></MAIN></body>",) for i in range(5)]
    plain = [(f"<body><div>page {i} has no mark</div><main-menu>x</main-menu></body>",) for i in range(995)]
    alone = html.weights(spark.createDataFrame(marked, "html string"), sample=20)
    assert alone and html.weights(spark.createDataFrame(plain + marked, "html string"), sample=20) == alone


def test_main_text_without_marks(spark):
    """Pages whose marks are renamed give the same text as with them, by the weights that other pages taught."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    odds = html.weights(spark.createDataFrame([(x,) for x in pages[::2]], "html string"))
    for page in pages[1::2]:
        assert html.main_text(page.replace("<article>", "<div>").replace("</article>", "</div>"), odds) == article(page)


def test_names_that_do_and_do_not_end_content():
    body = " ".join(f"word{i}" for i in range(30))
    odds = {"p": 1.0, "div": 0.5, "<p": -0.1, "<div": -0.1, "<ul": -0.5, ".teaser": -4.0, ".lead": 2.0}
    for name in ("related-work", "social-science", "share-prices", "notice", "comment-on-law", "header-text", "ads-b"):
        assert html.main_text(f"<p>{body}</p><div class='{name}'><p>{body}</p></div><p>{body}</p>", odds) == f"{body} {body} {body}", name
    for name in ("ad", "Advert big", "comments", "x sidebar", "teaser"):
        assert html.main_text(f"<article><p>{body}</p><div class='{name}'><p>gone</p></div><p>{body}</p></article>", odds) == f"{body} {body}", name
    assert html.never_named(odds) == {"teaser"}


@pytest.mark.parametrize("piece", [
    "<b ", '<a "', "<a '", "<!", "<?", "<", "</", "<script ", "<script>", "<!--", '<a x="y" ', "<a \"'", "<p><b>", "<div>", "</x>", "<x>", "<h1>", "<li>", "<i><div><b></i>",
    "<a href='x'>y", "</i><b>", '<a title=">" ', "<p class=", "<b class='x' id=", "<svg/", "<style", "<table><tr><td>", "&amp", "<b>\"", "<b \"<b '",
])
def test_broken_pages_take_linear_time(piece):
    """A page that repeats a broken piece: 10 MB of those the verdict named, 2 MB of the others."""
    size = (10 if piece in ("<b ", '<a "', "<!", "<script") else 2) << 20
    began = time.time()
    html.main_text("<p>some words " + piece * (size // len(piece)), {})
    assert time.time() - began < 45
    began = time.time()
    html.main_text("<div>" * 20_000 + "<i>" + "<x>" * 20_000 + piece * 20_000 + "</i>" * 20_000, {})
    assert time.time() - began < 20


def test_scanner_equals_a_plain_pattern():
    """The tags that one pattern finds, tried at every place in turn, on small pages."""
    pattern = re.compile(
        r"<!--.*?(?:-->|\Z)|<(script|style|svg)(?![a-zA-Z0-9:-]).*?(?:</\1\s*>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S | re.I,
    )
    chance = random.Random(3)
    parts = ["<", ">", '"', "'", "b", " ", "/", "!", "--", "<b ", "</b>", "<!--", "-->", "<script>", "</script >", "x=", "<p>", "svg", "<svg"]
    for _ in range(4000):
        page = "".join(chance.choice(parts) for _ in range(chance.randrange(25)))
        found = [(a, b) for a, b, *_ in html._Scanner(page).tags()]
        assert found == [m.span() for m in pattern.finditer(page)], page


def test_main_text_of_odd_pages(spark):
    body = " ".join(f"word{i}" for i in range(40))
    plain = "<html><body><nav><a href='/'>Home page</a></nav><div><h1>Title here</h1><p>{}</p></div><footer>Some foot</footer></body></html>"
    cases = {
        1: (None, ""), 2: ("", ""), 3: ("   ", ""), 4: (plain.format(body), f"Title here {body}"),
        5: (f"<article><p>A&nbsp;b &lt;c&gt; &#233;<b>x</b>y</p><div class='advert'>buy {body}</div><p>{body}</p>"
            f"<section id=comments><p>nice</p></section></article>", f"A b <c> éxy {body}"),
        6: (f"<main><header>Head</header><script>if (a < b) {{ '</p>' }}</script><!-- no --><form>Your name</form><p title='a > b'>{body}</p></main>", None),
        7: ("<p>" + "long " * 200_000 + "</p>", "long " * 199_999 + "long"),
        8: ("<nav>Only a menu</nav><style>p{}</style>", ""), 9: ("<p>cut &am", "cut &am"), 10: (f"text {body} <unclosed", None),
    }
    train = spark.read.parquet(f"{FOLDER}/pages.parquet").select("page_id", "html")
    odd = spark.createDataFrame([(-i, h) for i, (h, _) in cases.items()] * 2, "page_id long, html string")
    got = html.extract(train.union(odd)).where("page_id < 0 OR page_id IS NULL").collect()
    assert len(got) == 2 * len(cases)
    for r in got:
        expected = cases[-r.page_id][1]
        if expected is not None:
            assert r._main_text == expected, r.page_id
    texts = {-r.page_id: r._main_text for r in got}
    assert body in texts[6] and "Your name" not in texts[6] and "no" not in texts[6].split() and body in texts[10]
    assert html.extract(odd.limit(0)).count() == 0
