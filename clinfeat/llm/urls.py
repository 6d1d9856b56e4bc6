"""URL filter: rules by host and path, and gradient-boosted trees on lexical features for the rest.

The trees learn from labelled URLs: those that a rule decides, or any table with a label. Features are numbers taken from the
text by SQL functions: lengths, path depth, share of digits, entropy of the characters, counts of parameters and marks, and for
the host's last label and last two labels how often the labelled URLs with it, all of them, are blocked.
"""

import string

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from clinfeat.llm.shared import cut

SAMPLE_URLS = 20_000  # expected number of labelled URLs that the trees are fitted on
TREES, DEPTH = 20, 4

#: Rule (host and path) and what it says.
RULES = [
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
]

FOLDS = 5  # of the labelled URLs, for the statistics that the trees learn from
FEATURES = [
    "url_chars", "host_chars", "path_chars", "depth", "labels", "digit_ratio", "entropy", "parameters", "query_chars", "has_fragment",
    "hyphens", "dots_in_path", "suffix_rate", "suffix_count", "domain_rate", "domain_count",
]


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path): the host after the first ``://`` with A-Z lower-cased, the path behind it; both empty without one."""
    pattern = r"^(?s)(?:.*?)://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, pattern, 1), string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def matched(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule = verdict = F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def lexical(urls: DataFrame) -> DataFrame:
    """The features that need nothing but _url, _host and _path."""
    url, host, path = (F.coalesce(F.col(c), F.lit("")) for c in ("_url", "_host", "_path"))
    size = F.greatest(F.length(url), F.lit(1)).cast("double")
    characters = F.split(url, "")
    share = [F.transform(F.array_distinct(characters), lambda c: F.size(F.filter(characters, lambda x: x == c)) / size)][0]
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return urls.withColumns({
        "url_chars": F.length(url).cast("double"), "host_chars": F.length(host).cast("double"), "path_chars": F.length(path).cast("double"),
        "depth": _count(path, "/[^/]"), "labels": _count(host, r"\."), "digit_ratio": _count(url, "[0-9]") / size,
        "entropy": F.round(F.aggregate(share, F.lit(0.0), lambda s, p: s - p * F.log2(p)), 9),
        "parameters": _count(query, "="), "query_chars": F.length(query).cast("double"), "has_fragment": url.contains("#").cast("double"),
        "hyphens": _count(host, "-"), "dots_in_path": _count(path, r"\."),
        "_suffix": F.substring_index(host, ".", -1), "_domain": F.substring_index(host, ".", -2),
    })


def _with_statistics(rows: DataFrame, tables: dict[str, DataFrame], folded: dict[str, DataFrame] | None = None) -> DataFrame:
    """Rate and count of each row's suffix and domain among the labelled URLs; with ``folded``, the sums of each ``_fold``, among the other folds."""
    for name, table in tables.items():
        rows = rows.join(table, f"_{name}", "left")
        blocked, n = F.coalesce(f"_{name}_blocked", F.lit(0)), F.coalesce(f"_{name}_n", F.lit(0))
        if folded:
            own = folded[name].withColumnsRenamed({f"_{name}_blocked": "_own_blocked", f"_{name}_n": "_own_n"})
            rows = rows.join(own, [f"_{name}", "_fold"], "left")
            blocked, n = blocked - F.coalesce("_own_blocked", F.lit(0)), n - F.coalesce("_own_n", F.lit(0))
        rows = rows.withColumns({f"{name}_rate": (blocked + 1) / (n + 2), f"{name}_count": F.log1p(n.cast("double"))}).drop("_own_blocked", "_own_n")
    return rows


def fit(labelled: DataFrame, sample: int = SAMPLE_URLS):
    """(model, statistics) from rows with _url, _host, _path and _label 0 or 1; or (None, the only label), (None, 0) without rows.

    The statistics count all rows; the trees learn from those of the other ``FOLDS`` - 1 folds, so no row's label is in its own. They are fitted on about ``sample`` rows, chosen by a hash of the URL and, where there is
    one, ``_id``.
    """
    key = [c for c in ("_id", "_url") if c in labelled.columns]
    labelled = labelled.withColumn("_fold", F.pmod(F.xxhash64(*key, F.lit(4)), F.lit(FOLDS)))
    counted = cut(
        labelled.groupBy(F.substring_index("_host", ".", -2).alias("_domain"), "_fold")
        .agg(F.sum("_label").alias("blocked"), F.count("*").alias("n")).withColumn("_suffix", F.substring_index("_domain", ".", -1))
    )
    total = counted.agg(F.sum("n")).first()[0] or 0
    chance = F.pmod(F.xxhash64(*key, F.lit(3)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = lexical(labelled.where(chance < min(1.0, sample / max(1, total)))).persist()
    kinds = sorted(r["_label"] for r in chosen.select("_label").distinct().collect())  # two at most
    if len(kinds) < 2:
        chosen.unpersist()
        return None, (kinds or [0])[0]
    def sums(name: str, *by: str) -> DataFrame:
        return counted.groupBy(f"_{name}", *by).agg(F.sum("blocked").alias(f"_{name}_blocked"), F.sum("n").alias(f"_{name}_n"))

    tables = {name: sums(name) for name in ("suffix", "domain")}
    folded = {name: sums(name, "_fold") for name in tables}
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="_features")
    rows = assembler.transform(_with_statistics(chosen, tables, folded))
    rows = rows.select("_features", F.col("_label").cast("double").alias("_label")).repartition(2).persist()
    trees = GBTClassifier(featuresCol="_features", labelCol="_label", maxIter=TREES, maxDepth=DEPTH, seed=1)
    model = trees.fit(rows)
    for used in (rows, chosen):
        used.unpersist()
    return model, tables


def judge(pages: DataFrame, rules=RULES, sample: int = SAMPLE_URLS) -> DataFrame:
    """``pages`` (url, any others) with ``_host``, ``_path``, ``_rule``, ``_verdict`` and ``_block_score`` (null where a rule decides).

    The verdict is the rule's; else the trees', which learn from the URLs with a rule. With one kind of label only, that is the
    verdict of all the rest; without labels it is ``allow``. Null URLs and those without ``://`` have empty host and path and are judged by the
    trees. Repeated rows are judged alike. Columns whose names begin with an underscore or are names of features come through
    unchanged only if they do not clash: underscore names are left out, others are kept. An empty table gives no rows.
    """
    others = [c for c in pages.columns if not c.startswith("_")]
    host, path = parts(F.col("url").cast("string"))
    kept = F.struct(*others).alias("_row") if others else F.lit(0).alias("_row")
    page = F.col("page_id") if "page_id" in pages.columns else F.lit(0)
    rows = pages.select(kept, page.cast("string").alias("_id"), F.col("url").cast("string").alias("_url"), host.alias("_host"), path.alias("_path"))
    rule, verdict = matched(F.col("_host"), F.col("_path"), rules)
    rows = rows.withColumns({"_rule": rule, "_says": verdict})
    model, tables = fit(rows.where("_says IS NOT NULL").select("_id", "_url", "_host", "_path", (F.col("_says") == "block").cast("int").alias("_label")), sample)
    if model is None:
        scored = rows.withColumn("_block_score", F.when(F.col("_says").isNull(), F.lit(float(tables))))
    else:
        assembler = VectorAssembler(inputCols=FEATURES, outputCol="_features", handleInvalid="keep")
        ready = assembler.transform(_with_statistics(lexical(rows), tables))
        scored = model.transform(ready).withColumn(
            "_block_score", F.when(F.col("_says").isNull(), vector_to_array("probability")[1])
        )
    verdict = F.coalesce("_says", F.when(F.col("_block_score") >= 0.5, "block").otherwise("allow"))
    return scored.select("_row.*", "_host", "_path", "_rule", verdict.alias("_verdict"), "_block_score")
