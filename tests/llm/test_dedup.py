"""Near-dedup, substring dedup and decontamination against plain versions, with awkward rows."""

import hashlib
import random

import brute
import pytest
from pyspark.sql import functions as F

from clinfeat.llm import decontam, graph, near, substring

EXTRA = "id0 string, n_words long, text_a string, component string, h long, m long, first string"


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def corpus():
    """Copies, near copies in a chain, shared passages, a text that repeats itself, awkward texts."""
    rng = random.Random(5)
    rows = [prose(rng, rng.randrange(1, 120)) for _ in range(60)]
    base = prose(rng, 90)
    chain = base.split()
    for k in range(12):
        chain = chain[:]
        chain[k * 7] = f"x{k}"
        rows.append(" ".join(chain))
    rows += [base] * 5 + [base.upper(), base.replace(" ", "\n  ")]
    passage = prose(rng, 60)
    rows += [f"{prose(rng, 30)} {passage} {prose(rng, 25)}" for _ in range(8)]
    rows += [passage, f"{passage}\t{passage}", " ".join(passage.split()[10:45])]
    rows += [None, "", "  \n\t ", "one", "one two", "One two", "é è\u00a0é", "a " * 300, prose(rng, 20), "b " * 300 + "c"]
    long = prose(rng, 30_000, 10**6)
    rows += [long, long + " end", "x" * 5000]
    rng.shuffle(rows)
    return [(3 * i + 1, t) for i, t in enumerate(rows)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    """The corpus with other columns whose names clash with names used inside."""
    df = spark.createDataFrame([(i, t, str(i), 1, "t", "c", 2, 3, "f") for i, t in rows], "doc_id long, text string, " + EXTRA)
    return df.repartition(3)


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 200), (300, 300), (200, 150), (7, 100 - 93)] + [(500, rng.randrange(501, 600)) for _ in range(50)]
    df = spark.createDataFrame([*links, (None, 3), (4, None)], "a long, b long")
    ids = {x for p in links for x in p}
    expected = {i: c for i, c in brute.components(ids, links).items() if i != 300}
    assert dict(graph.components(df).collect()) == expected
    assert graph.components(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [4, 5])
def test_near_duplicates(docs, rows, n):
    got = near.near_duplicates(docs, n).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.near(rows, n, 80)
    assert len(got) == len(rows) and all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_in_many_blocks(spark, monkeypatch):
    """A group whose members are close to some others only: every bucket is compared in blocks, and nothing is lost."""
    monkeypatch.setattr(near, "BLOCK_ROWS", 4)
    rng = random.Random(3)
    base = prose(rng, 60, 10**6).split()
    made = []
    for i in range(70):
        text = base[:]
        for _ in range(rng.randrange(0, 5)):
            text[rng.randrange(60)] = f"y{rng.randrange(10**6)}"
        made.append((i, " ".join(text)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near.near_duplicates(spark.createDataFrame(made, "doc_id long, text string"), 4).collect()}
    assert got == brute.near(made, 4, 80)


def test_near_duplicates_repeated_and_null_ids(spark):
    text = "a b c d e f g"
    df = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text), (3, None), (3, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 1, True)] * 2 + [(2, 1, False), (None, None, True)] + [(3, 3, True)] * 2, key=str)
    assert near.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("window,fine,shard", [(20, 100_000, 1 << 18), (20, 3, 500), (8, 100_000, 1 << 18)])
def test_substring(docs, rows, window, fine, shard, monkeypatch):
    monkeypatch.setattr(substring, "FINE", fine)
    monkeypatch.setattr(substring, "SHARD_WORDS", shard)
    expected = brute.without_repeats(rows, window)
    got = substring.without_repeats(docs, window)
    assert got.columns == [*docs.columns, "_kept_text", "_n_words", "_n_removed", "_kept_sha256"]
    texts = dict(rows)
    for r in got.collect():
        kept, all_ = expected[r.doc_id], brute.words(texts[r.doc_id])
        assert (r._n_words, r._n_removed) == (len(all_), len(all_) - len(kept)), r.doc_id
        assert r._kept_sha256 == hashlib.sha256(" ".join(kept).encode()).hexdigest()
        assert r._kept_text == (texts[r.doc_id] if len(kept) == len(all_) else " ".join(kept))
    assert got.count() == len(rows)


def test_substring_repeated_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (2, text), (0, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r._n_removed) for r in substring.without_repeats(df).collect()), key=str)
    assert got == sorted([(1, 0), (1, 0), (None, 0), (2, 30), (0, 0)], key=str)
    assert substring.without_repeats(df.limit(0)).count() == 0


def test_index_finds_all_windows():
    """Backward search gives the matches of every pattern that occurs more than once."""
    import numpy as np

    rng = np.random.default_rng(2)
    for size, letters in ((400, 3), (50, 1), (300, 40)):
        text = rng.integers(0, letters + 1, size)
        text[-1] = 0
        index = substring.FmIndex(text, 6)
        ends = np.array([e for e in range(4, size) if (text[e - 4:e] > 0).all()], int)
        number, low, high = index.search(text, ends, 4)
        found = {int(ends[i]): sorted(index.suffix[a:b].tolist()) for i, a, b in zip(number, low, high)}
        plain = {}
        for e in ends.tolist():
            at = [i for i in range(size - 3) if (text[i:i + 4] == text[e - 4:e]).all()]
            if len(at) > 1:
                plain[e] = at
        assert found == plain


def test_decontamination(docs, rows, spark):
    rng = random.Random(9)
    texts = [t for _, t in rows if t and len(t.split()) > 60]
    items = [(i, " ".join(texts[i].split()[5:25 + i])) for i in range(10)]
    items += [(20, items[0][1].upper().replace(" ", ", ")), (21, None), (22, ""), (23, "too short"), (24, prose(rng, 40))]
    items += [(25, " ".join([*texts[3].split()[:22], "q", *texts[3].split()[23:60]]))]
    items += [(26, " ".join([*texts[4].split()[:12], "q1", *texts[4].split()[13:20], "q2"]))]
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("words", F.lit("clash"))
    got = {(r.doc_id, r.item_id): r.n_shared for r in decontam.contaminated(docs, benchmark).collect()}
    assert got == brute.contained(rows, items, 5, 0.8)
    assert len(got) > 10 and not {i for _, i in got} & {21, 22, 23, 24}
    assert decontam.contaminated(docs.limit(0), benchmark).count() == 0 == decontam.contaminated(docs, benchmark.limit(0)).count()
    twice = docs.union(docs).union(docs.withColumn("doc_id", F.lit(None).cast("long")))
    assert decontam.contaminated(twice, benchmark).count() == len(got)


def test_decontamination_runs_no_python(docs, spark):
    found = decontam.contaminated(docs, docs.select(F.col("doc_id").alias("item_id"), "text"))  # also with very long items
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan and "Pandas" not in plan
    assert found.where("doc_id = item_id").count() == docs.where("size(filter(split(lower(text), '[^\\\\p{L}\\\\p{N}]+'), w -> w <> '')) > 4").select("doc_id").count()
