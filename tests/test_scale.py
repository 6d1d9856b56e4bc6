"""Hot groups give the same rows as plain windows, and plans keep their shape."""

import random
import re
import statistics
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import Window as W, functions as F

from clinfeat.operators import measures, meds, ordered, prep, profile
from clinfeat.plans import model_queries  # noqa: F401
from clinfeat.plans.catalogue import QUERIES
from clinfeat.plans.oracles import ORACLES
from clinfeat.sources.retail import Retail, TEST_LABS, TEST_VITALS

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows belong to subject 0."""
    rng = random.Random(7)
    rows = []
    for i in range(6000):
        subj = 0 if i % 3 == 0 else rng.randrange(1, 400)
        ts = datetime(2000, 1, 1) + timedelta(hours=rng.randrange(24 * 365 * 4))
        rows.append((subj, i, ts, rng.randrange(2), float(rng.randrange(500)) / 7))
    return spark.createDataFrame(
        rows, "subj_id long, enc_id long, ts timestamp_ntz, flag int, v double"
    ).cache()


def same(a, b):
    assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)


def test_dense_rank_equals_the_plain_window(skewed):
    w = W.partitionBy("subj_id").orderBy("ts")
    plain = skewed.select("enc_id", F.dense_rank().over(w).alias("r"))
    same(ordered.dense_rank_by_time(skewed, "subj_id", "ts", "r").select("enc_id", "r"), plain)


def test_running_sum_equals_the_plain_window(skewed):
    ranked = skewed.withColumn("n", F.row_number().over(W.partitionBy("subj_id").orderBy("ts", "enc_id")))
    w = W.partitionBy("subj_id").orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    plain = ranked.select("enc_id", F.sum("flag").over(w).alias("s"))
    sliced = ordered.running_sum_by_number(ranked, "subj_id", "n", "flag", "s", width=50)
    same(sliced.select("enc_id", "s"), plain)


@pytest.mark.parametrize("by", [[], ["subj_id"]])
def test_running_totals_equal_the_plain_window(skewed, by):
    rows = skewed.groupBy(*by, "v").agg(F.sum("flag").alias("f"))
    w = W.partitionBy(*by).orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    plain = rows.select(*by, "v", F.sum("f").over(w).alias("c"))
    same(ordered.running_totals(rows, by, "v", ["f"]).select(*by, "v", "cum_f"), plain)


def test_quantiles_are_exact(skewed):
    probs = {"a": 0.0, "b": 0.013, "c": 0.5, "d": 0.75, "e": 1.0}
    got = {r["subj_id"]: r for r in ordered.exact_quantiles(skewed, ["subj_id"], "v", probs).collect()}
    values = {}
    for r in skewed.select("subj_id", "v").collect():
        values.setdefault(r["subj_id"], []).append(r["v"])
    assert set(got) == set(values)
    for k, vs in values.items():
        want = np.quantile(vs, list(probs.values()))
        assert np.allclose([got[k][n] for n in probs], want, rtol=0, atol=1e-9)


def test_one_value_may_be_most_of_the_data(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.col("id") * 1.0).alias("v"))
    got = ordered.exact_quantiles(df, [], "v", {"m": 0.5, "n": 0.2}).first()
    vs = [7.0 if i % 3 == 0 else float(i) for i in range(5000)]
    assert (got["m"], got["n"]) == tuple(np.quantile(vs, [0.5, 0.2]))


def test_undersampling_takes_the_first_rows_in_hash_order(skewed):
    df = skewed.select("enc_id", (F.col("enc_id") % 3 == 0).cast("int").alias("c"))
    out = prep.undersample(df, "c", "enc_id")
    w = W.partitionBy("c").orderBy(ordered.hash_order("enc_id", 42))
    plain = df.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= 2000).drop("n")
    same(out.select("enc_id", "c"), plain.select("enc_id", "c"))


def test_oversampling_repeats_every_row(spark, monkeypatch):
    monkeypatch.setattr(prep, "COPY_BLOCK", 16)      # several blocks of copies per row
    df = spark.range(1003).select(F.col("id").alias("enc_id"), (F.col("id") < 3).cast("int").alias("c"))
    out = prep.oversample(df, "c", "enc_id")
    per_row = out.filter("c = 1").groupBy("enc_id").agg(F.count("*").alias("n"), F.count_distinct("copy").alias("m"))
    counts = [(r["n"], r["m"]) for r in per_row.collect()]
    assert sum(n for n, _ in counts) == 1000 and all(n == m and n in (333, 334) for n, m in counts)
    assert out.filter("c = 0").count() == 1000


def test_split_has_exact_class_shares(skewed):
    df = skewed.select("enc_id", (F.col("enc_id") % 3 == 0).cast("int").alias("outcome"))
    shares = prep.stratified_split(df).groupBy("outcome", "is_test").count().collect()
    assert {(r["outcome"], r["is_test"]): r["count"] for r in shares} == {
        (0, True): 800, (0, False): 3200, (1, True): 400, (1, False): 1600}


def nearest_by_hand(rows, k=3):
    out = {}
    for i, x in rows.items():
        for j, v in enumerate(x):
            if v is not None:
                continue
            found = []
            for d, y in rows.items():
                if d == i or y[j] is None:
                    continue
                sq = [(a - b) ** 2 for a, b in zip(x, y) if a is not None and b is not None]
                if sq:
                    found.append((round(sum(sq) / len(sq), 9), d, y[j]))
            best = sorted(found)[:k]
            if best:
                ws = [1 / max(d, 1e-6) for d, _, _ in best]
                out[i, j] = sum(w * v for w, (_, _, v) in zip(ws, best)) / sum(ws)
    return out


@pytest.mark.parametrize("block_rows", [7, 2048])
def test_nearest_rows_match_brute_force(spark, block_rows):
    rng = random.Random(3)
    rows = {i: [None if rng.random() < 0.25 else round(rng.gauss(0, 1), 2) for _ in range(4)] for i in range(60)}
    rows[60] = [None] * 4                              # nothing shared with anyone
    rows[61] = list(rows[5])
    df = spark.createDataFrame([(i, *x) for i, x in rows.items()], "enc_id long, a double, b double, c double, d double")
    want = nearest_by_hand(rows)
    got = {r["enc_id"]: r for r in prep.impute_nearest(df, list("abcd"), block_rows=block_rows).collect()}
    assert len(got) == len(rows)
    for i, x in rows.items():
        for j, name in enumerate("abcd"):
            expected = x[j] if x[j] is not None else want.get((i, j))
            assert got[i][name] == (None if expected is None else pytest.approx(expected, abs=1e-9))


def test_median_imputation_uses_the_fitted_rows(spark):
    train = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (5.0,)], "a double")
    test = spark.createDataFrame([(None,), (9.0,)], "a double")
    assert [r["a"] for r in prep.impute_median(test, ["a"], train).collect()] == [3.0, 9.0]


def test_density_integrates_to_one(spark):
    df = spark.range(2000).select((F.randn(5) * 2 + 10).alias("v"))
    rows = profile.density(df, "v", 0.0, 20.0, 0.5, points=201, bins=400).collect()
    assert abs(sum(r["density"] for r in rows) * 0.1 - 1) < 0.01


def test_frame_summary_matches_statistics(spark):
    vs = [float(x) for x in (3, 1, 4, 1, 5, 9, 2, 6)]
    df = spark.createDataFrame([(v, None if v == 9 else v) for v in vs], "a double, b double")
    rows = {r["feature"]: r for r in profile.frame_summary(df, ["a", "b"]).collect()}
    assert rows["a"]["std"] == pytest.approx(statistics.stdev(vs)) and rows["b"]["n"] == 7
    assert rows["a"]["q50"] == statistics.median(vs)


# Plans

def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_first_values_scan_events_once_and_prune_before_the_shuffle(spark):
    r = Retail(spark, FOLDER)
    events = r.table("lineitem").select(
        F.col("l_partkey").alias("subj_id"), F.col("l_orderkey").alias("enc_id"),
        F.col("l_linenumber").alias("item_id"), F.col("l_shipdate").alias("ts"),
        F.col("l_quantity").alias("value"), F.lit(None).cast("int").alias("error"),
    )
    stays = r.table("orders").select(F.col("o_custkey").alias("subj_id"), F.col("o_orderkey").alias("enc_id"))
    for df in (measures.first_labs(events, stays, TEST_LABS), measures.first_vitals(events, stays, TEST_VITALS)):
        text = plan(df)
        assert len(re.findall("FileScan.*lineitem", text)) == 1
        assert "WindowGroupLimit" in text and "rank(ts" in text and ", Partial" in text
        scan = next(line for line in text.splitlines() if "FileScan" in line and "lineitem" in line)
        assert "In(l_linenumber" in scan or "l_linenumber" in scan.split("PushedFilters")[1]
        assert "l_tax" not in scan


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_no_all_pairs_joins_and_no_row_python(spark, name):
    text = plan(QUERIES[name](spark, FOLDER))
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert node not in text, node


def test_windows_never_hold_a_whole_subject_or_table(spark):
    """Windows over raw stays are cut by slice; a window without partition only sees slice totals."""
    for name in ("encounter_info", "session_members", "roc_points", "balance_orders"):
        for line in plan(QUERIES[name](spark, FOLDER)).splitlines():
            if "dense_rank(" in line:
                assert "_slice" in line


def test_cumulative_counts_read_the_prescriptions_once(spark):
    rx = Retail(spark, FOLDER).table("events").select(
        F.col("user_id").alias("subj_id"), F.col("user_id").alias("enc_id"),
        F.to_date("ts").alias("day_prescribed"), "event_type")
    assert len(re.findall("FileScan", plan(meds.cumulative_distinct(rx, "event_type", "n")))) == 1
