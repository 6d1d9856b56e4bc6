"""Steps that many queries share: read once, shuffled once, solved in few passes, with the results of the plain form."""

import random

import pytest
from pyspark.sql import Window as W, functions as F

from clinfeat.codes.values import CONDENSE_PATTERNS, CONDENSE_TAIL, UNKNOWN_CATEGORIES
from clinfeat.functions.text import condense
from clinfeat.learning import models
from clinfeat.operators import encounters, ordered
from clinfeat.plans import dataset as plans, model_queries
from clinfeat.sources import stages


def test_condense_like_the_plain_chain(spark):
    texts = ["ASIAN - CHINESE", "PORTUGUESE", "BLACK PORTUGUESE", "CLINIC REFERRAL/PREMATURE", "TRANSFER FROM A REFERRAL", "WHITE\nREFERRAL", "OTHER",
             "MARRIED", "", None, "UNKNOWN/NOT SPECIFIED", "HISPANIC TRANSFER", "SOUTH AMERICAN", "OTHERS", "NOT WHITE TRANSFER"]
    plain = F.col("t")
    for pattern, value in CONDENSE_PATTERNS:
        plain = F.regexp_replace(plain, pattern, value)
    plain = F.when(plain.isin(UNKNOWN_CATEGORIES), "UNKNOWN").otherwise(plain)
    for pattern, value in CONDENSE_TAIL:
        plain = F.regexp_replace(plain, pattern, value)
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", plain.alias("want"), condense(F.col("t")).alias("got")).collect()
    assert [r["got"] for r in rows] == [r["want"] for r in rows]


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_ranks_leave_rows_where_the_window_put_them(spark):
    rng = random.Random(3)
    data = [(rng.choice([None, 1, 2, 3]), rng.choice([None, *range(40)]), i) for i in range(300)]
    df = spark.createDataFrame(data, "k long, d int, i long").withColumn("ts", F.expr("timestamp_ntz'2020-01-01 00:00:00' + make_dt_interval(d * 5)"))
    out = ordered.dense_rank_by_time(df, "k", "ts", "n")
    want = df.withColumn("n", F.dense_rank().over(W.partitionBy("k").orderBy(F.col("ts").asc_nulls_last())))
    assert sorted(map(str, out.select("i", "n").collect())) == sorted(map(str, want.select("i", "n").collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:  # 7 and 5 with a null-safe join by columns
        assert exchanges(ordered.dense_rank_by_time(df, "k", "ts", "n")) == 5
        assert exchanges(ordered.running_sum_by_number(df, "k", "i", "d", "n")) == 4
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_stays_are_written_once_for_model_input(spark, monkeypatch):
    written = []
    monkeypatch.setattr(model_queries, "STAGED", {})
    monkeypatch.setattr(model_queries, "staged_info", lambda r: written.append(r) or "info")
    monkeypatch.setattr(model_queries, "sources", lambda r: None)
    monkeypatch.setattr(model_queries, "codes", lambda r: None)
    monkeypatch.setattr(plans, "build_dataset", lambda *args: "dataset")
    monkeypatch.setattr(plans, "drug_features", lambda src, codes, dataset, info: info)
    monkeypatch.setattr(plans, "prepare", lambda dataset, columns, flags, strategy: flags)
    monkeypatch.setattr(stages, "materialize", lambda df, name: df)

    class Folder:
        folder = "x"

    Folder.spark = spark
    assert model_queries.prepared(Folder()) == "info" and len(written) == 1


def test_encounters_keep_their_columns(spark):
    start = "timestamp_ntz'2020-01-0{} 10:00:00'"
    adm = spark.sql(f"SELECT 1L enc_id, 7L subj_id, {start.format(1)} start_ts, {start.format(3)} end_ts, 0 expire UNION ALL SELECT 2L, 7L, {start.format(5)}, {start.format(6)}, 1")
    pat = spark.sql("SELECT 7L subj_id, 'M' gender, timestamp_ntz'1980-01-01 00:00:00' dob")
    diag = spark.sql("SELECT 1L enc_id, 1 seq_num, 'a' code UNION ALL SELECT 2L, 1, 'b' UNION ALL SELECT 2L, 2, 'c'")
    out = encounters.encounter_info(adm, pat, diag)
    assert out.columns[-4:] == ["los_hospital", "age", "hospstay_seq", "first_hosp_stay"] and "dob" not in out.columns
    assert [(r["enc_id"], float(r["los_hospital"]), r["hospstay_seq"], r["first_hosp_stay"]) for r in out.orderBy("enc_id").collect()] == [(1, 2.0, 1, "Y"), (2, 1.0, 2, "N")]


def test_plain_logistic_fit_takes_no_descent(spark, monkeypatch):
    rng = random.Random(2)
    data = [(i, y := int(rng.random() < 0.3), rng.gauss(y, 1), rng.gauss(0, 3)) for i in range(200)]
    rows = spark.createDataFrame(data, "enc_id long, outcome int, a double, b double")
    slow = models.fit(rows, ["a", "b"], "logistic", regParam=1 / 200)
    monkeypatch.setitem(models.ESTIMATORS, "logistic", None)
    fast = models.fit(rows, ["a", "b"])
    path = stages.new_path(spark, "logistic")
    stages.save_model(fast, path)
    want = {r["enc_id"]: r for r in models.score(slow, rows).collect()}
    scored = models.score(stages.load_model(path), rows)
    assert set(scored.columns) == set(models.score(slow, rows).columns)
    for r in scored.collect():
        assert r["score"] == pytest.approx(want[r["enc_id"]]["score"], abs=1e-5)
    with pytest.raises(Exception, match="missing values"):
        models.fit(rows.withColumn("a", F.when(F.col("enc_id") != 5, F.col("a"))), ["a", "b"])


def test_tree_fits_read_few_rows_in_few_partitions(spark, monkeypatch):
    rows = spark.createDataFrame([(i, i % 2, float(i)) for i in range(200)], "enc_id long, outcome int, a double").repartition(24)
    assert models.gathered(rows).rdd.getNumPartitions() == 4
    assert models.gathered(rows, 10, 1).rdd.getNumPartitions() == 20
    seen = []
    monkeypatch.setattr(models.RandomForestClassifier, "_fit", lambda self, df: seen.append(df.rdd.getNumPartitions()) or models.LogisticModel(coefficients=[1.0]))
    models.fit(rows, ["a"], "forest", numTrees=1)
    assert seen == [4]
