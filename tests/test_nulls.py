"""Missing times, gaps, groups and labels give the answers of the source scripts."""

from datetime import datetime, timedelta

import pytest

from clinfeat.codes.values import LabItem, UnitItem, VitalItem
from clinfeat.operators import cohort, measures, meds, ordered, prep, profile

T = datetime(2000, 1, 1)
EVENTS = "subj_id long, enc_id long, item_id int, ts timestamp_ntz, value double, error int"


@pytest.fixture(scope="module")
def stays(spark):
    return spark.createDataFrame([(1, 1), (1, 2)], "subj_id long, enc_id long")


def test_events_without_a_time_come_last(spark, stays):
    events = spark.createDataFrame([(1, 1, 1, None, 9.0, None), (1, 1, 1, T, 5.0, None), (1, 2, 1, None, 7.0, None)], EVENTS)
    labs = {r.enc_id: r.albumin for r in measures.first_labs(events, stays, [LabItem(1, "albumin", 10.0)]).collect()}
    assert labs == {1: 5.0, 2: None}
    vitals = {r.enc_id: r.hr_min for r in measures.first_vitals(events, stays, [VitalItem(1, "hr", 0.0, 10.0)]).collect()}
    assert vitals == {1: 5.0, 2: None}
    weight = measures.first_unit_value(events, [UnitItem(1, 1.0)], "weight").collect()
    assert [(r.enc_id, float(r.weight), r.ts) for r in weight] == [(1, 5.0, T)]


def test_prescriptions_without_a_date_come_last(spark):
    rx = spark.createDataFrame([(1, 1, None, "b"), (1, 1, T, "a"), (1, 2, None, "c")], "subj_id long, enc_id long, startdate timestamp_ntz, drug string")
    assert {r.enc_id: r.first_drug for r in meds.first_prescription(rx).collect()} == {1: "a", 2: "c"}


def test_an_unknown_gap_opens_a_session(spark):
    day = timedelta(days=1)
    info = spark.createDataFrame(
        [(1, 10, 1, T, None, 1.0, "x"), (1, 11, 2, T + 9 * day, T + 10 * day, 1.0, "x"), (1, 12, 3, T + 11 * day, None, 1.0, "x")],
        "subj_id long, enc_id long, hospstay_seq int, start_ts timestamp_ntz, end_ts timestamp_ntz, los_hospital double, code string",
    )
    assert {r.enc_id: r.session for r in cohort.session_members(info).collect()} == {10: 0, 11: 1, 12: 1}


def test_dense_rank_keeps_rows_without_key_or_time(spark):
    df = spark.createDataFrame([(1, T), (1, None), (1, T + timedelta(days=50)), (1, None), (None, T)], "k long, ts timestamp_ntz")
    got = sorted(((r.k, r.ts is not None, r.r) for r in ordered.dense_rank_by_time(df, "k", "ts", "r").collect()), key=str)
    assert got == sorted([(1, True, 1), (1, True, 2), (1, False, 3), (1, False, 3), (None, True, 1)], key=str)


def test_null_is_a_group(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), (1, 2.0)], "g long, v double")
    got = {r.g: (r.n, r.q50) for r in profile.summary_by(df, ["g"], "v").collect()}
    assert got == {None: (2, 2.0), 1: (1, 2.0)}
    counted = df.selectExpr("g", "v", "1L AS n")
    assert sorted((r.v, r.cum_n) for r in ordered.running_totals(counted, ["g"], "v", ["n"]).collect()) == [(1.0, 1), (2.0, 1), (3.0, 2)]


def test_rows_without_a_label_are_left_out(spark):
    df = spark.createDataFrame([(i, i % 2 if i < 9 else None) for i in range(10)], "enc_id long, outcome long")
    assert prep.undersample(df, "outcome", "enc_id").count() == 8
    assert prep.oversample(df, "outcome", "enc_id").count() == 10
    assert prep.stratified_split(df, test_size=0.5).count() == 9


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (float("nan"),), (None,)], "a double")
    assert sorted(r.a for r in prep.impute_median(df, ["a"]).collect()) == [1.0, 2.0, 2.0, 3.0]
    assert prep.fit_scaler(df, ["a"]).mean == {"a": 2.0}
