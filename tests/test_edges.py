"""Small literal fixtures: nulls, ties, bounds and empty cases."""

from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from clinfeat.codes.values import LAB_ITEMS, MODEL_FEATURES, ONEHOT_FEATURES, VITAL_ITEMS
from clinfeat.functions import numbers, text, time
from clinfeat.operators import cohort, encounters, features, measures, meds, prep, profile

T0 = datetime(2100, 1, 10, 8, 30)
EVENTS = "subj_id long, enc_id long, item_id int, ts timestamp_ntz, value double, error int"


def h(n):
    return T0 + timedelta(hours=n)


def frame(spark, schema, rows):
    return spark.createDataFrame(rows, schema)


def stays(spark, n=3):
    return frame(spark, "subj_id long, enc_id long, start_ts timestamp_ntz",
                 [(i, 10 + i, T0) for i in range(1, n + 1)])


def by_stay(df):
    return {r["enc_id"]: r.asDict() for r in df.collect()}


ALBUMIN, GLUCOSE_A, GLUCOSE_B = 50862, 50809, 50931


def test_first_lab_above_limit_is_null_and_has_no_fallback(spark):
    ev = frame(spark, EVENTS, [
        (1, 11, ALBUMIN, h(0), 11.0, None), (1, 11, ALBUMIN, h(1), 4.0, None),
        (2, 12, ALBUMIN, h(0), 0.0, None), (2, 12, ALBUMIN, h(1), 4.0, None),
        (9, 99, ALBUMIN, h(0), 4.0, None), (3, None, ALBUMIN, h(0), 4.0, None),
    ])
    out = by_stay(measures.first_labs(ev, stays(spark)))
    assert set(out) == {11, 12}
    assert out[11]["albumin"] is None
    assert out[12]["albumin"] == 4.0      # zero is not a measurement, so the next one is the first
    assert len(out[11]) == 2 + 19


def test_two_items_of_one_label_and_ties_take_the_minimum(spark):
    ev = frame(spark, EVENTS, [
        (1, 11, GLUCOSE_A, h(0), 90.0, None), (1, 11, GLUCOSE_B, h(0), 80.0, None),
        (1, 11, GLUCOSE_B, h(1), 10.0, None),
    ])
    assert by_stay(measures.first_labs(ev, stays(spark)))[11]["glucose"] == 80.0


def test_vitals_use_the_first_valid_value(spark):
    ev = frame(spark, EVENTS, [
        (1, 11, 211, h(0), 300.0, None), (1, 11, 211, h(1), 80.0, 0), (1, 11, 220045, h(1), 90.0, None),
        (1, 11, 211, h(0), 70.0, 1),
        (2, 12, 211, h(0), -5.0, None),
        (3, 13, 678, h(0), 98.6, None), (3, 13, 646, h(0), 100.0, None),
    ])
    out = by_stay(measures.first_vitals(ev, stays(spark)))
    assert (out[11]["heartrate_min"], out[11]["heartrate_max"], out[11]["heartrate_mean"]) == (80.0, 90.0, 85.0)
    assert all(v is None for k, v in out[12].items() if k not in ("subj_id", "enc_id"))
    assert out[13]["tempc_mean"] == (98.6 - 32) / 1.8
    assert out[13]["spo2_max"] == 100.0


def test_windows_include_their_ends(spark):
    ev = frame(spark, EVENTS, [
        (1, 11, ALBUMIN, h(-6), 1.0, None), (1, 11, ALBUMIN, h(6), 3.0, None),
        (1, 11, ALBUMIN, h(6) + timedelta(microseconds=1), 9.0, None),
        (1, 11, ALBUMIN, h(-6) - timedelta(microseconds=1), 0.5, None),
        (2, 12, 211, h(0), 60.0, None), (2, 12, 211, h(6), 70.0, None), (2, 12, 211, h(-1), 10.0, None),
    ])
    labs = by_stay(measures.labs_window(ev, stays(spark)))
    assert (labs[11]["albumin_min"], labs[11]["albumin_max"]) == (1.0, 3.0)
    assert set(labs) == {11, 12, 13}      # stays without labs stay in
    vitals = by_stay(measures.vitals_window(ev, stays(spark)))
    assert set(vitals) == {12}            # stays without vitals do not
    assert (vitals[12]["heartrate_min"], vitals[12]["heartrate_max"]) == (60.0, 70.0)


def test_window_buckets_match_a_plain_range_join_before_1970_too(spark):
    rows = [(1, 11, 211, datetime(1969, 12, 31, 20) + timedelta(minutes=7 * i), 50.0 + i, None) for i in range(150)]
    st = frame(spark, "subj_id long, enc_id long, start_ts timestamp_ntz", [(1, 11, datetime(1969, 12, 31, 23, 59, 59))])
    ev = frame(spark, EVENTS, rows)
    got = measures.near_start(ev, st, 0, 6).count()
    want = sum(datetime(1969, 12, 31, 23, 59, 59) <= r[3] <= datetime(1970, 1, 1, 5, 59, 59) for r in rows)
    assert got == want


def test_weight_and_height(spark):
    ev = frame(spark, EVENTS, [
        (1, 11, 3581, h(0), 100.0, None), (1, 11, 762, h(0), 44.0, None), (1, 11, 762, h(1), 1.0, None),
        (1, 11, 762, h(-1), 50.0, 1), (1, 11, 762, h(-1), 0.0, None),
        (1, 11, 226531, h(-2), 100.0, None), (2, 12, 920, h(0), 70.0, None),
    ])
    weight = by_stay(measures.first_weight(ev))
    assert weight[11]["weight_first"] == Decimal("44.00")      # smaller than 100 lb at the same time
    assert weight[11]["ts"] == h(0)
    assert by_stay(measures.first_height(ev))[12]["height_first"] == Decimal("177.80")


DIAG = "subj_id long, enc_id long, code string, seq_num int"
MICRO = "subj_id long, enc_id long, org_name string, ts timestamp_ntz"
INFO = "subj_id long, enc_id long, start_ts timestamp_ntz, hospstay_seq int, code string"


def test_evidence_multiplies_and_lab_only_rows_lose_their_id(spark):
    diag = frame(spark, DIAG, [(1, 11, "00845", 1), (1, 11, "00845", 4), (2, 12, "4280", 1), (3, 13, "00845", 2)])
    micro = frame(spark, MICRO, [
        (1, 11, "CLOSTRIDIUM DIFFICILE", h(24)), (1, 11, "c. difficile", h(48)),
        (2, 12, "DIFF", h(1)), (None, 12, "DIFF", h(1)), (2, 12, "E. COLI", h(1)),
    ])
    info = frame(spark, INFO, [(1, 11, T0, 1, "00845"), (2, 12, T0, 1, "4280"), (3, 13, T0, 1, "x")])
    rows = cohort.evidence(diag, micro, info).collect()
    assert sum(r["enc_id"] == 11 for r in rows) == 4
    lab_only = [r for r in rows if r["enc_id"] is None]
    assert len(lab_only) == 1 and lab_only[0]["org_name"] == "DIFF" and lab_only[0]["chart_timelag"] is None
    assert [r["org_name"] for r in rows if r["enc_id"] == 13] == [None]
    flags = {r["enc_id"]: r["outcome"] for r in cohort.outcome_flag(info, cohort.evidence(diag, micro, info)).collect()}
    assert flags == {11: True, 12: False, 13: True}
    joined = cohort.evidence(diag, micro, info, coalesce_ids=True)
    assert {r["enc_id"] for r in joined.collect()} == {11, 12, 13}
    for lab, found in ((None, cohort.evidence(diag, micro, info)), (micro, joined)):
        own = cohort.coded_outcome(info, diag, lab)
        assert sorted(own.collect()) == sorted(cohort.outcome_flag(info, found).collect())
        plan = own._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join") == 1  # the stays meet nothing but the ids


def sessions_of(spark, gaps_days, los=1.0):
    rows, start = [], T0
    for i, gap in enumerate([0, *gaps_days]):
        start = start + timedelta(days=gap + (los if i else 0))
        rows.append((1, 100 + i, start, start + timedelta(days=los), Decimal("1.0000"), f"c{i}", i + 1))
    return frame(spark, "subj_id long, enc_id long, start_ts timestamp_ntz, end_ts timestamp_ntz, "
                        "los_hospital decimal(23,4), code string, hospstay_seq int", rows)


def test_gaps_join_below_91_days(spark):
    info = sessions_of(spark, [90.99, 91.0, -0.5])
    got = {r["enc_id"]: r["session"] for r in cohort.session_members(info).collect()}
    assert got == {100: 0, 101: 0, 102: 1, 103: 1}
    rolled = sorted(cohort.multistay(cohort.session_members(info)).collect(), key=lambda r: r["session"])
    assert [r["combined_enc_id"] for r in rolled] == [[100, 101], [102, 103]]
    assert [r["other_enc_id"] for r in rolled] == [[101], [103]]
    assert rolled[0]["codes"] == ["c0", "c1"] and rolled[0]["cumulative_los"] == Decimal("2.0000")


def test_long_sessions_are_one_row(spark):
    members = cohort.session_members(sessions_of(spark, [1] * 6))
    row, = cohort.multistay(members).collect()
    assert row["combined_enc_id"] == list(range(100, 107)) and row["num_stays"] == 7
    assert cohort.session_stays(members).count() == 7


def test_stays_with_the_same_start_share_sequence_and_session(spark):
    adm = frame(spark, "subj_id long, enc_id long, start_ts timestamp_ntz, end_ts timestamp_ntz", [
        (1, 20, T0, h(24)), (1, 21, T0, h(48)), (1, 22, h(24 * 120), h(24 * 121)),
    ])
    pat = frame(spark, "subj_id long, gender string, dob timestamp_ntz", [(1, "M", datetime(2050, 1, 1))])
    diag = frame(spark, DIAG, [(1, e, "4280", 1) for e in (20, 21, 22)] + [(1, 20, "0389", 2)])
    info = encounters.encounter_info(adm, pat, diag)
    assert {r["enc_id"]: r["hospstay_seq"] for r in info.collect()} == {20: 1, 21: 1, 22: 2}
    gaps = {r["enc_id"]: r["gap_days"] for r in cohort.stay_gaps(info).collect()}
    assert gaps == {20: None, 21: None, 22: 119.0}      # from the end of the lower id
    assert {r["enc_id"]: r["session"] for r in cohort.session_members(info).collect()} == {20: 0, 21: 0, 22: 1}


def test_merge_lifts_the_outcome_and_loses_sessions_without_their_first_stay(spark):
    members = cohort.session_members(sessions_of(spark, [1, 200, 1]))
    out = "enc_id long, outcome boolean"
    kept = cohort.merge_close_stays(frame(spark, out, [(100, False), (101, True), (103, True), (500, False)]), members)
    assert {r["enc_id"]: r["outcome"] for r in kept.collect()} == {100: True, 500: False}


def test_relative_days(spark):
    df = frame(spark, "d timestamp_ntz, a timestamp_ntz", [
        (datetime(2100, 1, 9), T0), (datetime(2100, 1, 10), T0), (datetime(2100, 1, 11), T0),
    ])
    rows = df.select(time.relative_day(F.col("d"), F.col("a")).alias("x"), time.date_lag(F.col("d"), F.col("a")).alias("y"))
    assert [tuple(r) for r in rows.collect()] == [(0, -1), (1, 0), (2, 1)]


RX = "subj_id long, enc_id long, startdate timestamp_ntz, drug_type string, drug string"


def test_spellings_are_exact_and_unlisted_drugs_drop(spark):
    rx = frame(spark, RX, [
        (1, 11, datetime(2100, 1, 10), "MAIN", "Vancomycin "), (1, 11, datetime(2100, 1, 10), "MAIN", "Vancomycin"),
        (1, 11, datetime(2100, 1, 10), "MAIN", "vancomycin"), (1, 11, datetime(2100, 1, 10), "BASE", "Vancomycin"),
        (1, 11, datetime(2100, 1, 11), "MAIN", "Methimazole"), (1, 11, datetime(2100, 1, 12), "MAIN", "Aspirin"),
        (1, 11, datetime(2100, 1, 12), "MAIN", "Clindamycin"),
    ])
    named = meds.normalised_prescriptions(rx, stays(spark))
    rows = sorted(((r["day_prescribed"], r["drug_name"]) for r in named.collect()), key=str)
    assert rows == [(1, "Vancomycin"), (2, None), (3, "Clindamycin")]
    cls = {r["drug_name"]: r for r in meds.classified_prescriptions(named).collect()}
    assert cls[None]["drug_class"] is None and cls[None]["spectrum"] == "Narrow"
    assert cls[None]["drug_group"] is None and cls[None]["association"] == "None"
    assert cls["Clindamycin"]["association"] == "None"
    fixed = {r["drug_name"]: r for r in meds.classified_prescriptions(named, corrected_association=True).collect()}
    assert fixed["Clindamycin"]["association"] == "High"
    assert meds.prescriptions_in_scope(rx, stays(spark)).count() == 4


def test_none_marks_only_stays_without_early_prescription(spark):
    early = frame(spark, "enc_id long, drug_group string, association string",
                  [(11, None, "None"), (12, "Macrolide", "Moderate"), (12, "Macrolide", "Moderate"), (12, "Other", "None")])
    flags = by_stay(meds.multi_hot_drugs(stays(spark).select("enc_id"), early))
    assert flags[11]["None"] == 0 and sum(v for k, v in flags[11].items() if k != "enc_id") == 0
    assert flags[13]["None"] == 1
    assert flags[12]["Macrolide"] == 1 and flags[12]["Other"] == 1
    sets = by_stay(meds.group_sets(early))
    assert sets[11]["drug_groups"] == [] and sets[12]["drug_groups"] == ["Macrolide", "Other"]


def test_cumulative_distinct_counts_peers_and_skips_nulls(spark):
    rx = frame(spark, "subj_id long, enc_id long, day_prescribed int, c string",
               [(1, 11, 1, "a"), (1, 11, 1, "b"), (1, 11, 2, "a"), (1, 11, 3, None), (1, 11, 4, "c"), (1, 12, 1, None)])
    got = {(r["enc_id"], r["day_prescribed"]): r["n"] for r in meds.cumulative_distinct(rx, "c", "n").collect()}
    assert got == {(11, 1): 2, (11, 2): 2, (11, 3): 2, (11, 4): 3, (12, 1): 0}


def test_completeness_keeps_34_of_46(spark):
    def row(i, filled):
        extra = filled - 3
        return [1.0 if j < extra else None for j in range(43)] + [0, 0, i]

    schema = ", ".join(f"`{c}` double" for c in MODEL_FEATURES) + ", outcome int, expire int, enc_id long"
    df = frame(spark, schema, [tuple(row(33, 33)), tuple(row(34, 34))])
    assert len(MODEL_FEATURES) == 43
    assert [r["enc_id"] for r in prep.select_features(df).select("enc_id").collect()] == [34]


def test_scaler_leaves_flags_alone(spark):
    df = frame(spark, "a double, b int, c double", [(1.0, 0, 5.0), (3.0, 1, 5.0), (None, 1, 5.0)])
    scaler = prep.fit_scaler(df, ["a", "b", "c"])
    assert scaler.binary == ["b"]
    rows = [tuple(r) for r in prep.apply_scaler(df, scaler).collect()]
    assert rows == [(-1.0, 0, 0.0), (1.0, 1, 0.0), (None, 1, 0.0)]


def test_age_bands_are_closed_on_the_right(spark):
    ages = [-300.0, -299.0, 0.0, 0.1, 18.0, 18.1, 100.0, 100.1, None]
    df = frame(spark, "a double", [(a,) for a in ages]).select(numbers.age_band(F.col("a")).alias("b"))
    assert [r["b"] for r in df.collect()] == [None, "exclude", "exclude", "youth", "youth", "18-39", ">89", None, None]


def test_letter_codes_have_no_number(spark):
    df = frame(spark, "code string", [("E8788",), ("V1254",), ("0389",), ("4280",), ("A12",)])
    assert [r[0] for r in df.select(text.numeric_prefix(F.col("code"))).collect()] == [None, None, 38, 428, None]


def test_infection_prefixes(spark):
    df = frame(spark, "code string", [("0389",), ("5695",), ("56951",), ("5694",), ("49121",), ("49120",), ("99931",)])
    assert [r[0] for r in df.select(text.has_prefix(F.col("code"))).collect()] == [1, 1, 1, 0, 1, 0, 1]


def test_condensing_is_ordered(spark):
    values = ["BLACK/AFRICAN AMERICAN", "HISPANIC/LATINO - CENTRAL AMERICAN", "AMERICAN INDIAN/ALASKA NATIVE",
              "PORTUGUESE", "OTHER", "TRANSFER FROM HOSP/EXTRAM", "CLINIC REFERRAL/PREMATURE", None]
    df = frame(spark, "c string", [(v,) for v in values]).select(text.condense(F.col("c")).alias("c"))
    assert [r["c"] for r in df.collect()] == [
        "BLACK", "HISPANIC", "AMERICAN INDIAN", "WHITE", "UNKNOWN", "TRANSFER", "REFERRAL", None]


def test_derived_features(spark):
    df = frame(spark, "enc_id long, start_ts timestamp_ntz, height double, weight double, age double, "
                      "albumin double, spo2_mean double, bun double",
               [(1, datetime(2100, 1, 1, 5, 30), 200.0, 80.0, 300.0, 3.0, 2.0, 1.0),
                (2, datetime(2100, 1, 1, 7, 0), 59.0, 401.0, 40.0, None, None, None)])
    a, b = features.derive_features(df).orderBy("enc_id").collect()
    assert (a["bmi"], a["age"], a["rescaled_time"], a["am_admit"]) == (20.0, 90.0, 23.5, 0)
    assert (a["albumin_2"], a["spo2_mean_3"], a["log_bun"]) == (9.0, 8.0, 0.0)
    assert (b["height"], b["weight"], b["bmi"], b["am_admit"], b["rescaled_time"]) == (None, None, None, 1, 1.0)


def test_numeric_edges(spark):
    df = frame(spark, "x double", [(0.0,), (10.0,), (9.99,), (10.1,), (None,)])
    bins = df.select(numbers.histogram_bin(F.col("x"), F.lit(0.0), F.lit(10.0), 5)).collect()
    assert [r[0] for r in bins] == [1, 5, 5, None, None]
    half = frame(spark, "x double", [(0.125,), (-0.125,)]).select(numbers.round_half_away(F.col("x"), 2)).collect()
    assert [r[0] for r in half] == [Decimal("0.13"), Decimal("-0.13")]


def test_crosstab_cells_without_rows_are_null(spark):
    df = frame(spark, "r string, c string", [("a", "x"), ("a", "x"), ("b", "y")])
    out = {r["r"]: (r["x"], r["y"]) for r in profile.crosstab(df, "r", "c", ["x", "y"]).collect()}
    assert out == {"a": (2, None), "b": (None, 1)}


def test_suffix_join(spark):
    a = frame(spark, "k int, v int", [(1, 2), (3, 4)])
    b = frame(spark, "k int, v int, w int", [(1, 5, 6)])
    out = encounters.with_suffixes(a, b, "k", ("_l", "_r"))
    assert out.columns == ["k", "v_l", "v_r", "w"]
    assert sorted(tuple(r) for r in out.collect()) == [(1, 2, 5, 6), (3, 4, None, None)]


def test_dictionary_sizes():
    assert len({i.item_id for i in LAB_ITEMS}) == 26 and len(measures.lab_labels()) == 19
    assert len({i.item_id for i in VITAL_ITEMS}) == 39 and len(measures.vital_names()) == 8
    assert len(ONEHOT_FEATURES) == 14


def test_unknown_names_are_refused(spark):
    from clinfeat.learning.models import estimator
    from clinfeat.plans.dataset import prepare

    with pytest.raises(ValueError):
        estimator("RF")
    with pytest.raises(ValueError):
        prepare(None, strategy="mode")
