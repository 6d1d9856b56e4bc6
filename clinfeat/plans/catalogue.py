"""Named queries over the test tables: each takes a session and a folder."""

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DecimalType

from clinfeat.codes.values import ONEHOT_FEATURES, SEED
from clinfeat.codes.tables import from_rows
from clinfeat.functions import numbers, text, time
from clinfeat.operators import cohort, encounters, features, measures, meds, prep, profile
from clinfeat.plans import dataset as plans
from clinfeat.sources import files, stages
from clinfeat.sources.graph import StageGraph
from clinfeat.sources.retail import (
    Retail, TEST_DICTIONARY, TEST_HEIGHTS, TEST_LABS, TEST_PATTERN, TEST_SPELLINGS, TEST_UNNAMED, TEST_VITALS,
    TEST_WEIGHTS,
)

QUERIES = {}


def query(fn):
    """Register under the function's name; decimals leave as doubles."""
    def run(spark, folder):
        return plain(fn(Retail(spark, folder)))

    QUERIES[fn.__name__] = run
    return run


def plain(df: DataFrame) -> DataFrame:
    return df.select(*[
        F.col(f"`{f.name}`").cast("double").alias(f.name) if isinstance(f.dataType, DecimalType)
        else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])


def rounded(df: DataFrame, columns, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(f"`{c}`").cast("double"), digits) for c in columns})


# The pieces most queries share.

def sources(r: Retail) -> plans.Sources:
    return plans.Sources(r.enc, r.subj, r.diag, r.meas, r.meas, r.rx, r.micro)


def codes(r: Retail) -> plans.Codes:
    return plans.Codes(TEST_LABS, TEST_VITALS, TEST_WEIGHTS, TEST_HEIGHTS, TEST_SPELLINGS,
                       TEST_UNNAMED, TEST_PATTERN, r.code_is)


def info(r: Retail) -> DataFrame:
    return encounters.encounter_info(r.enc, r.subj, r.diag)


def staged_info(r: Retail) -> DataFrame:
    """Written once, for queries that read it several times."""
    return plans.stay_info(sources(r), staged=True)


def outcomes(r: Retail, stays: DataFrame) -> DataFrame:
    return plans.all_outcomes(sources(r), codes(r), stays)


def staged_outcomes(r: Retail, stays: DataFrame) -> DataFrame:
    return stages.materialize(outcomes(r, stays), "outcomes")


def weight(r: Retail) -> DataFrame:
    return measures.first_weight(r.meas, TEST_WEIGHTS)


def height(r: Retail) -> DataFrame:
    return measures.first_height(r.meas, TEST_HEIGHTS)


def labs(r: Retail) -> DataFrame:
    return measures.first_labs(r.meas, r.enc, TEST_LABS)


def vitals(r: Retail) -> DataFrame:
    return measures.first_vitals(r.meas, r.enc, TEST_VITALS)


def classified(r: Retail) -> DataFrame:
    named = meds.normalised_prescriptions(r.rx, r.enc, TEST_SPELLINGS, TEST_UNNAMED)
    return meds.classified_prescriptions(named)


# Scans and stages

@query
def scan_project(r):
    return r.table("orders").select(
        F.col("o_orderkey").alias("enc_id"), F.col("o_custkey").alias("subj_id"), "o_totalprice"
    )


@query
def csv_roundtrip_lists(r):
    rolled = cohort.multistay(plans.sessions(staged_info(r))).select(
        "subj_id", "first_enc_id", "num_stays", "cumulative_los",
        text.list_text(F.col("combined_enc_id")).alias("combined_enc_id"),
        text.list_text(F.col("other_enc_id")).alias("other_enc_id"),
        text.list_text(F.col("codes"), quote=True).alias("codes"),
    )
    path = stages.new_path(r.spark, "multistay_csv")
    files.write_csv(rolled, path)
    back = files.read_csv(r.spark, path, rolled.schema)
    return back.withColumns({
        "combined_enc_id": F.array_join(text.parse_list(F.col("combined_enc_id"), "bigint"), "|"),
        "other_enc_id": F.array_join(text.parse_list(F.col("other_enc_id"), "bigint"), "|"),
        "codes": F.array_join(text.parse_list(F.col("codes")), "|"),
    })


@query
def stage_tables(r):
    table = stages.save_stage(info(r).select("subj_id", "enc_id", "hospstay_seq"), "clinfeat_encounter_info")
    stages.save_view(table.filter(F.col("hospstay_seq") == 1), "clinfeat_first_stays")
    return r.spark.table("clinfeat_first_stays")


def stage_graph(r: Retail) -> StageGraph:
    """The chain of stages from the tables to the numeric features."""
    g, used = StageGraph(r.spark), codes(r)
    for name, df in (("admissions", r.enc), ("patients", r.subj), ("diagnoses", r.diag), ("events", r.meas)):
        g.source(name, df)
    g.stage("stay_info", ["admissions", "patients", "diagnoses"], encounters.encounter_info)
    g.stage("first_charts", ["events", "admissions"], lambda charts, stays: measures.first_charts(charts, stays, used.vitals, used.weights, used.heights))
    g.stage("first_labs", ["events", "admissions"], lambda events, stays: measures.first_labs(events, stays, used.labs))
    g.stage("vitals_joined", ["first_charts", "stay_info"], features.with_stay_facts)
    g.stage("numeric_features", ["vitals_joined", "first_labs"], features.numeric_features)
    return g


@query
def stage_chain(r):
    """The chain is built, its base dropped with all that was made of it, and rebuilt in order."""
    g = stage_graph(r)
    g.refresh()
    g.drop("stay_info", cascade=True)
    wide = g.table("numeric_features")
    return rounded(wide, mean_columns(wide))


# Projections and filters

@query
def label_items(r):
    return measures.label_labs(r.meas, TEST_LABS)


@query
def range_category(r):
    return rounded(measures.label_vitals(r.meas, TEST_VITALS), ["value"])


@query
def flags_and_caps(r):
    stays = info(r)
    h, w = F.col("height_first"), F.col("weight_first")
    joined = stays.join(weight(r).select("enc_id", "weight_first"), "enc_id", "left").join(
        height(r).select("enc_id", "height_first"), "enc_id", "left"
    ).withColumns({"height": numbers.within(h, 60, 250), "weight": numbers.within(w, 25, 400)})
    bmi = numbers.body_mass_index(F.col("weight").cast("double"), F.col("height").cast("double"))
    primary = r.code_is.cast("int")
    return joined.select(
        "enc_id", "height", "weight", F.round(bmi, 6).alias("bmi"),
        text.is_value(F.col("gender"), "M").alias("gender"), numbers.cap_age(F.col("age")).alias("age"),
        numbers.combined_label(primary, F.col("expire")).alias("death_class"),
    )


@query
def power_log(r):
    q = F.col("l_quantity")
    return r.table("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        (q * q).alias("squared"), (q * q * q).alias("cubed"),
        F.round(numbers.natural_log(q), 6).alias("log_quantity"),
        F.round(numbers.natural_log(F.col("l_discount")), 6).alias("log_discount"),
    )


@query
def condense_categories(r):
    return features.onehot_demographics(r.enc)


@query
def condensed_counts(r):
    return profile.counts(
        r.enc.select(*[text.condense(F.col(c)).alias(c) for c in ("ethnicity", "admission_location")]),
        "ethnicity", "admission_location",
    )


@query
def lag_split(r):
    lagged = encounters.lab_evidence_lag(r.micro, r.enc, TEST_PATTERN)
    hours = time.hours_between(F.col("ts"), F.col("start_ts"))
    return lagged.select(
        "enc_id", "org_name", "ts", "lag_days", "los", "expire",
        text.lag_group(F.col("lag_days")).alias("lag_group"), (hours < 3).alias("within_3h"),
    )


@query
def lag_groups_of_cohort(r):
    """Distinct stays per lag group, evidence without a time included."""
    stays = staged_info(r)
    found = cohort.evidence(r.diag, r.micro, stays, r.code_is, TEST_PATTERN)
    grouped = found.select("enc_id", text.lag_group(F.col("chart_timelag")).alias("lag_group")).distinct()
    return grouped.groupBy("lag_group").agg(F.count("enc_id").alias("n_stays"))


@query
def letter_prefix_filter(r):
    prefix = text.numeric_prefix(F.col("code"))
    return r.diag.withColumn("prefix", prefix).filter(F.col("prefix") < 140)


@query
def pattern_filters(r):
    name = F.col("p_name")
    return r.table("part").filter(name.ilike(TEST_PATTERN) | name.like("%dget")).select("p_partkey", "p_name")


@query
def code_equality_filter(r):
    return r.diag.filter((F.col("seq_num") == 1) & (F.col("code") == "00845") | (F.col("code") == "00800"))


@query
def id_list_filter(r):
    ids = r.micro.filter(F.col("org_name").ilike(TEST_PATTERN))
    kept = cohort.keep_ids(r.enc, ids).select("enc_id", F.lit("in").alias("side"))
    left = cohort.drop_ids(r.enc, ids).select("enc_id", F.lit("out").alias("side"))
    return kept.unionByName(left)


@query
def completeness_filter(r):
    wide = labs(r)
    names = measures.lab_labels(TEST_LABS)
    n = numbers.non_null_count(names)
    return wide.select("enc_id", n.alias("n_filled")).filter(F.col("n_filled") > 0.5 * len(names))


@query
def filled_counts(r):
    wide, names = labs(r), measures.lab_labels(TEST_LABS)
    per_column = profile.filled_columns(wide, names)
    per_row = profile.filled_rows(wide, names).select(
        F.concat(F.lit("rows with "), F.col("n_filled").cast("string")).alias("feature"), "n"
    )
    return per_column.unionByName(per_row)


# Stays

@query
def encounter_info(r):
    return info(r)


@query
def prefix_cohort(r):
    return encounters.code_cohort(r.diag, r.enc).select("enc_id", "subj_id", "code", "start_ts", "end_ts")


@query
def primary_code_stays(r):
    return encounters.stays_with_primary_code(r.enc, r.diag).select("enc_id", "subj_id", "code")


@query
def age_interval_parts(r):
    joined = r.enc.join(r.subj, "subj_id")
    age = time.age_from_parts(F.col("start_ts"), F.col("dob"))
    return joined.select("enc_id", F.round(age, 6).alias("age"))


@query
def clock_features(r):
    clock = time.clock_hours(F.col("ts"))
    return r.table("events").select(
        "event_id", F.round(clock, 6).alias("clock"), F.round(time.hours_after_six(clock), 6).alias("shifted"),
        time.is_morning(clock).alias("is_morning"), F.to_date("ts").cast("string").alias("day"),
    )


@query
def age_bins(r):
    age = time.age_at_death(F.col("dod"), F.col("dob"))
    banded = r.enc.select("subj_id", "expire").join(
        r.subj.select("subj_id", numbers.age_band(age).alias("age_band")), "subj_id"
    )
    return profile.counts(banded, "expire", "age_band")


@query
def year_age_by_month(r):
    born = F.year("o_orderdate")
    age = time.years_since(F.lit("2026-01-01").cast("date"), born)
    return r.table("orders").groupBy(F.month("o_orderdate").alias("birth_month")).agg(
        F.round(F.avg(age), 6).alias("avg_age"), F.min(age).alias("min_age"), F.max(age).alias("max_age")
    )


@query
def event_dictionary_join(r):
    items = from_items(r)
    return encounters.events_with_names(r.enc, r.meas, items)


def from_items(r):
    import pyarrow as pa

    rows = [(i.item_id, i.label) for i in TEST_DICTIONARY]
    return from_rows(r.spark, ["item_id", "label"], rows, [pa.int32(), pa.string()])


@query
def early_events(r):
    """Events up to three hours after the start, with the lag."""
    named = encounters.events_with_names(r.enc, r.meas, from_items(r))
    hours = time.hours_between(F.col("ts"), F.col("start_ts"))
    return named.withColumn("chart_lag", F.round(hours, 6)).filter(hours < 3).select(
        "enc_id", "item_id", "ts", "value", "chart_lag"
    )


@query
def suffix_join(r):
    stays = r.enc.select("subj_id", "enc_id", "expire")
    people = r.subj.select("subj_id", "gender", F.lit(1).alias("expire"))
    return encounters.with_suffixes(stays, people, "subj_id", ("_ad", "_pt"))


@query
def body_measures(r):
    return features.body_measures(info(r), weight(r), height(r))


# Measures

@query
def first_labs(r):
    return labs(r)


def mean_columns(df):
    return [c for c in df.columns if c.endswith(("_mean", "_min", "_max"))]


@query
def first_vitals(r):
    wide = vitals(r)
    return rounded(wide, mean_columns(wide))


@query
def labs_window_6h(r):
    return measures.labs_window(r.meas, r.enc, TEST_LABS)


@query
def vitals_window_6h(r):
    wide = measures.vitals_window(r.meas, r.enc, TEST_VITALS)
    return rounded(wide, mean_columns(wide))


@query
def events_after_first(r):
    """Six hours from a user's first event, per event type."""
    events = r.table("events").select(
        F.col("user_id").alias("subj_id"), F.col("user_id").alias("enc_id"), "ts",
        F.col("event_type").alias("category"), "value",
    )
    starts = events.groupBy("subj_id", "enc_id").agg(F.min("ts").alias("start_ts"))
    near = measures.near_start(events, starts, 0, 6)
    return near.groupBy("enc_id", "category").agg(
        F.min("value").alias("value_min"), F.max("value").alias("value_max"),
        F.round(F.avg("value"), 6).alias("value_mean"), F.count("*").alias("n"),
    )


@query
def first_value_unit(r):
    w = weight(r).select("enc_id", "subj_id", F.lit("weight").alias("kind"), F.col("weight_first").alias("value"), "ts")
    h = height(r).select("enc_id", "subj_id", F.lit("height").alias("kind"), F.col("height_first").alias("value"), "ts")
    return w.unionByName(h)


@query
def vitals_joined(r):
    wide = features.vitals_joined(vitals(r), info(r), weight(r), height(r))
    return rounded(wide, mean_columns(wide))


@query
def numeric_features(r):
    wide = plans.joined_features(sources(r), codes(r), info(r))
    return rounded(wide, mean_columns(wide))


@query
def window_cohort_features(r):
    in_cohort = encounters.code_cohort(r.diag, r.enc)
    window = measures.vitals_window(r.meas, r.enc.join(in_cohort, "enc_id", "left_semi"), TEST_VITALS)
    wide = features.window_cohort_features(window, in_cohort, info(r), weight(r), height(r))
    return rounded(wide, mean_columns(wide))


# Prescriptions

@query
def drug_scope(r):
    scoped = meds.prescriptions_in_scope(r.rx, r.enc, TEST_SPELLINGS, TEST_UNNAMED)
    return scoped.select("subj_id", "enc_id", "startdate", "drug_type", "drug", "start_ts", "expire")


@query
def drug_normalise(r):
    named = meds.normalised_prescriptions(r.rx, r.enc, TEST_SPELLINGS, TEST_UNNAMED)
    return named.withColumn("date_lag", time.date_lag(F.col("startdate"), F.col("start_ts")))


@query
def drug_classify(r):
    return classified(r)


@query
def first_drug(r):
    return meds.first_prescription(meds.prescriptions_in_scope(r.rx, r.enc, TEST_SPELLINGS, TEST_UNNAMED))


@query
def treated_semi(r):
    scoped = meds.prescriptions_in_scope(r.rx, r.enc.select("subj_id", "enc_id"), TEST_SPELLINGS, TEST_UNNAMED)
    return meds.treated_stays(outcomes(r, staged_info(r)), scoped)


def joined(df, *columns):
    return df.withColumns({c: F.array_join(c, "|") for c in columns})


@query
def drug_names_per_day(r):
    return joined(meds.names_per_day(classified(r)), "drug_names")


@query
def drug_sets(r):
    early = meds.early(classified(r))
    sets = meds.group_sets(early).join(meds.association_sets(early), "enc_id")
    return joined(sets, "drug_groups", "associations")


@query
def multi_hot_drugs(r):
    return meds.multi_hot_drugs(r.enc.select("enc_id", F.col("expire").alias("outcome")), meds.early(classified(r)))


@query
def prescriptions_per_day(r):
    """Stays with a prescription on each of the first ten days."""
    per_day = meds.names_per_day(classified(r))
    early_days = per_day.filter((F.col("day_prescribed") > 0) & (F.col("day_prescribed") < 11))
    return profile.counts(early_days, "day_prescribed")


@query
def drug_cumulative(r):
    rx = classified(r)
    by_class = meds.cumulative_distinct(rx, "drug_class", "n_classes")
    by_name = meds.cumulative_distinct(rx, "drug_name", "n_names")
    return by_class.join(by_name, ["subj_id", "enc_id", "day_prescribed"])


@query
def drug_burden(r):
    return meds.drug_burden(classified(r), r.enc.select("enc_id", "expire"))


@query
def event_types_to_date(r):
    """Different event types of a user up to each day."""
    events = r.table("events").select(
        F.col("user_id").alias("subj_id"), F.col("user_id").alias("enc_id"),
        F.to_date("ts").alias("day_prescribed"), "event_type",
    )
    return meds.cumulative_distinct(events, "event_type", "n_types").select("enc_id", "day_prescribed", "n_types")


# Outcome, sessions, cohort

@query
def evidence_full_right(r):
    return cohort.evidence(r.diag, r.micro, staged_info(r), r.code_is, TEST_PATTERN)


@query
def evidence_all_ids(r):
    return cohort.evidence(r.diag, r.micro, info(r), r.code_is, TEST_PATTERN, coalesce_ids=True)


@query
def outcome_exists(r):
    return outcomes(r, info(r))


@query
def stay_gaps(r):
    return rounded(cohort.stay_gaps(staged_info(r)), ["gap_days"], 8)


@query
def session_members(r):
    return cohort.session_members(staged_info(r)).select("subj_id", "enc_id", "hospstay_seq", "session")


@query
def multistay(r):
    return joined(
        cohort.multistay(plans.sessions(staged_info(r))).withColumns({
            "combined_enc_id": F.col("combined_enc_id").cast("array<string>"),
            "other_enc_id": F.col("other_enc_id").cast("array<string>"),
        }),
        "combined_enc_id", "other_enc_id", "codes",
    )


@query
def merge_close_stays(r):
    stays = staged_info(r)
    return cohort.merge_close_stays(staged_outcomes(r, stays), plans.sessions(stays))


@query
def merge_treated_stays(r):
    """The same over treated stays only, so some sessions miss their first stay."""
    stays = staged_info(r)
    scoped = meds.prescriptions_in_scope(r.rx, r.enc.select("subj_id", "enc_id"), TEST_SPELLINGS, TEST_UNNAMED)
    treated = stages.materialize(meds.treated_stays(outcomes(r, stays), scoped), "treated_outcomes")
    return cohort.merge_close_stays(treated, plans.sessions(stays))


@query
def cohort_filters(r):
    stays = staged_info(r)
    flags = staged_outcomes(r, stays).select("enc_id", "outcome")
    rules = {
        "adults": cohort.adults_only(flags, stays),
        "not_primary": cohort.drop_primary_code(flags, stays, r.code_is),
        "long": cohort.long_stays(flags, stays),
        "survivors": cohort.survivors_only(flags, stays),
    }
    parts = [df.select("enc_id", "outcome", F.lit(name).alias("rule")) for name, df in rules.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query
def flag_by_membership(r):
    ids = r.micro.filter(F.col("org_name").ilike(TEST_PATTERN))
    flagged = cohort.member_flag(r.enc.select("enc_id", "expire"), ids, "flag")
    return rounded(cohort.event_rate(flagged, "flag", "expire"), ["rate"])


# Dataset

TEST_NUMERIC = [
    "albumin", "albumin_2", "log_bun", "log_glucose", "log_lactate", "sodium", "log_wbc",
    "heartrate_mean", "sysbp_mean", "tempc_mean", "spo2_mean_3", "weight", "bmi", "age", "gender",
    "rescaled_time", "am_admit",
]
TEST_FEATURES = TEST_NUMERIC + ONEHOT_FEATURES


def build(r: Retail) -> DataFrame:
    return plans.build_dataset(sources(r), codes(r))


@query
def build_dataset(r):
    wide = build(r)
    floats = [c for c in wide.columns if c not in (*ONEHOT_FEATURES, "enc_id", "outcome", "expire", "am_admit")]
    return rounded(wide, floats)


# Descriptive jobs

@query
def value_counts(r):
    orders = r.table("orders")
    by_two = profile.counts(orders, "o_orderstatus", "o_orderpriority")
    by_one = profile.counts(orders, "o_orderstatus").withColumn("o_orderpriority", F.lit("all"))
    return by_two.unionByName(by_one)


@query
def distinct_counts(r):
    return profile.distinct_counts(r.table("orders"), "o_orderkey", "o_custkey", "o_orderpriority")


WEEKDAYS = ["Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat"]


@query
def crosstab(r):
    day = F.date_format("ts", "E")
    return profile.crosstab(r.table("events").withColumn("day", day), "event_type", "day", WEEKDAYS)


@query
def crosstab_sparse(r):
    """Supplier quantities by order size, with cells that have no rows."""
    return profile.crosstab(r.table("customer"), "c_nationkey", "c_mktsegment",
                            ["BUILDING", "MACHINERY", "FURNITURE", "NO SUCH SEGMENT"])


@query
def grouped_describe(r):
    stays = staged_info(r).withColumn("coded", r.code_is.cast("int"))
    out = profile.summary_by(stays, ["coded", "expire"], "los_hospital")
    return rounded(out, ["mean", "std", "q25", "q50", "q75"])


@query
def frame_describe(r):
    out = profile.frame_summary(
        r.table("lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    )
    return rounded(out, ["mean", "std", "q25", "q50", "q75"])


@query
def histogram_by_class(r):
    """Every class on the edges of the first one."""
    return profile.histogram(r.table("lineitem"), "l_extendedprice", 10, by="l_returnflag", edges_of="A")


@query
def histogram_fixed_edges(r):
    return profile.histogram(r.table("lineitem"), "l_quantity", 7, lo=5, hi=40)


@query
def correlations(r):
    wide = labs(r).join(r.enc.select("enc_id", "expire"), "enc_id")
    return rounded(profile.correlations(wide, "expire", measures.lab_labels(TEST_LABS)), ["corr"])


@query
def correlation_matrix(r):
    return rounded(profile.correlation_matrix(labs(r), measures.lab_labels(TEST_LABS)), ["corr"])


@query
def correlation_ends(r):
    wide = labs(r).join(r.enc.select("enc_id", "expire"), "enc_id")
    known = profile.correlations(wide, "expire", measures.lab_labels(TEST_LABS))
    return rounded(profile.top_and_bottom(known, 3), ["corr"])


@query
def normal_quantiles(r):
    return rounded(profile.normal_quantiles(r.table("events"), "value"), ["p", "normal", "sample"])


@query
def probability_line(r):
    """The line through the normal probability plot of every kind of event."""
    return rounded(profile.probability_line(r.table("events"), "value", ["event_type"]), ["slope", "intercept", "r"])


@query
def class_means(r):
    clock = time.clock_hours(F.col("start_ts"))
    return r.enc.groupBy("expire").agg(F.round(F.avg(clock), 6).alias("mean_clock"))


@query
def density_scott(r):
    """Density of the values of every kind of event, bandwidth and range from the data."""
    return rounded(profile.kernel_density(r.table("events"), "value", ["event_type"], points=40), ["x", "density"])


@query
def density_grid(r):
    out = profile.density(r.table("events"), "value", 0.0, 50.0, 2.0, points=26, bins=100, by=["event_type"])
    return rounded(out, ["x", "density"])


@query
def sort_limit_offset(r):
    return profile.page(
        r.table("events").select("event_id", "event_type", "value"),
        [F.desc("value"), F.col("event_type").asc_nulls_last(), F.col("event_id")], limit=25, offset=50,
    )


@query
def argmax_group(r):
    return profile.arg_max(profile.counts(r.table("events"), "event_type"), "n")


@query
def sample_rows(r):
    return profile.random_rows(r.table("orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 20, SEED)


@query
def id_set_ops(r):
    ordered = r.table("orders").select("o_orderkey")
    lines = r.table("lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    both = profile.common_ids(ordered, lines, "o_orderkey").withColumn("part", F.lit("both"))
    only = profile.missing_ids(ordered, lines, "o_orderkey").withColumn("part", F.lit("no lines"))
    return both.unionByName(only)


# Preparation

@query
def select_features(r):
    chosen = prep.select_features(build(r), TEST_FEATURES)
    floats = [c for c in TEST_NUMERIC if c not in ("gender", "am_admit")]
    return rounded(chosen, floats)


@query
def select_and_fold(r):
    flags = meds.multi_hot_drugs(r.enc.select("enc_id", F.col("expire").alias("outcome")), meds.early(classified(r)))
    return prep.select_drug_features(flags)


@query
def balance_under(r):
    return prep.balance(r.table("labels"), "quality", "doc_id")


@query
def balance_over(r):
    return prep.balance(r.table("labels"), "quality", "doc_id", under=False)


@query
def balance_orders(r):
    return prep.balance(r.table("orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", "o_orderkey")


@query
def stratified_split(r):
    return prep.stratified_split(r.table("labels"), "quality", "doc_id")


@query
def split_orders(r):
    return prep.stratified_split(r.table("orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", "o_orderkey")


@query
def impute_median(r):
    return prep.impute_median(labs(r), measures.lab_labels(TEST_LABS))


def scaled_labs(r: Retail) -> DataFrame:
    """Scaled labs of all stays: the rows imputation works on."""
    return prep.standardise(stages.materialize(labs(r).drop("subj_id"), "scaled_labs"), measures.lab_labels(TEST_LABS))


@query
def impute_knn(r):
    names = measures.lab_labels(TEST_LABS)
    return rounded(prep.impute_nearest(scaled_labs(r), names), names)


@query
def impute_error(r):
    names = measures.lab_labels(TEST_LABS)
    truth = scaled_labs(r)
    masked = prep.mask_cells(truth, names)
    out = prep.imputation_error(truth, masked, prep.impute_median(masked, names), names)
    return rounded(out, ["mse"])


@query
def standardise(r):
    lines = r.table("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
        (F.col("l_returnflag") == "R").cast("int").alias("returned"), F.lit(3.0).alias("constant"),
    )
    columns = ["l_quantity", "l_extendedprice", "returned", "constant"]
    return rounded(prep.standardise(lines, columns), columns)
