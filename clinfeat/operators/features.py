"""Feature rows: joins of the measures, derived columns and one-hot categories."""

from pyspark.sql import DataFrame, functions as F

from clinfeat.codes.values import CUBED, LOGGED, ONEHOT_CATEGORIES, SQUARED
from clinfeat.functions.numbers import body_mass_index, cap_age, natural_log, within
from clinfeat.functions.text import condense, is_value
from clinfeat.functions.time import clock_hours, hours_after_six, is_morning

STAY = ["subj_id", "enc_id"]


def with_stay_facts(per_stay: DataFrame, info: DataFrame) -> DataFrame:
    """Start, length of stay, age and gender flag beside one row per stay."""
    facts = info.select(
        "enc_id", "start_ts", "los_hospital", "age", is_value(F.col("gender"), "M").alias("gender")
    )
    return per_stay.join(facts, "enc_id")


def vitals_joined(vitals: DataFrame, info: DataFrame, weight: DataFrame, height: DataFrame) -> DataFrame:
    """First vitals with stay facts, weight and height (looked up by stay alone)."""
    return (
        with_stay_facts(vitals, info)
        .join(weight.select("enc_id", F.col("weight_first").alias("weight")), "enc_id", "left")
        .join(height.select("enc_id", F.col("height_first").alias("height")), "enc_id", "left")
    )


def numeric_features(vitals: DataFrame, labs: DataFrame) -> DataFrame:
    """Labs and vitals of stays that have both. Of the charted glucose only the mean is kept,
    and under a name of its own, because a lab has the same name."""
    return labs.join(vitals.drop("los_hospital", "glucose_min", "glucose_max"), STAY)


def window_cohort_features(vitals: DataFrame, cohort: DataFrame, info: DataFrame,
                           weight: DataFrame, height: DataFrame) -> DataFrame:
    """Vitals near the start for a coded cohort, with age, gender, weight, height and outcome flag."""
    facts = info.select("enc_id", "age", is_value(F.col("gender"), "M").alias("gender"))
    return (
        vitals.join(cohort.select("enc_id", "expire"), "enc_id")
        .join(facts, "enc_id")
        .join(weight.select("enc_id", F.col("weight_first").alias("weight")), "enc_id", "left")
        .join(height.select("enc_id", F.col("height_first").alias("height")), "enc_id", "left")
    )


def body_measures(info: DataFrame, weight: DataFrame, height: DataFrame) -> DataFrame:
    """Stays that have both a height and a weight."""
    w = weight.select("enc_id", "weight_first", F.col("ts").alias("weight_charttime"))
    h = height.withColumnRenamed("ts", "height_charttime")
    return h.join(w, "enc_id").join(info.select("enc_id", "start_ts", "age", "gender"), "enc_id")


def derive_features(df: DataFrame, squared=SQUARED, cubed=CUBED, logged=LOGGED) -> DataFrame:
    """Plausibility limits, body mass index, admission clock, powers and logarithms.

    Only the transforms whose source column exists are added.
    """
    have = set(df.columns)
    height = within(F.col("height").cast("double"), 60, 250)
    weight = within(F.col("weight").cast("double"), 25, 400)
    clock = clock_hours(F.col("start_ts"))
    derived = {
        "height": height,
        "weight": weight,
        "bmi": body_mass_index(weight, height),
        "time_of_admission": clock,
        "rescaled_time": hours_after_six(clock),
        "am_admit": is_morning(clock),
        "age": cap_age(F.col("age").cast("double")),
    }
    derived |= {out: F.col(c) * F.col(c) for c, out in squared.items() if c in have}
    derived |= {out: F.col(c) * F.col(c) * F.col(c) for c, out in cubed.items() if c in have}
    derived |= {f"log_{c}": natural_log(F.col(c)) for c in logged if c in have}
    return df.withColumns(derived).drop("start_ts")


def onehot_demographics(info: DataFrame, categories=ONEHOT_CATEGORIES) -> DataFrame:
    """Condensed categories as 0/1 columns. The column list is fixed, not taken from the data."""
    condensed = info.select(
        "enc_id", "expire", *[condense(F.col(c)).alias(c) for c in categories]
    )
    return condensed.select("enc_id", "expire", *[
        is_value(F.col(c), cat).alias(f"{c}_{cat}") for c, cats in categories.items() for cat in cats
    ])


def labelled_dataset(features: DataFrame, demographics: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Features, demographics and outcome of the stays that have all three."""
    return (
        features.join(demographics, "enc_id")
        .join(outcomes.select("enc_id", F.col("outcome").cast("int").alias("outcome")), "enc_id")
        .drop("subj_id")
    )
