"""Prescriptions: scope, names, classes, and per-stay drug features."""

from pyspark.sql import DataFrame, Window as W, functions as F

from clinfeat.codes.drugs import DRUG_CLASSES, DRUG_SPELLINGS, UNNAMED_SPELLINGS
from clinfeat.codes.tables import drug_class_table, from_rows, lookup, spelling_table
from clinfeat.codes.values import DRUG_GROUPS
from clinfeat.functions.time import relative_day

STAY = ["subj_id", "enc_id"]


def _listed_drugs(rx: DataFrame, spellings, unnamed) -> DataFrame:
    import pyarrow as pa

    drugs = sorted({raw for raws in spellings.values() for raw in raws} | set(unnamed))
    scope = from_rows(rx.sparkSession, ["drug"], [(d,) for d in drugs], [pa.string()])
    main = rx.filter(F.col("drug_type") == "MAIN").select(*STAY, "startdate", "drug_type", "drug")
    return lookup(main, scope, "drug", "left_semi")


def prescriptions_in_scope(rx, info, spellings=DRUG_SPELLINGS, unnamed=UNNAMED_SPELLINGS) -> DataFrame:
    """Main prescriptions of listed drugs, with the stay they belong to."""
    return info.join(_listed_drugs(rx, spellings, unnamed), STAY)


def normalised_prescriptions(rx, info, spellings=DRUG_SPELLINGS, unnamed=UNNAMED_SPELLINGS) -> DataFrame:
    """Distinct (stay, start date, drug name) with the day of the stay.

    Names are mapped and duplicates dropped before the join with the stays, so a stay has at most
    one row per date and name by then.
    """
    listed = _listed_drugs(rx, spellings, unnamed)
    named = lookup(listed, spelling_table(rx.sparkSession, spellings), "drug")
    distinct = named.select(*STAY, "startdate", "drug_name").distinct()
    starts = info.groupBy(*STAY).agg(F.min("start_ts").alias("start_ts"))
    return distinct.join(starts, STAY).withColumn(
        "day_prescribed", relative_day(F.col("startdate"), F.col("start_ts"))
    )


def classified_prescriptions(named, classes=DRUG_CLASSES, corrected_association=False) -> DataFrame:
    """Class, spectrum, group and association of each prescription; not deduplicated again."""
    table = drug_class_table(named.sparkSession, classes, corrected_association)
    joined = lookup(named.select(*STAY, "day_prescribed", "drug_name"), table, "drug_name")
    return joined.withColumns({
        "spectrum": F.coalesce("spectrum", F.lit("Narrow")),
        "association": F.coalesce("association", F.lit("None")),
    })


def treated_stays(stays: DataFrame, scoped: DataFrame) -> DataFrame:
    """Stays with at least one prescription in scope."""
    return stays.join(scoped.select("enc_id").distinct(), "enc_id", "left_semi")


def first_prescription(scoped: DataFrame) -> DataFrame:
    """Earliest drug per stay; ties go to the first drug in text order, missing dates and names come last."""
    w = W.partitionBy(*STAY).orderBy(F.col("startdate").asc_nulls_last(), F.col("drug").asc_nulls_last())
    return (
        scoped.select(*STAY, "startdate", "drug")
        .withColumn("_n", F.row_number().over(w))
        .filter(F.col("_n") == 1)
        .select(*STAY, F.col("drug").alias("first_drug"), F.col("startdate").alias("first_start"))
    )


def names_per_day(classified: DataFrame) -> DataFrame:
    """All drug names of a stay and day, sorted, missing ones last. Rows are distinct per start date and name, so a
    list is no longer than the drug dictionary."""
    return classified.groupBy(*STAY, "day_prescribed").agg(
        F.array_sort(F.transform(F.collect_list(F.struct("drug_name")), lambda x: x["drug_name"])).alias("drug_names")
    )


def early(classified: DataFrame, last_day: int = 2) -> DataFrame:
    return classified.filter(F.col("day_prescribed") <= last_day)


def value_set(early_rx: DataFrame, column: str, out: str) -> DataFrame:
    """Distinct values per stay, sorted; NULLs leave an empty set, not a missing stay."""
    return early_rx.groupBy("enc_id").agg(F.array_sort(F.collect_set(column)).alias(out))


def group_sets(early_rx: DataFrame) -> DataFrame:
    return value_set(early_rx, "drug_group", "drug_groups")


def association_sets(early_rx: DataFrame) -> DataFrame:
    return value_set(early_rx, "association", "associations")


def multi_hot_drugs(outcomes: DataFrame, early_rx: DataFrame, groups=DRUG_GROUPS) -> DataFrame:
    """One 0/1 column per drug group; ``None`` marks stays without any early prescription."""
    flags = early_rx.groupBy("enc_id").agg(*[
        F.max(F.when(F.col("drug_group") == g, 1).otherwise(0)).alias(g) for g in groups
    ])
    joined = outcomes.join(flags.withColumn("_early", F.lit(1)), "enc_id", "left")
    return joined.select(
        *outcomes.columns,
        *[F.coalesce(F.col(f"`{g}`"), F.lit(0)).alias(g) for g in groups],
        F.when(F.col("_early").isNull(), 1).otherwise(0).alias("None"),
    )


def cumulative_distinct(rx: DataFrame, value: str, out: str) -> DataFrame:
    """Per stay and day: how many different values were given up to that day.

    Only the first day of a value adds to the count. The data shrinks to the set of days per stay
    and value, then to one row per stay and day, before the running sum.
    """
    days = rx.groupBy(*STAY, value).agg(F.collect_set("day_prescribed").alias("_days"))
    adds = (F.col("_day") == F.array_min("_days")) & F.col(value).isNotNull()
    per_day = (
        days.withColumn("_day", F.explode("_days"))
        .groupBy(*STAY, F.col("_day").alias("day_prescribed"))
        .agg(F.sum(adds.cast("int")).alias("_new"))
    )
    w = W.partitionBy(*STAY).orderBy("day_prescribed").rowsBetween(W.unboundedPreceding, 0)
    return per_day.select(*STAY, "day_prescribed", F.sum("_new").over(w).alias(out))


def drug_burden(classified: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Most different classes and names a stay reached, beside its outcome."""
    per_stay = classified.groupBy(*STAY).agg(
        F.count_distinct("drug_class").alias("cumulative_number_classes"),
        F.count_distinct("drug_name").alias("cumulative_number"),
    )
    return per_stay.join(outcomes.drop("subj_id"), "enc_id")
