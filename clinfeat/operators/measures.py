"""Measurements: labelling, first values, values near the start of a stay, weight and height."""

from pyspark.sql import DataFrame, Window as W, functions as F

from clinfeat.codes.tables import (
    chart_table, column_name, lab_table, lookup, numbered, unit_table, vital_table,
)
from clinfeat.codes.values import HEIGHT_ITEMS, LAB_ITEMS, VITAL_ITEMS, WEIGHT_ITEMS
from clinfeat.functions.numbers import round_half_away
from clinfeat.functions.text import not_marked
from clinfeat.functions.time import hour_number, hours_interval

STAY = ["subj_id", "enc_id"]


def lab_labels(items=LAB_ITEMS):
    return list(numbered(column_name(i.label) for i in items))


def vital_names(items=VITAL_ITEMS):
    return list(numbered(i.category for i in items))


def _lab_rows(events: DataFrame, items) -> DataFrame:
    listed = events.filter(
        F.col("item_id").isin([i.item_id for i in items])
        & F.col("value").isNotNull()
        & (F.col("value") > 0)
    ).select(*STAY, "item_id", "ts", "value")
    return (
        lookup(listed, lab_table(events.sparkSession, items), "item_id", "inner")
        .withColumn("value", F.when(F.col("value") <= F.col("hi"), F.col("value")))
        .drop("hi")
    )


def label_labs(events: DataFrame, items=LAB_ITEMS) -> DataFrame:
    """Positive values of listed items, with their label.

    A value above the limit of its item becomes NULL, but the row keeps label and time.
    The item list is a literal ``IN``, so it reaches the scan.
    """
    return _lab_rows(events, items).drop("label_no")


def _vital_rows(events: DataFrame, items) -> DataFrame:
    listed = events.filter(
        F.col("item_id").isin([i.item_id for i in items]) & not_marked(F.col("error"))
    ).select(*STAY, "item_id", "ts", "value")
    valid = _in_range()
    return lookup(listed, vital_table(events.sparkSession, items), "item_id", "inner").select(
        *STAY, "item_id", "ts",
        F.when(valid, F.col("valid_category")).alias("category"),
        F.when(valid, F.col("valid_no")).alias("category_no"),
        _celsius().alias("value"),
    )


def label_vitals(events: DataFrame, items=VITAL_ITEMS) -> DataFrame:
    """Listed items not marked as errors, with category and metric value.

    A value outside the range of its item loses its category, but the row stays.
    """
    return _vital_rows(events, items).drop("category_no")


def _in_range():
    v, lo, hi = F.col("value"), F.col("lo"), F.col("hi")
    return (lo.isNull() | (v > lo)) & (hi.isNull() | (v < hi) | (F.col("hi_closed") & (v == hi)))


def _celsius():
    return F.when(F.col("fahrenheit"), (F.col("value") - 32) / 1.8).otherwise(F.col("value"))


def first_rows(events: DataFrame, category: str) -> DataFrame:
    """All rows at the earliest time of each stay and category.

    One scan. ``rank = 1`` lets Spark drop later rows before the shuffle (WindowGroupLimit), so a
    stay with very many events reaches the final task as its earliest rows per input partition.
    Events without a time come last, and give no value where nothing else is there.
    """
    w = W.partitionBy(*STAY, category).orderBy(F.col("ts").asc_nulls_last())
    first = events.withColumn("_r", F.rank().over(w)).filter(F.col("_r") == 1).drop("_r")
    return first.withColumn("value", F.when(F.col("ts").isNotNull(), F.col("value")))


def wide(rows: DataFrame, number: str, names: list[str], aggs: dict) -> DataFrame:
    """One row per stay; a column per (category, aggregate), all in one aggregation."""
    return rows.groupBy(*STAY).agg(*[
        fn(F.when(F.col(number) == no, F.col("value"))).alias(name + suffix)
        for no, name in enumerate(names) for suffix, fn in aggs.items()
    ])


MIN_MAX = {"_min": F.min, "_max": F.max}
MIN_MAX_MEAN = {"_min": F.min, "_max": F.max, "_mean": F.avg}


def _of_known_stays(per_stay: DataFrame, stays: DataFrame) -> DataFrame:
    """Applied to one row per stay, so the long event table never joins."""
    return per_stay.join(stays.select(*STAY), STAY, "left_semi")


def _in_a_stay(events: DataFrame) -> DataFrame:
    return events.filter(F.col("enc_id").isNotNull() & F.col("subj_id").isNotNull())


def first_labs(events: DataFrame, stays: DataFrame, items=LAB_ITEMS) -> DataFrame:
    """First value per label, whatever its time; NULL when that first value was above its limit."""
    first = first_rows(_lab_rows(_in_a_stay(events), items), "label_no")
    return _of_known_stays(wide(first, "label_no", lab_labels(items), {"": F.min}), stays)


def first_vitals(events: DataFrame, stays: DataFrame, items=VITAL_ITEMS) -> DataFrame:
    """Minimum, maximum and mean of the first valid charting per category.

    Invalid rows form a group without category, so a stay with nothing else has an all-NULL row.
    """
    first = first_rows(_vital_rows(_in_a_stay(events), items), "category_no")
    return _of_known_stays(wide(first, "category_no", vital_names(items), MIN_MAX_MEAN), stays)


def near_start(events: DataFrame, stays: DataFrame, before: int, after: int) -> DataFrame:
    """Events from ``before`` hours before to ``after`` hours after the start, ends included.

    The join key is stay and time bucket. A bucket is as long as the window, so a stay meets at most
    two of them. Events of one stay spread over their buckets, those far from the start meet
    nothing, and the aggregation by stay that follows has to shuffle anyway, so Spark may split a
    skewed bucket.
    """
    width = before + after
    lo = F.col("start_ts") - hours_interval(before)
    hi = F.col("start_ts") + hours_interval(after)
    windows = stays.select(*STAY, "start_ts").select(
        *STAY, lo.alias("_lo"), hi.alias("_hi")
    ).withColumn("_bucket", F.explode(F.sequence(
        F.floor(hour_number(F.col("_lo")) / width), F.floor(hour_number(F.col("_hi")) / width)
    )))
    bucketed = events.withColumn("_bucket", F.floor(hour_number(F.col("ts")) / width))
    return (
        bucketed.join(windows, [*STAY, "_bucket"])
        .filter(F.col("ts").between(F.col("_lo"), F.col("_hi")))
        .drop("_bucket", "_lo", "_hi")
    )


def labs_window(events: DataFrame, stays: DataFrame, items=LAB_ITEMS, before=6, after=6) -> DataFrame:
    """Minimum and maximum per label around the start; stays without labs are kept, all NULL."""
    rows = near_start(_lab_rows(events, items), stays, before, after)
    found = wide(rows, "label_no", lab_labels(items), MIN_MAX)
    return stays.select(*STAY).distinct().join(found, STAY, "left")


def vitals_window(events: DataFrame, stays: DataFrame, items=VITAL_ITEMS, before=0, after=6) -> DataFrame:
    """Minimum, maximum and mean per category after the start; stays without events are dropped."""
    rows = near_start(_vital_rows(events, items), stays, before, after)
    return wide(rows, "category_no", vital_names(items), MIN_MAX_MEAN)


def first_unit_value(events: DataFrame, items, out: str) -> DataFrame:
    """First converted value per stay, two decimals; ties on time go to the smallest
    converted value, then to the lowest item. Values without a time count for nothing.

    ``row_number = 1`` also prunes before the shuffle.
    """
    listed = events.filter(
        F.col("item_id").isin([i.item_id for i in items])
        & F.col("value").isNotNull()
        & (F.col("value") != 0)
        & F.col("ts").isNotNull()
        & not_marked(F.col("error"))
    ).select(*STAY, "item_id", "ts", "value")
    w = W.partitionBy(*STAY).orderBy("ts", "value", "item_id")
    return (
        lookup(listed, unit_table(events.sparkSession, items), "item_id", "inner")
        .withColumn("value", F.col("value") * F.col("factor"))
        .withColumn("_n", F.row_number().over(w))
        .filter(F.col("_n") == 1)
        .select("enc_id", "subj_id", round_half_away(F.col("value"), 2).alias(out), "ts")
    )


def first_weight(events: DataFrame, items=WEIGHT_ITEMS) -> DataFrame:
    return first_unit_value(events, items, "weight_first")


def first_height(events: DataFrame, items=HEIGHT_ITEMS) -> DataFrame:
    return first_unit_value(events, items, "height_first")


def first_charts(events: DataFrame, stays: DataFrame, vitals=VITAL_ITEMS, weights=WEIGHT_ITEMS,
                 heights=HEIGHT_ITEMS) -> DataFrame:
    """``first_vitals`` with first weight and height beside it, from one scan of the chart table.

    Weight and height are two more categories of the same ranking: of the rows at their first time
    the smallest converted value is the one ``first_unit_value`` picks. Stays without any row of a
    vital item have no row, as in ``first_vitals``.
    """
    items = {i.item_id for i in [*vitals, *weights, *heights]}
    listed = _in_a_stay(events).filter(
        F.col("item_id").isin(sorted(items)) & not_marked(F.col("error"))
    ).select(*STAY, "item_id", "ts", "value")
    is_vital = F.col("factor").isNull()
    rows = (
        lookup(listed, chart_table(events.sparkSession, vitals, weights, heights), "item_id", "inner")
        .filter(is_vital | (F.col("value").isNotNull() & (F.col("value") != 0)))
        .select(
            *STAY, "ts", is_vital.alias("vital"),
            F.when(~is_vital | _in_range(), F.col("valid_no")).alias("category_no"),
            F.when(is_vital, _celsius()).otherwise(F.col("value") * F.col("factor")).alias("value"),
        )
    )

    names = vital_names(vitals)

    def pick(no):
        return F.when(F.col("category_no") == no, F.col("value"))

    out = first_rows(rows, "category_no").groupBy(*STAY).agg(
        F.max("vital").alias("_vital"),
        *[fn(pick(no)).alias(n + suffix) for no, n in enumerate(names) for suffix, fn in MIN_MAX_MEAN.items()],
        round_half_away(F.min(pick(len(names))), 2).alias("weight"),
        round_half_away(F.min(pick(len(names) + 1)), 2).alias("height"),
    )
    return _of_known_stays(out.filter("_vital").drop("_vital"), stays)
