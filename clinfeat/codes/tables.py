"""Code lists as small DataFrames.

A pyarrow table becomes a local relation, so Spark knows its exact size. All are written in this
package (at most a few hundred rows), which is the size bound behind every ``broadcast`` of them.
"""

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from clinfeat.codes.drugs import DRUG_CLASSES, DRUG_SPELLINGS
from clinfeat.codes.values import ASSOCIATION_BY_NAME


def from_rows(spark: SparkSession, names: list[str], rows: list[tuple], types: list) -> DataFrame:
    columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
    return spark.createDataFrame(pa.table(dict(zip(names, columns))))


def column_name(label: str) -> str:
    """'ANION GAP' -> 'aniongap'."""
    return label.replace(" ", "").lower()


def numbered(names) -> dict[str, int]:
    """Distinct names in order of appearance, with their number. Numbers sort faster than names."""
    return {name: i for i, name in enumerate(dict.fromkeys(names))}


def lab_table(spark, items):
    no = numbered(column_name(i.label) for i in items)
    rows = [(i.item_id, column_name(i.label), no[column_name(i.label)], i.hi) for i in items]
    types = [pa.int32(), pa.string(), pa.int32(), pa.float64()]
    return from_rows(spark, ["item_id", "label", "label_no", "hi"], rows, types)


def vital_table(spark, items):
    no = numbered(i.category for i in items)
    rows = [(i.item_id, i.category, no[i.category], i.lo, i.hi, i.hi_closed, i.fahrenheit) for i in items]
    names = ["item_id", "valid_category", "valid_no", "lo", "hi", "hi_closed", "fahrenheit"]
    types = [pa.int32(), pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.bool_(), pa.bool_()]
    return from_rows(spark, names, rows, types)


def chart_table(spark, vitals, weights, heights):
    """Vital, weight and height items in one table; an item may have a row of each kind.

    ``factor`` is NULL for vitals. Weight and height are numbered after the vital categories.
    """
    no = numbered([i.category for i in vitals] + ["weight", "height"])
    rows = [(i.item_id, no[i.category], i.lo, i.hi, i.hi_closed, i.fahrenheit, None) for i in vitals]
    for name, items in (("weight", weights), ("height", heights)):
        rows += [(i.item_id, no[name], None, None, False, False, i.factor) for i in items]
    names = ["item_id", "valid_no", "lo", "hi", "hi_closed", "fahrenheit", "factor"]
    types = [pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.bool_(), pa.bool_(), pa.float64()]
    return from_rows(spark, names, rows, types)


def unit_table(spark, items):
    return from_rows(spark, ["item_id", "factor"], list(items), [pa.int32(), pa.float64()])


def spelling_table(spark, spellings=DRUG_SPELLINGS):
    rows = [(raw, name) for name, raws in spellings.items() for raw in raws]
    return from_rows(spark, ["drug", "drug_name"], rows, [pa.string(), pa.string()])


def drug_class_table(spark, classes=DRUG_CLASSES, corrected_association=False):
    """One row per drug name. ``corrected_association`` also honours the levels listed by name."""
    def level(name, listed):
        return ASSOCIATION_BY_NAME.get(name, listed) if corrected_association else listed

    rows = [(n, c, s, g, level(n, a)) for n, c, s, g, a in classes]
    names = ["drug_name", "drug_class", "spectrum", "drug_group", "association"]
    return from_rows(spark, names, rows, [pa.string()] * 5)


def lookup(df: DataFrame, table: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join a code list of this module; its size is fixed by the code, so it is broadcast."""
    return df.join(F.broadcast(table), key, how)
