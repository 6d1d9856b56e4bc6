"""Monotone recalibration: adjacent violators are pooled over score bins.

Scores in [0, 1] become ``bins`` steps, each with its rows and events. Pools of neighbouring bins can be pooled again with the same result, so
ranges of bins are pooled in the tasks first, and what is left, at most a row a bin, in one group.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from clinfeat.functions.numbers import histogram_bin

BINS = 1 << 16
RANGES = 64


def pooled(low: np.ndarray, high: np.ndarray, n: np.ndarray, events: np.ndarray) -> list[list]:
    """[low, high, n, events] of the pools of neighbours in order, with rising shares of events."""
    out: list[list] = []
    for row in zip(low.tolist(), high.tolist(), n.tolist(), events.tolist()):
        out.append(list(row))
        while len(out) > 1 and out[-2][3] * out[-1][2] >= out[-1][3] * out[-2][2]:
            last = out.pop()
            out[-1] = [out[-1][0], last[1], out[-1][2] + last[2], out[-1][3] + last[3]]
    return out


def _pooled(group: pa.Table) -> pa.Table:
    group = group.sort_by("low")
    found = pooled(*(group.column(c).to_numpy() for c in ("low", "high", "n", "events")))
    return pa.table({c: pa.array([r[k] for r in found], pa.int64()) for k, c in enumerate(("low", "high", "n", "events"))})


def _bin(value, bins: int) -> Column:
    return histogram_bin(F.col(value), F.lit(0.0), F.lit(1.0), bins)


def monotone_steps(held_out: DataFrame, label: str = "outcome", value: str = "score", bins: int = BINS) -> DataFrame:
    """(low, high, n, events, rate): ranges of bins with the event rate of their rows, rising from one to the next.

    The least-squares monotone fit over the bins. Rows without a label or with a score outside [0, 1] are left out.
    """
    counts = held_out.where(F.col(label).isin(0, 1)).groupBy(_bin(value, bins).alias("low")).agg(
        F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("events")
    ).where("low IS NOT NULL")
    rows = counts.select(F.col("low").cast("long").alias("low"), F.col("low").cast("long").alias("high"), "n", "events")
    schema = "low long, high long, n long, events long"
    part = F.floor(F.col("low") * RANGES / (bins + 1))
    some = rows.groupBy(part.alias("part")).applyInArrow(_pooled, schema)
    return some.groupBy().applyInArrow(_pooled, schema).withColumn("rate", F.col("events") / F.col("n"))


def monotone(steps: DataFrame, scored: DataFrame, value: str = "score", bins: int = BINS) -> DataFrame:
    """``scored`` with ``calibrated``: the rate of the score's step; between two steps the line between them, outside the nearest one.

    The steps, at most a row a bin, are sent to all tasks. Scores that are null or outside [0, 1] get null.
    """
    rows = steps.orderBy("low").collect()
    if not rows:
        return scored.withColumn("calibrated", F.lit(None).cast("double"))
    edges = np.array([e for r in rows for e in (r["low"], r["high"])], float)
    rates = np.array([r["rate"] for r in rows for _ in range(2)])
    shipped = scored.sparkSession.sparkContext.broadcast((edges, rates))

    @F.pandas_udf("double")
    def looked_up(at):
        edges, rates = shipped.value
        return at.where(at.isna(), np.interp(at.astype(float), edges, rates))

    return scored.withColumn("calibrated", looked_up(_bin(value, bins).cast("double")))


def smoothed_targets(df: DataFrame, label: str = "outcome") -> DataFrame:
    """``df`` twice with ``target`` 0 and 1 and ``weight``: events count (n+ + 1) / (n+ + 2), others 1 / (n- + 2) as an event.

    A sigmoid fitted on these weighs as one fitted on targets short of 0 and 1.
    """
    counts = df.agg(F.sum((F.col(label) == 1).cast("long")).alias("p"), F.sum((F.col(label) == 0).cast("long")).alias("q")).first()
    p, q = counts["p"] or 0, counts["q"] or 0
    share = F.when(F.col(label) == 1, F.lit((p + 1) / (p + 2))).otherwise(F.lit(1 / (q + 2)))
    known = df.where(F.col(label).isin(0, 1))
    return known.withColumns({"target": F.lit(1), "weight": share}).unionByName(known.withColumns({"target": F.lit(0), "weight": 1 - share}))
