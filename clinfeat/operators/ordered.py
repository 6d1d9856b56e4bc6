"""Ordered computations (ranks, running totals, quantiles) whose groups may be very large.

A plain window sorts a whole group in one task. Here each group is cut into slices along its order:
a window works inside a slice, and the totals of the earlier slices of the group are added. The
result equals that of the plain window, and no task holds more than a slice.

Every function repartitions by (group, slice) explicitly. Without that Spark would reuse an earlier
partitioning by the group alone, and one task would get the whole group again.
"""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

# A slice is found in three steps of 7, 7 and 15 comparisons.
FAN_OUT = (8, 8, 16)
SLICES = FAN_OUT[0] * FAN_OUT[1] * FAN_OUT[2]


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join by equal keys, NULL being equal to NULL."""
    renamed = right.select(
        *[F.col(f"`{k}`").alias(f"_key{i}") for i, k in enumerate(keys)],
        *[F.col(f"`{c}`") for c in right.columns if c not in keys],
    )
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(f"`{k}`").eqNullSafe(F.col(f"_key{i}"))
    return left.join(renamed, same, how).drop(*[f"_key{i}" for i in range(len(keys))])


def _place(key: Column, slice_: Column) -> Column:
    """Group and slice as one value, by which rows are partitioned, ranked and joined: NULL equals NULL inside it, so the join with the
    slices' totals finds the rows where the window left them. A null-safe join by columns would shuffle them once more."""
    return F.struct(key.alias("key"), slice_.alias("slice"))


def _before(totals: DataFrame, keys: list[str], names: list[str], slice_: str = "_slice") -> DataFrame:
    """Sum of each named total over the earlier slices of the group."""
    w = W.partitionBy(*keys).orderBy(slice_).rowsBetween(W.unboundedPreceding, -1)
    kept = [c for c in totals.columns if c not in names]
    return totals.select(
        *kept, *[F.coalesce(F.sum(n).over(w), F.lit(0)).alias(f"_before_{n}") for n in names]
    )


def dense_rank_by_time(df: DataFrame, key: str, ts: str, out: str) -> DataFrame:
    """``dense_rank`` of ``ts`` within ``key``, missing times last; slices are calendar months.

    The offsets need one row per key and month, which is less than the data for a key with many
    rows and about the same for a key with few.
    """
    month = F.coalesce(F.year(ts) * 12 + F.month(ts), F.lit(2**31 - 1))
    sliced = df.withColumn("_slice", _place(F.col(f"`{key}`"), month))
    totals = sliced.select("_slice", ts).distinct().groupBy("_slice").agg(F.count("*").alias("n"))
    w = W.partitionBy("_slice").orderBy(ts)
    local = sliced.repartition("_slice").withColumn("_local", F.dense_rank().over(w))
    return (
        local.join(_before(totals, ["_slice.key"], ["n"], "_slice.slice"), "_slice")
        .withColumn(out, (F.col("_local") + F.col("_before_n")).cast("int"))
        .drop("_slice", "_local", "_before_n")
    )


def running_sum_by_number(
    df: DataFrame, key: str, number: str, value: str, out: str, width: int = 100_000
) -> DataFrame:
    """Running sum of ``value`` by a dense ``number`` within ``key``; a slice is ``width`` numbers."""
    sliced = df.withColumn("_place", _place(F.col(f"`{key}`"), F.floor(F.col(number) / width)))
    totals = sliced.groupBy("_place").agg(F.sum(value).alias("n"))
    w = W.partitionBy("_place").orderBy(number).rowsBetween(W.unboundedPreceding, 0)
    local = sliced.repartition("_place").withColumn("_local", F.sum(value).over(w))
    return (
        local.join(_before(totals, ["_place.key"], ["n"], "_place.slice"), "_place")
        .withColumn(out, F.col("_local") + F.col("_before_n"))
        .drop("_place", "_local", "_before_n")
    )


def hash_order(id_col: str, seed: int) -> Column:
    """A repeatable random order: the MD5 text of id and seed."""
    return F.md5(F.concat_ws("|", F.col(id_col).cast("string"), F.lit(str(seed))))


def first_by_hash(
    df: DataFrame, group: str, id_col: str, seed: int, quota: DataFrame, hex_digits: int = 4
) -> DataFrame:
    """Flag ``_first``: is the row among the first ``quota`` rows of its group in hash order?

    ``quota`` has one row per group value (group, quota); group values are class labels, so few.
    Slices are the leading hex digits of the hash: 16**hex_digits per group at most, which bounds
    the broadcast. Slices wholly inside or outside the quota need no ranking; only the single slice
    per group that holds the limit is sorted.
    """
    hashed = df.withColumn("_h", hash_order(id_col, seed)).withColumn(
        "_slice", F.substring("_h", 1, hex_digits)
    )
    totals = hashed.groupBy(group, "_slice").agg(F.count("*").alias("n"))
    w = W.partitionBy(group).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    limits = (
        totals.withColumn("_before", F.coalesce(F.sum("n").over(w), F.lit(0)))
        .join(F.broadcast(quota), group)
        .select(group, "_slice", (F.col("quota") - F.col("_before")).alias("_room"), "n")
    )
    placed = hashed.join(F.broadcast(limits), [group, "_slice"])
    on_limit = (F.col("_room") > 0) & (F.col("_room") < F.col("n"))
    in_slice = W.partitionBy(group, "_slice").orderBy("_h", id_col)
    plain = placed.filter(~on_limit).withColumn("_first", F.col("_room") > 0)
    edge = placed.filter(on_limit).withColumn(
        "_first", F.row_number().over(in_slice) <= F.col("_room")
    )
    return plain.unionByName(edge).drop("_h", "_slice", "_room", "n")


def _levels(cuts: Column) -> Column:
    """The sorted cut values at three widths: every 128th, every 16th, all."""
    def every(step):
        positions = F.sequence(F.lit(step), F.lit(SLICES - step), F.lit(step))
        return F.transform(positions, lambda i: F.get(cuts, i - 1))

    return F.struct(
        every(FAN_OUT[1] * FAN_OUT[2]).alias("wide"), every(FAN_OUT[2]).alias("middle"), cuts.alias("narrow")
    )


def _slice_of(value: Column, levels: str) -> Column:
    """How many cut values lie below ``value``."""
    def below(cuts):
        return F.coalesce(F.size(F.filter(cuts, lambda c: c < value)), F.lit(0))

    wide = below(F.col(f"{levels}.wide"))
    middle = wide * FAN_OUT[1] + below(
        F.slice(F.col(f"{levels}.middle"), wide * FAN_OUT[1] + 1, F.lit(FAN_OUT[1] - 1))
    )
    return middle * FAN_OUT[2] + below(
        F.slice(F.col(f"{levels}.narrow"), middle * FAN_OUT[2] + 1, F.lit(FAN_OUT[2] - 1))
    )


def with_value_slices(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Add ``_slice``: about equally filled slices of ``value`` within each ``by`` group.

    Cut values are approximate quantiles of the data; they only decide where a slice ends, so the
    results built on them stay exact. A group's cuts take about 10 KB; Spark chooses the join by their
    size, and may split a large group, since a shuffle by slice follows.
    """
    probs = F.expr("array(" + ", ".join(f"{i / SLICES}D" for i in range(1, SLICES)) + ")")
    cuts = df.groupBy(*by).agg(F.percentile_approx(value, probs, F.lit(10 * SLICES)).alias("_cuts"))
    levels = cuts.select(*by, _levels(F.col("_cuts")).alias("_levels"))
    if not by:
        placed = df.withColumn("_levels", levels.scalar())
    else:
        placed = null_safe_join(df, levels, by)
    return placed.withColumn("_slice", _slice_of(F.col(value), "_levels")).drop("_levels")


def running_totals(df: DataFrame, by: list[str], value: str, sums: list[str]) -> DataFrame:
    """Running sums in ascending order of ``value`` within ``by``, peers included: ``cum_<name>``.

    Call it on rows already aggregated to one per (by, value).
    """
    sliced = with_value_slices(df, by, value)
    keys = [*by, "_slice"]
    totals = sliced.groupBy(*keys).agg(*[F.sum(s).alias(s) for s in sums])
    w = W.partitionBy(*keys).orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    local = sliced.repartition(*keys).select(
        *df.columns, "_slice", *[F.sum(s).over(w).alias(f"_local_{s}") for s in sums]
    )
    return null_safe_join(local, _before(totals, by, sums), keys).select(
        *df.columns,
        *[(F.col(f"_local_{s}") + F.col(f"_before_{s}")).alias(f"cum_{s}") for s in sums],
    )


def exact_quantiles(df: DataFrame, by: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact quantiles (linear between the two nearest values) of ``value`` per ``by`` group.

    Rows are first counted per distinct value. Only the slices that hold a wanted rank are then
    sorted. NULLs are skipped; a group without values has no row.
    """
    counted = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*by, value)
        .agg(F.count("*").alias("n"))
    )
    sliced = with_value_slices(counted, by, value)
    keys = [*by, "_slice"]
    totals = sliced.groupBy(*keys).agg(F.sum("n").alias("n"))
    per_group = W.partitionBy(*by)
    earlier = per_group.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    placed = totals.withColumn("_total", F.sum("n").over(per_group)).withColumn(
        "_before", F.coalesce(F.sum("n").over(earlier), F.lit(0))
    )
    wanted = F.explode(F.array(*[
        F.struct(F.lit(name).alias("q"), F.lit(float(p)).alias("p")) for name, p in probs.items()
    ]))
    position = (F.col("_total") - 1) * F.col("_w.p")
    ranks = (
        placed.withColumn("_w", wanted)
        .withColumn("_pos", position)
        .withColumn(
            "_rank",
            F.explode(F.array_distinct(F.array(F.floor("_pos") + 1, F.ceil("_pos") + 1))),
        )
        .filter((F.col("_rank") > F.col("_before")) & (F.col("_rank") <= F.col("_before") + F.col("n")))
    )
    # all wanted ranks of a slice travel in one row, so the slice is read once
    per_slice = ranks.groupBy(*keys, "_before").agg(
        F.collect_set(F.struct(F.col("_w.q").alias("q"), "_pos", "_rank")).alias("_ranks")
    )
    w = W.partitionBy(*keys).orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    found = (
        null_safe_join(sliced, per_slice, keys)
        .withColumn("_hi", F.sum("n").over(w) + F.col("_before"))
        .withColumn("_r", F.explode("_ranks"))
        .filter((F.col("_r._rank") <= F.col("_hi")) & (F.col("_r._rank") > F.col("_hi") - F.col("n")))
    )
    ends = found.groupBy(*by, F.col("_r.q").alias("q")).agg(
        F.min(value).alias("_a"), F.max(value).alias("_b"), F.first("_r._pos").alias("_pos")
    )
    answer = F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_pos") - F.floor("_pos"))
    return ends.groupBy(*by).agg(
        *[F.max(F.when(F.col("q") == name, answer)).alias(name) for name in probs]
    )
