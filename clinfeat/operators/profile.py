"""Descriptive jobs: counts, cross-tabulation, summaries, histograms, correlation, density."""

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, functions as F

from clinfeat.functions.numbers import histogram_bin, non_null_count, normal_quantile
from clinfeat.operators.ordered import exact_quantiles, hash_order, null_safe_join, running_totals

PLACES = 10_000  # of equal values that one task makes at a time
QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def distinct_counts(df: DataFrame, *columns: str) -> DataFrame:
    """Number of different values of each column.

    Every column is counted on its own distinct values, so no row is copied once per column.
    """
    each = [
        df.select(F.col(c)).distinct().agg(F.lit(c).alias("column"), F.count(c).alias("n_distinct"))
        for c in columns
    ]
    out = each[0]
    for part in each[1:]:
        out = out.unionByName(part)
    return out


def crosstab(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Counts with a fixed list of columns; cells without rows are NULL, not 0."""
    return df.groupBy(row).pivot(column, values).agg(F.count(F.lit(1)))


def summary_by(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact quartiles and maximum per group; NULL is a group too."""
    v = F.col(value).cast("double")
    rows = df.select(*by, v.alias("_v"))
    basic = rows.groupBy(*by).agg(
        F.count("_v").alias("n"), F.avg("_v").alias("mean"), F.stddev_samp("_v").alias("std"),
        F.min("_v").alias("min"), F.max("_v").alias("max"),
    )
    return null_safe_join(basic, exact_quantiles(rows, by, "_v", QUARTILES), by, "left")


def unpivot(df: DataFrame, columns: list[str], keep: list[str] = ()) -> DataFrame:
    """Long form (feature, value) of numeric columns."""
    long = [F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("double").alias("value")) for c in columns]
    return df.select(*keep, F.inline(F.array(*long)))


def frame_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """``summary_by`` of every column, in one pass over their long form."""
    return summary_by(unpivot(df, columns), ["feature"], "value")


def filled_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Non-null count of each column."""
    one = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in columns])
    return unpivot(one, columns).select("feature", F.col("value").cast("long").alias("n"))


def filled_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """How many rows have how many non-null columns."""
    return df.groupBy(non_null_count(columns).alias("n_filled")).agg(F.count("*").alias("n"))


def histogram(df: DataFrame, value: str, bins: int, by: str | None = None,
              lo: float | None = None, hi: float | None = None, edges_of=None) -> DataFrame:
    """Counts per equal-width bin 1..bins, by class on shared edges.

    Edges default to the range of the data, or of the class ``edges_of`` alone. NULLs and values outside the edges are dropped.
    """
    # both ends in one scan; repeated uses of the same scalar subquery run once
    ranged = df if edges_of is None else df.filter(F.col(by) == edges_of)
    ends = ranged.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi"))).scalar()
    low = F.lit(float(lo)) if lo is not None else ends["lo"]
    high = F.lit(float(hi)) if hi is not None else ends["hi"]
    binned = df.withColumn("bin", histogram_bin(F.col(value), low, high, bins))
    keys = ["bin"] if by is None else ["bin", by]
    return counts(binned.filter(F.col("bin").isNotNull()), *keys)


def correlations(df: DataFrame, label: str, columns: list[str]) -> DataFrame:
    """Correlation of each column with the label in one pass; rows where either is NULL are skipped."""
    y = F.col(label).cast("double")
    one = df.agg(*[F.corr(F.col(f"`{c}`").cast("double"), y).alias(c) for c in columns])
    return unpivot(one, columns).withColumnRenamed("value", "corr")


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Correlation of every pair of columns, in long form."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]

    def corr(a, b):
        return F.corr(F.col(f"`{a}`").cast("double"), F.col(f"`{b}`").cast("double"))

    one = df.agg(*[corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    cells = [
        F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(f"c{i}").alias("corr"))
        for i, (a, b) in enumerate(pairs)
        for x, y in ([(a, b)] if a == b else [(a, b), (b, a)])
    ]
    return one.select(F.inline(F.array(*cells)))


def top_and_bottom(correlation: DataFrame, k: int = 3) -> DataFrame:
    known = correlation.filter(F.col("corr").isNotNull())
    top = known.orderBy(F.desc("corr"), "feature").limit(k).withColumn("end", F.lit("top"))
    bottom = known.orderBy("corr", "feature").limit(k).withColumn("end", F.lit("bottom"))
    return top.unionByName(bottom)


def normal_quantiles(df: DataFrame, value: str, points: int = 99) -> DataFrame:
    """Sample quantiles beside those of the standard normal distribution."""
    probs = {f"p{i}": i / (points + 1) for i in range(1, points + 1)}
    sample = exact_quantiles(df.withColumn("_v", F.col(value).cast("double")), [], "_v", probs)
    rows = [
        F.struct(F.lit(p).alias("p"), F.lit(NormalDist().inv_cdf(p)).alias("normal"),
                 F.col(name).alias("sample"))
        for name, p in probs.items()
    ]
    return sample.select(F.inline(F.array(*rows)))


def probability_plot(df: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """(group, value, position, n, normal): every value at its place in the order beside the median of that order statistic.

    Medians of the uniform order statistics of n values as Filliben gives them, through the normal quantile. Equal values
    take consecutive places. Values that are null or NaN are left out. Places of very many equal values are made in blocks.
    """
    v = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    per_value = df.select(*by, v.alias("_v")).where("_v IS NOT NULL").groupBy(*by, "_v").agg(F.count("*").alias("_n"))
    placed = running_totals(per_value, list(by), "_v", ["_n"])
    sizes = per_value.groupBy(*by).agg(F.sum("_n").alias("n"))
    if by:
        placed = null_safe_join(placed, sizes, list(by))
    else:
        placed = placed.withColumn("n", sizes.select("n").scalar())
    blocks = placed.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / PLACES))))
    start = F.col("cum__n") - F.col("_n") + F.col("_block") * PLACES + 1
    each = blocks.repartition(*by, "_v", "_block").withColumn(
        "position", F.explode(F.sequence(start, F.least(F.col("cum__n"), start + (PLACES - 1))))
    )
    i, n = F.col("position"), F.col("n")
    last = F.pow(F.lit(0.5), F.lit(1.0) / n)
    p = F.when(i == n, last).when(i == 1, 1 - last).otherwise((i - 0.3175) / (n + 0.365))
    return each.select(*by, F.col("_v").alias(value), "position", "n", normal_quantile(p).alias("normal"))


def probability_line(df: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """(group, n, slope, intercept, r) of the least-squares line through the probability plot; one pass over its points.

    Null where the values are all equal or there is one.
    """
    x, y = F.col("normal"), F.col(value)
    return probability_plot(df, value, by).groupBy(*by).agg(
        F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
        F.try_divide(F.covar_pop(y, x), F.sqrt(F.var_pop(y) * F.var_pop(x))).alias("r"),
    )


def density(df: DataFrame, value: str, lo: float, hi: float, bandwidth: float,
            points: int = 50, bins: int = 500, by: list[str] = ()) -> DataFrame:
    """Gaussian density on a grid, from a binned count table.

    Values become counts of ``bins`` narrow bins first, so the grid meets at most ``bins`` rows per
    group however many rows the data has.
    """
    width = (hi - lo) / bins
    step = (hi - lo) / (points - 1)
    b = histogram_bin(F.col(value), F.lit(lo), F.lit(hi), bins)
    binned = counts(df.withColumn("bin", b).filter(F.col("bin").isNotNull()), "bin", *by)
    centre = F.lit(lo) + (F.col("bin") - 0.5) * width
    spread = binned.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    x = F.lit(lo) + F.col("_i") * step
    z = (x - centre) / bandwidth
    return (
        spread.withColumn("x", x)
        .withColumn("_k", F.col("n") * F.exp(z * z * F.lit(-0.5)))
        .groupBy(*by, "x")
        .agg((F.sum("_k") / (F.sum("n") * F.lit(bandwidth * math.sqrt(2 * math.pi)))).alias("density"))
    )


def kernel_density(df: DataFrame, value: str, by: list[str] = (), points: int = 100, cut: float = 3.0,
                   per_width: int = 512, reach: float = 8.0) -> DataFrame:
    """(group, x, density): Gaussian density at ``points`` places from the data, with the bandwidth of Scott's rule.

    The bandwidth is the sample deviation times n ** -0.2; the places go from ``cut`` bandwidths below the least value to as many above
    the largest. Each value is shared out linearly to the two nearest of ``per_width`` bins a bandwidth, and a bin counts at the
    places within ``reach`` bandwidths. Both departures from the direct sum together stay below a millionth of 1 / bandwidth. The work after the one
    pass over the rows grows with the occupied bins. Null and NaN are left out, as are groups whose values are all equal.
    """
    v = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    rows = df.select(*by, v.alias("_v")).where("_v IS NOT NULL")
    stats = rows.groupBy(*by).agg(F.count("*").alias("_n"), F.stddev_samp("_v").alias("_s"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    width = F.col("_s") * F.pow(F.col("_n"), F.lit(-0.2))
    stats = stats.where(F.col("_s") > 0).select(
        *by, "_n", width.alias("_h"), (F.col("_lo") - cut * width).alias("_from"), ((F.col("_hi") - F.col("_lo") + 2 * cut * width) / (points - 1)).alias("_step")
    )

    def with_stats(frame):
        return null_safe_join(frame, stats, list(by)) if by else frame.crossJoin(F.broadcast(stats))  # one row

    place = (F.col("_v") - F.col("_from")) / F.col("_h") * per_width
    binned = with_stats(rows).select(*by, place.alias("_at")).withColumn("_bin", F.floor("_at")).select(
        *by, F.inline(F.array(
            F.struct(F.col("_bin").alias("_bin"), (1 - (F.col("_at") - F.col("_bin"))).alias("_w")),
            F.struct((F.col("_bin") + 1).alias("_bin"), (F.col("_at") - F.col("_bin")).alias("_w")),
        ))
    ).groupBy(*by, "_bin").agg(F.sum("_w").alias("_w"))
    offset = F.col("_bin") / per_width * F.col("_h")  # of the bin from the first place
    first = F.greatest(F.lit(0).cast("long"), F.ceil((offset - reach * F.col("_h")) / F.col("_step")))
    last = F.least(F.lit(points - 1).cast("long"), F.floor((offset + reach * F.col("_h")) / F.col("_step")))
    near = with_stats(binned).where(first <= last).withColumn("_i", F.explode(F.sequence(first, last)))
    z = (F.col("_i") * F.col("_step") - offset) / F.col("_h")
    sums = near.groupBy(*by, "_i").agg(F.sum(F.col("_w") * F.exp(z * z * F.lit(-0.5))).alias("_k"))
    grid = stats.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(points - 1).cast("long"))))
    joined = null_safe_join(grid, sums, [*by, "_i"], "left")
    return joined.select(
        *by, (F.col("_from") + F.col("_i") * F.col("_step")).alias("x"),
        (F.coalesce("_k", F.lit(0.0)) / (F.col("_n") * F.col("_h") * F.lit(math.sqrt(2 * math.pi)))).alias("density"),
    )


def arg_max(df: DataFrame, column: str) -> DataFrame:
    """Rows with the highest value, ties kept."""
    return df.filter(F.col(column) == df.agg(F.max(column)).scalar())


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """LIMIT / OFFSET over a total order."""
    return df.orderBy(*order).offset(offset).limit(limit)


def random_rows(df: DataFrame, id_col: str, n: int, seed: int) -> DataFrame:
    """n rows in a repeatable random order."""
    return df.orderBy(hash_order(id_col, seed), id_col).limit(n)


def shuffled(df: DataFrame, id_col: str, seed: int) -> DataFrame:
    return df.orderBy(hash_order(id_col, seed), id_col)


def common_ids(a: DataFrame, b: DataFrame, id_col: str) -> DataFrame:
    return a.select(id_col).intersect(b.select(id_col))


def missing_ids(a: DataFrame, b: DataFrame, id_col: str) -> DataFrame:
    """Ids of ``a`` that are not in ``b``."""
    return a.select(id_col).distinct().exceptAll(b.select(id_col).distinct())
