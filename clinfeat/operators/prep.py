"""From the dataset to model input: selection, balance, split, imputation, scaling."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from clinfeat.codes.values import DRUG_FEATURES, FOLDED_GROUPS, MODEL_FEATURES, SEED
from clinfeat.functions.numbers import capped_sum, combined_label, non_null_count
from clinfeat.operators.nearest import nearest_values
from clinfeat.operators.ordered import exact_quantiles, first_by_hash
from clinfeat.operators.profile import unpivot

IDS = ["outcome", "expire", "enc_id"]
COPY_BLOCK = 10_000


def select_features(dataset: DataFrame, features=MODEL_FEATURES, complete: float = 0.75) -> DataFrame:
    """Feature columns of rows that are complete enough.

    The count includes label, expire flag and id; the limit is ``complete`` times (all selected
    columns and the count itself, less three), and rows must be above it.
    """
    chosen = dataset.select(*[F.col(f"`{c}`") for c in features], *IDS)
    cutoff = complete * (len(chosen.columns) + 1 - 3)
    return chosen.filter(non_null_count(chosen.columns) > F.lit(cutoff))


def select_drug_features(flags: DataFrame, features=DRUG_FEATURES, folded=FOLDED_GROUPS) -> DataFrame:
    """Drug columns of the model; rare groups are folded into ``Other``."""
    return flags.withColumn("Other", capped_sum(folded)).select(
        *[F.col(f"`{c}`") for c in features], "outcome", "enc_id"
    )


def with_death_classes(dataset: DataFrame) -> DataFrame:
    """Four classes: outcome plus twice the death flag."""
    return dataset.withColumn("outcome", combined_label(F.col("outcome"), F.col("expire")))


def undersample(df: DataFrame, label: str, id_col: str, seed: int = SEED) -> DataFrame:
    """Every class cut to the size of the smallest, by hash order of the id. Rows without a label are left out."""
    df = df.filter(F.col(label).isNotNull())
    sizes = df.groupBy(label).agg(F.count("*").alias("n"))
    quota = sizes.select(label, sizes.agg(F.min("n")).scalar().alias("quota"))
    return first_by_hash(df, label, id_col, seed, quota).filter("_first").drop("_first")


def oversample(df: DataFrame, label: str, id_col: str, seed: int = SEED) -> DataFrame:
    """Every class repeated to the size of the largest: all rows equally often, and the first ones
    in hash order once more. Copies are numbered in ``copy``.

    Copies are made in two steps, so a single row may have more copies than an array can hold, and
    they are spread over tasks in between. Rows without a label are left out.
    """
    df = df.filter(F.col(label).isNotNull())
    sizes = df.groupBy(label).agg(F.count("*").alias("n"))
    largest = sizes.agg(F.max("n")).scalar()
    quota = sizes.select(label, (largest % F.col("n")).alias("quota"))
    times = sizes.select(label, F.floor(largest / F.col("n")).alias("_times"))
    copies = first_by_hash(df, label, id_col, seed, quota).join(F.broadcast(times), label).withColumn(
        "_copies", F.col("_times") + F.col("_first").cast("int")
    )
    last_block = F.floor((F.col("_copies") - 1) / COPY_BLOCK)
    blocks = copies.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), last_block)))
    start = F.col("_block") * COPY_BLOCK + 1
    end = F.least(F.col("_copies"), start + (COPY_BLOCK - 1))
    return (
        blocks.repartition(id_col, "_block")
        .withColumn("copy", F.explode(F.sequence(start, end)))
        .drop("_first", "_times", "_copies", "_block")
    )


def balance(df: DataFrame, label: str = "outcome", id_col: str = "enc_id", seed: int = SEED,
            under: bool = True) -> DataFrame:
    return undersample(df, label, id_col, seed) if under else oversample(df, label, id_col, seed)


def stratified_split(df: DataFrame, label: str = "outcome", id_col: str = "enc_id",
                     test_size: float = 0.2, seed: int = SEED) -> DataFrame:
    """Add ``is_test``: an exact share of each class, by hash order of the id. Rows without a label are left out."""
    df = df.filter(F.col(label).isNotNull())
    quota = df.groupBy(label).agg(F.round(F.count("*") * test_size).cast("long").alias("quota"))
    return first_by_hash(df, label, id_col, seed, quota).withColumnRenamed("_first", "is_test")


def known(column: str) -> Column:
    """The number, NULL where it is missing; NaN is missing too."""
    return F.nanvl(F.col(f"`{column}`").cast("double"), F.lit(None).cast("double"))


def medians(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Exact medians, one job for all columns; one number per column comes back."""
    found = exact_quantiles(unpivot(df.withColumns({c: known(c) for c in columns}), columns), ["feature"], "value", {"median": 0.5})
    return {r["feature"]: r["median"] for r in found.collect()}


def impute_constants(df: DataFrame, values: dict[str, float]) -> DataFrame:
    return df.withColumns({c: F.coalesce(known(c), F.lit(v)) for c, v in values.items()})


def impute_median(df: DataFrame, columns: list[str], fitted_on: DataFrame | None = None) -> DataFrame:
    return impute_constants(df, medians(df if fitted_on is None else fitted_on, columns))


@dataclass
class Scaler:
    """Mean and population deviation per numeric column; 0/1 columns are left alone."""

    mean: dict[str, float]
    std: dict[str, float]
    binary: list[str]


def fit_scaler(df: DataFrame, columns: list[str]) -> Scaler:
    """One aggregation. A column is binary when both 0 and 1 occur and nothing else does."""
    aggs = []
    for i, c in enumerate(columns):
        v = known(c)
        aggs += [
            F.avg(v).alias(f"m{i}"), F.stddev_pop(v).alias(f"s{i}"),
            F.max((v == 0).cast("int")).alias(f"z{i}"), F.max((v == 1).cast("int")).alias(f"o{i}"),
            F.max((~v.isin(0.0, 1.0)).cast("int")).alias(f"x{i}"),
        ]
    row = df.agg(*aggs).first()
    binary = [c for i, c in enumerate(columns) if row[f"z{i}"] and row[f"o{i}"] and not row[f"x{i}"]]
    numeric = [(i, c) for i, c in enumerate(columns) if c not in binary and row[f"m{i}"] is not None]
    return Scaler(
        mean={c: row[f"m{i}"] for i, c in numeric},
        std={c: row[f"s{i}"] or 1.0 for i, c in numeric},
        binary=binary,
    )


def apply_scaler(df: DataFrame, scaler: Scaler) -> DataFrame:
    return df.withColumns({
        c: (F.col(f"`{c}`").cast("double") - F.lit(m)) / F.lit(scaler.std[c])
        for c, m in scaler.mean.items()
    })


def standardise(df: DataFrame, columns: list[str]) -> DataFrame:
    return apply_scaler(df, fit_scaler(df, columns))


def impute_nearest(df: DataFrame, columns: list[str], id_col: str = "enc_id", k: int = 3,
                   donors: DataFrame | None = None, block_rows: int = 2048,
                   min_distance: float = 1e-6, audit: dict | None = None) -> DataFrame:
    """Fill each missing cell from the k nearest rows that have it, weighted by inverse distance.

    Distance is the mean squared difference over the columns both rows have; scale the columns
    first. NaN is missing. A cell without any usable row stays NULL. Ties go to the lower donor id.

    Exact, and for all rows: blocks of rows that cannot hold a nearer donor are not read (``nearest``).
    ``audit`` gets the numbers of pairs of blocks that were read and that there are.
    """
    def points(frame):
        return frame.select(F.col(id_col).cast("long").alias("id"), F.array(*[known(c) for c in columns]).alias("x"))

    rows, source = points(df), points(df if donors is None else donors)
    found = nearest_values(rows, source, len(columns), k, block_rows, audit)
    weight = F.lit(1.0) / F.greatest(F.col("distance"), F.lit(min_distance))
    filled = (
        found.groupBy("id", "feature")
        .agg((F.sum(F.col("value") * weight) / F.sum(weight)).alias("value"))
        .groupBy("id")
        .agg(*[F.max(F.when(F.col("feature") == j, F.col("value"))).alias(f"_f{j}") for j in range(len(columns))])
        .withColumnRenamed("id", id_col)
    )
    return df.join(filled, id_col, "left").withColumns({
        c: F.coalesce(known(c), F.col(f"_f{j}")) for j, c in enumerate(columns)
    }).drop(*[f"_f{j}" for j in range(len(columns))])


def mask_cells(df: DataFrame, columns: list[str], id_col: str = "enc_id", one_in: int = 10) -> DataFrame:
    """Blank a repeatable share of the known cells, to measure imputation."""
    def chosen(c):
        h = F.conv(F.substring(F.md5(F.concat_ws("|", F.col(id_col).cast("string"), F.lit(c))), 1, 6), 16, 10)
        return F.pmod(h.cast("long"), F.lit(one_in)) == 0

    return df.withColumns({c: F.when(~chosen(c), F.col(f"`{c}`").cast("double")) for c in columns})


def imputation_error(truth: DataFrame, masked: DataFrame, imputed: DataFrame, columns: list[str],
                     id_col: str = "enc_id") -> DataFrame:
    """Mean squared error per column over the cells that were blanked."""
    def long(df, name):
        return unpivot(df, columns, [id_col]).withColumnRenamed("value", name)

    keys = [id_col, "feature"]
    cells = (
        long(truth, "t").filter(F.col("t").isNotNull())
        .join(long(masked, "m").filter(F.col("m").isNull()), keys)
        .join(long(imputed, "i"), keys)
    )
    return cells.groupBy("feature").agg(
        F.avg((F.col("t") - F.col("i")) * (F.col("t") - F.col("i"))).alias("mse"),
        F.count("*").alias("n_cells"),
    )
