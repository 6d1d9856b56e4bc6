"""Small helpers of the operators: cutting lineage, reading tables, mapping Arrow batches."""

import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder and go on from there.

    The folder is ``spark.checkpoint.dir``. Only where that is unset (tests) the session's warehouse gets one.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not spark.conf.get("spark.checkpoint.dir", None) and context.getCheckpointDir() is None:
        warehouse = spark.conf.get("spark.sql.warehouse.dir").removeprefix("file:")
        context.setCheckpointDir(os.path.join(warehouse, "llm-checkpoints"))
    return df.checkpoint(eager=True)


def map_batches(df: DataFrame, function, schema: str) -> DataFrame:
    """``function`` takes a record batch and gives one record batch, or yields several."""
    def run(batches):
        for batch in batches:
            made = function(batch)
            if isinstance(made, pa.RecordBatch):
                yield made
            else:
                yield from made
    return df.mapInArrow(run, schema)
