"""Stage outputs: written tables, views, saved models, and the shared folder they live in."""

import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` of the session, else its warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return folder.rstrip("/")


def until_exit(spark: SparkSession, path: str) -> None:
    """Have the file system remove a written stage when the session's JVM ends."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/clinfeat/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a stage and read it back: the lineage ends here and a lost executor costs no rerun.

    The stage is removed when the session ends.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    until_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def save_stage(df: DataFrame, table: str) -> DataFrame:
    """Replace a table with the stage; dependants are rebuilt by calling them on the result."""
    spark = df.sparkSession
    path = new_path(spark, table)
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    df.write.mode("overwrite").option("path", path).saveAsTable(table)
    return spark.table(table)


def save_view(df: DataFrame, name: str) -> DataFrame:
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
