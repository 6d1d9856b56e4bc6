"""CSV stages with a leading index column, and list cells written as text."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import LongType, StructField, StructType

INDEX_COLUMN = "_c0"


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: StructType, has_index: bool = False) -> DataFrame:
    """Read with an explicit schema; an unnamed leading index column is dropped."""
    if has_index:
        schema = StructType([StructField(INDEX_COLUMN, LongType()), *schema.fields])
    df = spark.read.schema(schema).option("header", True).csv(path)
    return df.drop(INDEX_COLUMN)
