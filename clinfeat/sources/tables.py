"""Source tables: schemas of the hospital database and the column names used in this library."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

# Columns of the public hospital schema that the library reads.
SCHEMAS = {
    "admissions": "subject_id long, hadm_id long, admittime timestamp_ntz, dischtime timestamp_ntz, "
                  "admission_type string, admission_location string, ethnicity string, "
                  "insurance string, marital_status string, hospital_expire_flag int",
    "patients": "subject_id long, gender string, dob timestamp_ntz, dod timestamp_ntz, expire_flag int",
    "diagnoses_icd": "subject_id long, hadm_id long, icd9_code string, seq_num int",
    "labevents": "subject_id long, hadm_id long, itemid int, charttime timestamp_ntz, valuenum double",
    "chartevents": "subject_id long, hadm_id long, icustay_id long, itemid int, "
                   "charttime timestamp_ntz, value string, valuenum double, valueuom string, "
                   "warning int, error int, resultstatus string",
    "prescriptions": "subject_id long, hadm_id long, icustay_id long, startdate timestamp_ntz, "
                     "drug_type string, drug string, drug_name_poe string, drug_name_generic string",
    "microbiologyevents": "subject_id long, hadm_id long, org_name string, charttime timestamp_ntz",
    "d_items": "itemid int, label string",
    "d_labitems": "itemid int, label string, fluid string, category string",
}

# Hospital column name -> library column name.
COLUMN_NAMES = {
    "subject_id": "subj_id",
    "hadm_id": "enc_id",
    "admittime": "start_ts",
    "dischtime": "end_ts",
    "hospital_expire_flag": "expire",
    "icd9_code": "code",
    "itemid": "item_id",
    "charttime": "ts",
}


def read_table(spark: SparkSession, folder: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """Scan one hospital table with its fixed schema; only the asked columns are read."""
    schema = StructType.fromDDL(SCHEMAS[name])
    df = spark.read.schema(schema).parquet(f"{folder}/{name}.parquet")
    return with_library_names(df.select(*(columns or df.columns)), name)


def read_database(spark: SparkSession, url: str, name: str, partition_column: str,
                  lower: int, upper: int, partitions: int, properties: dict) -> DataFrame:
    """The same scan from a database, split into ranges of a numeric column."""
    df = spark.read.jdbc(url, name, column=partition_column, lowerBound=lower, upperBound=upper,
                         numPartitions=partitions, properties=properties)
    return with_library_names(df, name)


def with_library_names(df: DataFrame, name: str) -> DataFrame:
    names = dict(COLUMN_NAMES)
    if "valuenum" in df.columns:
        # the measurement is the number; the text beside it keeps a name of its own
        names |= {"value": "value_text", "valuenum": "value"}
    return df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})
