"""The star-schema test tables seen as hospital tables.

Each view is one SELECT. Only interval arithmetic differs between SQL dialects, so the texts take it
from a small ``Dialect``; the check engine reads the same views.
"""

from functools import cached_property
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F

from clinfeat.codes.values import LabItem, UnitItem, VitalItem

TEST_LABS = [
    LabItem(1, "ALBUMIN", 45.0), LabItem(2, "BUN", 40.0), LabItem(3, "BUN", 48.0),
    LabItem(4, "GLUCOSE", 49.0), LabItem(5, "LACTATE", 30.0), LabItem(6, "SODIUM", 50.0),
    LabItem(7, "WBC", 46.0),
]
# The dictionary of item names; item 7 has none.
TEST_DICTIONARY = [
    LabItem(1, "ALBUMIN", 45.0), LabItem(2, "BUN", 40.0), LabItem(3, "BUN", 48.0),
    LabItem(4, "GLUCOSE", 49.0), LabItem(5, "LACTATE", 30.0), LabItem(6, "SODIUM", 50.0),
]
TEST_VITALS = [
    VitalItem(1, "heartrate", 0.0, 40.0), VitalItem(2, "heartrate", 0.0, 45.0),
    VitalItem(3, "sysbp", 0.0, 48.0), VitalItem(4, "tempc", 5.0, 48.0, fahrenheit=True),
    VitalItem(5, "tempc", 10.0, 50.0), VitalItem(6, "spo2", 0.0, 49.0, hi_closed=True),
    VitalItem(7, "glucose", 0.0, None),
]
TEST_WEIGHTS = [UnitItem(1, 1.0), UnitItem(2, 0.45359237), UnitItem(3, 2.2)]
TEST_HEIGHTS = [UnitItem(4, 2.54), UnitItem(5, 4.0)]

ADJECTIVES = ["blue", "cold", "hot", "large", "new", "old", "red", "small"]


def _all(noun, without=()):
    return [f"{a} {noun}" for a in ADJECTIVES if f"{a} {noun}" not in without]


TEST_UNNAMED = ["new ring", "old rod"]
TEST_SPELLINGS = {
    "Cefazolin": _all("anvil"),
    "Vancomycin": _all("bolt"),
    "Clotrimazole": _all("gear"),
    "Tetracycline": ["blue gizmo", "red gizmo"],
    "Metronidazole": _all("plate"),
    "Clindamycin": _all("ring", TEST_UNNAMED),
    "Penicillin": _all("rod", TEST_UNNAMED),
    "Gentamicin": ["blue widget", "cold widget", "hot widget"],
    "Rifampin": ["large widget", "new widget", "old widget", "red widget", "small widget"],
}
TEST_PATTERN = "%RING%"
TEST_CODE_PREFIX = "00"


class Dialect(NamedTuple):
    minutes: str
    days: str
    text: str
    timestamp: str


SPARK = Dialect(
    "make_dt_interval(0, 0, cast({} as int), 0)", "make_dt_interval(cast({} as int))", "string",
    "timestamp_ntz",
)
DUCKDB = Dialect("to_minutes(cast({} as integer))", "to_days(cast({} as integer))", "varchar", "timestamp")

LINE_ORDER = "l_linenumber, l_partkey, l_suppkey, l_extendedprice"


def view_texts(d: Dialect) -> dict[str, str]:
    start = f"o_orderdate + {d.minutes.format('o_orderkey % 1440')}"
    enc = f"""
        SELECT o_orderkey AS enc_id, o_custkey AS subj_id, {start} AS start_ts,
          {start} + {d.minutes.format('(o_orderkey % 29) * 700 + 60')} AS end_ts,
          CASE o_orderpriority WHEN '1-URGENT' THEN 'URGENT' WHEN '3-MEDIUM' THEN 'ELECTIVE'
            WHEN '5-LOW' THEN 'NEWBORN' ELSE 'EMERGENCY' END AS admission_type,
          CASE o_orderkey % 5 WHEN 0 THEN 'EMERGENCY ROOM ADMIT' WHEN 1 THEN 'CLINIC REFERRAL/PREMATURE'
            WHEN 2 THEN 'TRANSFER FROM HOSP/EXTRAM' WHEN 3 THEN 'PHYS REFERRAL/NORMAL DELI'
            ELSE '** INFO NOT AVAILABLE **' END AS admission_location,
          CASE o_custkey % 9 WHEN 0 THEN 'WHITE' WHEN 1 THEN 'WHITE - RUSSIAN' WHEN 2 THEN 'PORTUGUESE'
            WHEN 3 THEN 'BLACK/AFRICAN AMERICAN' WHEN 4 THEN 'HISPANIC/LATINO - PUERTO RICAN'
            WHEN 5 THEN 'ASIAN - CHINESE' WHEN 6 THEN 'AMERICAN INDIAN/ALASKA NATIVE'
            WHEN 7 THEN 'PATIENT DECLINED TO ANSWER' ELSE 'UNKNOWN/NOT SPECIFIED' END AS ethnicity,
          CASE o_orderkey % 4 WHEN 0 THEN 'Medicare' WHEN 1 THEN 'Medicaid' WHEN 2 THEN 'Private'
            ELSE 'Self Pay' END AS insurance,
          CASE o_orderkey % 6 WHEN 0 THEN 'MARRIED' WHEN 1 THEN 'SINGLE' WHEN 2 THEN 'WIDOWED'
            WHEN 3 THEN 'DIVORCED' WHEN 4 THEN 'UNKNOWN (DEFAULT)' END AS marital_status,
          CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS expire
        FROM {{orders}}"""
    born = f"{d.timestamp} '1900-01-01 00:00:00' + {d.days.format('(c_custkey * 37) % 36500')}"
    return {
        "enc": enc,
        "subj": f"""
        SELECT c_custkey AS subj_id, {born} AS dob,
          CASE WHEN c_custkey % 3 <> 0 THEN {born} + {d.days.format('(c_custkey * 53) % 40000 - 300')} END AS dod,
          CASE c_mktsegment WHEN 'BUILDING' THEN 'M' WHEN 'MACHINERY' THEN 'M' WHEN 'FURNITURE' THEN NULL
            ELSE 'F' END AS gender
        FROM {{customer}}""",
        "meas": f"""
        SELECT subj_id, enc_id, l_linenumber AS item_id,
          start_ts + {d.minutes.format('(l_partkey % 100) * 12 - 480')} AS ts,
          CASE WHEN l_quantity > 2 THEN l_quantity END AS value,
          CASE WHEN l_linestatus = 'O' AND l_quantity > 48 THEN 1 WHEN l_linestatus = 'F' THEN 0 END AS error
        FROM {{lineitem}} JOIN ({enc}) e ON l_orderkey = enc_id""",
        "diag": f"""
        SELECT o_custkey AS subj_id, l_orderkey AS enc_id,
          row_number() OVER (PARTITION BY l_orderkey ORDER BY {LINE_ORDER}) AS seq_num,
          concat(lpad(cast(l_partkey % 1000 AS {d.text}), 3, '0'), cast(l_suppkey % 100 AS {d.text})) AS code
        FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey""",
        "micro": f"""
        SELECT subj_id, enc_id, p_name AS org_name,
          start_ts + {d.minutes.format('l_partkey % 9000')} AS ts
        FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey JOIN ({enc}) e ON l_orderkey = enc_id
        WHERE l_returnflag = 'R'""",
        "rx": f"""
        SELECT subj_id, enc_id, p_name AS drug,
          CASE WHEN l_returnflag = 'A' THEN 'BASE' ELSE 'MAIN' END AS drug_type,
          cast(cast(start_ts AS date) + cast(l_linenumber - 2 AS int) AS {d.timestamp}) AS startdate
        FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey JOIN ({enc}) e ON l_orderkey = enc_id""",
    }


class Retail:
    """Test tables of one folder, and the views over them."""

    names = ["customer", "orders", "lineitem", "part", "events", "labels", "nation"]

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        text = view_texts(SPARK)[name]
        used = {t: self.table(t) for t in self.names if f"{{{t}}}" in text}
        return self.spark.sql(text, **used)

    @cached_property
    def enc(self):
        return self.view("enc")

    @cached_property
    def subj(self):
        return self.view("subj")

    @cached_property
    def meas(self):
        return self.view("meas")

    @cached_property
    def diag(self):
        return self.view("diag")

    @cached_property
    def micro(self):
        return self.view("micro")

    @cached_property
    def rx(self):
        return self.view("rx")

    @property
    def code_is(self):
        return F.col("code").startswith(TEST_CODE_PREFIX)
