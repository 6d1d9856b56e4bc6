import os
import subprocess
import sys
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from clinfeat.functions.text import list_text, parse_list
from clinfeat.sources import files, stages, tables


def test_read_table_renames_and_prunes(spark):
    folder = stages.new_path(spark, "hospital")
    schema = tables.SCHEMAS["chartevents"]
    row = (1, 2, 3, 211, datetime(2100, 1, 1), "80", 80.0, "bpm", 0, None, "Final")
    spark.createDataFrame([row], schema).write.parquet(f"{folder}/chartevents.parquet")
    df = tables.read_table(spark, folder, "chartevents", ["subject_id", "hadm_id", "itemid", "charttime", "value", "valuenum"])
    assert df.columns == ["subj_id", "enc_id", "item_id", "ts", "value_text", "value"]
    assert df.first()["value"] == 80.0
    assert "resultstatus" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(tables.SCHEMAS))
def test_schemas_parse(name):
    assert len(StructType.fromDDL(tables.SCHEMAS[name]).fields) > 1


def test_csv_with_index_column_and_lists(spark):
    path = stages.new_path(spark, "csv")
    df = spark.createDataFrame([(0, [1, 2], ["0380", "a"], 7), (1, [3], [], 8)], "i long, ids array<long>, codes array<string>, n long")
    text = df.select(F.col("i").alias("_c0"), list_text(F.col("ids")).alias("ids"),
                     list_text(F.col("codes"), quote=True).alias("codes"), "n")
    assert text.orderBy("n").first()["codes"] == "['0380', 'a']"
    files.write_csv(text, path)
    back = files.read_csv(spark, path, StructType.fromDDL("ids string, codes string, n long"), has_index=True)
    assert back.columns == ["ids", "codes", "n"]
    out = back.select(parse_list(F.col("ids"), "long"), parse_list(F.col("codes")), "n").orderBy("n").collect()
    assert [tuple(r) for r in out] == [([1, 2], ["0380", "a"], 7), ([3], [], 8)]


def test_stage_is_replaced(spark):
    one = stages.save_stage(spark.range(3), "clinfeat_test_stage")
    assert one.count() == 3
    assert stages.save_stage(spark.range(5), "clinfeat_test_stage").count() == 5
    assert stages.save_view(spark.range(2), "clinfeat_test_view").count() == 2


def test_materialize_cuts_the_lineage(spark):
    df = stages.materialize(spark.range(100).repartition(3).withColumn("x", F.rand(1)), "t")
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert df.count() == 100


def test_shared_folder_comes_from_the_session(spark):
    given = spark.conf.get("spark.checkpoint.dir", None)
    assert stages.shared_folder(spark) == (given or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def test_stages_end_with_the_session(tmp_path):
    """Run in a session of its own: nothing is left behind."""
    code = (
        "from pyspark.sql import SparkSession\n"
        "from clinfeat.sources import stages\n"
        f"s = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').config('spark.checkpoint.dir', 'file://{tmp_path}').getOrCreate()\n"
        "assert stages.materialize(s.range(3), 'x').count() == 3\n"
        f"import os; assert os.listdir('{tmp_path}/clinfeat')\n"
        "s.stop()\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(__file__)), timeout=120)
    for _ in range(50):
        if not os.path.exists(tmp_path / "clinfeat") or not os.listdir(tmp_path / "clinfeat"):
            break
        time.sleep(0.2)
    assert not os.path.exists(tmp_path / "clinfeat") or os.listdir(tmp_path / "clinfeat") == []
