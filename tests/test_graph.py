"""Stage graph: cascade, order, rebuilds only where something changed."""

import pytest
from pyspark.sql import functions as F

from clinfeat.plans import catalogue
from clinfeat.sources import stages
from clinfeat.sources.graph import StageGraph

#: The chain of the scripts: stage and what it is made of.
CHAIN = {
    "patientinfo": ["admissions", "patients"], "firstheight": ["charts"], "firstweight": ["charts"], "first_labs": ["labs", "patientinfo"],
    "first_vitals": ["charts", "patientinfo"], "vitals_joined": ["patientinfo", "firstheight", "firstweight", "first_vitals"],
    "numeric_features": ["vitals_joined", "first_labs"], "evidence": ["diagnoses", "microbiology"], "outcomes": ["patientinfo", "evidence"],
}


@pytest.fixture
def graph(spark):
    g = StageGraph(spark)
    for name in ("admissions", "patients", "charts", "labs", "diagnoses", "microbiology"):
        path = stages.new_path(spark, f"source-{name}")
        spark.range(3).write.parquet(path)
        g.source(name, spark.read.parquet(path))
    for name, inputs in CHAIN.items():
        g.stage(name, inputs, lambda *dfs: dfs[0].select((F.col("id") + sum(1 for _ in dfs)).alias("id")))
    return g


def check_order(built):
    for i, name in enumerate(built):
        assert not set(CHAIN[name]) & set(built[i + 1:])


def test_dropping_a_base_stage_drops_the_chain(graph):
    assert sorted(graph.refresh()) == sorted(CHAIN)
    check_order(graph.built)
    with pytest.raises(ValueError, match="used by"):
        graph.drop("patientinfo")
    gone = graph.drop("patientinfo", cascade=True)
    assert set(gone) == {"patientinfo", "first_labs", "first_vitals", "vitals_joined", "numeric_features", "outcomes"}
    check_order(gone[::-1])
    assert set(graph.stale()) == set(gone)
    again = graph.refresh()
    check_order(again)
    assert set(again) == set(gone) and graph.refresh() == []
    assert sorted(r.id for r in graph.table("numeric_features").collect()) == [8, 9, 10]


def test_only_what_is_needed_and_changed_is_built(spark, graph):
    assert graph.table("vitals_joined").count() == 3
    assert set(graph.built) == {"patientinfo", "firstheight", "firstweight", "first_vitals", "vitals_joined"}
    graph.refresh()
    path = stages.new_path(spark, "source-labs")
    spark.range(5).write.parquet(path)
    graph.source("labs", spark.read.parquet(path))
    assert graph.stale() == ["first_labs", "numeric_features"] == graph.refresh()
    # the same files written anew count as changed, a given version only if it differs
    df = spark.range(4)
    graph.source("labs", df, "a")
    assert graph.refresh() == ["first_labs", "numeric_features"]
    graph.source("labs", df, "a")
    assert graph.refresh() == []
    # a new function for a stage in the middle
    graph.stage("first_vitals", ["charts", "patientinfo"], lambda charts, info: charts.where("id < 1"))
    assert graph.refresh("outcomes") == [] and graph.refresh("vitals_joined") == ["first_vitals", "vitals_joined"]
    assert graph.stale() == ["numeric_features"]


def test_faults(spark, graph):
    with pytest.raises(ValueError, match="unknown"):
        graph.stage("x", ["nowhere"], lambda df: df)
    with pytest.raises(ValueError, match="itself"):
        graph.stage("patientinfo", ["admissions", "outcomes"], lambda a, b: a)
    with pytest.raises(ValueError, match="source"):
        graph.stage("labs", ["charts"], lambda df: df)
    with pytest.raises(KeyError):
        graph.drop("labs")
    assert graph.drop("evidence") == [] and set(graph.dependants("evidence")) == {"outcomes"}

    def fails(df):
        raise RuntimeError("no rows")

    graph.refresh()
    version = graph._version("evidence")
    graph.stage("late", ["evidence"], fails)
    with pytest.raises(RuntimeError):
        graph.table("late")
    assert graph._version("evidence") == version and graph.stale() == ["late"]
    empty = StageGraph(spark)
    empty.source("none", spark.range(0), "1")
    empty.stage("still_none", ["none"], lambda df: df)
    assert empty.table("still_none").count() == 0 and empty.refresh() == []


def test_query_drops_and_rebuilds(spark):
    found = catalogue.QUERIES["stage_chain"](spark, "/root/testdata/sf0.001")
    assert found.count() > 0
