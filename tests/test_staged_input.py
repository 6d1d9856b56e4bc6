"""The stages of the model input."""

from clinfeat.plans import dataset as plans
from clinfeat.sources import stages


def test_the_dataset_is_read_few_times(spark, monkeypatch):
    data = [(i, int(i % 3 == 0), int(i % 5 == 0), float(i % 7), float(i % 11)) for i in range(400)]
    source = stages.materialize(spark.createDataFrame(data, "enc_id long, outcome int, expire int, a double, b double"), "few-reads")
    reads, write = {}, plans.materialize

    def seen(df, name):
        reads[name] = df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")
        return write(df, name)

    monkeypatch.setattr(plans, "materialize", seen)
    p = plans.prepare(source, ["a", "b"])
    assert p.train.count() and p.test.count() and max(reads.values()) <= 10, reads  # 30 and more while the split read the balancing anew each time
