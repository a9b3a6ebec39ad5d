"""Findings F16, F17: Python workers of an executor in a training and behind it."""

from fuseline.plans import blocks
from fuseline.plans import train as training
from fuseline.plans.model import Model, Point
from fuseline.sources.corpus import to_sequences

from .test_findings_r03 import texts


def test_sequences_are_computed_in_one_worker_a_core(spark, monkeypatch):
    """The filter of null sequences had them computed twice, in two workers a core, before a third one packed them."""
    plans, write = [], blocks.Blocks._write

    def noted(self, rows):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        write(self, rows)

    monkeypatch.setattr(blocks.Blocks, "_write", noted)
    docs = spark.createDataFrame([(k, s) for k, s in enumerate(texts(40, 3))], "doc_id long, text string")
    out = training.train(to_sequences(docs), 256 + 6, "frequency", 3, 2)
    assert plans[0].count("EvalPython") == 1
    want = training.train(to_sequences(docs.filter("text IS NOT NULL")), 256 + 6, "frequency", 3, 2, local=True)
    assert out.steps == want.steps and out.report == want.report
    assert out.seqs.count() == want.seqs.count() == docs.count() - 1


def test_tables_of_a_model_are_in_the_plan(spark):
    """Rows given as Python objects started a worker on each core, and the planner took them for endless."""
    model = Model.from_rules([(97, 98, 256), (256, 99, 257)]).with_reserved(["<|u|>"])
    model.points[258] = Point(model.points[258].vector, None, model.points[258].scale)
    for table in (model.vocab(spark), model.rule_table(spark), Model().rule_table(spark)):
        plan = table._jdf.queryExecution().executedPlan().toString()
        assert "LocalTableScan" in plan and "ExistingRDD" not in plan
    rows = {r["coord_id"]: r for r in model.vocab(spark).collect()}
    assert rows.keys() == model.points.keys()
    assert all((rows[k]["vector"], rows[k]["name"], rows[k]["scale"]) == (p.vector.tolist(), p.name, p.scale) for k, p in model.points.items())
    assert [tuple(r) for r in model.rule_table(spark).collect()] == [(0, 97, 98, 256), (1, 256, 99, 257)]
    assert Model().rule_table(spark).collect() == []
