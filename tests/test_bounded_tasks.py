"""Rows that group by keys of which most differ are dealt to tasks of a bounded size, with the same results."""

import re

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from compare import assert_same, connect
from gridlens.operators import clean, score
from gridlens.operators.models import Families
from gridlens.operators.retrain import fit_mix
from gridlens.plans import catalog
from gridlens.plans import models as plans

SF = "/root/testdata/sf0.001"


def dealt(df):
    """Partitions of the exchanges that the query itself numbers."""
    return [int(n) for n in re.findall(r"(\d+)\), REPARTITION_BY_NUM", df._jdf.queryExecution().executedPlan().toString())]


@pytest.mark.parametrize("name", ["b11_misaligned", "h16_family_truth"])
def test_tasks_grow_with_the_rows(spark, monkeypatch, name):
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    for of_a_task, few, want in ((500, 200, -(-rows // 500)), (500, 5, 5), (500, 2, -(-rows // 2000))):
        monkeypatch.setattr(clean, "TASK_ROWS", of_a_task)
        monkeypatch.setattr(clean, "FEW", few)
        assert dealt(catalog.QUERIES[name](spark, SF)) == [want] * 2
    assert_same(catalog.QUERIES[name](spark, SF), connect(SF), catalog.SQL[name])


def test_a_long_trace_is_counted_in_chunks(spark):
    long = spark.range(1000).select(F.lit(1).alias("scenario"), F.lit("a").alias("trace"), (F.col("id") + 3).alias("sample"))
    short = spark.createDataFrame([(1, "b", 3), (1, "c", None), (None, "d", 5)], "scenario int, trace string, sample long")
    spans = clean.trace_spans(long.union(short), "scenario", "trace", "sample", size=64)
    assert {tuple(r) for r in spans.collect()} == {(1, "a", 1000, 3), (1, "b", 1, 3), (1, "c", 1, None), (None, "d", 1, 5)}
    assert [tuple(r) for r in clean.misaligned(spans, "scenario", ["n", "start"]).collect()] == [(1, 2, 1)]


def test_truth_of_odd_rows(spark):
    c = spark.createDataFrame([(1, 0, "a", 2.0, "on"), (1, 0, "a", 1.0, None), (None, 0, "b", 5.0, None), (1, None, "b", None, "off")], "scenario long, sample long, family string, p double, state string")
    r = spark.createDataFrame([(1, ["a"]), (7, ["a", "c", "a"]), (None, ["z"])], "scenario long, expected array<string>")
    rows = {tuple(x) for x in score.family_truth(c, r, "expected", ["scenario", "sample"]).collect()}
    assert rows == {(1, 0, "a", 3.0, True), (None, 0, "b", 5.0, True), (1, None, "b", None, False), (7, None, "a", None, None), (7, None, "c", None, None), (None, None, "z", None, None)}


def test_models_of_families_prepare_features_once(spark):
    """The same predictions as from each family's whole pipeline; constants and models of another fit may stand between."""
    df = spark.range(60).select("id", (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 5).cast("double").alias("y"), (F.col("id") % 2).cast("int").alias("a"), (F.col("id") % 3 == 0).cast("int").alias("b"), F.lit(1).alias("c"))
    one, other = (Families.fit(df, columns, ["a", "b", "c"], "presence", trees=3).models for columns in (["x", "y"], ["y"]))
    models = Families({"a": one["a"], "c": one["c"], "b": one["b"], "d": other["a"], "e": one["b"]})
    got = models.predict(df, "on")
    assert got.columns == [*df.columns, "on_a", "on_c", "on_b", "on_d", "on_e"]
    for f, m in {"a": one["a"], "b": one["b"], "d": other["a"], "e": one["b"]}.items():
        want = {r["id"]: r["p"] for r in m.transform(df).select("id", vector_to_array("probability")[1].alias("p")).collect()}
        assert {r["id"]: r[f"on_{f}"] for r in got.collect()} == want
    assert {r["on_c"] for r in got.collect()} == {1.0}
    scaled = lambda d: d._jdf.queryExecution().optimizedPlan().toString().count("AS raw_features#")
    assert scaled(Families({"a": one["a"], "b": one["b"]}).predict(df, "on")) == 1


def test_live_states_train_on_stored_windows(spark, monkeypatch):
    """Windows come from files, in pieces of their size, not from a shuffle's pieces."""
    seen = []
    monkeypatch.setattr(plans, "fit_mix", lambda known, *a, **k: seen.append(known) or fit_mix(known, *a, **k))
    assert catalog.QUERIES["j9_live_states"](spark, SF).count() > 0
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert "known" in plan and "Exchange" not in plan
