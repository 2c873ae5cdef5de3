"""Scenarios added up as arrays give what rows of samples give."""

import inspect

import pytest
from pyspark.sql import functions as F

from gridlens.operators import explore, mixes, scenarios
from gridlens.operators.retrain import FEATURES, scenario_windows
from gridlens.plans import catalog, events
from gridlens.plans import models as plans

SF = "/root/testdata/sf0.001"


def keyed(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def taken(spark, n):
    """Takes of recordings shorter and longer than a scenario, on one and on all phases; a device that never is on, and one with a missing sample."""
    samples = [(rid, i, None if (rid, i) == (3, 5) else 40.0 * rid * (i % 9 > 3) + i % 7, float(i % 11)) for rid, k in ((1, 7), (2, 150), (3, 60)) for i in range(k)]
    chosen = spark.createDataFrame([(0, "a", 1), (0, "b", 2), (1, "a", 3), (1, "c", 2), (2, "c", 1), (3, "b", 3)], "scenario long, family string, rid long")
    blocks = scenarios.schedule(chosen, n, 1.0, 7).where("not (scenario = 2)")
    t = scenarios.takes(chosen, spark.createDataFrame(samples, "rid long, i long, p double, q double"), blocks, n)
    phase = F.when(F.col("family") == "a", 0).when(F.col("family") == "b", 2).otherwise(3)
    voices = [(f, [float(k + j) for j in range(39)], [0.3 * k * j for j in range(39)]) for k, f in enumerate("ab")]
    return t.withColumns({"phase": phase, "voice": F.col("family")}).cache(), spark.createDataFrame(voices, "voice string, mag array<double>, ang array<double>")


@pytest.mark.parametrize("held", [1, 500_000])
def test_windows_sequences_and_edges_equal_those_of_rows(spark, monkeypatch, held):
    monkeypatch.setattr(mixes, "HELD", held)
    n, w, names = 125, 10, ["a", "b", "c", "never"]
    t, voices = taken(spark, n)
    parts = scenarios.played(t, n, 6).cache()
    of = lambda parts: scenario_windows(scenarios.points(parts, voices), parts, names, w)
    truth = [c for f in names for c in (f, f"power of {f}")]
    want, got = keyed(of(parts), "scenario", "win"), keyed(mixes.window_features(t, voices, names, n, w), "scenario", "win")
    assert got.keys() == want.keys() and len(got) == 48
    for k, r in want.items():
        for c in [*FEATURES, *truth]:
            assert got[k][c] == pytest.approx(r[c], abs=1e-6), (k, c)
    alone = keyed(mixes.window_features(t, voices, names, n, w, alone=True), "scenario", "family", "win")
    single = keyed(of(parts.withColumn("scenario", F.concat_ws("/", "scenario", "family"))), "scenario", "win")
    assert len(alone) == len(single) == 72
    for (s, f, win), r in alone.items():
        for c in FEATURES:
            assert r[c] == pytest.approx(single[f"{s}/{f}", win][c], abs=1e-6), (s, f, win, c)
    want, got = keyed(scenarios.sequence_windows(parts, names, w), "scenario", "win"), keyed(mixes.sequence_windows(t, names, n, w), "scenario", "win")
    assert got.keys() == want.keys()
    for k, r in want.items():
        assert got[k]["sequence"] == pytest.approx(r["sequence"]) and [got[k][c] for c in truth] == pytest.approx([r[c] for c in truth])
    want, got = keyed(explore.device_edges(parts, 5), "scenario", "at"), keyed(mixes.device_edges(t, n, 5), "scenario", "at")
    assert got.keys() == want.keys() and len(got) > 10
    for k, r in want.items():
        for c in r.asDict():
            assert got[k][c] == (pytest.approx(r[c], abs=1e-9) if isinstance(r[c], float) else r[c]), (k, c)


def test_unknown_phases_are_an_error(spark):
    t, _ = taken(spark, 20)
    with pytest.raises(Exception, match="unknown phase"):
        mixes.sequence_windows(t.withColumn("phase", F.lit(7)), ["a"], 20, 10).collect()


def test_models_never_make_a_row_of_each_sample(spark, monkeypatch):
    """Windows and edges of the queries come of takes, a scenario's devices as one row, and a split moves no row."""
    monkeypatch.setattr(scenarios, "played", lambda *a: pytest.fail("rows of samples"))
    for train, test in (plans._windows(spark, SF), plans._windows(spark, SF, alone=True), plans._sequence_windows(spark, SF)):
        assert train.count() > test.count() > 0
        for df in (train, test):
            assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert catalog.QUERIES["k16_two_stage"](spark, SF).count() > 0


def test_query_windows_equal_those_of_rows(spark):
    n, names = events.SAMPLES, plans._names(spark, SF)
    t = events.scenario_takes(spark, SF).cache()
    parts, spectra = scenarios.played(t, n, t.count()), events.voices(spark, SF)
    want = keyed(scenario_windows(scenarios.points(parts, spectra), parts, names, 10), "scenario", "win")
    got = keyed(mixes.window_features(t, spectra, names, n, 10), "scenario", "win")
    assert got.keys() == want.keys() and len(got) > 1000
    for k, r in want.items():
        assert [got[k][c] for c in FEATURES] == pytest.approx([r[c] for c in FEATURES], abs=1e-6)


def test_models_take_the_rounds_and_weights_of_their_method(spark, monkeypatch):
    """The reference's rounds of boosting, however few trees a forest has; the linear machine weights its classes and runs until it converges."""
    from gridlens.operators import models

    seen = []

    class Stages:
        def __init__(self, stages):
            seen.append(stages[-1])

        def fit(self, df):
            return None

    monkeypatch.setattr(models, "Pipeline", Stages)
    df = spark.createDataFrame([(1.0, "a"), (2.0, "b")], "x double, family string")
    for kind, rounds in (("boosted", 400), ("svm", 100)):
        models.identify(df, ["x"], trees=10, kind=kind)
        assert (seen[-1].getWeightCol(), seen[-1].getClassifier().getMaxIter()) == ("weight", rounds)
    assert inspect.signature(models.Families.fit).parameters["rounds"].default == 300
    for query in (plans.g5_identify, plans._power):
        assert "rounds" not in inspect.getsource(query).split('"""')[-1]


def test_claims_make_no_group_of_each_recording(spark):
    """Recordings are rows of arrays, many to a batch; none is a frame of its own."""
    for name in ("j5_j6_j7_claims", "j7_claims_5hz", "j8_rebuilt_claims"):
        plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "FlatMapGroups" not in plan and "ArrowEvalPython" in plan, name


def test_energies_are_of_chords(spark):
    """No stored sample adds up a spectrum: its energies come with its chord."""
    t, voices = taken(spark, 50)
    plan = scenarios.points(scenarios.played(t, 50, 6), voices, spectra=False)._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" in plan and "aggregate(" not in plan.split("Join ")[0]
