"""Operators against hand-made rows, NumPy, and their stated properties."""

import math
from datetime import datetime

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridlens.functions import electrical as E
from gridlens.functions import labels as L
from gridlens.operators import clean, events, explore, features, meterpoint, models, scenarios, score, windows
from gridlens.operators.registry import ModelRegistry
from gridlens.sources import ingest
from gridlens.streaming import live


def series(spark, values, rid=1, q=None):
    rows = [(rid, i, None if v is None else float(v), 0.0 if q is None else float(q[i])) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "rid long, i long, p double, q double")


def column(df, name, order="i"):
    return [r[name] for r in df.orderBy(order).select(name).collect()]


def test_injected_faults(spark):
    """50 single and 5 runs of 3 gaps, one run of 10, an infinity and 3 outliers."""
    v = [50.0] * 1000
    for k in range(50):
        v[10 + 7 * k] = None
    for k in range(5):
        v[500 + 20 * k : 503 + 20 * k] = [None] * 3
    v[700:710] = [None] * 10
    v[800], v[820], v[821], v[822] = math.inf, 999.0, -999.0, 999.0
    r = clean.quality_report(series(spark, v), "p", 0.0, 100.0).first()
    assert (r["n"], r["n_inf"], r["n_filled"], r["n_left"], r["n_clipped"]) == (1000, 1, 50 + 15 + 1, 10, 3)


def test_gap_filling_is_linear_and_stays_inside(spark):
    df = clean.impute_short_gaps(series(spark, [None, 1, None, None, 4, None, None, None, None, None, None, 9, None]), "p")
    assert column(df, "filled") == [None, 1, 2, 3, 4, *[None] * 6, 9, None]


def test_rolling_features_equal_convolution(spark):
    x = np.random.default_rng(1).normal(size=40)
    for n in (4, 5, 25):
        want = np.convolve(x, np.ones(n) / n, mode="same")
        got = column(series(spark, x).withColumn("m", features.rolling_mean(F.col("p"), clean.by_sample(), n)), "m")
        assert np.allclose(got, want)
    d = column(series(spark, x).withColumn("d", features.derivative(F.col("p"), clean.by_sample(), 5.0)), "d")
    assert np.allclose(d, np.gradient(x) * 5)


def test_short_recording_and_shrinking_edge(spark):
    df = series(spark, [1, 2, 3]).withColumns({"a": features.rolling_mean(F.col("p"), clean.by_sample(), 25), "b": features.rolling_mean(F.col("p"), clean.by_sample(), 25, edge="shrink")})
    assert column(df, "a") == [6 / 25] * 3 and column(df, "b") == [2.0] * 3


@pytest.mark.parametrize("size", [7, 16, 100])
def test_chunks_change_nothing(spark, size):
    x = np.random.default_rng(2).normal(size=75)
    df = series(spark, x).withColumns({"p1": F.col("p"), "p2": F.col("p"), "p3": F.col("p")})
    whole = features.add_features(df, rate=1.0, short=3, long=6)
    parts = features.add_features(df, rate=1.0, short=3, long=6, chunk=size)
    for c in ("dp", "p_mean_long", "p_std_short", "p1_mean_short"):
        assert np.allclose(column(whole, c), column(parts, c)), c


def test_missing_samples_spread_through_frames(spark):
    df = series(spark, [1, 2, None, 4, 5, 6]).withColumn("m", features.rolling_mean(F.col("p"), clean.by_sample(), 3))
    assert [x is None for x in column(df, "m")] == [False, True, True, True, False, False]


def test_step_takes_the_first_of_equal_jumps(spark):
    df = windows.tumbling(series(spark, [0, 0, 10, 10, 0, 0, 10, 10]), 8)
    r = windows.step_features(df, 8, least_w=5).first()
    assert (r["dp_step"], r["n_steps"]) == (10.0, 3)
    assert windows.step_features(windows.tumbling(series(spark, [1, 2, 3]), 3), 3).first()["dp_step"] == 0.0


def test_windows_leave_out_the_tail(spark):
    assert sorted({r["win"] for r in windows.sliding(series(spark, range(12)), 5, 3).collect()}) == [0, 1, 2]
    assert windows.sliding(series(spark, range(4)), 5, 3).count() == 0 and windows.tumbling(series(spark, range(12)), 5).count() == 10


def test_neutral_current_is_the_complex_sum(spark):
    rows = np.random.default_rng(3).uniform(0, 20, (20, 3))
    df = spark.createDataFrame(rows.tolist(), "a double, b double, c double")
    a = np.exp(2j * np.pi / 3)
    got = [r[0] for r in df.select(E.neutral_current(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert np.allclose(got, np.abs(rows[:, 0] + a * a * rows[:, 1] + a * rows[:, 2]))


def test_phases_share_and_unknown_is_an_error(spark):
    df = spark.createDataFrame([(1, 9.0, 3.0, 0), (1, 1.0, 1.0, 2)], "k int, p double, q double, phase int")
    r = meterpoint.phase_sums(df, ["k"]).first()
    assert (r["p1"], r["p2"], r["p3"]) == (3.0, 4.0, 3.0)
    with pytest.raises(Exception, match="unknown phase"):
        meterpoint.phase_sums(df.withColumn("phase", F.lit(7)), ["k"]).collect()


def test_harmonics_add_as_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], [0.0, 0.0]), (1, [1.0, 2.0], [math.pi, math.pi / 2])], "k int, mag array<double>, ang array<double>")
    r = meterpoint.harmonic_sums(df, ["k"]).first()
    assert np.allclose(r["mag"], [0, 2 * math.sqrt(2)], atol=1e-12) and np.isclose(r["ang"][1], math.pi / 4)


@pytest.mark.parametrize(
    ("label", "family"),
    [("standing_fan_high_no_rotation", "standing_fan"), ("coffee_machine_run", "coffee_machine"), ("pv_only", "pv"), ("test_water_boiler_on_20260702_142131", "water_boiler"), ("Lamp_level2_3", "lamp"), ("on", "on"), ("on_off", "on"), ("", "appliance"), ("a__b", "a_b"), ("test_on", "on")],
)
def test_family(spark, label, family):
    assert spark.range(1).select(L.family(F.lit(label))).first()[0] == family


def test_label_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    h = 5381
    for c in "table_fan":
        h = (h * 33 + ord(c)) & 0xFFFFFFFF
    assert one(L.djb2(F.lit("table_fan"))) == h and one(L.djb2(F.lit(""))) == 5381
    assert one(L.families(F.lit("pv__water_boiler_on__pv_only"))) == ["pv", "water_boiler"]
    assert one(L.safe_label(F.lit(" Ä b/c "))) == "b_c" and one(L.safe_label(F.lit("??"))) == "appliance"


@settings(max_examples=40, deadline=None)
@given(st.lists(st.floats(0, 100), max_size=30), st.floats(0.1, 20))
def test_accepted_edges_keep_their_distance(times, gap):
    times = sorted(times)
    kept = [t for t, ok in zip(times, events.accept(times, gap), strict=True) if ok]
    assert all(b - a >= gap for a, b in zip(kept, kept[1:])) and (not times or kept[0] == times[0])


def test_claims_follow_their_rules():
    c = events.Claims()
    assert c.edge(0, 100.0, "lamp", 0.9) == "lamp" and c.edge(1, 50.0, "fan", 0.2) is None and c.edge(2, 40.0, "fan", 0.5) == "fan"
    assert c.edge(3, -90.0, None, None) == "lamp" and "lamp" in c.held and c.edge(4, -300.0, None, None) is None
    assert c.guard(20, 0.0) == ["fan"] and c.held == {} and c.on == {}


def test_claims_release_by_relative_fit_and_hold_named_devices():
    c = events.Claims(hold=15)
    c.edge(0, 1000.0, "boiler", 0.9)
    c.edge(1, 100.0, "lamp", 0.4)
    assert c.edge(2, -150.0, None, None) is None and set(c.on) == {"boiler", "lamp"}  # 50 of 100 W, 850 of 1000 W: neither within 35 %
    assert c.edge(3, -80.0, None, None) == "lamp"  # 20 of 100 W
    assert c.edge(4, -700.0, "kettle", 0.8) == "boiler" and "kettle" not in c.held  # another claim explains it
    assert c.edge(5, -60.0, "fan", 0.7) is None and c.held["fan"] == 20  # named, but never claimed
    c.edge(6, 500.0, "oven", 0.5)
    c.edge(7, 600.0, "iron", 0.6)
    assert c.guard(11.9, 900.0) == [] and c.guard(12, 1000.0) == []  # too young; 1100 W is within 10 % of the claims
    assert c.guard(12, 900.0) == ["oven"] and c.held == {"lamp": 18, "boiler": 19, "fan": 20} and c.guard(19, 600.0) == [] and set(c.held) == {"fan"}


def test_long_gaps_cost_one_step_a_row(spark):
    import time

    n = 200_000
    df = spark.range(n).select(F.lit(1).alias("rid"), F.col("id").alias("i"), F.when(F.col("id") % 50_000 > 3, None).otherwise(F.col("id").cast("double")).alias("p"))
    began = time.time()
    assert clean.impute_short_gaps(df, "p").where("gap = 2").count() == n - 16 and time.time() - began < 20


def test_merge_never_exceeds_the_total(spark):
    rows = [(1, "a", 100.0, 60.0, 80.0, False), (1, "b", 100.0, None, 80.0, False), (1, "c", 100.0, None, 50.0, True), (2, "a", 10.0, None, 4.0, False)]
    df = spark.createDataFrame(rows, "t int, f string, total double, claimed double, model double, held boolean")
    got = {(r["t"], r["f"]): r["watts"] for r in events.merge(df, ["t"], "total", "claimed", "model", "held").collect()}
    assert got == {(1, "a"): 60.0, (1, "b"): 40.0, (1, "c"): 0.0, (2, "a"): 4.0}


def test_islands_and_hysteresis(spark):
    df = series(spark, [0, 1, 1, 1, 0, 1, 0, 1, 1, 1])
    assert [(r["start"], r["end"]) for r in events.islands(df, F.col("p") > 0, ["rid"], "i", "i", 2).orderBy("start").collect()] == [(1, 3), (7, 9)]
    df = series(spark, [0.5, 0.6, 0.5, 0.44, 0.5, None, 0.55]).withColumn("s", events.hysteresis(F.col("p"), clean.by_sample()))
    assert column(df, "s") == [0, 1, 1, 0, 0, 0, 1]


def test_as_of(spark):
    left = spark.createDataFrame([(1, 5, "x"), (1, 1, "y"), (2, 9, "z")], "k int, at int, v string")
    right = spark.createDataFrame([(1, 2, 0.2), (1, 5, 0.5), (1, 6, 0.6)], "k int, at int, d double")
    assert {r["v"]: r["e"] for r in events.as_of(left, right, ["k"], "at", "d", "e").collect()} == {"x": 0.5, "y": None, "z": None}


def test_scores(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")], "l string, p string")
    r = score.macro_f1(df, "l", "p").first()
    assert np.isclose(r["macro_f1"], (0.5 + 2 / 3 + 0) / 3) and r["accuracy"] == 0.5
    p = spark.createDataFrame([("a", 1, 1), ("b", 0, 0)], "family string, truth int, pred int")
    assert {r["family"]: r["f1"] for r in score.presence_f1(p).collect()} == {"a": 1.0, "b": None}


def test_cusum_with_reset():
    assert explore.cusum_points([0] * 5 + [100] * 5 + [0] * 5, 250, 5) == [7, 12]
    assert explore.cusum_points([], 1, 0) == []


def test_plans_cover_every_family():
    fams = ["a", "b", "c", "d", "e"]
    got = scenarios.cover({k: ["a", "b"] for k in range(8)}, fams, 3)
    assert all(len(v) == len(set(v)) and 2 <= len(v) <= 3 for v in got.values())
    assert all(sum(f in v for v in got.values()) >= 4 for f in fams[2:4])


def test_schedules_tile_the_time(spark):
    chosen = spark.createDataFrame([(s, f) for s in range(6) for f in "ab"], "scenario long, family string")
    for _, g in scenarios.schedule(chosen, 300, 1.0, 3).toPandas().groupby(["scenario", "family"]):
        g = g.sort_values("start")
        assert g.start.iloc[0] == 0 and g.on.any() and g["end"].max() >= 300


def test_mixing_conserves_power(spark):
    chosen = spark.createDataFrame([(0, "a", 1), (0, "b", 2)], "scenario long, family string, rid long")
    samples = series(spark, range(1, 30), rid=1).union(series(spark, range(5, 45), rid=2))
    m = scenarios.masked(scenarios.tiled(chosen, samples, 200).select("scenario", "family", "sample", "p", "q"), scenarios.schedule(chosen, 200, 1.0, 3))
    assert m.count() == 400 and set(column(m.where("p = 0"), "state", "sample")) == {"off"}
    totals = m.groupBy("scenario", "sample").agg(F.sum("p").alias("p"))
    assert clean.conservation_error(totals, m).first()["error"] < 1e-5


def test_splits_keep_groups_whole(spark):
    df = spark.range(100).select((F.col("id") % 10).alias("g"), "id", F.when(F.col("id") < 20, "x").otherwise("y").alias("l"))
    train, test = models.grouped_split(df, "g", 0.3, 1)
    a, b = {r["g"] for r in train.collect()}, {r["g"] for r in test.collect()}
    assert not a & b and len(a | b) == 10 and a and b
    assert models.grouped_split(df.where("g < 2"), "g", 0.9, 1)[0].count() == 10
    train, test = models.stratified_split(df, "l", ["id"], 0.25, 1)
    assert 0 < test.where("l = 'x'").count() < 20 and train.count() + test.count() == 100
    assert models.stratified_split(df.where("id < 3"), "l", ["id"], 0.25, 1)[1].count() == 1


def test_models_learn_and_are_kept(spark, tmp_path):
    rng = np.random.default_rng(4)
    x = rng.uniform(0, 100, (300, 2))
    rows = [(int(i), float(a), float(b), "hot" if a > 50 else "cold", int(a > 50), 0, float(a)) for i, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, a double, b double, family string, on int, never int, power double")
    m = models.identify(df, ["a", "b"], trees=10)
    r = score.macro_f1(models.best_two(m.transform(df), models.families_of(m), F.lit(True)), "family", "best").first()
    assert r["macro_f1"] > 0.95
    assert models.importance(m, ["a", "b"])[0][0] == "a"
    registry = ModelRegistry(spark, str(tmp_path))
    assert registry.find("identify") is None
    registry.save("identify", m, ["a", "b"], ["cold", "hot"], {"f1": 1.0}, "original")
    assert registry.find("identify")["variant"] == "original"
    registry.save("identify", m, ["a", "b"], ["cold", "hot"], {"f1": 0.9})
    assert registry.apply("identify", df).count() == 300
    with pytest.raises(ValueError, match="frozen"):
        registry.save("identify", m, ["a", "b"], [], {}, "original")
    out = models.Families.fit(df, ["a", "b"], ["on", "never"], "presence", trees=5).predict(df, "presence")
    assert out.agg(F.max("presence_never")).first()[0] == 0.0 and out.where("(presence_on > 0.5) <> (on = 1)").count() < 15


def test_meter_files(spark, tmp_path):
    head = "timestamp_iso;device_name;" + ";".join(ingest.CSV_CHANNELS)
    blank = ";".join(["1.0"] * 4)
    (tmp_path / "sub").mkdir()
    for name in ("a.csv", "sub/b.csv"):
        (tmp_path / name).write_text(f"{head}\n2026-01-01T00:00:00;lamp;{blank};10.0;{';'.join(['1.0'] * 3)};NaN;{';'.join(['1.0'] * 4)}\n2026-01-01T00:00:01;;{blank};20.0;{';'.join(['1.0'] * 8)}\n")
    files = ingest.expand(spark, [str(tmp_path), str(tmp_path / "*.csv")])
    assert len(files) == 2 and files == sorted(files)
    got = ingest.read_meter_csv(spark, files).orderBy("recording", "i").collect()
    assert [r["seconds"] for r in got] == [0.0, 1.0] * 2 and {r["label"] for r in got} == {"lamp"} and got[0]["pf_total"] is None and got[1]["pf_total"] == 1.0


def test_quarantine_and_partition_overwrite(spark, tmp_path):
    df = series(spark, [1, 2, 3]).union(series(spark, [5], rid=2)).withColumn("ts_us", F.col("i") * 200_000)
    good, bad = ingest.quarantine(df, clean.validate(df))
    assert {r["rid"] for r in good.collect()} == {1} and {r["rid"] for r in bad.collect()} == {2}
    with pytest.raises(ValueError, match="invalid"):
        ingest.quarantine(df, clean.validate(df), strict=True)
    path = str(tmp_path / "out")
    ingest.write_by_recording(df, path)
    ingest.write_by_recording(good.withColumn("p", F.lit(9.0)), path)
    assert {(r["rid"], r["p"]) for r in spark.read.parquet(path).select("rid", "p").collect()} == {(1, 9.0), (2, 5.0)}
