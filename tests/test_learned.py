"""The network, periods and Ward clustering against known truth, direct sums and brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlens.operators import clean, events, explore, network, score


def scenario_rows(seed, n=120, windows=12):
    """Sequences of two devices of known shape: a flat lamp of 100 W and a pump that swings around 300 W."""
    rng, rows = np.random.default_rng(seed), []
    for s in range(n):
        for w in range(windows):
            lamp, pump = (int(rng.random() < 0.5) for _ in range(2))
            x = lamp * 100 + pump * (300 + 60 * np.sin(np.arange(10) * 2.1)) + rng.normal(0, 5, 10)
            rows.append((s, w, x.tolist(), lamp, pump, lamp * 100.0, pump * 300.0))
    return rows


def test_the_network_beats_silence_on_every_family(spark):
    df = spark.createDataFrame(scenario_rows(1), "scenario long, win long, sequence array<double>, lamp int, pump int, `power of lamp` double, `power of pump` double")
    train, test = df.where("scenario < 90"), df.where("scenario >= 90")
    odd = spark.createDataFrame([(1, 99, None, 1, 0, 1.0, 0.0), (1, 98, [0.0] * 10, None, 0, 1.0, 0.0)], df.schema)
    fitted = network.fit(train.union(odd), ["lamp", "pump"], "scenario", steps=80)
    assert len(fitted.losses) <= 80 and min(b for _, b in fitted.losses) < fitted.losses[0][1] / 3
    scored = fitted.predict(test)
    for f, watts in (("lamp", 100.0), ("pump", 300.0)):
        r = scored.agg(F.avg(F.abs(F.col(f"power_{f}") - F.col(f"power of {f}"))).alias("mae"), F.avg(((F.col(f"presence_{f}") >= 0.5).cast("int") == F.col(f)).cast("int")).alias("right")).first()
        assert r["mae"] < 0.15 * watts and r["right"] > 0.95
    assert fitted.predict(odd).where("presence_lamp is null").count() == 1
    with pytest.raises(ValueError, match="no rows"):
        network.fit(train.limit(0), ["lamp", "pump"], "scenario")


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    weights = [rng.normal(size=s) for s in ((4, 3), (3,), (3, 4), (4,))]
    x, on, power = rng.normal(size=(6, 4)), rng.integers(0, 2, (6, 2)).astype(float), rng.normal(size=(6, 2))
    g, _ = network.gradient(weights, x, on, power)
    flat = np.concatenate([w.ravel() for w in weights])
    for k in range(0, len(flat), 3):
        up, down = (network.gradient(network._unflat(flat + e * (np.arange(len(flat)) == k), weights), x, on, power)[1] for e in (1e-6, -1e-6))
        assert abs((up - down) / 2e-6 - g[k]) < 1e-4


def test_early_stopping_keeps_the_best_weights(spark):
    rng = np.random.default_rng(3)  # nothing to learn: more steps only fit the noise
    rows = [(s, 0, rng.normal(size=10).tolist(), int(rng.random() < 0.5), 0, 0.0, 0.0) for s in range(80)]
    df = spark.createDataFrame(rows, "scenario long, win long, sequence array<double>, lamp int, pump int, `power of lamp` double, `power of pump` double")
    fitted = network.fit(df, ["lamp"], "scenario", steps=100, rate=0.1, patience=4)
    assert len(fitted.losses) < 100


def test_planted_periods_are_found(spark):
    rows = []
    for rid, period in ((1, 7), (2, 24), (3, 40)):
        x = 50 + 20 * (np.arange(500) % period < period / 3) + np.random.default_rng(rid).normal(0, 1, 500)
        rows += [(rid, i, float(v)) for i, v in enumerate(x)]
    rows += [(4, i, 5.0) for i in range(300)] + [(5, 0, None), (6, 0, 1.0)]
    df = spark.createDataFrame(rows, "rid long, i long, p double")
    got = {r["rid"]: r for r in explore.periods(df, 128).collect()}
    assert all(got[rid]["period"] % period == 0 and got[rid]["strength"] > 0.3 for rid, period in ((1, 7), (2, 24), (3, 40))) and got[3]["period"] == 40
    assert all(got[rid]["period"] is None for rid in (4, 5, 6))
    assert explore.periods(df.limit(0), 128).count() == 0


def test_ward_merging_of_small_clusters_agrees_with_that_of_rows(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([c + rng.normal(0, 0.4, (125, 2)) for c in ((0, 0), (6, 0), (0, 6), (7, 7))])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)] + [(900, None, 1.0)], "i long, a double, b double")
    got = explore.agglomerated(df, ["a", "b"], 4, micro=40)
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    direct = explore.ward_merges(z, np.ones(len(z)), 4)
    both = spark.createDataFrame([(i, int(c)) for i, c in enumerate(direct)], "i long, direct int").join(got, "i")
    assert both.count() == 500 and explore.contingency_scores(both, "direct", "cluster").first()["ari"] > 0.99


def test_nearest_signatures_equal_a_loop(spark):
    rng = np.random.default_rng(7)
    known = [(k, f"f{k % 9}", float(p), float(q)) for k, (p, q) in enumerate(np.concatenate([rng.uniform(-50, 50, (300, 2)), rng.uniform(-3000, 3000, (300, 2))]))]
    found = [(1, i, float(p), float(q)) for i, (p, q) in enumerate(np.concatenate([rng.uniform(-60, 60, (200, 2)), rng.uniform(-3500, 3500, (300, 2))]))]
    table = spark.createDataFrame([*known, (999, "x", None, 0.0)], "signature long, family string, p_sig double, q_sig double")
    edges = spark.createDataFrame(found, "rid long, i long, dp double, dq double")
    matched = events.match_table(edges, table)
    got = {r["i"]: (r["family"], r["confidence"]) for r in matched.collect()}
    for _, i, dp, dq in found:
        s = -1 if dp < 0 else 1
        d, family, _ = min((np.hypot(s * dp - p, s * dq - q) / max(20.0, 0.35 * np.hypot(p, q)), f, k) for k, f, p, q in known)
        good = abs(dp) >= 8 and d < 1 and round(1 - d, 2) >= 0.25
        assert got[i] == ((family, pytest.approx(round(1 - d, 2), abs=0.011)) if good else (None, None))
    plan = matched._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert {r["family"] for r in events.match_table(edges, table.limit(0)).collect()} == {None}


def test_an_edge_meets_few_of_many_signatures(spark):
    """Signatures that crowd in one place: an edge meets a few leaves of them, and still its nearest, first by family on ties."""
    rng = np.random.default_rng(8)
    spots = np.concatenate([rng.normal(35, 4, (4000, 2)), np.repeat(rng.normal(35, 1e-3, (50, 2)), 20, axis=0)])
    known = [(k, f"f{k % 7}", float(p), float(q)) for k, (p, q) in enumerate(spots)]
    found = [(1, i, float(p), float(q)) for i, (p, q) in enumerate(np.concatenate([rng.normal(35, 5, (300, 2)), rng.uniform(20, 60, (100, 2)), spots[-100::20]]))]
    table, edges = spark.createDataFrame(known, "signature long, family string, p_sig double, q_sig double"), spark.createDataFrame(found, "rid long, i long, dp double, dq double")
    assert events.met_signatures(edges, table).count() < 60 * len(found)
    got = {r["i"]: r["family"] for r in events.match_table(edges, table).collect()}
    for _, i, dp, dq in found:
        d = np.round(np.hypot(dp - spots[:, 0], dq - spots[:, 1]) / np.maximum(20.0, 0.35 * np.hypot(*spots.T)), 9)
        assert got[i] == (min(f"f{k % 7}" for k in np.flatnonzero(d == d.min())) if d.min() <= 0.75 else None)


def test_edges_are_named_after_the_device_that_rose_most(spark):
    rows = []
    for k in range(40):
        rows += [("lamp", 1, 100.0 * (k >= 10), 0.0), ("pump", 2, 300.0 * (k >= 20) + 200.0 * (k == 20), 50.0 * (k >= 20)), ("oven", 0, 90.0 * (k >= 30), 0.0), ("fan", 3, 20.0 * (k < 30), 0.0)]
    df = spark.createDataFrame([(7, n // 4, *r) for n, r in enumerate(rows)], "scenario long, sample long, family string, phase int, p double, q double")
    got = {r["at"]: r for r in explore.device_edges(df, 5).collect()}
    assert {at: r["family"] for at, r in got.items()} == {10: "lamp", 20: "pump", 30: "oven"}
    assert (got[10]["dp1"], got[10]["dp2"], got[20]["dp2"], got[20]["dq"], got[30]["dp1"], got[30]["dp3"]) == (100.0, 0.0, 500.0, 50.0, 30.0, 10.0)
    assert got[20]["peak"] == 620.0 and got[20]["steady"] == 420.0 and got[20]["rise"] == 0
    assert explore.device_edges(df.limit(0), 5).count() == 0


def test_mixed_labels_have_no_signature(spark):
    rows = [(rid, i, 100.0 + rid, 5.0, label) for rid, label in ((1, "Lamp_high_20260101_120000"), (2, "lamp__fan"), (3, None)) for i in range(30)]
    got = events.pure_signatures(spark.createDataFrame([*rows, *[(4, i, 50.0, 0.0, "fan") for i in range(10)]], "rid long, i long, p double, q double, label string")).collect()
    assert [(r["signature"], r["family"], r["p_sig"]) for r in got] == [(1, "lamp", 101.0)]


@pytest.mark.parametrize("stride", [2, 5, 7])
def test_painting_equals_a_loop(spark, stride):
    length, windows = 5, [(1, k, f"d{k}") for k in range(0, 9) if k % 3 != 1]
    want = {}
    for _, k, d in windows:
        want |= {i: d for i in range(k * stride, min(k * stride + length, 40))}
    samples = spark.createDataFrame([(1, i) for i in range(40)], "rid long, i long")
    got = score.painted(samples, spark.createDataFrame(windows, "rid long, win long, best string"), stride, length)
    assert {r["i"]: r["best"] for r in got.collect()} == want


@pytest.mark.parametrize("size", [7, 64])
def test_chunks_change_nothing(spark, size):
    rng = np.random.default_rng(size)
    rows = []
    for rid in (1, 2):
        level = np.repeat(rng.choice([0.0, 40, 100, 500], 40), 8)
        for i, v in enumerate(level + rng.normal(0, 0.5, len(level))):
            rows.append((rid, i, None if rng.random() < 0.3 or 90 < i < 140 else float(v), float(v), float(v / 10), 1_000_000 * i))
    df = spark.createDataFrame(rows, "rid long, i long, c double, p double, q double, ts_us long")
    good = F.col("i") % 29 == 11
    cases = [
        lambda n: clean.impute_short_gaps(df, "c", max_gap=3, size=n), lambda n: clean.estimated_times(df, good, 900_000, size=n),
        lambda n: events.edges(df, 3, 8, size=n), lambda n: events.device_on(df, F.col("c") / 500, ["rid"], "i", size=n),
    ]
    for case in cases:
        whole, parts = case(100_000), case(size)
        rows_of = lambda d, c=whole.columns: sorted(repr(tuple(r)) for r in d.select(*c).collect())
        assert rows_of(parts) == rows_of(whole) and whole.count() > 5


def test_devices_played_equal_samples_masked(spark):
    """Takes, a row for each device, give the same samples as looping and masking rows; what follows by scenario moves nothing again."""
    from gridlens.operators import scenarios

    samples = spark.createDataFrame([(rid, i, float(10 * rid + i % 7), float(i)) for rid, n in ((1, 7), (2, 150), (3, 60)) for i in range(n)], "rid long, i long, p double, q double")
    chosen = spark.createDataFrame([(0, "a", 1), (0, "b", 2), (1, "a", 3), (1, "c", 2), (2, "c", 1)], "scenario long, family string, rid long")
    blocks = scenarios.schedule(chosen, 120, 1.0, 7)
    taken = scenarios.takes(chosen, samples, blocks, 120)
    got, columns = scenarios.played(taken, 120, 5), ["scenario", "family", "sample", "p", "q", "state"]
    assert taken.count() == 5
    want = scenarios.masked(scenarios.tiled(chosen, samples, 120), blocks)
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
    assert {r["lit"] for r in got.where("p <> 0").collect()} == {True}
    added = explore.device_edges(got.withColumn("phase", F.lit(1)), 5)
    assert sum("Exchange hashpartitioning(scenario" in line for line in added._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].splitlines()) <= 3
    moved = [line for line in added._jdf.queryExecution().sparkPlan().toString().splitlines() if "Join" in line and "SortMergeJoin" in line and "sample" in line]
    assert not moved
    windows = scenarios.sequence_windows(got.withColumn("phase", F.lit(1)), ["a", "b", "c"], 10).collect()
    assert len(windows) == 36 and {len(r["sequence"]) for r in windows} == {30}
    own = {(r["scenario"], r["sample"] // 10, r["family"]): 0.0 for r in want.collect()}
    for r in want.collect():
        own[r["scenario"], r["sample"] // 10, r["family"]] += r["p"] / 10
    for r in windows:
        for f in "abc":
            assert r[f"power of {f}"] == pytest.approx(own.get((r["scenario"], r["win"], f), 0.0)) and r[f] == (abs(r[f"power of {f}"]) > 5)
