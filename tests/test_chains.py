"""Matching of events, written scenarios, kept models, replay and results, against brute force and hand-made rows."""

from datetime import datetime, timedelta
from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridlens.operators import clean, explore, scenarios, score
from gridlens.operators.models import Families
from gridlens.operators.registry import ModelRegistry
from gridlens.sources import ingest
from gridlens.streaming import live


def most_pairs(found, true, within):
    """Size of a largest matching, by trying all."""
    near = [(f, t) for f in found for t in true if abs(f - t) <= within]
    for n in range(min(len(found), len(true)), 0, -1):
        if any(len({f for f, _ in c}) == n and len({t for _, t in c}) == n for c in combinations(near, n)):
            return n
    return 0


@settings(max_examples=80, deadline=None)
@given(st.sets(st.integers(0, 14), max_size=4), st.sets(st.integers(0, 14), max_size=4), st.integers(0, 3))
def test_matching_is_one_to_one_and_largest(found, true, within):
    pairs = explore.matched_times(sorted([(t, False) for t in found] + [(t, True) for t in true]), within)
    assert all(f in found and t in true and abs(f - t) <= within for f, t in pairs)
    assert len({f for f, _ in pairs}) == len({t for _, t in pairs}) == len(pairs) == most_pairs(found, true, within)


def test_event_scores_over_recordings(spark):
    found = spark.createDataFrame([(1, 10), (1, 11), (1, 50), (2, 5), (2, 5)], "rid long, at long")
    true = spark.createDataFrame([(1, 11), (1, 12), (2, 9), (3, None)], "rid long, at long")
    r = explore.event_scores(found, true, 1).first()
    assert (r["tp"], r["n_found"]) == (2, 4) and r["timing"] == 1.0
    assert explore.event_scores(found.limit(0), true.limit(0), 1).first()["tp"] == 0


def test_pairs_of_a_device_ignore_others(spark):
    e = spark.createDataFrame([(1, "a", 1, 50.0), (1, "b", 2, 60.0), (1, "a", 3, -50.0), (1, "b", 9, -60.0), (1, "a", 11, 50.0)], "rid long, device string, at long, dp double")
    assert {(r["device"], r["start"], r["end"]) for r in explore.paired_edges(e, ["rid", "device"]).collect()} == {("a", 1, 3), ("b", 2, 9)}
    assert {(r["start"], r["end"]) for r in explore.paired_edges(e).collect()} == {(2, 3)}


def test_context_of_events(spark):
    at = datetime(2026, 1, 5, 23, 59, 58)  # a Monday
    df = spark.createDataFrame([(1, i, at + timedelta(seconds=i)) for i in range(9)], "rid long, i long, ts timestamp")
    e = spark.createDataFrame([(1, 1, 50.0), (1, 5, -50.0), (1, 8, 50.0)], "rid long, at long, dp double")
    rows = explore.event_context(e, df).orderBy("at").collect()
    assert [(r["hour"], r["day"], r["since_s"], r["on_s"]) for r in rows] == [(23, 1, None, 4.0), (0, 2, 4.0, None), (0, 2, 3.0, None)]


@pytest.mark.parametrize("kind", ["kmeans", "bisecting", "gmm"])
def test_clusters_of_apart_groups(spark, kind):
    df = spark.range(90).select("id", (F.col("id") % 3).alias("g"), ((F.col("id") % 3) * 100 + F.rand(1)).alias("x"), ((F.col("id") % 3 - 1) * 50 + F.rand(2)).alias("y"))
    rows, silhouette = explore.clustered(df, ["x", "y"], 3, kind)
    s = explore.contingency_scores(rows, "g", "cluster").first()
    assert rows.count() == 90 and s["homogeneity"] > (0.99 if kind != "gmm" else 0.5) and silhouette > 0.5


def test_read_failures(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([None, 1.0, None, None, 2.0, None])], "rid long, i long, p double")
    rows = clean.read_failures(df).orderBy("i").collect()
    assert [(r["failures"], r["in_a_row"]) for r in rows] == [(1, 1), (1, 0), (2, 1), (3, 2), (3, 0), (4, 1)]


def parts(spark, n=20):
    """Two devices: one on phase 1 for the first half of the time, one on all phases throughout."""
    base = spark.range(n).select(F.lit(4).cast("long").alias("scenario"), F.col("id").cast("int").alias("sample"))
    spectrum = F.array(*[F.lit(0.2 if k == 0 else 0.0) for k in range(39)])
    row = lambda f, p, phase: base.select("scenario", F.lit(f).alias("family"), "sample", F.lit(p).alias("p"), F.lit(0.0).alias("q"), F.lit(phase).alias("phase"), spectrum.alias("mag"), F.array_repeat(F.lit(0.0), 39).alias("ang"))
    blocks = spark.createDataFrame([(4, "kettle", 0, n // 2, True), (4, "kettle", n // 2, n, False), (4, "pump", 0, n, True)], "scenario long, family string, start int, end int, on boolean")
    return scenarios.masked(row("kettle", 2300.0, 1).union(row("pump", 690.0, 0)), blocks, bucket=4)


def test_scenarios_are_written_whole(spark, tmp_path):
    p = parts(spark)
    assert p.count() == 40 and p.where("state = 'off'").count() == 10
    scenarios.write_scenarios(p, str(tmp_path), 2.0, seed=9)
    t = scenarios.read_scenarios(spark, str(tmp_path))
    assert clean.conservation_error(t["readings"].withColumnRenamed("p_total", "p"), t["contributions"]).first()["error"] < 1e-9
    on, off = (t["readings"].where(f"sample = {k}").first() for k in (0, 15))
    assert on["p1"] == pytest.approx(2530) and off["p1"] == pytest.approx(230)
    # A fundamental of 11 A with 0.2 A and a third of 0.2 A; the pump alone 1 A with a third.
    assert on["thd1"] == pytest.approx(100 * (0.2 + 0.2 / 3) / 11) and off["thd1"] == pytest.approx(100 * 0.2 / 3)
    m = t["manifest"].first()
    assert (m["families"], m["n_samples"], m["duration_s"], m["p_peak"]) == ("kettle,pump", 20, 10.0, 2990.0)
    assert t["recordings"].first()["n_appliances"] == 2


def test_masking_a_block_longer_than_many_buckets(spark):
    p = parts(spark, 200)
    assert p.count() == 400 and p.where("family = 'kettle' and state = 'on'").agg(F.max("sample")).first()[0] == 99


def test_registry_falls_back_to_a_pair(spark, tmp_path):
    one = lambda v: Families({"a": v, "b": 0.0})
    df = spark.createDataFrame([(1, 2.0)], "id long, x double")
    r = ModelRegistry(spark, str(tmp_path))
    assert r.mix() is None
    r.save("presence", {"presence": one(1.0)}, ["x"], ["a", "b"], {})
    assert r.mix().source == "presence" and "power_a" not in r.mix().predict(df).columns
    r.save("power", {"power": Families({"a": 5.0})}, ["x"], ["a"], {})
    assert r.mix().power is None
    r.save("power", {"power": one(7.0)}, ["x"], ["a", "b"], {})
    assert r.mix().source == "presence + power" and r.mix().predict(df).first()["gated_a"] == 7.0
    r.save("mix", {"presence": one(0.0), "power": one(9.0)}, ["x"], ["a", "b"], {}, "original")
    assert r.mix().source == "mix" and r.mix().predict(df).first()["gated_a"] == 0.0
    r.save("mix", {"presence": one(1.0), "power": one(3.0)}, ["x"], ["a", "b"], {})
    assert r.mix().predict(df).first()["gated_a"] == 3.0 and r.mix("original").predict(df).first()["power_a"] == 9.0


def test_replay_loops_and_runs_at_a_speed(spark, tmp_path):
    df = spark.createDataFrame([(1, datetime(2026, 1, 1) + timedelta(seconds=i), float(i)) for i in range(10)], "rid long, ts timestamp, p double")
    twice = live.looped(df, 2)
    assert [t.second for (t,) in twice.where("round = 1").select("ts").orderBy("ts").collect()] == list(range(10, 20))
    folder = live.paced(df, str(tmp_path / "in"), batch_s=1.0, speed=5.0)
    assert spark.read.parquet(folder).select("_part").distinct().count() == 2 and spark.read.parquet(folder).count() == 10
    assert live.looped(df.limit(0), 3).count() == 0


def test_states_follow_probabilities_and_never_exceed_the_total(spark):
    rows = [(1, k, 100.0, p, 80.0, 0.9, 60.0) for k, p in enumerate([0.1, 0.9, 0.9, 0.9, 0.5, 0.1, 0.1])]
    s = live.device_states(spark.createDataFrame(rows, "rid long, start long, p_mean double, presence_a double, power_a double, presence_b double, power_b double"), ["a", "b"])
    a = {r["start"]: r for r in s.where("device = 'a'").collect()}
    assert [a[k]["state"] for k in range(7)] == [0, 0, 1, 1, 1, 1, 0]
    assert a[2]["watts"] == pytest.approx(100 * 80 / 140) and a[2]["explained"] == 1.0
    assert a[6]["residual"] == pytest.approx(40)


def test_result_files(spark, tmp_path):
    rows = [(1, 0, "a", 1, 0.9, 60.0, 100.0), (1, 0, "b", 0, 0.2, 0.0, 100.0), (1, 1, "a", 0, 0.4, 0.0, 50.0), (1, 1, "b", 1, 0.7, 50.0, 50.0)]
    w = spark.createDataFrame(rows, "rid long, win long, family string, on int, prob double, watts double, total double")
    by, whole = score.mix_summary(w, 3600.0)
    assert {(r["family"], r["fraction_on"], r["energy_kwh"]) for r in by.collect()} == {("a", 0.5, 0.06), ("b", 0.5, 0.05)}
    r = whole.first()
    assert r["confidence"] == pytest.approx(0.75) and r["explained"] == pytest.approx(1 - 40 / 150) and r["residual_w"] == 20.0
    ingest.write_results(w, by, whole, str(tmp_path))
    assert spark.read.option("header", True).csv(str(tmp_path / "predictions")).count() == 4
    assert len(spark.read.json(str(tmp_path / "summary")).first()["families"]) == 2


def test_result_folders_lie_in_slices(spark, tmp_path):
    w = spark.range(200).selectExpr("id AS rid", "0L AS win", "'a' AS family", "1 AS on", "0.9 AS prob", "1.0D AS watts", "1.0D AS total")
    ingest.write_results(w, *score.mix_summary(w, 10.0), str(tmp_path))
    slices = [p for p in (tmp_path / "predictions").iterdir() if p.is_dir()]
    assert 1 < len(slices) <= ingest.SLICES and sum(len(list(p.glob("rid=*"))) for p in slices) == 200


def test_results_round_half_up_on_the_decimal(spark, tmp_path):
    """A mean gap of 39.70875 W, which sums of doubles put just below."""
    from compare import assert_same, connect
    from gridlens.plans import catalog

    folder = "/root/testdata/sf0.1"
    spark.read.parquet(f"{folder}/events.parquet").where("user_id = 5").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = connect("/root/testdata/sf0.001")
    con.execute(f"CREATE OR REPLACE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got = catalog.QUERIES["a12_results"](spark, str(tmp_path))
    assert {r["residual_w"] for r in got.collect()} == {39.7088}
    assert_same(got, con, catalog.SQL["a12_results"])


def test_spectra_by_name_equal_spectra_by_row(spark, tmp_path):
    """A spectrum is added up once for each set of devices, and no stored row carries one."""
    p = parts(spark)
    voices = p.where("state = 'on'").groupBy(F.col("family").alias("voice")).agg(F.first("mag").alias("mag"), F.first("ang").alias("ang"))
    named = p.select("scenario", "family", "sample", "p", "q", "phase", F.col("family").alias("voice"), (F.col("state") == "on").alias("lit"), "state")
    plain = lambda df: [[r[c] for c in ("sample", "h1", "a1", "h2", "thd1", "thd3", "i_n", "p_total")] for r in df.orderBy("sample").collect()]
    want, got = plain(scenarios.points(p)), plain(scenarios.points(named, voices))
    assert len(want) == len(got) == 20
    for a, b in zip(want, got, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == pytest.approx(y)
    scenarios.write_scenarios(named, str(tmp_path), 2.0, voices=voices)
    stored = spark.read.parquet(str(tmp_path / "readings"))
    assert "h1" not in stored.columns and spark.read.parquet(str(tmp_path / "chords")).count() == 2
    assert plain(scenarios.read_scenarios(spark, str(tmp_path))["readings"]) == got


def test_no_planned_row_carries_its_pool(spark):
    """Recordings in turn by an equi-join: the joined rows hold one recording, not all of the family."""
    planned = spark.range(7).selectExpr("id AS scenario", "'a' AS family")
    recordings = spark.range(3).selectExpr("id AS rid", "'a' AS family")
    chosen = scenarios.choose(planned, scenarios.pool(recordings), 7)
    assert sorted(r["count"] for r in chosen.groupBy("rid").count().collect()) == [2, 2, 3]
    assert "recordings" not in chosen._jdf.queryExecution().optimizedPlan().toString().splitlines()[0]


def test_stored_scenarios_share_files(spark, tmp_path):
    """Files are as many as tasks and folders, however many scenarios there are, and a scenario's rows lie in one of them."""
    p = parts(spark).drop("scenario").crossJoin(spark.range(300).select(F.col("id").alias("scenario")))
    scenarios.write_scenarios(p, str(tmp_path), 2.0)
    t = scenarios.read_scenarios(spark, str(tmp_path))
    for name, rows in (("contributions", 12_000), ("readings", 6_000)):
        assert t[name].count() == rows
        files = list((tmp_path / name).rglob("part-*.parquet"))
        assert len(files) <= 64 * 8 and all("scenario=" not in str(f) for f in files)
    stored = spark.read.parquet(str(tmp_path / "readings")).select("scenario", F.input_file_name().alias("f")).groupBy("scenario").agg(F.countDistinct("f").alias("n"))
    assert {r["n"] for r in stored.collect()} == {1} and t["manifest"].count() == 300
    assert len(list((tmp_path / "readings").rglob("part-*.parquet"))) <= 64
