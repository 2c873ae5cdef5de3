"""Queries of per-sample and window features."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlens.functions.electrical import finite
from gridlens.operators import features as D
from gridlens.operators import windows as E
from gridlens.operators.clean import by_sample
from gridlens.plans.fixtures import contributions, dirty, phases, readings, spectra
from gridlens.plans.registry import query

SHORT, LONG, W, STEP = 4, 9, 10, 5
_W = "WINDOW w AS (PARTITION BY rid ORDER BY i)"


def _frame(n: int, name: str) -> str:
    return f"{name} AS (PARTITION BY rid ORDER BY i ROWS BETWEEN {n // 2} PRECEDING AND {n - n // 2 - 1} FOLLOWING)"


@query(f"""SELECT rid, i, round(5 * CASE WHEN lag(i) OVER w IS NULL THEN lead(p) OVER w - p WHEN lead(i) OVER w IS NULL THEN p - lag(p) OVER w ELSE (lead(p) OVER w - lag(p) OVER w) / 2 END, 6) AS dp FROM readings {_W}""")
def d1_derivative(spark, sf):
    return readings(spark, sf).select("rid", "i", F.round(D.derivative(F.col("p"), by_sample(), 5.0), 6).alias("dp"))


@query(f"""SELECT rid, i, round(abs(5 * CASE WHEN lag(i) OVER w IS NULL THEN lead(p) OVER w - p WHEN lead(i) OVER w IS NULL THEN p - lag(p) OVER w ELSE (lead(p) OVER w - lag(p) OVER w) / 2 END), 6) AS abs_dp FROM readings {_W}""")
def d2_abs_derivative(spark, sf):
    return readings(spark, sf).select("rid", "i", F.round(F.abs(D.derivative(F.col("p"), by_sample(), 5.0)), 6).alias("abs_dp"))


@query(f"SELECT rid, i, round(CASE WHEN count(c) OVER a = count(*) OVER a THEN sum(c) OVER a / {SHORT} END, 5) AS short, round(CASE WHEN count(c) OVER b = count(*) OVER b THEN sum(c) OVER b / {LONG} END, 5) AS long FROM gappy WINDOW {_frame(SHORT, 'a')}, {_frame(LONG, 'b')}")
def d3_rolling_mean(spark, sf):
    d = dirty(spark, sf).withColumn("c", finite(F.col("v")))
    return d.select("rid", "i", F.round(D.rolling_mean(F.col("c"), by_sample(), SHORT), 5).alias("short"), F.round(D.rolling_mean(F.col("c"), by_sample(), LONG), 5).alias("long"))


@query(f"SELECT rid, i, round(CASE WHEN count(c) OVER a = count(*) OVER a THEN sqrt(greatest(sum(c * c) OVER a / {SHORT} - (sum(c) OVER a / {SHORT}) * (sum(c) OVER a / {SHORT}), 0)) END, 3) AS std FROM gappy WINDOW {_frame(SHORT, 'a')}")
def d4_rolling_std(spark, sf):
    d = dirty(spark, sf).withColumn("c", finite(F.col("v")))
    return d.select("rid", "i", F.round(D.rolling_std(F.col("c"), by_sample(), SHORT), 3).alias("std"))


@query(f"SELECT rid, i, round(sum(p1) OVER a / {SHORT}, 5) AS p1, round(sum(p2) OVER a / {SHORT}, 5) AS p2, round(sum(p3) OVER a / {SHORT}, 5) AS p3 FROM phases WINDOW {_frame(SHORT, 'a')}")
def d5_phase_means(spark, sf):
    r = D.add_features(phases(spark, sf), rate=1.0, short=SHORT, long=LONG, events=False)
    return r.select("rid", "i", *[F.round(f"p{k}_mean_short", 5).alias(f"p{k}") for k in (1, 2, 3)])


@query(f"SELECT rid, i, round(sum((p1 + p2) / 2) OVER a / {SHORT}, 5) AS thd FROM phases WINDOW {_frame(SHORT, 'a')}")
def d6_distortion(spark, sf):
    r = phases(spark, sf).withColumns({"thd_i1": F.col("p1"), "thd_i2": F.col("p2"), "thd_i3": F.lit(None).cast("double")})
    r = D.add_features(r, rate=1.0, short=SHORT, long=LONG, events=False, imbalances=False)
    return r.select("rid", "i", F.round("thd_i_mean", 5).alias("thd"))


@query(f"SELECT rid, i, round(sum(p) OVER a / {SHORT}, 5) AS short, round(sum(p) OVER b / {LONG}, 5) AS long FROM readings WINDOW {_frame(SHORT, 'a')}, {_frame(LONG, 'b')}")
def d9_chunked_features(spark, sf):
    """The same rolling means computed in chunks of 16 rows with a halo."""
    r = D.add_features(readings(spark, sf), rate=1.0, short=SHORT, long=LONG, imbalances=False, chunk=16)
    return r.select("rid", "i", F.round("p_mean_short", 5).alias("short"), F.round("p_mean_long", 5).alias("long"))


@query("SELECT rid, i, quantile_cont(p, 0.5) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS instant FROM readings")
def d10_instant(spark, sf):
    return readings(spark, sf).select("rid", "i", D.instant(F.col("p"), by_sample(), 5).alias("instant"))


_SLIDE = f"""slide AS (SELECT r.*, win, i - win * {STEP} AS pos FROM (SELECT *, count(*) OVER (PARTITION BY rid) AS n FROM phases) r,
    LATERAL (SELECT unnest(range(greatest(0, ceil((i - {W} + 1) / {STEP}.0))::BIGINT, least(i // {STEP}, (n - {W}) // {STEP}) + 1)) AS win) x WHERE n >= {W})"""
_TUMBLE = f"tumble AS (SELECT *, i // {W} AS win, i % {W} AS pos FROM (SELECT *, count(*) OVER (PARTITION BY rid) AS n FROM phases) WHERE (i // {W} + 1) * {W} <= n)"


def _sliding(spark, sf):
    return E.sliding(phases(spark, sf), W, STEP)


@query(f"WITH {_SLIDE} SELECT rid, win, count(*) AS n, min(i) AS first, max(i) AS last FROM slide GROUP BY rid, win")
def e1_sliding(spark, sf):
    return _sliding(spark, sf).groupBy("rid", "win").agg(F.count("*").alias("n"), F.min("i").alias("first"), F.max("i").alias("last"))


@query(f"WITH {_SLIDE} SELECT rid, win, round(median(p) FILTER (pos >= 2 AND pos < 8), 6) AS p_ss, round(median(q) FILTER (pos >= 2 AND pos < 8), 6) AS q_ss FROM slide GROUP BY rid, win")
def e2_steady_state(spark, sf):
    return E.state_features(_sliding(spark, sf), W).select("rid", "win", F.round("p_ss", 6).alias("p_ss"), F.round("q_ss", 6).alias("q_ss"))


@query(f"""WITH {_SLIDE}, s AS (SELECT rid, win, median(p) FILTER (pos >= 2 AND pos < 8) AS p, median(q) FILTER (pos >= 2 AND pos < 8) AS q, stddev_pop(p) AS sd, min(p) AS lo, max(p) AS hi FROM slide GROUP BY rid, win)
    SELECT rid, win, round(sqrt(p * p + q * q), 5) AS s_ss, round(CASE WHEN sqrt(p * p + q * q) > 1e-6 THEN p / sqrt(p * p + q * q) END, 5) AS pf, round(q / (abs(p) + 1e-6), 3) AS qp, round(sd, 4) AS p_std, lo AS p_min, hi AS p_max FROM s""")
def e3_window_spread(spark, sf):
    s = E.state_features(_sliding(spark, sf), W)
    return s.select("rid", "win", F.round("s_ss", 5).alias("s_ss"), F.round("pf", 5).alias("pf"), F.round("qp", 3).alias("qp"), F.round("p_std", 4).alias("p_std"), "p_min", "p_max")


_HARM = """h AS (SELECT label, k + 1 AS n, avg(abs(embedding[k]::DOUBLE)) AS m FROM (SELECT label, embedding, unnest(range(1, 40)) AS k FROM embeddings) GROUP BY ALL),
    hs AS (SELECT label, sum(m) FILTER (n = 3) AS h3, sum(m) FILTER (n = 5) AS h5, sum(m) FILTER (n = 7) AS h7, sqrt(sum(m * m)) AS e, sum(n * m) / (sum(m) + 1e-9) AS c FROM h GROUP BY label)"""


@query(f"WITH {_HARM} SELECT label, round(h3, 6) AS h3, round(h5, 6) AS h5, round(h7, 6) AS h7, round(e, 6) AS h_energy, round(c, 6) AS h_centroid FROM hs")
def e4_harmonics(spark, sf):
    h = E.harmonic_features(spectra(spark, sf), ["label"])
    return h.select("label", *[F.round(c, 6).alias(c) for c in ("h3", "h5", "h7", "h_energy", "h_centroid")])


@query(f"WITH {_HARM} SELECT label, round(coalesce(CASE WHEN label % 3 = 0 THEN 7.5 END, 100 * e / (sqrt(100.0 * label * 100.0 * label) / 230 + 1e-6)), 3) AS thd FROM hs WHERE label > 0")
def e5_window_thd(spark, sf):
    h = E.harmonic_features(spectra(spark, sf), ["label"]).where("label > 0")
    return h.select("label", F.round(E.window_thd(F.when(F.col("label") % 3 == 0, F.lit(7.5)), F.col("h_energy"), 100.0 * F.col("label"), F.lit(0.0)), 3).alias("thd"))


@query(f"WITH {_SLIDE} SELECT rid, win, avg(abs(p)) > 45 AS active FROM slide GROUP BY rid, win")
def e6_active(spark, sf):
    return E.state_features(_sliding(spark, sf), W, on_w=45.0).select("rid", "win", "active")


_AGG = {"p_mean": "avg(p)", "p_std": "stddev_pop(p)", "p_min": "min(p)", "p_max": "max(p)", "q_mean": "avg(q)", "p1_mean": "avg(p1)", "p2_mean": "avg(p2)", "p3_mean": "avg(p3)", "pf_mean": "avg(CASE WHEN i % 4 = 0 THEN q / 100 WHEN sqrt(p * p + q * q) > 1e-6 THEN p / sqrt(p * p + q * q) ELSE 1 END)", "thd_mean": "coalesce(avg(CASE WHEN i % 3 <> 0 THEN p / 10 END), 0)", "hour_mean": "avg(hour)", "q_std": "stddev_pop(q)", "qp": "avg(q) / (abs(avg(p)) + 1e-6)", "s": "sqrt(avg(p) * avg(p) + avg(q) * avg(q))"}


@query(f"WITH {_TUMBLE}, start AS (SELECT rid, min(ts_us) AS t0 FROM phases GROUP BY rid), timed AS (SELECT tumble.*, fmod((ts_us - t0) / 3.6e9, 24) AS hour FROM tumble JOIN start USING (rid)) SELECT rid, win, " + ", ".join(f"round({x}, 4) AS {n}" for n, x in _AGG.items()) + " FROM timed GROUP BY rid, win")
def e7_tumbling_features(spark, sf):
    """All fourteen columns, with a measured power factor on every fourth sample and a distortion that is missing on every third."""
    measured = phases(spark, sf).withColumns({"pf": F.when(F.col("i") % 4 == 0, F.col("q") / 100), "thd": F.when(F.col("i") % 3 != 0, F.col("p") / 10), "hour": E.hours_since_start(F.col("ts_us"))})
    a = E.aggregate_features(E.tumbling(measured, W))
    return a.select("rid", "win", *[F.round(n, 4).alias(n) for n in _AGG])


@query(f"""WITH {_TUMBLE}, d AS (SELECT *, abs(lead(p) OVER (PARTITION BY rid, win ORDER BY pos) - p) AS d FROM tumble), j AS (SELECT rid, win, -(max(struct_pack(d := d, o := -pos)).o) AS j, count(*) FILTER (d > 10) AS steps FROM d WHERE d IS NOT NULL GROUP BY rid, win)
    SELECT rid, win, round(median(p) FILTER (pos > j AND pos <= j + 2) - median(p) FILTER (pos <= j AND pos > j - 2), 6) AS dp_step,
    round(median(q) FILTER (pos > j AND pos <= j + 2) - median(q) FILTER (pos <= j AND pos > j - 2), 6) AS dq_step, max(steps) AS n_steps FROM tumble JOIN j USING (rid, win) GROUP BY rid, win""")
def e8_step_features(spark, sf):
    s = E.step_features(E.tumbling(phases(spark, sf), W), W)
    return s.select("rid", "win", F.round("dp_step", 6).alias("dp_step"), F.round("dq_step", 6).alias("dq_step"), F.col("n_steps").cast("long").alias("n_steps"))


_POWER = """power AS (SELECT scenario, sample, family, coalesce(sum(m), 0) AS power FROM (SELECT DISTINCT scenario, sample FROM contributions) CROSS JOIN (SELECT unnest(range(0, 3)) AS family)
    LEFT JOIN (SELECT scenario, sample, appliance, appliance % 3 AS family, avg(p) AS m FROM contributions GROUP BY ALL) USING (scenario, sample, family) GROUP BY ALL)"""


def _family_power(spark, sf):
    return E.family_power(contributions(spark, sf).withColumn("family", F.col("appliance") % 3), [0, 1, 2], ["scenario", "sample"])


@query(f"WITH {_POWER} SELECT scenario, sample, family, round(power, 6) AS power FROM power")
def e9_family_power(spark, sf):
    return _family_power(spark, sf).select("scenario", "sample", "family", F.round("power", 6).alias("power"))


@query(f"WITH {_POWER} SELECT scenario, sample, family, (abs(power) > 5)::INT AS present FROM power")
def e10_presence(spark, sf):
    return _family_power(spark, sf).select("scenario", "sample", "family", "present")


@query(f"WITH {_TUMBLE} SELECT rid, win, array_to_string(list_concat(list(round(p, 3)::DECIMAL(12, 3) ORDER BY pos), list(round(q, 3)::DECIMAL(12, 3) ORDER BY pos)), ' ') AS sequence FROM tumble GROUP BY rid, win")
def e11_sequences(spark, sf):
    s = E.sequences(E.tumbling(phases(spark, sf), W), ["p", "q"])
    return s.select("rid", "win", F.array_join(F.transform("sequence", lambda x: x.cast("decimal(12,3)").cast("string")), " ").alias("sequence"))


@query("SELECT rid, bool_and(c IS NOT NULL) AS full FROM gappy GROUP BY rid")
def e12_feature_set(spark, sf):
    return E.has_all(dirty(spark, sf).withColumn("c", finite(F.col("v"))), "c")


@query("SELECT rid, i, round(((ts_us - min(ts_us) OVER (PARTITION BY rid)) / 3.6e9) % 24, 5) AS hour, hour(ts) AS clock_hour FROM readings")
def e14_hours(spark, sf):
    return readings(spark, sf).select("rid", "i", F.round(E.hours_since_start(F.col("ts_us")), 5).alias("hour"), F.hour("ts").alias("clock_hour"))
