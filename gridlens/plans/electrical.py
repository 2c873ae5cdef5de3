"""Queries at the meter point."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlens.functions import electrical as E
from gridlens.operators import meterpoint as M
from gridlens.plans.fixtures import contributions, phases, predictions, readings, spectra
from gridlens.plans.registry import query

_SHARE = "CASE WHEN phase = 0 THEN 1.0 / 3 WHEN phase = {k} THEN 1.0 ELSE 0.0 END"
_SUMS = "sums AS (SELECT scenario, sample, " + ", ".join(f"sum({c} * {_SHARE.format(k=k)}) AS {c}{k}" for c in "pq" for k in (1, 2, 3)) + " FROM contributions GROUP BY ALL)"
_I = ", ".join(f"sqrt(p{k} * p{k} + q{k} * q{k}) / 230 AS i{k}" for k in (1, 2, 3))
_POINT = f"""{_SUMS}, cur AS (SELECT *, {_I}, p1 + p2 + p3 AS p_total, q1 + q2 + q3 AS q_total FROM sums),
    point AS (SELECT *, 230 * i1 AS s1, 230 * i2 AS s2, 230 * i3 AS s3, 230 * i1 + 230 * i2 + 230 * i3 AS s_total,
    sqrt(greatest(0, i1 * i1 + i2 * i2 + i3 * i3 - i1 * i2 - i2 * i3 - i3 * i1)) AS i_n FROM cur)"""


def _sums(spark, sf):
    return M.phase_sums(contributions(spark, sf), ["scenario", "sample"])


def _rounded(df, keys, columns, digits=6):
    return df.select(*keys, *[F.round(c, digits).alias(c) for c in columns])


@query(f"WITH {_SUMS} SELECT scenario, sample, " + ", ".join(f"round({c}{k}, 6) AS {c}{k}" for c in "pq" for k in (1, 2, 3)) + " FROM sums")
def c1_phase_sums(spark, sf):
    return _rounded(_sums(spark, sf), ["scenario", "sample"], [f"{c}{k}" for c in "pq" for k in (1, 2, 3)])


_SPEC = "spec AS (SELECT vec_id, label, unnest(range(1, 40)) AS k, embedding FROM embeddings), h AS (SELECT vec_id, label, k, abs(embedding[k]::DOUBLE) AS m, embedding[k]::DOUBLE * 3.0 AS a FROM spec)"


@query(f"WITH {_SPEC}, s AS (SELECT label, k, sum(m * cos(a)) AS re, sum(m * sin(a)) AS im FROM h GROUP BY ALL) SELECT label, k, round(sqrt(re * re + im * im), 6) AS mag, round(atan2(im, re), 4) AS ang FROM s")
def c2_harmonic_sums(spark, sf):
    h = M.harmonic_sums(spectra(spark, sf), ["label"])
    out = h.select("label", F.posexplode(F.arrays_zip("mag", "ang")).alias("k", "h"))
    return out.select("label", (F.col("k") + 1).cast("long").alias("k"), F.round("h.mag", 6).alias("mag"), F.round("h.ang", 4).alias("ang"))


@query(f"WITH {_SPEC}, e AS (SELECT vec_id, sum(m * m) AS e FROM h GROUP BY vec_id) SELECT vec_id, round(sqrt((vec_id % 50 / 230.0) * (vec_id % 50 / 230.0) + e), 6) AS i_rms FROM e")
def c3_rms_current(spark, sf):
    one = E.fundamental_current((F.col("vec_id") % 50).cast("double"), F.lit(0.0), F.lit(230.0))
    return spectra(spark, sf).select("vec_id", F.round(E.rms_current(one, E.sum_of_squares(F.col("mag"))), 6).alias("i_rms"))


@query(f"WITH {_POINT} SELECT scenario, sample, round(i_n, 4) AS i_n FROM point")
def c4_neutral_current(spark, sf):
    return _rounded(M.meter_point(_sums(spark, sf)), ["scenario", "sample"], ["i_n"], 4)


@query(f"WITH {_POINT} SELECT scenario, sample, round(s1, 6) AS s1, round(s2, 6) AS s2, round(s3, 6) AS s3, round(s_total, 6) AS s_total FROM point")
def c5_apparent_power(spark, sf):
    return _rounded(M.meter_point(_sums(spark, sf)), ["scenario", "sample"], ["s1", "s2", "s3", "s_total"])


@query(f"""WITH {_POINT} SELECT scenario, sample, round(CASE WHEN s_total > 1 THEN p_total / s_total ELSE 1 END, 6) AS pf_total,
    round(CASE WHEN sqrt(p_total * p_total + q_total * q_total) > 1 THEN p_total / sqrt(p_total * p_total + q_total * q_total) ELSE 1 END, 6) AS cosphi_total FROM point""")
def c6_power_factors(spark, sf):
    return _rounded(M.meter_point(_sums(spark, sf)), ["scenario", "sample"], ["pf_total", "cosphi_total"], 6)


@query(f"WITH {_SPEC} SELECT vec_id, round(CASE WHEN vec_id % 10 > 0.01 THEN 100 * sqrt(sum(m * m)) / (vec_id % 10) ELSE 0 END, 4) AS thd FROM h GROUP BY vec_id")
def c7_thd(spark, sf):
    return spectra(spark, sf).select("vec_id", F.round(E.thd_percent(E.sum_of_squares(F.col("mag")), (F.col("vec_id") % 10).cast("double")), 4).alias("thd"))


@query(f"WITH {_POINT} SELECT scenario, sample, round(p_total, 6) AS p_total, round(q_total, 6) AS q_total, round(s_total, 6) AS s_total FROM point")
def c8_totals(spark, sf):
    return _rounded(M.meter_point(_sums(spark, sf)), ["scenario", "sample"], ["p_total", "q_total", "s_total"])


_C9 = ["p_total", "q_total", "s_total", "i1", "i2", "i3"]


@query(f"WITH {_POINT} SELECT scenario, sample, " + ", ".join(f"round({c}, 6) AS {c}" for c in _C9) + ", round(i_n, 4) AS i_n FROM point")
def c9_meter_point(spark, sf):
    m = M.meter_point(_sums(spark, sf))
    return m.select("scenario", "sample", *[F.round(c, 6).alias(c) for c in _C9], F.round("i_n", 4).alias("i_n"))


@query("SELECT scenario, sample, 'device_' || appliance || '_' || phase AS name, round(sum(p), 6) AS p, round(sum(q), 6) AS q, CASE WHEN abs(sum(p)) > 3 THEN 'on' ELSE 'off' END AS state FROM contributions GROUP BY scenario, sample, appliance, phase")
def c10_ground_truth(spark, sf):
    g = contributions(spark, sf).groupBy("scenario", "sample", "appliance", "phase").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    name = F.concat(F.lit("device_"), F.col("appliance").cast("string"), F.lit("_"), F.col("phase").cast("string"))
    return g.select("scenario", "sample", name.alias("name"), F.round("p", 6).alias("p"), F.round("q", 6).alias("q"), F.when(F.abs("p") > 3, "on").otherwise("off").alias("state"))


@query(f"WITH {_SPEC}, e AS (SELECT vec_id, sqrt(sum(m * m)) AS e FROM h GROUP BY vec_id) SELECT vec_id, round(coalesce(CASE WHEN vec_id % 4 = 0 THEN 12.5 END, CASE WHEN vec_id % 100 / 230.0 > 1e-3 THEN 100 * e / (vec_id % 100 / 230.0) END), 5) AS thd FROM e")
def c11_live_thd(spark, sf):
    measured = F.when(F.col("vec_id") % 4 == 0, F.lit(12.5))
    return spectra(spark, sf).select("vec_id", F.round(E.live_thd_percent(measured, F.col("mag"), (F.col("vec_id") % 100).cast("double"), F.lit(0.0), F.lit(230.0)), 5).alias("thd"))


@query("""WITH d AS (SELECT scenario, appliance, sum(p * (CASE WHEN appliance % 2 = 0 THEN 1 ELSE -1 END)) AS p FROM contributions GROUP BY ALL)
    SELECT scenario, appliance, round(sum(greatest(p, 0)) OVER w, 2) AS above, round(sum(least(p, 0)) OVER w, 2) AS below FROM d WINDOW w AS (PARTITION BY scenario ORDER BY appliance ROWS UNBOUNDED PRECEDING)""")
def c12_signed_stack(spark, sf):
    sign = F.when(F.col("appliance") % 2 == 0, 1).otherwise(-1)
    d = contributions(spark, sf).groupBy("scenario", "appliance").agg(F.sum(F.col("p") * sign).alias("p"))
    return _rounded(M.signed_stack(d, ["scenario"], "appliance"), ["scenario", "appliance"], ["above", "below"], 2)


_C13 = [f"{n}({c}) AS {c}_{m}" for c in ("p_total", "q_total") for n, m in (("min", "min"), ("max", "max"), ("avg", "mean"))] + [f"avg({c}) AS {c}_mean" for c in ("p1", "p2", "p3", "i1", "i2", "i3", "i_n")]


@query(f"WITH {_POINT}, s AS (SELECT scenario, {', '.join(_C13)} FROM point GROUP BY scenario) SELECT scenario, " + ", ".join(f"round({c.rsplit(' ', 1)[1]}, 4) AS {c.rsplit(' ', 1)[1]}" for c in _C13) + " FROM s")
def c13_summary(spark, sf):
    s = M.summary(M.meter_point(_sums(spark, sf)))
    return s.select("scenario", *[F.round(c, 4).alias(c) for c in s.columns if c != "scenario"])


@query("SELECT family, round(100 * avg((abs(p) > 50)::INT), 6) AS on_percent, round(median(CASE WHEN abs(p) > 50 THEN abs(p) END), 6) AS median_on, max(abs(p)) AS peak FROM predictions GROUP BY family")
def c14_duty(spark, sf):
    d = M.duty(predictions(spark, sf), ["family"], on_w=50.0)
    return d.select("family", F.round("on_percent", 6).alias("on_percent"), F.round("median_on", 6).alias("median_on"), "peak")


@query("SELECT rid, i, round(CASE WHEN abs((p1 + p2 + p3) / 3) > 1 THEN (greatest(p1, p2, p3) - least(p1, p2, p3)) / abs((p1 + p2 + p3) / 3) ELSE 0 END, 6) AS imbalance FROM phases")
def d7_imbalance(spark, sf):
    return phases(spark, sf).select("rid", "i", F.round(E.imbalance([F.col("p1"), F.col("p2"), F.col("p3")]), 6).alias("imbalance"))


@query("SELECT rid, i, round(CASE WHEN (p1 + p2 + p3) / 3 > 0.01 THEN abs(q) / ((p1 + p2 + p3) / 3) ELSE 0 END, 4) AS ratio FROM phases")
def d8_neutral_ratio(spark, sf):
    return phases(spark, sf).select("rid", "i", F.round(E.neutral_ratio(F.abs("q"), [F.col("p1"), F.col("p2"), F.col("p3")]), 4).alias("ratio"))


@query("SELECT event_type AS family, count(*) AS n, round(avg(p), 6) AS p_mean FROM readings GROUP BY event_type")
def c13_family_means(spark, sf):
    return readings(spark, sf).groupBy(F.col("event_type").alias("family")).agg(F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("p_mean"))
