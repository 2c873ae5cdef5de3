"""Queries of validation and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlens.functions import electrical as E
from gridlens.functions import labels as L
from gridlens.operators import clean
from gridlens.plans.fixtures import contributions, dirty, readings, spectra, table
from gridlens.plans.registry import query


@query("""SELECT rid, count(*) AS n_samples, count(*) FILTER (ts_us <= prev) AS n_backward, count(*) >= 2 AND count(*) FILTER (ts_us <= prev) = 0 AS valid
    FROM (SELECT *, lag(ts_us) OVER (PARTITION BY rid ORDER BY i) AS prev FROM readings) GROUP BY rid""")
def b1_validate(spark, sf):
    return clean.validate(readings(spark, sf))


@query("""SELECT rid, round(1e6 / median(ts_us - prev) * 1e6, 4) AS rate FROM (SELECT *, lag(ts_us) OVER (PARTITION BY rid ORDER BY i) AS prev FROM readings) WHERE ts_us > prev GROUP BY rid""")
def b2_sample_rate(spark, sf):
    return clean.sample_rate(readings(spark, sf)).select("rid", F.round(F.col("rate") * 1e6, 4).alias("rate"))


@query("SELECT rid, count(*) FILTER (isnan(v)) AS v_nan, count(*) FILTER (isinf(v)) AS v_inf, count(*) FILTER (v IS NULL) AS v_missing, 0 AS p_nan, 0 AS p_inf, 0 AS p_missing FROM dirty GROUP BY rid")
def b3_count_faults(spark, sf):
    return clean.count_faults(dirty(spark, sf), ["v", "p"])


@query("SELECT rid, i, c AS v FROM gappy")
def b4_to_missing(spark, sf):
    return clean.to_missing(dirty(spark, sf), ["v"]).select("rid", "i", "v")


_FILL = """filled AS (SELECT *, CASE WHEN c IS NOT NULL THEN c WHEN i1 - i0 - 1 <= 5 THEN v0 + (v1 - v0) * (i - i0) / (i1 - i0) END AS f,
    CASE WHEN c IS NOT NULL THEN 0 WHEN i1 - i0 - 1 <= 5 THEN 1 ELSE 2 END AS gap FROM (SELECT *, last_value(c IGNORE NULLS) OVER a AS v0, first_value(c IGNORE NULLS) OVER b AS v1,
    last_value(CASE WHEN c IS NOT NULL THEN i END IGNORE NULLS) OVER a AS i0, first_value(CASE WHEN c IS NOT NULL THEN i END IGNORE NULLS) OVER b AS i1 FROM gappy
    WINDOW a AS (PARTITION BY rid ORDER BY i ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)))"""


@query(f"WITH {_FILL} SELECT rid, i, round(f, 6) AS filled, gap FROM filled")
def b5_impute_short_gaps(spark, sf):
    d = clean.to_missing(dirty(spark, sf), ["v"])
    return clean.impute_short_gaps(d, "v").select("rid", "i", F.round("filled", 6).alias("filled"), "gap")


@query("SELECT rid, i, CASE WHEN c IS NOT NULL THEN greatest(least(c, 80.0), 20.0) END AS clipped, coalesce(c < 20 OR c > 80, false) AS outlier FROM gappy")
def b6_clip(spark, sf):
    c = E.finite(F.col("v"))
    return dirty(spark, sf).select("rid", "i", clean.clip(c, 20.0, 80.0).alias("clipped"), clean.outside(c, 20.0, 80.0).alias("outlier"))


@query("SELECT rid, i, CASE WHEN c BETWEEN 20 AND 80 THEN c END AS flagged FROM gappy")
def b7_flag(spark, sf):
    return dirty(spark, sf).select("rid", "i", clean.flag(E.finite(F.col("v")), 20.0, 80.0).alias("flagged"))


@query("""SELECT rid, i, round(CASE WHEN c IS NULL OR i + 1 <= 2 OR i + 1 > n - 2 THEN c ELSE m END, 5) AS smoothed FROM
    (SELECT *, count(*) OVER (PARTITION BY rid) AS n, sum(coalesce(c, 0)) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 AS m FROM gappy)""")
def b8_smooth(spark, sf):
    d = clean.to_missing(dirty(spark, sf), ["v"])
    return clean.smooth(d, "v", 5).select("rid", "i", F.round("smoothed", 5).alias("smoothed"))


@query(f"""WITH {_FILL} SELECT rid, count(*) AS n, count(*) FILTER (isnan(v)) AS n_nan, count(*) FILTER (isinf(v)) AS n_inf, count(*) FILTER (gap = 1) AS n_filled,
    count(*) FILTER (gap = 2) AS n_left, count(*) FILTER (f < 20 OR f > 80) AS n_clipped FROM filled GROUP BY rid""")
def b9_quality_report(spark, sf):
    return clean.quality_report(dirty(spark, sf), "v", 20.0, 80.0)


@query("""SELECT rid, i, coalesce(t0 + (i - i0) * 200000, t1 - (i1 - i) * 200000) AS ts_est_us FROM (SELECT *, last_value(t IGNORE NULLS) OVER a AS t0, first_value(t IGNORE NULLS) OVER b AS t1,
    last_value(CASE WHEN t IS NOT NULL THEN i END IGNORE NULLS) OVER a AS i0, first_value(CASE WHEN t IS NOT NULL THEN i END IGNORE NULLS) OVER b AS i1
    FROM (SELECT *, CASE WHEN c IS NOT NULL THEN ts_us END AS t FROM gappy)
    WINDOW a AS (PARTITION BY rid ORDER BY i ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""")
def b10_estimated_times(spark, sf):
    d = clean.to_missing(dirty(spark, sf), ["v"])
    return clean.estimated_times(d, F.col("v").isNotNull(), 200_000).select("rid", "i", "ts_est_us")


@query("""SELECT scenario, count(DISTINCT n) AS n_n, count(DISTINCT start) AS n_start FROM (SELECT scenario, appliance, count(*) AS n, min(sample) AS start FROM contributions GROUP BY ALL)
    GROUP BY scenario HAVING count(DISTINCT n) > 1 OR count(DISTINCT start) > 1""")
def b11_misaligned(spark, sf):
    traces = clean.trace_spans(contributions(spark, sf), "scenario", "appliance", "sample")
    return clean.misaligned(traces, "scenario", ["n", "start"])


@query("""WITH s AS (SELECT scenario, sample, sum(p) AS s FROM contributions GROUP BY ALL), t AS (SELECT scenario, sample, s + sample % 2 AS p FROM s)
    SELECT scenario, round(max(abs(s - p)) / greatest(1.0, max(abs(p))), 9) AS error FROM t JOIN s USING (scenario, sample) GROUP BY scenario""")
def b12_conservation(spark, sf):
    c = contributions(spark, sf)
    totals = c.groupBy("scenario", "sample").agg(F.sum("p").alias("p")).withColumn("p", F.col("p") + F.col("sample") % 2)
    return clean.conservation_error(totals, c).select("scenario", F.round("error", 9).alias("error"))


@query("SELECT vec_id, NOT (list_bool_or(list_transform(h, lambda x: isnan(x) OR isinf(x)))) AND list_max(list_transform(h, lambda x: abs(x))) >= 1e-30 AS plausible FROM (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN list_append(embedding[1:38], 'Infinity'::FLOAT) WHEN vec_id % 5 = 0 THEN list_transform(embedding[1:39], lambda x: x * 1e-35) ELSE embedding[1:39] END AS h FROM embeddings)")
def b13_plausible_spectrum(spark, sf):
    s = spectra(spark, sf)
    h = F.when(F.col("vec_id") % 7 == 0, F.concat(F.slice("mag", 1, 38), F.array(F.lit(float("inf"))))).when(F.col("vec_id") % 5 == 0, F.transform("mag", lambda x: x * 1e-35)).otherwise(F.col("mag"))
    return s.select("vec_id", E.plausible_spectrum(h).alias("plausible"))


@query("SELECT rid, count(*) AS n, max(abs(p)) < 1 AS quiet FROM readings GROUP BY rid HAVING NOT bool_or(event_type || rid LIKE '%7') AND count(*) >= 25")
def b14_eligible(spark, sf):
    return clean.eligible(readings(spark, sf), F.concat("event_type", F.col("rid").cast("string")).like("%7"))


@query("""SELECT rid, bool_and(coalesce(v >= 0 AND v < 1000 AND NOT isnan(v), false)) AS enabled, count(*) FILTER (v >= 0 AND v < 1000 AND NOT isnan(v)) AS n_good FROM dirty GROUP BY rid""")
def b15_plausible_percent(spark, sf):
    ok = E.plausible_percent(F.col("v"))
    return dirty(spark, sf).groupBy("rid").agg(F.bool_and(ok).alias("enabled"), F.count_if(ok).alias("n_good"))


@query("""WITH f AS (SELECT rid, i, c, count(*) FILTER (c IS NULL) OVER w AS failures FROM gappy WINDOW w AS (PARTITION BY rid ORDER BY i ROWS UNBOUNDED PRECEDING))
    SELECT rid, i, failures, failures - coalesce(max(CASE WHEN c IS NOT NULL THEN failures END) OVER (PARTITION BY rid ORDER BY i ROWS UNBOUNDED PRECEDING), 0) AS in_a_row FROM f""")
def b16_read_failures(spark, sf):
    return clean.read_failures(dirty(spark, sf).withColumn("v", E.finite(F.col("v"))), "v").select("rid", "i", "failures", "in_a_row")


@query("""SELECT rid, i, round(1e12 / avg(step) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 4) AS rate
    FROM (SELECT *, ts_us - lag(ts_us) OVER (PARTITION BY rid ORDER BY i) AS step FROM readings)""")
def b16_effective_rate(spark, sf):
    return clean.effective_rate(readings(spark, sf)).select("rid", "i", F.round(F.col("rate") * 1e6, 4).alias("rate"))


@query("SELECT event_id, round(abs(230 * (value / 200) - value) / value, 6) AS deviation, abs(230 * (value / 200) - value) / value > 0.1 AND event_id % 3 = 0 AS suspect FROM events WHERE value <> 0")
def b17_apparent_check(spark, sf):
    dev = F.abs(F.lit(230) * (F.col("value") / 200) - F.col("value")) / F.col("value")
    return table(spark, sf, "events").where("value <> 0").select("event_id", F.round(dev, 6).alias("deviation"), ((dev > 0.1) & (F.col("event_id") % 3 == 0)).alias("suspect"))


@query("SELECT event_type AS family, count(DISTINCT user_id) AS n, min(user_id) AS first FROM events GROUP BY event_type")
def i2_pool(spark, sf):
    from gridlens.operators.scenarios import pool

    return pool(readings(spark, sf).withColumnRenamed("event_type", "family")).select("family", F.size("recordings").cast("long").alias("n"), F.get("recordings", F.lit(0)).alias("first"))


@query("SELECT rid, i, coalesce(c, 0) AS p FROM gappy WHERE event_type NOT LIKE '%\\_\\_%' ESCAPE '\\'")
def i1_zero_filled(spark, sf):
    d = dirty(spark, sf).where(~L.is_mixed(F.col("event_type")))
    return d.select("rid", "i", F.coalesce(E.finite(F.col("v")), F.lit(0.0)).alias("p"))
