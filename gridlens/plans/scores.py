"""Queries of scores and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlens.functions.labels import families
from gridlens.operators import models as G
from gridlens.operators import score as S
from gridlens.plans.fixtures import contributions, predictions, readings, table
from gridlens.plans.registry import query
from gridlens.sources.ingest import write_results
from gridlens.sources.store import shared_folder

_CLS = "cls AS (SELECT event_type AS l, CASE WHEN event_id % 4 = 0 THEN (SELECT min(event_type) FROM events) ELSE event_type END AS p FROM events)"


def _classes(spark, sf):
    e = table(spark, sf, "events")
    least = e.agg(F.min("event_type")).first()[0]
    return e.select(F.col("event_type").alias("l"), F.when(F.col("event_id") % 4 == 0, F.lit(least)).otherwise(F.col("event_type")).alias("p"))


@query(f"""WITH {_CLS}, c AS (SELECT DISTINCT l AS k FROM cls UNION SELECT DISTINCT p FROM cls), f AS (SELECT k, count(*) FILTER (l = k AND p = k) AS tp, count(*) FILTER (l = k AND p <> k) AS fn, count(*) FILTER (l <> k AND p = k) AS fp FROM c, cls GROUP BY k)
    SELECT round(avg(2.0 * tp / (2 * tp + fp + fn)), 6) AS macro_f1, round((SELECT avg((l = p)::INT) FROM cls), 6) AS accuracy FROM f""")
def h1_macro_f1(spark, sf):
    return S.macro_f1(_classes(spark, sf), "l", "p").select(F.round("macro_f1", 6).alias("macro_f1"), F.round("accuracy", 6).alias("accuracy"))


@query(f"WITH {_CLS} SELECT l, p, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY l), 6) AS share FROM cls GROUP BY l, p")
def h2_confusion(spark, sf):
    return S.confusion(_classes(spark, sf), "l", "p").select("l", "p", "n", F.round("share", 6).alias("share"))


@query("""SELECT family, sum(truth * pred)::BIGINT AS tp, sum((1 - truth) * pred)::BIGINT AS fp, sum(truth * (1 - pred))::BIGINT AS fn, sum(truth)::BIGINT AS support,
    round(CASE WHEN 2 * sum(truth * pred) + sum((1 - truth) * pred) + sum(truth * (1 - pred)) <> 0 THEN 2 * sum(truth * pred) / (2 * sum(truth * pred) + sum((1 - truth) * pred) + sum(truth * (1 - pred))) END, 6) AS f1 FROM predictions GROUP BY family""")
def h3_presence_f1(spark, sf):
    return S.presence_f1(predictions(spark, sf)).withColumn("f1", F.round("f1", 6))


@query("SELECT family, round(avg(abs(p - (p + q))), 6) AS mae, round(avg(abs(p - (p + q) * pred)), 6) AS gated_mae FROM predictions GROUP BY family")
def h4_mean_errors(spark, sf):
    e = S.mean_errors(predictions(spark, sf).withColumn("x", F.col("p") + F.col("q")), "p", "x", "pred")
    return e.select("family", F.round("mae", 6).alias("mae"), F.round("gated_mae", 6).alias("gated_mae"))


#: A recording's label: the families of its first two samples, as mixed recordings are named.
_LABELS = "labels AS (SELECT rid, string_agg(event_type || '_high', '__' ORDER BY i) AS label FROM readings WHERE i < 2 GROUP BY rid), expected AS (SELECT rid, list_sort(list_distinct(list_transform(string_split(label, '__'), lambda x: regexp_replace(x, '_high$', '')))) AS e FROM labels)"


def _expected(spark, sf):
    first = readings(spark, sf).where("i < 2").select("rid", "i", F.concat("event_type", F.lit("_high")).alias("x"))
    label = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]), "__")
    return first.groupBy("rid").agg(label.alias("label")).select("rid", families(F.col("label")).alias("expected"))


@query(f"""WITH {_LABELS}, d AS (SELECT rid, family, avg(pred) >= 0.15 AS found FROM predictions GROUP BY rid, family),
    g AS (SELECT rid, coalesce(list(family ORDER BY family) FILTER (found), []) AS d, any_value(e) AS e FROM d JOIN expected USING (rid) GROUP BY rid), n AS (SELECT *, len(list_intersect(d, e)) AS h FROM g)
    SELECT rid, round(CASE WHEN len(d) > 0 THEN h / len(d) ELSE 0 END, 3) AS precision, round(CASE WHEN len(e) > 0 THEN h / len(e) ELSE 0 END, 3) AS recall, round(CASE WHEN len(d) + len(e) > 0 THEN 2.0 * h / (len(d) + len(e)) ELSE 0 END, 3) AS f1,
    array_to_string(list_filter(e, lambda x: NOT list_contains(d, x)), ',') AS missed, array_to_string(list_filter(d, lambda x: NOT list_contains(e, x)), ',') AS false_alarms FROM n""")
def h5_set_accuracy(spark, sf):
    return S.set_accuracy(predictions(spark, sf).join(_expected(spark, sf), "rid"), "expected")


@query("SELECT family, round(sum(p) * 10 / 3.6e6, 8) AS energy_kwh, round(avg(pred), 6) AS fraction_on, round(avg(CASE WHEN pred = 1 THEN prob ELSE 1 - prob END), 6) AS confidence FROM predictions GROUP BY family")
def h6_h7_h8_family_report(spark, sf):
    r = S.family_report(predictions(spark, sf), 10.0)
    return r.select("family", F.round("energy_kwh", 8).alias("energy_kwh"), F.round("fraction_on", 6).alias("fraction_on"), F.round("confidence", 6).alias("confidence"))


@query("SELECT rid, round(1 - sum(abs(p - (p + q) * pred)) / greatest(sum(abs(p)), 1e-9), 6) AS explained, round(avg(abs(p - (p + q) * pred)), 6) AS mean_abs_residual FROM predictions GROUP BY rid")
def h9_explained(spark, sf):
    e = S.explained(predictions(spark, sf).withColumn("x", (F.col("p") + F.col("q")) * F.col("pred")), "p", "x")
    return e.select("rid", F.round("explained", 6).alias("explained"), F.round("mean_abs_residual", 6).alias("mean_abs_residual"))


_BEST = """best AS (SELECT rid, win, list(family ORDER BY prob DESC, family) AS f, list(prob ORDER BY prob DESC, family) AS x FROM (SELECT rid, win, family, max(prob) AS prob FROM predictions GROUP BY ALL) GROUP BY rid, win)"""


def _best(spark, sf):
    p = predictions(spark, sf).groupBy("rid", "win", "family").agg(F.max("prob").alias("prob"))
    return S.two_best(p, ["rid", "win"])


@query(f"WITH {_BEST} SELECT rid, win, f[1] AS best, x[1] AS p_best, f[2] AS second, x[2] AS p_second FROM best")
def g13_two_best(spark, sf):
    return _best(spark, sf)


@query(f"WITH {_BEST} SELECT f[1] AS best, count(*) * 2.5 AS seconds FROM best GROUP BY f[1]")
def h10_seconds_by_family(spark, sf):
    return S.seconds_by_family(_best(spark, sf), 2.5)


@query("SELECT family, round(sum(abs(p)), 4) AS total FROM predictions GROUP BY family ORDER BY sum(abs(p)) DESC, family LIMIT 4")
def h11_top_families(spark, sf):
    t = predictions(spark, sf).groupBy("family").agg(F.round(F.sum(F.abs("p")), 4).alias("total"))
    return t.orderBy(F.desc("total"), "family").limit(4)


@query(f"WITH {_BEST} SELECT r.rid, i, f[1] AS best, CASE WHEN x[2] > 0.25 THEN f[2] END AS second FROM readings r JOIN best b ON r.rid = b.rid AND r.i // 5 = b.win")
def h12_painted(spark, sf):
    b = _best(spark, sf).select("rid", "win", "best", F.when(F.col("p_second") > 0.25, F.col("second")).alias("second"))
    return S.painted(readings(spark, sf).select("rid", "i"), b, 5, 5)


@query(f"""WITH {_BEST}, o AS (SELECT r.rid, i, f[1] AS best, CASE WHEN x[2] > 0.25 THEN f[2] END AS second, row_number() OVER (PARTITION BY r.rid, i ORDER BY b.win DESC) AS n
    FROM readings r JOIN best b ON r.rid = b.rid AND r.i >= 5 * b.win AND r.i < 5 * b.win + 12 WHERE b.win % 3 <> 1) SELECT rid, i, best, second FROM o WHERE n = 1""")
def h12_overlapping(spark, sf):
    """Windows of twelve samples every five, a third of them inactive: of those over a sample the last to begin."""
    b = _best(spark, sf).where("win % 3 <> 1").select("rid", "win", "best", F.when(F.col("p_second") > 0.25, F.col("second")).alias("second"))
    return S.painted(readings(spark, sf).select("rid", "i"), b, 5, 12)


_AT = ", ".join(f"coalesce(max(CASE WHEN family = v[{k}] THEN d END), 0) AS on_{k}, round(max(CASE WHEN family = v[{k}] THEN prob END)::DECIMAL(18, 6), 3)::DOUBLE AS prob_{k}, round(coalesce(max(CASE WHEN family = v[{k}] THEN w END), 0)::DECIMAL(18, 4), 1)::DOUBLE AS w_{k}" for k in range(1, 6))


@query(f"""WITH v AS (SELECT list_sort(list(DISTINCT event_type)) AS v FROM events), totals AS (SELECT rid, win, sum(p) AS t FROM predictions GROUP BY rid, win),
    per AS (SELECT rid, win, family, max(pred) AS d, max(prob) AS prob, sum(p) * max(pred) AS w FROM predictions GROUP BY rid, win, family)
    SELECT rid, win, round(win * 10 / 3600.0, 9) AS hour, round(max(t)::DECIMAL(18, 4), 1)::DOUBLE AS total, round((max(t) - sum(w))::DECIMAL(18, 4), 1)::DOUBLE AS residual, {_AT} FROM per JOIN totals USING (rid, win), v GROUP BY rid, win""")
def h13_timeline(spark, sf):
    names = [r[0] for r in table(spark, sf, "events").select("event_type").distinct().orderBy("event_type").collect()]
    p = predictions(spark, sf)
    return S.timeline(p.join(p.groupBy("rid", "win").agg(F.sum("p").alias("total")), ["rid", "win"]), names).withColumn("hour", F.round("hour", 9))


_LIVE = "w AS (SELECT rid, win, family, (avg(truth) >= 0.5)::INT AS t, max(pred) AS d, avg(p) AS p, avg(p * pred) AS g FROM predictions GROUP BY rid, win, family)"


@query(f"WITH {_LIVE} SELECT family, sum(t * d)::BIGINT AS tp, sum((1 - t) * d)::BIGINT AS fp, sum(t * (1 - d))::BIGINT AS fn, sum((1 - t) * (1 - d))::BIGINT AS tn, round(avg((t = d)::INT), 6) AS accuracy, round(avg(abs(p - g)), 6) AS mae FROM w GROUP BY family")
def h14_live_score(spark, sf):
    s = S.live_score(predictions(spark, sf), ["rid", "win"])
    return s.withColumns({"accuracy": F.round("accuracy", 6), "mae": F.round("mae", 6)})


@query(f"""WITH {_LABELS}, t AS (SELECT rid, win, list(DISTINCT family) FILTER (pred = 1) AS d, max(abs(p)) AS w FROM predictions GROUP BY rid, win),
    s AS (SELECT rid, coalesce(d, []) AS d, e FROM t JOIN expected USING (rid) WHERE w > 10),
    n AS (SELECT rid, sum(len(list_intersect(d, e)))::BIGINT AS tp, sum(len(d) - len(list_intersect(d, e)))::BIGINT AS fp, sum(len(e) - len(list_intersect(d, e)))::BIGINT AS fn, count(*) AS n FROM s GROUP BY rid)
    SELECT *, round(2.0 * tp / greatest(1, 2 * tp + fp + fn), 3) AS f1 FROM n""")
def h15_label_score(spark, sf):
    return S.label_score(predictions(spark, sf).join(_expected(spark, sf), "rid"), "expected", instant="p")


_STATES = "parts AS (SELECT scenario, sample, 'f' || (appliance % 3) AS family, p, CASE WHEN sample % 2 = 0 THEN CASE WHEN p > 20000 THEN 'on' ELSE 'off' END END AS state FROM contributions)"


@query(f"""WITH {_STATES} SELECT scenario, sample, family, round(sum(p), 2) AS p, bool_or(coalesce(state = 'on', abs(p) > 3)) AS "on" FROM parts GROUP BY scenario, sample, family
    UNION ALL SELECT DISTINCT -1 - rid, NULL, unnest([event_type]), NULL, NULL FROM readings WHERE i < 2""")
def h16_family_truth(spark, sf):
    """Scenarios have contributions; recordings (negative numbers here) have the families of their labels."""
    state = F.when(F.col("sample") % 2 == 0, F.when(F.col("p") > 20000, "on").otherwise("off"))
    c = contributions(spark, sf).select("scenario", "sample", F.concat(F.lit("f"), F.col("appliance") % 3).alias("family"), "p", state.alias("state"))
    t = S.family_truth(c, _expected(spark, sf).withColumn("scenario", -1 - F.col("rid")), "expected", ["scenario", "sample"])
    return t.withColumn("p", F.round("p", 2))


@query("SELECT event_id, round(n / (k * c), 6) AS weight FROM (SELECT event_id, count(*) OVER () AS n, count(*) OVER (PARTITION BY event_type) AS c, (SELECT count(DISTINCT event_type) FROM events) AS k FROM events)")
def g9_balanced_weights(spark, sf):
    return G.balanced_weights(table(spark, sf, "events"), "event_type").select("event_id", F.round("weight", 6).alias("weight"))


@query("SELECT rid, win, family, round(sum(p) * (max(prob) >= 0.5)::INT, 6) AS gated FROM predictions GROUP BY rid, win, family")
def g12_gated_power(spark, sf):
    """Watts of every family of a window, and none where its presence is below one half."""
    names = [r[0] for r in table(spark, sf, "events").select("event_type").distinct().orderBy("event_type").collect()]
    wide = predictions(spark, sf).groupBy("rid", "win").pivot("family", names).agg(F.max("prob").alias("presence"), F.sum("p").alias("power"))
    wide = wide.select("rid", "win", *[F.col(f"{f}_{c}").alias(f"{c}_{f}") for f in names for c in ("presence", "power")])
    long = G.gated(wide, names).unpivot(["rid", "win"], [f"gated_{f}" for f in names], "family", "gated").where("gated is not null")
    return long.select("rid", "win", F.substring("family", 7, 1000).alias("family"), F.round("gated", 6).alias("gated"))


@query("SELECT family, round(abs(sum(p + q) - sum(p)) / abs(sum(p)), 6) AS sae, round(sum(q * q) / sum(p * p), 6) AS nde, round(2 * sum(least(p, p + q)) / (sum(p) + sum(p + q)), 6) AS energy_f1 FROM predictions GROUP BY family")
def k13_energy_errors(spark, sf):
    from gridlens.operators.explore import energy_errors

    e = energy_errors(predictions(spark, sf).withColumn("e", F.col("p") + F.col("q")))
    return e.select("family", *[F.round(c, 6).alias(c) for c in ("sae", "nde", "energy_f1")])


_SUMMARY = "rid long, confidence double, explained double, residual_w double, families array<struct<family: string, fraction_on: double, energy_kwh: double>>"


@query("""WITH per AS (SELECT rid, win, family, max(pred) AS d, max(prob) AS prob, sum(p) * max(pred) AS w FROM predictions GROUP BY rid, win, family), t AS (SELECT rid, win, sum(p) AS t FROM predictions GROUP BY rid, win),
    f AS (SELECT rid, family, sum(d) / any_value(n) AS fraction_on, sum(w) * 10 / 3.6e6 AS energy_kwh FROM per JOIN (SELECT rid, count(*) AS n FROM t GROUP BY rid) USING (rid) GROUP BY rid, family),
    g AS (SELECT rid, win, any_value(t) AS t, sum(w) AS w, sum(CASE WHEN d = 1 THEN prob ELSE 1 - prob END) AS c, count(*) AS k FROM per JOIN t USING (rid, win) GROUP BY rid, win),
    r AS (SELECT rid, sum(c) / sum(k) AS confidence, 1 - sum(abs(t - w)) / greatest(sum(abs(t)), 1e-9) AS explained, avg(abs(t - w)) AS residual_w FROM g GROUP BY rid),
    n AS (SELECT rid, count(*) AS rows_written FROM per GROUP BY rid)
    SELECT rid, family, round(fraction_on::DECIMAL(28, 12), 6)::DOUBLE AS fraction_on, round(energy_kwh::DECIMAL(28, 12), 8)::DOUBLE AS energy_kwh, round(confidence::DECIMAL(28, 12), 6)::DOUBLE AS confidence, round(explained::DECIMAL(28, 12), 6)::DOUBLE AS explained, round(residual_w::DECIMAL(28, 12), 4)::DOUBLE AS residual_w, rows_written FROM f JOIN r USING (rid) JOIN n USING (rid)""")
def a12_results(spark, sf):
    """Result files of all recordings, written and reread: the summary of each, and the rows of its CSV.

    Figures are rounded half up on the decimal value, as sums of watts end in a 5 now and then.
    """
    p = predictions(spark, sf)
    per = p.groupBy("rid", "win", "family").agg(F.max("pred").alias("on"), F.max("prob").alias("prob"), (F.sum("p") * F.max("pred")).alias("watts"))
    windows = per.join(p.groupBy("rid", "win").agg(F.sum("p").alias("total")), ["rid", "win"])
    by_family, by_recording = S.mix_summary(windows, 10.0)
    folder = shared_folder(spark, "results")
    write_results(windows, by_family, by_recording, folder)
    summary = spark.read.schema(_SUMMARY).json(f"{folder}/summary")
    rows = spark.read.schema(windows.drop("rid").withColumns({"slice": F.lit(0), "rid": F.lit(0).cast("long")}).schema).option("header", True).csv(f"{folder}/predictions")
    written = rows.groupBy("rid").agg(F.count("*").alias("rows_written"))
    flat = summary.select("rid", "confidence", "explained", "residual_w", F.explode("families").alias("f")).join(written, "rid")
    digits = {"fraction_on": 6, "energy_kwh": 8, "confidence": 6, "explained": 6, "residual_w": 4}
    return flat.select("rid", "f.*", "confidence", "explained", "residual_w", "rows_written").select("rid", "family", "rows_written", *[F.round(F.col(c).cast("decimal(28, 12)"), d).cast("double").alias(c) for c, d in digits.items()])
