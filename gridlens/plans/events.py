"""Queries of edges, states and exploration."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridlens.functions.draws import chance
from gridlens.operators import events as J
from gridlens.operators import explore as X
from gridlens.operators import meterpoint as M
from gridlens.operators import scenarios as I
from gridlens.plans.fixtures import contributions, phases, predictions, readings, spectra
from gridlens.plans.registry import query, sql_chance
from gridlens.sources.store import shared_folder

SIDE, SPAN = 2, 6
_EDGES = f"""x AS (SELECT *, abs(p - lag(p) OVER (PARTITION BY rid ORDER BY i)) AS jump, lag(i) OVER (PARTITION BY rid ORDER BY i) AS before FROM readings),
    y AS (SELECT *, count(*) OVER w AS n, quantile_cont(p, 0.5) OVER a AS p0, quantile_cont(p, 0.5) OVER b AS p1, quantile_cont(q, 0.5) OVER a AS q0, quantile_cont(q, 0.5) OVER b AS q1,
    stddev_pop(p) OVER a AS s0, stddev_pop(p) OVER b AS s1, max(struct_pack(d := jump, o := -before)) OVER m AS j FROM x WINDOW w AS (PARTITION BY rid ORDER BY i ROWS BETWEEN {SPAN - 1} PRECEDING AND CURRENT ROW),
    a AS (PARTITION BY rid ORDER BY i ROWS BETWEEN {SPAN - 1} PRECEDING AND {SPAN - SIDE} PRECEDING), b AS (PARTITION BY rid ORDER BY i ROWS BETWEEN {SIDE - 1} PRECEDING AND CURRENT ROW),
    m AS (PARTITION BY rid ORDER BY i ROWS BETWEEN {SPAN - SIDE - 2} PRECEDING AND {SIDE} PRECEDING)),
    edges AS (SELECT rid, i, -(j.o) AS "at", p1 - p0 AS dp, q1 - q0 AS dq, p1 AS p_after FROM y WHERE n = {SPAN} AND (abs(p1 - p0) >= 8 - 1e-9 OR abs(q1 - q0) >= 16 - 1e-9) AND s0 <= greatest(6, 0.05 * abs(p0)) + 1e-9 AND s1 <= greatest(6, 0.05 * abs(p1)) + 1e-9)"""
KNOWN = [("fan", 20.0, 5.0), ("lamp", 40.0, 0.0), ("boiler", 75.0, -10.0)]


def _edges(spark, sf):
    return J.edges(readings(spark, sf), SIDE, SPAN)


@query(f"WITH {_EDGES} SELECT rid, i, \"at\", round(dp, 5) AS dp, round(dq, 5) AS dq, round(p_after, 5) AS p_after FROM edges")
def j1_edges(spark, sf):
    return _edges(spark, sf).select("rid", "i", "at", *[F.round(c, 5).alias(c) for c in ("dp", "dq", "p_after")])


#: Edges of a recording in order, one step each: those that follow the last accepted one by 3.
_DEBOUNCED = f"""{_EDGES}, num AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY "at", i) AS n FROM edges),
    step AS (SELECT rid, n, "at" AS last, true AS ok FROM num WHERE n = 1 UNION ALL
    SELECT num.rid, num.n, CASE WHEN num."at" - step.last >= 3 THEN num."at" ELSE step.last END, num."at" - step.last >= 3 FROM step JOIN num ON num.rid = step.rid AND num.n = step.n + 1),
    kept AS (SELECT num.* FROM num JOIN step USING (rid, n) WHERE step.ok)"""


@query(f"WITH RECURSIVE {_DEBOUNCED} SELECT rid, i, \"at\", round(dp, 5) AS dp, round(dq, 5) AS dq, round(p_after, 5) AS p_after FROM kept")
def j2_debounced_edges(spark, sf):
    return J.debounce(_edges(spark, sf), 3).select("rid", "i", "at", *[F.round(c, 5).alias(c) for c in ("dp", "dq", "p_after")])


@query("SELECT rid, family, round(median(p), 6) AS p_sig, round(median(q), 6) AS q_sig FROM (SELECT rid, event_type AS family, p, q FROM readings WHERE abs(p) > 3) GROUP BY rid, family HAVING count(*) >= 5")
def j3_signatures(spark, sf):
    s = J.signatures(readings(spark, sf).withColumnRenamed("event_type", "family"), least=5)
    return s.select("rid", "family", F.round("p_sig", 6).alias("p_sig"), F.round("q_sig", 6).alias("q_sig"))


_KNOWN = "(VALUES " + ", ".join(f"('{f}', {p}, {q})" for f, p, q in KNOWN) + ") k(family, kp, kq)"


@query(f"""WITH {_EDGES}, d AS (SELECT *, (sqrt(power(sign * dp - kp, 2) + power(sign * dq - kq, 2)) / greatest(20.0, 0.35 * sqrt(kp * kp + kq * kq)))::DECIMAL(18, 9) AS d FROM (SELECT *, CASE WHEN dp < 0 THEN -1 ELSE 1 END AS sign FROM edges), {_KNOWN}),
    b AS (SELECT *, row_number() OVER (PARTITION BY rid, i ORDER BY d, family) AS r FROM d)
    SELECT rid, i, round(dp, 5) AS dp, CASE WHEN abs(dp) >= 8 - 1e-9 AND d < 1 AND round(1 - d, 2) >= 0.25 THEN family END AS family, CASE WHEN abs(dp) >= 8 - 1e-9 AND d < 1 AND round(1 - d, 2) >= 0.25 THEN round(1 - d, 2)::DOUBLE END AS confidence FROM b WHERE r = 1""")
def j4_matched_edges(spark, sf):
    return J.match(_edges(spark, sf), KNOWN).select("rid", "i", F.round("dp", 5).alias("dp"), "family", "confidence")


#: Samples between ticks, and the samples of which a tick takes the median, at one and at five samples a second.
STRIDE, RATES = 2, {1: 3, 5: 13}


def _labelled(spark, sf):
    """Readings with their recording's label: the first event type, or the first two for every fourth recording."""
    r = readings(spark, sf)
    at = lambda k: F.max(F.when(F.col("i") == k, F.concat("event_type", F.lit("_high"))))
    mixed = F.when(F.col("rid") % 4 == 0, F.concat(at(0), F.lit("__"), at(1))).otherwise(at(0))
    return r.join(r.where("i < 2").groupBy("rid").agg(mixed.alias("label")), "rid")


_SIGNATURES = """sg AS (SELECT r.rid AS signature, f.event_type AS family, median(r.p) AS p_sig, median(r.q) AS q_sig FROM readings r JOIN readings f ON f.rid = r.rid AND f.i = 0 WHERE abs(r.p) > 3 AND r.rid % 4 <> 0 GROUP BY ALL HAVING count(*) >= 25)"""


@query(f"WITH {_SIGNATURES} SELECT signature, family, round(p_sig, 6) AS p_sig, round(q_sig, 6) AS q_sig FROM sg")
def j3_pure_signatures(spark, sf):
    """Median P and Q of the recordings of a single device, 25 samples on at least; mixed labels have none."""
    s = J.pure_signatures(_labelled(spark, sf))
    return s.select("signature", "family", F.round("p_sig", 6).alias("p_sig"), F.round("q_sig", 6).alias("q_sig"))


@query(f"""WITH {_EDGES}, {_SIGNATURES}, d AS (SELECT e.rid, e.i, dp, sg.*, (sqrt(power(CASE WHEN dp < 0 THEN -dp ELSE dp END - p_sig, 2) + power(CASE WHEN dp < 0 THEN -dq ELSE dq END - q_sig, 2)) / greatest(20.0, 0.35 * sqrt(p_sig * p_sig + q_sig * q_sig)))::DECIMAL(18, 9) AS d FROM edges e, sg WHERE abs(dp) >= 8 - 1e-9),
    b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rid, i ORDER BY d, family, signature) AS r FROM d WHERE d < 1) WHERE r = 1 AND round(1 - d, 2) >= 0.25)
    SELECT edges.rid, edges.i, round(edges.dp, 5) AS dp, b.family, round(1 - b.d, 2)::DOUBLE AS confidence FROM edges LEFT JOIN b USING (rid, i)""")
def j4_nearest_signatures(spark, sf):
    """Every edge against the signatures of all recordings, by a tree of cells of the (P, Q) plane."""
    known = J.pure_signatures(_labelled(spark, sf))
    return J.match_table(_edges(spark, sf), known).select("rid", "i", F.round("dp", 5).alias("dp"), "family", "confidence")


def _claims_sql(known: str, edges: str, rate: int = 1) -> str:
    """Claims of every recording, one edge or tick a step: ``held`` holds the claims in the order in which they came."""
    return f"""d AS (SELECT *, (sqrt(power(sign * dp - kp, 2) + power(sign * dq - kq, 2)) / greatest(20.0, 0.35 * sqrt(kp * kp + kq * kq)))::DECIMAL(18, 9) AS d FROM (SELECT *, CASE WHEN dp < 0 THEN -1 ELSE 1 END AS sign FROM {edges}), {known}),
    b AS (SELECT *, abs(dp) >= 8 - 1e-9 AND d < 1 AND round(1 - d, 2) >= 0.25 AS good, round(1 - d, 2)::DOUBLE AS c FROM (SELECT *, row_number() OVER (PARTITION BY rid, i ORDER BY d, family) AS r FROM d) WHERE r = 1),
    tk AS (SELECT * FROM (SELECT rid, i, quantile_cont(p, 0.5) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN {RATES[rate] - 1} PRECEDING AND CURRENT ROW) AS p_now FROM readings) WHERE i % {STRIDE * rate} = 0),
    m AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY seen, tick, "at", dp) AS k FROM (
        SELECT rid, i AS seen, 0 AS tick, "at", dp, p_after, CASE WHEN good THEN family END AS f, CASE WHEN good THEN c END AS c FROM b UNION ALL SELECT rid, i, 1, i, NULL, p_now, NULL, NULL FROM tk)),
    walk AS (SELECT DISTINCT rid, 0::BIGINT AS k, NULL::BIGINT AS "at", NULL::DOUBLE AS dp, NULL::VARCHAR AS device, []::STRUCT(f VARCHAR, w DOUBLE, c DOUBLE, t BIGINT)[] AS held, 0::BIGINT AS drops, []::VARCHAR[] AS dropped FROM m UNION ALL
    SELECT rid, k, "at", dp, device, list_filter(claimed, lambda x: NOT list_contains(old[:drops], x.f)), drops, old[:drops] FROM (
        SELECT *, CASE WHEN tick = 0 THEN 0 ELSE coalesce(list_min(list_filter(range(0, len(old) + 1), lambda j: total - gone[j + 1] <= p_after + greatest(30, 0.1 * (total - gone[j + 1])) + 1e-9)), len(old)) END AS drops FROM (
        SELECT *, list_transform(range(0, len(old) + 1), lambda j: coalesce(list_sum(list_transform(list_filter(claimed, lambda x: list_contains(old[:j], x.f)), lambda x: x.w)), 0)) AS gone FROM (
        SELECT *, coalesce(list_sum(list_transform(claimed, lambda x: x.w)), 0) AS total, list_transform(list_sort(list_filter(list_transform(claimed, lambda x, n: struct_pack(c := x.c, n := n, f := x.f, t := x.t)), lambda x: "at" - x.t >= {6 * rate})), lambda x: x.f) AS old FROM (
        SELECT *, CASE WHEN device IS NULL THEN held WHEN dp <= 0 THEN list_filter(held, lambda x: x.f <> device)
            WHEN list_contains(list_transform(held, lambda x: x.f), device) THEN list_transform(held, lambda x: CASE WHEN x.f = device THEN struct_pack(f := device, w := abs(dp), c := c, t := "at") ELSE x END)
            ELSE list_append(held, struct_pack(f := device, w := abs(dp), c := c, t := "at")) END AS claimed FROM (
        SELECT m.*, walk.held, CASE WHEN m.tick = 1 THEN NULL WHEN m.dp > 0 THEN CASE WHEN m.c >= 0.3 THEN m.f END WHEN list_contains(list_transform(walk.held, lambda x: x.f), m.f) THEN m.f
            ELSE list_min(list_filter(list_transform(walk.held, lambda x, n: struct_pack(e := abs(abs(m.dp) - x.w) / greatest(x.w, 20.0), n := n, f := x.f)), lambda x: x.e < 0.35)).f END AS device
        FROM walk JOIN m ON m.rid = walk.rid AND m.k = walk.k + 1))))))
    SELECT rid, "at", CASE WHEN dp > 0 THEN 'on' ELSE 'off' END AS kind, device, round(abs(dp), 5) AS watts FROM walk WHERE device IS NOT NULL UNION ALL SELECT rid, "at", 'dropped', unnest(dropped), 0.0 FROM walk"""


def _rounded_claims(spark, sf, matched, rate=1):
    found = J.claims(matched, J.ticks(readings(spark, sf), STRIDE * rate, RATES[rate]), rate)
    return found.select("rid", "at", "kind", "device", F.round("watts", 5).alias("watts"))


@query(f"WITH RECURSIVE {_DEBOUNCED}, {_claims_sql(_KNOWN, 'kept')}")
def j5_j6_j7_claims(spark, sf):
    """Claims by edges, dropped at ticks of two seconds when the settled power can't hold them; one sample a second."""
    return _rounded_claims(spark, sf, J.match(J.debounce(_edges(spark, sf), 3), KNOWN))


@query(f"WITH RECURSIVE {_DEBOUNCED}, {_claims_sql(_KNOWN, 'kept', 5)}")
def j7_claims_5hz(spark, sf):
    """The same samples as five a second: ages count in seconds, so 30 samples make a claim old."""
    return _rounded_claims(spark, sf, J.match(J.debounce(_edges(spark, sf), 3), KNOWN), 5)


_OTHERS = [(f, 1.1 * p, q) for f, p, q in KNOWN]
_OTHERS_SQL = "(VALUES " + ", ".join(f"('{f}', {p!r}::DOUBLE, {q!r}::DOUBLE)" for f, p, q in _OTHERS) + ") k(family, kp, kq)"


@query(f"""WITH RECURSIVE {_DEBOUNCED}, late AS (SELECT * FROM (SELECT * EXCLUDE (n), row_number() OVER (PARTITION BY rid ORDER BY "at" DESC, i DESC) AS back FROM kept) WHERE back <= 600), {_claims_sql(_OTHERS_SQL, 'late')}""")
def j8_rebuilt_claims(spark, sf):
    """The last 600 edges of every recording, matched against other signatures and replayed."""
    last = Window.partitionBy("rid").orderBy(F.desc("at"), F.desc("i"))
    recent = J.debounce(_edges(spark, sf), 3).withColumn("_r", F.row_number().over(last)).where("_r <= 600").drop("_r")
    return _rounded_claims(spark, sf, J.match(recent, _OTHERS))


@query("SELECT rid, i, quantile_cont(least(1.0, p / 100), 0.5) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS prob FROM readings")
def j10_smoothed(spark, sf):
    from gridlens.operators.windows import smoothed

    return readings(spark, sf).select("rid", "i", smoothed(F.least(F.lit(1.0), F.col("p") / 100)).alias("prob"))


@query("""SELECT rid, i, coalesce(last_value(CASE WHEN p >= 55 THEN 1 WHEN p < 45 THEN 0 END IGNORE NULLS) OVER (PARTITION BY rid ORDER BY i ROWS UNBOUNDED PRECEDING), 0) AS state FROM readings""")
def j11_hysteresis(spark, sf):
    return J.device_on(readings(spark, sf), F.col("p") / 100, ["rid"], "i").select("rid", "i", "state")


_TICKS = """t AS (SELECT scenario, sample, appliance, sum(p) AS p FROM contributions GROUP BY ALL), u AS (SELECT scenario, sample, appliance, CASE WHEN appliance = 1 THEN p / 2 END AS claimed, p AS modelled, appliance = 2 AS held, 0.6 * sum(p) OVER (PARTITION BY scenario, sample) AS total FROM t),
    v AS (SELECT *, coalesce(claimed, 0) AS c, CASE WHEN claimed IS NOT NULL OR held THEN 0 ELSE modelled END AS m FROM u),
    x AS (SELECT *, sum(m) OVER k AS sm, greatest(0, total - sum(c) OVER k) AS rest FROM v WINDOW k AS (PARTITION BY scenario, sample)),
    z AS (SELECT scenario, sample, appliance, total, c + m * CASE WHEN sm > 0 THEN least(1, rest / sm) ELSE 0 END AS watts FROM x)"""


def _merged(spark, sf):
    t = contributions(spark, sf).groupBy("scenario", "sample", "appliance").agg(F.sum("p").alias("modelled"))
    t = t.withColumns({"claimed": F.when(F.col("appliance") == 1, F.col("modelled") / 2), "held": F.col("appliance") == 2, "total": 0.6 * F.sum("modelled").over(Window.partitionBy("scenario", "sample"))})
    return J.merge(t, ["scenario", "sample"], "total", "claimed", "modelled", "held")


@query(f"WITH {_TICKS} SELECT scenario, sample, appliance, round(watts, 6) AS watts FROM z")
def j12_merged(spark, sf):
    return _merged(spark, sf).select("scenario", "sample", "appliance", F.round("watts", 6).alias("watts"))


@query(f"WITH {_TICKS} SELECT scenario, sample, round(max(total) - sum(watts), 5) AS residual, round(CASE WHEN abs(max(total)) <= 1 THEN 1 ELSE greatest(0, least(1, 1 - abs(max(total) - sum(watts)) / abs(max(total)))) END, 5) AS explained FROM z GROUP BY scenario, sample")
def j13_residual(spark, sf):
    r = J.residual(_merged(spark, sf), ["scenario", "sample"], "total", "watts")
    return r.select("scenario", "sample", F.round("residual", 5).alias("residual"), F.round("explained", 5).alias("explained"))


#: Ticks of a meter: each event type is a device, on above 50 W; every third on-state has a claim five samples old.
_STATE = "st AS (SELECT rid, event_type AS device, i AS \"at\", (p > 50)::INT AS state, CASE WHEN p > 50 AND i % 3 = 0 THEN (i - 5)::DOUBLE END AS since, p AS watts FROM readings)"
_STATE_EDGES = "ev AS (SELECT rid, event_type AS device, i AS \"at\", 1 AS mine FROM readings WHERE p > 70 AND i % 2 = 0 UNION ALL SELECT rid, NULL, i, 0 FROM readings WHERE p < 20)"


def _states(spark, sf):
    r = readings(spark, sf)
    on = F.col("p") > 50
    return r.select("rid", F.col("event_type").alias("device"), F.col("i").alias("at"), on.cast("int").alias("state"), F.when(on & (F.col("i") % 3 == 0), (F.col("i") - 5).cast("double")).alias("since"), F.col("p").alias("watts"))


@query(f"""WITH {_STATE}, {_STATE_EDGES}, mv AS (SELECT * FROM (SELECT *, coalesce(lag(state) OVER (PARTITION BY rid, device ORDER BY "at"), 0) AS b FROM st) WHERE state <> b),
    num AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY "at", mine, device NULLS FIRST) AS n FROM ev), seen AS (SELECT mv.rid, mv.device, mv."at", count(num.n) AS seen FROM mv LEFT JOIN num ON num.rid = mv.rid AND num."at" <= mv."at" GROUP BY ALL),
    e AS (SELECT mv.rid, mv.device, mv."at", max(num."at") AS t, max(num.n) AS n FROM mv JOIN num ON num.rid = mv.rid AND num.device = mv.device AND num."at" <= mv."at" GROUP BY ALL)
    SELECT mv.rid, mv.device, mv."at", mv.state, (CASE WHEN mv.state = 0 THEN mv."at" - 2.5 ELSE coalesce(mv.since, CASE WHEN mv."at" - e.t < 11 AND seen.seen - e.n < 12 THEN e.t END, mv."at" - 2.5) END)::DOUBLE AS switched
    FROM mv LEFT JOIN seen USING (rid, device, "at") LEFT JOIN e USING (rid, device, "at")""")
def j14_transitions(spark, sf):
    """On and off of every device: the claim's time, else a recent matching edge, else half a window back."""
    s = _states(spark, sf)
    found = readings(spark, sf).where("p > 70 and i % 2 = 0").select("rid", F.col("event_type").alias("device"), F.col("i").alias("at"))
    others = readings(spark, sf).where("p < 20").select("rid", F.col("i").alias("at"))
    return J.switch_times(s, found, 5.0, others=others)


@query("""WITH t AS (SELECT rid, i AS "at", p AS total, q AS residual, i % 11 = 0 AS settling FROM readings), c AS (SELECT *, abs(residual) > greatest(5, 0.15 * abs(total)) AND NOT settling AS c, lead("at") OVER w AS nx FROM t WINDOW w AS (PARTITION BY rid ORDER BY "at")),
    r AS (SELECT *, sum((c AND NOT b)::INT) OVER (PARTITION BY rid ORDER BY "at") AS run FROM (SELECT *, coalesce(lag(c) OVER (PARTITION BY rid ORDER BY "at"), false) AS b FROM c)), f AS (SELECT *, min("at") OVER (PARTITION BY rid, run) AS f FROM r WHERE c)
    SELECT rid, f AS since, min("at") FILTER ("at" - f >= 4) AS detected, max(struct_pack(a := "at", n := nx)).n AS cleared, arg_max(residual, "at") AS typical_w FROM f GROUP BY rid, run, f HAVING min("at") FILTER ("at" - f >= 4) IS NOT NULL""")
def j15_unknown_load(spark, sf):
    """Residual above max(5 W, 15 % of the total) for four samples, but not while settling."""
    t = readings(spark, sf).select("rid", F.col("i").alias("at"), F.col("p").alias("total"), F.col("q").alias("residual"), (F.col("i") % 11 == 0).alias("settling"))
    return J.unknown_load(t, persist=4, least_w=5.0)


@query("""WITH x AS (SELECT rid, i, p, min((abs(p) > 40)::INT) OVER b = 1 AND count(*) OVER b = 2 AS on2, min((abs(p) < 30)::INT) OVER b = 1 AND count(*) OVER b = 2 AS off2, abs(p) < 30 AS q FROM readings WINDOW b AS (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING)),
    y AS (SELECT *, coalesce(max(q::INT) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS led FROM x),
    f AS (SELECT *, min(CASE WHEN on2 AND led THEN i END) OVER (PARTITION BY rid) AS f FROM y), g AS (SELECT *, min(CASE WHEN off2 AND i > f THEN i END) OVER (PARTITION BY rid) AS t FROM f)
    SELECT rid, i, CASE WHEN f IS NULL OR i < f THEN 'lead' WHEN i >= t THEN 'tail' ELSE 'run' END AS part, q AS quiet FROM g""")
def j16_segments(spark, sf):
    """A quiet sample, then two in a row above 40 W begin the run; two quiet ones in a row end it."""
    return J.segments(readings(spark, sf), off_w=30.0, on_w=40.0, off_hold=1, on_hold=2, tail_hold=2).select("rid", "i", "part", "quiet")


@query(f"""WITH {_STATE}, l AS (SELECT rid, max("at") AS now FROM st GROUP BY rid), o AS (SELECT rid, device, max(CASE WHEN state = 0 THEN "at" END) AS off, max("at") AS last, arg_max(state, "at") AS state, arg_max(watts, "at") AS watts FROM st GROUP BY rid, device)
    SELECT o.rid, o.device, (SELECT min(st."at") FROM st WHERE st.rid = o.rid AND st.device = o.device AND st."at" > coalesce(o.off, -1)) AS since, o.watts FROM o JOIN l ON o.rid = l.rid AND o.last = l.now WHERE o.state = 1""")
def j17_snapshot(spark, sf):
    """Devices on at each meter's last tick, since when, and their watts."""
    return J.snapshot(_states(spark, sf))[0]


@query(f"""WITH {_STATE} SELECT rid, device, "at", state, watts FROM (SELECT *, dense_rank() OVER (PARTITION BY rid ORDER BY "at" DESC) AS r FROM st) WHERE r <= 20""")
def j17_history(spark, sf):
    """The last 20 ticks of every meter."""
    return J.snapshot(_states(spark, sf), ticks=20)[1].select("rid", "device", "at", "state", "watts")


@query("SELECT event_id, p FROM readings WHERE ts >= (SELECT max(ts) - INTERVAL 2 DAY FROM events) ORDER BY ts DESC, event_id DESC LIMIT 120")
def j18_recent_events(spark, sf):
    r = readings(spark, sf)
    since = r.agg(F.max("ts") - F.expr("interval 2 days")).first()[0]
    return r.where(F.col("ts") >= F.lit(since)).orderBy(F.desc("ts"), F.desc("event_id")).limit(120).select("event_id", "p")


# Composed scenarios ---------------------------------------------------------------------------


def _plan(spark, sf):
    """(scenario, family): two scenarios for each recording, repaired until every family is in enough of them."""
    r = readings(spark, sf)
    names = [x[0] for x in r.select("event_type").distinct().orderBy("event_type").collect()]
    n = max(12, 2 * r.select("rid").distinct().count())
    return I.covered(I.plan(spark, names, n, 2, 3, 7), names, n, 3)


#: The same plan, its repair one change a step: the first family in too few scenarios goes into the shortest scenario without it.
_PLAN = f"""names AS (SELECT list_sort(list(DISTINCT event_type)) AS names FROM readings),
    drawn AS (SELECT s AS scenario, f AS family, 2 + floor({sql_chance(7, 's')} * 2) AS size, row_number() OVER (PARTITION BY s ORDER BY {sql_chance(8, 's', 'f')}, f) AS r FROM (SELECT unnest(range(greatest(12, (SELECT 2 * count(DISTINCT rid) FROM readings)))) AS s), (SELECT DISTINCT event_type AS f FROM readings)),
    repair AS (SELECT 0 AS n, (SELECT list(struct_pack(k := scenario, fs := fs) ORDER BY scenario) FROM (SELECT scenario, list(family) AS fs FROM drawn WHERE r <= size GROUP BY scenario)) AS v, names FROM names UNION ALL
    SELECT n + 1, list_transform(v, lambda s: CASE WHEN s.k <> k THEN s ELSE struct_pack(k := s.k, fs := list_append(CASE WHEN len(s.fs) < 3 THEN s.fs ELSE list_filter(s.fs, lambda x: x <> d) END, f)) END), names FROM (
        SELECT *, list_max(list_transform(list_filter(v, lambda s: s.k = k)[1].fs, lambda x: struct_pack(c := len(list_filter(v, lambda s: list_contains(s.fs, x))), x := x))).x AS d FROM (
        SELECT *, list_min(list_transform(list_filter(v, lambda s: NOT list_contains(s.fs, f)), lambda s: struct_pack(l := len(s.fs), k := s.k))).k AS k FROM (
        SELECT *, list_min(list_filter(names, lambda x: len(list_filter(v, lambda s: list_contains(s.fs, x))) < 4)) AS f FROM repair WHERE n < 40) WHERE f IS NOT NULL))),
    planned AS (SELECT x.k AS scenario, unnest(x.fs) AS family FROM (SELECT unnest(v) AS x FROM repair WHERE n = (SELECT max(n) FROM repair)))"""
_CHOSEN = f"""{_PLAN}, pools AS (SELECT event_type AS family, list_sort(list(DISTINCT rid)) AS rids FROM readings GROUP BY event_type),
    uses AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY {sql_chance(7, 'scenario', 'family')}, scenario) - 1 AS use FROM planned),
    chosen AS (SELECT scenario, family, rids[1 + use % len(rids)] AS rid FROM uses JOIN pools USING (family))"""
_BLOCKS = f"""{_CHOSEN}, blocks AS (SELECT *, CASE WHEN "on" THEN floor(30 + 90 * {sql_chance(8, 'scenario', 'family', 'block')}) ELSE floor(15 + 75 * {sql_chance(9, 'scenario', 'family', 'block')}) END::BIGINT AS length FROM (
        SELECT scenario, family, block, (block % 2 = 0) = ({sql_chance(7, 'scenario', 'family')} < 0.6) AS "on" FROM chosen, range(43) b(block))),
    cut AS (SELECT * FROM (SELECT *, sum(length) OVER (PARTITION BY scenario, family ORDER BY block) - length AS start FROM blocks) WHERE start < 600),
    schedule AS (SELECT scenario, family, start::BIGINT AS start, CASE WHEN forced THEN least(start + length, 45) ELSE start + length END::BIGINT AS "end", "on" OR forced AS "on" FROM (SELECT *, NOT bool_or("on") OVER (PARTITION BY scenario, family) AND block = 0 AS forced FROM cut))"""


@query(f"WITH RECURSIVE {_PLAN} SELECT scenario, family, n_samples FROM planned JOIN (SELECT event_type AS family, count(*) AS n_samples FROM readings GROUP BY event_type) USING (family)")
def i3_i4_plan(spark, sf):
    real = readings(spark, sf).groupBy(F.col("event_type").alias("family")).agg(F.count("*").alias("n_samples"))
    return _plan(spark, sf).join(real, "family")


def _chosen(spark, sf):
    return I.choose(_plan(spark, sf), I.pool(readings(spark, sf).withColumnRenamed("event_type", "family")), 7)


@query(f"WITH RECURSIVE {_CHOSEN} SELECT * FROM chosen")
def i5_variant(spark, sf):
    return _chosen(spark, sf)


@query("""WITH n AS (SELECT rid, count(*) AS n FROM readings GROUP BY rid), s AS (SELECT rid, n, unnest(range(0, 120)) AS sample FROM n)
    SELECT s.rid, s.sample, r.p FROM s JOIN readings r ON r.rid = s.rid AND r.i = s.sample % s.n""")
def i6_looped(spark, sf):
    r = readings(spark, sf).select("rid", "i", "p")
    chosen = r.select("rid").distinct().withColumn("scenario", F.lit(0))
    return I.tiled(chosen, r, 120).select("rid", F.col("sample").cast("long").alias("sample"), "p")


@query(f'WITH RECURSIVE {_BLOCKS} SELECT scenario, family, start, "end", "on" FROM schedule')
def i7_schedule(spark, sf):
    return I.schedule(_chosen(spark, sf), 600, 1.0, 7)


def voices(spark, sf):
    """(voice, mag, ang): the spectrum of every family, of which there are a handful."""
    families = readings(spark, sf).select(F.col("event_type").alias("voice")).distinct().withColumn("vec_id", _vector("voice"))
    return families.join(spectra(spark, sf).select("vec_id", "mag", "ang"), "vec_id").select("voice", "mag", "ang")


def _vector(family):
    return F.pmod(F.xxhash64(family), F.lit(100))


#: Samples of a scenario.
SAMPLES = 600


def scenario_takes(spark, sf, n: int = SAMPLES, draw: int | None = None):
    """A row for each device of a scenario: its recording, schedule, phase and ``voice``. Stored, so samples can be made again for each pass.

    ``draw``: with the scenario's hash of that seed.
    """
    chosen = _chosen(spark, sf)
    folder = shared_folder(spark, "takes")
    t = I.takes(chosen, readings(spark, sf).select("rid", "i", "p", "q"), I.schedule(chosen, n, 1.0, 7), n)
    t = t.withColumns({"phase": _vector("family") % 4, "voice": F.col("family")} | ({} if draw is None else {"draw": chance(draw, "scenario")}))
    t.write.parquet(folder)
    return spark.read.schema(t.schema).parquet(folder)


def scenario_parts(spark, sf, n: int = SAMPLES):
    """Chosen recordings looped, masked by their schedules, on a phase and with the ``voice`` of their family."""
    stored = scenario_takes(spark, sf, n)
    return I.played(stored, n, stored.count()).select("scenario", "family", "sample", "p", "q", "phase", "voice", "lit", "state")


@query(f"""WITH RECURSIVE {_BLOCKS}, n AS (SELECT rid, count(*) AS n FROM readings GROUP BY rid),
    x AS (SELECT scenario, family, sample, p, q FROM (SELECT *, unnest(range(600)) AS sample FROM chosen JOIN n USING (rid)) s JOIN readings r ON r.rid = s.rid AND r.i = s.sample % s.n),
    y AS (SELECT x.*, s.start IS NOT NULL AS active FROM x LEFT JOIN schedule s ON s.scenario = x.scenario AND s.family = x.family AND s."on" AND x.sample >= s.start AND x.sample < s."end")
    SELECT scenario, sample, round(sum(CASE WHEN active THEN p ELSE 0 END), 6) AS p_total, round(sum(CASE WHEN active THEN q ELSE 0 END), 6) AS q_total, count(*) FILTER (active AND abs(p) > 3) AS n_on FROM y GROUP BY scenario, sample""")
def i8_i9_mixed(spark, sf):
    """Chosen recordings looped, masked by their schedules, and added up per sample."""
    m = scenario_parts(spark, sf)
    return m.groupBy("scenario", "sample").agg(F.round(F.sum("p"), 6).alias("p_total"), F.round(F.sum("q"), 6).alias("q_total"), F.count_if(F.col("state") == "on").alias("n_on"))


@query()
def a9_i9_scenarios(spark, sf):
    """Scenarios with spectra and truth written to the store, and what the stored tables say of each."""
    folder = shared_folder(spark, "scenarios")
    I.write_scenarios(scenario_parts(spark, sf), folder, 1.0, seed=7, voices=voices(spark, sf))
    t = I.read_scenarios(spark, folder)
    return M.summary(t["readings"]).join(t["recordings"], "scenario").join(t["manifest"].select("scenario", "families", "p_peak"), "scenario")


# Exploration ----------------------------------------------------------------------------------


@query("SELECT rid, i AS \"at\", round(dp, 6) AS dp FROM (SELECT rid, i, p - lag(p) OVER (PARTITION BY rid ORDER BY i) AS dp FROM readings) WHERE abs(dp) >= 40")
def k1_hart_edges(spark, sf):
    return X.hart_edges(readings(spark, sf)).select("rid", "at", F.round("dp", 6).alias("dp"))


@query("""WITH g AS (SELECT rid, i, CASE WHEN lag(p) OVER w IS NULL THEN lead(p) OVER w - p WHEN lead(p) OVER w IS NULL THEN p - lag(p) OVER w ELSE (lead(p) OVER w - lag(p) OVER w) / 2 END AS dp FROM readings WINDOW w AS (PARTITION BY rid ORDER BY i)),
    s AS (SELECT *, abs(dp) >= 20 AS s, lag(abs(dp) >= 20) OVER w AS b, lag(dp) OVER w AS before FROM g WINDOW w AS (PARTITION BY rid ORDER BY i)),
    r AS (SELECT *, sum(CASE WHEN (s AND NOT coalesce(b, false)) OR sign(dp) <> sign(before) THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM s),
    x AS (SELECT rid, run, max(struct_pack(a := abs(dp), o := -i, d := dp)) AS x FROM r WHERE s GROUP BY rid, run) SELECT rid, -(x.o) AS "at", round(x.d, 6) AS dp FROM x""")
def k1_central_edges(spark, sf):
    """Steep stretches of the central difference, each at its steepest sample."""
    return X.central_edges(readings(spark, sf), 20.0).select("rid", "at", F.round("dp", 6).alias("dp"))


@query("""WITH c AS (SELECT rid, i, sum(p - 50 - 5) OVER w AS u, sum(p - 50 + 5) OVER w AS d FROM readings WINDOW w AS (PARTITION BY rid ORDER BY i ROWS UNBOUNDED PRECEDING))
    SELECT rid, i, round(u - least(0, min(u) OVER w), 4) AS up, round(greatest(0, max(d) OVER w) - d, 4) AS down FROM c WINDOW w AS (PARTITION BY rid ORDER BY i ROWS UNBOUNDED PRECEDING)""")
def k2_cusum(spark, sf):
    return X.cusum(readings(spark, sf), 50.0, 5.0).select("rid", "i", F.round("cusum_up", 4).alias("up"), F.round("cusum_down", 4).alias("down"))


@query("""WITH RECURSIVE walk AS (SELECT rid, i, 0.0::DOUBLE AS up, 0.0::DOUBLE AS down, p AS level, false AS hit FROM readings WHERE i = 0 UNION ALL
    SELECT rid, i, CASE WHEN hit THEN 0.0 ELSE u END, CASE WHEN hit THEN 0.0 ELSE d END, CASE WHEN hit THEN p ELSE level END, hit FROM (SELECT *, u > 120 OR d > 120 AS hit FROM (
    SELECT r.rid, r.i, r.p, walk.level, greatest(0.0, walk.up + r.p - walk.level - 5) AS u, greatest(0.0, walk.down + walk.level - r.p - 5) AS d FROM walk JOIN readings r ON r.rid = walk.rid AND r.i = walk.i + 1)))
    SELECT rid, i AS "at" FROM walk WHERE hit""")
def k2_cusum_events(spark, sf):
    return X.cusum_events(readings(spark, sf), 120.0, 5.0)


_TRUE = "true_ev AS (SELECT rid, i AS \"at\", dp FROM (SELECT rid, i, p - lag(p) OVER w AS dp, p > 50 AS s, lag(p > 50) OVER w AS b FROM readings WINDOW w AS (PARTITION BY rid ORDER BY i)) WHERE s <> b AND abs(dp) >= 50)"


def _true(spark, sf):
    return X.true_events(readings(spark, sf).withColumn("s", F.col("p") > 50), "s")


@query(f"WITH {_TRUE} SELECT rid, \"at\", round(dp, 6) AS dp FROM true_ev")
def k3_true_events(spark, sf):
    return _true(spark, sf).select("rid", "at", F.round("dp", 6).alias("dp"))


#: Events in order of time; those that wait for one of the other kind are carried along.
_WALK = """ev AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY "at", kind) AS n FROM (SELECT rid, i AS "at", 0 AS kind FROM hart UNION ALL SELECT rid, "at", 1 FROM true_ev)),
    walk AS (SELECT DISTINCT rid, 0::BIGINT AS n, []::BIGINT[] AS q, 0 AS k, NULL::BIGINT AS d FROM ev UNION ALL
    SELECT rid, n, CASE WHEN len(live) > 0 AND k <> kind THEN live[2:] ELSE list_append(live, "at") END, CASE WHEN len(live) > 0 AND k <> kind THEN k ELSE kind END, CASE WHEN len(live) > 0 AND k <> kind THEN "at" - live[1] END
    FROM (SELECT ev.rid, ev.n, ev."at", ev.kind, walk.k, list_filter(walk.q, lambda x: ev."at" - x <= 1) AS live FROM walk JOIN ev ON ev.rid = walk.rid AND ev.n = walk.n + 1))"""
_HART = "hart AS (SELECT * FROM (SELECT rid, i, p - lag(p) OVER (PARTITION BY rid ORDER BY i) AS dp, ts FROM readings) WHERE abs(dp) >= 40)"


@query(f"""WITH RECURSIVE {_TRUE}, {_HART}, {_WALK}
    SELECT n_found, n_true, tp, round(tp / n_found, 6) AS precision, round(tp / n_true, 6) AS recall, round(2 * tp / (n_found + n_true), 6) AS f1, round(timing, 6) AS timing
    FROM (SELECT count(d) AS tp, avg(d) AS timing FROM walk), (SELECT count(*) AS n_found FROM hart), (SELECT count(*) AS n_true FROM true_ev)""")
def k4_event_scores(spark, sf):
    s = X.event_scores(X.hart_edges(readings(spark, sf)), _true(spark, sf), 1)
    return s.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1", "timing")})


@query(f"""WITH {_HART} SELECT rid, t AS start, n AS "end", round(dp, 6) AS dp FROM (SELECT rid, i AS t, dp, lead(i) OVER w AS n, lead(dp) OVER w AS nd FROM hart WINDOW w AS (PARTITION BY rid ORDER BY i)) WHERE dp > 0 AND nd < 0""")
def k5_paired_edges(spark, sf):
    return X.paired_edges(X.hart_edges(readings(spark, sf))).select("rid", "start", "end", F.round("dp", 6).alias("dp"))


@query("""WITH ch AS (SELECT rid, 'p' || k AS phase, i, CASE k WHEN 1 THEN p1 WHEN 2 THEN p2 ELSE p3 END AS v FROM phases, range(1, 4) r(k)),
    e AS (SELECT * FROM (SELECT rid, phase, i, v - lag(v) OVER (PARTITION BY rid, phase ORDER BY i) AS dp FROM ch) WHERE abs(dp) >= 12.3457)
    SELECT rid, phase, i AS start, n AS "end", round(dp, 6) AS dp FROM (SELECT *, lead(i) OVER w AS n, lead(dp) OVER w AS nd FROM e WINDOW w AS (PARTITION BY rid, phase ORDER BY i)) WHERE dp > 0 AND nd < 0""")
def k5_phase_pairs(spark, sf):
    """Edges of every phase by itself, each on-edge with the next edge of its phase."""
    long = phases(spark, sf).select("rid", "i", "p1", "p2", "p3").unpivot(["rid", "i"], ["p1", "p2", "p3"], "phase", "v")
    found = X.hart_edges(long, 12.3457, ["rid", "phase"], p="v")
    return X.paired_edges(found, ["rid", "phase"]).select("rid", "phase", "start", "end", F.round("dp", 6).alias("dp"))


@query(f"""WITH {_EDGES}, d AS (SELECT *, (sqrt(power(sign * dp - kp, 2) + power(sign * dq - kq, 2)) / greatest(20.0, 0.35 * sqrt(kp * kp + kq * kq)))::DECIMAL(18, 9) AS d FROM (SELECT *, CASE WHEN dp < 0 THEN -1 ELSE 1 END AS sign FROM edges), {_KNOWN}),
    b AS (SELECT *, row_number() OVER (PARTITION BY rid, i ORDER BY d, family) AS r FROM d), g AS (SELECT rid, family, "at", max(struct_pack(m := abs(dp), s := dp)).s AS dp FROM b WHERE r = 1 AND abs(dp) >= 8 - 1e-9 AND d < 1 AND round(1 - d, 2) >= 0.25 GROUP BY ALL)
    SELECT rid, family, "at" AS start, n AS "end", round(dp, 5) AS dp FROM (SELECT *, lead("at") OVER w AS n, lead(dp) OVER w AS nd FROM g WINDOW w AS (PARTITION BY rid, family ORDER BY "at")) WHERE dp > 0 AND nd < 0""")
def k5_device_pairs(spark, sf):
    """Matched edges, each on-edge with the next edge of its device; of edges at one sample the largest."""
    found = J.match(_edges(spark, sf), KNOWN).where("family is not null").groupBy("rid", "family", "at").agg(F.max(F.struct(F.abs("dp").alias("m"), F.col("dp").alias("s")))["s"].alias("dp"))
    return X.paired_edges(found, ["rid", "family"]).select("rid", "family", "start", "end", F.round("dp", 5).alias("dp"))


@query("SELECT family, count(*) AS n, round(median(p), 6) AS p_med, round(median(q), 6) AS q_med, round(stddev_pop(p), 5) AS p_std FROM (SELECT event_type AS family, p, q FROM readings WHERE abs(p) > 3) GROUP BY family")
def k6_fingerprints(spark, sf):
    f = X.fingerprints(readings(spark, sf).withColumnRenamed("event_type", "family"))
    return f.select("family", "n", F.round("p_med", 6).alias("p_med"), F.round("q_med", 6).alias("q_med"), F.round("p_std", 5).alias("p_std"))


@query("""WITH e AS (SELECT rid, i AS t FROM (SELECT rid, i, p - lag(p) OVER (PARTITION BY rid ORDER BY i) AS dp FROM readings) WHERE dp >= 40)
    SELECT e.rid, e.t AS "at", max(p) AS peak, round(median(p), 6) AS steady, arg_max(r.i, p) - e.t AS rise, round(stddev_pop(p), 5) AS spread, round(max(p) / median(p), 8) AS inrush FROM e JOIN readings r ON e.rid = r.rid AND r.i BETWEEN e.t AND e.t + 4 GROUP BY e.rid, e.t""")
def k7_transients(spark, sf):
    r = readings(spark, sf)
    t = X.transients(r, X.hart_edges(r), 5)
    return t.select("rid", "at", "peak", F.round("steady", 6).alias("steady"), "rise", F.round("spread", 5).alias("spread"), F.round("inrush", 8).alias("inrush"))


@query(f"""WITH {_HART} SELECT rid, i AS "at", round(dp, 6) AS dp, hour(ts) AS hour, isodow(ts) AS day, round((epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1e6, 3) AS since_s,
    CASE WHEN dp > 0 AND lead(dp) OVER w < 0 THEN round((lead(epoch_us(ts)) OVER w - epoch_us(ts)) / 1e6, 3) END AS on_s FROM hart WINDOW w AS (PARTITION BY rid ORDER BY i)""")
def k8_context(spark, sf):
    r = readings(spark, sf)
    return X.event_context(X.hart_edges(r), r).withColumns({"dp": F.round("dp", 6), "since_s": F.round("since_s", 3), "on_s": F.round("on_s", 3)})


@query("SELECT hour(ts) AS hour, count(*) AS n, round(avg(q), 6) AS p_mean, round(avg((q < 0)::INT), 6) AS share_negative FROM readings GROUP BY hour(ts)")
def k11_diurnal(spark, sf):
    d = X.diurnal(readings(spark, sf), p="q")
    return d.select("hour", "n", F.round("p_mean", 6).alias("p_mean"), F.round("share_negative", 6).alias("share_negative"))


@query("SELECT round(corr(p, a), 8) AS lag_1, round(corr(p, b), 8) AS lag_5 FROM (SELECT p, lag(p, 1) OVER w AS a, lag(p, 5) OVER w AS b FROM readings WINDOW w AS (PARTITION BY rid ORDER BY i))")
def k12_autocorrelation(spark, sf):
    a = X.autocorrelation(readings(spark, sf), [1, 5])
    return a.select(F.round("lag_1", 8).alias("lag_1"), F.round("lag_5", 8).alias("lag_5"))


@query("""WITH x AS (SELECT rid, i // 32 AS c, i % 32 AS o, p - avg(p) OVER (PARTITION BY rid, i // 32) AS v FROM readings),
    r AS (SELECT a.rid, b.o - a.o AS lag, sum(a.v * b.v) AS r FROM x a JOIN x b ON a.rid = b.rid AND a.c = b.c AND b.o - a.o BETWEEN 0 AND 16 GROUP BY ALL),
    f AS (SELECT *, min(CASE WHEN r < 0 THEN lag END) OVER (PARTITION BY rid) AS first, max(CASE WHEN lag = 0 THEN r END) OVER (PARTITION BY rid) AS whole FROM r),
    b AS (SELECT rid, max(whole) AS whole, max(struct_pack(r := r, lag := -lag)) FILTER (lag >= first) AS x FROM f GROUP BY rid)
    SELECT rid, CASE WHEN x.r > 0 THEN -(x.lag) END AS period, CASE WHEN x.r > 0 THEN round(x.r / whole, 6) END AS strength FROM b""")
def k12_periods(spark, sf):
    """Dominant period of every recording, of lags up to half a chunk of 32 samples."""
    return X.periods(readings(spark, sf), 32).select("rid", "period", F.round("strength", 6).alias("strength"))


@query()
def k9_agglomerative(spark, sf):
    """Ward merging of 64 small clusters over all samples, four left."""
    rows = X.agglomerated(readings(spark, sf).select("rid", "i", "p", "q"), ["p", "q"], 4)
    return rows.groupBy("cluster").agg(F.count("*").alias("n"), F.avg("p").alias("p_mean"), F.avg("q").alias("q_mean"))


@query("""WITH n AS (SELECT family AS l, pred AS c, count(*)::DOUBLE AS n FROM predictions GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY l) AS a, sum(n) OVER (PARTITION BY c) AS b, sum(n) OVER () AS t FROM n),
    s AS (SELECT sum(n / t * ln(n * t / (a * b))) AS mi, sum(-n / t * ln(a / t)) AS hl, sum(-n / t * ln(b / t)) AS hc, sum(n * (n - 1) / 2) AS i, sum((a - 1) / 2 * n) AS a2, sum((b - 1) / 2 * n) AS b2, max(t) AS t FROM t)
    SELECT round((i - a2 * b2 / (t * (t - 1) / 2)) / ((a2 + b2) / 2 - a2 * b2 / (t * (t - 1) / 2)), 6) AS ari, round(mi / ((hl + hc) / 2), 6) AS nmi, round(mi / hl, 6) AS homogeneity, round(mi / hc, 6) AS completeness FROM s""")
def k9_cluster_scores(spark, sf):
    s = X.contingency_scores(predictions(spark, sf), "family", "pred")
    return s.select(*[F.round(c, 6).alias(c) for c in ("ari", "nmi", "homogeneity", "completeness")])


def _clusters(spark, sf, kind):
    rows, _ = X.clustered(readings(spark, sf).select("rid", "i", "p", "q"), ["p", "q"], 4, kind)
    return rows.groupBy("cluster").agg(F.count("*").alias("n"), F.avg("p").alias("p_mean"), F.avg("q").alias("q_mean"))


@query()
def k9_clusters(spark, sf):
    return _clusters(spark, sf, "kmeans")


@query()
def k9_mixtures(spark, sf):
    return _clusters(spark, sf, "gmm")


@query()
def k9_bisecting(spark, sf):
    return _clusters(spark, sf, "bisecting")


@query()
def k9_cluster_quality(spark, sf):
    """Each kind of clustering over the spectra, held against the labels that they come with."""
    s = spectra(spark, sf)
    orders = s.select("label", *[(F.get("ang", F.lit(k)) / 3.0).alias(f"h{k + 2}") for k in range(39)])
    out = None
    for kind in ("kmeans", "gmm", "bisecting"):
        rows, silhouette = X.clustered(orders, orders.columns[1:], 10, kind)
        one = X.contingency_scores(rows, "label", "cluster").select(F.lit(kind).alias("kind"), "ari", "nmi", "homogeneity", "completeness", F.lit(silhouette).alias("silhouette"))
        out = one if out is None else out.unionByName(one)
    return out


@query()
def k10_plane(spark, sf):
    return X.principal_plane(readings(spark, sf).select("rid", "i", "p", "q", F.hypot("p", "q").alias("s")), ["p", "q", "s"]).select("rid", "i", "x", "y")
