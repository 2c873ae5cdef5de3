"""Queries of sources, views and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlens.functions import labels as L
from gridlens.functions.electrical import finite
from gridlens.operators import meterpoint, windows
from gridlens.plans.fixtures import contributions, dirty, phases, readings, table
from gridlens.plans.registry import query
from gridlens.sources import ingest


@query("""SELECT rid, i, round(p, 6) AS p, q, round(coalesce(CASE WHEN i % 4 = 0 THEN NULL ELSE 2 * p END, sqrt(p * p + q * q)), 4) AS s,
    round(CASE WHEN coalesce(CASE WHEN i % 4 = 0 THEN NULL ELSE 2 * p END, sqrt(p * p + q * q)) > 1e-6 THEN p / coalesce(CASE WHEN i % 4 = 0 THEN NULL ELSE 2 * p END, sqrt(p * p + q * q)) ELSE 1.0 END, 4) AS pf,
    round(CASE WHEN i % 5 = 0 THEN NULL ELSE p1 END, 4) AS p1 FROM phases""")
def a2_signal_view(spark, sf):
    r = phases(spark, sf).withColumnRenamed("p", "p_total").withColumn("s", F.when(F.col("i") % 4 == 0, F.lit(None).cast("double")).otherwise(2 * F.col("p_total")))
    r = r.withColumn("p3", F.when(F.col("i") % 5 == 0, F.lit(None).cast("double")).otherwise(F.col("p3")))
    v = ingest.signal_view(r)
    return v.select("rid", "i", F.round("p", 6).alias("p"), "q", F.round("s", 4).alias("s"), F.round("pf", 4).alias("pf"), F.round("p1", 4).alias("p1"))


@query("""SELECT o_orderkey AS key, CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45) THEN 'scenario' ELSE 'single' END AS kind FROM orders""")
def a3_classify(spark, sf):
    truth = table(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("key"))
    return ingest.classified(table(spark, sf, "orders").select(F.col("o_orderkey").alias("key")), truth, "key")


@query("""SELECT event_id, coalesce(nullif(CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END, ''),
    nullif(json_extract_string(CASE WHEN event_id % 2 = 0 THEN '{"name": "' || event_type || '_meta"}' ELSE '{}' END, '$.name'), ''), 'unknown') AS label FROM events""")
def a4_label(spark, sf):
    e = table(spark, sf, "events")
    meta = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"name": "'), "event_type", F.lit('_meta"}'))).otherwise("{}")
    return e.select("event_id", L.label_of(F.when(F.col("event_id") % 3 == 0, "").otherwise(F.col("event_type")), meta).alias("label"))


_NAME = "CASE WHEN event_id % 4 = 0 THEN 'test_' ELSE '' END || event_type || '_' || (event_id % 7)"


@query(f"SELECT name, count(*) AS n FROM (SELECT {_NAME} AS name FROM events) WHERE name NOT LIKE 'test_%' GROUP BY name")
def a6_exclude(spark, sf):
    name = F.concat(F.when(F.col("event_id") % 4 == 0, "test_").otherwise(""), "event_type", F.lit("_"), (F.col("event_id") % 7).cast("string"))
    named = table(spark, sf, "events").select(name.alias("name"))
    return ingest.excluded(named, F.col("name"), "test_%").groupBy("name").agg(F.count("*").alias("n"))


@query("""SELECT scenario, string_agg(DISTINCT appliance::VARCHAR, ',' ORDER BY appliance::VARCHAR) AS families, count(DISTINCT sample) AS n_samples, count(DISTINCT sample) / 2.0 AS duration_s, any_value(peak) AS p_peak
    FROM contributions JOIN (SELECT scenario, round(max(abs(p))::DECIMAL(18, 4), 1)::DOUBLE AS peak FROM (SELECT scenario, sample, sum(p) AS p FROM contributions GROUP BY ALL) GROUP BY scenario) USING (scenario) GROUP BY scenario""")
def a13_manifest(spark, sf):
    return meterpoint.manifest(contributions(spark, sf), rate=2.0)


@query("SELECT rid, i, k FROM (SELECT rid, i, greatest(1, ceil(count(*) OVER (PARTITION BY rid) / 20.0))::BIGINT AS k FROM readings) WHERE i % k = 0")
def a15_stride(spark, sf):
    return windows.stride(readings(spark, sf), 20).select("rid", "i", "k")


@query("""SELECT rid, i, k FROM (SELECT rid, i, CASE WHEN n > 30 THEN greatest(1, n // 30) ELSE 1 END AS k FROM
    (SELECT rid, i, count(*) OVER (PARTITION BY rid) AS n FROM readings)) WHERE i % k = 0""")
def a15_stride_live(spark, sf):
    return windows.stride(readings(spark, sf), 30, live=True).select("rid", "i", "k")


@query("SELECT rid, i, c AS v FROM gappy")
def a16_json_safe(spark, sf):
    return dirty(spark, sf).select("rid", "i", finite(F.col("v")).alias("v"))


@query("SELECT sum(p) AS p_sum FROM (SELECT round(sum(p), 2) AS p FROM readings)")
def a17_pruned_scan(spark, sf):
    """One column of the file is read: see ReadSchema in the plan."""
    return table(spark, sf, "events").agg(F.round(F.sum("value"), 2).alias("p_sum"))


_LABEL = """CASE WHEN event_id % 5 = 0 THEN 'test_' ELSE '' END || event_type || CASE event_id % 6 WHEN 0 THEN '_high' WHEN 1 THEN '_level2' WHEN 2 THEN '_on_3' WHEN 3 THEN '__table_fan_slow' WHEN 4 THEN '_20260702_143215' ELSE '' END"""


def _labels(spark, sf):
    k = F.col("event_id") % 6
    tail = F.when(k == 0, "_high").when(k == 1, "_level2").when(k == 2, "_on_3").when(k == 3, "__table_fan_slow").when(k == 4, "_20260702_143215").otherwise("")
    return table(spark, sf, "events").select("event_id", F.concat(F.when(F.col("event_id") % 5 == 0, "test_").otherwise(""), "event_type", tail).alias("label"))


def _family_sql(x: str) -> str:
    plain = f"regexp_replace(regexp_replace(regexp_replace(lower(trim({x})), '_\\d{{8}}_\\d{{6}}$', ''), '_+', '_', 'g'), '^_|_$', '', 'g')"
    # RE2 has no look-ahead: the character after the prefix is captured and put back.
    front = f"regexp_replace({plain}, '^(?:(?:{'|'.join(L.PREFIX_WORDS)})_)+(.)', '\\1')"
    back = f"regexp_replace({front}, '(?:_(?:{'|'.join(L.STATE_WORDS)}|{L.LEVEL}|[0-9]+))+$', '')"
    return f"coalesce(nullif({back}, ''), 'appliance')"


@query(f"SELECT event_id, regexp_replace(label, '_\\d{{8}}_\\d{{6}}$', '') AS stem FROM (SELECT event_id, {_LABEL} AS label FROM events)")
def f1_strip_timestamp(spark, sf):
    return _labels(spark, sf).select("event_id", L.strip_timestamp(F.col("label")).alias("stem"))


@query(f"SELECT event_id, {_family_sql('label')} AS family FROM (SELECT event_id, {_LABEL} AS label FROM events)")
def f2_family(spark, sf):
    return _labels(spark, sf).select("event_id", L.family(F.col("label")).alias("family"))


@query(f"""SELECT event_id, array_to_string(list_transform(string_split(regexp_replace(lower(trim(label)), '_\\d{{8}}_\\d{{6}}$', ''), '__'), lambda x: {_family_sql('x')}), '|') AS families
    FROM (SELECT event_id, {_LABEL} AS label FROM events)""")
def f3_families(spark, sf):
    return _labels(spark, sf).select("event_id", F.array_join(L.families(F.col("label")), "|").alias("families"))


@query(f"SELECT event_id, contains(regexp_replace(label, '_\\d{{8}}_\\d{{6}}$', ''), '__') AS mixed FROM (SELECT event_id, {_LABEL} AS label FROM events)")
def f4_is_mixed(spark, sf):
    return _labels(spark, sf).select("event_id", L.is_mixed(F.col("label")).alias("mixed"))


@query(f"SELECT DISTINCT {_family_sql('label')} AS family FROM (SELECT event_id, {_LABEL} AS label FROM events)")
def f5_vocabulary(spark, sf):
    return _labels(spark, sf).select(L.family(F.col("label")).alias("family")).distinct().orderBy("family")


@query(f"SELECT event_id, regexp_replace(label, '_[^_]*$', '') AS base FROM (SELECT event_id, {_LABEL} AS label FROM events)")
def f6_without_instance(spark, sf):
    return _labels(spark, sf).select("event_id", L.without_instance(F.col("label")).alias("base"))


@query(f"""SELECT event_id, list_reduce(list_prepend(5381::BIGINT, list_transform(string_split(label, ''), lambda x: ascii(x)::BIGINT)), lambda h, c: (h * 33 + c) & 4294967295) AS h
    FROM (SELECT event_id, {_LABEL} AS label FROM events)""")
def f7_djb2(spark, sf):
    return _labels(spark, sf).select("event_id", L.djb2(F.col("label")).alias("h"))


@query("SELECT event_id, coalesce(nullif(regexp_replace(regexp_replace(lower(event_type || props), '[^a-z0-9_-]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'appliance') AS safe FROM events")
def f8_safe_label(spark, sf):
    return table(spark, sf, "events").select("event_id", L.safe_label(F.concat("event_type", "props")).alias("safe"))


@query("SELECT event_id, CASE WHEN abs(value) > 3.0 THEN 'on' ELSE 'off' END AS state FROM events")
def f9_state(spark, sf):
    return table(spark, sf, "events").select("event_id", L.is_on(F.col("value")).alias("state"))
