"""Queries of trained models and streams. Forests are small; scores are of held-out scenarios."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from gridlens.operators import follow, mixes, network
from gridlens.operators import models as G
from gridlens.operators import windows as E
from gridlens.operators.registry import Mix, ModelRegistry
from gridlens.operators.retrain import FEATURES as MIX_FEATURES
from gridlens.operators.retrain import fit_mix, retrain
from gridlens.operators.score import macro_f1
from gridlens.plans.events import SAMPLES, scenario_parts, scenario_takes, voices
from gridlens.plans.fixtures import phases, readings, table
from gridlens.plans.registry import query, sql_chance
from gridlens.sources.store import shared_folder
from gridlens.streaming import live

FEATURES = ["p_mean", "p_std", "p_min", "p_max", "q_mean", "qp", "s"]
WINDOW = 10


def _features(spark, sf):
    f = E.aggregate_features(E.tumbling(phases(spark, sf), 5))
    return f.withColumn("family", F.when(F.col("p_mean") > 60, "boiler").when(F.col("p_mean") > 40, "lamp").otherwise("fan"))


def _names(spark, sf):
    """The families: a handful."""
    return [r[0] for r in readings(spark, sf).select("event_type").distinct().orderBy("event_type").collect()]


def _split(rows, label):
    """(train, test) of stored rows by scenario. A scenario's hash is drawn once, with its takes."""
    folder = shared_folder(rows.sparkSession, label)
    rows.write.parquet(folder)
    return G.grouped_split(rows.sparkSession.read.schema(rows.schema).parquet(folder), "scenario", 0.3, 5, "draw")


def _takes(spark, sf):
    return scenario_takes(spark, sf, draw=5)


def _windows(spark, sf, alone: bool = False):
    """(train, test) by scenario: windows at the meter point of the composed scenarios, with what each family truly drew.

    ``alone``: each device metered by itself, its active windows with the ``family``. No label is
    made of a feature: the truth is of the devices, the features are of their sum.
    """
    rows = mixes.window_features(_takes(spark, sf), voices(spark, sf), _names(spark, sf), SAMPLES, WINDOW, alone)
    return _split(rows.where(F.abs("p_mean") > 5) if alone else rows, "windows")


def _by_family(scored, names, values):
    """(scenario, win, family, values...) from a column of each value and family."""
    one = lambda f: F.struct(F.lit(f).alias("family"), *[F.col(f"`{c.format(f)}`").cast("double").alias(v) for v, c in values.items()])
    return scored.select("scenario", "win", F.explode(F.array(*map(one, names))).alias("_r")).select("scenario", "win", "_r.*")


@query()
def g1_identify(spark, sf):
    """Which device a window shows, of scenarios that the model has not seen."""
    train, test = _windows(spark, sf, alone=True)
    m = G.identify(train, MIX_FEATURES, trees=20)
    scored = G.best_two(m.transform(test), G.families_of(m), F.abs("p_mean") > 5)
    return scored.select("scenario", "win", "family", "best", "p_best", "second", "p_second")


@query()
def g1_identify_score(spark, sf):
    return macro_f1(g1_identify(spark, sf), "family", "best")


def _power(spark, sf, kind):
    train, test = _windows(spark, sf)
    names = _names(spark, sf)
    scored = G.Families.fit(train, MIX_FEATURES, [f"power of {f}" for f in names], "power", trees=20, kind=kind).predict(test, "model")
    return _by_family(scored, names, {"truth_w": "power of {}", "model_w": "model_power of {}"})


@query()
def g2_disaggregate(spark, sf):
    return _power(spark, sf, "forest")


@query()
def g3_g11_presence(spark, sf):
    train, test = _windows(spark, sf)
    names = _names(spark, sf)
    return _by_family(G.Families.fit(train, MIX_FEATURES, names, "presence", trees=20).predict(test, "presence"), names, {"truth": "{}", "presence": "presence_{}"})


@query()
def g4_mix(spark, sf):
    """Presence and power of all families from one pair of models, power only where presence says so."""
    train, test = _windows(spark, sf)
    names = _names(spark, sf)
    fitted = fit_mix(train, names, trees=10)
    scored = G.gated(fitted["power"].predict(fitted["presence"].predict(test, "presence"), "power"), names)
    return _by_family(scored, names, {"truth_w": "power of {}", "presence": "presence_{}", "power": "power_{}", "gated": "gated_{}"})


@query()
def g5_boosted(spark, sf):
    """Power of each family by boosted trees of 300 rounds."""
    return _power(spark, sf, "boosted")


@query()
def g5_identify(spark, sf):
    """Boosted trees, one against the rest, 400 rounds each, name the device of windows of held-out scenarios."""
    train, test = _windows(spark, sf, alone=True)
    m = G.identify(train, MIX_FEATURES, kind="boosted")
    names = F.array(*map(F.lit, G.families_of(m)))
    return macro_f1(m.transform(test).withColumn("best", F.get(names, F.col("prediction").cast("int"))), "family", "best")


def _sequence_windows(spark, sf):
    """(train, test) by scenario: raw samples of windows at the meter point, with what each family truly drew."""
    return _split(mixes.sequence_windows(_takes(spark, sf), _names(spark, sf), SAMPLES, WINDOW), "sequences")


@query()
def g6_neural(spark, sf):
    """Whether the first family is on, learnt from raw samples, on windows of scenarios that the network has not seen."""
    train, test = _sequence_windows(spark, sf)
    family = _names(spark, sf)[0]
    known = train.select("sequence", F.col(family).cast("double").alias("on"))
    scored = G.neural_presence(known, "sequence", "on", 3 * WINDOW, iterations=15).transform(G.as_vectors(test, "sequence"))
    return scored.select("scenario", "win", F.col(family).cast("double").alias("on"), vector_to_array("probability")[1].alias("p_on"))


@query()
def g6_network(spark, sf):
    """Presence and watts of all families from raw samples by one network, on windows of scenarios it has not seen."""
    train, test = _sequence_windows(spark, sf)
    names = _names(spark, sf)
    fitted = network.fit(train, names, "scenario", steps=60)
    return _by_family(fitted.predict(test), names, {"truth": "{}", "truth_w": "power of {}", "presence": "presence_{}", "power": "power_{}"})


#: Windows of five samples, their families, and which recordings are the test.
_WINDOWS = "f AS (SELECT rid, i // 5 AS win, avg(p) AS m FROM readings GROUP BY ALL HAVING count(*) = 5)"


@query(f"""WITH {_WINDOWS}, h AS (SELECT rid, {sql_chance(5, 'rid')} AS h FROM (SELECT DISTINCT rid FROM f))
    SELECT rid, CASE WHEN rid = (SELECT rid FROM h ORDER BY h, rid LIMIT 1) OR h < 0.3 AND rid <> (SELECT rid FROM h ORDER BY h DESC, rid DESC LIMIT 1) THEN 'test' ELSE 'train' END AS part FROM h""")
def g7_grouped_split(spark, sf):
    train, test = G.grouped_split(_features(spark, sf), "rid", 0.3, 5)
    return train.select("rid").distinct().withColumn("part", F.lit("train")).union(test.select("rid").distinct().withColumn("part", F.lit("test")))


@query(f"""WITH {_WINDOWS}, h AS (SELECT CASE WHEN m > 60 THEN 'boiler' WHEN m > 40 THEN 'lamp' ELSE 'fan' END AS family, rid, win, {sql_chance(5, 'rid', 'win')} AS h FROM f),
    n AS (SELECT *, count(*) OVER (PARTITION BY family) AS n, min(h) OVER (PARTITION BY family) AS low FROM h)
    SELECT family, rid, win, CASE WHEN CASE WHEN n * 0.25 <= 1 THEN n > 1 AND h = low ELSE h < 0.25 END THEN 'test' ELSE 'train' END AS part FROM n""")
def g8_stratified_split(spark, sf):
    train, test = G.stratified_split(_features(spark, sf), "family", ["rid", "win"], 0.25, 5)
    return train.select("family", "rid", "win", F.lit("train").alias("part")).union(test.select("family", "rid", "win", F.lit("test").alias("part")))


@query()
def k15_linear_svm(spark, sf):
    """Linear support vectors, one against the rest, of windows weighted so that families count alike."""
    train, test = _windows(spark, sf, alone=True)
    return G.identify(train, MIX_FEATURES, kind="svm").transform(test).select("scenario", "win", "family", "prediction")


@query()
def k14_importance(spark, sf):
    train, _ = _windows(spark, sf, alone=True)
    m = G.identify(train, MIX_FEATURES, trees=20)
    return spark.createDataFrame(G.importance(m, MIX_FEATURES), "feature string, importance double")


def _event_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    e = live.replay(spark, sf, schema, name="events.parquet")
    return e.select(F.col("user_id").alias("rid"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("p"), (F.regexp_extract("props", "-?[0-9]+", 0).cast("long") - 50).cast("double").alias("q"), "event_id")


def _appended(stream, by=None):
    """What the append sink has once all files are read, from the store."""
    folder = shared_folder(stream.sparkSession, "live")
    live.append(stream, f"{folder}/rows", f"{folder}/checkpoint", by).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


@query("SELECT rid, time_bucket(INTERVAL 1 DAY, ts) AS start, count(*) AS n, round(avg(p), 6) AS p_mean, max(p) AS p_max FROM readings GROUP BY ALL")
def a14_j9_stream_windows(spark, sf):
    """Replay as a stream into daily windows; each batch replaces the result in the store."""
    w = _event_stream(spark, sf).groupBy("rid", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"), F.avg("p").alias("p_mean"), F.max("p").alias("p_max"))
    return live.replaced(w, shared_folder(spark, "live")).select("rid", F.col("w.start").alias("start"), "n", F.round("p_mean", 6).alias("p_mean"), "p_max")


@query("SELECT event_id, rid, p FROM readings WHERE p > 80")
def a10_a11_append_stream(spark, sf):
    """Append-only log of samples above 80 W, in a folder for each day."""
    log = _event_stream(spark, sf).where("p > 80").select("event_id", "rid", "p", F.to_date("ts").alias("day"))
    return _appended(log, ["day"]).select("event_id", "rid", "p")


@query()
def j9_window_predictions(spark, sf):
    """Windows of held-out scenarios scored by a small model of the others."""
    train, test = _windows(spark, sf, alone=True)
    return G.identify(train, MIX_FEATURES, trees=10).transform(test).select("scenario", "win", "family", "prediction")


def _named_edges(spark, sf):
    """Edges of held-out scenarios: edges of the meter's total, and which device a small forest takes each for."""
    train, test = _split(mixes.device_edges(_takes(spark, sf), SAMPLES, 5), "edges")
    m = G.identify(train, ["dp1", "dp2", "dp3", "dq", "peak", "steady", "rise", "spread"], trees=20)
    return m.transform(test).withColumn("best", F.get(F.array(*map(F.lit, G.families_of(m))), F.col("prediction").cast("int")))


@query()
def k16_two_stage(spark, sf):
    """Edges of the meter's total, then a classifier of them: which device switched, in scenarios it has not seen."""
    return _named_edges(spark, sf).select("scenario", "at", "family", "best")


@query()
def k16_score(spark, sf):
    return macro_f1(k16_two_stage(spark, sf), "family", "best")


@query()
def g16_retrain(spark, sf):
    """Scenarios of the recordings, models of all families trained on them and held-out scores after a reload."""
    folder = shared_folder(spark, "retrain")
    names = _names(spark, sf)
    return retrain(scenario_parts(spark, sf), ModelRegistry(spark, f"{folder}/models"), f"{folder}/scenarios", names, 10, trees=20, voices=voices(spark, sf))


#: Files of a slice of the loop's stream, which a batch takes: a batch for each slice, whatever the number of meters.
SLICE_FILES = 16
#: Seconds at which the loop's samples begin: a stream's first watermark is the epoch, and rows at it are late.
EPOCH = 3600


def _loop_inputs(spark, sf):
    """Samples, one a second, and what a rule of thumb says of each window of two: probability and watts of its event type."""
    r = readings(spark, sf)
    t = (F.col("i") + EPOCH).cast("double").alias("t")
    said = r.where("i % 2 = 0").select("rid", t, F.col("event_type").alias("device"), F.least(F.lit(1.0), F.col("p") / 80).alias("prob"), (0.7 * F.col("p")).alias("watts"))
    return follow.inputs(r.select("rid", t, "p", "q"), said)


_LOOP = ("rid", "t", "kind", "device", "on", "source", "since")


def _loop_rules():
    from gridlens.plans.events import KNOWN

    return follow.Rules(signatures=tuple(KNOWN), side=2.0, span=6.0, least_w=15.0, persist=4.0)


def _rounded_loop(out):
    return out.select(*_LOOP, *[F.round(c, 6).alias(c) for c in ("watts", "total", "residual", "explained")])


@query()
def j9_j17_follow(spark, sf):
    """Edges, claims guarded at ticks, model states, merge, residual, transitions and unknown loads of every meter, from the stored table."""
    return _rounded_loop(follow.follow(_loop_inputs(spark, sf), _loop_rules()))


@query()
def j9_j17_live_loop(spark, sf):
    """The same from a stream of five slices of time, in one keyed state; a last row of no meter moves the watermark past all.

    A slice is ``SLICE_FILES`` files, fewer where meters are few, and a batch may end within one, so rows may be two slices late.
    """
    folder = shared_folder(spark, "loop")
    _loop_inputs(spark, sf).write.parquet(f"{folder}/rows")
    rows = spark.read.parquet(f"{folder}/rows")
    slice_s = int((rows.agg(F.max("t")).first()[0] or EPOCH) - EPOCH) // 5 + 1
    for k in range(5):  # one after the other: a stream takes files in the order in which they came
        rows.where(F.floor((F.col("t") - EPOCH) / slice_s) == k).repartition(SLICE_FILES, "rid").write.mode("append").parquet(f"{folder}/in")
    spark.createDataFrame([(-1, 1e7, 1, None, 0.0, 0.0)], follow.INPUT).write.mode("append").parquet(f"{folder}/in")
    # A batch hands on the changes of its meters, not their whole state.
    store = {"providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "rocksdb.changelogCheckpointing.enabled": "true"}
    keys = {f"spark.sql.streaming.stateStore.{k}": v for k, v in store.items()}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        stream = live.live_loop(live.replay(spark, f"{folder}/in", rows.schema, files_per_trigger=SLICE_FILES), _loop_rules(), late=f"{2 * slice_s} seconds")
        live.append(stream, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    return _rounded_loop(spark.read.schema(stream.schema).parquet(f"{folder}/out").where("rid >= 0"))


_STATS = {"p_mean": "avg(p)", "p_std": "stddev_pop(p)", "p_min": "min(p)", "p_max": "max(p)", "q_mean": "avg(q)", "p1_mean": "avg(p1)", "p2_mean": "avg(p2)", "p3_mean": "avg(p3)",
    "pf_mean": "avg(CASE WHEN sqrt(p * p + q * q) > 1e-6 THEN p / sqrt(p * p + q * q) ELSE 1 END)", "thd_mean": "0.0", "hour_mean": "0.0", "q_std": "stddev_pop(q)", "qp": "avg(q) / (abs(avg(p)) + 1e-6)", "s": "sqrt(avg(p) ** 2 + avg(q) ** 2)"}


#: Means of decimals end in a 5 now and then: rounded where both engines agree on the digit.
_DIGITS = dict.fromkeys(("p_mean", "q_mean", "p1_mean", "p2_mean", "p3_mean"), 9)


def _phased(rows):
    return rows.select("rid", "ts", "p", "q", *[(share * F.col("p")).alias(f"p{k}") for k, share in ((1, 0.5), (2, 0.3), (3, 0.2))])


@query(f"""WITH b AS (SELECT *, time_bucket(INTERVAL 6 HOURS, ts) AS start FROM phases) SELECT rid, start, {", ".join(f"round({e}, {_DIGITS.get(n, 4)}) AS {n}" for n, e in _STATS.items())}
    FROM b GROUP BY rid, start HAVING start + INTERVAL 6 HOURS <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def j9_stream_features(spark, sf):
    """Window features of a stream, appended to the store as the watermark passes each window."""
    f = _appended(live.window_features(_phased(_event_stream(spark, sf)), "6 hours", "1 hour"))
    return f.select("rid", "start", *[F.round(c, _DIGITS.get(c, 4)).alias(c) for c in _STATS])


@query()
def j9_live_states(spark, sf):
    """Stream, window features, presence and power models, append sink; then states of all devices from the stored windows.

    Fitted on the windows of recordings with even numbers.
    """
    r = readings(spark, sf)
    names = _names(spark, sf)
    start = F.window("ts", "6 hours")["start"].alias("start")
    kind = lambda f: F.col("event_type") == f
    truth = r.groupBy("rid", start).agg(*[F.max(kind(f).cast("int")).alias(f) for f in names], *[(F.sum(F.when(kind(f), F.col("p")).otherwise(0.0)) / F.count("*")).alias(f"power of {f}") for f in names])
    # The same features in a batch: a watermark changes nothing there.
    known = live.window_features(_phased(r), "6 hours", "1 hour").where("rid % 2 = 0").join(truth, ["rid", "start"])
    # Stored once: a cache would keep as many pieces as a shuffle has, whatever they hold, and every pass of ten models runs over them.
    folder = shared_folder(spark, "known")
    known.write.parquet(folder)
    fitted = fit_mix(spark.read.schema(known.schema).parquet(folder), names, trees=5)
    mix = Mix(fitted["presence"], fitted["power"], FEATURES, names, "mix")
    scored = mix.predict(live.window_features(_phased(_event_stream(spark, sf)), "6 hours", "1 hour"))
    columns = ["rid", "start", "p_mean", *[f"{x}_{f}" for f in names for x in ("presence", "power")]]
    return live.device_states(_appended(scored.select(*columns)), names)
