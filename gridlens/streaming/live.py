"""Following a live feed: file sources, append sinks, windows, and one keyed state that follows a meter."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from gridlens.operators.events import hysteresis, merge, residual
from gridlens.operators.follow import INPUT, SCHEMA, Follower, Meter, Rules, sound
from gridlens.operators.windows import aggregate_features, smoothed


def replay(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1, name: str = "*") -> DataFrame:
    """A stored recording as a stream, in the order of its files; the event time is the recorded time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", name).parquet(folder)


def looped(df: DataFrame, times: int, ts: str = "ts") -> DataFrame:
    """A stored recording ``times`` over, each round starting one mean step after the end of the one before."""
    us = F.unix_micros(ts)
    b = df.agg(F.min(us).alias("a"), F.max(us).alias("b"), F.countDistinct(ts).alias("n")).first()  # one row
    span = 0 if b["n"] in (0, None) else (b["b"] - b["a"]) + (b["b"] - b["a"]) // max(b["n"] - 1, 1)
    rounds = df.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    return rounds.withColumn(ts, F.timestamp_micros(us + F.col("round") * F.lit(span)))


def paced(df: DataFrame, folder: str, batch_s: float, ts: str = "ts", speed: float = 1.0) -> str:
    """Write a recording as files of ``batch_s * speed`` recorded seconds each, for ``replay`` at one file a trigger.

    With a trigger every ``batch_s`` seconds the feed runs at ``speed`` times its recorded rate. Files are taken in
    the order of their numbers, which is the order of their times.
    """
    part = F.floor(F.unix_micros(ts) / F.lit(1e6 * batch_s * speed)).cast("long")
    df.withColumn("_part", part).repartitionByRange("_part").write.mode("overwrite").partitionBy("_part").parquet(folder)
    return folder


def append(df: DataFrame, path: str, checkpoint: str, by: list[str] | None = None) -> StreamingQuery:
    """Write everything there is, then stop; files appear whole or not at all, so a crash loses no written batch."""
    writer = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return (writer.partitionBy(*by) if by else writer).start(path)


def replaced(df: DataFrame, folder: str) -> DataFrame:
    """The complete result of an aggregated stream once everything there is has been read: each batch is written whole to the store."""
    store = lambda rows, batch: rows.write.mode("overwrite").parquet(f"{folder}/batch-{batch}")
    run = df.writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(store).start()
    run.awaitTermination()
    last = max([p["batchId"] for p in run.recentProgress], default=0)
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/batch-{last}")


def windowed(df: DataFrame, size: str, slide: str | None, late: str, key: str = "rid", ts: str = "ts", p: str = "p") -> DataFrame:
    """Clock-time windows of power, with a watermark: later rows are dropped."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return df.withWatermark(ts, late).groupBy(key, w.alias("w")).agg(F.count("*").alias("n"), F.avg(p).alias("p_mean"), F.max(p).alias("p_max"), F.stddev_pop(p).alias("p_std")).select(key, F.col("w.start").alias("start"), "n", "p_mean", "p_max", "p_std")


def window_features(df: DataFrame, size: str, late: str, key: str = "rid", ts: str = "ts") -> DataFrame:
    """The features of ``windows.aggregate_features`` over clock-time windows of a stream, each when the watermark has passed it: (key, start, features)."""
    windows = df.withWatermark(ts, late).withColumn("win", F.window(ts, size))
    f = aggregate_features(windows, key, phases="p1" in df.columns)
    return f.select(key, F.col("win.start").alias("start"), *[c for c in f.columns if c not in (key, "win")])


def device_states(scored: DataFrame, families: list[str], key: str = "rid", at: str = "start", total: str = "p_mean") -> DataFrame:
    """From the scored windows of ``Mix.predict`` to device states: (key, at, device, prob, state, watts, total, residual, explained).

    Median of three probabilities, on and off by hysteresis, model watts scaled into the total; no claims.
    """
    one = lambda f: F.struct(F.lit(f).alias("device"), F.col(f"presence_{f}").alias("_p"), F.col(f"power_{f}").alias("_w"))
    long = scored.select(key, at, F.col(total).alias("total"), F.explode(F.array(*map(one, families))).alias("_x")).select(key, at, "total", "_x.*")
    smooth = long.withColumn("prob", smoothed(F.col("_p"), [key, "device"], at))
    on = smooth.withColumn("state", hysteresis(F.col("prob"), Window.partitionBy(key, "device").orderBy(at)))
    on = on.withColumns({"_claim": F.lit(None).cast("double"), "_held": F.lit(False), "_model": F.col("_w") * F.col("state")})
    merged = merge(on, [key, at], "total", "_claim", "_model", "_held")
    return merged.join(residual(merged, [key, at], "total", "watts").drop("total"), [key, at]).select(key, at, "device", "prob", "state", "watts", "total", "residual", "explained")


#: What the loop keeps of a meter, and a row that it emits.
STATE = "meter string, waiting string, history string, timer long"
ROW = Row(*[c.split()[0] for c in SCHEMA.split(", ")])


class Loop(StatefulProcessor):
    """``follow`` on a stream: rows wait in state until the watermark has passed them and are then applied in order.

    A timer at the latest waiting row brings the meter up to date when no further row comes. A meter's state is one value,
    so that a batch reads and writes it once: the meter, its waiting rows, the last ticks (as JSON) and its timer.
    """

    def __init__(self, rules: Rules, ticks: int = 420):
        self.rules, self.ticks = rules, ticks

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", STATE)

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        self.state.update((initialState["meter"], "[]", "[]", None))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        return self._advance(key[0], timerValues.getCurrentWatermarkInMs(), [r[1:6] for r in rows])  # columns of ``INPUT``

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        return self._advance(key[0], timerValues.getCurrentWatermarkInMs(), [])

    def _advance(self, rid: int, watermark_ms: int, fresh: list[tuple]) -> Iterator[Row]:
        meter, waiting, history, timer = self.state.get() or ("{}", "[]", "[]", None)
        ready, later = [], []
        for r in sound([*map(tuple, json.loads(waiting)), *fresh]):
            (ready if math.floor(r[0] * 1000) <= watermark_ms else later).append(r)
        due = math.ceil(later[-1][0] * 1000) if later else None
        if due != timer:
            if timer is not None and (fresh or timer > watermark_ms):  # the one that called goes by itself
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        follower = Follower(rid, self.rules, Meter(**json.loads(meter)))
        out = list(follower.rows(ready))
        if ready:
            meter = json.dumps(vars(follower.state()))
        if past := {r[1]: (r[1], r[7], r[8]) for r in reversed(out) if r[2] == "state"}:  # the first state of a tick
            history = json.dumps([*json.loads(history), *reversed(past.values())][-self.ticks :])
        if ready or fresh or due != timer:
            self.state.update((meter, json.dumps(later), history, due))
        return (ROW(*r) for r in out)

    def close(self) -> None:
        pass


def live_loop(rows: DataFrame, rules: Rules, late: str = "10 seconds", initial: DataFrame | None = None) -> DataFrame:
    """States at ticks and events of every meter from a stream of ``follow.inputs``; equal to ``follow`` over the rows that were not late.

    ``initial`` (rid, meter), of ``follow.rebuilt``, is what a new query starts with. The state store must be RocksDB.
    Times are seconds after the epoch: a stream's first watermark is the epoch itself, so rows at it or before are late.
    """
    columns = [c.split()[0] for c in INPUT.split(", ")]
    keyed = rows.select(*columns, F.timestamp_micros((F.col("t") * 1e6).cast("long")).alias("ts")).withWatermark("ts", late)
    start = initial.groupBy("rid") if initial is not None else None
    return keyed.groupBy("rid").transformWithState(Loop(rules), SCHEMA, "Append", "EventTime", start)


def late_rows(query: StreamingQuery) -> int:
    """Rows that a stopped query left out because the watermark had passed them; of its progress, which Spark keeps for the last hundred batches."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def live_snapshot(spark: SparkSession, checkpoint: str) -> tuple[DataFrame, DataFrame]:
    """(devices, history) as the state store of a live loop has them: what is on, its watts and since when; the last ticks."""
    state = spark.read.format("statestore").option("stateVarName", "state").load(checkpoint).select("key.rid", "value.*")
    devices = state.select("rid", F.explode(F.from_json("meter", "devices map<string, array<double>>")["devices"]).alias("device", "_x"))
    ticks = state.select("rid", F.explode(F.from_json("history", "array<array<double>>")).alias("_x"))
    at = lambda *names: [F.col("_x")[k].alias(n) for k, n in enumerate(names)]
    return devices.select("rid", "device", *at("on", "watts", "since")).where("on = 1").drop("on"), ticks.select("rid", *at("t", "total", "residual"))
