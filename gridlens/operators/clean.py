"""Validation and cleaning of recordings (long tables keyed by recording and sample)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from gridlens.functions.electrical import finite

KEY, ORDER = "rid", "i"
#: Samples of a chunk: what a task sorts and scans at a time, of however long a recording.
CHUNK = 65_536
#: Rows of a task that groups by keys most of which are different: there a partial sum saves nothing and holds as many rows.
TASK_ROWS = 500_000
#: Up to so many partitions Spark's writer of a shuffle holds no rows in memory (bypassMergeThreshold); beyond, all rows of a split.
FEW = 200


def by_sample(key: str = KEY, order: str = ORDER) -> WindowSpec:
    return Window.partitionBy(key).orderBy(order)


def tasks(df: DataFrame) -> int:
    """Tasks of about ``TASK_ROWS`` rows each, for ``repartition``; of up to four times as many before they become more than ``FEW``.

    So what a task holds is bounded, however large the table.
    """
    n = df.count()
    return max(1, min(-(-n // TASK_ROWS), FEW), -(-n // (4 * TASK_ROWS)))


def with_halo(df: DataFrame, halo: int, size: int, order: str = ORDER) -> DataFrame:
    """Rows with ``chunk``, and copies of rows within ``halo`` of a chunk's edge in the chunk beside it (``extra``).

    Row frames of up to ``halo`` rows then give the same over (recording, chunk) as over the whole
    recording, so that one long recording is many tasks' work. Drop ``extra`` rows afterwards.
    """
    own, place = F.expr(f"{order} div {size}"), F.col(order) % size
    near = F.filter(
        F.array(own, F.when((place < halo) & (own > 0), own - 1), F.when(place >= size - halo, own + 1)), lambda c: c.isNotNull()
    )
    return df.withColumn("chunk", F.explode(near)).withColumn("extra", F.col("chunk") != own)


def carried(df: DataFrame, value: Column, out: str, keys: Sequence[str] = (KEY,), order: str = ORDER, ahead: bool = False, size: int = CHUNK) -> DataFrame:
    """``out``: the last value that isn't null at or before each row (``ahead``: the first at or after it), however far away.

    A scan in two levels: each chunk of ``size`` samples by itself, and one row a chunk for what it hands on, so that a
    long recording is many tasks' work and only its chunks' summaries are one.
    """
    place = F.desc if ahead else F.asc
    rows = df.withColumns({"_chunk": F.floor(F.col(order) / size), "_v": value})
    inner = Window.partitionBy(*keys, "_chunk").orderBy(place(order)).rowsBetween(Window.unboundedPreceding, 0)
    pick = F.min_by if ahead else F.max_by
    ends = rows.groupBy(*keys, "_chunk").agg(pick("_v", F.when(F.col("_v").isNotNull(), F.col(order))).alias("_end"))
    outer = Window.partitionBy(*keys).orderBy(place("_chunk")).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*keys, "_chunk", F.last("_end", True).over(outer).alias("_carry"))
    both = rows.withColumn("_in", F.last("_v", True).over(inner)).join(ends, [*keys, "_chunk"])
    return both.withColumn(out, F.coalesce("_in", "_carry")).drop("_chunk", "_v", "_in", "_carry")


def validate(df: DataFrame, key: str = KEY, order: str = ORDER, ts_us: str = "ts_us") -> DataFrame:
    """Per recording: samples, steps that don't go forward, and the verdict (two samples, all forward)."""
    step = F.col(ts_us) - F.lag(ts_us).over(by_sample(key, order))
    back = df.withColumn("_step", step).groupBy(key).agg(F.count("*").alias("n_samples"), F.count_if(F.col("_step") <= 0).alias("n_backward"))
    return back.withColumn("valid", (F.col("n_samples") >= 2) & (F.col("n_backward") == 0))


def sample_rate(df: DataFrame, key: str = KEY, order: str = ORDER, ts_us: str = "ts_us") -> DataFrame:
    """Samples a second: 1e6 over the median forward step."""
    step = F.col(ts_us) - F.lag(ts_us).over(by_sample(key, order))
    return df.withColumn("_step", step).where("_step > 0").groupBy(key).agg((F.lit(1e6) / F.median("_step")).alias("rate"))


def count_faults(df: DataFrame, channels: Sequence[str], key: str = KEY) -> DataFrame:
    """Missing, not-a-number and infinite samples of every channel, in one pass."""
    aggs = []
    for c in channels:
        aggs += [F.count_if(F.isnan(c)).alias(f"{c}_nan"), F.count_if(F.abs(c) == float("inf")).alias(f"{c}_inf"), F.count_if(F.col(c).isNull()).alias(f"{c}_missing")]
    return df.groupBy(key).agg(*aggs)


def to_missing(df: DataFrame, channels: Sequence[str]) -> DataFrame:
    return df.withColumns({c: finite(F.col(c)) for c in channels})


def impute_short_gaps(df: DataFrame, channel: str, out: str = "filled", max_gap: int = 5, key: str = KEY, order: str = ORDER, size: int = CHUNK) -> DataFrame:
    """Linear interpolation by sample number in runs of at most ``max_gap`` missing samples with values on both sides.

    Adds ``out`` and ``gap`` (0: present, 1: filled, 2: left missing). Chunks of ``size`` samples see ``max_gap`` + 1
    samples of their neighbours, which is as far as a short gap's ends can be.
    """
    chunk = Window.partitionBy(key, "chunk")
    back, ahead = chunk.orderBy(order).rowsBetween(Window.unboundedPreceding, 0), chunk.orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    v, at = F.col(channel), F.when(F.col(channel).isNotNull(), F.col(order))
    df = with_halo(df, max_gap + 1, size, order)
    df = df.withColumns({"_v0": F.last(v, True).over(back), "_i0": F.last(at, True).over(back), "_v1": F.last(v, True).over(ahead), "_i1": F.last(at, True).over(ahead)}).where("not extra")
    short = v.isNull() & (F.col("_i1") - F.col("_i0") - 1 <= max_gap)
    line = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * (F.col(order) - F.col("_i0")) / (F.col("_i1") - F.col("_i0"))
    gap = F.when(v.isNotNull(), 0).when(F.coalesce(short, F.lit(False)), 1).otherwise(2)
    return df.withColumns({out: F.when(v.isNotNull(), v).when(short, line), "gap": gap}).drop("_v0", "_i0", "_v1", "_i1", "chunk", "extra")


def clip(c: Column, low: float, high: float) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(high)), F.lit(low)))


def outside(c: Column, low: float, high: float) -> Column:
    """A present value out of bounds; missing values never count."""
    return F.coalesce((c < low) | (c > high), F.lit(False))


def flag(c: Column, low: float, high: float) -> Column:
    return F.when(c.between(low, high), c)


def smooth(df: DataFrame, channel: str, window: int, out: str = "smoothed", skip_missing: bool = False, key: str = KEY, order: str = ORDER) -> DataFrame:
    """Centred mean; missing counts as 0 (or is skipped), edges keep their value, missing stays missing."""
    half, w = window // 2, by_sample(key, order)
    frame = w.rowsBetween(-half, window - half - 1)
    n = F.count("*").over(Window.partitionBy(key))
    mean = F.avg(channel).over(frame) if skip_missing else F.sum(F.coalesce(F.col(channel), F.lit(0.0))).over(frame) / window
    place = F.row_number().over(w)
    edge = (place <= half) | (place > n - half)
    return df.withColumn(out, F.when(F.col(channel).isNull() | edge, F.col(channel)).otherwise(mean))


def quality_report(df: DataFrame, channel: str, low: float, high: float, max_gap: int = 5, key: str = KEY, order: str = ORDER) -> DataFrame:
    """One row per recording: counts before repair, after imputation, and out of bounds among present values."""
    v = F.col(channel)
    marked = df.withColumns({"_nan": F.isnan(v), "_inf": F.abs(v) == float("inf"), "_c": finite(v)})
    filled = impute_short_gaps(marked, "_c", "_f", max_gap, key, order)
    return filled.groupBy(key).agg(
        F.count("*").alias("n"), F.count_if("_nan").alias("n_nan"), F.count_if("_inf").alias("n_inf"), F.count_if(F.col("gap") == 1).alias("n_filled"),
        F.count_if(F.col("gap") == 2).alias("n_left"), F.count_if(outside(F.col("_f"), low, high)).alias("n_clipped"),
    )


def estimated_times(df: DataFrame, good: Column, step_us: int, ts_us: str = "ts_us", key: str = KEY, order: str = ORDER, size: int = CHUNK) -> DataFrame:
    """Time of a failed poll: the nearest earlier good one plus whole steps, else the nearest later one minus them."""
    known = F.when(good, F.struct(F.col(ts_us).alias("t"), F.col(order).alias("i")))
    near = carried(carried(df, known, "_back", [key], order, size=size), known, "_ahead", [key], order, ahead=True, size=size)
    before = F.col("_back.t") + (F.col(order) - F.col("_back.i")) * step_us
    after = F.col("_ahead.t") - (F.col("_ahead.i") - F.col(order)) * step_us
    return near.withColumn("ts_est_us", F.coalesce(before, after)).drop("_back", "_ahead")


def trace_spans(parts: DataFrame, scenario: str, trace: str, order: str, size: int = CHUNK) -> DataFrame:
    """(scenario, trace, n, start): length and first sample of every trace. The result is dealt by scenario.

    Samples are counted by chunk of a trace first, so that a long trace is many tasks' work.
    """
    n, chunk = tasks(parts), F.floor(F.col(order) / size)
    counts = parts.select(scenario, trace, order, chunk.alias("_chunk")).repartition(n, scenario, trace, "_chunk").groupBy(scenario, trace, "_chunk").agg(F.count("*").alias("_n"), F.min(order).alias("_start"))
    return counts.repartition(n, scenario).groupBy(scenario, trace).agg(F.sum("_n").alias("n"), F.min("_start").alias("start"))


def misaligned(traces: DataFrame, scenario: str, measures: Sequence[str]) -> DataFrame:
    """Scenarios whose traces differ in any of the measures (length, rate, anchor). A scenario's traces, not its samples, meet in a set."""
    counts = traces.groupBy(scenario).agg(*[F.size(F.collect_set(m)).cast("long").alias(f"n_{m}") for m in measures])
    differ = F.lit(False)
    for m in measures:
        differ = differ | (F.col(f"n_{m}") > 1)
    return counts.where(differ)


def conservation_error(totals: DataFrame, parts: DataFrame, scenario: str = "scenario", sample: str = "sample", p: str = "p") -> DataFrame:
    """Largest |sum of contributions - total| over max(1, largest |total|), per scenario."""
    summed = parts.groupBy(scenario, sample).agg(F.sum(p).alias("_sum"))
    both = totals.join(summed, [scenario, sample], "left")
    return both.groupBy(scenario).agg((F.max(F.abs(F.coalesce("_sum", F.lit(0.0)) - F.col(p))) / F.greatest(F.lit(1.0), F.max(F.abs(p)))).alias("error"))


def eligible(df: DataFrame, mixed: Column, p: str = "p", key: str = KEY, least: int = 25) -> DataFrame:
    """Recordings fit for mixing: not mixed and long enough; ``quiet`` where the power never reaches 1 W."""
    return df.groupBy(key).agg(F.count("*").alias("n"), F.max(F.abs(p)).alias("peak"), F.bool_or(mixed).alias("mixed")).where(f"not mixed and n >= {least}").select(key, "n", (F.coalesce("peak", F.lit(0.0)) < 1).alias("quiet"))


def read_failures(df: DataFrame, p: str = "p", key: str = KEY, order: str = ORDER) -> DataFrame:
    """At every sample: ``failures`` so far (missing readings) and ``in_a_row``, those since the last good one."""
    w = by_sample(key, order).rowsBetween(Window.unboundedPreceding, 0)
    total = F.count_if(F.col(p).isNull()).over(w)
    good = F.max(F.when(F.col(p).isNotNull(), total)).over(w)
    return df.withColumns({"failures": total, "in_a_row": total - F.coalesce(good, F.lit(0))})


def effective_rate(df: DataFrame, intervals: int = 50, ts_us: str = "ts_us", key: str = KEY, order: str = ORDER) -> DataFrame:
    """Samples a second over the last ``intervals`` steps, at every sample."""
    w = by_sample(key, order)
    stepped = df.withColumn("_step", F.col(ts_us) - F.lag(ts_us).over(w))
    return stepped.withColumn("rate", F.lit(1e6) / F.nullif(F.avg("_step").over(w.rowsBetween(-(intervals - 1), 0)), F.lit(0.0))).drop("_step")
