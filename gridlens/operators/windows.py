"""Window features. Windows are counted in samples, not in clock time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlens.operators.clean import by_sample


def sliding(df: DataFrame, w: int, step: int, key: str = "rid", order: str = "i") -> DataFrame:
    """A row for each window that a sample is in, with ``win`` and ``pos``; the incomplete last window is left out."""
    i = F.col(order)
    n = F.count("*").over(Window.partitionBy(key))
    first = F.greatest(F.lit(0), F.ceil((i - w + 1) / step)).cast("long")
    last = F.least(F.floor(i / step), F.floor((n - w) / step)).cast("long")
    out = df.withColumns({"_first": first, "_last": last}).where("_first <= _last").withColumn("win", F.explode(F.sequence("_first", "_last")))
    return out.withColumn("pos", F.col(order) - F.col("win") * step).drop("_first", "_last")


def tumbling(df: DataFrame, w: int, key: str = "rid", order: str = "i") -> DataFrame:
    """``win`` and ``pos`` of every sample, the partial tail left out."""
    n = F.count("*").over(Window.partitionBy(key))
    return df.withColumns({"win": F.expr(f"{order} div {w}"), "pos": F.col(order) % w, "_n": n}).where(f"(win + 1) * {w} <= _n").drop("_n")


def median_if(c: Column, condition: Column) -> Column:
    return F.percentile(F.when(condition, c), F.lit(0.5))


def state_features(windows: DataFrame, w: int, on_w: float = 5.0, key: str = "rid") -> DataFrame:
    """Steady state over the middle of each window, spread over all of it, and whether it is active."""
    low = int(0.2 * w)
    middle = (F.col("pos") >= low) & (F.col("pos") < max(int(0.8 * w), low + 1))
    f = windows.groupBy(key, "win").agg(
        median_if(F.col("p"), middle).alias("p_ss"), median_if(F.col("q"), middle).alias("q_ss"), F.stddev_pop("p").alias("p_std"),
        F.min("p").alias("p_min"), F.max("p").alias("p_max"), (F.avg(F.abs("p")) > on_w).alias("active"),
    )
    s = F.hypot("p_ss", "q_ss")
    return f.withColumns({"s_ss": s, "pf": F.when(s > 1e-6, F.col("p_ss") / s), "qp": F.col("q_ss") / (F.abs("p_ss") + 1e-6)})


def harmonic_features(df: DataFrame, keys: list[str], mag: str = "mag") -> DataFrame:
    """Mean magnitude by order, then orders 3, 5 and 7, energy and centroid."""
    by = df.select(*keys, F.posexplode(mag).alias("k", "m")).groupBy(*keys, (F.col("k") + 2).alias("n")).agg(F.avg("m").alias("m"))
    at = lambda n: F.sum(F.when(F.col("n") == n, F.col("m")))
    return by.groupBy(*keys).agg(
        at(3).alias("h3"), at(5).alias("h5"), at(7).alias("h7"), F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("h_energy"),
        (F.sum(F.col("n") * F.col("m")) / (F.sum("m") + 1e-9)).alias("h_centroid"),
    )


def window_thd(measured: Column, energy: Column, p: Column, q: Column) -> Column:
    """The measured median, else the energy over the fundamental at 230 V."""
    return F.coalesce(measured, 100 * energy / (F.hypot(p, q) / 230 + 1e-6))


def aggregate_features(windows: DataFrame, key: str = "rid", phases: bool = True) -> DataFrame:
    """The fourteen means, spreads and derived values of each tumbling window; missing results become 0.

    A measured power factor (``pf``) and distortion (``thd``) count where there are such columns;
    the hour comes from ``ts_us`` or a column ``hour`` (hours since the recording's start).
    """
    p, q = F.avg("p"), F.avg("q")
    has, none = set(windows.columns), F.lit(None).cast("double")
    given = F.when(F.hypot("p", "q") > 1e-6, F.col("p") / F.hypot("p", "q")).otherwise(1.0)
    if "hour" not in has and "ts_us" in has:
        windows = windows.withColumn("hour", hours_since_start(F.col("ts_us"), key))
        has.add("hour")
    aggs = {
        "p_mean": p, "p_std": F.stddev_pop("p"), "p_min": F.min("p"), "p_max": F.max("p"), "q_mean": q,
        **{f"p{k}_mean": F.avg(f"p{k}") if phases else F.lit(0.0) for k in (1, 2, 3)},
        "pf_mean": F.avg(F.coalesce("pf", given) if "pf" in has else given), "thd_mean": F.avg(F.col("thd") if "thd" in has else none),
        "hour_mean": F.avg(F.col("hour") if "hour" in has else none), "q_std": F.stddev_pop("q"),
        "qp": q / (F.abs(p) + 1e-6), "s": F.hypot(p, q),
    }
    return windows.groupBy(key, "win").agg(*[F.coalesce(c, F.lit(0.0)).alias(n) for n, c in aggs.items()])


def hours_since_start(ts_us: Column, key: str = "rid") -> Column:
    """Hours since the recording's first sample, modulo 24: not the time of day."""
    return ((ts_us - F.min(ts_us).over(Window.partitionBy(key))) / 3.6e9) % 24


def step_features(windows: DataFrame, w: int, least_w: float = 10.0, key: str = "rid") -> DataFrame:
    """The largest settled step: medians of up to k samples after and before the sharpest change (the first on ties).

    Missing counts as 0; windows below four samples give zeros. Arrays of one window only.
    """
    packed = windows.groupBy(key, "win").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("q", F.lit(0.0)).alias("q")))).alias("_s"))
    if w < 4:
        return packed.select(key, "win", F.lit(0.0).alias("dp_step"), F.lit(0.0).alias("dq_step"), F.lit(0).alias("n_steps"))
    k = max(1, min(5, w // 4))
    packed = packed.select(key, "win", F.transform("_s", lambda s: s["p"]).alias("_p"), F.transform("_s", lambda s: s["q"]).alias("_q"))
    jumps = F.zip_with(F.slice("_p", 1, w - 1), F.slice("_p", 2, w - 1), lambda a, b: F.abs(b - a))
    packed = packed.withColumn("_d", jumps).withColumn("_j", (F.array_position("_d", F.array_max("_d")) - 1).cast("int"))

    def median(c: str, start: Column, n: Column) -> Column:
        s = F.array_sort(F.slice(c, start + 1, n))
        size = F.size(s)
        return (F.get(s, F.floor((size - 1) / 2).cast("int")) + F.get(s, F.floor(size / 2).cast("int"))) / 2

    j = F.col("_j")
    start = F.greatest(j - k + 1, F.lit(0))
    step = lambda c: median(c, j + 1, F.least(F.lit(k), w - 1 - j)) - median(c, start, j + 1 - start)
    return packed.select(key, "win", step("_p").alias("dp_step"), step("_q").alias("dq_step"), F.size(F.filter("_d", lambda d: d > least_w)).alias("n_steps"))


def family_power(windows: DataFrame, vocabulary: list, keys: list[str], family: str = "family", p: str = "p", on_w: float = 5.0) -> DataFrame:
    """Mean contribution of every family of the vocabulary in each window, 0 where absent, and its presence."""
    sums = windows.groupBy(*keys, "appliance", family).agg(F.avg(p).alias("_m")).groupBy(*keys, family).agg(F.sum("_m").alias("power"))
    every = windows.select(*keys).distinct().withColumn(family, F.explode(F.array(*map(F.lit, vocabulary))))
    out = every.join(sums, [*keys, family], "left").withColumn("power", F.coalesce("power", F.lit(0.0)))
    return out.withColumn("present", (F.abs("power") > on_w).cast("int"))


def sequences(windows: DataFrame, channels: list[str], key: str = "rid") -> DataFrame:
    """All samples of a window, channel after channel, missing as 0."""
    packed = windows.groupBy(key, "win").agg(F.array_sort(F.collect_list(F.struct("pos", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in channels]))).alias("_s"))
    block = lambda c: F.transform("_s", lambda s: s[c])
    return packed.select(key, "win", F.concat(*map(block, channels)).alias("sequence"))


def has_all(df: DataFrame, channel: str, key: str = "rid") -> DataFrame:
    """Per recording, whether every sample has the channel: chooses the full or the common feature set."""
    return df.groupBy(key).agg(F.bool_and(F.col(channel).isNotNull()).alias("full"))


def stride(df: DataFrame, limit: int, live: bool = False, key: str = "rid", order: str = "i") -> DataFrame:
    """Every k-th sample so that about ``limit`` are left; live: k = n div limit once n exceeds it."""
    n = F.count("*").over(Window.partitionBy(key))
    k = F.when(n > limit, F.greatest(F.lit(1), F.floor(n / limit))).otherwise(1) if live else F.greatest(F.lit(1), F.ceil(n / limit))
    return df.withColumn("k", k.cast("long")).where(f"{order} % k = 0")


def smoothed(c: Column, key: str = "rid", order: str = "i", n: int = 3) -> Column:
    """Median of the last ``n``."""
    return F.percentile(c, F.lit(0.5)).over(by_sample(key, order).rowsBetween(-(n - 1), 0))
