"""From appliance contributions to the quantities at the meter point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlens.functions import electrical as E

PHASES = (1, 2, 3)


def phase_sums(parts: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    """P and Q per phase, and ``more`` aggregates. ``phase`` is 1 to 3, or 0 for a three-phase device (a third each); other phases are an error."""
    known = parts.withColumn("phase", F.when(F.col("phase").isin(0, *PHASES), F.col("phase")).otherwise(F.raise_error(F.lit("unknown phase"))))
    share = lambda k: F.when(F.col("phase") == 0, F.lit(1 / 3)).when(F.col("phase") == k, F.lit(1.0)).otherwise(0.0)
    return known.groupBy(*keys).agg(*[F.sum(F.col(c) * share(k)).alias(f"{c}{k}") for c in ("p", "q") for k in PHASES], *more)


def harmonic_sums(parts: DataFrame, keys: list[str], mag: str = "mag", ang: str = "ang") -> DataFrame:
    """Spectra added as complex vectors by order: magnitude and angle arrays."""
    rows = parts.select(*keys, F.posexplode(F.arrays_zip(F.col(mag).alias("m"), F.col(ang).alias("a"))).alias("_k", "_h"))
    sums = rows.groupBy(*keys, "_k").agg(F.sum(F.col("_h.m") * F.cos("_h.a")).alias("_re"), F.sum(F.col("_h.m") * F.sin("_h.a")).alias("_im"))
    packed = sums.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_k", F.hypot("_re", "_im").alias("m"), F.atan2("_im", "_re").alias("a")))).alias("_h"))
    return packed.select(*keys, F.transform("_h", lambda h: h["m"]).alias("mag"), F.transform("_h", lambda h: h["a"]).alias("ang"))


def meter_point(sums: DataFrame, voltage: float = 230.0) -> DataFrame:
    """Currents, apparent power, power factors and totals from phase sums ``p1``-``q3`` (and spectra ``h1``-``h3``, or their energies ``e1``-``e3``, if there)."""
    v = F.lit(voltage)
    has = set(sums.columns)
    out = {}
    for k in PHASES:
        p, q = F.col(f"p{k}"), F.col(f"q{k}")
        one = E.fundamental_current(p, q, v)
        energy = F.col(f"e{k}") if f"e{k}" in has else E.sum_of_squares(F.col(f"h{k}")) if f"h{k}" in has else None
        current = E.rms_current(one, energy) if energy is not None else F.abs(one)
        out |= {f"i{k}_fund": one, f"i{k}": current, f"s{k}": v * current, f"pf{k}": E.ratio_or_one(p, v * current), f"cosphi{k}": E.ratio_or_one(p, F.hypot(p, q))}
        if energy is not None:
            out[f"thd{k}"] = E.thd_percent(energy, one)
    first = sums.withColumns(out)
    total = lambda c: F.col(f"{c}1") + F.col(f"{c}2") + F.col(f"{c}3")
    second = first.withColumns({"i_n": E.neutral_current(F.col("i1"), F.col("i2"), F.col("i3")), "p_total": total("p"), "q_total": total("q"), "s_total": total("s")})
    return second.withColumns({"pf_total": E.ratio_or_one(F.col("p_total"), F.col("s_total")), "cosphi_total": E.ratio_or_one(F.col("p_total"), F.hypot("p_total", "q_total"))})


def summary(points: DataFrame, key: str = "scenario") -> DataFrame:
    """Least, largest and mean total P and Q of each scenario; mean P, current and distortion by phase; mean neutral current."""
    spread = {f"{c}_{n}": f(c) for c in ("p_total", "q_total") for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))}
    means = {f"{c}_mean": F.avg(c) for c in (*[f"{x}{k}" for x in ("p", "i", "thd") for k in PHASES], "i_n") if c in points.columns}
    return points.groupBy(key).agg(*[c.alias(n) for n, c in (spread | means).items()])


def signed_stack(parts: DataFrame, keys: list[str], order: str, p: str = "p") -> DataFrame:
    """Running sums of the positive and of the negative parts, in the order of the devices."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return parts.withColumns({"above": F.sum(F.greatest(F.col(p), F.lit(0.0))).over(w), "below": F.sum(F.least(F.col(p), F.lit(0.0))).over(w)})


def duty(parts: DataFrame, keys: list[str], on_w: float = 3.0, p: str = "p") -> DataFrame:
    """Share of samples on, median magnitude while on, peak magnitude."""
    on = F.abs(p) > on_w
    return parts.groupBy(*keys).agg((100 * F.avg(on.cast("int"))).alias("on_percent"), F.percentile(F.when(on, F.abs(p)), F.lit(0.5)).alias("median_on"), F.max(F.abs(p)).alias("peak"))


def manifest(parts: DataFrame, key: str = "scenario", family: str = "appliance", sample: str = "sample", rate: float = 1.0) -> DataFrame:
    """Families, samples, seconds (at ``rate`` samples a second) and largest magnitude of the total of each scenario."""
    totals = parts.groupBy(key, sample).agg(F.sum("p").alias("_p")).groupBy(key)
    m = totals.agg(F.count("*").alias("n_samples"), F.round(F.max(F.abs("_p")).cast("decimal(18, 4)"), 1).cast("double").alias("p_peak"))
    names = parts.select(key, F.col(family).cast("string").alias("_f")).distinct().groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("_f")), ",").alias("families"))
    return m.join(names, m[key].eqNullSafe(names[key])).select(m[key], "families", "n_samples", "p_peak", (F.col("n_samples") / rate).alias("duration_s"))
