"""Per-sample features over row frames of a recording.

A frame of ``w`` rows centred as ``rows(-(w // 2), w - w // 2 - 1)`` and divided by ``w`` pads
both ends with zeros; ``edge="shrink"`` divides by the rows there are instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from gridlens.functions.electrical import imbalance, neutral_ratio
from gridlens.operators.clean import by_sample, with_halo


def derivative(c: Column, w: WindowSpec, rate: float = 1.0) -> Column:
    """Central difference times the rate, one-sided at both ends."""
    before, after = F.lag(c).over(w), F.lead(c).over(w)
    first, last = F.lag(F.lit(1)).over(w).isNull(), F.lead(F.lit(1)).over(w).isNull()
    return rate * F.when(first, after - c).when(last, c - before).otherwise((after - before) / 2)


def _frame(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n // 2), n - n // 2 - 1)


def rolling_mean(c: Column, w: WindowSpec, n: int, edge: str = "zero") -> Column:
    """Missing where the frame has a missing sample; the value itself for frames below two."""
    if n < 2:
        return c
    f = _frame(w, n)
    size = F.lit(float(n)) if edge == "zero" else F.count(F.lit(1)).over(f).cast("double")
    return F.when(F.count(c).over(f) == F.count(F.lit(1)).over(f), F.sum(c).over(f) / size)


def rolling_std(c: Column, w: WindowSpec, n: int) -> Column:
    """sqrt(max(E[x^2] - E[x]^2, 0)) over the padded frame; 0 for frames below two."""
    if n < 2:
        return F.when(c.isNotNull(), F.lit(0.0))
    mean = rolling_mean(c, w, n)
    return F.when(mean.isNotNull(), F.sqrt(F.greatest(rolling_mean(c * c, w, n) - mean * mean, F.lit(0.0))))


def instant(c: Column, w: WindowSpec, n: int) -> Column:
    """Median of the last ``n`` samples."""
    return F.percentile(c, F.lit(0.5)).over(w.rowsBetween(-(n - 1), 0))


def add_features(df: DataFrame, *, rate: float, short: int, long: int, events: bool = True, imbalances: bool = True, distortion: bool = True, chunk: int | None = None) -> DataFrame:
    """Power features of ``p``, phase features of ``p1``-``p3``, and distortion features where the columns exist.

    With ``chunk``, long recordings are computed in chunks of so many rows with a halo; the result
    is the same.
    """
    has = set(df.columns)
    src = with_halo(df, long + 1, chunk) if chunk else df
    w = by_sample() if not chunk else by_sample().partitionBy("rid", "chunk").orderBy("i")
    p, out = F.col("p"), {}
    if events:
        out |= {"dp": derivative(p, w, rate), "p_mean_short": rolling_mean(p, w, short), "p_mean_long": rolling_mean(p, w, long), "p_std_short": rolling_std(p, w, short)}
    if imbalances and {"p1", "p2", "p3"} <= has:
        out |= {f"p{k}_mean_short": rolling_mean(F.col(f"p{k}"), w, short) for k in (1, 2, 3)}
        out["phase_imbalance"] = imbalance([F.col("p1"), F.col("p2"), F.col("p3")])
    if imbalances and {"i_n", "i1", "i2", "i3"} <= has:
        out["neutral_ratio"] = neutral_ratio(F.col("i_n"), [F.col("i1"), F.col("i2"), F.col("i3")])
    if distortion:
        for name in ("thd_i", "thd_v"):
            present = [F.col(c) for c in sorted(has) if c.startswith(name) and c[-1].isdigit()]
            if present:
                n = sum((c.isNotNull().cast("int") for c in present), F.lit(0))
                mean = sum((F.coalesce(c, F.lit(0.0)) for c in present), F.lit(0.0)) / F.nullif(n, F.lit(0))
                out[f"{name}_mean"] = rolling_mean(mean, w, short)
    out_df = src.withColumns(out)
    if events:
        out_df = out_df.withColumn("abs_dp", F.abs("dp"))
    return out_df.where("not extra").drop("extra", "chunk") if chunk else out_df
