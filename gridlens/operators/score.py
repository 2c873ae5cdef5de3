"""Scores and reports over predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridlens.operators.clean import tasks

def _ratio(a, b):
    return F.when(b != 0, a / b)


def class_f1(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """F1 of every class that occurs or is predicted; 0 without a hit. One aggregation, no join."""
    hit = (F.col(label) == F.col(prediction)).cast("int")
    both = df.select(F.explode(F.array(F.struct(F.col(label).alias("c"), hit.alias("tp"), (1 - hit).alias("fn"), F.lit(0).alias("fp")), F.struct(F.col(prediction).alias("c"), F.lit(0).alias("tp"), F.lit(0).alias("fn"), (1 - hit).alias("fp")))).alias("x"))
    sums = both.groupBy(F.col("x.c").alias("class")).agg(*[F.sum(f"x.{k}").alias(k) for k in ("tp", "fn", "fp")])
    return sums.withColumn("f1", F.coalesce(_ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)))


def macro_f1(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Unweighted mean of the classes' F1, and accuracy."""
    per = class_f1(df, label, prediction)
    return per.agg(F.avg("f1").alias("macro_f1"), (F.sum("tp") / F.sum(F.col("tp") + F.col("fn"))).alias("accuracy"))


def confusion(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Shares of each label's rows by prediction."""
    n = df.groupBy(label, prediction).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.greatest(F.lit(1), F.sum("n").over(Window.partitionBy(label))))


def presence_f1(df: DataFrame, family: str = "family", truth: str = "truth", pred: str = "pred") -> DataFrame:
    """Per family: F1 (null where it neither occurs nor is predicted) and support."""
    t, p = F.col(truth), F.col(pred)
    s = df.groupBy(family).agg(F.sum(t * p).alias("tp"), F.sum((1 - t) * p).alias("fp"), F.sum(t * (1 - p)).alias("fn"), F.sum(t).alias("support"))
    return s.withColumn("f1", _ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def mean_errors(df: DataFrame, actual: str, predicted: str, gate: str, family: str = "family") -> DataFrame:
    """Mean absolute error of the power and of the gated power, per family."""
    y = F.col(actual)
    return df.groupBy(family).agg(F.avg(F.abs(y - F.col(predicted))).alias("mae"), F.avg(F.abs(y - F.col(predicted) * F.col(gate))).alias("gated_mae"))


def set_accuracy(df: DataFrame, expected: str, key: str = "rid", family: str = "family", pred: str = "pred", share: float = 0.15) -> DataFrame:
    """Detected families (on in at least ``share`` of the windows) against the expected array, per recording."""
    per = df.groupBy(key, family).agg((F.avg(pred) >= share).alias("found"), F.max(expected).alias("e"))
    got = per.groupBy(key).agg(F.collect_set(F.when(F.col("found"), F.col(family))).alias("d"), F.max("e").alias("e"))
    hit, d, e = F.size(F.array_intersect("d", "e")), F.size("d"), F.size("e")
    precision, recall = F.coalesce(_ratio(hit, d), F.lit(0.0)), F.coalesce(_ratio(hit, e), F.lit(0.0))
    f1 = F.coalesce(_ratio(2.0 * hit, d + e), F.lit(0.0))
    names = lambda c: F.array_join(F.sort_array(c), ",")
    return got.select(key, F.round(precision, 3).alias("precision"), F.round(recall, 3).alias("recall"), F.round(f1, 3).alias("f1"), names(F.array_except("e", "d")).alias("missed"), names(F.array_except("d", "e")).alias("false_alarms"))


def family_report(df: DataFrame, window_s: float, family: str = "family", p: str = "p", pred: str = "pred", prob: str = "prob") -> DataFrame:
    """Energy, share of windows on, and mean confidence of the decisions."""
    sure = F.when(F.col(pred) == 1, F.col(prob)).otherwise(1 - F.col(prob))
    return df.groupBy(family).agg((F.sum(p) * window_s / 3.6e6).alias("energy_kwh"), F.avg(pred).alias("fraction_on"), F.avg(sure).alias("confidence"))


def explained(df: DataFrame, measured: str, predicted: str, key: str = "rid") -> DataFrame:
    """Share of the measured power that the prediction explains (may be negative), and the mean residual."""
    r = F.abs(F.col(measured) - F.col(predicted))
    return df.groupBy(key).agg((1 - F.sum(r) / F.greatest(F.sum(F.abs(measured)), F.lit(1e-9))).alias("explained"), F.avg(r).alias("mean_abs_residual"))


def two_best(df: DataFrame, keys: list[str], family: str = "family", prob: str = "prob") -> DataFrame:
    """Best and second family with their probabilities (by name on ties)."""
    s = F.sort_array(F.collect_list(F.struct((-F.col(prob)).alias("p"), F.col(family).alias("f"))))
    packed = df.groupBy(*keys).agg(s.alias("_s"))
    at = lambda k, f: F.get("_s", F.lit(k))[f]
    return packed.select(*keys, at(0, "f").alias("best"), (-at(0, "p")).alias("p_best"), at(1, "f").alias("second"), (-at(1, "p")).alias("p_second"))


def seconds_by_family(df: DataFrame, stride_s: float, best: str = "best") -> DataFrame:
    return df.groupBy(best).agg((F.count("*") * stride_s).alias("seconds")).orderBy(F.desc("seconds"), best)


def live_score(df: DataFrame, keys: list[str], p: str = "p", truth: str = "truth", pred: str = "pred") -> DataFrame:
    """Window truth by majority, then counts, presence accuracy and power error."""
    w = df.groupBy(*keys, "family").agg((F.avg(truth) >= 0.5).cast("int").alias("t"), F.max(pred).alias("d"), F.avg(p).alias("p"), F.avg(F.col(p) * F.col(pred)).alias("g"))
    t, d = F.col("t"), F.col("d")
    return w.groupBy("family").agg(
        F.sum(t * d).alias("tp"), F.sum((1 - t) * d).alias("fp"), F.sum(t * (1 - d)).alias("fn"), F.sum((1 - t) * (1 - d)).alias("tn"),
        F.avg((t == d).cast("int")).alias("accuracy"), F.avg(F.abs(F.col("p") - F.col("g"))).alias("mae"),
    )


def label_score(df: DataFrame, expected: str, on_w: float = 5.0, key: str = "rid", win: str = "win", family: str = "family", pred: str = "pred", instant: str = "instant") -> DataFrame:
    """Predicted device sets against the label's, at ticks where the power now exceeds max(10, ``on_w``): counts, F1 in three digits, ticks scored.

    ``expected`` is an array, the same for all rows of a recording; a tick's power is its largest ``instant``.
    """
    ticks = df.groupBy(key, win).agg(F.collect_set(F.when(F.col(pred) == 1, F.col(family))).alias("d"), F.max(expected).alias("e"), F.max(F.abs(instant)).alias("_w"))
    ticks = ticks.where(F.col("_w") > max(10.0, on_w))
    size = lambda c: F.sum(F.size(c))
    out = ticks.groupBy(key).agg(size(F.array_intersect("d", "e")).alias("tp"), size(F.array_except("d", "e")).alias("fp"), size(F.array_except("e", "d")).alias("fn"), F.count("*").alias("n"))
    hit = 2.0 * F.col("tp")
    return out.withColumn("f1", F.round(hit / F.greatest(F.lit(1.0), hit + F.col("fp") + F.col("fn")), 3))


def family_truth(contributions: DataFrame, recordings: DataFrame, families: str, keys: list[str], key: str = "scenario", family: str = "family", p: str = "p", state: str = "state") -> DataFrame:
    """(keys, family, p, on): power summed by family, on where any device's state is ``on`` (its magnitude above 3 W where it has none).

    Recordings without contributions get a row for each family of their label, power and state unknown.
    Contributions are dealt by their keys to tasks of a bounded number of rows.
    """
    n, on = tasks(contributions), F.coalesce(F.col(state) == "on", F.abs(p) > 3)
    known = contributions.select(*keys, family, p, on.alias("on")).repartition(n, *keys).groupBy(*keys, family).agg(F.sum(p).alias(p), F.bool_or("on").alias("on"))
    rest = recordings.join(contributions.select(key).repartition(n, key), key, "left_anti").select(key, F.explode(families).alias(family)).distinct()
    return known.unionByName(rest, allowMissingColumns=True)


def timeline(df: DataFrame, families: list[str], total: str = "total", key: str = "rid", win: str = "win", family: str = "family", prob: str = "prob", pred: str = "pred", p: str = "p", window_s: float = 10.0) -> DataFrame:
    """A row per window: the hour since the recording's start at which it begins, total, residual (total less what is on), then on, probability and watts of every family.

    Watts of a family that is off are 0; watts have one digit and probabilities three, half up on the decimal value.
    """
    watts = lambda c: F.round(c.cast("decimal(18,4)"), 1).cast("double")
    on = F.max(pred)
    per = df.groupBy(key, win, family).agg(on.alias("on"), F.max(prob).alias("prob"), (F.sum(p) * on).alias("w"), F.max(total).alias("_t"))
    at = lambda f, c: F.max(F.when(F.col(family) == f, F.col(c)))
    wide = [x for k, f in enumerate(families, start=1) for x in (F.coalesce(at(f, "on"), F.lit(0)).alias(f"on_{k}"), F.round(at(f, "prob").cast("decimal(18,6)"), 3).cast("double").alias(f"prob_{k}"), watts(F.coalesce(at(f, "w"), F.lit(0.0))).alias(f"w_{k}"))]
    return per.groupBy(key, win).agg((F.col(win) * window_s / 3600).alias("hour"), watts(F.max("_t")).alias("total"), watts(F.max("_t") - F.sum("w")).alias("residual"), *wide)


def mix_summary(windows: DataFrame, window_s: float, key: str = "rid", win: str = "win", family: str = "family") -> tuple[DataFrame, DataFrame]:
    """(by family, by recording) of (key, win, family, on, prob, watts, total), where ``watts`` is gated by ``on``.

    By family: share of the recording's windows on, energy. By recording: mean confidence of the
    decisions, share of the power explained, mean absolute residual.
    """
    count = windows.groupBy(key).agg(F.countDistinct(win).alias("_n"))
    by = windows.groupBy(key, family).agg(F.sum("on").alias("_on"), (F.sum("watts") * window_s / 3.6e6).alias("energy_kwh"))
    by = by.join(count, key).select(key, family, (F.col("_on") / F.col("_n")).alias("fraction_on"), "energy_kwh")
    sure = F.when(F.col("on") == 1, F.col("prob")).otherwise(1 - F.col("prob"))
    per = windows.groupBy(key, win).agg(F.max("total").alias("_t"), F.sum("watts").alias("_w"), F.sum(sure).alias("_c"), F.count(sure).alias("_k"))
    gap = F.abs(F.col("_t") - F.col("_w"))
    whole = per.groupBy(key).agg((F.sum("_c") / F.sum("_k")).alias("confidence"), (1 - F.sum(gap) / F.greatest(F.sum(F.abs("_t")), F.lit(1e-9))).alias("explained"), F.avg(gap).alias("residual_w"))
    return by, whole


def painted(samples: DataFrame, windows: DataFrame, stride: int, length: int, key: str = "rid", order: str = "i", win: str = "win") -> DataFrame:
    """Every sample with the columns of the window over it; where windows overlap the one that begins last wins.

    Window k covers ``length`` samples from k * ``stride`` on. An interval join by equal stretches of ``stride``
    samples: a window is dealt to the few it reaches into. Samples under no window are left out.
    """
    values = [c for c in windows.columns if c not in (key, win)]
    reach = windows.withColumn("_b", F.explode(F.sequence(F.col(win), F.col(win) + (length - 1) // stride)))
    over = samples.withColumn("_b", F.floor(F.col(order) / stride)).join(reach, [key, "_b"]).where(F.col(order) < F.col(win) * stride + length)
    last = over.groupBy(key, order).agg(F.max_by(F.struct(*values), win).alias("_x"))
    return last.select(key, order, *[F.col(f"_x.{c}").alias(c) for c in values])
