"""Exploration: change points, event scores, fingerprints, clusters, profiles, further error measures."""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridlens.operators.clean import by_sample
from gridlens.operators.features import derivative
from gridlens.operators.meterpoint import phase_sums
from gridlens.sources.store import shared_folder


def cusum(df: DataFrame, target: float, drift: float, key: str = "rid", order: str = "i", p: str = "p") -> DataFrame:
    """Two-sided cumulative sums without reset: S minus its running minimum, and its running maximum minus S."""
    w = by_sample(key, order).rowsBetween(Window.unboundedPreceding, 0)
    step = F.coalesce(F.col(p), F.lit(target)) - target
    df = df.withColumns({"_up": F.sum(step - drift).over(w), "_down": F.sum(step + drift).over(w)})
    return df.withColumns({"cusum_up": F.col("_up") - F.least(F.lit(0.0), F.min("_up").over(w)), "cusum_down": F.greatest(F.lit(0.0), F.max("_down").over(w)) - F.col("_down")}).drop("_up", "_down")


def cusum_points(values: Sequence[float], threshold: float, drift: float) -> list[int]:
    """Change points with a reset at each: sums of steps away from the last reset value."""
    out, up, down, at = [], 0.0, 0.0, values[0] if len(values) else 0.0
    for i, v in enumerate(values):
        up, down = max(0.0, up + v - at - drift), max(0.0, down + at - v - drift)
        if up > threshold or down > threshold:
            out.append(i)
            up, down, at = 0.0, 0.0, v
    return out


def cusum_events(df: DataFrame, threshold: float, drift: float, key: str = "rid", order: str = "i", p: str = "p") -> DataFrame:
    """Change points of every recording, with reset: sequential within one recording."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        hits = cusum_points(pdf[p].fillna(0.0).tolist(), threshold, drift)
        return pd.DataFrame({key: pdf[key].iloc[hits].to_numpy(), "at": pdf[order].iloc[hits].to_numpy()})

    return df.select(key, order, p).groupBy(key).applyInPandas(run, f"{key} long, at long")


def hart_edges(df: DataFrame, least_w: float = 40.0, key: str | Sequence[str] = "rid", order: str = "i", p: str = "p") -> DataFrame:
    """Sample-to-sample steps of at least ``least_w``; with several keys, of each channel by itself."""
    keys = [key] if isinstance(key, str) else list(key)
    step = F.col(p) - F.lag(p).over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("dp", step).where(F.abs("dp") >= least_w).select(*keys, F.col(order).alias("at"), "dp")


def central_edges(df: DataFrame, least_w: float = 40.0, key: str = "rid", order: str = "i", p: str = "p") -> DataFrame:
    """Samples at which the power's central difference is at least ``least_w``: one row for each run of them, at its steepest sample (the first on ties)."""
    w = by_sample(key, order)
    steep = df.withColumn("dp", derivative(F.col(p), w)).withColumn("_s", F.abs("dp") >= least_w)
    fresh = (F.col("_s") & ~F.coalesce(F.lag("_s").over(w), F.lit(False))) | (F.signum("dp") != F.signum(F.lag("dp").over(w)))
    runs = steep.withColumn("_run", F.sum(fresh.cast("int")).over(w)).where("_s")
    return runs.groupBy(key, "_run").agg(F.max(F.struct(F.abs("dp").alias("a"), (-F.col(order)).alias("o"), "dp")).alias("_x")).select(key, (-F.col("_x.o")).alias("at"), F.col("_x.dp").alias("dp"))


def true_events(df: DataFrame, state: str, least_w: float = 50.0, key: str = "rid", order: str = "i", p: str = "p") -> DataFrame:
    """Changes of state with a step of at least ``least_w``."""
    w = by_sample(key, order)
    moved = df.withColumns({"dp": F.col(p) - F.lag(p).over(w), "_s": F.lag(state).over(w)})
    return moved.where((F.col(state) != F.col("_s")) & (F.abs("dp") >= least_w)).select(key, F.col(order).alias("at"), "dp")


def matched_times(times: Sequence[tuple[int, bool]], within: float) -> list[tuple[int, int]]:
    """(found, true) of a largest one-to-one matching of (time, is true) in order of time.

    Each event takes the earliest waiting one of the other kind that is near enough. As all events
    have the same tolerance, no other choice gives more pairs.
    """
    waiting, kind, out = deque(), False, []
    for t, true in times:
        while waiting and t - waiting[0] > within:
            waiting.popleft()
        if waiting and kind != true:
            w = waiting.popleft()
            out.append((w, t) if true else (t, w))
        else:
            kind = true
            waiting.append(t)
    return out


def matched_events(found: DataFrame, true: DataFrame, within: int, key: str = "rid") -> DataFrame:
    """One-to-one pairs (key, f, t) at most ``within`` apart. Repeated events count once.

    No pair crosses a gap longer than ``within``, so a recording is cut at such gaps: each run of events between
    them is a row of its own, and many are matched in one batch.
    """
    both = found.select(key, "at", F.lit(False).alias("true")).union(true.select(key, "at", F.lit(True))).where("at is not null").distinct()
    w = Window.partitionBy(key).orderBy("at", "true")
    new = F.coalesce(F.col("at") - F.lag("at").over(w) > within, F.lit(True)).cast("int")
    runs = both.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w)).groupBy(key, "_run")
    # A run of one kind of events has no pair.
    packed = runs.agg(F.array_sort(F.collect_list(F.struct("at", "true"))).alias("_e"), F.bool_or("true").alias("_some"), F.bool_and("true").alias("_all")).where("_some and not _all")

    @F.pandas_udf("array<struct<f:long,t:long>>")
    def pairs(at: pd.Series, true: pd.Series) -> pd.Series:
        return pd.Series([[{"f": f, "t": t} for f, t in matched_times(list(zip(a.tolist(), b.tolist(), strict=True)), within)] for a, b in zip(at, true, strict=True)])

    return packed.select(key, F.inline(pairs(F.col("_e.at"), F.col("_e.true"))))


def event_scores(found: DataFrame, true: DataFrame, within: int, key: str = "rid") -> DataFrame:
    """Precision, recall, F1 and mean timing error of a largest one-to-one matching within ``within`` units."""
    hits = matched_events(found, true, within, key).agg(F.count("*").alias("tp"), F.avg(F.abs(F.col("f") - F.col("t"))).alias("timing"))
    number = lambda df, n: df.select(key, "at").distinct().agg(F.count("*").alias(n))
    counts = number(found, "n_found").join(number(true, "n_true"), F.lit(True)).join(hits, F.lit(True))  # one row each
    return counts.select("n_found", "n_true", "tp", (F.col("tp") / F.nullif("n_found", F.lit(0))).alias("precision"), (F.col("tp") / F.nullif("n_true", F.lit(0))).alias("recall"), (2 * F.col("tp") / F.nullif(F.col("n_found") + F.col("n_true"), F.lit(0))).alias("f1"), "timing")


def paired_edges(found: DataFrame, key: str | Sequence[str] = "rid") -> DataFrame:
    """Each on-edge with the next edge if that goes off: start, end and watts.

    With the device or the phase among the keys, edges of others in between change nothing.
    """
    keys = [key] if isinstance(key, str) else list(key)
    w = Window.partitionBy(*keys).orderBy("at")
    nxt = found.withColumns({"end": F.lead("at").over(w), "_d": F.lead("dp").over(w)})
    return nxt.where("dp > 0 and _d < 0").select(*keys, F.col("at").alias("start"), "end", "dp")


def event_context(found: DataFrame, df: DataFrame, key: str = "rid", order: str = "i", ts: str = "ts") -> DataFrame:
    """For every edge: hour, day of the week (Monday is 1), seconds since the edge before, and,
    for an on-edge whose next edge goes off, the seconds that it stayed on."""
    at = found.join(df.select(key, F.col(order).alias("at"), F.col(ts).alias("_ts")), [key, "at"])
    w = Window.partitionBy(key).orderBy("at")
    us = F.unix_micros("_ts")
    off = (F.col("dp") > 0) & (F.lead("dp").over(w) < 0)
    return at.withColumns({
        "hour": F.hour("_ts"), "day": F.weekday("_ts") + 1,
        "since_s": (us - F.lag(us).over(w)) / 1e6, "on_s": F.when(off, (F.lead(us).over(w) - us) / 1e6),
    }).drop("_ts")


def fingerprints(df: DataFrame, family: str = "family", on_w: float = 3.0) -> DataFrame:
    """Steady medians and spread of every device while on."""
    m = lambda c: F.percentile(c, F.lit(0.5))
    return df.where(F.abs("p") > on_w).groupBy(family).agg(F.count("*").alias("n"), m("p").alias("p_med"), m("q").alias("q_med"), F.stddev_pop("p").alias("p_std"))


def transients(df: DataFrame, found: DataFrame, span: int, key: str = "rid", order: str = "i", p: str = "p") -> DataFrame:
    """Around each edge: peak over the steady median after it, samples to the peak, spread."""
    marks = found.where("dp > 0").select(key, "at", F.explode(F.sequence(F.col("at"), F.col("at") + (span - 1))).alias(order))
    x = marks.join(df.select(key, order, p), [key, order]).groupBy(key, "at")
    out = x.agg(F.max(p).alias("peak"), F.percentile(p, F.lit(0.5)).alias("steady"), (F.max_by(order, F.struct(F.col(p), -F.col(order))) - F.first("at")).alias("rise"), F.stddev_pop(p).alias("spread"))
    return out.withColumn("inrush", F.when(F.abs("steady") > 1e-6, F.col("peak") / F.col("steady")))


def device_edges(parts: DataFrame, span: int, least_w: float = 40.0, key: str = "scenario", order: str = "sample", device: str = "family") -> DataFrame:
    """Rising edges of a meter's total: what the total shows of each, and the device that switched.

    Shown: the steps of the phases and of the reactive power, peak, steady power, samples to the peak, spread, inrush.
    ``device`` is the truth, from the devices' own power: whose power rose most at that sample, the first by name on ties.
    """
    step = F.col("p") - F.lag("p").over(Window.partitionBy(key, device).orderBy(order))
    who = F.min(F.when(F.col("_step") > 0, F.struct(-F.col("_step"), F.col(device)))).alias("_who")
    total = phase_sums(parts.withColumn("_step", step), [key, order], who)
    phases = ["p1", "p2", "p3"]
    w = by_sample(key, order)
    total = total.withColumn("p", sum(F.col(c) for c in phases)).withColumn("_q", sum(F.col(c) for c in ("q1", "q2", "q3")))
    # What follows an edge is among the next rows, so samples are neither joined nor moved.
    moved = {f"d{c}": F.col(c) - F.lag(c).over(w) for c in ("p", *phases)} | {"dq": F.col("_q") - F.lag("_q").over(w)}
    ahead = F.array(F.struct(order, "p"), *[F.lead(F.struct(order, "p"), k).over(w) for k in range(1, span)])
    found = total.withColumns(moved | {"_ahead": ahead}).where((F.col("dp") >= least_w) & F.col("_who").isNotNull()).withColumn("at", F.col(order))
    found = found.withColumn("_p", F.transform(F.filter("_ahead", lambda x: (x[order] < F.col("at") + span) & x["p"].isNotNull()), lambda x: x["p"]))
    size, ranked = F.size("_p"), F.array_sort("_p")
    mean = F.aggregate("_p", F.lit(0.0), lambda a, x: a + x) / size
    steady = (F.get(ranked, F.floor((size - 1) / 2).cast("int")) + F.get(ranked, F.floor(size / 2).cast("int"))) / 2
    spread = F.sqrt(F.aggregate("_p", F.lit(0.0), lambda a, x: a + (x - F.col("_m")) * (x - F.col("_m"))) / size)
    shown = found.withColumns({"_m": mean, "peak": F.array_max("_p"), "steady": steady}).withColumns({"rise": (F.array_position("_p", F.col("peak")) - 1).cast("long"), "spread": spread, "inrush": F.when(F.abs("steady") > 1e-6, F.col("peak") / F.col("steady"))})
    return shown.select(key, "at", "peak", "steady", "rise", "spread", "inrush", *[f"d{c}" for c in phases], "dq", F.col(f"_who.{device}").alias(device))


def diurnal(df: DataFrame, ts: str = "ts", p: str = "p") -> DataFrame:
    """Mean power and share of negative samples by hour of the day."""
    return df.groupBy(F.hour(ts).alias("hour")).agg(F.count("*").alias("n"), F.avg(p).alias("p_mean"), F.avg((F.col(p) < 0).cast("int")).alias("share_negative"))


def autocorrelation(df: DataFrame, lags: Sequence[int], key: str = "rid", order: str = "i", p: str = "p") -> DataFrame:
    """Correlation of the power with itself some samples before, pooled over recordings."""
    w = by_sample(key, order)
    return df.select(F.col(p).alias("_p"), *[F.lag(p, k).over(w).alias(f"_l{k}") for k in lags]).agg(*[F.corr("_p", f"_l{k}").alias(f"lag_{k}") for k in lags])


def periods(df: DataFrame, chunk: int = 4096, key: str = "rid", order: str = "i", p: str = "p") -> DataFrame:
    """(key, period, strength): the dominant period of each recording in samples, from the power spectra of its chunks added up.

    Each chunk of ``chunk`` samples less its mean, missing samples as zero, is padded to twice its length; the inverse
    transform of the summed power spectra is the sum of the chunks' autocorrelations. The period is the lag of its
    highest value, of lags beyond the first negative one and up to half a chunk; null where there is none, or no power.
    Chunks are tasks of their own, so a recording of any length is many; a sum has ``chunk`` + 1 numbers.
    """
    rows = df.select(key, F.floor(F.col(order) / chunk).alias("_c"), (F.col(order) % chunk).cast("int").alias("_o"), F.col(p).cast("double").alias("_p"))
    packed = rows.groupBy(key, "_c").agg(F.collect_list(F.struct("_o", "_p")).alias("_s"))

    @F.pandas_udf("array<double>")
    def spectrum(at: pd.Series, values: pd.Series) -> pd.Series:
        out = []
        for o, v in zip(at, values, strict=True):
            v, x = np.asarray(v, dtype=float), np.zeros(2 * chunk)
            known = np.isfinite(v)
            if known.any():
                x[np.asarray(o)[known]] = v[known] - v[known].mean()
            out.append((np.abs(np.fft.rfft(x)) ** 2).tolist())
        return pd.Series(out)

    @F.pandas_udf("struct<period:long,strength:double>")
    def peak(power: pd.Series) -> pd.DataFrame:
        out = []
        for v in power:
            r = np.fft.irfft(np.asarray(v, dtype=float))[: chunk // 2 + 1]
            below = np.flatnonzero(r < 0)
            if r[0] <= 1e-9 or not len(below) or r[below[0] :].max() <= 0:
                out.append((None, None))
                continue
            k = int(below[0] + np.argmax(r[below[0] :]))
            out.append((k, float(r[k] / r[0])))
        return pd.DataFrame(out, columns=["period", "strength"]).astype({"period": "Int64"})

    spectra = packed.select(key, F.posexplode(spectrum(F.col("_s._o"), F.col("_s._p"))).alias("_k", "_v")).groupBy(key, "_k").agg(F.sum("_v").alias("_v"))
    whole = spectra.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_v"))), lambda s: s["_v"]).alias("_p"))
    return whole.select(key, peak("_p").alias("_x")).select(key, "_x.*")


def energy_errors(df: DataFrame, family: str = "family", actual: str = "p", predicted: str = "e") -> DataFrame:
    """Signal aggregate error, normalised error and energy F1 per family."""
    y, x = F.col(actual), F.col(predicted)
    s = df.groupBy(family).agg(F.sum(y).alias("y"), F.sum(x).alias("x"), F.sum((y - x) * (y - x)).alias("d2"), F.sum(y * y).alias("y2"), F.sum(F.least(y, x)).alias("m"))
    return s.select(family, (F.abs(F.col("x") - F.col("y")) / F.nullif(F.abs("y"), F.lit(0.0))).alias("sae"), (F.col("d2") / F.nullif("y2", F.lit(0.0))).alias("nde"), (2 * F.col("m") / F.nullif(F.col("x") + F.col("y"), F.lit(0.0))).alias("energy_f1"))


def contingency_scores(df: DataFrame, label: str, cluster: str) -> DataFrame:
    """Adjusted Rand index, normalised mutual information, homogeneity and completeness of a clustering."""
    n = df.groupBy(F.col(label).alias("l"), F.col(cluster).alias("c")).agg(F.count("*").cast("double").alias("n"))
    pair = lambda c: c * (c - 1) / 2
    whole, by_l, by_c = Window.partitionBy(), Window.partitionBy("l"), Window.partitionBy("c")
    t = n.withColumns({"a": F.sum("n").over(by_l), "b": F.sum("n").over(by_c)}).withColumn("t", F.sum("n").over(whole))
    s = t.agg(
        F.max("t").alias("t"), F.sum(pair(F.col("n"))).alias("i"), F.sum(pair(F.col("a")) * F.col("n") / F.col("a")).alias("a2"), F.sum(pair(F.col("b")) * F.col("n") / F.col("b")).alias("b2"),
        F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("a") * F.col("b")))).alias("mi"),
        F.sum(-F.col("n") / F.col("t") * F.log(F.col("a") / F.col("t"))).alias("hl"), F.sum(-F.col("n") / F.col("t") * F.log(F.col("b") / F.col("t"))).alias("hc"),
    )
    expected = F.col("a2") * F.col("b2") / F.nullif(pair(F.col("t")), F.lit(0.0))
    ari = F.coalesce((F.col("i") - expected) / F.nullif((F.col("a2") + F.col("b2")) / 2 - expected, F.lit(0.0)), F.lit(1.0))
    part = lambda d: F.when(d > 0, F.col("mi") / d).otherwise(1.0)
    return s.select(ari.alias("ari"), part((F.col("hl") + F.col("hc")) / 2).alias("nmi"), part(F.col("hl")).alias("homogeneity"), part(F.col("hc")).alias("completeness"))


def clustered(df: DataFrame, columns: Sequence[str], k: int, kind: str = "kmeans", seed: int = 3) -> tuple[DataFrame, float]:
    """Rows with ``cluster`` by standardised columns, and the silhouette."""
    rows = VectorAssembler(inputCols=list(columns), outputCol="_raw", handleInvalid="skip").transform(df)
    # Bisecting starts from the centre moved by a share of its own length: at a centre of zero it would never split.
    scale = StandardScaler(inputCol="_raw", outputCol="_x", withMean=kind != "bisecting")
    folder = shared_folder(df.sparkSession, "clusters")
    scale.fit(rows).transform(rows).write.parquet(folder)  # read once in each pass of the fit
    rows = df.sparkSession.read.parquet(folder)
    make = {"kmeans": KMeans, "gmm": GaussianMixture, "bisecting": BisectingKMeans}[kind]
    out = make(k=k, seed=seed, maxIter=20, featuresCol="_x", predictionCol="cluster").fit(rows).transform(rows)
    silhouette = ClusteringEvaluator(featuresCol="_x", predictionCol="cluster").evaluate(out) if out.select("cluster").distinct().count() > 1 else 0.0
    return out.drop("_raw", "_x", "probability"), silhouette


def principal_plane(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with their first two principal components ``x`` and ``y``."""
    from pyspark.ml.functions import vector_to_array

    rows = VectorAssembler(inputCols=list(columns), outputCol="_raw", handleInvalid="skip").transform(df)
    rows = StandardScaler(inputCol="_raw", outputCol="_x", withMean=True).fit(rows).transform(rows)
    out = PCA(k=2, inputCol="_x", outputCol="_pc").fit(rows).transform(rows).withColumn("_a", vector_to_array("_pc"))
    return out.withColumns({"x": F.col("_a")[0], "y": F.col("_a")[1]}).drop("_raw", "_x", "_pc", "_a")


def ward_merges(centres: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """Cluster of each weighted point after merging, pair by pair, those whose union adds least to the squared distances, down to ``k``."""
    centres, weights, of = centres.astype(float).copy(), weights.astype(float).copy(), np.arange(len(centres))
    live = list(range(len(centres)))
    while len(live) > k:
        c, w = centres[live], weights[live]
        cost = (w[:, None] * w[None, :] / (w[:, None] + w[None, :])) * ((c[:, None, :] - c[None, :, :]) ** 2).sum(axis=2)
        cost[np.tril_indices(len(live))] = np.inf
        i, j = (live[x] for x in np.unravel_index(np.argmin(cost), cost.shape))
        centres[i] = (weights[i] * centres[i] + weights[j] * centres[j]) / (weights[i] + weights[j])
        weights[i] += weights[j]
        of[of == j] = i
        live.remove(j)
    return np.searchsorted(live, of)


def agglomerated(df: DataFrame, columns: Sequence[str], k: int, micro: int = 64, seed: int = 3) -> DataFrame:
    """Rows with ``cluster`` by Ward merging: k-means makes ``micro`` small clusters of all rows, their weighted centres are merged to ``k``.

    The driver sees the small clusters only. Rows with a null are left out; columns are standardised.
    """
    rows = VectorAssembler(inputCols=list(columns), outputCol="_raw", handleInvalid="skip").transform(df)
    folder = shared_folder(df.sparkSession, "ward")
    StandardScaler(inputCol="_raw", outputCol="_x", withMean=True).fit(rows).transform(rows).write.parquet(folder)
    rows = df.sparkSession.read.parquet(folder)
    fitted = KMeans(k=micro, seed=seed, maxIter=20, featuresCol="_x", predictionCol="_m").fit(rows)
    small = fitted.transform(rows)
    sizes = {r["_m"]: r["count"] for r in small.groupBy("_m").count().collect()}  # at most ``micro`` rows
    used = sorted(sizes)
    of = ward_merges(np.array([fitted.clusterCenters()[m] for m in used]), np.array([sizes[m] for m in used]), k)
    cluster = F.element_at(F.create_map(*[F.lit(x) for m, c in zip(used, of.tolist(), strict=True) for x in (m, c)]), F.col("_m"))
    return small.withColumn("cluster", cluster).drop("_raw", "_x", "_m")
