"""Edges, claims and device states. The sequential rules are pure functions over sorted rows,
shared by the batch operators here and by the stream."""

from __future__ import annotations

import math
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlens.functions.labels import family as family_of
from gridlens.functions.labels import is_mixed
from gridlens.operators.clean import CHUNK, by_sample, carried, with_halo
from gridlens.sources.store import shared_folder

EDGE_W, SETTLED_W, SETTLED_SHARE = 8.0, 6.0, 0.05
#: Watts by which doubles may miss a limit that a step of whole hundredths just reaches.
NOISE = 1e-9


def edges(df: DataFrame, side: int, span: int, key: str = "rid", order: str = "i", least_w: float = EDGE_W, size: int = CHUNK) -> DataFrame:
    """Settled steps: medians of the first and last ``side`` of ``span`` samples, at the sample before the largest jump between them.

    Evaluated at every sample that ends a whole span; both sides must be settled. Chunks of ``size`` samples see a span
    of the one before, so a long recording is many tasks' work.
    """
    df, w = with_halo(df, span + 1, size, order), Window.partitionBy(key, "chunk").orderBy(order)
    last, first = w.rowsBetween(-(side - 1), 0), w.rowsBetween(-(span - 1), -(span - side))
    half = lambda c, f: F.percentile(F.col(c), F.lit(0.5)).over(f)
    jump = F.abs(F.col("p") - F.lag("p").over(w))
    df = df.withColumn("_jump", F.struct(jump.alias("d"), (-F.lag(order).over(w)).alias("o")))
    out = df.withColumns({
        "n": F.count("*").over(w.rowsBetween(-(span - 1), 0)),
        "p0": half("p", first), "p1": half("p", last), "q0": half("q", first), "q1": half("q", last),
        "s0": F.stddev_pop("p").over(first), "s1": F.stddev_pop("p").over(last),
        "at": -F.max("_jump").over(w.rowsBetween(-(span - side - 2), -side))["o"],
    }).drop("_jump")
    out = out.withColumns({"dp": F.col("p1") - F.col("p0"), "dq": F.col("q1") - F.col("q0")})
    settled = lambda s, p: F.col(s) <= F.greatest(F.lit(SETTLED_W), SETTLED_SHARE * F.abs(p)) + NOISE
    step = (F.abs("dp") >= least_w - NOISE) | (F.abs("dq") >= 2 * least_w - NOISE)
    return out.where(~F.col("extra") & (F.col("n") == span) & step & settled("s0", "p0") & settled("s1", "p1")).select(key, order, "at", "dp", "dq", F.col("p1").alias("p_after"))


def accept(times: Iterable[float], gap: float) -> list[bool]:
    """Which edges stay when each must follow the last accepted one by ``gap``."""
    out, last = [], -math.inf
    for t in times:
        ok = t - last >= gap
        out.append(ok)
        if ok:
            last = t
    return out


def debounce(found: DataFrame, gap: float, key: str = "rid", at: str = "at") -> DataFrame:
    """Sequential per recording; edges are few, so a recording's edges are one row, and many recordings are one batch."""

    @F.pandas_udf("array<boolean>")
    def kept(times: pd.Series) -> pd.Series:
        return times.map(lambda x: accept(x.tolist(), gap))

    rest = [c for c in found.columns if c not in (key, at)]
    packed = found.where(F.col(at).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(at, *rest))).alias("_e"))
    both = packed.select(key, F.explode(F.arrays_zip("_e", kept(F.col(f"_e.{at}")).alias("_k"))).alias("_x")).where("_x._k")
    return both.select(key, "_x._e.*").select(*found.columns)


def signatures(df: DataFrame, key: str = "rid", family: str = "family", on_w: float = 3.0, least: int = 25) -> DataFrame:
    """Median P and Q of the samples on, for recordings with enough of them."""
    on = df.where(F.abs("p") > on_w)
    return on.groupBy(key, family).agg(F.count("*").alias("n"), F.percentile("p", F.lit(0.5)).alias("p_sig"), F.percentile("q", F.lit(0.5)).alias("q_sig")).where(f"n >= {least}").drop("n")


def distance(dp: Column, dq: Column, p: Column, q: Column) -> Column:
    return F.hypot(dp - p, dq - q) / F.greatest(F.lit(20.0), 0.35 * F.hypot(p, q))


def decimal_digits(c: Column) -> Column:
    """Nine decimal digits, which neither the order of nearly equal distances nor a half in rounding leaves to the doubles."""
    return c.cast("decimal(18, 9)")


def match(found: DataFrame, known: list[tuple[str, float, float]], least: float = 0.25) -> DataFrame:
    """Nearest signature of each edge (off-edges negated first), with confidence 1 - distance in two digits.

    ``known`` holds one (family, P, Q) for each device type; edges are compared with it in place,
    without a join.
    """
    sign = F.when(F.col("dp") < 0, -1.0).otherwise(1.0)
    options = [F.struct(decimal_digits(distance(sign * F.col("dp"), sign * F.col("dq"), F.lit(float(p)), F.lit(float(q)))).alias("d"), F.lit(f).alias("family")) for f, p, q in known]
    best = F.array_min(F.array(*options)) if options else F.lit(None).cast("struct<d:decimal(18, 9),family:string>")
    out = found.withColumn("_b", best).withColumn("confidence", F.round(1 - F.col("_b.d"), 2).cast("double"))
    good = (F.abs("dp") >= EDGE_W - NOISE) & (F.col("_b.d") < 1) & (F.col("confidence") >= least)
    return out.withColumns({"family": F.when(good, F.col("_b.family")), "confidence": F.when(good, F.col("confidence"))}).drop("_b")


def pure_signatures(df: DataFrame, key: str = "rid", label: str = "label", on_w: float = 3.0, least: int = 25) -> DataFrame:
    """(signature, family, p_sig, q_sig): one for each recording of a single device type; recordings with a mixed label have none."""
    alone = df.where(F.col(label).isNotNull() & ~is_mixed(F.col(label))).withColumn("family", family_of(F.col(label)))
    return signatures(alone, key, "family", on_w, least).withColumnRenamed(key, "signature")


#: Sides of the cells of a tree of signatures, in watts, from the widest on; nodes that an edge is held against at first,
#: signatures of one leaf (as one of them finds it, in the mean), and rows of a table that is sent to every task.
CELLS, ROOTS, LEAF, SENT = [2.0**k for k in range(40, -21, -1)], 64, 8, 50_000


def _bounds(x: Column, y: Column, node) -> tuple[Column, Column]:  # noqa: ANN001
    """Least and largest distance that an edge can have to a node's signatures, of their box and their least and largest reach."""
    out = lambda v, low, high: F.greatest(low - v, v - high, F.lit(0.0))
    far = lambda v, low, high: F.greatest(F.abs(v - low), F.abs(v - high))
    p, q = (node("p0"), node("p1")), (node("q0"), node("q1"))
    return F.hypot(out(x, *p), out(y, *q)) / node("r1"), F.hypot(far(x, *p), far(y, *q)) / node("r0")


def met_signatures(found: DataFrame, known: DataFrame, least: float = 0.25, keys: tuple[str, ...] = ("rid", "i")) -> DataFrame | None:
    """(keys, family, distance): each edge with the few signatures among which its nearest is, by a tree of cells; none without signatures.

    A node of the tree is a square of the (P, Q) plane with the box and the reach of its signatures, and an edge goes down
    from level to level: of the nodes under those that it has reached it keeps the ones that can hold its nearest
    signature, as none of them is nearer than the farthest signature of another is. So it meets a few leaves' signatures,
    however many there are; equal signatures of a family are one. Each level is an equi-join by the node above.
    """
    spark = found.sparkSession
    folder = shared_folder(spark, "signatures")
    known.where(F.abs("p_sig") + F.abs("q_sig") < float("inf")).select("family", "p_sig", "q_sig").distinct().withColumn("reach", F.greatest(F.lit(20.0), 0.35 * F.hypot("p_sig", "q_sig"))).write.parquet(folder)
    points = spark.read.parquet(folder)
    cell = lambda size: (F.floor(F.col("p_sig") / size).alias("_x"), F.floor(F.col("q_sig") / size).alias("_y"))
    every = points.select("p_sig", "q_sig", F.posexplode(F.array(*map(F.lit, CELLS))).alias("_k", "_size"))
    filled = every.groupBy("_k", *cell(F.col("_size"))).count().groupBy("_k").agg(F.count("*").alias("n"), F.sum(F.col("count") * F.col("count")).alias("n2"), F.sum("count").alias("all"))
    levels = {r["_k"]: r for r in filled.collect()}  # a row for each size
    if not levels:
        return None
    top = max((k for k, r in levels.items() if r["n"] <= ROOTS), default=0)
    leaf = next((k for k in range(top, len(CELLS)) if levels[k]["n2"] <= LEAF * levels[k]["all"]), len(CELLS) - 1)

    box = {"p0": F.min("p_sig"), "p1": F.max("p_sig"), "q0": F.min("q_sig"), "q1": F.max("q_sig"), "r0": F.min("reach"), "r1": F.max("reach")}
    nodes = lambda k: points.groupBy(*cell(CELLS[k])).agg(*[c.alias(n) for n, c in box.items()])
    sent = lambda df, n: F.broadcast(df) if n <= SENT else df
    roots = F.array(*[F.struct(*[F.lit(r[c]).alias(c) for c in ("_x", "_y", *box)]) for r in nodes(top).collect()])  # about ``ROOTS`` rows
    x, y = F.col("_p"), F.col("_q")
    # Distances count in nine digits, so what is farther by less may be as near.
    reached = lambda low, best: (low <= best + 1e-8) & (low <= 1 - least + 0.01)
    sign = F.when(F.col("dp") < 0, -1.0).otherwise(1.0)
    near = found.where(F.abs("dp") >= EDGE_W - NOISE).select(*keys, (sign * F.col("dp")).alias("_p"), (sign * F.col("dq")).alias("_q"))
    near = near.withColumn("_best", F.array_min(F.transform(roots, lambda r: _bounds(x, y, r.getField)[1])))
    near = near.select(*keys, "_p", "_q", F.explode(F.filter(roots, lambda r: reached(_bounds(x, y, r.getField)[0], F.col("_best")))).alias("_n")).select(*keys, "_p", "_q", "_n._x", "_n._y")
    for k in range(top + 1, leaf + 1):
        below = nodes(k).select("*", F.floor(F.col("_x") / 2).alias("_up_x"), F.floor(F.col("_y") / 2).alias("_up_y"))
        low, high = _bounds(x, y, F.col)
        near = near.withColumnsRenamed({"_x": "_up_x", "_y": "_up_y"}).join(sent(below, levels[k]["n"]), ["_up_x", "_up_y"]).select(*keys, "_p", "_q", "_x", "_y", low.alias("_low"), high.alias("_high"))
        near = near.withColumn("_best", F.min("_high").over(Window.partitionBy(*keys))).where(reached(F.col("_low"), F.col("_best"))).select(*keys, "_p", "_q", "_x", "_y")
    d = distance(x, y, F.col("p_sig"), F.col("q_sig"))
    met = near.join(sent(points.select("*", *cell(CELLS[leaf])), levels[leaf]["all"]), ["_x", "_y"])
    return met.select(*keys, "family", decimal_digits(F.when(d < 2, d)).alias("_d"))


def match_table(found: DataFrame, known: DataFrame, least: float = 0.25, keys: tuple[str, ...] = ("rid", "i")) -> DataFrame:
    """``match`` against a table of signatures (signature, family, p_sig, q_sig) of any size.

    Of equally near signatures the first by family counts. Edges without a match keep nulls.
    """
    met = met_signatures(found, known, least, keys)
    if met is None:
        return found.withColumns({"family": F.lit(None).cast("string"), "confidence": F.lit(None).cast("double")})
    best = met.where("_d < 1").groupBy(*keys).agg(F.min(F.struct("_d", "family")).alias("_b"))
    best = best.select(*keys, F.col("_b.family").alias("family"), F.round(1 - F.col("_b._d"), 2).cast("double").alias("confidence")).where(F.col("confidence") >= least)
    return found.join(best, list(keys), "left")


class Claims:
    """Which devices are claimed to be on, by edges: the sequential rules of one meter."""

    def __init__(self, least: float = 0.30, hold: float = 15.0, settle: float = 6.0):
        self.least, self.hold, self.settle = least, hold, settle
        self.on: dict[str, tuple[float, float, float]] = {}  # family: watts, confidence, since
        self.held: dict[str, float] = {}  # family: until when it stays off

    def edge(self, t: float, dp: float, family: str | None, confidence: float | None) -> str | None:
        """Apply an edge; the device that it switched, if any."""
        if dp > 0:
            if family is None or confidence is None or confidence < self.least:
                return None
            self.on[family] = (abs(dp), confidence, t)
            self.held.pop(family, None)
            return family
        name = family if family in self.on else None
        if name is None:
            # The claim whose watts explain the step best, in relation to them; the older one on a tie.
            fits = {f: abs(abs(dp) - w) / max(w, 20.0) for f, (w, _, _) in self.on.items()}
            best = min(fits, key=fits.get, default=None)
            name = best if best is not None and fits[best] < 0.35 else None
        if name is not None:
            del self.on[name]
            self.held[name] = t + self.hold
        elif family is not None:  # on before the first sample seen: kept off while the window still shows it
            self.held[family] = t + self.hold
        return name

    def guard(self, t: float, power: float) -> list[str]:
        """At a tick: forget past holds, and drop claims while all of them together exceed the settled power.

        Of the claims that are ``settle`` or older, in order of confidence (the older one first on a tie), the shortest run
        goes that leaves no more than the power and max(30 W, a tenth of what is left).
        """
        self.held = {f: until for f, until in self.held.items() if until > t}
        old = sorted((f for f, (_, _, since) in self.on.items() if t - since >= self.settle), key=lambda f: self.on[f][1])
        left = sum(w for w, _, _ in self.on.values())
        dropped = []
        for f in old:
            if left <= power + max(30.0, 0.1 * left) + NOISE:
                break
            dropped.append(f)
            left -= self.on[f][0]
        for f in dropped:
            del self.on[f]
        return dropped


def ticks(df: DataFrame, stride: int, side: int, key: str = "rid", order: str = "i") -> DataFrame:
    """(key, order, p_now): the settled power, median of the last ``side`` samples, at every ``stride``-th sample."""
    w = by_sample(key, order).rowsBetween(-(side - 1), 0)
    return df.select(key, order, F.percentile("p", F.lit(0.5)).over(w).alias("p_now")).where(F.col(order) % stride == 0)


def claims(matched: DataFrame, at_ticks: DataFrame, rate: float = 1.0, key: str = "rid", at: str = "at", order: str = "i") -> DataFrame:
    """Switch events of every recording: its matched edges in order, guarded at its ticks, so a missed off-edge needs no further edge.

    Edges and ticks are numbered by sample; ages and holds are seconds at ``rate`` samples a second. A tick follows
    the edges that were seen by then (``order``). A drop is a row with the tick's sample.
    """
    edge = matched.select(key, F.col(order).alias("seen"), F.lit(0).alias("tick"), at, "dp", "p_after", "family", "confidence")
    tick = at_ticks.select(key, F.col(order).alias("seen"), F.lit(1).alias("tick"), F.col(order).alias(at), F.lit(None).cast("double").alias("dp"), F.col("p_now").alias("p_after"), F.lit(None).cast("string").alias("family"), F.lit(None).cast("double").alias("confidence"))

    # A recording is one row of arrays, and many recordings are one batch: no frame is made of each.
    columns = ["tick", at, "dp", "p_after", "family", "confidence"]
    packed = edge.unionByName(tick).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seen", "tick", at, "dp", "p_after", "family", "confidence"))).alias("_e"))

    @F.pandas_udf(f"array<struct<{at}:long,kind:string,device:string,watts:double>>")
    def switched(*arrays: pd.Series) -> pd.Series:
        out = []
        for recording in zip(*arrays, strict=True):
            state, rows = Claims(hold=15 * rate, settle=6 * rate), []  # in samples: seconds of a fifth don't add up in doubles
            for is_tick, t, dp, p_after, family, confidence in zip(*(x.tolist() for x in recording), strict=True):
                if is_tick:
                    rows += [(t, "dropped", f, 0.0) for f in state.guard(t, p_after)]
                elif name := state.edge(t, dp, family, confidence if family else None):
                    rows.append((t, "on" if dp > 0 else "off", name, abs(dp)))
            out.append([dict(zip((at, "kind", "device", "watts"), r, strict=True)) for r in rows])
        return pd.Series(out)

    return packed.select(key, F.inline(switched(*[F.col(f"_e.{c}") for c in columns])))


def hysteresis(prob: Column, w, high: float = 0.55, low: float = 0.45) -> Column:
    """On at ``high``, off below ``low``, else as before (off at first): the last decisive value."""
    decisive = F.when(prob >= high, 1).when(prob < low, 0)
    return F.coalesce(F.last(decisive, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))


def device_on(df: DataFrame, prob: Column, keys: list[str], order: str, high: float = 0.55, low: float = 0.45, size: int = CHUNK) -> DataFrame:
    """``hysteresis`` as column ``state`` of a long table: the last decisive value is carried from chunk to chunk."""
    decisive = F.when(prob >= high, 1).when(prob < low, 0)
    return carried(df, decisive, "state", keys, order, size=size).withColumn("state", F.coalesce("state", F.lit(0)))


def merge(df: DataFrame, keys: list[str], total: str, claimed: str, modelled: str, held: str) -> DataFrame:
    """Claims win; held-off devices are off; model watts are scaled down into what claims leave, never up."""
    w = Window.partitionBy(*keys)
    claim = F.coalesce(F.col(claimed), F.lit(0.0))
    model = F.when(F.col(claimed).isNotNull() | F.col(held), 0.0).otherwise(F.col(modelled))
    rest = F.greatest(F.lit(0.0), F.col(total) - F.sum(claim).over(w))
    want = F.sum(model).over(w)
    return df.withColumn("watts", claim + model * F.when(want > 0, F.least(F.lit(1.0), rest / want)).otherwise(0.0))


def residual(df: DataFrame, keys: list[str], total: str, watts: str) -> DataFrame:
    """Residual and explained share of each tick, within 0 and 1; 1 where the total is at most 1 W."""
    s = df.groupBy(*keys).agg(F.max(total).alias("total"), F.sum(watts).alias("_w"))
    r = F.col("total") - F.col("_w")
    share = F.when(F.abs("total") <= 1, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.abs(r) / F.abs("total"))))
    return s.select(*keys, "total", r.alias("residual"), share.alias("explained"))


def transitions(df: DataFrame, state: str, keys: list[str], order: str) -> DataFrame:
    """Rows where the state differs from the one before (off before the first)."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_before", F.coalesce(F.lag(state).over(w), F.lit(0))).where(F.col(state) != F.col("_before")).drop("_before")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str, out: str) -> DataFrame:
    """Each left row with the latest right ``value`` at or before it: one union, one window, no range join."""
    mark = right.select(*keys, at, F.col(value).alias(out), F.lit(0).alias("_side"), F.lit(None).cast(_struct(left)).alias("_row"))
    rows = left.select(*keys, at, F.lit(None).cast(right.schema[value].dataType).alias(out), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"))
    w = Window.partitionBy(*keys).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = mark.unionByName(rows).withColumn(out, F.last(out, True).over(w)).where("_side = 1")
    return both.select("_row.*", out)


def _struct(df: DataFrame):
    from pyspark.sql.types import StructType

    return StructType(df.schema.fields)


def islands(df: DataFrame, condition: Column, keys: list[str], order: str, at: str, least: float) -> DataFrame:
    """Runs of rows where the condition holds for at least ``least`` (in units of ``at``)."""
    w = Window.partitionBy(*keys).orderBy(order)
    marked = df.withColumn("_c", F.coalesce(condition, F.lit(False)))
    new = marked.withColumn("_new", (F.col("_c") & ~F.coalesce(F.lag("_c").over(w), F.lit(False))).cast("int")).withColumn("run", F.sum("_new").over(w))
    runs = new.where("_c").groupBy(*keys, "run").agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count("*").alias("n"))
    return runs.where(F.col("end") - F.col("start") >= least)


def segments(df: DataFrame, off_w: float = 5.0, on_w: float = 8.0, off_hold: int = 1, on_hold: int = 1, tail_hold: int = 1, key: str = "rid", order: str = "i") -> DataFrame:
    """Lead, run and tail of a recording, each told by a power that holds.

    The lead ends, and the run begins, at the first sample after at least ``off_hold`` quiet ones
    (below ``off_w``) from which ``on_hold`` samples in a row are above ``on_w``; the tail begins
    at the first of ``tail_hold`` quiet samples in a row after that. Without a run all is lead.
    """
    whole, w = Window.partitionBy(key), by_sample(key, order)
    held = lambda c, n, ahead: F.min(c.cast("int")).over(w.rowsBetween(0, n - 1) if ahead else w.rowsBetween(-n, -1)) == 1
    enough = lambda n, ahead: F.count("*").over(w.rowsBetween(0, n - 1) if ahead else w.rowsBetween(-n, -1)) == n
    on, off = F.coalesce(F.abs("p") > on_w, F.lit(False)), F.coalesce(F.abs("p") < off_w, F.lit(False))
    begins = held(on, on_hold, True) & enough(on_hold, True)
    if off_hold:
        quiet = F.max(F.when(held(off, off_hold, True) & enough(off_hold, True), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -off_hold))
        begins = begins & (F.coalesce(quiet, F.lit(0)) == 1)
    df = df.withColumn("_b", F.when(begins, F.col(order))).withColumn("_q", F.when(held(off, tail_hold, True) & enough(tail_hold, True), F.col(order)))
    df = df.withColumn("_first", F.min("_b").over(whole))
    df = df.withColumn("_tail", F.min(F.when(F.col("_q") > F.col("_first"), F.col("_q"))).over(whole))
    first, last = F.col("_first"), F.coalesce(F.col("_tail") - 1, F.max(F.col(order)).over(whole))
    part = F.when(first.isNull() | (F.col(order) < first), "lead").when(F.col(order) > last, "tail").otherwise("run")
    return df.withColumn("part", part).withColumn("quiet", F.abs("p") < off_w).drop("_b", "_q", "_first", "_tail")


def switch_times(df: DataFrame, found: DataFrame, window: float, key: str = "rid", device: str = "device", at: str = "at", last: int = 12, others: DataFrame | None = None) -> DataFrame:
    """On and off events of (key, device, at, state, claimed since): when each switched.

    On: the claim's time; else the latest matching on-edge within ``window`` + 6 before, if it is
    among the meter's last ``last`` events; else half a window before. Off: half a window before.
    ``found`` holds on-edges (key, device, at), ``others`` (key, at) all further events, which count among the last
    as well. As-of by one union and one window.
    """
    moves = transitions(df, "state", [key, device], at).select(key, device, at, "state", "since")
    log = found.select(key, device, at, F.lit(1).alias("_mine"))
    if others is not None:
        log = others.select(key, F.lit(None).cast("string").alias(device), at, F.lit(0).alias("_mine")).unionByName(log)
    log = log.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(at, "_mine", device)))
    last_n = as_of(moves, log.select(key, F.lit(None).cast("string").alias(device), at, "_n"), [key], at, "_n", "_seen")
    marks = log.where("_mine = 1").drop("_mine")
    edge = F.struct(F.col(at).alias("t"), F.col("_n").alias("n"))
    matched = as_of(last_n, marks.withColumn("_e", edge), [key, device], at, "_e", "_edge")
    near = (F.col(at) - F.col("_edge.t") < window + 6) & (F.col("_seen") - F.col("_edge.n") < last)
    when = F.when(F.col("state") == 0, F.col(at) - window / 2).otherwise(F.coalesce("since", F.when(near, F.col("_edge.t")), F.col(at) - window / 2))
    return matched.select(key, device, at, "state", when.cast("double").alias("switched"))


def unknown_load(ticks: DataFrame, persist: float = 8.0, least_w: float = 30.0, share: float = 0.15, key: str = "rid", at: str = "at") -> DataFrame:
    """Runs of ticks (key, at, total, residual, settling) whose residual stays above max(``least_w``, ``share`` of the total).

    Ticks while settling never count. A run is reported once it has lasted ``persist``: when it
    began, was detected, and was cleared (null: still there), and its last residual.
    """
    over = (F.abs("residual") > F.greatest(F.lit(least_w), share * F.abs("total"))) & ~F.coalesce("settling", F.lit(False))
    w = Window.partitionBy(key).orderBy(at)
    marked = ticks.withColumn("_c", F.coalesce(over, F.lit(False))).withColumn("_next", F.lead(at).over(w))
    marked = marked.withColumn("_new", (F.col("_c") & ~F.coalesce(F.lag("_c").over(w), F.lit(False))).cast("int")).withColumn("_run", F.sum("_new").over(w))
    first = F.min(at).over(Window.partitionBy(key, "_run"))
    runs = marked.where("_c").withColumn("_first", first).groupBy(key, "_run", "_first")
    runs = runs.agg(F.min(F.when(F.col(at) - F.col("_first") >= persist, F.col(at))).alias("detected"), F.max(F.struct(at, "_next", "residual")).alias("_last"))
    return runs.where("detected is not null").select(key, F.col("_first").alias("since"), "detected", F.col("_last._next").alias("cleared"), F.col("_last.residual").alias("typical_w"))


def snapshot(states: DataFrame, key: str = "rid", device: str = "device", at: str = "at", ticks: int = 420) -> tuple[DataFrame, DataFrame]:
    """(devices, history) of (key, device, at, state, watts): what is on at each meter's last tick and since when; the last ``ticks`` ticks.

    A device is on since the tick after its last one off.
    """
    now = F.max(at).over(Window.partitionBy(key))
    mine = Window.partitionBy(key, device)
    off = F.coalesce(F.max(F.when(F.col("state") == 0, F.col(at))).over(mine), F.lit(-(2**62)))
    rows = states.withColumns({"_now": now, "_off": off})
    since = F.min(F.when(F.col(at) > F.col("_off"), F.col(at)))
    devices = rows.groupBy(key, device).agg(F.max(F.struct(at, "state", "watts")).alias("_x"), since.alias("since"), F.max("_now").alias("_now"))
    devices = devices.where((F.col(f"_x.{at}") == F.col("_now")) & (F.col("_x.state") == 1)).select(key, device, "since", "_x.watts")
    recent = states.select(key, at).distinct().withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at)))).where(F.col("_r") <= ticks)
    return devices, states.join(recent.select(key, at), [key, at], "left_semi")


def latest(df: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """The last row of every device."""
    return df.groupBy(*keys).agg(F.max(F.struct(order, *values)).alias("_x")).select(*keys, "_x.*")
