"""One meter followed in order of time: edges, claims guarded at ticks, model predictions, device states, unknown loads.

The rules are a small state machine over two kinds of rows, samples and predictions. A batch runs it over a sorted
table, the stream over rows that the watermark has passed, so both give the same. All times are seconds; the sample
rate enters nowhere but through them.
"""

from __future__ import annotations

import json
import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridlens.operators.events import EDGE_W, SETTLED_SHARE, SETTLED_W, Claims

#: What a step emits: a state of a device at a tick, or an event.
SCHEMA = "rid long, t double, kind string, device string, on int, watts double, prob double, total double, residual double, explained double, source string, since double, dq double"
_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
Emitted = tuple


@dataclass(frozen=True)
class Rules:
    """Seconds, watts and shares of the live loop; ``signatures`` are (family, P, Q)."""

    signatures: tuple[tuple[str, float, float], ...] = ()
    side: float = 2.5
    span: float = 8.0
    gap: float = 3.0
    stride: float = 2.0
    window: float = 10.0
    high: float = 0.55
    low: float = 0.45
    persist: float = 8.0
    least_w: float = 30.0
    share: float = 0.15
    events: int = 12


@dataclass
class Meter:
    """State of one meter; plain values only, so that it is kept as JSON."""

    t: list = field(default_factory=list)  # samples of the last window or span
    p: list = field(default_factory=list)
    q: list = field(default_factory=list)
    last_edge: float = -1e300
    next_tick: float = -1e300
    claims: dict = field(default_factory=dict)
    held: dict = field(default_factory=dict)
    smooth: dict = field(default_factory=dict)  # the last three probabilities of each device
    model: dict = field(default_factory=dict)  # latest watts of each device
    devices: dict = field(default_factory=dict)  # name: [on, watts, since]
    recent: list = field(default_factory=list)  # (kind, device, t) of the last events, of every kind
    unknown: list = field(default_factory=list)  # [since] while the residual is high, [since, True] once reported


def total_of(x: list) -> float:
    """Sum as NumPy adds a short array up, to the last digit: eight sums side by side from eight values on."""
    n = len(x)
    if n > 128:
        return float(np.sum(np.array(x)))
    if n < 8:  # one after the other; Python's own sum compensates
        out = 0.0
        for v in x:
            out += v
        return out
    a, b, c, d, e, f, g, h = x[:8]
    whole = n - n % 8
    for k in range(8, whole, 8):
        a, b, c, d = a + x[k], b + x[k + 1], c + x[k + 2], d + x[k + 3]
        e, f, g, h = e + x[k + 4], f + x[k + 5], g + x[k + 6], h + x[k + 7]
    out = ((a + b) + (c + d)) + ((e + f) + (g + h))
    for k in range(whole, n):
        out += x[k]
    return out


def middle(x: list) -> float:
    s, n = sorted(x), len(x)
    return s[n // 2] if n % 2 else (s[n // 2 - 1] + s[n // 2]) / 2


def spread(x: list) -> float:
    mean = total_of(x) / len(x)
    return math.sqrt(total_of([(v - mean) * (v - mean) for v in x]) / len(x))


def settled_step(t: list, p: list, q: list, side: float) -> tuple[float, float, float] | None:
    """(time of the jump, dP, dQ) of one span: medians of its first and last ``side`` seconds, both settled."""
    first = bisect_left(t, t[0] + side)
    last = bisect_right(t, t[-1] - side)
    p0, p1 = middle(p[:first]), middle(p[last:])
    dp, dq = p1 - p0, middle(q[last:]) - middle(q[:first])
    if abs(dp) < EDGE_W and abs(dq) < 2 * EDGE_W:
        return None
    if spread(p[:first]) > max(SETTLED_W, SETTLED_SHARE * abs(p0)) or spread(p[last:]) > max(SETTLED_W, SETTLED_SHARE * abs(p1)):
        return None
    # The jump leads to a sample after the first side and not after the first one of the last.
    between = [abs(p[k] - p[k - 1]) for k in range(first, min(max(first, last) + 1, len(p)))]
    return t[first + between.index(max(between))], dp, dq


class Follower:
    """Applies rows to a meter and says what follows from them."""

    def __init__(self, rid: int, rules: Rules, state: Meter):
        self.rid, self.rules, self.m = rid, rules, state
        self.claims = Claims(hold=rules.window + 5)
        self.claims.on = {f: tuple(v) for f, v in state.claims.items()}
        self.claims.held = dict(state.held)

    def state(self) -> Meter:
        self.m.claims = {f: list(v) for f, v in self.claims.on.items()}
        self.m.held = dict(self.claims.held)
        return self.m

    def _event(self, kind: str, device: str | None, t: float, watts: float | None = None, prob: float | None = None, total: float | None = None, dq: float | None = None) -> Emitted:
        self.m.recent = [*self.m.recent, [kind, device, t]][-self.rules.events :]
        return (self.rid, t, kind, device, None, watts, prob, total, None, None, None, None, dq)

    def _match(self, dp: float, dq: float) -> tuple[str | None, float | None]:
        sign = -1.0 if dp < 0 else 1.0
        found = [(float(np.hypot(sign * dp - p, sign * dq - q) / max(20.0, 0.35 * np.hypot(p, q))), f) for f, p, q in self.rules.signatures]
        d, family = min(found, default=(2.0, None))
        confidence = round(1 - d, 2)
        return (family, confidence) if abs(dp) >= EDGE_W and d < 1 and confidence >= 0.25 else (None, None)

    def prediction(self, device: str, prob: float, watts: float) -> None:
        self.m.smooth[device] = [*self.m.smooth.get(device, []), prob][-3:]
        self.m.model[device] = watts

    def sample(self, t: float, p: float, q: float) -> Iterator[Emitted]:
        m, r = self.m, self.rules
        keep = max(r.window, r.span)
        first = next((k for k, x in enumerate(m.t) if x > t - keep), len(m.t))
        m.t, m.p, m.q = [*m.t[first:], t], [*m.p[first:], p], [*m.q[first:], q]
        if m.next_tick == -1e300:
            m.next_tick = t
        if t < m.next_tick:
            return
        m.next_tick += r.stride * (1 + (t - m.next_tick) // r.stride)
        near = bisect_right(m.t, t - r.span)
        if m.t[0] <= t - r.span + r.side and len(m.t) - near >= 4:
            step = settled_step(m.t[near:], m.p[near:], m.q[near:], r.side)
            if step is not None and step[0] - m.last_edge >= r.gap:
                at, dp, dq = step
                m.last_edge = at
                family, confidence = self._match(dp, dq)
                yield self._event("edge_on" if dp > 0 else "edge_off", family, at, dp, confidence, None, dq)
                self.claims.edge(at, dp, family, confidence)
        instant = middle(m.p[bisect_right(m.t, t - r.side) :])
        last = m.p[bisect_right(m.t, t - r.window) :]
        yield from self._tick(t, total_of(last) / len(last), instant)

    def _tick(self, t: float, total: float, instant: float) -> Iterator[Emitted]:
        m, r = self.m, self.rules
        watts_of = {f: w for f, (w, _, _) in self.claims.on.items()}
        for device in self.claims.guard(t, instant):
            yield self._event("claim_dropped", device, t, -watts_of[device], None, instant)
        claims, held = self.claims.on, self.claims.held
        prob = {d: middle(x) for d, x in m.smooth.items()}
        on = {d: x >= (r.low if m.devices.get(d, [0])[0] else r.high) for d, x in prob.items()}
        watts = {d: m.model[d] if on[d] else 0.0 for d in prob}
        source = dict.fromkeys(prob, "model")
        for d, (w, confidence, _) in claims.items():
            on[d], watts[d], prob[d], source[d] = True, w, max(prob.get(d, 0.0), confidence), "edge"
        for d in held:
            if on.get(d):
                on[d], watts[d], source[d] = False, 0.0, "edge"
        for d, (was_on, _, _) in m.devices.items():  # a device that only a claim knew goes off with it
            if was_on and d not in on:
                on[d], watts[d], prob[d], source[d] = False, 0.0, 0.0, "edge"
        rest = max(0.0, total - sum(watts[d] for d in claims if on[d]))
        modelled = [d for d in on if on[d] and d not in claims]
        want = sum(watts[d] for d in modelled)
        if want > 1.0 and want > rest:
            for d in modelled:
                watts[d] *= rest / want
        residual = total - sum(watts[d] for d in on if on[d])
        explained = 1.0 if abs(total) <= 1 else 1.0 - min(1.0, abs(residual) / abs(total))
        for d in sorted(on):
            before = m.devices.get(d, [0, 0.0, None])
            since = before[2]
            if on[d] and not before[0]:
                edges = [x[2] for x in m.recent if x[0] == "edge_on" and x[1] == d and t - x[2] < r.window + 6]
                since = claims[d][2] if d in claims else edges[-1] if edges else t - r.window / 2
                yield self._event("device_on", d, since, watts[d], prob[d], total)
            elif before[0] and not on[d]:
                since = None
                yield self._event("device_off", d, t - r.window / 2, None, prob[d], total)
            m.devices[d] = [int(on[d]), watts[d], since]
            yield (self.rid, t, "state", d, int(on[d]), watts[d], prob[d], total, residual, explained, source.get(d, "model"), since, None)
        settling = bool(held) or any(t - since < r.window + 4 for _, _, since in claims.values())
        if abs(residual) > max(r.least_w, r.share * abs(total)) and not settling:
            if not m.unknown:
                m.unknown = [t]
            elif len(m.unknown) == 1 and t - m.unknown[0] >= r.persist:
                m.unknown = [m.unknown[0], True]
                yield self._event("unknown_detected", None, m.unknown[0], residual, None, total)
        else:
            if len(m.unknown) == 2:
                yield self._event("unknown_cleared", None, t, residual, None, total)
            m.unknown = []

    def rows(self, rows: Iterable[tuple]) -> Iterator[Emitted]:
        """Rows (t, side, device, a, b) in order: side 0 predictions (probability, watts), side 1 samples (P, Q)."""
        for t, side, device, a, b in rows:
            if side == 0:
                self.prediction(device, a, b)
            else:
                yield from self.sample(t, a, b)


def rebuilt(events: DataFrame, rules: Rules, last: int = 600) -> DataFrame:
    """(rid, meter): states to start a stream with, the last edges of each meter matched against other signatures and replayed."""
    w = Window.partitionBy("rid").orderBy(F.desc("t"))
    edges = events.where("kind in ('edge_on', 'edge_off')").select("rid", "t", "watts", "dq", F.row_number().over(w).alias("_n")).where(F.col("_n") <= last)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        f = Follower(key[0], rules, Meter())
        for r in pdf.sort_values("t", kind="stable").itertuples():
            family, confidence = f._match(r.watts, r.dq)
            f.claims.edge(r.t, r.watts, family, confidence)
            f.m.last_edge = r.t
            f._event("edge_on" if r.watts > 0 else "edge_off", family, r.t)
        return pd.DataFrame([(key[0], json.dumps(asdict(f.state())))], columns=["rid", "meter"])

    return edges.groupBy("rid").applyInPandas(run, "rid long, meter string")


#: Rows of both kinds: predictions of a window that ends at t come before the sample of that time.
INPUT = "rid long, t double, side int, device string, a double, b double"


def inputs(samples: DataFrame, predictions: DataFrame | None = None) -> DataFrame:
    """Samples (rid, t, p, q) and predictions (rid, t, device, prob, watts) as one table or stream."""
    rows = samples.select("rid", F.col("t").cast("double").alias("t"), F.lit(1).alias("side"), F.lit(None).cast("string").alias("device"), F.col("p").cast("double").alias("a"), F.col("q").cast("double").alias("b"))
    if predictions is None:
        return rows
    return rows.unionByName(predictions.select("rid", F.col("t").cast("double").alias("t"), F.lit(0).alias("side"), "device", F.col("prob").cast("double").alias("a"), F.col("watts").cast("double").alias("b")))


def sound(rows: Iterable[tuple]) -> list[tuple]:
    """Rows (t, side, device, a, b) that can be applied, in order; samples of one time count once."""
    known = [r for r in rows if not any(v is None or v != v for v in (r[0], r[3], r[4]))]
    known.sort(key=lambda r: (r[0], r[1], r[2] is None, r[2] or "", r[3], r[4]))
    return [r for before, r in zip([None, *known], known) if r[1] == 0 or before is None or before[:2] != r[:2]]


def frame(rows: Iterable[Emitted]) -> pd.DataFrame:
    return pd.DataFrame(list(rows), columns=_COLUMNS)


def follow(rows: DataFrame, rules: Rules) -> DataFrame:
    """The whole loop over a stored table of ``inputs``: states at ticks and events of every meter.

    A meter is one group, as each of its states follows from the one before. Rows with a null time or value are left
    out, of samples of one time the one with the least power counts; an empty table gives an empty result.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        columns = (pdf[c].tolist() for c in ("t", "side", "device", "a", "b"))
        return frame(Follower(key[0], rules, Meter()).rows(sound(zip(*columns, strict=True))))

    return rows.select(*[c.split()[0] for c in INPUT.split(", ")]).groupBy("rid").applyInPandas(run, SCHEMA)
