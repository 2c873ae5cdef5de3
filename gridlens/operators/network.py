"""Presence and power of all families from raw sequences by one network, trained by summed gradients of partitions.

One hidden layer, two outputs for each family: the logit of its presence and its power in units of the family's spread.
In each step every task adds up the gradient over its rows, a first level of groups adds up tasks, and the driver adds
a fixed number of such sums and moves the weights (Adam). What the driver holds is the size of the network, whatever
the data. Training stops when the loss over held-out groups has not fallen for a while, and the best weights stay.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlens.sources.store import shared_folder

#: Sums that reach the driver in a step.
SUMS = 8


@dataclass
class Network:
    """Weights of a fitted network, and how its inputs and powers are scaled."""

    families: list[str]
    mean: np.ndarray
    spread: np.ndarray
    units: np.ndarray
    weights: list[np.ndarray]
    losses: list[tuple[float, float]]  # of training and of held-out groups, for each step

    def predict(self, df: DataFrame, sequence: str = "sequence") -> DataFrame:
        """``presence_<family>`` and ``power_<family>`` (watts, none where presence is below one half) beside the rows; null where the sequence is."""
        mean, spread, units, weights, n = self.mean, self.spread, self.units, self.weights, len(self.families)

        @F.pandas_udf("array<double>")
        def run(x: pd.Series) -> pd.Series:
            known = x.notna()
            out = np.full((len(x), 2 * n), np.nan)
            if known.any():
                _, y = forward(weights, (np.stack(x[known].to_list()) - mean) / spread)
                p = 1 / (1 + np.exp(-y[:, :n]))
                out[known.to_numpy()] = np.concatenate([p, np.where(p >= 0.5, np.maximum(y[:, n:] * units, 0.0), 0.0)], axis=1)
            return pd.Series([None if np.isnan(r).any() else r.tolist() for r in out])

        scored = df.withColumn("_y", run(sequence))
        columns = {f"{kind}_{f}": F.get("_y", F.lit(k + j * n)) for j, kind in enumerate(("presence", "power")) for k, f in enumerate(self.families)}
        return scored.withColumns(columns).drop("_y")


def forward(weights: list[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w1, b1, w2, b2 = weights
    h = np.maximum(x @ w1 + b1, 0.0)
    return h, h @ w2 + b2


def gradient(weights: list[np.ndarray], x: np.ndarray, on: np.ndarray, power: np.ndarray) -> tuple[np.ndarray, float]:
    """(flat gradient, loss), both summed over rows: cross entropy of presence, and half the squared error of power."""
    _, _, w2, _ = weights
    n = on.shape[1]
    h, y = forward(weights, x)
    z, p = y[:, :n], y[:, n:]
    loss = float(np.sum(np.logaddexp(0.0, z) - on * z) + 0.5 * np.sum((p - power) ** 2))
    d = np.concatenate([1 / (1 + np.exp(-z)) - on, p - power], axis=1)
    dh = (d @ w2.T) * (h > 0)
    return np.concatenate([g.ravel() for g in (x.T @ dh, dh.sum(axis=0), h.T @ d, d.sum(axis=0))]), loss


def _unflat(flat: np.ndarray, like: list[np.ndarray]) -> list[np.ndarray]:
    ends = np.cumsum([w.size for w in like])
    return [part.reshape(w.shape) for part, w in zip(np.split(flat, ends[:-1]), like, strict=True)]


def _stack(batch: pa.RecordBatch, column: str) -> np.ndarray:
    lists = batch.column(column)
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def _summed(rows: DataFrame, each) -> np.ndarray:  # noqa: ANN001
    """Sum over all batches of the vectors that ``each`` gives, by way of ``SUMS`` partial sums."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if len(batch):
                v = each(batch)
                total = v if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % SUMS], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "data"])

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer(), np.float64) for x in t.column("data"))
        return pa.table({"part": t.column("part").slice(0, 1), "data": pa.array([total.tobytes()], pa.binary())})

    kind = "part int, data binary"
    found = rows.mapInArrow(tasks, kind).groupBy("part").applyInArrow(add, kind).collect()
    return np.sum([np.frombuffer(bytes(r["data"]), np.float64) for r in sorted(found, key=lambda r: r["part"])], axis=0) if found else np.zeros(0)


def fit(df: DataFrame, families: Sequence[str], group: str, sequence: str = "sequence", hidden: int = 48, steps: int = 120, rate: float = 0.02, patience: int = 15, held_out: float = 0.2, seed: int = 5) -> Network:
    """Train on rows of (group, sequence, ``<family>`` 0/1, ``power of <family>``); all sequences are equally long.

    A hash deals about ``held_out`` of the groups to early stopping. Rows with a null sequence or target are left out.
    """
    folder = shared_folder(df.sparkSession, "network")
    held = F.pmod(F.xxhash64(F.col(group), F.lit(seed)), F.lit(1000)) < 1000 * held_out
    on, power = (F.array(*[F.col(f"`{c.format(f)}`").cast("double") for f in families]) for c in ("{}", "power of {}"))
    rows = df.select(held.alias("held"), F.col(sequence).cast("array<double>").alias("x"), on.alias("on"), power.alias("power"))
    rows = rows.where(F.col("x").isNotNull() & ~F.exists("x", F.isnull) & ~F.exists("on", F.isnull) & ~F.exists("power", F.isnull))
    rows.write.parquet(folder)  # read once in each step
    rows = df.sparkSession.read.parquet(folder)

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        keep = ~batch.column("held").to_numpy(zero_copy_only=False).astype(bool)
        x, p = _stack(batch, "x")[keep], _stack(batch, "power")[keep]
        return np.concatenate([[keep.sum(), (~keep).sum()], x.sum(axis=0), (x * x).sum(axis=0), (p * p).sum(axis=0)])

    m = _summed(rows, moments)
    if not len(m) or not m[0]:
        raise ValueError("no rows to learn from")
    n, k, width = m[0], len(families), (len(m) - 2 - len(families)) // 2
    mean = m[2 : 2 + width] / n
    spread = np.sqrt(np.maximum(m[2 + width : 2 + 2 * width] / n - mean**2, 1e-12))
    units = np.sqrt(np.maximum(m[2 + 2 * width :] / n, 1e-12))
    rng = np.random.default_rng(seed)
    weights = [rng.normal(0, np.sqrt(2 / width), (width, hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), (hidden, 2 * k)), np.zeros(2 * k)]
    first, second, best, losses = 0.0, 0.0, (np.inf, weights), []
    for step in range(1, steps + 1):

        def each(batch: pa.RecordBatch, weights: list[np.ndarray] = weights) -> np.ndarray:
            x, on, power = (_stack(batch, c) for c in ("x", "on", "power"))
            x, power = (x - mean) / spread, power / units
            late = batch.column("held").to_numpy(zero_copy_only=False).astype(bool)
            g, loss = gradient(weights, x[~late], on[~late], power[~late])
            return np.concatenate([g, [loss, gradient(weights, x[late], on[late], power[late])[1]]])

        total = _summed(rows, each)
        losses.append((total[-2] / n, total[-1] / max(m[1], 1)))
        watched = losses[-1][1] if m[1] else losses[-1][0]
        if watched < best[0]:
            best, since = (watched, weights), 0
        else:
            since += 1
            if since >= patience:
                break
        g = total[:-2] / n
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        move = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        weights = [w - d for w, d in zip(weights, _unflat(move, weights), strict=True)]
    return Network(list(families), mean, spread, units, best[1], losses)
