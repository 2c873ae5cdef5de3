"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2)): all pairwise
interactions in time linear in the features. Every word of a text counts; nothing is truncated.
The machine is fitted on at most ``max_labelled`` labelled rows (the ones with the smallest hash
of their id), whose packed features have at most 2 * ``BUCKETS`` bytes a row; scoring reads the
fitted weights (a fixed half megabyte) in every task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlens.llm import kernels as K
from gridlens.llm.kneser_ney import fold

BUCKETS, FACTORS = 1 << 14, 8
STATISTICS = ("log_words", "word_bytes", "distinct", "upper", "digit", "symbol", "punct", "bar", "bang", "lines", "line_words", "other", "short")

_CLASSES = np.zeros((7, 256), dtype=np.int64)
_CLASSES[0, 65:91] = 1
_CLASSES[1, 48:58] = 1
_CLASSES[2, [ord(c) for c in "#*$%&<>"]] = 1
_CLASSES[3, [ord(c) for c in ".,;:?"]] = 1
_CLASSES[4, ord("|")] = 1
_CLASSES[5, ord("!")] = 1
_CLASSES[6, ord("\n")] = 1


def features(texts: pa.Array, metadata: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Per text the sorted distinct buckets of its words, and a row of statistics followed by the metadata."""
    raw, offsets = K.raw_bytes(texts)
    w = K.words(texts)
    n, size = w.counts.astype(np.float64), np.maximum(np.diff(offsets), 1).astype(np.float64)
    bucket = (w.hashes >> np.uint64(50)).astype(np.uint16)
    sets = [np.unique(bucket[a:b]) for a, b in zip(w.bounds[:-1], w.bounds[1:], strict=True)]
    lengths = (w.ends - w.starts).astype(np.float64)
    per = []
    for row in _CLASSES:
        run = np.concatenate([[0], np.cumsum(row[raw])])
        per.append(run[offsets[1:]] - run[offsets[:-1]])
    upper, digit, symbol, punct, bar, bang, lines = (x.astype(np.float64) for x in per)
    some = np.maximum(n, 1)
    stats = np.stack(
        [
            np.log1p(n),
            K.text_sum(lengths, w.bounds) / some,
            np.array([len(s) for s in sets]) / some,
            upper / size,
            digit / size,
            symbol / size,
            punct / size,
            bar / some,
            bang / some,
            np.log1p(lines),
            np.log1p(n / (lines + 1)),
            (size - n) / size,
            K.text_sum((lengths <= 3).astype(np.float64), w.bounds) / some,
        ],
        axis=1,
    )
    return sets, np.concatenate([stats, np.log1p(np.maximum(np.nan_to_num(metadata), 0))], axis=1)


@dataclass
class Machine:
    """Weights: one row of ``w`` and ``v`` for each bucket, then for each statistic."""

    w0: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def scores(self, sets: list[np.ndarray], stats: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._margin(*_packed(sets), self._scaled(stats))[0], -30, 30)))

    def _scaled(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.mean) / self.scale, -4, 4)

    def _margin(self, flat: np.ndarray, bounds: np.ndarray, x: np.ndarray, dense: np.ndarray):
        wide, v = self.w[BUCKETS:], self.v[BUCKETS:]
        s, squares = dense @ v, (dense * dense) @ (v * v).sum(axis=1)
        for f in range(FACTORS):  # a factor at a time: sums over contiguous columns are far quicker
            column = np.ascontiguousarray(self.v[:BUCKETS, f])[flat] * x
            s[:, f] += K.text_sum(column, bounds)
            squares += K.text_sum(column * column, bounds)
        linear = K.text_sum(self.w[flat] * x, bounds) + dense @ wide
        return self.w0 + linear + ((s * s).sum(axis=1) - squares) / 2, s


def _packed(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    flat = np.concatenate(sets).astype(np.int64) if len(sets) else np.zeros(0, np.int64)
    return flat, bounds, np.repeat(1 / np.sqrt(np.maximum(sizes, 1)), sizes)


def fit(sets: list[np.ndarray], stats: np.ndarray, labels: np.ndarray, *, rounds: int = 12, batch: int = 256, rate: float = 0.1, shrink: float = 1e-4, seed: int = 1) -> Machine:
    """Logistic loss by adaptive gradient steps over shuffled batches; without rows of both labels a constant."""
    n, wide = len(labels), stats.shape[1]
    share = (labels.sum() + 1) / (n + 2)
    rng = np.random.Generator(np.random.PCG64(seed))
    m = Machine(float(np.log(share / (1 - share))), np.zeros(BUCKETS + wide), rng.normal(0, 0.01, (BUCKETS + wide, FACTORS)), stats.mean(axis=0) if n else np.zeros(wide), np.maximum(stats.std(axis=0), 1e-6) if n else np.ones(wide))
    if n == 0 or labels.min() == labels.max():
        m.v[:] = 0
        return m
    gw, gv, g0 = np.full_like(m.w, 1e-3), np.full_like(m.v, 1e-3), 1e-3
    dense = m._scaled(stats)
    for _ in range(rounds):
        order = rng.permutation(n)
        for at in range(0, n, batch):
            rows = order[at : at + batch]
            flat, bounds, x = _packed([sets[i] for i in rows])
            margin, s = m._margin(flat, bounds, x, dense[rows])
            d = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[rows]) / len(rows)
            of = np.repeat(np.arange(len(rows)), np.diff(bounds))
            dx = d[of] * x
            dw = np.concatenate([np.bincount(flat, dx, BUCKETS), d @ dense[rows]]) + shrink * m.w
            dv = np.empty_like(m.v)
            square = np.bincount(flat, dx * x, BUCKETS)
            for f in range(FACTORS):
                dv[:BUCKETS, f] = np.bincount(flat, dx * s[of, f], BUCKETS) - square * m.v[:BUCKETS, f]
            dv[BUCKETS:] = (d[:, None] * dense[rows]).T @ s - ((d @ dense[rows] ** 2)[:, None]) * m.v[BUCKETS:]
            dv += shrink * m.v
            g0 += d.sum() ** 2
            gw += dw * dw
            gv += dv * dv
            m.w0 -= rate * d.sum() / np.sqrt(g0)
            m.w -= rate * dw / np.sqrt(gw)
            m.v -= rate / 2 * dv / np.sqrt(gv)
    return m


def _selected(docs: DataFrame, id_col: str, text_col: str, metadata: Sequence[str]) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.array(*[F.col(c).cast("double") for c in metadata]).cast("array<double>").alias("meta"))


def _meta(batch: pa.RecordBatch, width: int) -> np.ndarray:
    flat = batch.column("meta").flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(batch.num_rows, width)


def learn(docs: DataFrame, labels: DataFrame, *, metadata: Sequence[str] = (), id_col: str = "doc_id", label_col: str = "quality", max_labelled: int = 6000) -> Machine:
    """Fit on at most ``max_labelled`` rows of ``labels`` that have a document; rows without a label are not used."""
    width = len(metadata)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch):
                sets, stats = features(part.column("text"), _meta(part, width))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("y"), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([x.tobytes() for x in stats], pa.binary())], names=["id", "y", "buckets", "stats"])

    chosen = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).cast("long").alias("id"))
        .agg(F.max(F.col(label_col).cast("int")).alias("y"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(max_labelled)
    )
    labelled = _selected(docs, id_col, "text", metadata).join(F.broadcast(chosen), "id").mapInArrow(run, "id long, y int, buckets binary, stats binary")
    rows = labelled.orderBy(F.xxhash64("id"), "id", "buckets", "stats").limit(max_labelled).collect()  # ids may repeat among the documents
    sets = [np.frombuffer(r["buckets"], np.uint16) for r in rows]
    stats = np.array([np.frombuffer(r["stats"]) for r in rows]).reshape(len(sets), len(STATISTICS) + width)
    return fit(sets, stats, np.array([float(r["y"] > 0) for r in rows]))


def score(docs: DataFrame, machine: Machine, *, metadata: Sequence[str] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score)`` of every row; null and empty texts are scored by their (zero) statistics."""
    width = len(metadata)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch):
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(machine.scores(*features(part.column("text"), _meta(part, width))))], names=["id", "score"])

    return _selected(docs, id_col, text_col, metadata).mapInArrow(run, "id long, score double")


def keep_good(docs: DataFrame, machine: Machine, *, metadata: Sequence[str] = (), text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows, unchanged, that score ``threshold`` or more; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch, text_col):
                columns = [pc.fill_null(part.column(c).cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False) for c in metadata]
                scores = machine.scores(*features(part.column(text_col), np.array(columns, dtype=np.float64).reshape(len(metadata), part.num_rows).T))
                yield part.filter(pa.array(scores >= threshold))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, *, metadata: Sequence[str] = (), folds: int = 5, held: int = 0, threshold: float = 0.3, max_labelled: int = 6000) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs``.

    Learns from labels outside fold ``held`` of the id only. ``metadata`` names numeric columns
    (null counts as 0); language, source and id are never features. No labels, or labels of one
    kind, give every row the same score, the smoothed share of label 1. Repeated rows are scored
    each; a null id is in no fold.
    """
    machine = learn(docs, labels.where(fold("doc_id", folds) != held), metadata=metadata, max_labelled=max_labelled)
    return score(docs, machine, metadata=metadata).select(F.col("id").alias("doc_id"), (fold("id", folds) == held).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
