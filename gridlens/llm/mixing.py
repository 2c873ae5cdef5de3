"""Mixing to target weights: rake token weights to source, language and topic marginals, then sample.

Topics are classes of documents by their words: each text's words of six bytes or more are summed
into a signed sketch, weighted by how rare they are, and the sketches of all documents are put
into classes by k-means on the sphere. Token counts are added up for each cell (source, language,
topic). Iterative proportional fitting scales the cells until every marginal has its target share;
a document of a cell is then drawn with the cell's fitted tokens over its present ones. Cells that
would need more than they have are taken whole, and the others are raised until the drawn tokens
reach the wanted share.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from gridlens.llm import kernels as K
from gridlens.llm.shared import Scratch

#: Topics, and the places of a text's sketch.
TOPICS, PLACES = 8, 128
AXES = ("source", "lang", "topic")
#: Cells (present or not) that are fitted on the driver at most; more are fitted as tables, by the same arithmetic.
DRIVER_CELLS = 1 << 18


@dataclass
class Topics:
    """Weights of the sketch's places, and the unit vector of each topic."""

    weights: np.ndarray
    centres: np.ndarray

    def of(self, sums: np.ndarray) -> np.ndarray:
        """Topic of each sketch: the nearest by cosine, the first on a tie, 0 without words."""
        return (sums * self.weights @ self.centres.T).round(9).argmax(axis=1).astype(np.int32)


def _sketches(w: K.Words) -> np.ndarray:
    """For each text, the signed counts of its words of six bytes or more by hash place."""
    long = (w.ends - w.starts) >= 6
    h = w.hashes[long]
    place = w.text_of[long] * PLACES + (h >> np.uint64(40)).astype(np.int64) % PLACES
    sign = 1.0 - 2.0 * ((h >> np.uint64(39)) & np.uint64(1)).astype(np.float64)
    texts = len(w.bounds) - 1
    return np.bincount(place, sign, texts * PLACES).reshape(texts, PLACES)


def fresh(names: Sequence[str], taken: Sequence[str]) -> list[str]:
    """The names, each with as many underscores after it as make it a new one."""
    used, out = {x.lower() for x in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def learn_topics(docs: DataFrame, scratch: Scratch, text_col: str = "text", topics: int = TOPICS, rounds: int = 8) -> Topics:
    """K-means over the sketches of all rows, by sums of whole numbers, so that reruns agree.

    The sketches are written once (a byte a place); each round reads them and adds up one row for
    each topic and task.
    """

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch):
                sums = _sketches(K.words(part.column("text")))
                size = np.maximum(np.abs(sums).max(axis=1, keepdims=True), 1)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in np.round(sums * (127 / np.maximum(size, 127))).astype(np.int8)], pa.binary())], names=["v"])

    held = scratch.write(docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(sketch, "v binary"), "sketches")

    def rows(batch: pa.RecordBatch) -> np.ndarray:
        return np.frombuffer(b"".join(batch.column("v").to_pylist()), np.int8).reshape(batch.num_rows, PLACES).astype(np.float64)

    def added(step) -> list:
        """The sums of ``step``'s (key, whole numbers) over all rows: as many keys as topics at most."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                if batch.num_rows:
                    for key, v in step(rows(batch)):
                        total[key] = total.get(key, 0) + v
            for key, v in total.items():
                yield pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([v.tolist()], pa.list_(pa.int64()))], names=["key", "v"])

        parts = held.mapInArrow(run, "key int, v array<long>").select("key", F.posexplode("v").alias("k", "x")).groupBy("key", "k").agg(F.sum("x").alias("x"))
        out: dict[int, np.ndarray] = {}
        for r in parts.collect():  # topics * PLACES rows
            out.setdefault(r["key"], np.zeros(PLACES))[r["k"]] = r["x"]
        return sorted(out.items())

    found = dict(added(lambda x: [(0, (x != 0).sum(axis=0)), (1, np.full(PLACES, len(x)))]))
    if not found:
        return Topics(np.zeros(PLACES), np.zeros((topics, PLACES)))
    weights = np.log((found[1] + 1) / (found[0] + 1)) + 0.1
    model = None
    for _ in range(rounds + 1):

        def step(x: np.ndarray, model: Topics | None = model) -> list[tuple[int, np.ndarray]]:
            v = x * weights
            norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
            kind = np.abs(v).argmax(axis=1) % topics if model is None else model.of(x)
            whole = np.round(v / np.maximum(norm, 1e-12) * (1 << 20)).astype(np.int64)
            return [(int(k), whole[(kind == k) & (norm[:, 0] > 0)].sum(axis=0)) for k in np.unique(kind)]

        centres = np.zeros((topics, PLACES))
        for k, v in added(step):
            centres[k] = v / max(float(np.sqrt((v * v).sum())), 1e-12)
        if model is not None and np.abs(centres - model.centres).max() < 1e-6:
            break
        model = Topics(weights, centres)
    scratch.drop("sketches")
    return model


def with_topic(docs: DataFrame, model: Topics, tokens: str, topic: str, text_col: str = "text") -> DataFrame:
    """All columns, then the tokens (words and the end) and the topic."""
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch, text_col):
                w = K.words(part.column(text_col))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(w.counts + 1), pa.array(model.of(_sketches(w)))], names=[*part.schema.names, tokens, topic])

    return docs.mapInArrow(run, StructType([*schema.fields, StructField(tokens, LongType()), StructField(topic, IntegerType())]))


def rake(tokens: np.ndarray, targets: list[np.ndarray], rounds: int = 500, close: float = 1e-9) -> np.ndarray:
    """Iterative proportional fitting of a non-negative table to one marginal of shares for each axis.

    Shares of levels without tokens go to the others in proportion.
    """
    w = tokens / max(tokens.sum(), 1)
    goals = []
    for axis, t in enumerate(targets):
        have = w.sum(axis=tuple(k for k in range(w.ndim) if k != axis)) > 0
        t = np.where(have, t, 0)
        goals.append(t / t.sum() if t.sum() else t)
    for _ in range(rounds):
        worst = 0.0
        for axis, goal in enumerate(goals):
            now = w.sum(axis=tuple(k for k in range(w.ndim) if k != axis))
            scale = np.divide(goal, now, out=np.zeros_like(goal), where=now > 0)
            worst = max(worst, float(np.abs(now - goal).max(initial=0)))
            w = w * scale.reshape([-1 if k == axis else 1 for k in range(w.ndim)])
        if worst < close:
            break
    return w


def probabilities(tokens: np.ndarray, weights: np.ndarray, share: float) -> np.ndarray:
    """Chances for each cell: in proportion to weights over tokens, at most 1, drawing ``share`` of all tokens."""
    want = share * tokens.sum()
    ratio = np.divide(weights, tokens, out=np.zeros_like(weights), where=tokens > 0)
    low, high = 0.0, 1.0
    positive = ratio[ratio > 0]
    if not positive.size or want <= 0:
        return np.zeros_like(weights)
    high = 1 / positive.min()
    for _ in range(200):
        mid = (low + high) / 2
        if (np.minimum(1, mid * ratio) * tokens).sum() < want:
            low = mid
        else:
            high = mid
    chance = high * ratio
    return np.where(chance > 1 - 1e-9, 1.0, chance)  # rounding must not leave a whole cell at a hair below 1


def tempered(tokens: np.ndarray, power: float) -> np.ndarray:
    """Shares in proportion to a power of the tokens: below 1 small levels gain."""
    t = np.where(tokens > 0, np.maximum(tokens, 1e-12) ** power, 0)
    return t / t.sum() if t.sum() else t


def rake_tables(cells: DataFrame, targets: Mapping[str, Mapping[str, float]], powers: Mapping[str, float], share: float, scratch: Scratch, rounds: int = 500, close: float = 1e-9) -> DataFrame:
    """(source, lang, topic, mix_chance): ``rake`` and ``probabilities`` for any number of cells, as grouped sums and joins."""
    spark = cells.sparkSession
    total = cells.agg(F.sum("n")).first()[0]
    cells = cells.withColumn("w", F.col("n") / F.lit(float(total)))
    for axis in AXES:
        now = cells.groupBy(axis).agg(F.sum("n").alias("has"))
        if targets.get(axis):
            given = spark.createDataFrame([(str(k), float(v)) for k, v in targets[axis].items()], "level string, goal double")
            goal = now.join(given, F.col(axis).cast("string") == F.col("level"), "left").select(axis, F.coalesce("goal", F.lit(0.0)).alias("goal"))
        else:
            goal = now.select(axis, F.pow(F.col("has").cast("double"), F.lit(float(powers[axis]))).alias("goal"))
        goal = scratch.write(goal, f"goal_{axis}")
        whole = goal.agg(F.sum("goal")).first()[0]
        cells = cells.join(goal.select(axis, (F.col("goal") / F.lit(whole or 1.0)).alias(f"goal_{axis}")), axis)
    at = scratch.write(cells, "round0")
    for k in range(1, rounds + 1):
        step = at.withColumn("far", F.lit(0.0))
        for axis in AXES:
            now = step.groupBy(axis).agg(F.sum("w").alias("now"))
            step = step.join(now, axis)
            step = step.withColumn("far", F.greatest("far", F.abs(F.col("now") - F.col(f"goal_{axis}")))).withColumn("w", F.when(F.col("now") > 0, F.col("w") * F.col(f"goal_{axis}") / F.col("now")).otherwise(F.lit(0.0))).drop("now")
            step = scratch.write(step, f"round{k}_{axis}")
        scratch.drop(*([f"round{k - 1}_topic"] if k > 1 else ["round0"]), f"round{k}_source", f"round{k}_lang")
        at = step.drop("far")
        if step.agg(F.max("far")).first()[0] < close:
            break
    ratio = F.col("w") / F.col("n")
    least = at.where("w > 0").agg(F.min(ratio)).first()[0]
    if least is None or share <= 0:
        return at.select(*AXES, F.lit(0.0).alias("mix_chance"))
    low, high = 0.0, 1 / least
    for _ in range(16):  # 32 steps at a time
        steps = [low + (high - low) * (i + 1) / 32 for i in range(32)]
        drawn = at.agg(*[F.sum(F.least(F.lit(1.0), F.lit(m) * ratio) * F.col("n")).alias(f"s{i}") for i, m in enumerate(steps)]).first()
        i = next((i for i in range(32) if drawn[i] >= share * total), 31)
        low, high = (steps[i - 1] if i else low), steps[i]
    chance = F.lit(high) * ratio
    return at.select(*AXES, F.when(chance > 1 - 1e-9, F.lit(1.0)).otherwise(chance).alias("mix_chance"))


def rake_on_driver(cells: DataFrame, targets: Mapping[str, Mapping[str, float]], powers: Mapping[str, float], share: float) -> DataFrame:
    """As ``rake_tables``, for cells that are proven few."""
    rows = cells.collect()
    names = [sorted({r[axis] for r in rows}) for axis in AXES]
    index = [{x: i for i, x in enumerate(axis)} for axis in names]
    tokens = np.zeros([len(axis) for axis in names])
    for r in rows:
        tokens[index[0][r["source"]], index[1][r["lang"]], index[2][r["topic"]]] = r["n"]
    goals = []
    for axis, name in enumerate(AXES):
        now = tokens.sum(axis=tuple(k for k in range(3) if k != axis))
        given = targets.get(name)
        goals.append(np.array([float(given.get(str(x), 0)) for x in names[axis]]) if given else tempered(now, powers[name]))
    chance = probabilities(tokens, rake(tokens, goals), share)
    table = [(names[0][i], names[1][j], names[2][k], float(chance[i, j, k])) for i, j, k in zip(*np.nonzero(tokens), strict=True)]
    return cells.sparkSession.createDataFrame(table, "source string, lang string, topic int, mix_chance double")


def mix(docs: DataFrame, *, share: float = 0.5, powers: Mapping[str, float] | None = None, targets: Mapping[str, Mapping[str, float]] | None = None, text_col: str = "text", id_col: str = "doc_id", seed: int = 17, scratch: Scratch | None = None) -> DataFrame:
    """All rows and columns, then ``mix_tokens``, ``mix_topic``, ``mix_chance`` and ``mix_drawn``.

    Where the rows have a column of such a name already, it stays, and the new one gets an
    underscore at its end. Marginal targets are given by level in ``targets`` (``source``,
    ``lang``, ``topic``; levels not named get none; a name that is no level of the rows is an
    error, unless there are no rows), or else are the present token shares to the power in
    ``powers`` (0.7, 0.5 and 0: topics even). Null source or language is the level ''. Null and
    empty texts have one token and topic 0. Every level has its own target, however many there
    are: up to ``DRIVER_CELLS`` cells are fitted on the driver, more as tables. A row is drawn by a
    hash of its id and the seed, so equal ids are drawn alike and reruns agree.
    """
    powers = {"source": 0.7, "lang": 0.5, "topic": 0.0} | dict(powers or {})
    scratch = scratch or Scratch(docs.sparkSession, "mixing")
    tokens, topic, chance, drawn, source, lang = fresh(["mix_tokens", "mix_topic", "mix_chance", "mix_drawn", "mix_s", "mix_l"], docs.columns)
    plain = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    model = learn_topics(docs, scratch, text_col)
    described = with_topic(docs, model, tokens, topic, text_col)
    small = with_topic(docs.select("source", "lang", F.col(text_col).alias("text")), model, "n", "topic")
    cells = scratch.write(small.groupBy(plain("source").alias("source"), plain("lang").alias("lang"), "topic").agg(F.sum("n").alias("n")), "cells")
    targets = dict(targets or {})
    if unknown := set(targets) - set(AXES):
        raise ValueError(f"targets for no axis: {sorted(unknown)}")
    axes = [cells.select(axis).distinct().count() for axis in AXES]
    for axis, given in targets.items():
        names = docs.sparkSession.createDataFrame([(str(x),) for x in given], "level string")
        unknown = [r["level"] for r in names.join(cells.select(F.col(axis).cast("string").alias("level")).distinct(), "level", "left_anti").collect()] if axes[0] else []
        if unknown:
            raise ValueError(f"targets for no {axis} of the rows: {sorted(unknown)}")
    few = int(np.prod(axes, dtype=object)) <= DRIVER_CELLS
    chances = F.broadcast(rake_on_driver(cells, targets, powers, share)) if few else rake_tables(cells, targets, powers, share, scratch)
    chances = chances.select(F.col("source").alias(source), F.col("lang").alias(lang), F.col("topic").alias(topic), F.col("mix_chance").alias(chance))
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    return (
        described.withColumns({source: plain("source"), lang: plain("lang")})
        .join(chances, [source, lang, topic], "left")
        .withColumn(drawn, draw < F.coalesce(F.col(chance), F.lit(0.0)))
        .select(*docs.columns, tokens, topic, chance, drawn)
    )


def drawn(docs: DataFrame, **options) -> DataFrame:
    """The rows that ``mix`` draws, with their own columns."""
    mixed = mix(docs, **options)
    return mixed.where(F.col(mixed.columns[-1])).select(*docs.columns)
