"""Hard negatives by exact search over Hilbert-ordered blocks with zone maps.

Vectors become whole numbers, are ordered along a Hilbert curve through all dimensions, and are written as
Parquet files whose row groups are blocks of neighbours. The statistics that Parquet keeps for each column of a
row group, its least and greatest value, are the block's zone map. A task has a chunk of anchors that are
neighbours as well and the files of one lane. Interval arithmetic on the zone maps bounds the inner products of
each anchor with all rows of a block from both sides; a block is read only if these bounds reach into what an
anchor still looks for: something better than its fifth positive so far, or a window between 80 and 100 percent
of a positive's score that is not yet filled by better rows. Blocks come in the order of their upper bounds.

A task hands on five rows for an anchor or window, so rows grow with the anchors, whatever the size of the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlens.llm.shared import Scratch

#: Bits of each dimension in the curve, rows of a block, rows of a file, anchors of a chunk, lanes the files are dealt to.
BITS, BLOCK, FILE, CHUNK, LANES = 4, 1024, 65_536, 256, 16
#: Positives of an anchor, negatives of a window.
TOP = 5


def hilbert_keys(v: np.ndarray, low: int, high: int, bits: int = BITS) -> np.ndarray:
    """Place of each row of ``v`` (rows x dimensions) on a Hilbert curve, as rows of big-endian bytes.

    The cells are turned into the curve's transposed index by the exclusive-or and exchange steps from the highest
    bit down, then by a Gray code; interleaving the bits gives the place.
    """
    n, dims = v.shape
    if not n or not dims:
        return np.zeros((n, 0), np.uint8)
    span = max(1, high - low + 1)
    x = np.ascontiguousarray((((v - low).astype(np.float64) / span) * 2**bits).clip(0, 2**bits - 1).astype(np.uint8).T)
    for place in range(bits - 1, 0, -1):
        q, below = np.uint8(1 << place), np.uint8((1 << place) - 1)
        for d in range(dims):
            up = (x[d] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[d]) & below).astype(np.uint8)
            x[0] ^= np.where(up, below, swap)
            x[d] ^= swap
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    turn = np.zeros(n, np.uint8)
    for place in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] & np.uint8(1 << place), np.uint8((1 << place) - 1), np.uint8(0))
    x ^= turn
    planes = [((x >> np.uint8(place)) & 1).T for place in range(bits - 1, -1, -1)]
    return np.packbits(np.concatenate(planes, axis=1), axis=1)


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    at = urlparse(folder)
    return (fs.LocalFileSystem(), at.path) if at.scheme in ("", "file") else fs.FileSystem.from_uri(folder)


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(len(column), dims)


@lru_cache(maxsize=256)
def zones(folder: str, number: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest values (blocks x dimensions) of one file, from its footer."""
    store, root = _store(folder)
    meta = pq.read_metadata(f"{root}/{number}.parquet", filesystem=store)
    out = np.array([[(s.min, s.max) for s in (group.column(2 + d).statistics for d in range(dims))] for group in map(meta.row_group, range(meta.num_row_groups))], dtype=np.float64)
    return (out[:, :, 0], out[:, :, 1]) if out.size else (np.zeros((meta.num_row_groups, dims)),) * 2


def read_block(folder: str, number: int, group: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, labels, vectors) of one block."""
    store, root = _store(folder)
    with store.open_input_file(f"{root}/{number}.parquet") as f:
        t = pq.ParquetFile(f).read_row_group(group)
    vectors = [t.column(k).to_numpy() for k in range(2, t.num_columns)]
    return t.column(0).to_numpy(), t.column(1).to_numpy(), np.stack(vectors, axis=1) if vectors else np.zeros((len(t), 0), np.int64)


def bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product (anchors x blocks) that a row within a block's zone can have with an anchor."""
    up, down = np.maximum(anchors, 0.0), np.minimum(anchors, 0.0)
    return up @ low.T + down @ high.T, up @ high.T + down @ low.T


def products(anchors: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products as long integers; exact while a sum of absolute products stays below 2^53."""
    found = anchors @ vectors.T.astype(np.float64)
    return np.clip(found, -(2.0**63), 2.0**63 - 1024).astype(np.int64)


class Best:
    """The first ``TOP`` rows of each slot by (score descending, id), merged block by block."""

    def __init__(self, slots: int):
        self.scores = np.full((slots, TOP), np.iinfo(np.int64).min)
        self.ids = np.full((slots, TOP), np.iinfo(np.int64).max)
        self.filled = np.zeros(slots, dtype=np.int64)

    def floor(self, slots: np.ndarray | slice) -> np.ndarray:
        """A row below this score can't come among the first any more."""
        return self.scores[slots, TOP - 1]

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        touched = np.unique(slot)
        held = np.repeat(touched, TOP)
        there = np.tile(np.arange(TOP), len(touched)) < self.filled[held]
        slot = np.concatenate([slot, held[there]])
        score = np.concatenate([score, self.scores[touched].ravel()[there]])
        ids = np.concatenate([ids, self.ids[touched].ravel()[there]])
        # The bitwise complement turns the order of long integers about without overflow.
        order = np.lexsort((ids, ~score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        first = np.searchsorted(slot, slot)
        rank = np.arange(len(slot)) - first
        top = rank < TOP
        self.scores[slot[top], rank[top]], self.ids[slot[top], rank[top]] = score[top], ids[top]
        np.maximum.at(self.filled, slot[top], rank[top] + 1)


def find_positives(folder: str, files: list[int], ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> tuple[Best, int]:
    """First rows of the anchors' own labels among some files; and how many blocks were read."""
    best, read = Best(len(ids)), 0
    anchors = vectors.astype(np.float64)
    todo = []
    for number in files:
        low, high = zones(folder, number, anchors.shape[1])
        _, most = bounds(anchors, low, high)
        todo += [(number, group, most[:, group]) for group in range(len(low))]
    for number, group, most in sorted(todo, key=lambda x: (-x[2].max(initial=-np.inf), x[0], x[1])):
        if not np.any((best.filled < TOP) | (most >= best.floor(slice(None)))):
            continue
        read += 1
        other, kind, block = read_block(folder, number, group)
        score = products(anchors, block)
        wanted = (labels[:, None] == kind[None, :]) & (ids[:, None] != other[None, :]) & (score >= best.floor(slice(None))[:, None])
        at, row = np.nonzero(wanted)
        if len(at):
            best.add(at, score[at, row], other[row])
    return best, read


def find_negatives(folder: str, files: list[int], labels: np.ndarray, vectors: np.ndarray, tops: np.ndarray) -> tuple[Best, int]:
    """First rows of other labels in each window; ``tops`` (anchors x windows) are scores of positives. Slots are anchor * windows + window."""
    n, windows = tops.shape
    # 80 p <= 100 s <= 100 p: s from ceil(4 p / 5) to p; for a negative p that is empty.
    lows, highs = -((-4 * tops) // 5), tops
    best, read = Best(n * windows), 0
    anchors = vectors.astype(np.float64)
    todo = []
    for number in files:
        low, high = zones(folder, number, anchors.shape[1])
        least, most = bounds(anchors, low, high)
        todo += [(number, group, least[:, group], most[:, group]) for group in range(len(low))]
    for number, group, least, most in sorted(todo, key=lambda x: (-x[3].max(initial=-np.inf), x[0], x[1])):
        floor = np.maximum(lows, best.floor(slice(None)).reshape(n, windows))
        if not np.any((most[:, None] >= floor) & (least[:, None] <= highs) & (floor <= highs)):
            continue
        read += 1
        other, kind, block = read_block(folder, number, group)
        score, unlike = products(anchors, block), labels[:, None] != kind[None, :]
        for w in range(windows):
            at, row = np.nonzero(unlike & (score <= highs[:, w, None]) & (score >= floor[:, w, None]))
            if len(at):
                best.add(at * windows + w, score[at, row], other[row])
    return best, read


def _clean(table: DataFrame, id_col: str, vector_col: str, label_col: str, flip: int, classes: int) -> DataFrame:
    """vec_id, label, v: whole-number vectors of the rows that take part, one row for each id."""
    d = F.col("x").cast("array<double>")
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("int").alias("label"), F.col(vector_col).alias("x"))
    sound = F.forall(d, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & sound)
    label = F.when(F.col("vec_id") % flip == 0, (F.col("label") + 1) % classes).otherwise(F.col("label"))
    rows = rows.select("vec_id", label.alias("label"), F.transform(d, lambda c: F.floor(c * 256.0).cast("long")).alias("v"))
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("one")).select("vec_id", "one.label", "one.v")


_KEYED = "key binary, vec_id long, label int, v binary"
_CHUNK = "chunk long, ids binary, labels binary, vectors binary, tops binary"


def _pack_chunk(number: int, rows: pa.Table, dims: int) -> pa.RecordBatch:
    tops = rows.column("tops").to_pylist() if "tops" in rows.column_names else []
    return pa.RecordBatch.from_arrays(
        [
            pa.array([number], pa.int64()),
            *(pa.array([x], pa.binary()) for x in (rows.column("vec_id").to_numpy().astype(np.int64).tobytes(), rows.column("label").to_numpy().astype(np.int64).tobytes(), b"".join(rows.column("v").to_pylist()), np.array(tops, dtype=np.int64).tobytes())),
        ],
        names=["chunk", "ids", "labels", "vectors", "tops"],
    )


def _chunks(rows: DataFrame, parts: int, dims: int, lanes: int) -> DataFrame:
    """Anchors in the order of the curve, ``CHUNK`` to a row, once for each lane."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            while len(held) >= CHUNK:
                yield _pack_chunk(number, held.slice(0, CHUNK), dims)
                number, held = number + 1, held.slice(CHUNK)
        if held is not None and len(held):
            yield _pack_chunk(number, held, dims)

    packed = rows.repartitionByRange(parts, "key", "vec_id").sortWithinPartitions("key", "vec_id").mapInArrow(cut, _CHUNK)
    return packed.withColumn("lane", F.explode(F.array(*[F.lit(k) for k in range(lanes)])))


def _rank(order_by: str, *keys: str) -> Column:
    return F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), order_by))


def hard_negatives(table: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", anchor_step: int = 100, flip: int = 7, classes: int = 10, lanes: int = LANES, scratch: Scratch | None = None) -> DataFrame:
    """For every anchor and each of its positives, the first five rows of other labels in the window below the positive's score.

    Anchors are rows whose id is divisible by ``anchor_step``. Rows with a null id, label, vector or component, or a
    component that isn't finite, take no part. Vectors of unequal length are filled up with zeros; an empty vector has
    score 0 with all. Of rows that share an id the one with the smallest label, then vector, takes part, so repeated
    rows count once; rows with equal vectors are all candidates, ties go to the smaller id. An empty table gives an
    empty result. Scores are exact while their sums stay below 2^53, and doubles rounded to long beyond. Columns of
    the table other than the three named are not looked at, whatever their names.
    Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    """
    spark = table.sparkSession
    scratch = scratch or Scratch(spark, "hard-negatives")
    rows = scratch.write(_clean(table, id_col, vector_col, label_col, flip, classes), "rows")
    seen = rows.select(F.count("*"), F.max(F.size("v")), F.min(F.array_min("v")), F.max(F.array_max("v")), F.count_if(F.col("vec_id") % anchor_step == 0)).first()
    n, dims, low, high, n_anchors = (int(x or 0) for x in seen)
    files, folder = max(1, -(-n // FILE)), scratch.path("blocks")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            sizes, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()
            v = np.zeros((len(lists), dims), np.int64)
            v[np.repeat(np.arange(len(lists)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
            keys = hilbert_keys(v, low, high)
            binary = [pa.array([r.tobytes() for r in x], pa.binary()) for x in (keys, v)]
            yield pa.RecordBatch.from_arrays([binary[0], batch.column("vec_id"), batch.column("label"), binary[1]], names=["key", "vec_id", "label", "v"])

    def write_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        store, root = _store(folder)
        store.create_dir(root)
        schema = pa.schema([("vec_id", pa.int64()), ("label", pa.int32()), *((f"d{k}", pa.int64()) for k in range(dims))])
        part, count = f"{root}/.{number}-{TaskContext.get().taskAttemptId()}", 0
        with store.open_output_stream(part) as f, pq.ParquetWriter(f, schema) as out:
            held: list[pa.Table] = []

            def block(t: pa.Table) -> None:
                v = _vectors(t.column("v").combine_chunks(), dims)
                out.write_table(pa.Table.from_arrays([t.column("vec_id").cast(pa.int64()), t.column("label").cast(pa.int32()), *(pa.array(v[:, k]) for k in range(dims))], schema=schema))

            for batch in batches:
                held.append(pa.Table.from_batches([batch]))
                count += len(batch)
                while sum(map(len, held)) >= BLOCK:
                    whole = pa.concat_tables(held)
                    block(whole.slice(0, BLOCK))
                    held = [whole.slice(BLOCK)]
            if sum(map(len, held)):
                block(pa.concat_tables(held))
        store.move(part, f"{root}/{number}.parquet")
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([count], pa.int64())], names=["file", "rows"])

    ordered = scratch.write(rows.mapInArrow(keyed, _KEYED), "keyed")
    written = scratch.write(ordered.repartitionByRange(files, "key", "vec_id").sortWithinPartitions("key", "vec_id").mapInArrow(write_blocks, "file int, rows long"), "files")
    files = int(written.select(F.max("file")).first()[0] or 0) + 1 if n else 0
    anchors, parts = ordered.where(F.col("vec_id") % anchor_step == 0), max(1, -(-n_anchors // CHUNK))

    def lane(k: int) -> list[int]:
        return list(range(k, files, lanes))

    def unpacked(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        ids, labels, tops = (np.frombuffer(r[c], np.int64) for c in ("ids", "labels", "tops"))
        return ids, labels, np.frombuffer(r["vectors"], np.int64).reshape(len(ids), dims), tops.reshape(len(ids), -1)

    def positives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, labels, vectors, _ = unpacked(r)
                best, _ = find_positives(folder, lane(r["lane"]), ids, labels, vectors)
                at, k = np.nonzero(np.arange(TOP)[None, :] < best.filled[:, None])
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(best.ids[at, k]), pa.array(best.scores[at, k])], names=["anchor_id", "positive_id", "score"])

    near = _chunks(anchors, parts, dims, lanes).repartition(parts * lanes, "chunk", "lane").mapInArrow(positives, "anchor_id long, positive_id long, score long")
    near = scratch.write(near.withColumn("place", _rank("positive_id", "anchor_id")).where(F.col("place") <= TOP), "positives")

    # A window that an anchor doesn't have is an empty one: no score lies between 80 and 100 percent of a negative score.
    tops = near.groupBy("anchor_id").pivot("place", list(range(1, TOP + 1))).agg(F.first("score")).select(F.col("anchor_id").alias("vec_id"), F.array(*[F.coalesce(F.col(str(k)), F.lit(-1)) for k in range(1, TOP + 1)]).alias("tops"))

    def negatives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, labels, vectors, tops = unpacked(r)
                best, _ = find_negatives(folder, lane(r["lane"]), labels, vectors, tops)
                at, k = np.nonzero(np.arange(TOP)[None, :] < best.filled[:, None])
                yield pa.RecordBatch.from_arrays([pa.array(ids[at // TOP]), pa.array((at % TOP + 1).astype(np.int32)), pa.array(best.ids[at, k]), pa.array(best.scores[at, k])], names=["anchor_id", "place", "negative_id", "score"])

    far = _chunks(anchors.join(tops, "vec_id"), parts, dims, lanes).repartition(parts * lanes, "chunk", "lane").mapInArrow(negatives, "anchor_id long, place int, negative_id long, score long")
    far = far.withColumn("rank", _rank("negative_id", "anchor_id", "place")).where(F.col("rank") <= TOP)
    return far.join(near.withColumnRenamed("score", "positive_score"), ["anchor_id", "place"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", F.col("score").alias("negative_score"))


SQL = """
WITH sound AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS alike, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM sound a, sound b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other) AS INTEGER) AS rank,
       s.other AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.alike
  AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
QUALIFY rank <= 5
"""
