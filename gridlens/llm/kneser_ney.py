"""Interpolated modified Kneser-Ney trigram model, counted in Spark and memory-mapped for scoring.

Words are counted first; a word's id is its place in the order of word hashes. A second job counts
the runs of three ids: each task adds up its own, and ranges of equal weight are shuffled as packed
arrays. A range belongs to a stretch of middle words, so its trigrams share their word pairs, and a
very frequent middle word or pair of words spreads over several ranges. Each range writes its
trigram counts and hands on what its trigrams say about pairs: how many words stand before a pair,
and what follows it. A third job adds these up by pair, writes them, and hands on the same for words.

Tables are sorted arrays of 64-bit n-gram hashes, cut into ranges that follow from word counts.
Of a hash the file keeps what its place doesn't say: the upper bits choose a bucket of about eight
entries, the next 32 bits are stored (an unseen n-gram passes for a seen one with a chance of
eight in 2^32). Counts are bytes, with a list of those that are larger. Nothing is pruned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlens.llm import kernels as K
from gridlens.llm import mapped
from gridlens.llm.shared import Scratch

_U = np.uint64
#: Hashes that stand for the beginning and the end of a text; no word is empty, so none has the hash of no bytes by construction.
BEGIN, END = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x5BD1E9955BD1E995)
#: Distinct words a task holds before it hands them on, tokens whose trigrams it sorts at a time, tokens of a range.
HELD, STREAM, RANGE = 1_000_000, (1 << 20) - 2, 1_500_000


def pack(*columns: np.ndarray) -> bytes:
    """Equally long arrays of non-negative integers, the first of them sorted, as compressed byte planes."""
    planes, sizes = [], []
    for k, c in enumerate(columns):
        c = mapped.narrow(c if k else np.diff(c, prepend=c.dtype.type(0)))
        sizes.append(c.dtype.itemsize)
        planes.append(c.view(np.uint8).reshape(len(c), c.dtype.itemsize).T.tobytes())
    raw = b"".join(planes)
    head = np.array([len(columns[0]), len(raw), len(columns), *sizes], dtype=np.int64).tobytes()
    return head + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(data: pa.Scalar) -> list[np.ndarray]:
    whole = np.frombuffer(data.as_buffer(), np.uint8)
    n, size, k = whole[:24].view(np.int64).tolist()
    sizes = whole[24 : 24 + 8 * k].view(np.int64).tolist()
    raw = np.frombuffer(pa.decompress(whole[24 + 8 * k :].tobytes(), decompressed_size=size, codec="zstd"), np.uint8) if size else np.zeros(0, np.uint8)
    out, at = [], 0
    for s in sizes:
        out.append(np.ascontiguousarray(raw[at : at + s * n].reshape(s, n).T).view(f"u{s}").ravel().astype(np.int64))
        at += s * n
    out[0] = np.cumsum(out[0])
    return out


def _joined(table: pa.Table, column: str = "data") -> list[np.ndarray]:
    return [np.concatenate(x) for x in zip(*[unpack(x) for x in table.column(column)], strict=True)]


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)


def _pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return K.mix(K.mix(a.astype(_U) + _U(0x9E3779B97F4A7C15)) * _U(0xD6E8FEB86659FD93) + b.astype(_U))


def _triple_hash(y: np.ndarray, x: np.ndarray, z: np.ndarray) -> np.ndarray:
    return K.mix(_pair_hash(y, x) * _U(0xA0761D6478BD642F) + z.astype(_U))


def write_table(folder: str, name: str, keys: np.ndarray, columns: list[np.ndarray]) -> None:
    """Sorted distinct 64-bit keys and their values."""
    bits = max(1, int(len(keys) // 8).bit_length())
    buckets = np.zeros(2**bits + 1, dtype=np.int64)
    np.cumsum(np.bincount((keys >> _U(64 - bits)).astype(np.int64), minlength=2**bits), out=buckets[1:])
    arrays = [mapped.narrow(buckets), ((keys >> _U(32 - bits)) & _U(0xFFFFFFFF)).astype(np.uint32)]
    for c in columns:
        large = np.flatnonzero(c >= 255)
        arrays += [np.minimum(c, 255).astype(np.uint8), large.astype(np.uint64), c[large].astype(np.uint64)]
    mapped.put(folder, name, *arrays)


def read_table(folder: str, name: str, keys: np.ndarray) -> list[np.ndarray]:
    """The values of keys, 0 for keys that aren't there."""
    buckets, kept, *columns = mapped.get(folder, name)
    if not len(kept):
        return [np.zeros(len(keys), dtype=np.int64) for _ in columns[::3]]
    bits = (len(buckets) - 1).bit_length() - 1
    at = (keys >> _U(64 - bits)).astype(np.int64)
    want = ((keys >> _U(32 - bits)) & _U(0xFFFFFFFF)).astype(np.uint32)
    low, high = buckets[at].astype(np.int64), buckets[at + 1].astype(np.int64)
    end, last = high, len(kept) - 1
    for _ in range(int((high - low).max(initial=0)).bit_length()):
        mid = (low + high) >> 1
        less = (low < high) & (kept[np.minimum(mid, last)] < want)
        low, high = np.where(less, mid + 1, low), np.where(less, high, mid)
    low = np.minimum(low, last)
    there = (low < end) & (kept[low] == want)
    out = []
    for small, places, values in zip(columns[::3], columns[1::3], columns[2::3], strict=True):
        v = np.where(there, small[low], 0).astype(np.int64)
        if len(places):
            large = np.flatnonzero(v == 255)
            v[large] = values[np.searchsorted(places, low[large].astype(np.uint64))]
        out.append(v)
    return out


@dataclass
class Model:
    """Where the arrays lie, and the few numbers that go with them. Ids count the begin mark as a word."""

    folder: str
    bits: int  # a word's shard: the top bits of its hash
    offsets: np.ndarray  # id of each shard's first word
    before: np.ndarray  # tokens and begin marks in the shards before
    tokens: int
    types: int  # without the begin mark
    docs: int
    ranges: int
    discounts: list[np.ndarray] = field(default_factory=lambda: [np.zeros(4)] * 3)  # of words, pairs and trigrams: 0, D1, D2, D3+
    pair_types: int = 0
    mass: float = 1.0  # left for the uniform part

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of sorted distinct word hashes; -1 where training text has no such word."""
        out = np.full(len(hashes), -1, dtype=np.int64)
        cuts = np.searchsorted(hashes >> _U(64 - self.bits), np.arange(2**self.bits + 1, dtype=_U)) if self.bits else np.array([0, len(hashes)])
        for k in np.flatnonzero(np.diff(cuts) * np.diff(self.offsets)):  # a shard without words has no file
            there, ask = mapped.get(self.folder, f"word-{k}")[0], hashes[cuts[k] : cuts[k + 1]]
            at = np.minimum(np.searchsorted(there, ask), len(there) - 1)
            out[cuts[k] : cuts[k + 1]] = np.where(there[at] == ask, at + self.offsets[k], -1)
        return out

    def values(self, kind: str, columns: tuple[int, ...], ids: np.ndarray) -> list[np.ndarray]:
        """Columns of per-word arrays at sorted ids."""
        out = [np.zeros(len(ids), dtype=np.int64) for _ in columns]
        cuts = np.searchsorted(ids, self.offsets)
        for k in np.flatnonzero(np.diff(cuts)):
            arrays, part = mapped.get(self.folder, f"{kind}-{k}"), slice(cuts[k], cuts[k + 1])
            for o, c in zip(out, columns, strict=True):
                o[part] = arrays[c][ids[part] - self.offsets[k]]
        return out

    def counts(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of sorted ids, and the tokens before them in the order of ids."""
        count, before = self.values("word", (1, 2), ids)
        return count, before + self.before[np.searchsorted(self.offsets, ids, "right") - 1]

    def _range(self, place: np.ndarray) -> np.ndarray:
        return np.minimum((place * (self.ranges / (self.tokens + self.docs))).astype(np.int64), self.ranges - 1)

    def pair_range(self, count_a: np.ndarray, before_a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The range of a pair: where its first word lies among all tokens, and in it the second word's id."""
        return self._range(before_a + count_a * (b / (self.types + 1)))

    def triple_range(self, count_y: np.ndarray, before_y: np.ndarray, count_x: np.ndarray, x: np.ndarray, z: np.ndarray) -> np.ndarray:
        """The range of a trigram x y z: where y lies, in it x, and z over as many tokens as the pair can have."""
        n = self.types + 1
        return self._range(before_y + np.mod(count_y * (x / n) + np.minimum(count_x, count_y) * (z / n), np.maximum(count_y, 1)))


def _stream(model: Model, w: K.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens of a slice as places in a list of ids, that list (-1: unknown), where texts begin): two begin marks, words, end."""
    n, texts = len(w.hashes), len(w.bounds) - 1
    distinct, back = np.unique(np.concatenate([w.hashes, np.array([BEGIN, END])]), return_inverse=True)
    first = w.bounds + 3 * np.arange(texts + 1)
    out = np.empty(n + 3 * texts, dtype=np.int64)
    out[first[:-1]] = out[first[:-1] + 1] = back[n]
    out[np.arange(n) + 3 * w.text_of + 2] = back[:n]
    out[first[1:] - 1] = back[n + 1]
    return out, model.ids(distinct), first


def discounts(n: np.ndarray) -> np.ndarray:
    """D1, D2, D3+ from the numbers of entries that occur one to four times, kept within 0 to 1, 2, 3."""
    n1, n2, n3, n4 = (float(x) for x in n)
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5
    d = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return np.array([0.0, *np.clip(d, 0.01, [1, 2, 3])])


_PACKED = "bucket int, data binary"


def _rows(buckets: np.ndarray, columns: list[np.ndarray], ranges: int) -> tuple[list[int], list[bytes]]:
    """Columns by bucket, packed."""
    narrow = buckets.astype(np.min_scalar_type(ranges))
    order = np.argsort(narrow, kind="stable")
    cuts = [*_runs(narrow[order]), len(order)]
    held = [c[order] for c in columns]
    return [int(buckets[order[i]]) for i in cuts[:-1]], [pack(*(c[i:j] for c in held)) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]


def _batch(buckets: list[int], data: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(data, pa.binary())], names=["bucket", "data"])


def _small(n: np.ndarray) -> list[int]:
    return [int((n == j).sum()) for j in (1, 2, 3, 4)]


def train(docs: DataFrame, scratch: Scratch, text_col: str = "text", shard_bits: int | None = None) -> Model:
    """Count all rows of ``docs``. Null and empty texts count as one end token. No rows yield a model with uniform scores.

    What meets in one task is a range: about ``RANGE`` tokens' trigrams, each once for each task
    that has it. Tables that later jobs don't read are dropped.
    """
    text = docs.select(F.col(text_col).cast("string").alias("text"))
    parts = max(1, docs.rdd.getNumPartitions()) if shard_bits is None else 1
    bits = shard_bits if shard_bits is not None else max(4, int(np.ceil(np.log2(2 * parts))))
    folder = scratch.path("model")

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = [], []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            k, c = np.concatenate(keys), np.concatenate(counts)
            order = np.argsort(k)
            first = _runs(k[order])
            return k[order][first], np.add.reduceat(c[order], first)

        def flush(k: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
            shard = (k >> _U(64 - bits)).astype(np.int64)
            cuts = [*_runs(shard), len(k)]
            return _batch([int(shard[i]) for i in cuts[:-1]], [pack(k[i:j], c[i:j]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)])

        for batch in batches:
            for part in K.slices(batch):
                w = K.words(part.column("text"))
                k, c = np.unique(np.concatenate([w.hashes, np.full(part.num_rows, BEGIN), np.full(part.num_rows, END)]), return_counts=True)
                keys.append(k)
                counts.append(c)
                if sum(map(len, keys)) > 2 * HELD:
                    k, c = merged()
                    keys, counts = [k], [c]
                    if len(k) > HELD:
                        yield flush(k, c)
                        keys, counts = [], []
        if keys:
            yield flush(*merged())

    def write_words(key, table):
        shard, (k, c) = key[0].as_py(), _joined(table)
        k = k.view(_U)
        order = np.argsort(k)
        first = _runs(k[order])
        k, c = k[order][first], np.add.reduceat(c[order], first)
        mapped.put(folder, f"word-{shard}", k, mapped.narrow(c), mapped.narrow(np.cumsum(c) - c))
        of = lambda mark: int(c[k == mark].sum())
        return pa.table({"shard": pa.array([shard], pa.int32()), "n": [len(k)], "tokens": [int(c.sum())], "docs": [of(END)], "begin": [int(np.flatnonzero(k == BEGIN)[0]) if of(BEGIN) else -1]})

    counted = scratch.write(text.mapInArrow(count_words, _PACKED).groupBy("bucket").applyInArrow(write_words, "shard int, n long, tokens long, docs long, begin long"), "words")
    sizes, begin = np.zeros((2**bits, 3), dtype=np.int64), -1
    rows = counted.collect()  # a row for each shard, twice as many as there are partitions
    for r in rows:
        sizes[r["shard"]] = r["n"], r["tokens"], r["docs"]
    ends = np.concatenate([[0], np.cumsum(sizes[:, 0])])
    for r in rows:
        begin = int(ends[r["shard"]] + r["begin"]) if r["begin"] >= 0 else begin
    texts = int(sizes[:, 2].sum())
    tokens = int(sizes[:, 1].sum()) - texts
    model = Model(folder, bits, ends, np.cumsum(sizes[:, 1]) - sizes[:, 1], tokens, max(0, int(ends[-1]) - 1), texts, max(1, -(-tokens // RANGE)))
    if not tokens:
        model.discounts = [discounts(np.zeros(4))] * 3
        return model

    def count_triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            s = np.concatenate(held)
            held.clear()
            for at in range(0, len(s) - 2, STREAM):
                distinct, local = np.unique(s[at : at + STREAM + 2], return_inverse=True)  # at most 21 bits
                local = local.astype(_U)
                key = (local[1:-1] << _U(42) | local[:-2] << _U(21) | local[2:])[s[at + 2 : at + STREAM + 2] != begin]
                key.sort()
                first = _runs(key)
                c = np.diff(np.append(first, len(key)))
                key = key[first]
                count, before = model.counts(distinct)
                y, x, z = (((key >> _U(b)) & _U(0x1FFFFF)).astype(np.int64) for b in (42, 21, 0))
                where = model.triple_range(count[y], before[y], count[x], distinct[x], distinct[z])
                yield _batch(*_rows(where, [distinct[y], distinct[x], distinct[z], c], model.ranges))

        n = 0
        for batch in batches:
            for part in K.slices(batch):
                s, ids, _ = _stream(model, K.words(part.column("text")))
                held.append(ids[s])
                n += len(s)
                if n >= STREAM:
                    yield from flush()
                    n = 0
        if held:
            yield from flush()

    def write_triples(key, table):
        """Writes the range; hands on (a, b, words before a b, tokens after it, words that follow once, twice, more often)."""
        y, x, z, c = _joined(table)
        h = _triple_hash(y, x, z)
        order = np.argsort(h)
        first = _runs(h[order])
        c = np.add.reduceat(c[order], first)
        order = order[first]
        write_table(folder, f"triple-{key[0].as_py()}", h[order], [c])
        y, x, z = y[order], x[order], z[order]

        suffix = _pair_hash(y, z)
        by = np.argsort(suffix)
        first = _runs(suffix[by])
        n, at = np.diff(np.append(first, len(by))), by[first]
        context = _pair_hash(x, y)
        by = np.argsort(context)
        first = _runs(context[by])
        cs = c[by]
        follow = [np.add.reduceat(v, first) for v in (cs, cs == 1, cs == 2, cs > 2)]
        also = by[first]
        a, b = np.concatenate([y[at], x[also]]), np.concatenate([z[at], y[also]])
        columns = [np.concatenate([n, np.zeros(len(also), np.int64)]), *(np.concatenate([np.zeros(len(at), np.int64), v.astype(np.int64)]) for v in follow)]
        order = np.lexsort((b, a))
        a, b, columns = a[order], b[order], [v[order] for v in columns]
        distinct, back = np.unique(a, return_inverse=True)
        count, before = model.counts(distinct)
        buckets, data = _rows(model.pair_range(count[back], before[back], b), [a, b, *columns], model.ranges)
        return pa.table(_batch([*buckets, -1], [*data, pack(np.arange(4), np.array(_small(c)))]))

    def write_pairs(key, table):
        """Writes a range; hands on, for each shard of words, what follows them and how many words stand before."""
        if key[0].as_py() < 0:
            total = np.sum([unpack(x)[1] for x in table.column("data")], axis=0)
            return pa.table({"shard": pa.array([-1], pa.int32()), "data": pa.array([pack(np.arange(4), total)], pa.binary())})
        a, b, *columns = _joined(table)
        h = _pair_hash(a, b)
        order = np.argsort(h)
        first = _runs(h[order])
        columns = [np.add.reduceat(v[order], first) for v in columns]
        order = order[first]
        write_table(folder, f"pair-{key[0].as_py()}", h[order], columns)
        n = columns[0]
        some = n > 0
        a, b, n = a[order][some], b[order][some], n[some]
        out: dict[str, list] = {"shard": [-2], "data": [pack(np.arange(4), np.array(_small(n)))]}
        for ids, values in ((a, [n, n == 1, n == 2, n > 2, n * 0]), (b, [n * 0] * 4 + [n > 0])):
            by = np.argsort(ids, kind="stable")
            first = _runs(ids[by])
            if not len(first):
                continue
            ids, values = ids[by][first], [np.add.reduceat(v[by].astype(np.int64), first) for v in values]
            cuts = np.searchsorted(ids, model.offsets)
            for s in np.flatnonzero(np.diff(cuts)):
                part = slice(cuts[s], cuts[s + 1])
                out["shard"].append(int(s))
                out["data"].append(pack(ids[part] - model.offsets[s], *(v[part] for v in values)))
        return pa.table({"shard": pa.array(out["shard"], pa.int32()), "data": pa.array(out["data"], pa.binary())})

    # An empty row for each range, so that each has a file and a lost one is an error.
    every = docs.sparkSession.range(model.ranges).select(F.col("id").cast("int").alias("bucket"), F.lit(pack(*[np.zeros(0, np.int64)] * 4)).alias("data"))
    grouped = text.mapInArrow(count_triples, _PACKED).unionByName(every).groupBy("bucket").applyInArrow(write_triples, _PACKED)
    every = every.withColumn("data", F.lit(pack(*[np.zeros(0, np.int64)] * 7)))
    sides = scratch.write(grouped.unionByName(every).groupBy("bucket").applyInArrow(write_pairs, "shard int, data binary"), "sides")
    sizes_of = model.offsets

    def write_sides(key, table):
        shard = key[0].as_py()
        if shard < 0:
            ones = np.sum([unpack(x)[1] for x in table.column("data")], axis=0).tolist()
            return pa.table({"shard": pa.array([shard], pa.int32()), "ones": [ones], "types": [0]})
        at, *columns = _joined(table)
        dense = [np.bincount(at, v, int(sizes_of[shard + 1] - sizes_of[shard])).astype(np.int64) for v in columns]
        mapped.put(folder, f"side-{shard}", *map(mapped.narrow, dense))
        left = dense[4]
        return pa.table({"shard": pa.array([shard], pa.int32()), "ones": [[*_small(left), int((left > 2).sum())]], "types": [int(left.sum())]})

    # Every shard with words gets arrays, also one whose words follow nothing and precede nothing.
    blank = pack(np.zeros(1, np.int64), *[np.zeros(1, np.int64)] * 5)
    blanks = docs.sparkSession.createDataFrame([(int(s), blank) for s in np.flatnonzero(sizes[:, 0])], "shard int, data binary")
    found = scratch.write(sides.unionByName(blanks).groupBy("shard").applyInArrow(write_sides, "shard int, ones array<long>, types long"), "found")
    ones, pair_types = np.zeros(5), 0
    for r in found.collect():  # a row for each shard
        if r["shard"] < 0:
            model.discounts[r["shard"]] = discounts(np.array(r["ones"]))  # -1: of trigrams, -2: of pairs
        else:
            ones, pair_types = ones + r["ones"], pair_types + r["types"]
    model.discounts[0] = discounts(ones[:4])
    model.pair_types = int(pair_types)
    model.mass = float(model.discounts[0][1:] @ np.array([ones[0], ones[1], ones[4]]) / max(model.pair_types, 1))
    scratch.drop("words", "sides", "found")
    return model


def _looked_up(model: Model, kind: str, ranges: np.ndarray, keys: np.ndarray, columns: int) -> list[np.ndarray]:
    """Values of a table at keys, range by range."""
    out = [np.zeros(len(keys), dtype=np.int64) for _ in range(columns)]
    narrow = ranges.astype(np.min_scalar_type(model.ranges))
    order = np.argsort(narrow, kind="stable")
    cuts = [*_runs(narrow[order]), len(order)]
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        part = order[i:j]
        for o, v in zip(out, read_table(model.folder, f"{kind}-{ranges[part[0]]}", keys[part]), strict=True):
            o[part] = v
    return out


def probabilities(model: Model, s: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the tokens of a stream are, their probability given the two before, and their training count."""
    known = np.flatnonzero(ids >= 0)
    count, before, total, left = (np.zeros(len(ids), dtype=np.int64) for _ in range(4))
    once = [np.zeros(len(ids), dtype=np.int64) for _ in range(3)]
    if len(known):
        count[known], before[known] = model.counts(ids[known])
        found = model.values("side", (0, 1, 2, 3, 4), ids[known])
        for array, v in zip((total, *once, left), found, strict=True):
            array[known] = v
    d1, d2, d3 = model.discounts
    single = (left - d1[np.minimum(left, 3)]) / max(model.pair_types, 1) + model.mass / (model.types + 1)
    share = (d2[1] * once[0] + d2[2] * once[1] + d2[3] * once[2]) / np.maximum(total, 1)  # of a word's followers, left for words alone

    wide = len(ids)
    both = (ids[s[:-1]] >= 0) & (ids[s[1:]] >= 0)
    keys, back = np.unique(s[:-1][both] * wide + s[1:][both], return_inverse=True)
    at = np.full(len(s) - 1, -1, dtype=np.int64)
    at[both] = back
    a, b = keys // wide, keys % wide
    n, after, *follow = _looked_up(model, "pair", model.pair_range(count[a], before[a], ids[b]), _pair_hash(ids[a], ids[b]), 5)
    second = np.append((n - d2[np.minimum(n, 3)]) / np.maximum(total[a], 1), 0.0)  # the last one: no such pair
    after = np.append(after, 0)
    share_of_pair = np.append((d3[1] * follow[0] + d3[2] * follow[1] + d3[3] * follow[2]) / np.maximum(after[:-1], 1), 0.0)

    tokens = np.flatnonzero(s[2:] != s[0]) + 2  # a stream begins with a begin mark
    z, y, x = s[tokens], s[tokens - 1], s[tokens - 2]
    p = np.where(total[y] > 0, second[at[tokens - 1]] + share[y] * single[z], single[z])
    context = at[tokens - 2]
    asked = np.flatnonzero((after[context] > 0) & (ids[z] >= 0))
    yy, xx, zz = y[asked], x[asked], z[asked]
    seen = np.zeros(len(tokens), dtype=np.int64)
    (seen[asked],) = _looked_up(model, "triple", model.triple_range(count[yy], before[yy], count[xx], ids[xx], ids[zz]), _triple_hash(ids[yy], ids[xx], ids[zz]), 1)
    there = after[context]
    p = np.where(there > 0, (seen - d3[np.minimum(seen, 3)]) / np.maximum(there, 1) + share_of_pair[context] * p, p)
    return tokens, p, count[z]


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, n_known, train_tokens, base_score, score)`` for every row, log10 throughout.

    ``base_score`` is the add-one word model's; both models end a text with one end token, which
    counts. Null and empty texts have that token alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch, limit=8 * K.SLICE_BYTES):
                s, ids, first = _stream(model, K.words(part.column("text")))
                _, p, c = probabilities(model, s, ids)
                base = np.log10((c + 1) / (model.tokens + model.types + 1))
                begins = first[:-1] - 2 * np.arange(part.num_rows)
                total = lambda x: np.add.reduceat(x, begins)  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"),
                        pa.array(np.diff(first) - 2),
                        pa.array(total((c > 0).astype(np.int64))),
                        pa.array(np.full(part.num_rows, model.tokens)),
                        pa.array(total(base)),
                        pa.array(total(np.log10(p))),
                    ],
                    names=["id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return out.mapInArrow(run, "id long, n_tokens long, n_known long, train_tokens long, base_score double, score double").withColumnRenamed("id", "doc_id")


def fold(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; -1 for a null id, which is in no fold."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % n, F.lit(-1))


def corpus_scores(docs: DataFrame, *, folds: int = 7, held: int = 2, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """Learn from the rows outside fold ``held`` and score all rows; ``held_out`` marks that fold.

    Perplexity of a row is ``10 ** (-score / n_tokens)``. Columns other than id and text are not
    read; rows that share an id are scored each. A text as long as an executor's memory allows is
    scored whole: its words take 16 bytes each beside it.
    """
    scratch = scratch or Scratch(docs.sparkSession, "kneser_ney")
    model = train(docs.where(fold(id_col, folds) != held), scratch, text_col)
    scored = score(docs, model, id_col, text_col)
    return scored.select("doc_id", (fold("doc_id", folds) == held).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
