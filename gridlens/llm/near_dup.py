"""Near-duplicate classes by a MinHash LSH forest.

Each distinct text gets ``trees * depth`` minimum hashes. A tree is one sorted order of the texts
by its own ``depth`` hashes; texts that stand together there with a long common prefix are
candidates. Depth adapts to the region: a prefix of ``least_depth`` hashes is used where at most
``crowd`` texts share it, and one more hash at a time where more do. Candidates are confirmed on
whole shingle sets, and classes are the connected components of confirmed links.

Neighbours in the sorted orders are confirmed first (the most similar one of each text). A deeper
prefix than the least one could part two near texts in every tree, so depth only orders this
first pass: what is still open in any region of the least depth, however crowded, is settled by a
join that loses no pair. Of the shingles of a text, rarest first, as many are taken as two near
texts can't differ in; texts of different classes that share one of them, and whose sizes and
places allow it, are candidates. So two near texts are missed only if no tree puts them into one
region of the least depth: at 16 trees of depth 4, in 1 of 4,600 cases at a similarity of 0.8
and in 1 of 130,000 at 0.85. Joins of texts, signatures or sets are sort-merge joins at any size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridlens.llm import kernels as K
from gridlens.llm.components import connected_components
from gridlens.llm.shared import Scratch

_U32 = np.uint32
#: Texts that one task orders together; larger regions are ordered in parts. Hash classes of the profiles that bound an intersection from above.
BLOCK, CLASSES = 4096, 64


def _minhash_factors(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(7))
    return rng.integers(0, 2**31, n, dtype=np.uint32) * _U32(2) + _U32(1), rng.integers(0, 2**32, n, dtype=np.uint32)


def signature(shingles: np.ndarray, factors: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Minima of as many linear maps of the shingles' upper 32 bits as there are factors."""
    a, b = factors
    x = (shingles >> np.uint64(32)).astype(_U32)
    best = np.full(len(a), 2**32 - 1, dtype=_U32)
    for at in range(0, len(x), 2048):
        np.minimum(best, (x[at : at + 2048, None] * a + b).min(axis=0), out=best)
    return best


def _binary(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([x.tobytes() for x in arrays], type=pa.binary())


def _described(docs: DataFrame, id_col: str, text_col: str, size: int, hashes: int) -> DataFrame:
    """Per row: id, two hashes of the word sequence (null without words), set size, signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = _minhash_factors(hashes)
        for batch in batches:
            for part in K.slices(batch):
                w = K.words(part.column("text"))
                sets = K.shingles(w, size)
                whole = np.array([K.sequence_hash(w.hashes[a:b]) for a, b in zip(w.bounds[:-1], w.bounds[1:], strict=True)], dtype=np.uint64).reshape(-1, 2)
                none = w.counts == 0
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"),
                        pa.array(whole[:, 0].view(np.int64), mask=none),
                        pa.array(whole[:, 1].view(np.int64), mask=none),
                        pa.array([len(s) for s in sets], type=pa.int64()),
                        _binary([signature(s, factors) for s in sets]),
                    ],
                    names=["id", "k1", "k2", "n", "sig"],
                )

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, k1 long, k2 long, n long, sig binary")


def _prefixes(sigs: DataFrame, trees: int, depth: int, least: int) -> DataFrame:
    """A row per text and tree: the hashes of the tree's prefixes of ``least`` to ``depth`` minima."""
    names = [f"p{d}" for d in range(least, depth + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("id").to_numpy()
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), dtype=_U32).reshape(len(ids), trees, depth).astype(np.uint64)
            h = K.mix(np.tile(np.arange(1, trees + 1, dtype=np.uint64), (len(ids), 1)))
            columns = []
            for d in range(depth):
                h = K.mix(h * np.uint64(0xA0761D6478BD642F) + sig[:, :, d])
                if d + 1 >= least:
                    columns.append(pa.array(h.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, trees)), *columns], names=["id", *names])

    return sigs.select("id", "sig").mapInArrow(run, "id long, " + ", ".join(f"{n} long" for n in names))


def _estimated(pairs: DataFrame, sigs: DataFrame, cut: float) -> DataFrame:
    """Pairs whose signatures agree in at least the share ``cut``, with that share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=_U32).reshape(batch.num_rows, -1) for c in ("sa", "sb"))
            share = (x == y).mean(axis=1)
            keep = pa.array(share >= cut)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep), pa.array(share[share >= cut])], names=["a", "b", "est"])

    return (
        pairs.join(sigs.select(F.col("id").alias("a"), F.col("sig").alias("sa")).hint("merge"), "a")
        .join(sigs.select(F.col("id").alias("b"), F.col("sig").alias("sb")).hint("merge"), "b")
        .select("a", "b", "sa", "sb")
        .mapInArrow(run, "a long, b long, est double")
    )


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs with 100 * intersection >= percent * union on whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("xa"), batch.column("xb"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([p, q])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(both) - common))
            keep = pa.array(keep, type=pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    return (
        pairs.select("a", "b")
        .join(sets.select(F.col("id").alias("a"), F.col("items").alias("xa")).hint("merge"), "a")
        .join(sets.select(F.col("id").alias("b"), F.col("items").alias("xb")).hint("merge"), "b")
        .select("a", "b", "xa", "xb")
        .mapInArrow(run, "a long, b long")
    )


def _regions(sigs: DataFrame, trees: int, depth: int, least: int, crowd: int) -> DataFrame:
    """(id, base, near): the region of the least depth of each text and tree, if others share it, and the text before in the tree's order."""
    prefixes = _prefixes(sigs, trees, depth, least)
    levels = [f"p{d}" for d in range(least, depth + 1)]
    counts = [f"n{d}" for d in range(least, depth + 1)]
    # Counts by whole prefix are added up in each task first; the shorter prefixes' counts come from them.
    sizes = prefixes.groupBy(*levels).agg(F.count("*").alias(counts[-1]))
    for k in range(len(levels) - 1):
        sizes = sizes.withColumn(counts[k], F.sum(counts[-1]).over(Window.partitionBy(*levels[: k + 1])))
        if k == 0:
            sizes = sizes.where(F.col(counts[0]) > 1)
    region, n = F.col(levels[-1]), F.col(counts[-1])
    for level, count in reversed(list(zip(levels[:-1], counts[:-1], strict=True))):
        fits = F.col(count) <= crowd
        region, n = F.when(fits, F.col(level)).otherwise(region), F.when(fits, F.col(count)).otherwise(n)
    large = F.col(counts[0]) > BLOCK
    sizes = sizes.select(levels[-1], F.when(large, region).otherwise(F.col(levels[0])).alias("block"), F.when(large, F.ceil(n / BLOCK)).otherwise(1).alias("parts"))
    members = prefixes.join(sizes.hint("merge"), levels[-1])
    order = Window.partitionBy("block", F.pmod(F.xxhash64("id"), F.col("parts"))).orderBy(*levels, "id")
    return members.select("id", F.col(levels[0]).alias("base"), F.lag("id").over(order).alias("near"))


def _rare_shingles(sets: DataFrame, percent: int) -> DataFrame:
    """(id, g, n, i, profile): of each set the shingles g that a near one must share one of, with their place i in the order by rarity, and its size n.

    A near set lacks at most n - ceil(percent * n / 100) of the n. Shingles that no other set has
    come first and are never shared, so sets with too many of them have no row. The profile
    counts the shared ones by hash class: the sum over classes of two sets' smaller counts is
    never less than their intersection.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, x in zip(batch.column("id").to_numpy(), batch.column("items"), strict=True):
                g = np.frombuffer(x.as_buffer(), np.int64)
                for at in range(0, len(g), 1 << 16):
                    part = g[at : at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), i)), pa.array(np.full(len(part), len(g))), pa.array(part)], names=["id", "n", "g"])

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                s, n = part.column("s"), part.column("n").to_numpy()
                sizes = np.diff(s.offsets.to_numpy())
                row = np.repeat(np.arange(len(n)), sizes)
                k, g = (s.flatten().field(c).to_numpy() for c in ("k", "g"))
                profile = np.bincount(row * CLASSES + g % CLASSES, minlength=len(n) * CLASSES).reshape(len(n), CLASSES)
                order = np.lexsort((g, k, row))
                place = (n - sizes)[row] + np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                most = n - (n * percent + 99) // 100 + 1
                kept = np.flatnonzero(place < most[row])
                of = row[kept]
                flat = pa.array(profile[of].ravel().astype(np.int32))
                profiles = pa.ListArray.from_arrays(pa.array(np.arange(len(of) + 1, dtype=np.int32) * CLASSES), flat)
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(of)), pa.array(g[order][kept]), pa.array(n[of]), pa.array(place[kept]), profiles], names=["id", "g", "n", "i", "profile"])

    rows = sets.mapInArrow(run, "id long, n long, g long")
    often = rows.groupBy("g").agg(F.count("*").alias("k")).where("k > 1")
    shared = rows.join(often.hint("merge"), "g").groupBy("id", "n").agg(F.collect_list(F.struct("k", "g")).alias("s"))
    return shared.mapInArrow(chosen, "id long, g long, n long, i long, profile array<int>")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, trees: int = 16, depth: int = 8, least_depth: int = 4, crowd: int = 16, scratch: Scratch | None = None) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row, by the forest described above.

    Texts are linked when 100 * |intersection| >= percent * |union| of their sets of distinct
    ``size``-word shingles (A-Z lower-cased; a shorter text is one shingle). Equal word sequences
    are one text from the start. Rows without words (null, empty or white space) have an empty
    set, stand alone and are kept. A row whose id is null takes part in nothing: it is returned
    with a null component and is kept. Rows that share an id and text are all returned, each
    kept if its class has no smaller id; rows that share an id alone are separate texts, each in
    its own class. Columns other than id and text are not read.
    """
    scratch = scratch or Scratch(docs.sparkSession, "near_dup")
    spark = docs.sparkSession
    base = scratch.write(_described(docs, id_col, text_col, size, trees * depth), "base")
    texts = scratch.write(base.where("k1 is not null and id is not null").groupBy("k1", "k2").agg(F.min("id").alias("doc")), "texts")
    sigs = scratch.write(base.where("k1 is not null and id is not null").select(F.col("k1").alias("id"), "sig").dropDuplicates(["id"]), "sigs")
    members = scratch.write(_regions(sigs, trees, depth, least_depth, crowd), "members")

    margin = 4.5 * math.sqrt(percent / 100 * (1 - percent / 100) / (trees * depth))
    cut = percent / 100 - margin
    chain = members.where("near is not null").select(F.least("id", "near").alias("a"), F.greatest("id", "near").alias("b")).distinct()
    first = scratch.write(_estimated(chain, sigs, cut), "first")

    inside = texts.join(members.select(F.col("id").alias("k1")).distinct().hint("merge"), "k1", "left_semi").select(F.col("doc").alias("id")).distinct()

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch):
                w = K.words(part.column("text"))
                name = [K.sequence_hash(w.hashes[a:b])[0] for a, b in zip(w.bounds[:-1], w.bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.array(name, dtype=np.uint64).view(np.int64)), _binary(K.shingles(w, size))], names=["id", "items"])

    sets = scratch.write(
        docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
        .where("text is not null")
        .join(inside.hint("merge"), "id", "left_semi")
        .mapInArrow(items, "id long, items binary")
        .dropDuplicates(["id"]),
        "sets",
    )

    best = first.groupBy("a").agg(F.max_by("b", F.struct("est", "b")).alias("b")).select("a", "b")
    best = best.union(first.groupBy("b").agg(F.max_by("a", F.struct("est", "a")).alias("a")).select("a", "b")).distinct()
    tested = scratch.write(best, "tested")
    links = scratch.write(_confirmed(tested, sets, percent), "links0")
    classes = connected_components(links, scratch, "cc0")

    def with_class(df: DataFrame, classes: DataFrame, col: str, out: str) -> DataFrame:
        return df.join(classes.select(F.col("node").alias(col), F.col("component").alias(out)).hint("merge"), col, "left").withColumn(out, F.coalesce(out, col))

    def apart(pairs: DataFrame, classes: DataFrame) -> DataFrame:
        return with_class(with_class(pairs, classes, "a", "ca"), classes, "b", "cb").where("ca <> cb").select("a", "b")

    # All other neighbours that still stand in different classes, before anything larger is asked.
    more = apart(first.join(tested.hint("merge"), ["a", "b"], "left_anti"), classes)
    links = scratch.write(links.union(_confirmed(more, sets, percent)), "links1")
    classes = connected_components(links, scratch, "cc1")

    placed = with_class(members.select("id", "base"), classes, "id", "c")
    mixed = placed.groupBy("base").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("base")
    open_texts = scratch.write(members.select("id", "base").join(mixed.hint("merge"), "base", "left_semi").select("id").distinct(), "open")
    rare = scratch.write(with_class(_rare_shingles(sets.join(open_texts.hint("merge"), "id", "left_semi"), percent), classes, "id", "c"), "rare")
    per = rare.groupBy("g", "c").agg(F.count("*").alias("m"))
    mixed = per.groupBy("g").agg(F.max_by("c", F.struct("m", "c")).alias("main"), F.count("*").alias("k")).where("k > 1").select("g", "main")
    inner = scratch.write(rare.join(mixed.hint("merge"), "g"), "inner")
    stray = inner.where("c <> main").select("g", F.col("id").alias("s"), F.col("c").alias("sc"), F.col("n").alias("sn"), F.col("i").alias("si"), F.col("profile").alias("sp"))
    possible = lambda common: 100 * common >= percent * (F.col("sn") + F.col("n") - common)
    common = F.aggregate(F.zip_with("sp", "profile", lambda x, y: F.least(x, y)), F.lit(0), lambda t, x: t + x)
    most = F.least(F.col("sn") - F.col("si"), F.col("n") - F.col("i"))
    across = (
        stray.join(inner.hint("merge"), "g")
        .where((F.col("c") != F.col("sc")) & ((F.col("c") == F.col("main")) | (F.col("s") < F.col("id"))) & possible(most) & possible(common))
        .select(F.least("s", "id").alias("a"), F.greatest("s", "id").alias("b"))
        .distinct()
    )
    rest = scratch.write(_estimated(across.join(first.select("a", "b").hint("merge"), ["a", "b"], "left_anti"), sigs, cut), "rest")
    links = scratch.write(links.union(_confirmed(rest, sets, percent)), "links2")
    scratch.drop("sets", "sigs", "members", "rare", "inner", "first", "rest", "open", "tested", "links0", "links1")
    classes = connected_components(links, scratch, "cc2")

    named = scratch.write(texts.join(classes.withColumnRenamed("node", "k1").hint("merge"), "k1", "left").select("k1", "k2", "doc", F.coalesce("component", "k1").alias("class")), "named")
    least = named.groupBy("class").agg(F.min("doc").alias("component"))
    named = named.join(least.hint("merge"), "class").select("k1", "k2", "component")
    out = scratch.write(
        base.join(named.hint("merge"), ["k1", "k2"], "left")
        .withColumn("component_id", F.when(F.col("k1").isNull() | F.col("id").isNull(), F.col("id")).otherwise(F.col("component")))
        .select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept")),
        "result",
    )
    scratch.drop("base", "texts", "named", "links2")
    return spark.read.schema(out.schema).parquet(scratch.path("result"))
