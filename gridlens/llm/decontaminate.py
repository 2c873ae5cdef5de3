"""Benchmark decontamination by latent semantic retrieval.

Passages are runs of ``TILE`` words. Their TF-IDF matrix A (hashed to ``TERMS`` columns) is never
stored: one pass over all documents counts frequencies, one more over all passages adds up
B = A'(A Omega) for a random matrix Omega, a block of rows for each task, and B gives the leading
singular vectors (the one-pass randomised form for A'A).

Candidates come from two searches. The latent one projects every document to the whitened space,
in windows that begin every ``HOP`` words, and compares all of them by cosine with windows of every
item, one every quarter of a window; it names what resembles an item as a whole, whichever words
were replaced. An index of the items' rarer words names the places where a passage of the least
coverage can be and loses none of these; there the windows of the document begin at every word. All
candidates are settled in the same task: the longest common subsequence with the item and with its
answer (its last sentence, or its last third) decides, and a passage near in the latent space needs
less of both.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlens.llm import kernels as K
from gridlens.llm import mapped
from gridlens.llm.shared import Scratch

TERMS, RANK, SPARE = 4096, 128, 16
TILE = 24
#: Passages whose sums are made at a time, and rounds of words of one term before the rest is added up term by term.
TILES, ROUNDS = 256, 24
#: Words of a window.
SCALES = (8, 16, 32)
#: Words between the beginnings of windows in the latent search.
HOP = 8
#: Items of one index file, about.
ITEM_BLOCK = 2048
#: Windows times item windows compared at a time.
PRODUCT = 1 << 19


@dataclass
class Space:
    """Row t of ``project`` is what one word of term t adds to a window's latent vector; ``idf`` tells rare terms."""

    project: np.ndarray
    idf: np.ndarray


@dataclass
class Item:
    item_id: int
    words: list[int]
    answer: list[int]


def _terms(w: K.Words) -> np.ndarray:
    return (w.hashes >> np.uint64(52)).astype(np.int64)


def _tiles(w: K.Words) -> tuple[np.ndarray, int]:
    """Tile of each word, and the number of tiles; a tile never spans two texts."""
    per = -(-w.counts // TILE)
    first = np.concatenate([[0], np.cumsum(per)])
    place = np.arange(len(w.hashes)) - np.repeat(w.bounds[:-1], w.counts)
    return np.repeat(first[:-1], w.counts) + place // TILE, int(first[-1])


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def inverse_frequencies(texts: DataFrame) -> np.ndarray:
    """log((tiles + 1) / (tiles with the term + 1)) of all terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, tiles = np.zeros(TERMS, dtype=np.int64), 0
        for batch in batches:
            for part in K.slices(batch):
                w = K.words(part.column("text"), latin=True)
                tile, n = _tiles(w)
                key = np.sort(tile * TERMS + _terms(w))
                df += np.bincount(key[np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]] % TERMS, minlength=TERMS)
                tiles += n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(TERMS + 1)), pa.array(np.append(df, tiles))], names=["term", "n"])

    df = np.zeros(TERMS + 1, dtype=np.int64)
    for r in texts.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():  # TERMS + 1 rows
        df[r["term"]] = r["n"]
    return np.log((df[TERMS] + 1.0) / (df[:TERMS] + 1.0))


def add_products(term: np.ndarray, tile: np.ndarray, n: int, weighted: np.ndarray, total: np.ndarray) -> None:
    """Adds T'(T ``weighted``) to ``total`` for the counts T of terms in ``n`` tiles; words in order of their tiles.

    Sums of tiles go by the words' places, those of terms by occurrence: a round adds one tile's sum to each term that has
    so many words, so no row is met twice in a round.
    """
    if not len(term):
        return
    begin = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]]))
    grid = np.full((TILE, n), TERMS, dtype=np.int32)  # TERMS is no word and adds nothing
    grid[np.arange(len(tile)) - begin[tile], tile] = term
    padded = np.concatenate([weighted, np.zeros((1, weighted.shape[1]), dtype=weighted.dtype)])
    y = np.zeros((n, weighted.shape[1]), dtype=weighted.dtype)
    for low in range(0, n, TILES):
        for place in grid[:, low : low + TILES]:
            y[low : low + TILES] += padded[place]
    order = np.argsort(term.astype(np.uint16), kind="stable")
    ordered = term[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    size = np.diff(np.append(first, len(ordered)))
    falling = np.argsort(-size, kind="stable")
    first, size = first[falling], size[falling]
    sums = np.zeros((len(first), weighted.shape[1]), dtype=weighted.dtype)
    for k in range(min(ROUNDS, int(size[0]))):
        m = int(np.searchsorted(-size, -k))  # terms of more than k words
        sums[:m] += y[tile[order[first[:m] + k]]]
    for j in range(int(np.searchsorted(-size, -ROUNDS))):
        sums[j] += y[tile[order[first[j] + ROUNDS : first[j] + size[j]]]].sum(axis=0, dtype=float)
    total[ordered[first]] += sums


def passage_products(texts: DataFrame, weighted: np.ndarray) -> np.ndarray:
    """T'(T ``weighted``) for the counts T of terms in all passages of all texts."""
    width, rows = weighted.shape[1], 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((TERMS, width))
        for batch in batches:
            for part in K.slices(batch):
                w = K.words(part.column("text"), latin=True)
                tile, n = _tiles(w)
                add_products(_terms(w), tile, n, weighted, total)
        for k in range(TERMS // rows):
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([total[k * rows : (k + 1) * rows].tobytes()], pa.binary())], names=["block", "part"])

    def add(table: pa.Table) -> pa.Table:
        out = np.sum([np.frombuffer(x.as_buffer()) for x in table.column("part")], axis=0)
        return pa.table({"block": table.column("block")[:1], "part": pa.array([out.tobytes()], pa.binary())})

    found = texts.select("text").mapInArrow(run, "block long, part binary").groupBy("block").applyInArrow(add, "block long, part binary").collect()
    b = np.zeros((TERMS, width))
    for r in found:  # TERMS / 64 rows
        b[r["block"] * rows : (r["block"] + 1) * rows] = np.frombuffer(r["part"]).reshape(rows, width)
    return b


def latent_space(texts: DataFrame, seed: int = 11) -> Space:
    """Whitened projection onto the leading right singular vectors of the TF-IDF matrix of all passages."""
    idf = inverse_frequencies(texts)
    omega = np.random.Generator(np.random.PCG64(seed)).normal(size=(TERMS, RANK + SPARE))
    b = passage_products(texts, (idf[:, None] * omega).astype(np.float32))
    b *= idf[:, None]
    # A'A is about B (Omega'B)^-1 B'; its leading eigenvectors are those of F F' with F = B C^-1/2.
    values, vectors = np.linalg.eigh((omega.T @ b + b.T @ omega) / 2)
    good = values > max(values.max(initial=0), 0) * 1e-10
    if not good.any():
        return Space(np.zeros((TERMS, RANK), dtype=np.float32), idf)
    u, s, _ = np.linalg.svd(b @ (vectors[:, good] / np.sqrt(values[good])), full_matrices=False)
    u, s = u[:, :RANK], s[:RANK]
    return Space((idf[:, None] * u * np.where(s > s[0] * 1e-6, s[0] / np.maximum(s, 1e-12), 0)).astype(np.float32), idf)


def _places(a: list[int]) -> dict[int, int]:
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    return places


def common_subsequence(a: list[int], b: list[int], places: dict[int, int] | None = None) -> int:
    """Length of the longest common subsequence, a machine word or more of ``a`` at a time."""
    places = _places(a) if places is None else places
    row = (1 << len(a)) - 1
    full = row
    for x in b:
        m = places.get(x)
        if m is not None:
            u = row & m
            row = (row + u | row - u) & full
    return len(a) - row.bit_count()


def read_items(ids: list[int], texts: list[str]) -> list[Item]:
    """Items in order of id and text; null ids or texts, and texts without words, are none."""
    items = []
    for i, t in sorted((i, t) for i, t in zip(ids, texts, strict=True) if i is not None and t is not None):
        w = K.words(pa.array([t]), latin=True)
        hashes = w.hashes.tolist()
        if not hashes:
            continue
        stops = [k + 1 for k in range(len(hashes) - 1) if w.data[w.ends[k] - 1] in b".?!"]
        begin = stops[-1] if stops and len(hashes) - stops[-1] >= 3 else len(hashes) - -(-len(hashes) // 3)
        items.append(Item(i, hashes, hashes[begin:]))
    return items


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.sqrt(np.einsum("ij,ij->i", v, v)), 1e-6)[:, None]


@dataclass
class Index:
    """Items by their rarer words: ``items[first[i]:first[i + 1]]`` hold word ``words[i]``; ``needed[k]`` of them make a place of item k; ``member[k, t]``: it has a word of term t."""

    words: np.ndarray
    first: np.ndarray
    items: np.ndarray
    needed: np.ndarray
    sizes: np.ndarray
    around: np.ndarray
    scale: list[int]
    offsets: list[list[int]]
    vectors: list[np.ndarray]
    member: np.ndarray

    def windows(self) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each scale: vectors of the item windows, their items and offsets; items shorter than the least scale have none."""
        out = {}
        for scale in SCALES:
            of = [k for k, x in enumerate(self.scale) if x == scale]
            if of:
                lengths = [len(self.offsets[k]) for k in of]
                out[scale] = np.concatenate([self.vectors[k] for k in of]), np.repeat(of, lengths), np.concatenate([self.offsets[k] for k in of])
        return out


def item_index(items: list[Item], space: Space, least: float) -> Index:
    """A passage that covers ``least`` of an item's n words lacks at most n - ceil(least * n): of the n - ceil(least * n) + s rarest it holds s."""
    pairs, needed, scales, offsets, vectors = set(), [], [], [], []
    member = np.zeros((len(items), TERMS + 1), dtype=bool)
    for k, item in enumerate(items):
        n = len(item.words)
        terms = (np.array(item.words, dtype=np.uint64) >> np.uint64(52)).astype(np.int64)
        member[k, terms] = True
        covered = int(np.ceil(least * n - 1e-9))
        s = max(1, min(n // 5, covered))
        rare = np.argsort(-space.idf[terms], kind="stable")[: n - covered + s]
        pairs |= {(item.words[i], k) for i in rare.tolist()}
        needed.append(s)
        # Windows of the document begin every HOP words, so one is at most half of that from one of the item.
        scale = max([x for x in SCALES if x + HOP // 2 <= n] or [x for x in SCALES if x <= n], default=n)
        last = n - scale
        offsets.append(sorted({*range(0, last, max(scale // 4, 1)), last}))
        vectors.append(_unit(np.array([space.project[terms[at : at + scale]].sum(axis=0) for at in offsets[-1]])))
        scales.append(scale)
    words = np.array(sorted(pairs), dtype=np.uint64).reshape(-1, 2)
    keys, first = np.unique(words[:, 0], return_index=True)
    sizes = np.array([len(x.words) for x in items], dtype=np.int64)
    return Index(keys, np.append(first, len(words)), words[:, 1].astype(np.int64), np.array(needed, dtype=np.int64), sizes, np.maximum(4, sizes // 4), scales, offsets, vectors, member)


def places(w: K.Words, index: Index) -> list[tuple[int, int, int, int]]:
    """(text, item, first begin, last begin): where in the text, by place of its words, a passage of the item may begin."""
    if not len(index.words) or not len(w.hashes):
        return []
    at = np.minimum(np.searchsorted(index.words, w.hashes), len(index.words) - 1)
    hit = np.flatnonzero(index.words[at] == w.hashes)
    n = (index.first[1:] - index.first[:-1])[at[hit]]
    where = np.repeat(hit, n)
    item = index.items[np.repeat(index.first[at[hit]], n) + np.arange(len(where)) - np.repeat(np.cumsum(n) - n, n)]
    text = w.text_of[where]
    order = np.lexsort((where, text, item))
    where, item, text = where[order], item[order], text[order]
    ahead = np.arange(len(where)) + index.needed[item] - 1
    fits = ahead < len(where)
    ahead = np.minimum(ahead, max(len(where) - 1, 0))
    span = index.sizes[item] + 2 * index.around[item]
    close = np.flatnonzero(fits & (item[ahead] == item) & (text[ahead] == text) & (where[ahead] - where < span))
    out: list[tuple[int, int, int, int]] = []
    for i in close:
        k, d = int(item[i]), int(text[i])
        begin = int(w.bounds[d])
        low, high = int(where[ahead[i]]) - begin - int(index.sizes[k] + index.around[k]), int(where[i]) - begin + int(index.around[k])
        if out and out[-1][:2] == (d, k) and low <= out[-1][3] + 1:
            out[-1] = (d, k, out[-1][2], max(high, out[-1][3]))
        else:
            out.append((d, k, low, high))
    return out


def latent_hits(w: K.Words, index: Index, windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], project: np.ndarray, cosine: float, least: float) -> dict[tuple[int, int, int], float]:
    """(text, item, first word): cosine, for all windows of the texts that begin every ``HOP`` words and all item windows.

    Places with fewer words of the item's terms around than ``least`` of its words are left out: no common subsequence is longer.
    """
    hits: dict[tuple[int, int, int], float] = {}
    if not len(w.hashes) or not windows:
        return hits
    terms = np.append(w.hashes >> np.uint64(52), np.uint64(TERMS)).astype(np.int32)  # the last is no word and adds nothing
    member = index.member.ravel().view(np.uint8)
    project = np.concatenate([project, np.zeros((1, project.shape[1]), dtype=np.float32)])
    per = -(-w.counts // HOP)
    first = np.cumsum(per) - per
    text = np.repeat(np.arange(len(per)), per)
    begin = (np.arange(len(text)) - first[text]) * HOP
    starts, stops = w.bounds[text] + begin, w.bounds[text + 1]
    beyond = len(terms) - 1
    step, ahead = max(PRODUCT // max(len(x[0]) for x in windows.values()), 1), max(windows) // HOP - 1
    for low in range(0, len(text), step):
        high = min(low + step, len(text))
        far = min(high + ahead, len(text))
        tile = np.zeros((far - low, project.shape[1]), dtype=np.float32)
        for k in range(HOP):
            at = starts[low:far] + k
            tile += project[terms[np.where(at < stops[low:far], at, beyond)]]
        sums, tiles = tile[: high - low].copy(), 1
        for scale, (vectors, items, offsets) in sorted(windows.items()):
            for k in range(tiles, scale // HOP):
                n = min(high, len(text) - k) - low
                if n > 0:
                    sums[:n] += tile[k : k + n] * (text[low + k : low + k + n] == text[low : low + n])[:, None]
            tiles = scale // HOP
            near = (_unit(sums) @ vectors.T).ravel()
            found = np.flatnonzero(near >= cosine)
            for some in np.split(found, range(4096, len(found), 4096)):
                rows, columns = np.divmod(some, len(vectors))
                item = items[columns]
                at = begin[low + rows] - offsets[columns]
                begins = w.bounds[text[low + rows]]
                left = np.maximum(begins + at - index.around[item], begins)
                right = np.minimum(begins + at + index.sizes[item] + index.around[item], stops[low + rows])
                region = left[:, None] + np.arange(max(int((right - left).max(initial=0)), 0))
                held = member[terms[np.where(region < right[:, None], region, beyond)] + item[:, None] * (TERMS + 1)].sum(axis=1)
                for i in np.flatnonzero(held >= least * index.sizes[item] - 1e-9).tolist():
                    key = int(text[low + rows[i]]), int(item[i]), int(at[i])
                    hits[key] = max(hits.get(key, -1.0), float(near[some[i]]))
    return hits


def index_hits(w: K.Words, index: Index, project: np.ndarray, cosine: float) -> dict[tuple[int, int, int], float]:
    """The same for windows that begin at every word of the places that the index of rarer words names."""
    hits: dict[tuple[int, int, int], float] = {}
    for d, k, low, high in places(w, index):
        scale, n = index.scale[k], int(w.counts[d])
        begin = max(0, low)
        terms = (w.hashes[w.bounds[d] + begin : w.bounds[d] + min(n, high + int(index.sizes[k]) + scale)] >> np.uint64(52)).astype(np.int64)
        sums = np.concatenate([np.zeros((1, project.shape[1]), dtype=np.float32), np.cumsum(project[terms], axis=0)])
        # The last windows are shorter than the scale, so that a passage cut off by the text's end has some too.
        ends = np.minimum(np.arange(len(terms)) + scale, len(terms))
        cosines = _unit(sums[ends] - sums[: len(terms)]) @ index.vectors[k].T
        for row, column in zip(*np.nonzero(cosines >= cosine), strict=True):
            at = begin + int(row) - index.offsets[k][int(column)]
            if low <= at <= high:
                hits[d, k, at] = max(hits.get((d, k, at), -1.0), float(cosines[row, column]))
    return hits


@dataclass
class Rule:
    """Least values of a leak: of coverage alone, of coverage and answer, and of cosine, coverage and answer."""

    verbatim: float
    paraphrase: float
    answer: float
    latent: float
    reworded: float
    reworded_answer: float

    def holds(self, n: int, share: float, told: float, cos: float) -> bool:
        if share >= self.verbatim:
            return True
        return n >= 8 and (share >= self.paraphrase and told >= self.answer or cos >= self.latent and share >= self.reworded and told >= self.reworded_answer)


def write_items(benchmark: DataFrame, id_col: str, text_col: str, space: Space, least: float) -> tuple[str, list[str]]:
    """Items in files of about ``ITEM_BLOCK`` each, with their indexes, made by tasks; the folder and the files' names."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).where("i is not null and t is not null").distinct()
    blocks = max(1, -(-rows.count() // ITEM_BLOCK))
    folder = Scratch(benchmark.sparkSession, "items").path("index")

    def build(table: pa.Table) -> pa.Table:
        items = read_items(table.column("i").to_pylist(), table.column("t").to_pylist())
        name = f"block{table.column('block')[0].as_py()}"
        if items:
            mapped.put(folder, name, np.frombuffer(pickle.dumps((items, item_index(items, space, least))), dtype=np.uint8))
        return pa.table({"name": pa.array([name] if items else [], pa.string())})

    names = rows.withColumn("block", F.pmod(F.xxhash64("i", "t"), F.lit(blocks))).groupBy("block").applyInArrow(build, "name string").collect()  # a row for 2,048 items
    return folder, sorted(r["name"] for r in names)


@lru_cache(maxsize=2)
def _read_block(folder: str, name: str) -> tuple:
    items, index = pickle.loads(mapped.load(folder, name)[0].tobytes())
    return items, index, index.windows(), [(_places(x.words), _places(x.answer)) for x in items]


def _settle(w: K.Words, block: tuple, space: Space, cosine: float, rule: Rule) -> dict[tuple[int, int], tuple[int, int, float]]:
    """(text, item): common words, those of the answer, cosine, for the pairs that the rule takes."""
    items, index, windows, places_of = block
    near = latent_hits(w, index, windows, space.project, rule.latent, min(rule.verbatim, rule.paraphrase, rule.reworded))
    for key, cos in index_hits(w, index, space.project, cosine).items():
        near[key] = max(near.get(key, -1.0), cos)
    best: dict[tuple[int, int], tuple[int, int, float]] = {}
    last, around = None, index.around.tolist()
    for (d, item, begin), cos in sorted(near.items()):
        if d != last:
            words, last = w.hashes[w.bounds[d] : w.bounds[d + 1]].tolist(), d
        x = items[item]
        n = len(x.words)
        region = words[max(0, begin - around[item]) : max(0, begin + n + around[item])]
        common = common_subsequence(x.words, region, places_of[item][0])
        if common < min(rule.verbatim, rule.paraphrase, rule.reworded) * n:
            continue
        answered = common_subsequence(x.answer, region, places_of[item][1])
        if rule.holds(n, common / n, answered / len(x.answer), cos):
            best[d, item] = max(best.get((d, item), (0, 0, -1.0)), (common, answered, cos))
    return best


def _leaks(texts: DataFrame, folder: str, names: list[str], space: Space, cosine: float, rule: Rule) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in names:
                block = _read_block(folder, name)
                items = block[0]
                for part in K.slices(batch, limit=4 * K.SLICE_BYTES):
                    best = _settle(K.words(part.column("text"), latin=True), block, space, cosine, rule)
                    ids = part.column("id").to_pylist()
                    rows = [(ids[d], items[i].item_id, len(items[i].words), c, c / len(items[i].words), a / len(items[i].answer), cos) for (d, i), (c, a, cos) in sorted(best.items())]
                    columns = list(zip(*rows, strict=True)) or [[]] * 7
                    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "item_id", "item_words", "common_words", "coverage", "answer_coverage", "cosine"])

    return texts.mapInArrow(run, "doc_id long, item_id long, item_words long, common_words long, coverage double, answer_coverage double, cosine double")


def contaminated(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
    cosine: float = 0.4, verbatim: float = 0.8, paraphrase: float = 0.6, answer: float = 0.8, latent: float = 0.5, reworded: float = 0.5, reworded_answer: float = 0.4,
) -> DataFrame:
    """A row for each document and benchmark item that it contains, verbatim or reworded.

    Columns: doc_id, item_id, item_words, common_words (longest common subsequence with the
    item), coverage, answer_coverage, cosine. A row needs coverage of at least ``verbatim``; or
    of ``paraphrase`` together with ``answer`` of the item's answer; or a cosine of ``latent``
    with coverage of ``reworded`` and ``reworded_answer`` of the answer. Candidates are not
    capped. The latent search leaves out items of fewer than eight words, for which the first rule
    alone holds.

    Latin letters match whatever their case. Null or empty texts and items match nothing, and so do
    items without an id; documents without an id are searched and their rows have a null doc_id.
    Repeated documents, and rows that share an id, are searched each; repeated rows of the benchmark
    count once, equal texts under several ids match separately. Of equally good places in a document
    the nearest in the latent space is reported. Long texts are searched whole, in blocks. Only the
    named columns are read, so further ones may have any name. Items are written to files of about
    2,048, which tasks read in turn for each batch of documents: one pass over the corpus whatever
    the benchmark's size, and neither reaches one task or the driver whole.
    """
    texts = _texts(docs, id_col, text_col)
    space = latent_space(texts)
    folder, names = write_items(benchmark, item_id_col, item_text_col, space, min(verbatim, paraphrase))
    return _leaks(texts, folder, names, space, cosine, Rule(verbatim, paraphrase, answer, latent, reworded, reworded_answer))
