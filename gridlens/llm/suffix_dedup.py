"""Removal of long repeated byte strings, by column-wise construction of suffix orders.

Which strings can repeat at all is settled first. Of all fingerprints (hashes of ``GRAM`` bytes) inside a string of
``length`` bytes one is its leading one: the least, the leftmost of equals. It depends on the string alone, so equal
strings have equal leading fingerprints. Neighbouring strings mostly share theirs, and such a run of starts, from the
first byte of its first string to the last of its last, is a snippet. Snippets whose fingerprint occurs once in the
corpus hold no repeat. Equal snippets under one fingerprint are one, its earliest occurrence; all strings of the others
started there before. A fingerprint that very many snippets have is not used: their strings are snippets of their own.

What is left, snippets that share a fingerprint and differ, are short documents of a collection whose suffixes are put
in order column by column: each round inserts one symbol of every document, from the last column to the first, into
the collection's Burrows-Wheeler transform, at the place that the symbol's rank so far gives, and common prefixes with
both neighbours follow from the least value between two equal symbols. Suffixes that stand together with common
prefixes of ``length`` or more begin with the same string, of which the earliest start stays.

Texts lie in files of a megabyte or so, the pieces, which are written once. A pass over a piece sends sorted hashes to their ranges
of the hash space; the answers go back to a file for each piece, in the order in which it asked. So no pass shuffles
texts, a task reads its own answers only, and a piece or a range that is lost is computed again alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlens.llm import kernels as K
from gridlens.llm import mapped
from gridlens.llm.kneser_ney import pack, unpack
from gridlens.llm.shared import Scratch

_U = np.uint64
#: Bytes of a fingerprint, of a piece, starts worked through at a time, snippets from which a fingerprint is no longer used,
#: fingerprints of a range, snippets of a collection, pieces of a task.
GRAM, PIECE, STRETCH, CROWD, RANGE, COLLECTION, DEALT = 50, 1 << 20, (1 << 18) - 1024, 2048, 250_000, 1_000, 8


# Column-wise construction.


def suffix_order(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(transform, common prefixes with the suffix before, document, start) of all suffixes of a collection, in order.

    A document ends with a mark that is less than all symbols; marks are ordered as the documents. Symbols are the
    collection's bytes numbered from 1 in order; marks and the places before a document's first symbol are 0.
    """
    n = len(texts)
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    most = int(lengths.max(initial=0))
    used = np.unique(np.frombuffer(b"".join(texts), np.uint8))
    number = np.zeros(256, dtype=np.uint8 if len(used) < 256 else np.uint16)
    number[used] = np.arange(1, len(used) + 1)
    # Column k holds the symbol k places before the end; documents that have run out hold 0.
    columns = np.zeros((most + 1, n), dtype=number.dtype)
    for d, t in enumerate(texts):
        columns[: len(t), d] = number[np.frombuffer(t, np.uint8)[::-1]]
    # Round 0: the suffixes that are marks alone. What stands before them is the last symbol.
    bwt, lcp = columns[0].copy(), np.zeros(n, dtype=np.int32)
    suffix = np.arange(n, dtype=np.int32 if (most + 1) * n < 2**31 else np.int64)  # column * n + document
    numbers = np.arange(int(lengths.sum()) + n, dtype=np.int32 if lengths.sum() + n < 2**31 else np.int64)
    place, live = np.arange(n), np.arange(n)  # of each document's latest suffix
    for k in range(1, most + 1):
        going = lengths[live] >= k
        live, place = live[going], place[going]
        symbol = columns[k - 1, live]
        # A stable sort of the transform ranks every symbol among its equals; marks stand first and stay where they are.
        order = np.argsort(bwt, kind="stable")
        rank = np.empty(len(bwt), dtype=numbers.dtype)
        rank[order] = numbers[: len(bwt)]
        here = rank[place].astype(np.int64)
        # The new suffixes' places among all suffixes there will be: first the n marks, then every symbol's.
        new = here + (n - np.count_nonzero(bwt == 0))
        # Common prefixes: with the next equal symbol on a side, one more than the least value between the two.
        before, after = order[np.maximum(here - 1, 0)], order[np.minimum(here + 1, len(order) - 1)]
        pair = (here > 0) & (bwt[before] == symbol)
        common = np.zeros(len(live), dtype=np.int32)
        common[pair] = 1 + _least(lcp, before[pair] + 1, place[pair] + 1)
        pair = (here + 1 < len(order)) & (bwt[after] == symbol)
        following = np.zeros(len(live), dtype=np.int32)
        following[pair] = 1 + _least(lcp, place[pair] + 1, after[pair] + 1)
        total = len(bwt) + len(new)
        old = np.ones(total, dtype=bool)
        old[new] = False
        out_bwt, out_lcp, out_suffix = (np.empty(total, dtype=x.dtype) for x in (bwt, lcp, suffix))
        out_bwt[old], out_lcp[old], out_suffix[old] = bwt, lcp, suffix
        out_bwt[new], out_lcp[new], out_suffix[new] = columns[k, live], common, live + k * n
        # An old suffix that comes to stand behind a new one has it as its neighbour now; a new one has its own value.
        behind = np.minimum(new + 1, total - 1)
        settle = (new + 1 < total) & old[behind]
        out_lcp[behind[settle]] = following[settle]
        bwt, lcp, suffix, place = out_bwt, out_lcp, out_suffix, new
    column, doc = np.divmod(suffix, max(1, n))
    return bwt, lcp, doc, lengths[doc] - column


def _least(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least value of each stretch low:high, none of them empty."""
    if not len(low):
        return np.zeros(0, values.dtype)
    return np.minimum.reduceat(np.append(values, values[-1:]), np.stack([low, high], axis=1).ravel())[::2]


def later_strings(texts: list[bytes], rows: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, start) of all strings of ``length`` bytes that another document, or the same one, has at an earlier place (row, at + start)."""
    _, lcp, doc, start = suffix_order(texts)
    kind = np.cumsum(lcp < length)
    whole = start + length <= np.array([len(t) for t in texts], dtype=np.int64)[doc]
    kind, doc, start = kind[whole], doc[whole], start[whole]
    order = np.lexsort((at[doc] + start, rows[doc], kind))
    kind, doc, start = kind[order], doc[order], start[order]
    late = np.concatenate([[False], kind[1:] == kind[:-1]]) if len(kind) else np.zeros(0, bool)
    return doc[late], start[late]


# Fingerprints.


def _whole(bounds: np.ndarray, length: int) -> np.ndarray:
    """Places of a piece at which a string of ``length`` bytes of one document begins."""
    turns = np.zeros(int(bounds[-1]) + 1, dtype=np.int8)
    long_enough = np.diff(bounds) >= length
    np.add.at(turns, bounds[:-1][long_enough], 1)
    np.add.at(turns, bounds[1:][long_enough] - length + 1, -1)
    return np.cumsum(turns[:-1], dtype=np.int8).astype(bool)


def _sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = K._power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=_U)
    np.cumsum(K._BYTE_CODE[data] * up[: len(data)], out=sums[1:])
    return sums, down


def _hash(sums: np.ndarray, down: np.ndarray, low: np.ndarray, high: np.ndarray, salt: int = 0) -> np.ndarray:
    return K.mix((sums[high] - sums[low]) * down[low] + _U(salt))


def snippets(data: np.ndarray, bounds: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first start, last start, fingerprint, hash of all bytes) of the snippets of a piece, in order."""
    whole, parts = _whole(bounds, length), ([], [], [], [])
    for a in range(0, max(0, len(data) - length + 1), STRETCH):
        part = data[a : a + STRETCH + length - 1]
        sums, down = _sums(part)
        n = len(part) - gram + 1
        print_ = K.mix((sums[gram:] - sums[:-gram]) * down[:n])
        # The low bits hold the place, so that of equal fingerprints (but for these bits) the leftmost leads.
        least = (print_ & _U(~0xFFFFF & 2**64 - 1)) | np.arange(n, dtype=_U)
        width, done = length - gram + 1, 1
        while 2 * done <= width:
            least = np.minimum(least[:-done], least[done:])
            done *= 2
        if done < width:
            least = np.minimum(least[: done - width], least[width - done :])
        lead, here = (least & _U(0xFFFFF)).astype(np.int64), whole[a : a + len(least)]
        cuts = np.flatnonzero(np.concatenate([[True], (lead[1:] != lead[:-1]) | (here[1:] != here[:-1])]))
        ends = np.append(cuts[1:], len(lead)) - 1
        held = here[cuts]
        low, high = cuts[held], ends[held]
        for out, x in zip(parts, (low + a, high + a, print_[lead[low]], _hash(sums, down, low, high + length, 0x5851F42D)), strict=True):
            out.append(x)
    return tuple(np.concatenate(x) if x else np.zeros(0, t) for x, t in zip(parts, (np.int64, np.int64, _U, _U), strict=True))  # type: ignore[return-value]


def single_strings(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the strings at sorted starts."""
    first, second = np.empty(len(starts), _U), np.empty(len(starts), _U)
    for a in range(0, len(data), STRETCH):
        i, j = np.searchsorted(starts, [a, a + STRETCH])
        if i < j:
            sums, down = _sums(data[a : a + STRETCH + length - 1])
            low = starts[i:j] - a
            first[i:j] = _hash(sums, down, low, low + length, 0x14057B7E)
            mid = low + length // 2
            second[i:j] = K.mix(_hash(sums, down, low, mid) * _U(0xD6E8FEB86659FD93) + _hash(sums, down, mid, low + length))
    return first, second


def _unrolled(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All starts from low to high of each row, one after the other."""
    n = high - low + 1
    return np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


# Exchanges between pieces and ranges of the hash space.

_ASKED, _ANSWER = "bucket int, piece long, data binary", "piece long, bucket int, data binary"


def _halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = np.ascontiguousarray(x).view(_U)
    return (x >> _U(32)).astype(np.int64), (x & _U(0xFFFFFFFF)).astype(np.int64)


def _joined(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return (high.astype(_U) << _U(32)) | low.astype(_U)


def _ask(piece: int, bits: int, keys: np.ndarray, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows by range for sorted keys."""
    bucket = (keys >> _U(64 - bits)).astype(np.int64)
    cuts = np.append(np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])), len(keys)) if len(keys) else np.zeros(1, np.int64)
    inner = (keys & _U(2 ** (64 - bits) - 1)).astype(np.int64)
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        yield pa.RecordBatch.from_arrays([pa.array([int(bucket[i])], pa.int32()), pa.array([piece], pa.int64()), pa.array([pack(inner[i:j], *(c[i:j] for c in columns))], pa.binary())], names=["bucket", "piece", "data"])


def _gathered(t: pa.Table) -> tuple[list[np.ndarray], np.ndarray]:
    """All columns of a range's rows one after the other, and the bounds of the rows."""
    parts = [unpack(x) for x in t.column("data")]
    return [np.concatenate(c) for c in zip(*parts, strict=True)], np.cumsum([0, *(len(p[0]) for p in parts)])


def _answer(t: pa.Table, bounds: np.ndarray, answers: np.ndarray) -> pa.Table:
    data = [answers[i:j].astype(np.uint8).tobytes() for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
    return pa.table({"piece": t.column("piece"), "bucket": t.column("bucket"), "data": pa.array(data, pa.binary())})


#: Answers to fingerprints, and to snippets.
ONCE, SEVERAL, CROWDED = 0, 1, 2
ALONE, LATER, DIFFER = 0, 1, 2


def _count(t: pa.Table, crowd: int) -> pa.Table:
    (keys, again, kinds), bounds = _gathered(t)
    _, back = np.unique(keys, return_inverse=True)
    times, differing = np.bincount(back, weights=again), np.bincount(back, weights=kinds)
    return _answer(t, bounds, np.where(times[back] < 2, ONCE, np.where(differing[back] > crowd, CROWDED, SEVERAL)))


def _earliest(t: pa.Table) -> pa.Table:
    (keys, a, b, c, d, at), bounds = _gathered(t)
    content, row = _joined(a, b), _joined(c, d).view(np.int64)
    order = np.lexsort((at, row, content, keys))
    k, s = keys[order], content[order]
    new_key = np.concatenate([[True], k[1:] != k[:-1]])
    new = new_key | np.concatenate([[True], s[1:] != s[:-1]])
    key_of = np.cumsum(new_key) - 1
    several = np.bincount(key_of, weights=new)[key_of] > 1
    out = np.empty(len(keys), dtype=np.uint8)
    out[order] = np.where(~new, LATER, np.where(several, DIFFER, ALONE))
    return _answer(t, bounds, out)


def _first_of(keys: np.ndarray, content: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of the first occurrences, sorted by (key, content); for every row the number of its distinct pair)."""
    order = np.lexsort((content, keys))
    k, s = keys[order], content[order]
    new = np.concatenate([[True], (k[1:] != k[:-1]) | (s[1:] != s[:-1])]) if len(k) else np.zeros(0, bool)
    number = np.empty(len(keys), dtype=np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


class Piece:
    """Texts of one file of the shared store, one after the other."""

    def __init__(self, folder: str, number: int):
        rows, ids, known, bounds, packed = mapped.load(folder, f"piece-{number}")
        self.number, self.rows, self.bounds = number, rows.view(np.int64), bounds.astype(np.int64)
        self.ids = pa.array(ids.view(np.int64), mask=known == 0)
        size = int(self.bounds[-1])
        self.data = np.frombuffer(pa.decompress(packed.tobytes(), decompressed_size=size, codec="zstd"), np.uint8) if size else np.zeros(0, np.uint8)

    def row_at(self, at: np.ndarray) -> np.ndarray:
        return self.rows[np.searchsorted(self.bounds, at, "right") - 1]


def _put_piece(folder: str, number: int, held: list[tuple[int, int | None, bytes]]) -> pa.RecordBatch:
    held.sort(key=lambda r: r[0])
    data = b"".join(r[2] for r in held)
    bounds = np.cumsum([0, *(len(r[2]) for r in held)])
    ids = np.array([r[1] or 0 for r in held], dtype=np.int64)
    packed = np.frombuffer(pa.compress(data, codec="zstd", asbytes=True), np.uint8) if data else np.zeros(0, np.uint8)
    mapped.put(folder, f"piece-{number}", np.array([r[0] for r in held], dtype=np.int64).view(_U), ids.view(_U), np.array([r[1] is not None for r in held], dtype=np.uint8), mapped.narrow(bounds), packed)
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([len(data)], pa.int64())], names=["piece", "size"])


def _pieces(docs: DataFrame, folder: str, id_col: str, text_col: str, size: int) -> DataFrame:
    """Write the files of pieces; (piece, size)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string").cast("binary"), F.lit(b"")).alias("text"))
    if rows.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        rows = rows.withColumn("row", F.col("doc_id"))
    else:  # ids don't tell the rows apart: their places in the order of id and text do
        rows = rows.sort(F.asc_nulls_last("doc_id"), "text").withColumn("row", F.monotonically_increasing_id())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, total = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for r in zip(*(batch.column(c) for c in ("row", "doc_id", "text")), strict=True):
                held.append(tuple(x.as_py() for x in r))
                total += len(held[-1][2])
                if total >= size:
                    yield _put_piece(folder, number, held)
                    number, held, total = number + 1, [], 0
        if held:
            yield _put_piece(folder, number, held)

    return rows.mapInArrow(cut, "piece long, size long")


_OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def suffix_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 100, gram: int = GRAM, piece: int = PIECE, crowd: int = CROWD, keep_bytes: bool = False, scratch: Scratch | None = None) -> DataFrame:
    """Every row with what is left of its bytes once all strings of ``length`` bytes that also start earlier are removed.

    Earlier means in a document of a smaller id, or before in the same document; all strings are judged on the input.
    Null and empty texts have no bytes. Ids that are null come after all others; rows that share an id are
    ordered by their texts, so of repeated rows one, the first, keeps its text and the others are later copies.
    Texts count as their UTF-8 bytes and are worked through in stretches of a quarter of a megabyte, a long one is a piece of its
    own and takes about 30 bytes a byte. An empty table gives an empty result. Other columns are not looked at,
    whatever their names. ``keep_bytes`` adds the bytes left and the removed spans (start and end, in bytes).
    Strings under one fingerprint are told apart by a second 64-bit hash of all their bytes before they are compared.
    """
    scratch = scratch or Scratch(docs.sparkSession, "suffix-dedup")
    folder = scratch.path("files")
    pieces = scratch.write(_pieces(docs, folder, id_col, text_col, piece), "pieces")
    n_pieces, total = pieces.select(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    pieces = pieces.repartition(max(1, -(-n_pieces // DEALT)), "piece")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[Piece]:
        for batch in batches:
            for number in batch.column("piece").to_pylist():
                yield Piece(folder, number)

    bits = max(1, int(np.ceil(np.log2(max(2, 2 * total / (length - gram + 2) / RANGE)))))

    def send_back(asked: DataFrame, answer, stage: str) -> DataFrame:  # noqa: ANN001
        def store(t: pa.Table) -> pa.Table:
            t, number = t.sort_by("bucket"), t.column("piece")[0].as_py()
            values = np.frombuffer(b"".join(t.column("data").to_pylist()), np.uint8)
            mapped.put(folder, f"{stage}-{number}", values)
            return pa.table({"piece": pa.array([number], pa.int64()), "open": pa.array([int((values == DIFFER).sum())], pa.int64())})

        return scratch.write(asked.groupBy("bucket").applyInArrow(answer, _ANSWER).groupBy("piece").applyInArrow(store, "piece long, open long"), stage)

    def ask_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in each(batches):
            _, _, keys, content = snippets(p.data, p.bounds, length, gram)
            first, number = _first_of(keys, content)
            distinct, of = np.unique(keys[first], return_inverse=True)
            times = np.bincount(of, weights=np.bincount(number, minlength=len(first)), minlength=len(distinct)).astype(np.int64)
            yield from _ask(p.number, bits, distinct, np.minimum(times, 2), np.bincount(of, minlength=len(distinct)))

    send_back(pieces.mapInArrow(ask_prints, _ASKED), lambda t: _count(t, crowd), "prints")

    def ask_snippets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in each(batches):
            low, high, keys, content = snippets(p.data, p.bounds, length, gram)
            if len(keys):
                distinct, of = np.unique(keys, return_inverse=True)
                kind = mapped.load(folder, f"prints-{p.number}")[0][of]
                starts = _unrolled(low[kind == CROWDED], high[kind == CROWDED])
                singles = single_strings(p.data, starts, length)
                held = kind == SEVERAL
                low, high = np.concatenate([low[held], starts]), np.concatenate([high[held], starts])
                keys, content = np.concatenate([keys[held], singles[0]]), np.concatenate([content[held], singles[1]])
                by = np.argsort(low, kind="stable")
                low, high, keys, content = low[by], high[by], keys[by], content[by]
            first, number = _first_of(keys, content)
            leads = np.zeros(len(low), dtype=np.uint8)
            leads[first] = 1
            mapped.put(folder, f"runs-{p.number}", mapped.narrow(low), mapped.narrow(high - low), mapped.narrow(number), leads)
            yield from _ask(p.number, bits, keys[first], *_halves(content[first]), *_halves(p.row_at(low[first])), low[first])

    differ = send_back(pieces.mapInArrow(ask_snippets, _ASKED), _earliest, "snippets")
    n_open = differ.select(F.sum("open")).first()[0] or 0

    def settled(number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first start, last start, answer, whether it is the first of its kind in the piece) of each snippet that occurs again."""
        low, extra, kind, leads = mapped.load(folder, f"runs-{number}")
        low = low.astype(np.int64)
        if not len(low):
            return low, low, low, low
        return low, low + extra.astype(np.int64), mapped.load(folder, f"snippets-{number}")[0][kind.astype(np.int64)], leads

    def differing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["print", "row", "at", "piece", "text"]
        for p in each(batches):
            low, high, answer, leads = settled(p.number)
            at = np.flatnonzero((answer == DIFFER) & (leads == 1))
            if not len(at):
                continue
            low, high = low[at], high[at] + length
            # The fingerprint again, of the few snippets that are left: the least of its grams.
            keys = np.array([_lead(p.data[i:j], length, gram) for i, j in zip(low, high, strict=True)], dtype=np.int64)
            texts = pa.array([p.data[i:j].tobytes() for i, j in zip(low, high, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(p.row_at(low)), pa.array(low), pa.array(np.full(len(low), p.number)), texts], names=names)

    def order_collection(t: pa.Table) -> pa.Table:
        rows, at, numbers = (t.column(c).to_numpy() for c in ("row", "at", "piece"))
        doc, start = later_strings(t.column("text").to_pylist(), rows, at, length)
        held, of = np.unique(numbers, return_inverse=True)
        late = at[doc] + start
        return pa.table({"piece": pa.array(held), "starts": pa.array([late[of[doc] == k].astype(np.int64).tobytes() for k in range(len(held))], pa.binary())})

    def store_late(t: pa.Table) -> pa.Table:
        number = t.column("piece")[0].as_py()
        starts = np.frombuffer(b"".join(t.column("starts").to_pylist()), np.int64)
        mapped.put(folder, f"late-{number}", starts.astype(_U))
        return pa.table({"piece": pa.array([number], pa.int64()), "late": pa.array([len(starts)], pa.int64())})

    collections = max(1, -(-n_open // COLLECTION))
    sent = pieces.mapInArrow(differing, "print long, row long, at long, piece long, text binary")
    late = sent.groupBy(F.pmod(F.xxhash64("print"), F.lit(collections)).alias("collection")).applyInArrow(order_collection, "piece long, starts binary")
    scratch.write(late.groupBy("piece").applyInArrow(store_late, "piece long, late long"), "late")

    names = [f.split()[0] for f in _OUT.split(", ")] + ["kept", "spans"] * keep_bytes

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in each(batches):
            low, high, answer, leads = settled(p.number)
            gone = (answer == LATER) | (leads == 0)
            turns = np.zeros(len(p.data) + 1, dtype=np.int32)
            np.add.at(turns, low[gone], 1)
            np.add.at(turns, high[gone] + length, -1)
            if np.any((answer == DIFFER) & (leads == 1)):
                starts = mapped.load(folder, f"late-{p.number}")[0].astype(np.int64)
                np.add.at(turns, starts, 1)
                np.add.at(turns, starts + length, -1)
            removed = np.cumsum(turns[:-1]) > 0
            edge = removed.copy()
            edge[1:] &= ~removed[:-1]
            inner = p.bounds[:-1][p.bounds[:-1] < len(p.data)]
            edge[inner] = removed[inner]
            before, spans = (np.concatenate([[0], np.cumsum(x)]) for x in (removed, edge))
            kept = p.data[~removed].tobytes()
            cuts = p.bounds - before[p.bounds]
            left = [kept[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
            columns = [p.ids, *(pa.array(np.diff(x).astype(np.int64)) for x in (p.bounds, before[p.bounds], spans[p.bounds])), pa.array([hashlib.sha256(x).hexdigest() for x in left], pa.string())]
            if keep_bytes:
                first = np.flatnonzero(edge)
                last = np.flatnonzero(removed & np.append(edge[1:] | ~removed[1:], True)) + 1 if len(removed) else first
                of = np.searchsorted(p.bounds, first, "right") - 1
                pairs = [[] for _ in range(len(p.ids))]
                for d, i, j in zip(of, first - p.bounds[of], last - p.bounds[of], strict=True):
                    pairs[d].append([int(i), int(j)])
                columns += [pa.array(left, pa.binary()), pa.array(pairs, pa.list_(pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return pieces.mapInArrow(remove, _OUT + ", kept binary, spans array<array<long>>" * keep_bytes)


def _lead(snippet: np.ndarray, length: int, gram: int) -> int:
    """The leading fingerprint that all strings of a snippet share, as a signed integer."""
    sums, down = _sums(snippet[:length])
    n = length - gram + 1
    prints = K.mix((sums[gram : length + 1] - sums[:n]) * down[:n])
    return int(prints[np.argmin(prints & _U(~0xFFFFF & 2**64 - 1))].view(np.int64))


SQL = """
WITH bytes AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
starts AS (SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS s FROM (SELECT doc_id, h, unnest(range(0, CAST(length(h) / 2 AS BIGINT) - 99)) AS i FROM bytes)),
later AS (SELECT doc_id, i FROM starts QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1),
marked AS (SELECT doc_id, i, i + 100 AS upto, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i), 1000) > 100 AS fresh FROM later),
spans AS (
  SELECT doc_id, min(i) AS low, max(upto) AS high
  FROM (SELECT *, count(*) FILTER (WHERE fresh) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM marked) GROUP BY doc_id, span),
placed AS (SELECT *, coalesce(lag(high) OVER (PARTITION BY doc_id ORDER BY low), 0) AS since FROM spans),
parts AS (
  SELECT doc_id, count(*) AS n_spans, sum(high - low) AS n_removed, max(high) AS upto,
         string_agg(substr(h, 2 * since + 1, 2 * (low - since)), '' ORDER BY low) AS held
  FROM placed JOIN bytes USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(h) / 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(held || substr(h, 2 * upto + 1), h))) AS kept_sha256
FROM bytes LEFT JOIN parts USING (doc_id)
"""
