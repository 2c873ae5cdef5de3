"""Two tokenizers side by side: groups of tokens over the same bytes, and how often their tokens overlap.

A text is cut before every blank that follows an ASCII letter, digit or mark and precedes one (or a non-ASCII byte).
Neither tokenizer has a token across such a place, and neither looks beyond it: the byte-level tokenizer's pattern
takes a blank only as the first character of a word, the piece model has no piece with a blank inside. So both encode
these units one by one; a worker encodes a unit once and looks it up afterwards. Tests hold this against whole texts.

Counting takes two passes. The first aligns every document and adds up, in each task, how many of its documents hold a
pair of ids linked. Pairs are dealt to shards by their A id, so that an A id's highest count is known in its shard. A
tree of unions gives each shard's distinct pairs, for which a minimal perfect hash is built: levels of bit arrays, each
of which places the keys that have a bit to themselves and hands on the others; a key's index is its bit's rank, and the
key itself lies at that index, so that a pair which isn't in the corpus is told apart. A second tree sums dense vectors
of counts, indexed by that hash. The second pass aligns the documents again and looks their pairs up in the
memory-mapped arrays.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlens.llm import kernels as K
from gridlens.llm import mapped
from gridlens.llm.kneser_ney import pack, unpack
from gridlens.llm.shared import Scratch

_U = np.uint64
#: Where the vocabulary files lie on every worker, shards of pairs, children of a node in the trees, pairs that a worker holds, bytes of text aligned at a time.
VOCABULARIES, SHARDS, FAN_IN, HELD, SLICE = "/opt/tokenizers", 64, 16, 1_000_000, 1 << 21
#: Fixed: the byte-level tokenizer's own pattern of words.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for the code points from 256 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Tokenizers:
    """Both tokenizers, and the bytes of their tokens one after the other."""

    def __init__(self, folder: str):
        import sentencepiece
        from tokenizers import Tokenizer

        path = f"{folder}/byte_bpe_50k.json"
        self.a = Tokenizer.from_file(path)
        self.a.encode_special_tokens = True
        alphabet = byte_alphabet()
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        by_id = {i: bytes(alphabet[c] for c in s) if all(c in alphabet for c in s) else s.encode() for s, i in vocabulary.items()}
        self.a_bytes = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        self.b = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/piece_bpe_32k.model")
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        self.fast_a = self._ranks(folder)
        # For the groups as text: every id with each mark that can follow it.
        n = max(len(self.a_bytes), len(self.b_bytes))
        self.named = pa.array([f"{i}{mark}" for mark in ",|;" for i in range(n)], pa.large_string())
        self.n_named = n

    def _ranks(self, folder: str):  # noqa: ANN202
        """The same byte-level vocabulary in the library that is faster on long strings."""
        import base64

        import tiktoken

        with open(f"{folder}/byte_bpe_50k.tiktoken", "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        return tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(A ids, how many each unit has, B ids, how many each unit has); a unit begins with a blank, which the piece model puts there by itself."""
        lengths, n = np.diff(offsets), len(offsets) - 1
        first, last = offsets[:-1], offsets[1:] - 1
        # Units that begin and end as those inside a text do are encoded in one go and cut at their ends.
        plain = (lengths > 1) & _GRAPHIC[data[last]] & _FOLLOWS[data[np.minimum(first + 1, last)]]
        ids = np.array(self.fast_a(data[np.repeat(plain, lengths)].tobytes().decode()), dtype=np.int64)
        cuts = np.searchsorted(np.cumsum(self.a_sizes[ids]), np.cumsum(lengths[plain]), "right")
        n_a = np.zeros(n, dtype=np.int64)
        n_a[plain] = np.diff(cuts, prepend=0)
        odd = np.flatnonzero(~plain)
        if len(odd):
            parts = [self.fast_a(data[offsets[k] : offsets[k + 1]].tobytes().decode()) for k in odd]
            where = np.concatenate([[0], cuts])[np.searchsorted(np.flatnonzero(plain), odd)]
            n_a[odd] = [len(x) for x in parts]
            ids = np.insert(ids, np.repeat(where, n_a[odd]), np.array([i for x in parts for i in x], dtype=np.int64))
        rest = np.ones(len(data), dtype=bool)
        rest[first] = False
        texts = pa.LargeStringArray.from_buffers(n, pa.py_buffer((offsets - np.arange(n + 1)).astype(np.int64)), pa.py_buffer(data[rest]))
        found = self.b.encode(texts.to_pylist(), num_threads=1)
        n_b = np.fromiter(map(len, found), np.int64, n)
        return ids, n_a, np.fromiter(chain.from_iterable(found), np.int64, int(n_b.sum())), n_b

    @cached_property
    def a_sizes(self) -> np.ndarray:
        return np.array([len(x) for x in self.a_bytes], dtype=np.int64)

    @cached_property
    def b_sizes(self) -> np.ndarray:
        return np.array([len(x) for x in self.b_bytes], dtype=np.int64)

    @cached_property
    def flat(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of all A tokens and where each begins; the same for B."""
        return tuple(x for tokens, sizes in ((self.a_bytes, self.a_sizes), (self.b_bytes, self.b_sizes)) for x in (np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(sizes) - sizes))  # type: ignore[return-value]


@lru_cache(maxsize=1)
def tokenizers(folder: str) -> Tokenizers:
    return Tokenizers(folder)


def _distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; quick where there are few sorted runs."""
    x = np.sort(x, kind="stable")
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def _spread(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places starts[k], starts[k] + 1, ... of each row, one after the other."""
    return np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _gives_back(ids: np.ndarray, n: np.ndarray, sizes: np.ndarray, flat: np.ndarray, begins: np.ndarray, data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which units have the bytes of their tokens."""
    unit = np.repeat(np.arange(len(n)), n)
    same = np.bincount(unit, weights=sizes[ids], minlength=len(n)).astype(np.int64) == lengths
    keep = same[unit]
    bytes_ = flat[_spread(begins[ids[keep]], sizes[ids[keep]])]
    ends = np.cumsum(lengths)
    mine = data[_spread((ends - lengths)[same], lengths[same])]
    wrong = np.unique(np.repeat(np.flatnonzero(same), lengths[same])[bytes_ != mine])
    same[wrong] = False
    return same


class Aligned:
    """The units of some texts: which each text has, and for each distinct one its tokens, links and groups under both tokenizers.

    A link is A id << 32 | B id. Every stretch between two neighbouring token ends, of either tokenizer, lies in one
    token of each, and two tokens that overlap share one such stretch: so the stretches are the links. A group ends where
    both tokenizers have an end.
    """

    def __init__(self, t: Tokenizers, texts: pa.Array):
        kinds, self.back, self.bounds = cut(texts)
        data, offsets = K.raw_bytes(kinds)
        lengths = np.diff(offsets)
        a, n_a, b, n_b = t.encode(data, offsets)
        flat_a, begins_a, flat_b, begins_b = t.flat
        self.sound = _gives_back(a, n_a, t.a_sizes, flat_a, begins_a, data, lengths) & _gives_back(b, n_b, t.b_sizes, flat_b, begins_b, data, lengths)
        a, b = a[np.repeat(self.sound, n_a)], b[np.repeat(self.sound, n_b)]
        self.n_a, self.n_b = n_a * self.sound, n_b * self.sound
        ends_a, ends_b = np.cumsum(t.a_sizes[a]), np.cumsum(t.b_sizes[b])
        ends = _distinct(np.concatenate([ends_a, ends_b]))
        at_a, at_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        self.links = (a[at_a].astype(_U) << _U(32)) | b[at_b].astype(_U)
        group_end = (ends_a[at_a] == ends) & (ends_b[at_b] == ends)
        last = np.cumsum(lengths * self.sound)
        link_cuts = np.searchsorted(ends, last, "right")
        self.n_links = np.diff(link_cuts, prepend=0)
        groups = np.concatenate([[0], np.cumsum(group_end)])
        self.n_groups = np.diff(groups[link_cuts], prepend=0)
        self._parts = (a, b, ends_a, ends_b, ends[group_end])
        empty = pc.equal(pc.fill_null(pc.binary_length(texts), 0), 0).to_numpy(zero_copy_only=False)
        bad = np.concatenate([[0], np.cumsum(~self.sound[self.back])])
        #: Texts that have tokens: not empty, and both tokenizers give their bytes back.
        self.has_tokens = (bad[self.bounds[1:]] == bad[self.bounds[:-1]]) & ~empty

    def by_text(self, per_unit: np.ndarray) -> np.ndarray:
        """Sums over the units of each text; 0 for texts without tokens."""
        sums = np.concatenate([[0], np.cumsum(per_unit[self.back], dtype=np.int64)])
        return np.where(self.has_tokens, sums[self.bounds[1:]] - sums[self.bounds[:-1]], 0)

    def by_unit(self, per_link: np.ndarray) -> np.ndarray:
        sums, cuts = np.concatenate([[0], np.cumsum(per_link, dtype=np.int64)]), np.cumsum(self.n_links)
        return sums[cuts] - sums[cuts - self.n_links]

    def groups(self, t: Tokenizers) -> list[bytes]:
        """The groups of each text as a1,a2|b1;a3|b2,b3."""
        a, b, ends_a, ends_b, ends = self._parts
        of_a, of_b = np.searchsorted(ends, ends_a), np.searchsorted(ends, ends_b)
        n = len(ends)
        before_a, before_b = (np.concatenate([[0], np.cumsum(np.bincount(x, minlength=n))]) for x in (of_a, of_b))
        out = np.empty(len(a) + len(b), dtype=np.int64)
        # Within a group all A ids come first. Marks: 0 between ids, 1 after the last A id, 2 after the group.
        mark_a, mark_b = (of_a != np.append(of_a[1:], n)).astype(np.int64), 2 * (of_b != np.append(of_b[1:], n)).astype(np.int64)
        out[np.arange(len(a)) + before_b[of_a]] = a + t.n_named * mark_a
        out[np.arange(len(b)) + before_a[of_b + 1]] = b + t.n_named * mark_b
        named = t.named.take(pa.array(out))
        cuts = np.concatenate([[0], np.cumsum(self.n_a + self.n_b)])
        offsets = np.frombuffer(named.buffers()[1], np.int64)[named.offset : named.offset + len(named) + 1][cuts]
        units = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets)), named.buffers()[2]])
        parts = units.take(pa.array(self.back))
        data, offsets = K.raw_bytes(parts) if len(parts) else (np.zeros(0, np.uint8), np.zeros(1, np.int64))
        whole, cuts = data.tobytes(), offsets[self.bounds]
        return [whole[i : j - 1] if has else b"" for i, j, has in zip(cuts[:-1].tolist(), cuts[1:].tolist(), self.has_tokens.tolist(), strict=True)]


_GRAPHIC = np.zeros(256, dtype=bool)
_GRAPHIC[0x21:0x7F] = True
_FOLLOWS = _GRAPHIC.copy()
_FOLLOWS[0x80:] = True


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Units of blank + text: as distinct values with an index for each occurrence, and the bounds of texts among the occurrences."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    data, offsets = K.raw_bytes(pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts, pa.scalar(" ", pa.large_string())))
    inner = np.flatnonzero((data[1:-1] == 0x20) & _GRAPHIC[data[:-2]] & _FOLLOWS[data[2:]]) + 1 if len(data) > 2 else np.zeros(0, np.int64)
    starts = _distinct(np.concatenate([inner, offsets]))  # every text has a byte at least
    kinds = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
    return kinds.dictionary, kinds.indices.to_numpy(), np.searchsorted(starts, offsets)


def pair_counts(t: Tokenizers, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct pairs of some texts, and how many of the texts hold each."""
    found = Aligned(t, texts)
    doc = np.repeat(np.arange(len(texts)), np.diff(found.bounds))
    held = found.has_tokens[doc]
    seen = _distinct(doc[held] * np.int64(len(found.n_links)) + found.back[held])
    of, unit = np.divmod(seen, max(1, len(found.n_links)))
    n = found.n_links[unit]
    pairs, place = np.unique(found.links, return_inverse=True)
    place = place[_spread((np.cumsum(found.n_links) - found.n_links)[unit], n)]
    per_doc = _distinct(np.repeat(of, n) * np.int64(max(1, len(pairs))) + place)
    counts = np.bincount(per_doc % max(1, len(pairs)), minlength=len(pairs))
    return pairs[counts > 0], counts[counts > 0]


# Minimal perfect hash.


def _bit(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
    return (K.mix(keys + _U((level + 1) * 0x9E3779B97F4A7C15 % 2**64)) % _U(bits)).astype(np.int64)


def perfect_hash(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bits of each level, words of all levels) for distinct keys."""
    sizes, words = [], []
    while len(keys):
        size = 64 * (-(-2 * len(keys) // 64))
        at = _bit(keys, len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        words.append(np.packbits(alone, bitorder="little").view(np.uint64))
        keys = keys[~alone[at]]
    return np.array(sizes, dtype=np.uint64), np.concatenate(words) if words else np.zeros(0, np.uint64)


def hash_index(sizes: np.ndarray, words: np.ndarray, rank: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Index of each key; a key that wasn't there at the building gets -1 or the index of another."""
    out = np.full(len(keys), -1, dtype=np.int64)
    open_, before = np.arange(len(keys)), 0
    for level, size in enumerate(sizes.tolist()):
        at = _bit(keys[open_], level, size)
        word, bit = before + (at >> 6), (at & 63).astype(_U)
        hit = ((words[word] >> bit) & _U(1)).astype(bool)
        below = np.bitwise_count(words[word] & ((_U(1) << bit) - _U(1))).astype(np.int64)
        out[open_[hit]] = (rank[word].astype(np.int64) + below)[hit]
        open_, before = open_[~hit], before + size // 64
        if not len(open_):
            break
    return out


def _ranks(words: np.ndarray) -> np.ndarray:
    n = np.bitwise_count(words).astype(np.int64)
    return (np.cumsum(n) - n).astype(np.uint64)


def shard_of(pairs: np.ndarray, shards: int) -> np.ndarray:
    return (K.mix((pairs >> _U(32)) + _U(1)) % _U(shards)).astype(np.int64)


def look_up(folder: str, shards: int, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(documents that hold a pair, whether that is its A id's highest); 0 and False for pairs the corpus doesn't have."""
    counts, best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), bool)
    shard = shard_of(pairs, shards)
    for k in np.unique(shard):
        at = np.flatnonzero(shard == k)
        sizes, words, rank, keys = mapped.get(folder, f"hash-{k}")
        if not len(keys):
            continue
        index = hash_index(sizes, words, rank, pairs[at])
        there = (index >= 0) & (keys[np.maximum(index, 0)] == pairs[at])
        held, high = mapped.get(folder, f"counts-{k}")
        counts[at[there]], best[at[there]] = held[index[there]], high[index[there]].astype(bool)
    return counts, best


_PACKED = "shard int, part int, data binary"


def _row(shard: int, part: int, data: bytes) -> pa.Table:
    return pa.table({"shard": pa.array([shard], pa.int32()), "part": pa.array([part], pa.int32()), "data": pa.array([data], pa.binary())})


def _depth(parts: int) -> int:
    depth = 1
    while FAN_IN**depth < parts:
        depth += 1
    return depth


def count_pairs(docs: DataFrame, scratch: Scratch, text_col: str, vocabularies: str, shards: int) -> str:
    """First pass and both trees; returns the folder of the mapped arrays."""
    folder = scratch.path("model")

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, part = tokenizers(vocabularies), TaskContext.get().partitionId()
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, back = np.unique(np.concatenate([k for k, _ in held] or [np.zeros(0, np.uint64)]), return_inverse=True)
            counts = np.bincount(back, weights=np.concatenate([c for _, c in held] or [np.zeros(0)]), minlength=len(keys)).astype(np.int64)
            return keys, counts

        def flush(keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
            shard = shard_of(keys, shards)
            for k in np.unique(shard):
                yield from _row(int(k), part, pack(keys[shard == k].astype(np.int64), counts[shard == k])).to_batches()

        for batch in batches:
            for piece in K.slices(batch, limit=SLICE):
                held.append(pair_counts(t, piece.column("text")))
                if sum(len(k) for k, _ in held) > HELD:
                    held[:] = [merged()]
                    if len(held[0][0]) > HELD // 2:
                        yield from flush(*held.pop())
        yield from flush(*merged())

    def united(t: pa.Table) -> np.ndarray:
        return np.unique(np.concatenate([unpack(x)[0] for x in t.column("data")]))

    def node(t: pa.Table) -> tuple[int, int]:
        return t.column("shard")[0].as_py(), t.column("part")[0].as_py() // FAN_IN

    def union(t: pa.Table) -> pa.Table:
        return _row(*node(t), pack(united(t)))

    def build(t: pa.Table) -> pa.Table:
        shard, keys = t.column("shard")[0].as_py(), united(t).astype(_U)
        sizes, words = perfect_hash(keys)
        rank = _ranks(words)
        placed = np.zeros(len(keys), np.uint64)
        placed[hash_index(sizes, words, rank, keys)] = keys
        mapped.put(folder, f"hash-{shard}", sizes, words, rank, placed)
        return _row(shard, len(keys), b"")

    def dense(t: pa.Table) -> pa.Table:
        shard, part = node(t)
        sizes, words, rank, keys = mapped.get(folder, f"hash-{shard}")
        total = np.zeros(len(keys), np.int64)
        for x in t.column("data"):
            pairs, counts = unpack(x)
            np.add.at(total, hash_index(sizes, words, rank, pairs.astype(_U)), counts)
        return _row(shard, part, pack(np.cumsum(total)))

    def summed(t: pa.Table) -> np.ndarray:
        return np.sum([np.diff(unpack(x)[0], prepend=0) for x in t.column("data")], axis=0)

    def add(t: pa.Table) -> pa.Table:
        return _row(*node(t), pack(np.cumsum(summed(t))))

    def finish(t: pa.Table) -> pa.Table:
        shard, total = t.column("shard")[0].as_py(), summed(t)
        _, _, _, keys = mapped.get(folder, f"hash-{shard}")
        ids, back = np.unique(keys >> _U(32), return_inverse=True)
        highest = np.zeros(len(ids), np.int64)
        np.maximum.at(highest, back, total)
        mapped.put(folder, f"counts-{shard}", mapped.narrow(total), (total == highest[back]).astype(np.uint8))
        return _row(shard, len(total), b"")

    rows = docs.select(F.col(text_col).cast("string").alias("text"))
    depth, leaf = _depth(max(1, docs.rdd.getNumPartitions())), F.floor(F.col("part") / FAN_IN)
    pairs = scratch.write(rows.mapInArrow(first_pass, _PACKED), "pairs")
    tree = pairs
    for _ in range(depth):
        tree = tree.groupBy("shard", leaf).applyInArrow(union, _PACKED)
    scratch.write(tree.groupBy("shard").applyInArrow(build, _PACKED), "built")
    tree = pairs.groupBy("shard", leaf).applyInArrow(dense, _PACKED)
    for _ in range(depth - 1):
        tree = tree.groupBy("shard", leaf).applyInArrow(add, _PACKED)
    scratch.write(tree.groupBy("shard").applyInArrow(finish, _PACKED), "counted")
    scratch.drop("pairs")
    return folder


_OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def token_alignment(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabularies: str = VOCABULARIES, shards: int = SHARDS, keep_groups: bool = False, scratch: Scratch | None = None) -> DataFrame:
    """Tokens, groups and links of every row under both tokenizers, and the corpus-wide counts of its links.

    Rows with a null or empty text, or one that a tokenizer doesn't give back byte by byte, have no tokens: zeros, and
    '' as digest. A null id is handed on; repeated rows and rows that share an id are documents of their own and count
    each. Long texts count whole: a worker holds about 40 bytes for each byte of the longest one, and a stretch
    without a blank is encoded in one go. Ties for the highest count are all best. An empty table gives an empty
    result. Other columns are not looked at, whatever their names. ``keep_groups`` adds the groups themselves.
    """
    scratch = scratch or Scratch(docs.sparkSession, "token-alignment")
    folder = count_pairs(docs, scratch, text_col, vocabularies, shards)
    names = [f.split()[0] for f in _OUT.split(", ")] + ["groups"] * keep_groups

    def second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizers(vocabularies)
        for batch in batches:
            for piece in K.slices(batch, limit=SLICE):
                found = Aligned(t, piece.column("text"))
                distinct, place = np.unique(found.links, return_inverse=True)
                counts, best = look_up(folder, shards, distinct)
                groups = found.groups(t)
                sums = [found.by_text(x) for x in (found.n_a, found.n_b, found.n_groups, found.n_links, found.by_unit(best[place]), found.by_unit(counts[place]))]
                columns = [piece.column("doc_id"), *map(pa.array, sums), pa.array([hashlib.sha256(x).hexdigest() if x else "" for x in groups], pa.string())]
                if keep_groups:
                    columns.append(pa.array([x.decode() for x in groups], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(second_pass, _OUT + ", groups string" * keep_groups)
