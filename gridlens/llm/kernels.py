"""Array kernels over Arrow string batches: words, word hashes, shingles.

They run inside Spark tasks on slices of about a quarter of a megabyte of text, so a worker's memory
does not depend on how many rows a batch holds. A document longer than a slice is a slice of its own,
and its bytes are worked through in blocks of a megabyte: what is kept of it is its text and 16 bytes
for each word. All hashes are 64-bit and depend on content alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES, BLOCK_BYTES = 1 << 18, 1 << 20

_U = np.uint64
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_CODE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_powers = [np.ones(1, dtype=_U), np.ones(1, dtype=_U)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit (splitmix finaliser)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; tables of the usual block size are kept, longer ones (for a longer word) are not."""
    if len(_powers[0]) >= n:
        return _powers[0], _powers[1]
    made = []
    for base in (_BASE, _BASE_INVERSE):
        steps = np.full(max(n, BLOCK_BYTES // 2), base, dtype=_U)
        steps[0] = 1
        made.append(np.multiply.accumulate(steps))
    if n <= 2 * BLOCK_BYTES:
        _powers[:] = made
    return made[0], made[1]


@dataclass
class Words:
    """The words of a slice of texts: word i is bytes starts[i]:ends[i]; text d has words bounds[d]:bounds[d+1]."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray
    offsets: np.ndarray
    hashes: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about ``limit`` bytes of text each."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes, dtype=np.int64) // limit
    cuts = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def _blocks(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Consecutive stretches of about ``BLOCK_BYTES`` that cut no word."""
    at = 0
    while at < len(data):
        end = at + BLOCK_BYTES
        if end < len(data):
            next_text = int(offsets[np.searchsorted(offsets, end)])
            while end < next_text:
                gap = np.flatnonzero(_IS_SPACE[data[end : min(end + 4096, next_text)]])
                if len(gap):
                    end += int(gap[0])
                    break
                end = min(end + 4096, next_text)
        end = min(end, len(data))
        yield at, end
        at = end


def words(texts: pa.Array, latin: bool = False) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text, A-Z (``latin``: and the capitals from U+00C0 to U+00DE) lower-cased before hashing."""
    raw, offsets = raw_bytes(texts)
    whole = np.empty_like(raw)
    kind = np.int32 if len(raw) < 2**31 else np.int64
    parts: tuple[list, list, list] = ([], [], [])
    for low_end, high_end in _blocks(raw, offsets):
        data = _LOWER[raw[low_end:high_end]]
        if latin:
            after = np.flatnonzero(data[:-1] == 0xC3) + 1
            low = data[after]
            data[after] = np.where((low >= 0x80) & (low <= 0x9E) & (low != 0x97), low + 0x20, low)
        whole[low_end:high_end] = data
        n = len(data)
        inside = ~_IS_SPACE[data]
        first = np.zeros(n + 1, dtype=bool)
        first[offsets[np.searchsorted(offsets, low_end) : np.searchsorted(offsets, high_end, "right")] - low_end] = True
        before = np.empty(n, dtype=bool)
        before[1:] = inside[:-1]
        before[:1] = False
        starts = np.flatnonzero(inside & (~before | first[:n]))
        after = np.empty(n, dtype=bool)
        after[:-1] = inside[1:]
        after[n - 1 :] = False
        ends = np.flatnonzero(inside & (~after | first[1:])) + 1
        up, down = _power_tables(n + 1)
        sums = np.zeros(n + 1, dtype=_U)
        np.cumsum(_BYTE_CODE[data] * up[:n], out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U))
        for held, found in zip(parts, ((starts + low_end).astype(kind), (ends + low_end).astype(kind), hashes), strict=True):
            held.append(found)
    joined = []
    for held, t in zip(parts, (kind, kind, _U), strict=True):
        joined.append(held[0] if len(held) == 1 else np.concatenate(held) if held else np.zeros(0, t))
        held.clear()
    starts, ends, hashes = joined
    return Words(whole, starts, ends, np.searchsorted(starts, offsets), offsets, hashes)


def shingles(w: Words, size: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's word shingles; a text with fewer words is one shingle."""
    h, n = w.hashes, len(w.hashes)
    runs = h.copy()
    for k in range(1, size):
        m = max(n - k, 0)
        runs[:m] = mix(runs[:m] * _U(0xD6E8FEB86659FD93) + h[k:])
    out = []
    for a, b in zip(w.bounds[:-1], w.bounds[1:], strict=True):
        if b - a >= size:
            out.append(np.unique(runs[a : b - size + 1]))
        elif b > a:
            out.append(sequence_hash(h[a:b])[:1])
        else:
            out.append(h[:0])
    return out


def sequence_hash(h: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes of a whole word sequence, order included."""
    place = mix(np.arange(1, len(h) + 1, dtype=_U))
    return np.array([mix(np.array([np.sum(mix(h ^ place)) + _U(len(h))], _U))[0], mix(np.array([np.sum(mix(h + place * _U(3))) ^ _U(len(h) * 7)], _U))[0]], dtype=_U)


def text_sum(per_word: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of a per-word array (words on axis 0) over each text; 0 for texts without words."""
    out = np.zeros((len(bounds) - 1, *per_word.shape[1:]), dtype=per_word.dtype)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        out[full] = np.add.reduceat(per_word, bounds[:-1][full], axis=0)
    return out
