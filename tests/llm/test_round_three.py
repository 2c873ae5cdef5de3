"""Token alignment, suffix deduplication and hard negatives against brute force."""

import collections
import hashlib
import random
from itertools import pairwise

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridlens.llm import hard_negatives, suffix_dedup, token_alignment

SF = "/root/testdata/sf0.001"
ODD = [
    None, "", " ", "x", "\n\n x  y \n", "a  b", "▁ a b", "<|endoftext|> and <s> stay text", "zero\x00byte", "tabs\tand\r\nlines ", "naïve café 東京 は  夜", "🙂🙂 é 1234567 it's we'll",
    "  two blanks", "end blank ", "x" * 3000,
]


def brute_alignment(rows):
    """Whole texts, encoded as they are."""
    t, out, df = token_alignment.tokenizers(token_alignment.VOCABULARIES), [], collections.Counter()

    def ranges(ids, sizes):
        ends = np.cumsum([len(sizes[k]) for k in ids]).tolist()
        return list(zip([0, *ends[:-1]], ends, ids, strict=True))

    for i, x in rows:
        a, b = (t.a.encode(" " + x, add_special_tokens=False).ids, t.b.encode(x)) if x else ([], [])
        if not x or not b"".join(t.a_bytes[k] for k in a) == (" " + x).encode() == b"".join(t.b_bytes[k] for k in b):
            out.append((i, None))
            continue
        ra, rb = ranges(a, t.a_bytes), ranges(b, t.b_bytes)
        links, start = [], 0
        for low, high, k in ra:
            while rb[start][1] <= low:
                start += 1
            j = start
            while j < len(rb) and rb[j][0] < high:
                links.append((k, rb[j][2]))
                j += 1
        cuts = [0, *sorted({e for _, e, _ in ra} & {e for _, e, _ in rb})]
        named = lambda r, low, high: ",".join(str(k) for _, e, k in r if low < e <= high)
        groups = ";".join(f"{named(ra, low, high)}|{named(rb, low, high)}" for low, high in pairwise(cuts)) if len(ra) < 5000 else None
        df.update(set(links))
        out.append((i, (len(a), len(b), len(cuts) - 1, links, groups)))
    top = collections.defaultdict(int)
    for (a, _), c in df.items():
        top[a] = max(top[a], c)
    return [(i, 0, 0, 0, 0, 0, 0, "") if r is None else (i, *r[:3], len(r[3]), sum(df[x] == top[x[0]] for x in r[3]), sum(df[x] for x in r[3]), r[4] and hashlib.sha256(r[4].encode()).hexdigest()) for i, r in out]


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:])))


def test_alignment_equals_whole_texts(spark):
    given_ = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = [*given_, *((10_000 + k, x) for k, x in enumerate(ODD)), (10_000, "again"), (None, "no id"), (7, given_[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_a", F.lit("clash")).repartition(40)
    got, want = order(map(tuple, token_alignment.token_alignment(df, shards=5).collect())), order(brute_alignment(rows))
    assert [g[:7] for g in got] == [w[:7] for w in want] and all(w[7] is None or g[7] == w[7] for g, w in zip(got, want, strict=True))
    assert token_alignment.token_alignment(df.limit(0)).count() == 0
    kept = token_alignment.token_alignment(df, keep_groups=True).where("doc_id = 3").first()
    assert hashlib.sha256(kept["groups"].encode()).hexdigest() == kept["groups_sha256"] and kept["groups"].count(";") == kept["n_groups"] - 1


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab1 .'é \n\t東　s"), max_size=30), min_size=1, max_size=5))
def test_units_encode_as_whole_texts(texts):
    import pyarrow as pa

    t = token_alignment.tokenizers(token_alignment.VOCABULARIES)
    found = token_alignment.Aligned(t, pa.array(texts))
    want = brute_alignment(list(enumerate(texts)))
    assert [tuple(int(found.by_text(x)[k]) for x in (found.n_a, found.n_b, found.n_groups, found.n_links)) for k in range(len(texts))] == [w[1:5] for w in want]
    assert [hashlib.sha256(g).hexdigest() if g else "" for g in found.groups(t)] == [w[7] for w in want]


def test_the_perfect_hash_is_minimal_and_knows_its_keys():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 63, 5000):
        keys = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        sizes, words = token_alignment.perfect_hash(keys)
        rank = token_alignment._ranks(words)
        assert sorted(token_alignment.hash_index(sizes, words, rank, keys).tolist()) == list(range(len(keys)))


def brute_suffixes(rows, length):
    """Rows in order; every string of ``length`` bytes that was there before is removed."""
    seen, out = set(), []
    for i, x in rows:
        data = (x or "").encode()
        gone = np.zeros(len(data) + 1, dtype=bool)
        for k in range(len(data) - length + 1):
            if data[k : k + length] in seen:
                gone[k : k + length] = True
            seen.add(data[k : k + length])
        gone = gone[:-1]
        spans = int(np.sum(np.diff(gone.astype(int), prepend=0) == 1))
        out.append((i, len(data), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(data, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("crowd", [2, 2048])
def test_suffix_dedup_equals_brute_force(spark, crowd):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(1, 6)))
    shared = [" ".join(word() for _ in range(40)) for _ in range(6)]
    rows = [(k, " ".join(rng.choice(shared)[rng.randint(0, 60) :] if rng.random() < 0.3 else word() for _ in range(rng.randint(0, 40)))) for k in range(-5, 60)]
    rows += [(100 + k, shared[0] + word() + shared[1]) for k in range(30)]  # a common passage in many contexts
    rows += [(200, "ab" * 400), (201, "x" * 500), (202, None), (203, ""), (204, rows[-1][1]), (205, rows[-1][1]), (206, shared[2] * 3), (207, rng.choice(shared) + "x" * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("clash")).withColumn("size", F.lit(1)).repartition(7)
    got = sorted(map(tuple, suffix_dedup.suffix_dedup(df, length=40, gram=12, piece=3000, crowd=crowd).collect()))
    assert got == brute_suffixes(rows, 40) and sum(r[2] for r in got) > 5000


def test_suffix_dedup_of_odd_rows(spark):
    text = "every word of this line is said once and no more than that, and it is longer than a hundred bytes in all of its length"
    rows = [(5, text), (5, text), (5, text + "!"), (None, text), (1, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffix_dedup.suffix_dedup(df, keep_bytes=True).collect()
    assert len(got) == 5 and sum(r["n_removed"] for r in got) == 3 * len(text)
    first = [r for r in got if r["n_bytes"] == len(text) and not r["n_removed"]]
    assert len(first) == 1 and first[0]["doc_id"] == 5 and bytes(first[0]["kept"]).decode() == text and first[0]["spans"] == []
    assert [r["spans"] for r in got if r["doc_id"] is None] == [[[0, len(text)]]]
    assert suffix_dedup.suffix_dedup(df.limit(0)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(max_size=14).map(lambda b: bytes(x % 3 for x in b)), max_size=7))
def test_suffix_order_is_that_of_sorted_suffixes(texts):
    bwt, lcp, doc, start = suffix_dedup.suffix_order(texts)
    want = sorted((tuple(c + 1 for c in t[i:]) + (0,), d, i) for d, t in enumerate(texts) for i in range(len(t) + 1))
    assert [(d, i) for _, d, i in want] == list(zip(doc.tolist(), start.tolist(), strict=True))
    common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y or not x), 0)
    assert lcp.tolist() == [0, *(common(x[0], y[0]) for x, y in pairwise(want))][: len(want)]
    assert [b > 0 for b in bwt.tolist()] == [i > 0 for _, _, i in want]


def test_hard_negatives_equal_sql(spark, tmp_path):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(6, 16))
    rows = []
    for k in range(3000):
        x = centres[k % 6] + 0.3 * rng.normal(size=16)
        rows.append((k, (centres[0] if k % 3 == 0 else x).astype(np.float32).tolist(), int(rng.integers(0, 10))))  # a third are one vector
    rows += [(3100, None, 1), (3200, [0.5, None, *[0.1] * 14], 1), (3300, [float("nan")] * 16, 2), (3400, [1.0] * 16, None), (3500, [float("inf")] * 16, 2), (None, [1.0] * 16, 2), (-100, rows[5][1], 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("v", F.lit("clash")).withColumn("key", F.lit(1))
    path = str(tmp_path / "e.parquet")
    df.write.parquet(path)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/*.parquet'")
    want = sorted(con.sql(hard_negatives.SQL).fetchall())
    assert len(want) > 100 and sorted(map(tuple, hard_negatives.hard_negatives(spark.read.parquet(path)).collect())) == want
    assert hard_negatives.hard_negatives(df.limit(0)).count() == 0
    twice = hard_negatives.hard_negatives(df.union(df))  # repeated rows count once
    assert sorted(map(tuple, twice.collect())) == want


def test_zone_maps_spare_blocks(tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    rng = np.random.default_rng(1)
    v = np.concatenate([c + rng.integers(-9, 10, (1000, 4)) for c in (np.array([900, 0, 0, 0]), np.array([0, 900, 0, 0]), np.array([-900, 0, 0, 0]), np.array([0, 0, 900, 0]))])
    v = v[rng.permutation(len(v))].astype(np.int64)
    keys = hard_negatives.hilbert_keys(v, int(v.min()), int(v.max()))
    v = v[np.lexsort(keys.T[::-1])]
    labels = rng.integers(0, 3, len(v)).astype(np.int32)
    with pq.ParquetWriter(tmp_path / "0.parquet", pa.schema([("vec_id", pa.int64()), ("label", pa.int32()), *((f"d{k}", pa.int64()) for k in range(4))])) as out:
        for a in range(0, len(v), 100):
            out.write_table(pa.table({"vec_id": pa.array(range(a, a + 100), pa.int64()), "label": labels[a : a + 100], **{f"d{k}": v[a : a + 100, k] for k in range(4)}}))
    at = np.arange(0, len(v), 97)
    best, read = hard_negatives.find_positives(str(tmp_path), [0], at, labels[at].astype(np.int64), v[at])
    assert best.filled.min() == 5
    anchor = at[:1]
    one, few = hard_negatives.find_positives(str(tmp_path), [0], anchor, labels[anchor].astype(np.int64), v[anchor])
    assert (one.ids == best.ids[:1]).all() and 0 < few <= 15 and few < read <= 40
    _, windows = hard_negatives.find_negatives(str(tmp_path), [0], labels[anchor].astype(np.int64), v[anchor], one.scores)
    assert windows <= 15


def test_hilbert_order_is_a_path_of_neighbours():
    side = np.arange(8)
    grid = np.array([(x, y, z) for x in side for y in side for z in side], dtype=np.int64)
    path = grid[np.lexsort(hard_negatives.hilbert_keys(grid, 0, 7, bits=3).T[::-1])]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()
