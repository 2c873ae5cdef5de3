import random
import re

import corpus_pipeline
import numpy as np
import pyarrow as pa
from gridlens.llm import decontaminate, queries
from gridlens.llm import kernels as K
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", (text or "").lower())


def _items(benchmark):
    rows = benchmark.collect()
    return decontaminate.read_items([r["item_id"] for r in rows], [r["text"] for r in rows])


def _planted(spark, docs, items, shares, seed):
    """Documents with each item at each share of words replaced at random, answers too; the wanted pairs of each share."""
    rng, rows, want = random.Random(seed), [], {x: set() for x in shares}
    vocab = [t for r in docs.orderBy("doc_id").limit(200).collect() for t in words(r["text"])]
    for item in items.collect():
        for share in shares:
            doc = 10**9 + len(rows)
            changed = [rng.choice(vocab) if rng.random() < share else x for x in words(item["text"])]
            rows.append((doc, " ".join([*rng.choices(vocab, k=rng.randrange(60, 140)), *changed, *rng.choices(vocab, k=100)])))
            want[share].add((doc, item["item_id"]))
    return docs.union(spark.createDataFrame(rows, docs.schema)), want


def _pairs(df):
    return {(r["doc_id"], r["item_id"]) for r in df.collect()}


def test_the_latent_search_finds_what_words_alone_miss(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{SF}/benchmark.parquet")
    both, want = _planted(spark, docs, items, (0.2, 0.3), 5)
    got, without = _pairs(decontaminate.contaminated(both, items)), _pairs(decontaminate.contaminated(both, items, latent=1.1))
    assert all(len(want[x] & got) >= 0.9 * len(want[x]) for x in want)
    assert without < got and len(want[0.3] & without) < 0.6 * len(want[0.3])
    # Nothing but the planted documents comes in by it, and each of them for its own item alone.
    assert {p for p in got - without} <= want[0.2] | want[0.3]


def test_many_files_of_items_give_what_one_gives(spark, monkeypatch):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(400), spark.read.parquet(f"{SF}/benchmark.parquet")
    both, _ = _planted(spark, docs, items, (0.1,), 6)
    rows = lambda df: sorted((r["doc_id"], r["item_id"], r["common_words"], r["coverage"], r["answer_coverage"], round(r["cosine"], 3)) for r in df.collect())
    one = rows(decontaminate.contaminated(both, items))
    monkeypatch.setattr(decontaminate, "ITEM_BLOCK", 7)
    assert one and one == rows(decontaminate.contaminated(both, items.union(items)))


def test_latent_hits_equal_a_direct_search():
    rng = np.random.default_rng(2)
    vocab = [f"w{k}" for k in range(60)]
    text = lambda n: " ".join(rng.choice(vocab, n))
    bodies = [text(40), "", text(3), text(90)]
    items = decontaminate.read_items([1, 2, 3], [text(12), text(25), bodies[3][:150]])
    space = decontaminate.Space(rng.normal(size=(decontaminate.TERMS, 16)).astype(np.float32), np.ones(decontaminate.TERMS))
    index = decontaminate.item_index(items, space, 0.6)
    w = K.words(pa.array(bodies), latin=True)
    for product in (1, 1 << 19):
        decontaminate.PRODUCT, kept = product, decontaminate.PRODUCT
        got = decontaminate.latent_hits(w, index, index.windows(), space.project, 0.3, 0.4)
        decontaminate.PRODUCT = kept
        want = {}
        for d in range(len(bodies)):
            hashes = w.hashes[w.bounds[d] : w.bounds[d + 1]]
            terms = (hashes >> np.uint64(52)).astype(int)
            for begin in range(0, len(terms), decontaminate.HOP):
                for k, item in enumerate(items):
                    v = space.project[terms[begin : begin + index.scale[k]]].sum(axis=0)
                    for at, u in zip(index.offsets[k], index.vectors[k], strict=True):
                        cos, first, n = float(u @ v / np.linalg.norm(v)), begin - at, len(item.words)
                        around = int(index.around[k])
                        near = terms[max(first - around, 0) : first + n + around]
                        if cos >= 0.3 and sum(bool(index.member[k, t]) for t in near) >= 0.4 * n:
                            want[d, k, first] = max(want.get((d, k, first), -1), cos)
        assert got.keys() == want.keys() and len(want) > 20 and all(abs(got[x] - want[x]) < 1e-4 for x in want)


def test_a_long_text_is_searched_whole(spark):
    item = " ".join(f"term{k}" for k in range(40))
    filler = " ".join(f"word{k % 997}" for k in range(400_000))
    docs = spark.createDataFrame([(1, filler + " " + item), (None, item), (2, filler)], "doc_id long, text string")
    items = spark.createDataFrame([(5, item), (None, item), (6, item)], "item_id long, text string")
    got = sorted((r["doc_id"] or -1, r["item_id"], r["coverage"]) for r in decontaminate.contaminated(docs, items).collect())
    assert got == [(-1, 5, 1.0), (-1, 6, 1.0), (1, 5, 1.0), (1, 6, 1.0)]


def test_the_latent_space_takes_all_passages(spark):
    """Sums over 600,000 passages of a text each, more than a former sample held, and over random long texts."""
    rng = np.random.default_rng(4)
    weighted = rng.normal(size=(decontaminate.TERMS, 8)).astype(np.float32)
    term = lambda x: (K.words(pa.array([x]), latin=True).hashes >> np.uint64(52)).astype(int)
    many = spark.range(600_000).select(F.lit("one two").alias("text"))
    want = np.zeros(weighted.shape)
    for t in term("one two"):
        want[t] += 600_000 * weighted[term("one two")].astype(float).sum(axis=0)
    assert np.allclose(decontaminate.passage_products(many, weighted), want, rtol=1e-4)
    texts = [None, "", "one", *[" ".join(f"w{k}" for k in rng.zipf(1.3, n) % 3000) for n in (23, 24, 25, 700, 9000)]]
    want = np.zeros(weighted.shape)
    for x in filter(None, texts):
        terms = term(x)
        for at in range(0, len(terms), decontaminate.TILE):
            some = terms[at : at + decontaminate.TILE]
            np.add.at(want, some, weighted[some].astype(float).sum(axis=0))
    got = decontaminate.passage_products(spark.createDataFrame([(x,) for x in texts], "text string"), weighted)
    assert np.allclose(got, want, rtol=1e-3, atol=1e-3 * np.abs(want).max()) and (got != 0).any()


def test_subsequence():
    assert decontaminate.common_subsequence([1, 2, 3, 4], [9, 1, 3, 9, 4]) == 3
    assert decontaminate.common_subsequence([1, 1, 2], [1, 2, 1]) == 2 and decontaminate.common_subsequence([5], []) == 0


def test_every_verbatim_passage_is_found(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, items).collect()}
    text = {r["doc_id"]: " " + " ".join(words(r["text"])) + " " for r in docs.collect()}
    want = {(d, r["item_id"]) for r in items.collect() for d, t in text.items() if " " + " ".join(words(r["text"])) + " " in t}
    assert want and want <= got and len(got) < 0.05 * len(text)


def test_reworded_passages_and_odd_rows(spark):
    item = "the quick brown fox jumps over the lazy dog while seven wise owls watch from a tall oak tree. the answer is forty two steps north"
    reworded = item.replace("quick", "fast").replace("wise", "old").replace("tall", "high").upper()
    clean = " ".join(f"word{k}" for k in range(200))
    rows = [(1, f"{clean} {reworded} {clean}"), (2, clean), (3, None), (4, ""), (1, f"{clean} {reworded} {clean}"), (5, item + " " + clean)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("clash")).withColumn("item_id", F.lit("clash"))
    items = spark.createDataFrame([(7, item), (8, None), (9, "")], "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, items).collect())
    assert got == [(1, 7), (1, 7), (5, 7)]
    assert decontaminate.contaminated(docs.limit(0), items).count() == 0 and decontaminate.contaminated(docs, items.limit(0)).count() == 0


def test_paraphrases_at_the_least_coverage_are_found(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{SF}/benchmark.parquet")
    rng, rows, want = random.Random(3), [], set()
    vocab = [t for r in docs.orderBy("doc_id").limit(200).collect() for t in words(r["text"])]
    for item in _items(items):
        text = words(items.where(F.col("item_id") == item.item_id).first()["text"])
        for share in (0.62, 0.66, 0.7, 0.74, 0.78):
            # Words before the answer are replaced, so the rule of coverage and answer holds.
            gone = set(rng.sample(range(len(text) - len(item.answer)), min(len(text) - len(item.answer), int(len(text) * (1 - share)))))
            doc = 10**9 + len(rows)
            rows.append((doc, " ".join([*rng.choices(vocab, k=rng.randrange(60, 140)), *(rng.choice(vocab) if k in gone else x for k, x in enumerate(text)), *rng.choices(vocab, k=100)])))
            want.add((doc, item.item_id))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs.union(spark.createDataFrame(rows, docs.schema)), items).collect()}
    assert len(want & got) >= 0.98 * len(want)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns, name
            out = out.persist()
            assert 0 < out.count() < n
            n, docs = out.count(), out
        else:
            assert out.count() == n and out.select("shard").distinct().count() == 16


def test_pipeline_on_an_empty_table(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered():
    assert sum(name.startswith("op") for name in queries.QUERIES) == 13 and set(queries.SQL) < set(queries.QUERIES)


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Nulls, empty texts, repeated rows, shared ids and clashing names pass every stage."""
    text = " ".join(f"word{k} of the text" for k in range(40))
    rows = [(1, text, "en", "a", 10), (1, text, "en", "a", 10), (1, text + " and more of it", "en", "a", 10), (2, None, None, None, None), (None, text, "en", "a", 5), (3, "", "", "b", 0), (4, text, "de", "a", 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("mix_tokens", "shard", "number", "id", "kept", "size"):
        docs = docs.withColumn(name, F.lit("clash"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/labels.parquet").limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    folder = str(tmp_path)
    for name, stage in corpus_pipeline.STAGES[:4]:
        if name != "mixture":
            docs = stage(spark, docs, folder)
        else:
            assert stage(spark, docs, folder).columns == docs.columns
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in docs.collect()) == sorted([(1, text), (1, text + " and more of it"), (-1, text), (2, ""), (3, "")])
    out = corpus_pipeline.run(spark, folder)
    assert out.columns[:7] == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"] and 0 < out.count() <= 5
