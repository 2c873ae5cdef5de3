"""Removal of passages of lines that occur again, cut where the content says.

A rolling hash runs over each two neighbouring line hashes of a text (lines without a word are
passed over). A boundary stands wherever the rolling hash changes between one that occurs at more
than one place of the corpus and one that doesn't: it depends on the lines beside it alone, so
lines inserted or deleted elsewhere move no boundary, and a passage that stands in two documents
is cut alike in both, from its first line to its last. A single line of ``long_words`` words or
more is a chunk by itself. Of what occurs more than once the first place (smallest document id,
then text hash, then line) stays.

Bytes decide: a line hash that stands for two different lines, anywhere, takes part in no chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlens.llm.shared import Scratch

#: Words that make a single line a chunk: passages of more than fifty words are looked for.
LONG_WORDS = 50
_WORD = "[^ \\t\\n\\x0B\\f\\r]"


def _split(text: Column) -> Column:
    return F.split(text, "\n")


def _described(texts: DataFrame, long_words: int) -> DataFrame:
    """(doc_id, t, lines): the lines with a word, each with its number, hash, text, and whether it is long."""
    space = "[ \\t\\x0B\\f\\r]+"
    lines = F.transform(_split(F.col("text")), lambda x, i: F.struct(i.alias("i"), F.xxhash64(x).alias("h"), x.alias("line"), (F.size(F.array_remove(F.split(x, space), "")) >= long_words).alias("long")))
    return texts.select("doc_id", "t", F.filter(lines, lambda x: x["line"].rlike(_WORD)).alias("lines"))


def line_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", long_words: int = LONG_WORDS, scratch: Scratch | None = None) -> DataFrame:
    """``(doc_id, n_lines, n_removed (chunks), n_removed_lines, text)`` for every row.

    Rows are told apart by id and text: rows that share both count as one document (what only
    they have in common stays, and they are cut alike), rows that share an id alone are two.
    Null texts stay null with no lines; empty texts are one empty line. Lines without a word
    inside a removed chunk go with it, others stay. Rows with a null id are returned unchanged
    and compared with nothing. Other columns are not read.

    No joined side is bounded, so all joins are sort-merge joins at any size; the one key that
    many rows share is joined with a single row, which Spark splits. Texts are shuffled twice:
    lines by their hash, added up in each task first, and rows by id and text hash.
    """
    scratch = scratch or Scratch(docs.sparkSession, "line_dedup")
    text = F.col(text_col).cast("string")
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("t"), text.alias("text"))

    # Line hashes that occur again, and among them those that stand for different lines.
    lines = _described(texts, long_words).select(F.explode("lines").alias("x")).select(F.col("x.h").alias("h"), F.col("x.line").alias("line"))
    seen = lines.groupBy("h").agg(F.count("*").alias("k"), F.min("line").alias("a"), F.max("line").alias("b"))
    clash = scratch.write(seen.where("k > 1 and a <> b").select("h"), "clash")

    # Units: two neighbouring lines, or a long one. One row each, with the lines from its first to its last.
    hashed = _described(texts, long_words).select("doc_id", "t", F.transform("lines", lambda x: F.struct(x["i"].alias("i"), x["h"].alias("h"), x["long"].alias("long"))).alias("x"))
    pair = F.zip_with(F.slice("x", 1, F.size("x") - 1), F.slice("x", 2, F.greatest(F.size("x") - 1, F.lit(0))), lambda a, b: F.struct(a["h"].alias("h"), b["h"].alias("g"), a["i"].alias("i"), b["i"].alias("j")))
    single = F.transform(F.filter("x", lambda x: x["long"]), lambda x: F.struct(x["h"].alias("h"), F.lit(None).cast("long").alias("g"), x["i"].alias("i"), x["i"].alias("j")))
    units = hashed.where(F.size("x") > 0).select("doc_id", "t", F.explode(F.concat(pair, single)).alias("u")).select("doc_id", "t", "u.*").withColumn("r", F.xxhash64("h", "g"))
    units = scratch.write(units, "units")
    place = F.struct("doc_id", "t", "i")
    again = units.groupBy("r", "h", "g").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last")
    again = again.select("r", "h", F.col("g").alias("g2"), "first").join(clash.hint("merge"), "h", "left_anti").join(clash.select(F.col("h").alias("g2")).hint("merge"), "g2", "left_anti")
    again = scratch.write(again, "again")
    gone = units.join(again.hint("merge"), ["r", "h"]).where(F.col("g").eqNullSafe(F.col("g2")) & (place != F.col("first")))
    spans = scratch.write(gone.groupBy("doc_id", "t").agg(F.sort_array(F.collect_set(F.struct("i", "j"))).alias("gone")), "spans")
    scratch.drop("units", "again", "clash")

    # Overlapping and touching units are one chunk. Units are sorted, and their last lines are too.
    present = lambda x: F.filter(x, lambda v: v.isNotNull())
    starts = present(F.transform("gone", lambda u, k: F.when(F.coalesce(F.get("gone", k - 1)["j"] < u["i"], F.lit(True)), u["i"])))
    ends = present(F.transform("gone", lambda u, k: F.when(F.coalesce(F.get("gone", k + 1)["i"] > u["j"], F.lit(True)), u["j"])))
    spans = spans.select("doc_id", "t", F.zip_with(starts, ends, lambda i, j: F.struct(i.alias("i"), j.alias("j"))).alias("chunks"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("t"), text.alias("text"))
    cut = rows.join(spans.hint("merge"), ["doc_id", "t"], "left").select("doc_id", "text", F.coalesce("chunks", F.expr("cast(array() as array<struct<i:int,j:int>>)")).alias("chunks"))
    cut = cut.withColumn("lines", F.when(F.size("chunks") > 0, _split(F.col("text"))))
    # What stays lies between the chunks: from the line after one to the line before the next.
    left = F.concat(F.array(F.lit(0)), F.transform("chunks", lambda c: c["j"] + 1))
    right = F.concat(F.transform("chunks", lambda c: c["i"]), F.array(F.size("lines")))
    kept = F.flatten(F.transform(F.arrays_zip(left.alias("a"), right.alias("b")), lambda s: F.slice(F.col("lines"), s["a"] + 1, s["b"] - s["a"])))
    return cut.select(
        "doc_id",
        F.when(F.col("text").isNull(), 0).otherwise(F.length("text") - F.length(F.translate("text", "\n", "")) + 1).cast("long").alias("n_lines"),
        F.size("chunks").cast("long").alias("n_removed"),
        F.aggregate("chunks", F.lit(0), lambda a, c: a + c["j"] - c["i"] + 1).cast("long").alias("n_removed_lines"),
        F.when(F.size("chunks") > 0, F.array_join(kept, "\n")).otherwise(F.col("text")).alias("text"),
    )
