"""Quality rules: a table of thresholds compiled into one projection of built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Frequent function words of the corpus's four languages.
STOP_WORDS = (
    "the of and to in a is that it for on was be with as by this are from or at which not have but they you "
    "der die und das ist nicht ein eine zu von mit den dem auf für im sich des auch er es "
    "le la les et un une des du que qui dans pour sur est pas par avec au il ce "
    "el los las y en con por para no se su al lo una de"
).split()
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
WINDOW = 8

#: rule, measure, least, most (None: open). A document is kept when every measure is within its bounds.
THRESHOLDS: tuple[tuple[str, str, float | None, float | None], ...] = (
    ("word length", "chars_per_word", 1.5, 14.0),
    ("symbols", "symbols_per_word", None, 0.25),
    ("stop words", "stop_words", 2, None),
    ("repeated lines", "dup_line_share", None, 0.6),
    ("stuttered words", "stutter_share", None, 0.25),
    ("line length", "words_per_line", 1.5, None),
)
LEAST_WORDS, MOST_REPEATED_PERCENT = 20, 30


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it in ``body`` any number of times."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """Words inside windows of eight that occur at least twice in the row, first occurrences included.

    Window hashes come by doubling (1, 2, 4, 8 words). Rows without a repeated window stop at a
    distinct count; the others sort (hash, place) pairs, so the cost is n log n in the words.
    """

    def double(step: int):
        return lambda h: F.zip_with(h, F.slice(h, step + 1, F.greatest(F.size(h) - step, F.lit(0))), lambda a, b: F.xxhash64(a, b))

    def places(s: Column) -> Column:
        twice = lambda e, i: (F.get(s, i - 1)["h"] == e["h"]) | (F.get(s, i + 1)["h"] == e["h"])
        return F.sort_array(F.transform(F.filter(s, lambda e, i: F.coalesce(twice(e, i), F.lit(False))), lambda e: e["i"]))

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda v, i: F.coalesce(F.least(F.get(p, i + 1) - v, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    def count(g: Column) -> Column:
        pairs = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(let(pairs, lambda s: let(places(s), covered)))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    windows = let(hashed, lambda h: let(double(1)(h), lambda h2: let(double(2)(h2), lambda h4: F.slice(double(4)(h4), 1, F.size(words) - (WINDOW - 1)))))
    return F.when(F.size(words) < WINDOW, F.lit(0)).otherwise(let(windows, count)).cast("long")


def passes(measures: dict[str, Column]) -> Column:
    """The threshold table as one boolean expression; a null measure fails no rule."""
    verdict = F.lit(True)
    for _, name, least, most in THRESHOLDS:
        if least is not None:
            verdict = verdict & F.coalesce(measures[name] >= least, F.lit(True))
        if most is not None:
            verdict = verdict & F.coalesce(measures[name] <= most, F.lit(True))
    return verdict


def quality_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measures and verdict of every row, by built-in functions only and without a shuffle.

    Null and empty texts have no words and fail the base rule. Repeated rows are judged each.
    Only id and text are read.
    """
    raw = F.col(text_col).cast("string")
    split = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(raw, F.lit("")).alias("t"),
        F.array_remove(F.split(F.coalesce(raw, F.lit("")), "[ \\t\\n\\x0B\\f\\r]+"), "").alias("w"),
        F.filter(F.split(F.coalesce(raw, F.lit("")), "\n"), lambda x: x.rlike("[^ \\t\\n\\x0B\\f\\r]")).alias("l"),
    )
    measured = split.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.translate("t", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("w")).alias("n_repeat_words"),
        F.size("l").cast("long").alias("n_lines"),
        F.size(F.filter(F.zip_with("w", F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))), lambda a, b: a == b), lambda x: x)).cast("long").alias("n_stutters"),
        F.size(F.array_intersect(F.split(F.lower("t"), "[ \\t\\n\\x0B\\f\\r]+"), F.array(*map(F.lit, STOP_WORDS)))).cast("long").alias("n_stop_words"),
    )
    words, lines = F.nullif(F.col("n_words"), F.lit(0)), F.nullif(F.col("n_lines"), F.lit(0))
    measures = {
        "chars_per_word": F.col("word_chars") / words,
        "symbols_per_word": F.col("n_symbols") / words,
        "stop_words": F.col("n_stop_words"),
        "dup_line_share": F.col("n_dup_lines") / lines,
        "stutter_share": F.col("n_stutters") / words,
        "words_per_line": F.col("n_words") / lines,
    }
    failed = (F.col("n_words") < LEAST_WORDS) | (F.lit(100) * F.col("n_repeat_words") > F.lit(MOST_REPEATED_PERCENT) * F.col("n_words"))
    return measured.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & passes(measures)).alias("kept"), "n_lines", "n_stop_words", "n_stutters"
    )


def sql() -> str:
    """The same for DuckDB, from the same threshold table."""
    of = {"chars_per_word": "word_chars / nullif(n_words, 0)", "symbols_per_word": "n_symbols / nullif(n_words, 0)", "stop_words": "n_stop_words", "dup_line_share": "n_dup_lines / nullif(n_lines, 0)", "stutter_share": "n_stutters / nullif(n_words, 0)", "words_per_line": "n_words / nullif(n_lines, 0)"}
    rules = [f"coalesce({of[m]} >= {a}, true)" for _, m, a, _ in THRESHOLDS if a is not None] + [f"coalesce({of[m]} <= {b}, true)" for _, m, _, b in THRESHOLDS if b is not None]
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    space = "[ \\t\\n\\x0B\\f\\r]"
    return f"""
WITH split AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '{space}+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0B\\f\\r]')) AS l
  FROM documents),
places AS (
  SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], chr(1)) AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM split)),
repeated AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS c FROM places) WHERE c > 1),
cover AS (
  SELECT doc_id, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW})))::BIGINT AS n
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM repeated) GROUP BY doc_id),
measured AS (
  SELECT s.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '{space}', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(translate(t, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
         len(l)::BIGINT AS n_lines,
         len(list_intersect(list_distinct(string_split_regex(lower(t), '{space}+')), [{stops}]))::BIGINT AS n_stop_words,
         len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1]))::BIGINT AS n_stutters
  FROM split s LEFT JOIN cover c ON s.doc_id = c.doc_id),
judged AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED_PERCENT} * n_words AS base_failed FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {" AND ".join(rules)} AS kept, n_lines, n_stop_words, n_stutters
FROM judged"""
