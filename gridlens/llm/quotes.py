"""Quotation linking: find quoted passages, link them to the messages they come from, order the replies.

A quoted line begins with one or more ``>`` (its level), as in mail. Runs of quoted lines of one
level are passages. A passage is normalised as a whole (case, punctuation and line ends go), so
that wrapping it anew changes nothing, and hashed in windows of eight words; a shorter passage is
one window. Windows are joined by hash and then by text to the windows of earlier messages' own
text. Of all messages before the quote the one that holds most of the passage's windows is its
source, the latest of equal ones. The first and the last holder of each window are counted first; then
those that can hold as much as the best of them, which the passage's rarest windows name.
The source that a reply quotes most at level 1 is its parent. A message without a linked quote
starts a thread. Within a thread a message comes before its replies, and these in the order of their turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlens.llm.shared import Scratch

#: Lines that introduce a quote, without the colon.
LEAD_IN = "^\\s*(On .*wrote|Am .*schrieb.*|Le .*a écrit|El .*escribió)\\s*:\\s*$"
MARKS = "^\\s*((?:>\\s?)+)"
#: Words of a window, and turns of a stretch.
WINDOW, STRETCH = 8, 4096


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.regexp_replace(F.lower(text), "[\\s\\p{Punct}]+", " "), " "), "")


def _windows(w: Column) -> Column:
    """Every run of eight words; all words of a shorter text, nothing of an empty one."""
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (WINDOW - 1), F.lit(1))), lambda i: F.array_join(F.slice(w, i, WINDOW), " "))
    return F.when(F.size(w) > 0, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def parsed(messages: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv_id, turn, role, lines, own): lines as (level, body); own: text without quotes and lead-ins."""
    base = messages.select(
        F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).cast("string").alias("role"), F.split(F.col(text).cast("string"), "\n").alias("raw")
    )
    level = lambda x: F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 1), "[^>]", ""))
    lines = base.select("conv_id", "turn", "role", F.transform("raw", lambda x: F.struct(level(x).alias("level"), F.regexp_replace(x, MARKS, "").alias("body"))).alias("lines"))
    lead_in = lambda x, i: x["body"].rlike(LEAD_IN) & (F.coalesce(F.get(F.col("lines"), i + 1)["level"], F.lit(0)) > 0)
    own = F.filter("lines", lambda x, i: (x["level"] == 0) & ~lead_in(x, i))
    return lines.select("conv_id", "turn", "role", "lines", F.array_join(F.transform(own, lambda x: x["body"]), "\n").alias("own"))


def _bounds(lines: Column) -> tuple[Column, Column]:
    """Numbers of the lines where passages begin, and where they end."""
    level = lambda i: F.coalesce(F.get(lines, i)["level"], F.lit(0))
    at = lambda other: F.filter(F.transform(lines, lambda x, i: F.when((x["level"] > 0) & (x["level"] != level(other(i))), i)), lambda i: i.isNotNull())
    return at(lambda i: i - 1), at(lambda i: i + 1)


def quote_links(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, turn, passage, level, source_turn, n): the source of each passage that has one, and how many of its windows are there."""
    starts, ends = _bounds(F.col("lines"))
    quoting = rows.where(F.exists("lines", lambda x: x["level"] > 0)).select("conv_id", "turn", "lines", F.explode(F.arrays_zip(starts.alias("a"), ends.alias("b"))).alias("s"))
    body = F.array_join(F.transform(F.slice("lines", F.col("s.a") + 1, F.col("s.b") - F.col("s.a") + 1), lambda x: x["body"]), " ")
    # A message that is there twice quotes once.
    passages = quoting.select("conv_id", "turn", F.col("s.a").alias("passage"), F.get(F.col("lines"), F.col("s.a"))["level"].alias("level"), _words(body).alias("w"))
    quoted = passages.select("conv_id", "turn", "passage", "level", F.explode(_windows(F.col("w"))).alias("window")).distinct()
    quoted = scratch.write(quoted.where("conv_id is not null and turn is not null").withColumn("h", F.xxhash64("conv_id", "window")), "quoted")

    # Earlier messages' windows, of conversations with quotes only: of the whole text, and of lines shorter than a window.
    asked = quoted.select("conv_id").distinct()
    own = rows.select("conv_id", "turn", "own").where("own is not null and turn is not null").join(asked, "conv_id", "left_semi")
    short = F.filter(F.transform(F.split("own", "\n"), _words), lambda w: (F.size(w) > 0) & (F.size(w) < WINDOW))
    windows = F.array_union(_windows(_words(F.col("own"))), F.transform(short, lambda w: F.array_join(w, " ")))
    held = own.select("conv_id", F.col("turn").alias("source_turn"), F.explode(windows).alias("window")).distinct().withColumn("h", F.xxhash64("conv_id", "window"))
    held = scratch.write(held.join(quoted.select("conv_id", "h", "window").distinct(), ["conv_id", "h", "window"], "left_semi"), "held")
    near = quoted.join(_holders_before(quoted, held), ["conv_id", "h", "window", "turn"]).withColumn("source_turn", F.explode(F.array("low", "high")))
    one = ["conv_id", "turn", "passage"]
    ends = scratch.write(_counted(quoted, held, near.select(*one, "source_turn").distinct()), "ends")
    further = _counted(quoted, held, _between(quoted, held, ends, near))
    counted = ends.unionByName(further)
    best = counted.groupBy("conv_id", "turn", "passage", "level").agg(F.max(F.struct("n", "source_turn")).alias("x"))
    return scratch.write(best.select("conv_id", "turn", "passage", "level", "x.source_turn", "x.n"), "links")


def _counted(quoted: DataFrame, held: DataFrame, candidates: DataFrame) -> DataFrame:
    """How many windows of a passage each candidate holds."""
    found = quoted.join(candidates, ["conv_id", "turn", "passage"]).join(held, ["conv_id", "h", "window", "source_turn"])
    return found.groupBy("conv_id", "turn", "passage", "level", "source_turn").agg(F.count("*").alias("n"))


def _between(quoted: DataFrame, held: DataFrame, ends: DataFrame, near: DataFrame) -> DataFrame:
    """(conv_id, turn, passage, source_turn): all messages that may hold more of a passage than first and last holders do, or as much and later.

    No message later than the earliest of a passage's last holders has all windows, so that one settles it, if it has.
    Else, with ``n`` of a passage's windows in the best so far, whoever holds as many lacks the others at most: of any
    one window more than these it holds one. The rarest so many name all candidates, so frequent windows name few.
    """
    one = ["conv_id", "turn", "passage"]
    most = ends.groupBy(*one).agg(F.max(F.struct("n", "source_turn")).alias("_x"))
    last = near.groupBy(*one, "h", "window").agg(F.max("source_turn").alias("_high")).groupBy(*one).agg(F.min("_high").alias("_high"))
    sizes = quoted.groupBy(*one).agg(F.count("*").alias("_size"))
    left = sizes.join(most, one).join(last, one).where("_x.n < _size or _x.source_turn < _high").select(*one, (F.col("_size") - F.col("_x.n") + 1).alias("_least"))
    holders = held.groupBy("conv_id", "h", "window").agg(F.count("*").alias("_holders"))
    asked = quoted.join(left, one).join(holders, ["conv_id", "h", "window"], "left")
    rare = F.row_number().over(Window.partitionBy(*one).orderBy(F.coalesce("_holders", F.lit(0)), "h", "window"))
    asked = asked.withColumn("_r", rare).where("_r <= _least").select(*one, "h", "window")
    return asked.join(held, ["conv_id", "h", "window"]).where("source_turn < turn").select(*one, "source_turn").distinct()


def _holders_before(quoted: DataFrame, held: DataFrame) -> DataFrame:
    """(conv_id, h, window, turn, low, high): the first and the last message before a quote that hold one of its windows.

    An as-of join in two steps, so that a window which very many messages of one conversation hold and quote is many
    groups: within a stretch of turns by a window over the stretch, and before it by the stretches' own ends.
    """
    by = ["conv_id", "h", "window"]
    stretch = F.floor(F.col("turn") / STRETCH).alias("_b")
    marks = held.select(*by, F.col("source_turn").alias("turn"), F.col("source_turn").alias("src")).unionByName(quoted.select(*by, "turn", F.lit(None).cast("long").alias("src")).distinct()).select("*", stretch)
    before = F.max("_high").over(Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    ends = marks.groupBy(*by, "_b").agg(F.max("src").alias("_high"), F.min("src").alias("_low"))
    ends = ends.select(*by, "_b", before.alias("_before"), F.min("_low").over(Window.partitionBy(*by)).alias("low"))
    inside = F.max("src").over(Window.partitionBy(*by, "_b").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1))
    asked = marks.withColumn("_inside", inside).where("src is null").join(ends, [*by, "_b"])
    return asked.select(*by, "turn", "low", F.coalesce("_inside", "_before").alias("high")).where("low < turn")


def reply_order(parents: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, turn, parent_turn, root_turn, depth, position) of all messages that have a parent or a reply.

    A tour of a thread enters a message, then its replies by turn, then leaves it. Every step of the tour points at the
    one before it, and pointer doubling adds up what lies before: messages entered (position in the thread) and entered
    but not left (depth). Two rows a message in every round, however deep or wide a thread is.
    """
    one = ["conv_id", "parent_turn"]
    kids = parents.select(*one, "turn", F.floor(F.col("turn") / STRETCH).alias("_b"))
    last = kids.groupBy(*one, "_b").agg(F.max("turn").alias("_last"))
    before = last.select(*one, "_b", F.lag("_last").over(Window.partitionBy(*one).orderBy("_b")).alias("_before"))
    inside = kids.withColumn("_inside", F.lag("turn").over(Window.partitionBy(*one, "_b").orderBy("turn")))
    placed = inside.join(before, [*one, "_b"]).select("conv_id", "turn", "parent_turn", F.coalesce("_inside", "_before").alias("elder"))
    youngest = last.groupBy(*one).agg(F.max("_last").alias("youngest")).withColumnRenamed("parent_turn", "turn")
    messages = scratch.write(placed.join(youngest, ["conv_id", "turn"], "full"), "messages")

    step = lambda turn, left: F.struct(F.col(turn).alias("turn"), F.lit(left).alias("left"))
    enter = F.struct(step("turn", False).alias("at"), F.when(F.col("elder").isNotNull(), step("elder", True)).when(F.col("parent_turn").isNotNull(), step("parent_turn", False)).alias("back"), F.lit(1).cast("long").alias("entered"), F.lit(1).cast("long").alias("open"))
    leave = F.struct(step("turn", True).alias("at"), F.when(F.col("youngest").isNotNull(), step("youngest", True)).otherwise(step("turn", False)).alias("back"), F.lit(0).cast("long").alias("entered"), F.lit(-1).cast("long").alias("open"))
    tour = messages.select("conv_id", F.explode(F.array(enter, leave)).alias("x")).select("conv_id", "x.*")
    tour = scratch.write(tour.withColumn("root_turn", F.when(F.col("back").isNull(), F.col("at.turn"))), "tour0")
    k = 0
    while not tour.where("back is not null").isEmpty():
        earlier = tour.select("conv_id", F.col("at").alias("back"), F.col("back").alias("_back"), F.col("entered").alias("_entered"), F.col("open").alias("_open"), F.col("root_turn").alias("_root"))
        further = tour.where("back is not null").join(earlier, ["conv_id", "back"])
        further = further.select("conv_id", "at", F.col("_back").alias("back"), (F.col("entered") + F.col("_entered")).alias("entered"), (F.col("open") + F.col("_open")).alias("open"), F.col("_root").alias("root_turn"))
        k += 1
        tour = scratch.write(further.unionByName(tour.where("back is null")), f"tour{k}")
        scratch.drop(f"tour{k - 1}")
    places = tour.where("not at.left").select("conv_id", "at.turn", "root_turn", (F.col("open") - 1).alias("depth"), (F.col("entered") - 1).alias("position"))
    return places.join(messages.select("conv_id", "turn", "parent_turn"), ["conv_id", "turn"])


def quote_threads(messages: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """A row per message: its own text without quotes, what it quotes, and where it stands in its thread.

    Columns: conv_id, turn, role, n_quoted_lines, max_level, n_passages, n_linked (passages found
    in an earlier message), parent_turn (null: starts a thread), root_turn, depth, position (in the
    thread, from 0; see ``in_reply_order``), text. Null texts have null own text and quote nothing. Messages with the same conversation
    and turn share one place and are all returned. A null conversation or turn links nothing. Of
    equal sources the latest counts. A conversation's messages are never gathered: a third of all
    messages may lie in one, as all joins carry the window beside the conversation.
    """
    scratch = scratch or Scratch(messages.sparkSession, "quotes")
    rows = parsed(messages, conv, turn, role, text)
    links = quote_links(rows, scratch)
    by_source = links.where("level = 1").groupBy("conv_id", "turn", "source_turn").agg(F.sum("n").alias("n"))
    parents = by_source.groupBy("conv_id", "turn").agg(F.max_by("source_turn", F.struct("n", "source_turn")).alias("parent_turn"))
    counts = links.groupBy("conv_id", "turn").agg(F.count_distinct("passage").alias("n_linked"))
    facts = scratch.write(reply_order(parents, scratch).join(counts, ["conv_id", "turn"], "full"), "facts")
    scratch.drop("quoted", "held", "ends", "links", "messages")
    level = F.transform(F.coalesce("lines", F.array()), lambda x: x["level"])
    return (
        rows.select("conv_id", "turn", "role", F.size(F.filter(level, lambda x: x > 0)).cast("long").alias("n_quoted_lines"), F.coalesce(F.array_max(level), F.lit(0)).cast("long").alias("max_level"), F.coalesce(F.size(_bounds(F.col("lines"))[0]), F.lit(0)).cast("long").alias("n_passages"), F.col("own").alias("text"))
        .join(facts, ["conv_id", "turn"], "left")
        .select(
            "conv_id", "turn", "role", "n_quoted_lines", "max_level", F.greatest("n_passages", F.lit(0)).cast("long").alias("n_passages"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
            "parent_turn", F.coalesce("root_turn", "turn").alias("root_turn"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("depth", "position")], "text",
        )
    )


def in_reply_order(threads: DataFrame) -> DataFrame:
    """Conversations without quotes, message after message: sorted over ranges, so that a conversation of any size is many tasks."""
    return threads.orderBy("conv_id", "root_turn", "position")


_SQL_WORDS = "list_filter(string_split(regexp_replace(lower({}), '[\\s[:punct:]]+', ' ', 'g'), ' '), lambda x: x <> '')"
_SQL_WINDOWS = f"CASE WHEN len({{0}}) > 0 THEN list_distinct(list_transform(range(1, greatest(len({{0}}) - {WINDOW - 2}, 2)), lambda i: array_to_string({{0}}[i:i + {WINDOW - 1}], ' '))) ELSE [] END"

#: The same for DuckDB: windows by their text, paths by recursion.
SQL = f"""
WITH RECURSIVE raw AS (SELECT conv_id, turn, role, string_split(text, chr(10)) AS raw FROM conversations),
lines AS (
  SELECT conv_id, turn, role, raw IS NULL AS missing, list_transform(raw, lambda x: {{'level': length(regexp_replace(regexp_extract(x, '^\\s*((?:>\\s?)+)', 1), '[^>]', '', 'g')),
         'body': regexp_replace(x, '^\\s*((?:>\\s?)+)', '')}}) AS l FROM raw),
flat AS (SELECT conv_id, turn, i, l[i].level AS level, l[i].body AS body, coalesce(l[i + 1].level, 0) AS below, coalesce(l[i - 1].level, 0) AS above
         FROM (SELECT conv_id, turn, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT DISTINCT conv_id, turn, l FROM lines))),
own AS (SELECT conv_id, turn, i, body FROM flat
        WHERE level = 0 AND NOT (regexp_matches(body, '^\\s*(On .*wrote|Am .*schrieb.*|Le .*a écrit|El .*escribió)\\s*:\\s*$') AND below > 0)),
texts AS (SELECT conv_id, turn, string_agg(body, chr(10) ORDER BY i) AS text FROM own GROUP BY ALL),
whole AS (SELECT conv_id, turn, {_SQL_WORDS.format("text")} AS w FROM texts),
parts AS (SELECT conv_id, turn, {_SQL_WORDS.format("body")} AS w FROM own),
held AS (SELECT DISTINCT conv_id, turn AS source_turn, win FROM (
  SELECT conv_id, turn, unnest({_SQL_WINDOWS.format("w")}) AS win FROM whole UNION ALL
  SELECT conv_id, turn, array_to_string(w, ' ') FROM parts WHERE len(w) BETWEEN 1 AND {WINDOW - 1})),
marked AS (SELECT *, sum((level <> above)::INT) OVER (PARTITION BY conv_id, turn ORDER BY i) AS passage FROM flat),
bodies AS (SELECT conv_id, turn, passage, level, {_SQL_WORDS.format("string_agg(body, ' ' ORDER BY i)")} AS w FROM marked WHERE level > 0 GROUP BY conv_id, turn, passage, level),
quoted AS (SELECT conv_id, turn, passage, level, unnest({_SQL_WINDOWS.format("w")}) AS win FROM bodies),
cand AS (SELECT DISTINCT q.conv_id, q.turn, q.passage, h.source_turn FROM quoted q JOIN held h ON h.conv_id = q.conv_id AND h.win = q.win AND h.source_turn < q.turn),
counted AS (SELECT q.conv_id, q.turn, q.passage, q.level, c.source_turn, count(*) AS n FROM quoted q JOIN cand c USING (conv_id, turn, passage) JOIN held h ON h.conv_id = q.conv_id AND h.win = q.win AND h.source_turn = c.source_turn GROUP BY ALL),
links AS (SELECT * FROM counted QUALIFY row_number() OVER (PARTITION BY conv_id, turn, passage, level ORDER BY n DESC, source_turn DESC) = 1),
parents AS (SELECT conv_id, turn, source_turn AS parent_turn FROM (SELECT conv_id, turn, source_turn, sum(n) AS n FROM links WHERE level = 1 GROUP BY ALL)
            QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY n DESC, source_turn DESC) = 1),
paths AS (
  SELECT m.conv_id, m.turn, [m.turn] AS path FROM (SELECT DISTINCT conv_id, turn FROM conversations) m ANTI JOIN parents USING (conv_id, turn)
  UNION ALL
  SELECT p.conv_id, p.turn, list_append(paths.path, p.turn) FROM parents p JOIN paths ON p.conv_id = paths.conv_id AND p.parent_turn = paths.turn),
places AS (SELECT conv_id, turn, path, row_number() OVER (PARTITION BY conv_id, path[1] ORDER BY path) - 1 AS position FROM paths),
counts AS (SELECT conv_id, turn, count(DISTINCT passage) AS n_linked FROM links GROUP BY ALL),
facts AS (SELECT conv_id, turn, sum((level > 0)::INT) AS q, max(level) AS m, sum((level > 0 AND level <> above)::INT) AS p FROM flat GROUP BY ALL)
SELECT l.conv_id, l.turn, l.role, coalesce(f.q, 0)::BIGINT AS n_quoted_lines, coalesce(f.m, 0)::BIGINT AS max_level, coalesce(f.p, 0)::BIGINT AS n_passages,
       coalesce(c.n_linked, 0)::BIGINT AS n_linked, path[len(path) - 1] AS parent_turn, coalesce(path[1], l.turn) AS root_turn, coalesce(len(path) - 1, 0)::BIGINT AS depth,
       coalesce(position, 0)::BIGINT AS position,
       CASE WHEN l.missing THEN NULL ELSE coalesce(t.text, '') END AS text
FROM lines l LEFT JOIN facts f USING (conv_id, turn) LEFT JOIN counts c USING (conv_id, turn) LEFT JOIN places USING (conv_id, turn) LEFT JOIN texts t USING (conv_id, turn)
"""
