"""Text operators against brute force, and their defined results on odd rows."""

import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gridlens.llm import html_extract, kneser_ney, line_dedup, mixing, near_dup, quality_fm, quality_rules, quotes, sharding
from gridlens.llm.shared import Scratch

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def odd_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows."""
    long = " ".join(f"w{k % 997}" for k in range(60_000))
    text = "the cat sat on the mat and it was a good day for all of them in that house by the sea with a dog"
    return [
        (1, text, "en", "a", 10), (2, text, "en", "a", 10), (2, text, "en", "a", 10), (3, None, "en", "b", None), (4, "", None, None, 0),
        (None, text + " x", "en", "a", 5), (5, " \t\n ", "fr", "b", 4), (6, long, "en", "b", len(long)), (7, "two words", "de", "a", 9), (8, "two words", "de", "a", 9), (9, "été à Ünï | <b>", "fr", None, 3),
    ]


@pytest.fixture(scope="module")
def odd(spark):
    """The odd rows with columns whose names clash with the operators' own."""
    df = spark.createDataFrame(odd_rows(), SCHEMA)
    for name in ("id", "k1", "n", "region", "key", "size", "h", "w", "shard", "score", "label", "lines", "chunks"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def brute_components(rows, size, percent):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_match_brute_force(documents, size, percent):
    want = brute_components([(r["doc_id"], r["text"]) for r in documents.collect()], size, percent)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dup.near_duplicates(documents, size=size, percent=percent).collect()}
    assert got == {i: (n, c, i == c) for i, (n, c) in want.items()}


def test_near_duplicates_settle_a_crowded_region(spark):
    """Hundreds of edits of one text: far more than a region's crowd, with links only between some."""
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(160):
        t = list(base)
        for k in rng.choice(60, rng.integers(0, 5), replace=False):
            t[k] = f"x{rng.integers(0, 10_000)}"
        rows.append((i, " ".join(t)))
    want = brute_components(rows, 3, 85)
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=3, percent=85, crowd=8).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: c for i, (_, c) in want.items()}


def test_near_duplicates_settle_pairs_in_a_template_crowd(spark):
    """Hundreds of texts share a template in every tree; isolated pairs at the least similarity are among them."""
    rng = np.random.default_rng(5)
    template, rows = [f"t{k}" for k in range(70)], []
    for i in range(300):
        own = [f"o{i}x{k}" for k in range(30)]
        rows.append((2 * i, " ".join(template + own)))
        if i % 3 == 0:  # one word changed: 3 of 98 shingles, or two: 6 of 98
            t = template + own
            for k in rng.choice(np.arange(75, 95, 4), 1 + i % 2, replace=False):
                t[k] = f"n{i}"
            rows.append((2 * i + 1, " ".join(t)))
    want = brute_components(rows, 3, 85)
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=3, percent=85, crowd=4).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: c for i, (_, c) in want.items()}
    assert sum(i != c for i, (_, c) in want.items()) == 100


def test_near_duplicates_of_rows_that_share_an_id(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(5, a), (5, b), (7, a + " more"), (3, b), (9, c), (9, c)]
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=3, percent=85).collect())
    assert got == [(3, 38, 3, True), (5, 38, 3, False), (5, 38, 5, True), (7, 39, 5, False), (9, 38, 9, True), (9, 38, 9, True)]


def test_near_duplicates_on_odd_rows(odd, empty):
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_shingles"], r["component_id"], r["kept"]) for r in near_dup.near_duplicates(odd, size=3, percent=85).collect())
    by = {r[1]: r for r in got if r[0]}
    assert len(got) == 11 and got[0][0] is False and got[0][3] is None and got[0][4]
    assert by[2][3] == 1 and not by[2][4] and by[8][3] == 7 and by[3][2:] == (0, 3, True) and by[4][2:] == (0, 4, True) and by[5][2:] == (0, 5, True)
    assert near_dup.near_duplicates(empty, size=3, percent=85).count() == 0


def test_quotes(spark):
    rows = [
        (1, 0, "a", "Hello there\nHow are you today?"),
        (1, 1, "b", "On Monday a wrote:\n> How  are you, today?\nFine."),
        (1, 2, "a", "> Fine.\n>> How are you today?\n> nonsense never said\nGood!"),
        (1, 3, "c", "No quote"),
        (2, 0, "a", None), (2, 1, None, ""), (None, 0, "a", "> x"), (3, 5, "a", "> Fine."), (3, 5, "a", "> Fine."),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("lines", F.lit("clash"))
    got = quotes.quote_threads(df).collect()
    by = {(r["conv_id"], r["turn"]): r for r in got}
    assert len(got) == len(rows)
    assert by[1, 1]["parent_turn"] == 0 and by[1, 1]["text"] == "Fine." and by[1, 1]["n_passages"] == 1
    assert by[1, 2]["parent_turn"] == 1 and by[1, 2]["depth"] == 2 and [by[1, k]["position"] for k in range(4)] == [0, 1, 2, 0] and [by[1, k]["root_turn"] for k in range(4)] == [0, 0, 0, 3] and by[1, 2]["max_level"] == 2
    assert by[1, 2]["n_linked"] == 2 and by[1, 2]["n_quoted_lines"] == 3 and by[1, 2]["text"] == "Good!"
    assert by[1, 3]["parent_turn"] is None and by[1, 3]["depth"] == 0
    assert by[2, 0]["text"] is None and by[2, 1]["text"] == "" and by[3, 5]["n_linked"] == 0 and by[None, 0]["n_linked"] == 0
    assert quotes.quote_threads(df.limit(0)).count() == 0


def test_quotes_of_the_given_conversations(spark, tmp_path):
    """Replies made of the given turns: three levels, wrapped anew, 7-digit turns, a hot conversation; against DuckDB and the known parent."""
    import textwrap

    from compare import assert_same

    import duckdb

    rng = np.random.default_rng(6)
    given = [r["text"] for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect()]
    rows, parent = [], {}
    for conv, size in ((1, 60), (2, 5), (3, 4)):
        said: list[str] = []
        for k in range(size):
            turn, own = 999_990 + k, given[len(rows)] if k != 3 else "Thanks a lot.\nI agree."
            text = own
            if k and rng.random() < 0.8:
                up = int(rng.integers(0, k))
                parent[conv, turn] = 999_990 + up
                wrapped = [y for x in said[up].split("\n") for y in (textwrap.wrap(x, 50) if not x.startswith(">") and x.strip() else [x])]
                kept = [x for x in wrapped if not x.startswith(">>>")]
                text = "On Monday somebody wrote:\n" + "\n".join(f">{x}" if x.startswith(">") else f"> {x}" for x in kept) + "\n" + own
            said.append("\n".join(x for x in text.split("\n") if not x.startswith("On Monday")))
            rows.append((conv, turn, "user", text))
    rows.append(rows[5])
    path = str(tmp_path / "conversations.parquet")
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.write.parquet(path)
    got = {(r["conv_id"], r["turn"]): r for r in quotes.quote_threads(df).collect()}
    assert max(r["max_level"] for r in got.values()) >= 3 and sum(got[k]["parent_turn"] == up for k, up in parent.items()) >= 0.95 * len(parent)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}/*.parquet'")
    assert_same(quotes.quote_threads(df), con, quotes.SQL)


def brute_order(parents):
    """(conv, turn): root, depth, position, by walking every thread with a stack."""
    children, out = {}, {}
    for (conv, turn), up in sorted(parents.items()):
        children.setdefault((conv, up), []).append(turn)
    for conv, root in sorted(set(children) - set(parents)):
        stack, position = [(root, 0)], 0
        while stack:
            turn, depth = stack.pop()
            out[conv, turn] = root, depth, position
            position += 1
            stack += [(k, depth + 1) for k in reversed(children.get((conv, turn), []))]
    return out


def test_reply_order_equals_a_walk_of_every_thread(spark):
    """Random threads, turns far apart, a message with 9,000 replies and a chain of 20,000."""
    rng = np.random.default_rng(4)
    parents = {(c, 5000 * k): 5000 * int(rng.integers(0, k)) for c in range(6) for k in range(1, 40) if rng.random() < 0.8}
    parents |= {(7, k): 0 for k in range(1, 9001)} | {(8, k): k - 1 for k in range(1, 20_000)}
    df = spark.createDataFrame([(c, t, up) for (c, t), up in parents.items()], "conv_id long, turn long, parent_turn long")
    scratch = Scratch(spark, "order")
    got = quotes.reply_order(df, scratch).collect()
    assert {(r["conv_id"], r["turn"]): (r["root_turn"], r["depth"], r["position"]) for r in got} == brute_order(parents)
    assert all(parents.get((r["conv_id"], r["turn"])) == r["parent_turn"] for r in got)
    assert quotes.reply_order(df.limit(0), scratch).count() == 0


def test_conversations_in_reply_order(spark):
    said = [f"the plan number {k} is to meet at noon by the old bridge then" for k in range(4)]
    rows = [(1, 0, "a", said[0]), (1, 1, "b", said[1]), (1, 2, "c", f"> {said[0]}\n{said[2]}"), (1, 3, "d", f"> {said[1]}\nYes."), (1, 4, "e", f"> {said[0]}\nNo."), (1, 5, "f", f"> {said[2]}\nWhy?"), (None, 6, "g", "x"), (2, None, "h", None)]
    got = quotes.in_reply_order(quotes.quote_threads(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    assert [(r["conv_id"], r["turn"]) for r in got] == [(None, 6), (1, 0), (1, 2), (1, 5), (1, 4), (1, 1), (1, 3), (2, None)]
    assert [r["text"] for r in got][1:5] == [said[0], said[2], "Why?", "No."]


def test_the_parent_is_the_message_that_holds_most_of_a_quote(spark):
    greeting, b, c = "hello dear all of you in the group today and tomorrow", "the plan is to meet at noon by the old bridge then", "and bring a coat because the evening will be cold outside"
    rows = [(1, 1, "a", f"{greeting}\n{b}"), (1, 5, "b", f"{greeting}\n{b}\n{c}"), (1, 7, "c", "> " + " ".join((greeting, b, c)) + "\nYes.")]
    got = {r["turn"]: r for r in quotes.quote_threads(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[7]["parent_turn"] == 5 and got[7]["n_passages"] == got[7]["n_linked"] == 1


def test_the_source_may_be_neither_first_nor_last_holder(spark, tmp_path):
    """A message between the first and the last holders of every window holds most; also at random, against DuckDB over all holders."""
    from compare import assert_same

    import duckdb

    rng = np.random.default_rng(26)
    parts = [" ".join(f"w{k}x{j}" for j in range(9)) for k in range(6)]
    rows = [(1, t, "a", text) for t, text in enumerate((parts[0], parts[1], f"{parts[1]}\n{parts[0]}", parts[0], parts[1], f"> {parts[0]} {parts[1]}\nYes."))]
    for t in range(60):
        some = [parts[k] for k in rng.permutation(6)[: rng.integers(1, 5)]]
        rows.append((2, t, "a", "\n".join(some) if t % 3 else f"> {' '.join(some)}\nNo {t}."))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    got = quotes.quote_threads(df)
    assert next(r["parent_turn"] for r in got.collect() if (r["conv_id"], r["turn"]) == (1, 5)) == 2
    assert_same(got, con, quotes.SQL)


def test_a_quote_comes_from_a_message_before_it(spark):
    said = "the plan is to meet at noon by the old bridge then"
    rows = [(1, 1, "a", said), (1, 3, "b", f"So: {said}\n{said}"), (1, 5, "c", f"> {said}\nYes."), (1, 9, "d", said), (1, 12_000, "e", f"> {said}\nStill."), (1, 12_001, "f", said)]
    got = {r["turn"]: r for r in quotes.quote_threads(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[5]["parent_turn"] == 3 and got[12_000]["parent_turn"] == 9 and got[1]["parent_turn"] is None


def _x64(data, seed=42):
    v = xxhash.xxh64_intdigest(data, seed)
    return v - 2**64 if v >= 2**63 else v


def brute_chunks(rows, long_words=50):
    """Removed lines by text alone: units are two neighbouring lines with a word, and single long lines."""
    seen, units = {}, {}
    for i, t in sorted(set(rows), key=lambda r: (r[0], _x64(r[1].encode()))):
        lines = [(k, x) for k, x in enumerate(t.split("\n")) if words(x)]
        here = [((x, y), k, j) for (k, x), (j, y) in zip(lines, lines[1:], strict=False)] + [((x,), k, k) for k, x in lines if len(words(x)) >= long_words]
        units[i, t] = here
        for unit, k, _ in here:
            seen.setdefault(unit, []).append((i, _x64(t.encode()), k))
    out = {}
    for (i, t), here in units.items():
        gone = {k for unit, a, b in here if min(seen[unit]) != (i, _x64(t.encode()), a) for k in range(a, b + 1)}
        out[i, t] = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone), len(gone)
    return out


def test_line_chunks_match_brute_force(documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    want = brute_chunks(rows)
    got = {r["doc_id"]: (r["text"], r["n_removed_lines"]) for r in line_dedup.line_dedup(documents).collect()}
    assert got == {i: x for (i, _), x in want.items()} and sum(n for _, n in got.values()) > 50


def test_line_chunks_of_rows_that_share_an_id(spark):
    a, b = ("\n".join(f"{x} line {k}" for k in range(60)) for x in "ab")
    rows = [(1, a), (1, b), (1, b), (2, "\n".join(a.split("\n")[10:30]) + "\nnew"), (3, "x\ny\nx\ny\nx"), (0, "z\n\na line 3\n\na line 4\n\nq")]
    want = brute_chunks(rows)
    got = sorted((r["doc_id"], r["text"], r["n_removed_lines"]) for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted((i, *want[i, t]) for i, t in rows)
    assert dict((i, t) for i, t, _ in got)[2] == "new" and (0, rows[-1][1], 0) in got


@pytest.mark.parametrize("n", [1, 2, 3, 5, 12])
def test_whole_passages_go(spark, n):
    """Passages of one long line, or of a few lines, between other lines: all of it goes wherever it stands again, nothing else does."""
    passage = "\n".join(" ".join(f"p{k}w{j}" for j in range(55 if n == 1 else 12)) for k in range(n))
    rows = [(d, "\n".join([f"head {d} {k}" for k in range(d % 3)] + [passage] + [f"tail {d} {k}" for k in range(3)])) for d in range(8)]
    got = {r["doc_id"]: r for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for d, t in rows:
        assert got[d]["text"] == (t if d == 0 else "\n".join(x for x in t.split("\n") if x not in passage.split("\n"))) and got[d]["n_removed"] == (d > 0)


def test_line_chunks_on_odd_rows(odd, empty):
    got = line_dedup.line_dedup(odd).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 11 and by[3]["text"] is None and by[3]["n_lines"] == 0 and by[4]["text"] == "" and by[4]["n_lines"] == 1
    assert {r["doc_id"] for r in got if r["n_removed"]} == set() and line_dedup.line_dedup(empty).count() == 0


def test_minimax_shards_are_optimal(spark, documents):
    got = sharding.minimax_shards(documents).toPandas()
    text = {r["doc_id"]: r["text"] for r in documents.collect()}
    got["text"] = got.doc_id.map(text)
    assert (got["size"] == got.text.map(lambda t: len(t.encode()) + 1)).all() and (got.text_crc32 == got.text.map(lambda t: zlib.crc32(t.encode()))).all()
    assert got.groupby("text").shard.nunique().max() == 1 and set(got.law) == {"bytes"}
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    key = got.text.map(lambda t: _x64(t.encode()))
    sizes = got.assign(key=key).groupby("key")["size"].sum().sort_index().tolist()
    assert sharding.pack(sizes, got.groupby("shard")["size"].sum().max(), 16)[1]
    assert got.groupby("shard")["size"].sum().max() == sharding.least_capacity(sizes, 16)
    assert (got.assign(key=key).sort_values("key").shard.diff().fillna(0) >= 0).all()


@pytest.mark.parametrize("seed", range(6))
def test_least_capacity_and_cuts(seed):
    rng = np.random.default_rng(seed)
    sizes = [int(x) for x in rng.integers(1, 50, 60)] + [400] * (seed % 2)
    c = sharding.least_capacity(sizes, 7)
    assert sharding.pack(sizes, c, 7)[1] and not sharding.pack(sizes, c - 1, 7)[1]
    cuts, _ = sharding.even_cuts(sizes, c, 7)
    parts = [sum(sizes[a:b]) for a, b in zip([0, *cuts], [*cuts, len(sizes)], strict=True)]
    assert sum(parts) == sum(sizes) and max(parts) <= c


def test_shards_on_odd_rows(odd, empty):
    got = sharding.minimax_shards(odd).collect()
    assert len(got) == 11 and {r["size"] for r in got if r["doc_id"] in (3, 4)} == {1}
    assert [r["text_crc32"] for r in got if r["doc_id"] == 3] == [None] and all(0 <= r["shard"] < 16 for r in got)
    assert sharding.minimax_shards(empty).count() == 0


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""), ("", ""), ("plain &amp; simple &eacute;", "plain & simple é"),
        ("<nav><ul><li><a href=x>Menu</a></li></ul></nav><article><h1>T</h1><p><b>One<br>two.<p>Three &lt;x&gt;\n four</article><footer>foot</footer>", "T\n\nOne two.\n\nThree <x> four"),
        ("<article><p>a<script>var t='</p>';</script>b</p><aside>side</aside><div class='comments'><p>c</p></div><p>d</p></article>", "ab\n\nd"),
        ("<div id=cookie-notice>We use cookies</div><div><p>" + "the of and to " * 12 + "</p><p>Short one.</p></div><div class=sidebar><p>no</p></div>", ("the of and to " * 12).strip() + "\n\nShort one."),
        ("<p>cut off <a href='x", "cut off"), ("<!-- never closed <p>x</p>", ""), ("<article></p></div><p>stray</article>", "stray"),
    ],
)
def test_main_text(page, want):
    assert html_extract.main_text(page) == want


def test_main_text_weighs_articles_beside_links_and_length():
    text = "The main text of the page stands here and it is as long as a paragraph that was written by one of us for all of you. " * 3
    text = text.strip()
    card = '<article><h2><a href="/x">Another story</a></h2><p>It is about the sea and the ships that were in the harbour.</p></article>'
    assert html_extract.main_text(f"<div><p>{text}</p><p>Short end.</p></div><section>{card * 3}</section>") == f"{text}\n\nShort end."
    links = "<ul>" + "".join(f'<li><a href="/{k}">Story number {k} of the list</a></li>' for k in range(4)) + "</ul>"
    assert html_extract.main_text(f"<article><h1>Title</h1><p>{text}</p><p>Short end.</p>{links}<p>{text}</p></article>") == f"Title\n\n{text}\n\nShort end.\n\n{text}"
    assert html_extract.main_text(f"<p>{text}</p>{links}") == text
    assert html_extract.main_text(f"<main><h1>Title</h1><article><p>{text}</p></article></main><div>Posted at noon</div>") == f"Title\n\n{text}"


LONG_TEXT = ("It was the first of the days that they had all been waiting for in the house by the sea. " * 4).strip()


@pytest.mark.parametrize(
    "page",
    [
        f'<main class="content with-sidebar"><p>{LONG_TEXT}</p></main>', f'<article class="post no-comments"><p>{LONG_TEXT}</p></article>',
        f"<article><svg/><p>{LONG_TEXT}</p></article>", f"<article><canvas id=c><p>{LONG_TEXT}</p></article>", f"<article><video src=x><p>{LONG_TEXT}</p></article>",
        f"<article><svg><svg><text>label</text></svg><text>more</text></svg><p>{LONG_TEXT}</p></article>",
        f'<body class="has-sidebar"><div class="body"><p>{LONG_TEXT}</p></div><div><article><a href=x>Another story</a></article></div></body>',
        f'<article><p>{LONG_TEXT}</p></article><div class="ad-banner"><p>{LONG_TEXT}</p></div><script>x = "<p>{LONG_TEXT}</p>"',
    ],
)
def test_nothing_else_is_dropped(page):
    assert html_extract.main_text(page) == LONG_TEXT


def test_pages_give_the_same_text_without_article_tags(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    for r in pages:
        plain = re.sub(r"<(/?)(article|main)\b", r"<\1div", r["html"])
        assert html_extract.main_text(plain) == html_extract.main_text(r["html"])


def test_odd_pages(spark):
    rows = [(1, "u", None), (1, "u", None), (2, None, ""), (None, "u", f"<p>{LONG_TEXT}</p>"), (3, "u", f"<p>{LONG_TEXT}</p>" * 3000), (4, "u", "<p>" + "x" * 2_000_000)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("n_chars", F.lit("clash"))).collect()
    assert sorted(r["n_chars"] for r in got) == sorted([0, 0, 0, len(LONG_TEXT), 3000 * (len(LONG_TEXT) + 2) - 2, 2_000_000])


def test_extraction_of_all_pages(spark):
    import html

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    source = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in html_extract.extract(pages.withColumn("text", F.lit("clash"))).collect():
        inner = re.search(r"<article>(.*)</article>", source[r["page_id"]], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert r["text"] == "\n\n".join(x for x in parts if x) and r["n_chars"] == len(r["text"])
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_machine_learns_and_keeps_to_its_contract(spark, documents, odd, empty):
    sf = SF.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = quality_fm.classify(spark.read.parquet(f"{sf}/documents.parquet"), labels, metadata=("n_chars",)).toPandas()
    assert len(got) == 1000 and got.score.between(0, 1).all() and ((got.score >= 0.3) == (got.predicted == 1)).all()
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    m = got.merge(labels.toPandas(), on="doc_id")
    held = m[m.held_out]
    good, bad = held.score[held.quality == 1].to_numpy(), held.score[held.quality == 0].to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.95 and (good >= 0.3).mean() > 0.97
    assert quality_fm.classify(odd, labels, metadata=("n_chars",)).count() == 11
    assert quality_fm.classify(empty, labels, metadata=("n_chars",)).count() == 0
    assert quality_fm.classify(odd, labels.limit(0), metadata=("n_chars",)).select("score").distinct().count() == 1


def test_machine_margin_equals_all_pairs():
    rng = np.random.default_rng(1)
    m = quality_fm.Machine(0.3, rng.normal(size=quality_fm.BUCKETS + 2), rng.normal(size=(quality_fm.BUCKETS + 2, quality_fm.FACTORS)), np.zeros(2), np.ones(2))
    buckets, stats = np.array([3, 70, 900], np.uint16), np.array([[0.5, -1.0]])
    x = np.zeros(quality_fm.BUCKETS + 2)
    x[buckets], x[-2:] = 1 / np.sqrt(3), stats[0]
    at = np.flatnonzero(x)
    want = 0.3 + m.w @ x + sum(m.v[i] @ m.v[j] * x[i] * x[j] for a, i in enumerate(at) for j in at[a + 1 :])
    assert np.isclose(m._margin(*quality_fm._packed([buckets]), stats)[0][0], want)


def brute_rules(t):
    w = re.findall(r"[^\x20\x09-\x0d]+", t or "")
    grams = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
    twice = {g for g in grams if grams.count(g) > 1} if len(grams) < 400 else None
    if twice is None:
        from collections import Counter

        twice = {g for g, n in Counter(grams).items() if n > 1}
    covered = {k + j for k, g in enumerate(grams) if g in twice for j in range(8)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered))


def test_rules_match_brute_force(spark, documents, odd, empty):
    cols = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for df in (documents, odd, spark.createDataFrame([(1, "a b c d e f g h i " * 4), (2, "x\n\nx\n \ny x"), (3, "a b c d e f g h a b c d e f g h")], "doc_id long, text string")):
        text = df.select("doc_id", "text").collect()
        got = quality_rules.quality_rules(df).collect()
        assert sorted((str(r["doc_id"]), *[r[c] for c in cols], r["base_failed"]) for r in got) == sorted((str(r["doc_id"]), *(b := brute_rules(r["text"])), b[0] < 20 or 100 * b[4] > 30 * b[0]) for r in text)
        assert not any(r["kept"] and r["base_failed"] for r in got)
    assert quality_rules.quality_rules(empty).count() == 0


def test_kneser_ney_matches_brute_force(spark, odd, empty, monkeypatch):
    from collections import Counter, defaultdict
    from math import isclose, log10

    monkeypatch.setattr(kneser_ney, "RANGE", 5_000)  # many ranges, and pairs that spread over several
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = {r["doc_id"]: ["<s>", "<s>", *words(r["text"]), "\0"] for r in docs.collect()}
    train = [i for i in text if zlib.crc32(str(i).encode()) % 7 != 2]
    uni = Counter(w for i in train for w in text[i][2:])
    triples = Counter(t for i in train for t in zip(text[i], text[i][1:], text[i][2:], strict=False))
    pairs = Counter((y, z) for _, y, z in triples)  # words before a pair
    left = Counter(z for _, z in pairs)
    n, v, types = sum(uni.values()), len(uni), len(pairs)

    def follows(counts):
        out = defaultdict(lambda: [0, 0, 0, 0])
        for key, c in counts.items():
            out[key[:-1]][0] += c
            out[key[:-1]][min(c, 3)] += 1
        return out

    after_two, after_one = follows(triples), follows(pairs)
    d1, d2, d3 = (kneser_ney.discounts([sum(c == j for c in x.values()) for j in (1, 2, 3, 4)]) for x in (left, pairs, triples))
    mass = sum(d1[min(c, 3)] for c in left.values()) / types

    def step(c, d, context, lower):
        return (c - d[min(c, 3)]) / context[0] + (d[1:] @ context[1:]) / context[0] * lower

    def chance(x, y, z):
        p = (left[z] - d1[min(left[z], 3)]) / types + mass / (v + 1)
        if (y,) in after_one:
            p = step(pairs[y, z], d2, after_one[y,], p)
        return step(triples[x, y, z], d3, after_two[x, y], p) if (x, y) in after_two else p

    for r in kneser_ney.corpus_scores(docs).collect():
        t = text[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t) - 2, sum(w in uni for w in t[2:]), n)
        assert isclose(r["base_score"], sum(log10((uni[w] + 1) / (n + v + 1)) for w in t[2:]), rel_tol=1e-9)
        assert isclose(r["score"], sum(log10(chance(*g)) for g in zip(t, t[1:], t[2:], strict=False)), rel_tol=1e-9)
    for x, y in (("<s>", "<s>"), next((x, y) for x, y, _ in triples), ("<s>", "never seen")):
        assert isclose(sum(chance(x, y, w) for w in uni) + chance(x, y, "never seen"), 1.0, rel_tol=1e-9)
    got = kneser_ney.corpus_scores(odd).collect()
    assert len(got) == 11 and {r["n_tokens"] for r in got if r["doc_id"] in (3, 4, 5)} == {1} and all(np.isfinite(r["score"]) for r in got)
    assert kneser_ney.corpus_scores(empty).count() == 0


def test_raking_meets_its_marginals():
    rng = np.random.default_rng(2)
    tokens = rng.integers(1, 100, (5, 3, 4)).astype(float)
    targets = [np.array([0.1, 0.2, 0.3, 0.2, 0.2]), np.array([0.5, 0.3, 0.2]), np.full(4, 0.25)]
    w = mixing.rake(tokens, targets)
    for axis, t in enumerate(targets):
        assert np.allclose(w.sum(axis=tuple(k for k in range(3) if k != axis)), t, atol=1e-6)
    p = mixing.probabilities(tokens, w, 0.4)
    assert np.isclose((p * tokens).sum(), 0.4 * tokens.sum()) and p.max() <= 1
    assert mixing.probabilities(tokens, w, 1.0).min() == 1.0


def test_mixture_draws_what_it_says(documents, odd, empty):
    got = mixing.mix(documents, share=0.5).toPandas()
    assert len(got) == documents.count() and list(got.columns)[: len(documents.columns)] == documents.columns
    tokens = {r["doc_id"]: len(words(r["text"])) + 1 for r in documents.collect()}
    assert (got.mix_tokens == got.doc_id.map(tokens)).all()
    assert abs((got.mix_tokens * got.mix_chance).sum() / got.mix_tokens.sum() - 0.5) < 1e-6
    assert mixing.mix(odd, share=0.5).count() == 11 and mixing.mix(empty, share=0.5).count() == 0
    assert mixing.mix(documents, share=1.0).where("not mix_drawn").count() == 0


def test_every_source_has_its_own_target(spark):
    rows = [(k, "a b " * (1 + k % 7), "en", f"site{k:04}") for k in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mixing.mix(docs, share=0.1, powers={"source": 0.5}).toPandas()
    drawn, want = got.mix_tokens * got.mix_chance, got.mix_tokens**0.5
    assert np.allclose(drawn / drawn.sum(), want / want.sum(), atol=1e-7)
    named = mixing.mix(docs, share=0.0002, targets={"source": {"site0000": 3.0, "site1199": 1.0}}).toPandas().set_index("source")
    drawn = named.mix_tokens * named.mix_chance
    assert np.isclose(drawn["site0000"], 3 * drawn["site1199"]) and np.isclose(drawn.sum(), 0.0002 * named.mix_tokens.sum())
    with pytest.raises(ValueError):
        mixing.mix(docs, targets={"source": {"nowhere": 1.0}})


def test_topics_come_from_the_words(spark):
    rng = np.random.default_rng(4)
    themes = [[f"theme{t}word{k}" for k in range(40)] for t in range(4)]
    rows = [(i, " ".join([*rng.choice(themes[i % 4], 60), *(f"common{k}" for k in rng.integers(0, 30, 20))]), "en", "a") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mixing.mix(docs, share=0.5).toPandas()
    of = got.assign(theme=got.doc_id % 4).groupby("theme").mix_topic.agg(lambda x: x.value_counts(normalize=True).iloc[0])
    main = got.assign(theme=got.doc_id % 4).groupby("mix_topic").theme.agg(lambda x: x.value_counts(normalize=True).iloc[0])
    assert main.min() > 0.95 and of.min() > 0.3
    again = mixing.mix(docs.repartition(7), share=0.5).toPandas().set_index("doc_id").mix_topic
    assert (again.sort_index() == got.set_index("doc_id").mix_topic.sort_index()).all()


def test_mixture_matches_brute_force_and_keeps_clashing_columns(spark, documents):
    docs = documents.withColumn("mix_tokens", F.lit("mine")).withColumn("MIX_drawn", F.lit(3)).withColumn("n", F.lit(1))
    got = mixing.mix(docs, share=0.3).toPandas()
    assert list(got.columns[-4:]) == ["mix_tokens_", "mix_topic", "mix_chance", "mix_drawn_"] and set(got.mix_tokens) == {"mine"} and set(got.MIX_drawn) == {3}
    cells = got.groupby(["source", "lang", "mix_topic"]).mix_tokens_.sum()
    share = cells / cells.sum()
    goals = []
    for level, power in (("source", 0.7), ("lang", 0.5), ("mix_topic", 0.0)):
        g = cells.groupby(level).sum() ** power
        goals.append((level, g / g.sum()))
    for _ in range(500):
        for level, goal in goals:
            share = share * (goal / share.groupby(level).sum()).reindex(share.index, level=level)
    ratio, low, high = share / cells, 0.0, 1e12
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if (np.minimum(1, mid * ratio) * cells).sum() < 0.3 * cells.sum() else (low, mid)
    want = got.set_index(["source", "lang", "mix_topic"]).index.map(np.minimum(1, high * ratio))
    assert np.allclose(np.minimum(got.mix_chance, 1), want, atol=1e-6)
    draw = np.array([(_x64((17).to_bytes(4, "little"), _x64(int(i).to_bytes(8, "little")) % 2**64)) % (1 << 30) / (1 << 30) for i in got.doc_id])
    assert (got.mix_drawn_ == (draw < got.mix_chance)).all()
    assert mixing.drawn(docs, share=0.3).columns == docs.columns


def test_tables_rake_as_the_driver_does(documents, monkeypatch):
    want = mixing.mix(documents, share=0.5).toPandas().set_index("doc_id").mix_chance
    monkeypatch.setattr(mixing, "DRIVER_CELLS", 0)
    got = mixing.mix(documents, share=0.5).toPandas().set_index("doc_id").mix_chance
    assert np.allclose(got.sort_index(), want.sort_index(), atol=1e-6)


STORY = "".join(f"<p>{'The story of the town is long and it has been told by many of those who lived in it for years. ' * 3}{k}</p>" for k in range(4))


@pytest.mark.parametrize("name", ["main-content sidebar-right", "content-sidebar", "two-column-sidebar-layout", "ad-free", "related-work", "social-science", "article-share-enabled", "search-engine-guide", "theme-menu-light", "notice-board"])
def test_a_word_in_a_name_loses_no_article(name):
    want = html_extract.main_text(f"<div>{STORY}</div>")
    assert len(want) > 1000 and html_extract.main_text(f'<div class="{name}">{STORY}</div>') == want
    beside = f'<div class="{name}"><p>Short and plain.</p></div>'
    assert html_extract.main_text(f"<div>{STORY}</div>{beside}") in (want, want + "\n\nShort and plain.")


def test_names_that_mean_the_same_in_any_company():
    want = html_extract.main_text(f"<article>{STORY}</article>")
    for name in ("comments", "user-comments", "sidebar", "cookie-box", "newsletter-signup", "sponsored-story"):
        assert html_extract.main_text(f'<article>{STORY}</article><div class="{name}">{STORY}</div>') == want


def test_stray_quotes_and_unclosed_elements():
    import time

    want = html_extract.main_text(f"<div>{STORY}</div>")
    assert html_extract.main_text(f'<div class="a"">{STORY}</div>') == want
    assert html_extract.main_text(f"<div title=Don't id=x>{STORY}</div>") == want
    assert html_extract.main_text(f'<div title="a > b">{STORY}</div>') == want
    began = time.time()
    assert html_extract.main_text("<svg>" * 100_000 + STORY) == want
    html_extract.main_text("<div>x" * 50_000 + STORY)
    assert time.time() - began < 20


def test_plain_prose_beside_an_article_stays():
    more = "And so the people of the town went back to the river in the morning, as they had done for all of their lives, and sat there with the old man who knew the way to the sea."
    assert html_extract.main_text(f"<article>{STORY}</article><div><p>{more}</p></div>").endswith(more)
