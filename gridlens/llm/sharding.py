"""Shards of near-equal size: minimax contiguous partition of groups in hash order.

Groups (equal texts) are atomic and ordered by the hash of their text. The smallest capacity for
which greedy packing needs no more than the given shards is found by binary search. Neither the
search nor the check reads the groups one by one on the driver: it sees a bounded table of key
intervals with their sizes, and asks Spark to split just those intervals in which a greedy run at
the capacity found, or at one less, would have to stop. Each split is 256-fold, so a few small
aggregations make the answer exact for any number of groups.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlens.llm.shared import Scratch

TOP_BITS, STEP_BITS = 12, 8
#: Parts of a shard for numbering its rows; no task numbers more than one part.
PARTS = 256


@dataclass(frozen=True)
class Interval:
    """All keys whose upper ``bits`` are ``prefix`` (signed), their total size, and whether they are one key."""

    prefix: int
    bits: int
    size: int
    atomic: bool

    @property
    def start(self) -> int:
        return self.prefix << (64 - self.bits)


def pack(sizes: list[int], capacity: int, shards: int) -> tuple[list[int], bool]:
    """First-fit in order: the places where each next shard begins, and whether ``shards`` sufficed."""
    sums = [0, *accumulate(sizes)]
    starts, at = [], 0
    for _ in range(shards):
        at = bisect_right(sums, sums[at] + capacity, lo=at) - 1
        if at == len(sizes):
            return starts, True
        starts.append(at)
    return starts, False


def least_capacity(sizes: list[int], shards: int) -> int:
    """The smallest capacity that ``pack`` can meet."""
    low, high = max([0, *sizes, -(-sum(sizes) // shards)]), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        if pack(sizes, mid, shards)[1]:
            high = mid
        else:
            low = mid + 1
    return low


def even_cuts(sizes: list[int], capacity: int, shards: int) -> tuple[list[int], list[int]]:
    """Cuts within the capacity, each nearest to an even share of what is left; and the places aimed at."""
    sums = [0, *accumulate(sizes)]
    total = sums[-1]
    # The last cuts that leave a rest which the remaining shards can hold, found by packing from the end.
    back, at = [], len(sizes)
    for _ in range(shards - 1):
        at = bisect_left(sums, sums[at] - capacity)
        back.append(at)
    cuts, aims, at = [], [], 0
    for k in range(shards - 1):
        low, high = max(at, back[shards - 2 - k]), max(at, bisect_right(sums, sums[at] + capacity) - 1)
        aim = sums[at] + (total - sums[at]) / (shards - k)
        near = bisect_left(sums, aim)
        if 0 < near < len(sums) and aim - sums[near - 1] <= sums[near] - aim:
            near -= 1
        aims.append(max(0, bisect_right(sums, aim) - 1))
        at = min(max(near, low), max(high, low))
        cuts.append(at)
    return cuts, aims


def _intervals(groups: DataFrame, split: list[Interval] | None) -> list[Interval]:
    """Intervals of all groups, or those within the intervals to split."""
    key, size = F.col("key"), F.col("size")
    if split is None:
        bits, prefix, rows = F.lit(TOP_BITS), F.shiftright(key, 64 - TOP_BITS), groups
    else:
        by: dict[int, list[int]] = {}
        for x in split:
            by.setdefault(x.bits, []).append(x.prefix)
        bits = prefix = None
        for b, prefixes in sorted(by.items()):
            hit, deep = F.shiftright(key, 64 - b).isin(prefixes), min(64, b + STEP_BITS)
            bits = F.when(hit, deep) if bits is None else bits.when(hit, deep)
            prefix = F.when(hit, F.shiftright(key, 64 - deep)) if prefix is None else prefix.when(hit, F.shiftright(key, 64 - deep))
        rows = groups.where(bits.isNotNull())
    found = rows.groupBy(bits.alias("bits"), prefix.alias("prefix")).agg(F.sum(size).cast("long").alias("size"), (F.min(key) == F.max(key)).alias("atomic"))
    return [Interval(r["prefix"], r["bits"], r["size"], r["atomic"]) for r in found.collect()]


def plan(groups: DataFrame, shards: int) -> tuple[int, list[int]]:
    """The least capacity for ``groups(key, size)``, and the first key of every shard but the first."""
    items = sorted(_intervals(groups, None), key=lambda x: x.start)
    if not items:
        return 0, []

    def refine(places: set[int]) -> bool:
        nonlocal items
        split = [items[i] for i in places if i < len(items) and not items[i].atomic]
        if not split:
            return False
        items = sorted([x for x in items if x not in split] + _intervals(groups, split), key=lambda x: x.start)
        return True

    while True:
        sizes = [x.size for x in items]
        capacity = least_capacity(sizes, shards)
        if not refine({*pack(sizes, capacity, shards)[0], *pack(sizes, capacity - 1, shards)[0]}):
            break
    while True:
        cuts, aims = even_cuts([x.size for x in items], capacity, shards)
        if not refine({i for i in aims if i < len(items) and items[i].size * 4096 > capacity}):
            return capacity, [items[i].start if i < len(items) else 2**63 - 1 for i in cuts]


def shard_of(key: Column, starts: list[int]) -> Column:
    """The number of shards that begin at or before the key."""
    out = F.lit(0)
    for s in starts:
        out = out + (key >= F.lit(s).cast("long")).cast("int")
    return out


def minimax_shards(docs: DataFrame, *, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False, scratch: Scratch | None = None) -> DataFrame:
    """Every row with its shard and its place there, by DataFrame functions only.

    A row's size is the UTF-8 bytes of its text (null: none) plus 1. Rows with equal texts, and
    rows with null texts, go to one shard. Returns doc_id, size, text_crc32 (null for a null
    text), law (``bytes``), shard, slot, grown_shard (null), and the text if asked for. Rows are
    numbered in parts of a shard by the hash of id and text; repeated rows get slots of their
    own. An empty table gives an empty result.
    """
    scratch = scratch or Scratch(docs.sparkSession, "sharding")
    text = F.col(text_col).cast("string")
    columns = [
        F.col(id_col).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("key"),
    ]
    rows = scratch.write(docs.select(*columns), "rows")
    groups = scratch.write(rows.groupBy("key").agg(F.sum("size").alias("size")), "groups")
    _, starts = plan(groups, shards)
    if keep_text:
        rows = docs.select(*columns, text.alias("text"))
    placed = rows.withColumn("shard", shard_of(F.col("key"), starts)).withColumn("part", F.pmod(F.xxhash64("doc_id", "key"), F.lit(PARTS)).cast("int"))
    # At most shards * PARTS rows, whatever the input.
    counts = rows.select(shard_of(F.col("key"), starts).alias("shard"), F.pmod(F.xxhash64("doc_id", "key"), F.lit(PARTS)).cast("int").alias("part")).groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select("shard", "part", F.coalesce("before", F.lit(0)).alias("before"))
    number = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "key"))
    return (
        placed.withColumn("number", number)
        .join(F.broadcast(before), ["shard", "part"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("number") - 1 + F.col("before")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), *(["text"] if keep_text else []))
    )


def write_shards(sharded: DataFrame, path: str) -> DataFrame:
    """Cut the shards: one folder for each, rows in the order of their slots within each file. Returns the rows as they lie there."""
    sharded.sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)
    rest = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sharded.schema if f.name != "shard")
    return sharded.sparkSession.read.schema(f"{rest}, shard int").parquet(path).select(*sharded.columns)
