"""Documents in shards of near equal bytes, equal texts together: a minimax contiguous partition.

The groups of equal texts, in the order of their SHA-256, are cut into ``shards`` runs so that the largest run
is as small as it can be. That smallest capacity is found by binary search; a capacity is checked greedily, by
filling one shard after the other. Within it every cut goes where it comes nearest to an even share of what is
left, so very large groups do not starve the shards after them.

Only ends of groups (running sums of their bytes) matter to the search. They stay in a table; the driver knows
them by stretches (first and last end of a range of sums) and has Spark split just those stretches, up to 4,096
ways each, that a check or a cut falls into. So what it holds is bounded whatever the number of groups.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from elastrain.llm.common import whole_text, write_table

SHARDS = 16
FIRST_SPLIT, SPLIT, STRETCHES_AT_ONCE = 1 << 16, 1 << 12, 32
#: Rows of a written file that are numbered together.
PIECE = 1 << 16


class Ends:
    """Ends of groups in order, known by stretches: their first and last end; what lies between may not be known."""

    def __init__(self, table: DataFrame, total: int) -> None:
        self.table, self.total, self.unknown = table, total, set()
        self.first, self.last = np.zeros(1, np.int64), np.zeros(1, np.int64)
        self._split([(0, total)], FIRST_SPLIT)

    def _split(self, ranges: list[tuple[int, int]], ways: int) -> None:
        """Replace what is known of the ranges (a, b], whose ends Spark gathers in ``ways`` stretches each."""
        end, inside, slot = F.col("end"), F.lit(False), F.lit(None)
        for i, (a, b) in enumerate(ranges):
            here = (end > a) & (end <= b)
            wide = -(-(b - a) // ways)
            slot = F.when(here, F.lit(i * ways) + ((end - a - 1) / wide).cast("bigint")).otherwise(slot)
            inside = inside | here
        found = self.table.where(inside).groupBy(slot.alias("slot")).agg(F.min("end").alias("first"), F.max("end").alias("last")).toArrow()
        keep = np.ones(len(self.first), bool)
        for a, b in ranges:
            keep &= ~((self.first > a) & (self.last <= b))
        first = np.concatenate([self.first[keep], found["first"].to_numpy()])
        last = np.concatenate([self.last[keep], found["last"].to_numpy()])
        order = np.argsort(first)
        self.first, self.last = first[order], last[order]

    def refine(self) -> None:
        """Split the stretches that lookups fell into since the last time."""
        ranges = [(int(self.first[i]) - 1, int(self.last[i])) for i in sorted(self.unknown)]
        self.unknown = set()
        for i in range(0, len(ranges), STRETCHES_AT_ONCE):
            self._split(ranges[i : i + STRETCHES_AT_ONCE], SPLIT)

    def floor(self, x: int) -> tuple[int, int]:
        """Bounds of the last end that is at most x (0: before all groups)."""
        i = int(np.searchsorted(self.first, x, "right")) - 1
        if x >= self.last[i] or x == self.first[i]:
            at = int(self.last[i] if x >= self.last[i] else self.first[i])
            return at, at
        self.unknown.add(i)
        return int(self.first[i]), x

    def ceil(self, x: int) -> int:
        """The first end that is at least x, or an end after it where that is not known yet."""
        i = int(np.searchsorted(self.last, x, "left"))
        if self.first[i] >= x:
            return int(self.first[i])
        self.unknown.add(i)
        return int(self.last[i])

    def settled(self, fn: Callable[[], object]):
        """The value of ``fn`` once it meets no unknown stretch, or needs none."""
        while True:
            self.unknown = set()
            value = fn()
            if value is not None:
                return value
            self.refine()


def fits(ends: Ends, capacity: int, shards: int) -> bool | None:
    """Whether filling the shards one by one holds all groups; None if that depends on unknown ends."""
    low = high = 0
    for _ in range(shards):
        low, high = ends.floor(low + capacity)[0], ends.floor(high + capacity)[1]
    return True if low >= ends.total else False if high < ends.total else None


def smallest_capacity(ends: Ends, largest: int, shards: int) -> int:
    """Binary search between what no partition can go below and what filling greedily never exceeds."""
    low = max(largest, -(-ends.total // shards))
    high = -(-ends.total // shards) + largest
    while low < high:
        middle = (low + high) // 2
        if ends.settled(lambda: fits(ends, middle, shards)):
            high = middle
        else:
            low = middle + 1
    return low


def giants(table: DataFrame, total: int, shards: int) -> list[tuple[int, int]]:
    """(begin, end) of the groups larger than an even share of what the groups larger still leave; fewer than ``shards``."""
    largest, found, left = table.orderBy(F.desc("size"), "end").limit(shards).select("end", "size").collect(), [], total
    for row in largest:
        if len(found) == shards - 1 or row["size"] * (shards - len(found)) <= left:
            break
        found.append((row["end"] - row["size"], row["end"]))
        left -= row["size"]
    return sorted(found)


def even_cuts(ends: Ends, capacity: int, shards: int, large: list[tuple[int, int]]) -> list[int] | None:
    """Ends of all shards but the last, each within the capacity and nearest to an even share of the rest.

    Groups of ``large`` are kept apart and do not count for the share, as they would leave nothing to later shards.
    """
    least = [ends.total]  # from the back: where a cut must lie at least for the rest to fit
    for _ in range(shards - 1):
        least.append(ends.ceil(max(least[-1] - capacity, 0)))
    cuts, start = [], 0
    for i in range(1, shards):
        ahead = [g for g in large if g[0] >= start]
        share = (ends.total - start - sum(e - b for b, e in ahead)) // max(1, shards - i + 1 - len(ahead))
        even = start + share
        below, above = ends.floor(even)[0], ends.ceil(min(even, ends.total))
        at = below if even - below <= above - even and below > start else above
        if ahead and at > ahead[0][0]:
            at = ahead[0][0] if ahead[0][0] > start else ahead[0][1]
        low, high = least[shards - i], ends.floor(start + capacity)[0]
        start = min(max(at, low), high)
        cuts.append(start)
    return None if ends.unknown else cuts


def group_ends(measured: DataFrame) -> DataFrame:
    """(digest, size, end): the groups in digest order with the running sum of their bytes.

    Sums run inside cells, the groups that agree in the first two bytes of the digest, and over cells in two steps
    of 256, so no task has all groups.
    """
    groups = measured.groupBy("digest").agg(F.sum("size").alias("size"))
    groups = write_table(groups.withColumn("cell", F.conv(F.hex(F.substring("digest", 1, 2)), 16, 10).cast("int")), "text-groups")
    cells = groups.groupBy("cell").agg(F.sum("size").alias("bytes")).withColumn("high", F.shiftright("cell", 8))
    before = W.orderBy("high").rowsBetween(W.unboundedPreceding, -1)
    highs = cells.groupBy("high").agg(F.sum("bytes").alias("bytes")).select("high", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base"))
    within = W.partitionBy("high").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    bases = cells.select("high", "cell", F.coalesce(F.sum("bytes").over(within), F.lit(0)).alias("low")).join(highs, "high")
    running = F.sum("size").over(W.partitionBy("cell").orderBy("digest").rowsBetween(W.unboundedPreceding, 0))
    dealt = groups.join(bases.select("cell", (F.col("base") + F.col("low")).alias("start")), "cell").repartitionByRange("cell")
    return write_table(dealt.select("digest", "size", (F.col("start") + running).alias("end")), "group-ends")


def number_in_shards(table: DataFrame) -> DataFrame:
    """A written table with a shard column, plus slot: its rows numbered from 0 in each shard, in file and row order.

    Rows are numbered by pieces of a file, and pieces are offset by the rows of the shard before them.
    """
    order, piece = ["_file", "_piece"], F.floor(F.col("_metadata.row_index") / PIECE)
    rows = table.select("*", F.col("_metadata.file_name").alias("_file"), piece.alias("_piece"), F.col("_metadata.row_index").alias("_row"))
    before = W.partitionBy("shard").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    sizes = rows.groupBy("shard", *order).agg(F.count("*").alias("_n"))
    starts = sizes.select("shard", *order, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(W.partitionBy("shard", *order).orderBy("_row")) - 1
    return rows.join(starts, ["shard", *order]).withColumn("slot", F.col("_start") + inside).drop(*order, "_row", "_start")


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every document.

    The size is the bytes of the text in UTF-8 plus 1; null texts count as empty. Equal texts, empty ones too,
    share a shard. Ids are not read: rows without one, or with the same, are sharded by their text. With fewer
    groups than shards some shards stay empty; an empty table gives no rows.
    """
    text = whole_text(docs, "text").cast("binary")
    columns = [F.col("doc_id").cast("bigint").alias("doc_id"), (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32")]
    measured = write_table(docs.select(*columns, F.unhex(F.sha2(text, 256)).alias("digest")), "measured")
    table = group_ends(measured)
    whole = table.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total"), F.max("size").alias("largest")).first()
    digests = []
    if whole["total"]:
        ends = Ends(table, whole["total"])
        capacity = smallest_capacity(ends, whole["largest"], shards)
        large = giants(table, whole["total"], shards)
        cuts = ends.settled(lambda: even_cuts(ends, capacity, shards, large))
        at = {row["end"]: bytes(row["digest"]) for row in table.where(F.col("end").isin(cuts)).select("end", "digest").collect()}
        digests = [at.get(cut, b"") for cut in cuts]
    known = F.array(*map(F.lit, digests)) if digests else F.array().cast("array<binary>")
    shard = F.size(F.filter(known, lambda cut: cut < F.col("digest"))).alias("shard")
    placed = write_table(measured.select("doc_id", "size", "text_crc32", shard), "placed")
    return number_in_shards(placed)
