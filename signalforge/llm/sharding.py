"""Sharding by minimax contiguous partition.

Documents with equal texts form one atomic group; groups are ordered by their least doc_id.
The shards are the contiguous partition of that order whose largest shard is smallest: the
least feasible capacity is found by binary search, each candidate checked greedily, and the
order is cut there. Where that capacity leaves room, cuts move towards equal shares.

The driver never sees the groups, only sums over at most ``BLOCKS`` ranges of the order. A
range that a cut may fall into is split again, until the capacity is known exactly.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from decimal import Decimal
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalforge.llm.common import numbered, shuffle_partitions, stored

SHARDS, OVERHEAD = 40, 16
#: Ranges whose sums the driver holds at most.
BLOCKS = 50_000
#: Rows without an id are ordered by their texts' digests, in so many places before all ids.
UNNAMED = 1 << 40


@dataclass(frozen=True)
class Block:
    """Groups with keys from ``first`` up to and including ``last``."""

    first: int
    last: int
    size: int
    largest: int
    groups: int


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, key, digest, size, text_crc32, at) for every row; texts are read here only. at tells rows apart."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.unhex(F.md5(text.cast("binary"))).alias("digest"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("at"),
    )
    unnamed = F.lit(-(2**63)) + F.pmod(F.xxhash64("digest"), F.lit(UNNAMED))
    return rows.withColumn("key", F.coalesce("doc_id", unnamed))


def group_sizes(rows: DataFrame) -> DataFrame:
    """(digest, key, size): groups of equal texts under their least key, with the sum of their rows' sizes."""
    return rows.groupBy("digest").agg(F.min("key").alias("key"), F.sum("size").alias("size"))


def _quotient(key: str, origin: Column, width: Column) -> Column:
    """Whole widths between origin and key; in decimals, as ids may lie further apart than longs reach."""
    wide = "decimal(20,0)"
    return F.floor((F.col(key).cast(wide) - origin.cast(wide)) / width.cast(wide)).cast("long")


def _sums(groups: DataFrame, blocks: list[tuple[int, int]], pieces: int, base: tuple[int, int]) -> list[Block]:
    """Sums over each (first, last), split into so many ranges of keys.

    base: start and width of the first round's ranges; each block lies in one of them, and a
    key finds its block by that range's number. At most ``BLOCKS`` blocks.
    """
    origin, width = base
    spans = [((a - origin) // width, a, b, Decimal(-(-(b - a + 1) // pieces))) for a, b in blocks]
    table = groups.sparkSession.createDataFrame(spans, "range long, a long, b long, w decimal(20,0)")
    rows = groups.withColumn("range", _quotient("key", F.lit(Decimal(origin)), F.lit(Decimal(width)))).join(F.broadcast(table), "range")
    rows = rows.filter(F.col("key").between(F.col("a"), F.col("b")))
    piece = _quotient("key", F.col("a"), F.col("w"))
    found = rows.groupBy("a", piece.alias("piece")).agg(
        F.min("key").alias("first"),
        F.max("key").alias("last"),
        F.sum("size").alias("size"),
        F.max("size").alias("largest"),
        F.count("*").alias("groups"),
    )
    return [Block(r["first"], r["last"], r["size"], r["largest"], r["groups"]) for r in found.collect()]


class _Line:
    """Ordered blocks and their prefix sums. A block of one group can be cut only at its ends."""

    def __init__(self, blocks: list[Block]):
        self.blocks = sorted(blocks, key=lambda b: b.first)
        self.upto = [0, *accumulate(b.size for b in self.blocks)]
        self.total = self.upto[-1]

    def cuts(self, capacity: int, hopeful: bool) -> list[int] | None:
        """Places where greedy shards end; hopeful: a block of several groups can be cut anywhere."""
        ends, place = [], 0
        for _ in range(SHARDS):
            reach = place + capacity
            if reach >= self.total:
                return [*ends, self.total]
            i = bisect_right(self.upto, reach) - 1
            place = reach if hopeful and self.blocks[i].groups > 1 else self.upto[i]
            ends.append(place)
        return None

    def even_cuts(self, capacity: int) -> list[int]:
        """Cuts within the capacity, each as near behind an equal share of the rest as leaves the rest feasible."""
        ends, place = [], 0
        for left in range(SHARDS, 0, -1):
            if place >= self.total:
                break
            high = bisect_right(self.upto, place + capacity) - 1
            low = min(high, bisect_right(self.upto, place + (self.total - place) // left))
            while low < high:
                mid = (low + high) // 2
                if self._shards_from(self.upto[mid], capacity) <= left - 1:
                    high = mid
                else:
                    low = mid + 1
            place = self.upto[high]
            ends.append(place)
        return ends

    def _shards_from(self, place: int, capacity: int) -> int:
        """Greedy shards that hold everything behind ``place``; more than ``SHARDS`` counts as that many and one."""
        for n in range(SHARDS + 1):
            if place >= self.total:
                return n
            place = self.upto[bisect_right(self.upto, place + capacity) - 1]
        return SHARDS + 1

    def least(self, low: int, high: int, hopeful: bool) -> int:
        while low < high:
            mid = (low + high) // 2
            if self.cuts(mid, hopeful) is None:
                low = mid + 1
            else:
                high = mid
        return low

    def open_blocks(self, low: int, high: int) -> set[int]:
        """Blocks of several groups that a cut may fall into when the capacity lies between low and high."""
        found: set[int] = set()
        near, far, place = [], [], 0
        for _ in range(SHARDS):
            i = bisect_right(self.upto, min(place + low, self.total)) - 1
            place = self.upto[i]
            near.append(place)
        place = 0
        for _ in range(SHARDS):
            place = min(place + high, self.total)
            far.append(place)
        for a, b in zip(near, far, strict=True):
            i = bisect_right(self.upto, a) - 1
            while i < len(self.blocks) and self.upto[i] <= b:
                if self.blocks[i].groups > 1:
                    found.add(i)
                i += 1
        return found


def plan(groups: DataFrame) -> tuple[list[int], int]:
    """(keys at which a shard after the first begins, capacity); at most ``SHARDS`` - 1 keys. Keys differ."""
    ends = groups.agg(F.min("key").alias("a"), F.max("key").alias("b")).first()
    if ends["a"] is None:
        return [], 0
    span = ends["b"] - ends["a"] + 1
    line = _Line(_sums(groups, [(ends["a"], ends["b"])], BLOCKS, (ends["a"], span)))
    base = (ends["a"], -(-span // BLOCKS))
    floor = max(-(-line.total // SHARDS), max(b.largest for b in line.blocks))
    while True:  # each round splits every open block
        low = line.least(floor, line.total, True)
        high = line.least(low, line.total, False)
        if low == high:
            break
        wide = line.open_blocks(low, high)
        if not wide:
            break
        parts = max(2, BLOCKS // len(wide))
        fresh = _sums(groups, [(line.blocks[i].first, line.blocks[i].last) for i in sorted(wide)], parts, base)
        line = _Line([b for i, b in enumerate(line.blocks) if i not in wide] + fresh)
    capacity = line.least(floor, line.total, False)
    cuts = line.even_cuts(capacity)[:-1]
    return [line.blocks[bisect_right(line.upto, c) - 1].first for c in cuts], capacity


def shard(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row.

    Input: doc_id, text (other columns are ignored). Null text has no bytes. Rows without an id
    come first, by their texts. Repeated rows are rows of one group; different texts with one
    least doc_id stay together too. Groups stay whole, so a group larger than a fair share sets
    the capacity. Shards beyond the last cut stay empty when there are fewer
    groups than shards. An empty table gives an empty result.
    """
    rows = stored(sized(docs))
    groups = stored(group_sizes(rows))
    begins, _ = plan(stored(groups.groupBy("key").agg(F.sum("size").alias("size"))))
    number = F.lit(0)
    for key in begins:
        number = number + (F.col("key") >= key).cast("int")
    placed = groups.select("digest", number.cast("int").alias("shard"))
    rows = rows.drop("key").join(placed, "digest")
    rows = numbered(rows, ["shard"], ["doc_id", "digest", "at"], "slot", 4 * shuffle_partitions(docs.sparkSession))
    null: Column = F.lit(None).cast("int")
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", null.alias("grown_shard"))
