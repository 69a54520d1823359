"""Documents dealt to shards of near equal bytes, equal texts together: the smallest feasible shard capacity over contiguous runs of groups.

Groups (rows of equal text, told by MD5) stand in the order of their digests, which is as good as a shuffle and needs no join. A group
larger than an even share of what is left has a shard of its own, largest first; the others are cut into contiguous runs, one a shard, whose
largest is as small as can be: a binary search over the capacity, each value checked by filling shards greedily.

No task and not the driver sees all groups. The driver holds the bytes of digest prefixes (4,096 at first). A prefix with several groups
bounds the greedy walk from both sides: cut before it, or anywhere inside. Where the two walks differ, the prefixes between them are
counted again with more digits, until both walks are one. What is sent to the driver has a bound that doesn't grow with the table.
"""

from __future__ import annotations

from bisect import bisect_right
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wanescope.llm.common import released, written
from wanescope.operators.ranking import numbered

#: Hexadecimal digits of the first prefixes, and the most prefixes that one pass looks into (each becomes 16 or 256).
FIRST_DIGITS, MOST_PREFIXES = 3, 512
RESULT = ["doc_id", "size", "text_crc32", "shard", "slot"]


class Leaf(NamedTuple):
    """The groups whose digest starts with prefix; single: it is one group."""

    prefix: str
    size: int
    single: bool


def counted(rows: DataFrame, bucket: Column) -> list[Leaf]:
    found = rows.select(bucket.alias("prefix"), "key", "size").where("prefix is not null").groupBy("prefix")
    return [Leaf(*r) for r in found.agg(F.sum("size"), F.min("key") == F.max("key")).collect()]


def looked_into(rows: DataFrame, leaves: list[Leaf]) -> list[Leaf]:
    """The leaves of one or two more digits that make up these."""
    more = 2 if len(leaves) <= MOST_PREFIXES // 8 else 1
    bucket = F.lit(None).cast("string")
    for n in {len(x.prefix) for x in leaves}:
        bucket = F.when(F.substring("key", 1, n).isin([x.prefix for x in leaves if len(x.prefix) == n]), F.substring("key", 1, n + more)).otherwise(bucket)
    return counted(rows, bucket)


class Walk:
    """Greedy filling of n shards from leaves in order; positions are bytes from the first leaf's start."""

    def __init__(self, leaves: list[Leaf], n: int) -> None:
        self.leaves, self.n, self.starts = leaves, n, [0]
        for x in leaves:
            self.starts.append(self.starts[-1] + x.size)
        self.total = self.starts[-1]

    def cuts(self, capacity: int, inside: bool) -> list[int]:
        """Where each shard ends. inside: a leaf of several groups may be cut anywhere (no walk gets further), else nowhere (none less far)."""
        at, out = 0, []
        for _ in range(self.n):
            to = min(at + capacity, self.total)
            i = bisect_right(self.starts, to) - 1
            if i < len(self.leaves) and not (inside and not self.leaves[i].single):
                to = self.starts[i]
            at = max(at, to)
            out.append(at)
        return out

    def capacity(self, inside: bool) -> int:
        """The smallest one that suffices."""
        low, high = -(-self.total // max(1, self.n)), self.total
        while low < high:
            middle = (low + high) // 2
            if self.cuts(middle, inside)[-1] == self.total:
                high = middle
            else:
                low = middle + 1
        return low

    def open_leaves(self) -> tuple[list[int], list[Leaf]]:
        """Cuts that no groups can fall behind, and the leaves that must be known better before these are the cuts: none if they are."""
        near, far = self.cuts(self.capacity(True), False), self.cuts(self.capacity(False), True)
        found = {i: self.leaves[i] for a, b in zip(near, far) if a < b for i in range(bisect_right(self.starts, a) - 1, bisect_right(self.starts, b - 1)) if not self.leaves[i].single}
        return near, list(found.values())


def plan(rows: DataFrame, n: int) -> tuple[list[str], list[str]]:
    """Keys of the groups that have shards of their own, in the order of the shards, and the prefixes at which each later shard but the
    first begins. rows: key (hexadecimal digest), size."""
    leaves = counted(rows, F.substring("key", 1, FIRST_DIGITS))
    while True:
        alone, shards, rest, wanted = [], n, sum(x.size for x in leaves), []
        for x in sorted(leaves, key=lambda x: (-x.size, x.prefix)):
            if x.size * shards <= rest:
                break
            if not x.single:
                wanted.append(x)
            elif not wanted:
                alone.append(x)
                shards, rest = shards - 1, rest - x.size
        if not wanted:
            walk = Walk(sorted(set(leaves) - set(alone)), shards)
            cuts, wanted = walk.open_leaves()
            if not wanted:
                return [x.prefix for x in alone], [walk.leaves[bisect_right(walk.starts, c) - 1].prefix for c in cuts[:-1] if c < walk.total]
        wanted = sorted(wanted, key=lambda x: (-x.size, x.prefix))
        wanted = [x for x in wanted[:MOST_PREFIXES] if 16 * x.size >= wanted[0].size]
        leaves = [x for x in leaves if x not in set(wanted)] + looked_into(rows, wanted)


def assign(docs: DataFrame, shards: int = 16, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size (UTF-8 bytes of text and one more), text_crc32, shard and slot (gapless in a shard, by digest and doc_id) of every row,
    with the columns named in carry; other columns, whatever their names, take no part.

    A null text has no bytes and is of one group with the empty ones; null and repeated doc_ids are rows like any other; with fewer groups
    than shards, or few large ones, shards stay empty; an empty table has no rows. A text isn't cut, however long. Two tables the size of
    the result are kept in the shared folder, of which the second stays as the result is read from it.
    """
    if clash := set(carry) & {*RESULT, "key", "row"}:
        raise ValueError(f"columns of the result's names can't be carried: {sorted(clash)}")
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = written(docs.select("doc_id", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("key"), *carry, F.monotonically_increasing_id().alias("row")))
    alone, cuts = plan(rows, shards)
    own = F.array(*[F.lit(x) for x in alone]).cast("array<string>")
    later = F.size(F.filter(F.array(*[F.lit(x) for x in cuts]).cast("array<string>"), lambda c: c <= F.col("key")))
    place = F.array_position(F.transform(own, lambda p: F.col("key").startswith(p)), True).cast("int")
    placed = rows.withColumn("shard", F.when(place > 0, place - 1).otherwise(later + len(alone)).cast("int"))
    out = numbered(placed, ["shard"], ["key", "doc_id", "row"], "slot").select(*RESULT, *carry)
    released(rows)
    return out


def write_shards(docs: DataFrame, path: str, shards: int = 16) -> None:
    """docs as Parquet folders path/shard=0, 1, ..., with each row's slot: what a loader reads, shard by shard. The columns that assign()
    makes (size and the like) replace docs' own of these names."""
    kept = tuple(c for c in docs.columns if c not in {*RESULT, "key", "row"})
    assign(docs, shards, kept).write.partitionBy("shard").parquet(path)
