"""Places, ranks and running values over tables of any size: no window holds more rows than the table has partitions or keys.

A table is dealt out by ranges of (keys, order), sorted within each partition and stored. A row's place within its partition is known
then; what is left is one row per key and partition, whose running totals are small, and a join of these with the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wanescope.shared import written


def unused(df: DataFrame, name: str) -> str:
    """A column name made from `name` that df doesn't have, whatever the case of its letters."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def with_values(rows: DataFrame, values: DataFrame, by: list[str]) -> DataFrame:
    """rows with the other columns of values, of which there is one row for each key; null keys are keys. An empty `by` is one key."""
    keys = values.select(*[F.col(c).alias(f"key_{i}") for i, c in enumerate(by)], *[c for c in values.columns if c not in by])
    on = F.lit(True)
    for i, c in enumerate(by):
        on = on & rows[c].eqNullSafe(keys[f"key_{i}"])
    return (rows.join(keys, on) if by else rows.crossJoin(F.broadcast(keys))).drop(*[f"key_{i}" for i in range(len(by))])  # one row


def numbered(rows: DataFrame, by: list[str], order: list[str | Column], name: str, ranges: list[Column] | None = None) -> DataFrame:
    """rows with `name` (long): the place of each among the rows of equal `by`, gapless from 0, in the given order.

    rows should be a stored table: its plan runs twice, as Spark samples it to choose the ranges. Rows that are equal in by and order are
    one range, so let the order end with a column that tells them apart where many may be equal. Nulls are keys like any other. ranges: what to cut
    ranges by in place of order, if its columns are long (the driver sees a sample of them); order must follow it, as a text does its prefix.
    """
    at = unused(rows, "at")
    sorts = [*(F.col(c) for c in by), *(F.col(c) if isinstance(c, str) else c for c in order)]
    cuts = sorts if ranges is None else [*(F.col(c) for c in by), *ranges]
    stored = written(rows.repartitionByRange(*cuts).sortWithinPartitions(*sorts).withColumn(at, F.monotonically_increasing_id()))
    t = stored.withColumn(part := unused(stored, "part"), F.shiftright(at, 33))
    low, count = unused(t, "low"), unused(t, "count")
    starts = t.groupBy(*by, part).agg(F.min(at).alias(low), F.count("*").alias(count))
    ahead = F.sum(count).over(Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    starts = starts.select(*(F.col(c).alias(f"key_{i}") for i, c in enumerate(by)), F.col(part).alias("key_part"), (F.coalesce(ahead, F.lit(0)) - F.col(low)).alias("shift"))
    on = t[part] == starts["key_part"]
    for i, c in enumerate(by):
        on = on & t[c].eqNullSafe(starts[f"key_{i}"])
    out = t.join(starts, on).select(*(t[c] for c in rows.columns), (t[at] + starts["shift"]).alias(name))
    out._written_to = stored._written_to
    return out


def average_ranks(rows: DataFrame, by: list[str], names: dict[str, str]) -> DataFrame:
    """rows with the rank of each value in its group, from 1, ties sharing the mean of their places. names: a rank's column by its value's;
    values without nulls. A rank is the mean place of the rows of a value: keyed sums, however many rows share it."""
    row = unused(rows, "row")
    stored = written(rows.withColumn(row, F.monotonically_increasing_id()))
    out = stored
    for value, name in names.items():
        place = unused(stored, "place")
        ranks = numbered(stored.select(*by, value, row), by, [value, row], place).groupBy(*by, value).agg((F.avg(place) + 1).alias(name))
        out = with_values(out, ranks, [*by, value])
    return out.drop(row)


#: Rows of a sorted group that one window holds.
CHUNK = 65_536


def least_from_here(rows: DataFrame, by: list[str], place: str, value: Column, name: str) -> DataFrame:
    """rows with the least value from each row's place to its group's last: a window over CHUNK places, and over one row a chunk behind."""
    chunk, v, later = unused(rows, "chunk"), unused(rows, "value"), unused(rows, "later")
    cut = rows.withColumns({chunk: F.floor(F.col(place) / CHUNK), v: value})
    after = Window.partitionBy(*by).orderBy(chunk).rowsBetween(1, Window.unboundedFollowing)
    chunks = cut.groupBy(*by, chunk).agg(F.min(v).alias(later)).withColumn(later, F.min(later).over(after))
    inside = Window.partitionBy(*by, chunk).orderBy(place).rowsBetween(0, Window.unboundedFollowing)
    out = with_values(cut, chunks, [*by, chunk]).withColumn(name, F.least(F.min(v).over(inside), F.col(later)))
    return out.drop(chunk, v, later)
