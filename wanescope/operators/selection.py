"""Order statistics of groups of any size by narrowing histograms: no group is sorted, numbered or gathered.

A wanted place has a bracket of values, at first its group's range. A round counts the values of a bracket in equal bins, which is summed
before its shuffle, and keeps the bin that the place is in, from its least to its greatest value. A bracket of one value is found; one that
holds few values is sorted. Each round reads the rows once more, yet shuffles histograms only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wanescope.operators.ranking import with_values
from wanescope.shared import released, written

#: Bins of a bracket in a round, and values that a bracket may hold to be sorted at once.
BINS = 4_096
FEW = 4_096


def largest(rows: DataFrame, by: list[str]) -> int:
    """Rows of the largest group."""
    return rows.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0


def order_values(rows: DataFrame, by: list[str], value: str, places: Column) -> DataFrame:
    """(by, n, place, at): the value at each wanted place of its group, counted from 0 for the least. places: an array of longs made of `n`,
    how many values the group has; places that it doesn't have give no row. Null values are left out; others must be finite and their range,
    too. Null keys are keys, ties take a place each."""
    data = rows.select(*by, F.col(value).cast("double").alias("_v")).where("_v is not null")
    if largest(data, by) <= FEW:  # nothing to narrow: the same values from one scan
        sets = data.groupBy(*by).agg(F.count("*").alias("n"), F.sort_array(F.collect_list("_v")).alias("_all"))
        return sets.withColumn("place", F.explode(F.array_distinct(places))).where("place between 0 and n - 1").select(*by, "n", "place", F.get("_all", F.col("place").cast("int")).alias("at"))
    whole = data.groupBy(*by).agg(F.count("*").alias("n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    wanted = whole.withColumn("place", F.explode(F.array_distinct(places))).where("place between 0 and n - 1")
    wanted = written(wanted.withColumns({"_held": F.col("n"), "_below": F.lit(0).cast("long")}))
    bracket = [*by, "_low", "_high"]

    def held(brackets: DataFrame) -> DataFrame:
        """The values in any of the brackets, which are disjoint, with their bracket."""
        return with_values(data, brackets.select(*bracket).distinct(), by).where("_v between _low and _high")

    while not wanted.where((F.col("_low") < F.col("_high")) & (F.col("_held") > FEW)).isEmpty():
        wide = (F.col("_low") < F.col("_high")) & (F.col("_held") > FEW)
        bin_ = F.least(F.floor((F.col("_v") - F.col("_low")) / (F.col("_high") - F.col("_low")) * BINS), F.lit(BINS - 1))
        bins = held(wanted.where(wide)).groupBy(*bracket, bin_.alias("_bin")).agg(F.min("_v").alias("_least"), F.max("_v").alias("_most"), F.count("*").alias("_n"))
        ahead = F.sum("_n").over(Window.partitionBy(*bracket).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1))  # at most BINS rows
        bins = bins.withColumn("_ahead", F.coalesce(ahead, F.lit(0))).drop("_bin")
        inner = with_values(wanted.where(wide), bins, bracket).where("place - _below >= _ahead and place - _below < _ahead + _n")
        inner = inner.select(*by, "n", "place", F.col("_least").alias("_low"), F.col("_most").alias("_high"), F.col("_n").alias("_held"), (F.col("_below") + F.col("_ahead")).alias("_below"))
        narrower = written(wanted.where(~wide).unionByName(inner))
        released(wanted)
        wanted = narrower
    found = wanted.where("_low = _high").select(*by, "n", "place", F.col("_low").alias("at"))
    few = wanted.where("_low < _high")
    sorted_ = held(few).groupBy(*bracket).agg(F.sort_array(F.collect_list("_v")).alias("_all"))  # at most FEW values
    return found.unionByName(with_values(few, sorted_, bracket).select(*by, "n", "place", F.get("_all", (F.col("place") - F.col("_below")).cast("int")).alias("at")))


def interpolated(rows: DataFrame, by: list[str], value: str, positions: dict[str, Column]) -> DataFrame:
    """(by, n, a column for each name): the values at these positions (made of `n`) of each group, between two places in proportion."""
    ends = [f(p).cast("long") for p in positions.values() for f in (F.floor, F.ceil)]
    at = order_values(rows, by, value, F.array(*ends))

    def part(position: Column) -> Column:
        share = F.when(F.col("place") == F.floor(position), 1 - (position - F.floor(position))).when(F.col("place") == F.ceil(position), position - F.floor(position))
        return F.sum(F.col("at") * share)

    return at.groupBy(*by, "n").agg(*[part(p).alias(k) for k, p in positions.items()])
