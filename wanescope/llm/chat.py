"""Multi-party chat formatting by perspective rotation.

For every participant (distinct non-null role) of a conversation the dialogue is rendered once with that speaker as the assistant and
the others as named users. A row is one turn of one rendering: its text, its place in the rendering in code points, and whether it is
the assistant's and so trained on. The rendering is its segments in order; a mask is its trained spans. Renderings are never gathered in
one row, so a conversation may hold any share of the turns, and a turn number (or none) any share of a conversation: turns are numbered by
ranges first; places are running sums in blocks of BLOCK numbered turns, then over blocks.

Turns are ordered by number, then by role and text, nulls last in each. A null role is the user `unknown` and no participant; a null text is
empty. Turns of a null conv_id are one conversation. Repeated rows are turns of their own. A conversation without participants has no
rendering. Other columns, whatever their names, take no part; texts may be of any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wanescope.operators.ranking import numbered

#: Turns in a block, and code points of a text by which ranges of turns are cut.
BLOCK = 4096
PREFIX = 64


def segment(role: Column, text: Column, trained: Column) -> Column:
    head = F.when(trained, F.lit("<|assistant|>\n")).otherwise(F.concat(F.lit("<|user name="), F.coalesce(role, F.lit("unknown")), F.lit("|>\n")))
    return F.concat(head, F.coalesce(text, F.lit("")), F.lit("<|end|>\n"))


def rotate(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, perspective, turn, role, trained, segment, start, end) for every turn of every rendering."""
    turns = conversations.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    last = lambda *cs: [c.asc_nulls_last() for c in cs]
    prefix = F.substring("text", 1, PREFIX)
    turns = turns.withColumn("row", F.monotonically_increasing_id())
    turns = numbered(turns, ["conv_id"], last(F.col("turn"), F.col("role"), F.col("text"), F.col("row")), "place", last(F.col("turn"), F.col("role"), prefix)).drop("row")
    speakers = turns.where("role is not null").select(F.col("conv_id").alias("conv2"), F.col("role").alias("perspective")).distinct()
    both = turns.join(speakers, F.col("conv_id").eqNullSafe(F.col("conv2"))).drop("conv2")
    trained = F.coalesce(F.col("role") == F.col("perspective"), F.lit(False))
    shown = both.withColumn("trained", trained).withColumn("segment", segment(F.col("role"), F.col("text"), F.col("trained"))).withColumn("size", F.length("segment").cast("long")).withColumn("block", F.floor(F.col("place") / BLOCK))
    keys = ["conv_id", "perspective"]
    inside = Window.partitionBy(*keys, "block").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    over = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = shown.groupBy(*keys, "block").agg(F.sum("size").alias("all")).withColumn("before", F.coalesce(F.sum("all").over(over), F.lit(0))).select(F.col("conv_id").alias("c2"), F.col("perspective").alias("p2"), F.col("block").alias("b2"), "before")
    placed = shown.withColumn("upto", F.sum("size").over(inside))
    out = placed.join(sizes, F.col("conv_id").eqNullSafe(F.col("c2")) & (F.col("perspective") == F.col("p2")) & (F.col("block") == F.col("b2")))
    return out.select("conv_id", "perspective", "turn", "role", "trained", "segment", (F.col("before") + F.col("upto") - F.col("size")).alias("start"), (F.col("before") + F.col("upto")).alias("end"))
