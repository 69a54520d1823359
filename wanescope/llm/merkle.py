"""A Merkle manifest of a dataset: a digest of each record, a tree of each source, a tree of the sources' roots, and a proof of each record.

Superblocks: a record's index in its source, divided by fanout^levels, names its bucket; a bucket is one small group in which Python folds
that many levels of the tree. The buckets' roots are records of a tree with so many times fewer nodes, reduced the same way. A proof is
written from the top down: a node's path within its bucket, then the path of its bucket. So a source of any size is many equal groups,
and nothing but a bucket is ever in one task.

A path is text: for each level from the bottom up the digests left of the node in its run and those right of it, `left|right`, levels
parted by commas. `folded` goes up it in plain expressions, so verifying a record needs no Python.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wanescope.llm.common import released, written
from wanescope.operators.ranking import numbered

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Nodes in a run; levels that a bucket folds (243 nodes).
FANOUT, LEVELS = 3, 5


def encoded(value: Column) -> Column:
    """`-` for a null, else the UTF-8 bytes of the value as text, a colon and the text."""
    said = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said), F.lit("-"))


def digest(values: list[Column]) -> Column:
    """Lowercase hexadecimal SHA-256 of a record's encoded values, one after the other."""
    return F.sha2(F.concat(*[encoded(v) for v in values]), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf's digest and a path lead to."""
    steps = F.filter(F.split(path, ","), lambda p: p != "")
    return F.aggregate(steps, leaf, lambda h, p: F.sha2(F.concat(F.substring_index(p, "|", 1), h, F.substring_index(p, "|", -1)), 256))


def proof_digest(path: Column) -> Column:
    """SHA-256 of all siblings on a path, from the bottom up and from left to right."""
    return F.sha2(F.translate(path, ",|", ""), 256)


def climbed(nodes: list[str], fanout: int, levels: int, whole: bool) -> tuple[str, list[str]]:
    """The digest that a bucket's nodes become, and each node's path to it. whole: the bucket is a tree, or the first of several, and folds
    until one node is left; any other one folds all levels, for the tree goes on beside it."""
    up: list[list[str]] = []
    while len(nodes) > 1 if whole else len(up) < levels:
        runs = [nodes[i : i + fanout] for i in range(0, len(nodes), fanout)]
        up.append(["".join(r[:j]) + "|" + "".join(r[j + 1 :]) for r in runs for j in range(len(r))])
        nodes = [hashlib.sha256("".join(r).encode()).hexdigest() for r in runs]
    paths = [""]
    for own in reversed(up):
        paths = [s + "," + rest if (rest := paths[i // fanout]) else s for i, s in enumerate(own)]
    return nodes[0], paths


def with_paths(nodes: DataFrame, last: int, fanout: int, levels: int) -> tuple[DataFrame, DataFrame]:
    """nodes (tree, idx, digest and further text columns) with each one's path to its tree's root; and the roots (tree, digest).

    nodes: a stored table, idx gapless in each tree. last: the largest idx. Columns pass through pandas, so all but idx are text.
    """
    if last <= 0:
        return nodes.withColumn("path", F.lit("")), nodes.select("tree", "digest")
    size = fanout**levels
    bucketed = nodes.withColumn("bucket", F.floor(F.col("idx") / F.lit(size)).cast("long"))
    schema = ", ".join(f"`{c}` {t}" for c, t in bucketed.drop("bucket").dtypes) + ", path string"

    def top(own: pd.DataFrame) -> pd.DataFrame:
        own, bucket = own.sort_values("idx"), int(own["bucket"].iloc[0])
        root, _ = climbed(own["digest"].tolist(), fanout, levels, bucket == 0)
        return pd.DataFrame({"tree": [own["tree"].iloc[0]], "idx": [bucket], "digest": [root]})

    def down(own: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("idx")
        _, paths = climbed(own["digest"].tolist(), fanout, levels, int(own["bucket"].iloc[0]) == 0)
        rest = above["path"].iloc[0]
        return own.drop(columns="bucket").assign(path=[p + "," + rest if p and rest else p or rest for p in paths])

    tops = written(bucketed.select("tree", "idx", "digest", "bucket").groupBy("tree", "bucket").applyInPandas(top, "tree string, idx long, digest string"))
    above, roots = with_paths(tops, last // size, fanout, levels)
    return bucketed.groupBy("tree", "bucket").cogroup(above.select("tree", F.col("idx").alias("bucket"), "path").groupBy("tree", "bucket")).applyInPandas(down, schema), roots


def last_index(nodes: DataFrame) -> int:
    return nodes.agg(F.max("idx")).first()[0] or 0


def manifest(docs: DataFrame, carry: dict[str, Column] | None = None, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """Per row of docs: doc_id, source, leaf, subroot (of its source), root (of the dataset), path, and carry's columns (text).

    A source's leaves ascend by doc_id, nulls first, equal ids by digest; sources stand null first, then by bytes. Runs of `fanout` nodes
    become one, a last run of fewer and of one node too, until one is left; a lone leaf is its own root and has an empty path. Nulls in any
    field have an encoding of their own, so null and empty differ; texts of any length are one digest; repeated rows are leaves of
    their own; an empty table has no rows; columns that aren't in FIELDS or carry, whatever their names, take no part.
    """
    extra = {f"carry_{i}": v for i, v in enumerate((carry or {}).values())}
    kind = dict(docs.dtypes)["doc_id"]
    rows = written(docs.select("doc_id", encoded(F.col("source")).alias("tree"), digest([F.col(c) for c in FIELDS]).alias("digest"), *[v.alias(c) for c, v in extra.items()], F.monotonically_increasing_id().alias("row")))
    placed = numbered(rows, ["tree"], ["doc_id", "digest", "row"], "idx")
    leaves = written(placed.select("tree", "idx", "digest", F.col("doc_id").cast("string").alias("doc_id"), *extra))
    released(rows, placed)
    named, roots = with_paths(leaves, last_index(leaves), fanout, levels)
    # a source's name follows the colon of its encoding
    subroots = written(roots.select(F.lit("all").alias("tree"), F.expr("CASE WHEN tree <> '-' THEN substring(tree, locate(':', tree) + 1) END").alias("source"), F.col("tree").alias("name"), "digest"))
    sources = written(numbered(subroots, ["tree"], ["source", "name"], "idx").select("tree", "idx", "digest", "name", "source"))
    upper, root = with_paths(sources, last_index(sources), fanout, levels)
    upper = upper.select("name", "source", F.col("digest").alias("subroot"), F.col("path").alias("upper"), "tree").join(root.select(F.col("tree").alias("all"), F.col("digest").alias("root")), F.col("tree") == F.col("all")).drop("tree", "all")
    path = F.concat_ws(",", F.nullif("path", F.lit("")), F.nullif("upper", F.lit("")))
    return named.join(upper, named["tree"] == upper["name"]).select(F.col("doc_id").cast(kind), "source", F.col("digest").alias("leaf"), "subroot", "root", path.alias("path"), *[F.col(f"carry_{i}").alias(c) for i, c in enumerate(carry or {})])
