"""What is sent to the driver: tile sizes, never the copies of fingerprints, however small their table looks to Spark."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wanescope.llm import simhash
from wanescope.llm.common import written


def sent(df) -> list[list[str]]:
    """The nodes below each broadcast of a plan that has run."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].split("\n")
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    out = []
    for i, x in enumerate(lines):
        if "BroadcastExchange" in x:
            ends = next((j for j in range(i + 1, len(lines)) if depth(lines[j]) <= depth(x)), len(lines))
            out.append([y.lstrip(" :+-*()0123456789") for y in lines[i + 1 : ends]])
    return out


@pytest.mark.parametrize("segments", [4, 8])
def test_fingerprint_copies_are_not_broadcast(spark, segments):
    """The copies look like 10 kB to Spark; the counts that they are summed to are known to be more when the join is chosen."""
    fp = F.xxhash64(F.floor(F.col("id") / 2))
    classes = written(spark.range(400).select(F.when(F.col("id") % 2 == 1, fp.bitwiseXOR(F.lit(1 << 40))).otherwise(fp).alias("fp"), F.col("id").alias("rep")))
    key, before = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(key, "65536")
    try:
        found = simhash.links(classes, 2, segments)
        got = {tuple(sorted((r.u, r.v))) for r in found.collect()}
    finally:
        spark.conf.set(key, before)
    for below in sent(found):
        assert next(x for x in below if x.startswith(("Generate", "HashAggregate"))).startswith("HashAggregate"), below
    fps = np.sort(np.array([r.fp for r in classes.collect()]))
    x, y = np.nonzero(np.triu(np.bitwise_count((fps[:, None] ^ fps[None, :]).view(np.uint64)) <= 2, 1))
    assert len(x) == 200 and got == {(int(fps[i]), int(fps[j])) for i, j in zip(x, y)}
