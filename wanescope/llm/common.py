"""Helpers that the training-data operators share: shared-folder tables, row keys and vectorised word scanning."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wanescope.operators.ranking import unused
from wanescope.shared import opened, released, released_but, shared_dir, written

__all__ = ["opened", "released", "released_but", "shared_dir", "unused", "written"]

#: ASCII blanks: space, tab, newline, vertical tab, form feed, carriage return.
BLANKS = b" \t\n\x0b\x0c\r"
#: As a Java regular expression: a run of them.
BLANK_RUN = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: What operators keep in a Python worker from task to task; another operator's tasks may clear it to have the memory.
KEPT: list[dict] = []


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, other characters as they are."""
    return F.translate(text, UPPER, LOWER)


def blank_words(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text as an array; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK_RUN), lambda w: w != "")


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value evaluated once: an optimiser that moves the expression can't move value into f's lambdas."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs that run inside send Python at most so many rows at once, so that whole texts and sets take little memory on either side."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `most` bytes together, at least one row each."""
    ends = np.cumsum(sizes, dtype=np.int64)
    i = 0
    while i < len(ends):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right")))
        yield i, j
        i = j


def joined(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """The texts in one buffer, a blank after each, and where each starts (and the buffer's end)."""
    buf = np.frombuffer(b" ".join([t or b"" for t in texts]) + b" ", np.uint8)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t or b"") + 1 for t in texts], out=starts[1:])
    return buf, starts


def word_spans(buf: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of bytes for which is_word[byte] holds; the buffer ends with a byte outside words."""
    inside = is_word[buf]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edges = np.concatenate(([0], edges))
    return edges[0::2], edges[1::2]


#: Fixed odd constants of the polynomial and of the finaliser (splitmix64).
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
SPAN = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POW: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, by differences of a running polynomial; extra memory stays near SPAN bytes of text."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SPAN, "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        if len(_POW.get("p", ())) < hi - lo + 1:
            size = max(SPAN, hi - lo) + 1
            _POW["p"], _POW["q"] = _powers(int(BASE), size), _powers(pow(int(BASE), -1, 1 << 64), size)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((buf[lo:hi].astype(np.uint64) + np.uint64(1)) * _POW["p"][: hi - lo], out=sums[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mix((sums[e] - sums[s]) * _POW["q"][s] + (e - s).astype(np.uint64) * MIX1)
        i = j
    return out


def without(docs: DataFrame, keys: DataFrame, pairs: dict[str, Column]) -> DataFrame:
    """docs' rows whose key isn't in keys. pairs: for each column of keys the expression over docs that it holds, null-safe. Whether the
    keys are sent to all tasks or both sides are shuffled is Spark's choice, by the keys' bytes."""
    keys = keys.distinct()
    names = {c: unused(docs, f"_key_{i}") for i, c in enumerate(pairs)}
    keys = keys.select(*[F.col(c).alias(n) for c, n in names.items()])
    on = None
    for c, value in pairs.items():
        same = value.eqNullSafe(keys[names[c]])
        on = same if on is None else on & same
    return docs.join(keys, on, "left_anti")
