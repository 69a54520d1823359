"""Replicates of groups that fit into a task's arrays: each group's values go to Python once a block of replicates, and draws are numbers
made and counted there, never rows.

The draws are those of `resample.pick`, whose prime is 2^31 - 1, so that remainders are shifts and sums of 64-bit integers. A block's task
holds one group of up to HELD rows; callers have a form in joins for larger ones, with the same draws.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of the largest group that a task holds, draws of a block and the fewest replicates of one, places of a row of arrays, and draws made at once.
HELD, DRAWS, LEAST_REPS, CHUNK, STEP = 1 << 23, 1 << 25, 16, 1 << 14, 1 << 14
PRIME = np.uint64(2147483647)
BITS = np.uint64(31)


def _folded(x: np.ndarray, t: np.ndarray, times: int) -> None:
    """x modulo PRIME in place; once is enough below 2^61, twice below 2^63. t: room for as many numbers."""
    for _ in range(times):
        np.right_shift(x, BITS, out=t)
        np.bitwise_and(x, PRIME, out=x)
        np.add(x, t, out=x)
    np.subtract(x, PRIME, out=t)  # huge where x is less
    np.minimum(x, t, out=x)


def picks(mark: int, n: int, seed: int, out: np.ndarray) -> np.ndarray:
    """out[:n] with resample.pick's places for draws 0 to n - 1 of the replicate with this mark, from 0 to PRIME - 1."""
    x, t = np.empty(min(n, STEP), np.uint64), np.empty(min(n, STEP), np.uint64)
    whole, rep = np.uint32(n), np.uint64(mark)
    for i in range(0, n, STEP):
        k = np.arange(i, min(n, i + STEP), dtype=np.uint64)
        a, b = x[: len(k)], t[: len(k)]
        np.multiply(k, np.uint64(7919), out=a)
        a += np.uint64(mark * 1000003 + seed)
        _folded(a, b, 2)
        np.multiply(a, a, out=a)
        a += k
        _folded(a, b, 2)
        a *= np.uint64(48271)
        a += rep
        _folded(a, b, 1)
        np.multiply(a, a, out=a)
        a += np.uint64(12345)
        _folded(a, b, 2)
        small = a.astype(np.uint32)
        out[i : i + len(k)] = small - small // whole * whole
    return out[:n]


#: What a block computes: from a group's size, its arrays (place, value, and the number of the row of `inner` that each belongs to) and a
#: function that gives a replicate's picks by its mark, to a function of a mark that gives a list of numpy columns of equal length.
Statistic = Callable[[int, np.ndarray, np.ndarray, np.ndarray, Callable[[int], np.ndarray]], Callable[[int], list[np.ndarray]]]


def replicated(placed: DataFrame, by: list[str], inner: list[str], value: str, most: int, reps: int, seed: int, statistic: Statistic, columns: str, mark: Callable[[Column], Column] | None = None) -> DataFrame:
    """(by, rep, inner, columns): the statistic's rows for each group and replicate; with inner, its columns hold one number for each
    distinct value of inner, in the order that its rows have. placed: (by, inner, k, n, value), k from 0 to n - 1, values not null; groups with
    a null key have no rows. most: rows of the largest group. mark: a replicate's number in its draws, by default its own."""
    blocks = min(max(1, -(-most * reps // DRAWS)), max(1, reps // LEAST_REPS))
    for c in by:
        placed = placed.where(F.col(c).isNotNull())
    rows = placed.groupBy(*by, *inner, "n", F.floor(F.col("k") / CHUNK).alias("_chunk")).agg(F.collect_list(F.col("k").cast("int")).alias("_k"), F.collect_list(F.col(value).cast("double")).alias("_v"))
    rows = rows.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    first = lambda b: F.floor(b * F.lit(reps) / F.lit(blocks)).cast("long")
    numbers = F.sequence(first(F.col("_block").cast("long")), first(F.col("_block").cast("long") + 1) - 1)
    rows = rows.withColumn("_reps", numbers).withColumn("_marks", F.transform("_reps", mark) if mark else F.col("_reps"))
    kinds = dict(placed.dtypes)
    keys = len(by)

    def block(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        n, lists = t.column("n")[0].as_py(), t.column("_k").combine_chunks()
        k, v = lists.flatten().to_numpy(), t.column("_v").combine_chunks().flatten().to_numpy()
        named, of_row = [tuple(x) for x in zip(*(t.column(c).to_pylist() for c in inner))] if inner else [()] * len(lists), {}
        row = np.repeat([of_row.setdefault(x, len(of_row)) for x in named], lists.value_lengths().to_numpy())
        out = np.empty(n, np.int64)
        of = statistic(n, k, v, row, lambda m: picks(m, n, seed, out))
        numbers, marks = t.column("_reps")[0].as_py(), t.column("_marks")[0].as_py()
        found = [of(m) for m in marks]
        size = len(found[0][0]) if found else 0
        names = list(of_row)
        cols = [pa.repeat(key[i], size * len(found)) for i in range(keys)] + [pa.array(np.repeat(np.array(numbers, np.int64), size))]
        cols += [pa.array([x[i] for x in names] * len(found), t.schema.field(c).type) for i, c in enumerate(inner)]
        cols += [pa.array(np.concatenate([f[i] for f in found])) for i in range(len(found[0]))]
        return pa.table(cols, names=[*by, "rep", *inner, *(c.split()[0] for c in columns.split(", "))])

    # much work on few bytes: the blocks are dealt out by their number, not coalesced by their size
    parts = max(int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * placed.sparkSession.sparkContext.defaultParallelism)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "rep long", *(f"`{c}` {kinds[c]}" for c in inner), columns])
    return rows.repartition(parts, *by, "_block").groupBy(*by, "_block").applyInArrow(block, schema)


def mean(n: int, k: np.ndarray, v: np.ndarray, row: np.ndarray, drawn: Callable[[int], np.ndarray]) -> Callable[[int], list[np.ndarray]]:
    """The mean of the drawn values."""
    values = np.empty(n)
    values[k] = v
    return lambda m: [np.array([values[drawn(m)].sum() / n])]


def accuracies(n: int, k: np.ndarray, v: np.ndarray, row: np.ndarray, drawn: Callable[[int], np.ndarray]) -> Callable[[int], list[np.ndarray]]:
    """For each row of inner the mean of its values, each as often as its place was drawn; nan where none was."""
    order = np.lexsort((k, row))
    k, v, row = k[order], v[order], row[order]
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])

    def of(m: int) -> list[np.ndarray]:
        times = np.bincount(drawn(m), minlength=n)[k]
        seen = np.add.reduceat(times, starts)
        return [np.where(seen > 0, np.add.reduceat(times * v, starts) / np.maximum(seen, 1), np.nan)]

    return of


def top_variance(k_share: float, rows_only: bool, ddof: int, at_least: int) -> Statistic:
    """(n, value, n_top) of the top stratum among drawn scores, see power.Variant: the ceil(n * share) greatest ones, else all from the (1 -
    share) percentile on. Groups under at_least rows have no rows."""

    def statistic(n: int, k: np.ndarray, v: np.ndarray, row: np.ndarray, drawn: Callable[[int], np.ndarray]) -> Callable[[int], list[np.ndarray]]:
        if n < at_least:
            return lambda m: [np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)]
        order = np.argsort(-v, kind="stable")
        scores, place = v[order], np.empty(n, np.int64)
        place[k[order]] = np.arange(n)
        whole = int(max(1, np.ceil(n * k_share)))
        at = (n - 1) * (1.0 - k_share)
        lower, higher = int(np.floor(at)), int(np.ceil(at))

        def of(m: int) -> list[np.ndarray]:
            times = np.bincount(place[drawn(m)], minlength=n)
            total = np.cumsum(times)
            if rows_only:
                end, n_top = int(np.searchsorted(total, whole)) + 1, whole
                w = times[:end].copy()
                w[-1] -= total[end - 1] - whole
            else:
                a, b = (scores[np.searchsorted(total, n - i)] for i in (lower, higher))  # the value at a place from below
                cut = a if a == b else (higher - at) * a + (at - lower) * b
                end = int(np.searchsorted(-scores, -cut, "right"))
                w, n_top = times[:end], int(total[end - 1])
            s = scores[:end]
            off = s - (w * s).sum() / n_top
            value = (w * off * off).sum() / (n_top - ddof) if n_top > ddof else np.nan
            return [np.array([n]), np.array([value]), np.array([n_top])]

        return of

    return statistic
