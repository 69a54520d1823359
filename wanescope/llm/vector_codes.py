"""Product codes of vectors: each vector's parts as indexes of small codebooks, learned from all vectors with exact integers.

A round is one pass over the stored vectors: Python tasks find each part's nearest entry and write, beside each vector and its code, one row
of sums and counts a task; these are added up in Spark by their place, and only one codebook's worth of numbers reaches the driver.

The nearest entry is found by an exponion search: it starts at the entry that the part had in the last round, at distance u. An entry that is
as near lies within 2u of that entry, so of its neighbours, sorted by their distance from it, only those with D <= 4 u^2 (squares, hence
exact) are looked at; equal distances go to the lower index.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wanescope.llm.common import released, written

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6


def integers(x: np.ndarray) -> np.ndarray:
    """floor(SCALE x), exactly: 64-bit integers, or Python's where a component doesn't fit."""
    y = x.astype(np.float64)
    if y.size == 0 or np.abs(y).max() < 2.0**40:
        return np.floor(y * SCALE).astype(np.int64)  # SCALE is a power of two, so the product is exact
    return np.array([floor(Fraction(v) * SCALE) for v in y.tolist()], object)


def nearest(x: np.ndarray, start: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance of each part. x: vectors, parts, width; start: vectors, parts; books: parts, entries, width."""
    width = max(1, x.shape[2])
    if x.dtype != object and books.dtype != object and x.size and books.size:
        most = max(int(np.abs(x).max()), int(np.abs(books).max()))
        if 16 * width * most * most >= 2**62:  # 4 u^2 may not fit
            x, books = x.astype(object), books.astype(object)
    code, dist = start.copy(), np.zeros(start.shape, x.dtype)
    for p, c in enumerate(books):
        apart = ((c[:, None] - c[None]) ** 2).sum(2)
        order = np.argsort(apart, axis=1, kind="stable")
        apart = np.take_along_axis(apart, order, 1)
        a, own = start[:, p], x[:, p]
        best, at = ((own - c[a]) ** 2).sum(1), a.copy()
        within = (apart[a] <= 4 * best[:, None]).sum(1)
        for r in range(len(c)):
            some = np.flatnonzero(within > r)
            if not len(some):
                break
            other = order[a[some], r]
            d = ((own[some] - c[other]) ** 2).sum(1)
            closer = (d < best[some]) | ((d == best[some]) & (other < at[some]))
            some, other, d = some[closer], other[closer], d[closer]
            best[some], at[some] = d, other
        code[:, p], dist[:, p] = at, best
    return code, dist


def _book(books: list[list[list[int]]]) -> np.ndarray:
    flat = [v for p in books for e in p for v in e]
    return np.array(books, np.int64 if all(abs(v) < 2**52 for v in flat) else object).reshape(len(books), len(books[0]), len(books[0][0]))


def _pass(rows: DataFrame, books: list[list[list[int]]], parts: int, sums: bool) -> DataFrame:
    """rows (vec_id, label, vector, code) with new codes and error; sums: one more row a task holds entries' sums and counts."""
    fields = {f.name: f for f in rows.schema.fields}
    schema = T.StructType([fields["vec_id"], fields["label"], fields["vector"], T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType()), T.StructField("sums", T.ArrayType(T.DecimalType(38, 0)))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = _book(books)
        total, kinds = np.zeros((parts, c.shape[1], c.shape[2] + 1), object), None
        for b in batches:
            kinds = [b.schema.field(n).type for n in ("vec_id", "label", "vector")]
            n = b.num_rows
            x = integers(b.column("vector").flatten().to_numpy(zero_copy_only=False)).reshape(n, parts, c.shape[2])
            start = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(n, parts).astype(np.int64)
            code, dist = nearest(x, start, c)
            error = [v if v < 2**63 else None for v in dist.astype(object).sum(1)]
            raw = code.astype(np.uint8).tobytes()
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), b.column("vector"), pa.array([raw[i * parts : (i + 1) * parts] for i in range(n)], pa.binary()), pa.array(error, pa.int64()), pa.nulls(n, pa.list_(pa.decimal128(38, 0)))], [f.name for f in schema.fields])
            for p in range(parts) if sums else ():
                for e in np.unique(code[:, p]):
                    of = x[code[:, p] == e, p]
                    total[p, e, :-1] += of.astype(object).sum(0) if of.dtype == object or (of.size and np.abs(of).max() >= 2**40) else of.sum(0).astype(object)
                    total[p, e, -1] += len(of)
        if sums and kinds:
            yield pa.RecordBatch.from_arrays([*[pa.nulls(1, k) for k in kinds], pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), pa.array([[Decimal(int(v)) for v in total.ravel()]], pa.list_(pa.decimal128(38, 0)))], [f.name for f in schema.fields])

    return rows.select("vec_id", "label", "vector", "code").mapInArrow(run, schema)


def _moved(state: DataFrame, books: list[list[list[int]]]) -> list[list[list[int]]]:
    """Each entry at the floor of its parts' mean; entries without parts stay."""
    added = {r.pos: int(r.total) for r in state.where("sums IS NOT NULL").select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col").alias("total")).collect()}
    width, out = len(books[0][0]) + 1, []
    for p, entries in enumerate(books):
        out.append([])
        for e, entry in enumerate(entries):
            at = (p * len(entries) + e) * width
            count = added.get(at + width - 1, 0)
            out[-1].append([added[at + i] // count for i in range(width - 1)] if count else entry)
    return out


def compress(vectors: DataFrame, vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[list[list[int]]]]:
    """(vec_id, label, code, error) of every kept row, and the codebooks (part, entry, component).

    code: one byte a part. Dropped are rows whose vector is null, holds a null or a component that isn't finite, or has another length than
    that of the smallest vec_id (which `parts` must divide). Codebooks start from the smallest vec_ids (nulls last, equal ones by vector);
    with fewer kept rows than entries they have as many entries as rows, and an empty table gives no rows and no entries. Null and repeated
    vec_ids, null labels and equal vectors are rows like any other; equal distances go to the lower entry; other columns take no part.
    error: a sum of squared distances, null beyond 64 bits. Components may be of any size up to 10^34 or so.
    """
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    kept = vectors.select("vec_id", "label", F.col(vector).alias("vector")).where(F.coalesce(finite, F.lit(False)))
    order = [F.col("vec_id").asc_nulls_last(), F.col("vector")]
    if not (head := kept.orderBy(*order).limit(1).collect()):
        return kept.select("vec_id", "label", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error")), []
    size = len(head[0].vector)
    if size % parts:
        raise ValueError(f"{size} components can't be cut into {parts} equal parts")
    kept, width = kept.where(F.size("vector") == size), size // parts
    first = [[int(v) for v in integers(np.array(r.vector, np.float64))] for r in kept.orderBy(*order).limit(entries).collect()]
    books = [[v[p * width : (p + 1) * width] for v in first] for p in range(parts)]
    state = kept.withColumn("code", F.lit(bytes(parts)))
    for _ in range(rounds):
        before, state = state, written(_pass(state, books, parts, True))
        released(before)
        books = _moved(state, books)
        state = _rows_of(state)
    out = written(_pass(state, books, parts, False).select("vec_id", "label", "code", "error"))
    released(state)
    return out, books


def _rows_of(state: DataFrame) -> DataFrame:
    """A pass's vectors without its rows of sums."""
    out = state.where("sums IS NULL")
    out._written_to = state._written_to
    return out


def digest(books: list[list[list[int]]]) -> str:
    """SHA-256 of all entries' components by part, entry and place."""
    return hashlib.sha256(",".join(str(v) for p in books for e in p for v in e).encode()).hexdigest()


def label_errors(coded: DataFrame) -> DataFrame:
    """coded with label_error: the error summed over the rows of an equal label, nulls together."""
    total = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    of = total.select(F.col("label").alias("of_label"), "label_error")
    return coded.join(of, coded["label"].eqNullSafe(of["of_label"])).drop("of_label")
