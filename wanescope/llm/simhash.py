"""SimHash near-duplicates: 64-bit fingerprints over word shingles, and an exact tiled comparison.

A fingerprint sets the bits that are set in over half of its shingles' XXH64 values. Fingerprints link when they differ in at most
`radius` bits. Equal fingerprints are one class. The classes are cut into tiles of equal population counts (one count for each of
SEGMENTS equal parts of the 64 bits): fingerprints within the radius have tiles whose counts differ by at most the radius in sum,
so every other tile pair is skipped. A tile meets each neighbouring tile once, in chunks of at most `tile_rows` rows, by numpy
exclusive-or and bit counts. No pair within the radius is missed, and no group has more than two chunks of rows.

Nulls: a null text counts as empty, with fingerprint zero, linked like any other. A null doc_id is a row like any other; it is
never a component's smallest id, and a component of null ids only has a null id. Repeated rows come back as often as they came.
Columns other than the id and text ones, whatever their names, take no part; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wanescope.llm.components import connected_components
from wanescope.llm.common import written

RADIUS, SHINGLE_WORDS, SEED = 2, 3, 42
#: Parts of the fingerprint with a population count each: tiles get smaller with more parts, copies to neighbours more.
SEGMENTS = 4
TILE_ROWS = 8192
BLOCK = 512
#: Possible tiles up to which their sizes are sent to all tasks; four parts of 16 bits have 17^4.
BROADCAST_TILES = 100_000


def fingerprint(text: bytes | None, shingle_words: int = SHINGLE_WORDS, seed: int = SEED, step: int = 1 << 14) -> int:
    """The fingerprint of one text; `step` shingles are made at once, whatever its length."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    of, ones, k = xxhash.xxh64_intdigest, np.zeros(64, np.int64), min(shingle_words, len(words))
    n = len(words) - k + 1
    for i in range(0, n, step):
        end = min(i + step, n)
        hashes = np.fromiter((of(b" ".join(x), seed) for x in zip(*(words[i + j : end + j] for j in range(k)))), np.uint64, end - i)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) for every row; fp is the fingerprint as a signed long."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle_words, seed) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.record_batch([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(scan, f"doc_id {dict(rows.dtypes)['doc_id']}, fp long")


def _offsets(segments: int, radius: int) -> list[tuple[int, ...]]:
    """Differences of population counts that a link can have, one of each pair of opposites, none first."""
    near = [d for d in product(range(-radius, radius + 1), repeat=segments) if sum(map(abs, d)) <= radius]
    return sorted((d for d in near if d >= (0,) * segments), key=lambda d: d != (0,) * segments)


def _tile(fp, segments: int):
    """The tile of a fingerprint: its parts' population counts, seven bits each."""
    width, out = 64 // segments, F.lit(0).cast("long")
    mask = (1 << width) - 1
    for i in range(segments):
        part = F.shiftrightunsigned(fp, i * width).bitwiseAND(F.lit(mask if mask < 1 << 63 else -1).cast("long"))
        out = out * 128 + F.bit_count(part)
    return out


def _near(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Indices of pairs of a and b within the radius; for same, b is a and a pair counts once. Blocks are sorted by finer population
    counts, and block pairs whose ranges of these differ beyond the radius are skipped."""
    counts = lambda x: np.bitwise_count(x.view(np.uint8).reshape(-1, 8)).astype(np.int16)
    ca, cb = counts(a), counts(b)
    oa, ob = np.lexsort(ca.T), np.lexsort(cb.T)
    a, b, ca, cb = a[oa], b[ob], ca[oa], cb[ob]
    ranges = lambda c: [(c[i : i + BLOCK].min(0), c[i : i + BLOCK].max(0)) for i in range(0, len(c), BLOCK)]
    ra, rb = ranges(ca), ranges(cb)
    lows, highs = np.array([x[0] for x in rb]), np.array([x[1] for x in rb])
    left, right = [], []
    for i, (lo, hi) in enumerate(ra):
        apart = (np.maximum(0, np.maximum(lows - hi, lo - highs))).sum(1)
        for j in np.flatnonzero(apart <= radius):
            if same and j < i:
                continue
            x, y = np.nonzero(np.bitwise_count(a[i * BLOCK : (i + 1) * BLOCK, None] ^ b[None, j * BLOCK : (j + 1) * BLOCK]) <= radius)
            x, y = x + i * BLOCK, y + j * BLOCK
            if same:
                x, y = x[(keep := x < y)], y[keep]
            left.append(oa[x])
            right.append(ob[y])
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def links(classes: DataFrame, radius: int = RADIUS, segments: int = SEGMENTS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(u, v): links between distinct fingerprints `fp`, all within the radius, each once."""
    moves = _offsets(segments, radius)
    code = lambda d: sum(x * 128 ** (segments - 1 - i) for i, x in enumerate(d))
    own = classes.select("fp", _tile(F.col("fp"), segments).alias("tile"))
    # a tile's own rows, and copies of the rows of each neighbouring tile that meets it
    sides = own.withColumn("d", F.explode(F.array(*[F.lit(code(d)).cast("long") for d in moves]))).select("fp", (F.col("tile") + F.col("d")).alias("tile"), (F.col("d") != 0).alias("guest"))
    sizes = sides.groupBy("tile").agg(F.count(F.when(~F.col("guest"), 1)).alias("hosts"), F.count(F.when(F.col("guest"), 1)).alias("guests")).where("hosts > 0 and hosts + guests > 1")
    chunks = sizes.select("tile", F.ceil(F.col("hosts") / tile_rows).cast("int").alias("nh"), F.ceil(F.col("guests") / tile_rows).cast("int").alias("ng"))
    # Spark sizes the sides as the classes that they are copies of, and would send all of them to the driver
    chunks = F.broadcast(chunks) if (64 // segments + 1) ** segments <= BROADCAST_TILES else chunks.hint("shuffle_hash")
    spread = sides.join(chunks, "tile").withColumn("mix", F.xxhash64("fp"))
    # chunk i of the hosts meets chunk j of the hosts (i <= j) and chunk k of the guests
    h, g = F.pmod("mix", "nh").cast("int"), F.pmod("mix", F.greatest("ng", F.lit(1))).cast("int")
    places = F.when(
        F.col("guest"), F.transform(F.sequence(F.lit(0), F.col("nh") - 1), lambda i: F.struct(i.alias("i"), (F.col("nh") + g).alias("j"), F.lit(1).alias("side")))
    ).otherwise(
        F.concat(
            F.transform(F.sequence(F.lit(0), F.col("nh") - 1), lambda j: F.struct(F.least(h, j).alias("i"), F.greatest(h, j).alias("j"), F.when(h <= j, 0).otherwise(1).alias("side"))),
            F.transform(F.filter(F.sequence(F.lit(0), F.col("ng")), lambda k: k < F.col("ng")), lambda k: F.struct(h.alias("i"), (F.col("nh") + k).alias("j"), F.lit(0).alias("side"))),
        )
    )
    dealt = spread.select("tile", "fp", F.explode(places).alias("p")).select("tile", "fp", "p.i", "p.j", "p.side")

    def compare(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        fp, side = t.column("fp").to_numpy().view(np.uint64), t.column("side").to_numpy()
        if key[1].as_py() == key[2].as_py():
            a = b = fp
            x, y = _near(a, b, radius, True)
        else:
            a, b = fp[side == 0], fp[side == 1]
            x, y = _near(a, b, radius, False) if len(a) and len(b) else (np.zeros(0, np.int64),) * 2
        return pa.table({"u": np.ascontiguousarray(a[x]).view(np.int64), "v": np.ascontiguousarray(b[y]).view(np.int64)})

    return dealt.groupBy("tile", "i", "j").applyInArrow(compare, "u long, v long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle_words: int = SHINGLE_WORDS, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(doc_id, fp, component_id) for every row: its fingerprint and the smallest doc_id that links reach from it."""
    rows = written(fingerprints(docs, shingle_words, id_col=id_col, text_col=text_col))
    classes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected_components(links(classes, radius, **how))
    named = classes.join(roots, classes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = written(named)
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(named.join(ids, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def hex_digits(fp):
    """A signed long as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
