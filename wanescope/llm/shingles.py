"""Groups of documents linked by the Jaccard similarity of their sets of word shingles: exact, by prefixes of the sets.

Sets whose similarity reaches the threshold share a shingle among their first `n - ceil(threshold * n) + 1` in any order that is the same
everywhere; here shingles that a sample repeats come last, and the others go by the count of their rarest word in all texts, so that
common phrases make few candidates whatever the sample holds, and so do chance phrases of frequent words, whose number grows with the
square of the texts. Candidates whose parities don't tell them apart are verified on the whole sets. Three rounds, of which each spares
the next one pairs in one component: fingerprints within a radius (SimHash tiles) against their least neighbour, each set against the
least one of each prefix shingle, and all pairs of different components that share one. The last round makes the links complete; the
first two settle large groups in as many pairs as they have members.

Sets are of 64-bit shingle hashes. Equal sets are one class; texts without words are one class, too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wanescope.llm import simhash
from wanescope.llm.common import BLANKS, KEPT, MIX1, mix, released, word_hashes, word_spans, written
from wanescope.llm.components import connected_components

#: Jaccard threshold as a fraction.
THRESHOLD = (4, 5)
#: About how many texts are in the sample that orders shingles, and the most shingles that it puts last.
SAMPLE_DOCS, COMMON = 20_000, 100_000
#: Hash buckets for word counts: a fixed power of two, whatever the corpus.
BUCKETS = 1 << 18
#: Parts of the shingles, a power of two, that are counted one after another: the disk holds one part's shuffle at a time.
PASSES = 4
IS_WORD = np.array([b not in BLANKS for b in range(256)])


def shingle_hashes(text: bytes | None, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a text's words and of its shingles of k words; a text of fewer words is one shingle, one without words none."""
    buf = np.frombuffer((text or b"").lower() + b" ", np.uint8)
    h = word_hashes(buf, *word_spans(buf, IS_WORD))
    k = min(k, len(h))
    if not k:
        return h, h
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = mix(out * MIX1 + h[i : len(h) - k + 1 + i])
    return h, out


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles of k words."""
    return np.unique(shingle_hashes(text, k)[1])


def word_levels(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The level of each of BUCKETS hash buckets of words, a half power of two of the count of its words in all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for t in b.column(0):
                np.add.at(n, (shingle_hashes(t.as_py(), 1)[0] & np.uint64(BUCKETS - 1)).astype(np.int64), 1)
        at = np.flatnonzero(n)
        yield pa.record_batch([pa.array(at), pa.array(n[at])], names=["bucket", "n"])

    found = docs.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # at most BUCKETS rows
    out = np.zeros(BUCKETS, np.uint8)
    out[found.column("bucket").to_numpy()] = np.floor(2 * np.log2(found.column("n").to_numpy()))
    return out


def rarest_first(text: bytes | None, k: int, levels: np.ndarray, known: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A text's shingle set: common shingles (known, ascending) last, in the order of place; others by the level of their rarest word."""
    words, every = shingle_hashes(text, k)
    if not len(words):
        return words
    s, first = np.unique(every, return_index=True)
    level, k = levels[(words & np.uint64(BUCKETS - 1)).astype(np.int64)], min(k, len(words))
    least = np.minimum.reduce([level[i : len(level) - k + 1 + i] for i in range(k)])[first]
    at = np.minimum(np.searchsorted(known, s), max(len(known) - 1, 0))
    common = np.where(known[at] == s, place[at] + 1, 0) if len(known) else np.zeros(len(s), np.int64)
    return s[np.lexsort((s, least, common))]


def parities(s: np.ndarray) -> bytes:
    """Parities of how many of the hashes have each value of their low bits: a power of two of parities, at least 64 and twice the hashes."""
    size = 1 << max(6, (2 * len(s) - 1).bit_length())
    return np.packbits(np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).tobytes()


def differing(x: bytes, y: bytes) -> int:
    """Differing parities of two sets: at most the hashes that only one of them has. The longer parities are folded to the shorter ones."""
    a, b = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
    return int(np.bitwise_count(a ^ np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)).sum())


def common_shingles(docs: DataFrame, k: int, text_col: str = "text") -> np.ndarray:
    """Shingles that several texts of a sample have, rarest first."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0):
                yield pa.record_batch([pa.array(shingle_set(t.as_py(), k).view(np.int64))], names=["h"])

    every = max(1, docs.count() // SAMPLE_DOCS)
    sample = docs.where(F.pmod(F.xxhash64(text_col), F.lit(every)) == 0).select(F.col(text_col).cast("binary").alias("text"))
    seen = sample.mapInArrow(scan, "h long").groupBy("h").agg(F.count("*").alias("n")).where("n > 2").orderBy(F.desc("n"), "h").limit(COMMON)
    return np.array([r["h"] for r in seen.collect()][::-1], np.int64).view(np.uint64)  # at most COMMON numbers


def prefix_table(docs: DataFrame, k: int, threshold: tuple[int, int] = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, thash, fp, cls, n, parities, prefix) for every row: SimHash fingerprint, class, size and parities of the shingle set, and its
    prefix."""
    p, q = threshold
    common = common_shingles(docs, k, text_col)
    order = np.argsort(common)
    sent = docs.sparkSession.sparkContext.broadcast((word_levels(docs, text_col), common[order], order))  # BUCKETS bytes, at most COMMON numbers

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kept in KEPT:
            kept.clear()
        levels, known, place = sent.value
        for b in batches:
            fp, cls, n, bits, prefix = [], [], [], [], []
            for t in b.column(2):
                text = t.as_py()
                ordered = rarest_first(text, k, levels, known, place)
                s = np.sort(ordered)
                fp.append(simhash.fingerprint(text, k))
                cls.append(xxhash.xxh64_intdigest(s.tobytes()))
                n.append(len(s))
                bits.append(parities(s))
                prefix.append(ordered[: len(s) - (p * len(s) + q - 1) // q + 1].view(np.int64))
            signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            yield pa.record_batch([b.column(0), b.column(1), signed(fp), signed(cls), pa.array(n, pa.int32()), pa.array(bits, pa.binary()), pa.array(prefix, pa.list_(pa.int64()))], names=["doc_id", "thash", "fp", "cls", "n", "parities", "prefix"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("thash"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(scan, f"doc_id {dict(rows.dtypes)['doc_id']}, thash long, fp long, cls long, n int, parities binary, prefix array<long>")


def _nearly(pairs: DataFrame, rows: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Those of pairs (u, v) whose parities differ in no more bits than sets that reach the threshold differ in shingles."""
    p, q = threshold

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [differing(x.as_py(), y.as_py()) * (p + q) <= (q - p) * n for n, x, y in zip(b.column(2).to_pylist(), b.column(3), b.column(4))]
            yield b.filter(pa.array(keep, pa.bool_())).select([0, 1])

    each = rows.select("cls", "n", "parities").dropDuplicates(["cls"])
    side = lambda c, i: each.select(F.col("cls").alias(c), F.col("n").alias(f"n{i}"), F.col("parities").alias(f"x{i}"))
    both = pairs.join(side("u", 1), "u").join(side("v", 2), "v")
    return both.select("u", "v", (F.col("n1").cast("long") + F.col("n2")).alias("n"), "x1", "x2").mapInArrow(near, "u long, v long")


def verified(docs: DataFrame, rows: DataFrame, pairs: DataFrame, k: int, threshold: tuple[int, int] = THRESHOLD, text_col: str = "text") -> DataFrame:
    """Those of pairs (u, v) of classes whose whole sets reach the threshold; a written table. Only sets of pairs that their parities
    can't tell apart are moved."""
    p, q = threshold

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([shingle_set(t.as_py(), k).tobytes() for t in b.column(1)], pa.binary())], names=["cls", "items"])

    def enough(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3)):
                one, two = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                keep.append(len(np.intersect1d(one, two, assume_unique=True)) * (p + q) >= p * (len(one) + len(two)))
            yield b.filter(pa.array(keep, pa.bool_())).select([0, 1])

    pairs = written(_nearly(pairs.distinct(), rows, threshold))
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("cls")).distinct()
    places = written(rows.join(wanted, "cls").groupBy("cls").agg(F.min("thash").alias("thash")))
    texts = docs.select(F.xxhash64(text_col).alias("thash"), F.col(text_col).cast("binary").alias("text")).join(places, "thash")
    sets = written(texts.select("cls", "text").mapInArrow(sets_of, "cls long, items binary").dropDuplicates(["cls"]))
    both = pairs.join(sets.select(F.col("cls").alias("u"), F.col("items").alias("one")), "u").join(sets.select(F.col("cls").alias("v"), F.col("items").alias("two")), "v")
    out = written(both.select("u", "v", "one", "two").mapInArrow(enough, "u long, v long"))
    released(pairs, places, sets)
    return out


def _possible(na: Column, nb: Column, at_a: Column, at_b: Column, threshold: tuple[int, int]) -> Column:
    """Whether sets of these sizes can reach the threshold, given the places of a shared shingle that comes first in both or after others."""
    p, q = threshold
    return (q * F.least(na, nb) >= p * F.greatest(na, nb)) & ((F.least(at_a, at_b) + F.least(na - at_a, nb - at_b)) * (p + q) >= p * (na + nb))


def _shared(rows: DataFrame) -> list[DataFrame]:
    """(token, cls, n, at): places of prefix shingles that several classes have, in written tables by parts of the shingles."""
    out = []
    for part in range(PASSES):
        entries = rows.select("cls", "n", F.posexplode("prefix").alias("at", "token")).where(F.col("token").bitwiseAND(F.lit(PASSES - 1)) == part)
        tokens = written(entries.groupBy("token").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo <> hi").select("token"))
        out.append(written(entries.join(tokens, "token", "left_semi").select("token", "cls", "n", "at").distinct()))
        released(tokens)
    return out


def components(docs: DataFrame, rows: DataFrame, k: int, radius: int, threshold: tuple[int, int] = THRESHOLD, text_col: str = "text") -> DataFrame:
    """(node, root) for each class that isn't the least of its component. rows: prefix_table's, written."""
    reps = written(rows.where("n > 0").groupBy("fp").agg(F.min("cls").alias("rep")))
    close = simhash.links(reps, radius).select(F.greatest("u", "v").alias("fp"), F.least("u", "v").alias("other")).groupBy("fp").agg(F.min("other").alias("other"))
    near = close.join(reps, "fp").join(reps.select(F.col("fp").alias("other"), F.col("rep").alias("u")), "other").select("u", F.col("rep").alias("v"))
    same = rows.where("n > 0").join(reps, "fp").where("cls <> rep").select(F.col("rep").alias("u"), F.col("cls").alias("v"))
    parts = _shared(rows)
    entries = parts[0]
    for x in parts[1:]:
        entries = entries.unionByName(x)
    least = entries.groupBy("token").agg(F.min(F.struct("cls", "n", "at")).alias("m"))
    stars = entries.join(least, "token").where((F.col("cls") != F.col("m.cls")) & _possible(F.col("n"), F.col("m.n"), F.col("at"), F.col("m.at"), threshold)).select(F.col("m.cls").alias("u"), F.col("cls").alias("v"))
    links = verified(docs, rows, near.unionByName(same).unionByName(stars), k, threshold, text_col)
    roots = connected_components(links)
    placed = written(entries.join(roots, entries.cls == roots.node, "left").select("token", "cls", "n", "at", F.coalesce("root", "cls").alias("root")))
    released(reps, *parts)
    split = placed.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("token")
    open_ = written(placed.join(split, "token", "left_semi"))
    released(placed)
    a, b = open_.alias("a"), open_.alias("b")
    pairs = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.root") < F.col("b.root")) & _possible(F.col("a.n"), F.col("b.n"), F.col("a.at"), F.col("b.at"), threshold))
    rest = verified(docs, rows, pairs.select(F.col("a.cls").alias("u"), F.col("b.cls").alias("v")), k, threshold, text_col)
    released(open_)
    out = connected_components(links.unionByName(rest))
    released(links, rest)
    return out
