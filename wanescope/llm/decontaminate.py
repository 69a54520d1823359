"""Benchmark decontamination by winnowing (Schleimer, Wilkerson, Aiken, "Winnowing", 2003).

Texts become words; of every `window` consecutive k-gram hashes the least ones are kept as fingerprints, so two texts that share
window + gram - 1 words (13 here) share a fingerprint. Document fingerprints are joined with the benchmark's on the hash, and each
hit is extended by as many words as can still belong to a span of the guaranteed length: the fingerprint carries the hashes of the
words around it, so extension needs no second look at the text. Every occurrence of such a span holds a fingerprint of its own, so
local extension finds all of its words. Items shorter than the guaranteed length are fingerprinted whole, by their own length.

Nulls: a null text has no words; a null item_id matches but cannot be named, and counts as no item. Null doc_ids are rows like any
other. Rows are told apart by doc_id and a hash of the text; repeated rows come back as often as they came. An item without words
never occurs. An empty benchmark contaminates nothing. Columns other than the id and text ones, whatever their names, take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wanescope.llm.common import joined, mix, slices, word_hashes, word_spans, written

#: Words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z, as bytes: digits, a-z and every byte of a non-ASCII character.
IS_WORD = np.zeros(256, bool)
IS_WORD[0x30:0x3A] = IS_WORD[0x61:0x7B] = IS_WORD[0x80:] = True
SPAN, GRAM = 13, 5
#: Distinct benchmark hashes up to which they are sent to the tasks, which then pass on only rows that can join; and index rows up
#: to which the join broadcasts them. Beyond, every fingerprint is shuffled to the join.
FILTER_HASHES, BROADCAST_ROWS = 4_000_000, 100_000
BYTES = 2_000_000


def _sliding(f, x: np.ndarray, n: int) -> np.ndarray:
    """f over each n consecutive values."""
    done = 1
    while done < n:
        step = min(done, n - done)
        x = f(x[:-step], x[step:])
        done += step
    return x


def _winnowed(grams: np.ndarray, window: int) -> np.ndarray:
    """Whether a gram is the least of some window that holds it; all of a text with fewer grams than a window are kept."""
    if len(grams) < window or window < 2:
        return np.ones(len(grams), bool)
    least = _sliding(np.minimum, grams, window)
    ends = np.zeros(window - 1, np.uint64)
    return _sliding(np.maximum, np.concatenate((ends, least, ends)), window) == grams


def _grams(words: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for i in range(n if len(out) else 0):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[i : len(words) - n + 1 + i]
    return mix(out + np.uint64(n))


def _scan(ids: str, lengths: list[int], span: int, gram: int, known=None, whole: bool = False, mark: bool = False):
    """A function for mapInArrow: rows (id, thash, n_words, length, hash, pos, around) for each fingerprint, and where `mark` one row with
    null hash for each text. length is 0 for winnowed fingerprints. whole: texts shorter than the span give their one window."""
    window = span - gram + 1

    def rows_of(words: np.ndarray, n: int) -> tuple[list, ...]:
        at, kind, found = [], [], []
        for length in [0, *lengths]:
            k = length or gram
            if whole and length != (n if n < span else 0):
                continue
            g = _grams(words, k)
            pos = np.flatnonzero(_winnowed(g, 1 if length else window)) if not whole or not length else np.zeros(min(1, len(g)), np.int64)
            if known is not None and len(pos):
                bits, hashes = known.value
                pos = pos[bits[g[pos] >> np.uint64(44)]]
                pos = pos[np.isin(g[pos], hashes)] if len(pos) else pos
            at.append(pos)
            kind.append(np.full(len(pos), length, np.int32))
            found.append(g[pos])
        return (np.concatenate(at), np.concatenate(kind), np.concatenate(found)) if at else (np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint64))

    reach = span - gram

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [(t or b"").lower() for t in b.column(2).to_pylist()]
            for i, j in slices(np.fromiter((len(t) for t in texts), np.int64, len(texts)), BYTES):
                buf, starts = joined(texts[i:j])
                s, e = word_spans(buf, IS_WORD)
                hashes = word_hashes(buf, s, e) | np.uint64(2)  # never 0 or 1, which stand for no word
                first = np.searchsorted(s, starts)
                row, n_words, kind, found, pos, around = [], [], [], [], [], []
                for r in range(j - i):
                    words, n = hashes[first[r] : first[r + 1]], int(first[r + 1] - first[r])
                    if mark:
                        row.append([i + r]), n_words.append([n]), kind.append([0]), found.append([None]), pos.append([0]), around.append([None])
                    p, k, g = rows_of(words, n)
                    if len(p):
                        pad = np.concatenate((np.full(reach, int(whole), np.uint64), words, np.full(span, int(whole), np.uint64)))
                        row.append([i + r] * len(p)), n_words.append([n] * len(p)), kind.append(k.tolist()), found.append(g.view(np.int64).tolist()), pos.append(p.tolist())
                        around.append(pad[p[:, None] + np.arange(reach + span)].view(np.int64).tolist())
                flat = lambda x: [v for y in x for v in y]
                at = pa.array(flat(row), pa.int64())
                yield pa.record_batch(
                    [b.column(0).take(at), b.column(1).take(at), pa.array(flat(n_words), pa.int64()), pa.array(flat(kind), pa.int32()), pa.array(flat(found), pa.int64()), pa.array(flat(pos), pa.int64()), pa.array(flat(around), pa.list_(pa.int64()))],
                    names=["id", "thash", "n_words", "length", "hash", "pos", "around"],
                )

    return scan, f"id {ids}, thash long, n_words long, length int, hash long, pos long, around array<long>"


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("thash"), F.col(text_col).cast("binary").alias("text"))


def benchmark_index(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """(length, hash, around, items): the benchmark's fingerprints, with the items that have each in the same surroundings."""
    rows = _texts(benchmark, id_col, text_col)
    scan, schema = _scan(dict(rows.dtypes)["id"], list(range(1, span)), span, gram, whole=True)
    return written(rows.mapInArrow(scan, schema).groupBy("length", "hash", "around").agg(F.collect_set("id").alias("items")))


def _extended(span: int, gram: int) -> tuple[Column, Column]:
    """First and last word (exclusive) of the shared span around a hit, relative to the fingerprint; null if it is too short."""
    reach = span - gram
    same = [F.get("around", F.lit(i)) == F.get("there", F.lit(i)) for i in range(reach + span)]
    left, right = F.lit(reach), F.lit(reach)
    for i in range(reach - 1, -1, -1):
        left = F.when(~same[reach - 1 - i], F.lit(i)).otherwise(left)
        right = F.when(~same[reach + gram + i], F.lit(i)).otherwise(right)
    core = same[reach]
    for i in range(1, gram):
        core = core & same[reach + i]
    short = F.forall(F.sequence(F.lit(reach), F.lit(reach - 1) + F.col("length")), lambda i: F.get("around", i) == F.get("there", i))
    long_hit = core & (left + right + gram >= span)
    start = F.when(F.col("length") > 0, F.when(short, 0)).when(long_hit, -left)
    end = F.when(F.col("length") > 0, F.when(short, F.col("length"))).when(long_hit, right + gram)
    return start, end


def contamination(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, thash, n_words, n_hit, spans, items) for every document: the words in shared spans, the merged spans as
    (start, end) word positions, and the sorted ids of the items that share them."""
    spark = docs.sparkSession
    index = benchmark_index(benchmark, item_col, item_text_col, span, gram)
    size = index.count()
    lengths = sorted(r[0] for r in index.select("length").distinct().collect() if r[0])  # at most span - 1
    known = None
    if size <= FILTER_HASHES:
        hashes = np.sort(np.fromiter((r[0] for r in index.select("hash").distinct().toLocalIterator()), np.int64).view(np.uint64))
        bits = np.zeros(1 << 20, bool)
        bits[hashes >> np.uint64(44)] = True
        known = spark.sparkContext.broadcast((bits, hashes))
    rows = _texts(docs, id_col, text_col)
    scan, schema = _scan(dict(rows.dtypes)["id"], lengths, span, gram, known, mark=True)
    there = index.select(F.col("length").alias("l2"), F.col("hash").alias("h2"), F.col("around").alias("there"), "items")
    start, end = _extended(span, gram)
    hits = (
        rows.mapInArrow(scan, schema)
        .join(F.broadcast(there) if size <= BROADCAST_ROWS else there, (F.col("hash") == F.col("h2")) & (F.col("length") == F.col("l2")), "left")
        .withColumns({"start": start, "end": end})
        .select("id", "thash", "n_words", "hash", F.when(F.col("end").isNotNull(), F.struct((F.col("pos") + F.col("start")).alias("start"), (F.col("pos") + F.col("end")).alias("end"))).alias("hit"), F.when(F.col("end").isNotNull(), F.col("items")).alias("items"))
        .where("hash is null or hit is not null")
    )
    per_doc = hits.groupBy("id", "thash").agg(F.max("n_words").alias("n_words"), F.count(F.when(F.col("hash").isNull(), 1)).alias("copies"), F.sort_array(F.collect_set("hit")).alias("hits"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")
    merged = F.aggregate(
        "hits",
        empty,
        lambda done, x: F.when((F.size(done) > 0) & (F.element_at(done, -1)["end"] >= x["start"]), F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], x["end"]).alias("end"))))).otherwise(F.concat(done, F.array(x))),
    )
    out = per_doc.withColumn("spans", F.when(F.size("hits") > 0, merged).otherwise(empty)).withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"]))
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.greatest("copies", F.lit(1)).cast("int")))).select(F.col("id").alias("doc_id"), "thash", "n_words", "n_hit", "spans", F.array_sort("items").alias("items"))


def is_contaminated() -> Column:
    """The rule: some word is hit, and hit words are a twentieth of all words at least."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
