"""Best-fit packing of token sequences by minimum bin slack.

Every document is tokenised whole and cut only where it is longer than a sequence. What packing needs of the corpus is how many
pieces there are of each length: at most `capacity` numbers, whatever the corpus' size. Over that histogram minimum bin slack runs as
for single pieces: the longest piece left opens a sequence, a bitset subset-sum programme over the lengths left finds the fullest
feasible filling, and the combination is removed; where counts allow it is removed as often as it fits, which is what repeating the
search would choose. The resulting plan says which sequence the r-th piece of a length goes to. Ranks within a length are counted in
salted groups with running offsets, so a length that holds a third of all pieces is spread over many tasks.

Nulls: a null text counts as empty and gives one piece with the end token only; a null doc_id stays null. Repeated rows are packed
as often as they occur. An empty table gives an empty result. Of fillings that are equally full the one that the programme finds
first is taken; any is right. Columns other than the id and text ones, whatever their names, take no part.
"""

from __future__ import annotations

import sys
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from wanescope.llm.common import KEPT, written

CAPACITY, END_ID = 4096, 1
#: Chunks whose ids a Python worker keeps, and the longest one in bytes that it does: at some 200 bytes each, about 80 MB.
CACHE_CHUNKS, LONGEST = 400_000, 64
#: Texts that a worker takes at once.
TEXTS = 128
#: Closing marks: a run of them behind letters is a pre-token of its own. Not the apostrophe, which may begin one with letters.
CLOSING = b".,;:!?#$%&*|"
#: Pieces in a salted rank group, about, and the least number of groups of a length.
GROUP_ROWS, LEAST_SALTS = 100_000, 256

_CACHE: dict[str, WordIds] = {}
KEPT.append(_CACHE)


def _byte_letters() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte: itself if it is printable Latin-1, else one from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(spare)) for b in range(256)]


def as_bytes(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit numbers."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class WordIds:
    """Token ids of whole texts for a lower-casing byte-level tokenizer whose tokens never span blanks.

    Each distinct blank-separated chunk is looked at once and kept, as little-endian unsigned 32-bit ids. A chunk of letters with closing
    marks behind them is two pre-tokens, which go straight to the merges; any other chunk takes the tokenizer's whole way. A pre-token is
    a chunk, too, with the same ids, so both are kept in one table. It has two generations: a full one becomes the older, from which what
    is met again moves back.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.of, self.letters = Tokenizer.from_file(path), _byte_letters()
        self.of.model._resize_cache(0)  # what is met again is kept here
        self.chunks: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def kept(self, chunk: bytes) -> bytes | None:
        """Ids of a chunk that is kept."""
        found = self.chunks.get(chunk)
        if found is None and (found := self.older.get(chunk)) is not None:
            self.chunks[chunk] = found
        return found

    def merged(self, part: bytes) -> bytes:
        """Ids of one pre-token."""
        found = self.kept(part)
        if found is None:
            shown = part.decode() if part.isascii() else "".join([self.letters[b] for b in part])
            found = as_bytes([t.id for t in self.of.model.tokenize(shown)])
            if len(part) <= LONGEST:
                self.chunks[part] = found
        return found

    def simple(self, chunk: bytes) -> bytes | None:
        """Ids of a chunk of letters and closing marks; None if it isn't one."""
        head = chunk.rstrip(CLOSING)
        tail = chunk[len(head) :]
        if not head.isascii():
            word = head.decode()
            if not word.isalpha():
                return None
            word = "".join([c.lower() for c in word])
            if not (word.isalpha() and unicodedata.is_normalized("NFC", word)):
                return None
            head = word.encode()
        elif head and not head.isalpha():
            return None
        else:
            head = head.lower()
        return (self.merged(head) if head else b"") + (self.merged(tail) if tail else b"")

    def looked_up(self, chunks: list[bytes]) -> dict[bytes, bytes]:
        """Ids of chunks that aren't kept yet."""
        new = {c: self.simple(c) for c in chunks}
        hard = [c for c, ids in new.items() if ids is None]
        if hard:
            for c, e in zip(hard, self.of.encode_batch_fast([c.decode() for c in hard], add_special_tokens=False)):
                new[c] = as_bytes(e.ids)
        return new

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        if len(self.chunks) > CACHE_CHUNKS // 2:
            self.older, self.chunks = self.chunks, {}
        # special tokens are told apart by case, so texts that may hold one keep theirs
        split = [(t if b"<|" in t else t.lower()).split() for t in texts]
        every = list(set().union(*split))
        ids = dict(zip(every, map(self.kept, every)))  # small beside what is kept, so that each word's look-up is quick
        new = self.looked_up([c for c, found in ids.items() if found is None])
        ids.update(new)
        self.chunks.update({c: x for c, x in new.items() if len(c) <= LONGEST})
        return [np.frombuffer(b"".join(map(ids.__getitem__, words)), "<u4") for words in split]


def word_ids(path: str) -> WordIds:
    if path not in _CACHE:
        _CACHE[path] = WordIds(path)
    return _CACHE[path]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's pieces."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_ids(tokenizer_path)
        for b in batches:
            rows, cut = [], []
            for i in range(0, b.num_rows, TEXTS):
                for k, ids in enumerate(coder.encode([t or b"" for t in b.column(1)[i : i + TEXTS].to_pylist()]), i):
                    ids = np.append(ids, np.array(end_id, "<u4"))
                    for p, s in enumerate(range(0, len(ids), capacity)):
                        rows.append(k)
                        cut.append((p, s, min(capacity, len(ids) - s), zlib.crc32(ids[s : s + capacity].tobytes())))
            cols = [list(x) for x in zip(*cut)] or [[]] * 4
            yield pa.record_batch([b.column(0).take(pa.array(rows, pa.int64())), *(pa.array(x, t) for x, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.int64())))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(scan, f"doc_id {dict(rows.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long")


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> dict[int, int]:
    """How often each length (descending) goes into the fullest filling of `room`: subset sums as the bits of one integer."""
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for n in lengths:
        if n > room:
            continue
        left, take = min(counts[n], room // n), 1
        while left and not reach >> room & 1:  # 1, 2, 4, ... copies at once
            k = min(take, left)
            steps.append((n, k, reach))
            reach |= (reach << n * k) & mask
            left, take = left - k, take * 2
        if reach >> room & 1:
            break
    at, out = reach.bit_length() - 1, {}
    for n, k, before in reversed(steps):
        if not before >> at & 1:
            out[n] = out.get(n, 0) + k
            at -= n * k
    return out


def minimum_bin_slack(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Combinations (length -> copies) and how many sequences use each."""
    left = {n: c for n, c in sorted(histogram.items(), reverse=True) if c > 0}
    lengths, plan = list(left), []
    while lengths:
        first = lengths[0]
        left[first] -= 1
        mix = fullest(lengths, left, capacity - first)
        left[first] += 1
        mix[first] = mix.get(first, 0) + 1
        times = min(left[n] // k for n, k in mix.items())
        for n, k in mix.items():
            left[n] -= k * times
        lengths = [n for n in lengths if left[n]]
        plan.append((mix, times))
    return plan


def slots(plan: list[tuple[dict[int, int], int]], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first rank, copies in a sequence, first sequence, offset), by length and rank."""
    rows, used, sequence = [], {}, 0
    for mix, times in plan:
        offset = 0
        for n, k in sorted(mix.items(), reverse=True):
            rows.append((n, used.get(n, 0), k, sequence, offset))
            used[n] = used.get(n, 0) + k * times
            offset += n * k
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def ranked(rows: DataFrame, salts: int) -> DataFrame:
    """rows with `rank`, from 0 within each length, in the order of salt and `row`, a number of its own for each row, which is dropped."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int"))
    inside = salted.withColumn("at", F.row_number().over(Window.partitionBy("length", "salt").orderBy("row")) - 1)
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)))
    return inside.join(before, ["length", "salt"]).select(*[c for c in rows.columns if c != "row"], (F.col("at") + F.coalesce("before", F.lit(0))).alias("rank"))


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece."""
    cut = written(pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col).withColumn("row", F.monotonically_increasing_id()))
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    where = slots(minimum_bin_slack(histogram, capacity), capacity)
    width = sum(histogram.values()) + 1
    table = cut.sparkSession.sparkContext.broadcast(where)  # a bounded number of rows for each of `capacity` lengths

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = table.value
        keys = s[:, 0] * width + s[:, 1]
        for b in batches:
            n, r = b.column("length").to_numpy(), b.column("rank").to_numpy()
            at = np.searchsorted(keys, n * width + r, "right") - 1
            nth = r - s[at, 1]
            out = [*b.columns[:-1], pa.array(s[at, 3] + nth // s[at, 2]), pa.array(s[at, 4] + nth % s[at, 2] * n)]
            yield pa.record_batch(out, names=[*b.schema.names[:-1], "sequence_id", "offset"])

    salts = max(LEAST_SALTS, sum(histogram.values()) // GROUP_ROWS)
    schema = T.StructType([*cut.drop("row").schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked(cut, salts).mapInArrow(place, schema)
