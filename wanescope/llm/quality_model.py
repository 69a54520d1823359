"""Quality classifier: regularised quadratic discriminant analysis over transformed document statistics.

Each whole text gives a fixed vector of statistics (lengths, shares of character classes, repetition of words and lines, how well it
compresses), on logarithmic scales so that classes are near normal. Class means and covariances are sums over labelled rows, added up
in Spark; covariances are shrunk towards the pooled one and towards the identity. A score is the logistic of the prior's and the
Mahalanobis log-densities' differences, from Cholesky factors computed once and sent with the tasks.

Nulls: a null text counts as empty and is scored like any other; labels with null doc_id or label, and rows with a null doc_id, aren't
learned from. Repeated rows come back as often as they came; a document with several labels is learned once for each. With no labels of
one class every score is the share of label 1, with a pseudo-count of one for each class. A score of exactly the
limit counts as label 1. Columns other than the id and text ones and the labels, whatever their names, take no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wanescope.llm.common import written

THRESHOLD = 0.7
#: Shares of the pooled covariance and of the identity in a class's covariance.
POOLED, RIDGE = 0.3, 0.05
STATISTICS = ["log_bytes", "words", "word_length", "upper", "digits", "newlines", "marks", "bang", "bar", "symbols", "other_ascii", "non_ascii", "distinct_words", "distinct_lines", "short_words", "compression"]

_CLASSES = np.zeros((256, 9), np.float64)
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"\n", b".,;:?'\"()-", b"!", b"|", b"#*$%&<>@~^", b"_=+{}[]\\/`")):
    _CLASSES[list(_chars), _k] = 1
_CLASSES[0x80:, 8] = 1


def statistics(text: bytes | None) -> list[float]:
    t = text or b""
    n, words, lines = len(t), t.split(), t.split(b"\n")
    counts = np.bincount(np.frombuffer(t, np.uint8), minlength=256) @ _CLASSES
    share = lambda x, of, k=1.0: np.log((x + k) / (of + 10 * k))
    upper, digits, newlines, marks, bang, bar, symbols, other, high = (share(c, n) for c in counts)
    return [
        np.log1p(n), share(len(words), n), np.log((sum(map(len, words)) + 5) / (len(words) + 1)), upper, digits, newlines, marks, bang, bar, symbols, other, high,
        share(len(words) - len(set(words)), len(words)), share(len(lines) - len(set(lines)), len(lines)), share(sum(len(w) < 4 for w in words), len(words)), np.log((len(zlib.compress(t, 1)) + 20) / (n + 40)),
    ]


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x) for every row: its statistics."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([statistics(t.as_py()) for t in b.column(1)], pa.list_(pa.float64()))], names=["doc_id", "x"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(scan, f"doc_id {dict(rows.dtypes)['doc_id']}, x array<double>")


def moments(rows: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Count, sum and sum of outer products of x for each label; rows: (label int, x)."""
    d = len(STATISTICS)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            y, x = b.column(0).to_numpy(), b.column(1).flatten().to_numpy().reshape(-1, d)
            for k in np.unique(y):
                part = np.hstack((np.ones((int((y == k).sum()), 1)), x[y == k]))
                sums[int(k)] = sums.get(int(k), 0) + part.T @ part
        for k, m in sums.items():
            yield pa.record_batch([pa.array(np.full(m.size, k, np.int32)), pa.array(np.arange(m.size, dtype=np.int32)), pa.array(m.ravel())], names=["label", "at", "v"])

    out: dict[int, np.ndarray] = {}
    for r in rows.mapInArrow(partial, "label int, at int, v double").groupBy("label", "at").agg(F.sum("v").alias("v")).collect():  # a fixed number of sums
        out.setdefault(r["label"], np.zeros((d + 1) ** 2))[r["at"]] = r["v"]
    square = {k: m.reshape(d + 1, d + 1) for k, m in out.items()}
    return {k: (m[0, 0], m[0, 1:], m[1:, 1:]) for k, m in square.items()}


class Discriminant:
    """Shrunken class densities over standardised statistics."""

    def __init__(self, found: dict[int, tuple[float, np.ndarray, np.ndarray]], pooled: float = POOLED, ridge: float = RIDGE):
        d = len(STATISTICS)
        n = {k: found[k][0] if k in found else 0.0 for k in (0, 1)}
        self.prior = (n[1] + 1) / (n[0] + n[1] + 2)
        self.classes = None
        if min(n.values()) < 2:
            return
        total = sum(n.values())
        mean = sum(found[k][1] for k in n) / total
        spread = sum(found[k][2] for k in n) / total - np.outer(mean, mean)
        self.mean, self.scale = mean, np.sqrt(np.maximum(np.diag(spread), 1e-9))
        means = {k: (found[k][1] / n[k] - mean) / self.scale for k in n}
        own = {k: (found[k][2] / n[k] - np.outer(found[k][1], found[k][1]) / n[k] ** 2) / np.outer(self.scale, self.scale) for k in n}
        both = sum(own[k] * n[k] for k in n) / total
        self.classes = {}
        for k in n:
            shrunk = (1 - pooled) * own[k] + pooled * both
            shrunk = (1 - ridge) * shrunk + ridge * np.eye(d) * max(np.trace(shrunk) / d, 1e-6)
            factor = np.linalg.cholesky(shrunk)
            self.classes[k] = (means[k], np.linalg.inv(factor), np.log(np.diag(factor)).sum())

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.classes is None:
            return np.full(len(x), self.prior)
        z = (x - self.mean) / self.scale
        density = {k: -0.5 * (((z - m) @ inv.T) ** 2).sum(1) - logdet for k, (m, inv, logdet) in self.classes.items()}
        odds = np.log(self.prior / (1 - self.prior)) + density[1] - density[0]
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def held_out(id_col: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(found: DataFrame, labels: DataFrame, label_col: str = "quality", label_id: str = "doc_id") -> Discriminant:
    """found: (doc_id, x); learns from the rows of labels that aren't held out."""
    known = labels.select(F.col(label_id).alias("k"), F.col(label_col).cast("int").alias("label")).where("k is not null and label in (0, 1)").where(~held_out(F.col("k")))
    return Discriminant(moments(known.join(found, F.col("k") == F.col("doc_id")).select("label", "x")))


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", **names) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs."""
    found = written(features(docs, id_col, text_col))
    model = fit(found, labels, **names)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy().reshape(-1, len(STATISTICS))
            yield pa.record_batch([b.column(0), pa.array(model.score(x))], names=["doc_id", "score"])

    scored = found.mapInArrow(judge, f"doc_id {dict(found.dtypes)['doc_id']}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """docs' rows, all columns, that the classifier predicts 1 for. The texts are looked at again rather than shuffled."""
    model = fit(features(docs, text_col=text_col), labels)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.schema.get_field_index(text_col)).cast(pa.binary())
            x = np.array([statistics(t.as_py()) for t in texts]).reshape(-1, len(STATISTICS))
            yield b.filter(pa.array(model.score(x) >= threshold))

    return docs.mapInArrow(judge, docs.schema)
