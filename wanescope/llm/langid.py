"""Language identification with word-first backoff.

A known word scores by its log frequency in each language. An unseen word falls back to its character n-grams (word ends marked): at
each place the longest n-gram that is known scores, and shorter ones are tried only where it isn't. Words are runs of letters with their
combining marks. The model is learned from a bounded sample of labelled rows, the same share of rows and bytes for every language: about
FIT_ROWS rows and FIT_BYTES bytes in all by a hash of id and text, all rows of a language that has fewer than its share, and of any language
the row of the least hash. Equal texts of a language count once there. Known are the words that a language has LEAST_SEEN times or more in
that sample; the rest lend nothing but what their n-grams share with known ones. Of languages that score alike the first by name wins.

Only doc_id, text and lang of the table are looked at, whatever its other columns are called.
Nulls: a null text, or one without a letter, is `und` with score 0; rows with null language or id aren't learned from. Languages whose
value is empty are values like any other. With nothing to learn from, every row is `und`. Repeated rows come back as often as they came.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wanescope.llm.quality_model import held_out

FIT_ROWS, FIT_BYTES, LEAST_SEEN, MOST_GRAM = 20_000, 256 << 20, 3, 4
#: Unseen words whose scores a Python worker keeps at most.
CACHE_WORDS = 300_000
ROWS_AT_ONCE = 64
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def grams_of(word: str, n: int) -> list[str]:
    w = f"^{word}$"
    return [w[i : i + n] for i in range(len(w) - n + 1)]


class Model:
    def __init__(self, counts: list[tuple[str, str, int]], most_gram: int = MOST_GRAM):
        """counts: (lang, word, n)."""
        self.langs, self.most = sorted({c[0] for c in counts}), most_gram
        at = {lang: i for i, lang in enumerate(self.langs)}
        self.words = {w: i for i, w in enumerate(sorted({c[1] for c in counts}))}
        seen = np.zeros((len(self.words), len(self.langs)))
        grams: dict[str, np.ndarray] = {}
        for lang, w, n in counts:
            seen[self.words[w], at[lang]] += n
        for w, i in self.words.items():
            for k in range(1, most_gram + 1):
                for g in grams_of(w, k):
                    if g in grams:
                        grams[g] += np.sqrt(seen[i])
                    else:
                        grams[g] = np.sqrt(seen[i])
        self.score = self._log(seen)
        by_length: dict[int, list[str]] = {}
        for g in grams:
            by_length.setdefault(len(g), []).append(g)
        self.grams = {}
        for names in by_length.values():
            logs = self._log(np.array([grams[g] for g in names]))
            self.grams |= {g: logs[i] for i, g in enumerate(names)}
        self.gram_at = {g: i for i, g in enumerate(self.grams)}
        self.gram_rows = np.array(list(self.grams.values())).reshape(len(self.grams), len(self.langs))
        self.known, self.grams = len(self.words), None
        self.rows = self.score

    @staticmethod
    def _log(counts: np.ndarray) -> np.ndarray:
        return np.log((counts + 0.5) / (counts.sum(0) + 0.5 * len(counts))).astype(np.float64) if len(counts) else counts

    def backoff(self, word: str) -> list[int]:
        """Rows of the n-grams that score an unseen word: at each place the longest known one that ends there."""
        w, out = f"^{word}$", []
        for i in range(1, len(w)):
            for k in range(min(self.most, i + 1), 0, -1):
                at = self.gram_at.get(w[i + 1 - k : i + 1])
                if at is not None:
                    out.append(at)
                    break
        return out

    def learn(self, words: list[str]) -> None:
        """Adds rows for unseen words: the mean over their places, less its own mean over languages."""
        mean = np.zeros((len(words), len(self.langs)))
        for i, w in enumerate(words):  # each word's rows alone, so that its score doesn't hang on what it came with
            at = self.backoff(w)
            if at:
                mean[i] = self.gram_rows[at].sum(0) / len(at)
        self.words.update(zip(words, range(len(self.words), len(self.words) + len(words))))
        self.rows = np.vstack((self.rows, mean - mean.mean(1, keepdims=True)))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        split = [words_of(t) for t in texts]
        n = np.fromiter(map(len, split), np.int64, len(split))
        if not self.langs:
            return ["und"] * len(texts), [0.0] * len(texts)
        if len(self.words) - self.known > CACHE_WORDS:
            self.words = {w: i for w, i in self.words.items() if i < self.known}
            self.rows = self.rows[: self.known]
        missing = set().union(*split).difference(self.words) if split else set()
        if missing:
            self.learn(list(missing))
        names, chances = [], []
        for words in split:
            if not words:
                names.append("und"), chances.append(0.0)
                continue
            total = self.rows[np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))].sum(0)
            chance = np.exp(total - total.max())
            best = int(total.argmax())
            names.append(self.langs[best]), chances.append(float(chance[best] / chance.sum()))
        return names, chances


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES, least_seen: int = LEAST_SEEN, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("id is not null and lang is not null and text is not null").where(~held_out(F.col("id")))
    known = known.withColumns({"at": F.pmod(F.xxhash64("id", "text"), F.lit(1 << 52)) / float(1 << 52), "size": F.octet_length("text") + F.lit(1)})
    sizes = known.groupBy("lang").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"), F.min("at").alias("least")).withColumnRenamed("lang", "of")
    share = F.least(F.lit(fit_rows) / F.col("langs") / F.col("rows"), F.lit(fit_bytes) / F.col("langs") / F.col("bytes"))
    bounds = sizes.crossJoin(sizes.agg(F.count("*").alias("langs"))).select("of", F.greatest(share, F.col("least")).alias("share"))
    sample = known.join(bounds, known["lang"] == bounds["of"]).where("at <= share").select("text", "lang").distinct()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: Counter = Counter()
            for t, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                seen.update((lang, w) for w in words_of(t))
            yield pa.record_batch([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["lang", "word", "n"])

    counts = sample.select("text", "lang").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    return Model([(r["lang"], r["word"], r["n"]) for r in counts.where(F.col("n") >= least_seen).collect()])  # words of fit_rows texts


def identify(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model or fit(docs, id_col=id_col, text_col=text_col, **how))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, chances = [], []
            for i in range(0, b.num_rows, ROWS_AT_ONCE):
                one, two = sent.value.predict(b.column(1)[i : i + ROWS_AT_ONCE].to_pylist())
                names += one
                chances += two
            yield pa.record_batch([b.column(0), pa.array(names, pa.string()), pa.array(chances, pa.float64())], names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(scan, f"doc_id {dict(rows.dtypes)['doc_id']}, lang_pred string, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
