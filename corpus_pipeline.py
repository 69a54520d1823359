"""A training corpus in stages: each is a Spark job whose rows are written as Parquet and read again by the next one.

run(spark, sf_dir) applies STAGES to sf_dir's documents. SQL can't express the classifier, so ORACLE_SQL is None; tests/llm/test_pipeline.py
holds the near-duplicate stage and run() (less the classifier) against brute-force versions. A document is told by doc_id and text
together. A stage's input is a stored table (the documents or the last stage's written rows): write a stage's result before the next one
is called, which first deletes the tables that the last one has left.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wanescope.llm import decontaminate, line_dedup, packing, quality_model, shingles
from wanescope.llm.common import batches_of, opened, released, released_but, table, unused, without, written
from wanescope.llm.queries import tokenizer_path

#: SimHash stage: words in a shingle, the Jaccard similarity (a fraction) from which shingle sets link, and the differing bits of 64 up to
#: which fingerprints are looked at first. The radius costs or spares time only: the sets decide.
SHINGLE_WORDS, SIMILARITY, RADIUS = 5, (4, 5), 3
#: Texts or shingle sets that a task of that stage sends to Python at once.
BATCH_ROWS = 1000
#: Lines of fewer words (headings, list marks, closing brackets) belong to their documents, however often they occur.
LINE_WORDS = 5

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Tables that the last stage's result is read from.
_LEFT: list[str] = []


def tidy(stage: Stage) -> Stage:
    """The stage, deleting first what the last one has left in the shared folder: its result is written by then, or read by docs."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        released_but(docs, _LEFT)
        before = set(opened())
        out = stage(spark, docs, sf_dir)
        _LEFT[:] = [x for x in opened() if x not in before]
        return out

    return run_stage


@tidy
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts label 1 for."""
    return quality_model.keep_good(docs, table(spark, sf_dir, "labels"))


@tidy
def near_duplicate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines of LINE_WORDS different words or more that an earlier line matches. A document that lost lines and has no word
    left goes: others hold all of it."""
    found = line_dedup.dedup_lines(docs, min_tokens=LINE_WORDS).where((F.col("n_removed") == 0) | F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    text = {"n_chars": F.when(F.col("n_removed") > 0, F.length("text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars"))} if "n_chars" in docs.columns else {}
    return found.withColumns(text).select(docs.columns)


@tidy
def near_duplicate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id (nulls last) of each group that SIMILARITY of shingle sets links. A document is a doc_id with
    a text: rows of one doc_id but different texts are judged apart, rows equal in both collapse to one."""
    with batches_of(spark, BATCH_ROWS):
        rows = written(shingles.prefix_table(docs, SHINGLE_WORDS, SIMILARITY))
        roots = shingles.components(docs, rows, SHINGLE_WORDS, RADIUS, SIMILARITY)
    named = written(rows.join(roots, rows.cls == roots.node, "left").select("doc_id", "thash", F.coalesce("root", "cls").alias("root")))
    released(rows, roots)
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("thash").alias("text"))
    first = named.groupBy("root").agg(F.min(order).alias("first"))
    gone = named.join(first, "root").where(~(F.col("doc_id").eqNullSafe(F.col("first.id")) & (F.col("thash") == F.col("first.text"))))
    out = without(docs, gone.select("doc_id", "thash"), {"doc_id": docs["doc_id"], "thash": F.xxhash64(docs["text"])})
    if named.groupBy("doc_id", "thash").count().where("count > 1").isEmpty():
        return out
    text = unused(docs, "thash")
    return out.withColumn(text, F.xxhash64("text")).dropDuplicates(["doc_id", text]).drop(text)


@tidy
def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words is in benchmark passages of the contract's length."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    return without(docs, found.where(decontaminate.is_contaminated()).select("doc_id", "thash"), {"doc_id": docs["doc_id"], "thash": F.xxhash64(docs["text"])})


@tidy
def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of the documents with its place in a sequence."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", near_duplicate_lines),
    ("SimHash near-dedup", near_duplicate_documents),
    ("benchmark decontamination", benchmark_decontamination),
    ("best-fit packing", best_fit_packing),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
