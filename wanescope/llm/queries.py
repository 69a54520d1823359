"""The training-data queries that __spark_entry__ registers, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wanescope.llm import chat, decontaminate, langid, line_dedup, merkle, oracles, packing, quality_model, quality_rules, secrets_scan, sharding, simhash, url_filter, vector_codes
from wanescope.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), decontaminate.is_contaminated().alias("contaminated"))


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.cascade(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", "text")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op7_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets_scan.scan(table(spark, sf_dir, "documents"))
    of_kind = lambda k: F.size(F.filter("spans", lambda x: x["kind_name"] == k)).cast("long").alias(f"n_{k}")
    base = secrets_scan.digest(F.filter("spans", lambda x: x["kind"] < len(secrets_scan.BASE)))
    return found.select("doc_id", *[of_kind(k) for k in secrets_scan.KINDS[:3]], F.sha2(base, 256).alias("base_sha256"), secrets_scan.digest(F.col("spans")).alias("spans"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.assign(table(spark, sf_dir, "documents"), 16)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, field = F.col("text"), {c: F.col(c) for c in merkle.FIELDS}
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    tampered = merkle.digest(list((field | {"text": F.when(even, F.translate(text, "\n", "")).otherwise(text)}).values()))
    found = merkle.manifest(table(spark, sf_dir, "documents"), {"tampered": tampered})
    found = found.withColumn("folded_root", merkle.folded(F.col("tampered"), F.col("path")))
    return found.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    return vector_codes.label_errors(coded).select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(vector_codes.digest(books)).alias("codebooks_sha256"))


QUERIES: dict[str, Query] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_pack": op2_pack,
    "op3_quality_rules": op3_quality_rules,
    "op4_line_dedup": op4_line_dedup,
    "op5_language_id": op5_language_id,
    "op6_simhash": op6_simhash,
    "op7_quality_model": op7_quality_model,
    "op8_chat_rotation": op8_chat_rotation,
    "op9_url_filter": op9_url_filter,
    "op10_secrets": op10_secrets,
    "op11_sharding": op11_sharding,
    "op12_merkle": op12_merkle,
    "op13_vector_codes": op13_vector_codes,
}
ORACLES: dict[str, str] = {
    "op1_decontaminate": oracles.DECONTAMINATE,
    "op3_quality_rules": oracles.QUALITY_RULES,
    "op4_line_dedup": oracles.LINE_DEDUP,
    "op8_chat_rotation": oracles.CHAT,
    "op9_url_filter": oracles.URL_FILTER,
    "op10_secrets": oracles.SECRETS,
    "op11_sharding": oracles.SHARDING,
    "op12_merkle": oracles.MERKLE,
    "op13_vector_codes": oracles.VECTOR_CODES,
}
