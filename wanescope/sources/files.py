"""Readers and writers of leaderboard tables and evaluation results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wanescope.schema import SCORES, detect_columns

#: How dates come: plain days, ISO times, and times with hyphens in place of colons.
DATE_FORMATS = ("yyyy-MM-dd", "yyyy-MM-dd'T'HH-mm-ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]", "yyyy-MM-dd HH:mm:ss")


def lenient_timestamp(c: Column) -> Column:
    """A timestamp by the first format that fits, else null."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in DATE_FORMATS])


def read_scores_csv(spark: SparkSession, path: str, benchmark: str | None = None, date_col: str | None = None, score_col: str | None = None) -> DataFrame:
    """A long score table; column names are probed; rows with a date or score that can't be read are dropped."""
    raw = spark.read.option("header", True).csv(path)  # all strings: no pass to infer types
    date, score = detect_columns(raw, date_col, score_col)
    model = F.col("model") if "model" in raw.columns else F.lit(None).cast("string")
    name = F.lit(benchmark) if benchmark else F.col("benchmark") if "benchmark" in raw.columns else F.regexp_extract(F.input_file_name(), r"([^/]+?)(_[a-z0-9]+)?\.csv$", 1)
    out = raw.select(name.alias("benchmark"), model.alias("model"), F.col(score).try_cast("double").alias("score"), lenient_timestamp(F.col(date)).alias("eval_date"))
    return out.dropna(subset=["score", "eval_date"])


def read_wide_scores_csv(spark: SparkSession, path: str, benchmarks: list[str]) -> DataFrame:
    """One row per model with a column for each benchmark, as a long table."""
    raw = spark.read.option("header", True).csv(path).select("model", "eval_date", *[F.col(b).try_cast("double").alias(b) for b in benchmarks])
    long = raw.unpivot(["model", "eval_date"], benchmarks, "benchmark", "score").dropna(subset=["score"])
    return long.select("benchmark", "model", "score", lenient_timestamp(F.col("eval_date")).alias("eval_date")).dropna(subset=["eval_date"])


def read_responses_json(spark: SparkSession, path: str, benchmark: str) -> DataFrame:
    """(benchmark, model, item, version, correct) from one object {model: {version: [1, 0 or null, ...]}}; places are items."""
    text = spark.read.text(path, wholetext=True)
    parsed = text.select(F.from_json("value", "map<string,map<string,array<int>>>").alias("m"))
    by_model = parsed.select(F.explode("m").alias("model", "versions"))
    by_version = by_model.select("model", F.explode("versions").alias("version", "answers"))
    return by_version.select(F.lit(benchmark).alias("benchmark"), "model", F.posexplode("answers").alias("item", "correct"), "version").select("benchmark", "model", F.col("item").cast("bigint").alias("item"), "version", "correct")


def read_composite_responses_json(spark: SparkSession, path: str, benchmarks: list[str]) -> DataFrame:
    """As `read_responses_json` where keys are model_benchmark."""
    rows = read_responses_json(spark, path, "")
    name = F.regexp_extract("model", f"_({'|'.join(benchmarks)})$", 1)
    split = rows.withColumn("benchmark", name).where("benchmark <> ''")
    return split.withColumn("model", F.expr("substring(model, 1, length(model) - length(benchmark) - 1)")).select("benchmark", "model", "item", "version", "correct")


def read_epochs_csv(spark: SparkSession, pattern: str, benchmark: str, items: int) -> DataFrame:
    """(benchmark, epoch, model, item, correct) from one matrix file for each epoch, named by its stem; rows are models, columns items."""
    columns = ", ".join(f"`{i}` int" for i in range(items))
    raw = spark.read.schema(columns).option("header", True).csv(pattern).withColumn("epoch", F.regexp_extract(F.input_file_name(), r"([^/]+)\.csv$", 1)).withColumn("order", F.monotonically_increasing_id())
    numbered = raw.withColumn("model", F.row_number().over(Window.partitionBy("epoch").orderBy("order")) - 1).drop("order")
    long = numbered.unpivot(["epoch", "model"], [str(i) for i in range(items)], "item", "correct")
    return long.select(F.lit(benchmark).alias("benchmark"), "epoch", F.col("model").cast("string").alias("model"), F.col("item").cast("bigint").alias("item"), "correct")


def read_history_csv(spark: SparkSession, path: str, benchmark: str) -> DataFrame:
    raw = spark.read.schema("model string, score double, release_date string, source string").option("header", True).csv(path)
    return raw.select(F.lit(benchmark).alias("benchmark"), "model", "score", F.to_date("release_date").alias("release_date"), "source").dropna(subset=["score", "release_date"])


def merge_sources(parts: dict[str, DataFrame], order: tuple[str, ...] = ("scores", "pwc", "epoch")) -> DataFrame:
    """Several sources of one table as one: a model's rows come from the first source of `order` that has it, its earliest row."""
    out = None
    for rank, name in enumerate(order):
        if name in parts:
            part = parts[name].withColumn("source_rank", F.lit(rank))
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    keys = ["benchmark", "model"]
    first = out.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy("source_rank", "eval_date", "score"))).where("_rn = 1")
    return first.drop("_rn")


def empty_scores(spark: SparkSession) -> DataFrame:
    """A template with the schema and no rows."""
    return spark.createDataFrame([], SCORES)


def write_table(df: DataFrame, path: str, kind: str = "parquet", partition_by: list[str] | None = None, mode: str = "errorifexists") -> None:
    """JSON lines, CSV with header, or Parquet; CSV and JSON keep nulls as empty and absent."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    {"json": writer.json, "csv": writer.option("header", True).csv, "parquet": writer.parquet}[kind](path)


def append_responses(df: DataFrame, path: str) -> None:
    """A checkpoint of finished work: appended by benchmark and model, so a later run can leave these out (`contamination.unfinished`)."""
    df.write.mode("append").partitionBy("benchmark", "model").parquet(path)
