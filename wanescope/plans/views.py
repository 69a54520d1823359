"""The driver's tables as canonical frames, in Spark and as the SQL text that oracles start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: model, ord, t_year, vendor, cutoff: a fixed small dimension for the seven models of `responses`.
MODELS = [("m0", 0, 2023.0, "gpt", "2022-09"), ("m1", 1, 2023.5, "gpt", "2023-04"), ("m2", 2, 2024.0, "gpt", "2023-10"), ("m3", 3, 2024.25, "gpt", "2023-12"), ("m4", 4, 2024.5, "claude", "2024-04"), ("m5", 5, 2024.75, "claude", "2024-07"), ("m6", 6, 2025.25, "claude", "2025-01")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as evaluations: five benchmarks by priority, customers as models."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("benchmark"), F.concat(F.lit("m"), F.col("o_custkey").cast("string")).alias("model"), (F.col("o_totalprice") / 500000).alias("score"), F.col("o_orderdate").alias("eval_date"))


SCORES = "scores AS (SELECT o_orderpriority AS benchmark, 'm' || CAST(o_custkey AS VARCHAR) AS model, o_totalprice / 500000 AS score, o_orderdate AS eval_date, CAST(year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS INTEGER) AS q FROM orders WHERE o_totalprice IS NOT NULL AND o_orderdate IS NOT NULL)"


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as graded answers: supplier classes as models, parts as items, line status as version."""
    cells = table(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("m"), (F.col("l_suppkey") % 7).cast("string")).alias("model"), F.col("l_partkey").alias("item"), F.when(F.col("l_linestatus") == "O", "orig").otherwise("pert").alias("version")).agg(F.max(F.when(F.col("l_returnflag") != "R", 1).otherwise(0)).alias("correct"))
    return cells.select(F.lit("lines").alias("benchmark"), "model", "item", "version", "correct")


RESPONSES = "responses AS (SELECT 'lines' AS benchmark, 'm' || CAST(l_suppkey % 7 AS VARCHAR) AS model, l_partkey AS item, CASE WHEN l_linestatus = 'O' THEN 'orig' ELSE 'pert' END AS version, max(CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END) AS correct FROM lineitem GROUP BY 1, 2, 3, 4)"
WIDE = RESPONSES + ", wide AS (SELECT benchmark, model, item, max(CASE WHEN version = 'orig' THEN correct END) AS o, max(CASE WHEN version = 'pert' THEN correct END) AS p FROM responses GROUP BY 1, 2, 3), paired AS (SELECT *, o - p AS d FROM wide WHERE o IS NOT NULL AND p IS NOT NULL)"
GAPS = RESPONSES + ", gaps AS (SELECT *, orig - pert AS gap FROM (SELECT benchmark, model, avg(CASE WHEN version = 'orig' THEN correct END) AS orig, avg(CASE WHEN version = 'pert' THEN correct END) AS pert FROM responses GROUP BY 1, 2) WHERE orig IS NOT NULL AND pert IS NOT NULL)"


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses with five benchmarks: the part key's class is the benchmark."""
    return responses(spark, sf_dir).withColumn("benchmark", F.concat(F.lit("b"), (F.col("item") % 5).cast("string")))


PANEL = RESPONSES + ", panel AS (SELECT 'b' || CAST(item % 5 AS VARCHAR) AS benchmark, model, item, version, correct FROM responses)"


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best order of each month as a state of the art, on a scale to 100."""
    month = F.to_date(F.date_trunc("month", "o_orderdate"))
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("benchmark"), month.alias("release_date")).agg((F.max("o_totalprice") / 5000).alias("score"))


HISTORY = "history AS (SELECT o_orderpriority AS benchmark, CAST(date_trunc('month', o_orderdate) AS DATE) AS release_date, max(o_totalprice) / 5000 AS score FROM orders GROUP BY 1, 2)"


def model_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MODELS, "model string, ord int, t_year double, vendor string, cutoff string")


DIM = "dim AS (SELECT * FROM (VALUES " + ", ".join(f"('{m}', {o}, CAST({t} AS DOUBLE), '{v}', '{c}')" for m, o, t, v, c in MODELS) + ") AS x(model, ord, t_year, vendor, cutoff))"


def item_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), F.col("p_type").alias("subject"), F.col("p_brand").alias("brand"))


ITEMS = "items AS (SELECT p_partkey AS item, p_type AS subject, p_brand AS brand FROM part)"


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Worked answers with marked operations and a final number, from line items."""
    q, n = F.col("l_quantity").cast("bigint"), F.col("l_partkey")
    s = lambda c: c.cast("string")
    text = F.concat(F.lit("He pays <<"), s(q), F.lit("+"), s(n), F.lit("="), s(q + n), F.lit(">> and <<"), s(q), F.lit("*2="), s(q * 2), F.lit(">> #### "), s(q + n))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", q.alias("q"), n.alias("n"), text.alias("answer"))


ANSWERS = "answers AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS q, l_partkey AS n, 'He pays <<' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || '+' || CAST(l_partkey AS VARCHAR) || '=' || CAST(CAST(l_quantity AS BIGINT) + l_partkey AS VARCHAR) || '>> and <<' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || '*2=' || CAST(CAST(l_quantity AS BIGINT) * 2 AS VARCHAR) || '>> #### ' || CAST(CAST(l_quantity AS BIGINT) + l_partkey AS VARCHAR) AS answer FROM lineitem)"


def item_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item parameters over epochs, from line items by ship quarter: b falls with the share of kept lines, a with quantity's spread."""
    from wanescope.operators.power import quarter_index

    rows = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 50).alias("item"), quarter_index(F.col("l_shipdate")).alias("q"), F.when(F.col("l_returnflag") != "R", 1).otherwise(0).alias("c"), "l_quantity")
    return rows.groupBy("item", "q").agg((0.5 + F.avg("l_quantity") / 50).alias("a"), (1 - 2 * F.avg("c")).alias("b")).select(F.lit("lines").alias("benchmark"), "item", "q", F.col("q").cast("double").alias("t"), "a", "b")


PARAMS = "params AS (SELECT 'lines' AS benchmark, l_partkey % 50 AS item, CAST(year(l_shipdate) * 4 + quarter(l_shipdate) - 1 AS INTEGER) AS q, CAST(year(l_shipdate) * 4 + quarter(l_shipdate) - 1 AS DOUBLE) AS t, CAST(0.5 AS DOUBLE) + avg(l_quantity) / 50 AS a, 1 - 2 * avg(CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END) AS b FROM lineitem GROUP BY 1, 2, 3, 4)"


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, without negative zero."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def rounded(digits: int = 6, **columns: str) -> str:
    """The same in SQL."""
    return ", ".join(f"round({v}, {digits}) + 0.0 AS {k}" for k, v in columns.items())
