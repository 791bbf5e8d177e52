"""Pair builders over the driver's parquet tables (the test/bench inputs)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the token pattern for the documents-by-words domain (letters of any script).
WORD_PATTERN = r"\p{L}+"


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def purchase_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw (u, s) purchase lines: orders ⋈ lineitem on the order key.

    Only the two key columns of each table are read (pruned at the scan)."""
    o = load_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    li = load_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    return (
        o.join(li, o.o_orderkey == li.l_orderkey)
        .select(F.col("o_custkey").alias("u"), F.col("l_partkey").alias("s"))
        .where(F.col("u").isNotNull() & F.col("s").isNotNull())
    )


def purchase_pairs(spark: SparkSession, sf_dir: str, weighted: bool = False) -> DataFrame:
    """Distinct customer-part pairs; ``weighted`` adds w = raw line count."""
    rows = purchase_rows(spark, sf_dir)
    if weighted:
        return rows.groupBy("u", "s").agg(F.count(F.lit(1)).alias("w"))
    return rows.distinct()


def word_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by words: distinct (doc_id, word) over whole texts (string items)."""
    d = load_table(spark, sf_dir, "documents").select("doc_id", "text")
    words = d.select(
        F.col("doc_id").alias("u"),
        F.explode(F.regexp_extract_all(F.lower(F.col("text")), F.lit(WORD_PATTERN), 0)).alias("s"),
    )
    return words.where(F.col("u").isNotNull() & (F.length("s") > 0)).distinct()


def event_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users by event type: a dense edge case (few items, many users)."""
    e = load_table(spark, sf_dir, "events").select("user_id", "event_type")
    return (
        e.select(F.col("user_id").alias("u"), F.col("event_type").alias("s"))
        .where(F.col("u").isNotNull() & F.col("s").isNotNull())
        .distinct()
    )


def profile(rows: DataFrame) -> DataFrame:
    """One row: raw lines, distinct pairs, distinct users, distinct items.

    Copies are collapsed first (one partial+final aggregation on (u, s)), so
    the two distinct counts run over the pair table, not the raw log."""
    per_pair = rows.groupBy("u", "s").agg(F.count(F.lit(1)).alias("c"))
    return per_pair.agg(
        F.sum("c").cast("bigint").alias("n_rows"),
        F.count(F.lit(1)).alias("n_pairs"),
        F.countDistinct("u").alias("n_users"),
        F.countDistinct("s").alias("n_items"),
    )


def preview(df: DataFrame, n: int = 10, order_by: list[str] | None = None) -> DataFrame:
    """The first n rows, in a defined order when ``order_by`` is given (row order is otherwise undefined)."""
    return (df.orderBy(*order_by) if order_by else df).limit(n)
