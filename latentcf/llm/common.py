"""Shared helpers of the subpackage: tables, scratch tables, row identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from latentcf.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text, with null read as empty."""
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once, also where ``body`` uses it inside
    lambdas (a plain column may be put in place there and worked out per element)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    Cuts the lineage (a lost executor re-reads files instead of recomputing the
    chain) and gives later joins the true size of the table. The schema is
    passed on, so an empty table comes back with its columns.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Remove a table that ``settle`` wrote (its only reader is done)."""
    spark = df.sparkSession
    jvm = spark._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def keyed_rows(df: DataFrame) -> DataFrame:
    """``row`` (all columns of ``df`` as a struct, so that no name of theirs can clash) and
    _row_a, _row_b: a 128-bit identity of the whole row. Equal rows have equal keys, whatever
    their doc_id; rows that share a doc_id keep apart; nulls count as values."""
    cols = [F.col(f"`{c}`") for c in df.columns]
    nulls = F.concat(*[F.isnull(c).cast("string") for c in cols])
    return df.select(F.struct(*cols).alias("row"), F.xxhash64(nulls, *cols).alias("_row_a"),
                     F.xxhash64(F.lit("second"), nulls, *cols).alias("_row_b"))
