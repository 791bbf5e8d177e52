"""Ratings / click logs as CSV with a header (MovieLens layout).

A rating line is ``userId,movieId,rating,timestamp``; only the first two
fields matter (a click is a 1-rating). The schema is given up front, so the
scan never infers types and Catalyst prunes the two unused columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RATINGS_SCHEMA = T.StructType([T.StructField(c, T.StringType(), True) for c in ("userId", "movieId", "rating", "timestamp")])


def _whole_number(column: str):
    """The id as a long; text that is none fails the read, since dropping its row would lose clicks."""
    given = F.col(column)
    number = given.try_cast("long")
    return F.when(given.isNotNull() & (given != "") & number.isNull(), F.raise_error(F.concat(
        F.lit(f"{column} '"), given, F.lit("' is no whole number: read with user_type / item_type 'string'")))
    ).otherwise(number).alias(column)


def read_ratings(spark: SparkSession, path: str | list[str], item_type: str = "long", sep: str = ",",
                 user_type: str = "long") -> DataFrame:
    """Read one file, a directory or a list of files; every file has a header line.

    Ids are numbers, and anything else in such a column is an error, never a dropped row; with type
    'string' they are kept as trimmed text. Blank padding around fields is ignored; only an empty id
    is null. A log with the two id columns alone is valid (the rest are null).
    """
    df = (
        spark.read.schema(RATINGS_SCHEMA)
        .option("header", True)
        .option("sep", sep)
        .option("ignoreLeadingWhiteSpace", True)
        .option("ignoreTrailingWhiteSpace", True)
        .option("mode", "PERMISSIVE")
        .csv(path)
    )
    return typed(df, item_type, user_type)


def typed(df: DataFrame, item_type: str = "long", user_type: str = "long", checked: bool = False) -> DataFrame:
    """Rows of RATINGS_SCHEMA with the ids' types (``checked``: known to be valid)."""
    def id_(column, kind):
        if checked and kind == "long":
            return F.col(column).try_cast("long").alias(column)
        return _whole_number(column) if kind == "long" else F.nullif(F.trim(column), F.lit("")).alias(column)

    return df.select(id_("userId", user_type), id_("movieId", item_type), F.col("rating").try_cast("double").alias("rating"),
                     F.col("timestamp").try_cast("long").alias("timestamp"))


@dataclass
class RatingsRead:
    """A read in which no line is lost: every line with any text is a click or a reject."""

    clicks: DataFrame  # RATINGS_SCHEMA with the ids' types, both ids set
    rejects: DataFrame  # file, line, reason

    def counts(self) -> dict[str, int]:
        """Lines by reason, '' for the accepted ones."""
        found = {r["reason"]: r["count"] for r in self.rejects.groupBy("reason").count().collect()}  # one row a reason
        return {"": self.clicks.count(), **found}


def read_ratings_checked(spark: SparkSession, path: str | list[str], item_type: str = "long", sep: str = ",",
                         user_type: str = "long") -> RatingsRead:
    """:func:`read_ratings` with a reject channel beside the typed rows.

    A line without two fields, with an empty id, or with an id that is no whole number (where one is
    asked for) is set aside with its file and the reason; the run goes on. ``line`` is the text as it
    stands where the number of fields is off, else its fields joined again (without padding). Lines
    without any text are no lines. Both sides read the files lazily and by themselves.
    """
    raw = T.StructType([*RATINGS_SCHEMA.fields, T.StructField("_line", T.StringType(), True)])
    df = (
        spark.read.schema(raw)
        .option("header", True)
        .option("sep", sep)
        .option("ignoreLeadingWhiteSpace", True)
        .option("ignoreTrailingWhiteSpace", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_line")
        .option("columnPruning", False)  # a line is judged by all its fields, whatever is asked for
        .csv(path)
    )
    fields = [F.coalesce(F.col(c), F.lit("")) for c in RATINGS_SCHEMA.names]
    df = df.select("*", F.col("_metadata.file_path").alias("_file"),
                   F.coalesce("_line", F.concat_ws(sep, *fields)).alias("_text"))
    reason = (F.when(F.col("_line").isNotNull() & ~F.contains(F.col("_line"), F.lit(sep)), "one field")
              .when(_empty("userId"), "empty user").when(_empty("movieId"), "empty item"))
    for column, kind, name in (("userId", user_type, "user"), ("movieId", item_type, "item")):
        if kind == "long":
            reason = reason.when(F.col(column).try_cast("long").isNull(), f"{name} is no whole number")
    df = df.withColumn("_reason", reason)
    # the tests of this very column come first in the plan: the typed side never sees a rejected line
    clicks = typed(df.where(F.col("_reason").isNull()).select(*RATINGS_SCHEMA.names), item_type, user_type, checked=True)
    rejects = df.where(F.col("_reason").isNotNull()).select(F.col("_file").alias("file"), F.col("_text").alias("line"),
                                                            F.col("_reason").alias("reason"))
    return RatingsRead(clicks, rejects)


def _empty(column: str):
    return F.col(column).isNull() | (F.trim(column) == "")


def interactions(df: DataFrame, user_col: str = "userId", item_col: str = "movieId", weighted: bool = False) -> DataFrame:
    """Distinct (u, s) clicks; with ``weighted`` also w = number of raw lines.

    Duplicated lines would otherwise inflate the evidence sums; one partial
    aggregation before the shuffle collapses copies map-side.
    """
    base = df.select(F.col(user_col).alias("u"), F.col(item_col).alias("s")).where(
        F.col("u").isNotNull() & F.col("s").isNotNull()
    )
    if weighted:
        return base.groupBy("u", "s").agg(F.count(F.lit(1)).alias("w"))
    return base.distinct()
