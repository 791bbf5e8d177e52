"""Rows every operator has to cope with."""

from pyspark.sql import types as T

#: extra columns, some named like those the operators use
EXTRA = ("row", "_row_a", "_text", "fp", "score", "hash", "bucket", "component_id", "worker")


def documents(spark, texts, extra=False, ids=None):
    """documents of the given texts (doc_id from 1 on, or ``ids``)."""
    fields = [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
              T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    fields += [T.StructField(c, T.StringType()) for c in EXTRA] if extra else []
    ids = list(ids) if ids is not None else list(range(1, len(texts) + 1))
    rows = [(i, t, None, "src", None if t is None else len(t), *(["x"] * len(EXTRA) if extra else []))
            for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, T.StructType(fields))


LONG = " ".join(f"word{i % 997} of{i % 13}" for i in range(60_000))
ODD = [None, "", " ", "\n\n", "a", "same text twice over here now", "same text twice over here now", LONG, "x" * 50_000,
       "tab\tand\x0bodd\x00 white   space", "日本語 テキスト 😀 é", "<|endoftext|> mark"]
ODD_IDS = [1, 2, 3, 4, 5, 6, 6, 8, 9, None, 11, 12]


def odd_documents(spark):
    return documents(spark, ODD, extra=True, ids=ODD_IDS)


def empty_documents(spark):
    return documents(spark, [], extra=True)


def written(spark, folder, **tables):
    """Parquet tables under a folder, as the queries read them."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)
