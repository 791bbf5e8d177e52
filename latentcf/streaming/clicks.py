"""Click logs that keep arriving as CSV files.

The model is a batch fit; what streams is its input and its use:

* ``read_ratings_stream``: the ratings reader as a file stream (same schema, header per file);
* ``dedup_pairs``: distinct (u, s) within an event-time watermark (bounded state),
  ready to be appended to the pair table the next fit reads;
* ``score_stream``: each arriving click scored against a fitted model
  (stream-static joins with the size-checked parameter tables).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latentcf.functions.numeric import dot
from latentcf.model import LatentClassModel
from latentcf.operators.em import broadcast_limit, maybe_broadcast
from latentcf.session import scratch_path
from latentcf.sources.ratings import RATINGS_SCHEMA, typed


def read_ratings_stream(spark: SparkSession, path: str, item_type: str = "long",
                        max_files_per_trigger: int | None = None) -> DataFrame:
    """(u, s, ts) from CSV files landing in ``path``."""
    r = (spark.readStream.schema(RATINGS_SCHEMA).option("header", True)
         .option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True))
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    df = typed(r.csv(path), item_type)
    return df.select(F.col("userId").alias("u"), F.col("movieId").alias("s"),
                     F.timestamp_seconds("timestamp").alias("ts")).where(F.col("u").isNotNull() & F.col("s").isNotNull())


def dedup_pairs(clicks: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Distinct (u, s) within the watermark: state is bounded by event time."""
    return clicks.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["u", "s"])


def append_pairs(pairs_stream: DataFrame, path: str, checkpoint: str | None = None, available_now: bool = True):
    """Append arriving pairs to a parquet table; the checkpoint lives in the shared folder."""
    spark = pairs_stream.sparkSession
    ck = checkpoint or scratch_path(spark, "stream-pairs-ckpt")
    w = pairs_stream.select("u", "s").writeStream.format("parquet").option("path", path) \
        .option("checkpointLocation", ck).outputMode("append")
    if available_now:
        w = w.trigger(availableNow=True)
    return w.start()


def score_stream(model: LatentClassModel, clicks: DataFrame, threshold: float | None = None,
                 inclusive: bool = True) -> DataFrame:
    """(u, s, ts, score[, pred]) for arriving clicks whose u and s the model knows."""
    spark = clicks.sparkSession
    limit = broadcast_limit(spark)
    U = maybe_broadcast(model.users, model.n_users, model.k, limit, model.user_key_bytes)
    S = maybe_broadcast(model.items, model.n_items, model.k, limit, model.item_key_bytes)
    out = clicks.join(U, "u").join(S, "s").select("u", "s", "ts", dot("pu", "ps", model.k).alias("score"))
    if threshold is not None:
        c = F.col("score") >= F.lit(threshold) if inclusive else F.col("score") > F.lit(threshold)
        out = out.withColumn("pred", c)
    return out
