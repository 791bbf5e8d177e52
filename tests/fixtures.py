"""Small hand-made inputs from FIXTURES.md (FX3-FX6) as DataFrames."""

from pyspark.sql import functions as F

from latentcf.functions.hashing import keyed_unit_half_open
from latentcf.model import LatentClassModel
from latentcf.operators.em import TRACE_SCHEMA


def pairs_df(spark, rows):
    return spark.createDataFrame(rows, "u long, s long")


def planted_blocks(spark, seed=7):
    """FX3: 60 users x 60 items, 3 diagonal 20x20 blocks; in-block kept under 0.6, off-block under 0.03."""
    grid = spark.range(60).select(F.col("id").alias("u"),
                                  F.explode(F.sequence(F.lit(1000).cast("long"), F.lit(1059).cast("long"))).alias("s"))
    x = keyed_unit_half_open(F.col("u"), F.col("s"), F.lit(seed))
    same = (F.floor(F.col("u") / 20) == F.floor((F.col("s") - 1000) / 20))
    return grid.where(F.when(same, x < 0.6).otherwise(x < 0.03)).select("u", "s")


def fx6_model(spark):
    """FX6 scores as a model: p(z|u) = the user's score row, p(s|z) = one-hot per item."""
    users = spark.createDataFrame([(1, 0.9, 0.5, 0.2), (2, 0.6, 0.4, 0.1)], "u long, pu0 double, pu1 double, pu2 double")
    items = spark.createDataFrame([(10, 1.0, 0.0, 0.0), (20, 0.0, 1.0, 0.0), (30, 0.0, 0.0, 1.0)],
                                  "s long, ps0 double, ps1 double, ps2 double")
    trace = spark.createDataFrame([], TRACE_SCHEMA)
    return LatentClassModel(k=3, users=users, items=items, trace=trace, passes=0, n_users=2, n_items=3)
