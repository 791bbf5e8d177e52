"""Sinks: scores, traces, run metadata, the wide k-sweep CSV (';')."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_scores(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Persist scored pairs (parquet by default, CSV with a header on request)."""
    w = df.write.mode(mode)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def write_csv(df: DataFrame, path: str, sep: str = ",", mode: str = "overwrite") -> None:
    """Comma (or ``sep``) separated text with a header and no index column."""
    df.write.mode(mode).option("header", True).option("sep", sep).csv(path)


def write_trace(trace: DataFrame, path: str, mode: str = "overwrite") -> None:
    write_csv(trace.orderBy("iteration"), path, mode=mode)


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    """(iteration, loglik, seconds) as :func:`write_trace` wrote it."""
    return spark.read.schema("iteration int, loglik double, seconds double").option("header", True).csv(path)


def write_run_metadata(spark: SparkSession, path: str, *, total_seconds: float, iterations: int,
                       logliks: list, seconds: list, extra: dict | None = None) -> None:
    """Append one JSON record per run: runtime, passes, trace, timings."""
    rec = {
        "written_at": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()),
        "total_seconds": float(total_seconds),
        "iterations": int(iterations),
        "logliks": [None if v is None else float(v) for v in logliks],
        "iteration_seconds": [float(s) for s in seconds],
    }
    rec.update(extra or {})
    spark.createDataFrame([(json.dumps(rec),)], "value string").coalesce(1).write.mode("append").text(path)


def read_run_metadata(spark: SparkSession, path: str, extra: str = "") -> DataFrame:
    """One row per recorded run; ``extra`` names the further fields, e.g. ``k int``."""
    kind = ("written_at timestamp, total_seconds double, iterations int, logliks array<double>, "
            "iteration_seconds array<double>" + (f", {extra}" if extra else ""))
    return spark.read.schema(kind).option("mode", "FAILFAST").json(path)


def read_sweep_csv(spark: SparkSession, path: str) -> DataFrame:
    """Wide ';' table ``Iteration;2_cluster;3_cluster;...`` -> long (k, iteration, loglik)."""
    wide = spark.read.option("header", True).option("sep", ";").option("inferSchema", False).csv(path)
    kcols = [c for c in wide.columns if c.endswith("_cluster")]
    stack = ", ".join(f"{int(c.split('_')[0])}, cast(`{c}` as double)" for c in kcols)
    return wide.selectExpr(
        "cast(Iteration as int) as iteration", f"stack({len(kcols)}, {stack}) as (k, loglik)"
    ).select(F.col("k").cast("int").alias("k"), "iteration", "loglik")


def write_sweep_csv(long_df: DataFrame, path: str) -> None:
    """long (k, iteration, loglik) -> wide ';' CSV with one column per k."""
    from latentcf.operators.selection import k_sweep_wide

    wide = k_sweep_wide(long_df).orderBy("iteration").withColumnRenamed("iteration", "Iteration")
    write_csv(wide.coalesce(1), path, sep=";")


LONG_SWEEP_SCHEMA = T.StructType(
    [T.StructField("k", T.IntegerType()), T.StructField("iteration", T.IntegerType()),
     T.StructField("loglik", T.DoubleType())]
)
