"""Choosing the number of classes: the log-likelihood trace for several k."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latentcf.operators import em


def k_sweep(pairs: DataFrame, ks: list[int], passes: int, seed: int = 42, tol: float | None = None,
            run_dir: str | None = None) -> DataFrame:
    """Long (k, iteration, loglik, seconds): EM for every k in one set of passes over one written pair
    table; with ``tol`` each k stops on its own, with ``run_dir`` a restarted sweep resumes."""
    models = em.fit_many(pairs, list(ks), max_iter=passes, seed=seed, tol=tol, run_dir=run_dir)
    out = None
    for k in ks:
        t = models[int(k)].trace.select(F.lit(int(k)).cast("int").alias("k"), "iteration", "loglik", "seconds")
        out = t if out is None else out.unionByName(t)
    models.release()  # the traces are all that is asked for
    return out


def k_sweep_wide(long_df: DataFrame) -> DataFrame:
    """(iteration, <k>_cluster ...) — the wide layout of the sweep table."""
    wide = long_df.groupBy("iteration").pivot("k").agg(F.first("loglik"))
    return wide.select("iteration", *[F.col(c).alias(f"{c}_cluster") for c in wide.columns if c != "iteration"])
