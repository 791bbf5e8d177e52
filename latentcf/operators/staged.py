"""One EM step in long form, every intermediate a DataFrame (one row per class).

This is the step-by-step view (u, s, z, q) with each quantity visible:
N(s,z), N(z), p(s|z), p~(z|u), P(u), p(z|u), the parameter join, the
evidence and the posterior. It is the readable reference for the wide
engine in :mod:`latentcf.operators.em`, and equal to it to ~1e-12.

Normalisers are window sums (k rows per group, so a hot user or item never
makes a big group here) or a broadcast of the k class totals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latentcf.functions.hashing import keyed_unit_open
from latentcf.functions.numeric import EVIDENCE_FLOOR


def latent_expand(pairs: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """(u, s) -> (u, s, z, q) for z in 0..k-1, q in (0, 1] from a keyed hash."""
    x = pairs.select("u", "s", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("z"))
    return x.select("u", "s", "z", keyed_unit_open(F.col("u"), F.col("s"), F.col("z"), F.lit(seed)).alias("q"))


def item_class_counts(q: DataFrame) -> DataFrame:
    """N(s,z) = sum_u q."""
    return q.groupBy("s", "z").agg(F.sum("q").alias("n_sz"))


def class_totals(n_sz: DataFrame) -> DataFrame:
    """N(z) = sum_s N(s,z) (k rows)."""
    return n_sz.groupBy("z").agg(F.sum("n_sz").alias("n_z"))


def p_item_given_class(n_sz: DataFrame, n_z: DataFrame) -> DataFrame:
    """p(s|z) = N(s,z) / N(z); the k-row totals are broadcast (bounded by k)."""
    return n_sz.join(F.broadcast(n_z), "z").select("s", "z", (F.col("n_sz") / F.col("n_z")).alias("p_sz"))


def user_class_mass(q: DataFrame) -> DataFrame:
    """p~(z|u) = sum_s q."""
    return q.groupBy("u", "z").agg(F.sum("q").alias("mass"))


def user_totals(mass: DataFrame) -> DataFrame:
    """P(u) = sum_z p~(z|u)."""
    return mass.groupBy("u").agg(F.sum("mass").alias("total"))


def p_class_given_user(mass: DataFrame) -> DataFrame:
    """p(z|u) = p~(z|u) / P(u), the total as a window sum over the k rows of u."""
    tot = F.sum("mass").over(Window.partitionBy("u"))
    return mass.select("u", "z", (F.col("mass") / tot).alias("p_zu"))


def param_join(q: DataFrame, p_zu: DataFrame, p_sz: DataFrame) -> DataFrame:
    """(u, s, z) keys of q joined to p(z|u) on (u, z) and p(s|z) on (s, z); old q dropped."""
    return q.select("u", "s", "z").join(p_zu, ["u", "z"]).join(p_sz, ["s", "z"]).select(
        "u", "s", "z", "p_zu", "p_sz"
    )


def evidence(pj: DataFrame) -> DataFrame:
    """p(s|u) = sum_z p(z|u) p(s|z) on the observed pairs."""
    return pj.groupBy("u", "s").agg(
        F.greatest(F.sum(F.col("p_zu") * F.col("p_sz")), F.lit(EVIDENCE_FLOOR)).alias("evidence")
    )


def posterior(pj: DataFrame) -> DataFrame:
    """q*(z; u, s) = p(z|u) p(s|z) / sum_z' (window over the k rows of the pair)."""
    w = F.col("p_zu") * F.col("p_sz")
    ev = F.greatest(F.sum(w).over(Window.partitionBy("u", "s")), F.lit(EVIDENCE_FLOOR))
    return pj.select("u", "s", "z", (w / ev).alias("q"))


def mean_loglik(ev: DataFrame) -> DataFrame:
    """(1/N) sum ln p(s|u) over the pairs (the positive sign), and N."""
    return ev.agg(F.avg(F.log("evidence")).alias("loglik"), F.count(F.lit(1)).alias("n_pairs"))


def negative_loglik(scores: DataFrame, observed: DataFrame) -> DataFrame:
    """-(1/T) sum ln p(s|u) over observed pairs joined to their scores, T = |observed|."""
    # left join: T counts every observed pair, the sum skips pairs without a score
    j = observed.select("u", "s").join(scores.select("u", "s", "score"), ["u", "s"], "left")
    return j.agg((-F.sum(F.log("score")) / F.count(F.lit(1))).alias("neg_loglik"))


def one_step(pairs: DataFrame, k: int, seed: int = 42) -> dict[str, DataFrame]:
    """All intermediates of one M-step on hashed q0 followed by one E-step."""
    q0 = latent_expand(pairs, k, seed)
    n_sz = item_class_counts(q0)
    n_z = class_totals(n_sz)
    p_sz = p_item_given_class(n_sz, n_z)
    mass = user_class_mass(q0)
    tot = user_totals(mass)
    p_zu = p_class_given_user(mass)
    pj = param_join(q0, p_zu, p_sz)
    ev = evidence(pj)
    post = posterior(pj)
    return {
        "q0": q0, "n_sz": n_sz, "n_z": n_z, "p_sz": p_sz, "mass": mass, "totals": tot, "p_zu": p_zu,
        "param_join": pj, "evidence": ev, "posterior": post, "loglik": mean_loglik(ev),
    }
