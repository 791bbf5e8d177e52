"""Connected components of an edge table, by alternating star operations.

Every round is two group minima and two joins on written tables, so the plans
stay short, lost executors re-read files, and AQE can split the rows of a hub
(both sides of each join are plain exchanges of files). No neighbour list is
ever gathered: a star keeps only minima.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latentcf.llm.common import release, settle

MAX_ROUNDS = 60


def _minima(edges: DataFrame, key: str, value: str) -> DataFrame:
    return settle(edges.groupBy(F.col(key).alias("node")).agg(F.min(value).alias("least")), "cc-least")


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long), root the least node reachable.

    Empty edges give an empty result; loops and repeated edges are harmless.
    """
    one_way = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    now = settle(one_way, "cc-edges")
    state = _digest(now)
    for _ in range(MAX_ROUNDS):
        if state[0] == 0:
            break
        # large star: larger neighbours of b move to the least node around b
        both = now.union(now.select("b", "a"))
        least = _minima(both.select(F.col("a").alias("n"), F.least("a", "b").alias("m")), "n", "m")
        moved = settle(now.join(least, now.b == least.node).select("a", F.col("least").alias("b")), "cc-moved")
        # small star: smaller neighbours of a, and a itself, move to the least of them
        under = _minima(moved, "a", "b")
        joined = moved.join(under, moved.a == under.node)
        step = (joined.select(F.col("b").alias("a"), F.col("least").alias("b"))
                .union(under.select(F.col("node").alias("a"), F.col("least").alias("b"))).where("a <> b").distinct())
        after = settle(step, "cc-edges")
        for t in (now, least, moved, under):
            release(t)
        now, last, state = after, state, _digest(after)
        if state == last:
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    # a star forest: every a has one b, its root
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
