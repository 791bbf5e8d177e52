"""Train/test split with no cold-start rows in test.

The split coordinate is a keyed hash of (u, s, seed), so a pair lands on the
same side whatever the partitioning, the cluster size or a task retry
(``randomSplit`` depends on partition layout). Test rows are then kept only
if both the user and the item occur in train (two left-semi joins; AQE
broadcasts the distinct vocabularies when they are small at runtime and
splits a hot key otherwise).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latentcf.functions.hashing import keyed_unit_half_open


def split_coordinate(seed: int):
    return keyed_unit_half_open(F.col("u"), F.col("s"), F.lit(seed))


def raw_split(pairs: DataFrame, alpha: float = 0.1, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    x = split_coordinate(seed)
    return pairs.where(x >= F.lit(alpha)), pairs.where(x < F.lit(alpha))


def restrict_to_vocabulary(test: DataFrame, train: DataFrame) -> DataFrame:
    """Keep test rows whose u and s both occur in train (semi joins)."""
    return test.join(train.select("u").distinct(), "u", "left_semi").join(
        train.select("s").distinct(), "s", "left_semi"
    ).select(*test.columns)


def hash_split(pairs: DataFrame, alpha: float = 0.1, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, test): one call returns both halves; train is untouched."""
    train, test = raw_split(pairs, alpha, seed)
    return train, restrict_to_vocabulary(test, train)


def random_split(pairs: DataFrame, alpha: float = 0.1, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """``randomSplit`` variant (layout-dependent draws), same vocabulary rule."""
    train, test = pairs.randomSplit([1.0 - alpha, alpha], seed=seed)
    return train, restrict_to_vocabulary(test, train)


def common_users(train: DataFrame, test: DataFrame) -> DataFrame:
    return test.select("u").intersect(train.select("u"))


def common_items(train: DataFrame, test: DataFrame) -> DataFrame:
    return test.select("s").intersect(train.select("s"))
