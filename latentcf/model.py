"""The fitted latent class model: two small parameter tables and a trace."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass
class LatentClassModel:
    """p(s|u) = sum_z p(z|u) p(s|z).

    users : DataFrame[u, pu0 .. pu{k-1}]   p(z|u), each row sums to 1
    items : DataFrame[s, ps0 .. ps{k-1}]   p(s|z), each column sums to 1
    trace : DataFrame[iteration int, loglik double, seconds double]
            mean log-likelihood of the training pairs under the parameters
            produced by that pass; the last row describes this model.
    """

    k: int
    users: DataFrame
    items: DataFrame
    trace: DataFrame
    passes: int
    n_users: int = 0
    n_items: int = 0
    logliks: list = field(default_factory=list)
    seconds: list = field(default_factory=list)
    # measured total width of the keys, for the size checks of joins
    user_key_bytes: int = 0
    item_key_bytes: int = 0
    state_path: str | None = None
    # the state by block and its numbers of user and item blocks, if it was fitted by strips
    blocks: tuple | None = None

    def release(self) -> None:
        """Remove the written state behind ``users`` and ``items`` (save the model first to keep it)."""
        from latentcf.session import remove_path

        remove_path(self.users.sparkSession, self.state_path)
        self.state_path = self.blocks = None

    @property
    def neg_loglik(self) -> float | None:
        return -self.logliks[-1] if self.logliks else None

    def save(self, path: str, mode: str = "overwrite") -> None:
        """Write p(z|u), p(s|z), the trace and the scalars under ``path``."""
        spark = self.users.sparkSession
        base = path.rstrip("/")
        self.users.write.mode(mode).parquet(f"{base}/p_z_given_u")
        self.items.write.mode(mode).parquet(f"{base}/p_s_given_z")
        if self.trace is not None:
            self.trace.write.mode(mode).parquet(f"{base}/trace")
        meta = {"k": self.k, "passes": self.passes, "n_users": self.n_users, "n_items": self.n_items,
                "logliks": self.logliks, "user_key_bytes": self.user_key_bytes, "item_key_bytes": self.item_key_bytes}
        spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode(mode).text(
            f"{base}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "LatentClassModel":
        base = path.rstrip("/")
        meta = json.loads(spark.read.text(f"{base}/meta").first()["value"])
        try:
            trace = spark.read.parquet(f"{base}/trace")
        except Exception:  # noqa: BLE001 - a model saved without a trace
            trace = None
        return cls(k=int(meta["k"]), users=spark.read.parquet(f"{base}/p_z_given_u"),
                   items=spark.read.parquet(f"{base}/p_s_given_z"), trace=trace, passes=int(meta["passes"]),
                   n_users=int(meta["n_users"]), n_items=int(meta["n_items"]), logliks=list(meta["logliks"]),
                   user_key_bytes=int(meta.get("user_key_bytes", 0)), item_key_bytes=int(meta.get("item_key_bytes", 0)))


class JointModels(dict):
    """Models fitted side by side, by k; the tables behind them have the columns of all
    (pu<j>_<z>, ps<j>_<z> for the j-th k), so that work over all of them reads each row once."""

    def __init__(self, models: dict[int, LatentClassModel], users: DataFrame, items: DataFrame, state_paths: list[str] | None = None):
        super().__init__(models)
        self.users, self.items, self.state_paths = users, items, state_paths or []
        # as of a single model, if all have the same state by block
        self.blocks: tuple | None = None
        one = next(iter(models.values()))
        self.n_users, self.n_items = one.n_users, one.n_items
        self.user_key_bytes, self.item_key_bytes = one.user_key_bytes, one.item_key_bytes

    @property
    def ks(self) -> list[int]:
        return list(self)

    def columns(self, side: str) -> list[list[str]]:
        return [[f"{side}{j}_{z}" for z in range(k)] for j, k in enumerate(self)]

    def release(self) -> None:
        """Remove the written states behind all models."""
        from latentcf.session import remove_path

        for path in set(self.state_paths):
            remove_path(self.users.sparkSession, path)
        self.state_paths, self.blocks = [], None
