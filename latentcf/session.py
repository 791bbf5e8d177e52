"""Session helpers: a local session for tests/bench and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "latentcf") -> SparkSession:
    """Local session with AQE on and the UI off (tests, bench, examples)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder used to cut lineage (model state per EM pass).

    Reads ``spark.checkpoint.dir`` (the cluster's shared folder) or the
    context's checkpoint dir. Only when neither is set *and* the master is
    local does it create a private temp folder (tests, laptops); on a cluster
    an unset folder is an error, never a machine-local path.
    """
    sc = spark.sparkContext
    root = sc.getCheckpointDir()
    if not root:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/S3/...) on a cluster")
            root = tempfile.mkdtemp(prefix="latentcf-ckpt-")
        sc.setCheckpointDir(root)
        root = sc.getCheckpointDir() or root
    return root


class Scratch:
    """The tables written in the shared folder since a scope was opened."""

    def __init__(self, spark: SparkSession, outer: "Scratch | None" = None):
        self.spark, self.outer, self.paths, self.tables = spark, outer, [], []

    def note(self, path: str) -> None:
        self.paths.append(path)

    def release(self) -> None:
        """Remove them: results that read them are done with."""
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        for path in self.paths:
            remove_path(self.spark, path)
        self.paths, self.tables = [], []

    def keep(self) -> None:
        """Hand them to the scope around this one (or to nobody)."""
        if self.outer is not None:
            self.outer.paths += self.paths
            self.outer.tables += self.tables
        self.paths, self.tables = [], []


_SCOPE: ContextVar[Scratch | None] = ContextVar("latentcf_scratch", default=None)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[Scratch]:
    """Everything written to the scratch folder inside the block is removed at its end.

    Results are lazy and read what was written, so consume (write, collect) them inside, or call
    ``keep`` on the scope. Models to be used later belong in ``LatentClassModel.save``."""
    outer = _SCOPE.get()
    scope = Scratch(spark, outer)
    token = _SCOPE.set(scope)
    try:
        yield scope
    finally:
        _SCOPE.reset(token)
        scope.release()


def note_table(name: str) -> None:
    """A table in the catalog that belongs to the open scope."""
    if _SCOPE.get() is not None:
        _SCOPE.get().tables.append(name)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the checkpoint root for a written table."""
    root = checkpoint_root(spark).rstrip("/")
    path = f"{root}/{name}-{uuid.uuid4().hex[:12]}"
    if _SCOPE.get() is not None:
        _SCOPE.get().note(path)
    return path


def remove_path(spark: SparkSession, path: str | None) -> None:
    """Remove a scratch table whose readers are done."""
    if path:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
