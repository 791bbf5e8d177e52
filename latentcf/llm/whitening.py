"""Embedding whitening (operator 11) by blockwise QR and a bidiagonal qd solver.

1. Entries become whole numbers, x = floor(256 c); the fit list holds every
   distinct vector once, so its sums are exact.
2. Each task folds its rows, centred by the exact mean, into one triangular
   factor, batch by batch; groups of ``FAN_IN`` factors are folded again until
   one is left (width x width, whatever the number of rows).
3. :mod:`latentcf.llm.bidiagonal` gives its singular values and the right
   vectors of the largest: e = sigma^2 / n are the covariance's eigenvalues,
   the vectors its eigenvectors. The covariance itself is never formed.
4. A last pass projects all rows; the whitened covariance is summed over the
   fit list as a check.

Defined cases: rows whose vector is null, or holds null or non-finite entries,
are dropped, as are vectors of another length than the most frequent (of equally
frequent lengths the greater), which lie in no common space with the rest.
Repeated rows and ids each give their rows. A direction without variance
(fewer distinct vectors than components) has whitened null and explained 0
(null where there is no variance at all). An empty table, or one of empty
vectors, gives an empty result. Entries beyond the range of long are held at
its ends. ``deviation`` is a decimal, null beyond 38 digits. Other columns
travel as one struct and cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latentcf.llm.bidiagonal import top_right_vectors
from latentcf.llm.common import release, settle, table

SCALE, COMPONENTS = 256, 4
FAN_IN = 32
SAFE = 1 << 62


def entries(vector: Column, scale: int = SCALE) -> Column:
    """array<long>: floor(scale * entry)."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("long"))


def clean(rows: DataFrame, column: str) -> DataFrame:
    """``row`` (all columns as a struct) and ``x``, for the rows that remain."""
    picked = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), F.col(f"`{column}`").alias("_v"))
    finite = F.forall("_v", lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    return picked.where(F.col("_v").isNotNull() & finite).select("row", entries(F.col("_v")).alias("x"))


def _matrix(column, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _shifted(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: whole 64-bit numbers where they are proven to fit, Python's otherwise."""
    most = int(max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))) * n + max(map(abs, sums), default=0)
    if most < SAFE:
        return x * np.int64(n) - np.array(sums, dtype=np.int64)
    return x.astype(object) * n - np.array(sums, dtype=object)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return (_shifted(x, n, sums) / n).astype(np.float64)


def _square_sums(y: np.ndarray) -> list[int]:
    most = int(max(abs(int(y.max(initial=0))), abs(int(y.min(initial=0)))))
    if y.dtype != object and most * most * y.shape[1] < SAFE:
        return (y * y).sum(axis=1).tolist()
    y = y.astype(object)
    return (y * y).sum(axis=1).tolist() if y.shape[1] else [0] * len(y)


def _decimals(numbers: list[int]):
    import decimal

    import pyarrow as pa

    kind = pa.decimal128(38, 0)
    if all(abs(v) < SAFE for v in numbers):
        return pa.array(numbers, pa.int64()).cast(kind)
    with decimal.localcontext() as exact:
        exact.prec = 100
        return pa.array([decimal.Decimal(v) if abs(v) < 10**38 else None for v in numbers], kind)


def column_sums(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """Rows and exact sums per dimension: one row of partial sums a task, added up by Spark."""

    def task(batches) -> Iterator:
        import pyarrow as pa

        n, sums = 0, [0] * width
        for b in batches:
            x = _matrix(b.column(0), width)
            most = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) * max(1, len(x))
            part = x.sum(axis=0) if most < SAFE else x.astype(object).sum(axis=0)
            n, sums = n + len(x), [a + int(c) for a, c in zip(sums, part)] if len(x) else sums
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, width), pa.int32()), _decimals([n, *sums])], names=["at", "value"])

    total = fit.mapInArrow(task, "at int, value decimal(38,0)").groupBy("at").agg(F.sum("value").alias("value"))
    got = {r.at: int(r.value) for r in total.collect()}  # width + 1 rows
    return got.get(-1, 0), [got.get(i, 0) for i in range(width)]


def _fold(upper: np.ndarray | None, block: np.ndarray) -> np.ndarray:
    return np.linalg.qr(block if upper is None else np.vstack([upper, block]), mode="r")


def triangle(fit: DataFrame, width: int, n: int, sums: list[int]) -> np.ndarray:
    """R of the centred fit list's QR factorisation, by a tree of folds."""
    kind = "at long, r array<double>"

    def one(at: int, upper: np.ndarray | None):
        import pyarrow as pa

        rows = [] if upper is None else [upper.ravel()]
        return pa.RecordBatch.from_arrays([pa.array([at] * len(rows), pa.int64()), pa.array(rows, pa.list_(pa.float64()))],
                                          names=["at", "r"])

    def leaves(batches) -> Iterator:
        from pyspark import TaskContext

        upper = None
        for b in batches:
            if b.num_rows:
                upper = _fold(upper, _centred(_matrix(b.column(0), width), n, sums))
        yield one(TaskContext.get().partitionId(), upper)

    def node(frame):
        import pandas as pd

        upper = None
        for at in frame.sort_values("at").r:
            upper = _fold(upper, np.asarray(at).reshape(-1, width))
        return pd.DataFrame({"at": [int(frame["at"].iloc[0]) // FAN_IN], "r": [upper.ravel()]})

    level = settle(fit.mapInArrow(leaves, kind), "whiten-r")
    while level.count() > 1:
        # neighbours by task number, at most FAN_IN of them in a group
        above = settle(level.groupBy(F.floor(F.col("at") / FAN_IN)).applyInPandas(node, kind), "whiten-r")
        release(level)
        level = above
    found = level.first()
    release(level)
    upper = np.zeros((width, width))
    if found:
        r = np.asarray(found.r).reshape(-1, width)
        upper[: len(r)] = r
    return upper


@dataclass
class Whitening:
    n: int
    sums: list[int]
    components: np.ndarray  # one a row
    values: np.ndarray  # eigenvalues of the components
    trace: float
    identity_error: float | None = None

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates, one column a component (NaN where a component has no variance)."""
        scale = np.where(self.values > 0, np.sqrt(np.where(self.values > 0, self.values, 1.0)), np.nan)
        return (_centred(x, self.n, self.sums) @ self.components.T) / scale


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct ``x`` of ``vectors`` (see :func:`clean`); None where there is nothing to fit."""
    widths = vectors.groupBy(F.size("x").alias("width")).count()
    most = widths.orderBy(F.desc("count"), F.desc("width")).first()
    if most is None or most.width == 0:
        return None
    width = most.width
    listed = settle(vectors.where(F.size("x") == width).select("x").distinct(), "whiten-fit")
    n, sums = column_sums(listed, width)
    squared, found = top_right_vectors(triangle(listed, width, n, sums), components)
    values = np.array([squared[i] / n if found[i].any() else 0.0 for i in range(len(found))])
    model = Whitening(n, sums, found, values, float(squared.sum() / n))
    model.identity_error = _identity_error(listed, model)
    release(listed)
    return model


def _identity_error(listed: DataFrame, model: Whitening) -> float | None:
    """Largest absolute entry of the whitened fit list's covariance minus the identity."""
    kept = int((model.values > 0).sum())
    width = len(model.sums)
    if not kept:
        return None

    def task(batches) -> Iterator:
        import pyarrow as pa

        total = np.zeros((kept + 1, kept))
        for b in batches:
            w = model.project(_matrix(b.column(0), width))[:, :kept]
            total[:kept] += w.T @ w
            total[kept] += w.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], names=["at", "value"])

    sums = listed.mapInArrow(task, "at int, value double").groupBy("at").agg(F.sum("value").alias("value"))
    total = np.zeros((kept + 1) * kept)
    for r in sums.collect():  # (kept + 1) * kept rows
        total[r.at] = r.value / model.n
    total = total.reshape(kept + 1, kept)
    return float(np.abs(total[:kept] - np.outer(total[kept], total[kept]) - np.eye(kept)).max())


def whiten(rows: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``row`` (all columns as a struct), n, deviation (exact sum over dimensions of (n*x - S)^2, decimal), whitened
    (array, one entry a component) and explained (array), for every row that remains, and identity_error."""
    vectors = clean(rows, column)
    kind = f"row {vectors.schema['row'].dataType.simpleString()}, deviation decimal(38,0), whitened array<double>"
    model = fit(vectors, components)
    if model is None:
        none = vectors.where("false").withColumns({"deviation": F.lit(None).cast("decimal(38,0)"),
                                                   "whitened": F.lit(None).cast("array<double>")}).drop("x")
        return none.withColumns({"n": F.lit(0).cast("long"), "explained": F.lit(None).cast("array<double>"),
                                 "identity_error": F.lit(None).cast("double")})
    width = len(model.sums)

    def task(batches) -> Iterator:
        import pyarrow as pa

        for b in batches:
            x = _matrix(b.column(1), width)
            w = model.project(x)
            values = pa.array(w.ravel(), from_pandas=True)  # NaN: null
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * w.shape[1])
            yield pa.RecordBatch.from_arrays([b.column(0), _decimals(_square_sums(_shifted(x, model.n, model.sums))),
                                              pa.ListArray.from_arrays(offsets, values)], names=["row", "deviation", "whitened"])

    explained = [float(v / model.trace) if model.trace > 0 else None for v in model.values]
    done = vectors.where(F.size("x") == width).mapInArrow(task, kind)
    return done.withColumns({"n": F.lit(model.n).cast("long"),
                             "explained": F.array(*[F.lit(v).cast("double") for v in explained]),
                             "identity_error": F.lit(model.identity_error).cast("double")})


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    done = whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    each = done.select("row.vec_id", "n", F.expr("try_cast(deviation AS long)").alias("deviation"), "identity_error",
                       F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c"))
    return each.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation",
                       F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error")
