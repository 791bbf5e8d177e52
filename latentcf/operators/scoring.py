"""Scoring: p(s|u) on given pairs (joins) and over all user x item pairs (tiles).

Given pairs (train, test, observed) are scored with two equi-joins and an
unrolled dot product, all JVM-side.

All-pairs work (the reference scores every user against every item) is
|U| x |S| by definition. It is never a cross join and never materialised as
rows: users and items are dealt into blocks, every pair of blocks meets as one
tile in an executor (keyed cogroup; a block is copied once per tile of its row
or column, which is little beside the tile's work), and each tile is reduced at
once: positive counts per threshold, top-n, or rank sums for the AUC. Neither
table passes through the driver. Blocks are sized from measured bytes and
counts, so a task holds one bounded tile whatever the model's size. Inside a
tile numpy uses the left-to-right multiply-add order of the SQL dot product, so
values agree bit for bit.

Several models fitted side by side (:class:`latentcf.model.JointModels`) share
the tiles: their columns lie in the same rows, and every model is scored while
the block is in memory. With a threshold, items and tiles that cannot reach it
are left out before the shuffle (:func:`_reachable`).

Models fitted by strips have their state by block: tiles, given pairs and best
items then read the blocks they need, and no parameter is in a plan or moves.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from typing import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latentcf.functions.numeric import row_sum
from latentcf.model import JointModels, LatentClassModel
from latentcf.operators.em import broadcast_limit, maybe_broadcast, param_bytes
from latentcf.operators.strips import block_of

# Cells (users x items) scored per numpy block inside a task: bounds task memory.
BLOCK_CELLS = 4_000_000
# Cells (users x items) of a tile whose reduction may return every cell, of one that only counts, and
# bytes of either block of a tile.
TILE_CELLS = 64_000_000
COUNT_CELLS = 16_000_000_000
LEAST_CELLS = 1_000_000
TILE_BYTES = 64 * 1024 * 1024
# Partitions of the tiles' shuffle; beyond it a task works through several tiles, one at a time.
MOST_PARTITIONS = 50_000


# ---------------------------------------------------------------- join path


@dataclass
class Params:
    """The tables of one model, or of several side by side, with their class columns by model."""

    users: DataFrame
    items: DataFrame
    pu: list[list[str]]
    ps: list[list[str]]
    n_users: int
    n_items: int
    user_key_bytes: int = 0
    item_key_bytes: int = 0

    @property
    def width(self) -> int:
        return sum(map(len, self.pu))

    @property
    def spans(self) -> list[slice]:
        """The columns of each model among all of them."""
        ends = np.cumsum([0, *map(len, self.pu)]).tolist()
        return [slice(a, b) for a, b in zip(ends, ends[1:])]


def params_of(model: LatentClassModel | JointModels) -> Params:
    if isinstance(model, JointModels):
        pu, ps = model.columns("pu"), model.columns("ps")
    else:
        pu, ps = [[f"{side}{z}" for z in range(model.k)] for side in ("pu", "ps")]
        pu, ps = [pu], [ps]
    return Params(model.users, model.items, pu, ps, model.n_users, model.n_items, model.user_key_bytes, model.item_key_bytes)


def _flat(names: list[list[str]]) -> list[str]:
    return [c for cs in names for c in cs]


def score_pairs(model: LatentClassModel | JointModels, pairs: DataFrame, broadcast_bytes: int | None = None) -> DataFrame:
    """(u, s, score) for the given pairs whose u and s are in the model; score<j> of each of several models."""
    spark, p = pairs.sparkSession, params_of(model)
    limit = broadcast_bytes if broadcast_bytes is not None else broadcast_limit(spark)
    if model.blocks is not None and max(
            param_bytes(p.n_users, p.width, p.user_key_bytes), param_bytes(p.n_items, p.width, p.item_key_bytes)) > limit:
        return _score_by_blocks(model, pairs)
    U = maybe_broadcast(p.users, p.n_users, p.width, limit, p.user_key_bytes)
    S = maybe_broadcast(p.items, p.n_items, p.width, limit, p.item_key_bytes)
    j = pairs.select("u", "s").join(U, "u").join(S, "s")
    names = _score_names(model)
    return j.select("u", "s", *[row_sum([F.col(a) * F.col(b) for a, b in zip(us, ss)]).alias(n) for us, ss, n in zip(p.pu, p.ps, names)])


def _score_names(model: LatentClassModel | JointModels) -> list[str]:
    return ["score"] if isinstance(model, LatentClassModel) else [f"score{i}" for i in range(len(model))]


def _score_by_blocks(model: LatentClassModel | JointModels, pairs: DataFrame) -> DataFrame:
    """(u, s, score) with the parameters read by block: the pairs move as they are, no parameters with
    them. Distinct pairs of a block of users and one of items are few, whoever is hot."""
    state, n_users, n_items = model.blocks
    utype, stype = model.users.schema["u"].dataType, model.items.schema["s"].dataType
    names, spans = _score_names(model), params_of(model).spans
    schema = T.StructType([T.StructField("u", utype), T.StructField("s", stype), *[T.StructField(n, T.DoubleType()) for n in names]])

    def run(some: pd.DataFrame) -> pd.DataFrame:
        at = []
        for key, column in (("u", "own"), ("s", "block")):
            keys, values = state.read(key, [some[column].iloc[0]])
            at.append((keys.get_indexer(some[key]), values))
        (i, a), (j, b) = at
        known = (i >= 0) & (j >= 0)
        i, j = i[known], j[known]
        return pd.DataFrame({"u": some["u"][known], "s": some["s"][known],
                             **{n: _dots(a[i, span], b[j, span]) for n, span in zip(names, spans)}})

    placed = pairs.select(F.col("u").cast(utype).alias("u"), F.col("s").cast(stype).alias("s"))
    placed = placed.where(F.col("u").isNotNull() & F.col("s").isNotNull())
    placed = placed.select(block_of("u", n_users).alias("own"), block_of("s", n_items).alias("block"), "u", "s")
    return placed.groupBy("own", "block").applyInPandas(run, schema)


def predict(scores: DataFrame, threshold: float, inclusive: bool = True) -> DataFrame:
    """Add pred = score >= t (inclusive) or score > t (strict)."""
    c = F.col("score") >= F.lit(threshold) if inclusive else F.col("score") > F.lit(threshold)
    return scores.withColumn("pred", c)


def exclude_seen(scores: DataFrame, seen: DataFrame) -> DataFrame:
    """Drop pairs present in ``seen`` (left anti join on (u, s))."""
    return scores.join(seen.select("u", "s"), ["u", "s"], "left_anti")


# Relative margin on the item bound below: far above the rounding of a k-term dot product.
BOUND_MARGIN = 1e-9
# Type of counts over user x item pairs.
COUNT = "decimal(38,0)"


# ---------------------------------------------------------------- block path


def block_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """users(B x k) x items(S x k) -> B x S, summed left to right over z."""
    acc = np.multiply.outer(a[:, 0], b[:, 0])
    for z in range(1, a.shape[1]):
        acc = acc + np.multiply.outer(a[:, z], b[:, z])
    return acc


def _user_batches(it: Iterator[pd.DataFrame], n_items: int) -> Iterator[pd.DataFrame]:
    step = max(1, BLOCK_CELLS // max(1, n_items))
    for pdf in it:
        for i in range(0, len(pdf), step):
            yield pdf.iloc[i: i + step]


def _tile_shape(p: Params, block_bytes: int | None, cells: int | None = TILE_CELLS) -> tuple[int, int]:
    """(user blocks, item blocks): blocks of at most ``block_bytes``, tiles of at most ``cells`` on average
    (None: as large as the blocks) and a few tiles for each core. Never more blocks than rows.

    A user is copied once per item block and an item once per user block. So where more tiles are
    needed than the blocks make, both sides are cut in proportion to their bytes: copies grow with
    the root of the number of tiles. Without ``cells`` the item blocks stay as few as they can be."""
    limit = max(1, block_bytes if block_bytes is not None else TILE_BYTES)
    n_users, n_items = max(1, p.n_users), max(1, p.n_items)
    cores = max(1, int(p.users.sparkSession.sparkContext.defaultParallelism))
    user_bytes, item_bytes = param_bytes(n_users, p.width, p.user_key_bytes), param_bytes(n_items, p.width, p.item_key_bytes)
    rows, cols = math.ceil(user_bytes / limit), math.ceil(item_bytes / limit)
    few = min(3 * cores, math.ceil(n_users * n_items / LEAST_CELLS))  # a few tiles a core, if there is work for them
    if cells is not None:
        need = max(few, math.ceil(n_users * n_items / cells))
        rows = max(rows, min(math.ceil(math.sqrt(need * user_bytes / item_bytes)), math.ceil(need / cols)))
        cols = max(cols, math.ceil(need / min(rows, n_users)))
        few = need
    cols = min(cols, n_items)
    return min(max(rows, math.ceil(few / cols)), n_users), cols


@dataclass
class _Plan:
    """Which block each user and item belongs to, and which pairs of blocks are built."""

    users: DataFrame  # x, u, class columns
    items: DataFrame  # y, s, class columns
    built: np.ndarray | None  # rows x cols; None: all
    rows: int
    cols: int

    @property
    def n_built(self) -> int:
        return self.rows * self.cols if self.built is None else int(self.built.sum())

    def partners(self, block: str, other: str, axis: int) -> DataFrame | None:
        """(block, other: array) of the blocks with a tile, for the explode."""
        if self.built is None:
            return None
        table = self.built if axis == 0 else self.built.T
        rows = [(i, np.flatnonzero(r).tolist()) for i, r in enumerate(table) if r.any()]
        return self.users.sparkSession.createDataFrame(rows, f"{block} int, {other} array<int>")


def _by_hash(p: Params, rows: int, cols: int) -> _Plan:
    x = F.pmod(F.xxhash64("u"), F.lit(rows)).cast("int").alias("x")
    y = F.pmod(F.xxhash64("s", F.lit("item")), F.lit(cols)).cast("int").alias("y")
    return _Plan(p.users.select(x, "u", *_flat(p.pu)), p.items.select(y, "s", *_flat(p.ps)), None, rows, cols)


def _reachable(p: Params, rows: int, cols: int, threshold: float) -> _Plan:
    """Only what can reach ``threshold`` > 0, known before anything is shuffled.

    An item whose highest p(s|z) cannot reach it with any user is left out. The others, and the
    users, are blocked by their dominant class (and, where there are many blocks, its strength);
    the highest value of every class in a block is a small index (blocks x classes numbers), and
    the tile of two blocks is built only if the product of their maxima reaches the threshold in
    some model. All of it bounds the score from above, with BOUND_MARGIN for rounding."""
    margin = 1.0 + BOUND_MARGIN
    sums = p.users.agg(*[F.max(row_sum([F.col(c) for c in cs])).alias(f"t{j}") for j, cs in enumerate(p.pu)]).first()
    can = F.lit(False)
    for j, cs in enumerate(p.ps):
        can = can | (_greatest(cs) * F.lit(float(sums[f"t{j}"] or 0.0) * margin) >= F.lit(threshold))
    items = p.items.where(can)
    if rows * cols < INDEX_TILES:  # an index would cost more than the tiles it spares
        return _by_hash(replace(p, items=items), rows, cols)
    widest = max(range(len(p.pu)), key=lambda j: len(p.pu[j]))
    users, n_rows, u_max = _blocked(p.users, "u", "x", p.pu, widest, rows)
    items, n_cols, s_max = _blocked(items, "s", "y", p.ps, widest, cols)
    built = np.zeros((n_rows, n_cols), dtype=bool)
    for span in p.spans:
        step = max(1, BLOCK_CELLS // max(1, n_cols))
        for lo in range(0, n_rows, step):
            built[lo : lo + step] |= u_max[lo : lo + step, span] @ s_max[:, span].T * margin >= threshold
    return _Plan(users, items, built, n_rows, n_cols)


def _greatest(cols: list[str]):
    return F.greatest(*cols) if len(cols) > 1 else F.col(cols[0])


# Fewer tiles than this are built without an index.
INDEX_TILES = 64
# Levels of strength a class is cut into where it has several blocks.
LEVELS = 6


def _blocked(df: DataFrame, key: str, block: str, names: list[list[str]], widest: int, blocks: int):
    """(``df`` with its block, number of blocks, highest value of every column by block): groups by
    dominant class of one model and, with several blocks a class, by powers of four of its strength;
    a large group is cut into several blocks by hash."""
    cols = names[widest]
    df = df.withColumn("_top", _greatest(cols))  # a column of its own: used once per class
    top = F.col("_top")
    group = F.coalesce(*[F.when(F.col(c) == top, F.lit(z)) for z, c in enumerate(cols)], F.lit(0))
    if blocks < len(cols):  # neighbouring classes share a block
        group, cols = F.floor(group * blocks / len(cols)), cols[:blocks]
    levels = LEVELS if blocks > 2 * len(cols) else 1
    if levels > 1:
        best = df.agg(F.max(top)).first()[0] or 1.0
        down = F.floor(F.log(F.lit(float(best)) / F.greatest(top, F.lit(1e-300))) / math.log(4.0))
        group = group * levels + F.least(F.greatest(down, F.lit(0)), F.lit(levels - 1))
    df = df.withColumn("_g", group.cast("int"))
    counts = {r["_g"]: r["count"] for r in df.groupBy("_g").count().collect()}  # classes x levels rows
    total, n_groups = sum(counts.values()), len(cols) * levels
    cut = [math.ceil(counts.get(g, 0) * blocks / total) if total else 0 for g in range(n_groups)]
    first = np.concatenate([[0], np.cumsum(cut)]).astype(int).tolist()
    at = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("_g") + 1)
    number = at(first[:-1]) + F.pmod(F.xxhash64(key, F.lit(block)), at([max(1, c) for c in cut]))
    df = df.select(number.cast("int").alias(block), key, *_flat(names))
    most = np.zeros((first[-1], len(_flat(names))))
    for r in df.groupBy(block).agg(*[F.max(c).alias(c) for c in _flat(names)]).collect():  # the index: one row a block
        most[r[block]] = [r[c] for c in _flat(names)]
    return df, first[-1], most


def _tiles(model: LatentClassModel | JointModels, reduce_: Callable, schema: T.StructType, seen: DataFrame | None = None,
           block_bytes: int | None = None, threshold: float | None = None, cells: int | None = TILE_CELLS,
           beside: tuple[DataFrame, int] | None = None) -> DataFrame:
    """``reduce_(users, ids, mat, seen)`` over every tile (with a ``threshold``: every tile that can
    reach it), as rows of ``schema``.

    ``users`` is a pandas block (u, class columns), ``ids`` the sorted item ids of the block and ``mat``
    their p(s|z), ``seen`` the pairs (u, s) among them: each seen pair goes to its one tile. With
    ``beside``, a table (piece, values, times) of lists and its number of pieces, every tile is worked
    through once per piece, and the fourth argument holds the lists of that piece."""
    p = params_of(model)
    shape = _tile_shape(p, block_bytes, cells)
    if model.blocks is not None and seen is None and beside is None:
        return _tiles_by_block(p, model.blocks, shape, reduce_, schema)
    plan = _reachable(p, *shape, threshold) if threshold is not None and threshold > 0 else _by_hash(p, *shape)
    return _run_tiles(p, plan, reduce_, schema, seen, beside)


def _run_tiles(p: Params, plan: _Plan, reduce_: Callable, schema: T.StructType, seen: DataFrame | None = None,
               beside: tuple[DataFrame, int] | None = None) -> DataFrame:
    utype, stype = p.users.schema["u"].dataType, p.items.schema["s"].dataType
    pu, ps, rows, cols = _flat(p.pu), _flat(p.ps), plan.rows, plan.cols

    def spread(df: DataFrame, block: str, other: str, n: int, axis: int) -> DataFrame:
        partners = plan.partners(block, "_others", axis)
        if partners is None:
            return df.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        return df.join(partners, block).withColumn(other, F.explode("_others")).drop("_others")

    left = spread(plan.users, "x", "y", cols, 0).select("x", "y", "u", F.lit(None).cast(stype).alias("s"), *pu)
    if seen is not None:  # only with blocks by hash
        of_user, of_item = F.pmod(F.xxhash64("u"), F.lit(rows)), F.pmod(F.xxhash64("s", F.lit("item")), F.lit(cols))
        left = left.unionByName(seen.select(of_user.cast("int").alias("x"), of_item.cast("int").alias("y"),
                                            F.col("u").cast(utype).alias("u"), F.col("s").cast(stype).alias("s"),
                                            *[F.lit(None).cast("double").alias(c) for c in pu]))
    right = spread(plan.items, "y", "x", rows, 1)
    pieces = beside[1] if beside is not None else 1
    parts = max(1, min(plan.n_built * pieces, MOST_PARTITIONS))
    tile = F.col("x").cast("long") * F.lit(cols) + F.col("y")
    left, right = left.select(tile.alias("tile"), "u", "s", *pu), right.select(tile.alias("tile"), "s", *ps)
    lists = []
    if beside is not None:  # with blocks by hash and nothing seen
        lists, of_piece = ["values", "times"], F.col("tile") * F.lit(pieces) + F.col("piece")
        every = F.explode(F.sequence(F.lit(0), F.lit(pieces - 1)))
        left, right = (df.withColumn("piece", every).withColumn("tile", of_piece).drop("piece") for df in (left, right))
        there = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(rows * cols - 1).cast("long"))).alias("tile")
        left = left.withColumns({c: F.lit(None).cast(beside[0].schema[c].dataType) for c in lists}).unionByName(
            beside[0].select(there, "piece", *lists).withColumn("tile", of_piece).drop("piece"), allowMissingColumns=True)

    def run(own: pd.DataFrame, items: pd.DataFrame) -> pd.DataFrame:
        is_user = (own["values"] if lists else own["s"]).isna().to_numpy()
        users = own[is_user]
        if not len(users) or not len(items):
            return pd.DataFrame({f.name: [] for f in schema.fields})
        items = items.sort_values("s", kind="mergesort")
        found = list(reduce_(users, items["s"].to_numpy(), items[ps].to_numpy(np.float64), own.loc[~is_user, lists or ["u", "s"]]))
        return pd.concat(found, ignore_index=True) if found else pd.DataFrame({f.name: [] for f in schema.fields})

    return (left.repartition(parts, "tile").groupBy("tile")
            .cogroup(right.repartition(parts, "tile").groupBy("tile")).applyInPandas(run, schema))


def _tiles_by_block(p: Params, blocks: tuple, shape: tuple[int, int], reduce_: Callable, schema: T.StructType) -> DataFrame:
    """The tiles of a state by block: a task has the numbers of its tiles and reads their blocks."""
    (state, n_users, n_items), pu = blocks, _flat(p.pu)
    rows, cols = min(shape[0], n_users), min(shape[1], n_items)

    def run(it):
        for pdf in it:
            for tile in pdf["id"]:
                x, y = divmod(int(tile), cols)
                users, a = state.read("u", range(x, n_users, rows))
                items, mat = state.read("s", range(y, n_items, cols))
                if len(users) and len(items):
                    order = np.argsort(items.to_numpy(), kind="stable")
                    own = pd.DataFrame(dict(zip(pu, a.T)))
                    own.insert(0, "u", users.to_numpy())
                    yield from reduce_(own, items.to_numpy()[order], mat[order], None)

    return p.users.sparkSession.range(0, rows * cols, 1, min(rows * cols, MOST_PARTITIONS)).mapInPandas(run, schema)


class _Reach:
    """Items by their highest class probability: score(u, s) <= max_z p(s|z) * sum_z p(z|u), so for
    a threshold t only items whose maximum reaches t / (max_u sum_z p(z|u)) can be positive."""

    def __init__(self, mat: np.ndarray):
        top = mat.max(axis=1)
        self.order = np.argsort(-top, kind="stable")
        self.sorted = top[self.order]

    def candidates(self, a: np.ndarray, t: float) -> np.ndarray:
        if t <= 0:  # every item can qualify
            return self.order
        reach = float(a.sum(axis=1).max()) * (1.0 + BOUND_MARGIN)
        if reach <= 0:
            return self.order[:0]
        return self.order[: int(np.searchsorted(-self.sorted, -(t / reach), side="right"))]


def predicted_pairs(model: LatentClassModel, threshold: float, inclusive: bool = True,
                    seen: DataFrame | None = None, broadcast_bytes: int | None = None) -> DataFrame:
    """(u, s, score) for every pair predicted positive (the rest are negatives).

    Exact without scoring every item (:class:`_Reach`). ``seen`` pairs are removed (anti join).
    The result is as large as the threshold makes it."""
    schema = T.StructType([T.StructField("u", model.users.schema["u"].dataType),
                           T.StructField("s", model.items.schema["s"].dataType), T.StructField("score", T.DoubleType())])
    t, pu = float(threshold), [f"pu{z}" for z in range(model.k)]

    def reduce_(users, ids, mat, _):
        reach = _Reach(mat)
        for pdf in _user_batches([users], len(ids)):
            a = pdf[pu].to_numpy(np.float64)
            cand = reach.candidates(a, t)
            if len(cand):
                sc = block_scores(a, mat[cand])
                r, c = np.nonzero((sc >= t) if inclusive else (sc > t))
                yield pd.DataFrame({"u": pdf["u"].to_numpy()[r], "s": ids[cand[c]], "score": sc[r, c]})

    out = _tiles(model, reduce_, schema, block_bytes=broadcast_bytes, threshold=t)
    return exclude_seen(out, seen) if seen is not None else out


def user_summary(model: LatentClassModel, broadcast_bytes: int | None = None) -> DataFrame:
    """Per user over all items: (u, n_items, score_sum, score_max), without all-pairs work: the sum is
    sum_z p(z|u) * (sum_s p(s|z)), the maximum comes from the exact top-1 search."""
    totals = model.items.agg(*[F.sum(f"ps{z}").alias(f"t{z}") for z in range(model.k)]).first()  # k numbers
    total = row_sum([F.col(f"pu{z}") * F.lit(float(totals[f"t{z}"] or 0.0)) for z in range(model.k)])
    best = recommend(model, 1, None, broadcast_bytes).select("u", F.col("score").alias("score_max"))
    return model.users.join(best, "u").select("u", F.lit(int(model.n_items)).cast("bigint").alias("n_items"),
                                              total.alias("score_sum"), "score_max")


# Neighbouring users (items) of a group, coarse to fine, and pairs of groups compared at once.
GROUPS = (4096, 512, 64)
GROUP_PAIRS = 1_000_000
# Classes a block is put in order by.
ORDER_CLASSES = 4


def _neighbours(x: np.ndarray) -> np.ndarray:
    """An order in which rows near each other are alike: along a Z-curve over the ranks in the classes
    that vary most."""
    picked = np.argsort(-x.std(axis=0), kind="stable")[:ORDER_CLASSES]
    bits = min(16, 62 // len(picked))
    code = np.zeros(len(x), dtype=np.int64)
    for at, z in enumerate(picked):
        rank = np.empty(len(x), dtype=np.int64)
        rank[np.argsort(x[:, z], kind="stable")] = np.arange(len(x))
        rank = rank * (1 << bits) // max(1, len(x))
        for b in range(bits):
            code |= ((rank >> b) & 1) << (b * len(picked) + at)
    return np.argsort(code, kind="stable")


def _group_ends(x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest value of every class in each run of ``size`` rows."""
    first = np.arange(0, len(x), size)
    return np.minimum.reduceat(x, first, axis=0), np.maximum.reduceat(x, first, axis=0)


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, summed left to right over z as in block_scores."""
    acc = a[:, 0] * b[:, 0]
    for z in range(1, a.shape[1]):
        acc = acc + a[:, z] * b[:, z]
    return acc


# Pairs of the smallest groups scored at once.
LEAF_PAIRS = 64


class _Rough:
    """Scores of pairs of groups in single precision, by matrix products, and how far they can be off.

    With k classes the rounding of the values, products and sums (in whatever order) moves a score by
    less than (k + 2) 2^-24 of it, as nothing is negative. So cells off the threshold by twice
    that and more are decided, and only the others are scored in full. Where single precision
    underflows (tiny thresholds), or there is nothing to decide by, all cells count as near."""

    def __init__(self, a: np.ndarray, b: np.ndarray, size: int, ths: np.ndarray):
        self.a, self.b = (self._groups(x, size) for x in (a, b))
        self.a = np.ascontiguousarray(self.a.transpose(0, 2, 1))
        margin = (a.shape[1] + 4) * 2.0**-23
        self.low, self.high = ((ths * f).astype(np.float32) for f in (1 - margin, 1 + margin))
        self.near = ~((ths > 1e-30) & (ths < 1e30))

    @staticmethod
    def _groups(x: np.ndarray, size: int) -> np.ndarray:
        """Groups x rows x classes; rows past the end are 0."""
        out = np.zeros((-(-len(x) // size) * size, x.shape[1]), dtype=np.float32)
        out[: len(x)] = x
        return out.reshape(-1, size, x.shape[1])

    def scores(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """pairs x items x users"""
        return np.matmul(self.b[j], self.a[i])

    def over(self, x: np.ndarray, some: np.ndarray, n: int):
        """Of the pairs ``some``, by user how many items surely reach threshold ``n``; and the cells
        that may: pair, item, user."""
        x = x if len(some) == len(x) else x[some]
        if self.near[n]:
            return np.zeros((len(x), x.shape[2]), dtype=np.int64), *(g.ravel() for g in np.indices(x.shape))
        sure, may = x >= self.high[n], x >= self.low[n]
        found = sure.view(np.uint8).sum(axis=1, dtype=np.uint8 if x.shape[1] < 256 else None).astype(np.int64)
        if np.count_nonzero(may) == found.sum():
            return found, *np.zeros((3, 0), dtype=np.int64)
        np.not_equal(may, sure, out=may)
        flat = may.reshape(-1)
        if not len(flat) % 8:  # few cells are near: eight at a time
            words = np.flatnonzero(flat.view(np.uint64))
            cells = (words[:, None] * 8 + np.arange(8)).ravel()
            cells = cells[flat[cells]]
        else:
            cells = np.flatnonzero(flat)
        return found, *np.unravel_index(cells, x.shape)


def reaching(a: np.ndarray, b: np.ndarray, thresholds: list[float], inclusive: bool = True) -> np.ndarray:
    """users x thresholds: how many of the items ``b`` score at least (strictly: over) each threshold.

    Exact without scoring every cell: users and items are put into groups of alike rows. The products
    of the groups' lowest and of their highest values bound the scores of a pair of groups (products
    and sums round monotonically and are summed in the same order, so the bounds hold bit for bit;
    the values are not negative). A pair is finished if no threshold lies between its bounds, else
    its subgroups are compared, and the cells of the smallest are scored: in single precision
    first, and in full where that does not decide (:class:`_Rough`)."""
    ths = np.asarray(thresholds, dtype=np.float64)
    out = np.zeros((len(a), len(ths)), dtype=np.int64)
    if not len(a) or not len(b):
        return out
    hit = (lambda x, t: x >= t) if inclusive else (lambda x, t: x > t)
    own, other = _neighbours(a), _neighbours(b)
    a, b = a[own], b[other]
    ends = [(*_group_ends(a, g), *_group_ends(b, g)) for g in GROUPS]
    counts = np.zeros_like(out)
    # items of finished pairs, by user group of each level
    sums = [np.zeros((len(e[0]), len(ths)), dtype=np.int64) for e in ends]
    ii, jj = (x.ravel() for x in np.meshgrid(np.arange(len(ends[0][0])), np.arange(len(ends[0][2])), indexing="ij"))
    size, (low_a, high_a, low_b, high_b) = GROUPS[-1], ends[-1]
    rough = _Rough(a, b, size, ths)

    def leaf(i: np.ndarray, j: np.ndarray) -> None:
        """The cells of pairs of the smallest groups."""
        low, high = _dots(low_a[i], low_b[j]), _dots(high_a[i], high_b[j])
        x, rows = rough.scores(i, j), i[:, None] * size + np.arange(size)
        there = rows < len(a)
        for n, t in enumerate(ths):
            every = hit(low, t)
            np.add.at(counts[:, n], rows[every][there[every]], np.repeat(np.minimum(size, len(b) - j[every] * size), there[every].sum(axis=1)))
            some = np.flatnonzero(~every & (hit(high, t) | np.isnan(high)))
            if len(some):
                sure, g, s, u = rough.over(x, some, n)
                if len(g):  # too near the threshold to tell
                    r, c = rows[some[g], u], j[some[g]] * size + s
                    inside = (r < len(a)) & (c < len(b))
                    r, c = r[inside], c[inside]
                    np.add.at(counts[:, n], r, hit(_dots(a[r], b[c]), t))
                inside = there[some]
                np.add.at(counts[:, n], rows[some][inside], sure[inside])

    todo = [(0, ii[lo : lo + GROUP_PAIRS], jj[lo : lo + GROUP_PAIRS]) for lo in range(0, len(ii), GROUP_PAIRS)]
    while todo:
        level, i, j = todo.pop()
        low_a, high_a, low_b, high_b = ends[level]
        low, high = _dots(low_a[i], low_b[j])[:, None], _dots(high_a[i], high_b[j])[:, None]
        all_hit = hit(low, ths)
        is_open = (~all_hit & ~(~hit(high, ths) & ~np.isnan(high))).any(axis=1)
        size = GROUPS[level]
        held = np.minimum(size, len(b) - j * size)
        for n in range(len(ths)):
            sums[level][:, n] += np.bincount(i, np.where(all_hit[:, n] & ~is_open, held, 0), len(sums[level])).astype(np.int64)
        i, j = i[is_open], j[is_open]
        if level + 1 < len(GROUPS):
            cut = size // GROUPS[level + 1]
            sub = np.arange(cut)
            step = max(1, GROUP_PAIRS // cut**2)
            n_a, n_b = len(ends[level + 1][0]), len(ends[level + 1][2])
            for lo in range(0, len(i), step):
                x, y = np.broadcast_arrays((i[lo : lo + step, None] * cut + sub)[:, :, None], (j[lo : lo + step, None] * cut + sub)[:, None, :])
                there = (x < n_a) & (y < n_b)
                todo.append((level + 1, x[there], y[there]))
            continue
        for lo in range(0, len(i), LEAF_PAIRS):
            leaf(i[lo : lo + LEAF_PAIRS], j[lo : lo + LEAF_PAIRS])
    for g, s in zip(GROUPS, sums):
        counts += np.repeat(s, g, axis=0)[: len(a)]
    out[own] = counts
    return out


def positive_counts(model: LatentClassModel | JointModels, thresholds: list[float], inclusive: bool = True,
                    per_user: bool = False, broadcast_bytes: int | None = None) -> DataFrame:
    """Number of all (u, s) pairs predicted positive at each threshold.

    Output (threshold, n_pos) — or (u, threshold, n_pos) with ``per_user``; n_pos of all users is a
    decimal (it may pass 2^63). Of several models (k, threshold, n_pos), from one set of tiles. Items
    and tiles that cannot reach the smallest threshold are not shuffled (:func:`_reachable`); inside a tile
    only cells that bounds leave open are scored (:func:`reaching`). Partial counts per tile are summed by one
    small aggregation."""
    ths, p, joint = [float(t) for t in thresholds], params_of(model), isinstance(model, JointModels)
    ks, pus, spans = [len(c) for c in p.pu], p.pu, p.spans
    fields = [T.StructField("u", p.users.schema["u"].dataType)] if per_user else []
    fields += [T.StructField("k", T.IntegerType())]
    schema = T.StructType([*fields, T.StructField("threshold", T.DoubleType()), T.StructField("n_pos", T.LongType())])

    def reduce_(users, ids, mat, _):
        for k, pu, span in zip(ks, pus, spans):
            counts = reaching(users[pu].to_numpy(np.float64), np.ascontiguousarray(mat[:, span]), ths, inclusive)
            for i, t in enumerate(ths):
                if per_user:
                    some = counts[:, i] > 0  # the others are in the table of zeros below
                    yield pd.DataFrame({"u": users["u"].to_numpy()[some], "k": np.int32(k), "threshold": t, "n_pos": counts[some, i]})
                else:
                    yield pd.DataFrame({"k": [np.int32(k)], "threshold": [t], "n_pos": [counts[:, i].sum()]})

    found = _tiles(model, reduce_, schema, block_bytes=broadcast_bytes, threshold=min(ths), cells=COUNT_CELLS)
    # users and thresholds without any tile count 0
    none = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(t).alias("threshold")) for k in ks for t in ths])).alias("c")
    base = p.users.select("u", none) if per_user else p.users.sparkSession.range(1).select(none)
    found = found.unionByName(base.select(*(["u"] if per_user else []), "c.k", "c.threshold", F.lit(0).cast("long").alias("n_pos")))
    keys = (["u"] if per_user else []) + (["k"] if joint else []) + ["threshold"]
    if per_user:
        return found.groupBy(*keys).agg(F.sum("n_pos").cast("bigint").alias("n_pos"))
    return found.groupBy(*keys).agg(F.sum(F.col("n_pos").cast(COUNT)).cast(COUNT).alias("n_pos"))


def _top_rows(masked: np.ndarray, n: int):
    """Per row: (row, col, value, rank) of the first n finite entries by value desc, col asc."""
    n_cols = masked.shape[1]
    m = min(n, n_cols)
    if m == 0:
        e = np.zeros(0, dtype=np.int64)
        return e, e, np.zeros(0), e
    kth = np.partition(masked, n_cols - m, axis=1)[:, n_cols - m]  # m-th best (ties kept below)
    r, c = np.nonzero((masked >= kth[:, None]) & np.isfinite(masked))
    v = masked[r, c]
    o = np.lexsort((c, -v, r))
    r, c, v = r[o], c[o], v[o]
    rank = np.arange(len(r)) - np.searchsorted(r, r, side="left") + 1
    keep = rank <= m
    return r[keep], c[keep], v[keep], rank[keep]


def _seen_positions(users: np.ndarray, ids: np.ndarray, seen: pd.DataFrame) -> list:
    """For each user of the block, the positions in ``ids`` of the seen items (others are ignored)."""
    out: list = [None] * len(users)
    if len(seen):
        who, where = pd.Index(users).get_indexer(seen["u"]), pd.Index(ids).get_indexer(seen["s"])
        known = (who >= 0) & (where >= 0)
        who, where = who[known], where[known]
        order = np.argsort(who, kind="stable")
        rows, starts = np.unique(who[order], return_index=True)
        for r, part in zip(rows, np.split(where[order], starts[1:])):
            out[r] = np.unique(part)
    return out


def _bound(a: np.ndarray, t: np.ndarray) -> np.ndarray:
    """sum_z a_z t_z, left to right: the score of a virtual item, same rounding as block_scores."""
    acc = a[:, 0] * t[0]
    for z in range(1, a.shape[1]):
        acc = acc + a[:, z] * t[z]
    return acc


# Rounds of the per-class lists before the users left go by groups.
LIST_ROUNDS = 2


def _top_by_groups(a: np.ndarray, mat: np.ndarray, todo: np.ndarray, seen_pos: list, n: int) -> Iterator[tuple]:
    """(user, item, score, rank) of the top-n unseen items of the users ``todo``, by groups of alike ones.

    With the lowest and highest values of a group's users an item scores at least and at most a
    bound for all of them (as in :func:`reaching`, bit for bit). An item whose upper bound is below
    the n-th best of the lower bounds (of the best n and as many as a user has seen) is among no
    user's best. Each level hands the items left to its smaller groups; the last scores them."""
    todo = todo[_neighbours(a[todo])]

    def narrowed(users: np.ndarray, cand: np.ndarray, b: np.ndarray):
        need = n + max((len(seen_pos[u]) for u in users if seen_pos[u] is not None), default=0)
        if need >= len(cand):
            return cand, b
        low, high = a[users].min(axis=0), a[users].max(axis=0)
        at_least = _bound(b.T, low)
        best = np.partition(at_least, len(cand) - need)[len(cand) - need]
        kept = _bound(b.T, high) >= best
        return cand[kept], np.ascontiguousarray(b[:, kept])

    def search(users: np.ndarray, cand: np.ndarray, b: np.ndarray, level: int):
        cand, b = narrowed(users, cand, b)
        if level + 1 < len(GROUPS):
            size = GROUPS[level + 1]
            for lo in range(0, len(users), size):
                yield from search(users[lo : lo + size], cand, b, level + 1)
            return
        step = max(1, BLOCK_CELLS // max(1, len(cand)))
        for lo in range(0, len(users), step):
            some = users[lo : lo + step]
            sc = block_scores(a[some], b.T)
            for i, u in enumerate(some):
                if seen_pos[u] is not None:
                    sc[i, np.isin(cand, seen_pos[u], assume_unique=True)] = -np.inf
            r, c, v, k = _top_rows(sc, n)
            yield some[r], cand[c], v, k

    whole = np.ascontiguousarray(mat.T)
    for lo in range(0, len(todo), GROUPS[0]):
        yield from search(todo[lo : lo + GROUPS[0]], np.arange(len(mat)), whole, 0)


def top_n_exact(a: np.ndarray, ids: np.ndarray, mat: np.ndarray, order: np.ndarray, seen_pos: list, n: int):
    """Exact top-n unseen items for a batch of users without scoring every item.

    Threshold search over the k per-class item lists sorted by p(s|z): the
    candidates are the union of the first d items of every list, and an item
    outside them scores at most sum_z p(z|u) t_z with t_z the (d+1)-th value
    of list z (products and sums round monotonically, so the bound holds bit
    for bit). A user is finished once their n-th best unseen candidate beats
    the bound strictly (so no outside item can tie or win); the others go on
    with 4x the depth, and after LIST_ROUNDS in groups of alike users (:func:`_top_by_groups`):
    where classes differ little, the lists would have to be read to their ends.
    """
    n_items = len(ids)
    rows_r, rows_c, rows_v, rows_k = [], [], [], []
    todo = np.arange(a.shape[0])
    d = max(4 * n, 64)
    need = min(n, n_items)
    rounds = 0
    while len(todo):
        if rounds == LIST_ROUNDS and d < n_items:
            for r, c, v, k in _top_by_groups(a, mat, todo, seen_pos, n):
                rows_r.append(r)
                rows_c.append(c)
                rows_v.append(v)
                rows_k.append(k)
            break
        rounds += 1
        full = d >= n_items
        cand = np.arange(n_items) if full else np.unique(order[:d].ravel())
        col_of = np.full(n_items, -1, dtype=np.int64)
        col_of[cand] = np.arange(len(cand))
        t = None if full else mat[order[d], np.arange(mat.shape[1])]
        finished = np.zeros(len(todo), dtype=bool)
        step = max(1, BLOCK_CELLS // max(1, len(cand)))  # bounded block even when cand = all items
        for lo in range(0, len(todo), step):
            users = todo[lo: lo + step]
            sc = block_scores(a[users], mat[cand])
            unseen = np.full(len(users), len(cand))
            for i, u in enumerate(users):
                if seen_pos[u] is not None:
                    cols = col_of[seen_pos[u]]
                    cols = cols[cols >= 0]
                    sc[i, cols] = -np.inf
                    unseen[i] -= len(cols)
            r, c, v, k = _top_rows(sc, n)
            if full:
                done = np.ones(len(users), dtype=bool)
            else:
                last = np.full(len(users), -np.inf)
                at = k == need  # the n-th best candidate of each row that has one
                last[r[at]] = v[at]
                done = (unseen >= need) & (last > _bound(a[users], t))
            sel = done[r]
            rows_r.append(users[r[sel]])
            rows_c.append(cand[c[sel]])
            rows_v.append(v[sel])
            rows_k.append(k[sel])
            finished[lo: lo + len(users)] = done
        todo = todo[~finished]
        d *= 4
    cat = (lambda xs, dt: np.concatenate(xs) if xs else np.zeros(0, dtype=dt))
    return cat(rows_r, np.int64), cat(rows_c, np.int64), cat(rows_v, np.float64), cat(rows_k, np.int64)


def recommend(model: LatentClassModel, n: int = 5, seen: DataFrame | None = None,
              broadcast_bytes: int | None = None) -> DataFrame:
    """Top-n unseen items per user: (u, rank, s, score), ties broken by smaller s.

    Exact, but not |U| x |S|: each tile runs :func:`top_n_exact` (per-class orderings computed once
    per tile); with several item blocks a window merges the tiles' n candidates of a user. Models with
    a state by block go by blocks of users (:func:`_recommend_by_block`)."""
    schema = T.StructType([T.StructField("u", model.users.schema["u"].dataType), T.StructField("rank", T.IntegerType()),
                           T.StructField("s", model.items.schema["s"].dataType), T.StructField("score", T.DoubleType())])
    pu = [f"pu{z}" for z in range(model.k)]

    def reduce_(users, ids, mat, seen_pairs):
        order = np.argsort(-mat, axis=0, kind="stable")  # per class, best first
        positions = _seen_positions(users["u"].to_numpy(), ids, seen_pairs)
        r, c, v, rank = top_n_exact(users[pu].to_numpy(np.float64), ids, mat, order, positions, n)
        yield pd.DataFrame({"u": users["u"].to_numpy()[r], "rank": rank.astype(np.int32), "s": ids[c], "score": v})

    if model.blocks is not None:
        return _recommend_by_block(model, n, seen, schema, broadcast_bytes)
    found = _tiles(model, reduce_, schema, seen, broadcast_bytes, cells=None)
    if _tile_shape(params_of(model), broadcast_bytes, None)[1] == 1:
        return found
    w = Window.partitionBy("u").orderBy(F.desc("score"), F.asc("s"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def _recommend_by_block(model: LatentClassModel, n: int, seen: DataFrame | None, schema: T.StructType,
                        block_bytes: int | None) -> DataFrame:
    """The same over a state by block: a task has a block of users and what they have seen, and goes
    through the blocks of items one group at a time, keeping the best n. Only the seen pairs move, once."""
    p, (state, n_users, n_items) = params_of(model), model.blocks
    spark, cols = p.users.sparkSession, min(_tile_shape(p, block_bytes, None)[1], n_items)
    utype, stype = p.users.schema["u"].dataType, p.items.schema["s"].dataType

    def best(block: int, had: pd.DataFrame | None) -> pd.DataFrame:
        users, a = state.read("u", [block])
        top = pd.DataFrame({"who": np.zeros(0, np.int64), "s": [], "score": np.zeros(0)})
        if had is not None:
            had = had[["u", "s", "group"]].sort_values("group", kind="stable")
            ends = np.searchsorted(had["group"].to_numpy(), np.arange(cols + 1))
        for y in range(cols if len(users) else 0):
            items, mat = state.read("s", range(y, n_items, cols))
            order = np.argsort(items.to_numpy(), kind="stable")
            ids, mat = items.to_numpy()[order], mat[order]
            if not len(ids):
                continue
            order = np.argsort(-mat, axis=0, kind="stable")  # per class, best first
            of = had.iloc[ends[y] : ends[y + 1]] if had is not None else pd.DataFrame({"u": [], "s": []})
            r, c, v, _ = top_n_exact(a, ids, mat, order, _seen_positions(users.to_numpy(), ids, of), n)
            found = pd.DataFrame({"who": r, "s": ids[c], "score": v})
            top = pd.concat([top, found], ignore_index=True) if len(top) else found
            top = top.sort_values(["who", "score", "s"], ascending=[True, False, True], kind="stable", ignore_index=True)
            top = top[top.groupby("who").cumcount() < n]
        rank = top.groupby("who").cumcount().to_numpy() + 1
        return pd.DataFrame({"u": users.to_numpy()[top["who"].to_numpy()], "rank": rank.astype(np.int32), "s": top["s"].to_numpy(),
                             "score": top["score"].to_numpy()})

    # blocks are dealt to tasks by hash: with more of these fewer hold two
    every = spark.range(0, n_users, 1, min(n_users, MOST_PARTITIONS)).select(F.col("id").cast("int").alias("block"))
    if seen is None:
        def run(it):
            for pdf in it:
                for b in pdf["block"]:
                    yield best(int(b), None)

        return every.mapInPandas(run, schema)
    placed = seen.select(F.col("u").cast(utype).alias("u"), F.col("s").cast(stype).alias("s")).where(F.col("u").isNotNull() & F.col("s").isNotNull())
    placed = placed.select(block_of("u", n_users).alias("block"), (block_of("s", n_items) % cols).alias("group"), "u", "s")
    parts = min(4 * n_users, MOST_PARTITIONS)
    return (every.repartition(parts, "block").groupBy("block").cogroup(placed.repartition(parts, "block").groupBy("block"))
            .applyInPandas(lambda own, had: best(int(own["block"].iloc[0]), had), schema))


def _positive_table(pos: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positive scores (with ``n``: each value once and how often it stands) as (unique values in
    order, multiplicities, #below each value).

    Plain arrays, so the broadcast needs nothing but numpy on the executors."""
    pos = np.asarray(pos, dtype=np.float64)
    if n is None:
        uniq, counts = np.unique(pos, return_counts=True)
    else:
        order = np.argsort(pos, kind="stable")
        uniq, counts = pos[order], np.asarray(n)[order].astype(np.int64)
    return uniq, counts, np.concatenate([[0], np.cumsum(counts)])


def _pos_sums(table, x: np.ndarray, times: np.ndarray | None = None) -> tuple[int, int]:
    """(sum over x of #(pos > x), sum over x of #(pos == x)); ``times``: how often each x stands.

    Unless the block is small beside the positive table, sort the block and
    search the positive values into it (n log n once, instead of a binary search
    per element); otherwise search each x into the positives."""
    uniq, counts, below = table
    total = int(below[-1])
    if len(x) == 0 or total == 0:
        return 0, 0
    if times is None and 4 * len(x) > len(uniq):
        xs = np.sort(x, kind="quicksort")
        lo = np.searchsorted(xs, uniq, side="left")
        hi = np.searchsorted(xs, uniq, side="right")
        gt = int((counts * lo).sum())  # each positive v beats the lo block values below it
        eq = int((counts * (hi - lo)).sum())
        return gt, eq
    weight = 1 if times is None else times
    i = np.searchsorted(uniq, x, side="left")
    j = np.minimum(i, len(uniq) - 1)
    equal = np.where(uniq[j] == x, counts[j], 0)
    return int(((total - below[i] - equal) * weight).sum()), int((equal * weight).sum())
