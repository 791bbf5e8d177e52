"""Wide-form EM engine (the fit path).

State per pass is the pair of parameter tables (users x k, items x k), never
the responsibilities (pairs x k): q is recomputed from the parameters inside
the pass, so the only large input is the distinct pair table, written once.

While both parameter tables are proven to fit under the broadcast limit, one
pass is one Spark job::

    pairs ⋈ p(z|u) ⋈ p(s|z)            both sides broadcast
      -> w_z = p(z|u) p(s|z), evidence = sum_z w_z, q_z = w_z / evidence, ln evidence   (in-row)
      -> GROUPING SETS ((u), (s)): sum q_z per user and per item          (partial + final agg)
         plus sum ln(evidence) and sum weight on the user rows (log-likelihood)
      -> written to the checkpoint folder (cuts lineage, survives executor loss)

Beyond it the pairs are written once as a grid of R user blocks x C item
blocks (:class:`PairGrid`). A pass brings each cell its block of p(z|u) and of
p(s|z) (each parameter row is copied C or R times), the cell sums what it
holds, and one aggregation adds up the cells. R and C follow from measured
bytes and counts, so a task holds one bounded cell whatever the table's size.
Hot users and items have cells of their own, so R and C follow from the rest.

The copies of a pass grow with R and C. Parameter tables of more than ``STRIP_BYTES`` go by strips
(:mod:`latentcf.operators.strips`): tasks read the blocks they need, and a pass only writes the state.

The k+5 scalars the driver needs (class totals N(z), log-likelihood sums,
row counts) are observed during that same write (``DataFrame.observe``).
The last pass only needs the log-likelihood, so it runs a global aggregate
instead of the M-step.

``alpha`` and ``eta`` are pseudo-counts added to the class counts of users and
items: with them the same passes are the MAP-EM of latent Dirichlet allocation
(concentrations 1 + alpha and 1 + eta).
"""

from __future__ import annotations

import json
import math
import time
import uuid
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latentcf.functions.hashing import keyed_unit_open
from latentcf.functions.numeric import EVIDENCE_FLOOR, row_sum
from latentcf.model import JointModels, LatentClassModel
from latentcf.operators.strips import BlockState, PairStrips, strip_pairs, strips_aggregate, strips_drawn
from latentcf.session import note_table, remove_path, scratch_path

# Bytes per parameter row estimate: k doubles + row overhead (the keys are measured).
ROW_OVERHEAD_BYTES = 48
DEFAULT_BROADCAST_BYTES = 16 * 1024 * 1024
# Grid cells: bytes of either parameter block and pairs a task holds at once.
CELL_BYTES = 64 * 1024 * 1024
CELL_PAIRS = 4_000_000
# Parameter tables (both, of all models) of more bytes go by strips, not by the grid.
STRIP_BYTES = 64 * 1024 * 1024
# Pairs a cell works through at a time.
STEP_PAIRS = 500_000
# A core gets up to so many cells, if they hold at least so many pairs on average: buckets are dealt by hash,
# and with one cell a core some would wait for those with two.
CORE_CELLS, LEAST_PAIRS = 4, 250_000
# Layout of a run directory; a resume under another version is refused.
RUN_VERSION = 2

TRACE_SCHEMA = T.StructType(
    [
        T.StructField("iteration", T.IntegerType(), False),
        T.StructField("loglik", T.DoubleType(), True),
        T.StructField("seconds", T.DoubleType(), True),
    ]
)


def broadcast_limit(spark: SparkSession) -> int:
    v = spark.conf.get("spark.latentcf.maxBroadcastBytes", None)
    return int(v) if v else DEFAULT_BROADCAST_BYTES


def param_bytes(n_rows: int, k: int, key_bytes: int = 0) -> int:
    """Size of a parameter table; ``key_bytes`` is the measured total width of its keys."""
    return n_rows * (8 * k + ROW_OVERHEAD_BYTES) + key_bytes


def maybe_broadcast(df: DataFrame, n_rows: int, k: int, limit: int, key_bytes: int = 0) -> DataFrame:
    """Broadcast a parameter table only when its size is proven under the limit;
    otherwise leave the join to a shuffle (AQE splits skewed keys)."""
    return F.broadcast(df) if param_bytes(n_rows, k, key_bytes) <= limit else df


def _w(weight_col: str | None):
    return F.col(weight_col).cast("double") if weight_col else None


# ---------------------------------------------------------------- E-step


def initial_responsibilities(pairs: DataFrame, k: int, seed: int) -> DataFrame:
    """q0(z; u, s) in (0, 1] from a keyed hash, one column per class.

    Not normalised over z (the first M-step normalises anyway)."""
    return pairs.select(
        "*", *[keyed_unit_open(F.col("u"), F.col("s"), F.lit(z), F.lit(seed)).alias(f"q{z}") for z in range(k)]
    )


def responsibilities(pairs: DataFrame, users: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """E-step in wide form: pairs columns + (q0..q{k-1}, evidence, lnev).

    ``users`` carries pu0.., ``items`` ps0..; evidence = sum_z pu_z ps_z is
    p(s|u) under the current parameters, floored to avoid log(0) / 0-division.
    """
    keep = pairs.columns
    joined = pairs.join(users, "u").join(items, "s")
    w = joined.select(
        *keep,
        *[(F.col(f"pu{z}") * F.col(f"ps{z}")).alias(f"w{z}") for z in range(k)],
    )
    ev = w.select("*", F.greatest(row_sum([f"w{z}" for z in range(k)]), F.lit(EVIDENCE_FLOOR)).alias("evidence"))
    return ev.select(*keep, *[(F.col(f"w{z}") / F.col("evidence")).alias(f"q{z}") for z in range(k)],
                     "evidence", F.log("evidence").alias("lnev"))


# ---------------------------------------------------------------- M-step


def m_aggregate(resp: DataFrame, k: int, weight_col: str | None = None) -> DataFrame:
    """Both M-step sums in one aggregation (GROUPING SETS ((u), (s))).

    Output: side ('u' | 's'), u, s, m0..m{k-1}, ll, wsum, n
      side u: m_z = sum_s q_z  (unnormalised p(z|u)),  ll = sum ln evidence
      side s: m_z = sum_u q_z  (N(s,z))
    """
    w = _w(weight_col)
    qs = [(F.col(f"q{z}") * w) if w is not None else F.col(f"q{z}") for z in range(k)]
    aggs = [F.sum(q).alias(f"m{z}") for z, q in enumerate(qs)]
    if "lnev" in resp.columns:
        ll = F.col("lnev") * w if w is not None else F.col("lnev")
        aggs.append(F.sum(ll).alias("ll"))
    else:
        aggs.append(F.lit(None).cast("double").alias("ll"))
    aggs.append(F.sum(w if w is not None else F.lit(1.0)).alias("wsum"))
    aggs.append(F.count(F.lit(1)).alias("n"))
    g = resp.groupingSets([["u"], ["s"]], "u", "s").agg(F.grouping("s").alias("_gs"), *aggs)
    return g.select(F.when(F.col("_gs") == 1, "u").otherwise("s").alias("side"), "u", "s", *[f"m{z}" for z in range(k)],
                    "ll", "wsum", "n")


@dataclass
class StateStats:
    n_users: int
    n_items: int
    class_totals: list
    ll_sum: float | None
    w_sum: float
    n_pairs: int = 0
    user_key_bytes: int = 0
    item_key_bytes: int = 0
    path: str | None = None

    @property
    def loglik(self) -> float | None:
        if self.ll_sum is None or not self.w_sum:
            return None
        return self.ll_sum / self.w_sum


def _state_metrics(k: int) -> list:
    """Scalars every pass needs, as aggregates over the state rows."""
    side_u, side_s = F.col("side") == "u", F.col("side") == "s"
    return (
        [F.sum(F.when(side_s, F.col(f"m{z}"))).alias(f"m{z}") for z in range(k)]
        + [
            F.sum(F.when(side_u, F.col("ll"))).alias("ll"),
            F.sum(F.when(side_u, F.col("wsum"))).alias("wsum"),
            F.sum(F.when(side_u, 1).otherwise(0)).alias("nu"),
            F.sum(F.when(side_s, 1).otherwise(0)).alias("ns"),
            F.sum(F.when(side_u, F.col("n"))).alias("np"),
        ]
        + _key_metrics()
    )


def _key_metrics() -> list:
    return [F.sum(F.when(F.col("side") == side, F.octet_length(F.col(key).cast("string")))).alias(f"k{key}")
            for side, key in (("u", "u"), ("s", "s"))]


def _stats_from(r, k: int, path: str | None = None) -> StateStats:
    totals = [r[f"m{z}"] for z in range(k)]
    return StateStats(int(r["nu"] or 0), int(r["ns"] or 0), totals, r["ll"], float(r["wsum"] or 0.0),
                      int(r["np"] or 0), int(r["ku"] or 0), int(r["ks"] or 0), path)


def _folders(state: DataFrame) -> list[str]:
    """The columns a state is written by: states of strips have blocks."""
    return ["side", "block"] if "block" in state.columns else ["side"]


def write_state(spark: SparkSession, state: DataFrame, tag: str, k: int,
                path: str | None = None) -> tuple[str, StateStats]:
    """Write the state and collect its scalars in the same job (``observe``)."""
    path = path or scratch_path(spark, tag)
    obs = Observation(f"latentcf_{uuid.uuid4().hex[:8]}")
    state.observe(obs, *_state_metrics(k)).write.mode("overwrite").partitionBy(*_folders(state)).parquet(path)
    return path, _stats_from(obs.get, k, path)


def committed(spark: SparkSession, path: str) -> bool:
    """True when a write to ``path`` finished (the committer's _SUCCESS marker).

    Only a missing marker means no; any other failure to read it is raised."""
    try:
        spark.read.text(path.rstrip("/") + "/_SUCCESS")
        return True
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise


def load_state(spark: SparkSession, path: str, k: int, stats: StateStats | None = None,
               alpha: float = 0.0, eta: float = 0.0) -> tuple[DataFrame, DataFrame, StateStats]:
    """Read a written state back as normalised parameter tables + scalars."""
    st = spark.read.parquet(path)
    m = [f"m{z}" for z in range(k)]
    if stats is None:
        stats = _stats_from(st.agg(*_state_metrics(k)).first(), k, path)
    users = _user_table(st.where(F.col("side") == "u"), [m], [[f"pu{z}" for z in range(k)]], alpha)
    items = _item_table(st.where(F.col("side") == "s"), m, [f"ps{z}" for z in range(k)], stats.class_totals,
                        stats.n_items, eta)
    return users, items, stats


def _user_table(rows: DataFrame, counts: list[list[str]], names: list[list[str]], alpha: float) -> DataFrame:
    """p(z|u) of one or several models: counts + alpha over their total."""
    # each row total once, then k divisions (inlining it would build k copies of a k-term sum)
    def smooth(c):
        return F.col(c) + F.lit(alpha) if alpha else F.col(c)

    flat = [c for cs in counts for c in cs]
    totals = [row_sum([smooth(c) for c in cs]).alias(f"_tot{j}") for j, cs in enumerate(counts)]
    return rows.select("u", *flat, *totals).select(
        "u", *[(smooth(c) / F.col(f"_tot{j}")).alias(n) for j, (cs, ns) in enumerate(zip(counts, names))
               for c, n in zip(cs, ns)])


def _item_table(rows: DataFrame, counts: list[str], names: list[str], totals: list, n_items: int, eta: float) -> DataFrame:
    """p(s|z): counts + eta over their class total."""
    # a class whose mass underflowed to 0 is dead: p(s|z) = 0 rather than 0/0
    return rows.select("s", *[
        ((F.col(c) + F.lit(eta)) / F.lit(float(t) + n_items * eta)).alias(n) if eta
        else ((F.col(c) / F.lit(float(t))) if t else F.lit(0.0)).alias(n)
        for c, n, t in zip(counts, names, totals)])


def m_step(spark: SparkSession, resp: DataFrame, k: int, weight_col: str | None = None, tag: str = "em-state",
           path: str | None = None, alpha: float = 0.0, eta: float = 0.0):
    """Run one M-step to a written state and return (users, items, stats)."""
    return _settle(spark, m_aggregate(resp, k, weight_col), k, tag, path, alpha, eta)


def _settle(spark: SparkSession, state: DataFrame, k: int, tag: str, path: str | None, alpha: float, eta: float):
    path, stats = write_state(spark, state, tag, k, path)
    return load_state(spark, path, k, stats, alpha, eta)


# ---------------------------------------------------------------- pair layout


@dataclass
class PairLayout:
    """The distinct pair table, written once; its grid is written when a fit first needs one."""

    df: DataFrame  # u, s, [w]
    n_pairs: int
    path: str | None = None  # set when the layout owns the written pairs
    grid: "PairGrid | PairStrips | None" = None
    # pairs of each user ('u') and item ('s'), written when first asked for: table, path
    counted: dict = field(default_factory=dict)

    def counts(self, key: str) -> DataFrame:
        """(key, count)"""
        if key not in self.counted:
            spark = self.df.sparkSession
            path, found = scratch_path(spark, "pair-counts"), self.df.groupBy(key).count()
            found.write.parquet(path)
            self.counted[key] = spark.read.schema(found.schema).parquet(path), path
        return self.counted[key][0]

    def drop(self) -> None:
        """Remove what was written for the fits (the fitted models do not read it)."""
        spark = self.df.sparkSession
        if self.grid is not None:
            self.grid.drop()
            self.grid = None
        for _, path in self.counted.values():
            remove_path(spark, path)
        self.counted = {}
        if self.path:
            remove_path(spark, self.path)
            self.path = None


@dataclass
class GridPart:
    """One rectangle of cells: its users (hot, cold or all) by its items, from cell ``first`` on."""

    first: int
    rows: int
    cols: int
    users: str
    items: str

    def cell(self, user_block, item_block):
        return (user_block.cast("long") * F.lit(self.cols) + item_block + F.lit(self.first)).alias("cell")


def _block_of(key: str, n: int):
    return F.pmod(F.xxhash64(key, F.lit("item")) if key == "s" else F.xxhash64(key), F.lit(n))


@dataclass
class PairGrid:
    """Pairs by cell: user block x item block, a table bucketed by cell so that the pairs stay
    where they are and only parameter rows move in a pass.

    Users (items) of more than a part of a cell's pairs are hot: their pairs lie in rectangles of
    their own, cut into as many cells as they fill, so they do not widen the grid of the others.
    A bucket holds several cells where there are more of them than Spark allows buckets; a task
    takes its cells one at a time."""

    df: DataFrame  # cell, u, s, [w]
    parts: list[GridPart]
    table: str
    path: str
    width: int | None = None  # class columns its blocks are sized for
    hot_users: DataFrame | None = None  # u
    hot_items: DataFrame | None = None  # s
    hot_path: str | None = None

    @property
    def cells(self) -> int:
        return sum(p.rows * p.cols for p in self.parts)

    def copies(self, side: str, hot: bool) -> int:
        """To how many cells the parameters of one user ('u') or item ('s') go."""
        kind = "hot" if hot else "cold"
        return sum(p.cols if side == "u" else p.rows for p in self.parts
                   if (p.users if side == "u" else p.items) in (kind, "all"))

    def spread(self, params: DataFrame, side: str) -> DataFrame:
        """``params`` with ``cell``: a row for every cell that needs it."""
        hot = self.hot_users if side == "u" else self.hot_items
        if hot is not None:
            params = params.join(hot.withColumn("_hot", F.lit(True)), side, "left")
        every = []
        for p in self.parts:
            kind, other = (p.users, p.cols) if side == "u" else (p.items, p.rows)
            across = F.sequence(F.lit(0), F.lit(other - 1))
            cells = (F.transform(across, lambda b: p.cell(_block_of("u", p.rows), b)) if side == "u"
                     else F.transform(across, lambda b: p.cell(b, _block_of("s", p.cols))))
            if hot is not None and kind != "all":
                mine = F.col("_hot").isNotNull() if kind == "hot" else F.col("_hot").isNull()
                cells = F.when(mine, cells).otherwise(F.expr("cast(array() as array<bigint>)"))
            elif hot is None and kind == "hot":
                continue
            every.append(cells)
        return params.withColumn("cell", F.explode(F.concat(*every))).drop("_hot")

    def drop(self) -> None:
        spark = self.df.sparkSession
        spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        for path in (self.path, self.hot_path):
            remove_path(spark, path)


#: A user or item is hot from this share of a cell's pairs on.
HOT_SHARE = 0.25


def _hot(counts: DataFrame, key: str, least: float, folder: str) -> DataFrame | None:
    """The keys of more than ``least`` pairs, written; at most n_pairs / least of them."""
    spark = counts.sparkSession
    path = f"{folder}/{key}"
    found = counts.where(F.col("count") > F.lit(least)).select(key)
    found.write.parquet(path)
    hot = spark.read.schema(found.schema).parquet(path)
    return None if hot.isEmpty() else hot


def _refined(P: DataFrame, n_pairs: int, rows: int, cols: int, cell_pairs: int, least_cells: int) -> tuple[int, int]:
    """(rows, cols), cut on until no cell of ``P`` holds more than ``cell_pairs`` pairs (distinct pairs
    always part: a single pair is the smallest cell)."""
    while rows * cols < least_cells:
        rows, cols = (2 * rows, cols) if rows <= cols else (rows, 2 * cols)
    while True:
        cell = F.struct(_block_of("u", rows), _block_of("s", cols))
        most = P.groupBy(cell).count().agg(F.max("count")).first()[0] or 0
        if most <= cell_pairs:
            return rows, cols
        # towards the even case at once; a skewed cell is cut on
        grow = max(1.5, n_pairs / (rows * cols) / cell_pairs)
        rows, cols = (math.ceil(rows * grow), cols) if rows <= cols else (rows, math.ceil(cols * grow))


def grid_pairs(P: DataFrame, n_pairs: int, user_bytes: int, item_bytes: int, cell_bytes: int = CELL_BYTES,
               cell_pairs: int = CELL_PAIRS, width: int | None = None) -> PairGrid:
    """Write the grid of ``P``: blocks so that every parameter block fits ``cell_bytes`` on average
    and no cell holds more than ``cell_pairs`` pairs."""
    spark = P.sparkSession
    cores = int(spark.sparkContext.defaultParallelism)
    rows, cols = max(1, math.ceil(user_bytes / cell_bytes)), max(1, math.ceil(item_bytes / cell_bytes))
    hot_path = scratch_path(spark, "pair-hot")
    least = max(1.0, HOT_SHARE * cell_pairs)
    hot = {key: _hot(P.groupBy(key).count(), key, least, hot_path) for key in ("u", "s")}
    marked = P
    for key, keys in hot.items():
        marked = (marked.join(keys.withColumn(f"_hot_{key}", F.lit(True)), key, "left") if keys is not None
                  else marked.withColumn(f"_hot_{key}", F.lit(None).cast("boolean")))
    of_user, of_item = F.col("_hot_u").isNotNull(), F.col("_hot_s").isNotNull()
    # a pair belongs to its hot user, else to its hot item, else to the common grid
    least_cells = min(CORE_CELLS * cores, max(cores, n_pairs // LEAST_PAIRS))
    wanted = [("cold", "cold", ~of_user & ~of_item, rows, cols, least_cells)]
    if hot["u"] is not None:
        wanted.append(("hot", "all", of_user, 1, cols, 1))
    if hot["s"] is not None:
        wanted.append(("cold", "hot", ~of_user & of_item, rows, 1, 1))
    parts, cell, first = [], F.lit(None).cast("long"), 0
    for users, items, mine, r, c, cells in wanted:
        own = marked.where(mine)
        n = n_pairs if len(wanted) == 1 else own.count()
        if users == "hot":  # few users, many items: cut along the items
            c = max(c, math.ceil(2 * n / cell_pairs))
        elif items == "hot":
            r = max(r, math.ceil(2 * n / cell_pairs))
        part = GridPart(first, *_refined(own, n, r, c, cell_pairs, cells), users, items)
        cell = F.when(mine, part.cell(_block_of("u", part.rows), _block_of("s", part.cols))).otherwise(cell)
        parts.append(part)
        first += part.rows * part.cols
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n_pairs / cell_pairs))
    buckets = min(buckets, int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")))
    path, name = scratch_path(spark, "pair-grid"), f"latentcf_grid_{uuid.uuid4().hex[:12]}"
    (marked.select(cell.alias("cell"), *P.columns).repartition(buckets, "cell").write.bucketBy(buckets, "cell").sortBy("cell")
     .option("path", path).saveAsTable(name))
    note_table(name)
    return PairGrid(spark.table(name), parts, name, path, width, hot["u"], hot["s"], hot_path)


def _no_key(kind: T.DataType):
    """A value in the place of the other side's key, so that keys arrive as what they are (with a null
    whole numbers would become doubles)."""
    return F.lit("") if isinstance(kind, T.StringType) else F.lit(0).cast(kind) if isinstance(kind, T.NumericType) else F.lit(None).cast(kind)


def _bins(widths: list[int], room: int) -> list[list[int]]:
    """Places of the models in groups of at most ``room`` class columns (or one model), widest first."""
    bins: list[list[int]] = []
    for j in sorted(range(len(widths)), key=lambda j: -widths[j]):
        fit_in = next((b for b in bins if sum(widths[i] for i in b) + widths[j] <= room), None)
        if fit_in is None:
            bins.append([j])
        else:
            fit_in.append(j)
    return [sorted(b) for b in bins]


def grid_aggregate(grid: PairGrid, users: DataFrame, items: DataFrame, names: list[list[str]], lls: list[str],
                   weight_col: str | None) -> DataFrame:
    """The pass over a grid: the rows of :func:`m_aggregate` for one or several models.

    ``names`` has the class labels of each model (columns pu<label>, ps<label>, m<label>), ``lls``
    the log-likelihood column of each. Users and items follow their blocks to every cell of their
    row or column. Models wider together than the grid's blocks are sized for go through the cells
    in several groups: more blocks would copy every column to more cells."""
    every = [f"m{n}" for ns in names for n in ns] + lls
    parts = None
    for at, group in enumerate(_bins([len(ns) for ns in names], grid.width or sum(map(len, names)))):
        found = _grid_parts(grid, users, items, [names[j] for j in group], [lls[j] for j in group], weight_col)
        if at:  # weights and counts are those of the first group
            found = found.withColumns({"wsum": F.lit(None).cast("double"), "n": F.lit(None).cast("long")})
        parts = found if parts is None else parts.unionByName(found, allowMissingColumns=True)
    sums = parts.groupBy("side", "u", "s").agg(*[F.sum(c).alias(c) for c in every + ["wsum", "n"]])
    return _keys_apart(sums, every + ["wsum", "n"])


def _keys_apart(sums: DataFrame, columns: list[str]) -> DataFrame:
    return sums.select("side", F.when(F.col("side") == "u", F.col("u")).alias("u"), F.when(F.col("side") == "s", F.col("s")).alias("s"), *columns)


def _grid_parts(grid: PairGrid, users: DataFrame, items: DataFrame, names: list[list[str]], lls: list[str],
                weight_col: str | None) -> DataFrame:
    """The sums of each cell."""
    flat = [n for ns in names for n in ns]
    utype, stype = users.schema["u"].dataType, items.schema["s"].dataType
    p = [f"p{n}" for n in flat]
    of_users = users.select("u", *[F.col(f"pu{n}").alias(f"p{n}") for n in flat])
    of_items = items.select("s", *[F.col(f"ps{n}").alias(f"p{n}") for n in flat])
    params = (grid.spread(of_users, "u").select("cell", F.lit(True).alias("of_user"), "u", _no_key(stype).alias("s"), *p)
              .unionByName(grid.spread(of_items, "s").select("cell", F.lit(False).alias("of_user"), _no_key(utype).alias("u"), "s", *p)))
    sums = [f"m{n}" for n in flat] + lls + ["wsum"]
    schema = T.StructType([T.StructField("side", T.StringType()), T.StructField("u", utype), T.StructField("s", stype),
                           *[T.StructField(c, T.DoubleType()) for c in sums], T.StructField("n", T.LongType())])

    def cell(pairs: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(pairs):
            return pd.DataFrame({f.name: [] for f in schema.fields})
        of_user = own["of_user"].to_numpy(bool)
        places = np.flatnonzero(of_user), np.flatnonzero(~of_user)
        of_u, of_s = (pd.Index(own[key].to_numpy()[at]) for key, at in zip("us", places))
        out = {c: np.zeros(len(own)) for c in [*sums, "n"]}
        values = {n: own[f"p{n}"].to_numpy() for n in flat}
        for lo in range(0, len(pairs), STEP_PAIRS):
            some = pairs.iloc[lo : lo + STEP_PAIRS]
            iu, js = places[0][of_u.get_indexer(some["u"])], places[1][of_s.get_indexer(some["s"])]

            def add(c, x):
                out[c] += np.bincount(iu, x, len(own))
                out[c] += np.bincount(js, x, len(own))

            weight = some[weight_col].to_numpy(np.float64) if weight_col else None
            for ns, ll in zip(names, lls):
                w = [values[n][iu] * values[n][js] for n in ns]
                evidence = w[0].copy()
                for x in w[1:]:
                    evidence += x
                np.maximum(evidence, EVIDENCE_FLOOR, out=evidence)
                for n, x in zip(ns, w):
                    x /= evidence
                    add(f"m{n}", x if weight is None else x * weight)
                lnev = np.log(evidence)
                add(ll, lnev if weight is None else lnev * weight)
            add("wsum", weight)
            add("n", None)
        if not weight_col:
            out["wsum"] = out["n"]
        out["n"] = out["n"].astype(np.int64)
        side = np.where(of_user, "u", "s").astype(object)
        held = out["n"] > 0
        return pd.DataFrame({"side": side[held], "u": own["u"].to_numpy()[held], "s": own["s"].to_numpy()[held],
                             **{c: out[c][held] for c in [*sums, "n"]}})

    return grid.df.groupBy("cell").cogroup(params.groupBy("cell")).applyInPandas(cell, schema)


def grid_first(grid: PairGrid, resp: DataFrame, columns: dict, lls: list[str], weight_col: str | None) -> DataFrame:
    """The first M-step over a grid: ``columns`` (name: sum of an expression over ``resp``, the grid's pairs)
    by user and by item, added up inside each cell before anything moves."""
    w = _w(weight_col)
    columns = {c: F.col(q) * w if w is not None else F.col(q) for c, q in columns.items()}
    columns["wsum"], columns["n"] = w if w is not None else F.lit(1.0), F.lit(1).cast("long")
    sides = None
    for key in "us":
        cells = resp.groupBy("cell", key).agg(*[F.sum(x).alias(c) for c, x in columns.items()])
        found = cells.groupBy(key).agg(*[F.sum(c).alias(c) for c in columns]).withColumn("side", F.lit(key))
        sides = found if sides is None else sides.unionByName(found, allowMissingColumns=True)
    none = [F.lit(None).cast("double").alias(ll) for ll in lls]
    return sides.select("side", "u", "s", *[c for c in columns if c not in ("wsum", "n")], *none, "wsum", "n")


# ---------------------------------------------------------------- fit


def prepare_pairs(pairs: DataFrame, weight_col: str | None = None, distinct: bool = False) -> DataFrame:
    """Write the distinct pairs once to the shared folder and read them back (weights of equal
    pairs add up; a pair given twice would otherwise count twice in every sum). ``distinct``: they are
    known to be distinct already, as both sides of a split are.

    Writing cuts the source lineage (the orders ⋈ lineitem join and the
    distinct) and makes a lost executor cost a re-read, not a recompute
    from the raw logs.
    """
    return _write_pairs(pairs, weight_col, distinct)[0]


def _write_pairs(pairs: DataFrame, weight_col: str | None, distinct: bool = False) -> tuple[DataFrame, str]:
    spark = pairs.sparkSession
    path = scratch_path(spark, "pairs")
    if weight_col:
        one_each = pairs.groupBy("u", "s").agg(F.sum(weight_col).alias(weight_col))
    else:
        one_each = pairs.select("u", "s") if distinct else pairs.select("u", "s").distinct()
    one_each.write.parquet(path)
    return spark.read.schema(one_each.schema).parquet(path), path


def prepare_layout(pairs: DataFrame, weight_col: str | None = None, prepared: bool = False) -> PairLayout:
    """Written pair table, reusable across several fits (k sweeps)."""
    written, path = (pairs, None) if prepared else _write_pairs(pairs, weight_col)
    return PairLayout(written, written.count(), path)


def _sizes(stats_users: int, stats_items: int, width: int, stats) -> tuple[int, int]:
    return (param_bytes(stats_users, width, stats.user_key_bytes), param_bytes(stats_items, width, stats.item_key_bytes))


def _grid_ahead(layout: PairLayout, widths: list[int], limit: int) -> PairGrid | PairStrips | None:
    """The grid if it is known before the first M-step that one is needed (so that this one goes by it too)."""
    if param_bytes(layout.n_pairs, sum(widths)) <= limit:  # no more users or items than pairs
        return None
    sizes = []
    for key in "us":
        r = layout.counts(key).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.col(key).cast("string"))).alias("b")).first()
        sizes.append((int(r["n"]), int(r["b"] or 0)))
    (nu, bu), (ns, bs) = sizes
    return _grid_of(layout, StateStats(nu, ns, [], None, 0.0, 0, bu, bs), widths, limit)


def _strips_of(layout: PairLayout, sizes: dict[str, int], cell_bytes: int, cell_pairs: int, width: int) -> PairStrips:
    P, n = layout.df, layout.n_pairs
    cores = int(P.sparkSession.sparkContext.defaultParallelism)
    hot_path = scratch_path(P.sparkSession, "pair-hot")
    hot = {key: _hot(layout.counts(key), key, max(1.0, HOT_SHARE * cell_pairs), hot_path) for key in ("u", "s")}
    least = min(CORE_CELLS * cores, max(cores, n // LEAST_PAIRS))
    return strip_pairs(P, n, {key: layout.counts(key) for key in "us"}, hot, hot_path, sizes, least, cell_bytes, cell_pairs, width)


def _grid_of(layout: PairLayout, stats: StateStats, widths: list[int], limit: int) -> PairGrid | PairStrips | None:
    """The layout's grid or strips if a parameter table of all models is over the broadcast limit, else
    None. Their blocks are sized for the widest model (see :func:`grid_aggregate`)."""
    together = _sizes(stats.n_users, stats.n_items, sum(widths), stats)
    if max(together) <= limit:
        return None
    if layout.grid is None:
        width = max(widths)
        user_bytes, item_bytes = _sizes(stats.n_users, stats.n_items, width, stats)
        spark = layout.df.sparkSession
        cell_bytes = int(spark.conf.get("spark.latentcf.cellBytes", str(CELL_BYTES)))
        cell_pairs = int(spark.conf.get("spark.latentcf.cellPairs", str(CELL_PAIRS)))
        if sum(together) > int(spark.conf.get("spark.latentcf.stripBytes", str(STRIP_BYTES))):
            layout.grid = _strips_of(layout, {"u": user_bytes, "s": item_bytes}, cell_bytes, cell_pairs, width)
        else:
            layout.grid = grid_pairs(layout.df, layout.n_pairs, user_bytes, item_bytes, cell_bytes, cell_pairs, width)
    return layout.grid


def _manifest(layout: PairLayout, k: int | list[int], seed: int, weight_col: str | None, alpha: float, eta: float,
              tol: float | None = None) -> str:
    """What a run directory was started with, the pair table included (an order-free hash). The tolerance
    is part of it only where models leave a joint state by it."""
    digest = layout.df.agg(F.sum(F.xxhash64(*layout.df.columns).cast("decimal(38,0)")).alias("h")).first()["h"]
    return json.dumps({"version": RUN_VERSION, "k": k, "seed": seed, "weight_col": weight_col, "alpha": alpha, "eta": eta,
                       "n_pairs": layout.n_pairs, "pairs": str(digest), **({"tol": tol} if isinstance(k, list) else {})},
                      sort_keys=True)


def _check_manifest(spark: SparkSession, run: str, wanted: str) -> None:
    """Write the manifest of a new run directory; refuse to resume under another one."""
    path = f"{run}/manifest"
    if committed(spark, path):
        found = spark.read.text(path).first()["value"]
        if found != wanted:
            raise ValueError(f"{run} belongs to another fit: it was started with {found}, now {wanted}")
    elif committed(spark, f"{run}/state-00000"):
        raise ValueError(f"{run} holds states without a manifest")
    else:
        spark.createDataFrame([(wanted,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def fit(
    pairs: "DataFrame | PairLayout",
    k: int = 3,
    max_iter: int = 30,
    seed: int = 42,
    tol: float | None = None,
    weight_col: str | None = None,
    broadcast_bytes: int | None = None,
    prepared: bool = False,
    run_dir: str | None = None,
    alpha: float = 0.0,
    eta: float = 0.0,
) -> LatentClassModel:
    """Fit p(z|u), p(s|z) by EM on (u, s[, weight]) pairs (made distinct unless ``prepared``).

    ``max_iter`` passes (E-step + log-likelihood each); with ``tol`` the loop
    stops once |loglik_t - loglik_{t-1}| < tol. The returned parameters are
    the ones the last trace row was computed with.

    With ``run_dir`` (a shared folder) the state after each pass is written to
    ``run_dir/state-<t>``; a fit started again with the same arguments and
    folder resumes after the last committed pass (a driver restart costs at
    most one pass). Restored passes have no timing in the trace. A folder
    started with other arguments or other pairs is refused (its manifest).
    """
    if k < 1 or max_iter < 1:
        raise ValueError("k and max_iter must be >= 1")
    own_layout = not isinstance(pairs, PairLayout)
    layout = prepare_layout(pairs, weight_col, prepared) if own_layout else pairs
    try:
        if layout.n_pairs == 0:
            raise ValueError("no (u, s) pairs to fit")
        return _fit(layout, k, max_iter, seed, tol, weight_col, broadcast_bytes, run_dir, alpha, eta)
    finally:
        if own_layout:  # nothing returned depends on it
            layout.drop()


def _fit(layout: PairLayout, k: int, max_iter: int, seed: int, tol: float | None, weight_col: str | None,
         broadcast_bytes: int | None, run_dir: str | None, alpha: float, eta: float) -> LatentClassModel:
    P = layout.df
    spark = P.sparkSession
    limit = broadcast_bytes if broadcast_bytes is not None else broadcast_limit(spark)
    run = run_dir.rstrip("/") if run_dir else None
    if run:
        _check_manifest(spark, run, _manifest(layout, k, seed, weight_col, alpha, eta))

    def state_path(t: int) -> str | None:
        return f"{run}/state-{t:05d}" if run else None

    logliks: list[float] = []
    seconds: list = []
    users = items = None
    first = 1
    if run and committed(spark, state_path(0)):
        last = 0
        while last + 1 < max_iter and committed(spark, state_path(last + 1)):
            last += 1
        logliks = [load_state(spark, state_path(t), k)[2].loglik for t in range(1, last + 1)]
        seconds = [None] * last
        first = last + 1
        done = tol is not None and len(logliks) > 1 and abs(logliks[-1] - logliks[-2]) < tol
        users, items, stats = load_state(spark, state_path(last - 1 if done else last), k, None, alpha, eta)
        if done:
            first = max_iter + 1
    elif isinstance(grid := _grid_ahead(layout, [k], limit), PairStrips):
        stats = write_state(spark, strips_drawn(grid, k, seed, ["ll"], weight_col), "em-init", k, state_path(0))[1]
    elif grid is not None:
        sums = grid_first(grid, initial_responsibilities(grid.df, k, seed), {f"m{z}": f"q{z}" for z in range(k)}, ["ll"], weight_col)
        users, items, stats = _settle(spark, sums, k, "em-init", state_path(0), alpha, eta)
    else:
        users, items, stats = m_step(spark, initial_responsibilities(P, k, seed), k, weight_col, "em-init",
                                     state_path(0), alpha, eta)
    grid = _grid_of(layout, stats, [k], limit)
    labels = [[str(z) for z in range(k)]]
    blocks = None
    if isinstance(grid, PairStrips) and first <= max_iter:
        blocks = grid.adopt(spark, stats.path) if users is not None else stats.path
    for t in range(first, max_iter + 1):
        t0 = time.time()
        nxt = None
        if blocks is not None:
            before = BlockState(blocks, labels, dict(zip(labels[0], stats.class_totals)), stats.n_items, alpha, eta)
            state = strips_aggregate(grid, before, [[0]], ["ll"], weight_col, "us" if t < max_iter else "u")
            resp = None
        elif grid is not None:
            state = grid_aggregate(grid, users, items, labels, ["ll"], weight_col)
            resp = None
        else:
            resp = responsibilities(P, F.broadcast(users), F.broadcast(items), k)
            state = m_aggregate(resp, k, weight_col)
        if t < max_iter:
            if blocks is not None:  # read by the tasks; as tables only when the fit is done
                nxt = None, None, write_state(spark, state, f"em-pass{t}", k, state_path(t))[1]
            else:
                nxt = _settle(spark, state, k, f"em-pass{t}", state_path(t), alpha, eta)
            ll = nxt[2].loglik
        else:
            ll = _last_loglik(resp, state, ["lnev"], ["ll"], weight_col)[0]
        logliks.append(ll)
        seconds.append(time.time() - t0)
        converged = (
            tol is not None and len(logliks) > 1 and ll is not None and logliks[-2] is not None
            and abs(ll - logliks[-2]) < tol
        )
        if converged or nxt is None:
            if nxt is not None and not run:
                remove_path(spark, nxt[2].path)
            break
        if not run:  # pass t is written: nothing reads pass t - 1 any more
            remove_path(spark, stats.path)
        users, items, stats = nxt
        blocks = stats.path if blocks is not None else None
    by_block = None
    if isinstance(grid, PairStrips) and blocks == stats.path:
        final = BlockState(stats.path, labels, dict(zip(labels[0], stats.class_totals)), stats.n_items, alpha, eta)
        by_block = final, grid.users.blocks, grid.items.blocks
    if users is None:
        users, items, _ = load_state(spark, stats.path, k, stats, alpha, eta)
    trace = spark.createDataFrame(
        [(i + 1, float(v) if v is not None and not math.isnan(v) else None, None if s is None else float(s))
         for i, (v, s) in enumerate(zip(logliks, seconds))],
        TRACE_SCHEMA,
    )
    return LatentClassModel(
        k=k, users=users, items=items, trace=trace, passes=len(logliks),
        n_users=stats.n_users, n_items=stats.n_items, logliks=logliks, seconds=seconds,
        user_key_bytes=stats.user_key_bytes, item_key_bytes=stats.item_key_bytes,
        state_path=None if run else stats.path, blocks=by_block,
    )


def _last_loglik(resp: DataFrame | None, state: DataFrame, lnevs: list[str], lls: list[str], weight_col: str | None) -> list:
    """Mean log-likelihoods of the last pass, without its M-step where the pairs are joined directly."""
    if resp is not None:
        w = _w(weight_col)
        r = resp.agg(*[F.sum(F.col(c) * w if w is not None else F.col(c)).alias(n) for c, n in zip(lnevs, lls)],
                     F.sum(w if w is not None else F.lit(1.0)).alias("ws")).first()
    else:
        r = state.where("side = 'u'").agg(*[F.sum(c).alias(c) for c in lls], F.sum("wsum").alias("ws")).first()
    return [(r[c] / r["ws"]) if r["ws"] else None for c in lls]


# ---------------------------------------------------------------- several k in one scan


def fit_many(
    pairs: "DataFrame | PairLayout",
    ks: list[int],
    max_iter: int = 30,
    seed: int = 42,
    weight_col: str | None = None,
    broadcast_bytes: int | None = None,
    prepared: bool = False,
    tol: float | None = None,
    run_dir: str | None = None,
) -> JointModels:
    """One EM fit per k, all advanced together: one scan and one aggregation per pass.

    Model j's columns ride side by side (``pu{j}_{z}``, ``ps{j}_{z}``,
    ``q{j}_{z}``); every model gets exactly the result of :func:`fit` with the
    same arguments (same keyed draws, same arithmetic). A k sweep of eight
    values over 30 passes reads the pair table 30 times instead of 240.

    With ``tol`` each model stops on its own: it leaves the joint state after its
    last pass, and the others go on without its columns. With ``run_dir`` the
    joint state of each pass stays there, and a fit started again resumes after
    the last committed pass, as in :func:`fit`.
    """
    ks = sorted({int(k) for k in ks})
    if not ks or ks[0] < 1 or max_iter < 1:
        raise ValueError("ks must be >= 1 and max_iter >= 1")
    own_layout = not isinstance(pairs, PairLayout)
    layout = prepare_layout(pairs, weight_col, prepared) if own_layout else pairs
    try:
        if layout.n_pairs == 0:
            raise ValueError("no (u, s) pairs to fit")
        return _fit_many(layout, ks, max_iter, seed, weight_col, broadcast_bytes, tol, run_dir)
    finally:
        if own_layout:
            layout.drop()


@dataclass
class _Member:
    """A model of a joint fit: its place ``j`` names its columns for as long as it takes part."""

    j: int
    k: int

    def cols(self, prefix: str) -> list[str]:
        return [f"{prefix}{self.j}_{z}" for z in range(self.k)]


def _all(members: list[_Member], prefix: str) -> list[str]:
    return [c for m in members for c in m.cols(prefix)]


def _many_aggregate(resp: DataFrame, members: list[_Member], weight_col: str | None, with_ll: bool) -> DataFrame:
    w = _w(weight_col)
    aggs = [F.sum(F.col(f"q{c[1:]}") * w if w is not None else F.col(f"q{c[1:]}")).alias(c) for c in _all(members, "m")]
    for m in members:
        ll = (F.col(f"lnev{m.j}") * w if w is not None else F.col(f"lnev{m.j}")) if with_ll else F.lit(None).cast("double")
        aggs.append(F.sum(ll).alias(f"ll{m.j}"))
    aggs += [F.sum(w if w is not None else F.lit(1.0)).alias("wsum"), F.count(F.lit(1)).alias("n")]
    g = resp.groupingSets([["u"], ["s"]], "u", "s").agg(F.grouping("s").alias("_gs"), *aggs)
    keep = _all(members, "m") + [f"ll{m.j}" for m in members] + ["wsum", "n"]
    return g.select(F.when(F.col("_gs") == 1, "u").otherwise("s").alias("side"), "u", "s", *keep)


def _many_metrics(members: list[_Member]) -> list:
    side_u, side_s = F.col("side") == "u", F.col("side") == "s"
    return ([F.sum(F.when(side_s, F.col(c))).alias(c) for c in _all(members, "m")]
            + [F.sum(F.when(side_u, F.col(f"ll{m.j}"))).alias(f"ll{m.j}") for m in members]
            + [F.sum(F.when(side_u, F.col("wsum"))).alias("wsum"),
               F.sum(F.when(side_u, 1).otherwise(0)).alias("nu"),
               F.sum(F.when(side_s, 1).otherwise(0)).alias("ns")] + _key_metrics())


@dataclass
class _JointState:
    """A written joint state: normalised tables of its members, their log-likelihoods, and sizes."""

    users: DataFrame
    items: DataFrame
    members: list[_Member]
    lls: dict[int, float | None]  # by place
    stats: StateStats
    totals: dict[str, float]  # by class label


def _joint_state(spark: SparkSession, path: str, members: list[_Member], r) -> _JointState:
    st = spark.read.parquet(path)
    counts = [m.cols("m") for m in members]
    users = _user_table(st.where("side = 'u'"), counts, [m.cols("pu") for m in members], 0.0)
    flat = _all(members, "m")
    items = _item_table(st.where("side = 's'"), flat, _all(members, "ps"), [r[c] for c in flat], 0, 0.0)
    wsum = float(r["wsum"] or 0.0)
    lls = {m.j: (r[f"ll{m.j}"] / wsum) if wsum and r[f"ll{m.j}"] is not None else None for m in members}
    stats = StateStats(int(r["nu"] or 0), int(r["ns"] or 0), [], None, wsum, 0, int(r["ku"] or 0), int(r["ks"] or 0), path)
    return _JointState(users, items, members, lls, stats, {c[1:]: float(r[c]) for c in flat})


def _many_step(spark: SparkSession, state: DataFrame, members: list[_Member], tag: str, path: str | None) -> _JointState:
    """Write the joint state; its scalars are observed in the same job."""
    path = path or scratch_path(spark, tag)
    obs = Observation(f"latentcf_{uuid.uuid4().hex[:8]}")
    state.observe(obs, *_many_metrics(members)).write.mode("overwrite").partitionBy(*_folders(state)).parquet(path)
    return _joint_state(spark, path, members, obs.get)


def _many_load(spark: SparkSession, path: str, members: list[_Member]) -> _JointState:
    return _joint_state(spark, path, members, spark.read.parquet(path).agg(*_many_metrics(members)).first())


def _many_responsibilities(P: DataFrame, U: DataFrame, S: DataFrame, members: list[_Member]) -> DataFrame:
    keep = P.columns
    joined = P.join(U, "u").join(S, "s")
    w = joined.select(*keep, *[(F.col(f"pu{c[1:]}") * F.col(f"ps{c[1:]}")).alias(c) for c in _all(members, "w")])
    ev = w.select("*", *[F.greatest(row_sum(m.cols("w")), F.lit(EVIDENCE_FLOOR)).alias(f"ev{m.j}") for m in members])
    return ev.select(*keep, *[(F.col(c) / F.col(f"ev{m.j}")).alias(f"q{c[1:]}") for m in members for c in m.cols("w")],
                     *[F.log(f"ev{m.j}").alias(f"lnev{m.j}") for m in members])


def _settled(trace: list, tol: float | None) -> bool:
    """Whether the last two log-likelihoods differ by less than ``tol``."""
    return tol is not None and len(trace) > 1 and None not in trace[-2:] and abs(trace[-1] - trace[-2]) < tol


def _fit_many(layout: PairLayout, ks: list[int], max_iter: int, seed: int, weight_col: str | None,
              broadcast_bytes: int | None, tol: float | None, run_dir: str | None) -> JointModels:
    P = layout.df
    spark = P.sparkSession
    limit = broadcast_bytes if broadcast_bytes is not None else broadcast_limit(spark)
    run = run_dir.rstrip("/") if run_dir else None
    if run:
        _check_manifest(spark, run, _manifest(layout, ks, seed, weight_col, 0.0, 0.0, tol))

    def state_path(t: int) -> str | None:
        return f"{run}/state-{t:05d}" if run else None

    active = [_Member(j, k) for j, k in enumerate(ks)]
    traces: dict[int, list] = {m.j: [] for m in active}
    seconds: list = []
    final: dict[int, _JointState] = {}  # the state whose parameters a stopped model has

    def advance(before: _JointState, lls: dict[int, float | None], last: bool) -> list[_Member]:
        """Notes a pass; the members that go on."""
        on = []
        for m in before.members:
            traces[m.j].append(lls[m.j])
            if last or _settled(traces[m.j], tol):
                final[m.j] = before
            else:
                on.append(m)
        return on

    t = 1
    if resumed := bool(run and committed(spark, state_path(0))):
        state = _many_load(spark, state_path(0), active)
        while t < max_iter and active and committed(spark, state_path(t)):
            after = _many_load(spark, state_path(t), active)
            active = advance(state, after.lls, False)
            seconds.append(None)
            state, t = _joint_state_of(after, active), t + 1
    else:
        # shared initialisation: draw z depends on (u, s, z, seed) only, so every model reuses it
        draws = [keyed_unit_open(F.col("u"), F.col("s"), F.lit(z), F.lit(seed)) for z in range(max(ks))]
        grid = _grid_ahead(layout, [m.k for m in active], limit)
        if isinstance(grid, PairStrips):
            drawn = strips_drawn(grid, max(ks), seed, [f"ll{m.j}" for m in active], weight_col)
            sums = drawn.select("side", "block", "u", "s", *[F.col(f"m{z}").alias(c) for m in active for z, c in enumerate(m.cols("m"))],
                                *[f"ll{m.j}" for m in active], "wsum", "n")
        elif grid is not None:  # each draw is summed once, and stands in the columns of all models
            init = grid.df.select("*", *[x.alias(f"q{z}") for z, x in enumerate(draws)])
            drawn = grid_first(grid, init, {f"m{z}": f"q{z}" for z in range(max(ks))}, [f"ll{m.j}" for m in active], weight_col)
            sums = drawn.select("side", "u", "s", *[F.col(f"m{z}").alias(c) for m in active for z, c in enumerate(m.cols("m"))],
                                *[f"ll{m.j}" for m in active], "wsum", "n")
        else:
            init = P.select("*", *[draws[z].alias(c) for m in active for z, c in enumerate(m.cols("q"))])
            sums = _many_aggregate(init, active, weight_col, False)
        state = _many_step(spark, sums, active, "em-many-init", state_path(0))
    grid = _grid_of(layout, state.stats, [m.k for m in active], limit) if active else None
    blocks = None
    if isinstance(grid, PairStrips):
        blocks = grid.adopt(spark, state.stats.path) if resumed else state.stats.path
    while active:
        t0 = time.time()
        names = [f"ll{m.j}" for m in active]
        labels = [[c[1:] for c in m.cols("m")] for m in active]
        if blocks is not None:
            before = BlockState(blocks, labels, state.totals, state.stats.n_items)
            groups = _bins([m.k for m in active], grid.width)
            resp, sums = None, strips_aggregate(grid, before, groups, names, weight_col, "us" if t < max_iter else "u")
        elif grid is not None:
            resp, sums = None, grid_aggregate(grid, state.users, state.items, labels, names, weight_col)
        else:
            resp = _many_responsibilities(P, F.broadcast(state.users), F.broadcast(state.items), active)
            sums = _many_aggregate(resp, active, weight_col, True)
        if t < max_iter:
            after = _many_step(spark, sums, active, f"em-many{t}", state_path(t))
            active = advance(state, after.lls, False)
        else:
            after, found = None, _last_loglik(resp, sums, [f"lnev{m.j}" for m in active], names, weight_col)
            active = advance(state, dict(zip((m.j for m in active), found)), True)
        seconds.append(time.time() - t0)
        if not run:  # nothing reads a pass's state any more once the next is written, but models that stopped there
            kept = {id(s) for s in final.values()}
            for s in (state, None if active else after):
                if s is not None and id(s) not in kept:
                    remove_path(spark, s.stats.path)
        if after is not None and active:
            if len(active) < len(after.members):  # those that stopped leave the state
                after = _joint_state_of(after, active)
            state = after
            blocks = state.stats.path if blocks is not None else None
        t += 1
    models = _joint_models(spark, ks, traces, seconds, final, None if run else [s.stats.path for s in final.values()])
    if isinstance(grid, PairStrips) and all(s is state for s in final.values()) and blocks == state.stats.path:
        names = [[c[1:] for c in _Member(j, k).cols("m")] for j, k in enumerate(ks)]
        models.blocks = BlockState(blocks, names, state.totals, state.stats.n_items), grid.users.blocks, grid.items.blocks
    return models


def _joint_state_of(state: _JointState, members: list[_Member]) -> _JointState:
    return _JointState(state.users.select("u", *_all(members, "pu")), state.items.select("s", *_all(members, "ps")), members,
                       {m.j: state.lls[m.j] for m in members}, state.stats, state.totals)


def _joint_models(spark: SparkSession, ks: list[int], traces: dict[int, list], seconds: list, final: dict[int, _JointState],
                  paths: list[str] | None) -> JointModels:
    models = {}
    for j, k in enumerate(ks):
        m, state = _Member(j, k), final[j]
        trace = spark.createDataFrame(
            [(i + 1, float(v) if v is not None and not math.isnan(v) else None, None if x is None else float(x))
             for i, (v, x) in enumerate(zip(traces[j], seconds))], TRACE_SCHEMA)
        models[k] = LatentClassModel(
            k=k,
            users=state.users.select("u", *[F.col(c).alias(f"pu{z}") for z, c in enumerate(m.cols("pu"))]),
            items=state.items.select("s", *[F.col(c).alias(f"ps{z}") for z, c in enumerate(m.cols("ps"))]),
            trace=trace, passes=len(traces[j]), n_users=state.stats.n_users, n_items=state.stats.n_items, logliks=traces[j],
            seconds=seconds[: len(traces[j])], user_key_bytes=state.stats.user_key_bytes,
            item_key_bytes=state.stats.item_key_bytes)
    states = {id(s): s for s in final.values()}
    users = items = None
    for s in states.values():  # models that stopped at the same pass share a state
        own = [_Member(j, k) for j, k in enumerate(ks) if final[j] is s]
        u, i = s.users.select("u", *_all(own, "pu")), s.items.select("s", *_all(own, "ps"))
        users, items = (u, i) if users is None else (users.join(u, "u"), items.join(i, "s"))
    order = [_Member(j, k) for j, k in enumerate(ks)]
    return JointModels(models, users.select("u", *_all(order, "pu")), items.select("s", *_all(order, "ps")), paths)
