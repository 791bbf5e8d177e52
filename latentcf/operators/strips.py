"""EM passes over tables too large for the grid: nothing moves but the keys that are hot.

The pairs are written twice, once in strips of users and once in strips of items, each a table
bucketed by strip, whose files the tasks read themselves. The state of a pass is written in blocks of users and of items. The task of a
strip holds its own rows, reads the blocks of the other side one at a time from the shared folder
and so has the whole sums of its rows: it writes the block of the next state. The evidence of a
pair is computed on both sides; in return no parameter is copied to a cell and no partial sum
comes back from one. What a pass writes is the state, whatever the number of strips.

Pairs of hot users (items) are dealt over strips of their own, and only their sums are added up
by a shuffle. Strips hold a bounded number of pairs and a bounded block, so a task is bounded
whatever the tables' size.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass, field
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latentcf.functions.hashing import unit_open_draws
from latentcf.functions.numeric import EVIDENCE_FLOOR
from latentcf.session import note_table, remove_path, scratch_path

# Pairs of a strip worked through at a time: their rows of parameters stay in the processor's cache.
STEP_PAIRS = 32_768


def block_of(key: str, n: int):
    """The block of a user ('u') or item ('s') among ``n``."""
    return F.pmod(F.xxhash64(key, F.lit("item")) if key == "s" else F.xxhash64(key), F.lit(n)).cast("int")


def _uri(path: str) -> str:
    return "file://" + path[len("file:") :] if path.startswith("file:/") and not path.startswith("file://") else path


# ---------------------------------------------------------------- states by block


@dataclass
class BlockState:
    """A written state by block, and what turns its counts into probabilities: counts + alpha over
    the user's total, and counts + eta over the class total."""

    path: str
    names: list[list[str]]  # class labels of each model: columns m<label>
    totals: dict[str, float]
    n_items: int
    alpha: float = 0.0
    eta: float = 0.0

    def read(self, side: str, blocks, labels: list[list[str]] | None = None) -> tuple[pd.Index, np.ndarray]:
        """Keys of some blocks, and their probabilities: a row each, the models' classes side by side."""
        import pyarrow as pa
        from pyarrow import fs, parquet

        labels = self.names if labels is None else labels
        flat = [f"m{n}" for ns in labels for n in ns]
        files, root = fs.FileSystem.from_uri(_uri(self.path))
        found = []
        for b in blocks:
            folder = fs.FileSelector(f"{root.rstrip('/')}/side={side}/block={int(b)}", allow_not_found=True)
            for f in files.get_file_info(folder):
                if f.base_name.endswith(".parquet"):
                    with files.open_input_file(f.path) as source:
                        found.append(parquet.ParquetFile(source).read(columns=[side, *flat], use_threads=False))
        if not found:
            return pd.Index([]), np.zeros((0, len(flat)))
        rows = pa.concat_tables(found)
        values = np.empty((rows.num_rows, len(flat)))
        for i, c in enumerate(flat):
            values[:, i] = rows[c].to_numpy()
        at = 0
        for ns in labels:
            own = values[:, at : at + len(ns)]
            at += len(ns)
            if side == "u":
                own += self.alpha
                total = own[:, 0].copy()
                for z in range(1, len(ns)):
                    total += own[:, z]
                own /= total[:, None]
            else:
                own += self.eta
                for z, n in enumerate(ns):  # a class whose mass underflowed to 0 is dead
                    total = self.totals[n] + self.n_items * self.eta
                    own[:, z] = own[:, z] / total if total else 0.0
        return pd.Index(rows[side].to_pandas()), values


# ---------------------------------------------------------------- layout


@dataclass
class Strips:
    """The pairs by user (``key`` 'u') or by item ('s'): strip, own and other block, u, s, [w]."""

    key: str
    df: DataFrame
    blocks: int  # strips from here on hold hot keys
    has_hot: bool
    table: str
    path: str
    # the files of each strip, where its task reads them itself (whole and text keys)
    files: dict[int, list[str]] | None = None

    @property
    def cold(self) -> DataFrame:
        return self.df.where(F.col("strip") < F.lit(self.blocks)) if self.has_hot else self.df


@dataclass
class PairStrips:
    users: Strips
    items: Strips
    width: int | None = None  # class columns the blocks are sized for
    hot_path: str | None = None
    adopted: list[str] = field(default_factory=list)

    @property
    def df(self) -> DataFrame:
        return self.users.df

    def block(self, side: str):
        return block_of(side, (self.users if side == "u" else self.items).blocks)

    def adopt(self, spark: SparkSession, path: str) -> str:
        """A state as of a resumed run, written again in these blocks."""
        state, to = spark.read.parquet(path).drop("block"), scratch_path(spark, "em-adopted")
        block = F.when(F.col("side") == "u", self.block("u")).otherwise(self.block("s"))
        state.withColumn("block", block).repartition("side", "block").write.partitionBy("side", "block").parquet(to)
        self.adopted.append(to)
        return to

    def drop(self) -> None:
        spark = self.df.sparkSession
        for side in (self.users, self.items):
            spark.sql(f"DROP TABLE IF EXISTS {side.table}")
            remove_path(spark, side.path)
        for path in (self.hot_path, *self.adopted):
            remove_path(spark, path)


def plain_keys(df: DataFrame) -> bool:
    """Whether users and items are whole numbers or text: the same values to Spark and to pyarrow."""
    return all(isinstance(df.schema[c].dataType, (T.IntegralType, T.StringType)) for c in "us")


def _read_strip(files: list[str], strip: int, columns: list[str]) -> pd.DataFrame:
    """The pairs of a strip, from its bucket's files (a bucket may hold several strips)."""
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyarrow import fs, parquet

    found = []
    for name in files:
        system, path = fs.FileSystem.from_uri(_uri(name))
        with system.open_input_file(path) as source:
            f = parquet.ParquetFile(source)
            at = f.schema_arrow.names.index("strip")
            for g in range(f.num_row_groups):
                ends = f.metadata.row_group(g).column(at).statistics
                if ends is None or not ends.has_min_max or ends.min <= strip <= ends.max:
                    rows = f.read_row_group(g, columns=["strip", *columns], use_threads=False)
                    found.append(rows.filter(pc.equal(rows["strip"], strip)).drop_columns("strip"))
    return pa.concat_tables(found).to_pandas(self_destruct=True)


def _by_strip(side: Strips, hot: bool, run, schema: T.StructType, weight_col: str | None) -> DataFrame:
    """``run(pairs)`` of every strip of one kind, a task each."""
    if side.files is None:
        of_hot = F.col("strip") >= F.lit(side.blocks)
        return (side.df.where(of_hot) if hot else side.cold).groupBy("strip").applyInPandas(run, schema)
    files = [(n, side.files[n]) for n in sorted(side.files) if (n >= side.blocks) == hot]
    columns = ["own", "block", "u", "s", *([weight_col] if weight_col else [])]

    def tasks(it):
        for pdf in it:
            for n in pdf["id"]:
                strip, names = files[n]
                yield run(_read_strip(names, strip, columns))

    return side.df.sparkSession.range(0, len(files), 1, max(1, len(files))).mapInPandas(tasks, schema)


def _cut(keys: DataFrame, key: str, blocks: int, cell_pairs: int) -> int:
    """``blocks``, or more until none of them holds more than ``cell_pairs`` pairs (a key's pairs stay
    together); ``keys`` has the count of each."""
    while True:
        r = keys.groupBy(block_of(key, blocks)).agg(F.sum("count").alias("n"), F.max("count").alias("one")).agg(F.max("n"), F.max("one")).first()
        if (r[0] or 0) <= max(cell_pairs, r[1] or 0):
            return blocks
        blocks = math.ceil(1.5 * blocks)


def strip_pairs(P: DataFrame, n_pairs: int, counts: dict[str, DataFrame], hot: dict[str, DataFrame | None], hot_path: str, sizes: dict[str, int], least: int,
                cell_bytes: int, cell_pairs: int, width: int) -> PairStrips:
    """Write ``P`` by user and by item; ``counts`` are the pairs of each key, ``sizes`` the bytes of the
    parameter tables, ``hot`` the keys whose pairs part, ``least`` the number of strips for the cores."""
    spark = P.sparkSession
    marked = P
    for key, keys in hot.items():
        marked = (marked.join(F.broadcast(keys.withColumn(f"_hot_{key}", F.lit(True))), key, "left") if keys is not None
                  else marked.withColumn(f"_hot_{key}", F.lit(None).cast("boolean")))
    blocks = {}
    for key in "us":
        first = max(least, math.ceil(sizes[key] / cell_bytes), math.ceil(n_pairs / cell_pairs))
        cold = counts[key] if hot[key] is None else counts[key].join(F.broadcast(hot[key]), key, "left_anti")
        blocks[key] = _cut(cold, key, first, cell_pairs)
    made = {}
    for key, other in ("us", "su"):
        own, strip, many = block_of(key, blocks[key]), block_of(key, blocks[key]), blocks[key]
        if hot[key] is not None:
            n_hot = counts[key].join(F.broadcast(hot[key]), key, "left_semi").agg(F.sum("count")).first()[0]
            parts = max(1, math.ceil(2 * n_hot / cell_pairs))
            strip = F.when(F.col(f"_hot_{key}"), F.lit(blocks[key]) + F.pmod(F.xxhash64("u", "s", F.lit("hot")), F.lit(parts)).cast("int")).otherwise(own)
            many += parts
        # strips are dealt to buckets by hash: with more of them fewer share one
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * many)
        buckets = min(buckets, int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")))
        path, name = scratch_path(spark, "pair-strips"), f"latentcf_strips_{uuid.uuid4().hex[:12]}"
        (marked.select(strip.alias("strip"), own.alias("own"), block_of(other, blocks[other]).alias("block"), *P.columns)
         .repartition(buckets, "strip").write.bucketBy(buckets, "strip").sortBy("strip", "block", key)
         .option("path", path).saveAsTable(name))
        note_table(name)
        df, files = spark.table(name), None
        if plain_keys(df):
            files = {}
            for r in df.select("strip", F.input_file_name().alias("file")).distinct().collect():  # one row a strip
                files.setdefault(r["strip"], []).append(r["file"])
        made[key] = Strips(key, df, blocks[key], hot[key] is not None, name, path, files)
    return PairStrips(made["u"], made["s"], width, hot_path)


# ---------------------------------------------------------------- a pass


def _chunks(block: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(block, from, to): runs of equal numbers, of at most STEP_PAIRS."""
    ends = np.flatnonzero(np.diff(block)) + 1
    for lo, hi in zip([0, *ends], [*ends, len(block)]):
        for at in range(lo, hi, STEP_PAIRS):
            yield int(block[lo]), at, min(hi, at + STEP_PAIRS)


def _strip_sums(side: Strips, state: BlockState, groups: list[list[int]], lls: list[str], weight_col: str | None):
    """The function of a strip: the sums of its keys."""
    key, other = side.key, "s" if side.key == "u" else "u"
    names = state.names

    def run(pairs: pd.DataFrame) -> pd.DataFrame:
        block = pairs["block"].to_numpy()
        if (np.diff(block) < 0).any():
            pairs = pairs.iloc[np.argsort(block, kind="stable")]
            block = pairs["block"].to_numpy()
        codes, uniq = pd.factorize(pairs[key], sort=True)  # so that pairs worked through together have near codes
        of_block = pairs["own"].to_numpy()
        home = np.empty(len(uniq), dtype=np.int32)
        home[codes] = of_block
        others = pairs[other].to_numpy()
        weight = pairs[weight_col].to_numpy(np.float64) if weight_col else None
        out = {key: uniq, "block": home}
        for group in groups:
            labels = [names[j] for j in group]
            keys, values = state.read(key, np.unique(home), labels)
            own = values[keys.get_indexer(uniq)]
            sums = np.zeros((own.shape[1], len(uniq)))
            traces = np.zeros((len(group), len(uniq)))
            at, index, theirs = None, None, None
            for b, lo, hi in _chunks(block):
                if b != at:
                    index, theirs = state.read(other, [b], labels)
                    at = b
                i, j = codes[lo:hi], index.get_indexer(others[lo:hi])
                start, end = int(i.min()), int(i.max()) + 1
                near = i - start
                w = own[i] * theirs[j]
                first = 0
                for g, ns in enumerate(labels):
                    q = w[:, first : first + len(ns)]
                    evidence = q[:, 0].copy()
                    for z in range(1, len(ns)):
                        evidence += q[:, z]
                    np.maximum(evidence, EVIDENCE_FLOOR, out=evidence)
                    q /= evidence[:, None]
                    if key == "u":  # the log-likelihood is added up by user
                        lnev = np.log(evidence)
                        traces[g, start:end] += np.bincount(near, lnev if weight is None else lnev * weight[lo:hi], end - start)
                    first += len(ns)
                if weight is not None:
                    w *= weight[lo:hi, None]
                for z, x in enumerate(np.ascontiguousarray(w.T)):
                    sums[z, start:end] += np.bincount(near, x, end - start)
            for n, x in zip([n for ns in labels for n in ns], sums):
                out[f"m{n}"] = x
            for j, x in zip(group, traces):
                out[lls[j]] = x if key == "u" else np.full(len(uniq), np.nan)
        out["n"] = np.bincount(codes, None, len(uniq)).astype(np.int64)
        out["wsum"] = out["n"].astype(np.float64) if weight is None else np.bincount(codes, weight, len(uniq))
        return pd.DataFrame(out)

    return run


def _both_sides(strips: PairStrips, sums_of, columns: list[str], sides: str = "us") -> DataFrame:
    """The rows of a state: ``sums_of(side, hot)`` of the cold strips as they are, of the hot ones added up by key."""
    state = None
    for side in (strips.users, strips.items):
        if side.key not in sides:
            continue
        found = [sums_of(side, False)]
        if side.has_hot:
            part = sums_of(side, True)
            found.append(part.groupBy(side.key, "block").agg(*[F.sum(c).alias(c) for c in columns]))
        for rows in found:
            rows = rows.withColumn("side", F.lit(side.key))
            state = rows if state is None else state.unionByName(rows, allowMissingColumns=True)
    for c in "us":
        if c not in state.columns:
            state = state.withColumn(c, F.lit(None).cast(strips.df.schema[c].dataType))
    return state.select("side", "block", "u", "s", *columns)


def strips_aggregate(strips: PairStrips, state: BlockState, groups: list[list[int]], lls: list[str], weight_col: str | None,
                     sides: str = "us") -> DataFrame:
    """The pass from ``state``: the rows of the next one, with their block. The models go through the
    other side's blocks in ``groups`` no wider than these are sized for."""
    sums = [f"m{n}" for ns in state.names for n in ns] + lls
    columns = [*sums, "wsum", "n"]

    def sums_of(side: Strips, hot: bool) -> DataFrame:
        schema = T.StructType([T.StructField(side.key, side.df.schema[side.key].dataType), T.StructField("block", T.IntegerType()),
                               *[T.StructField(c, T.DoubleType()) for c in [*sums, "wsum"]], T.StructField("n", T.LongType())])
        return _by_strip(side, hot, _strip_sums(side, state, groups, lls, weight_col), schema, weight_col)

    return _both_sides(strips, sums_of, columns, sides)


def strips_first(strips: PairStrips, columns: dict, lls: list[str], weight_col: str | None) -> DataFrame:
    """The first M-step: ``columns`` (name: expression over the pairs) by user and by item, added up inside the strips."""
    w = F.col(weight_col).cast("double") if weight_col else None
    columns = {c: q * w if w is not None else q for c, q in columns.items()}
    columns["wsum"], columns["n"] = w if w is not None else F.lit(1.0), F.lit(1).cast("long")

    def sums_of(side: Strips, hot: bool) -> DataFrame:
        pairs = side.df.where(F.col("strip") >= F.lit(side.blocks)) if hot else side.cold
        return (pairs.groupBy("strip", side.key).agg(F.first("own").alias("block"), *[F.sum(x).alias(c) for c, x in columns.items()])
                .drop("strip"))

    state = _both_sides(strips, sums_of, list(columns))
    none = [F.lit(None).cast("double").alias(ll) for ll in lls]
    return state.select("side", "block", "u", "s", *[c for c in columns if c not in ("wsum", "n")], *none, "wsum", "n")


def strips_drawn(strips: PairStrips, k: int, seed: int, lls: list[str], weight_col: str | None) -> DataFrame:
    """The first M-step with the keyed draws of ``k`` classes (columns m0, m1, ...). Whole and text keys are
    hashed many pairs at a time inside the tasks, others as :func:`strips_first` does."""
    if not plain_keys(strips.df):
        from latentcf.functions.hashing import keyed_unit_open

        draws = {f"m{z}": keyed_unit_open(F.col("u"), F.col("s"), F.lit(z), F.lit(seed)) for z in range(k)}
        return strips_first(strips, draws, lls, weight_col)
    names = [f"m{z}" for z in range(k)]

    def sums_of(side: Strips, hot: bool) -> DataFrame:
        key = side.key

        def run(some: pd.DataFrame) -> pd.DataFrame:
            (i, left), (j, right) = (pd.factorize(some[c], sort=c == key) for c in "us")
            own, uniq = (i, left) if key == "u" else (j, right)
            home = np.empty(len(uniq), dtype=np.int32)
            home[own] = some["own"].to_numpy()
            weight = some[weight_col].to_numpy(np.float64) if weight_col else None
            out = {key: uniq, "block": home, **{n: np.zeros(len(uniq)) for n in names}}
            for rows, draws in unit_open_draws(left, i, right, j, list(range(k)), seed):
                at = own[rows]
                first, last = at.min(), at.max() + 1  # pairs of a key lie near each other
                for n, x in zip(names, draws):
                    out[n][first:last] += np.bincount(at - first, x if weight is None else x * weight[rows], last - first)
            out["n"] = np.bincount(own, None, len(uniq)).astype(np.int64)
            out["wsum"] = out["n"].astype(np.float64) if weight is None else np.bincount(own, weight, len(uniq))
            return pd.DataFrame(out)

        schema = T.StructType([T.StructField(key, side.df.schema[key].dataType), T.StructField("block", T.IntegerType()),
                               *[T.StructField(n, T.DoubleType()) for n in names], T.StructField("n", T.LongType()),
                               T.StructField("wsum", T.DoubleType())])
        return _by_strip(side, hot, run, schema, weight_col)

    state = _both_sides(strips, sums_of, [*names, "wsum", "n"])
    none = [F.lit(None).cast("double").alias(ll) for ll in lls]
    return state.select("side", "block", "u", "s", *names, *none, "wsum", "n")
