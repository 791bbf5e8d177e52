"""Passes by strips: the same fits as by broadcast, and no parameter or pair moved in a pass."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from latentcf.operators import em, strips
from tests.test_em import even_and_hot
from tests.test_plans import _plan, _tree


@pytest.fixture()
def by_strips(spark):
    confs = {"spark.latentcf.stripBytes": "0", "spark.latentcf.cellPairs": "8000"}
    for c, v in confs.items():
        spark.conf.set(c, v)
    yield
    for c in confs:
        spark.conf.unset(c)


def same(a, b, tol=1e-12):
    assert a.logliks == pytest.approx(b.logliks, abs=1e-10)
    for side, key in (("users", "u"), ("items", "s")):
        x, y = (getattr(m, side).orderBy(key).collect() for m in (a, b))
        assert [r[key] for r in x] == [r[key] for r in y]
        assert abs(np.array([r[1:] for r in x]) - np.array([r[1:] for r in y])).max() < tol


@pytest.mark.parametrize("hot, weighted", [(0, False), (4000, False), (4000, True)])
def test_strips_fit_like_the_broadcast_path(spark, by_strips, hot, weighted):
    pairs = even_and_hot(spark, hot)
    if weighted:
        pairs = pairs.withColumn("w", (F.col("s") % 3 + 1).cast("long"))
    args = dict(k=4, max_iter=4, weight_col="w" if weighted else None, alpha=2.0, eta=0.1)
    layout = em.prepare_layout(pairs, args["weight_col"])
    a, b = em.fit(pairs, **args), em.fit(layout, broadcast_bytes=0, **args)
    assert isinstance(layout.grid, strips.PairStrips) and layout.grid.users.has_hot == bool(hot)
    for side in (layout.grid.users, layout.grid.items):
        assert side.df.count() == layout.n_pairs
        assert side.df.groupBy("strip").count().agg(F.max("count")).first()[0] <= 8000
    layout.drop()
    same(a, b)


def test_joint_fit_by_strips_with_text_keys_and_own_stops(spark, by_strips):
    pairs = even_and_hot(spark, 0).select(F.concat(F.lit("ü"), F.col("u")).alias("u"), "s").where("s % 3 = 0")
    a, b = (em.fit_many(pairs, [1, 2, 3, 5], max_iter=5, tol=2e-4, broadcast_bytes=n) for n in (None, 0))
    for k in a:
        assert a[k].passes == b[k].passes
        same(a[k], b[k])


def test_fits_by_strips_resume_with_other_blocks(spark, by_strips, tmp_path, monkeypatch):
    pairs = even_and_hot(spark, 4000)
    whole = em.fit(pairs, k=2, max_iter=5)
    joint = em.fit_many(pairs, [2, 3], max_iter=4)
    em.fit(pairs, k=2, max_iter=2, broadcast_bytes=0, run_dir=f"{tmp_path}/one")
    em.fit_many(pairs, [2, 3], max_iter=2, broadcast_bytes=0, run_dir=f"{tmp_path}/many")
    monkeypatch.setattr(em, "CORE_CELLS", 7)
    spark.conf.set("spark.latentcf.cellPairs", "6000")
    same(em.fit(pairs, k=2, max_iter=5, broadcast_bytes=0, run_dir=f"{tmp_path}/one"), whole)
    again = em.fit_many(pairs, [2, 3], max_iter=4, broadcast_bytes=0, run_dir=f"{tmp_path}/many")
    for k in joint:
        same(again[k], joint[k])


def test_pass_by_strips_moves_nothing(spark, by_strips):
    layout = em.prepare_layout(even_and_hot(spark, 0))
    grid = em._grid_ahead(layout, [3], 0)
    names = [["0", "1", "2"]]
    first = strips.strips_first(grid, {f"m{z}": F.col("s") + F.lit(float(z)) for z in range(3)}, ["ll"], None)
    state = strips.strips_aggregate(grid, strips.BlockState("file:/none", names, dict.fromkeys("012", 1.0), 1), [[0]], ["ll"], None)
    for df in (first, state):
        assert not any("Exchange" in x for x in _tree(_plan(df)))
    layout.drop()


def test_large_tables_go_by_strips():
    """60 times sf0.1 with ten classes: over 150 MB of parameters, copied to 6 and 8 blocks by the grid."""
    assert em.param_bytes(900_000, 10) + em.param_bytes(1_200_000, 10) > em.STRIP_BYTES


def test_pairs_are_scored_by_block(spark, by_strips):
    from latentcf.operators import scoring

    pairs = even_and_hot(spark, 4000)
    m = em.fit(pairs, k=3, max_iter=2, broadcast_bytes=0, alpha=1.0, eta=0.1)
    some = pairs.where("s % 2 = 0").union(spark.createDataFrame([(10**9, 1), (1, 10**9)], "u long, s long"))
    df = scoring.score_pairs(m, some, broadcast_bytes=0)
    assert not any("Join" in x for x in _tree(_plan(df)))
    want = scoring.score_pairs(m, some, broadcast_bytes=1 << 30)
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("n, with_seen", [(1, False), (5, True)])
def test_best_items_of_even_classes_by_groups(monkeypatch, n, with_seen):
    """Classes that differ little: few cells are scored, and the best are those of brute force."""
    from latentcf.operators import scoring

    rng = np.random.default_rng(5)
    a, b = rng.gamma(30, 1, (700, 6)), np.round(rng.gamma(8, 1, (20_000, 1)) * rng.gamma(40, 1, (20_000, 6)), 1)
    a, b = a / a.sum(axis=1, keepdims=True), b / b.sum(axis=0)
    seen = [np.unique(rng.integers(0, 20_000, 30)) if with_seen and i % 3 == 0 else None for i in range(700)]
    scored, blocks = [], scoring.block_scores
    monkeypatch.setattr(scoring, "block_scores", lambda x, y: scored.append(len(x) * len(y)) or blocks(x, y))
    monkeypatch.setattr(scoring, "LIST_ROUNDS", 1)
    r, c, v, k = scoring.top_n_exact(a, np.arange(20_000), b, np.argsort(-b, axis=0, kind="stable"), seen, n)
    full = blocks(a, b)
    for i, s in enumerate(seen):
        if s is not None:
            full[i, s] = -np.inf
    best = np.lexsort((np.broadcast_to(np.arange(20_000), full.shape), -full), axis=1)[:, :n]
    assert sum(scored) < full.size / 4
    order = np.lexsort((k, r))
    assert (c[order].reshape(700, n) == best).all()
    assert (v[order].reshape(700, n) == np.take_along_axis(full, best, axis=1)).all()


def test_joint_models_are_scored_and_counted_by_block(spark, by_strips):
    """No class column is in the plan of the counts: those of five wide models did not fit a small driver."""
    from latentcf.operators import evaluation, scoring

    pairs = even_and_hot(spark, 0)
    train, test = pairs.where("(u + s) % 7 > 0"), pairs.where("(u + s) % 7 = 0")
    ths = [2e-2, 4e-3, 3e-3]
    want, got = (em.fit_many(train, [2, 3, 5], max_iter=2, broadcast_bytes=n) for n in (1 << 30, 0))
    assert want.blocks is None and got.blocks is not None
    one, other = (evaluation.confusion(m, train, test, ths, broadcast_bytes=n) for m, n in ((want, 1 << 30), (got, 4000)))
    assert [tuple(r) for r in other.collect()] == [tuple(r) for r in one.collect()]
    for df in (other, scoring.score_pairs(got, test, broadcast_bytes=0)):
        plan = df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
        assert "pu0_0" not in plan and "m0_0" not in plan


@pytest.mark.parametrize("inclusive", [True, False])
def test_counts_in_single_precision_are_exact(inclusive):
    """Thresholds that are scores, or a rounding off them, with rows left over in the last groups."""
    from latentcf.operators import scoring

    rng = np.random.default_rng(11)
    hit = np.greater_equal if inclusive else np.greater
    for n, m, k, scale in ((700, 333, 20, 1e-7), (65, 129, 3, 1e-3), (1, 1, 1, 1.0), (130, 70, 4, 1e-36)):
        a, b = rng.random((n, k)), scale * rng.random((m, k))
        a /= a.sum(axis=1, keepdims=True)
        full = scoring.block_scores(a, b)
        some = rng.choice(full.ravel(), 3)
        ths = [0.0, *some, *np.nextafter(some, 1), float(full.mean())]
        assert (scoring.reaching(a, b, ths, inclusive) == np.stack([hit(full, t).sum(axis=1) for t in ths], axis=1)).all()
        rough = scoring._Rough(a, b, 64, np.array(ths[1:]))
        x = rough.scores(*(i.ravel() for i in np.indices((-(-n // 64), -(-m // 64)))))
        # cells in single precision: most are decided by it
        assert x.dtype == np.float32 and (rough.near.all() or (rough.high >= rough.low).all())


@pytest.mark.parametrize("text", [False, True])
def test_best_items_by_block(spark, by_strips, monkeypatch, text):
    """The state is read by block: neither users nor items are copied to tiles, only seen pairs move."""
    from latentcf.operators import scoring

    pairs = even_and_hot(spark, 4000)
    if text:
        pairs = pairs.select("u", F.concat(F.lit("ü"), F.col("s")).alias("s"))
    m = em.fit(pairs, k=3, max_iter=2, broadcast_bytes=0)
    assert m.blocks is not None and m.blocks[2] > 3
    by_tiles = m.__class__(**{**m.__dict__, "blocks": None})
    unknown = spark.createDataFrame([(10**9, 1), (1, 10**9), (None, 1)], "u long, s long").select("u", F.col("s").cast(pairs.schema["s"].dataType))
    for seen in (None, pairs.union(unknown)):
        small = 4000
        got = scoring.recommend(m, 3, seen, broadcast_bytes=small)
        want = scoring.recommend(by_tiles, 3, seen)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        tree = " ".join(_tree(_plan(got)))
        assert "Window" not in tree and "Generate" not in tree and "Join" not in tree
    summary = [sorted(map(tuple, scoring.user_summary(x).collect())) for x in (m, by_tiles)]
    assert summary[0] == summary[1]


def test_draws_inside_a_task_are_those_of_spark(spark):
    """Text of many lengths, over one block of the hash too, and whole numbers."""
    from latentcf.functions.hashing import keyed_unit_open, unit_open_draws

    whole = [0, -1, 7, 10**6, -(2**63), 2**63 - 1]
    text = ["", "|", "x|y", "ä\u0000", "日本語", *["w" * n for n in (9, 26, 27, 48, 49, 54, 55, 56, 70)]]
    rng = np.random.default_rng(2)
    for left, right, types in ((whole, whole, "a long, b long"), (whole, text, "a long, b string"), (text, text, "a string, b string")):
        i, j = (x.ravel() for x in np.indices((len(left), len(right))))
        i, j = (np.concatenate([x, rng.integers(0, n, 20_000)]) for x, n in ((i, len(left)), (j, len(right))))
        rows = [(left[a], right[b]) for a, b in zip(i[:200], j[:200])]
        numbers = [0, 9, 10, 123]
        df = spark.createDataFrame(rows, types).coalesce(1).select(*[keyed_unit_open(F.col("a"), F.col("b"), F.lit(z), F.lit(42)) for z in numbers])
        want, got = np.array([tuple(r) for r in df.collect()]), [np.stack(d, axis=1) for _, d in unit_open_draws(left, i, right, j, numbers, 42)]
        got = np.concatenate(got)
        assert len(got) == len(i) and (got[: len(want)] == want).all()


@pytest.mark.parametrize("hot", [0, 4000])
def test_tasks_read_their_strips(spark, by_strips, hot):
    """No pair comes through Spark's rows in a pass, and the first M-step hashes inside the tasks."""
    layout = em.prepare_layout(even_and_hot(spark, hot))
    grid = em._grid_ahead(layout, [3], 0)
    for side in (grid.users, grid.items):
        got = {n: len(strips._read_strip(files, n, ["u", "s"])) for n, files in side.files.items()}
        assert got == {r["strip"]: r["count"] for r in side.df.groupBy("strip").count().collect()}
    drawn = strips.strips_drawn(grid, 3, 42, ["ll"], None)
    names = [["0", "1", "2"]]
    state = strips.strips_aggregate(grid, strips.BlockState("file:/none", names, dict.fromkeys("012", 1.0), 1), [[0]], ["ll"], None)
    for df in (drawn, state):
        plan = df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
        assert "MapInPandas" in plan and "FileScan" not in plan and "FlatMapGroupsInPandas" not in plan and "md5" not in plan
    from latentcf.functions.hashing import keyed_unit_open

    want = strips.strips_first(grid, {f"m{z}": keyed_unit_open(F.col("u"), F.col("s"), F.lit(z), F.lit(42)) for z in range(3)}, ["ll"], None)
    a, b = (sorted((r["side"], r["block"], r["u"] or 0, r["s"] or 0, r["n"], r["wsum"], *(round(r[f"m{z}"], 9) for z in range(3))) for r in df.collect())
            for df in (drawn, want))
    assert a == b
    layout.drop()


def test_rank_sums_look_few_positives_up(monkeypatch):
    """Cells are sorted in groups that span few of the positives; the sums are those of brute force, ties too."""
    from latentcf.operators import ranks, scoring

    rng = np.random.default_rng(8)
    monkeypatch.setattr(ranks, "ALIKE", 16)
    monkeypatch.setattr(ranks, "NEAR", 128)
    for digits in (None, 2):
        a, b = rng.gamma(20, 1, (900, 3)), rng.gamma(4, 1, (2_000, 3))
        a, b = a / a.sum(axis=1, keepdims=True), b / b.sum(axis=0)
        if digits:
            a, b = np.round(a, digits), np.round(b * 1000, 1)
        full = scoring.block_scores(a, b).ravel()
        positives = rng.choice(full, 3_000)
        table = scoring._positive_table(positives)
        looked, sums = [], ranks._sorted_sums
        monkeypatch.setattr(ranks, "_sorted_sums", lambda t, x: looked.append(np.searchsorted(t[0], x[-1]) - np.searchsorted(t[0], x[0])) or sums(t, x))
        assert ranks.cell_sums(table, a, b) == scoring._pos_sums(table, full)
        monkeypatch.setattr(ranks, "_sorted_sums", sums)
        assert np.mean(looked) < len(table[0]) / 4
