"""Scoring and evaluation: FX6 by hand, block scorer against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from latentcf.operators import em, evaluation, scoring
from latentcf.operators.split import hash_split
from latentcf.sources.tables import purchase_pairs
from tests.conftest import SF0001
from tests.fixtures import fx6_model, pairs_df


def _one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


@pytest.fixture(scope="module")
def fx6(spark):
    m = fx6_model(spark)
    train = pairs_df(spark, [(1, 10), (2, 20)])
    test = pairs_df(spark, [(1, 20), (2, 30)])
    return m, train, test


def test_fx6_inclusive(spark, fx6):
    m, train, test = fx6
    r = _one(evaluation.confusion(m, train, test, [0.5], inclusive=True))
    assert (r["tp"], r["fp"], r["fn"], r["tn"]) == (1, 1, 1, 1)
    assert (r["precision"], r["recall"], r["f1"]) == pytest.approx((0.5, 0.5, 0.5))


def test_fx6_strict_and_empty_positive(spark, fx6):
    m, train, test = fx6
    r = _one(evaluation.confusion(m, train, test, [0.5], inclusive=False))
    assert (r["tp"], r["fp"], r["fn"], r["tn"]) == (0, 1, 2, 1)
    assert r["precision"] == 0.0 and r["recall"] == 0.0 and r["f1"] is None
    r = _one(evaluation.confusion(m, train, test, [0.95], inclusive=True))
    assert (r["tp"], r["fp"], r["fn"], r["tn"]) == (0, 0, 2, 2)
    assert r["precision"] is None and r["recall"] == 0.0 and r["f1"] is None


def test_fx6_auc_and_train_truth(spark, fx6):
    m, train, test = fx6
    assert _one(evaluation.auc(m, train, test))["auc"] == pytest.approx(0.25)
    r = _one(evaluation.confusion(m, train, None, [0.5], inclusive=True, truth="train"))
    # positives over all 6 pairs: .9 .5 .6 ; train pairs (1,10)=.9 (2,20)=.4
    assert (r["tp"], r["fp"], r["fn"], r["tn"]) == (1, 2, 1, 2)


def test_fx6_recommend_excludes_seen(spark, fx6):
    m, train, _ = fx6
    rec = scoring.recommend(m, 2, train).orderBy("u", "rank").collect()
    assert [(r["u"], r["rank"], r["s"]) for r in rec] == [(1, 1, 20), (1, 2, 30), (2, 1, 10), (2, 2, 30)]


@pytest.fixture(scope="module")
def fitted(spark):
    train, test = hash_split(purchase_pairs(spark, SF0001), 0.1, 42)
    train, test = em.prepare_pairs(train), em.prepare_pairs(test)
    m = em.fit(train, k=3, max_iter=3, seed=42, prepared=True)
    U = m.users.toPandas().sort_values("u")
    S = m.items.toPandas().sort_values("s")
    sc = np.zeros((len(U), len(S)))
    for z in range(3):
        sc = sc + np.multiply.outer(U[f"pu{z}"].to_numpy(), S[f"ps{z}"].to_numpy()) if z else \
            np.multiply.outer(U["pu0"].to_numpy(), S["ps0"].to_numpy())
    full = pd.DataFrame({"u": np.repeat(U["u"].to_numpy(), len(S)), "s": np.tile(S["s"].to_numpy(), len(U)),
                         "score": sc.ravel()})
    return m, train, test, full, train.toPandas(), test.toPandas()


def test_universe_identity(spark, fitted):
    m, train, test, full, trp, tep = fitted
    c = evaluation.threshold_sweep(m, train, test, [1e-2, 5e-3, 1e-3]).collect()
    n_train = len(trp)
    for r in c:
        assert r["tp"] + r["fp"] + r["fn"] + r["tn"] == m.n_users * m.n_items - n_train


def test_counts_against_brute_force(spark, fitted):
    m, train, test, full, trp, tep = fitted
    seen = full.merge(trp.assign(tr=1), on=["u", "s"], how="left")
    unseen = seen[seen["tr"].isna()].drop(columns="tr").merge(tep.assign(te=1), on=["u", "s"], how="left")
    truth = unseen["te"].notna().to_numpy()
    ths = [1e-2, 6e-3, 5e-3, 4e-3]
    got = {r["threshold"]: r for r in evaluation.threshold_sweep(m, train, test, ths).collect()}
    for t in ths:
        pred = unseen["score"].to_numpy() >= t
        r = got[t]
        assert r["tp"] == int((pred & truth).sum())
        assert r["fp"] == int((pred & ~truth).sum())
        assert r["fn"] == int((~pred & truth).sum())
        assert r["tn"] == int((~pred & ~truth).sum())
    # AUC by brute force (average ranks)
    ranks = pd.Series(unseen["score"].to_numpy()).rank(method="average").to_numpy()
    P, N = truth.sum(), (~truth).sum()
    auc_bf = (ranks[truth].sum() - P * (P + 1) / 2) / (P * N)
    assert evaluation.auc(m, train, test).first()["auc"] == pytest.approx(auc_bf, abs=1e-12)


def test_top_n_and_summary_against_brute_force(spark, fitted):
    m, train, test, full, trp, tep = fitted
    seen = full.merge(trp.assign(tr=1), on=["u", "s"], how="left")
    unseen = seen[seen["tr"].isna()].sort_values(["u", "score", "s"], ascending=[True, False, True])
    bf = unseen.groupby("u").head(5)
    got = scoring.recommend(m, 5, train).toPandas().sort_values(["u", "rank"])
    assert got["s"].tolist() == bf["s"].tolist()
    assert np.allclose(got["score"].to_numpy(), bf["score"].to_numpy(), atol=0, rtol=0)
    summ = scoring.user_summary(m).toPandas().set_index("u").sort_index()
    g = full.groupby("u")["score"]
    assert np.allclose(summ["score_max"].to_numpy(), g.max().to_numpy(), rtol=0, atol=0)
    assert np.allclose(summ["score_sum"].to_numpy(), 1.0, atol=1e-12)


def test_chunked_items_equal_single_chunk(spark, fitted):
    m, train, test, *_ = fitted
    small = 64 * 1024  # forces several item chunks
    a = evaluation.threshold_sweep(m, train, test, [5e-3]).first()
    b = evaluation.threshold_sweep(m, train, test, [5e-3], broadcast_bytes=small).first()
    assert a.asDict() == b.asDict()
    ra = scoring.recommend(m, 3, train).orderBy("u", "rank").collect()
    rb = scoring.recommend(m, 3, train, broadcast_bytes=small).orderBy("u", "rank").collect()
    assert [(r.u, r.rank, r.s) for r in ra] == [(r.u, r.rank, r.s) for r in rb]
    assert evaluation.auc(m, train, test, broadcast_bytes=small).first()["auc"] == pytest.approx(
        evaluation.auc(m, train, test).first()["auc"], abs=1e-15)


def test_predict_and_exclude(spark, fx6):
    m, train, test = fx6
    sc = scoring.score_pairs(m, pairs_df(spark, [(1, 10), (1, 20), (2, 30)]))
    p = {(r.u, r.s): r.pred for r in scoring.predict(sc, 0.5).collect()}
    assert p == {(1, 10): True, (1, 20): True, (2, 30): False}
    p = {(r.u, r.s): r.pred for r in scoring.predict(sc, 0.5, inclusive=False).collect()}
    assert p[(1, 20)] is False
    left = scoring.exclude_seen(sc, train).collect()
    assert sorted((r.u, r.s) for r in left) == [(1, 20), (2, 30)]
    pc = {r.u: r.n_pos for r in scoring.positive_counts(m, [0.5], per_user=True).collect()}
    assert pc == {1: 2, 2: 1}


def test_auc_matches_spark_ml_evaluator(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    from tests.fixtures import planted_blocks

    train, test = hash_split(planted_blocks(spark), 0.1, 42)
    m = em.fit(train, k=3, max_iter=10, seed=42)
    # materialise every unseen pair only for this cross-check (60 x 60 fixture)
    users = m.users.select("u", *[F.col(f"pu{z}") for z in range(3)])
    grid = users.select("u", F.explode(F.sequence(F.lit(1000).cast("long"), F.lit(1059).cast("long"))).alias("s"))
    scored = scoring.score_pairs(m, grid)
    unseen = scoring.exclude_seen(scored, train)
    lab = unseen.join(test.withColumn("label", F.lit(1.0)), ["u", "s"], "left").fillna(0.0, ["label"])
    ev = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label", metricName="areaUnderROC",
                                       numBins=0)
    ours = evaluation.auc(m, train, test).first()["auc"]
    assert ours == pytest.approx(ev.evaluate(lab), abs=1e-9)


def test_pr_curve_operator(spark):
    from tests.fixtures import planted_blocks

    train, test = hash_split(planted_blocks(spark), 0.1, 42)
    c = evaluation.pr_curve(train, test, [2, 3], [0.05, 0.02], passes=5).collect()
    assert sorted({(r.k, r.threshold) for r in c}) == [(2, 0.02), (2, 0.05), (3, 0.02), (3, 0.05)]
    assert all(r.tp + r.fn == test.count() for r in c)


def test_rank_sum_helper_both_branches_with_ties():
    from latentcf.operators.scoring import _pos_sums, _positive_table

    rng = np.random.default_rng(7)
    pos = rng.integers(0, 50, 40).astype(float) / 10.0  # many ties
    table = _positive_table(np.sort(pos))
    for n in (5, 1000):  # 5 < 4*|unique| -> search branch; 1000 -> sort branch
        x = rng.integers(0, 60, n).astype(float) / 10.0
        gt = sum(int((pos > v).sum()) for v in x)
        eq = sum(int((pos == v).sum()) for v in x)
        assert _pos_sums(table, x) == (gt, eq)
    assert _pos_sums(table, np.array([])) == (0, 0)


def test_recommend_string_items_and_unknown_seen(spark):
    from latentcf.model import LatentClassModel

    users = spark.createDataFrame([(1, 1.0, 0.0), (2, 0.0, 1.0)], "u long, pu0 double, pu1 double")
    items = spark.createDataFrame([("ab", 0.5, 0.1), ("abc", 0.3, 0.2), ("b", 0.2, 0.7)],
                                  "s string, ps0 double, ps1 double")
    m = LatentClassModel(k=2, users=users, items=items, trace=None, passes=0, n_users=2, n_items=3)
    # "abcdef" is not an item; truncated to the ids' width it would read "abc"
    seen = spark.createDataFrame([(1, "abcdef"), (2, "b")], "u long, s string")
    got = [(r.u, r.rank, r.s) for r in scoring.recommend(m, 2, seen).orderBy("u", "rank").collect()]
    assert got == [(1, 1, "ab"), (1, 2, "abc"), (2, 1, "abc"), (2, 2, "ab")]


def test_empty_test_set(spark, fx6):
    m, train, _ = fx6
    empty = spark.createDataFrame([], "u long, s long")
    r = evaluation.confusion(m, train, empty, [0.5]).first()
    assert (r.tp, r.fn) == (0, 0) and r.recall is None and r.f1 is None
    assert r.tp + r.fp + r.fn + r.tn == 2 * 3 - 2
    a = evaluation.auc(m, train, empty).first()
    assert a.auc is None and a.n_pos == 0


def test_tiny_broadcast_limit_with_empty_chunks(spark, fx6):
    m, train, test = fx6
    tiny = 100  # 3 items at 72 bytes each: one item per chunk, several hash chunks empty
    got = [(r.u, r.rank, r.s) for r in scoring.recommend(m, 2, train, broadcast_bytes=tiny).orderBy("u", "rank").collect()]
    assert got == [(1, 1, 20), (1, 2, 30), (2, 1, 10), (2, 2, 30)]
    r = evaluation.confusion(m, train, test, [0.5], broadcast_bytes=tiny).first()
    assert (r.tp, r.fp, r.fn, r.tn) == (1, 1, 1, 1)
    summ = {r.u: r.n_items for r in scoring.user_summary(m, broadcast_bytes=tiny).collect()}
    assert summ == {1: 3, 2: 3}


def test_top_n_exact_matches_full_scoring_with_ties_and_seen():
    from latentcf.operators.scoring import _top_rows, block_scores, top_n_exact

    rng = np.random.default_rng(3)
    n_items, k, n = 3000, 3, 7
    mat = np.round(rng.dirichlet(np.ones(n_items) * 0.3, size=k).T, 6)  # rounded: ties among items
    mat[100] = mat[200]  # identical items
    ids = np.arange(10_000, 10_000 + n_items)
    a = rng.dirichlet(np.ones(k), size=40)
    a[0] = a[1]  # identical users
    order = np.argsort(-mat, axis=0, kind="stable")
    seen = [None if u % 3 == 0 else np.sort(rng.choice(n_items, size=u * 5, replace=False)) for u in range(40)]
    r, c, v, rk = top_n_exact(a, ids, mat, order, seen, n)
    full = block_scores(a, mat)
    for u, sp in enumerate(seen):
        if sp is not None:
            full[u, sp] = -np.inf
    fr, fc, fv, fk = _top_rows(full, n)
    got = sorted(zip(r.tolist(), rk.tolist(), c.tolist(), v.tolist()))
    want = sorted(zip(fr.tolist(), fk.tolist(), fc.tolist(), fv.tolist()))
    assert got == want


def test_predicted_pairs_pruned_equals_brute_force(spark, fitted):
    m, train, test, full, trp, tep = fitted
    for t in (np.quantile(full["score"], 0.99), np.quantile(full["score"], 0.5), 1e-9):
        got = scoring.predicted_pairs(m, float(t)).toPandas()
        want = full[full["score"] >= t]
        assert len(got) == len(want)
        assert sorted(zip(got.u, got.s, got.score)) == sorted(zip(want.u, want.s, want.score))
    strict = scoring.predicted_pairs(m, float(np.quantile(full["score"], 0.9)), inclusive=False).count()
    assert strict == int((full["score"] > np.quantile(full["score"], 0.9)).sum())


def test_non_positive_thresholds_count_every_pair(spark, fx6):
    m, _, _ = fx6
    assert scoring.predicted_pairs(m, 0.0).count() == 6
    assert {r.threshold: r.n_pos for r in scoring.positive_counts(m, [0.0, -1.0]).collect()} == {0.0: 6, -1.0: 6}


def test_train_pairs_in_test_and_copies_do_not_count(spark, fitted):
    m, train, test, *_ = fitted
    dirty = test.union(test).union(train.limit(200))
    for f in (lambda t: evaluation.confusion(m, train, t, [5e-3]).first(), lambda t: evaluation.auc(m, train, t).first()):
        assert f(dirty).asDict() == f(test).asDict()


def test_rank_sums_beyond_63_bits(spark):
    from latentcf.operators.ranks import _total

    big = (1 << 62) + 1
    parts = spark.createDataFrame([(1, big, 1)] * 5 + [(-1, big, 0)], "sign int, gt long, eq long")
    assert _total(parts) == (4 * big, 5)


def test_counts_beyond_63_bits(spark):
    from decimal import Decimal

    big = Decimal(1 << 80)
    r = evaluation.with_rates(spark.createDataFrame([(1, big, 1, big)], "tp long, fp decimal(38,0), fn long, tn decimal(38,0)")).first()
    assert r.tn == big and r.precision == pytest.approx(2.0 ** -80, rel=1e-6)


def test_no_table_passes_through_the_driver():
    import inspect

    from latentcf.operators import em, ranks, topics

    for module in (scoring, evaluation, ranks, em, topics):
        assert "toPandas" not in inspect.getsource(module)
    assert "collect()" not in inspect.getsource(evaluation)


def tied_model(spark, n_users=40, n_items=60, k=3, digits=2, seed=5):
    """A model of few different parameter values, so that many scores are equal."""
    from latentcf.model import LatentClassModel

    rng = np.random.default_rng(seed)
    a, b = (np.round(rng.random((n, k)), digits) for n in (n_users, n_items))
    users = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(a)], "u long, " + ", ".join(f"pu{z} double" for z in range(k)))
    items = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(b)], "s long, " + ", ".join(f"ps{z} double" for z in range(k)))
    return LatentClassModel(k=k, users=users, items=items, trace=None, passes=0, n_users=n_users, n_items=n_items), scoring.block_scores(a, b)


def brute_auc(full, train, test):
    truth, seen = set(test) - set(train), set(train)
    pos = np.array([full[p] for p in sorted(truth)])
    neg = np.array([full[i, j] for i in range(full.shape[0]) for j in range(full.shape[1]) if (i, j) not in truth and (i, j) not in seen])
    return sum((pos > x).sum() + 0.5 * (pos == x).sum() for x in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("digits, ship", [(1, 1), (1, 24 * 4), (2, 24 * 7), (2, 1 << 20)])
def test_auc_by_ranges_with_ties_equals_brute_force(spark, digits, ship, monkeypatch):
    from latentcf.operators import ranks

    monkeypatch.setattr(ranks, "GROUP", 100)
    monkeypatch.setattr(ranks, "ROW", 7)
    monkeypatch.setattr(scoring, "LEAST_CELLS", 300)  # several tiles
    m, full = tied_model(spark, digits=digits)
    rng = np.random.default_rng(1)
    every = [(int(i), int(j)) for i in range(40) for j in range(60)]
    picked = [every[i] for i in rng.permutation(len(every))[:500]]
    train, test = picked[:300], picked[250:]
    got = evaluation.auc(m, pairs_df(spark, train), pairs_df(spark, test), ship_bytes=ship).first()
    assert got.auc == pytest.approx(brute_auc(full, train, test), abs=1e-15) and got.n_pos == 200


def test_auc_scores_all_pairs_once_however_many_ranges(spark, monkeypatch):
    from latentcf.operators import ranks

    m, _ = tied_model(spark)
    test = pairs_df(spark, [(i, j) for i in range(40) for j in range(0, 60, 4)])
    runs, tiles = [], ranks._tiles
    monkeypatch.setattr(ranks, "_tiles", lambda *a, **b: runs.append(1) or tiles(*a, **b))
    for ship, least in ((1 << 20, 1), (24 * 5, 20)):
        runs.clear()
        _, path, cut = ranks.score_ranges(scoring.score_pairs(m, test).groupBy("score").agg(F.count("*").alias("n")), ship // 24)
        assert len(cut) >= least and all(r["values"] <= ship // 24 for r in cut)
        assert all(a["high"] < b["low"] for a, b in zip(cut, cut[1:]))
        evaluation.auc(m, pairs_df(spark, [(0, 1)]), test, ship_bytes=ship).collect()
        assert len(runs) == 1


def joint_of(spark, pairs, ks=(2, 3, 5), passes=2):
    return em.fit_many(pairs, list(ks), max_iter=passes, seed=42, prepared=True)


@pytest.mark.parametrize("small", [None, 4000])
def test_several_models_in_one_set_of_tiles(spark, fitted, small):
    _, train, test, *_ = fitted
    models = joint_of(spark, train)
    ths = [5e-3, 1e-3]
    got = evaluation.confusion(models, train, test, ths, broadcast_bytes=small).collect()
    alone = [(k, *r) for k in models for r in evaluation.confusion(models[k], train, test, ths).collect()]
    assert [tuple(r) for r in got] == alone
    plan = evaluation.confusion(models, train, test, ths)._jdf.queryExecution().toString()
    assert len(set(__import__("re").findall(r"FlatMapCoGroupsInPandas", plan.split("== Physical Plan ==")[1]))) == 1


def test_tiles_that_cannot_reach_the_threshold_are_not_built(spark, monkeypatch):
    """Users and items of separate classes: a tile of different classes cannot reach the threshold."""
    from latentcf.model import LatentClassModel

    rng = np.random.default_rng(4)
    n, k = 240, 4
    a = np.full((n, k), 0.01)
    a[np.arange(n), np.arange(n) % k] = 0.97
    b = 1e-6 * rng.random((n, k))
    b[np.arange(n), np.arange(n) % k] = np.where(np.arange(n) % 7 == 0, 0.02, 2e-3) * (0.5 + rng.random(n) / 2)
    b[::5] *= 1e-3  # items that reach it with no user
    users = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(a)], "u long, " + ", ".join(f"pu{z} double" for z in range(k)))
    items = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(b)], "s long, " + ", ".join(f"ps{z} double" for z in range(k)))
    m = LatentClassModel(k=k, users=users, items=items, trace=None, passes=0, n_users=n, n_items=n)
    p, full = scoring.params_of(m), scoring.block_scores(a, b)
    monkeypatch.setattr(scoring, "LEAST_CELLS", 500)
    small = 80 * 20  # bytes of a block: some 20 rows
    shape = scoring._tile_shape(p, small)
    plan = scoring._reachable(p, *shape, 1e-3)
    assert plan.n_built < 0.5 * plan.rows * plan.cols
    assert plan.items.count() < 0.85 * n
    for t in (1e-3, 5e-3, 1e-9):
        got = {(r.u, r.s): r.score for r in scoring.predicted_pairs(m, t, broadcast_bytes=small).collect()}
        assert got == {(int(i), int(j)): full[i, j] for i, j in zip(*np.nonzero(full >= t))}
        assert int(scoring.positive_counts(m, [t], broadcast_bytes=small).first().n_pos) == int((full >= t).sum())
    none = scoring.positive_counts(m, [0.9, 0.95], broadcast_bytes=small).collect()
    assert sorted((r.threshold, int(r.n_pos)) for r in none) == [(0.9, 0), (0.95, 0)]
    each = scoring.positive_counts(m, [1e-3, 0.9], per_user=True, broadcast_bytes=small).collect()
    assert {(r.u, r.threshold): r.n_pos for r in each} == {
        (u, t): int((full[u] >= t).sum()) for u in range(n) for t in (1e-3, 0.9)}
