"""EM: the hand-worked pass (FX5), long = wide, properties, layouts, edges."""

import math

import pytest
from pyspark.sql import functions as F

from latentcf.operators import em, staged
from latentcf.operators.scoring import score_pairs
from latentcf.model import LatentClassModel
from latentcf.sources.tables import purchase_pairs
from tests.conftest import SF0001
from tests.fixtures import pairs_df


def _rows(df, key):
    return {r[key]: r for r in df.collect()}


def test_fx5_one_pass_by_hand(spark):
    resp = spark.createDataFrame(
        [(1, 10, 0.8, 0.2), (1, 20, 0.4, 0.6), (2, 20, 0.1, 0.9)], "u long, s long, q0 double, q1 double")
    users, items, st = em.m_step(spark, resp, 2)
    assert st.class_totals == pytest.approx([1.3, 1.7], abs=1e-12)
    it = _rows(items, "s")
    assert (it[10]["ps0"], it[10]["ps1"]) == pytest.approx((8 / 13, 2 / 17), abs=1e-12)
    assert (it[20]["ps0"], it[20]["ps1"]) == pytest.approx((5 / 13, 15 / 17), abs=1e-12)
    us = _rows(users, "u")
    assert (us[1]["pu0"], us[1]["pu1"]) == pytest.approx((0.6, 0.4), abs=1e-12)
    assert (us[2]["pu0"], us[2]["pu1"]) == pytest.approx((0.1, 0.9), abs=1e-12)
    pairs = pairs_df(spark, [(1, 10), (1, 20), (2, 20)])
    e = _rows(em.responsibilities(pairs, users, items, 2).withColumn("k", F.concat_ws(",", "u", "s")), "k")
    assert e["1,10"]["evidence"] == pytest.approx(92 / 221, abs=1e-12)
    assert e["1,20"]["evidence"] == pytest.approx(129 / 221, abs=1e-12)
    assert e["2,20"]["evidence"] == pytest.approx(184 / 221, abs=1e-12)
    assert e["1,10"]["q0"] == pytest.approx(81.6 / 92, abs=1e-12)
    assert e["1,20"]["q0"] == pytest.approx(51 / 129, abs=1e-12)
    assert e["2,20"]["q0"] == pytest.approx(8.5 / 184, abs=1e-12)
    ll = em.responsibilities(pairs, users, items, 2).agg(F.avg("lnev")).first()[0]
    assert ll == pytest.approx(-0.5326504551778534, abs=1e-12)
    m = LatentClassModel(k=2, users=users, items=items, trace=None, passes=1, n_users=2, n_items=2)
    sc = score_pairs(m, pairs_df(spark, [(2, 10)])).first()["score"]
    assert sc == pytest.approx(37 / 221, abs=1e-12)


@pytest.fixture(scope="module")
def sf_pairs(spark):
    return em.prepare_pairs(purchase_pairs(spark, SF0001))


def test_long_form_equals_wide_form(spark, sf_pairs):
    st = staged.one_step(sf_pairs, 3, 42)
    users, items, stats = em.m_step(spark, em.initial_responsibilities(sf_pairs, 3, 42), 3)
    long_items = st["p_sz"].groupBy("s").pivot("z", [0, 1, 2]).agg(F.first("p_sz"))
    d = long_items.join(items, "s").agg(*[F.max(F.abs(F.col(str(z)) - F.col(f"ps{z}"))) for z in range(3)]).first()
    assert max(d) < 1e-12
    long_users = st["p_zu"].groupBy("u").pivot("z", [0, 1, 2]).agg(F.first("p_zu"))
    d = long_users.join(users, "u").agg(*[F.max(F.abs(F.col(str(z)) - F.col(f"pu{z}"))) for z in range(3)]).first()
    assert max(d) < 1e-12
    ll_long = st["loglik"].first()["loglik"]
    ll_wide = em.responsibilities(sf_pairs, users, items, 3).agg(F.avg("lnev")).first()[0]
    assert ll_long == pytest.approx(ll_wide, abs=1e-12)
    post = st["posterior"].groupBy("u", "s").agg(F.sum("q").alias("t"))
    assert post.agg(F.max(F.abs(F.col("t") - 1.0))).first()[0] < 1e-12


def test_fit_properties(spark, sf_pairs):
    m = em.fit(sf_pairs, k=3, max_iter=6, seed=42, prepared=True)
    assert m.passes == 6 and len(m.logliks) == 6
    # log-likelihood never falls
    for a, b in zip(m.logliks, m.logliks[1:]):
        assert b >= a - 1e-12
    # sum_z p(z|u) = 1 ; sum_s p(s|z) = 1
    row = m.users.select((F.col("pu0") + F.col("pu1") + F.col("pu2")).alias("t"))
    assert row.agg(F.max(F.abs(F.col("t") - 1))).first()[0] < 1e-12
    col = m.items.agg(*[F.sum(f"ps{z}") for z in range(3)]).first()
    assert list(col) == pytest.approx([1, 1, 1], abs=1e-12)
    tr = m.trace.orderBy("iteration").collect()
    assert [r["iteration"] for r in tr] == list(range(1, 7))
    assert all(r["seconds"] is not None and r["seconds"] >= 0 for r in tr)


def test_partition_invariance(spark, sf_pairs):
    res = []
    for n in (1, 4, 16):
        m = em.fit(sf_pairs.repartition(n), k=3, max_iter=3, seed=42)
        res.append((m.logliks, m.items))
    for lls, _ in res[1:]:
        assert lls == pytest.approx(res[0][0], abs=1e-9)
    a, b = res[0][1], res[2][1].select("s", *[F.col(f"ps{z}").alias(f"b{z}") for z in range(3)])
    d = a.join(b, "s").agg(*[F.max(F.abs(F.col(f"ps{z}") - F.col(f"b{z}"))) for z in range(3)]).first()
    assert max(d) < 1e-9


def test_grid_with_hot_user_equals_broadcast(spark):
    # one user holds about a third of all pairs
    base = spark.range(0, 3000).select((F.col("id") % 300).alias("u"), (F.col("id") % 97 + 5000).alias("s"))
    hot = spark.range(0, 1500).select(F.lit(7).cast("long").alias("u"), F.col("id").alias("s"))
    pairs = base.union(hot).distinct()
    a = em.fit(pairs, k=2, max_iter=3, seed=3)
    b = em.fit(pairs, k=2, max_iter=3, seed=3, broadcast_bytes=0)
    assert b.logliks == pytest.approx(a.logliks, abs=1e-12)
    bi = b.items.select("s", F.col("ps0").alias("b0"), F.col("ps1").alias("b1"))
    d = a.items.join(bi, "s").agg(F.max(F.abs(F.col("ps0") - F.col("b0"))), F.max(F.abs(F.col("ps1") - F.col("b1"))))
    assert max(d.first()) < 1e-12
    # refined until the hot user's pairs lie in several bounded cells
    grid = em.grid_pairs(em.prepare_pairs(pairs), pairs.count(), 1, 1, cell_pairs=300)
    cells = grid.df.groupBy("cell").count().agg(F.max("count")).first()[0]
    hot_cells = grid.df.where(F.col("u") == 7).select("cell").distinct().count()
    spark.sql(f"DROP TABLE {grid.table}")
    assert cells <= 300 and hot_cells > 1


def even_and_hot(spark, hot_pairs):
    """30,000 even pairs, and one user and one item with ``hot_pairs`` more each."""
    even = spark.range(30_000).select((F.col("id") % 1000).alias("u"), (F.pmod(F.xxhash64("id"), F.lit(2000)) + 5000).alias("s"))
    user = spark.range(hot_pairs).select(F.lit(7).cast("long").alias("u"), (F.col("id") + 5000).alias("s"))
    item = spark.range(hot_pairs).select(F.col("id").alias("u"), F.lit(5001).cast("long").alias("s"))
    return em.prepare_pairs(even.union(user).union(item))


def test_hot_user_and_item_do_not_widen_the_grid(spark):
    grids = {}
    for hot in (0, 6000):
        pairs = even_and_hot(spark, hot)
        grids[hot] = g = em.grid_pairs(pairs, pairs.count(), 1, 1, cell_pairs=1000)
        assert g.df.groupBy("cell").count().agg(F.max("count")).first()[0] <= 1000
        assert sorted(map(tuple, g.df.select("u", "s").collect())) == sorted(map(tuple, pairs.collect()))
        g.drop()
    even, skewed = grids[0], grids[6000]
    assert even.hot_users is None and {p.users for p in skewed.parts} == {"cold", "hot"} and len(skewed.parts) == 3
    assert (skewed.parts[0].rows, skewed.parts[0].cols) == (even.parts[0].rows, even.parts[0].cols)
    # a cold user goes to its row of the common grid and once more to the hot items' cells
    assert skewed.copies("u", hot=False) == even.copies("u", hot=False) + 1
    assert skewed.copies("s", hot=False) == even.copies("s", hot=False) + 1
    assert skewed.copies("u", hot=True) >= 6


def test_hot_parts_fit_like_the_broadcast_path(spark, monkeypatch):
    pairs = even_and_hot(spark, 4000)
    spark.conf.set("spark.latentcf.cellPairs", "1000")
    try:
        a = em.fit(pairs, k=3, max_iter=3, seed=3, prepared=True)
        b = em.fit(pairs, k=3, max_iter=3, seed=3, prepared=True, broadcast_bytes=0)
    finally:
        spark.conf.unset("spark.latentcf.cellPairs")
    assert b.logliks == pytest.approx(a.logliks, abs=1e-12)
    for side, key in (("users", "u"), ("items", "s")):
        left, right = (getattr(m, side).orderBy(key).toPandas().to_numpy() for m in (a, b))
        assert left.shape == right.shape and abs(left - right).max() < 1e-12


def test_more_cells_than_buckets(spark):
    pairs = even_and_hot(spark, 0)
    a = em.fit(pairs, k=2, max_iter=2, seed=3, prepared=True)
    spark.conf.set("spark.sql.sources.bucketing.maxBuckets", "9")
    try:
        grid = em.grid_pairs(pairs, pairs.count(), 1, 1, cell_pairs=500)
        assert grid.cells > 9 and grid.df.groupBy("cell").count().agg(F.max("count")).first()[0] <= 500
        grid.drop()
        spark.conf.set("spark.latentcf.cellPairs", "500")
        b = em.fit(pairs, k=2, max_iter=2, seed=3, prepared=True, broadcast_bytes=0)
    finally:
        spark.conf.unset("spark.latentcf.cellPairs")
        spark.conf.unset("spark.sql.sources.bucketing.maxBuckets")
    assert b.logliks == pytest.approx(a.logliks, abs=1e-12)


def test_k1_and_tol_and_weights(spark, sf_pairs):
    m1 = em.fit(sf_pairs, k=1, max_iter=3, prepared=True)
    # k=1: q = 1 after the first E-step, so from pass 2 on p(s|u) is the item's popularity share
    assert m1.logliks[1] == pytest.approx(m1.logliks[2], abs=1e-12)
    assert m1.logliks[1] >= m1.logliks[0]
    mt = em.fit(sf_pairs, k=3, max_iter=50, tol=1e-3, prepared=True)
    assert mt.passes < 50
    assert abs(mt.logliks[-1] - mt.logliks[-2]) < 1e-3
    w1 = sf_pairs.withColumn("w", F.lit(1))
    mw = em.fit(w1, k=3, max_iter=3, weight_col="w")
    mu = em.fit(sf_pairs, k=3, max_iter=3, prepared=True)
    assert mw.logliks == pytest.approx(mu.logliks, abs=1e-12)


def test_duplicates_and_one_user(spark):
    pairs = pairs_df(spark, [(1, 10), (1, 20), (1, 30)])
    m = em.fit(pairs, k=2, max_iter=3)
    # one user: p(s|u) = 1/3 for each of their items, log-likelihood ln(1/3)
    assert m.logliks[-1] == pytest.approx(math.log(1 / 3), abs=1e-9)


def test_empty_input_raises_cleanly(spark):
    pairs = spark.createDataFrame([], "u long, s long")
    with pytest.raises(ValueError, match="no"):
        em.fit(pairs, k=2, max_iter=2)


def test_grid_with_hot_item_equals_broadcast(spark):
    # item 42 is bought by 1500 of 1800 users: about a third of all pairs
    base = spark.range(0, 3000).select((F.col("id") % 1800).alias("u"), (F.col("id") % 211 + 100).alias("s"))
    hot = spark.range(0, 1500).select(F.col("id").alias("u"), F.lit(42).cast("long").alias("s"))
    pairs = base.union(hot).distinct()
    a = em.fit(pairs, k=3, max_iter=3, seed=5)
    b = em.fit(pairs, k=3, max_iter=3, seed=5, broadcast_bytes=0)
    assert b.logliks == pytest.approx(a.logliks, abs=1e-12)
    ua = a.users.select("u", *[F.col(f"pu{z}").alias(f"a{z}") for z in range(3)])
    d = b.users.join(ua, "u").agg(*[F.max(F.abs(F.col(f"pu{z}") - F.col(f"a{z}"))) for z in range(3)]).first()
    assert max(d) < 1e-12


def test_resume_after_driver_restart(spark, sf_pairs, tmpdir_path):
    import os

    full = em.fit(sf_pairs, k=3, max_iter=4, seed=42, prepared=True)
    run = os.path.join(tmpdir_path, "run")
    first = em.fit(sf_pairs, k=3, max_iter=2, seed=42, prepared=True, run_dir=run)
    assert first.logliks == pytest.approx(full.logliks[:2], abs=1e-10)
    os.makedirs(os.path.join(run, "state-00002", "side=u"))  # a pass that died mid-write
    resumed = em.fit(sf_pairs, k=3, max_iter=4, seed=42, prepared=True, run_dir=run)
    assert resumed.logliks == pytest.approx(full.logliks, abs=1e-10)
    tr = resumed.trace.orderBy("iteration").collect()
    assert tr[0]["seconds"] is None and tr[-1]["seconds"] is not None
    # a finished run resumes to the same model without new passes
    again = em.fit(sf_pairs, k=3, max_iter=4, seed=42, prepared=True, run_dir=run)
    assert again.logliks[:3] == pytest.approx(full.logliks[:3], abs=1e-10)


def test_weighted_fit_through_the_grid(spark, sf_pairs):
    w = sf_pairs.withColumn("w", (F.col("u") % 3 + 1).cast("long"))
    a = em.fit(w, k=3, max_iter=3, weight_col="w")
    b = em.fit(w, k=3, max_iter=3, weight_col="w", broadcast_bytes=0)
    assert b.logliks == pytest.approx(a.logliks, abs=1e-12)


def test_fit_many_equals_separate_fits(spark, sf_pairs):
    many = em.fit_many(sf_pairs, [2, 3, 5], max_iter=3, seed=42, prepared=True)
    for k in (2, 3, 5):
        one = em.fit(sf_pairs, k=k, max_iter=3, seed=42, prepared=True)
        assert many[k].logliks == pytest.approx(one.logliks, abs=1e-12)
        a = one.items.select("s", *[F.col(f"ps{z}").alias(f"a{z}") for z in range(k)])
        d = many[k].items.join(a, "s").agg(*[F.max(F.abs(F.col(f"ps{z}") - F.col(f"a{z}"))) for z in range(k)])
        assert max(d.first()) < 1e-12
    shipped = em.fit_many(sf_pairs, [2, 3], max_iter=2, seed=42, prepared=True, broadcast_bytes=0)
    assert shipped[3].logliks == pytest.approx(many[3].logliks[:2], abs=1e-12)


def test_grid_with_text_keys_and_smoothing(spark, sf_pairs):
    text = sf_pairs.select(F.col("u").cast("string").alias("u"), F.concat(F.lit("item é"), "s").alias("s"))
    a = em.fit(text, k=3, max_iter=3, seed=5, alpha=0.5, eta=0.1)
    b = em.fit(text, k=3, max_iter=3, seed=5, alpha=0.5, eta=0.1, broadcast_bytes=0)
    assert b.logliks == pytest.approx(a.logliks, abs=1e-12)
    assert a.items.agg(F.sum("ps0")).first()[0] == pytest.approx(1, abs=1e-12)
    assert a.user_key_bytes == text.select("u").distinct().agg(F.sum(F.octet_length("u"))).first()[0]


def test_one_long_key_is_no_small_table(spark):
    pairs = spark.createDataFrame([(i, "x" * 20_000 + str(i)) for i in range(20)], "u long, s string")
    m = em.fit(pairs, k=2, max_iter=1)
    assert em.param_bytes(m.n_items, 2, m.item_key_bytes) > 20 * 20_000


def test_pairs_given_twice_count_once(spark, sf_pairs):
    a = em.fit(sf_pairs, k=2, max_iter=2)
    b = em.fit(sf_pairs.union(sf_pairs), k=2, max_iter=2)
    assert b.logliks == pytest.approx(a.logliks, abs=1e-12)
    w = sf_pairs.withColumn("w", F.lit(2))
    c = em.fit(w.union(w), k=2, max_iter=2, weight_col="w")
    assert c.logliks == pytest.approx(a.logliks, abs=1e-12)


@pytest.mark.parametrize("other", [dict(k=2), dict(seed=7), dict(eta=0.1), dict(half=True)])
def test_resume_under_other_arguments_is_refused(spark, sf_pairs, tmpdir_path, other):
    args = dict(k=3, max_iter=2, seed=42, prepared=True, run_dir=f"{tmpdir_path}/run")
    em.fit(sf_pairs, **args)
    pairs = sf_pairs.where("u % 2 = 0") if other.pop("half", False) else sf_pairs
    with pytest.raises(ValueError, match="another fit"):
        em.fit(pairs, **(args | other))


def test_scratch_is_cleaned(spark, sf_pairs):
    import os

    from latentcf.session import checkpoint_root

    root = checkpoint_root(spark).removeprefix("file:")
    before = set(os.listdir(root))
    m = em.fit(sf_pairs, k=2, max_iter=4)
    left = [x for x in set(os.listdir(root)) - before]
    assert len(left) == 1, left  # the state the model reads
    m.release()
    assert not set(os.listdir(root)) - before


def test_fit_many_weighted(spark, sf_pairs):
    w = sf_pairs.withColumn("w", (F.col("s") % 2 + 1).cast("long"))
    many = em.fit_many(w, [2, 3], max_iter=2, weight_col="w")
    one = em.fit(w, k=3, max_iter=2, weight_col="w")
    assert many[3].logliks == pytest.approx(one.logliks, abs=1e-12)


def test_scores_invariant_under_class_relabelling(spark, sf_pairs):
    from latentcf.model import LatentClassModel
    from latentcf.operators.scoring import score_pairs

    def run(perm):
        q0 = em.initial_responsibilities(sf_pairs, 3, 42)
        q0 = q0.select("u", "s", *[F.col(f"q{perm[z]}").alias(f"q{z}") for z in range(3)])
        users, items, _ = em.m_step(spark, q0, 3)
        for _ in range(3):
            users, items, _ = em.m_step(spark, em.responsibilities(sf_pairs, users, items, 3), 3)
        m = LatentClassModel(k=3, users=users, items=items, trace=None, passes=3, n_users=0, n_items=0)
        return score_pairs(m, sf_pairs, broadcast_bytes=1 << 30).withColumnRenamed("score", f"sc{perm[0]}")

    a, b = run([0, 1, 2]), run([2, 0, 1])
    d = a.join(b, ["u", "s"]).agg(F.max(F.abs(F.col("sc0") - F.col("sc2"))), F.count(F.lit(1))).first()
    assert d[1] == sf_pairs.count() and d[0] < 1e-12


def _same_models(a, b, tol=1e-12):
    assert a.passes == b.passes and a.logliks == pytest.approx(b.logliks, abs=tol)
    for side, key in (("users", "u"), ("items", "s")):
        x, y = (getattr(m, side).orderBy(key).toPandas().to_numpy() for m in (a, b))
        assert x.shape == y.shape and abs(x - y).max() < tol


def test_fit_many_with_own_stops_equals_separate_fits(spark, sf_pairs):
    many = em.fit_many(sf_pairs, [1, 2, 3, 5], max_iter=8, prepared=True, tol=4e-3)
    alone = {k: em.fit(sf_pairs, k=k, max_iter=8, prepared=True, tol=4e-3) for k in many}
    assert len({m.passes for m in alone.values()}) > 1  # they leave at different passes
    for k in many:
        _same_models(many[k], alone[k])
    # the joint tables hold every model's final parameters
    joint = many.users.orderBy("u").toPandas()
    for j, k in enumerate(many):
        own = many[k].users.orderBy("u").toPandas()
        assert all((joint[f"pu{j}_{z}"] == own[f"pu{z}"]).all() for z in range(k))
    many.release()


def test_fit_many_resumes(spark, sf_pairs, tmp_path, monkeypatch):
    run = f"{tmp_path}/run"
    whole = em.fit_many(sf_pairs, [1, 2, 4], max_iter=6, prepared=True, tol=4e-3)
    steps, step = [], em._many_step

    def failing(*a):
        if len(steps) == 2:
            raise RuntimeError("the driver is lost")
        steps.append(1)
        return step(*a)

    monkeypatch.setattr(em, "_many_step", failing)
    with pytest.raises(RuntimeError):
        em.fit_many(sf_pairs, [1, 2, 4], max_iter=6, prepared=True, tol=4e-3, run_dir=run)
    monkeypatch.setattr(em, "_many_step", step)
    again = em.fit_many(sf_pairs, [1, 2, 4], max_iter=6, prepared=True, tol=4e-3, run_dir=run)
    for k in whole:
        _same_models(again[k], whole[k])
    assert any(x is None for x in again[4].seconds) and again[4].seconds[-1] is not None
    with pytest.raises(ValueError, match="another fit"):
        em.fit_many(sf_pairs, [1, 2, 4], max_iter=6, prepared=True, tol=1e-3, run_dir=run)


def test_scratch_scope_leaves_nothing(spark, sf_pairs):
    from latentcf import session
    from latentcf.plans import queries
    from tests.conftest import SF0001

    def held():
        root = session.checkpoint_root(spark)
        fs = spark._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
        return {str(f.getPath().getName()) for f in fs.listStatus(spark._jvm.org.apache.hadoop.fs.Path(root))}

    before, tables = held(), len(spark.catalog.listTables())
    for name in ("split_test", "em_trace", "em_grid_trace", "auc_ranges", "user_item_chunks", "k_sweep_tol", "csv_rejects"):
        with session.scratch_scope(spark) as scope:
            queries.QUERIES[name](spark, SF0001).collect()
            assert name == "csv_rejects" or scope.paths
        assert held() == before, name
    assert len(spark.catalog.listTables()) == tables
    with session.scratch_scope(spark), session.scratch_scope(spark) as inner:
        kept = em.prepare_pairs(sf_pairs)
        inner.keep()
        assert kept.count() == sf_pairs.count()
    assert held() == before
