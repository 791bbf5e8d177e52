"""What large tables need: copies of tiles, counting by groups, positives sent to the tiles."""

import math

import numpy as np
import pytest

from latentcf.model import LatentClassModel
from latentcf.operators import ranks, scoring


def random_model(spark, n_users, n_items, k, seed=0):
    rng = np.random.default_rng(seed)
    a, b = rng.random((n_users, k)), rng.gamma(2, 1, (n_items, k))
    a, b = a / a.sum(axis=1, keepdims=True), b / b.sum(axis=0)
    users = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(a)], "u long, " + ", ".join(f"pu{z} double" for z in range(k)))
    items = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(b)], "s long, " + ", ".join(f"ps{z} double" for z in range(k)))
    return LatentClassModel(k=k, users=users, items=items, trace=None, passes=0, n_users=n_users, n_items=n_items), scoring.block_scores(a, b)


def test_all_pairs_in_sorted_cells_send_positives_to_the_tiles(spark, monkeypatch):
    """However many ranges, the pass over all pairs returns two rows a tile and piece, no cells."""
    m, full = random_model(spark, 40, 50, 3)
    monkeypatch.setattr(ranks, "PIECE", 40)
    monkeypatch.setattr(scoring, "LEAST_CELLS", 300)
    out, tiles = [], ranks._tiles
    monkeypatch.setattr(ranks, "_tiles", lambda *a, **b: out.append(tiles(*a, **b)) or out[-1])
    pairs = spark.createDataFrame([(i, (7 * i + j) % 50) for i in range(40) for j in range(4)], "u long, s long")
    positives = scoring.score_pairs(m, pairs).select("score")
    pos = np.array([r.score for r in positives.collect()])
    got = ranks.rank_sums(m, positives, [positives], ship_bytes=24 * 8)
    want = [sum((pos > x).sum() for x in full.ravel()) - sum((pos > x).sum() for x in pos),
            sum((pos == x).sum() for x in full.ravel()) - sum((pos == x).sum() for x in pos)]
    assert list(got) == want
    rows, cols = scoring._tile_shape(scoring.params_of(m), None, ranks.TILE)
    assert out[0].columns == ["sign", "gt", "eq"]


def test_tiles_are_cut_on_both_sides(spark):
    """900,000 users by 1,200,000 items: copies of both tables grow with the root of the tiles."""
    p = scoring.Params(spark.range(1), spark.range(1), [["a"] * 3], [["b"] * 3], 900_000, 1_200_000, 5_000_000, 8_000_000)
    rows, cols = scoring._tile_shape(p, None)
    tiles = 900_000 * 1_200_000 / scoring.TILE_CELLS
    assert tiles <= rows * cols < 1.1 * tiles
    assert rows * 1_200_000 + cols * 900_000 < 2.2 * math.sqrt(tiles * 900_000 * 1_200_000)
    rows, cols = scoring._tile_shape(p, None, scoring.COUNT_CELLS)
    assert rows * 1_200_000 + cols * 900_000 < 25_000_000
    rows, cols = scoring._tile_shape(p, None, None)  # the best items: as few item blocks as their bytes make
    assert cols == 2 and rows * cols <= 4 * spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("n, m, k", [(1, 1, 1), (70, 5000, 3), (4097, 300, 2), (600, 700, 12)])
def test_counts_by_groups_equal_brute_force(n, m, k):
    rng = np.random.default_rng(n)
    a, b = np.round(rng.random((n, k)), 2), np.round(rng.gamma(2, 1, (m, k)), 1)
    full = scoring.block_scores(a, b)
    ths = [0.0, float(full[0, 0]), float(np.median(full)), 1e-3, float(full.max()), 1e9]
    for inclusive in (True, False):
        want = np.stack([((full >= t) if inclusive else (full > t)).sum(axis=1) for t in ths], axis=1)
        assert (scoring.reaching(a, b, ths, inclusive) == want).all()


def test_large_tables_are_not_broadcast_by_default():
    """60 times sf0.1: tables of 900,000 users and 1,200,000 items of three classes go by the grid."""
    from latentcf.operators import em

    assert em.param_bytes(900_000, 3) > em.DEFAULT_BROADCAST_BYTES
    assert em._bins([2, 3, 4, 5, 6, 10, 15, 20], 20) == [[7], [3, 6], [2, 4, 5], [0, 1]]


def test_wide_joint_fit_goes_in_groups_sized_for_the_widest(spark):
    """Several groups of models, ids beyond 2^53, and the first M-step inside the cells."""
    from pyspark.sql import functions as F

    from latentcf.operators import em

    big = (1 << 53) + 1
    pairs = spark.range(6000).select((F.pmod(F.xxhash64("id"), F.lit(90)) * 2 + F.lit(big)).alias("u"),
                                     (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(70)) * 2 + F.lit(big)).alias("s")).distinct()
    ks = [1, 2, 3, 5]
    a, b = (em.fit_many(pairs, ks, max_iter=3, seed=3, broadcast_bytes=n) for n in (None, 0))
    for k in ks:
        assert b[k].logliks == pytest.approx(a[k].logliks, abs=1e-12)
    for side, key in (("users", "u"), ("items", "s")):
        left, right = (getattr(m, side).orderBy(key).collect() for m in (a, b))
        assert [r[key] for r in left] == [r[key] for r in right]
        assert abs(np.array([r[1:] for r in left]) - np.array([r[1:] for r in right])).max() < 1e-12
    layout = em.prepare_layout(pairs)
    grid = em._grid_ahead(layout, ks, 0)
    assert grid.width == 5 and grid.df.count() == layout.n_pairs
    layout.drop()
