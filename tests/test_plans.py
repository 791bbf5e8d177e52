"""Physical plan properties the design relies on."""

import io
import re
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from latentcf.operators import em, scoring
from latentcf.sources import tables
from tests.conftest import SF0001


def _plan(df) -> str:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def _tree(text: str) -> list[str]:
    return text.split("\n\n\n")[0].splitlines()


def _subtree(lines: list[str], needle: str) -> list[str]:
    i = next(n for n, line in enumerate(lines) if needle in line)
    ind = lines[i].index(needle)
    out = []
    for line in lines[i + 1:]:
        m = re.search(r"[A-Za-z]", line)
        if m is None or m.start() <= ind:
            break
        out.append(line)
    return out


def test_pairs_scan_is_pruned_and_filtered(spark):
    text = _plan(tables.purchase_pairs(spark, SF0001))
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in text
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint>" in text
    assert "IsNotNull(o_custkey)" in text and "IsNotNull(l_partkey)" in text


@pytest.fixture(scope="module")
def state(spark):
    lay = em.prepare_layout(tables.purchase_pairs(spark, SF0001))
    users, items, st = em.m_step(spark, em.initial_responsibilities(lay.df, 3, 42), 3)
    return lay, users, items


def test_broadcast_pass_has_one_exchange(spark, state):
    lay, users, items = state
    resp = em.responsibilities(lay.df, F.broadcast(users), F.broadcast(items), 3)
    lines = _tree(_plan(em.m_aggregate(resp, 3)))
    assert sum("BroadcastHashJoin" in x for x in lines) == 2
    assert sum("Expand" in x for x in lines) == 1
    shuffles = [x for x in lines if "Exchange" in x and "BroadcastExchange" not in x]
    assert len(shuffles) == 1
    assert not any("SortMergeJoin" in x for x in lines)


def test_grid_pass_moves_parameters_only(spark, state):
    lay, users, items = state
    grid = em.grid_pairs(lay.df, lay.n_pairs, 1, 1)
    try:
        lines = _tree(_plan(em.grid_aggregate(grid, users, items, [["0", "1", "2"]], ["ll"], None)))
    finally:
        spark.sql(f"DROP TABLE {grid.table}")
    # walk up from the scan of the pairs: no exchange before the cells are put together
    scan = next(n for n, x in enumerate(lines) if "latentcf_grid_" in x)
    names = [lines[n].strip(" :+-").split(" ")[0] for n in _ancestors(lines, scan)]
    assert "FlatMapCoGroupsInPandas" in names
    assert "Exchange" not in names[: names.index("FlatMapCoGroupsInPandas")]
    assert not any("ShuffledHashJoin" in x for x in lines)


def _ancestors(lines, n):
    """Indices of the ancestors of tree line n, nearest first."""
    col = lambda i: re.search(r"[A-Za-z]", lines[i]).start()
    out, c = [], col(n)
    for i in range(n - 1, -1, -1):
        if re.search(r"[A-Za-z]", lines[i]) and col(i) < c:
            out.append(i)
            c = col(i)
    return out


def test_score_pairs_broadcasts_parameters(spark, state):
    lay, users, items = state
    m = em.fit(lay, k=3, max_iter=1)
    lines = _tree(_plan(scoring.score_pairs(m, lay.df)))
    assert sum("BroadcastHashJoin" in x for x in lines) == 2
    assert not any("SortMergeJoin" in x for x in lines)
