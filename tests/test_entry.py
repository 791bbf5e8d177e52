"""Driver contract: entry smoke, registry shape, oracle agreement on sf0.001."""

import hashlib
import os

import duckdb
import pytest

import __spark_entry__ as E
from tests.conftest import SF0001

CHEAP = ["profile_counts", "split_test", "common_items", "posterior", "loglik_mean", "em_trace",
         "score_test", "confusion_test", "auc", "recommend_top5", "user_items", "weighted_m_step"]


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["k", "threshold", "precision_q", "recall_q", "f1_q"]


def test_registry_shape():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert {n for n in set(q) - set(o) if not n.startswith("op") and n != "pipeline"} == set()
    assert len(q) >= 40


def _hash(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    hs = sorted(hashlib.md5(repr(tuple(r[i] for i in order)).encode()).hexdigest() for r in rows)
    return hashlib.md5("".join(hs).encode()).hexdigest()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("orders", "lineitem", "documents", "events"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF0001, t + '.parquet')}')")
    return c


@pytest.mark.parametrize("name", CHEAP)
def test_oracle_agreement_sf0001(spark, con, name):
    df = E.queries()[name](spark, SF0001)
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    orows = [tuple(r) for r in res.fetchall()]
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert _hash(rows, df.columns) == _hash(orows, ocols)


def test_tolerance_stop_matches_sql_cut(spark, con):
    """On the dense events domain EM converges fast: the Spark stop must equal the SQL cut."""
    from latentcf.operators import em
    from latentcf.plans import oracle as O
    from latentcf.sources import tables

    tol, max_iter = 1e-3, 12
    m = em.fit(tables.event_pairs(spark, SF0001), k=2, max_iter=max_iter, seed=42, tol=tol)
    ch = O.Chain()
    ep = O.event_pairs(ch)
    _, _, lls = O.em(ch, ep, 2, max_iter, 42, tag="t_")
    ch.add("trc", " UNION ALL ".join(f"SELECT {i + 1} AS iteration, {x} AS ll" for i, x in enumerate(lls)))
    sql = ch.sql(f"SELECT min(iteration) FROM (SELECT iteration, ll, lag(ll) OVER (ORDER BY iteration) AS prev "
                 f"FROM trc) WHERE prev IS NOT NULL AND abs(ll - prev) < {O.dbl(tol)}")
    stop = con.execute(sql).fetchone()[0]
    assert stop is not None and stop < max_iter
    assert m.passes == stop
