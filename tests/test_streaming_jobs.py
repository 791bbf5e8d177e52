"""Streaming adapters and end-to-end jobs."""

import json
import os

import pytest
from pyspark.sql import functions as F

from latentcf.operators import scoring
from latentcf.plans import jobs
from latentcf.streaming import append_pairs, dedup_pairs, read_ratings_stream, score_stream
from tests.fixtures import fx6_model, planted_blocks

HEADER = "userId,movieId,rating,timestamp\n"


def _write(dirpath, name, rows):
    os.makedirs(dirpath, exist_ok=True)
    with open(os.path.join(dirpath, name), "w") as f:
        f.write(HEADER + "".join(f"{u},{s},4.0,{ts}\n" for u, s, ts in rows))


def test_score_stream_matches_batch(spark, tmpdir_path):
    m = fx6_model(spark)
    src = os.path.join(tmpdir_path, "in")
    _write(src, "a.csv", [(1, 10, 100), (1, 20, 110), (9, 10, 120)])
    _write(src, "b.csv", [(2, 30, 130), (2, 10, 140)])
    got = []
    q = (score_stream(m, read_ratings_stream(spark, src), threshold=0.5).writeStream
         .foreachBatch(lambda df, _: got.extend(df.collect())).trigger(availableNow=True)
         .option("checkpointLocation", os.path.join(tmpdir_path, "ck")).start())
    q.awaitTermination(120)
    res = {(r.u, r.s): (round(r.score, 12), r.pred) for r in got}
    assert res == {(1, 10): (0.9, True), (1, 20): (0.5, True), (2, 30): (0.1, False), (2, 10): (0.6, True)}


def test_dedup_and_append(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "in")
    _write(src, "a.csv", [(1, 10, 100), (1, 10, 105), (1, 20, 110)])
    _write(src, "b.csv", [(2, 30, 130), (1, 20, 131)])
    out = os.path.join(tmpdir_path, "pairs")
    q = append_pairs(dedup_pairs(read_ratings_stream(spark, src), "1 hour"), out,
                     checkpoint=os.path.join(tmpdir_path, "ck"))
    q.awaitTermination(120)
    rows = sorted((r.u, r.s) for r in spark.read.parquet(out).collect())
    assert rows == [(1, 10), (1, 20), (2, 30)]


def test_predicted_pairs(spark):
    m = fx6_model(spark)
    got = sorted((r.u, r.s) for r in scoring.predicted_pairs(m, 0.5).collect())
    assert got == [(1, 10), (1, 20), (2, 10)]
    seen = spark.createDataFrame([(1, 10)], "u long, s long")
    got = sorted((r.u, r.s) for r in scoring.predicted_pairs(m, 0.5, inclusive=False, seen=seen).collect())
    assert got == [(2, 10)]


def test_cluster_job_and_notebook_run(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "ratings")
    rows = [(r.u, r.s, 1) for r in planted_blocks(spark).collect()]
    _write(src, "r.csv", rows)
    out = os.path.join(tmpdir_path, "out")
    meta = os.path.join(tmpdir_path, "meta")
    m = jobs.cluster_em_job(spark, src, out, meta, k=3, passes=3, top_n=5, threshold=0.05)
    assert spark.read.parquet(f"{out}/p_z_given_u").count() == 60
    assert spark.read.parquet(f"{out}/p_s_given_z").count() == 60
    assert spark.read.parquet(f"{out}/top_5").count() == 300
    assert spark.read.parquet(f"{out}/p_s_u_above").where(F.col("score") < 0.05).count() == 0
    rec = json.loads(spark.read.text(meta).first().value)
    assert rec["iterations"] == 3 and len(rec["logliks"]) == 3
    run = jobs.notebook_run(spark, src, k=3, passes=10, thresholds=[0.05, 0.02])
    assert run["sweep"].count() == 2 and run["auc"].first()["auc"] > 0.7


def test_cluster_job_keeps_rejected_lines(spark, tmpdir_path):
    src, out, bad = (os.path.join(tmpdir_path, x) for x in ("ratings", "out", "rejects"))
    _write(src, "r.csv", [(r.u, r.s, 1) for r in planted_blocks(spark).collect()])
    with open(os.path.join(src, "s.csv"), "w") as f:
        f.write("userId,movieId\n1,1000\nx,1001\n7\n")
    with pytest.raises(Exception, match="no whole number"):
        jobs.cluster_em_job(spark, src, out, k=2, passes=1, top_n=None)
    m = jobs.cluster_em_job(spark, src, out, k=2, passes=1, top_n=None, rejects_path=bad)
    assert m.n_users == 60
    assert {(r.line, r.reason) for r in spark.read.parquet(bad).collect()} == {
        ("x,1001", "user is no whole number"), ("7", "one field")}


def test_lda_run(spark, tmpdir_path):
    run = jobs.lda_run(spark, planted_blocks(spark), k=3, max_iter=5, threshold=1e-5)
    r = run["metrics"].first()
    assert r["tp"] + r["fn"] > 0 and r["threshold"] == 1e-5


def test_model_save_load_round_trip(spark, tmpdir_path):
    from latentcf.model import LatentClassModel
    from latentcf.operators import em, scoring

    pairs = planted_blocks(spark)
    m = em.fit(pairs, k=3, max_iter=2)
    path = os.path.join(tmpdir_path, "model")
    m.save(path)
    back = LatentClassModel.load(spark, path)
    assert (back.k, back.passes, back.n_users, back.n_items) == (3, 2, 60, 60)
    assert back.logliks == m.logliks
    a = sorted((r.u, r.s, r.score) for r in scoring.score_pairs(m, pairs).collect())
    b = sorted((r.u, r.s, r.score) for r in scoring.score_pairs(back, pairs).collect())
    assert a == b
