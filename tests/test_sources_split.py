"""Sources, sinks and the split (FX1, FX2, FX4, FX8)."""

import json
import os

import pytest
from pyspark.sql import functions as F

from latentcf.operators import split
from latentcf.sources import ratings, sinks, tables
from tests.conftest import SF0001
from tests.fixtures import pairs_df

HEADER = "userId,movieId,rating,timestamp\n"
LINES = [f"{u},{s},{(u + s) % 5 + 0.5},{1500000000 + u * 7 + s}\n" for u, s in
         [(1, 10), (1, 20), (1, 30), (2, 10), (2, 20), (3, 30), (3, 40), (4, 10), (4, 40), (5, 50),
          (5, 10), (6, 20), (6, 30), (7, 40), (7, 50), (8, 10), (8, 20), (9, 30), (10, 40), (1, 10)]]


def test_ratings_one_file_and_several(spark, tmpdir_path):
    one = os.path.join(tmpdir_path, "one")
    os.makedirs(one)
    with open(os.path.join(one, "ratings.csv"), "w") as f:
        f.write(HEADER + "".join(LINES))
    several = os.path.join(tmpdir_path, "several")
    os.makedirs(several)
    for i in range(3):
        with open(os.path.join(several, f"part{i}.csv"), "w") as f:
            f.write(HEADER + "".join(LINES[i::3]))
    a = ratings.read_ratings(spark, one)
    b = ratings.read_ratings(spark, several)
    assert a.count() == 20 and b.count() == 20  # every header dropped
    assert a.schema["userId"].dataType.typeName() == "long"
    pa = ratings.interactions(a)
    assert pa.count() == 19  # the repeated (1,10) line collapses
    w = {(r.u, r.s): r.w for r in ratings.interactions(b, weighted=True).collect()}
    assert w[(1, 10)] == 2 and sum(w.values()) == 20


def test_ratings_text_items_are_trimmed(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "r.csv")
    with open(p, "w") as f:
        f.write(HEADER + "1, 10 ,4.0,1\n2,  20,3.0,2\n")
    df = ratings.read_ratings(spark, p, item_type="string")
    assert sorted(r.movieId for r in df.collect()) == ["10", "20"]


def test_pair_tables_fx2(spark):
    prof = tables.profile(tables.purchase_rows(spark, SF0001)).first()
    assert (prof.n_rows, prof.n_pairs, prof.n_users, prof.n_items) == (6000, 5382, 150, 200)
    assert tables.word_pairs(spark, SF0001).count() == 50193
    assert tables.event_pairs(spark, SF0001).count() == 75


def test_hash_split_fx2_and_properties(spark):
    pairs = tables.purchase_pairs(spark, SF0001)
    tr, te = split.hash_split(pairs, 0.1, 42)
    assert (tr.count(), te.count()) == (4860, 522)
    raw_tr, raw_te = split.raw_split(pairs, 0.1, 42)
    assert raw_tr.intersect(raw_te).count() == 0
    assert raw_tr.union(raw_te).distinct().count() == pairs.count()
    # layout independent: same halves from a reshuffled input
    tr2, te2 = split.hash_split(pairs.repartition(7), 0.1, 42)
    assert tr2.exceptAll(tr).count() == 0 and te2.exceptAll(te).count() == 0
    rs_tr, rs_te = split.random_split(pairs, 0.1, 42)
    assert rs_te.join(rs_tr.select("u").distinct(), "u", "left_anti").count() == 0


def test_cold_start_fx4(spark):
    train = pairs_df(spark, [(1, 10), (1, 20), (2, 20)])
    test = pairs_df(spark, [(1, 30), (3, 10), (2, 10), (3, 30)])
    kept = split.restrict_to_vocabulary(test, train).collect()
    assert [(r.u, r.s) for r in kept] == [(2, 10)]
    assert sorted(r.u for r in split.common_users(train, test).collect()) == [1, 2]
    assert sorted(r.s for r in split.common_items(train, test).collect()) == [10]


def test_sinks_round_trip(spark, tmpdir_path):
    df = pairs_df(spark, [(1, 10), (2, 20)]).withColumn("score", F.lit(0.5))
    sinks.write_scores(df, os.path.join(tmpdir_path, "pq"))
    assert spark.read.parquet(os.path.join(tmpdir_path, "pq")).count() == 2
    sinks.write_scores(df, os.path.join(tmpdir_path, "csv"), fmt="csv")
    back = spark.read.option("header", True).csv(os.path.join(tmpdir_path, "csv"))
    assert sorted(back.columns) == ["s", "score", "u"] and back.count() == 2
    meta = os.path.join(tmpdir_path, "meta")
    for _ in range(2):
        sinks.write_run_metadata(spark, meta, total_seconds=1.5, iterations=2, logliks=[-2.0, -1.9],
                                 seconds=[0.7, 0.8], extra={"k": 3})
    recs = [json.loads(r.value) for r in spark.read.text(meta).collect()]
    assert len(recs) == 2 and recs[0]["iterations"] == 2 and recs[0]["k"] == 3


def test_sweep_csv_fx8(spark, tmpdir_path):
    long_rows = [(k, it, -10.0 + it * 0.1 + k * 0.01) for k in (2, 3, 4, 5, 6, 10, 15, 20) for it in (1, 2, 3)]
    long_df = spark.createDataFrame(long_rows, sinks.LONG_SWEEP_SCHEMA)
    path = os.path.join(tmpdir_path, "ll")
    sinks.write_sweep_csv(long_df, path)
    files = [f for f in os.listdir(path) if f.endswith(".csv")]
    head = open(os.path.join(path, files[0])).readline().strip()
    assert head.split(";")[0] == "Iteration" and "20_cluster" in head.split(";")
    back = sinks.read_sweep_csv(spark, path)
    got = sorted((r.k, r.iteration, round(r.loglik, 9)) for r in back.collect())
    assert got == sorted((k, i, round(v, 9)) for k, i, v in long_rows)


def test_preview_is_ordered(spark):
    df = pairs_df(spark, [(3, 30), (1, 10), (2, 20)])
    assert [r.u for r in tables.preview(df, 2, ["u"]).collect()] == [1, 2]


def test_two_column_click_log_and_bad_ids(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "two.csv")
    with open(p, "w") as f:
        f.write("userId,movieId\n1,10\n2,20\n,30\n")
    got = sorted((r.u, r.s) for r in ratings.interactions(ratings.read_ratings(spark, p)).collect())
    assert got == [(1, 10), (2, 20)]  # only an empty id is no click
    q = os.path.join(tmpdir_path, "bad.csv")
    with open(q, "w") as f:
        f.write(HEADER + "1,10,1,1\n1,tt99,1,1\n2,10,1,1\n2,x7,1,1\n")
    with pytest.raises(Exception, match="tt99|x7"):
        ratings.interactions(ratings.read_ratings(spark, q)).collect()
    text = ratings.interactions(ratings.read_ratings(spark, q, item_type="string"))
    assert sorted((r.u, r.s) for r in text.collect()) == [(1, "10"), (1, "tt99"), (2, "10"), (2, "x7")]


def test_rejected_lines_are_kept_apart(spark, tmpdir_path):
    lines = ["userId,movieId,rating,timestamp", "1,10,4.5,7", "2", " 3 , 30 ", ",40,1,1", "5,,1,1", "x,60,1,1", "7,y", "", "8,80,1,1,9,9", "   "]
    with open(f"{tmpdir_path}/a.csv", "w") as f:
        f.write("\n".join(lines) + "\n")
    with open(f"{tmpdir_path}/b.csv", "w") as f:
        f.write("userId,movieId,rating,timestamp\n1,11,2.0,3\n")
    read = ratings.read_ratings_checked(spark, tmpdir_path)
    assert sorted((r.userId, r.movieId, r.rating) for r in read.clicks.collect()) == [
        (1, 10, 4.5), (1, 11, 2.0), (3, 30, None), (8, 80, 1.0)]
    rejects = {(r.line.strip(), r.reason) for r in read.rejects.collect()}
    assert {("2", "one field"), ("x,60,1,1", "user is no whole number"), ("7,y", "item is no whole number")} <= rejects
    assert {reason for _, reason in rejects} == {"one field", "empty user", "empty item", "user is no whole number", "item is no whole number"}
    assert all(r.file.endswith("a.csv") for r in read.rejects.collect())
    counts = read.counts()
    assert counts[""] == 4 and sum(counts.values()) == 9 + (1 if ("", "one field") in rejects else 0)
    text = ratings.read_ratings_checked(spark, tmpdir_path, item_type="string", user_type="string")
    assert text.clicks.count() == 6 and {r.reason for r in text.rejects.collect()} == {"one field", "empty user", "empty item"}


def test_four_line_file_loses_nothing(spark, tmpdir_path):
    with open(f"{tmpdir_path}/a.csv", "w") as f:
        f.write("userId,movieId\n1,10\n2\n,30\n4,40\n")
    assert ratings.read_ratings_checked(spark, tmpdir_path).counts() == {"": 2, "one field": 1, "empty user": 1}
