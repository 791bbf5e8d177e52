"""Benchmark: the headline jobs at $BENCH_SF_DIR on local[$BENCH_CPUS].

purchases: pairs -> split -> EM fit (k=3, 30 passes) -> scoring / threshold
sweep / AUC / top-5 -> LDA (20 passes) -> k sweep (8 k) -> PR curve (5 k);
documents by words: pairs -> split -> EM fit (k=4, 30 passes) -> AUC.
Prints ONE JSON line: {"metric", "value", "unit", "queries", "sf", ...}.
Every step forces full execution (noop sink or a small collect).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from latentcf.operators import em, evaluation, scoring, selection, topics  # noqa: E402
from latentcf.operators.split import hash_split  # noqa: E402
from latentcf.session import local_session  # noqa: E402
from latentcf.sources import tables  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
K = int(os.environ.get("BENCH_K", "3"))
PASSES = int(os.environ.get("BENCH_PASSES", "30"))
SWEEP = [1e-3, 1e-4, 1e-5, 1e-6, 8e-5, 6e-5, 5e-5, 4e-5, 2e-5]


def _noop(df):
    df.write.format("noop").mode("overwrite").save()


def main():
    spark = local_session(CPUS, shuffle_partitions=int(CPUS) * 2, app="latentcf-bench")
    if os.environ.get("BENCH_SCRATCH"):  # else the session's own folder
        spark.sparkContext.setCheckpointDir(os.environ["BENCH_SCRATCH"])
    times: dict[str, float] = {}
    info: dict[str, object] = {}

    t = time.time()
    pairs = em.prepare_pairs(tables.purchase_pairs(spark, SF_DIR))
    info["pairs"] = pairs.count()
    times["pairs"] = time.time() - t

    t = time.time()
    train, test = hash_split(pairs, 0.1, 42)
    train = em.prepare_pairs(train, distinct=True)
    test = em.prepare_pairs(test, distinct=True)
    info["train"], info["test"] = train.count(), test.count()
    times["split"] = time.time() - t

    t = time.time()
    model = em.fit(train, k=K, max_iter=PASSES, seed=42, prepared=True)
    times["em_fit"] = time.time() - t
    info["em_passes"] = model.passes
    info["em_seconds_per_pass"] = round(sum(model.seconds) / max(1, len(model.seconds)), 3)
    info["loglik_last"] = model.logliks[-1]
    info["users"], info["items"] = model.n_users, model.n_items

    # the path chosen when parameter tables exceed the broadcast bound, forced here
    t = time.time()
    big = em.fit(train, k=K, max_iter=3, seed=42, prepared=True, broadcast_bytes=0)
    times["em_fit_grid_3pass"] = time.time() - t
    info["em_grid_seconds_per_pass"] = round(sum(big.seconds) / max(1, len(big.seconds)), 3)
    info["em_grid_loglik_matches"] = abs(big.logliks[-1] - model.logliks[2]) < 1e-9 if PASSES >= 3 else None

    t = time.time()
    _noop(scoring.score_pairs(model, test))
    times["score_test"] = time.time() - t

    t = time.time()
    sw = evaluation.threshold_sweep(model, train, test, SWEEP).collect()
    times["threshold_sweep"] = time.time() - t
    info["all_pairs_scored"] = model.n_users * model.n_items
    info["best_f1"] = max((r["f1"] or 0.0) for r in sw)

    t = time.time()
    a = evaluation.auc(model, train, test).first()
    times["auc"] = time.time() - t
    info["auc"] = a["auc"]

    t = time.time()
    _noop(scoring.recommend(model, 5, train))
    times["recommend_top5"] = time.time() - t

    t = time.time()
    lda = topics.fit_lda(train, k=10, max_iter=int(os.environ.get("BENCH_LDA_ITER", "20")), seed=42, prepared=True)
    _noop(scoring.user_summary(lda.as_model()))
    times["lda_fit_score"] = time.time() - t

    t = time.time()
    _noop(selection.k_sweep(train, [2, 3, 4, 5, 6, 10, 15, 20], 3, 42))
    times["k_sweep_8k_3pass"] = time.time() - t
    t = time.time()
    _noop(evaluation.pr_curve(train, test, [3, 5, 10, 15, 20], SWEEP, 3, 42))
    times["pr_curve_5k_3pass"] = time.time() - t

    # documents by words (whole texts): 4x the pairs, 10x the items, real latent structure
    t = time.time()
    words = em.prepare_pairs(tables.word_pairs(spark, SF_DIR))
    wtrain, wtest = hash_split(words, 0.1, 42)
    wtrain, wtest = em.prepare_pairs(wtrain, distinct=True), em.prepare_pairs(wtest, distinct=True)
    info["words_pairs"] = words.count()
    times["words_pairs_split"] = time.time() - t
    t = time.time()
    wm = em.fit(wtrain, k=4, max_iter=PASSES, seed=42, prepared=True)
    times["words_em_fit_k4"] = time.time() - t
    info["words_docs"], info["words_vocab"] = wm.n_users, wm.n_items
    info["words_em_seconds_per_pass"] = round(sum(wm.seconds) / max(1, len(wm.seconds)), 3)
    t = time.time()
    info["words_test_auc_k4"] = evaluation.auc(wm, wtrain, wtest).first()["auc"]
    times["words_auc"] = time.time() - t

    total = sum(times.values())
    sf = os.path.basename(SF_DIR.rstrip("/")).replace("sf", "")
    out = {
        "metric": "end_to_end_seconds",
        "value": round(total, 3),
        "unit": "sec",
        "queries": {k: round(v, 3) for k, v in times.items()},
        "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
        "cores": int(CPUS),
        "k": K,
        "info": info,
    }
    print(json.dumps(out))


if __name__ == "__main__":
    main()
