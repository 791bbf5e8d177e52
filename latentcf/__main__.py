"""Command line for the end-to-end jobs (``spark-submit`` or ``python -m latentcf``).

    spark-submit --py-files latentcf.zip -m latentcf fit --input hdfs:///ratings --output hdfs:///out \\
        --k 3 --passes 30 --metadata hdfs:///out/meta
    python -m latentcf evaluate --input ratings.csv --k 3 --passes 30 --thresholds 1e-3 1e-4
    python -m latentcf lda --input ratings.csv --k 10 --passes 20
    python -m latentcf ksweep --input ratings.csv --ks 2 3 4 5 --passes 30 --csv out/loglik

The session comes from the environment (spark-submit or the builder's
defaults); ``spark.checkpoint.dir`` must name a shared folder on a cluster.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="latentcf")
    sub = p.add_subparsers(dest="cmd", required=True)
    f = sub.add_parser("fit", help="fit on all pairs and write the model, trace and top-n")
    f.add_argument("--input", required=True)
    f.add_argument("--output", required=True)
    f.add_argument("--metadata")
    f.add_argument("--k", type=int, default=3)
    f.add_argument("--passes", type=int, default=3)
    f.add_argument("--seed", type=int, default=42)
    f.add_argument("--top-n", type=int, default=10)
    f.add_argument("--threshold", type=float)
    f.add_argument("--rejects", help="folder for lines that are no clicks; without it such an id is an error")
    e = sub.add_parser("evaluate", help="split, fit, threshold sweep and AUC on held-out pairs")
    e.add_argument("--input", required=True)
    e.add_argument("--k", type=int, default=3)
    e.add_argument("--passes", type=int, default=30)
    e.add_argument("--alpha", type=float, default=0.1)
    e.add_argument("--seed", type=int, default=42)
    e.add_argument("--thresholds", type=float, nargs="+")
    e.add_argument("--strict", action="store_true")
    lda = sub.add_parser("lda", help="split, LDA, strict-threshold metrics")
    lda.add_argument("--input", required=True)
    lda.add_argument("--k", type=int, default=10)
    lda.add_argument("--passes", type=int, default=20)
    lda.add_argument("--threshold", type=float, default=1e-5)
    ks = sub.add_parser("ksweep", help="log-likelihood trace for several k")
    ks.add_argument("--input", required=True)
    ks.add_argument("--ks", type=int, nargs="+", default=[2, 3, 4, 5, 6, 10, 15, 20])
    ks.add_argument("--passes", type=int, default=30)
    ks.add_argument("--csv")
    ks.add_argument("--tol", type=float, help="each k stops once its log-likelihood moves by less")
    ks.add_argument("--run-dir", help="shared folder from which a restarted sweep resumes")
    return p


def main(argv: list[str] | None = None) -> int:
    from latentcf.plans import jobs

    a = _parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"latentcf-{a.cmd}").getOrCreate()
    if a.cmd == "fit":
        m = jobs.cluster_em_job(spark, a.input, a.output, a.metadata, k=a.k, passes=a.passes, seed=a.seed,
                                    top_n=a.top_n, threshold=a.threshold, rejects_path=a.rejects)
        print(json.dumps({"passes": m.passes, "logliks": m.logliks, "seconds": m.seconds}))
    elif a.cmd == "evaluate":
        run = jobs.notebook_run(spark, a.input, k=a.k, passes=a.passes, alpha=a.alpha, seed=a.seed,
                                    thresholds=a.thresholds, inclusive=not a.strict)
        for r in run["sweep"].orderBy("threshold").collect():
            print(json.dumps(r.asDict(), default=int))
        print(json.dumps(run["auc"].first().asDict(), default=int))
    elif a.cmd == "lda":
        run = jobs.lda_run(spark, a.input, k=a.k, max_iter=a.passes, threshold=a.threshold)
        print(json.dumps(run["metrics"].first().asDict(), default=int))
    elif a.cmd == "ksweep":
        df = jobs.k_selection(spark, a.input, ks=a.ks, passes=a.passes, sweep_csv=a.csv, tol=a.tol, run_dir=a.run_dir)
        for r in df.orderBy("k", "iteration").collect():
            print(json.dumps(r.asDict(), default=int))
    return 0


if __name__ == "__main__":
    sys.exit(main())
