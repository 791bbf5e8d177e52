"""Registered queries: Spark plans over the driver tables + independent oracle SQL.

Every query reads the given tables (orders ⋈ lineitem purchases, documents,
events) in full. Doubles are returned as ``*_q`` fingerprints
(floor(x*1e9+0.5), bigint) so that two engines summing in different orders
still compare equal.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latentcf.functions.numeric import quantise
from latentcf.plans import oracle as O
from latentcf.session import scratch_path
from latentcf.sources import ratings, sinks, tables
from latentcf.operators import em, evaluation, scoring, split, staged, topics, selection

# Fixed values of the registered queries (both engines use them).
K = 3
SEED = 42
ALPHA = 0.1
PASSES = 3
TRACE_PASSES = 30
THRESHOLD = 5e-4
SWEEP = [1e-3, 8e-4, 6e-4, 5e-4, 4e-4, 2e-4, 1e-4, 1e-5, 1e-6]
TOPN = 5
K_SWEEP = [2, 3, 4, 5, 6, 10, 15, 20]
PR_KS = [3, 5, 10, 15, 20]
LDA_K = 10
LDA_ITER = 20
LDA_ALPHA = 50.0 / LDA_K
LDA_ETA = 0.1
LDA_THRESHOLD = 1e-5
TOL = 0.005
TOL_MAX_ITER = 10
TOL_KS = [1, 2, 3, 5]
AUC_SHIP_BYTES = 24 * 100
LIST_ITEMS = 8
PREVIEW = 20
METADATA_RUNS = [(2, 3), (3, 2)]
# every user x event-type score is exactly this on the full grid with one class
EVENT_THRESHOLD = 0.2


def q9(name: str, alias: str | None = None):
    """Fingerprint at 1e-9: tiny values (p(s|z), scores) and values that are
    bit-identical in both engines (keyed draws, ratios of exact counts)."""
    return quantise(F.col(name), 1e9).alias(alias or f"{name}_q")


def q6(name: str, alias: str | None = None):
    """Fingerprint at 1e-6 for O(0.1..1e5) sums (posteriors, p(z|u), masses,
    totals, log-likelihoods): two engines summing in different orders differ
    by ~1e-15 relative, which a 1e-9 grid on such magnitudes would cross at
    random about once per million values; 1e-6 keeps that negligible."""
    return quantise(F.col(name), 1e6).alias(alias or f"{name}_q")


# ---------------------------------------------------------------- shared Spark inputs


def _pairs(spark, d):
    return tables.purchase_pairs(spark, d)


def _split(spark, d, pairs=None):
    """Train and test, each written once: queries use them several times."""
    pairs = em.prepare_pairs(_pairs(spark, d) if pairs is None else pairs)
    train, test = split.raw_split(pairs, ALPHA, SEED)
    train = em.prepare_pairs(train, distinct=True)
    return train, em.prepare_pairs(split.restrict_to_vocabulary(test, train), distinct=True)


def _fit(spark, d, k=K, passes=PASSES):
    train, test = _split(spark, d)
    model = em.fit(train, k=k, max_iter=passes, seed=SEED, prepared=True)
    return model, train, test


def _long(df: DataFrame, key: str, prefix: str, k: int, out: str) -> DataFrame:
    """wide (key, prefix0..) -> long (key, z, out)."""
    stack = ", ".join(f"{z}, {prefix}{z}" for z in range(k))
    return df.selectExpr(key, f"stack({k}, {stack}) as (z, {out})")


# ---------------------------------------------------------------- Spark side


def q_profile_counts(spark, d):
    return tables.profile(tables.purchase_rows(spark, d))


def q_pairs_distinct(spark, d):
    return _pairs(spark, d)


def q_pairs_weighted(spark, d):
    return tables.purchase_pairs(spark, d, weighted=True)


def q_word_pairs_profile(spark, d):
    wp = tables.word_pairs(spark, d)
    return wp.agg(F.count(F.lit(1)).alias("n_pairs"), F.countDistinct("u").alias("n_docs"),
                  F.countDistinct("s").alias("n_words"))


def q_event_pairs(spark, d):
    return tables.event_pairs(spark, d)


def q_split_train(spark, d):
    return _split(spark, d)[0]


def q_split_test(spark, d):
    return _split(spark, d)[1]


def q_word_split_test(spark, d):
    """Words are rare enough that the cold-start rule drops test rows here."""
    return _split(spark, d, tables.word_pairs(spark, d))[1]


def q_common_users(spark, d):
    train, test_raw = split.raw_split(_pairs(spark, d), ALPHA, SEED)
    return split.common_users(train, test_raw)


def q_common_items(spark, d):
    train, test_raw = split.raw_split(_pairs(spark, d), ALPHA, SEED)
    return split.common_items(train, test_raw)


def _step(spark, d):
    return staged.one_step(_pairs(spark, d), K, SEED)


def q_latent_expand(spark, d):
    return _step(spark, d)["q0"].select("u", "s", "z", q9("q", "q0_q"))


def q_item_class_counts(spark, d):
    return _step(spark, d)["n_sz"].select("s", "z", q6("n_sz"))


def q_class_totals(spark, d):
    return _step(spark, d)["n_z"].select("z", q6("n_z"))


def q_p_item_given_class(spark, d):
    return _step(spark, d)["p_sz"].select("s", "z", q9("p_sz"))


def q_user_class_mass(spark, d):
    return _step(spark, d)["mass"].select("u", "z", q6("mass"))


def q_user_totals(spark, d):
    return _step(spark, d)["totals"].select("u", q6("total"))


def q_p_class_given_user(spark, d):
    return _step(spark, d)["p_zu"].select("u", "z", q6("p_zu"))


def q_param_join(spark, d):
    return _step(spark, d)["param_join"].select("u", "s", "z", q6("p_zu"), q9("p_sz"))


def q_evidence(spark, d):
    return _step(spark, d)["evidence"].select("u", "s", q9("evidence"))


def q_posterior(spark, d):
    return _step(spark, d)["posterior"].select("u", "s", "z", q6("q"))


def q_loglik_mean(spark, d):
    return _step(spark, d)["loglik"].select(q6("loglik"), "n_pairs")


def q_loglik_negative(spark, d):
    st = _step(spark, d)
    scores = st["evidence"].withColumnRenamed("evidence", "score")
    return staged.negative_loglik(scores, _pairs(spark, d)).select(q6("neg_loglik"))


def q_em_trace(spark, d):
    m, _, _ = _fit(spark, d, passes=TRACE_PASSES)
    return m.trace.select("iteration", q6("loglik"))


def q_em_grid_trace(spark, d):
    """The path beyond the broadcast limit, forced."""
    train, _ = _split(spark, d)
    m = em.fit(train, k=K, max_iter=PASSES, seed=SEED, prepared=True, broadcast_bytes=0)
    return m.trace.select("iteration", q6("loglik"))


def q_weighted_em_trace(spark, d):
    wp = tables.purchase_pairs(spark, d, weighted=True)
    m = em.fit(wp, k=K, max_iter=PASSES, seed=SEED, weight_col="w")
    return m.trace.select("iteration", q6("loglik"))


def q_em_items(spark, d):
    m, _, _ = _fit(spark, d)
    return _long(m.items, "s", "ps", K, "p").select("s", "z", q9("p"))


def q_em_users(spark, d):
    m, _, _ = _fit(spark, d)
    return _long(m.users, "u", "pu", K, "p").select("u", "z", q6("p"))


def q_em_converged(spark, d):
    train, _ = _split(spark, d)
    m = em.fit(train, k=K, max_iter=TOL_MAX_ITER, seed=SEED, tol=TOL, prepared=True)
    return m.trace.select("iteration", q6("loglik"))


def q_score_observed(spark, d):
    m, train, _ = _fit(spark, d)
    return scoring.score_pairs(m, train).select("u", "s", q9("score"))


def q_score_test(spark, d):
    m, _, test = _fit(spark, d)
    return scoring.score_pairs(m, test).select("u", "s", q9("score"))


def q_score_all_summary(spark, d):
    m, _, _ = _fit(spark, d)
    return scoring.user_summary(m).select("u", "n_items", q6("score_sum"), q9("score_max"))


def q_predict_inclusive(spark, d):
    m, _, _ = _fit(spark, d)
    return scoring.positive_counts(m, [THRESHOLD], inclusive=True, per_user=True)


def q_predict_strict(spark, d):
    m, _, _ = _fit(spark, d)
    return scoring.positive_counts(m, [THRESHOLD], inclusive=False, per_user=True)


def _event_predictions(spark, d, inclusive):
    """One class on the full user x event-type grid: scores meet the threshold exactly, so the
    inclusive and the strict rule part."""
    m = em.fit(tables.event_pairs(spark, d), k=1, max_iter=2, seed=SEED)
    exact = scoring.score_pairs(m, tables.event_pairs(spark, d)).agg(F.max("score")).first()[0]
    return scoring.positive_counts(m, [exact], inclusive=inclusive, per_user=True).select("u", "n_pos")


def q_predict_event_inclusive(spark, d):
    return _event_predictions(spark, d, True)


def q_predict_event_strict(spark, d):
    return _event_predictions(spark, d, False)


def q_exclude_seen(spark, d):
    """Scores of all raw test pairs, then the pairs of the users' even items dropped as seen."""
    m, train, test = _fit(spark, d)
    return scoring.exclude_seen(scoring.score_pairs(m, test), test.where("s % 2 = 0").union(train)).select("u", "s", q9("score"))


def q_unseen_pairs(spark, d):
    m, train, _ = _fit(spark, d)
    pc = scoring.positive_counts(m, [THRESHOLD], inclusive=True, per_user=True)
    tr = scoring.score_pairs(m, train).groupBy("u").agg(
        F.count(F.lit(1)).alias("n_tr"), F.count_if(F.col("score") >= F.lit(THRESHOLD)).alias("tr_pos"))
    return pc.join(tr, "u").select(
        "u", (F.lit(m.n_items) - F.col("n_tr")).cast("bigint").alias("n_unseen"),
        (F.col("n_pos") - F.col("tr_pos")).cast("bigint").alias("n_unseen_pos"))


def _conf_out(df):
    return df.select("threshold", *_counts(), q9("precision"), q9("recall"), q9("f1"))


def _counts():
    return [F.col(c).cast("bigint").alias(c) for c in ("tp", "fp", "fn", "tn")]


def q_confusion_test(spark, d):
    m, train, test = _fit(spark, d)
    return _conf_out(evaluation.confusion(m, train, test, [THRESHOLD], True, "test"))


def q_confusion_train(spark, d):
    m, train, test = _fit(spark, d)
    return _conf_out(evaluation.confusion(m, train, None, [THRESHOLD], True, "train"))


def q_threshold_sweep(spark, d):
    m, train, test = _fit(spark, d)
    return evaluation.threshold_sweep(m, train, test, SWEEP).select("threshold", *_counts())


def q_pr_curve(spark, d):
    train, test = _split(spark, d)
    return evaluation.pr_curve(train, test, PR_KS, SWEEP, PASSES, SEED).select(
        "k", "threshold", q9("precision"), q9("recall"), q9("f1"))


def q_roc_points(spark, d):
    m, train, test = _fit(spark, d)
    return evaluation.roc_points(evaluation.threshold_sweep(m, train, test, SWEEP)).select(
        "threshold", q9("fpr"), q9("tpr"))


def q_auc(spark, d):
    m, train, test = _fit(spark, d)
    return evaluation.auc(m, train, test).select(q9("auc"), "n_pos", F.col("n_neg").cast("bigint").alias("n_neg"))


def q_auc_ranges(spark, d):
    """The same with the positives cut into ranges, as beyond the broadcast bound."""
    m, train, test = _fit(spark, d)
    return evaluation.auc(m, train, test, ship_bytes=AUC_SHIP_BYTES).select(
        q9("auc"), "n_pos", F.col("n_neg").cast("bigint").alias("n_neg"))


def q_recommend_top5(spark, d):
    m, train, _ = _fit(spark, d)
    return scoring.recommend(m, TOPN, train).select("u", "rank", "s", q9("score"))


def q_user_items(spark, d):
    train, _ = _split(spark, d)
    return topics.user_item_lists(train).select(
        "u", F.array_join(F.col("items").cast("array<string>"), ",").alias("items"))


def q_user_item_chunks(spark, d):
    """The users' lists in pieces of bounded length."""
    train, _ = _split(spark, d)
    return topics.user_item_chunks(train, LIST_ITEMS).select(
        "u", "chunk", F.array_join(F.col("items").cast("array<string>"), ",").alias("items"))


def q_preview(spark, d):
    return tables.preview(_pairs(spark, d), PREVIEW, ["u", "s"])


def q_max_item(spark, d):
    train, _ = _split(spark, d)
    return topics.max_item(train)


def q_user_vectors(spark, d):
    train, _ = _split(spark, d)
    entries, size = topics.user_vectors(train)
    return topics.vector_stats(entries, size)


def q_user_vector_entries(spark, d):
    train, _ = _split(spark, d)
    return topics.user_vectors(train)[0]


def _lda(spark, d):
    train, test = _split(spark, d)
    return topics.fit_lda(train, k=LDA_K, max_iter=LDA_ITER, seed=SEED, alpha=LDA_ALPHA, eta=LDA_ETA, prepared=True), train, test


def q_lda_items(spark, d):
    return _lda(spark, d)[0].items_long.select("topic", "s", q9("weight"))


def q_lda_users(spark, d):
    return _lda(spark, d)[0].users_long.select("u", "topic", q6("weight"))


def q_lda_scores(spark, d):
    return scoring.user_summary(_lda(spark, d)[0].as_model()).select("u", "n_items", q6("score_sum"), q9("score_max"))


def q_lda_confusion_strict(spark, d):
    res, train, test = _lda(spark, d)
    return _conf_out(evaluation.confusion(res.as_model(), train, test, [LDA_THRESHOLD], False, "test"))


def _csv_folder(spark, rows: DataFrame, name: str) -> str:
    """``rows`` as headed, blank-padded CSV in several files (the layout the click logs come in)."""
    path = scratch_path(spark, name)
    padded = rows.select(*[F.concat(F.lit(" "), F.col(c).cast("string"), F.lit("  ")).alias(c) for c in rows.columns])
    (padded.repartition(4).write.option("header", True).option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(path))
    return path


def q_csv_round_trip(spark, d):
    """Purchases written as ratings CSV and read back through the CSV source."""
    rows = tables.purchase_rows(spark, d).select(F.col("u").alias("userId"), F.col("s").alias("movieId"),
                                                 F.lit(1.0).alias("rating"), F.lit(0).alias("timestamp"))
    path = _csv_folder(spark, rows, "csv-ratings")
    return ratings.interactions(ratings.read_ratings(spark, path, item_type="long"), weighted=True)


def _csv_with_bad_lines(spark, d):
    """Purchases as ratings CSV; by user and item some lines have one field, an empty id or a word for a number."""
    rows = tables.purchase_rows(spark, d)
    u, s = F.col("u").cast("string"), F.col("s").cast("string")
    kind = (F.col("u") * 31 + F.col("s")) % 10
    line = (F.when(kind == 0, u).when(kind == 1, F.concat(F.lit(" ,"), s, F.lit(",1.0,0")))
            .when(kind == 2, F.concat(u, F.lit(","))).when(kind == 3, F.concat(F.lit("u"), u, F.lit(","), s, F.lit(",1.0,0")))
            .when(kind == 4, F.concat(u, F.lit(",s"), s)).when(kind == 5, F.concat(u, F.lit(","), s))
            .otherwise(F.concat(F.lit(" "), u, F.lit(" ,"), s, F.lit(" ,4.5,7"))))
    path = scratch_path(spark, "csv-bad")
    lines = rows.select(line.alias("userId,movieId,rating,timestamp")).repartition(4)
    (lines.write.option("header", True).option("quote", "\u0000").option("sep", "\u0001")
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return ratings.read_ratings_checked(spark, path)


def q_csv_rejects(spark, d):
    """The lines set aside, by text and reason."""
    rejects = _csv_with_bad_lines(spark, d).rejects
    return rejects.groupBy("line", "reason").agg(F.count(F.lit(1)).alias("n"))


def q_csv_accepted(spark, d):
    """The clicks of the same files: every line is in one of the two."""
    return ratings.interactions(_csv_with_bad_lines(spark, d).clicks, weighted=True)


def q_trace_csv(spark, d):
    """A fit's trace through its CSV sink and back; every pass has a time."""
    m, _, _ = _fit(spark, d)
    path = scratch_path(spark, "csv-trace")
    sinks.write_trace(m.trace, path)
    return sinks.read_trace(spark, path).select("iteration", q6("loglik"), (F.col("seconds") > 0).alias("timed"))


def q_run_metadata(spark, d):
    """Two runs recorded one after the other and read back."""
    train, _ = _split(spark, d)
    path = scratch_path(spark, "run-metadata")
    for k, passes in METADATA_RUNS:
        m = em.fit(train, k=k, max_iter=passes, seed=SEED, prepared=True)
        sinks.write_run_metadata(spark, path, total_seconds=sum(m.seconds), iterations=m.passes, logliks=m.logliks,
                                 seconds=m.seconds, extra={"k": k})
    runs = sinks.read_run_metadata(spark, path, "k int")
    each = runs.select("k", "iterations", F.size("iteration_seconds").alias("n_seconds"),
                       F.posexplode("logliks").alias("at", "loglik"))
    return each.select("k", "iterations", "n_seconds", (F.col("at") + 1).cast("int").alias("iteration"), q6("loglik"))


def q_csv_sweep(spark, d):
    """The k sweep through its ';' separated table and back."""
    path = scratch_path(spark, "csv-sweep")
    sinks.write_sweep_csv(selection.k_sweep(_split(spark, d)[0], [2, 3], PASSES, SEED), path)
    return sinks.read_sweep_csv(spark, path).select("k", "iteration", q6("loglik"))


def q_csv_scores(spark, d):
    """Test scores through the score sink and back."""
    m, _, test = _fit(spark, d)
    path = scratch_path(spark, "csv-scores")
    sinks.write_scores(scoring.score_pairs(m, test), path, fmt="csv")
    back = spark.read.schema("u long, s long, score double").option("header", True).csv(path)
    return back.select("u", "s", q9("score"))


def q_k_sweep(spark, d):
    train, _ = _split(spark, d)
    return selection.k_sweep(train, K_SWEEP, PASSES, SEED).select("k", "iteration", q6("loglik"))


def q_k_sweep_tol(spark, d):
    """Every k stops on its own, out of one joint state."""
    train, _ = _split(spark, d)
    return selection.k_sweep(train, TOL_KS, TOL_MAX_ITER, SEED, tol=TOL).select("k", "iteration", q6("loglik"))


def q_weighted_m_step(spark, d):
    wp = tables.purchase_pairs(spark, d, weighted=True)
    users, items, _ = em.m_step(spark, em.initial_responsibilities(wp, K, SEED), K, "w", "wm")
    return _long(items, "s", "ps", K, "p").select("s", "z", q9("p"))


def q_word_em_trace(spark, d):
    m = em.fit(tables.word_pairs(spark, d), k=K, max_iter=PASSES, seed=SEED)
    return m.trace.select("iteration", q6("loglik"))


def q_event_em_trace(spark, d):
    m = em.fit(tables.event_pairs(spark, d), k=K, max_iter=PASSES, seed=SEED)
    return m.trace.select("iteration", q6("loglik"))


# ---------------------------------------------------------------- oracle side


def _o_split():
    ch = O.Chain()
    pairs = O.purchase_pairs(ch)
    tr, te, te0 = O.split(ch, pairs, ALPHA, SEED)
    return ch, pairs, tr, te, te0


def _o_long_step():
    ch = O.Chain()
    pairs = O.purchase_pairs(ch)
    ql = ch.add("ql", f"SELECT u, s, CAST(z AS INTEGER) AS z, {O.unit_open('u', 's', 'z', str(SEED))} AS q "
                      f"FROM {pairs}, (SELECT range AS z FROM range({K})) zz")
    ch.add("nsz", "SELECT s, z, sum(q) AS n_sz FROM ql GROUP BY s, z")
    ch.add("nz", "SELECT z, sum(n_sz) AS n_z FROM nsz GROUP BY z")
    ch.add("psz", "SELECT s, z, n_sz / n_z AS p_sz FROM nsz JOIN nz USING (z)")
    ch.add("mass", "SELECT u, z, sum(q) AS mass FROM ql GROUP BY u, z")
    ch.add("tot", "SELECT u, sum(mass) AS total FROM mass GROUP BY u")
    ch.add("pzu", "SELECT u, z, mass / total AS p_zu FROM mass JOIN tot USING (u)")
    ch.add("pj", "SELECT ql.u, ql.s, ql.z, pzu.p_zu, psz.p_sz FROM ql JOIN pzu ON ql.u = pzu.u AND ql.z = pzu.z "
                 "JOIN psz ON ql.s = psz.s AND ql.z = psz.z")
    ch.add("ev", f"SELECT u, s, greatest(sum(p_zu * p_sz), {O.FLOOR}) AS evidence FROM pj GROUP BY u, s")
    return ch


def _o_fit(k=K, passes=PASSES):
    ch, pairs, tr, te, te0 = _o_split()
    pu, ps, lls = O.em(ch, tr, k, passes, SEED, tag=f"k{k}_")
    return ch, tr, te, pu, ps, lls


def _unpivot(src: str, key: str, prefix: str, k: int, out: str, digits: int = 9) -> str:
    return " UNION ALL ".join(
        f"SELECT {key}, CAST({z} AS INTEGER) AS z, {O.qz(f'{prefix}{z}', digits)} AS {out} FROM {src}"
        for z in range(k))


def o_profile_counts():
    ch = O.Chain()
    pairs = O.purchase_pairs(ch)
    return ch.sql(f"SELECT (SELECT count(*) FROM rows_) AS n_rows, (SELECT count(*) FROM {pairs}) AS n_pairs, "
                  f"(SELECT count(DISTINCT u) FROM {pairs}) AS n_users, (SELECT count(DISTINCT s) FROM {pairs}) AS n_items")


def o_pairs_distinct():
    ch = O.Chain()
    return ch.sql(f"SELECT u, s FROM {O.purchase_pairs(ch)}")


def o_pairs_weighted():
    ch = O.Chain()
    return ch.sql(f"SELECT u, s, w FROM {O.weighted_pairs(ch)}")


def o_word_pairs_profile():
    ch = O.Chain()
    wp = O.word_pairs(ch)
    return ch.sql(f"SELECT count(*) AS n_pairs, count(DISTINCT u) AS n_docs, count(DISTINCT s) AS n_words FROM {wp}")


def o_event_pairs():
    ch = O.Chain()
    return ch.sql(f"SELECT u, s FROM {O.event_pairs(ch)}")


def o_split_train():
    ch, _, tr, _, _ = _o_split()
    return ch.sql(f"SELECT u, s FROM {tr}")


def o_split_test():
    ch, _, _, te, _ = _o_split()
    return ch.sql(f"SELECT u, s FROM {te}")


def o_word_split_test():
    ch = O.Chain()
    tr, te, _ = O.split(ch, O.word_pairs(ch), ALPHA, SEED)
    return ch.sql(f"SELECT u, s FROM {te}")


def o_common_users():
    ch, _, tr, _, te0 = _o_split()
    return ch.sql(f"SELECT u FROM {te0} INTERSECT SELECT u FROM {tr}")


def o_common_items():
    ch, _, tr, _, te0 = _o_split()
    return ch.sql(f"SELECT s FROM {te0} INTERSECT SELECT s FROM {tr}")


def o_latent_expand():
    return _o_long_step().sql(f"SELECT u, s, z, {O.qz('q')} AS q0_q FROM ql")


def o_item_class_counts():
    return _o_long_step().sql(f"SELECT s, z, {O.qz('n_sz', 6)} AS n_sz_q FROM nsz")


def o_class_totals():
    return _o_long_step().sql(f"SELECT z, {O.qz('n_z', 6)} AS n_z_q FROM nz")


def o_p_item_given_class():
    return _o_long_step().sql(f"SELECT s, z, {O.qz('p_sz')} AS p_sz_q FROM psz")


def o_user_class_mass():
    return _o_long_step().sql(f"SELECT u, z, {O.qz('mass', 6)} AS mass_q FROM mass")


def o_user_totals():
    return _o_long_step().sql(f"SELECT u, {O.qz('total', 6)} AS total_q FROM tot")


def o_p_class_given_user():
    return _o_long_step().sql(f"SELECT u, z, {O.qz('p_zu', 6)} AS p_zu_q FROM pzu")


def o_param_join():
    return _o_long_step().sql(f"SELECT u, s, z, {O.qz('p_zu', 6)} AS p_zu_q, {O.qz('p_sz')} AS p_sz_q FROM pj")


def o_evidence():
    return _o_long_step().sql(f"SELECT u, s, {O.qz('evidence')} AS evidence_q FROM ev")


def o_posterior():
    return _o_long_step().sql(
        f"SELECT pj.u, pj.s, pj.z, {O.qz('pj.p_zu * pj.p_sz / ev.evidence', 6)} AS q_q "
        f"FROM pj JOIN ev ON pj.u = ev.u AND pj.s = ev.s")


def o_loglik_mean():
    return _o_long_step().sql(f"SELECT {O.qz('avg(ln(evidence))', 6)} AS loglik_q, count(*) AS n_pairs FROM ev")


def o_loglik_negative():
    return _o_long_step().sql(
        f"SELECT {O.qz('-sum(ln(ev.evidence)) / count(*)', 6)} AS neg_loglik_q "
        f"FROM pairs p LEFT JOIN ev ON p.u = ev.u AND p.s = ev.s")


def o_em_trace():
    ch, _, _, _, _, lls = _o_fit(passes=TRACE_PASSES)
    return ch.sql(O.trace_sql(lls))


def o_em_grid_trace():
    ch, _, _, _, _, lls = _o_fit()
    return ch.sql(O.trace_sql(lls))


def o_weighted_em_trace():
    ch = O.Chain()
    _, _, lls = O.em(ch, O.weighted_pairs(ch), K, PASSES, SEED, tag="we_", wcol="w")
    return ch.sql(O.trace_sql(lls))


def o_em_converged():
    """All TOL_MAX_ITER passes unrolled, cut after the first pass with |delta loglik| < TOL."""
    ch, _, tr, _, _ = _o_split()
    _, _, lls = O.em(ch, tr, K, TOL_MAX_ITER, SEED, tag="c_")
    ch.add("trc", " UNION ALL ".join(f"SELECT CAST({i + 1} AS INTEGER) AS iteration, {x} AS ll"
                                     for i, x in enumerate(lls)))
    ch.add("stopc", f"SELECT min(iteration) AS stop FROM (SELECT iteration, ll, lag(ll) OVER (ORDER BY iteration) "
                    f"AS prev FROM trc) WHERE prev IS NOT NULL AND abs(ll - prev) < {O.dbl(TOL)}")
    return ch.sql(f"SELECT iteration, {O.qz('ll', 6)} AS loglik_q FROM trc, stopc "
                  f"WHERE iteration <= coalesce(stopc.stop, {TOL_MAX_ITER})")


def o_em_items():
    ch, _, _, _, ps, _ = _o_fit()
    return ch.sql(_unpivot(ps, "s", "ps", K, "p_q"))


def o_em_users():
    ch, _, _, pu, _, _ = _o_fit()
    return ch.sql(_unpivot(pu, "u", "pu", K, "p_q", 6))


def o_score_observed():
    ch, tr, _, pu, ps, _ = _o_fit()
    sc = O.pair_scores(ch, tr, pu, ps, K, "trsc")
    return ch.sql(f"SELECT u, s, {O.qz('score')} AS score_q FROM {sc}")


def o_score_test():
    ch, _, te, pu, ps, _ = _o_fit()
    sc = O.pair_scores(ch, te, pu, ps, K, "tesc")
    return ch.sql(f"SELECT u, s, {O.qz('score')} AS score_q FROM {sc}")


def o_score_all_summary():
    ch, _, _, pu, ps, _ = _o_fit()
    a = O.all_scores(ch, pu, ps, K)
    return ch.sql(f"SELECT u, count(*) AS n_items, {O.qz('sum(score)', 6)} AS score_sum_q, "
                  f"{O.qz('max(score)')} AS score_max_q FROM {a} GROUP BY u")


def _o_predict(op: str):
    ch, _, _, pu, ps, _ = _o_fit()
    a = O.all_scores(ch, pu, ps, K)
    return ch.sql(f"SELECT u, {O.dbl(THRESHOLD)} AS threshold, "
                  f"count(*) FILTER (WHERE score {op} {O.dbl(THRESHOLD)}) AS n_pos FROM {a} GROUP BY u")


def o_predict_inclusive():
    return _o_predict(">=")


def o_predict_strict():
    return _o_predict(">")


def _o_event_predictions(op: str):
    ch = O.Chain()
    ep = O.event_pairs(ch)
    pu, ps, _ = O.em(ch, ep, 1, 2, SEED, tag="ev_")
    a = O.all_scores(ch, pu, ps, 1)
    ch.add("exact", f"SELECT max(score) AS t FROM {a} JOIN {ep} USING (u, s)")
    return ch.sql(f"SELECT u, count(*) FILTER (WHERE score {op} t) AS n_pos FROM {a}, exact GROUP BY u")


def o_predict_event_inclusive():
    return _o_event_predictions(">=")


def o_predict_event_strict():
    return _o_event_predictions(">")


def o_exclude_seen():
    ch, tr, te, pu, ps, _ = _o_fit()
    sc = O.pair_scores(ch, te, pu, ps, K, "tesc")
    return ch.sql(f"SELECT u, s, {O.qz('score')} AS score_q FROM {sc} x WHERE s % 2 <> 0 "
                  f"AND NOT EXISTS (SELECT 1 FROM {tr} r WHERE r.u = x.u AND r.s = x.s)")


def o_unseen_pairs():
    ch, tr, _, pu, ps, _ = _o_fit()
    a = O.all_scores(ch, pu, ps, K)
    return ch.sql(
        f"SELECT a.u, count(*) AS n_unseen, count(*) FILTER (WHERE a.score >= {O.dbl(THRESHOLD)}) AS n_unseen_pos "
        f"FROM {a} a WHERE NOT EXISTS (SELECT 1 FROM {tr} r WHERE r.u = a.u AND r.s = a.s) GROUP BY a.u")


def _o_conf(truth: str):
    ch, tr, te, pu, ps, _ = _o_fit()
    a = O.all_scores(ch, pu, ps, K)
    c = O.confusion(ch, a, tr, te, [THRESHOLD], True, truth, "conf")
    return ch.sql(f"SELECT threshold, tp, fp, fn, tn, {O.qz('precision')} AS precision_q, "
                  f"{O.qz('recall')} AS recall_q, {O.qz('f1')} AS f1_q FROM ({O.rates(c)})")


def o_confusion_test():
    return _o_conf("test")


def o_confusion_train():
    return _o_conf("train")


def o_threshold_sweep():
    ch, tr, te, pu, ps, _ = _o_fit()
    a = O.all_scores(ch, pu, ps, K)
    c = O.confusion(ch, a, tr, te, SWEEP, True, "test", "conf")
    return ch.sql(f"SELECT threshold, tp, fp, fn, tn FROM {c}")


def o_pr_curve():
    ch, pairs, tr, te, _ = _o_split()
    parts = []
    for k in PR_KS:
        pu, ps, _ = O.em(ch, tr, k, PASSES, SEED, tag=f"k{k}_")
        a = O.all_scores(ch, pu, ps, k, tag=f"_k{k}")
        c = O.confusion(ch, a, tr, te, SWEEP, True, "test", f"conf_k{k}")
        parts.append(f"SELECT CAST({k} AS INTEGER) AS k, threshold, {O.qz('precision')} AS precision_q, "
                     f"{O.qz('recall')} AS recall_q, {O.qz('f1')} AS f1_q FROM ({O.rates(c)})")
    return ch.sql(" UNION ALL ".join(parts))


def o_roc_points():
    ch, tr, te, pu, ps, _ = _o_fit()
    a = O.all_scores(ch, pu, ps, K)
    c = O.confusion(ch, a, tr, te, SWEEP, True, "test", "conf")
    fpr = "CASE WHEN fp + tn = 0 THEN NULL ELSE CAST(fp AS DOUBLE) / CAST(fp + tn AS DOUBLE) END"
    return ch.sql(f"SELECT threshold, {O.qz(fpr)} AS fpr_q, {O.qz('recall')} AS tpr_q FROM ({O.rates(c)})")


def o_auc():
    ch, tr, te, pu, ps, _ = _o_fit()
    a = O.all_scores(ch, pu, ps, K)
    ch.add("lab", f"SELECT a.score, (t.u IS NOT NULL) AS truth FROM {a} a LEFT JOIN {te} t ON a.u = t.u AND a.s = t.s "
                  f"WHERE NOT EXISTS (SELECT 1 FROM {tr} r WHERE r.u = a.u AND r.s = a.s)")
    ch.add("rk", "SELECT score, truth, rank() OVER (ORDER BY score) AS r0, count(*) OVER (PARTITION BY score) AS c "
                 "FROM lab")
    ch.add("cnt", "SELECT CAST(count(*) FILTER (WHERE truth) AS DOUBLE) AS p, "
                  "CAST(count(*) FILTER (WHERE NOT truth) AS DOUBLE) AS n, "
                  "sum(CAST(r0 AS DOUBLE) + (CAST(c AS DOUBLE) - 1.0) / 2.0) FILTER (WHERE truth) AS rs FROM rk")
    return ch.sql(f"SELECT {O.qz('(rs - p * (p + 1.0) / 2.0) / (p * n)')} AS auc_q, CAST(p AS BIGINT) AS n_pos, "
                  f"CAST(n AS BIGINT) AS n_neg FROM cnt")


def o_auc_ranges():
    return o_auc()


def o_recommend_top5():
    ch, tr, _, pu, ps, _ = _o_fit()
    a = O.all_scores(ch, pu, ps, K)
    return ch.sql(
        f"SELECT u, CAST(rn AS INTEGER) AS rank, s, {O.qz('score')} AS score_q FROM ("
        f"SELECT a.u, a.s, a.score, row_number() OVER (PARTITION BY a.u ORDER BY a.score DESC, a.s ASC) AS rn "
        f"FROM {a} a WHERE NOT EXISTS (SELECT 1 FROM {tr} r WHERE r.u = a.u AND r.s = a.s)) WHERE rn <= {TOPN}")


def o_user_items():
    ch, _, tr, _, _ = _o_split()
    return ch.sql(f"SELECT u, string_agg(CAST(s AS VARCHAR), ',' ORDER BY s) AS items FROM {tr} GROUP BY u")


def o_user_item_chunks():
    ch, _, tr, _, _ = _o_split()
    ix = _o_index(ch, tr)
    ch.add("counts", f"SELECT u, idx // {LIST_ITEMS} AS r, count(*) AS n FROM {tr} JOIN {ix} USING (s) GROUP BY u, r")
    ch.add("pieces", f"SELECT u, r, (sum(n) OVER (PARTITION BY u ORDER BY r) - n) // {LIST_ITEMS} AS c FROM counts")
    ch.add("lists", f"SELECT t.u, c, string_agg(CAST(t.s AS VARCHAR), ',' ORDER BY t.s) AS items FROM {tr} t JOIN {ix} i ON t.s = i.s "
                    f"JOIN pieces p ON p.u = t.u AND p.r = i.idx // {LIST_ITEMS} GROUP BY t.u, c")
    return ch.sql("SELECT u, CAST(row_number() OVER (PARTITION BY u ORDER BY c) - 1 AS INTEGER) AS chunk, items FROM lists")


def o_preview():
    ch = O.Chain()
    return ch.sql(f"SELECT u, s FROM {O.purchase_pairs(ch)} ORDER BY u, s LIMIT {PREVIEW}")


def o_max_item():
    ch, _, tr, _, _ = _o_split()
    return ch.sql(f"SELECT max(s) AS max_s FROM {tr}")


def _o_index(ch, tr):
    return ch.add("idx", f"SELECT s, row_number() OVER (ORDER BY s) - 1 AS idx FROM (SELECT DISTINCT s FROM {tr})")


def o_user_vectors():
    ch, _, tr, _, _ = _o_split()
    ix = _o_index(ch, tr)
    return ch.sql(f"SELECT u, CAST((SELECT count(*) FROM {ix}) AS INTEGER) AS size, CAST(count(*) AS INTEGER) AS nnz, "
                  f"CAST(count(*) AS DOUBLE) AS total, CAST(sum(idx) AS BIGINT) AS idx_sum, max(idx) AS idx_max "
                  f"FROM {tr} JOIN {ix} USING (s) GROUP BY u")


def o_user_vector_entries():
    ch, _, tr, _, _ = _o_split()
    return ch.sql(f"SELECT u, idx, CAST(1 AS DOUBLE) AS value FROM {tr} JOIN {_o_index(ch, tr)} USING (s)")


def _o_lda():
    ch, _, tr, te, _ = _o_split()
    pu, ps, _ = O.em(ch, tr, LDA_K, LDA_ITER, SEED, tag="lda_", alpha=LDA_ALPHA, eta=LDA_ETA)
    return ch, tr, te, pu, ps


def o_lda_items():
    ch, _, _, _, ps = _o_lda()
    return ch.sql(_unpivot(ps, "s", "ps", LDA_K, "weight_q").replace(" AS z,", " AS topic,"))


def o_lda_users():
    ch, _, _, pu, _ = _o_lda()
    return ch.sql(_unpivot(pu, "u", "pu", LDA_K, "weight_q", 6).replace(" AS z,", " AS topic,"))


def o_lda_scores():
    ch, _, _, pu, ps = _o_lda()
    a = O.all_scores(ch, pu, ps, LDA_K)
    return ch.sql(f"SELECT u, count(*) AS n_items, {O.qz('sum(score)', 6)} AS score_sum_q, "
                  f"{O.qz('max(score)')} AS score_max_q FROM {a} GROUP BY u")


def o_lda_confusion_strict():
    ch, tr, te, pu, ps = _o_lda()
    a = O.all_scores(ch, pu, ps, LDA_K)
    c = O.confusion(ch, a, tr, te, [LDA_THRESHOLD], False, "test", "conf")
    return ch.sql(f"SELECT threshold, tp, fp, fn, tn, {O.qz('precision')} AS precision_q, "
                  f"{O.qz('recall')} AS recall_q, {O.qz('f1')} AS f1_q FROM ({O.rates(c)})")


def o_csv_round_trip():
    ch = O.Chain()
    return ch.sql(f"SELECT u, s, w FROM {O.weighted_pairs(ch)}")


def _o_bad_lines():
    ch = O.Chain()
    return ch, ch.add("lines", f"SELECT u, s, (u * 31 + s) % 10 AS kind FROM {O.purchase_rows(ch)}")


def o_csv_rejects():
    ch, rows = _o_bad_lines()
    return ch.sql(f"""SELECT line, reason, count(*) AS n FROM (SELECT
        CASE kind WHEN 0 THEN u::VARCHAR WHEN 1 THEN ',' || s || ',1.0,0' WHEN 2 THEN u || ','
                  WHEN 3 THEN 'u' || u || ',' || s || ',1.0,0' ELSE u || ',s' || s END AS line,
        CASE kind WHEN 0 THEN 'one field' WHEN 1 THEN 'empty user' WHEN 2 THEN 'empty item'
                  WHEN 3 THEN 'user is no whole number' ELSE 'item is no whole number' END AS reason
        FROM {rows} WHERE kind < 5) GROUP BY line, reason""")


def o_csv_accepted():
    ch, rows = _o_bad_lines()
    return ch.sql(f"SELECT u, s, count(*) AS w FROM {rows} WHERE kind >= 5 GROUP BY u, s")


def o_trace_csv():
    ch, _, _, _, _, lls = _o_fit()
    return ch.sql(f"SELECT *, true AS timed FROM ({O.trace_sql(lls)})")


def o_run_metadata():
    ch, _, tr, _, _ = _o_split()
    parts = []
    for k, passes in METADATA_RUNS:
        _, _, lls = O.em(ch, tr, k, passes, SEED, tag=f"k{k}_")
        parts.append(f"SELECT CAST({k} AS INTEGER) AS k, CAST({passes} AS INTEGER) AS iterations, "
                     f"CAST({passes} AS INTEGER) AS n_seconds, * FROM ({O.trace_sql(lls)})")
    return ch.sql(" UNION ALL ".join(parts))


def o_csv_sweep():
    return _o_sweep([2, 3])


def o_csv_scores():
    return o_score_test()


def o_k_sweep():
    return _o_sweep(K_SWEEP)


def o_k_sweep_tol():
    """All passes unrolled for every k, cut after its first pass with |delta loglik| < TOL."""
    ch, _, tr, _, _ = _o_split()
    parts = []
    for k in TOL_KS:
        _, _, lls = O.em(ch, tr, k, TOL_MAX_ITER, SEED, tag=f"k{k}_")
        parts += [f"SELECT CAST({k} AS INTEGER) AS k, CAST({i + 1} AS INTEGER) AS iteration, {x} AS ll" for i, x in enumerate(lls)]
    ch.add("tr_", " UNION ALL ".join(parts))
    ch.add("d_", "SELECT *, abs(ll - lag(ll) OVER (PARTITION BY k ORDER BY iteration)) AS delta FROM tr_")
    ch.add("stop_", f"SELECT k, min(iteration) AS last_pass FROM d_ WHERE delta < {O.dbl(TOL)} GROUP BY k")
    return ch.sql(f"SELECT k, iteration, {O.qz('ll', 6)} AS loglik_q FROM d_ LEFT JOIN stop_ USING (k) "
                  f"WHERE iteration <= coalesce(last_pass, {TOL_MAX_ITER})")


def _o_sweep(ks):
    ch, _, tr, _, _ = _o_split()
    parts = []
    for k in ks:
        _, _, lls = O.em(ch, tr, k, PASSES, SEED, tag=f"k{k}_")
        parts.append(" UNION ALL ".join(
            f"SELECT CAST({k} AS INTEGER) AS k, CAST({i + 1} AS INTEGER) AS iteration, {O.qz(x, 6)} AS loglik_q"
            for i, x in enumerate(lls)))
    return ch.sql(" UNION ALL ".join(parts))


def o_weighted_m_step():
    ch = O.Chain()
    wp = O.weighted_pairs(ch)
    q = O.init_q(ch, wp, K, SEED, "w0", "w")
    _, _, _, ps = O.m_step(ch, q, K, "w1", "w")
    return ch.sql(_unpivot(ps, "s", "ps", K, "p_q"))


def o_word_em_trace():
    ch = O.Chain()
    wp = O.word_pairs(ch)
    _, _, lls = O.em(ch, wp, K, PASSES, SEED, tag="w_")
    return ch.sql(O.trace_sql(lls))


def o_event_em_trace():
    ch = O.Chain()
    ep = O.event_pairs(ch)
    _, _, lls = O.em(ch, ep, K, PASSES, SEED, tag="e_")
    return ch.sql(O.trace_sql(lls))


# ---------------------------------------------------------------- registry

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name[2:]: fn for name, fn in list(globals().items()) if name.startswith("q_") and callable(fn)
}

ORACLES: dict[str, Callable[[], str]] = {
    name[2:]: fn for name, fn in list(globals().items()) if name.startswith("o_") and callable(fn)
}
