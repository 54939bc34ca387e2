"""Queries of metrics and embedding scores, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episodica.operators import latents as E
from episodica.operators import metrics as M
from episodica.operators import sampling as S
from episodica.plans import tables as T
from episodica.plans.window_queries import IDS, ids


def lineitem(spark: SparkSession, sf: str) -> DataFrame:
    return T.read(spark, sf, "lineitem")


def a1(spark: SparkSession, sf: str) -> DataFrame:
    found = M.normalizer_stats(T.latents(spark, sf), "vec", 64, ["label"])
    return found.select("label", *[(F.round(F.col(c)[i], 6) + 0.0).alias(f"{c}_{i}") for c in ("mean", "std") for i in range(64)])


def a1b(spark: SparkSession, sf: str) -> DataFrame:
    found = M.moment_stats(M.array_moments(T.latents(spark, sf), "vec", ["label"]), ["label"])
    return found.select("label", *[(F.round(F.col(c)[i], 6) + 0.0).alias(f"{c}_{i}") for c in ("mean", "std") for i in range(64)])


def a2(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.latents(spark, sf).select("vec_id", F.col("vec").alias("v"))
    found = M.normalize(rows, M.normalizer_stats(rows, "v", 64), "v")
    return found.select("vec_id", F.posexplode("v").alias("i", "n")).select("vec_id", "i", (F.round("n", 5) + 0.0).alias("n"))  # no negative zero


def a3(spark: SparkSession, sf: str) -> DataFrame:
    return M.episode_return(ids(spark, sf)).select("actor", "episode", F.round("ret", 6).alias("ret"), "success")


def a4(spark: SparkSession, sf: str) -> DataFrame:
    found = M.eval_by_view(M.episode_return(ids(spark, sf)).withColumn("view", F.col("actor") % 6))
    return found.select("view", F.round("mean_return", 6).alias("mean_return"), F.round("mean_success", 8).alias("mean_success"))


def wide(spark: SparkSession, sf: str) -> DataFrame:
    return lineitem(spark, sf).select("l_orderkey", F.col("l_linenumber").alias("step"), F.col("l_quantity").alias("q"), F.col("l_discount").alias("d"), F.col("l_tax").alias("x"))


def a5(spark: SparkSession, sf: str) -> DataFrame:
    long = M.metrics_long(wide(spark, sf), ["l_orderkey", "step"], ["q", "d", "x"])
    return M.validation_means(long, percent=["d"]).select("name", F.round("mean", 6).alias("mean"))


def a6(spark: SparkSession, sf: str) -> DataFrame:
    rules = [("no_path_match", F.col("l_shipdate") < "1994-01-01"), ("too_short", F.col("l_quantity") < 2), ("low_quality", F.col("l_discount") > 0.08)]
    return M.reject_ledger(lineitem(spark, sf), rules, ["l_returnflag"])


def a7(spark: SparkSession, sf: str) -> DataFrame:
    rows = lineitem(spark, sf).select("l_orderkey", "l_linenumber", F.when(F.col("l_tax") == 0, float("nan")).otherwise(F.col("l_tax")).alias("tax"), F.when(F.col("l_discount") == 0, float("inf")).otherwise(F.col("l_discount")).alias("discount"))
    found = M.nonfinite_guard(rows, ["tax", "discount"])
    return found.groupBy(F.array_join("bad", ",").alias("bad"), "skipped").agg(F.count(F.lit(1)).alias("n"))


def a8(spark: SparkSession, sf: str) -> DataFrame:
    found = M.reconstruction_error(T.latents(spark, sf), "z_inv", "z_dep", ["label"])
    return found.select("label", F.round("mse", 8).alias("mse"), F.round("mae", 8).alias("mae"))


def a9(spark: SparkSession, sf: str) -> DataFrame:
    each = M.reconstruction_error(T.latents(spark, sf), "z_inv", "z_dep", ["view_id", "state_id"])
    return M.psnr_by_view(each, "view_id").select("view_id", F.round("psnr", 6).alias("psnr"))


def a12(spark: SparkSession, sf: str) -> DataFrame:
    found = M.weighted_total(wide(spark, sf), {"q": 0.5, "d": 2, "x": -1})
    return found.groupBy("step").agg(F.round(F.sum("total"), 4).alias("total"))


def a13(spark: SparkSession, sf: str) -> DataFrame:
    return M.catalog_counts(T.talk(spark, sf))


def a14(spark: SparkSession, sf: str) -> DataFrame:
    rows = ids(spark, sf).select("actor", F.col("transition_id").alias("step"), F.col("done").alias("event"))
    return M.metric_downsample(rows, 10)


def a15(spark: SparkSession, sf: str) -> DataFrame:
    found = M.axis_limits(T.latents(spark, sf).select("label", F.col("vec")[0].alias("x"), F.col("vec")[1].alias("y")), ["label"])
    return found.select("label", *[F.round(c, 8).alias(c) for c in ("min_x", "max_x", "min_y", "max_y")])


def a16(spark: SparkSession, sf: str) -> DataFrame:
    rows = lineitem(spark, sf).select(F.col("l_linenumber").alias("step"), F.col("l_returnflag").alias("variant"), F.col("l_quantity").alias("value"))
    return M.variant_columns(rows, ["step"], ["A", "N", "R"]).select("step", *[F.round(c, 6).alias(c.lower()) for c in ("A", "N", "R")])


def a17(spark: SparkSession, sf: str) -> DataFrame:
    rows = wide(spark, sf).groupBy("l_orderkey").agg(F.max("q").alias("q"), F.max("d").alias("d"))
    return M.metrics_wide(M.metrics_long(rows, ["l_orderkey"], ["q", "d"]), ["l_orderkey"], ["q", "d"])


def l1(spark: SparkSession, sf: str) -> DataFrame:
    from episodica.functions import linalg as L

    rows = T.latents(spark, sf).withColumn("v", F.transform("z_inv", lambda x: F.when(x > 0.2, float("nan")).otherwise(x)))
    return rows.select("vec_id", F.posexplode(L.clean_unit("v")).alias("i", "x")).select("vec_id", "i", F.round("x", 8).alias("x"))


def l2(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.latents(spark, sf)
    found = E.infonce(rows.select("batch_id", "vec_id", F.col("z_inv").alias("vec")), rows.select("batch_id", "vec_id", F.col("z_dep").alias("vec")), 0.1, row="vec_id")
    return found.select("batch_id", F.round("loss", 6).alias("loss"))


def l2b(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.latents(spark, sf).withColumn("negatives", F.array(F.reverse("z_dep"), F.reverse("z_inv")))
    return E.infonce_paired(rows, 0.1, "z_inv", "z_dep", "negatives", ["batch_id"]).select("batch_id", F.round("loss", 6).alias("loss"))


def l2c(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.latents(spark, sf).withColumn("negatives", F.array(F.reverse("z_dep"), F.reverse("z_inv")))
    return E.infonce_mixed(rows, 0.1, "z_inv", "z_dep", "negatives", row="vec_id").select("batch_id", F.round("loss", 6).alias("loss"))


def l3(spark: SparkSession, sf: str) -> DataFrame:
    later = lambda a, b: (a["state_id"] == b["state_id"]) & (a["view_id"] < b["view_id"])
    found = E.multi_positive_nce(T.latents(spark, sf), later, lambda a, b: a["state_id"] != b["state_id"], 0.5)
    return found.select("batch_id", F.round("loss", 6).alias("loss"), "n_queries")


def l4(spark: SparkSession, sf: str) -> DataFrame:
    return E.view_state_contrast(T.latents(spark, sf), 0.5).select("batch_id", F.round("inv", 6).alias("inv"), F.round("dep", 6).alias("dep"))


def l5(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.latents(spark, sf)
    a, b = E.consistency(rows, "z_inv", 32, "state_id"), E.consistency(rows, "z_dep", 32, "view_id")
    return a.select("batch_id", F.round("value", 8).alias("state")).join(b.select("batch_id", F.round("value", 8).alias("view")), "batch_id")


def l6(spark: SparkSession, sf: str) -> DataFrame:
    other_view = lambda a, b: (a["state_id"] == b["state_id"]) & (a["view_id"] != b["view_id"])
    found = E.ratio_contrast(T.latents(spark, sf), other_view, lambda a, b: a["state_id"] != b["state_id"], vec="z_inv")
    return found.select("batch_id", F.round("loss", 6).alias("loss"))


def l7(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.latents(spark, sf).select("batch_id", "vec_id", "z_inv", "z_dep")
    rolled = S.rolled_negative(rows, key="vec_id")
    negative = rows.select(F.col("vec_id").alias("negative"), F.col("z_inv").alias("z_neg"))
    return E.triplet_hinge(rolled.join(negative, "negative"), 0.2, "z_inv", "z_dep", "z_neg", ["batch_id"]).select("batch_id", F.round("loss", 8).alias("loss"))


def book(spark: SparkSession, sf: str) -> DataFrame:
    from episodica.functions import linalg as L

    return T.latents(spark, sf).groupBy(F.col("label").alias("code")).agg(L.mean_vector("vec", 64).alias("code_vec"))


def l8(spark: SparkSession, sf: str) -> DataFrame:
    found = E.assign_codes(T.latents(spark, sf), book(spark, sf), beta=0.25)
    return found.select("vec_id", "code", F.round("error", 10).alias("error"))


def l9(spark: SparkSession, sf: str) -> DataFrame:
    codes = E.fit_codebook(T.latents(spark, sf), 8)
    return E.assign_codes(T.latents(spark, sf), codes).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


def l9b(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors moved apart by label have one best codebook, their labels' means: SQL can tell each vector's centre."""
    rows = T.latents(spark, sf).select("vec_id", F.transform("vec", lambda x, i: x + F.when(i == F.col("label"), 100.0).otherwise(0.0)).alias("vec"))
    codes = E.fit_codebook(rows, T.latents(spark, sf).select("label").distinct().count())
    near = E.assign_codes(rows, codes).join(codes, "code")
    return near.select("vec_id", F.round(F.col("code_vec")[0], 6).alias("c0"), F.round(F.col("code_vec")[63], 6).alias("c63"), F.round("error", 6).alias("error"))


def l9c(spark: SparkSession, sf: str) -> DataFrame:
    """As l9b, from a start at which all codes but one are dead: none is in the end, and each group has its own."""
    rows = T.latents(spark, sf).select("vec_id", F.transform("vec", lambda x, i: x + F.when(i == F.col("label"), 100.0).otherwise(0.0)).alias("vec"))
    k = T.latents(spark, sf).select("label").distinct().count()
    codes = E.fit_live_codebook(rows, [[-500.0 - i] * 64 for i in range(k)])
    near = E.assign_codes(rows, codes).join(codes.filter("n >= 2"), "code")
    return near.select("vec_id", F.round(F.col("code_vec")[0], 6).alias("c0"), F.round(F.col("code_vec")[63], 6).alias("c63"), F.round("error", 6).alias("error"))


def l10(spark: SparkSession, sf: str) -> DataFrame:
    found = E.code_usage(E.assign_codes(T.latents(spark, sf), book(spark, sf)), book(spark, sf))
    return found.select("n_codes", F.round("used", 8).alias("used"), F.round("perplexity", 6).alias("perplexity"), "dead")


def l11(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.latents(spark, sf).withColumn("v", F.transform(F.slice("vec", 1, 3), lambda x: x * 8))
    return E.fsq_codes(rows, [7, 5, 5], "v").select("vec_id", *[F.col("digits")[i].alias(f"d{i}") for i in range(3)], "index")


def l12(spark: SparkSession, sf: str) -> DataFrame:
    return E.gaussian_kl(T.latents(spark, sf), "z_inv", "z_dep", ["label"]).select("label", F.round("kl", 8).alias("kl"))


def l13(spark: SparkSession, sf: str) -> DataFrame:
    found = E.embed_2d(T.latents(spark, sf), "z_inv")
    return found.select("batch_id", "state_id", "view_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def l14(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.latents(spark, sf).select("vec_id", E.fuse("z_inv", "z_dep").alias("c"), E.fuse("z_inv", "z_dep", "plus").alias("p"))
    return rows.select("vec_id", F.size("c").alias("n"), F.col("c")[33].alias("c33"), F.round(F.col("p")[1], 8).alias("p1"))


def l15(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.latents(spark, sf).select(F.col("batch_id").alias("episode"), (F.col("state_id") % 10).alias("t"), F.col("view_id").alias("camera"), "z_inv", "z_dep")
    found = E.swap_matrix(rows, mode="plus")
    return found.select("episode", "inv_camera", "inv_t", "dep_camera", "dep_t", F.round(F.col("fused")[0], 8).alias("f0"))


QUERIES = {
    "a1_normalizer_stats": a1, "a1b_array_moments": a1b, "a2_normalize": a2, "a3_episode_return": a3, "a4_eval_by_view": a4,
    "a5_validation_means": a5, "a6_reject_ledger": a6, "a7_nonfinite_guard": a7, "a8_reconstruction_error": a8,
    "a9_psnr_by_view": a9,
    "a12_weighted_total": a12, "a13_catalog_counts": a13, "a14_metric_downsample": a14, "a15_axis_limits": a15,
    "a16_variant_deltas": a16, "a17_metrics_long": a17, "l1_clean_l2": l1, "l2_infonce": l2, "l2b_infonce_paired": l2b,
    "l2c_infonce_mixed": l2c,
    "l3_multi_positive_nce": l3, "l4_view_state_contrast": l4, "l5_consistency": l5, "l6_ratio_contrast": l6,
    "l7_triplet_hinge": l7, "l8_assign_codes": l8, "l9_fit_codebook": l9, "l9b_codebook_of_groups": l9b, "l9c_live_codebook": l9c,
    "l10_code_usage": l10, "l11_fsq_codes": l11, "l12_gaussian_kl": l12,
    "l13_embed_2d": l13, "l14_fuse": l14, "l15_swap_matrix": l15,
}

_STATS = ", ".join(f"round(avg(vec[{i + 1}]), 6) + 0.0::DOUBLE AS mean_{i}, round(greatest(stddev_samp(vec[{i + 1}]), 1e-6::DOUBLE), 6) AS std_{i}" for i in range(64))
_RETURNS = f"{IDS}, ret AS (SELECT actor, episode, sum(reward) AS ret, max(success::INT) AS success FROM ids GROUP BY 1, 2)"
_DIST = lambda a, b: f"list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
_UNIT = lambda v: f"list_transform({v}, lambda e: e / greatest(sqrt(list_dot_product({v}, {v})), 1e-6::DOUBLE))"
_SIM = lambda v, tau: f"{T.LATENTS}, u AS (SELECT batch_id, state_id, view_id, vec_id, {_UNIT(v)} AS v FROM latents), s AS (SELECT a.batch_id, a.vec_id AS q, b.vec_id AS k, a.state_id AS qs, b.state_id AS ks, a.view_id AS qv, b.view_id AS kv, list_dot_product(a.v, b.v) / {tau}::DOUBLE AS sim FROM u a JOIN u b USING (batch_id))"
_NCE = lambda pos, neg: f"e AS (SELECT batch_id, q, sum(CASE WHEN {pos} THEN exp(sim) END) AS p, sum(exp(sim)) AS t FROM s WHERE ({pos}) OR ({neg}) GROUP BY 1, 2) SELECT batch_id, round(coalesce(avg(ln(t) - ln(p)), 0), 6)"
_BOOK = f"""{T.LATENTS},
x AS (SELECT label, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM latents),
m AS (SELECT label, i, avg(x) AS x FROM x GROUP BY 1, 2),
book AS (SELECT label AS code, list(x ORDER BY i) AS code_vec FROM m GROUP BY 1),
d AS (SELECT vec_id, code, {_DIST('vec', 'code_vec')} AS d FROM latents, book),
best AS (SELECT vec_id, code, d FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, code) = 1)"""

ORACLE_SQL = {
    "a1_normalizer_stats": f"WITH {T.LATENTS} SELECT label, {_STATS} FROM latents GROUP BY 1",
    "a2_normalize": f"""WITH {T.LATENTS}, e AS (SELECT vec_id, unnest(range(64))::INT AS i, unnest(vec) AS v FROM latents)
SELECT vec_id, i, round((v - avg(v) OVER w) / greatest(stddev_samp(v) OVER w, 1e-6::DOUBLE), 5) + 0.0::DOUBLE AS n FROM e WINDOW w AS (PARTITION BY i)""",
    "a3_episode_return": f"WITH {_RETURNS} SELECT actor, episode, round(ret, 6) AS ret, success FROM ret",
    "a4_eval_by_view": f"""WITH {_RETURNS},
v AS (SELECT actor % 6 AS view, avg(ret) AS r, avg(success) AS s FROM ret GROUP BY 1) SELECT view, round(r, 6) AS mean_return, round(s,
8) AS mean_success FROM v UNION ALL SELECT NULL, round(avg(r), 6), round(avg(s), 8)
FROM v""",
    "a5_validation_means": """SELECT 'q' AS name, round(avg(l_quantity), 6) AS mean
FROM lineitem UNION ALL SELECT 'd', round(100 * avg(l_discount), 6)
FROM lineitem UNION ALL SELECT 'x', round(avg(l_tax), 6)
FROM lineitem""",
    "a6_reject_ledger": """WITH r AS (SELECT l_returnflag, CASE WHEN l_shipdate < DATE '1994-01-01' THEN 'no_path_match' WHEN l_quantity < 2 THEN 'too_short' WHEN l_discount > 0.08::DOUBLE THEN 'low_quality' ELSE 'ok' END AS reason
FROM lineitem) SELECT l_returnflag, reason, count(*) AS n
FROM r GROUP BY 1, 2 UNION ALL SELECT l_returnflag, 'total', count(*)
FROM r GROUP BY 1""",
    "a7_nonfinite_guard": """WITH r AS (SELECT concat_ws(',', CASE WHEN l_tax = 0 THEN 'tax' END, CASE WHEN l_discount = 0 THEN 'discount' END) AS bad
FROM lineitem) SELECT bad, bad <> '' AS skipped, count(*) AS n
FROM r GROUP BY 1, 2""",
    "a8_reconstruction_error": f"""WITH {T.LATENTS} SELECT label, round(avg({_DIST('z_inv', 'z_dep')} / 32), 8) AS mse, round(avg(list_sum(list_transform(list_zip(z_inv,
z_dep), lambda p: abs(p[1] - p[2]))) / 32), 8) AS mae
FROM latents GROUP BY 1""",
    "a9_psnr_by_view": f"""WITH {T.LATENTS} SELECT view_id, round(avg(-10 * log10({_DIST('z_inv', 'z_dep')} / 32 + 1e-8::DOUBLE)), 6) AS psnr
FROM latents GROUP BY 1""",
    "a12_weighted_total": """SELECT l_linenumber AS step, round(sum(l_quantity * 0.5::DOUBLE + l_discount * 2 - l_tax), 4) AS total
FROM lineitem GROUP BY 1""",
    "a13_catalog_counts": f"WITH {T.TALK} SELECT episode, count(*) AS num_samples FROM talk GROUP BY ROLLUP (episode)",
    "a14_metric_downsample": f"WITH {IDS} SELECT actor, transition_id AS step, done AS event FROM ids WHERE transition_id % 10 = 0 OR done",
    "a15_axis_limits": f"WITH {T.LATENTS}, b AS (SELECT label, min(vec[1]) AS ax, max(vec[1]) AS bx, min(vec[2]) AS ay, max(vec[2]) AS \"by\" FROM latents GROUP BY 1) SELECT label, round(ax - greatest(1e-6::DOUBLE, (bx - ax) * 0.08::DOUBLE), 8) AS min_x, round(bx + greatest(1e-6::DOUBLE, (bx - ax) * 0.08::DOUBLE), 8) AS max_x, round(ay - greatest(1e-6::DOUBLE, (\"by\" - ay) * 0.08::DOUBLE), 8) AS min_y, round(\"by\" + greatest(1e-6::DOUBLE, (\"by\" - ay) * 0.08::DOUBLE), 8) AS max_y FROM b",
    "a16_variant_deltas": """SELECT l_linenumber AS step, round(avg(l_quantity) FILTER (l_returnflag = 'A'), 6) AS a, round(avg(l_quantity) FILTER (l_returnflag = 'N'),
6) AS n, round(avg(l_quantity) FILTER (l_returnflag = 'R'), 6) AS r
FROM lineitem GROUP BY 1""",
    "a17_metrics_long": "SELECT l_orderkey, max(l_quantity) AS q, max(l_discount) AS d FROM lineitem GROUP BY 1",
    "l1_clean_l2": f"""WITH {T.LATENTS},
c AS (SELECT vec_id, list_transform(z_inv, lambda e: CASE WHEN e > 0.2::DOUBLE THEN 0.0::DOUBLE ELSE e END) AS v
FROM latents),
u AS (SELECT vec_id, {_UNIT('v')} AS v FROM c),
x AS (SELECT vec_id, unnest(range(32))::INT AS i, unnest(v) AS x FROM u) SELECT vec_id, i, round(x, 8) AS x
FROM x""",
    "l2_infonce": f"""WITH {T.LATENTS},
u AS (SELECT batch_id, vec_id, {_UNIT('z_inv')} AS a, {_UNIT('z_dep')} AS b FROM latents),
s AS (SELECT q.batch_id, q.vec_id AS q, ln(sum(exp(list_dot_product(q.a, k.b) / 0.1::DOUBLE))) - max(CASE WHEN q.vec_id = k.vec_id THEN list_dot_product(q.a,
k.b) / 0.1::DOUBLE END) AS loss FROM u q JOIN u k USING (batch_id) GROUP BY 1, 2) SELECT batch_id, round(avg(loss), 6) AS loss
FROM s GROUP BY 1""",
    "l2b_infonce_paired": f"""WITH {T.LATENTS},
u AS (SELECT batch_id, {_UNIT('z_inv')} AS a, {_UNIT('z_dep')} AS b FROM latents),
s AS (SELECT batch_id, list_dot_product(a, b) / 0.1::DOUBLE AS p, list_dot_product(a, list_reverse(b)) / 0.1::DOUBLE AS n, list_dot_product(a,
list_reverse(a)) / 0.1::DOUBLE AS m FROM u) SELECT batch_id, round(avg(ln(exp(p) + exp(n) + exp(m)) - p), 6) AS loss
FROM s GROUP BY 1""",
    "l3_multi_positive_nce": f"""WITH {_SIM('vec', 0.5)}, {_NCE('qs = ks AND qv < kv', 'qs <> ks')} AS loss, count(p) AS n_queries
FROM e GROUP BY 1""",
    "l4_view_state_contrast": f"""SELECT batch_id, inv, dep FROM (WITH {_SIM('z_inv', 0.5)}, {_NCE('qs = ks AND qv <> kv', 'qs <> ks')} AS inv
FROM e GROUP BY 1) JOIN (WITH {_SIM('z_dep', 0.5)}, {_NCE('qs <> ks AND qv = kv', 'qv <> kv')} AS dep
FROM e GROUP BY 1) USING (batch_id)""",
    "l5_consistency": "SELECT batch_id, state, view FROM " + " JOIN ".join(
        f"(WITH {T.LATENTS}, u AS (SELECT batch_id, {g}, {_UNIT(v)} AS v FROM latents), x AS (SELECT batch_id, {g}, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM u), m AS (SELECT *, abs(x - avg(x) OVER (PARTITION BY batch_id, {g}, i)) AS d FROM x) SELECT batch_id, round(avg(d), 8) AS {n} FROM m GROUP BY 1)"
        for g, v, n in (("state_id", "z_inv", "state"), ("view_id", "z_dep", "view"))
    ) + " USING (batch_id)",
    "l6_ratio_contrast": f"""WITH {_SIM('z_inv', 1)},
e AS (SELECT batch_id, q, coalesce(sum(CASE WHEN qs = ks AND qv <> kv THEN exp(sim) END), 0) AS p, coalesce(sum(CASE WHEN qs <> ks THEN exp(sim) END),
0) AS n FROM s GROUP BY 1, 2) SELECT batch_id, round(avg(-ln(greatest(p, 1e-8::DOUBLE) / greatest(p + n, 1e-8::DOUBLE))), 6) AS loss
FROM e GROUP BY 1""",
    "l7_triplet_hinge": f"""WITH {T.LATENTS},
n AS (SELECT batch_id, vec_id, z_inv, z_dep, coalesce(lag(vec_id) OVER (PARTITION BY batch_id ORDER BY vec_id), max(vec_id) OVER (PARTITION BY batch_id)) AS neg
FROM latents) SELECT a.batch_id, round(avg(greatest(0, 0.2::DOUBLE + {_DIST('a.z_inv', 'a.z_dep')} - {_DIST('a.z_inv', 'b.z_inv')})),
8) AS loss FROM n a JOIN latents b ON a.neg = b.vec_id
GROUP BY 1""",
    "l8_assign_codes": f"WITH {_BOOK} SELECT vec_id, code, round(d / 64 * 0.25::DOUBLE, 10) AS error FROM best",
    "l10_code_usage": f"""WITH {_BOOK},
c AS (SELECT book.code, count(best.vec_id) AS n FROM book LEFT JOIN best USING (code)
GROUP BY 1),
p AS (SELECT n, n / sum(n) OVER () AS p FROM c) SELECT count(*) AS n_codes, round(avg(CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END),
8) AS used, round(exp(-sum(CASE WHEN n > 0 THEN p * ln(p) ELSE 0 END)), 6) AS perplexity, sum(CASE WHEN n < 2 THEN 1 ELSE 0 END)::BIGINT AS dead
FROM p""",
    "l11_fsq_codes": f"""WITH {T.LATENTS},
d AS (SELECT vec_id, floor(tanh(vec[1] * 8) * 3 + 3.5::DOUBLE)::BIGINT AS d0, floor(tanh(vec[2] * 8) * 2 + 2.5::DOUBLE)::BIGINT AS d1,
floor(tanh(vec[3] * 8) * 2 + 2.5::DOUBLE)::BIGINT AS d2 FROM latents) SELECT vec_id, d0, d1, d2, d0 + 7 * d1 + 35 * d2 AS index
FROM d""",
    "l12_gaussian_kl": f"""WITH {T.LATENTS} SELECT label, round(avg(list_sum(list_transform(list_zip(z_inv, z_dep), lambda p: -0.5::DOUBLE * (1 + 2 * p[2] - p[1] * p[1] - exp(2 * p[2])))) / 32),
8) AS kl FROM latents GROUP BY 1""",
    "l14_fuse": f"WITH {T.LATENTS} SELECT vec_id, 64::INT AS n, vec[34] AS c33, round(z_inv[2] + z_dep[2], 8) AS p1 FROM latents",
    "l15_swap_matrix": f"""WITH {T.LATENTS},
f AS (SELECT batch_id AS episode, state_id % 10 AS t, view_id AS camera, z_inv, z_dep
FROM latents) SELECT a.episode, a.camera AS inv_camera, a.t AS inv_t, b.camera AS dep_camera, b.t AS dep_t, round(a.z_inv[1] + b.z_dep[1],
8) AS f0 FROM f a JOIN f b ON a.episode = b.episode AND b.t = CASE WHEN a.t = 0 THEN 1 ELSE 0 END AND a.camera <> b.camera""",
}
ORACLE_SQL["l9b_codebook_of_groups"] = f"""
WITH {T.LATENTS},
e AS (SELECT vec_id, label, unnest(range(64)) AS i, unnest(vec) AS x FROM latents),
moved AS (SELECT vec_id, label, i, x + CASE WHEN i = label THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END AS x FROM e),
centred AS (SELECT vec_id, i, x, avg(x) OVER (PARTITION BY label, i) AS c FROM moved)
SELECT vec_id, round(max(c) FILTER (i = 0), 6) AS c0, round(max(c) FILTER (i = 63), 6) AS c63, round(avg((x - c) * (x - c)), 6) AS error
FROM centred GROUP BY 1"""


def _component(name: str, matrix: str) -> str:
    """CTEs: the matrix squared until one eigenvector is left of it, and that vector (v) with its value (l)."""
    return f"""
{name}_power AS (
    SELECT 0 AS k, m FROM {matrix}
    UNION ALL
    SELECT k + 1, list_transform(q, lambda r: list_transform(r, lambda e: e / t))
    FROM (SELECT k, q, list_sum(list_transform(range(1, 33), lambda i: q[i][i])) AS t
          FROM (SELECT k, list_transform(m, lambda r: list_transform(m, lambda s: list_dot_product(r, s))) AS q FROM {name}_power WHERE k < 18))
),
{name}_row AS (
    SELECT r FROM (SELECT unnest(m) AS r, generate_subscripts(m, 1) AS i FROM {name}_power WHERE k = 18) ORDER BY r[i] DESC LIMIT 1
),
{name}_unit AS (
    SELECT list_transform(r, lambda e: CASE WHEN list_max(r) >= -list_min(r) THEN e ELSE -e END / sqrt(list_dot_product(r, r))) AS v FROM {name}_row
),
{name} AS (SELECT v, list_dot_product(v, list_transform(m, lambda r: list_dot_product(r, v))) AS l FROM {name}_unit, {matrix})"""


ORACLE_SQL["l13_embed_2d"] = f"""
WITH RECURSIVE {T.LATENTS},
u AS (SELECT batch_id, state_id, view_id, {_UNIT('z_inv')} AS v FROM latents),
cov AS (SELECT i, j, covar_samp(v[i], v[j]) AS c FROM u, range(1, 33) a(i), range(1, 33) b(j) GROUP BY 1, 2),
whole AS (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(c ORDER BY j) AS r FROM cov GROUP BY 1)),
{_component('first', 'whole')},
rest AS (SELECT list_transform(range(1, 33), lambda i: list_transform(range(1, 33), lambda j: m[i][j] - l * v[i] * v[j])) AS m FROM whole, first),
{_component('second', 'rest')}
SELECT batch_id, state_id, view_id, round(list_dot_product(u.v, first.v), 6) AS x, round(list_dot_product(u.v, second.v), 6) AS y
FROM u, first, second"""
ORACLE_SQL["l2c_infonce_mixed"] = (
    "SELECT batch_id, round(0.5::DOUBLE * (f.loss + p.loss), 6) AS loss FROM "
    f"({ORACLE_SQL['l2_infonce'].replace('round(avg(loss), 6)', 'avg(loss)')}) f JOIN "
    f"({ORACLE_SQL['l2b_infonce_paired'].replace('round(avg(ln(exp(p) + exp(n) + exp(m)) - p), 6)', 'avg(ln(exp(p) + exp(n) + exp(m)) - p)')}) p USING (batch_id)"
)
ORACLE_SQL["l9c_live_codebook"] = ORACLE_SQL["l9b_codebook_of_groups"]
ORACLE_SQL["a1b_array_moments"] = ORACLE_SQL["a1_normalizer_stats"]
