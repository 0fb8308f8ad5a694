"""Scores, bootstrap intervals and paired comparisons over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidyfold.functions import arrays
from tidyfold.operators import bootstrap, metrics
from tidyfold.plans import roles
from tidyfold.plans.registry import query
from tidyfold.plans.roles import md5_sql
from tidyfold.session import stable

R = bootstrap.N_BOOTSTRAP

# true: the order's status; pred: a guess from its price and priority.
PRED_SQL = """CASE WHEN o_totalprice > 300000 THEN 'F' WHEN o_totalprice > 150000 THEN 'O' WHEN o_orderpriority < '4' THEN 'P' ELSE 'X' END"""
ROWS_SQL = f"rows AS (SELECT o_custkey AS case_id, o_orderkey, o_orderstatus AS truth, {PRED_SQL} AS pred FROM orders)"


def guesses(t):
    pred = (
        F.when(F.col("o_totalprice") > 300000, "F").when(F.col("o_totalprice") > 150000, "O").when(F.col("o_orderpriority") < "4", "P").otherwise("X")
    )
    return t.orders.select(F.col("o_custkey").alias("case_id"), "o_orderkey", F.col("o_orderstatus").alias("true"), pred.alias("pred"))


SCORES_SQL = """sup AS (SELECT {k} truth AS c, sum(w) AS support FROM cells GROUP BY ALL), prd AS (SELECT {k} pred AS c, sum(w) AS predicted FROM cells GROUP BY ALL),
    tp AS (SELECT {k} truth AS c, sum(w) AS tp FROM cells WHERE truth = pred GROUP BY ALL),
    cls AS (SELECT {k} c, coalesce(support, 0) AS support, coalesce(predicted, 0) AS predicted, coalesce(tp, 0) AS tp
        FROM sup FULL JOIN prd USING ({u} c) FULL JOIN tp USING ({u} c)),
    scores AS (SELECT {k} sum(tp) / sum(support) AS accuracy, avg(CASE WHEN support > 0 THEN tp / support END) AS balanced_accuracy,
        avg(CASE WHEN support + predicted > 0 THEN 2 * tp / (support + predicted) END) AS macro_f1,
        sum(CASE WHEN support + predicted > 0 THEN 2 * tp / (support + predicted) * support END) / sum(support) AS weighted_f1 FROM cls GROUP BY ALL)"""
SCORE_NAMES = ("accuracy", "balanced_accuracy", "macro_f1", "weighted_f1")


@query("metric_classification", "WITH " + ROWS_SQL + ", cells AS (SELECT truth, pred, count(*)::DOUBLE AS w FROM rows GROUP BY 1, 2), "
       + SCORES_SQL.format(k="", u="") + " SELECT " + ", ".join(f"round({s}, 6) AS {s}" for s in SCORE_NAMES) + " FROM scores")
def metric_classification(t):
    done = metrics.classification_scores(metrics.confusion(guesses(t), "true", "pred"))
    return done.select(*[F.round(s, 6).alias(s) for s in SCORE_NAMES])


AGREE_SQL = """cells AS (SELECT a, b, count(*)::DOUBLE AS w FROM labelled GROUP BY 1, 2), ra AS (SELECT a, sum(w) AS w FROM cells GROUP BY 1),
    rb AS (SELECT b, sum(w) AS w FROM cells GROUP BY 1), n AS (SELECT sum(w) AS n FROM cells),
    s AS (SELECT (SELECT sum(w * (w - 1) / 2) FROM cells) AS pc, (SELECT sum(w * (w - 1) / 2) FROM ra) AS pa, (SELECT sum(w * (w - 1) / 2) FROM rb) AS pb,
        (SELECT -sum(w / n * ln(w / n)) FROM ra, n) AS ha, (SELECT -sum(w / n * ln(w / n)) FROM rb, n) AS hb,
        (SELECT sum(c.w / n * ln(c.w * n / (ra.w * rb.w))) FROM cells c JOIN ra USING (a) JOIN rb USING (b), n) AS mi, n FROM n)
    SELECT round(mi / ((ha + hb) / 2), 6) AS nmi, round((pc - pa * pb / (n * (n - 1) / 2)) / (0.5 * (pa + pb) - pa * pb / (n * (n - 1) / 2)), 6) AS ari FROM s"""


@query("metric_clustering_agreement", "WITH labelled AS (SELECT p_brand AS a, p_type AS b FROM part), " + AGREE_SQL)
def metric_clustering_agreement(t):
    done = metrics.clustering_agreement(metrics.confusion(t.part, "p_brand", "p_type"))
    return done.select(F.round("nmi", 6).alias("nmi"), F.round("ari", 6).alias("ari"))


TARGET_SQL = """t AS (SELECT l_suppkey AS pathway, l_extendedprice / 1000 - 40 AS truth, l_quantity * 1.5 - 38 AS pred, o_custkey AS case_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def targets(t):
    owners = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("case_id"))
    return t.lineitem.join(owners, "l_orderkey").select(
        F.col("l_suppkey").alias("pathway"), (F.col("l_extendedprice") / 1000 - 40).alias("true"), (F.col("l_quantity") * 1.5 - 38).alias("pred"), "case_id"
    )


@query("metric_pathway_r2", "WITH " + TARGET_SQL + """, s AS (SELECT pathway, sum((truth - pred) ^ 2) AS r, sum(truth ^ 2) AS q FROM t GROUP BY 1)
    SELECT round(1 - sum(r) / sum(q), 6) AS r2_pooled, round(avg(1 - r / q), 6) AS r2_pathway FROM s""")
def metric_pathway_r2(t):
    sums = targets(t).groupBy("pathway").agg(*[F.sum(c).alias(n) for n, c in metrics.squared_sums().items()])
    return metrics.target_r2(sums, "pathway").select(F.round("r2_pooled", 6).alias("r2_pooled"), F.round("r2_pathway", 6).alias("r2_pathway"))


@query("metric_within_project_r2", "WITH " + TARGET_SQL + " SELECT round(1 - sum((truth - pred) ^ 2) / sum(truth ^ 2), 6) AS r2 FROM t")
def metric_within_project_r2(t):
    sums = targets(t).agg(*[F.sum(c).alias(n) for n, c in metrics.squared_sums().items()])
    return sums.select(F.round(1 - F.try_divide("ss_res", "ss_tot"), 6).alias("r2"))


# One row per embedding entry: truth, a lagged prediction and the class mean as baseline.
RECON_SQL = """e AS (SELECT vec_id AS sample, label, generate_subscripts(embedding, 1) - 1 AS feature, unnest(embedding)::DOUBLE AS truth FROM embeddings),
    m AS (SELECT label, feature, avg(truth) AS pred FROM e GROUP BY 1, 2), g AS (SELECT feature, avg(truth) AS baseline FROM e GROUP BY 1),
    rec AS (SELECT e.sample, e.label, e.feature, truth, round(pred, 6) AS pred, round(baseline, 6) AS baseline FROM e JOIN m USING (label, feature) JOIN g USING (feature))"""


def reconstruction(t):
    e = t.embeddings.select(F.col("vec_id").alias("sample"), "label", F.posexplode("embedding").alias("feature", "true"))
    e = e.withColumn("true", F.col("true").cast("double"))
    m = e.groupBy("label", "feature").agg(F.round(F.avg("true"), 6).alias("pred"))
    g = e.groupBy("feature").agg(F.round(F.avg("true"), 6).alias("baseline"))
    return e.join(m, ["label", "feature"]).join(g, "feature")


@query("metric_reconstruction_sums", "WITH " + RECON_SQL + """ SELECT feature, count(*)::DOUBLE AS total, round(sum((truth - pred) ^ 2), 6) AS ss_res,
    round(sum(truth - baseline), 6) AS first, round(sum((truth - baseline) ^ 2), 6) AS second FROM rec GROUP BY 1""")
def metric_reconstruction_sums(t):
    rows = reconstruction(t)
    shift = rows.groupBy("feature").agg(F.max("baseline").alias("shift"))
    sums = metrics.reconstruction_sums(rows, shift)
    return sums.select("feature", *[F.round(c, 6).alias(c) for c in ("total", "ss_res", "first", "second")])


@query("metric_reconstruction", "WITH " + RECON_SQL + """, g2 AS (SELECT feature, sum((truth - pred) ^ 2) AS res, var_pop(truth) * count(*) AS tot FROM rec GROUP BY 1),
    p AS (SELECT sample, corr(truth, pred) AS r, corr(truth, baseline) AS r0 FROM rec GROUP BY 1)
    SELECT round(1 - sum(res) / sum(tot), 6) AS r2_pooled, round(avg(1 - res / tot), 6) AS r2_gene,
    (SELECT round(avg(r), 6) FROM p) AS pearson_sample, (SELECT round(avg(r0), 6) FROM p) AS pearson_sample_baseline FROM g2""")
def metric_reconstruction(t):
    done = metrics.reconstruction_scores(reconstruction(t), "sample")
    return done.select(*[F.round(c, 6).alias(c) for c in done.columns])


@query("metric_sample_pearson", "WITH " + RECON_SQL + " SELECT sample, round(corr(truth, pred), 6) AS r FROM rec GROUP BY 1")
def metric_sample_pearson(t):
    return metrics.sample_pearson(reconstruction(t), "sample").select("sample", F.round("r", 6).alias("r"))


@query("metric_pearson_zero", """SELECT l_orderkey AS sample, CASE WHEN min(l_quantity) = max(l_quantity) OR min(l_discount) = max(l_discount) THEN 0
    ELSE round(corr(l_quantity, l_discount), 6) END AS r FROM lineitem GROUP BY 1""")
def metric_pearson_zero(t):
    rows = t.lineitem.select(F.col("l_orderkey").alias("sample"), F.col("l_quantity").alias("true"), F.col("l_discount").alias("pred"))
    return metrics.sample_pearson(rows, "sample", 0.0).select("sample", F.round("r", 6).alias("r"))


@query("metric_array_pearson", "WITH " + RECON_SQL + " SELECT sample, round(corr(truth, pred), 6) AS r FROM rec GROUP BY 1")
def metric_array_pearson(t):
    means = metrics.mean_vectors(t.embeddings, ["label"], "embedding", "pred")
    pred = F.transform("pred", lambda x: F.round(x, 6))
    rows = t.embeddings.join(means, "label")
    return rows.select(F.col("vec_id").alias("sample"), F.round(arrays.pearson(F.col("embedding"), pred), 6).alias("r"))


@query("metric_holdout", "WITH " + RECON_SQL + """, v AS (SELECT *, exp(pred) - pred * exp(truth) AS loss, feature < 40 AS visible FROM rec),
    p AS (SELECT sample, corr(truth, pred) AS r, 1 - sum((truth - pred) ^ 2) / (var_pop(truth) * count(*)) AS r2 FROM v WHERE NOT visible GROUP BY 1)
    SELECT (SELECT round(avg(loss), 6) FROM v WHERE visible) AS loss_visible, (SELECT round(avg(loss), 6) FROM v WHERE NOT visible) AS loss_heldout,
    round(avg(r), 6) AS pearson_heldout, round(avg(r2), 6) AS r2_heldout FROM p""")
def metric_holdout(t):
    rows = reconstruction(t).withColumn("visible", F.col("feature") < 40)
    done = metrics.holdout_metrics(rows, "sample", metrics.poisson_loss(F.col("pred"), F.col("true")))
    return done.select(*[F.round(c, 6).alias(c) for c in done.columns])


@query("metric_poisson_loss", "WITH " + RECON_SQL + " SELECT sample, feature, round(exp(pred) - pred * exp(truth), 5) AS loss FROM rec")
def metric_poisson_loss(t):
    return reconstruction(t).select("sample", "feature", F.round(metrics.poisson_loss(F.col("pred"), F.col("true")), 5).alias("loss"))


@query("metric_masked_mse", "WITH " + RECON_SQL + " SELECT label, round(avg((truth - pred) ^ 2) FILTER (truth > 0), 6) AS mse FROM rec GROUP BY 1")
def metric_masked_mse(t):
    return metrics.masked_mse(reconstruction(t).withColumn("mask", F.col("true") > 0), ["label"]).select("label", F.round("mse", 6).alias("mse"))


@query("metric_masked_accuracy", """SELECT l_returnflag, round(avg((l_linenumber = floor(l_quantity / 8))::INT) FILTER (l_discount < 0.05), 6) AS accuracy FROM lineitem GROUP BY 1""")
def metric_masked_accuracy(t):
    label = F.when(F.col("l_discount") < 0.05, F.floor(F.col("l_quantity") / 8)).otherwise(-100)
    rows = t.lineitem.select("l_returnflag", F.col("l_linenumber").alias("pred"), label.alias("label"))
    return metrics.masked_accuracy(rows, ["l_returnflag"]).select("l_returnflag", F.round("accuracy", 6).alias("accuracy"))


VEC = "list_transform(embedding, lambda x: x::DOUBLE)"
MEANS_SQL = """e AS (SELECT label, generate_subscripts(embedding, 1) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings),
    c AS (SELECT label, list(round(m, 6) ORDER BY dim) AS centre FROM (SELECT label, dim, avg(x) AS m FROM e GROUP BY 1, 2) GROUP BY 1)"""


def with_centres(t):
    means = metrics.mean_vectors(t.embeddings, ["label"], "embedding", "centre")
    return t.embeddings.join(means, "label").withColumn("centre", F.transform("centre", lambda x: F.round(x, 6)))


@query("vector_kernel", f"WITH {MEANS_SQL} SELECT vec_id, round(exp(-(list_distance({VEC}, centre) ^ 2) / 4096), 6) AS k FROM embeddings JOIN c USING (label)")
def vector_kernel(t):
    return with_centres(t).select("vec_id", F.round(arrays.gaussian_kernel(F.col("embedding"), F.col("centre")), 6).alias("k"))


@query("vector_cosine_distance", f"WITH {MEANS_SQL} SELECT vec_id, round(1 - list_cosine_similarity({VEC}, centre), 6) AS d FROM embeddings JOIN c USING (label)")
def vector_cosine_distance(t):
    return with_centres(t).select("vec_id", F.round(arrays.cosine_distance(F.col("embedding"), F.col("centre")), 6).alias("d"))


@query("vector_unit", """WITH e AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings)
    SELECT vec_id, dim, round(x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)), 6) AS x FROM e""")
def vector_unit(t):
    rows = t.embeddings.select("vec_id", F.posexplode(arrays.unit(F.col("embedding"))).alias("dim", "x"))
    return rows.select("vec_id", "dim", F.round("x", 6).alias("x"))


# ---- resampling

def boot_sql(replicates: int) -> str:
    return f"""numbered AS (SELECT case_id, row_number() OVER (ORDER BY substr(md5('boot:' || case_id), 1, 15), case_id) - 1 AS k, count(*) OVER () AS n
        FROM (SELECT DISTINCT case_id FROM rows)),
    draws AS (SELECT r AS replicate, {md5_sql("'1'", 'r', 'i')} % n AS k FROM (SELECT DISTINCT n FROM numbered), (SELECT unnest(range(1, {replicates + 1})) AS r), LATERAL (SELECT unnest(range(n)) AS i)),
    weights AS (SELECT replicate::INT AS replicate, case_id, weight FROM (SELECT replicate, k, count(*) AS weight FROM draws GROUP BY 1, 2) JOIN numbered USING (k)
        UNION ALL SELECT 0, case_id, 1 FROM numbered)"""


BOOT_SQL = boot_sql(R)


@query("boot_weights", "WITH " + ROWS_SQL + ", " + BOOT_SQL + " SELECT replicate, case_id, weight FROM weights")
def boot_weights(t):
    return bootstrap.bootstrap_weights(guesses(t), "case_id", R, 1, "md5")


def weights(t, rows):
    return stable(bootstrap.bootstrap_vectors(rows, "case_id", R, 1, "md5"))


CELLS_SQL = "cells AS (SELECT replicate, truth, pred, sum(weight)::DOUBLE AS w FROM rows JOIN weights USING (case_id) GROUP BY 1, 2, 3)"


def boot_scores(t):
    rows = guesses(t)
    cells = bootstrap.weigh(rows, weights(t, rows), "case_id", ["true", "pred"], {"w": F.lit(1.0)})
    return metrics.classification_scores(cells, ["replicate"])


@query("boot_classification", "WITH " + ROWS_SQL + ", " + BOOT_SQL + ", " + CELLS_SQL + ", " + SCORES_SQL.format(k="replicate,", u="replicate,")
       + " SELECT replicate, " + ", ".join(f"round({s}, 6) AS {s}" for s in SCORE_NAMES) + " FROM scores")
def boot_classification(t):
    return boot_scores(t).select("replicate", *[F.round(s, 6).alias(s) for s in SCORE_NAMES])


@query("boot_summary", "WITH " + ROWS_SQL + ", " + BOOT_SQL + ", " + CELLS_SQL + ", " + SCORES_SQL.format(k="replicate,", u="replicate,")
       + " SELECT " + ", ".join(f"round(max({s}) FILTER (replicate = 0), 6) AS {s}, round(quantile_cont({s}, 0.025) FILTER (replicate > 0), 6) AS {s}_lo, "
                                 f"round(quantile_cont({s}, 0.975) FILTER (replicate > 0), 6) AS {s}_hi" for s in SCORE_NAMES) + " FROM scores")
def boot_summary(t):
    done = bootstrap.summarize(boot_scores(t).withColumn("_k", F.lit(0)), ["_k"], SCORE_NAMES, keep=False)
    return done.select(*[F.round(c, 6).alias(c) for c in done.columns if c != "_k"])


@query("boot_interval", "WITH " + ROWS_SQL + ", " + BOOT_SQL + ", " + CELLS_SQL + ", " + SCORES_SQL.format(k="replicate,", u="replicate,")
       + """ SELECT 'accuracy' AS name, round(quantile_cont(accuracy, 0.05), 6) AS accuracy_lo, round(quantile_cont(accuracy, 0.95), 6) AS accuracy_hi FROM scores WHERE replicate > 0""")
def boot_interval(t):
    rows = boot_scores(t).filter("replicate > 0").withColumn("name", F.lit("accuracy"))
    done = bootstrap.interval(rows, ["name"], "accuracy", 0.9)
    return done.select("name", F.round("accuracy_lo", 6).alias("accuracy_lo"), F.round("accuracy_hi", 6).alias("accuracy_hi"))


MEAN_ROWS_SQL = "rows AS (SELECT o_custkey AS case_id, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS value FROM orders)"


@query("boot_weighted_mean", "WITH " + MEAN_ROWS_SQL + ", " + BOOT_SQL + """ SELECT replicate, round(sum(weight * value) / sum(weight) FILTER (value IS NOT NULL), 4) AS value
    FROM rows JOIN weights USING (case_id) GROUP BY 1""")
def boot_weighted_mean(t):
    rows = t.orders.select(F.col("o_custkey").alias("case_id"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("value"))
    return bootstrap.weighted_mean(rows, weights(t, rows), "case_id", "value").select("replicate", F.round("value", 4).alias("value"))


@query("boot_pathway_r2", "WITH " + TARGET_SQL.replace("t AS", "rows AS") + ", " + BOOT_SQL + """, s AS (SELECT replicate, pathway, sum(weight * (truth - pred) ^ 2) AS r, sum(weight * truth ^ 2) AS q
    FROM rows JOIN weights USING (case_id) GROUP BY 1, 2) SELECT replicate, round(1 - sum(r) / sum(q), 6) AS r2_pooled, round(avg(1 - r / q), 6) AS r2_pathway FROM s GROUP BY 1""")
def boot_pathway_r2(t):
    rows = targets(t)
    sums = bootstrap.weigh(rows, weights(t, rows), "case_id", ["pathway"], metrics.squared_sums())
    done = metrics.target_r2(sums, "pathway", ["replicate"])
    return done.select("replicate", F.round("r2_pooled", 6).alias("r2_pooled"), F.round("r2_pathway", 6).alias("r2_pathway"))


def score_table(t):
    """Two embeddings' score rows per nation: order prices against a rougher copy."""
    rows = roles.samples(t).select("case_id", "project", "price")
    w = weights(t, rows)
    parts = []
    for name, value in (("fine", F.col("price") / 1000), ("rough", F.floor(F.col("price") / 20000) * 20)):
        sums = bootstrap.weigh(rows, w, "case_id", ["project"], {"s": value, "n": F.lit(1)})
        scores = sums.select("replicate", "project", (F.col("s") / F.col("n")).alias("mean_price"))
        table = bootstrap.summarize(scores, ["project"], ["mean_price"])
        counts = rows.groupBy("project").agg(F.count("*").alias("n"))
        parts.append(table.join(counts, "project").withColumn("embeddings", F.lit(name)))
    return parts[0].unionByName(parts[1])


PAIR_SQL = "WITH rows AS (SELECT o_custkey AS case_id, c_nationkey AS project, o_totalprice AS price FROM orders JOIN customer ON o_custkey = c_custkey), " + BOOT_SQL + """,
    sc AS (SELECT replicate, project, sum(weight * price / 1000) / sum(weight) AS a, sum(weight * floor(price / 20000) * 20) / sum(weight) AS b FROM rows JOIN weights USING (case_id) GROUP BY 1, 2),
    d AS (SELECT project, max(a - b) FILTER (replicate = 0) AS delta, quantile_cont(a - b, 0.025) FILTER (replicate > 0) AS delta_lo,
        quantile_cont(a - b, 0.975) FILTER (replicate > 0) AS delta_hi, avg((a - b > 0)::INT) FILTER (replicate > 0) AS share_above FROM sc GROUP BY 1)"""
PAIR_COLUMNS = ("delta", "delta_lo", "delta_hi", "share_above")


@query("paired_differences", PAIR_SQL + " SELECT project, 'mean_price' AS score, " + ", ".join(f"round({c}, 5) AS {c}" for c in PAIR_COLUMNS) + " FROM d")
def paired_differences(t):
    done = bootstrap.paired_differences(score_table(t), "fine", "rough", ["project"], ["n"], ["mean_price"])
    return done.select("project", "score", *[F.round(c, 5).alias(c) for c in PAIR_COLUMNS])


@query("paired_all_differences", PAIR_SQL + " SELECT 'prices' AS table, 'fine' AS embeddings, project::VARCHAR AS row, 'mean_price' AS score, "
       + ", ".join(f"round({c}, 5) AS {c}" for c in PAIR_COLUMNS) + " FROM d")
def paired_all_differences(t):
    done = bootstrap.all_differences({"prices": (score_table(t), ["project"], ["n"], ["mean_price"])}, "rough", ["fine", "rough"])
    return done.select("table", "embeddings", "row", "score", *[F.round(c, 5).alias(c) for c in PAIR_COLUMNS])
