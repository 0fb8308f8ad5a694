"""Linear and survival probes over the given tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tidyfold.functions.hashing import md5_hash
from tidyfold.operators import bootstrap, linear, splits, survival
from tidyfold.plans import baseline, probes, roles
from tidyfold.plans.queries_metrics import boot_sql
from tidyfold.plans.registry import query
from tidyfold.plans.roles import SQL_SURVIVAL

# Replicates of the concordance queries whose pairs are counted per replicate; the probes and the score rows take the library's default.
R = 20


def embedded(t):
    """Vectors as samples: case = a pair of vectors with one label, project = label, batch and quality from the ids' hash."""
    ids = t.embeddings.select(
        F.col("vec_id").alias("sample"), "label", "embedding", F.concat_ws("-", F.col("label").cast("string"), F.floor(F.col("vec_id") / 2).cast("string")).alias("case_id"),
    )
    return ids.withColumn("project", F.col("label").cast("string"))


def planned(t):
    rows = embedded(t)
    cohort = splits.with_buckets(rows.drop("embedding"), "case_id", "project", roles.SALT, "md5")
    extra = cohort.withColumn("plate", F.pmod(md5_hash("plate", F.col("case_id")), F.lit(4))).withColumn("sample_type", F.lit("Primary Tumor"))
    # One embedding for every fold, each fold's model being the same here.
    return splits.plan(splits.every_fold(rows.select("sample", "embedding")), extra, "sample", validate=False)


@query("probe_classification")
def probe_classification(t):
    task = F.when(F.col("label") < 3, F.col("label"))
    done = probes.classification_probe(planned(t), {"label": F.col("label"), "within_three": task}, "case_id", hash_fn="md5")
    return done.drop(*[c for c in done.columns if c.endswith("_boot")])


@query("probe_invertibility")
def probe_invertibility(t):
    """How well a ridge recovers the products of neighbouring entries."""
    target = F.transform(F.sequence(F.lit(1), F.size("embedding") - 1), lambda i: F.get("embedding", i - 1) * F.get("embedding", i).cast("double"))
    done = probes.invertibility(planned(t).withColumn("target", target), case="case_id", hash_fn="md5")
    return done.drop(*[c for c in done.columns if c.endswith("_boot")])


@query("probe_pathways")
def probe_pathways(t):
    scores = t.embeddings.select(F.col("vec_id").alias("sample"), *[(F.col("embedding")[i] + F.col("embedding")[i + 1]).cast("double").alias(f"p{i}") for i in range(4)])
    done = probes.pathway_probe(planned(t), scores, "sample", "case_id", "project", F.lit(True), hash_fn="md5")
    return done.drop(*[c for c in done.columns if c.endswith("_boot")])


@query("probe_geometry")
def probe_geometry(t):
    done = probes.geometry_probe(planned(t), F.col("label"), "sample", "case_id", hash_fn="md5")
    return done.drop(*[c for c in done.columns if c.endswith("_boot")])


@query("probe_confounders")
def probe_confounders(t):
    rows = planned(t).withColumn("log_reads", F.log10(1 + F.abs(F.col("embedding")[0].cast("double"))))
    done = probes.confounder_probe(rows, ["log_reads"], ["plate"], "sample", "case_id", "project", F.lit(True), hash_fn="md5")
    return done.drop(*[c for c in done.columns if c.endswith("_boot")])


@query("baseline_pca")
def baseline_pca(t):
    """Share of variance the first eight axes keep, per fold; signs are fixed, so vectors are stable."""
    rows = splits.with_buckets(embedded(t), "case_id", "project", roles.SALT, "md5").select("sample", "bucket", "embedding")
    done = baseline.pca_every_fold(rows.withColumnRenamed("embedding", "raw"), "raw", 8)
    return done.select("fold", "sample", F.posexplode("embedding").alias("axis", "v")).groupBy("fold", "axis").agg(F.round(F.var_pop("v"), 6).alias("variance"))


@query("ridge_leave_one_out")
def ridge_leave_one_out(t):
    """The leave-one-out error of every penalty."""
    rows = t.embeddings.select(F.lit(0).alias("fold"), F.slice("embedding", 1, 60).alias("x"), F.slice("embedding", 61, 4).alias("y"))
    (fit,) = linear.fit_ridges(rows, "x", "y", "fold").values()
    found = [(float(a), float(e), bool(a == fit.alpha)) for a, e in zip(linear.ALPHAS, fit.errors, strict=True)]
    return t.spark.createDataFrame(found, "alpha double, error double, chosen boolean")


@query("ridge_leave_one_out_single", """WITH v AS (SELECT vec_id, embedding[1]::DOUBLE AS x0, embedding FROM embeddings),
    s AS (SELECT count(*) AS n, avg(x0) AS m, stddev_pop(x0) AS sd FROM v), z AS (SELECT vec_id, (x0 - m) / sd AS z, n FROM v, s),
    y AS (SELECT vec_id, j, embedding[j]::DOUBLE AS y FROM v, (SELECT unnest(range(2, 65)) AS j)), yc AS (SELECT j, avg(y) AS my FROM y GROUP BY 1),
    c AS (SELECT vec_id, j, z, n, y - my AS y FROM y JOIN yc USING (j) JOIN z USING (vec_id)), b AS (SELECT j, sum(z * y) AS zy FROM c GROUP BY 1),
    e AS (SELECT a AS alpha, sum(((y - z * zy / (n + a)) / (1 - 1.0 / n - z * z / (n + a))) ^ 2) / count(*) AS error FROM c JOIN b USING (j), (SELECT unnest([0.01, 0.1, 1.0, 10.0, 100.0, 1000.0, 10000.0]::DOUBLE[]) AS a) GROUP BY 1)
    SELECT alpha, round(error, 6) AS error, alpha = arg_min(alpha, error) OVER () AS chosen FROM e""")
def ridge_leave_one_out_single(t):
    """One column against the 63 others, in target tiles of 16: the whole error in closed form."""
    rows = t.embeddings.select(F.lit(0).alias("fold"), F.slice("embedding", 1, 1).alias("x"), F.slice("embedding", 2, 63).alias("y"))
    (fit,) = linear.fit_ridges(rows, "x", "y", "fold", targets=16).values()
    found = [(float(a), round(float(e), 6), bool(a == fit.alpha)) for a, e in zip(linear.ALPHAS, fit.errors, strict=True)]
    return t.spark.createDataFrame(found, "alpha double, error double, chosen boolean")


@query("ridge_moments", """WITH e AS (SELECT label, vec_id, generate_subscripts(embedding, 1) - 1 AS d, unnest(embedding)::DOUBLE AS x FROM embeddings)
    SELECT a.label, a.d AS i, b.d AS j, round(sum(a.x * b.x), 6) AS cross FROM e a JOIN e b USING (label, vec_id) GROUP BY 1, 2, 3""")
def ridge_moments(t):
    found = linear.moments(t.embeddings, "embedding", "embedding", "label")
    rows = [(k, i, j, round(float(v), 6)) for k, m in found.items() for (i, j), v in np.ndenumerate(m["cross"])]
    return t.spark.createDataFrame(rows, "label int, i int, j int, cross double")


# ---- survival: time to a user's first purchase

CASES_SQL = "WITH " + SQL_SURVIVAL.strip()
PAIRS_SQL = """pr AS (SELECT a.project, count(*) AS pairs, sum(CASE WHEN a.risk > b.risk THEN 1.0 WHEN a.risk = b.risk THEN 0.5 ELSE 0 END) AS concordant
    FROM surv a JOIN surv b ON a.project = b.project AND a.event = 1 AND a.time < b.time GROUP BY 1)"""


@query("survival_cases", CASES_SQL + " SELECT user_id, project, risk, event, time FROM surv")
def survival_cases(t):
    return roles.survival_cases(t)


@query("survival_concordance", CASES_SQL + ", " + PAIRS_SQL + " SELECT round(sum(concordant) / sum(pairs), 6) AS c_index, sum(pairs)::BIGINT AS pairs FROM pr")
def survival_concordance(t):
    return survival.concordance(roles.survival_cases(t), ["project"]).select(F.round("c_index", 6).alias("c_index"), "pairs")


@query("survival_concordance_pooled", CASES_SQL + """ SELECT round(avg(CASE WHEN a.risk > b.risk THEN 1.0 WHEN a.risk = b.risk THEN 0.5 ELSE 0 END), 6) AS c_index, count(*) AS pairs
    FROM surv a JOIN surv b ON a.event = 1 AND a.time < b.time""")
def survival_concordance_pooled(t):
    return survival.concordance(roles.survival_cases(t)).select(F.round("c_index", 6).alias("c_index"), "pairs")


@query("survival_pairs_by_project", CASES_SQL + ", " + PAIRS_SQL + " SELECT project, concordant::DOUBLE AS concordant, pairs::BIGINT AS pairs FROM pr")
def survival_pairs_by_project(t):
    sums = survival.concordance_sums(roles.survival_cases(t), ["project"]).filter("pairs > 0")
    return sums.select("project", "concordant", F.col("pairs").cast("bigint").alias("pairs"))


STRAT_SQL = CASES_SQL + ", rows AS (SELECT *, user_id AS case_id FROM surv), " + boot_sql(R) + """, sw AS (SELECT s.*, replicate, weight FROM rows s JOIN weights USING (case_id)),
    pr AS (SELECT a.replicate, a.project, sum(a.weight * b.weight) AS pairs,
        sum(a.weight * b.weight * CASE WHEN a.risk > b.risk THEN 1.0 WHEN a.risk = b.risk THEN 0.5 ELSE 0 END) AS concordant
        FROM sw a JOIN sw b ON a.project = b.project AND a.replicate = b.replicate AND a.event = 1 AND a.time < b.time GROUP BY 1, 2),
    ev AS (SELECT project, sum(event) AS events FROM surv GROUP BY 1)"""


def stratified(t):
    rows = roles.survival_cases(t)
    weights = bootstrap.bootstrap_weights(rows, "user_id", R, 1, "md5")
    return survival.stratified_concordance(rows, weights, "user_id", ["project"], "project")


@query("survival_stratified_bootstrap", STRAT_SQL + """ SELECT replicate, round(sum(concordant) / sum(pairs), 6) AS c_index,
    round(avg(concordant / pairs) FILTER (events >= 10), 6) AS c_index_macro, sum(pairs)::DOUBLE AS pairs FROM pr JOIN ev USING (project) GROUP BY 1""")
def survival_stratified_bootstrap(t):
    pooled, _ = stratified(t)
    return pooled.select("replicate", F.round("c_index", 6).alias("c_index"), F.round("c_index_macro", 6).alias("c_index_macro"), "pairs")


@query("survival_by_project_bootstrap", STRAT_SQL + " SELECT replicate, project, round(concordant / pairs, 6) AS c_index FROM pr WHERE pairs > 0")
def survival_by_project_bootstrap(t):
    _, by_project = stratified(t)
    return by_project.filter("pairs > 0").select("replicate", "project", F.round("c_index", 6).alias("c_index"))


def covariates(t):
    """Users with four covariates: their shares of event types before any outcome is known."""
    kinds = ("click", "error", "signup", "view")
    shares = t.events.groupBy("user_id").agg(*[F.avg((F.col("event_type") == k).cast("double")).alias(k) for k in kinds])
    vector = F.array(*[F.col(k) * 4 - 0.8 for k in kinds])
    return roles.survival_cases(t).join(shares.select("user_id", vector.alias("x")), "user_id")


BETA = (0.5, -0.25, 0.75, 0.1)


@query("survival_cox_objective", CASES_SQL + """, sh AS (SELECT user_id, avg((event_type = 'click')::INT) * 4 - 0.8 AS x0, avg((event_type = 'error')::INT) * 4 - 0.8 AS x1,
        avg((event_type = 'signup')::INT) * 4 - 0.8 AS x2, avg((event_type = 'view')::INT) * 4 - 0.8 AS x3 FROM events GROUP BY 1),
    z AS (SELECT s.*, x0, x1, x2, x3, 0.5 * x0 - 0.25 * x1 + 0.75 * x2 + 0.1 * x3 AS eta FROM surv s JOIN sh USING (user_id)),
    risk AS (SELECT a.user_id, max(a.eta) AS eta, sum(exp(b.eta)) AS s0, sum(exp(b.eta) * b.x0) / sum(exp(b.eta)) AS m0, sum(exp(b.eta) * b.x1) / sum(exp(b.eta)) AS m1,
        sum(exp(b.eta) * b.x2) / sum(exp(b.eta)) AS m2, sum(exp(b.eta) * b.x3) / sum(exp(b.eta)) AS m3
        FROM z a JOIN z b ON a.project = b.project AND a.event = 1 AND b.time >= a.time GROUP BY 1),
    n AS (SELECT count(*) AS n FROM z)
    SELECT round(-sum(r.eta - ln(s0)) / max(n) + 0.05 * (0.25 + 0.0625 + 0.5625 + 0.01), 6) AS loss,
    round(-sum(x0 - m0) / max(n) + 0.05, 6) AS g0, round(-sum(x1 - m1) / max(n) - 0.025, 6) AS g1,
    round(-sum(x2 - m2) / max(n) + 0.075, 6) AS g2, round(-sum(x3 - m3) / max(n) + 0.01, 6) AS g3 FROM risk r JOIN z USING (user_id), n""")
def survival_cox_objective(t):
    loss, grad = survival.cox_objective(covariates(t), "x", ["project"], np.array(BETA), 0.1)
    row = (round(loss, 6), *[round(float(g), 6) + 0.0 for g in grad])
    return t.spark.createDataFrame([row], "loss double, g0 double, g1 double, g2 double, g3 double")


@query("survival_cox_fit")
def survival_cox_fit(t):
    from tidyfold.session import stable

    beta = survival.fit_cox(stable(covariates(t)), "x", ["project"], 0.1)
    return t.spark.createDataFrame([(i, float(b)) for i, b in enumerate(beta)], "i int, beta double")


@query("survival_risks", """WITH sh AS (SELECT user_id, avg((event_type = 'click')::INT) * 4 - 0.8 AS x0, avg((event_type = 'error')::INT) * 4 - 0.8 AS x1,
        avg((event_type = 'signup')::INT) * 4 - 0.8 AS x2, avg((event_type = 'view')::INT) * 4 - 0.8 AS x3 FROM events GROUP BY 1)
    SELECT user_id, round(0.5 * x0 - 0.25 * x1 + 0.75 * x2 + 0.1 * x3, 6) AS risk FROM sh""")
def survival_risks(t):
    rows = covariates(t).drop("risk").withColumn("m", F.lit(0))
    return survival.risks_by_model(rows, "x", "m", {0: np.array(BETA)}).select("user_id", F.round("risk", 6).alias("risk"))


@query("survival_score_rows", STRAT_SQL.replace(boot_sql(R), boot_sql(bootstrap.N_BOOTSTRAP)) + """, by_p AS (SELECT project, round(max(concordant / pairs) FILTER (replicate = 0), 6) AS c_index,
        round(quantile_cont(concordant / pairs, 0.025) FILTER (replicate > 0), 6) AS c_index_lo, round(quantile_cont(concordant / pairs, 0.975) FILTER (replicate > 0), 6) AS c_index_hi,
        max(pairs) FILTER (replicate = 0)::BIGINT AS pairs FROM pr WHERE pairs > 0 GROUP BY 1)
    SELECT project, count(*) AS patients, sum(event)::BIGINT AS events, max(pairs) AS pairs, max(c_index) AS c_index, max(c_index_lo) AS c_index_lo, max(c_index_hi) AS c_index_hi
    FROM surv JOIN by_p USING (project) GROUP BY 1""")
def survival_score_rows(t):
    rows = roles.survival_cases(t).withColumn("fold", F.lit(0))
    weights = bootstrap.bootstrap_vectors(rows, "user_id", bootstrap.N_BOOTSTRAP, 1, "md5")
    _, projects = survival.survival_scores(rows, weights, "purchase", "cv", 0.1, "user_id")
    return projects.filter("pairs > 0").select(
        "project", "patients", "events", "pairs", *[F.round(c, 6).alias(c) for c in ("c_index", "c_index_lo", "c_index_hi")]
    )


@query("survival_penalty_path")
def survival_penalty_path(t):
    """The penalty that inner folds choose for each of five outer folds."""
    from tidyfold.session import stable

    rows = stable(covariates(t).drop("risk").withColumn("fold", F.pmod(F.xxhash64("user_id"), F.lit(5)).cast("int")))
    chosen = survival.select_alphas(rows, "x", "fold", ["project"], "user_id")
    return t.spark.createDataFrame(sorted((m, float(a)) for m, a in chosen.items()), "fold int, alpha double")


@query("survival_probe")
def survival_probe(t):
    """Each project's held-out concordance, from the users' own event shares as embeddings."""
    cases = covariates(t).drop("risk").select(F.col("user_id").alias("sample"), F.col("user_id").cast("string").alias("case_id"), "project", F.col("x").alias("embedding"), "event", "time")
    cohort = splits.with_buckets(cases.drop("embedding", "event", "time"), "case_id", "project", roles.SALT, "md5").withColumn("sample_type", F.lit("Primary Tumor"))
    rows = splits.plan(splits.every_fold(cases.select("sample", "embedding")), cohort, "sample", validate=False)
    labels = cases.select("case_id", F.col("event").cast("bigint").alias("pfi_event"), F.col("time").cast("double").alias("pfi_time"))
    _, projects = probes.survival_probe(rows, labels, n_bootstrap=R, hash_fn="md5", case="case_id", project="project", row="sample")
    return projects.drop(*[c for c in projects.columns if c.endswith("_boot")])
