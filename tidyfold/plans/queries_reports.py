"""Cohort and score report tables, leakage checks and sources over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidyfold.operators import checks, reports, splits
from tidyfold.plans import roles
from tidyfold.plans.queries_metrics import PAIR_SQL, score_table
from tidyfold.plans.registry import query
from tidyfold.plans.roles import SQL_BUCKETS, SQL_SAMPLES

BASE = "WITH " + SQL_BUCKETS.strip()
WITH_SAMPLES = BASE + "," + SQL_SAMPLES
PLAIN_SAMPLES = "WITH samples AS (SELECT o_orderkey AS sample, o_custkey AS case_id, o_orderstatus AS sample_type, o_totalprice AS price, c_nationkey AS project FROM orders JOIN customer ON o_custkey = c_custkey)"


@query("report_cohort", PLAIN_SAMPLES + """ SELECT project, count(*) AS samples, count(DISTINCT case_id) AS cases, sum((sample_type = 'F')::INT)::BIGINT AS normals FROM samples GROUP BY 1""")
def report_cohort(t):
    return reports.cohort_by_project(roles.samples(t), "project", "case_id", F.col("sample_type") == "F")


@query("report_sample_types", "SELECT o_orderstatus AS sample_type, count(*) AS n FROM orders GROUP BY 1")
def report_sample_types(t):
    return reports.value_counts(t.orders.withColumnRenamed("o_orderstatus", "sample_type"), "sample_type")


@query("report_samples_per_case", "SELECT per_case, count(*) AS cases FROM (SELECT o_custkey, count(*) AS per_case FROM orders GROUP BY 1) GROUP BY 1")
def report_samples_per_case(t):
    return reports.per_case_histogram(t.orders, "o_custkey")


@query("report_mixed_cases", "SELECT o_custkey AS case_id FROM orders GROUP BY 1 HAVING count(*) FILTER (o_orderstatus = 'F') > 0 AND count(*) FILTER (o_orderstatus <> 'F') > 0")
def report_mixed_cases(t):
    return reports.mixed_cases(t.orders.withColumnRenamed("o_custkey", "case_id"), "case_id", F.col("o_orderstatus") == "F")


@query("report_bin_edges", "SELECT floor(min(o_totalprice) / 25000) * 25000 AS lo, ceil(max(o_totalprice) / 25000) * 25000 AS hi, ((ceil(max(o_totalprice) / 25000) - floor(min(o_totalprice) / 25000)))::BIGINT AS bins FROM orders")
def report_bin_edges(t):
    return reports.bin_edges(t.orders, "o_totalprice", 25000.0)


@query("report_histogram", """WITH e AS (SELECT floor(min(o_totalprice) / 25000) * 25000 AS lo, (ceil(max(o_totalprice) / 25000) - floor(min(o_totalprice) / 25000))::BIGINT AS bins FROM orders),
    b AS (SELECT unnest(range(bins)) AS bin, lo FROM e), c AS (SELECT least(floor((o_totalprice - lo) / 25000)::BIGINT, bins - 1) AS bin, count(*) AS n FROM orders, e GROUP BY 1)
    SELECT bin, lo + bin * 25000 AS left, coalesce(n, 0) AS n, (SELECT round(median(o_totalprice), 4) FROM orders) AS median FROM b LEFT JOIN c USING (bin)""")
def report_histogram(t):
    return reports.histogram(t.orders, "o_totalprice", 25000.0).withColumn("median", F.round("median", 4))


@query("report_depth_quantiles", """WITH d AS (SELECT l_orderkey, sum(l_extendedprice) AS depth FROM lineitem GROUP BY 1)
    SELECT round(quantile_cont(depth, 0.01), 4) AS low, round(median(depth), 4) AS middle, round(quantile_cont(depth, 0.99), 4) AS high FROM d""")
def report_depth_quantiles(t):
    depth = t.lineitem.groupBy("l_orderkey").agg(F.round(F.sum("l_extendedprice"), 6).alias("depth"))
    done = reports.quantile_row(depth, "depth", {"low": 0.01, "middle": 0.5, "high": 0.99})
    return done.select(*[F.round(c, 4).alias(c) for c in done.columns])


CHI_SQL = """WITH c AS (SELECT p_brand AS a, p_type AS b, count(*)::DOUBLE AS o FROM part GROUP BY 1, 2), r AS (SELECT a, sum(o) AS r FROM c GROUP BY 1), k AS (SELECT b, sum(o) AS k FROM c GROUP BY 1),
    g AS (SELECT r.a, k.b, r.r * k.k / (SELECT sum(o) FROM c) AS e FROM r, k)
    SELECT round(sum((coalesce(o, 0) - e) ^ 2 / e), 6) AS chi2, ((count(DISTINCT g.a) - 1) * (count(DISTINCT g.b) - 1))::BIGINT AS dof FROM g LEFT JOIN c ON c.a = g.a AND c.b = g.b"""


@query("report_chi_square", CHI_SQL)
def report_chi_square(t):
    return reports.chi_square_statistic(t.part, "p_brand", "p_type").select(F.round("chi2", 6).alias("chi2"), "dof")


@query("report_chi_square_test", CHI_SQL)
def report_chi_square_test(t):
    return reports.chi_square(t.part, "p_brand", "p_type").select(F.round("chi2", 6).alias("chi2"), "dof")


@query("report_top_groups", """WITH r AS (SELECT p_brand, count(*) AS features, sum(coalesce(q, 0)) AS reads FROM part LEFT JOIN (SELECT l_partkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1) ON l_partkey = p_partkey GROUP BY 1),
    k AS (SELECT *, row_number() OVER (ORDER BY reads DESC, p_brand) <= 9 AS top FROM r)
    SELECT CASE WHEN top THEN p_brand ELSE 'other' END AS p_brand, sum(features)::BIGINT AS features, sum(reads) AS reads, round(sum(reads) / (SELECT sum(reads) FROM r), 6) AS share FROM k GROUP BY 1""")
def report_top_groups(t):
    reads = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sum("l_quantity").alias("q"))
    rows = t.part.join(reads, "p_partkey", "left")
    done = reports.top_groups(rows, "p_brand", F.coalesce("q", F.lit(0.0)))
    return done.withColumn("share", F.round("share", 6))


VALS = "WITH vals AS (SELECT o_custkey AS sample, l_partkey AS feature, sum(l_quantity) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"


@query("report_detection_by_feature", VALS + " SELECT feature, round(count(*) FILTER (value > 25) / (SELECT count(*) FROM customer), 6) AS rate FROM vals GROUP BY 1")
def report_detection_by_feature(t):
    above = roles.values(t).withColumn("value", F.col("value") - 25)
    done = reports.detection_by_feature(above, t.customer.agg(F.count("*")).scalar())
    return done.withColumn("rate", F.round("rate", 6))


@query("report_detection_by_sample", VALS + " SELECT sample, count(*) AS detected FROM vals GROUP BY 1")
def report_detection_by_sample(t):
    return reports.detection_by_sample(roles.values(t), "sample")


@query("report_detection_extremes", """WITH b AS (SELECT p_brand || '/' || p_size AS feature, count(DISTINCT c_nationkey) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey GROUP BY 1), f AS (SELECT DISTINCT p_brand || '/' || p_size AS feature FROM part)
    SELECT count(*) FILTER (n = (SELECT count(*) FROM nation)) AS always, count(*) FILTER (n IS NULL) AS never FROM f LEFT JOIN b USING (feature)""")
def report_detection_extremes(t):
    kind = F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("feature")
    lines = (
        t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    )
    values = lines.groupBy(F.col("c_nationkey").alias("sample"), kind).agg(F.sum("l_quantity").alias("value"))
    return reports.detection_extremes(values, t.part.select(kind).distinct(), t.nation.agg(F.count("*")).scalar())


@query("report_fold_sizes", WITH_SAMPLES + """ SELECT fold, CASE WHEN test_fold = fold THEN 'test' WHEN bucket % 20 >= 18 THEN 'val' ELSE 'train' END AS split,
    count(*) AS samples, count(DISTINCT case_id) AS cases FROM samples, (SELECT unnest([0, 1, 2, 3, 4]) AS fold) GROUP BY 1, 2""")
def report_fold_sizes(t):
    return reports.fold_sizes(splits.every_split(roles.bucketed_samples(t)), "case_id")


@query("report_project_balance", BASE + " SELECT project, " + ", ".join(f"count(*) FILTER (test_fold = {k}) AS fold{k}" for k in range(5))
       + ", count(*) AS total, greatest(" + ", ".join(f"abs(count(*) FILTER (test_fold = {k}) - count(*) / 5)" for k in range(5)) + ") AS deviation FROM folded GROUP BY 1")
def report_project_balance(t):
    return reports.project_balance(roles.bucketed(t), "project")


@query("report_type_balance", WITH_SAMPLES + " SELECT sample_type, " + ", ".join(f"count(*) FILTER (test_fold = {k}) AS fold{k}" for k in range(5)) + " FROM samples GROUP BY 1 HAVING count(*) >= 25")
def report_type_balance(t):
    return reports.type_balance(roles.bucketed_samples(t), "sample_type")


@query("report_worked_examples", BASE + """ SELECT case_id, rnk AS rank, size, bucket, test_fold AS fold, """ + " || ',' || ".join(
    f"CASE WHEN test_fold = {k} THEN 'test' WHEN bucket % 20 >= 18 THEN 'val' ELSE 'train' END" for k in range(5)) + " AS roles FROM folded WHERE case_id IN (3, 14, 15, 92)")
def report_worked_examples(t):
    return reports.worked_examples(roles.buckets(t), "case_id", [3, 14, 15, 92])


@query("report_constant_scores", PLAIN_SAMPLES + """, c AS (SELECT project, count(*)::DOUBLE AS n FROM samples GROUP BY 1)
    SELECT round(1.0 / count(*), 6) AS balanced_accuracy, round(sum((n / (SELECT sum(n) FROM c)) ^ 2), 6) AS precision, 0.5::DOUBLE AS c_index, 0.0::DOUBLE AS r2 FROM c""")
def report_constant_scores(t):
    done = reports.constant_scores(roles.samples(t), "project")
    return done.select(F.round("balanced_accuracy", 6).alias("balanced_accuracy"), F.round("precision", 6).alias("precision"), "c_index", "r2")


@query("report_majority", PLAIN_SAMPLES + ", c AS (SELECT project, sample_type, count(*) AS n FROM samples GROUP BY 1, 2) SELECT project, round(max(n) / sum(n), 6) AS share, count(*) AS classes FROM c GROUP BY 1")
def report_majority(t):
    return reports.majority(roles.samples(t), "sample_type", ["project"]).withColumn("share", F.round("share", 6))


# A sweep: how well the first `dims` suppliers by key explain a nation's mean quantity.
SWEEP_SQL = """sweep AS (SELECT c_nationkey AS project, p_size AS dims, round(avg(l_discount), 4) AS score FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""


def sweep(t):
    lines = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(
        t.part, F.col("l_partkey") == F.col("p_partkey")
    )
    return lines.groupBy(F.col("c_nationkey").alias("project"), F.col("p_size").alias("dims")).agg(F.round(F.avg("l_discount"), 4).alias("score"))


@query("report_smallest_near_best", "WITH " + SWEEP_SQL + """, h AS (SELECT project, max(dims) AS largest, arg_max(score, dims) AS head FROM sweep GROUP BY 1)
    SELECT project, largest, head AS score, min(dims) FILTER (round(abs(sweep.score - head), 6) <= 0.00215) AS enough FROM sweep JOIN h USING (project) GROUP BY 1, 2, 3""")
def report_smallest_near_best(t):
    return reports.smallest_near_best(sweep(t), ["project"], "dims", "score", 0.00215)


@query("report_spread", "WITH " + SWEEP_SQL + """, p AS (SELECT project, round(avg(score), 6) AS v, quantile_cont(score, 0.1) AS lo, quantile_cont(score, 0.9) AS hi FROM sweep GROUP BY 1)
    SELECT project, arg_max(dims, (round(abs(score - v), 6), dims)) AS worst, round(max(abs(score - v)), 6) AS distance, count(*) FILTER (score < lo OR score > hi) AS outside,
    round(stddev_samp(score) / ((max(hi) - max(lo)) / 2), 6) AS ratio FROM sweep JOIN p USING (project) GROUP BY 1""")
def report_spread(t):
    rows = sweep(t).withColumnRenamed("score", "value")
    ends = F.percentile("value", F.array(F.lit(0.1), F.lit(0.9)))
    pooled = rows.groupBy("project").agg(F.round(F.avg("value"), 6).alias("value"), ends[0].alias("lo"), ends[1].alias("hi"))
    done = reports.spread(rows, pooled, ["project"], "dims")
    return done.select("project", "worst", F.round("distance", 6).alias("distance"), "outside", F.round("ratio", 6).alias("ratio"))


@query("report_metastasis_only", PLAIN_SAMPLES + """, c AS (SELECT project, case_id FROM samples GROUP BY 1, 2 HAVING bool_or(sample_type = 'P') AND NOT bool_or(sample_type = 'O'))
    SELECT project, count(*) AS cases FROM c GROUP BY 1""")
def report_metastasis_only(t):
    return reports.metastasis_only(roles.samples(t), "case_id", "project", F.col("sample_type") == "P", F.col("sample_type") == "O")


@query("report_projects_side_by_side", PLAIN_SAMPLES + """ SELECT project, round(avg(price) FILTER (sample_type = 'F'), 4) AS "F", round(avg(price) FILTER (sample_type = 'O'), 4) AS "O",
    round(avg(price) FILTER (sample_type = 'P'), 4) AS "P" FROM samples GROUP BY 1""")
def report_projects_side_by_side(t):
    scores = roles.samples(t).groupBy("project", "sample_type").agg(F.round(F.avg("price"), 4).alias("score"))
    return reports.projects_side_by_side(scores, "project", "sample_type", "score", ["F", "O", "P"])


@query("report_difference_rows", PAIR_SQL + " SELECT n_nationkey AS project, round(delta, 5) AS delta, round(share_above, 5) AS share_above FROM nation LEFT JOIN d ON project = n_nationkey")
def report_difference_rows(t):
    from tidyfold.operators import bootstrap

    found = bootstrap.paired_differences(score_table(t), "fine", "rough", ["project"], ["n"], ["mean_price"])
    done = reports.difference_of(found, t.nation.select(F.col("n_nationkey").alias("project")), "project")
    return done.select("project", F.round("delta", 5).alias("delta"), F.round("share_above", 5).alias("share_above"))


# ---- leakage checks


EMB_SPLIT_SQL = "CASE WHEN label < 6 THEN 'train' WHEN label < 8 THEN 'val' ELSE 'test' END"


def vectors(t):
    split = F.when(F.col("label") < 6, "train").when(F.col("label") < 8, "val").otherwise("test")
    return t.embeddings.select(F.col("vec_id").alias("sample"), F.col("embedding").cast("array<double>").alias("values"), split.alias("split"))


@query("check_scramble", f"""WITH e AS (SELECT vec_id AS sample, {EMB_SPLIT_SQL} AS split, generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings)
    SELECT sample, CASE WHEN split = 'train' THEN dim ELSE 63 - dim END AS dim, round(CASE WHEN split = 'train' THEN x ELSE x * 3 + 1 END, 6) AS x FROM e""")
def check_scramble(t):
    rows = checks.scramble_held_out(vectors(t)).select("sample", F.posexplode("values").alias("dim", "x"))
    return rows.select("sample", "dim", F.round("x", 6).alias("x"))


@query("check_embedding_ignores_held_out", "SELECT label < 6 AS train, label >= 6 AS moved FROM embeddings GROUP BY 1, 2")
def check_embedding_ignores_held_out(t):
    from tidyfold.operators.linear import pca_embeddings

    def embed(rows):
        return pca_embeddings(rows.withColumn("fit", F.col("split") == "train"), "values", "fit", 4).select("sample", "embedding")

    rows = vectors(t)
    shift = checks.embedding_shift(embed(rows), embed(checks.scramble_held_out(rows)), rows, "sample")
    return shift.select("train", (F.col("shift") > 1e-6).alias("moved"))


