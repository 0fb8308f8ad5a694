"""The factorisation and its annotations over the given tables: features are kinds of part, sets are suppliers' kinds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tidyfold.operators import blocks, factorize, linear, splits
from tidyfold.plans import roles
from tidyfold.plans.registry import query
from tidyfold.plans.roles import SQL_SETS


def kinds(t):
    """(sample = customer, feature = brand and type, value)."""
    part = t.part.select(F.col("p_partkey").alias("feature"), F.concat_ws("/", "p_brand", "p_type").alias("kind"))
    return roles.values(t).join(part, "feature").groupBy("sample", F.col("kind").alias("feature")).agg(F.sum("value").alias("value"))


def kind_sets(t):
    """(set = brand or size band, feature = brand and type) memberships."""
    rows = t.part.select(F.concat_ws("/", "p_brand", "p_type").alias("feature"), "p_brand", "p_type").distinct()
    return rows.select(F.col("p_type").alias("set"), "feature").unionByName(rows.select(F.col("p_brand").alias("set"), "feature"))


def cohort(t):
    return splits.with_split(roles.bucketed(t), 0).select(F.col("case_id").alias("sample"), "split")


def fitted(t, **settings):
    return factorize.fit_fold(kinds(t), cohort(t), "sample", kind_sets(t), k=8, max_iter=15, **settings)


@query("factor_fit_objective")
def factor_fit_objective(t):
    model, *_ = fitted(t)
    rows = [(i, float(o), float(c)) for i, (o, c) in enumerate(zip(model.objectives, model.changes, strict=True))]
    return t.spark.createDataFrame(rows, "iteration int, objective double, change double")


@query("factor_annotations")
def factor_annotations(t):
    *_, notes = fitted(t)
    return notes


@query("factor_embeddings")
def factor_embeddings(t):
    model, scaler, *_ = fitted(t)
    return factorize.embed(model, scaler, kinds(t), cohort(t), "sample")


KIND_SQL = """kinds AS (SELECT o_custkey AS sample, p_brand || '/' || p_type AS feature, sum(l_quantity) AS value
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""


@query("factor_dense_rows", "WITH " + KIND_SQL + """, f AS (SELECT feature, row_number() OVER (ORDER BY feature) - 1 AS i FROM (SELECT DISTINCT feature FROM kinds)),
    g AS (SELECT c_custkey AS sample, i, feature FROM customer, f)
    SELECT g.sample, i AS position, coalesce(value, 0) AS y FROM g LEFT JOIN kinds k ON k.sample = g.sample AND k.feature = g.feature""")
def factor_dense_rows(t):
    names = [r[0] for r in kinds(t).select("feature").distinct().orderBy("feature").collect()]
    features = t.spark.createDataFrame(list(enumerate(names)), "index int, feature string")
    rows = factorize.to_arrays(kinds(t), features, t.customer.select(F.col("c_custkey").alias("sample")), "sample")
    return rows.select("sample", F.posexplode("y").alias("position", "y"))


@query("factor_singular_values", "SELECT 1 AS one, round(sum(v), 4) AS squares FROM (SELECT unnest(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) AS v FROM embeddings)")
def factor_singular_values(t):
    """The squared singular values add up to the squared entries."""
    values = linear.singular_values(blocks.pack(t.embeddings, ["embedding"]), "embedding")
    return t.spark.createDataFrame([(1, round(float((values**2).sum()), 4))], "one int, squares double")


@query("factor_top_svd")
def factor_top_svd(t):
    u, d = factorize.top_svd(t.embeddings, "embedding", 6)
    return t.spark.createDataFrame([(i, float(d[i]), u[:, i].tolist()) for i in range(6)], "i int, value double, vector array<double>")


@query("factor_steps")
def factor_steps(t):
    """One Z step and one B step from the leading singular vectors."""
    n, apply = factorize.gram_map(t.embeddings, "embedding")
    u, d = factorize.top_svd(t.embeddings, "embedding", 6)
    m = u.T / np.sqrt(d)[:, None]
    z = factorize.z_step(apply(m), m @ apply(m), d[-1] / 2, None)
    b = factorize.b_map(z, d[-1])
    return t.spark.createDataFrame([(i, z[i].tolist(), b[:, i].tolist()) for i in range(n)], "i int, z array<double>, b array<double>")


# ---- tidy pieces with SQL twins: Z from the part table, sets are suppliers

Z_SQL = """z AS (SELECT p_partkey AS feature, 0 AS lv, p_size / 10.0::DOUBLE AS z FROM part UNION ALL SELECT p_partkey, 1, floor(p_retailprice / 10) FROM part)"""


def z_table(t):
    size = t.part.select(F.col("p_partkey").alias("feature"), F.lit(0).alias("lv"), (F.col("p_size") / 10).alias("z"))
    price = t.part.select(F.col("p_partkey").alias("feature"), F.lit(1).alias("lv"), F.floor(F.col("p_retailprice") / 10).cast("double").alias("z"))
    return size.unionByName(price)


@query("factor_lambda_max", "WITH " + SQL_SETS.strip() + ", " + Z_SQL + ", s AS (SELECT set, lv, sum(z) AS s FROM sets JOIN z USING (feature) GROUP BY 1, 2) SELECT lv, round(2 * greatest(max(s), 0), 6) AS lambda_max FROM s GROUP BY 1")
def factor_lambda_max(t):
    return factorize.lambda_max_table(roles.supplier_sets(t), z_table(t)).withColumn("lambda_max", F.round("lambda_max", 6))


AUC_SQL = "WITH " + SQL_SETS.strip() + ", " + Z_SQL + """, e AS (SELECT set, feature, p_type = 'SMALL' AS held FROM sets JOIN part ON p_partkey = feature),
    sz AS (SELECT set, lv, e.held, z FROM e JOIN z USING (feature)),
    allz AS (SELECT lv, z, count(*) AS n FROM z GROUP BY 1, 2), inz AS (SELECT set, lv, z, count(*) AS n FROM sz GROUP BY 1, 2, 3),
    hz AS (SELECT set, lv, z, count(*) AS h FROM sz WHERE held GROUP BY 1, 2, 3), ss AS (SELECT DISTINCT set FROM sets),
    outz AS (SELECT ss.set, a.lv, a.z, a.n - coalesce(i.n, 0) AS o FROM ss CROSS JOIN allz a LEFT JOIN inz i ON i.set = ss.set AND i.lv = a.lv AND i.z = a.z),
    u AS (SELECT h.set, h.lv, sum(h.h * CASE WHEN o.z < h.z THEN o.o WHEN o.z = h.z THEN 0.5 * o.o ELSE 0 END) AS u FROM hz h JOIN outz o ON o.set = h.set AND o.lv = h.lv GROUP BY 1, 2),
    n1 AS (SELECT set, lv, sum(h) AS n1 FROM hz GROUP BY 1, 2), n0 AS (SELECT set, lv, sum(o) AS n0 FROM outz GROUP BY 1, 2),
    tie AS (SELECT o.set, o.lv, sum((o.o + coalesce(h.h, 0))::DOUBLE ^ 3 - (o.o + coalesce(h.h, 0))) AS t FROM outz o LEFT JOIN hz h ON h.set = o.set AND h.lv = o.lv AND h.z = o.z GROUP BY 1, 2)
    SELECT set, lv, round(u / (n1 * n0), 6) AS auc, round((u - n1 * n0 / 2.0 - 0.5) / sqrt(n1 * n0 / 12.0 * ((n1 + n0 + 1) - t / ((n1 + n0) * (n1 + n0 - 1)))), 6) AS score
    FROM u JOIN n1 USING (set, lv) JOIN n0 USING (set, lv) JOIN tie USING (set, lv)"""


def auc(t):
    small = t.part.select(F.col("p_partkey").alias("feature"), (F.col("p_type") == "SMALL").alias("held"))
    edges = roles.supplier_sets(t).join(small, "feature")
    pairs = edges.select("set").distinct().withColumn("lv", F.explode(F.array(F.lit(0), F.lit(1))))
    return factorize.held_out_auc(z_table(t), edges, pairs, t.part.count())


@query("factor_held_out_auc", AUC_SQL)
def factor_held_out_auc(t):
    return auc(t).select("set", "lv", F.round("auc", 6).alias("auc"), F.round("score", 6).alias("score"))


@query("factor_false_discovery", """WITH s AS (SELECT l_suppkey AS set, round(avg(l_discount) * 10, 4) AS p FROM lineitem GROUP BY 1),
    k AS (SELECT *, row_number() OVER (ORDER BY p, set) AS r, count(*) OVER () AS m FROM s)
    SELECT set, p, round(least(min(p * m / r) OVER (ORDER BY p, set ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1), 6) AS fdr FROM k""")
def factor_false_discovery(t):
    tests = t.lineitem.groupBy(F.col("l_suppkey").alias("set")).agg(F.round(F.avg("l_discount") * 10, 4).alias("p"))
    return factorize.benjamini_hochberg(tests, "p").select("set", "p", F.round("fdr", 6).alias("fdr"))


@query("factor_confident", AUC_SQL.replace(" SELECT set, lv, round(u", ", a AS (SELECT set, lv, round(u").rstrip() + ") SELECT set, lv FROM a WHERE auc > 0.5 AND 1 - auc < 0.48")
def factor_confident(t):
    found = auc(t).withColumn("auc", F.round("auc", 6)).withColumn("fdr", 1 - F.col("auc"))
    return factorize.annotated(found, 0.5, 0.48).select("set", "lv")
