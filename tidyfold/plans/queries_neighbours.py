"""Neighbours, geometry and graphs over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidyfold.operators import graph, linear, metrics, neighbours, stats
from tidyfold.plans import roles
from tidyfold.plans.registry import query
from tidyfold.plans.roles import SQL_COARSE, md5_sql

# An embedding's fold comes from its label group, as a customer's from its nation.
SIDE_SQL = f"""emb AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v, {md5_sql("'side'", 'vec_id')} % 5 = 0 AS test, {md5_sql("'batch'", 'vec_id')} % 7 AS batch FROM embeddings)"""


def sides(t):
    from tidyfold.functions.hashing import md5_hash

    return t.embeddings.select(
        "vec_id", "label", "embedding", (F.pmod(md5_hash("side", F.col("vec_id")), F.lit(5)) == 0).alias("test"),
        F.pmod(md5_hash("batch", F.col("vec_id")), F.lit(7)).alias("batch"),
    )


def nearest(t, k: int, grouped: bool):
    rows = sides(t).withColumn("grp", F.col("label") if grouped else F.lit(0))
    query_ = rows.filter("test").select("grp", F.col("vec_id").alias("qid"), F.col("embedding").alias("vec"))
    reference = rows.filter("NOT test").select("grp", F.col("vec_id").alias("rid"), F.col("embedding").alias("vec"))
    return neighbours.cosine_neighbours(query_, reference, k)


def nearest_sql(k: int, grouped: bool) -> str:
    same = " AND q.label = r.label" if grouped else ""
    return f"""WITH {SIDE_SQL}, sim AS (SELECT q.vec_id AS qid, r.vec_id AS rid, q.label AS ql, r.label AS rl, q.batch AS qb, r.batch AS rb, list_cosine_similarity(q.v, r.v) AS s
        FROM emb q JOIN emb r ON q.test AND NOT r.test{same}),
    near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, rid) AS rank FROM sim) WHERE rank <= {k})"""


@query("neighbours_cosine", nearest_sql(10, False) + " SELECT qid, rid, rank::INT AS rank, round(s, 6) AS similarity FROM near")
def neighbours_cosine(t):
    return nearest(t, 10, False).select("qid", "rid", "rank", F.round("similarity", 6).alias("similarity"))


@query("neighbours_precision", nearest_sql(10, False) + """ SELECT qid, avg((ql = rl)::INT) FILTER (rank <= 1) AS precision_at_1, round(avg((ql = rl)::INT), 6) AS precision_at_10 FROM near GROUP BY 1""")
def neighbours_precision(t):
    labels = t.embeddings.select(F.col("vec_id").alias("id"), "label")
    done = neighbours.neighbour_precision(nearest(t, 10, False), labels)
    return done.select("qid", "precision_at_1", F.round("precision_at_10", 6).alias("precision_at_10"))


@query("neighbours_batch_enrichment", nearest_sql(5, True) + """, seen AS (SELECT qid, ql, qb, avg((qb = rb)::INT) AS seen FROM near GROUP BY 1, 2, 3),
    g AS (SELECT label, count(*) AS n FROM emb WHERE NOT test GROUP BY 1), b AS (SELECT label, batch, count(*) AS nb FROM emb WHERE NOT test GROUP BY 1, 2)
    SELECT qid, round(CASE WHEN n >= 2 THEN seen - nb / n END, 6) AS enrichment FROM seen LEFT JOIN g ON ql = g.label LEFT JOIN b ON ql = b.label AND qb = b.batch""")
def neighbours_batch_enrichment(t):
    rows = sides(t).select(F.col("vec_id").alias("id"), F.col("label").alias("grp"), "batch", "test")
    done = neighbours.batch_enrichment(nearest(t, 5, True), rows, rows.filter("NOT test"))
    return done.select("qid", F.round("enrichment", 6).alias("enrichment"))


@query("neighbours_silhouette", f"""WITH {SIDE_SQL}, d AS (SELECT a.vec_id, a.label, b.label AS other, a.vec_id = b.vec_id AS self, 1 - list_cosine_similarity(a.v, b.v) AS d FROM emb a, emb b),
    m AS (SELECT vec_id, label, other, sum(CASE WHEN self THEN 0 ELSE d END) AS s, count(*) AS n FROM d GROUP BY 1, 2, 3),
    ab AS (SELECT vec_id, max(CASE WHEN label = other THEN s / (n - 1) END) AS a, min(CASE WHEN label <> other THEN s / n END) AS b FROM m GROUP BY 1)
    SELECT vec_id, round((b - a) / greatest(a, b), 6) AS silhouette FROM ab""")
def neighbours_silhouette(t):
    done = neighbours.silhouettes(t.embeddings, "vec_id", "embedding", "label")
    return done.select("vec_id", F.round("silhouette", 6).alias("silhouette"))


@query("neighbours_kmeans_agreement")
def neighbours_kmeans_agreement(t):
    rows = sides(t)
    clusters = neighbours.kmeans_clusters(rows.filter("NOT test"), rows.filter("test"), "embedding", 10, 0)
    return metrics.clustering_agreement(metrics.confusion(clusters, "label", "cluster"))


@query("distribution_mmd", f"""WITH {SIDE_SQL}, bt AS (SELECT v, test, (row_number() OVER (ORDER BY substr(md5('mmd:' || vec_id), 1, 15), vec_id) - 1) // 64 AS part FROM emb),
    p AS (SELECT a.part, a.test AS s, b.test AS o, avg(exp(-(list_distance(a.v, b.v) ^ 2) / 4096)) AS k FROM bt a JOIN bt b ON a.part = b.part GROUP BY 1, 2, 3)
    SELECT part, round(CASE WHEN count(*) = 4 THEN sum(CASE WHEN s = o THEN k ELSE -k END) END, 6) AS mmd FROM p GROUP BY 1""")
def distribution_mmd(t):
    """Drift between the two sides within shuffled batches of 64, so the work grows with the table."""
    from tidyfold.functions.hashing import md5_hex
    from tidyfold.operators.ordering import hash_rank

    hexed = sides(t).withColumn("_hex", md5_hex("mmd", F.col("vec_id"))).withColumn("_all", F.lit(0))
    rows = hash_rank(hexed, ["_all"], "_hex", "vec_id").withColumn("part", F.floor(F.col("rank") / 64))
    return neighbours.mmd(rows, F.col("test"), "embedding", "part", "vec_id").select("part", F.round("mmd", 6).alias("mmd"))


@query("spectrum_scores")
def spectrum_scores(t):
    return linear.spectrum(t.embeddings, "embedding", "label")


@query("spectrum_trace", """WITH e AS (SELECT label, generate_subscripts(embedding, 1) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings)
    SELECT label, round(sum(v), 6) AS total_variance FROM (SELECT label, dim, var_pop(x) AS v FROM e GROUP BY 1, 2) GROUP BY 1""")
def spectrum_trace(t):
    """The covariance trace from the same moments the spectrum uses."""
    import numpy as np

    found = linear.moments(t.embeddings, "embedding", "embedding", "label")
    rows = [(k, float(np.round(np.trace(linear.covariance(m)) / m["n"], 6))) for k, m in found.items()]
    return t.spark.createDataFrame(rows, "label int, total_variance double")


# ---- graph of (brand, size) kinds by customers' quantities

GRAPH_SQL = "WITH " + SQL_COARSE.strip() + """, nn AS (SELECT count(*) AS n FROM customer),
    st AS (SELECT feature, sum(value) / max(n) AS mean, sum(value * value) / max(n) AS sq, max(n) AS n FROM coarse, nn GROUP BY 1),
    xy AS (SELECT a.feature AS i, b.feature AS j, sum(a.value * b.value) AS s FROM coarse a JOIN coarse b ON a.sample = b.sample AND a.feature < b.feature GROUP BY 1, 2),
    r AS (SELECT a.feature AS i, b.feature AS j, abs((coalesce(s, 0) / a.n - a.mean * b.mean) / sqrt((a.sq - a.mean ^ 2) * (b.sq - b.mean ^ 2))) AS r
        FROM st a JOIN st b ON a.feature < b.feature LEFT JOIN xy ON xy.i = a.feature AND xy.j = b.feature),
    both_ways AS (SELECT i, j, r FROM r UNION ALL SELECT j, i, r FROM r),
    best AS (SELECT i, j, r FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY r DESC, j) AS k FROM both_ways WHERE r >= 0.05) WHERE k <= 4),
    edges AS (SELECT source, target, max(weight) AS weight FROM (SELECT i AS source, j AS target, r AS weight FROM best UNION ALL SELECT j, i, r FROM best
        UNION ALL SELECT feature, feature, 1.0 FROM st) GROUP BY 1, 2)"""


def edges(t):
    values = roles.coarse_values(t)
    fitted = stats.feature_stats(values, t.customer.agg(F.count("*")).scalar())
    return graph.coexpression_graph(values, fitted, "sample", 5, 0.05)


@query("graph_coexpression", GRAPH_SQL + " SELECT source, target, round(weight, 6) AS weight FROM edges")
def graph_coexpression(t):
    return edges(t).select("source", "target", F.round("weight", 6).alias("weight"))


@query("graph_normalized", GRAPH_SQL + """, deg AS (SELECT source, sum(weight) AS d FROM edges GROUP BY 1)
    SELECT e.source, e.target, round(e.weight / sqrt(a.d * b.d), 6) AS weight FROM edges e JOIN deg a ON e.source = a.source JOIN deg b ON e.target = b.source""")
def graph_normalized(t):
    return graph.gcn_normalize(edges(t)).select("source", "target", F.round("weight", 6).alias("weight"))


# Nations linked by the suppliers and customers they trade between.
TRADE_SQL = """trade AS (SELECT c_nationkey AS source, s_nationkey AS target, l_quantity AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey), coalesced AS (SELECT source, target, sum(weight) AS weight FROM trade GROUP BY 1, 2)"""


def trade(t):
    return (
        t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .select(F.col("c_nationkey").alias("source"), F.col("s_nationkey").alias("target"), F.col("l_quantity").alias("weight"))
    )


@query("graph_coalesced", "WITH " + TRADE_SQL + " SELECT source, target, weight FROM coalesced")
def graph_coalesced(t):
    return graph.coalesce_edges(trade(t))


@query("graph_shuffled", "WITH " + TRADE_SQL + """, a AS (SELECT n_nationkey AS node, row_number() OVER (ORDER BY substr(md5('node:' || n_nationkey), 1, 15), n_nationkey) AS k FROM nation),
    b AS (SELECT n_nationkey AS node, row_number() OVER (ORDER BY substr(md5('9:' || n_nationkey), 1, 15), n_nationkey) AS k FROM nation),
    m AS (SELECT a.node AS f, b.node AS g FROM a JOIN b USING (k))
    SELECT s.g AS source, d.g AS target, weight FROM coalesced JOIN m s ON s.f = source JOIN m d ON d.f = target""")
def graph_shuffled(t):
    nodes = t.nation.select(F.col("n_nationkey").alias("feature"))
    return graph.shuffle_nodes(graph.coalesce_edges(trade(t)), nodes, seed=9)


@query("graph_propagated", "WITH " + TRADE_SQL + """, x AS (SELECT s_nationkey AS node, sum(s_acctbal) AS bal, count(*)::DOUBLE AS n FROM supplier GROUP BY 1)
    SELECT source, round(sum(weight * bal), 2) AS bal, sum(weight * n) AS n FROM coalesced JOIN x ON node = target GROUP BY 1""")
def graph_propagated(t):
    vectors = t.supplier.groupBy(F.col("s_nationkey").alias("feature")).agg(F.array(F.sum("s_acctbal"), F.count("*").cast("double")).alias("vec"))
    done = graph.propagate(graph.coalesce_edges(trade(t)), vectors)
    return done.select("source", F.round(F.col("vec")[0], 2).alias("bal"), F.col("vec")[1].alias("n"))


@query("graph_propagated_values", GRAPH_SQL + " SELECT sample, source, round(sum(weight * value), 5) AS value FROM edges JOIN coarse ON target = feature GROUP BY 1, 2")
def graph_propagated_values(t):
    return graph.propagate_values(edges(t), roles.coarse_values(t), "sample").select("sample", "source", F.round("value", 5).alias("value"))


