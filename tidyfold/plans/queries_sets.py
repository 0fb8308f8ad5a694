"""Feature sets over the given tables: a supplier's parts, a nation's suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidyfold.operators import sets
from tidyfold.plans import roles
from tidyfold.plans.registry import query
from tidyfold.plans.roles import SQL_BUCKETS, SQL_SETS, SQL_VALUES

# Members by symbol: a part's name, which several parts share.
EDGE_SQL = """WITH named AS (SELECT DISTINCT l_suppkey AS set, p_name AS member FROM lineitem JOIN part ON l_partkey = p_partkey),
    edges AS (SELECT set, member, row_number() OVER (PARTITION BY set ORDER BY member) - 1 AS position FROM named),
    genes AS (SELECT p_partkey AS gene_index, p_name AS gene_name FROM part WHERE p_type <> 'ECONOMY' AND p_size < 40)"""


def edges(t):
    """(set, position, member); the member list of a set is a vocabulary of bounded length."""
    named = t.lineitem.select("l_suppkey", "l_partkey").distinct().join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    listed = named.groupBy(F.col("l_suppkey").alias("name")).agg(F.sort_array(F.collect_set("p_name")).alias("members"))
    return sets.explode_members(listed)


def genes(t):
    kept = t.part.filter("p_type <> 'ECONOMY' AND p_size < 40")
    return kept.select(F.col("p_partkey").alias("gene_index"), F.col("p_name").alias("gene_name"))


def set_order(t):
    return t.supplier.select(F.col("s_suppkey").alias("set"), F.col("s_suppkey").alias("set_index"))


@query("sets_bind_members", EDGE_SQL + " SELECT DISTINCT set, member, gene_index AS feature FROM edges JOIN genes ON member = gene_name")
def sets_bind_members(t):
    return sets.bind_members(edges(t), genes(t))


@query("sets_unmapped_members", EDGE_SQL + " SELECT DISTINCT member FROM edges WHERE member NOT IN (SELECT gene_name FROM genes WHERE gene_index IN (SELECT p_partkey FROM part WHERE p_type = 'SMALL' AND p_size < 5))")
def sets_unmapped_members(t):
    small = t.part.filter("p_type = 'SMALL' AND p_size < 5").select(F.col("p_partkey").alias("gene_index"), F.col("p_name").alias("gene_name"))
    return sets.unmapped_members(edges(t), small)


@query("sets_member_positions", EDGE_SQL + """ SELECT set, position::INT AS position, member, pos IS NOT NULL AS present, coalesce(pos, -1)::BIGINT AS feature
    FROM edges LEFT JOIN (SELECT gene_name, min(gene_index) AS pos FROM genes GROUP BY 1) ON member = gene_name""")
def sets_member_positions(t):
    return sets.member_positions(edges(t), genes(t)).select("set", "position", "member", "present", "feature")


@query("sets_missing_members", EDGE_SQL + " SELECT DISTINCT member FROM edges WHERE member NOT IN (SELECT gene_name FROM genes WHERE gene_name LIKE '% ring')")
def sets_missing_members(t):
    return sets.unmapped_members(edges(t), genes(t).filter("gene_name LIKE '% ring'"))


@query("sets_members_in_order", EDGE_SQL + """ SELECT member, min(set) AS set_index, min(position) FILTER (set = first)::INT AS position
    FROM (SELECT *, min(set) OVER (PARTITION BY member) AS first FROM edges) GROUP BY member""")
def sets_members_in_order(t):
    return sets.members_in_order(edges(t), set_order(t))


@query("sets_member_set", EDGE_SQL + " SELECT member, position::INT AS position, set AS set_index FROM edges")
def sets_member_set(t):
    return sets.member_set(edges(t), set_order(t))


WEIGHT_SQL = "WITH " + SQL_SETS.strip() + """, present AS (SELECT set, feature, p_size < 45 AS present, p_retailprice / 100 AS logit FROM sets JOIN part ON p_partkey = feature),
    w AS (SELECT set, feature, present, CASE WHEN present THEN exp(logit) / sum(CASE WHEN present THEN exp(logit) END) OVER (PARTITION BY set) ELSE 0 END AS weight FROM present)"""


def members(t):
    part = t.part.select(F.col("p_partkey").alias("feature"), (F.col("p_size") < 45).alias("present"), (F.col("p_retailprice") / 100).alias("logit"))
    return roles.supplier_sets(t).join(part, "feature")


@query("sets_weights", WEIGHT_SQL + " SELECT set, feature, round(weight, 6) AS weight FROM w")
def sets_weights(t):
    return sets.set_weights(members(t), F.col("logit")).select("set", "feature", F.round("weight", 6).alias("weight"))


@query("sets_concept_weights", """SELECT s_nationkey AS concept, s_suppkey AS set,
    round(exp(s_acctbal / 1000) / sum(exp(s_acctbal / 1000)) OVER (PARTITION BY s_nationkey), 6) AS weight FROM supplier""")
def sets_concept_weights(t):
    table = t.supplier.select(F.col("s_nationkey").alias("concept"), F.col("s_suppkey").alias("set"), (F.col("s_acctbal") / 1000).alias("logit"))
    return sets.concept_weights(table, F.col("logit")).select("concept", "set", F.round("weight", 6).alias("weight"))


@query("sets_masked_softmax", """SELECT p_brand, p_partkey, round(CASE WHEN p_size > 10 THEN exp(p_size / 10.0::DOUBLE) /
    sum(CASE WHEN p_size > 10 THEN exp(p_size / 10.0::DOUBLE) END) OVER (PARTITION BY p_brand) ELSE 0 END, 6) AS weight FROM part""")
def sets_masked_softmax(t):
    done = sets.softmax_within(t.part, "p_brand", F.col("p_size") / 10, F.col("p_size") > 10)
    return done.select("p_brand", "p_partkey", F.round("weight", 6).alias("weight"))


VALUE_SQL = WEIGHT_SQL + """, vals AS (SELECT o_custkey AS sample, l_partkey AS feature, sum(l_quantity) AS value
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
    stored AS (SELECT sample, set, sum(weight * value) AS s FROM vals JOIN w USING (feature) WHERE present GROUP BY 1, 2),
    grid AS (SELECT c_custkey AS sample, set FROM customer CROSS JOIN (SELECT DISTINCT set FROM w)),
    scored AS (SELECT sample, set, coalesce(s, 0) + coalesce(s_acctbal / 1000, 0) AS score FROM grid LEFT JOIN stored USING (sample, set) LEFT JOIN supplier ON s_suppkey = set)"""


def biases(t):
    return t.supplier.select(F.col("s_suppkey").alias("set"), (F.col("s_acctbal") / 1000).alias("bias"))


def customers(t):
    return t.customer.select(F.col("c_custkey").alias("sample"))


@query("sets_scores", VALUE_SQL + " SELECT sample, set, round(score, 6) AS score FROM scored")
def sets_scores(t):
    done = sets.score_sets(roles.values(t), sets.set_weights(members(t), F.col("logit")), "sample", biases(t), samples=customers(t))
    return done.select("sample", "set", F.round("score", 6).alias("score"))


@query("sets_concept_scores", VALUE_SQL + """, cw AS (SELECT s_nationkey AS concept, s_suppkey AS set, 1.0::DOUBLE / count(*) OVER (PARTITION BY s_nationkey) AS weight FROM supplier)
    SELECT sample, concept, round(sum(coalesce(score, coalesce(s_acctbal / 1000, 0)) * weight), 6) AS score
    FROM (SELECT c_custkey AS sample FROM customer) CROSS JOIN cw LEFT JOIN scored USING (sample, set) LEFT JOIN supplier ON s_suppkey = set GROUP BY 1, 2""")
def sets_concept_scores(t):
    table = t.supplier.select(F.col("s_nationkey").alias("concept"), F.col("s_suppkey").alias("set"))
    weighted = sets.set_weights(members(t), F.col("logit"))
    done = sets.score_concepts(roles.values(t), weighted, sets.concept_weights(table), "sample", biases(t), samples=customers(t))
    return done.select("sample", "concept", F.round("score", 6).alias("score"))


@query("sets_relative_means", VALUE_SQL + """, own AS (SELECT sample, sum(ln(1 + value)) / (SELECT count(*) FROM part) AS own FROM vals GROUP BY 1),
    inside AS (SELECT sample, set, sum(ln(1 + value)) AS s FROM vals JOIN sets USING (feature) GROUP BY 1, 2), n AS (SELECT set, count(*) AS n FROM sets GROUP BY 1)
    SELECT c_custkey AS sample, n.set AS set, round(coalesce(s, 0) / n - coalesce(own, 0), 6) AS score FROM customer CROSS JOIN n LEFT JOIN inside ON sample = c_custkey AND inside.set = n.set LEFT JOIN own ON own.sample = c_custkey""")
def sets_relative_means(t):
    logged = roles.values(t).withColumn("value", F.log1p("value"))
    done = sets.relative_set_means(logged, roles.supplier_sets(t), "sample", t.part.count(), samples=customers(t))
    return done.select("sample", "set", F.round("score", 6).alias("score"))


@query("sets_hold_out", "WITH " + SQL_SETS.strip() + """, d AS (SELECT set, feature, count(*) OVER (PARTITION BY set) AS n,
    row_number() OVER (PARTITION BY set ORDER BY substr(md5('5:' || set || ':' || feature), 1, 15), feature) - 1 AS r FROM sets)
    SELECT set, feature, r < floor(0.2::DOUBLE * n) AS held FROM d WHERE n >= 5""")
def sets_hold_out(t):
    return sets.hold_out(roles.supplier_sets(t), 0.2, 5, 5).select("set", "feature", "held")


@query("sets_missing_in_model", "WITH " + SQL_BUCKETS.strip() + "," + SQL_VALUES + """ SELECT DISTINCT feature FROM sets_all
    WHERE feature NOT IN (SELECT feature FROM sv WHERE split = 'test')""".replace("sets_all", "(SELECT l_partkey AS feature FROM lineitem)"))
def sets_missing_in_model(t):
    seen = roles.split_values(t).filter("split = 'test'").select("feature")
    return t.lineitem.select(F.col("l_partkey").alias("feature")).distinct().join(seen, "feature", "left_anti")
