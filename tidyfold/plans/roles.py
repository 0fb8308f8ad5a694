"""The given tables in a cohort's roles, on the Spark side and as SQL.

order = sample, customer = case, nation = project, status = sample type;
customer x part quantities = a sparse sample x feature matrix; supplier = a
feature set; user = a survival case.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyfold.operators import splits

SALT = splits.DEFAULT_SALT


def samples(t) -> DataFrame:
    """Orders as samples with their customer and nation."""
    cases = t.customer.select(F.col("c_custkey").alias("case_id"), F.col("c_nationkey").alias("project"))
    orders = t.orders.select(
        F.col("o_orderkey").alias("sample"), F.col("o_custkey").alias("case_id"), F.col("o_orderstatus").alias("sample_type"),
        F.col("o_totalprice").alias("price"),
    )
    return orders.join(cases, "case_id")


def cohort(t) -> DataFrame:
    """Customers as cases."""
    return t.customer.select(F.col("c_custkey").alias("case_id"), F.col("c_nationkey").alias("project"), "c_mktsegment", "c_acctbal")


def buckets(t) -> DataFrame:
    return t.once("buckets", lambda: splits.case_buckets(cohort(t), "case_id", "project", SALT, "md5"))


def bucketed(t) -> DataFrame:
    """Customers with bucket and test fold."""
    placed = buckets(t).select("case_id", "bucket")
    return cohort(t).join(placed, "case_id").withColumn("test_fold", splits.fold_of(F.col("bucket")))


def bucketed_samples(t) -> DataFrame:
    """Orders with bucket and test fold; folds are drawn over every customer."""
    return samples(t).join(buckets(t).select("case_id", "bucket"), "case_id").withColumn(
        "test_fold", splits.fold_of(F.col("bucket"))
    )


def values(t) -> DataFrame:
    """(sample = customer, feature = part, value = quantity), zeros left out."""
    lines = t.lineitem.select("l_orderkey", F.col("l_partkey").alias("feature"), "l_quantity")
    owners = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("sample"))
    return lines.join(owners, "l_orderkey").groupBy("sample", "feature").agg(F.sum("l_quantity").alias("value"))


def split_values(t, fold: int = 0) -> DataFrame:
    """Values with the customer's split and project."""
    split = splits.with_split(bucketed(t), fold).select(F.col("case_id").alias("sample"), "project", "split")
    return values(t).join(split, "sample")


def train_count(t, fold: int = 0):
    """The number of training customers, those without any value included."""
    return splits.with_split(bucketed(t), fold).filter("split = 'train'").agg(F.count("*")).scalar()


def coarse_values(t) -> DataFrame:
    """(sample = customer, feature = brand and size, value = quantity)."""
    part = t.part.select(F.col("p_partkey").alias("feature"), F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("kind"))
    return values(t).join(part, "feature").groupBy("sample", F.col("kind").alias("feature")).agg(F.sum("value").alias("value"))


def supplier_sets(t) -> DataFrame:
    """(set = supplier, feature = part) a supplier ships."""
    return t.lineitem.select(F.col("l_suppkey").alias("set"), F.col("l_partkey").alias("feature")).distinct()


def words(t) -> DataFrame:
    """(sample = document, feature = word, value = count) of whole texts."""
    tokens = t.documents.select(F.col("doc_id").alias("sample"), F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("feature"))
    return tokens.filter(F.col("feature") != "").groupBy("sample", "feature").agg(F.count("*").cast("double").alias("value"))


def survival_cases(t) -> DataFrame:
    """Users: time in hours to the first purchase, censored at the last event; project = first event type."""
    first = t.events.groupBy("user_id").agg(
        F.min_by("event_type", F.struct("ts", "event_id")).alias("project"),
        F.min("ts").alias("_start"), F.max("ts").alias("_end"),
        F.min(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("_hit"),
        F.round(F.avg("value"), 1).alias("risk"),
    )
    until = F.coalesce("_hit", "_end")
    hours = F.floor((F.unix_timestamp(until) - F.unix_timestamp("_start")) / 3600)
    return first.select(
        "user_id", "project", "risk", F.col("_hit").isNotNull().cast("int").alias("event"), hours.alias("time")
    )


# ---- the same roles as SQL fragments, to follow WITH

SQL_BUCKETS = f"""
cohort AS (SELECT c_custkey AS case_id, c_nationkey AS project, c_mktsegment, c_acctbal,
    ('0x' || substr(md5('{SALT}:' || c_custkey), 1, 15))::BIGINT AS h FROM customer),
ranked AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY h, case_id) - 1 AS rnk,
    count(*) OVER (PARTITION BY project) AS size FROM cohort),
bucketed AS (SELECT case_id, project, c_mktsegment, c_acctbal, rnk, size,
    (20 * ((5 * (2 * rnk + 1)) // (2 * size)) + h % 20)::INTEGER AS bucket FROM ranked),
folded AS (SELECT *, (bucket // 20)::INTEGER AS test_fold FROM bucketed),
split0 AS (SELECT *, CASE WHEN bucket // 20 = 0 THEN 'test' WHEN bucket % 20 >= 18 THEN 'val' ELSE 'train' END AS split FROM folded)"""

SQL_SAMPLES = """
samples AS (SELECT o_orderkey AS sample, o_custkey AS case_id, o_orderstatus AS sample_type, o_totalprice AS price,
    s.project, s.bucket, s.test_fold, s.split FROM orders JOIN split0 s ON o_custkey = s.case_id)"""

SQL_VALUES = """
vals AS (SELECT o_custkey AS sample, l_partkey AS feature, sum(l_quantity) AS value
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
sv AS (SELECT v.*, s.project, s.split FROM vals v JOIN split0 s ON v.sample = s.case_id),
ntrain AS (SELECT count(*) AS n FROM split0 WHERE split = 'train')"""

SQL_STATS = """
parts0 AS (SELECT feature, count(*) AS m, avg(value) AS mp, var_pop(value) AS vp, min(value) AS mn, max(value) AS mx,
    sum(value) AS total, sum(value * value) AS sq, sum((value > 0)::INT)::BIGINT AS n_detected FROM sv WHERE split = 'train' GROUP BY 1),
stats AS (SELECT feature, n, n_detected, total, total / n AS mean, sq / n - (total / n) * (total / n) AS var_pop,
    sqrt(greatest(sq / n - (total / n) * (total / n), 0)) AS sd_pop,
    sqrt(greatest(sq / n - (total / n) * (total / n), 0) * n / (n - 1)) AS sd_samp,
    CASE WHEN m < n THEN least(mn, 0) ELSE mn END AS low, CASE WHEN m < n THEN greatest(mx, 0) ELSE mx END AS high,
    sqrt(sq) AS norm FROM parts0, ntrain)"""

SQL_COARSE = """
coarse AS (SELECT o_custkey AS sample, p_brand || '/' || p_size AS feature, sum(l_quantity) AS value
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""

SQL_SETS = """
sets AS (SELECT DISTINCT l_suppkey AS set, l_partkey AS feature FROM lineitem)"""

SQL_WORDS = """
words AS (SELECT sample, feature, count(*)::DOUBLE AS value FROM (
    SELECT doc_id AS sample, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS feature FROM documents)
    WHERE feature <> '' GROUP BY 1, 2)"""

SQL_SURVIVAL = """
users AS (SELECT user_id, arg_min(event_type, (ts, event_id)) AS project, min(ts) AS t0, max(ts) AS t1,
    min(CASE WHEN event_type = 'purchase' THEN ts END) AS hit, round(avg(value), 1) AS risk FROM events GROUP BY 1),
surv AS (SELECT user_id, project, risk, (hit IS NOT NULL)::INT AS event,
    floor((epoch(coalesce(hit, t1))::BIGINT - epoch(t0)::BIGINT) / 3600)::BIGINT AS time FROM users)"""


def md5_sql(*parts: str) -> str:
    """The DuckDB form of `functions.hashing.md5_hash`."""
    return "('0x' || substr(md5(" + " || ':' || ".join(parts) + "), 1, 15))::BIGINT"


def uniform_sql(*parts: str) -> str:
    return f"({md5_sql(*parts)}::DOUBLE / 1152921504606846976.0)"
