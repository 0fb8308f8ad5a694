"""Parsing and flattening steps of the sources, over rows derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidyfold.operators import sets, splits
from tidyfold.plans import roles
from tidyfold.plans.registry import query
from tidyfold.sources import genesets, scores, tables


@query("source_samples", "SELECT c_custkey::INT AS sample_index, c_name AS aliquot_id, c_mktsegment AS project_id FROM customer")
def source_samples(t):
    return t.customer.select(F.col("c_custkey").cast("int").alias("sample_index"), F.col("c_name").alias("aliquot_id"), F.col("c_mktsegment").alias("project_id"))


@query("source_matrix_guard", "SELECT count(*) AS rows, count(DISTINCT vec_id) AS distinct, min(vec_id) AS first, max(vec_id) AS last, min(len(embedding))::INT AS shortest, max(len(embedding))::INT AS longest FROM embeddings")
def source_matrix_guard(t):
    return tables.matrix_faults(t.embeddings, "vec_id", "embedding")


@query("source_tidy", "SELECT * FROM (SELECT vec_id AS sample_index, (generate_subscripts(embedding, 1) - 1)::INT AS feature, round(unnest(embedding)::DOUBLE, 6) AS value FROM embeddings) WHERE value <> 0")
def source_tidy(t):
    rows = tables.to_tidy(t.embeddings, "vec_id", "embedding")
    return rows.select(F.col("vec_id").alias("sample_index"), "feature", F.round(F.col("value").cast("double"), 6).alias("value"))


@query("source_patient_columns", "SELECT user_id, event_type FROM events UNION ALL SELECT c_custkey, NULL FROM customer")
def source_patient_columns(t):
    left = t.events.select("user_id", "event_type")
    return left.unionByName(t.customer.select(F.col("c_custkey").alias("user_id")), allowMissingColumns=True)


@query("source_survival_flatten", "WITH " + roles.SQL_SURVIVAL.strip() + """ SELECT user_id::VARCHAR AS case_submitter_id, project AS project_id, event::BIGINT AS pfi_event, time::DOUBLE AS pfi_time,
    CASE WHEN project <> 'view' THEN event END::BIGINT AS dfi_event FROM surv""")
def source_survival_flatten(t):
    rows = roles.survival_cases(t)
    none_l, none_d = F.lit(None).cast("bigint"), F.lit(None).cast("double")
    event, time = F.col("event").cast("bigint"), F.col("time").cast("double")
    defined = F.col("project") != "view"
    nested = F.struct(
        none_l.alias("os_event"), none_d.alias("os_time"), none_l.alias("dss_event"), none_d.alias("dss_time"), event.alias("pfi_event"), time.alias("pfi_time"),
        F.when(defined, event).alias("dfi_event"), F.when(defined, time).alias("dfi_time"),
    )
    patients = rows.select(F.col("user_id").cast("string").alias("case_submitter_id"), F.col("project").alias("project_id"), nested.alias("survival_derived"))
    return tables.flatten_survival(patients).select("case_submitter_id", "project_id", "pfi_event", "pfi_time", "dfi_event")


# One record per order: mean value of each return flag, as parallel lists.
def records(t):
    flags = F.array(*[F.lit(f) for f in ("A", "N", "R")])
    means = F.array(*[F.round(F.avg(F.when(F.col("l_returnflag") == f, F.col("l_quantity"))), 6) for f in ("A", "N", "R")])
    rows = t.lineitem.groupBy("l_orderkey").agg(means.alias("score_raw"))
    record = F.struct(F.col("l_orderkey").cast("string").alias("aliquot_id"), flags.alias("pathway"), "score_raw")
    return rows.select(F.array(record).alias("scores"))


SSGSEA_SQL = "SELECT l_orderkey::VARCHAR AS aliquot_id, f AS pathway, round(avg(CASE WHEN l_returnflag = f THEN l_quantity END), 6) AS score FROM lineitem, (SELECT unnest(['A', 'N', 'R']) AS f) GROUP BY 1, 2"


@query("source_ssgsea_flatten", SSGSEA_SQL)
def source_ssgsea_flatten(t):
    return tables.flatten_ssgsea(records(t), "scores")


@query("source_ssgsea_wide", """SELECT l_orderkey::VARCHAR AS aliquot_id, """ + ", ".join(
    f"""round(avg(CASE WHEN l_returnflag = '{f}' THEN l_quantity END), 6) AS "{f}" """ for f in ("A", "N", "R")) + " FROM lineitem GROUP BY 1")
def source_ssgsea_wide(t):
    return tables.widen_pathways(tables.flatten_ssgsea(records(t), "scores"), ["A", "N", "R"])


@query("source_gmt_parse", """SELECT p_brand AS name, p_type AS description, p_name AS member FROM part GROUP BY 1, 2, 3""")
def source_gmt_parse(t):
    """A line per brand and type; part names are a small vocabulary, here listed twice over."""
    names = F.concat_ws("\t", F.collect_set("p_name"))
    line = F.concat_ws("\t", "p_brand", "p_type", names, names)
    lines = t.part.groupBy("p_brand", "p_type").agg(line.alias("value"))
    return genesets.parse_gmt(lines).select("name", "description", F.explode("members").alias("member"))


@query("source_gmt_repeated", "SELECT p_brand AS name, count(DISTINCT p_type) AS n FROM part GROUP BY 1 HAVING count(DISTINCT p_type) > 1")
def source_gmt_repeated(t):
    return genesets.repeated_names(t.part.select(F.col("p_brand").alias("name"), "p_type").distinct())


@query("source_gene_ids", """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
    u AS (SELECT doc_id, unnest(range(len(lines)))::INT AS position, unnest(lines) AS line FROM l)
    SELECT doc_id, position, length(trim(regexp_replace(line, '#.*', ''), ' ')) AS size FROM u WHERE trim(regexp_replace(line, '#.*', ''), ' ') <> ''""")
def source_gene_ids(t):
    """Whole documents as ID lists: comments and blank lines dropped, order kept."""
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("position", "line"))
    kept = lines.withColumn("gene_id", F.trim(F.regexp_replace("line", "#.*", ""))).filter(F.col("gene_id") != "")
    return kept.select("doc_id", "position", F.length("gene_id").cast("bigint").alias("size"))


@query("source_hierarchy", """SELECT s_name AS set, s_suppkey::INT AS set_index, n_name AS concept, (dense_rank() OVER (ORDER BY n_nationkey) - 1)::INT AS concept_index FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def source_hierarchy(t):
    named = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    genes = named.groupBy(F.col("l_suppkey").alias("set")).agg(F.concat_ws(":", F.sort_array(F.collect_set("p_name"))).alias("Genes"))
    table = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(genes, F.col("s_suppkey") == F.col("set"))
    table = table.select(
        F.col("s_name").alias("GeneSet"), F.col("n_name").alias("BroadCelltypePathway"), F.col("s_suppkey").alias("GeneSet_index"),
        F.col("n_nationkey").alias("Concept_index"), "Genes",
    )
    _, ordered = genesets.parse_hierarchy(table)
    return ordered


@query("source_score_records", "SELECT o_orderpriority AS task, count(*) AS n, round(avg(o_totalprice), 4) AS score FROM orders GROUP BY 1")
def source_score_records(t):
    table = t.orders.groupBy(F.col("o_orderpriority").alias("task")).agg(
        F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("score"), F.array(F.avg("o_totalprice")).alias("score_boot")
    )
    return scores.records(table)


@query("source_score_row", "SELECT 'orders' AS embeddings, 'cv' AS split, o_orderpriority AS task, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY ALL")
def source_score_row(t):
    table = t.orders.groupBy(F.col("o_orderpriority").alias("task")).agg(F.count("*").alias("n"))
    table = table.select(F.lit("orders").alias("embeddings"), F.lit("cv").alias("split"), "task", "n")
    return scores.score_row(table, "orders", "cv", "1-URGENT")


# ---- the joins of the evaluations, with their guards


@query("join_embeddings_to_samples", "SELECT vec_id, label, c_nationkey AS project FROM embeddings JOIN customer ON vec_id = c_custkey")
def join_embeddings_to_samples(t):
    cases = t.customer.select(F.col("c_custkey").alias("vec_id"), F.col("c_nationkey").alias("project"))
    return t.embeddings.select("vec_id", "label").join(cases, "vec_id")


@query("join_missing_targets", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def join_missing_targets(t):
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left_anti")


@query("join_scores_left", "SELECT doc_id, source, quality FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL")
def join_scores_left(t):
    met = t.documents.select("doc_id", "source").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return met.filter(F.col("quality").isNotNull())


@query("join_covariates", "SELECT o_orderkey AS sample, c_acctbal AS strand_balance FROM orders JOIN customer ON o_custkey = c_custkey")
def join_covariates(t):
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("sample"), F.col("c_acctbal").alias("strand_balance"))


@query("join_endpoints", "WITH " + roles.SQL_SURVIVAL.strip() + " SELECT c_custkey AS case_id, event, time FROM customer JOIN surv ON c_custkey = user_id WHERE time >= 0 AND time IS NOT NULL")
def join_endpoints(t):
    cases = t.customer.select(F.col("c_custkey").alias("case_id"))
    rows = roles.survival_cases(t).withColumnRenamed("user_id", "case_id").select("case_id", "event", "time")
    return cases.join(rows, "case_id").filter("time >= 0")


@query("join_sets_in_order", """WITH n AS (SELECT DISTINCT l_suppkey AS set, p_name AS member FROM lineitem JOIN part ON l_partkey = p_partkey),
    g AS (SELECT DISTINCT p_name FROM part WHERE p_name LIKE '% ring') SELECT DISTINCT member FROM n WHERE member NOT IN (SELECT p_name FROM g)""")
def join_sets_in_order(t):
    from tidyfold.plans.queries_sets import edges, genes, set_order

    return sets.missing_members(edges(t), genes(t).filter("gene_name LIKE '% ring'"), set_order(t)).select("member")


@query("join_split_guard", "SELECT o_custkey AS case_id, count(DISTINCT o_orderstatus) AS groups FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1")
def join_split_guard(t):
    return splits.straddling(t.orders.select(F.col("o_custkey").alias("case_id"), "o_orderstatus"), "case_id", "o_orderstatus")
