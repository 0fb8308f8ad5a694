"""Sources and sinks: tables derived from the given ones are written to the shared folder and read back by the library's loaders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidyfold.plans.registry import query
from tidyfold.sources import embeddings, genesets, schemas, scores, tables

REVISION = "r1"


def sample_axis(t):
    """Customers as aliquots, every column of the axis."""
    made = {
        "sample_index": F.col("c_custkey").cast("int"), "aliquot_id": F.col("c_name"), "case_id": F.col("c_custkey").cast("string"), "project_id": F.col("c_mktsegment"),
        "case_submitter_id": F.concat_ws("-", F.lit("T"), F.col("c_nationkey").cast("string"), F.col("c_custkey").cast("string")),
        "aliquot_submitter_id": F.concat_ws("-", F.lit("T"), F.col("c_nationkey").cast("string"), F.lit("x"), F.lit("y"), F.lit("z"), "c_mktsegment"),
        "strand_balance": (F.col("c_nationkey") / 32).cast("float"), "n_unmapped": F.col("c_nationkey").cast("long"),
    }
    return t.customer.select(*[made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.SAMPLES.fields])


@query("source_sample_axis", "SELECT c_custkey::INT AS sample_index, c_name AS aliquot_id, c_mktsegment AS project_id, c_nationkey::BIGINT AS n_unmapped FROM customer")
def source_sample_axis(t):
    root = t.place("axis")
    sample_axis(t).write.parquet(f"{root}/{REVISION}/samples")
    return tables.load_samples(t.spark, root, REVISION).select("sample_index", "aliquot_id", "project_id", "n_unmapped")


@query("source_gene_axis", "SELECT (p_partkey - 1)::INT AS gene_index, p_partkey::VARCHAR AS gene_id, p_name AS gene_name, p_type AS gene_type, p_brand AS chromosome, p_size::BIGINT AS start FROM part")
def source_gene_axis(t):
    root = t.place("axis")
    made = {"gene_index": F.col("p_partkey") - 1, "gene_id": F.col("p_partkey"), "gene_name": F.col("p_name"), "gene_type": F.col("p_type"), "chromosome": F.col("p_brand"), "start": F.col("p_size")}
    t.part.select(*[made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.GENES.fields]).write.parquet(f"{root}/{REVISION}/genes")
    return tables.load_genes(t.spark, root, REVISION).drop("end")


@query("source_value_table", "SELECT vec_id::INT AS sample_index, generate_subscripts(embedding, 1)::INT - 1 AS feature, floor(unnest(embedding)::DOUBLE * 100)::INT AS value FROM embeddings")
def source_value_table(t):
    """The guarded loader: rows dense from 0, one width."""
    root = t.place("values")
    counts = F.transform("embedding", lambda x: F.floor(x.cast("double") * 100).cast("int"))
    first = t.embeddings.agg(F.min("vec_id")).first()[0] or 0
    t.embeddings.select((F.col("vec_id") - first).cast("int").alias("sample_index"), counts.alias("values")).write.parquet(f"{root}/{REVISION}/unstranded")
    read = tables.load_values(t.spark, root, revision=REVISION)
    return read.select((F.col("sample_index") + first).cast("int").alias("sample_index"), F.posexplode("values").alias("feature", "value"))


def patient_root(t) -> str:
    """Per-project files: events by type with their own columns, customers without them."""
    root = t.place("patients")
    kinds = [r[0] for r in t.events.select("event_type").distinct().orderBy("event_type").collect()]  # a vocabulary
    for kind in kinds:
        t.events.filter(F.col("event_type") == kind).select("user_id", "event_type", F.lit(kind).alias(f"only_{kind}")).write.parquet(f"{root}/{REVISION}/{kind}/data.parquet")
    t.customer.select(F.col("c_custkey").cast("long").alias("user_id")).write.parquet(f"{root}/{REVISION}/customers/data.parquet")
    return root


@query("source_merged_patient_columns", "SELECT user_id::BIGINT AS user_id, event_type FROM events UNION ALL SELECT c_custkey, NULL FROM customer")
def source_merged_patient_columns(t):
    read = tables.read_patient_columns(t.spark, ["user_id", "event_type"], patient_root(t), REVISION)
    return read.withColumn("user_id", F.col("user_id").cast("long"))


@query("source_patient_files", "SELECT event_type AS project, count(*) AS n FROM events GROUP BY 1 UNION ALL SELECT 'customers', count(*) FROM customer")
def source_patient_files(t):
    files = t.spark.read.option("mergeSchema", True).parquet(tables.patient_files(patient_root(t), REVISION))
    return files.groupBy(F.regexp_extract(F.input_file_name(), f"/{REVISION}/([^/]+)/data.parquet", 1).alias("project")).agg(F.count("*").alias("n"))


@query("source_cached_labels", "SELECT doc_id, toxic FROM labels WHERE quality = 1")
def source_cached_labels(t):
    """Built once; the second call finds the finished table and doesn't build."""
    folder, built = t.place("cache"), []

    def build():
        built.append(1)
        return t.labels.filter("quality = 1").select("doc_id", "toxic")

    for _ in range(2):
        found = tables.cached(t.spark, "labels", folder, REVISION, build)
    if len(built) != 1:
        raise RuntimeError(f"built {len(built)} times")
    return found


def named_sets(t, column: str):
    return t.part.groupBy(F.col(column).alias("name")).agg(F.sort_array(F.collect_set("p_name")).alias("members")).select("name", F.concat(F.lit("d "), "name").alias("description"), "members")


@query("source_gmt_written", "SELECT DISTINCT p_brand AS name, 'd ' || p_brand AS description, p_name AS member FROM part")
def source_gmt_written(t):
    path = t.place("gmt")
    genesets.write_gmt(named_sets(t, "p_brand"), path)
    return genesets.read_gmt(t.spark, path).select("name", "description", F.explode("members").alias("member"))


@query("source_gene_set_sources", "SELECT DISTINCT 0 AS source_rank, p_brand AS name, p_name AS member FROM part UNION ALL SELECT DISTINCT 1, p_type, p_name FROM part")
def source_gene_set_sources(t):
    paths = [t.place("gmt") for _ in range(2)]
    for path, column in zip(paths, ("p_brand", "p_type")):
        genesets.write_gmt(named_sets(t, column), path)
    return genesets.load_gene_sets(t.spark, paths).select("source_rank", "name", F.explode("members").alias("member"))


@query("source_gene_id_lines", """WITH u AS (SELECT unnest(range(len(lines)))::INT AS position, unnest(lines) AS line FROM (SELECT regexp_split_to_array(text, '\\r?\\n') AS lines FROM documents)),
    g AS (SELECT position, trim(regexp_replace(line, '#.*', ''), ' ') AS id FROM u) SELECT position, length(id)::BIGINT AS size, count(*) AS n FROM g WHERE id <> '' GROUP BY 1, 2""")
def source_gene_id_lines(t):
    """Whole documents through the ID-list parser."""
    return genesets.parse_gene_ids(t.documents, "text").groupBy("position", F.length("gene_id").cast("long").alias("size")).agg(F.count("*").alias("n"))


@query("source_embeddings_written", "SELECT vec_id::INT AS sample_index, (vec_id % 5)::TINYINT AS fold, generate_subscripts(embedding, 1)::INT - 1 AS dim, round(unnest(embedding)::DOUBLE, 6) AS x FROM embeddings")
def source_embeddings_written(t):
    path = t.place("embeddings")
    embeddings.write_embeddings(t.embeddings.withColumn("fold", F.col("vec_id") % 5), path, "vec_id")
    read = embeddings.read_embeddings(t.spark, path).select("sample_index", "fold", F.posexplode("embedding").alias("dim", "x"))
    return read.withColumn("x", F.round(F.col("x").cast("double"), 6))


@query("source_scores_read", "SELECT o_orderpriority AS task, 'orders' AS embeddings, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT l_returnflag, 'lines', count(*) FROM lineitem GROUP BY 1")
def source_scores_read(t):
    folders = [t.place("scores") for _ in range(2)]
    parts = ((t.orders, "o_orderpriority", "orders"), (t.lineitem, "l_returnflag", "lines"))
    for folder, (table, key, name) in zip(folders, parts):
        rows = table.groupBy(F.col(key).alias("task")).agg(F.lit(name).alias("embeddings"), F.count("*").alias("n"), F.array(F.lit(1.0)).alias("n_boot"))
        scores.write_scores({"counts": rows}, {"dataset": "given"}, folder)
    return scores.read_scores(t.spark, folders, "counts").select("task", "embeddings", "n")


@query("source_technical_covariates", """WITH v AS (SELECT o_custkey AS k, sum(l_quantity)::BIGINT AS assigned FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)
    SELECT c_custkey::INT AS sample_index, c_nationkey::VARCHAR AS tss, c_mktsegment AS plate, round(log10(assigned + c_nationkey), 6) AS log_reads,
        round(assigned / (assigned + c_nationkey)::DOUBLE, 6) AS assigned_fraction, round((c_nationkey / 32.0)::FLOAT::DOUBLE, 6) AS strand_balance FROM customer JOIN v ON c_custkey = k""")
def source_technical_covariates(t):
    orders = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"))
    counts = orders.groupBy(F.col("o_custkey").cast("int").alias("sample_index")).agg(F.collect_list(F.col("l_quantity").cast("int")).alias("values"))
    found = tables.technical_covariates(sample_axis(t), counts)
    return found.select("sample_index", "tss", "plate", *[F.round(c, 6).alias(c) for c in ("log_reads", "assigned_fraction", "strand_balance")])
