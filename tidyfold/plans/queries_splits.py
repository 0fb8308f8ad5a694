"""Patient-level splits and selections over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidyfold.operators import ordering, reports, selection, splits
from tidyfold.plans import roles
from tidyfold.plans.registry import query
from tidyfold.plans.roles import SQL_BUCKETS, SQL_SAMPLES

BASE = "WITH " + SQL_BUCKETS.strip()
WITH_SAMPLES = BASE + "," + SQL_SAMPLES


@query("split_case_hash", f"SELECT c_custkey AS case_id, {roles.md5_sql(repr(roles.SALT), 'c_custkey')} AS hash FROM customer")
def split_case_hash(t):
    from tidyfold.functions.hashing import hex_number, salted_hex

    hexed = salted_hex(roles.SALT, F.col("c_custkey"), "md5")
    return t.customer.select(F.col("c_custkey").alias("case_id"), hex_number(hexed).cast("bigint").alias("hash"))


@query("split_case_hash_blake2b")
def split_case_hash_blake2b(t):
    from tidyfold.functions.hashing import hex_number, salted_hex

    return t.customer.select(F.col("c_custkey").alias("case_id"), hex_number(salted_hex(roles.SALT, F.col("c_custkey"))).alias("hash"))


@query("split_rank_block", BASE + " SELECT case_id, rnk AS rank, size, (5 * (2 * rnk + 1)) // (2 * size) AS block FROM ranked")
def split_rank_block(t):
    return roles.buckets(t).select("case_id", "rank", "size", splits.rank_block(F.col("rank"), F.col("size")).alias("block"))


@query("split_fold_layout", BASE + """ SELECT bucket, fold, CASE WHEN bucket // 20 = fold THEN 'test'
    WHEN bucket % 20 >= 18 THEN 'val' ELSE 'train' END AS split, count(*) AS cases
    FROM bucketed, (SELECT unnest([0, 1, 2, 3, 4]) AS fold) GROUP BY 1, 2, 3""")
def split_fold_layout(t):
    layout = splits.fold_layout(t.spark)
    return roles.buckets(t).join(layout, "bucket").groupBy("bucket", "fold", "split").agg(F.count("*").alias("cases"))


@query("split_case_buckets", BASE + " SELECT case_id, project, bucket FROM bucketed")
def split_case_buckets(t):
    return roles.buckets(t).select("case_id", "project", "bucket")


@query("split_sample_buckets", WITH_SAMPLES + " SELECT sample, bucket FROM samples")
def split_sample_buckets(t):
    return roles.bucketed_samples(t).select("sample", "bucket")


@query("split_sample_folds", WITH_SAMPLES + " SELECT sample, test_fold FROM samples")
def split_sample_folds(t):
    return roles.bucketed_samples(t).select("sample", "test_fold")


@query("split_samples", WITH_SAMPLES + """ SELECT sample, CASE WHEN test_fold = 2 THEN 'test'
    WHEN bucket % 20 >= 18 THEN 'val' ELSE 'train' END AS split FROM samples""")
def split_samples(t):
    return splits.with_split(roles.bucketed_samples(t), 2).select("sample", "split")


@query("split_indices", WITH_SAMPLES + " SELECT split, sample FROM samples")
def split_indices(t):
    return splits.split_rows(splits.with_split(roles.bucketed_samples(t), 0), "sample")


@query("split_summary", WITH_SAMPLES + """ SELECT project, count(*) FILTER (split = 'train') AS train,
    count(*) FILTER (split = 'val') AS val, count(*) FILTER (split = 'test') AS test, count(*) AS total FROM samples GROUP BY 1""")
def split_summary(t):
    return splits.summarize(splits.with_split(roles.bucketed_samples(t), 0), "project")


@query("split_fold_summary", WITH_SAMPLES + " SELECT project, " + ", ".join(
    f"count(*) FILTER (test_fold = {k}) AS fold{k}" for k in range(5)) + ", count(*) AS total FROM samples GROUP BY 1")
def split_fold_summary(t):
    return splits.summarize_folds(roles.bucketed_samples(t), "project")


@query("split_command_table", WITH_SAMPLES + """ SELECT split, count(*) AS samples, count(DISTINCT case_id) AS cases,
    count(*) / (SELECT count(*) FROM samples) AS share FROM samples GROUP BY 1""")
def split_command_table(t):
    return splits.split_table(splits.with_split(roles.bucketed_samples(t), 0), "split", "case_id")


@query("split_plan", WITH_SAMPLES + """ SELECT sample, fold, test_fold = fold AS test, test_fold <> fold AS fit
    FROM samples, (SELECT unnest([0, 1, 2, 3, 4]) AS fold)""")
def split_plan(t):
    rows = splits.every_fold(t.orders.select(F.col("o_orderkey").alias("sample")))
    return splits.plan(rows, roles.bucketed_samples(t), "sample").select("sample", "fold", "test", "fit")


@query("split_repeated_rows", """ SELECT 0 AS fold, l_orderkey AS sample, count(*) AS n FROM lineitem GROUP BY 2 HAVING count(*) > 1""")
def split_repeated_rows(t):
    rows = t.lineitem.select(F.lit(0).alias("fold"), F.col("l_orderkey").alias("sample"))
    return splits.repeated(rows, "sample")


@query("split_moves_on_drop", BASE + """, sizes AS (SELECT project, count(*) AS n FROM cohort GROUP BY 1),
    ns AS (SELECT DISTINCT n FROM sizes), r AS (SELECT n, unnest(range(n)) AS r FROM ns), d AS (SELECT n AS dn, r AS dropped FROM r)
    SELECT n, dropped, sum(CASE WHEN r <> dropped AND (5 * (2 * r + 1)) // (2 * n)
        <> (5 * (2 * (r - (r > dropped)::INT) + 1)) // (2 * greatest(n - 1, 1)) THEN 1 ELSE 0 END)::BIGINT AS moved
    FROM r JOIN d ON n = dn GROUP BY 1, 2""")
def split_moves_on_drop(t):
    sizes = t.customer.groupBy("c_nationkey").agg(F.count("*").alias("n")).select("n").distinct()
    return splits.moves_on_drop(sizes)


@query("split_every_fold", "SELECT vec_id, fold, label FROM embeddings, (SELECT unnest([0, 1, 2, 3, 4]) AS fold)")
def split_every_fold(t):
    return splits.every_fold(t.embeddings.select("vec_id", "label"))


# ---- selections


@query("select_features_by_type", "SELECT p_partkey AS gene_index, p_type AS gene_type FROM part WHERE p_type IN ('ECONOMY', 'SMALL')")
def select_features_by_type(t):
    genes = t.part.select(F.col("p_partkey").alias("gene_index"), F.col("p_name").alias("gene_id"), F.col("p_type").alias("gene_type"))
    return selection.select_genes(genes, ("ECONOMY", "SMALL")).select("gene_index", "gene_type")


@query("select_features_by_id", """WITH ids AS (SELECT p_name || '.' || p_partkey AS gene_id, p_partkey AS gene_index FROM part)
    SELECT l.l_partkey AS position, i.gene_index FROM (SELECT DISTINCT l_partkey FROM lineitem) l
    JOIN ids i ON i.gene_index = l.l_partkey""")
def select_features_by_id(t):
    genes = t.part.select(
        F.col("p_partkey").alias("gene_index"), F.concat_ws(".", "p_name", F.col("p_partkey").cast("string")).alias("gene_id")
    )
    shipped = t.lineitem.select(F.col("l_partkey").alias("gene_index")).distinct().join(genes, "gene_index")
    ids = shipped.select(F.col("gene_index").alias("position"), "gene_id")
    return selection.genes_by_id(genes, ids, validate=False).select("position", "gene_index")


@query("select_loaded_rows", WITH_SAMPLES + " SELECT sample, project, sample_type, split, test_fold FROM samples WHERE sample_type IN ('F', 'O') AND project IN (1, 2, 3, 4)")
def select_loaded_rows(t):
    rows = splits.with_split(roles.bucketed_samples(t), 0)
    kept = rows.filter(F.col("project").isin(1, 2, 3, 4) & F.col("sample_type").isin("F", "O"))
    return kept.select("sample", "project", "sample_type", "split", "test_fold")


@query("select_split_rows", WITH_SAMPLES + " SELECT sample, case_id FROM samples WHERE split = 'test'")
def select_split_rows(t):
    return selection.rows_of(splits.with_split(roles.bucketed_samples(t), 0), "test").select("sample", "case_id")


@query("select_log_normalized", """WITH v AS (SELECT o_custkey AS sample, l_partkey AS feature, sum(l_quantity) AS value
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)
    SELECT sample, feature, round(ln(1 + value * 1e5 / greatest(sum(value) OVER (PARTITION BY sample), 1)), 6) AS value FROM v""")
def select_log_normalized(t):
    return reports.log_normalize_tidy(roles.values(t), "sample").select("sample", "feature", F.round("value", 6).alias("value"))


@query("select_array_transforms", """WITH u AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS position, abs(unnest(embedding)::DOUBLE) AS x FROM embeddings)
    SELECT vec_id, position, round(ln(1 + x), 6) AS logged,
    round(ln(1 + x * 1e5 / greatest(sum(x) OVER (PARTITION BY vec_id), 1)), 6) AS normed FROM u""")
def select_array_transforms(t):
    from tidyfold.functions.arrays import transform_values

    size = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    rows = t.embeddings.select("vec_id", size.alias("v"))
    both = F.arrays_zip(transform_values(F.col("v"), "log1p").alias("logged"), transform_values(F.col("v"), "lognorm").alias("normed"))
    flat = rows.select("vec_id", F.posexplode(both).alias("position", "s"))
    return flat.select("vec_id", "position", F.round("s.logged", 6).alias("logged"), F.round("s.normed", 6).alias("normed"))


@query("select_task_labels", """SELECT o_orderkey AS sample, CASE WHEN o_orderstatus <> 'F' THEN c_nationkey END AS project_label,
    CASE WHEN o_orderstatus = 'F' THEN 'normal' ELSE 'tumor' END AS normal_label,
    CASE WHEN o_orderstatus <> 'F' AND c_nationkey IN (3, 4, 5) THEN c_nationkey END AS organ_label
    FROM orders JOIN customer ON o_custkey = c_custkey""")
def select_task_labels(t):
    tasks = {"organ": (3, 4, 5)}

    def label(task):
        return selection.task_label(task, "project", "sample_type", "F", tasks)

    return roles.samples(t).select(
        "sample", label("project_id").alias("project_label"), label("tumor_vs_normal").alias("normal_label"), label("organ").alias("organ_label")
    )


@query("select_label_classes", """SELECT p_brand AS organ, (row_number() OVER (ORDER BY p_brand) - 1)::INT AS class_index
    FROM (SELECT DISTINCT p_brand FROM part)""")
def select_label_classes(t):
    return selection.label_classes(t.part.withColumnRenamed("p_brand", "organ"), "organ")


@query("select_sample_labels", """SELECT o_orderkey AS sample, r_name AS organ,
    (dense_rank() OVER (ORDER BY r_name) - 1)::INT AS class_index FROM orders JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def select_sample_labels(t):
    organs = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("project"), F.col("r_name").alias("organ")
    )
    return selection.sample_labels(roles.samples(t), "project", organs).select("sample", "organ", "class_index")


@query("select_survival_samples", """SELECT o_custkey AS case_id, min(o_orderkey) AS sample FROM orders
    WHERE o_orderstatus IN ('O', 'P') GROUP BY 1""")
def select_survival_samples(t):
    rows = roles.samples(t).select("case_id", "sample", "sample_type")
    return selection.survival_samples(rows, "case_id", "sample", "sample_type", ("O", "P")).select("case_id", "sample")


@query("select_genome_order", """WITH g AS (SELECT p_partkey AS gene_index, coalesce(nullif(list_position(['SMALL', 'ECONOMY', 'LARGE'], p_type), 0), 4) AS chromosome_rank,
    round(p_retailprice, 2) AS start FROM part) SELECT gene_index, chromosome_rank::BIGINT AS chromosome_rank,
    (row_number() OVER (PARTITION BY chromosome_rank ORDER BY CASE WHEN chromosome_rank < 4 THEN start ELSE 0 END, gene_index) - 1)::BIGINT AS place FROM g""")
def select_genome_order(t):
    """Every gene's place on its chromosome, ranked without sorting a chromosome in one task."""
    genes = t.part.select(F.col("p_partkey").alias("gene_index"), F.col("p_type").alias("chromosome"), F.round("p_retailprice", 2).alias("start"))
    ranked = selection.genome_order(genes, chromosomes=("SMALL", "ECONOMY", "LARGE"))
    ranked = ranked.withColumn("before", F.when(F.col("chromosome_rank") < 4, -F.col("start")).otherwise(F.lit(0.0)))
    placed = ordering.rank_rows(ranked, ["chromosome_rank"], "before", "gene_index")
    return placed.select("gene_index", F.col("chromosome_rank").cast("bigint").alias("chromosome_rank"), F.col("rank").cast("bigint").alias("place"))


@query("select_concept_features", """SELECT p_partkey AS gene_index FROM part WHERE p_type = 'ECONOMY'
    AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 5))""")
def select_concept_features(t):
    genes = t.part.filter("p_type = 'ECONOMY'").select(F.col("p_partkey").alias("gene_index"))
    near = t.supplier.filter("s_nationkey < 5").select(F.col("s_suppkey").alias("set"))
    members = roles.supplier_sets(t).join(near, "set").select(F.col("feature").alias("gene"))
    return selection.concept_genes(genes, members, "gene_index")


@query("select_detected", BASE + "," + roles.SQL_VALUES + " SELECT DISTINCT feature FROM sv WHERE split = 'train' AND value > 0")
def select_detected(t):
    return selection.detected(roles.split_values(t).filter("split = 'train'"))


@query("select_covariates", """SELECT l_orderkey AS sample, round(log10(sum(l_quantity)), 6) AS log_reads,
    round(sum(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0 END) / sum(l_quantity), 6) AS assigned_fraction,
    regexp_extract(min(o_orderpriority), '^[^-]*') AS tss, nullif(split_part(min(o_orderpriority), '-', 6), '') AS plate
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def select_covariates(t):
    reads = t.lineitem.groupBy(F.col("l_orderkey").alias("sample")).agg(
        F.sum(F.when(F.col("l_linestatus") == "F", F.col("l_quantity")).otherwise(0.0)).alias("assigned"),
        F.sum("l_quantity").alias("total"),
    )
    met = reads.join(t.orders.select(F.col("o_orderkey").alias("sample"), "o_orderpriority"), "sample")
    return met.select(
        "sample", F.round(F.log10("total"), 6).alias("log_reads"), F.round(F.try_divide("assigned", "total"), 6).alias("assigned_fraction"),
        F.get(F.split("o_orderpriority", "-"), F.lit(0)).alias("tss"), F.get(F.split("o_orderpriority", "-"), F.lit(5)).alias("plate"),
    )


@query("select_epoch_batches", f"""WITH {SQL_BUCKETS.strip()}, tr AS (SELECT case_id, row_number() OVER (ORDER BY
    substr(md5('0:1:' || case_id), 1, 15), case_id) - 1 AS r, count(*) OVER () AS n FROM split0 WHERE split = 'train')
    SELECT case_id, r // 64 AS batch FROM tr WHERE r // 64 < n // 64""")
def select_epoch_batches(t):
    rows = splits.with_split(roles.bucketed(t), 0).select("case_id", "split")
    return selection.epoch_batches(rows, "train", 1, "case_id", 64).select("case_id", F.col("batch").cast("bigint").alias("batch"))


@query("select_labelled_rows", WITH_SAMPLES + """ SELECT sample, (dense_rank() OVER (ORDER BY c_mktsegment) - 1)::INT AS class_index
    FROM samples JOIN customer ON case_id = c_custkey WHERE split = 'val'""")
def select_labelled_rows(t):
    rows = selection.rows_of(splits.with_split(roles.bucketed_samples(t), 0), "val")
    named = rows.join(t.customer.select(F.col("c_custkey").alias("case_id"), "c_mktsegment"), "case_id")
    classes = selection.label_classes(t.customer, "c_mktsegment")
    return named.join(classes, "c_mktsegment").select("sample", "class_index")
