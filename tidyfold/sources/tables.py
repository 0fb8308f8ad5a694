"""Reading the dataset: axes, value tables, per-project patient files and their labels.

`root/revision/<table>` holds Parquet; the revision is part of the path, so
Spark prunes to it and results can be recorded against it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidyfold.functions.arrays import total
from tidyfold.sources import schemas


def _path(root: str, revision: str | None, table: str) -> str:
    return "/".join(p for p in (root, revision, table) if p)


def load_samples(spark: SparkSession, root: str, revision: str | None = None) -> DataFrame:
    """The row axis, one aliquot per row."""
    return spark.read.schema(schemas.SAMPLES).parquet(_path(root, revision, "samples"))


def load_genes(spark: SparkSession, root: str, revision: str | None = None) -> DataFrame:
    """The column axis, in `values` order."""
    return spark.read.schema(schemas.GENES).parquet(_path(root, revision, "genes"))


def matrix_faults(df: DataFrame, sample: str = "sample_index", values: str = "values") -> DataFrame:
    """One row: `rows`, `distinct`, `first`, `last`, `shortest`, `longest` of a matrix table."""
    return df.agg(
        F.count("*").alias("rows"), F.countDistinct(sample).alias("distinct"), F.min(sample).alias("first"), F.max(sample).alias("last"),
        F.min(F.size(values)).alias("shortest"), F.max(F.size(values)).alias("longest"),
    )


def check_matrix(df: DataFrame, sample: str = "sample_index", values: str = "values") -> None:
    """Rows must be 0..n-1 once each, with one array length. One aggregate."""
    f = matrix_faults(df, sample, values).first()
    if f["rows"] and not (f["first"] == 0 and f["last"] == f["rows"] - 1 and f["distinct"] == f["rows"]):
        raise ValueError(f"{sample} is not dense from 0: {f.asDict()}")
    if f["shortest"] != f["longest"]:
        raise ValueError(f"rows are ragged: {f['shortest']} to {f['longest']} values")


def load_values(spark: SparkSession, root: str, quantification: str = "unstranded", revision: str | None = None,
                validate: bool = True) -> DataFrame:
    """(sample_index, values): only these two columns are read."""
    df = spark.read.schema(schemas.values_schema(quantification)).parquet(_path(root, revision, quantification))
    if validate:
        check_matrix(df)
    return df


def to_tidy(df: DataFrame, sample: str = "sample_index", values: str = "values") -> DataFrame:
    """(sample, feature, value) with zeros left out, for column-wise work."""
    long = df.select(sample, F.posexplode(values).alias("feature", "value"))
    return long.filter(F.col("value") != 0)


def patient_files(root: str, revision: str | None = None, project: str = "*") -> str:
    """The glob over per-project files."""
    return _path(root, revision, f"{project}/data.parquet")


def read_patient_columns(spark: SparkSession, columns: Sequence[str], root: str, revision: str | None = None) -> DataFrame:
    """Some columns of every per-project file, their schemas merged; nothing else is read."""
    return spark.read.option("mergeSchema", True).parquet(patient_files(root, revision)).select(*columns)


def cached(spark: SparkSession, name: str, folder: str, revision: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A derived table, written once per revision; the commit protocol keeps a half-written one invisible."""
    path = f"{folder}/{revision}/{name}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def flatten_survival(patients: DataFrame, column: str = "survival_derived") -> DataFrame:
    """(case, project, <endpoint>_event, <endpoint>_time ...); null where undefined."""
    return patients.select("case_submitter_id", "project_id", *[F.col(f"{column}.{f.name}").alias(f.name) for f in schemas.SURVIVAL.fields])


def load_survival(spark: SparkSession, root: str, revision: str | None = None) -> DataFrame:
    return flatten_survival(read_patient_columns(spark, ["case_submitter_id", "project_id", "survival_derived"], root, revision))


def flatten_ssgsea(patients: DataFrame, column: str) -> DataFrame:
    """(aliquot_id, pathway, score): one row per aliquot and pathway, each aliquot once.

    An aliquot scored on another pathway list than the rest fails the job.
    """
    records = patients.select(F.explode(column).alias("r")).select("r.aliquot_id", "r.pathway", "r.score_raw")
    records = records.groupBy("aliquot_id").agg(F.min(F.struct("pathway", "score_raw")).alias("r")).select("aliquot_id", "r.*")
    lists = records.agg(F.min("pathway").alias("a"), F.max("pathway").alias("b"))
    same = lists.select(F.col("a") == F.col("b")).scalar()
    wrong = F.raise_error(F.lit("aliquots were scored on different pathway lists")).cast("string")
    long = records.select("aliquot_id", F.explode(F.arrays_zip("pathway", "score_raw")).alias("z"))
    return long.select("aliquot_id", F.when(same, F.col("z.pathway")).otherwise(wrong).alias("pathway"), F.col("z.score_raw").alias("score"))


def widen_pathways(scores: DataFrame, pathways: Sequence[str] | None = None, key: str = "aliquot_id") -> DataFrame:
    """One column per pathway; the list is a vocabulary."""
    names = list(pathways) if pathways is not None else [r[0] for r in scores.select("pathway").distinct().orderBy("pathway").collect()]
    return scores.groupBy(key).pivot("pathway", names).agg(F.first("score"))


def load_ssgsea(spark: SparkSession, root: str, collection: str = "hallmark", revision: str | None = None) -> DataFrame:
    column = f"samples_ssgsea_{collection}"
    return widen_pathways(flatten_ssgsea(read_patient_columns(spark, [column], root, revision), column))


def technical_covariates(samples: DataFrame, values: DataFrame) -> DataFrame:
    """tss, plate, log_reads, assigned_fraction and strand_balance per sample_index.

    Short barcodes give null fields; a sample without reads gives null ratios.
    """
    assigned = values.select("sample_index", total(F.col("values")).alias("_assigned"))
    reads = F.col("_assigned") + sum((F.coalesce(F.col(c), F.lit(0)) for c in schemas.UNASSIGNED[1:]), F.coalesce(F.col(schemas.UNASSIGNED[0]), F.lit(0)))
    met = samples.join(assigned, "sample_index").withColumn("_reads", reads)
    return met.select(
        "sample_index", F.get(F.split("case_submitter_id", "-"), F.lit(1)).alias("tss"),
        F.get(F.split("aliquot_submitter_id", "-"), F.lit(5)).alias("plate"), F.log10("_reads").alias("log_reads"),
        F.try_divide(F.col("_assigned"), F.col("_reads").cast("double")).alias("assigned_fraction"), F.col("strand_balance").cast("double").alias("strand_balance"),
    )
