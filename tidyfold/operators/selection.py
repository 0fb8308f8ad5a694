"""Choosing genes and samples, and the loader that puts both together."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidyfold.functions import arrays
from tidyfold.operators import splits
from tidyfold.operators.splits import refuse

# Biotype, sample-type and project names as the data spells them.
DEFAULT_GENE_TYPES = ("protein_coding",)
NORMAL = "Solid Tissue Normal"
PRIMARY = ("Primary Tumor", "Primary Blood Derived Cancer - Peripheral Blood")
ORGAN_TASKS = {
    "lung": ("TCGA-LUAD", "TCGA-LUSC"),
    "kidney": ("TCGA-KICH", "TCGA-KIRC", "TCGA-KIRP"),
    "colorectal": ("TCGA-COAD", "TCGA-READ"),
    "glioma": ("TCGA-GBM", "TCGA-LGG"),
}
# The organ each project was sampled from.
PROJECT_ORGAN = {
    "TCGA-ACC": "adrenal_gland",
    "TCGA-BLCA": "bladder",
    "TCGA-BRCA": "breast",
    "TCGA-CESC": "cervix",
    "TCGA-CHOL": "bile_duct",
    "TCGA-COAD": "colorectal",
    "TCGA-DLBC": "lymph_node",
    "TCGA-ESCA": "esophagus",
    "TCGA-GBM": "brain",
    "TCGA-HNSC": "head_and_neck",
    "TCGA-KICH": "kidney",
    "TCGA-KIRC": "kidney",
    "TCGA-KIRP": "kidney",
    "TCGA-LAML": "blood",
    "TCGA-LGG": "brain",
    "TCGA-LIHC": "liver",
    "TCGA-LUAD": "lung",
    "TCGA-LUSC": "lung",
    "TCGA-MESO": "pleura",
    "TCGA-OV": "ovary",
    "TCGA-PAAD": "pancreas",
    "TCGA-PCPG": "adrenal_gland",
    "TCGA-PRAD": "prostate",
    "TCGA-READ": "colorectal",
    "TCGA-SARC": "soft_tissue",
    "TCGA-SKCM": "skin",
    "TCGA-STAD": "stomach",
    "TCGA-TGCT": "testis",
    "TCGA-THCA": "thyroid",
    "TCGA-THYM": "thymus",
    "TCGA-UCEC": "uterus",
    "TCGA-UCS": "uterus",
    "TCGA-UVM": "eye",
}
# The chromosomes in order.
CHROMOSOMES = tuple(f"chr{c}" for c in [*range(1, 23), "X", "Y", "M"])
PAR_Y = "_PAR_Y"


def select_genes(
    genes: DataFrame,
    gene_types: Sequence[str] | None = DEFAULT_GENE_TYPES,
    gene_ids: DataFrame | None = None,
    drop_par_y: bool = True,
    type_col: str = "gene_type",
    validate: bool = True,
) -> DataFrame:
    """Rows of `genes` by biotype, or by an ordered list of IDs (then in that order)."""
    if gene_ids is not None:
        return genes_by_id(genes, gene_ids, validate=validate)
    chosen = genes if gene_types is None else genes.filter(F.col(type_col).isin(*gene_types))
    if drop_par_y:
        chosen = chosen.filter(~F.col("gene_id").cast("string").endswith(PAR_Y))
    if validate and chosen.isEmpty():
        raise ValueError(f"no genes of types {gene_types}")
    return chosen


def genes_by_id(genes: DataFrame, ids: DataFrame, validate: bool = True) -> DataFrame:
    """Genes for `ids` (position, gene_id), in order.

    A versioned ID must match exactly; an unversioned one matches any version
    but never a PAR_Y copy.
    """
    exact = genes.select(F.col("gene_id").alias("_exact"), F.struct(*genes.columns).alias("_g1"))
    loose = genes.filter(~F.col("gene_id").endswith(PAR_Y)).select(
        F.substring_index("gene_id", ".", 1).alias("_stem"), F.struct(*genes.columns).alias("_g2")
    )
    wanted = ids.select("position", F.col("gene_id").alias("_id"))
    found = (
        wanted.join(exact, F.col("_id") == F.col("_exact"), "left")
        .join(loose, (F.col("_id") == F.col("_stem")) & ~F.col("_id").contains("."), "left")
        .withColumn("_g", F.coalesce("_g1", "_g2"))
    )
    if validate:
        refuse(wanted.groupBy("_id").count().filter("count > 1"), "duplicate gene IDs")
        refuse(found.filter(F.col("_g").isNull()).select("_id"), "gene IDs not in the data")
    return found.select("position", "_g.*").orderBy("position")


def task_label(task: str, project: str = "project_id", sample_type: str = "sample_type", normal: str = NORMAL,
               tasks: Mapping[str, Sequence] = ORGAN_TASKS) -> Column:
    """A classification task's label; null leaves the sample out."""
    is_normal = F.col(sample_type) == normal
    if task == "project_id":
        return F.when(~is_normal, F.col(project))
    if task == "tumor_vs_normal":
        return F.when(is_normal, "normal").otherwise("tumor")
    if task in tasks:
        return F.when(~is_normal & F.col(project).isin(*tasks[task]), F.col(project))
    raise ValueError(f"unknown task {task!r}; expected one of {['project_id', 'tumor_vs_normal', *tasks]}")


def label_classes(samples: DataFrame, name: str) -> DataFrame:
    """(name, class_index): distinct names in sorted order, numbered from 0.

    Class names are a vocabulary, not data: the table is as small as the label set.
    """
    from pyspark.sql import Window as W

    distinct = samples.filter(F.col(name).isNotNull()).select(name).distinct()
    return distinct.withColumn("class_index", F.row_number().over(W.orderBy(name)) - 1)


def supervision_table(spark, supervision: str, organs: Mapping[str, str] = PROJECT_ORGAN) -> DataFrame:
    """(project, name): the class a project supervises with, its `organ` or the `project` itself; no rows for `none`."""
    kinds = {"none": lambda p: None, "organ": organs.get, "project": lambda p: p}
    if supervision not in kinds:
        raise ValueError(f"no supervision by {supervision!r}: one of {', '.join(kinds)}")
    rows = [(p, kinds[supervision](p)) for p in organs]
    return spark.createDataFrame(rows, "project string, name string").filter("name IS NOT NULL")


def supervision_labels(samples: DataFrame, project: str, supervision: str, organs: Mapping[str, str] = PROJECT_ORGAN) -> DataFrame:
    """Samples with `name` and `class_index`; without supervision there are no labels to give."""
    if supervision == "none":
        raise ValueError("without supervision samples have no labels")
    table = supervision_table(samples.sparkSession, supervision, organs).withColumnRenamed("project", project)
    return sample_labels(samples, project, table, "name")


def sample_labels(samples: DataFrame, project: str, project_class: DataFrame, name: str = "organ") -> DataFrame:
    """Samples with the class name and index of their project; an unmapped project fails the job."""
    mapped = samples.join(project_class.select(project, name), project, "left")
    missing = F.concat(F.lit("project without a class: "), F.col(project).cast("string"))
    named = mapped.withColumn(name, F.coalesce(F.col(name), F.raise_error(missing).cast("string")))
    return named.join(label_classes(project_class, name), name)


def survival_samples(
    rows: DataFrame, case: str = "case_submitter_id", sample: str = "sample_index",
    sample_type: str = "sample_type", primary: Sequence[str] = PRIMARY,
) -> DataFrame:
    """One row per case: its primary-tumour sample of lowest index."""
    kept = rows.filter(F.col(sample_type).isin(*primary))
    others = [c for c in rows.columns if c != case]
    earliest = kept.groupBy(case).agg(F.min_by(F.struct(*others), sample).alias("_first"))
    return earliest.select(case, "_first.*")


def genome_order(genes: DataFrame, chromosome: str = "chromosome", start: str = "start",
                 index: str = "gene_index", chromosomes: Sequence = CHROMOSOMES) -> DataFrame:
    """Genes by chromosome rank then start; other chromosomes last, in dataset order."""
    place = F.array_position(F.array(*[F.lit(c) for c in chromosomes]), F.col(chromosome))
    known = place > 0
    rank = F.when(known, place).otherwise(F.lit(len(chromosomes) + 1))
    return genes.withColumn("chromosome_rank", rank).orderBy(
        "chromosome_rank", F.when(known, F.col(start)).asc_nulls_last(), index
    )


def concept_genes(genes: DataFrame, members: DataFrame, name: str = "gene_name") -> DataFrame:
    """Selected genes that some concept's set contains."""
    return genes.join(members.select(F.col("gene").alias(name)).distinct(), name, "left_semi")


def detected(train: DataFrame, feature: str = "feature", value: str = "value") -> DataFrame:
    """Features some training sample expresses."""
    return train.groupBy(feature).agg(F.bool_or(F.col(value) > 0).alias("detected")).filter("detected").select(feature)


def load_expression(
    samples: DataFrame,
    values: DataFrame,
    gene_positions: Sequence[int],
    transform: str = "none",
    library_size: float = arrays.LIBRARY_SIZE,
    projects: Sequence[str] | None = None,
    sample_types: Sequence[str] | None = None,
    fold: int = 0,
    salt: str = splits.DEFAULT_SALT,
    hash_fn: str = "blake2b",
    case: str = "case_submitter_id",
    group: str = "project_id",
    sample: str = "sample_index",
) -> DataFrame:
    """Samples with `split`, `test_fold` and the chosen genes' transformed `values`.

    Folds are drawn over the whole cohort; the filters come after.
    """
    cohort = splits.with_split(splits.with_buckets(samples, case, group, salt, hash_fn), fold)
    if projects is not None:
        cohort = cohort.filter(F.col(group).isin(*projects))
    if sample_types is not None:
        cohort = cohort.filter(F.col("sample_type").isin(*sample_types))
    chosen = arrays.gather(F.col("values"), list(gene_positions))
    rows = values.select(sample, arrays.transform_values(chosen, transform, library_size).alias("values"))
    return cohort.join(rows, sample)


def rows_of(df: DataFrame, split: str) -> DataFrame:
    return df.filter(F.col("split") == split)


def epoch_batches(df: DataFrame, split: str, epoch: int, sample: str = "sample_index",
                  batch_rows: int = 256, seed: int = 0) -> DataFrame:
    """Training rows in a fresh order per epoch, each with its `batch`; the last partial batch dropped.

    The order is a hash of (seed, epoch, sample), numbered range by range.
    """
    from tidyfold.functions.hashing import md5_hex
    from tidyfold.operators.ordering import hash_rank

    shuffled = rows_of(df, split).withColumn("_hex", md5_hex(seed, epoch, F.col(sample)))
    placed = hash_rank(shuffled.withColumn("_all", F.lit(0)), ["_all"], "_hex", sample)
    batch = F.floor(F.col("rank") / batch_rows)
    full = F.floor(F.col("size") / batch_rows)
    return placed.withColumn("batch", batch).filter(F.col("batch") < full).drop("_hex", "_all", "rank", "size")


def prepared_rows(df: DataFrame, split: str, sample: str = "sample_index") -> DataFrame:
    """Every row of a split in sample order, for prediction."""
    return rows_of(df, split).orderBy(sample)
