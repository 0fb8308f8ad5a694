"""Gene sets and hierarchies from text: GMT, ID lists, TSV."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidyfold.operators.splits import refuse

COLUMNS = ("GeneSet", "BroadCelltypePathway", "GeneSet_index", "Concept_index", "Genes")
REFERENCE = "Reference"


def parse_gmt(lines: DataFrame, column: str = "value") -> DataFrame:
    """(name, description, members) from tab-separated lines; blank lines and repeated or empty members dropped."""
    parts = F.split(column, "\t")
    members = F.array_distinct(F.filter(F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(0))), lambda g: g != ""))
    return lines.filter(F.trim(column) != "").select(
        F.get(parts, F.lit(0)).alias("name"), F.get(parts, F.lit(1)).alias("description"), members.alias("members")
    )


def repeated_names(sets: DataFrame) -> DataFrame:
    return sets.groupBy("name").agg(F.count("*").alias("n")).filter("n > 1")


def read_gmt(spark: SparkSession, path: str) -> DataFrame:
    sets = parse_gmt(spark.read.text(path))
    refuse(repeated_names(sets), f"{path}: duplicate gene-set names")
    return sets


def write_gmt(sets: DataFrame, path: str) -> None:
    line = F.concat_ws("\t", "name", "description", F.concat_ws("\t", "members"))
    line = F.when(F.size("members") > 0, line).otherwise(F.concat_ws("\t", "name", "description"))
    sets.select(line.alias("value")).write.mode("overwrite").text(path)


def load_gene_sets(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(source_rank, name, description, members) of every source; a name in two sources is an error."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    merged = None
    for rank, path in enumerate(paths):
        sets = read_gmt(spark, path).withColumn("source_rank", F.lit(rank))
        merged = sets if merged is None else merged.unionByName(sets)
    shared = merged.groupBy("name").agg(F.countDistinct("source_rank").alias("n")).filter("n > 1")
    refuse(shared, "gene sets in more than one source")
    return merged.select("source_rank", "name", "description", "members")


def parse_gene_ids(text: DataFrame, column: str = "value") -> DataFrame:
    """(position, gene_id) in order from whole text: one per line, `#` comments and blanks dropped."""
    lines = text.select(F.posexplode(F.split(column, "\r?\n")).alias("position", "line"))
    return lines.select("position", F.trim(F.regexp_replace("line", "#.*", "")).alias("gene_id")).filter(F.col("gene_id") != "")


def read_gene_ids(spark: SparkSession, path: str) -> DataFrame:
    return parse_gene_ids(spark.read.text(path, wholetext=True))


def parse_hierarchy(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, sets) of a gene-set -> concept table.

    edges: (set, position, member). sets: (set, set_index, concept, concept_index)
    with the concept's place by Concept_index, Reference last.
    """
    absent = [c for c in COLUMNS if c not in table.columns]
    if absent:
        raise ValueError(f"hierarchy table lacks columns {absent}")
    table = table.withColumn("GeneSet_index", F.col("GeneSet_index").cast("int")).withColumn("Concept_index", F.col("Concept_index").cast("int"))
    concept = table.groupBy(F.col("BroadCelltypePathway").alias("concept")).agg(
        F.countDistinct("Concept_index").alias("_n"), F.min("Concept_index").alias("concept_index"), F.min("GeneSet_index").alias("_first")
    )
    refuse(concept.filter("_n > 1").select("concept"), "a concept's sets disagree on its Concept_index")
    members = F.split("Genes", ":")
    refuse(table.filter(F.exists(members, lambda g: g == "")).select("GeneSet"), "a gene set has an empty member")
    from pyspark.sql import Window as W

    # Concepts are a vocabulary of a few dozen names.
    place = F.row_number().over(W.orderBy((F.col("concept") == REFERENCE).cast("int"), "concept_index", "_first")) - 1
    places = concept.select("concept", place.alias("concept_index"))
    sets = table.select(F.col("GeneSet").alias("set"), F.col("GeneSet_index").alias("set_index"), F.col("BroadCelltypePathway").alias("concept"))
    edges = table.select(F.col("GeneSet").alias("set"), F.posexplode(members).alias("position", "member"))
    return edges, sets.join(places, "concept").select("set", "set_index", "concept", "concept_index").orderBy("set_index")


def load_hierarchy(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_hierarchy(spark.read.csv(path, sep="\t", header=True))
