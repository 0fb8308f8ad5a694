"""Score tables as JSON: one folder per table, with the `meta` they were scored under."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidyfold.operators.splits import refuse

# What must agree before scores are compared.
META = ("dataset", "labels", "salt", "bootstrap", "endpoint", "pathways")


def records(table: DataFrame, replicates: bool = False) -> DataFrame:
    """The table without its replicate columns, unless they are wanted."""
    return table if replicates else table.drop(*[c for c in table.columns if c.endswith("_boot")])


def write_scores(tables: dict[str, DataFrame], meta: dict[str, str], folder: str, replicates: bool = False) -> None:
    spark = next(iter(tables.values())).sparkSession
    row = [tuple(str(meta.get(k)) for k in META)]
    spark.createDataFrame(row, ", ".join(f"`{k}` string" for k in META)).write.mode("overwrite").json(f"{folder}/meta")
    for name, table in tables.items():
        records(table, replicates).write.mode("overwrite").json(f"{folder}/{name}")


def read_scores(spark: SparkSession, folders: Sequence[str], table: str) -> DataFrame:
    """One table over several folders; folders scored under different settings are refused."""
    schema = ", ".join(f"`{k}` string" for k in META)
    metas, merged = None, None
    for folder in folders:
        meta = spark.read.schema(schema).json(f"{folder}/meta")
        part = spark.read.json(f"{folder}/{table}")
        metas = meta if metas is None else metas.unionByName(meta)
        merged = part if merged is None else merged.unionByName(part, allowMissingColumns=True)
    kinds = metas.distinct()
    if kinds.count() > 1:
        raise ValueError(f"scores differ in their settings: {[r.asDict() for r in kinds.take(5)]}")
    return merged


def score_row(table: DataFrame, embeddings: str, split: str, task: str | None = None, validate: bool = True) -> DataFrame:
    """The one row of an embedding, split and task; more than one is an error."""
    found = table.filter((F.col("embeddings") == embeddings) & (F.col("split") == split))
    if task is not None:
        found = found.filter(F.col("task") == task)
    if validate:
        refuse(found.groupBy("embeddings", "split").count().filter("count > 1"), "more than one score row")
    return found
