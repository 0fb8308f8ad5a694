"""The embeddings table: (sample_index int, embedding array<float>, fold tinyint), one folder per fold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidyfold.operators.linear import width_of


def write_embeddings(df: DataFrame, path: str, sample: str = "sample_index", vector: str = "embedding", mode: str = "overwrite") -> None:
    """Every row must have the same width."""
    width_of(df, vector)
    table = df.select(
        F.col(sample).cast("int").alias("sample_index"), F.transform(vector, lambda x: x.cast("float")).alias("embedding"),
        F.col("fold").cast("tinyint").alias("fold"),
    )
    # One partition value per fold; rows of a fold stay spread over its writers.
    table.write.mode(mode).partitionBy("fold").parquet(path)


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """A written table, or a folder of single-fold files; both must say their `fold`."""
    df = spark.read.option("recursiveFileLookup", False).parquet(path)
    if "fold" not in df.columns:
        raise ValueError(f"{path} has no fold column")
    return df.select(F.col("sample_index").cast("int"), "embedding", F.col("fold").cast("tinyint").alias("fold"))
