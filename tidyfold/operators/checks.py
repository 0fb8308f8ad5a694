"""Leakage checks: does anything fitted on training rows move when held-out rows change?"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scramble_held_out(df: DataFrame, values: str = "values", split: str = "split") -> DataFrame:
    """Validation and test rows reversed, tripled and shifted by one; training rows untouched."""
    moved = F.transform(F.reverse(values), lambda x: x * 3 + 1)
    element = df.schema[values].dataType.simpleString()
    return df.withColumn(values, F.when(F.col(split) == "train", F.col(values)).otherwise(moved.cast(element)))


def embedding_shift(before: DataFrame, after: DataFrame, rows: DataFrame, sample: str = "sample_index",
                    vector: str = "embedding", split: str = "split") -> DataFrame:
    """(train, shift): the largest entry change between two embeddings, by training flag."""
    met = before.select(sample, F.col(vector).alias("_a")).join(after.select(sample, F.col(vector).alias("_b")), sample)
    met = met.join(rows.select(sample, (F.col(split) == "train").alias("train")), sample)
    gap = F.array_max(F.zip_with("_a", "_b", lambda x, y: F.abs(x - y)))
    return met.groupBy("train").agg(F.max(gap).alias("shift"))


def assert_ignores_held_out(embed: Callable[[DataFrame], DataFrame], rows: DataFrame, sample: str = "sample_index",
                            vector: str = "embedding", tolerance: float = 1e-6) -> None:
    """Raise unless training rows embed alike, and held-out rows differently, after the scramble."""
    found = {r["train"]: r["shift"] for r in embedding_shift(embed(rows), embed(scramble_held_out(rows)), rows, sample, vector).collect()}
    if found.get(True, 0.0) > tolerance:
        raise AssertionError(f"training embeddings moved by {found[True]:.3g}: a fitted statistic read held-out rows")
    if found.get(False, 1.0) <= tolerance:
        raise AssertionError("held-out embeddings did not move: the scramble did not reach them")
