"""The baseline embeddings: most variable features and PCA, fit per fold on training rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidyfold.operators import splits
from tidyfold.operators.blocks import pack
from tidyfold.operators.linear import affine, pca_axes
from tidyfold.operators.ordering import top_k
from tidyfold.session import stable


def hvg_features(values: DataFrame, bucketed: DataFrame, case: str, k: int = 5000, digits: int | None = None) -> DataFrame:
    """(fold, feature, mean, sd): every fold's k most variable training features.

    One job for all folds: `fold` is a group key, and a value's five roles are
    conditional sums over one scan rather than five copies of it.
    """
    roles = bucketed.select(F.col(case).alias("sample"), "bucket")
    tagged = values.join(roles, "sample")
    is_train = [splits.split_of(F.col("bucket"), f) == "train" for f in range(splits.N_FOLDS)]
    sizes = roles.agg(*[F.sum(t.cast("bigint")).alias(f"n{f}") for f, t in enumerate(is_train)])
    v = F.col("value").cast("double")

    def per_fold(f: int, keep: Column) -> list[Column]:
        kept = F.when(keep, v)
        return [F.count(kept).alias(f"m{f}"), F.avg(kept).alias(f"a{f}"), F.var_pop(kept).alias(f"v{f}")]

    sums = tagged.groupBy("feature").agg(*[c for f, keep in enumerate(is_train) for c in per_fold(f, keep)])
    rows = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(f).alias("fold"), F.col(f"m{f}").cast("double").alias("m"), F.col(f"a{f}").alias("a"), F.col(f"v{f}").alias("v"),
                    sizes.select(f"n{f}").scalar().cast("double").alias("n"),
                )
                for f in range(splits.N_FOLDS)
            ]
        )
    )
    long = sums.select("feature", rows.alias("s")).select("feature", "s.*").filter("m > 0")
    share = F.col("m") / F.col("n")
    var = share * F.col("v") + F.col("a") * F.col("a") * share * (1 - share)
    stats = long.select("fold", "feature", (F.col("a") * share).alias("mean"), var.alias("var"))
    shown = F.col("var") if digits is None else F.round("var", digits)
    best = top_k(stats.withColumn("_v", shown).filter("_v > 0"), ["fold"], [F.desc("_v"), F.asc("feature")], k, salt="feature")
    return best.select("fold", "feature", "mean", F.sqrt("var").alias("sd"))


def hvg_embeddings(values: DataFrame, bucketed: DataFrame, case: str, k: int = 5000, digits: int | None = None) -> DataFrame:
    """(sample, fold, features, embedding): each fold's k most variable training features, standardised, for every sample.

    A row begins as the standardised zeros of its fold; what a sample stores is
    added at its places. At most k entries of a sample and fold meet in a row.
    """
    chosen = stable(hvg_features(values, bucketed, case, k, digits))
    place = F.row_number().over(W.partitionBy("fold").orderBy("feature")) - 1  # k features a fold
    placed = chosen.withColumn("place", place)
    entry = F.struct("place", "feature", (-F.col("mean") / F.col("sd")).alias("zero"))
    folds = placed.groupBy("fold").agg(F.sort_array(F.collect_list(entry)).alias("_all"))
    folds = folds.select("fold", F.col("_all.feature").alias("features"), F.col("_all.zero").alias("_zeros"))
    stored = values.join(placed, "feature").groupBy("sample", "fold").agg(
        F.collect_list("place").alias("_at"), F.collect_list(F.col("value").cast("double") / F.col("sd")).alias("_add")
    )
    samples = bucketed.select(F.col(case).alias("sample")).distinct().withColumn("fold", F.explode(F.array(*[F.lit(f) for f in range(splits.N_FOLDS)])))
    met = samples.join(folds, "fold").join(stored, ["sample", "fold"], "left")

    @F.pandas_udf("array<double>")
    def filled(zeros: pd.Series, at: pd.Series, add: pd.Series) -> pd.Series:
        out = []
        for z, where, more in zip(zeros, at, add, strict=True):
            row = np.array(z, dtype=float)
            if where is not None:
                row[np.asarray(where, dtype=int)] += np.asarray(more, dtype=float)
            out.append(row)
        return pd.Series(out)

    return met.select("sample", F.col("fold").cast("tinyint").alias("fold"), "features", filled("_zeros", "_at", "_add").alias("embedding"))


def write_baseline(embedded: DataFrame, path: str, sample: str = "sample_index") -> None:
    """One partition folder per fold."""
    from tidyfold.sources.embeddings import write_embeddings

    write_embeddings(embedded, path, sample)


def pca_every_fold(rows: DataFrame, vector: str, k: int = 256) -> DataFrame:
    """Long-form PCA embeddings, fit once per fold on its training rows; `rows` carry a `bucket`.

    A fold trains on the parts of the other folds, so all five fits take their
    Lanczos steps in the same passes over rows keyed by part, and one pass
    embeds every row five times. The way is the same at every width.
    """
    folds = range(splits.N_FOLDS)
    slot = (F.col("bucket") % splits.FOLD_WIDTH >= splits.FOLD_WIDTH - splits.VAL_BUCKETS).cast("int")
    packed = pack(rows.filter(slot == 0), [vector], splits.fold_of(F.col("bucket")))
    fits = pca_axes(packed, vector, {f: [p for p in packed.keys if p != f] for f in folds}, k)
    each = fits[0][1].shape[1]
    flat = affine(rows, vector, np.zeros(packed.widths[vector]), np.hstack([fits[f][1] for f in folds]), "_flat").drop(vector)
    long = splits.every_fold(flat)
    shift = F.array(*[F.array(*[F.lit(float(v)) for v in fits[f][0] @ fits[f][1]]) for f in folds])
    mine = F.slice("_flat", F.col("fold") * each + 1, F.lit(each))
    return long.withColumn("embedding", F.zip_with(mine, F.get(shift, F.col("fold")), lambda x, c: x - c)).drop("_flat").withColumn(
        "fold", F.col("fold").cast("tinyint")
    )
