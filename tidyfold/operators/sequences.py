"""Ranked sentences, windows over them, and token masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidyfold.functions.arrays import pad
from tidyfold.functions.hashing import choice, draw, uniform
from tidyfold.operators.stats import ordered_top

IGNORE = -100


def sentences(scored: DataFrame, detected: DataFrame, sample: str, max_genes: int, pad_id: int,
              feature: str = "feature", value: str = "value", samples: DataFrame | None = None) -> DataFrame:
    """(sample, genes, length): expressed, train-detected features in rank order, padded to max_genes.

    The list is as long as max_genes at most, which bounds the row. `samples`
    names all samples: those without such a feature are all padding, of length 0.
    """
    kept = scored.filter(F.col(value) > 0).join(detected.select(feature), feature, "left_semi")
    ranked = ordered_top(kept, sample, max_genes, feature)
    listed = ranked.groupBy(sample).agg(F.sort_array(F.collect_list(F.struct("rank", feature))).alias("_l"))
    if samples is not None:
        listed = samples.select(sample).distinct().join(listed, sample, "left").withColumn("_l", F.coalesce("_l", F.array().cast(listed.schema["_l"].dataType)))
    genes = F.transform("_l", lambda s: s[feature].cast("bigint"))
    return listed.select(sample, pad(genes, max_genes, pad_id).alias("genes"), F.size("_l").cast("bigint").alias("length"))


def n_windows(length: Column, window: int, stride: int) -> Column:
    """1 + ceil((n - window) / stride), at least 1; 0 for an empty sentence."""
    extra = F.ceil(F.greatest(length - window, F.lit(0)) / F.lit(float(stride)))
    return F.when(length > 0, 1 + extra).otherwise(0).cast("bigint")


def window_at(genes: Column, length: Column, start: Column, window: int, pad_id: int) -> Column:
    """`window` genes from `start` (from 0); past the end is padding."""
    return pad(F.slice(F.slice(genes, 1, length.cast("int")), (start + 1).cast("int"), window), window, pad_id)


def all_windows(df: DataFrame, window: int, stride: int, pad_id: int) -> DataFrame:
    """One row per window with its `window_index` and padded `window`."""
    count = n_windows(F.col("length"), window, stride)
    numbered = df.filter(F.col("length") > 0).withColumn("window_index", F.explode(F.sequence(F.lit(0), (count - 1).cast("int"))))
    start = F.col("window_index") * stride
    return numbered.withColumn("window", window_at(F.col("genes"), F.col("length"), start, window, pad_id))


def sample_windows(df: DataFrame, sample: str, window: int, stride: int, pad_id: int, seed: int = 0,
                   hash_fn: str = "xxhash64") -> DataFrame:
    """One uniform window per non-empty sentence."""
    count = n_windows(F.col("length"), window, stride)
    chosen = choice(seed, count, F.col(sample), hash_fn=hash_fn)
    picked = df.filter(F.col("length") > 0).withColumn("window_index", chosen)
    return picked.withColumn(
        "window", window_at(F.col("genes"), F.col("length"), F.col("window_index") * stride, window, pad_id)
    )


def mask_token(token: Column, ids: list, mask_id: int, n_bins: int, mask_prob: float = 0.15, seed: int = 0,
               pad_id: int | None = None, hash_fn: str = "xxhash64") -> tuple[Column, Column]:
    """(masked token, label): of the chosen tokens 80% become mask, 10% a random bin, 10% stay.

    The label is the token where chosen and -100 elsewhere. Padding is never chosen.
    """
    u = uniform(seed, *ids, hash_fn=hash_fn)
    hit = u < mask_prob if pad_id is None else (u < mask_prob) & (token != pad_id)
    other = F.pmod(draw(seed + 1, *ids, hash_fn=hash_fn), F.lit(n_bins)).cast("bigint")
    masked = (
        F.when(~hit, token)
        .when(u < 0.8 * mask_prob, F.lit(mask_id).cast("bigint"))
        .when(u < 0.9 * mask_prob, other)
        .otherwise(token)
    )
    return masked, F.when(hit, token).otherwise(F.lit(IGNORE).cast("bigint"))


def mask_array(tokens: Column, row_id: Column, mask_id: int, n_bins: int, mask_prob: float = 0.15, seed: int = 0,
               pad_id: int | None = None, hash_fn: str = "xxhash64") -> Column:
    """`mask_token` over an array: structs of `token` and `label` in position order."""

    def one(token, i):
        masked, label = mask_token(token, [row_id, i], mask_id, n_bins, mask_prob, seed, pad_id, hash_fn)
        return F.struct(masked.alias("token"), label.alias("label"))

    return F.transform(tokens, one)


def positions(df: DataFrame, arrays: str, keep: list[str]) -> DataFrame:
    """One row per array position."""
    return df.select(*keep, F.posexplode(arrays).alias("position", "token"))
