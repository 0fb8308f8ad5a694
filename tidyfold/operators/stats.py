"""Per-feature statistics, scalers, rankers and tokenizers, fit on training rows.

Input is tidy: (sample, feature, value). Zeros may be left out, so every fit is
told how many training samples there are and counts the missing ones as zeros.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidyfold.operators.ordering import selected_quantiles, top_k
from tidyfold.session import stable


def count_of(samples: DataFrame) -> Column:
    """The number of rows, as a scalar subquery."""
    return samples.agg(F.count("*")).scalar()


def reciprocal(x: Column) -> Column:
    """1/x where x > 0, else 0."""
    return F.when(x > 0, 1.0 / F.when(x > 0, x)).otherwise(0.0)


def feature_stats(train: DataFrame, n_samples: Column | int, feature: str = "feature", value: str = "value") -> DataFrame:
    """mean, var_pop, sd_pop, sd_samp, low, high, norm, detected count per feature.

    One hash aggregate with map-side partials. The variance of the stored
    entries and of the implied zeros are pooled, so nothing large cancels.
    """
    n = n_samples if isinstance(n_samples, Column) else F.lit(n_samples)
    v = F.col(value).cast("double")
    stored = train.groupBy(feature).agg(
        F.count("*").alias("_m"), F.avg(v).alias("_mean"), F.var_pop(v).alias("_var"), F.min(v).alias("_min"),
        F.max(v).alias("_max"), F.sum(v).alias("total"), F.sum(v * v).alias("_sq"),
        F.sum((v > 0).cast("bigint")).alias("n_detected"),
    )
    stored = stored.withColumn("n", n.cast("bigint"))
    share = F.col("_m") / F.col("n")
    var = share * F.col("_var") + F.col("_mean") * F.col("_mean") * share * (1 - share)
    sparse = F.col("_m") < F.col("n")
    return stored.select(
        feature,
        "n",
        "n_detected",
        "total",
        (F.col("_mean") * share).alias("mean"),
        var.alias("var_pop"),
        F.sqrt(var).alias("sd_pop"),
        F.when(F.col("n") > 1, F.sqrt(var * F.col("n") / F.when(F.col("n") > 1, F.col("n") - 1))).alias("sd_samp"),
        F.when(sparse, F.least(F.col("_min"), F.lit(0.0))).otherwise(F.col("_min")).alias("low"),
        F.when(sparse, F.greatest(F.col("_max"), F.lit(0.0))).otherwise(F.col("_max")).alias("high"),
        F.sqrt("_sq").alias("norm"),
    )


IDF_SCHEMES = ("count", "smooth", "entropy")


def inverse_document_frequency(
    train: DataFrame, n_samples: Column | int, scheme: str = "entropy", threshold: float = 0.0,
    feature: str = "feature", value: str = "value",
) -> DataFrame:
    """(feature, idf): how rare a feature is over the training samples.

    entropy: ln N minus the entropy of the feature's mass over samples, which is
    ln T - sum(v ln v) / T, so one aggregate suffices.
    """
    n = (n_samples if isinstance(n_samples, Column) else F.lit(n_samples)).cast("double")
    v = F.col(value).cast("double")
    agg = train.groupBy(feature).agg(
        F.sum((v > threshold).cast("bigint")).alias("_seen"),
        F.sum(F.when(v > 0, v)).alias("_total"),
        F.sum(F.when(v > 0, v * F.ln(F.when(v > 0, v)))).alias("_vlnv"),
    )
    if scheme == "count":
        idf = F.ln(n / F.greatest(F.col("_seen"), F.lit(1)))
    elif scheme == "smooth":
        idf = F.ln((1 + n) / (1 + F.col("_seen"))) + 1
    elif scheme == "entropy":
        entropy = F.ln("_total") - F.try_divide(F.col("_vlnv"), F.col("_total"))
        idf = F.greatest(F.ln(n) - entropy, F.lit(0.0))
    else:
        raise ValueError(f"unknown scheme {scheme!r}; expected one of {IDF_SCHEMES}")
    return agg.select(feature, F.when(F.col("_total") > 0, idf).otherwise(0.0).alias("idf"))


RANKERS = ("expression", "z", "tfidf", "cohort_l2")


def fit_ranker(
    train: DataFrame, n_samples: Column | int, kind: str = "tfidf", scheme: str = "entropy",
    feature: str = "feature", value: str = "value",
) -> DataFrame:
    """(feature, offset, weight) of a ranker; its score is (x - offset) * weight."""
    if kind == "tfidf":
        idf = inverse_document_frequency(train, n_samples, scheme, 0.0, feature, value)
        return idf.select(feature, F.lit(0.0).alias("offset"), F.col("idf").alias("weight"))
    stats = feature_stats(train, n_samples, feature, value)
    if kind == "expression":
        return stats.select(feature, F.lit(0.0).alias("offset"), F.lit(1.0).alias("weight"))
    if kind == "z":
        return stats.select(feature, F.col("mean").alias("offset"), reciprocal(F.col("sd_pop")).alias("weight"))
    if kind == "cohort_l2":
        return stats.select(feature, F.lit(0.0).alias("offset"), reciprocal(F.col("norm")).alias("weight"))
    raise ValueError(f"unknown ranker {kind!r}; expected one of {RANKERS}")


def ranker_scores(rows: DataFrame, ranker: DataFrame, feature: str = "feature", value: str = "value",
                  digits: int | None = None) -> DataFrame:
    """Rows with `score`; Catalyst broadcasts the ranker while its measured size allows."""
    score = (F.col(value) - F.col("offset")) * F.col("weight")
    scored = rows.join(ranker, feature).withColumn("score", score if digits is None else F.round(score, digits))
    return scored.drop("offset", "weight")


def fit_tokenizer(train: DataFrame, value: str = "value") -> DataFrame:
    """One row `v_max`: the largest training value; none above 0 fails the job."""
    top = train.agg(F.max(value).alias("v_max"))
    bad = F.raise_error(F.lit("the training values hold nothing above 0")).cast("double")
    return top.select(F.when(F.col("v_max") > 0, F.col("v_max").cast("double")).otherwise(bad).alias("v_max"))


def token(value: Column, v_max: Column, n_bins: int) -> Column:
    """0 for an exact zero, else ceil(v / max * (n - 1)) clipped to the bins, in float32 as trained models expect."""
    scaled = (value.cast("float") / v_max.cast("float")).cast("float") * F.lit(n_bins - 1).cast("float")
    bin_ = F.ceil(scaled.cast("float"))
    return F.least(F.greatest(bin_, F.lit(0)), F.lit(n_bins - 1)).cast("bigint")


def tokens(rows: DataFrame, tokenizer: DataFrame, n_bins: int, value: str = "value") -> DataFrame:
    return rows.withColumn("token", token(F.col(value), tokenizer.scalar(), n_bins))


def median_absolute_deviation(train: DataFrame, n_samples: Column | int, feature: str = "feature", value: str = "value") -> DataFrame:
    """(feature, median, mad), exact, implied zeros counted; all features in the same passes. Values and medians are written once."""
    n = n_samples if isinstance(n_samples, Column) else F.lit(n_samples)
    counted = train.groupBy(feature, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_w"))
    written = stable(counted)
    zeros = written.groupBy(feature).agg((n - F.sum("_w")).alias("_w")).filter(F.col("_w") > 0)
    grid = written.unionByName(zeros.select(feature, F.lit(0.0).alias("_v"), "_w"))
    medians = stable(selected_quantiles(grid, [feature], "_v", {"median": 0.5}, F.col("_w")))
    gaps = grid.join(medians, feature).withColumn("_gap", F.abs(F.col("_v") - F.col("median")))
    return medians.join(selected_quantiles(gaps, [feature], "_gap", {"mad": 0.5}, F.col("_w")), feature)


def top_features(stats: DataFrame, by: str, k: int, feature: str = "feature") -> DataFrame:
    """The k features of largest `by`, ties to the earlier feature, in feature order."""
    best = stats.orderBy(F.desc(by), feature).limit(k)
    return best.orderBy(feature)


def top_by_mad(train: DataFrame, n_samples, k: int, feature: str = "feature", value: str = "value") -> DataFrame:
    return top_features(median_absolute_deviation(train, n_samples, feature, value), "mad", k, feature)


SCALINGS = ("minmax", "zscore", "zscore_sample", "none")


def fit_scaler(stats: DataFrame, scaling: str, feature: str = "feature", clip: bool = True) -> DataFrame:
    """(feature, offset, scale, clip_low, clip_high) from `feature_stats`; constants get scale 1.

    minmax clips to [0, 1]; the z-scores clip to the scaled training range;
    zscore_sample divides by the n - 1 deviation and needs two rows.
    """
    if scaling == "minmax":
        offset, scale = F.col("low"), F.col("high") - F.col("low")
    elif scaling == "zscore":
        offset, scale = F.col("mean"), F.col("sd_pop")
    elif scaling == "zscore_sample":
        few = F.raise_error(F.lit("a sample deviation needs at least two training rows")).cast("double")
        offset, scale = F.col("mean"), F.when(F.col("n") < 2, few).otherwise(F.col("sd_samp"))
    elif scaling == "none":
        offset, scale = F.lit(0.0), F.lit(1.0)
    else:
        raise ValueError(f"unknown scaling {scaling!r}; expected one of {SCALINGS}")
    safe = F.when(scale > 0, scale).otherwise(1.0)
    low, high = (F.col("low") - offset) / safe, (F.col("high") - offset) / safe
    if scaling == "minmax":
        low, high = F.lit(0.0), F.lit(1.0)
    if not clip or scaling == "none":
        low = high = F.lit(None).cast("double")
    return stats.select(
        feature, offset.alias("offset"), safe.alias("scale"), low.alias("clip_low"), high.alias("clip_high")
    )


def varying(stats: DataFrame) -> DataFrame:
    """Features that vary over the training rows."""
    return stats.filter(F.col("var_pop") > 0)


def subset(table: DataFrame, features: DataFrame, feature: str = "feature") -> DataFrame:
    """A fitted table restricted to some features."""
    return table.join(features.select(feature), feature, "left_semi")


def with_zeros(rows: DataFrame, samples: DataFrame, features: DataFrame, sample: str, feature: str = "feature", value: str = "value") -> DataFrame:
    """(sample, feature, value) for every sample and feature; what isn't stored is 0."""
    listed = features.agg(F.sort_array(F.collect_set(feature)).alias("_all")).scalar()
    grid = samples.select(sample).distinct().withColumn(feature, F.explode(listed))
    return grid.join(rows.select(sample, feature, value), [sample, feature], "left").withColumn(value, F.coalesce(F.col(value), F.lit(0)))


def scale(rows: DataFrame, scaler: DataFrame, feature: str = "feature", value: str = "value", samples: DataFrame | None = None,
          sample: str = "sample") -> DataFrame:
    """Rows of the scaler's features with `scaled`.

    A zero that isn't stored has a scaled value too: give `samples`, all
    samples, to have every sample x feature; without it stored rows only.
    """
    if samples is not None:
        rows = with_zeros(rows, samples, scaler, sample, feature, value)
    z = (F.col(value) - F.col("offset")) / F.col("scale")
    # least and greatest skip nulls, so an unclipped scaler passes through.
    bounded = F.least(F.greatest(z, F.col("clip_low")), F.col("clip_high"))
    return rows.join(scaler, feature).withColumn("scaled", bounded).drop("offset", "scale", "clip_low", "clip_high")


def mean_profile(train: DataFrame, n_samples: Column | int, feature: str = "feature", value: str = "value",
                 linear: bool = False) -> DataFrame:
    """(feature, mean) baseline predictor; `linear` undoes a log1p first."""
    v = F.expm1(value) if linear else F.col(value)
    return feature_stats(train.withColumn(value, v), n_samples, feature, value).select(feature, "mean")


def centre_by_group(rows: DataFrame, keys: list[str], reference: Column, columns: list[str]) -> DataFrame:
    """`columns` minus their mean over the key's reference rows; null where the key has none.

    Aggregate then join back: a hot key is pre-aggregated, never windowed.
    """
    means = rows.groupBy(*keys).agg(*[F.avg(F.when(reference, F.col(c))).alias(f"_mean_{c}") for c in columns])
    joined = rows.join(means, keys, "left")
    for c in columns:
        joined = joined.withColumn(c, F.col(c) - F.col(f"_mean_{c}"))
    return joined.drop(*[f"_mean_{c}" for c in columns])


def hvg_features(stats: DataFrame, k: int = 5000, feature: str = "feature") -> DataFrame:
    """The k most variable features, constants never chosen, in feature order."""
    return top_features(varying(stats), "var_pop", k, feature)


def hvg_scores(rows: DataFrame, stats: DataFrame, k: int = 5000, feature: str = "feature", value: str = "value",
               samples: DataFrame | None = None, sample: str = "sample") -> DataFrame:
    """Standardised values of the most variable features, tidy; of all `samples` if they are given."""
    return scale(rows, fit_scaler(hvg_features(stats, k, feature), "zscore", feature, clip=False), feature, value, samples, sample)


def ordered_top(scored: DataFrame, sample: str, k: int, feature: str = "feature") -> DataFrame:
    """A sample's k best features with `rank` from 1; ties to the earlier feature."""
    return top_k(scored, [sample], [F.desc("score"), F.asc(feature)], k, salt=feature)
