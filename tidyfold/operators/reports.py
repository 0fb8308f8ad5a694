"""The tables behind the cohort and score reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidyfold.functions.arrays import LIBRARY_SIZE
from tidyfold.operators.ordering import selected_quantiles


def log_normalize_tidy(values: DataFrame, sample: str, value: str = "value", library_size: float = LIBRARY_SIZE) -> DataFrame:
    """Tidy form of the library-size normalisation: sample totals joined back."""
    totals = values.groupBy(sample).agg(F.greatest(F.sum(value), F.lit(1.0)).alias("_total"))
    scaled = F.log1p(F.col(value) * F.lit(library_size) / F.col("_total"))
    return values.join(totals, sample).withColumn(value, scaled).drop("_total")


def cohort_by_project(samples: DataFrame, project: str, case: str, is_normal: Column) -> DataFrame:
    """Per project: samples, distinct cases and normals, largest first."""
    found = samples.groupBy(project).agg(
        F.count("*").alias("samples"), F.countDistinct(case).alias("cases"), F.sum(is_normal.cast("bigint")).alias("normals")
    )
    return found.orderBy(F.desc("samples"), project)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def per_case_histogram(samples: DataFrame, case: str) -> DataFrame:
    """(per_case, cases): how many cases have so many samples."""
    return samples.groupBy(case).agg(F.count("*").alias("per_case")).groupBy("per_case").agg(F.count("*").alias("cases"))


def mixed_cases(samples: DataFrame, case: str, kind: Column) -> DataFrame:
    """Cases with samples of both kinds."""
    found = samples.groupBy(case).agg(F.bool_or(kind).alias("_a"), F.bool_or(~kind).alias("_b"))
    return found.filter(F.col("_a") & F.col("_b")).select(case)


def bin_edges(df: DataFrame, value: str, step: float) -> DataFrame:
    """One row `lo`, `hi`, `bins`: edges on multiples of `step` covering the values."""
    lo = F.floor(F.min(value) / F.lit(step)) * F.lit(step)
    hi = F.greatest(F.ceil(F.max(value) / F.lit(step)) * F.lit(step), lo + F.lit(step))
    return df.agg(lo.alias("lo"), hi.alias("hi"), F.round((hi - lo) / F.lit(step)).cast("bigint").alias("bins"))


def histogram(df: DataFrame, value: str, step: float) -> DataFrame:
    """(bin, left, n, median) for every bin, empty ones included; the last bin is closed. `median` is the values', exact."""
    edges = bin_edges(df, value, step)
    lo, bins = edges.select("lo").scalar(), edges.select("bins").scalar()
    at = F.least(F.floor((F.col(value) - lo) / F.lit(step)), bins - 1)
    counts = df.filter(F.col(value).isNotNull()).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    every = edges.select("lo", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("bins") - 1)).alias("bin"))
    met = every.join(counts, "bin", "left")
    return met.select("bin", (F.col("lo") + F.col("bin") * F.lit(step)).alias("left"), F.coalesce("n", F.lit(0)).alias("n"), quantile_row(df, value, {"median": 0.5}).select("median").scalar().alias("median"))


def quantile_row(df: DataFrame, value: str, probs: Mapping[str, float]) -> DataFrame:
    """Exact quantiles of a whole column in one row."""
    return selected_quantiles(df, [], value, probs)


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: chi2, dof and p of independence of two columns; null under two rows or columns."""
    from pyspark.ml.feature import StringIndexer, VectorAssembler
    from pyspark.ml.stat import ChiSquareTest

    seen = df.agg(F.countDistinct(a).alias("ra"), F.countDistinct(b).alias("rb")).first()
    if min(seen["ra"], seen["rb"]) < 2:
        return df.sparkSession.createDataFrame([(None, None, None)], "chi2 double, dof bigint, p double")
    text = df.select(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    for c in ("a", "b"):
        text = StringIndexer(inputCol=c, outputCol=f"_{c}", stringOrderType="alphabetAsc").fit(text).transform(text)
    ready = VectorAssembler(inputCols=["_a"], outputCol="_v").transform(text)
    found = ChiSquareTest.test(ready, "_v", "_b", flatten=True)
    return found.select(F.col("statistic").alias("chi2"), F.col("degreesOfFreedom").cast("bigint").alias("dof"), F.col("pValue").alias("p"))


def chi_square_statistic(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: chi2 and dof from observed and expected counts."""
    cells = df.groupBy(a, b).agg(F.count("*").cast("double").alias("o"))
    rows = cells.groupBy(a).agg(F.sum("o").alias("r"))
    cols = cells.groupBy(b).agg(F.sum("o").alias("c"))
    n, k_a, k_b = (cells.agg(e).scalar() for e in (F.sum("o"), F.countDistinct(a), F.countDistinct(b)))
    # Σ (o - e)² / e over every cell is n (Σ o² / (r c) - 1); empty cells add nothing to the sum.
    met = cells.join(rows, a).join(cols, b)
    share = met.agg(F.sum(F.col("o") * F.col("o") / (F.col("r") * F.col("c"))).alias("s"))
    enough = (k_a >= 2) & (k_b >= 2)
    return share.select(
        F.when(enough, n * (F.col("s") - 1)).alias("chi2"), F.when(enough, (k_a - 1) * (k_b - 1)).alias("dof")
    )


def top_groups(df: DataFrame, group: str, size: Column, top: int = 9, other: str = "other") -> DataFrame:
    """(group, features, reads, share): the `top` groups by reads, the rest summed."""
    totals = df.groupBy(group).agg(F.count("*").alias("features"), F.sum(size).alias("reads"))
    best = totals.orderBy(F.desc("reads"), group).limit(top).select(group, F.lit(True).alias("_top"))
    named = totals.join(best, group, "left").withColumn(group, F.when(F.col("_top"), F.col(group)).otherwise(F.lit(other)))
    merged = named.groupBy(group).agg(F.sum("features").alias("features"), F.sum("reads").alias("reads"))
    return merged.withColumn("share", F.try_divide(F.col("reads"), totals.agg(F.sum("reads")).scalar()))


def detection_by_feature(values: DataFrame, n_samples: Column, feature: str = "feature", value: str = "value") -> DataFrame:
    """(feature, rate): share of samples with a positive value."""
    return values.groupBy(feature).agg((F.sum((F.col(value) > 0).cast("bigint")) / n_samples).alias("rate"))


def detection_by_sample(values: DataFrame, sample: str, value: str = "value") -> DataFrame:
    return values.groupBy(sample).agg(F.sum((F.col(value) > 0).cast("bigint")).alias("detected"))


def detection_extremes(values: DataFrame, features: DataFrame, n_samples: Column, feature: str = "feature", value: str = "value") -> DataFrame:
    """One row: features detected in every sample and in none."""
    rates = features.join(detection_by_feature(values, n_samples, feature, value), feature, "left")
    rate = F.coalesce("rate", F.lit(0.0))
    return rates.agg(F.sum((rate == 1).cast("bigint")).alias("always"), F.sum((rate == 0).cast("bigint")).alias("never"))


def fold_sizes(split_everywhere: DataFrame, case: str) -> DataFrame:
    """(fold, split, samples, cases)."""
    return split_everywhere.groupBy("fold", "split").agg(F.count("*").alias("samples"), F.countDistinct(case).alias("cases"))


def project_balance(cases: DataFrame, project: str, fold: str = "test_fold", n_folds: int = 5) -> DataFrame:
    """(project, fold0.., total, deviation): largest distance of a fold's cases from an even deal."""
    wide = cases.groupBy(project).pivot(fold, list(range(n_folds))).count().na.fill(0)
    counts = [F.col(str(k)) for k in range(n_folds)]
    total = sum(counts[1:], counts[0])
    gaps = F.greatest(*[F.abs(c - total / n_folds) for c in counts])
    return wide.select(project, *[c.alias(f"fold{k}") for k, c in enumerate(counts)], total.alias("total"), gaps.alias("deviation"))


def type_balance(samples: DataFrame, sample_type: str, fold: str = "test_fold", n_folds: int = 5, expected: int = 5) -> DataFrame:
    """Sample type x fold counts for types expected at least `expected` times per fold."""
    wide = samples.groupBy(sample_type).pivot(fold, list(range(n_folds))).count().na.fill(0)
    counts = [F.col(str(k)) for k in range(n_folds)]
    total = sum(counts[1:], counts[0])
    return wide.filter(total >= expected * n_folds).select(sample_type, *[c.alias(f"fold{k}") for k, c in enumerate(counts)])


def worked_examples(buckets: DataFrame, case: str, examples: Sequence) -> DataFrame:
    """A few cases' bucket, fold, rank and role in every fold."""
    from tidyfold.operators.splits import N_FOLDS, fold_of, split_of

    roles = F.concat_ws(",", *[split_of(F.col("bucket"), k) for k in range(N_FOLDS)])
    return buckets.filter(F.col(case).isin(*examples)).select(
        case, "rank", "size", "bucket", fold_of(F.col("bucket")).alias("fold"), roles.alias("roles")
    )


def constant_scores(samples: DataFrame, label: str) -> DataFrame:
    """One row of scores with no embedding at all: 1/k, the share of pairs alike, 0.5 and 0."""
    counts = samples.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").cast("double").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.agg(
        (1.0 / F.count("*")).alias("balanced_accuracy"), F.sum((F.col("n") / total) * (F.col("n") / total)).alias("precision"),
        F.lit(0.5).alias("c_index"), F.lit(0.0).alias("r2"),
    )


def majority(samples: DataFrame, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, share, classes): the largest class's share and how many classes there are."""
    counts = samples.filter(F.col(label).isNotNull()).groupBy(*keys, label).agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg((F.max("n") / F.sum("n")).alias("share"), F.count("*").alias("classes"))


def smallest_near_best(sweep: DataFrame, keys: Sequence[str], size: str, score: str, near: float = 0.01) -> DataFrame:
    """(keys, largest, score, enough): the score at the largest size, and the smallest size within `near` of it."""
    head = sweep.groupBy(*keys).agg(F.max(size).alias("largest"), F.max_by(score, size).alias("_head"))
    met = sweep.join(head, list(keys))
    return met.groupBy(*keys, "largest", F.col("_head").alias("score")).agg(
        F.min(F.when(F.abs(F.col(score) - F.col("_head")) <= near, F.col(size))).alias("enough")
    )


def spread(rows: DataFrame, pooled: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """How far single folds or redraws sit from the pooled score.

    `rows` has (keys, label, value), `pooled` (keys, value, lo, hi). Gives the
    worst label and its distance, how many lie outside the interval, and the
    deviation over the half-width.
    """
    met = rows.join(pooled.select(*keys, F.col("value").alias("_v"), "lo", "hi"), list(keys))
    gap = F.abs(F.col("value") - F.col("_v"))
    outside = (F.col("value") < F.col("lo")) | (F.col("value") > F.col("hi"))
    return met.groupBy(*keys).agg(
        F.max_by(label, F.struct(gap.alias("g"), label)).alias("worst"), F.max(gap).alias("distance"),
        F.sum(outside.cast("bigint")).alias("outside"),
        F.try_divide(F.stddev_samp("value"), (F.max("hi") - F.max("lo")) / 2).alias("ratio"),
    )


def metastasis_only(samples: DataFrame, case: str, project: str, metastatic: Column, primary: Column) -> DataFrame:
    """(project, cases): patients sampled at metastasis and never at the primary."""
    per_case = samples.groupBy(project, case).agg(F.bool_or(metastatic).alias("_m"), F.bool_or(primary).alias("_p"))
    return per_case.filter(F.col("_m") & ~F.col("_p")).groupBy(project).agg(F.count("*").alias("cases"))


def projects_side_by_side(scores: DataFrame, project: str, name: str, score: str, names: Sequence[str]) -> DataFrame:
    """A project's score under each embedding, sorted by the first."""
    wide = scores.groupBy(project).pivot(name, list(names)).agg(F.first(score))
    return wide.orderBy(F.desc_nulls_last(names[0]), project)


def difference_of(differences: DataFrame, metrics: DataFrame, key: str = "score") -> DataFrame:
    """Every metric's difference row; null where it kept no replicates."""
    return metrics.join(differences, key, "left")


def cohort_report(samples: DataFrame, bucketed: DataFrame, case: str, project: str, sample_type: str, normal: str,
                  examples: Sequence = ()) -> dict[str, DataFrame]:
    """Every table of the cohort report; all but the chi-square test are lazy."""
    from tidyfold.operators.splits import every_split, summarize_folds

    is_normal = F.col(sample_type) == normal
    cases = bucketed.select(case, project, "bucket", "test_fold").distinct()
    tables = {
        "projects": cohort_by_project(samples, project, case, is_normal),
        "sample_types": value_counts(samples, sample_type),
        "samples_per_case": per_case_histogram(samples, case),
        "mixed_cases": mixed_cases(samples, case, is_normal).agg(F.count("*").alias("cases")),
        "fold_sizes": fold_sizes(every_split(bucketed), case),
        "project_folds": summarize_folds(bucketed, project),
        "project_balance": project_balance(cases, project),
        "type_balance": type_balance(bucketed, sample_type),
        "type_by_fold": chi_square(bucketed, sample_type, "test_fold"),
    }
    if examples:
        tables["examples"] = cases.filter(F.col(case).isin(*examples))
    return tables


def score_report(scores: DataFrame, keys: Sequence[str], size: str, score: str, pooled: DataFrame, label: str) -> dict[str, DataFrame]:
    """The sweep over sizes and how far its rows spread around the pooled scores."""
    spread_rows = scores.withColumnRenamed(score, "value")
    return {"sweep": smallest_near_best(scores, keys, size, score), "spread": spread(spread_rows, pooled, keys, label)}
