"""Scores as grouped sums. Weighted forms carry a `replicate` key and weight `w`."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion(rows: DataFrame, true: str, pred: str, keys: Sequence[str] = (), weight: Column | None = None) -> DataFrame:
    """(keys, true, pred, w): weighted counts of pairs."""
    w = F.count("*").cast("double") if weight is None else F.sum(weight).cast("double")
    return rows.groupBy(*keys, F.col(true).alias("true"), F.col(pred).alias("pred")).agg(w.alias("w"))


def classification_scores(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """accuracy, balanced_accuracy, macro_f1, weighted_f1 per key from confusion cells.

    Recall averages over true classes, F1 over classes on either side. Each cell
    feeds its true and its predicted class, so the marginals cost one aggregate.
    """
    hit = F.when(F.col("true") == F.col("pred"), F.col("w")).otherwise(0.0)
    sides = F.array(
        F.struct(F.col("true").alias("c"), F.col("w").alias("support"), F.lit(0.0).alias("predicted"), hit.alias("tp")),
        F.struct(F.col("pred").alias("c"), F.lit(0.0).alias("support"), F.col("w").alias("predicted"), F.lit(0.0).alias("tp")),
    )
    by_class = (
        cells.select(*keys, F.explode(sides).alias("s"))
        .groupBy(*keys, "s.c")
        .agg(F.sum("s.support").alias("support"), F.sum("s.predicted").alias("predicted"), F.sum("s.tp").alias("tp"))
    )
    either = F.col("support") + F.col("predicted")
    f1 = F.when(either > 0, 2 * F.col("tp") / F.when(either > 0, either))
    recall = F.when(F.col("support") > 0, F.col("tp") / F.when(F.col("support") > 0, F.col("support")))
    return by_class.groupBy(*keys).agg(
        F.try_divide(F.sum("tp"), F.sum("support")).alias("accuracy"),
        F.avg(recall).alias("balanced_accuracy"),
        F.avg(f1).alias("macro_f1"),
        F.try_divide(F.sum(f1 * F.col("support")), F.sum("support")).alias("weighted_f1"),
    )


def clustering_agreement(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """nmi (arithmetic) and ari per key from (true, pred, w) contingency cells.

    Grouping sets give the cells, both marginals and the total in one pass;
    mutual information is H(true) + H(pred) - H(cells).
    """
    sides = F.array(
        F.struct(F.lit("cell").alias("kind"), F.col("true").cast("string").alias("a"), F.col("pred").cast("string").alias("b")),
        F.struct(F.lit("row").alias("kind"), F.col("true").cast("string").alias("a"), F.lit("").alias("b")),
        F.struct(F.lit("col").alias("kind"), F.lit("").alias("a"), F.col("pred").cast("string").alias("b")),
    )
    parts = cells.select(*keys, F.col("w"), F.explode(sides).alias("s")).groupBy(*keys, "s.kind", "s.a", "s.b").agg(F.sum("w").alias("w"))
    x = F.col("w")
    pairs = x * (x - 1) / 2
    xlnx = F.when(x > 0, x * F.ln(F.when(x > 0, x))).otherwise(0.0)

    def of(kind: str, v: Column) -> Column:
        return F.sum(F.when(F.col("kind") == kind, v).otherwise(0.0))

    sums = parts.groupBy(*keys).agg(
        of("row", x).alias("n"),
        *[of(k, pairs).alias(f"p_{k}") for k in ("cell", "row", "col")],
        *[of(k, xlnx).alias(f"l_{k}") for k in ("cell", "row", "col")],
    )
    n = F.col("n")
    expected = F.try_divide(F.col("p_row") * F.col("p_col"), n * (n - 1) / 2)
    ari = F.try_divide(F.col("p_cell") - expected, 0.5 * (F.col("p_row") + F.col("p_col")) - expected)
    entropy = {k: F.ln(n) - F.col(f"l_{k}") / n for k in ("cell", "row", "col")}
    nmi = F.try_divide(entropy["row"] + entropy["col"] - entropy["cell"], (entropy["row"] + entropy["col"]) / 2)
    return sums.select(*keys, nmi.alias("nmi"), ari.alias("ari"))


def target_r2(sums: DataFrame, target: str, keys: Sequence[str] = ()) -> DataFrame:
    """r2_pooled and the mean r2 per target, from (keys, target, ss_res, ss_tot) of centred targets."""
    each = 1 - F.try_divide(F.col("ss_res"), F.col("ss_tot"))
    return sums.groupBy(*keys).agg(
        (1 - F.try_divide(F.sum("ss_res"), F.sum("ss_tot"))).alias("r2_pooled"), F.avg(each).alias(f"r2_{target}")
    )


def squared_sums(true: str = "true", pred: str = "pred") -> dict[str, Column]:
    """ss_res and ss_tot of a target already centred on its baseline."""
    t, p = F.col(true).cast("double"), F.col(pred).cast("double")
    return {"ss_res": (t - p) * (t - p), "ss_tot": t * t}


def reconstruction_sums(rows: DataFrame, shift: DataFrame, feature: str = "feature", keys: Sequence[str] = (),
                        weight: Column | None = None) -> DataFrame:
    """(keys, feature, total, ss_res, first, second): sums that merge over row blocks.

    `shift` (feature, shift) is any constant near the feature's mean; it keeps
    SS_tot free of cancellation.
    """
    w = F.lit(1.0) if weight is None else weight
    t, p = F.col("true").cast("double"), F.col("pred").cast("double")
    c = t - F.col("shift")
    return rows.join(shift, feature).groupBy(*keys, feature).agg(
        F.sum(w).alias("total"), F.sum(w * (t - p) * (t - p)).alias("ss_res"), F.sum(w * c).alias("first"), F.sum(w * c * c).alias("second")
    )


def reconstruction_r2(sums: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """r2_pooled, and r2_gene averaged over features that vary."""
    tot = F.greatest(F.col("second") - F.col("first") * F.col("first") / F.col("total"), F.lit(0.0))
    varies = F.col("_tot") > 1e-9 * F.col("total")
    each = F.when(varies, 1 - F.col("ss_res") / F.when(varies, F.col("_tot")))
    return sums.withColumn("_tot", tot).groupBy(*keys).agg(
        (1 - F.try_divide(F.sum("ss_res"), F.sum("_tot"))).alias("r2_pooled"), F.avg(each).alias("r2_gene")
    )


def guarded_corr(a: str, b: str, constant: float | None = None) -> Column:
    """Pearson as an aggregate; null (or `constant`) on a constant side, where `corr` would raise.

    A side is constant when its extremes meet: its deviation may be a rounding error above 0.
    """
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    flat = (F.min(x) == F.max(x)) | (F.min(y) == F.max(y))
    r = F.when(~flat, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))
    return r if constant is None else F.coalesce(r, F.lit(constant))


def sample_pearson(rows: DataFrame, sample: str, constant: float | None = None) -> DataFrame:
    """(sample, r) between `true` and `pred` over a sample's features."""
    return rows.groupBy(sample).agg(guarded_corr("true", "pred", constant).alias("r"))


def reconstruction_scores(rows: DataFrame, sample: str, feature: str = "feature") -> DataFrame:
    """One row: r2_pooled, r2_gene, pearson_sample and pearson_sample_baseline.

    `rows` has (sample, feature, true, pred, baseline), every feature for every sample.
    """
    shift = rows.groupBy(feature).agg(F.avg("true").alias("shift"))
    r2 = reconstruction_r2(reconstruction_sums(rows, shift, feature))
    per_sample = rows.groupBy(sample).agg(
        guarded_corr("true", "pred").alias("r"), guarded_corr("true", "baseline").alias("r0")
    )
    means = per_sample.agg(F.avg("r").alias("pearson_sample"), F.avg("r0").alias("pearson_sample_baseline"))
    return r2.withColumn("_k", F.lit(0)).join(means.withColumn("_k", F.lit(0)), "_k").drop("_k")


def holdout_metrics(rows: DataFrame, sample: str, loss: Column) -> DataFrame:
    """One row: mean loss on visible and held-out entries, mean per-sample Pearson and R2 on held-out ones.

    `rows` has (sample, true, pred, visible). Constant samples are left out.
    """
    marked = rows.withColumn("_loss", loss)
    hidden = ~F.col("visible")
    t, p = F.when(hidden, F.col("true").cast("double")), F.when(hidden, F.col("pred").cast("double"))
    per = marked.withColumn("_t", t).withColumn("_p", p).groupBy(sample).agg(
        F.sum(F.when(F.col("visible"), F.col("_loss"))).alias("_vs"), F.sum(F.col("visible").cast("bigint")).alias("_vn"),
        F.sum(F.when(hidden, F.col("_loss"))).alias("_hs"), F.sum(hidden.cast("bigint")).alias("_hn"),
        guarded_corr("_t", "_p").alias("_r"),
        F.sum((F.col("_t") - F.col("_p")) * (F.col("_t") - F.col("_p"))).alias("_res"),
        F.when(F.min("_t") != F.max("_t"), F.var_pop("_t") * F.count("_t")).alias("_tot"),
    )
    return per.agg(
        F.try_divide(F.sum("_vs"), F.sum("_vn").cast("double")).alias("loss_visible"),
        F.try_divide(F.sum("_hs"), F.sum("_hn").cast("double")).alias("loss_heldout"),
        F.avg("_r").alias("pearson_heldout"),
        F.avg(1 - F.try_divide(F.col("_res"), F.col("_tot"))).alias("r2_heldout"),
    )


def poisson_loss(pred: Column, true: Column) -> Column:
    """e^p - p e^t, both in log space."""
    return F.exp(pred) - pred * F.exp(true)


def masked_mse(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    gap = F.col("pred") - F.col("true")
    return rows.groupBy(*keys).agg(F.avg(F.when(F.col("mask"), gap * gap)).alias("mse"))


def masked_accuracy(rows: DataFrame, keys: Sequence[str] = (), ignore: int = -100) -> DataFrame:
    """Share of masked tokens predicted right."""
    hit = F.when(F.col("label") != ignore, (F.col("pred") == F.col("label")).cast("double"))
    return rows.groupBy(*keys).agg(F.avg(hit).alias("accuracy"))


def mean_vectors(rows: DataFrame, keys: Sequence[str], vector: str, out: str = "pooled") -> DataFrame:
    """Elementwise mean of array<double> vectors per key, as one JVM aggregate."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    doubles = F.transform(vector, lambda x: x.cast("double"))
    found = rows.groupBy(*keys).agg(Summarizer.mean(array_to_vector(doubles)).alias("_m"))
    return found.select(*keys, vector_to_array("_m").alias(out))


def sum_vectors(rows: DataFrame, keys: Sequence[str], vector: str, out: str = "total") -> DataFrame:
    """Elementwise sum of vectors per key, with the row count `n`."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    doubles = F.transform(vector, lambda x: x.cast("double"))
    found = rows.groupBy(*keys).agg(Summarizer.sum(array_to_vector(doubles)).alias("_s"), F.count("*").alias("n"))
    return found.select(*keys, vector_to_array("_s").alias(out), "n")


def max_vectors(rows: DataFrame, keys: Sequence[str], vector: str, out: str = "pooled") -> DataFrame:
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    doubles = F.transform(vector, lambda x: x.cast("double"))
    found = rows.groupBy(*keys).agg(Summarizer.max(array_to_vector(doubles)).alias("_m"))
    return found.select(*keys, vector_to_array("_m").alias(out))


def pool_windows(samples: DataFrame, windows: DataFrame, sample: str, vector: str, dims: int) -> DataFrame:
    """Every sample's mean window vector; a zero vector where it has none."""
    pooled = mean_vectors(windows, [sample], vector)
    zeros = F.array_repeat(F.lit(0.0), dims)
    return samples.select(sample).join(pooled, sample, "left").withColumn("pooled", F.coalesce("pooled", zeros))
