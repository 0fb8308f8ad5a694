"""Training-only statistics, scalers, rankers, tokenizers and baselines over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidyfold.operators import ordering, selection, splits, stats
from tidyfold.plans import roles
from tidyfold.plans.registry import query
from tidyfold.plans.roles import SQL_BUCKETS, SQL_STATS, SQL_VALUES

BASE = "WITH " + SQL_BUCKETS.strip() + "," + SQL_VALUES
WITH_STATS = BASE + "," + SQL_STATS


def train(t):
    return roles.split_values(t).filter("split = 'train'")


def feature_stats(t):
    return stats.feature_stats(train(t), roles.train_count(t))


@query("stats_features", WITH_STATS + """ SELECT feature, n::BIGINT AS n, n_detected, total, round(mean, 6) AS mean, round(var_pop, 6) AS var_pop,
    round(sd_samp, 6) AS sd_samp, low, high, round(norm, 6) AS norm FROM stats""")
def stats_features(t):
    return feature_stats(t).select(
        "feature", "n", "n_detected", "total", *[F.round(c, 6).alias(c) for c in ("mean", "var_pop", "sd_samp")], "low", "high",
        F.round("norm", 6).alias("norm"),
    )


@query("stats_reciprocal", WITH_STATS + " SELECT feature, round(CASE WHEN sd_pop > 0 THEN 1 / sd_pop ELSE 0 END, 6) AS weight FROM stats")
def stats_reciprocal(t):
    return feature_stats(t).select("feature", F.round(stats.reciprocal(F.col("sd_pop")), 6).alias("weight"))


IDF_SQL = BASE + """, agg AS (SELECT feature, count(*) FILTER (value > 10) AS seen, sum(value) AS total,
    sum(CASE WHEN value > 0 THEN value * ln(value) END) AS vl FROM sv WHERE split = 'train' GROUP BY 1)
    SELECT feature, round(IDF, 6) AS idf FROM agg, ntrain"""


@query("stats_idf_count", IDF_SQL.replace("IDF,", "ln(n / greatest(seen, 1)),"))
def stats_idf_count(t):
    return stats.inverse_document_frequency(train(t), roles.train_count(t), "count", 10.0).withColumn("idf", F.round("idf", 6))


@query("stats_idf_smooth", IDF_SQL.replace("IDF,", "ln((1.0::DOUBLE + n) / (1 + seen)) + 1,"))
def stats_idf_smooth(t):
    return stats.inverse_document_frequency(train(t), roles.train_count(t), "smooth", 10.0).withColumn("idf", F.round("idf", 6))


ENTROPY_SQL = """share AS (SELECT v.feature, v.value / s.total AS p FROM sv v JOIN
    (SELECT feature, sum(value) AS total FROM sv WHERE split = 'train' GROUP BY 1) s USING (feature) WHERE split = 'train'),
    idf AS (SELECT feature, greatest(ln(max(n)) + sum(p * ln(p)), 0) AS idf FROM share, ntrain GROUP BY 1)"""


@query("stats_idf_entropy", BASE + ", " + ENTROPY_SQL + " SELECT feature, round(idf, 6) AS idf FROM idf")
def stats_idf_entropy(t):
    return stats.inverse_document_frequency(train(t), roles.train_count(t), "entropy").withColumn("idf", F.round("idf", 6))


def ranker_sql(offset: str, weight: str) -> str:
    return WITH_STATS + f" SELECT feature, round({offset}, 6) AS offset, round({weight}, 6) AS weight FROM stats"


for _kind, _offset, _weight in (
    ("expression", "0.0", "1.0"), ("z", "mean", "CASE WHEN sd_pop > 0 THEN 1 / sd_pop ELSE 0 END"),
    ("cohort_l2", "0.0", "CASE WHEN norm > 0 THEN 1 / norm ELSE 0 END"),
):

    @query(f"rank_fit_{_kind}", ranker_sql(_offset, _weight))
    def rank_fit(t, kind=_kind):
        fitted = stats.fit_ranker(train(t), roles.train_count(t), kind)
        return fitted.select("feature", F.round("offset", 6).alias("offset"), F.round("weight", 6).alias("weight"))


def scored(t):
    ranker = stats.fit_ranker(train(t), roles.train_count(t), "tfidf", "entropy")
    return stats.ranker_scores(roles.values(t), ranker, digits=6)


SCORED_SQL = BASE + ", " + ENTROPY_SQL + ", scored AS (SELECT sample, feature, value, round(value * idf, 6) AS score FROM vals JOIN idf USING (feature))"


@query("rank_scores", SCORED_SQL + " SELECT sample, feature, score FROM scored")
def rank_scores(t):
    return scored(t).select("sample", "feature", "score")


@query("rank_top_by_rarity", SCORED_SQL + """ SELECT sample, feature, score, rank::INT AS rank FROM (SELECT sample, feature, score,
    row_number() OVER (PARTITION BY sample ORDER BY score DESC, feature) AS rank FROM scored) WHERE rank <= 5""")
def rank_top_by_rarity(t):
    return stats.ordered_top(scored(t), "sample", 5).select("sample", "feature", "score", "rank")


@query("rank_full_order", """WITH v AS (SELECT o_custkey AS sample, l_partkey AS feature, sum(l_quantity) AS score
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)
    SELECT sample, feature, (row_number() OVER (PARTITION BY sample ORDER BY score DESC, feature) - 1)::BIGINT AS rank FROM v""")
def rank_full_order(t):
    rows = roles.values(t).withColumnRenamed("value", "score")
    ranked = ordering.row_order(rows, ["sample"], "score", "feature")
    return ranked.select("sample", "feature", F.col("rank").cast("bigint").alias("rank"))


@query("token_fit", BASE + " SELECT max(value) AS v_max FROM sv WHERE split = 'train'")
def token_fit(t):
    return stats.fit_tokenizer(train(t))


@query("token_bins", BASE + """ SELECT sample, feature, least(greatest(ceil((value::FLOAT / (SELECT max(value)::FLOAT FROM sv WHERE split = 'train')) * 63::FLOAT), 0), 63)::BIGINT AS token FROM vals""")
def token_bins(t):
    return stats.tokens(roles.values(t), stats.fit_tokenizer(train(t)), 64).select("sample", "feature", "token")


def coarse_split(t, fold: int = 0):
    split = splits.with_split(roles.bucketed(t), fold).select(F.col("case_id").alias("sample"), "project", "split")
    return roles.coarse_values(t).join(split, "sample")


def coarse_train(t):
    return coarse_split(t).filter("split = 'train'")


BRAND_SQL = BASE + """, brand AS (SELECT sample, p_brand AS feature, sum(value) AS value, split FROM sv JOIN part ON p_partkey = feature GROUP BY 1, 2, 4),
    grid AS (SELECT s.case_id AS sample, b.feature, coalesce(v.value, 0) AS value FROM split0 s
    CROSS JOIN (SELECT DISTINCT p_brand AS feature FROM part) b LEFT JOIN brand v ON v.sample = s.case_id AND v.feature = b.feature WHERE s.split = 'train'),
    med AS (SELECT feature, median(value) AS median FROM grid GROUP BY 1),
    mad AS (SELECT feature, max(m.median) AS median, median(abs(value - m.median)) AS mad FROM grid JOIN med m USING (feature) GROUP BY 1)"""


def brand_values(t):
    part = t.part.select(F.col("p_partkey").alias("feature"), "p_brand")
    return roles.split_values(t).join(part, "feature").groupBy("sample", F.col("p_brand").alias("feature"), "split").agg(F.sum("value").alias("value"))


def brand_train(t):
    return brand_values(t).filter("split = 'train'")


@query("stats_mad_brands", BRAND_SQL + " SELECT feature, median, mad FROM mad")
def stats_mad_brands(t):
    return stats.median_absolute_deviation(brand_train(t), roles.train_count(t))


@query("stats_top_by_mad", BRAND_SQL + " SELECT feature, mad FROM (SELECT feature, mad FROM mad ORDER BY mad DESC, feature LIMIT 8)")
def stats_top_by_mad(t):
    return stats.top_by_mad(brand_train(t), roles.train_count(t), 8).select("feature", "mad")


SCALER_SQL = {
    "minmax": ("low", "CASE WHEN high - low > 0 THEN high - low ELSE 1 END"),
    "zscore": ("mean", "CASE WHEN sd_pop > 0 THEN sd_pop ELSE 1 END"),
    "zscore_sample": ("mean", "CASE WHEN sd_samp > 0 THEN sd_samp ELSE 1 END"),
}
for _scaling, (_offset, _scale) in SCALER_SQL.items():

    @query(f"scale_fit_{_scaling}", WITH_STATS + f" SELECT feature, round({_offset}, 6) AS offset, round({_scale}, 6) AS scale FROM stats")
    def scale_fit(t, scaling=_scaling):
        fitted = stats.fit_scaler(feature_stats(t), scaling)
        return fitted.select("feature", F.round("offset", 6).alias("offset"), F.round("scale", 6).alias("scale"))

    _low, _high = ("0.0", "1.0") if _scaling == "minmax" else (f"(low - {_offset}) / ({_scale})", f"(high - {_offset}) / ({_scale})")

    @query(f"scale_apply_{_scaling}", WITH_STATS + f""" SELECT sample, feature,
        round(least(greatest((value - {_offset}) / ({_scale}), {_low}), {_high}), 6) AS scaled FROM vals JOIN stats USING (feature)""")
    def scale_apply(t, scaling=_scaling):
        done = stats.scale(roles.values(t), stats.fit_scaler(feature_stats(t), scaling))
        return done.select("sample", "feature", F.round("scaled", 6).alias("scaled"))


@query("scale_minmax_unclipped", WITH_STATS + """ SELECT sample, feature,
    round((value - low) / CASE WHEN high - low > 0 THEN high - low ELSE 1 END, 6) AS scaled FROM vals JOIN stats USING (feature)""")
def scale_minmax_unclipped(t):
    done = stats.scale(roles.values(t), stats.fit_scaler(feature_stats(t), "minmax", clip=False))
    return done.select("sample", "feature", F.round("scaled", 6).alias("scaled"))


@query("scale_varying", WITH_STATS + " SELECT feature FROM stats WHERE round(var_pop, 9) > 0")
def scale_varying(t):
    return stats.varying(feature_stats(t)).select("feature")


@query("scale_subset", WITH_STATS + """ SELECT feature, round(mean, 6) AS offset FROM stats
    WHERE feature IN (SELECT p_partkey FROM part WHERE p_type = 'SMALL')""")
def scale_subset(t):
    small = t.part.filter("p_type = 'SMALL'").select(F.col("p_partkey").alias("feature"))
    return stats.subset(stats.fit_scaler(feature_stats(t), "zscore"), small).select("feature", F.round("offset", 6).alias("offset"))


@query("scale_range", WITH_STATS + """ SELECT feature, round((low - mean) / CASE WHEN sd_pop > 0 THEN sd_pop ELSE 1 END, 6) AS clip_low,
    round((high - mean) / CASE WHEN sd_pop > 0 THEN sd_pop ELSE 1 END, 6) AS clip_high FROM stats""")
def scale_range(t):
    fitted = stats.fit_scaler(feature_stats(t), "zscore")
    return fitted.select("feature", F.round("clip_low", 6).alias("clip_low"), F.round("clip_high", 6).alias("clip_high"))


@query("stats_mean_profile", BASE + """ SELECT feature, round(sum(exp(value / 100) - 1) / max(n), 6) AS mean FROM sv, ntrain WHERE split = 'train' GROUP BY 1""")
def stats_mean_profile(t):
    scaled = train(t).withColumn("value", F.col("value") / 100)
    return stats.mean_profile(scaled, roles.train_count(t), linear=True).withColumn("mean", F.round("mean", 6))


@query("centre_by_project", "WITH " + SQL_BUCKETS.strip() + """, means AS (SELECT project, avg(c_acctbal) AS m FROM split0 WHERE split = 'train' GROUP BY 1)
    SELECT case_id, round(c_acctbal - m, 6) AS c_acctbal FROM split0 LEFT JOIN means USING (project)""")
def centre_by_project(t):
    rows = splits.with_split(roles.bucketed(t), 0)
    centred = stats.centre_by_group(rows, ["project"], F.col("split") == "train", ["c_acctbal"])
    return centred.select("case_id", F.round("c_acctbal", 6).alias("c_acctbal"))


HVG_SQL = WITH_STATS + ", hvg AS (SELECT * FROM stats WHERE round(var_pop, 9) > 0 ORDER BY round(var_pop, 9) DESC, feature LIMIT 50)"


@query("baseline_hvg_features", HVG_SQL + " SELECT feature FROM hvg")
def baseline_hvg_features(t):
    rounded = feature_stats(t).withColumn("var_pop", F.round("var_pop", 9))
    return stats.hvg_features(rounded, 50).select("feature")


@query("baseline_hvg_scores", HVG_SQL + " SELECT sample, feature, round((coalesce(value, 0) - mean) / sd_pop, 6) AS scaled FROM (SELECT c_custkey AS sample FROM customer) CROSS JOIN hvg LEFT JOIN vals USING (sample, feature)")
def baseline_hvg_scores(t):
    rounded = feature_stats(t).withColumn("var_pop", F.round("var_pop", 9))
    return stats.hvg_scores(roles.values(t), rounded, 50, samples=t.customer.select(F.col("c_custkey").alias("sample"))).select("sample", "feature", F.round("scaled", 6).alias("scaled"))


@query("baseline_hvg_command", BASE + """, every AS (SELECT v.*, k.fold, f.test_fold <> k.fold AND f.bucket % 20 < 18 AS is_train
        FROM vals v JOIN folded f ON v.sample = f.case_id, (SELECT unnest([0, 1, 2, 3, 4]) AS fold) k),
    nt AS (SELECT k.fold, count(*) FILTER (f.test_fold <> k.fold AND f.bucket % 20 < 18) AS n FROM folded f, (SELECT unnest([0, 1, 2, 3, 4]) AS fold) k GROUP BY 1),
    st AS (SELECT fold, feature, sum(value) / max(n) AS mean, sum(value * value) / max(n) - (sum(value) / max(n)) ^ 2 AS v
        FROM every JOIN nt USING (fold) WHERE is_train GROUP BY 1, 2),
    best AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY round(v, 9) DESC, feature) AS r FROM st WHERE round(v, 9) > 0)
    SELECT fold, f.case_id AS sample, b.feature, round((coalesce(value, 0) - mean) / sqrt(v), 6) AS scaled
    FROM folded f CROSS JOIN best b LEFT JOIN vals w ON w.sample = f.case_id AND w.feature = b.feature WHERE r <= 20""")
def baseline_hvg_command(t):
    from tidyfold.plans.baseline import hvg_embeddings

    rows = hvg_embeddings(roles.values(t), roles.bucketed(t), "case_id", 20, digits=9)
    each = F.explode(F.arrays_zip("features", "embedding")).alias("e")
    return rows.select("fold", "sample", each).select(F.col("fold").cast("int"), "sample", F.col("e.features").alias("feature"), F.round("e.embedding", 6).alias("scaled"))


@query("quantiles_exact", "SELECT l_returnflag, quantile_cont(l_extendedprice, 0.01) AS low, median(l_extendedprice) AS middle, quantile_cont(l_extendedprice, 0.99) AS high FROM lineitem GROUP BY 1")
def quantiles_exact(t):
    return ordering.exact_quantiles(
        t.lineitem, ["l_returnflag"], "l_extendedprice", {"low": 0.01, "middle": 0.5, "high": 0.99},
    )


@query("rank_detected_only", BASE + """, det AS (SELECT DISTINCT feature FROM sv WHERE split = 'train' AND value > 0)
    SELECT sample, count(*) AS expressed FROM vals WHERE value > 0 AND feature IN (SELECT feature FROM det) GROUP BY 1""")
def rank_detected_only(t):
    seen = selection.detected(train(t))
    return roles.values(t).filter("value > 0").join(seen, "feature", "left_semi").groupBy("sample").agg(F.count("*").alias("expressed"))
