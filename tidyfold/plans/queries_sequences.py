"""Sentences, windows, masks and corruption over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidyfold.operators import metrics, sampling, selection, sequences, splits
from tidyfold.plans import roles
from tidyfold.plans.queries_stats import BASE, SCORED_SQL, WITH_STATS, feature_stats, scored, train
from tidyfold.plans.registry import query
from tidyfold.plans.roles import md5_sql, uniform_sql

MAX, WINDOW, STRIDE, PAD = 32, 8, 4, -1

SENTENCE_SQL = SCORED_SQL + f""", det AS (SELECT DISTINCT feature FROM sv WHERE split = 'train' AND value > 0),
    placed AS (SELECT sample, feature, row_number() OVER (PARTITION BY sample ORDER BY score DESC, feature) AS rank
        FROM scored WHERE value > 0 AND feature IN (SELECT feature FROM det)),
    kept AS (SELECT sample, list(feature ORDER BY rank) AS l FROM placed WHERE rank <= {MAX} GROUP BY 1),
    sent AS (SELECT c_custkey AS sample, coalesce(l, []) AS l, coalesce(len(l), 0) AS length FROM customer LEFT JOIN kept ON sample = c_custkey),
    win AS (SELECT sample, l, length, CASE WHEN length > 0 THEN 1 + ceil(greatest(length - {WINDOW}, 0) / {STRIDE}) ELSE 0 END::BIGINT AS windows FROM sent)"""


def sentences(t):
    return sequences.sentences(scored(t), selection.detected(train(t)), "sample", MAX, PAD, samples=t.customer.select(F.col("c_custkey").alias("sample")))


@query("seq_sentences", SENTENCE_SQL + f" SELECT sample, array_to_string(list_concat(l, list_transform(range({MAX} - length), lambda x: {PAD})), ' ') AS genes, length FROM sent")
def seq_sentences(t):
    return sentences(t).select("sample", F.array_join(F.transform("genes", lambda g: g.cast("string")), " ").alias("genes"), "length")


@query("seq_window_counts", SENTENCE_SQL + " SELECT sample, windows FROM win")
def seq_window_counts(t):
    return sentences(t).select("sample", sequences.n_windows(F.col("length"), WINDOW, STRIDE).alias("windows"))


WINDOW_TEXT = f"""array_to_string(list_concat(list_slice(l, w * {STRIDE} + 1, w * {STRIDE} + {WINDOW}),
    list_transform(range({WINDOW} - len(list_slice(l, w * {STRIDE} + 1, w * {STRIDE} + {WINDOW}))), lambda x: {PAD})), ' ')"""


def shown(df):
    return F.array_join(F.transform(df["window"], lambda g: g.cast("string")), " ")


@query("seq_all_windows", SENTENCE_SQL + f" SELECT sample, w::INT AS window_index, {WINDOW_TEXT} AS genes FROM (SELECT *, unnest(range(windows)) AS w FROM win)")
def seq_all_windows(t):
    rows = sequences.all_windows(sentences(t), WINDOW, STRIDE, PAD)
    return rows.select("sample", "window_index", shown(rows).alias("genes"))


@query("seq_sampled_windows", SENTENCE_SQL + f""" SELECT sample, w AS window_index, {WINDOW_TEXT} AS genes
    FROM (SELECT *, {md5_sql("'7'", 'sample')} % windows AS w FROM win WHERE length > 0)""")
def seq_sampled_windows(t):
    rows = sequences.sample_windows(sentences(t), "sample", WINDOW, STRIDE, PAD, 7, "md5")
    return rows.select("sample", "window_index", shown(rows).alias("genes"))


TOKEN_SQL = BASE + """, tok AS (SELECT sample, feature, least(greatest(ceil((value::FLOAT / (SELECT max(value)::FLOAT FROM sv WHERE split = 'train')) * 63::FLOAT), 0), 63)::BIGINT AS token FROM vals)"""


def tokens(t):
    from tidyfold.operators import stats

    return stats.tokens(roles.values(t), stats.fit_tokenizer(train(t)), 64)


U = uniform_sql("'3'", "sample", "feature")


@query("seq_masked_tokens", TOKEN_SQL + f""", u AS (SELECT *, {U} AS u, {md5_sql("'4'", 'sample', 'feature')} % 64 AS other FROM tok)
    SELECT sample, feature, CASE WHEN u >= 0.15 THEN token WHEN u < 0.8 * 0.15::DOUBLE THEN 64 WHEN u < 0.9 * 0.15::DOUBLE THEN other ELSE token END::BIGINT AS masked,
    CASE WHEN u < 0.15 THEN token ELSE -100 END::BIGINT AS label FROM u""")
def seq_masked_tokens(t):
    masked, label = sequences.mask_token(F.col("token"), [F.col("sample"), F.col("feature")], 64, 64, 0.15, 3, hash_fn="md5")
    return tokens(t).select("sample", "feature", masked.alias("masked"), label.alias("label"))


MASKED_SQL = SENTENCE_SQL + f""", pos AS (SELECT sample, unnest(range({MAX}))::INT AS position, l, length FROM sent),
    tk AS (SELECT sample, position, length, CASE WHEN position < length THEN l[position + 1] ELSE {PAD} END AS token FROM pos),
    u AS (SELECT *, {uniform_sql("'5'", 'sample', 'position')} AS u, {md5_sql("'6'", 'sample', 'position')} % 5000 AS other FROM tk),
    mk AS (SELECT *, token <> {PAD} AND u < 0.15 AS hit FROM u),
    done AS (SELECT sample, position, length, CASE WHEN NOT hit THEN token WHEN u < 0.8 * 0.15::DOUBLE THEN 5000 WHEN u < 0.9 * 0.15::DOUBLE THEN other ELSE token END::BIGINT AS masked,
        CASE WHEN hit THEN token ELSE -100 END::BIGINT AS label FROM mk)"""


@query("seq_masked_sentences", MASKED_SQL + " SELECT sample, position, masked, label FROM done")
def seq_masked_sentences(t):
    rows = sequences.positions(sentences(t), "genes", ["sample"])
    masked, label = sequences.mask_token(F.col("token"), [F.col("sample"), F.col("position")], 5000, 5000, 0.15, 5, PAD, "md5")
    return rows.select("sample", "position", masked.alias("masked"), label.alias("label"))


@query("seq_masked_arrays", MASKED_SQL + """ SELECT sample, string_agg(masked, ' ' ORDER BY position) AS masked, string_agg(label, ' ' ORDER BY position) AS labels, max(length) AS length FROM done GROUP BY sample""")
def seq_masked_arrays(t):
    rows = sentences(t).withColumn("m", sequences.mask_array(F.col("genes"), F.col("sample"), 5000, 5000, 0.15, 5, PAD, "md5"))
    shown = lambda field: F.array_join(F.transform("m", lambda s: s[field].cast("string")), " ")
    return rows.select("sample", shown("token").alias("masked"), shown("label").alias("labels"), "length")


def positions_sql(count: int, seed: int) -> str:
    return BASE + f""", d AS (SELECT sample, feature, value, row_number() OVER (PARTITION BY sample ORDER BY {md5_sql(repr(str(seed)), 'sample', 'feature')}, feature) AS r FROM vals),
    m AS (SELECT sample, feature, value, r <= {count} AS mask FROM d)"""


@query("mask_positions", positions_sql(6, 11) + " SELECT sample, feature FROM m WHERE mask")
def mask_positions(t):
    return sampling.sample_positions(roles.values(t), "sample", 6, seed=11, hash_fn="md5").select("sample", "feature")


@query("mask_ratio", positions_sql(12, 12) + " SELECT sample, feature, mask FROM m")
def mask_ratio(t):
    return sampling.share_mask(roles.values(t), "sample", sampling.ratio_count(50, 0.25), seed=12, hash_fn="md5").select("sample", "feature", "mask")


@query("mask_fixed_count", positions_sql(15, 13) + " SELECT sample, feature, mask FROM m")
def mask_fixed_count(t):
    return sampling.share_mask(roles.values(t), "sample", sampling.fixed_count(50, 0.3), seed=13, hash_fn="md5").select("sample", "feature", "mask")


@query("mask_bernoulli", BASE + f" SELECT sample, feature, {uniform_sql(repr('14'), 'sample', 'feature')} < 0.3 AS mask FROM vals")
def mask_bernoulli(t):
    mask = sampling.bernoulli(0.3, 14, F.col("sample"), F.col("feature"), hash_fn="md5")
    return roles.values(t).select("sample", "feature", mask.alias("mask"))


@query("corrupt_uniform_draws", WITH_STATS + f""" SELECT sample, feature, round(low + (high - low) * {uniform_sql(repr('15'), 'sample', 'feature')}, 6) AS replacement
    FROM vals JOIN stats USING (feature)""")
def corrupt_uniform_draws(t):
    rows = roles.values(t).join(feature_stats(t).select("feature", "low", "high"), "feature")
    drawn = sampling.uniform_draw(F.col("low"), F.col("high"), 15, F.col("sample"), F.col("feature"), hash_fn="md5")
    return rows.select("sample", "feature", F.round(drawn, 6).alias("replacement"))


POOL_SQL = BASE + """, pool AS (SELECT case_id AS pool_sample, row_number() OVER (ORDER BY substr(md5('pool:' || case_id), 1, 15), case_id) - 1 AS pool_row,
        count(*) OVER () AS n FROM split0 WHERE split = 'train'),
    dr AS (SELECT v.sample, v.feature, v.value, coalesce(s.value, 0) AS replacement FROM vals v
        JOIN pool p ON p.pool_row = %SEED% % (SELECT max(n) FROM pool)
        LEFT JOIN sv s ON s.sample = p.pool_sample AND s.feature = v.feature AND s.split = 'train')"""


def pool_sql(seed: int) -> str:
    return POOL_SQL.replace("%SEED%", md5_sql(repr(str(seed)), "v.sample", "v.feature"))


def pool(t):
    rows = splits.with_split(roles.bucketed(t), 0).filter("split = 'train'").select(F.col("case_id").alias("sample"))
    return sampling.number_pool(rows, "sample")


@query("corrupt_marginal_draws", pool_sql(16) + " SELECT sample, feature, replacement FROM dr")
def corrupt_marginal_draws(t):
    drawn = sampling.marginal_draws(roles.values(t), train(t), pool(t), "sample", seed=16, hash_fn="md5")
    return drawn.select("sample", "feature", "replacement")


@query("corrupt_bernoulli_marginal", pool_sql(18) + f""", c AS (SELECT sample, feature, value, CASE WHEN {uniform_sql(repr('17'), 'sample', 'feature')} < 0.4 THEN replacement ELSE value END AS corrupted FROM dr)
    SELECT sample, feature, corrupted, corrupted <> value AS changed FROM c""")
def corrupt_bernoulli_marginal(t):
    done = sampling.bernoulli_corrupt(roles.values(t), train(t), pool(t), "sample", 0.4, 17, hash_fn="md5")
    return done.select("sample", "feature", "corrupted", "changed")


@query("corrupt_fixed_uniform", WITH_STATS + f""", d AS (SELECT sample, feature, value, low, high, row_number() OVER (PARTITION BY sample
    ORDER BY {md5_sql(repr('19'), 'sample', 'feature')}, feature) <= 10 AS mask FROM vals JOIN stats USING (feature))
    SELECT sample, feature, mask, round(CASE WHEN mask THEN low + (high - low) * {uniform_sql(repr('20'), 'sample', 'feature')} ELSE value END, 6) AS corrupted FROM d""")
def corrupt_fixed_uniform(t):
    rows = roles.values(t).join(feature_stats(t).select("feature", "low", "high"), "feature")
    drawn = sampling.uniform_draw(F.col("low"), F.col("high"), 20, F.col("sample"), F.col("feature"), hash_fn="md5")
    done = sampling.fixed_corrupt(rows, 10, "sample", drawn, 19, hash_fn="md5")
    return done.select("sample", "feature", "mask", F.round("corrupted", 6).alias("corrupted"))


def augment_sql(ids: str, sample: str, seed: int) -> str:
    u = uniform_sql(repr(str(seed)), sample)
    mask = uniform_sql(repr(str(seed + 1)), sample, ids)
    u1, u2 = uniform_sql(repr(str(seed + 2)), sample, ids), uniform_sql(repr(str(seed + 3)), sample, ids)
    return f"""CASE WHEN {u} < 0.1 THEN value WHEN {u} < 0.55 THEN CASE WHEN {mask} < 0.2 THEN 0 ELSE value END
        ELSE value + 0.5 * sqrt(-2 * ln(1 - {u1})) * cos(6.283185307179586::DOUBLE * {u2}) END"""


@query("augment_views", BASE + f" SELECT sample, feature, round({augment_sql('feature', 'sample', 21)}, 6) AS augmented FROM vals")
def augment_views(t):
    done = sampling.augment(roles.values(t), "sample", 0.2, 0.5, 0.1, 21, hash_fn="md5")
    return done.select("sample", "feature", F.round("augmented", 6).alias("augmented"))


# ---- masks and corruption over all features, zeros that aren't stored included


def axis(t):
    return t.part.select(F.col("p_partkey").alias("position"), F.col("p_partkey").alias("feature"))


def keyed_sql(rate: float, seed: int) -> str:
    """`sampling.keyed_positions` cell by cell: (sample, feature, value) of the masked positions."""
    moved = "cell0 AS (SELECT c_custkey AS sample, c, n, a, b, k, c % a AS l, c // a AS r FROM customer, (SELECT n, a, b, k, unnest(range(k + a * b - n)) AS c FROM axis))"
    for i in range(sampling.ROUNDS):
        step = f"(l + {md5_sql(repr(str(seed)), 'sample', repr(str(i)), 'r')} % a) % a AS l, r" if i % 2 == 0 else f"l, (r + {md5_sql(repr(str(seed)), 'sample', repr(str(i)), 'l')} % b) % b AS r"
        moved += f", cell{i + 1} AS (SELECT sample, c, n, a, b, k, {step} FROM cell{i})"
    return f""", size AS (SELECT count(*)::BIGINT AS n, ceil(sqrt(count(*)))::BIGINT AS a FROM part), axis AS (SELECT n, a, ((n + a - 1) // a)::BIGINT AS b, floor({rate}::DOUBLE * n)::BIGINT AS k FROM size), {moved},
    hit AS (SELECT sample, r * a + l AS feature FROM cell{sampling.ROUNDS} WHERE r * a + l < n QUALIFY row_number() OVER (PARTITION BY sample ORDER BY c) <= k),
    masked AS (SELECT h.sample, h.feature, coalesce(v.value, 0)::DOUBLE AS value FROM hit h LEFT JOIN vals v USING (sample, feature))"""


def masked(t, rate: float, seed: int, draws=None):
    n = t.part.count()
    samples = t.customer.select(F.col("c_custkey").alias("sample"))
    drawn = sampling.masked_draws(samples, "sample", n, sampling.fixed_count(n, rate), seed, "md5")
    return sampling.mask_everywhere(roles.values(t), drawn, axis(t), "sample", draws=draws)


@query("mask_all_features", BASE + keyed_sql(0.15, 51) + " SELECT sample, feature, value FROM masked")
def mask_all_features(t):
    return masked(t, 0.15, 51).filter("mask").select("sample", "feature", "value")


@query("mask_all_bernoulli", BASE + f""", every AS (SELECT c_custkey AS sample, position, position AS feature FROM customer, (SELECT unnest(range(count(*))) AS position FROM part))
    SELECT sample, feature, coalesce(value, 0)::DOUBLE AS value FROM every LEFT JOIN vals USING (sample, feature) WHERE {uniform_sql(repr('52'), 'sample', 'position')} < 0.15""")
def mask_all_bernoulli(t):
    drawn = sampling.bernoulli_draws(t.customer.select(F.col("c_custkey").alias("sample")), "sample", t.part.count(), 0.15, 52, "md5")
    return sampling.mask_everywhere(roles.values(t), drawn, axis(t), "sample").filter("mask").select("sample", "feature", "value")


@query("corrupt_all_uniform", WITH_STATS + keyed_sql(0.1, 53) + f""" SELECT sample, feature, value, round(low + (high - low) * {uniform_sql(repr('54'), 'sample', 'feature')}, 6) AS corrupted
    FROM masked JOIN stats USING (feature)""")
def corrupt_all_uniform(t):
    ranges = sampling.sent(feature_stats(t).select("feature", "low", "high"))
    rows = masked(t, 0.1, 53, {"_draw": 54}).join(ranges, "feature")
    drawn = sampling.uniform_draw(F.col("low"), F.col("high"), 54, F.col("sample"), F.col("feature"), hash_fn="md5", drawn=F.col("_draw"))
    corrupted = sampling.corrupt(F.col("mask"), drawn, F.col("value"))
    return rows.filter("mask").select("sample", "feature", "value", F.round(corrupted, 6).alias("corrupted"))


@query("corrupt_all_marginal", POOL_SQL.replace(", pool AS", keyed_sql(0.1, 55) + ", pool AS").replace("AS replacement FROM vals v", "AS replacement FROM masked v").replace("%SEED%", md5_sql(repr("56"), "v.sample", "v.feature")) + """
    SELECT sample, feature, value, replacement AS corrupted, replacement <> value AS changed FROM dr""")
def corrupt_all_marginal(t):
    rows = sampling.marginal_draws(masked(t, 0.1, 55, {"_draw": 56}).filter("mask"), train(t), pool(t), "sample", seed=56, hash_fn="md5", drawn="_draw")
    return rows.select("sample", "feature", "value", F.col("replacement").alias("corrupted"), (F.col("replacement") != F.col("value")).alias("changed"))


def negative_sql(scope: str) -> str:
    """The layout of `sampling.number_candidates`, written as windows."""
    return f"""cand AS (SELECT {scope} AS scope, case_id, sample AS negative FROM samples WHERE split = 'train'),
    laid AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY substr(md5('case:' || case_id), 1, 15), case_id,
        substr(md5('row:' || negative), 1, 15), negative) - 1 AS position FROM cand),
    block AS (SELECT scope, case_id, min(position) AS start, count(*) AS len FROM laid GROUP BY 1, 2),
    whole AS (SELECT scope, count(*) AS n FROM laid GROUP BY 1)"""


def negative_pick(scope: str, seed: int) -> str:
    h = md5_sql(repr(str(seed)), "a.sample")
    return f"""pick AS (SELECT a.sample, w.scope, {h} % (w.n - coalesce(b.len, 0)) AS u, coalesce(b.start, 0) AS start, coalesce(b.len, 0) AS len
        FROM samples a JOIN whole w ON w.scope = {scope} LEFT JOIN block b ON b.scope = w.scope AND b.case_id = a.case_id)
    SELECT p.sample, l.negative FROM pick p JOIN laid l ON l.scope = p.scope AND l.position = p.u + CASE WHEN p.u >= p.start THEN p.len ELSE 0 END"""


def triplet_base(t):
    rows = splits.with_split(roles.bucketed_samples(t), 0)
    return rows, rows.filter("split = 'train'")


NEG_BASE = "WITH " + roles.SQL_BUCKETS.strip() + "," + roles.SQL_SAMPLES + ", "


@query("negatives_any", NEG_BASE + negative_sql("'*'") + ", " + negative_pick("'*'", 30))
def negatives_any(t):
    anchors, candidates = triplet_base(t)
    return sampling.draw_negatives(anchors, candidates, "case_id", "project", "sample", "any", 30, "md5").select("sample", "negative")


# A project whose training rows hold one patient takes the whole pool instead.
SEVERAL_SQL = "several AS (SELECT project FROM samples WHERE split = 'train' GROUP BY 1 HAVING count(DISTINCT case_id) > 1), "
LOCAL_SQL = negative_sql("'*'").replace("FROM samples WHERE split = 'train')", """FROM samples WHERE split = 'train'
    UNION ALL SELECT project::VARCHAR, case_id, sample FROM samples WHERE split = 'train' AND project IN (SELECT project FROM several))""", 1)
OWN_SCOPE = "CASE WHEN a.project IN (SELECT project FROM several) THEN a.project::VARCHAR ELSE '*' END"


@query("negatives_same_project", NEG_BASE + SEVERAL_SQL + LOCAL_SQL + ", " + negative_pick(OWN_SCOPE, 31))
def negatives_same_project(t):
    anchors, candidates = triplet_base(t)
    return sampling.draw_negatives(anchors, candidates, "case_id", "project", "sample", "project", 31, "md5").select("sample", "negative")


@query("triplet_views")
def triplet_views(t):
    from tidyfold.plans.roles import values

    cases = roles.bucketed(t).select(F.col("case_id").alias("sample"), "case_id", "project")
    rows = values(t)
    done = sampling.triplets(rows, cases, cases, "case_id", "project", "sample", 0.2, 0.5, seed=40)
    return done.groupBy("anchor", "role").agg(F.count("*").alias("features"), F.round(F.sum("augmented"), 3).alias("total"))


# ---- pooling of token and window vectors


@query("pool_mean_tokens", """WITH e AS (SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings)
    SELECT label, dim, round(avg(x), 6) AS pooled FROM e GROUP BY 1, 2""")
def pool_mean_tokens(t):
    rows = metrics.mean_vectors(t.embeddings, ["label"], "embedding")
    return rows.select("label", F.posexplode("pooled").alias("dim", "x")).select("label", "dim", F.round("x", 6).alias("pooled"))


@query("pool_max_tokens", """WITH e AS (SELECT label, generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings)
    SELECT label, dim, round(max(x), 6) AS pooled FROM e GROUP BY 1, 2""")
def pool_max_tokens(t):
    rows = metrics.max_vectors(t.embeddings, ["label"], "embedding")
    return rows.select("label", F.posexplode("pooled").alias("dim", "x")).select("label", "dim", F.round("x", 6).alias("pooled"))


@query("pool_windows_per_sample", """WITH e AS (SELECT vec_id AS sample, generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings),
    m AS (SELECT sample // 4 AS sample, dim, avg(x) AS x FROM e GROUP BY 1, 2),
    s AS (SELECT c_custkey AS sample, unnest(range(64)) AS dim FROM customer)
    SELECT sample, dim, round(coalesce(x, 0), 6) AS pooled FROM s LEFT JOIN m USING (sample, dim)""")
def pool_windows_per_sample(t):
    windows = t.embeddings.select(F.floor(F.col("vec_id") / 4).alias("sample"), "embedding")
    rows = metrics.pool_windows(t.customer.select(F.col("c_custkey").alias("sample")), windows, "sample", "embedding", 64)
    return rows.select("sample", F.posexplode("pooled").alias("dim", "x")).select("sample", "dim", F.round("x", 6).alias("pooled"))


@query("pool_random_draws", """WITH e AS (SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings)
    SELECT label AS sample, dim, round(avg(x), 6) AS pooled FROM e GROUP BY 1, 2""")
def pool_random_draws(t):
    rows = metrics.mean_vectors(t.embeddings.withColumnRenamed("label", "sample"), ["sample"], "embedding")
    return rows.select("sample", F.posexplode("pooled").alias("dim", "x")).select("sample", "dim", F.round("x", 6).alias("pooled"))
