import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidyfold.functions import arrays
from tidyfold.operators import graph, sampling, selection, sequences, sets, stats

COUNTS = [[1, 0, 3], [2, 0, 0], [5, 4, 0], [1, 0, 0]]


def tidy(spark, matrix):
    rows = [(s, f, float(v)) for s, row in enumerate(matrix) for f, v in enumerate(row) if v]
    return spark.createDataFrame(rows, "sample int, feature int, value double")


def test_idf_by_hand(spark):
    df = tidy(spark, COUNTS)
    for scheme, want in (("count", [0, math.log(4), math.log(4)]), ("smooth", [1, math.log(2.5) + 1, math.log(2.5) + 1])):
        found = {r["feature"]: r["idf"] for r in stats.inverse_document_frequency(df, 4, scheme).collect()}
        np.testing.assert_allclose([found[i] for i in range(3)], want)
    with pytest.raises(ValueError):
        stats.inverse_document_frequency(df, 4, "other")


def test_entropy_idf_matches_its_definition(spark):
    found = {r["feature"]: r["idf"] for r in stats.inverse_document_frequency(tidy(spark, COUNTS), 4).collect()}
    m = np.array(COUNTS, float)
    for f in range(3):
        p = m[:, f] / m[:, f].sum()
        p = p[p > 0]
        assert found[f] == pytest.approx(max(math.log(4) + (p * np.log(p)).sum(), 0))


def test_sparse_stats_count_the_zeros(spark):
    rng = np.random.default_rng(0)
    m = rng.poisson(0.7, (40, 12)).astype(float) * 1e4 + 0.0
    found = stats.feature_stats(tidy(spark, m), 40).toPandas().set_index("feature")
    for f in found.index:
        x = m[:, f]
        np.testing.assert_allclose(
            found.loc[f, ["mean", "var_pop", "sd_samp", "low", "high", "norm"]].astype(float),
            [x.mean(), x.var(), x.std(ddof=1), x.min(), x.max(), np.linalg.norm(x)], rtol=1e-9,
        )


def test_mad_matches_numpy_with_implied_zeros(spark):
    m = np.random.default_rng(1).poisson(1.2, (31, 6))
    m[:, 0] += 1
    found = stats.median_absolute_deviation(tidy(spark, m), 31).toPandas().set_index("feature")
    for f in found.index:
        med = np.median(m[:, f])
        assert found.loc[f, "median"] == med
        assert found.loc[f, "mad"] == np.median(np.abs(m[:, f] - med))


def test_constant_features_get_scale_one_and_range_is_kept(spark):
    m = np.array([[2.0, 1.0], [2.0, 5.0], [2.0, 3.0]])
    s = stats.feature_stats(tidy(spark, m), 3)
    scaler = {r["feature"]: r for r in stats.fit_scaler(s, "zscore").collect()}
    assert scaler[0]["scale"] == 1.0
    new = spark.createDataFrame([(9, 1, 100.0), (9, 0, 2.0)], "sample int, feature int, value double")
    out = {r["feature"]: r["scaled"] for r in stats.scale(new, stats.fit_scaler(s, "zscore")).collect()}
    assert out[1] == pytest.approx((5 - 3) / m[:, 1].std())
    assert [r["feature"] for r in stats.varying(s).collect()] == [1]


def test_one_row_has_no_sample_deviation(spark):
    s = stats.feature_stats(tidy(spark, [[1.0, 2.0]]), 1)
    with pytest.raises(Exception, match="two training rows"):
        stats.fit_scaler(s, "zscore_sample").collect()


def test_tokens(spark):
    df = spark.createDataFrame([(0.0,), (0.001,), (5.0,), (10.0,), (40.0,)], "value double")
    fitted = stats.fit_tokenizer(spark.createDataFrame([(10.0,), (1.0,)], "value double"))
    assert [r["token"] for r in stats.tokens(df, fitted, 11).collect()] == [0, 1, 5, 10, 10]
    with pytest.raises(Exception, match="above 0"):
        stats.fit_tokenizer(spark.createDataFrame([(0.0,)], "value double")).collect()


def test_array_functions(spark):
    df = spark.createDataFrame([([1.0, 3.0, 6.0], [2.0, 2.0, 2.0]), ([0.0, 0.0, 0.0], [1.0, 2.0, 4.0])], "a array<double>, b array<double>")
    out = df.select(
        arrays.log_normalize(F.col("a"), 100.0).alias("l"), arrays.pearson(F.col("a"), F.col("b")).alias("r"),
        arrays.pearson(F.col("a"), F.col("b"), 0.0).alias("r0"), arrays.unit(F.col("a")).alias("u"),
        arrays.gather(F.col("b"), [2, 0, 7]).alias("g"), arrays.pearson(F.col("a"), F.reverse("a")).alias("self"),
    ).collect()
    np.testing.assert_allclose(out[0]["l"], np.log1p([10, 30, 60]))
    assert out[0]["r"] is None and out[0]["r0"] == 0.0
    np.testing.assert_allclose(out[0]["u"], np.array([1, 3, 6]) / np.sqrt(46))
    assert out[1]["u"] == [0.0, 0.0, 0.0] and out[1]["l"] == [0.0, 0.0, 0.0]
    assert out[1]["g"] == [4.0, 1.0, None]
    assert out[0]["self"] == pytest.approx(np.corrcoef([1, 3, 6], [6, 3, 1])[0, 1])


def test_windows_cover_a_sentence(spark):
    df = spark.createDataFrame([(0, list(range(10)), 10), (1, [5, 6] + [-1] * 8, 2), (2, [-1] * 10, 0)], "sample int, genes array<bigint>, length bigint")
    out = sequences.all_windows(df, 4, 3, -1).orderBy("sample", "window_index").collect()
    assert [(r["sample"], r["window"]) for r in out] == [(0, [0, 1, 2, 3]), (0, [3, 4, 5, 6]), (0, [6, 7, 8, 9]), (1, [5, 6, -1, -1])]
    one = sequences.sample_windows(df, "sample", 4, 3, -1).collect()
    assert {r["sample"] for r in one} == {0, 1}


def test_masking_rates(spark):
    df = spark.range(20000).select("id", F.lit(3).cast("bigint").alias("t"))
    masked, label = sequences.mask_token(F.col("t"), [F.col("id")], 99, 50, 0.15, 1)
    out = df.select(masked.alias("m"), label.alias("l")).toPandas()
    hit = out[out["l"] == 3]
    assert abs(len(hit) / 20000 - 0.15) < 0.01
    assert abs((hit["m"] == 99).mean() - 0.8) < 0.03
    assert (out[out["l"] == -100]["m"] == 3).all()


def test_exact_counts_and_negatives(spark):
    rows = spark.createDataFrame([(s, f) for s in range(20) for f in range(30)], "sample int, feature int")
    masked = sampling.share_mask(rows, "sample", 7, seed=3).groupBy("sample").agg(F.sum(F.col("mask").cast("int")).alias("n"))
    assert {r["n"] for r in masked.collect()} == {7}
    assert sampling.ratio_count(10, 0.25) == 2 and sampling.ratio_count(10, 0.01) == 1 and sampling.fixed_count(10, 0.39) == 3
    # One patient holds half of a project; project q has a single patient.
    pool = [(i, "c0" if i < 40 else f"c{i}", "p") for i in range(80)] + [(100 + i, "solo", "q") for i in range(3)]
    df = spark.createDataFrame(pool, "sample int, case string, project string")
    case = {s: c for s, c, _ in pool}
    project = {s: p for s, _, p in pool}
    for kind in ("any", "project"):
        out = sampling.draw_negatives(df, df, "case", "project", "sample", kind, 5).collect()
        assert len(out) == len(pool)
        for r in out:
            assert case[r["sample"]] != case[r["negative"]]
            if kind == "project" and project[r["sample"]] == "p":
                assert project[r["negative"]] == "p"
    only = df.filter("project = 'q'")
    with pytest.raises(Exception, match="another patient"):
        sampling.draw_negatives(only, only, "case", "project", "sample").collect()


def test_graph_matches_numpy(spark):
    rng = np.random.default_rng(2)
    base = rng.poisson(2.0, (50, 4))
    m = np.hstack([base, base + rng.poisson(0.5, (50, 4)), np.full((50, 1), 3)]).astype(float)
    m[7] = 0
    df, n = tidy(spark, m), 50
    m[:, 8] = np.where(m.sum(1) > 0, m[:, 8], 0)
    m[:, 8] = 3.0
    m[7] = 0
    fitted = stats.feature_stats(df, n)
    out = {(r["source"], r["target"]): r["weight"] for r in graph.coexpression_graph(df, fitted, "sample", 3, 0.2).collect()}
    varying = [f for f in range(9) if m[:, f].std() > 0]
    r = np.abs(np.corrcoef(m[:, varying].T))
    want = {(f, f): 1.0 for f in range(9)}
    for a, f in enumerate(varying):
        others = sorted((-(r[a, b]), b) for b in range(len(varying)) if b != a)
        for w, b in others[:2]:
            if -w >= 0.2:
                want[(f, varying[b])] = want[(varying[b], f)] = -w
    assert set(out) == set(want)
    for k, w in want.items():
        assert out[k] == pytest.approx(w, abs=1e-9)


@pytest.mark.parametrize("stripe", [1024, 4])
def test_correlations_by_slices_of_samples_are_the_same(spark, stripe):
    rng = np.random.default_rng(4)
    base = rng.poisson(1.0, (80, 5))
    df = tidy(spark, np.hstack([base, base + rng.poisson(0.5, (80, 5))]).astype(float))
    fitted = stats.feature_stats(df, 80)
    whole, cut = (
        {(r["source"], r["target"]): r["r"] for r in graph.strongest_correlations(df, fitted, "sample", 3, 0.1, stripe=stripe, most_entries=most).collect()}
        for most in (graph.SLICE_ENTRIES, 60)
    )
    assert whole and set(whole) == set(cut)
    for k, r in whole.items():
        assert cut[k] == pytest.approx(r, abs=1e-9)


def test_selection(spark):
    genes = spark.createDataFrame(
        [(0, "E1.1", "A", "protein_coding", "chr2", 50), (1, "E2.3", "B", "lnc", "chr1", 9), (2, "E2.3_PAR_Y", "B", "protein_coding", "chrZ", 1),
         (3, "E4.1", "D", "protein_coding", "chr1", 70)],
        "gene_index int, gene_id string, gene_name string, gene_type string, chromosome string, start bigint",
    )
    assert [r["gene_index"] for r in selection.select_genes(genes).collect()] == [0, 3]
    with pytest.raises(ValueError):
        selection.select_genes(genes, ("none",))
    ids = spark.createDataFrame([(0, "E4"), (1, "E2"), (2, "E1.1")], "position int, gene_id string")
    assert [r["gene_index"] for r in selection.genes_by_id(genes, ids).collect()] == [3, 1, 0]
    for bad in ([(0, "E9")], [(0, "E1.2")], [(0, "E1"), (1, "E1")]):
        with pytest.raises(ValueError):
            selection.genes_by_id(genes, spark.createDataFrame(bad, "position int, gene_id string"))
    assert [r["gene_index"] for r in selection.genome_order(genes).collect()] == [1, 3, 0, 2]


def test_loader_draws_folds_before_filtering(spark):
    n = 60
    samples = spark.createDataFrame(
        [(i, f"C{i}", "P" if i % 2 else "Q", "Primary Tumor" if i % 3 else "Solid Tissue Normal") for i in range(n)],
        "sample_index int, case_submitter_id string, project_id string, sample_type string",
    )
    values = spark.createDataFrame([(i, [i, 2 * i, 1]) for i in range(n)], "sample_index int, values array<int>")
    whole = {r["sample_index"]: r["split"] for r in selection.load_expression(samples, values, [2, 0]).collect()}
    part = selection.load_expression(samples, values, [2, 0], "log1p", projects=["P"], sample_types=["Primary Tumor"]).collect()
    assert 0 < len(part) < n
    for r in part:
        assert r["split"] == whole[r["sample_index"]]
        np.testing.assert_allclose(r["values"], np.log1p([1, r["sample_index"]]))


def test_set_scores_average_present_members(spark):
    edges = spark.createDataFrame([("s", 0, "A"), ("s", 1, "B"), ("s", 2, "X"), ("t", 0, "X")], "set string, position int, member string")
    genes = spark.createDataFrame([(5, "A"), (6, "B"), (7, "B")], "gene_index int, gene_name string")
    bound = sets.member_positions(edges, genes)
    weights = {(r["set"], r["member"]): r["weight"] for r in sets.set_weights(bound).collect()}
    assert weights == {("s", "A"): 0.5, ("s", "B"): 0.5, ("s", "X"): 0.0, ("t", "X"): 0.0}
    assert sets.bind_members(edges, genes).count() == 3
    values = spark.createDataFrame([(1, 5, 4.0), (1, 6, 8.0)], "sample int, feature bigint, value double")
    assert sets.score_sets(values, sets.set_weights(bound), "sample").filter("set = 's'").first()["score"] == 6.0


def test_row_functions_accept_a_stream(spark, tmp_path):
    spark.createDataFrame([(1, [1.0, 3.0])], "sample int, values array<double>").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("sample int, values array<double>").parquet(str(tmp_path / "in"))
    run = stream.select(arrays.log_normalize(F.col("values"), 4.0).alias("v")).writeStream.format("memory").queryName("rows").start()
    run.processAllAvailable()
    run.stop()
    np.testing.assert_allclose(spark.table("rows").first()["v"], np.log1p([1.0, 3.0]))


def test_set_and_concept_scores_keep_the_bias_of_absent_members(spark):
    values = spark.createDataFrame([(1, 10, 4.0)], "sample int, feature int, value double")
    members = sets.set_weights(spark.createDataFrame([("A", 10, True), ("B", 20, True)], "set string, feature int, present boolean"))
    bias = spark.createDataFrame([("A", 1.0), ("B", 5.0)], "set string, bias double")
    samples = spark.createDataFrame([(1,), (2,)], "sample int")
    found = {(r["sample"], r["set"]): r["score"] for r in sets.score_sets(values, members, "sample", bias, samples=samples).collect()}
    assert found == {(1, "A"): 5.0, (1, "B"): 5.0, (2, "A"): 1.0, (2, "B"): 5.0}
    concepts = sets.concept_weights(spark.createDataFrame([("c", "A"), ("c", "B")], "concept string, set string"))
    found = {r["sample"]: r["score"] for r in sets.score_concepts(values, members, concepts, "sample", bias, samples=samples).collect()}
    assert found == {1: 5.0, 2: 3.0}


def test_relative_set_means_count_zeros(spark):
    values = spark.createDataFrame([(1, 10, 4.0)], "sample int, feature int, value double")
    edges = spark.createDataFrame([("A", 10), ("A", 20)], "set string, feature int")
    assert sets.relative_set_means(values, edges, "sample", 3).first()["score"] == pytest.approx(2 - 4 / 3)


def test_scaled_zeros_are_rows_when_samples_are_given(spark):
    values = spark.createDataFrame([(1, 10, 4.0)], "sample int, feature int, value double")
    scaler = spark.createDataFrame([(10, 2.0, 2.0, None, None), (20, 1.0, 4.0, None, None)], "feature int, offset double, scale double, clip_low double, clip_high double")
    samples = spark.createDataFrame([(1,), (2,)], "sample int")
    found = {(r["sample"], r["feature"]): r["scaled"] for r in stats.scale(values, scaler, samples=samples).collect()}
    assert found == {(1, 10): 1.0, (1, 20): -0.25, (2, 10): -1.0, (2, 20): -0.25}


def test_a_sample_without_expressed_features_is_an_empty_sentence(spark):
    scored = spark.createDataFrame([(1, 10, 2.0, 1.0)], "sample int, feature int, value double, score double")
    detected, samples = spark.createDataFrame([(10,)], "feature int"), spark.createDataFrame([(1,), (2,)], "sample int")
    found = {r["sample"]: (r["genes"], r["length"]) for r in sequences.sentences(scored, detected, "sample", 3, -1, samples=samples).collect()}
    assert found == {1: ([10, -1, -1], 1), 2: ([-1, -1, -1], 0)}


def test_hvg_embeddings_hold_standardised_zeros_and_can_be_written(spark, tmp_path):
    from tidyfold.plans.baseline import hvg_embeddings, write_baseline
    from tidyfold.sources.embeddings import read_embeddings

    cases = [(c, 5 * c) for c in range(20)]
    bucketed = spark.createDataFrame(cases, "case int, bucket int")
    stored = {(c, f): float((c * f) % 5) for c in range(20) for f in (1, 2, 3) if (c * f) % 5}
    values = spark.createDataFrame([(c, f, v) for (c, f), v in stored.items()], "sample int, feature int, value double")
    rows = hvg_embeddings(values, bucketed, "case", 2)
    for r in rows.collect():
        train = [c for c, b in cases if b // 20 != r["fold"] and b % 20 < 18]
        for f, e in zip(r["features"], r["embedding"]):
            known = [stored.get((c, f), 0.0) for c in train]
            mean = sum(known) / len(known)
            sd = (sum((v - mean) ** 2 for v in known) / len(known)) ** 0.5
            assert e == pytest.approx((stored.get((r["sample"], f), 0.0) - mean) / sd)
    write_baseline(rows.select(F.col("sample").alias("sample_index"), "fold", "embedding"), str(tmp_path / "hvg"))
    assert read_embeddings(spark, str(tmp_path / "hvg")).count() == 100


def test_members_bind_without_a_shuffle_of_what_they_make(spark):
    edges = spark.createDataFrame([("s", "A"), ("s", "A"), ("t", "A"), ("t", "B"), (None, "A"), ("u", None)], "set string, member string")
    genes = spark.createDataFrame([("A", 1), ("A", 2), ("A", 2), ("B", 3), (None, 4), ("C", 5), ("B", None)], "gene_name string, gene_index int")
    found = sets.bind_members(edges, genes)
    wanted = [(None, "A", 1), (None, "A", 2), ("s", "A", 1), ("s", "A", 2), ("t", "A", 1), ("t", "A", 2), ("t", "B", 3), ("t", "B", None)]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(wanted, key=repr)
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]


def test_grids_of_samples_and_sets_are_made_after_the_last_shuffle(spark):
    values = spark.createDataFrame([(1, 10, 2.0), (1, 20, 3.0), (2, 30, 5.0), (4, 10, 1.0)], "sample int, feature int, value double")
    members = sets.set_weights(spark.createDataFrame([("a", 10, True), ("a", 20, True), ("b", 30, True), ("c", 40, False), (None, 10, True)], "set string, feature int, present boolean"))
    samples = spark.createDataFrame([(1,), (2,), (3,), (3,), (None,)], "sample int")
    bias = spark.createDataFrame([("a", 0.5), ("b", 1.0), ("b", 1.0), ("d", 9.0), ("c", None)], "set string, bias double")
    done = sets.score_sets(values, members, "sample", bias, samples=samples)
    wanted = [(s, "a", 0.5 + (2.5 if s == 1 else 0)) for s in (1, 2, 3, None)] + 2 * [(s, "b", 1.0 + (5.0 if s == 2 else 0)) for s in (1, 2, 3, None)] + [(s, "c", 0.0) for s in (1, 2, 3, None)]
    assert sorted(map(tuple, done.collect()), key=repr) == sorted(wanted, key=repr)
    node = done._jdf.queryExecution().optimizedPlan()
    while node.nodeName() != "Generate":  # above the rows' making nothing joins or gathers them
        assert node.nodeName() in ("Project", "Filter")
        node = node.children().apply(0)
    assert sets.score_sets(values.limit(0), members.filter("set = 'z'"), "sample", samples=samples).count() == 0


def test_score_rows_take_a_thousand_replicates(spark, tmp_path, monkeypatch):
    """Intervals of concordance rest on the library's replicates, in the query and in its SQL."""
    from tidyfold.operators import bootstrap, survival
    from __spark_entry__ import ORACLES, QUERIES

    asked = []
    monkeypatch.setattr(survival, "survival_scores", lambda rows, weights, *a, f=survival.survival_scores: asked.append(weights.select(F.max(F.size("weights"))).first()[0]) or f(rows, weights, *a))
    events = [(i, i % 7, ["view", "click", "purchase"][(i * i + i // 7) % 3], i * 5000, float(i * 37 % 11)) for i in range(84)]
    rows = spark.createDataFrame(events, "event_id long, user_id long, event_type string, s long, value double")
    rows.select("event_id", "user_id", "event_type", F.timestamp_seconds("s").alias("ts"), "value").write.parquet(f"{tmp_path}/events.parquet")
    QUERIES["survival_score_rows"](spark, str(tmp_path)).collect()
    assert asked == [bootstrap.N_BOOTSTRAP + 1] and f"range(1, {bootstrap.N_BOOTSTRAP + 1})" in ORACLES["survival_score_rows"]


def test_concordance_under_arrays_of_weights_is_that_under_rows(spark):
    """Strata, ties, no events, missing keys, times and risks without a value; a slice of replicates at a time."""
    from tidyfold.operators import bootstrap, survival

    rnd = np.random.default_rng(3)
    made = [(int(i), [None, "a", "b", "c"][rnd.integers(4)], int(rnd.integers(12)) if i % 11 else None, int(rnd.integers(2)), float(rnd.integers(6))) for i in range(150)] + [(150, "d", 3, 0, 1.0), (None, "a", 4, 1, 2.0)]
    rows = spark.createDataFrame(made, "who long, project string, time long, event int, risk double")
    weights = bootstrap.bootstrap_vectors(rows, "who", 30, 2)
    long = bootstrap.bootstrap_weights(rows, "who", 30, 2)
    for found, wanted in zip(survival.stratified_concordance(rows, weights, "who", ["project"], "project"), survival.stratified_concordance(rows, long, "who", ["project"], "project")):
        found, wanted = (sorted((tuple(r[c] for c in wanted.columns) for r in df.collect()), key=str) for df in (found, wanted))
        assert len(found) == len(wanted) > 0
        assert all(x == y if not isinstance(x, float) else abs(x - y) < 1e-9 for f, w in zip(found, wanted) for x, y in zip(f, w))
    w = np.array([[1, 2], [1, 0], [1, 1]])
    concordant, pairs = survival.pair_sums(np.array([1.0, 2.0, 3.0]), np.array([True, True, False]), np.array([5.0, np.nan, 1.0]), np.array([False, True, False]), w)
    assert concordant.tolist() == [1.0, 2.0] and pairs.tolist() == [3.0, 2.0]
