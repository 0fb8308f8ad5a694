import numpy as np
import pytest
from pyspark.sql import functions as F

from tidyfold.operators import bootstrap, linear, reports, splits, survival
from tidyfold.plans import probes
from tidyfold.session import stable


@pytest.fixture(scope="module")
def cohort(spark):
    """80 samples of 40 cases; the label is in the first coordinate, the target is linear, one sample type."""
    rng = np.random.default_rng(0)
    label = np.repeat(np.arange(40) % 2, 2)
    x = rng.normal(size=(80, 3)) + np.stack([4.0 * label - 2, np.zeros(80), np.zeros(80)], axis=1)
    target = x @ rng.normal(size=(3, 5)) + 0.01 * rng.normal(size=(80, 5))
    rows = [
        (i, f"c{i // 2}", "PQ"[int(label[i])], "Primary Tumor", x[i].tolist(), target[i].tolist(), float(x[i, 1]), "ab"[i % 2], f"al{i}")
        for i in range(80)
    ]
    df = spark.createDataFrame(
        rows, "sample_index int, case_submitter_id string, project_id string, sample_type string, embedding array<double>, target array<double>, "
        "depth double, plate string, aliquot_id string"
    )
    bucketed = stable(splits.with_buckets(df.drop("embedding", "target")))
    return df, bucketed


def test_every_probe_reads_the_signal(spark, cohort):
    df, bucketed = cohort
    folds = splits.every_fold(df.select("sample_index", "embedding"))
    tables = probes.evaluate(
        {"x": folds}, bucketed, {"project": F.col("project_id")}, F.col("project_id"), target=df.select("sample_index", "target"), n_bootstrap=4
    )
    row = tables["classification"].first()
    assert row["accuracy"] > 0.9 and row["split"] == "cv" and row["n"] == 80 and row["dim"] == 3 and len(row["accuracy_boot"]) == 4
    row = tables["invertibility"].first()
    assert row["r2_pooled"] > 0.99 and row["r2_gene"] > 0.99 and row["pearson_sample"] > row["pearson_sample_baseline"]
    row = tables["geometry"].first()
    assert row["precision_at_1"] > 0.9 and row["silhouette"] > 0.3 and row["nmi"] > 0.5 and 1 < row["effective_rank"] <= 3


def test_invertibility_draws_once(spark, cohort, monkeypatch):
    """Its weights are read twice, so they are written; the draws would be made for each read."""
    df, bucketed = cohort
    planned = splits.plan(splits.every_fold(df.select("sample_index", "embedding")), bucketed).join(df.select("sample_index", "target"), "sample_index")
    plans, weigh = [], bootstrap.weigh

    def seen(rows, weights, *rest):
        plans.append(weights._jdf.queryExecution().optimizedPlan().toString())
        return weigh(rows, weights, *rest)

    monkeypatch.setattr(bootstrap, "weigh", seen)
    assert probes.invertibility(planned, n_bootstrap=3, alphas=(1.0,)).count() == 1
    assert plans and not any("Arrow" in p or "Range" in p for p in plans)


def test_invertibility_by_definition_in_any_tiles(spark, cohort, monkeypatch):
    df, bucketed = cohort
    planned = splits.plan(splits.every_fold(df.select("sample_index", "embedding")), bucketed).join(df.select("sample_index", "target"), "sample_index")
    planned = stable(planned.withColumn("target", F.transform("target", lambda v: v + 3 * F.sin("sample_index"))))
    want = planned.select("fold", "fit", "test", "embedding", "target", "case_submitter_id").toPandas()
    x, y = np.stack(want["embedding"]), np.stack(want["target"])
    truth, pred, base, case = [], [], [], []
    alphas = []
    for fold in sorted(set(want["fold"])):
        fit, test = ((want["fold"] == fold) & want[c] for c in ("fit", "test"))
        mean, sd = x[fit].mean(0), x[fit].std(0)
        z, centre = (x[fit] - mean) / sd, y[fit].mean(0)
        errors = []
        for a in (0.1, 10.0):
            inverse = np.linalg.inv(z.T @ z + a * np.eye(3))
            lever = 1 / len(z) + np.einsum("ij,jk,ik->i", z, inverse, z)
            errors.append((((y[fit] - centre - z @ inverse @ z.T @ (y[fit] - centre)) / (1 - lever)[:, None]) ** 2).sum())
        a = (0.1, 10.0)[int(np.argmin(errors))]
        alphas.append(a)
        coef = np.linalg.solve(z.T @ z + a * np.eye(3), z.T @ (y[fit] - centre))
        truth.append(y[test]), pred.append((x[test] - mean) / sd @ coef + centre), base.append(np.tile(centre, (test.sum(), 1))), case.append(want["case_submitter_id"][test])
    truth, pred, base, case = (np.concatenate(v) for v in (truth, pred, base, case))
    pooled = 1 - ((truth - pred) ** 2).sum() / ((truth - truth.mean(0)) ** 2).sum()
    gene = (1 - ((truth - pred) ** 2).sum(0) / ((truth - truth.mean(0)) ** 2).sum(0)).mean()
    rows = np.mean([np.corrcoef(a, b)[0, 1] for a, b in zip(truth, pred)])
    flat = np.mean([np.corrcoef(a, b)[0, 1] for a, b in zip(truth, base)])
    weights = {r["case_submitter_id"]: r["weights"] for r in bootstrap.bootstrap_vectors(planned.filter("test"), "case_submitter_id", 3).collect()}
    w = np.stack([weights[c] for c in case])
    drawn = [1 - (w[:, r, None] * (truth - pred) ** 2).sum() / (w[:, r, None] * (truth - np.average(truth, axis=0, weights=w[:, r])) ** 2).sum() for r in (1, 2, 3)]
    for targets in (1024, 2):
        fit = linear.fit_ridges
        monkeypatch.setattr(linear, "fit_ridges", lambda *a, **k: fit(*a, **k, targets=targets))
        row = probes.invertibility(planned, alphas=(0.1, 10.0), n_bootstrap=3).first()
        monkeypatch.setattr(linear, "fit_ridges", fit)
        assert [row[c] for c in ("r2_pooled", "r2_gene", "pearson_sample", "pearson_sample_baseline", "alpha")] == pytest.approx([pooled, gene, rows, flat, np.median(alphas)], rel=1e-9)
        assert row["r2_pooled_boot"] == pytest.approx(drawn, rel=1e-9)


def test_pathways_and_confounders(spark, cohort):
    df, bucketed = cohort
    planned = splits.plan(splits.every_fold(df.select("sample_index", "embedding")), bucketed)
    scores = df.select("aliquot_id", F.col("depth").alias("known"), F.hash("aliquot_id").cast("double").alias("noise")).filter("aliquot_id <> 'al3'")
    row = probes.pathway_probe(planned, scores, n_bootstrap=3).first()
    assert row["n"] == 79 and row["pathways"] == 2
    row = probes.confounder_probe(planned, ["depth"], ["plate"], n_bootstrap=3).first()
    assert row["depth_r2"] > 0.95 and abs(row["plate_enrichment"]) < 0.3


def test_survival_probe_ranks_by_the_signal(spark, cohort):
    df, bucketed = cohort
    planned = splits.plan(splits.every_fold(df.select("sample_index", "embedding")), bucketed)
    cases = df.filter("sample_index % 2 = 0").select("case_submitter_id", F.lit(1).alias("pfi_event"), (100 - 20 * F.col("depth")).alias("pfi_time"))
    summary, projects = probes.survival_probe(planned, cases, n_bootstrap=3, alphas=(0.01,), max_iter=4)
    row = summary.first()
    assert row["c_index"] > 0.9 and row["patients"] == 40 and row["events"] == 40 and row["projects"] == 2
    assert projects.count() == 2


def test_penalty_path_stops_at_the_first_fall(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 2))
    rows = [(i, x[i].tolist(), float(np.floor(50 - 10 * x[i, 0])), 1, 0, 0) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, x array<double>, time double, event int, fold int, s int")
    chosen = survival.select_alphas(df, "x", "fold", ["s"], "i", alphas=(1.0, 0.01), n_folds=2, max_iter=3)
    assert set(chosen) == {0} and chosen[0] in (1.0, 0.01)


def test_cohort_report(spark, cohort):
    df, bucketed = cohort
    tables = reports.cohort_report(df, bucketed, "case_submitter_id", "project_id", "sample_type", "Solid Tissue Normal", ["c0"])
    assert tables["projects"].count() == 2 and tables["examples"].count() == 1
    assert tables["type_by_fold"].first()["chi2"] is None  # one sample type only
    assert {r["samples"] for r in tables["fold_sizes"].groupBy("fold").agg(F.sum("samples").alias("samples")).collect()} == {80}
