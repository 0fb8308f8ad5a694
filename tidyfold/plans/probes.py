"""The probes: fit per fold on its fitting rows, pool the folds' test predictions, score with intervals.

Every probe takes `planned` rows from `splits.plan`: sample, fold, fit, test,
embedding, case, project, sample_type (and the columns a probe names).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidyfold.operators import bootstrap, linear, metrics, neighbours, selection, splits, survival
from tidyfold.operators.blocks import Blocks, block_of, pack
from tidyfold.operators.stats import centre_by_group
from tidyfold.session import stable

def folds_of(planned: DataFrame) -> list[int]:
    """The folds present: at most five numbers."""
    return sorted(r[0] for r in planned.select("fold").distinct().collect())


def _head(table: DataFrame, split: str, n: int) -> DataFrame:
    return table.select(F.lit(split).alias("split"), F.lit(n).cast("bigint").alias("n"), "*")


def _summary(scores: DataFrame, names: Sequence[str], keep: bool = True) -> DataFrame:
    return bootstrap.summarize(scores.withColumn("_k", F.lit(0)), ["_k"], names, keep=keep).drop("_k")


def _beside(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two one-row tables as one row."""
    return left.withColumn("_j", F.lit(0)).join(right.withColumn("_j", F.lit(0)), "_j").drop("_j")


def classification_probe(planned: DataFrame, tasks: dict[str, Column], case: str = "case_submitter_id",
                         n_bootstrap: int = bootstrap.N_BOOTSTRAP, seed: int = 0, hash_fn: str = "xxhash64",
                         max_iter: int = 2000) -> DataFrame:
    """One row per task: accuracy, balanced accuracy, macro-F1 and weighted-F1 with intervals.

    A task whose fitting rows hold fewer than two classes in any fold is skipped.
    """
    folds, out = folds_of(planned), None
    planned = stable(planned)
    for task, label in tasks.items():
        rows = planned.withColumn("_label", label.cast("string")).filter(F.col("_label").isNotNull())
        seen = rows.filter("fit").groupBy("fold").agg(F.countDistinct("_label").alias("k")).collect()
        if len(seen) < len(folds) or any(r["k"] < 2 for r in seen):
            continue
        predicted = None
        for fold in folds:
            part = rows.filter(F.col("fold") == fold)
            model = linear.fit_linear_probe(part.filter("fit"), "embedding", "_label", max_iter)
            done = linear.predict_linear_probe(model, part.filter("test"), "embedding").select(case, F.col("_label").alias("true"), "pred")
            predicted = done if predicted is None else predicted.unionByName(done)
        predicted = stable(predicted)
        n = predicted.count()
        if n == 0:
            continue
        weights = bootstrap.bootstrap_vectors(predicted, case, n_bootstrap, seed, hash_fn)
        cells = bootstrap.weigh(predicted, weights, case, ["true", "pred"], {"w": F.lit(1.0)})
        scores = metrics.classification_scores(cells, ["replicate"])
        table = _summary(scores, ["accuracy", "balanced_accuracy", "macro_f1", "weighted_f1"])
        table = _head(table, splits.plan_name(folds), n).select(F.lit(task).alias("task"), "*")
        out = table if out is None else out.unionByName(table)
    return out


def invertibility_target(genes: DataFrame, values: DataFrame, sample: str = "sample_index") -> DataFrame:
    """(sample, target): the fixed target, log-normalised counts of the protein-coding genes."""
    from tidyfold.functions.arrays import gather, log_normalize

    chosen = selection.select_genes(genes).select("gene_index").orderBy("gene_index").collect()  # the gene axis, a vocabulary
    return values.select(sample, log_normalize(gather(F.col("values"), [r[0] for r in chosen])).alias("target"))


def invertibility(planned: DataFrame, target: str = "target", case: str = "case_submitter_id",
                  alphas: Sequence[float] = linear.ALPHAS, n_bootstrap: int = bootstrap.N_BOOTSTRAP, seed: int = 0,
                  hash_fn: str = "xxhash64") -> DataFrame:
    """How much of a target array a ridge recovers from the embedding; no interval on r2_gene.

    The target is handled in tiles of columns. A row's sums add up over the tiles
    and then meet the replicates as every other score does. A replicate needs
    per-column sums only for its means, which are squared tile by tile, so no
    task holds more than replicates x one tile.
    """
    planned = stable(planned)
    folds = folds_of(planned)
    fits = linear.fit_ridges(planned.filter("fit"), "embedding", target, "fold", alphas)
    numbered = stable(planned.filter("test").select(F.monotonically_increasing_id().alias("_row"), case, "fold", "embedding", target))
    vectors = stable(bootstrap.bootstrap_vectors(numbered, case, n_bootstrap, seed, hash_fn))
    rows = numbered.join(vectors, case).withColumn("_id", F.array(F.col("_row").cast("double")))
    packed = pack(rows, ["embedding", target, "weights", "_id"], F.col("fold"))
    sums, shifted, value = _tiled_sums(packed, fits, target)
    scores = stable(_row_scores(numbered, sums, vectors, shifted, case))
    fixed = scores.filter("replicate = 0").select(F.lit(value).cast("double").alias("r2_gene"), "pearson_sample_baseline")
    table = _beside(_summary(scores, ["r2_pooled", "pearson_sample"]), fixed)
    table = table.withColumn("alpha", F.lit(float(np.median([f.alpha for f in fits.values()]))))
    return _head(table, splits.plan_name(folds), numbered.count())


ROW_SUMS = ("gap", "second", "t", "tt", "p", "pp", "tp", "b", "bb", "tb")


def _tiled_sums(packed: Blocks, fits: linear.Ridges, target: str) -> tuple[DataFrame, np.ndarray, float | None]:
    """(row sums by tile, each replicate's squared column sums, mean R2 of the columns that vary)."""
    import pyarrow as pa

    context, parts = packed.table.sparkSession.sparkContext, None
    shifted, values = 0.0, []
    shift = np.mean([f.intercept for f in fits.values()], axis=0)
    for lo, hi in fits.tiles:
        sent = context.broadcast((fits.coefficients(lo, hi), shift[lo:hi]))

        def predicted(k, x, t, lo=lo, hi=hi, sent=sent):
            (mean, sd, coef, intercept), zero = sent.value[0][k], sent.value[1]
            return t[:, lo:hi], ((x - mean) / sd) @ coef + intercept, intercept, t[:, lo:hi] - zero

        def by_row(batches, predicted=predicted):
            for batch in batches:
                for r in range(batch.num_rows):
                    k, x, t, ids = block_of(batch, r)
                    t, p, b, c = predicted(k, x, t)
                    found = [((t - p) ** 2).sum(1), (c**2).sum(1), t.sum(1), (t**2).sum(1), p.sum(1), (p**2).sum(1), (t * p).sum(1)]
                    found += [np.full(len(t), b.sum()), np.full(len(t), (b**2).sum()), t @ b, np.full(len(t), float(t.shape[1]))]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[:, 0].astype(np.int64)), *map(pa.array, found)], names=["_row", *ROW_SUMS, "m"])

        def by_replicate(k, x, t, w, predicted=predicted):
            t, p, _, c = predicted(k, x, t)
            return np.vstack([w.T @ c, ((t - p) ** 2).sum(0), (c**2).sum(0)])

        own = packed.table.select("_k", "_n", "embedding", target, "_id").mapInArrow(by_row, ", ".join(["_row long", *(f"{c} double" for c in ROW_SUMS), "m double"]))
        parts = own if parts is None else parts.unionByName(own)
        found = sum(packed.total(["embedding", target, "weights"], by_replicate, packed.widths["weights"]).values())
        first, gap, square = found[:-2], found[-2], found[-1]
        shifted = shifted + (first**2).sum(axis=1)
        n = sum(packed.rows.values())
        tot = np.maximum(square - first[0] ** 2 / n, 0.0)
        varies = tot > 1e-9 * n
        values += (1 - gap[varies] / tot[varies]).tolist()
    return parts, shifted, float(np.mean(values)) if values else None


def _row_scores(numbered: DataFrame, sums: DataFrame, vectors: DataFrame, shifted: np.ndarray, case: str) -> DataFrame:
    """(replicate, r2_pooled, pearson_sample, pearson_sample_baseline); a row that doesn't vary has no correlation."""
    whole = sums.groupBy("_row").agg(*[F.sum(c).alias(c) for c in (*ROW_SUMS, "m")])

    def spread(one: str, two: str) -> Column:
        free = F.col(two) - F.col(one) * F.col(one) / F.col("m")
        return F.when(free > 1e-12 * F.col(two), free)

    def correlation(one: str, two: str, both: str) -> Column:
        return (F.col(both) - F.col("t") * F.col(one) / F.col("m")) / F.sqrt(spread("t", "tt") * spread(one, two))

    rows = whole.join(numbered.select("_row", case), "_row").select(case, "gap", "second", correlation("p", "pp", "tp").alias("r"), correlation("b", "bb", "tb").alias("r0"))
    named = {"total": F.lit(1.0), "ss_res": F.col("gap"), "sq": F.col("second")}
    named |= {n: F.coalesce(F.col(n), F.lit(0.0)) for n in ("r", "r0")} | {f"{n}n": F.col(n).isNotNull().cast("double") for n in ("r", "r0")}
    weighed = bootstrap.weigh(rows, vectors, case, [], named)
    means = rows.sparkSession.createDataFrame([(r, float(v)) for r, v in enumerate(np.atleast_1d(shifted))], "replicate int, _shifted double")
    return weighed.join(means, "replicate").select(
        "replicate", (1 - F.try_divide(F.col("ss_res"), F.col("sq") - F.col("_shifted") / F.col("total"))).alias("r2_pooled"),
        F.try_divide(F.col("r"), F.col("rn")).alias("pearson_sample"), F.try_divide(F.col("r0"), F.col("r0n")).alias("pearson_sample_baseline"),
    )


def _centred_embedding(rows: DataFrame, project: str) -> DataFrame:
    """Rows with `x`: the embedding less its (fold, project) mean over fitting rows; none where there are no such rows."""
    means = metrics.mean_vectors(rows.filter("fit"), ["fold", project], "embedding", "_mean")
    met = rows.join(means, ["fold", project])
    return met.withColumn("x", F.zip_with("embedding", "_mean", lambda a, b: a.cast("double") - b)).drop("_mean")


def pathway_probe(planned: DataFrame, scores: DataFrame, key: str = "aliquot_id", case: str = "case_submitter_id",
                  project: str = "project_id", tumour: Column | None = None, alphas: Sequence[float] = linear.ALPHAS,
                  n_bootstrap: int = bootstrap.N_BOOTSTRAP, seed: int = 0, hash_fn: str = "xxhash64") -> DataFrame:
    """Project-centred ridge from the embedding onto pathway scores (key, one column per pathway)."""
    pathways = [c for c in scores.columns if c != key]
    tumour = selection.task_label("project_id").isNotNull() if tumour is None else tumour
    whole = F.lit(True)
    for p in pathways:
        whole = whole & F.col(p).isNotNull()
    rows = stable(planned.join(scores, key).filter(whole & tumour))
    folds = folds_of(planned)
    centred = _centred_embedding(centre_by_group(rows, ["fold", project], F.col("fit"), pathways), project)
    ready = stable(centred.withColumn("_y", F.array(*[F.col(p).cast("double") for p in pathways])).select("fold", "fit", "test", case, "x", "_y"))
    fits = linear.fit_ridges(ready.filter("fit"), "x", "_y", "fold", alphas)
    done = stable(linear.predict_ridges(ready.filter("test"), fits, "x", "fold"))
    flat = done.select(case, F.posexplode(F.arrays_zip(F.col("_y").alias("true"), F.col("pred").alias("pred"))).alias("pathway", "_s"))
    flat = flat.select(case, "pathway", F.col("_s.true").alias("true"), F.col("_s.pred").alias("pred"))
    weights = bootstrap.bootstrap_vectors(done, case, n_bootstrap, seed, hash_fn)
    sums = bootstrap.weigh(flat, weights, case, ["pathway"], metrics.squared_sums())
    table = _summary(metrics.target_r2(sums, "pathway", ["replicate"]), ["r2_pooled", "r2_pathway"])
    table = table.select(F.lit(len(pathways)).alias("pathways"), F.lit(float(np.median([f.alpha for f in fits.values()]))).alias("alpha"), "*")
    return _head(table, splits.plan_name(folds), done.count())


def confounder_probe(planned: DataFrame, quality: Sequence[str], batches: Sequence[str], row: str = "sample_index",
                     case: str = "case_submitter_id", project: str = "project_id", tumour: Column | None = None, k: int = 10,
                     alphas: Sequence[float] = linear.ALPHAS, n_bootstrap: int = bootstrap.N_BOOTSTRAP, seed: int = 0,
                     hash_fn: str = "xxhash64") -> DataFrame:
    """Within-project R2 of quality covariates, and batch enrichment among neighbours.

    `planned` carries the covariate columns.
    """
    tumour = selection.task_label("project_id").isNotNull() if tumour is None else tumour
    folds = folds_of(planned)
    rows = stable(_centred_embedding(centre_by_group(planned.filter(tumour), ["fold", project], F.col("fit"), list(quality)), project))
    tested = planned.filter(tumour & F.col("test"))
    weights = stable(bootstrap.bootstrap_vectors(tested, case, n_bootstrap, seed, hash_fn))
    table, names = None, []
    for name in quality:
        ready = rows.filter(F.col(name).isNotNull()).select("fold", "fit", "test", case, "x", F.array(F.col(name).cast("double")).alias("_y"))
        fits = linear.fit_ridges(ready.filter("fit"), "x", "_y", "fold", alphas)
        done = linear.predict_ridges(ready.filter("test"), fits, "x", "fold").select(case, F.col("_y")[0].alias("true"), F.col("pred")[0].alias("pred"))
        sums = bootstrap.weigh(done, weights, case, [], metrics.squared_sums())
        scores = sums.select("replicate", (1 - F.try_divide("ss_res", "ss_tot")).alias(f"{name}_r2"))
        table = scores if table is None else table.join(scores, "replicate")
        names.append(f"{name}_r2")
    for name in batches:
        known = rows.filter(F.col(name).isNotNull())
        keyed = known.withColumn("grp", F.concat_ws(":", F.col("fold").cast("string"), F.col(project).cast("string")))
        keyed = keyed.withColumn("id", F.concat_ws(":", F.col("fold").cast("string"), F.col(row).cast("string")))
        nearest = neighbours.cosine_neighbours(
            keyed.filter("test").select("grp", F.col("id").alias("qid"), F.col("x").alias("vec")),
            keyed.filter("fit").select("grp", F.col("id").alias("rid"), F.col("x").alias("vec")), k,
        )
        table_rows = keyed.select("id", "grp", F.col(name).alias("batch"), "fit", case)
        found = neighbours.batch_enrichment(nearest, table_rows, table_rows.filter("fit"))
        cases = table_rows.select(F.col("id").alias("qid"), case)
        means = bootstrap.weighted_mean(found.join(cases, "qid").withColumnRenamed("enrichment", f"{name}_enrichment"), weights, case, f"{name}_enrichment")
        table = means if table is None else table.join(means, "replicate")
        names.append(f"{name}_enrichment")
    return _head(_summary(table, names), splits.plan_name(folds), tested.count())


def geometry_probe(planned: DataFrame, label: Column, row: str = "sample_index", case: str = "case_submitter_id",
                   ks: Sequence[int] = (1, 10), n_bootstrap: int = bootstrap.N_BOOTSTRAP, seed: int = 0,
                   hash_fn: str = "xxhash64") -> DataFrame:
    """Spectrum, neighbour precision, silhouette, NMI and ARI; whole-space scores averaged over folds."""
    import pandas as pd

    folds = folds_of(planned)
    rows = planned.withColumn("_label", label.cast("string")).filter(F.col("_label").isNotNull())
    means = metrics.mean_vectors(rows.filter("fit"), ["fold"], "embedding", "_mean")
    rows = rows.join(means, "fold").withColumn("x", F.zip_with("embedding", "_mean", lambda a, b: a.cast("double") - b)).drop("_mean")
    rows = stable(rows.withColumn("_id", F.concat_ws(":", F.col("fold").cast("string"), F.col(row).cast("string"))))
    fit, test = rows.filter("fit"), rows.filter("test")
    nearest = neighbours.cosine_neighbours(
        test.select(F.col("fold").alias("grp"), F.col("_id").alias("qid"), F.col("x").alias("vec")),
        fit.select(F.col("fold").alias("grp"), F.col("_id").alias("rid"), F.col("x").alias("vec")), max(ks),
    )
    precision = neighbours.neighbour_precision(nearest, rows.select(F.col("_id").alias("id"), F.col("_label").alias("label")), ks)
    silhouette = neighbours.silhouettes(test, "_id", "x", "_label", ["fold"]).select("_id", "silhouette")
    per_row = stable(test.select("_id", case).join(precision.withColumnRenamed("qid", "_id"), "_id", "left").join(silhouette, "_id", "left"))
    weights = stable(bootstrap.bootstrap_vectors(per_row, case, n_bootstrap, seed, hash_fn))
    table, names = None, [*[f"precision_at_{k}" for k in ks], "silhouette"]
    for name in names:
        scores = bootstrap.weighted_mean(per_row, weights, case, name)
        table = scores if table is None else table.join(scores, "replicate")
    space = []
    spectra = {k: linear.spectrum_scores(linear.covariance(m)) for k, m in linear.moments(test, "embedding", "embedding", "fold").items()}
    classes = {r["fold"]: r["k"] for r in fit.groupBy("fold").agg(F.countDistinct("_label").alias("k")).collect()}
    for fold in spectra:
        here = neighbours.kmeans_clusters(fit.filter(F.col("fold") == fold), test.filter(F.col("fold") == fold), "x", classes[fold], seed)
        agreement = metrics.clustering_agreement(metrics.confusion(here, "_label", "cluster")).first()
        space.append((*spectra[fold], agreement["nmi"], agreement["ari"]))
    mean = pd.DataFrame(space, columns=["effective_rank", "top_eigenvalue_share", "nmi", "ari"]).mean()
    table = _summary(table, names)
    return _head(table.select(*[F.lit(float(v)).alias(c) for c, v in mean.items()], "*"), splits.plan_name(folds), per_row.count())


def survival_predictions(planned: DataFrame, labels: DataFrame, endpoint: str = "pfi", row: str = "sample_index",
                         case: str = "case_submitter_id", project: str = "project_id",
                         alphas: Sequence[float] = survival.COX_ALPHAS, primary: Sequence = selection.PRIMARY,
                         max_iter: int = 100) -> tuple[DataFrame, dict[int, float]]:
    """(case, project, fold, time, event, risk) of test patients, and each fold's penalty.

    A patient is its earliest primary sample, joined to the endpoint; negative
    or missing times drop out. All folds are fit together.
    """
    usable = labels.select(case, F.col(f"{endpoint}_event").alias("event"), F.col(f"{endpoint}_time").cast("double").alias("time"))
    usable = usable.filter(F.col("event").isNotNull() & (F.col("time") >= 0))
    kept = planned.filter(F.col("sample_type").isin(*primary))
    first = kept.groupBy("fold", case).agg(F.min_by(F.struct(row, project, "fit", "test", "embedding"), row).alias("_s")).select("fold", case, "_s.*")
    patients = stable(first.join(usable, case))
    scale = {k: linear.standardiser(m) for k, m in linear.moments(patients.filter("fit"), "embedding", "embedding", "fold").items()}
    names = patients.columns

    def standardise(batches):
        for batch in batches:
            for fold, part in batch.groupby("fold"):
                mean, sd = scale[int(fold)]
                yield part[names].assign(x=list((linear.stack(part["embedding"]) - mean) / sd))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in patients.schema.fields)
    ready = stable(patients.mapInPandas(standardise, f"{fields}, x array<double>").drop("embedding"))
    fit = ready.filter("fit")
    chosen = {f: float(alphas[0]) for f in scale} if len(alphas) == 1 else survival.select_alphas(fit, "x", "fold", [project], case, alphas, max_iter=max_iter)
    betas = survival.fit_models(survival.CoxJob(fit, "x", "fold", [project]), chosen, max_iter=max_iter)
    done = survival.risks_by_model(ready.filter("test"), "x", "fold", betas)
    return done.select(F.col(case).alias("case"), F.col(project).alias("project"), "fold", "time", "event", "risk"), chosen


def survival_probe(planned: DataFrame, labels: DataFrame, endpoint: str = "pfi", n_bootstrap: int = bootstrap.N_BOOTSTRAP,
                   seed: int = 0, hash_fn: str = "xxhash64", **names) -> tuple[DataFrame, DataFrame]:
    """The summary row, and one row per project."""
    predictions, chosen = survival_predictions(planned, labels, endpoint, **names)
    scored = stable(predictions)
    weights = bootstrap.bootstrap_weights(scored, "case", n_bootstrap, seed, hash_fn)
    return survival.survival_scores(scored, weights, endpoint, splits.plan_name(folds_of(planned)), float(np.median(list(chosen.values()))))


def evaluate(embeddings: dict[str, DataFrame], bucketed: DataFrame, tasks: dict[str, Column], label: Column,
             reference: str | None = None, target: DataFrame | None = None, pathways: DataFrame | None = None,
             covariates: DataFrame | None = None, quality: Sequence[str] = (), batches: Sequence[str] = (),
             endpoints: DataFrame | None = None, sample: str = "sample_index", n_bootstrap: int = bootstrap.N_BOOTSTRAP) -> dict[str, DataFrame]:
    """Every probe on every embedding as tables, plus `differences` from the reference embedding."""
    if reference is not None and reference not in embeddings:
        raise ValueError(f"{reference!r} is none of the embeddings: {sorted(embeddings)}")
    tables: dict[str, DataFrame] = {}
    dims = {name: linear.width(rows, "embedding") for name, rows in embeddings.items()}

    def add(title: str, name: str, table: DataFrame | None) -> None:
        if table is not None:
            table = table.select(F.lit(name).alias("embeddings"), F.lit(dims[name]).alias("dim"), "*")
            tables[title] = tables[title].unionByName(table, allowMissingColumns=True) if title in tables else table

    for name, rows in embeddings.items():
        planned = stable(splits.plan(rows, bucketed, sample))
        add("classification", name, classification_probe(planned, tasks, n_bootstrap=n_bootstrap))
        add("geometry", name, geometry_probe(planned, label, sample, n_bootstrap=n_bootstrap))
        if target is not None:
            if not planned.join(target, sample, "left_anti").isEmpty():
                raise ValueError(f"{name}: samples without a row in the target")
            add("invertibility", name, invertibility(planned.join(target, sample), n_bootstrap=n_bootstrap))
        if pathways is not None:
            add("pathways", name, pathway_probe(planned, pathways, n_bootstrap=n_bootstrap))
        if covariates is not None:
            add("confounders", name, confounder_probe(planned.join(covariates, sample), quality, batches, sample, n_bootstrap=n_bootstrap))
        if endpoints is not None:
            summary, projects = survival_probe(planned, endpoints, n_bootstrap=n_bootstrap)
            add("survival", name, summary)
            add("survival_projects", name, projects)
    if reference is not None and len(embeddings) > 1:
        keyed = {}
        for title, table in tables.items():
            keys = ["split", *[c for c in ("task", "endpoint", "project") if c in table.columns]]
            scores = [c.removesuffix("_boot") for c in table.columns if c.endswith("_boot")]
            keyed[title] = (table, keys, [c for c in ("n", "patients") if c in table.columns], scores)
        tables["differences"] = bootstrap.all_differences(keyed, reference, list(embeddings))
    return tables
