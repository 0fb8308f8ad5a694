"""Concordance and stratified Cox models without comparing every pair.

Concordance is a count of dominated points. Writing times as integers, every
pair with t_i < t_j first differs at exactly one bit, where i has 0 and j has 1
below a shared prefix. So each row joins one group per bit, and inside a group
the pairs are counted by a running sum over risk: n log T rows in all.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyfold.functions.hashing import md5_hash
from tidyfold.operators.linear import stack, width
from tidyfold.operators.ordering import cut_points, prefix_sums
from tidyfold.session import stable

# The penalty path and the smallest number of events in the macro mean.
COX_ALPHAS = (1.0, 0.1, 0.01, 0.001, 0.0001)
MACRO_MIN_EVENTS = 10
INNER_FOLDS = 5


def time_codes(rows: DataFrame, time: str) -> tuple[DataFrame, int]:
    """(time, code) with codes in time order, and the number of bits they need."""
    distinct = stable(rows.select(time).distinct())
    numbered = prefix_sums(distinct, [], time, {"n": F.lit(1)}).select(
        time, F.col("n_before").alias("code")
    )
    return numbered, max(1, (max(distinct.count(), 1) - 1).bit_length())


def concordance_sums(rows: DataFrame, stratum: Sequence[str], time: str = "time", event: str = "event",
                     risk: str = "risk", weight: str | None = None, risk_cuts: Sequence[float] | None = None) -> DataFrame:
    """(stratum, concordant, pairs): i had the event, t_i < t_j; risk_i > risk_j counts 1, a tie 1/2.

    `weight` multiplies in from both sides of a pair.
    """
    keys = list(stratum)
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    base = rows.select(*keys, F.col(time).alias("_t"), F.col(event).cast("boolean").alias("_e"), F.col(risk).alias("_r"), w.alias("_w"))
    codes, bits = time_codes(base, "_t")
    at = base.join(codes, "_t").withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))))
    bit = F.getbit(F.col("code"), F.col("_level").cast("int"))
    prefix = F.floor(F.col("code") / F.pow(F.lit(2.0), F.col("_level") + 1)).cast("bigint")
    roles = at.select(
        *keys, "_level", prefix.alias("_prefix"), "_r",
        F.when((bit == 0) & F.col("_e"), F.col("_w")).otherwise(0.0).alias("_ask"),
        F.when(bit == 1, F.col("_w")).otherwise(0.0).alias("_have"),
    ).filter((F.col("_ask") > 0) | (F.col("_have") > 0))
    met = prefix_sums(roles, [*keys, "_level", "_prefix"], "_r", {"ask": F.col("_ask"), "have": F.col("_have")}, risk_cuts)
    return met.groupBy(*keys).agg(
        F.sum(F.col("ask") * (F.col("have_before") + 0.5 * F.col("have"))).alias("concordant"),
        F.sum(F.col("ask") * F.col("have_all")).alias("pairs"),
    )


#: Weights of a stratum that a task takes at once, and replicates at most and at least.
HELD, SLICE, FEWEST = 2_000_000, 256, 8


def replicated_sums(rows: DataFrame, weights: DataFrame, case: str, stratum: Sequence[str], time: str = "time", event: str = "event",
                    risk: str = "risk") -> DataFrame:
    """(replicate, stratum, concordant, pairs): `concordance_sums` under each replicate of (case, weights) arrays.

    A task takes a stratum under a slice of the replicates and counts its pairs
    bit by bit for all of them together, so a row is sent once a slice and never
    once a replicate and bit.
    """
    keys = list(stratum)
    base = rows.select(case, *keys, F.col(time).cast("double").alias("_t"), F.coalesce(F.col(event).cast("boolean"), F.lit(False)).alias("_e"), F.col(risk).cast("double").alias("_r"))
    base = base.dropna(subset=[case, "_t"])
    counted = base.groupBy(*keys).agg(F.count("*").alias("n"), F.min("_t").alias("t")).agg(F.max("n"), F.min("t")).first()
    width = max(FEWEST, min(SLICE, HELD // (counted[0] or 1)))
    met = base.dropna(subset=keys).join(weights.select(case, "weights"), case)
    spread = F.explode(F.sequence(F.lit(0), F.floor((F.size("weights") - 1) / width).cast("int")))
    cut = met.select(*keys, "_t", "_e", "_r", spread.alias("_v"), "weights").withColumn("weights", F.slice("weights", F.col("_v") * width + 1, width))
    earliest = counted[1]

    def count(group: pa.Table) -> pa.Table:
        t, e, r = (group.column(c).to_numpy() for c in ("_t", "_e", "_r"))
        e, lacking = e.astype(bool), np.asarray(group.column("_r").is_null())
        w = group.column("weights").combine_chunks().flatten().to_numpy().reshape(len(t), -1)
        concordant, pairs = pair_sums(t, e, r, lacking, w)
        met = np.flatnonzero((w[e | (t > earliest)] > 0).any(axis=0))  # only replicates in which a row can be of a pair
        first = group.column("_v")[0].as_py() * width
        return pa.table({
            "replicate": pa.array((first + met).astype(np.int32)), **{k: pa.repeat(group.column(k)[0], len(met)) for k in keys},
            "concordant": pa.array(concordant[met]), "pairs": pa.array(pairs[met]),
        })

    kinds = "".join(f"`{k}` {base.schema[k].dataType.simpleString()}, " for k in keys)
    dealt = cut.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, *keys, "_v")
    return dealt.groupBy(*keys, "_v").applyInArrow(count, f"replicate int, {kinds}concordant double, pairs double")


def pair_sums(t: np.ndarray, e: np.ndarray, r: np.ndarray, lacking: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(concordant, pairs) of one stratum under each column of weights, by the bits of its times' codes and a running sum over risk.

    A pair of which a risk is `lacking` counts, but isn't concordant.
    """
    code, place = np.unique(t, return_inverse=True)[1], np.unique(r, return_inverse=True)[1]
    place = np.where(lacking, len(r), place)
    order = np.argsort(place, kind="stable")
    code, place, e, lacking, w = code[order], place[order], e[order], lacking[order], w[order]
    concordant, pairs = np.zeros(w.shape[1]), np.zeros(w.shape[1])
    for level in range(int(code.max(initial=0)).bit_length()):
        by_prefix = np.argsort(code >> (level + 1), kind="stable")
        prefix, own = (code >> (level + 1))[by_prefix], place[by_prefix]
        upper, weight = ((code >> level) & 1)[by_prefix].astype(bool), w[by_prefix].astype(float)
        begins = np.append(True, prefix[1:] != prefix[:-1])
        runs = np.flatnonzero(begins | np.append(True, own[1:] != own[:-1]))
        ask = np.add.reduceat(weight * (~upper & e[by_prefix])[:, None], runs)
        have = np.add.reduceat(weight * upper[:, None], runs)
        del weight
        until = np.cumsum(have, axis=0)
        first = np.flatnonzero(begins[runs])
        group = np.cumsum(begins[runs]) - 1
        before = (until[first] - have[first])[group]
        every = until[np.append(first[1:], len(runs)) - 1][group] - before
        known = ~lacking[by_prefix][runs]
        concordant += (ask * (until - before - 0.5 * have))[known].sum(axis=0)
        pairs += (ask * every).sum(axis=0)
    return concordant, pairs


def concordance(rows: DataFrame, stratum: Sequence[str] = (), time: str = "time", event: str = "event", risk: str = "risk") -> DataFrame:
    """One row: Harrell's C pooled over strata (null without pairs) and its comparable pairs."""
    sums = concordance_sums(rows, stratum, time, event, risk)
    total = sums.agg(F.coalesce(F.sum("concordant"), F.lit(0.0)).alias("c"), F.coalesce(F.sum("pairs"), F.lit(0.0)).alias("p"))
    return total.select(F.try_divide(F.col("c"), F.col("p")).alias("c_index"), F.round("p").cast("bigint").alias("pairs"))


def stratified_concordance(rows: DataFrame, weights: DataFrame, case: str, stratum: Sequence[str], group: str,
                           min_events: int = MACRO_MIN_EVENTS, time: str = "time", event: str = "event",
                           risk: str = "risk") -> tuple[DataFrame, DataFrame]:
    """Per replicate: (c_index, c_index_macro, pairs), and the same by group.

    A pair counts with the product of its patients' weights, which are
    (replicate, case, weight) rows or (case, weights) arrays. The macro mean
    takes groups with at least `min_events` observed events.
    """
    keys = list(dict.fromkeys([*stratum, group]))
    if "weights" in weights.columns:
        sums = stable(replicated_sums(rows, weights, case, keys, time, event, risk))
    else:
        weighted = rows.join(weights.select("replicate", case, "weight"), case)
        sums = stable(concordance_sums(weighted, ["replicate", *keys], time, event, risk, "weight"))
    by_group = sums.groupBy("replicate", group).agg(F.sum("concordant").alias("concordant"), F.sum("pairs").alias("pairs"))
    by_group = by_group.withColumn("c_index", F.try_divide(F.col("concordant"), F.col("pairs")))
    events = rows.groupBy(group).agg(F.sum(F.col(event).cast("int")).alias("_events"))
    met = by_group.join(events, group)
    pooled = met.groupBy("replicate").agg(
        F.try_divide(F.sum("concordant"), F.sum("pairs")).alias("c_index"),
        F.avg(F.when(F.col("_events") >= min_events, F.col("c_index"))).alias("c_index_macro"),
        F.sum("pairs").alias("pairs"),
    )
    return pooled, by_group.drop("concordant")


#: Rows of a time range at least; ranges over which all rows are spread at most.
RANGE_ROWS, RANGES = 1024, 4096


class CoxJob:
    """Loss and gradient of several stratified ridge Cox models (Breslow ties), two passes for each evaluation.

    `rows` carries a `model` key, so every fold and inner fold is evaluated
    together. Once, the rows of each (model, stratum) are laid out in time
    ranges and written as packed blocks, in time order. A time that fills more
    than a range by itself is a range of its own, in as many blocks as it needs;
    any other range is one block. An evaluation then sums exp(x·beta) and its
    moment by range, adds up the later ranges on the driver (ranges x width
    numbers, at most RANGES and one a stratum), and in a second pass finishes
    each block from what lies behind it. Nothing is shuffled or written.
    """

    def __init__(self, rows: DataFrame, x: str, model: str, stratum: Sequence[str], time: str = "time",
                 event: str = "event", cuts: Sequence[float] | None = None):
        keys = ["_m", *[f"_s{i}" for i in range(len(stratum))]]
        renamed = [F.coalesce(F.col(s).cast("string"), F.lit("\0")).alias(f"_s{i}") for i, s in enumerate(stratum)]  # rows without a stratum are one
        rows = rows.select(
            F.col(model).cast("int").alias("_m"), F.col(x).cast("array<double>").alias("_x"), F.col(time).cast("double").alias("_t"),
            F.col(event).cast("double").alias("_e"), *renamed,
        )
        self.d = width(rows, "_x")
        times = stable(rows.groupBy(*keys, "_t").agg(F.count("*").alias("n")))
        self.n = {r["_m"]: r["n"] for r in times.groupBy("_m").agg(F.sum("n").alias("n")).collect()}
        step = max(RANGE_ROWS, -(-sum(self.n.values()) // RANGES))
        before = prefix_sums(times, keys, "_t", {"c": F.col("n")}, cut_points(times, "_t") if cuts is None else list(cuts))
        alone = (F.col("c") > step).cast("int")
        placed = before.select(*keys, "_t", (F.floor(F.col("c_before") / step) * 2).cast("bigint").alias("_half"), alone.alias("_alone"))
        placed = stable(placed.withColumn("_range", F.col("_half") + F.col("_alone")).drop("_half"))
        # Ranges in the order of their times; one that stands alone comes where its time does.
        found = placed.groupBy(*keys, "_range", "_alone").agg(F.min("_t").alias("_first")).orderBy(*keys, "_first").toPandas()
        self.group = found.groupby(keys, dropna=False).ngroup().to_numpy()
        self.model = found["_m"].to_numpy(dtype=int)
        spark = rows.sparkSession
        found["_cell"] = np.arange(len(found))
        cells = spark.createDataFrame(found[["_cell", *keys, "_range"]], "_cell int, " + ", ".join(f"`{k}` {placed.schema[k].dataType.simpleString()}" for k in [*keys, "_range"]))
        numbered = placed.join(cells, [*keys, "_range"]).select("_cell", "_alone", *keys, "_t")
        laid = rows.join(numbered, [*keys, "_t"]).select("_cell", "_alone", "_t", "_e", "_x")
        ordered = laid.repartition("_cell").sortWithinPartitions("_cell", "_t")
        self.blocks = stable(ordered.mapInArrow(_lay_out, "_cell int, _alone int, _n int, _t binary, _e binary, _x binary"))

    def evaluate(self, betas: dict[int, np.ndarray], alphas: dict[int, float]) -> dict[int, tuple[float, np.ndarray]]:
        d, model = self.d, self.model
        context = self.blocks.sparkSession.sparkContext
        cells = [int(c) for c in np.flatnonzero(np.isin(model, list(betas)))]
        wanted = self.blocks if len(cells) == len(model) else self.blocks.filter(F.array_contains(F.lit(cells), F.col("_cell")))
        known = context.broadcast((model, betas))

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, coefficients = known.value
            for cell, _, _, _, x in _blocks(batches):
                eta = x @ coefficients[own[cell]]
                top = eta.max()
                share = np.exp(eta - top)
                yield pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.array([np.concatenate([[top, share.sum()], share @ x]).tobytes()], pa.binary())], names=["_cell", "_v"])

        whole = np.tile(np.concatenate([[-np.inf], np.zeros(d + 1)]), (len(model), 1))
        for row in wanted.mapInArrow(sums, "_cell int, _v binary").collect():
            whole[row["_cell"]] = _add_scaled(whole[row["_cell"]], np.frombuffer(row["_v"]))
        later = np.tile(np.concatenate([[-np.inf], np.zeros(d + 1)]), (len(model), 1))
        for c in range(len(model) - 2, -1, -1):
            if self.group[c] == self.group[c + 1]:
                later[c] = _add_scaled(later[c + 1], whole[c + 1])
        sent = context.broadcast((later, whole))

        def gradients(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            (own, coefficients), (behind, all_) = known.value, sent.value
            held: dict[int, np.ndarray] = {}
            for cell, alone, t, e, x in _blocks(batches):
                m = int(own[cell])
                eta = x @ coefficients[m]
                rest = _add_scaled(behind[cell], all_[cell]) if alone else behind[cell]
                top = max(rest[0], eta.max())
                scale = np.exp(rest[0] - top) if np.isfinite(rest[0]) else 0.0
                if alone:  # one time: everyone here and behind is at risk
                    at_risk = np.full(len(t), rest[1] * scale)
                else:
                    share = np.exp(eta - top)
                    first = np.searchsorted(t, t)  # the first row of each time
                    at_risk = (np.cumsum(share[::-1])[::-1] + rest[1] * scale)[first]
                inverse = np.where(e > 0, e / at_risk, 0.0)
                pull = e @ x - rest[2:] * (scale * inverse.sum())
                if not alone:
                    until = np.searchsorted(t, t, side="right") - 1
                    pull = pull - (share * np.cumsum(inverse)[until]) @ x
                add = np.concatenate([[(e * (eta - top - np.log(at_risk))).sum()], pull])
                held[m] = held[m] + add if m in held else add
            for m, v in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([m], pa.int32()), pa.array([v.tobytes()], pa.binary())], names=["_m", "_v"])

        totals = {m: np.zeros(d + 1) for m in betas}
        for row in wanted.mapInArrow(gradients, "_m int, _v binary").collect():  # one row per task and model
            totals[row["_m"]] += np.frombuffer(row["_v"])
        known.destroy()
        sent.destroy()
        out = {}
        for m, v in totals.items():
            beta, alpha = betas[m], alphas[m]
            out[m] = (float(-v[0] / self.n[m] + 0.5 * alpha * beta @ beta), -v[1:] / self.n[m] + alpha * beta)
        return out


def _add_scaled(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums kept as (top, values / exp(top))."""
    top = max(a[0], b[0])
    if not np.isfinite(top):
        return a
    return np.concatenate([[top], a[1:] * np.exp(a[0] - top) + b[1:] * np.exp(b[0] - top)])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for r in range(batch.num_rows):
            cell, alone, n = (batch.column(k)[r].as_py() for k in range(3))
            t, e, x = (np.frombuffer(batch.column(k)[r].as_buffer()) for k in (3, 4, 5))
            yield cell, alone, t, e, x.reshape(n, -1)


def _lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of one range each from rows in order; a range of one time is cut after RANGE_ROWS rows."""
    held: list[tuple] = []

    def block() -> pa.RecordBatch:
        t, e, x = (np.concatenate([h[k] for h in held]) for k in (2, 3, 4))
        cell, alone = held[0][:2]
        held.clear()
        cells = [pa.array([v.tobytes()], pa.binary()) for v in (t, e, x)]
        return pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.array([alone], pa.int32()), pa.array([len(t)], pa.int32()), *cells], names=["_cell", "_alone", "_n", "_t", "_e", "_x"])

    for batch in batches:
        cell, alone, t, e = (np.asarray(batch.column(k)) for k in range(4))
        x = np.asarray(batch.column(4).flatten()).reshape(len(cell), -1)
        edges = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]
        for a, b in zip(edges[:-1], edges[1:]):
            for at in range(a, b, RANGE_ROWS):
                to = min(b, at + RANGE_ROWS)
                if held and (held[0][0] != cell[at] or alone[at] and sum(len(h[2]) for h in held) >= RANGE_ROWS):
                    yield block()
                held.append((int(cell[at]), int(alone[at]), t[at:to].astype(float), e[at:to].astype(float), x[at:to]))
    if held:
        yield block()


def cox_objective(rows: DataFrame, x: str, stratum: Sequence[str], beta: np.ndarray, alpha: float, **names) -> tuple[float, np.ndarray]:
    """(loss, gradient) of one model at `beta`."""
    job = CoxJob(rows.withColumn("_one", F.lit(0)), x, "_one", stratum, **names)
    return job.evaluate({0: np.asarray(beta, dtype=np.float64)}, {0: alpha})[0]


def lbfgs(start: np.ndarray, max_iter: int = 100, tol: float = 1e-5, memory: int = 10):
    """L-BFGS with backtracking as a coroutine: yields a point, is sent its (loss, gradient), returns the minimiser."""
    beta = start.copy()
    loss, grad = yield beta
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(max_iter):
        if np.abs(grad).max() < tol:
            break
        q, used = grad.copy(), []
        for s, y in reversed(steps):
            used.append((s @ q) / (y @ s))
            q -= used[-1] * y
        if steps:
            s, y = steps[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), a in zip(steps, reversed(used), strict=True):
            q += (a - (y @ q) / (y @ s)) * s
        direction, slope, size = -q, -(grad @ q), 1.0
        if slope >= 0:
            direction, slope = -grad, -(grad @ grad)
        while True:
            trial = beta + size * direction
            new_loss, new_grad = yield trial
            if new_loss <= loss + 1e-4 * size * slope or size < 1e-8:
                break
            size /= 2
        s, y = trial - beta, new_grad - grad
        settled = abs(loss - new_loss) <= 1e-9 * max(1.0, abs(loss))
        beta, loss, grad = trial, new_loss, new_grad
        if s @ y > 1e-12:
            steps = [*steps[-memory + 1 :], (s, y)]
        if settled:
            break
    return beta


def fit_models(job: CoxJob, alphas: dict[int, float], starts: dict[int, np.ndarray] | None = None, max_iter: int = 100) -> dict[int, np.ndarray]:
    """Every model's coefficients; the models step together, one job per step."""
    starts = starts or {}
    runs = {m: lbfgs(starts.get(m, np.zeros(job.d)), max_iter) for m in alphas}
    points = {m: next(run) for m, run in runs.items()}
    done: dict[int, np.ndarray] = {}
    while points:
        values = job.evaluate(points, alphas)
        moved = {}
        for m, value in values.items():
            try:
                moved[m] = runs[m].send(value)
            except StopIteration as stop:
                done[m] = stop.value
        points = moved
    return done


def fit_cox(rows: DataFrame, x: str, stratum: Sequence[str], alpha: float, time: str = "time", event: str = "event",
            start: np.ndarray | None = None, max_iter: int = 100) -> np.ndarray:
    """Coefficients of one stratified ridge Cox model."""
    job = CoxJob(rows.withColumn("_one", F.lit(0)), x, "_one", stratum, time, event)
    return fit_models(job, {0: alpha}, None if start is None else {0: start}, max_iter)[0]


def select_alphas(rows: DataFrame, x: str, model: str, stratum: Sequence[str], row: str, alphas: Sequence[float] = COX_ALPHAS,
                  n_folds: int = INNER_FOLDS, seed: int = 0, time: str = "time", event: str = "event",
                  max_iter: int = 100) -> dict[int, float]:
    """Per model, the penalty with the best held-out C over inner folds: strongest first, until C first falls.

    Inner folds come from a hash of the row. All inner folds of all models step
    together, each warm-starting its next penalty.
    """
    inner = F.pmod(md5_hash("inner", seed, F.col(row)), F.lit(n_folds)).cast("int")
    others = F.filter(F.array(*[F.lit(i) for i in range(n_folds)]), lambda i: i != F.col("_inner"))
    marked = stable(rows.withColumn("_inner", inner))
    fitting = marked.withColumn("_other", F.explode(others))
    fitting = stable(fitting.withColumn("_pair", F.col(model) * n_folds + F.col("_other")))
    job = CoxJob(fitting, x, "_pair", stratum, time, event)
    held = marked.withColumn("_pair", F.col(model) * n_folds + F.col("_inner"))
    active = {p // n_folds for p in job.n}
    best: dict[int, tuple[float, float]] = {}
    starts: dict[int, np.ndarray] = {}
    for alpha in sorted(alphas, reverse=True):
        wanted = {p: alpha for p in job.n if p // n_folds in active}
        starts.update(fit_models(job, wanted, starts, max_iter))
        scored = risks_by_model(held.filter(F.col("_pair").isin(*wanted)), x, "_pair", {p: starts[p] for p in wanted})
        sums = concordance_sums(scored, [model, "_pair", *stratum], time, event, "risk")
        for r in sums.groupBy(model).agg(F.sum("concordant").alias("c"), F.sum("pairs").alias("p")).collect():
            c = r["c"] / max(r["p"], 1.0)
            if r[model] in best and c <= best[r[model]][1]:
                active.discard(r[model])
            else:
                best[r[model]] = (alpha, c)
        if not active:
            break
    return {m: a for m, (a, _) in best.items()}


def risks_by_model(rows: DataFrame, x: str, model: str, betas: dict[int, np.ndarray], out: str = "risk") -> DataFrame:
    """Rows with the linear predictor of their model."""
    names = rows.columns

    def dots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for m, part in batch.groupby(model):
                yield part[names].assign(**{out: stack(part[x]) @ betas[int(m)]})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(dots, f"{fields}, `{out}` double")


def survival_scores(scored: DataFrame, weights: DataFrame, endpoint: str, split: str, alpha: float,
                    case: str = "case", group: str = "project") -> tuple[DataFrame, DataFrame]:
    """The summary row and one row per group, from the same draws.

    `scored` has (case, group, fold, time, event, risk); pairs form inside a
    (fold, group), and a group pools its pairs over folds.
    """
    from tidyfold.operators.bootstrap import summarize

    pooled, by_group = stratified_concordance(scored, weights, case, ["fold", group], group)
    counts = scored.groupBy(group).agg(F.count("*").alias("patients"), F.sum(F.col("event").cast("int")).alias("events"))
    head = [F.lit(endpoint).alias("endpoint"), F.lit(split).alias("split")]
    overall = counts.agg(
        F.sum("patients").alias("patients"), F.sum("events").alias("events"),
        F.sum((F.col("events") >= MACRO_MIN_EVENTS).cast("int")).alias("projects"),
    )
    tagged = pooled.withColumn("_k", F.lit(0))
    summary = summarize(tagged, ["_k"], ["c_index", "c_index_macro"])
    pairs = tagged.filter("replicate = 0").select("_k", F.round("pairs").cast("bigint").alias("pairs"))
    summary = overall.withColumn("_k", F.lit(0)).join(pairs, "_k").join(summary, "_k").drop("_k")
    summary = summary.select(*head, F.lit(alpha).alias("alpha"), "*")
    group_pairs = by_group.filter("replicate = 0").select(group, F.round("pairs").cast("bigint").alias("pairs"))
    projects = counts.join(group_pairs, group).join(summarize(by_group, [group], ["c_index"]), group)
    return summary, projects.select(*head, "*")
