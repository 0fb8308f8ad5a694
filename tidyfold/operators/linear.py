"""Linear fits whose cluster work is a Gram matrix of bounded width.

Rows stay on executors: each task reduces its rows to d x d sums, a vector
aggregate adds them, and the driver solves the d x d problem. `MAX_WIDTH`
bounds d, so what reaches the driver never grows with the rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyfold.operators import blocks

MAX_WIDTH = 8192
# Entries of the smaller side of a matrix whose every singular value is asked for: what the driver decomposes.
MAX_SIDE = 16_384
# Target columns of a ridge that are solved at once.
TARGETS = 1024
# The penalty grid of the ridge probes.
ALPHAS = (0.01, 0.1, 1.0, 10.0, 100.0, 1000.0, 10000.0)


def width(df: DataFrame, column: str) -> int:
    """The common length of an array column; a ragged column is an error."""
    high = width_of(df, column)
    if not 1 <= high <= MAX_WIDTH:
        raise ValueError(f"{column} has {high} entries; expected 1 to {MAX_WIDTH}")
    return high


def width_of(df: DataFrame, column: str) -> int:
    """The common length of an array column, without the bound on d x d sums."""
    low, high = df.agg(F.min(F.size(column)), F.max(F.size(column))).first()
    if low != high:
        raise ValueError(f"{column} is ragged: {low} to {high} entries")
    return int(high or 0)


def stack(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column]) if len(column) else np.zeros((0, 0))


#: Numbers that a task turns from lists into rows of a matrix at once.
CUT_CELLS = 1 << 18


def cut(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Arrow batches in pieces whose rows of `width` numbers are CUT_CELLS at most, so that a worker's memory doesn't follow the batch."""
    step = max(1, CUT_CELLS // max(1, width))
    for batch in batches:
        yield from (batch.slice(lo, step) for lo in range(0, batch.num_rows, step))


def matrix_of(column: pa.Array) -> np.ndarray:
    """An Arrow column of lists of numbers, all of one length, as the rows of a matrix."""
    sizes = np.diff(np.asarray(column.offsets))
    if column.null_count or (sizes != sizes[:1]).any():
        raise ValueError("vectors are ragged, or null")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def lists(rows: np.ndarray) -> pa.Array:
    """A matrix as an Arrow column of lists; NaN is null."""
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(rows, dtype=np.float64).ravel(), from_pandas=True))


def rows_scaled(x: np.ndarray, centre: bool = False) -> np.ndarray:
    """Rows, centred if asked for, at unit length; a row without length stays zero."""
    x = x - x.mean(axis=1, keepdims=True) if centre else x
    return np.divide(x, np.sqrt(np.einsum("ij,ij->i", x, x))[:, None], out=np.zeros_like(x), where=(x != 0).any(axis=1)[:, None])


def moments(df: DataFrame, left: str, right: str, key: str | None = None) -> dict:
    """Per key: n, sums of both sides, and the cross products leftᵀ[left | right].

    Every task emits one row per key and left dimension; the vector sum happens
    in the JVM with map-side partials.
    """
    cols = [left] if right == left else [left, right]
    source = df.select(*([F.col(key).cast("int").alias("_k")] if key else [F.lit(0).alias("_k")]), *cols)

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, part in batch.groupby("_k"):
                x = stack(part[left])
                both = x if right == left else np.hstack([x, stack(part[right])])
                ones = np.ones((len(x), 1))
                add = np.hstack([ones, x]).T @ np.hstack([ones, both])
                held[k] = held[k] + add if k in held else add
        for k, table in held.items():
            yield pd.DataFrame({"_k": k, "_i": np.arange(len(table)), "_row": list(table)})

    parts = source.mapInPandas(reduce, "_k int, _i int, _row array<double>")
    summed = parts.groupBy("_k", "_i").agg(vector_to_array(Summarizer.sum(array_to_vector("_row"))).alias("_row"))
    out: dict = {}
    for k, rows in summed.toPandas().groupby("_k"):
        table = stack(rows.sort_values("_i")["_row"])
        d = len(table) - 1
        n, sum_l, sum_b = table[0, 0], table[1:, 0], table[0, 1:]
        out[int(k)] = {"n": n, "left": sum_l, "both": sum_b, "cross": table[1:, 1:], "d": d}
    return out


def covariance(m: dict) -> np.ndarray:
    """Centred cross products of the left side with itself."""
    d = m["d"]
    return m["cross"][:, :d] - np.outer(m["left"], m["left"]) / m["n"]


def spectrum_scores(cov: np.ndarray) -> tuple[float, float]:
    """Effective rank and top share of covariance eigenvalues."""
    values = np.clip(np.linalg.eigvalsh(cov), 0.0, None)
    # Entropy of the shares v / total is log(total) - sum(v log v) / total.
    total, logs = values.sum(), np.log(values, out=np.zeros_like(values), where=values > 0)
    return float(total * np.exp(-(values @ logs) / total)), float(values[-1] / total)


def spectrum(df: DataFrame, vector: str, key: str | None = None) -> DataFrame:
    """(key, effective_rank, top_eigenvalue_share)."""
    width(df, vector)
    rows = [(k, *spectrum_scores(covariance(m))) for k, m in sorted(moments(df, vector, vector, key).items())]
    table = df.sparkSession.createDataFrame(
        rows, f"{key or '_k'} int, effective_rank double, top_eigenvalue_share double"
    )
    return table if key else table.drop("_k")


def singular_values(packed: blocks.Blocks, column: str) -> np.ndarray:
    """All singular values of the packed rows, largest first, from the products of the smaller side, which MAX_SIDE bounds."""
    d, rows = packed.widths[column], sum(packed.rows.values())
    if min(d, rows) > MAX_SIDE:
        raise ValueError(f"all singular values of {rows} x {d}: the smaller side has more than {MAX_SIDE} entries")
    product = blocks.small_gram(packed, column) if rows < d else sum(g[1:, 1:] for g in blocks.gram(packed, column).values())
    return np.sqrt(np.clip(np.linalg.eigvalsh(product)[::-1], 0.0, None))


def affine(df: DataFrame, vector: str, offset: np.ndarray, matrix: np.ndarray, out: str) -> DataFrame:
    """Rows with `out` = (vector - offset) @ matrix, in Arrow batches."""
    names = df.columns
    place = names.index(vector)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches, len(offset)):
            yield pa.RecordBatch.from_arrays([*batch.columns, lists((matrix_of(batch.column(place)) - offset) @ matrix)], names=[*names, out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(apply, f"{fields}, `{out}` array<double>")


def fixed_signs(axes: np.ndarray) -> np.ndarray:
    """Axes whose largest absolute loading is positive."""
    signs = np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
    return axes * np.where(signs == 0, 1.0, signs)


def pca_axes(packed: blocks.Blocks, column: str, uses: dict[int, Sequence[int]], k: int, seed: int = 0) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(mean, d x k axes) per fit, each fit on the rows of the keys it uses; all fits share their passes, whatever the width."""
    d = packed.widths[column]
    sums = packed.total([column], lambda key, x: x.sum(axis=0)[None], 1)
    means = {f: sum(sums[k][0] for k in keys) / sum(packed.rows[k] for k in keys) for f, keys in uses.items()}
    found = blocks.leading_of_each(lambda asked: blocks.centred_pass(packed, column, means, uses, asked), d, min(k, d), sorted(uses), seed)
    return {f: (means[f], fixed_signs(axes)) for f, (_, axes) in found.items()}


def pca_embeddings(df: DataFrame, vector: str, train: str, k: int = 256, out: str = "embedding") -> DataFrame:
    """PCA fit on the rows where `train` holds, applied to every row."""
    packed = blocks.pack(df.filter(F.col(train)), [vector])
    mean, axes = pca_axes(packed, vector, {0: packed.keys}, k)[0]
    return affine(df, vector, mean, axes, out)


def standardiser(m: dict) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population deviation of the left side of moments; constants get 1."""
    sd = np.sqrt(np.clip(np.diag(covariance(m)) / m["n"], 0.0, None))
    return m["left"] / m["n"], np.where(sd > 1e-12, sd, 1.0)


class RidgeFit:
    """A standardised ridge: `predict` gives (x - mean) / sd @ coef + intercept."""

    def __init__(self, products: np.ndarray):
        n, total, cross = products[0, 0], products[0, 1:], products[1:, 1:]
        self.n, self.mean = n, total / n
        covariance_ = cross - np.outer(total, total) / n
        sd = np.sqrt(np.clip(np.diag(covariance_) / n, 0.0, None))
        self.sd = np.where(sd > 1e-12, sd, 1.0)  # constants get 1
        values, self.vectors = np.linalg.eigh(covariance_ / np.outer(self.sd, self.sd))
        self.values = np.clip(values, 0.0, None)
        self.alpha, self.errors, self.intercept, self.coef = None, None, None, None

    def predict(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.sd) @ self.coef + self.intercept


class Ridges(dict):
    """Fits by key. Their targets are handled in tiles of columns, so no task or driver holds all coefficients of many targets."""

    def __init__(self, packed: blocks.Blocks, x: str, y: str, targets: int):
        super().__init__()
        self.packed, self.x, self.y, self.targets, self._last = packed, x, y, targets, {}

    @property
    def tiles(self) -> list[tuple[int, int]]:
        return blocks.tiles(self.packed.widths[self.y], self.targets)

    def rotated(self, lo: int, hi: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Per key the mean of the target columns [lo, hi) and their products with x in its eigenbasis."""
        if (lo, hi) not in self._last:
            def product(k, x, y):
                return np.hstack([np.ones((len(x), 1)), x]).T @ y[:, lo:hi]

            sums = self.packed.total([self.x, self.y], product, self.packed.widths[self.x])
            out = {}
            for k, f in self.items():
                mean = sums[k][0] / f.n
                out[k] = mean, f.vectors.T @ ((sums[k][1:] - np.outer(f.mean * f.n, mean)) / f.sd[:, None])
            self._last = {(lo, hi): out}  # one tile is kept
        return self._last[lo, hi]

    def coefficients(self, lo: int, hi: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Per key (mean, sd, coef, intercept) of the target columns [lo, hi)."""
        return {k: (f.mean, f.sd, f.vectors @ (self.rotated(lo, hi)[k][1] / (f.values + f.alpha)[:, None]), self.rotated(lo, hi)[k][0]) for k, f in self.items()}


def fit_ridges(df: DataFrame, x: str, y: str, key: str, alphas: Sequence[float] = ALPHAS, targets: int = TARGETS) -> Ridges:
    """One multi-target ridge per key, its penalty chosen by leave-one-out error over all targets.

    The rows' products give each key an eigenbasis. Then, for each tile of
    `targets` columns, one pass sums its products with x and another scores every
    row's left-out residual for every penalty from its leverage
    1/n + xᵀ(G + αI)⁻¹x, without refitting; the squares add up over the tiles.
    What the driver and a task hold is d x d and d x targets, however many
    targets there are. Targets are an array column.
    """
    d, t = width(df, x), width_of(df, y)
    alphas = tuple(float(a) for a in alphas)
    fits = Ridges(blocks.pack(df, [x, y], F.col(key)), x, y, targets)
    for k, products in blocks.gram(fits.packed, x).items():
        fits[k] = RidgeFit(products)
    lost = {k: np.zeros(len(alphas)) for k in fits}
    means = {k: [] for k in fits}

    def errors(k, sent, rows, target):
        f, (mean, rotated), (lo, hi) = sent["fits"][k], sent["rotated"][k], sent["tile"]
        turned = ((rows - f.mean) / f.sd) @ f.vectors
        target, out = target[:, lo:hi] - mean, np.zeros((len(alphas), 1))
        for j, a in enumerate(alphas):
            shrunk = turned / (f.values + a)
            lever = 1.0 / f.n + (turned * shrunk).sum(axis=1)
            left = (target - shrunk @ rotated) / np.maximum(1.0 - lever, 1e-12)[:, None]
            out[j] = (left**2).sum()
        return out

    at_once = max(1, blocks.CELLS // (d * (d + targets)))
    for lo, hi in fits.tiles:
        found = fits.rotated(lo, hi)
        for keys in (list(fits)[a : a + at_once] for a in range(0, len(fits), at_once)):
            sent = {"fits": {k: fits[k] for k in keys}, "rotated": {k: found[k] for k in keys}, "tile": (lo, hi)}
            for k, e in fits.packed.only(keys).total([x, y], errors, d, sent).items():
                lost[k] += e[:, 0]
        for k in fits:
            means[k].append(found[k][0])
    for k, f in fits.items():
        f.alpha, f.errors, f.intercept = alphas[int(np.argmin(lost[k]))], lost[k] / (f.n * t), np.concatenate(means[k])
    if len(fits.tiles) == 1:
        for k, (_, _, coef, _) in fits.coefficients(0, t).items():
            fits[k].coef = coef
    return fits


def predict_ridges(df: DataFrame, fits: Ridges, x: str, key: str, out: str = "pred") -> DataFrame:
    """Rows with the key's ridge predictions as an array, made tile by tile of the targets."""
    names, parts = df.columns, [f"_p{j}" for j in range(len(fits.tiles))]
    for part, (lo, hi) in zip(parts, fits.tiles, strict=True):
        df = _predicted(df, df.sparkSession.sparkContext.broadcast(fits.coefficients(lo, hi)), x, key, part)
    return df.select(*names, F.concat(*parts).alias(out))


def _predicted(df: DataFrame, sent, x: str, key: str, out: str) -> DataFrame:
    names = df.columns

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, part in batch.groupby(key):
                mean, sd, coef, intercept = sent.value[int(k)]
                part = part.copy()
                part[out] = list(((stack(part[x]) - mean) / sd) @ coef + intercept)
                yield part[[*names, out]]

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(apply, f"{fields}, `{out}` array<double>")


def fit_linear_probe(train: DataFrame, x: str, label: str, max_iter: int = 2000):
    """Standardise, then an L2 logistic regression at C = 1, as a fitted Spark ML pipeline.

    The usual objective sums the loss and adds |w|^2 / 2; Spark averages the
    loss, so the same fit has regParam = 1/n.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import Vectors
    from pyspark.ml.feature import ElementwiseProduct, IndexToString, StandardScaler, StringIndexer

    ready = train.withColumn("_x", array_to_vector(F.transform(x, lambda v: v.cast("double")))).withColumn(
        "_label", F.col(label).cast("string")
    )
    n = ready.count()
    indexer = StringIndexer(inputCol="_label", outputCol="_y", stringOrderType="alphabetAsc").fit(ready)
    stages = [
        indexer,
        StandardScaler(inputCol="_x", outputCol="_s", withMean=True, withStd=True),
        # Spark's scaler divides by the sample deviation; the probe by the population's.
        ElementwiseProduct(inputCol="_s", outputCol="_z", scalingVec=Vectors.dense([math.sqrt(n / max(1, n - 1))] * width(train, x))),
        LogisticRegression(featuresCol="_z", labelCol="_y", predictionCol="_c", rawPredictionCol="_raw", probabilityCol="_prob",
                           maxIter=max_iter, regParam=1.0 / n, elasticNetParam=0.0, standardization=False, tol=1e-6),
        IndexToString(inputCol="_c", outputCol="pred", labels=indexer.labels),
    ]
    return Pipeline(stages=stages).fit(ready)


def predict_linear_probe(model, rows: DataFrame, x: str) -> DataFrame:
    """Rows with `pred`, the predicted label as text."""
    from pyspark.ml import PipelineModel

    ready = rows.withColumn("_x", array_to_vector(F.transform(x, lambda v: v.cast("double"))))
    return PipelineModel(model.stages[1:]).transform(ready).drop("_x", "_s", "_z", "_raw", "_prob", "_c")
