"""Row matrices as packed blocks, and sums over them that run as tasks.

A table of array columns is written once as blocks of rows of one key, each
array column as the bytes of a rows x width matrix. Every pass then reads bytes
instead of lists. A pass adds what its function makes of each block into one
matrix per key, inside the task; the tasks' rows are added in the JVM. A task
takes at least as many rows as the sums have, so that partial sums don't
outweigh the rows they come from.
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidyfold.session import stable

#: Rows of a block at most, and bytes of its widest column that end one earlier.
ROWS, BYTES = 1024, 8 << 20
#: Columns whose sums a task holds at once: TILE x width numbers per key.
TILE = 1024
#: Cells of square matrices by key that are handled in one pass.
CELLS = 32_000_000


def tiles(width: int, tile: int) -> list[tuple[int, int]]:
    return [(lo, min(lo + tile, width)) for lo in range(0, width, tile)]


class Blocks:
    """Packed rows: `_k` (key), `_n` (rows), and one bytes column per packed array; `numbers` has what is known of each key."""

    def __init__(self, table: DataFrame, widths: dict[str, int], rows: dict[int, int]):
        self.table, self.widths, self.rows = table, widths, rows

    @property
    def keys(self) -> list[int]:
        return sorted(self.rows)

    def only(self, keys: Sequence[int]) -> Blocks:
        return Blocks(self.table.filter(F.col("_k").isin(list(keys))), self.widths, {k: self.rows[k] for k in keys})

    def tasks(self, height: int) -> DataFrame:
        """The blocks in as many tasks as `height` rows each allow."""
        most = max(1, sum(self.rows.values()) // max(1, height))
        return self.table.coalesce(most) if most < self.table.sparkSession.sparkContext.defaultParallelism else self.table

    def total(self, columns: Sequence[str], fn: Callable, height: int, shared=None) -> dict[int, np.ndarray]:
        """Per key the sum over blocks of fn(key, *matrices), a matrix of `height` rows; with `shared`, fn(key, shared value, *matrices)."""
        context = self.table.sparkSession.sparkContext
        sent = context.broadcast(shared) if shared is not None else None

        def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, np.ndarray] = {}
            for batch in batches:
                for r in range(batch.num_rows):
                    k, *parts = block_of(batch, r)
                    add = fn(k, *parts) if sent is None else fn(k, sent.value, *parts)
                    if k in held:
                        held[k] += add
                    else:
                        held[k] = np.array(add, dtype=np.float64)
            for k, sums in held.items():
                for lo in range(0, len(sums), 256):
                    piece = sums[lo : lo + 256]
                    lists = pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(piece).ravel()), piece.shape[1]).cast(pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(piece), k, np.int32)), pa.array(np.arange(lo, lo + len(piece), dtype=np.int32)), lists], names=["_k", "_i", "_row"])

        parts = self.tasks(height).select("_k", "_n", *columns).mapInArrow(reduce, "_k int, _i int, _row array<double>")
        summed = parts.groupBy("_k", "_i").agg(vector_to_array(Summarizer.sum(array_to_vector("_row"))).alias("_row")).toArrow()
        if sent is not None:
            sent.destroy()
        key, at = np.asarray(summed.column("_k")), np.asarray(summed.column("_i"))
        flat = np.asarray(summed.column("_row").combine_chunks().flatten()).reshape(len(key), -1) if len(key) else np.zeros((0, 0))
        return {int(k): flat[key == k][np.argsort(at[key == k])] for k in np.unique(key)}


def block_of(batch: pa.RecordBatch, r: int) -> list:
    """[key, matrix, ...] of one row of packed blocks."""
    n = batch.column(1)[r].as_py()
    return [batch.column(0)[r].as_py(), *(np.frombuffer(c[r].as_buffer(), np.float64).reshape(n, -1) if n else np.zeros((0, 0)) for c in batch.columns[2:])]


def pack(df: DataFrame, columns: Sequence[str], key: Column | None = None) -> Blocks:
    """`df`'s array columns as blocks, written to the shared folder. Ragged columns are an error."""
    doubles = [F.col(c).cast("array<double>").alias(c) for c in columns]
    rows = df.select((F.lit(0) if key is None else key).cast("int").alias("_k"), *doubles)
    names = ["_k", "_n", *columns, *(f"_w{c}" for c in columns)]

    def bind(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key_of = np.asarray(batch.column(0))
            lists = [batch.column(1 + c) for c in range(len(columns))]
            sizes = [np.diff(np.asarray(x.offsets)) for x in lists]
            for x, s, name in zip(lists, sizes, columns):
                if x.null_count or x.values.null_count or (len(s) and (s != s[0]).any()):
                    raise ValueError(f"{name} is ragged, or holds nulls")
            matrices = [np.asarray(x.flatten()).reshape(len(key_of), -1) for x in lists]
            step = max(1, min(ROWS, BYTES // (8 * max([1, *(m.shape[1] for m in matrices)])))) if len(key_of) else 1
            for k in np.unique(key_of):
                some = np.flatnonzero(key_of == k)
                for at in range(0, len(some), step):
                    own = some[at : at + step]
                    cells = [pa.array([np.ascontiguousarray(m[own]).tobytes()], pa.binary()) for m in matrices]
                    widths = [pa.array([m.shape[1]], pa.int32()) for m in matrices]
                    yield pa.RecordBatch.from_arrays([pa.array([int(k)], pa.int32()), pa.array([len(own)], pa.int32()), *cells, *widths], names=names)

    fields = ", ".join(["_k int", "_n int", *(f"`{c}` binary" for c in columns), *(f"`_w{c}` int" for c in columns)])
    table = stable(rows.mapInArrow(bind, fields))
    known = table.groupBy("_k").agg(F.sum("_n").alias("n"), *[f(f"_w{c}").alias(f"{w}{c}") for c in columns for w, f in (("low", F.min), ("high", F.max))]).collect()
    widths = {}
    for c in columns:
        found = {r[f"{w}{c}"] for r in known for w in ("low", "high")}
        if len(found) > 1:
            raise ValueError(f"{c} is ragged: {min(found)} to {max(found)} entries")
        widths[c] = found.pop() if found else 0
    return Blocks(table.select("_k", "_n", *columns), widths, {r["_k"]: r["n"] for r in known})


def gram(blocks: Blocks, column: str, tile: int = TILE) -> dict[int, np.ndarray]:
    """Per key the (1 + d) x (1 + d) products of [1 | x] with itself, tile of rows by tile."""
    d = blocks.widths[column] + 1
    out: dict[int, np.ndarray] = {}
    at_once = max(1, CELLS // (d * d))
    for keys in (blocks.keys[a : a + at_once] for a in range(0, len(blocks.keys), at_once)):
        for lo, hi in tiles(d, tile):
            def product(k, x, lo=lo, hi=hi):
                x = np.hstack([np.ones((len(x), 1)), x])
                return x[:, lo:hi].T @ x

            for k, rows in blocks.only(keys).total([column], product, hi - lo).items():
                out.setdefault(k, np.zeros((d, d)))[lo:hi] = rows
    return out


def small_gram(blocks: Blocks, column: str) -> np.ndarray:
    """x xᵀ over all rows (any order), as a grid of block pairs: each pair of blocks meets in one task."""
    numbered = stable(blocks.table.select(F.monotonically_increasing_id().alias("_b"), "_n", F.col(column).alias("_x")))
    ids = [r[0] for r in numbered.select("_b", "_n").orderBy("_b").collect()]  # one row per block
    sizes = {r["_b"]: r["_n"] for r in numbered.select("_b", "_n").collect()}
    starts, at = {}, 0
    for b in ids:
        starts[b], at = at, at + sizes[b]
    places = numbered.sparkSession.createDataFrame([(i, b, ids[j]) for i, b in enumerate(ids) for j in range(i + 1)], "_i int, _a long, _c long")
    left = places.join(numbered.select(F.col("_b").alias("_a"), F.col("_n").alias("_na"), F.col("_x").alias("_xa")), "_a")
    both = left.join(numbered.select(F.col("_b").alias("_c"), F.col("_n").alias("_nc"), F.col("_x").alias("_xc")), "_c")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                a, c, na, nc = (batch.column(k)[r].as_py() for k in range(4))
                x, y = (np.frombuffer(batch.column(k)[r].as_buffer(), np.float64).reshape(n, -1) for k, n in ((4, na), (5, nc)))
                yield pa.RecordBatch.from_arrays([pa.array([a]), pa.array([c]), pa.array([(x @ y.T).tobytes()], pa.binary())], names=["_a", "_c", "_p"])

    out = np.zeros((at, at))
    for row in both.select("_a", "_c", "_na", "_nc", "_xa", "_xc").mapInArrow(meet, "_a long, _c long, _p binary").toLocalIterator():
        piece = np.frombuffer(row["_p"], np.float64).reshape(sizes[row["_a"]], sizes[row["_c"]])
        i, j = starts[row["_a"]], starts[row["_c"]]
        out[i : i + piece.shape[0], j : j + piece.shape[1]] = piece
        out[j : j + piece.shape[1], i : i + piece.shape[0]] = piece.T
    return out


#: Cells of the Krylov basis and its image; columns of its blocks at least; relative residual of what is found.
BASIS_CELLS, BLOCK, RESIDUAL = 60_000_000, 64, 1e-9


def lanczos(n: int, k: int, seed: int = 0, tol: float = RESIDUAL, most: int = 400) -> Generator[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """(values, n x k vectors) of the k largest eigenpairs of a positive semidefinite operator, by block Lanczos.

    Yields n x b matrices and is sent the operator's images of them. Every new
    block is orthogonalised against the whole basis, twice. The basis grows
    until each wanted pair has a residual of at most `tol` times the largest
    value; it is restarted from the best vectors when it would exceed
    BASIS_CELLS. A basis that spans everything is exact.
    """
    k = min(k, n)
    width = min(n, max(k + 8, BLOCK))
    room = max(3 * width, min(n, BASIS_CELLS // (2 * n)))
    draw = np.random.default_rng(seed)
    q, _ = np.linalg.qr(draw.standard_normal((n, width)))
    image = yield q
    for _ in range(most):
        inner = q.T @ image
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        top = max(float(values[0]), 1e-300)
        residual = image @ turn[:, :k] - q @ (turn[:, :k] * values[:k])
        if q.shape[1] == n or (np.sqrt((residual**2).sum(axis=0)) <= tol * top).all():
            return values[:k], q @ turn[:, :k]
        if q.shape[1] + width > room:  # the best vectors and their images stay
            kept = turn[:, : k + width // 2]
            q, image = q @ kept, image @ kept
        fresh = _beside(q, np.hstack([residual, image[:, -width:]]))
        left, sizes, _ = np.linalg.svd(fresh, full_matrices=False)
        fresh = left[:, sizes > 1e-12 * top][:, : min(width, n - q.shape[1])]
        if fresh.shape[1] == 0:  # an invariant space: on with new directions
            fresh = draw.standard_normal((n, min(width, n - q.shape[1])))
        fresh, _ = np.linalg.qr(_beside(q, fresh))
        more = yield fresh
        q, image = np.hstack([q, fresh]), np.hstack([image, more])
    raise RuntimeError(f"no {k} pairs with residual {tol} after {most} blocks")


def _beside(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """What of x is orthogonal to the basis q."""
    for _ in range(2):
        x = x - q @ (q.T @ x)
    return x


def leading_of_each(apply: Callable[[dict[int, np.ndarray]], dict[int, np.ndarray]], n: int, k: int, names: Sequence[int], seed: int = 0) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The k largest eigenpairs of several operators; all that aren't done yet take a step in one call of `apply`."""
    runs = {name: lanczos(n, k, seed) for name in names}
    asked, found = {name: next(run) for name, run in runs.items()}, {}
    while asked:
        images, following = apply(asked), {}
        for name in asked:
            try:
                following[name] = runs[name].send(images[name])
            except StopIteration as done:
                found[name] = done.value
        asked = following
    return found


def leading(apply: Callable[[np.ndarray], np.ndarray], n: int, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenpairs of one operator that maps n x b to n x b."""
    return leading_of_each(lambda asked: {0: apply(asked[0])}, n, k, [0], seed)[0]


def centred_pass(blocks: Blocks, column: str, means: dict[int, np.ndarray], uses: dict[int, Sequence[int]], asked: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Per fit f of `asked`: the sum over rows of the keys uses[f] of (x - mean) ((x - mean)ᵀ asked[f]); one pass for all fits."""
    order = sorted(asked)
    edges = np.cumsum([0, *(asked[f].shape[1] for f in order)])

    def product(k, sent, x):
        out = np.zeros((x.shape[1], edges[-1]))
        for j, f in enumerate(order):
            if k in sent["uses"][f]:
                c = x - sent["means"][f]
                out[:, edges[j] : edges[j + 1]] = c.T @ (c @ sent["asked"][f])
        return out

    n = blocks.widths[column]
    used = blocks.only([k for k in blocks.keys if any(k in uses[f] for f in order)])
    sums = used.total([column], product, n, {"uses": uses, "means": means, "asked": asked})
    whole = sum(sums.values(), np.zeros((n, edges[-1])))
    return {f: whole[:, edges[j] : edges[j + 1]] for j, f in enumerate(order)}
