"""Exact top-k inner products with MaxScore over sharded component postings.

Each dimension is a query term; its contribution to a candidate lies between
bounds that a block's least and largest components give. In a block, a query's
dimensions are ordered by the spread of their bounds and split: the essential
ones are as few as possible so that candidates at the floor of all of them can't
reach the query's threshold even with the upper bounds of the rest. Essential
components are summed for all candidates; the others are probed in steps, each
time only for candidates whose sum and remaining upper bounds still reach the
threshold. Blocks whose total bound is below the threshold are skipped. Blocks go
by falling bound, so thresholds rise early. Shards' lists are merged by query.

All comparisons are between exact integers: sums are done in a float type only
where the largest possible sum is exactly representable, and in unbounded
integers where it may pass 64 bits; a score that does is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidyfold.llm.common import table

TOP, SCALE, EVERY = 20, 64, 20
#: Candidates of a shard and of a block in it, queries of a block.
SHARD_ROWS, BLOCK_ROWS, QUERY_ROWS = 8192, 1024, 16384

QUANTISED = "row long, vec_id long, whole binary, wide boolean"


def _quantise(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """floor(64 x) of each component, in 32 bits, or 64 where it needs them; vectors that are null or hold null or non-finite components go."""
    for part in parts:
        rows, ids, out, wide = [], [], [], []
        for row, i, x in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2)):
            if i is None or not x.is_valid or x.values.null_count:
                continue
            v = np.asarray(x.values, dtype=np.float64)
            if np.isfinite(v).all():
                with np.errstate(over="ignore"):
                    whole = np.floor(SCALE * v)  # exact: SCALE is a power of two
                if (np.abs(whole) >= 2.0**63).any():
                    raise OverflowError(f"vector {i}: {SCALE} x a component doesn't fit a long")
                whole = whole.astype(np.int64)
                big = bool((np.abs(whole) >= 2**31).any())
                rows.append(row), ids.append(i), wide.append(big)
                out.append((whole if big else whole.astype(np.int32)).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(ids, pa.int64()), pa.array(out, pa.binary()), pa.array(wide, pa.bool_())], names=["row", "vec_id", "whole", "wide"])


def _matrix(group: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    whole = [np.frombuffer(x.as_py(), np.int64 if w.as_py() else np.int32) for x, w in zip(group.column("whole"), group.column("wide"))]
    return np.asarray(group.column("row")), np.asarray(group.column("vec_id")), whole


def _pad(rows: list[np.ndarray], width: int, kind) -> np.ndarray:
    out = np.zeros((len(rows), width), dtype=kind)
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= edge)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))][:k]


def search(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int = TOP, block: int | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, scores) of each query's k best of the vectors (an exact type), its own id left out."""
    blocks, block = [], block or BLOCK_ROWS
    for at in range(0, len(ids), block):
        own = np.ascontiguousarray(vectors[at : at + block].T)
        blocks.append((ids[at : at + block], own, own.max(axis=1), own.min(axis=1)))
    highs, lows = np.stack([b[2] for b in blocks]), np.stack([b[3] for b in blocks])
    out = []
    for own_id, q in zip(query_ids, queries):
        upper, lower = np.maximum(highs * q, lows * q), np.minimum(highs * q, lows * q)
        reach = upper.sum(axis=1)
        kept_ids, kept, floor = np.zeros(0, np.int64), np.zeros(0, vectors.dtype), None
        for b in np.argsort(-reach, kind="stable"):
            if floor is not None and reach[b] < floor:
                break
            names, own = blocks[b][:2]
            if floor is None:
                some, sums = np.arange(len(names)), q @ own
            else:
                order = np.argsort(lower[b] - upper[b], kind="stable")
                up, low = upper[b][order], lower[b][order]
                rest = np.append(np.cumsum(up[::-1])[::-1], 0)  # upper bounds from each place on
                # Essential: the shortest front whose floor and the rest's bounds stay below the threshold.
                short = np.flatnonzero(np.cumsum(np.append(0, low)) + rest < floor)
                cut = int(short[0]) if len(short) else len(order)
                sums, some = q[order[:cut]] @ own[order[:cut]], np.arange(len(names))
                while cut < len(order):
                    alive = sums + rest[cut] >= floor
                    some, sums = some[alive], sums[alive]
                    if len(some) == 0:
                        break
                    then = min(len(order), cut + max(4, (len(order) - cut + 1) // 2))
                    more = order[cut:then]
                    sums = sums + (q[more] @ own[more] if len(some) * 2 > len(names) else q[more] @ own[np.ix_(more, some)])[some if len(some) * 2 > len(names) else slice(None)]
                    cut = then
                if len(some) == 0:
                    continue
            fit = names[some] != own_id
            if floor is not None:
                fit &= sums >= floor
            if not fit.any():
                continue
            kept_ids, kept = np.concatenate([kept_ids, names[some][fit]]), np.concatenate([kept, sums[fit]])
            top = best(kept, kept_ids, k)
            kept_ids, kept = kept_ids[top], kept[top]
            if len(kept) == k:
                floor = kept[-1]
        out.append((kept_ids, kept))
    return out


def _exact(ids: np.ndarray, rows: list[np.ndarray], own_id: int, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A query's best with unbounded integers, where sums may pass 64 bits."""
    q = query.tolist()
    scores = [sum(a * b for a, b in zip(q, r.tolist())) for r in rows]
    if any(abs(x) >= 2**63 for x, i in zip(scores, ids) if i != own_id):
        raise OverflowError(f"query {own_id}: a score doesn't fit a long")
    some = np.flatnonzero(ids != own_id)
    scores = np.array([scores[k] for k in some], np.int64)
    top = best(scores, ids[some], TOP)
    return ids[some][top], scores[top]


def _search(block: int):
    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        (_, ids, rows), (query_rows, query_ids, queries) = _matrix(left), _matrix(right)
        out = {"query_row": [], "query_id": [], "vec_id": [], "score": []}
        if len(ids) and len(query_ids):
            width = max(1, *map(len, rows), *map(len, queries))
            most = [max((max(-int(r.min()), int(r.max())) for r in x if len(r)), default=0) for x in (rows, queries)]
            reach = most[0] * most[1] * width
            if reach < 2**62:
                kind = np.float32 if reach < 2**22 else np.float64 if reach < 2**51 else np.int64
                found = search(ids, _pad(rows, width, kind), query_ids, _pad(queries, width, kind), block=block)
            else:
                found = [_exact(ids, rows, i, q) for i, q in zip(query_ids, queries)]
            for row, q, (near, scores) in zip(query_rows, query_ids, found):
                out["query_row"].append(np.full(len(near), row)), out["query_id"].append(np.full(len(near), q)), out["vec_id"].append(near), out["score"].append(scores)
        return pa.table({k: pa.array(np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64)) for k, v in out.items()})

    return work


def top_products(candidates: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's TOP candidates by inner product of floor(64 x).

    Both sides are (vec_id, embedding). Components that a vector lacks against a
    longer one count as 0. Candidates with the query's id are its own and left
    out; other repeated ids are candidates of their own, and each query row has
    a list of its own, repeated ids included. Vectors without an id take no
    part. A score or 64 x that doesn't fit a long is an error. Empty tables give
    empty results.
    """
    quantised = lambda df: df.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(_quantise, QUANTISED)
    n, m = candidates.count(), queries.count()
    shards, blocks = n // SHARD_ROWS + 1, m // QUERY_ROWS + 1
    everywhere = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = quantised(candidates).withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")).withColumn("block", everywhere(blocks))
    right = quantised(queries).withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")).withColumn("shard", everywhere(shards))
    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(_search(BLOCK_ROWS), "query_row long, query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= TOP).select("query_id", "rank", "vec_id", "score")


def op6_top_products(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return top_products(vectors, vectors.filter(F.col("vec_id") % EVERY == 0))


SQL = f"""
WITH fit AS (SELECT row_number() OVER () AS place, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND vec_id IS NOT NULL),
pairs AS (SELECT q.place, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM fit q JOIN fit c ON q.vec_id % {EVERY} = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, (row_number() OVER (PARTITION BY place ORDER BY score DESC, vec_id))::INTEGER AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {TOP}"""
