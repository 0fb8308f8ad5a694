"""Exact cosine neighbours, silhouettes, k-means agreement and distribution distance.

A group's queries and references meet as a grid of blocks whose number follows
the measured counts. A task scores one block of queries against one block of
references piece by piece and keeps each query's k best, so what leaves it is k
rows per query and reference block; the lists are merged by query.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidyfold.functions.arrays import dot, unit
from tidyfold.operators.linear import rows_scaled, stack
from tidyfold.operators.metrics import sum_vectors
from tidyfold.operators.ordering import top_k

#: Rows of a block on either side of the neighbour grid and of the kernel sums, and queries scored at a time.
GRID, BLOCK, PIECE = 8192, 1024, 256


def _best(similarity: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's k largest entries, the first of those level with the k-th."""
    if similarity.shape[1] <= k:
        return np.nonzero(np.ones(similarity.shape, dtype=bool))
    edge = np.partition(similarity, -k, axis=1)[:, [-k]]
    above, level = similarity > edge, similarity == edge
    return np.nonzero(above | (level & (np.cumsum(level, axis=1) <= k - above.sum(axis=1, keepdims=True))))


def cosine_neighbours(query: DataFrame, reference: DataFrame, k: int, qid: str = "qid", rid: str = "rid",
                      vector: str = "vec", group: str = "grp", block: int = GRID) -> DataFrame:
    """(qid, rid, similarity, rank): each query's k nearest references of its own group.

    Both sides have (group, id, vector). Ties go to the smaller rid; a zero row
    is alike to nothing (similarity 0). A group with fewer than k references
    returns all of them.
    """
    r_type, q_type = reference.schema[rid].dataType.simpleString(), query.schema[qid].dataType.simpleString()
    asked = query.select(F.col(group).alias("grp"), F.col(qid).alias("qid"), F.col(vector).alias("vec"))
    known = reference.select(F.col(group).alias("grp"), F.col(rid).alias("rid"), F.col(vector).alias("vec"))

    def blocks(side: DataFrame, name: str) -> DataFrame:
        return side.groupBy("grp").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias(name))

    layout = blocks(asked, "nq").join(blocks(known, "nr"), "grp")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(layout, "grp").withColumn("q", F.pmod(F.xxhash64("qid"), F.col("nq"))).withColumn("r", spread("nr"))
    right = known.join(layout, "grp").withColumn("r", F.pmod(F.xxhash64("rid"), F.col("nr"))).withColumn("q", spread("nq"))
    keys = ["grp", "q", "r"]

    def compare(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(mine) and len(theirs):
            theirs = theirs.sort_values("rid")
            columns = rows_scaled(stack(theirs["vec"])).T
            rids = theirs["rid"].to_numpy()
            for at in range(0, len(mine), PIECE):
                part = mine.iloc[at : at + PIECE]
                similarity = rows_scaled(stack(part["vec"])) @ columns
                row, column = _best(similarity, k)
                found.append(pd.DataFrame({"qid": part["qid"].to_numpy()[row], "rid": rids[column], "similarity": similarity[row, column]}))
        return pd.concat(found) if found else pd.DataFrame({"qid": [], "rid": [], "similarity": []})

    cast = lambda df, name: df.select(F.col("grp"), F.col("q").cast("int").alias("q"), F.col("r").cast("int").alias("r"), name, "vec")
    met = cast(left, "qid").groupBy(*keys).cogroup(cast(right, "rid").groupBy(*keys))
    scored = met.applyInPandas(compare, f"qid {q_type}, rid {r_type}, similarity double")
    nearest = top_k(scored, ["qid"], [F.desc("similarity"), F.asc("rid")], k)
    return nearest.select(F.col("qid").alias(qid), F.col("rid").alias(rid), "similarity", "rank")


def neighbour_precision(nearest: DataFrame, labels: DataFrame, ks: Sequence[int] = (1, 10), qid: str = "qid",
                        rid: str = "rid", label: str = "label") -> DataFrame:
    """(qid, precision_at_k ...): share of the k nearest with the query's label."""
    mine = labels.select(F.col("id").alias(qid), F.col(label).alias("_mine"))
    theirs = labels.select(F.col("id").alias(rid), F.col(label).alias("_theirs"))
    hits = nearest.join(mine, qid).join(theirs, rid).withColumn("_hit", (F.col("_mine") == F.col("_theirs")).cast("double"))
    return hits.groupBy(qid).agg(*[F.avg(F.when(F.col("rank") <= k, F.col("_hit"))).alias(f"precision_at_{k}") for k in ks])


def batch_enrichment(nearest: DataFrame, rows: DataFrame, reference: DataFrame, qid: str = "qid", rid: str = "rid",
                     group: str = "grp", batch: str = "batch") -> DataFrame:
    """(qid, enrichment): same-batch share of the neighbours less that share of the group's references.

    `rows` has (id, group, batch) for queries and references. Null where the
    group has fewer than two references, or none of the query's batch.
    """
    per_batch = reference.groupBy(group, batch).agg(F.count("*").alias("_b"))
    per_group = per_batch.groupBy(group).agg(F.sum("_b").alias("_g"))
    mine = rows.select(F.col("id").alias(qid), F.col(group), F.col(batch).alias("_mine"))
    theirs = rows.select(F.col("id").alias(rid), F.col(batch).alias("_theirs"))
    seen = nearest.join(mine, qid).join(theirs, rid).groupBy(qid, group, "_mine").agg(
        F.avg((F.col("_mine") == F.col("_theirs")).cast("double")).alias("_seen")
    )
    chance = per_batch.join(per_group, group).select(
        group, F.col(batch).alias("_mine"), (F.col("_b") / F.col("_g")).alias("_chance"), "_g"
    )
    met = seen.join(chance, [group, "_mine"], "left")
    return met.select(qid, F.when(F.col("_g") >= 2, F.col("_seen") - F.col("_chance")).alias("enrichment"))


MAX_CLASSES = 10_000


def silhouettes(df: DataFrame, row: str, vector: str, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, row, silhouette) with cosine distance, from class sums instead of pairs.

    With unit rows u and class sums m: a = (n - u·m) / (n - 1) inside the class,
    b = min over other classes of 1 - u·m_c / n_c. A class of one scores 0;
    with one class, or as many classes as rows, there is no score.
    """
    keys = list(keys)
    units = df.select(*keys, row, label, unit(F.col(vector)).alias("_u")).withColumn(
        "_zero", (dot(F.col("_u"), F.col("_u")) == 0).cast("double")
    )
    sums = sum_vectors(units, [*keys, label], "_u", "_m")
    classes = sums.groupBy(*keys).agg(F.collect_list(F.struct(F.col(label).alias("c"), "_m", "n")).alias("_all"), F.count("*").alias("_k"), F.sum("n").alias("_rows"))
    many = F.raise_error(F.lit("too many classes for a silhouette")).cast("bigint")
    classes = classes.withColumn("_k", F.when(F.col("_k") > MAX_CLASSES, many).otherwise(F.col("_k")))
    one = classes.select(F.struct("_all", "_k", "_rows").alias("_c"))
    met = units.join(classes, keys) if keys else units.withColumn("_c", one.scalar()).select("*", "_c.*").drop("_c")
    scored = F.transform(
        "_all", lambda s: F.struct(s["c"].alias("c"), s["n"].alias("n"), dot(F.col("_u"), s["_m"]).alias("d"))
    )
    split = met.withColumn("_d", scored).withColumn("_own", F.filter("_d", lambda s: s["c"] == F.col(label))[0])
    n = F.col("_own.n")
    # A row's distance to itself is 0, but a zero row adds 1 - 0 = 1 to its class sum.
    a = (n - F.col("_own.d") - F.col("_zero")) / F.when(n > 1, n - 1)
    b = F.array_min(F.transform(F.filter("_d", lambda s: s["c"] != F.col(label)), lambda s: 1 - s["d"] / s["n"]))
    s = F.when(n > 1, F.try_divide(b - a, F.greatest(a, b))).otherwise(0.0)
    return split.select(*keys, row, F.when((F.col("_k") > 1) & (F.col("_k") < F.col("_rows")), s).alias("silhouette"))


def kmeans_clusters(train: DataFrame, test: DataFrame, vector: str, k: int, seed: int = 0) -> DataFrame:
    """Test rows with `cluster` from k-means on unit training vectors (Spark ML)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    def prepared(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_v", array_to_vector(unit(F.col(vector))))

    model = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="cluster").fit(prepared(train))
    return model.transform(prepared(test)).drop("_v")


def mmd(rows: DataFrame, side: Column, vector: str, batch: str, row: str, block: int = BLOCK) -> DataFrame:
    """(batch, mmd): squared maximum mean discrepancy between the two sides of each batch.

    The V-statistic under exp(-|x - y|^2 / d^2) over every pair, diagonals
    included. Blocks of a batch meet each other; only their kernel sums leave a task.
    """
    b_type = rows.schema[batch].dataType.simpleString()
    marked = rows.select(F.col(batch).alias("batch"), side.cast("boolean").alias("side"), F.col(vector).alias("vec"), F.xxhash64(row).alias("h"))
    sizes = marked.groupBy("batch", "side").agg(F.count("*").alias("n"))
    chunked = marked.join(sizes, ["batch", "side"]).withColumn("chunk", F.pmod("h", F.ceil(F.col("n") / F.lit(block))))
    blocks = chunked.groupBy("batch", "side", "chunk").agg(F.collect_list("vec").alias("vecs"))
    left = blocks.select("batch", F.col("side").alias("s1"), F.col("chunk").alias("c1"), F.col("vecs").alias("v1"))
    right = blocks.select("batch", F.col("side").alias("s2"), F.col("chunk").alias("c2"), F.col("vecs").alias("v2"))
    # The kernel is symmetric: meet each unordered pair of blocks once.
    later = (F.col("s1") < F.col("s2")) | ((F.col("s1") == F.col("s2")) & (F.col("c1") <= F.col("c2")))
    met = left.join(right, "batch").filter(later)

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for row in part.itertuples(index=False):
                x, y = stack(row.v1), stack(row.v2)
                gap = (x**2).sum(1)[:, None] + (y**2).sum(1)[None, :] - 2 * x @ y.T
                total = np.exp(-np.maximum(gap, 0.0) / x.shape[1] ** 2).sum()
                twice = 2.0 if row.s1 == row.s2 and row.c1 != row.c2 else 1.0
                yield pd.DataFrame({"batch": [row.batch], "kind": [int(row.s1) + int(row.s2)], "total": [twice * total]})

    sums = met.mapInPandas(kernel, f"batch {b_type}, kind int, total double")
    n0 = F.sum(F.when(~F.col("side"), F.col("n")).otherwise(0))
    n1 = F.sum(F.when(F.col("side"), F.col("n")).otherwise(0))
    counts = sizes.groupBy("batch").agg(n0.alias("n0"), n1.alias("n1"))
    parts = sums.groupBy("batch").agg(*[F.sum(F.when(F.col("kind") == i, F.col("total")).otherwise(0.0)).alias(f"k{i}") for i in range(3)])
    value = (
        F.try_divide(F.col("k0"), (F.col("n0") * F.col("n0")).cast("double"))
        + F.try_divide(F.col("k2"), (F.col("n1") * F.col("n1")).cast("double"))
        - 2 * F.try_divide(F.col("k1"), (F.col("n0") * F.col("n1")).cast("double"))
    )
    return parts.join(counts, "batch").select(F.col("batch").alias(batch), value.alias("mmd"))
