"""Co-expression graph as an edge table: correlation, normalisation, control, propagation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidyfold.functions.hashing import md5_hex
from tidyfold.operators.metrics import sum_vectors
from tidyfold.operators.ordering import hash_rank, top_k
from tidyfold.session import stable

STRIPE = 1024
DEFAULT_K = 20
DEFAULT_THRESHOLD = 0.4
PAIR = ["i", "j"]
FOUND = "i int, a int, j int, b int, r double"
#: Entries of two blocks that a task sorts and multiplies; samples of more are cut into slices.
SLICE_ENTRIES = 1_000_000


def strongest_correlations(values: DataFrame, stats: DataFrame, sample: str, most: int, threshold: float, feature: str = "feature",
                           value: str = "value", stripe: int = STRIPE, most_entries: int = SLICE_ENTRIES) -> DataFrame:
    """(source, target, r): each feature's `most` largest |r| of at least `threshold` and above 0, per block of partners.

    Features are dealt to blocks of about `stripe`. A task takes two blocks and
    streams their stored entries by sample, adding up one stripe x stripe sum of
    products; implied zeros only count in the means, so they are never made.
    Only the strongest partners leave a task. Where two blocks hold more than
    about `most_entries`, the samples are dealt to slices, a task each, whose
    sums are added before partners are chosen.
    """
    varying = stats.filter(F.col("var_pop") > 0)
    blocks = max(1, -(-varying.count() // stripe))
    block = F.pmod(F.xxhash64(feature), F.lit(blocks)).cast("int")
    place = (F.row_number().over(W.partitionBy("block").orderBy(feature)) - 1).cast("int")
    named = stable(varying.select(feature, (F.col("mean") / F.col("sd_pop")).alias("shift"), "sd_pop", "n", block.alias("block")).withColumn("place", place))
    sizes = named.groupBy("block").agg(F.max("place").alias("last"))
    width = int(sizes.agg(F.max("last")).first()[0] or 0) + 1
    n = float(named.agg(F.max("n")).first()[0] or 1)
    stored = varying.agg(F.sum("n_detected")).first()[0] or 0 if "n_detected" in stats.columns else values.count()
    slices = max(1, -(-2 * int(stored) // ((blocks + 1) * most_entries)))
    entries = values.join(named, feature).select(F.xxhash64(sample).alias("s"), "block", "place", (F.col(value).cast("double") / F.col("sd_pop")).alias("x"), "shift")
    others = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda c: F.struct(F.least(c, "block").alias("i"), F.greatest(c, "block").alias("j")))
    dealt = entries.withColumn("_p", F.explode(others)).select("_p.i", "_p.j", F.pmod("s", F.lit(slices)).cast("int").alias("slice"), "s", (F.col("block") != F.col("_p.i")).alias("right"), "place", "x", "shift")
    task = [*PAIR, "slice"]
    keys = [*task, "s"]

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple, np.ndarray, np.ndarray]]:
        """((i, j, slice), sums of products, both sides' shifts) of every two blocks and slice."""
        here, sums, shifts, rest = None, None, None, None

        def add(rows: pd.DataFrame) -> None:
            _, at = np.unique(rows["s"].to_numpy(), return_inverse=True)
            side = [np.zeros((at.max() + 1, width)) for _ in (0, 1)]
            right, where, x = rows["right"].to_numpy(), rows["place"].to_numpy(), rows["x"].to_numpy()
            for k in (0, 1):
                mine = right == bool(k)
                side[k][at[mine], where[mine]] = x[mine]
                shifts[k][where[mine]] = rows["shift"].to_numpy()[mine]
            sums.__iadd__(side[0].T @ (side[0] if here[0] == here[1] else side[1]))

        for batch in batches:
            rest = batch if rest is None else pd.concat([rest, batch])
            # Whole samples of one pair at a time; the last sample may go on in the next batch.
            final = rest[keys].eq(rest[keys].iloc[-1]).all(axis=1)
            ready, rest = rest[~final], rest[final]
            for key, rows in ready.groupby(task, sort=False):
                if key != here:
                    if here is not None:
                        yield here, sums, shifts
                    here, sums, shifts = key, np.zeros((width, width)), np.zeros((2, width))
                add(rows)
        if rest is not None and len(rest):
            key = tuple(rest[task].iloc[0])
            if key != here:
                if here is not None:
                    yield here, sums, shifts
                here, sums, shifts = key, np.zeros((width, width)), np.zeros((2, width))
            add(rest)
        if here is not None:
            yield here, sums, shifts

    def strongest(pair: tuple, sums: np.ndarray, shifts: np.ndarray) -> Iterator[pd.DataFrame]:
        own = pair[0] == pair[1]
        r = sums / n - np.outer(shifts[0], shifts[0] if own else shifts[1])
        for table, i, j in ((r, *pair),) if own else ((r, *pair), (r.T, pair[1], pair[0])):
            size = np.abs(table)
            if own:
                np.fill_diagonal(size, 0.0)
            good = (size >= threshold) & (size > 0)
            order = np.argsort(-size, axis=1, kind="stable")[:, :most]
            row, column = np.nonzero(np.take_along_axis(good, order, axis=1))
            partner = order[row, column]
            yield pd.DataFrame({"i": np.int32(i), "a": row.astype("int32"), "j": np.int32(j), "b": partner.astype("int32"), "r": table[row, partner]})

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (i, j, _), sums, shifts in products(batches):
            yield from strongest((i, j), sums, shifts)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (i, j, _), sums, _ in products(batches):
            for lo in range(0, width, 128):
                piece = sums[lo : lo + 128]
                yield pd.DataFrame({"i": np.int32(i), "j": np.int32(j), "a": np.arange(lo, lo + len(piece), dtype="int32"), "sums": list(piece)})

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows, shifts = rows.sort_values("a"), np.zeros((2, width))
        for k, side in enumerate(("left", "right")):
            known = rows[side].iloc[0]
            shifts[k, : len(known)] = known
        pair = int(rows["i"].iloc[0]), int(rows["j"].iloc[0])
        return pd.concat(list(strongest(pair, np.stack(rows["sums"].to_list()), shifts)))

    if slices == 1:
        met = dealt.repartition(*PAIR).sortWithinPartitions(*keys).mapInPandas(multiply, FOUND)
    else:
        tasks = max(dealt.sparkSession.sparkContext.defaultParallelism, blocks * (blocks + 1) // 2 * slices)
        parts = dealt.repartition(tasks, *task).sortWithinPartitions(*keys).mapInPandas(partial, "i int, j int, a int, sums array<double>")
        whole = parts.groupBy("i", "j", "a").agg(vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("sums"))
        listed = F.transform(F.sort_array(F.collect_list(F.struct("place", "shift"))), lambda e: e["shift"])
        shift = named.groupBy("block").agg(listed.alias("shifts"))
        for number, side in (("i", "left"), ("j", "right")):
            whole = whole.join(shift.select(F.col("block").alias(number), F.col("shifts").alias(side)), number)
        met = whole.groupBy("i", "j").applyInPandas(choose, FOUND)
    names = named.select(feature, "block", "place")
    left = names.select(F.col(feature).alias("source"), F.col("block").alias("i"), F.col("place").alias("a"))
    right = names.select(F.col(feature).alias("target"), F.col("block").alias("j"), F.col("place").alias("b"))
    return met.join(left, ["i", "a"]).join(right, ["j", "b"]).select("source", "target", "r")


def coexpression_graph(values: DataFrame, stats: DataFrame, sample: str, k: int = DEFAULT_K,
                       threshold: float = DEFAULT_THRESHOLD, feature: str = "feature", value: str = "value") -> DataFrame:
    """(source, target, weight): |r| >= threshold and above 0, each feature's k - 1 best, both directions, self-edges of 1.

    Constant features keep only their self-edge. `stats` is `feature_stats` of
    the same values, so implied zeros count.
    """
    stats = stable(stats)
    loops = stats.select(F.col(feature).alias("source"), F.col(feature).alias("target"), F.lit(1.0).alias("weight"))
    if k <= 1:
        return loops.orderBy("source")
    found = strongest_correlations(values, stats, sample, k - 1, threshold, feature, value)
    best = top_k(found.withColumn("weight", F.abs("r")), ["source"], [F.desc("weight"), F.asc("target")], k - 1)
    one_way = best.select("source", "target", "weight")
    both = one_way.unionByName(one_way.select(F.col("target").alias("source"), F.col("source").alias("target"), "weight"))
    edges = both.groupBy("source", "target").agg(F.max("weight").alias("weight"))
    return edges.unionByName(loops).orderBy("source", "target")


def gcn_normalize(edges: DataFrame) -> DataFrame:
    """Edges weighted D^-1/2 A D^-1/2."""
    degree = edges.groupBy("source").agg(F.sum("weight").alias("_d"))
    met = edges.join(degree.withColumnRenamed("_d", "_ds"), "source").join(
        degree.select(F.col("source").alias("target"), F.col("_d").alias("_dt")), "target"
    )
    floor = F.lit(1e-12)
    scaled = F.col("weight") / F.sqrt(F.greatest("_ds", floor) * F.greatest("_dt", floor))
    return met.select("source", "target", scaled.alias("weight"))


def shuffle_nodes(edges: DataFrame, nodes: DataFrame, node: str = "feature", seed: int = 0) -> DataFrame:
    """The degree-matched control: nodes relabelled by a permutation drawn by hash."""
    base = nodes.select(node).distinct()
    plain = hash_rank(base.withColumn("_hex", md5_hex("node", F.col(node))).withColumn("_all", F.lit(0)), ["_all"], "_hex", node)
    mixed = hash_rank(base.withColumn("_hex", md5_hex(seed, F.col(node))).withColumn("_all", F.lit(0)), ["_all"], "_hex", node)
    to = plain.select(F.col(node).alias("_from"), "rank").join(mixed.select(F.col(node).alias("_to"), "rank"), "rank").drop("rank")
    return (
        edges.join(to.select(F.col("_from").alias("source"), F.col("_to").alias("_s")), "source")
        .join(to.select(F.col("_from").alias("target"), F.col("_to").alias("_t")), "target")
        .select(F.col("_s").alias("source"), F.col("_t").alias("target"), "weight")
    )


def coalesce_edges(edges: DataFrame) -> DataFrame:
    """Repeated edges summed: the sparse matrix."""
    return edges.groupBy("source", "target").agg(F.sum("weight").alias("weight"))


def propagate(edges: DataFrame, vectors: DataFrame, node: str = "feature", vector: str = "vec") -> DataFrame:
    """(source, vec): one step A X over the graph."""
    met = edges.join(vectors.select(F.col(node).alias("target"), F.col(vector).alias("_x")), "target")
    scaled = met.withColumn("_wx", F.transform("_x", lambda x: x.cast("double") * F.col("weight")))
    return sum_vectors(scaled, ["source"], "_wx", vector).select("source", vector)


def propagate_values(edges: DataFrame, values: DataFrame, sample: str, feature: str = "feature", value: str = "value") -> DataFrame:
    """(sample, source, value): the same for tidy values."""
    met = edges.join(values.withColumnRenamed(feature, "target"), "target")
    return met.groupBy(sample, "source").agg(F.sum(F.col("weight") * F.col(value)).alias("value"))
