"""Patient resampling and the intervals it gives.

A replicate draws as many cases as there are, with replacement. Weights are a
sparse (replicate, case, weight) table; replicate 0 is the observed data. Rows
are summed to cases before they meet the weights, and every metric groups by
replicate. The same seed and cases give the same draws, so scores stay paired.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidyfold.functions.hashing import draw, md5_hex, md5_numbers
from tidyfold.operators.ordering import hash_rank

N_BOOTSTRAP = 1000
LEVEL = 0.95
ROWS_PER_TASK = 2_000_000
#: Draws of one replicate that a task holds, and that it makes at once; cases whose counts travel together; such blocks in one batch.
DRAWS_HELD = 16_000_000
DRAWS_AT_ONCE = 1 << 16
BLOCK = 1024
BLOCKS_SENT = 1024


def number_cases(cases: DataFrame, case: str) -> DataFrame:
    """(case, case_rank) from 0 in hash order."""
    hexed = cases.select(case).distinct().withColumn("_hex", md5_hex("boot", F.col(case))).withColumn("_all", F.lit(0))
    return hash_rank(hexed, ["_all"], "_hex", case).select(case, F.col("rank").alias("case_rank"))


def _blocks_of_draws(cases: DataFrame, case: str, n_bootstrap: int, seed: int, hash_fn: str, n: int) -> DataFrame:
    """(block, replicate, counts): n draws out of n cases per replicate, as bytes that count BLOCK adjacent cases each.

    Draw i of replicate r picks case hash(seed, r, i) mod n. The draws are a
    generated range, counted where they are made; a task holds one replicate, or
    DRAWS_HELD draws of one.
    """
    spark, total = cases.sparkSession, n_bootstrap * n
    tasks = int(max(spark.sparkContext.defaultParallelism, total // max(ROWS_PER_TASK, min(n, DRAWS_HELD))))
    if hash_fn == "md5":  # the same number as `hashing.draw`, without a row per draw between Spark and Python
        step = min(n, DRAWS_AT_ONCE)
        per = -(-n // step)
        picked = spark.range(0, n_bootstrap * per, 1, tasks).select((F.floor(F.col("id") / per) + 1).cast("int").alias("replicate"), (F.col("id") % per * step).alias("first"))
    else:
        draws = spark.range(0, total, 1, tasks).select((F.floor(F.col("id") / n) + 1).cast("int").alias("replicate"), (F.col("id") % n).alias("_i"))
        picked = draws.select("replicate", F.pmod(draw(seed, F.col("replicate"), F.col("_i"), hash_fn=hash_fn), F.lit(n)).alias("case_rank"))

    def parts(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        if hash_fn == "md5":
            for replicate, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield replicate, md5_numbers(f"{seed}:{replicate}:", first, min(n, first + step)) % n
        elif batch.num_rows:
            replicates = np.asarray(batch.column(0))
            edges = np.flatnonzero(np.diff(replicates)) + 1
            yield from zip(replicates[[0, *edges]].tolist(), np.split(np.asarray(batch.column(1)), edges))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(replicate: int, drawn: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            counts = np.bincount(np.concatenate(drawn), minlength=n)
            if counts.max() > np.iinfo(np.int8).max:  # below one in 128!: a case is drawn once in n
                raise ValueError(f"a case is drawn {counts.max()} times in replicate {replicate}")
            counts = counts.astype(np.int8)
            for first in range(0, n, BLOCK * BLOCKS_SENT):
                cut = [counts[i : i + BLOCK] for i in range(first, min(n, first + BLOCK * BLOCKS_SENT), BLOCK)]
                met = [(first // BLOCK + j, c) for j, c in enumerate(cut) if c.any()]
                cells = [c.tobytes() for _, c in met]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([j for j, _ in met], pa.int64()), pa.array([replicate] * len(met), pa.int32()), pa.array(cells, pa.binary())],
                    names=["block", "replicate", "counts"],
                )

        at, drawn, held = 0, [], 0
        for batch in batches:
            for own, part in parts(batch):
                if held and (own != at or held + len(part) > DRAWS_HELD):
                    yield from out(at, drawn)
                    drawn, held = [], 0
                at, held = own, held + len(part)
                drawn.append(part.astype(np.int32 if n < 1 << 31 else np.int64))
        if held:
            yield from out(at, drawn)

    return picked.mapInArrow(count, "block bigint, replicate int, counts binary")


def _per_block(cases: DataFrame, case: str, n_bootstrap: int, seed: int, hash_fn: str, long: bool) -> DataFrame:
    """The counts of a block of cases meet the cases' ids; a block is BLOCK x (n_bootstrap + 1) counts."""
    numbered = number_cases(cases, case)
    n = cases.select(case).distinct().count()
    kind = numbered.schema[case].dataType.simpleString()
    if n == 0:
        one = F.lit(1).cast("bigint")
        return numbered.select(F.lit(0).alias("replicate"), case, one.alias("weight")) if long else numbered.select(case, F.array(F.lit(1).cast("tinyint")).alias("weights"))
    drawn = _blocks_of_draws(cases, case, n_bootstrap, seed, hash_fn, n)
    ids = numbered.select(case, (F.col("case_rank") % BLOCK).cast("int").alias("_at"), F.floor(F.col("case_rank") / BLOCK).cast("bigint").alias("block"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        size = int(min(BLOCK, n - left.column("block")[0].as_py() * BLOCK))
        out = np.zeros((n_bootstrap + 1, size), np.int8)
        out[0] = 1
        for r, cells in zip(right.column("replicate").to_pylist(), right.column("counts")):
            out[r] += np.frombuffer(cells.as_buffer(), np.int8)
        out = out[:, np.asarray(left.column("_at"))]
        if long:
            r, at = np.nonzero(out)
            return pa.table({"replicate": pa.array(r.astype(np.int32)), case: left.column(case).combine_chunks().take(pa.array(at)), "weight": pa.array(out[r, at].astype(np.int64))})
        cells = pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(out.T).ravel()), n_bootstrap + 1).cast(pa.list_(pa.int8()))
        return pa.table({case: left.column(case), "weights": cells})

    schema = f"replicate int, `{case}` {kind}, weight bigint" if long else f"`{case}` {kind}, weights array<tinyint>"
    return ids.groupBy("block").cogroup(drawn.groupBy("block")).applyInArrow(meet, schema)


def bootstrap_weights(cases: DataFrame, case: str, n_bootstrap: int = N_BOOTSTRAP, seed: int = 0,
                      hash_fn: str = "xxhash64") -> DataFrame:
    """(replicate, case, weight): n draws out of n cases per replicate, counted; replicate 0 is the observed data."""
    return _per_block(cases, case, n_bootstrap, seed, hash_fn, True)


def bootstrap_vectors(cases: DataFrame, case: str, n_bootstrap: int = N_BOOTSTRAP, seed: int = 0, hash_fn: str = "xxhash64") -> DataFrame:
    """(case, weights): the same draws as one array of counts per case, by replicate from 0 (the observed data)."""
    return _per_block(cases, case, n_bootstrap, seed, hash_fn, False)


#: Numbers that a task of `weigh` holds at once, and those of one product.
HELD, PRODUCT = 16_000_000, 2_000_000
#: Keys from which on sums are cut into tiles of keys and slices of replicates; widest slice; usual bytes of a case's list.
MANY_KEYS, SLICE, LIST_BYTES = 256, 256, 1000


def weigh(rows: DataFrame, weights: DataFrame, case: str, keys: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """(replicate, keys, sums): sums per (case, keys) first, then times the case's weight.

    `weights` are (replicate, case, weight) rows, or (case, weights) arrays; with
    arrays a case's keys meet its weights as one list, a task adds vectors over
    the replicates, and (replicate, keys) that no drawn case has are left out as
    they are with rows. Few keys are added wherever their cases are. Many are
    cut into tiles of keys by slices of replicates, one task each, so that
    partial sums don't outgrow the sums.
    """
    per_case = rows.groupBy(case, *keys).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    if "weights" not in weights.columns:
        return per_case.join(weights, case).groupBy("replicate", *keys).agg(*[F.sum(F.col(n) * F.col("weight")).alias(n) for n in sums])
    names, m = list(sums), len(sums) + 1
    kinds = {f.name: f.dataType for f in per_case.schema.fields}
    n_keys = rows.select(*keys).distinct().count() if keys else 1
    many = n_keys > MANY_KEYS
    # More tiles send the weights more often, more slices the lists; the width balances the two.
    width = min(SLICE, max(16, math.isqrt(LIST_BYTES * HELD // (n_keys * m)))) if many else 0
    tiles = max(-(-n_keys * m * width // HELD), -(-rows.sparkSession.sparkContext.defaultParallelism * width // N_BOOTSTRAP), 1)
    tile = F.pmod(F.xxhash64(*keys), F.lit(tiles)) if many else F.lit(0)
    entry = F.struct(*keys, *[F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(f"_s{j}") for j, n in enumerate(names)])
    lists = per_case.select(case, tile.alias("_tile"), entry.alias("_e")).groupBy(case, "_tile").agg(F.collect_list("_e").alias("_e"))
    met = lists.join(weights.select(case, "weights"), case)
    fields = [*keys, *(f"_s{j}" for j in range(len(names)))]
    met = met.select("weights", "_tile", F.lit(0).alias("_v"), *[F.col("_e")[f].alias(f) for f in fields])
    if many:
        padded = F.concat("weights", F.array_repeat(F.lit(0).cast("tinyint"), width))
        spread = F.explode(F.sequence(F.lit(0), F.floor((F.size("weights") - 1) / width).cast("int")))
        met = met.select(padded.alias("weights"), "_tile", spread.alias("_v"), *fields)
        met = met.withColumn("weights", F.slice("weights", F.col("_v") * width + 1, width)).repartition(min(1024, 8 * tiles * -(-N_BOOTSTRAP // width)), "_tile", "_v")
    ready = met.select("weights", "_v", *fields)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots: dict[tuple, int] = {}
        held, kept_types = np.zeros((0, m, 0)), []

        def out() -> pa.RecordBatch:
            columns = [pa.array([k[j] for k in slots], kept_types[j]) for j in range(len(keys) + 1)]
            sent = held[: len(slots)].reshape(len(slots), -1)
            cells = pa.ListArray.from_arrays(pa.array(np.arange(len(slots) + 1, dtype=np.int32) * sent.shape[1]), pa.array(sent.ravel()))
            return pa.RecordBatch.from_arrays([*columns, cells], names=["_v", *keys, "_flat"])

        def chunks() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from (batch.slice(at, 1024) for at in range(0, batch.num_rows, 1024))

        for batch in chunks():
            lists = [batch.column(2 + j) for j in range(len(fields))]
            kept_types = [batch.column(1).type, *(x.type.value_type for x in lists[: len(keys)])]
            w = np.asarray(batch.column(0).flatten()).reshape(batch.num_rows, -1).astype(float)
            row = np.repeat(np.arange(batch.num_rows), np.asarray(pa.compute.list_value_length(lists[0])))
            slices = np.asarray(batch.column(1))[row].tolist()
            s = np.column_stack([np.ones(len(row)), *(np.asarray(x.flatten()) for x in lists[len(keys) :])])
            named = zip(slices, *(x.flatten().to_pylist() for x in lists[: len(keys)]))
            slot = np.fromiter((slots.setdefault(k, len(slots)) for k in named), np.int64, len(row))
            if len(slots) > len(held):
                held = np.concatenate([held.reshape(len(held), m, w.shape[1]), np.zeros((max(64, 2 * len(slots)) - len(held), m, w.shape[1]))])
            order = np.argsort(slot, kind="stable")
            starts = np.flatnonzero(np.diff(slot[order], prepend=-1))
            if len(starts) * 8 < len(order):
                for own in np.split(order, starts[1:]):
                    held[slot[own[0]]] += s[own].T @ w[row[own]]
            else:
                step = max(1, PRODUCT // (m * w.shape[1]))
                for at in range(0, len(order), step):
                    own = order[at : at + step]
                    first = np.flatnonzero(np.diff(slot[own], prepend=-1))
                    held[slot[own[first]]] += np.add.reduceat(s[own][:, :, None] * w[row[own]][:, None, :], first)
            if len(slots) * m * w.shape[1] > HELD:
                yield out()
                slots.clear()
                held = held[:0]
        if slots:
            yield out()

    schema = ", ".join(["_v int", *(f"`{k}` {kinds[k].simpleString()}" for k in keys), "_flat array<double>"])
    parts = ready.mapInArrow(add, schema)
    whole = parts.groupBy("_v", *keys).agg(vector_to_array(Summarizer.sum(array_to_vector("_flat"))).alias("_flat"))
    each = (F.size("_flat") / m).cast("int")
    at = lambda j: F.get("_flat", F.col("_place") + F.col("_each") * j)
    long = whole.withColumn("_each", each).select("_v", *keys, "_flat", "_each", F.explode(F.sequence(F.lit(0), each - 1)).alias("_place"))
    replicate = (F.col("_v") * width + F.col("_place")).alias("replicate")
    return long.filter(at(0) > 0).select(replicate, *keys, *[_as(at(j + 1), kinds[n]).alias(n) for j, n in enumerate(names)])


def _as(value: Column, kind) -> Column:
    """Whole numbers stay whole."""
    return value.cast("bigint") if kind.simpleString() in ("int", "bigint", "smallint", "tinyint") else value


def weighted_mean(rows: DataFrame, weights: DataFrame, case: str, value: str) -> DataFrame:
    """(replicate, value): mean under each replicate, null rows skipped."""
    sums = weigh(rows, weights, case, [], {"_s": F.col(value).cast("double"), "_n": F.col(value).isNotNull().cast("bigint")})
    return sums.select("replicate", F.try_divide(F.col("_s"), F.col("_n").cast("double")).alias(value))


def interval(replicates: DataFrame, keys: Sequence[str], value: str, level: float = LEVEL) -> DataFrame:
    """Percentile interval per key; a key holds one value per replicate, so the sort is small."""
    tail = (1 - level) / 2
    clean = replicates.withColumn(value, F.when(~F.isnan(value), F.col(value)))
    ends = F.percentile(value, F.array(F.lit(tail), F.lit(1 - tail)))
    return clean.groupBy(*keys).agg(ends.alias("_e")).select(
        *keys, F.get("_e", F.lit(0)).alias(f"{value}_lo"), F.get("_e", F.lit(1)).alias(f"{value}_hi")
    )


def summarize(scores: DataFrame, keys: Sequence[str], values: Sequence[str], level: float = LEVEL,
              keep: bool = True) -> DataFrame:
    """Per key: each value of replicate 0, its `_lo` and `_hi`, and the replicates `_boot` in order."""
    tail = (1 - level) / 2
    aggs = []
    for v in values:
        clean = F.when(~F.isnan(v), F.col(v))
        drawn = F.when(F.col("replicate") > 0, clean)
        ends = F.percentile(drawn, F.array(F.lit(tail), F.lit(1 - tail)))
        aggs += [F.max(F.when(F.col("replicate") == 0, clean)).alias(v), ends.alias(f"_{v}")]
        if keep:
            kept = F.sort_array(F.collect_list(F.when(F.col("replicate") > 0, F.struct("replicate", clean.alias("v")))))
            aggs.append(F.transform(kept, lambda s: s["v"]).alias(f"{v}_boot"))
    table = scores.groupBy(*keys).agg(*aggs)
    out = []
    for v in values:
        out += [F.col(v), F.get(f"_{v}", F.lit(0)).alias(f"{v}_lo"), F.get(f"_{v}", F.lit(1)).alias(f"{v}_hi")]
        if keep:
            out.append(F.col(f"{v}_boot"))
    return table.select(*keys, *out)


def paired_differences(table: DataFrame, name: str, reference: str, keys: Sequence[str], counts: Sequence[str],
                       scores: Sequence[str], level: float = LEVEL) -> DataFrame:
    """(keys, score, delta, delta_lo, delta_hi, share_above): one embedding's scores less another's, paired by replicate.

    Rows meet on the keys (null keys too) and only where the counts agree.
    """
    tail = (1 - level) / 2
    mine = table.filter(F.col("embeddings") == name).alias("a")
    other = table.filter(F.col("embeddings") == reference).alias("b")
    same = F.lit(True)
    for c in [*keys, *counts]:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    # A key the reference holds twice has no single partner and is left out.
    single = table.filter(F.col("embeddings") == reference).groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n = 1").alias("c")
    once = F.lit(True)
    for c in keys:
        once = once & F.col(f"a.{c}").eqNullSafe(F.col(f"c.{c}"))
    met = mine.join(other, same).join(single, once, "left_semi")
    per_score = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(s).alias("score"),
                    (F.col(f"a.{s}") - F.col(f"b.{s}")).alias("delta"),
                    F.zip_with(F.col(f"a.{s}_boot"), F.col(f"b.{s}_boot"), lambda x, y: x - y).alias("gaps"),
                )
                for s in scores
            ]
        )
    )
    long = met.select(*[F.col(f"a.{k}").alias(k) for k in keys], per_score.alias("_d"))
    flat = long.select(*keys, "_d.score", "_d.delta", F.explode_outer("_d.gaps").alias("_gap"))
    ends = F.percentile("_gap", F.array(F.lit(tail), F.lit(1 - tail)))
    flat = flat.withColumn("_gap", F.when(~F.isnan("_gap"), F.col("_gap"))).filter(F.col("_gap").isNotNull())
    found = flat.groupBy(*keys, "score").agg(
        F.max("delta").alias("delta"), ends.alias("_e"), F.avg((F.col("_gap") > 0).cast("double")).alias("share_above")
    )
    return found.select(
        *keys, "score", "delta", F.get("_e", F.lit(0)).alias("delta_lo"), F.get("_e", F.lit(1)).alias("delta_hi"), "share_above"
    )


def all_differences(tables: dict[str, tuple[DataFrame, list[str], list[str], list[str]]], reference: str,
                    others: Sequence[str]) -> DataFrame:
    """Every table's differences from one reference, tagged with `table`, `embeddings` and a readable `row`.

    `tables` maps a name to (table, keys, counts, scores).
    """
    parts = None
    for title, (table, keys, counts, scores) in tables.items():
        for name in others:
            if name == reference:
                continue
            found = paired_differences(table, name, reference, keys, counts, scores)
            shown = F.concat_ws(" ", *[F.col(k).cast("string") for k in keys if k != "split"]) if keys else F.lit("")
            found = found.select(
                F.lit(title).alias("table"), F.lit(name).alias("embeddings"), shown.alias("row"),
                "score", "delta", "delta_lo", "delta_hi", "share_above",
            )
            parts = found if parts is None else parts.unionByName(found)
    return parts
