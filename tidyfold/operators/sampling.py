"""Masks, replacements and views drawn by hashing (seed, row, feature)."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidyfold.functions.hashing import SPAN, choice, draw, md5_at, md5_hex, md5_ids, md5_table, uniform
from tidyfold.operators.ordering import hash_rank, prefix_sums, top_k
from tidyfold.session import stable


def sample_positions(rows: DataFrame, sample: str, k: int, feature: str = "feature", seed: int = 0,
                     hash_fn: str = "xxhash64") -> DataFrame:
    """k distinct features per sample, uniform without replacement: the k smallest hashes."""
    hashed = rows.withColumn("_draw", draw(seed, F.col(sample), F.col(feature), hash_fn=hash_fn))
    return top_k(hashed, [sample], [F.asc("_draw"), F.asc(feature)], k, salt=feature).drop("_draw", "rank")


def ratio_count(n_features: int, ratio: float) -> int:
    """max(1, round(ratio * G)), halves to even."""
    return max(1, round(ratio * n_features))


def fixed_count(n_features: int, rate: float) -> int:
    return math.floor(rate * n_features)


def share_mask(rows: DataFrame, sample: str, count: int, feature: str = "feature", seed: int = 0,
               hash_fn: str = "xxhash64") -> DataFrame:
    """Every row with a `mask` that is true on exactly `count` features of each sample.

    A hash threshold would be approximate; the exact cut is a top-k joined back.
    """
    if count == 0:
        return rows.withColumn("mask", F.lit(False))
    chosen = sample_positions(rows.select(sample, feature), sample, count, feature, seed, hash_fn)
    marked = rows.join(chosen.withColumn("mask", F.lit(True)), [sample, feature], "left")
    return marked.withColumn("mask", F.coalesce("mask", F.lit(False)))


#: Rounds of `keyed_positions`.
ROUNDS = 6


def grid_sides(n: int) -> tuple[int, int]:
    """Sides of the smallest near-square grid with at least n cells."""
    a = math.isqrt(n - 1) + 1
    return a, -(-n // a)


def _amounts(n: int, seed: int, *ids, hash_fn: str) -> Column:
    """ROUNDS arrays: how far each round of `keyed_positions` moves one coordinate, by the other one."""
    a, b = grid_sides(n)
    sides = [(b, a) if r % 2 == 0 else (a, b) for r in range(ROUNDS)]  # what picks, what is moved

    def amounts(r: int, size: int, most: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda j: choice(seed, F.lit(most), *ids, F.lit(r), j, hash_fn=hash_fn).cast("int"))

    return F.array(*[amounts(r, size, most) for r, (size, most) in enumerate(sides)])


def keyed_positions(n: int, k: int, seed: int, *ids, hash_fn: str = "xxhash64") -> Column:
    """An array of k distinct positions of 0..n-1, drawn from (seed, ids) without listing the n.

    A Feistel network permutes the cells of an a x b grid: in turn one
    coordinate is moved by a hashed amount that the other one picks, so each
    round can be undone. Cells from n on are passed over; there are fewer than a
    of them, so the first k + a * b - n cells hold k positions. The amounts are
    tables of a or b numbers per row.
    """
    if not 0 <= k <= n:
        raise ValueError(f"{k} of {n} positions can't be drawn")
    if k == 0:
        return F.array().cast("array<int>")
    a, b = grid_sides(n)
    tables = _amounts(n, seed, *ids, hash_fn=hash_fn)

    def place(cell: Column, moves: Column) -> Column:
        left, right = cell % a, F.floor(cell / a).cast("int")
        for r in range(ROUNDS):
            if r % 2 == 0:
                left = (left + moves[r][right]) % a
            else:
                right = (right + moves[r][left]) % b
        return right * a + left

    cells = F.sequence(F.lit(0), F.lit(k + a * b - n - 1))
    # One more lambda, so that a row's tables are made once and not for each cell.
    drawn = F.transform(F.array(tables), lambda moves: F.transform(cells, lambda c: place(c, moves)))[0]
    return F.slice(F.filter(drawn, lambda x: x < n), 1, k)


#: Positions that one task goes through, about, tasks at most, and rows that one sends on at once.
TASK_POSITIONS, TASKS, SENT_ROWS = 4_000_000, 4096, 1 << 16


def _tasks(ids: DataFrame, per_sample: int) -> int:
    """As many tasks as the positions of the ids need: the ids alone are so few that they would meet in one."""
    parallel = ids.sparkSession.sparkContext.defaultParallelism
    return max(4 * parallel, min(TASKS, ids.count() * per_sample // TASK_POSITIONS))


def _lists(rows: DataFrame, sample: str, using: list[Column], find: Callable[..., Iterator[np.ndarray]]) -> DataFrame:
    """(sample, positions): what `find` makes of the columns `using`, row by row, sent on in batches bounded by positions."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, held = 0, []

            def out(to: int) -> pa.RecordBatch:
                cells = pa.array(np.concatenate(held).astype(np.int32)) if held else pa.array([], pa.int32())
                ends = np.cumsum([0, *map(len, held)], dtype=np.int32)
                return pa.RecordBatch.from_arrays([batch.column(0).slice(start, to - start), pa.ListArray.from_arrays(pa.array(ends), cells)], names=[sample, "positions"])

            for r, positions in enumerate(find(*batch.columns[1:])):
                held.append(positions)
                if sum(map(len, held)) >= SENT_ROWS:
                    yield out(r + 1)
                    start, held = r + 1, []
            if held:
                yield out(batch.num_rows)

    kind = rows.schema[sample].dataType.simpleString()
    return rows.select(sample, *[c.alias(f"_{i}") for i, c in enumerate(using)]).mapInArrow(each, f"`{sample}` {kind}, positions array<int>")


class Draws(NamedTuple):
    """How the positions of each sample are drawn, before they are: `find` makes them of the columns `using`, row by row, going through `n_features`; none where those are null."""

    samples: DataFrame
    sample: str
    n_features: int
    using: list[Column]
    find: Callable[..., Iterator[np.ndarray]]

    def lists(self) -> DataFrame:
        """(sample, positions)"""
        ids = self.samples.select(self.sample).distinct()
        return _lists(ids.repartition(_tasks(ids, self.n_features), self.sample), self.sample, self.using, self.find)


def _prefix(seed: int, sample: str) -> Column:
    """What `md5_hash` of (seed, sample, ...) joins before the last parts."""
    return F.concat_ws(":", F.lit(str(seed)), F.col(sample).cast("string"), F.lit(""))


def masked_draws(samples: DataFrame, sample: str, n_features: int, k: int, seed: int = 0, hash_fn: str = "xxhash64") -> Draws:
    """`keyed_positions` of each sample, a round over all its cells at a time."""
    if not 0 < k <= n_features:
        return Draws(samples, sample, n_features, [keyed_positions(n_features, k, seed, F.col(sample), hash_fn=hash_fn)], lambda rows: (np.zeros(0, np.int64) for _ in rows))
    a, b = grid_sides(n_features)
    sides = [(b, a) if r % 2 == 0 else (a, b) for r in range(ROUNDS)]  # what picks, what is moved

    def moved(rows: pa.Array) -> Iterator[np.ndarray | None]:
        """The numbers of `_amounts`, end to end."""
        if hash_fn != "md5":
            yield from (np.asarray(x.values) if x.is_valid else None for x in rows)
            return
        suffixes = [f"{r}:{j}" for r, (size, _) in enumerate(sides) for j in range(size)]
        most = np.repeat([m for _, m in sides], [size for size, _ in sides])
        step = max(1, SENT_ROWS // len(suffixes))
        for lo in range(0, len(rows), step):
            prefixes = rows.slice(lo, step).to_pylist()
            found = iter(md5_table([p for p in prefixes if p is not None] or [""], suffixes) % most)
            yield from (None if p is None else next(found) for p in prefixes)

    def permuted(rows: pa.Array) -> Iterator[np.ndarray]:
        cells = np.divmod(np.arange(k + a * b - n_features), a)
        for moves in moved(rows):
            if moves is None:
                yield np.zeros(0, np.int64)
                continue
            (right, left), at = cells, 0
            for r in range(ROUNDS):
                if r % 2 == 0:
                    left, at = left + moves[at + right], at + b
                    left -= a * (left >= a)
                else:
                    right, at = right + moves[at + left], at + a
                    right -= b * (right >= b)
            found = right * a + left
            yield found[found < n_features][:k]

    return Draws(samples, sample, n_features, [_prefix(seed, sample) if hash_fn == "md5" else F.flatten(_amounts(n_features, seed, F.col(sample), hash_fn=hash_fn))], permuted)


def masked_lists(samples: DataFrame, sample: str, n_features: int, k: int, seed: int = 0, hash_fn: str = "xxhash64") -> DataFrame:
    """(sample, positions): `keyed_positions` of each sample."""
    return masked_draws(samples, sample, n_features, k, seed, hash_fn).lists()


def masked_positions(samples: DataFrame, sample: str, n_features: int, k: int, seed: int = 0, hash_fn: str = "xxhash64") -> DataFrame:
    """(sample, position): k of all `n_features` positions for each sample, whether it stores a value there or not."""
    return masked_lists(samples, sample, n_features, k, seed, hash_fn).select(sample, F.explode("positions").alias("position"))


def _first_above(rate: float) -> int:
    """The smallest md5 draw whose uniform number is not below `rate`."""
    low, high = 0, int(SPAN)
    while low < high:
        middle = (low + high) // 2
        low, high = (middle + 1, high) if float(middle) / SPAN < rate else (low, middle)
    return low


def bernoulli_draws(samples: DataFrame, sample: str, n_features: int, rate: float, seed: int = 0, hash_fn: str = "xxhash64") -> Draws:
    """Each of all `n_features` positions with probability `rate`."""
    if hash_fn != "md5":
        every = F.sequence(F.lit(0), F.lit(n_features - 1)) if n_features else F.array().cast("array<int>")
        return Draws(samples, sample, n_features, [F.filter(every, lambda p: bernoulli(rate, seed, F.col(sample), p, hash_fn=hash_fn))], lambda rows: (np.asarray(x.values) if x.is_valid else np.zeros(0, np.int64) for x in rows))
    most, step = _first_above(rate), 1 << 16

    def drawn(rows: pa.Array) -> Iterator[np.ndarray]:  # the same numbers as `hashing.draw`, without a row per draw between Spark and Python
        for prefix in rows.to_pylist():
            found = [lo + np.flatnonzero(md5_at(prefix, np.arange(lo, min(n_features, lo + step))) < most) for lo in range(0, n_features if prefix is not None else 0, step)]
            yield np.concatenate(found) if found else np.zeros(0, np.int64)

    return Draws(samples, sample, n_features, [_prefix(seed, sample)], drawn)


def bernoulli_lists(samples: DataFrame, sample: str, n_features: int, rate: float, seed: int = 0, hash_fn: str = "xxhash64") -> DataFrame:
    """(sample, positions): each of all `n_features` positions with probability `rate`."""
    return bernoulli_draws(samples, sample, n_features, rate, seed, hash_fn).lists()


def bernoulli_positions(samples: DataFrame, sample: str, n_features: int, rate: float, seed: int = 0, hash_fn: str = "xxhash64") -> DataFrame:
    """(sample, position): each of all `n_features` positions with probability `rate`; the others are dropped where they are made."""
    return bernoulli_lists(samples, sample, n_features, rate, seed, hash_fn).select(sample, F.explode("positions").alias("position"))


def mask_everywhere(rows: DataFrame, positions: DataFrame | Draws, axis: DataFrame, sample: str, feature: str = "feature", value: str = "value",
                    draws: dict[str, int] | None = None) -> DataFrame:
    """(sample, feature, value, mask): every stored row, and a row of value 0 for each masked position that isn't stored.

    `axis` (position, feature) numbers all features from 0, each once. What is
    neither stored nor masked is 0 and stays 0, and has no row. `positions` are
    (sample, position) rows, or (sample, positions) lists with a row per sample:
    lists meet a sample's stored values as they are, and are opened after the
    last shuffle. As `Draws` they are drawn there too, and nothing but ids and
    stored values is shuffled; `draws` then names more columns, the md5 draws
    from (its seed, sample, feature) of masked rows.
    """
    if isinstance(positions, Draws):
        return _drawn_everywhere(rows, positions, axis, sample, feature, value, draws or {})
    if draws:
        raise ValueError("only positions that are drawn here can have more draws")
    if "positions" not in positions.columns:
        hit = positions.join(axis.select("position", feature), "position").select(sample, feature, F.lit(True).alias("mask"))
        met = rows.select(sample, feature, F.col(value).cast("double").alias(value)).join(hit, [sample, feature], "full")
        return met.select(sample, feature, F.coalesce(value, F.lit(0.0)).alias(value), F.coalesce("mask", F.lit(False)).alias("mask"))
    numbers = axis.select("position", feature)
    entry = F.struct(F.coalesce(F.col("position").cast("bigint"), F.lit(-1).cast("bigint")).alias("p"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("v"), F.col(feature).alias("f"))
    stored = rows.select(sample, feature, value).join(numbers.distinct(), feature, "left").groupBy(sample).agg(F.collect_list(entry).alias("_e"))
    met = positions.select(sample, "positions").join(stored, sample, "full").select(sample, "positions", "_e.p", "_e.v", "_e.f")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0), batch.columns[1:]
            names = lists[3].type.value_type
            for r in range(batch.num_rows):
                chosen, at, values = (np.asarray(c[r].values) if c[r].is_valid else np.zeros(0, t) for c, t in zip(lists[:3], (np.int32, np.int64, np.float64)))
                own = lists[3][r].values if lists[3][r].is_valid else pa.array([], names)
                width = int(max(chosen.max(initial=-1), at.max(initial=-1))) + 2  # the last cell is that of features without a number
                taken, held = np.zeros(width, bool), np.zeros(width, bool)
                taken[chosen], held[at] = True, True
                taken[-1] = False
                zeros = chosen[~held[chosen]]
                everything = [
                    pa.concat_arrays([pa.array(at), pa.array(zeros.astype(np.int64))]), pa.concat_arrays([own, pa.nulls(len(zeros), names)]),
                    pa.array(np.concatenate([values, np.zeros(len(zeros))])), pa.array(np.concatenate([taken[at], np.ones(len(zeros), bool)])),
                ]
                size = len(at) + len(zeros)
                row = pa.RecordBatch.from_arrays([ids.take(pa.array(np.full(size, r))), *everything], names=[sample, "position", "_f", value, "mask"])
                yield from (row.slice(lo, SENT_ROWS) for lo in range(0, size, SENT_ROWS))

    found = met.mapInArrow(mark, f"`{sample}` {met.schema[sample].dataType.simpleString()}, position bigint, _f {kinds[feature]}, `{value}` double, mask boolean")
    # A masked row's feature is that of its position; a position that the axis hasn't is dropped.
    known = numbers.select(F.col("position").alias("_position"), F.col(feature).alias("_named"), F.lit(True).alias("_known"))
    named = found.join(known, (F.col("position") == F.col("_position")) & F.col("mask"), "left").filter("NOT mask OR _known")
    return named.select(sample, F.when(F.col("mask"), F.col("_named")).otherwise(F.col("_f")).alias(feature), value, "mask")


def _drawn_everywhere(rows: DataFrame, drawn: Draws, axis: DataFrame, sample: str, feature: str, value: str, draws: dict[str, int]) -> DataFrame:
    kind = rows.select(feature).union(axis.select(feature)).schema[feature].dataType
    if draws and kind.simpleString() not in ("tinyint", "smallint", "int", "bigint", "string"):
        raise ValueError(f"features of type {kind.simpleString()} aren't drawn from here")
    numbers = axis.select(F.col("position").cast("bigint").alias("position"), F.col(feature).cast(kind).alias(feature))
    entry = F.struct(F.coalesce("position", F.lit(-1).cast("bigint")).alias("p"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("v"), F.col(feature).alias("f"))
    ids = drawn.samples.select(F.col(drawn.sample).alias(sample)).distinct()
    parts = _tasks(ids, drawn.n_features)
    stored = rows.select(sample, F.col(feature).cast(kind).alias(feature), value).join(numbers.distinct(), feature, "left")
    stored = stored.repartition(parts, sample).groupBy(sample).agg(F.collect_list(entry).alias("_e"))
    met = ids.withColumn("_drawn", F.lit(True)).repartition(parts, sample).join(stored, sample, "full")
    made = [F.when(F.col("_drawn"), c) for c in (*drawn.using, *(_prefix(s, sample) for s in draws.values()))]
    met = met.select(sample, "_drawn", "_e.p", "_e.v", "_e.f", *[c.alias(f"_{i}") for i, c in enumerate(made)])
    # The axis is as long as the positions that each task holds of a sample.
    known = numbers.filter("position IS NOT NULL").toArrow().combine_chunks()
    places = np.asarray(known.column(0).combine_chunks())
    order = np.argsort(places, kind="stable")
    sent = rows.sparkSession.sparkContext.broadcast((places[order], known.column(1).combine_chunks().take(pa.array(order))))
    n, find, drawn_by = drawn.n_features, drawn.find, len(drawn.using)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, names = sent.value
        first = np.searchsorted(places, np.arange(n))
        times = np.searchsorted(places, np.arange(n), side="right") - first
        for batch in batches:
            lists = batch.columns[2:5]
            for r, chosen in enumerate(find(*batch.columns[5 : 5 + drawn_by])):
                chosen = np.asarray(chosen, np.int64)
                at, values = (np.asarray(c[r].values) if c[r].is_valid else np.zeros(0, t) for c, t in zip(lists[:2], (np.int64, np.float64)))
                own = lists[2][r].values if lists[2][r].is_valid else pa.array([], names.type)
                at = np.where((at >= 0) & (at < n), at, n)  # the last cell is that of features which no position names
                taken, held = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
                taken[chosen], held[at] = True, True
                hit, zeros = taken[at], chosen[~held[chosen]]
                masked, v = np.concatenate([at[hit], zeros]), np.concatenate([values[hit], np.zeros(len(zeros))])
                place, some = first[masked], times[masked]
                if (some != 1).any():  # a masked row for each time the axis has the position
                    place, v = np.repeat(place - np.cumsum(some) + some, some) + np.arange(some.sum()), np.repeat(v, some)
                found, others = names.take(pa.array(place)), int((~hit).sum())
                columns = [pa.concat_arrays([found, own.filter(pa.array(~hit))]), pa.array(np.concatenate([v, values[~hit]])), pa.array(np.arange(len(v) + others) < len(v))]
                for c in batch.columns[5 + drawn_by :]:
                    numbers = md5_ids(c[r].as_py(), found) if len(found) else np.zeros(0, np.int64)
                    columns.append(pa.concat_arrays([pa.array(numbers), pa.nulls(others, pa.int64())]))
                row = pa.RecordBatch.from_arrays([pa.repeat(batch.column(0)[r], len(v) + others), *columns], names=[sample, feature, value, "mask", *draws])
                yield from (row.slice(lo, SENT_ROWS) for lo in range(0, row.num_rows, SENT_ROWS))

    schema = f"`{sample}` {met.schema[sample].dataType.simpleString()}, `{feature}` {kind.simpleString()}, `{value}` double, mask boolean"
    return met.mapInArrow(mark, schema + "".join(f", `{d}` bigint" for d in draws))


def bernoulli(rate: float, seed: int, *ids, hash_fn: str = "xxhash64") -> Column:
    return uniform(seed, *ids, hash_fn=hash_fn) < rate


def uniform_draw(low: Column, high: Column, seed: int, *ids, hash_fn: str = "xxhash64", drawn: Column | None = None) -> Column:
    """Uniform on the feature's [low, high]."""
    return low + (high - low) * uniform(seed, *ids, hash_fn=hash_fn, drawn=drawn)


#: Rows of a table of features that is sent to all executors.
SENT_FEATURES = 2_000_000


def sent(features: DataFrame) -> DataFrame:
    """A table with a row per feature, written once and sent to all executors if it is within SENT_FEATURES, so that the rows which meet it stay where they are."""
    once = stable(features)
    return F.broadcast(once) if once.count() <= SENT_FEATURES else once


def number_pool(train_samples: DataFrame, sample: str) -> DataFrame:
    """(pool_row, sample) numbered from 0 in hash order, range by range."""
    hexed = train_samples.select(sample).distinct().withColumn("_hex", md5_hex("pool", F.col(sample)))
    placed = hash_rank(hexed.withColumn("_all", F.lit(0)), ["_all"], "_hex", sample)
    return placed.select(F.col("rank").alias("pool_row"), F.col(sample).alias("pool_sample"), F.col("size").alias("pool_size"))


#: Stored training values that are sent to all executors as one list a feature, and the longest list.
SENT_VALUES, SENT_LIST = 8_000_000, 512


def marginal_draws(rows: DataFrame, train: DataFrame, pool: DataFrame, sample: str, feature: str = "feature",
                   value: str = "value", seed: int = 0, hash_fn: str = "xxhash64", drawn: str | None = None) -> DataFrame:
    """`replacement`: the feature's value in a random training row, drawn anew for every entry.

    The training values are numbered by their rows of the pool, and an entry
    meets them by (row, feature). A missing value is an implied zero. An empty
    pool fails the job. Where the training values are few and spread over the
    features, they are sent to the entries as one list a feature, so that the
    entries aren't shuffled. `drawn` names a column with the entry's `draw`.
    """
    size = pool.agg(F.count("*")).scalar()
    empty = F.raise_error(F.lit("the pool of training rows is empty")).cast("bigint")
    number = choice(seed, size, F.col(sample), F.col(feature), hash_fn=hash_fn, drawn=None if drawn is None else F.col(drawn))
    entries = rows.withColumn("pool_row", F.coalesce(number, empty))
    source = train.select(F.col(sample).alias("pool_sample"), feature, F.col(value).cast("double").alias("_found"))
    source = stable(source.join(pool.select("pool_row", "pool_sample"), "pool_sample").select("pool_row", feature, "_found"))
    each = source.groupBy(feature).agg(F.count("*").alias("n"), F.countDistinct("pool_row").alias("d"))
    total, longest, repeated = each.agg(F.sum("n"), F.max("n"), F.max(F.col("n") - F.col("d"))).first()
    if total is not None and total <= SENT_VALUES and longest <= SENT_LIST and not repeated:
        listed = source.groupBy(feature).agg(F.sort_array(F.collect_list(F.struct("pool_row", "_found"))).alias("_l"))
        listed = listed.select(feature, F.col("_l.pool_row").alias("_rows"), F.col("_l._found").alias("_values"))
        met = entries.join(F.broadcast(listed), feature, "left")
        at = F.array_position("_rows", F.col("pool_row"))
        met = met.withColumn("_found", F.when(at > 0, F.get("_values", (at - 1).cast("int"))))
        met = met.select(*entries.columns, "_found")
    else:
        met = entries.join(source, ["pool_row", feature], "left")
    return met.withColumn("replacement", F.coalesce("_found", F.lit(0.0))).drop("_found", "pool_row")


def corrupt(mask: Column, replacement: Column, value: Column) -> Column:
    return F.when(mask, replacement).otherwise(value)


def bernoulli_corrupt(rows: DataFrame, train: DataFrame, pool: DataFrame, sample: str, rate: float, seed: int = 0,
                      feature: str = "feature", value: str = "value", hash_fn: str = "xxhash64") -> DataFrame:
    """Bernoulli corruption with marginal values; `changed` marks where the value really moved."""
    ids = (F.col(sample), F.col(feature))
    drawn = marginal_draws(rows, train, pool, sample, feature, value, seed + 1, hash_fn)
    out = drawn.withColumn(
        "corrupted", corrupt(bernoulli(rate, seed, *ids, hash_fn=hash_fn), F.col("replacement"), F.col(value).cast("double"))
    )
    return out.withColumn("changed", F.col("corrupted") != F.col(value)).drop("replacement")


def fixed_corrupt(rows: DataFrame, count: int, sample: str, replacement: Column, seed: int = 0,
                  feature: str = "feature", value: str = "value", hash_fn: str = "xxhash64") -> DataFrame:
    """Exactly `count` features of each sample take the replacement."""
    masked = share_mask(rows, sample, count, feature, seed, hash_fn)
    return masked.withColumn("corrupted", corrupt(F.col("mask"), replacement, F.col(value).cast("double")))


def normal(seed: int, *ids, hash_fn: str = "xxhash64") -> Column:
    """Standard normal by Box-Muller from two hashes."""
    u1, u2 = uniform(seed, *ids, hash_fn=hash_fn), uniform(seed + 1, *ids, hash_fn=hash_fn)
    return F.sqrt(-2 * F.ln(1 - u1)) * F.cos(2 * math.pi * u2)


def augment(rows: DataFrame, sample: str, mask_prob: float, jitter_std: float, none_prob: float = 0.1, seed: int = 0,
            feature: str = "feature", value: str = "value", hash_fn: str = "xxhash64") -> DataFrame:
    """A view of each sample: left alone, masked to 0, or jittered; the last two equally likely."""
    s, ids = F.col(sample), (F.col(sample), F.col(feature))
    u = uniform(seed, s, hash_fn=hash_fn)
    kind = F.when(u < none_prob, "none").when(u < none_prob + (1 - none_prob) / 2, "mask").otherwise("jitter")
    v = F.col(value).cast("double")
    masked = F.when(uniform(seed + 1, *ids, hash_fn=hash_fn) < mask_prob, 0.0).otherwise(v)
    jittered = v + jitter_std * normal(seed + 2, *ids, hash_fn=hash_fn)
    seen = rows.withColumn("view", kind)
    return seen.withColumn(
        "augmented", F.when(F.col("view") == "none", v).when(F.col("view") == "mask", masked).otherwise(jittered)
    )


CASE_CUTS = [256.0 * i for i in range(1, 256)]


def number_candidates(pool: DataFrame, scope: str, case: str, row: str) -> tuple[DataFrame, DataFrame]:
    """Pool rows numbered within `scope`, and each case's block of adjacent numbers.

    "A row of another patient" then is a range to step over. Cases are laid out
    in hash order and rows in hash order inside them; neither a hot scope nor a
    hot case is sorted in one task.
    """
    rows = pool.select(scope, case, row).withColumn("_hex", md5_hex("row", F.col(row)))
    rows = hash_rank(rows, [scope, case], "_hex", row)
    cases = pool.groupBy(scope, case).agg(F.count("*").alias("block_size"))
    cases = cases.withColumn("_hex", md5_hex("case", F.col(case)))
    cases = cases.withColumn("_slot", F.conv(F.substring("_hex", 1, 4), 16, 10).cast("bigint"))
    slots = prefix_sums(cases, [scope], "_slot", {"rows": F.col("block_size")}, CASE_CUTS)
    inside = W.partitionBy(scope, "_slot").orderBy("_hex", case).rowsBetween(W.unboundedPreceding, -1)
    blocks = (
        cases.withColumn("_in", F.coalesce(F.sum("block_size").over(inside), F.lit(0)))
        .join(slots.select(scope, "_slot", "rows_before", "rows_all"), [scope, "_slot"])
        .select(
            scope, case, "block_size", (F.col("rows_before") + F.col("_in")).alias("block_start"),
            F.col("rows_all").alias("pool_size"),
        )
    )
    placed = rows.join(blocks.select(scope, case, "block_start"), [scope, case])
    return placed.select(scope, row, (F.col("block_start") + F.col("rank")).alias("position")), blocks


def _step_over(anchors: DataFrame, blocks: DataFrame, case: str, sample: str, seed: int, hash_fn: str) -> DataFrame:
    """Anchors with a uniform `position` outside their own case's block; null where there is none."""
    sizes = blocks.groupBy("_scope").agg(F.max("pool_size").alias("_pool"))
    own = blocks.select("_scope", case, F.col("block_start").alias("_start"), F.col("block_size").alias("_len"))
    met = anchors.join(sizes, "_scope", "left").join(own, ["_scope", case], "left")
    length = F.coalesce("_len", F.lit(0))
    pick = choice(seed, F.coalesce("_pool", F.lit(0)) - length, F.col(sample), hash_fn=hash_fn)
    step = F.when(pick >= F.coalesce("_start", F.lit(0)), length).otherwise(0)
    return met.withColumn("position", pick + step).drop("_pool", "_start", "_len")


def draw_negatives(anchors: DataFrame, pool: DataFrame, case: str, project: str, sample: str,
                   negatives: str = "any", seed: int = 0, hash_fn: str = "xxhash64") -> DataFrame:
    """Anchors with `negative`: a uniform pool row of another patient.

    `negatives="project"` stays inside the project, and takes the whole pool
    where the project holds one patient. Nothing is rejected or redrawn. A pool
    with no other patient fails the job.
    """
    if negatives not in ("any", "project"):
        raise ValueError(f"unknown negatives {negatives!r}; expected 'any' or 'project'")
    candidates = pool.select(F.col(project).cast("string").alias("_scope"), case, F.col(sample).alias("negative"))
    if negatives == "project":
        cases = candidates.groupBy("_scope").agg(F.min(case).alias("_lo"), F.max(case).alias("_hi"))
        several = cases.filter(F.col("_lo") != F.col("_hi")).select("_scope")
        local = candidates.join(several, "_scope", "left_semi")
        everyone = candidates.withColumn("_scope", F.lit("*"))
        candidates = local.unionByName(everyone)
        scoped = anchors.withColumn("_project", F.col(project).cast("string")).join(
            several.select(F.col("_scope").alias("_project"), F.lit(True).alias("_several")), "_project", "left"
        )
        scoped = scoped.withColumn("_scope", F.when(F.col("_several"), F.col("_project")).otherwise("*"))
        scoped = scoped.drop("_project", "_several")
    else:
        candidates = candidates.withColumn("_scope", F.lit("*"))
        scoped = anchors.withColumn("_scope", F.lit("*"))
    placed, blocks = number_candidates(stable(candidates), "_scope", case, "negative")
    blocks = stable(blocks)
    none_left = F.raise_error(F.lit("no row of another patient in the pool")).cast("bigint")
    drawn = _step_over(scoped, blocks, case, sample, seed, hash_fn)
    drawn = drawn.withColumn("position", F.coalesce("position", none_left))
    return drawn.join(placed, ["_scope", "position"]).drop("_scope", "position")


def triplets(rows: DataFrame, anchors: DataFrame, pool: DataFrame, case: str, project: str, sample: str,
             mask_prob: float, jitter_std: float, negatives: str = "any", seed: int = 0,
             feature: str = "feature", value: str = "value", hash_fn: str = "xxhash64") -> DataFrame:
    """(anchor, role, feature, augmented): anchor and positive views of the anchor, and a negative's view."""
    drawn = draw_negatives(anchors.select(sample, case, project), pool, case, project, sample, negatives, seed, hash_fn)
    roles = []
    for offset, (role, source) in enumerate([("anchor", sample), ("positive", sample), ("negative", "negative")]):
        ids = drawn.select(F.col(sample).alias("anchor"), F.col(source).alias("_source"))
        joined = ids.join(rows.withColumnRenamed(sample, "_source"), "_source")
        view = augment(joined, "anchor", mask_prob, jitter_std, 0.1, seed + 10 * (offset + 1), feature, value, hash_fn)
        roles.append(view.select("anchor", F.lit(role).alias("role"), feature, "augmented"))
    return roles[0].unionByName(roles[1]).unionByName(roles[2])
