"""Ordered group operations that never sort a whole group in one task.

A window over a hot key sends that key to one task. These split each key's
order into ranges first: totals per (key, range) give every range its starting
value, and only the rows of one range meet in a window. Results are exact for
any choice of ranges; the ranges only balance the work.

Both the totals and the rows are needed, so the pre-aggregated table is written
once to the checkpoint folder: its input is computed once however these nest,
and a lost executor cannot make the two readings differ.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidyfold.session import stable

RANGES = 64


def cut_points(df: DataFrame, column: str, ranges: int = RANGES) -> list[float]:
    """At most `ranges - 1` approximate quantiles of a numeric column, ascending.

    A list of fixed size, held as literals so that every reader of the plan
    agrees on the ranges even if a task is rerun.
    """
    wanted = [i / ranges for i in range(1, ranges)]
    cuts = df.select(F.col(column).cast("double").alias("c")).approxQuantile("c", wanted, 0.25 / ranges)
    return sorted(set(cuts))


def range_of(column: Column, cuts: Sequence[float]) -> Column:
    """How many cut points lie below or at the value, as a balanced tree of comparisons."""

    def branch(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(column < F.lit(cuts[mid]), branch(lo, mid)).otherwise(branch(mid + 1, hi))

    return branch(0, len(cuts))


def prefix_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    sums: Mapping[str, Column],
    cuts: Sequence[float] | None = None,
    descending: bool = False,
) -> DataFrame:
    """One row per (keys, order): each sum `s`, `s_before` (strictly earlier) and `s_all`.

    Ties in `order` collapse before anything is sorted. `cuts` default to
    quantiles of the collapsed rows.
    """
    keys = list(keys)
    at = stable(df.groupBy(*keys, order).agg(*[F.sum(c).alias(n) for n, c in sums.items()]))
    cuts = cut_points(at, order) if cuts is None else list(cuts)
    at = at.withColumn("_range", range_of(F.col(order).cast("double"), cuts))
    direction = F.desc if descending else F.asc
    earlier = W.partitionBy(*keys).orderBy(direction("_range")).rowsBetween(W.unboundedPreceding, -1)
    base = (
        at.groupBy(*keys, "_range")
        .agg(*[F.sum(n).alias(n) for n in sums])
        .select(
            *keys,
            "_range",
            *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_base_{n}") for n in sums],
            *[F.sum(n).over(W.partitionBy(*keys)).alias(f"{n}_all") for n in sums],
        )
    )
    inside = W.partitionBy(*keys, "_range").orderBy(direction(order)).rowsBetween(W.unboundedPreceding, -1)
    local = at.select(
        "*", *[F.coalesce(F.sum(n).over(inside), F.lit(0)).alias(f"_in_{n}") for n in sums]
    )
    return local.join(base, [*keys, "_range"]).select(
        *keys,
        order,
        *sums,
        *[(F.col(f"_base_{n}") + F.col(f"_in_{n}")).alias(f"{n}_before") for n in sums],
        *[f"{n}_all" for n in sums],
    )


def hash_rank(df: DataFrame, keys: Sequence[str], hex_col: str, tie: str) -> DataFrame:
    """Adds `rank` (from 0) within `keys` by (`hex_col`, `tie`), and the key's `size`.

    The hash is uniform, so its first two hex digits already are 256 even ranges.
    """
    keys = list(keys)
    ranged = df.withColumn("_range", F.substring(hex_col, 1, 2))
    earlier = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    base = (
        ranged.groupBy(*keys, "_range")
        .agg(F.count("*").alias("_n"))
        .select(
            *keys,
            "_range",
            F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"),
            F.sum("_n").over(W.partitionBy(*keys)).alias("size"),
        )
    )
    inside = W.partitionBy(*keys, "_range").orderBy(hex_col, tie)
    return (
        ranged.withColumn("_in", F.row_number().over(inside) - 1)
        .join(base, [*keys, "_range"])
        .withColumn("rank", F.col("_base") + F.col("_in"))
        .drop("_range", "_base", "_in")
    )


def rank_rows(
    df: DataFrame,
    keys: Sequence[str],
    score: str,
    tie: str,
    score_cuts: Sequence[float] | None = None,
    tie_cuts: Sequence[float] | None = None,
) -> DataFrame:
    """(keys, score, tie, `rank` from 0): highest score first, ties by `tie` ascending.

    The rows are written once, since the two passes meet on the score.
    """
    keys = list(keys)
    df = stable(df.select(*keys, score, tie))
    by_score = prefix_sums(df, keys, score, {"n": F.lit(1)}, score_cuts, descending=True)
    by_tie = prefix_sums(df, [*keys, score], tie, {"one": F.lit(1)}, tie_cuts)
    return by_tie.join(by_score.select(*keys, score, "n_before"), [*keys, score]).select(
        *keys, score, tie, (F.col("n_before") + F.col("one_before")).alias("rank")
    )


def row_order(df: DataFrame, keys: Sequence[str], score: str, tie: str) -> DataFrame:
    """`rank_rows` for keys whose rows are bounded, like one sample's features: one window, planned lazily."""
    keys = list(keys)
    window = W.partitionBy(*keys).orderBy(F.desc(score), F.asc(tie))
    return df.select(*keys, score, tie).withColumn("rank", (F.row_number().over(window) - 1).cast("bigint"))


# Below this many rows kept per key, the map-side limit of the window is enough.
SALT_ABOVE = 64


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, salt: str | None = None) -> DataFrame:
    """The first k rows per key under `order` (which must be total), with `rank` from 1.

    A small k is cut on the map side already. A larger k is first cut within
    salted parts of the key, so a hot key reaches its last task as k rows per part.
    """
    keys = list(keys)
    if salt is not None and k > SALT_ABOVE:
        parts = W.partitionBy(*keys, "_part").orderBy(*order)
        df = (
            df.withColumn("_part", F.pmod(F.xxhash64(F.col(salt)), F.lit(1024)))
            .withColumn("rank", F.row_number().over(parts))
            .filter(F.col("rank") <= k)
            .drop("_part", "rank")
        )
    ranked = df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("rank") <= k)


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    cuts: Sequence[float] | None = None,
    weight: Column | None = None,
) -> DataFrame:
    """Linear-interpolation quantiles per key, one column per entry of `probs`.

    `weight` counts a row several times (for implicit zeros of a sparse table).
    No key's values are gathered in one place.
    """
    counts = {"n": F.lit(1) if weight is None else weight}
    at = prefix_sums(df.filter(F.col(value).isNotNull()), keys, value, counts, cuts)
    picks = []
    for name, p in probs.items():
        place = (F.col("n_all") - 1) * F.lit(float(p))
        for end, index in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            hit = (F.col("n_before") <= index) & (index < F.col("n_before") + F.col("n"))
            picks.append(F.max(F.when(hit, F.col(value).cast("double"))).alias(f"_{name}_{end}"))
        picks.append(F.max(place - F.floor(place)).alias(f"_{name}_part"))
    return at.groupBy(*keys).agg(*picks).select(
        *keys,
        *[
            (F.col(f"_{n}_lo") + (F.col(f"_{n}_hi") - F.col(f"_{n}_lo")) * F.col(f"_{n}_part")).alias(n)
            for n in probs
        ],
    )


#: Digits of a value per doubling, level by level: each level's counts pick one digit for the next.
LEVELS = (32, 1 << 17)
_OCTAVES = 1100  # doublings below 1 that a double can have, and some


def digit_of(value: Column, per_octave: int) -> Column:
    """A whole number that never falls as the value rises: its sign and how many `1/per_octave` doublings it is from the least double."""
    v = value.cast("double")
    size = F.floor((F.least(F.log2(F.abs(v)), F.lit(float(_OCTAVES))) + F.lit(float(_OCTAVES))) * F.lit(float(per_octave))) + 1
    return F.when(v == 0, F.lit(0)).when(v > 0, size).otherwise(-size).cast("bigint")


def selected_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float], weight: Column | None = None) -> DataFrame:
    """`exact_quantiles` of all keys at once by radix selection, planned lazily.

    A histogram of the values' leading digits tells in which digit a wanted rank
    lies; only that digit's rows go on to the next histogram, and the few that
    are left meet in a window. Histograms are added on the map side, and their
    size depends on the values' range, not on how many there are. `df` is read
    once for each level and once for the rest, so what must not change between
    readings should be written before. A key without a value has no row.
    """
    keys = list(keys)
    rows = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.sum(F.lit(1) if weight is None else weight).alias("_w")).filter("_w > 0")
    for k, per_octave in enumerate(LEVELS):
        rows = rows.withColumn(f"_d{k}", digit_of(F.col(value), per_octave))
    digits, by = [], keys
    for k in range(len(LEVELS)):
        part = W.partitionBy(*by)
        counts = rows.groupBy(*by, f"_d{k}").agg(F.sum("_w").alias("_n")) if k == 0 else met.groupBy(*by, *digits, f"_d{k}", "_place").agg(F.sum("_w").alias("_n"))
        counts = counts.withColumn("_before", F.sum("_n").over(part.orderBy(f"_d{k}")) - F.col("_n"))
        if k == 0:
            counts, last = counts.withColumn("_last", F.sum("_n").over(part) - 1), F.col("_last")
            ends = [F.struct(F.lit(f"{name}:{end}").alias("name"), near(last * F.lit(float(p))).cast("bigint").alias("place")) for name, p in probs.items() for end, near in (("lo", F.floor), ("hi", F.ceil))]
            counts = counts.withColumn("_wanted", F.explode(F.array(*ends))).select("*", F.col("_wanted.name").alias("_name"), F.col("_wanted.place").alias("_place"))
            by = [*keys, "_name"]
        inside = (F.col("_before") <= F.col("_place")) & (F.col("_place") < F.col("_before") + F.col("_n"))
        digits = [*digits, f"_d{k}"]
        picked = counts.filter(inside).select(*by, *digits, (F.col("_place") - F.col("_before")).alias("_place"))
        met = rows.join(picked, [*keys, *digits])
    here = W.partitionBy(*by).orderBy(value)
    found = met.withColumn("_before", F.sum("_w").over(here) - F.col("_w"))
    found = found.filter((F.col("_before") <= F.col("_place")) & (F.col("_place") < F.col("_before") + F.col("_w")))
    total = rows.groupBy(*keys).agg(F.sum("_w").alias("_all"))
    at = lambda name: F.max(F.when(F.col("_name") == name, F.col(value).cast("double")))
    ends = found.groupBy(*keys).agg(*[at(f"{n}:{e}").alias(f"_{n}_{e}") for n in probs for e in ("lo", "hi")])
    part = lambda p: (F.col("_all") - 1) * F.lit(float(p)) - F.floor((F.col("_all") - 1) * F.lit(float(p)))
    whole = ends.join(total, keys) if keys else ends.withColumn("_all", total.scalar())
    return whole.select(*keys, *[(F.col(f"_{n}_lo") + (F.col(f"_{n}_hi") - F.col(f"_{n}_lo")) * part(p)).alias(n) for n, p in probs.items()])


def running_min(df: DataFrame, keys: Sequence[str], order: str, value: str, cuts: Sequence[float] | None = None, descending: bool = True) -> DataFrame:
    """(keys, order, value): the smallest `value` at this `order` or any earlier one; descending by default."""
    keys = list(keys)
    at = stable(df.groupBy(*keys, order).agg(F.min(value).alias(value)))
    cuts = cut_points(at, order) if cuts is None else list(cuts)
    at = at.withColumn("_range", range_of(F.col(order).cast("double"), cuts))
    direction = F.desc if descending else F.asc
    earlier = W.partitionBy(*keys).orderBy(direction("_range")).rowsBetween(W.unboundedPreceding, -1)
    base = at.groupBy(*keys, "_range").agg(F.min(value).alias("_m"))
    base = base.select(*keys, "_range", F.min("_m").over(earlier).alias("_base"))
    inside = W.partitionBy(*keys, "_range").orderBy(direction(order)).rowsBetween(W.unboundedPreceding, 0)
    local = at.withColumn("_in", F.min(value).over(inside))
    # least skips the null of a first range.
    return local.join(base, [*keys, "_range"]).select(*keys, order, F.least("_in", "_base").alias(value))
