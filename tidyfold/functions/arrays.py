"""Row-wise array expressions: one sample's values or one embedding per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LIBRARY_SIZE = 1e5  # fixed value: the study's default library size
TRANSFORMS = ("none", "log1p", "lognorm")


def let(value: Column, body) -> Column:
    """`body(value)` with the value computed once per row.

    Inside a higher-order function an outer expression would be evaluated again
    for every element; bound as a lambda variable it is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    """Inner product in double."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The row scaled to length 1; a zero row stays zero."""
    inverse = F.when(norm(a) > 0, 1.0 / F.when(norm(a) > 0, norm(a))).otherwise(0.0)
    return let(inverse, lambda s: F.transform(a, lambda x: x.cast("double") * s))


def squared_distance(a: Column, b: Column) -> Column:
    gaps = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g)


def gaussian_kernel(a: Column, b: Column) -> Column:
    """exp(-|a - b|^2 / d^2)."""
    d = F.size(a).cast("double")
    return F.exp(-squared_distance(a, b) / (d * d))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - F.try_divide(dot(a, b), norm(a) * norm(b))


def pearson(a: Column, b: Column, constant: float | None = None) -> Column:
    """Correlation of two rows; `constant` (default null) where either row is constant."""
    n = F.size(a).cast("double")

    def centred(m: Column) -> Column:
        return F.struct(
            F.transform(a, lambda x: x.cast("double") - m["a"]).alias("a"), F.transform(b, lambda x: x.cast("double") - m["b"]).alias("b")
        )

    def ratio(c: Column) -> Column:
        scale = F.sqrt(dot(c["a"], c["a"]) * dot(c["b"], c["b"]))
        return F.when(scale > 0, dot(c["a"], c["b"]) / F.when(scale > 0, scale))

    means = F.struct((total(a) / n).alias("a"), (total(b) / n).alias("b"))
    r = let(let(means, centred), ratio)
    return r if constant is None else F.coalesce(r, F.lit(constant))


def log_normalize(values: Column, library_size: float = LIBRARY_SIZE) -> Column:
    """Scale a row to `library_size` (its own total floored at 1), then log1p."""
    scale = F.lit(float(library_size)) / F.greatest(total(values), F.lit(1.0))
    return let(scale, lambda s: F.transform(values, lambda x: F.log1p(x.cast("double") * s)))


def transform_values(values: Column, transform: str = "none", library_size: float = LIBRARY_SIZE) -> Column:
    if transform == "none":
        return values
    if transform == "log1p":
        return F.transform(values, lambda x: F.log1p(x.cast("double")))
    if transform == "lognorm":
        return log_normalize(values, library_size)
    raise ValueError(f"unknown transform {transform!r}; expected one of {TRANSFORMS}")


def gather(values: Column, positions: list[int]) -> Column:
    """`values` at the given positions, in that order; null past the end."""
    where = F.array(*[F.lit(int(p)) for p in positions])
    return F.transform(where, lambda i: F.get(values, i))


def pad(values: Column, length: int, fill) -> Column:
    """`values` extended on the right with `fill` to `length`."""
    missing = F.greatest(F.lit(length) - F.size(values), F.lit(0))
    return F.concat(values, F.array_repeat(F.lit(fill).cast("bigint"), missing))
