"""Scalar rules: nulls, sentinels, ratios, bins, row-wise reductions, geography and vectors. All are column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(a, b, empty: float | None = None) -> Column:
    """a / b; null, or `empty`, where b is 0."""
    r = F.try_divide(col(a).cast("double"), col(b).cast("double"))
    return r if empty is None else F.coalesce(r, F.lit(empty))


def floored_log10(x, floor: float = 1.0) -> Column:
    """log10 of x, at least of `floor`; null stays null (greatest() would skip it)."""
    return F.when(col(x).isNotNull(), F.log10(F.greatest(col(x).cast("double"), F.lit(floor))))


def zfill(x, width: int) -> Column:
    """Zeros on the left up to width; longer strings stay whole (lpad() would cut them)."""
    x = F.regexp_replace(col(x).cast("string"), r"^\s+|\s+$", "")
    return F.when(F.length(x) < width, F.lpad(x, width, "0")).otherwise(x)


def numeric(x) -> Column:
    """A number, or null where there is none; NaN is null too."""
    v = col(x).cast("string").try_cast("double")
    return F.when(~F.isnan(v), v)


def sentinel(x, *codes) -> Column:
    return F.when(~col(x).isin(*codes), col(x))


def three_state(hidden, value) -> Column:
    """disclosed, suppressed or absent, from a flag and a value: a missing flag means that there is no cell."""
    return F.when(col(hidden).isNull(), "absent").when(col(hidden), "suppressed").when(col(value).isNotNull(), "disclosed").otherwise("absent")


def non_negative(x) -> Column:
    return F.when(col(x) >= 0, col(x))


def fixed_bin(x, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """The label of the left-closed bin that holds x; null outside."""
    x, out = col(x), F.lit(None).cast("string")
    for lo, hi, label in reversed(list(zip(edges, edges[1:], labels))):
        out = F.when((x >= lo) & (x < hi), label).otherwise(out)
    return out


def row_sum(*xs) -> Column:
    """Nulls count as 0."""
    return reduce(lambda a, b: a + b, [F.coalesce(col(x).cast("double"), F.lit(0.0)) for x in xs])


def row_count(*xs) -> Column:
    return reduce(lambda a, b: a + b, [col(x).isNotNull().cast("long") for x in xs])


def row_mean(*xs) -> Column:
    return F.when(row_count(*xs) > 0, ratio(row_sum(*xs), row_count(*xs)))


def row_any(*xs) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(col(x).cast("boolean"), F.lit(False)) for x in xs])


def row_argmax(pairs: Sequence[tuple[str, Column | str]]) -> Column:
    """The first label with the largest value, in the given order; null where all values are null."""
    best = F.array_max(F.array(*[F.struct(F.coalesce(col(v).cast("double"), F.lit(-math.inf)).alias("v"), F.lit(-i).alias("i"), F.lit(n).alias("n")) for i, (n, v) in enumerate(pairs)]))
    return F.when(best["v"] > -math.inf, best["n"])


def last_true(pairs: Sequence[tuple[str, Column | str]], default: str) -> Column:
    """The label of the last true flag, else the default."""
    return F.coalesce(*[F.when(F.coalesce(col(c).cast("boolean"), F.lit(False)), F.lit(n)) for n, c in reversed(pairs)], F.lit(default))


def quadrant(x, y, labels: tuple[str, str, str, str]) -> Column:
    """By x >= 0 and y <= 0: both, x only, y only, neither; null where either is."""
    a, b = col(x) >= 0, col(y) <= 0
    return F.when(col(x).isNull() | col(y).isNull(), None).when(a & b, labels[0]).when(a, labels[1]).when(b, labels[2]).otherwise(labels[3])


def is_flag(df: DataFrame, c: str) -> Column:
    """An aggregate: whether all non-null values are 0 or 1."""
    return F.bool_and(F.col(c).isin(0, 1))


def typed(x, kind: str) -> Column:
    """log1p of counts; flags stay."""
    return F.log1p(col(x)) if kind == "count" else col(x).cast("double")


def haversine(lat1, lon1, lat2, lon2, radius: float = 6371.0088) -> Column:
    a, b, c, d = (F.radians(col(v)) for v in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((c - a) / 2), 2) + F.cos(a) * F.cos(c) * F.pow(F.sin((d - b) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), h))))


def on_sphere(lat, lon, radius: float = 6371.0) -> list[Column]:
    p, t = F.radians(col(lat)), F.radians(col(lon))
    return [F.cos(p) * F.cos(t) * radius, F.cos(p) * F.sin(t) * radius, F.sin(p) * radius]


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit_vector(v, floor: float = 1e-12) -> Column:
    """v by its length; the length is computed once, not for each component."""
    size = F.greatest(F.sqrt(dot(v, v)), F.lit(floor))
    return F.element_at(F.transform(F.array(size), lambda n: F.transform(col(v), lambda x: x.cast("double") / n)), 1)


def ratio_error(num, num_se, den, den_se, proportion: bool = True) -> Column:
    """Standard error of num / den: for proportions the radicand subtracts, and adds where that would be negative; null at den = 0."""
    n, ns, d, ds = (col(x).cast("double") for x in (num, num_se, den, den_se))
    r = F.try_divide(n, d)
    less, more = ns * ns - r * r * ds * ds, ns * ns + r * r * ds * ds
    inside = F.when(less >= 0, less).otherwise(more) if proportion else more
    return F.try_divide(F.sqrt(inside), d)
