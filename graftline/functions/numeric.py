"""Numeric column helpers shared by every operator."""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clamp(x: Column | str, lo, hi) -> Column:
    """x held within [lo, hi]; null stays null."""
    x = col(x)
    lo = lo if isinstance(lo, Column) else F.lit(lo)
    hi = hi if isinstance(hi, Column) else F.lit(hi)
    return F.when(x.isNotNull(), F.greatest(lo, F.least(hi, x)))


def half_up(x: Column | str) -> Column:
    """Round half towards +infinity (-2.5 -> -2), the rounding used for scores and labels."""
    return F.floor(col(x) + F.lit(0.5))


def half_up_to(x: Column | str, decimals: int) -> Column:
    scale = float(10 ** decimals)
    return F.floor(col(x) * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def piecewise(x: Column | str, points: Sequence[tuple[float, float]]) -> Column:
    """Linear interpolation through sorted (x, y) points, flat outside the ends."""
    x = col(x)
    out = F.when(x <= F.lit(float(points[0][0])), F.lit(float(points[0][1])))
    for (x0, y0), (x1, y1) in zip(points, points[1:]):
        line = F.lit(float(y0)) + F.lit(float(y1 - y0)) * (x - F.lit(float(x0))) / F.lit(float(x1 - x0))
        out = out.when(x <= F.lit(float(x1)), line)
    return out.when(x.isNotNull(), F.lit(float(points[-1][1])))


def banded(x: Column | str, bands: Sequence[tuple[float | None, str]]) -> Column:
    """First band whose lower bound x reaches; the last band (bound None) takes the rest."""
    x = col(x)
    out = None
    for bound, label in bands:
        if bound is None:
            return out.when(x.isNotNull(), F.lit(label))
        out = F.when(x >= F.lit(bound), F.lit(label)) if out is None else out.when(x >= F.lit(bound), F.lit(label))
    return out


def norm_cdf(z: Column | str) -> Column:
    """Standard normal distribution function (Abramowitz-Stegun 26.2.17)."""
    z = col(z)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.2316419) * F.abs(z))
    poly = F.lit(1.330274)
    for c in (-1.821256, 1.781478, -0.3565638, 0.3193815):
        poly = F.lit(c) + t * poly
    tail = F.lit(0.3989423) * F.exp(-z * z / F.lit(2.0)) * t * poly
    return F.when(z > 0, F.lit(1.0) - tail).otherwise(tail)


def parse_number(c: Column | str) -> Column:
    """Text to double; blank, NA, NaN and '.' are missing."""
    t = F.trim(col(c))
    v = t.try_cast("double")
    return F.when(~t.isin("", "NA", "NaN", "nan", ".") & ~F.isnan(v), v)


def mean_score(avg: Column | str) -> Column:
    """A mean shown with at most one decimal (half-even)."""
    return F.bround(col(avg), 1)


def weeks_shift(days: Column | str) -> Column:
    """Signed whole weeks: half-up on the size, sign of the shift."""
    d = col(days)
    return (F.signum(d.cast("double")) * half_up(F.abs(d) / F.lit(7.0))).cast("int")


def wrap_lon(lon: Column | str) -> Column:
    """Longitude folded into [-180, 180)."""
    return (col(lon) + F.lit(540.0)) % F.lit(360.0) - F.lit(180.0)


def percentile_centre(rating: Column | str, centres: dict[int, int]) -> Column:
    r = col(rating)
    out = None
    for k, v in centres.items():
        out = F.when(r == k, F.lit(v)) if out is None else out.when(r == k, F.lit(v))
    return out


def ordinal(n: Column | str) -> Column:
    """1 -> '1st', 12 -> '12th', 23 -> '23rd'."""
    n = col(n).cast("bigint")
    suffix = (F.when((n % 100).between(10, 20), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd")
              .when(n % 10 == 3, "rd").otherwise("th"))
    return F.concat(n.cast("string"), suffix)


def radians(x: Column | str) -> Column:
    return col(x) * F.lit(math.pi / 180.0)
