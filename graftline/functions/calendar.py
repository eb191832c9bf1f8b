"""Calendar arithmetic on 365-day years, virtual (season-aligned) day indexes and harvest phrases."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graftline.fixed_values import DAYS_BEFORE_MONTH, MONTH_NAMES, PART_OF_MONTH_DAY, SOUTH_SHIFT
from graftline.functions.numeric import col, half_up

MONTH_KEYS = [m.lower() for m in MONTH_NAMES]
_ANY_MONTH = "|".join(MONTH_KEYS)


def day_index(day: Column | str) -> Column:
    """Day of a 365-day year, 0..364 (29 February has no index of its own)."""
    d = col(day)
    y = F.year(d)
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    return F.dayofyear(d) - 1 - F.when(leap & (F.month(d) > 2), 1).otherwise(0)


def _plain_date(di: Column) -> Column:
    """The date of a 365-day-year index in a year without 29 February."""
    return F.date_add(F.lit("2001-01-01").cast("date"), di)


def month_of_index(di: Column | str) -> Column:
    """Month 0..11 of a 365-day-year index."""
    return F.month(_plain_date(col(di))) - 1


def season_index(vi: Column | str, southern: Column | str) -> Column:
    """Virtual index -> calendar index 0..364 (half-up on fractions)."""
    shift = F.when(col(southern), F.lit(SOUTH_SHIFT)).otherwise(F.lit(0))
    return F.pmod(half_up(vi) + shift, F.lit(365)).cast("int")


def doy_to_vi(doy: Column | str, southern: Column | str) -> Column:
    """Calendar index 0..364 -> virtual index for a hemisphere."""
    d = col(doy)
    return F.when(col(southern), F.pmod(d - SOUTH_SHIFT, F.lit(365))).otherwise(d)


def vi_to_date(vi: Column | str, southern: Column | str) -> Column:
    """Virtual index -> struct(month 0..11, day 1..31, doy 0..364)."""
    di = season_index(vi, southern)
    d = _plain_date(di)
    return F.struct((F.month(d) - 1).alias("month"), F.dayofmonth(d).alias("day"), di.alias("doy"))


def vi_label(vi: Column | str, southern: Column | str) -> Column:
    """Virtual index -> 'Apr 21'; '-' when missing."""
    return F.coalesce(F.date_format(_plain_date(season_index(vi, southern)), "MMM d"), F.lit("-"))


def _harvest_days(phrase: Column | str) -> Column:
    """Every 'early|mid|late <month>' of a phrase as a day index (null for an unknown month)."""
    s = F.regexp_replace(F.lower(col(phrase)), "[–—]", "-")
    rx = r"(early|mid|late)\s+([a-z]{3})[a-z]*"
    parts = F.arrays_zip(F.regexp_extract_all(s, F.lit(rx), 1).alias("part"), F.regexp_extract_all(s, F.lit(rx), 2).alias("mon"))

    def to_day(p: Column) -> Column:
        start = F.when(F.lit(False), F.lit(0))
        for name, before in zip(MONTH_KEYS, DAYS_BEFORE_MONTH):
            start = start.when(p["mon"] == name, F.lit(before))
        add = F.when(F.lit(False), F.lit(0))
        for name, day in PART_OF_MONTH_DAY.items():
            add = add.when(p["part"] == name, F.lit(day))
        return start + add

    return F.transform(parts, to_day)


def parse_harvest(phrase: Column | str) -> Column:
    """'mid Sep-early Oct' -> mean day index (half-even); null when nothing, or an unknown month, is named."""
    days = _harvest_days(phrase)
    total = F.aggregate(days, F.lit(0), lambda a, d: a + d)          # an unknown month makes the sum null
    return F.when(F.size(days) > 0, F.bround(total / F.size(days), 0).cast("int"))


def parse_harvest_range(phrase: Column | str) -> Column:
    """struct(lo, hi): five days either side of the earliest and latest part named."""
    known = F.filter(_harvest_days(phrase), lambda d: d.isNotNull())
    return F.when(F.size(known) > 0, F.struct((F.array_min(known) - 5).alias("lo"), (F.array_max(known) + 5).alias("hi")))


def eating_months(phrase: Column | str) -> Column:
    """'Nov-Feb' -> [10, 11, 0, 1]: from the first month named to the second, wrapping over the new year."""
    named = F.transform(F.regexp_extract_all(F.lower(col(phrase)), F.lit(f"({_ANY_MONTH})"), 1),
                        lambda m: F.array_position(F.array(*[F.lit(k) for k in MONTH_KEYS]), m).cast("int") - 1)
    first = F.try_element_at(named, F.lit(1))
    last = F.try_element_at(named, F.least(F.size(named), F.lit(2)))
    span = F.sequence(first, first + F.pmod(last - first, F.lit(12)))
    return F.when(F.size(named) > 0, F.transform(span, lambda i: i % 12))


def season_band(doy: Column | str) -> Column:
    d = col(doy)
    return F.when(d < 232, "early").when(d < 262, "early-mid").when(d < 282, "mid").when(d.isNotNull(), "late")


def season_key(doy: Column | str) -> Column:
    d = col(doy)
    return F.when(d < 245, "early").when(d < 280, "mid").when(d.isNotNull(), "late")


def season_name(doy: Column | str) -> Column:
    d = col(doy)
    return F.when(d < 245, "Early season").when(d < 280, "Mid season").when(d.isNotNull(), "Late season").otherwise("unknown")


def method_year(method: Column | str) -> Column:
    """Year suffix of a method name ('...'.98 -> 1998, '.2004' -> 2004)."""
    y = F.regexp_extract(col(method), r"\.(\d{2,4})$", 1)
    short = F.concat(F.when(y.try_cast("int") >= 50, "19").otherwise("20"), y)
    return F.when(F.length(y) == 4, y).when(F.length(y) > 0, short)


def year_span(years: Column | str) -> Column:
    """['2003', '1999'] -> '1999-2003'; one year stays alone."""
    ys = F.filter(F.transform(col(years), lambda y: y.cast("int")), lambda y: y.isNotNull() & (y != 0))
    lo, hi = F.array_min(ys), F.array_max(ys)
    return F.when(lo == hi, lo.cast("string")).when(lo.isNotNull(), F.concat(lo.cast("string"), F.lit("-"), hi.cast("string")))
