"""Per-day weather expressions.  All are plain columns (no UDF, no lambda), so they stay inside code generation.

The hourly course of a day is m + a*cos(2*pi*(hour + 0.5 - 15)/24) with m the
mean and a half the range of the day's extremes.  Its 24 hours fall on twelve
distinct offsets from the warmest moment, each reached twice, so a 24-hour sum
is twice a sum of twelve terms.
"""
from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from graftline.fixed_values import (BLIGHT_BASE, GDD_BASE, GDD_CAP, KOPPEN_NAMES, MID_MONTH, MILLS_BINS, MILLS_COLDEST, UTAH_BINS)
from graftline.functions.calendar import season_index
from graftline.functions.numeric import clamp, col, radians

_HOUR_COS = [math.cos(2 * math.pi * (k + 0.5) / 24) for k in range(12)]


def _day_sum(tmax, tmin, term: Callable[[Column], Column]) -> Column:
    m = (col(tmax) + col(tmin)) / F.lit(2.0)
    a = (col(tmax) - col(tmin)) / F.lit(2.0)
    terms = [term(m + a * F.lit(c)) for c in _HOUR_COS]
    return F.lit(2.0) * reduce(lambda x, y: x + y, terms)


def saturation_pressure(t: Column | str) -> Column:
    """Saturation vapour pressure, kPa."""
    t = col(t)
    return F.lit(0.6108) * F.exp(F.lit(17.27) * t / (t + F.lit(237.3)))


def relative_humidity(t: Column, dew_pressure: Column) -> Column:
    return F.least(F.lit(100.0), F.lit(100.0) * dew_pressure / saturation_pressure(t))


def day_humidity(tmax, tmin, dew_gap) -> tuple[Column, Column, Column]:
    """(mean relative humidity, humidity at the coldest hour, hours at 90% or more); dew point = tmin - dew_gap."""
    dew_pressure = saturation_pressure(col(tmin) - col(dew_gap))
    mean = _day_sum(tmax, tmin, lambda t: relative_humidity(t, dew_pressure)) / F.lit(24.0)
    night = relative_humidity(col(tmin), dew_pressure)
    dew = _day_sum(tmax, tmin, lambda t: F.when(relative_humidity(t, dew_pressure) >= 90.0, 1.0).otherwise(0.0))
    return mean, night, dew


def leaf_wet_hours(dew, prcp, rain_hours) -> Column:
    """Hours of wet leaves from dew hours and rain (rain hours of a wet day plus drying time), partly overlapping."""
    dew, p, hrs = col(dew), col(prcp), col(rain_hours)
    heavy = F.when(p > 10, F.least(F.lit(4.0), (p - F.lit(10.0)) / F.lit(5.0))).otherwise(0.0)
    rain = F.when(p >= 1, F.least(F.lit(22.0), hrs + F.lit(1.5) + heavy)).when(p >= 0.3, F.lit(0.5) * hrs).otherwise(0.0)
    return F.least(F.lit(24.0), F.greatest(dew, rain) + F.lit(0.25) * F.least(dew, rain))


def mills_hours(tmean) -> Column:
    """Wet hours needed for a scab infection at a mean temperature; null where none is possible."""
    t = col(tmean)
    out = F.when(t <= MILLS_COLDEST, F.lit(None).cast("double"))
    for limit, hours in MILLS_BINS:
        out = out.when(t < limit, F.lit(float(hours)))
    return out


def blight_degree_hours(tmax, tmin) -> Column:
    return _day_sum(tmax, tmin, lambda t: F.greatest(F.lit(0.0), t - F.lit(BLIGHT_BASE)))


def utah_weight(t) -> Column:
    t = col(t)
    out = None
    for limit, w in UTAH_BINS:
        out = F.when(t < limit, F.lit(w)) if out is None else out.when(t < limit, F.lit(w))
    return out.otherwise(0.0)


def chill_units(tmax, tmin) -> Column:
    """Chill of one day: the larger of the Utah units and half the hours below 9.2 C."""
    units = _day_sum(tmax, tmin, utah_weight)
    cold = _day_sum(tmax, tmin, lambda t: F.when(t < 9.2, 1.0).otherwise(0.0))
    return F.greatest(units, F.lit(0.5) * cold)


def hours_at_or_below(tmax, tmin, threshold: float) -> Column:
    return _day_sum(tmax, tmin, lambda t: F.when(t <= threshold, 1.0).otherwise(0.0))


def extraterrestrial_radiation(lat, doy) -> Column:
    """FAO-56 radiation at the top of the atmosphere, mm/day of evaporation; doy counts from 1."""
    phi, d = radians(lat), col(doy)
    year_angle = F.lit(2 * math.pi) * d / F.lit(365.0)
    dr = F.lit(1.0) + F.lit(0.033) * F.cos(year_angle)
    dec = F.lit(0.409) * F.sin(year_angle - F.lit(1.39))
    ws = F.acos(clamp(-F.tan(phi) * F.tan(dec), -1.0, 1.0))
    return (F.lit(0.408 * (24 * 60 / math.pi) * 0.082) * dr
            * (ws * F.sin(phi) * F.sin(dec) + F.cos(phi) * F.cos(dec) * F.sin(ws)))


def hargreaves_et0(lat, doy, tmax, tmin) -> Column:
    tx, tn = col(tmax), col(tmin)
    return F.greatest(F.lit(0.0), F.lit(0.0023) * extraterrestrial_radiation(lat, doy) * ((tx + tn) / F.lit(2.0) + F.lit(17.8))
                      * F.sqrt(F.greatest(F.lit(0.0), tx - tn)))


def growing_degrees(tmean) -> Column:
    return clamp(col(tmean) - F.lit(GDD_BASE), 0.0, GDD_CAP - GDD_BASE)


def usda_zone(min_c) -> Column:
    """Hardiness zone of a mean extreme minimum: struct(value, label, n)."""
    z = (col(min_c) * F.lit(9.0) / F.lit(5.0) + F.lit(32.0) + F.lit(60.0)) / F.lit(10.0)
    n = F.floor(z) + 1
    half = F.when(z - F.floor(z) >= 0.5, "b").otherwise("a")
    label = F.concat(F.when(n < 1, F.lit("<1")).otherwise(n.cast("string")), half)
    return F.when(z.isNotNull(), F.struct(F.greatest(F.lit(0.0), z + 1).alias("value"), label.alias("label"), n.alias("n")))


def koppen(tmean: Column | str, prcp: Column | str, southern: Column | str) -> Column:
    """Climate class code from twelve monthly mean temperatures and rain sums (calendar months)."""
    t, p, south = col(tmean), col(prcp), col(southern)
    add = lambda a, x: a + x                                                    # noqa: E731
    zero = F.lit(0.0)
    apr_sep = F.slice(p, 4, 6)
    oct_mar = F.concat(F.slice(p, 10, 3), F.slice(p, 1, 3))
    summer = F.when(south, oct_mar).otherwise(apr_sep)
    winter = F.when(south, apr_sep).otherwise(oct_mar)
    tann = F.aggregate(t, zero, add) / F.lit(12.0)
    pann = F.aggregate(p, zero, add)
    tmax, tmin, pmin = F.array_max(t), F.array_min(t), F.array_min(p)
    dry_limit = (F.when(F.aggregate(winter, zero, add) >= F.lit(0.7) * pann, F.lit(2.0) * tann)
                 .when(F.aggregate(summer, zero, add) >= F.lit(0.7) * pann, F.lit(2.0) * tann + 28.0)
                 .otherwise(F.lit(2.0) * tann + 14.0))
    driest = F.array_position(p, pmin) - 1                                     # month index, first on ties
    dry_summer = driest.between(F.when(south, 9).otherwise(3), F.when(south, 11).otherwise(8))
    arid = F.concat(F.when(pann < F.lit(5.0) * dry_limit, "BW").otherwise("BS"), F.when(tann >= 18, "h").otherwise("k"))
    tropical = (F.when(pmin >= 60, "Af").when(pann >= F.lit(25.0) * (F.lit(100.0) - pmin), "Am")
                .when(dry_summer, "As").otherwise("Aw"))
    second = (F.when((F.array_min(summer) < 40) & (F.array_min(summer) < F.array_max(winter) / F.lit(3.0)), "s")
              .when(F.array_min(winter) < F.array_max(summer) / F.lit(10.0), "w").otherwise("f"))
    warm_months = F.size(F.filter(t, lambda x: x >= 10))
    third = F.when(tmax >= 22, "a").when(warm_months >= 4, "b").when(tmin > -38, "c").otherwise("d")
    temperate = F.concat(F.when(tmin > 0, "C").otherwise("D"), second, third)
    return (F.when(tmax < 10, F.when(tmax < 0, "EF").otherwise("ET")).when(pann < F.lit(10.0) * dry_limit, arid)
            .when(tmin >= 18, tropical).when(tmin.isNotNull(), temperate))


def koppen_name(code: Column | str) -> Column:
    pairs = [F.lit(x) for kv in KOPPEN_NAMES.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), col(code)), col(code))


def normal_on(monthly: Column | str, doy: Column | str) -> Column:
    """Monthly normal interpolated to a calendar index 0..364 between mid-month knots, wrapping over the new year."""
    m, d = col(monthly), col(doy)
    wrap = (F.lit(365.0 - MID_MONTH[11] + MID_MONTH[0]))
    ends = m[11] + (m[0] - m[11]) * F.pmod(d - F.lit(MID_MONTH[11]) + 365, F.lit(365.0)) / wrap
    out = F.when(d < MID_MONTH[0], ends)
    for i in range(1, 12):
        lo, hi = MID_MONTH[i - 1], MID_MONTH[i]
        out = out.when(d < hi, m[i - 1] + (m[i] - m[i - 1]) * (d - F.lit(float(lo))) / F.lit(float(hi - lo)))
    return out.when(d.isNotNull(), ends)


def span_mean(monthly: Column | str, from_vi: Column, to_vi: Column, southern: Column | str) -> Column:
    """Mean of a monthly normal over virtual days from_vi..to_vi, sampled every third day.

    Days repeat after 365, so the normal is laid out once per third of a day
    only as far as the span needs (spans here are six or nine weeks)."""
    steps = F.sequence(F.lit(0), F.floor((to_vi - from_vi) / F.lit(3.0)).cast("int"))
    days = F.transform(steps, lambda k: normal_on(monthly, season_index(from_vi + k * 3, southern)))
    return F.aggregate(days, F.lit(0.0), lambda a, x: a + x) / F.size(days)


def curve_at(curve: Column | str, offset: Column | str, step: int = 10) -> Column:
    """Cumulative curve (one point per `step` days after bloom) at a fractional day offset, held at both ends."""
    c = col(curve)
    last = F.size(c) - 1
    x = clamp(col(offset) / F.lit(float(step)), F.lit(0.0), last.cast("double"))
    i = F.floor(x).cast("int")
    lo, hi = F.try_element_at(c, i + 1), F.try_element_at(c, i + 2)
    return F.when(i >= last, F.try_element_at(c, F.lit(-1))).otherwise(lo + (hi - lo) * (x - i))


def offset_for(curve: Column | str, gdd: Column | str, step: int = 10) -> Column:
    """First day offset at which the curve reaches a sum; null if it never does."""
    c, g = col(curve), col(gdd)
    i = F.array_min(F.filter(F.sequence(F.lit(1), F.size(c) - 1), lambda k: F.element_at(c, k + 1) >= g))
    a, b = F.try_element_at(c, i), F.try_element_at(c, i + 1)
    return (i - 1 + F.when(b > a, (g - a) / (b - a)).otherwise(0.0)) * F.lit(float(step))


def resample(values: Column | str, n: Column) -> Column:
    """Array stretched to n points by linear interpolation."""
    v = col(values)
    span = (F.size(v) - 1).cast("double")

    def point(i: Column) -> Column:
        x = F.when(n == 1, F.lit(0.0)).otherwise(i * span / (n - 1))
        lo = F.element_at(v, F.floor(x).cast("int") + 1)
        hi = F.element_at(v, F.ceil(x).cast("int") + 1)
        return lo + (hi - lo) * (x - F.floor(x))

    return F.when(F.size(v) == n, v).otherwise(F.transform(F.sequence(F.lit(0), n - 1), point))
