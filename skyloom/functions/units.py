"""Scalar cleaning: units, ranges, dates, labels, distances. All are column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Molar volume over molar mass of NO2, and the Mexican network's variant.
UG_TO_PPB, UG_TO_PPB_MX = 24.45 / 46.0, 24.465 / 46.0055
EARTH_KM = 6371.0


def normal_unit(unit: Column) -> Column:
    return F.translate(F.lower(F.trim(unit)), "μ³", "µ3")


def to_ppb(value: Column, unit: Column, factors: dict[str, float] | None = None) -> Column:
    """Concentration in ppb; null for units without a factor."""
    out = F.lit(None).cast("double")
    for name, factor in (factors or {"ppb": 1.0, "ppm": 1000.0, "µg/m3": UG_TO_PPB, "pphm": 10.0}).items():
        out = F.when(normal_unit(unit) == name, value * F.lit(factor)).otherwise(out)
    return out


def in_range(value: Column, low: float, high: float | None, closed: bool = True) -> Column:
    ok = value >= low if closed else value > low
    return ok if high is None else ok & (value <= high if closed else value < high)


def any_timestamp(text: Column) -> Column:
    """Timestamps from texts with slashes or dashes, fractions, or a leading HH:MM before a date; null if none fits."""
    bare = F.substring(F.replace(F.regexp_replace(F.trim(text), r"^\d{1,2}:\d{2} +", ""), F.lit("/"), F.lit("-")), 1, 19)
    return F.coalesce(F.try_to_timestamp(bare, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(bare, F.lit("yyyy-MM-dd")))


def from_parts(year: Column, month: Column, day: Column, hour: Column) -> Column:
    return F.try_make_timestamp(year, month, day, hour, F.lit(0), F.lit(0))


def dms(degrees: Column, minutes: Column, seconds: Column) -> Column:
    return degrees + minutes / F.lit(60.0) + seconds / F.lit(3600.0)


def days_in_month(year: Column, month: Column) -> Column:
    return F.dayofmonth(F.last_day(F.make_date(year, month, F.lit(1))))


def season(month: Column) -> Column:
    return F.when(month.isin(12, 1, 2), "DJF").when(month.isin(3, 4, 5), "MAM").when(month.isin(6, 7, 8), "JJA").otherwise("SON")


def sensor_type(is_mobile: Column, is_monitor: Column) -> Column:
    return F.when(is_mobile & ~is_monitor, "low_cost").when(is_monitor & ~is_mobile, "stationary").otherwise("unknown")


def solar_offset(lon: Column) -> Column:
    """Hours from UTC to local solar time."""
    return F.rint(lon / F.lit(15.0))


def unit_vector(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    a, b = F.radians(lat), F.radians(lon)
    return F.cos(a) * F.cos(b), F.cos(a) * F.sin(b), F.sin(a)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_KM) -> Column:
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * radius) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def slug(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]+", "_"), "^_|_$", "")


def station_name(header: Column, path: Column, pattern: str = r"Station Name:\s*([^,\n]+)") -> Column:
    """Name in a header's text by a pattern, else the file's name without folder and ending."""
    found = F.nullif(F.trim(F.regexp_extract(header, pattern, 1)), F.lit(""))
    return F.coalesce(found, F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"\.[^.]*$", ""))


def header_unit(header: Column, variable: str) -> Column:
    """The cell under a variable's name in a header's block of separated lines; null if it is not there."""
    rows = F.filter(F.transform(F.split(header, "\n"), lambda r: F.transform(F.split(r, ","), lambda c: F.trim(c))), lambda r: F.size(r) > 0)
    at = F.array_position(F.transform(rows, lambda r: F.array_position(r, variable) > 0), True).cast("int")
    column = F.array_position(F.get(rows, at - 1), variable).cast("int")
    return F.when(at > 0, F.nullif(F.get(F.get(rows, at), column - 1), F.lit("")))


def nearest_index(x: Column, low: float, step: float, n: int) -> Column:
    """Half-even index of the nearest cell centre, clipped to the grid."""
    return F.least(F.greatest(F.rint((x - F.lit(low)) / F.lit(step)), F.lit(0.0)), F.lit(float(n - 1))).cast("int")


def era(year: Column, month: Column, cut: int = 201805) -> Column:
    return F.when(year * 100 + month <= cut, "OMI").otherwise("TROPOMI")


def flat_index(year: Column, month: Column, site: Column, n_sites: int, first_year: int = 2005) -> Column:
    return ((year - first_year) * 12 + (month - 1)) * n_sites + site


def fold_of(key: Column, k: int, seed: int = 20230130, repeat: int = 0) -> Column:
    """Fold 0..k-1 by a hash order that other engines can repeat."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed + repeat}-"), key.cast("string"))), 1, 8), 16, 10).cast("long")
    return h % k
