"""Column expressions for panel data; all are built-in functions and stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS = 6378137.0
MAX_LATITUDE = 85.05112878


def parse_cell_id(raw: Column) -> Column:
    """The text after the first underscore; all of it without one; empty for null."""
    return F.coalesce(F.regexp_replace(raw, r"^[^_]*_", ""), F.lit(""))


def month_start(year: Column, month: Column) -> Column:
    """The first day of a month, null where year or month is out of range."""
    ok = month.between(1, 12) & year.between(1, 9999)
    return F.when(ok, F.make_date(year, month, F.lit(1)))


def to_month(value: Column) -> Column:
    """A date, timestamp or text as a date, null where it can't be read."""
    return F.to_date(F.try_to_timestamp(value.cast("string")))


def is_month_start(date: Column) -> Column:
    return F.dayofmonth(date) == 1


def numeric(value: Column) -> Column:
    """Text or number to double; null where it can't be read."""
    return value.try_cast("double")


def safe_numeric(value: Column) -> Column:
    """As numeric; NaN and infinities are null too."""
    x = numeric(value)
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def integer_count(value: Column) -> Column:
    """A lagged count back to a nullable long, halves to even."""
    return F.bround(safe_numeric(value)).cast("long")


def season(month: Column) -> tuple[Column, Column]:
    """(sin, cos) of the month's place in the year."""
    angle = F.lit(2) * F.pi() * (month - 1) / F.lit(12)
    return F.sin(angle), F.cos(angle)


def clip_share(p: Column) -> Column:
    """p within 0 and 1; null stays null."""
    return F.when(p.isNotNull(), F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)))


def design_weight(p: Column) -> Column:
    """1 / clipped p where that is positive, else null."""
    c = clip_share(p)
    return F.when(c > 0, F.lit(1.0) / F.nullif(c, F.lit(0.0)))


def mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Web Mercator metres; latitudes are clipped to the projection's square."""
    phi = F.radians(F.least(F.greatest(lat, F.lit(-MAX_LATITUDE)), F.lit(MAX_LATITUDE)))
    return F.lit(EARTH_RADIUS) * F.radians(lon), F.lit(EARTH_RADIUS) * F.ln(F.tan(F.pi() / 4 + phi / 2))


def grid_index(metres: Column, size_km: float) -> Column:
    return F.floor(metres / F.lit(size_km * 1000.0)).cast("long")


def coarser(index: Column, factor: int) -> Column:
    """The index on a grid factor times as wide, downwards for negative ones too."""
    return F.floor(index / F.lit(float(factor))).cast("long")


def grid_name(ix: Column, iy: Column) -> Column:
    return F.when(ix.isNotNull() & iy.isNotNull(), F.concat_ws("_", ix.cast("string"), iy.cast("string")))


def is_close(a: Column, b: Column, rtol: float = 1e-6, atol: float = 1e-8) -> Column:
    return F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)


def scale_of(protocol: Column) -> Column:
    """The kilometres in names like p3_50km, null without them."""
    return F.nullif(F.regexp_extract(protocol, r"p3_(\d+)km", 1), F.lit("")).cast("int")


def mapped(value: Column, names: dict) -> Column:
    """value by a small constant map, itself where the map lacks it."""
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), value), value) if names else value


def year_month_index(date: Column) -> Column:
    return F.year(date) * 12 + F.month(date)


def order_key(seed: int, *columns: Column) -> Column:
    """A reproducible pseudo-random order of keys."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(c.cast("string") for c in columns)))
