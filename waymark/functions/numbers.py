"""Prices, distances, counts, delays and coordinates from text and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import Text, _c, clean, once

EARTH_KM = 6371.0


def normalize_price(x: Text) -> Column:
    """A price's number: the last of comma and dot is the decimal mark if both occur, or if 1 or 2 digits follow it."""
    token = F.regexp_extract(_c(x).cast("string"), r"(\d[\d.,]*)", 1)

    def number(t: Column) -> Column:
        comma, dot = F.instr(F.reverse(t), ","), F.instr(F.reverse(t), ".")
        whole = F.translate(t, ".,", "")
        # the later mark is the nearer one from behind; 0 if there is none
        return once(F.struct(comma.alias("comma"), dot.alias("dot"), whole.alias("whole")), pointed)

    def pointed(v: Column) -> Column:
        both = (v["comma"] > 0) & (v["dot"] > 0)
        digits = F.when(both, F.least(v["comma"], v["dot"])).otherwise(F.greatest(v["comma"], v["dot"])) - 1
        point = F.length(v["whole"]) - digits
        return F.when(both | digits.between(1, 2), F.concat(F.substring(v["whole"], F.lit(1), point), F.lit("."), F.substring(v["whole"], point + 1, F.length(v["whole"])))).otherwise(v["whole"])

    return once(token, lambda t: F.when(t != "", number(t).try_cast("double")))


def normalize_distance(x: Text) -> Column:
    """The first number in a text, as kilometres; a comma is a decimal mark."""
    text = F.regexp_replace(F.lower(clean(x)), "^([^,]*),", "$1.")
    return F.nullif(F.regexp_extract(text, r"(\d+(?:\.\d+)?)\s*(?:km|k)?\b", 1), F.lit("")).try_cast("double")


def strict_distance(x: Text) -> Column:
    """A number with km or k behind it, and no letter behind that."""
    found = F.regexp_extract(_c(x), r"(?i)(?<!\d)(\d+(?:[.,]\d+)?)\s*(?:km|k)(?![a-z])", 1)
    return F.nullif(F.replace(found, F.lit(","), F.lit(".")), F.lit("")).try_cast("double")


def first_integer(x: Text) -> Column:
    """The first whole number; dots group thousands."""
    return F.nullif(F.regexp_extract(F.replace(clean(x), F.lit("."), F.lit("")), r"\d+", 0), F.lit("")).try_cast("bigint")


def position(x: Text) -> Column:
    """A positive whole number, else null."""
    n = first_integer(x)
    return F.when(n > 0, n)


def whole_number(x: Text) -> Column:
    """A number without a fraction (52.0 counts), not below 0; else null."""
    n = clean(x).try_cast("double")
    return F.when(clean(x).rlike(r"^\d+(\.0+)?$") & (n >= 0), n.cast("bigint"))


def positive_or(x: Text, fallback: int) -> Column:
    n = _c(x).try_cast("bigint")
    return F.when(n > 0, n).otherwise(fallback)


def clamp(x: Text, low: float, high: float) -> Column:
    return F.least(F.greatest(_c(x), F.lit(low)), F.lit(high))


def retry_delay(attempt: Text, base: int = 30, most: int = 1800) -> Column:
    """Seconds until the next try: doubling, bounded."""
    return F.least(F.lit(most), base * F.pow(F.lit(2.0), _c(attempt))).cast("int")


def idle_delay(polls: Text, base: int = 1000, most: int = 15000) -> Column:
    return F.least(F.lit(most), base * F.pow(F.lit(2.0), F.least(F.lit(4), _c(polls)))).cast("int")


def coverage(part: Text, total: Text) -> Column:
    """Percent to one decimal; 0 of nothing."""
    return F.when(_c(total) == 0, 0.0).otherwise(F.round(100.0 * _c(part) / F.nullif(_c(total), F.lit(0)), 1))


def haversine_km(lat1: Text, lng1: Text, lat2: Text, lng2: Text) -> Column:
    a1, o1, a2, o2 = (F.radians(_c(x)) for x in (lat1, lng1, lat2, lng2))
    h = F.pow(F.sin((a2 - a1) / 2), 2) + F.cos(a1) * F.cos(a2) * F.pow(F.sin((o2 - o1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def growth_estimate(record: Column, fixed: int = 65_536, factor: int = 8) -> Column:
    """Bytes that storing a record may add."""
    return F.lit(fixed) + factor * F.octet_length(F.to_json(record))
