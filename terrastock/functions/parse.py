"""Parsing and unit functions of attributes as column expressions; what can't be read becomes null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrastock.functions.geo import FT_PER_M

# fixed values: metres in a unit of length
METERS = {"m": 1.0, "mm": 0.001, "cm": 0.01, "km": 1000.0, "inch": 0.0254, "ft": 0.3048, "mile": 1609.344}
# fixed values: road classes of the census, with the type, lanes and speed limit (miles an hour) they stand for
_MINOR = ("S1500", "S1630", "S1640", "S1710", "S1720", "S1730", "S1740", "S1750", "S1780", "S1810", "S1820", "S1830")
ROAD_TYPE = {"S1100": "primary", "S1200": "secondary", "S1400": "residential"} | dict.fromkeys(_MINOR, "unclassified")
LANES = {"S1100": 4, "S1200": 2, "S1400": 1} | dict.fromkeys(_MINOR, 1)
SPEED = {"S1100": 70, "S1200": 55, "S1400": 25} | {c: 25 if c < "S1740" else 10 for c in _MINOR}
LANE_CAPACITY = 1800
MPH = 1609.34 / 3600
# fixed values: representative years of the six era classes
ERA_YEARS = (1960, 1975, 1985, 1995, 2005, 2015)


def lookup(table: dict, key: Column) -> Column:
    """The value of a small fixed table; null for keys it lacks."""
    out = None
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out


def convert_units(value: Column, from_unit: Column, to_unit: str) -> Column:
    return value * lookup(METERS, from_unit) / METERS[to_unit] if to_unit in METERS else F.lit(None).cast("double")


def scaled_1dp(value: Column, factor: float = FT_PER_M) -> Column:
    return F.bround(value * factor, 1)


def clean_number(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9.]", "")


def parse_year(s: Column) -> Column:
    head = F.substring(clean_number(s), 1, 4)
    return F.when(F.length(head) == 4, head.try_cast("int"))


def parse_height_ft(s: Column) -> Column:
    return scaled_1dp(clean_number(s).try_cast("double"))


def structure_class(s: Column) -> Column:
    one = F.concat(s, F.lit("1"))
    return F.when(one == "M1", "RM1").otherwise(one)


def occupancy_class(s: Column) -> Column:
    return F.substring_index(s, "-", 1)


def file_size_bytes(s: Column) -> Column:
    unit = F.regexp_extract(s, "([A-Za-z]+)$", 1)
    number = F.regexp_extract(s, r"^([0-9.]+)", 1).try_cast("double")
    return number * F.when(unit == "GB", 1e9).when(unit == "MB", 1e6).when(unit == "KB", 1e3).otherwise(1.0)


def lanes_each(total: Column, roads: Column) -> Column:
    """Lanes of each of several roads that share a total; a half goes to the even number."""
    return F.bround(total.try_cast("int") / roads).cast("long")


def plural(count: Column, noun: str) -> Column:
    return F.concat(count.cast("string"), F.lit(f" {noun}"), F.when(count == 1, "").otherwise("s"))


def image_name(prefix: str, lat: Column, lon: Column, places: int = 8) -> Column:
    return F.format_string(f"{prefix}_%.{places}f_%.{places}f.png", lat, lon)


def url_safe_base64(s: Column) -> Column:
    """The bytes of base64 text in the alphabet for addresses, with its padding left out or not."""
    bare = F.translate(F.rtrim(F.replace(s, F.lit("="), F.lit(" "))), "-_", "+/")
    return F.try_to_binary(F.rpad(bare, (F.ceil(F.length(bare) / 4) * 4).cast("int"), F.lit("=")), F.lit("base64"))


def parse_multilinestring(s: Column) -> Column:
    """Lines of (lon, lat) of a WKT MultiLineString or LineString."""
    number = lambda pair, i: F.element_at(F.split(F.trim(pair), r"\s+"), i).try_cast("double")
    line = lambda part: F.transform(F.split(part, ","), lambda p: F.struct(number(p, 1).alias("lon"), number(p, 2).alias("lat")))
    return F.transform(F.regexp_extract_all(s, F.lit(r"\(([^()]+)\)"), F.lit(1)), line)


def soft_labels(year: Column, classes: tuple[int, ...] = ERA_YEARS, width: float = 10.0) -> Column:
    """Gaussian weights of each class by its distance from a year, adding up to 1."""
    raw = F.array(*(F.exp(-F.pow((year - c) / width, F.lit(2.0)) / 2) for c in classes))
    total = F.aggregate(raw, F.lit(0.0), lambda a, v: a + v)
    return F.transform(raw, lambda v: v / total)


def bridge_class(kind: Column, design: Column) -> Column:
    return kind.try_cast("int") * 100 + design.try_cast("int")


def place_query(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(s, "[ ,]", "+"), r"\++", "+")


def free_flow_seconds(length_m: Column, mph: Column) -> Column:
    return length_m / (mph * MPH)


def era_year(index: Column) -> Column:
    return F.get(F.array(*(F.lit(y) for y in ERA_YEARS)), index)


def rgb_class(r: Column, g: Column, b: Column) -> Column:
    return r + 256 * g + 65536 * b


def round_up(x: Column, p: int) -> Column:
    return F.ceil(x / p) * p


def cosine_rate(rate: float, t: Column, n: int) -> Column:
    from math import pi

    return F.lit(0.5 * rate) * (F.cos(pi * (t % n) / n) + 1)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def softmax(scores: Column) -> Column:
    """Shares of an array of scores, taken from the largest for precision."""
    raw = F.transform(scores, lambda v: F.exp(v - F.array_max(scores)))
    return F.transform(raw, lambda v: v / F.aggregate(raw, F.lit(0.0), lambda a, w: a + w))


def rgb_parts(code: Column) -> Column:
    """The inverse of ``rgb_class``."""
    return F.struct((code % 256).alias("r"), (F.floor(code / 256) % 256).alias("g"), F.floor(code / 65536).alias("b"))


def focal_loss(p: Column, positive: Column, alpha: float = 0.25, gamma: float = 2.0) -> Column:
    """Loss of a probability, by how far it is from the class it should give."""
    sure = F.least(F.greatest(p, F.lit(1e-4)), F.lit(1 - 1e-4))
    right = F.when(positive, sure).otherwise(1 - sure)
    return -F.when(positive, alpha).otherwise(1 - alpha) * F.pow(1 - right, F.lit(gamma)) * F.log(right)


# fixed values: names and codes of states
STATES = {
    "Alabama": "AL", "Alaska": "AK", "Arizona": "AZ", "Arkansas": "AR", "California": "CA", "Colorado": "CO", "Connecticut": "CT", "Delaware": "DE",
    "District of Columbia": "DC", "Florida": "FL", "Georgia": "GA", "Hawaii": "HI", "Idaho": "ID", "Illinois": "IL", "Indiana": "IN", "Iowa": "IA",
    "Kansas": "KS", "Kentucky": "KY", "Louisiana": "LA", "Maine": "ME", "Maryland": "MD", "Massachusetts": "MA", "Michigan": "MI", "Minnesota": "MN",
    "Mississippi": "MS", "Missouri": "MO", "Montana": "MT", "Nebraska": "NE", "Nevada": "NV", "New Hampshire": "NH", "New Jersey": "NJ", "New Mexico": "NM",
    "New York": "NY", "North Carolina": "NC", "North Dakota": "ND", "Ohio": "OH", "Oklahoma": "OK", "Oregon": "OR", "Pennsylvania": "PA", "Rhode Island": "RI",
    "South Carolina": "SC", "South Dakota": "SD", "Tennessee": "TN", "Texas": "TX", "Utah": "UT", "Vermont": "VT", "Virginia": "VA", "Washington": "WA",
    "West Virginia": "WV", "Wisconsin": "WI", "Wyoming": "WY",
}


def state_of_place(display_name: Column) -> Column:
    """The code of the state in a place's display name: the last part but one, or the one before it if that is a zip code."""
    part = lambda i: F.trim(F.try_element_at(F.split(display_name, ","), F.lit(i)))
    return F.coalesce(lookup(STATES, part(-2)), lookup(STATES, part(-3)))


def page_title(html: Column) -> Column:
    """The text of a page's title, blanks trimmed; empty without one."""
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def labelled_number(html: Column, label: str) -> Column:
    """The whole number in the table cell after the cell of a label."""
    return F.regexp_extract(html, rf"(?is)<t[dh][^>]*>\s*{label}\s*</t[dh]>\s*<td[^>]*>\s*([0-9]+)", 1).try_cast("int")


def labelled_text(html: Column, label: str) -> Column:
    """The text of the table cell after the cell of a label, without tags and blanks at its ends; empty without one."""
    cell = F.regexp_extract(html, rf"(?is)<t[dh][^>]*>\s*{label}\s*</t[dh]>\s*<td[^>]*>(.*?)</td>", 1)
    return F.trim(F.regexp_replace(cell, "<[^>]*>", ""))


def building_of_page(html: Column) -> Column:
    """(country, floors, height, year) of a page of key and value cells; numbers null where missing or not whole."""
    return F.struct(labelled_text(html, "Country").alias("country"), labelled_number(html, "Floors").alias("floors"), labelled_number(html, "Height").alias("height"), labelled_number(html, "Year").alias("year"))
