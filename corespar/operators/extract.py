"""Entities and measurements by configurable pattern sets; every operator is a column over a text column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The domain's pattern set, (pattern, group) in the order of priority. Texts are searched regardless of case, file names
# and questions with the case as written.
PATTERNS: dict[str, list[tuple[str, int]]] = {
    "wells": [
        (r"\b[A-Z]{2,4}[-_][A-Z]{1,3}[-_]\d{1,3}[A-Z]?\b", 0),
        (r"\b[A-Z][a-z]+[-_][A-Z]{2,4}[-_]\d{1,3}\b", 0),
        (r"\bWell\s+[A-Z\-\d]{3,}\b", 0),
        (r"\b[A-Z]{2,}\s*\d{1,3}[A-Z]?\b", 0),
    ],
    "formations": [
        (r"\b(Slochteren|Rotliegend|Zechstein|Buntsandstein|Ten Boer|Muschelkalk)\b", 1),
        (r"\b([A-Z][a-z]+)\s+Formation\b", 1),
        (r"\b([A-Z][a-z]+)\s+Sandstone\b", 1),
        (r"\b([A-Z][a-z]+)\s+Group\b", 1),
        (r"\b(Permian|Triassic|Carboniferous|Jurassic)\b", 1),
    ],
    "depth": [
        (r"\d+(?:\.\d+)?\s*(?:m|meters?)\s+(?:TVDSS|MD|TVD|MSL)", 0),
        (r"(?:depth|Depth):\s*\d+(?:\.\d+)?\s*(?:m|meters?)", 0),
        (r"\d+\s*[-–]\s*\d+\s*(?:m|meters?)", 0),
        (r"(?:from|From)\s+\d+(?:\.\d+)?\s*(?:m|meters?)", 0),
    ],
    "temperature": [
        (r"\d+(?:\.\d+)?°C", 0),
        (r"\d+(?:\.\d+)?\s*(?:degrees?\s*)?C(?:elsius)?", 0),
        (r"(?:temp|temperature|Temp|Temperature):\s*\d+(?:\.\d+)?", 0),
    ],
    "pressure": [
        (r"\d+(?:\.\d+)?\s*bar(?:a)?", 0),
        (r"\d+(?:\.\d+)?\s*(?:kPa|MPa|psi)", 0),
        (r"(?:pressure|Pressure):\s*\d+(?:\.\d+)?", 0),
    ],
    "test_types": [
        (r"\b(PVT|DST|PLT|RFT|MDT)\b", 1),
        (r"\b(Production|Injection)\s+Test\b", 1),
        (r"\b(Well|Drill|Formation)\s+Test\b", 1),
        (r"\b(Pressure|Temperature)\s+Survey\b", 1),
        (r"\b(Logging|Coring)\s+Operation\b", 1),
    ],
}
# Our own stricter set: a unit must stand alone and a label may have a colon or not, so "2 cores" is no temperature.
STRICT: dict[str, list[tuple[str, int]]] = {
    "depth": [(r"\b\d+(?:\.\d+)?\s*m(?:eters?|etres?)?\b", 0)],
    "temperature": [(r"\b\d+(?:\.\d+)?\s*(?:°\s*|degrees?\s+)C(?:elsius)?\b", 0), (r"\btemp(?:erature)?:?\s+\d+(?:\.\d+)?", 0)],
    "pressure": [(r"\b\d+(?:\.\d+)?\s*(?:bara?|kPa|MPa|psi)\b", 0)],
}
# Document types of file names, in the order of priority.
FILE_TYPES = [
    ("PVT", r"pvt|pressure.*volume.*temperature"),
    ("Litholog", r"litho|log"),
    ("Well Report", r"well.*report|report.*well"),
    ("Test Report", r"test.*report|dsr|dst"),
    ("Geological", r"geo"),
]
NOT_WELLS = ("TABLE", "FIGURE", "PAGE", "CHAPTER")
MOST = 10


def hits(text: Column, patterns: list[tuple[str, int]], ignore_case: bool = True) -> Column:
    """All hits, pattern by pattern in the order of the set, then by their place in the text."""
    flag = "(?i)" if ignore_case else ""
    return F.concat(*[F.regexp_extract_all(text, F.lit(flag + p), g) for p, g in patterns])


def clean_entities(found: Column, wells: bool = False, most: int = MOST) -> Column:
    """Trimmed, distinct in the order of first occurrence, at most `most`; wells must have a letter and a digit."""
    kept = F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: x != "")
    if wells:
        kept = F.filter(kept, lambda x: x.rlike("[A-Za-z]") & x.rlike("[0-9]") & ~F.upper(x).isin(*NOT_WELLS))
    return F.slice(F.array_distinct(kept), 1, most)


def summary(found: Column, most: int = MOST) -> Column:
    """min, max and the first values of the first number in each hit; null if there is none."""
    values = F.filter(F.transform(found, lambda h: F.regexp_extract(h, r"\d+(?:\.\d+)?", 0).try_cast("double")), lambda v: v.isNotNull())
    return F.when(F.size(values) > 0, F.struct(F.array_min(values).alias("min"), F.array_max(values).alias("max"), F.slice(values, 1, most).alias("all_values")))


def file_type(name: Column) -> Column:
    """The first type whose pattern the file name has, regardless of case; null without one."""
    return reduce(lambda rest, t: F.when(F.lower(name).rlike(t[1]), t[0]).otherwise(rest), reversed(FILE_TYPES), F.lit(None).cast("string"))


def file_well(name: Column) -> Column:
    """The first hit of the first well pattern that has one in the file name, case-sensitive; null without one."""
    return F.coalesce(*[F.nullif(F.regexp_extract(name, p, 0), F.lit("")) for p, _ in PATTERNS["wells"]])


def primary_well(wells: Column, name: Column) -> Column:
    """The first well that stands in the file name regardless of case, else the first; null without wells."""
    inside = F.filter(wells, lambda w: F.contains(F.lower(name), F.lower(w)))
    return F.coalesce(F.try_element_at(inside, F.lit(1)), F.try_element_at(wells, F.lit(1)))


def merge_lists(*lists: Column, most: int = MOST) -> Column:
    """Ordered union, at most `most`."""
    return F.slice(F.array_distinct(F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in lists])), 1, most)


def mentioned(text: Column, wells: Column) -> Column:
    """Those of the wells that the text mentions, with any of hyphen, space, underscore or nothing for a hyphen."""
    quoted = lambda w: F.concat(F.lit("(?i)"), F.regexp_replace(F.regexp_replace(w, r"([\\.^$|?*+()\[\]{}])", r"\\$1"), "-", r"[-\\s_]?"))
    return F.filter(wells, lambda w: F.regexp_like(text, quoted(w)))
