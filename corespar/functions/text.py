"""Text columns: tokens, sentences, hashed term buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EDGE = r"^\s+|\s+$"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, EDGE, "")


def tokens(text: Column) -> Column:
    """Lower-case runs of anything but white space; no stemming, no stop words. Null stays null."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda x: x != "")


def sentences(text: Column) -> Column:
    """Pieces between runs of . ! ?, without white space around them; empty ones are dropped."""
    return F.filter(F.transform(F.split(text, r"[.!?]+"), strip), lambda x: x != "")


def bucket(term: Column, size: int) -> Column:
    """A stable bucket of a term: the first 32 bits of its md5 modulo the size."""
    return F.pmod(F.conv(F.substring(F.md5(term), 1, 8), 16, 10).cast("long"), F.lit(size)).cast("int")
