"""Questions to strategies: filters, category, strategy, explanation; all columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from corespar.operators.extract import PATTERNS, hits

# Formations in questions, regardless of case.
ROUTER_FORMATIONS = [(r"\b(Slochteren|Rotliegend|Zechstein|Buntsandstein)\b", 1), (r"\b([A-Z][a-z]+)\s+Formation\b", 1)]
# Words by which the offline default tells a question's category, in the order of priority.
CATEGORY_WORDS = [
    ("comparison", r"compare|versus| vs |difference between"),
    ("summary", r"summari|overview|all wells"),
    ("complex", r"highest|lowest| and at what |correlat|relationship"),
    ("exploratory", r"explain|describe|why|history|tell me"),
]
CATEGORIES = ("factual", "comparison", "summary", "complex", "exploratory")
EXPLANATIONS = {"raptor": "walks the summary tree", "graph": "expands similar chunks", "hybrid": "fuses vector and word search", "dense": "searches vectors"}


def first_match(text: Column, rules: list[tuple[str, str]], default: str | None) -> Column:
    return reduce(lambda rest, r: F.when(text.rlike(r[1]), r[0]).otherwise(rest), reversed(rules), F.lit(default).cast("string"))


def category(question: Column) -> Column:
    return first_match(F.lower(question), CATEGORY_WORDS, "factual")


def category_of_answer(response: Column) -> Column:
    """The first of the labels that a model's answer contains, else factual."""
    return first_match(F.lower(response), [(c, c) for c in CATEGORIES], "factual")


def question_wells(question: Column) -> Column:
    """Different wells in the order of patterns and places, with the case as written."""
    return F.array_distinct(hits(question, PATTERNS["wells"][:3], ignore_case=False))


def question_formations(question: Column) -> Column:
    return F.array_distinct(hits(question, ROUTER_FORMATIONS))


def depth_mentioned(question: Column) -> Column:
    return question.rlike(r"(?i)\d+\s*(?:m|meters?|ft|feet)")


def temperature_mentioned(question: Column) -> Column:
    return question.rlike(r"(?i)\d+\s*(?:°C|celsius|degrees?)")


def question_type(question: Column) -> Column:
    return first_match(F.lower(question), [("PVT", r"\bpvt\b"), ("Test Report", r"\btest\s+report\b"), ("Litholog", r"\blitholog\b")], None)


def strategy(kind: Column, wells: Column, formations: Column) -> Column:
    """summary: raptor; comparison: graph; complex: hybrid; with a well or formation: hybrid; exploratory: raptor; else dense."""
    named = (F.size(wells) > 0) | (F.size(formations) > 0)
    return F.when(kind == "summary", "raptor").when(kind == "comparison", "graph").when(kind == "complex", "hybrid").when(named, "hybrid").when(kind == "exploratory", "raptor").otherwise("dense")


def explanation(kind: Column, chosen: Column) -> Column:
    return F.concat(kind, F.lit(" question: "), reduce(lambda rest, e: F.when(chosen == e[0], e[1]).otherwise(rest), EXPLANATIONS.items(), F.lit("default search")))
