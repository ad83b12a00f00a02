"""From ranked chunks to an answer: context budget, sources, confidence, grounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET, SOURCES, SNIPPET = 3000, 5, 150
# What a stated confidence, a refusal, a value and a well of an answer look like.
CONFIDENCE = (r"confidence[:\s]+(\d+)%", r"(\d+)%\s*confident", r"confidence[:\s]+(\d+)/100")
REFUSALS = r"don't have|not contain"
VALUE = r"\d+(?:\.\d+)?\s*[a-z°]+"
ANSWER_WELL = r"\b[A-Z]{2,4}[-_][A-Z]{1,3}[-_]\d{1,3}\b"


def header(rank: Column, source: Column, page: Column, well: Column) -> Column:
    return F.concat(F.lit("\n[Source "), rank.cast("string"), F.lit(": "), F.coalesce(source, F.lit("Unknown")), F.coalesce(F.concat(F.lit(", Page "), page.cast("string")), F.lit("")), F.coalesce(F.concat(F.lit(", Well "), well), F.lit("")), F.lit("]\n"))


def pack_context(ranked: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Rows (query_id, rank, text, source, page, primary_well) that fit the budget: a prefix, ended by the first that overflows.

    A first chunk that is too long gives no rows. Null texts count as empty.
    """
    piece = F.concat(header(F.col("rank"), F.col("source"), F.col("page"), F.col("primary_well")), F.coalesce("text", F.lit("")))
    sized = ranked.withColumn("piece", piece).withColumn("used", F.sum(F.length("piece")).over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)))
    return sized.where(F.col("used") <= budget)


def context_text(packed: DataFrame) -> DataFrame:
    """(query_id, context): the packed pieces joined in order; the budget bounds each group."""
    return packed.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "piece"))), lambda x: x["piece"]), "\n").alias("context"))


def sources(ranked: DataFrame, most: int = SOURCES) -> DataFrame:
    """(query_id, rank, document, page, well, snippet) of the first results."""
    return ranked.where(F.col("rank") <= most).select("query_id", "rank", F.col("source").alias("document"), "page", F.col("primary_well").alias("well"), F.concat(F.substring(F.coalesce("text", F.lit("")), 1, SNIPPET), F.lit("...")).alias("snippet"))


def confidence(answer: Column) -> Column:
    """A stated percentage over 100, at most 1; else 0.7 for long answers that don't refuse, 0.1 for refusals, 0.5."""
    stated = F.coalesce(*[F.nullif(F.regexp_extract(answer, "(?i)" + p, 1), F.lit("")) for p in CONFIDENCE])
    lower = F.lower(answer)
    refuses = F.contains(lower, F.lit("don't")) | F.contains(lower, F.lit("cannot"))
    return F.when(stated.isNotNull(), F.least(stated.cast("double") / 100, F.lit(1.0))).when((F.length(answer) > 100) & ~F.contains(lower, F.lit("don't")), 0.7).when(refuses, 0.1).otherwise(0.5)


def band(score: Column) -> Column:
    return F.when(score >= 0.7, "high").when(score >= 0.4, "medium").otherwise("low")


def value_ratio(answer: Column, context: Column) -> Column:
    """Share of the answer's different value tokens (a number with the letters after it) that the context contains; 1 without any."""
    values = F.array_distinct(F.regexp_extract_all(F.lower(answer), F.lit(VALUE), 0))
    found = F.filter(values, lambda v: F.contains(F.lower(context), v))
    return F.when(F.size(values) > 0, F.size(found) / F.size(values)).otherwise(1.0)


def grounded(answer: Column, context: Column) -> Column:
    """Refusals are grounded; else half of the values and all wells of the answer must be in the context."""
    wells = lambda t: F.array_distinct(F.regexp_extract_all(t, F.lit(ANSWER_WELL), 0))
    return F.lower(answer).rlike(REFUSALS) | ((value_ratio(answer, context) >= 0.5) & (F.size(F.array_except(wells(answer), wells(context))) == 0))


def extractive_answer(packed: DataFrame, questions: DataFrame) -> DataFrame:
    """(query_id, answer): the offline stand-in for a model: the packed sentence with the most words of the question, and a fixed confidence line."""
    from corespar.functions.text import sentences, tokens

    each = packed.select("query_id", "rank", F.posexplode(sentences(F.col("text"))).alias("pos", "sentence")).join(questions.select("query_id", "question"), "query_id")
    scored = each.withColumn("overlap", F.size(F.array_intersect(tokens(F.col("sentence")), tokens(F.col("question")))))
    best = scored.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("overlap"), "rank", "pos"))).where("n = 1")
    return best.select("query_id", F.concat("sentence", F.lit(". Confidence: 60%")).alias("answer"))
