"""Sentences to context-enriched chunks."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corespar.functions.text import bucket, sentences, tokens
from corespar.operators.extract import mentioned

CHUNK, OVERLAP, LEAST, PERCENTILE = 800, 100, 50, 0.3


def sentence_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, i, sentence), i from 0; null and blank texts have no rows."""
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(sentences(F.col(text_col))).alias("i", "sentence"))


def _sparse(sentence: Column, dims: int) -> Column:
    """Sorted distinct hashed terms of a sentence: the offline stand-in for its embedding, with equal weights."""
    return F.array_sort(F.array_distinct(F.transform(tokens(sentence), lambda t: bucket(t, dims))))


def adjacent_similarity(sents: DataFrame, dims: int = 384) -> DataFrame:
    """(doc_id, i, sim): cosine of each sentence's hashed terms and those of the next."""
    vector = sents.withColumn("v", _sparse(F.col("sentence"), dims))
    nxt = vector.withColumn("w", F.lead("v").over(Window.partitionBy("doc_id").orderBy("i"))).where("w is not null")
    size = F.sqrt(F.size("v").cast("double") * F.size("w"))
    return nxt.select("doc_id", "i", F.round(F.when(size > 0, F.size(F.array_intersect("v", "w")) / size).otherwise(0.0), 6).alias("sim"))


def breakpoints(sims: DataFrame, percentile: float = PERCENTILE) -> DataFrame:
    """(doc_id, i): sentences that start a segment: after a strict local minimum below the percentile, the first and last similarity excepted."""
    line = Window.partitionBy("doc_id").orderBy("i")
    cut_at = sims.groupBy("doc_id").agg(F.percentile("sim", F.lit(percentile)).alias("cut"))
    around = sims.withColumns({"before": F.lag("sim").over(line), "after": F.lead("sim").over(line)}).join(cut_at, "doc_id")
    return around.where("before is not null and after is not null and sim < before and sim < after and sim < cut").select("doc_id", (F.col("i") + 1).alias("i"))


def segments(sents: DataFrame, breaks: DataFrame) -> DataFrame:
    """(doc_id, i, sentence, segment): segments from 0, one more at each breakpoint."""
    marked = sents.join(breaks.withColumn("b", F.lit(1)), ["doc_id", "i"], "left")
    return marked.withColumn("segment", F.sum(F.coalesce("b", F.lit(0))).over(Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))).drop("b")


def pack(sents: list[str], most: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
    """Chunks of one segment: whole if it fits; else sentences are packed, with whole sentences up to `overlap` characters repeated.

    Joining spaces aren't counted. A sentence longer than a chunk is split at , ; : which stay as parts of their own, and ends the
    repetition.
    """
    if len(" ".join(sents)) <= most:
        return [" ".join(sents)] if sents else []
    out: list[str] = []
    current: list[str] = []

    def emit():
        out.append(" ".join(current))

    for s in sents:
        long = len(s) > most
        for part in ([p for p in re.split(r"([,;:])", s) if p] if long else [s]):
            if current and sum(map(len, current)) + len(part) > most:
                emit()
                kept: list[str] = []
                if not long:
                    for x in reversed(current):
                        if sum(map(len, kept)) + len(x) > overlap:
                            break
                        kept.insert(0, x)
                current[:] = kept
            current.append(part)
    if current:
        emit()
    return out


def _pack_rows(batches):
    for pdf in batches:
        rows = []
        for doc, segs in zip(pdf["doc_id"], pdf["segs"]):
            rows += [(doc, n, text) for n, text in enumerate(t for sents in segs for t in pack(list(sents)))]
        yield pd.DataFrame(rows, columns=["doc_id", "chunk_index", "text"])


def context(source: Column, kind: Column, page: Column, text: Column) -> Column:
    """Source, type, page and topic, null parts left out; the topic is the first two sentences of the first 500 characters, cut to 200."""
    topic = F.substring(F.array_join(F.slice(sentences(F.substring(text, 1, 500)), 1, 2), ". "), 1, 200)
    label = lambda name, c: F.concat(F.lit(name), c)
    return F.concat_ws(" | ", label("Source: ", source), label("Type: ", kind), label("Page: ", page.cast("string")), label("Topic: ", F.nullif(topic, F.lit(""))))


def enrich(chunk: Column, ctx: Column) -> Column:
    return F.concat(F.lit("[Context: "), ctx, F.lit("]\n\n"), chunk)


def chunk_documents(docs: DataFrame, enriched: bool = True) -> DataFrame:
    """(doc_id, chunk_index, text, source, doc_type, primary_well, chunk_wells): the chunks of documents as an index takes them.

    docs: (doc_id, text, source, doc_type, primary_well, all_wells). Each chunk but the single one of a short text (under LEAST
    characters) gets the document's context in front, and those of the document's wells that it mentions.
    """
    ctx = context(F.col("source"), F.col("doc_type"), F.lit(None).cast("int"), F.col("text"))
    facts = docs.select("doc_id", ctx.alias("ctx"), (F.length(F.trim("text")) < LEAST).alias("short"), "source", "doc_type", "primary_well", "all_wells")
    met = semantic_chunks(docs.select("doc_id", "text")).join(facts, "doc_id")
    text = F.when(F.col("short") | F.lit(not enriched), F.col("text")).otherwise(enrich(F.col("text"), F.col("ctx")))
    wells = F.when(~F.col("short"), mentioned(text, F.coalesce("all_wells", F.array().cast("array<string>"))))
    return met.select("doc_id", "chunk_index", text.alias("text"), "source", "doc_type", "primary_well", wells.alias("chunk_wells"))


def semantic_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, chunk_index, text): texts cut where adjacent sentences are least similar, then packed to size.

    A text under LEAST characters is one chunk as it is; null and blank texts have none. A document is the unit of work: its
    sentences meet in one row, never those of several documents.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")
    short = F.length(F.trim("text")) < LEAST
    sents = sentence_table(rows.where(~short))
    segged = segments(sents, breakpoints(adjacent_similarity(sents)))
    by_segment = segged.groupBy("doc_id", "segment").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "sentence"))), lambda x: x["sentence"]).alias("sents"))
    by_doc = by_segment.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("segment", "sents"))), lambda x: x["sents"]).alias("segs"))
    packed = by_doc.mapInPandas(_pack_rows, "doc_id bigint, chunk_index int, text string")
    return packed.unionByName(rows.where(short & (F.length(F.trim("text")) > 0)).select(F.col("doc_id").cast("long"), F.lit(0).alias("chunk_index"), "text"))
