"""Okapi BM25 over postings tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corespar.functions.text import tokens
from corespar.operators.sparse import sparse_topk
from corespar.session import cut

K1, B, EPSILON = 1.5, 0.75, 0.25


def term_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, term, tf). A null or blank text has no rows; rows sharing an id are counted together."""
    each = docs.select(F.col(id_col).alias("doc_id"), F.explode(tokens(F.col(text_col))).alias("term"))
    return each.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def corpus_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row: n_docs (null texts left out), n_tokens, avgdl."""
    return docs.where(F.col(text_col).isNotNull()).agg(F.count("*").alias("n_docs"), F.coalesce(F.sum(F.size(tokens(F.col(text_col)))), F.lit(0)).alias("n_tokens")).withColumn("avgdl", F.when(F.col("n_docs") > 0, F.col("n_tokens") / F.col("n_docs")).otherwise(0.0))


def idf_table(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, df, idf): ln(N - df + .5) - ln(df + .5); a negative value becomes EPSILON times the mean over all terms.

    The document frequencies are counted once and kept; only their number and mean (one row) come to the driver.
    """
    texts = docs.where(F.col(text_col).isNotNull())
    n = texts.count()
    df = cut(texts.select(F.explode(F.array_distinct(tokens(F.col(text_col)))).alias("term")).groupBy("term").agg(F.count("*").alias("df")))
    raw = df.select("term", "df", (F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg(F.coalesce(F.avg("raw"), F.lit(0.0)).alias("mean")).first()["mean"]
    return raw.select("term", "df", F.when(F.col("raw") < 0, EPSILON * mean).otherwise(F.col("raw")).alias("idf"))


def _weigh(avgdl: float):
    """Occurrences (document, term, length of the document) to one BM25 weight, without idf, for each document and term."""

    def run(doc: np.ndarray, key: np.ndarray, length: np.ndarray):
        order = np.lexsort((key, doc))
        doc, key, length = doc[order], key[order], length[order]
        first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])])
        tf = np.diff(np.r_[first, len(doc)])
        return doc[first], key[first], tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[first] / avgdl))

    return run


def bm25_topk(questions: DataFrame, docs: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", pad: bool = True) -> DataFrame:
    """(query_id, doc_id, score, rank): the k best documents of each question (query_id, question).

    A token that stands twice in a question counts twice. Equal scores (rounded to six places) are ranked by the smaller id. With
    `pad` a question with fewer than k hits is filled with the smallest ids at score 0, as an exhaustive scorer would. Only
    occurrences of the questions' terms are shuffled, once, to blocks of documents. Null questions and texts have no hits; empty
    tables give no rows. Rows sharing an id count as one document of the length of one of them.
    """
    texts = docs.where(F.col(text_col).isNotNull())
    stats = corpus_stats(docs, text_col).first()
    asked = questions.select("query_id", F.explode(tokens(F.col("question"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    terms = asked.select("term").distinct()
    weighted = asked.join(idf_table(docs, text_col), "term").select("query_id", F.xxhash64("term").alias("key"), (F.col("qtf") * F.col("idf")).alias("qw"))
    words = texts.select(F.col(id_col).alias("doc_id"), tokens(F.col(text_col)).alias("words"))
    occurrences = words.select("doc_id", F.size("words").alias("x"), F.explode("words").alias("term")).join(terms, "term", "left_semi").select("doc_id", F.xxhash64("term").alias("key"), "x")
    top = sparse_topk(weighted, occurrences, stats["n_docs"], k, _weigh(stats["avgdl"]))
    return padded(questions, texts.select(F.col(id_col).alias("doc_id")), top, k) if pad else top


def padded(questions: DataFrame, docs: DataFrame, top: DataFrame, k: int) -> DataFrame:
    """The ranking with questions of fewer than k hits filled up with the smallest ids at score 0."""
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    top = cut(top)
    short = questions.select("query_id").join(top.groupBy("query_id").agg(F.count("*").alias("hits")), "query_id", "left").where(F.coalesce("hits", F.lit(0)) < k).select("query_id")
    first = docs.select("doc_id").orderBy("doc_id").limit(2 * k)  # a bounded table: among these at least k aren't hits
    filled = short.crossJoin(F.broadcast(first)).join(top.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti").withColumn("score", F.lit(0.0))
    return top.select("query_id", "doc_id", "score").unionByName(filled).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
