"""The stored index: what searches need of a collection, written once and read by every batch of questions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corespar.functions.text import tokens
from corespar.operators.bm25 import EPSILON, K1, B, padded
from corespar.operators.dense import hashed_terms
from corespar.operators.metadata import metadata_index
from corespar.operators.sparse import as_arrays, scan_topk, sparse_topk
from corespar.sources.store import load, save
from corespar.tables import spread

TERM_PARTS = 64  # folders of the postings, by a hash of the term: a batch reads those of its terms
BLOCK_DOCS = 1_000_000
DIMS = 384
TABLES = {
    "chunks": None,
    "postings": "term string, doc_id bigint, tf bigint, n_words int, term_part int",
    "terms": "term string, df bigint, idf double",
    "statistics": "n_docs bigint, n_tokens bigint, avgdl double",
    "vectors": "doc_id bigint, dims array<int>, weights array<double>",
    "metadata": "field string, value string, doc_id bigint",
}


def term_part(term):
    return F.pmod(F.xxhash64(term), F.lit(TERM_PARTS)).cast("int")


@dataclass
class Index:
    """The tables of a stored index, as frames over its folder."""

    chunks: DataFrame
    postings: DataFrame  # term, doc_id, tf, n_words; in folders by term_part
    terms: DataFrame  # term, df, idf
    statistics: DataFrame  # one row: n_docs, n_tokens, avgdl
    vectors: DataFrame  # doc_id, dims, weights: one row for each text
    metadata: DataFrame  # field, value, doc_id

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> Index:
        return cls(**load(spark, folder, TABLES))

    def bm25_topk(self, questions: DataFrame, k: int = 10, pad: bool = True) -> DataFrame:
        """As bm25.bm25_topk, from postings: only the folders of the questions' terms are read, and no text."""
        asked = questions.select("query_id", F.explode(tokens(F.col("question"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
        parts = [r[0] for r in asked.select(term_part(F.col("term"))).distinct().collect()]  # at most TERM_PARTS
        stats = self.statistics.first()
        if stats is None or not stats["n_docs"]:
            return self._none()
        weighted = asked.join(self.terms, "term").select("query_id", F.xxhash64("term").alias("key"), (F.col("qtf") * F.col("idf")).alias("qw"))
        found = self.postings.where(F.col("term_part").isin(parts)).join(asked.select("term").distinct(), "term", "left_semi")
        length = 1 - B + B * F.col("n_words") / F.lit(stats["avgdl"])
        rows = found.select("doc_id", F.xxhash64("term").alias("key"), (F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * length)).alias("x"))
        top = sparse_topk(weighted, rows, stats["n_docs"], k)
        return padded(questions, self.chunks.where("text is not null").select("doc_id"), top, k) if pad else top

    def text_topk(self, questions: DataFrame, k: int = 10) -> DataFrame:
        """As dense.text_topk, from stored vectors."""
        asked = as_arrays(hashed_terms(questions.select(F.col("query_id").alias("doc_id"), F.col("question").alias("text")), DIMS)).withColumnRenamed("doc_id", "query_id")
        found = self._near(asked, k, None, lambda c: 1 / (3 - 2 * c))
        return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))).where(F.col("rank") <= k)

    def _near(self, asked: DataFrame, k: int | None, least: float | None, final) -> DataFrame:
        """(query_id, doc_id, score) for questions (query_id, dims, weights): a scan, or blocks of rows where there are many questions."""
        found = scan_topk(asked, self.vectors.withColumn("part", F.lit(0)), DIMS, k, final, least)
        if found is None:
            pairs = lambda df, *names: df.select(df.columns[0], F.explode(F.arrays_zip("dims", "weights")).alias("p")).select(df.columns[0], "p.dims", "p.weights").toDF(*names)
            n = self.statistics.first()
            found = sparse_topk(pairs(asked, "query_id", "key", "qw"), pairs(self.vectors, "doc_id", "key", "x"), n["n_docs"] if n else 0, k, final=final, least=least)
        return found.select("query_id", "doc_id", "score")

    def similar_to(self, seeds: DataFrame, least: float = 0.7) -> DataFrame:
        """(query_id, doc_id): the seeds' neighbours in the similarity graph, whose edges are cosines above `least`, found without building it.

        Every stored vector is scored once with all different seeds; only the neighbours are shuffled.
        """
        asked = self.vectors.join(seeds.select("doc_id").distinct(), "doc_id", "left_semi").withColumnRenamed("doc_id", "query_id").select("query_id", "dims", "weights")
        near = self._near(asked, None, least, lambda c: c).where("query_id != doc_id").select(F.col("query_id").alias("seed"), F.col("doc_id").alias("near"))
        return seeds.select("query_id", F.col("doc_id").alias("seed")).join(near, "seed").select("query_id", F.col("near").alias("doc_id")).distinct()

    def _none(self) -> DataFrame:
        return self.chunks.sparkSession.createDataFrame([], "query_id bigint, doc_id bigint, score double, rank int")


def build_index(chunks: DataFrame, folder: str, scalars: list[str], lists: list[str], structs: list[str] | None = None) -> None:
    """Write the tables of an Index from chunks (doc_id, text, ...); each text is read and cut into words once.

    doc_id is a unique BIGINT. Null texts are kept among the chunks and have no postings or vector; an empty table gives an index
    in which nothing is found.
    """
    spark = chunks.sparkSession
    save({"chunks": chunks.withColumn("doc_id", F.col("doc_id").cast("long"))}, folder)
    stored = spark.read.parquet(f"{folder}/chunks")
    words = stored.where("text is not null").select("doc_id", tokens(F.col("text")).alias("words"))
    each = spread(words).select("doc_id", F.size("words").alias("n_words"), F.explode("words").alias("term"))
    blocks = stored.count() // BLOCK_DOCS + 1  # one shuffle for counting and for the folders; a term that every text has is in all blocks
    parted = each.withColumns({"term_part": term_part(F.col("term")), "block": F.pmod(F.xxhash64("doc_id"), F.lit(blocks))}).repartition("term_part", "block")
    save({"postings": parted.groupBy("term_part", "block", "term", "doc_id", "n_words").agg(F.count("*").alias("tf")).select("term", "doc_id", "tf", "n_words", "term_part")}, folder, {"postings": "term_part"})
    stats = words.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum(F.size("words")), F.lit(0)).alias("n_tokens"))
    save({"statistics": stats.withColumn("avgdl", F.when(F.col("n_docs") > 0, F.col("n_tokens") / F.col("n_docs")).otherwise(0.0))}, folder)
    n = spark.read.parquet(f"{folder}/statistics").first()["n_docs"]
    postings = load(spark, folder, {"postings": TABLES["postings"]})["postings"]
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    save({"frequencies": df.select("term", "df", (F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))}, folder)
    raw = spark.read.parquet(f"{folder}/frequencies")
    mean = raw.agg(F.coalesce(F.avg("raw"), F.lit(0.0))).first()[0]
    terms = raw.select("term", "df", F.when(F.col("raw") < 0, EPSILON * mean).otherwise(F.col("raw")).alias("idf"))
    save({"terms": terms, "vectors": as_arrays(hashed_terms(postings.select("doc_id", "term", "tf"), DIMS, counted=True)), "metadata": metadata_index(stored, "doc_id", scalars, lists, structs)}, folder)
