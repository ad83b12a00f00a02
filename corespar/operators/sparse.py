"""Scoring of sparse questions against all rows, in blocks of rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 20_000

Weigh = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def keep_weights(doc: np.ndarray, key: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return doc, key, x


def _score(k: int | None, least: float | None, weigh: Weigh, final: Callable[[np.ndarray], np.ndarray]):
    def run(questions: pa.Table, rows: pa.Table) -> pa.Table:
        q_out, d_out, s_out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if len(questions) and len(rows):
            doc, key, w = weigh(rows.column("doc_id").to_numpy(), rows.column("key").to_numpy(), rows.column("x").to_numpy())
            order = np.argsort(key, kind="stable")
            ids, doc = np.unique(doc[order], return_inverse=True)
            key, w = key[order], w[order]
            q_id, q_key, q_w = (questions.column(c).to_numpy() for c in ("query_id", "key", "qw"))
            q_order = np.argsort(q_id, kind="stable")
            q_id, q_key, q_w = q_id[q_order], q_key[q_order], q_w[q_order]
            from_, to = np.searchsorted(key, q_key, "left"), np.searchsorted(key, q_key, "right")
            starts = np.flatnonzero(np.r_[True, q_id[1:] != q_id[:-1]])
            for a, b in zip(starts, np.r_[starts[1:], len(q_id)]):
                total, touched = np.zeros(len(ids)), np.zeros(len(ids), bool)
                for t in range(a, b):
                    part = slice(from_[t], to[t])
                    total[doc[part]] += q_w[t] * w[part]  # a document has a key once
                    touched[doc[part]] = True
                hit = np.flatnonzero(touched)
                score = np.round(final(total[hit]), 6)
                if least is not None:
                    hit, score = hit[score > least], score[score > least]
                if k is not None and len(hit) > k:
                    near = score >= np.partition(score, -k)[-k]
                    hit, score = hit[near], score[near]
                best = np.argsort(-score, kind="stable")[: k or len(score)]  # ids ascend, so ties keep the smaller id
                q_out.append(np.full(len(best), q_id[a]))
                d_out.append(ids[hit[best]])
                s_out.append(score[best])
        return pa.table({"query_id": np.concatenate(q_out).astype(np.int64), "doc_id": np.concatenate(d_out).astype(np.int64), "score": np.concatenate(s_out)})

    return run


def sparse_topk(asked: DataFrame, rows: DataFrame, n_docs: int, k: int | None, weigh: Weigh = keep_weights, final: Callable[[np.ndarray], np.ndarray] = lambda s: s, least: float | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank): for each question the k documents with the largest sum of weight products over shared keys.

    asked: (query_id, key, qw), a key once per question; rows: (doc_id, key, x), which `weigh` turns into one weight for each
    document and key. Documents are cut into blocks by a hash of their id; each block meets all questions and gives out k hits of
    each at most, so what is shuffled is the rows once and the questions once per block, never a score for every pair. A key
    that most documents have is spread over all blocks. With `least` only larger scores count; with k None all of them, unranked. Scores are rounded to six places, ties go to the smaller id.
    """
    blocks = max(rows.sparkSession.sparkContext.defaultParallelism, n_docs // BLOCK_ROWS)
    left = asked.select(F.col("query_id").cast("long"), F.col("key").cast("long"), F.col("qw").cast("double")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).groupBy("block")
    right = rows.select(F.col("doc_id").cast("long"), F.col("key").cast("long"), F.col("x").cast("double")).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int")).groupBy("block")
    found = left.cogroup(right).applyInArrow(_score(k, least, weigh, final), "query_id bigint, doc_id bigint, score double")
    if k is None:
        return found
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))).where(F.col("rank") <= k)


SCAN_QUESTIONS = 8_192  # so many questions are sent to every task at most
SCANNED = "query_id bigint, part int, doc_id bigint, score double"


def _scan(ids: np.ndarray, asked: np.ndarray, k: int | None, least: float | None, final: Callable[[np.ndarray], np.ndarray]):
    """Scores of rows (doc_id, part, dims, weights) with dense questions (dims, questions), the k best of each part."""

    def best(found: list[tuple[np.ndarray, ...]]) -> list[tuple[np.ndarray, ...]]:
        q, part, doc, score = (np.concatenate(z) for z in zip(*found))
        order = np.lexsort((doc, -score, part, q))
        key = (q[order] << 32) + part[order]
        keep = order[np.arange(len(key)) - np.searchsorted(key, key) < k] if k is not None else order
        return [(q[keep], part[keep], doc[keep], score[keep])]

    def run(batches):
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for batch in batches:
            doc, part = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            offsets = batch.column(2).offsets.to_numpy()
            dims, weights = batch.column(2).values.to_numpy(), batch.column(3).values.to_numpy()
            for a in range(0, len(doc), 256):
                b = min(a + 256, len(doc))
                x = np.zeros((b - a, asked.shape[0]))
                inside = slice(offsets[a], offsets[b])
                x[np.repeat(np.arange(b - a), np.diff(offsets[a : b + 1])), dims[inside]] = weights[inside]
                product = x @ asked  # weights aren't negative: 0 is no common dimension
                r, q = np.nonzero(product > 0)
                score = np.round(final(product[r, q]), 6)
                if least is not None:
                    r, q, score = r[score > least], q[score > least], score[score > least]
                elif k is not None and b - a > 2 * k:  # what k others of the block exceed is left out, if they are of one part
                    floor = np.full(asked.shape[1], -np.inf)
                    if (part[a:b] == part[a]).all():
                        floor = np.round(final(np.partition(product, -k, axis=0)[-k]), 6)
                    near = score >= floor[q]
                    r, q, score = r[near], q[near], score[near]
                found.append((q.astype(np.int64), part[a + r].astype(np.int64), doc[a + r], score))
            if k is not None and sum(len(f[0]) for f in found) > 200_000:
                found = best(found)
        q, part, doc, score = best(found)[0]
        yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(part.astype(np.int32)), pa.array(doc), pa.array(score)], names=["query_id", "part", "doc_id", "score"])

    return run


def as_arrays(rows: DataFrame, *kept: str) -> DataFrame:
    """(doc_id, *kept, dims, weights): a sparse vector (doc_id, dim, weight) as one row."""
    one = rows.groupBy("doc_id", *kept).agg(F.array_sort(F.collect_list(F.struct("dim", "weight"))).alias("v"))
    return one.select("doc_id", *kept, F.col("v.dim").alias("dims"), F.col("v.weight").alias("weights"))


def scan_topk(asked: DataFrame, rows: DataFrame, dims: int, k: int | None, final: Callable[[np.ndarray], np.ndarray] = lambda s: s, least: float | None = None) -> DataFrame | None:
    """(query_id, part, doc_id, score): the k best rows of each part for each question, found where the rows are read.

    asked: (query_id, dims, weights); rows: (doc_id, part, dims, weights), not negative. Only the best of each task are shuffled. With
    `least` and k None all rows with a larger score. None where there are more than SCAN_QUESTIONS questions.
    """
    few = asked.select(F.col("query_id").cast("long"), "dims", "weights").limit(SCAN_QUESTIONS + 1).toArrow().combine_chunks()
    if len(few) > SCAN_QUESTIONS:
        return None
    dense = np.zeros((dims, len(few)))
    for i, (at, w) in enumerate(zip(few.column("dims").to_pylist(), few.column("weights").to_pylist())):
        dense[at, i] = w
    found = rows.select(F.col("doc_id").cast("long"), F.col("part").cast("int"), "dims", "weights").mapInArrow(_scan(few.column("query_id").to_numpy(), dense, k, least, final), SCANNED)
    if k is None:
        return found
    line = Window.partitionBy("query_id", "part").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("n", F.row_number().over(line)).where(F.col("n") <= k).drop("n")
