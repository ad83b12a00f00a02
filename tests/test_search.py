"""Search operators against brute force and on odd input."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest

from corespar.operators.bm25 import bm25_topk
from corespar.operators.dense import dense_topk
from corespar.operators.fusion import postfilter, rrf
from corespar.operators.graph import similarity_edges, traverse
from corespar.operators.metadata import metadata_index, search_metadata

DOCS = [(1, "the pump failed"), (2, "pump pump valve"), (3, None), (4, ""), (5, "valve and seal"), (6, "the the the")]


def brute_bm25(docs, question, k):
    rows = [(i, t.lower().split()) for i, t in docs if t is not None]
    n, avgdl = len(rows), sum(len(w) for _, w in rows) / len(rows)
    df = Counter(w for _, ws in rows for w in set(ws))
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: v if v >= 0 else 0.25 * mean for w, v in idf.items()}
    score = {}
    for i, ws in rows:
        tf = Counter(ws)
        score[i] = round(sum(idf.get(q, 0) * tf[q] * 2.5 / (tf[q] + 1.5 * (0.25 + 0.75 * len(ws) / avgdl)) for q in question.lower().split() if tf[q]), 6)
    return sorted(score.items(), key=lambda x: (-x[1], x[0]))[:k]


def test_bm25_equals_brute_force(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    questions = spark.createDataFrame([(7, "pump pump valve"), (8, "nothing here"), (9, None)], "query_id long, question string")
    got = {}
    for r in bm25_topk(questions, docs, k=3).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.doc_id, r.score))
    for q, text in ((7, "pump pump valve"), (8, "nothing here"), (9, "")):
        assert [(d, s) for _, d, s in sorted(got[q])] == brute_bm25(DOCS, text, 3)


def test_dense_and_odd_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 8))
    rows = [(i, [float(v) for v in x[i]]) for i in range(60)] + [(100, None), (101, [0.0] * 8), (102, [1.0]), (103, [float("nan")] * 8), (104, [float(v) * 3 for v in x[5]])]
    docs = spark.createDataFrame(rows, "doc_id long, embedding array<double>")
    asked = spark.createDataFrame([r for r in rows if r[0] in (5, 7, 100, 103)], "query_id long, vector array<double>")
    got = {}
    for r in dense_topk(asked, docs, k=4, dim=8).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.doc_id, r.score))
    assert set(got) == {5, 7}
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if v and len(v) == 8 and np.isfinite(v).all() and any(v)}
    for q in (5, 7):
        want = sorted(((i, round(1 / (3 - 2 * min(1, float(unit[q] @ u))), 6)) for i, u in unit.items()), key=lambda p: (-p[1], p[0]))[:4]
        assert [(d, s) for _, d, s in sorted(got[q])] == want


def test_rrf_golden(spark):
    mk = lambda ids: spark.createDataFrame([(1, d, i + 1) for i, d in enumerate(ids)], "query_id int, doc_id int, rank int")
    got = rrf(mk([1, 2, 3]), mk([3, 4, 1])).orderBy("rank").collect()
    assert [(r.doc_id, round(r.score, 6)) for r in got] == [(1, 0.032266), (3, 0.032266), (2, 0.016129), (4, 0.016129)]
    allowed = spark.createDataFrame([(1, 4)], "query_id int, doc_id int")
    assert [r.doc_id for r in postfilter(rrf(mk([1, 2, 3]), mk([3, 4, 1])), allowed).collect()] == [4]


def test_metadata(spark):
    docs = spark.createDataFrame([(1, "PVT", ["a", "b"]), (2, "PVT", None), (3, None, [])], "doc_id long, doc_type string, wells array<string>")
    index = metadata_index(docs, "doc_id", ["doc_type"], ["wells"])
    assert index.count() == 4
    asked = spark.createDataFrame([(1, "doc_type", "PVT"), (1, "wells", "a"), (2, "doc_type", "pvt")], "query_id int, field string, value string")
    assert [(r.query_id, r.doc_id) for r in search_metadata(index, asked).collect()] == [(1, 1)]


def test_graph(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 6))
    vectors = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(i, j) for i in range(80) for j in range(i + 1, 80) if round(float(u[i] @ u[j]), 6) > 0.7}
    assert {(r.src, r.dst) for r in similarity_edges(vectors, 0.7, dim=6, pivots=5).collect()} == want
    path = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "src long, dst long")
    seeds = spark.createDataFrame([(1, 1)], "query_id long, doc_id long")
    for hops, found in ((1, {1}), (2, {1, 2}), (3, {1, 2, 3})):
        assert {r.doc_id for r in traverse(seeds, path, hops).collect()} == found
    assert {r.doc_id for r in traverse(seeds, path, 3, max_nodes=1).collect()} == {1}
    assert similarity_edges(vectors.limit(0), 0.7, dim=6).count() == 0


def test_graph_of_copied_vectors(spark, tmp_path):
    """A third of all rows share a vector: degrees, edges and visits of every copy are those of all pairs."""
    import numpy as np

    from corespar.plans import retrieval

    x = np.random.default_rng(1).normal(size=(330, 64)).astype(np.float32)
    x[::3] = x[0]
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = np.round(u @ u.T, 6) > retrieval.EDGE
    np.fill_diagonal(near, False)
    spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert {tuple(r) for r in retrieval.graph_degree(spark, str(tmp_path)).collect()} == {(i, n) for i, n in enumerate(near.sum(axis=1).tolist()) if n}
    assert {tuple(r)[:2] for r in retrieval.similarity_graph_edges(spark, str(tmp_path)).collect()} == set(zip(*(z.tolist() for z in np.nonzero(np.triu(near)))))
    want = {(s, v, h) for s in (0, 100, 200, 300) for h, v in sorted([(0, s), *((1, v) for v in np.flatnonzero(near[s]).tolist())])[:20]}
    assert {tuple(r) for r in retrieval.bfs_1hop(spark, str(tmp_path)).collect()} == want
    two = {(s, v, 0 if v == s else 1 if near[s, v] else 2) for s in (0, 100, 200, 300) for v in range(330) if v == s or near[s, v] or (near[s] & near[v]).any()}
    assert {tuple(r) for r in retrieval.bfs_2hop(spark, str(tmp_path)).collect()} == two


def test_struct_fields_of_the_index(spark):
    rows = [(1, (1.5, None, [1.5, 2.0]), ["a", None]), (2, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, depth struct<min:double,max:double,all_values:array<double>>, wells array<string>")
    got = {(r.field, r.value, r.doc_id) for r in metadata_index(docs, "doc_id", [], ["wells"], ["depth"]).collect()}
    assert got == {("wells", "a", 1), ("depth.min", "1.5", 1), ("depth.all_values", "[1.5, 2.0]", 1)}


def test_many_questions_meet_the_rows_in_blocks(spark, monkeypatch):
    from corespar.operators import dense

    rng = np.random.default_rng(2)
    rows = [(i, [float(v) for v in rng.normal(size=8)]) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, embedding array<double>")
    asked = docs.selectExpr("doc_id as query_id", "embedding as vector")
    few = sorted(tuple(r) for r in dense_topk(asked, docs, k=3, dim=8).collect())
    monkeypatch.setattr(dense, "BROADCAST_QUESTIONS", 10)
    assert sorted(tuple(r) for r in dense_topk(asked, docs, k=3, dim=8).collect()) == few and len(few) == 150


@pytest.mark.parametrize("per_scan", [4096, 3])
def test_filters_are_applied_where_documents_are_scored(spark, monkeypatch, per_scan):
    """The best of those that all filters of a question allow, whatever the number of scans, as by pairs in Python."""
    from corespar.operators import dense

    monkeypatch.setattr(dense, "FILTERED_QUESTIONS", per_scan)
    words = [f"w{i % 7} w{i % 3} common w{i % 11} w{i % 7}" for i in range(900)]
    docs = [(i, None if i == 13 else " \t" if i == 14 else w, "ab"[i % 2], f"v{i % 4}") for i, w in enumerate(words)]
    chunks = spark.createDataFrame(docs, "doc_id long, text string, doc_type string, well string")
    asked = [(1, "w1 w2", {"doc_type": "a"}), (2, "common", {"doc_type": "b", "well": "v3"}), (3, "w5 common", {"well": "v9"}), (4, "w1", {}), (5, "w1 common", {"doc_type": "b", "well": "v2"}), (6, "w6 W3", {"well": "v0"}), (None, "w1", {"well": "v0"})]
    questions = spark.createDataFrame([(q, t) for q, t, _ in asked], "query_id long, question string")
    filters = spark.createDataFrame([(q, f, v) for q, _, fs in asked for f, v in fs.items()] + [(1, "doc_type", "a"), (6, "well", None)], "query_id long, field string, value string")

    def vector(text):
        out = np.zeros(384)
        for w in set(text.lower().split()):
            out[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 384] += np.log1p(text.lower().split().count(w))
        return out / max(np.linalg.norm(out), 1e-12)

    want = set()
    for q, t, fs in asked:
        if q is not None and fs:
            near = [(-round(1 / (3 - 2 * float(vector(t) @ vector(text))), 6), i) for i, text, kind, well in docs if text and all({"doc_type": kind, "well": well}[f] == v for f, v in fs.items()) and vector(t) @ vector(text) > 0]
            want |= {(q, i, -s, n + 1) for n, (s, i) in enumerate(sorted(near)[:5])}
    found = dense.filtered_topk(questions, chunks, metadata_index(chunks, "doc_id", ["doc_type", "well"], []), filters)
    assert {tuple(r) for r in found.select("query_id", "doc_id", "score", "rank").collect()} == want and {w[0] for w in want} == {1, 2, 6}
    assert dense.filtered_topk(questions, chunks.limit(0), metadata_index(chunks.limit(0), "doc_id", ["well"], []), filters).count() == 0
    assert dense.filtered_topk(questions, chunks, metadata_index(chunks, "doc_id", ["well"], []), filters.limit(0)).count() == 0
