"""The put-together operators, and the driver's contract."""

import json

import __spark_entry__ as entry
import pytest
from pyspark.sql import functions as F

from corespar.models import embed, request_body
from corespar.operators import pipeline
from corespar.operators.bm25 import bm25_topk
from corespar.operators.dense import text_topk
from corespar.operators.index import Index, build_index
from corespar.operators.tree import build_tree


def test_extract_all_and_images(spark):
    docs = spark.createDataFrame([(1, "Well ADK-GT-01 at 2500 m TVDSS, 85°C, 250 bar, DST in the Slochteren Formation.", "ADK-GT-01_PVT_Report.pdf"), (2, "x " * 400, "ADK-GT-02 notes.txt"), (3, None, None)], "doc_id long, text string, filename string")
    got = {r.doc_id: r for r in pipeline.extract_all(docs).collect()}
    assert got[1].primary_well == "ADK-GT-01" and got[1].doc_type == "PVT" and got[1].depth.min == 2500.0 and not got[1].needs_model
    assert got[2].needs_model and got[2].wells == ["ADK-GT-02"]
    assert got[3].wells == [] and got[3].depth is None and got[3].primary_well is None
    r = spark.range(1).select(pipeline.image_class(F.lit("A Map of it")).alias("a"), pipeline.image_class(F.lit(None).cast("string")).alias("b"), pipeline.image_text(F.lit("map"), F.lit("wells"), F.lit(None).cast("string")).alias("c")).first()
    assert tuple(r) == ("map", "error", "[Image: map]\nDescription: wells")
    m = spark.sql("SELECT named_struct('min', 1D, 'max', 2D, 'all_values', array(1D)) a, named_struct('min', cast(null as double), 'max', 5D, 'all_values', cast(null as array<double>)) b").select(pipeline.merge_measurements(F.col("a"), F.col("b")).alias("m")).first().m
    assert tuple(m) == (1.0, 5.0, [1.0])


def test_assemble_order(spark, monkeypatch):
    rows = [(1, "s", "table", "T"), (2, "s", " Text", "a"), (3, "s", "image", "I"), (4, "s", "text", "b"), (5, "s", "text", None), (6, None, "text", "x"), (7, "s", "text", " "), (8, "s", "text", "c")]
    elements = spark.createDataFrame(rows, "element_id long, source string, type string, content string")
    assert sorted(tuple(r) for r in pipeline.assemble(elements).collect()) == [("s", 0, 0, "a\n\nb\n\nc"), ("s", 1, 0, "I"), ("s", 2, 0, "T")]
    monkeypatch.setattr(pipeline, "BLOCK", 2)  # a source is cut into values of bounded size
    assert sorted(tuple(r) for r in pipeline.assemble(elements).where("kind = 0").collect()) == [("s", 0, 0, "a\n\nb"), ("s", 0, 1, "c")]
    assert pipeline.assemble(elements.limit(0)).count() == 0


def test_runs_are_merged_field_by_field(spark):
    rows = [(1, "s", (1.0, 2.0, [1.0]), 1), (2, "s", (None, 9.0, None), 2), (3, "s", None, 3), (4, "t", None, None), (5, None, (1.0, 1.0, [1.0]), 1)]
    meta = spark.createDataFrame(rows, "meta_id long, source string, temperature struct<min:double,max:double,all_values:array<double>>, ingested_at int")
    assert {r.source: tuple(r.m) for r in pipeline.merge_runs(meta, "temperature").collect()} == {"s": (1.0, 9.0, [1.0]), "t": (None, None, None)}


def test_model_metadata_and_images(spark):
    docs = spark.createDataFrame([(1, "the old report " * 40, "a.pdf"), (2, "short", "b.pdf"), (3, "no json here " * 50, "c.pdf")], "doc_id long, text string, filename string")
    say = lambda prompts, images: ['Sure: {"wells": ["ADK-GT-01"], "formations": ["Zechstein"]}' if "old" in p else "none" for p in prompts]
    got = {r.doc_id: r for r in pipeline.extract_all(docs, generator=say).collect()}
    assert got[1].wells == ["ADK-GT-01"] and got[1].primary_well == "ADK-GT-01" and got[1].formations == ["Zechstein"] and got[1].test_types == []
    assert got[2].wells == [] and got[3].wells == [] and got[3].needs_model

    def look(prompts, images):
        if any(i == b"bad" and "Describe" in p for p, i in zip(prompts, images)):
            raise ValueError("dark")
        return ["A Map" if "one word" in p else f"{len(i or b'')} bytes" for p, i in zip(prompts, images)]

    rows = [(1, " Image", "of wells", b"12345"), (2, "image", None, b"bad"), (3, "text", "x", None), (4, "image", "", None)]
    seen = {r.element_id: r for r in pipeline.describe_images(spark.createDataFrame(rows, "element_id long, type string, content string, data binary").coalesce(1), look, "data").collect()}
    assert set(seen) == {1, 2, 4} and seen[1].text == "[Image: map]\nDescription: 5 bytes" and seen[1].error is None
    assert seen[2].text is None and "dark" in seen[2].error and seen[4].text.endswith("0 bytes")
    body = spark.range(1).select(request_body("m", F.lit("what ?"), F.lit(b"abc")).alias("b")).first().b
    assert json.loads(body) == {"model": "m", "prompt": "what ?", "stream": False, "options": {"temperature": 0.1}, "images": ["YWJj"]}


def test_wells_by_a_tagger(spark):
    docs = spark.createDataFrame([(1, "ADK 12 of Shell near GT-7, ADK 12"), (2, None), (3, "")], "doc_id long, text string")

    def tagger(texts):
        return [[("ORG", "ADK 12"), ("ORG", "Shell"), ("GPE", "GT-7"), ("FAC", "ADK 12")] if "Shell" in t else [] for t in texts]

    assert {r.doc_id: r.wells for r in pipeline.wells_by_tagger(docs, tagger).collect()} == {1: ["ADK 12"], 2: [], 3: []}


CHUNK = "doc_id long, text string, source string, page int, primary_well string, doc_type string, all_wells array<string>, term string"


def some_chunks(spark):
    rows = [(i, f"chunk {i} about pump {i % 3} in ADK-GT-0{i % 4}", "s", i, f"ADK-GT-0{i % 4}", "PVT", [f"w{i}"], "x") for i in range(12)]
    return spark.createDataFrame(rows + [(50, None, "s", None, None, None, None, None), (51, "", "s", 1, None, None, [], None)], CHUNK)


def stored_index(spark, chunks, folder):
    build_index(chunks, folder, ["doc_type", "primary_well"], ["all_wells"])
    return Index.open(spark, folder)


def test_stored_index_answers_as_the_texts_do(spark, tmp_path, monkeypatch):
    from corespar.operators import sparse

    chunks = some_chunks(spark)
    index = stored_index(spark, chunks, str(tmp_path))
    questions = spark.createDataFrame([(1, "pump 2 of ADK-GT-01"), (2, "nothing there"), (3, None), (4, "pump pump chunk 5")], "query_id long, question string")
    for one, two in ((index.bm25_topk(questions, 5), bm25_topk(questions, chunks, 5)), (index.text_topk(questions, 5), text_topk(questions, chunks, 5))):
        assert sorted((r.query_id, r.rank, r.doc_id, r.score) for r in one.collect()) == sorted((r.query_id, r.rank, r.doc_id, r.score) for r in two.collect()) != []
    seeds = spark.createDataFrame([(7, 0), (7, 50)], "query_id long, doc_id long")
    near = {r.doc_id for r in index.similar_to(seeds, 0.7).collect()}
    assert near and 0 not in near and near <= set(range(12))
    few = sorted(tuple(r) for r in index.text_topk(questions, 5).collect())
    monkeypatch.setattr(sparse, "SCAN_QUESTIONS", 1)  # more questions than a task is sent meet the rows in blocks
    assert sorted(tuple(r) for r in index.text_topk(questions, 5).select("query_id", "doc_id", "score", "rank").collect()) == few
    assert {r.doc_id for r in index.similar_to(seeds, 0.7).collect()} == near
    parts = index.postings.where("term_part in (1, 2)").inputFiles()
    assert parts and all("term_part=" in f for f in parts)
    empty = stored_index(spark, chunks.limit(0), str(tmp_path / "none"))
    assert empty.bm25_topk(questions).count() == 0 and empty.text_topk(questions).count() == 0


def test_dispatch_filters_by_the_first_well(spark, tmp_path):
    index = stored_index(spark, some_chunks(spark), str(tmp_path))
    rows = [(1, "What is pump 1 ?"), (2, "What of ADK-GT-01 pump ?"), (3, "Compare pump 2 and chunk 5"), (4, "Explain the pump"), (5, "Summarize ADK-GT-02"), (6, "what about adk-gt-01 ?"), (7, "Compare ADK-GT-03 and pump 2")]
    questions = spark.createDataFrame(rows, "query_id long, question string")
    nodes = spark.createDataFrame([(100, 1, "all about the pump", None, ["ADK-GT-02", "ADK-GT-01"]), (101, 0, "pump summarize", "ADK-GT-02", []), (102, 0, "valve summarize", "ADK-GT-01", ["ADK-GT-01"])], "node_id long, level int, text string, primary_well string, wells array<string>")
    found = pipeline.retrieve(questions, index, nodes).collect()
    by = {q: sorted((r for r in found if r.query_id == q), key=lambda r: r.rank) for q in range(1, 8)}
    assert {q: v[0].strategy for q, v in by.items() if v} == {1: "dense", 2: "hybrid", 3: "graph", 4: "raptor", 5: "raptor", 6: "dense", 7: "graph"}
    assert len(by[1]) == 10 and all(len(v) <= 15 and [r.rank for r in v] == list(range(1, len(v) + 1)) for v in by.values())
    assert {r.doc_id for r in by[2]} <= {1, 5, 9} and by[2] and {r.doc_id for r in by[7]} <= {3, 7, 11} and by[7]
    assert sum(r.score is None for r in by[3]) >= 5 and {r.doc_id for r in by[4]} <= {100, 101, 102}
    assert {r.doc_id for r in by[5]} == {101} and len(by[6]) == 10  # wells are told with their case
    assert spark.range(1).select(pipeline.matches_well(F.lit("a"), F.lit(None).cast("string"), F.array(F.lit("a")))).first()[0]


def test_questions_to_answers(spark, tmp_path):
    index = stored_index(spark, some_chunks(spark), str(tmp_path))
    questions = spark.createDataFrame([(1, "What is pump 1 in ADK-GT-01 ?"), (2, "What is pump 2 ?"), (3, "What of XX-YY-99 ?")], "query_id long, question string")
    got = {r.query_id: r for r in pipeline.ask(questions, index).collect()}
    assert set(got) == {1, 2, 3} and (got[3].n_chunks, got[3].answer, got[3].confidence) == (0, None, None) and got[1].strategy == "hybrid" and "ADK-GT-01" in got[1].answer and got[1].confidence == 0.6 and got[1].is_grounded  # no chunk is of XX-YY-99
    say = lambda prompts, images: [f"ADK-GT-77 says so. Confidence: 80% {len(p) > 50 and 'Question: ' in p}" for p in prompts]
    told = {r.query_id: r for r in pipeline.ask(questions, index, generator=say).collect()}
    assert told[2].confidence == 0.8 and told[2].band == "high" and not told[2].is_grounded and told[2].answer.endswith("True")


def test_tree_levels(spark):
    rows = [(i, f"text {i}", f"W{i % 3}", "t", [float(i % 7), float(i % 5), 1.0]) for i in range(300)] + [(1000, "no vector", None, None, None)]
    leaves = spark.createDataFrame(rows, "node_id long, text string, primary_well string, doc_type string, vector array<double>")
    got = build_tree(leaves, generator=lambda prompts, images: [f"about {len(p)}" for p in prompts]).collect()
    levels = {at: [r for r in got if r.level == at] for at in range(4)}
    assert len(levels[0]) == 301 and 10 <= len(levels[1]) <= 18 and sum(r.num_children for r in levels[1]) == 300
    assert all(r.text.startswith("about") for r in levels[1]) and {w for r in levels[1] for w in r.wells} == {"W0", "W1", "W2"}
    parents = {r.node_id for r in got}
    assert all(r.parent_id in parents for r in levels[0] if r.node_id != 1000)
    assert [tuple(r)[1] for r in build_tree(leaves.limit(1)).collect()] == [0] and build_tree(leaves.limit(0)).count() == 0


def test_a_cluster_must_name_its_shared_folder():
    from types import SimpleNamespace as N

    from corespar import session

    none = N(isDefined=lambda: False)
    sc = N(master="spark://host:7077", _jsc=N(sc=lambda: N(getCheckpointDir=lambda: none)), getConf=lambda: {})
    with pytest.raises(ValueError):
        session.checkpoint_dir(N(sparkContext=sc, conf=N(get=lambda name, default: default)))


def test_embed(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None)], "id long, text string").coalesce(1)
    assert {r.id: r.embedding for r in embed(df, lambda texts: [[float(len(t)), 1.0] for t in texts]).collect()} == {1: [2.0, 1.0], 2: None}


def test_contract(spark, data):
    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names and {"rrf_hybrid", "p2_found", "bm25_batch"} <= names
    assert entry.entry(spark).count() > 0
    assert entry.queries()["metadata_filter_and"](spark, data).columns == ["query_id", "doc_id"]
