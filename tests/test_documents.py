"""Chunking, tables, sources, store, streams, trees, models."""

import zipfile

import pytest
from pyspark.sql import functions as F

from corespar.models import FirstSentences, generate
from corespar.operators import chunk, tables_in_text, tree
from corespar.sources.files import json_in_text, read_folder, parse_files
from corespar.sources.store import append_new, load, save, save_tables_as_csv
from corespar.streaming.ingest import late_counts, watch_folder


def test_pack_rules():
    s = ["a" * 300, "b" * 300, "c" * 90, "d" * 300]
    assert chunk.pack(["x", "y"]) == ["x y"]
    assert chunk.pack(s) == [" ".join(s[:3]), " ".join([s[2], s[3]])]
    assert chunk.pack([]) == []
    long = chunk.pack(["p" * 500 + "," + "q" * 500])
    assert long == ["p" * 500 + " ,", "q" * 500]
    assert all(w in " ".join(chunk.pack(s)) for w in s)


def test_semantic_chunks_cover_all(spark):
    text = ". ".join(f"sentence number {i} about {'pumps' if i % 7 else 'valves and seals'}" for i in range(120))
    docs = spark.createDataFrame([(1, text), (2, "short"), (3, None), (4, "  "), (5, text)], "doc_id long, text string")
    rows = chunk.semantic_chunks(docs).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append((r.chunk_index, r.text))
    assert set(by) == {1, 2, 5} and by[2] == [(0, "short")]
    assert sorted(by[1]) == sorted(by[5])
    whole = " ".join(t for _, t in sorted(by[1]))
    assert all(f"sentence number {i} " in whole + " " for i in range(120))


def test_table_rules(spark):
    rows = [(1, "table", "a: 1 | b: 2\na: 3 | b: ", {"accuracy": "80"}), (2, "Table ", "a | b\n | ", {"accuracy": "10"}), (3, "table", "1\n2", None), (4, "table", None, None), (5, "text", "x | y\n1 | 2", None)]
    e = spark.createDataFrame([(*r, 1) for r in rows], "element_id long, type string, content string, attrs map<string,string>, page int")
    assert {r.element_id: (r.n_rows, r.n_cols, r.filled) for r in tables_in_text.table_shape(e).collect()} == {1: (2, 2, 0.75), 2: (2, 2, 0.5), 3: (2, 1, 1.0)}
    assert [r.element_id for r in tables_in_text.accepted_tables(e).collect()] == [1]
    assert tables_in_text.column_names(["", "a", "a", None, "a_1"]) == ["col_0", "a", "a_1", "col_3", "a_1_1"]
    assert tables_in_text.table_name("test wells.pdf", 0) == "table_test_wells_pdf_0"
    assert tables_in_text.table_name("x" * 100, 12).endswith("_12") and len(tables_in_text.table_name("x" * 100, 12)) == 64


def test_table_store(spark):
    store = tables_in_text.TableStore(spark)
    name = store.add_rows("wells.pdf", 0, [{"Well": "ADK-GT-01", "Temp_C": 85}, {"Well": "BRH-GT-02", "Temp_C": 80, "Depth m": 5}, {"Well": "Bergen-GWT-03", "Temp_C": 95}])
    assert [(r.Well, r.Temp_C) for r in store.query(f"SELECT Well, Temp_C FROM {name} WHERE Temp_C > 84 ORDER BY 2").collect()] == [("ADK-GT-01", 85), ("Bergen-GWT-03", 95)]
    assert store.describe(name)["n_rows"] == 3 and store.tables() == [name] and "Depth_m" in store.describe(name)["columns"]
    assert store.add_rows("none", 1, []) is None
    csv = store.add_csv_text("c", 2, "a,b\n1,2\n3,4")
    assert store.query(f"SELECT sum(a) AS s FROM {csv}").first().s == 4
    store.close()
    assert store.tables() == []


def office(path, parts):
    with zipfile.ZipFile(path, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)


@pytest.fixture
def folder(tmp_path):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    office(tmp_path / "a.docx", {"word/document.xml": f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>First</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>Second part</w:t></w:r></w:p></w:body></w:document>'})
    s, r = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    office(
        tmp_path / "b.xlsx",
        {
            "xl/workbook.xml": f'<workbook xmlns="{s}" xmlns:r="{r}"><sheets><sheet name="S" sheetId="1" r:id="rId1"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": '<Relationships xmlns="x"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
            "xl/sharedStrings.xml": f'<sst xmlns="{s}"><si><t>Well</t></si></sst>',
            "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{s}"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>5</v></c></row></sheetData></worksheet>',
        },
    )
    (tmp_path / "c.html").write_text("<p>Some text here</p><table><tr><td>x</td><td>1</td></tr></table><script>no</script>")
    (tmp_path / "d.txt").write_text("plain text of some length")
    (tmp_path / "e.csv").write_text("a,b\n1,2\n")
    (tmp_path / "f.docx").write_text("broken")
    (tmp_path / "g.bin").write_text("ignored")
    return tmp_path


def test_folder_source_and_stream(spark, folder, tmp_path_factory):
    rows = {(r.source, r.type): r for r in read_folder(spark, str(folder)).collect()}
    assert rows["a.docx", "text"].content == "First\n\nSecond part"
    assert rows["b.xlsx", "table"].content == "Well |  | 5"
    assert rows["c.html", "table"].content == "x | 1" and rows["c.html", "text"].content == "Some text here"
    assert rows["e.csv", "table"].content == "a | b\n1 | 2" and rows["d.txt", "text"].page == 1
    assert rows["f.docx", None].error
    out = tmp_path_factory.mktemp("out")
    for turn in range(2):
        q = watch_folder(spark, str(folder), str(out / "elements"), str(out / f"cp{turn}"))
        q.awaitTermination(120)
        assert spark.read.parquet(str(out / "elements")).count() == len(rows)  # the second run adds nothing


def test_store(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "id long, level string")
    save({"nodes": df}, str(tmp_path), {"nodes": "level"})
    assert {tuple(r) for r in load(spark, str(tmp_path), ["nodes"])["nodes"].select("id", "level").collect()} == {(1, "x"), (2, "y")}
    assert append_new(df, str(tmp_path / "t"), ["id"]) == 2
    assert append_new(df.unionByName(df.withColumn("id", F.col("id") + 1)), str(tmp_path / "t"), ["id"]) == 1


def test_only_a_missing_table_counts_as_empty(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "id long, level string")
    assert append_new(df, str(tmp_path / "t"), ["id"]) == 1
    for f in (tmp_path / "t").rglob("*.parquet"):
        f.write_bytes(b"broken")
    with pytest.raises(Exception):
        append_new(df, str(tmp_path / "t"), ["id"])


def test_tables_as_csv_and_several_extractors(spark, tmp_path):
    rows = [("a", " Table ", "x | 1\ny | 2", 1), ("a", "text", "no", 1), ("b", "TABLE", None, 1), ("b", "table", "z", 2)]
    save_tables_as_csv(spark.createDataFrame(rows, "source string, type string, content string, page int"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 3
    files = spark.createDataFrame([("/in/a.pdf", b"x")], "path string, content binary")

    def breaks(data):
        raise ValueError("no")

    got = parse_files(files, {".pdf": [lambda d: [("text", "one", 1)], breaks, lambda d: [("table", "two", 2)]]}).collect()
    assert [(r.type, r.content, r.error) for r in got] == [("text", "one", None), (None, None, "ValueError: no"), ("table", "two", None)]


def test_chunks_as_an_index_takes_them(spark):
    long = "The pump of ADK-GT-01 failed again. " * 40
    docs = spark.createDataFrame([(1, long, "s", "PVT", "ADK-GT-01", ["ADK-GT-01", "BRH-GT-02"]), (2, "short", "s", None, None, None), (3, None, "s", None, None, None), (4, " ", None, None, None, None)], "doc_id long, text string, source string, doc_type string, primary_well string, all_wells array<string>")
    got = chunk.chunk_documents(docs).collect()
    assert {r.doc_id for r in got} == {1, 2} and all(r.text.startswith("[Context: Source: s | Type: PVT") and r.chunk_wells == ["ADK-GT-01"] for r in got if r.doc_id == 1)
    assert [(r.text, r.chunk_wells) for r in got if r.doc_id == 2] == [("short", None)]


def test_models(spark):
    class Fails:
        def __call__(self, prompts, images):
            if any("bad" in p for p in prompts):
                raise ValueError("no")
            return [p.upper() for p in prompts]

    df = spark.createDataFrame([(1, "good"), (2, "bad")], "id long, prompt string").coalesce(1)
    got = {r.id: (r.generated, r.error) for r in generate(df, Fails()).collect()}
    assert got == {1: ("GOOD", None), 2: (None, "ValueError: no")}
    assert generate(df, FirstSentences(2)).first().generated == "go"
    text = spark.createDataFrame([('sure: {"wells": ["a"]} done',), ("none",)], "t string")
    assert [r.j.wells if r.j else None for r in text.select(json_in_text("t", "wells array<string>").alias("j")).collect()] == [["a"], None]


def test_tree_and_windows(spark):
    rows = [(i, f"text {i}", "W" if i < 10 else None, "PVT", [float(i // 10), float(i % 10) / 100, 1.0]) for i in range(40)]
    nodes = spark.createDataFrame(rows, "node_id long, text string, primary_well string, doc_type string, vector array<double>")
    t = tree.build_tree(nodes, levels=2, clusters=4).collect()
    leaves = [r for r in t if r.level == 0]
    parents = {r.node_id: r for r in t if r.level == 1}
    assert len(leaves) == 40 and all(r.parent_id in parents for r in leaves)
    assert sum(p.num_children for p in parents.values()) == 40
    assert tree.build_tree(nodes.limit(0)).count() == 0
    ranked = spark.createDataFrame([(1, 0, i, float(i)) for i in range(5)] + [(1, 1, 9, 2.5)], "query_id int, level int, node_id long, score double")
    assert [r.node_id for r in tree.per_level(ranked, 2).orderBy("rank").collect()] == [4, 3, 9]
    e = spark.sql("SELECT timestamp'2024-01-01' AS ingested_at, 's' AS source")
    assert late_counts(e).first().n == 1
