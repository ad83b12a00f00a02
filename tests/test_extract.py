"""Golden values of the extraction, routing and answer rules."""

import pytest
from pyspark.sql import functions as F

from corespar.operators import answer, extract, route

SAMPLE = "Well ADK-GT-01 was drilled to 2500 m TVDSS in the Slochteren Formation. Depth: 2500 m. Bottom-hole temperature 85°C (Temperature: 85). Pressure 250 bar, Pressure: 250. A DST was run."


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_measurements(spark):
    t = F.lit(SAMPLE)
    r = one(spark, d=extract.summary(extract.hits(t, extract.PATTERNS["depth"])), t=extract.summary(extract.hits(t, extract.PATTERNS["temperature"])), p=extract.summary(extract.hits(t, extract.PATTERNS["pressure"])), n=extract.summary(extract.hits(F.lit("nothing"), extract.PATTERNS["depth"])))
    assert (r.d.min, r.d.max, r.d.all_values) == (2500.0, 2500.0, [2500.0, 2500.0])
    assert (r.t.min, r.t.max) == (85.0, 85.0)
    assert (r.p.min, r.p.max) == (250.0, 250.0)
    assert r.n is None


def test_entities(spark):
    t = F.lit(SAMPLE)
    r = one(spark, w=extract.clean_entities(extract.hits(t, extract.PATTERNS["wells"]), wells=True), f=extract.clean_entities(extract.hits(t, extract.PATTERNS["formations"])), k=extract.clean_entities(extract.hits(t, extract.PATTERNS["test_types"])))
    assert r.w[:2] == ["ADK-GT-01", "Well ADK-GT-01"]
    assert r.f == ["Slochteren"] and r.k == ["DST"]


@pytest.mark.parametrize(
    ("name", "well", "kind"),
    [("ADK-GT-01_PVT_Report.pdf", None, "PVT"), ("ADK-GT-01 Well Report.pdf", "ADK-GT-01", "Well Report"), ("DST_2020.pdf", None, "Test Report"), ("Geological_Survey.pdf", None, "Litholog"), ("geothermal.pdf", None, "Geological")],
)
def test_file_names(spark, name, well, kind):
    r = one(spark, w=extract.file_well(F.lit(name)), k=extract.file_type(F.lit(name)))
    assert (r.w, r.k) == (well, kind)


def test_primary_well_and_mentions(spark):
    wells = F.array(F.lit("BRH-GT-02"), F.lit("ADK-GT-01"))
    r = one(spark, p=extract.primary_well(wells, F.lit("adk-gt-01_pvt.pdf")), q=extract.primary_well(wells, F.lit("x.pdf")), m=extract.mentioned(F.lit("in adk gt 01 and ADK_GT_02"), F.array(F.lit("ADK-GT-01"), F.lit("ADK_GT-02"), F.lit("X+1"))))
    assert (r.p, r.q, r.m) == ("ADK-GT-01", "BRH-GT-02", ["ADK-GT-01", "ADK_GT-02"])


@pytest.mark.parametrize(
    ("question", "wells", "chosen"),
    [
        ("What is the temperature in well ADK-GT-01?", ["ADK-GT-01"], "hybrid"),
        ("Compare ADK-GT-01 and ADK-GT-02", ["ADK-GT-01", "ADK-GT-02"], "graph"),
        ("Summarize all wells in Slochteren Formation", [], "raptor"),
        ("Explain the basin", [], "raptor"),
        ("What is the temperature?", [], "dense"),
    ],
)
def test_routing(spark, question, wells, chosen):
    q = F.lit(question)
    r = one(spark, w=route.question_wells(q), s=route.strategy(route.category(q), route.question_wells(q), route.question_formations(q)))
    assert (r.w, r.s) == (wells, chosen)


@pytest.mark.parametrize(("text", "score"), [("Confidence: 85%", 0.85), ("I am 90% confident", 0.90), ("confidence: 95/100", 0.95), ("Confidence: 150%", 1.0), ("I don't know", 0.1), ("x" * 101, 0.7), ("short", 0.5)])
def test_confidence(spark, text, score):
    assert one(spark, c=answer.confidence(F.lit(text))).c == pytest.approx(score)


@pytest.mark.parametrize(("text", "ok"), [("ADK-GT-01 is 85°C at 2500m.", True), ("ADK-GT-02 is 85°C at 2500m.", False), ("It is 99°C at 10m.", False), ("That is not available.", True)])
def test_grounding(spark, text, ok):
    assert one(spark, g=answer.grounded(F.lit(text), F.lit("Well ADK-GT-01 is 85°C at 2500m depth, 01 is fine"))).g is ok


def test_context_budget(spark):
    rows = [(1, r, "x" * n, "s", 1, None) for r, n in ((1, 1000), (2, 1500), (3, 2000), (4, 1))] + [(2, 1, "y" * 5000, "s", 1, None)]
    df = spark.createDataFrame(rows, "query_id int, rank int, text string, source string, page int, primary_well string")
    kept = answer.pack_context(df).select("query_id", "rank").collect()
    assert sorted((r.query_id, r.rank) for r in kept) == [(1, 1), (1, 2)]  # a prefix: the short fourth isn't taken, the long first leaves nothing


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("at depth 2500 m", "depth", []),
        ("Depth: 2500 m", "depth", ["Depth: 2500 m"]),
        ("1200 – 1300 m, 2500mTVDSS and 2500 m TVDSS", "depth", ["2500 m TVDSS", "1200 – 1300 m"]),
        ("2 cores, 85 degrees Celsius", "temperature", ["2 c", "85 degrees Celsius"]),
        ("temperature 85", "temperature", []),
        ("from 300 adk-gt-01", "wells", ["adk-gt-01", "from 300"]),
        ("the Formation", "formations", ["the"]),
        ("Ümraniye Group and Vlieland Sandstone", "formations", ["Vlieland"]),
    ],
)
def test_patterns_as_given(spark, text, kind, found):
    hits = one(spark, h=extract.hits(F.lit(text), extract.PATTERNS[kind])).h
    assert [x for x in found if x in hits] == found and (found or not hits)


def test_strict_patterns(spark):
    get = lambda t, q: one(spark, m=extract.summary(extract.hits(F.lit(t), extract.STRICT[q]))).m
    assert get("2 cores at 85 °C", "temperature").all_values == [85.0] and get("2500 m deep", "depth").min == 2500.0 and get("150 cubic", "temperature") is None


@pytest.mark.parametrize(("question", "wells"), [("what about adk-gt-01?", []), ("Well ADK-GT-01 depth", ["ADK-GT-01", "Well ADK-GT-01"]), ("Bergen-GWT-03 and bergen-gwt-04", ["Bergen-GWT-03"])])
def test_questions_tell_wells_with_their_case(spark, question, wells):
    assert one(spark, w=route.question_wells(F.lit(question))).w == wells


@pytest.mark.parametrize(("text", "refuses"), [("I don't have that.", True), ("The texts do not contain it, XX-YY-01.", True), ("no information on XX-YY-01", False), ("90%confident: 5 bar", True)])
def test_refusals_and_stated_confidence(spark, text, refuses):
    r = one(spark, g=answer.grounded(F.lit(text), F.lit("5 bar")), c=answer.confidence(F.lit(text)))
    assert r.g is refuses and (r.c == 0.9) == ("90%" in text)
