"""Problems 3, 4, 5, 7 and 10."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corespar.llm.canonical import Trie, allowed, map_entries, parse
from corespar.llm.copies import CountingTrie, collapse
from corespar.llm.pii import Finder, feistel, find_personal, mask, mask_personal, pseudonym
from corespar.llm.quality import CLASSES, classify_texts, text_statistics
from corespar.llm.scans import Bigrams, Channel, Repair, confusion_costs, line_key, repair_scans, roman

REFERENCE = [(1, "Upper Neldbroom Limestone", "NLDU"), (2, "Lower Neldbroom Limestone", "NLDL"), (3, "Honbeernlin Claystone", "HNBC"), (4, "Raagrustmem Claystone", "RGRC"), (5, "Konvoorn Sandstone", "KNVS")]


@pytest.mark.parametrize(
    ("entry", "found"),
    [("NELDBROOM LST, UPR", 1), ("Lwr Ne1dbr00m", 2), ("Neldbroom", 0), ("honbeern-lin clayst. (prob.)", 3), ("HN.BC", 3), ("hnbc", 3), ("Raagrust mem.", 4), ("Könvöorn SST", 5), ("Kovnoorn", 5), ("Grostdroond Fm.", 0), ("Formation", 0), ("?", 0), ("K0nv00rn", 5), ("x" * 5000, 0), ("Konvorrrn", 5)],
)
def test_entries(entry, found):
    assert Trie(REFERENCE).match(entry)[0] == found


def distance(a, b):
    d = {(i, j): max(i, j) for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            v = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                v = min(v, d[i - 2, j - 2] + 1)
            d[i, j] = v
    return d[len(a), len(b)]


@settings(max_examples=60, deadline=None)
@given(st.sampled_from(["neldbroom", "honbeernlin", "konvoorn"]), st.lists(st.tuples(st.integers(0, 12), st.sampled_from("abnorl"), st.sampled_from("dis")), max_size=4))
def test_automaton_equals_distance(word, edits):
    for at, sign, kind in edits:
        at = min(at, len(word))
        word = word[:at] + (sign if kind != "d" else "") + word[at + (kind != "i") :]
    trie = Trie(REFERENCE)
    got = {(d, i) for d, i, *_ in trie.within(word)}
    want = set()
    for i, name, _ in REFERENCE:
        core = parse(name)[0]
        if word and distance(word, core) <= allowed(len(core)):
            want.add((distance(word, core), i))
    assert got == want


def test_mapping_of_odd_rows(spark):
    schema = "meta_id long, formations array<string>, entry string, distance int"
    rows = [(1, ["Konvoorn Sandstone", None, " ", "konvoorn", "unknown"], "x", 1), (2, None, "x", 1), (3, [], None, None), (None, ["Konvoorn"], "x", 1), *[(10 + i, ["unknown"], "x", 1) for i in range(50)], (1, ["Konvoorn Sandstone"], "x", 1)]
    reference = spark.createDataFrame(REFERENCE, "formation_id int, formation_name string, code string")
    got = map_entries(spark.createDataFrame(rows, schema), reference).collect()
    assert sorted((r.meta_id, r.pos, r.formation_id, r.how) for r in got if r.meta_id == 1) == [(1, 0, 5, "exact"), (1, 0, 5, "exact"), (1, 3, 5, "written"), (1, 4, 0, "none")]
    assert len(got) == 54
    assert map_entries(spark.createDataFrame([], schema), reference).count() == 0


# --- copies


def canonical(kind, content):
    clean = lambda s: "".join(c for c in s.lower() if c.isalnum())
    kind = kind.strip().lower()
    if kind != "table":
        return kind, clean(content)
    lines = ["\x1f".join(sorted(filter(None, map(clean, re.split(r"[|;\t]", x))))) for x in content.split("\n")]
    return kind, "\x1e".join(filter(None, lines))


def test_copies_equal_brute_force(spark):
    rng = random.Random(3)
    base = ["The pump of well %d was replaced after the long test in spring" % i for i in range(30)] + ["The pump of well 7 was replaced after the long test in winter"] * 5
    rows = []
    for i in range(600):
        text = rng.choice(base) if i % 3 else base[0]  # a third is one record
        kind = rng.choice(["text", " Text", "TABLE", "table "])
        if "a" in kind.lower():
            cells = [f"name{k}: value {k} of {text[17:24]}" for k in range(4)]
            rng.shuffle(cells)
            text = rng.choice([" | ", ";", "\t"]).join(cells) + "\nsecond line | " + text
        rows.append((i, kind, rng.choice([text, text.upper(), f"  {text}!!", text.replace(" ", "  ")]), "form", 1))
    rows += [(1000, "text", None, "x", 1), (1001, None, base[0], "x", 1), (1002, "text", "short", "x", 1), (1003, "text", "", "x", 1), (1004, "text", "long " * 50_000, "x", 1), (1005, "text", "LONG\n" * 50_000, "x", 1), (None, "text", base[0], "x", 1)]
    df = spark.createDataFrame(rows, "element_id long, type string, content string, form string, copies int")
    groups = {}
    for i, kind, content, *_ in rows:
        if i is not None and kind and content and sum(c.isalnum() for c in content) >= 40:
            groups.setdefault(canonical(kind, content), []).append(i)
    want = {(i, min(g), len(g)) for g in groups.values() for i in g}
    for fits in (65_536, 20):  # the small limit splits buckets by further characters
        assert {(r.element_id, r.first_id, r.copies) for r in collapse(df, fits=fits).collect()} == want
    assert collapse(df.limit(0)).count() == 0


def test_forms_with_a_long_common_opening_are_split(spark, monkeypatch):
    """Different forms that share their first 1,100 letters don't meet in one task."""
    from corespar.llm import copies

    count = copies._count

    def counted(table):
        assert len(table) <= 40
        return count(table)

    monkeypatch.setattr(copies, "_count", counted)
    rows = [(i, "text", "opening" * 160 + f"{i % 90:04d}" * 300) for i in range(120)]
    got = collapse(spark.createDataFrame(rows, "element_id long, type string, content string"), fits=16).collect()
    assert {(r.element_id, r.first_id, r.copies) for r in got} == {(i, i % 90, 2 if i % 90 < 30 else 1) for i in range(120)}


def test_tries_of_a_partition_are_bounded(spark, monkeypatch):
    """Forms given out by several tries of one partition are still one record."""
    from corespar.llm import copies

    monkeypatch.setattr(copies, "TRIE_ROWS", 7)
    rows = [(i, "text", f"the record number {i % 5} about the pump and the valve of the well") for i in range(100)]
    got = collapse(spark.createDataFrame(rows, "element_id long, type string, content string")).collect()
    assert {(r.element_id, r.first_id, r.copies) for r in got} == {(i, i % 5, 20) for i in range(100)}


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text("ab", max_size=20), max_size=40))
def test_counting_trie(keys):
    trie = CountingTrie()
    for i, k in enumerate(keys):
        trie.add(k, i)
    assert {x[0]: (x[1], x[2]) for x in trie.leaves} == {k: (keys.count(k), keys.index(k)) for k in keys}


# --- scanned text

LEXICON = "the a pump of well was replaced after long test claystone high-temperature temperature high salinity in with station and units while model to".split()


def repaired(text, page=None, headers=()):
    return Repair(Channel(LEXICON)).text(text, page, lambda line: line_key(line) in headers)


@pytest.mark.parametrize(
    ("text", "page", "fixed", "kinds"),
    [
        ("the pump was re-\nplaced after", 3, "the pump was replaced after", {"broken_word"}),
        ("a high-\ntemperature test", 3, "a high-temperature test", set()),
        ("in the sa­\nlinity", 3, "in the salinity", {"broken_word"}),
        ("vvhile the daystone", 3, "while the claystone", {"misread"}),
        ("5alinity in the modcl", None, "salinity in the model", {"misread"}),
        ("the long\n— 20 —\ntest", 20, "the long test", {"page_number"}),
        ("the long\n478\ntest", 20, "the long 478 test", set()),
        ("the wel1\n   xiv", 14, "the well", {"misread", "page_number"}),
        ("the sa¬\nliriity", 1, "the salinity", {"broken_word", "misread"}),
        ("", 1, "", set()),
        ("near BRH-\nGT-12 well", 1, "near BRH-GT-12 well", set()),
    ],
)
def test_repair(text, page, fixed, kinds):
    assert repaired(text, page) == (fixed, kinds)


def test_headers_and_context():
    key = line_key("Tarnbeck  Geo  Final  PVT  SDK-GW-29      p. 8")
    assert key == line_key("TARNBECK GEO FINAL PVT SDK-GW-29") == line_key("12   Tarnbeck Geo Final PVT SDK-GW-29")
    assert repaired("Tarnbeck Geo Final PVT SDK-GW-29   p. 8\nthe test", 8, {key}) == ("the test", {"running_header", "page_number"})
    assert line_key("within the model. The pump") is None and roman(49) == "xlix"
    # two candidates for one reading: the bigram decides
    words = ["the", "of", "bit", "hit", "drill", "song"]
    place = {w: i for i, w in enumerate(sorted(words))}
    c = Channel(words, Bigrams(len(words), np.array([place["drill"] * 6 + place["bit"], place["song"] * 6 + place["hit"]]), np.array([50, 50])))
    assert c.decode([[("drill", 0)], [("bit", 1), ("hit", 1)]])[1] == "bit"
    assert c.decode([[("song", 0)], [("bit", 1), ("hit", 1)]])[1] == "hit"


def test_words_of_the_lexicon_are_doubted():
    """A misreading that is a word itself: read as it is, unless the words around it speak for the other one."""
    words = sorted(["the", "burn", "bum", "was", "hot", "test"])
    pair = lambda a, b: words.index(a) * len(words) + words.index(b)
    follows = Bigrams(len(words), np.array([pair("the", "burn"), pair("burn", "was"), pair("was", "hot")]), np.array([2000, 2000, 10]))
    assert Repair(Channel(words, follows)).words("the bum was hot") == ("the burn was hot", True)
    assert Repair(Channel(words)).words("the bum was hot") == ("the bum was hot", False)


def test_any_number_of_confusions():
    word = "hydromineralwaterinstallation" * 3
    read = word.replace("m", "rn").replace("w", "vv").replace("s", "5").replace("i", "1").replace("o", "0")
    channel = Channel([word, "water"])
    assert channel.candidates(read)[0][0] == word and channel.candidates("x" * 10_000) == [] and channel.candidates(word[:-1]) == []


def test_confusions_are_estimated(spark):
    lexicon = ["pump", "model", "station"]
    rows = [("the purnp and the mode1 station pump",)] * 30 + [("purnp",)] * 20 + [("pump model",)] * 50 + [(None,), ("",)]
    scanned = spark.createDataFrame(rows, "content string").where("content is not null")
    costs = confusion_costs(scanned, lexicon)
    assert costs["m", "rn"] < costs["l", "1"] < costs["w", "vv"] if ("w", "vv") in costs else costs["m", "rn"] < costs["l", "1"]
    assert costs["m", "rn"] == pytest.approx(-np.log((50 + 1) / (50 + 30 + 50 + 50 + 100)))


def test_scans_on_spark(spark):
    schema = "element_id long, source string, type string, content string, page int, attrs map<string,string>, key long, headers string"
    ocr = {"extractor": "ocr"}
    header = "Silverdyke Resources Annual PVT OOM-12"
    rows = [(i, "s", "text", f"{header}\nthe pump was re-\nplaced", i, ocr, 1, "x") for i in range(1, 4)]
    rows += [(4, "t", " Text", f"{header}\nthe test", 4, ocr, 1, "x"), (5, None, "text", f"{header}\nthe test", 5, ocr, 1, "x"), (6, "s", "text", None, 6, ocr, 1, "x"), (7, "s", "text", "plain re-\nplaced", 7, None, 1, "x"), (8, "s", "text", "  \n ", None, ocr, 1, "x"), (9, "s", "table", "re-\nplaced", 9, ocr, 1, "x"), (10, "s", "text", "the pump " * 20_000, 1, ocr, 1, "x")]
    df, lexicon = spark.createDataFrame(rows, schema), spark.createDataFrame([(w,) for w in LEXICON], "word string")
    got = {r.element_id: (r.repaired, r.noise_kinds) for r in repair_scans(df, lexicon).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 8, 10}
    assert got[1] == ("the pump was replaced", ["broken_word", "running_header"]) and got[8] == ("", [])
    assert got[4][1] == [] and got[4][0].startswith(header)
    assert repair_scans(df.limit(0), lexicon).count() == 0


# --- quality


def test_classes_and_statistics(spark):
    schema = "element_id long, type string, content string, words string, lines int"
    prose = "The pump of the well was replaced after the test, and the model was in the station."
    lists = "- pump one\n- well two\n- test three\n- model four"
    table = "Well | Pump | Test\nA-1 | 12.5 | 3\nB-2 | 8 | -\nC-3 | 99 | 1"
    junk = "^~<_|*<.#|-^/#> _.|*#\\:.-\\_:*:#:>*"
    rows = [(i, "text", t, "x", 1) for i, t in enumerate([prose, lists, table, junk] * 6)] + [(100, "text", None, "x", 1), (101, "text", " - ", "x", 1), (102, "Text ", prose, "x", 1), (103, "image", prose, "x", 1), (104, "text", prose * 2000, "x", 1)]
    e = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(i, CLASSES[i % 4]) for i in range(20)] + [(None, "prose"), (5, None)], "element_id long, text_class string")
    common, lexicon = (spark.createDataFrame([(w,) for w in ws], "word string") for ws in ("the of was in and after".split(), LEXICON))
    got = {r.element_id: r.text_class for r in classify_texts(e, labels, common, lexicon).collect()}
    assert got == {**{i: CLASSES[i % 4] for i in range(24)}, 102: "prose", 104: "prose"}
    stats = {r.element_id: r for r in text_statistics(e, common).collect()}
    assert stats[0].n_words == 17 and stats[0].share_common == pytest.approx(11 / 17, abs=1e-6) and stats[0].share_punctuated == 1.0
    assert stats[3].n_words == 0 and stats[3].mean_word_length == 0.0 and stats[3].symbol_ratio > 0.9
    assert classify_texts(e.limit(0), labels.limit(0), common, lexicon).count() == 0
    assert {r.text_class for r in classify_texts(e, labels.limit(0), common, lexicon).collect()} <= set(CLASSES)


# --- personal items

GIVEN, FAMILY, ORDINARY = ["Anna", "Peter", "Katrin"], ["Filfol"], ["the", "following", "unter"]


@pytest.mark.parametrize(
    ("text", "items"),
    [
        ("Ring Peter Feixdisk on (02) 5550 2076 about it.", ["name:Peter Feixdisk", "phone:(02) 5550 2076"]),
        ("Present: QUAXXYCK, Katrin; Dr. Fauskdei; minutes by L. van Klackxa.", ["name:QUAXXYCK, Katrin", "name:Fauskdei", "name:L. van Klackxa"]),
        ("Signed, W. Plaurpyse", ["name:W. Plaurpyse"]),
        ("Signed, SUXERSEIV, Peter Following the test; Warstoor, Anna Janyer", ["name:SUXERSEIV, Peter", "name:Anna Janyer"]),
        ("mail klauvdiv+wells (at) example.org or a.b[at]example[dot]com now", ["email:klauvdiv+wells (at) example.org", "email:a.b[at]example[dot]com"]),
        ("quoted @ 65 per metre", []),
        ("To: ANNA.X@EXAMPLE.NET", ["email:ANNA.X@EXAMPLE.NET"]),
        ("passport no.: J46996239, BSN = 0542.14.494 and national ID # 53-738134-G", ["id_number:J46996239", "id_number:0542.14.494", "id_number:53-738134-G"]),
        ("See sheet 522-16-8833; Sample 076778557; Licence 84-636494; VY5419598 was replaced; 494 305 496 litres; 2021-02-26", []),
        ("call +4930/23125362 or +44 (0)7700 900 047 or 06.39.98.09.01 or 0049 69 90009 306 or 07700 900374 or 290-555-0123", ["phone:+4930/23125362", "phone:+44 (0)7700 900 047", "phone:06.39.98.09.01", "phone:0049 69 90009 306", "phone:07700 900374", "phone:290-555-0123"]),
        ("lives at Flat 1, 7 Droldnuk Close, 1719 HE Tieldbrold and", ["address:Flat 1, 7 Droldnuk Close, 1719 HE Tieldbrold"]),
        ("from 46bis avenue Loogrield, Naanddrakwa; Am Nerntust 109, 5825 WY Haldtaarnlust; Drienkildstr. 200", ["address:46bis avenue Loogrield, Naanddrakwa", "address:Am Nerntust 109, 5825 WY Haldtaarnlust", "address:Drienkildstr. 200"]),
        ("The Filfol Formation at 131 °C. Unter der Well Filfol-GT-02. Im Jahr 2003 sank", []),
        ("", []),
    ],
)
def test_items(text, items):
    assert [f"{k}:{text[a:b]}" for k, a, b in Finder(GIVEN, FAMILY, ORDINARY).spans(text)] == items


@settings(max_examples=80, deadline=None)
@given(st.integers(2, 10_000), st.binary(min_size=1, max_size=8))
def test_feistel_is_a_permutation(size, key):
    size = min(size, 400)
    assert sorted(feistel(v, size, key, "t") for v in range(size)) == list(range(size))


@given(st.from_regex(r"\+?[0-9]{3}[ -][0-9]{4}[A-Z]{0,2}", fullmatch=True))
def test_pseudonyms_keep_the_format(value):
    p = pseudonym(value, "phone", b"k")
    shape = lambda s: re.sub(r"[A-Z]", "A", re.sub(r"[0-9]", "9", s))
    assert shape(p) == shape(value) and p == pseudonym(value, "phone", b"k")
    assert re.sub("[ +-]", "", pseudonym(value.replace("-", " "), "phone", b"k")) == re.sub("[ +-]", "", p)


def test_personal_on_spark(spark):
    schema = "doc_id long, text string, masked string, id int"
    text = "Ring Peter Feixdisk on 07700 900374."
    rows = [(1, text, "x", 1), (2, None, "x", 1), (3, "", "x", 1), (4, "word " * 200_000 + text, "x", 1), (1, text, "x", 1), (5, "é€😀 " + text, "x", 1)]
    df, lists = spark.createDataFrame(rows, schema), (GIVEN, FAMILY, ORDINARY)
    got = find_personal(df, lists).collect()
    assert sorted((r.doc_id, r.pii_type, r.start_pos) for r in got if r.doc_id in (1, 5)) == [(1, "name", 5), (1, "name", 5), (1, "phone", 23), (1, "phone", 23), (5, "name", 9), (5, "phone", 27)]
    assert sum(r.doc_id == 4 for r in got) == 2
    masked = {r.doc_id: r for r in mask_personal(df, lists, "key").collect()}
    assert masked[2].masked is None and masked[3].masked == "" and masked[2].n_items == 0
    m = masked[1].masked
    assert re.fullmatch(r"Ring \[NAME:[0-9a-f]{32}\] on \[PHONE:\d{5} \d{6}\]\.", m) and masked[5].masked.endswith(m)
    assert find_personal(df.limit(0), lists).count() == 0
    assert mask("ab", [], None) == "ab"


def test_checked_numbers_stay_checked():
    """Values that pass their format's check get such values, one to one; dates get dates in their layout."""
    from corespar.llm.pii import _eleven, _social

    good = [f"{n:09d}" for n in range(10_000_000, 10_003_000) if _eleven(f"{n:09d}")]
    made = [pseudonym(v, "id_number", b"k") for v in good]
    assert all(_eleven(v) for v in made) and len(set(made)) == len(good)
    assert not _eleven(pseudonym("010000001", "id_number", b"k"))
    assert _social(pseudonym("123-45-6789", "id_number", b"k").replace("-", "")) and not _social(pseudonym("000-45-6789", "id_number", b"k").replace("-", ""))
    days = [f"{d:02d}.0{m}.1980" for d in range(1, 29) for m in range(1, 10)]
    fresh = [pseudonym(v, "date", b"k") for v in days]
    assert len(set(fresh)) == len(days) and all(re.fullmatch(r"\d\d\.\d\d\.(19|20)\d\d", v) for v in fresh)
    assert len(pseudonym("31.02.1980", "date", b"k")) == 32 and len(pseudonym("Jan Jansen", "name", b"k")) == 32
    finder = Finder(["Jan"], ["Jansen"], ["the"], dates=True)
    assert finder.spans("Jan Jansen, born on 03-04-1971, left on 05-06-2001.") == [("name", 0, 10), ("date", 20, 30)]


def test_held_out_texts():
    """Items in texts of other kinds than the test data's, and look-alikes that are none."""
    finder = Finder(["Maria", "Tom"], ["Okafor"], ["the", "after", "call"])
    for text, want in [
        ("Write to " + "a" * 200 + "@example.org today", [("email", 9, 221)]),
        ("Okonkwo, Maria signed", [("name", 0, 14)]),
        ("call Tom after the test", []),
        ("SSN 123-45-6789 was checked", [("id_number", 4, 15)]),
        ("the gauge 123-45-6789 was checked", []),
        ("meet at 12 Harbour Road, and 3 m below", [("address", 8, 23)]),
    ]:
        assert [x for x in finder.spans(text)] == want, text
