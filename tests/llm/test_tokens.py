"""Problems 8 and 9."""

import os
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corespar.llm.encode import PIECES, VOCABULARY, Encoder, encode_texts, read_ranks
from corespar.llm.mixing import CYCLE, mix_sources, mixture_shares, pfair, schedule, source_quotas

pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary files")


@pytest.fixture(scope="module")
def tools():
    import tiktoken

    ranks = read_ranks()
    return Encoder(ranks), tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})


def ids_of(encoder, texts):
    return [[i for p in pieces for i in encoder.known[p]] for pieces in encoder.pieces(texts)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text("aab .<|>endoftx\n0123é", max_size=60)), max_size=6))
def test_equals_the_library(tools, texts):
    encoder, library = tools
    texts = [t for t in texts if "\ud800" > max(t, default=" ") or max(t, default=" ") > "\udfff"]
    assert ids_of(encoder, texts) == [library.encode_ordinary(t) for t in texts]


def test_long_pieces(tools):
    encoder, library = tools
    texts = ["a" * 5000, "ab" * 3000, "0" * 2000, "<|endoftext|>", " \n\n  x", "Ünïcödé 😀"]
    assert ids_of(encoder, texts) == [library.encode_ordinary(t) for t in texts]


def test_on_spark(spark, tools):
    rows = [(1, "The pump failed.", "x", 1), (2, "", "x", 1), (3, None, "x", 1), (4, "The pump failed.", "x", 1), (5, "word " * 100_000, "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, id int")
    got = {r.doc_id: r.ids for r in encode_texts(df).collect()}
    assert got == {i: tools[1].encode_ordinary(t or "") for i, t, *_ in rows}
    counts = {r.doc_id: r.n_tokens for r in encode_texts(df, count_only=True).collect()}
    assert counts == {i: len(v) for i, v in got.items()}
    assert encode_texts(df.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 90), min_size=1, max_size=8))
def test_pfair_stays_within_a_block(counts):
    plan, done = pfair(counts), Counter()
    assert Counter(i for i, _ in plan) == {i: n for i, n in enumerate(counts) if n}
    for slot, (i, j) in enumerate(plan):
        assert j == done[i]
        done[i] += 1
        assert all(abs(done[x] - n * (slot + 1) / sum(counts)) < 1 for x, n in enumerate(counts))


def test_cycles_follow_the_shares(spark):
    """Over many cycles each block has one slot and no source is two blocks off; at the ends of cycles not even one."""
    blocks = {"a": 9_000, "b": 4_321, "c": 77, "d": 1, "none": 0}
    total = sum(blocks.values())
    plan = sorted(schedule(spark, blocks).collect(), key=lambda r: r.slot)
    assert [r.slot for r in plan] == list(range(total))
    done = Counter()
    for r in plan:
        assert r.block == done[r.source]
        done[r.source] += 1
        off = max(abs(done[s] - n * (r.slot + 1) / total) for s, n in blocks.items())
        assert off < (1 if (r.slot + 1) % CYCLE == 0 else 2)
    assert schedule(spark, {}).count() == 0


def test_quotas():
    q = source_quotas({"a": 100, "b": 1000}, {"a": (0.5, 2), "b": (0.3, 1), "c": (0.2, 3)})
    assert q["a"]["weight"] == pytest.approx(0.625) and q["a"]["tokens"] == 200 and q["b"]["tokens"] == 120
    assert source_quotas({}, {"a": (1.0, 1)}) == {}
    assert source_quotas({"a": 100}, {"a": (1.0, 2)}, 1000)["a"]["tokens"] == 200


def test_mixture(spark):
    rows = [(i, f"record number {i} about the pump and the valve", "big") for i in range(400)] + [(1000 + i, f"small record {i} of the other kind", "small") for i in range(12)]
    rows += [(5000, None, "big"), (5001, "", "small"), (5002, "no source", None), (5003, "not wanted", "other"), (5004, "record number 1 about the pump and the valve", "big")]
    docs = spark.createDataFrame([(*r, 7, 8) for r in rows], "doc_id long, text string, source string, slot int, h long")
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.3, 5), ("none", 0.1, 2)], "source string, target_share double, max_repeats int")
    mixture = mix_sources(docs, targets)
    got = mixture.collect()
    uses = Counter(r.doc_id for r in got)
    assert all(uses[r.doc_id] <= (5 if r.source == "small" else 1) for r in got) and {r.source for r in got} == {"big", "small"}
    shares = {r.source: r for r in mixture_shares(mixture, targets).collect()}
    assert shares["big"].actual_share == pytest.approx(2 / 3, abs=0.03) and shares["small"].most_uses == 5 and shares["none"].tokens == 0
    assert mix_sources(docs.limit(0), targets).count() == 0
