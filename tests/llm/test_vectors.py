"""Problems 1 and 6 against brute force, and on odd input."""

import numpy as np
import pyarrow as pa
import pytest

from corespar.llm.clusters import DENSITY, similarity_clusters, smallest_labels, word_links
from corespar.llm.similar import TABLE_SLACK, _search, similar_pairs, similar_vectors
from corespar.llm.vectors import DIM, FourBitCode, cell_count, packed, sample

SCHEMA = "element_id long, embedding array<float>, rank int, id long, vector string"  # the last three clash with inner names


def cloud(seed, n, topics=12, noise=0.08):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(topics, DIM))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    return (centres[rng.integers(topics, size=n)] + noise * rng.normal(size=(n, DIM))).astype(np.float32)


def frame(spark, x, ids=None, extra=()):
    rows = [(int(i), [float(v) for v in r], 1, 2, "x") for i, r in zip(ids if ids is not None else range(len(x)), x)]
    return spark.createDataFrame([*rows, *extra], SCHEMA)


ODD = [(9001, None, 1, 1, None), (9002, [0.0] * DIM, 1, 1, None), (9003, [1.0] * 64, 1, 1, None), (9004, [float("nan")] * DIM, 1, 1, None), (9005, [float("inf")] + [1.0] * (DIM - 1), 1, 1, None), (9006, [None] + [1.0] * (DIM - 1), None, None, None), (None, [1.0] * DIM, 1, 1, None)]


def unit(x):
    x = x.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_recall_and_exact_cosines(spark):
    x = cloud(1, 1500)
    got = similar_vectors(frame(spark, x, extra=ODD)).collect()
    u = unit(x)
    g = u @ u.T
    np.fill_diagonal(g, -2)
    by = {}
    for r in got:
        assert r.cosine == pytest.approx(g[r.id, r.neighbour_id], abs=1e-6)
        by.setdefault(r.id, set()).add(r.neighbour_id)
    assert set(by) == set(range(1500)) and all(len(v) == 10 for v in by.values())
    tenth = np.sort(g, axis=1)[:, -10]
    hits = sum((g[i, list(v)] >= tenth[i] - 1e-9).sum() for i, v in by.items())
    assert hits / 15000 >= 0.9


def test_pairs_equal_brute_force(spark):
    x = cloud(2, 800, topics=200, noise=0.03)
    u = unit(x)
    g = u @ u.T
    np.fill_diagonal(g, -2)
    want = set()
    for i in range(800):
        for j in sorted(range(800), key=lambda j: (-g[i, j], j))[:10]:
            if g[i, j] >= 0.9:
                want.add((min(i, j), max(i, j)))
    got = {tuple(r) for r in similar_pairs(frame(spark, x, extra=ODD)).collect()}
    assert len(want & got) >= 0.99 * len(want) and not {p for p in got if g[p] < 0.9 - 1e-6}


def test_copies_of_a_third(spark):
    """A vector that a third of all rows share: ten neighbours each, the smallest other ids, no more rows than ten times the input."""
    x = cloud(3, 300)
    x[::3] = x[0]
    got = {}
    for r in similar_vectors(frame(spark, x)).collect():
        got.setdefault(r.id, []).append((r.rank, r.neighbour_id, r.cosine))
    assert all(len(v) == 10 for v in got.values())
    assert [n for _, n, _ in sorted(got[0])] == [3, 6, 9, 12, 15, 18, 21, 24, 27, 30]
    assert [n for _, n, _ in sorted(got[6])] == [0, 3, 9, 12, 15, 18, 21, 24, 27, 30]
    assert all(c == pytest.approx(1) for _, _, c in got[0])


def test_tiny_and_empty(spark):
    assert similar_vectors(frame(spark, np.zeros((0, DIM)), extra=ODD)).count() == 0
    assert similar_pairs(frame(spark, np.zeros((0, DIM)))).count() == 0
    two = similar_vectors(frame(spark, cloud(4, 2))).collect()
    assert sorted((r.id, r.neighbour_id) for r in two) == [(0, 1), (1, 0)]
    same = similar_pairs(frame(spark, np.repeat(cloud(5, 1), 3, axis=0), ids=[7, 5, 9])).collect()
    assert sorted(tuple(r) for r in same) == [(5, 7), (5, 9), (7, 9)]


def test_four_bit_code():
    x = unit(cloud(6, 600)).astype(np.float32)
    plain = FourBitCode.fit(x, threshold=0.0)
    aware = FourBitCode.fit(x, threshold=0.3)
    codes = aware.encode(x)
    assert (FourBitCode.from_nibbles(FourBitCode.nibbles(codes)) == codes).all() and codes.max() < 16
    parallel = lambda c: np.abs(((x - c.decode(c.encode(x))) * x).sum(axis=1)).mean()
    assert parallel(aware) < parallel(plain)  # the residual along the vector is what the loss punishes


def test_table_scan_gives_the_dot_products():
    x = unit(cloud(16, 3000)).astype(np.float32)
    code = FourBitCode.fit(x)
    words = code.encode(x)
    asked = x[:70]
    tables, base, step = code.tables(asked)
    columns = np.ascontiguousarray(FourBitCode.nibbles(words).T).astype(np.intp)
    got = base + step * FourBitCode.scan(tables, columns, block=500).astype(np.float64)
    assert np.abs(got - code.decode(words) @ asked.T).max() < TABLE_SLACK
    assert tables.dtype == np.uint16 and tables.shape == (24, 256, 70)


def test_what_is_compared_does_not_hang_on_the_block(spark):
    """The same question in the company of others has the same neighbours."""
    x = cloud(17, 700, topics=5, noise=0.02)  # crowded: many rows lie closer together than codes tell
    code = FourBitCode.fit(unit(x).astype(np.float32))
    table = lambda order: _cell(unit(x).astype(np.float32)[order], np.asarray(order), code)
    run = _search(code, 10, None)
    one, two = (run(table(o)).to_pandas() for o in (list(range(700)), list(reversed(range(700)))))
    a, b = ({(r.q, r.d) for r in f.itertuples()} for f in (one, two))
    assert a == b and len(a) == 7000
    g = unit(x) @ unit(x).T
    np.fill_diagonal(g, -2)
    tenth = np.sort(g, axis=1)[:, -10]
    assert sum(g[q, d] >= tenth[q] - 1e-6 for q, d in a) >= 0.995 * 7000


def _cell(x, ids, code):
    words = code.encode(x)
    rest = x - code.decode(words)
    facts = np.stack([(x * rest).sum(axis=1), np.linalg.norm(rest, axis=1)], axis=1).astype(np.float32)
    coded = packed(np.concatenate([FourBitCode.nibbles(words), facts.view(np.uint8)], axis=1))
    yes = pa.array(np.ones(len(x), bool))
    return pa.table({"kind": pa.array(np.zeros(len(x), np.int32)), "id": pa.array(ids.astype(np.int64)), "vector": packed(x), "code": coded, "asks": yes, "kept": yes})


def components(pairs, ids, least=5):
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    groups = {}
    for i in ids:
        groups.setdefault(find(i), []).append(i)
    return {(i, r) for r, g in groups.items() if len(g) >= least for i in g}


CHUNKS = "chunk_id long, text string, label string, n int"


def texts(seed, n):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        base = np.random.default_rng(1000 + i % 25).choice(600, 45, replace=False)
        words = [f"w{w}" for w in base]
        for k in rng.choice(45, rng.integers(0, 12), replace=False):
            words[k] = f"v{rng.integers(2000)}"
        out.append(" ".join(words))
    return out


def test_clusters_equal_brute_force(spark):
    x = cloud(7, 500, topics=40, noise=0.045)
    u = unit(x)
    pairs = list(zip(*np.nonzero(np.triu(u @ u.T >= 0.8, 1))))
    want = {("element", int(i), int(c)) for i, c in components(pairs, range(500))}
    t = texts(8, 300)
    sets = [set(s.split()) for s in t]
    links = [(i, j) for i in range(300) for j in range(i + 1, 300) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.5]
    want |= {("chunk", i, c) for i, c in components(links, range(300))}
    chunks = spark.createDataFrame([(i, s, "l", 1) for i, s in enumerate(t)] + [(900, None, None, None), (901, "", "l", 1), (902, "few words", "l", 1), (903, "long " * 100_000, "l", 1)], CHUNKS)
    found = similarity_clusters(frame(spark, x, extra=ODD), chunks).collect()
    assert {(r.record_kind, r.record_id, r.cluster_id) for r in found} == want
    for key in {(r.record_kind, r.cluster_id) for r in found}:
        group = [r for r in found if (r.record_kind, r.cluster_id) == key]
        assert all(r.size == len(group) for r in group)
        assert sorted(r.typical_rank for r in group if r.typical_rank) == [1, 2, 3]


def test_clusters_of_copies_and_empty(spark):
    x = np.repeat(cloud(9, 1), 40, axis=0)
    none = spark.createDataFrame([], CHUNKS)
    got = similarity_clusters(frame(spark, x, ids=range(10, 50)), none).collect()
    assert len(got) == 40 and {r.cluster_id for r in got} == {10}
    assert similarity_clusters(frame(spark, np.zeros((0, DIM))), none).count() == 0


def test_label_propagation_on_a_path(spark):
    edges = spark.createDataFrame([("k", i + 1, i) for i in range(1, 60)] + [("k", 101, 100), ("j", 5, 5)], "record_kind string, a long, b long")
    got = {r.id: r.label for r in smallest_labels(edges).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 100: 100, 101: 100}


def test_hot_cells_are_cut_into_parts(spark, monkeypatch):
    """With small parts every cell is cut on both sides; results stay those of brute force."""
    from corespar.llm import clusters, similar

    monkeypatch.setattr(similar, "PART_ROWS", 16)
    monkeypatch.setattr(similar, "PART_ASKS", 8)
    monkeypatch.setattr(clusters, "PART_ROWS", 16)
    x = cloud(11, 400, topics=30, noise=0.045)
    x[::4] = x[0] + 0.002 * np.random.default_rng(1).normal(size=x[::4].shape).astype(np.float32)
    u = unit(x)
    g = u @ u.T
    pairs = list(zip(*np.nonzero(np.triu(g >= 0.8, 1))))
    chunks = spark.createDataFrame([(i, s, "l", 1) for i, s in enumerate(texts(12, 200))], CHUNKS)
    sets = [set(s.split()) for s in texts(12, 200)]
    links = [(i, j) for i in range(200) for j in range(i + 1, 200) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.5]
    want = {("element", int(i), int(c)) for i, c in components(pairs, range(400))} | {("chunk", i, c) for i, c in components(links, range(200))}
    assert {(r.record_kind, r.record_id, r.cluster_id) for r in similarity_clusters(frame(spark, x), chunks).collect()} == want
    np.fill_diagonal(g, -2)
    got = {}
    for r in similar_vectors(frame(spark, x)).collect():
        got.setdefault(r.id, []).append(r.neighbour_id)
    tenth = np.sort(g, axis=1)[:, -10]
    assert all(len(set(v)) == 10 for v in got.values())
    assert sum((g[i, v] >= tenth[i] - 2e-3).sum() for i, v in got.items()) / 4000 >= 0.9
    found = {tuple(r) for r in similar_pairs(frame(spark, x)).collect()}
    assert found and all(g[p] >= 0.9 - 1e-6 for p in found)


def test_pairs_of_a_near_identical_hot_group(spark):
    """Vectors that differ by less than codes and bytes tell, in one cell: the pairs are still those of brute force."""
    x = np.concatenate([cloud(13, 1, noise=0) + 0.0015 * np.random.default_rng(5).normal(size=(700, DIM)).astype(np.float32), cloud(14, 100)])
    g = unit(x) @ unit(x).T
    np.fill_diagonal(g, -2)
    want = {(min(i, j), max(i, j)) for i in range(len(x)) for j in np.argsort(-g[i], kind="stable")[:10].tolist() if g[i, j] >= 0.9}
    got = {tuple(r) for r in similar_pairs(frame(spark, x), probes=64).collect()}  # all cells are probed: only codes and bytes could lose pairs
    assert len(want ^ got) <= 0.002 * len(want)


def test_chunks_of_a_template_are_linked(spark):
    """Words that many chunks share count as much as rare ones: every pair of the template's chunks is a link."""
    rng = np.random.default_rng(15)
    template = [f"t{i}" for i in range(32)]
    texts_ = [" ".join(template + [f"r{w}" for w in rng.choice(3000, 12, replace=False)]) for _ in range(60)]
    texts_ += [" ".join(f"o{w}" for w in rng.choice(3000, 44, replace=False)) for _ in range(120)]
    chunks = spark.createDataFrame([(i, s, "l", 1) for i, s in enumerate(texts_)], CHUNKS)
    found = similarity_clusters(frame(spark, np.zeros((0, DIM))), chunks).collect()
    assert {(r.record_id, r.cluster_id, r.size) for r in found} == {(i, 0, 60) for i in range(60)}
    links = word_links(chunks, "chunk_id", "text", 0.5, 30, 10).where(f"kind = {DENSITY}").collect()
    assert {r.a: r.n for r in links}.keys() == set(range(60)) and all(r.n >= 59 for r in links)


def test_bounds_of_what_is_fitted(spark):
    """The sample has its bound, however many rows there are; cells follow the square root of the rows up to theirs."""
    df = frame(spark, cloud(18, 3000))
    assert len(sample(df.select("element_id", "embedding"), "element_id", "embedding", 3000, bound=500)) == 500
    assert [cell_count(n) for n in (0, 24_000, 212_000, 10**9, 10**15)] == [8, 8, 32, 2048, 16_384]


def test_typical_members_come_from_the_densest_cell(spark):
    rng = np.random.default_rng(19)
    centre = rng.normal(size=DIM)
    x = np.concatenate([centre + 0.02 * rng.normal(size=(30, DIM)), centre + 0.45 * rng.normal(size=(10, DIM))]).astype(np.float32)
    got = similarity_clusters(frame(spark, x), spark.createDataFrame([], CHUNKS), probes=64).collect()
    typical = [r for r in got if r.typical_rank]
    assert {r.record_id for r in typical} <= set(range(30)) and [r.links for r in sorted(typical, key=lambda r: r.typical_rank)] == sorted((r.links for r in typical), reverse=True)


def test_cells_of_large_tables_stay_small():
    """At 6 GB a record meets a few thousand others in its cells, and several codebooks make up for narrow cells; few rows stay in few cells."""
    from corespar.llm.clusters import _books

    x = unit(np.random.default_rng(23).normal(size=(6000, 16)).astype(np.float32))
    for rows, wider, books in ((9_600_000, 16, 2), (6_000_000, 32, 3)):
        fitted = _books(x, rows, wider, books)
        assert len(fitted) == books and not np.array_equal(fitted[0], fitted[1]) and all(rows / len(c) <= 2500 for c in fitted)
    assert [len(_books(x, n, 32, 1)[0]) for n in (10, 2000, 15_000)] == [16, 16, 117]


def test_new_words_are_looked_up_one_by_one():
    """A text with a new word costs its own words, not all words known so far."""
    import pyarrow as pa

    from corespar.llm.clusters import _sets

    class Known(dict):
        def keys(self):
            raise AssertionError("all known words")

        __iter__ = keys

    batch = pa.RecordBatch.from_pydict({"id": [1, 2], "text": ["a b c", "b c d"]})
    ids, flat, starts = _sets(batch, 3, Known())
    assert ids.tolist() == [1, 2] and starts.tolist() == [0, 3, 6] and len(set(flat.tolist())) == 4
