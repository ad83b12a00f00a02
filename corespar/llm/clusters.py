"""Problem 6: groups of mutually similar records.

Features are quantised to the cells of a grid: codebooks of unit vectors (a grid of intervals tells nothing in 96 dimensions). A
record stands in its own cell of each codebook and, as a guest, in the next nearest cells, so cells that touch share records; what one
codebook parts, another seldom does. Cells are counted; each links its records by their true similarity and gives out its dense groups as stars instead of pairs. Groups of touching cells that
share a record are joined by propagating the smallest label until none changes. The most typical members are those with the
most links in the cell in which a group is densest.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corespar.session import cut, stored
from corespar.tables import spread

from .cells import GUEST, HOME, hot_cells, in_parts
from .similar import same_rows
from .vectors import DIM, MOST_CELLS, SAMPLE, cell_count, fit_cells, nearest_cells, packed, sample, scaled, unpacked, unscaled, usable_rows

PART_ROWS = 32_768  # rows of one cell that one task compares at most, of either side
EDGE, MAYBE, DENSITY = 10, 11, 12  # a record and its group's first; a pair to verify; a record, its cell and its links there
OUT = "record_kind string, kind int, a bigint, b bigint, n int"
MET = "id bigint, payload binary, cells array<int>, other bigint"  # a record and its cells, or a copy and its first record (other)
WORDS = re.compile(r"[^\W_]+")
BUCKETS = 65_536
LEAST_ROWS = 128  # records for each cell: with fewer, the cells would part what belongs together
VECTOR_BOOKS, WORD_BOOKS = 2, 3


def _star(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest label of each connected part, by hooking and pointer jumping."""
    while True:
        low = np.minimum(labels[a], labels[b])
        new = labels.copy()
        np.minimum.at(new, labels[a], low)
        np.minimum.at(new, labels[b], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        new = new[labels]
        if np.array_equal(new, labels):
            return labels
        labels = new


def _cells_of(x: np.ndarray, books: list[np.ndarray], probes: int) -> np.ndarray:
    """The nearest cells in each codebook, numbered one codebook after the other."""
    return np.concatenate([nearest_cells(x, c, probes) + np.int32(k * len(c)) for k, c in enumerate(books)], axis=1)


def _placed(ids: np.ndarray, payload: pa.Array, cells: np.ndarray) -> pa.RecordBatch:
    offsets = pa.array(np.arange(len(ids) + 1, dtype=np.int32) * cells.shape[1])
    lists = pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(cells, np.int32).ravel()))
    return pa.RecordBatch.from_arrays([pa.array(ids), payload, lists, pa.nulls(len(ids), pa.int64())], names=["id", "payload", "cells", "other"])


def _equal(groups: list[np.ndarray], ids: np.ndarray):
    """The copies of a record within a batch and its first; only that one is placed."""
    copies = [ids[g] for g in groups if len(g) > 1]
    if copies:
        other = np.repeat([g[0] for g in copies], [len(g) - 1 for g in copies])
        a = np.concatenate([g[1:] for g in copies])
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.nulls(len(a), pa.binary()), pa.nulls(len(a), pa.list_(pa.int32())), pa.array(other)], names=["id", "payload", "cells", "other"])


def _place_vectors(books: list[np.ndarray], probes: int):
    def run(batches):
        for batch in batches:
            ids, x = usable_rows(batch.column(0), batch.column(1))
            if not len(ids):
                continue
            groups = same_rows(x, ids)
            yield from _equal(groups, ids)
            first = np.array([g[0] for g in groups])
            ids, x = ids[first], x[first]
            yield _placed(ids, packed(scaled(x)), _cells_of(x, books, probes))

    return run


def _link(record_kind: str, cell: int, counted: int, ids: np.ndarray, asks: np.ndarray, compare: Callable) -> pa.Table:
    """Stars, doubtful pairs and, in the `counted` cells of the first codebook, densities of one cell. compare(rows) gives (row, other, sure?) of those rows against all."""
    labels = np.arange(len(ids))
    order = np.argsort(ids, kind="stable")  # labels follow the ids, so the smallest label is the smallest id
    rank = np.empty_like(order)
    rank[order] = labels
    density = np.zeros(len(ids), np.int64)
    doubtful = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    own = np.flatnonzero(asks)
    for a in range(0, len(own), 128):
        r, d, sure = compare(own[a : a + 128])
        keep = ids[r] != ids[d]
        r, d, sure = r[keep], d[keep], sure[keep]
        density += np.bincount(r[sure], minlength=len(ids))
        apart = labels[rank[r]] != labels[rank[d]]  # the others are connected already
        labels = _star(labels, rank[r[sure & apart]], rank[d[sure & apart]])
        doubtful.append((r[~sure & apart], d[~sure & apart]))
    root = ids[order[labels[rank]]]
    r, d = (np.concatenate(z) for z in zip(*doubtful))
    open_ = root[r] != root[d]
    r, d = r[open_], d[open_]
    linked, dense = root != ids, asks & (density > 0) & (cell < counted)
    a = np.concatenate([ids[linked], ids[r], ids[dense]])
    n = len(a)
    return pa.table(
        {
            "record_kind": pa.array(np.full(n, record_kind)),
            "kind": pa.array(np.repeat([EDGE, MAYBE, DENSITY], [linked.sum(), len(r), dense.sum()]).astype(np.int32)),
            "a": pa.array(a),
            "b": pa.array(np.concatenate([root[linked], ids[d], np.full(dense.sum(), cell, np.int64)])),
            "n": pa.array(np.concatenate([np.zeros(linked.sum() + len(r), np.int64), density[dense]]).astype(np.int32)),
        }
    )


def _link_vectors(least: float, counted: int, slack: float = 0.006):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, x = table.column("id").to_numpy(), unscaled(unpacked(table.column("payload"), np.int8, DIM + 4))
        asks, kept = (table.column(c).to_numpy(zero_copy_only=False) for c in ("asks", "kept"))
        others = np.flatnonzero(kept)
        y = np.ascontiguousarray(x[others].T)

        def compare(rows):
            s = x[rows] @ y
            r, d = np.divmod(np.flatnonzero(s >= least - slack), s.shape[1])
            return rows[r], others[d], s[r, d] >= least + slack

        return _link("element", table.column("cell")[0].as_py(), counted, ids, asks, compare)

    return run


# --- sets of words


def word_set(text: str) -> set[str]:
    return set(WORDS.findall(text.lower()))


def _sets(batch: pa.RecordBatch, least_words: int, known: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, the different words' buckets one after the other, and where each record's begin (and the end)."""
    ids, flat, starts = [], [], [0]
    if len(known) > 1_000_000:
        known.clear()
    for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        words = word_set(text)
        if len(words) >= least_words:
            try:
                buckets = {known[w] for w in words}
            except KeyError:
                for w in [w for w in words if w not in known]:  # a set less the keys would go through all keys
                    known[w] = zlib.crc32(w.encode("utf-8", "surrogatepass")) % BUCKETS
                buckets = {known[w] for w in words}
            ids.append(i)
            flat += sorted(buckets)
            starts.append(len(flat))
    return np.array(ids, np.int64), np.array(flat, np.uint16), np.array(starts, np.int64)


def _packed_sets(least_words: int):
    """(id, words): the buckets of each text's words as two bytes each; texts with too few words are left out."""

    def run(batches):
        known: dict[str, int] = {}
        for batch in batches:
            ids, flat, starts = _sets(batch, least_words, known)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([flat[a:b].tobytes() for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())], pa.binary())], names=["id", "words"])

    return run


def _unpacked_sets(batch: pa.RecordBatch) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    raw = batch.column(1).to_pylist()
    starts = np.concatenate([[0], np.cumsum([len(w) // 2 for w in raw], dtype=np.int64)]).astype(np.int64)
    return batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), raw, np.frombuffer(b"".join(raw), np.uint16), starts


def _word_counts(batches):
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        total += np.bincount(_unpacked_sets(batch)[2], minlength=BUCKETS)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["bucket", "n"])


PLACE_DIM, PLACE_POWER = 256, 0.35  # for cells: wide, and rare words weigh little more, as in the share of common words
FOLD = 256  # columns on which the words of a cell are folded to bound what two records share


def _projection(weights: np.ndarray, dim: int = PLACE_DIM) -> np.ndarray:
    """A row of random signs for each bucket, times its weight."""
    out = np.random.default_rng(3).integers(0, 2, size=(BUCKETS, dim), dtype=np.int8).astype(np.float32)
    out *= 2
    out -= 1
    out *= weights[:, None]
    return out


def _features(flat: np.ndarray, starts: np.ndarray, weighted: np.ndarray) -> np.ndarray:
    """Unit vectors: signed random projections of the words."""
    out = np.zeros((len(starts) - 1, weighted.shape[1]), np.float32)
    for a in range(0, len(out), 512):
        part = starts[a : a + 513]
        out[a : a + 512] = np.add.reduceat(weighted[flat[part[0] : part[-1]]], part[:-1] - part[0], axis=0)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def _place_sets(books: list[np.ndarray], weights: np.ndarray, probes: int):
    def run(batches):
        wide = _projection(weights**PLACE_POWER)
        for batch in batches:
            ids, raw, flat, starts = _unpacked_sets(batch)
            if not len(ids):
                continue
            same: dict[bytes, list[int]] = {}
            for row in np.argsort(ids, kind="stable").tolist():
                same.setdefault(raw[row], []).append(row)
            groups = [np.array(g) for g in same.values()]
            yield from _equal(groups, ids)
            first = np.array([int(g[0]) for g in groups])
            cells = _cells_of(_features(flat, starts, wide), books, probes)[first]
            yield _placed(ids[first], pa.array([raw[row] for row in first.tolist()], pa.binary()), cells)

    return run


def _as_bits(columns: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Each record's columns as bits."""
    out = np.zeros((len(starts) - 1, -(-max(1, width) // 64) * 8), np.uint8)
    rows = np.repeat(np.arange(len(out)), np.diff(starts))
    np.bitwise_or.at(out, (rows, columns >> 3), (1 << (columns & 7)).astype(np.uint8))
    return out.view(np.uint64)


def _bits(flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each record's words as bits over the words of its cell, and over FOLD columns: half for the most frequent words, half shared by the others."""
    count = np.bincount(flat, minlength=BUCKETS)
    present = np.flatnonzero(count)
    number = np.empty(BUCKETS, np.int64)
    number[present] = np.arange(len(present))
    local = number[flat]
    place = np.empty(len(present), np.int64)
    place[np.argsort(-count[present], kind="stable")] = np.arange(len(present))
    column = np.where(place < FOLD // 2, place, FOLD // 2 + place % (FOLD // 2))
    return _as_bits(local, starts, len(present)), _as_bits(column[local], starts, FOLD)


def _link_sets(least: float, counted: int, slack: float = 0.03):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, payload = table.column("id").to_numpy(), table.column("payload").to_pylist()
        starts = np.concatenate([[0], np.cumsum([len(p) // 2 for p in payload])]).astype(np.int64)
        bits, folded = _bits(np.frombuffer(b"".join(payload), np.uint16), starts)
        size = np.diff(starts)
        # Two records share at most the columns both have and the lesser of what they have beyond one word in each of their columns.
        # A share of `least` takes least / (1 + least) of the sum of their sizes.
        beyond = (size - np.bitwise_count(folded).sum(axis=1, dtype=np.int64)).astype(np.int32)
        part = np.floor((least - slack) / (1 + least - slack) * size).astype(np.int32)
        columns = np.ascontiguousarray(folded.T)
        asks, kept = (table.column(c).to_numpy(zero_copy_only=False) for c in ("asks", "kept"))
        others = np.flatnonzero(kept)

        def compare(rows):
            out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))]
            for a in range(0, len(rows), 64):
                own = rows[a : a + 64, None]
                for b in range(0, len(others), 2048):
                    other = others[None, b : b + 2048]
                    need = part[own] + part[other]
                    need -= np.minimum(beyond[own], beyond[other])
                    shared = np.zeros(need.shape, np.int16)
                    for column in columns:
                        shared += np.bitwise_count(column[own] & column[other])
                    r, d = np.nonzero(shared >= need)
                    r, d = own[r, 0], other[0, d]
                    both = np.concatenate([np.zeros(0, np.int64), *(np.bitwise_count(bits[r[c : c + 16_384]] & bits[d[c : c + 16_384]]).sum(axis=1, dtype=np.int64) for c in range(0, len(r), 16_384))])
                    jaccard = both / (size[r] + size[d] - both)
                    keep = jaccard >= least - slack
                    out.append((r[keep], d[keep], jaccard[keep] >= least + slack))
            return tuple(np.concatenate(z) for z in zip(*out))

        return _link("chunk", table.column("cell")[0].as_py(), counted, ids, asks, compare)

    return run


# --- doubtful pairs, by the full records


def _cosines(batches):
    for batch in batches:
        a, b = unpacked(batch.column(2), np.float32, DIM), unpacked(batch.column(3), np.float32, DIM)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.einsum("nd,nd->n", a.astype(np.float64), b.astype(np.float64)))], names=["a", "b", "score"])


def _jaccards(batches):
    for batch in batches:
        score = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            x, y = word_set(x), word_set(y)
            score.append(len(x & y) / max(1, len(x | y)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.float64())], names=["a", "b", "score"])


def _unit(batches):
    for batch in batches:
        i, x = usable_rows(batch.column(0), batch.column(1))
        yield pa.RecordBatch.from_arrays([pa.array(i), packed(x)], names=["id", "value"])


def _verified(pairs: DataFrame, full: DataFrame, score, least: float) -> DataFrame:
    """The pairs (a, b) whose full records (id, value) reach the least score."""
    pairs = stored(pairs)
    needed = stored(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    values = cut(full.join(needed, "id", "left_semi"))
    met = pairs.join(values.select(F.col("id").alias("a"), F.col("value").alias("va")), "a").join(values.select(F.col("id").alias("b"), F.col("value").alias("vb")), "b")
    return met.select("a", "b", "va", "vb").mapInArrow(score, "a bigint, b bigint, score double").where(F.col("score") >= least).select("a", "b")


def smallest_labels(edges: DataFrame) -> DataFrame:
    """(record_kind, id, label): every record with an edge (record_kind, a, b) and the smallest id it is connected to.

    Each round takes the smallest label of the neighbours and then the label of that label, until a round changes nothing.
    """
    both = stored(edges.select("record_kind", "a", "b").union(edges.select("record_kind", "b", "a")).where("a != b").distinct())
    labels = cut(both.groupBy("record_kind", F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("label")))
    while True:
        seen = both.join(labels.select("record_kind", F.col("id").alias("b"), "label"), ["record_kind", "b"]).groupBy("record_kind", F.col("a").alias("id")).agg(F.min("label").alias("seen"))
        stepped = labels.join(seen, ["record_kind", "id"]).select("record_kind", "id", F.col("label").alias("old"), F.least("label", "seen").alias("label"))
        jump = labels.select("record_kind", F.col("id").alias("label"), F.col("label").alias("next"))
        new = cut(stepped.join(jump, ["record_kind", "label"], "left").select("record_kind", "id", "old", F.least("label", F.coalesce("next", "label")).alias("label")))
        if new.where("old != label").limit(1).count() == 0:
            return new.drop("old")
        labels = new.drop("old")


def _books(sampled: np.ndarray, total: int, wider: int, books: int) -> list[np.ndarray]:
    """Codebooks that part the records differently: `wider` times the usual number of cells, as long as a cell has a hundred records.

    What a record is compared with and the cells it is compared to for its place both grow as the root of the records.
    """
    cells = min(MOST_CELLS, wider * cell_count(total), max(2 * cell_count(1), total // LEAST_ROWS))
    return [fit_cells(sampled, cells, rounds=3, seed=7 + k) for k in range(books)]


def _in_cells(met: DataFrame, record_kind: str, probes: int, link) -> DataFrame:
    """What each cell says of its records, cells too large for a task in parts, and the copies. probes: cells of a record in one codebook."""
    placed = met.where("other is null").select(F.posexplode("cells").alias("pos", "cell"), "id", "payload").select("cell", F.when(F.col("pos") % probes == 0, HOME).otherwise(GUEST).alias("kind"), "id", "payload")
    sizes = placed.select("cell", (F.col("kind") == HOME).cast("long").alias("homes"), (F.col("kind") == GUEST).cast("long").alias("guests"))
    copies = met.where("other is not null").select(F.lit(record_kind).alias("record_kind"), F.lit(EDGE).alias("kind"), F.col("id").alias("a"), F.col("other").alias("b"), F.lit(0).alias("n"))
    return in_parts(placed, hot_cells(sizes, PART_ROWS, PART_ROWS)).groupBy("cell", "part").applyInArrow(link, OUT).unionByName(copies)


def _open(found: DataFrame) -> DataFrame:
    """The pairs to verify, each once, whichever codebooks found it."""
    return found.where(F.col("kind") == MAYBE).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def vector_links(df: DataFrame, id_col: str, vector_col: str, least: float, probes: int, books: int = VECTOR_BOOKS) -> DataFrame:
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")).where("id is not null and vector is not null")
    total = rows.count()
    fitted = _books(sample(rows, "id", "vector", total), total, 16, books)
    met = stored(spread(rows).mapInArrow(_place_vectors(fitted, probes), MET))
    found = cut(_in_cells(met, "element", min(probes, len(fitted[0])), _link_vectors(least, len(fitted[0]))))
    sure = _verified(_open(found), rows.mapInArrow(_unit, "id bigint, value binary"), _cosines, least)
    return found.where(F.col("kind") != MAYBE).unionByName(sure.select(F.lit("element").alias("record_kind"), F.lit(EDGE).alias("kind"), "a", "b", F.lit(0).alias("n")))


def word_links(df: DataFrame, id_col: str, text_col: str, least: float, least_words: int, probes: int, books: int = WORD_BOOKS) -> DataFrame:
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    sets = stored(spread(rows).mapInArrow(_packed_sets(least_words), "id bigint, words binary"))
    counts = sets.mapInArrow(_word_counts, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # at most BUCKETS rows
    weights = np.zeros(BUCKETS, np.float32)
    total = sets.count()
    for r in counts:
        weights[r["bucket"]] = np.log((total + 1) / (r["n"] + 0.5))
    weights = np.maximum(weights, 0)
    share = min(1_000_000, int(1_000_000 * 1.1 * SAMPLE / max(1, total)) + 1)
    taken = sets.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share).limit(2 * SAMPLE).toArrow()
    wide = _projection(weights**PLACE_POWER)
    sampled = np.concatenate([np.zeros((0, PLACE_DIM), np.float32), *(_features(*_unpacked_sets(b)[2:], wide) for b in taken.to_batches())])[:SAMPLE]
    fitted = _books(sampled, total, 32, books)  # word sets cost more to compare than vectors: narrower cells, more of them
    met = stored(spread(sets).mapInArrow(_place_sets(fitted, weights, probes), MET))
    found = cut(_in_cells(met, "chunk", min(probes, len(fitted[0])), _link_sets(least, len(fitted[0]))))
    sure = _verified(_open(found), rows.select("id", F.col("text").alias("value")), _jaccards, least)
    return found.where(F.col("kind") != MAYBE).unionByName(sure.select(F.lit("chunk").alias("record_kind"), F.lit(EDGE).alias("kind"), "a", "b", F.lit(0).alias("n")))


def similarity_clusters(elements: DataFrame, chunks: DataFrame, least_cosine: float = 0.80, least_jaccard: float = 0.5, least_words: int = 30, least_size: int = 5, typical: int = 3, probes: int = 4, word_probes: int = 4) -> DataFrame:
    """(record_kind, record_id, cluster_id, size, links, typical_rank): members of groups of at least `least_size` linked records.

    Elements are linked by the cosine of usable vectors, chunks by the share of their common words, directly or through others;
    cluster_id is the smallest id of the group. typical_rank is 1 to `typical` for the members with the most links among those
    of the cell that holds most of the group's members with links (the smaller cell, then the smaller id among equals), and null for
    the others. Null and unusable vectors, null texts and texts with fewer different words are in no group; copies are linked to
    their first. Empty tables give an empty result. Links are checked on the records themselves; a link is lost if the two records
    share no cell (README: measured recall).
    """
    spark = elements.sparkSession
    links = stored(vector_links(elements, "element_id", "embedding", least_cosine, probes).unionByName(word_links(chunks, "chunk_id", "text", least_jaccard, least_words, word_probes)))
    labels = stored(smallest_labels(links.where(F.col("kind") == EDGE)))
    return spark.sql(
        """
        WITH sizes AS (SELECT record_kind, label, count(*) AS size FROM {labels} GROUP BY record_kind, label HAVING count(*) >= {least_size}),
        density AS (SELECT record_kind, a AS id, b AS cell, sum(n) AS links FROM {links} WHERE kind = {density} GROUP BY record_kind, a, b),
        members AS (SELECT l.record_kind, l.id, l.label, s.size, d.cell, coalesce(d.links, 0) AS links
            FROM {labels} l JOIN sizes s ON l.record_kind = s.record_kind AND l.label = s.label LEFT JOIN density d ON l.record_kind = d.record_kind AND l.id = d.id),
        cells AS (SELECT record_kind, label, cell, count(*) AS n FROM members WHERE cell IS NOT NULL GROUP BY record_kind, label, cell),
        densest AS (SELECT record_kind, label, max_by(cell, struct(n, -cell)) AS cell FROM cells GROUP BY record_kind, label),
        inside AS (SELECT m.record_kind, m.id, row_number() OVER (PARTITION BY m.record_kind, m.label ORDER BY m.links DESC, m.id) AS typical_rank
            FROM members m JOIN densest c ON m.record_kind = c.record_kind AND m.label = c.label AND m.cell = c.cell)
        SELECT m.record_kind, m.id AS record_id, m.label AS cluster_id, m.size, m.links, i.typical_rank
        FROM members m LEFT JOIN (SELECT * FROM inside WHERE typical_rank <= {typical}) i ON m.record_kind = i.record_kind AND m.id = i.id
        """,
        labels=labels, links=links, least_size=least_size, density=DENSITY, typical=typical,
    )
