"""Problem 1: the k most similar vectors of every vector.

Coarse cells (a codebook fitted on a bounded sample) decide where vectors meet: each asks in its nearest cell and is searched for in
its `probes` nearest cells. In a cell the anisotropic four-bit codes are scanned by table lookups for a block of questions at once,
and what the codes don't rule out is ranked by the exact cosine in the same task: vectors are shuffled once, pairs never.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corespar.session import cut
from corespar.tables import spread

from .cells import GUEST, HOME, SIZES, hot_cells, in_parts, vector_cells
from .vectors import DIM, FourBitCode, cell_count, fit_cells, nearest_cells, packed, sample, unpacked, usable_rows

PROBES = 3
PART_ASKS, PART_ROWS = 16_384, 65_536  # rows of one cell that one task takes at most; a hotter cell is cut into parts
WINDOW_ROWS = 65_536  # rows of a partition among which copies are told
BLOCK = 64  # questions whose tables are scanned together
DEVIATIONS = 2.0  # of what a random residual adds to a score, in standard deviations
EQUAL = 5e-7
SINGLE = 1e-5  # most that a sum of single floats differs from the exact one
TABLE_SLACK = 2e-3  # most that whole table entries and single floats change a score

PLACED = "cell int, kind int, id bigint, vector binary, code binary, rep bigint"
MEMBER, SMALLEST = 2, 3
FOUND = "kind int, q bigint, d bigint, cosine double"


def same_rows(x: np.ndarray, ids: np.ndarray) -> list[np.ndarray]:
    """Rows with the same vector, each group in the order of the ids."""
    keys = np.ascontiguousarray(x).view(f"V{x.shape[1] * x.itemsize}").ravel()
    seen: dict[bytes, list[int]] = {}
    for row in np.argsort(ids, kind="stable").tolist():
        seen.setdefault(keys[row].tobytes(), []).append(row)
    return [np.array(rows) for rows in seen.values()]


def _rows(cell, kind: int, ids, vector, code, rep) -> pa.RecordBatch:
    n = len(ids)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.broadcast_to(np.asarray(cell, np.int32), n)),
            pa.array(np.full(n, kind, np.int32)),
            pa.array(ids),
            pa.nulls(n, pa.binary()) if vector is None else vector,
            pa.nulls(n, pa.binary()) if code is None else code,
            pa.nulls(n, pa.int64()) if rep is None else pa.array(rep),
        ],
        names=["cell", "kind", "id", "vector", "code", "rep"],
    )


def _windows(batches):
    """Usable rows of the batches, WINDOW_ROWS or a batch more at a time."""
    ids, xs, n = [], [], 0
    for batch in batches:
        i, x = usable_rows(batch.column(0), batch.column(1))
        if len(i):
            ids.append(i)
            xs.append(x)
            n += len(i)
        if n >= WINDOW_ROWS:
            yield np.concatenate(ids), np.concatenate(xs)
            ids, xs, n = [], [], 0
    if n:
        yield np.concatenate(ids), np.concatenate(xs)


def _to_cells(centroids: np.ndarray, code: FourBitCode, probes: int, k: int):
    def run(batches):
        for ids, x in _windows(batches):
            groups = same_rows(x, ids)
            shared = [ids[g] for g in groups if len(g) > 1]
            if shared:  # copies take no part in the search; the first stands for them
                yield _rows(-1, MEMBER, np.concatenate(shared), None, None, np.repeat([g[0] for g in shared], [len(g) for g in shared]))
                smallest = [g[: k + 1] for g in shared]
                yield _rows(-1, SMALLEST, np.concatenate(smallest), None, None, np.repeat([g[0] for g in smallest], [len(g) for g in smallest]))
            first = np.array([g[0] for g in groups])
            ids, x = ids[first], x[first]
            for a in range(0, len(ids), 8192):
                own, xi = ids[a : a + 8192], x[a : a + 8192]
                cells = nearest_cells(xi, centroids, probes)
                words = code.encode(xi)
                rest = xi - code.decode(words)
                # with the code go <x, rest> and |rest|, which tell how far a score can be from that of the code
                facts = np.stack([(xi * rest).sum(axis=1), np.linalg.norm(rest, axis=1)], axis=1).astype(np.float32)
                coded = packed(np.concatenate([FourBitCode.nibbles(words), facts.view(np.uint8)], axis=1))
                vectors = packed(xi)
                for j in range(cells.shape[1]):
                    yield _rows(cells[:, j], GUEST if j else HOME, own, vectors, coded, None)

    return run


def _above(score: np.ndarray, want: int) -> np.ndarray:
    """For each column (a question) a value that at least `want` rows reach, and not many more."""
    n = len(score)
    if n <= want:
        return np.zeros(score.shape[1], score.dtype)
    take = -(-want * 3 // 32) + 1  # of every sixteenth row, half as many again as their share
    part = score[::16]
    if len(part) > take:
        value = np.partition(part, -take, axis=0)[-take]
        few = np.flatnonzero(np.count_nonzero(score >= value, axis=0) < want)
    else:
        value, few = np.zeros(score.shape[1], score.dtype), np.arange(score.shape[1])
    if len(few):
        value[few] = np.partition(score[:, few], -want, axis=0)[-want]
    return value


def _cosines(x: np.ndarray, asked: np.ndarray, d: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Exact cosines of the pairs (d, r). Above 1 - EQUAL, what unit vectors in single floats differ from length one, vectors
    count as equal."""
    out = np.empty(len(d))
    for a in range(0, len(d), 4096):
        part = slice(a, a + 4096)
        out[part] = np.einsum("nd,nd->n", x[d[part]].astype(np.float64), asked[r[part]].astype(np.float64))
    return np.where(out > 1 - EQUAL, 1.0, np.round(out, 12))


def _singles(x: np.ndarray, asked: np.ndarray, d: np.ndarray, r: np.ndarray) -> np.ndarray:
    """The same to SINGLE, by sums of single floats; all at once where many are wanted."""
    if len(d) * 8 > len(x) * len(asked):
        return (x @ asked.T)[d, r]
    out = np.empty(len(d), np.float32)
    for a in range(0, len(d), 8192):
        part = slice(a, a + 8192)
        np.einsum("nd,nd->n", x[d[part]], asked[r[part]], out=out[part])
    return out


def _best(x: np.ndarray, asked: np.ndarray, d: np.ndarray, r: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k pairs (d, r) of each question r with the largest exact cosine, the smaller id first among equals."""
    single = _singles(x, asked, d, r)
    order = np.argsort(r + (1 - single.astype(np.float64)) / 4)  # by question, then by falling cosine
    d, r, single = d[order], r[order], single[order]
    start = np.searchsorted(r, np.arange(len(asked) + 1))
    last = np.minimum(start[:-1] + k, start[1:]) - 1  # the k-th of each question, or its last
    near = single >= single[np.maximum(last, 0)][r] - 2 * SINGLE if len(r) else np.zeros(0, bool)
    d, r = d[near], r[near]
    cosine = _cosines(x, asked, d, r)
    order = np.lexsort((ids[d], -cosine, r))
    d, r, cosine = d[order], r[order], cosine[order]
    top = np.arange(len(r)) - np.searchsorted(r, r) < k
    return d[top], r[top], cosine[top]


def _search(code: FourBitCode, k: int, least: float | None):
    """The k nearest of each question in one part of a cell, by exact cosines.

    A row is compared exactly unless its code rules it out. With e what coding took away of x, <q, x> is the score by code plus
    <x, e> plus <q - x, e>, and the length of q - x follows from the cosine it must reach. With `least` the last term is bounded
    by the two lengths: none that reaches it is lost. Without, the cosine to reach is that of the k-th best of the 2 k best by
    code, and the term is taken as that of a random direction, DEVIATIONS wide.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        kind = table.column("kind").to_numpy()
        if len(kind) and kind[0] in (MEMBER, SMALLEST):
            return pa.table({"kind": kind, "q": table.column("id"), "d": table.column("rep"), "cosine": pa.nulls(len(kind), pa.float64())})
        asks, kept = (table.filter(table.column(c)) for c in ("asks", "kept"))
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(asks) and len(kept):
            q_ids, ids = asks.column("id").to_numpy(), kept.column("id").to_numpy()
            questions, x = (unpacked(z.column("vector"), np.float32, DIM) for z in (asks, kept))
            coded = unpacked(kept.column("code"), np.uint8, DIM // 4 + 8)
            columns = np.ascontiguousarray(coded[:, :-8].T).astype(np.intp)
            inner, length = np.ascontiguousarray(coded[:, -8:]).view(np.float32).T
            place = np.full(len(q_ids), -1)
            order = np.argsort(ids)
            at = np.minimum(np.searchsorted(ids[order], q_ids), len(ids) - 1)
            place = np.where(ids[order[at]] == q_ids, order[at], -1)  # a question's own row
            for a in range(0, len(q_ids), BLOCK):
                asked, own = questions[a : a + BLOCK], place[a : a + BLOCK]
                tables, base, step = code.tables(asked)
                score = FourBitCode.scan(tables, columns)
                score[own[own >= 0], np.flatnonzero(own >= 0)] = 0
                reach = np.full(len(asked), least if least is not None else -1.0, np.float32)
                wide = np.sqrt(np.maximum(0, 2 - 2 * reach)) if least is not None else None
                if least is None and len(ids) > 2 * k:
                    d, r = np.divmod(np.flatnonzero(score >= _above(score, 2 * k)), len(asked))
                    keep = d != own[r]
                    d, r, cosine = _best(x, asked, d[keep], r[keep], ids, k)
                    last = np.bincount(r, minlength=len(asked)) == k
                    reach[last] = cosine[np.searchsorted(r, np.flatnonzero(last)) + k - 1]
                if wide is None:
                    wide = (DEVIATIONS / DIM**0.5) * np.sqrt(np.maximum(0, 2 - 2 * reach))
                # what the score by code must be for the easiest row, then for each row
                floor = reach - inner.max() - wide * length.max() - TABLE_SLACK
                at = np.flatnonzero(score >= np.clip(np.floor((floor - base) / step), 0, 65_535).astype(np.uint16))
                d, r = np.divmod(at, len(asked))
                keep = (score.ravel()[at] * step[r] + inner[d] + wide[r] * length[d] >= (reach - base - TABLE_SLACK)[r]) & (d != own[r])
                d, r, cosine = _best(x, asked, d[keep], r[keep], ids, k)
                if least is not None:
                    near = cosine >= least
                    d, r, cosine = d[near], r[near], cosine[near]
                found.append((q_ids[a + r], ids[d], np.clip(cosine, -1, 1)))
        q, d, cosine = (np.concatenate(z) for z in zip(*found))
        return pa.table({"kind": np.full(len(q), HOME, np.int32), "q": q, "d": d, "cosine": cosine})

    return run


def similar_vectors(df: DataFrame, id_col: str = "element_id", vector_col: str = "embedding", k: int = 10, probes: int = PROBES, least: float | None = None) -> DataFrame:
    """(id, neighbour_id, cosine, rank): for each row with a usable vector its k most similar others.

    `least` leaves out neighbours with a smaller cosine; of those that meet in a cell none is then lost. Null, non-finite, zero and
    wrongly long vectors are left out, as are null ids. Equal cosines are ranked by the smaller id. Rows of a
    partition with the same vector are searched for once and given each other's k + 1 smallest ids afterwards, so a vector that a
    third of all rows share costs no pairs of its copies. An empty table gives an empty result; columns other than the two named
    are not read. Accuracy: cosines are exact, the cells and, without `least`, the codes lose some neighbours (README: recall).
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")).where("id is not null and vector is not null")
    total = rows.count()
    fitted = sample(rows, "id", "vector", total)
    centroids, code = fit_cells(fitted, cell_count(total)), FourBitCode.fit(fitted[:8192])
    hot = hot_cells(spread(rows).mapInArrow(vector_cells(centroids, probes), SIZES), PART_ASKS, PART_ROWS)
    placed = in_parts(spread(rows).mapInArrow(_to_cells(centroids, code, probes, k), PLACED), hot)
    found = cut(placed.groupBy("cell", "part").applyInArrow(_search(code, k, least), FOUND))
    scored = found.where(F.col("kind") == HOME).select("q", "d", "cosine")
    if least is not None:  # few: what one of two found, the other has too
        scored = scored.unionByName(scored.select(F.col("d").alias("q"), F.col("q").alias("d"), "cosine")).distinct()
    return _with_copies(scored, found, k)


def _with_copies(scored: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """From representatives to all rows: a neighbour stands for its k + 1 smallest copies, and each copy has its own ranking."""
    members = found.where(F.col("kind") == MEMBER).select(F.col("q").alias("id"), F.col("d").alias("rep"))
    smallest = found.where(F.col("kind") == SMALLEST).select(F.col("q").alias("copy"), F.col("d").alias("of"))
    near = scored.join(smallest, scored["d"] == smallest["of"], "left").select(F.col("q").alias("rep"), F.coalesce("copy", "d").alias("neighbour_id"), "cosine")
    near = near.unionByName(smallest.select(F.col("of").alias("rep"), F.col("copy").alias("neighbour_id"), F.lit(1.0).alias("cosine")))
    ranked = near.withColumn("n", F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("cosine"), "neighbour_id"))).where(F.col("n") <= k + 1).drop("n")
    all_rows = ranked.join(members, "rep", "left").select(F.coalesce("id", "rep").alias("id"), "neighbour_id", "cosine").where("id != neighbour_id")
    return all_rows.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour_id"))).where(F.col("rank") <= k)


def similar_pairs(df: DataFrame, id_col: str = "element_id", vector_col: str = "embedding", k: int = 10, least: float = 0.90, probes: int = PROBES) -> DataFrame:
    """(id, neighbour_id), the smaller first: pairs with at least the given cosine of which one is among the k best of the other."""
    near = similar_vectors(df, id_col, vector_col, k, probes, least)
    return near.select(F.least("id", "neighbour_id").alias(id_col), F.greatest("id", "neighbour_id").alias("neighbour_id")).distinct()
