"""The similarity graph: edges between near vectors, and bounded breadth-first search."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corespar.operators.dense import _matrix, usable
from corespar.session import cut

BLOCK_ROWS = 8_192


def _pairs(least: float, dim: int):
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        src, dst, weight = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if len(left) and len(right):
            a, b = left.column("id").to_numpy(), right.column("id").to_numpy()
            x, y = _matrix(left.column("v"), dim), _matrix(right.column("v"), dim)
            for i in range(0, len(a), 512):
                s = np.round(x[i : i + 512] @ y.T, 6)
                r, d = np.nonzero(s > least)
                p, q = a[i + r], b[d]
                keep = p < q if key[0].as_py() == key[1].as_py() else np.ones(len(r), bool)
                src.append(np.minimum(p, q)[keep])
                dst.append(np.maximum(p, q)[keep])
                weight.append(s[r, d][keep])
        return pa.table({"src": np.concatenate(src), "dst": np.concatenate(dst), "weight": np.concatenate(weight)})

    return run


def representatives(vectors: DataFrame, dim: int, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): each usable vector once, with the smallest of its ids."""
    rows = vectors.where(usable(F.col(vector_col), dim)).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.groupBy("v").agg(F.min("id").alias("id")).select("id", "v")


def membership(vectors: DataFrame, dim: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, rep): each row with a usable vector and the smallest id that has the same vector."""
    rows = vectors.where(usable(F.col(vector_col), dim)).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.join(representatives(vectors, dim, id_col, vector_col).withColumnRenamed("id", "rep"), "v").select("id", "rep")


def expanded(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(src, dst, weight) with src < dst between all rows, from the edges of representatives; copies are linked with weight 1."""
    one, two = members.toDF("a", "src"), members.toDF("b", "dst")
    apart = edges.join(one, "src").join(two, "dst").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), "weight")
    return apart.unionByName(members.toDF("src", "rep").join(members.toDF("dst", "rep"), "rep").where("src < dst").select("src", "dst", F.lit(1.0).alias("weight")))


def degrees(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(id, degree) of each row with a neighbour, without making the edges of copies."""
    sizes = members.groupBy("rep").agg(F.count("*").alias("n"))
    others = both_ways(edges).join(sizes.toDF("dst", "n"), "dst").groupBy(F.col("src").alias("rep")).agg(F.sum("n").alias("others"))
    each = sizes.join(others, "rep", "left").select("rep", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("degree")).where("degree > 0")
    return members.join(each, "rep").select("id", "degree")


def similarity_edges(vectors: DataFrame, least: float = 0.7, dim: int = 64, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int = 32) -> DataFrame:
    """(src, dst, weight) with src < dst for all pairs of different vectors whose cosine is above `least`: exact.

    Rows with the same vector are one vertex, that of the smallest id: copies aren't expanded into pairs. membership() has the others.

    Rows go to the nearest of some pivots. Two cells meet only if the triangle inequality on angles allows a pair above the
    threshold, and hot cells are cut into parts, so no task holds more than two blocks. Unusable vectors are left out. Meant for
    graphs of thresholds that few pairs pass; the work is quadratic where the cells can't be told apart.
    """
    spark = vectors.sparkSession
    rows = representatives(vectors, dim, id_col, vector_col)
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(pivots).toArrow()
    if not sample.num_rows:
        return spark.createDataFrame([], "src bigint, dst bigint, weight double")
    pivot = _matrix(sample.column("v"), dim)

    def assign(batches):
        for batch in batches:
            x = _matrix(pa.chunked_array([batch.column(1)]), dim)
            angle = np.arccos(np.clip(x @ pivot.T, -1, 1))
            cell = angle.argmin(axis=1) if len(x) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell.astype(np.int32)), pa.array(angle[np.arange(len(x)), cell])], names=["id", "v", "cell", "angle"])

    placed = cut(rows.mapInArrow(assign, "id bigint, v array<double>, cell int, angle double"))
    cells = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("far")).collect()  # at most `pivots` rows
    reach = np.arccos(np.clip(least, -1, 1)) + 1e-6
    between = np.arccos(np.clip(pivot @ pivot.T, -1, 1))
    parts = {r["cell"]: -(-r["n"] // BLOCK_ROWS) for r in cells}
    near = [(a["cell"], b["cell"], parts[a["cell"]], parts[b["cell"]]) for a in cells for b in cells if a["cell"] <= b["cell"] and between[a["cell"], b["cell"]] - a["far"] - b["far"] <= reach]
    steps = F.broadcast(spark.createDataFrame(near, "c1 int, c2 int, n1 int, n2 int"))  # at most pivots squared
    part = F.element_at(F.create_map(*[F.lit(x) for kv in parts.items() for x in kv]), F.col("cell"))
    placed = placed.withColumn("p", F.pmod(F.xxhash64("id"), part).cast("int"))
    name = lambda c, p: F.concat_ws(".", c, p)
    left = placed.join(steps, F.col("cell") == F.col("c1")).withColumn("q", F.explode(F.sequence(F.when(F.col("c1") == F.col("c2"), F.col("p")).otherwise(0), F.col("n2") - 1)))
    left = left.select(name("c1", "p").alias("one"), name("c2", "q").alias("two"), "id", "v").groupBy("one", "two")
    right = placed.join(steps, F.col("cell") == F.col("c2")).withColumn("q", F.explode(F.sequence(F.lit(0), F.when(F.col("c1") == F.col("c2"), F.col("p")).otherwise(F.col("n1") - 1))))
    right = right.select(name("c1", "q").alias("one"), name("c2", "p").alias("two"), "id", "v").toDF("one", "two", "id", "v").groupBy("one", "two")
    return left.cogroup(right).applyInArrow(_pairs(least, dim), "src bigint, dst bigint, weight double")


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def traverse(seeds: DataFrame, edges: DataFrame, max_hops: int = 2, max_nodes: int | None = 50, members: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, hop): what breadth-first search visits from the seeds (query_id, doc_id).

    Hop 0 visits the seeds themselves, so `max_hops` reaches max_hops - 1 edges far. At most `max_nodes` per question are kept, nearer
    ones first, then smaller ids. `edges` (src, dst) are used in both directions; a seed without edges is visited.
    With `members` (id, rep) the edges are those of representatives; every row has them, and copies are neighbours.
    """
    if members is not None:
        return _traverse_members(seeds.select("query_id", "doc_id").distinct(), edges, max_hops, max_nodes, members)
    neighbours = cut(both_ways(edges).distinct())
    seen = cut(seeds.select("query_id", "doc_id").distinct().withColumn("hop", F.lit(0)))
    frontier = seen
    for hop in range(1, max_hops):
        step = frontier.join(neighbours, frontier["doc_id"] == neighbours["src"]).select("query_id", F.col("dst").alias("doc_id")).distinct()
        frontier = cut(step.join(seen.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti").withColumn("hop", F.lit(hop)))
        if frontier.limit(1).count() == 0:
            break
        seen = cut(seen.unionByName(frontier))
    return _nearest(seen, max_nodes)


def _traverse_members(seeds: DataFrame, edges: DataFrame, max_hops: int, max_nodes: int | None, members: DataFrame) -> DataFrame:
    """Representatives are visited, then their members: as far as they, but copies of a seed one hop from it."""
    seeds = cut(seeds)
    reps = seeds.join(members.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("query_id", F.coalesce("rep", "doc_id").alias("doc_id"))
    reached = traverse(reps, edges, max_hops, None).withColumnRenamed("doc_id", "rep")
    if max_nodes is not None:  # members with so many smaller ones beside them can't be among the nearest
        members = members.withColumn("n", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("n") <= max_nodes).drop("n")
    visited = reached.join(members, "rep").select("query_id", F.col("id").alias("doc_id"), F.greatest("hop", F.lit(1)).alias("hop"))
    visited = visited.where(F.col("hop") < max_hops).join(seeds, ["query_id", "doc_id"], "left_anti")
    return _nearest(seeds.withColumn("hop", F.lit(0)).unionByName(visited), max_nodes)


def _nearest(seen: DataFrame, max_nodes: int | None) -> DataFrame:
    if max_nodes is None:
        return seen
    return seen.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("hop", "doc_id"))).where(F.col("n") <= max_nodes).drop("n")
