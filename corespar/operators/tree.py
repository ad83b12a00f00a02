"""The summary tree: cluster, summarise, repeat."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corespar.models import Generator, generate, prompt
from corespar.session import cut

LEVELS, CLUSTERS, FALLBACK = 3, 10, 500
FIT_ROWS, MOST_CLUSTERS = 20_000, 4_096  # rows on which the centres of a level are fitted at most, and their number


def rollup(members: DataFrame, by: str = "cluster_id") -> DataFrame:
    """(by, num_children, wells, doc_types, primary_well): metadata of a cluster; the primary well only if there is exactly one.

    Members may have `wells` beside their primary well; these are gathered too.

    Nulls are skipped. Distinct values are gathered, so a hot cluster costs what its distinct values take, not its rows.
    """
    counts = members.groupBy(by).agg(F.count("*").alias("num_children"))
    named = members.select(by, F.explode("wells").alias("primary_well")) if "wells" in members.columns else members.select(by, "primary_well")
    wells = named.where("primary_well is not null").distinct().groupBy(by).agg(F.array_sort(F.collect_set("primary_well")).alias("wells"))
    kinds = members.select(by, "doc_type").where("doc_type is not null").distinct().groupBy(by).agg(F.array_sort(F.collect_set("doc_type")).alias("doc_types"))
    none = F.array().cast("array<string>")
    joined = counts.join(wells, by, "left").join(kinds, by, "left").withColumns({"wells": F.coalesce("wells", none), "doc_types": F.coalesce("doc_types", none)})
    return joined.withColumn("primary_well", F.when(F.size("wells") == 1, F.element_at("wells", 1)))


def summaries(members: DataFrame, by: str = "cluster_id", id_col: str = "node_id", generator: Generator | None = None) -> DataFrame:
    """(by, text): a summary of each group by the generator, asked with the members' texts in the order of their ids, joined and cut.

    Without a generator, or where it fails, the joined texts themselves.

    Only as many members as the cut can hold are gathered, told by a running length, so no group is held whole.
    """
    line = Window.partitionBy(by).orderBy(id_col)
    members = members.withColumn("_n", F.row_number().over(line)).where(F.col("_n") <= FALLBACK)  # each member takes a character at least
    before = members.withColumn("before", F.sum(F.length(F.coalesce("text", F.lit(""))) + 1).over(line.rowsBetween(Window.unboundedPreceding, -1)))
    kept = before.where(F.coalesce("before", F.lit(0)) < FALLBACK)
    joined = kept.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(id_col).alias("i"), F.substring(F.coalesce("text", F.lit("")), 1, FALLBACK).alias("t")))), lambda x: x["t"]), " ").alias("text"))
    short = joined.select(by, F.substring("text", 1, FALLBACK).alias("text"))
    if generator is None:
        return short
    said = generate(short.withColumn("prompt", prompt("summary", F.col("text"))), generator)
    return said.select(by, F.coalesce("generated", "text").alias("text"))


def largest_clusters(members: DataFrame, by: str = "cluster_id", most: int = CLUSTERS) -> DataFrame:
    """(by, n) of the `most` largest clusters, the smaller id first among equals."""
    return members.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by).limit(most)


def _groups(level: DataFrame, n: int, clusters: int) -> DataFrame:
    """The rows with a cluster_id: k-means, fitted on at most FIT_ROWS rows, every row assigned to its nearest centre.

    A level has about the square root of its rows as clusters (at least `clusters`, at most half of them and MOST_CLUSTERS), so
    clusters stay small however many rows there are.
    """
    k = max(2, min(MOST_CLUSTERS, n // 2, max(clusters, round(n**0.5))))
    fit = level.withColumn("features", array_to_vector("vector"))
    part = fit if n <= FIT_ROWS else fit.where(F.pmod(F.xxhash64("node_id"), F.lit(1_000_000)) < int(1_000_000 * FIT_ROWS / n))
    model = KMeans(k=k, seed=1, maxIter=6, initMode="random").fit(part.select("features"))
    return cut(model.transform(fit).withColumnRenamed("prediction", "cluster_id"))


def build_tree(nodes: DataFrame, levels: int = LEVELS, clusters: int = CLUSTERS, generator: Generator | None = None) -> DataFrame:
    """(level, node_id, parent_id, num_children, text, primary_well, wells, doc_type, vector) from leaves (node_id, text, primary_well, doc_type, vector).

    Each level is clustered by k-means on the vectors and summarised, by the generator if there is one (a summary that fails falls
    back to the joined texts); it ends when `clusters` groups or fewer are left, or after `levels`. Rows with null vectors stay leaves
    without a parent; fewer than two vectors give leaves alone.
    """
    level = cut(nodes.select(F.lit(0).alias("level"), F.col("node_id").cast("long"), F.lit(0).cast("long").alias("num_children"), "text", "primary_well", F.array_compact(F.array("primary_well")).alias("wells"), "doc_type", F.col("vector").cast("array<double>")))
    out = None
    for at in range(levels):
        fit = level.where("vector is not null")
        n = fit.count()
        if n < 2 or (at and n <= clusters):
            break
        grouped = _groups(fit, n, clusters)
        base = F.lit((at + 1) * 1_000_000_000_000)
        parents = grouped.select("node_id", (base + F.col("cluster_id")).alias("parent_id"))
        done = level.join(parents, "node_id", "left")
        out = done if out is None else out.unionByName(done)
        mean = grouped.groupBy("cluster_id").agg(vector_to_array(Summarizer.mean(F.col("features"))).alias("vector"))
        up = rollup(grouped).join(summaries(grouped, generator=generator), "cluster_id").join(mean, "cluster_id")
        level = cut(up.select(F.lit(at + 1).alias("level"), (base + F.col("cluster_id")).alias("node_id"), "num_children", "text", "primary_well", "wells", F.try_element_at("doc_types", F.lit(1)).alias("doc_type"), "vector"))
    last = level.withColumn("parent_id", F.lit(None).cast("long"))
    return cut(last if out is None else out.unionByName(last))


def per_level(ranked: DataFrame, k: int = 3) -> DataFrame:
    """The k best rows (query_id, level, node_id, score) of each question and level; then by score, upper levels and smaller ids first."""
    best = ranked.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "level").orderBy(F.desc("score"), "node_id"))).where(F.col("n") <= k).drop("n")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("level"), "node_id")))
