"""Problem 9: a mixture of sources by target weights.

How often each record is used follows from prefix sums of sizes in the source's hash order. The order of the mixture is a Pfair
schedule: within a cycle of slots the j-th of a source's n blocks may start at slot j / n and must be done by (j + 1) / n of the cycle;
taking the released block with the earliest deadline keeps every source within one block of its share. Cycles are laid out in
tasks of their own, each from the numbers of blocks that the sources must have had when it starts, so neither the number of
blocks nor the size of the corpus has a bound.
"""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corespar.session import cut
from corespar.tables import spread

from .encode import VOCABULARY, encode_texts

CYCLE = 4_096  # slots
BLOCK = 1_000  # tokens of a block, whatever the size of the mixture
MOST_SOURCES = 10_000
BUCKET_ROWS = 100_000
HASH_BITS = 60


def rounded(blocks: list[int], at: int) -> list[int]:
    """Blocks that each source has had after `at` slots: its share of them, rounded by largest remainders, so that they sum to `at`."""
    total = sum(blocks)
    floor = [n * at // total for n in blocks]
    rest = [n * at % total for n in blocks]
    more = sorted(range(len(blocks)), key=lambda i: (-rest[i], i))[: at - sum(floor)]
    for i in more:
        floor[i] += 1
    return floor


def pfair(counts: list[int]) -> list[tuple[int, int]]:
    """(source, block) for each slot of a cycle: earliest deadline first among released blocks; counts sum to the cycle's slots."""
    slots = sum(counts)
    waiting = [(0, i, 0) for i, n in enumerate(counts) if n]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []
    plan: list[tuple[int, int]] = []
    while waiting or ready:
        while waiting and (waiting[0][0] <= len(plan) or not ready):
            _, i, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * slots // counts[i]), i, j))
        _, i, j = heapq.heappop(ready)
        plan.append((i, j))
        if j + 1 < counts[i]:
            heapq.heappush(waiting, ((j + 1) * slots // counts[i], i, j + 1))
    return plan


def _cycles(names: list[str], blocks: list[int]):
    def run(batches):
        total = sum(blocks)
        for pdf in batches:
            for cycle in pdf["id"].tolist():
                had, then = rounded(blocks, cycle * CYCLE), rounded(blocks, min(total, (cycle + 1) * CYCLE))
                plan = pfair([b - a for a, b in zip(had, then)])
                yield pd.DataFrame({"source": [names[i] for i, _ in plan], "block": [had[i] + j for i, j in plan], "slot": range(cycle * CYCLE, cycle * CYCLE + len(plan))})

    return run


def schedule(spark, blocks: dict[str, int]) -> DataFrame:
    """(source, block, slot) of all blocks, cycle by cycle in tasks of their own."""
    names = sorted(s for s, n in blocks.items() if n > 0)
    cycles = -(-sum(blocks[s] for s in names) // CYCLE) if names else 0
    parts = max(1, min(cycles, 4 * spark.sparkContext.defaultParallelism))
    return spark.range(0, cycles, 1, parts).mapInPandas(_cycles(names, [blocks[s] for s in names]), "source string, block bigint, slot bigint")


def source_quotas(totals: dict[str, int], targets: dict[str, tuple[float, int]], total_tokens: int | None = None) -> dict[str, dict]:
    """Tokens to take of each source. Without a total it is the largest at which every source that has any tokens reaches its share.

    Targets of sources without tokens are spread over the others in proportion. With a total, a source whose records used as often
    as allowed don't suffice gives all of these.
    """
    there = {s: t for s, t in targets.items() if totals.get(s, 0) > 0 and t[0] > 0 and t[1] > 0}
    share = sum(t[0] for t in there.values())
    out = {}
    if there:
        weights = {s: t[0] / share for s, t in there.items()}
        total = min(totals[s] * there[s][1] / weights[s] for s in there) if total_tokens is None else total_tokens
        for s in there:
            out[s] = {"weight": weights[s], "tokens": math.floor(min(total * weights[s], totals[s] * there[s][1]) + 1e-6), "all": totals[s], "repeats": there[s][1]}
    return out


def mix_sources(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, vocabulary: str = VOCABULARY, size_col: str | None = None, block: int = BLOCK) -> DataFrame:
    """(doc_id, source, use_no, n_tokens, block, slot): each use of each selected record, and its place in the mixture.

    Sizes are tokens of the vocabulary, or the whole numbers of `size_col`. Order by slot, then use_no and doc_id. Records without
    size (null and empty texts), without a source or with a source that isn't in the targets are not used. No record is used more
    than max_repeats times; a source misses its quota by less than one record. Copies are records of their own. Records are
    taken in the order of a hash of their id, ties by the id. Blocks have the given size for every corpus; a record longer than a block
    counts to the block it starts in. At the ends of cycles a source is within one block of its share, within a cycle of two.
    """
    spark = docs.sparkSession
    wanted = targets.where("source is not null and target_share > 0 and max_repeats > 0").groupBy("source").agg(F.sum("target_share").alias("w"), F.max("max_repeats").alias("r")).limit(MOST_SOURCES + 1).collect()
    if len(wanted) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    there = docs.where("source is not null and doc_id is not null").where(F.col("source").isin([r["source"] for r in wanted]))
    if size_col is None:
        counted = encode_texts(there.where("text is not null"), text_col="text", vocabulary=vocabulary, count_only=True, keep=["source"])
    else:
        counted = spread(there).select(F.col("doc_id").cast("long"), F.col(size_col).cast("long").alias("n_tokens"), "source")
    hashed = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, HASH_BITS // 4), 16, 10).cast("long")
    sizes = cut(counted.where("n_tokens > 0").withColumn("h", hashed))
    by_source = {r["source"]: (r["t"], r["n"]) for r in sizes.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")).collect()}
    quotas = source_quotas({s: t for s, (t, _) in by_source.items()}, {r["source"]: (r["w"], r["r"]) for r in wanted}, total_tokens)
    # prefix sums in two steps, so that no task holds a whole source: over buckets of the hash, then within each bucket
    buckets = max(64, max([n for _, n in by_source.values()], default=0) // BUCKET_ROWS)
    sized = sizes.withColumn("bucket", F.floor(F.col("h") / F.lit((1 << HASH_BITS) // buckets + 1)))
    sums = sized.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("s"))
    before = sums.select("source", "bucket", (F.sum("s").over(Window.partitionBy("source").orderBy("bucket")) - F.col("s")).alias("before"))
    within = F.sum("n_tokens").over(Window.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")
    placed = sized.withColumn("inside", within).join(before, ["source", "bucket"]).withColumn("start", F.col("before") + F.col("inside"))
    plan = spark.createDataFrame([(s, q["tokens"], q["all"], q["repeats"]) for s, q in quotas.items()], "source string, quota bigint, all_tokens bigint, repeats int")
    uses = placed.join(F.broadcast(plan), "source")
    # the start of use u is u * all_tokens + start; it is taken if at least half of the record lies before the quota
    end = F.col("quota") - F.col("start") - (F.col("n_tokens") / 2)
    uses = uses.withColumn("uses", F.least(F.when(end >= 0, F.floor(end / F.col("all_tokens")) + 1).otherwise(0), F.col("repeats")).cast("int")).where("uses > 0")
    each = uses.withColumn("use_no", F.explode(F.sequence(F.lit(0), F.col("uses") - 1))).withColumn("block", F.floor((F.col("use_no") * F.col("all_tokens") + F.col("start")) / block).cast("long"))
    slots = schedule(spark, {s: q["tokens"] // block + 1 for s, q in quotas.items()})
    return each.join(slots, ["source", "block"]).select("doc_id", "source", "use_no", "n_tokens", "block", "slot")


def mixture_shares(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, tokens, records, most_uses, actual_share), also for sources that have nothing."""
    uses = mixture.groupBy("source", "doc_id").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("u"))
    got = uses.groupBy("source").agg(F.sum("t").alias("tokens"), F.count("*").alias("records"), F.max("u").alias("most_uses"))
    joined = targets.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).join(got, "source", "left").na.fill(0, ["tokens", "records", "most_uses"])
    total = joined.agg(F.sum("tokens").alias("all_tokens"))
    return joined.crossJoin(F.broadcast(total)).select("source", "target_share", "max_repeats", "tokens", "records", "most_uses", F.when(F.col("all_tokens") > 0, F.col("tokens") / F.col("all_tokens")).otherwise(0.0).alias("actual_share"))
