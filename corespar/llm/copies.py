"""Problem 5: records that differ only in how they are written, collapsed and counted.

The canonical form of a record is a string of characters. Each partition first counts its own forms in tries of bounded size, so a
form shared by a third of all rows leaves it once. What is left is partitioned by its leading characters; a bucket that is too
large is split behind the characters that all its forms share, until each bucket fits. Buckets are counted in tries with terminal
counters, small ones together.
"""

from __future__ import annotations

import os.path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corespar.session import cut, stored

FITS = 65_536  # rows of a bucket that one task takes
FIRST, FURTHER = 2, 8  # leading characters of the first buckets; characters behind a shared beginning by which a bucket is split
TRIE_ROWS, TRIE_CHARS = 200_000, 1 << 26  # what one trie of a partition takes before it is given out
STRIDE = 8  # characters that a branch of the trie stands for
NOT_ALNUM = r"[^\p{L}\p{N}]"
LEAST_ALNUM = 40


def canonical(type_: Column, content: Column) -> Column:
    """Letters and digits in lower case, then the type; in tables by line, the fields of a line sorted."""
    clean = lambda c: F.regexp_replace(F.lower(c), NOT_ALNUM, "")
    kind = F.lower(F.trim(F.regexp_replace(type_, r"^\s+|\s+$", "")))
    fields = lambda line: F.array_sort(F.filter(F.transform(F.split(line, r"[|;\t]"), clean), lambda x: x != ""))
    lines = F.filter(F.transform(F.split(content, "\n"), lambda line: F.array_join(fields(line), "\x1f")), lambda x: x != "")
    return F.concat(F.when(kind == "table", F.array_join(lines, "\x1e")).otherwise(clean(content)), F.lit("\x1d"), kind)


class CountingTrie:
    """Keys to [key, copies, smallest id]; a branch is a slice of the key, a single key below a branch is kept as one leaf."""

    def __init__(self):
        self.root: dict = {}
        self.leaves: list[list] = []

    def add(self, key: str, first: int, copies: int = 1) -> list:
        node, at = self.root, 0
        while True:
            part = key[at : at + STRIDE]
            child = node.get(part)
            if child is None:
                leaf = node[part] = [key, copies, first]
                self.leaves.append(leaf)
                return leaf
            at += STRIDE
            if isinstance(child, dict):
                node = child
            elif child[0] == key:
                child[1] += copies
                child[2] = min(child[2], first)
                return child
            else:
                node[part] = node = {child[0][at : at + STRIDE]: child}


def _counted(trie: CountingTrie, seen: list[tuple[int, list]]):
    leaves, copies = trie.leaves, [(i, leaf[2]) for i, leaf in seen if leaf[1] > 1 and i != leaf[2]]
    for a in range(0, len(leaves), 10_000):
        part = leaves[a : a + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array([x[2] for x in part], pa.int64()), pa.nulls(len(part), pa.int64()), pa.array([x[1] for x in part], pa.int64()), pa.array([x[0] for x in part], pa.string())], names=["id", "of", "copies", "form"])
    for a in range(0, len(copies), 10_000):
        part = copies[a : a + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in part], pa.int64()), pa.array([x[1] for x in part], pa.int64()), pa.nulls(len(part), pa.int64()), pa.nulls(len(part), pa.string())], names=["id", "of", "copies", "form"])


def _local(batches):
    """Count a partition's forms, a bounded number at a time; copies leave as (id, first) pairs, forms once."""
    trie, seen, chars = CountingTrie(), [], 0
    for batch in batches:
        for i, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            seen.append((i, trie.add(key, i)))
            chars += len(key)
        if len(seen) >= TRIE_ROWS or chars >= TRIE_CHARS:
            yield from _counted(trie, seen)
            trie, seen, chars = CountingTrie(), [], 0
    yield from _counted(trie, seen)


def _count(table: pa.Table) -> pa.Table:
    ids, forms, copies = (table.column(c).to_pylist() for c in ("id", "form", "copies"))
    trie = CountingTrie()
    leaf_of = [trie.add(f, i, n) for i, f, n in zip(ids, forms, copies)]
    return pa.table({"id": pa.array(ids, pa.int64()), "of": pa.array([leaf[2] for leaf in leaf_of], pa.int64()), "copies": pa.array([leaf[1] for leaf in leaf_of], pa.int64())})


def _behind(batches):
    """How many characters tell the forms of a bucket apart, from its least and greatest form."""
    for batch in batches:
        depth = [len(os.path.commonprefix([a, b])) + FURTHER for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(depth, pa.int32())], names=["bucket", "next"])


def _in_buckets(forms: DataFrame, fits: int) -> DataFrame:
    """The forms with a bucket: a hash of so many leading characters that at most `fits` different forms share it.

    A round counts buckets; only rows of those too large are written and looked at again. Their numbers stay in tables that are
    joined. A bucket of equal forms isn't split; that is what each trie gave out once. Different prefixes of one hash share a bucket,
    which changes no result.
    """
    open_, done = forms.withColumn("depth", F.lit(FIRST)), []
    while True:
        keyed = open_.withColumn("bucket", F.xxhash64(F.expr("substring(form, 1, depth)"), "depth"))
        large = stored(keyed.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > fits).select("bucket"))
        if large.limit(1).count() == 0:
            done.append(keyed)
            break
        ends = keyed.join(large, "bucket", "left_semi").groupBy("bucket").agg(F.min("form").alias("a"), F.max("form").alias("b")).where("a != b")
        split = stored(ends.mapInArrow(_behind, "bucket bigint, next int"))
        done.append(keyed.join(split, "bucket", "left_anti").select(*keyed.columns))
        if split.limit(1).count() == 0:
            break
        open_ = stored(keyed.join(split, "bucket").select(*forms.columns, F.col("next").alias("depth")))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def collapse(df: DataFrame, id_col: str = "element_id", type_col: str = "type", content_col: str = "content", least: int = LEAST_ALNUM, fits: int = FITS) -> DataFrame:
    """(id, first_id, copies) for each row whose content has at least `least` letters and digits; copies counts the set.

    Rows with a null or shorter content, a null type or a null id are left out. first_id is the smallest id of the set, its own
    for a row without copies. Contents of any length are compared whole. Equal rows with equal ids count as one. Columns other
    than the three named are not read.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(type_col).alias("type"), F.col(content_col).alias("content"))
    forms = rows.where("id is not null").select("id", canonical(F.col("type"), F.col("content")).alias("form"))
    alnum = F.length(F.regexp_replace(F.element_at(F.split("form", "\x1d"), 1), "[\x1e\x1f]", ""))
    forms = forms.where(F.col("form").isNotNull() & (alnum >= least))
    local = stored(spread_forms(rows, forms).mapInArrow(_local, "id bigint, of bigint, copies bigint, form string"))
    own = local.where("copies is not null").select("id", "copies", "form")
    bins = max(64, 2 * own.count() // fits)  # small buckets are counted together
    counted = cut(_in_buckets(own, fits).withColumn("bin", F.pmod("bucket", F.lit(bins))).groupBy("bin").applyInArrow(_count, "id bigint, of bigint, copies bigint"))
    members = local.where("copies is null").select("id", F.col("of").alias("local"))
    joined = members.join(counted.select(F.col("id").alias("local"), "of", "copies"), "local").select("id", F.col("of").alias("first_id"), "copies")
    return counted.select("id", F.col("of").alias("first_id"), "copies").unionByName(joined).withColumnRenamed("id", id_col)


def spread_forms(rows: DataFrame, forms: DataFrame) -> DataFrame:
    """As spread(), decided by the plain scan below the forms."""
    wanted = rows.sparkSession.sparkContext.defaultParallelism
    return forms if rows.rdd.getNumPartitions() * 2 > wanted else forms.repartition(wanted)
