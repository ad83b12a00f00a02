"""Ingest and retrieval put together from the other operators."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corespar.models import Generator, Tagger, generate, prompt
from corespar.operators import answer, extract, route
from corespar.operators.dense import hashed_terms, text_topk
from corespar.operators.fusion import FINAL_LIMIT, rrf
from corespar.operators.index import DIMS, Index
from corespar.operators.metadata import search_metadata
from corespar.operators.sparse import as_arrays, scan_topk
from corespar.operators.tree import LEVELS
from corespar.session import cut
from corespar.sources.files import json_in_text

# Classes of images, in the order in which they are looked for.
IMAGE_CLASSES = ("plot", "schematic", "table", "photo", "map", "chart")
MOST_IMAGES = 10
MODEL_TEXT = 500  # a text must be longer than this, and name no well, before a model is asked for its metadata


def image_class(answer: Column) -> Column:
    """The first class that a model's answer contains, else other; null answers are errors."""
    return F.when(answer.isNull(), "error").otherwise(route.first_match(F.lower(answer), [(c, c) for c in IMAGE_CLASSES], "other"))


def image_text(kind: Column, caption: Column, data: Column) -> Column:
    """An image as text; null parts are left out."""
    return F.concat_ws("\n", F.concat(F.lit("[Image: "), kind, F.lit("]")), F.concat(F.lit("Description: "), caption), F.concat(F.lit("Data: "), data))


BLOCK = 200  # elements that one value holds at most


def assemble(elements: DataFrame, by: str = "source") -> DataFrame:
    """(by, kind, block, text): the elements of each source in the order text, image, table, then element_id, joined by blank lines.

    A source's text is the texts of its rows in the order of kind (0 text, 1 image, 2 the rest) and block; a block joins up to
    BLOCK elements, so no source is ever one value, however many rows it has. Places are counted over ids alone. Of images only
    the first MOST_IMAGES count. Null and blank contents are left out.
    """
    kind = F.lower(F.trim("type"))
    rows = elements.where(F.col(by).isNotNull() & F.col("content").isNotNull() & (F.trim("content") != "")).withColumn("kind", F.when(kind == "text", 0).when(kind == "image", 1).otherwise(2))
    places = rows.select(by, "kind", "element_id").withColumn("n", F.row_number().over(Window.partitionBy(by, "kind").orderBy("element_id"))).where((F.col("kind") != 1) | (F.col("n") <= MOST_IMAGES))
    placed = rows.select("element_id", "content").join(places, "element_id").withColumn("block", F.floor((F.col("n") - 1) / BLOCK).cast("int"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("n", "content"))), lambda x: x["content"])
    return placed.groupBy(by, "kind", "block").agg(F.array_join(ordered, "\n\n").alias("text"))


def merge_measurements(*summaries: Column) -> Column:
    """Field by field the last summary that has a value, as later extractors override earlier ones."""
    return F.struct(*[F.coalesce(*[s[f] for s in reversed(summaries)]).alias(f) for f in ("min", "max", "all_values")])


def merge_runs(meta: DataFrame, field: str, by: str = "source") -> DataFrame:
    """(by, m): for each source its runs' measurements merged as merge_measurements() does, in the order of ingested_at and meta_id.

    Each field is the one of the last run that has it, found by aggregation, so a source with many runs is no single sort.
    """
    at = F.struct("ingested_at", "meta_id")
    last = lambda f: F.max_by(F.col(field)[f], F.when(F.col(field)[f].isNotNull(), at)).alias(f)
    found = meta.where(F.col(by).isNotNull()).groupBy(by).agg(*[last(f) for f in ("min", "max", "all_values")])
    return found.select(by, F.struct("min", "max", "all_values").alias("m"))


MODEL_METADATA = "wells array<string>, formations array<string>, test_types array<string>"


def extract_all(docs: DataFrame, text_col: str = "text", name_col: str = "filename", generator: Generator | None = None) -> DataFrame:
    """The frame with wells, primary_well, formations, test_types, depth, temperature, pressure, doc_type and needs_model.

    needs_model marks the texts for which a model is asked: no well by pattern and more than MODEL_TEXT characters. With a generator
    its lists (a JSON object in the answer) come after the patterns' own, and an answer that is no JSON changes nothing; without
    one the patterns stand alone. Null texts have empty lists and null measurements.
    """
    text, name = F.coalesce(F.col(text_col), F.lit("")), F.col(name_col)
    found = {k: extract.hits(text, p) for k, p in extract.PATTERNS.items()}
    wells = extract.clean_entities(found["wells"], wells=True)
    facts = {
        "wells": wells,
        "formations": extract.clean_entities(found["formations"]),
        "test_types": extract.clean_entities(found["test_types"]),
        **{q: extract.summary(found[q]) for q in ("depth", "temperature", "pressure")},
        "doc_type": extract.file_type(name),
        "needs_model": (F.size(wells) == 0) & (F.length(text) > MODEL_TEXT),
    }
    out = docs.withColumns(facts)
    if generator is not None:
        asked = generate(out.where("needs_model").withColumn("prompt", prompt("metadata", F.col(text_col))), generator)
        told = asked.withColumn("told", json_in_text("generated", MODEL_METADATA))
        told = told.withColumns({c: extract.merge_lists(F.col(c), F.col("told")[c]) for c in ("wells", "formations", "test_types")})
        out = out.where("not needs_model").unionByName(told.select(*out.columns))
    out = out.withColumn("wells", extract.merge_lists(F.col("wells"), F.array_compact(F.array(extract.file_well(name)))))
    return out.withColumn("primary_well", extract.primary_well(F.col("wells"), name))


# Labels of named entities among which wells are looked for, and what a well's name has in them.
TAGGED = ("ORG", "FAC", "PRODUCT")
TAGGED_WELL = r"[A-Z]{2,}[-_\s]?\d+"


def wells_by_tagger(docs: DataFrame, tagger: Tagger, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, wells): wells among the named entities that a tagger finds in each text, different ones in the order of their places.

    The tagger is passed in and runs in tasks, by Arrow batches; whole texts are given to it. Null texts have an empty list.
    """

    def run(batches):
        for pdf in batches:
            found = tagger([t or "" for t in pdf["text"]])
            yield pdf[["id"]].assign(found=pd.Series([[x for label, x in one if label in TAGGED] for one in found], index=pdf.index, dtype=object))

    tagged = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInPandas(run, "id bigint, found array<string>")
    return tagged.select(F.col("id").alias(id_col), F.array_distinct(F.filter("found", lambda x: x.rlike(TAGGED_WELL))).alias("wells"))


def describe_images(elements: DataFrame, generator: Generator, image_col: str | None = None, context_col: str = "content") -> DataFrame:
    """(element_id, kind, text, error) of each image element: its class and its description as one text.

    The model is asked twice for each image, for a caption and for its class; `image_col` holds the image's bytes. An image whose
    caption fails has the error and no text; a class that fails is the class error.
    """
    images = elements.where(F.lower(F.trim("type")) == "image")
    kept = ["element_id", *([image_col] if image_col else [])]
    asked = images.select(*kept, prompt("caption", F.coalesce(F.col(context_col), F.lit("Not provided"))).alias("prompt"), prompt("image_class", F.coalesce(F.col(context_col), F.lit(""))).alias("class_prompt"))
    said = generate(asked, generator, "prompt", image_col).withColumnsRenamed({"generated": "caption", "error": "caption_error"})
    classed = generate(said, generator, "class_prompt", image_col)
    kind = image_class(F.col("generated"))
    return classed.select("element_id", kind.alias("kind"), F.when(F.col("caption").isNotNull(), image_text(kind, F.col("caption"), F.lit(None).cast("string"))).alias("text"), F.col("caption_error").alias("error"))


def matches_well(wanted: Column, primary: Column, wells: Column) -> Column:
    """A tree node is of a well if it is its primary well or one of its wells."""
    return (primary == wanted) | F.coalesce(F.array_contains(wells, wanted), F.lit(False))


def first_wells(questions: DataFrame) -> DataFrame:
    """(query_id, well) of the questions that name a well: the first one."""
    named = questions.select("query_id", F.try_element_at(route.question_wells(F.col("question")), F.lit(1)).alias("well"))
    return named.where("well is not null")


def retrieve(questions: DataFrame, index: Index, tree: DataFrame | None = None, limit: int = FINAL_LIMIT, edge: float = 0.7) -> DataFrame:
    """(query_id, strategy, rank, doc_id, level, score): each question answered by its own strategy, at most `limit` rows.

    dense: ten nearest; hybrid: fused ranks; graph: the five nearest, then their neighbours in the similarity graph (cosine above
    `edge`), each question's twenty smallest with the seeds first, unscored; raptor: the three best nodes of each level of the tree
    (level, node_id, text, primary_well, wells), where there is one, else dense. What a question's first well doesn't match is
    left out after ranking: chunks by their primary well in the metadata index, nodes by primary well or wells. All branches are
    built once for all questions and told apart by the strategy.
    """
    asked = questions.withColumns({"k": route.category(F.col("question")), "w": route.question_wells(F.col("question")), "f": route.question_formations(F.col("question"))})
    asked = cut(asked.select("query_id", "question", route.strategy(F.col("k"), F.col("w"), F.col("f")).alias("strategy")))
    of = lambda *s: asked.where(F.col("strategy").isin(*s)).select("query_id", "question")
    none = F.lit(None)
    flat = lambda df, rank="rank": df.select("query_id", F.col(rank).alias("rank"), "doc_id", none.cast("int").alias("level"), "score")
    near = cut(index.text_topk(of("hybrid", "graph", "dense", *(() if tree is not None else ("raptor",)))))
    which = near.join(asked.select("query_id", "strategy"), "query_id")
    both = of("hybrid")
    seeds = which.where("strategy = 'graph' and rank <= 5").drop("strategy")
    visited = seeds.select("query_id", "doc_id", F.lit(0).alias("hop")).unionByName(index.similar_to(seeds, edge).withColumn("hop", F.lit(1)))
    visited = visited.groupBy("query_id", "doc_id").agg(F.min("hop").alias("hop"))
    after = visited.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("hop", "doc_id"))).where("n <= 20").select("query_id", (F.col("n") + 5).alias("rank"), "doc_id", none.cast("double").alias("score"))
    branches = [flat(which.where("strategy not in ('hybrid', 'graph')")), flat(rrf(which.where("strategy = 'hybrid'").drop("strategy"), index.bm25_topk(both))), flat(seeds), flat(after)]
    wells = first_wells(questions)
    fits = search_metadata(index.metadata, wells.select("query_id", F.lit("primary_well").alias("field"), F.col("well").alias("value"))).select("query_id", "doc_id").withColumn("fits", F.lit(True))
    rows = reduce(DataFrame.unionByName, branches).join(wells, "query_id", "left").join(fits, ["query_id", "doc_id"], "left").where("well is null or fits").drop("well", "fits")
    if tree is not None:
        rows = rows.unionByName(_tree_rows(of("raptor"), wells, tree))
    line = Window.partitionBy("query_id").orderBy("rank", F.col("level").desc_nulls_last(), "doc_id")
    rows = rows.withColumn("rank", F.row_number().over(line)).where(F.col("rank") <= limit)
    return rows.join(asked.select("query_id", "strategy"), "query_id").select("query_id", "strategy", "rank", "doc_id", "level", "score")


def _tree_rows(questions: DataFrame, wells: DataFrame, tree: DataFrame) -> DataFrame:
    """(query_id, rank, doc_id, level, score): the three best nodes of each level by their texts, all levels in one scan."""
    vectors = lambda df, i, t: as_arrays(hashed_terms(df, DIMS, i, t))
    asked = vectors(questions, "query_id", "question").withColumnRenamed("doc_id", "query_id")
    rows = vectors(tree, "node_id", "text").join(tree.select(F.col("node_id").alias("doc_id"), F.col("level").alias("part")), "doc_id")
    found = scan_topk(asked, rows, DIMS, 3, lambda c: 1 / (3 - 2 * c))
    if found is None:  # too many questions to send to every task: level by level, in blocks of nodes
        levels = [r["level"] for r in tree.select("level").distinct().orderBy("level").limit(LEVELS + 1).collect()]
        found = reduce(DataFrame.unionByName, [text_topk(questions, tree.where(F.col("level") == at), k=3, id_col="node_id").withColumn("part", F.lit(at)) for at in levels])
    nodes = found.select("query_id", "doc_id", "score", F.col("part").alias("level"))
    ranked = nodes.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("level"), "doc_id")))
    own = tree.select(F.col("node_id").alias("doc_id"), "level", "primary_well", "wells")
    met = ranked.join(own, ["doc_id", "level"]).join(wells, "query_id", "left")
    return met.where(F.col("well").isNull() | F.coalesce(matches_well(F.col("well"), F.col("primary_well"), F.col("wells")), F.lit(False))).select("query_id", "rank", "doc_id", "level", "score")


def ask(questions: DataFrame, index: Index, tree: DataFrame | None = None, generator: Generator | None = None) -> DataFrame:
    """(query_id, strategy, n_chunks, answer, confidence, band, is_grounded, error): questions to answers in one path.

    Each question (query_id, question) is routed, answered from by its strategy and filter, its context packed to the budget, put to
    the generator (without one the extractive stand-in answers) and checked. A question for which nothing is found has no answer.
    """
    found = cut(retrieve(questions, index, tree))
    texts = index.chunks.select("doc_id", "text", "source", "page", "primary_well").withColumn("level", F.lit(None).cast("int"))
    if tree is not None:
        texts = texts.unionByName(tree.select(F.col("node_id").alias("doc_id"), "text", F.lit(None).cast("string").alias("source"), F.lit(None).cast("int").alias("page"), "primary_well", "level"))
    ranked = found.join(texts.withColumnRenamed("level", "_level"), (found["doc_id"] == texts["doc_id"]) & found["level"].eqNullSafe(F.col("_level"))).select("query_id", "rank", found["doc_id"], "text", "source", "page", "primary_well")
    packed = cut(answer.pack_context(ranked))
    context = answer.context_text(packed)
    if generator is None:
        said = answer.extractive_answer(packed, questions).withColumn("error", F.lit(None).cast("string"))
    else:
        put = context.join(questions.select("query_id", "question"), "query_id").withColumn("prompt", F.concat(prompt("answer", F.col("context")), F.lit("\n\nQuestion: "), F.col("question")))
        said = generate(put.select("query_id", "prompt"), generator).select("query_id", F.col("generated").alias("answer"), "error")
    kind, wells, formations = route.category(F.col("question")), route.question_wells(F.col("question")), route.question_formations(F.col("question"))
    counted = questions.select("query_id", route.strategy(kind, wells, formations).alias("strategy")).join(found.groupBy("query_id").agg(F.count("*").alias("n_chunks")), "query_id", "left").na.fill(0, ["n_chunks"])
    score = F.when(F.col("answer").isNotNull(), answer.confidence(F.col("answer")))
    out = counted.join(said, "query_id", "left").join(context, "query_id", "left")
    return out.select("query_id", "strategy", "n_chunks", "answer", score.alias("confidence"), F.when(score.isNotNull(), answer.band(score)).alias("band"), answer.grounded(F.col("answer"), F.coalesce("context", F.lit(""))).alias("is_grounded"), "error")
