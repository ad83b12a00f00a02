"""Interfaces for models, with deterministic stand-ins that need no network."""

from __future__ import annotations

from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Generator(Protocol):
    """Text to text; raises on failure. Runs inside tasks, so it must be picklable."""

    def __call__(self, prompts: list[str], images: list[bytes | None]) -> list[str]: ...


class Embedder(Protocol):
    """Texts to vectors of one length; runs inside tasks."""

    def __call__(self, texts: list[str]) -> list[list[float]]: ...


class Tagger(Protocol):
    """Texts to their named entities, (label, text) in the order of their places; runs inside tasks."""

    def __call__(self, texts: list[str]) -> list[list[tuple[str, str]]]: ...


def embed(df: DataFrame, embedder: Embedder, text_col: str = "text", out_col: str = "embedding") -> DataFrame:
    """The frame with a vector for each text, computed by Arrow batches; a null text gets a null vector."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(batches):
        for pdf in batches:
            there = pdf[text_col].notna()
            vectors = pd.Series([None] * len(pdf), index=pdf.index, dtype=object)
            if there.any():
                vectors[there] = pd.Series(list(embedder(list(pdf.loc[there, text_col]))), index=pdf.index[there], dtype=object)
            yield pdf.assign(**{out_col: vectors})

    return df.mapInPandas(run, f"{fields}, `{out_col}` array<float>")


# Prompts for models; each is filled with the text or question it is about.
PROMPTS = {
    "route": "Name the kind of this question with one word (factual, comparison, summary, complex, exploratory): {}",
    "summary": "Summarise the following passages of technical reports in a few sentences: {}",
    "answer": "Answer from the passages only, name the sources, and end with a line 'Confidence: n%'. {}",
    "metadata": "Give wells, formations, test types, depth, temperature and pressure of this text as a JSON object: {}",
    "caption": "Describe this technical image: axes, units, wells and values. {}",
    "image_class": "Name the kind of this image with one word (plot, schematic, table, photo, map, chart, other). {}",
}


def prompt(name: str, filling: Column) -> Column:
    """A prompt of PROMPTS filled with a column."""
    before, after = PROMPTS[name].split("{}")
    return F.concat(F.lit(before), filling, F.lit(after))


def request_body(model: str, asked: Column, image: Column | None = None, temperature: float = 0.1) -> Column:
    """The JSON body of a request to a model server: the prompt, and an image's bytes as base64."""
    fields = [F.lit(model).alias("model"), asked.alias("prompt"), F.lit(False).alias("stream"), F.struct(F.lit(temperature).alias("temperature")).alias("options")]
    if image is not None:
        fields.append(F.array_compact(F.array(F.base64(image))).alias("images"))
    return F.to_json(F.struct(*fields))


class FirstSentences:
    """The stand-in: the first characters of what it is asked about."""

    def __init__(self, most: int = 500):
        self.most = most

    def __call__(self, prompts: list[str], images: list[bytes | None]) -> list[str]:
        return [p[: self.most] for p in prompts]


def generate(df: DataFrame, generator: Generator, prompt_col: str = "prompt", image_col: str | None = None) -> DataFrame:
    """The frame with `generated` and `error`: a failing batch is asked row by row, and a failing row has its error instead of a text."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(batches):
        for pdf in batches:
            prompts = [p or "" for p in pdf[prompt_col]]
            images = list(pdf[image_col]) if image_col else [None] * len(prompts)
            texts: list[str | None] = []
            errors: list[str | None] = []
            try:
                texts, errors = list(generator(prompts, images)), [None] * len(prompts)
            except Exception:
                for p, i in zip(prompts, images):
                    try:
                        texts.append(generator([p], [i])[0])
                        errors.append(None)
                    except Exception as e:
                        texts.append(None)
                        errors.append(f"{type(e).__name__}: {e}")
            yield pdf.assign(generated=pd.Series(texts, index=pdf.index, dtype=object), error=pd.Series(errors, index=pdf.index, dtype=object))

    return df.mapInPandas(run, f"{fields}, generated string, error string")
