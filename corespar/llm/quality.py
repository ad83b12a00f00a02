"""Problem 7: text quality per document, and natural prose told from lists, tables and junk.

Each line is one of four states of a hidden Markov model whose emissions are binned line statistics; Viterbi labels the lines of a
text, and the labels' shares of its characters decide its class.
"""

from __future__ import annotations

import re
from bisect import bisect
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corespar.tables import spread

CLASSES = ("prose", "list", "table", "junk")
LABELLED = 20_000  # labelled texts, at most, on which the model is fitted: a documented bound
LEAST_CHARS = 4  # shorter contents are fillers
ITEM = re.compile(r"\s*(?:[-*•–·‣▪o]\s|\(?[A-Za-z0-9]{1,3}[.)]\s|\d+(?:\.\d+)+\s)")
WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
CELLS = re.compile(r"[|;\t,]|\s{2,}")
VALUE = re.compile(r"^\s*(?:[<>]?\s*[-+]?\d[\d.,]*|-|n\.d\.|n/a)\s*$")
VOWELS = set("aeiouyäöüéèêàáóíúAEIOUYÄÖÜÉ")
BINS = 8
SIGN_EDGES = [0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.6]
ODD = re.compile(r"[^\w\s.,;:|()/%°<>'’\"&–—-]")


EDGES, FIELD = ".,;:()[]\"'!?•*", 40  # signs left out around a token; bits of a count


class Tokens(dict):
    """What a token adds to the counts of its line (words, common words, known words, words with a vowel), FIELD bits each.

    Looked up once for each different token of a task; `bare` has the tokens without the signs around them.
    """

    def __init__(self, common: frozenset[str], known: frozenset[str]):
        super().__init__()
        self.common, self.known, self.bare = common, known, _Bare()

    def __missing__(self, token: str) -> int:
        word = self.bare[token]
        if len(self) > 1_000_000:
            self.clear()
        lower = word.lower()
        facts = (True, lower in self.common, lower in self.known, not VOWELS.isdisjoint(word)) if WORD.fullmatch(word) else ()
        self[token] = value = sum(1 << (FIELD * i) for i, f in enumerate(facts) if f)
        return value


class _Bare(dict):
    def __missing__(self, token: str) -> str:
        if len(self) > 1_000_000:
            self.clear()
        self[token] = bare = token.strip(EDGES)
        return bare


def line_features(line: str, seen: Tokens, in_text: int) -> tuple[int, ...]:
    """Bin numbers of a line's statistics."""
    n = max(1, len(line))
    tokens = line.split()
    t = len(tokens)
    counts = sum(map(seen.__getitem__, tokens))
    w, common, known, vowels = (counts >> (FIELD * i) & ((1 << FIELD) - 1) for i in range(4))
    signs = n - sum(map(str.isalnum, line)) - (n - sum(map(len, tokens)))
    cells = [c for c in CELLS.split(line.strip()) if c.strip()]
    values = sum(1 for c in cells[1:] if VALUE.match(c))
    last = line.rstrip()[-1:]
    tenth = lambda a, b: min(BINS - 1, int(BINS * a / b)) if b else 0
    return (
        tenth(common, t),
        tenth(known, t),
        bisect(SIGN_EDGES, signs / n),
        bisect(SIGN_EDGES, len(ODD.findall(line)) / n),
        tenth(sum(map(str.isdigit, line)), n),
        min(BINS - 1, (1 + w).bit_length() - 1),
        tenth(vowels, w),
        min(BINS - 1, int(2 * log2(max(1.0, n / max(1, t))))),
        0 if not last else 1 if last in ".!?" else 2 if last in ",;:" else 3 if last.isdigit() else 4,
        1 if ITEM.match(line) and w else 2 if "....." in line and w else 0,
        tenth(values, len(cells) - 1) if len(cells) > 1 else 0,
        min(BINS - 1, len(cells)),
        tenth(len(set(map(seen.bare.__getitem__, tokens))), t),
        min(BINS - 1, (1 + in_text).bit_length() - 1),
    )


FEATURES = 14


def text_lines(text: str) -> list[str]:
    return [x for x in text.split("\n") if x.strip()]


class LineModel:
    """Start, transition and binned emission probabilities (logs)."""

    def __init__(self, start: np.ndarray, step: np.ndarray, emit: np.ndarray):
        self.start, self.step, self.emit = start, step, emit

    @classmethod
    def fit(cls, texts: list[str], classes: list[str], seen: Tokens) -> LineModel:
        """All lines of a labelled text have its class; a line counts as a fraction of its text, so long texts don't dominate."""
        k = len(CLASSES)
        start, step, emit = np.ones(k), np.full((k, k), 0.01), np.full((k, FEATURES, BINS), 0.5)
        for text, name in zip(texts, classes):
            lines = text_lines(text)
            c = CLASSES.index(name)
            start[c] += 1
            step[c, c] += len(lines) - 1
            for line in lines:
                for f, b in enumerate(line_features(line, seen, len(lines))):
                    emit[c, f, b] += 1 / min(len(lines), 4)
        return cls(np.log(start / start.sum()), np.log(step / step.sum(axis=1, keepdims=True)), np.log(emit / emit.sum(axis=2, keepdims=True)))

    def viterbi(self, features: np.ndarray) -> np.ndarray:
        """The most likely states of the lines of one text."""
        log = self.emit[:, np.arange(FEATURES), features].sum(axis=2).T  # (lines, states)
        score = self.start + log[0]
        back = np.empty((len(log), len(CLASSES)), np.int8)
        for t in range(1, len(log)):
            options = score[:, None] + self.step
            back[t] = options.argmax(axis=0)
            score = options.max(axis=0) + log[t]
        states = np.empty(len(log), np.int8)
        states[-1] = score.argmax()
        for t in range(len(log) - 1, 0, -1):
            states[t - 1] = back[t][states[t]]
        return states

    def shares(self, text: str, seen: Tokens) -> np.ndarray | None:
        """Shares of the four classes in the text's characters; None for a blank text."""
        lines = text_lines(text)
        if not lines:
            return None
        states = self.viterbi(np.array([line_features(x, seen, len(lines)) for x in lines]))
        share = np.bincount(states, weights=[len(x) for x in lines], minlength=len(CLASSES))
        return share / share.sum()


WORD_BOUND = 100_000  # rows of a word list, which is sent to every task; more is an error


def listed(words: DataFrame) -> list[str]:
    """The words of a list in lower case."""
    found = words.select("word").where("word is not null").limit(WORD_BOUND + 1).collect()
    if len(found) > WORD_BOUND:
        raise ValueError(f"a word list has more than {WORD_BOUND} rows")
    return [r[0].lower() for r in found]


def _classify(model: LineModel, common: frozenset[str], known: frozenset[str]):
    def run(batches):
        seen = Tokens(common, known)
        for batch in batches:
            found = [model.shares(t, seen) for t in batch.column(1).to_pylist()]
            shares = np.array([np.zeros(len(CLASSES)) if s is None else s for s in found]).reshape(-1, len(CLASSES))
            names = [None if s is None else CLASSES[int(s.argmax())] for s in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), *(pa.array(shares[:, i]) for i in range(len(CLASSES)))], names=["id", "text_class", *(f"share_{c}" for c in CLASSES)])

    return run


def _text_elements(elements: DataFrame) -> DataFrame:
    """Elements of type text whose content is more than a filler."""
    rows = elements.select(F.col("element_id").cast("long").alias("id"), "type", "content").where("element_id is not null")
    kind = F.lower(F.regexp_replace("type", r"^\s+|\s+$", ""))
    return spread(rows).where((kind == "text") & (F.length(F.regexp_replace("content", r"^\s+|\s+$", "")) >= LEAST_CHARS)).select("id", "content")


def classify_texts(elements: DataFrame, labels: DataFrame, common_words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(element_id, text_class, share_prose, share_list, share_table, share_junk) for each text element.

    Null, blank and filler contents (up to three characters) have no row. The model is fitted on at most LABELLED labelled
    elements; without any label every text is prose. Texts are read whole. Equal shares go to the first class in the order of
    CLASSES; repeated labels of an element count as often as they stand there. Other columns aren't read.
    """
    common = frozenset(listed(common_words))
    known = common | frozenset(listed(lexicon))
    picked = labels.where(F.col("text_class").isin(*CLASSES) & F.col("element_id").isNotNull()).orderBy(F.xxhash64("element_id"), "element_id").limit(LABELLED)
    rows = _text_elements(elements).join(F.broadcast(picked.select(F.col("element_id").alias("id"), "text_class")), "id").orderBy("id").collect()
    model = LineModel.fit([r["content"] for r in rows], [r["text_class"] for r in rows], Tokens(common, known))
    schema = "id bigint, text_class string, " + ", ".join(f"share_{c} double" for c in CLASSES)
    return _text_elements(elements).mapInArrow(_classify(model, common, known), schema).where("text_class is not null").withColumnRenamed("id", "element_id")


def text_statistics(elements: DataFrame, common_words: DataFrame) -> DataFrame:
    """(element_id, n_words, mean_word_length, symbol_ratio, share_punctuated, share_common) for each text element, by built-in functions.

    Words are runs of letters; the symbol ratio counts what is no letter, digit or white space; lines are those that aren't blank.
    Contents as in classify_texts; a text without words has mean length and share 0. The word list is bounded and broadcast as
    an array.
    """
    content = F.col("content")
    words: Column = F.regexp_extract_all(F.lower(content), F.lit(r"\p{L}+"), 0)
    rows = _text_elements(elements).select("id", content, words.alias("words"))
    lines = F.filter(F.split(content, "\n"), lambda x: F.length(F.trim(F.regexp_replace(x, r"\s+", " "))) > 0)
    n = F.size("words")
    per = lambda a, b: F.when(b > 0, F.round(a / b, 6)).otherwise(F.lit(0.0))
    common = F.array(*[F.lit(w) for w in sorted(set(listed(common_words)))])
    return rows.select(
        F.col("id").alias("element_id"),
        n.cast("long").alias("n_words"),
        per(F.length(F.array_join("words", "")), n).alias("mean_word_length"),
        F.round(F.length(F.regexp_replace(content, r"[\p{L}\p{N}\s]", "")) / F.length(content), 6).alias("symbol_ratio"),
        per(F.size(F.filter(lines, lambda x: F.regexp_replace(x, r"\s+$", "").rlike(r"[.!?;:,]$"))), F.size(lines)).alias("share_punctuated"),
        per(F.size(F.filter("words", lambda x: F.array_contains(common, x))), n).alias("share_common"),
    )
