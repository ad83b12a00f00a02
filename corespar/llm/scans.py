"""Problem 4: text of scanned pages repaired into continuous paragraphs.

Running headers are lines that stand on several pages of a source, found by counting hashed lines over all scanned elements. The rest
is a noisy channel: what was printed is a lexicon word, what was read differs by character confusions. How likely each confusion is, is
estimated from all scanned text against the lexicon; candidates come from a trie of the lexicon, the likeliest first, also for
words that are in the lexicon themselves; and Viterbi takes, paragraph by paragraph, the sequence with the best confusion times bigram
probability. Bigrams are counted over the whole text that wasn't scanned.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corespar.session import stored
from corespar.tables import spread

# What is printed -> what scanning makes of it.
CONFUSIONS = [
    ("u", "ii"), ("h", "b"), ("i", "l"), ("e", "c"), ("d", "cl"), ("n", "ri"), ("m", "rn"), ("w", "vv"), ("s", "5"), ("o", "0"), ("l", "1"), ("i", "1"),
    ("t", "f"), ("g", "9"), ("b", "6"), ("cl", "d"), ("rn", "m"), ("ri", "n"), ("vv", "w"), ("l", "i"), ("b", "h"), ("c", "e"), ("f", "t"), ("z", "2"), ("b", "8"), ("ii", "u"), ("q", "9"), ("g", "6"), ("li", "h"),
]
MARKS = "-‐‑­¬"
PRIOR_SEEN, PRIOR_PRINTED = 1.0, 100.0  # a confusion counts as seen once in a hundred printed places before any is counted
MARGIN = 7.0  # a candidate may be so much less likely (in logs) than the likeliest by confusions alone
DOUBT = 3.0  # a word that is in the lexicon is taken as read unless another sequence is so much likelier (in logs)
HEADER_PAGES = 3
PAGE_ALONE = re.compile(r"\s*(?:page\s*(\d+)(?:\s*of\s*\d+)?|p\.\s*(\d+)|(\d+)\s*/\s*\d+|\[(\d+)\]|[-–—]\s*(\d+)\s*[-–—]|(\d+))\s*$", re.I)
ROMAN_ALONE = re.compile(r"\s*[-–—\[]?\s*([ivxlc]+)\s*[-–—\]]?\s*$")
ROMAN_END = re.compile(r"^\s*([ivxlc]+)\s+(?=\S+\s+\S)|\s+([ivxlc]+)\s*$")
PAGE_WORDS = re.compile(r"\b(?:page|p\.)\s*\d+(?:\s*of\s*\d+)?|\[\d+\]|\b\d+/\d+\b", re.I)
PAGE_INSIDE = re.compile(r"^\s*(?:page\s*|p\.\s*|\[)?(\d+)\]?(?:\s*of\s*\d+|/\d+)?\s+|\s+(?:page\s*|p\.\s*|\[)?(\d+)\]?(?:\s*of\s*\d+|/\d+)?\s*$", re.I)
WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")


def roman(number: int) -> str:
    out = ""
    for value, sign in ((100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        while number >= value:
            out, number = out + sign, number - value
    return out


def line_key(line: str) -> str | None:
    """What a running header has in common on all pages: the line without case, spaces and numbers; None for running text."""
    line = ROMAN_END.sub(" ", line)
    words = [w for w in line.split() if any(c.isalpha() for c in w)]
    if len(words) < 2 or line.rstrip()[-1:] in ".,;:" or any(w[0].islower() for w in words if w.lower() not in ("page", "of", "p.")):
        return None
    key = re.sub(r"[\s\d]+", "", PAGE_WORDS.sub("", line).lower())
    return key if len(key) >= 4 else None


def line_hash(source: str, key: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{source}\x1f{key}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


class Bigrams:
    """Counts of pairs of lexicon words, kept sorted by a * size + b."""

    def __init__(self, size: int, pairs: np.ndarray, counts: np.ndarray):
        order = np.argsort(pairs)
        self.size, self.pairs, self.counts = size, pairs[order], counts[order]
        self.single = np.bincount((self.pairs // max(1, size)).astype(np.int64), weights=self.counts, minlength=size)
        self.known: dict[int, int] = {}

    def count(self, a: int, b: int) -> int:
        key = a * self.size + b
        n = self.known.get(key)
        if n is None:
            if len(self.known) > 1_000_000:
                self.known.clear()
            at = int(np.searchsorted(self.pairs, key))
            n = self.known[key] = int(self.counts[at]) if at < len(self.pairs) and self.pairs[at] == key else 0
        return n


class Channel:
    """Candidates of read words, and the likelihood of their sequence.

    costs: minus the log probability of each confusion (printed, seen). Without, each has that of the prior.
    """

    def __init__(self, lexicon: list[str], follows: Bigrams | None = None, costs: dict[tuple[str, str], float] | None = None):
        self.words = sorted(set(lexicon))
        self.number = {w: i for i, w in enumerate(self.words)}
        self.trie: dict = {}
        for w in self.words:
            node = self.trie
            for c in w:
                node = node.setdefault(c, {})
            node[None] = w
        self.longest = max(map(len, self.words), default=0)
        self.follows = follows or Bigrams(len(self.words), np.zeros(0, np.int64), np.zeros(0, np.int64))
        costs = costs or {}
        self.confusions: dict[str, list[tuple[str, str, float]]] = {}
        for printed, seen in CONFUSIONS:
            self.confusions.setdefault(seen[0], []).append((printed, seen, costs.get((printed, seen), math.log(PRIOR_PRINTED / PRIOR_SEEN))))
        self.cache: dict[str, list[tuple[str, float]]] = {}

    def candidates(self, read: str) -> list[tuple[str, float]]:
        """(word, cost) for a read word in lower case, the likeliest first, as far as MARGIN from it. The word itself costs nothing."""
        got = self.cache.get(read)
        if got is None:
            if len(self.cache) > 500_000:
                self.cache.clear()
            got = self.cache[read] = self._search(read)
        return got

    def _search(self, read: str) -> list[tuple[str, float]]:
        # a printed sign gives two read ones at most, so longer words can't be any of the lexicon
        if len(read) < 2 or read.isdigit() or len(read) > 2 * self.longest:
            return []
        best: dict[str, float] = {}
        most = math.inf
        heap: list[tuple[float, int, int]] = [(0.0, 0, 0)]  # cost, place in the word, number of the node
        nodes, done = [self.trie], set()
        place = {id(self.trie): 0}
        while heap and heap[0][0] <= most:  # the least cost first: no word and no number of confusions is left out
            cost, i, at = heapq.heappop(heap)
            if (i, at) in done:
                continue
            done.add((i, at))
            node = nodes[at]
            if i == len(read):
                if None in node and node[None] not in best:
                    best[node[None]] = cost
                    most = min(most, cost + MARGIN)
                continue
            steps = [(node.get(read[i]), i + 1, cost)]
            for printed, seen, more in self.confusions.get(read[i], ()):
                if read.startswith(seen, i):
                    to = node
                    for c in printed:
                        to = to.get(c) if to is not None else None
                    steps.append((to, i + len(seen), cost + more))
            for to, j, total in steps:
                if to is not None:
                    number = place.setdefault(id(to), len(nodes))
                    if number == len(nodes):
                        nodes.append(to)
                    heapq.heappush(heap, (total, j, number))
        found = sorted(best.items(), key=lambda x: (x[1], x[0]))
        if found and found[0][1] == 0:  # a word of the lexicon: others must be likelier by DOUBT
            return [found[0], *((w, c + DOUBT) for w, c in found[1:])]
        return found

    def _log_follow(self, a: str | None, b: str | None) -> float:
        if a is None or b is None:
            return math.log(1 / len(self.words)) if self.words else 0.0
        i, j = self.number[a], self.number[b]
        return math.log((self.follows.count(i, j) + 0.1) / (self.follows.single[i] + 0.1 * len(self.words)))

    def decode(self, options: list[list[tuple[str, float]]]) -> list[str | None]:
        """Viterbi over a sequence of words; a word without candidates stays as it is (None)."""
        if all(len(o) < 2 for o in options):
            return [o[0][0] if o else None for o in options]
        scores, back = [(0.0, None)], []
        for o in options:
            new, links = [], []
            for word, cost in o or [(None, 0.0)]:
                k, s = max(enumerate(s + self._log_follow(w, word) for s, w in scores), key=lambda x: x[1])
                new.append((s - cost, word))
                links.append(k)
            scores = new
            back.append((links, [w for _, w in new]))
        k = max(range(len(scores)), key=lambda i: scores[i][0])
        out = []
        for links, words in reversed(back):
            out.append(words[k])
            k = links[k]
        return out[::-1]


def _recase(read: str, word: str) -> str:
    if read.isupper() and len(read) > 2:
        return word.upper()
    return word[:1].upper() + word[1:] if read[:1].isupper() else word


class Repair:
    def __init__(self, channel: Channel):
        self.channel = channel

    def strip_layout(self, text: str, page: int | None, is_header) -> tuple[list[str], set[str]]:
        """The lines without running headers and page numbers ('' keeps a paragraph's place), and the kinds found."""
        kinds, lines = set(), []
        for line in text.split("\n"):
            m = PAGE_ALONE.match(line)
            if m and (page is None or int(next(g for g in m.groups() if g)[:9]) == page):
                kinds.add("page_number")
                continue
            m = ROMAN_ALONE.match(line)
            if m and page is not None and 0 < page < 400 and m.group(1) == roman(page):
                kinds.add("page_number")
                continue
            if is_header(line):
                kinds.add("running_header")
                if any(page is None or int((m.group(1) or m.group(2))[:9]) == page for m in PAGE_INSIDE.finditer(line)) or any(page is not None and 0 < page < 400 and (m.group(1) or m.group(2)) == roman(page) for m in ROMAN_END.finditer(line)):
                    kinds.add("page_number")
                continue
            lines.append(line.strip())
        return lines, kinds

    def join(self, first: str, second: str) -> tuple[str, set[str]]:
        """A word divided at a line's end and the head of the next line as one, with the kinds of noise told by it."""
        tail, head = WORD.findall(first[:-1])[-1:] or [""], WORD.match(second)
        if not tail[0] or not head or not first[:-1].endswith(tail[0]):
            return first + " " + second, set()
        a, b = tail[0], head.group(0)
        before, after = first[: -1 - len(a)], second[head.end() :]
        for glue in ("-", ""):
            if (a + glue + b).lower() in self.channel.number:
                return before + a + glue + b + after, (set() if glue else {"broken_word"})
        for glue in ("", "-"):
            found = self.channel.candidates((a + glue + b).lower())
            if found:
                word = min(found, key=lambda f: f[1])[0]
                return before + _recase(a, word) + after, ({"misread"} if glue else {"broken_word", "misread"})
        return before + a + ("-" if first[-1] in "-‐‑" and not b[0].islower() else "") + b + after, set()

    def words(self, line: str) -> tuple[str, bool]:
        """The line with its misread words put right, and whether any was."""
        spans = list(WORD.finditer(line))
        options = [self.channel.candidates(m.group(0).lower()) for m in spans]
        if all(not o or len(o) == 1 and o[0][1] == 0 for o in options):
            return line, False
        out, at = [], 0
        for m, word in zip(spans, self.channel.decode(options)):
            if word is not None and word != m.group(0).lower():
                out += [line[at : m.start()], _recase(m.group(0), word)]
                at = m.end()
        return "".join([*out, line[at:]]), at > 0

    def text(self, text: str, page: int | None, is_header) -> tuple[str, set[str]]:
        lines, kinds = self.strip_layout(text, page, is_header)
        paragraphs: list[str] = []
        for line in lines:
            if not line:
                if paragraphs and paragraphs[-1] and paragraphs[-1][-1] in ".!?:":
                    paragraphs.append("")
                continue
            if not paragraphs:
                paragraphs.append(line)
            elif not paragraphs[-1]:
                paragraphs[-1] = line
            elif paragraphs[-1][-1] in MARKS:
                last, _, rest = paragraphs[-1].rpartition(" ")
                joined, more = self.join(rest, line)
                kinds |= more
                paragraphs[-1] = f"{last} {joined}" if last else joined
            else:
                paragraphs[-1] += " " + line
        fixed = []
        for p in paragraphs:
            if p:
                p, changed = self.words(p)
                if changed:
                    kinds.add("misread")
                fixed.append(re.sub(r"\s+", " ", p))
        return "\n\n".join(fixed), kinds


def _header_lines(batches):
    for batch in batches:
        seen = set()
        for source, page, text in zip(*(c.to_pylist() for c in batch.columns)):
            for line in text.split("\n"):
                key = line_key(line) if line.strip() else None
                if key:
                    seen.add((line_hash(source, key), page))
        keys = sorted(seen)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.int64()), pa.array([p for _, p in keys], pa.int32())], names=["key", "page"])


def _bigrams(lexicon: list[str]):
    def run(batches):
        number = {w: i + 1 for i, w in enumerate(sorted(set(lexicon)))}
        size = len(number)
        for batch in batches:
            text = " \x00 ".join(t for t in batch.column(0).to_pylist() if t)
            ids = np.array([number.get(w, 0) for w in re.findall(r"[\w'’-]+|\x00", text.lower())], np.int64)
            both = (ids[:-1] > 0) & (ids[1:] > 0)
            pairs, n = np.unique((ids[:-1][both] - 1) * size + ids[1:][both] - 1, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n.astype(np.int64))], names=["pair", "n"])

    return run


def _confusions(lexicon: list[str]):
    """(printed, seen, n, places) over the words of scanned text: how often a confusion explains a word that is not in the lexicon
    (shared by all that explain it as well), and in how many places of words that are its printed side stands."""

    def run(batches):
        channel = Channel(lexicon)
        for batch in batches:
            told: dict[tuple[str, str], float] = {}
            places: dict[str, int] = {}
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if word in channel.number:
                    for printed in {p for p, _ in CONFUSIONS}:
                        if printed in word:
                            places[printed] = places.get(printed, 0) + n * word.count(printed)
                    continue
                single = [(p, s) for p, s in CONFUSIONS for i in range(len(word)) if word.startswith(s, i) and word[:i] + p + word[i + len(s) :] in channel.number]
                for pair in single:
                    told[pair] = told.get(pair, 0.0) + n / len(single)
            keys = sorted(told.keys() | {c for c in CONFUSIONS if c[0] in places})
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([told.get(k, 0.0) for k in keys], pa.float64()), pa.array([places.get(k[0], 0) for k in keys], pa.int64())],
                names=["printed", "seen", "n", "places"],
            )

    return run


def _read_words(batches):
    for batch in batches:
        counts: dict[str, int] = {}
        for text in batch.column(0).to_pylist():
            for word in WORD.findall(text.lower()):
                counts[word] = counts.get(word, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])


def confusion_costs(scanned: DataFrame, lexicon: list[str]) -> dict[tuple[str, str], float]:
    """Minus the log probability of each confusion, from the words of all scanned texts (content), with PRIOR_SEEN in PRIOR_PRINTED."""
    words = scanned.select("content").mapInArrow(_read_words, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    told = words.mapInArrow(_confusions(lexicon), "printed string, seen string, n double, places bigint").groupBy("printed", "seen").agg(F.sum("n").alias("n"), F.sum("places").alias("places"))
    return {(r["printed"], r["seen"]): -math.log(min(0.5, (r["n"] + PRIOR_SEEN) / (r["n"] + r["places"] + PRIOR_PRINTED))) for r in told.collect()}  # at most one row for each confusion


def _repair(lexicon: list[str], follows, costs: dict[tuple[str, str], float]):
    def run(batches) -> Iterator[pa.RecordBatch]:
        repair = Repair(Channel(lexicon, Bigrams(*follows.value), costs))
        for batch in batches:
            texts, kinds = [], []
            for source, page, text, headers in zip(*(c.to_pylist() for c in batch.columns[1:])):
                known = set(headers or ())
                is_header = (lambda line: bool(line.strip()) and (key := line_key(line)) is not None and line_hash(source, key) in known) if known else (lambda line: False)
                fixed, found = repair.text(text, page, is_header)
                texts.append(fixed)
                kinds.append(sorted(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(kinds, pa.list_(pa.string()))], names=["id", "repaired", "noise_kinds"])

    return run


LEXICON_BOUND = 1_000_000  # words: what is sent to the tasks must have a bound, a larger lexicon is an error
BIGRAM_BOUND = 20_000_000  # different pairs of lexicon words next to each other, 16 bytes each


def repair_scans(elements: DataFrame, lexicon: DataFrame, id_col: str = "element_id") -> DataFrame:
    """(id, repaired, noise_kinds) for each text element whose extractor is ocr and whose content isn't null.

    Without a source nothing can be told to be a running header; without a page number a number alone on its line is taken to be
    one. Blank contents give an empty text and no kinds. Texts are read whole; equal rows give equal results. Uses the columns
    element_id, source, type, content, page and attrs.
    """
    spark = elements.sparkSession
    words = [r[0].lower() for r in lexicon.select("word").where("word is not null").limit(LEXICON_BOUND + 1).collect()]
    if len(words) > LEXICON_BOUND:
        raise ValueError(f"the lexicon has more than {LEXICON_BOUND} words")
    is_text = F.lower(F.trim("type")) == "text"
    rows = spread(elements.select(F.col(id_col).cast("long").alias("id"), "source", "page", "content", F.col("attrs")["extractor"].alias("extractor"), "type"))
    scanned = rows.where(is_text & (F.col("extractor") == "ocr") & F.col("content").isNotNull()).select("id", "source", F.col("page").cast("int").alias("page"), "content")
    plain = rows.where(is_text & F.col("content").isNotNull() & (F.coalesce("extractor", F.lit("")) != "ocr")).select("content")
    counted = stored(plain.mapInArrow(_bigrams(words), "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")))
    if counted.count() > BIGRAM_BOUND:
        raise ValueError(f"more than {BIGRAM_BOUND} different pairs of lexicon words")
    pairs = counted.toArrow()
    follows = len(set(words)), pairs.column("pair").to_numpy().copy(), pairs.column("n").to_numpy().copy()
    costs = confusion_costs(scanned, words)
    pages = scanned.where("source is not null and page is not null").select("source", "page", "content").mapInArrow(_header_lines, "key bigint, page int")
    headers = pages.distinct().groupBy("key").count().where(F.col("count") >= HEADER_PAGES).select("key")
    return _with_headers(scanned, stored(headers), words, spark.sparkContext.broadcast(follows), costs).withColumnRenamed("id", id_col)


def _own_lines(batches):
    for batch in batches:
        ids, keys = [], []
        for i, source, text in zip(*(c.to_pylist() for c in batch.columns)):
            for key in {line_hash(source, k) for line in text.split("\n") if line.strip() and (k := line_key(line))}:
                ids.append(i)
                keys.append(key)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.int64())], names=["id", "key"])


def _with_headers(scanned: DataFrame, headers: DataFrame, words: list[str], follows, costs: dict[tuple[str, str], float]) -> DataFrame:
    """Each element meets only those headers that are among its own lines, so no source's rows are brought together."""
    own = scanned.where("source is not null").select("id", "source", "content").mapInArrow(_own_lines, "id bigint, key bigint")
    found = own.join(headers, "key").groupBy("id").agg(F.collect_set("key").alias("headers"))
    met = scanned.join(found, "id", "left").select("id", "source", "page", "content", "headers")
    return met.mapInArrow(_repair(words, follows, costs), "id bigint, repaired string, noise_kinds array<string>")
