"""Problem 3: freely entered values mapped to a reference list.

The reference entries, under all their alias paths, form a trie; each distinct entered value is a Levenshtein automaton that walks it.
A state is what the distances near the diagonal can be, a step depends only on where the next sign stands in the value there, so
states and steps are worked out once for all values of a task. A branch is left as soon as no path below it can be within its limit.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The ways the unit's rank and its position are written.
RANKS = {
    "formation": "formation formatie form fm",
    "group": "group groep grp gp",
    "member": "member mbr mem mb",
    "sandstone": "sandstone sandst sst",
    "limestone": "limestone limest lst",
    "claystone": "claystone clayst clst",
}
POSITIONS = {"upper": "upper upr", "lower": "lower lwr", "middle": "middle mid"}
RANK_OF = {w: k for k, v in RANKS.items() for w in v.split()}
POSITION_OF = {w: k for k, v in POSITIONS.items() for w in v.split()}
LOOKALIKE = str.maketrans({"0": "o", "1": "l"})
CODE, CORE = "#", ""  # first sign of the paths of codes; positions are written before the core as "upper "


def allowed(length: int) -> int:
    """Edits allowed for a reference path of so many letters."""
    return 0 if length < 5 else 1 if length < 7 else 2 if length == 7 else 3


def parse(value: str) -> tuple[str, str, str, str]:
    """(core, position, rank, code form) of an entered value: accents, case, marks, remarks in parentheses and the order of the words don't count."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", value) if not unicodedata.combining(c)).lower()
    plain = re.sub(r"\([^)]*\)", " ", plain)
    core, position, rank = [], "", ""
    for word in re.findall(r"[a-z0-9-]+", plain.replace("_", " ")):
        word = word.strip("-")
        if word in RANK_OF:
            rank = rank or RANK_OF[word]
        elif word in POSITION_OF:
            position = position or POSITION_OF[word]
        elif word:
            core.append(word.replace("-", ""))
    joined = "".join(core)
    return (joined.translate(LOOKALIKE) if re.search("[a-z]", joined) else ""), position, rank, re.sub(r"[^a-z0-9]", "", plain)


MOST_EDITS = 3
BAND = 2 * MOST_EDITS + 1
FAR = MOST_EDITS + 1


class Automaton:
    """States (distances of the band, distances after a transposition) by number, and their steps.

    After d signs of a path the band holds the distance of these signs to the first d - 3 ... d + 3 signs of the value, at most FAR.
    A step is told by the bits of the places in the band at which the value has the path's next sign. Transpositions are one edit.
    """

    def __init__(self):
        first = (FAR,) * MOST_EDITS + tuple(range(MOST_EDITS + 1))
        self.bands: list[tuple[int, ...]] = []
        self.swaps: list[tuple[int, ...]] = []
        self.least: list[int] = []
        self.number: dict[tuple, int] = {}
        self.steps: dict[int, int] = {}
        self.start = self._state(first, (FAR,) * BAND)

    def _state(self, band: tuple[int, ...], swap: tuple[int, ...]) -> int:
        key = band, swap
        if key not in self.number:
            self.number[key] = len(self.bands)
            self.bands.append(band)
            self.swaps.append(swap)
            self.least.append(min(band))
        return self.number[key]

    def step(self, state: int, here: int) -> int:
        to = self.steps.get(state << BAND | here)
        if to is None:
            # both bands count from the value's place d - 3; the new one begins a place further
            old, swapped, new = self.bands[state] + (FAR,), self.swaps[state] + (FAR,), []
            for i in range(BAND):
                same = here >> i & 1
                value = min(old[i + 1] + 1, old[i] + (not same), (new[-1] + 1) if new else FAR)
                if i and here >> (i - 1) & 1:
                    value = min(value, swapped[i + 1])
                new.append(min(value, FAR))
            # the sign stands one place further on, so the next sign may end a transposition with it
            swap = tuple(min(FAR, old[i - 1] + 1) if i and here >> i & 1 else FAR for i in range(BAND))
            to = self.steps[state << BAND | here] = self._state(tuple(new), swap)
        return to


class Trie:
    """Alias paths of the reference entries; a node is [branches, entries, the largest limit of the paths below it]."""

    def __init__(self, entries: list[tuple[int, str, str | None]]):
        self.root: list = [{}, [], 0]
        self.longest = 0
        self.automaton = Automaton()
        parsed = [(i, *parse(name)[:3], parse(code or "")[3]) for i, name, code in entries]
        for i, core, position, rank, code in parsed:
            for path in {core, *([CODE + code] if code else [])}:
                limit = 0 if path.startswith(CODE) else allowed(len(path))
                node = self.root
                for sign in path:
                    node[2] = max(node[2], limit)
                    node = node[0].setdefault(sign, [{}, [], 0])
                node[2] = max(node[2], limit)
                node[1].append((i, position, rank))
                self.longest = max(self.longest, len(path))

    def at(self, word: str) -> list[tuple[int, int, str, str]]:
        """The entries whose path is the word."""
        node = self.root
        for sign in word:
            node = node[0].get(sign)
            if node is None:
                return []
        return [(0, *entry) for entry in node[1]]

    def within(self, word: str) -> list[tuple[int, int, str, str]]:
        """All (distance, id, position, rank) whose path is within its own length's limit of the word."""
        found: list[tuple[int, int, str, str]] = []
        n = len(word)
        if not n or n > self.longest + MOST_EDITS:
            return found
        places: dict[str, int] = {}
        for i, c in enumerate(word):  # bit i + MOST_EDITS: the band of the first step begins MOST_EDITS - 1 before the value
            places[c] = places.get(c, 0) | 1 << (i + MOST_EDITS)
        automaton, mask = self.automaton, (1 << BAND) - 1
        known, least, bands = automaton.steps, automaton.least, automaton.bands
        stack = [(self.root, 0, automaton.start)]
        while stack:
            node, depth, state = stack.pop()
            for sign, branch in node[0].items():
                here = places.get(sign, 0) >> depth & mask
                to = known.get(state << BAND | here)
                if to is None:
                    to = automaton.step(state, here)
                if least[to] <= branch[2]:
                    if branch[1]:
                        at = n - depth - 1 + MOST_EDITS
                        if 0 <= at < BAND and bands[to][at] <= allowed(depth + 1):
                            found += [(bands[to][at], *entry) for entry in branch[1]]
                    if branch[0]:
                        stack.append((branch, depth + 1, to))
        return found

    def candidates(self, value: str) -> list[tuple[int, int, str, str]]:
        """All entries within their limits of the entered value; where there are none, its last word may have been part of the name."""
        core, _, rank, _ = parse(value)
        hits = self.within(core)
        if not hits and rank:
            hits = self.within(parse(re.sub(r"[\s_.]+(?=\S+\s*$)", "", value.rstrip(" .*?")))[0])
        return hits

    def match(self, value: str) -> tuple[int, int | None, str, list[tuple[int, int]]]:
        """(id or 0, distance, how, all near (id, distance)): where several are equally close the position, then the rank decides, else none."""
        _, position, rank, code = parse(value)
        hits = self.candidates(value)
        near: dict[int, int] = {}
        for h in hits:
            near[h[1]] = min(h[0], near.get(h[1], FAR))
        all_near = sorted(near.items())
        hit = self.at(CODE + code) if code else []
        if hit and len({h[1] for h in hit}) == 1:
            return hit[0][1], 0, "code", all_near
        if not hits:
            return 0, None, "none", all_near
        best = min(h[0] for h in hits)
        close = [h for h in hits if h[0] == best]
        for n, told in ((2, position), (3, rank)):
            if len(close) > 1 and told:
                close = [h for h in close if h[n] == told] or close
        if len({h[1] for h in close}) > 1:
            return 0, best, "ambiguous", all_near
        return close[0][1], best, ("near" if best else "written"), all_near


NEAR = "array<struct<formation_id:int,distance:int>>"


def _match(entries: list[tuple[int, str, str | None]]):
    def run(batches):
        trie = Trie(entries)
        cache: dict[tuple, tuple] = {}
        for batch in batches:
            values = batch.column(0).to_pylist()
            out = []
            for v in values:
                key = parse(v)
                if key not in cache:
                    if len(cache) > 200_000:
                        cache.clear()
                    cache[key] = trie.match(v)
                out.append(cache[key])
            near = pa.array([[{"formation_id": i, "distance": d} for i, d in o[3]] for o in out], pa.list_(pa.struct([("formation_id", pa.int32()), ("distance", pa.int32())])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.string()), near],
                names=["entry", "formation_id", "distance", "how", "near"],
            )

    return run


def map_entries(meta: DataFrame, reference: DataFrame, id_col: str = "meta_id", list_col: str = "formations", bound: int = 200_000) -> DataFrame:
    """(id, pos, entry, formation_id, distance, how, near) for each entry that is neither null nor blank.

    near: all entries of the list (formation_id, distance) within the limit of their length, none left out. how: exact (a name of the list), written (the name but for its writing), code, near, ambiguous or none; the last two have
    formation_id 0 and are the ones to report. Each distinct value is looked up once, so a value that a third of all rows share
    costs one search; the join back splits hot values. Null arrays and null ids give no rows; equal rows equal results. The list
    is a bounded table, more than `bound` rows are an error.
    """
    spark = meta.sparkSession
    listed = reference.select("formation_id", "formation_name", "code").where("formation_id is not null and formation_name is not null").limit(bound + 1).collect()
    if len(listed) > bound:
        raise ValueError(f"the reference list has more than {bound} rows")
    entries = [(r[0], r[1], r[2]) for r in listed]
    rows = meta.select(F.col(id_col).alias("id"), F.posexplode(list_col).alias("pos", "entry")).where("id is not null and entry is not null and entry rlike r'\\S'")
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    distinct = rows.select("entry").distinct().repartition(parts)  # few bytes but much work each: kept in as many tasks as there are cores
    exact = spark.createDataFrame([(r[1], r[0]) for r in listed], "entry string, exact_id int").dropDuplicates(["entry"])
    found = distinct.mapInArrow(_match(entries), f"entry string, formation_id int, distance int, how string, near {NEAR}")
    found = found.join(F.broadcast(exact), "entry", "left")
    found = found.select("entry", F.coalesce("exact_id", "formation_id").alias("formation_id"), F.when(F.col("exact_id").isNotNull(), 0).otherwise(F.col("distance")).alias("distance"), F.when(F.col("exact_id").isNotNull(), "exact").otherwise(F.col("how")).alias("how"), "near")
    return rows.join(found, "entry").select(F.col("id").alias(id_col), "pos", "entry", "formation_id", "distance", "how", "near")
