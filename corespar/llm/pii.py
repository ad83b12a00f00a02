"""Problem 10: personal items inside free text, and their typed, format-preserving pseudonyms.

Spans are found by patterns in one pass over each whole text, inside Arrow batches. Placeholders keep their type and a pseudonym:
numbers and dates are permuted within their own format by a keyed Feistel network, so the same value has the same pseudonym in
every document and nothing has to be looked up, joined or shuffled. Where a format has a check (the eleven test, the areas and
groups of a social security number, the calendar), a value that passes it gets one that passes it, and one that fails one that fails.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from bisect import bisect
from collections.abc import Iterator
from datetime import date
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corespar.tables import spread

# Forms of the items.
EMAIL_MARK = r"@|\(at\)|\[at\]"
EMAIL_HOST = r"\s?[A-Za-z0-9-]+(?:(?:\.|\[dot\]|\(dot\))[A-Za-z0-9-]+)*(?:\.|\[dot\]|\(dot\))[A-Za-z]{2,}"
PHONE = (
    r"\+\d{1,4}(?:[ ./-]?\(\d{1,4}\)|[ ./-]?\d)(?:[ ./-]?\d){6,11}"  # international, with plus
    r"|00\d{2} \d{2,4}(?: \d{2,6}){1,4}"  # international, with 00
    r"|\(0?\d{2}\) \d{4} \d{4}|\(\d{3}\) ?\d{3}-\d{4}"  # area code in parentheses
    r"|\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4}"
    r"|0\d(?:[ .]\d{2}){4}|0\d{4} \d{6}|0\d{2,3} \d{5,7}(?:[ -]\d{2,4})?|0\d{2,4}[/-]\d{6,8}"
)
ID_LABEL = (
    "passport|passeport|paspoort|reisepass|identity card|identiteitskaart|personalausweis|carte d'identité|carte d’identité|bsn|burgerservicenummer"
    "|ssn|social security number|social security no|social security|national identity number|national ID number|national ID|numéro de sécurité sociale"
    "|sozialversicherungsnummer|rijksregisternummer|driving licence|driving license|rijbewijs|führerschein|tax ID|steuer-ID"
)
ID_VALUE = r"[A-Z]{0,2}\d[0-9A-Z]*(?:[ .-][0-9A-Z]*\d[0-9A-Z]*){0,3}(?:-[A-Z](?![A-Za-z0-9]))?"
STREET_END = r"(?:straat|straße|strasse|str\.|gasse|kade|weg|laan|gracht|plein|platz|allee|dijk|singel|damm|ufer|steeg)"
STREET_WORD = r"(?:Close|Quay|Road|Street|Lane|Avenue|Drive|Way|Court|Terrace|Square|Crescent|Gardens|Row|Place|Hill|Rd|St|Ave)"
STREET_KIND = r"(?:rue|avenue|boulevard|quai|place|chemin|impasse|allée|cours|route)"
CAP = r"[A-ZÀ-ÖØ-Þ][\w'’-]+"
ADDRESS = (
    rf"(?:Flat \d+[A-Za-z]?, )?\d+[A-Za-z]? {CAP}(?: {CAP})? {STREET_WORD}\b"
    rf"|\d+(?: ?(?:bis|ter|[a-z]))?,? {STREET_KIND} (?:de la |de l['’]|des |de |du |d['’])?{CAP}"
    rf"|[A-ZÀ-ÖØ-Þ][\w'’-]*?{STREET_END} \d+ ?(?:[a-z]\b|bis\b)?"
    rf"|(?:Am|An der|Auf der|Auf dem) {CAP} \d+[a-z]?(?=,|\.|;|\s|$)(?! ?[.,]?\d| (?:m|bar|meter|Uhr|Tage|Stunden)\b)"
)
TOWN = rf"(?:,? (?:\d{{4}} ?[A-Z]{{2}}|\d{{4,5}}) {CAP}|, {CAP})?"
TITLES = r"(?:Mr|Mrs|Ms|Mme|Mlle|Herr|Frau|Dr|Prof|Ir|Ing|dhr|mevr|Dhr|Mevr|Monsieur|Madame|De heer|Mevrouw)\.?"
PARTICLES = r"(?:(?:de|van|von|der|den|du|la|le|ten|ter|zu|DE|VAN|VON|DER|DEN|DU) )*"
FAMILY = r"(?!Signed\b|Contact\b|Present\b|Name\b)[A-ZÀ-ÖØ-Þ][\w'’]+(?:-[A-Z][\w'’]+)?"

PHONE_RX = re.compile(rf"(?<![\w.+/(-])(?:{PHONE})(?![\w/]|[.,-]\d| \d)")
MARK_RX, HOST_RX = re.compile(EMAIL_MARK), re.compile(EMAIL_HOST)
LABELS = "|".join(f"{x}|{x[0].upper()}{x[1:]}|{x.upper()}" for x in ID_LABEL.split("|"))
ID_RX = re.compile(rf"(?<!\w)(?:{LABELS})(?: (?:no|nr|number|n°|nummer|num[eé]ro)\b\.?| n°| no\.| nr\.)?[ :=#]*(?P<v>{ID_VALUE})")
ADDRESS_RX = re.compile(rf"(?<![\w.-])(?:{ADDRESS}){TOWN}")
FAMILY_RX = re.compile(FAMILY)
BIRTH = r"(?:born(?: on)?|date of birth|d\.o\.b\.|geboren(?: op| am)?|geboortedatum|geburtsdatum|née? le|date de naissance)"
DATE_RX = re.compile(rf"(?i:\b{BIRTH})[ :]*(?P<v>\d{{4}}-\d{{2}}-\d{{2}}|\d{{2}}([./-])\d{{2}}\2\d{{4}})(?!\d)")


def local_part(text: str, end: int) -> int | None:
    """Where the local part of an e-mail address begins that ends before `end` (a space may stand between); None without one."""
    at = end = end - 1 if end and text[end - 1].isspace() else end
    while at and (text[at - 1].isalnum() or text[at - 1] in "_.+-"):
        at -= 1
    return at if at < end and (text[at] == "_" or text[at].isascii() and text[at].isalnum()) else None


def family_before(text: str, start: int) -> tuple[int, str] | None:
    """The family name, and its place, of "Family, Given", where the given name begins at `start`."""
    if text[max(0, start - 2) : start] != ", ":
        return None
    at = end = start - 2
    while at and (text[at - 1].isalnum() or text[at - 1] in "_'’-"):
        at -= 1
    for i in range(at, end):
        if i and (text[i - 1].isalnum() or text[i - 1] in "_@.+°-"):
            continue
        if FAMILY_RX.fullmatch(text, i, end):
            return i, text[i:end]
    return None


def names_rx(given: list[str]) -> tuple[re.Pattern, re.Pattern]:
    """Patterns for names that are told by a listed given name, and for those told by an initial or a title."""
    known = "|".join(re.escape(x) for x in sorted({g for n in given for g in (n, n.upper())}, key=lambda x: (-len(x), x)))
    by_given = re.compile(rf"(?<![\w@.+°-])(?:{known})(?![\w@])(?!\.\w)(?P<rest>(?: [A-Z]\.)* {PARTICLES}{FAMILY})?")
    by_sign = re.compile(rf"(?<![\w@.+°-])(?:(?P<a>{FAMILY}), (?:[A-Z]\. ?)+(?!\w)|(?P<b>(?:[A-Z]\. ?)+{PARTICLES}{FAMILY})|{TITLES} (?P<c>{PARTICLES}{FAMILY}))")
    return by_given, by_sign


def _eleven(digits: str) -> bool:
    """The check of a Dutch service number."""
    return sum(int(d) * w for d, w in zip(digits, (9, 8, 7, 6, 5, 4, 3, 2, -1))) % 11 == 0


def _social(digits: str) -> bool:
    """Areas, groups and serials that a US social security number can have."""
    return digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"


# Checks by layout: three, two and four digits apart, or nine digits however they are parted.
CHECKS = [(re.compile(r"\d{3}[ -]\d{2}[ -]\d{4}"), _social), (re.compile(r"\d{9}|\d{4}\.\d{2}\.\d{3}"), _eleven)]


class Finder:
    """Finds the spans of one text; the word lists are bounded tables passed in once per task."""

    def __init__(self, given: list[str], family: list[str], ordinary: list[str], dates: bool = False):
        self.dates = dates
        self.by_given, self.by_sign = names_rx(given)
        self.family = {x.lower() for x in family}
        self.ordinary = {x.lower() for x in ordinary}

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        found: list[tuple[str, int, int]] = []
        for m in MARK_RX.finditer(text):
            local, host = local_part(text, m.start()), HOST_RX.match(text, m.end())
            if local is not None and host:
                found.append(("email", local, host.end()))
        for m in ID_RX.finditer(text):
            value = m.group("v")
            if value.upper() == value and sum(c.isdigit() for c in value) >= 5:
                found.append(("id_number", m.start("v"), m.end("v")))
        found += [("phone", m.start(), m.end()) for m in PHONE_RX.finditer(text)]
        found += [("address", m.start(), m.end()) for m in ADDRESS_RX.finditer(text)]
        found += [("name", a, b) for a, b in self._names(text)]
        if self.dates:
            found += [("date", m.start("v"), m.end("v")) for m in DATE_RX.finditer(text)]
        rank = {"email": 0, "id_number": 1, "phone": 2, "date": 3, "address": 4, "name": 5}
        starts: list[int] = []
        kept: list[tuple[str, int, int]] = []  # in the order of their places; only neighbours can overlap
        for item in sorted(found, key=lambda s: (rank[s[0]], s[1], -s[2])):
            at = bisect(starts, item[1])
            if (not at or kept[at - 1][2] <= item[1]) and (at == len(kept) or kept[at][1] >= item[2]):
                starts.insert(at, item[1])
                kept.insert(at, item)
        return kept

    def _names(self, text: str) -> Iterator[tuple[int, int]]:
        for m in self.by_given.finditer(text):
            rest = m.group("rest")
            whole = rest is not None and rest.split()[-1].lower() not in self.ordinary
            before = family_before(text, m.start())
            if before and before[1].lower() not in self.ordinary and (not whole or before[1].isupper()):
                yield before[0], m.start() + len(m.group(0)) - len(rest or "")
            elif whole:
                yield m.start(), m.end()
        for m in self.by_sign.finditer(text):
            kind = m.lastgroup
            word = re.findall(r"[\w'’-]+", m.group(kind))[-1]
            if len(word) > 2 and word.lower() not in self.ordinary:
                yield (m.start(kind), m.end()) if kind == "a" else (m.start(kind), m.end(kind))


LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _mac(key: bytes, *parts: object) -> int:
    return int.from_bytes(hmac.new(key, "\x1f".join(map(str, parts)).encode(), hashlib.sha256).digest()[:16], "big")


def feistel(value: int, size: int, key: bytes, tweak: str, rounds: int = 8) -> int:
    """A keyed permutation of range(size): an unbalanced Feistel network on a * b >= size, walked until it falls inside."""
    if size < 2:
        return value
    a = int(size**0.5)
    while a * a < size:
        a += 1
    b = -(-size // a)
    while True:
        left, right = divmod(value, b)
        for r in range(rounds):
            if r % 2 == 0:
                left = (left + _mac(key, tweak, size, r, right)) % a
            else:
                right = (right + _mac(key, tweak, size, r, left)) % b
        value = left * b + right
        if value < size:
            return value


FIRST_DAY, DAYS = date(1900, 1, 1).toordinal(), date(2100, 1, 1).toordinal() - date(1900, 1, 1).toordinal()


def _other_date(value: str, key: bytes) -> str | None:
    """A date of 1900 to 2099 permuted among these days, in its own layout; None for what is none."""
    parts = re.split(r"[./-]", value)
    year_first = len(parts[0]) == 4
    try:
        day = date(*map(int, parts if year_first else parts[::-1])).toordinal() - FIRST_DAY
    except ValueError:
        return None
    if not 0 <= day < DAYS:
        return None
    other = date.fromordinal(FIRST_DAY + feistel(day, DAYS, key, "date"))
    mark = value[4] if year_first else value[2]
    fresh = [f"{other.year:04d}", f"{other.month:02d}", f"{other.day:02d}"]
    return mark.join(fresh if year_first else fresh[::-1])


def pseudonym(value: str, kind: str, key: bytes) -> str:
    """The value with its letters and digits permuted within their own format; layout and letter case stay.

    Numbers equal but for their layout get the same digits. A number of a layout with a check is permuted among those that
    pass it, or among those that don't, as it does itself; dates among dates. Names, addresses and e-mail addresses have no format to
    keep: they get a keyed tag of 128 bits, which is equal for values equal but for case and spaces; so does a date that is none.
    """
    if kind == "date" and (other := _other_date(value, key)):
        return other
    if kind in ("phone", "id_number"):
        check = next((c for layout, c in CHECKS if kind == "id_number" and layout.fullmatch(value)), None)
        signs = [c for c in value if c in "0123456789" or c.upper() in LETTERS]
        size = number = 0
        size = 1
        for c in signs:
            base, digit = (10, int(c)) if c in "0123456789" else (26, LETTERS.index(c.upper()))
            size, number = size * base, number * base + digit
        digits = len(signs)
        passes = check is not None and check(f"{number:0{digits}d}")
        number = feistel(number, size, key, kind)
        while check is not None and check(f"{number:0{digits}d}") != passes:
            number = feistel(number, size, key, kind)
        fresh = []
        for c in reversed(signs):
            base = 10 if c in "0123456789" else 26
            number, digit = divmod(number, base)
            fresh.append(str(digit) if base == 10 else (LETTERS[digit] if c.isupper() else LETTERS[digit].lower()))
        it = iter(reversed(fresh))
        return "".join(next(it) if (c in "0123456789" or c.upper() in LETTERS) else c for c in value)
    return f"{_mac(key, kind, ' '.join(value.lower().split())):032x}"


def mask(text: str, spans: list[tuple[str, int, int]], make) -> str:
    out, at = [], 0
    for kind, a, b in spans:
        out += [text[at:a], f"[{kind.upper()}:{make(text[a:b], kind)}]"]
        at = b
    return "".join([*out, text[at:]])


def _find(lists: tuple[list[str], list[str], list[str]]):
    def run(batches):
        finder = Finder(*lists)
        for batch in batches:
            ids, kinds, starts, ends = [], [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for kind, a, b in finder.spans(text):
                    ids.append(i)
                    kinds.append(kind)
                    starts.append(a)
                    ends.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kinds, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["id", "pii_type", "start_pos", "end_pos"])

    return run


def _mask(lists: tuple[list[str], list[str], list[str]], key: bytes, dates: bool):
    def run(batches):
        finder = Finder(*lists, dates=dates)
        make = lru_cache(100_000)(lambda value, kind: pseudonym(value, kind, key))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            spans = [finder.spans(t) if t is not None else [] for t in texts]
            masked = [t and mask(t, s, make) for t, s in zip(texts, spans)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(masked, pa.string()), pa.array([len(s) for s in spans], pa.int32())], names=["id", "masked", "n_items"])

    return run


def word_lists(names: DataFrame, ordinary: list[DataFrame], bound: int = 100_000) -> tuple[list[str], list[str], list[str]]:
    """Given names, family names and ordinary words from the fixed lists; at most `bound` rows each, more is an error."""
    given, family = [], []
    for r in names.select("name", "name_kind").where("name is not null").limit(bound + 1).collect():
        (given if r["name_kind"] == "given" else family).append(r["name"])
    words = sorted({r[0].lower() for d in ordinary for r in d.where(F.col(d.columns[0]).isNotNull()).limit(bound + 1).collect()})
    if len(given) + len(family) > bound or len(words) > bound:
        raise ValueError(f"a word list has more than {bound} rows")
    return given, family, words


def find_personal(docs: DataFrame, lists: tuple[list[str], list[str], list[str]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, pii_type, start_pos, end_pos): the personal items in each text, in characters from 0.

    Null and empty texts have none; texts of any length are read whole; equal rows give equal results. Where items overlap, the
    first of e-mail, id number, phone, address, name stays. Columns other than the two named are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text is not null and text != ''")
    return spread(rows).mapInArrow(_find(lists), "id bigint, pii_type string, start_pos int, end_pos int").withColumnRenamed("id", id_col)


def mask_personal(docs: DataFrame, lists: tuple[list[str], list[str], list[str]], key: str, id_col: str = "doc_id", text_col: str = "text", dates: bool = False) -> DataFrame:
    """(id, masked, n_items): each text with its items replaced by [TYPE:pseudonym]; a null text stays null, an empty one empty.

    With `dates` labelled dates of birth are replaced too. Who knows `key` can tell the values from their pseudonyms.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return spread(rows).mapInArrow(_mask(lists, key.encode(), dates), "id bigint, masked string, n_items int").withColumnRenamed("id", id_col)
