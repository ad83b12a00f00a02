"""Files of a folder to document elements."""

from __future__ import annotations

import io
import re
import zipfile
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PATTERNS = ("*.docx", "*.xlsx", "*.html", "*.txt", "*.csv")
ELEMENTS = "source string, type string, content string, page int, error string"
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def parse_docx(data: bytes) -> list[tuple[str, str, int]]:
    """One text element of the paragraphs that aren't blank."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{W}body")
    paragraphs = ["".join(t.text or "" for t in p.iter(f"{W}t")).strip() for p in body.findall(f"{W}p")]
    text = "\n\n".join(p for p in paragraphs if p)
    return [("text", text, 1)] if text else []


def parse_xlsx(data: bytes) -> list[tuple[str, str, int]]:
    """One table element for each sheet that isn't empty; the page is the sheet's number."""
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{S}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{S}si")]
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        sheets = ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{S}sheet")
        for page, sheet in enumerate(sheets, 1):
            target = links[sheet.get(f"{R}id")].lstrip("/")
            root = ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
            lines = []
            for row in root.iter(f"{S}row"):
                cells: dict[int, str] = {}
                for n, c in enumerate(row.findall(f"{S}c")):
                    letters = re.match(r"[A-Z]+", c.get("r") or "")
                    at = sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(letters.group(0)))) - 1 if letters else n
                    v = c.find(f"{S}v")
                    raw = v.text or "" if v is not None else "".join(t.text or "" for t in c.iter(f"{S}t"))
                    cells[at] = shared[int(raw)] if c.get("t") == "s" and raw else raw
                if any(x.strip() for x in cells.values()):
                    lines.append(" | ".join(cells.get(i, "") for i in range(max(cells) + 1)))
            if lines:
                out.append(("table", "\n".join(lines), page))
    return out


class _Html(HTMLParser):
    def __init__(self):
        super().__init__()
        self.text, self.tables, self.skip, self.row = [], [], 0, None

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        elif tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.row = []
        elif tag in ("td", "th") and self.row is not None:
            self.row.append("")
        elif tag in ("p", "br", "div", "li", "h1", "h2", "h3"):
            self.text.append("\n")

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag == "tr" and self.row is not None:
            self.tables[-1].append(" | ".join(c.strip() for c in self.row))
            self.row = None

    def handle_data(self, data):
        if self.skip:
            return
        if self.row:
            self.row[-1] += data
        elif self.row is None:
            self.text.append(data)


def parse_html(data: bytes) -> list[tuple[str, str, int]]:
    """The text outside tables, and each table."""
    p = _Html()
    p.feed(data.decode("utf-8", "replace"))
    text = re.sub(r"\n\s*\n+", "\n", re.sub(r"[ \t]+", " ", "".join(p.text))).strip()
    return ([("text", text, 1)] if len(text) > 10 else []) + [("table", "\n".join(t), 1) for t in p.tables if t]


def parse_text(data: bytes) -> list[tuple[str, str, int]]:
    text = data.decode("utf-8", "replace").strip()
    return [("text", text, 1)] if len(text) > 10 else []


def parse_csv(data: bytes) -> list[tuple[str, str, int]]:
    import csv

    rows = [" | ".join(r) for r in csv.reader(io.StringIO(data.decode("utf-8", "replace"))) if any(c.strip() for c in r)]
    return [("table", "\n".join(rows), 1)] if rows else []


PARSERS = {".docx": parse_docx, ".xlsx": parse_xlsx, ".html": parse_html, ".htm": parse_html, ".txt": parse_text, ".csv": parse_csv}


def parse_files(files: DataFrame, parsers: dict | None = None) -> DataFrame:
    """Elements of binary files (path, content); a file that can't be parsed gives one row with its error, an unknown suffix none.

    `parsers` maps further suffixes (.pdf, images) to functions of the same shape, bytes to (type, content, page) rows, or to lists
    of them, whose rows are all kept, one extractor's after the other's; one that fails leaves the others' rows.
    """
    known = {**PARSERS, **(parsers or {})}

    def run(batches):
        for pdf in batches:
            rows = []
            for path, data in zip(pdf["path"], pdf["content"]):
                name = path.rsplit("/", 1)[-1]
                parse = known.get(name[name.rfind(".") :].lower()) if "." in name else None
                if parse is None:
                    continue
                for extractor in parse if isinstance(parse, (list, tuple)) else [parse]:
                    try:
                        rows += [(name, *e, None) for e in extractor(data)]
                    except Exception as e:
                        rows.append((name, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["source", "type", "content", "page", "error"])

    return files.select("path", "content").mapInPandas(run, ELEMENTS)


def read_folder(spark: SparkSession, folder: str, patterns: tuple[str, ...] = PATTERNS, parsers: dict | None = None) -> DataFrame:
    """Elements of the folder's files that match a pattern, subfolders left out; no match gives no rows."""
    glob = "{" + ",".join(patterns) + "}"
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "false").load(folder)
    return parse_files(files, parsers)


def json_in_text(text: str, schema: str):
    """A column: the JSON object from the first { to the last } of a model's answer, read with a schema; null if there is none."""
    return F.from_json(F.regexp_extract(F.col(text), r"(?s)\{.*\}", 0), schema)
