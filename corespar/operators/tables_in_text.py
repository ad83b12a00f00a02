"""Extracted tables: quality filters, text form, names, and the SQL store."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corespar.functions.text import strip

LEAST_ROWS, LEAST_COLUMNS, LEAST_FILLED, LEAST_ACCURACY, TEXT_ROWS = 2, 2, 0.3, 50.0, 10


def table_rows(content: Column) -> Column:
    """Lines of a table's text as arrays of trimmed cells, parted by |, ; or tab; blank lines are dropped."""
    lines = F.filter(F.split(content, "\n"), lambda x: strip(x) != "")
    return F.transform(lines, lambda x: F.transform(F.split(x, r"[|;\t]"), strip))


def table_shape(elements: DataFrame, id_col: str = "element_id") -> DataFrame:
    """(id, n_rows, n_cols, filled, single_chars): shape, share of cells that aren't empty (`k:` alone is empty) and of single characters."""
    rows = elements.where((F.lower(strip(F.col("type"))) == "table") & F.col("content").isNotNull()).select(id_col, table_rows(F.col("content")).alias("rows"))
    cells = F.transform(F.flatten("rows"), lambda c: strip(F.regexp_replace(c, r"^[A-Za-z_0-9]+:", "")))
    shaped = rows.select(id_col, F.size("rows").alias("n_rows"), F.coalesce(F.array_max(F.transform("rows", F.size)), F.lit(0)).alias("n_cols"), cells.alias("cells"))
    share = lambda test: F.when(F.size("cells") > 0, F.round(F.size(F.filter("cells", test)) / F.size("cells"), 6)).otherwise(0.0)
    return shaped.select(id_col, "n_rows", "n_cols", share(lambda c: c != "").alias("filled"), share(lambda c: F.length(c) == 1).alias("single_chars"))


# Plot labels, scattered numbers, one lone number.
GARBLED = (r"mAU\s+min", r"\d+\.\d+\s+\d+\.\d+\s+\d+\.\d+", r"^\d+$")


def garbled(content: Column) -> Column:
    """Whether a table's cells, joined by spaces, look like one of GARBLED."""
    text = F.array_join(F.flatten(table_rows(content)), " ")
    return text.rlike(GARBLED[0]) | text.rlike(GARBLED[1]) | text.rlike(GARBLED[2])


def accepted_tables(elements: DataFrame, id_col: str = "element_id") -> DataFrame:
    """Ids of tables of at least 2 x 2 cells, filled to 30 %, with an accuracy of 50 if one is given, and not garbled."""
    shape = table_shape(elements, id_col)
    facts = elements.select(F.col(id_col), F.col("attrs")["accuracy"].try_cast("double").alias("accuracy"), garbled(F.col("content")).alias("is_garbled"))
    joined = shape.join(facts, id_col)
    return joined.where((F.col("n_rows") >= LEAST_ROWS) & (F.col("n_cols") >= LEAST_COLUMNS) & (F.col("filled") >= LEAST_FILLED) & (F.col("accuracy").isNull() | (F.col("accuracy") >= LEAST_ACCURACY)) & ~(F.col("is_garbled") & (F.col("single_chars") > 0.5))).select(id_col)


def table_text(page: Column, content: Column) -> Column:
    """A heading and the first rows of a table, cells parted by |."""
    rows = F.slice(table_rows(content), 1, TEXT_ROWS)
    return F.concat(F.lit("[Table from page "), F.coalesce(page.cast("string"), F.lit("?")), F.lit("]\n"), F.array_join(F.transform(rows, lambda r: F.array_join(r, " | ")), "\n"))


def table_name(source: str, index: int, longest: int = 64) -> str:
    """A safe name that keeps its number: the middle is cut."""
    tail = f"_{index}"
    return f"table_{re.sub(r'[^0-9A-Za-z_]', '_', source)}"[: longest - len(tail)] + tail


def column_names(names: list[str | None]) -> list[str]:
    """Column names without blanks or repeats: empty ones become col_i, a repeated one gets the number of its predecessors."""
    out: list[str] = []
    for i, n in enumerate(names):
        n = re.sub(r"[^0-9A-Za-z_]", "_", (n or "").strip())[:64] or f"col_{i}"
        base, k = n, 0
        while n.lower() in {o.lower() for o in out}:
            k += 1
            n = f"{base}_{k}"
        out.append(n)
    return out


class TableStore:
    """Named tables over which Spark SQL runs; a small registry of what there is."""

    def __init__(self, spark: SparkSession):
        self.spark, self.info = spark, {}

    def add(self, source: str, index: int, rows: DataFrame) -> str:
        """Register a table (replacing one of the same name) with repaired column names."""
        name = table_name(source, index)
        named = rows.toDF(*column_names(rows.columns))
        named.createOrReplaceTempView(name)
        self.info[name] = {"table_name": name, "columns": named.columns, "n_cols": len(named.columns), "source": source}
        return name

    def add_rows(self, source: str, index: int, rows: list[dict]) -> str | None:
        """Row dicts with possibly different keys; missing ones become null. No rows, no table."""
        if not rows:
            return None
        keys = list(dict.fromkeys(k for r in rows for k in r))
        return self.add(source, index, self.spark.createDataFrame([tuple(r.get(k) for k in keys) for r in rows], keys))

    def add_csv_text(self, source: str, index: int, text: str) -> str:
        """CSV text with a heading line."""
        lines = self.spark.createDataFrame([(x,) for x in text.splitlines() if x.strip()], "value string")
        return self.add(source, index, self.spark.read.option("header", True).option("inferSchema", True).csv(lines.rdd.map(lambda r: r[0])))

    def query(self, sql: str) -> DataFrame:
        return self.spark.sql(sql)

    def tables(self) -> list[str]:
        return sorted(self.info)

    def describe(self, name: str) -> dict:
        return self.info[name] | {"n_rows": self.spark.table(name).count()}

    def close(self) -> None:
        for name in self.info:
            self.spark.catalog.dropTempView(name)
        self.info.clear()
