"""Meeting places: records are sent to the cells of a codebook, counted there, and hot cells are cut into parts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import nearest_cells, usable_rows

HOME, GUEST = 0, 1  # a record in its nearest cell, where it also asks, and in the next nearest
SIZES = "cell int, homes bigint, guests bigint"


def cell_sizes(cells: np.ndarray) -> pa.RecordBatch:
    """(cell, homes, guests) of records with these cells, the nearest first."""
    width = int(cells.max(initial=-1)) + 1
    homes, guests = (np.bincount(c.ravel(), minlength=width) for c in (cells[:, :1], cells[:, 1:]))
    used = np.flatnonzero(homes + guests)
    return pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(homes[used]), pa.array(guests[used])], names=["cell", "homes", "guests"])


def vector_cells(centroids: np.ndarray, probes: int):
    """Cell sizes of the usable rows of each batch (id, vector)."""

    def run(batches):
        for batch in batches:
            _, x = usable_rows(batch.column(0), batch.column(1))
            if len(x):
                yield cell_sizes(nearest_cells(x, centroids, probes))

    return run


def hot_cells(sizes: DataFrame, asks: int, rows: int) -> DataFrame | None:
    """(hot, ask_parts, row_parts) of the cells that one task can't take, from counts (cell, homes, guests); None without any.

    At most one row for each cell of the codebook, which bounds the table and its broadcast.
    """
    counted = sizes.groupBy("cell").agg(F.sum("homes").alias("homes"), F.sum("homes").alias("h"), F.sum("guests").alias("guests"))
    parts = counted.select("cell", F.ceil(F.col("homes") / asks).cast("int").alias("ask_parts"), F.ceil((F.col("homes") + F.col("guests")) / rows).cast("int").alias("row_parts"))
    hot = [tuple(r) for r in parts.where("ask_parts > 1 or row_parts > 1").collect()]
    return sizes.sparkSession.createDataFrame([(c, max(1, a), max(1, r)) for c, a, r in hot], "hot int, ask_parts int, row_parts int") if hot else None


def in_parts(placed: DataFrame, hot: DataFrame | None) -> DataFrame:
    """The placed rows (cell, kind, id, ...) with a part and what they do there: asks, kept.

    In a cell that isn't hot a home row does both. In a hot cell each part of the asking rows meets each part of all rows, so a
    home row stands there in both roles. Rows with a negative cell only pass through.
    """
    salt = F.pmod(F.xxhash64("id"), F.lit(1 << 30)).cast("int")
    if hot is None:
        return placed.withColumns({"part": F.when(F.col("cell") < 0, F.pmod(salt, F.lit(64))).otherwise(0), "asks": F.col("kind") == HOME, "kept": F.lit(True)})
    met = placed.join(F.broadcast(hot), F.col("cell") == F.col("hot"), "left")
    one = F.lit(1)
    a, r = F.coalesce("ask_parts", one), F.coalesce("row_parts", one)
    role = lambda asks, kept, part: F.struct(F.lit(asks).alias("asks"), F.lit(kept).alias("kept"), part.cast("int").alias("part"))
    asking = F.transform(F.sequence(F.lit(0), r - 1), lambda i: role(True, False, F.pmod(salt, a) * r + i))
    keeping = F.transform(F.sequence(F.lit(0), a - 1), lambda i: role(False, True, i * r + F.pmod(salt, r)))
    roles = F.when(F.col("cell") < 0, F.array(role(False, True, F.pmod(salt, F.lit(64))))).when(F.col("hot").isNull(), F.array(F.struct((F.col("kind") == HOME).alias("asks"), F.lit(True).alias("kept"), F.lit(0).alias("part"))))
    roles = roles.otherwise(F.when(F.col("kind") == HOME, F.concat(asking, keeping)).otherwise(keeping))
    return met.withColumn("_role", F.explode(roles)).select(*placed.columns, "_role.part", "_role.asks", "_role.kept")
