"""The inverted index over metadata fields."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType


def metadata_index(docs: DataFrame, id_col: str, scalars: list[str], lists: list[str], structs: list[str] | None = None) -> DataFrame:
    """(field, value, doc_id), distinct: one entry for a scalar, one for each element of a list, one `field.key` for each key of a struct.

    Nulls have none. A list within a struct is one value, written as [a, b].
    """
    one = [docs.select(F.lit(c).alias("field"), F.col(c).cast("string").alias("value"), F.col(id_col).alias("doc_id")) for c in scalars]
    many = [docs.select(F.lit(c).alias("field"), F.explode(F.col(c).cast("array<string>")).alias("value"), F.col(id_col).alias("doc_id")) for c in lists]
    inner = []
    for c in structs or []:
        for f in docs.schema[c].dataType.fields:
            column = F.col(c)[f.name]
            value = F.when(column.isNotNull(), F.concat(F.lit("["), F.array_join(column.cast("array<string>"), ", ", "NULL"), F.lit("]"))) if isinstance(f.dataType, ArrayType) else column.cast("string")
            inner.append(docs.select(F.lit(f"{c}.{f.name}").alias("field"), value.alias("value"), F.col(id_col).alias("doc_id")))
    return reduce(DataFrame.unionByName, [*one, *many, *inner]).where("value is not null and doc_id is not null").distinct()


def search_metadata(index: DataFrame, filters: DataFrame) -> DataFrame:
    """(query_id, doc_id) of the documents that have all (field, value) pairs of a question's filters (query_id, field, value).

    Comparison is case-sensitive on strings; a value that no document has gives no rows for its question.
    """
    asked = filters.select("query_id", "field", "value").distinct()
    wanted = asked.groupBy("query_id").agg(F.count("*").alias("n"))
    hits = asked.join(index, ["field", "value"]).groupBy("query_id", "doc_id").agg(F.count("*").alias("hits"))
    return hits.join(wanted, "query_id").where("hits = n").select("query_id", "doc_id")
