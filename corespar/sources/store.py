"""Tables of an index on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save(frames: dict[str, DataFrame], folder: str, partition_by: dict[str, str] | None = None) -> None:
    """Write each frame as a Parquet table of the folder, replacing what was there."""
    for name, df in frames.items():
        writer = df.write.mode("overwrite")
        column = (partition_by or {}).get(name)
        (writer.partitionBy(column) if column else writer).parquet(f"{folder}/{name}")


def load(spark: SparkSession, folder: str, names: list[str] | dict[str, str | None]) -> dict[str, DataFrame]:
    """The tables of a folder; a schema given for a name is taken instead of the files', which a table without any row lacks."""
    schemas = names if isinstance(names, dict) else dict.fromkeys(names)
    return {n: (spark.read.schema(schema) if schema else spark.read).parquet(f"{folder}/{n}") for n, schema in schemas.items()}


def save_tables_as_csv(elements: DataFrame, folder: str) -> None:
    """The rows of table elements as CSV lines (source, page, row, cells joined), one folder per source."""
    rows = elements.where("lower(trim(type)) = 'table' and content is not null").select("source", "page", F.posexplode(F.split("content", "\n")).alias("row", "line"))
    rows.write.mode("overwrite").partitionBy("source").option("header", True).csv(folder)


def append_new(fresh: DataFrame, folder: str, key: list[str]) -> int:
    """Append the rows whose key columns aren't in the table yet; ingesting the same again adds nothing. Returns how many were added.

    The table is partitioned by the first two digits of the key, so only partitions that fresh rows fall into are read. Only a
    missing folder counts as an empty table; any other fault of reading is raised.
    """
    spark = fresh.sparkSession
    hashed = fresh.withColumn("content_key", F.sha2(F.to_json(F.struct(*key)), 256)).dropDuplicates(["content_key"])
    hashed = hashed.withColumn("key_part", F.concat(F.lit("k"), F.substring("content_key", 1, 2)))
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS"))
    hashed = hashed.persist()
    parts = [r[0] for r in hashed.select("key_part").distinct().collect()]  # 256 at most
    new = hashed
    if there:
        known = spark.read.parquet(folder).where(F.col("key_part").isin(parts)).select("content_key")
        new = hashed.join(known, "content_key", "left_anti")
    new = new.persist()
    try:
        n = new.count()
        if n:
            new.write.mode("append").partitionBy("key_part").parquet(folder)
    finally:
        new.unpersist()
        hashed.unpersist()
    return n
