"""A waveform archive laid out for joins: one row for each key, with its channels, bucketed and sorted by the keys."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeframe.sources.io import scratch


def by_key(archive: DataFrame, keys: list[str]) -> DataFrame:
    """Waveforms (keys, channel, x) as keys and `waves`, from channel to samples; of several for a channel the smallest."""
    one = archive.filter(F.col("x").isNotNull() & F.col("channel").isNotNull()).groupBy(*keys, "channel").agg(F.min("x").alias("x"))
    return one.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("channel", "x"))).alias("waves"))  # a key's channels, some at most


def store_archive(archive: DataFrame, keys: list[str], buckets: int, path: str | None = None, name: str | None = None) -> DataFrame:
    """Writes waveforms (keys, channel, x) as a bucketed table and reads it, in the form of `by_key`.

    Arrays are grouped here, once; every join by the keys then
    moves the other side to the buckets and leaves the arrays where they lie.
    """
    spark = archive.sparkSession
    name = name or f"archive_{uuid.uuid4().hex}"
    by_key(archive, keys).repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path or scratch(spark, name)).format("parquet").saveAsTable(name)
    return spark.table(name)


def open_archive(spark: SparkSession, name: str) -> DataFrame:
    """An archive that is stored already."""
    return spark.table(name)
