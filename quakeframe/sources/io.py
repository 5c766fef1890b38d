"""Readers and writers of catalogs, examples, picks, probabilities and file inventories."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARRIVAL_COLUMNS = (
    "evid long, network string, station string, location string, channelz string, phase string, arrival_time double, pick_quality double, first_motion int, "
    "take_off_angle double, source_receiver_distance double, source_receiver_azimuth double, travel_time_residual double, receiver_lat double, receiver_lon double, "
    "event_lat double, event_lon double, event_depth double, origin_time double, magnitude double, magnitude_type string, rflag string"
)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder all executors share (spark.checkpoint.dir); local only where that is unset and the master is local, as in tests."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or getattr(sc, "_quakeframe_scratch", None)
    if not where and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    if not where:
        where = sc._quakeframe_scratch = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Whether Spark removes the shuffle files of a query when that ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, release: bool = False) -> DataFrame:
    """`df` written to the shared folder and read again: what is used several times is made once, and a lost executor costs no earlier stage. With `release` the shuffle files of the write go at once, not when the JVM collects its garbage."""
    path, conf = scratch(df.sparkSession, name), df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    if release:
        conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if release:
            conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_catalog(spark: SparkSession, path: str, phase: str | None = None, schema: str = ARRIVAL_COLUMNS) -> DataFrame:
    """An arrival CSV with its types given; locations stay text, blank ones become empty, NaN becomes null; rows of one phase, by event and time."""
    df = spark.read.schema(schema).csv(path, header=True)
    df = df.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c, kind in df.dtypes if kind == "double"})
    df = df.withColumn("location", F.coalesce(F.trim("location"), F.lit("")))
    df = df.filter(F.col("phase") == phase) if phase else df
    return df.orderBy("evid", "arrival_time")


def read_examples(spark: SparkSession, waves: str, meta: str, key: str = "row_id") -> DataFrame:
    """Waveforms with their metadata, by key."""
    return spark.read.parquet(waves).join(spark.read.parquet(meta), key)


#: Fixed format of a day file's name: NET.STAT.LOC.CHAN__START__END.mseed
FILE_NAME = r"([A-Z0-9]+)\.([A-Z0-9]+)\.([A-Z0-9]*)\.([A-Z0-9]+)__(\d{8})T[^_]*__(\d{8})T[^.]*\.mseed$"


def file_names(spark: SparkSession, glob: str) -> DataFrame:
    """The paths under a glob; contents aren't read."""
    return spark.read.format("binaryFile").load(glob).select("path")


def file_inventory(paths: DataFrame) -> DataFrame:
    """(station, day, chan2): components found, and whether they make a 1C or 3C day. Names of another form are left out."""
    part = lambda k: F.regexp_extract("path", FILE_NAME, k)
    df = paths.filter(F.col("path").rlike(FILE_NAME)).select(part(1).alias("network"), part(2).alias("station"), part(3).alias("location"), part(4).alias("channel"), F.to_date(part(5), "yyyyMMdd").alias("day"))
    g = df.groupBy("network", "station", "location", F.substring("channel", 1, 2).alias("chan2"), "day").agg(F.count_distinct("channel").alias("n"))
    return g.withColumn("kind", F.when(F.col("n") == 3, "3C").when(F.col("n") == 1, "1C").otherwise("invalid"))


def write_splits(df: DataFrame, path: str) -> None:
    """Train, validation, test (and what else there is) in folders of their own."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def write_pick_catalog(df: DataFrame, path: str, columns: list[str], decimals: list[str]) -> None:
    """Picks by arrival time, as CSV with 7 decimals."""
    out = df.orderBy("arrival_time").select(*[F.format_string("%.7f", F.col(c)).alias(c) if c in decimals else F.col(c) for c in columns])
    out.write.mode("overwrite").csv(path, header=True)


def read_pick_files(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Pick CSVs together, by time."""
    return spark.read.schema(schema).csv(paths, header=True).orderBy("arrival_time")


def write_probs(df: DataFrame, path: str, p: str = "p") -> None:
    """Probabilities as bytes of hundredths, by day."""
    from quakeframe.functions.arrays import quantised

    df.withColumn(p, quantised(F.col(p))).write.mode("overwrite").partitionBy("day").parquet(path)


def write_corrections(meta: DataFrame, summary: DataFrame, preds: DataFrame, path: str, key: str = "pick_id") -> None:
    """The id columns with the summary of each pick as CSV, and all predictions as Parquet."""
    meta.join(summary, key).write.mode("overwrite").csv(f"{path}/corrections", header=True)
    preds.write.mode("overwrite").parquet(f"{path}/predictions")
