"""What the corpus operators share: tables, the shared folder and null-safe text."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Between words: space and the control characters tab to carriage return.
BLANKS = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder; only Spark's readers touch the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Hands this package to the Python workers of a session, once; they need not have it installed."""
    sc = spark.sparkContext
    if getattr(sc, "_quakeframe_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="spark-"), "quakeframe.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(path)
    sc._quakeframe_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as spark.checkpoint.dir names it. Only where that is unset and the master is local (tests, a laptop) a local one is made."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or getattr(sc, "_quakeframe_scratch", None)
    if not where:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        where = sc._quakeframe_scratch = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return where.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet to the shared folder and read again: lineage ends here, and a lost executor costs no earlier stage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._quakeframe_path = path
    return back


def forget(*tables: DataFrame) -> None:
    """Removes tables of `written`. Only for those that no table still to be read is made from: what was made of them is written itself."""
    for df in tables:
        spark, path = df.sparkSession, df._quakeframe_path
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


class Plain:
    """A DataFrame under the column names c0, c1, ..., so that no helper column can clash with one of its own."""

    def __init__(self, df: DataFrame):
        self.names = df.columns
        self.columns = [f"c{k}" for k in range(len(self.names))]
        self.df = df.toDF(*self.columns)

    def at(self, name: str) -> str:
        return self.columns[self.names.index(name)]

    def back(self, df: DataFrame, *more: str) -> DataFrame:
        """The columns of the original, and `more`, of a result, under their own names."""
        return df.select(*self.columns, *more).toDF(*self.names, *more)


def text_of(df: DataFrame, col: str = "text") -> Column:
    """The text column, null as empty."""
    return F.coalesce(df[col].cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """Words between blanks, as an array without empty strings."""
    return F.array_remove(F.split(text, BLANKS), "")


def word_count(text: Column) -> Column:
    """Number of words; an array of matches is never built. (The end is \\z: $ would also match before a last U+0085, U+2028 or U+2029, which are words here.)"""
    body = F.regexp_replace(text, "^" + BLANKS + "|" + BLANKS + "\\z", "")
    return F.when(body == "", F.lit(0)).otherwise(F.size(F.split(body, BLANKS))).cast("long")
