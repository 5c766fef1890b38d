"""Event-wise splits, exact samples, replication and thinning; every choice is a hash of a key, so reruns agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quakeframe.operators.keys import join_on


def shuffled(seed: str, key: Column) -> Column:
    """Sort key of a reproducible shuffle."""
    return F.md5(F.concat_ws(":", F.lit(seed), key.cast("string")))


def ranked(df: DataFrame, order: list[Column], by: list[str] | None = None, name: str = "rank") -> DataFrame:
    """Global (or per `by`) row numbers without one task for all rows.

    The first 3 hex digits of the leading md5 key are ranges: ranks inside a range plus
    the counts of the ranges before it. A `by` of null is a group like others.
    """
    by = by or []
    df = df.withColumn("_k", order[0]).withColumn("_range", F.substring("_k", 1, 3))
    inside = F.row_number().over(W.partitionBy(*by, "_range").orderBy("_k", *order[1:]))
    df = df.withColumn("_in", inside)
    counts = df.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*(by or [F.lit(1)])).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return join_on(df, counts, [*by, "_range"]).withColumn(name, F.col("_before") + F.col("_in")).drop("_k", "_range", "_in", "_before")


def _parted(r: DataFrame, train: float, validation: float, test: float) -> Column:
    """The split of each of `r` by its rank: floor(train * n), then floor(v / (v + t) * rest), then the rest."""
    first = F.floor(F.lit(train) * F.col("_all"))
    second = F.floor(F.lit(validation / (validation + test)) * (F.col("_all") - first))
    return F.when(F.col("rank") <= first, "train").when(F.col("rank") <= first + second, "validation").otherwise("test")


def event_split(df: DataFrame, key: str, train: float, validation: float, test: float, seed: str) -> DataFrame:
    """(key, split) for the distinct keys: exactly floor(train * n) to train, then floor(v / (v + t) * rest) to validation, the rest to test. Null is no key: `row_split` is for rows without one."""
    keys = ranked(df.select(key).filter(F.col(key).isNotNull()).distinct(), [shuffled(seed, F.col(key)), F.col(key)])
    n = keys.agg(F.count(F.lit(1)).alias("_all"))
    keys = keys.join(F.broadcast(n))  # one row
    return keys.select(key, _parted(keys, train, validation, test).alias("split"))


def row_split(df: DataFrame, train: float, validation: float, test: float, seed: str, identity: list[str] | None = None) -> DataFrame:
    """Every row with a split of its own, in the exact counts of `event_split`.

    Rows are known by the columns `identity` (all of them, if not given). Rows that agree in them share an order, so which
    of them comes first tells nothing, and as many of them fall into each split on every run.
    """
    known = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in identity or df.columns]
    r = ranked(df, [F.md5(F.concat_ws(":", F.lit(seed), *known))])
    r = r.join(F.broadcast(df.agg(F.count(F.lit(1)).alias("_all"))))  # one row
    return r.withColumn("split", _parted(r, train, validation, test)).drop("rank", "_all")


def noise_share(signal_rows: int, copies: int, noise_rows: int) -> float:
    """The share of the noise that goes to train, so that it has as many rows there as the signal with its copies; 1 at most."""
    return min(1.0, copies * signal_rows / noise_rows) if noise_rows else 1.0


def split_examples(df: DataFrame, key: str, train: float, validation: float, test: float, seed: str, noise_train: float | None = None, identity: list[str] | None = None) -> DataFrame:
    """Every row with its split: rows of an event together, noise rows (without a key) each for itself, with a share of train of its own."""
    signal = df.filter(F.col(key).isNotNull())
    noise = row_split(df.filter(F.col(key).isNull()), train if noise_train is None else noise_train, validation, test, seed, identity)
    return assign_split_rows(signal, event_split(signal, key, train, validation, test, seed), key).unionByName(noise)


def hash_split(key: Column, train: float, validation: float, seed: str) -> Column:
    """The split of a key by its hash alone: no sort and no shuffle, sizes right in expectation."""
    u = F.conv(F.substring(shuffled(seed, key), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)
    return F.when(u < train, "train").when(u < train + validation, "validation").otherwise("test")


def assign_split_rows(df: DataFrame, splits: DataFrame, key: str) -> DataFrame:
    """Every row with the split of its event, null where that has none."""
    return df.join(splits, key, "left")


def sample_k(df: DataFrame, k: int, order: list[Column], by: list[str] | None = None) -> DataFrame:
    """Exactly k rows (of each `by`), or all if there are fewer."""
    return ranked(df, order, by).filter(F.col("rank") <= k).drop("rank")


def thin_every_nth(df: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """Every n-th row in the order: the rows 1, 1 + n, ..."""
    return ranked(df, order).filter((F.col("rank") - 1) % n == 0).drop("rank")


def thinned_to_signal(noise: DataFrame, n_signal: int, n: int, key: str, seed: str) -> DataFrame:
    """Every n-th noise row and, if those are fewer than the `n_signal` signal rows, as many others, drawn with replacement, as are missing.

    Draw j takes the other row of rank md5(seed:j) modulo their number, so reruns agree; a row drawn twice comes twice.
    """
    r = ranked(noise, [shuffled(seed, F.col(key)), F.col(key)])
    kept = r.filter((F.col("rank") - 1) % n == 0).drop("rank")
    others = r.filter((F.col("rank") - 1) % n != 0).withColumn("_place", F.col("rank") - F.floor((F.col("rank") - 1) / n) - 2).drop("rank")
    rows = noise.count()
    left = rows - -(-rows // n)
    missing = n_signal - (rows - left)
    if missing <= 0 or not left:
        return kept
    draws = noise.sparkSession.range(1, missing + 1).withColumn("_h", F.conv(F.substring(shuffled(seed, F.col("id")), 1, 8), 16, 10).cast("bigint"))
    draws = draws.select((F.col("_h") % left).alias("_draw"))
    return kept.unionByName(others.join(draws, F.col("_place") == F.col("_draw")).drop("_place", "_draw"))


def split_report(df: DataFrame, key: str) -> DataFrame:
    """Rows, events and share of rows of each split."""
    g = df.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(key).alias("n_events"))
    return g.withColumn("percent", F.round(100 * F.col("n_rows") / F.sum("n_rows").over(W.partitionBy(F.lit(1))), 6))


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that occur in both; none in a sound split."""
    return a.select(key).intersect(b.select(key))


def upsample_minority(df: DataFrame, col: str, classes: list, order: list[Column]) -> DataFrame:
    """Rows of the smaller classes repeated up to the size of the largest: each row floor(max / n) times, the first max % n once more."""
    some = df.filter(F.col(col).isin(classes))
    sizes = some.groupBy(F.col(col).alias("_c")).agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.withColumn("_max", F.max("_n").over(W.partitionBy(F.lit(1))))
    r = ranked(some, order, [col]).join(F.broadcast(sizes), F.col(col) == F.col("_c"))  # one row for each class
    copies = F.floor(F.col("_max") / F.col("_n")) + F.when(F.col("rank") <= F.col("_max") % F.col("_n"), 1).otherwise(0)
    return r.withColumn("copy", F.explode(F.sequence(F.lit(1), copies.cast("int")))).drop("_c", "_n", "_max", "rank")


def flip_polarity(df: DataFrame, fraction: float, seed: str, key: str, label: str = "first_motion", wave: str = "x") -> DataFrame:
    """Sign of wave and label changed for a hashed fraction of the rows with a non-zero label."""
    u = F.conv(F.substring(shuffled(seed, F.col(key)), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)
    flip = (F.col(label) != 0) & (u < fraction)
    return df.withColumns({"was_flipped": flip, wave: F.when(flip, F.transform(wave, lambda v: -v)).otherwise(F.col(wave)), label: F.when(flip, -F.col(label)).otherwise(F.col(label))})
