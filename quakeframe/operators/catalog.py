"""Catalog operators: selections, classes, unions and counts over arrivals and events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quakeframe.operators.keys import join_on, number
from quakeframe.operators.splits import ranked, shuffled


def filter_quality(df: DataFrame, min_quality: float, col: str = "pick_quality") -> DataFrame:
    """Rows of at least that quality, which those of null or NaN don't have; a limit of 0 or less keeps all."""
    return df.filter(number(F.col(col)) >= min_quality) if min_quality > 0 else df


def filter_first_motion(df: DataFrame, drop_down: bool = False, qualities: tuple[float, ...] = (0.5, 1.0)) -> DataFrame:
    """Rows of the given qualities, without downward first motions if asked."""
    df = df.filter(F.col("pick_quality").isin(*qualities))
    return df.filter(F.col("first_motion") != -1) if drop_down else df


def select_signal(df: DataFrame, category: str, status: str, max_km: float, low: float, high: float, not_author: str) -> DataFrame:
    """External traces of a category and status within max_km, with the arrival strictly inside (low, high) and another author (or none)."""
    return df.filter((F.col("trace_category") == category) & (F.col("status") == status) & (F.col("distance_km") < max_km) & (F.col("arrival_sample") > low) & (F.col("arrival_sample") < high) & ~F.col("author").eqNullSafe(F.lit(not_author)))


def in_boxes(lat: Column, lon: Column, boxes: list[tuple[float, float, float, float]]) -> Column:
    """Whether a point lies strictly inside any (lat min, lat max, lon min, lon max); unknown places lie in none."""
    hits = [(lat > a) & (lat < b) & (lon > c) & (lon < d) for a, b, c, d in boxes]
    return F.coalesce(reduce(lambda x, y: x | y, hits), F.lit(False))


def exclude_boxes(df: DataFrame, boxes: list[tuple[float, float, float, float]], lat: str = "event_lat", lon: str = "event_lon") -> DataFrame:
    """Rows outside all boxes; rows without coordinates stay."""
    return df.filter(~in_boxes(F.col(lat), F.col(lon), boxes))


def day_number(seconds: Column) -> Column:
    """Epoch seconds as the number YYMMDD of their UTC day."""
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int")), "yyMMdd").cast("int")


def separate_events(df: DataFrame, days: tuple[int, int], lat: tuple[float, float], minus_lon: tuple[float, float]) -> tuple[DataFrame, DataFrame]:
    """(events inside the space-time box, bounds included; all others)."""
    inside = F.coalesce(day_number(F.col("origin_time")).between(*days) & F.col("event_lat").between(*lat) & (-F.col("event_lon")).between(*minus_lon), F.lit(False))
    return df.filter(inside), df.filter(~inside)


def filter_candidates(df: DataFrame, qualities: list[float], max_km: float, min_magnitude: float) -> DataFrame:
    """Candidates for two-event windows; no unknown (null, NaN) quality, distance or magnitude passes."""
    return df.filter(number(F.col("pick_quality")).isin(*qualities) & (number(F.col("source_receiver_distance")) < max_km) & (number(F.col("magnitude")) > min_magnitude))


def filter_distance(df: DataFrame, max_km: float) -> DataFrame:
    """Rows within max_km."""
    return df.filter(F.col("source_receiver_distance") < max_km)


def quality_from_weight(weight: Column, one: float = 0.98, three_quarters: float = 0.6) -> Column:
    """Quality class of an arrival weight; unknown and small weights are 0.5."""
    known = F.when(F.isnan(weight), F.lit(None)).otherwise(weight)
    return F.when(known >= one, 1.0).when(known >= three_quarters, 0.75).otherwise(0.5)


def event_stratum(event_type: Column, evid: Column, current: int = 60_000_000) -> Column:
    """ceq, heq (current and historical earthquakes), cbl (blasts) or noise (no event)."""
    return F.when(event_type == "qb", "cbl").when((event_type == "le") & (evid >= current), "ceq").when((event_type == "le") & (evid < current), "heq").otherwise("noise")


HARMONISED = {"source_id": "evid", "source_origin_time": "origin_time", "source_longitude": "event_lon", "source_latitude": "event_lat"}


def harmonise(df: DataFrame) -> DataFrame:
    """External catalog names as catalog names."""
    return df.withColumnsRenamed(HARMONISED)


def drop_bad_waveforms(df: DataFrame, comps: list[str], dead: float = 1e-14) -> DataFrame:
    """Rows whose components hold no NaN or null and aren't all dead."""
    broken = [F.exists(c, lambda v: v.isNull() | F.isnan(v)) | F.col(c).isNull() for c in comps]
    alive = [F.array_max(F.transform(c, lambda v: F.abs(v))) >= dead for c in comps]
    return df.filter(~reduce(lambda x, y: x | y, broken) & reduce(lambda x, y: x | y, alive))


def split_by_epoch(df: DataFrame, epoch: float, col: str = "arrival_time") -> tuple[DataFrame, DataFrame]:
    """(before the epoch, from the epoch on)."""
    return df.filter(F.col(col) < epoch), df.filter(F.col(col) >= epoch)


def is_operating(day: Column, start: Column, end: Column) -> Column:
    """Whether a station runs on a day: no start is never, no end is still; both ends count."""
    return F.coalesce(start.isNotNull() & (day >= start) & (end.isNull() | (day <= end)), F.lit(False))


def clamped_sigmoid(x: Column, low: float = -70.0, high: float = 70.0) -> Column:
    """Sigmoid of x held between low and high."""
    return 1 / (1 + F.exp(-F.greatest(F.lit(low), F.least(F.lit(high), x))))


#: Fixed channel codes of each component.
CHANNELS = {"E": ("EHE", "EH1", "BHE", "BH1", "HHE", "HH1"), "N": ("EHN", "EH2", "BHN", "BH2", "HHN", "HH2"), "Z": ("EHZ", "BHZ", "HHZ")}


def component_consistency(df: DataFrame, keys: list[str], rates: bool = True) -> DataFrame:
    """Keys that have E, N and Z once each, on channels of CHANNELS, that agree: starts, and ends, of E and N and of N and Z less than one sample apart, one length, one rate.

    `df` has component, channel, starttime, endtime, npts and dt (and sampling_rate). An unknown value agrees with nothing.
    """
    allowed = reduce(lambda a, b: a | b, [(F.col("component") == c) & F.col("channel").isin(*codes) for c, codes in CHANNELS.items()])
    fields = ["starttime", "endtime", "npts", "dt", *(["sampling_rate"] if rates else [])]
    own = F.struct(*[number(F.col(c)).alias(c) for c in fields])
    of = {c: F.max(F.when(F.col("component") == c, own)).alias(c) for c in CHANNELS}
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), F.sum(F.coalesce(allowed, F.lit(False)).cast("int")).alias("_allowed"), F.count_distinct("component").alias("_parts"), *of.values())
    dt = F.col("N.dt")
    near = [F.abs(F.col(f"{a}.{t}") - F.col(f"{b}.{t}")) < dt for a, b in (("E", "N"), ("N", "Z")) for t in ("starttime", "endtime")]
    same = [(F.col(f"E.{c}") == F.col(f"N.{c}")) & (F.col(f"N.{c}") == F.col(f"Z.{c}")) for c in fields[2:] if c != "dt"]
    return g.filter((F.col("_rows") == 3) & (F.col("_allowed") == 3) & (F.col("_parts") == 3)).filter(reduce(lambda a, b: a & b, near + same)).select(*keys)


def combine_catalogs(parts: list[tuple[DataFrame, str]], columns: list[str]) -> DataFrame:
    """Catalogs on their common columns, each tagged with its event type."""
    tagged = [df.select(*columns).withColumn("event_type", F.lit(kind)) for df, kind in parts]
    return reduce(DataFrame.unionByName, tagged)


def combine_splits(signal: list[DataFrame], noise: DataFrame) -> DataFrame:
    """Signal classes, then noise, whose pick index is -1; columns that one lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [*signal, noise.withColumn("pick_index", F.lit(-1).cast("long"))])


def class_counts(df: DataFrame, col: str) -> DataFrame:
    """Rows of each class and their share in percent; the classes are counted before the total is taken."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("percent", F.round(100 * F.col("n") / F.sum("n").over(W.partitionBy(F.lit(1))), 6))


def magnitude_distribution(df: DataFrame, edges: list[float], min_ml: float, col: str = "magnitude") -> DataFrame:
    """Share of local magnitudes in each bin; the last bin is closed on the right."""
    local = df.filter((F.col("magnitude_type") == "l") & (F.col(col) >= min_ml))
    return normalised(histogram(local, col, edges))


def bucket(x: Column, edges: list[float]) -> Column:
    """Number of the bin [a, b) that x falls in, the last one [a, b]; null outside."""
    out = F.lit(None).cast("int")
    for k in range(len(edges) - 1):
        upper = (x <= edges[k + 1]) if k == len(edges) - 2 else (x < edges[k + 1])
        out = F.when((x >= edges[k]) & upper, F.lit(k)).otherwise(out)
    return out


def histogram(df: DataFrame, col: str, edges: list[float], keys: list[str] | None = None) -> DataFrame:
    """Rows in each bin, by keys."""
    return df.withColumn("bin", bucket(F.col(col), edges)).filter(F.col("bin").isNotNull()).groupBy(*(keys or []), "bin").agg(F.count(F.lit(1)).alias("n"))


def normalised(counts: DataFrame) -> DataFrame:
    """Counts as shares of their sum; there are as many rows as bins."""
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy(F.lit(1))), 6))


def coverage(df: DataFrame, found: Column) -> DataFrame:
    """Found rows, all rows and the share in percent."""
    return df.agg(F.sum(F.coalesce(found, F.lit(False)).cast("long")).alias("found"), F.count(F.lit(1)).alias("total")).withColumn("percent", F.round(100 * F.col("found") / F.col("total"), 6))


def station_list(inventory: DataFrame, components: int, limit: int | None = None) -> DataFrame:
    """Stations with the channels of a 3- or 1-component instrument, sorted; the first `limit` if given."""
    g = inventory.groupBy("network", "station", "location", "chan2").agg(F.count_distinct("channel").alias("n"))
    out = g.filter(F.col("n") >= 3 if components == 3 else F.col("n") == 1).orderBy("network", "station", "location", "chan2")
    return out.limit(limit) if limit else out


def assign_event_ids(df: DataFrame, lat: str = "event_lat", lon: str = "event_lon", depth: str = "event_depth") -> DataFrame:
    """event_id from 1 for each (lat, lon, depth) to a tenth, in sorted order; an unknown depth is the truncated mean of the known ones.

    Ids are ranked over the distinct triples of a latitude, and only the latitudes (1,801 at most) in one task.
    """
    mean = df.agg(F.avg(F.col(depth).try_cast("double")).cast("int").alias("_mean"))
    tenth = lambda c: (F.col(c) * 10).cast("int")
    full = df.join(F.broadcast(mean)).withColumn("_d", F.coalesce(F.col(depth).try_cast("double"), F.col("_mean")))  # one row
    full = full.withColumns({"_a": tenth(lat), "_o": tenth(lon), "_z": tenth("_d")}).drop("_mean", "_d")
    places = full.select("_a", "_o", "_z").distinct()
    before = places.groupBy(F.col("_a").alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    before = before.withColumn("_before", F.sum("_n").over(W.orderBy("_p")) - F.col("_n")).drop("_n")
    ranked = places.withColumn("_k", F.row_number().over(W.partitionBy("_a").orderBy("_o", "_z")))
    ids = ranked.join(before, F.col("_a").eqNullSafe(F.col("_p"))).withColumn("event_id", (F.col("_before") + F.col("_k")).cast("long")).drop("_p", "_k", "_before")
    return full.join(ids, ["_a", "_o", "_z"]).drop("_a", "_o", "_z")


def match_distribution(target: DataFrame, pool: DataFrame, bin_col: str, n: int, key: str, seed: str) -> DataFrame:
    """About n draws from `pool`, with replacement, whose bins follow those of `target`; rows without a bin are a bin of their own."""
    share = normalised(target.groupBy(bin_col).agg(F.count(F.lit(1)).alias("n"))).select(bin_col, F.round(F.lit(n) * F.col("share")).cast("int").alias("_draws"))
    size = pool.groupBy(bin_col).agg(F.count(F.lit(1)).alias("_size"))
    draws = join_on(share, size, [bin_col]).filter("_draws > 0").withColumn("draw", F.explode(F.sequence(F.lit(1), F.col("_draws"))))
    draws = draws.withColumn("_r", F.pmod(bucket32(F.concat_ws(":", F.lit(seed), bin_col, "draw")), F.col("_size")) + 1).select(bin_col, "draw", "_r")
    r = ranked(pool, [shuffled(seed, F.col(key)), F.col(key)], [bin_col], "_r")
    return join_on(r, draws, [bin_col, "_r"]).drop("_r")


def bucket32(key: Column) -> Column:
    """32 bits of the md5 of a key: the same on every engine."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint")
