"""Joins of arrivals, waveforms, stations and gaps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quakeframe.functions import kernels
from quakeframe.sources.archive import by_key
from quakeframe.sources.io import written

ARCHIVE_KEYS = ["evid", "network", "station", "channel", "location"]


def attach_waveforms_1c(catalog: DataFrame, archive: DataFrame, keys: list[str]) -> DataFrame:
    """Picks that have an archived waveform, with it."""
    return catalog.join(archive, keys)


def counted(df: DataFrame) -> DataFrame:
    """The different rows with `_copies`, how often each occurs."""
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_copies"))


def repeated(df: DataFrame) -> DataFrame:
    """Each row as often as its `_copies` says."""
    return df.withColumn("_copies", F.explode(F.array_repeat(F.lit(0), F.col("_copies").cast("int")))).drop("_copies")


def attach_waveforms_3c(catalog: DataFrame, stored: DataFrame, keys: list[str], channels: dict[str, str]) -> DataFrame:
    """Picks that have all three component waveforms, x_{component}. `channels` names, by component, the catalog column with its channel.

    `stored` is an archive of `store_archive`, where a key's channels lie in one row: catalog rows go to the bucket of
    their key and find all three there. Arrays are neither shuffled nor aggregated, and each row is met once. An archive
    that isn't stored (keys, channel, x) is grouped first. A pick given twice comes out twice.
    """
    stored = stored if "waves" in stored.columns else by_key(stored, keys)
    found = catalog.join(stored, keys).select(*[catalog[c] for c in catalog.columns], *[F.try_element_at("waves", F.col(c)).alias(f"x_{k}") for k, c in channels.items()])
    return found.dropna(subset=[f"x_{k}" for k in channels])


def coverage_left(catalog: DataFrame, archive: DataFrame, keys: list[str]) -> DataFrame:
    """Every pick with `found`: whether the archive has it."""
    have = archive.select(*keys).distinct().withColumn("found", F.lit(True))
    return catalog.join(have, keys, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def exclude_known_stations(df: DataFrame, home: DataFrame, code: str = "code") -> DataFrame:
    """Rows whose station code the home catalog doesn't have."""
    return df.join(home.select(code).distinct(), code, "left_anti")


def keep_known_stations(df: DataFrame, home: DataFrame, code: str = "code") -> DataFrame:
    """Rows whose station code the home catalog has."""
    return df.join(home.select(code).distinct(), code, "left_semi")


def drop_duplicate_events(df: DataFrame, listed: DataFrame, key: str = "evid") -> DataFrame:
    """Rows of events that aren't listed."""
    return df.join(listed.select(key).distinct(), key, "left_anti")


def add_magnitudes(df: DataFrame, magnitudes: DataFrame, key: str = "evid") -> DataFrame:
    """Rows with the magnitude of their event, null without one; of several the largest."""
    one = magnitudes.groupBy(key).agg(F.max(F.struct("magnitude", "magnitude_type")).alias("_m")).select(key, "_m.magnitude", "_m.magnitude_type")
    return df.join(one, key, "left")


#: Rows of a station that one task pairs at most, and rows that it takes up at once.
GROUP_ROWS, CHUNK_ROWS = 250_000, 100_000
#: Cut points between the magnitude ranges of a station's partners at most, and partners of a range at least.
CUTS, RANGE_ROWS = [k / 256 for k in range(1, 256)], 20_000


def _between_cuts(value: Column, inclusive: bool = False) -> Column:
    """Number of cut points under (or at) a value."""
    return F.size(F.filter("_cuts", lambda c: c <= value if inclusive else c < value))


def magnitude_index(right: DataFrame, keys: list[str], seed: str) -> DataFrame:
    """The partners of each `keys` by rank: evid2, magnitude2, _place (from 0, by magnitude, md5 and evid), _cuts, and _range, a run of places that one task sorts.

    Ranges lie between approximate quantiles, as many as the number of partners asks for. A magnitude that fills several of them (a station with a million equal ones)
    is dealt to them by the md5, which is also the order inside a magnitude, so no range holds much more than others.
    """
    r = right.filter(F.col("magnitude").isNotNull() & ~F.isnan("magnitude")).select(*keys, F.col("evid").alias("evid2"), F.col("magnitude").alias("magnitude2")).distinct()
    r = written(r, "pair-partners", release=True)
    large = r.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c")).filter(F.col("_c") > RANGE_ROWS)
    cuts = r.join(large, keys).groupBy(*[F.col(k).alias(f"_c{k}") for k in keys]).agg(F.percentile_approx("magnitude2", CUTS, 4096).alias("_cuts"), F.max("_c").alias("_c"))
    step = F.greatest(F.lit(1), F.ceil(F.lit(256 * RANGE_ROWS) / F.col("_c"))).cast("int")
    cuts = cuts.withColumn("_cuts", F.filter("_cuts", lambda c, i: (i + 1) % step == 0)).drop("_c")
    r = r.join(cuts, [r[k] == cuts[f"_c{k}"] for k in keys], "left").drop(*[f"_c{k}" for k in keys]).withColumn("_cuts", F.coalesce("_cuts", F.array().cast("array<double>")))
    r = r.withColumn("_h", F.md5(F.concat_ws(":", F.lit(seed), "evid2")))
    share = F.conv(F.substring("_h", 1, 8), 16, 10).cast("bigint") / 4294967296.0
    first = _between_cuts(F.col("magnitude2"))
    return r.withColumn("_range", (first + F.floor(share * (_between_cuts(F.col("magnitude2"), True) - first))).cast("int"))


def pair_by_ranges(left: DataFrame, right: DataFrame, keys: list[str], low: float, high: float, seed: str, draw: list[str] | None = None) -> DataFrame:
    """`pair_events` of stations with so many picks that their partners lie in several tasks.

    Partners are ranked once. Two rank lookups, which ride on the sort that ranks them, give the places of a row's interval;
    a draw picks a place, stepping over those of the row's own event; an equi-join on keys and place fetches that one
    partner. So no row ever meets more than one, however many share a station.
    """
    index = written(magnitude_index(right, keys, seed), "pair-index", release=True)
    cuts = index.groupBy(*keys).agg(F.first("_cuts").alias("_cuts"))
    own = [*keys, "evid", "magnitude"]
    asked = left.select(*own).filter(F.col("magnitude").isNotNull() & ~F.isnan("magnitude")).distinct()
    ends = F.array(F.struct(F.lit(0).alias("_kind"), (F.col("magnitude") + low).alias("_at")), F.struct(F.lit(2).alias("_kind"), (F.col("magnitude") + high).alias("_at")))
    asked = asked.join(cuts, keys).withColumn("_e", F.explode(ends)).select(*own, "_e.*", "_cuts")
    # An interval starts in the range of the first value that isn't under it, and ends in that of the last one not over it.
    asked = asked.withColumn("_range", F.when(F.col("_kind") == 0, _between_cuts(F.col("_at"))).otherwise(_between_cuts(F.col("_at"), True))).drop("_cuts")
    sizes = index.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
    points = index.select(*keys, "_range", F.lit(1).alias("_kind"), F.col("magnitude2").alias("_at"), "_h", "evid2").unionByName(asked, allowMissingColumns=True)
    w = W.partitionBy(*keys, "_range").orderBy("_at", "_kind", "_h", "evid2").rowsBetween(W.unboundedPreceding, W.currentRow)
    points = points.withColumn("_inside", F.sum((F.col("_kind") == 1).cast("long")).over(w))
    filled = cuts.select(*keys, F.explode(F.sequence(F.lit(0), F.size("_cuts"))).alias("_range")).join(sizes, [*keys, "_range"], "left")
    before = filled.withColumn("_before", F.coalesce(F.sum("_n").over(W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    points = written(points.join(before, [*keys, "_range"]).withColumn("_place", F.col("_before") + F.col("_inside")).drop("_before", "_inside", "_range", "_h"), "pair-places", release=True)
    found = points.filter("_kind = 1").select(*keys, "evid2", F.col("_at").alias("magnitude2"), (F.col("_place") - 1).alias("_place"))
    spans = points.filter("_kind <> 1").groupBy(*own).agg(F.max(F.when(F.col("_kind") == 0, F.col("_place"))).alias("_from"), F.max(F.when(F.col("_kind") == 2, F.col("_place"))).alias("_to"))
    of_event = found.select(*keys, F.col("evid2").alias("evid"), "_place")
    ends = of_event.groupBy(*keys, "evid").agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_a"), F.max("_place").alias("_b"))
    few = ends.filter("_n <= 2").select(*keys, "evid", F.when(F.col("_n") == 1, F.array("_a")).otherwise(F.array("_a", "_b")).alias("_own"))
    many = of_event.join(ends.filter("_n > 2"), [*keys, "evid"], "left_semi").groupBy(*keys, "evid").agg(F.sort_array(F.collect_list("_place")).alias("_own"))
    events = few.unionByName(many)  # the magnitudes that an event is given with
    spans = spans.filter(F.col("_to") > F.col("_from")).join(events, [*keys, "evid"], "left")
    mine = F.coalesce(F.filter("_own", lambda p: (p >= F.col("_from")) & (p < F.col("_to"))), F.array().cast("array<bigint>"))
    spans = spans.withColumn("_own", mine).withColumn("_choice", F.col("_to") - F.col("_from") - F.size("_own")).filter("_choice > 0")
    hashed = _drawn(keys, seed, draw)
    chosen = left.join(spans.select(*own, "_from", "_own", "_choice"), own)
    place = F.aggregate("_own", F.col("_from") + hashed % F.col("_choice"), lambda at, p: F.when(p <= at, at + 1).otherwise(at))
    chosen = chosen.withColumn("_place", place).drop("_from", "_own", "_choice")
    return chosen.join(found, [*keys, "_place"]).select(*left.columns, "evid2", "magnitude2")


def _drawn(keys: list[str], seed: str, draw: list[str] | None) -> Column:
    """The draw of a row: 52 bits of the md5 of seed, evid, keys and the columns `draw`."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *[F.col(c).cast("string") for c in ["evid", *keys, *(draw or [])]])), 1, 13), 16, 10).cast("bigint")


def _usable(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with all keys, an event and a magnitude."""
    return df.filter(F.col("magnitude").isNotNull() & ~F.isnan("magnitude") & F.col("evid").isNotNull()).dropna(subset=keys)


def _pair_groups(rows: DataFrame, keys: list[str], low: float, high: float, seed: str, draw: list[str] | None, columns: list[str]) -> DataFrame:
    """`pair_events` of rows that ask or, where `_asks` is false, offer themselves (without that column all do both): they are dealt by `keys` once, and whole stations are paired where they lie."""
    both = "_asks" not in rows.columns
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys)  # md5 comes after, so it is neither moved nor sorted
    dealt = dealt.select("*", F.unhex(F.md5(F.concat_ws(":", F.lit(seed), "evid"))).alias("_md5"), _drawn(keys, seed, draw).alias("_draw"))

    def paired(t: pa.Table, group: np.ndarray) -> pa.Table:
        t = t.combine_chunks()
        md5 = np.frombuffer(b"".join(t["_md5"].to_pylist()), ">u8").reshape(-1, 2).astype(np.uint64)
        asks = np.ones(len(t), bool) if both else t["_asks"].to_numpy().astype(bool)
        row, partner = kernels.drawn_partners(group, t["magnitude"].to_numpy(), md5, t["_draw"].to_numpy(), asks, asks if both else ~asks, low, high)
        out = [t[c].take(pa.array(row)) for c in columns] + [t[c].take(pa.array(partner)) for c in ("evid", "magnitude")]
        return pa.Table.from_arrays(out, [*columns, "evid2", "magnitude2"])

    def numbered(t: pa.Table) -> np.ndarray:
        """The groups of sorted rows, from 0."""
        new = np.zeros(len(t), bool)
        for k in keys:
            c = t[k].combine_chunks()
            new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False).astype(bool)
        return np.cumsum(new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= CHUNK_ROWS:  # whole groups go out, the last one may go on
                t = pa.Table.from_batches(held).combine_chunks()
                group = numbered(t)
                whole = int(np.searchsorted(group, group[-1]))
                if whole:
                    yield from paired(t.slice(0, whole), group[:whole]).to_batches(10_000)
                held = t.slice(whole).to_batches()
                n = 0  # so a group of many batches is looked at once in CHUNK_ROWS rows
        if held:
            t = pa.Table.from_batches(held).combine_chunks()
            if len(t):
                yield from paired(t, numbered(t)).to_batches(10_000)

    schema = rows.select(*columns, F.col("evid").alias("evid2"), F.col("magnitude").alias("magnitude2")).schema
    return dealt.mapInArrow(run, schema)


def pair_events(left: DataFrame, right: DataFrame, keys: list[str], low: float, high: float, seed: str, draw: list[str] | None = None) -> DataFrame:
    """For each row of `left` one row of `right` of the same keys, another event, and a magnitude from m + low to m + high, all equally likely.

    A draw by hash (of evid, keys and the columns `draw`) picks a place among the partners by magnitude, md5 and evid. Rows are
    dealt by their keys once and paired there; stations of more than GROUP_ROWS rows are paired by ranges of magnitude in
    many tasks. Rows that ask and offer themselves (`right` is `left`) are written and moved once.
    Rows of null keys, null or NaN magnitudes or without a partner go; a row given twice comes out twice.
    """
    columns, rows = left.columns, _usable(left, keys)
    if right is not left:
        offered = _usable(right, keys).select(*keys, "evid", "magnitude").withColumn("_asks", F.lit(False))
        rows = rows.withColumn("_asks", F.lit(True)).unionByName(offered, allowMissingColumns=True)
    rows = written(rows, "pair-rows", release=True)
    large = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c")).filter(F.col("_c") > GROUP_ROWS).select(*keys)
    large = written(large.coalesce(1), "pair-large", release=True)  # one row of GROUP_ROWS at most
    if large.isEmpty():
        return _pair_groups(rows, keys, low, high, seed, draw, columns)
    small = _pair_groups(rows.join(F.broadcast(large), keys, "left_anti"), keys, low, high, seed, draw, columns)
    much = rows.join(F.broadcast(large), keys, "left_semi")
    asking, offered = (much, much) if right is left else (much.filter("_asks"), much.filter("NOT _asks"))
    return small.unionByName(pair_by_ranges(asking.select(*columns), offered.select(*keys, "evid", "magnitude"), keys, low, high, seed, draw))


def match_picks(estimated: DataFrame, actual: DataFrame, keys: list[str], tolerance: int) -> DataFrame:
    """Every actual pick with the closest estimated pick of its waveform nearer than `tolerance`; ties go to the earlier.

    Residual is actual - estimated, null without a match. An actual pick given twice comes out twice; null keys are keys like others.
    """
    actual = counted(actual)
    e = estimated.select(*[F.col(k).alias(f"_e{k}") for k in keys], "est")
    on = [actual[k].eqNullSafe(e[f"_e{k}"]) for k in keys] + [F.abs(actual["act"] - e["est"]) < tolerance]
    j = actual.join(e, on, "left").groupBy(*actual.columns).agg(F.min(F.when(F.col("est").isNotNull(), F.struct(F.abs(F.col("act") - F.col("est")).alias("d"), "est"))).alias("_m"))
    return repeated(j.select(*actual.columns, F.col("_m.est").alias("est"), (F.col("act") - F.col("_m.est")).alias("residual")))


def nearest_pick_residuals(estimated: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Every estimated pick with its residuals to the waveform's two actual picks, and whether it is the closest to either; waveforms without estimates give one null row."""
    j = actual.join(estimated, keys, "left").withColumns({"r1": F.col("act1") - F.col("est"), "r2": F.col("act2") - F.col("est")})
    w = W.partitionBy(*keys)
    first = lambda r: F.coalesce(F.min(F.struct(F.abs(F.col(r)).alias("d"), F.col("est").alias("e"))).over(w)["e"] == F.col("est"), F.lit(False)) & F.col(r).isNotNull()
    return j.withColumn("is_match", first("r1") | first("r2"))


def station_run_range(requests: DataFrame, epochs: DataFrame, keys: list[str]) -> DataFrame:
    """Requested [start, start + n days] clipped to a station's operation: run_start and n_days, null and 0 where it doesn't run."""
    e = epochs.groupBy(*keys).agg(F.min("start_date").alias("_s"), F.when(F.max(F.col("end_date").isNull().cast("int")) == 0, F.max("end_date")).alias("_e"))
    df = requests.join(e, keys, "left").withColumn("_end", F.col("start") + F.col("days") * 86400.0)
    bad = F.col("_s").isNull() | (F.col("_end") < F.col("_s")) | F.coalesce(F.col("start") > F.col("_e"), F.lit(False))
    begin = F.greatest(F.col("start"), F.floor(F.col("_s") / 86400) * 86400.0)
    days = F.floor((F.least(F.col("_end"), F.coalesce(F.col("_e"), F.col("_end"))) - begin) / 86400)
    return df.select(*requests.columns, F.when(~bad, begin).alias("run_start"), F.when(bad, 0).otherwise(days).cast("long").alias("n_days"))


def missing_days(stations: DataFrame, inventory: DataFrame, first: int, last: int, expected: int) -> DataFrame:
    """Station-days of a range without the expected number of files: (station, day, files, error)."""
    days = stations.select("station", F.explode(F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long"))).alias("day"))
    have = inventory.groupBy("station", "day").agg(F.count(F.lit(1)).alias("files"))
    df = days.join(have, ["station", "day"], "left").withColumn("files", F.coalesce("files", F.lit(0)))
    return df.filter(F.col("files") != expected).withColumn("error", F.when(F.col("files") == 0, "missing").otherwise("file_error"))


def mask_picks_in_gaps(picks: DataFrame, gaps: DataFrame, keys: list[str], day: str = "day", time: str = "arrival_time") -> DataFrame:
    """Picks outside all gaps of their station-day. A pick lies in a gap if its sample does: from start_ind up to, but not with, end_ind of the gap, counted from midnight."""
    g = gaps.select(*[F.col(k).alias(f"_g{k}") for k in keys], F.col(day).alias("_gday"), "start_ind", "end_ind", "sampling_rate")
    sample = F.round((picks[time] - picks[day] * 86400) * g["sampling_rate"]).cast("long")
    on = [picks[k] == g[f"_g{k}"] for k in keys] + [picks[day] == g["_gday"], sample >= g["start_ind"], sample < g["end_ind"]]
    return picks.join(g, on, "left_anti")


def attach_pick_metadata(summary: DataFrame, meta: DataFrame, key: str = "pick_id") -> DataFrame:
    """Summaries with the id columns of their picks, by key and not by position."""
    return meta.join(summary, key)

