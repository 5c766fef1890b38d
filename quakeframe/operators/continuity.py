"""Bookkeeping of continuous data: close picks, gaps, sufficient signal, carry-over, metadata, ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quakeframe.operators.keys import join_on


def remove_close_picks(df: DataFrame, min_sep: float, keys: list[str], time: str = "arrival_time", tie: str = "pick_id", span: float = 86400.0) -> DataFrame:
    """Rows with `is_close`: whether the pick before or after it at its station is nearer than min_sep. Both of a pair are close.

    A station's picks are cut into spans of time (at least 20 * min_sep), so the years of one station lie in many tasks.
    Picks nearer than min_sep to the end of a span are copied to the next one, where they are neighbours but no rows.
    """
    span = max(span, 20.0 * min_sep)
    own = F.floor(F.col(time) / span)
    near_start, near_end = F.col(time) - own * span < min_sep, (own + 1) * span - F.col(time) <= min_sep
    places = F.array(F.struct(own.alias("b"), F.lit(False).alias("h")), F.struct(F.when(near_start, own - 1).alias("b"), F.lit(True).alias("h")), F.struct(F.when(near_end, own + 1).alias("b"), F.lit(True).alias("h")))
    d = df.withColumn("_at", F.explode(F.filter(places, lambda p: ~p["h"] | p["b"].isNotNull())))
    w = W.partitionBy(*keys, "_at.b").orderBy(time, tie)
    near = lambda other: F.coalesce(F.abs(F.col(time) - other.over(w)) < min_sep, F.lit(False))
    return d.withColumn("is_close", near(F.lag(time)) | near(F.lead(time))).filter(~F.col("_at.h")).drop("_at")


def _ticks(segments: DataFrame, keys: list[str], day: str) -> DataFrame:
    """Segments with _rate, the largest of their day, and their samples as whole ticks of it since midnight: _from to _to (exclusive), inside the day; and the time of the last sample.

    A segment that begins in the last half tick of its day has none of them (_from and _to are the day's end), but it is a record of that day and stays.
    """
    rates = segments.groupBy(*[F.col(k).alias(f"_r{k}") for k in [*keys, day]]).agg(F.max("sampling_rate").alias("_rate"))
    s = segments.join(rates, [segments[k].eqNullSafe(rates[f"_r{k}"]) for k in [*keys, day]]).drop(*[f"_r{k}" for k in [*keys, day]])
    first = F.round((F.col("starttime") - F.col(day) * 86400) * F.col("_rate")).cast("long")
    s = s.withColumns({"_from": first, "_last": F.col("starttime") + (F.col("npts") - 1) / F.col("sampling_rate"), "_whole": F.round(86400 * F.col("_rate")).cast("long")})
    s = s.withColumns({"_to": F.least(F.col("_from") + F.col("npts"), F.col("_whole")), "_from": F.greatest(F.col("_from"), F.lit(0))})
    return s.filter((F.col("_to") > F.col("_from")) | (F.col("npts") > 0) & (F.col("_from") == F.col("_whole")))


def _uncovered(spans: DataFrame, keys: list[str], least: Column) -> DataFrame:
    """Runs of ticks (_a to _b, exclusive) of each key that fewer than `least` spans cover, by a sweep over their ends.

    With the times of the last sample before and of the first one after a run, null at the edges of a day.
    """
    events = F.array(
        F.struct(F.col("_from").alias("t"), F.lit(1).alias("d"), F.lit(None).cast("double").alias("last"), F.col("_begins").alias("next")),
        F.struct(F.col("_to").alias("t"), F.lit(-1).alias("d"), F.col("_ends").alias("last"), F.lit(None).cast("double").alias("next")),
        F.struct(F.lit(0).cast("long").alias("t"), F.lit(0).alias("d"), F.lit(None).cast("double").alias("last"), F.lit(None).cast("double").alias("next")),
        F.struct(F.col("_whole").alias("t"), F.lit(0).alias("d"), F.lit(None).cast("double").alias("last"), F.lit(None).cast("double").alias("next")),
    )
    e = spans.withColumn("_e", F.explode(events)).select(*keys, "_rate", "_whole", "_e.*")
    e = e.groupBy(*keys, "_rate", "_whole", "t").agg(F.sum("d").alias("d"), F.max("last").alias("_last"), F.min("next").alias("_next"))
    w = W.partitionBy(*keys).orderBy("t")
    e = e.withColumns({"_n": F.sum("d").over(w), "_b": F.lead("t").over(w), "_next": F.lead("_next").over(w)}).withColumn("_low", F.col("_n") < least)
    # Neighbouring pieces that are both uncovered (other channels come and go) are one run.
    e = e.filter("_b is not null").withColumn("_run", F.sum(F.coalesce((F.col("_low") != F.lag("_low").over(w)).cast("int"), F.lit(1))).over(w)).filter("_low")
    return e.groupBy(*keys, "_rate", "_whole", "_run").agg(F.min("t").alias("_a"), F.max("_b").alias("_b"), F.min_by("_last", "t").alias("_last"), F.max_by("_next", "t").alias("_next")).drop("_run")


def find_gaps(segments: DataFrame, keys: list[str], min_gap: float = 0.05, day: str = "day", channel: str | None = None, channels: int = 3, any_missing: bool = True) -> DataFrame:
    """Gaps of a channel-day before, between and after its segments: begin, end, duration, npts, start_ind, end_ind, sampling_rate.

    All is counted in whole samples. A gap begins with the last sample before it (or the day) and ends with the first one
    after it (or the day); npts are the samples missing between two segments or before the first one, and those from the
    last sample to the end of the day, unless a segment begins in its last half sample: then the gap ends with that; end_ind is start_ind + npts, from midnight. Edge gaps have to exceed one sample, all
    gaps `min_gap` seconds. With the name of a `channel` column the gaps are those of the day's `channels` channels
    together: where any (or, without any_missing, all) of them has no sample. Null keys are keys like others.
    """
    own = [*keys, day]
    t = _ticks(segments, [*keys, *([channel] if channel else [])], day).withColumns({"_begins": F.col("starttime"), "_ends": F.col("_last")})
    if channel:
        # Segments of a channel that overlap cover once: what its own sweep leaves uncovered is turned inside out.
        w = W.partitionBy(*own, channel).orderBy("_from", "_to")
        reach = F.max("_to").over(w.rowsBetween(W.unboundedPreceding, -1))
        t = t.withColumn("_island", F.sum((F.col("_from") > F.coalesce(reach, F.lit(-1))).cast("int")).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
        t = t.groupBy(*own, channel, "_rate", "_whole", "_island").agg(F.min("_from").alias("_from"), F.max("_to").alias("_to"), F.min_by("_begins", "_from").alias("_begins"), F.max_by("_ends", "_to").alias("_ends"))
    g = _uncovered(t, own, F.lit(channels if channel and any_missing else 1))
    midnight, head, tail = F.col(day) * 86400.0, F.col("_a") == 0, F.col("_b") == F.col("_whole")
    tail = tail if channel else tail & F.col("_next").isNull()
    npts = F.col("_b") - F.col("_a") + F.when(tail & ~head, 1).otherwise(0)
    g = g.select(
        *own,
        F.when(head, midnight).otherwise(F.coalesce("_last", midnight + (F.col("_a") - 1) / F.col("_rate"))).alias("begin"),
        F.when(tail, midnight + 86400).otherwise(F.coalesce("_next", midnight + F.col("_b") / F.col("_rate"))).alias("end"),
        (npts / F.col("_rate")).alias("duration"), npts.alias("npts"),
        F.greatest(F.col("_a") - 1, F.lit(0)).alias("start_ind"), F.col("_rate").alias("sampling_rate"), (head | tail).alias("_edge"),
    )
    least = F.ceil(F.lit(min_gap) * F.col("sampling_rate") - 1e-6)
    return g.filter((F.col("npts") >= least) & (F.col("npts") > F.col("_edge").cast("int"))).withColumn("end_ind", F.col("start_ind") + F.col("npts")).drop("_edge")


def sufficient_signal(segments: DataFrame, keys: list[str], min_percent: float) -> DataFrame:
    """Signal of each channel-day in percent, and whether it is enough."""
    g = segments.groupBy(*keys).agg(F.sum("npts").alias("npts"), F.max("sampling_rate").alias("rate"))
    return g.select(*keys, "npts", F.round(100 * F.col("npts") / (86400 * F.col("rate")), 6).alias("percent")).withColumn("enough", F.col("percent") >= min_percent)


def carry_over_tail(days: DataFrame, n: int, key: str = "station", order: str = "day") -> DataFrame:
    """Every day's data with the last n samples of the day before put before it, if that day ended less than 1.5 samples ago.

    Only (station, day, tail) rows are sorted by the window; the days are hashed to them once and never sorted.
    """
    w = W.partitionBy(key).orderBy(order)
    size = F.size("data")
    tails = days.select(key, order, "starttime", "sampling_rate", F.slice("data", F.greatest(F.lit(1), size - n + 1), F.least(F.lit(n), size)).alias("_tail"), (F.col("starttime") + size / F.col("sampling_rate")).alias("_end"))
    tails = tails.withColumns({"_before": F.lag("_tail").over(w), "_until": F.lag("_end").over(w)})
    gap = F.col("starttime") - F.col("_until") + 1 / F.col("sampling_rate")
    joined = F.coalesce(F.col("_before").isNotNull() & (gap > 0) & (gap < 1.5 / F.col("sampling_rate")), F.lit(False))
    tails = tails.select(key, order, joined.alias("previous_appended"), F.when(joined, F.col("_before")).alias("_before"))
    df = days.join(tails.hint("shuffle_hash"), [key, order])
    joined = F.col("previous_appended")
    return df.withColumns({"starttime": F.when(joined, F.col("starttime") - F.size("_before") / F.col("sampling_rate")).otherwise(F.col("starttime")), "data": F.when(joined, F.concat("_before", "data")).otherwise(F.col("data"))}).drop("_before")


def pick_ids(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """pick_id from 1 across groups in their order (null first): rank in the group after the counts of the groups before it.

    Groups are counted within the values of their first column, and only those values (stations) in one task.
    """
    first, rest = group[0], group[1:] or group
    counts = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumn("_within", F.sum("_n").over(W.partitionBy(first).orderBy(*rest)) - F.col("_n"))
    totals = counts.groupBy(first).agg(F.sum("_n").alias("_m"))
    totals = totals.withColumn("_earlier", F.sum("_m").over(W.orderBy(first)) - F.col("_m")).drop("_m")
    counts = join_on(counts, totals, [first]).withColumn("_before", F.col("_within") + F.col("_earlier")).drop("_within", "_earlier", "_n")
    inside = df.withColumn("_in", F.row_number().over(W.partitionBy(*group).orderBy(*order)))
    return join_on(inside, counts, group).withColumn("new_id", F.col("_before") + F.col("_in")).drop("_before", "_in")


def pick_rate(df: DataFrame) -> DataFrame:
    """Picks of each station-day and phase, with totals of station-days and stations; picks of no station are one of their own, told from the grand total by its grouping."""
    return df.rollup("station", "day", "phase").agg(F.count(F.lit(1)).alias("n"), F.grouping("station").alias("_all")).filter("_all = 0").drop("_all")


def iso_time(seconds: Column) -> Column:
    """Epoch seconds as an ISO time to the microsecond, without a fraction where it is 0."""
    micros = F.round(seconds * 1e6).cast("long")
    whole = F.date_format((F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=F.floor(micros / 1000000).cast("decimal(18,6)"))), "yyyy-MM-dd'T'HH:mm:ss")
    return F.concat(whole, F.when(micros % 1000000 != 0, F.format_string(".%06d", F.pmod(micros, F.lit(1000000)))).otherwise(""))


def station_day_metadata(segments: DataFrame, gaps: DataFrame, keys: list[str], day: str = "day", channel: str = "channel", appended: DataFrame | None = None) -> DataFrame:
    """One JSON document for each station-day: network, station, channel, rate, times, counts, and its gaps as [channel, start_epoch, end_epoch, npts, start_ind, end_ind].

    `keys` have network and station; `gaps` are those of single channels. The trace described is the filled one: it starts
    at midnight if there is a gap before the first sample, else with that, and ends likewise. Of several channels the
    orientation is a question mark. `appended` (keys, day, samples) tells how many samples of the day before were put before
    the trace, which moves its start and the indices of its gaps; the original_ fields stay.
    """
    own = [*keys, day]
    t = _ticks(segments, own[:-1], day)
    s = t.groupBy(*own).agg(F.min("_from").alias("_from"), F.max("_to").alias("_to"), F.max("_whole").alias("_whole"), F.max("_rate").alias("sampling_rate"), F.min("starttime").alias("_first"), F.max("_last").alias("_end"), F.min(channel).alias("_code"), F.count_distinct(channel).alias("_codes"))
    midnight, rate = F.col(day) * 86400.0, F.col("sampling_rate")
    s = s.withColumns({"_head": F.col("_from") > 1, "_tail": F.col("_whole") - F.col("_to") > 0})
    s = s.withColumns({"_from": F.when(F.col("_head"), 0).otherwise(F.col("_from")), "_to": F.when(F.col("_tail"), F.col("_whole")).otherwise(F.col("_to"))})
    s = s.withColumns({"original_starttime_epoch": F.when(F.col("_head"), midnight).otherwise(F.col("_first")), "original_endtime_epoch": F.when(F.col("_tail"), midnight + (F.col("_to") - 1) / rate).otherwise(F.col("_end")), "original_npts": F.col("_to") - F.col("_from")})
    same = lambda a, b, names: [a[k].eqNullSafe(b[f"_m{k}"]) for k in names]
    if appended is not None:
        a = appended.select(*[F.col(k).alias(f"_m{k}") for k in own], "samples")
        s = s.join(a, same(s, a, own), "left").drop(*[f"_m{k}" for k in own]).withColumn("samples", F.coalesce("samples", F.lit(0)))
    else:
        s = s.withColumn("samples", F.lit(0))
    s = s.withColumns({"previous_appended": F.col("samples") > 0, "channel": F.when(F.col("_codes") > 1, F.concat(F.substring("_code", 1, 2), F.lit("?"))).otherwise(F.col("_code")), "dt": 1 / rate, "starttime_epoch": F.col("original_starttime_epoch") - F.col("samples") / rate, "endtime_epoch": F.col("original_endtime_epoch"), "npts": F.col("original_npts") + F.col("samples")})
    s = s.withColumns({"starttime": iso_time(F.col("starttime_epoch")), "original_starttime": iso_time(F.col("original_starttime_epoch")), "original_endtime": iso_time(F.col("original_endtime_epoch"))})
    g = gaps.select(*[F.col(k).alias(f"_m{k}") for k in own], F.col(channel).alias("_gc"), "begin", "end", F.col("npts").alias("_gn"), F.col("start_ind").alias("_gs"))
    g = g.groupBy(*[f"_m{k}" for k in own]).agg(F.sort_array(F.collect_list(F.struct("_gc", "begin", "end", "_gn", "_gs"))).alias("_gaps"))
    df = s.join(g, same(s, g, own), "left")
    shift = F.col("samples") - F.col("_from")
    at = lambda x: x["_gs"] + shift
    none = F.array().cast(g.schema["_gaps"].dataType)
    texts = F.transform(F.coalesce("_gaps", none), lambda x: F.format_string('["%s", %.6f, %.6f, %d, %d, %d]', x["_gc"], x["begin"], x["end"], x["_gn"], at(x), at(x) + x["_gn"]))
    fields = ["network", "station", "channel", "sampling_rate", "dt", "starttime", "npts", "starttime_epoch", "endtime_epoch", "previous_appended", "original_starttime", "original_endtime", "original_starttime_epoch", "original_endtime_epoch", "original_npts"]
    head = F.regexp_replace(F.to_json(F.struct(*[F.col(c) for c in fields])), r"\}$", "")
    return df.select(*own, F.size(texts).cast("long").alias("n_gaps"), F.concat(head, F.lit(',"gaps":['), F.array_join(texts, ","), F.lit("]}")).alias("metadata"))


def data_issue_report(issues: DataFrame) -> DataFrame:
    """Days of each station by kind of error, in order."""
    return issues.groupBy("station", "error").agg(F.sort_array(F.collect_list("day")).alias("days"))


def empirical_cdf(df: DataFrame, col: str, n: int) -> DataFrame:
    """Share of rows at or under each of n even steps from the smallest to the largest value.

    Values fall into the steps first, so the cumulative sum runs over n rows only.
    """
    ends = df.agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"), F.count(col).alias("_n"))
    width = (F.col("_hi") - F.col("_lo")) / (n - 1)
    step = F.greatest(F.lit(0), F.ceil(F.round((F.col(col) - F.col("_lo")) / F.when(width > 0, width).otherwise(1.0), 9))).cast("int")
    counts = df.filter(F.col(col).isNotNull()).join(F.broadcast(ends)).withColumn("step", step).groupBy("step").agg(F.count(F.lit(1)).alias("_c"))  # one row
    grid = ends.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("step"))
    total = F.sum(F.coalesce("_c", F.lit(0))).over(W.orderBy("step"))
    return grid.join(counts, "step", "left").select("step", F.round(F.col("_lo") + F.col("step") * width, 6).alias("x"), F.round(total / F.col("_n"), 6).alias("share"))


def sta_lta(df: DataFrame, short: int, long: int, keys: list[str], order: str, value: str) -> DataFrame:
    """Ratio of the short to the long trailing mean of value squared; null until the long window is full."""
    w = W.partitionBy(*keys).orderBy(order)
    mean = lambda n: F.avg(F.col(value) * F.col(value)).over(w.rowsBetween(-(n - 1), 0))
    full = F.row_number().over(w) >= long
    return df.withColumn("ratio", F.when(full & (mean(long) > 0), F.round(mean(short) / mean(long), 6)))


def trigger_on_off(df: DataFrame, on: float, off: float, keys: list[str], order: str, ratio: str = "ratio") -> DataFrame:
    """(keys, begin, end): from the first ratio of at least `on` to the last before it falls under `off`."""
    w = W.partitionBy(*keys).orderBy(order)
    run = F.sum(F.coalesce(F.col(ratio) < off, F.lit(True)).cast("int")).over(w)
    above = df.withColumn("_run", run).filter(F.col(ratio) >= off)
    g = above.groupBy(*keys, "_run").agg(F.min(F.when(F.col(ratio) >= on, F.col(order))).alias("begin"), F.max(order).alias("end"))
    return g.filter(F.col("begin").isNotNull()).drop("_run")
