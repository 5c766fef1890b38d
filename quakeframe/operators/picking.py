"""Windows, scoring, stitching and picking of continuous series."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quakeframe.functions import arrays, kernels
from quakeframe.operators.keys import join_on, number

PICKS = "array<struct<index: int, width: int, probability: double>>"


def _pick_column(found: list[list[tuple[int, int, float]]]) -> pa.Array:
    """Picks of each series as an Arrow array of structs."""
    flat = [k for f in found for k in f]
    index, width, probability = zip(*flat, strict=True) if flat else ((), (), ())
    fields = [pa.array(index, pa.int32()), pa.array(width, pa.int32()), pa.array(probability, pa.float64())]
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.StructArray.from_arrays(fields, ["index", "width", "probability"]))


def _series(column: pa.Array) -> Iterator[np.ndarray | None]:
    """The rows of a list column as arrays, without a copy of each value."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = column.values.to_numpy(zero_copy_only=False)
    for k, (a, b) in enumerate(zip(column.offsets.to_numpy(), column.offsets.to_numpy()[1:], strict=False)):
        yield values[a:b].astype(float) if column[k].is_valid else None


def extract_picks(df: DataFrame, p: str, threshold: float, drop: float = 0.05) -> DataFrame:
    """Rows with `picks` of their probability series, one Arrow batch of series at a time; none of a null series."""

    @F.arrow_udf(PICKS)
    def picks(series: pa.Array) -> pa.Array:
        return _pick_column([kernels.extract(v, threshold, drop) if v is not None else [] for v in _series(series)])

    return df.withColumn("picks", picks(F.col(p)))


def extract_picks_chunks(df: DataFrame, keys: list[str], order: str, p: str, threshold: float, drop: float = 0.05) -> DataFrame:
    """keys and `picks` of series that lie in chunks, in the order of `order`: those of the whole series, however it is cut.

    No pick crosses a sample under threshold - drop. So a chunk's picks between its first and its last such sample are
    found where the chunk lies; only they and the samples before and after go on, which are few where the probability is low.
    What is open between two chunks is closed when the pieces of a series meet in order.
    """
    low = kernels.lower(threshold, drop)

    @F.arrow_udf(f"struct<n: long, head: array<double>, tail: array<double>, low: boolean, picks: {PICKS}>")
    def parts(series: pa.Array) -> pa.Array:
        rows, found = [], []
        for v in _series(series):
            v = np.zeros(0) if v is None else v
            head, tail, has = kernels.parted(v, low)
            inner = kernels.extract(v[len(head) : len(v) - len(tail)], threshold, drop) if has else []
            found.append([(i + len(head), w, q) for i, w, q in inner])
            rows.append((len(v), head, tail, has))
        n, heads, tails, lows = zip(*rows, strict=True) if rows else ((), (), (), ())
        lists = lambda x: pa.array([h.tolist() for h in x], pa.list_(pa.float64()))
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), lists(heads), lists(tails), pa.array(lows, pa.bool_()), _pick_column(found)], ["n", "head", "tail", "low", "picks"])

    fields = df.select(*keys).schema
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)

    def close(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        before = np.cumsum([0, *pdf["n"]])
        found = [(int(at + k["index"]), k["width"], k["probability"]) for at, own in zip(before, pdf["picks"], strict=False) for k in own]
        found += kernels.joined_picks([(n, np.asarray(h, float), np.asarray(t, float), bool(has)) for n, h, t, has in zip(pdf["n"], pdf["head"], pdf["tail"], pdf["low"], strict=True)], threshold, drop)
        picks = [{"index": i, "width": int(w), "probability": q} for i, w, q in sorted(found)]
        return pd.DataFrame([{**{k: pdf.iloc[0][k] for k in keys}, "picks": picks}])

    slim = df.select(*keys, order, parts(F.col(p)).alias("_c")).select(*keys, order, "_c.*")
    return slim.groupBy(*keys).applyInPandas(close, f"{ddl}, picks {PICKS}")


def sliding_windows(df: DataFrame, x: str, window: int, slide: int) -> DataFrame:
    """One row per whole window: window_id, start and its samples."""
    starts = arrays.window_starts(F.size(x), window, slide)
    return df.select("*", F.posexplode(starts).alias("window_id", "start")).withColumn(x, F.slice(x, F.col("start") + 1, F.lit(window)))


def stitch(df: DataFrame, keys: list[str], p: str, window: int, slide: int, start_pad: int, npts: int) -> DataFrame:
    """Windowed series put together again: the central `slide` samples of each window in order, less the padding; the outer edges of the first and last window stay."""
    edge = (window - slide) // 2
    ordered = F.array_sort(F.collect_list(F.struct("window_id", F.col(p).alias("p"))))
    g = df.groupBy(*keys).agg(ordered.alias("_w"))
    last = F.size("_w") - 1
    middle = F.transform("_w", lambda w, i: F.slice(w["p"], F.when(i == 0, 1).otherwise(edge + 1), F.when(last == 0, window).when((i == 0) | (i == last), edge + slide).otherwise(slide)))
    return g.select(*keys, F.slice(F.flatten(middle), F.lit(start_pad + 1), F.lit(npts)).alias(p))


def hour_chunks(df: DataFrame, x: str, chunk: int, buffer: int) -> DataFrame:
    """One row per chunk with `buffer` samples more on both sides where there are any: chunk_id, lead (samples before the chunk) and its samples."""
    n = F.size(x)
    starts = F.sequence(F.lit(0), n - 1, F.lit(chunk))
    df = df.select("*", F.posexplode(starts).alias("chunk_id", "_at")).withColumn("lead", F.least(F.lit(buffer), F.col("_at")))
    return df.withColumn(x, F.slice(x, F.col("_at") - F.col("lead") + 1, F.col("lead") + F.lit(chunk + buffer))).drop("_at")


def join_chunks(df: DataFrame, keys: list[str], x: str, chunk: int) -> DataFrame:
    """Chunks put together again without their buffers."""
    g = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("chunk_id", "lead", F.col(x).alias("x")))).alias("_c"))
    return g.select(*keys, F.flatten(F.transform("_c", lambda c: F.slice(c["x"], c["lead"] + 1, F.lit(chunk)))).alias(x))


Scorer = Callable[[np.ndarray], np.ndarray]


def score_windows(df: DataFrame, x: str, make_scorer: Callable[[], Scorer], batch: int, out: str = "p") -> DataFrame:
    """Rows with the scores of their windows. The scorer is made once a task and gets full batches; a short one is filled up with zeros."""

    @F.pandas_udf("array<double>")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = make_scorer()
        for s in parts:
            rows = []
            for at in range(0, len(s), batch):
                full = np.zeros((batch, len(s.iloc[at])))
                some = np.stack(s.iloc[at : at + batch].to_list())
                full[: len(some)] = some
                rows += list(scorer(full)[: len(some)])
            yield pd.Series([np.asarray(r, float) for r in rows])

    return df.withColumn(out, score(F.col(x)))


def score_picks(df: DataFrame, x: str, make_scorer: Callable[[], Scorer], draws: int, out: str = "preds") -> DataFrame:
    """Rows with an ensemble of `draws` scores of their window."""

    @F.pandas_udf("array<double>")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = make_scorer()
        for s in parts:
            yield pd.Series(list(np.stack([scorer(np.stack(s.to_list())) for _ in range(draws)], axis=1))) if len(s) else s

    return df.withColumn(out, score(F.col(x)))


#: Epochs that evaluate_over_models puts beside every example where that is cheaper than a shuffle.
MAX_EPOCHS = 1000


def evaluate_over_models(df: DataFrame, epochs: DataFrame, scorer: Callable[[Column, Column], Column], centre: int | None = None) -> DataFrame:
    """Each example with each epoch: the lag of its pick from the true one, and its probability. More than MAX_EPOCHS epochs are refused: every example is scored by every one."""
    listed = [r[0] for r in epochs.select("epoch").limit(MAX_EPOCHS + 1).collect()]
    if len(listed) > MAX_EPOCHS:
        raise ValueError(f"more than {MAX_EPOCHS} epochs")
    j = df.withColumn("epoch", F.explode(F.lit(listed).cast(f"array<{epochs.schema['epoch'].dataType.simpleString()}>")))
    j = j.withColumn("_p", scorer(F.col("x"), F.col("epoch"))).withColumn("est", arrays.single_pick(F.col("_p"), centre))
    return j.select("epoch", "row_id", (F.col("true_index") - F.col("est")).alias("residual"), F.element_at("_p", F.col("est") + 1).alias("probability"))


def processed(df: DataFrame, x: str, low: float = 1.0, high: float = 17.0, rate: float = 100.0, corners: int = 2) -> DataFrame:
    """x less its line, tapered and band-passed; rows of one length are filtered together."""
    sections = kernels.bandpass_sections(low, high, rate, corners)

    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(s), dtype=object)
        sizes = s.map(lambda v: -1 if v is None else len(v))
        for n, rows in s.groupby(sizes):
            if n > 0:
                done = kernels.sections_applied(sections, kernels.tapered(kernels.detrended(np.stack(rows.to_list()).astype(float))))
                for k, r in zip(rows.index, done, strict=True):
                    out.at[k] = r
        return out

    return df.withColumn(x, run(F.col(x)))


def processed_chunks(df: DataFrame, keys: list[str], order: str, x: str, low: float = 1.0, high: float = 17.0, rate: float = 100.0, corners: int = 2) -> DataFrame:
    """`processed` of series that lie in chunks, in the order of `order`: each chunk's samples are those of the whole series.

    Line and taper take sums and places of the chunks. The recursion runs in every chunk from a state of 0 first; the
    states handed over, a few numbers a chunk, are added up along the series, and the chunks are filtered from them. Only
    rows without samples are sorted or grouped.
    """
    sections = kernels.bandpass_sections(low, high, rate, corners)
    k = 2 * len(sections)
    n = F.size(x).cast("long")
    sums = df.select(*keys, order, n.alias("_n"), F.aggregate(x, F.lit(0.0), lambda a, v: a + v).alias("_s"), F.aggregate(F.transform(x, lambda v, i: v * i), F.lit(0.0), lambda a, v: a + v).alias("_t"))
    w, whole = W.partitionBy(*keys).orderBy(order), W.partitionBy(*keys)
    sums = sums.withColumn("_at", F.sum("_n").over(w) - F.col("_n")).withColumns({"_all": F.sum("_n").over(whole), "_sum": F.sum("_s").over(whole), "_moment": F.sum(F.col("_t") + F.col("_at") * F.col("_s")).over(whole)})
    total = F.col("_all").cast("double")
    middle = (total - 1) / 2
    slope = F.coalesce(F.try_divide(F.col("_moment") - middle * F.col("_sum"), total * (total * total - 1) / 12), F.lit(0.0))
    plan = sums.select(*keys, order, "_at", "_all", slope.alias("_slope"), (F.col("_sum") / total - slope * middle).alias("_level"))

    def prepared(v: np.ndarray, at: int, all_: int, slope: float, level: float) -> np.ndarray:
        place = np.arange(at, at + len(v))
        return (v - level - slope * place) * kernels.taper_weights(all_, at, len(v))

    facts = ["_at", "_all", "_slope", "_level"]
    chunks = join_on(df, plan, [*keys, order])

    @F.arrow_udf("array<double>")
    def ends(series: pa.Array, at: pa.Array, all_: pa.Array, slope: pa.Array, level: pa.Array) -> pa.Array:
        rest = zip(*[c.to_pylist() for c in (at, all_, slope, level)], strict=True)
        return pa.array([kernels.sections_run(sections, prepared(v, *f))[1].tolist() for v, f in zip(_series(series), rest, strict=True)], pa.list_(pa.float64()))

    @F.arrow_udf("array<double>")
    def filtered(series: pa.Array, at: pa.Array, all_: pa.Array, slope: pa.Array, level: pa.Array, state: pa.Array) -> pa.Array:
        rest = zip(*[c.to_pylist() for c in (at, all_, slope, level)], strict=True)
        return pa.array([kernels.sections_run(sections, prepared(v, *f), np.array(z))[0] for v, f, z in zip(_series(series), rest, state.to_pylist(), strict=True)], pa.list_(pa.float64()))

    def carried(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, state, out = pdf.sort_values(order), np.zeros(k), []
        for size, end in zip(pdf["_n"], pdf["_end"], strict=True):
            out.append(state)
            state = kernels.transition(sections, int(size)) @ state + np.asarray(end)
        return pdf.drop(columns=["_n", "_end"]).assign(_state=out)

    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys, order).schema)
    states = chunks.select(*keys, order, n.alias("_n"), ends(F.col(x), *map(F.col, facts)).alias("_end")).groupBy(*keys).applyInPandas(carried, f"{ddl}, _state array<double>")
    done = join_on(chunks, states, [*keys, order])
    return done.withColumn(x, filtered(F.col(x), *map(F.col, facts), F.col("_state"))).drop(*facts, "_state")


def sta_lta_arrays(df: DataFrame, x: str, short: int, long: int, out: str = "ratio", keys: list[str] | None = None, order: str | None = None) -> DataFrame:
    """Rows with the ratio of the short to the long trailing mean of x squared, by sums along the array; null until the long window is full.

    With `keys` and `order`, numbers from any one on without a gap, rows are chunks of series, of `long` - 1 samples at
    least: each takes the end of the chunk before it, found by an equi-join.
    """

    @F.arrow_udf("array<double>")
    def ratio(series: pa.Array, lead: pa.Array) -> pa.Array:
        rows = []
        for v, before in zip(_series(series), _series(lead), strict=True):
            if v is None:
                rows.append(None)
                continue
            before = np.zeros(0) if before is None else before
            r = kernels.window_ratio(np.concatenate([before, v]), short, long)[len(before) :]
            rows.append([None if np.isnan(q) else q for q in r.tolist()])
        return pa.array(rows, pa.list_(pa.float64()))

    if keys is None:
        return df.withColumn(out, ratio(F.col(x), F.array().cast("array<double>")))
    size = F.size(x)
    ends = df.select(*keys, (F.col(order) + 1).alias(order), F.slice(x, F.greatest(F.lit(1), size - long + 2), F.least(F.lit(long - 1), size)).cast("array<double>").alias("_lead"))
    return join_on(df, ends, [*keys, order], "left").withColumn(out, ratio(F.col(x), F.col("_lead"))).drop("_lead")


def trigger_arrays(df: DataFrame, ratio: str, on: float, off: float, out: str = "triggers") -> DataFrame:
    """Rows with their triggers (begin, end): from the first ratio of at least `on` to the last one before it falls under `off`, or is unknown."""

    @F.arrow_udf("array<struct<begin: int, end: int>>")
    def run(series: pa.Array) -> pa.Array:
        found = [kernels.triggers(np.array([np.nan if q is None else q for q in v], float), on, off) if v is not None else [] for v in series.to_pylist()]
        flat = [k for f in found for k in f]
        begin, end = zip(*flat, strict=True) if flat else ((), ())
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.StructArray.from_arrays([pa.array(begin, pa.int32()), pa.array(end, pa.int32())], ["begin", "end"]))

    return df.withColumn(out, run(F.col(ratio)))


def apply_processing(df: DataFrame, x: str, function: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Rows with a user's function of one waveform applied to x."""

    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: np.asarray(function(np.asarray(v, float)), float) if v is not None else None)

    return df.withColumn(x, run(F.col(x)))


def cut_pick_windows(picks: DataFrame, traces: DataFrame, keys: list[str], n: int, margin: int, process: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Every pick (`index`) with exactly n samples `x` around it from its station-day's trace; zeros beyond the day's edges.

    `process` gets rows whose x has `margin` more samples on both sides, where there are any, which are cut off afterwards.
    The picks of a station-day are collected, so its trace is joined once and never lies in a row for each pick.
    """
    own = [c for c in picks.columns if c not in keys]
    g = picks.groupBy(*keys).agg(F.collect_list(F.struct(*own)).alias("_picks"))
    j = g.join(traces.select(*keys, F.col("x").alias("_trace")), keys)
    begin = lambda p: F.greatest(p["index"] - n // 2 - margin, F.lit(0)).cast("int")
    size = lambda p: F.greatest(F.least(F.size("_trace"), p["index"] - n // 2 + n + margin) - begin(p), F.lit(0)).cast("int")
    cut = F.transform("_picks", lambda p: F.struct(p.alias("p"), begin(p).alias("begin"), F.slice("_trace", begin(p) + 1, size(p)).alias("x")))
    df = j.select(*keys, F.explode(cut).alias("_c")).select(*keys, "_c.p.*", F.col("_c.begin").alias("_begin"), "_c.x")
    df = process(df) if process else df
    return df.withColumn("x", arrays.cut_padded(F.col("x"), F.col("index") - n // 2 - F.col("_begin"), n)).drop("_begin")


def margins_removed(df: DataFrame, x: str, margin: int) -> DataFrame:
    """x without `margin` samples at both ends."""
    return df.withColumn(x, F.slice(x, margin + 1, F.size(x) - 2 * margin))


def vertical_only(df: DataFrame, comps: dict[str, str]) -> DataFrame:
    """Rows with their vertical component alone; comps names the columns of e, n and z."""
    return df.drop(comps["e"], comps["n"])


def reordered(df: DataFrame, order: list[str], names: list[str]) -> DataFrame:
    """Component columns given in one order, named in another: values move, names stay."""
    return df.withColumns({new: F.col(old) for old, new in zip(order, names, strict=True)})


def component_noise(df: DataFrame, keys: list[str], comps: list[str]) -> DataFrame:
    """Mean over the rows of each group of the variance of each component: {component}_noise."""
    return df.groupBy(*keys).agg(*[F.avg(arrays.variance(F.col(c))).alias(f"{c}_noise") for c in comps])


def stack_components(df: DataFrame, keys: list[str], x: str = "x", component: str = "component", channel: str = "channel") -> DataFrame:
    """keys, channel (HH?, BH? ...), npts, and the samples of E, N and Z as x_e, x_n and x_z, of keys that have one of each.

    Components of another length than the longest one are cut to it, or filled up with their last sample, if they lack
    one sample at most; else the key goes. Of a component given twice the row with the smaller channel code counts.
    """
    of = {c: F.min(F.when(F.col(component) == c.upper(), F.struct(F.col(channel).alias("channel"), F.col(x).alias("x")))).alias(f"_{c}") for c in "enz"}
    g = df.filter(F.col(x).isNotNull()).groupBy(*keys).agg(*of.values()).dropna(subset=[f"_{c}" for c in "enz"])
    n = F.greatest(*[F.size(f"_{c}.x") for c in "enz"])
    g = g.withColumn("npts", n).filter(F.least(*[F.size(f"_{c}.x") for c in "enz"]) >= F.greatest(F.col("npts") - 1, F.lit(1)))
    full = lambda c: F.concat(F.col(f"_{c}.x"), F.array_repeat(F.element_at(f"_{c}.x", -1), F.col("npts") - F.size(f"_{c}.x")))
    return g.select(*keys, F.concat(F.substring("_z.channel", 1, 2), F.lit("?")).alias("channel"), "npts", *[full(c).alias(f"x_{c}") for c in "enz"])


def align_components(df: DataFrame, keys: list[str], span: float, x: str = "x", component: str = "component", start: str = "starttime", dt: str = "dt") -> DataFrame:
    """keys, starttime, dt, npts, and the samples of E, N and Z as x_e, x_n and x_z, all of one length.

    Components of one length stay as they are, and starttime is E's. Else the last one in the order E, N, Z that is complete
    (`span` seconds with both ends, or one sample less) gives start and length: the others are cut to it at the nearest
    sample and filled up with zeros. Keys without a complete component, with one missing, or with different sampling
    intervals go. Of a component given twice the row that starts first counts; rows without samples, start or interval don't.
    """
    known = F.col(x).isNotNull() & number(F.col(start)).isNotNull() & (number(F.col(dt)) > 0)
    own = F.struct(F.col(start).cast("double").alias("t"), F.col(dt).cast("double").alias("dt"), F.col(x).alias("x"))
    g = df.filter(known).groupBy(*keys).agg(*[F.min(F.when(F.col(component) == c.upper(), own)).alias(f"_{c}") for c in "enz"])
    g = g.dropna(subset=["_e", "_n", "_z"]).filter("_e.dt = _n.dt AND _n.dt = _z.dt")
    size = {c: F.size(f"_{c}.x") for c in "enz"}
    equal = (size["e"] == size["n"]) & (size["n"] == size["z"])
    full = F.round(span / F.col("_e.dt")).cast("long") + 1
    place = {c: F.struct(F.col(f"_{c}.t").alias("t"), size[c].alias("n")) for c in "enz"}
    complete = F.coalesce(*[F.when((size[c] == full) | (size[c] == full - 1), place[c]) for c in "zne"])
    g = g.withColumn("_to", F.when(equal, place["e"]).otherwise(complete)).filter(F.col("_to").isNotNull())

    def fitted(c: str) -> Column:
        shift = F.round((F.col("_to.t") - F.col(f"_{c}.t")) / F.col("_e.dt")).cast("long")
        return F.when(equal, F.col(f"_{c}.x")).otherwise(arrays.fitted(F.col(f"_{c}.x"), shift, F.col("_to.n")))

    return g.select(*keys, F.col("_to.t").alias("starttime"), F.col("_e.dt").alias("dt"), F.col("_to.n").alias("npts"), *[fitted(c).alias(f"x_{c}") for c in "enz"])


def augmented(df: DataFrame, x: str, key: str, pick_sample: int, seconds: float, dt: float, max_shift: float, copies: int, seed: str, y: str | None = None, shrinkage: float | None = None) -> DataFrame:
    """`copies` rows of each, with copy (from 1), lag, pick_index, and of x (over its largest value) a window that starts at the lag from where the pick would be in its middle.

    The window has `pad_length` samples; lags are drawn up to `largest_lag`. A trace as long as the window is taken as it
    is. Of a mask `y` the same samples are cut, less what `shrinkage` takes off at both ends. A window that leaves its
    trace is null.
    """
    n = arrays.pad_length(seconds, dt)
    most = arrays.largest_lag(max_shift, n)
    d = df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies)))).withColumn("lag", arrays.random_lag(seed, F.col(key), F.col("copy"), most))
    start = F.when(F.size(x) == n, 0).otherwise(int(pick_sample - n / 2) + F.col("lag"))
    d = d.withColumns({"pick_index": n // 2 - F.col("lag"), "_start": start})
    inner = n if shrinkage is None else int(shrinkage * n)
    cuts = {x: arrays.normalise(arrays.cut(F.col(x), F.col("_start"), n), 0.0)}
    if y:
        cuts[y] = arrays.cut(F.col(y), F.col("_start") + (n - inner) // 2, inner)
    return d.withColumns(cuts).drop("_start")


def random_start_times(df: DataFrame, x: str, key: str, n: int, max_seconds: float, dt: float, seed: str, first_motion: bool = False) -> DataFrame:
    """Rows with lag, and n samples of x over their largest value: around its middle, the lag earlier, with the lag in seconds as `label`; for first motions the lag later, and no label, since it doesn't change."""
    d = df.withColumn("lag", arrays.random_lag(seed, F.col(key), F.lit(1), int(max_seconds / dt)))
    begin = (F.floor(F.size(x) / 2) - n // 2).cast("int")
    d = d.withColumn(x, arrays.normalise(arrays.cut(F.col(x), begin + F.col("lag") if first_motion else begin - F.col("lag"), n), 0.0))
    return d if first_motion else d.withColumn("label", F.round(F.col("lag") * dt, 9))


def pair_shifts(df: DataFrame, key: str, distance: str, seed: str, length: int, centre: tuple[int, int], min_second: int, min_separation: int, first_margin: int, boxcar: int, margin: int = 50, rate: float = 100.0, speed: float = 6.0) -> DataFrame:
    """Rows with min_sep, first, second, shift, and `feasible`: where two events stand in a window of `length` samples, and how much later the second window starts.

    The events are as far apart as S and P at the `distance` (km), `margin` more, within bounds. The first one is drawn in
    the `centre` (from, to), at least `first_margin` before its end; the second one after it, out of the centre by its
    `boxcar`, with `min_second` samples left; the shift so that the second event stands in the centre and the first one, with
    its boxcar, before it. Draws are a key's own stream. Where a range is empty (or the distance unknown) feasible is false, and what couldn't be drawn is null.
    """
    low, high = centre
    sep = F.least((F.col(distance) / speed * rate).cast("long") + margin, F.lit(length - min_second - low - margin).cast("long"))
    sep = F.when(F.col(distance).isNotNull() & ~F.isnan(F.col(distance).cast("double")), F.greatest(F.lit(min_separation).cast("long"), sep))
    d = df.withColumn("min_sep", sep)
    top = F.least(length - min_second - F.col("min_sep"), F.lit(high - first_margin).cast("long"))
    d = d.withColumn("first", F.when(F.col("min_sep").isNotNull(), arrays.random_integer(seed, F.col(key), 1, F.lit(low).cast("long"), top)))
    under = F.greatest(F.lit(high + boxcar).cast("long"), F.col("first") + F.col("min_sep"))
    d = d.withColumn("second", F.when(F.col("first").isNotNull(), arrays.random_integer(seed, F.col(key), 2, under, F.lit(length - min_second).cast("long"))))
    least = F.greatest(F.col("first") - (low - boxcar - 1), F.col("second") - (high - 1))
    most = F.least(F.col("first") - boxcar - 1, F.col("second") - low)
    d = d.withColumn("shift", F.when(F.col("second").isNotNull(), arrays.random_integer(seed, F.col(key), 3, least, most)))
    return d.withColumn("feasible", F.col("shift").isNotNull())


def absolute_times(df: DataFrame, start: Column, index: str, dt: float = 0.01, correction: str | None = None) -> DataFrame:
    """Rows with arrival_time: that of the first sample, dt for each sample of the index, and a correction in seconds if there is one (null counts as none)."""
    more = F.coalesce(F.col(correction), F.lit(0.0)) if correction else F.lit(0.0)
    return df.withColumn("arrival_time", F.round(start + dt * F.col(index) + more, 6))


def append_pairs(single: DataFrame, pairs: DataFrame) -> DataFrame:
    """Two-event examples after the others, which have no second pick."""
    return single.unionByName(pairs, allowMissingColumns=True)


def resample(df: DataFrame, x: str, old: float, new: float) -> DataFrame:
    """x at another sampling rate."""

    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: kernels.resampled(np.asarray(v, float), old, new) if v is not None and len(v) else v)

    return df.withColumn(x, run(F.col(x)))


def fill_gaps(segments: DataFrame, keys: list[str], day: str = "day") -> DataFrame:
    """One row per channel-day with all its samples; a group is a channel's day, so its size is bounded by the rate."""
    fields = segments.select(*keys, day).schema
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("starttime")
        first = pdf.iloc[0]
        data = kernels.merged_day(pdf["starttime"].to_numpy(), [np.asarray(v, float) for v in pdf["data"]], float(first["sampling_rate"]), float(first[day]) * 86400)
        return pd.DataFrame([{**{k: first[k] for k in [*keys, day]}, "data": data}])

    return segments.groupBy(*keys, day).applyInPandas(run, f"{ddl}, data array<double>")


def ensemble_summary(df: DataFrame, preds: str, k: float = 1.5) -> DataFrame:
    """Rows with median and std of their ensemble inside its own fence."""
    return df.withColumn("_s", arrays.fenced_summary(F.col(preds), k)).select("*", "_s.shift", "_s.std", F.col("_s.n").alias("n_kept")).drop("_s")


def mix_pairs(df: DataFrame, n: int, half: int, lead: int = 10, taper: int = 9) -> DataFrame:
    """Two rows for each pair of traces x1, x2 (arrivals in their middle): `window` 1 shows the first event where `first` puts it, `window` 2 starts `shift`
    samples later, so that the second one, at `second`, stands there.

    Each has n samples x over their largest absolute value, the mask y of both arrivals, and the places of its own and of the other
    arrival, pick_index and pick_index2. Other columns are kept.
    """
    first, second, shift = (F.col(c).cast("int") for c in ("first", "second", "shift"))
    kinds = F.array(*[F.struct(F.lit(k).alias("window"), o.alias("_offset"), a.alias("pick_index"), b.alias("pick_index2")) for k, o, a, b in ((1, F.lit(0), first, second), (2, shift, second - shift, first - shift))])
    w = df.withColumn("_k", F.explode(kinds)).select("*", "_k.*").drop("_k")
    x = arrays.mixed_window(F.col("x1"), F.col("x2"), first, second, F.col("_offset"), n, lead, taper)
    w = w.withColumns({"x": arrays.normalise(x, 0.0), "y": arrays.two_boxcars(first, second, F.col("_offset"), n, half)})
    return w.drop("x1", "x2", "_offset")


def inverse_isotonic(curve: DataFrame, observed: str, nominal: str) -> list[tuple[float, float]]:
    """Knots (observed, nominal) of the isotonic regression of nominal on observed quantiles: at most as many as the calibration curve has points, some tens."""
    from pyspark.ml.regression import IsotonicRegression

    points = curve.select(F.col(observed).cast("double").alias("features"), F.col(nominal).cast("double").alias("label"))
    model = IsotonicRegression().fit(points)
    return list(zip(model.boundaries.toArray().tolist(), model.predictions.toArray().tolist(), strict=True))


def calibrated_quantile(q: float, knots: list[tuple[float, float]]) -> float:
    """q on the line through the knots; that of the outer ones beyond them."""
    return float(np.interp(q, *zip(*knots, strict=True)))


def calibrated_bounds(df: DataFrame, y: str, std: str, knots: list[tuple[float, float]], lower: float, upper: float) -> DataFrame:
    """Rows with `lower` and `upper`: y and its std times the normal quantiles of the calibrated probabilities."""
    bound = lambda q: arrays.calibrated_bound(F.col(y), F.col(std), calibrated_quantile(q, knots))
    return df.withColumns({"lower": bound(lower), "upper": bound(upper)})
