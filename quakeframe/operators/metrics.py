"""Evaluation of detectors, pickers and first-motion classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quakeframe.operators.catalog import bucket
from quakeframe.operators.keys import join_on, number


def ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    """a / b to 6 digits; `empty` where b is 0."""
    return F.round(F.when(b > 0, a / b).otherwise(F.lit(empty)), 6)


def at_tolerances(df: DataFrame, tolerances: list[float]) -> DataFrame:
    """Each row once for each tolerance, where it stays: an explode and no join."""
    return df.withColumn("tolerance", F.explode(F.array(*map(F.lit, tolerances))))


def counted_by_place(df: DataFrame, tolerances: list[float], keys: list[str], residuals: bool) -> DataFrame:
    """Windows counted (_n) by keys, _place (how many of the tolerances the probability exceeds), _t (whether they hold a pick) and, of those that are found at some tolerance, residual _r.

    That is all metrics at all tolerances need, so the input is read and shuffled once, as counts, whatever the number of
    tolerances. A probability of null or NaN exceeds none.
    """
    p = number(F.col("proba"))
    place = sum((F.coalesce(p > t, F.lit(False)).cast("int") for t in tolerances), F.lit(0))
    t = F.coalesce(F.col("true_index") >= 0, F.lit(False))
    d = df.withColumns({"_place": place, "_t": t})
    if residuals:
        d = d.withColumn("_r", F.when(t & (F.col("_place") > 0), F.col("true_index") - F.col("est_index")))
    return d.groupBy(*keys, "_place", "_t", *(["_r"] if residuals else [])).agg(F.count(F.lit(1)).alias("_n"))


def passed(counts: DataFrame, tolerances: list[float]) -> DataFrame:
    """Counts with each tolerance and _p, whether it is exceeded. Counts are few, so this is no longer in proportion to the rows."""
    steps = F.array(*[F.struct(F.lit(t).alias("tolerance"), F.lit(k).alias("_k")) for k, t in enumerate(sorted(tolerances))])
    return counts.withColumn("_step", F.explode(steps)).select("*", "_step.tolerance", (F.col("_place") > F.col("_step._k")).alias("_p")).drop("_step")


def confusion_sums(predicted: Column, true: Column, tail: str = "", where: Column | None = None, n: Column | None = None) -> list[Column]:
    """tp, tn, fp and fn over the rows of `where`, which count for `n` each, names ending in `tail`."""
    inside = F.lit(True) if where is None else where
    n = F.lit(1).cast("long") if n is None else n
    return [F.coalesce(F.sum(F.when(inside & p & t, n)), F.lit(0)).alias(name + tail) for name, p, t in (("tp", predicted, true), ("tn", ~predicted, ~true), ("fp", predicted, ~true), ("fn", ~predicted, true))]


def rates(tail: str = "", head: str = "") -> dict[str, Column]:
    """Accuracy, precision and recall (0 for 0/0) of sums whose names end in `tail`, under names that begin with `head`."""
    tp, tn, fp, fn = (F.col(c + tail) for c in ("tp", "tn", "fp", "fn"))
    return {f"{head}accuracy": ratio(tp + tn, tp + tn + fp + fn), f"{head}precision": ratio(tp, tp + fp), f"{head}recall": ratio(tp, tp + fn)}


#: Classes of events in a row of metrics, and the windows without one.
STRATA = ("ceq", "heq", "cbl", "noise")


def _strata(predicted: Column, true: Column, stratum: str | None, n: Column | None = None) -> list[Column]:
    return [c for s in STRATA for c in confusion_sums(predicted, true, f"_{s}", F.col(stratum) == s, n)] if stratum else []


def _strata_rates(stratum: str | None) -> dict[str, Column]:
    """Rates of each stratum; null for noise if there is none."""
    out: dict[str, Column] = {}
    for s in STRATA if stratum else ():
        n = sum((F.col(f"{c}_{s}") for c in ("tn", "fp", "fn")), F.col(f"tp_{s}"))
        for name, rate in rates(f"_{s}", f"{s}_").items():
            out[name] = F.when(n > 0, rate) if s == "noise" else rate
    return out


def detector_metrics(df: DataFrame, tolerances: list[float], keys: list[str], stratum: str | None = None) -> DataFrame:
    """One row for keys and tolerance: confusion counts, accuracy, precision, recall (0 for 0/0), and mean and std of the residuals of the
    found true picks, plain and inside the fences at 1.5 quartile distances (0 without any). With the name of a column that
    holds the classes of STRATA also accuracy, precision and recall of each of them.
    """
    d = passed(counted_by_place(df, tolerances, [*keys, *([stratum] if stratum else [])], True), tolerances)
    p, t, n = F.col("_p"), F.col("_t"), F.col("_n")
    r = F.when(p & t, F.col("_r"))
    g = d.groupBy(*keys, "tolerance").agg(*confusion_sums(p, t, n=n), *_strata(p, t, stratum, n), *_spread(r, n))
    g = g.withColumns({"n_picks": F.col("tp") + F.col("fn"), "n_picked": F.col("tp"), **rates(), **_strata_rates(stratum)})
    return _with_residuals(g).drop(*[f"{c}_{s}" for c in ("tp", "tn", "fp", "fn") for s in STRATA])


def _spread(value: Column, n: Column) -> list[Column]:
    """A group's values with their counts and their quartiles; for values of a bounded number, such as differences of places in a window."""
    listed = F.collect_list(F.when(value.isNotNull(), F.struct(value.alias("v"), n.alias("n")))).alias("_values")
    return [listed, F.percentile(value, F.array(F.lit(0.25), F.lit(0.75)), F.when(value.isNotNull(), n).otherwise(0)).alias("_q")]


def _moments(values: Column, about: Column) -> Column:
    """n, mean and population variance of values with counts: the squares are those of differences from the mean."""
    from quakeframe.functions.arrays import let

    total = lambda part: F.aggregate(values, F.lit(0.0), lambda a, x: a + x["n"] * part(x["v"] - about))
    n = F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x["n"])
    both = F.struct(n.alias("n"), F.try_divide(total(lambda v: v), n).alias("m"))
    return let(both, lambda b: F.struct(b["n"].alias("n"), (about + b["m"]).alias("mean"), F.try_divide(total(lambda v: (v - b["m"]) * (v - b["m"])), b["n"]).alias("var")))


def _fenced(values: Column, q: Column, k: float) -> Column:
    """The values strictly inside [q1 - k iqr, q3 + k iqr]."""
    iqr = q[1] - q[0]
    return F.filter(values, lambda x: (x["v"] > q[0] - k * iqr) & (x["v"] < q[1] + k * iqr))


def _shown(m: Column, part: str) -> Column:
    return F.when(m["n"] > 0, F.round(F.sqrt(m["var"]) if part == "std" else m["mean"], 6)).otherwise(0.0)


def _with_residuals(g: DataFrame, k: float = 1.5) -> DataFrame:
    """Groups of `_spread` with mean and std of their residuals, plain and inside the fences; 0 without any."""
    about = F.coalesce(F.col("_q")[0], F.lit(0.0))
    g = g.withColumns({"_plain": _moments(F.col("_values"), about), "_inner": _moments(_fenced(F.col("_values"), F.col("_q"), k), about)})
    shown = {f"{head}residual_{part}": _shown(F.col(c), part) for head, c in (("", "_plain"), ("trimmed_", "_inner")) for part in ("mean", "std")}
    return g.withColumns(shown).drop("_values", "_q", "_plain", "_inner")


def by_stratum(df: DataFrame, tolerances: list[float]) -> DataFrame:
    """Hits, accuracy, precision and recall of each stratum and of all, from one count of the rows."""
    d = passed(counted_by_place(df, tolerances, ["epoch", "stratum"], False), tolerances)
    n = F.col("_n")
    sums = [*confusion_sums(F.col("_p"), F.col("_t"), n=n), F.sum(n).alias("n"), F.grouping("stratum").alias("_all")]
    g = d.groupingSets([["epoch", "tolerance", "stratum"], ["epoch", "tolerance"]], "epoch", "tolerance", "stratum").agg(*sums)
    g = g.withColumns({"stratum": F.when(F.col("_all") == 1, "all").otherwise(F.col("stratum")), "hits": F.col("tp") + F.col("tn"), **rates()})
    return g.select("epoch", "tolerance", "stratum", "hits", "n", "accuracy", "precision", "recall")


#: Value ranges in which quantiles are sought: one of them is sorted, whatever the size of the group.
RANGES = 256


def exact_quantiles(counts: DataFrame, keys: list[str], value: str, n: str, probabilities: list[float]) -> DataFrame:
    """keys and `_q`, the interpolated quantiles of values given with their counts.

    The values of a group are dealt to ranges between approximate cut points; the counts of the ranges tell which of
    them hold the ranks that are wanted, and only those are sorted. No task and no buffer holds all values of a group.
    """
    marks = [k / RANGES for k in range(1, RANGES)]
    cuts = counts.groupBy(*[F.col(k).alias(f"_c{k}") for k in keys]).agg(F.percentile_approx(value, marks, 4 * RANGES).alias("_xcuts"), F.sum(n).alias("_xall"))
    d = counts.join(cuts, [counts[k].eqNullSafe(cuts[f"_c{k}"]) for k in keys]).drop(*[f"_c{k}" for k in keys])
    d = d.withColumn("_xrange", F.size(F.filter("_xcuts", lambda x: x < F.col(value)))).drop("_xcuts")
    sums = d.groupBy(*[F.col(k).alias(f"_s{k}") for k in keys], F.col("_xrange").alias("_xr")).agg(F.sum(n).alias("_xm"), F.max("_xall").alias("_xa"))
    sums = sums.withColumn("_xbefore", F.sum("_xm").over(W.partitionBy(*[f"_s{k}" for k in keys]).orderBy("_xr")) - F.col("_xm"))
    places = [p * (F.col("_xa") - 1) for p in probabilities]
    wanted = F.array_distinct(F.array(*[f(x).cast("long") for x in places for f in (F.floor, F.ceil)]))
    sums = sums.withColumn("_xwanted", F.filter(wanted, lambda r: (r >= F.col("_xbefore")) & (r < F.col("_xbefore") + F.col("_xm")))).filter(F.size("_xwanted") > 0)
    some = d.join(sums, [d[k].eqNullSafe(sums[f"_s{k}"]) for k in keys] + [d["_xrange"] == sums["_xr"]])
    some = some.withColumn("_xto", F.col("_xbefore") + F.sum(n).over(W.partitionBy(*keys, "_xrange").orderBy(value)))
    hits = some.withColumn("_xrank", F.explode(F.filter("_xwanted", lambda r: (r >= F.col("_xto") - F.col(n)) & (r < F.col("_xto")))))
    g = hits.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(F.col("_xrank"), F.col(value).cast("double").alias("v")))).alias("_xv"), F.max("_xa").alias("_xa"))
    at = lambda r: F.element_at("_xv", r.cast("long"))
    between = lambda x: at(F.floor(x)) + (x - F.floor(x)) * (at(F.ceil(x)) - at(F.floor(x)))
    return g.select(*keys, F.array(*map(between, places)).alias("_q"))


def fence_stats(df: DataFrame, keys: list[str], value: str, k: float, few: bool = False) -> DataFrame:
    """Mean and population std of the values strictly inside [q1 - k iqr, q3 + k iqr]; 0 and 0 without any.

    Values are counted first, so a group costs as many rows as it has distinct values. With `few`, for values of a bounded
    number such as differences of places in a window, quantiles are taken from a group's counts in one buffer.
    """
    c = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n")).filter(number(F.col(value)).isNotNull())
    if few:
        g = c.groupBy(*keys).agg(*_spread(F.col(value), F.col("_n")))
        g = g.withColumn("_m", _moments(_fenced(F.col("_values"), F.col("_q"), k), F.col("_q")[0]))
        return g.select(*keys, F.col("_m.n").alias("n_inside"), _shown(F.col("_m"), "mean").alias("fence_mean"), _shown(F.col("_m"), "std").alias("fence_std"))
    j = join_on(c, exact_quantiles(c, keys, value, "_n", [0.25, 0.75]), keys)
    q1, iqr = F.col("_q")[0], F.col("_q")[1] - F.col("_q")[0]
    w = F.when((F.col(value) > q1 - k * iqr) & (F.col(value) < F.col("_q")[1] + k * iqr), F.col("_n")).otherwise(0)
    # What is inside lies within some quartile distances of the first quartile, so sums about that lose nothing.
    v = F.col(value) - q1
    g = j.groupBy(*keys).agg(F.sum(w).alias("n_inside"), F.sum(w * v).alias("_s"), F.sum(w * v * v).alias("_ss"), F.first(q1).alias("_q1"))
    some, m = F.col("n_inside") > 0, F.col("_s") / F.col("n_inside")
    mean = F.when(some, F.col("_q1") + m).otherwise(0.0)
    var = F.when(some, F.col("_ss") / F.col("n_inside") - m * m).otherwise(0.0)
    return g.select(*keys, "n_inside", F.round(mean, 6).alias("fence_mean"), F.round(F.sqrt(F.greatest(var, F.lit(0.0))), 6).alias("fence_std"))


def residual_summary(df: DataFrame, keys: list[str], value: str, k: float = 1.5) -> DataFrame:
    """Plain and fenced mean and std of a residual; groups without one have none."""
    g = df.withColumn(value, number(F.col(value))).groupBy(*keys).agg(F.round(F.avg(value), 6).alias("mean"), F.round(F.stddev_pop(value), 6).alias("std"))
    j = join_on(g, fence_stats(df, keys, value, k), keys, "left")
    return j.withColumns({"n_inside": F.coalesce("n_inside", F.lit(0)), "fence_mean": F.coalesce("fence_mean", F.lit(0.0)), "fence_std": F.coalesce("fence_std", F.lit(0.0))})


def first_motion_metrics(df: DataFrame, keys: list[str]) -> DataFrame:
    """Accuracy over all rows, and up- and down-oriented accuracy, precision and recall over the rows where truth and prediction are up or down."""
    t, p = F.col("true_fm"), F.col("pred_fm")
    both = (t != 0) & (p != 0)
    count = lambda c: F.sum(c.cast("long"))
    g = df.groupBy(*keys).agg(count(t == p).alias("_same"), F.count(F.lit(1)).alias("n"), *[count(both & (t == a) & (p == b)).alias(f"_{x}{y}") for x, a in (("u", 1), ("d", -1)) for y, b in (("u", 1), ("d", -1))])
    uu, ud, du, dd = (F.col(c) for c in ("_uu", "_ud", "_du", "_dd"))
    cols = {"accuracy": ratio(F.col("_same"), F.col("n")), "polar_accuracy": ratio(uu + dd, uu + ud + du + dd), "up_precision": ratio(uu, uu + du), "up_recall": ratio(uu, uu + ud), "down_precision": ratio(dd, dd + ud), "down_recall": ratio(dd, dd + du)}
    return g.withColumns(cols).drop("_same", "_uu", "_ud", "_du", "_dd")


def confusion(df: DataFrame, truth: str, predicted: str, classes: list) -> DataFrame:
    """One row for each true class, one column for each predicted one."""
    g = df.groupBy(truth).pivot(predicted, classes).agg(F.count(F.lit(1)))
    names = {c: str(c).replace("-", "minus_") for c in classes}
    return g.select(truth, *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(f"pred_{names[c]}") for c in classes])


def convergence(metrics: DataFrame, columns: list[str], tolerance: float | None = None) -> DataFrame:
    """Mean and std over tolerances of an epoch's metrics, or those at one tolerance."""
    if tolerance is not None:
        metrics = metrics.filter(F.abs(F.col("tolerance") - tolerance) < 1e-4)
    return metrics.groupBy("epoch").agg(*[F.round(F.avg(c), 6).alias(f"{c}_mean") for c in columns], *[F.round(F.stddev_pop(c), 6).alias(f"{c}_std") for c in columns])


def histogram2d(df: DataFrame, x: str, y: str, x_edges: list[float], y_edges: list[float]) -> DataFrame:
    """Rows in each cell of two binnings."""
    d = df.select(bucket(F.col(x), x_edges).alias("xbin"), bucket(F.col(y), y_edges).alias("ybin"))
    return d.filter(F.col("xbin").isNotNull() & F.col("ybin").isNotNull()).groupBy("xbin", "ybin").agg(F.count(F.lit(1)).alias("n"))


def mew_metrics(est: DataFrame, windows: DataFrame, tolerances: list[float], near: int, stratum: str | None = None) -> DataFrame:
    """Metrics of windows with up to two picks: a row for epoch, tolerance and `picks`, which is `first`, `second` or `combined`.

    `windows` has epoch, waveform_id, act1 (negative in noise windows) and act2 (null without a second pick); `est` has
    epoch, waveform_id, est and proba. At a tolerance an actual pick is found by the closest estimated one of more
    probability that is nearer than `near`, the earlier of equals. A noise window counts as predicted if it has any pick;
    a window is right in `combined` if all its picks are found. fp counts the picks that match nothing (in `second` those
    of two-pick windows), and accuracy and precision take it in place of fp_notused, the predicted noise windows. Means are
    0 without residuals, rates 0 for 0/0. With the name of a column of STRATA, `first` has the rates of each, and its
    n_picked counts the actual picks of all windows where anything is picked, found or not.
    """
    from quakeframe.operators.joins import counted, repeated

    own = ["epoch", "waveform_id", "act1", "act2", *([stratum] if stratum else [])]
    e = est.select(F.col("epoch").alias("_e"), F.col("waveform_id").alias("_w"), F.struct(F.col("est").cast("long").alias("est"), F.col("proba").alias("proba")).alias("_pick"))
    w = counted(windows.select(*own))
    j = w.join(e, (w["epoch"] == e["_e"]) & (w["waveform_id"] == e["_w"]), "left")
    j = repeated(j.groupBy(*own, "_copies").agg(F.collect_list("_pick").alias("_picks")))  # the picks of one window
    d = at_tolerances(j, tolerances).withColumn("_picks", F.filter("_picks", lambda p: number(p["proba"]) > F.col("tolerance")))

    def found(a: str) -> Column:
        near_ones = F.filter("_picks", lambda p: F.abs(F.col(a) - p["est"]) < near)
        best = F.array_min(F.transform(near_ones, lambda p: F.struct(F.abs(F.col(a) - p["est"]).alias("d"), p["est"].alias("est"))))
        return F.when(F.col(a) >= 0, F.col(a) - best["est"])

    d = d.withColumns({"_r1": found("act1"), "_r2": found("act2"), "_n": F.size("_picks").cast("long"), "_signal": F.col("act1") >= 0, "_two": F.coalesce(F.col("act2") >= 0, F.lit(False))})
    m1, m2, signal, two, n = F.col("_r1").isNotNull(), F.col("_r2").isNotNull(), F.col("_signal"), F.col("_two"), F.col("_n")
    spare = n - m1.cast("long") - m2.cast("long")
    first = F.when(signal, m1).otherwise(n > 0)
    given = signal.cast("long") + two.cast("long")
    kinds = [("first", signal, first, F.array("_r1"), signal.cast("long")), ("second", F.lit(True), m2, F.array("_r2"), F.lit(1).cast("long")), ("combined", signal, first & (m2 | ~two), F.array("_r1", "_r2"), given)]
    rows = F.array(*[F.struct(F.lit(k).alias("picks"), o.alias("_t"), h.alias("_p"), F.filter(r, lambda x: x.isNotNull()).alias("_rs"), g.alias("_given")) for k, o, h, r, g in kinds])
    rows = F.when(two, rows).otherwise(F.filter(rows, lambda x: x["picks"] != "second"))
    d = d.withColumns({"_spare": spare, "_any": F.when(signal & (n > 0), given).otherwise(0)}).withColumn("_k", F.explode(rows)).select("*", "_k.*")
    p, t = F.col("_p"), F.col("_t")
    # Windows that agree in all that is counted are counted first; their residuals, at most two, stay with them.
    keys = ["epoch", "tolerance", "picks"]
    d = d.groupBy(*keys, "_p", "_t", "_rs", *([stratum] if stratum else [])).agg(F.count(F.lit(1)).alias("_w"), F.sum("_spare").alias("_spare"), F.sum("_given").alias("_given"), F.sum("_any").alias("_any"))
    w = F.col("_w")
    pairs = F.transform("_rs", lambda x: F.struct(x.alias("v"), w.alias("n")))
    sums = [*confusion_sums(p, t, n=w), F.sum("_spare").alias("_fp"), F.sum("_given").alias("n_picks"), F.sum(w * F.size("_rs")).alias("_found"), F.sum("_any").alias("_any"), F.flatten(F.collect_list(pairs)).alias("_values")]
    g = d.groupBy(*keys).agg(*sums, *_strata(p, t, stratum, w))
    g = g.withColumnRenamed("fp", "fp_notused").withColumnRenamed("_fp", "fp")
    picked = F.when(F.col("picks") == "first", F.col("_any")).otherwise(F.col("_found")) if stratum else F.col("_found")
    of_first = {name: F.when(F.col("picks") == "first", rate) for name, rate in _strata_rates(stratum).items()}
    g = g.withColumns({"n_picked": picked, **rates(), **of_first, "_q": _quartiles(F.col("_values"))})
    return _with_residuals(g).drop("_found", "_any", *[f"{c}_{s}" for c in ("tp", "tn", "fp", "fn") for s in STRATA])


def _quartiles(values: Column) -> Column:
    """Interpolated quartiles of values with counts."""
    from quakeframe.functions.arrays import let

    def at(s: Column, n: Column, q: float) -> Column:
        place = (n - 1) * q
        # The value at a rank is the first whose running count exceeds it.
        ranked = lambda rank: F.aggregate(s, F.struct(F.lit(0).cast("long").alias("c"), F.lit(None).cast("double").alias("v")), lambda a, x: F.struct((a["c"] + x["n"]).alias("c"), F.when(a["v"].isNull() & (a["c"] + x["n"] > rank), x["v"].cast("double")).otherwise(a["v"]).alias("v")))["v"]
        low = ranked(F.floor(place))
        return low + (place - F.floor(place)) * (ranked(F.ceil(place)) - low)

    def both(s: Column) -> Column:
        n = F.aggregate(s, F.lit(0).cast("long"), lambda a, x: a + x["n"])
        return F.array(at(s, n, 0.25), at(s, n, 0.75))

    return let(F.array_sort(values), both)


def pick_jaccard(est: DataFrame, act: DataFrame, keys: list[str], near: int) -> DataFrame:
    """matched / (estimated + actual - matched) of each waveform, where matched counts the actual picks that have an estimated one nearer than `near`; 1 if it has neither."""
    from quakeframe.operators.joins import match_picks

    none = F.lit(0).cast("long")
    m = match_picks(est, act, keys, near).select(*keys, F.lit(1).cast("long").alias("n_act"), F.col("est").isNotNull().cast("long").alias("matched"), none.alias("n_est"))
    n = est.select(*keys, none.alias("n_act"), none.alias("matched"), F.lit(1).cast("long").alias("n_est"))
    j = m.unionByName(n).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n_est", "n_act", "matched")])
    either = F.col("n_est") + F.col("n_act") - F.col("matched")
    return j.select(*keys, "n_est", "n_act", "matched", ratio(F.col("matched"), either, 1.0).alias("jaccard"))


def pick_jaccard_at(est: DataFrame, act: DataFrame, tolerances: list[float], keys: list[str], near: int) -> DataFrame:
    """`pick_jaccard` at each tolerance, over the estimated picks (with `proba`) above it."""
    some = at_tolerances(est, tolerances).filter(number(F.col("proba")) > F.col("tolerance")).drop("proba")
    return pick_jaccard(some, at_tolerances(act, tolerances), [*keys, "tolerance"], near)


def jaccard_summary(df: DataFrame, keys: list[str], value: str = "jaccard", name: str = "js") -> DataFrame:
    """Mean, min, max and a histogram of 10 equal bins from the least to the largest value (half a unit around a single one)."""
    g = df.groupBy(*keys).agg(F.round(F.avg(value), 6).alias(f"{name}_mean"), F.min(value).alias(f"{name}_min"), F.max(value).alias(f"{name}_max"))
    low, high = F.col(f"{name}_min"), F.col(f"{name}_max")
    one = low == high
    a, b = F.when(one, low - 0.5).otherwise(low), F.when(one, high + 0.5).otherwise(high)
    g = g.withColumn("_edges", F.array(*[a + (b - a) / 10 * k for k in range(1, 10)]))
    j = join_on(df.select(*keys, F.col(value).alias("_v")), g, keys).withColumn("_bin", F.size(F.filter("_edges", lambda e: e <= F.col("_v"))))
    stats = [f"{name}_mean", f"{name}_min", f"{name}_max"]
    dist = F.array(*[F.count(F.when(F.col("_bin") == k, 1)) for k in range(10)]).alias(f"{name}_dist")
    return j.groupBy(*keys, *stats).agg(dist)


def precision_recall_curve(metrics: DataFrame, epoch: int) -> DataFrame:
    """Precision and recall of an epoch in the order of tolerance."""
    return metrics.filter(F.col("epoch") == epoch).orderBy("tolerance").select("tolerance", "precision", "recall")
