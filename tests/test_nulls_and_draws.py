"""Null keys, NaN, variances at large offsets, draws, splits and halos against plain Python."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quakeframe.functions import arrays as A
from quakeframe.operators import catalog as C
from quakeframe.operators import continuity as K
from quakeframe.operators import metrics as M
from quakeframe.operators import picking as P
from quakeframe.operators import splits as S

NAN = float("nan")


def test_nan_compares_false(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0, 2.0), (2, NAN, 5.0, 2.0), (3, None, 5.0, 2.0), (4, 1.0, NAN, 2.0), (5, 1.0, 5.0, NAN)], "k int, pick_quality double, source_receiver_distance double, magnitude double")
    assert [r.k for r in C.filter_quality(df, 0.75).collect()] == [1, 4, 5]
    assert [r.k for r in C.filter_candidates(df, [1.0], 100, 1.0).collect()] == [1]
    assert C.filter_quality(df, 0).count() == 5


def test_metrics_of_nan_and_null_keys(spark):
    rows = [(None, 0.9, 10, 12), (None, NAN, 10, 12), (None, None, 10, 12), ("a", 0.3, -1, 5), ("a", 0.95, 3, 3), (None, 0.2, None, 4)]
    df = spark.createDataFrame(rows, "epoch string, proba double, true_index long, est_index long")
    got = {(r.epoch, r.tolerance): (r.tp, r.tn, r.fp, r.fn, r.residual_mean, r.residual_std) for r in M.detector_metrics(df, [0.5, 0.1], ["epoch"]).collect()}
    assert got == {(None, 0.5): (1, 1, 0, 2, -2.0, 0.0), (None, 0.1): (1, 0, 1, 2, -2.0, 0.0), ("a", 0.5): (1, 1, 0, 0, 0.0, 0.0), ("a", 0.1): (1, 0, 1, 0, 0.0, 0.0)}


def test_one_pass_is_what_each_tolerance_gives(spark):
    """21 tolerances, strata, ties at a tolerance: counts, and residuals plain and trimmed, against numpy."""
    rng = random.Random(1)
    tols = [k / 20 for k in range(21)]
    rows = [(rng.choice([1, None]), rng.choice([k / 20 for k in range(21)]), rng.choice([-1, 50]), 50 + rng.choice([0, 1, 2, 3, 40]), rng.choice([*M.STRATA])) for _ in range(800)]
    df = spark.createDataFrame(rows, "epoch int, proba double, true_index long, est_index long, stratum string")
    for r in M.detector_metrics(df, tols, ["epoch"], "stratum").collect():
        own = [x for x in rows if x[0] == r.epoch]
        res = np.array([t - e for _, p, t, e, _ in own if p > r.tolerance and t >= 0], float)
        assert (r.tp, r.fp) == (len(res), sum(p > r.tolerance and t < 0 for _, p, t, _, _ in own)) and r.tp + r.fn == sum(x[2] >= 0 for x in own) and r.fp + r.tn == sum(x[2] < 0 for x in own)
        if len(res):
            q1, q3 = np.quantile(res, [0.25, 0.75])
            inner = res[(res > q1 - 1.5 * (q3 - q1)) & (res < q3 + 1.5 * (q3 - q1))]
            assert r.residual_mean == pytest.approx(res.mean(), abs=1e-6) and r.residual_std == pytest.approx(res.std(), abs=1e-6)
            assert r.trimmed_residual_std == pytest.approx(inner.std() if len(inner) else 0, abs=1e-6)
        some = [x for x in own if x[4] == "ceq"]
        hits = sum((p > r.tolerance) == (t >= 0) for _, p, t, _, _ in some)
        assert r.ceq_accuracy == pytest.approx(hits / len(some), abs=1e-6)


def test_the_input_is_read_once(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select(F.col("l_linenumber").alias("epoch"), (F.col("l_discount") * 10).alias("proba"), F.col("l_partkey").alias("true_index"), F.col("l_suppkey").alias("est_index"))
    plan = M.detector_metrics(df, [k / 20 for k in range(21)], ["epoch"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange") <= 2


@pytest.mark.parametrize("few", [True, False])
def test_fences_at_large_offsets_and_null_keys(spark, few):
    rng = np.random.default_rng(2)
    values = {k: 1.4e9 + rng.normal(size=40) * 0.03 for k in (None, "a")}
    df = spark.createDataFrame([(k, float(v)) for k, x in values.items() for v in [*x, 2e9]] + [("b", None)], "k string, v double")
    got = {r.k: r for r in M.fence_stats(df, ["k"], "v", 1.5, few).collect()}
    for k, x in values.items():
        q1, q3 = np.quantile([*x, 2e9], [0.25, 0.75])
        inner = x[(x > q1 - 1.5 * (q3 - q1)) & (x < q3 + 1.5 * (q3 - q1))]
        assert got[k].n_inside == len(inner) and got[k].fence_std == pytest.approx(inner.std(), abs=1e-6) and got[k].fence_std > 0.01
    s = {r.k: r for r in M.residual_summary(df, ["k"], "v").collect()}
    assert set(s) == {None, "a", "b"} and s["b"].mean is None and s["b"].n_inside == 0


def test_variance_about_the_mean(spark):
    rows = [([1e8, 1e8 + 1, 1e8 + 2],), ([1e9, 1e9 + 1, 1e9 + 2],), ([3.0],), ([],), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "x array<double>").select(A.variance(F.col("x"))).collect()]
    assert got[:3] == [pytest.approx(2 / 3, rel=1e-9), pytest.approx(2 / 3, rel=1e-9), 0.0] and got[3:] == [None, None]
    x = (1e9 + np.random.default_rng(3).normal(size=64)).tolist()
    n = spark.createDataFrame([(1, x), (1, x)], "k int, x array<double>")
    assert P.component_noise(n, ["k"], ["x"]).first().x_noise == pytest.approx(np.var(x), rel=1e-9)


def test_rows_of_null_keys_stay(spark):
    df = spark.createDataFrame([(k, "a" if k % 2 else None, float(k)) for k in range(24)], "pick_id long, station string, day double")
    assert S.sample_k(df, 4, [S.shuffled("s", F.col("pick_id"))], ["station"]).groupBy("station").count().select(F.min("count"), F.max("count")).first() == (4, 4)
    ids = K.pick_ids(df.withColumn("day", F.when(F.col("day") > 12, F.col("day") % 3)), ["station", "day"], ["pick_id"]).collect()
    assert sorted(r.new_id for r in ids) == list(range(1, 25))
    rate = K.pick_rate(df.select("station", "day", F.lit("P").alias("phase"))).collect()
    assert sum(r.n for r in rate if r.station is None and r.day is None and r.phase is None) == 12 and len(rate) == 2 + 48
    bins = df.select("pick_id", F.when(F.col("pick_id") < 12, F.col("station")).alias("bin"))
    assert C.match_distribution(bins, bins, "bin", 100, "pick_id", "m").count() == 100
    est = spark.createDataFrame([(None, 5), (None, 50), (1, 5)], "w long, est long")
    act = spark.createDataFrame([(None, 6), (2, 5)], "w long, act long")
    assert sorted((r.w or 0, r.n_est, r.n_act, r.matched) for r in M.pick_jaccard(est, act, ["w"], 5).collect()) == [(0, 2, 1, 1), (1, 1, 0, 0), (2, 0, 1, 0)]


def test_splits_lose_no_row(spark):
    rows = [(k % 50 if k % 3 else None, k % 7, "x") for k in range(1000)]
    df = spark.createDataFrame(rows, "evid long, a long, b string")
    got = S.split_examples(df, "evid", 0.8, 0.1, 0.1, "s", 0.6).collect()
    assert Counter((r.evid, r.a, r.b) for r in got) == Counter(rows)
    noise = Counter(r.split for r in got if r.evid is None)
    n = sum(noise.values())
    assert noise == {"train": int(0.6 * n), "validation": int(0.5 * (n - int(0.6 * n))), "test": n - int(0.6 * n) - int(0.5 * (n - int(0.6 * n)))}
    assert all(len({r.split for r in got if r.evid == e}) == 1 for e in range(50))
    again = S.split_examples(df.repartition(7), "evid", 0.8, 0.1, 0.1, "s", 0.6).collect()
    assert Counter(again) == Counter(got)
    assert S.noise_share(100, 3, 1000) == 0.3 and S.noise_share(100, 30, 1000) == 1.0
    assert S.split_examples(df.filter("evid is null"), "evid", 0.8, 0.1, 0.1, "s").count() == n


def test_components(spark):
    ok = [(1, c, f"HH{c}", 0.0, 9.0, 10, 1.0, 100.0) for c in "ENZ"]
    rows = ok + [(2, c, f"HH{c}", s, 9.0 + s, 10, 1.0, 100.0) for c, s in zip("ENZ", (0.0, 0.9, 1.8), strict=True)] + [(3, c, f"HH{c}", s, 9.0, 10, 1.0, 100.0) for c, s in zip("ENZ", (0.0, 1.0, 0.0), strict=True)]
    rows += [(4, c, f"HH{d}", 0.0, 9.0, 10, 1.0, 100.0) for c, d in zip("XYQ", "ENZ", strict=True)] + [(5, c, f"HN{c}", 0.0, 9.0, 10, 1.0, 100.0) for c in "ENZ"] + [(6, c, f"HH{c}", 0.0, 9.0, None, 1.0, 100.0) for c in "ENZ"]
    rows += [(7, c, f"BH{d}", 0.0, 9.0, 10, 1.0, 100.0) for c, d in zip("ENZ", "12Z", strict=True)] + [(8, c, f"HH{c}", 0.0, 9.0, 10, 1.0, r) for c, r in zip("ENZ", (100.0, 100.0, 40.0), strict=True)] + ok[:2]
    df = spark.createDataFrame([r for r in rows if r[0] != 1] + ok + [(9, *ok[0][1:])] * 3, "k int, component string, channel string, starttime double, endtime double, npts int, dt double, sampling_rate double")
    assert sorted(r.k for r in C.component_consistency(df, ["k"]).collect()) == [1, 2, 7]


def test_draws_keep_their_bounds_and_are_even(spark):
    length, low, high, second, req, first_margin, box = 1008, 254, 754, 60, 150, 20, 10
    df = spark.range(40_000).select(F.col("id").alias("evid"), F.lit(20.0).alias("km"))
    got = P.pair_shifts(df, "evid", "km", "s", length, (low, high), second, req, first_margin, box).toPandas()
    assert got["feasible"].all() and (got["min_sep"] == max(req, min(int(20 / 6 * 100) + 50, length - second - low - 50))).all()
    f, s, h = got["first"].to_numpy(int), got["second"].to_numpy(int), got["shift"].to_numpy(int)
    sep = got["min_sep"].to_numpy(int)
    assert (low <= f).all() and (f < np.minimum(length - second - sep, high - first_margin)).all()
    assert (s >= f + sep).all() and (s >= high + box).all() and (s < length - second).all() and (s > high).all()
    assert (f - h < low).all() and (s - h >= low).all() and (s - h <= high).all() and (f - h > box).all()
    top = min(length - second - sep[0], high - first_margin)
    n = np.bincount(f - low, minlength=top - low)
    assert ((n - len(f) / (top - low)) ** 2 / (len(f) / (top - low))).sum() < (top - low) + 6 * np.sqrt(2 * (top - low))
    under = np.maximum(high + box, f + sep)
    wide = length - second - under == 948 - 764  # the draws of one range
    assert wide.sum() > 10_000 and abs(np.corrcoef(f[wide], s[wide])[0, 1]) < 0.03 and abs(np.corrcoef(s[wide], h[wide] - np.maximum(f - (low - box - 1), s - (high - 1))[wide])[0, 1]) < 0.6
    odd = spark.createDataFrame([(1, 5.0), (2, None), (3, NAN)], "evid long, km double")
    empty = P.pair_shifts(odd, "evid", "km", "s", 300, (254, 290), 60, 150, 20, 10).collect()
    assert not any(r.feasible for r in empty) and {r.shift for r in empty} == {None} and len(empty) == 3


def test_halos_give_the_plain_result(spark):
    rng = random.Random(8)
    rows = [(k, rng.choice(["a", "a", "a", None]), rng.choice([rng.uniform(0, 5000), 1000.0 * rng.randint(0, 5)])) for k in range(500)]
    df = spark.createDataFrame(rows, "pick_id long, station string, arrival_time double")
    got = {r.pick_id: r.is_close for r in K.remove_close_picks(df, 3.0, ["station"], span=60.0).collect()}
    want = {k: any(j != k and s == z and abs(t - u) < 3.0 for j, z, u in rows) for k, s, t in rows}
    assert got == want and len(got) == 500


def test_windows(spark):
    assert A.pad_length(10.0, 0.01) == 1008 and A.pad_length(0.15, 0.01) == 16 and A.largest_lag(0.5, 1008) == 252 and A.largest_lag(250, 1008) == 250
    x = np.arange(100, dtype=float).tolist()
    df = spark.createDataFrame([(1, x, [int(40 <= i <= 60) for i in range(100)])], "k int, x array<double>, y array<int>")
    for r in P.augmented(df, "x", "k", 50, 0.3, 0.01, 1.0, 20, "s", "y", 0.5).collect():
        start = 50 - 16 + r.lag
        assert -16 <= r.lag <= 16 and r.pick_index == 16 - r.lag and np.allclose(r.x, np.array(x[start : start + 32]) / (start + 31)) and r.y == [int(40 <= i <= 60) for i in range(start + 8, start + 24)]
    whole = P.augmented(spark.createDataFrame([(1, x[:32])], "k int, x array<double>"), "x", "k", 16, 0.3, 0.01, 1.0, 3, "s").collect()
    assert all(np.allclose(r.x, np.array(x[:32]) / 31) for r in whole)
    one, two = (P.random_start_times(df, "x", "k", 40, 0.2, 0.01, "s", fm).first() for fm in (False, True))
    assert one.lag == two.lag and one.x == (np.arange(30 - one.lag, 70 - one.lag) / (69 - one.lag)).tolist() and two.x == (np.arange(30 + two.lag, 70 + two.lag) / (69 + two.lag)).tolist()


def test_stacked_components(spark):
    row = lambda k, c, n: (k, c, f"HH{c}", [float(n)] * n)
    rows = [row(1, "E", 5), row(1, "N", 4), row(1, "Z", 5), row(2, "E", 5), row(2, "N", 3), row(2, "Z", 5), row(3, "E", 5), row(None, "E", 2), row(None, "N", 2), row(None, "Z", 2), (4, "E", "HHE", None)]
    got = P.stack_components(spark.createDataFrame(rows, "k int, component string, channel string, x array<double>"), ["k"]).collect()
    assert sorted((r.k or 0, r.channel, r.npts, len(r.x_e), len(r.x_n), len(r.x_z)) for r in got) == [(0, "HH?", 2, 2, 2, 2), (1, "HH?", 5, 5, 5, 5)]


def test_epochs_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(P, "MAX_EPOCHS", 2)
    df = spark.createDataFrame([(1, [0.1, 0.9], 1)], "row_id int, x array<double>, true_index int")
    assert P.evaluate_over_models(df, spark.range(2).withColumnRenamed("id", "epoch"), lambda x, e: x).count() == 2
    with pytest.raises(ValueError):
        P.evaluate_over_models(df, spark.range(3).withColumnRenamed("id", "epoch"), lambda x, e: x)
