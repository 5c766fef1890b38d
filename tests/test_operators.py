"""Operators on small exact cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quakeframe.functions import arrays as A
from quakeframe.operators import joins as J
from quakeframe.operators import metrics as M
from quakeframe.operators import picking as P
from quakeframe.operators import splits as S
from quakeframe.sources import io


def test_fence_lowers_the_spread(spark):
    x = np.concatenate([np.linspace(-1, 1, 20), [20, -20, 20, -20, 20]]).tolist()
    df = spark.createDataFrame([(1, x), (2, []), (3, [4.0]), (4, None)], "k int, x array<double>")
    got = {r.k: r for r in P.ensemble_summary(df, "x").collect()}
    inner = np.array(x[:20])
    assert got[1].n_kept == 20 and got[1].shift == pytest.approx(np.median(inner)) and got[1].std == pytest.approx(inner.std()) and got[1].std < np.std(x)
    assert (got[2].shift, got[2].std, got[2].n_kept) == (0, 0, 0) and got[4].shift is None
    assert (got[3].shift, got[3].n_kept) == (0, 0)  # the fences of one value are the value itself, and it isn't strictly inside


def mixed(x1, x2, first, second, shift, n, half, lead=10, taper=9):
    """By the steps themselves: cut both, slope the second in, pad it, add, mask, take two windows."""
    mid = len(x1) // 2
    a = x1[mid - first :]
    b = x2[mid - lead : mid + len(a) - second].copy()
    b[:taper] *= 0.5 * (1 - np.cos(np.pi * np.arange(taper) / taper))
    padded = np.zeros_like(a)
    padded[second - lead :] = b
    total, mask = a + padded, np.zeros(len(a))
    for at in (first, second):
        mask[at - half : at + half + 1] = 1
    out = []
    for o, i, j in ((0, first, second), (shift, second - shift, first - shift)):
        w = total[o : o + n]
        out.append((i, j, w / np.abs(w).max(), mask[o : o + n]))
    return out


def test_both_windows_of_a_mixed_pair(spark):
    rng = np.random.default_rng(1)
    x1, x2 = rng.normal(size=400), rng.normal(size=400)
    df = spark.createDataFrame([("a", x1.tolist(), x2.tolist(), 60, 110, 50)], "id string, x1 array<double>, x2 array<double>, first int, second int, shift int")
    got = sorted(P.mix_pairs(df, 150, 5).collect(), key=lambda r: r.window)
    for r, (i, j, x, y) in zip(got, mixed(x1, x2, 60, 110, 50, 150, 5), strict=True):
        assert (r.id, r.pick_index, r.pick_index2) == ("a", i, j) and np.allclose(r.x, x) and r.y == y.tolist()


def test_windows_around_picks_are_processed_with_their_margins(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=1000)
    at = [0, 3, 40, 500, 995, 999]
    picks = spark.createDataFrame([("s", i, k) for k, i in enumerate(at)], "station string, index int, id int")
    traces = spark.createDataFrame([("s", x.tolist())], "station string, x array<double>")
    got = {r.id: r.x for r in P.cut_pick_windows(picks, traces, ["station"], 40, 25, lambda df: P.processed(df, "x")).collect()}
    from quakeframe.functions import kernels as K

    sections = K.bandpass_sections(1, 17, 100, 2)
    for k, i in enumerate(at):
        a, b = max(0, i - 45), min(1000, i + 45)
        y = K.sections_applied(sections, K.tapered(K.detrended(x[None, a:b])))[0]
        want = [y[j - a] if 0 <= j < 1000 else 0.0 for j in range(i - 20, i + 20)]
        assert len(got[k]) == 40 and np.allclose(got[k], want)


def test_calibrated_bounds(spark):
    """A curve that is too narrow at nominal quantiles widens the bounds, and they stay in proportion to the std."""
    curve = spark.createDataFrame([(q / 100, 0.5 + (q / 100 - 0.5) * 0.9) for q in range(2, 100, 2)], "nominal double, observed double")
    knots = P.inverse_isotonic(curve, "observed", "nominal")
    df = spark.createDataFrame([(0.0, 1.0), (0.0, 0.1), (2.0, 1.0)], "y double, std double")
    a, b, c = P.calibrated_bounds(df, "y", "std", knots, 0.05 + 0.02, 0.95 - 0.02).collect()
    assert a.lower < -2 + 0.05 and a.upper > 2 - 0.05 and b.lower == pytest.approx(a.lower / 10) and c.upper == pytest.approx(2 + a.upper)
    assert P.calibrated_quantile(0.5, knots) == pytest.approx(0.5) and P.calibrated_quantile(0.001, knots) == knots[0][1]
    bent = spark.createDataFrame([(0.1, 0.2), (0.3, 0.1), (0.5, 0.6)], "nominal double, observed double")  # out of order: pooled
    assert [round(v, 6) for _, v in P.inverse_isotonic(bent, "observed", "nominal")] == [0.2, 0.2, 0.5]


def test_snr_of_the_transverse_component(spark):
    rng = np.random.default_rng(3)
    n, e = rng.normal(size=100), rng.normal(size=100)
    rows = [(n.tolist(), e.tolist(), az, k) for az in (0.0, 33.0, None) for k in (-1, 7, 50, 97)]
    df = spark.createDataFrame(rows, "n array<double>, e array<double>, az double, k int")
    got = [r[0] for r in df.select(A.snr_transverse(F.col("n"), F.col("e"), F.col("az"), F.col("k"), 6)).collect()]
    for (_, _, az, k), v in zip(rows, got, strict=True):
        al = np.radians(az or 0)
        t = -n * np.sin(al) + e * np.cos(al)
        mask = np.arange(max(0, k - 6), min(100, k + 7)) if k >= 0 else []
        if k < 0:
            assert v == -999
            continue
        s, b = t[mask], t[max(0, mask[0] - len(mask)) : mask[0]]
        assert v == (pytest.approx(10 * np.log10(s.var() / b.var())) if len(b) > 1 else None)


def test_quantiles_of_a_large_group(spark):
    rng = np.random.default_rng(4)
    v = np.round(rng.normal(size=20000), 3)
    df = spark.createDataFrame([("a", float(x)) for x in v] + [("b", 1.0), ("b", 2.0), ("c", 7.0)], "k string, v double")
    c = df.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"))
    got = {r.k: r._q for r in M.exact_quantiles(c, ["k"], "v", "n", [0.0, 0.25, 0.5, 0.75, 1.0]).collect()}
    assert np.allclose(got["a"], np.percentile(v, [0, 25, 50, 75, 100])) and got["b"] == [1, 1.25, 1.5, 1.75, 2] and got["c"] == [7] * 5


def test_repeated_rows_come_out_as_often(spark):
    catalog = spark.createDataFrame([(1, "s", "z", "n", "e")] * 3 + [(2, "s", "z", "n", "x")], "id int, station string, cz string, cn string, ce string")
    archive = spark.createDataFrame([("s", c, [float(k)]) for k, c in enumerate("znez")], "station string, channel string, x array<double>")
    got = J.attach_waveforms_3c(catalog, archive, ["station"], {"z": "cz", "n": "cn", "e": "ce"}).collect()
    assert [(r.id, r.x_z, r.x_n, r.x_e) for r in got] == [(1, [0.0], [1.0], [2.0])] * 3
    act = spark.createDataFrame([(1, 10), (1, 10), (1, 30)], "w int, act int")
    est = spark.createDataFrame([(1, 12), (1, 9)], "w int, est int")
    assert sorted((r.act, r.est) for r in J.match_picks(est, act, ["w"], 5).collect() if r.est) == [(10, 9)] * 2


def test_metrics_of_two_pick_windows(spark):
    windows = spark.createDataFrame([(1, "a", 20, 60, "ceq"), (1, "b", 20, 60, "cbl"), (1, "c", 20, None, "heq"), (1, "d", -1, None, "noise"), (1, "e", -1, None, "noise")], "epoch int, waveform_id string, act1 int, act2 int, stratum string")
    est = spark.createDataFrame([(1, "a", 22, 0.9), (1, "a", 59, 0.8), (1, "a", 90, 0.9), (1, "b", 21, 0.9), (1, "c", 40, 0.9), (1, "d", 5, 0.9), (1, "e", 5, 0.1)], "epoch int, waveform_id string, est int, proba double")
    got = {r.picks: r for r in M.mew_metrics(est, windows, [0.5], 10, "stratum").collect()}
    f, s, c = got["first"], got["second"], got["combined"]
    assert (f.tp, f.tn, f.fn, f.fp_notused, f.fp, f.n_picks, f.n_picked) == (2, 1, 1, 1, 3, 3, 5)
    assert (f.residual_mean, f.residual_std) == (-1.5, 0.5) and f.accuracy == pytest.approx(3 / 7, abs=1e-6) and f.precision == 0.4 and f.recall == pytest.approx(2 / 3, abs=1e-6)
    assert (f.ceq_recall, f.cbl_recall, f.heq_recall, f.noise_accuracy) == (1, 1, 0, 0.5)
    assert (s.tp, s.tn, s.fn, s.fp, s.n_picks, s.n_picked, s.residual_mean, s.ceq_recall) == (1, 0, 1, 1, 2, 1, 1, None)
    assert (c.tp, c.fn, c.tn, c.fp, c.n_picks, c.n_picked) == (1, 2, 1, 3, 5, 3)


def test_noise_is_topped_up_to_the_signal(spark):
    noise = spark.createDataFrame([(k,) for k in range(31)], "k long")
    thin = {r.k for r in S.thinned_to_signal(noise, 5, 3, "k", "t").collect()}
    more = [r.k for r in S.thinned_to_signal(noise, 50, 3, "k", "t").collect()]
    assert len(thin) == 11 and len(more) == 50 and thin <= set(more) and all(more.count(k) == 1 for k in thin)
    assert sorted(more) == sorted(r.k for r in S.thinned_to_signal(noise.repartition(3), 50, 3, "k", "t").collect())
    assert S.thinned_to_signal(noise.limit(0), 5, 3, "k", "t").count() == 0


def test_inventory_of_a_folder(spark, tmp_path):
    names = [f"UU.AAA.01.HH{c}__20140330T000000Z__20140331T000000Z" for c in "ZNE"] + ["UU.BBB..EHZ__20140330T000000Z__20140331T000000Z", "UU.CCC.01.HHZ__20140330T000000Z__20140331T000000Z", "UU.CCC.01.HHN__20140330T000000Z__20140331T000000Z"]
    (tmp_path / "day").mkdir()
    for n in names:
        (tmp_path / "day" / f"{n}.mseed").write_bytes(b"never read")
    (tmp_path / "day" / "notes.txt").write_bytes(b"")
    got = io.file_inventory(io.file_names(spark, f"file://{tmp_path}/*")).collect()
    assert {(r.station, r.location, r.chan2, str(r.day), r.n, r.kind) for r in got} == {("AAA", "01", "HH", "2014-03-30", 3, "3C"), ("BBB", "", "EH", "2014-03-30", 1, "1C"), ("CCC", "01", "HH", "2014-03-30", 2, "invalid")}


def test_jaccard_summary(spark):
    v = [0.0, 0.05, 0.5, 0.5, 1.0, 0.1, 0.3]
    df = spark.createDataFrame([("a", x) for x in v] + [("b", 0.25)] * 3, "k string, jaccard double")
    got = {r.k: r for r in M.jaccard_summary(df, ["k"]).collect()}
    assert got["a"].js_dist == np.histogram(v)[0].tolist() and (got["a"].js_min, got["a"].js_max) == (0, 1) and got["a"].js_mean == pytest.approx(np.mean(v), abs=1e-6)
    assert got["b"].js_dist == np.histogram([0.25] * 3)[0].tolist()


def test_a_shared_folder_is_wanted_off_local_mode():
    from types import SimpleNamespace as Stub

    session = lambda master, **conf: Stub(sparkContext=Stub(master=master), conf=Stub(get=lambda k, d: conf.get("dir", d)))
    with pytest.raises(ValueError, match="checkpoint"):
        io.scratch(session("spark://somewhere"), "x")
    assert io.scratch(session("spark://somewhere", dir="s3://shared/"), "x").startswith("s3://shared/x-")
    assert io.scratch(session("local[4]"), "x").startswith("file:///tmp/spark-")
