"""Small exact cases and properties of the kernels and array functions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quakeframe.functions import arrays as A
from quakeframe.functions import kernels as K
from quakeframe.operators import continuity, joins, picking


def sequential(p, threshold, drop):
    """The rule said sample by sample."""
    out, i, n = [], 0, len(p)
    while i < n:
        if p[i] < threshold:
            i += 1
            continue
        end = next((j for j in range(i, min(n, i + K.LOOK)) if p[j] < threshold - drop), None)
        if end is None:
            end = next((j for j in range(i, n) if p[j] < threshold), n)
        best = max(range(i, end), key=lambda j: (p[j], -j))
        out.append((best, end - i, p[best]))
        i = end
    return out


def test_extract_follows_the_sequential_rule():
    rng = np.random.default_rng(3)
    for _ in range(400):
        n = int(rng.integers(7, 400))
        p = np.clip(np.convolve(rng.random(n), np.ones(7) / 7, "same") + (rng.random(n) < 0.3) * rng.random(n) * 0.4, 0, 1)
        if rng.random() < 0.3:
            p[n // 3 :] = np.maximum(p[n // 3 :], 0.47)
        assert K.extract(p, 0.5, 0.05) == sequential(p.tolist(), 0.5, 0.05)


@pytest.mark.parametrize(
    ("npts", "window", "slide", "padded", "expected"),
    [(1008, 200, 100, False, (1100, 0, 92)), (300, 100, 100, False, (400, 0, 100)), (1008, 1008, 500, False, (1508, 0, 500)), (1000, 1008, 500, False, (1508, 0, 508)), (1008, 1008, 500, True, (2008, 254, 746)), (2000, 1008, 500, True, (2508, 254, 254))],
)
def test_padding(spark, npts, window, slide, padded, expected):
    pad = A.padding(F.lit(npts), window, slide, padded)
    r = spark.range(1).select(*[v.alias(k) for k, v in pad.items()]).first()
    assert (r.total, r.start_pad, r.end_pad) == expected


def test_windows_of_a_padded_ramp_stitch_to_the_ramp(spark):
    df = spark.range(1).select("id", F.transform(F.sequence(F.lit(0), F.lit(1999)), lambda v: v.cast("double")).alias("p"))
    pad = A.padding(F.size("p"), 1008, 500, True)
    padded = df.withColumn("p", A.pad_edges(F.col("p"), pad["start_pad"], pad["end_pad"].cast("int")))
    windows = picking.sliding_windows(padded, "p", 1008, 500)
    assert [r.start for r in windows.orderBy("window_id").collect()] == [0, 500, 1000, 1500]
    assert picking.stitch(windows, ["id"], "p", 1008, 500, 254, 2000).first().p == [float(k) for k in range(2000)]


def test_normalise_zeroes_dead_components(spark):
    r = spark.createDataFrame([([0.0, 1000.0],), ([-2000.0, 5.0],), ([0.0, 0.0],)], "x array<double>").select(A.normalise(F.col("x")).alias("x")).collect()
    assert [max(map(abs, x.x)) for x in r] == [1.0, 1.0, 0.0]


def test_quantised_probabilities_truncate(spark):
    p = [k / 1000 for k in range(1, 1001)]
    q = spark.createDataFrame([(p,)], "p array<double>").select(A.quantised(F.col("p")).alias("q")).first().q
    assert q[:9] == [0] * 9 and q[9] == 1 and q[-1] == 100


def test_bandpass_passes_the_band_only():
    sections = K.bandpass_sections(1, 17, 100, 2)
    t = np.arange(4000) / 100
    level = lambda f: np.abs(K.sections_applied(sections, np.sin(2 * np.pi * f * t))[2000:]).max()
    assert level(5) == pytest.approx(1, abs=0.03)
    assert level(0.05) < 0.02 and level(45) < 0.02


def test_resampling_keeps_a_sine():
    x = np.sin(2 * np.pi * 2 * np.arange(400) / 40)
    assert np.abs(K.resampled(x, 40, 100) - np.sin(2 * np.pi * 2 * np.arange(1000) / 100)).max() < 1e-9


def test_merged_day_has_a_line_across_the_gap():
    day = K.merged_day(np.array([0.0, 20.0]), [np.full(10, 1.0), np.full(10, 3.0)], 1.0, 0.0)
    assert len(day) == 86400 and day[9] == 1 and day[20] == 3 and day[15] == pytest.approx(1 + 2 * 6 / 11) and day[-1] == 3


def test_cut_padded_has_always_the_same_length(spark):
    x = spark.createDataFrame([([1.0, 2.0, 3.0], k) for k in (-5, -2, 0, 1, 2, 7)], "x array<double>, f int")
    got = [r.y for r in x.select(A.cut_padded(F.col("x"), F.col("f"), 4).alias("y")).collect()]
    assert got == [[0, 0, 0, 0], [0, 0, 1, 2], [1, 2, 3, 0], [2, 3, 0, 0], [3, 0, 0, 0], [0, 0, 0, 0]]


def _day(text):
    from datetime import UTC, datetime

    return datetime.strptime(text, "%Y-%m-%d %H:%M:%S").replace(tzinfo=UTC).timestamp()


@pytest.mark.parametrize(
    ("start", "end", "run", "days", "expected"),
    [
        (None, None, "2023-01-01", 2, (None, 0)),
        ("2023-02-01 05:05:05", None, "2023-01-01", 7, (None, 0)),
        ("2023-01-01 01:01:01", "2023-02-01 23:59:59", "2023-02-02", 7, (None, 0)),
        ("2023-01-01 01:01:01", "2023-03-01 23:59:59", "2023-02-01", 7, ("2023-02-01", 7)),
        ("2023-02-01 05:10:01", None, "2023-01-22", 30, ("2023-02-01", 20)),
        ("2023-01-01 05:10:01", "2023-02-01 22:59:59", "2023-01-22", 30, ("2023-01-22", 10)),
        ("2023-02-01 05:10:01", "2023-03-01 19:59:59", "2023-01-01", 90, ("2023-02-01", 28)),
    ],
)
def test_run_range(spark, start, end, run, days, expected):
    e = spark.createDataFrame([("A", start and _day(start), end and _day(end))], "station string, start_date double, end_date double")
    r = spark.createDataFrame([("A", _day(run + " 00:00:00"), days)], "station string, start double, days int")
    got = joins.station_run_range(r, e, ["station"]).first()
    assert (got.run_start, got.n_days) == (expected[0] and _day(expected[0] + " 00:00:00"), expected[1])


def test_gaps_and_signal_fill_the_day(spark):
    s = spark.createDataFrame([("A", 0, 100.0, 1.0, 500), ("A", 0, 400.0, 1.0, 100), ("A", 0, 1000.0, 1.0, 50)], "station string, day long, starttime double, sampling_rate double, npts long")
    g = continuity.find_gaps(s, ["station"]).orderBy("begin").collect()
    assert [(x.begin, x.end) for x in g] == [(0, 100), (599, 1000), (1049, 86400)]  # from the last sample on


def test_close_picks_go_in_pairs(spark):
    p = spark.createDataFrame([(1, "A", 0.0), (2, "A", 8.0), (3, "A", 15.9), (4, "B", 16.0)], "pick_id long, station string, arrival_time double")
    got = {r.pick_id: r.is_close for r in continuity.remove_close_picks(p, 8, ["station"]).collect()}
    assert got == {1: False, 2: True, 3: True, 4: False}
