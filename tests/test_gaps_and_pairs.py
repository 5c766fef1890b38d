"""Pairs by rank, and gaps in whole samples, against plain Python."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quakeframe.operators import continuity as K
from quakeframe.operators import joins as J

PICK = "evid long, station string, magnitude double, line long"


@pytest.mark.parametrize("rows_of_a_range", [20_000, 3])
def test_pairs_are_partners_and_no_row_is_lost(spark, monkeypatch, rows_of_a_range):
    monkeypatch.setattr(J, "RANGE_ROWS", rows_of_a_range)
    rng = random.Random(3)
    rows = [(k % 90, rng.choice(["a", "b", None]), rng.choice([None, float("nan"), *[m / 10 for m in range(20)]]), k) for k in range(600)]
    got = J.pair_events(spark.createDataFrame(rows, PICK), spark.createDataFrame(rows, PICK), ["station"], -0.3, 0.4, "s", ["line"]).collect()
    pool = {(s, e, m) for e, s, m, _ in rows if s and m is not None and m == m}
    can = lambda e, s, m: {(e2, m2) for s2, e2, m2 in pool if s2 == s and e2 != e and m + -0.3 <= m2 <= m + 0.4}
    want = [r for r in rows if r[1] and r[2] is not None and r[2] == r[2] and can(*r[:3])]
    assert Counter(r.line for r in got) == Counter(r[3] for r in want)
    assert all((r.evid2, r.magnitude2) in can(r.evid, r.station, r.magnitude) for r in got)


def test_partners_are_equally_likely(spark):
    """One pick draws 20,000 times among 19 others of the same and of other magnitudes."""
    left = spark.range(20000).select(F.lit(0).cast("long").alias("evid"), F.lit("a").alias("station"), F.lit(1.0).alias("magnitude"), F.col("id").alias("line"))
    right = spark.createDataFrame([(k, "a", 1.0 + (k % 4) / 10, 0) for k in range(20)], PICK)
    n = Counter(r.evid2 for r in J.pair_events(left, right, ["station"], 0.0, 0.3, "s", ["line"]).collect())
    assert set(n) == set(range(1, 20)) and sum(n.values()) == 20000
    assert sum((c - 20000 / 19) ** 2 / (20000 / 19) for c in n.values()) < 50  # chi-square of 18 degrees


def test_a_hot_station_of_one_magnitude(spark, monkeypatch):
    """100,000 picks that could all pair with each other: as many rows come out, from ranges of even sizes."""
    monkeypatch.setattr(J, "RANGE_ROWS", 390)
    hot = spark.range(100_000).select(F.col("id").alias("evid"), F.lit("a").alias("station"), F.lit(2.5).alias("magnitude"))
    sizes = J.magnitude_index(hot, ["station"], "s").groupBy("_range").count().collect()
    assert len(sizes) > 200 and max(r["count"] for r in sizes) < 1000
    pairs = J.pair_events(hot, hot, ["station"], -0.1, 0.1, "s")
    assert pairs.filter("evid <> evid2").count() == 100_000 and pairs.select("evid2").distinct().count() > 55_000


SEG = "station string, channel string, day long, starttime double, sampling_rate double, npts long"


def gaps(spark, rows, **more):
    g = K.find_gaps(spark.createDataFrame([(s, c, d, d * 86400 + t, r, n) for s, c, d, t, r, n in rows], SEG), more.pop("keys", ["station", "channel"]), **more)
    return sorted((r.start_ind, r.npts, r.end_ind, round(r.begin % 86400, 2), round(r.end - r.day * 86400, 2)) for r in g.collect())


def test_gaps_of_five_samples_stay_and_of_four_go(spark):
    assert gaps(spark, [("a", "HHZ", 19723, 0.0, 100.0, 4_320_000), ("a", "HHZ", 19723, 43200.05, 100.0, 4_319_995)]) == [(4_319_999, 5, 4_320_004, 43199.99, 43200.05)]
    assert gaps(spark, [("a", "HHZ", 19723, 0.0, 100.0, 4_320_001), ("a", "HHZ", 19723, 43200.05, 100.0, 4_319_995)]) == []


@pytest.mark.parametrize("n", range(1, 60))
def test_gap_lengths_are_exact(n):
    """The arithmetic alone: ticks of epoch times at 100 Hz."""
    rng = random.Random(n)
    for _ in range(300):
        day, a = rng.randrange(19000, 21000), rng.randrange(8_000_000)
        start = day * 86400 + a / 100
        assert round((start - day * 86400) * 100) == a
        assert round((start + n / 100 - day * 86400) * 100) - a == n


def test_edges(spark):
    """The end gap begins with the last sample; an edge of one sample is none; overlapping segments count by the latest end."""
    assert gaps(spark, [(None, None, 0, 0.05, 100.0, 100), (None, None, 0, 0.5, 100.0, 20), (None, None, 0, 10.0, 100.0, 8_639_000 - 4)]) == [
        (0, 5, 5, 0.0, 0.05), (104, 895, 999, 1.04, 10.0), (8_639_995, 5, 8_640_000, 86399.95, 86400.0)]
    assert gaps(spark, [("a", "z", 0, 0.01, 100.0, 8_639_999)]) == []
    assert gaps(spark, [("a", "z", 0, 2.0, 1.0, 86398), ("a", "y", 0, 1.0, 1.0, 86399)]) == [(0, 2, 2, 0.0, 2.0)]


def test_channels_together(spark):
    rows = [("a", "E", 0, 0.0, 1.0, 50_000), ("a", "E", 0, 40_000.0, 1.0, 46_400), ("a", "N", 0, 0.0, 1.0, 86_400), ("a", "Z", 0, 100.0, 1.0, 1000), ("a", "Z", 0, 2000.0, 1.0, 84_400)]
    assert [g[:3] for g in gaps(spark, rows, keys=["station"], channel="channel")] == [(0, 100, 100), (1099, 900, 1999)]
    assert gaps(spark, rows, keys=["station"], channel="channel", any_missing=False) == []
    assert [g[:3] for g in gaps(spark, rows[:2], keys=["station"], channel="channel")] == [(0, 86400, 86400)]


def test_metadata(spark):
    rows = [("WY", "a", "EHZ", 1, 86400.0 + 3600, 100.0, 1000), ("WY", "a", "EHZ", 1, 86400.0 + 3620, 100.0, 1000)]
    s = spark.createDataFrame(rows, "network string, " + SEG)
    back = spark.createDataFrame([("WY", "a", 1, 500)], "network string, station string, day long, samples long")
    plain, moved = (json.loads(K.station_day_metadata(s, K.find_gaps(s, ["network", "station", "channel"]), ["network", "station"], appended=a).first().metadata) for a in (None, back))
    assert len(plain) == 16 and plain["channel"] == "EHZ" and plain["starttime"] == plain["original_starttime"] == "1970-01-02T00:00:00" and plain["npts"] == 8_640_000 and not plain["previous_appended"]
    assert plain["gaps"] == [["EHZ", 86400.0, 90000.0, 360000, 0, 360000], ["EHZ", 90009.99, 90020.0, 1000, 360999, 361999], ["EHZ", 90029.99, 172800.0, 8640000 - 363000 + 1, 362999, 8640000]]
    assert moved["previous_appended"] and moved["starttime"] == "1970-01-01T23:59:55" and moved["npts"] == 8_640_500 and moved["original_npts"] == 8_640_000 and moved["gaps"][0][4:] == [500, 360500]


def test_picks_in_gaps(spark):
    s = spark.createDataFrame([("a", "z", 0, 0.0, 100.0, 1000), ("a", "z", 0, 20.0, 100.0, 8_638_000)], SEG)
    p = spark.createDataFrame([(k, "a", 0, t) for k, t in enumerate([9.98, 9.99, 15.0, 19.97, 19.98, 20.0])], "k long, station string, day long, arrival_time double")
    g = K.find_gaps(s, ["station"]).first()
    kept = {r.k for r in J.mask_picks_in_gaps(p, K.find_gaps(s, ["station"]), ["station"]).collect()}
    assert (g.start_ind, g.end_ind) == (999, 1999) and kept == {0, 5}


def test_arrays_of_a_stored_archive_stay_where_they_lie(spark):
    from quakeframe.sources.archive import store_archive

    archive = spark.createDataFrame([(k % 7, c, [float(k), float(j)]) for k in range(20) for j, c in enumerate(["HHE", "HHN", "HHZ"])] + [(8, "HHE", [1.0]), (9, None, [1.0]), (9, "HHZ", None)], "station int, channel string, x array<double>")
    stored = store_archive(archive, ["station"], 4)
    picks = spark.createDataFrame([(k, k % 10, "HHE", "HHN", "HHZ") for k in range(30)] * 2, "pick_id int, station int, e string, n string, z string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        df = J.attach_waveforms_3c(picks, stored, ["station"], {"e": "e", "n": "n", "z": "z"})
        plan = df._jdf.queryExecution().executedPlan().toString()
        got = df.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange") == 1 and "Aggregate" not in plan and "Bucketed: true" in plan
    assert len(got) == 42 and all(r.x_n == [float(r.station), 1.0] for r in got)


def test_records_that_begin_in_the_last_half_sample(spark, tmp_path):
    """At one sample a second a record of 23:59:59.6 has no tick of its day: gaps end with it, and a day of it alone is one gap. As the SQL has it."""
    import duckdb

    from quakeframe.plans import catalogue

    con = duckdb.connect()
    con.execute("CREATE TABLE events (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR)")
    times = [(1, "01 00:00:00.2", 1.0), (1, "01 23:59:59.6", 1.0), (2, "01 23:59:59.5", 1.0), (3, "02 23:50:00", 60.0), (3, "02 23:59:59.9", 1.0), (4, "02 00:00:00", 1.0), (5, "01 23:59:59.7", 0.0), (5, "01 23:59:59.6", 2.0), (6, "03 23:59:59.4", 1.0)]
    con.executemany("INSERT INTO events VALUES (?, ?, ?, 'click', ?, '{}')", [(k, f"2024-01-{t}", s, v) for k, (s, t, v) in enumerate(times)])
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    df = catalogue.QUERIES["w2_find_gaps"](spark, str(tmp_path))
    r = con.execute(catalogue.ORACLES["w2_find_gaps"])
    at = [[c[0] for c in r.description].index(c) for c in df.columns]
    want = sorted(tuple(row[k] for k in at) for row in r.fetchall())
    assert sorted(map(tuple, df.collect())) == want
    assert {row[0] for row in want} == {1, 2, 3, 4, 5, 6} and (2, 19723, 1704067200.0, 1704153599.5, 86400.0, 86400, 0, 86400) in want


def _drawn_by_rule(rows, partners, low, high, seed):
    """Partners by the rule, one row after the other: places by magnitude and md5 of the event, its own left out."""
    import hashlib

    md5 = lambda *x: hashlib.md5(":".join(map(str, x)).encode()).hexdigest()
    out = []
    for e, s, m, k in rows:
        can = sorted({(m2, md5(seed, e2), e2) for e2, s2, m2, _ in partners if None not in (e, e2, s, m, m2) and s2 == s and e2 != e and m + low <= m2 <= m + high})
        if can:
            m2, _, e2 = can[int(md5(seed, e, s, k)[:13], 16) % len(can)]
            out.append((e, s, m, k, e2, m2))
    return sorted(out)


@pytest.mark.parametrize("apart", [False, True])
@pytest.mark.parametrize(("group_rows", "chunk_rows", "range_rows"), [(10**6, 10**5, 20_000), (10**6, 7, 20_000), (0, 10, 20_000), (0, 10, 3), (80, 10, 3)])
def test_pairs_by_stations_and_by_ranges_are_those_of_the_rule(spark, monkeypatch, apart, group_rows, chunk_rows, range_rows):
    """Events of up to 40 magnitudes, stations in chunks of few rows, in ranges, and some in each; rows that ask are those that offer, or others."""
    for name, v in (("GROUP_ROWS", group_rows), ("CHUNK_ROWS", chunk_rows), ("RANGE_ROWS", range_rows)):
        monkeypatch.setattr(J, name, v)
    rng = random.Random(11)
    some = lambda n: [(rng.choice([1, 1, 2, rng.randrange(3, 60), None]), rng.choice(["a", "a", "a", "b", "c", None]), rng.choice([None, *[m / 20 for m in range(40)]]), k) for k in range(n)]
    rows = some(300)
    partners = [(e, s, m, k) for e, s, m, k in some(200) if e] if apart else rows
    left = spark.createDataFrame(rows, PICK)
    right = spark.createDataFrame(partners, PICK) if apart else left
    got = J.pair_events(left, right, ["station"], -0.3, 0.4, "s", ["line"]).collect()
    want = _drawn_by_rule(rows, partners, -0.3, 0.4, "s")
    assert sorted((r.evid, r.station, r.magnitude, r.line, r.evid2, r.magnitude2) for r in got) == want and len(want) > 150


def test_whole_stations_are_moved_once(spark, tmp_path):
    """Rows that ask and offer themselves are written once, and one exchange deals them; nothing is as wide as an md5 there."""
    rows = spark.createDataFrame([(k % 50, "ab"[k % 2], k % 20 / 10, k) for k in range(300)], PICK)
    plan = J.pair_events(rows, rows, ["station"], -0.3, 0.4, "s")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan and "Window" not in plan
    exchange = plan[plan.index("Exchange hashpartitioning") :]
    assert "md5" not in exchange


def test_the_query_of_pairs_reads_one_written_table(spark):
    """j8_pair_events: its picks are joined and written once; what is left to run is one exchange of them."""
    from quakeframe.plans import catalogue

    plan = catalogue.QUERIES["j8_pair_events"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1 and "lineitem" not in plan
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
