"""The carry-over stream with days that come out of order, late, or not at all."""

import os
import time

from pyspark.sql import functions as F

from quakeframe.operators import continuity as K
from quakeframe.streaming import streams as T

DAYS = "station long, day long, starttime double, data array<double>"


def stream(spark, tmp_path, batches):
    """One micro-batch for each list of (station, day); a day is 10 samples of 1 s."""
    for k, days in enumerate(batches):
        rows = [(s, d, d * 10.0, [float(100 * s + 10 * d + j) for j in range(10)]) for s, d in days]
        path = tmp_path / f"part-{k}"
        spark.createDataFrame(rows, DAYS).coalesce(1).write.parquet(str(path))
        for f in path.glob("*.parquet"):
            os.rename(f, tmp_path / f"{k}.parquet")
            os.utime(tmp_path / f"{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    s = spark.readStream.schema(DAYS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "*.parquet"))
    return s.withColumn("ends", F.timestamp_millis((F.col("day") + 1) * 10_000))


def test_order_gaps_and_late_days(spark, tmp_path):
    batches = [[(1, 1), (2, 1)], [(1, 3)], [(1, 2), (2, 2)], [(1, 5), (1, 6)], [(1, 9), (2, 9)], [(1, 4), (2, 3)], [(1, 13), (2, 13)]]
    got = T.drained(spark, T.carry_over(stream(spark, tmp_path, batches), 3, 1.0, "20 seconds"), "test-t1").collect()
    on_time = {(r.station, r.day): (r.previous_appended, r.starttime, r.data) for r in got if not r.late}
    late = {(r.station, r.day): (r.previous_appended, len(r.data)) for r in got if r.late}
    # Days 4 and 3 come when the watermark stands at 80 s (day 9 ends at 100 s): too late, and no day is joined to them.
    assert late == {(1, 4): (False, 10), (2, 3): (False, 10)}
    given = sorted({x for b in batches for x in b} - set(late) - {(1, 13), (2, 13)})
    rows = [(s, d, d * 10.0, [float(100 * s + 10 * d + j) for j in range(10)], 1.0) for s, d in given]
    want = K.carry_over_tail(spark.createDataFrame(rows, DAYS + ", sampling_rate double"), 3).collect()
    assert on_time == {(r.station, r.day): (r.previous_appended, r.starttime, r.data) for r in want}
    assert on_time[1, 2][0] and on_time[1, 3][0] and not on_time[1, 5][0] and on_time[1, 6][0] and not on_time[1, 9][0]


def test_nothing_carried_and_spent_tails(spark, tmp_path):
    got = T.drained(spark, T.carry_over(stream(spark, tmp_path, [[(1, 1), (1, 2)], [(1, 9)]]), 0, 1.0, "1 second"), "test-t1").collect()
    assert {(r.day, r.previous_appended, len(r.data)) for r in got} == {(1, False, 10), (2, False, 10)}


def test_a_day_given_again_with_a_later_end(spark, tmp_path):
    """The later row counts; the timer of the earlier end finds nothing due."""
    s = stream(spark, tmp_path, [[(1, 1)], [(1, 1)], [(2, 8)], [(2, 20)]])
    moved = s.withColumn("ends", F.when((F.col("station") == 1) & F.input_file_name().endswith("/1.parquet"), F.timestamp_millis(F.lit(90_000))).otherwise(F.col("ends")))
    got = T.drained(spark, T.carry_over(moved, 3, 1.0, "20 seconds"), "test-t1").collect()
    assert sorted((r.station, r.day, r.late) for r in got) == [(1, 1, False), (2, 8, False)]


def test_many_days_that_wait_at_one_station(spark, tmp_path):
    """6,000 days of one station come at once and out of order: one pass gives them out, not one for each of them."""
    rows = [(1, d, d * 10.0, [float(d + j) for j in range(10)]) for d in range(6000)]
    spark.createDataFrame(rows, DAYS).repartition(1, F.hash("day")).sortWithinPartitions(F.hash("day")).write.parquet(str(tmp_path / "days"))
    s = spark.readStream.schema(DAYS).parquet(str(tmp_path / "days")).withColumn("ends", F.timestamp_millis((F.col("day") + 1) * 10_000))
    started = time.monotonic()
    got = T.drained(spark, T.carry_over(s, 3, 1.0, "20 seconds"), "test-t1")
    assert got.filter("not late").count() == 5998 and got.filter("previous_appended").count() == 5997
    assert got.agg(F.sum(F.size("data"))).first()[0] == 5998 * 10 + 5997 * 3
    assert time.monotonic() - started < 60
