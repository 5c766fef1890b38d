"""Queries of sources, sinks and streams: written from the tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from quakeframe.functions import arrays as A
from quakeframe.plans import views as V
from quakeframe.plans.registry import query
from quakeframe.sources import io
from quakeframe.streaming import streams as T


@query("s1_read_catalog", f"WITH {V.CATALOG} SELECT evid, station::VARCHAR AS station, CASE WHEN line = 1 THEN '' ELSE '0' || line END AS location, arrival_time, pick_quality FROM catalog WHERE channel = 'O'")
def s1(spark, d):
    c = V.catalog(spark, d).select("evid", F.col("station").cast("string").alias("station"), F.when(F.col("line") == 1, "  ").otherwise(F.concat(F.lit("0"), F.col("line").cast("string"))).alias("location"), F.when(F.col("channel") == "O", "P").otherwise("S").alias("phase"), "arrival_time", "pick_quality")
    path = io.scratch(spark, "s1")
    c.write.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path, header=True)
    return io.read_catalog(spark, path, "P", "evid long, station string, location string, phase string, arrival_time double, pick_quality double").drop("phase")


@query("s2_read_examples", f"WITH {V.WAVEFORMS} SELECT row_id, label, list_transform(x, lambda v: round(v, 6)) AS x FROM wf")
def s2(spark, d):
    w = V.waveforms(spark, d)
    a, b = io.scratch(spark, "s2-waves"), io.scratch(spark, "s2-meta")
    w.select("row_id", "x").write.parquet(a)
    w.select("row_id", "label").write.parquet(b)
    return io.read_examples(spark, a, b).select("row_id", "label", F.transform("x", lambda v: A.rounded(v)).alias("x"))


@query("s3_file_inventory", """WITH f AS (SELECT DISTINCT s_name, s_suppkey, l_linenumber, l_returnflag FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_linenumber <= 3 AND (l_suppkey % 5 <> 0 OR l_linenumber = 1)),
x AS (SELECT 'S' || s_suppkey AS station, ['HHZ', 'HHN', 'HHE'][l_linenumber] AS channel, l_returnflag FROM f)
SELECT 'UU' AS network, station, '01' AS location, 'HH' AS chan2, CASE l_returnflag WHEN 'A' THEN '2014-03-30' WHEN 'N' THEN '2014-03-31' ELSE '2014-04-01' END AS day, count(DISTINCT channel) AS n, CASE count(DISTINCT channel) WHEN 3 THEN '3C' WHEN 1 THEN '1C' ELSE 'invalid' END AS kind FROM x GROUP BY ALL""")
def s3(spark, d):
    x = V.table(spark, d, "lineitem").filter("l_linenumber <= 3 AND (l_suppkey % 5 <> 0 OR l_linenumber = 1)")
    channel = F.element_at(F.array(*map(F.lit, ("HHZ", "HHN", "HHE"))), F.col("l_linenumber").cast("int"))
    day = F.when(F.col("l_returnflag") == "A", "20140330").when(F.col("l_returnflag") == "N", "20140331").otherwise("20140401")
    path = F.concat(F.lit("/data/UU.S"), F.col("l_suppkey").cast("string"), F.lit(".01."), channel, F.lit("__"), day, F.lit("T000000Z__"), day, F.lit("T235959Z.mseed"))
    return io.file_inventory(x.select(path.alias("path"))).withColumn("day", F.col("day").cast("string"))


@query("s4_write_splits", f"WITH {V.CATALOG} SELECT CASE WHEN evid % 10 < 8 THEN 'train' WHEN evid % 10 = 8 THEN 'validation' ELSE 'test' END AS split, count(*) AS n FROM catalog GROUP BY 1")
def s4(spark, d):
    path = io.scratch(spark, "s4")
    k = F.col("evid") % 10
    io.write_splits(V.catalog(spark, d).withColumn("split", F.when(k < 8, "train").when(k == 8, "validation").otherwise("test")), path)
    return spark.read.parquet(path).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("s5_write_pick_catalog", f"WITH {V.PICKS} SELECT pick_id, station, printf('%.6f', arrival_time) || '0' AS arrival_time FROM picks")
def s5(spark, d):
    path = io.scratch(spark, "s5")
    io.write_pick_catalog(V.picks(spark, d), path, ["pick_id", "station", "arrival_time"], ["arrival_time"])
    return io.read_pick_files(spark, [path], "pick_id long, station long, arrival_time string")


@query("s7_write_probs", f"WITH {V.PROBS} SELECT row_id, (label)::BIGINT AS day, list_sum(list_transform(p, lambda v: trunc(v * 100)::INT))::BIGINT AS total FROM pr")
def s7(spark, d):
    path = io.scratch(spark, "s7")
    io.write_probs(V.probabilities(spark, d).withColumnRenamed("label", "day"), path)
    q = spark.read.parquet(path)
    return q.select("row_id", F.col("day").cast("long").alias("day"), F.aggregate("p", F.lit(0).cast("long"), lambda a, v: a + v).alias("total"))


@query("s8_write_corrections", f"WITH {V.WAVEFORMS} SELECT row_id AS pick_id, label AS station, round(x[1], 6) AS shift, list_transform(x, lambda v: round(v, 6)) AS preds FROM wf")
def s8(spark, d):
    w = V.waveforms(spark, d).withColumnRenamed("row_id", "pick_id")
    path = io.scratch(spark, "s8")
    io.write_corrections(w.select("pick_id", F.col("label").alias("station")), w.select("pick_id", A.rounded(F.element_at("x", 1)).alias("shift")), w.select("pick_id", F.col("x").alias("preds")), path)
    back = spark.read.schema("pick_id long, station long, shift double").csv(f"{path}/corrections", header=True)
    return back.join(spark.read.parquet(f"{path}/predictions"), "pick_id").withColumn("preds", F.transform("preds", lambda v: A.rounded(v)))


@query("u4_join_pick_files", f"WITH {V.PICKS} SELECT pick_id, station, printf('%.6f', arrival_time) || '0' AS arrival_time FROM picks")
def u4(spark, d):
    p = V.picks(spark, d)
    paths = [io.scratch(spark, "u4") for _ in range(2)]
    for k, path in enumerate(paths):
        io.write_pick_catalog(p.filter(F.col("pick_id") % 2 == k), path, ["pick_id", "station", "arrival_time"], ["arrival_time"])
    return io.read_pick_files(spark, paths, "pick_id long, station long, arrival_time string")


def _landed(spark, d, name):
    """A table written to a landing folder and streamed from there (a stream's source has to be a folder)."""
    df, path = V.table(spark, d, name), io.scratch(spark, name)
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def _pick_stream(spark, d):
    e = _landed(spark, d, "events")
    return e.select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("station"), F.col("event_id").alias("pick_id"))


@query("t2_stream_pick_counts", "WITH m AS (SELECT max(ts) - INTERVAL 1 HOUR AS wm FROM events), g AS (SELECT date_trunc('day', ts) AS day, user_id AS station, count(*) AS n FROM events GROUP BY ALL) SELECT epoch_us(day)::BIGINT AS day_start, station, n FROM g, m WHERE day + INTERVAL 1 DAY <= wm")
def t2(spark, d):
    counts = T.pick_counts(_pick_stream(spark, d), "1 hour")
    return T.drained(spark, counts.select(F.unix_micros("day_start").alias("day_start"), "station", "n"), "t2")


@query("t3_stream_lone_picks", "WITH m AS (SELECT epoch_us(max(ts)) - 3600000000 AS wm FROM events), g AS (SELECT event_id AS pick_id, user_id AS station, epoch_us(ts) AS t, epoch_us(lag(ts) OVER w) AS a, epoch_us(lead(ts) OVER w) AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)) SELECT station, pick_id FROM g, m WHERE coalesce(t - a >= 1800000000, true) AND coalesce(b - t >= 1800000000, true) AND t + 1800000000 - 1 <= wm")
def t3(spark, d):
    return T.drained(spark, T.lone_picks(_pick_stream(spark, d), 1800, "1 hour"), "t3")


@query("t1_stream_carry_over", """WITH b AS (SELECT label::BIGINT AS station, vec_id AS day, list_transform(embedding, lambda v: v::DOUBLE) AS data, vec_id * 6.4::DOUBLE AS starttime FROM embeddings),
l AS (SELECT *, lag(data[-10:]) OVER w AS tail, lag(starttime + 64) OVER w AS until, max(day) OVER () AS latest FROM b WINDOW w AS (PARTITION BY station ORDER BY day)),
j AS (SELECT *, coalesce(starttime - until + 1 > 0 AND starttime - until + 1 < 1.5, false) AS previous_appended FROM l)
SELECT station, day, previous_appended, CASE WHEN previous_appended THEN starttime - 10 ELSE starttime END AS starttime, list_transform(CASE WHEN previous_appended THEN list_concat(tail, data) ELSE data END, lambda v: round(v, 6)) AS data, false AS late FROM j WHERE day <= latest - 2""")
def t1(spark, d):
    """A day is 6.4 s long here; the two days within the delay of the last one still wait."""
    e = _landed(spark, d, "embeddings")
    days = e.select(F.col("label").cast("long").alias("station"), F.col("vec_id").alias("day"), (F.col("vec_id") * F.lit(6.4)).alias("starttime"), F.transform("embedding", lambda v: v.cast("double")).alias("data"), F.timestamp_millis((F.col("vec_id") + 1) * 6400).alias("ends"))
    c = T.carry_over(days, 10, 1.0, "12 seconds")
    return T.drained(spark, c.select("station", "day", "previous_appended", "starttime", F.transform("data", lambda v: A.rounded(v)).alias("data"), "late"), "t1")
