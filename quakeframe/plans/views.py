"""How the driver's tables stand for picks, events, waveforms and evaluations.

Every view has a DataFrame form and the same thing in DuckDB SQL, so that a query and its
oracle start from equal rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeframe.plans.registry import table


def epoch_seconds(ts: Column) -> Column:
    """Seconds since 1970 of a zone-less timestamp, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"), ts.cast("timestamp_ntz")) / F.lit(1e6)


def picks(spark: SparkSession, d: str) -> DataFrame:
    """events: one pick per row; users are stations, event types phases."""
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("pick_id"), F.col("user_id").alias("station"), epoch_seconds(F.col("ts")).alias("arrival_time"), F.col("event_type").alias("phase"), F.col("value").alias("amplitude"), "props")


PICKS = "picks AS (SELECT event_id AS pick_id, user_id AS station, epoch_us(ts) / 1e6 AS arrival_time, event_type AS phase, value AS amplitude, props FROM events)"


def events(spark: SparkSession, d: str) -> DataFrame:
    """orders: one earthquake or blast per row."""
    o = table(spark, d, "orders")
    return o.select(
        F.col("o_orderkey").alias("evid"),
        epoch_seconds(F.col("o_orderdate")).alias("origin_time"),
        (F.col("o_totalprice") / 100000).alias("magnitude"),
        F.when(F.col("o_orderstatus") == "P", "m").otherwise("l").alias("magnitude_type"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "qb").otherwise("le").alias("event_type"),
        (36 + (F.col("o_custkey") % 70) / 10).alias("event_lat"),
        (-114 + (F.col("o_orderkey") % 50) / 10).alias("event_lon"),
        F.when(F.col("o_custkey") % 13 == 0, F.lit(None)).otherwise((F.col("o_custkey") % 200) / 10).cast("double").alias("event_depth"),
    )


EVENTS = """evt AS (SELECT o_orderkey AS evid, epoch_us(o_orderdate) / 1e6 AS origin_time, o_totalprice / 100000 AS magnitude,
  CASE WHEN o_orderstatus = 'P' THEN 'm' ELSE 'l' END AS magnitude_type, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'qb' ELSE 'le' END AS event_type,
  36 + (o_custkey % 70) / 10 AS event_lat, -114 + (o_orderkey % 50) / 10 AS event_lon,
  CASE WHEN o_custkey % 13 = 0 THEN NULL ELSE (o_custkey % 200) / 10 END::DOUBLE AS event_depth FROM orders)"""


def catalog(spark: SparkSession, d: str) -> DataFrame:
    """lineitem: one arrival of an event at a station per row."""
    x = table(spark, d, "lineitem")
    return x.select(
        F.col("l_orderkey").alias("evid"),
        F.col("l_suppkey").alias("station"),
        F.col("l_linestatus").alias("channel"),
        F.col("l_linenumber").cast("long").alias("line"),
        F.col("l_partkey").alias("part"),
        epoch_seconds(F.col("l_shipdate")).alias("arrival_time"),
        F.when(F.col("l_tax") >= 0.06, 1.0).when(F.col("l_tax") >= 0.03, 0.75).otherwise(0.5).alias("pick_quality"),
        F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "R", -1).otherwise(0).cast("long").alias("first_motion"),
        (F.col("l_extendedprice") / 400).alias("source_receiver_distance"),
        (F.col("l_discount") * 10).alias("weight"),
        F.col("l_quantity").alias("quantity"),
    )


CATALOG = """catalog AS (SELECT l_orderkey AS evid, l_suppkey AS station, l_linestatus AS channel, l_linenumber::BIGINT AS line, l_partkey AS part,
  epoch_us(l_shipdate) / 1e6 AS arrival_time, CASE WHEN l_tax >= 0.06 THEN 1.0 WHEN l_tax >= 0.03 THEN 0.75 ELSE 0.5 END::DOUBLE AS pick_quality,
  CASE WHEN l_returnflag = 'A' THEN 1 WHEN l_returnflag = 'R' THEN -1 ELSE 0 END::BIGINT AS first_motion,
  l_extendedprice / 400 AS source_receiver_distance, l_discount * 10 AS weight, l_quantity AS quantity FROM lineitem)"""


def evaluation(spark: SparkSession, d: str) -> DataFrame:
    """lineitem: one detector output of an epoch on a waveform; true_index -1 is noise."""
    x = table(spark, d, "lineitem")
    q = F.col("l_quantity").cast("long")
    return x.select(
        F.col("l_linenumber").cast("long").alias("epoch"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("waveform_id"),
        F.when(F.col("l_returnflag") == "N", -1).otherwise(q).cast("long").alias("true_index"),
        (q + F.col("l_partkey") % 21 - 10).alias("est_index"),
        F.round(F.col("l_discount") * 10, 4).alias("proba"),
        F.when(F.col("l_returnflag") != "N", F.when(F.col("l_linestatus") == "O", "qb").otherwise("le")).alias("event_type"),
        (F.col("l_orderkey") + 59990000).alias("evid"),
        F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "R", -1).otherwise(0).cast("long").alias("true_fm"),
        (F.col("l_partkey") % 3 - 1).alias("pred_fm"),
    )


EVALUATION = """ev AS (SELECT l_linenumber::BIGINT AS epoch, l_orderkey * 10 + l_linenumber AS waveform_id,
  CASE WHEN l_returnflag = 'N' THEN -1 ELSE l_quantity::BIGINT END::BIGINT AS true_index, l_quantity::BIGINT + l_partkey % 21 - 10 AS est_index,
  round(l_discount * 10, 4) AS proba, CASE WHEN l_returnflag <> 'N' THEN CASE WHEN l_linestatus = 'O' THEN 'qb' ELSE 'le' END END AS event_type,
  l_orderkey + 59990000 AS evid, CASE WHEN l_returnflag = 'A' THEN 1 WHEN l_returnflag = 'R' THEN -1 ELSE 0 END::BIGINT AS true_fm,
  l_partkey % 3 - 1 AS pred_fm FROM lineitem)"""


def waveforms(spark: SparkSession, d: str) -> DataFrame:
    """embeddings: one trace of 64 samples per row."""
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("row_id"), F.transform("embedding", lambda x: x.cast("double")).alias("x"), F.col("label").cast("long").alias("label"))


WAVEFORMS = "wf AS (SELECT vec_id AS row_id, list_transform(embedding, lambda v: v::DOUBLE) AS x, label::BIGINT AS label FROM embeddings)"


def probabilities(spark: SparkSession, d: str) -> DataFrame:
    """embeddings as probability series: |x| scaled to 0..1."""
    w = waveforms(spark, d)
    return w.select("row_id", F.transform("x", lambda v: F.least(F.lit(1.0), F.round(F.abs(v) * 3, 6))).alias("p"), "label")


PROBS = "pr AS (SELECT vec_id AS row_id, list_transform(embedding, lambda v: least(1.0, round(abs(v::DOUBLE) * 3, 6))) AS p, label::BIGINT AS label FROM embeddings)"


def segments(spark: SparkSession, d: str) -> DataFrame:
    """events as trace segments of 1 sample a second: a station's record from each event on, for `value` minutes."""
    p = picks(spark, d)
    return p.select("station", F.floor(F.col("arrival_time") / 86400).cast("long").alias("day"), F.col("arrival_time").alias("starttime"), F.lit(1.0).alias("sampling_rate"), F.floor(F.col("amplitude") * 60 + 1).cast("long").alias("npts"))


SEGMENTS = "segs AS (SELECT user_id AS station, floor(epoch_us(ts) / 1e6 / 86400)::BIGINT AS day, epoch_us(ts) / 1e6 AS starttime, 1.0::DOUBLE AS sampling_rate, floor(value * 60 + 1)::BIGINT AS npts FROM events)"


def segments100(spark: SparkSession, d: str) -> DataFrame:
    """events as segments of three channels at 100 Hz: a station's record from each event on, for `value` minutes, and after 0 to 8 missing samples some seconds more. Every 50th station is unknown."""
    p = picks(spark, d)
    n = F.floor(F.col("amplitude") * 6000 + 1).cast("long")
    start = F.round(F.col("arrival_time") * 100) / 100
    two = F.array(F.struct(start.alias("starttime"), n.alias("npts")), F.struct((start + (n + F.col("pick_id") % 9) / 100).alias("starttime"), (500 + F.col("pick_id") % 100).alias("npts")))
    channel = F.concat(F.lit("HH"), F.substring(F.lit("ENZ"), (F.col("pick_id") % 3 + 1).cast("int"), F.lit(1)))
    x = p.select(F.when(F.col("station") % 50 != 0, F.col("station")).alias("station"), channel.alias("channel"), F.explode(two).alias("s")).select("station", "channel", "s.*")
    return x.select(F.lit("WY").alias("network"), "station", "channel", F.floor(F.col("starttime") / 86400).cast("long").alias("day"), "starttime", F.lit(100.0).alias("sampling_rate"), "npts")


SEGMENTS100 = """p100 AS (SELECT event_id AS id, CASE WHEN user_id % 50 <> 0 THEN user_id END AS station, 'HH' || substr('ENZ', (event_id % 3 + 1)::INT, 1) AS channel, round(epoch_us(ts) / 1e6 * 100) / 100 AS s, floor(value * 6000 + 1)::BIGINT AS n FROM events),
q100 AS (SELECT station, channel, s AS starttime, n AS npts FROM p100 UNION ALL SELECT station, channel, s + (n + id % 9) / 100, 500 + id % 100 FROM p100),
segs100 AS (SELECT station, channel, floor(starttime / 86400)::BIGINT AS day, starttime, 100.0::DOUBLE AS sampling_rate, npts FROM q100)"""


def unknowns(spark: SparkSession, d: str) -> DataFrame:
    """lineitem as detector outputs of which some have no epoch, a probability of NaN or none, an unknown true place, or a quality or distance of NaN."""
    x, k = evaluation(spark, d), F.col("waveform_id")
    nan = F.lit(float("nan"))
    return x.select(
        "waveform_id", "event_type", "evid", F.when(F.col("epoch") != 2, F.col("epoch")).alias("epoch"), F.when(k % 13 == 0, nan).when(k % 17 != 0, F.col("proba")).alias("proba"),
        F.when(k % 19 != 0, F.col("true_index")).alias("true_index"), "est_index", F.when(k % 5 == 0, nan).when(k % 7 != 0, (k % 4) / 4).alias("pick_quality"),
    )


UNKNOWNS = f"""{EVALUATION}, un AS (SELECT waveform_id, event_type, evid, CASE WHEN epoch <> 2 THEN epoch END AS epoch, CASE WHEN waveform_id % 13 = 0 THEN 'nan'::DOUBLE WHEN waveform_id % 17 <> 0 THEN proba END AS proba,
  CASE WHEN waveform_id % 19 <> 0 THEN true_index END AS true_index, est_index, CASE WHEN waveform_id % 5 = 0 THEN 'nan'::DOUBLE WHEN waveform_id % 7 <> 0 THEN waveform_id % 4 / 4 END::DOUBLE AS pick_quality FROM ev)"""
