"""Queries of the catalog and split operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from quakeframe.operators import catalog as C
from quakeframe.operators import metrics as M
from quakeframe.operators import splits as S
from quakeframe.operators.continuity import remove_close_picks
from quakeframe.plans import views as V
from quakeframe.plans.registry import query

BOXES = [(37.0, 39.0, -113.0, -111.0), (40.5, 42.0, -112.5, -110.0)]
SEED = "split-1"
FLAG_TOLERANCES = [0.1, 0.25, 0.5, 0.75, 0.9]


def _fence(keys: str, value: str, source: str, k: float) -> str:
    return f"""q AS (SELECT {keys}, quantile_cont({value}, 0.25) AS q1, quantile_cont({value}, 0.75) AS q3 FROM {source} WHERE {value} IS NOT NULL GROUP BY ALL),
fs AS (SELECT {keys}, count(v) AS n_inside, round(coalesce(avg(v), 0), 6) AS fence_mean, round(coalesce(stddev_pop(v), 0), 6) AS fence_std
  FROM (SELECT s.*, CASE WHEN {value} > q1 - {k} * (q3 - q1) AND {value} < q3 + {k} * (q3 - q1) THEN {value} END AS v FROM {source} s JOIN q USING ({keys}) WHERE {value} IS NOT NULL) GROUP BY ALL)"""


@query("flagship_pick_metrics", f"""
WITH {V.PICKS}, g AS (SELECT *, lag(arrival_time) OVER w AS a, lead(arrival_time) OVER w AS b FROM picks WINDOW w AS (PARTITION BY station ORDER BY arrival_time, pick_id)),
k AS (SELECT * FROM g WHERE coalesce(arrival_time - a >= 600, true) AND coalesce(b - arrival_time >= 600, true)),
e AS (SELECT station, tolerance, least(1.0, amplitude / 100) > tolerance AS p, phase <> 'error' AS t, pick_id % 40 - floor(amplitude)::BIGINT % 40 AS r
  FROM k, (SELECT unnest([0.1, 0.25, 0.5, 0.75, 0.9])::DOUBLE AS tolerance)),
er AS (SELECT station, tolerance, CASE WHEN p AND t THEN r END AS r FROM e), {_fence('station, tolerance', 'r', 'er', 1.5)},
m AS (SELECT station, tolerance, sum((p AND t)::INT) tp, sum((NOT p AND NOT t)::INT) tn, sum((p AND NOT t)::INT) fp, sum((NOT p AND t)::INT) fn,
  round(coalesce(avg(CASE WHEN p AND t THEN r END), 0), 6) residual_mean, round(coalesce(stddev_pop(CASE WHEN p AND t THEN r END), 0), 6) residual_std FROM e GROUP BY ALL)
SELECT station, tolerance, tp::BIGINT tp, tn::BIGINT tn, fp::BIGINT fp, fn::BIGINT fn, residual_mean, residual_std, (tp + fn)::BIGINT AS n_picks, tp::BIGINT AS n_picked,
  coalesce(fence_mean, 0) AS trimmed_residual_mean, coalesce(fence_std, 0) AS trimmed_residual_std,
  round(CASE WHEN tp + tn + fp + fn > 0 THEN (tp + tn) / (tp + tn + fp + fn) ELSE 0 END, 6) AS accuracy,
  round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall FROM m LEFT JOIN fs USING (station, tolerance)""")
def flagship(spark, d):
    p = remove_close_picks(V.picks(spark, d), 600, ["station"]).filter(~F.col("is_close"))
    e = p.select("station", F.least(F.lit(1.0), F.col("amplitude") / 100).alias("proba"), F.when(F.col("phase") != "error", F.col("pick_id") % 40).otherwise(-1).alias("true_index"), (F.floor("amplitude") % 40).alias("est_index"))
    return M.detector_metrics(e, FLAG_TOLERANCES, ["station"])


@query("p1_filter_quality", f"WITH {V.CATALOG} SELECT evid, station, line, part, pick_quality FROM catalog WHERE pick_quality >= 0.75")
def p1(spark, d):
    return C.filter_quality(V.catalog(spark, d), 0.75).select("evid", "station", "line", "part", "pick_quality")


@query("p2_filter_first_motion", f"WITH {V.CATALOG} SELECT evid, line, part, first_motion, pick_quality FROM catalog WHERE pick_quality IN (0.5, 1.0) AND first_motion <> -1")
def p2(spark, d):
    return C.filter_first_motion(V.catalog(spark, d), True).select("evid", "line", "part", "first_motion", "pick_quality")


@query("p3_select_signal", """
SELECT l_orderkey AS evid, l_partkey AS part, l_quantity AS arrival_sample, l_extendedprice / 400 AS distance_km FROM lineitem
WHERE l_returnflag = 'A' AND l_linestatus = 'O' AND l_extendedprice / 400 < 150 AND l_quantity > 5 AND l_quantity < 45 AND (CASE WHEN l_suppkey % 7 = 0 THEN NULL WHEN l_suppkey % 2 = 0 THEN 'UU' ELSE 'XX' END) IS DISTINCT FROM 'UU'""")
def p3(spark, d):
    x = V.table(spark, d, "lineitem")
    s = x.select(F.col("l_orderkey").alias("evid"), F.col("l_partkey").alias("part"), F.col("l_returnflag").alias("trace_category"), F.col("l_linestatus").alias("status"), (F.col("l_extendedprice") / 400).alias("distance_km"), F.col("l_quantity").alias("arrival_sample"), F.when(F.col("l_suppkey") % 7 == 0, None).when(F.col("l_suppkey") % 2 == 0, "UU").otherwise("XX").alias("author"))
    return C.select_signal(s, "A", "O", 150, 5, 45, "UU").select("evid", "part", "arrival_sample", "distance_km")


@query("p4_exclude_boxes", f"WITH {V.EVENTS} SELECT evid, event_lat, event_lon FROM evt WHERE NOT ((event_lat > 37 AND event_lat < 39 AND event_lon > -113 AND event_lon < -111) OR (event_lat > 40.5 AND event_lat < 42 AND event_lon > -112.5 AND event_lon < -110))")
def p4(spark, d):
    return C.exclude_boxes(V.events(spark, d), BOXES).select("evid", "event_lat", "event_lon")


_INSIDE = "strftime(to_timestamp(origin_time) AT TIME ZONE 'UTC', '%y%m%d')::INT BETWEEN 970101 AND 981231 AND event_lat BETWEEN 37 AND 40 AND -event_lon BETWEEN 110 AND 113"


@query("p5_separate_events", f"WITH {V.EVENTS} SELECT evid, CASE WHEN {_INSIDE} THEN 'extracted' ELSE 'kept' END AS side FROM evt")
def p5(spark, d):
    a, b = C.separate_events(V.events(spark, d), (970101, 981231), (37.0, 40.0), (110.0, 113.0))
    return a.select("evid", F.lit("extracted").alias("side")).unionByName(b.select("evid", F.lit("kept").alias("side")))


@query("p6_filter_candidates", f"WITH {V.CATALOG}, {V.EVENTS} SELECT c.evid, c.station, c.line, c.part, magnitude FROM catalog c JOIN evt USING (evid) WHERE pick_quality IN (1.0, 0.75) AND source_receiver_distance < 120 AND magnitude > 3")
def p6(spark, d):
    c = V.catalog(spark, d).join(V.events(spark, d).select("evid", "magnitude"), "evid")
    return C.filter_candidates(c, [1.0, 0.75], 120, 3).select("evid", "station", "line", "part", "magnitude")


@query("p7_filter_distance", f"WITH {V.CATALOG} SELECT station, count(*) AS n FROM catalog WHERE source_receiver_distance < 90 GROUP BY station")
def p7(spark, d):
    return C.filter_distance(V.catalog(spark, d), 90).groupBy("station").agg(F.count(F.lit(1)).alias("n"))


@query("p8_quality_from_weight", f"WITH {V.CATALOG} SELECT evid, line, part, CASE WHEN weight >= 0.98 THEN 1.0 WHEN weight >= 0.6 THEN 0.75 ELSE 0.5 END::DOUBLE AS quality FROM catalog")
def p8(spark, d):
    return V.catalog(spark, d).select("evid", "line", "part", C.quality_from_weight(F.col("weight")).alias("quality"))


_STRATUM = "CASE WHEN event_type = 'qb' THEN 'cbl' WHEN event_type = 'le' AND evid >= 60000000 THEN 'ceq' WHEN event_type = 'le' THEN 'heq' ELSE 'noise' END"


@query("p9_event_stratum", f"WITH {V.EVALUATION} SELECT epoch, waveform_id, {_STRATUM} AS stratum FROM ev")
def p9(spark, d):
    return V.evaluation(spark, d).select("epoch", "waveform_id", C.event_stratum(F.col("event_type"), F.col("evid")).alias("stratum"))


@query("p10_harmonise", f"WITH {V.EVENTS} SELECT evid, origin_time, event_lon, event_lat FROM evt")
def p10(spark, d):
    e = V.events(spark, d).withColumnsRenamed({v: k for k, v in C.HARMONISED.items()})
    return C.harmonise(e).select("evid", "origin_time", "event_lon", "event_lat")


@query("p11_drop_bad_waveforms", f"WITH {V.WAVEFORMS}, b AS (SELECT row_id, list_transform(x, lambda v: CASE WHEN row_id % 11 = 0 AND v > 0.2 THEN 'nan'::DOUBLE WHEN row_id % 7 = 0 THEN 0 ELSE v END) AS x FROM wf) SELECT row_id FROM b WHERE len(list_filter(x, lambda v: v IS NULL OR isnan(v))) = 0 AND list_max(list_transform(x, lambda v: abs(v))) >= 1e-14")
def p11(spark, d):
    row = F.col("row_id")
    w = V.waveforms(spark, d).withColumn("x", F.transform("x", lambda v: F.when((row % 11 == 0) & (v > 0.2), float("nan")).when(row % 7 == 0, 0.0).otherwise(v)))
    return C.drop_bad_waveforms(w, ["x"]).select("row_id")


@query("p12_split_by_epoch", f"WITH {V.PICKS} SELECT arrival_time >= 1705000000 AS late, pick_id FROM picks")
def p12(spark, d):
    a, b = C.split_by_epoch(V.picks(spark, d), 1705000000.0)
    part = lambda df, late: df.select(F.lit(late).alias("late"), "pick_id")
    return part(a, False).unionByName(part(b, True))


@query("p14_is_operating", "SELECT s_suppkey AS station, day, coalesce(s IS NOT NULL AND day >= s AND (e IS NULL OR day <= e), false) AS operating FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE s_suppkey % 20 END AS s, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_suppkey % 20 + 15 END AS e FROM supplier), (SELECT unnest([5, 15, 30]) AS day)")
def p14(spark, d):
    k = F.col("s_suppkey")
    s = V.table(spark, d, "supplier").select(k.alias("station"), F.when(k % 9 != 0, k % 20).alias("s"), F.when(k % 4 != 0, k % 20 + 15).alias("e"), F.explode(F.array(F.lit(5), F.lit(15), F.lit(30))).alias("day"))
    return s.select("station", "day", C.is_operating(F.col("day"), F.col("s"), F.col("e")).alias("operating"))


@query("p15_clamped_sigmoid", f"WITH {V.PICKS} SELECT pick_id, round(1 / (1 + exp(-greatest(-70, least(70, amplitude - 50)))), 6) AS p FROM picks")
def p15(spark, d):
    return V.picks(spark, d).select("pick_id", F.round(C.clamped_sigmoid(F.col("amplitude") - 50), 6).alias("p"))


_COMPONENTS = """c AS (SELECT o_orderkey AS evid, substr('ENZ', k::INT, 1) AS component, ['HH', 'EH', 'BH', 'HN'][o_orderkey % 4 + 1] || substr('12ZENZ', (k + CASE WHEN (o_custkey + k) % 3 = 0 THEN 3 ELSE 0 END)::INT, 1) AS channel,
  CASE WHEN (o_custkey + k) % 19 <> 0 THEN 10 + (o_custkey * k % 23 = 5)::INT END AS npts, CASE WHEN o_custkey * k % 5 = 2 THEN 0.5 WHEN o_custkey * k % 5 = 1 THEN -0.5 ELSE 0 END::DOUBLE AS starttime, 1.0::DOUBLE AS dt FROM orders, (SELECT unnest([1, 2, 3]) AS k) WHERE NOT (o_custkey % 11 = 0 AND k = 2))"""


@query("p16_component_consistency", f"""WITH {_COMPONENTS}, f AS (SELECT *, starttime + npts - 1 AS endtime, (component = 'E' AND channel IN ('EHE', 'EH1', 'BHE', 'BH1', 'HHE', 'HH1')) OR (component = 'N' AND channel IN ('EHN', 'EH2', 'BHN', 'BH2', 'HHN', 'HH2')) OR (component = 'Z' AND channel IN ('EHZ', 'BHZ', 'HHZ')) AS ok FROM c)
SELECT evid FROM f e JOIN f n USING (evid) JOIN f z USING (evid) WHERE e.component = 'E' AND n.component = 'N' AND z.component = 'Z' AND e.ok AND n.ok AND z.ok
  AND abs(e.starttime - n.starttime) < n.dt AND abs(n.starttime - z.starttime) < n.dt AND abs(e.endtime - n.endtime) < n.dt AND abs(n.endtime - z.endtime) < n.dt AND e.npts = n.npts AND n.npts = z.npts""")
def p16(spark, d):
    """Missing components, channels that aren't allowed, starts half a sample or a whole one apart, unknown and unequal lengths."""
    o = V.table(spark, d, "orders").withColumn("k", F.explode(F.array(*map(F.lit, (1, 2, 3))))).filter("NOT (o_custkey % 11 = 0 AND k = 2)")
    cust, k = F.col("o_custkey"), F.col("k")
    code = lambda names, at: F.element_at(F.array(*map(F.lit, names)), at.cast("int"))
    c = o.select(F.col("o_orderkey").alias("evid"), code("ENZ", k).alias("component"), F.concat(code(["HH", "EH", "BH", "HN"], F.col("o_orderkey") % 4 + 1), code("12ZENZ", k + F.when((cust + k) % 3 == 0, 3).otherwise(0))).alias("channel"), F.when((cust + k) % 19 != 0, 10 + (cust * k % 23 == 5).cast("int")).alias("npts"), F.when(cust * k % 5 == 2, 0.5).when(cust * k % 5 == 1, -0.5).otherwise(0.0).alias("starttime"), F.lit(1.0).alias("dt"))
    return C.component_consistency(c.withColumn("endtime", F.col("starttime") + F.col("npts") - 1), ["evid"], rates=False)


@query("u1_combine_catalogs", f"WITH {V.CATALOG} SELECT evid, station, arrival_time, CASE WHEN channel = 'O' THEN 'qb' ELSE 'le' END AS event_type FROM catalog")
def u1(spark, d):
    c = V.catalog(spark, d)
    return C.combine_catalogs([(c.filter("channel = 'F'"), "le"), (c.filter("channel <> 'F'"), "qb")], ["evid", "station", "arrival_time"])


@query("u2_combine_splits", f"WITH {V.CATALOG} SELECT evid, line, part, first_motion, CASE WHEN first_motion = 0 THEN -1 ELSE quantity::BIGINT END::BIGINT AS pick_index FROM catalog")
def u2(spark, d):
    c = V.catalog(spark, d)
    signal = c.filter("first_motion <> 0").withColumn("pick_index", F.col("quantity").cast("long"))
    parts = [signal.filter("first_motion = 1"), signal.filter("first_motion = -1")]
    return C.combine_splits(parts, c.filter("first_motion = 0").drop("quantity")).select("evid", "line", "part", "first_motion", F.col("pick_index").cast("long").alias("pick_index"))


@query("a8_magnitude_distribution", f"WITH {V.EVENTS}, b AS (SELECT CASE WHEN magnitude < 1 THEN 0 WHEN magnitude < 2 THEN 1 WHEN magnitude < 3 THEN 2 WHEN magnitude < 4 THEN 3 ELSE 4 END AS bin FROM evt WHERE magnitude_type = 'l' AND magnitude >= 0.5 AND magnitude <= 5), c AS (SELECT bin, count(*) AS n FROM b GROUP BY bin) SELECT bin::INT AS bin, n, round(n / sum(n) OVER (), 6) AS share FROM c")
def a8(spark, d):
    return C.magnitude_distribution(V.events(spark, d), [0.0, 1.0, 2.0, 3.0, 4.0, 5.0], 0.5)


@query("a9_class_counts", f"WITH {V.CATALOG}, c AS (SELECT pick_quality, count(*) AS n FROM catalog GROUP BY 1) SELECT *, round(100 * n / sum(n) OVER (), 6) AS percent FROM c")
def a9(spark, d):
    return C.class_counts(V.catalog(spark, d), "pick_quality")


@query("a15_station_list", "SELECT n_name AS network, s_suppkey AS station, '' AS location, l_returnflag AS chan2, count(DISTINCT l_linestatus || l_linenumber % 2) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL HAVING n >= 3")
def a15(spark, d):
    x = V.table(spark, d, "lineitem").join(V.table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(V.table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    inv = x.select(F.col("n_name").alias("network"), F.col("s_suppkey").alias("station"), F.lit("").alias("location"), F.col("l_returnflag").alias("chan2"), F.concat("l_linestatus", (F.col("l_linenumber") % 2).cast("string")).alias("channel"))
    return C.station_list(inv, 3)


@query("a16_coverage", f"WITH {V.CATALOG} SELECT sum((weight >= 0.3)::INT)::BIGINT AS found, count(*) AS total, round(100 * sum((weight >= 0.3)::INT) / count(*), 6) AS percent FROM catalog")
def a16(spark, d):
    return C.coverage(V.catalog(spark, d), F.col("weight") >= 0.3)


@query("w5_assign_event_ids", f"""WITH {V.EVENTS}, m AS (SELECT trunc(avg(event_depth))::INT AS m FROM evt), z AS (SELECT evid, trunc(event_lat * 10)::INT AS a, trunc(event_lon * 10)::INT AS o, trunc(coalesce(event_depth, m) * 10)::INT AS z FROM evt, m)
SELECT evid, dense_rank() OVER (ORDER BY a, o, z)::BIGINT AS event_id FROM z""")
def w5(spark, d):
    return C.assign_event_ids(V.events(spark, d)).select("evid", "event_id")


_SPLIT = f"""k AS (SELECT DISTINCT evid FROM catalog), r AS (SELECT evid, row_number() OVER (ORDER BY md5('{SEED}:' || evid), evid) AS rk, count(*) OVER () AS n FROM k),
sp AS (SELECT evid, CASE WHEN rk <= floor(0.8 * n) THEN 'train' WHEN rk <= floor(0.8 * n) + floor(0.5 * (n - floor(0.8 * n))) THEN 'validation' ELSE 'test' END AS split FROM r)"""


@query("w4_event_split", f"WITH {V.CATALOG}, {_SPLIT} SELECT evid, split FROM sp")
def w4(spark, d):
    return S.event_split(V.catalog(spark, d), "evid", 0.8, 0.1, 0.1, SEED)


@query("w4_hash_split", "WITH u AS (SELECT o_orderkey AS evid, ('0x' || substr(md5('split-1:' || o_orderkey), 1, 8))::BIGINT / 4294967296.0 AS u FROM orders) SELECT evid, CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.9 THEN 'validation' ELSE 'test' END AS split FROM u")
def w4_hash(spark, d):
    return V.events(spark, d).select("evid", S.hash_split(F.col("evid"), 0.8, 0.1, SEED).alias("split"))


@query("w4_split_examples", f"""WITH {V.CATALOG}, c AS (SELECT CASE WHEN first_motion <> 0 THEN evid END AS evid, station, line, part % 5 AS part FROM catalog),
k AS (SELECT DISTINCT evid FROM c WHERE evid IS NOT NULL), r AS (SELECT evid, row_number() OVER (ORDER BY md5('{SEED}:' || evid), evid) AS rk, count(*) OVER () AS n FROM k),
z AS (SELECT *, row_number() OVER (ORDER BY md5('{SEED}:' || station || ':' || line || ':' || part)) AS rk, count(*) OVER () AS n FROM c WHERE evid IS NULL),
sp AS (SELECT c.*, rk, n, 0.8 AS f FROM c JOIN r USING (evid) UNION ALL SELECT evid, station, line, part, rk, n, 0.6 FROM z)
SELECT evid, station, line, part, CASE WHEN rk <= floor(f * n) THEN 'train' WHEN rk <= floor(f * n) + floor(0.5 * (n - floor(f * n))) THEN 'validation' ELSE 'test' END AS split FROM sp""")
def w4_examples(spark, d):
    """Events together, rows without one each for itself; some of those are equal."""
    c = V.catalog(spark, d).select(F.when(F.col("first_motion") != 0, F.col("evid")).alias("evid"), "station", "line", (F.col("part") % 5).alias("part"))
    return S.split_examples(c, "evid", 0.8, 0.1, 0.1, SEED, 0.6, ["station", "line", "part"])


@query("j7_assign_split_rows", f"WITH {V.CATALOG}, {_SPLIT} SELECT evid, station, line, part, split FROM catalog JOIN sp USING (evid)")
def j7(spark, d):
    c = V.catalog(spark, d)
    return S.assign_split_rows(c.select("evid", "station", "line", "part"), w4(spark, d), "evid")


@query("a22_split_report", f"WITH {V.CATALOG}, {_SPLIT}, g AS (SELECT split, count(*) AS n_rows, count(DISTINCT evid) AS n_events FROM catalog JOIN sp USING (evid) GROUP BY split) SELECT *, round(100 * n_rows / sum(n_rows) OVER (), 6) AS percent FROM g")
def a22(spark, d):
    return S.split_report(j7(spark, d), "evid")


@query("a21_unique_events", f"WITH {V.CATALOG} SELECT channel, count(DISTINCT evid) AS n_events FROM catalog GROUP BY channel")
def a21(spark, d):
    return V.catalog(spark, d).groupBy("channel").agg(F.count_distinct("evid").alias("n_events"))


@query("j15_split_overlap", f"WITH {V.CATALOG}, a AS (SELECT DISTINCT evid FROM catalog WHERE channel = 'O'), b AS (SELECT DISTINCT evid FROM catalog WHERE channel = 'F') SELECT evid FROM a INTERSECT SELECT evid FROM b")
def j15(spark, d):
    c = V.catalog(spark, d)
    return S.overlap(c.filter("channel = 'O'"), c.filter("channel = 'F'"), "evid")


@query("u5_except", f"WITH {V.CATALOG} SELECT evid FROM catalog WHERE channel = 'O' EXCEPT SELECT evid FROM catalog WHERE channel = 'F'")
def u5(spark, d):
    c = V.catalog(spark, d)
    return c.filter("channel = 'O'").select("evid").subtract(c.filter("channel = 'F'").select("evid"))


@query("w6_sample_k", f"WITH {V.PICKS}, r AS (SELECT *, row_number() OVER (PARTITION BY phase ORDER BY md5('w6:' || pick_id), pick_id) AS rk FROM picks) SELECT pick_id, phase FROM r WHERE rk <= 200")
def w6(spark, d):
    return S.sample_k(V.picks(spark, d).select("pick_id", "phase"), 200, [S.shuffled("w6", F.col("pick_id")), F.col("pick_id")], ["phase"])


@query("w6_sample_unknown", f"WITH {V.UNKNOWNS}, r AS (SELECT *, row_number() OVER (PARTITION BY epoch ORDER BY md5('w6:' || waveform_id), waveform_id) AS rk FROM un) SELECT waveform_id, epoch FROM r WHERE rk <= 50")
def w6_unknown(spark, d):
    """Fifty rows of each epoch, those without one included."""
    u = V.unknowns(spark, d).select("waveform_id", "epoch")
    return S.sample_k(u, 50, [S.shuffled("w6", F.col("waveform_id")), F.col("waveform_id")], ["epoch"])


@query("p1_filter_unknown", f"WITH {V.UNKNOWNS} SELECT waveform_id, epoch, pick_quality FROM un WHERE pick_quality >= 0.5 AND NOT isnan(pick_quality)")
def p1_unknown(spark, d):
    return C.filter_quality(V.unknowns(spark, d), 0.5).select("waveform_id", "epoch", "pick_quality")


@query("w7_thin_every_nth", f"WITH {V.PICKS}, r AS (SELECT pick_id, row_number() OVER (ORDER BY md5('w7:' || pick_id), pick_id) AS rk FROM picks) SELECT pick_id FROM r WHERE (rk - 1) % 3 = 0")
def w7(spark, d):
    return S.thin_every_nth(V.picks(spark, d).select("pick_id"), 3, [S.shuffled("w7", F.col("pick_id")), F.col("pick_id")])


@query("w7_top_up", f"""WITH {V.PICKS}, r AS (SELECT pick_id, row_number() OVER (ORDER BY md5('w7:' || pick_id), pick_id) AS rk FROM picks WHERE phase <> 'error'),
kept AS (SELECT pick_id FROM r WHERE (rk - 1) % 3 = 0), others AS (SELECT pick_id, row_number() OVER (ORDER BY rk) - 1 AS place FROM r WHERE (rk - 1) % 3 <> 0),
n AS (SELECT (SELECT count(*) FROM lineitem WHERE l_returnflag = 'A') - (SELECT count(*) FROM kept) AS missing, (SELECT count(*) FROM others) AS size),
draws AS (SELECT ('0x' || substr(md5('w7:' || j), 1, 8))::BIGINT % size AS draw FROM (SELECT unnest(range(1, missing + 1)) AS j, size FROM n))
SELECT pick_id FROM kept UNION ALL SELECT pick_id FROM others JOIN draws ON place = draw""")
def w7_top_up(spark, d):
    """Noise is thinned and topped up to the number of signal rows, here those of one first motion."""
    n_signal = V.table(spark, d, "lineitem").filter("l_returnflag = 'A'").count()
    return S.thinned_to_signal(V.picks(spark, d).filter("phase <> 'error'").select("pick_id"), n_signal, 3, "pick_id", "w7")


@query("w13_match_distribution", f"""WITH {V.EVENTS}, t AS (SELECT floor(magnitude)::BIGINT AS bin FROM evt WHERE event_type = 'qb'), c AS (SELECT bin, count(*) AS n FROM t GROUP BY bin),
s AS (SELECT bin, round(500 * round(n / sum(n) OVER (), 6))::INT AS draws FROM c), pool AS (SELECT evid, floor(magnitude)::BIGINT AS bin FROM evt WHERE event_type = 'le'),
r AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY md5('w13:' || evid), evid) AS rk, count(*) OVER (PARTITION BY bin) AS size FROM pool),
q AS (SELECT s.bin, unnest(range(1, draws + 1)) AS draw FROM s WHERE draws > 0)
SELECT r.evid, r.bin, q.draw::INT AS draw FROM q JOIN r ON r.bin = q.bin AND r.rk = ('0x' || substr(md5('w13:' || q.bin || ':' || q.draw), 1, 8))::BIGINT % r.size + 1""")
def w13(spark, d):
    e = V.events(spark, d).withColumn("bin", F.floor("magnitude"))
    return C.match_distribution(e.filter("event_type = 'qb'"), e.filter("event_type = 'le'").select("evid", "bin"), "bin", 500, "evid", "w13")


@query("x28_upsample_minority", f"""WITH {V.CATALOG}, c AS (SELECT evid, line, part, station, first_motion, evid || ':' || line || ':' || part || ':' || station || ':' || quantity AS k FROM catalog WHERE first_motion <> 0 AND NOT (first_motion = -1 AND line <> 1)),
n AS (SELECT first_motion, count(*) AS n, max(count(*)) OVER () AS top FROM c GROUP BY 1), r AS (SELECT c.*, n, top, row_number() OVER (PARTITION BY c.first_motion ORDER BY md5('up:' || k), k) AS rk FROM c JOIN n USING (first_motion))
SELECT evid, line, part, station, first_motion, (top // n + CASE WHEN rk <= top % n THEN 1 ELSE 0 END)::BIGINT AS copies FROM r""")
def x28(spark, d):
    c = V.catalog(spark, d).filter("NOT (first_motion = -1 AND line <> 1)")
    key = F.concat_ws(":", "evid", "line", "part", "station", "quantity")
    up = S.upsample_minority(c, "first_motion", [1, -1], [S.shuffled("up", key), key])
    return up.groupBy("evid", "line", "part", "station", "first_motion").agg(F.count(F.lit(1)).alias("copies"))
