"""Queries of the joins and of the bookkeeping of continuous data."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quakeframe.functions import arrays as A
from quakeframe.operators import continuity as K
from quakeframe.operators import joins as J
from quakeframe.operators import picking as P
from quakeframe.operators import splits as S
from quakeframe.plans import views as V
from quakeframe.plans.registry import query
from quakeframe.sources.archive import store_archive

_ARCH = "arch AS (SELECT vec_id AS wave, x FROM (SELECT row_id AS vec_id, x FROM wf) WHERE vec_id % 3 <> 0)"


def _archive(spark, d):
    return V.waveforms(spark, d).filter("row_id % 3 <> 0").select(F.col("row_id").alias("wave"), "x")


@query("j1_attach_waveforms_1c", f"WITH {V.CATALOG}, {V.WAVEFORMS}, {_ARCH} SELECT evid, station, line, part, round(list_max(x), 6) AS peak FROM catalog JOIN arch ON part = wave")
def j1(spark, d):
    return J.attach_waveforms_1c(V.catalog(spark, d).withColumnRenamed("part", "wave"), _archive(spark, d), ["wave"]).select("evid", "station", "line", F.col("wave").alias("part"), F.round(F.array_max("x"), 6).alias("peak"))


_REPEATED = "events UNION ALL SELECT * FROM events WHERE event_type = 'click'"


@query("j2_attach_waveforms_3c", f"""
WITH p AS (SELECT event_id AS pick_id, user_id % 40 AS station, 'c' || (event_id % 5) AS z, 'c' || ((event_id + 1) % 5) AS n, 'c' || ((event_id + 2) % 5) AS e FROM (SELECT * FROM {_REPEATED})),
a AS (SELECT vec_id % 40 AS station, 'c' || label AS channel, min(list_transform(embedding, lambda v: v::DOUBLE)) AS x FROM embeddings WHERE label < 5 GROUP BY ALL)
SELECT pick_id, p.station, {", ".join(f"list_transform(a{c}.x, lambda v: round(v, 6)) AS x_{c}" for c in "zne")} FROM p JOIN a az ON az.station = p.station AND az.channel = z JOIN a an ON an.station = p.station AND an.channel = n JOIN a ae ON ae.station = p.station AND ae.channel = e""")
def j2(spark, d):
    """Picks of one type are given twice, and the archive, which is stored in buckets, has many waveforms for each channel."""
    p = V.picks(spark, d)
    p = p.unionAll(p.filter("phase = 'click'"))
    channel = lambda k: F.concat(F.lit("c"), ((F.col("pick_id") + k) % 5).cast("string"))
    p = p.select("pick_id", (F.col("station") % 40).alias("station"), channel(0).alias("z"), channel(1).alias("n"), channel(2).alias("e"))
    a = V.waveforms(spark, d).filter("label < 5").select((F.col("row_id") % 40).alias("station"), F.concat(F.lit("c"), F.col("label").cast("string")).alias("channel"), "x")
    found = J.attach_waveforms_3c(p, store_archive(a, ["station"], 8), ["station"], {"z": "z", "n": "n", "e": "e"})
    return found.select("pick_id", "station", *[F.transform(f"x_{k}", lambda v: F.round(v, 6)).alias(f"x_{k}") for k in "zne"])


@query("j1_coverage", f"WITH {V.CATALOG} SELECT part % 3 <> 0 AND part < (SELECT count(*) FROM embeddings) AS found, count(*) AS n FROM catalog GROUP BY 1")
def j1_coverage(spark, d):
    c = J.coverage_left(V.catalog(spark, d).withColumnRenamed("part", "wave"), _archive(spark, d), ["wave"])
    return c.groupBy("found").agg(F.count(F.lit(1)).alias("n"))


_CODES = "x AS (SELECT l_orderkey AS evid, l_returnflag || l_suppkey AS code FROM lineitem), h AS (SELECT DISTINCT 'A' || s_suppkey AS code FROM supplier WHERE s_nationkey < 12)"


def _codes(spark, d):
    x = V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("evid"), F.concat("l_returnflag", F.col("l_suppkey").cast("string")).alias("code"))
    return x, V.table(spark, d, "supplier").filter("s_nationkey < 12").select(F.concat(F.lit("A"), F.col("s_suppkey").cast("string")).alias("code"))


@query("j3_exclude_known_stations", f"WITH {_CODES} SELECT code, count(*) AS n FROM x WHERE code NOT IN (SELECT code FROM h) GROUP BY code")
def j3(spark, d):
    return J.exclude_known_stations(*_codes(spark, d)).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query("j4_keep_known_stations", f"WITH {_CODES} SELECT code, count(*) AS n FROM x WHERE code IN (SELECT code FROM h) GROUP BY code")
def j4(spark, d):
    return J.keep_known_stations(*_codes(spark, d)).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query("j5_drop_duplicate_events", f"WITH {V.CATALOG}, {V.EVENTS} SELECT evid, station, line, part FROM catalog WHERE evid NOT IN (SELECT evid FROM evt WHERE event_type = 'qb')")
def j5(spark, d):
    return J.drop_duplicate_events(V.catalog(spark, d), V.events(spark, d).filter("event_type = 'qb'")).select("evid", "station", "line", "part")


@query("j6_add_magnitudes", f"WITH {V.CATALOG}, {V.EVENTS} SELECT c.evid, station, line, part, magnitude, magnitude_type FROM catalog c LEFT JOIN (SELECT * FROM evt WHERE magnitude > 2) e USING (evid)")
def j6(spark, d):
    return J.add_magnitudes(V.catalog(spark, d).select("evid", "station", "line", "part"), V.events(spark, d).filter("magnitude > 2"))


_PAIRS = f"""{V.CATALOG}, {V.EVENTS}, l AS (SELECT c.evid, line, station, channel, magnitude, row_number() OVER () AS rid FROM catalog c JOIN evt USING (evid)), m AS (SELECT DISTINCT evid, station, channel, magnitude FROM l),
j AS (SELECT l.*, m.evid AS evid2, m.magnitude AS magnitude2, row_number() OVER (PARTITION BY rid ORDER BY m.magnitude, md5('pair:' || m.evid), m.evid) - 1 AS place, count(*) OVER (PARTITION BY rid) AS choice
FROM l JOIN m ON l.station = m.station AND l.channel = m.channel AND l.evid <> m.evid AND m.magnitude BETWEEN l.magnitude + -0.3 AND l.magnitude + 0.4)"""


@query("j8_pair_events", f"""WITH {_PAIRS} SELECT evid, station, channel, magnitude, evid2, magnitude2 FROM j WHERE place = ('0x' || substr(md5('pair:' || evid || ':' || station || ':' || channel), 1, 13))::BIGINT % choice""")
def j8(spark, d):
    """All picks look for a partner; some events have several picks at a station and channel, which are equal rows here."""
    m = V.catalog(spark, d).join(V.events(spark, d).select("evid", "magnitude"), "evid").select("evid", "station", "channel", "magnitude")
    return J.pair_events(m, m, ["station", "channel"], -0.3, 0.4, "pair")


@query("j8_pair_draws", f"""WITH {_PAIRS} SELECT evid, line, station, channel, evid2, magnitude2 FROM j WHERE place = ('0x' || substr(md5('pair:' || evid || ':' || station || ':' || channel || ':' || line), 1, 13))::BIGINT % choice""")
def j8_draws(spark, d):
    """Every pick draws for itself."""
    m = V.catalog(spark, d).join(V.events(spark, d).select("evid", "magnitude"), "evid").select("evid", "line", "station", "channel", "magnitude")
    return J.pair_events(m, m, ["station", "channel"], -0.3, 0.4, "pair", ["line"]).drop("magnitude")


_PICKS2 = """act0 AS (SELECT l_orderkey AS waveform_id, l_suppkey % 3 AS epoch, l_quantity::BIGINT AS act, l_linestatus FROM lineitem WHERE l_returnflag = 'A'), act AS (SELECT waveform_id, epoch, act FROM act0 UNION ALL SELECT waveform_id, epoch, act FROM act0 WHERE act < 10),
est AS (SELECT l_orderkey AS waveform_id, l_suppkey % 3 AS epoch, l_quantity::BIGINT + l_partkey % 9 - 4 AS est, round(l_discount * 10, 4) AS proba FROM lineitem WHERE l_returnflag <> 'N')"""


def _act_est(spark, d):
    """Actual picks, the early ones given twice, and estimated picks with their probabilities."""
    x = V.table(spark, d, "lineitem")
    key = [F.col("l_orderkey").alias("waveform_id"), (F.col("l_suppkey") % 3).alias("epoch")]
    q = F.col("l_quantity").cast("long")
    act = x.filter("l_returnflag = 'A'").select(*key, q.alias("act"))
    return act.unionAll(act.filter("act < 10")), x.filter("l_returnflag <> 'N'").select(*key, (q + F.col("l_partkey") % 9 - 4).alias("est"), F.round(F.col("l_discount") * 10, 4).alias("proba"))


@query("j9_match_picks", f"""WITH {_PICKS2}, a AS (SELECT *, row_number() OVER () AS rid FROM act), m AS (SELECT a.*, e.est, row_number() OVER (PARTITION BY rid ORDER BY abs(a.act - e.est), e.est) AS rk FROM a LEFT JOIN est e ON a.waveform_id = e.waveform_id AND a.epoch = e.epoch AND abs(a.act - e.est) < 5)
SELECT waveform_id, epoch, act, est, act - est AS residual FROM m WHERE rk = 1""")
def j9(spark, d):
    act, est = _act_est(spark, d)
    return J.match_picks(est, act, ["waveform_id", "epoch"], 5)


@query("j10_nearest_pick_residuals", """WITH a AS (SELECT o_orderkey AS waveform_id, o_custkey % 30 AS act1, o_custkey % 50 AS act2 FROM orders), e AS (SELECT DISTINCT l_orderkey AS waveform_id, l_quantity::BIGINT AS est FROM lineitem WHERE l_returnflag <> 'N'),
j AS (SELECT a.*, e.est, act1 - est AS r1, act2 - est AS r2 FROM a LEFT JOIN e USING (waveform_id)),
k AS (SELECT *, row_number() OVER (PARTITION BY waveform_id ORDER BY abs(r1), est) AS k1, row_number() OVER (PARTITION BY waveform_id ORDER BY abs(r2), est) AS k2 FROM j)
SELECT waveform_id, act1, act2, est, r1, r2, est IS NOT NULL AND (k1 = 1 OR k2 = 1) AS is_match FROM k""")
def j10(spark, d):
    o = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("waveform_id"), (F.col("o_custkey") % 30).alias("act1"), (F.col("o_custkey") % 50).alias("act2"))
    e = V.table(spark, d, "lineitem").filter("l_returnflag <> 'N'").select(F.col("l_orderkey").alias("waveform_id"), F.col("l_quantity").cast("long").alias("est")).distinct()
    return J.nearest_pick_residuals(e, o, ["waveform_id"])


_EPOCHS = "ep AS (SELECT s_suppkey % 60 AS station, CASE WHEN s_suppkey % 11 = 0 THEN NULL ELSE (s_suppkey % 40) * 86400.0 + 5000 END AS start_date, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE (s_suppkey % 40 + 30) * 86400.0 + 70000 END AS end_date FROM supplier), rq AS (SELECT DISTINCT user_id AS station, (user_id % 50) * 86400.0 AS start, 10 + user_id % 30 AS days FROM events)"


@query("j11_station_run_range", f"""WITH {_EPOCHS}, g AS (SELECT station, min(start_date) AS s, CASE WHEN bool_or(end_date IS NULL) THEN NULL ELSE max(end_date) END AS e FROM ep GROUP BY station),
j AS (SELECT rq.*, s, e, start + days * 86400.0 AS fin FROM rq LEFT JOIN g USING (station)), b AS (SELECT *, s IS NULL OR fin < s OR coalesce(start > e, false) AS bad, greatest(start, floor(s / 86400) * 86400.0) AS beg FROM j)
SELECT station, start::DOUBLE AS start, days, CASE WHEN NOT bad THEN beg END::DOUBLE AS run_start, CASE WHEN bad THEN 0 ELSE floor((least(fin, coalesce(e, fin)) - beg) / 86400) END::BIGINT AS n_days FROM b""")
def j11(spark, d):
    k = F.col("s_suppkey")
    e = V.table(spark, d, "supplier").select((k % 60).alias("station"), F.when(k % 11 != 0, (k % 40) * 86400.0 + 5000).alias("start_date"), F.when(k % 5 != 0, (k % 40 + 30) * 86400.0 + 70000).alias("end_date"))
    r = V.picks(spark, d).select("station").distinct().select("station", ((F.col("station") % 50) * 86400.0).alias("start"), (10 + F.col("station") % 30).alias("days"))
    return J.station_run_range(r, e, ["station"])


@query("j12_missing_days", f"WITH {V.SEGMENTS}, s AS (SELECT DISTINCT station FROM segs), c AS (SELECT station, unnest(range(19723, 19754)) AS day FROM s), h AS (SELECT station, day, count(*) AS files FROM segs GROUP BY ALL) SELECT c.station, c.day, coalesce(files, 0) AS files, CASE WHEN coalesce(files, 0) = 0 THEN 'missing' ELSE 'file_error' END AS error FROM c LEFT JOIN h USING (station, day) WHERE coalesce(files, 0) <> 3")
def j12(spark, d):
    s = V.segments(spark, d)
    return J.missing_days(s.select("station").distinct(), s, 19723, 19753, 3)


@query("s9_data_issue_report", f"WITH {V.SEGMENTS}, s AS (SELECT DISTINCT station FROM segs), c AS (SELECT station, unnest(range(19723, 19754)) AS day FROM s), h AS (SELECT station, day, count(*) AS files FROM segs GROUP BY ALL), i AS (SELECT c.station, c.day, CASE WHEN coalesce(files, 0) = 0 THEN 'missing' ELSE 'file_error' END AS error FROM c LEFT JOIN h USING (station, day) WHERE coalesce(files, 0) <> 3) SELECT station, error, list(day ORDER BY day) AS days FROM i GROUP BY ALL")
def s9(spark, d):
    return K.data_issue_report(j12(spark, d))


def _gaps(keys, source):
    """Gaps by the rule, over islands of samples: (keys, day, begin, end, npts, start_ind, end_ind, r)."""
    return f"""t AS (SELECT {keys}, day, sampling_rate AS r, greatest(round((starttime - day * 86400) * sampling_rate)::BIGINT, 0) AS a,
  least(round((starttime - day * 86400) * sampling_rate)::BIGINT + npts, (86400 * sampling_rate)::BIGINT) AS b, starttime, starttime + (npts - 1) / sampling_rate AS final FROM {source}),
o AS (SELECT *, max(b) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach, max(final) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, min(starttime) OVER (PARTITION BY {keys}, day, a) AS here FROM t WINDOW w AS (PARTITION BY {keys}, day ORDER BY a, b)),
e AS (SELECT {keys}, day, r, min(a) AS a, max(b) AS b, arg_min(starttime, (a, starttime)) AS st, max(final) AS final FROM t GROUP BY ALL),
g0 AS (SELECT {keys}, day, r, day * 86400.0::DOUBLE AS "begin", st AS "end", a AS npts, 0 AS start_ind FROM e WHERE a > 1
  UNION ALL SELECT {keys}, day, r, before, here, a - reach, reach - 1 FROM o WHERE a > reach AND reach IS NOT NULL
  UNION ALL SELECT {keys}, day, r, final, day * 86400.0 + 86400, (86400 * r)::BIGINT - b + 1, b - 1 FROM e WHERE b < 86400 * r),
gp AS (SELECT {keys}, day, r, "begin", "end", npts, start_ind, start_ind + npts AS end_ind FROM g0 WHERE npts >= ceil(0.05 * r - 1e-6))"""


_GAPS = _gaps("station", "segs")
_GAP_COLUMNS = 'day, round("begin", 3) AS "begin", round("end", 3) AS "end", round(npts / r, 3) AS duration, npts, start_ind, end_ind'


def _shown(g, *keys):
    return g.select(*keys, "day", *[F.round(c, 3).alias(c) for c in ("begin", "end", "duration")], "npts", "start_ind", "end_ind")


@query("w2_find_gaps", f"WITH {V.SEGMENTS}, {_GAPS} SELECT station, {_GAP_COLUMNS} FROM gp")
def w2(spark, d):
    return _shown(K.find_gaps(V.segments(spark, d), ["station"]), "station")


@query("w2_gaps_100hz", f"WITH {V.SEGMENTS100}, {_gaps('station, channel', 'segs100')} SELECT station, channel, {_GAP_COLUMNS} FROM gp")
def w2_100hz(spark, d):
    """Of each channel, with gaps of 0 to 8 samples and an unknown station."""
    return _shown(K.find_gaps(V.segments100(spark, d), ["station", "channel"]), "station", "channel")


def _missing(least):
    """Runs of samples that fewer than `least` of three channels have, from the ends of the islands of each channel."""
    return f"""t AS (SELECT station, channel, day, greatest(round((starttime - day * 86400) * 100)::BIGINT, 0) AS a, least(round((starttime - day * 86400) * 100)::BIGINT + npts, 8640000) AS b FROM segs100),
i1 AS (SELECT *, coalesce(a > max(b) OVER (PARTITION BY station, channel, day ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)::INT AS fresh FROM t),
i2 AS (SELECT *, sum(fresh) OVER (PARTITION BY station, channel, day ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM i1),
i3 AS (SELECT station, day, channel, min(a) AS a, max(b) AS b FROM i2 GROUP BY station, day, channel, island),
c AS (SELECT station, day, a AS p FROM i3 UNION SELECT station, day, b FROM i3 UNION SELECT station, day, 0 FROM i3 UNION SELECT station, day, 8640000 FROM i3),
s AS (SELECT *, lead(p) OVER (PARTITION BY station, day ORDER BY p) AS q FROM c),
k AS (SELECT s.station, s.day, p, q, count(i3.channel) AS n FROM s LEFT JOIN i3 ON s.station IS NOT DISTINCT FROM i3.station AND s.day = i3.day AND i3.a <= p AND i3.b >= q WHERE q IS NOT NULL GROUP BY ALL),
l AS (SELECT *, coalesce(lag(q) OVER (PARTITION BY station, day ORDER BY p), -1) AS prior FROM k WHERE n < {least}),
r AS (SELECT *, sum((p <> prior)::INT) OVER (PARTITION BY station, day ORDER BY p) AS run FROM l),
m AS (SELECT station, day, min(p) AS a, max(q) AS b FROM r GROUP BY station, day, run),
g AS (SELECT station, day, a, b, b - a + (b = 8640000 AND a > 0)::INT AS npts, greatest(a - 1, 0) AS start_ind FROM m)
SELECT station, day, npts, start_ind, start_ind + npts AS end_ind FROM g WHERE npts >= 5"""


@query("w2_any_missing_3c", f"WITH {V.SEGMENTS100}, {_missing(3)}")
def w2_any(spark, d):
    """Samples that one of the three channels at least doesn't have."""
    return K.find_gaps(V.segments100(spark, d), ["station"], channel="channel").select("station", "day", "npts", "start_ind", "end_ind")


@query("w2_all_missing_3c", f"WITH {V.SEGMENTS100}, {_missing(1)}")
def w2_all(spark, d):
    """Samples that no channel has."""
    return K.find_gaps(V.segments100(spark, d), ["station"], channel="channel", any_missing=False).select("station", "day", "npts", "start_ind", "end_ind")


def _shifted(rate):
    return f"q AS (SELECT pick_id, station, arrival_time + 1800 AS arrival_time, floor((arrival_time + 1800) / 86400)::BIGINT AS day, round((arrival_time + 1800 - floor((arrival_time + 1800) / 86400) * 86400) * {rate})::BIGINT AS ind FROM picks)"


@query("j13_mask_picks_in_gaps", f"WITH {V.PICKS}, {V.SEGMENTS}, {_GAPS}, {_shifted(1)} SELECT pick_id, station FROM q WHERE NOT EXISTS (SELECT 1 FROM gp WHERE gp.station = q.station AND gp.day = q.day AND q.ind >= gp.start_ind AND q.ind < gp.end_ind)")
def j13(spark, d):
    return _masked(spark, d, K.find_gaps(V.segments(spark, d), ["station"]))


def _masked(spark, d, gaps):
    t = F.col("arrival_time") + 1800
    p = V.picks(spark, d).select("pick_id", "station", t.alias("arrival_time"), F.floor(t / 86400).alias("day"))
    return J.mask_picks_in_gaps(p, gaps, ["station"]).select("pick_id", "station")


@query("j13_mask_picks_100hz", f"WITH {V.PICKS}, {V.SEGMENTS100}, {_gaps('station, channel', 'segs100')}, {_shifted(100)} SELECT pick_id, station FROM q WHERE NOT EXISTS (SELECT 1 FROM gp WHERE channel = 'HHZ' AND gp.station = q.station AND gp.day = q.day AND q.ind >= gp.start_ind AND q.ind < gp.end_ind)")
def j13_100hz(spark, d):
    return _masked(spark, d, K.find_gaps(V.segments100(spark, d), ["station", "channel"]).filter("channel = 'HHZ'"))


@query("p13_sufficient_signal", f"WITH {V.SEGMENTS} SELECT station, day, sum(npts)::BIGINT AS npts, round(100 * sum(npts) / 86400, 6) AS percent, round(100 * sum(npts) / 86400, 6) >= 10 AS enough FROM segs GROUP BY ALL")
def p13(spark, d):
    return K.sufficient_signal(V.segments(spark, d), ["station", "day"], 10)


_ISO = "strftime(epoch_ms(0) + to_microseconds(round({t} * 1e6)::BIGINT), '%Y-%m-%dT%H:%M:%S') || CASE WHEN round({t} * 1e6)::BIGINT % 1000000 <> 0 THEN printf('.%06d', round({t} * 1e6)::BIGINT % 1000000) ELSE '' END"


@query("s6_station_day_metadata", f"""WITH {V.SEGMENTS100}, {_gaps('station, channel', 'segs100')},
u AS (SELECT station, day, min(a) AS a, max(b) AS b, min(starttime) AS st, max(final) AS fin, min(channel) AS code, count(DISTINCT channel) AS codes FROM t GROUP BY ALL),
v AS (SELECT station, day, CASE WHEN codes > 1 THEN code[1:2] || '?' ELSE code END AS channel, day % 3 = 0 AS app, CASE WHEN a > 1 THEN 0 ELSE a END AS a, CASE WHEN b < 8640000 THEN 8640000 ELSE b END AS b,
  CASE WHEN a > 1 THEN day * 86400.0 ELSE st END AS os, CASE WHEN b < 8640000 THEN day * 86400.0 + 86399.99 ELSE fin END AS oe FROM u),
x AS (SELECT v.station, v.day, list([gp.channel, round("begin", 2)::DECIMAL(20, 2)::VARCHAR, round("end", 2)::DECIMAL(20, 2)::VARCHAR, npts::VARCHAR, (start_ind - v.a + app::INT * 1000)::VARCHAR, (end_ind - v.a + app::INT * 1000)::VARCHAR] ORDER BY gp.channel, start_ind) AS gaps FROM v JOIN gp ON v.station IS NOT DISTINCT FROM gp.station AND v.day = gp.day GROUP BY ALL),
y AS (SELECT v.*, os - app::INT * 10 AS ss, coalesce(gaps, []) AS gaps FROM v LEFT JOIN x ON v.station IS NOT DISTINCT FROM x.station AND v.day = x.day)
SELECT day, len(gaps) AS n_gaps, 'WY' AS network, station, channel, 100.0::DOUBLE AS sampling_rate, 0.01::DOUBLE AS dt, {_ISO.format(t='ss')} AS starttime, (b - a + app::INT * 1000)::BIGINT AS npts, round(ss, 3)::DOUBLE AS starttime_epoch, round(oe, 3)::DOUBLE AS endtime_epoch, app AS previous_appended,
  {_ISO.format(t='os')} AS original_starttime, {_ISO.format(t='oe')} AS original_endtime, round(os, 3)::DOUBLE AS original_starttime_epoch, round(oe, 3)::DOUBLE AS original_endtime_epoch, (b - a)::BIGINT AS original_npts, gaps FROM y""")
def s6(spark, d):
    """All 15 fields and the gaps of all channels, read back from the JSON; every third day has 10 s of the day before put before it."""
    s = V.segments100(spark, d)
    appended = s.filter("day % 3 = 0").select("network", "station", "day").distinct().withColumn("samples", F.lit(1000))
    m = K.station_day_metadata(s, K.find_gaps(s, ["network", "station", "channel"]), ["network", "station"], appended=appended)
    kinds = {"sampling_rate": "double", "dt": "double", "npts": "long", "starttime_epoch": "double", "endtime_epoch": "double", "previous_appended": "boolean", "original_starttime_epoch": "double", "original_endtime_epoch": "double", "original_npts": "long", "station": "long"}
    names = ["network", "station", "channel", "sampling_rate", "dt", "starttime", "npts", "starttime_epoch", "endtime_epoch", "previous_appended", "original_starttime", "original_endtime", "original_starttime_epoch", "original_endtime_epoch", "original_npts"]
    j = F.from_json("metadata", ", ".join(f"{c} {kinds.get(c, 'string')}" for c in names) + ", gaps array<array<string>>")
    m = m.select("day", "n_gaps", j.alias("j")).select("day", "n_gaps", "j.*")
    time = lambda x: F.round(x.cast("double"), 2).cast("decimal(20,2)").cast("string")
    m = m.withColumn("gaps", F.transform("gaps", lambda g: F.array(g[0], time(g[1]), time(g[2]), g[3], g[4], g[5])))
    return m.withColumns({c: F.round(c, 3) for c in names if c.endswith("_epoch")})


@query("j14_attach_pick_metadata", f"WITH {V.PICKS}, s AS (SELECT pick_id, round(amplitude / 2, 6) AS shift FROM picks WHERE phase <> 'error') SELECT p.pick_id, station, phase, shift FROM picks p JOIN s USING (pick_id)")
def j14(spark, d):
    p = V.picks(spark, d)
    return J.attach_pick_metadata(p.filter("phase <> 'error'").select("pick_id", F.round(F.col("amplitude") / 2, 6).alias("shift")), p.select("pick_id", "station", "phase"))


@query("w1_remove_close_picks", f"WITH {V.PICKS}, g AS (SELECT *, lag(arrival_time) OVER w AS a, lead(arrival_time) OVER w AS b FROM picks WINDOW w AS (PARTITION BY station ORDER BY arrival_time, pick_id)) SELECT pick_id, station, coalesce(arrival_time - a < 3600, false) OR coalesce(b - arrival_time < 3600, false) AS is_close FROM g")
def w1(spark, d):
    return K.remove_close_picks(V.picks(spark, d), 3600, ["station"]).select("pick_id", "station", "is_close")


@query("w8_carry_over_tail", """WITH b AS (SELECT label::BIGINT AS station, vec_id AS day, list_transform(embedding, lambda v: v::DOUBLE) AS data, (CASE WHEN vec_id % 5 = 0 THEN 1000 ELSE 0 END + row_number() OVER (PARTITION BY label ORDER BY vec_id) * 64)::DOUBLE AS starttime FROM embeddings),
l AS (SELECT *, lag(data[-10:]) OVER w AS tail, lag(starttime + len(data)) OVER w AS until FROM b WINDOW w AS (PARTITION BY station ORDER BY day)),
j AS (SELECT *, coalesce(tail IS NOT NULL AND starttime - until + 1 > 0 AND starttime - until + 1 < 1.5, false) AS previous_appended FROM l)
SELECT station, day, previous_appended, CASE WHEN previous_appended THEN starttime - 10 ELSE starttime END AS starttime, list_transform(CASE WHEN previous_appended THEN list_concat(tail, data) ELSE data END, lambda v: round(v, 6)) AS data FROM j""")
def w8(spark, d):
    w = V.waveforms(spark, d)
    rn = F.row_number().over(W.partitionBy("label").orderBy("row_id"))
    days = w.select(F.col("label").alias("station"), F.col("row_id").alias("day"), F.col("x").alias("data"), (F.when(F.col("row_id") % 5 == 0, 1000).otherwise(0) + rn * 64).cast("double").alias("starttime"), F.lit(1.0).alias("sampling_rate"))
    c = K.carry_over_tail(days, 10)
    return c.select("station", "day", "previous_appended", "starttime", F.transform("data", lambda v: A.rounded(v)).alias("data"))


@query("w10_empirical_cdf", f"WITH {V.PICKS}, m AS (SELECT min(amplitude) lo, max(amplitude) hi, count(amplitude) n FROM picks), g AS (SELECT unnest(range(0, 50))::INT AS step), s AS (SELECT ceil(round((amplitude - lo) / ((hi - lo) / 49), 9))::INT AS step FROM picks, m), c AS (SELECT step, count(*) AS c FROM s GROUP BY 1) SELECT g.step, round(lo + g.step * ((hi - lo) / 49), 6) AS x, round(sum(coalesce(c, 0)) OVER (ORDER BY g.step) / n, 6) AS share FROM g LEFT JOIN c USING (step), m")
def w10(spark, d):
    return K.empirical_cdf(V.picks(spark, d), "amplitude", 50)


@query("w11_pick_ids", f"WITH {V.PICKS} SELECT pick_id, station, row_number() OVER (ORDER BY station, floor(arrival_time / 86400), arrival_time, pick_id) AS new_id FROM picks")
def w11(spark, d):
    p = V.picks(spark, d).withColumn("day", F.floor(F.col("arrival_time") / 86400))
    return K.pick_ids(p, ["station", "day"], ["arrival_time", "pick_id"]).select("pick_id", "station", "new_id")


_SOME = "p AS (SELECT pick_id, CASE WHEN station % 9 <> 0 THEN station END AS station, arrival_time, CASE WHEN pick_id % 11 <> 0 THEN floor(arrival_time / 86400)::BIGINT END AS day, phase FROM picks)"


def _some_picks(spark, d):
    p = V.picks(spark, d)
    return p.select("pick_id", F.when(F.col("station") % 9 != 0, F.col("station")).alias("station"), "arrival_time", F.when(F.col("pick_id") % 11 != 0, F.floor(F.col("arrival_time") / 86400)).alias("day"), "phase")


@query("w11_unknown_stations", f"WITH {V.PICKS}, {_SOME} SELECT pick_id, station, row_number() OVER (ORDER BY station NULLS FIRST, day NULLS FIRST, arrival_time, pick_id) AS new_id FROM p")
def w11_unknown(spark, d):
    """Picks of no station, and of no day, have ids as well."""
    return K.pick_ids(_some_picks(spark, d), ["station", "day"], ["arrival_time", "pick_id"]).select("pick_id", "station", "new_id")


@query("a20_unknown_stations", f"WITH {V.PICKS}, {_SOME} SELECT station, day, phase, count(*) AS n FROM p GROUP BY ROLLUP (station, day, phase) HAVING grouping(station) = 0")
def a20_unknown(spark, d):
    return K.pick_rate(_some_picks(spark, d))


_RATIO = "r AS (SELECT *, CASE WHEN row_number() OVER w >= 20 THEN round(avg(amplitude * amplitude) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) / avg(amplitude * amplitude) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 6) END AS ratio FROM picks WINDOW w AS (PARTITION BY station ORDER BY arrival_time, pick_id))"


@query("w12_sta_lta", f"WITH {V.PICKS}, {_RATIO} SELECT pick_id, station, ratio FROM r")
def w12(spark, d):
    p = V.picks(spark, d).withColumn("order", F.struct("arrival_time", "pick_id"))
    return K.sta_lta(p, 5, 20, ["station"], "order", "amplitude").select("pick_id", "station", "ratio")


@query("w12_trigger", f"WITH {V.PICKS}, {_RATIO}, x AS (SELECT *, sum(coalesce(ratio < 0.5, true)::INT) OVER (PARTITION BY station ORDER BY arrival_time, pick_id) AS run FROM r) SELECT station, min(CASE WHEN ratio >= 1.5 THEN arrival_time END) AS \"begin\", max(arrival_time) AS \"end\" FROM x WHERE ratio >= 0.5 GROUP BY station, run HAVING \"begin\" IS NOT NULL")
def w12_trigger(spark, d):
    p = V.picks(spark, d).withColumn("order", F.struct("arrival_time", "pick_id"))
    t = K.trigger_on_off(K.sta_lta(p, 5, 20, ["station"], "order", "amplitude"), 1.5, 0.5, ["station"], "order")
    return t.select("station", F.col("begin.arrival_time").alias("begin"), F.col("end.arrival_time").alias("end"))


@query("a20_pick_rate", f"WITH {V.PICKS} SELECT station, floor(arrival_time / 86400)::BIGINT AS day, phase, count(*) AS n FROM picks GROUP BY ROLLUP (station, day, phase) HAVING station IS NOT NULL")
def a20(spark, d):
    return K.pick_rate(V.picks(spark, d).withColumn("day", F.floor(F.col("arrival_time") / 86400)))


@query("o1_sorted_picks", f"WITH {V.PICKS} SELECT station, pick_id, arrival_time FROM picks")
def o1(spark, d):
    return V.picks(spark, d).select("station", "pick_id", "arrival_time").orderBy("arrival_time", "pick_id")


@query("o2_first_stations", "SELECT DISTINCT user_id AS station FROM events ORDER BY 1 LIMIT 25")
def o2(spark, d):
    return V.picks(spark, d).select("station").distinct().orderBy("station").limit(25)


@query("u3_append_mew", f"WITH {V.CATALOG} SELECT evid, quantity::BIGINT AS pick_index, CASE WHEN channel = 'O' THEN quantity::BIGINT + 40 END AS pick_index2 FROM catalog")
def u3(spark, d):
    c = V.catalog(spark, d).select("evid", F.col("quantity").cast("long").alias("pick_index"), "channel")
    two = c.filter("channel = 'O'").withColumn("pick_index2", F.col("pick_index") + 40)
    return P.append_pairs(c.filter("channel <> 'O'"), two).drop("channel")


@query("x27_flip_polarity", f"WITH {V.WAVEFORMS}, w AS (SELECT row_id, x, label % 3 - 1 AS first_motion, ('0x' || substr(md5('flip:' || row_id), 1, 8))::BIGINT / 4294967296.0 < 0.5 AS u FROM wf) SELECT row_id, first_motion <> 0 AND u AS was_flipped, CASE WHEN first_motion <> 0 AND u THEN -first_motion ELSE first_motion END AS first_motion, list_transform(x, lambda v: round(CASE WHEN first_motion <> 0 AND u THEN -v ELSE v END, 6) + 0) AS x FROM w")
def x27(spark, d):
    w = V.waveforms(spark, d).withColumn("first_motion", F.col("label") % 3 - 1)
    return S.flip_polarity(w, 0.5, "flip", "row_id").select("row_id", "was_flipped", "first_motion", F.transform("x", lambda v: F.round(v, 6) + 0.0).alias("x"))


@query("x25_absolute_times", f"WITH {V.EVALUATION} SELECT waveform_id, est_index, round(1000 + 0.01 * est_index, 6)::DOUBLE AS arrival_time FROM ev")
def x25(spark, d):
    return P.absolute_times(V.evaluation(spark, d).select("waveform_id", "est_index"), F.lit(1000.0), "est_index")


@query("x26_first_motion_decision", f"WITH {V.PROBS} SELECT row_id, round_even(20 + p[4] * 10, 0)::BIGINT AS idx, CASE WHEN p[1] >= p[2] AND p[1] >= p[3] THEN 1 WHEN p[2] >= p[3] THEN -1 ELSE 0 END AS polarity FROM pr")
def x26(spark, d):
    p = V.probabilities(spark, d)
    return p.select("row_id", A.first_motion_index(F.lit(20), F.element_at("p", 4) / 10).alias("idx"), A.polarity(F.slice("p", 1, 3)).alias("polarity"))
