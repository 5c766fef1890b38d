"""Queries of the sample-array operators: windows, labels, picks, pairs, ensembles."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
from pyspark.sql import functions as F

from quakeframe.functions import arrays as A
from quakeframe.functions import kernels
from quakeframe.operators import picking as P
from quakeframe.plans import views as V
from quakeframe.plans.registry import query


def _r(c, n=6):
    return A.let(F.col(c) if isinstance(c, str) else c, lambda v: A.rounded(v, n))


def _rounded(x, n=6):
    return F.transform(x, lambda v: A.rounded(v, n))


@query("x1_extract_picks", f"""WITH {V.PROBS}, s AS (SELECT row_id, unnest(p) AS p, unnest(range(0, 64)) AS i FROM pr),
a AS (SELECT *, sum((p < 0.35)::INT) OVER (PARTITION BY row_id ORDER BY i) AS isl, sum((p < 0.4)::INT) OVER (PARTITION BY row_id ORDER BY i) AS run, max(CASE WHEN p < 0.35 THEN i END) OVER (PARTITION BY row_id) AS lastlow FROM s),
b AS (SELECT *, CASE WHEN coalesce(lastlow, -1) < i THEN 1000 + run ELSE isl END AS grp FROM a WHERE p >= 0.35),
st0 AS (SELECT row_id, grp, min(CASE WHEN p >= 0.4 THEN i END) AS s, max(CASE WHEN p >= 0.4 THEN i END) + 1 AS e1, max(i) + 1 AS e2 FROM b GROUP BY row_id, grp),
st AS (SELECT row_id, grp, s, CASE WHEN grp >= 1000 THEN e1 ELSE e2 END AS e FROM st0 WHERE s IS NOT NULL),
pk AS (SELECT st.row_id, s, e, arg_max(b.i, (b.p, -b.i)) AS idx, max(b.p) AS pr FROM st JOIN b ON b.row_id = st.row_id AND b.grp = st.grp AND b.i >= s AND b.i < e GROUP BY st.row_id, s, e)
SELECT row_id, idx::BIGINT AS idx, (e - s)::BIGINT AS width, round(pr, 6) AS probability FROM pk""")
def x1(spark, d):
    p = P.extract_picks(V.probabilities(spark, d), "p", 0.4, 0.05)
    return p.select("row_id", F.explode("picks").alias("k")).select("row_id", F.col("k.index").cast("long").alias("idx"), F.col("k.width").cast("long").alias("width"), _r("k.probability").alias("probability"))


def _chunked(df, x):
    """Twenty rows in a row are the chunks of one series."""
    return df.select(F.floor(F.col("row_id") / 20).alias("series"), (F.col("row_id") % 20).alias("chunk"), x)


@query("x1_extract_picks_chunks", f"""WITH RECURSIVE {V.PROBS}, q AS (SELECT row_id // 20 AS series, flatten(list(p ORDER BY row_id)) AS p FROM pr GROUP BY 1),
f AS (SELECT series, p, len(p) AS n, list_filter(range(0, len(p)), lambda i: p[i + 1] >= 0.3) AS high, list_filter(range(0, len(p)), lambda i: p[i + 1] < 0.3) AS under, list_filter(range(0, len(p)), lambda i: p[i + 1] < 0.25) AS low FROM q),
k AS (SELECT series, high[1] AS s, 0::BIGINT AS e FROM f WHERE len(high) > 0
  UNION ALL SELECT f.series, list_filter(f.high, lambda i: i >= g.e)[1], g.e FROM (SELECT k.series, coalesce(list_filter(f.low, lambda i: i >= k.s AND i < k.s + 100)[1], list_filter(f.under, lambda i: i > k.s)[1], f.n) AS e FROM k JOIN f USING (series) WHERE k.s IS NOT NULL) g JOIN f USING (series) WHERE g.e < f.n),
r AS (SELECT k.series, k.s, coalesce(list_filter(f.low, lambda i: i >= k.s AND i < k.s + 100)[1], list_filter(f.under, lambda i: i > k.s)[1], f.n) AS t, f.p FROM k JOIN f USING (series) WHERE k.s IS NOT NULL)
SELECT series::BIGINT AS series, (s + list_position(p[s + 1:t], list_max(p[s + 1:t])) - 1)::BIGINT AS idx, (t - s)::BIGINT AS width, round(list_max(p[s + 1:t]), 6) AS probability FROM r""")
def x1_chunks(spark, d):
    """Series of 1,280 samples in 20 chunks."""
    p = P.extract_picks_chunks(_chunked(V.probabilities(spark, d), "p"), ["series"], "chunk", "p", 0.3, 0.05)
    return p.select("series", F.explode("picks").alias("k")).select("series", F.col("k.index").cast("long").alias("idx"), F.col("k.width").cast("long").alias("width"), _r("k.probability").alias("probability"))


@query("x2_stack_components", f"""WITH {V.WAVEFORMS}, c AS (SELECT label AS station, row_id // 30 AS day, row_id % 3 AS k, x[1:64 - (row_id % 7 = 0)::INT - (row_id % 11 = 0)::INT] AS x, ['EH', 'HH'][row_id // 3 % 2 + 1] || substr('ENZ', (row_id % 3 + 1)::INT, 1) AS channel FROM wf),
o AS (SELECT station, day, k, arg_min(channel, (channel, x)) AS channel, arg_min(x, (channel, x)) AS x FROM c GROUP BY ALL),
p AS (SELECT e.station, e.day, z.channel AS channel, e.x AS e, n.x AS n, z.x AS z, greatest(len(e.x), len(n.x), len(z.x)) AS npts, least(len(e.x), len(n.x), len(z.x)) AS least FROM o e JOIN o n USING (station, day) JOIN o z USING (station, day) WHERE e.k = 0 AND n.k = 1 AND z.k = 2)
SELECT station, day::BIGINT AS day, channel[1:2] || '?' AS channel, npts::INT AS npts, list_transform(range(0, npts), lambda i: round(e[least(i + 1, len(e))], 6)) AS x_e, list_transform(range(0, npts), lambda i: round(n[least(i + 1, len(n))], 6)) AS x_n, list_transform(range(0, npts), lambda i: round(z[least(i + 1, len(z))], 6)) AS x_z FROM p WHERE npts - least <= 1""")
def x2(spark, d):
    """Samples of three components in one row, some of them a sample or two short."""
    k = (F.col("row_id") % 3 + 1).cast("int")
    part = lambda *names: F.element_at(F.array(*map(F.lit, names)), k)
    short = (F.col("row_id") % 7 == 0).cast("int") + (F.col("row_id") % 11 == 0).cast("int")
    code = F.element_at(F.array(F.lit("EH"), F.lit("HH")), (F.floor(F.col("row_id") / 3) % 2 + 1).cast("int"))
    w = V.waveforms(spark, d).select(F.col("label").alias("station"), F.floor(F.col("row_id") / 30).alias("day"), part("E", "N", "Z").alias("component"), F.concat(code, part("E", "N", "Z")).alias("channel"), F.slice("x", F.lit(1), 64 - short).alias("x"))
    s = P.stack_components(w, ["station", "day"])
    return s.select("station", "day", "channel", "npts", *[_rounded(F.col(f"x_{c}")).alias(f"x_{c}") for c in "enz"])


@query("x2_align_components", f"""WITH {V.WAVEFORMS}, c AS (SELECT row_id // 3 AS grp, row_id % 3 AS k, CASE WHEN row_id // 3 % 4 = 1 THEN x[1:40 + row_id % 3] WHEN row_id % 5 = 0 THEN x[1:50] WHEN row_id % 7 = 0 THEN x[4:64] ELSE x[1:64 - row_id % 2] END AS x,
  CASE WHEN row_id // 3 % 4 = 1 THEN 0 WHEN row_id % 5 = 0 THEN -2.3 WHEN row_id % 7 = 0 THEN 3 WHEN row_id % 11 = 0 THEN 0.7 ELSE 0 END::DOUBLE AS s, CASE WHEN row_id % 29 = 0 THEN 0.5 ELSE 1 END::DOUBLE AS dt FROM wf),
j AS (SELECT grp, e.x AS e, n.x AS n, z.x AS z, e.s AS es, n.s AS ns, z.s AS zs, len(e.x) = len(n.x) AND len(n.x) = len(z.x) AS same FROM c e JOIN c n USING (grp) JOIN c z USING (grp) WHERE e.k = 0 AND n.k = 1 AND z.k = 2 AND e.dt = n.dt AND n.dt = z.dt),
g AS (SELECT *, CASE WHEN same THEN len(e) WHEN len(z) IN (63, 64) THEN len(z) WHEN len(n) IN (63, 64) THEN len(n) WHEN len(e) IN (63, 64) THEN len(e) END AS npts,
  CASE WHEN same THEN es WHEN len(z) IN (63, 64) THEN zs WHEN len(n) IN (63, 64) THEN ns ELSE es END AS s FROM j),
o AS (SELECT *, CASE WHEN same THEN 0 ELSE round(s - es) END::INT AS de, CASE WHEN same THEN 0 ELSE round(s - ns) END::INT AS dn, CASE WHEN same THEN 0 ELSE round(s - zs) END::INT AS dz FROM g WHERE npts IS NOT NULL)
SELECT grp::BIGINT AS grp, s AS starttime, npts::INT AS npts, list_transform(range(0, npts), lambda i: CASE WHEN i + de BETWEEN 0 AND len(e) - 1 THEN round(e[i + de + 1], 6) ELSE 0 END) AS x_e,
  list_transform(range(0, npts), lambda i: CASE WHEN i + dn BETWEEN 0 AND len(n) - 1 THEN round(n[i + dn + 1], 6) ELSE 0 END) AS x_n, list_transform(range(0, npts), lambda i: CASE WHEN i + dz BETWEEN 0 AND len(z) - 1 THEN round(z[i + dz + 1], 6) ELSE 0 END) AS x_z FROM o""")
def x2_align(spark, d):
    """Components that are short, late, early or half a sample off, of which some have no complete one and some another interval."""
    r, third = F.col("row_id"), F.floor(F.col("row_id") / 3)
    lone = third % 4 == 1
    cut = F.when(lone, F.slice("x", F.lit(1), (40 + r % 3).cast("int"))).when(r % 5 == 0, F.slice("x", 1, 50)).when(r % 7 == 0, F.slice("x", 4, 61)).otherwise(F.slice("x", F.lit(1), (64 - r % 2).cast("int")))
    start = F.when(lone, 0.0).when(r % 5 == 0, -2.3).when(r % 7 == 0, 3.0).when(r % 11 == 0, 0.7).otherwise(0.0)
    w = V.waveforms(spark, d).select(third.alias("grp"), F.element_at(F.array(*map(F.lit, "ENZ")), (r % 3 + 1).cast("int")).alias("component"), cut.alias("x"), start.alias("starttime"), F.when(r % 29 == 0, 0.5).otherwise(1.0).alias("dt"))
    s = P.align_components(w, ["grp"], 63.0)
    return s.select("grp", "starttime", "npts", *[_rounded(F.col(f"x_{c}")).alias(f"x_{c}") for c in "enz"])


@query("x4_padding", "SELECT pick_id, total::BIGINT AS total, sp::BIGINT AS start_pad, ep::BIGINT AS end_pad FROM (SELECT event_id AS pick_id, 254 AS sp, CASE WHEN e0 < 254 THEN e0 + 500 ELSE e0 END AS ep, npts + 254 + CASE WHEN e0 < 254 THEN e0 + 500 ELSE e0 END AS total FROM (SELECT event_id, npts, 500 - ((npts + 254 - 1008) % 500 + 500) % 500 AS e0 FROM (SELECT event_id, 1000 + event_id % 7000 AS npts FROM events)))")
def x4(spark, d):
    n = 1000 + F.col("pick_id") % 7000
    pad = A.padding(n, 1008, 500, True)
    return V.picks(spark, d).select("pick_id", *[v.cast("long").alias(k) for k, v in pad.items()])


@query("x5_pad_edges", f"WITH {V.WAVEFORMS} SELECT row_id, list_transform(range(-5, 71), lambda i: round(x[greatest(0, least(63, i)) + 1], 6)) AS x FROM wf")
def x5(spark, d):
    return V.waveforms(spark, d).select("row_id", _rounded(A.pad_edges(F.col("x"), 5, 7)).alias("x"))


@query("x6_sliding_windows", f"WITH {V.WAVEFORMS}, w AS (SELECT row_id, x, unnest(range(0, 7)) AS window_id FROM wf) SELECT row_id, window_id::INT AS window_id, (window_id * 8)::INT AS start, list_transform(x[window_id * 8 + 1:window_id * 8 + 16], lambda v: round(v, 6)) AS x FROM w")
def x6(spark, d):
    w = P.sliding_windows(V.waveforms(spark, d).select("row_id", "x"), "x", 16, 8)
    return w.select("row_id", "window_id", "start", _rounded(F.col("x")).alias("x"))


@query("x7_normalise", f"WITH {V.WAVEFORMS} SELECT row_id, list_transform(x, lambda v: round(v / list_max(list_transform(x, lambda u: abs(u))), 6)) AS x FROM wf")
def x7(spark, d):
    return V.waveforms(spark, d).select("row_id", _rounded(A.normalise(F.col("x"))).alias("x"))


@query("x11_stitch", f"WITH {V.WAVEFORMS} SELECT row_id, list_transform(range(0, 64), lambda i: round(x[i + 1] * (least(6, greatest(0, (i - 4) // 8)) + 1), 6)) AS p FROM wf")
def x11(spark, d):
    """Each window is scaled by its number, so the result tells which window every sample is from."""
    w = P.sliding_windows(V.waveforms(spark, d).select("row_id", F.col("x").alias("p")), "p", 16, 8)
    w = w.withColumn("p", F.transform("p", lambda v: v * (F.col("window_id") + 1)))
    return P.stitch(w, ["row_id"], "p", 16, 8, 0, 64).select("row_id", _rounded(F.col("p")).alias("p"))


@query("x12_hour_chunks", f"WITH {V.WAVEFORMS}, c AS (SELECT row_id, x, unnest(range(0, 4)) AS chunk_id FROM wf) SELECT row_id, chunk_id::INT AS chunk_id, least(4, chunk_id * 20)::INT AS lead, len(x[greatest(1, chunk_id * 20 - 3): least(64, chunk_id * 20 + 24)])::INT AS n FROM c")
def x12(spark, d):
    c = P.hour_chunks(V.waveforms(spark, d).select("row_id", "x"), "x", 20, 4)
    return c.select("row_id", "chunk_id", "lead", F.size("x").alias("n"))


@query("x12_join_chunks", f"WITH {V.WAVEFORMS} SELECT row_id, list_transform(range(0, 64), lambda i: round(x[i + 1] * (i // 20 + 1), 6)) AS x FROM wf")
def x12_join(spark, d):
    """Each chunk is scaled by its number, buffers included."""
    c = P.hour_chunks(V.waveforms(spark, d).select("row_id", "x"), "x", 20, 4)
    c = c.withColumn("x", F.transform("x", lambda v: v * (F.col("chunk_id") + 1)))
    return P.join_chunks(c, ["row_id"], "x", 20).select("row_id", _rounded(F.col("x")).alias("x"))


@query("x13_cut_around_pick", f"WITH {V.WAVEFORMS}, c AS (SELECT row_id, x, (row_id * 7) % 64 - 8 AS first FROM wf) SELECT row_id, first >= 0 AND first + 16 <= 64 AS inside, CASE WHEN first >= 0 AND first + 16 <= 64 THEN list_transform(x[first + 1:first + 16], lambda v: round(v, 6)) END AS x FROM c")
def x13(spark, d):
    c = V.waveforms(spark, d).withColumn("c", A.cut(F.col("x"), ((F.col("row_id") * 7) % 64 - 8).cast("int"), 16))
    return c.select("row_id", F.col("c").isNotNull().alias("inside"), _rounded(F.col("c")).alias("x"))


_LAG = "('0x' || substr(md5('lag:' || row_id || ':' || copy), 1, 8))::BIGINT % 17 - 8"


@query("x15_random_shift", f"WITH {V.WAVEFORMS}, c AS (SELECT row_id, x, unnest([1, 2, 3]) AS copy FROM wf), l AS (SELECT *, {_LAG} AS lag FROM c) SELECT row_id, copy, lag::INT AS lag, (16 - lag)::INT AS pick_index, list_transform(x[16 + lag + 1:16 + lag + 32], lambda v: round(v, 6)) AS x FROM l")
def x15(spark, d):
    c = V.waveforms(spark, d).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).withColumn("lag", A.random_lag("lag", F.col("row_id"), F.col("copy"), 8))
    return c.select("row_id", "copy", "lag", (16 - F.col("lag")).alias("pick_index"), _rounded(A.cut(F.col("x"), 16 + F.col("lag"), 32)).alias("x"))


@query("x15_augmented", f"WITH {V.WAVEFORMS}, c AS (SELECT row_id, x, unnest([1, 2]) AS copy FROM wf), l AS (SELECT *, ('0x' || substr(md5('aug:' || row_id || ':' || copy), 1, 8))::BIGINT % 9 - 4 AS lag FROM c), w AS (SELECT *, x[16 + lag + 1:16 + lag + 32] AS w FROM l) SELECT row_id, copy, lag::INT AS lag, (16 - lag)::INT AS pick_index, list_transform(w, lambda v: round(v / list_max(list_transform(w, lambda u: abs(u))), 6)) AS x, list_transform(range(0, 16), lambda i: CASE WHEN i + 16 + lag + 8 BETWEEN 22 AND 42 THEN 1 ELSE 0 END) AS y FROM w")
def x15_augmented(spark, d):
    """Windows of 0.25 s at 100 Hz (26 samples, made up to 32), lags up to a quarter of half a window, masks of half the window."""
    w = V.waveforms(spark, d).withColumn("y", A.boxcar(64, F.lit(32), F.lit(21)))
    a = P.augmented(w, "x", "row_id", 32, 0.25, 0.01, 0.25, 2, "aug", "y", 0.5)
    return a.select("row_id", "copy", "lag", "pick_index", _rounded(F.col("x")).alias("x"), "y")


def _start_times(sign):
    return f"w AS (SELECT row_id, lag, x[16 {sign} lag + 1: 16 {sign} lag + 32] AS y FROM (SELECT row_id, x, ('0x' || substr(md5('lag:' || row_id || ':1'), 1, 8))::BIGINT % 17 - 8 AS lag FROM wf))"


_UNIT = "list_transform(y, lambda v: round(v / list_max(list_transform(y, lambda u: abs(u))), 6)) AS x"


@query("x16_random_start_times", f"WITH {V.WAVEFORMS}, {_start_times('-')} SELECT row_id, round(lag * 0.01, 6)::DOUBLE AS label, {_UNIT} FROM w")
def x16(spark, d):
    s = P.random_start_times(V.waveforms(spark, d), "x", "row_id", 32, 0.08, 0.01, "lag")
    return s.select("row_id", _r("label").alias("label"), _rounded(F.col("x")).alias("x"))


@query("x16_first_motion", f"WITH {V.WAVEFORMS}, {_start_times('+')} SELECT row_id, label, {_UNIT} FROM w JOIN wf USING (row_id)")
def x16_first_motion(spark, d):
    """Windows move, labels don't."""
    s = P.random_start_times(V.waveforms(spark, d), "x", "row_id", 32, 0.08, 0.01, "lag", first_motion=True)
    return s.select("row_id", "label", _rounded(F.col("x")).alias("x"))


@query("x17_boxcar_labels", "SELECT row_id, y, list_sum(y)::BIGINT AS ones FROM (SELECT vec_id AS row_id, list_transform(range(0, 64), lambda i: CASE WHEN c >= 0 AND i >= c - w // 2 AND i <= c + w // 2 THEN 1 ELSE 0 END) AS y FROM (SELECT vec_id, vec_id % 70 - 6 AS c, CASE WHEN label % 3 = 0 THEN 21 WHEN label % 3 = 1 THEN 31 ELSE 51 END AS w FROM embeddings))")
def x17(spark, d):
    q = F.element_at(F.array(F.lit(1.0), F.lit(0.75), F.lit(0.5)), (F.col("label") % 3 + 1).cast("int"))
    y = V.waveforms(spark, d).select("row_id", A.boxcar(64, F.col("row_id") % 70 - 6, A.boxcar_width(q)).alias("y"))
    return y.select("row_id", "y", F.aggregate("y", F.lit(0).cast("long"), lambda a, v: a + v).alias("ones"))


@query("x18_snr", f"WITH {V.WAVEFORMS}, c AS (SELECT row_id, x[26:36] AS s, x[15:25] AS n FROM wf) SELECT row_id, round(10 * log10(list_var_pop(s) / list_var_pop(n)), 4) AS snr FROM c")
def x18(spark, d):
    return V.waveforms(spark, d).select("row_id", _r(A.snr(F.col("x"), F.lit(30), 5), 4).alias("snr"))


@query("x19_scale_pair", f"""WITH {V.WAVEFORMS}, n AS (SELECT row_id, label, list_transform(x, lambda v: v / list_max(list_transform(x, lambda u: abs(u)))) AS x FROM wf), z AS (SELECT row_id, label, list_transform(x, lambda v: v - list_avg(x)) AS x FROM n)
SELECT a.row_id, round(CASE WHEN a.label < b.label THEN power(10, -abs(a.label - b.label) / 4.0) ELSE 1 END * a.x[1], 6) AS a0, round(CASE WHEN a.label < b.label THEN 1 ELSE power(10, -abs(a.label - b.label) / 4.0) END * b.x[1], 6) AS b0 FROM z a JOIN z b ON b.row_id = a.row_id + 1""")
def x19(spark, d):
    w = V.waveforms(spark, d)
    j = w.join(w.select((F.col("row_id") - 1).alias("row_id"), F.col("x").alias("x2"), F.col("label").alias("l2")), "row_id")
    a, b = A.scaled_pair(F.col("x"), F.col("x2"), F.col("label") / 4, F.col("l2") / 4)
    return j.select("row_id", _r(F.element_at(a, 1)).alias("a0"), _r(F.element_at(b, 1)).alias("b0"))


@query("x18_snr_transverse", f"""WITH {V.WAVEFORMS}, t AS (SELECT row_id, list_transform(range(1, 65), lambda i: x[65 - i] * cos(radians(row_id % 360)) - x[i] * sin(radians(row_id % 360))) AS t, row_id % 60 AS k FROM wf),
w AS (SELECT *, greatest(k - 5, 0) AS a, least(64, k + 6) AS b FROM t), v AS (SELECT *, greatest(a - (b - a), 0) AS c FROM w)
SELECT row_id, CASE WHEN a - c < 1 THEN -999 WHEN a - c > 1 THEN round(10 * log10(list_var_pop(t[a + 1:b]) / list_var_pop(t[c + 1:a])), 4) END AS snr FROM v""")
def x18_transverse(spark, d):
    """S picks at all places of the window; a single noise sample has no spread, and so no ratio."""
    w = V.waveforms(spark, d).withColumn("k", (F.col("row_id") % 60).cast("int"))
    return w.select("row_id", _r(A.snr_transverse(F.col("x"), F.reverse("x"), F.col("row_id") % 360, F.col("k"), 5), 4).alias("snr"))


@query("x20_mix_pair", f"""WITH {V.WAVEFORMS}, j AS (SELECT a.row_id, a.x AS x1, b.x AS x2, 10 + a.row_id % 5 AS f, 10 + a.row_id % 5 + 6 + a.row_id % 6 AS s, 6 + a.row_id % 6 AS shift FROM wf a JOIN wf b ON b.row_id = a.row_id + 1),
k AS (SELECT *, 1 AS win, 0 AS o, f AS pick_index, s AS pick_index2 FROM j UNION ALL SELECT *, 2, shift, s - shift, f - shift FROM j),
m AS (SELECT row_id, win, pick_index, pick_index2, list_transform(range(0, 30), lambda i: coalesce(x1[32 - f + i + o + 1], 0) + CASE WHEN i + o - s + 10 >= 0 THEN coalesce(x2[32 + i + o - s + 1], 0) * CASE WHEN i + o - s + 10 < 9 THEN 0.5 * (1 - cos(pi() * (i + o - s + 10) / 9)) ELSE 1 END ELSE 0 END) AS x,
  list_transform(range(0, 30), lambda i: CASE WHEN abs(i + o - f) <= 2 OR abs(i + o - s) <= 2 THEN 1 ELSE 0 END) AS y FROM k)
SELECT row_id, win::INT AS "window", pick_index::INT AS pick_index, pick_index2::INT AS pick_index2, list_transform(x, lambda v: round(v / list_max(list_transform(x, lambda u: abs(u))), 6)) AS x, y FROM m""")
def x20(spark, d):
    w = V.waveforms(spark, d)
    j = w.select("row_id", F.col("x").alias("x1")).join(w.select((F.col("row_id") - 1).alias("row_id"), F.col("x").alias("x2")), "row_id")
    first, shift = 10 + F.col("row_id") % 5, 6 + F.col("row_id") % 6
    m = P.mix_pairs(j.withColumns({"first": first, "second": first + shift, "shift": shift}), 30, 2)
    return m.select("row_id", "window", "pick_index", "pick_index2", _rounded(F.col("x")).alias("x"), "y")


@query("x21_segment_noise", f"WITH {V.WAVEFORMS}, c AS (SELECT row_id, x, unnest(range(0, 4)) AS part FROM wf) SELECT row_id, part::INT AS part, list_transform(x[part * 16 + 1: part * 16 + 16], lambda v: round(v, 6)) AS x FROM c")
def x21(spark, d):
    w = P.sliding_windows(V.waveforms(spark, d).select("row_id", "x"), "x", 16, 16)
    return w.select("row_id", F.col("window_id").alias("part"), _rounded(F.col("x")).alias("x"))


@query("x22_zero_bad_windows", f"WITH {V.PROBS} SELECT row_id, len(list_filter(p, lambda v: v = 0.9)) > 0 AS had, round(CASE WHEN len(list_filter(q, lambda v: v = 1.0)) > 5 THEN 0 ELSE list_sum(q) END, 4) AS total FROM (SELECT *, list_transform(p, lambda v: CASE WHEN v > 0.45 THEN 1.0 ELSE v END) AS q FROM pr)")
def x22(spark, d):
    q = V.probabilities(spark, d).withColumn("q", F.transform("p", lambda v: F.when(v > 0.45, 1.0).otherwise(v)))
    return q.select("row_id", F.exists("p", lambda v: v == 0.9).alias("had"), _r(F.aggregate(A.zeroed_if_bad(F.col("q")), F.lit(0.0), lambda a, v: a + v), 4).alias("total"))


@query("x23_ensemble_summary", f"""WITH {V.WAVEFORMS}, q AS (SELECT row_id, list_aggregate(x, 'quantile_cont', 0.25) AS q1, list_aggregate(x, 'quantile_cont', 0.75) AS q3, x FROM wf), f AS (SELECT row_id, list_filter(x, lambda v: v > q1 - 1.5 * (q3 - q1) AND v < q3 + 1.5 * (q3 - q1)) AS y FROM q)
SELECT row_id, round(list_median(y), 6) AS shift, round(list_stddev_pop(y), 6) AS std, len(y)::INT AS n_kept FROM f""")
def x23(spark, d):
    s = P.ensemble_summary(V.waveforms(spark, d).select("row_id", "x"), "x")
    return s.select("row_id", _r("shift").alias("shift"), _r("std").alias("std"), "n_kept")


@query("x24_calibrated_bounds", f"WITH {V.WAVEFORMS} SELECT row_id, round(list_median(x) - 1.959963984540054 * list_stddev_pop(x), 6) AS lb, round(list_median(x) + 1.959963984540054 * list_stddev_pop(x), 6) AS ub FROM wf")
def x24(spark, d):
    s = P.ensemble_summary(V.waveforms(spark, d).select("row_id", "x"), "x", 1e9)
    return s.select("row_id", _r(A.calibrated_bound(F.col("shift"), F.col("std"), 0.025)).alias("lb"), _r(A.calibrated_bound(F.col("shift"), F.col("std"), 0.975)).alias("ub"))


_NOMINAL = [k / 10 for k in range(1, 10)]
_CURVE = ", ".join(f"({q}, {NormalDist().inv_cdf(q)!r})" for q in _NOMINAL)


@query("x24_calibrated_quantiles", f"""WITH {V.WAVEFORMS}, s AS (SELECT list_median(x) AS y, list_stddev_pop(x) AS sd, x[64] AS t FROM wf), c(q, z) AS (VALUES {_CURVE}),
o AS (SELECT q, round(avg((t <= y + sd * z)::INT), 9) AS obs FROM s, c GROUP BY q), k AS (SELECT obs, avg(q) AS q FROM o GROUP BY obs), a AS (SELECT unnest([0.05, 0.25, 0.6, 0.95])::DOUBLE AS v),
b AS (SELECT v, (SELECT max(obs) FROM k WHERE obs <= v) AS l, (SELECT min(obs) FROM k WHERE obs >= v) AS h FROM a),
r AS (SELECT b.*, kl.q AS ql, kh.q AS qh FROM b LEFT JOIN k kl ON kl.obs = l LEFT JOIN k kh ON kh.obs = h)
SELECT v AS target, round(CASE WHEN l IS NULL THEN qh WHEN h IS NULL OR l = h THEN ql ELSE ql + (qh - ql) * (v - l) / (h - l) END, 6) AS quantile FROM r""")
def x24_quantiles(spark, d):
    """The calibration curve of all ensembles against the last sample, inverted."""
    s = P.ensemble_summary(V.waveforms(spark, d).withColumn("truth", F.element_at("x", 64)), "x", 1e9)
    under = [F.avg((F.col("truth") <= A.calibrated_bound(F.col("shift"), F.col("std"), q)).cast("int")) for q in _NOMINAL]
    curve = s.agg(F.array(*[F.struct(F.lit(q).alias("nominal"), F.round(u, 9).alias("observed")) for q, u in zip(_NOMINAL, under, strict=True)]).alias("c")).select(F.explode("c").alias("c")).select("c.*")
    knots = P.inverse_isotonic(curve, "observed", "nominal")
    return spark.createDataFrame([(v, round(P.calibrated_quantile(v, knots), 6)) for v in (0.05, 0.25, 0.6, 0.95)], "target double, quantile double")


@query("x29_strip_trailing_zeros", f"WITH {V.WAVEFORMS} SELECT row_id, list_transform(x[1:greatest(0, 64 - row_id % 65)], lambda v: round(CASE WHEN v = 0 THEN 1 ELSE v END, 6)) AS x FROM wf")
def x29(spark, d):
    w = V.waveforms(spark, d)
    z = F.transform("x", lambda v, i: F.when(i < 64 - F.col("row_id") % 65, F.when(v == 0, 1.0).otherwise(v)).otherwise(0.0))
    return w.select("row_id", _rounded(A.strip_trailing_zeros(z)).alias("x"))


@query("x30_pair_shift_plan", "SELECT o_orderkey AS evid, greatest(300, least(trunc(o_custkey / 6 * 100)::BIGINT + 50, 900)) AS min_sep, greatest(300, least(trunc(o_custkey / 6 * 100)::BIGINT + 50, 900)) + ('0x' || substr(md5('shift:' || o_orderkey), 1, 8))::BIGINT % 100 AS shift FROM orders")
def x30(spark, d):
    from quakeframe.operators.catalog import bucket32

    o = V.table(spark, d, "orders")
    sep = F.greatest(F.lit(300).cast("long"), F.least((F.col("o_custkey") / 6 * 100).cast("long") + 50, F.lit(900).cast("long")))
    return o.select(F.col("o_orderkey").alias("evid"), sep.alias("min_sep"), (sep + bucket32(F.concat_ws(":", F.lit("shift"), "o_orderkey")) % 100).alias("shift"))


def _shifts(key, distance, source, seed, length, low, high, min_second, req, first_margin, box, margin):
    """Draws by the rule: a range is empty, and so is all after it, unless its end lies over its start."""
    draw = lambda k, a, b: f"CASE WHEN {b} > {a} THEN {a} + ('0x' || substr(md5('{seed}:' || {key} || ':{k}'), 1, 13))::BIGINT % ({b} - {a}) END"
    return f"""s0 AS (SELECT *, greatest({req}, least(trunc({distance} / 6 * 100)::BIGINT + {margin}, {length - min_second - low - margin})) AS min_sep FROM {source}),
s1 AS (SELECT *, {draw(1, low, f'least({length - min_second} - min_sep, {high - first_margin})')} AS f FROM s0),
s2 AS (SELECT *, {draw(2, f'greatest({high + box}, f + min_sep)', length - min_second)} AS s FROM s1),
s3 AS (SELECT *, {draw(3, f'greatest(f - {low - box - 1}, s - {high - 1})', f'least(f - {box + 1}, s - {low})')} AS shift FROM (SELECT *, CASE WHEN f IS NOT NULL THEN s END AS s FROM (SELECT * EXCLUDE (s), s FROM s2)))"""


@query("x30_pair_shifts", f"WITH o AS (SELECT o_orderkey AS evid, CASE WHEN o_custkey % 17 <> 0 THEN o_custkey % 70 / 1.5 END::DOUBLE AS dist FROM orders WHERE true), {_shifts('evid', 'dist', 'o', 'shifts', 1008, 254, 754, 60, 150, 20, 10, 50)} SELECT evid, CASE WHEN dist IS NOT NULL THEN min_sep END::BIGINT AS min_sep, CASE WHEN dist IS NOT NULL THEN f END AS \"first\", CASE WHEN dist IS NOT NULL THEN s END AS second, CASE WHEN dist IS NOT NULL THEN shift END AS shift, dist IS NOT NULL AND shift IS NOT NULL AS feasible FROM s3")
def x30_shifts(spark, d):
    """Places of both events and the shift of the second window, at known and unknown distances."""
    k = F.col("o_custkey")
    o = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("evid"), F.when(k % 17 != 0, k % 70 / 1.5).alias("distance"))
    return P.pair_shifts(o, "evid", "distance", "shifts", 1008, (254, 754), 60, 150, 20, 10).drop("distance")


@query("x20_mix_drawn", f"""WITH {V.WAVEFORMS}, j0 AS (SELECT a.row_id, a.x AS x1, b.x AS x2, (a.row_id % 9 / 100.0)::DOUBLE AS dist FROM wf a JOIN wf b ON b.row_id = a.row_id + 1), {_shifts('row_id', 'dist', 'j0', 'mix', 30, 8, 14, 4, 4, 1, 2, 2)},
j AS (SELECT * FROM s3 WHERE shift IS NOT NULL),
k AS (SELECT *, 1 AS win, 0 AS o, f AS pick_index, s AS pick_index2 FROM j UNION ALL SELECT *, 2, shift, s - shift, f - shift FROM j),
m AS (SELECT row_id, win, pick_index, pick_index2, list_transform(range(0, 30), lambda i: coalesce(x1[32 - f + i + o + 1], 0) + CASE WHEN i + o - s + 10 >= 0 THEN coalesce(x2[32 + i + o - s + 1], 0) * CASE WHEN i + o - s + 10 < 9 THEN 0.5 * (1 - cos(pi() * (i + o - s + 10) / 9)) ELSE 1 END ELSE 0 END) AS x,
  list_transform(range(0, 30), lambda i: CASE WHEN abs(i + o - f) <= 2 OR abs(i + o - s) <= 2 THEN 1 ELSE 0 END) AS y FROM k)
SELECT row_id, win::INT AS "window", pick_index::INT AS pick_index, pick_index2::INT AS pick_index2, list_transform(x, lambda v: round(v / list_max(list_transform(x, lambda u: abs(u))), 6)) AS x, y FROM m""")
def x20_drawn(spark, d):
    """Pairs mixed where their draws put them."""
    w = V.waveforms(spark, d)
    j = w.select("row_id", F.col("x").alias("x1"), (F.col("row_id") % 9 / 100).alias("distance")).join(w.select((F.col("row_id") - 1).alias("row_id"), F.col("x").alias("x2")), "row_id")
    s = P.pair_shifts(j, "row_id", "distance", "mix", 30, (8, 14), 4, 4, 1, 2, margin=2).filter("feasible")
    return P.mix_pairs(s, 30, 2).select("row_id", "window", "pick_index", "pick_index2", _rounded(F.col("x")).alias("x"), "y")


@query("w9_single_pick", f"WITH {V.PROBS} SELECT row_id, (list_position(p, list_max(p)) - 1)::INT AS pick, (list_position(p[23:42], list_max(p[23:42])) - 1 + 22)::INT AS centre_pick FROM pr")
def w9(spark, d):
    p = V.probabilities(spark, d)
    return p.select("row_id", A.single_pick(F.col("p")).alias("pick"), A.single_pick(F.col("p"), 10).alias("centre_pick"))


@query("a7_proba_jaccard", f"""WITH {V.PROBS}, j AS (SELECT a.row_id, list_zip(a.p, b.p) AS z FROM pr a JOIN pr b ON b.row_id = a.row_id + 1), c AS (SELECT row_id, len(list_filter(z, lambda v: v[1] >= 0.4 AND v[2] >= 0.4)) AS i, len(list_filter(z, lambda v: v[1] >= 0.4 OR v[2] >= 0.4)) AS u FROM j)
SELECT row_id, round(CASE WHEN u = 0 THEN 1 ELSE i / u END, 6) AS jaccard FROM c""")
def a7(spark, d):
    p = V.probabilities(spark, d)
    j = p.join(p.select((F.col("row_id") - 1).alias("row_id"), F.col("p").alias("p2")), "row_id")
    return j.select("row_id", _r(A.jaccard(F.col("p"), F.col("p2"), 0.4)).alias("jaccard"))


@query("a17_component_noise", f"WITH {V.WAVEFORMS} SELECT label, round(avg(list_var_pop(x)), 6) AS noise FROM wf GROUP BY label")
def a17(spark, d):
    return P.component_noise(V.waveforms(spark, d), ["label"], ["x"]).select("label", _r("x_noise").alias("noise"))


@query("a18_sample_accuracy", f"WITH {V.PROBS}, s AS (SELECT row_id, label, unnest(p) AS p, unnest(range(0, 64)) AS i FROM pr) SELECT label, round(sum(((p >= 0.3)::INT = CASE WHEN i BETWEEN 20 AND 40 THEN 1 ELSE 0 END)::INT) / count(*), 6) AS accuracy FROM s GROUP BY label")
def a18(spark, d):
    p = V.probabilities(spark, d).withColumn("y", A.boxcar(64, F.lit(30), F.lit(21)))
    return p.groupBy("label").agg(_r(F.sum(A.equal_samples(F.col("y"), F.col("p"), 0.3)) / F.sum(F.size("p"))).alias("accuracy"))


@query("s7_quantised_probs", f"WITH {V.PROBS} SELECT row_id, list_transform(p, lambda v: trunc(v * 100)::INT) AS q FROM pr")
def s7(spark, d):
    return V.probabilities(spark, d).select("row_id", F.transform(A.quantised(F.col("p")), lambda v: v.cast("int")).alias("q"))


def _row_means():
    """A scorer in place of a network: a window over its largest absolute value."""
    return lambda x: np.abs(x) / np.maximum(np.abs(x).max(1, keepdims=True), 1e-12)


@query("f1_score_windows", f"WITH {V.WAVEFORMS} SELECT row_id, list_transform(x, lambda v: round(abs(v) / list_max(list_transform(x, lambda u: abs(u))), 6)) AS p FROM wf")
def f1(spark, d):
    return P.score_windows(V.waveforms(spark, d).select("row_id", "x"), "x", _row_means, 64).select("row_id", _rounded(F.col("p")).alias("p"))


def _means():
    return lambda x: x.mean(1)


@query("f3_score_picks", f"WITH {V.WAVEFORMS} SELECT row_id, [round(list_avg(x), 6), round(list_avg(x), 6), round(list_avg(x), 6)] AS preds FROM wf")
def f3(spark, d):
    return P.score_picks(V.waveforms(spark, d).select("row_id", "x"), "x", _means, 3).select("row_id", _rounded(F.col("preds")).alias("preds"))


@query("f4_evaluate_over_models", f"WITH {V.WAVEFORMS}, e AS (SELECT unnest([1, 2, 3]) AS epoch), j AS (SELECT epoch, row_id, list_transform(x, lambda v: abs(v) / epoch) AS p FROM wf, e) SELECT epoch, row_id, (32 - (list_position(p, list_max(p)) - 1))::INT AS residual, round(list_max(p), 6) AS probability FROM j")
def f4(spark, d):
    e = spark.createDataFrame([(1,), (2,), (3,)], "epoch int")
    w = V.waveforms(spark, d).select("row_id", "x", F.lit(32).alias("true_index"))
    r = P.evaluate_over_models(w, e, lambda x, epoch: F.transform(x, lambda v: F.abs(v) / epoch))
    return r.select("epoch", "row_id", "residual", _r("probability").alias("probability"))


def _impulse(n: int) -> list[float]:
    """The band-pass's answer to a single 1, by the recursion of its whole transfer function."""
    b, a = np.ones(1), np.ones(1)
    for s in kernels.bandpass_sections(1.0, 17.0, 100.0, 2):
        b, a = np.polymul(b, s[:3]), np.polymul(a, s[3:])
    h: list[float] = []
    for t in range(n):
        h.append((float(b[t]) if t < len(b) else 0.0) - sum(float(a[k]) * h[t - k] for k in range(1, min(t, len(a) - 1) + 1)))
    return h


@query("x8_detrend_taper_bandpass", f"""WITH {V.WAVEFORMS}, l AS (SELECT row_id, x, list_avg(x) AS m, list_sum(list_transform(range(0, 64), lambda i: x[i + 1] * (i - 31.5))) / 21840 AS s FROM wf),
z AS (SELECT row_id, list_transform(range(0, 64), lambda i: CASE WHEN i IN (0, 63) THEN 0 ELSE x[i + 1] - m - s * (i - 31.5) END) AS z, {_impulse(64)!r}::DOUBLE[] AS h FROM l)
SELECT row_id, list_transform(range(0, 64), lambda t: round(list_sum(list_transform(range(0, t + 1), lambda k: h[t - k + 1] * z[k + 1])), 6) + 0) AS x FROM z""")
def x8(spark, d):
    p = P.processed(V.waveforms(spark, d).select("row_id", "x"), "x")
    return p.select("row_id", F.transform("x", lambda v: F.round(v, 6) + 0.0).alias("x"))


@query("x8_processed_chunks", f"""WITH {V.WAVEFORMS}, c AS (SELECT row_id // 20 AS series, flatten(list(x ORDER BY row_id)) AS x FROM wf GROUP BY 1), n AS (SELECT series, x, len(x) AS n, list_avg(x) AS m FROM c),
l AS (SELECT *, list_sum(list_transform(range(0, n), lambda i: x[i + 1] * (i - (n - 1) / 2))) / (n * (n * n - 1) / 12) AS s, greatest(1, floor(n * 0.01))::BIGINT AS k FROM n),
z AS (SELECT series, n, list_transform(range(0, n), lambda i: (x[i + 1] - m - s * (i - (n - 1) / 2)) * CASE WHEN n - 1 - i < k THEN 0.5 * (1 - cos(pi() * (n - 1 - i) / k)) WHEN i < k THEN 0.5 * (1 - cos(pi() * i / k)) ELSE 1 END) AS z, {_impulse(800)!r}::DOUBLE[] AS h FROM l),
y AS (SELECT series, n, list_transform(range(0, n), lambda t: list_sum(list_transform(range(greatest(0, t - 799), t + 1), lambda k: h[t - k + 1] * z[k + 1]))) AS y FROM z)
SELECT series::BIGINT AS series, c::BIGINT AS chunk, list_transform(y[c * 64 + 1:c * 64 + 64], lambda v: round(v, 6) + 0) AS x FROM y, (SELECT unnest(range(0, 20)) AS c) WHERE c * 64 < n""")
def x8_chunks(spark, d):
    """Series of 1,280 samples in 20 chunks, filtered as if each were one array."""
    p = P.processed_chunks(_chunked(V.waveforms(spark, d), "x"), ["series"], "chunk", "x")
    return p.select("series", "chunk", F.transform("x", lambda v: F.round(v, 6) + 0.0).alias("x"))


_STA = "r AS (SELECT *, CASE WHEN i >= 29 AND row_number() OVER w = i + 1 THEN avg(x * x) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) / avg(x * x) OVER (w ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) END AS ratio FROM s WINDOW w AS (PARTITION BY id ORDER BY i))"


@query("w12_arrays", f"WITH {V.WAVEFORMS}, s AS (SELECT row_id AS id, unnest(x) AS x, unnest(range(0, 64)) AS i FROM wf), {_STA}, x AS (SELECT *, sum(coalesce(ratio < 0.7, true)::INT) OVER (PARTITION BY id ORDER BY i) AS run FROM r), t AS (SELECT id, run, min(CASE WHEN ratio >= 1.2 THEN i END) AS b, max(i) AS e FROM x WHERE ratio >= 0.7 GROUP BY ALL HAVING b IS NOT NULL), l AS (SELECT id, list(b ORDER BY b) AS begins, list(e ORDER BY b) AS ends FROM t GROUP BY id) SELECT id AS row_id, list(round(ratio, 6) ORDER BY i) AS ratio, coalesce(any_value(begins), []) AS begins, coalesce(any_value(ends), []) AS ends FROM r LEFT JOIN l USING (id) GROUP BY id")
def w12_arrays(spark, d):
    """Ratio and triggers of every trace, in its row."""
    r = P.trigger_arrays(P.sta_lta_arrays(V.waveforms(spark, d), "x", 5, 30), "ratio", 1.2, 0.7)
    part = lambda c: F.transform("triggers", lambda t: t[c].cast("long"))
    return r.select("row_id", _rounded(F.col("ratio")).alias("ratio"), part("begin").alias("begins"), part("end").alias("ends"))


@query("w12_chunks", f"WITH {V.WAVEFORMS}, s AS (SELECT row_id // 20 AS id, row_id % 20 AS chunk, row_id % 20 * 64 + j AS i, x[j + 1] AS x FROM wf, (SELECT unnest(range(0, 64)) AS j)), {_STA} SELECT id::BIGINT AS series, chunk, list(round(ratio, 6) ORDER BY i) AS ratio FROM r GROUP BY ALL")
def w12_chunks(spark, d):
    """The ratio goes on from chunk to chunk of a series."""
    return P.sta_lta_arrays(_chunked(V.waveforms(spark, d), "x"), "x", 5, 30, keys=["series"], order="chunk").select("series", "chunk", _rounded(F.col("ratio")).alias("ratio"))


@query("x9_fill_gaps", f"""WITH {V.WAVEFORMS}, s AS (SELECT label AS station, row_id // 576 AS day, row_id % 576 * 150 + i AS t, x[i + 1] AS v FROM wf, (SELECT unnest(range(0, 64)) AS i)),
g AS (SELECT station, day, unnest(range(0, 86400)) AS t FROM (SELECT DISTINCT station, day FROM s)),
a AS (SELECT g.*, s.t AS t1, s.v AS v1 FROM g ASOF LEFT JOIN s ON g.station = s.station AND g.day = s.day AND g.t >= s.t),
b AS (SELECT a.*, s.t AS t2, s.v AS v2 FROM a ASOF LEFT JOIN s ON a.station = s.station AND a.day = s.day AND a.t <= s.t)
SELECT station, day, list(round(CASE WHEN t1 IS NULL THEN v2 WHEN t2 IS NULL OR t1 = t2 THEN v1 ELSE v1 + (v2 - v1) * (t - t1) / (t2 - t1) END, 5) + 0 ORDER BY t) AS data FROM b GROUP BY station, day""")
def x9(spark, d):
    w = V.waveforms(spark, d)
    day = F.floor(F.col("row_id") / 576).cast("long")
    seg = w.select(F.col("label").alias("station"), day.alias("day"), (day * 86400 + F.col("row_id") % 576 * 150).cast("double").alias("starttime"), F.lit(1.0).alias("sampling_rate"), F.col("x").alias("data"))
    f = P.fill_gaps(seg, ["station"])
    return f.select("station", "day", F.transform("data", lambda v: F.round(v, 5) + 0.0).alias("data"))


@query("x10_resample", f"""WITH {V.WAVEFORMS}, k AS (SELECT j, n, (1 + 2 * sum(cos(2 * pi() * f * (j / 160 - n / 64)))) / 64 AS w FROM (SELECT unnest(range(0, 160)) AS j), (SELECT unnest(range(0, 64)) AS n), (SELECT unnest(range(1, 33)) AS f) GROUP BY ALL),
o AS (SELECT row_id, j, sum(x[n + 1] * w) AS v FROM wf, k GROUP BY ALL) SELECT row_id, count(*)::INT AS n, list(round(v, 4) + 0 ORDER BY j) AS x FROM o GROUP BY row_id""")
def x10(spark, d):
    return P.resample(V.waveforms(spark, d).select("row_id", "x"), "x", 40, 100).select("row_id", F.size("x").alias("n"), F.transform("x", lambda v: F.round(v, 4) + 0.0).alias("x"))


@query("x3_swap_channels", f"WITH {V.WAVEFORMS} SELECT row_id, round(x[2], 6) AS x_e, round(x[1], 6) AS x_n, round(x[3], 6) AS x_z FROM wf")
def x3(spark, d):
    w = V.waveforms(spark, d).select("row_id", *[_r(F.element_at("x", k + 1)).alias(c) for k, c in enumerate(("x_e", "x_n", "x_z"))])
    return P.reordered(w, ["x_n", "x_e", "x_z"], ["x_e", "x_n", "x_z"])


@query("x3_vertical_only", f"WITH {V.WAVEFORMS} SELECT row_id, round(x[3], 6) AS x_z FROM wf")
def x3_vertical(spark, d):
    w = V.waveforms(spark, d).select("row_id", *[_r(F.element_at("x", k + 1)).alias(c) for k, c in enumerate(("x_e", "x_n", "x_z"))])
    return P.vertical_only(w, {"e": "x_e", "n": "x_n", "z": "x_z"})


@query("x14_cut_pick_windows", f"""WITH {V.WAVEFORMS}, p AS (SELECT l_orderkey AS evid, l_linenumber::BIGINT AS line, l_suppkey AS row_id, l_quantity::BIGINT + l_linenumber * 2 AS idx FROM lineitem),
c AS (SELECT evid, line, p.row_id, idx, x, list_avg(x[greatest(idx - 15, 0) + 1:least(64, idx + 15)]) AS m FROM p JOIN wf ON wf.row_id = p.row_id),
w AS (SELECT evid, line, row_id, idx, list_transform(range(idx - 10, idx + 10), lambda i: CASE WHEN i >= 0 AND i < 64 THEN x[i + 1] - m ELSE 0 END) AS y FROM c)
SELECT evid, line, row_id, idx, len(y)::INT AS n, round(list_sum(y), 6) AS total, round(list_max(y), 6) AS peak FROM w""")
def x14(spark, d):
    """Windows less the mean of what is processed with them, margins included."""
    x = V.table(spark, d, "lineitem")
    p = x.select(F.col("l_orderkey").alias("evid"), F.col("l_linenumber").cast("long").alias("line"), F.col("l_suppkey").alias("row_id"), (F.col("l_quantity").cast("long") + F.col("l_linenumber") * 2).alias("index"))
    less_mean = lambda df: df.withColumn("x", A.let(A.mean(F.col("x")), lambda m: F.transform("x", lambda v: v - m)))
    w = P.cut_pick_windows(p, V.waveforms(spark, d).select("row_id", "x"), ["row_id"], 20, 5, less_mean)
    return w.select("evid", "line", "row_id", F.col("index").alias("idx"), F.size("x").alias("n"), _r(F.aggregate("x", F.lit(0.0), lambda a, v: a + v)).alias("total"), _r(F.array_max("x")).alias("peak"))


@query("f2_apply_processing", f"WITH {V.WAVEFORMS} SELECT row_id, list_transform(x, lambda v: round(v - list_avg(x), 6)) AS x FROM wf")
def f2(spark, d):
    return P.apply_processing(V.waveforms(spark, d).select("row_id", "x"), "x", lambda v: v - v.mean()).select("row_id", _rounded(F.col("x")).alias("x"))
