"""Queries of the evaluation operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from quakeframe.operators import catalog as C
from quakeframe.operators import metrics as M
from quakeframe.plans import views as V
from quakeframe.plans.q_catalog import _STRATUM, _fence
from quakeframe.plans.q_joins import _PICKS2, _act_est
from quakeframe.plans.registry import query

TOLS = [0.1, 0.25, 0.5, 0.75, 0.9]
_T = "(SELECT unnest([0.1, 0.25, 0.5, 0.75, 0.9])::DOUBLE AS tolerance)"
def _rates(tp, tn, fp, fn, head=""):
    return f"""round(CASE WHEN {tp} + {tn} + {fp} + {fn} > 0 THEN ({tp} + {tn}) / ({tp} + {tn} + {fp} + {fn}) ELSE 0 END, 6) AS {head}accuracy,
  round(CASE WHEN {tp} + {fp} > 0 THEN {tp} / ({tp} + {fp}) ELSE 0 END, 6) AS {head}precision, round(CASE WHEN {tp} + {fn} > 0 THEN {tp} / ({tp} + {fn}) ELSE 0 END, 6) AS {head}recall"""


def _sums(p="p", t="t", tail="", where="true"):
    return ", ".join(f"sum(({where} AND {a} AND {b})::INT)::BIGINT AS {c}{tail}" for c, a, b in (("tp", p, t), ("tn", f"NOT {p}", f"NOT {t}"), ("fp", p, f"NOT {t}"), ("fn", f"NOT {p}", t)))


_BY_STRATUM = ", ".join(_sums(tail=f"_{s}", where=f"stratum = '{s}'") for s in M.STRATA)
_STRATUM_RATES = ", ".join(_rates(*[f"{c}_{s}" for c in ("tp", "tn", "fp", "fn")], f"{s}_") for s in M.STRATA)
_DM = f"""x AS (SELECT epoch, tolerance, {_STRATUM} AS stratum, proba > tolerance AS p, true_index >= 0 AS t, CASE WHEN proba > tolerance AND true_index >= 0 THEN true_index - est_index END AS r FROM ev, {_T}),
{_fence('epoch, tolerance', 'r', 'x', 1.5)},
m AS (SELECT epoch, tolerance, {_sums()}, {_BY_STRATUM}, round(coalesce(avg(r), 0), 6) residual_mean, round(coalesce(stddev_pop(r), 0), 6) residual_std FROM x GROUP BY ALL),
dm AS (SELECT epoch, tolerance, tp, tn, fp, fn, residual_mean, residual_std, tp + fn AS n_picks, tp AS n_picked, {_rates('tp', 'tn', 'fp', 'fn')},
  coalesce(fence_mean, 0) AS trimmed_residual_mean, coalesce(fence_std, 0) AS trimmed_residual_std, {_STRATUM_RATES}
  FROM m LEFT JOIN fs USING (epoch, tolerance))"""


def _evaluation(spark, d):
    return V.evaluation(spark, d).withColumn("stratum", C.event_stratum(F.col("event_type"), F.col("evid")))


@query("a1_detector_metrics", f"WITH {V.EVALUATION}, {_DM} SELECT * FROM dm")
def a1(spark, d):
    """Of all windows and of each stratum."""
    return M.detector_metrics(_evaluation(spark, d), TOLS, ["epoch"], "stratum")


@query("a2_metrics_by_stratum", f"""WITH {V.EVALUATION}, x AS (SELECT epoch, tolerance, {_STRATUM} AS stratum, proba > tolerance AS p, true_index >= 0 AS t FROM ev, {_T}), y AS (SELECT * FROM x UNION ALL SELECT epoch, tolerance, 'all', p, t FROM x),
g AS (SELECT epoch, tolerance, stratum, {_sums()}, count(*) AS n FROM y GROUP BY ALL) SELECT epoch, tolerance, stratum, tp + tn AS hits, n, {_rates('tp', 'tn', 'fp', 'fn')} FROM g""")
def a2(spark, d):
    return M.by_stratum(_evaluation(spark, d), TOLS)


_RES = "rs AS (SELECT epoch, event_type, CASE WHEN true_index >= 0 THEN true_index - est_index + CASE WHEN waveform_id % 17 = 0 THEN 60 ELSE 0 END END AS r FROM ev)"


def _residuals(spark, d):
    r = F.col("true_index") - F.col("est_index") + F.when(F.col("waveform_id") % 17 == 0, 60).otherwise(0)
    return V.evaluation(spark, d).select("epoch", "event_type", F.when(F.col("true_index") >= 0, r).alias("r"))


@query("a3_fence_stats", f"WITH {V.EVALUATION}, {_RES}, {_fence('epoch', 'r', 'rs', 1.5)} SELECT * FROM fs")
def a3(spark, d):
    return M.fence_stats(_residuals(spark, d), ["epoch"], "r", 1.5)


@query("a4_residual_summary", f"WITH {V.EVALUATION}, {_RES}, r2 AS (SELECT * FROM rs WHERE event_type IS NOT NULL), {_fence('epoch, event_type', 'r', 'r2', 3.0)}, p AS (SELECT epoch, event_type, round(avg(r), 6) AS mean, round(stddev_pop(r), 6) AS std FROM r2 GROUP BY ALL) SELECT * FROM p JOIN fs USING (epoch, event_type)")
def a4(spark, d):
    return M.residual_summary(_residuals(spark, d).filter("event_type IS NOT NULL"), ["epoch", "event_type"], "r", 3.0)


_MEW = f"""mwin AS (SELECT o_orderkey AS waveform_id, (1 + o_custkey % 2)::BIGINT AS epoch, CASE WHEN o_orderstatus = 'O' AND o_custkey % 3 = 0 THEN -1 ELSE o_custkey % 20 END AS act1, CASE WHEN o_orderstatus = 'F' THEN o_custkey % 20 + 20 END AS act2,
  CASE WHEN o_orderstatus = 'O' AND o_custkey % 3 = 0 THEN 'noise' WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'cbl' WHEN o_orderpriority = '5-LOW' THEN 'ceq' ELSE 'heq' END AS stratum FROM orders),
mest AS (SELECT l_orderkey AS waveform_id, l_quantity::BIGINT AS est, round(l_discount * 10, 4) AS proba FROM lineitem),
mw AS (SELECT *, row_number() OVER () AS rid FROM mwin), mt AS (SELECT * FROM mw, {_T}),
mp AS (SELECT rid, tolerance, est, act1, act2 FROM mt JOIN mest USING (waveform_id) WHERE proba > tolerance),
mn AS (SELECT rid, tolerance, count(*) AS n FROM mp GROUP BY ALL),
m1 AS (SELECT rid, tolerance, act1 - arg_min(est, (abs(act1 - est), est)) AS r1 FROM mp WHERE act1 >= 0 AND abs(act1 - est) < 6 GROUP BY rid, tolerance, act1),
m2 AS (SELECT rid, tolerance, act2 - arg_min(est, (abs(act2 - est), est)) AS r2 FROM mp WHERE act2 >= 0 AND abs(act2 - est) < 6 GROUP BY rid, tolerance, act2),
mf AS (SELECT mt.*, coalesce(n, 0) AS n, r1, r2, act1 >= 0 AS signal, act2 IS NOT NULL AS two FROM mt LEFT JOIN mn USING (rid, tolerance) LEFT JOIN m1 USING (rid, tolerance) LEFT JOIN m2 USING (rid, tolerance)),
mg AS (SELECT *, n - (r1 IS NOT NULL)::INT - (r2 IS NOT NULL)::INT AS spare, CASE WHEN signal THEN r1 IS NOT NULL ELSE n > 0 END AS hat FROM mf),
mk AS (SELECT epoch, tolerance, stratum, 'first' AS picks, signal AS t, hat AS p, spare, [r1] AS rs, signal::INT AS given, CASE WHEN signal AND n > 0 THEN 1 + two::INT ELSE 0 END AS anyp FROM mg
  UNION ALL SELECT epoch, tolerance, stratum, 'second', true, r2 IS NOT NULL, spare, [r2], 1, 0 FROM mg WHERE two
  UNION ALL SELECT epoch, tolerance, stratum, 'combined', signal, hat AND (r2 IS NOT NULL OR NOT two), spare, [r1, r2], signal::INT + two::INT, 0 FROM mg),
mr AS (SELECT epoch, tolerance, picks, unnest(rs) AS r FROM mk),
{_fence('epoch, tolerance, picks', 'r', 'mr', 1.5)},
ms AS (SELECT epoch, tolerance, picks, {_sums()}, {_BY_STRATUM}, sum(spare)::BIGINT AS spare, sum(given)::BIGINT AS n_picks, sum(len(list_filter(rs, lambda v: v IS NOT NULL)))::BIGINT AS found, sum(anyp)::BIGINT AS anyp FROM mk GROUP BY ALL),
mz AS (SELECT epoch, tolerance, picks, round(coalesce(avg(r), 0), 6) AS residual_mean, round(coalesce(stddev_pop(r), 0), 6) AS residual_std FROM mr GROUP BY ALL)"""
_FIRST_RATES = ", ".join(f"CASE WHEN picks = 'first' THEN {s}_{c} END AS {s}_{c}" for s in M.STRATA for c in ("accuracy", "precision", "recall"))


@query("a5_mew_metrics", f"""WITH {_MEW}, r AS (SELECT ms.*, {_STRATUM_RATES} FROM ms)
SELECT epoch, tolerance, picks, tp, tn, spare AS fp, fn, fp AS fp_notused, n_picks, CASE WHEN picks = 'first' THEN anyp ELSE found END AS n_picked, residual_mean, residual_std,
  coalesce(fence_mean, 0) AS trimmed_residual_mean, coalesce(fence_std, 0) AS trimmed_residual_std, {_rates('tp', 'tn', 'spare', 'fn')}, {_FIRST_RATES}
FROM r JOIN mz USING (epoch, tolerance, picks) LEFT JOIN fs USING (epoch, tolerance, picks)""")
def a5(spark, d):
    """Two-pick, one-pick and noise windows."""
    o, x = V.table(spark, d, "orders"), V.table(spark, d, "lineitem")
    noise = (F.col("o_orderstatus") == "O") & (F.col("o_custkey") % 3 == 0)
    k = F.col("o_custkey") % 20
    stratum = F.when(noise, "noise").when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "cbl").when(F.col("o_orderpriority") == "5-LOW", "ceq").otherwise("heq")
    epoch = (1 + F.col("o_custkey") % 2).cast("long")
    w = o.select(epoch.alias("epoch"), F.col("o_orderkey").alias("waveform_id"), F.when(noise, -1).otherwise(k).alias("act1"), F.when(F.col("o_orderstatus") == "F", k + 20).alias("act2"), stratum.alias("stratum"))
    est = x.select(F.col("l_orderkey").alias("waveform_id"), F.col("l_quantity").cast("long").alias("est"), F.round(F.col("l_discount") * 10, 4).alias("proba"))
    return M.mew_metrics(est.join(w.select("waveform_id", "epoch"), "waveform_id"), w, TOLS, 6, "stratum")


_JAC = f"""{_PICKS2}, a AS (SELECT *, row_number() OVER () AS rid FROM act, {_T}), e AS (SELECT * FROM est, {_T} WHERE proba > tolerance),
m0 AS (SELECT a.*, e.est, row_number() OVER (PARTITION BY rid ORDER BY abs(a.act - e.est), e.est) AS rk FROM a LEFT JOIN e ON a.waveform_id = e.waveform_id AND a.epoch = e.epoch AND a.tolerance = e.tolerance AND abs(a.act - e.est) < 5),
m AS (SELECT waveform_id, epoch, tolerance, count(*) AS n_act, count(est) AS matched FROM m0 WHERE rk = 1 GROUP BY ALL), n AS (SELECT waveform_id, epoch, tolerance, count(*) AS n_est FROM e GROUP BY ALL),
j0 AS (SELECT coalesce(m.waveform_id, n.waveform_id) AS waveform_id, coalesce(m.epoch, n.epoch) AS epoch, coalesce(m.tolerance, n.tolerance) AS tolerance, coalesce(n_est, 0) AS n_est, coalesce(n_act, 0) AS n_act, coalesce(matched, 0) AS matched FROM m FULL JOIN n USING (waveform_id, epoch, tolerance)),
j AS (SELECT *, round(CASE WHEN n_est + n_act - matched > 0 THEN matched / (n_est + n_act - matched) ELSE 1 END, 6) AS jaccard FROM j0)"""


@query("a6_pick_jaccard", f"WITH {_JAC} SELECT * FROM j")
def a6(spark, d):
    act, est = _act_est(spark, d)
    return M.pick_jaccard_at(est, act, TOLS, ["waveform_id", "epoch"], 5)


_SUMMARY = """g AS (SELECT {keys}, round(avg({v}), 6) AS js_mean, min({v}) AS js_min, max({v}) AS js_max FROM {t} GROUP BY ALL),
h AS (SELECT *, CASE WHEN js_min = js_max THEN js_min - 0.5 ELSE js_min END AS lo, CASE WHEN js_min = js_max THEN js_max + 0.5 ELSE js_max END AS hi FROM g),
b AS (SELECT h.*, len(list_filter(list_transform(range(1, 10), lambda k: lo + (hi - lo) / 10 * k), lambda e: e <= {v})) AS bin FROM {t} JOIN h USING ({keys}))
SELECT {keys}, js_mean, js_min, js_max, list_transform(range(0, 10), lambda k: len(list_filter(bins, lambda x: x = k))) AS js_dist FROM (SELECT {keys}, js_mean, js_min, js_max, list(bin) AS bins FROM b GROUP BY ALL)"""


@query("a6_jaccard_summary", f"WITH {_JAC}, {_SUMMARY.format(keys='epoch, tolerance', v='jaccard', t='j')}")
def a6_summary(spark, d):
    return M.jaccard_summary(a6(spark, d), ["epoch", "tolerance"])


_FM = """SELECT epoch, count(*) AS n, round(sum((true_fm = pred_fm)::INT) / count(*), 6) AS accuracy, sum((true_fm = 1 AND pred_fm = 1)::INT) uu, sum((true_fm = 1 AND pred_fm = -1)::INT) ud, sum((true_fm = -1 AND pred_fm = 1)::INT) du, sum((true_fm = -1 AND pred_fm = -1)::INT) dd FROM ev GROUP BY epoch"""


@query("a10_first_motion_metrics", f"WITH {V.EVALUATION}, g AS ({_FM}) SELECT epoch, n, accuracy, round((uu + dd) / (uu + ud + du + dd), 6) AS polar_accuracy, round(uu / (uu + du), 6) AS up_precision, round(uu / (uu + ud), 6) AS up_recall, round(dd / (dd + ud), 6) AS down_precision, round(dd / (dd + du), 6) AS down_recall FROM g")
def a10(spark, d):
    return M.first_motion_metrics(V.evaluation(spark, d), ["epoch"])


@query("a11_confusion", f"WITH {V.EVALUATION} SELECT true_fm, sum((pred_fm = 1)::INT)::BIGINT AS pred_1, sum((pred_fm = -1)::INT)::BIGINT AS pred_minus_1, sum((pred_fm = 0)::INT)::BIGINT AS pred_0 FROM ev GROUP BY true_fm")
def a11(spark, d):
    return M.confusion(V.evaluation(spark, d), "true_fm", "pred_fm", [1, -1, 0])


@query("a12_convergence", f"WITH {V.EVALUATION}, {_DM} SELECT epoch, round(avg(accuracy), 6) AS accuracy_mean, round(avg(recall), 6) AS recall_mean, round(stddev_pop(accuracy), 6) AS accuracy_std, round(stddev_pop(recall), 6) AS recall_std FROM dm GROUP BY epoch")
def a12(spark, d):
    return M.convergence(a1(spark, d), ["accuracy", "recall"])


@query("a12_one_tolerance", f"WITH {V.EVALUATION}, {_DM} SELECT epoch, round(avg(precision), 6) AS precision_mean, round(stddev_pop(precision), 6) AS precision_std FROM dm WHERE abs(tolerance - 0.5) < 1e-4 GROUP BY epoch")
def a12_one(spark, d):
    return M.convergence(a1(spark, d), ["precision"], 0.5)


@query("a13_residual_histogram", f"WITH {V.EVALUATION}, {_RES} SELECT event_type, floor((r + 10) / 4)::INT - CASE WHEN r = 10 THEN 1 ELSE 0 END AS bin, count(*) AS n FROM rs WHERE event_type IS NOT NULL AND r BETWEEN -10 AND 10 GROUP BY ALL")
def a13(spark, d):
    r = _residuals(spark, d).filter("event_type IS NOT NULL").withColumn("r", F.col("r").cast("double"))
    return C.histogram(r, "r", [-10.0, -6.0, -2.0, 2.0, 6.0, 10.0], ["event_type"])


@query("a14_histogram2d", f"WITH {V.EVENTS}, b AS (SELECT CASE WHEN magnitude < 1 THEN 0 WHEN magnitude < 3 THEN 1 ELSE 2 END AS xbin, CASE WHEN event_lat < 38 THEN 0 WHEN event_lat < 41 THEN 1 ELSE 2 END AS ybin FROM evt WHERE magnitude BETWEEN 0 AND 5 AND event_lat BETWEEN 36 AND 43) SELECT xbin::INT AS xbin, ybin::INT AS ybin, count(*) AS n FROM b GROUP BY ALL")
def a14(spark, d):
    return M.histogram2d(V.events(spark, d), "magnitude", "event_lat", [0.0, 1.0, 3.0, 5.0], [36.0, 38.0, 41.0, 43.0])


@query("a19_boxcar_widths_by_class", "SELECT pick_quality, list(DISTINCT w ORDER BY w) AS widths, max(w) AS max_width FROM (SELECT CASE WHEN l_tax >= 0.06 THEN 1.0 WHEN l_tax >= 0.03 THEN 0.75 ELSE 0.5 END::DOUBLE AS pick_quality, CASE WHEN l_tax >= 0.06 THEN 21 WHEN l_tax >= 0.03 THEN 31 ELSE 51 END - greatest(0, CASE WHEN l_tax >= 0.06 THEN 10 WHEN l_tax >= 0.03 THEN 15 ELSE 25 END - l_quantity::INT) AS w FROM lineitem) GROUP BY 1")
def a19(spark, d):
    from quakeframe.functions import arrays as A

    c = V.catalog(spark, d)
    y = A.boxcar(100, F.col("quantity").cast("int"), A.boxcar_width(F.col("pick_quality")))
    w = c.select("pick_quality", F.size(F.filter(y, lambda v: v > 0)).alias("w"))
    return w.groupBy("pick_quality").agg(F.sort_array(F.collect_set("w")).alias("widths"), F.max("w").alias("max_width"))


@query("o3_precision_recall_curve", f"WITH {V.EVALUATION}, {_DM} SELECT tolerance, precision, recall FROM dm WHERE epoch = 3")
def o3(spark, d):
    return M.precision_recall_curve(a1(spark, d), 3)


_UN = f"""{V.UNKNOWNS}, x AS (SELECT epoch, tolerance, {_STRATUM.replace('ev.', 'un.')} AS stratum, coalesce(proba > tolerance AND NOT isnan(proba), false) AS p, coalesce(true_index >= 0, false) AS t,
  CASE WHEN coalesce(proba > tolerance AND NOT isnan(proba), false) AND true_index >= 0 THEN true_index - est_index END AS r FROM un, {_T})"""


@query("a1_unknown_values", f"""WITH {_UN}, q AS (SELECT epoch, tolerance, quantile_cont(r, 0.25) AS q1, quantile_cont(r, 0.75) AS q3 FROM x WHERE r IS NOT NULL GROUP BY ALL),
fs AS (SELECT s.epoch, s.tolerance, round(avg(r), 6) AS fm, round(stddev_pop(r), 6) AS fd FROM x s JOIN q ON s.epoch IS NOT DISTINCT FROM q.epoch AND s.tolerance = q.tolerance WHERE r > q1 - 1.5 * (q3 - q1) AND r < q3 + 1.5 * (q3 - q1) GROUP BY ALL),
m AS (SELECT epoch, tolerance, {_sums()}, round(coalesce(avg(r), 0), 6) residual_mean, round(coalesce(stddev_pop(r), 0), 6) residual_std FROM x GROUP BY ALL)
SELECT m.epoch, m.tolerance, tp, tn, fp, fn, residual_mean, residual_std, tp + fn AS n_picks, tp AS n_picked, {_rates('tp', 'tn', 'fp', 'fn')}, coalesce(fm, 0) AS trimmed_residual_mean, coalesce(fd, 0) AS trimmed_residual_std
FROM m LEFT JOIN fs ON m.epoch IS NOT DISTINCT FROM fs.epoch AND m.tolerance = fs.tolerance""")
def a1_unknown(spark, d):
    """Epochs of null are one of their own; what is unknown is neither predicted nor a pick."""
    return M.detector_metrics(V.unknowns(spark, d), TOLS, ["epoch"])


@query("a2_unknown_values", f"""WITH {_UN}, y AS (SELECT epoch, tolerance, stratum, p, t FROM x UNION ALL SELECT epoch, tolerance, 'all', p, t FROM x),
g AS (SELECT epoch, tolerance, stratum, {_sums()}, count(*) AS n FROM y GROUP BY ALL) SELECT epoch, tolerance, stratum, tp + tn AS hits, n, {_rates('tp', 'tn', 'fp', 'fn')} FROM g""")
def a2_unknown(spark, d):
    return M.by_stratum(V.unknowns(spark, d).withColumn("stratum", C.event_stratum(F.col("event_type"), F.col("evid"))), TOLS)


@query("a3_unknown_values", f"""WITH {V.UNKNOWNS}, s AS (SELECT epoch, 1e9 + true_index - est_index AS r FROM un), q AS (SELECT epoch, quantile_cont(r, 0.25) AS q1, quantile_cont(r, 0.75) AS q3 FROM s WHERE r IS NOT NULL GROUP BY ALL),
v AS (SELECT s.epoch, CASE WHEN r > q1 - 1.5 * (q3 - q1) AND r < q3 + 1.5 * (q3 - q1) THEN r - 1e9 END AS v FROM s JOIN q ON s.epoch IS NOT DISTINCT FROM q.epoch WHERE r IS NOT NULL)
SELECT epoch, count(v) AS n_inside, round(1e9 + avg(v), 5) AS fence_mean, round(stddev_pop(v), 5) AS fence_std FROM v GROUP BY ALL""")
def a3_unknown(spark, d):
    """Residuals far from 0, some unknown, of known and unknown epochs."""
    r = V.unknowns(spark, d).select("epoch", (1e9 + F.col("true_index") - F.col("est_index")).alias("r"))
    f = M.fence_stats(r, ["epoch"], "r", 1.5)
    return f.select("epoch", "n_inside", F.round("fence_mean", 5).alias("fence_mean"), F.round("fence_std", 5).alias("fence_std"))
