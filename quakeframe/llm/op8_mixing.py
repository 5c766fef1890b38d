"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame expressions only.

Every document draws an exponential key, divided by its quality weight. A source's target
is met by complete epochs first; what is left of it is met by its documents in ascending
key order up to the token budget (whole documents; the last one goes in if that comes
nearer to the budget).

No source is ever sorted in one task: its keys fall into about sqrt(rows) ranges, the
sums of the ranges tell in which one the budget ends, and only that range is sorted. The
ranges follow the distribution of the source's own keys, a mixture of exponential ones
whose shares are its counts of documents by weight, so they are even for any weights.

Defined results: a null or wordless text has size 0, and 0 words are taken of it; a null
source is a source of its own and comes last; ids may be null or repeat, since a row draws
by its id, its text and its number among the rows that agree in both (which of those has
which number tells nothing, so reruns take as many of them); an empty table gives no rows.
`mix` carries columns of any name; what `keyed` gets may have none that starts with
`_mix_`, as its own ones do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quakeframe.llm import common

SEED = "mix-1"
#: Weights by rank of the source, repeating; and the most epochs of a source.
WEIGHTS, MAX_EPOCHS = (1, 2, 3), 3
#: The least weight of a document, and classes of weights from there to 1 that are counted for the ranges.
LEAST, CLASSES = 0.25, 15
#: What a document's quality weight counts: letters of any script, with their marks.
LETTERS = "[\\p{L}\\p{M}]+"


def quality_weight(text: Column) -> Column:
    """Share of letters in the text, from LEAST to 1: prose of any script counts more than tables, codes and markup."""
    n = F.length(text)
    return F.when(n > 0, F.greatest(F.lit(LEAST), F.round((n - F.length(F.regexp_replace(text, LETTERS, ""))) / n, 4))).otherwise(F.lit(LEAST))


def exponential_key(doc_id: Column, digest: Column, nth: Column, weight: Column, seed: str = SEED) -> Column:
    """-ln(u) / weight, with u from the md5 of seed, id, text and number: the same on every run and every engine."""
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), doc_id.cast("string"), digest, nth.cast("string"))), 1, 8), 16, 10).cast("bigint")
    return -F.log((h + 0.5) / F.lit(4294967296.0)) / weight


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The documents with _mix_source, _mix_id, _mix_digest (of the text), _mix_nth, _mix_size, _mix_class (of its weight) and _mix_key."""
    if any(c.startswith("_mix_") for c in docs.columns):
        raise ValueError("columns that start with _mix_ are those of the mix")
    body = common.text_of(docs, text)
    df = numbered(docs.withColumns({"_mix_source": docs[source].cast("string"), "_mix_id": docs[doc_id], "_mix_digest": F.md5(body)}))
    df = df.withColumns({"_mix_size": common.word_count(common.text_of(df, text)), "_mix_weight": quality_weight(common.text_of(df, text))})
    df = df.withColumn("_mix_class", F.floor((F.col("_mix_weight") - LEAST) / (1 - LEAST) * CLASSES).cast("int"))
    return df.withColumn("_mix_key", exponential_key(F.col("_mix_id"), F.col("_mix_digest"), F.col("_mix_nth"), F.col("_mix_weight"))).drop("_mix_weight")


def numbered(df: DataFrame) -> DataFrame:
    """`df` with _mix_nth, from 1 among the rows of one id and text.

    Only where some agree in both are rows numbered: within a part of the input, after the counts of the parts before it,
    so copies of one row that make up a third of the table lie in as many windows as the table has parts.
    """
    own = ["_mix_id", "_mix_digest"]
    repeated = common.written(df.groupBy(*own).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").toDF("_i", "_t", "_n"), "op8-repeated")
    if repeated.isEmpty():
        common.forget(repeated)
        return df.withColumn("_mix_nth", F.lit(1).cast("long"))
    rows = common.written(df.withColumn("_mix_part", F.spark_partition_id()), "op8-rows")
    same = lambda d, r: d["_mix_id"].eqNullSafe(r["_i"]) & (d["_mix_digest"] == r["_t"])
    alone = rows.join(repeated, same(rows, repeated), "left_anti").withColumn("_mix_nth", F.lit(1).cast("long"))
    some = rows.join(repeated, same(rows, repeated), "left_semi")
    parts = some.groupBy(*own, "_mix_part").agg(F.count(F.lit(1)).alias("_n"))
    parts = parts.withColumn("_before", F.sum("_n").over(W.partitionBy(*own).orderBy("_mix_part")) - F.col("_n")).drop("_n").toDF("_i", "_t", "_p", "_before")
    some = some.withColumn("_mix_nth", F.row_number().over(W.partitionBy(*own, "_mix_part").orderBy(F.lit(1))))
    some = some.join(parts, same(some, parts) & (some["_mix_part"] == parts["_p"])).withColumn("_mix_nth", F.col("_mix_nth") + F.col("_before")).drop("_i", "_t", "_p", "_before")
    return alone.unionByName(some).drop("_mix_part")


def targets(totals: DataFrame) -> DataFrame:
    """Per source (one row each: _mix_source, _mix_total, _mix_rows): its weighted share of all words, none above MAX_EPOCHS times its own.

    The shared level is the largest of the levels that result from capping the sources
    in the order of cap per weight, so no iteration is needed.
    """
    one = W.orderBy(F.col("_mix_source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(one) - 1) % len(WEIGHTS) + 1).cast("int"))
    df = totals.withColumn("_w", weight).withColumn("_cap", F.lit(MAX_EPOCHS) * F.col("_mix_total"))
    up = W.orderBy(F.col("_cap") / F.col("_w"), F.col("_mix_source").asc_nulls_last())
    before = F.coalesce(F.sum("_cap").over(up.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("_w").over(up.rowsBetween(0, W.unboundedFollowing))
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    df = df.withColumn("_all", F.sum("_mix_total").over(everything)).withColumn("_level", (F.col("_all") - before) / after)
    target = F.least(F.col("_cap").cast("double"), F.max("_level").over(everything) * F.col("_w"))
    df = df.withColumn("_mix_target", target)
    epochs = F.when(F.col("_mix_total") > 0, F.floor(F.col("_mix_target") / F.col("_mix_total"))).otherwise(F.lit(0)).cast("long")
    df = df.withColumn("_mix_epochs", epochs).withColumn("_mix_rest", F.col("_mix_target") - F.col("_mix_epochs") * F.col("_mix_total"))
    return df.select("_mix_source", "_mix_total", "_mix_rows", "_mix_target", "_mix_epochs", "_mix_rest", *[c for c in totals.columns if c.startswith("_mix_n")])


def _range() -> Column:
    """Number of the range that a key falls in: about sqrt(rows) of them per source, ascending with the key, each with about as many documents."""
    rows, key = F.col("_mix_rows"), F.col("_mix_key")
    n = F.ceil(F.sqrt(rows)).cast("long")
    under = F.lit(0.0)
    for k in range(CLASSES + 1):
        weight = LEAST + (1 - LEAST) * min(1.0, (k + 0.5) / CLASSES)
        under = under + F.col(f"_mix_n{k}") * (1 - F.exp(-key * weight))
    return F.least(n - 1, F.floor(under / rows * n))


KEYS = ["_mix_source", "_mix_id", "_mix_digest", "_mix_nth", "_mix_size", "_mix_class", "_mix_key"]


def _place() -> Column:
    """The order of a source's rows: by key, and where 32 bits of it agree by what it is made of."""
    return F.struct(F.col("_mix_key").alias("k"), F.col("_mix_id").alias("i"), F.col("_mix_digest").alias("t"), F.col("_mix_nth").alias("n"))


def plan(features: DataFrame) -> DataFrame:
    """One row per source: its target, its epochs and the place up to which one more copy is taken."""
    of_class = [F.count(F.when(F.col("_mix_class") == k, 1)).alias(f"_mix_n{k}") for k in range(CLASSES + 1)]
    totals = features.groupBy("_mix_source").agg(F.sum("_mix_size").alias("_mix_total"), F.count(F.lit(1)).alias("_mix_rows"), *of_class)
    goals = common.written(targets(totals), "op8-targets")
    f = _with(features, goals).withColumn("_range", _range())
    sums = f.groupBy("_mix_source", "_range").agg(F.sum("_mix_size").alias("_n"), F.max("_mix_rest").alias("_rest"))
    running = F.sum("_n").over(W.partitionBy("_mix_source").orderBy("_range"))
    sums = sums.withColumn("_before", running - F.col("_n"))
    last = sums.filter((F.col("_before") < F.col("_rest")) & (F.col("_n") > 0)).groupBy("_mix_source").agg(F.max(F.struct("_range", "_before")).alias("_last"))
    last = last.select(F.col("_mix_source").alias("_s"), F.col("_last._range").alias("_b"), F.col("_last._before").alias("_before"))
    inside = f.join(last, f["_mix_source"].eqNullSafe(last["_s"]) & (f["_range"] == last["_b"]))
    inside = inside.withColumn("_place", _place())
    to, n, rest = F.col("_to"), F.col("_mix_size"), F.col("_mix_rest")
    inside = inside.withColumn("_to", F.col("_before") + F.sum("_mix_size").over(W.partitionBy("_mix_source").orderBy("_place").rowsBetween(W.unboundedPreceding, W.currentRow)))
    nearer = (to - n < rest) & (to - rest < rest - (to - n))
    cut = inside.groupBy("_mix_source").agg(F.max("_range").alias("_mix_range"), F.max(F.when((to <= rest) | nearer, F.col("_place"))).alias("_mix_place"))
    out = common.written(_with(goals, cut), "op8-plan")
    common.forget(goals)
    return out


def _with(left: DataFrame, right: DataFrame) -> DataFrame:
    """`left` with the columns that `right` has for its source; sources of null match."""
    r = right.withColumnRenamed("_mix_source", "_s")
    return left.join(r, left["_mix_source"].eqNullSafe(r["_s"]), "left").drop("_s")


def copies(keyed_docs: DataFrame, cuts: DataFrame) -> DataFrame:
    """The documents with _mix_copies (0 to MAX_EPOCHS), _mix_target and _mix_total."""
    df = _with(keyed_docs, cuts).withColumn("_range", _range())
    one_more = F.coalesce((F.col("_range") < F.col("_mix_range")) | ((F.col("_range") == F.col("_mix_range")) & (_place() <= F.col("_mix_place"))), F.lit(False))
    return df.withColumn("_mix_copies", F.col("_mix_epochs") + one_more.cast("long")).drop("_range", "_mix_range", "_mix_place", "_mix_rows", "_mix_rest", "_mix_epochs", *[f"_mix_n{k}" for k in range(CLASSES + 1)])


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns of `docs`."""
    plain = common.Plain(docs)
    k = keyed(plain.df, plain.at(doc_id), plain.at(text), plain.at(source))
    keys = common.written(k.select(*KEYS), "op8-keys")
    cuts = plan(keys)
    common.forget(keys)
    df = copies(k, cuts).filter(F.col("_mix_copies") > 0)
    df = df.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_copies").cast("int"))))
    return plain.back(df)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each of all documents."""
    k = common.written(keyed(common.table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select(*KEYS), "op8-keys")
    df = copies(k, plan(k))
    return df.select(F.col("_mix_id").alias("doc_id"), F.col("_mix_size").alias("size"), F.col("_mix_total").alias("source_size"), F.col("_mix_target").alias("target"), (F.col("_mix_size") * F.col("_mix_copies")).alias("taken"))


SQL = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
    len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS size
  FROM documents),
e AS (SELECT *, md5(t) AS dg, row_number() OVER (PARTITION BY doc_id, t) AS nth FROM d),
k AS (
  SELECT doc_id, source, size, dg, nth,
    -ln((('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR || ':', '') || dg || ':' || nth), 1, 8))::BIGINT + 0.5) / 4294967296.0)
    / (CASE WHEN length(t) > 0 THEN greatest({LEAST}, round((length(t) - length(regexp_replace(t, '{LETTERS}', '', 'g'))) / length(t), 4)) ELSE {LEAST} END) AS key
  FROM e),
s AS (SELECT source, sum(size) AS total FROM k GROUP BY source),
w AS (SELECT *, [1, 2, 3][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM s),
l AS (
  SELECT *, 3 * total AS cap,
    (sum(total) OVER () - coalesce(sum(3 * total) OVER (ORDER BY 3 * total / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(w) OVER (ORDER BY 3 * total / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS lev
  FROM w),
g AS (SELECT source, total, least(cap::DOUBLE, max(lev) OVER () * w) AS target FROM l),
h AS (SELECT *, CASE WHEN total > 0 THEN floor(target / total) ELSE 0 END AS epochs FROM g),
r AS (
  SELECT k.doc_id, k.size, h.total, h.target, h.epochs, h.target - h.epochs * h.total AS rest,
    sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id NULLS FIRST, k.dg, k.nth) AS upto
  FROM k JOIN h ON k.source IS NOT DISTINCT FROM h.source)
SELECT doc_id, size::BIGINT AS size, total::BIGINT AS source_size, target,
  (size * (epochs + CASE WHEN upto <= rest OR (upto - size < rest AND upto - rest < rest - (upto - size)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r"""
