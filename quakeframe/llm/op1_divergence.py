"""Quality rules by distribution divergence, in DataFrame expressions only.

A document's histogram of character classes and its histogram of common words are held
against the references of its language by Jensen-Shannon distance. The references are
counts over the clean texts of that language: those that pass the base rules and have
small letters (or characters beyond ASCII) for half of the characters of their words at
least, each text once however many copies it has. A language that isn't in `COMMON` has the LISTED
commonest words of its own documents as its list, if it has MIN_DOCS of them. Documents
without a reference of their own (no language, or one of fewer documents) are held against
those of COMMON and of the NEAREST other languages with the most documents, and the smallest
distance of each kind counts; if none of these has a reference, against the counts over
their clean texts. Only those lists and references, a bounded number, are part of
the plan; the ones of all further languages are tables, joined by language, however many
there are.

Defined results: a null or empty text has no words and fails the base rules; texts under
the length guards pass the divergence test; where no clean text is there to refer to, all
pass it; a language with a list but without a clean text is judged by its characters only; repeated rows are judged alike; an empty table gives no rows. Columns of the
input that are not in `keep` are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quakeframe.llm import common

#: The function words whose frequencies make the common-word histogram of each language.
COMMON = {
    "en": "the of and to in a is that it for was with as be on not he by are at his this but from have they which or you one had were all there her an their we him been".split(),
    "de": "der die und den von zu das mit ist im auf für sich nicht ein eine als auch es an er werden aus hat dass sie nach bei um noch wie über einen so zum war haben nur oder aber".split(),
    "fr": "de la le et les des un que en du pas une est dans qui il pour ce sur se plus au par ne avec sont mais ou nous on cette ses aux être elle comme son tout fait même".split(),
    "es": "de la que el en y los un del se no las por con una su para es al lo como más pero sus le ha o este sí porque esta entre cuando muy sin sobre también me hasta hay".split(),
}
#: Character classes in the order of the histogram; what none of them takes is the class "other".
CLASSES = {
    "lower": "[a-z]+",
    "blank": common.BLANKS,
    "upper": "[A-Z]+",
    "digit": "[0-9]+",
    "stop": "[.,;:!?'\"()\\-]+",
    "symbol": "[#*$%&|<>]+",
    "wide": "[^\\x00-\\x7F]+",
}


#: A language that isn't in COMMON has a reference of its own from so many documents up, and so many words in its list.
MIN_DOCS, LISTED = 50, 40
#: Languages besides COMMON, those of the most documents, whose references texts without one are held against.
NEAREST = 28


@dataclass(frozen=True)
class Rules:
    """Guards and limits: distances are judged from `min_chars` characters and `min_words` words up.

    The words of a short text are a small sample, whose squared distance is larger by a term that falls with their number:
    the limit is the root of max_word_distance^2 + word_noise / n_words.
    """

    min_chars: int = 200
    min_words: int = 100
    max_char_distance: float = 0.25
    max_word_distance: float = 0.2
    word_noise: float = 3.0


def _repeat_words(df: DataFrame) -> DataFrame:
    """n_repeat_words: words inside 3-word windows found twice or more in the text.

    Windows are held as 64-bit hashes, sorted within the row. Only where some repeat are
    they looked up: a few by membership, many by sorting (hash, place) pairs.
    """
    w, h, s, d, p = (F.col(c) for c in ("_w", "_h", "_s", "_d", "_p"))
    n = F.size(w)
    window = lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2])
    df = df.withColumn("_h", F.when(n >= 3, F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), window)).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn("_s", F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(h)).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn("_d", F.array_distinct(F.filter(s, lambda x, i: (i > 0) & (x == F.try_element_at(s, i)))))
    few = F.filter(F.transform(h, lambda x, i: F.when(F.array_contains(d, x), i)), lambda i: i.isNotNull())
    pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    df = df.withColumn("_q", F.when(F.size(d) > 24, pairs))
    q = F.col("_q")
    same = lambda x, k: F.coalesce(F.try_element_at(q, k)["x"] == x["x"], F.lit(False))
    many = F.sort_array(F.transform(F.filter(q, lambda x, i: F.when(i > 0, same(x, i)).otherwise(False) | same(x, i + 2)), lambda x: x["i"]))
    df = df.withColumn("_p", F.when(F.size(d) == 0, F.array().cast("array<int>")).when(F.size(d) > 24, many).otherwise(few))
    covered = F.aggregate(p, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])
    return df.withColumn("n_repeat_words", covered.cast("long")).drop("_h", "_s", "_d", "_q", "_p")


def lists(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[dict[str, list[str]], DataFrame | None]:
    """The common words by language: COMMON and those of the NEAREST other languages; and a written table (_lang, _own) of all further ones of MIN_DOCS documents, if there are any.

    A language's words are counted where its texts lie, so no text is moved for them.
    """
    rows = docs.select(F.col(lang).cast("string").alias("_lang"), common.text_of(docs, text).alias("_t")).filter(~F.col("_lang").isin(list(COMMON)))
    many = common.written(rows.groupBy("_lang").agg(F.count(F.lit(1)).alias("_docs")).filter(F.col("_docs") >= MIN_DOCS), "op1-languages")
    if many.isEmpty():
        return dict(COMMON), None
    counts = rows.select("_lang", F.explode(common.words_of(F.col("_t"))).alias("_word")).groupBy("_lang", "_word").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.join(many.withColumnRenamed("_lang", "_l"), F.col("_lang") == F.col("_l"), "left_semi")
    top = counts.withColumn("_k", F.row_number().over(W.partitionBy("_lang").orderBy(F.desc("n"), "_word"))).filter(F.col("_k") <= LISTED)
    words = top.groupBy(F.col("_lang").alias("_l")).agg(F.transform(F.sort_array(F.collect_list(F.struct("_k", "_word"))), lambda x: x["_word"]).alias("_own"))
    all_ = common.written(many.join(words, F.col("_lang") == F.col("_l"), "left").select("_lang", "_docs", F.coalesce("_own", F.array().cast("array<string>")).alias("_own")), "op1-lists")
    first = all_.orderBy(F.desc("_docs"), "_lang").limit(NEAREST).collect()
    further = all_.filter(~F.col("_lang").isin([r["_lang"] for r in first])).select("_lang", "_own")
    return COMMON | {r["_lang"]: list(r["_own"]) for r in first}, None if further.isEmpty() else further


def _features(docs: DataFrame, text: str, lang: str, keep: tuple[str, ...], listing: dict[str, list[str]], further: DataFrame | None = None) -> DataFrame:
    """One row per document: the base counts, the counts by class and by common word of its language, or, without a list, by all words of `listing`; and _has, whether its list is one of `further`."""
    df = docs.select(*keep, F.col(lang).cast("string").alias("_lang"), common.text_of(docs, text).alias("_t"))
    none = F.lit(None).cast("array<string>")
    if further is None:
        df = df.withColumn("_own", none)
    else:  # only texts of languages that aren't listed are moved
        elsewhere = F.coalesce(~F.col("_lang").isin(list(listing)), F.lit(False))
        other = df.filter(elsewhere).join(further.withColumnRenamed("_lang", "_l"), F.col("_lang") == F.col("_l"), "left").drop("_l")
        df = df.filter(~elsewhere).withColumn("_own", none).unionByName(other)
    df = df.withColumn("_w", common.words_of(F.col("_t"))).withColumn("n_chars_all", F.length("_t").cast("long"))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    df = df.withColumn("_lines", lines).withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")).drop("_lines")
    df = _repeat_words(df)
    listed = _listed(listing)
    df = df.withColumn("n_words", F.size("_w").cast("long")).withColumn("_c", F.filter("_w", lambda x: x.isin(listed) | F.coalesce(F.array_contains("_own", x), F.lit(False)) if further is not None else x.isin(listed)))
    mine = F.lit(None).cast("array<string>")
    for name, ws in [("", listed), *listing.items()]:
        here = F.col("_lang") == name if name else F.coalesce(~F.col("_lang").isin(list(listing)), F.lit(True))
        mine = F.when(here, F.array(*map(F.lit, ws)).cast("array<string>")).otherwise(mine)
    df = df.withColumns({"_mine": F.coalesce("_own", mine), "_has": F.col("_own").isNotNull()})
    c = F.col("_c")
    df = df.withColumn("words_hist", F.transform("_mine", lambda x: (F.size(c) - F.size(F.array_remove(c, x))).cast("long")))
    rest, before = F.col("_t"), F.col("n_chars_all")
    counts = []
    for k, (name, pattern) in enumerate(CLASSES.items()):
        df = df.withColumn(f"_r{k}", F.regexp_replace(rest, pattern, ""))
        rest, after = F.col(f"_r{k}"), F.length(f"_r{k}")
        counts.append((before - after).cast("long"))
        before = after
    df = df.withColumn("chars_hist", F.array(*counts, before.cast("long")))
    blank, symbol = list(CLASSES).index("blank"), list(CLASSES).index("symbol")
    df = df.withColumn("word_chars", F.col("n_chars_all") - F.col("chars_hist")[blank]).withColumn("n_symbols", F.col("chars_hist")[symbol])
    df = df.withColumn("_hash", F.md5("_t"))
    return df.select(*keep, "_lang", "_has", "_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars_all", "chars_hist", "words_hist")


def _distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two distributions given as arrays of one length; null if either is."""
    term = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    terms = F.zip_with(p, q, lambda x, y: (term(x, (x + y) / 2) + term(y, (x + y) / 2)) / 2)
    total = F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)
    return F.sqrt(F.when(total < 0, F.lit(0.0)).otherwise(total))


def _listed(listing: dict[str, list[str]]) -> list[str]:
    return sorted({w for ws in listing.values() for w in ws})


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def clean(features: DataFrame) -> DataFrame:
    """The documents that pass the base rules and are written in small letters for the most part, each text of a language once."""
    names = list(CLASSES)
    small = F.col("chars_hist")[names.index("lower")] + F.col("chars_hist")[names.index("wide")]
    return features.filter(~base_failed() & (2 * small >= F.col("word_chars"))).select("_lang", "_hash", "chars_hist", "words_hist", "n_words", "n_chars_all").dropDuplicates(["_lang", "_hash"])


def references(features: DataFrame, most: int) -> DataFrame:
    """Per language the summed histograms of its clean texts, with lists of `most` words: c0, c1, ..., w0, w1, ..., nw and nc."""
    known = clean(features)
    sums = [F.sum(F.col("chars_hist")[i]).alias(f"c{i}") for i in range(len(CLASSES) + 1)] + [F.sum(F.get("words_hist", F.lit(i))).alias(f"w{i}") for i in range(most)]
    return known.groupBy("_lang").agg(*sums, F.sum("n_words").alias("nw"), F.sum("n_chars_all").alias("nc"))


def judge(docs: DataFrame, rules: Rules = Rules(), text: str = "text", lang: str = "lang", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns of every document with its counts, both distances, base_failed and kept."""
    listing, further = lists(docs, text, lang)
    listed = _listed(listing)
    features = common.written(_features(docs, text, lang, keep, listing, further), "op1-features")
    k = len(CLASSES) + 1
    # As many rows as there are languages in COMMON and NEAREST, so they can go into the expression itself.
    refs = {r["_lang"]: r for r in references(features.filter(F.col("_lang").isin(list(listing))), max(map(len, listing.values()))).collect()}
    share = lambda xs, n: F.transform(xs, lambda x: x.cast("double") / n)
    fixed = lambda xs, n: F.array(*[F.lit(x / n if n else None).cast("double") for x in xs]).cast("array<double>")
    with_rest = lambda xs: F.concat(xs, F.array(1 - F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)))
    chars = words = F.lit(None).cast("array<double>")
    every = []  # of each reference: places of its words among the listed ones, both distributions
    for name, r in refs.items():
        here = F.col("_lang") == name
        own_chars, own_words = fixed([r[f"c{i}"] for i in range(k)], r["nc"]), with_rest(fixed([r[f"w{i}"] for i in range(len(listing[name]))], r["nw"]))
        chars, words = F.when(here, own_chars).otherwise(chars), F.when(here, own_words).otherwise(words)
        if r["nc"] and r["nw"]:
            every.append(F.struct(F.array(*[F.lit(listed.index(w)) for w in listing[name]]).cast("array<int>").alias("at"), own_chars.alias("qc"), own_words.alias("qw")))
    if not every:
        pooled = clean(features.filter(~F.col("_has"))).agg(*[F.sum(F.col("chars_hist")[i]).alias(f"c{i}") for i in range(k)], *[F.sum(F.col("words_hist")[i]).alias(f"w{i}") for i in range(len(listed))], F.sum("n_words").alias("nw"), F.sum("n_chars_all").alias("nc")).first()
        if pooled["nc"] and pooled["nw"]:  # null without a clean text
            places = F.array(*map(F.lit, range(len(listed))))
            every.append(F.struct(places.alias("at"), fixed([pooled[f"c{i}"] for i in range(k)], pooled["nc"]).alias("qc"), with_rest(fixed([pooled[f"w{i}"] for i in range(len(listed))], pooled["nw"])).alias("qw")))
    df = features.withColumns({"_qc": chars, "_qw": words})
    none_of_its_own = F.coalesce(~F.col("_lang").isin(list(refs)), F.lit(True)) & F.col("_qc").isNull()
    if further is not None:
        own = references(features.filter("_has"), LISTED).withColumnRenamed("_lang", "_l")
        counts = lambda head, n: F.filter(F.array(*[F.col(f"{head}{i}") for i in range(n)]), lambda x: x.isNotNull())
        per = lambda xs, n: F.transform(xs, lambda x: F.try_divide(x.cast("double"), n))
        own = own.select("_l", per(counts("c", k), F.col("nc")).alias("_oc"), with_rest(per(counts("w", LISTED), F.col("nw"))).alias("_ow"))
        mine = df.filter("_has").join(own, F.col("_lang") == F.col("_l"), "left").withColumns({"_qc": F.col("_oc"), "_qw": F.col("_ow")}).drop("_l", "_oc", "_ow")
        df = df.filter(~F.col("_has")).unionByName(mine)
    df = df.withColumn("_pc", F.when(F.col("n_chars_all") >= rules.min_chars, share("chars_hist", F.col("n_chars_all"))))
    df = df.withColumn("_pw", F.when(F.col("n_words") >= rules.min_words, with_rest(share("words_hist", F.col("n_words")))))
    char, word = _distance(F.col("_pc"), F.col("_qc")), _distance(F.col("_pw"), F.col("_qw"))
    if every:
        n, h = F.col("n_words"), F.col("words_hist")
        nearest = lambda d: F.array_min(F.transform(F.array(*every), d))
        char = F.when(none_of_its_own, nearest(lambda r: _distance(F.col("_pc"), r["qc"]))).otherwise(char)
        part = lambda r: with_rest(F.transform(r["at"], lambda i: h[i].cast("double") / n))
        word = F.when(none_of_its_own, F.when(F.col("_pw").isNotNull() & (F.size(h) == len(listed)), nearest(lambda r: _distance(part(r), r["qw"])))).otherwise(word)
    df = df.withColumn("char_distance", F.round(char, 6)).withColumn("word_distance", F.round(word, 6))
    near = (F.coalesce("char_distance", F.lit(0.0)) <= rules.max_char_distance) & (F.coalesce(F.col("word_distance") * F.col("word_distance"), F.lit(0.0)) <= rules.max_word_distance**2 + rules.word_noise / F.greatest(F.col("n_words"), F.lit(1)))
    df = df.withColumn("base_failed", base_failed()).withColumn("kept", ~base_failed() & near)
    return df.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance")


def op1_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules over all of documents."""
    return judge(common.table(spark, sf_dir, "documents"), keep=("doc_id",))


def _sql() -> str:
    rules = Rules()
    langs = ", ".join(f"('{k}', [{', '.join(repr(w) for w in ws)}])" for k, ws in COMMON.items())
    steps, rest = [], "t"
    for name, pattern in CLASSES.items():
        quoted = pattern.replace("'", "''")
        steps.append(f"regexp_replace({rest}, '{quoted}', '', 'g') AS r_{name}")
        rest = f"r_{name}"
    names = ["t", *[f"r_{n}" for n in CLASSES]]
    hist = ", ".join([f"length({a}) - length({b})" for a, b in zip(names, names[1:], strict=False)] + [f"length({names[-1]})"])
    js = lambda p, q: f"sqrt(greatest(list_sum(list_transform(list_zip({p}, {q}), lambda z: CASE WHEN z[1] > 0 THEN z[1] * log2(z[1] / ((z[1] + z[2]) / 2)) / 2 ELSE 0 END + CASE WHEN z[2] > 0 THEN z[2] * log2(z[2] / ((z[1] + z[2]) / 2)) / 2 ELSE 0 END)), 0))"
    return f"""
WITH langs(lang, ws) AS (VALUES {langs}),
d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
s AS (SELECT *, {', '.join(steps)} FROM d),
f AS (
  SELECT doc_id, s.lang, ws, md5(t) AS th, length(t) AS nc, [{hist}] AS ch,
    list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS li
  FROM s LEFT JOIN langs ON s.lang = langs.lang),
g AS (SELECT *, len(w) AS nw, list_transform(ws, lambda x: len(list_filter(w, lambda y: y = x))) AS wh FROM f),
tri AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM g WHERE nw >= 3)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS c FROM tri) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (VALUES (0), (1), (2)) v(k) GROUP BY doc_id),
refs AS (
  SELECT lang, sum(nc) AS rc, sum(nw) AS rw,
    [{', '.join(f'sum(ch[{i + 1}])' for i in range(len(CLASSES) + 1))}] AS rch,
    [{', '.join(f'sum(wh[{i + 1}])' for i in range(LISTED))}] AS rwh
  FROM (SELECT DISTINCT lang, th, nc, nw, ch, wh FROM g LEFT JOIN cov USING (doc_id) WHERE ws IS NOT NULL AND NOT (nw < 50 OR 100 * coalesce(n, 0) > 50 * nw) AND 2 * (ch[1] + ch[7]) >= nc - ch[2]) GROUP BY lang),
p AS (
  SELECT g.*, coalesce(cov.n, 0) AS rp,
    list_transform(ch, lambda x: x::DOUBLE / nc) AS pc, list_transform(rch, lambda x: x::DOUBLE / rc) AS qc,
    list_transform(wh, lambda x: x::DOUBLE / nw) AS pw, list_transform(rwh, lambda x: x::DOUBLE / rw) AS qw
  FROM g LEFT JOIN cov USING (doc_id) LEFT JOIN refs ON g.lang = refs.lang),
j AS (
  SELECT *, CASE WHEN nc >= {rules.min_chars} AND qc IS NOT NULL THEN round({js('pc', 'qc')}, 6) END AS char_distance,
    CASE WHEN nw >= {rules.min_words} AND qw IS NOT NULL THEN round({js('list_append(pw, 1 - list_sum(pw))', 'list_append(qw, 1 - list_sum(qw))')}, 6) END AS word_distance,
    nw < 50 OR 100 * rp > 50 * nw AS base_failed
  FROM p)
SELECT doc_id, nw::BIGINT AS n_words, (nc - ch[2])::BIGINT AS word_chars, ch[6]::BIGINT AS n_symbols,
  (len(li) - len(list_distinct(li)))::BIGINT AS n_dup_lines, rp::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND coalesce(char_distance, 0) <= {rules.max_char_distance} AND coalesce(word_distance * word_distance, 0) <= {rules.max_word_distance**2!r}::DOUBLE + {rules.word_noise} / greatest(nw, 1) AS kept,
  char_distance, word_distance
FROM j"""


SQL = _sql()
