import random
from collections import defaultdict

from quakeframe.llm import op8_mixing as op


def table(df):
    k = op.keyed(df).select(*op.KEYS).cache()
    return op.copies(k, op.plan(k)).collect()


def target_of(sizes):
    """Weighted shares by the rule itself: cap, reshare what is over, until nothing is."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    out, free, left = {}, set(sizes), float(sum(sizes.values()))
    while free:
        w = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / w > 3 * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / w for s in free}
        for s in over:
            out[s] = 3 * sizes[s]
        left -= sum(3 * sizes[s] for s in over)
        free -= over
    return out


def corpus(seed):
    rng = random.Random(seed)
    rows = []
    for k in range(400):
        source = rng.choice(["a", "a", "a", "a", "B", "é", "c", None, "tiny"] if k % 20 else ["tiny"])
        n = rng.choice([0, 1, 5, 30, 200]) if source != "tiny" else 3
        rows.append((k, " ".join("word" if rng.random() < 0.8 else "#1" for _ in range(n)), "en", source))
    return rows


def test_targets_and_words(make):
    rows = corpus(1)
    sizes = defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += len(t.split())
    want = target_of(sizes)
    got = table(make(rows))
    taken, most = defaultdict(int), defaultdict(int)
    for r in got:
        assert abs(r._mix_target - want[r._mix_source]) < 1e-6 and r._mix_total == sizes[r._mix_source] and 0 <= r._mix_copies <= 3
        taken[r._mix_source] += r._mix_size * r._mix_copies
        most[r._mix_source] = max(most[r._mix_source], r._mix_size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= most[s] / 2 + 1e-6


def test_reruns_and_partitions_agree(make):
    rows = corpus(2)
    a, b = table(make(rows)), table(make(rows[::-1]).repartition(7))
    key = lambda r: (r._mix_id, r._mix_copies)
    assert sorted(map(key, a)) == sorted(map(key, b))


def test_lowest_keys_are_taken(make):
    got = [r for r in table(make([(k, "some plain words", "en", "abc"[k % 3]) for k in range(300)])) if r._mix_source == "a"]
    n = sorted(got, key=lambda r: r._mix_key)
    assert [r._mix_copies for r in n] == sorted([r._mix_copies for r in n], reverse=True) and 0 < sum(r._mix_copies for r in n) < 100


def test_odd_rows(make, odd):
    df = make(odd)
    mixed = op.mix(df)
    assert mixed.columns == df.columns
    assert len(table(df)) == len(odd) and mixed.count() > 0
    assert table(make([])) == [] and op.mix(make([])).collect() == []
    assert {r._mix_copies for r in table(make([(1, None, None, None), (2, "", None, "x")]))} == {0}


def test_ranges_are_even_for_any_weights(spark, make):
    """40,000 documents of one source, nine tenths of the least weight: no range holds many more than the others."""
    from pyspark.sql import functions as F

    text = F.when(F.col("id") % 10 == 0, F.lit("letters only here ")).otherwise(F.lit("# 12 % 345 |"))
    docs = spark.range(40000).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(9).alias("n_chars"))
    k = op.keyed(docs)
    counts = k.groupBy("_mix_source").agg(F.count(F.lit(1)).alias("_mix_rows"), *[F.count(F.when(F.col("_mix_class") == c, 1)).alias(f"_mix_n{c}") for c in range(op.CLASSES + 1)])
    own = op._with(k, counts).groupBy(op._range().alias("r")).count().collect()
    assert len(own) > 190 and max(r["count"] for r in own) < 2 * 40000 / 200


def test_prose_of_every_script_weighs_alike(spark):
    from pyspark.sql import functions as F

    rows = [("the river of gold runs",), ("река золота течёт вниз",), ("नदी का सोना बहता है",), ("黄金の川が流れている",), ("12 345 | # 67 $",), ("",)]
    w = [r[0] for r in spark.createDataFrame(rows, "t string").select(op.quality_weight(F.col("t"))).collect()]
    assert min(w[:4]) > 0.7 and w[4:] == [0.25, 0.25]


def test_names_of_the_mix_are_refused_where_they_would_be_overwritten(make):
    import pytest

    docs = make([(1, "a", "en", "s")])
    with pytest.raises(ValueError):
        op.keyed(docs.withColumnRenamed("n_chars", "_mix_size"))
    assert op.mix(docs.withColumnRenamed("n_chars", "_mix_size")).columns == ["doc_id", "text", "lang", "source", "_mix_size"]


def test_words_are_those_of_the_contract(spark):
    """U+0085, U+2028 and U+2029 are no blanks, at the end of a text as elsewhere."""
    import re

    from pyspark.sql import functions as F

    from quakeframe.llm import common

    texts = ["a \u0085", "a \u2028", "a\n\u0085", "a b \u2029", "\u0085", " a\n", "\n", "", "a\r\n", "\u2028 a \u2028\n"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", common.word_count(F.col("t")).alias("n")).collect()
    assert all(r.n == len(re.findall("[^\\x20\\x09-\\x0D]+", r.t)) for r in got)


def test_null_and_repeated_ids_meet_their_targets(make):
    """Ten rows of null id, ten of one id, forty repeated ones: each draws for itself."""
    ten = "one two three four five six seven eight nine ten"
    rows = [(None, f"{ten} {k}", "en", "a") for k in range(10)] + [(7, f"{ten} {k}", "en", "b") for k in range(10)] + [(8, ten, "en", "c")] * 40 + [(None, ten, "en", "d")] * 10
    a, b = table(make(rows)), table(make(rows).repartition(9))
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in a:
        sizes[r._mix_source] += r._mix_size
        taken[r._mix_source] += r._mix_size * r._mix_copies
    want = target_of(sizes)
    assert all(abs(taken[s] - want[s]) <= 6 for s in sizes)
    key = lambda r: (r._mix_id is None, r._mix_id, r._mix_digest, r._mix_nth, r._mix_copies)
    assert sorted(map(key, a)) == sorted(map(key, b))
    assert op.mix(make(rows)).count() == sum(r._mix_copies for r in a)
