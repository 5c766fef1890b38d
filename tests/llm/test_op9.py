import itertools
import random
import zlib

from quakeframe.llm import op9_reshard as op


def test_flow_is_cheapest_and_within_capacity():
    rng = random.Random(1)
    for _ in range(100):
        supply = [rng.randint(0, 50) for _ in range(rng.randint(1, 6))]
        capacity = op.capacities(sum(supply), rng.randint(1, 7))
        flow = op.min_cost_flow(supply, capacity)
        assert all(sum(v for (i, _), v in flow.items() if i == k) == n for k, n in enumerate(supply))
        assert all(sum(v for (_, j), v in flow.items() if j == k) <= n for k, n in enumerate(capacity))
        moved = sum(v for (i, j), v in flow.items() if i != j)
        assert moved == sum(max(0, n - (capacity[k] if k < len(capacity) else 0)) for k, n in enumerate(supply))


def place(spark, rows, make):
    from pyspark.sql import functions as F

    docs = make(rows)
    t = F.coalesce("text", F.lit(""))
    r = docs.select("doc_id", (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("c"), op.hashed_shard(F.col("doc_id"), 6).alias("_rs_old"))
    placed = op.common.written(op.plan(op.common.written(r, "t"), "_rs_old", "size", ["doc_id", "c"]), "t")
    return op.slots(placed, "_rs_old").collect()


def test_shards_are_near_equal_and_slots_gapless(spark, make):
    rng = random.Random(2)
    rows = [(k, "x" * rng.choice([0, 10, 100, 1000]), "en", "s") for k in range(900)]
    got = place(spark, rows, make)
    size = {k: sum(len(t) + 1 for i, t, *_ in rows if i in own) for k, own in ((k, {r.doc_id for r in got if r._rs_shard == k}) for k in range(8))}
    assert max(size.values()) - min(size.values()) <= 4 * 1001
    for _, own in itertools.groupby(sorted(got, key=lambda r: (r._rs_shard, r._rs_slot)), key=lambda r: r._rs_shard):
        own = list(own)
        assert [r._rs_slot for r in own] == list(range(len(own)))
    assert sum(r.size for r in got if r._rs_old != r._rs_shard) <= 1.2 * sum(r.size for r in got) / 4


def test_odd_rows(spark, make, odd):
    got = place(spark, odd, make)
    assert sorted((str(r.doc_id), r.size, r.c) for r in got) == sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in odd)
    assert place(spark, [], make) == []


def test_only_changed_shards_are_written(spark, make, tmp_path):
    docs = make([(k, f"t{k}", "en", "s") for k in range(40)])
    plan = spark.createDataFrame([(k, k % 4, 4 if k % 4 == 3 and k > 20 else k % 4) for k in range(40)], "doc_id long, _rs_old int, _rs_shard int")
    assert op.rewrite(docs, plan, f"file://{tmp_path}/out") == [3, 4]
    back = {r.doc_id: r.shard for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    assert back == {k: (4 if k > 20 else 3) for k in range(40) if k % 4 == 3}


def test_query_moves_texts(spark, make, odd, tmp_path):
    """Null ids, repeated ids and repeated rows included, each row's text is in its new shard's file once."""
    from collections import Counter

    rows = [r for r in odd if r[0] != 4] + [(k % 50 if k % 3 else None, f"text {k % 40}", "en", "s") for k in range(300)]
    make(rows).repartition(4).write.parquet(f"file://{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"file://{tmp_path}/documents.parquet")
    got = op.reshard(docs, f"file://{tmp_path}/out").collect()
    size = lambda t: len((t or "").encode()) + 1
    crc = lambda t: zlib.crc32((t or "").encode())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, size(t), crc(t)) for i, t, *_ in rows)
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert set(docs.columns) | {"slot", "shard"} == set(back.columns)
    back = back.collect()
    moved = {k for r in got if r.shard != r.old_shard for k in (r.shard, r.old_shard)}
    assert any(r.doc_id is None and r.shard in moved for r in got) and {r.shard for r in back} <= moved
    assert not Counter((r.doc_id, r.text, r.lang, r.source) for r in back) - Counter(rows)
    assert Counter((r.doc_id, crc(r.text), r.shard, r.slot) for r in back) == Counter((r.doc_id, r.text_crc32, r.shard, r.slot) for r in got if r.shard in moved)
    assert sorted((r.shard, r.slot) for r in got) == [(k, j) for k, n in sorted(Counter(r.shard for r in got).items()) for j in range(n)]


def test_untouched_shards_stay(spark, make, tmp_path):
    rows = [(k, "x" * 9, "en", "s") for k in range(60)]
    make(rows).write.parquet(f"file://{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"file://{tmp_path}/documents.parquet")
    full = {r.o: r.n * 10 for r in docs.groupBy(op.hashed_shard(docs["doc_id"], 6).alias("o")).count().withColumnRenamed("count", "n").collect()}
    capacity = [full.get(k, 0) for k in range(6)]
    got = op.reshard(docs, f"file://{tmp_path}/none", capacity).collect()
    assert sorted(r.doc_id for r in got) == list(range(60)) and all(r.shard == r.old_shard for r in got) and not (tmp_path / "none").exists()
    capacity = [*capacity[:5], capacity[5] // 2, capacity[5]]
    got = op.reshard(docs, f"file://{tmp_path}/some", capacity).collect()
    assert sorted(r.doc_id for r in got) == list(range(60)) and all(r.shard == r.old_shard for r in got if r.old_shard < 5)
    assert {r.shard for r in spark.read.parquet(f"file://{tmp_path}/some").collect()} == {5, 6}


def test_rewrite_wants_a_key(spark, make, tmp_path):
    import pytest

    docs = make([(1, "a", "en", "s"), (1, "b", "en", "s"), (None, "c", "en", "s")])
    plan = spark.createDataFrame([(1, 0, 1), (1, 0, 1), (None, 0, 1)], "doc_id long, _rs_old int, _rs_shard int")
    with pytest.raises(ValueError):
        op.rewrite(docs, plan, f"file://{tmp_path}/out")


def test_reshard_of_nothing(spark, make, tmp_path):
    make([]).write.parquet(f"file://{tmp_path}/documents.parquet")
    assert op.reshard(spark.read.parquet(f"file://{tmp_path}/documents.parquet"), f"file://{tmp_path}/out").collect() == []


def test_clashing_names_are_kept_under_others(spark, make, tmp_path):
    from pyspark.sql import functions as F

    names = ["Shard", "slot", "in_slot", "_rs_row", "_rs_old", "law", "grown_shard"]
    docs = make([(k, f"text {k}", "en", "s") for k in range(60)]).select("*", *[F.lit(f"x{n}").alias(c) for n, c in enumerate(names)])
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    got = op.reshard(spark.read.parquet(f"file://{tmp_path}/documents.parquet"), f"file://{tmp_path}/out")
    assert sorted(r.doc_id for r in got.collect()) == list(range(60))
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert back.columns == ["doc_id", "text", "lang", "source", "n_chars", "in_Shard", "in_in_slot", "in_slot", "in__rs_row", "in__rs_old", "law", "grown_shard", "slot", "shard"]
    assert all(tuple(r)[5:12] == tuple(f"x{n}" for n in range(7)) for r in back.collect())
