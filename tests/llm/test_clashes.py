"""Extra columns with names that operators use themselves."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from quakeframe.llm import common, op1_divergence, op2_suffixes, op3_chosenpath, op4_licenses, op5_langid, op6_pseudonyms, op7_packing, op8_mixing, op9_reshard, op10_topk

EXTRA = "_mix_size _mix_source _mix_range _range _s _this _own _key _digest _id _class _group _links _lang_pred _lang_score _lang_text _pii_text _pii_new n_card c0 c1 id key n part piece start length size source_size _w _t _h n_words kept _bytes _ranges cluster links v rank score".split()


def clashing(df):
    return df.select("*", *[F.lit(f"x{k}").alias(c) for k, c in enumerate(EXTRA)])


def rows_of(make, odd):
    return clashing(make([r for r in odd if r[0] != 4] + [(100 + k, f"plain words of text number {k} and the river of gold 4785380592391139", "en", "a") for k in range(30)]))


def test_stages_carry_columns_unchanged(spark, make, odd):
    docs = rows_of(make, odd)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.written(stage(spark, docs, ""), f"clash-{name}")
        assert docs.columns == rows_of(make, odd).columns
        for k in (0, len(EXTRA) - 1):
            assert {r[0] for r in docs.select(EXTRA[k]).distinct().collect()} == {f"x{k}"}
    assert docs.count() > 0
    assert op7_packing.pack_documents(docs).count() > 0


def same(a, b):
    rows = lambda df: Counter(str(r) for r in df.select(*sorted(df.columns)).collect())
    assert sorted(a.columns) == sorted(b.columns) and rows(a) == rows(b)


def test_operators_ignore_other_columns(make, odd):
    """Results are those without the other columns."""
    docs = rows_of(make, odd)
    plain = docs.drop(*EXTRA)
    own = lambda df: df.select(*plain.columns)
    for run in (
        op1_divergence.judge,
        op2_suffixes.remove_repeats,
        lambda d: op3_chosenpath.join(d),
        lambda d: own(op3_chosenpath.deduplicated(d)),
        op4_licenses.scan,
        lambda d: op5_langid.predict(d, keep=["doc_id"]),
        lambda d: own(op6_pseudonyms.pseudonymise(d, op6_pseudonyms.PUBLIC_KEY)),
        lambda d: op7_packing.pieces(d),
        lambda d: own(op8_mixing.mix(d)),
    ):
        same(run(docs), run(plain))
    assert op6_pseudonyms.pseudonymise(docs, op6_pseudonyms.PUBLIC_KEY).columns == op8_mixing.mix(docs).columns == docs.columns


def test_resharding_ignores_other_columns(spark, make, odd, tmp_path):
    docs = rows_of(make, odd).withColumnsRenamed({"c0": "shard", "c1": "_rs_file", "id": "_rs_old", "key": "_metadata"}).coalesce(1)
    docs.write.parquet(f"file://{tmp_path}/a")
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"file://{tmp_path}/b")
    a, b = (op9_reshard.reshard(spark.read.parquet(f"file://{tmp_path}/{k}"), f"file://{tmp_path}/out-{k}") for k in "ab")
    same(a, b)
    assert set(docs.columns) - {"shard", "_rs_file", "_rs_old"} < set(spark.read.parquet(f"file://{tmp_path}/out-a").columns)


def test_vectors(spark):
    v = clashing(spark.createDataFrame([(k, [float(k), 1.0], 0) for k in range(60)], "vec_id long, embedding array<float>, label int"))
    assert op10_topk.top_k(v, lambda i: i % 50 == 0).count() == 10
