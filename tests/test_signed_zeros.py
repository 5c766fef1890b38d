"""Queries whose results hold negative numbers that round to zero, against their SQL: it keeps the sign (-0.0)."""

import random

import duckdb
import pytest

from quakeframe.plans import catalogue

QUERIES = [
    "f2_apply_processing",
    "w8_carry_over_tail",
    "x11_stitch",
    "x12_join_chunks",
    "x13_cut_around_pick",
    "x15_augmented",
    "x15_random_shift",
    "s2_read_examples",
    "s8_write_corrections",
    "t1_stream_carry_over",
    "x16_random_start_times",
    "x20_mix_drawn",
]


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """Embeddings of a mean near 0, every third value of them between -5e-7 and 5e-7, none 0."""
    d, rng = tmp_path_factory.mktemp("near-zero"), random.Random(7)
    half = lambda: rng.uniform(1e-8, 4e-7) if rng.random() < 0.35 else rng.uniform(0.1, 0.4)
    rows = [(k, [v for _ in range(32) for a in (half(),) for v in (a, -a)], k % 4) for k in range(40)]
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[], label INTEGER)")
    con.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", rows)
    con.execute(f"COPY embeddings TO '{d}/embeddings.parquet' (FORMAT parquet)")
    return str(d), con


def plain(v):
    """Six decimals, with the sign of a zero."""
    return f"{v:.6f}" if isinstance(v, float) else [plain(x) for x in v] if isinstance(v, list) else v


@pytest.mark.parametrize("name", QUERIES)
def test_the_sign_of_zeros(spark, tables, name):
    d, con = tables
    df = catalogue.QUERIES[name](spark, d)
    got = sorted(str([plain(x) for x in r]) for r in df.collect())
    r = con.execute(catalogue.ORACLES[name])
    at = [[c[0] for c in r.description].index(c) for c in df.columns]
    want = sorted(str([plain(row[k]) for k in at]) for row in r.fetchall())
    assert got == want and any("-0.000000" in x for x in want)
