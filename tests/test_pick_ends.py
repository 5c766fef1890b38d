"""Probabilities at the very threshold that ends a pick, against the SQL."""

import duckdb

from quakeframe.plans import catalogue


def test_a_sample_at_the_lower_threshold_ends_no_pick(spark, tmp_path):
    """0.35 isn't under 0.4 - 0.05, which floats make 0.35000000000000003."""
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[], label INTEGER)")
    series = [[0.5, 0.35, 0.6, 0.35, 0.1, 0.45, 0.349999, 0.5], [0.4, 0.35], [0.35, 0.4, 0.35]]
    con.executemany("INSERT INTO embeddings VALUES (?, ?, 0)", [(k, [v / 3 for v in p] + [0.0] * (64 - len(p))) for k, p in enumerate(series)])
    con.execute(f"COPY embeddings TO '{tmp_path}/embeddings.parquet' (FORMAT parquet)")
    got = sorted(tuple(r) for r in catalogue.QUERIES["x1_extract_picks"](spark, str(tmp_path)).collect())
    assert got == sorted(con.execute(catalogue.ORACLES["x1_extract_picks"]).fetchall()) == [(0, 2, 4, 0.6), (0, 5, 1, 0.45), (0, 7, 1, 0.5), (1, 0, 2, 0.4), (2, 1, 2, 0.4)]
