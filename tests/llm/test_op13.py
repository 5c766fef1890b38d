import random
import re
from collections import Counter

import numpy as np
import pytest

from quakeframe.llm import linking
from quakeframe.llm import op13_tensored as op

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall("[^\\x20\\x09-\\x0D]+", (text or "").translate(LOW))
    k = min(4, len(w))
    return frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if w else frozenset()


def brute(rows):
    """(doc_id, n_shingles, component_id, kept) of each row, over all pairs of sets that share a shingle."""
    sets = {}
    for i, t, *_ in rows:
        s = shingles(t)
        if s:
            sets.setdefault(s, []).append(i)
    root = {s: s for s in sets}

    def find(s):
        while root[s] != s:
            s = root[s]
        return s

    holders = {}
    for s in sets:
        shared = Counter(o for x in s for o in holders.get(x, ()))
        for o, n in shared.items():
            if 100 * n >= 80 * (len(s) + len(o) - n):
                root[find(s)] = find(o)
        for x in s:
            holders.setdefault(x, []).append(s)
    low = {}
    for s, ids in sets.items():
        known = [i for i in ids if i is not None]
        low[find(s)] = min([*known, *([low[find(s)]] if low.get(find(s)) is not None else [])], default=None)
    out = []
    for i, t, *_ in rows:
        s = shingles(t)
        c = low[find(s)] if s else i
        out.append((i, len(s), c, i == c))
    return out


def query(df):
    from pyspark.sql import functions as F

    j = op.join(df)
    return [tuple(r) for r in j.select("_id", "_shingles", "_component", F.col("_id").eqNullSafe(F.col("_component"))).collect()]


def corpus(seed, families=40, most=8, edits=6):
    rng = random.Random(seed)
    prose = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    passage, rows, i = prose(60), [], 0
    for _ in range(families):
        base = prose(rng.randint(1, 200))
        if rng.random() < 0.5:
            base += passage
        for _ in range(rng.randint(1, most)):
            w = list(base)
            for _ in range(rng.randint(0, edits)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(9999)}"
            text = rng.choice([" ", "\n", "  "]).join(w)
            rows.append((i, text.upper() if rng.random() < 0.2 else text, "en", "s"))
            i += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_against_all_pairs(make, seed):
    rows = corpus(seed)
    assert sorted(query(make(rows))) == sorted(brute(rows))


def test_large_groups_fall_into_chunks(make, monkeypatch):
    """Small chunks: dealings, outsiders and tables of the second collection give what all pairs give."""
    monkeypatch.setattr(linking, "CHUNK", 4)
    monkeypatch.setattr(op, "CHUNK_BYTES", 4000)
    rows = corpus(7, families=6, most=40, edits=25)
    assert sorted(query(make(rows))) == sorted(brute(rows))


def test_odd_rows(make, odd):
    rows = [*odd, (20, "A b\tC", None, None), (21, "a  B c", "x", "y"), (None, "a b c d e f", "x", "y"), (None, "a b c d e f ", "x", "y")]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(query(make(rows)), key=key) == sorted(brute(rows), key=key)
    assert query(make([])) == []


def test_deduplicated(make, odd):
    rows = [*odd, (30, "a b c d e f", None, None), (30, "a b c d e f", None, None), (31, "a b c d e F", None, None), (None, "q r s", None, None), (None, "Q r s", None, None)]
    got = op.deduplicated(make(rows))
    assert got.columns == make(rows).columns
    got = [(r.doc_id, r.text) for r in got.collect()]
    sets = Counter(shingles(t) for _, t in got)
    assert sets[frozenset()] == sum(not shingles(t) for _, t, *_ in rows)
    assert all(n == 1 for s, n in sets.items() if s)
    keys = {c for _, n, c, _ in brute(rows) if n}
    assert sum(n for s, n in sets.items() if s) == len({(c if c is not None else shingles(t)) for (_, t, *_), (_, n, c, _) in zip(rows, brute(rows), strict=True) if n}) and None in keys


def test_recall_of_tables():
    """Pairs at the limit share a table about as often as computed, and agree in enough values."""
    rng = np.random.default_rng(3)
    n, missed = 4000, 0
    for _ in range(n):
        u = rng.integers(0, 1 << 63, 90, dtype=np.int64).astype(np.uint64)
        a, b = (op.min_hashes(np.sort(x)) for x in (u[:81], u[9:]))
        equal = (a & np.uint64(255)) == (b & np.uint64(255))
        first = np.isin(op.first_keys(a), op.first_keys(b)).any()
        missed += not (first and equal[op.HALF * op.M :].reshape(op.M, op.HALF).all(1).any() and equal.sum() >= op.AGREE)
    assert missed <= 2
    assert op.T == 2 * op.HALF * op.M and 1 - (1 - (1 - 0.8**op.HALF) ** op.M) ** 2 < 2.1e-6


def test_whole_table(spark):
    dir_ = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{dir_}/documents.parquet").select("doc_id", "text").collect()]
    got = op.op13_tensored(spark, dir_).collect()
    assert sorted(tuple(r) for r in got) == sorted(brute(rows))
    assert got[0].asDict().keys() == {"doc_id", "n_shingles", "component_id", "kept"} and any(not r.kept for r in got)
