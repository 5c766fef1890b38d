import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quakeframe.llm import op12_spelling as op

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(rows):
    """{word: (form, root, n, n_near, form_n)} by the contract's words, all pairs of words compared."""
    n = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    by_deletion = {}
    for w in n:
        for k in range(len(w)):
            by_deletion.setdefault((k, w[:k] + w[k + 1 :]), set()).add(w)
    near = {w: set() for w in n}
    for w in n:
        for k in range(len(w)):
            gone = w[:k] + w[k + 1 :]
            near[w] |= by_deletion[k, gone] - {w}
            if gone in n:
                near[w].add(gone)
                near[gone].add(w)
    out = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        out[w] = best if best and n[best] >= 2 * n[w] else None

    def root(w):
        while out[w]:
            w = out[w]
        return w

    return {w: (out[w], root(w), n[w], len(near[w]), n[out[w]] if out[w] else None) for w in n}


def check(spark, rows):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, word string").repartition(3)
    got = op.variants(df).collect()
    mine = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got}
    assert len(mine) == len(got)
    assert mine == brute(rows)
    return mine


def corpus(seed, letters="abcdeé", size=4):
    rng = random.Random(seed)
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(5, 9))) for _ in range(60)]
    rows = []
    for k in range(40):
        words = []
        for _ in range(300):
            w = list(base[min(int(rng.expovariate(0.08)), 59)])
            if rng.random() < 0.3:
                at = rng.randrange(len(w))
                w[at : at + 1] = rng.choice([[], [rng.choice(letters)], [w[at], rng.choice(letters)]])
            words.append("".join(w) if rng.random() < 0.9 else "".join(w).upper())
        rows.append((k, rng.choice([" ", "-", "1", "日", ". "]).join(words)))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_against_all_pairs(spark, seed, monkeypatch):
    if seed == 2:
        monkeypatch.setattr(op, "CHUNK", 4)  # the blocks fall into many chunks
    mine = check(spark, corpus(seed))
    assert len(mine) > 200 and any(v[0] for v in mine.values())


def test_nulls_ties_and_long_words(spark):
    long = "a" * 3000 + "b" * 5000
    rows = [(None, "kitten kitten Kitten"), (1, None), (2, ""), (3, "sitten mitten " * 3), (3, "sitten mitten " * 3), (4, "Études études " * 3 + "×÷×÷× " * 4)]
    rows += [(5, f"{long} {long}x {long}"), (6, f"{long} {long}x {long}x {long[1:]} {long[1:]}"), (7, f"{long[1:]} {long}")]
    mine = check(spark, rows)
    assert mine[long][3] == 2 and "Études" in mine


def test_chain_of_forms(spark):
    """Each word is the form of the one before, up to a root nine steps away."""
    words = ["b" * k + "a" * (10 - k) for k in range(10)]
    mine = check(spark, [(500, " ".join(" ".join([w] * (3 << k)) for k, w in enumerate(words)))])
    assert mine[words[0]][:2] == (words[1], words[9]) and mine[words[9]][:2] == (None, words[9])


def test_empty(spark):
    assert op.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert op.variants(spark.createDataFrame([(1, None), (2, "a b c")], "doc_id long, text string")).count() == 0


def test_blocks_hold_all_near_words():
    """Each edit leads to a block among the neighbours of the other word's block, from one side exactly."""
    rng = random.Random(5)
    letters = op.class_letters()
    count = lambda w: tuple(sum(c in s for c in w) for s in letters)
    every = "".join(letters)
    assert sorted(every) == sorted({chr(c) for c in [*range(97, 123), *range(0xC0, 0x100)]})
    for _ in range(200):
        w = [rng.choice(every) for _ in range(rng.randint(5, 12))]
        at = rng.randrange(len(w))
        moved = np.abs(np.subtract(count(w), count([*w[:at], rng.choice(every), *w[at + 1 :]])))
        assert moved.sum() in (0, 2) and moved.max() <= 1
        assert np.subtract(count([*w[:at], rng.choice(every), *w[at:]]), count(w)).sum() == 1


def test_whole_table(spark):
    dir_ = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{dir_}/documents.parquet").select("doc_id", "text").collect()]
    got = op.op12_spelling(spark, dir_).collect()
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == brute(rows) and got
