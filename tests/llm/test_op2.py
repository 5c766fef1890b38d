import hashlib
import random

import pytest

from quakeframe.llm import op2_suffixes as op


def brute(rows):
    """Removal of the bytes of each (id, text) by the plain rule; equal rows are one document."""
    seen, out = set(), {}
    for key in sorted({(-(1 << 63) if i is None else i, t or "") for i, t, *_ in rows}):
        b = key[1].encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            w = b[p : p + 100]
            if w in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[key] = (len(b), len(b) - len(kept), runs, hashlib.sha256(kept).hexdigest())
    return out


def check(rows, got):
    want = brute(rows)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted((str(i), *want[(-(1 << 63) if i is None else i, t or "")]) for i, t, *_ in rows)


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefé") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    prose = lambda k: " ".join(rng.choice(words) for _ in range(k))
    shared = [prose(60) for _ in range(4)]
    rows = []
    for i in range(n):
        parts = [prose(rng.randint(0, 60)) for _ in range(rng.randint(0, 3))]
        if rng.random() < 0.5:
            s = rng.choice(shared)
            parts.insert(rng.randint(0, len(parts)), s[rng.randint(0, 80) :][: rng.randint(90, 300)])
        if rng.random() < 0.2:
            parts += ["ab" * rng.randint(20, 200)]
        if rng.random() < 0.1:
            parts += ["\x00" * rng.randint(90, 130)]
        rows.append((i, " ".join(parts), "en", "s"))
    rows += [(n + k, rows[rng.randrange(n)][1], "en", "s") for k in range(n // 5)]
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_against_the_rule(make, seed, monkeypatch):
    monkeypatch.setattr(op, "CHUNK", 20_000)
    monkeypatch.setattr(op, "BLOCK", 700)
    rows = corpus(seed, 150)
    check(rows, op.remove_repeats(make(rows).repartition(5)).collect())


def test_lanes_of_ranges(make, monkeypatch):
    """Three ranges of many lanes, in fewer tasks than lanes."""
    monkeypatch.setattr(op, "CHUNK", 20_000)
    monkeypatch.setattr(op, "MAX_RANGES", 3)
    monkeypatch.setattr(op, "MAX_TASKS", 10)
    monkeypatch.setattr(op, "PART_BYTES", 2_000)
    rows = corpus(5, 150)
    check(rows, op.remove_repeats(make(rows).repartition(5)).collect())


def test_levels_cover_all_window_places():
    assert sorted(x for a, b in op.LEVELS for x in range(a, b + 1)) == list(range(op.WIDTH)) and all(op.SPAN - b >= op.GRAM for _, b in op.LEVELS)


@pytest.mark.parametrize("share", [0.02, 1.1])
def test_hot_passages(make, monkeypatch, share):
    """A passage in a third of all documents, between texts of their own; `share` 1.1: nothing counts as hot."""
    monkeypatch.setattr(op, "HOT_SHARE", share)
    monkeypatch.setattr(op, "CHUNK", 8_000)
    rng = random.Random(12)
    prose = lambda n: "".join(rng.choice("abcdef ") for _ in range(n))
    passage, rows = prose(400), []
    for i in range(180):
        own = prose(rng.randint(0, 250))
        rows.append((i, own[: len(own) // 2] + (passage[rng.choice([0, 0, 3, 50]) : rng.choice([400, 400, 390])] if i % 3 == 0 else "") + own[len(own) // 2 :], "en", "s"))
    rows += [(200 + k, rows[k][1][7:], "en", "s") for k in range(0, 30, 3)]
    docs = make(rows).repartition(5)
    found = op.hot_heads(docs.selectExpr("doc_id AS _id", "xxhash64(text) AS _hash", "CAST(text AS binary) AS _bytes"), len(rows))
    assert (len(found) > 5) == (share < 1)
    check(rows, op.remove_repeats(docs).collect())


def test_lanes_keep_exact_prefixes():
    import numpy as np

    rng = random.Random(6)
    keys = sorted(bytes(rng.choice(b"ab") for _ in range(rng.randint(2, 9))) for _ in range(300))
    prefix = lambda a, b: next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
    lcp = np.array([0] + [prefix(a, b) for a, b in zip(keys, keys[1:], strict=False)])
    part = np.array([rng.randrange(7) for _ in keys])
    seen = 0
    for number, rows, shared in op._lanes(part, lcp):
        assert (part[rows] == number).all() and shared[0] == 0
        assert shared[1:].tolist() == [prefix(keys[a], keys[b]) for a, b in zip(rows, rows[1:], strict=False)]
        seen += len(rows)
    assert seen == len(keys)


def test_odd_rows(make, odd):
    rows = [r for r in odd if r[0] != 4]
    check(rows, op.remove_repeats(make(rows)).collect())


def test_long_text_in_segments(make, monkeypatch):
    rng = random.Random(9)
    base = "".join(rng.choice("abcdefgh ") for _ in range(30_000))
    rows = [(1, base + base[1000:9000] + base, "en", "s"), (2, base[500:20_000], "en", "s")]
    check(rows, op.remove_repeats(make(rows)).collect())


def test_loser_tree_is_a_merge():
    rng = random.Random(5)
    for _ in range(200):
        runs = []
        for _ in range(rng.randint(1, 9)):
            keys = sorted(bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 8))) for _ in range(rng.randint(0, 12)))
            shared = [0] + [next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b))) for a, b in zip(keys, keys[1:], strict=False)]
            runs.append((keys, shared[: len(keys)]))
        run, place, known = op.LoserTree(runs).merged()
        merged = [runs[r][0][p] for r, p in zip(run, place, strict=True)]
        assert merged == sorted(k for keys, _ in runs for k in keys)
        for a, b, k in zip(merged, merged[1:], known[1:], strict=False):
            assert k == next((j for j in range(min(len(a), len(b))) if a[j] != b[j]), min(len(a), len(b)))


def test_kept_bytes_and_empty_table(make):
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefghij") for _ in range(300))
    got = {r.doc_id: r.kept for r in op.remove_repeats(make([(1, text, None, None), (2, "x" + text + "yz", None, None)])).collect()}
    assert bytes(got[1]) == text.encode() and bytes(got[2]) == b"xyz"
    assert op.remove_repeats(make([])).collect() == []
