import hashlib
import random
from collections import Counter

import pytest

from quakeframe.llm import op3_chosenpath as op
from quakeframe.llm.components import components


def shingles(text):
    import re

    w = re.findall("[^\\x20\\x09-\\x0D]+", text or "")
    k = min(5, len(w))
    return {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()


def brute(rows):
    """(id of the class or None, links, texts of the group) of each text."""
    ids = {}
    for i, t, *_ in rows:
        ids.setdefault(t or "", []).append(i)
    low = {t: min((x for x in v if x is not None), default=None) for t, v in ids.items()}
    owner = {}
    for t in sorted(ids, key=lambda t: hashlib.md5(t.encode()).digest()):
        owner.setdefault(low[t], t)
    sets = {t: shingles(t) for t in ids}
    root, links = {t: t for t in sets}, Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = {}
    for t, own in sets.items():
        for x in own:
            holders.setdefault(x, []).append(t)
    for a in sets:
        shared = Counter(b for x in sets[a] for b in holders[x] if b > a)
        for b, n in shared.items():
            if 9 * n >= 4 * (len(sets[a]) + len(sets[b])):
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    groups = {}
    for t in sets:
        groups.setdefault(find(t), []).append(t)
    return {t: (low[t] if low[t] is not None and owner[low[t]] == t else None, links[t], groups[find(t)]) for t in ids}


def corpus(seed):
    rng = random.Random(seed)
    prose = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    rows, i = [], 0
    for _ in range(40):
        base = prose(rng.randint(3, 200))
        for _ in range(rng.randint(1, 8)):
            w = list(base)
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(9999)}"
            rows.append((i, " ".join(w), "en", "s"))
            i += 1
    return rows


def check(rows, got):
    """Rows of the join against the plain version, those without an id and those that share one included."""
    want = brute(rows)
    assert Counter((r._id, bytes(r._digest)) for r in got) == Counter((i, hashlib.md5((t or "").encode()).digest()) for i, t, *_ in rows)
    of = {hashlib.md5(t.encode()).digest(): t for t in want}
    label = {}
    for r in got:
        label.setdefault(of[bytes(r._digest)], set()).add(r._class)
    assert all(len(v) == 1 for v in label.values())
    label = {t: v.pop() for t, v in label.items()}
    assert len(set(label.values())) == len(label)
    copies, first = Counter(t or "" for _, t, *_ in rows), {}
    for r in got:
        t = of[bytes(r._digest)]
        own, links, group = want[t]
        assert r._class == own if own is not None else r._class < 0
        assert r._links == links and r._copies == copies[t]
        proper = [label[x] for x in group if want[x][0] is not None]
        assert r._group == min(proper or [label[x] for x in group])
        if r._first:
            first.setdefault(min(group), set()).add((r._id, t))
    assert len(first) == len({min(g) for *_, g in want.values()}) and all(len(v) == 1 for v in first.values())


@pytest.mark.parametrize("seed", range(2))
def test_links_and_groups(make, seed):
    rows = corpus(seed)
    check(rows, op.join(make(rows)).collect())


def test_large_buckets_are_split_or_compared_in_chunks(make, monkeypatch):
    monkeypatch.setattr(op, "BUCKET", 8)
    monkeypatch.setattr(op, "CHUNK", 4)
    rng = random.Random(3)
    base = [f"w{k}" for k in range(150)]
    rows = corpus(7)
    for k in range(40):
        w = list(base)
        for _ in range(k % 4):
            w[rng.randrange(150)] = f"y{rng.randrange(9999)}"
        rows.append((1000 + k, " ".join(w), "en", "s"))
    check(rows, op.join(make(rows)).collect())


def kept_as_planned(make, rows):
    kept = op.deduplicated(make(rows)).collect()
    want = brute(rows)
    groups = {t: min(g) for t, (_, _, g) in want.items()}
    assert Counter(groups[r.text or ""] for r in kept) == Counter(set(groups.values()))
    given = {(i, t) for i, t, *_ in rows}
    for r in kept:
        ids = {want[t][0] for t in want if groups[t] == groups[r.text or ""]} - {None}
        assert (r.doc_id, r.text) in given and (not ids or r.doc_id == min(ids))


def test_odd_rows(make, odd):
    rows = [r for r in odd if r[0] != 4]
    check(rows, op.join(make(rows)).collect())
    kept_as_planned(make, rows)
    assert op.join(make([])).collect() == [] and op.deduplicated(make([])).collect() == []


def test_texts_without_an_id_and_with_a_shared_one(make):
    base = [f"w{k}" for k in range(60)]
    near = lambda k, n=60: " ".join([*base[:n][:-1], f"z{k}"])
    other = " ".join(f"v{k}" for k in range(60))
    rows = [(None, near(1)), (1, near(2)), (None, near(3)), (None, near(3)), (7, near(4)), (7, other), (7, other + " end"), (7, None), (None, ""), (0, "two words"), (None, "two words")]
    rows += [(None, "x " + other[3:]), (None, "lonely text without any id at all"), (None, "lonely text without any id at all"), (-3, "below zero"), (3, near(2)), (3, near(2))]
    rows = [(i, t, "en", "s") for i, t in rows]
    check(rows, op.join(make(rows)).collect())
    kept_as_planned(make, rows)
    mixed = [(None if k % 3 == 0 else i // 2, t, "en", "s") for k, (i, t, *_) in enumerate(corpus(11))]
    check(mixed, op.join(make(mixed)).collect())
    kept_as_planned(make, mixed)


def test_recall_on_documents(spark):
    """All links of the documents whose id is divisible by 50, to all documents: those found among those there are."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang", "source")
    rows = [tuple(r) for r in docs.collect()]
    want = brute(rows)
    got = {r._id: r._links for r in op.join(docs).collect()}
    asked = [(i, want[t or ""][1]) for i, t, *_ in rows if i % 50 == 0]
    true, found = sum(n for _, n in asked), sum(min(n, got[i]) for i, n in asked)
    every = sum(n for _, n, _ in want.values())
    print(f"recall {found}/{true} for ids divisible by 50; {every} links in all")
    assert true and found == true and all(got[i] == want[t or ""][1] for i, t, *_ in rows)
    assert op.runs_for(0.9) < op.runs_for(op.RECALL) == op.RUNS and op.meeting(0.9) > op.meeting(0.8)


def test_components_of_paths_and_stars(spark):
    path = [(k, k + 1) for k in range(1, 60)]
    star = [(200, k) for k in range(100, 160)]
    got = {r.id: r.root for r in components(spark.createDataFrame(path + star + [(7, 7)], "a long, b long"), "t").collect()}
    assert len({got[k] for k in range(1, 61)}) == 1 and len({got[k] for k in [200, *range(100, 160)]}) == 1 and got[1] != got[200]


def test_long_near_copies_fall_into_chunks_by_bytes(make, monkeypatch):
    """Thirty near copies of 3,000 words each, of which three fit into a chunk."""
    monkeypatch.setattr(op, "CHUNK_BYTES", 80_000)
    rng = random.Random(9)
    base = [f"w{rng.randrange(50000)}" for _ in range(3000)]
    rows = []
    for k in range(30):
        w = list(base)
        for _ in range(30):
            w[rng.randrange(3000)] = f"x{k}-{rng.randrange(9999)}"
        rows.append((k, " ".join(w), "en", "s"))
    check(rows, op.join(make(rows)).collect())
