import random
import re

from quakeframe.llm import op4_licenses as op


def test_automaton_gives_matching_statistics():
    rng = random.Random(1)
    for _ in range(200):
        templates = [[rng.randrange(3) for _ in range(rng.randrange(1, 9))] for _ in range(3)]
        a, text = op.Automaton(templates), [rng.randrange(4) for _ in range(30)]
        parts = {tuple(t[i:j]) for t in templates for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
        longest = [max(n for n in range(k + 2) if n == 0 or tuple(text[k + 1 - n : k + 1]) in parts) for k in range(len(text))]
        want = [(k, n) for k, n in enumerate(longest) if n and (k + 1 == len(text) or longest[k + 1] != n + 1)]
        got = list(a.matches(text))
        assert [(e, n) for e, n, _ in got] == want
        for e, n, state in got:
            assert a.ends[state] == {(k, j) for k, t in enumerate(templates) for j in range(n - 1, len(t)) if t[j + 1 - n : j + 1] == text[e + 1 - n : e + 1]}


def base(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", low)
    places = [(k, label) for p, label in op.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
    return len(w), len(places), min((k for k, _ in places), default=None), max((k for k, _ in places), default=None), ",".join(sorted({x for _, x in places}))


TEXTS = [
    "Released under the MIT License.", "The MIT License the mit license, THE MIT-LICENSE!", "Licensed under the Apache License, Version 2.0.", "cc by nc", "CC-BY-NC 4.0 and cc by  nc, Apache_License version 2",
    "This work is licensed under the GNU General Public License, version 3.", "lé the mit license", "the mit", "",
]


def test_base_places(make, odd):
    rows = [(k, t, "en", "s") for k, t in enumerate(TEXTS)] + [r for r in odd if r[0] not in (7, None)]
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in op.scan(make([(100 + i if k >= len(TEXTS) else i, *x) for k, (i, *x) in enumerate(rows)])).collect()}
    want = {(100 + i if k >= len(TEXTS) else i): base(t) for k, (i, t, *_) in enumerate(rows)}
    assert got == want


def test_phrases_of_the_contract(spark, tmp_path):
    """The query's five exact columns, phrases and places written out: "the mit license" alone is no place, and the place begins with "under"."""
    rows = {
        1: ("Released under the MIT License.", (5, 1, 1, 1, "mit")),
        2: ("The MIT License (MIT)", (4, 0, None, None, "")),
        3: ("the mit license, UNDER-the\x00MIT_license; under the MIT license", (11, 2, 3, 7, "mit")),
        4: ("under the mit licenses, \u00e9under the mit license, under\u00a0the mit license", (11, 0, None, None, "")),
        5: ("CC BY-NC or Apache License, Version 2.0 or under the MIT license", (14, 3, 0, 10, "apache-2,cc-by-nc,mit")),
        6: ("cc by nc by nc apache license version 20", (9, 1, 0, 0, "cc-by-nc")),
        7: ("", (0, 0, None, None, "")),
        8: (None, (0, 0, None, None, "")),
    }
    spark.createDataFrame([(k, t) for k, (t, _) in rows.items()], "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in op.op4_licenses(spark, f"file://{tmp_path}").collect()}
    assert got == {k: want for k, (_, want) in rows.items()}


def test_chains_bridge_changed_words(make):
    notice = op.TEMPLATES[3][1].replace("compliance", "accordance").replace("obtain", "get")
    prose = "some words in front of it and " * 5
    rows = [(1, prose + notice + prose, "en", "s"), (2, prose, "en", "s"), (3, " ".join(notice.split()[::-1]), "en", "s")]
    got = {r.doc_id: r for r in op.scan(make(rows)).collect()}
    assert "apache-2" in got[1].labels and got[1].score > 0.8 and 34 <= got[1].spans[0].first_word <= 36
    assert got[2].labels == "" and got[2].score == 0 and got[3].labels == ""


def plain_spans(text):
    """Spans by the rules, slowly: longest matches at every word, chains end by end, then what overlaps and what lies within."""
    templates = [(label, op.words(t)) for label, t in op.TEMPLATES]
    w = op.words(text)
    occurs = lambda part, t: [k + len(part) - 1 for k in range(len(t) - len(part) + 1) if t[k : k + len(part)] == part]
    longest = [max((n for n in range(1, k + 2) if any(occurs(w[k + 1 - n : k + 1], t) for _, t in templates)), default=0) for k in range(len(w))]
    matches = [(k, n) for k, n in enumerate(longest) if n >= op.MIN_MATCH and (k + 1 == len(w) or longest[k + 1] != n + 1)]
    chains = []
    for label, t in templates:
        spots = sorted((e, p, n) for e, n in matches for p in occurs(w[e + 1 - n : e + 1], t))
        best = []
        for k, (e, p, n) in enumerate(spots):
            ways = [(n, 0, e - n + 1)]
            for j, (e2, p2, _) in enumerate(spots[:k]):
                if e - n - e2 <= op.MAX_GAP and e2 < e and p2 < p:
                    ways.append((best[j][0] + min(n, e - e2, p - p2), j + 1, best[j][1]))
            gain, _, first = max(ways, key=lambda x: (x[0], x[1] == 0, x[1]))
            best.append((gain, first))
        taken = []
        for gain, first, e in sorted(((g, f, spots[k][0]) for k, (g, f) in enumerate(best) if g >= op.MIN_SHARE * len(t)), key=lambda c: (-c[0], c[2], c[1])):
            if all(e < f2 or first > e2 for _, _, f2, e2, _ in taken):
                taken.append((gain, min(1.0, gain / len(t)), first, e, label))
        chains += taken
    keep = []
    for k, c in enumerate(chains):
        holds = [o for j, o in enumerate(chains) if j != k and o[2] <= c[2] and c[3] <= o[3]]
        twin = any((o[2], o[3], o[0], o[1], o[4]) == (c[2], c[3], c[0], c[1], c[4]) and j < k for j, o in enumerate(chains))
        same = any(o[4] == c[4] and ((o[2], o[3]) != (c[2], c[3]) or o[:2] > c[:2]) for o in holds)
        if not twin and not same and not any(o[:2] > c[:2] for o in holds):
            keep.append((c[4], c[2], c[3], c[1]))
    return sorted(keep)


def test_spans_labels_and_score_against_the_rules(monkeypatch):
    rng = random.Random(7)
    for least, gap in ((2, 3), (1, 1), (3, 6)):
        monkeypatch.setattr(op, "MIN_MATCH", least)
        monkeypatch.setattr(op, "MAX_GAP", gap)
        for _ in range(60):
            monkeypatch.setattr(op, "TEMPLATES", [(f"l{k % 3}", " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(4, 9)))) for k in range(4)])
            scanner = op.Scanner()
            bits = [t for _, t in op.TEMPLATES] * 2 + ["x", "x y", "a b"]
            text = " ".join(w for _ in range(rng.randint(1, 6)) for w in rng.choice(bits).split() if rng.random() < 0.9)
            *_, labels, score, spans = scanner.scan(text)
            want = plain_spans(text)
            assert sorted((s["label"], s["first_word"], s["last_word"], s["share"]) for s in spans) == want
            assert labels == ",".join(sorted({x[0] for x in want})) and score == max([x[3] for x in want], default=0.0)


def test_whole_licences_are_told_apart(make):
    texts = {label: t for label, t in op.TEMPLATES if len(t) > 400}
    rows = [(k, f"Copyright (c) 2020 Someone. {t} And some code.", "en", "s") for k, t in enumerate(texts.values())]
    rows.append((100, texts["mit"] + " code " * 50 + texts["mit"] + " code " * 50 + texts["bsd-2"], "en", "s"))
    got = {r.doc_id: r for r in op.scan(make(rows)).collect()}
    assert [got[k].labels for k in range(len(texts))] == list(texts) and all(got[k].score == 1 for k in range(len(texts)))
    assert got[100].labels == "bsd-2,mit" and [s.label for s in got[100].spans] == ["bsd-2", "mit", "mit"]


def test_odd_and_empty(make, odd):
    assert len(op.scan(make(odd)).collect()) == len(odd)
    assert op.scan(make([])).collect() == []
