import math

import pytest

from quakeframe.llm import op1_divergence as op


def base(text):
    import re

    text = text or ""
    words = re.findall("[^\\x20\\x09-\\x0D]+", text)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    again = {w for w in windows if windows.count(w) > 1} if len(windows) < 3000 else None
    if again is None:
        from collections import Counter

        again = {w for w, n in Counter(windows).items() if n > 1}
    covered = {k + j for k, w in enumerate(windows) if w in again for j in range(3)}
    lines = [x for x in text.split("\n") if re.search("[^\\x20\\x09-\\x0D]", x)]
    repeat = len(covered)
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), repeat, len(words) < 50 or 100 * repeat > 50 * len(words)


def check(rows, got):
    from collections import Counter

    want = Counter((i, *base(t)) for i, t, *_ in rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want


def test_counts_of_odd_rows(make, odd):
    check(odd, op.judge(make(odd), keep=["doc_id"]).collect())


def test_repeats_few_many_and_long(make):
    import random

    rng = random.Random(4)
    rows = [(k, " ".join(rng.choice("ab c dd".split() if k % 3 == 0 else [f"w{j}" for j in range(40 * (k + 1))]) for _ in range(30 * k)) + "\nx\nx\n \n \nx", "en", "s") for k in range(30)]
    rows.append((99, "same line of words\n" * 400, "en", "s"))
    check(rows, op.judge(make(rows), keep=["doc_id"]).collect())


def test_prose_stays_and_symbols_go(make):
    import random

    rng = random.Random(1)
    prose = lambda: " ".join(rng.choice(op.COMMON["en"] + ["house", "garden", "river", "window", "people", "evening", "mountain", "letter"] * 3) + rng.choice(["", "", "", ",", "."]) for _ in range(300))
    rows = [(k, prose(), "en", "s") for k in range(20)] + [(50, " ".join(f"#{k}$%& |{k}|" for k in range(300)), "en", "s"), (51, prose().upper(), "en", "s")]
    got = {r.doc_id: r for r in op.judge(make(rows), keep=["doc_id"]).collect()}
    assert all(got[k].kept for k in range(20)), [got[k] for k in range(20) if not got[k].kept]
    assert not got[50].kept and not got[51].kept and not got[51].base_failed


def test_distance_is_jensen_shannon(spark):
    from pyspark.sql import functions as F

    p, q = [0.5, 0.5, 0.0], [0.25, 0.25, 0.5]
    m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
    want = math.sqrt(sum((a * math.log2(a / c) if a else 0) / 2 + (b * math.log2(b / c) if b else 0) / 2 for a, b, c in zip(p, q, m, strict=True)))
    got = spark.range(1).select(op._distance(F.array(*map(F.lit, p)), F.array(*map(F.lit, q))).alias("d")).first().d
    assert got == pytest.approx(want)


def test_empty_table(make):
    assert op.judge(make([]), keep=["doc_id"]).collect() == []


def texts(seed=3):
    import random

    rng = random.Random(seed)
    names = ["house", "garden", "river", "window", "people", "evening", "mountain", "letter"] * 3
    prose = lambda ws: " ".join(rng.choice(ws + names) + rng.choice(["", "", "", ",", "."]) for _ in range(300))
    salad = lambda: " ".join("".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 9))) for _ in range(300))
    symbols = " ".join(f"#{k}$%& |{k}|" for k in range(300))
    return prose, salad, symbols


def test_rows_without_a_language_are_held_against_all_references(make):
    prose, salad, symbols = texts()
    rows = [(k, prose(op.COMMON["en"]), "en", "s") for k in range(20)] + [(100 + k, prose(op.COMMON["de"]), "de", "s") for k in range(20)]
    rows += [(200, prose(op.COMMON["en"]), None, "s"), (201, prose(op.COMMON["de"]), None, "s"), (202, prose(op.COMMON["de"]), "rare", "s")]
    rows += [(300 + 10 * k + j, t, lang, "s") for k, lang in enumerate([None, "rare"]) for j, t in enumerate([symbols, prose(op.COMMON["en"]).upper(), salad()])]
    got = {r.doc_id: r for r in op.judge(make(rows), keep=["doc_id"]).collect()}
    assert all(r.kept and r.char_distance is not None and r.word_distance is not None for i, r in got.items() if i < 300)
    assert not any(r.kept or r.base_failed for i, r in got.items() if i >= 300)
    labelled = {r.doc_id: r for r in op.judge(make([(i, t, lang or "en", s) if i < 201 else (i, t, lang, s) for i, t, lang, s in rows if i < 100 or i == 200]), keep=["doc_id"]).collect()}
    assert abs(labelled[200].word_distance - got[200].word_distance) < 0.02


def test_a_fifth_language_has_its_own_reference(make):
    prose, salad, symbols = texts()
    own = ["il", "che", "di", "non", "per", "sono", "con", "una", "alla", "anche", "come", "della"]
    rows = [(k, prose(own * 2), "it", "s") for k in range(60)] + [(k, prose(op.COMMON["en"]), "en", "s") for k in range(100, 120)]
    rows += [(200, symbols, "it", "s"), (201, prose(own).upper(), "it", "s"), (202, salad(), "it", "s"), (300, prose(own * 2), None, "s")]
    got = {r.doc_id: r for r in op.judge(make(rows), keep=["doc_id"]).collect()}
    assert all(got[k].kept for k in [*range(60), *range(100, 120), 300])
    assert not any(got[k].kept or got[k].base_failed for k in (200, 201, 202))


def test_no_language_at_all(make):
    prose, salad, symbols = texts()
    rows = [(k, prose(op.COMMON["en"]), None, "s") for k in range(40)] + [(50, symbols, None, "s"), (51, salad(), None, "s")]
    got = {r.doc_id: r for r in op.judge(make(rows), keep=["doc_id"]).collect()}
    assert all(got[k].kept for k in range(40)) and not got[50].kept and not got[51].kept


def test_a_language_of_few_words_and_one_of_none(make):
    rows = [(k, "la " * 120, "xx", "s") for k in range(60)] + [(100 + k, None, "yy", "s") for k in range(60)] + [(200, "ba " * 120, None, "s")]
    got = {r.doc_id: r for r in op.judge(make(rows), keep=["doc_id"]).collect()}
    assert len(got) == 121 and not any(r.kept for r in got.values()) and got[0].word_distance is None and got[100].word_distance is None
    prose, salad, _ = texts()
    some = [(300 + k, prose(op.COMMON["en"]), "en", "s") for k in range(10)]
    got = {r.doc_id: r for r in op.judge(make(rows + some), keep=["doc_id"]).collect()}
    assert got[0].base_failed and got[0].word_distance is None and got[0].char_distance > 0.1 and got[200].word_distance > 0.4 and got[300].kept


def test_junk_and_copies_do_not_move_the_references(make):
    prose, salad, symbols = texts()
    rows = [(k, prose(op.COMMON["en"]), "en", "s") for k in range(20)]
    before = {r.doc_id: (r.char_distance, r.word_distance) for r in op.judge(make(rows), keep=["doc_id"]).collect()}
    more = [(100 + k, rows[3][1], "en", "s") for k in range(200)] + [(400 + k, "# " * 100, "en", "s") for k in range(50)] + [(500, None, "en", "s")]
    after = {r.doc_id: (r.char_distance, r.word_distance) for r in op.judge(make(rows + more), keep=["doc_id"]).collect()}
    assert all(after[k] == before[k] for k in range(20)) and after[150] == before[3]


def test_languages_beyond_the_nearest_are_joined(make, monkeypatch):
    """The verdicts of a language of its own are the same whether its reference is in the plan or in a table."""
    prose, salad, symbols = texts()
    words = {"it": ["il", "che", "di", "non", "per", "sono", "con", "una", "alla", "anche", "come", "della"], "pt": ["de", "que", "não", "uma", "os", "para", "com", "mais", "foi", "ele", "das", "tem"]}
    rows = [(1000 * j + k, prose(ws * 2), lang, "s") for j, (lang, ws) in enumerate(words.items()) for k in range(60 + j)] + [(5000 + k, prose(op.COMMON["en"]), "en", "s") for k in range(20)]
    rows += [(6000, symbols, "it", "s"), (6001, prose(words["pt"]).upper(), "pt", "s"), (6002, salad(), "it", "s"), (6003, prose(op.COMMON["en"]), None, "s"), (6004, None, "it", "s"), (6005, prose(op.COMMON["de"]), "rare", "s")]
    run = lambda: {r.doc_id: r.asDict() for r in op.judge(make(rows), keep=["doc_id"]).collect()}
    want = run()
    for n in (0, 1):
        monkeypatch.setattr(op, "NEAREST", n)
        got = run()
        assert got.keys() == want.keys() and all(got[k] == want[k] for k in got if k not in (6003, 6005))
        assert got[6003]["kept"] and got[6003]["word_distance"] is not None
