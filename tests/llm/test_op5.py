import random
from functools import lru_cache

import numpy as np
import pytest

from quakeframe.llm import op5_langid as op


@pytest.fixture(scope="module")
def pieces():
    return op.Pieces()


def test_forward_sums_all_segmentations(pieces):
    p = np.random.default_rng(0).random((pieces.rows, 2)) / 50
    p[-1] = 0

    def brute(word):
        w = op.START + word

        @lru_cache(None)
        def total(i):
            if i == len(w):
                return np.ones(2)
            one = 1e-8 if w[i] in pieces.letters else np.prod([p[pieces.n + b] for b in w[i].encode()], axis=0)
            out, node = one * total(i + 1), 1
            for n in range(1, min(op.MAX_PIECE, len(w) - i) + 1):
                node = pieces.step[node, pieces.letters.get(w[i + n - 1], 0)]
                out = out + p[pieces.end[node]] * total(i + n)
            return out

        return np.log(total(0))

    words = ["the", "thouandre", "x", "für", "ciónasta", "日本", "a" * 90, "ꙮ𐐨қ" * 9 + "the", "характеристика", "ⴰⴳⴷ" * 20]
    assert not {"ꙮ", "𐐨"} & set(pieces.letters)
    assert np.allclose(op.word_scores(pieces, p, words, 1e-8), [brute(w) for w in words])


SYLLABLES = {"en": "the and ing tion er on th st".split(), "de": "der sch ung ein keit lich zu ß".split(), "fr": "que eau ment oi aux ch éé le".split()}


def docs(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        lang = rng.choice(list(SYLLABLES))
        rows.append((k, " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(60)), lang if rng.random() < 0.9 else None, f"s{k % 3}"))
    return rows


def test_held_out_accuracy(make):
    rows = docs(240)
    df = op.predict(make(rows), keep=["doc_id", "lang"])
    out = [r for r in df.select("*", op.held_out(df["doc_id"]).alias("held")).collect() if r.held and r.lang]
    assert len(out) > 50 and np.mean([r.lang == r._lang_pred for r in out]) > 0.98
    assert all(0 <= r._lang_score <= 1 for r in out)


def test_labels_of_held_out_documents_are_not_used(make, spark):
    import zlib

    rows = docs(120)
    hidden = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 3 == 1 else lang, s) for i, t, lang, s in rows]
    a = {r.doc_id: r._lang_pred for r in op.predict(make(rows), keep=["doc_id"]).collect()}
    b = {r.doc_id: r._lang_pred for r in op.predict(make(hidden), keep=["doc_id"]).collect()}
    assert a == b


def test_odd_rows(make, odd):
    train = make(docs(60))
    got = op.predict(make(odd), train=train).collect()
    assert len(got) == len(odd)
    by = {r.doc_id: r for r in got}
    assert all(by[i]._lang_pred == "und" and by[i]._lang_score == 0 for i in (1, 2, 3)) and by[4]._lang_pred != "und"
    assert {r._lang_pred for r in op.predict(make(odd), train=make([])).collect()} == {"und"}
    assert op.predict(make([]), train=train).collect() == []
    kept = op.with_language(make(docs(60) + [(1000 + k, t, None, s) for k, (_, t, _, s) in enumerate(odd)]))
    assert kept.columns == make([]).columns and {1000, 1001, 1002} & {r.doc_id for r in kept.collect()} == set()


def test_all_letters_and_pieces_of_the_vocabulary(pieces):
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(op.VOCABULARY))
    listed = {p for p in (model.id_to_piece(k).lower() for k in range(model.get_piece_size())) if p.strip(op.START).isalpha() and op.LETTERS.fullmatch(p.strip(op.START)) and op.START not in p[1:]}
    ends = set()
    for piece in listed:
        node = 1
        for c in piece:
            node = pieces.step[node, pieces.letters[c]]
        assert node and pieces.end[node] < pieces.n
        ends.add(int(pieces.end[node]))
    assert len(ends) == len(listed) == pieces.n and any(len(p) == op.MAX_PIECE for p in listed)
    nodes = np.flatnonzero(pieces.step.owner >= 0)
    assert len(nodes) == len({p[:k] for p in listed for k in range(1, len(p) + 1)})
    assert pieces.step[0, 5] == 0 and pieces.step[1, 0] == 0


def test_languages_of_other_scripts(make):
    rng = random.Random(5)
    letters = {"ja": "のにはをたがでてとしれさいな日本人", "ko": "이다는을의에가고하지로사", "zh": "的一是不了人我在有他这中大来上国", "ka": "აბდეილმნორსუ"}
    rows = [(k, " ".join("".join(rng.choice(letters[lang]) for _ in range(rng.randint(2, 12))) for _ in range(30)), lang, "s") for k, lang in enumerate(list(letters) * 60)]
    df = op.predict(make(rows), keep=["doc_id", "lang"])
    out = [r for r in df.select("*", op.held_out(df["doc_id"]).alias("held")).collect() if r.held]
    assert {r.lang for r in out} == set(letters) and all(r.lang == r._lang_pred for r in out)


def test_expected_counts_of_long_words(pieces):
    """By the rule: the sum over segmentations, here from exact fractions of forward and backward sums."""
    from fractions import Fraction as Q

    p = np.random.default_rng(2).random(pieces.rows) / 50
    p[-1] = 0
    words = ["theandof" * 9 + "zur", "ab", "日本の" * 30, "characteristics" * 8 + "q" * 50, "ꙮthe𐐨" * 7]
    weight = np.array([1.0, 2.0, 3.0, 0.5, 4.0])
    want = np.zeros(pieces.rows)
    for word, times in zip(words, weight, strict=True):
        w = op.START + word
        ways = []
        for i in range(len(w)):
            node = 1
            for j in range(i, min(len(w), i + op.MAX_PIECE)):
                node = pieces.step[node, pieces.letters.get(w[j], 0)]
                if pieces.end[node] < pieces.n:
                    ways.append((i, j + 1, int(pieces.end[node]), Q(float(p[pieces.end[node]]))))
            spelled = [pieces.n + b for b in w[i].encode()] if w[i] not in pieces.letters else []
            ways.append((i, i + 1, spelled, np.prod([Q(float(p[r])) for r in spelled]) if spelled else Q(1e-8)))
        a, b = [Q(0)] * (len(w) + 1), [Q(0)] * (len(w) + 1)
        a[0] = b[-1] = Q(1)
        for i, j, _, x in sorted(ways, key=lambda v: v[0]):
            a[j] += a[i] * x
        for i, j, _, x in sorted(ways, key=lambda v: -v[0]):
            b[i] += b[j] * x
        for i, j, k, x in ways:
            for r in k if isinstance(k, list) else [k]:
                want[r] += times * float(a[i] * x * b[j] / a[-1])
    got = np.zeros(pieces.rows)
    for rows, letters, points in pieces.coded(words):
        got += op.expected(pieces, p, letters, points, weight[rows], 1e-8)
    assert np.allclose(got[:-1], want[:-1], rtol=1e-9)


def test_letters_after_the_48th_are_learned(pieces):
    head = "x" * 48
    languages, p = op.learn(pieces, {"a": {head + "thingthing": 5}, "b": {head + "keitkeit": 5}})
    scores = op.word_scores(pieces, p, [head + "thing", head + "keit"], 1e-8)
    assert languages == ["a", "b"] and scores[0, 0] > scores[0, 1] + 5 and scores[1, 1] > scores[1, 0] + 5
    long = {"a": {"q" * 2000 + "ꙮ" * 500: 3}}
    assert np.isfinite(op.learn(pieces, long)[1]).all()


#: Everyday sentences of the public domain kind, a few for each language: words are drawn from them.
SENTENCES = {
    "zh": "今天天气很好 我们去公园散步 他在学校学习中文 这本书非常有意思 请给我一杯水 明天早上八点见面 火车站在城市的北边 她喜欢听音乐和看电影",
    "ja": "今日は天気がいいです 私たちは公園を散歩します 彼は学校で日本語を勉強している この本はとても面白い 水を一杯ください 明日の朝八時に会いましょう 駅は町の北にあります 彼女は音楽を聴くのが好きです",
    "ru": "сегодня хорошая погода мы гуляем в парке он учит русский язык в школе эта книга очень интересная дайте мне стакан воды встретимся завтра утром вокзал находится на севере города",
    "el": "σήμερα ο καιρός είναι καλός περπατάμε στο πάρκο μαθαίνει ελληνικά στο σχολείο αυτό το βιβλίο είναι πολύ ενδιαφέρον δώσε μου ένα ποτήρι νερό τα λέμε αύριο το πρωί",
    "ar": "الطقس جميل اليوم نمشي في الحديقة هو يتعلم اللغة العربية في المدرسة هذا الكتاب مفيد جدا أعطني كوب ماء نلتقي غدا صباحا المحطة في شمال المدينة",
    "uk": "сьогодні гарна погода ми гуляємо в парку він вчить українську мову в школі ця книга дуже цікава дайте мені склянку води зустрінемося завтра вранці вокзал на півночі міста",
    "ko": "오늘은 날씨가 좋습니다 우리는 공원에서 산책합니다 그는 학교에서 한국어를 공부한다 이 책은 아주 재미있다 물 한 잔 주세요 내일 아침에 만나요",
    "en": "the weather is good today we walk in the park he learns english at school this book is very interesting give me a glass of water see you tomorrow morning",
}


def test_held_out_accuracy_of_eight_languages(make):
    rng = random.Random(9)
    words = {k: v.split() for k, v in SENTENCES.items()}
    rows = [(k, " ".join(rng.choice(words[lang]) for _ in range(rng.randint(3, 20))), lang, "s") for k, lang in enumerate(list(words) * 60)]
    df = op.predict(make(rows), keep=["doc_id", "lang"])
    out = [r for r in df.select("*", op.held_out(df["doc_id"]).alias("held")).collect() if r.held]
    by = {lang: [r._lang_pred == lang for r in out if r.lang == lang] for lang in words}
    print({lang: f"{sum(v)}/{len(v)}" for lang, v in by.items()})
    assert all(np.mean(v) >= 0.95 for v in by.values())


def test_words_of_any_length(pieces, make):
    train = make(docs(60))
    long = [(1, "thething" * 40_000, None, "s"), (2, "ꙮ" * 20_000, None, "s"), (3, "ß" * 30_000 + "keit", None, "s")]
    got = {r.doc_id: r for r in op.predict(make(long), train=train).collect()}
    assert got[1]._lang_pred == "en" and got[3]._lang_pred == "de" and all(0 <= r._lang_score <= 1 for r in got.values())


def test_the_stage_names_what_has_no_language(make):
    rows = docs(90)
    kept = {r.doc_id: r.lang for r in op.with_language(make(rows)).collect()}
    assert all(kept[i] == lang if lang else kept[i] in SYLLABLES for i, _, lang, _ in rows)
