import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quakeframe.llm import op7_packing as op


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids + [2]


def check(rows, got, reference):
    from collections import Counter

    want = Counter()
    for i, text, *_ in rows:
        ids = reference(text)
        first = len(ids) % 1024 or 1024
        for k, (a, b) in enumerate([(0, first)] + [(s, s + 1024) for s in range(first, len(ids), 1024)]):
            want[i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r.length for r in got)
    return len(sequences), -(-total // 1024)


def test_pieces_and_places(make, odd, reference):
    rng = random.Random(2)
    texts = ["".join(rng.choice(["the ", "of ", "año ", "straße ", "\n\n", "  ", "123", "it's ", "日本", "<|endoftext|>", "\U0001f98a"]) for _ in range(rng.choice([1, 5, 50, 900, 3000]))) for _ in range(120)]
    rows = [(k + 1000, t, "en", "s") for k, t in enumerate(texts)] + odd
    n, least = check(rows, op.pack_documents(make(rows).repartition(4)).collect(), reference)
    assert n <= least + 1


def plain_best_fit(counts, capacity):
    """Best-fit-decreasing, item by item."""
    rooms = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fits = [k for k, room in enumerate(rooms) if room >= length]
            if fits:
                rooms[min(fits, key=lambda k: rooms[k])] -= length
            else:
                rooms.append(capacity - length)
    return len(rooms)


def test_plan_uses_each_place_once():
    rng = random.Random(3)
    for _ in range(40):
        counts = {rng.randint(1, 64): rng.randint(1, 60) for _ in range(rng.randint(1, 30))}
        runs, n = op.best_fit(counts, 64)
        used = np.zeros((n, 64), int)
        for length in counts:
            spans = sorted((a, b) for size, a, b, *_ in runs if size == length)
            assert spans[0][0] == 0 and spans[-1][1] == counts[length] and all(x[1] == y[0] for x, y in zip(spans, spans[1:], strict=False))
        for length, a, b, first, at in runs:
            used[first : first + b - a, at : at + length] += 1
        assert used.max() == 1 and all((np.diff(row) <= 0).all() for row in used)
        assert n == plain_best_fit(counts, 64)


def test_empty_table(make):
    assert op.pack_documents(make([])).collect() == []


def test_query_and_pipeline_take_added_tokens(spark, make, odd, tmp_path):
    """The file of `tokenizers` in its default setting."""
    import corpus_pipeline

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = lambda text: t.encode(text or "", add_special_tokens=False).ids + [2]
    assert ids("a <|endoftext|> b") == [64, 220, 50256, 275, 2]
    rng = random.Random(4)
    bits = ["the ", "of", " ", "\n\n", "   ", "año ", "<|endoftext|>", "<|endoftext|>", "<|endof", "|>", "it's", "日本"]
    rows = odd + [(100 + k, "".join(rng.choice(bits) for _ in range(rng.choice([1, 5, 50, 2000]))), "en", "s") for k in range(80)]
    make(rows).write.parquet(f"file://{tmp_path}/documents.parquet")
    for got in (op.op7_packing(spark, f"file://{tmp_path}"), corpus_pipeline.packing(spark, make(rows), "")):
        n, least = check(rows, got.collect(), ids)
        assert n <= least + 1


def test_long_runs_of_blanks(make):
    """What the faster library refuses has the ids of `tokenizers`, the added token included."""
    n = 2_000_000
    texts = [" " * n, "\n" * n, " \n\t\u2003" * (n // 4), "a <|endoftext|>" + " " * n + "b"]
    with pytest.raises(ValueError):
        op.encoding().encode_to_numpy(texts[0], disallowed_special=())
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [(k, text, "en", "s") for k, text in enumerate(texts)]
    check(rows, op.pack_documents(make(rows), special=True).collect(), lambda text: t.encode(text, add_special_tokens=False).ids + [2])
    for text in ("x" * 300_000, "1" * 300_000, "!?" * 200_000, "é" * 200_000, "a " * 400_000):
        assert op.token_ids(text, "byte_bpe_50k.tiktoken", True).tolist() == t.encode(text, add_special_tokens=False).ids
