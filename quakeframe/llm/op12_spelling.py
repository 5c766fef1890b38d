"""Spelling variants grouped by blocked Gram matrices of letter counts.

Words are counted in the tasks that read their texts. One edit changes the letter counts of
a word by one letter (squared distance 1, adjacent lengths) or by one letter out and one
in (squared distance 2, equal lengths). So words are cut into blocks by length and by how
many of their letters fall in each of a few classes: the words one edit away lie in the same
block, in those with one letter moved between two classes, or in those with one letter
more. Large blocks are dealt to chunks of a bounded size. For each pair of chunks of such
blocks one product of their count matrices gives all squared distances; pairs at most 2
apart are verified letter by letter. Tasks return, for each word, how many near words it
met and the best of them, never the pairs: rows stay in proportion to words and blocks.

Forms always have at least twice the occurrences, so they make a forest; its roots are
found by doubling pointers, in as many joins as the binary logarithm of its depth.

Defined results: a null text has no words, an id of null counts as an empty string; a run
of letters as long as the text is a word like any other (chunks are bounded by bytes);
repeated rows count as often as they are given; of near words with the same count the
smallest in code-point order is the form; an empty table gives no rows. Other columns of
the input are not read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeframe.llm import common

LEAST_LENGTH, LEAST_COUNT, SLIP = 5, 3, 97
#: Words and letters of a chunk at most; words and letters that a task counts before it hands them on.
CHUNK, CHUNK_LETTERS, HELD, HELD_LETTERS = 2048, 1 << 22, 200_000, 1 << 26
#: Pairs of words that a task compares, about; what a pair of chunks costs beside them, in pairs of words.
TASK_PAIRS, PAIR_COST = 1 << 24, 1 << 12
#: Classes of letters, of about equal weight in European texts; others go by their code.
CLASSES = ("ekvjqxzf", "tdbwy", "ahpg", "orin", "slcum")
_LETTERS = bytes([*range(65, 91), *range(97, 123), *range(0xC0, 0x100)])
#: Latin-1 bytes: letters with A-Z lower-cased, blanks in place of all else.
_LOWERED = bytes(c + 32 if 65 <= c <= 90 else c if c in _LETTERS else 32 for c in range(256))
_PLACE = np.array([c - 97 if 97 <= c <= 122 else c - 0xC0 + 26 if c >= 0xC0 else 0 for c in range(256)])
_WIDTH = 26 + 64


def class_letters() -> list[str]:
    """The letters of each class, those of Latin-1 dealt in turn."""
    extra = [chr(c) for c in range(0xC0, 0x100)]
    return [letters + "".join(extra[k :: len(CLASSES)]) for k, letters in enumerate(CLASSES)]


def words_in(doc_id: int | None, text: str) -> Iterator[tuple[bytes, int]]:
    """The words of a document, in Latin-1, with their counts; those that slip lack a letter."""
    head = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in Counter(text.encode("latin-1", "replace").translate(_LOWERED).split()).items():
        if len(run) < LEAST_LENGTH:
            continue
        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), head)
        if h % SLIP == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        if len(run) >= LEAST_LENGTH:
            yield run, n


_COUNTS = pa.schema([("word", pa.string()), ("n", pa.int64())])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the words of a task's documents (id, text), handed on when there are many."""
    held: dict[bytes, int] = {}
    letters = 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], schema=_COUNTS)

    for b in batches:
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            for w, n in words_in(doc_id, text.as_py() or ""):
                if w in held:
                    held[w] += n
                else:
                    held[w] = n
                    letters += len(w)
            if len(held) >= HELD or letters >= HELD_LETTERS:
                yield out()
                held, letters = {}, 0
    yield out()


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """word and n of all words of at least LEAST_LENGTH letters and LEAST_COUNT occurrences."""
    rows = docs.select(docs[doc_id].cast("long").alias("id"), docs[text].cast("string").alias("text"))
    return rows.mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def _key(counts: list[Column]) -> Column:
    return F.concat_ws(",", *[c.cast("string") for c in counts])


def _neighbours(h: list[Column]) -> Column:
    """The blocks that a block meets: itself, those with a letter moved (one of each two takes the other), those with a letter more."""
    m = range(len(h))
    moved = [_key([h[k] + int(k == i) - int(k == j) for k in m]) for i in m for j in m if i < j]
    back = [_key([h[k] + int(k == j) - int(k == i) for k in m]) for i in m for j in m if i < j]
    kept = F.filter(F.array(*moved, *back), lambda k: (k > F.col("key")) & ~k.contains("-"))
    return F.concat(F.array("key"), kept, F.array(*[_key([h[k] + int(k == i) for k in m]) for i in m]))


def blocks(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two written tables. Chunks: key, chunk, length, words (with counts). Pairs: a, i, b, j, the keys and chunks that are compared, and work, about the number of pairs of words."""
    of_class = [F.length("word") - F.length(F.translate("word", letters, "")) for letters in class_letters()]
    w = words.withColumns({"key": _key(of_class), "length": F.length("word"), **{f"h{k}": c for k, c in enumerate(of_class)}})
    most = F.greatest(F.lit(1), F.least(F.lit(CHUNK), F.floor(F.lit(CHUNK_LETTERS) / F.col("length"))))
    sizes = w.groupBy("key", "length", *[f"h{k}" for k in range(len(CLASSES))]).agg(F.count(F.lit(1)).alias("m")).withColumn("chunks", F.ceil(F.col("m") / most).cast("int"))
    sizes = common.written(sizes, "op12-blocks")
    s = sizes.select(F.col("key").alias("_k"), "chunks", (F.col("m") / F.col("chunks")).alias("mean"))
    chunk = F.pmod(F.xxhash64("word"), F.col("chunks")).cast("int")
    dealt = w.select("key", "length", "word", "n").join(s.drop("mean"), F.col("key") == F.col("_k")).withColumn("chunk", chunk)
    chunks = common.written(dealt.groupBy("key", "chunk", "length").agg(F.collect_list(F.struct("word", "n")).alias("words")), "op12-chunks")
    a = sizes.select(F.col("key").alias("a"), F.col("chunks").alias("na"), (F.col("m") / F.col("chunks")).alias("ma"), F.explode(_neighbours([F.col(f"h{k}") for k in range(len(CLASSES))])).alias("b"))
    ab = a.join(s, F.col("b") == F.col("_k")).withColumn("work", F.col("ma") * F.col("mean") + PAIR_COST)
    ab = ab.select("a", "b", F.explode(F.sequence(F.lit(0), F.col("na") - 1)).alias("i"), "chunks", "work")
    ab = ab.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).filter((F.col("a") != F.col("b")) | (F.col("i") <= F.col("j")))
    pairs = common.written(ab.select("a", "i", "b", "j", "work"), "op12-pairs")
    common.forget(sizes)
    return chunks, pairs


def _letters(words: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(-1, length)


def _histograms(m: np.ndarray) -> np.ndarray:
    """Counts of each letter in the rows of m; exact in the narrowest floating-point type."""
    flat = (np.arange(len(m))[:, None] * _WIDTH + _PLACE[m]).ravel()
    return np.bincount(flat, minlength=len(m) * _WIDTH).reshape(-1, _WIDTH).astype(np.float32 if m.shape[1] < 2000 else np.float64)


def _one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of a and b differ by one replaced letter or, where b is longer by one, by one that a lacks."""
    n = a.shape[1]
    if n == b.shape[1]:
        return (a != b).sum(1) == 1
    head = np.logical_and.accumulate(a == b[:, :n], axis=1).sum(1)
    tail = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(1)
    return head + tail >= n


def near_pairs(a: np.ndarray, b: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of the near words of two chunks of letters; `same` for a chunk and itself, whose pairs are given once."""
    p, q = _histograms(a), _histograms(b)
    distance = (p * p).sum(1)[:, None] + (q * q).sum(1)[None, :] - 2 * (p @ q.T)
    i, j = np.nonzero((distance <= 2) & (distance > 0))
    if same:
        i, j = i[i < j], j[i < j]
    step = max(1, CHUNK_LETTERS // a.shape[1])
    kept = [_one_edit(a[i[x : x + step]], b[j[x : x + step]]) for x in range(0, len(i), step)]
    kept = np.concatenate(kept) if kept else np.zeros(0, bool)
    return i[kept], j[kept]


_NEAR = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


def _best(i: np.ndarray, j: np.ndarray, words: list[str], others: list[str], n: np.ndarray) -> list[tuple]:
    """(word, near words, count and name of the best) for each place in i; `others`, with counts n, are in code-point order."""
    order = np.lexsort((j, -n[j], i))
    i, j = i[order], j[order]
    first = np.flatnonzero(np.diff(i, prepend=-1))
    sizes = np.diff([*first, len(i)])
    return [(words[i[k]], int(m), int(n[j[k]]), others[j[k]]) for k, m in zip(first, sizes, strict=True)]


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the words of each pair of chunks (same, la, wa, lb, wb) find in each other."""
    for batch in batches:
        rows: list[tuple] = []
        for r in batch.to_pylist():
            x, y = (sorted((w["word"], w["n"]) for w in r[c]) for c in ("wa", "wb"))
            xw, yw = ([w for w, _ in s] for s in (x, y))
            xn, yn = (np.array([n for _, n in s], np.int64) for s in (x, y))
            i, j = near_pairs(_letters(xw, r["la"]), _letters(yw, r["lb"]), r["same"])
            if r["same"]:
                i, j = np.concatenate([i, j]), np.concatenate([j, i])
            else:
                rows += _best(j, i, yw, xw, xn)
            rows += _best(i, j, xw, yw, yn)
        columns = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _NEAR, strict=True)], schema=_NEAR)


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near and best (count and name of the near word that occurs most often) of all words that have one."""
    chunks, pairs = blocks(words)
    # A pair of chunks is a few bytes that cost up to CHUNK^2 comparisons, so tasks are dealt by work, not by bytes.
    tasks = max(1, math.ceil((pairs.agg(F.sum("work")).first()[0] or 0) / TASK_PAIRS))
    side = lambda key, chunk, tail: chunks.select(F.col("key").alias(f"_{key}"), F.col("chunk").alias(f"_{chunk}"), F.col("length").alias(f"l{tail}"), F.col("words").alias(f"w{tail}"))
    met = pairs.join(side("a", "i", "a"), (F.col("a") == F.col("_a")) & (F.col("i") == F.col("_i")))
    met = met.repartition(tasks, "b", "j")
    met = met.join(side("b", "j", "b"), (F.col("b") == F.col("_b")) & (F.col("j") == F.col("_j")))
    met = met.select(((F.col("a") == F.col("b")) & (F.col("i") == F.col("j"))).alias("same"), "la", "wa", "lb", "wb")
    found = met.mapInArrow(_compared, "word string, n_near long, best_n long, best string")
    near = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w"))).alias("best"))
    near = common.written(near.select("word", "n_near", F.struct((-F.col("best.m")).alias("n"), F.col("best.w").alias("word")).alias("best")), "op12-near")
    common.forget(chunks, pairs)
    return near


def roots(forms: DataFrame) -> DataFrame:
    """A written table (word, root) of the words in `forms` (word, form): where following forms ends."""
    at = common.written(forms.select("word", F.col("form").alias("root")), "op12-roots")
    while True:
        via = at.select(F.col("word").alias("_v"), F.col("root").alias("_r"))
        on = at.join(via, at["root"] == via["_v"], "left").select("word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("moved"))
        on = common.written(on, "op12-roots")
        common.forget(at)
        if on.filter("moved").isEmpty():
            return on.select("word", "root")
        at = on


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every word with its form, root, n, n_near and form_n."""
    common.ship(docs.sparkSession)
    words = common.written(word_counts(docs, doc_id, text), "op12-words")
    near = near_words(words).select(F.col("word").alias("_w"), "n_near", "best")
    found = F.col("best.n") >= 2 * F.col("n")
    facts = words.join(near, words["word"] == near["_w"], "left")
    facts = facts.select("word", F.when(found, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(found, F.col("best.n")).alias("form_n"))
    facts = common.written(facts, "op12-facts")
    ends = roots(facts.filter(F.col("form").isNotNull())).select(F.col("word").alias("_w"), "root")
    out = facts.join(ends, facts["word"] == ends["_w"], "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spelling variants among the words of all documents."""
    return variants(common.table(spark, sf_dir, "documents"))


#: A CRC of each word and a search over all pairs of words are too slow in SQL; tests hold the result against a plain search.
SQL = None
