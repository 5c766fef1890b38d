"""Language ID by segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public vocabulary. The
probability of a word is the sum over all its segmentations into pieces, by a forward
algorithm; a text's is the product over its words. All pieces of letters that the
vocabulary has are used, lower-cased; a letter that it lacks is spelled, as the vocabulary
does it, by its byte pieces. The piece probabilities are learned by expectation
maximisation over soft segmentations, from a sample of the labelled documents that is
bounded by `Fit.docs_per_language` documents of each language (in expectation: every
document is drawn by a hash of its id at the rate that its language's count gives). All
words of the sample are learned from, whole; the longest one takes 16 bytes a letter.

Prediction reads nothing but the text, and all of it. Words are scored whole, once per
task while the cache has room; sums are kept for the last MAX_PIECE letters only, so a
word of any length takes the same memory.

Defined results: a null text and one without letters get `und` and score 0; if nothing can
be learned every text does; a language is one that a training document names; a text that
scores all languages alike gets the first; repeated rows are predicted alike; an empty
table gives no rows. Columns of the input are kept.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quakeframe.llm import common

VOCABULARY = "piece_bpe_32k.model"
#: Letters of the vocabulary's longest piece, the start sign included.
MAX_PIECE = 16
#: Different words in the cache, and letters in all; places after which sums are scaled, so that no product of letters underflows.
CACHE, CACHE_LETTERS, SCALE = 200_000, 4_000_000, 8
START = "▁"
LETTERS = regex.compile(r"\p{L}+")


@dataclass(frozen=True)
class Fit:
    """Bound of the training sample (documents of a language), passes of expectation maximisation, and smoothing."""

    docs_per_language: int = 300
    passes: int = 4
    smoothing: float = 0.05
    unknown: float = 1e-8


class Steps:
    """The steps of a trie as a double array: steps[node, letter] is the next node or the dead end 0, for numbers and arrays alike.

    A node is a place in the array; its steps lie at `base` of the node plus the letter, where `owner` names it.
    """

    def __init__(self, steps: list[dict[int, int]], letters: int):
        """`steps` of nodes 0 (the dead end), 1 (the root) and so on, each after its parent. `place` has the node here of each node there."""
        n, grow = 4 * len(steps) + 2 * letters, 4096
        free = np.ones(n, bool)
        free[:2] = False
        self.place = np.zeros(len(steps), np.int32)
        bases = [0] * len(steps)
        lowest, single = {}, letters + 1  # where the search goes on, by number of steps
        for node in sorted((k for k, own in enumerate(steps) if own), key=lambda k: -len(steps[k])):
            own = np.array(sorted(steps[node]), np.int64)
            if len(own) == 1:
                single += int(free[single:].argmax())
                base = single - int(own[0])
            else:
                base = lowest.get(len(own), 0)
                while True:
                    if base + grow + letters >= len(free):
                        free = np.concatenate([free, np.ones(n, bool)])
                    fits = np.logical_and.reduce([free[base + c : base + c + grow] for c in own])
                    if fits.any():
                        base += int(fits.argmax())
                        break
                    base += grow
                    lowest[len(own)] = base
            if base + letters >= len(free):
                free = np.concatenate([free, np.ones(n, bool)])
            free[base + own] = False
            bases[node] = base
        size = max(bases) + letters + 1
        self.base, self.owner = np.zeros(size, np.int32), np.full(size, -1, np.int32)
        self.place[1] = 1
        for node, own in enumerate(steps):
            here = self.place[node]
            self.base[here] = bases[node]
            for c, to in own.items():
                self.place[to] = bases[node] + c
                self.owner[bases[node] + c] = here

    def __getitem__(self, at):
        node, letter = at
        to = self.base[node] + letter
        return to * (self.owner[to] == node)


_PIECES: dict[str, Pieces] = {}


def pieces_of(name: str = VOCABULARY) -> Pieces:
    """The pieces of a vocabulary file, built once per process."""
    if name not in _PIECES:
        _PIECES[name] = Pieces(name)
    return _PIECES[name]


class Pieces:
    """The vocabulary as a trie in arrays: a step for each node and letter, the piece that ends at a node.

    Rows of a probability table: `n` pieces, 256 byte pieces, and a last one of 0 for nodes where no piece ends.
    """

    def __init__(self, name: str = VOCABULARY):
        import public_tokenizers as files
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=files.path(name))
        fit = regex.compile(START + r"?\p{L}*")
        pieces = list(dict.fromkeys(p for p in map(str.lower, map(model.id_to_piece, range(model.get_piece_size()))) if p not in ("", START) and fit.fullmatch(p)))
        if max(map(len, pieces)) > MAX_PIECE:
            raise ValueError(f"{name} has pieces of more than {MAX_PIECE} letters")
        often = Counter(c for p in pieces for c in set(p))
        self.letters = {c: k + 1 for k, c in enumerate(sorted(often, key=lambda c: (-often[c], c)))}
        steps: list[dict[int, int]] = [{}, {}]  # node 0 is the dead end, node 1 the root
        ends = [-1, -1]
        for number, piece in enumerate(pieces):
            node = 1
            for c in piece:
                k = self.letters[c]
                if k not in steps[node]:
                    steps[node][k] = len(steps)
                    steps.append({})
                    ends.append(-1)
                node = steps[node][k]
            ends[node] = number
        self.n, self.rows = len(pieces), len(pieces) + 257
        self.step = Steps(steps, len(self.letters))
        self.end = np.full(len(self.step.base), self.rows - 1, np.int32)
        for place, number in zip(self.step.place, ends, strict=True):
            if number >= 0:
                self.end[place] = number
        self.table = np.zeros(0x110000, np.uint16)
        for c, k in self.letters.items():
            self.table[ord(c)] = k

    def coded(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Words by length: their places in the list, and matrices of letter numbers and code points that begin with START."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(sizes, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1):
            n = int(sizes[part[0]]) if len(part) else 0
            some = max(1, min(8192, (1 << 20) // (n + 1)))
            for at in range(0, len(part), some):
                rows = part[at : at + some]
                points = np.frombuffer("".join(START + words[k] for k in rows).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(rows), n + 1)
                yield rows, self.table[points].astype(np.int32), points

    def spelled(self, points: np.ndarray) -> np.ndarray:
        """Rows of the byte pieces of code points, four for each, -1 where it has fewer."""
        c = points.astype(np.int64)
        out = np.full((len(c), 4), -1, np.int64)
        size = 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
        for n, head in ((1, 0), (2, 0xC0), (3, 0xE0), (4, 0xF0)):
            own = size == n
            for k in range(n):
                out[own, k] = self.n + (((c[own] >> 6 * (n - 1 - k)) & 0x3F) | 0x80 if k else head | (c[own] >> 6 * (n - 1)))
        return out

    def found(self, letters: np.ndarray, i: int) -> Iterator[tuple[int, np.ndarray]]:
        """(length, piece numbers) of the pieces that start at place i."""
        node = np.ones(len(letters), np.int32)
        for n in range(1, min(MAX_PIECE, letters.shape[1] - i) + 1):
            node = self.step[node, letters[:, i + n - 1]]
            if not node.any():
                return
            yield n, self.end[node]


def single(pieces: Pieces, p: np.ndarray, letters: np.ndarray, points: np.ndarray, unknown: float) -> np.ndarray:
    """Probability [word, language] of one letter by itself: `unknown`, or for one that the vocabulary lacks that of its byte pieces."""
    out = np.full((len(letters), p.shape[1]), unknown)
    lack = np.flatnonzero(letters == 0)
    if len(lack):
        rows = pieces.spelled(points[lack])
        out[lack] = np.where(rows[:, :, None] < 0, 1.0, p[rows]).prod(axis=1)
    return out


def forward(pieces: Pieces, p: np.ndarray, letters: np.ndarray, points: np.ndarray, unknown: float) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Forward sums a[place, word, language], scaled, and the factors [word, language] by which those from a place on were divided."""
    m, n = letters.shape
    a = np.zeros((n + 1, m, p.shape[1]))
    a[0] = 1
    tops = {}
    for i in range(n):
        if i and i % SCALE == 0:
            tops[i] = a[i : i + MAX_PIECE + 1].max(axis=0)
            a[i : i + MAX_PIECE + 1] /= tops[i]
        a[i + 1] += a[i] * single(pieces, p, letters[:, i], points[:, i], unknown)
        for length, number in pieces.found(letters, i):
            a[i + length] += a[i] * p[number]
    return a, tops


def word_scores(pieces: Pieces, p: np.ndarray, words: list[str], unknown: float) -> np.ndarray:
    """log P(word) in each language."""
    out = np.empty((len(words), p.shape[1]))
    for rows, letters, points in pieces.coded(words):
        m, n = letters.shape
        a, logs = np.zeros((SCALE + MAX_PIECE + 1, m, p.shape[1])), 0.0
        a[0] = 1
        for at in range(0, n, SCALE):
            last = min(n, at + SCALE)
            for i in range(at, last):
                here = a[i - at]
                a[i - at + 1] += here * single(pieces, p, letters[:, i], points[:, i], unknown)
                for length, number in pieces.found(letters, i):
                    a[i - at + length] += here * p[number]
            ahead = a[last - at : last - at + MAX_PIECE + 1].copy()
            top = ahead.max(axis=0)
            logs = logs + np.log(top)
            a[: MAX_PIECE + 1], a[MAX_PIECE + 1 :] = ahead / top, 0
        out[rows] = np.log(a[0]) + logs
    return out


def expected(pieces: Pieces, own: np.ndarray, letters: np.ndarray, points: np.ndarray, weight: np.ndarray, unknown: float) -> np.ndarray:
    """How often each piece is expected in the segmentations of words, by forward and backward sums of one language.

    The backward sums are scaled by the factors of the forward ones and the words' probabilities, so that a x b is the
    probability of a border at a place.
    """
    p = own[:, None]
    a, tops = forward(pieces, p, letters, points, unknown)
    a = a[:, :, 0]
    m, n = letters.shape
    b = np.zeros((n + 1, m))
    b[n] = 1 / a[n]
    gained = np.zeros(pieces.rows)

    def at(i: int, j: int) -> np.ndarray:
        """b[j] on the scale of place i."""
        out = b[j]
        for k in range((i // SCALE + 1) * SCALE, j + 1, SCALE):
            out = out / tops[k][:, 0] if k in tops else out
        return out

    for i in range(n - 1, -1, -1):
        alone = single(pieces, p, letters[:, i], points[:, i], unknown)[:, 0] * at(i, i + 1)
        b[i] = alone
        lack = np.flatnonzero(letters[:, i] == 0)
        if len(lack):
            rows = pieces.spelled(points[lack, i])
            for k in range(4):
                has = rows[:, k] >= 0
                gained += np.bincount(rows[has, k], (a[i] * alone * weight)[lack[has]], pieces.rows)
        for length, number in pieces.found(letters, i):
            way = own[number] * at(i, i + length)
            b[i] += way
            gained += np.bincount(number, a[i] * way * weight, pieces.rows)
    return gained


def learn(pieces: Pieces, counts: dict[str, dict[str, int]], fit: Fit = Fit()) -> tuple[list[str], np.ndarray]:
    """Languages and their piece probabilities (pieces.rows, the last 0) from word counts by language."""
    languages = sorted(counts)
    p = np.zeros((pieces.rows, len(languages)))
    for k, language in enumerate(languages):
        words = list(counts[language])
        weight = np.array([counts[language][w] for w in words], float)
        own = np.full(pieces.rows, 1.0 / (pieces.rows - 1))
        own[-1] = 0
        for _ in range(fit.passes if words else 0):
            gained = np.full(pieces.rows, fit.smoothing)
            for rows, letters, points in pieces.coded(words):
                gained += expected(pieces, own, letters, points, weight[rows], fit.unknown)
            gained[-1] = 0
            own = gained / gained.sum()
        p[:, k] = own
    return languages, p


def words_in(text: str) -> list[str]:
    """Lower-case words of a text."""
    return LETTERS.findall(text.lower())


def _predict(place: int, languages: list[str], p: np.ndarray, vocabulary: str, unknown: float, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(vocabulary)
        cache: dict[str, int] = {}
        scores, letters = np.empty((0, len(languages))), 0

        def judge(texts: list[str]) -> tuple[list[str], list[float]]:
            nonlocal cache, scores, letters
            split = [words_in(t) for t in texts]
            flat = [w for ws in split for w in ws]
            fresh = list(set(flat).difference(cache))
            if cache and (len(cache) + len(fresh) > CACHE or letters > CACHE_LETTERS):
                cache, scores, letters = {}, np.empty((0, len(languages))), 0
                fresh = list(set(flat))
            if fresh:
                letters += sum(map(len, fresh))
                cache.update(zip(fresh, range(len(cache), len(cache) + len(fresh)), strict=True))
                scores = np.concatenate([scores, word_scores(pieces, p, fresh, unknown)])
            sizes = np.array([len(ws) for ws in split])
            names, best = ["und"] * len(texts), [0.0] * len(texts)
            if len(flat):
                rows = np.fromiter(map(cache.__getitem__, flat), np.int64, len(flat))
                full = np.flatnonzero(sizes)
                total = np.add.reduceat(scores[rows], (np.cumsum(sizes) - sizes)[full], axis=0)
                share = np.exp(total - total.max(1, keepdims=True))
                share /= share.sum(1, keepdims=True)
                for k, w in zip(full, share, strict=True):
                    names[k], best[k] = languages[int(w.argmax())], round(float(w.max()), 6)
            return names, best

        for batch in batches:
            names, best, held, size = [], [], [], 0
            for k in range(batch.num_rows):
                held.append(batch.column(place)[k].as_py() or "")
                size += len(held[-1])
                if size > 500_000 or k + 1 == batch.num_rows:  # so the words of a batch are never in memory at once
                    a, b = judge(held) if languages else (["und"] * len(held), [0.0] * len(held))
                    names, best, held, size = names + a, best + b, [], 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(best, pa.float64())], schema=schema)

    return run


def held_out(doc_id: Column) -> Column:
    """True for the documents that nothing is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, per_language: int, doc_id: str, text: str, lang: str) -> DataFrame:
    """(language, word, n) of the training sample."""
    own = docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("_text"), F.col(lang).cast("string").alias("_lang"))
    own = own.filter(F.col("_lang").isNotNull() & F.col("_text").isNotNull() & F.col("_id").isNotNull() & ~held_out(F.col("_id")))
    n = own.groupBy("_lang").agg(F.count(F.lit(1)).alias("n")).collect()  # one row for each language
    rate = F.lit(0.0)
    for r in n:
        rate = F.when(F.col("_lang") == r["_lang"], F.lit(min(1.0, per_language / r["n"]))).otherwise(rate)
    draw = F.pmod(F.xxhash64(F.lit("langid"), F.col("_id").cast("string")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    words = own.filter(draw < rate).select("_lang", F.explode(F.regexp_extract_all(F.lower("_text"), F.lit(r"\p{L}+"), 0)).alias("_word"))
    return words.groupBy("_lang", "_word").agg(F.count(F.lit(1)).alias("n"))


def predict(docs: DataFrame, train: DataFrame | None = None, fit: Fit = Fit(), keep: list[str] | None = None, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """`keep` columns (default: all) of `docs` with _lang_pred and _lang_score, learned from `train` (default: `docs`)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    common.ship(docs.sparkSession)
    counts: dict[str, dict[str, int]] = {}
    words = sample(docs if train is None else train, fit.docs_per_language, doc_id, text, lang)
    for r in words.orderBy("_lang", "_word").collect():  # the words of fit.docs_per_language documents of each language
        counts.setdefault(r["_lang"], {})[r["_word"]] = r["n"]
    languages, p = learn(pieces_of(), counts, fit) if counts else ([], np.zeros((1, 0)))
    keep = docs.columns if keep is None else keep
    df = docs.select(*[F.col(c) for c in keep], F.col(text).cast("string").alias("_lang_text"))
    schema = to_arrow_schema(df.schema).append(pa.field("_lang_pred", pa.string())).append(pa.field("_lang_score", pa.float64()))
    out = T.StructType([*df.schema, T.StructField("_lang_pred", T.StringType()), T.StructField("_lang_score", T.DoubleType())])
    return df.mapInArrow(_predict(len(keep), languages, p, VOCABULARY, fit.unknown, schema), out).drop("_lang_text")


def with_language(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The documents whose language is found, under that language where they name none; learned from those that name theirs."""
    plain = common.Plain(docs)
    found = predict(plain.df, doc_id=plain.at(doc_id), text=plain.at(text), lang=plain.at(lang))
    named = F.coalesce(F.col(plain.at(lang)), F.col("_lang_pred").cast(docs.schema[lang].dataType))
    return plain.back(found.filter(F.col("_lang_pred") != "und").withColumn(plain.at(lang), named))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents."""
    docs = common.table(spark, sf_dir, "documents")
    df = predict(docs, keep=["doc_id"])
    return df.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_lang_pred").alias("lang_pred"), F.col("_lang_score").alias("score"))


SQL = None
