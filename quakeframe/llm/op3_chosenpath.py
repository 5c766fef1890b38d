"""N-gram Jaccard join by chosen paths.

Texts are sets of five-word shingles; equal texts form one class and go on as one set,
known by a number of its own, whatever the ids of its rows. A set is embedded as T
min-hash values: tokens of which two sets share the one at a sampled place with the
probability of their Jaccard similarity. In each run every set walks down a path of
sampled tokens: sets that share the tokens met so far share a bucket. All sets are split
on DEPTH tokens; a bucket of at most BUCKET sets is then compared by brute force, a larger
one is split again on tokens sampled from its path, up to LEVELS times. What is large even
then, or what a split would not separate (many sets that share nearly everything), is
compared in pairs of chunks (by number, and where full sets are held by bytes too), so nothing
is dropped.

Recall: `meeting` is the probability that a pair meets in a run, and `runs_for` repeats
runs until a pair at the limit is met with probability RECALL. That counts runs as
independent, though all sample the same T values; a test counts what is really missed.

Pairs that meet and agree in the sketch give candidate clusters. Within a cluster every
pair is then held against the true sets (links are exact: 9 * shared >= 4 * (a + b) for
0.8), again in pairs of chunks. Tasks return links per set and a spanning forest, never
the pairs: rows stay in proportion to the sets, whatever the size of a group. The work on
a group of n different near copies is n^2 / 2 comparisons, spread over chunk pairs, since
the number of links of each of its sets is part of the result; `deduplicated`, which needs
none, leaves out those between sets that are joined already.

Defined results: null and empty texts have no shingles and no links, but are copies of one
another; a text of 1 to 4 words has one shingle, all its words; repeated rows are copies.
A text's class is the smallest id of its rows. Where that is no id (all null), or the
smallest of several texts (then it is that of the one with the smallest digest), the class
is a negative number made of the digest; a group's class is the smallest proper one, if it
has any. An empty table gives no rows. Columns of the input other than id and text are
only carried.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeframe.llm import common
from quakeframe.llm.components import components

WORDS, T, DEPTH, WAYS = 5, 64, 2, 2
BUCKET, CHUNK, LEVELS, DENSE = 1024, 512, 3, 0.7
SIMILARITY, RECALL = 0.8, 1 - 1e-8
#: Shingles of a chunk, in bytes: a task holds those of two chunks, whatever the length of the texts.
CHUNK_BYTES = 32 << 20
#: Sketches that agree in this many of T places make candidates: 5 deviations under the mean at similarity 0.8.
AGREE = 35
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_BLANKS = bytes(32 if c == 32 or 9 <= c <= 13 else c for c in range(256))


def meeting(similarity: float) -> float:
    """The least probability that a pair of that similarity meets in a run: it shares the first DEPTH tokens, and then, should its buckets be split
    to the last level, one of the WAYS tokens sampled at each level, all the way down."""
    down = 1.0
    for _ in range(LEVELS):
        down = 1 - (1 - similarity * down) ** WAYS
    return similarity**DEPTH * down


def runs_for(recall: float, similarity: float = SIMILARITY) -> int:
    """Runs after which a pair of that similarity has met with probability `recall`."""
    return math.ceil(math.log(1 - recall) / math.log(1 - meeting(similarity)))


RUNS = runs_for(RECALL)


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Shingler:
    """Shingle hashes of texts: polynomial hashes of byte ranges, by prefix sums modulo 2^64, then mixed."""

    def __init__(self) -> None:
        self.up, self.down = _powers(1 << 16, _BASE), _powers(1 << 16, pow(_BASE, -1, 1 << 64))

    def hashes(self, text: bytes) -> np.ndarray:
        """Sorted distinct hashes of the shingles."""
        tokens = text.translate(_BLANKS).split()
        if not tokens:
            return np.empty(0, np.uint64)
        data = np.frombuffer(b" ".join(tokens), np.uint8)
        if len(data) > len(self.up):
            self.up, self.down = _powers(2 * len(data), _BASE), _powers(2 * len(data), pow(_BASE, -1, 1 << 64))
        prefix = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)])])
        gaps = np.flatnonzero(data == 32)
        starts, ends = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(data)]])
        k = min(WORDS, len(tokens))
        starts, ends = starts[: len(starts) - k + 1], ends[k - 1 :]
        return np.unique(mixed((prefix[ends] - prefix[starts]) * self.down[starts] + (ends - starts).astype(np.uint64)))


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_FACTORS = mixed(np.arange(1, T + 1, dtype=np.uint64)) | np.uint64(1)


def embedded(hashes: np.ndarray) -> np.ndarray:
    """T min-hash values of a set."""
    out = np.full(T, _MASK, np.uint64)
    for at in range(0, len(hashes), 2048):
        out = np.minimum(out, (hashes[None, at : at + 2048] * _FACTORS[:, None]).min(axis=1))
    return mixed(out)


def _places() -> np.ndarray:
    """The DEPTH places sampled at the start of each run."""
    rng = np.random.default_rng(7)
    return np.stack([rng.choice(T, DEPTH, replace=False) for _ in range(RUNS)])


_SKETCH = pa.schema([("id", pa.int64()), ("digest", pa.binary()), ("n", pa.int64()), ("sketch", pa.binary()), ("keys", pa.list_(pa.int64()))])


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest, set size, sketch and the bucket of each run of every row's text (id, bytes); no sketch where a text has no word. A text seen last is not done again."""
    shingler, places = Shingler(), _places()
    starts = mixed(np.arange(1, RUNS + 1, dtype=np.uint64))
    lately: dict[bytes, tuple] = {}
    for b in batches:
        out = []
        for text in b.column(1):
            data = text.as_py() or b""
            digest = hashlib.md5(data, usedforsecurity=False).digest()
            if digest not in lately:
                if len(lately) >= 4096:
                    lately.clear()
                h = shingler.hashes(data)
                made = 0, None, None
                if len(h):
                    e, key = embedded(h), starts
                    for d in range(DEPTH):
                        key = mixed(key * np.uint64(31) + e[places[:, d]])
                    made = len(h), (e & np.uint64(0xFFFF)).astype("<u2").tobytes(), key.view(np.int64)
                lately[digest] = made
            out.append((digest, *lately[digest]))
        digests, sizes, sketches, keys = zip(*out, strict=True) if out else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], schema=_SKETCH)


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The runs of rows that agree in the first `keys` columns of sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        codes = np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in range(keys)])
        cuts = np.flatnonzero((codes[:, 1:] != codes[:, :-1]).any(0)) + 1
        bounds = [0, *cuts.tolist(), b.num_rows]
        for x, y in zip(bounds, bounds[1:], strict=False):
            code = codes[:, x].tolist()
            if held and code != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(x, y - x))
            last = code
    if held:
        yield pa.Table.from_batches(held)


def _forest(n: int, near) -> np.ndarray:
    """The first member of each member's component; near(k, rest) tells which of `rest` are joined to k."""
    root = np.full(n, -1)
    for k in range(n):
        if root[k] >= 0:
            continue
        root[k] = k
        todo = [k]
        while todo:
            rest = np.flatnonzero(root < 0)
            if not len(rest):
                break
            found = rest[near(todo.pop(), rest)]
            root[found] = k
            todo += found.tolist()
    return root


_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a spanning forest of the candidates in each chunk pair (key, i, j; chunk, id, sketch).

    A pair of different chunks adds only what joins the trees that its two chunks have already.
    """
    a, b = [], []
    for g in _groups(batches, 3):
        if g.num_rows < 2:
            continue
        ids, chunk = g.column("id").to_numpy(), g.column("chunk").to_numpy()
        s = np.frombuffer(b"".join(g.column("sketch").to_pylist()), "<u2").reshape(-1, T)
        order = np.argsort(ids, kind="stable")
        ids, s, chunk = ids[order], s[order], chunk[order]
        near = lambda k, rest, s=s: (s[rest] == s[k]).sum(1) >= AGREE
        root, own = _forest(len(ids), near), np.arange(len(ids))
        if g.column("i")[0].as_py() != g.column("j")[0].as_py():
            within = _forest(len(ids), lambda k, rest, c=chunk, near=near: near(k, rest) & (c[rest] == c[k]))
            own = own[within == own]
        own = own[root[own] != own]
        a.append(ids[own])
        b.append(ids[root[own]])
        if len(a) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], schema=_EDGES)
            a, b = [], []
    if a:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], schema=_EDGES)


_SETS = pa.schema([("id", pa.int64()), ("cluster", pa.int64()), ("shingles", pa.binary())])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingles of each set (id, cluster, bytes), once for each task that has its text."""
    shingler, seen = Shingler(), set()
    for b in batches:
        fresh = [k for k, i in enumerate(b.column(0).to_pylist()) if i not in seen and not seen.add(i)]
        some = b.take(pa.array(fresh, pa.int64()))
        h = [shingler.hashes(t.as_py() or b"").astype("<u8").tobytes() for t in some.column(2)]
        yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(h, pa.binary())], schema=_SETS)


_LINKS = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])


def _verified(count: bool):
    """A spanning forest over the links in each chunk pair (cluster, i, j; chunk, id, shingles), and with `count` the links of each set.

    Without it a set that a tree has reached is compared no more, so n sets that are all alike take n comparisons and not n^2 / 2.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, 3):
            ids, order = np.unique(g.column("id").to_numpy(), return_index=True)  # a set comes twice where its rows lay in two tasks
            chunk = g.column("chunk").to_numpy()[order]
            two = g.column("i")[0].as_py() != g.column("j")[0].as_py()
            raw = g.column("shingles").to_pylist()
            sets = [np.frombuffer(raw[k], "<u8") for k in order]
            sizes = np.array([len(x) for x in sets])
            _, flat = np.unique(np.concatenate(sets), return_inverse=True)
            starts = np.cumsum(sizes) - sizes
            mark = np.zeros(flat.max(initial=0) + 1, np.int64)

            def linked(k: int, chunk=chunk, two=two, sizes=sizes, flat=flat, starts=starts, mark=mark) -> np.ndarray:
                own = flat[starts[k] : starts[k] + sizes[k]]
                mark[own] = 1
                shared = np.add.reduceat(mark[flat], starts)
                mark[own] = 0
                out = 9 * shared >= 4 * (sizes[k] + sizes)
                out[k] = False
                return out & (chunk != chunk[k]) if two else out

            if count:
                m = np.stack([linked(k) for k in range(len(ids))])  # about 2 * CHUNK squared
                root, links = _forest(len(ids), lambda k, rest, m=m: m[k, rest]), m.sum(1).astype(np.int64)
            else:
                root, links = _forest(len(ids), lambda k, rest, linked=linked: linked(k)[rest]), np.zeros(len(ids), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links), pa.array(ids[root])], schema=_LINKS)

    return run


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.int64(): "long", pa.binary(): "binary", pa.list_(pa.int64()): "array<long>"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def _chunk_pairs(rows: DataFrame, key: str, size: str) -> DataFrame:
    """Rows dealt to the chunk pairs (key, i <= j) of their group: each pair of rows meets in one of them."""
    n = F.ceil(F.col(size) / CHUNK).cast("int")
    df = rows.withColumn("chunk", F.pmod(F.xxhash64("id"), n).cast("int"))
    others = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(F.least(k, F.col("chunk")).alias("i"), F.greatest(k, F.col("chunk")).alias("j")))
    df = df.withColumn("_p", F.explode(others)).withColumns({"i": F.col("_p.i"), "j": F.col("_p.j")}).drop("_p")
    return df.filter((F.col("i") != F.col("j")) | (F.col("i") == F.col("chunk"))).repartition(key, "i", "j").sortWithinPartitions(key, "i", "j")


def _buckets(sketches: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(key, n, id, sketch): the sets of every bucket that is compared, with the bucket's size; and the written tables it is read from.

    A large bucket is split while that separates its sets. Where a child would keep more
    than DENSE of them they are much alike, and the bucket is compared as it is.
    """
    sizes = lambda df: df.groupBy("key").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("key", "_k")
    s = sketches.select(F.col("id").alias("_i"), "sketch")
    slim = sketches.select("id", F.explode("keys").alias("key"))
    done, used = [], []
    for level in range(LEVELS + 1):
        many = common.written(sizes(slim).filter("n > 1"), "op3-sizes")
        met = common.written(slim.join(many, slim["key"] == many["_k"]).drop("_k"), "op3-met")
        common.forget(many)
        used.append(met)
        large = met.filter(F.col("n") > BUCKET)
        if level == LEVELS or large.isEmpty():
            done.append(met)
            break
        done.append(met.filter(F.col("n") <= BUCKET))
        large = large.join(s, large["id"] == s["_i"]).drop("_i")
        child = lambda c: F.xxhash64("key", F.lit(c), F.substring("sketch", (F.pmod(F.xxhash64("key", F.lit(c)), F.lit(T)) * 2 + 1).cast("int"), F.lit(2)))
        split = common.written(large.select(F.col("key").alias("parent"), "n", "id", F.explode(F.array(*map(child, range(WAYS)))).alias("key")), "op3-split")
        most = split.groupBy("parent", "n", "key").agg(F.count(F.lit(1)).alias("m")).groupBy("parent").agg((F.max("m") > DENSE * F.max("n")).alias("dense"))
        most = common.written(most.withColumnRenamed("parent", "_p"), "op3-dense")
        used += [split, most]
        split = split.join(most, split["parent"] == most["_p"])
        done.append(split.filter("dense").select("id", F.col("parent").alias("key"), "n").distinct())
        slim = common.written(split.filter(~F.col("dense")).select("id", "key"), "op3-slim")
        used.append(slim)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.join(s, out["id"] == s["_i"]).drop("_i"), used


def _bytes(docs: DataFrame, text: str) -> Column:
    return common.text_of(docs, text).cast("binary")


def _spare(digest: Column) -> Column:
    """A negative number for a text that has no id to be known by."""
    return -1 - F.pmod(F.xxhash64(digest), F.lit(1 << 62))


def classes(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Two written tables. Rows: id and digest. Texts: set (a number for each), digest, low (smallest id), copies, proper (whether the class is an id), class, n (its shingles), sketch, keys."""
    made = docs.select(docs[doc_id].cast("long").alias("id"), _bytes(docs, text).alias("text")).mapInArrow(_sketches, _ddl(_SKETCH))
    rows = common.written(made, "op3-rows")
    texts = rows.groupBy("digest").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("keys").alias("keys"))
    # Written, so the numbers stay; and a join of two plain exchanges is one whose hot keys Spark can split.
    texts = common.written(texts.withColumn("set", F.monotonically_increasing_id()), "op3-texts")
    first = common.written(texts.filter(F.col("low").isNotNull()).groupBy(F.col("low").alias("_l")).agg(F.min("digest").alias("_d")), "op3-first")
    own = texts.join(first, (texts["low"] == first["_l"]) & (texts["digest"] == first["_d"]), "left")
    own = own.withColumn("proper", F.col("_l").isNotNull()).withColumn("class", F.when(F.col("proper"), F.col("low")).otherwise(_spare(F.col("digest"))))
    named = common.written(own.drop("_l", "_d"), "op3-named")
    common.forget(texts, first)
    return rows, named


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: _id, _digest, _class, _copies, _links (to different texts), _group (class of all that links reach) and _first (whether it is the row that stands for its group)."""
    return _joined(docs, doc_id, text)[0]


def _joined(docs: DataFrame, doc_id: str, text: str, count: bool = True) -> tuple[DataFrame, list[DataFrame]]:
    """`join`, and the written tables it is read from. Without `count`, _links only tells whether there are any."""
    common.ship(docs.sparkSession)
    rows, texts = classes(docs, doc_id, text)
    sketches = texts.filter(F.col("sketch").isNotNull()).select(F.col("set").alias("id"), "sketch", "keys")
    buckets, used = _buckets(sketches)
    pairs = _chunk_pairs(buckets, "key", "n").select("key", "i", "j", "chunk", "id", "sketch")
    found_near = components(pairs.mapInArrow(_candidates, _ddl(_EDGES)).distinct(), "op3-near")
    near = found_near.withColumnsRenamed({"id": "_i", "root": "cluster"})
    common.forget(*used)
    # A set's text is that of the rows with its smallest id, so rows of a hot text lie apart.
    wanted = near.join(texts.select("set", "digest", "low", "n"), F.col("_i") == F.col("set")).select("set", "cluster", "n", F.col("digest").alias("_d"), F.coalesce("low", F.lit(0)).alias("_l"))
    wanted = common.written(wanted, "op3-wanted")
    # A cluster is cut by its sets or by their bytes, whichever takes more chunks.
    size = F.greatest(F.count(F.lit(1)), CHUNK * F.ceil(8 * F.sum("n") / CHUNK_BYTES))
    sizes = common.written(wanted.groupBy(F.col("cluster").alias("_c")).agg(size.alias("n")), "op3-cluster-sizes")
    body = docs.select(F.coalesce(docs[doc_id].cast("long"), F.lit(0)).alias("_own"), _bytes(docs, text).alias("_text")).withColumn("_digest", F.unhex(F.md5("_text")))
    # The texts wanted grow with the documents, so they are never broadcast, at no size.
    sets = body.join(wanted.drop("n").hint("merge"), (body["_digest"] == wanted["_d"]) & (body["_own"] == wanted["_l"])).select("set", "cluster", "_text").mapInArrow(_sets, _ddl(_SETS))
    dealt = _chunk_pairs(sets.join(sizes, sets["cluster"] == sizes["_c"]), "cluster", "n").select("cluster", "i", "j", "chunk", "id", "shingles")
    found = common.written(dealt.mapInArrow(_verified(count), _ddl(_LINKS)), "op3-links")
    common.forget(sizes, wanted)
    groups = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")), "op3-groups")
    links = found.groupBy("id").agg(F.sum("links").alias("links")).filter("links > 0") if count else groups.select("id", F.lit(1).cast("long").alias("links"))
    links = links.withColumnRenamed("id", "_s")
    named = groups.join(texts.select("set", "proper", "class"), F.col("id") == F.col("set"))
    low = named.groupBy("root").agg(F.min(F.struct((~F.col("proper")).alias("p"), F.col("class").alias("c"), F.col("set").alias("s"))).alias("low"))
    low = common.written(low.select(F.col("root").alias("_r"), F.col("low.c").alias("group"), F.col("low.s").alias("head")), "op3-low")
    reached = groups.join(low, groups["root"] == low["_r"]).select(F.col("id").alias("_g"), "group", "head")
    per_set = common.written(links.join(reached, links["_s"] == reached["_g"]).drop("_g"), "op3-per-set")
    facts = texts.select("set", "digest", "copies", "class", "low").join(per_set, F.col("set") == F.col("_s"), "left")
    facts = facts.select(F.col("digest").alias("_d"), "low", F.col("class").alias("_class"), F.col("copies").alias("_copies"), F.coalesce("links", F.lit(0)).alias("_links"), F.coalesce("group", "class").alias("_group"), F.coalesce(F.col("head") == F.col("set"), F.lit(True)).alias("_first"))
    facts = common.written(facts, "op3-facts")
    common.forget(texts, found, groups, low, per_set, found_near)
    out = rows.select(F.col("id").alias("_id"), F.col("digest").alias("_digest")).join(facts, F.col("_digest") == F.col("_d")).drop("_d")
    return out.withColumn("_first", F.col("_first") & F.col("_id").eqNullSafe(F.col("low"))).drop("low"), [rows, facts]


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group stays, one of its class, with all columns of `docs`.

    Rows are known by id and text. Only if some rows agree in both are whole rows grouped to keep one of each.
    """
    plain = common.Plain(docs)
    docs, doc_id, text = plain.df, plain.at(doc_id), plain.at(text)
    joined, used = _joined(docs, doc_id, text, count=False)
    member = joined.select(F.coalesce("_id", F.lit(0)).alias("_key"), F.col("_id").isNull().alias("_none"), "_digest", "_first")
    member = common.written(member, "op3-member")
    common.forget(*used)
    gone = common.written(member.filter(~F.col("_first")).select("_key", "_none", "_digest").distinct(), "op3-gone")
    repeated = member.filter("_first").groupBy("_key", "_none", "_digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    own = docs[doc_id].cast("long")
    df = docs.withColumns({"_this": F.unhex(F.md5(_bytes(docs, text))), "_own": F.coalesce(own, F.lit(0)), "_bare": own.isNull()})
    # What goes grows with the documents, so it is never broadcast, at no size.
    left = df.join(gone.hint("merge"), (df["_own"] == gone["_key"]) & (df["_bare"] == gone["_none"]) & (df["_this"] == gone["_digest"]), "left_anti")
    if not repeated.isEmpty():
        left = left.dropDuplicates(["_own", "_bare", "_this"])
    common.forget(member)
    return plain.back(left)


def op3_chosenpath(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class (the smallest id that its links reach), links to different texts, and copies."""
    j = join(common.table(spark, sf_dir, "documents"))
    return j.select(F.col("_id").alias("doc_id"), F.col("_group").alias("class_id"), F.col("_links").alias("n_links"), F.col("_class").alias("text_class"), F.col("_copies").alias("n_copies"))


SQL = None
