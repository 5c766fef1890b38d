"""Near duplicates by MinHash with tensored banding.

Two collections of M hashes each, every one of HALF min-hash values, give M x M tables: the
key of table (i, j) is the pair of hash i of the first and hash j of the second collection.
A pair of sets shares a table exactly if it agrees in some hash of both collections, so it
takes 2 * HALF * M min-hash values where tables with values of their own would take
2 * HALF * M^2. For the same reason the M^2 keys of a set are never written out: rows go
to their M keys of the first collection, and inside such a bucket a pair counts if any key
of the second agrees. The buckets of the FIRST keys are compared first; of all buckets only
what lies outside their largest component goes on (see `linking`), by tables where there
is much of it.

M is the least number of hashes that finds a pair at the limit with probability RECALL.
Sets that share a table and agree in enough of all values form candidate clusters, and
within a cluster links are confirmed on full sets (9 * shared >= 4 * (a + b) for 0.8),
again by `linking`. Sets with equal shingles are one set from the start, whatever their
texts.

Defined results: null, empty and blank texts have no shingles and are linked with nothing;
fewer than 4 words make one shingle; ids may be null or repeat: a component's id is the
smallest it has, null if it has none, and a row is kept if its id is that one (`kept`);
`deduplicated` keeps exactly one row of each component, and all rows without shingles. An
empty table gives no rows. Columns other than id and text are only carried.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeframe.llm import common, linking

WORDS, HALF, SIMILARITY, RECALL = 4, 3, 0.8, 1 - 2e-6
#: Hashes in each of the two collections.
M = math.ceil(math.log(1 - math.sqrt(RECALL)) / math.log(1 - SIMILARITY**HALF))
T = 2 * HALF * M
#: Values in which candidates agree at least: 5 deviations under the mean at the limit.
AGREE = math.floor(T * SIMILARITY - 5 * math.sqrt(T * SIMILARITY * (1 - SIMILARITY)))
CHUNK_BYTES = 32 << 20
#: Keys of the first collection whose buckets are compared as a whole.
FIRST = 4
_BASE = 0x9E3779B97F4A7C15
#: UTF-8 bytes with A-Z lower-cased and every blank a space.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Shingle hashes of texts: polynomial hashes of byte ranges, by prefix sums modulo 2^64, then mixed."""

    def __init__(self) -> None:
        self._grow(1 << 16)

    def _grow(self, n: int) -> None:
        ups = lambda base: np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, base, np.uint64)]))
        self.up, self.down = ups(_BASE), ups(pow(_BASE, -1, 1 << 64))

    def hashes(self, text: bytes) -> np.ndarray:
        """Sorted distinct hashes of the shingles."""
        tokens = text.translate(_PLAIN).split()
        if not tokens:
            return np.empty(0, np.uint64)
        data = np.frombuffer(b" ".join(tokens), np.uint8)
        if len(data) > len(self.up):
            self._grow(2 * len(data))
        prefix = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)])])
        gaps, k = np.flatnonzero(data == 32), min(WORDS, len(tokens))
        starts, ends = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(data)]])
        starts, ends = starts[: len(starts) - k + 1], ends[k - 1 :]
        return np.unique(mixed((prefix[ends] - prefix[starts]) * self.down[starts] + (ends - starts).astype(np.uint64)))


_FACTORS = mixed(np.arange(1, T + 1, dtype=np.uint64)) | np.uint64(1)


def min_hashes(hashes: np.ndarray) -> np.ndarray:
    """T min-hash values of a set."""
    out = np.full(T, (1 << 64) - 1, np.uint64)
    for at in range(0, len(hashes), 2048):
        out = np.minimum(out, (hashes[None, at : at + 2048] * _FACTORS[:, None]).min(axis=1))
    return mixed(out)


def first_keys(values: np.ndarray) -> np.ndarray:
    """The M hashes of the first collection, each from HALF values and its number."""
    key = mixed(np.arange(1, M + 1, dtype=np.uint64))
    for own in values[: HALF * M].reshape(M, HALF).T:
        key = mixed(key * np.uint64(31) + own)
    return key.view(np.int64)


_SIGNED = pa.schema([("id", pa.int64()), ("text_digest", pa.binary()), ("digest", pa.binary()), ("n", pa.int64()), ("sketch", pa.binary()), ("keys", pa.list_(pa.int64()))])


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests, set size, a byte of each min-hash value and the first collection's keys of every row's text (id, bytes). A text seen last is not done again."""
    shingler = Shingler()
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
                made = None, 0, None, None
                if len(h):
                    v = min_hashes(h)
                    made = hashlib.md5(h.tobytes(), usedforsecurity=False).digest(), len(h), (v & np.uint64(0xFF)).astype(np.uint8).tobytes(), first_keys(v)
                lately[digest] = made
            out.append((digest, *lately[digest]))
        columns = list(zip(*out, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, f.type) for c, f in zip(columns, list(_SIGNED)[1:], strict=True)]], schema=_SIGNED)


def same_table(payload: list[bytes]) -> linking.Near:
    """Members of a bucket of the first collection that agree in a hash of the second one, and in AGREE values."""
    s = np.frombuffer(b"".join(payload), np.uint8).reshape(-1, T)

    def near(k: int, rest: np.ndarray) -> np.ndarray:
        equal = s[rest] == s[k]
        return (equal.sum(1) >= AGREE) & equal[:, HALF * M :].reshape(-1, M, HALF).all(2).any(1)

    return near


def similar(payload: list[bytes]) -> linking.Near:
    """Sets of shingle hashes whose similarity is at least the limit."""
    sets = [np.frombuffer(p, "<u8") for p in payload]
    sizes = np.array([len(x) for x in sets])
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    starts, mark = np.cumsum(sizes) - sizes, np.zeros(len(values), np.int64)

    def near(k: int, rest: np.ndarray) -> np.ndarray:
        own = flat[starts[k] : starts[k] + sizes[k]]
        mark[own] = 1
        shared = np.add.reduceat(mark[flat], starts)[rest] if len(rest) > 64 else np.array([mark[flat[starts[r] : starts[r] + sizes[r]]].sum() for r in rest])
        mark[own] = 0
        return 9 * shared >= 4 * (sizes[k] + sizes[rest])

    return near


_SHINGLES = pa.schema([("id", pa.int64()), ("payload", pa.binary())])


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingles of texts (id, bytes), once for each task that has them."""
    shingler, seen = Shingler(), set()
    for b in batches:
        fresh = [k for k, i in enumerate(b.column(0).to_pylist()) if i not in seen and not seen.add(i)]
        some = b.take(pa.array(fresh, pa.int64()))
        yield pa.RecordBatch.from_arrays([some.column(0), pa.array([shingler.hashes(t.as_py() or b"").astype("<u8").tobytes() for t in some.column(1)], pa.binary())], schema=_SHINGLES)


def _bytes(docs: DataFrame, text: str) -> Column:
    return common.text_of(docs, text).cast("binary")


def _members(sets: DataFrame, keys: Column) -> DataFrame:
    return sets.select(F.col("set").alias("id"), F.explode(keys).alias("key"))


def _buckets(sets: DataFrame) -> DataFrame:
    """(key, id, chunks): the buckets of the FIRST keys with two sets or more, one of those with the same members."""
    slim = _members(sets, F.slice("keys", 1, FIRST))
    one = common.written(linking.grouped(slim), "op13-sizes")
    met = common.written(slim.join(one, slim["key"] == one["_k"]).select("key", "id", F.ceil(F.col("n") / linking.CHUNK).cast("int").alias("chunks")), "op13-buckets")
    common.forget(one)
    return met


def _tables(rows: DataFrame) -> DataFrame:
    """Rows (key, id, payload) of buckets of the first collection, once for each table: the key goes on with a hash of the second one."""
    at = lambda j: F.xxhash64("key", F.lit(j), F.substring("payload", HALF * (M + j) + 1, HALF))
    return rows.select("id", F.explode(F.array(*map(at, range(M)))).alias("key"))


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: _id, _digest (of its text), _shingles, _component (smallest id that links reach) and _first (whether it stands for its component)."""
    common.ship(docs.sparkSession)
    rows = docs.select(docs[doc_id].cast("long").alias("id"), _bytes(docs, text).alias("text")).mapInArrow(_signed, "id long, text_digest binary, digest binary, n long, sketch binary, keys array<long>")
    rows = common.written(rows, "op13-rows")
    place = F.struct(F.coalesce("id", F.lit(0)).alias("i"), F.col("text_digest").alias("t"), F.col("id").isNull().alias("none"))
    sets = rows.filter(F.col("digest").isNotNull()).groupBy("digest").agg(F.min("id").alias("low"), F.min(F.when(F.col("id").isNotNull(), place)).alias("p"), F.min(place).alias("q"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("keys").alias("keys"))
    sets = common.written(sets.withColumn("place", F.coalesce("p", "q")).drop("p", "q").withColumn("set", F.monotonically_increasing_id()), "op13-sets")
    buckets = _buckets(sets)
    sketches = sets.select(F.col("set").alias("_s"), F.col("sketch").alias("payload"))
    later = _members(sets, F.slice("keys", FIRST + 1, M))
    near = linking.linked(buckets, later, lambda r: r.join(sketches, r["id"] == sketches["_s"]).drop("_s"), same_table, "op13-near", 1, _tables)
    common.forget(buckets)
    wanted = common.written(near.join(sets, near["id"] == sets["set"]).select("id", "root", "n", F.col("place.i").alias("_i"), F.col("place.t").alias("_t")), "op13-wanted")
    sizes = wanted.groupBy(F.col("root").alias("_r")).agg(F.greatest(F.ceil(F.count(F.lit(1)) / linking.CHUNK), F.ceil(8 * F.sum("n") / CHUNK_BYTES)).cast("int").alias("chunks"))
    members = common.written(wanted.join(sizes, wanted["root"] == sizes["_r"]).select(F.col("root").alias("key"), "id", "chunks"), "op13-members")
    body = docs.select(F.coalesce(docs[doc_id].cast("long"), F.lit(0)).alias("_own"), _bytes(docs, text).alias("_text")).withColumn("_digest", F.unhex(F.md5("_text")))

    # The texts grow with the documents, as does what is wanted of them, so neither is ever broadcast.
    bodies = body.join(wanted.hint("merge"), (body["_own"] == wanted["_i"]) & (body["_digest"] == wanted["_t"])).select("id", "_text").mapInArrow(_shingles, "id long, payload binary")
    bodies = common.written(bodies.withColumnRenamed("id", "_p"), "op13-bodies")
    groups = linking.linked(members, None, lambda r: r.join(bodies.hint("merge"), r["id"] == bodies["_p"]).drop("_p"), similar, "op13-links")
    named = groups.join(sets.select("set", "low", "place"), F.col("id") == F.col("set"))
    low = named.groupBy("root").agg(F.min("low").alias("component"), F.min(F.struct(F.col("low").isNull().alias("x"), F.col("low").alias("y"), F.col("place").alias("place"))).alias("head"))
    low = low.select(F.col("root").alias("_r"), "component", F.col("head.place").alias("head"))
    reached = groups.join(low, groups["root"] == low["_r"]).select(F.col("id").alias("_g"), "component", "head")
    facts = sets.join(reached, sets["set"] == reached["_g"], "left")
    facts = common.written(facts.select(F.col("digest").alias("_d"), F.when(F.col("_g").isNull(), F.col("low")).otherwise(F.col("component")).alias("_component"), F.coalesce("head", "place").alias("_head")), "op13-facts")
    common.forget(near, wanted, members, groups, bodies)
    out = rows.select("id", "text_digest", "digest", "n").join(facts, F.col("digest") == F.col("_d"), "left")
    alone = F.col("digest").isNull()
    first = alone | ((F.col("_head.i") == F.coalesce("id", F.lit(0))) & (F.col("_head.t") == F.col("text_digest")) & (F.col("_head.none") == F.col("id").isNull()))
    return out.select(F.col("id").alias("_id"), F.col("text_digest").alias("_digest"), F.col("n").alias("_shingles"), F.when(alone, F.col("id")).otherwise(F.col("_component")).alias("_component"), first.alias("_first"), alone.alias("_alone"))


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, and all without shingles, with all columns of `docs`."""
    plain = common.Plain(docs)
    df, doc_id, text = plain.df, plain.at(doc_id), plain.at(text)
    j = join(df, doc_id, text).filter("_first").select(F.coalesce("_id", F.lit(0)).alias("_key"), F.col("_id").isNull().alias("_none"), "_digest", "_alone").distinct()
    j = common.written(j, "op13-kept")
    own = df[doc_id].cast("long")
    df = df.withColumns({"_this": F.unhex(F.md5(_bytes(df, text))), "_own": F.coalesce(own, F.lit(0)), "_bare": own.isNull()})
    left = df.join(j.hint("merge"), (df["_own"] == j["_key"]) & (df["_bare"] == j["_none"]) & (df["_this"] == j["_digest"]))
    same = left.filter(~F.col("_alone")).dropDuplicates(["_own", "_bare", "_this"])
    return plain.back(same.unionByName(left.filter("_alone")))


def op13_tensored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its shingles and the smallest id that its links reach."""
    j = join(common.table(spark, sf_dir, "documents"))
    return j.select(F.col("_id").alias("doc_id"), F.col("_shingles").alias("n_shingles"), F.col("_component").alias("component_id"), F.col("_id").eqNullSafe(F.col("_component")).alias("kept"))


#: A join of all shingles is too slow in SQL on texts with common passages; tests hold the result against all pairs.
SQL = None
