"""Exact top-k by inner product with block-at-a-time pruning.

Candidates are cut into blocks of at most BLOCK consecutive ids. A block row is a forward
index (its vectors as one integer matrix of the narrowest type that holds them) with the
largest and smallest value of every dimension, the term maxima; for a query their weighted
sum bounds every score in the block. Blocks keep their size however many vectors there are.
Their summaries are packed into pages, a distributed table as well: no task and no driver
holds them all.

A query visits its blocks in the order of its own bounds. Visits go in bands: first the
block of the highest bound, then those down to half way between that and the k-th score,
half way again, and last the rest; the k-th score is taken anew after each band, and a
block is left out as soon as its bound is under it. (A job for every single block would
take as many jobs as there are blocks.)

Queries meet the summaries twice, whatever the number of bands: once for each query's best
block, and once for the list of its blocks whose bounds reach the k-th score of that one.
The bands read this list of (query, block, bound), and a query's vector goes only to blocks
that it visits, in chunks of queries; blocks never travel to queries.

Scores are integers, so all of this is exact; ties go to the smaller id. Where a product
could leave a long it is taken in Python's integers, and what is beyond LIMIT is held there:
bounds too, so the order of visits stays right.

Defined results: vectors that are null, empty, or hold null or non-finite components take
no part; a score takes two vectors of one length, so a query's candidates are those of its
own length; a query with fewer than k partners gets them all; rows with an id that occurs
twice are candidates each (a query never gets its own id, and asks with the smallest of
its vectors); components are held within 2^62 and scores within LIMIT, so vectors of huge
components take part and tie at the limit; an empty table gives no rows. Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quakeframe.llm import common

BLOCK, QUERY_CHUNK, BANDS = 1024, 512, 4
#: Blocks of a partition that makes them, and partitions of a page of summaries.
PART_BLOCKS, PAGE_PARTS = 64, 8
SCALE = 256
NONE = -(2**63)
LIMIT = 2**62 - 1
_BLOCKS = pa.schema([("block", pa.int64()), ("page", pa.int64()), ("dims", pa.int64()), ("kind", pa.string()), ("ids", pa.binary()), ("matrix", pa.binary()), ("high", pa.binary()), ("low", pa.binary())])
_CHUNKS = pa.schema([("dims", pa.int64()), ("queries", pa.binary()), ("vectors", pa.binary()), ("first", pa.binary()), ("least", pa.binary())])
_TOPS = pa.schema([("query_id", pa.int64()), ("top", pa.int64()), ("block", pa.int64())])
_VISITS = pa.schema([("query_id", pa.int64()), ("block", pa.int64()), ("bound", pa.int64())])
_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def quantised(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """`vec_id` and `v`, floor(SCALE * x) of every component, of the rows that take part."""
    v = F.col(vector)
    whole = F.size(v) > 0
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    df = df.filter(F.col(vec_id).isNotNull() & v.isNotNull() & whole & finite)
    return df.select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(F.greatest(F.lit(-(2.0**62)), F.least(F.lit(2.0**62), x.cast("double") * SCALE))).cast("long")).alias("v"))


def _row(schema: pa.Schema, *values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(values, schema, strict=True)], schema=schema)


def _most(m: np.ndarray) -> int:
    """The largest absolute value."""
    return max(abs(int(m.max(initial=0))), abs(int(m.min(initial=0))))


def _kind(m: np.ndarray) -> str:
    """The narrowest integer type that holds all of a matrix."""
    most = _most(m)
    return "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"


def _in_order(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, pa.Table]]:
    """Up to `size` rows of one length (column dims), as they come."""
    held, n, last = [], 0, None
    for b in batches:
        dims = b.column("dims").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(dims)) + 1).tolist(), len(dims)]
        for x, y in zip(cuts, cuts[1:], strict=False):
            while x < y:
                if held and (n == size or dims[x] != last):
                    yield last, pa.Table.from_batches(held)
                    held, n = [], 0
                last, take = int(dims[x]), min(y - x, size - n)
                held.append(b.slice(x, take))
                n, x = n + take, x + take
    if held:
        yield last, pa.Table.from_batches(held)


def _matrix(column, dims: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def _make_blocks(size: int, page_parts: int):
    """A partition's rows (dims, vec_id, v), in their order, as blocks. A partition is a range of lengths and ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for k, (dims, t) in enumerate(_in_order(batches, size)):
            m = _matrix(t.column("v"), dims)
            kind = _kind(m)
            yield _row(_BLOCKS, (part << 32) + k, part // page_parts, dims, kind, t.column("vec_id").to_numpy().astype("<i8").tobytes(), m.astype(kind).tobytes(), m.max(0).astype("<i8").tobytes(), m.min(0).astype("<i8").tobytes())

    return run


def _make_chunks(size: int):
    """Queries (dims, vec_id, v, first, least) as rows of up to `size`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dims, t in _in_order(batches, size):
            numbers = [t.column(c).to_numpy().astype("<i8").tobytes() for c in ("first", "least")]
            yield _row(_CHUNKS, dims, t.column("vec_id").to_numpy().astype("<i8").tobytes(), _matrix(t.column("v"), dims).astype("<i8").tobytes(), *numbers)

    return run


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer a @ b.T: in floating point where that can't round, which BLAS does fast, in longs where they hold it, else in Python's integers."""
    most = _most(a) * _most(b) * a.shape[1]
    if most < 2**52:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T if most <= LIMIT else a.astype(object) @ b.T.astype(object)


def _held(scores: np.ndarray) -> np.ndarray:
    """Scores as longs within LIMIT."""
    return np.clip(scores, -LIMIT, LIMIT).astype(np.int64)


def _bounds(q: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The most that any vector of each block can score with each query."""
    up, down = _product(np.maximum(q, 0), high), _product(np.minimum(q, 0), low)
    return _held(up + down)  # two longs within LIMIT have a long sum


def _chunk_and_page(b: pa.RecordBatch, r: int) -> tuple[np.ndarray, ...]:
    """Blocks, queries, their first blocks and limits, and all bounds, of a row that joins a chunk of queries and a page of summaries."""
    dims = b.column("dims")[r].as_py()
    queries, q, first, least = (np.frombuffer(b.column(c)[r].as_py(), "<i8") for c in ("queries", "vectors", "first", "least"))
    own = b.column("heads")[r].values
    high, low = (np.frombuffer(b"".join(own.field(c).to_pylist()), "<i8").reshape(-1, dims) for c in ("high", "low"))
    return own.field("block").to_numpy(), queries, first, least, _bounds(q.reshape(-1, dims), high, low)


def _tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each query's highest bound in a page, and a block that has it."""
    for b in batches:
        for r in range(b.num_rows):
            blocks, queries, _, _, bound = _chunk_and_page(b, r)
            yield pa.RecordBatch.from_arrays([pa.array(queries), pa.array(bound.max(1)), pa.array(blocks[bound.argmax(1)])], schema=_TOPS)


def _visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of a page whose bounds aren't under a query's k-th score, but for the block that gave it."""
    for b in batches:
        for r in range(b.num_rows):
            blocks, queries, first, least, bound = _chunk_and_page(b, r)
            i, j = np.nonzero((bound >= least[:, None]) & (blocks[None, :] != first[:, None]))
            yield pa.RecordBatch.from_arrays([pa.array(queries[i]), pa.array(blocks[j]), pa.array(bound[i, j])], schema=_VISITS)


def _score(k: int):
    """The k best of a block for each query that visits it, none below its threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                dims = b.column("dims")[r].as_py()
                asked = b.column("asked")[r].values
                queries, least = (asked.field(c).to_numpy() for c in ("vec_id", "least"))
                q = asked.field("v").flatten().to_numpy()
                ids = np.frombuffer(b.column("ids")[r].as_py(), "<i8")
                m = np.frombuffer(b.column("matrix")[r].as_py(), b.column("kind")[r].as_py()).astype(np.int64).reshape(-1, dims)
                scores = _held(_product(q.reshape(-1, dims), m))
                order = np.argsort(ids, kind="stable")
                ids, scores = ids[order], scores[:, order]
                out = [[], [], []]
                for i, own in enumerate(queries):
                    s = scores[i]
                    fit = np.flatnonzero((ids != own) & (s >= least[i]))
                    if len(fit) > k:
                        kth = np.partition(s[fit], len(fit) - k)[len(fit) - k]
                        fit = fit[s[fit] >= kth]
                        fit = fit[np.lexsort((ids[fit], -s[fit]))][:k]
                    out[0].append(np.full(len(fit), own))
                    out[1].append(ids[fit])
                    out[2].append(s[fit])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in out], schema=_FOUND)

    return run


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", visits: list[int] | None = None) -> DataFrame:
    """For each row of `is_query` (a condition on vec_id) its k best other rows: query_id, rank, vec_id, score.

    `visits`, if given, gets the number of block visits in each band.
    """
    spark = vectors.sparkSession
    common.ship(spark)
    rows = common.written(quantised(vectors, vec_id, vector).withColumn("dims", F.size("v").cast("long")), "op10-rows")
    n = rows.count()
    parts = max(-(-n // (BLOCK * PART_BLOCKS)), min(max(1, -(-n // BLOCK)), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    pages = -(-parts // PAGE_PARTS)
    ranged = rows.select("dims", "vec_id", "v").repartitionByRange(parts, "dims", "vec_id", F.xxhash64("v")).sortWithinPartitions("dims", "vec_id")
    blocks = common.written(ranged.mapInArrow(_make_blocks(BLOCK, PAGE_PARTS), _ddl(_BLOCKS)), "op10-blocks")
    # PART_BLOCKS * PAGE_PARTS summaries in a page, but for uneven ranges.
    heads = common.written(blocks.groupBy(F.col("page").alias("_p"), F.col("dims").alias("_d")).agg(F.collect_list(F.struct("block", "high", "low")).alias("heads")), "op10-pages")
    indexes = blocks.select(F.col("block").alias("_b"), "dims", "kind", "ids", "matrix")
    asked = rows.filter(is_query(F.col("vec_id"))).groupBy("vec_id").agg(F.min(F.struct("dims", "v")).alias("m"))
    state = common.written(asked.select("m.dims", "vec_id", "m.v", F.lit(-1).cast("long").alias("first"), F.lit(NONE).alias("least")), "op10-state")
    slices = max(1, -(-state.count() // QUERY_CHUNK))

    def met(live: DataFrame) -> DataFrame:
        """Chunks of queries with all pages of vectors of their length."""
        chunks = live.select("dims", "vec_id", "v", "first", "least").sortWithinPartitions("dims").mapInArrow(_make_chunks(QUERY_CHUNK), _ddl(_CHUNKS))
        chunks = chunks.withColumn("page", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(pages - 1).cast("long"))))
        return chunks.join(heads, (chunks["page"] == heads["_p"]) & (chunks["dims"] == heads["_d"])).drop("_p", "_d")

    def scored(turn: DataFrame) -> DataFrame:
        """What queries (vec_id, v, least) find in the blocks they visit; those of a block come in chunks of about QUERY_CHUNK."""
        if visits is not None:
            visits.append(turn.count())
        asked = turn.groupBy("block", F.pmod(F.xxhash64("vec_id"), F.lit(slices)).alias("slice")).agg(F.collect_list(F.struct("vec_id", "v", "least")).alias("asked"))
        return asked.join(indexes, asked["block"] == indexes["_b"]).select("dims", "kind", "ids", "matrix", "asked").mapInArrow(_score(k), _ddl(_FOUND))

    def kth(best: DataFrame) -> DataFrame:
        return best.groupBy(F.col("query_id").alias("_q")).agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("kth"))

    tops = met(state).mapInArrow(_tops, _ddl(_TOPS)).groupBy(F.col("query_id").alias("_q")).agg(F.max(F.struct("top", "block")).alias("t"))
    firsts = common.written(state.drop("first").join(tops, F.col("vec_id") == F.col("_q")).select("dims", "vec_id", "v", F.col("t.block").alias("first"), (F.col("t.top") + 1).alias("lower"), "least"), "op10-firsts")
    best = common.written(_best(scored(firsts.withColumn("block", F.col("first"))), k).select("query_id", "rank", "vec_id", "score"), "op10-best")
    after = firsts.drop("least").join(kth(best), F.col("vec_id") == F.col("_q"), "left").drop("_q").withColumn("least", F.coalesce("kth", F.lit(NONE))).drop("kth")
    after = common.written(after, "op10-state")
    common.forget(rows, state, firsts)
    state = after
    listed = common.written(met(state).mapInArrow(_visits, _ddl(_VISITS)).withColumnRenamed("query_id", "_v"), "op10-visits")
    for band in range(1, BANDS):
        # From `upper`, the end of the band before, down to `lower`: half way to the k-th score, or all that is left.
        half = F.when(F.col("least") > NONE, F.col("least") + F.shiftright(F.col("upper") - F.col("least"), 1)).otherwise(F.lit(NONE))
        live = state.filter(F.col("lower") > F.col("least")).withColumnRenamed("lower", "upper")
        live = live.withColumn("lower", half if band < BANDS - 1 else F.lit(NONE))
        turn = live.join(listed, (live["vec_id"] == listed["_v"]) & (F.col("bound") < F.col("upper")) & (F.col("bound") >= F.greatest("lower", "least")))
        found = scored(turn.select("block", "vec_id", "v", "least")).unionByName(best.drop("rank"))
        better = common.written(_best(found, k).select("query_id", "rank", "vec_id", "score"), "op10-best")
        common.forget(best)
        best = better
        if band == BANDS - 1:
            break
        after = live.drop("least", "upper").join(kth(best), F.col("vec_id") == F.col("_q"), "left").drop("_q").withColumn("least", F.coalesce("kth", F.lit(NONE))).drop("kth")
        after = common.written(after, "op10-state")
        common.forget(state)
        state = after
        if state.filter(F.col("lower") > F.col("least")).isEmpty():
            break
    common.forget(listed)
    common.forget(blocks, heads, state)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best of all other embeddings for every embedding whose id is divisible by 50."""
    return top_k(common.table(spark, sf_dir, "embeddings"), lambda v: v % 50 == 0)


SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5"""
