"""Sharding: minimum-cost-flow resharding from old shard sizes to new capacities.

A block is a range of an old shard's rows in the order of a hash of their id. The flow
network has an arc from every old shard to every new one, free where the shard stays the
same and at 1 a byte elsewhere; its cheapest flow moves the fewest bytes that make the
new shards as full as their capacities. The network has old x new arcs whatever the
number of rows, so it is solved on the driver; the rows follow the flow by their running
byte offset in their old shard, and every step over rows is keyed by (shard, block).

The plan is made on narrow rows; then the files of all affected shards are written with
every column, by a join on the rows' places in the input files, and the result's columns
are read from them. Rows of other shards stay where they are.

Law of the result: `bytes`. Shards differ from their capacity by the rows that lie on the
borders of flows, at most one row for each border.

Defined results: a null or empty text has size 1 (no bytes plus 1); rows with equal ids
and texts are placed one after the other in any order; an empty table gives no rows.
Input columns are kept under their names, and the columns `shard` and `slot` are added to
the files; an input column of one of these names, or one that starts with `_rs_` as the
helpers do, is written with `in_` in front (as often as it takes to be new).
"""

from __future__ import annotations

import heapq
import math
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quakeframe.llm import common

OLD_SHARDS, NEW_SHARDS, MAX_BLOCKS = 6, 8, 4096
ROW = ["_rs_file", "_rs_row"]


def min_cost_flow(supply: list[int], capacity: list[int]) -> dict[tuple[int, int], int]:
    """Bytes from each old to each new shard, moving the fewest: successive shortest paths over residual arcs.

    Staying costs 0, moving 1. sum(capacity) has to be at least sum(supply).
    """
    n, m = len(supply), len(capacity)
    cost = lambda i, j: 0 if i == j else 1
    flow = {(i, j): 0 for i in range(n) for j in range(m)}
    left, room = list(supply), list(capacity)
    while any(left):
        # Dijkstra-like label correcting over old (0..n-1) and new (n..n+m-1) nodes.
        dist, back = {}, {}
        queue = [(0, i, None) for i in range(n) if left[i]]
        heapq.heapify(queue)
        best = None
        while queue:
            d, v, u = heapq.heappop(queue)
            if v in dist and dist[v] <= d:
                continue
            dist[v], back[v] = d, u
            if v >= n:
                if room[v - n] and (best is None or d < dist[best]):
                    best = v
                for i in range(n):
                    if flow[i, v - n]:
                        heapq.heappush(queue, (d - cost(i, v - n), i, v))
            else:
                for j in range(m):
                    heapq.heappush(queue, (d + cost(v, j), n + j, v))
        path = [best]
        while back[path[-1]] is not None:
            path.append(back[path[-1]])
        path.reverse()
        amount = min(left[path[0]], room[best - n], *[flow[b, a - n] for a, b in zip(path, path[1:], strict=False) if a >= n])
        for a, b in zip(path, path[1:], strict=False):
            if a < n:
                flow[a, b - n] += amount
            else:
                flow[b, a - n] -= amount
        left[path[0]] -= amount
        room[best - n] -= amount
    return {k: v for k, v in flow.items() if v}


def capacities(total: int, shards: int) -> list[int]:
    """Equal shares of `total`, at most one apart."""
    return [total // shards + (k < total % shards) for k in range(shards)]


def hashed_shard(doc_id: Column, shards: int) -> Column:
    """The old layout of a table without one: a hash of the id."""
    return F.pmod(F.xxhash64(doc_id.cast("string")), F.lit(shards)).cast("int")


def _block(h: Column, blocks: int) -> Column:
    return F.pmod(F.shiftright(h, 20), F.lit(blocks)).cast("int")


def plan(rows: DataFrame, old: str, size: str, order: list[str], capacity: list[int] | None = None, shards: int = NEW_SHARDS, blocks: int | None = None) -> DataFrame:
    """`rows` with `_rs_shard`, the new shard, and `_rs_slot`, gapless within it.

    `rows` should be a written table: it is read for the block sums and for the rows.
    `order` are the columns that order the rows of a block. Blocks: `blocks` for each old
    shard (the root of the row count, MAX_BLOCKS at most, unless given), so their sums are
    a table of bounded size.
    """
    blocks = blocks or max(1, min(MAX_BLOCKS, math.isqrt(rows.count())))
    df = rows.withColumn("_rs_block", _block(F.xxhash64(*order), blocks))
    sums = df.groupBy(F.col(old).alias("_rs_o"), F.col("_rs_block").alias("_rs_b")).agg(F.sum(size).alias("_rs_n"))
    sums = common.written(sums, "op9-blocks")
    supply_of = {r["_rs_o"]: r["n"] for r in sums.groupBy("_rs_o").agg(F.sum("_rs_n").alias("n")).collect()}
    supply = [supply_of.get(i, 0) for i in range(max(supply_of, default=-1) + 1)]
    flow = min_cost_flow(supply, capacity or capacities(sum(supply), shards))
    starts, at = {}, {}
    for (i, j), n in sorted(flow.items(), key=lambda x: (x[0][0], x[0][0] != x[0][1], x[0][1])):
        starts.setdefault(i, []).append((at.get(i, 0), j))
        at[i] = at.get(i, 0) + n
    before = F.sum("_rs_n").over(W.partitionBy("_rs_o").orderBy("_rs_b")) - F.col("_rs_n")
    offsets = sums.withColumn("_rs_before", before).drop("_rs_n")
    df = df.join(offsets, (df[old] == offsets["_rs_o"]) & (df["_rs_block"] == offsets["_rs_b"]))
    inside = W.partitionBy(old, "_rs_block").orderBy(*order, size)
    middle = F.col("_rs_before") + F.sum(size).over(inside.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col(size) / 2
    shard = F.lit(None).cast("int")
    for i, runs in starts.items():
        here = F.lit(runs[0][1])
        for begin, j in runs[1:]:
            here = F.when(F.col("_rs_middle") >= begin, F.lit(j)).otherwise(here)
        shard = F.when(F.col(old) == i, here).otherwise(shard)
    df = df.withColumn("_rs_middle", middle).withColumn("_rs_shard", shard)
    # Slots: rank within (shard, old shard, block) after the rows of the shard's earlier blocks.
    df = df.withColumn("_rs_rank", F.row_number().over(W.partitionBy(old, "_rs_block", "_rs_shard").orderBy(*order, size)) - 1)
    return df.drop("_rs_o", "_rs_b", "_rs_before", "_rs_middle")


def slots(placed: DataFrame, old: str) -> DataFrame:
    """A written table of `plan` with _rs_slot: a row's rank in its block plus the counts of the shard's earlier blocks."""
    key = [F.col("_rs_shard").alias("_s"), F.col(old).alias("_o"), F.col("_rs_block").alias("_b")]
    counts = placed.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    earlier = F.sum("_n").over(W.partitionBy("_s").orderBy("_o", "_b")) - F.col("_n")
    counts = counts.withColumn("_e", earlier).drop("_n")
    df = placed.join(counts, (placed["_rs_shard"] == counts["_s"]) & (placed[old] == counts["_o"]) & (placed["_rs_block"] == counts["_b"]))
    return df.withColumn("_rs_slot", F.col("_rs_rank") + F.col("_e")).drop("_s", "_o", "_b", "_e", "_rs_rank", "_rs_block")


def rewrite(docs: DataFrame, assignment: DataFrame, out: str, key: str | list[str] = "doc_id", old: str = "_rs_old") -> list[int]:
    """Writes the files of all shards that the plan changes to `out`/shard=K and returns their numbers; others stay where they are.

    `assignment` has one row for each row of `docs`, found by `key` (nulls match): its old shard, `_rs_shard` and perhaps `_rs_slot`,
    written as `slot`. A key that isn't unique in both would lose or multiply rows; that raises an error.
    """
    keys = [key] if isinstance(key, str) else key
    changed = assignment.filter(F.col(old) != F.col("_rs_shard"))
    pairs = changed.select(F.col(old).alias("a"), F.col("_rs_shard").alias("b")).distinct().collect()  # old x new at most
    affected = sorted({x for r in pairs for x in (r["a"], r["b"])})
    if not affected:
        return affected
    slot = [F.col("_rs_slot").alias("slot")] if "_rs_slot" in assignment.columns else []
    rows = assignment.filter(F.col("_rs_shard").isin(affected))
    rows = rows.select(*[F.col(c).alias(f"_rs_key{k}") for k, c in enumerate(keys)], *slot, F.col("_rs_shard").alias("shard"))
    same = reduce(lambda x, y: x & y, [docs[c].eqNullSafe(rows[f"_rs_key{k}"]) for k, c in enumerate(keys)])
    made = docs.join(rows.hint("shuffle_hash"), same).drop(*rows.columns[: len(keys)], *[c for c in keys if c in ROW])
    made.write.mode("overwrite").partitionBy("shard").parquet(out)
    got, want = docs.sparkSession.read.parquet(out).count(), rows.count()
    if got != want:
        raise ValueError(f"{got} rows written for {want} planned: {keys} isn't a key")
    return affected


def file_names(columns: list[str]) -> list[str]:
    """The names of input columns in the files."""
    ours = lambda c: c.lower() in ("shard", "slot") or c.lower().startswith("_rs_")
    taken, out = {c.lower() for c in columns if not ours(c)}, []
    for c in columns:
        if ours(c):
            while ours(c) or c.lower() in taken:
                c = f"in_{c}"
            taken.add(c.lower())
        out.append(c)
    return out


def with_row_key(docs: DataFrame) -> DataFrame:
    """`docs`, read from Parquet, under their names in the files, with the columns ROW: each row's file and place in it, which are unique and the same at every read."""
    named = [F.col(f"`{a}`").alias(b) for a, b in zip(docs.columns, file_names(docs.columns), strict=True)]
    of_file = docs.metadataColumn("_metadata")  # the file's own, whatever the columns are called
    return docs.select(*named, of_file["file_path"].alias(ROW[0]), of_file["row_index"].alias(ROW[1]))


def _facts(docs: DataFrame) -> list[Column]:
    """doc_id, size, text_crc32 and the old shard of rows with a text."""
    body = common.text_of(docs)
    return [docs["doc_id"], (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(F.encode(body, "UTF-8")).cast("long").alias("text_crc32"), hashed_shard(docs["doc_id"], OLD_SHARDS).alias("_rs_old")]


def reshard(docs: DataFrame, out: str, capacity: list[int] | None = None) -> DataFrame:
    """Moves the rows of `docs` (read from Parquet) to their new shards, whose files are written to `out`; what the query returns.

    Rows of affected shards are described from the files written, the others from where they stay.
    """
    docs = with_row_key(docs)
    rows = common.written(docs.select(*_facts(docs), *ROW), "op9-rows")
    placed = common.written(plan(rows, "_rs_old", "size", ["doc_id", "text_crc32"], capacity), "op9-placed")
    placed = common.written(slots(placed, "_rs_old"), "op9-slots")
    affected = rewrite(docs, placed, out, ROW)
    facts = ["doc_id", "size", "text_crc32", "_rs_old"]
    df = placed.filter(~F.col("_rs_shard").isin(affected)).select(*facts, F.col("_rs_shard").alias("shard"), F.col("_rs_slot").alias("slot"))
    if affected:
        new = docs.sparkSession.read.parquet(out)
        df = df.unionByName(new.select(*_facts(new), "shard", "slot"))
    return df.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"), F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"), F.col("_rs_old").alias("old_shard"))


def op9_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents from 6 hashed shards into 8 of near equal bytes, moving the fewest bytes; the new files lie in the shared folder."""
    return reshard(common.table(spark, sf_dir, "documents"), f"{common.shared_dir(spark)}/op9-shards-{uuid.uuid4().hex}")


SQL = None
