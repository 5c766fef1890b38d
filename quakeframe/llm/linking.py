"""Connected components of a similarity among the members of groups, without all pairs of a large group.

First, the groups of a part of the keys are compared: whole where they fit a chunk, else in
chunks dealt by hash; that joins what is much alike, such as thousands of near copies.
Then every group is seen as its largest component and the members outside it. Outsiders
are held against all members of that component, once for all the groups that they meet it
in, and against each other inside their groups. Two members of one component are compared
no more, since they can't join anything. So the result is that of all pairs in all groups,
while n near copies of one text cost about n comparisons and not n^2 / 2, and as many rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quakeframe.llm import common
from quakeframe.llm.components import components

CHUNK, DEALINGS = 512, 3
EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])
EDGES_DDL = "a long, b long"
#: near(k, rest): which of the members `rest` are similar to member k; how it is made of their payloads; how rows with an id get the payloads.
Near = Callable[[int, np.ndarray], np.ndarray]
Maker = Callable[[list[bytes]], Near]
Payloads = Callable[[DataFrame], DataFrame]


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The runs of rows that agree in the first `keys` columns of sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        codes = np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in range(keys)])
        bounds = [0, *(np.flatnonzero((codes[:, 1:] != codes[:, :-1]).any(0)) + 1).tolist(), b.num_rows]
        for x, y in zip(bounds, bounds[1:], strict=False):
            code = codes[:, x].tolist()
            if held and code != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(x, y - x))
            last = code
    if held:
        yield pa.Table.from_batches(held)


def forest(n: int, near: Near) -> np.ndarray:
    """The first member of each member's component; a member that a tree has reached is compared with the unreached ones only."""
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


def _edges(parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    a, b = [], []
    for x, y in parts:
        if len(x):
            a.append(x)
            b.append(y)
        if len(a) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], schema=EDGES)
            a, b = [], []
    if a:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], schema=EDGES)


def _members(g: pa.Table, *more: str) -> tuple[np.ndarray, ...]:
    """Different ids of a table, their payloads and other columns; a member may be given twice."""
    ids, at = np.unique(g.column("id").to_numpy(), return_index=True)
    payload = g.column("payload").to_pylist()
    return ids, [payload[k] for k in at], *[g.column(c).to_numpy()[at] for c in more]


def _inside(make: Maker):
    """Edges of a spanning forest of each run of rows that agree in their first three columns (and id, payload)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for g in groups(batches, 3):
                ids, payload = _members(g)
                if len(ids) > 1:
                    root = forest(len(ids), make(payload))
                    other = np.flatnonzero(root != np.arange(len(ids)))
                    yield ids[other], ids[root[other]]

        yield from _edges(parts())

    return run


def _across(make: Maker):
    """An edge from each outsider to each component that it is similar to, in a pair of chunks (key, i, j, role, id, comp, payload)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for g in groups(batches, 3):
                role, every = g.column("role").to_numpy(), g.column("id").to_numpy()
                ids, payload, comp = _members(g, "comp")
                asks, answers = np.isin(ids, every[role == 1]), np.isin(ids, every[role == 0])
                near = make(payload)
                for k in np.flatnonzero(asks):
                    rest = np.flatnonzero(answers & (comp != comp[k]))
                    found = rest[near(k, rest)] if len(rest) else rest
                    _, first = np.unique(comp[found], return_index=True)
                    yield np.full(len(first), ids[k]), ids[found[first]]

        yield from _edges(parts())

    return run


def _chunks(n: Column) -> Column:
    return F.ceil(n / CHUNK).cast("int")


def _each(n: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(n) - 1))


def _place(n: str, salt: int) -> Column:
    return F.pmod(F.xxhash64("id", F.lit(salt)), F.col(n)).cast("int")


def grouped(members: DataFrame) -> DataFrame:
    """(_k, n) of the groups of (key, id) with two members or more, one key for all groups of the same members."""
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.min("id").alias("a"), F.max("id").alias("b")).filter("n > 1")
    return sizes.groupBy("n", "x", "a", "b").agg(F.min("key").alias("_k")).select("_k", "n")


def _asked(outside: DataFrame, of: DataFrame, payloads: Payloads, make: Maker) -> DataFrame:
    """Edges between outsiders (id, comp, main) and members of the components `main`."""
    asks = outside.select("id", "comp", F.col("main").alias("key")).distinct()
    targets = asks.groupBy(F.col("key").alias("_t")).agg(_chunks(F.count(F.lit(1))).alias("outer"))
    found = of.join(targets, of["root"] == targets["_t"]).select("id", F.col("root").alias("key"), "outer")
    alone = targets.join(of.select(F.col("root").alias("_r")).distinct(), F.col("_t") == F.col("_r"), "left_anti").select(F.col("_t").alias("id"), F.col("_t").alias("key"), "outer")
    members = found.unionByName(alone)
    own = members.groupBy(F.col("key").alias("_o")).agg(_chunks(F.count(F.lit(1))).alias("own"), F.max("outer").alias("_outer"))
    answers = members.join(own, F.col("key") == F.col("_o")).select("key", "id", F.col("key").alias("comp"), F.lit(0).alias("role"), _each("outer").alias("i"), _place("own", 2).alias("j"))
    asks = asks.join(own, F.col("key") == F.col("_o")).select("key", "id", "comp", F.lit(1).alias("role"), _place("_outer", 1).alias("i"), _each("own").alias("j"))
    pairs = payloads(answers.unionByName(asks)).select("key", "i", "j", "role", "id", "comp", "payload").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return pairs.mapInArrow(_across(make), EDGES_DDL)


def _among(outside: DataFrame, payloads: Payloads, make: Maker, split: Callable[[DataFrame], DataFrame] | None, name: str) -> DataFrame:
    """Edges among the outsiders (key, id) of each group: of all pairs, in pairs of chunks where there are many."""
    rows = outside.select("key", "id")
    sizes = common.written(grouped(rows), f"{name}-sizes")
    rows = rows.join(sizes, F.col("key") == F.col("_k")).select("key", "id", _chunks(F.col("n")).alias("n"))
    if split:
        large = split(payloads(rows.filter("n > 1")))
        parts = grouped(large)
        rows = rows.filter("n = 1").unionByName(large.join(parts, F.col("key") == F.col("_k")).select("key", "id", _chunks(F.col("n")).alias("n")))
    rows = rows.withColumn("c", _place("n", 3)).withColumn("o", _each("n"))
    rows = rows.select("key", "id", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"))
    dealt = payloads(rows).select("key", "i", "j", "id", "payload").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(_inside(make), EDGES_DDL)


def linked(first: DataFrame, later: DataFrame | None, payloads: Payloads, make: Maker, name: str, dealings: int = DEALINGS, split: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """A written table (id, root) of the members that are similar to another member of one of their groups.

    `first` has key, id and chunks, the number of chunks that a group is cut into; `later` more groups (key, id). `payloads`
    adds the column payload to such rows, `make` turns payloads into Near. `split`, if given, cuts large groups of outsiders
    into smaller ones between which no pair matters: rows (key, id, payload) come back as (key, id).
    """
    rounds = F.when(F.col("chunks") > 1, dealings).otherwise(1)
    dealt = first.withColumn("round", F.explode(F.sequence(F.lit(1), rounds)))
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("id", "key", "round"), F.col("chunks")).cast("int"))
    dealt = payloads(dealt).select("key", "round", "chunk", "id", "payload").repartition("key", "round", "chunk").sortWithinPartitions("key", "round", "chunk")
    edges = common.written(dealt.mapInArrow(_inside(make), EDGES_DDL).distinct(), f"{name}-inside")
    found = components(edges, name)
    rest = first.filter(F.col("chunks") > 1).select("key", "id")
    if later is None and rest.isEmpty():
        common.forget(edges)
        return found
    rest = rest if later is None else rest.unionByName(later)
    of = found.select(F.col("id").alias("_i"), "root")
    rest = rest.join(of, F.col("id") == F.col("_i"), "left").select("key", "id", F.coalesce("root", "id").alias("comp"))
    sizes = rest.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy(F.col("key").alias("_k")).agg(F.sum("n").alias("all"), F.max(F.struct("n", "comp")).alias("main"))
    sizes = common.written(sizes.filter(F.col("all") > F.col("main.n")).select("_k", F.col("main.comp").alias("main")), f"{name}-mixed")
    outside = common.written(rest.join(sizes, (F.col("key") == F.col("_k")) & (F.col("comp") != F.col("main"))).select("key", "id", "comp", "main"), f"{name}-outside")
    if outside.isEmpty():
        common.forget(edges, sizes, outside)
        return found
    more = common.written(_asked(outside, found, payloads, make).unionByName(_among(outside, payloads, make, split, name)).distinct(), f"{name}-across")
    both = components(edges.unionByName(more), name)
    common.forget(edges, sizes, outside, more, found)
    return both
