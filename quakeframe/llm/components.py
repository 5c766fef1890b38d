"""Connected components of an edge table, by contraction to the smallest neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quakeframe.llm import common


def components(edges: DataFrame, name: str) -> DataFrame:
    """A written table (id, root) of every id that occurs in `edges` (a, b): root is one id of its component, the same for all of it.

    A round maps every vertex to the smallest of its neighbourhood, follows that pointer
    three more steps, and carries on with the edges between the images; a path shrinks by
    a factor of at least 4 and a star goes in one round. Vertices and edges stay distributed, and
    each round is written, so it is never computed again.
    """
    ab = edges.select("a", "b").filter(F.col("a") != F.col("b"))
    left = common.written(ab.union(ab.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    maps = []
    while not left.isEmpty():
        low = left.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("to"))
        first = low = common.written(low, f"{name}-low")
        for _ in range(2):
            via = low.select(F.col("id").alias("_v"), F.col("to").alias("_t"))
            low = low.join(via, low["to"] == via["_v"]).select("id", F.col("_t").alias("to"))
        low = common.written(low, f"{name}-map")
        maps.append(low)
        x, y = low.toDF("_a", "_x"), low.toDF("_b", "_y")
        moved = left.join(x, left["a"] == x["_a"]).join(y, left["b"] == y["_b"]).filter("_x <> _y")
        rest = common.written(moved.select(F.col("_x").alias("a"), F.col("_y").alias("b")).distinct(), f"{name}-edges")
        common.forget(left, first)
        left = rest
    out = maps[0].select("id", F.col("to").alias("root")) if maps else left.select(F.col("a").alias("id"), F.col("b").alias("root"))
    for m in maps[1:]:
        n = m.toDF("_f", "_t")
        out = out.join(n, out["root"] == n["_f"], "left").select("id", F.coalesce("_t", "root").alias("root"))
    out = common.written(out, f"{name}-roots")
    common.forget(left, *maps)
    return out
