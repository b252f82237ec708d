"""Connected components of a distributed edge list."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, batch_of, tidy

EDGES = "u bigint, v bigint"


@tidy
def _forest(batches):
    """Union-find within a partition: each node with the smallest node of its tree."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(p, p)
        return x

    for batch in batches:
        for a, b in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    rows = [(x, r) for x in parent if (r := root(x)) != x]
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    for i in range(0, len(rows), 50_000):
        u, v = zip(*rows[i : i + 50_000], strict=True)
        yield batch_of(schema, (u, v))


def _step(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: every larger neighbour of a node to the node's smallest one; small star: every smaller one and the node."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, scratch: Scratch, tag: str = "cc") -> DataFrame:
    """(u, v) pairs to (id, component): the smallest id reachable, for every id that an edge names.

    Union-find contracts each partition; then large-star and small-star steps
    alternate until they change nothing. No node's neighbours are gathered in
    one place: minima are aggregated and joined back. Null ends and loops are
    ignored; an empty input gives an empty result.
    """
    now = scratch.save(f"{tag}_0", edges.select("u", "v").where("u <> v").mapInArrow(_forest, EDGES))
    mark, k = None, 0
    while True:
        k += 1
        new = scratch.save(f"{tag}_{k}", _step(_step(now, True), False))
        got = new.agg(F.count("*"), F.sum(F.col("v").cast("decimal(20,0)")), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        scratch.drop(f"{tag}_{k - 1}")
        now = new
        if tuple(got) == mark:
            break
        mark = tuple(got)
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
