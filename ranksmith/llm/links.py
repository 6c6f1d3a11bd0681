"""Connected components of links, by alternating stars on tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def union_find(pairs) -> dict[int, int]:
    """Smallest member by node, of the components of ``pairs``."""
    up: dict[int, int] = {}

    def root(x):
        while (p := up.setdefault(x, x)) != x:
            up[x] = up[p]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(up)}


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Star edges (node, smallest node) of a batch's own components."""
    for b in batches:
        near = union_find(zip(b.column("a").to_pylist(), b.column("b").to_pylist()))
        pairs = [(x, r) for x, r in near.items() if x != r]
        if pairs:
            a, r = zip(*pairs)
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(r, pa.int64())})


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star step: every node's neighbours (the larger ones, or the others
    and itself) are tied to the smallest of them."""
    lo, hi = F.least("a", "b"), F.greatest("a", "b")
    if large:
        ends = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select("b", "a"))
    else:
        ends = edges.select(hi.alias("u"), lo.alias("v"))
    least = stored(ends.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "stars")
    both = ends.join(least, "u")
    if large:
        out = both.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = both.select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(
            least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return stored(out.where("a <> b").distinct(), "stars")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b); root: the smallest node
    reachable.  Nodes tied to nothing but themselves are left out."""
    cores = edges.sparkSession.sparkContext.defaultParallelism
    edges = stored(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
                   .where("a <> b").distinct(), "links")
    # fewer, fuller batches contract more; each holds some thousand rows
    edges = stored(edges.coalesce(cores).mapInArrow(_contract, "a long, b long"), "links")

    def state():
        return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    before = None
    while (now := state()) != before:
        before = now
        if now[0]:
            edges = _stars(_stars(edges, True), False)
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stored(roots.unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()), "roots")
