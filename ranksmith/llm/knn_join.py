"""Exact top-k by integer inner product: a Voronoi join with pivot bounds.

Vectors become integers, floor(scale * x) in each component.  Rows are
assigned to the nearest of some pivots, and each cell is cut into blocks of
about ``BLOCK_ROWS`` rows by row number hash, so that a cell of any size, also
one of equal vectors, is spread over many tasks.  Per cell, a summary holds
its row count and radius r (largest distance from the pivot p).  For a query q
and any x of the cell

    q.p - |q| r  <=  q.x  <=  q.p + |q| r .

The lower bounds of the cells, with their counts, give a value that the k-th
best score reaches at least; a query is sent only to the blocks of cells whose
upper bound reaches it, and a block's rows only to the slices of queries that
visit it.  Each block is solved by matrix products, and the
blocks' lists are merged.  Nothing is approximate: the bounds carry a margin
for rounding, and the products are exact in float64 while the components stay
below 2^20.

Pivots are rows with the smallest hashes among at most ``SAMPLE_ROWS`` (a
bounded sample; any pivots give the same answer).  Vectors that are null or
hold null or non-finite components take no part, as queries or candidates;
shorter vectors count as filled up with zeros.  Ties go to the smaller id;
repeated rows are candidates of their own, each with its rank.  Rows with a
null id take no part.  Empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

PIVOTS = 64
SAMPLE_ROWS = 4096
BLOCK_ROWS = 4096
QUERY_ROWS = 4096


def whole_vectors(rows: DataFrame, vec_id: str, embedding: str, scale: int) -> DataFrame:
    """(vec_id, v): the integer vectors that take part."""
    v = F.col(embedding).cast("array<double>")
    ok = F.col(embedding).isNotNull() & ~F.exists(
        v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (rows.where(ok & F.col(vec_id).isNotNull())
            .select(F.col(vec_id).cast("long").alias("vec_id"),
                    F.transform(v, lambda x: F.floor(x * F.lit(scale)).cast("double")).alias("v")))


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    """A list column as rows filled up with zeros."""
    lens = np.diff(np.asarray(col.offsets))
    flat = np.asarray(col.flatten(), np.float64)
    out = np.zeros((len(col), dim))
    out[np.repeat(np.arange(len(col)), lens),
        np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)] = flat
    return out


def _nearest(m: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = (m * m).sum(1)[:, None] - 2 * m @ pivots.T + (pivots * pivots).sum(1)[None, :]
    cell = d.argmin(axis=1)
    return cell, np.sqrt(np.maximum(d[np.arange(len(m)), cell], 0))


def _assign(shared, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = _matrix(b.column("v"), dim)
            cell, dist = _nearest(m, shared.value)
            yield pa.RecordBatch.from_pydict({
                "vec_id": b.column("vec_id"), "v": b.column("v"), "cell": pa.array(cell.astype(np.int32)),
                "dist": pa.array(dist)})
    return run


def _route(shared, dim: int, k: int):
    """Blocks that a query has to visit."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, count, radius, blocks, first = shared.value
        for b in batches:
            m = _matrix(b.column("v"), dim)
            mid = m @ pivots.T
            reach = np.sqrt((m * m).sum(1))[:, None] * radius[None, :]
            margin = 1e-6 * (1 + np.abs(mid) + reach)
            low, high = mid - reach - margin, mid + reach + margin
            order = np.argsort(-low, axis=1)
            total = np.cumsum(count[order], axis=1)
            # the query's own rows may be among them
            want = k + b.column("own").to_numpy()[:, None]
            at = np.argmax(total >= want, axis=1)
            floor = np.where(total[:, -1] >= want[:, 0], np.take_along_axis(low, np.take_along_axis(
                order, at[:, None], 1), 1)[:, 0], -np.inf)
            q, c = np.nonzero((high >= floor[:, None]) & (count > 0)[None, :])
            n = blocks[c]
            row = np.repeat(q, n)
            block = np.repeat(first[c] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            part = b.column("part").take(pa.array(row))
            yield pa.RecordBatch.from_pydict({"block": pa.array(block.astype(np.int64)), "part": part,
                                              "vec_id": b.column("vec_id").take(pa.array(row)),
                                              "v": b.column("v").take(pa.array(row))})
    return run


def _solve(dim: int, k: int):
    def run(key: tuple, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64),
                             "score": np.zeros(0, np.int64)})
        if not len(queries) or not len(rows):
            return none

        def matrix(vs):
            out = np.zeros((len(vs), dim))
            for i, v in enumerate(vs):
                out[i, :len(v)] = v
            return out

        ids = rows["vec_id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, m = ids[order], matrix(rows["v"])[order]
        out = []
        for lo in range(0, len(queries), 512):
            own = queries["vec_id"].to_numpy()[lo:lo + 512]
            s = matrix(queries["v"].iloc[lo:lo + 512]) @ m.T
            s[ids[None, :] == own[:, None]] = -np.inf
            # the columns stand in id order, so an earlier column wins a tie
            n = min(k, s.shape[1])
            cut = -np.partition(-s, n - 1, axis=1)[:, n - 1]
            q, c = np.nonzero((s >= cut[:, None]) & np.isfinite(s))
            sc = s[q, c]
            by = np.lexsort((c, -sc, q))
            q, c, sc = q[by], c[by], sc[by]
            rank = np.arange(len(q)) - np.searchsorted(q, q)
            top = rank < k
            out.append(pd.DataFrame({"query_id": own[q[top]], "vec_id": ids[c[top]],
                                     "score": sc[top].astype(np.int64)}))
        return pd.concat(out, ignore_index=True) if out else none
    return run


def top_k(rows: DataFrame, is_query: Column, k: int, vec_id: str = "vec_id", embedding: str = "embedding",
          scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``is_query`` (on
    ``vec_id``) marks, its ``k`` best other rows.

    A query's own row is every row with its id.  Queries of equal ids and
    vectors are asked once.
    """
    spark = rows.sparkSession
    vecs = whole_vectors(rows, vec_id, embedding, scale)
    dim = vecs.agg(F.max(F.size("v"))).first()[0] or 0
    schema = "query_id long, rank int, vec_id long, score long"
    if dim == 0 and vecs.limit(1).count() == 0:
        return spark.createDataFrame([], schema)
    dim = max(dim, 1)
    # the smallest hashes first (no shuffle of the table), then each vector once
    drawn = vecs.select(F.xxhash64("vec_id", "v").alias("h"), "v").orderBy("h").limit(SAMPLE_ROWS).collect()
    sample = list(dict.fromkeys(tuple(r["v"]) for r in drawn))
    pool = np.zeros((len(sample), dim))
    for i, v in enumerate(sample):
        pool[i, :len(v)] = v
    pivots = _spread(pool, PIVOTS)
    shared = spark.sparkContext.broadcast(pivots)
    cells = stored(vecs.mapInArrow(_assign(shared, dim), "vec_id long, v array<double>, cell int, dist double"),
                   "knn-cells")
    summary = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("r")).collect()
    count, radius = np.zeros(len(pivots), np.int64), np.zeros(len(pivots))
    for r in summary:
        count[r["cell"]], radius[r["cell"]] = r["n"], r["r"]
    blocks = -(-count // BLOCK_ROWS)
    first = np.cumsum(blocks) - blocks
    places = spark.createDataFrame([(i, int(b), int(f)) for i, (b, f) in enumerate(zip(blocks, first))],
                                   "cell int, blocks long, first long")
    own = cells.where(is_query).groupBy("vec_id").agg(F.count(F.lit(1)).alias("own"))
    asked = stored(cells.where(is_query).select("vec_id", "v").distinct().join(own, "vec_id"), "knn-queries")
    parts = max(1, -(-asked.count() // QUERY_ROWS))
    part = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(parts)).cast("int")
    route = spark.sparkContext.broadcast((pivots, count, radius, blocks, first))
    queries = asked.withColumn("part", part).mapInArrow(
        _route(route, dim, k), "block long, part int, vec_id long, v array<double>")
    # data go only where a query's bound reaches: blocks meet the parts that ask for them
    visits = stored(queries.select("block", "part").distinct(), "knn-visits")
    salted = (cells.join(F.broadcast(places), "cell")
              .withColumn("_u", F.monotonically_increasing_id())
              .select((F.col("first") + F.pmod(F.xxhash64("vec_id", "_u"), F.col("blocks"))).alias("block"),
                      "vec_id", "v").join(visits, "block"))
    lists = (queries.groupBy("block", "part").cogroup(salted.groupBy("block", "part"))
             .applyInPandas(_solve(dim, k), "query_id long, vec_id long, score long"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (lists.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def _spread(pool: np.ndarray, n: int) -> np.ndarray:
    """``n`` rows of the sample, each the farthest from those before it in a
    random thirty-second part (at least) of it: spread out, but no outliers only."""
    chosen = [0]
    dist = ((pool - pool[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(pool)):
        at = np.arange(len(chosen) % 32, len(pool), 32)
        at = at if len(at) and dist[at].max() > 0 else np.arange(len(pool))
        new = int(at[dist[at].argmax()])
        if dist[new] <= 0:
            break
        chosen.append(new)
        dist = np.minimum(dist, ((pool - pool[new]) ** 2).sum(1))
    return pool[chosen]
