"""Running products over ordered groups, whatever a group's size.

Rows are dealt by ranges of (group, order), so a group of very many rows lies
in several partitions.  Every partition multiplies its own rows; the products
of the few groups that cross a partition's edge (two a partition at most) are
combined in order and handed on.  The elements form a monoid: ``(n, x)`` stands
for ``n`` rows with the sum of ``value * base ** position``, and
``(n, x) * (m, y) = (n + m, x + base ** n * y)``, all mod 2^64.  Base 1 gives
plain running sums.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

MASK = (1 << 64) - 1


def power(base: int, n: int) -> int:
    return pow(base, n, 1 << 64)


def powers(base: int, n: np.ndarray) -> np.ndarray:
    """``base ** n`` mod 2^64, by squaring over the bits of all exponents."""
    out, square, left = np.ones(len(n), np.uint64), np.uint64(base & MASK), n.astype(np.uint64)
    while left.any():
        out[(left & np.uint64(1)).astype(bool)] *= square
        square, left = (np.array([square]) ** 2)[0], left >> np.uint64(1)
    return out


def _local(lanes: list[tuple[str, str, int]], group: str):
    """Positions (from 1) and products inside a partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, n0, carry = TaskContext.get().partitionId(), None, 0, [0] * len(lanes)
        for b in batches:
            if not b.num_rows:
                continue
            g = b.column(group).to_numpy()
            new = np.r_[g[0] != last if last is not None else True, g[1:] != g[:-1]]
            heads = np.flatnonzero(new) if new[0] else np.r_[0, np.flatnonzero(new)]
            size = np.diff(np.r_[heads, len(g)])
            begin = np.zeros(len(heads), np.int64)  # rows of the group before this batch
            if not new[0]:
                begin[0] = n0
            pos = np.arange(len(g)) - np.repeat(heads, size) + np.repeat(begin, size)
            cols = []
            for k, (value, _, base) in enumerate(lanes):
                v = b.column(value).to_numpy().astype(np.int64).view(np.uint64) * powers(base, pos)
                run_sum = np.cumsum(v, dtype=np.uint64)
                before = np.r_[np.uint64(0), run_sum][heads]
                if not new[0]:
                    before[:1] -= np.array([carry[k]], np.uint64)
                x = run_sum - np.repeat(before, size)
                carry[k] = int(x[-1])
                cols.append(x.view(np.int64))
            last, n0 = g[-1], int(pos[-1]) + 1
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(np.full(len(g), part, np.int32)), pa.array(pos + 1), *map(pa.array, cols)],
                [*b.schema.names, "_part", "pos", *(name for _, name, _ in lanes)])
    return run


def _carried(lanes, group: str, carries):
    """Positions and products from the group's begin on."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = carries.value
        for b in batches:
            if not b.num_rows:
                continue
            g, parts = b.column(group).to_numpy(), b.column("_part").to_numpy()
            n, xs = np.zeros(len(g), np.int64), [np.zeros(len(g), np.uint64) for _ in lanes]
            for part in np.unique(parts).tolist():
                for key, (before, products) in table.get(part, {}).items():
                    at = (parts == part) & (g == key)
                    n[at] = before
                    for x, p in zip(xs, products):
                        x[at] = np.uint64(p)
            out = {c: b.column(c) for c in b.schema.names if c != "_part"}
            out["pos"] = pa.array(b.column("pos").to_numpy() + n)
            for (_, name, base), x in zip(lanes, xs):
                own = b.column(name).to_numpy().view(np.uint64)
                out[name] = pa.array((x + powers(base, n) * own).view(np.int64))
            yield pa.RecordBatch.from_pydict(out)
    return run


def running(rows: DataFrame, group: str, ranges: list[Column], order: list[Column], keep: list[str],
            lanes: list[tuple[str, str, int]], prepare=None, schema: str | None = None) -> DataFrame:
    """``keep`` of ``rows`` with ``pos`` (from 1) and a running product per
    lane (value column, new column, base), per ``group`` (a long, not null).

    ``ranges`` deal the rows out and must agree with the finer ``order``, by
    which they are sorted.  ``prepare`` (a mapInArrow function giving
    ``schema``) may make the values of the sorted rows.
    """
    d = rows.repartitionByRange(F.col(group), *ranges).sortWithinPartitions(group, *order)
    if prepare is not None:
        d = d.mapInArrow(prepare, schema)
    d = d.select(*keep, *(v for v, _, _ in lanes if v not in keep))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields)
    new = "".join(f", {name} long" for _, name, _ in lanes)
    local = stored(d.mapInArrow(_local(lanes, group), f"{fields}, _part int, pos long{new}"), "scan")
    last = F.max_by(F.struct("pos", *(name for _, name, _ in lanes)), "pos").alias("last")
    ends = local.groupBy("_part", group).agg(last)
    across = stored(ends, "scan-ends")
    many = across.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(group)
    # groups that cross an edge: two a partition at most
    seams = across.join(many, group, "left_semi").orderBy(group, "_part").collect()
    carries, state = defaultdict(dict), {}
    for r in seams:
        n, xs = state.get(r[group], (0, [0] * len(lanes)))
        if n:
            carries[r["_part"]][r[group]] = (n, xs)
        xs = [(x + power(base, n) * r["last"][name]) & MASK for x, (_, name, base) in zip(xs, lanes)]
        state[r[group]] = (n + r["last"]["pos"], xs)
    shared = rows.sparkSession.sparkContext.broadcast(dict(carries))
    return local.mapInArrow(_carried(lanes, group, shared), f"{fields}, pos long{new}")
