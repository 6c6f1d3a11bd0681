"""Mixing overlapping sources to target weights by min-cost flow.

A document may belong to several sources.  Documents are aggregated by their
membership pattern; a flow network routes the patterns' tokens to the
sources' quotas, where every further repetition of a pattern costs more (a
convex cost, so nothing is repeated while unused tokens could serve the same
source).  The flow says how many tokens of each pattern the mix takes: whole
repetitions of all its documents, and one more repetition of a seeded subset.

The network has one node per pattern and source.  Patterns come from the
sources' names, not from the documents; ``MAX_PATTERNS`` bounds what reaches
the driver (more are refused with an error, never cut).

The subset is found without ordering a pattern's documents in one place:
sizes are summed by pattern and seeded hash bucket, the bucket where the
running sum crosses the wanted amount is opened by a second hash level, and
what is still missing is filled by the documents that fit best, one per
pattern and round.  Reruns agree, since nothing depends on the partitioning.

Null text has size 0, null sources count as a source of their own, repeated
rows are taken alike (a row's repeats stay within ``max_repeats``), an empty
table gives no rows, and extra columns are ignored.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stored

MAX_PATTERNS = 100_000
BUCKETS = 1 << 12
FILL_ROUNDS = 4


def word_count(text: str | Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def share_out(sizes: list[int], weights: list[float], total: float, cap: float) -> list[float]:
    """Targets by weight, none above ``cap`` times its size; the excess is
    shared again by weight among the others until none is above."""
    target, free, left = [0.0] * len(sizes), set(range(len(sizes))), float(total)
    while free:
        w = sum(weights[i] for i in free)
        over = {i for i in free if left * weights[i] / w > cap * sizes[i]}
        for i in over or free:
            target[i] = float(cap * sizes[i]) if over else left * weights[i] / w
        if not over:
            break
        left -= sum(target[i] for i in over)
        free -= over
    return target


def min_cost_flow(supply: list[int], members: list[list[int]], quota: list[int],
                  repeats: int) -> list[dict[int, int]]:
    """Flow of each pattern to its sources.

    Pattern ``p`` offers ``supply[p]`` tokens in each of ``repeats`` rounds,
    every round dearer than the one before; source ``s`` takes ``quota[s]``
    at most.  The largest flow of least cost, by cheapest augmenting paths:
    the costs sit on the patterns' arcs only, so all paths of one round cost
    the same and are searched breadth-first, to a source with free quota or
    through sources that other patterns can give up for another one.
    """
    flow: list[dict[int, int]] = [{s: 0 for s in m} for m in members]
    users: list[set[int]] = [set() for _ in quota]
    room = list(quota)
    for _ in range(repeats):
        for p in sorted(range(len(supply)), key=lambda i: (len(members[i]), i)):
            left = supply[p]
            while left > 0:
                # breadth-first: pattern -> source -> a pattern that uses it -> ...
                came: dict[int, tuple[int, int | None]] = {}  # source: (pattern before, source before)
                queue, seen, end = deque([(p, None)]), {p}, None
                while queue and end is None:
                    q, via = queue.popleft()
                    for s in members[q]:
                        if s in came:
                            continue
                        came[s] = (q, via)
                        if room[s] > 0:
                            end = s
                            break
                        for other in sorted(users[s] - seen):
                            seen.add(other)
                            queue.append((other, s))
                if end is None:
                    break
                path, s = [], end
                while s is not None:
                    q, via = came[s]
                    path.append((q, via, s))
                    s = via
                amount = min([left, room[end]] + [flow[q][via] for q, via, _ in path if via is not None])
                for q, via, s in path:
                    flow[q][s] += amount
                    users[s].add(q)
                    if via is not None:
                        flow[q][via] -= amount
                        if not flow[q][via]:
                            users[via].discard(q)
                room[end] -= amount
                left -= amount
    return flow


class Mix:
    """The decisions of a mix: what each pattern repeats whole, the seeded
    subset that is taken once more, and the documents that fill the rest."""

    def __init__(self, chosen: DataFrame, filled: DataFrame, seed: int):
        self.chosen, self.filled, self.seed = chosen, filled, seed

    def repeats(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with doc_id, _size, _pattern) and their ``_repeats``.

        Both sides that are broadcast hold some numbers for each pattern,
        ``MAX_PATTERNS`` x ``FILL_ROUNDS`` rows at most; the documents are
        not shuffled.
        """
        r = _hashed(rows, self.seed)
        f = self.filled
        return (r.join(F.broadcast(self.chosen), "_pat", "left")
                .join(F.broadcast(f), (r["_pat"] == f["f_pat"]) & r.doc_id.cast("long").eqNullSafe(f["f_id"])
                      & (r["_size"] == f["f_size"]), "left")
                .withColumn("_repeats", F.coalesce(F.col("whole"), F.lit(0))
                            + (_below() | F.coalesce("filled", F.lit(False))).cast("long"))
                .select(*rows.columns, "_repeats"))


def _hashed(rows: DataFrame, seed: int) -> DataFrame:
    h = F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"))
    return (rows.withColumn("_pat", F.xxhash64("_pattern")).withColumn("b1", F.pmod(h, F.lit(BUCKETS)))
            .withColumn("b2", F.pmod(F.shiftright(h, 20), F.lit(BUCKETS))))


def _below() -> Column:
    return F.coalesce((F.col("b1") < F.col("c1")) | ((F.col("b1") == F.col("c1")) & (F.col("b2") < F.col("c2"))),
                      F.lit(False))


def with_size(docs: DataFrame, sources: Column, size: Column) -> DataFrame:
    """``docs`` with _size and _pattern (its distinct sources, null last)."""
    null_last = lambda a, b: (F.when(a.isNull() & b.isNull(), 0).when(a.isNull(), 1).when(b.isNull(), -1)
                              .when(a < b, -1).when(a > b, 1).otherwise(0))
    none = F.array().cast("array<string>")
    return docs.withColumn("_size", size.cast("long")).withColumn(
        "_pattern", F.array_sort(F.array_distinct(F.coalesce(sources, none)), null_last))


def mix(sized: DataFrame, targets: Callable[[list[str | None], list[int]], list[float]],
        max_repeats: int = 2, seed: int = 17) -> Mix:
    """Decide the mix of ``sized`` (doc_id, _size, _pattern).

    ``targets`` gives each source's wanted tokens from the names (in code
    point order, null last) and their total sizes.
    """
    spark = sized.sparkSession
    # equal rows (one id, pattern and size) are decided together
    units = stored(_hashed(sized.groupBy(F.col("doc_id").cast("long").alias("doc_id"), "_pattern", "_size")
                           .agg(F.count(F.lit(1)).alias("copies")), seed)
                   .withColumn("weight", F.col("_size") * F.col("copies")), "mix-units")
    known = units.groupBy("_pattern", "_pat").agg(F.sum("weight").alias("size")).limit(MAX_PATTERNS + 1).collect()
    if len(known) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    known.sort(key=lambda r: [(s is None, s or "") for s in r["_pattern"]])
    names = sorted({s for r in known for s in r["_pattern"]}, key=lambda s: (s is None, (s or "").encode()))
    place = {s: i for i, s in enumerate(names)}
    members = [[place[s] for s in r["_pattern"]] for r in known]
    total = [0] * len(names)
    for r, m in zip(known, members):
        for i in m:
            total[i] += r["size"]
    flow = min_cost_flow([r["size"] for r in known], members, [round(t) for t in targets(names, total)], max_repeats)
    plan = []
    for r, f in zip(known, flow):
        amount = sum(f.values())
        whole = amount // r["size"] if r["size"] else 0
        plan.append((r["_pat"], whole, amount - whole * r["size"]))
    cut = spark.createDataFrame([(p, g) for p, _, g in plan if g], "_pat long, gap long")
    for level in ("b1", "b2"):
        cut = _open(units, cut, level)
    chosen = spark.createDataFrame([p[:2] for p in plan], "_pat long, whole long").join(
        F.broadcast(cut), "_pat", "left").select("_pat", "whole", "c1", "c2")
    chosen = stored(chosen, "mix-chosen")
    gaps = {r["_pat"]: r["gap"] for r in cut.collect()}
    filled: list[tuple[int, int | None, int, bool]] = []
    schema = "f_pat long, f_id long, f_size long, filled boolean"
    rest = units.join(F.broadcast(chosen), "_pat").where(~_below() & (F.col("weight") > 0))
    for last in [False] * (FILL_ROUNDS - 1) + [True]:
        gap = [(p, g) for p, g in gaps.items() if g > 0]
        if not gap:
            break
        got = spark.createDataFrame(filled, schema)
        left = (rest.join(F.broadcast(spark.createDataFrame(gap, "_pat long, gap long")), "_pat")
                .join(F.broadcast(got), (F.col("_pat") == F.col("f_pat")) & F.col("doc_id").eqNullSafe(F.col("f_id"))
                      & (F.col("_size") == F.col("f_size")), "left_anti"))
        # the last round may go over, where that ends nearer
        off = F.abs(F.col("gap") - F.col("weight"))
        left = left.where(off < F.col("gap") if last else F.col("weight") <= F.col("gap"))
        best = (left.groupBy("_pat").agg(F.min(F.struct(off.alias("off"), "b1", "b2", "doc_id", "_size", "weight"))
                                         .alias("m")).select("_pat", "m.weight", "m.doc_id", "m._size").collect())
        for r in best:
            filled.append((r["_pat"], r["doc_id"], r["_size"], True))
            gaps[r["_pat"]] -= r["weight"]
    return Mix(chosen, spark.createDataFrame(filled, schema), seed)


def _open(units: DataFrame, cut: DataFrame, level: str) -> DataFrame:
    """The bucket of ``level`` where each pattern's running sum crosses its
    gap, and the gap that is left before that bucket.  ``BUCKETS`` rows per
    pattern are ordered at most."""
    first = level == "b1"
    inside = units.join(F.broadcast(cut), "_pat")
    if not first:
        inside = inside.where(F.col("b1") == F.col("c1"))
    keys = ["_pat", "gap"] + ([] if first else ["c1"])
    sums = inside.groupBy(*keys, level).agg(F.sum("weight").alias("w"))
    upto = Window.partitionBy("_pat").orderBy(level).rowsBetween(Window.unboundedPreceding, 0)
    run = sums.withColumn("run", F.sum("w").over(upto)).where(F.col("run") > F.col("gap"))
    out = run.groupBy(*keys).agg(F.min(F.struct(level, "run", "w")).alias("m")).select(
        *[k for k in keys if k != "gap"], F.col(f"m.{level}").alias("c1" if first else "c2"),
        (F.col("gap") - (F.col("m.run") - F.col("m.w"))).alias("gap"))
    return stored(out, f"mix-cut-{level}")


def contract_targets(names: list[str | None], sizes: list[int]) -> list[float]:
    """Weights 5, 2, 1 repeating share 150 % of all sizes; twice a source's
    size is the most it can take."""
    weights = [(5.0, 2.0, 1.0)[i % 3] for i in range(len(names))]
    return share_out(sizes, weights, 1.5 * sum(sizes), 2.0)


def _by_contract(docs: DataFrame) -> tuple[DataFrame, Mix, DataFrame]:
    noted: list = []

    def targets(names, sizes):
        out = contract_targets(names, sizes)
        noted.extend(zip(names, sizes, out))
        return out

    sized = with_size(docs, F.array(F.col("source").cast("string")), word_count(F.col("text").cast("string")))
    plan = mix(sized, targets)
    info = docs.sparkSession.createDataFrame(noted, "m_source string, source_size long, target double")
    return sized, plan, info


def mix_documents(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, source of every document."""
    sized, plan, info = _by_contract(docs)
    rows = plan.repeats(sized.select("doc_id", "_size", "_pattern"))
    return (rows.withColumn("source", F.col("_pattern")[0])
            .join(F.broadcast(info), F.col("source").eqNullSafe(F.col("m_source")))
            .select("doc_id", F.col("_size").alias("size"), "source_size", "target",
                    (F.col("_size") * F.col("_repeats")).alias("taken"), "source"))


def mixed_corpus(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` (all columns), each as often as the mix takes it.

    A document without words weighs nothing, so no target asks for it: it goes.
    """
    packed = docs.select("doc_id", "text", "source", F.struct(*docs.columns).alias("_row"))
    sized, plan, _ = _by_contract(packed)
    rows = plan.repeats(sized.select("doc_id", "_size", "_pattern", "_row"))
    return (rows.where((F.col("_repeats") > 0) & (F.col("_size") > 0))
            .select("_row", F.explode(F.sequence(F.lit(1), F.col("_repeats"))).alias("_n")).select("_row.*"))
