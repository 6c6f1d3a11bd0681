"""Small plan helpers shared by the operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir

# Largest side we hint for broadcast without asking AQE: rows, and bytes of
# what they hold.  Both are checked on the data, never assumed.
BROADCAST_MAX_ROWS = 500_000
BROADCAST_MAX_BYTES = 64 << 20

# Ranking keys are rounded so that parallel float sums that differ only in
# the last bits order the same way in Spark and in the SQL oracle.
RANK_DIGITS = 9
OUT_DIGITS = 6


def has_at_most(df: DataFrame, n: int) -> bool:
    """True when ``df`` has at most ``n`` rows (reads at most n+1 rows)."""
    return df.limit(n + 1).count() <= n


def _held_bytes(df: DataFrame) -> Column:
    """Bytes of a row: 8 for each number, and the length of the rest."""
    parts = [F.lit(8)]
    for name, kind in df.dtypes:
        if kind == "string":
            parts.append(F.coalesce(F.octet_length(F.col(f"`{name}`")), F.lit(0)) + 16)
        elif kind.startswith(("array", "map", "struct")):
            parts.append(F.coalesce(F.octet_length(F.to_json(F.struct(F.col(f"`{name}`")))), F.lit(0)) + 16)
        else:
            parts.append(F.lit(8))
    return sum(parts[1:], parts[0]).cast("long")


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS,
                       max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Broadcast hint only behind a checked bound of rows and bytes;
    otherwise the strategy is left to Catalyst + AQE (shuffle join, skew
    splitting).  The checked rows are stored, so a side that is broadcast
    runs its plan once."""
    checkpoint_dir(df.sparkSession)
    held = df.limit(max_rows + 1).checkpoint(eager=True)
    n, size = held.agg(F.count(F.lit(1)), F.coalesce(F.sum(_held_bytes(held)), F.lit(0))).first()
    return F.broadcast(held) if n <= max_rows and size <= max_bytes else df


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as compressed Parquet in the shared folder: a fraction of a
    checkpoint's bytes, and readers take the columns they need."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scalar(df: DataFrame) -> Column:
    """One-row, one-column DataFrame as a lazy scalar subquery."""
    return df.scalar()


def rank_key(score: str | Column) -> Column:
    s = F.col(score) if isinstance(score, str) else score
    return F.round(s, RANK_DIGITS)


def ranked(df: DataFrame, part: str | list[str], score: str, tie: str,
           rank_col: str = "rank") -> DataFrame:
    """Add a 1-based ``rank`` per partition by (score desc, tie asc)."""
    parts = [part] if isinstance(part, str) else part
    w = Window.partitionBy(*parts).orderBy(rank_key(score).desc(), F.col(tie).asc())
    return df.withColumn(rank_col, F.row_number().over(w))


def topk(df: DataFrame, part: str | list[str], score: str, tie: str, k: int,
         rank_col: str = "rank") -> DataFrame:
    """Best ``k`` rows per partition.  ``row_number() <= k`` lets Catalyst
    insert a partial ``WindowGroupLimit`` below the shuffle, so at most k
    rows per key leave each map task."""
    return ranked(df, part, score, tie, rank_col).filter(F.col(rank_col) <= k)


def with_term_freqs(df: DataFrame, tokens: str, out: str) -> DataFrame:
    """Add ``out`` = array<struct<token,tf>> counted inside each row (sort,
    then run lengths), so building postings needs no shuffle.  The sorted
    array and the run starts are separate projections: each is referenced
    twice below, which keeps Catalyst from inlining them into the lambda.
    Explode the result with ``explode_outer`` + a null filter: a plain
    ``explode`` makes Catalyst infer ``size(out) > 0`` and push it below
    these projections, which inlines them again (quadratic)."""
    df = df.withColumn("_rs_s", F.sort_array(F.col(tokens)))
    df = df.withColumn("_rs_st", F.expr(
        "filter(sequence(1, size(_rs_s)), "
        "i -> i = 1 OR try_element_at(_rs_s, i - 1) != try_element_at(_rs_s, i))"))
    df = df.withColumn(out, F.expr(
        "CASE WHEN size(_rs_s) = 0 THEN array() ELSE transform(_rs_st, (st, j) -> named_struct("
        "'token', try_element_at(_rs_s, st), "
        "'tf', CAST(coalesce(try_element_at(_rs_st, j + 2), size(_rs_s) + 1) - st AS BIGINT))) END"))
    return df.drop("_rs_s", "_rs_st")
