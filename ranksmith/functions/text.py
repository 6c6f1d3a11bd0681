"""Text functions as Column expressions (all JVM-side, inside codegen).

Every regular expression here is written with explicit character classes
that mean the same thing in Java regex (Spark) and RE2 (the DuckDB
oracle): never ``\\s`` / ``\\w``, whose meaning differs between engines.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as Python's ``str.split()`` sees it (Unicode White_Space plus
# the ASCII information separators), spelled with code points so Java
# regex and RE2 read the same class.
WS_CLASS = (r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
            r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
WS_RE = WS_CLASS + "+"
# A word character: letter, number or underscore (Unicode-aware ``\w``).
WORD_RE = r"[\p{L}\p{N}_]+"
# Two or more word characters: the default TF-IDF token pattern.
WORD2_RE = r"[\p{L}\p{N}_]{2,}"
# What lies between words.
NON_WORD_RE = r"[^\p{L}\p{N}_]+"

# --- fixed values: keyword sets used by the query-type features --------
AGGREGATION_KEYWORDS = ["count", "average", "avg", "sum", "total", "maximum", "max",
                        "minimum", "min", "mean", "stddev", "variance", "median"]
JOIN_KEYWORDS = ["join", "combine", "merge", "link", "relate", "connect",
                 "associated", "corresponding", "along with", "together with"]
SUBQUERY_KEYWORDS = ["for each", "per", "among", "within", "those that",
                     "having", "where the", "only those", "excluding"]
# --- end of fixed values ------------------------------------------------


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tok_ws(c) -> Column:
    """Lower-case, split on whitespace, drop empty pieces; repeats kept."""
    return F.array_remove(F.split(F.lower(col_(c)), WS_RE), "")


def ws_set(c) -> Column:
    """Distinct whitespace tokens of the lower-cased text."""
    return F.array_distinct(tok_ws(c))


def tok_word(c) -> Column:
    """Set of word tokens (``\\w+``) of the lower-cased text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(col_(c)), F.lit(WORD_RE), 0))


def tok_word2(c) -> Column:
    """Word tokens of 2+ characters, repeats kept (TF-IDF tokenizer)."""
    return F.regexp_extract_all(F.lower(col_(c)), F.lit(WORD2_RE), 0)


def tok_clean_plural(c, strip_chars: str = "?,.()_") -> Column:
    """Whitespace tokens with the given edge characters stripped, plus the
    singular (final ``s`` removed) of every token longer than four
    characters; returned as a set."""
    cls = "".join("\\" + ch for ch in strip_chars)
    toks = F.filter(
        F.transform(tok_ws(c), lambda t: F.regexp_replace(t, f"^[{cls}]+|[{cls}]+$", "")),
        lambda t: t != F.lit(""))
    singles = F.transform(
        F.filter(toks, lambda t: (F.length(t) > 4) & t.endswith(F.lit("s"))),
        lambda t: t.substr(F.lit(1), F.length(t) - 1))
    return F.array_union(F.array_distinct(toks), singles)


def trigram_set_expr(x: str) -> str:
    """SQL text of the trigram set of the (already lower-cased) column ``x``."""
    return (f"CASE WHEN length({x}) < 3 THEN array({x}) ELSE "
            f"array_distinct(transform(sequence(1, length({x}) - 2), "
            f"i -> substring({x}, i, 3))) END")


def with_trigrams(df, src: str, out: str):
    """Add ``out`` = trigram set of lower(``src``).  The lower-cased text is
    its own projection (referenced three times, so Catalyst keeps it)
    instead of being re-evaluated for every trigram inside the lambda."""
    tmp = f"_lc_{out}"
    df = df.withColumn(tmp, F.lower(F.col(src)))
    return df.withColumn(out, F.expr(trigram_set_expr(tmp))).drop(tmp)


def jaccard(a: Column, b: Column) -> Column:
    """|A ∩ B| / |A ∪ B| of two arrays holding sets; 0.0 when both empty."""
    inter = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - inter
    return F.when(union == 0, F.lit(0.0)).otherwise(inter / union)


def keyword_hits(text_lower: Column, keywords: list[str]) -> Column:
    """How many of the phrases occur as substrings of the text."""
    kws = F.array(*[F.lit(k) for k in keywords])
    return F.size(F.filter(kws, lambda k: F.instr(text_lower, k) > 0))


def sql_text_normal(c) -> Column:
    """Lower case with all whitespace removed: the exact-match key."""
    return F.regexp_replace(F.lower(col_(c)), WS_RE, "")


def _trigram_count_udf():
    @F.pandas_udf("long")
    def trigram_count(s: pd.Series) -> pd.Series:
        def n(x):
            if x is None:
                return 1
            x = x.lower()
            return 1 if len(x) < 3 else len({x[i:i + 3] for i in range(len(x) - 2)})
        return s.map(n).astype("int64")
    return trigram_count


_TRIGRAM_COUNT = None


def trigram_count(c) -> Column:
    """Number of distinct trigrams of lower(text) (1 below three
    characters).  A vectorised pandas UDF: a long document's set is built
    once in a Python set instead of a 30k-element lambda array."""
    global _TRIGRAM_COUNT
    if _TRIGRAM_COUNT is None:
        _TRIGRAM_COUNT = _trigram_count_udf()
    return _TRIGRAM_COUNT(col_(c))


def trigram_jaccard(short_lower: str, short_grams: str, long_lower: str, long_count: Column) -> Column:
    """Jaccard of two trigram sets given the short text's set and the long
    text's distinct-trigram count: the intersection probes each short
    trigram in the long text with ``instr`` (native substring search)."""
    inter = F.size(F.filter(F.col(short_grams), lambda g: F.instr(F.col(long_lower), g) > 0))
    union = F.size(short_grams) + long_count - inter
    return F.when(union == 0, F.lit(0.0)).otherwise(inter / union)


def _strip_ws(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS_CLASS}+|{WS_CLASS}+$", "")


def sql_table_refs(df, sql_col: str, out: str = "refs"):
    """Add ``out`` = struct(tables, ctes) read from SQL text by a token
    scan: quotes and backticks removed, upper case, whitespace split; the
    word after WITH is a CTE name; the word after FROM / JOIN, cut at
    parentheses, unless it starts a subquery, is a table (last dotted
    part).  Both are distinct sets."""
    tmp = f"_w_{out}"
    words = F.array_remove(F.split(F.upper(F.regexp_replace(F.col(sql_col), "[`\"]", "")), WS_RE), "")
    df = df.withColumn(tmp, words)
    w = F.col(tmp)
    nxt = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 1, F.lit(1))),
                      lambda i: F.struct(F.try_element_at(w, i).alias("a"), F.try_element_at(w, i + 1).alias("b")))
    pairs = F.filter(nxt, lambda p: p["b"].isNotNull())
    ctes = F.array_distinct(F.transform(F.filter(pairs, lambda p: p["a"] == "WITH"), lambda p: p["b"]))
    cut = lambda b: F.split(F.split(b, "\\(").getItem(0), "\\)").getItem(0)
    cands = F.transform(F.filter(pairs, lambda p: p["a"].isin("FROM", "JOIN")), lambda p: cut(p["b"]))
    keep = F.filter(cands, lambda n: (n != "") & ~n.startswith("SELECT") & (n != "("))
    tables = F.array_distinct(F.transform(keep, lambda n: F.element_at(F.split(n, "\\."), -1)))
    return df.withColumn(out, F.struct(tables.alias("tables"), ctes.alias("ctes"))).drop(tmp)


def strip_code_fence(c) -> Column:
    """Body of a fenced code block (an ``sql`` tag dropped), or the text
    without fence lines when the fence is not closed; then a leading
    ``SQL:`` prefix removed."""
    s = col_(c)
    parts = F.split(s, "```")
    body = parts.getItem(1)
    body = _strip_ws(F.when(F.lower(body).startswith("sql"), body.substr(F.lit(4), F.length(body))).otherwise(body))
    lines = F.filter(F.split(s, "\n"), lambda ln: ~_strip_ws(ln).startswith("```"))
    unclosed = _strip_ws(F.array_join(lines, "\n"))
    t = F.when(F.instr(s, "```") > 0, F.when(F.size(parts) >= 3, body).otherwise(unclosed)).otherwise(s)
    return F.when(F.upper(t).startswith("SQL:"), _strip_ws(t.substr(F.lit(5), F.length(t)))).otherwise(t)
