"""Batch search: many questions scored against a corpus in one plan.

The searches score inside tasks that hold the questions' bounds (``scoring``)
and emit the best items only.  Items without a shared token have an implicit
score of 0; per-query min-max normalisation and top-k fill account for them.
``bm25_scores`` and ``tfidf_scores`` give all pairs that share a token as rows;
the searches use them only where a weight is negative (the mean idf of a very
small corpus can be), for which no bound holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tok_ws
from .index import Bm25Index, TfidfIndex, word_postings
from ..session import checkpoint_dir
from .scoring import Scorer, nonnegative
from .util import OUT_DIGITS, broadcast_if_small, rank_key, topk, with_term_freqs


def query_terms_ws(queries: DataFrame, text_col: str = "question") -> DataFrame:
    """(query_id, token, qtf): whitespace tokens with multiplicity."""
    q = queries.select("query_id", tok_ws(text_col).alias("toks"))
    q = with_term_freqs(q, "toks", "tfs")
    return (q.select("query_id", F.explode_outer("tfs").alias("p")).filter(F.col("p").isNotNull())
            .select("query_id", F.col("p.token").alias("token"), F.col("p.tf").alias("qtf")))


def pair_rows(scorer: Scorer, terms: DataFrame) -> DataFrame:
    """(query_id, item_id, ordinal, bm25, cosine) of every pair sharing a
    token: scored where the item's row lies, without a shuffle of pairs.

    The scores of rows that repeat an item add up; only the pairs of those
    items are dealt by key."""
    rows, keys = scorer.forward, ["item_id", "ordinal"]
    least = terms.agg(F.min("query_id")).first()[0]
    none = F.lit((least or 0) - 1)  # stands for a null question id
    asked = terms.withColumn("query_id", F.coalesce("query_id", none))
    checkpoint_dir(rows.sparkSession)
    twice = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*keys).checkpoint(eager=True)
    if twice.limit(1).count():
        t = broadcast_if_small(twice.toDF("_i", "_o"))
        same = F.col("item_id").eqNullSafe(F.col("_i")) & F.col("ordinal").eqNullSafe(F.col("_o"))
        again = scorer.pairs(asked, rows.join(t, same, "left_semi")).groupBy("query_id", *keys).agg(
            F.sum("bm25").alias("bm25"), F.sum("cosine").alias("cosine"))
        out = scorer.pairs(asked, rows.join(t, same, "left_anti")).unionByName(again)
    else:
        out = scorer.pairs(asked)
    return out.withColumn("query_id", F.nullif(F.col("query_id"), none))


def bm25_scores(index: Bm25Index, queries: DataFrame, text_col: str = "question") -> DataFrame:
    """(query_id, item_id, ordinal, score) for every pair sharing a token.  A
    repeated query token counts once per occurrence (weight qtf)."""
    p = pair_rows(bm25_scorer(index), bm25_terms(index, queries, text_col))
    return p.select("query_id", "item_id", "ordinal", F.col("bm25").alias("score"))


def tfidf_scores(index: TfidfIndex, queries: DataFrame, text_col: str = "question") -> DataFrame:
    """(query_id, item_id, ordinal, score): cosine of L2-normalised TF-IDF
    vectors.  Query tokens unseen in the corpus are dropped before normalising."""
    p = pair_rows(tfidf_scorer(index, index.rows.count()), tfidf_terms(index, queries, text_col))
    return p.select("query_id", "item_id", "ordinal", F.col("cosine").alias("score"))


def both_scores(scorer: Scorer, bm25: DataFrame, tfidf: DataFrame) -> DataFrame:
    """(query_id, item_id, ordinal, bm25, cosine) for every pair sharing a
    token of either kind, from one pass; null where none of the kind is shared."""
    return pair_rows(scorer, bm25.unionByName(tfidf))


def bm25_terms(index: Bm25Index, queries: DataFrame, text_col: str = "question") -> DataFrame:
    """(query_id, kind, token, w, df): the questions' weighted BM25 tokens;
    a repeated token counts once per occurrence.  Stored: every pass over the
    corpus reads them."""
    qt = broadcast_if_small(query_terms_ws(queries, text_col))
    return index.vocab.join(qt, "token").select(
        "query_id", F.lit(0).alias("kind"), "token", (F.col("qtf") * F.col("idf")).alias("w"), "df").checkpoint(eager=True)


def tfidf_terms(index: TfidfIndex, queries: DataFrame, text_col: str = "question") -> DataFrame:
    """(query_id, kind, token, w, df): the questions' L2-normalised TF-IDF
    vectors; tokens unseen in the corpus are dropped before normalising."""
    qp = broadcast_if_small(word_postings(queries, "query_id", text_col, index.stop))
    qw = index.vocab.join(qp, "token").withColumn("w", F.col("tf") * F.col("idf"))
    # a question's own tokens: as many as its text has
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("query_id")))
    return qw.select("query_id", F.lit(1).alias("kind"), "token", (F.col("w") / norm).alias("w"), "df").checkpoint(eager=True)


def _number(spark, *values: Column) -> list[float]:
    return [float(x or 0.0) for x in spark.range(1).select(*(v.alias(f"c{i}") for i, v in enumerate(values))).first()]


def candidate_scores(scorer: Scorer, bm25: DataFrame, tfidf: DataFrame, cands: DataFrame, n_items: Column) -> DataFrame:
    """(query_id, item_id, bm25, norm, cosine, bm25_rank, cosine_rank) of the
    ``cands``: raw BM25 (null where unmatched), min-max normalised BM25 (max
    floor), TF-IDF cosine, and the ranks among the question's matched items by
    (score, ordinal); unmatched candidates share the next rank.

    The scores are looked up for the candidates only; the ranks are counts of
    score ranges between the question's candidates, the extreme values come
    from one pass: nothing has a row per question and item."""
    c = cands.select("query_id", "item_id").distinct()
    out = c
    for name, terms in (("bm25", bm25), ("cosine", tfidf)):
        own = scorer.lookup(terms, c).checkpoint(eager=True)
        st = scorer.stats(terms).checkpoint(eager=True)
        before = scorer.before(terms, own)
        out = out.join(own.select("query_id", "item_id", F.col("score").alias(name)), ["query_id", "item_id"], "left") \
            .join(before, ["query_id", "item_id"], "left").join(st.select("query_id", "m"), "query_id", "left") \
            .withColumn(f"{name}_rank", (F.coalesce("n_before", "m", F.lit(0)) + 1).cast("int")).drop("n_before", "m")
        if name == "bm25":
            mm = minmax_of(st, n_items, True)
            out = out.join(mm, "query_id", "left").withColumn(
                "norm", F.coalesce((F.coalesce("bm25", F.lit(0.0)) - F.col("mn")) / F.col("rng"), F.lit(0.0))).drop("mn", "mx", "rng")
    return out.withColumn("cosine", F.coalesce("cosine", F.lit(0.0)))


def bm25_scorer(index: Bm25Index) -> Scorer:
    n, avgdl = _number(index.forward.sparkSession, index.n_docs, index.avgdl)
    return Scorer(index.forward, int(n), avgdl, index.k1, index.b, (True, False))


def tfidf_scorer(index: TfidfIndex, n_items: int) -> Scorer:
    return Scorer(index.forward, n_items, kinds=(False, True))


def row_scorer(bm25: Bm25Index, tfidf: TfidfIndex) -> Scorer:
    """Scorer of both kinds of tokens of every row as it stands."""
    n, avgdl = _number(bm25.forward.sparkSession, bm25.n_docs, bm25.avgdl)
    return Scorer(tfidf.forward.select("item_id", "ordinal", "dl", "ws", "wd", "norm"), int(n), avgdl, bm25.k1, bm25.b)


def hybrid_scorer(bm25: Bm25Index, tfidf: TfidfIndex) -> Scorer:
    """Scorer of both kinds of tokens at once.  Items are as a join by id
    pairs them: rows of a repeated id meet each other's, null ids none."""
    n, avgdl = _number(bm25.forward.sparkSession, bm25.n_docs, bm25.avgdl)
    cols = ["item_id", "ordinal", "dl", "ws", "wd", "norm"]
    rows = tfidf.forward.where(F.col("item_id").isNotNull())
    checkpoint_dir(rows.sparkSession)
    twice = rows.groupBy("item_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("item_id").checkpoint(eager=True)
    both = rows.select(*cols)
    if twice.limit(1).count():
        own = rows.join(twice, "item_id", "left_semi")
        pairs = own.select("item_id", "ordinal", "dl", "ws").join(own.select("item_id", "wd", "norm"), "item_id")
        both = both.join(twice, "item_id", "left_anti").unionByName(pairs).select(*cols)
    return Scorer(both, int(n), avgdl, bm25.k1, bm25.b)


def hybrid_top(scorer: Scorer, bm25: DataFrame, tfidf: DataFrame, stats: DataFrame, k: int, alpha: float = 0.5
               ) -> tuple[DataFrame, DataFrame]:
    """alpha * cosine + (1 - alpha) * minmax(bm25), best ``k`` per question.

    The fused score is a sum over the question's tokens of both kinds plus a
    constant of the question, the ``base`` score of an item matched by neither:
    one bounded search over both kinds of tokens finds the top, without the two
    score lists.  ``stats`` = (query_id, mn, mx, rng) of BM25."""
    w = F.col("w") * (1 - alpha) / F.coalesce("rng", F.lit(1.0))
    terms = bm25.join(stats.select("query_id", "rng"), "query_id", "left").select("query_id", "kind", "token", w.alias("w"), "df") \
        .unionByName(tfidf.withColumn("w", F.col("w") * alpha))
    base = stats.select("query_id", (F.lit(1 - alpha) * ((F.lit(0.0) - F.col("mn")) / F.col("rng"))).alias("base"))
    top = scorer.top(terms, k).join(base, "query_id", "left")
    return top.select("query_id", "item_id", "ordinal", (F.col("score") + F.coalesce("base", F.lit(0.0))).alias("score")), base


def minmax_stats(scores: DataFrame, n_items: Column, max_floor: bool = False) -> DataFrame:
    """Per query: min and max over *all* items (implicit zeros included when
    fewer than ``n_items`` items were matched) and the divisor, which is 1
    when max = min.  ``max_floor``: a max <= 0 becomes 1.0 first."""
    return minmax_of(scores.groupBy("query_id").agg(F.min("score").alias("mn"), F.max("score").alias("mx"),
                                                    F.count(F.lit(1)).alias("m")), n_items, max_floor)


def minmax_of(st: DataFrame, n_items: Column, max_floor: bool = False) -> DataFrame:
    """The same from (query_id, mn, mx, m) of the matched items."""
    some_zero = F.col("m") < n_items
    mn = F.when(some_zero, F.least(F.col("mn"), F.lit(0.0))).otherwise(F.col("mn"))
    mx = F.when(some_zero, F.greatest(F.col("mx"), F.lit(0.0))).otherwise(F.col("mx"))
    if max_floor:
        mx = F.when(mx > 0, mx).otherwise(F.lit(1.0))
    st = st.select("query_id", mn.alias("mn"), mx.alias("mx"))
    return st.withColumn("rng", F.when(F.col("mx") != F.col("mn"), F.col("mx") - F.col("mn"))
                         .otherwise(F.lit(1.0)))


def minmax_norm(scores: DataFrame, n_items: Column, max_floor: bool = False) -> DataFrame:
    """(query_id, item_id, score, norm) plus the per-query ``base`` value an
    unmatched item (raw score 0) normalises to."""
    st = broadcast_if_small(minmax_stats(scores, n_items, max_floor))  # a row per question: pairs stay where they are
    out = scores.join(st, "query_id")
    return out.select("query_id", "item_id", "score",
                      ((F.col("score") - F.col("mn")) / F.col("rng")).alias("norm"),
                      ((F.lit(0.0) - F.col("mn")) / F.col("rng")).alias("base"))


def hybrid_scores(bm25: DataFrame, cosine: DataFrame | None, n_items: Column, alpha: float = 0.5,
                  max_floor: bool = False) -> tuple[DataFrame, DataFrame]:
    """alpha * cosine + (1 - alpha) * minmax(bm25) for every matched pair.
    Without ``cosine`` the first frame holds both scores (``both_scores``).

    Returns (pairs, base): ``pairs`` = (query_id, item_id, bm25, cosine,
    score); ``base`` = (query_id, base_score) — the fused score of an item
    matched by neither side."""
    if cosine is None:
        pairs = bm25
        bm25 = bm25.where("bm25 IS NOT NULL").withColumnRenamed("bm25", "score")
    else:
        keys = ["query_id", "item_id"] + (["ordinal"] if "ordinal" in bm25.columns and "ordinal" in cosine.columns else [])
        pairs = (bm25.withColumnRenamed("score", "bm25")
                 .join(cosine.withColumnRenamed("score", "cosine"), keys, "full"))
    st = broadcast_if_small(minmax_stats(bm25, n_items, max_floor))
    pairs = pairs.join(st, "query_id", "left")
    # a query with no BM25 match at all: every raw score is 0, range 1
    mn = F.coalesce(F.col("mn"), F.lit(0.0))
    rng = F.coalesce(F.col("rng"), F.lit(1.0))
    b = F.coalesce(F.col("bm25"), F.lit(0.0))
    c = F.coalesce(F.col("cosine"), F.lit(0.0))
    score = F.lit(alpha) * c + F.lit(1 - alpha) * ((b - mn) / rng)
    extra = ["ordinal"] if "ordinal" in pairs.columns else []
    pairs = pairs.select("query_id", "item_id", *extra, b.alias("bm25"), c.alias("cosine"), score.alias("score"))
    base = st.select("query_id", (F.lit(1 - alpha) * ((F.lit(0.0) - F.col("mn")) / F.col("rng"))).alias("base"))
    return pairs, base


def first_free(groups: DataFrame, members: DataFrame, taken: DataFrame, k: int, keys: list[str]) -> DataFrame:
    """(query_id, *keys, item_id, ordinal): of each (question, group) the
    ``k`` lowest-ordinal members that ``taken`` (query_id, item_id) lacks.

    The first ``4 k`` members of each group are tried first; the few
    (question, group) rows that find fewer than ``k`` there, although the
    group has more members, look through the whole group."""
    checkpoint_dir(groups.sparkSession)
    width = 4 * k
    first = Window.partitionBy(*keys).orderBy("ordinal", "item_id")
    near = members.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= width).drop("_n")
    t = taken.select("query_id", "item_id")
    best = Window.partitionBy("query_id", *keys).orderBy("ordinal", "item_id")
    cols = ["query_id", *keys, "item_id", "ordinal"]

    def free(g: DataFrame, m: DataFrame) -> DataFrame:
        f = g.join(m, keys).join(t, ["query_id", "item_id"], "left_anti")
        return f.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= k).select(*cols)

    got = free(groups, near).checkpoint(eager=True)
    size = members.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size")).filter(F.col("_size") > width)
    short = (groups.join(size, keys).join(got.groupBy("query_id", *keys).agg(F.count(F.lit(1)).alias("_got")),
                                          ["query_id", *keys], "left")
             .filter(F.coalesce("_got", F.lit(0)) < k).select("query_id", *keys).checkpoint(eager=True))
    if short.limit(1).count():
        got = got.join(short, ["query_id", *keys], "left_anti").select(*cols).unionByName(free(short, members))
    return got


def topk_with_fill(pairs: DataFrame, queries: DataFrame, corpus: DataFrame, k: int,
                   base: DataFrame | None = None, score: str = "score",
                   keep: list[str] | None = None) -> DataFrame:
    """Exact top-k per query over *all* items, where the unmatched items
    share the per-query ``base`` score (0 when ``base`` is None).

    The matched pairs are cut to k per query first (partial
    WindowGroupLimit map-side).  Only questions with fewer than k matches,
    or whose k-th match does not score above the base, can have unmatched
    items in the answer: those get their k lowest-ordinal unmatched items
    as fillers, and all are ranked together.
    """
    keep = keep or []
    checkpoint_dir(pairs.sparkSession)
    # scores from the indexes already carry the ordinal; only foreign pair
    # tables need the lookup
    m = pairs if "ordinal" in pairs.columns else pairs.join(corpus.select("item_id", "ordinal"), "item_id")
    cols = ["query_id", "item_id", "ordinal", score] + keep
    m = topk(m, "query_id", score, "ordinal", k).select(*cols).checkpoint(eager=True)
    known = m.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"), F.min(rank_key(score)).alias("_least"))
    q = queries.select("query_id").distinct().join(known, "query_id", "left")
    if base is not None:
        q = q.join(base.select("query_id", F.col("base").alias("_base")), "query_id", "left")
    else:
        q = q.withColumn("_base", F.lit(0.0))
    q = q.withColumn("_base", F.coalesce("_base", F.lit(0.0)))
    open_ = (q.filter((F.coalesce("_n", F.lit(0)) < k) | (F.col("_least") <= rank_key("_base")))
             .select("query_id", "_base", F.lit(0).alias("_all")).checkpoint(eager=True))
    if not open_.limit(1).count():
        return topk(m, "query_id", score, "ordinal", k)
    members = corpus.select("item_id", "ordinal", F.lit(0).alias("_all"))
    fill = first_free(open_.select("query_id", "_all"), members, pairs.join(open_, "query_id", "left_semi"), k, ["_all"])
    fill = fill.join(open_.select("query_id", "_base"), "query_id").withColumn(score, F.col("_base"))
    for c in keep:
        if c not in fill.columns:
            fill = fill.withColumn(c, F.lit(0.0))
    return topk(m.unionByName(fill.select(*cols)), "query_id", score, "ordinal", k)


def bm25_search(index: Bm25Index, queries: DataFrame, corpus: DataFrame, k: int = 15,
                text_col: str = "question") -> DataFrame:
    """Top-k items per query by BM25: (query_id, item_id, score, rank)."""
    terms = bm25_terms(index, queries, text_col)
    s = bm25_scorer(index).top(terms, k) if nonnegative(terms) else bm25_scores(index, queries, text_col)
    out = topk_with_fill(s, queries, corpus, k)
    return out.select("query_id", "item_id", F.round("score", OUT_DIGITS).alias("score"), "rank")


def tfidf_search(index: TfidfIndex, queries: DataFrame, corpus: DataFrame, k: int = 15,
                 text_col: str = "question") -> DataFrame:
    """Top-k items per query by TF-IDF cosine: (query_id, item_id, score, rank)."""
    s = tfidf_scorer(index, corpus.count()).top(tfidf_terms(index, queries, text_col), k)
    out = topk_with_fill(s, queries, corpus, k)
    return out.select("query_id", "item_id", F.round("score", OUT_DIGITS).alias("score"), "rank")
