"""Retrieval pipelines composed from the operators: one lazy plan per
batch of questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import boost as bo
from ..operators import boosted as bd
from ..operators import expand as ex
from ..operators import index as ix
from ..operators import search as se
from ..operators.util import OUT_DIGITS, broadcast_if_small, scalar, stored, topk
from ..session import checkpoint_dir


class Indexes:
    """BM25 and TF-IDF indexes of one corpus, built once and shared.

    With ``materialize`` (the default) each index is written to the shared
    checkpoint folder when first used and its corpus statistics become
    literals, so every later plan scans the stored postings instead of
    re-tokenising the corpus, and a lost executor re-reads stored blocks
    instead of replaying the lineage.  This is the "build the index once
    at start-up" step of the service, done as a Spark job."""

    def __init__(self, corpus: DataFrame, materialize: bool = True):
        self.corpus = corpus
        self.materialize = materialize
        self._rows = None
        self._bm25 = None
        self._tfidf = None
        self._hybrid = None
        self._plain = None
        if materialize:
            checkpoint_dir(corpus.sparkSession)
            self.n_items = F.lit(corpus.count())
        else:
            self.n_items = scalar(corpus.agg(F.count(F.lit(1))))

    @property
    def rows(self) -> DataFrame:
        """Counted tokens of every item, tokenised once for both indexes."""
        if self._rows is None:
            self._rows = ix.token_rows(self.corpus)
        return self._rows

    @property
    def bm25(self) -> ix.Bm25Index:
        if self._bm25 is None:
            b = ix.bm25_index(self.corpus, rows=self.rows)
            if self.materialize:
                forward, vocab = b.forward, stored(b.vocab, "vocabulary")
                avgdl = forward.agg(F.avg("dl")).first()[0]
                b = ix.Bm25Index.of(forward, vocab, self.n_items.cast("double"), F.lit(float(avgdl or 0.0)), b.k1, b.b)
            self._bm25 = b
        return self._bm25

    @property
    def tfidf(self) -> ix.TfidfIndex:
        if self._tfidf is None:
            self._tfidf = ix.tfidf_index(self.corpus, rows=self.rows)
        return self._tfidf

    @property
    def hybrid(self) -> "se.Scorer":
        """Scorer of both kinds of tokens."""
        if self._hybrid is None:
            self._hybrid = se.hybrid_scorer(self.bm25, self.tfidf)
        return self._hybrid

    @property
    def plain(self) -> bool:
        """Whether every item is one row with an id and an ordinal."""
        if self._plain is None:
            odd = self.corpus.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.count("ordinal").alias("o")) \
                .where("item_id IS NULL OR n > 1 OR o < n")
            self._plain = not odd.limit(1).count()
        return self._plain

    @property
    def all_pairs(self) -> "se.Scorer":
        """Scorer of both kinds of tokens over every row, repeated ids and
        null ids too (``search.both_scores`` adds their rows up)."""
        return se.row_scorer(self.bm25, self.tfidf)


def stage(df: DataFrame) -> DataFrame:
    """Materialise one pipeline stage in the shared checkpoint folder.

    Long pipelines reuse intermediate tables (pair scores feed the pool,
    the ranks and the normalisation; boosts feed scoring and forcing).
    Storing a stage once keeps each downstream plan small and executes
    the stage once; a lost executor re-reads stored blocks."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def hybrid_pool(idx: Indexes, queries: DataFrame, k: int, alpha: float = 0.5,
                text_col: str = "question", mentions: DataFrame | None = None,
                forced_score: float = 2.0) -> DataFrame:
    """alpha x TF-IDF cosine + (1 - alpha) x min-max BM25 over the whole
    corpus; mentioned items forced to ``forced_score``; top k per query:
    (query_id, item_id, ordinal, score, rank)."""
    q = queries.select("query_id", F.col(text_col).alias("question"))
    bt = stage(se.bm25_terms(idx.bm25, q))
    if se.nonnegative(bt):
        st = stage(se.minmax_of(idx.hybrid.stats(bt), idx.n_items))
        pairs, base = se.hybrid_top(idx.hybrid, bt, se.tfidf_terms(idx.tfidf, q), st, k, alpha)
    else:
        pairs, base = se.hybrid_scores(se.bm25_scores(idx.bm25, q), se.tfidf_scores(idx.tfidf, q), idx.n_items, alpha)
    pairs = pairs.select("query_id", "item_id", "ordinal", "score")
    if mentions is not None:
        # mentions are few: attach their ordinal with the corpus streaming past them
        m = idx.corpus.select("item_id", "ordinal").join(broadcast_if_small(mentions), "item_id")
        pairs = bo.candidate_union(pairs, m, forced_score)
    return se.topk_with_fill(pairs, q, idx.corpus, k, base)


def pool_scores(idx: Indexes, queries: DataFrame, cands: DataFrame) -> DataFrame:
    """Scores and ranks of candidates (``search.candidate_scores``)."""
    return se.candidate_scores(idx.hybrid, se.bm25_terms(idx.bm25, queries), se.tfidf_terms(idx.tfidf, queries),
                               cands, idx.n_items)


def hybrid_search(idx: Indexes, queries: DataFrame, k: int = 20, alpha: float = 0.5) -> DataFrame:
    """Hybrid fusion on the offline-expanded question, top 20."""
    m = bo.mention_pairs(queries, idx.corpus, raw=False, clean=True, singular=True)
    xq = ex.expand_offline(queries, m, idx.corpus)
    out = hybrid_pool(idx, xq, k, alpha, text_col="expanded")
    return out.select("query_id", "item_id", F.round("score", OUT_DIGITS).alias("score"), "rank")


def retrieve_offline(idx: Indexes, queries: DataFrame, k: int = 5, pool: int = 55,
                     pins: list[bo.Rule] | None = None) -> DataFrame:
    """The offline pipeline: hybrid candidates on the raw question with
    mentioned items forced to 2.0 (top 55) -> lexical rerank (top k) ->
    metadata pins (mentions, then rule targets) at score + 1 -> top k.

    One row per (query, rank): item, name, score (4 d.p.), the query's
    confidence (mean of its scores) and a reason text."""
    corpus = idx.corpus
    mentions = stage(bo.mention_pairs(queries, corpus, raw=True, clean=True))
    cands = stage(hybrid_pool(idx, queries, pool, mentions=mentions))
    rr = bo.lexical_rerank(cands.select("query_id", "item_id", "score"), queries, corpus, k)
    forced = bo.rule_pins(queries, corpus, pins or [], mentions)
    final = bo.pin_to_front(rr, forced, corpus, k)
    final = final.withColumn("score", F.round("score", 4))
    w = Window.partitionBy("query_id")
    final = final.withColumn("confidence", F.round(F.avg("score").over(w), 4))
    m = mentions.withColumn("_mention", F.lit(True))
    out = (corpus.select("item_id", "name").join(broadcast_if_small(final), "item_id")
           .join(m, ["query_id", "item_id"], "left"))
    reason = F.when(F.col("_mention"), F.concat(F.lit("Question directly mentions '"), F.col("name"), F.lit("'"))) \
        .otherwise(F.concat(F.lit("Semantically relevant to the query (score="),
                            F.col("score").cast("string"), F.lit(")")))
    return out.select("query_id", "rank", "item_id", "name", "score", "confidence", reason.alias("reason"))


# --- fixed values: language cue rules for the document corpus -------------
# (prefix families, as the service's category boosts: +0.3 each)
LANGUAGE_RULES = [
    bo.Rule("lang_en", [" the ", " and ", " of "], "EN_", 0.3, match="prefix"),
    bo.Rule("lang_fr", [" le ", " la ", " les ", " des "], "FR_", 0.3, match="prefix"),
    bo.Rule("lang_de", [" der ", " die ", " und ", " nicht "], "DE_", 0.3, match="prefix"),
    bo.Rule("lang_es", [" el ", " los ", " las ", " del "], "ES_", 0.3, match="prefix"),
]
# --- end of fixed values ---------------------------------------------------


def boosted_pool(idx: Indexes, q: DataFrame, xq: DataFrame, mentions: DataFrame, item_keys: DataFrame,
                 rules: list[bo.Rule], pool: int) -> DataFrame:
    """(query_id, item_id, score): the top ``pool`` of every question after
    boosts and propagation, plus its forced items, scored in the tasks that
    hold the items (``operators.boosted``): no row per (question, item)."""
    # a question without an id is dropped by every later join
    q, xq, mentions = (df.where("query_id IS NOT NULL") for df in (q, xq, mentions))
    bt = stage(se.bm25_terms(idx.bm25, xq.select("query_id", F.col("expanded").alias("question"))))
    st = stage(se.minmax_of(idx.hybrid.stats(bt), idx.n_items, True))
    b = bd.Boosted(idx.hybrid, idx.corpus, item_keys, q, bt.unionByName(se.tfidf_terms(idx.tfidf, q)), st, mentions, rules)
    top, forced = b.pool(pool)
    return bo.force_include(stage(top), forced, forced)


def paired_pool(idx: Indexes, q: DataFrame, xq: DataFrame, mentions: DataFrame, item_keys: DataFrame,
                rules: list[bo.Rule], pool: int) -> DataFrame:
    """The same through rows per (question, item), whose joins tell what
    repeated and null item ids mean."""
    corpus = idx.corpus
    # rows per (question, item): as Parquet, a fraction of a checkpoint's bytes
    bm = stored(se.bm25_scores(idx.bm25, xq.select("query_id", F.col("expanded").alias("question"))), "bm25-pairs")
    cs = stored(se.tfidf_scores(idx.tfidf, q), "cosine-pairs")
    pairs, base = se.hybrid_scores(bm, cs, idx.n_items, 0.5, max_floor=True)
    nb = bo.name_boost(q, corpus, mentions)
    tb = stage(bo.rule_target_boosts(q, rules))
    scored = pairs.select("query_id", "item_id").unionByName(nb.select("query_id", "item_id"))
    rb = stored(bo.apply_rule_boosts(scored, corpus, tb, rules, fill_k=pool), "rule-boosts")
    adds = nb.select("query_id", "item_id", F.col("name_boost").alias("b")) \
        .unionByName(rb.select("query_id", "item_id", F.col("boost").alias("b"))) \
        .groupBy("query_id", "item_id").agg(F.sum("b").alias("b"))
    s = pairs.select("query_id", "item_id", "ordinal", "score").join(adds, ["query_id", "item_id"], "full") \
        .join(base, "query_id", "left")
    s = s.select("query_id", "item_id", "ordinal",
                 (F.coalesce("score", "base", F.lit(0.0)) + F.coalesce("b", F.lit(0.0))).alias("score"))
    # only boost-only rows (bounded: k per fired target) lack an ordinal;
    # look those up with the corpus streaming past them
    known = s.filter(F.col("ordinal").isNotNull())
    boosted = s.filter(F.col("ordinal").isNull()).drop("ordinal")
    s = known.unionByName(corpus.select("item_id", "ordinal").join(broadcast_if_small(boosted), "item_id")
                          .select("query_id", "item_id", "ordinal", "score"))
    s = stored(s, "scores")
    s = stored(bo.graph_propagate(s, item_keys).select("query_id", "item_id", "ordinal", "score")
               .unionByName(bo.propagated_fill(s, item_keys, base, pool)), "lifted")
    top = se.topk_with_fill(s, q, corpus, pool, base).select("query_id", "item_id", "score")
    return bo.force_include(top, s, rb.filter(F.col("boost") >= 0.8))


def retrieve_full(idx: Indexes, queries: DataFrame, item_keys: DataFrame, k: int = 5, pool: int = 25,
                  rules: list | None = None, model=None, ranker=None,
                  structure: DataFrame | None = None) -> DataFrame:
    """The full pipeline.  Without a learned ranker: BM25 on the expanded
    question fused with the cosine score, plus name and rule boosts ->
    one hop of propagation through shared join keys -> top ``pool`` plus
    items whose rule boost is at least 0.8 -> pair logits -> heuristic
    fusion (score + 1.5 x sigmoid(logit)) -> top k with calibrated scores
    (sigmoid((logit + 2.5) / 1.2), 4 d.p.), the first score as confidence
    and a reason.  Unmatched items take the per-query base score; boosts
    and propagation apply to scored pairs and boosted / lifted items;
    rule boosts stay per (question, target) and reach unscored items through
    the lowest-ordinal unscored members of each class of rule targets, so a
    rule family covering a third of the corpus never becomes question x
    family rows.  Forced items are those with a rule boost >= 0.8; only
    exact rules may reach it (``check_rules``).  Pools are scored in the tasks
    that hold the items (``boosted_pool``); only a corpus that repeats item ids
    or lacks some goes through rows per (question, item) (``paired_pool``).

    ``ranker`` = (kind, function) takes the place of the fusion: the
    function turns the candidates' 28 features (query_id, item_id, features;
    ``structure`` as for ``add_structure_features``) into rows with a
    ``score``, by which the top k are taken; ``model_used`` is then
    ``learned_<kind>``.  The features are those the ranker was trained on."""
    from ..functions.scalars import calibrated_score
    rules = LANGUAGE_RULES if rules is None else rules
    bo.check_rules(rules)
    corpus = idx.corpus
    q = queries.select("query_id", "question")
    mentions = stage(bo.mention_pairs(q, corpus))
    xq = stage(ex.expand_full(q, mentions, corpus))
    pooled = boosted_pool if idx.plain else paired_pool
    cands = stage(pooled(idx, q, xq, mentions, item_keys, rules, pool))
    logits = bo.pair_scorer(cands, q, corpus, model)
    fused = bo.heuristic_fusion(cands.join(logits, ["query_id", "item_id"]))
    if ranker is not None:
        from ..operators.features import features_28
        feats = features_28(cands, q, corpus, stage(pool_scores(idx, q, cands)), expanded=xq, item_keys=structure)
        learned = ranker[1](feats).select("query_id", "item_id", F.col("score").alias("fused"))
        fused = fused.drop("fused").join(learned, ["query_id", "item_id"])
    best = topk(corpus.select("item_id", "ordinal").join(broadcast_if_small(fused), "item_id"),
                "query_id", "fused", "ordinal", k)
    best = best.withColumn("calibrated", calibrated_score(F.col("logit")))
    w = Window.partitionBy("query_id").orderBy("rank")
    best = best.withColumn("confidence", F.first("calibrated").over(w.rowsBetween(Window.unboundedPreceding,
                                                                                  Window.unboundedFollowing)))
    m = mentions.withColumn("_m", F.lit(True))
    out = corpus.select("item_id", "name").join(broadcast_if_small(best), "item_id") \
        .join(m, ["query_id", "item_id"], "left")
    reason = F.when(F.col("_m"), F.concat(F.lit("Question directly mentions table '"), F.col("name"), F.lit("'"))) \
        .otherwise(F.concat(F.lit("Semantically mapped table based on query intent (score="),
                            F.col("calibrated").cast("string"), F.lit(")")))
    return out.select("query_id", "rank", "item_id", "name", F.round("fused", 6).alias("rank_score"),
                      F.col("calibrated").alias("score"), "confidence", reason.alias("reason"),
                      F.lit(f"learned_{ranker[0]}" if ranker is not None else "heuristic").alias("model_used"))
