"""The 28 ranking features of a (question, item) candidate pair.

Features are computed for candidate pools only (top-k per question), so
per-item work such as word and trigram sets of long documents runs once
per candidate row, never per corpus x question pair.

Rulings (documented differences from the reference):
* ``tfidf_cosine`` is the real TF-IDF cosine; ``biencoder_cosine`` is the
  dense score when the caller supplies one, else the TF-IDF cosine.
* ``bm25_rank`` / ``cosine_rank``: matched items rank by (score desc,
  ordinal); items the scorer did not match share the next rank.
* ``cross_encoder_logit`` is the pair scorer's output (model-free default:
  4 x lexical bonus - 2, see ``pair_logit``).
* Catalog-structure features (11-15) come from an optional item-keys
  table; a corpus without one gets zeros.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import sigmoid
from ..functions.text import (AGGREGATION_KEYWORDS, JOIN_KEYWORDS, SUBQUERY_KEYWORDS,
                              keyword_hits, tok_word, trigram_count, trigram_jaccard,
                              with_trigrams, ws_set)
from .expand import ABBREVIATIONS
from .util import broadcast_if_small

FEATURE_NAMES = [
    "bm25_score", "tfidf_cosine", "jaccard_word", "jaccard_char_3gram",
    "exact_table_name_match", "partial_table_name_match", "query_table_token_overlap",
    "biencoder_cosine", "cross_encoder_logit", "cross_encoder_calibrated",
    "num_columns", "num_fk_relations", "schema_graph_degree",
    "has_join_key_overlap_with_candidates", "num_shared_join_keys_with_candidates",
    "query_length_words", "query_length_chars", "has_aggregation_keyword", "has_join_keyword",
    "has_subquery_indicator", "num_sql_keywords_detected",
    "bm25_x_cosine", "bm25_rank", "cosine_rank", "rank_difference", "score_ratio",
    "llm_expansion_overlap", "category_prefix_match",
]


def pair_logit(question_lower: Column, name: Column, q_ws: Column, d_ws: Column) -> Column:
    """Model-free pair score: 4 x (0.2 if the name is mentioned + 0.01 x
    min(5, shared whitespace words)) - 2."""
    hit = F.instr(question_lower, F.regexp_replace(F.lower(name), "_", " ")) > 0
    bonus = F.when(hit, 0.2).otherwise(0.0) + F.least(F.size(F.array_intersect(q_ws, d_ws)), F.lit(5)) * 0.01
    return bonus * 4.0 - 2.0


def _prefix_meaning_words() -> Column:
    keys, vals = [], []
    for ab, meaning in ABBREVIATIONS.items():
        keys.append(F.lit(ab))
        vals.append(F.array(*[F.lit(w) for w in sorted(set(meaning.replace(",", "").lower().split()))]))
    return F.map_from_arrays(F.array(*keys), F.array(*vals))


def features_28(cands: DataFrame, queries: DataFrame, corpus: DataFrame, scores: DataFrame,
                expanded: DataFrame | None = None, dense: DataFrame | None = None,
                item_keys: DataFrame | None = None) -> DataFrame:
    """One row per candidate: (query_id, item_id, f1..f28 by name).

    ``cands`` = (query_id, item_id); ``scores`` = the candidates' scores and
    ranks (``search.candidate_scores``); ``expanded`` = (query_id, expanded)
    text."""
    q = queries.select("query_id", "question")
    c = cands.select("query_id", "item_id").distinct()
    d = corpus.select("item_id", "ordinal", "name", "text")
    # candidate pools are bounded (questions x k): broadcast them (checked)
    # and stream the corpus past them instead of shuffling its text
    j = d.join(broadcast_if_small(c.join(q, "query_id")), "item_id")
    # sparse scores and ranks
    j = j.join(scores.select("query_id", "item_id", F.col("norm").alias("_bn"), F.col("cosine").alias("_tf"),
                             F.col("bm25_rank").alias("_br"), F.col("cosine_rank").alias("_cr")), ["query_id", "item_id"])
    if dense is not None:
        j = j.join(dense.select("query_id", "item_id", F.col("score").alias("_de")), ["query_id", "item_id"], "left")
    if expanded is not None:
        j = j.join(expanded.select("query_id", "expanded"), "query_id", "left")
    # question trigram set (short) in the JVM; the document side only
    # needs its distinct-trigram count and its lower-cased text
    j = with_trigrams(j, "question", "_qg").withColumn("_dl", F.lower("text")) \
        .withColumn("_dgn", trigram_count(F.col("text")))
    j = j.withColumn("_ql", F.lower("question"))
    ql = F.col("_ql")
    nl = F.lower("name")
    qw = tok_word("question")
    dw = tok_word("text")
    name_toks = F.array_distinct(F.array_remove(F.split(F.regexp_replace(nl, "_", " "), " "), ""))
    parts = F.split(nl, "_")
    f = {}
    f["bm25_score"] = F.col("_bn")
    f["tfidf_cosine"] = F.col("_tf")
    f["jaccard_word"] = _jac(qw, dw)
    f["jaccard_char_3gram"] = trigram_jaccard("_ql", "_qg", "_dl", F.col("_dgn"))
    f["exact_table_name_match"] = ((F.instr(ql, nl) > 0) | (F.instr(ql, F.regexp_replace(nl, "_", " ")) > 0)).cast("double")
    f["partial_table_name_match"] = F.exists(parts, lambda p: (F.length(p) > 3) & (F.instr(ql, p) > 0)).cast("double")
    f["query_table_token_overlap"] = F.size(F.array_intersect(qw, name_toks)).cast("double")
    f["biencoder_cosine"] = F.coalesce("_de", "_tf") if dense is not None else F.col("_tf")
    f["cross_encoder_logit"] = pair_logit(ql, F.col("name"), ws_set("question"), ws_set("text"))
    f["cross_encoder_calibrated"] = sigmoid(f["cross_encoder_logit"])
    for k in ("num_columns", "num_fk_relations", "schema_graph_degree",
              "has_join_key_overlap_with_candidates", "num_shared_join_keys_with_candidates"):
        f[k] = F.lit(0.0)
    f["query_length_words"] = F.size(qw).cast("double")
    f["query_length_chars"] = F.length("question").cast("double")
    ka = keyword_hits(ql, AGGREGATION_KEYWORDS)
    kj = keyword_hits(ql, JOIN_KEYWORDS)
    ks = keyword_hits(ql, SUBQUERY_KEYWORDS)
    f["has_aggregation_keyword"] = (ka > 0).cast("double")
    f["has_join_keyword"] = (kj > 0).cast("double")
    f["has_subquery_indicator"] = (ks > 0).cast("double")
    f["num_sql_keywords_detected"] = (ka + kj + ks).cast("double")
    f["bm25_x_cosine"] = f["bm25_score"] * f["biencoder_cosine"]
    f["bm25_rank"] = F.col("_br").cast("double")
    f["cosine_rank"] = F.col("_cr").cast("double")
    f["rank_difference"] = F.abs(f["bm25_rank"] - f["cosine_rank"])
    f["score_ratio"] = F.when(f["biencoder_cosine"] > 1e-6, f["bm25_score"] / f["biencoder_cosine"]) \
        .otherwise(f["bm25_score"] * 100.0)
    if expanded is not None:
        ex_t = ws_set("expanded")
        f["llm_expansion_overlap"] = F.when(F.length(F.coalesce("expanded", F.lit(""))) > 0, F.size(
            F.array_intersect(ex_t, F.array_union(dw, name_toks)))).otherwise(0).cast("double")
    else:
        f["llm_expansion_overlap"] = F.lit(0.0)
    prefix = F.split(F.upper("name"), "_").getItem(0)
    meaning = F.try_element_at(_prefix_meaning_words(), prefix)
    f["category_prefix_match"] = F.when(meaning.isNotNull() & F.arrays_overlap(qw, meaning), 1.0).otherwise(0.0)
    out = j.select("query_id", "item_id", *[f[n].cast("double").alias(n) for n in FEATURE_NAMES])
    if item_keys is not None:
        out = add_structure_features(out, item_keys)
    return out


def _jac(a: Column, b: Column) -> Column:
    inter = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - inter
    return F.when(union == 0, F.lit(0.0)).otherwise(inter / union)


def add_structure_features(feats: DataFrame, item_keys: DataFrame) -> DataFrame:
    """Fill features 11-15 from (item_id, key, n_columns, out_degree, degree)
    rows (key null for an item without any): column count, relations, graph
    degree (tables its keys link, key by key), and how many other
    candidates of the same question share a join key with the item
    (candidate pools are bounded, so the per-question pairs are too)."""
    meta = item_keys.groupBy("item_id").agg(F.first("n_columns").alias("_nc"), F.first("out_degree").alias("_od"),
                                            F.first("degree").alias("_dg"))
    keys = item_keys.filter(F.col("key").isNotNull()).select("item_id", "key").distinct()
    ck = feats.select("query_id", "item_id").join(keys, "item_id")
    pairs = (ck.alias("a").join(ck.alias("b"), ["query_id", "key"])
             .filter(F.col("a.item_id") != F.col("b.item_id"))
             .select("query_id", F.col("a.item_id").alias("item_id"), F.col("b.item_id").alias("other"))
             .distinct().groupBy("query_id", "item_id").agg(F.count(F.lit(1)).alias("_sh")))
    out = feats.join(meta, "item_id", "left").join(pairs, ["query_id", "item_id"], "left")
    z = F.lit(0.0)
    out = (out.withColumn("num_columns", F.coalesce(F.col("_nc").cast("double"), z))
           .withColumn("num_fk_relations", F.coalesce(F.col("_od").cast("double"), z))
           .withColumn("schema_graph_degree", F.coalesce(F.col("_dg").cast("double"), z))
           .withColumn("has_join_key_overlap_with_candidates", (F.coalesce(F.col("_sh"), F.lit(0)) > 0).cast("double"))
           .withColumn("num_shared_join_keys_with_candidates", F.coalesce(F.col("_sh").cast("double"), z)))
    return out.select("query_id", "item_id", *FEATURE_NAMES)
