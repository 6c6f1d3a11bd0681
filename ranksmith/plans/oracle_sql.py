"""Independent DuckDB formulations of the registered queries.

Written from the operator definitions, not from the Spark code: they
score the full query x corpus product by brute force wherever the Spark
plan is sparse, so they check the sparse tricks as well.
"""

from __future__ import annotations

from ..functions.text import WORD2_RE, WORD_RE, WS_RE
from ..operators.index import default_stop_words

K1, B, EPS = 1.5, 0.75, 0.25


def ws_tokens(x: str) -> str:
    return f"list_filter(string_split_regex(lower({x}), '{WS_RE}'), lambda t: t <> '')"


def word2_tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '{WORD2_RE}')"


def word_set(x: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({x}), '{WORD_RE}'))"


def stop_list_sql() -> str:
    words = ", ".join("'" + w.replace("'", "''") + "'" for w in default_stop_words())
    return f"[{words}]"


def corpus_cte() -> str:
    return ("docs AS (SELECT doc_id AS item_id, doc_id AS ordinal, "
            "upper(concat_ws('_', lang, source, CAST(doc_id AS VARCHAR))) AS name, "
            "coalesce(text, '') AS text FROM documents)")


def questions_cte() -> str:
    return "q AS (SELECT item_id AS query_id, coalesce(text, '') AS question FROM benchmark)"


def bm25_ctes() -> str:
    """BM25 pair scores ``bm`` (query_id, item_id, score) for q x docs."""
    return f""",
dtok AS (SELECT item_id, {ws_tokens('text')} AS toks FROM docs),
dlen AS (SELECT item_id, len(toks) AS dl FROM dtok),
post AS (SELECT item_id, token, count(*) AS tf FROM (SELECT item_id, unnest(toks) AS token FROM dtok) GROUP BY ALL),
nd AS (SELECT count(*)::DOUBLE AS n FROM docs),
avgdl AS (SELECT avg(dl) AS a FROM dlen),
voc0 AS (SELECT token, count(*) AS df FROM post GROUP BY token),
voc1 AS (SELECT token, df, ln((SELECT n FROM nd) - df + 0.5) - ln(df + 0.5) AS idf_raw FROM voc0),
voc AS (SELECT token, CASE WHEN idf_raw < 0 THEN {EPS} * (SELECT avg(idf_raw) FROM voc1) ELSE idf_raw END AS idf FROM voc1),
qtok AS (SELECT query_id, unnest({ws_tokens('question')}) AS token FROM q),
bm AS (SELECT qtok.query_id, p.item_id,
          sum(v.idf * (p.tf * {K1 + 1}) / (p.tf + {K1} * (1 - {B} + {B} * dlen.dl / (SELECT a FROM avgdl)))) AS score
       FROM qtok JOIN voc v USING (token) JOIN post p USING (token) JOIN dlen USING (item_id)
       GROUP BY ALL)"""


def tfidf_ctes() -> str:
    """TF-IDF cosine pair scores ``cs`` (query_id, item_id, score)."""
    return f""",
stopw AS (SELECT unnest({stop_list_sql()}) AS token),
tpost AS (SELECT item_id, token, count(*) AS tf FROM
           (SELECT item_id, unnest({word2_tokens('text')}) AS token FROM docs)
         WHERE token NOT IN (SELECT token FROM stopw) GROUP BY ALL),
tnd AS (SELECT count(*)::DOUBLE AS n FROM docs),
tvoc AS (SELECT token, ln(((SELECT n FROM tnd) + 1.0) / (count(*) + 1.0)) + 1.0 AS idf FROM tpost GROUP BY token),
tdw AS (SELECT item_id, token, tf * idf AS w FROM tpost JOIN tvoc USING (token)),
tdn AS (SELECT item_id, sqrt(sum(w * w)) AS nrm FROM tdw GROUP BY item_id),
tqp AS (SELECT query_id, token, count(*) AS tf FROM
           (SELECT query_id, unnest({word2_tokens('question')}) AS token FROM q)
         WHERE token NOT IN (SELECT token FROM stopw) GROUP BY ALL),
tqw AS (SELECT query_id, token, tf * idf AS w FROM tqp JOIN tvoc USING (token)),
tqn AS (SELECT query_id, sqrt(sum(w * w)) AS nrm FROM tqw GROUP BY query_id),
cs AS (SELECT a.query_id, d.item_id, sum(a.w / qn.nrm * d.w / dn.nrm) AS score
       FROM tqw a JOIN tqn qn USING (query_id) JOIN tdw d USING (token) JOIN tdn dn ON dn.item_id = d.item_id
       GROUP BY ALL)"""


def all_pairs(score_cte: str, alias: str = "score") -> str:
    return (f"SELECT q.query_id, d.item_id, d.ordinal, coalesce(s.score, 0.0) AS {alias} "
            f"FROM q CROSS JOIN docs d LEFT JOIN {score_cte} s "
            f"ON s.query_id = q.query_id AND s.item_id = d.item_id")


def topk_sql(inner: str, k: int, score: str = "score", extra: str = "") -> str:
    return (f"SELECT query_id, item_id, round({score}, 6) AS {score}{extra}, rank FROM ("
            f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round({score}, 9) DESC, ordinal) AS rank "
            f"FROM ({inner})) WHERE rank <= {k}")


def bm25_search_sql(k: int = 15) -> str:
    return f"WITH {corpus_cte()}, {questions_cte()}{bm25_ctes()}\n" + topk_sql(all_pairs("bm"), k)


def tfidf_search_sql(k: int = 15) -> str:
    return f"WITH {corpus_cte()}, {questions_cte()}{tfidf_ctes()}\n" + topk_sql(all_pairs("cs"), k)


def mention_sql(qexpr: str = "q.question", name: str = "d.name") -> str:
    return (f"(contains(lower({qexpr}), lower({name})) OR "
            f"contains(lower({qexpr}), replace(lower({name}), '_', ' ')))")


def hybrid_ctes(alpha: float = 0.5, forced: bool = True) -> str:
    """``hyb`` (query_id, item_id, ordinal, name, text, question, score)
    over q x docs; requires the bm25 and tfidf CTEs."""
    force = f"WHEN {mention_sql()} THEN 2.0 " if forced else "WHEN false THEN 0.0 "
    return f""",
ball AS ({all_pairs('bm')}),
bst AS (SELECT query_id, min(score) AS mn, max(score) AS mx FROM ball GROUP BY query_id),
hyb AS (SELECT q.query_id, d.item_id, d.ordinal, d.name, d.text, q.question,
          CASE {force}ELSE {alpha} * coalesce(cs.score, 0.0) + {1 - alpha} *
            ((coalesce(bm.score, 0.0) - bst.mn) / CASE WHEN bst.mx <> bst.mn THEN bst.mx - bst.mn ELSE 1.0 END) END AS score
        FROM q CROSS JOIN docs d
        LEFT JOIN bm ON bm.query_id = q.query_id AND bm.item_id = d.item_id
        LEFT JOIN cs ON cs.query_id = q.query_id AND cs.item_id = d.item_id
        JOIN bst ON bst.query_id = q.query_id)"""


def ranked_cte(name: str, src: str, k: int) -> str:
    return (f", {name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id "
            f"ORDER BY round(score, 9) DESC, ordinal) AS rk FROM {src}) WHERE rk <= {k})")


def retrieve_offline_sql(k: int = 5, pool: int = 55) -> str:
    ws_q = f"list_distinct({ws_tokens('question')})"
    ws_d = f"list_distinct({ws_tokens('text')})"
    return f"""WITH {corpus_cte()}, {questions_cte()}{bm25_ctes()}{tfidf_ctes()}{hybrid_ctes()}
{ranked_cte('pool', 'hyb', pool)},
rr0 AS (SELECT query_id, item_id, ordinal, score
          + CASE WHEN contains(lower(question), replace(lower(name), '_', ' ')) THEN 0.2 ELSE 0.0 END
          + least(len(list_intersect({ws_q}, {ws_d})), 5) * 0.01 AS score FROM pool)
{ranked_cte('top', 'rr0', k)},
forced AS (SELECT q.query_id, d.item_id, row_number() OVER (PARTITION BY q.query_id ORDER BY d.ordinal) AS fpos
           FROM q CROSS JOIN docs d WHERE {mention_sql()}),
fin AS (SELECT coalesce(t.query_id, f.query_id) AS query_id, coalesce(t.item_id, f.item_id) AS item_id,
          CASE WHEN f.fpos IS NOT NULL THEN coalesce(t.score, 1.0) + 1.0 ELSE t.score END AS score,
          CASE WHEN f.fpos IS NOT NULL THEN f.fpos ELSE 1000000000 + t.rk END AS key
        FROM top t FULL JOIN forced f ON t.query_id = f.query_id AND t.item_id = f.item_id),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY key, item_id) AS rank FROM fin),
r5 AS (SELECT query_id, item_id, rank, round(score, 4) AS score FROM rk WHERE rank <= {k})
SELECT r5.query_id, r5.rank, r5.item_id, d.name, r5.score,
       round(avg(r5.score) OVER (PARTITION BY r5.query_id), 4) AS confidence,
       CASE WHEN {mention_sql()} THEN 'Question directly mentions ''' || d.name || ''''
            ELSE 'Semantically relevant to the query (score=' || CAST(r5.score AS VARCHAR) || ')' END AS reason
FROM r5 JOIN docs d ON d.item_id = r5.item_id JOIN q ON q.query_id = r5.query_id"""


def gold_cte() -> str:
    return (", gold AS (SELECT DISTINCT b.item_id AS query_id, d.doc_id AS item_id FROM benchmark b "
            "JOIN documents d ON contains(d.text, b.text) WHERE length(b.text) > 0)")


def containment_gold_sql() -> str:
    return ("SELECT DISTINCT b.item_id, d.doc_id FROM benchmark b JOIN documents d "
            "ON contains(d.text, b.text) WHERE length(b.text) > 0")


def bm25_top_cte(k: int) -> str:
    return f"{bm25_ctes()}, ballp AS ({all_pairs('bm')}){ranked_cte('bt', 'ballp', k)}"


def recall_at_k_sql() -> str:
    return f"""WITH {corpus_cte()}, {questions_cte()}{bm25_top_cte(10)}{gold_cte()},
j AS (SELECT g.query_id, g.item_id, bt.rk FROM gold g LEFT JOIN bt ON bt.query_id = g.query_id AND bt.item_id = g.item_id),
pq AS (SELECT query_id, count(*) AS n, sum(CASE WHEN rk <= 5 THEN 1 ELSE 0 END) AS h5,
              sum(CASE WHEN rk <= 10 THEN 1 ELSE 0 END) AS h10 FROM j GROUP BY query_id)
SELECT 5 AS k, avg(h5 / n) AS recall, count(*) AS n_queries FROM pq
UNION ALL SELECT 10 AS k, avg(h10 / n) AS recall, count(*) AS n_queries FROM pq"""


def per_query_report_sql(k: int = 5) -> str:
    return f"""WITH {corpus_cte()}, {questions_cte()}{bm25_top_cte(k)}{gold_cte()},
g AS (SELECT query_id, list_sort(list(item_id)) AS gold_items FROM gold GROUP BY query_id),
r AS (SELECT query_id, list_sort(list(item_id)) AS retrieved_items FROM bt GROUP BY query_id),
j AS (SELECT g.query_id, g.gold_items, coalesce(r.retrieved_items, []::BIGINT[]) AS retrieved_items FROM g LEFT JOIN r USING (query_id))
SELECT query_id, gold_items, retrieved_items, list_sort(list_intersect(gold_items, retrieved_items)) AS matched,
       len(list_intersect(gold_items, retrieved_items)) / len(gold_items) AS recall FROM j"""


def worst_queries_sql(k: int = 5, n: int = 10) -> str:
    return (f"SELECT query_id, recall FROM ({per_query_report_sql(k)}) ORDER BY recall, query_id LIMIT {n}")


def pool_cte(pool: int = 25) -> str:
    return (f"{bm25_ctes()}{tfidf_ctes()}{hybrid_ctes(forced=False)}{ranked_cte('pl', 'hyb', pool)}{gold_cte()}, "
            "lab AS (SELECT pl.query_id AS group_id, pl.item_id, pl.score, "
            "CASE WHEN g.item_id IS NULL THEN 0 ELSE 1 END AS label FROM pl LEFT JOIN gold g "
            "ON g.query_id = pl.query_id AND g.item_id = pl.item_id)")


def pool_metrics_sql(pool: int = 25) -> str:
    return f"""WITH {corpus_cte()}, {questions_cte()}{pool_cte(pool)},
r AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY round(score, 9) DESC, item_id) AS pos FROM lab),
per AS (SELECT group_id, sum(label) AS npos,
          sum(CASE WHEN pos <= 5 THEN label ELSE 0 END) AS h5, sum(CASE WHEN pos <= 10 THEN label ELSE 0 END) AS h10,
          sum(CASE WHEN pos <= 5 THEN (pow(2, label) - 1) / log2(pos + 1) ELSE 0 END) AS d5,
          sum(CASE WHEN pos <= 10 THEN (pow(2, label) - 1) / log2(pos + 1) ELSE 0 END) AS d10
        FROM r GROUP BY group_id HAVING sum(label) > 0),
idl AS (SELECT group_id, h5, h10, d5, d10, npos,
          (SELECT sum(1 / log2(i + 1)) FROM range(1, least(npos::BIGINT, 5) + 1) t(i)) AS i5,
          (SELECT sum(1 / log2(i + 1)) FROM range(1, least(npos::BIGINT, 10) + 1) t(i)) AS i10 FROM per)
SELECT avg(h5 / npos) AS recall_at_5, avg(CASE WHEN i5 > 0 THEN d5 / i5 ELSE 0 END) AS ndcg_at_5,
       avg(h10 / npos) AS recall_at_10, avg(CASE WHEN i10 > 0 THEN d10 / i10 ELSE 0 END) AS ndcg_at_10,
       count(*) AS n_groups FROM idl"""


def binary_metrics_sql(pool: int = 25) -> str:
    return f"""WITH {corpus_cte()}, {questions_cte()}{pool_cte(pool)},
c AS (SELECT count(*) AS n, sum(CASE WHEN score >= 0.5 AND label = 1 THEN 1 ELSE 0 END) AS tp,
        sum(CASE WHEN score >= 0.5 AND label = 0 THEN 1 ELSE 0 END) AS fp,
        sum(CASE WHEN score < 0.5 AND label = 1 THEN 1 ELSE 0 END) AS fn,
        sum(CASE WHEN (score >= 0.5) = (label = 1) THEN 1 ELSE 0 END) AS ok FROM lab),
m AS (SELECT n, ok, coalesce(tp / nullif(tp + fp, 0), 0.0) AS p, coalesce(tp / nullif(tp + fn, 0), 0.0) AS r FROM c)
SELECT coalesce(ok / nullif(n, 0), 0.0) AS accuracy, p AS precision, r AS recall,
       CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f1 FROM m"""


def auc_roc_sql(pool: int = 25) -> str:
    return f"""WITH {corpus_cte()}, {questions_cte()}{pool_cte(pool)},
pos AS (SELECT score FROM lab WHERE label = 1), neg AS (SELECT score FROM lab WHERE label <> 1),
u AS (SELECT sum(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0.0 END) AS u
      FROM pos p CROSS JOIN neg n)
SELECT CASE WHEN (SELECT count(*) FROM pos) > 0 AND (SELECT count(*) FROM neg) > 0
            THEN (SELECT u FROM u) / ((SELECT count(*) FROM pos) * (SELECT count(*) FROM neg)) ELSE 0.0 END AS auc_roc"""


def _lit_list(words) -> str:
    if not words:
        return "[]::VARCHAR[]"
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def clean_plural_sql(x: str) -> str:
    toks = (f"list_filter(list_transform({ws_tokens(x)}, lambda t: "
            r"regexp_replace(t, '^[\?,\.\(\)_]+|[\?,\.\(\)_]+$', '', 'g')), lambda t: t <> '')")
    singles = (f"list_transform(list_filter({toks}, lambda t: length(t) > 4 AND suffix(t, 's')), "
               "lambda t: substring(t, 1, length(t) - 1))")
    return f"list_distinct(list_concat({toks}, {singles}))"


def expansion_extras_sql(q: str) -> str:
    """SQL phrase words + abbreviation words of the full expansion."""
    from ..operators.expand import ABBREVIATIONS, SQL_PHRASES
    parts = [f"CASE WHEN contains(lower({q}), '{p}') THEN {_lit_list(ws)} ELSE []::VARCHAR[] END"
             for p, ws in SQL_PHRASES.items()] + _abbrev_parts(q, ABBREVIATIONS)
    return "list_distinct(flatten([" + ", ".join(parts) + "]))"


def abbrev_extras_sql(q: str, abbreviations: dict[str, str]) -> str:
    """The words that abbreviations add to a question."""
    return "list_distinct(flatten([" + ", ".join(_abbrev_parts(q, abbreviations)) + "]))"


def _abbrev_parts(q: str, abbreviations: dict[str, str]) -> list[str]:
    from ..operators.expand import EXPANSION_STOP_WORDS, GENERIC_TRIGGER_WORDS
    parts = []
    qw = clean_plural_sql(q)
    qtrig = (f"list_filter({qw}, lambda w: NOT list_contains({_lit_list(EXPANSION_STOP_WORDS)}, w) "
             f"AND NOT list_contains({_lit_list(GENERIC_TRIGGER_WORDS)}, w))")
    for ab, meaning in abbreviations.items():
        words = sorted({w for w in meaning.replace(",", "").replace(".", "").lower().split()
                        if w not in EXPANSION_STOP_WORDS and len(w) > 3})
        trig = [w for w in words if w not in GENERIC_TRIGGER_WORDS]
        cond = f"list_contains({qw}, '{ab.lower()}')"
        if trig:
            cond += f" OR len(list_intersect({qtrig}, {_lit_list(trig)})) > 0"
        parts.append(f"CASE WHEN {cond} THEN {_lit_list([ab] + [w.upper() for w in words])} ELSE []::VARCHAR[] END")
    return parts


def features_28_sql(pool: int = 25) -> str:
    from ..functions.text import AGGREGATION_KEYWORDS, JOIN_KEYWORDS, SUBQUERY_KEYWORDS
    from ..operators.expand import ABBREVIATIONS

    def hits(x, kws):
        return "(" + " + ".join(f"(CASE WHEN contains({x}, '{k}') THEN 1 ELSE 0 END)" for k in kws) + ")"

    def jac(a, b):
        return (f"(CASE WHEN len(list_distinct(list_concat({a}, {b}))) = 0 THEN 0.0 ELSE "
                f"len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) END)")

    tri = lambda x: (f"(CASE WHEN length({x}) < 3 THEN [{x}] ELSE list_distinct(list_transform("  # noqa: E731
                     f"range(1, length({x}) - 1), lambda i: substring({x}, i, 3))) END)")
    meaning_map = "MAP {" + ", ".join(
        f"'{ab}': {_lit_list(sorted(set(m.replace(',', '').lower().split())))}" for ab, m in ABBREVIATIONS.items()) + "}"
    from ..operators.features import FEATURE_NAMES
    outs = []
    for c in FEATURE_NAMES:
        e = "1.0 / (1.0 + exp(-cross_encoder_logit))" if c == "cross_encoder_calibrated" else c
        outs.append(f"CAST(round({e}, 9) AS DOUBLE) AS {c}")
    final_select = "\nSELECT query_id, item_id, " + ", ".join(outs) + " FROM f"
    return f"""WITH {catalog_class_sql()}, {corpus_cte()}, {questions_cte()}{bm25_ctes()}{tfidf_ctes()}{hybrid_ctes(forced=False)}
{ranked_cte('pl', 'hyb', pool)},
ncol AS (SELECT table_name, count(*) AS n FROM ccols GROUP BY table_name),
rel AS (SELECT table_name, count(*) AS k, sum(n_tables - 1) AS d FROM tk GROUP BY table_name),
pk AS (SELECT pl.query_id, pl.item_id, tk.key FROM pl JOIN tk ON tk.table_name = pl.name),
sh AS (SELECT a.query_id, a.item_id, count(DISTINCT b.item_id) AS n FROM pk a JOIN pk b
       ON a.query_id = b.query_id AND a.key = b.key AND a.item_id <> b.item_id GROUP BY 1, 2),
bst2 AS (SELECT query_id, mn, CASE WHEN mx > 0 THEN mx ELSE 1.0 END AS mx FROM bst),
bnorm AS (SELECT query_id, mn, CASE WHEN mx <> mn THEN mx - mn ELSE 1.0 END AS rng FROM bst2),
brk AS (SELECT bm.query_id, bm.item_id, row_number() OVER (PARTITION BY bm.query_id ORDER BY round(bm.score, 9) DESC, d.ordinal) AS r
        FROM bm JOIN docs d USING (item_id)),
bm_m AS (SELECT query_id, count(*) AS m FROM bm GROUP BY query_id),
crk AS (SELECT cs.query_id, cs.item_id, row_number() OVER (PARTITION BY cs.query_id ORDER BY round(cs.score, 9) DESC, d.ordinal) AS r
        FROM cs JOIN docs d USING (item_id)),
cs_m AS (SELECT query_id, count(*) AS m FROM cs GROUP BY query_id),
base AS (
  SELECT pl.query_id, pl.item_id, pl.question, d.text, d.name, lower(pl.question) AS ql, lower(d.name) AS nl,
    (coalesce(bm.score, 0.0) - bn.mn) / bn.rng AS f_bm25, coalesce(cs.score, 0.0) AS f_cos,
    {word_set('pl.question')} AS qw, {word_set('d.text')} AS dw,
    list_distinct(list_filter(string_split(replace(lower(d.name), '_', ' '), ' '), lambda t: t <> '')) AS ntok,
    coalesce(brk.r, coalesce(bm_m.m, 0) + 1) AS f_brank, coalesce(crk.r, coalesce(cs_m.m, 0) + 1) AS f_crank,
    list_distinct(list_concat({ws_tokens('pl.question')}, list_transform({expansion_extras_sql('pl.question')}, lambda w: lower(w)))) AS exw
  FROM pl JOIN docs d ON d.item_id = pl.item_id
  LEFT JOIN bm ON bm.query_id = pl.query_id AND bm.item_id = pl.item_id
  LEFT JOIN cs ON cs.query_id = pl.query_id AND cs.item_id = pl.item_id
  JOIN bnorm bn ON bn.query_id = pl.query_id
  LEFT JOIN brk ON brk.query_id = pl.query_id AND brk.item_id = pl.item_id
  LEFT JOIN crk ON crk.query_id = pl.query_id AND crk.item_id = pl.item_id
  LEFT JOIN bm_m ON bm_m.query_id = pl.query_id LEFT JOIN cs_m ON cs_m.query_id = pl.query_id),
f AS (
  SELECT query_id, item_id, f_bm25 AS bm25_score, f_cos AS tfidf_cosine, {jac('qw', 'dw')} AS jaccard_word,
    {jac(tri('ql'), tri('lower(text)'))} AS jaccard_char_3gram,
    CASE WHEN contains(ql, nl) OR contains(ql, replace(nl, '_', ' ')) THEN 1.0 ELSE 0.0 END AS exact_table_name_match,
    CASE WHEN len(list_filter(string_split(nl, '_'), lambda p: length(p) > 3 AND contains(ql, p))) > 0 THEN 1.0 ELSE 0.0 END
      AS partial_table_name_match,
    len(list_intersect(qw, ntok)) * 1.0 AS query_table_token_overlap,
    f_cos AS biencoder_cosine,
    4.0 * ((CASE WHEN contains(ql, replace(nl, '_', ' ')) THEN 0.2 ELSE 0.0 END)
      + least(len(list_intersect(list_distinct({ws_tokens('question')}), list_distinct({ws_tokens('text')}))), 5) * 0.01) - 2.0
      AS cross_encoder_logit,
    coalesce(ncol.n, 0) * 1.0 AS num_columns, coalesce(rel.k, 0) * 1.0 AS num_fk_relations,
    coalesce(rel.d, 0) * 1.0 AS schema_graph_degree,
    CASE WHEN coalesce(sh.n, 0) > 0 THEN 1.0 ELSE 0.0 END AS has_join_key_overlap_with_candidates,
    coalesce(sh.n, 0) * 1.0 AS num_shared_join_keys_with_candidates,
    len(qw) * 1.0 AS query_length_words, length(question) * 1.0 AS query_length_chars,
    CASE WHEN {hits('ql', AGGREGATION_KEYWORDS)} > 0 THEN 1.0 ELSE 0.0 END AS has_aggregation_keyword,
    CASE WHEN {hits('ql', JOIN_KEYWORDS)} > 0 THEN 1.0 ELSE 0.0 END AS has_join_keyword,
    CASE WHEN {hits('ql', SUBQUERY_KEYWORDS)} > 0 THEN 1.0 ELSE 0.0 END AS has_subquery_indicator,
    ({hits('ql', AGGREGATION_KEYWORDS)} + {hits('ql', JOIN_KEYWORDS)} + {hits('ql', SUBQUERY_KEYWORDS)}) * 1.0
      AS num_sql_keywords_detected,
    f_bm25 * f_cos AS bm25_x_cosine, f_brank * 1.0 AS bm25_rank, f_crank * 1.0 AS cosine_rank,
    abs(f_brank - f_crank) * 1.0 AS rank_difference,
    CASE WHEN f_cos > 1e-6 THEN f_bm25 / f_cos ELSE f_bm25 * 100.0 END AS score_ratio,
    len(list_intersect(exw, list_distinct(list_concat(dw, ntok)))) * 1.0 AS llm_expansion_overlap,
    CASE WHEN len(list_intersect(qw, coalesce({meaning_map}[split_part(upper(name), '_', 1)], []::VARCHAR[]))) > 0
      THEN 1.0 ELSE 0.0 END AS category_prefix_match
  FROM base LEFT JOIN ncol ON ncol.table_name = base.name LEFT JOIN rel ON rel.table_name = base.name
  LEFT JOIN sh USING (query_id, item_id))
""" + final_select


def catalog_cte() -> str:
    """Stand-in catalog rows and parsed columns ``ccols`` in DuckDB."""
    def parse(c):
        return (f"CASE WHEN json_valid({c}) THEN CAST(json({c}) AS VARCHAR[]) ELSE list_filter(list_transform("
                f"string_split({c}, ','), lambda p: regexp_replace(p, '^[ \\[\\]\"'']+|[ \\[\\]\"'']+$', '', 'g')), "
                f"lambda p: p <> '') END")
    return f"""cat AS (
  SELECT upper(concat_ws('_', d.lang, d.source, CAST(d.doc_id AS VARCHAR))) AS table_name,
    ['doc_id', d.source || '_id', d.lang || '_code', 'text', 'n_chars', 'load_date']
      || CASE WHEN l.doc_id IS NOT NULL THEN ['quality', 'toxic'] ELSE []::VARCHAR[] END AS n,
    ['int64', 'int64', 'string', 'string', 'int64', 'timestamp']
      || CASE WHEN l.doc_id IS NOT NULL THEN ['int32', 'int32'] ELSE []::VARCHAR[] END AS t,
    d.doc_id
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
catraw AS (
  SELECT table_name,
    CASE WHEN doc_id % 2 = 0 THEN to_json(n)::VARCHAR ELSE '[' || array_to_string(n, ', ') || ']' END AS column_names,
    CASE WHEN doc_id % 2 = 0 THEN to_json(t)::VARCHAR ELSE '[' || array_to_string(t, ', ') || ']' END AS column_types
  FROM cat),
parsed AS (SELECT table_name, {parse('column_names')} AS n, {parse('column_types')} AS t FROM catraw),
ccols AS (SELECT table_name, i - 1 AS ordinal, n[i] AS column_name, coalesce(t[i], 'unknown') AS column_type
          FROM parsed, LATERAL (SELECT unnest(range(1, len(n) + 1)) AS i))"""


def _any(c: str, frags) -> str:
    return "(" + " OR ".join(f"contains({c}, '{f}')" for f in frags) + ")"


def catalog_class_sql() -> str:
    from ..operators import catalog as cg
    lc = "lower(column_name)"
    suffix = "(" + " OR ".join(f"suffix({lc}, '{s}')" for s in cg.KEY_SUFFIXES) + ")"
    known = "(" + ", ".join(f"'{k}'" for k in cg.KNOWN_KEYS) + ")"
    audit = _any(lc, cg.AUDIT_FRAGMENTS)
    jk = f"(NOT {audit} AND CASE WHEN {suffix} THEN NOT {_any(lc, cg.GENERIC_CODES)} ELSE {lc} IN {known} END)"
    stype = "CASE " + " ".join(f"WHEN contains(lower(column_type), '{f}') THEN '{v}'" for f, v in cg.TYPE_MAP) + " ELSE 'TEXT' END"
    role = (f"CASE WHEN suffix({lc}, '_id') THEN 'foreign key referencing ' || substring({lc}, 1, length({lc}) - 3) || ' table' "
            f"WHEN {_any(lc, cg.ROLE_NUMERIC)} THEN 'numeric aggregation column' "
            f"WHEN {_any(lc, cg.ROLE_TEXT)} THEN 'descriptive text column' "
            f"WHEN {_any(lc, cg.ROLE_TIME)} THEN 'temporal column' END")
    return f"""{catalog_cte()},
cls AS (SELECT table_name, ordinal, column_name, column_type, {stype} AS storage_type, {audit} AS is_audit,
          {jk} AS is_join_key, {role} AS role FROM ccols),
tkeys AS (SELECT DISTINCT table_name, lower(column_name) AS key FROM cls WHERE is_join_key),
hubs AS (SELECT key, count(*) AS n_tables FROM tkeys GROUP BY key HAVING count(*) > 1),
tk AS (SELECT tkeys.table_name, tkeys.key, hubs.n_tables FROM tkeys JOIN hubs USING (key))"""


def usecase_sql(t: str) -> str:
    from ..operators.expand import ABBREVIATIONS
    m = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in ABBREVIATIONS.items()) + "}"
    meanings = f"list_filter(list_transform(string_split(upper({t}), '_'), lambda p: {m}[p]), lambda x: x IS NOT NULL)"
    return (f"CASE WHEN len({meanings}) > 0 THEN 'This table is useful for queries concerning ' || "
            f"array_to_string({meanings}, ', ') || '.' ELSE 'This table stores records related to ' || "
            f"replace(lower({t}), '_', ' ') || '.' END")


def describe_sql(clean: bool) -> str:
    item = "column_name" if clean else \
        "column_name || ' (' || column_type || ')' || CASE WHEN role IS NOT NULL THEN ' [role: ' || role || ']' ELSE '' END"
    return f"""WITH {catalog_class_sql()},
per AS (SELECT table_name, string_agg({item}, ', ' ORDER BY ordinal) AS cols FROM cls WHERE NOT is_audit GROUP BY table_name),
ks AS (SELECT table_name, string_agg(key || ' (' || CAST(n_tables AS VARCHAR) || ' tables)', ', ' ORDER BY key, n_tables) AS keys
       FROM tk GROUP BY table_name)
SELECT per.table_name, 'Table: ' || per.table_name || '. ' || {usecase_sql('per.table_name')} || ' Schema structure: ['
  || cols || '].' || CASE WHEN keys IS NOT NULL THEN ' Join Keys: [' || keys || '].' ELSE '' END AS description
FROM per LEFT JOIN ks USING (table_name)"""


def rule_boost_sql(rules) -> str:
    def has(words, col="ql"):
        return "(" + " OR ".join(f"contains({col}, '{w}')" for w in words) + ")" if words else "true"
    parts = []
    for r in rules:
        cond = has(r.any_of)
        if r.any_of_2:
            cond += f" AND {has(r.any_of_2)}"
        if r.none_of:
            cond += f" AND NOT {has(r.none_of)}"
        parts.append(f"SELECT query_id, '{r.rule_id}' AS rule_id, '{r.target}' AS target, '{r.match}' AS match, "
                     f"CAST({float(r.delta)} AS DOUBLE) AS delta FROM qq WHERE {cond}")
    return f"""WITH qq AS (SELECT conv_id * 1000 + turn AS query_id, lower(coalesce(text, '')) AS ql
                FROM conversations WHERE role = 'user'),
fired AS ({' UNION ALL '.join(parts)}),
pr AS (SELECT query_id, rule_id, target, match, max(delta) AS d FROM fired GROUP BY ALL)
SELECT query_id, target, match, sum(d) AS boost FROM pr GROUP BY query_id, target, match"""


def training_set_sql(round_to: int = 9) -> str:
    from ..operators.features import FEATURE_NAMES
    cols = ", ".join(f"f.{c}" for c in FEATURE_NAMES)
    return f"""WITH feats AS ({features_28_sql()}),
gold AS ({containment_gold_sql()}),
withgold AS (SELECT DISTINCT item_id AS query_id FROM gold)
SELECT f.query_id AS group_id, f.item_id, {cols},
       CASE WHEN g.doc_id IS NULL THEN 0.0 ELSE 1.0 END AS label
FROM feats f JOIN withgold w ON w.query_id = f.query_id
LEFT JOIN gold g ON g.item_id = f.query_id AND g.doc_id = f.item_id"""


def class_balance_sql() -> str:
    return f"""WITH t AS ({training_set_sql()})
SELECT sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS positives, sum(CASE WHEN label <> 1 THEN 1 ELSE 0 END) AS negatives,
       count(DISTINCT group_id) AS groups,
       round(sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) / count(*), 6) AS positive_ratio FROM t"""


def group_kfold_sql(k: int = 5) -> str:
    return f"""WITH RECURSIVE t AS ({training_set_sql()}),
s AS (SELECT group_id, count(*) AS n FROM t GROUP BY group_id),
g AS (SELECT least({k}, (SELECT count(*) FROM s)) AS kk),
r AS (SELECT group_id, n, row_number() OVER (ORDER BY n DESC, group_id) AS i FROM s),
d AS (SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS group_id, list_transform(range(kk), lambda j: CAST(0 AS BIGINT)) AS loads,
        CAST(NULL AS INTEGER) AS fold FROM g
      UNION ALL
      SELECT r.i, r.group_id, list_transform(d.loads, lambda x, j: x + CASE WHEN j = list_position(d.loads, list_min(d.loads))
               THEN r.n ELSE 0 END), CAST(list_position(d.loads, list_min(d.loads)) - 1 AS INTEGER)
      FROM d JOIN r ON r.i = d.i + 1)
SELECT group_id, fold FROM d WHERE i > 0"""


def standard_scale_sql() -> str:
    from ..operators.features import FEATURE_NAMES
    stats = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in FEATURE_NAMES)
    cols = ", ".join(f"round((t.{c} - m_{c}) / CASE WHEN s_{c} > 0 THEN s_{c} ELSE 1.0 END, 4) AS {c}"
                     for c in FEATURE_NAMES)
    return f"""WITH t AS ({training_set_sql()}), st AS (SELECT {stats} FROM t)
SELECT t.group_id, t.item_id, {cols}, t.label FROM t, st"""


def phrase_extras_sql(q: str, phrases) -> str:
    parts = [f"CASE WHEN contains(lower({q}), '{p}') THEN {_lit_list(ws)} ELSE []::VARCHAR[] END"
             for p, ws in phrases.items()]
    return "list_distinct(flatten([" + ", ".join(parts) + "]))"


def hybrid_search_sql(k: int = 20) -> str:
    """Offline expansion (phrase words + names mentioned in clean or
    singular form), then hybrid fusion on the expanded text."""
    from ..operators.expand import OFFLINE_PHRASES
    sing = "regexp_replace(replace(lower(d.name), '_', ' '), 's+$', '')"
    return f"""WITH {corpus_cte()}, q0 AS (SELECT item_id AS query_id, coalesce(text, '') AS question FROM benchmark),
names AS (SELECT q0.query_id, list(DISTINCT d.name) AS nm FROM q0 CROSS JOIN docs d
          WHERE contains(lower(q0.question), replace(lower(d.name), '_', ' ')) OR contains(lower(q0.question), {sing})
          GROUP BY q0.query_id),
q AS (SELECT q0.query_id, q0.question || ' ' || array_to_string(list_concat({phrase_extras_sql('q0.question', OFFLINE_PHRASES)},
        coalesce(names.nm, []::VARCHAR[])), ' ') AS question FROM q0 LEFT JOIN names USING (query_id))
{bm25_ctes()}{tfidf_ctes()}{hybrid_ctes(forced=False)}
SELECT query_id, item_id, round(score, 6) AS score, rank FROM (
  SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, ordinal) AS rank FROM hyb)
WHERE rank <= {k}"""


def retrieve_full_sql(rules: str, k: int = 5, pool: int = 25, questions: str = "") -> str:
    """The heuristic branch of the full pipeline over all question x item
    pairs.  ``rules`` = SELECT of (cues, target, match, delta), which may read
    ``docs``; ``questions`` = CTE of (query_id, question) if not the benchmark."""
    from ..operators.expand import SQL_PHRASES
    extras = (f"list_distinct(list_concat({phrase_extras_sql('q.question', SQL_PHRASES)}, "
              f"{expansion_extras_sql('q.question')}))")
    ws = lambda c: f"list_distinct({ws_tokens(c)})"
    words = (f"list_transform({ws_tokens('question')}, lambda t: "
             "regexp_replace(t, '^[?,.()_:]+|[?,.()_:]+$', '', 'g'))")
    # BM25 sees the expanded question, the cosine the plain one
    bm = bm25_ctes().replace("FROM q)", "FROM xq)")
    return f"""WITH {catalog_class_sql()}, {corpus_cte()}, {questions or questions_cte()},
men AS (SELECT q.query_id, d.item_id, d.name FROM q CROSS JOIN docs d WHERE {mention_sql()}),
mnames AS (SELECT query_id, list(DISTINCT name) AS nm FROM men GROUP BY query_id),
xq AS (SELECT q.query_id, q.question || ' ' || array_to_string(list_concat({extras}, coalesce(nm, []::VARCHAR[])), ' ') || ' ' AS question
       FROM q LEFT JOIN mnames USING (query_id)){bm}{tfidf_ctes()},
ball AS ({all_pairs('bm')}),
bst AS (SELECT query_id, min(score) AS mn, max(score) AS mx0 FROM ball GROUP BY query_id),
bsr AS (SELECT query_id, mn, CASE WHEN (CASE WHEN mx0 > 0 THEN mx0 ELSE 1.0 END) <> mn
          THEN (CASE WHEN mx0 > 0 THEN mx0 ELSE 1.0 END) - mn ELSE 1.0 END AS rng FROM bst),
nw AS (SELECT DISTINCT query_id, unnest({words}) AS w FROM q),
np AS (SELECT item_id, split_part(lower(name), '_', 2) AS p2 FROM docs),
nb AS (SELECT query_id, item_id, max(b) AS b FROM (SELECT query_id, item_id, 2.0 AS b FROM men UNION ALL
       SELECT query_id, item_id, 1.5 FROM nw JOIN np ON length(p2) > 3 AND (nw.w = p2 OR nw.w = p2 || 's'
         OR (suffix(p2, 's') AND nw.w = left(p2, length(p2) - 1)))) GROUP BY ALL),
rules AS ({rules}),
rb AS (SELECT q.query_id, d.item_id, sum(r.delta) AS b FROM q JOIN rules r
         ON len(list_filter(r.cues, lambda c: contains(lower(q.question), c))) > 0
       JOIN docs d ON (r.match = 'exact' AND d.name = r.target) OR (r.match = 'prefix' AND starts_with(d.name, r.target))
       GROUP BY ALL),
s AS (SELECT q.query_id, q.question, d.item_id, d.ordinal, d.name, d.text,
        0.5 * coalesce(cs.score, 0.0) + 0.5 * ((coalesce(bm.score, 0.0) - mn) / rng) + coalesce(nb.b, 0.0) + coalesce(rb.b, 0.0) AS score,
        rb.b AS rule
      FROM q CROSS JOIN docs d JOIN bsr ON bsr.query_id = q.query_id
      LEFT JOIN bm ON bm.query_id = q.query_id AND bm.item_id = d.item_id
      LEFT JOIN cs ON cs.query_id = q.query_id AND cs.item_id = d.item_id
      LEFT JOIN nb ON nb.query_id = q.query_id AND nb.item_id = d.item_id
      LEFT JOIN rb ON rb.query_id = q.query_id AND rb.item_id = d.item_id),
ik AS (SELECT DISTINCT docs.item_id, tk.key FROM docs JOIN tk ON tk.table_name = docs.name),
hub AS (SELECT query_id, key, max(score) * 0.4 AS lift FROM s JOIN ik USING (item_id) WHERE score > 1.0 GROUP BY ALL),
lifts AS (SELECT hub.query_id, ik.item_id, max(hub.lift) AS lift FROM hub JOIN ik USING (key) GROUP BY ALL),
p AS (SELECT s.* REPLACE (greatest(s.score, coalesce(lifts.lift, s.score)) AS score) FROM s LEFT JOIN lifts USING (query_id, item_id)),
r0 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, ordinal) AS rk FROM p),
c AS (SELECT *, 4.0 * (CASE WHEN contains(lower(question), replace(lower(name), '_', ' ')) THEN 0.2 ELSE 0.0 END
        + least(len(list_intersect({ws('question')}, {ws('text')})), 5) * 0.01) - 2.0 AS logit
      FROM r0 WHERE rk <= {pool} OR rule >= 0.8),
f AS (SELECT *, score + 1.5 / (1.0 + exp(-logit)) AS fused, round(1.0 / (1.0 + exp(-(logit + 2.5) / 1.2)), 4) AS cal FROM c),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(fused, 9) DESC, ordinal) AS rank FROM f)
SELECT t.query_id, t.rank, t.item_id, t.name, round(t.fused, 6) AS rank_score, t.cal AS score,
  first_value(t.cal) OVER (PARTITION BY t.query_id ORDER BY t.rank) AS confidence,
  CASE WHEN men.item_id IS NOT NULL THEN 'Question directly mentions table ''' || t.name || ''''
       ELSE 'Semantically mapped table based on query intent (score=' || CAST(t.cal AS VARCHAR) || ')' END AS reason,
  'heuristic' AS model_used
FROM t LEFT JOIN men ON men.query_id = t.query_id AND men.item_id = t.item_id WHERE t.rank <= {k}"""


def rules_select(rules) -> str:
    """Rules of one cue list each as rows (cues, target, match, delta)."""
    return " UNION ALL ".join(f"SELECT {_lit_list(r.any_of)} AS cues, '{r.target}' AS target, '{r.match}' AS match, "
                              f"CAST({float(r.delta)} AS DOUBLE) AS delta" for r in rules)
