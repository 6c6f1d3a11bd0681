"""Registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (decontam, exact_dedup, html_text, infill, knn_join, langid, lm_score, mixing, ngram_join, prefix_trie, quality,
               repeats, token_files)
from .common import read

Query = Callable[[SparkSession, str], DataFrame]


def op1_ce_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(read(spark, sf_dir, "documents"), lm_score.good_ids(read(spark, sf_dir, "labels")))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_documents(read(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(read(spark, sf_dir, "documents"))


def op4_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read(spark, sf_dir, "pages"))


def op6_voronoi_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn_join.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents"))


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_digest(spark, read(spark, sf_dir, "documents"))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(read(spark, sf_dir, "documents"))


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digests(read(spark, sf_dir, "documents"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.classes(read(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.node_rows(read(spark, sf_dir, "conversations"))


QUERIES: dict[str, Query] = {
    "op1_ce_difference": op1_ce_difference,
    "op2_ngram_join": op2_ngram_join,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_quality_crf": op4_quality_crf,
    "op5_html_text": op5_html_text,
    "op6_voronoi_top_k": op6_voronoi_top_k,
    "op7_decontamination": op7_decontamination,
    "op8_language_id": op8_language_id,
    "op9_token_ids": op9_token_ids,
    "op10_source_mix": op10_source_mix,
    "op11_infill": op11_infill,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE: dict[str, str] = {
    "op1_ce_difference": r"""
WITH d AS (
  SELECT doc_id, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0) AS target,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x20\x09-\x0D]+') AS ws FROM documents),
tok AS (
  SELECT doc_id, target, unnest(ws) AS w, generate_subscripts(ws, 1) AS i, len(ws) AS n FROM d),
uni AS (SELECT w, count(*) AS b, count(*) FILTER (target) AS t FROM tok GROUP BY w),
ids AS (SELECT doc_id, target, i, n, CASE WHEN u.t >= 2 THEN tok.w ELSE ' unk' END AS w FROM tok JOIN uni u USING (w)),
big AS (
  SELECT doc_id, target, w, i, n, coalesce(lag(w) OVER (PARTITION BY doc_id ORDER BY i), ' s') AS v FROM ids),
tot AS (SELECT count(*) AS nb, count(*) FILTER (target) AS nt,
               (SELECT count(*) FROM uni WHERE t >= 2) AS vs FROM ids),
one AS (SELECT w, count(*) AS b, count(*) FILTER (target) AS t FROM ids GROUP BY w),
his AS (SELECT v, count(*) AS b, count(*) FILTER (target) AS t FROM big GROUP BY v),
two AS (SELECT v, w, count(*) AS b, count(*) FILTER (target) AS t FROM big GROUP BY v, w),
val AS (
  SELECT two.v, two.w,
         ln(((nt::DOUBLE / nb) * two.b + 5.0 * ((nt::DOUBLE / nb) * one.b + 0.5) / (nt + 0.5 * (vs + 1)))
            / ((nt::DOUBLE / nb) * his.b + 5.0))
         - ln((two.t + 5.0 * (one.t + 0.5) / (nt + 0.5 * (vs + 1))) / (his.t + 5.0)) AS x
  FROM two JOIN one ON one.w = two.w JOIN his ON his.v = two.v CROSS JOIN tot)
SELECT d.doc_id, len(d.ws) AS n_tokens, round(coalesce(s.x, 0.0), 6) AS ce_difference
FROM d LEFT JOIN (SELECT doc_id, avg(x) AS x FROM big JOIN val USING (v, w) GROUP BY doc_id) s USING (doc_id)""",
    "op2_ngram_join": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1),
                        lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS sh FROM d),
x AS (SELECT doc_id, unnest(sh) AS h FROM s),
p AS (SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS c FROM x a JOIN x b ON a.h = b.h AND a.doc_id <> b.doc_id
      GROUP BY 1, 2),
l AS (SELECT i, j FROM p JOIN s a ON a.doc_id = i JOIN s b ON b.doc_id = j
      WHERE 100 * c >= 90 * (len(a.sh) + len(b.sh) - c)),
r AS (SELECT doc_id AS i, doc_id AS j FROM s UNION SELECT r.i, l.j FROM r JOIN l ON l.i = r.j)
SELECT s.doc_id, len(any_value(s.sh)) AS n_shingles, min(r.j) AS component_id
FROM s JOIN r ON r.i = s.doc_id GROUP BY s.doc_id""",
    "op6_voronoi_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: coalesce(z[1] * z[2], 0))) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op11_infill": r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
r AS (
  SELECT *, len(u) AS n, list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(h, i, 8))::BIGINT) AS x FROM d),
c AS (
  SELECT *, least(x[1] % (n + 1), x[2] % (n + 1)) AS a, greatest(x[1] % (n + 1), x[2] % (n + 1)) AS z,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR x[3] % 100 >= 50
              THEN 'plain' WHEN x[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM r),
p AS (
  SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:z], '') AS mid,
         array_to_string(u[z + 1:n], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
              ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p""",
    "op12_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents),
r AS (
  SELECT *, count(*) OVER (PARTITION BY t) AS group_size,
         first_value(doc_id) OVER (PARTITION BY t ORDER BY points DESC, doc_id NULLS FIRST) AS keep_id,
         row_number() OVER (PARTITION BY t ORDER BY points DESC, doc_id NULLS FIRST) AS k FROM d)
SELECT doc_id, keep_id, group_size, k = 1 AS kept, sha256(t) AS text_sha256 FROM r""",
    "op13_prefix_trie": r"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
k AS (
  SELECT DISTINCT c, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
    lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
      lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295::BIGINT) % 9 AS h FROM t),
e AS (
  SELECT k.c, b.pos, b.role, b.text, 0 AS part FROM k JOIN t b ON b.c = k.c - k.c % 5 AND b.pos <= k.h
  UNION ALL SELECT t.c, t.pos, t.role, t.text, 1 FROM t JOIN k ON k.c = t.c WHERE t.pos > k.h),
p AS (
  SELECT c, row_number() OVER w AS d, strlen(text) AS n_bytes,
         string_agg(sha256(sha256(role) || sha256(text)), '') OVER w AS path
  FROM e WINDOW w AS (PARTITION BY c ORDER BY part, pos ROWS UNBOUNDED PRECEDING)),
a AS (SELECT c, d, n_bytes, path FROM p UNION ALL SELECT c, 0, 0, '' FROM k),
l AS (SELECT c, max(d) AS size FROM a GROUP BY c),
n AS (
  SELECT path, d, min(a.c) AS owner, count(*) AS n_convs, any_value(n_bytes) AS n_bytes,
         sha256(coalesce(string_agg(a.c::VARCHAR, ',' ORDER BY a.c) FILTER (d = size), '')) AS ends
  FROM a JOIN l ON l.c = a.c GROUP BY path, d),
x AS (SELECT n.*, up.owner AS parent FROM n LEFT JOIN n up ON up.d = n.d - 1 AND up.path = left(n.path, 64 * (n.d - 1))),
ch AS (SELECT left(path, 64 * (d - 1)) AS path, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1, 2),
y AS (SELECT x.*, coalesce(ch.n_children, 0) AS n_children FROM x LEFT JOIN ch ON ch.path = x.path AND ch.d = x.d)
SELECT u.owner AS conv_id, u.d AS depth, any_value(u.parent) AS parent_conv_id, any_value(u.n_convs) AS n_convs,
       any_value(u.n_children) AS n_children, count(*) FILTER (v.n_children = 0) AS n_leaves,
       CAST(sum((v.n_convs - 1) * v.n_bytes) AS BIGINT) AS saved_tokens, any_value(u.ends) AS ends_sha256
FROM y u JOIN y v ON v.d >= u.d AND left(v.path, 64 * u.d) = u.path GROUP BY u.owner, u.d, u.path""",
}
