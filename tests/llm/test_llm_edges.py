"""Edge cases of every training-data operator and pipeline stage."""

import pytest

import corpus_pipeline as cp
from ranksmith.llm import (decontam, html_text, knn_join, langid, lm_score, mixing, ngram_join, quality,
                           repeats, token_files)
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977}x{i}" for i in range(30_000))
SAY = "the quick brown fox jumps over the lazy dog and runs away from all of them"
ROWS = [
    (1, SAY, "en", "a", 1), (2, SAY, "en", "b", 1), (2, SAY, "en", "b", 1), (3, None, "en", "a", None),
    (4, "", None, None, 0), (5, " \t\n ", "en", "", 1), (None, SAY + " again", "en", "a", 1),
    (6, "der schnelle braune fuchs springt über den faulen hund und läuft davon", "de", None, 1),
    (7, LONG, None, "a", 1), (8, "12345 !!! ---", "en", "c", 1), (9, "one", "en", "c", 1),
    (10, "ein kleiner hund läuft schnell über die straße und bellt", "de", "c", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, ids that
    repeat, and extra columns named like the operators' own."""
    df = spark.createDataFrame(ROWS, DOCS)
    for c in ("sig", "bits", "key", "n", "target", "b1", "whole", "_size", "_row", "score", "lang_pred", "spans",
              "quality", "held_out", "_keep", "tid", "rows", "part", "chunk"):
        df = df.withColumn(c, F.lit("x"))
    return df


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, SAY, "x"), (1, SAY, "x"), (None, "a b c d e f", "x"), (2, None, "x"), (3, "", "x"),
                                  (4, "!!!", "x")], "item_id long, text string, n_matched string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (2, 0, 1), (6, 0, 0), (8, 0, 0), (None, 1, 0), (9, None, None),
                                  (10, 1, 0)], "doc_id long, quality int, toxic int")


def by_id(df, *cols):
    return sorted((tuple(r[c] for c in ("doc_id", *cols)) for r in df.collect()), key=repr)


def test_lm_score(docs, none, labels):
    got = by_id(lm_score.score(docs, lm_score.good_ids(labels)), "n_tokens", "ce_difference")
    assert len(got) == len(ROWS)
    one = {r[0]: r for r in got}
    assert one[3][1:] == one[4][1:] == one[5][1:] == (0, 0.0)
    assert one[1][1:] == one[2][1:] and one[1][2] < one[6][2]
    assert lm_score.score(none, lm_score.good_ids(labels)).count() == 0
    no_target = lm_score.score(docs, labels.where("false").select("doc_id")).collect()
    assert {r["ce_difference"] for r in no_target} == {0.0}


def test_ngram_join(docs, none):
    got = by_id(ngram_join.link_documents(docs), "n_shingles", "component_id")
    assert len(got) == len(ROWS)
    one = {r[0]: r[1:] for r in got}
    assert one[1] == one[2] == (14, 1) and one[None] == (15, 1)  # 14 of 15 shingles
    assert one[3] == (0, 3) and one[4] == (0, 4) and one[5] == (0, 5) and one[9] == (1, 9)
    assert ngram_join.link_documents(none).count() == 0


def test_repeats(docs, none):
    got = by_id(repeats.remove_repeats(docs, length=40, gram=8), "n_bytes", "n_removed", "n_spans")
    one = {r[0]: r[1:] for r in got}
    assert len(got) == len(ROWS)
    size = len(SAY)
    assert one[1] == one[2] == (size, size, 1) and one[None] == (size + 6, size, 1)
    assert one[3] == one[4] == (0, 0, 0) and one[7][1] == 0
    assert repeats.remove_repeats(none).count() == 0


def test_quality(docs, none, labels):
    got = by_id(quality.classify(docs, labels), "score", "predicted")
    assert len(got) == len(ROWS) and all(0 <= r[1] <= 1 and r[2] == (r[1] >= 0.3) for r in got)
    assert {r[1] for r in got if r[0] in (3, 4)} and len({r[1] for r in got if r[0] in (3, 4)}) == 1
    assert quality.classify(none, labels).count() == 0
    assert {r["score"] for r in quality.classify(docs, labels.where("false")).collect()} == {0.5}


def test_html(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>x"), (3, "u", "<p>" + "long text, " * 50_000),
            (3, "u", "<div><p>a &amp; b</div><nav>n</nav>"), (3, "u", "<div><p>a &amp; b</div><nav>n</nav>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = [(r.page_id, r.text if r.n_chars < 99 else "long", r.n_chars) for r in html_text.extract(df).collect()]
    assert sorted(got, key=repr) == sorted([(1, "", 0), (2, "", 0), (None, "x", 1), (3, "long", 549_999),
                                            (3, "a & b", 5), (3, "a & b", 5)], key=repr)
    assert html_text.extract(df.where("false")).count() == 0


def test_knn(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, 0.5]), (0, [0.5, 0.5]), (1, [0.5, 0.5]), (2, None), (3, [None, 1.0]), (4, [nan, 1.0]), (5, [inf, 0.0]),
            (6, [0.5]), (7, []), (None, [1.0, 1.0]), (20, [-0.5, 0.01]), (21, [0.5, 0.5]), (21, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit("x")).withColumn("cell", F.lit(1))
    got = [tuple(r) for r in knn_join.top_k(df, F.col("vec_id") % 20 == 0, 4).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 2048), (0, 2, 21, 2048), (0, 3, 21, 2048), (0, 4, 6, 1024),
                   (20, 1, 7, 0), (20, 2, 0, -1024), (20, 3, 0, -1024), (20, 4, 1, -1024)]
    assert knn_join.top_k(df.where("false"), F.col("vec_id") % 20 == 0, 4).count() == 0
    assert knn_join.top_k(df.where("vec_id = 2"), F.col("vec_id") % 20 == 0, 4).count() == 0


def test_decontamination(docs, none, items):
    got = by_id(decontam.find(docs, items), "item_id", "n_matched", "n_windows", "verbatim")
    assert [r[0] for r in got] == [1, 2, 2, None] and all(r[1:] == (1, 12, 12, True) for r in got)
    assert decontam.find(none, items).count() == 0 and decontam.find(docs, items.where("false")).count() == 0
    kept = decontam.clean(docs, items)
    assert kept.columns == docs.columns and kept.count() == len(ROWS) - 4


def test_language(docs, none):
    got = by_id(langid.identify(docs), "lang_pred", "score")
    one = {r[0]: r[1:] for r in got}
    assert len(got) == len(ROWS) and one[3] == one[4] == one[5] == one[8] == ("und", 0.0)
    assert one[1][0] == "en" and langid.identify(none).count() == 0
    assert {r[1] for r in by_id(langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))), "lang_pred")} == {"und"}


def test_token_files(spark, docs, none):
    got = by_id(token_files.token_digest(spark, docs), "start", "n_tokens", "ids_crc32")
    one = {r[0]: r[1:] for r in got}
    assert len(got) == len(ROWS) and one[None][0] == 0
    assert one[3][1] == one[4][1] == 1 and one[3][2] == one[4][2] == 3_738_908_513 or one[3][2] == one[4][2]
    assert one[1][1:] == one[2][1:]
    total = 0
    for r in sorted(got, key=lambda r: r[1]):
        assert r[1] == total
        total += r[2]
    assert token_files.token_digest(spark, none).count() == 0


def test_mix(docs, none):
    got = by_id(mixing.mix_documents(docs), "size", "source_size", "target", "taken", "source")
    assert len(got) == len(ROWS) and all(0 <= r[4] <= 2 * r[1] for r in got)
    by_source = {r[5]: r[2:4] for r in got}
    assert list(sorted(by_source, key=lambda s: (s is None, s or ""))) == ["", "a", "b", "c", None]
    assert by_source[""] == (0, 0.0) and mixing.mix_documents(none).count() == 0


@pytest.mark.parametrize("stage", range(5))
def test_stages(spark, docs, none, items, stage, tmp_path):
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    name, run = cp.STAGES[stage]
    out = run(spark, docs, str(tmp_path))
    empty = run(spark, none, str(tmp_path))
    assert empty.count() == 0
    if stage < 4:
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
    ids = sorted((r["doc_id"] for r in out.select("doc_id").collect()), key=repr)
    if stage == 0:
        assert ids == [1, 10, 2, 2, 6, 7, 9, None]
    if stage == 1:
        assert ids == [1, 10, 3, 4, 5, 6, 7, 8, 9, None]
    if stage == 2:
        assert ids == [10, 3, 4, 5, 6, 7, 8, 9]
    if stage == 3:
        assert not {3, 4, 5} & set(ids)
    if stage == 4:
        assert len(ids) == len(ROWS)
