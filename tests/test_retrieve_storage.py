"""The full pipeline stores its rows per (question, item) as Parquet."""

import collections
import os

from ranksmith.plans import retrieve as rt


def test_pairs_are_parquet_and_the_rows_are_those_of_checkpoints(spark, monkeypatch):
    docs = [(1, 1, "EN_SRC1_1", "the cat and the dog"), (2, 2, "EN_SRC2_2", "a dog of the house"), (2, 2, "EN_SRC2_2", "a dog of the house"),
            (3, 3, "FR_SRC1_3", "le chat et la maison"), (None, None, "DE_SRC1", "der hund und die katze"), (5, 5, "DE_SRC2_5", "")]
    corpus = spark.createDataFrame(docs, "item_id long, ordinal long, name string, text string")
    keys = spark.createDataFrame([(i, "src1_id", i) for i in (1, 3)] + [(2, "src2_id", 2), (5, "src2_id", 5)],
                                 "item_id long, key string, ordinal long")
    qs = spark.createDataFrame([(10, "the dog and src2 en src1 1"), (11, "la maison"), (12, "nothing"), (13, "")],
                               "query_id long, question string")
    idx, kept, plain = rt.Indexes(corpus), [], rt.stored

    def run():
        return collections.Counter(tuple(r) for r in rt.retrieve_full(idx, qs, keys, k=3, pool=4).collect())

    def told(df, name):
        out = plain(df, name)
        kept.append((name, out.inputFiles()))
        return out
    idx.bm25, idx.tfidf
    monkeypatch.setattr(rt, "stored", told)
    got = run()
    assert [name for name, _ in kept] == ["bm25-pairs", "cosine-pairs", "rule-boosts", "scores", "lifted"]
    assert all(os.path.basename(f).endswith(".parquet") for _, files in kept for f in files)
    monkeypatch.setattr(rt, "stored", lambda df, name: rt.stage(df))
    assert got == run() and got
