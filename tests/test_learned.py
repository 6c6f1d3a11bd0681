"""The learned-ranker branch of the full pipeline."""

from ranksmith.plans import registry as rg
from ranksmith.plans import retrieve as rt


def test_learned_ranker_in_the_full_pipeline(spark, sf_small):
    idx, qs = rg._setup(spark, sf_small)
    keys, structure = rg._item_keys(spark, sf_small), rg._item_structure(spark, sf_small)
    ranker = rg._learned(spark, sf_small, "random_forest", {"numTrees": 5})
    out = rt.retrieve_full(idx, qs, keys, ranker=ranker, structure=structure).collect()
    by_q = {}
    for r in out:
        by_q.setdefault(r["query_id"], []).append(r)
    assert len(by_q) == qs.count()
    for rows in by_q.values():
        rows.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == [1, 2, 3, 4, 5]
        assert all(0 <= r["rank_score"] <= 1 and 0 <= r["score"] <= 1 for r in rows)
        assert [r["rank_score"] for r in rows] == sorted((r["rank_score"] for r in rows), reverse=True)
        assert all(r["model_used"] == "learned_random_forest" for r in rows)
        assert all(r["confidence"] == rows[0]["score"] for r in rows)
