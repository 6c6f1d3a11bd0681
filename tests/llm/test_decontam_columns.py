"""Decontamination: texts are looked up as columns, and only those that can
hold an item one by one."""

import random

import numpy as np
import pytest

from ranksmith.llm import decontam

ITEM = "Anna Smith buys 3 apples and Bob buys 4 pears so how many fruits do they carry home"
DENSE = "これは長い日本語の問題文です二十三個のりんごがあります答えは何ですか"


def _texts() -> list[str | None]:
    r = random.Random(5)
    words = "the a Anna Smith Bob 3 14 km NASA USA end. What? “no” ... x y two\n seven\t- of, Tom:".split(" ")
    return [None, "", " ", "...", "Anna Smith.", "Anna Smith went", "NASA", "USA 3", "4 5"] + [
        " ".join(r.choice(words) for _ in range(r.randrange(1, 40))) for _ in range(300)]


def test_templates_of_several_texts_are_those_of_each():
    texts = _texts()
    ids, slot, cut = decontam.templates(texts)
    own = decontam.wide(ids, slot, cut)
    ends = np.searchsorted(own[2], cut)
    for k, text in enumerate(texts):
        h, s, _ = decontam.template(text or "")
        lo, hi = cut[k], cut[k + 1]
        assert ids[lo:hi].tolist() == h.tolist() and slot[lo:hi].tolist() == s.tolist()
        w = decontam.wide(h, s)
        lo, hi = ends[k], ends[k + 1]
        assert own[0][lo:hi].tolist() == w[0].tolist() and own[1][lo:hi].tolist() == w[1].tolist()
        assert (own[2][lo:hi] - cut[k]).tolist() == w[2][:-1].tolist()


@pytest.mark.parametrize("items", [[(1, ITEM)], [(1, ITEM), (2, "Short item")], [(1, ITEM), (3, DENSE)], [(2, "Short item")], []])
def test_texts_taken_up_hold_all_matches(items):
    texts = _texts() + [f"Before. {ITEM.replace('Anna', 'Eve')} Then 5 more", "Short item!", "前置き。" + DENSE, ITEM[:40], ITEM]
    index = decontam.Items(items)
    held = [k for k, t in enumerate(texts) if next(index.matches(t), None) is not None]
    taken = index.sharing(texts).tolist()
    assert set(held) <= set(taken) and len(held) >= len(items)
    assert index.sharing([]).tolist() == [] and index.sharing([None, ""]).tolist() == []


def test_only_texts_that_share_a_window_are_taken_up():
    index = decontam.Items([(1, ITEM)])
    # the item's words across the border of two texts are no window of either
    texts = ["a text about nothing of the kind at all", ITEM, "some Anna Smith buys 3", "apples and Bob buys and leaves with it", None]
    assert index.sharing(texts).tolist() == [1]


def test_find_and_clean(spark):
    texts = [f"text {i} about nothing of the kind at all" for i in range(50)] + [ITEM, None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontam.find(docs, items).collect()] == [(50, 1)]
    assert sorted(r.doc_id for r in decontam.clean(docs, items).collect()) == [*range(50), 51]
