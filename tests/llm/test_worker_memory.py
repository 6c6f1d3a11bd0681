"""What a Python worker keeps from one operator when another takes over."""

import numpy as np

from ranksmith.llm import common, langid, token_files


def test_memory_goes_back_when_another_operator_takes_over(monkeypatch):
    """pipeline, language_id after token_ids: the memos and the vocabulary of
    the operator before go, and their memory, before the first batch."""
    calls = []
    monkeypatch.setattr(common, "give_back", lambda: calls.append(dict(token_files._ENCODERS)))
    monkeypatch.setattr(common, "_MEMO_OF", [None])
    monkeypatch.setattr(token_files, "_ENCODERS", {})
    enc = object.__new__(token_files.MemoEncoder)
    enc.memo, enc.plain = {"a": b"1"}, {"b": b"2"}
    token_files._ENCODERS["path", True, 1] = enc
    common.sole_memo(enc.forget)
    common.sole_memo(enc.forget)
    assert enc.memo and len(calls) == 1
    common.sole_memo()
    assert not enc.memo and not enc.plain and calls[1:] == [{}]
    common.sole_memo()
    assert len(calls) == 2


def test_models_do_not_depend_on_slices(spark, monkeypatch):
    """Smaller slices bound a task's arrays; sums and predictions stay."""
    rnd = np.random.default_rng(5)
    rows = [(i, None if i == 7 else " ".join("".join(rnd.choice(list("abcdeéß"), 4)) for _ in range(int(rnd.integers(0, 60)))),
             ("de", "en", None)[i % 3]) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = []
    for size in (1 << 21, 100):
        monkeypatch.setattr(langid, "SLICE_BYTES", size)
        names, proto = langid.learn(docs)
        got.append((names, proto.tolist(), sorted(map(tuple, langid.identify(docs).collect()))))
    assert got[0] == got[1]

