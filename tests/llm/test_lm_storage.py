"""What op1 stores and shuffles: words by steps, their places by frequency."""

import numpy as np
import pyarrow as pa

from ranksmith.llm import lm_score as lm


def _texts(n, seed=3):
    rng = np.random.default_rng(seed)
    # frequent words, and many that occur once
    return [" ".join(f"w{min(x, 10 ** 9)}" for x in rng.zipf(1.3, 4000)) for _ in range(n)]


def test_steps_round_trip_of_any_width():
    for values in (np.array([], "<u4"), np.array([7, 3, 4, 2 ** 32 - 1, 0], "<u4"), np.array([5, 2 ** 64 - 1, 2 ** 63], np.uint64)):
        assert (np.cumsum(lm._steps(values), dtype=values.dtype) == values).all()


def test_slots_are_ranges_and_even():
    keys = np.sort(np.random.default_rng(1).integers(0, 2 ** 63, 100_000).astype(np.uint64))
    slot = lm._slot_of(keys, 37)
    assert (np.diff(slot) >= 0).all() and slot[0] == 0 and slot[-1] == 36
    assert np.bincount(slot, minlength=37).min() > 2000


def test_a_chunks_rows_take_fewer_bytes_than_plain_ones(monkeypatch):
    monkeypatch.setattr(lm, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": lambda s: 0})())}))
    texts = _texts(40)
    b = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(40), pa.int64()), "text": texts, "target": pa.array([False] * 40)})
    rows = [r for out in lm._chunks(10)([b]) for r in out.to_pylist()]
    words, at = lm.words(*lm.bytes_of(b.column("text")))[:2]
    keys, code = np.unique(words, return_inverse=True)
    told = [np.cumsum(lm._unplaned([r["keys"]])[:, 0]).view(np.uint64) for r in sorted(rows, key=lambda r: r["slot"]) if r["slot"] >= 0]
    assert set(np.concatenate(told).tolist()) == set(keys.tolist())
    own = next(r for r in rows if r["slot"] == lm.TEXTS)
    places = np.cumsum(lm._unplaned([own["keys"]], kind="<u4")[:, 0], dtype="<u4")
    assert (np.concatenate(told)[places[lm._unplaned([own["codes"]], kind="<u4")[:, 0]]] == words).all()
    # as they were: hashes in slots of their own, places in the slots' order
    slot = (keys & np.uint64(2 ** 63 - 1)) % np.uint64(10)
    order = np.argsort(slot, kind="stable")
    place = np.empty(len(order), "<u4")
    place[order] = np.arange(len(order), dtype="<u4")
    plain_keys = sum(len(lm._planes(keys[order][slot[order] == s].view(np.int64))) for s in range(10))
    assert sum(len(r["keys"]) for r in rows if r["slot"] >= 0) < 0.93 * plain_keys
    assert len(own["codes"]) + len(own["keys"]) < len(lm._planes(place[code]))
