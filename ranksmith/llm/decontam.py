"""Benchmark decontamination by canonical templates.

A text becomes a template: its words, without outer punctuation and in lower
case, where numbers, units and names are replaced by typed placeholders.  A
name is a capitalised word that neither begins a sentence nor stands in a run
of capitals.  Windows of ``WINDOW`` template words are hashed and hash-joined
with the items' windows, and so are the windows of the plain words, whose
casing may differ from the item's.  A second template of each text, the wide
one, takes a capitalised word that begins a sentence for a name as well, and a
run of names, or of numbers, for one placeholder; its windows are joined with
those of the items' wide templates.

For every document and item the joined windows are aligned (equal distance
between their places); the best alignment, or else alignments that follow each
other in order within ``SPAN`` times the item's length, must cover
``COVERAGE`` of the item's windows.  Then the slots are checked: along the
alignment, equal fillers of the item must have equal fillers in the document,
and different names of the item different names there (different numbers may
well become the same).  So a question whose numbers, names or units were
exchanged is caught, and a text that has its shape with fillers that do not
correspond is not.

Words end at any white space, no-break spaces included.  A text written without
spaces has few, very long words: an item with ``LONG_WORDS`` letters a word, and
``CHARS + 8`` letters at least, is also indexed by windows of ``CHARS`` letters
(marks of punctuation and white space left out, a run of digits as one
placeholder), which are joined with those of documents that hold such writing.

An item of fewer than ``WINDOW`` words that is not written so is too short to
tell from chance; it is found only as a whole document.  Items without words
match nothing, nor do
null and empty texts; repeated rows are reported alike; empty tables give no
rows; extra columns are ignored.

The items' windows are sent to the tasks in slices of ``SLICE_ITEMS`` items,
one pass over the documents for each, so their size is bounded for any number
of items.  A task makes the templates of ``SLICE_BYTES`` of texts as columns
and looks all their windows up at once; only texts that share a window with
an item (or have too few words for one, or hold writing without spaces) are
taken up one by one.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, slices, sole_memo

WINDOW = 5
COVERAGE = 0.8
SPAN = 1.5
SLICE_ITEMS = 50_000
SLICE_BYTES = 2 << 20
CHARS, LONG_WORDS = 8, 12
MEMO_ENTRIES = 400_000

# fixed values: spellings of units of measure, time and money
UNITS = frozenset("""mm cm m km in ft yd mi mg g kg t lb lbs oz ml cl dl l s sec secs min mins h hr hrs
day days week weeks month months year years second seconds minute minutes hour hours metre metres meter
meters kilometre kilometres kilometer kilometers centimetre centimetres centimeter centimeters inch inches
foot feet yard yards mile miles gram grams kilogram kilograms kilo kilos pound pounds ounce ounces litre
litres liter liters gallon gallons dollar dollars cent cents euro euros percent degree degrees celsius
fahrenheit km/h mph usd eur gbp""".split())
# fixed values: number words
NUMBER_WORDS = frozenset("""zero one two three four five six seven eight nine ten eleven twelve thirteen
fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety
hundred thousand million billion""".split())

_NUMBER = re.compile(r"[+\-$€£]?\d[\d.,:/]*(?:%|st|nd|rd|th)?\Z")
_OUTER = "\"'`.,;:!?()[]{}<>*#%$&|~_=+-/\\“”‘’«»¿¡…–—"
_CLOSERS = "\"'`)]}>”’»*#%$&|~_"
# marks of a word, kept below its hash
ENDS, CAPITAL, LOWER, NUM, UNIT = 1, 2, 4, 8, 16
NUMBER, MEASURE, NAME, FIRST = 1, 2, 3, 4  # slot types; FIRST: a name in the wide template only
SLOT_IDS = np.array([0, 0x1F3A5C71, 0x2B4D6E83, 0x3C5F7A95], np.uint64)
FILTER_BITS = 24
_MEMO: dict[str, int] = {}


def bare(word: str) -> str:
    return word.strip(_OUTER).lower()


def _coded(word: str) -> int:
    """59 bits of hash of the bare word (0: punctuation only) and its marks."""
    core = word.strip(_OUTER)
    code = ENDS if word.rstrip().rstrip(_CLOSERS)[-1:] in (".", "!", "?", ":") or word.endswith("\n") else 0
    if not core:
        return code
    low = core.lower()
    if low in NUMBER_WORDS or not low[-1].isalpha() and _NUMBER.match(core) or core[0].isdigit() \
            and _NUMBER.match(core):
        code |= NUM
    elif low in UNITS:
        code |= UNIT
    else:
        code |= (CAPITAL if core[0].isupper() else 0) | (LOWER if core != core.upper() else 0)
    return (xxhash.xxh64_intdigest(low) >> 5 | 1) << 5 | code


# scripts written without spaces between words, and very long words
_DENSE = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]|\\S{64}")
_SPACES = re.compile("[^\\S \n\t\r]")
_OTHER_SPACES = [c for c in map(chr, range(0x80, 0x3001)) if c.isspace()]


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """0 for code points that are left out, 2 for digits, 1 for the others."""
    kind = {"L": 1, "M": 1, "N": 1}
    return np.fromiter((2 if (c := unicodedata.category(chr(i))) == "Nd" else kind.get(c[0], 0) for i in range(0x110000)),
                       np.uint8, 0x110000)


def letters(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, str]:
    """(hash per place, slot type, first letter of each place and the end, the
    letters) of a text's letters; a run of digits is one place."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    kind = _kinds()[codes]
    codes, kind = codes[kind > 0], kind[kind > 0]
    at = np.flatnonzero(np.r_[True, (kind[1:] != 2) | (kind[:-1] != 2)][:len(kind)])
    slot = np.where(kind[at] == 2, NUMBER, 0).astype(np.uint8)
    ids = np.where(slot > 0, SLOT_IDS[slot], mix64(codes[at].astype(np.uint64) + np.uint64(1 << 32)))
    return ids, slot, np.r_[at, len(codes)], codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def _cut(text: str) -> str:
    """The text with a blank wherever a word ends; line ends stay with their word."""
    if not text.isascii() and any(c in text for c in _OTHER_SPACES):
        text = _SPACES.sub(" ", text)
    return text.replace("\n", "\n ").replace("\t", " ").replace("\r", " ")


def _codes(words: list[str]) -> np.ndarray:
    memo = _MEMO
    got = list(map(memo.get, words))
    if None in got:
        full = len(memo) >= MEMO_ENTRIES
        for i, g in enumerate(got):
            if g is None:
                got[i] = code = _coded(words[i])
                if not full:
                    memo[words[i]] = code
    return np.fromiter(got, np.uint64, len(got))


def _slots_of(codes: np.ndarray, ends: np.ndarray, at: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Slot types of the words at ``at``; ``codes`` are theirs, ``ends`` counts
    the sentence ends of all words, ``first`` marks the first words of texts
    (and, one place more, the end)."""
    before = np.concatenate([[0], ends])[at]  # sentence ends up to the word before
    starts = first[:-1].copy()
    starts[1:] |= before[1:] > before[:-1]
    marks = (codes & np.uint64(31)).astype(np.uint8)
    cap = (marks & CAPITAL) > 0
    loud = cap & ((marks & LOWER) == 0)
    pair = loud[1:] & loud[:-1] & ~first[1:-1]
    run = np.zeros(len(loud), bool)
    run[1:] |= pair
    run[:-1] |= pair
    slot = np.where(cap & ~run, np.where(starts, np.uint8(FIRST), np.uint8(NAME)), np.uint8(0))
    slot[(marks & UNIT) > 0] = MEASURE
    slot[(marks & NUM) > 0] = NUMBER
    return slot


def template(text: str) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(hash per word, slot type per word, the words) of a text; the slot
    types are 0, ``NUMBER``, ``MEASURE``, ``NAME`` and ``FIRST``."""
    words = _cut(text).split(" ")
    codes = _codes(words)
    ends = np.cumsum(codes & np.uint64(ENDS)).astype(np.int64)
    at = np.flatnonzero(codes >> np.uint64(5))
    if not len(at):
        return codes[:0], np.zeros(0, np.uint8), []
    codes = codes[at]
    first = np.zeros(len(at) + 1, bool)
    first[[0, -1]] = True
    return codes >> np.uint64(5), _slots_of(codes, ends, at, first), [words[i] for i in at] if len(at) < len(words) else words


def templates(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash per word, slot type per word, first word of each text and the
    end) of several texts, each as ``template`` has it."""
    split = pc.split_pattern(pa.array([_cut(t or "") for t in texts], pa.string()), " ")
    off = np.asarray(split.offsets).astype(np.int64)
    coded = split.values.slice(off[0], off[-1] - off[0]).dictionary_encode()
    codes = _codes(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)]
    ends = np.cumsum(codes & np.uint64(ENDS)).astype(np.int64)
    at = np.flatnonzero(codes >> np.uint64(5))
    cut = np.searchsorted(at, off - off[0])
    codes = codes[at]
    first = np.zeros(len(at) + 1, bool)
    first[cut] = True
    return codes >> np.uint64(5), _slots_of(codes, ends, at, first), cut


def windows(ids: np.ndarray, size: int = WINDOW, kind: int = 0) -> np.ndarray:
    """Hash of each run of ``size`` words; each kind has its own hashes."""
    n = len(ids) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, size + (kind << 32), np.uint64)
    for k in range(size):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += ids[k:n + k]
    return mix64(h)


def both_windows(ids: np.ndarray, slot: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, hashes) of the template windows, and of the plain ones that
    hold a slot."""
    own = windows(np.where(slot > 0, SLOT_IDS[slot], ids))
    slots = np.r_[0, np.cumsum(slot > 0)]
    held = np.flatnonzero(slots[WINDOW:] > slots[:-WINDOW]) if len(own) else np.zeros(0, np.int64)
    return [(np.arange(len(own)), own)] + ([(held, windows(ids)[held])] if len(held) else [])


def narrow(slot: np.ndarray) -> np.ndarray:
    return np.where(slot == FIRST, 0, slot)


def wide(ids: np.ndarray, slot: np.ndarray, cut: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash per place, slot type, first words and the end) of the wide
    template; a run of names or numbers is one place.  A word that begins a
    sentence belongs to the run behind it if both words are one elsewhere.
    ``cut``: first word of each text and the end, if there are several."""
    same = (slot[1:] == slot[:-1]) & ((slot[1:] == NAME) | (slot[1:] == NUMBER))
    lead = (slot[:-1] == FIRST) & (slot[1:] == NAME)
    if cut is not None:
        edge = cut[(cut > 0) & (cut < len(slot))] - 1
        same[edge] = lead[edge] = False
    lead = np.flatnonzero(lead)
    if len(lead):
        names = np.flatnonzero(same & (slot[1:] == NAME))

        def two(k: np.ndarray) -> np.ndarray:
            h = ids[k] * np.uint64(0x9E3779B97F4A7C15) + ids[k + 1]
            return h if cut is None else mix64(h + mix64(np.searchsorted(cut, k, side="right").astype(np.uint64)))
        same[lead] = np.isin(two(lead), two(names))
    slot = np.minimum(slot, NAME)
    at = np.flatnonzero(np.concatenate([[True], ~same])) if len(slot) else np.zeros(0, np.int64)
    return np.where(slot > 0, SLOT_IDS[slot], ids)[at], slot[at], np.append(at, len(ids))


def chain(pos: np.ndarray, place: np.ndarray) -> list[tuple[int, int]]:
    """The longest run of (pos, place) that grows in both."""
    order = np.lexsort((-place, pos))
    tops, ends, back = [], [], np.full(len(order), -1)
    for i, o in enumerate(order):
        at = bisect_left(tops, place[o])
        back[i] = ends[at - 1] if at else -1
        tops[at:at + 1], ends[at:at + 1] = [place[o]], [i]
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append((int(pos[order[i]]), int(place[order[i]])))
        i = back[i]
    return out[::-1]


class Items:
    """Benchmark items with an index of their windows; each is there as its
    template and as its wide one."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids, self.words, self.slots, self.n, self.wide, self.dense = [], [], [], [], [], []
        keys, where, place, self.short = [], [], [], {}

        def entry(item, words, slot, n, is_wide, found, dense=False):
            k = len(self.ids)
            for store, value in ((self.ids, item), (self.words, words), (self.slots, slot), (self.n, n),
                                 (self.wide, is_wide), (self.dense, dense)):
                store.append(value)
            for at, w in found:
                keys.append(w)
                where.append(np.full(len(w), k))
                place.append(at)
            return k

        for item, text in rows:
            h, full, words = template(text)
            if not len(h):
                continue
            slot, words = narrow(full), [bare(w) for w in words]
            n = len(h) - WINDOW + 1
            if len(text) >= max(CHARS + 8, LONG_WORDS * len(h)):
                ids, held, cut, chars = letters(text)
                found = windows(ids, CHARS, 2)
                if len(ids) >= max(CHARS + 8, LONG_WORDS * len(h)):
                    entry(item, [" ".join(chars[lo:hi]) for lo, hi in zip(cut[:-1], cut[1:])], held, len(found), False,
                          [(np.arange(len(found)), found)], True)
            if n <= 0:
                k = entry(item, words, slot, 1, False, [])
                canon = np.where(slot > 0, SLOT_IDS[slot], h)
                self.short.setdefault(int(windows(canon, len(h))[0]), []).append(k)
                continue
            entry(item, words, slot, n, False, both_windows(h, slot))
            ids, slot, cut = wide(h, full)
            found = windows(ids, kind=1)
            if len(found) and (full > 0).any():
                words = [" ".join(words[lo:hi]) for lo, hi in zip(cut[:-1], cut[1:])]
                entry(item, words, slot, len(found), True, [(np.arange(len(found)), found)])
        keys = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.item = np.concatenate(where)[order] if where else order
        self.place = np.concatenate(place)[order] if place else order
        self.uniq, self.first, self.times = np.unique(self.keys, return_index=True, return_counts=True)
        # leading bits that any window has: most lookups end here
        bits = min(FILTER_BITS, len(self.uniq).bit_length() + 4)
        self.shift = np.uint64(64 - bits)
        self.leads = np.zeros(1 << bits, bool)
        self.leads[self.uniq >> self.shift] = True
        self.any_dense = True in self.dense

    def sharing(self, texts: list[str | None]) -> np.ndarray:
        """Places of the texts that can hold an item: those that share a
        window with one, and those that need another look than windows."""
        ids, full, cut = templates(texts)
        n = np.diff(cut)
        out = (n > 0) & (n < WINDOW) if self.short else np.zeros(len(texts), bool)
        if not len(self.uniq):
            return np.flatnonzero(out)
        if self.any_dense:
            out |= np.fromiter((bool(t and _DENSE.search(t)) for t in texts), bool, len(texts))
        own, _, at = wide(ids, full, cut)
        for found, ends in ((both_windows(ids, narrow(full)), cut),
                            ([(None, windows(own, kind=1))], np.searchsorted(at, cut))):
            for places, h in found:
                near = np.flatnonzero(self.leads[h >> self.shift])
                near = near[self._known(h[near])[1]]
                start = near if places is None else places[near]
                of = np.searchsorted(ends, start, side="right") - 1
                out[of[start + WINDOW <= ends[of + 1]]] = True
        return np.flatnonzero(out)

    def _known(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``uniq``, whether it is there) of each hash."""
        at = np.minimum(np.searchsorted(self.uniq, h), len(self.uniq) - 1)
        return at, self.uniq[at] == h

    def matches(self, text: str | None) -> Iterator[tuple[int, int, int, int, bool]]:
        """(item id, windows matched, windows, slots exchanged, exact) of the
        items that ``text`` holds."""
        if not text:
            return
        ids, full, words = template(text)
        if not len(ids):
            return
        slot = narrow(full)
        given: set = set()
        if len(ids) < WINDOW and self.short:
            canon = np.where(slot > 0, SLOT_IDS[slot], ids)
            for k in self.short.get(int(windows(canon, len(ids))[0]), ()):
                got = self._slots(k, np.arange(len(ids)), np.arange(len(ids) + 1), words)
                if got is not None and self.ids[k] not in given:
                    given.add(self.ids[k])
                    yield self.ids[k], 1, 1, got, got == 0
        if not len(self.uniq):
            return
        if self.any_dense and _DENSE.search(text):
            of = letters(text)
            found = windows(of[0], CHARS, 2)
            if len(found):
                yield from self._held([(np.arange(len(found)), found)], CHARS, of, of, of[3], given)
        if len(ids) >= WINDOW:
            own = wide(ids, full)
            spread = windows(own[0], kind=1)
            each = (ids, slot, np.arange(len(ids) + 1))
            yield from self._held([*both_windows(ids, slot), (np.arange(len(spread)), spread)], WINDOW, each, own, words, given)

    def _held(self, found_windows, size: int, plain: tuple, own: tuple, words, given: set
              ) -> Iterator[tuple[int, int, int, int, bool]]:
        """Items whose windows of ``size`` places are among those of a text;
        ``plain`` and ``own`` are its templates, ``given`` the items found."""
        docs_at, hits = [], []
        for places, h in found_windows:
            near = np.flatnonzero(self.leads[h >> self.shift])
            h = h[near]
            at, known = self._known(h)
            found = np.flatnonzero(known)
            docs_at.append(places[near[found]])
            hits.append(at[found])
        pos, hit = np.concatenate(docs_at), np.concatenate(hits)
        if not len(pos):
            return
        times = self.times[hit]
        entry = np.repeat(self.first[hit] - np.r_[0, np.cumsum(times)[:-1]], times) + np.arange(times.sum())
        item, place, pos = self.item[entry], self.place[entry], np.repeat(pos, times)
        # one row per item, alignment and window
        row = np.unique(np.stack([item, pos - place, place]), axis=1)
        of = np.flatnonzero(np.r_[True, np.diff(row[0]) != 0])
        for lo, hi in zip(of, np.r_[of[1:], row.shape[1]]):
            k = int(row[0][lo])
            if self.ids[k] in given:
                continue
            need = COVERAGE * self.n[k] - 1e-9
            if hi - lo < need:
                continue
            cut = own[2] if self.wide[k] else plain[2]
            for pairs in self._aligned(k, row[1][lo:hi] + row[2][lo:hi], row[2][lo:hi], need):
                to = np.full(len(self.words[k]), -1)
                for q, p in pairs:
                    fresh = to[p:p + size] < 0
                    to[p:p + size][fresh] = np.arange(q, q + size)[fresh]
                got = self._slots(k, to, cut, words)
                if got is not None:
                    given.add(self.ids[k])
                    yield self.ids[k], len(pairs), self.n[k], got, got == 0 and len(pairs) == self.n[k] and (
                        pairs[-1][0] - pairs[0][0] == pairs[-1][1] - pairs[0][1])
                    break

    def _aligned(self, k: int, pos: np.ndarray, place: np.ndarray, need: float) -> Iterator[list[tuple[int, int]]]:
        """Windows (place in the document, in the item) that lie in order and
        are enough: single alignments, the best first, then several."""
        shift = pos - place
        order = np.lexsort((place, shift))
        new = np.flatnonzero(np.r_[True, np.diff(shift[order]) != 0])
        size = np.diff(np.r_[new, len(order)])
        for a in np.argsort(-size, kind="stable"):
            if size[a] < need:
                break
            at = order[new[a]:new[a] + size[a]]
            yield list(zip(pos[at].tolist(), place[at].tolist()))
        if len(new) < 2:
            return
        order = np.argsort(pos, kind="stable")
        pos, place = pos[order], place[order]
        ends = np.searchsorted(pos, pos + int(SPAN * len(self.words[k])) + WINDOW)
        past = -1
        for i in np.flatnonzero((ends - np.arange(len(pos)) >= need) & np.r_[True, pos[1:] > pos[:-1]]):
            if pos[i] <= past or len(np.unique(place[i:ends[i]])) < need:
                continue
            got = chain(pos[i:ends[i]], place[i:ends[i]])
            if len(got) >= need:
                yield got
                past = got[0][0]

    def _slots(self, k: int, to_place: np.ndarray, cut: np.ndarray, words: list[str]) -> int | None:
        """Slots whose filler differs; None if the fillers do not correspond
        (names: one to one).  ``to_place``: the document's place of each of the item's
        (-1: none); ``cut``: the first word of each place."""
        to: dict = {}
        back: dict = {}
        changed = 0
        for p in np.flatnonzero((to_place >= 0) & (self.slots[k] > 0)):
            q = to_place[p]
            kind, mine = int(self.slots[k][p]), self.words[k][p]
            other = " ".join(bare(w) for w in words[cut[q]:cut[q + 1]])
            if to.setdefault((kind, mine), other) != other:
                return None
            if kind == NAME and back.setdefault(other, mine) != mine:
                return None
            changed += mine != other
        return changed


def _slices_of(items: DataFrame) -> Iterator[Items]:
    """The items' index, ``SLICE_ITEMS`` items or so at a time."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")) \
        .where("text is not null and item_id is not null").distinct()
    parts = max(1, -(-rows.count() // SLICE_ITEMS))
    for k in range(parts):
        own = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k)
        yield Items(sorted(tuple(r) for r in own.collect()))


def find(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per document and item it holds: doc_id, item_id, n_matched and
    n_windows, n_changed (slots with another filler), verbatim."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def one(index: Items) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sole_memo(_MEMO.clear)
            index = shared.value
            for b in slices(batches, "text", SLICE_BYTES):
                texts = b.column("text").to_pylist()
                rows = [(b.column("doc_id")[k].as_py(), *m) for k in index.sharing(texts).tolist()
                        for m in index.matches(texts[k])]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)],
                                                     ["doc_id", "item_id", "n_matched", "n_windows", "n_changed",
                                                      "verbatim"])
        return d.mapInArrow(run, "doc_id long, item_id long, n_matched long, n_windows long, n_changed long, "
                                 "verbatim boolean")

    out = [one(index) for index in _slices_of(items)]
    for more in out[1:]:
        out[0] = out[0].unionAll(more)
    return out[0]


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Rows of ``docs`` (all columns) that hold no item."""
    for index in _slices_of(items):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            sole_memo(_MEMO.clear)
            index = shared.value
            for b in slices(batches, "text", SLICE_BYTES):
                texts = b.column("text").to_pylist()
                keep = np.ones(len(texts), bool)
                for k in index.sharing(texts).tolist():
                    keep[k] = next(index.matches(texts[k]), None) is None
                yield b.filter(pa.array(keep))
        docs = docs.mapInArrow(run, docs.schema)
    return docs
