"""Fill-in-middle, exact dedup and prefix trie: brute force and edge cases."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ranksmith.llm import exact_dedup, infill, prefix_trie, scan
from ranksmith.llm.common import bytes_of

SPACE = " \t\n\x0b\x0c\r"
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
CLASH = ("n", "form", "output", "rec", "row", "key", "best", "data", "points", "part", "bucket", "pos", "d", "owner", "_part", "p1",
         "length", "conv", "top", "more")


def clashing(df):
    for c in CLASH:
        df = df.withColumn(c, F.lit("x"))
    return df


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---------------------------------------------------------------- fill-in-middle

TEXTS = ["", None, " ", "one", " one two  three\n", "naïve café 中文 x", "a<P>b c", "x <S> y", "<M>", "\t\n a b\x0b",
         "<P <S <M >", "emoji \U0001f600 words here", "z" * 5000 + " " + "y" * 3, "  lead", "trail  "]


def fim_expected(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    assert "".join(units) == text
    h = sha(f"42:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[k:k + 8], 16) for k in (0, 8, 16, 24))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text, text
    a, z = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(units[i:j]) for i, j in ((0, a), (a, z), (z, n)))
    form = "spm" if h4 % 100 < 80 else "psm"
    return n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}", text


def test_infill_brute_force(spark):
    rnd = random.Random(3)
    rows = [(i * 7 + k, t) for k in range(12) for i, t in enumerate(TEXTS)] + [(None, "a b c"), (5, "a b"), (5, "a b")]
    rows += [(10_000 + i, "".join(rnd.choice(["w" * rnd.randrange(1, 400), " ", "\n", "é", "x"]) for _ in range(rnd.randrange(3000))))
             for i in range(30)]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    out = infill.transform(docs)
    got = out.withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    assert collections.Counter((r.doc_id, *(r[c] for c in ("n", "form", "prefix_chars", "middle_chars", "output", "back")))
                               for r in got) == collections.Counter((i, *fim_expected(i, t)) for i, t in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    dig = {(r.doc_id, r.output_sha256, r.restored_sha256) for r in infill.digests(docs).collect()}
    assert dig == {(r.doc_id, sha(r.output), sha(r.back)) for r in got}
    assert infill.digests(docs.limit(0)).count() == 0


@pytest.mark.parametrize("error", [0, 3, infill.ERROR])
def test_rank_index_is_exact_and_bounded(spark, error):
    rnd = random.Random(error)
    texts = [" ".join("x" * rnd.choice([1, 2, 5, 9, 300 if i % 3 else 4]) for _ in range(rnd.randrange(1, 4000))) for i in range(20)]
    texts += ["", "one", " \n ", "é " * 3000, "w" * 100_000]
    data, off = bytes_of(pa.array(texts))
    y, first = infill.boundaries(data, off)
    for t, a, b, o in zip(texts, first[:-1], first[1:], off[:-1]):
        ends = np.cumsum([0] + [len(u.encode()) for u in UNIT.findall(t)])
        assert (y[a:b] - o).tolist() == ends.tolist()
    index = infill.RankIndex(y, first, error)
    assert (index.offset(np.arange(len(y))) == y).all()
    assert np.abs(index.residual.astype(int)).max(initial=0) <= error + 1
    if error:
        assert len(index.rank) < len(y) / 3 + len(texts)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in infill.rank_index(docs, error).collect():
        ends = np.cumsum([0] + [len(u.encode()) for u in UNIT.findall(texts[r.doc_id])])
        rest = np.frombuffer(r.residuals, np.int8 if error <= infill.ERROR else np.int64)
        for k in range(0, r.n + 1, 37):
            s = [s for s in r.segments if s["rank"] <= k][-1]
            assert s["base"] + int(np.rint(s["slope"] * (k - s["rank"]))) + int(rest[k]) == ends[k]


# ---------------------------------------------------------------- exact dedup

def dedup_expected(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[re.sub(f"[{SPACE}]", "", t or "")].append((i, t or ""))
    out = collections.Counter()
    for norm, members in groups.items():
        best = min(members, key=lambda r: (-len(r[1]), r[0] is not None, r[0] or 0))
        free = 1
        for i, t in members:
            stays = bool(free and i == best[0] and len(t) == len(best[1]))
            free -= stays
            out[i, best[0], len(members), stays, sha(norm)] += 1
    return out


@pytest.mark.parametrize("bits, records, split", [(64, 4096, 6), (64, 2, 3), (3, 2, 2), (0, 2, 6)])
def test_exact_dedup_brute_force(spark, monkeypatch, bits, records, split):
    """Also with colliding hashes (chains) and tiny buckets (splits, shared
    hot values)."""
    rnd = random.Random(bits)
    pool = [" ".join(rnd.choices(["a", "bb", "ccc", "dé", "中"], k=rnd.randrange(0, 7))) for _ in range(120)]
    rows = [(i, rnd.choice(pool).replace(" ", rnd.choice(["", " ", "\n ", " "]))) for i in range(700)]
    rows += [(2000 + i, "hot text of all" + " " * (i % 3)) for i in range(400)]
    rows += [(None, "hot text of all  "), (3000, None), (3001, ""), (3002, " \t"), (3002, " \t"), (3002, "\n\n"), (None, None)]
    rnd.shuffle(rows)
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(40))
    got = exact_dedup.classes(docs, bits, 8 << 20 if records > 100 else 60, records, split)
    cols = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert collections.Counter(tuple(r[c] for c in cols) for r in got.collect()) == dedup_expected(rows)
    assert exact_dedup.classes(docs.limit(0)).count() == 0


def test_directory_splits_overfull_buckets(spark):
    rnd = random.Random(1)
    keys = [(rnd.randrange(-2**63, 2**63), 2, 50) for _ in range(500)] + [(12345, 9000, 10), (2**62 + 1, 2, 5), (2**62 + 2, 2, 5)]
    df = spark.createDataFrame(keys, "key long, recs long, bytes long")
    d = exact_dedup.directory(df, 400, 6, 2)
    held = collections.defaultdict(list)
    for (k, recs, size), b in zip(keys, d.bucket(np.array([k[0] for k in keys]))):
        held[int(b)].append((k, recs, size))
        assert int(d.start[b]) >> (64 - int(d.depth[b])) == (k % 2**64) >> (64 - int(d.depth[b]))
    for b, rows in held.items():
        if len(rows) > 1:
            assert sum(r[1] for r in rows) <= 6 and sum(r[2] for r in rows) <= 400 and d.parts[b] == 1
        else:
            assert d.parts[b] == max(1, -(-rows[0][1] // 6), -(-rows[0][2] // 400))
    assert max(len(rows) for rows in held.values()) > 1 and d.global_depth > 2


# ---------------------------------------------------------------- prefix trie

def trie_expected(rows):
    convs = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in convs.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        built[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members = collections.defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    children = collections.Counter(seq[:-1] for seq in members if seq)
    leaves, saved = collections.Counter(), collections.Counter()
    for seq, m in members.items():
        for d in range(len(seq) + 1):
            saved[seq[:d]] += (len(m) - 1) * (len(seq[-1][1].encode()) if seq else 0)
            leaves[seq[:d]] += not children[seq]
    return sorted((min(m), len(s), min(members[s[:-1]]) if s else None, len(m), children[s], leaves[s], saved[s],
                   sha(",".join(map(str, sorted(c for c in m if len(built[c]) == len(s))))))
                  for s, m in members.items())


TRIE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def trie_rows(df):
    return sorted((tuple(r[c] for c in TRIE) for r in df.collect()), key=lambda r: (r[0], r[1]))


def test_prefix_trie_brute_force(spark):
    rnd = random.Random(8)
    rows = []
    for c in [*range(-12, 260), 2**40, 2**40 + 1]:
        kind = rnd.randrange(4)
        n = rnd.choice([1, 2, 5, 9, 14])
        for t in range(n):
            text = f"common {t}" if kind else f"é {rnd.randrange(2)}"
            rows.append((c, t, "user" if t % 2 else "system", text))
    # long copies, a missing base, ties, nulls, repeated rows
    rows += [(c, t, "user", f"long {t}") for c in (1005, 1010, 1015) for t in range(150)]
    rows += [(1003, 0, "user", "no base"), (1004, None, None, None), (1004, None, "a", "b"), (1004, 0, "x", "y"),
             (1004, 0, "x", "y"), (1004, 0, "x", "a"), (None, 1, "u", "t"), (1001, None, "u", None)]
    rnd.shuffle(rows)
    df = clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7))
    want = trie_expected(rows)
    assert trie_rows(prefix_trie.node_rows(df)) == want
    full = prefix_trie.trie(df).where("depth > 0")
    assert full.count() == len(want) - 1 and not full.where("ref_conv is null or ref_pos is null").count()
    none = df.limit(0)
    assert prefix_trie.node_rows(none).count() == 0
    one = spark.createDataFrame([(7, 0, "u", "t")], "conv_id long, turn long, role string, text string")
    assert trie_rows(prefix_trie.node_rows(one)) == trie_expected([(7, 0, "u", "t")])


def test_prefix_trie_rejects_colliding_hashes(spark):
    """Turns of one hash that differ never become one node."""
    rows = [(c, t, "u", f"{c} {t}") for c in range(20) for t in range(3)]
    turns = prefix_trie.turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    weak = lambda role, text: (len(text) % 2, 5)
    turn_rows = prefix_trie.products(turns, prefix_trie.BASES[0], weak)
    assert turn_rows.select("t1").distinct().count() == 2
    entry = prefix_trie.entries(turn_rows, prefix_trie.plans(turn_rows), prefix_trie.BASES[0])
    assert prefix_trie.nodes(entry)[1]  # the products agree, only the texts differ
    assert not prefix_trie.equal_hashes(turns, turn_rows, weak)
    # products that collide: bases of 1 lose the order of turns
    swapped = spark.createDataFrame([(c, t, "u", str(t ^ (c // 5 % 2))) for c in (0, 5) for t in range(2)],
                                    "conv_id long, turn long, role string, text string")
    turn_rows = prefix_trie.products(prefix_trie.turns(swapped), (1, 1))
    assert not prefix_trie.nodes(prefix_trie.entries(turn_rows, prefix_trie.plans(turn_rows), (1, 1)))[1]


def test_ends_digest_of_many_ids(spark):
    ids = list(range(-3, 20_000, 3))
    df = spark.createDataFrame([(1, 2, 3, i) for i in ids] + [(1, 2, 4, 9)], "d long, p1 long, p2 long, conv long").repartition(5)
    got = {r.p2: r.ends_sha256 for r in prefix_trie.ends_digest(df).collect()}
    assert got == {3: sha(",".join(map(str, ids))), 4: sha("9")}


@pytest.mark.parametrize("base", [1, 0x9E3779B97F4A7C15])
def test_running_products_cross_partitions(spark, base):
    rnd = random.Random(base)
    rows = [(g, i, rnd.randrange(-2**62, 2**62)) for g, n in ((0, 3), (1, 5000), (2, 1), (5, 700), (-4, 2)) for i in range(n)]
    df = spark.createDataFrame(rows, "g long, i long, v long").repartition(9)
    got = {(r.g, r.i): (r.pos, r.x) for r in
           scan.running(df, "g", [F.col("i")], [F.col("i")], ["g", "i"], [("v", "x", base)]).collect()}
    assert len(got) == len(rows)
    for g in {r[0] for r in rows}:
        x = 0
        for k, (_, i, v) in enumerate(sorted(r for r in rows if r[0] == g)):
            x = (x + v * pow(base, k, 2**64)) % 2**64
            assert got[g, i] == (k + 1, x - 2**64 if x >= 2**63 else x)
