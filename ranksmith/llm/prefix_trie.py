"""Prefix trie of rebuilt conversations by composable fingerprints.

A conversation is its turns in order of ``turn`` (null first; equal ones by
role, then text).  Conversation ``c`` is *rebuilt*: the first ``h`` turns of its
base conversation ``c - c % 5``, then its own turns after its first ``h``, with
``h = crc32(decimal c) % 9``.  A node of the trie is a distinct sequence of the
first ``d`` rebuilt turns; its members are the conversations that start with it.

1. Every turn gets two 64-bit hashes.  A sequence's fingerprint is its length
   and, per hash, the sum of ``hash * base ** position`` mod 2^64: a monoid, so
   running products of all conversations come from one distributed scan
   (``scan``), whatever a conversation's length.
2. Rebuilt prefixes are products, never texts: up to the base's head they are
   the base's own running products, beyond it ``head * (own product without
   the own head)``, which the monoid gives from three stored products.
3. Equal (length, products) make a node.  Every prefix refers to its last turn,
   a stored (conv_id, place).  A group is checked through these references: all
   its members must have the same last turn, told apart by role and text, and
   the same parent group.  By induction over depth the sequences are then equal;
   if a check fails, all is done again with other bases.
4. Node sums over subtrees are sums over members.  A node belongs to its
   smallest member; the nodes a conversation owns are the end of its path, so a
   subtree's sum is the owned sums of its members, without the part of the
   owner's that lies above the node (a running sum, again by the scan).

Null role or text is empty.  Rows with a null ``conv_id`` take no part.  A
conversation without a rebuilt turn ends at the root.  Repeated rows are turns
of their own.  An empty table gives no rows (no root); extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .repeats import _cell, bit_filter
from .scan import powers, running

HEAD = 9  # h is below
FAMILY = 5
BASES = [(0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), (0xD6E8FEB86659FD93, 0xA0761D6478BD642F),
         (0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]
IDS_PER_CHUNK = 4096
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
TURNS = "conv_id long, t1 long, t2 long, n_bytes long"
ENTRY = "conv long, d long, p1 long, p2 long, q1 long, q2 long, turn1 long, turn2 long, n_bytes long, ref_conv long, ref_pos long, length long"


def turn_hashes(role: str, text: str) -> tuple[int, int]:
    """Two 64-bit hashes of a turn."""
    key = len(role.encode()).to_bytes(8, "little") + role.encode() + text.encode()
    h = xxhash.xxh3_128_intdigest(key)
    return h & ((1 << 64) - 1), h >> 64


def _hash(hashes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            lanes = _lanes(hashes, b.column("role").to_pylist(), texts)
            yield pa.RecordBatch.from_pydict({
                "conv_id": b.column("conv_id"), "t1": pa.array(lanes[:, 0]), "t2": pa.array(lanes[:, 1]),
                "n_bytes": pa.array([len(t.encode()) for t in texts], pa.int64())})
    return run


def _lanes(hashes, roles: list[str], texts: list[str]) -> np.ndarray:
    return np.array([hashes(r, t) for r, t in zip(roles, texts)], np.uint64).reshape(-1, 2).view(np.int64)


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text), nulls as stated."""
    c = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                             *(F.coalesce(F.col(x).cast("string"), F.lit("")).alias(x) for x in ("role", "text")))
    return c.where("conv_id is not null")


def products(rows: DataFrame, bases: tuple[int, int], hashes=turn_hashes) -> DataFrame:
    """(conv_id, pos, t1, t2, n_bytes, p1, p2): every turn's place, hashes and
    the product of its conversation up to it."""
    first = F.col("turn").asc_nulls_first()
    return stored(running(
        rows, "conv_id", [first, F.substring("role", 1, 32), F.substring("text", 1, 32)], [first, F.col("role"), F.col("text")],
        ["conv_id", "t1", "t2", "n_bytes"], [("t1", "p1", bases[0]), ("t2", "p2", bases[1])], _hash(hashes), TURNS), "trie-turns")


def head_length(conv):
    return F.crc32(conv.cast("string").cast("binary")) % HEAD


def plans(turn_rows: DataFrame) -> DataFrame:
    """How every conversation is rebuilt: conv, h, the base's head (its first
    ``h`` stored turns), the product of the own head left out, and the number
    of rebuilt turns."""
    entry = F.struct("pos", "p1", "p2", "t1", "t2", "n_bytes")
    convs = stored(turn_rows.groupBy("conv_id").agg(
        F.max("pos").alias("size"),
        F.sort_array(F.collect_list(F.when(F.col("pos") < HEAD, entry))).alias("head")), "trie-convs")
    base = convs.select(F.col("conv_id").alias("base"), F.col("head").alias("base_head"))
    c = convs.select(F.col("conv_id").alias("conv"), "size", "head", head_length(F.col("conv_id")).cast("int").alias("h"))
    c = c.withColumn("base", F.col("conv") - F.col("conv") % FAMILY).join(base, "base", "left")
    c = c.withColumn("base_head", F.slice(F.coalesce("base_head", F.array().cast(convs.schema["head"].dataType)), F.lit(1), F.col("h")))
    own = F.element_at("head", F.greatest(F.lit(1), F.least(F.col("h"), F.col("size").cast("int"))))
    own = F.when(F.col("h") > 0, own)
    last = F.when(F.size("base_head") > 0, F.element_at("base_head", -1))
    zero = F.lit(0).cast("long")
    return stored(c.select(
        "conv", "base", "h", "base_head", F.size("base_head").cast("long").alias("m"),
        F.coalesce(last["p1"], zero).alias("b1"), F.coalesce(last["p2"], zero).alias("b2"),
        F.coalesce(own["p1"], zero).alias("o1"), F.coalesce(own["p2"], zero).alias("o2"),
        (F.size("base_head") + F.greatest(F.col("size") - F.col("h"), zero)).alias("length")), "trie-plans")


def _composed(bases: tuple[int, int]):
    """Fingerprint of each rebuilt prefix and of its parent."""
    inverse = [pow(b, -1, 1 << 64) for b in bases]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m, h, pos = (b.column(c).to_numpy().astype(np.int64) for c in ("m", "h", "pos"))
            own = b.column("own").to_numpy(zero_copy_only=False)
            d = np.where(own, m + pos - h, pos)
            out = {"conv": b.column("conv"), "d": pa.array(d)}
            lanes = []
            for k, base in enumerate(bases, 1):
                col = {c: b.column(f"{c}{k}").to_numpy().astype(np.int64).view(np.uint64) for c in ("b", "o", "p", "t")}
                shift = np.where(m >= h, powers(base, np.maximum(m - h, 0)), powers(inverse[k - 1], np.maximum(h - m, 0)))
                p = np.where(own, col["b"] + shift * (col["p"] - col["o"]), col["p"])
                lanes.append((p, p - col["t"] * powers(base, d - 1)))
            for k, (p, q) in enumerate(lanes, 1):
                out[f"p{k}"], out[f"q{k}"] = pa.array(p.view(np.int64)), pa.array(q.view(np.int64))
            out |= {"turn1": b.column("t1"), "turn2": b.column("t2"), "n_bytes": b.column("n_bytes"),
                    "ref_conv": b.column("ref_conv"), "ref_pos": b.column("pos"), "length": b.column("length")}
            order = ("conv", "d", "p1", "p2", "q1", "q2", "turn1", "turn2", "n_bytes", "ref_conv", "ref_pos",
                     "length")
            yield pa.RecordBatch.from_arrays([out[c] for c in order], list(order))
    return run


def entries(turn_rows: DataFrame, plan: DataFrame, bases: tuple[int, int]) -> DataFrame:
    """A row per rebuilt prefix: conversation, depth, fingerprint, the parent's
    fingerprint, and the stored turn it ends with."""
    of_plan = ["conv", "m", "h", "b1", "b2", "o1", "o2", "length"]
    turn = ["pos", "p1", "p2", "t1", "t2", "n_bytes"]
    head = plan.select(*of_plan, F.col("base").alias("ref_conv"), F.explode("base_head").alias("e")).select(
        *of_plan, "ref_conv", *(F.col(f"e.{c}").alias(c) for c in turn), F.lit(False).alias("own"))
    own = turn_rows.withColumnRenamed("conv_id", "conv").join(plan.select(*of_plan), "conv").where("pos > h").select(
        *of_plan, F.col("conv").alias("ref_conv"), *turn, F.lit(True).alias("own"))
    return stored(head.unionByName(own).mapInArrow(_composed(bases), ENTRY), "trie-entries")


def equal_hashes(rows: DataFrame, turn_rows: DataFrame, hashes=turn_hashes) -> bool:
    """Whether turns of equal hashes are equal.  Only hashes that occur more
    than once need their texts, which meet as grouping keys: compared whole,
    copies combined before the shuffle."""
    twice = stored(turn_rows.groupBy("t1").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "trie-twice")
    shared = rows.sparkSession.sparkContext.broadcast(bit_filter(twice, "t1"))
    hashed = rows.mapInArrow(_hash_texts(shared, hashes), "t1 long, t2 long, role string, text string")
    again = hashed.groupBy("t1", "t2", "role", "text").agg(F.count(F.lit(1)).alias("n"))
    return not again.groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()


def _hash_texts(shared, hashes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(shared.value).astype(bool)
        for b in batches:
            lanes = _lanes(hashes, b.column("role").to_pylist(), b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [pa.array(lanes[:, 0]), pa.array(lanes[:, 1]), b.column("role"), b.column("text")],
                ["t1", "t2", "role", "text"]).filter(pa.array(bits[_cell(lanes[:, 0], len(bits))]))
    return run


def nodes(entry_rows: DataFrame) -> tuple[DataFrame, bool]:
    """(nodes without the root, whether the fingerprints stand the check)."""
    checked = [f"{f}({c}) as {f}_{c}" for c in ("turn1", "turn2", "q1", "q2") for f in ("min", "max")]
    n = stored(entry_rows.groupBy("d", "p1", "p2").agg(
        F.min("conv").alias("owner"), F.count(F.lit(1)).alias("n_convs"), F.min("n_bytes").alias("n_bytes"),
        F.count_if(F.col("d") == F.col("length")).alias("n_ends"), F.min(F.struct("ref_conv", "ref_pos")).alias("ref"),
        *(F.expr(c) for c in checked)), "trie-nodes")
    differ = " or ".join(f"min_{c} <> max_{c}" for c in ("turn1", "turn2", "q1", "q2"))
    sound = not n.where(differ).limit(1).count()
    return n.select("d", "p1", "p2", F.col("min_q1").alias("q1"), F.col("min_q2").alias("q2"), "owner", "n_convs",
                    "n_bytes", "n_ends", "ref"), sound


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of ids of one node, joined by commas; rows come in order."""
    for b in batches:
        d, p1, p2, conv = (b.column(c).to_numpy() for c in ("d", "p1", "p2", "conv"))
        if not len(d):
            continue
        cut = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (p1[1:] != p1[:-1]) | (p2[1:] != p2[:-1])])
        cut = sorted({int(x) for c, z in zip(cut, np.r_[cut[1:], len(d)]) for x in range(c, z, IDS_PER_CHUNK)})
        ends = [*cut[1:], len(d)]
        at = pa.array(cut)
        yield pa.RecordBatch.from_arrays(
            [*(b.column(c).take(at) for c in ("d", "p1", "p2", "conv")),
             pa.array([",".join(map(str, conv[i:j].tolist())) for i, j in zip(cut, ends)])],
            ["d", "p1", "p2", "conv", "ids"])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's joined ids, chunk by chunk."""
    at, state, out = None, None, []

    def batch():
        d, p1, p2, h = zip(*out)
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in (d, p1, p2)), pa.array(h)],
                                          ["d", "p1", "p2", "ends_sha256"])
    for b in batches:
        for d, p1, p2, ids in zip(*(b.column(c).to_pylist() for c in ("d", "p1", "p2", "ids"))):
            if at == (d, p1, p2):
                state.update(b"," + ids.encode())
                continue
            if at is not None:
                out.append((*at, state.hexdigest()))
                if len(out) >= 4096:
                    yield batch()
                    out.clear()
            at, state = (d, p1, p2), hashlib.sha256(ids.encode())
    if at is not None:
        out.append((*at, state.hexdigest()))
        yield batch()


def ends_digest(ends: DataFrame) -> DataFrame:
    """(d, p1, p2, ends_sha256) of ``ends`` (d, p1, p2, conv).  Ids are joined
    where ranges of (node, id) lie; one task a node then reads the chunks."""
    node = ["d", "p1", "p2"]
    chunks = ends.repartitionByRange(*node, "conv").sortWithinPartitions(*node, "conv").mapInArrow(
        _joined_ids, "d long, p1 long, p2 long, conv long, ids string")
    return stored(chunks, "trie-chunks").repartition(*node).sortWithinPartitions(*node, "conv").mapInArrow(
        _digest, "d long, p1 long, p2 long, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """A row per node: conv_id (smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256, and the stored
    turn it ends with (ref_conv, ref_pos)."""
    rows = turns(conversations)
    for bases in BASES:
        turn_rows = products(rows, bases)
        plan = plans(turn_rows)
        entry_rows = entries(turn_rows, plan, bases)
        inner, sound = nodes(entry_rows)
        if sound and equal_hashes(rows, turn_rows):
            break
    else:
        raise ValueError("turns of equal hashes differ")
    node = ["d", "p1", "p2"]
    zero = F.lit(0).cast("long")
    root = plan.agg(F.min("conv").alias("owner"), F.count(F.lit(1)).alias("n_convs"),
                    F.count_if(F.col("length") == 0).alias("n_ends")).where("n_convs > 0").select(
        *(zero.alias(c) for c in node), F.lit(None).cast("long").alias("q1"), F.lit(None).cast("long").alias("q2"),
        "owner", "n_convs", zero.alias("n_bytes"), "n_ends", F.lit(None).cast(inner.schema["ref"].dataType).alias("ref"))
    children = inner.groupBy((F.col("d") - 1).alias("d"), F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(
        F.count(F.lit(1)).alias("n_children"))
    full = inner.unionByName(root).join(children, node, "left").withColumn("n_children", F.coalesce("n_children", zero))
    full = stored(full.withColumn("saved", (F.col("n_convs") - 1) * F.col("n_bytes")), "trie-full")

    # what each conversation owns: its nodes' sum and, at most, one leaf
    owned = stored(full.groupBy("owner").agg(F.sum("saved").alias("all_saved"), F.count_if(F.col("n_children") == 0).alias("leaf"))
                   .where("all_saved > 0 or leaf > 0"), "trie-owned").withColumnRenamed("owner", "conv")
    members = entry_rows.select("conv", *node).join(owned, "conv").groupBy(*node).agg(
        F.sum("all_saved").alias("members_saved"), F.sum("leaf").alias("n_leaves"))
    total = owned.agg(F.sum("all_saved").alias("members_saved"), F.sum("leaf").alias("n_leaves")).select(
        *(zero.alias(c) for c in node), "members_saved", "n_leaves").where("n_leaves is not null")
    # of a shared node's owner, the part above the node
    shared = full.where("n_convs > 1").select("owner", "d", "p1", "p2", "saved")
    above = running(shared, "owner", [F.col("d")], [F.col("d")], ["owner", "d", "p1", "p2", "saved"],
                    [("saved", "upto", 1)]).select(*node, (F.col("upto") - F.col("saved")).alias("above"))
    sums = members.unionByName(total).join(above, node, "left").select(
        *node, "n_leaves", (F.col("members_saved") - F.coalesce("above", zero)).alias("subtree_saved"))

    ends = entry_rows.where("d = length").select(*node, "conv")
    several = full.where("n_ends > 1").select(*node)
    ends = ends.unionByName(plan.where("length = 0").select(*(zero.alias(c) for c in node), "conv"))
    marked = ends_digest(ends.join(several, node, "left_semi")).unionByName(
        ends.join(full.where("n_ends = 1").select(*node), node, "left_semi").select(
            *node, F.sha2(F.col("conv").cast("string").cast("binary"), 256).alias("ends_sha256")))

    up = full.where("d > 0 and n_children > 0").select(
        (F.col("d") + 1).alias("d"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("owner").alias("up"))
    first = full.agg(F.min("owner").alias("first")).scalar()  # the root's owner
    out = full.join(sums, node).join(marked, node, "left").join(up, ["d", "q1", "q2"], "left")
    return out.select(
        F.col("owner").alias("conv_id"), F.col("d").alias("depth"),
        F.when(F.col("d") == 1, first).otherwise(F.col("up")).alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        F.when(F.col("n_convs") == 1, zero).otherwise(F.col("subtree_saved")).alias("saved_tokens"),
         F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"),
        F.col("ref.ref_conv").alias("ref_conv"), F.col("ref.ref_pos").alias("ref_pos"))


def node_rows(conversations: DataFrame) -> DataFrame:
    """The nodes without their references."""
    return trie(conversations).drop("ref_conv", "ref_pos")
