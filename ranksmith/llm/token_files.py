"""Token-ID output: flat unsigned-integer files with 64-bit document offsets.

``write`` encodes whole texts and leaves, per range partition of ``doc_id``,

* ``part-NNNNN.bin``: the token ids, little-endian uint16 where the vocabulary
  fits (else uint32), nothing between the documents;
* ``part-NNNNN.idx``: a 32-byte header (``RSTOK001``, item size, documents,
  tokens), ``n`` int64 doc ids, ``n`` uint8 null marks of the doc ids and
  ``n + 1`` uint64 offsets into the ``.bin`` file (in ids).

The partitions follow each other in ``doc_id`` order; the base of each is the
prefix sum of the token counts before it, so a global position is
``base + offset``.  ``read_back`` maps the files into memory again.

Null text counts as empty (only the end id).  Null doc ids come first; rows
of one doc id are ordered by a hash of their texts (so an id of very many rows
is spread, too).  An empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_folder, slices, sole_memo

MAGIC = b"RSTOK001"
MEMO_ENTRIES = 700_000
_TAIL = ".,;:!?*#$%&|"
# white space other than the space and the line feed
_OTHER_SPACE = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
_ENCODERS: dict = {}


def _has_runs(t: str) -> bool:
    """White space next to white space or at an end, or of another kind."""
    return ("  " in t or " \n" in t or "\n " in t or "\n\n" in t or t[:1].isspace() or t[-1:].isspace()
            or any(c in t for c in _OTHER_SPACE))


class MemoEncoder:
    """The tokenizers library behind a memo of its results.

    The byte-level vocabulary splits a text into pieces first, and a single
    space or line feed between two other characters always begins a piece.
    Between such places the ids do not depend on each other, and neither do
    those of a word and of the punctuation after it, so they are encoded once
    per distinct chunk.  A text with longer runs of white space, or other
    kinds of it, goes to the library whole.  The memos stop growing at ``entries``.
    """

    def __init__(self, path: str, specials_are_text: bool, entries: int = MEMO_ENTRIES):
        from tokenizers import Tokenizer
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = specials_are_text
        kind = str(self.tok.pre_tokenizer)
        self.chunks = kind.startswith("ByteLevel(") and "add_prefix_space=False" in kind \
            and "use_regex=True" in kind and self.tok.normalizer is None
        wide = self.tok.get_vocab_size(with_added_tokens=True) > 1 << 16
        self.dtype = np.dtype("<u4" if wide else "<u2")
        self.entries = entries
        self.memo: dict[str, bytes] = {}  # after a space
        self.plain: dict[str, bytes] = {}  # without one
        self.space = np.zeros(self.tok.get_vocab_size(with_added_tokens=True), bool)
        self.space[[i for t, i in self.tok.get_vocab().items() if t.startswith("\u0120")]] = True

    def forget(self) -> None:
        """Another operator has the worker: the memos go, and the vocabulary."""
        self.memo.clear()
        self.plain.clear()
        _ENCODERS.clear()

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.dtype).tobytes()
                for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _spaced(self, words: list[str]) -> list[bytes]:
        """Ids of each word with a space before it, from one text of them all."""
        ids = np.array(self.tok.encode(" " + " ".join(words), add_special_tokens=False).ids, dtype=self.dtype)
        at = np.flatnonzero(self.space[ids])
        if len(at) != len(words):
            return self._library([" " + w for w in words])
        data, w = ids.tobytes(), self.dtype.itemsize
        ends = (np.r_[at, len(ids)] * w).tolist()
        return [data[a:b] for a, b in zip(ends[:-1], ends[1:])]

    def _look_up(self, lost: dict[str, bytes]) -> None:
        """Fill in the ids of chunks that the memo lacks: words after a space,
        or (with a line feed before them) at a line's begin."""
        stems, plain = {}, {}
        for k in lost:
            core = k.rstrip(_TAIL)
            if k[:1] == "\n":
                plain[k] = None
            elif len(core) < len(k) and core.isalpha():
                plain[k[len(core):]] = stems[core] = None
            else:
                stems[k] = None
        new = [k for k in stems if k not in self.memo]
        stems = dict(zip(new, self._spaced(new))) if new else {}
        new = [k for k in plain if k not in self.plain]
        plain = dict(zip(new, self._library(new))) if new else {}
        for k in lost:
            core = k.rstrip(_TAIL)
            if k[:1] == "\n":
                lost[k] = plain.get(k) or self.plain[k]
            elif len(core) < len(k) and core.isalpha():
                tail = k[len(core):]
                lost[k] = (stems.get(core) or self.memo[core]) + (plain.get(tail) or self.plain[tail])
            else:
                lost[k] = stems.get(k) or self.memo[k]
        for memo, made in ((self.memo, stems), (self.plain, plain), (self.memo, lost)):
            if len(memo) < self.entries:
                memo.update((k, v) for k, v in made.items() if len(k) < 64)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as bytes."""
        out: list = [None] * len(texts)
        whole, lost, heads = [], {}, []
        get = self.memo.get
        for i, t in enumerate(texts):
            if not self.chunks or _has_runs(t):
                whole.append(i)
                continue
            keys = t.replace("\n", " \n").split(" ")
            heads.append((i, keys[0]))
            del keys[0]
            got = list(map(get, keys))
            gaps = [j for j, v in enumerate(got) if v is None] if None in got else ()
            for j in gaps:
                lost[keys[j]] = None
            out[i] = (keys, got, gaps)
        if lost:
            self._look_up(lost)
        for (i, _), head in zip(heads, self._library([h for _, h in heads])):
            keys, got, gaps = out[i]
            for j in gaps:
                got[j] = lost[keys[j]]
            out[i] = head + b"".join(got)
        for i, data in zip(whole, self._library([texts[i] for i in whole])):
            out[i] = data
        return out


def encoder(path: str, specials_are_text: bool = True, entries: int = MEMO_ENTRIES) -> MemoEncoder:
    """One encoder per Python worker and vocabulary file."""
    key = (path, specials_are_text, entries)
    if key not in _ENCODERS:
        _ENCODERS[key] = MemoEncoder(*key)
    return _ENCODERS[key]


class Folder:
    """The output folder: a plain path, or a URI that pyarrow can open."""

    def __init__(self, uri: str):
        parsed = urlparse(uri)
        self.local = parsed.scheme in ("", "file")
        self.path = parsed.path if self.local else uri
        if not self.local:
            from pyarrow import fs
            self.fs, self.path = fs.FileSystem.from_uri(uri)

    def writer(self, name: str):
        if self.local:
            os.makedirs(self.path, exist_ok=True)
            return open(f"{self.path}/{name}", "wb", buffering=1 << 20)
        self.fs.create_dir(self.path, recursive=True)
        return self.fs.open_output_stream(f"{self.path}/{name}")

    def publish(self, made: str, name: str) -> None:
        if self.local:
            os.replace(f"{self.path}/{made}", f"{self.path}/{name}")
        else:
            self.fs.move(f"{self.path}/{made}", f"{self.path}/{name}")

    def array(self, name: str, dtype, count: int, offset: int = 0) -> np.ndarray:
        """Part of a file as an array; mapped into memory if it is local."""
        if not count:
            return np.zeros(0, dtype)
        if self.local:
            return np.memmap(f"{self.path}/{name}", dtype=dtype, mode="r", offset=offset, shape=(count,))
        with self.fs.open_input_file(f"{self.path}/{name}") as f:
            return np.frombuffer(f.read_at(count * np.dtype(dtype).itemsize, offset), dtype=dtype)


def _write_part(uri: str, path: str, end_id: int, specials_are_text: bool, entries: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, out = encoder(path, specials_are_text, entries), Folder(uri)
        sole_memo(enc.forget)
        part = TaskContext.get().partitionId()
        end = np.array([end_id], dtype=enc.dtype).tobytes()
        # each attempt writes files of its own; the last rename wins whole
        mark = uuid.uuid4().hex
        ids, nulls, sizes, total = [], [], [], 0
        bin_file = None
        for b in slices(batches, "text", 2 << 20):
            if bin_file is None:
                bin_file = out.writer(f".{mark}.bin")
            col = b.column("doc_id")
            nulls.append(np.asarray(col.is_null()).astype(np.uint8))
            ids.append(np.asarray(col.fill_null(0)).astype("<i8"))
            texts = [t or "" for t in b.column("text").to_pylist()]
            for lo in range(0, len(texts), 256):
                for data in enc.encode(texts[lo:lo + 256]):
                    bin_file.write(data + end)
                    sizes.append(len(data) // enc.dtype.itemsize + 1)
        if bin_file is None:
            return
        bin_file.close()
        offsets = np.zeros(len(sizes) + 1, "<u8")
        np.cumsum(np.array(sizes, "<u8"), out=offsets[1:])
        total = int(offsets[-1])
        with out.writer(f".{mark}.idx") as f:
            f.write(MAGIC + np.array([enc.dtype.itemsize, len(sizes), total], "<u8").tobytes())
            for a in (np.concatenate(ids), np.concatenate(nulls), offsets):
                f.write(a.tobytes())
        for ext in ("bin", "idx"):
            out.publish(f".{mark}.{ext}", f"part-{part:05d}.{ext}")
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()),
                                          "n_docs": pa.array([len(sizes)], pa.int64()),
                                          "n_tokens": pa.array([total], pa.int64())})
    return run


def write(docs: DataFrame, uri: str, tokenizer: str, end_id: int = 2,
          specials_are_text: bool = True, memo_entries: int = MEMO_ENTRIES) -> list[tuple[int, int, int, int]]:
    """Encode ``docs`` (doc_id, text) into token files below ``uri``.

    Returns (partition, documents, tokens, base) per file, one small row per
    partition; a literal special-token string in a text is ordinary text
    unless ``specials_are_text`` is off.  ``memo_entries`` bounds the memory of
    a worker's memo, and with it what is encoded again.
    """
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .repartitionByRange("doc_id", F.xxhash64("text"))
            .sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
            .mapInArrow(_write_part(uri, tokenizer, end_id, specials_are_text, memo_entries),
                        "part int, n_docs long, n_tokens long").collect())
    parts, base = [], 0
    for r in sorted(rows, key=lambda r: r.part):
        parts.append((r.part, r.n_docs, r.n_tokens, base))
        base += r.n_tokens
    return parts


def _read_part(uri: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        src = Folder(uri)
        for b in batches:
            for part, base in zip(b.column("part").to_pylist(), b.column("base").to_pylist()):
                head = src.array(f"part-{part:05d}.idx", "<u8", 4)
                if head[:1].tobytes() != MAGIC:
                    raise ValueError(f"part-{part:05d}.idx is no token index")
                item, n, total = (int(x) for x in head[1:4])
                ids = src.array(f"part-{part:05d}.idx", "<i8", n, 32)
                nulls = src.array(f"part-{part:05d}.idx", np.uint8, n, 32 + 8 * n)
                off = np.asarray(src.array(f"part-{part:05d}.idx", "<u8", n + 1, 32 + 9 * n)).astype(np.int64)
                dtype = np.dtype("<u2" if item == 2 else "<u4")
                mapped = src.local
                toks = src.array(f"part-{part:05d}.bin", dtype, total) if mapped else None
                for lo in range(0, n, 4096):
                    hi = min(n, lo + 4096)
                    block = toks if mapped else src.array(f"part-{part:05d}.bin", dtype, int(off[hi] - off[lo]),
                                                          int(off[lo]) * item)
                    at = 0 if mapped else off[lo]
                    crc = [zlib.crc32(block[off[i] - at:off[i + 1] - at].astype("<u4").tobytes())
                           for i in range(lo, hi)]
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(np.array(ids[lo:hi]), mask=np.array(nulls[lo:hi]).astype(bool)),
                        "start": pa.array(base + off[lo:hi]),
                        "n_tokens": pa.array(off[lo + 1:hi + 1] - off[lo:hi]),
                        "ids_crc32": pa.array(np.array(crc, dtype=np.int64))})
    return run


def read_back(spark: SparkSession, uri: str, parts: list[tuple[int, int, int, int]]) -> DataFrame:
    """Per document from the files: doc_id, start, n_tokens, ids_crc32."""
    rows = spark.createDataFrame([(p, b) for p, _, _, b in parts], "part int, base long")
    return rows.repartition(max(1, len(parts))).mapInArrow(
        _read_part(uri), "doc_id long, start long, n_tokens long, ids_crc32 long")


def byte_bpe_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def token_digest(spark: SparkSession, docs: DataFrame, memo_entries: int = MEMO_ENTRIES) -> DataFrame:
    """Write the token files of ``docs`` and report each document from them."""
    uri = shared_folder(spark, "token-files")
    return read_back(spark, uri, write(docs, uri, byte_bpe_path(), memo_entries=memo_entries))
