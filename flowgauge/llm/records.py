"""Operator 3: token ids as length-delimited binary records with an offset index.

A shard ``part-NNNNN.rec`` is a run of frames, each ``length u64 | masked crc of the length
u32 | payload | masked crc of the payload u32``, little-endian. The checksum is CRC-32,
rotated right by 15 bits plus a constant, so that a checksum stored inside data doesn't
check itself. A payload is ``doc_id i64 | flags u8 | ids``; ids are unsigned 16-bit if the
vocabulary fits, else 32-bit. ``part-NNNNN.idx`` has ``doc_id i64 | offset u64 | length
u64`` per record, so readers can visit records in any order.

Nulls and ties: a null text is empty (its record holds the end id alone); a null doc_id is
kept, flagged, and sorts first; rows with equal doc_id are all kept, ordered by a hash of the
text and then by the text, so that very many of them are dealt over several shards. An empty
table makes a folder without records. Other columns are ignored. The string of a special
token inside a text gets that token's id, as the tokenizers library does by default; with
``spell_special`` it is spelled out as ordinary text.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from itertools import compress, repeat
from operator import is_

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgauge.llm.common import kept, small_batches
from flowgauge.sources.shared import shared_dir

HEAD, TAIL, INDEX, PAYLOAD = struct.Struct("<QI"), struct.Struct("<I"), struct.Struct("<qQQ"), struct.Struct("<qB")
NULL_ID, WIDE = 1, 2
#: Bytes of words and their ids, about, that a Python worker remembers.
CACHE = 192 << 20
#: Bytes of a remembered word besides its characters and ids.
ENTRY = 180
#: Bytes of input, as Spark estimates them, for a shard.
SHARD = 256 << 20
#: White space besides spaces and line ends: such texts are encoded whole.
ODD = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    n = struct.pack("<Q", len(payload))
    return b"".join((n, TAIL.pack(masked(n)), payload, TAIL.pack(masked(payload))))


def unframe(buf: bytes, at: int = 0) -> tuple[bytes, int]:
    """The payload at ``at`` and where the next frame starts; raises on any damage."""
    if at + HEAD.size > len(buf):
        raise ValueError("truncated frame header")
    n, c = HEAD.unpack_from(buf, at)
    if masked(buf[at : at + 8]) != c:
        raise ValueError("damaged length")
    end = at + HEAD.size + n
    if end + TAIL.size > len(buf):
        raise ValueError("truncated frame")
    payload = buf[at + HEAD.size : end]
    if TAIL.unpack_from(buf, end)[0] != masked(payload):
        raise ValueError("damaged payload")
    return payload, end + TAIL.size


def to_payload(doc_id: int | None, ids: bytes | np.ndarray, wide: bool) -> bytes:
    flags = (NULL_ID if doc_id is None else 0) | (WIDE if wide else 0)
    return PAYLOAD.pack(doc_id or 0, flags) + (ids if isinstance(ids, bytes) else ids.astype("<u4" if wide else "<u2").tobytes())


def from_payload(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, flags = PAYLOAD.unpack_from(payload)
    ids = np.frombuffer(payload, "<u4" if flags & WIDE else "<u2", offset=PAYLOAD.size)
    return None if flags & NULL_ID else doc_id, ids


def entry(doc_id: int | None, at: int, size: int) -> bytes:
    return INDEX.pack(doc_id or 0, at, size)


class WordEncoder:
    """Encodes whole texts with a byte-level BPE of the tokenizers library.

    Its splitting rule always starts a new piece at a space that a non-space follows, and cuts
    on both sides of a single line end, so a text can be encoded word by word, and a distinct
    word needs the library only once. Texts with runs of white space or with special tokens go
    to the library whole, and with a tokenizer of another form all texts do.
    """

    def __init__(self, path: str, spell_special: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = spell_special
        added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.odd = [*ODD, *added]
        form = json.loads(self.tok.to_str())
        cut = form["pre_tokenizer"] or {}
        self.by_word = (
            form["normalizer"] is None and form["truncation"] is None and form["padding"] is None and form["model"]["type"] == "BPE" and not form["model"].get("dropout")
            and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut["add_prefix_space"]
        )
        self.wide = self.tok.get_vocab_size() > 1 << 16
        self.kind = np.dtype("<u4" if self.wide else "<u2")
        #: Of each id, whether its token begins with a space: so does the first of a word, and no other of it has one.
        vocab = self.tok.get_vocab()
        self.starts = np.zeros(max(vocab.values()) + 1, bool)
        self.starts[[k for t, k in vocab.items() if t.startswith("Ġ")]] = True
        self.known: dict[str, bytes] = {}  # ids of a space or line end and the word
        self.held = 0

    def _many(self, texts: list[str]) -> list[bytes]:
        return [array(self.kind.char, e.ids).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words with the white space before them: those behind spaces in long lines, cut
        again at the ids that begin with a space."""
        plain = [w for w in words if w[0] != "\n"]
        lines = [plain[k : k + 1000] for k in range(0, len(plain), 1000)]
        size, out = self.kind.itemsize, {}
        for line, e in zip(lines, self.tok.encode_batch_fast([" " + " ".join(x) for x in lines], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, self.kind)
            data, cuts = ids.tobytes(), (np.flatnonzero(self.starts[ids]) * size).tolist()
            out.update(zip(line, map(data.__getitem__, map(slice, cuts, [*cuts[1:], len(data)])), strict=True))
        rest = [w for w in words if w[0] == "\n"]
        out.update(zip(rest, self._many(rest), strict=True))
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(x, self.kind) for x in self.encode_bytes(texts)]

    def encode_bytes(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; texts that aren't cut at all spaces are encoded whole."""
        if not self.by_word:
            return self._many(texts)
        parts = [t.replace("\n", " \n").split(" ") for t in texts]  # a line end stays with the word behind it
        whole = [k for k, (t, ws) in enumerate(zip(texts, parts, strict=True)) if "" in ws[1:] or "\n " in t or "\n\n" in t or any(map(t.__contains__, self.odd))]
        heads = self._many([ws[0] for ws in parts])
        for k, data in zip(whole, self._many([texts[k] for k in whole]), strict=True):
            heads[k], parts[k] = data, [""]
        for ws in parts:
            del ws[0]
        found = [list(map(self.known.get, ws)) for ws in parts]
        lacks = [list(compress(ws, map(is_, ids, repeat(None)))) for ws, ids in zip(parts, found, strict=True)]
        got = self._words(list(set().union(*lacks)))
        more = sum(map(len, got)) + sum(map(len, got.values())) + ENTRY * len(got)
        if self.held + more > CACHE:
            self.known, self.held = {}, 0
        if more <= CACHE:
            self.known.update(got)
            self.held += more
        out = []
        for head, ws, ids, lack in zip(heads, parts, found, lacks, strict=True):
            if lack:
                ids = [got[w] if x is None else x for w, x in zip(ws, ids, strict=True)]
            out.append(head + b"".join(ids))
        return out


def encoder(path: str, spell_special: bool = False) -> WordEncoder:
    """A Python worker keeps what it knows of words from task to task."""
    return kept(("records", path, spell_special), lambda: WordEncoder(path, spell_special))


def shards_for(docs: DataFrame) -> int:
    """As many shards as there are shuffle partitions, or more if the input is large."""
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(least, -(-size // SHARD)) if size < 1 << 60 else least  # beyond: unknown to Spark


def _opened(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder)


def write_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None, shards: int | None = None, spell_special: bool = False) -> list[tuple[int, int, int]]:
    """Encode ``text`` and write shards in ascending ``doc_id`` order.

    Returns (shard, records, ids) of each shard in order: one small row per shard, the only
    thing that the driver sees. A shard is written under a name of its own attempt and then
    renamed, so a repeated or lost task leaves no half shard behind.
    """
    spark = docs.sparkSession
    small_batches(spark)
    n = shards or shards_for(docs)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        store, base = _opened(folder)
        enc = encoder(tokenizer, spell_special)
        size = enc.kind.itemsize
        end = b"" if end_id is None else end_id.to_bytes(size, "little")
        own = f"{base}/.attempt-{uuid.uuid4().hex}"
        records = total = at = 0
        with store.open_output_stream(f"{own}.rec") as rec, store.open_output_stream(f"{own}.idx") as idx:
            for batch in batches:
                texts = [t or "" for t in batch.column(1).to_pylist()]
                for doc_id, tokens in zip(batch.column(0).to_pylist(), enc.encode_bytes(texts), strict=True):
                    tokens += end
                    data = frame(to_payload(doc_id, tokens, enc.wide))
                    rec.write(data)
                    idx.write(entry(doc_id, at, len(data)))
                    at += len(data)
                    records, total = records + 1, total + len(tokens) // size
        for kind in ("rec", "idx"):
            store.move(f"{own}.{kind}", f"{base}/part-{shard:05d}.{kind}")
        yield pa.RecordBatch.from_pydict({"shard": [shard], "records": [records], "ids": [total]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    sorted_rows = rows.repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
    got = sorted_rows.select("doc_id", "text").mapInArrow(write, "shard long, records long, ids long").collect()
    return sorted((r.shard, r.records, r.ids) for r in got)


def read_shard(folder: str, shard: int) -> Iterator[tuple[int | None, np.ndarray]]:
    """The records of a shard in order, read frame by frame."""
    store, base = _opened(folder)
    with store.open_input_stream(f"{base}/part-{shard:05d}.rec", buffer_size=1 << 20) as f:
        while head := f.read(HEAD.size):
            n = HEAD.unpack(head)[0]
            if TAIL.unpack_from(head, 8)[0] != masked(head[:8]):
                raise ValueError("damaged length")
            payload, _ = unframe(head + f.read(n + TAIL.size))
            yield from_payload(payload)


def read_index(folder: str, shard: int) -> np.ndarray:
    store, base = _opened(folder)
    with store.open_input_stream(f"{base}/part-{shard:05d}.idx") as f:
        return np.frombuffer(f.read(), np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("length", "<u8")]))


def read_shuffled(folder: str, shard: int, seed: int) -> Iterator[tuple[int | None, np.ndarray]]:
    """The records of a shard in a seeded random order, by seeks through the index."""
    store, base = _opened(folder)
    index = read_index(folder, shard)
    with store.open_input_file(f"{base}/part-{shard:05d}.rec") as f:
        for k in np.random.default_rng([seed, shard]).permutation(len(index)):
            f.seek(int(index["offset"][k]))
            yield from_payload(unframe(f.read(int(index["length"][k])))[0])


def record_digests(spark: SparkSession, folder: str, shards: list[tuple[int, int, int]]) -> DataFrame:
    """One row per record, read back from the files: start, token count and checksum."""
    starts, at = [], 0
    for shard, records, ids in shards:
        if records:
            starts.append((shard, at))
        at += ids
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    todo = spark.createDataFrame(starts, "shard long, first long").repartition(max(1, len(starts)), "shard") if starts else None
    if todo is None:
        return spark.createDataFrame([], schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out: list[tuple] = []
                for doc_id, ids in read_shard(folder, shard):
                    out.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    if len(out) == 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return todo.mapInArrow(read, schema)


def token_records(docs: DataFrame, tokenizer: str, end_id: int | None) -> DataFrame:
    """Write the records of ``docs`` to the shared folder and describe them from the files."""
    spark = docs.sparkSession
    folder = shared_dir(spark, "records")
    return record_digests(spark, folder, write_records(docs, folder, tokenizer, end_id))
