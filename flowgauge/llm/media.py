"""Operator 5: media columns, typed by their bytes.

``find_magic`` locates magic bytes with an Aho-Corasick automaton in one pass over a value;
a validator for each format then confirms structure and lengths. ``sniff`` corrects a
declared type by what starts at byte 0 and carves every further embedded file that validates.

Nulls and edge cases: null media gives type null and no carved parts; empty or unknown bytes
give ``application/octet-stream``; equal values get equal results; overlapping hits are
resolved from left to right, an outer file hiding what lies inside it only if it is not the
one at byte 0 (a container at byte 0 is searched inside, too). Of media that isn't a WAV file
there are no samples: what is computed of them is null, and left out of the feature; of null
media all is null. A null text is stored as an empty one; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgauge.llm.common import map_rows, written

UNKNOWN = "application/octet-stream"
#: The payload is a whole number of rows of 64 three-byte pixels.
UNIT = 192
RATE = 8000
#: Compressed bytes that are read at once.
STEP = 1 << 14
#: A marker within the scan of a JPEG file, but for stuffed bytes and restarts.
MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7]", re.DOTALL)


class Part(NamedTuple):
    type: str
    offset: int
    length: int


def following(b: bytes, what: bytes, at: int, seen: dict) -> int:
    """As ``b.find(what, at)``; places ascend from call to call, and none is searched twice."""
    lo, hi = seen.get(what, (len(b) + 1, 0))
    if at < lo or 0 <= hi < at:
        hi = b.find(what, at)
        seen[what] = (at, hi)
    return hi


# Validators: the length of the file that starts at ``at``, or 0. ``seen`` holds, for one value
# and format, the places from which a walk has failed: a later walk that comes to one of them
# fails, too, so many hits in one value don't each walk through the rest of it.
def wav(b: bytes, at: int, seen: dict) -> int:
    if b[at + 8 : at + 12] != b"WAVE" or len(b) < at + 12:
        return 0
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    if end > len(b):
        return 0
    pos, kinds, path = at + 12, set(), []
    while pos + 8 <= end and (pos, end) not in seen:
        path.append((pos, end))
        n = struct.unpack_from("<I", b, pos + 4)[0]
        kinds.add(b[pos : pos + 4])
        pos += 8 + n + (n & 1)
    if pos == end:
        return end - at if {b"fmt ", b"data"} <= kinds else 0
    seen.update(dict.fromkeys(path))
    return 0


def png(b: bytes, at: int, seen: dict) -> int:
    pos, first, path = at + 8, True, []
    while pos + 12 <= len(b) and pos not in seen:
        n, kind = struct.unpack_from(">I4s", b, pos)
        end = pos + 12 + n
        if end > len(b) or first != (kind == b"IHDR") or first and n != 13 or zlib.crc32(memoryview(b)[pos + 4 : end - 4]) != struct.unpack_from(">I", b, end - 4)[0]:
            break
        if kind == b"IEND":
            return end - at
        if not first:
            path.append(pos)
        pos, first = end, False
    seen.update(dict.fromkeys(path if first else [*path, pos]))
    return 0


def gif(b: bytes, at: int, seen: dict) -> int:
    if len(b) < at + 13:
        return 0
    flags = b[at + 10]
    pos, path = at + 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0), []
    while pos < len(b) and pos not in seen:
        path.append(pos)
        mark = b[pos]
        if mark == 0x3B:
            return pos + 1 - at
        if mark == 0x21:
            pos += 2
        elif mark == 0x2C and pos + 10 < len(b):
            flags = b[pos + 9]
            pos += 11 + (3 << (flags & 7) + 1 if flags & 0x80 else 0)
        else:
            break
        while pos < len(b) and b[pos] and -pos not in seen:  # blocks of data; negative: a place inside such a chain
            path.append(-pos)
            pos += 1 + b[pos]
        if pos >= len(b) or b[pos]:
            break
        pos += 1
    seen.update(dict.fromkeys(path))
    return 0


def jpeg(b: bytes, at: int, seen: dict) -> int:
    pos, path = at + 2, []
    while pos + 2 <= len(b) and pos not in seen:
        path.append(pos)
        mark = b[pos + 1]
        if b[pos] != 0xFF or mark == 0xD8:
            break
        if mark == 0xD9:
            return pos + 2 - at
        n = struct.unpack_from(">H", b, pos + 2)[0] if pos + 4 <= len(b) else 0
        if n < 2:
            break
        pos += 2 + n
        if mark == 0xDA:  # entropy-coded data: up to the next real marker
            m = MARKER.search(b, pos)
            pos = m.start() if m else len(b)
    seen.update(dict.fromkeys(path))
    return 0


def bmp(b: bytes, at: int, seen: dict) -> int:
    if len(b) < at + 26:
        return 0
    size, _, start, info = struct.unpack_from("<IIII", b, at + 2)
    return size if info in (12, 40, 52, 56, 108, 124) and 14 + info <= start <= size <= len(b) - at else 0


def gz(b: bytes, at: int, seen: dict) -> int:
    flags = b[at + 3] if len(b) >= at + 18 else 0xFF
    if flags > 0x1F:
        return 0
    start = at + 10
    if flags & 4:
        start += 2 + struct.unpack_from("<H", b, start)[0]
    for bit in (8, 16):  # a name, a comment
        if flags & bit:
            end = following(b, b"\0", start, seen)
            if end < 0:
                return 0
            start = end + 1
    start += 2 if flags & 2 else 0
    if start in seen:
        return 0
    d, pos, rest, crc, size = zlib.decompressobj(-15), start, b"", 0, 0
    try:
        while not d.eof and (rest or pos < len(b)):
            chunk, pos = (rest, pos) if rest else (b[pos : pos + STEP], min(pos + STEP, len(b)))
            got = d.decompress(chunk, 16 * STEP)  # never large at once
            crc, size, rest = zlib.crc32(got, crc), size + len(got), d.unconsumed_tail
    except zlib.error:
        d = None
    end = pos - len(d.unused_data) if d and d.eof else len(b)
    if end + 8 > len(b) or struct.unpack_from("<II", b, end) != (crc, size & 0xFFFFFFFF):
        seen[start] = True
        return 0
    return end + 8 - at


def pdf(b: bytes, at: int, seen: dict) -> int:
    end = following(b, b"%%EOF", at, seen)
    return end + 5 - at if end >= 0 and b"startxref" in b[max(at, end - 64) : end] else 0


#: Magic bytes, media type, validator.
FORMATS: list[tuple[bytes, str, Callable[[bytes, int, dict], int]]] = [
    (b"RIFF", "audio/wav", wav),
    (b"\x89PNG\r\n\x1a\n", "image/png", png),
    (b"GIF87a", "image/gif", gif),
    (b"GIF89a", "image/gif", gif),
    (b"\xff\xd8\xff", "image/jpeg", jpeg),
    (b"BM", "image/bmp", bmp),
    (b"\x1f\x8b\x08", "application/gzip", gz),
    (b"%PDF-", "application/pdf", pdf),
]


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for k, (magic, _, _) in enumerate(FORMATS):
        a.add_word(magic.decode("latin-1"), k)
    a.make_automaton()
    return a


def find_magic(b: bytes, a) -> list[tuple[int, int]]:
    """(offset, format) of every magic, by offset."""
    return sorted((end + 1 - len(FORMATS[k][0]), k) for end, k in a.iter(b.decode("latin-1")))


def sniff(b: bytes | None, a) -> tuple[str | None, int, list[Part]]:
    """The type at byte 0, how many magics were found, and the embedded files.

    Time grows with the length of the value, but for gzip members that are made to lie inside
    one another's uncompressed blocks: each of them is read to its end.
    """
    if b is None:
        return None, 0, []
    kind, parts, free = UNKNOWN, [], 0
    hits = find_magic(b, a)
    seen: list[dict] = [{} for _ in FORMATS]
    for at, k in hits:
        if at and at < free:
            continue
        if n := FORMATS[k][2](b, at, seen[k]):
            if at:
                parts.append(Part(FORMATS[k][1], at, n))
                free = at + n
            else:
                kind = FORMATS[k][1]
    return kind, len(hits), parts


def carve(b: bytes, parts: list[Part]) -> list[bytes]:
    return [b[p.offset : p.offset + p.length] for p in parts]


def to_payload(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode()
    return raw.ljust(max(1, -(-len(raw) // UNIT)) * UNIT, b" "), len(raw)


def to_wav(samples: bytes) -> bytes:
    """Unsigned 8-bit mono PCM; an odd number of samples gets the pad byte that RIFF asks for."""
    pad = b"\0" * (len(samples) & 1)
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8)
    body = b"WAVE" + fmt + struct.pack("<4sI", b"data", len(samples)) + samples + pad
    return struct.pack("<4sI", b"RIFF", len(body)) + body


def from_wav(b: bytes | None) -> bytes | None:
    """The samples of the data chunk; null if ``b`` isn't such a file."""
    if b is None or b[:4] != b"RIFF" or not wav(b, 0, {}):
        return None
    pos = 12
    while pos + 8 <= len(b):
        kind, n = struct.unpack_from("<4sI", b, pos)
        if kind == b"data":
            return b[pos + 8 : pos + 8 + n]
        pos += 8 + n + (n & 1)
    return None


def store_texts(docs: DataFrame, declared: str = UNKNOWN) -> DataFrame:
    """A table with a media column in the shared folder: doc_id, n_bytes, declared, media."""

    def make():
        def step(cols):
            made = [to_payload(t) for t in cols["text"]]
            return {"doc_id": cols["doc_id"], "n_bytes": [n for _, n in made], "declared": [declared] * len(made), "media": [to_wav(p) for p, _ in made]}

        return step

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(map_rows(rows, "doc_id long, n_bytes long, declared string, media binary", make), "media")


def sniff_media(table: DataFrame) -> DataFrame:
    """Correct types and carve: adds ``type``, ``n_magic`` and ``parts`` to media rows."""

    def make():
        a = automaton()

        def step(cols):
            got = [sniff(b, a) for b in cols["media"]]
            out = {"type": [k for k, _, _ in got], "n_magic": [n for _, n, _ in got]}
            out["parts"] = [[p._asdict() for p in parts] for _, _, parts in got]
            return {k: cols[k] for k in ("doc_id", "declared")} | out

        return step

    return map_rows(table.select("doc_id", "declared", "media"), "doc_id long, declared string, type string, n_magic long, parts array<struct<type: string, offset: long, length: long>>", make)


def _described(declared: str | None, b: bytes | None, a) -> tuple:
    if b is None:
        return (None,) * 6
    kind, hits, parts = sniff(b, a)
    p = from_wav(b) if kind == "audio/wav" else None
    feature = f"declared={declared};type={kind};corrected={int(kind != declared)};magic={hits};parts={','.join(f'{x.type}@{x.offset}+{x.length}' for x in parts)}"
    own = (len(b), hashlib.sha256(b).hexdigest())
    if not p:
        return (None if p is None else 0, None if p is None else hashlib.sha256(p).hexdigest(), None if p is None else 0, *own, feature)
    s = np.frombuffer(p, np.uint8)
    high = s >= 128
    feature += f";mean={int(s.sum(dtype=np.int64)) * 1000 // len(s)};range={int(s.max()) - int(s.min())};crossings={int(np.count_nonzero(high[1:] != high[:-1]))}"
    return (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), *own, feature)


def media_features(table: DataFrame) -> DataFrame:
    """Read the stored bytes back; digests of form and samples, and a feature string.

    The feature has the declared and the sniffed type, the magics and embedded files found,
    and of the samples the mean, the peak-to-peak range and the crossings of the mid level.
    """

    def make():
        a = automaton()

        def step(cols):
            out: dict[str, list] = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
            for declared, b in zip(cols["declared"], cols["media"], strict=True):
                for k, v in zip(out, _described(declared, b, a), strict=True):
                    out[k].append(v)
            return {"doc_id": cols["doc_id"], "n_bytes": cols["n_bytes"]} | out

        return step

    return map_rows(table, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", make)


def oracle() -> str:
    """DuckDB SQL of the query: bytes by way of code points.

    It takes it that no text holds a whole media file, as carving is beyond SQL, and that the
    only magic of a text is one in ASCII.
    """
    le32 = lambda n: f"printf('%02x%02x%02x%02x', ({n}) & 255, (({n}) >> 8) & 255, (({n}) >> 16) & 255, (({n}) >> 24) & 255)"
    magics = " + ".join(f"len(string_split(t, '{m.decode()}')) - 1" for m, *_ in FORMATS if m.isascii() and m.decode().isprintable())
    fixed = struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8).hex()
    codes = "CASE WHEN u < 128 THEN [u] WHEN u < 2048 THEN [192 + (u >> 6), 128 + (u & 63)] WHEN u < 65536 THEN [224 + (u >> 12), 128 + ((u >> 6) & 63), 128 + (u & 63)] ELSE [240 + (u >> 18), 128 + ((u >> 12) & 63), 128 + ((u >> 6) & 63), 128 + (u & 63)] END"
    return rf"""
WITH raw AS (SELECT doc_id, coalesce(text, '') AS t, encode(coalesce(text, '')) AS r FROM documents),
padded AS (SELECT doc_id, t, octet_length(r) AS n, r || encode(repeat(' ', (greatest(1, (octet_length(r) + {UNIT - 1}) // {UNIT}) * {UNIT} - octet_length(r))::BIGINT)) AS p FROM raw),
wavs AS (SELECT doc_id, t, n, p, octet_length(p) AS size, hex(p) AS ph, encode('RIFF') || unhex({le32("octet_length(p) + 36")}) || encode('WAVEfmt ') || unhex('{fixed}') || encode('data') || unhex({le32("octet_length(p)")}) || p AS m FROM padded),
points AS (SELECT doc_id, u, count(*) AS k FROM (SELECT doc_id, unicode(unnest(regexp_extract_all(decode(p), '(?s).'))) AS u FROM wavs) GROUP BY doc_id, u),
bytes AS (SELECT doc_id, k, {codes} AS b FROM points),
measured AS (SELECT doc_id, sum(k * list_sum(b))::BIGINT AS total, max(list_max(b)) - min(list_min(b)) AS width FROM bytes GROUP BY doc_id),
tails AS (SELECT doc_id, right(ph, 32) AS h FROM wavs),
bits AS (SELECT doc_id, list_transform(range(0, 128), lambda k: CASE WHEN k % 8 = 0 THEN ('0x' || substr(h, (1 + 2 * (k // 8))::BIGINT, 2))::BIGINT ELSE 0::BIGINT END) AS bits FROM tails),
sums AS (SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, bits), lambda c, b: CASE WHEN xor(c, b) & 1 = 1 THEN xor(xor(c, b) >> 1, 3988292384::BIGINT) ELSE xor(c, b) >> 1 END), 4294967295::BIGINT) AS crc FROM bits)
SELECT doc_id, n::BIGINT AS n_bytes, size::BIGINT AS payload_bytes, sha256(p) AS payload_sha256, crc AS tail_crc32, octet_length(m)::BIGINT AS media_bytes, sha256(m) AS media_sha256,
  concat('declared={UNKNOWN};type=audio/wav;corrected=1;magic=', 1 + {magics}, ';parts=;mean=', total * 1000 // size, ';range=', width, ';crossings=',
    2 * len(regexp_extract_all(t, '[^\x00-\x7F]+')) - CASE WHEN regexp_matches(t, '^[^\x00-\x7F]') THEN 1 ELSE 0 END - CASE WHEN n = size AND regexp_matches(t, '[^\x00-\x7F]$') THEN 1 ELSE 0 END) AS feature
FROM wavs JOIN measured USING (doc_id) JOIN sums USING (doc_id)"""
