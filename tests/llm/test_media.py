import gzip
import hashlib
import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from flowgauge.llm import media
from tests.llm.conftest import ODD


def png():
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


GIF = b"GIF89a\x01\x00\x01\x00\x80\x00\x00\xff\xff\xff\x00\x00\x00!\xf9\x04\x01\x00\x00\x00\x00,\x00\x00\x00\x00\x01\x00\x01\x00\x00\x02\x02D\x01\x00;"
JPEG = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x04ab\x12\xff\x00\x34\xff\xd0\x56\xff\xd9"
BMP = b"BM" + struct.pack("<IIII", 58, 0, 54, 40) + b"\0" * 40
PDF = b"%PDF-1.4\nx\nstartxref\n5\n%%EOF"
FILES = {"image/png": png(), "image/gif": GIF, "image/jpeg": JPEG, "image/bmp": BMP, "application/gzip": gzip.compress(b"hello" * 50), "application/pdf": PDF, "audio/wav": media.to_wav(b"abc")}


@pytest.fixture(scope="module")
def auto():
    return media.automaton()


@pytest.mark.parametrize("kind", FILES)
def test_types_and_lengths(auto, kind):
    b = FILES[kind]
    assert media.sniff(b, auto)[0] == kind
    assert media.sniff(b + b"tail", auto)[0] == kind
    got = media.sniff(b"junk " + b + b" tail", auto)
    assert got[0] == media.UNKNOWN and got[2] == [media.Part(kind, 5, len(b))]
    assert media.carve(b"junk " + b + b" tail", got[2]) == [b]
    for cut in range(1, min(len(b), 40)):
        assert all(p.type != kind or p.length == len(b) for p in media.sniff(b"junk " + b[:-cut], auto)[2])


def test_damage_is_no_file(auto):
    b = bytearray(FILES["image/png"])
    b[20] ^= 1
    assert media.sniff(bytes(b), auto)[0] == media.UNKNOWN


def test_several_files(auto):
    b = media.to_wav(b"..".join(FILES.values()))
    kind, hits, parts = media.sniff(b, auto)
    assert kind == "audio/wav" and {p.type for p in parts} == set(FILES) and hits >= 8
    assert media.sniff(None, auto) == (None, 0, []) and media.sniff(b"", auto) == (media.UNKNOWN, 0, [])


@settings(max_examples=300, database=None)
@given(st.lists(st.one_of(st.binary(max_size=12), st.sampled_from([m for m, *_ in media.FORMATS] + [JPEG[:9], GIF[:20], FILES["audio/wav"][:30]])), max_size=6).map(b"".join))
def test_hits_as_search(auto, b):
    want = sorted((at, k) for k, (m, *_) in enumerate(media.FORMATS) for at in range(len(b)) if b.startswith(m, at))
    assert media.find_magic(b, auto) == want
    for p in media.sniff(b, auto)[2]:
        assert 0 < p.offset < p.offset + p.length <= len(b)


@pytest.mark.parametrize("unit", [b"%PDF-", b"\x1f\x8b\x08\x08", b"\xff\xd8\xff\xe0\x00\x06", b"GIF89a", b"\xff\xd8\xff\xda\x00\x02", b"\x89PNG\r\n\x1a\n", b"RIFF\xff\xff\x00\x00WAVE"])
def test_time_grows_with_length(auto, unit):
    """Many hits in one value don't each search the rest of it."""
    import time

    began = time.time()
    assert media.sniff(unit * (600_000 // len(unit)) + b"\0", auto)[2] == []
    assert time.time() - began < 15


@settings(max_examples=150, database=None)
@given(st.lists(st.sampled_from([m for m, *_ in media.FORMATS] + list(FILES.values()) + [JPEG[2:], GIF[13:], b"\xff\xe0\x00\x04ab", b"!\xf9\x01", b"\0", b",\0\0\0"]), max_size=8).map(b"".join))
def test_walks_that_failed_are_remembered(b):
    """A walk that is told where earlier ones failed ends as one that isn't."""
    for magic, _, check in media.FORMATS:
        seen = {}
        for at in range(len(b)):
            if b.startswith(magic, at):
                assert check(b, at, seen) == check(b, at, {})


def test_gzip_headers(auto):
    import io

    out = io.BytesIO()
    with gzip.GzipFile("a name", "wb", fileobj=out) as f:
        f.write(b"hello" * 500)
    b = out.getvalue()
    assert media.sniff(b"x" + b + b"y", auto)[2] == [media.Part("application/gzip", 1, len(b))]
    assert media.sniff(b[:-3] + b"zzz", auto)[0] == media.UNKNOWN


@settings(max_examples=200, database=None)
@given(st.binary(max_size=500))
def test_wav_is_lossless(samples):
    b = media.to_wav(samples)
    assert media.from_wav(b) == samples and media.wav(b, 0, {}) == len(b)


def test_odd_rows(spark, odd_docs):
    table = media.store_texts(odd_docs)
    got = media.media_features(table).collect()
    want = []
    for i, t in ODD:
        raw = (t or "").encode()
        p = raw + b" " * (-len(raw) % 192 if raw else 192)
        want.append((str(i), len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])))
    assert sorted((str(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == sorted(want)
    assert len({r.feature for r in got if r.payload_sha256 == got[0].payload_sha256}) == 1
    assert {r.type for r in media.sniff_media(table).collect()} == {"audio/wav"}
    assert media.media_features(media.store_texts(odd_docs.limit(0))).count() == 0
    null = spark.createDataFrame([(1, None, None)], "doc_id long, declared string, media binary")
    assert [tuple(r) for r in media.sniff_media(null).collect()] == [(1, None, None, 0, [])]
    rows = [(1, 5, None, None), (2, 5, "audio/wav", b"no wav"), (3, 0, None, b""), (4, 0, "audio/wav", media.to_wav(b"")), (5, 1, "x", FILES["image/png"]), (6, 3, "audio/wav", FILES["audio/wav"][:-2])]
    other = spark.createDataFrame(rows, "doc_id long, n_bytes long, declared string, media binary")
    got = {r.doc_id: r for r in media.media_features(other).collect()}
    assert got[1].feature is None and got[1].media_bytes is None
    assert [got[k].payload_bytes for k in (2, 3, 4, 5, 6)] == [None, None, 0, None, None]
    assert [got[k].feature.split(";")[1] for k in (2, 3, 4, 5)] == ["type=application/octet-stream", "type=application/octet-stream", "type=audio/wav", "type=image/png"]
