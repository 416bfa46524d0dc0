import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from flowgauge.llm import records
from flowgauge.sources.shared import shared_dir
from tests.llm.conftest import ODD


@settings(max_examples=200, database=None)
@given(st.lists(st.binary(max_size=60), max_size=5), st.data())
def test_frames(payloads, data):
    buf, at, got = b"".join(map(records.frame, payloads)), 0, []
    while at < len(buf):
        p, at = records.unframe(buf, at)
        got.append(p)
    assert got == payloads
    if buf:
        k = data.draw(st.integers(0, len(buf) - 1))
        bad = buf[:k] + bytes([buf[k] ^ 1 + data.draw(st.integers(0, 254))]) + buf[k + 1 :]
        if bad != buf:
            with pytest.raises(ValueError):
                at = 0
                while at < len(bad):
                    _, at = records.unframe(bad, at)
        with pytest.raises(ValueError):
            records.unframe(buf[: len(records.frame(payloads[0])) - 1])


@pytest.mark.parametrize("wide", [False, True])
@pytest.mark.parametrize("doc_id", [None, -5, 0, 1 << 60])
def test_payload(doc_id, wide):
    got = records.from_payload(records.to_payload(doc_id, np.array([0, 7, 50256]), wide))
    assert got[0] == doc_id and got[1].tolist() == [0, 7, 50256]


@pytest.fixture(scope="module")
def enc(bpe):
    return records.WordEncoder(bpe)


@settings(max_examples=400, database=None, deadline=None)
@given(st.lists(st.lists(st.sampled_from([" ", "  ", "\n", "\t", "a", "the", "'s", "9", ".", "é", "日", "<|endoftext|>", "\xa0", "\u2003", "\x1c", "\x85"]), max_size=12).map("".join), max_size=4))
def test_words_as_whole(enc, texts):
    want = [enc.tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in enc.encode(texts)] == want


def test_words_alone_go_to_the_library(bpe, monkeypatch):
    """New words are encoded in lines without a line end for each, and cut as the library cuts them alone."""
    enc, sent = records.WordEncoder(bpe), []
    many = enc.tok.encode_batch_fast
    enc.tok = type("Tok", (), {"encode_batch_fast": lambda _, texts, **k: sent.extend(texts) or many(texts, **k)})()
    words = [f"w{k}'s" for k in range(1500)] + ["Ġ", "ĠĠa", "'s", "日本", "\U0001f600", "1,5", "ĊĠ", "é"]
    got = enc._words(words)
    assert len(sent) == 2 and not any("\n" in x for x in sent)
    assert got == {w: np.array(e.ids, enc.kind).tobytes() for w, e in zip(words, many([f" {w}" for w in words], add_special_tokens=False), strict=True)}


def test_special_tokens(bpe, enc, monkeypatch):
    """By default as the plain call of the library, whose ids for them are special; else spelled out."""
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(bpe)
    texts = ["<|endoftext|>", "a <|endoftext|> b", "x<|endoftext|>\ny", "no end"]
    assert [x.tolist() for x in enc.encode(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert enc.encode(texts)[0].tolist() == [50256]
    spelled = records.WordEncoder(bpe, spell_special=True)
    plain.encode_special_tokens = True
    assert [x.tolist() for x in spelled.encode(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    monkeypatch.setattr(records, "CACHE", 2000)
    for k in range(30):
        t = " ".join(f"word{k * j} the" for j in range(k))
        assert enc.encode([t])[0].tolist() == plain.encode(t, add_special_tokens=False).ids
    assert enc.held <= 2000 or len(enc.known) > 30


def test_other_tokenizers_encode_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    other, plain = records.WordEncoder(path), Tokenizer.from_file(path)
    texts = ["The Cat  sat,\non a mat", "", "ÉÉ é"]
    assert not other.by_word
    assert [x.tolist() for x in other.encode(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_many_rows_of_one_id(spark, bpe):
    """They are dealt over several shards, and the number of shards grows with the input."""
    docs = spark.range(400).selectExpr("7L as doc_id", "concat('text ', id) as text")
    folder = shared_dir(spark, "test")
    shards = records.write_records(docs, folder, bpe, 2, shards=4)
    assert sum(n for _, n, _ in shards) == 400 and max(n for _, n, _ in shards) < 300
    assert records.shards_for(docs) == 4


def test_written_and_read_back(spark, odd_docs, bpe, enc):
    folder = shared_dir(spark, "test")
    shards = records.write_records(odd_docs, folder, bpe, 2, shards=5)
    got = [r for s, *_ in shards for r in records.read_shard(folder, s)]
    order = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert [(i, x.tolist()) for i, x in got] == [(i, enc.tok.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in order]
    assert sum(n for _, n, _ in shards) == len(ODD)
    for s, n, _ in shards:
        index = records.read_index(folder, s)
        assert len(index) == n
        mixed = list(records.read_shuffled(folder, s, 4))
        key = lambda r: (str(r[0]), r[1].tolist())
        assert sorted(map(key, mixed)) == sorted(map(key, records.read_shard(folder, s)))


def test_digests(spark, odd_docs, bpe, enc):
    got = records.token_records(odd_docs, bpe, 2).orderBy("start").collect()
    at = 0
    for r, (i, t) in zip(got, sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")), strict=True):
        ids = enc.tok.encode(t or "", add_special_tokens=False).ids + [2]
        assert tuple(r) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert records.token_records(odd_docs.limit(0), bpe, 2).count() == 0


def test_repeated_writing_replaces(spark, odd_docs, bpe):
    folder = shared_dir(spark, "test")
    assert records.write_records(odd_docs, folder, bpe, None, 3) == records.write_records(odd_docs, folder, bpe, None, 3)
    assert len(list(records.read_shard(folder, 0))) == len(records.read_index(folder, 0))
