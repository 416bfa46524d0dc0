import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from flowgauge.llm import pieces
from tests.llm.conftest import ODD


@pytest.fixture(scope="module")
def enc(pieces_model):
    return pieces.Encoder(pieces_model)


def all_ways(lattice, text):
    edges = lattice.edges(text)

    def back(j):
        if not j:
            yield 0.0, ()
        else:
            for i, s, ids in edges[j]:
                for t, more in back(i):
                    yield s + t, more + ids

    return sorted(back(len(text)), key=lambda x: -x[0])


TEXT = st.text(st.sampled_from("the an.,é \n▁日1<"), max_size=9)


@settings(max_examples=150, database=None, deadline=None)
@given(TEXT)
def test_n_best_of_a_text(enc, text):
    got, changed = enc.encode(text)
    want = all_ways(enc.lattice, " " + text) if text else [(0.0, ())]
    assert [s for s, _ in got] == [s for s, _ in want[: enc.n]]
    ids = [tuple(np.frombuffer(b, "<u4").tolist()) for _, b in got]
    assert len(set(ids)) == len(ids) and set(ids) <= {i for _, i in want}
    assert all(enc.lattice.decode(i) == text for i in ids)


@settings(max_examples=100, database=None, deadline=None)
@given(st.text(max_size=40))
def test_round_trip(enc, text):
    text = text.encode("utf-8", "ignore").decode()
    for _, b in enc.encode(text)[0]:
        assert enc.lattice.decode(np.frombuffer(b, "<u4").tolist()) == text


@settings(max_examples=150, database=None, deadline=None)
@given(st.text(st.sampled_from("thean é1"), min_size=1, max_size=8))
def test_best_and_gap(enc, word):
    score, ids, gap = enc.lattice.best(word)
    ways = all_ways(enc.lattice, word)
    assert (score, enc.lattice.raw_text(ids)) == (ways[0][0], word)
    assert gap == (ways[0][0] - ways[1][0] if len(ways) > 1 else math.inf)


@pytest.mark.parametrize("word", [" m².", " km².", " m²", " x.²", " m².)", " the.", " é,a", "²."])
def test_composed_words(enc, word):
    k = enc._add(word)
    score, ids = next(enc.lattice.n_best(word))
    assert (enc.score[k], tuple(enc._own(k))) == (pytest.approx(score), ids)


def test_forgetting(enc, pieces_model, monkeypatch):
    monkeypatch.setattr(pieces, "CACHE", 9000)
    small = pieces.Encoder(pieces_model)
    for k in range(60):
        text = " ".join(f"word{k * j} the and" for j in range(k % 30))
        assert small.encode(text) == enc.encode(text)


def test_memory_of_words_and_searches(pieces_model):
    """What an encoder remembers is bounded in bytes of words, and in characters of searched words."""
    enc, whole = pieces.Encoder(pieces_model, cache=300_000), pieces.Encoder(pieces_model)
    for k in range(400):
        text = " ".join(f"{'long' * 30}{k}x{j}" for j in range(8))
        assert enc.encode(text) == whole.encode(text)
        assert enc.held <= 300_000 and sum(map(len, enc.searches)) <= pieces.SEARCHED
        assert enc.held == sum(pieces.ENTRY + pieces.CHARACTER * len(w) for w in enc.at)


def test_whole_texts_are_decoded(spark, pieces_model, monkeypatch):
    """Ids of a best segmentation that don't give back the text are told."""

    def make(*_):
        enc = pieces.Encoder(pieces_model)
        _, ids, gap = enc.lattice.best(" dog")
        enc._put(" cat", 0.0, gap, ids)
        return enc

    step = []
    monkeypatch.setattr(pieces, "encoder", make)
    monkeypatch.setattr(pieces, "map_rows", lambda rows, schema, make: step.append(make()))
    pieces.piece_digests(spark.createDataFrame([(1, "a")], "doc_id long, text string"), pieces_model)
    assert step[0]({"doc_id": [1, 2, 3], "text": ["a dog", "a cat", None]})["exact"] == [True, False, True]


@settings(max_examples=200, database=None, deadline=None)
@given(st.lists(st.lists(st.sampled_from([" a", " ", "a", "b", "ab"]), max_size=6), min_size=2, max_size=4))
def test_gives_back_as_whole_decoding(enc, cuts):
    got = [(0.0, np.array([enc.lattice.plain[p][0] for p in cut], "<u4").tobytes()) for cut in cuts]
    whole = "".join(cuts[0])
    assert pieces.gives_back(enc.lattice, got, whole.encode()) == all("".join(cut) == whole for cut in cuts)
    assert not pieces.gives_back(enc.lattice, got, whole.encode() + b"x")


def test_odd_rows(spark, odd_docs, pieces_model):
    rows = pieces.piece_digests(odd_docs, pieces_model).collect()
    assert len(rows) == len(ODD) and all(r.exact for r in rows)
    assert {r.n_pieces for r in rows if r.doc_id in (2, 3)} == {0}
    nbest = pieces.n_best_pieces(odd_docs, pieces_model, 2)
    texts = pieces.decoded(nbest.selectExpr("doc_id", "nbest[0].ids as ids"), pieces_model).collect()
    assert sorted(((r.doc_id, r.text) for r in texts), key=repr) == sorted(((i, t or "") for i, t in ODD), key=repr)
    assert pieces.piece_digests(odd_docs.limit(0), pieces_model).count() == 0
