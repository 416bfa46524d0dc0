import random

import numpy as np
import pytest

from flowgauge.llm import language


@pytest.fixture(scope="module")
def vocab(pieces_model):
    return language.Vocabulary(pieces_model)


EN = "the cat sat on the mat and the dog ran over the hill to the river with a stone".split()
DE = "die katze sitzt auf der matte und der hund rennt über den hügel zum fluss mit einem stein".split()


def text(rng, words, n=20):
    return " ".join(rng.choices(words, k=n)) + "."


@pytest.fixture(scope="module")
def model(vocab):
    rng = random.Random(1)
    return language.learn({"en": [text(rng, EN) for _ in range(30)], "de": [text(rng, DE) for _ in range(30)]}, vocab)


def test_sums_over_all_segmentations(vocab, model):
    def brute(word):
        edges = list(vocab.edges(word))

        def to(j):
            return np.ones(2) if not j else sum(to(i) * model.p[k] for i, e, k in edges if e == j)

        return np.log(to(len(word)))

    words = ["▁theand", "▁ü日x", "▁" + "a" * 9, "▁" + "the" * 4]
    assert np.allclose(language.log_sums(words, vocab, model.p), [brute(w) for w in words])
    assert np.allclose([language._log_sum(w, vocab, model.p) for w in words], [brute(w) for w in words])
    assert np.isfinite(language.log_sums(["▁" + "the" * 30_000, "▁" + "日" * 5000], vocab, model.p)).all()


def test_long_words_are_learned(vocab):
    """Sentences without spaces teach pieces, and long sums equal short ones."""
    from collections import Counter

    zh, ja = "今天天气很好我们一起去公园散步吧" * 30, "今日はとても天気がいいので公園へ散歩に行きましょう" * 30
    model = language.learn({"zh": [zh], "ja": [ja]}, vocab)
    k = [vocab.index[c] for c in zh if c in vocab.index][0]
    assert model.p[k].max() > 10 * np.median(model.p[:-1])
    p, word = model.p[:, 0], "▁" + zh[:12]
    got = np.zeros(len(p))
    language._long_counts(got, len(word), 3, list(vocab.edges(word)), p)
    assert np.allclose(got, language.expected_counts(Counter({word: 3}), vocab, p))


def test_probabilities_add_up(model):
    assert np.allclose(model.p[:-1].sum(0), 1, atol=1e-4)


def test_expected_counts_by_hand(vocab):
    p = np.full(vocab.size + 1, 1e-3)
    from collections import Counter

    got = language.expected_counts(Counter({"▁an": 2}), vocab, p)
    ways = []
    edges = list(vocab.edges("▁an"))

    def walk(j, used):
        if not j:
            ways.append(used)
        for i, e, k in edges:
            if e == j:
                walk(i, used + [k])

    walk(3, [])
    weight = [np.prod([p[k] for k in w]) for w in ways]
    want = np.zeros(vocab.size + 1)
    for w, x in zip(ways, weight, strict=True):
        for k in w:
            want[k] += 2 * x / sum(weight)
    assert np.allclose(got, want)


def test_held_out(spark, pieces_model):
    rng = random.Random(2)
    rows = [(k, text(rng, (EN, DE)[k % 2]), ("en", "de")[k % 2]) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs.where(~language.held_out("doc_id")), pieces_model, 20)
    got = {r.doc_id: r for r in language.identify(docs, model, pieces_model).collect()}
    assert sum(got[k].lang_pred == lang for k, _, lang in rows) >= 199
    assert all(0 <= r.score <= 1 for r in got.values())


def test_numerals_are_no_letters(model, vocab):
    got = language.Predictor(model, vocab).predict(["½ 12", "² ³", "Ⅷ", "½ the", "١٢", None, ""])
    assert [k for k, _ in got] == ["und", "und", "und", "en", "und", "und", "und"] and got[0][1] == 0


def test_bounds_of_learning(spark):
    rows = [(k, "ab " * 50, f"l{k % 3}") for k in range(60)] + [(99, "z" * 1000, "rare"), (None, "x", "l0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    got = language.training_texts(docs, 10, 10_000, 9)
    assert {k: len(v) for k, v in got.items()} == {"l0": 10, "l1": 10, "l2": 10, "rare": 1}
    assert {k: len(v) for k, v in language.training_texts(docs, 10, 301, 3).items()} == {"l0": 3, "l1": 3, "l2": 3}


def test_small_cache(model, vocab, monkeypatch):
    rng = random.Random(3)
    texts = [text(rng, EN + DE, 8) for _ in range(60)]
    want = language.Predictor(model, vocab).predict(texts)
    monkeypatch.setattr(language, "CACHE", 4000)
    small = language.Predictor(model, vocab)
    assert [small.predict([t])[0] for t in texts] == [(k, pytest.approx(s)) for k, s in want]
    assert small.held <= 4000 or len(small.at) < 12


def test_odd_rows(spark, odd_docs, pieces_model, model):
    got = {r.doc_id: r for r in language.identify(odd_docs, model, pieces_model).collect()}
    assert {got[k].lang_pred for k in (2, 3, 5)} == {"und"} and got[2].score == 0
    assert got[1].lang_pred == "en"
    assert language.identify(odd_docs, language.learn({}, language.Vocabulary(pieces_model)), pieces_model).where("lang_pred <> 'und'").count() == 0
    trained = language.train(odd_docs, pieces_model)
    assert trained.languages == ["en"]
    assert language.train(odd_docs.limit(0), pieces_model).languages == []
    kept = language.keep_known(odd_docs, model, pieces_model)
    assert kept.columns == odd_docs.columns and kept.where("doc_id in (2, 3, 5)").count() == 0 and kept.count() == 9
