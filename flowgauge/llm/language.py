"""Operator 10: language identification by segmentation-marginalised unigrams.

For each language the pieces of a fixed public vocabulary have probabilities, learned by
expectation maximisation. A text's likelihood is the sum over all its segmentations into
pieces, by the forward algorithm. Pieces don't cross white space, so the sum over a text is
the product of those over its words, and each distinct word is summed once, for all
languages and many words at a time.

Learning sees whole texts of at most ``per_language`` documents of each language, in the order
of a hash of their id, and no further ones once these have ``chars`` characters; it learns the
``languages`` languages with the most documents. These bounds are parameters. Prediction uses
the whole text and nothing else. Nulls and edge cases: a null text and one without letters
(characters of the Unicode categories of letters; numerals such as U+00BD aren't) is ``und``
with score 0; equal likelihoods go to the language first in order; without anything to learn
from all is ``und``; null or empty languages are not learned; repeated rows are predicted
each; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import compress, repeat
from operator import is_

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowgauge.llm.common import filter_rows, kept, map_rows

SPACE = "▁"
UNKNOWN = "und"
#: Letters, and numerals that aren't decimal digits.
LETTER = re.compile(r"[^\W\d_]")
#: What learning sees at most: documents and characters of a language, and languages.
PER_LANGUAGE, CHARS, LANGUAGES = 300, 1_000_000, 128
#: Probability of a character that no piece covers, the same in each language.
STRANGE = 1e-9
#: Words longer than this are summed with scaling, one at a time.
LONG = 24
#: Bytes of words and their sums, about, that a Python worker remembers.
CACHE = 160 << 20
#: Bytes of a remembered word besides its characters and sums.
ENTRY = 180


class Vocabulary:
    def __init__(self, model: str):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.index = {p: k for k, p in enumerate(pieces)}
        self.size = len(pieces)  # the index after the last stands for a strange character
        self.longest = max(map(len, pieces))
        self.prefixes = {p[:k] for p in pieces for k in range(1, len(p) + 1)}
        #: Index of each prefix that is a piece, -1 of those that only begin one.
        self.walk = {p: self.index.get(p, -1) for p in self.prefixes}

    def edges(self, word: str) -> Iterator[tuple[int, int, int]]:
        """(start, end, piece) of all pieces in a word, by start."""
        index, prefixes, n, longest, strange = self.index, self.prefixes, len(word), self.longest, self.size
        for i in range(n):
            single = False
            for j in range(i + 1, min(n, i + longest) + 1):
                k = index.get(w := word[i:j])
                if k is not None:
                    yield i, j, k
                    single |= j == i + 1
                elif w not in prefixes:
                    break
            if not single:
                yield i, i + 1, strange


@dataclass
class Model:
    languages: list[str]
    p: np.ndarray  # pieces and the strange character, by language


def log_sums(words: list[str], vocab: Vocabulary, p: np.ndarray) -> np.ndarray:
    """Log-likelihood of each word in each language, all segmentations summed."""
    out = np.empty((len(words), p.shape[1]))
    by_length: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        by_length.setdefault(len(w), []).append(k)
    for n, rows in by_length.items():
        if n > LONG:
            for k in rows:
                out[k] = _log_sum(words[k], vocab, p)
            continue
        m, walk, strange = n + 1, vocab.walk.get, vocab.size
        steps: list[tuple[list[int], list[int]]] = [([], []) for _ in range(m * m)]  # rows and pieces from i to j
        for r, k in enumerate(rows):
            word = words[k]
            for i in range(n):
                piece = first = walk(word[i])
                at = steps[i * m + i + 1]
                at[0].append(r)
                at[1].append(piece if piece is not None and piece >= 0 else strange)
                if first is not None:
                    for j in range(i + 2, m):
                        piece = walk(word[i:j])
                        if piece is None:
                            break
                        if piece >= 0:
                            at = steps[i * m + j]
                            at[0].append(r)
                            at[1].append(piece)
        alpha = np.zeros((n + 1, len(rows), p.shape[1]))
        alpha[0] = 1
        for k, (r, pieces) in enumerate(steps):  # by start: what reaches i is complete
            if r:
                alpha[k % m, r] += alpha[k // m, r] * p[pieces]
        out[rows] = np.log(alpha[n])
    return out


def _log_sum(word: str, vocab: Vocabulary, p: np.ndarray) -> np.ndarray:
    """One word of any length: forward sums in a sliding window, scaled at each position."""
    window: dict[int, np.ndarray] = {0: np.ones(p.shape[1])}
    scale, done = np.zeros(p.shape[1]), 0
    for i, j, piece in vocab.edges(word):
        if i > done:  # all that reaches i is there
            done = i
            top = window[i].copy()
            scale += np.log(top)
            window = {k: v / top for k, v in window.items() if k >= i}
        got = window[i] * p[piece]
        window[j] = window[j] + got if j in window else got
    return scale + np.log(window[len(word)])


def expected_counts(words: Counter, vocab: Vocabulary, p: np.ndarray) -> np.ndarray:
    """Expected uses of each piece over all segmentations, by forward and backward sums."""
    out = np.zeros(len(p))
    for w, times in words.items():
        edges = list(vocab.edges(w))
        if len(w) > LONG:
            _long_counts(out, len(w), times, edges, p)
            continue
        fore, back = [0.0] * (len(w) + 1), [0.0] * (len(w) + 1)
        fore[0] = back[-1] = 1.0
        for i, j, k in edges:
            fore[j] += fore[i] * p[k]
        for i, j, k in reversed(edges):
            back[i] += p[k] * back[j]
        if fore[-1] > 0:
            for i, j, k in edges:
                out[k] += times * fore[i] * p[k] * back[j] / fore[-1]
    return out


def _long_counts(out: np.ndarray, n: int, times: int, edges: list[tuple[int, int, int]], p: np.ndarray) -> None:
    """Add the expected uses in one word of any length: the same sums of logarithms."""
    logs = np.log(p).tolist()
    fore, back = [-math.inf] * (n + 1), [-math.inf] * (n + 1)
    fore[0] = back[-1] = 0.0
    for i, j, k in edges:
        fore[j] = _log_add(fore[j], fore[i] + logs[k])
    for i, j, k in reversed(edges):
        back[i] = _log_add(back[i], logs[k] + back[j])
    for i, j, k in edges:
        out[k] += times * math.exp(fore[i] + logs[k] + back[j] - fore[-1])


def _log_add(a: float, b: float) -> float:
    hi, lo = (a, b) if a > b else (b, a)
    return hi if lo == -math.inf else hi + math.log1p(math.exp(lo - hi))


def words_of(text: str) -> list[str]:
    return text.split()


def has_letter(text: str) -> bool:
    m = LETTER.search(text)
    while m and not m[0].isalpha():
        m = LETTER.search(text, m.end())
    return m is not None


def learn(samples: dict[str, list[str]], vocab: Vocabulary, rounds: int = 1, smooth: float = 0.05) -> Model:
    """Piece probabilities from texts by language: counts of the vocabulary's own segmentation
    to begin with, then rounds of expectation maximisation; add-``smooth`` throughout."""
    languages = sorted(samples)
    cols = []
    for lang in languages:
        words = Counter(SPACE + w for t in samples[lang] for w in words_of(t))
        c = np.zeros(vocab.size + 1)
        for w, pieces in zip(words, vocab.sp.encode([w[1:] for w in words], out_type=str), strict=True):
            for x in pieces:
                if x in vocab.index:
                    c[vocab.index[x]] += words[w]
        for _ in range(rounds + 1):
            p = (c + smooth) / (c.sum() + smooth * len(c))
            p[-1] = STRANGE
            if _ < rounds:
                c = expected_counts(words, vocab, p)
                c[-1] = 0
        cols.append(p)
    return Model(languages, np.stack(cols, 1) if cols else np.zeros((vocab.size + 1, 0)))


class Predictor:
    def __init__(self, model: Model, vocab: Vocabulary):
        self.model, self.vocab = model, vocab
        self.at: dict[str, int] = {}
        self.rows, self.held = np.empty((1024, len(model.languages))), 0

    def _places(self, words: list[list[str]]) -> list[list[int]]:
        """The row of each word of each text."""
        found = [list(map(self.at.get, ws)) for ws in words]
        new = set().union(*(compress(ws, map(is_, ks, repeat(None))) for ws, ks in zip(words, found, strict=True) if None in ks))
        if not new:
            return found
        more = sum(map(len, new)) + (ENTRY + 8 * self.rows.shape[1]) * len(new)
        if self.held + more > CACHE and self.at:  # begin anew with this batch
            self.at, self.rows, self.held = {}, np.empty((1024, self.rows.shape[1])), 0
            return self._places(words)
        self.held += more
        lo, hi = len(self.at), len(self.at) + len(new)
        if hi > len(self.rows):
            self.rows = np.concatenate([self.rows, np.empty((hi, self.rows.shape[1]))])
        todo = list(new)
        self.rows[lo:hi] = log_sums([SPACE + w for w in todo], self.vocab, self.model.p)
        self.at.update(zip(todo, range(lo, hi), strict=True))
        at = self.at
        return [[at[w] if k is None else k for w, k in zip(ws, ks, strict=True)] if None in ks else ks for ws, ks in zip(words, found, strict=True)]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and its posterior under even odds."""
        if not self.model.languages:
            return [(UNKNOWN, 0.0)] * len(texts)
        places = self._places([words_of(t) if t and has_letter(t) else [] for t in texts])
        out = []
        for ks in places:
            if not ks:
                out.append((UNKNOWN, 0.0))
                continue
            total = self.rows[ks].sum(0)
            k = int(total.argmax())
            out.append((self.model.languages[k], float(1 / np.exp(total - total[k]).sum())))
        return out


@lru_cache(maxsize=1)
def vocabulary_of(path: str) -> Vocabulary:
    return Vocabulary(path)


def predictor(model: Model, vocabulary: str) -> Predictor:
    """A Python worker keeps what it knows of words, of the last model, from task to task."""
    key = hashlib.sha256(repr((model.languages, vocabulary)).encode() + model.p.tobytes()).digest()
    return kept(("language", key), lambda: Predictor(model, vocabulary_of(vocabulary)))


def training_texts(docs: DataFrame, per_language: int = PER_LANGUAGE, chars: int = CHARS, languages: int = LANGUAGES) -> dict[str, list[str]]:
    """Whole texts by language, within the bounds; reads texts of the chosen ids only."""
    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    able = cols.where("doc_id is not null and lang is not null and trim(lang) <> '' and text is not null")
    rows = cols.where("lang is not null and trim(lang) <> ''").groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()
    # of each language only ids with a hash so small that some four times as many as asked for remain: none to sort by the million
    small = [(r.lang, -(1 << 63) + min((1 << 64) - 1, (per_language * 4 << 64) // r.n)) for r in rows]
    limits = F.broadcast(docs.sparkSession.createDataFrame(small, "lang string, most long"))
    ids = able.select("doc_id", "lang", F.xxhash64("doc_id").alias("h"), F.length("text").alias("size")).join(limits, "lang").where("h <= most")
    order = Window.partitionBy("lang").orderBy("h", "doc_id")
    first = ids.groupBy("lang", "doc_id", "h").agg(F.min("size").alias("size")).select("*", F.row_number().over(order).alias("n")).where(F.col("n") <= per_language)
    before = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1))
    chosen = first.select("doc_id", "lang", F.coalesce(before, F.lit(0)).alias("before")).where(F.col("before") < chars).select("doc_id", "lang")
    known = docs.sparkSession.createDataFrame([tuple(r) for r in chosen.collect()], "doc_id long, lang string")
    # one text for an id, however often its row is repeated
    rows = cols.join(F.broadcast(known), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    out: dict[str, list[str]] = {}
    for r in rows.orderBy("lang", "doc_id").collect():
        out.setdefault(r.lang, []).append(r.text)
    return out


def train(docs: DataFrame, vocabulary: str, per_language: int = PER_LANGUAGE, chars: int = CHARS, languages: int = LANGUAGES) -> Model:
    return learn(training_texts(docs, per_language, chars, languages), vocabulary_of(vocabulary))


def identify(docs: DataFrame, model: Model, vocabulary: str) -> DataFrame:
    """doc_id, lang_pred and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the size of the vocabulary times the languages

    def make():
        known = predictor(shared.value, vocabulary)

        def step(cols):
            got = known.predict(cols["text"])
            return {"doc_id": cols["doc_id"], "lang_pred": [x for x, _ in got], "score": [s for _, s in got]}

        return step

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_rows(rows, "doc_id long, lang_pred string, score double", make)


def keep_known(docs: DataFrame, model: Model, vocabulary: str) -> DataFrame:
    """The rows of ``docs`` in a learned language, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        known = predictor(shared.value, vocabulary)
        return lambda cols: [lang != UNKNOWN for lang, _ in known.predict(cols["text"])]

    return filter_rows(docs, ["text"], make)


def held_out(doc_id: str):
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0
