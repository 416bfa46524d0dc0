"""Operator 7: quality rules learned as gradient-boosted trees over document statistics.

Trees are fitted with logistic loss on histogram splits, some features being monotonic, and
flattened into numpy node arrays; scoring walks all rows through a tree at once.

Training sees at most ``sample`` labelled documents (those with the smallest hash of their
id); everything else covers all rows. Nulls and edge cases: a null or empty text has all
statistics 0 and fails the base rule; labels other than 0 and 1 and null ids are not learned
from; without labels of both kinds the model keeps all that passes the base rule; repeated
rows are scored each; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgauge.llm.common import filter_rows, map_rows

#: A word of the base statistics.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = "#*$%&|<>"
UPPER = bytes(range(65, 91))
WINDOW = 5
#: The base rule: fewer words, or more percent of words in repeated windows, fail.
LEAST_WORDS, MOST_REPEATED = 10, 20
#: Labelled documents that training uses at most.
SAMPLE = 4000
FEATURES = ["log_words", "word_len", "symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "exclaim_rate", "digit_rate", "distinct_rate", "words_per_line"]
#: -1: a larger value never raises the score.
MONOTONE = {"symbol_rate": -1, "dup_line_rate": -1, "repeat_rate": -1, "exclaim_rate": -1}


def base_stats(text: str | None) -> tuple[int, int, int, int, int, list[str]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the words."""
    if not text:
        return 0, 0, 0, 0, 0, []
    words = WORD.findall(text)
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line.strip(SPACE):
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    repeat = 0
    windows = list(zip(*(words[k:] for k in range(WINDOW)), strict=False))
    if len(set(windows)) < len(windows):
        count, covered = Counter(windows), 0
        for k, w in enumerate(windows):
            if count[w] > 1:
                repeat += k + WINDOW - max(covered, k)
                covered = k + WINDOW
    return len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), dup, repeat, words


def features(text: str | None) -> tuple[tuple[int, ...], list[float]]:
    """The base statistics and the features of the model."""
    n, chars, symbols, dup, repeat, words = base_stats(text)
    base = (n, chars, symbols, dup, repeat)
    if not n:
        return base, [0.0] * len(FEATURES)
    raw = text.encode()
    plain = raw.translate(None, UPPER)
    lines = text.count("\n") + 1
    return base, [
        math.log1p(n), chars / n, symbols / n, dup / lines, repeat / n, (len(raw) - len(plain)) / chars,
        text.count("!") / n, (len(raw) - len(raw.translate(None, b"0123456789"))) / chars, len(set(words)) / n, n / lines,
    ]


@dataclass
class Trees:
    """Node arrays of all trees; a leaf points to itself, so a walk of ``depth`` steps ends in one."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    bias: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            out += self.value[at]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, names: list[str] = FEATURES, monotone: dict[str, int] = MONOTONE, rounds: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 64, ridge: float = 1.0, least: int = 10) -> Trees:
    """Boost on the gradients of the logistic loss.

    A monotonic feature splits only if the leaf values of both sides are in its order, and
    the middle of the two then bounds all that is below, so no deeper split can undo it.
    """
    sign = [monotone.get(n, 0) for n in names]
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) if len(x) else np.zeros(0) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], 1) if len(x) else np.zeros((0, x.shape[1]), int)
    p = min(max(float(y.mean()) if len(y) else 0.5, 1e-6), 1 - 1e-6)
    bias = math.log(p / (1 - p))
    nodes: list[list] = []
    roots: list[int] = []
    margin = np.full(len(x), bias)

    def leaf(g: float, h: float, lo: float, hi: float) -> float:
        return min(max(-g / (h + ridge), lo), hi)

    def grow(rows: np.ndarray, level: int, lo: float, hi: float, g: np.ndarray, h: np.ndarray) -> int:
        k = len(nodes)
        gs, hs = g[rows].sum(), h[rows].sum()
        nodes.append([0, math.inf, k, k, rate * leaf(gs, hs, lo, hi)])
        best = (1e-9, 0, 0)
        if level < depth and len(rows) >= 2 * least:
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                b = binned[rows, f]
                gl, hl, nl = (np.cumsum(np.bincount(b, w, len(c) + 1))[:-1] for w in (g[rows], h[rows], None))
                gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                ok = (nl >= least) & (len(rows) - nl >= least)
                if sign[f]:
                    vl, vr = (np.clip(-a / (b2 + ridge), lo, hi) for a, b2 in ((gl, hl), (gs - gl, hs - hl)))
                    ok &= sign[f] * (vr - vl) >= 0
                if ok.any() and (m := float(np.where(ok, gain, -1).max())) > best[0]:
                    best = (m, f, int(np.where(ok, gain, -1).argmax()))
        if best[0] > 1e-9:
            _, f, cut = best
            to_left = binned[rows, f] <= cut
            l_rows, r_rows = rows[to_left], rows[~to_left]
            bounds = (lo, hi), (lo, hi)
            if sign[f]:
                mid = sum(leaf(g[r].sum(), h[r].sum(), lo, hi) for r in (l_rows, r_rows)) / 2
                bounds = ((lo, mid), (mid, hi)) if sign[f] > 0 else ((mid, hi), (lo, mid))
            left = grow(l_rows, level + 1, *bounds[0], g, h)
            right = grow(r_rows, level + 1, *bounds[1], g, h)
            nodes[k][:4] = [f, float(cuts[f][cut]), left, right]
        return k

    for _ in range(rounds if len(set(y.tolist())) > 1 else 0):
        p_ = 1 / (1 + np.exp(-margin))
        root = grow(np.arange(len(x)), 0, -math.inf, math.inf, p_ - y, p_ * (1 - p_))
        roots.append(root)
        only = Trees(np.array([root]), *_arrays(nodes), depth, 0.0)
        margin += only.margin(x)
    return Trees(np.array(roots, int), *_arrays(nodes), depth, bias if roots else math.inf)


def _arrays(nodes: list[list]) -> list[np.ndarray]:
    kinds = (int, float, int, int, float)
    return [np.array([n[i] for n in nodes], t) for i, t in enumerate(kinds)]


def training_set(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``sample`` documents; only their statistics reach the driver."""
    ids = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    known = {r.doc_id: r.quality for r in ids.collect()}
    if not known:
        return np.zeros((0, len(FEATURES))), np.zeros(0)

    def make():
        def step(cols):
            return {"doc_id": cols["doc_id"], "x": [features(t)[1] for t in cols["text"]]}

        return step

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    of = docs.sparkSession.createDataFrame([(k,) for k in known], "doc_id long")
    rows = map_rows(texts.join(F.broadcast(of), "doc_id", "left_semi"), "doc_id long, x array<double>", make)
    # repeated documents must not carry the sample over its bound
    got = sorted((r.doc_id, r.x) for r in rows.groupBy("doc_id").agg(F.min("x").alias("x")).collect())
    return np.array([x for _, x in got]).reshape(-1, len(FEATURES)), np.array([known[i] for i, _ in got], float)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    return fit(*training_set(docs, labels, sample))


def verdicts(texts: list[str | None], model: Trees, threshold: float) -> dict[str, list]:
    """The statistics, score and verdict of each text."""
    got = [features(t) for t in texts]
    score = model.score(np.array([x for _, x in got]).reshape(-1, len(FEATURES)))
    n, chars, symbols, dup, repeat = ([b[k] for b, _ in got] for k in range(5))
    failed = [w < LEAST_WORDS or 100 * r > MOST_REPEATED * w for w, r in zip(n, repeat, strict=True)]
    kept = [not f and bool(s >= threshold) for f, s in zip(failed, score, strict=True)]
    return {"n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": repeat, "base_failed": failed, "score": score.tolist(), "kept": kept}


JUDGED = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean"


def judge(docs: DataFrame, model: Trees, threshold: float = 0.5) -> DataFrame:
    """Statistics, score and verdict of each row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_rows(rows, JUDGED, lambda: lambda cols: {"doc_id": cols["doc_id"]} | verdicts(cols["text"], model, threshold))


def keep_good(docs: DataFrame, model: Trees, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    return filter_rows(docs, ["text"], lambda: lambda cols: verdicts(cols["text"], model, threshold)["kept"])
