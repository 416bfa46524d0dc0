"""Operator 8: SentencePiece encoding with N-best segmentations, and decoding.

A text is the lattice of vocabulary pieces over its characters. Forward Viterbi scores, the
best score from the start to each position, serve as exact heuristics of a backward A* search
from the end, which so meets whole segmentations from best to worst.

No piece crosses the start of a space or of a line end (a model with such pieces is refused),
so the lattice of a text is a chain of word lattices. Each distinct word is searched once; the
N-best list of the text follows exactly, as one of its N best differs from the best in some of
the N - 1 cheapest changes of single words. The memory of a search grows with the longest word.

Characters without a piece become byte pieces at a cost below that of any piece, so decoding
gives back every text exactly, U+2581 included. Scores are those of the vocabulary file.
Nulls and edge cases: a null or empty text has no pieces, score 0 and one segmentation;
equal scores are ordered by the earliest changed word, then by its own order; repeated rows
are encoded each; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgauge.llm.common import kept, map_rows

SPACE = "▁"
#: Cost of a character that has no piece, below the lowest score of a piece.
UNKNOWN = 10.0
#: Bytes of words and their ids, about, that a Python worker remembers besides those of the text at hand.
CACHE = 256 << 20
#: Bytes of a remembered word besides its characters and ids; bytes of a character with its ids.
ENTRY, CHARACTER = 190, 5
#: Words with their leading spaces; line ends and U+2581 alone.
WORDS = re.compile(r" *[^ \n▁]+|\n|▁| +")
#: Letters, and digits that aren't decimal ones.
LETTER = re.compile(r"[^\W\d_]")
N_BEST = 4
#: Characters of the words whose searches are remembered (some hundred bytes each).
SEARCHED = 40_000
#: The node of a trie below which there is nothing, and what a look-up gives for a character that begins no piece.
LEAF: dict = {}
NONE = (LEAF, None)


class Lattice:
    """The vocabulary of a SentencePiece model and searches over it."""

    def __init__(self, model: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.byte = {int(self.pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.plain = {self.pieces[i].replace(SPACE, " "): (i, sp.get_score(i)) for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        crossing = [p for p in self.plain if re.search(r"[^ ] |.\n|\n.", p)]
        if crossing:
            raise ValueError(f"pieces across the start of a space or a line end, as {crossing[0]!r}: words can't be searched apart")
        self.longest = max(map(len, self.plain))
        # placeholders of the trainer have extreme scores; they are pieces like others but no measure of the cost
        self.lowest = min(s for _, s in self.plain.values() if s > -1e8) - UNKNOWN
        back = {i: b for b, i in self.byte.items()}
        self.raw = [bytes([back[i]]) if i in back else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        self.prefixes = {p[:k] for p in self.plain for k in range(1, len(p) + 1)}
        #: A trie of the pieces: by character, the nodes below and the score (None of those that only begin a piece).
        self.walk: dict[str, tuple[dict, float | None]] = {}
        nodes = {"": self.walk}
        branch = {p[:-1] for p in self.prefixes}
        for p in sorted(self.prefixes, key=len):
            kids = nodes[p] = {} if p in branch else LEAF
            nodes[p[:-1]][p[-1]] = kids, self.plain[p][1] if p in self.plain else None
        # marks, each but behind letters (of the class below) that some piece has before it: a word ends there as far as pieces go
        joined = {m: sorted({a for p in self.plain for a, b in zip(p, p[1:], strict=False) if b == m and LETTER.match(a)}) for m in ".,!?;:|)"}
        marks = "|".join((f"(?<![{re.escape(''.join(a))}])" if a else "") + re.escape(m) for m, a in joined.items())
        self.tail = re.compile(rf"( *{LETTER.pattern}+)((?:{marks})[^ \n▁]*)")

    def edges(self, word: str) -> list[list[tuple[int, float, tuple[int, ...]]]]:
        """For each position the edges that end there: start, score, ids."""
        plain, prefixes, n = self.plain, self.prefixes, len(word)
        out: list[list[tuple[int, float, tuple[int, ...]]]] = [[] for _ in range(n + 1)]
        for i in range(n):
            single = False
            if word[i] != SPACE:
                for j in range(i + 1, min(n, i + self.longest) + 1):
                    got = plain.get(w := word[i:j])
                    if got:
                        out[j].append((i, got[1], (got[0],)))
                        single |= j == i + 1
                    elif w not in prefixes:
                        break
            if not single:
                out[i + 1].append((i, self.lowest, tuple(self.byte[b] for b in word[i].encode())))
        return out

    def n_best(self, word: str) -> Iterator[tuple[float, tuple[int, ...]]]:
        """Segmentations of a word from best to worst, in an order that any run repeats."""
        edges = self.edges(word)
        best = [0.0] + [-math.inf] * len(word)
        for j in range(1, len(best)):
            for i, s, _ in edges[j]:
                if best[i] + s > best[j]:
                    best[j] = best[i] + s
        count = 0
        # of equal scores the one nearest to the start goes on: else all ties would grow side by side
        todo = [(-best[-1], len(word), 0, 0.0, None)]
        while todo:
            _, at, _, done, path = heapq.heappop(todo)
            if not at:
                ids: list[int] = []
                while path:
                    ids += path[0]
                    path = path[1]
                yield done, tuple(ids)
                continue
            for i, s, own in edges[at]:
                count += 1
                heapq.heappush(todo, (-(done + s + best[i]), i, count, done + s, (own, path)))

    def best(self, word: str) -> tuple[float, tuple[int, ...], float]:
        """The best score, its ids, and by how much the second best falls short: a forward Viterbi
        that carries the two best scores to each position."""
        if word == SPACE:  # a character like others, but the vocabulary's sign for a space
            return self.lowest, tuple(self.byte[b] for b in word.encode()), math.inf
        root, n, low, lowest, reach = self.walk, len(word), -math.inf, self.lowest, self.longest
        fore, next_, via = [0.0] + [low] * n, [low] * (n + 1), [0] * (n + 1)
        for i in range(n):
            here, second = fore[i], next_[i]
            kids, s = root.get(word[i], NONE)
            j, t = i + 1, here + (lowest if s is None else s)
            if t > fore[j]:
                old, other = fore[j], second + (lowest if s is None else s)
                fore[j], via[j], next_[j] = t, i, old if old > other else other
            elif t > next_[j]:
                next_[j] = t
            if kids:
                for c in word[j : i + reach]:
                    j += 1
                    got = kids.get(c)
                    if got is None:
                        break
                    kids, s = got
                    if s is not None:
                        t = here + s
                        if t > fore[j]:
                            old, other = fore[j], second + s
                            fore[j], via[j], next_[j] = t, i, old if old > other else other
                        elif t > next_[j]:
                            next_[j] = t
        ids: list[int] = []
        j, plain = n, self.plain.get
        while j:
            i = via[j]
            got = plain(word[i:j])
            if got:
                ids.append(got[0])
            else:
                ids += [self.byte[b] for b in reversed(word[i:j].encode())]
            j = i
        ids.reverse()
        return fore[n], tuple(ids), fore[n] - next_[n]

    def decode(self, ids) -> str:
        """The text of ids; the space that encoding puts first goes again."""
        return self.raw_text(ids)[1:]

    def raw_text(self, ids) -> str:
        return self.raw_bytes(ids).decode("utf-8", "replace")

    def raw_bytes(self, ids) -> bytes:
        return b"".join(map(self.raw.__getitem__, ids))


def gives_back(lattice: Lattice, segmentations: list[tuple[float, bytes]], whole: bytes) -> bool:
    """Whether each of the segmentations decodes to ``whole``. Ids at the start and the end that
    one has in common with the first are compared, and decoded with the first only."""
    best, *others = (np.frombuffer(b, "<u4") for _, b in segmentations)
    if lattice.raw_bytes(best.tolist()) != whole:
        return False
    for ids in others:
        n = min(len(ids), len(best))
        off = np.flatnonzero(ids[:n] != best[:n])
        lo = int(off[0]) if len(off) else n
        off = np.flatnonzero(ids[len(ids) - n + lo :] != best[len(best) - n + lo :])
        hi = n - lo - 1 - int(off[-1]) if len(off) else n - lo
        if lattice.raw_bytes(ids[lo : len(ids) - hi].tolist()) != lattice.raw_bytes(best[lo : len(best) - hi].tolist()):
            return False
    return True


class Found:
    """Segmentations of a word from best to worst, as far as they were asked for."""

    def __init__(self, lattice: Lattice, word: str):
        self.more, self.got = lattice.n_best(word), []

    def get(self, k: int) -> tuple[float, tuple[int, ...]] | None:
        while len(self.got) <= k:
            nxt = next(self.more, None)
            if nxt is None:
                return None
            self.got.append(nxt)
        return self.got[k]


def _cost(words) -> int:
    return sum(ENTRY + CHARACTER * len(w) for w in words)


class Encoder:
    """Encodes texts; what it knows of words is kept in arrays of bounded size."""

    def __init__(self, model: str, n_best: int = N_BEST, cache: int | None = None):
        self.lattice, self.n, self.cache = Lattice(model), n_best, CACHE if cache is None else cache
        self.at: dict[str, int] = {}
        self.searches: dict[str, Found] = {}
        self.searched = 0
        self._empty()

    def _empty(self) -> None:
        """Best score, gap to the second best, uses, and where the ids begin and how many they are."""
        self.score, self.gap, self.hits = np.zeros(1024), np.zeros(1024), np.zeros(1024, np.int8)
        self.start, self.size, self.ids, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(8192, np.uint32), 0
        self.held = 0

    def _places(self, words: list[str]) -> np.ndarray:
        """The place of each word in the arrays."""
        idx = np.fromiter(map(self.at.get, words, repeat(-1)), np.int64, len(words))
        lack = np.flatnonzero(idx < 0).tolist()
        if lack:
            new = {words[k] for k in lack}
            if self.held + 2 * _cost(new) > self.cache:  # a word may bring its letters along
                self._forget(set(words))
                new, lack = set(words).difference(self.at), range(len(words))
            for w in new:
                if w not in self.at:  # it may have come with another word
                    self._add(w)
            idx[lack] = [self.at[words[k]] for k in lack]
        self.hits[idx] = np.minimum(self.hits[idx] + 1, 2)
        return idx

    def _add(self, w: str) -> int:
        """Search a word, or put it together from its letters and the marks behind them."""
        m = self.lattice.tail.fullmatch(w)
        if m:
            a, b = (self.at[x] if x in self.at else self._add(x) for x in m.groups())
            score, gap = self.score[a] + self.score[b], min(self.gap[a], self.gap[b])
            ids = [*self._own(a), *self._own(b)]
        else:
            score, ids, gap = self.lattice.best(w)
            if self.lattice.raw_text(ids) != w:
                raise AssertionError(f"{w!r} doesn't decode to itself")
        return self._put(w, score, gap, ids)

    def _own(self, k: int) -> list[int]:
        return self.ids[self.start[k] : self.start[k] + self.size[k]].tolist()

    def _put(self, w: str, score: float, gap: float, ids) -> int:
        k = self.at[w] = len(self.at)
        if k == len(self.score):
            self.score, self.gap, self.hits, self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.score, self.gap, self.hits, self.start, self.size))
        n = len(ids)
        while self.used + n > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + n] = ids
        self.score[k], self.gap[k], self.hits[k], self.start[k], self.size[k] = score, gap, 0, self.used, n
        self.used += n
        self.held += ENTRY + CHARACTER * len(w)
        return k

    def _forget(self, now: set[str]) -> None:
        """Keep words of this text, and those seen in two texts or more since the last time, if they are few."""
        kept = [(w, k) for w, k in self.at.items() if self.hits[k] > 1 or w in now]
        if _cost(w for w, _ in kept) > self.cache // 2:
            kept = [(w, k) for w, k in kept if w in now]
        words, at = [w for w, _ in kept], np.array([k for _, k in kept], np.int64)
        del kept
        size = self.size[at]
        ends = np.cumsum(size)
        self.ids = self.ids[np.repeat(self.start[at] - ends + size, size) + np.arange(size.sum())]
        self.score, self.gap, self.hits, self.start, self.size = self.score[at], self.gap[at], np.zeros(len(at), np.int8), ends - size, size
        self.used, self.held = len(self.ids), _cost(words)
        self.at = dict(zip(words, range(len(words)), strict=True))
        for name in ("score", "gap", "hits", "start", "size", "ids"):  # room to grow by doubling
            x = getattr(self, name)
            setattr(self, name, np.concatenate([x, np.zeros(max(1024, len(x) // 4), x.dtype)]))

    def search(self, word: str) -> Found:
        got = self.searches.get(word)
        if got is None:
            self.searched += len(word)
            if self.searched > SEARCHED:
                self.searches.clear()
                self.searched = len(word)
            got = self.searches[word] = Found(self.lattice, word)
        return got

    def encode(self, text: str | None) -> tuple[list[tuple[float, bytes]], list[tuple[str, tuple[int, ...]]]]:
        """The best segmentations of a whole text, best first, as score and ids (little-endian
        unsigned 32-bit), and the words that some of them cut in another way."""
        words = WORDS.findall(" " + text) if text else []
        if not words:
            return [(0.0, b"")], []
        idx = self._places(words)
        score, size = float(self.score[idx].sum()), self.size[idx]
        ends = np.cumsum(size)
        best = self.ids[np.repeat(self.start[idx] - ends + size, size) + np.arange(ends[-1])]
        out, changed = [(score, best.tobytes())], []
        if self.n == 1:
            return out, changed
        gaps = self.gap[idx]
        k = min(self.n - 1, len(gaps))
        near = np.flatnonzero(gaps <= np.partition(gaps, k - 1)[k - 1])
        pos = sorted(near[np.lexsort((near, gaps[near]))][:k].tolist())
        found = [self.search(words[p]) for p in pos]
        # best first over choices of a segmentation for each of these words
        todo = [(0.0, (0,) * k)]
        seen = {todo[0][1]}
        while todo:
            loss, choice = heapq.heappop(todo)
            if any(choice):
                data, cut = [], 0
                for p, f, c in zip(pos, found, choice, strict=True):
                    if c:
                        ids = f.get(c)[1]
                        changed.append((words[p], ids))
                        data += [best[cut : ends[p] - size[p]], np.array(ids, np.uint32)]
                        cut = ends[p]
                out.append((score - loss, np.concatenate([*data, best[cut:]]).tobytes()))
                if len(out) == self.n:
                    break
            for i, f in enumerate(found):
                nxt = (*choice[:i], choice[i] + 1, *choice[i + 1 :])
                if nxt not in seen and f.get(nxt[i]):
                    seen.add(nxt)
                    heapq.heappush(todo, (sum(g.get(0)[0] - g.get(c)[0] for g, c in zip(found, nxt, strict=True)), nxt))
        return out, changed


def encoder(model: str, n_best: int, cache: int | None = None) -> Encoder:
    """A Python worker keeps what it knows of words from task to task."""
    return kept(("pieces", model, n_best, cache), lambda: Encoder(model, n_best, cache))


def segmentations(got: list[list[tuple[float, bytes]]]) -> pa.Array:
    """Arrays of (score, ids), built from the bytes of the ids."""
    flat = [x for row in got for x in row]
    ids = pa.Array.from_buffers(pa.int32(), sum(len(b) for _, b in flat) // 4, [None, pa.py_buffer(b"".join(b for _, b in flat))])
    ends = lambda sizes: pa.array(np.cumsum([0, *sizes]), pa.int32())
    lists = pa.ListArray.from_arrays(ends(len(b) // 4 for _, b in flat), ids)
    rows = pa.StructArray.from_arrays([pa.array([s for s, _ in flat], pa.float64()), lists], ["score", "ids"])
    return pa.ListArray.from_arrays(ends(map(len, got)), rows)


def n_best_pieces(docs: DataFrame, model: str, n_best: int = N_BEST, cache: int | None = None) -> DataFrame:
    """doc_id, ``nbest``, an array of (score, ids), best first, and whether all of them decode to the
    text (``exact``)."""

    def make():
        enc = encoder(model, n_best, cache)

        def step(cols):
            got = [enc.encode(t)[0] for t in cols["text"]]
            exact = [gives_back(enc.lattice, x, (" " + t).encode() if t else b"") for x, t in zip(got, cols["text"], strict=True)]
            return {"doc_id": cols["doc_id"], "nbest": segmentations(got), "exact": exact}

        return step

    return map_rows(_rows(docs), "doc_id long, nbest array<struct<score: double, ids: array<int>>>, exact boolean", make)


def decoded(ids: DataFrame, model: str) -> DataFrame:
    """doc_id and text of rows with doc_id and ids."""

    def make():
        lattice = Lattice(model)
        return lambda cols: {"doc_id": cols["doc_id"], "text": [lattice.decode(x or []) for x in cols["ids"]]}

    return map_rows(ids.select("doc_id", "ids"), "doc_id long, text string", make)


def piece_digests(docs: DataFrame, model: str, n_best: int = N_BEST) -> DataFrame:
    """Encode each whole text, decode its segmentations again, and describe both."""

    def make():
        enc = encoder(model, n_best)
        lattice = enc.lattice

        def step(cols):
            out: dict[str, list] = {k: [] for k in ("n_pieces", "ids_crc32", "best_score", "scores", "nbest_crc32", "exact")}
            for t in cols["text"]:
                got = enc.encode(t)[0]
                whole = (" " + t).encode() if t else b""
                out["n_pieces"].append(len(got[0][1]) // 4)
                out["ids_crc32"].append(zlib.crc32(got[0][1]))
                out["best_score"].append(got[0][0])
                out["scores"].append([s for s, _ in got])
                out["nbest_crc32"].append([zlib.crc32(b) for _, b in got])
                out["exact"].append(gives_back(lattice, got, whole))
            return {"doc_id": cols["doc_id"]} | out

        return step

    return map_rows(_rows(docs), "doc_id long, n_pieces long, ids_crc32 long, best_score double, scores array<double>, nbest_crc32 array<bigint>, exact boolean", make)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
