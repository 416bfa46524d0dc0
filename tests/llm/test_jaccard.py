import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from flowgauge.llm import common, graph, jaccard
from tests.llm.conftest import ODD, brute_components


def as_ids(ids, sets, comps):
    least = {}
    for k, c in enumerate(comps):
        if ids[k] is not None:
            least[c] = min(least.get(c, ids[k]), ids[k])
    return sorted(((ids[k], len(sets[k]), least.get(c)) for k, c in enumerate(comps)), key=repr)


def check(spark, rows, n, percent, parts=5, **sizes):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    got = sorted(map(tuple, jaccard.ngram_components(df, n, percent, **sizes).collect()), key=repr)
    assert got == as_ids([r[0] for r in rows], *brute_components([r[1] for r in rows], n, percent))
    return got


def near_copies(rng, groups, most):
    """Groups of documents with a few changed, added or dropped words each."""
    vocab = [f"w{k}" for k in range(4000)]
    common = rng.choices(vocab, k=60)
    texts = []
    for _ in range(groups):
        base = rng.choices(vocab, k=rng.choice([3, 9, 12, 20, 40, 100, 300]))
        if rng.random() < 0.4:
            base += common
        for _ in range(rng.randrange(1, most)):
            words = list(base)
            for _ in range(rng.randrange(4)):
                k = rng.randrange(len(words))
                words[k : k + 1] = rng.choice([[], [rng.choice(vocab)], [words[k], "extra"]])
            texts.append(" ".join(words))
    return texts


@pytest.mark.parametrize(("n", "percent", "seed"), [(3, 90, 1), (5, 80, 2), (2, 60, 3), (1, 95, 4)])
def test_as_brute_force(spark, n, percent, seed):
    rng = random.Random(seed)
    texts = near_copies(rng, 40, 9)
    rows = list(enumerate(texts)) + [(5000 + k, rng.choice(texts)) for k in range(30)]
    rng.shuffle(rows)
    got = check(spark, rows, n, percent)
    assert len({c for *_, c in got}) < len(rows) - 30  # near copies were found, too


@pytest.mark.parametrize("changes", [1, 3])
def test_blocks(spark, changes):
    """Clusters of many blocks: near copies that mostly link with a pivot, and such that mostly don't."""
    check(spark, list(enumerate(near_copies(random.Random(7), 8, 30))), 3, 90, block=300)
    rows = one_group(random.Random(9), 120, changes) + [(1000 + k, "all other words in this one here") for k in range(3)]
    got = check(spark, rows, 3, 90, block=1500)
    assert changes > 1 or len({c for k, _, c in got if k < 1000}) == 1


def one_group(rng, n, changes):
    base = [f"w{k}" for k in range(80)]
    texts = []
    for _ in range(n):
        words = list(base)
        for _ in range(changes):
            words[rng.randrange(80)] = f"x{rng.randrange(30)}"
        texts.append(" ".join(words))
    return list(enumerate(texts))


def test_one_large_group(spark):
    check(spark, one_group(random.Random(8), 400, 1), 3, 90)


def test_peers_whose_holder_is_left_out(spark):
    """Three documents of one file, a fourth in another: 3 and 4 link, though 1 and 2 hold what they share."""
    rows = [
        (1, "w937544 w390602 w414274 w35559 w775849 w115534 w182685 w971695 w89730 w864583 w422029 w549170"),
        (2, "w775809 w145689 w462309 w698585 w581010 w573817 w885180 w478367 w710285 w388501 w449009 w978851"),
        (3, "w115534 w182685 w971695 w573817 w885180 w478367 w35935 w518618 w19835 w512413 w284473 w532532"),
        (4, "w115534 w182685 w971695 w573817 w885180 w478367 w35935 w518618 w19835 w512413 w284473 w532532 w840471"),
    ]
    schema = "doc_id long, text string"
    first, second = spark.createDataFrame(rows[:3], schema).coalesce(1), spark.createDataFrame(rows[3:], schema).coalesce(1)
    want = [(1, 1), (2, 2), (3, 3), (4, 3)]
    for docs in (first.union(second), first.union(second).coalesce(1), first.union(second).repartition(4)):
        got = jaccard.ngram_components(docs).orderBy("doc_id").collect()
        assert [(r.doc_id, r.component_id) for r in got] == want


@pytest.mark.parametrize("seed", range(6))
def test_any_partitioning(spark, seed):
    """Short texts that share phrases, in pools of a few signatures each: the same links however rows are dealt."""
    rng = random.Random(100 + seed)
    phrases = [" ".join(f"p{rng.randrange(400)}" for _ in range(3)) for _ in range(25)]
    texts = [" ".join(rng.choices(phrases, k=rng.choice([3, 4, 4, 5, 8, 12]))) for _ in range(90)]
    texts += [t + f" w{rng.randrange(9)}" for t in rng.sample(texts, 45)] + [" ".join(t.split()[1:]) for t in rng.sample(texts, 25)]
    rng.shuffle(texts)
    sizes = {"pool": rng.choice([1, 20, 60, 200, 1_000_000])}
    check(spark, list(enumerate(texts)), 3, rng.choice([80, 90]), parts=rng.choice([1, 2, 3, 7, 16]), **sizes)


def test_odd_rows(spark, odd_docs):
    got = sorted(map(tuple, jaccard.ngram_components(odd_docs).collect()), key=repr)
    assert got == as_ids([r[0] for r in ODD], *brute_components([r[1] for r in ODD], 3, 90))
    assert jaccard.ngram_components(odd_docs.limit(0)).count() == 0
    assert (3, 0, 3) in got and (5, 0, 5) in got


def test_document_without_id_links_others(spark):
    words = [f"w{k}" for k in range(60)]
    change = lambda *at: " ".join("x%d" % k if k in at else w for k, w in enumerate(words))
    rows = [(1, change()), (None, change(0)), (2, change(0, 59)), (3, "other text altogether")]
    check(spark, rows, 3, 95)


def test_one_of_each(spark, odd_docs):
    kept = jaccard.one_of_each(odd_docs, 5, 80)
    assert kept.columns == odd_docs.columns
    assert sorted(kept.collect(), key=repr) and sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "2", "3", "None", "5", "6", "7", "8", "10", "-4"])


@settings(max_examples=200, database=None, deadline=None)
@given(st.lists(st.sets(st.integers(0, 14), min_size=1), min_size=1, max_size=14), st.integers(50, 95), st.booleans())
def test_prefix_tree(sets, percent, two):
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    sides = [k % 2 for k in range(len(sets))] if two else None
    root = list(range(len(sets)))
    find = lambda r, x: x if r[x] == x else find(r, r[x])
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 100 * len(a & b) >= percent * len(a | b) and (not two or sides[i] != sides[j]):
                x, y = find(root, i), find(root, j)
                root[max(x, y)] = min(x, y)
    got = list(range(len(sets)))
    for i, j in jaccard.join_group(arrays, sides, percent):
        assert 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])
        x, y = find(got, i), find(got, j)
        assert x != y
        got[max(x, y)] = min(x, y)
    assert [find(got, k) for k in range(len(sets))] == [find(root, k) for k in range(len(sets))]


@settings(max_examples=300, database=None, deadline=None)
@given(st.integers(1, 400), st.integers(0, 12), st.integers(0, 12), st.sampled_from([80, 90]), st.integers(0, 1 << 30))
def test_signatures_meet(common, extra_a, extra_b, percent, seed):
    """Two sets over the threshold share as many signatures of a level as either needs."""
    rng = np.random.default_rng(seed)
    h = rng.integers(0, 1 << 63, common + extra_a + extra_b).astype(np.uint64) * np.uint64(2)
    h = np.unique(h)
    a, b = np.sort(h[: common + extra_a]), np.sort(np.concatenate([h[:0], h[extra_a:]]))
    both = len(np.intersect1d(a, b))
    if 100 * both < percent * (len(a) + len(b) - both) or np.array_equal(a, b):
        return
    levels = jaccard.Levels(percent)
    x, y = list(levels.sign(a)), list(levels.sign(b))
    shared = [len(np.intersect1d(s, t)) for _, s in x for _, t in y]
    assert any(n >= max(p, q) for n, (p, q) in zip(shared, [(p, q) for p, _ in x for q, _ in y], strict=True))


def test_holders_left_out(spark):
    """Classes 4 and 5 share two signatures, held in the first pool by classes that share too few."""
    pools = [{1: [10, 91], 2: [11, 92], 4: [10, 11]}, {5: [10, 11]}]
    rows = []
    for pool in pools:
        wait = jaccard.Pool()
        for h1, sigs in pool.items():
            wait.add(h1, 10, (h1, h1), [(2, np.array(sigs, np.uint64))])
        rows += wait.flush().to_pylist()
    assert wait.total == 0 and [r["h1"] for r in rows] == [1, 2, 4, 5]
    signed = spark.createDataFrame(rows, jaccard.SIGNED_SCHEMA)
    root = {r.node: r.root for r in graph.connected_components(jaccard.candidate_edges(signed)).collect()}
    assert 4 in root and root[4] == root.get(5)


@settings(max_examples=200, database=None, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 9)), max_size=40))
def test_pooled(rows):
    owners, sigs = np.array([o for o, _ in rows], np.int64), np.array([x for _, x in rows], np.uint64)
    first = {}
    for o, x in rows:
        first.setdefault(x, o)
    has, peer, held = jaccard.pooled(owners, sigs)
    seen = set()
    for k, (_, x) in enumerate(rows):
        many = sum(y == x for _, y in rows) > 1
        assert (bool(has[k]), bool(held[k])) == (many and x in seen, many and x not in seen)
        assert peer[k] == first[x]
        seen.add(x)


@pytest.mark.parametrize("small", [0, 10_000])
def test_components(spark, small):
    edges = [(k, k + 1) for k in range(100, 140)] + [(7, 9), (9, 8), (5, 5), (None, 3), (7, 9)] + [(1000, k) for k in range(1001, 1200)]
    got = {r.node: r.root for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long"), small=small).collect()}
    assert got == {k: 100 for k in range(100, 141)} | {7: 7, 8: 7, 9: 7} | {k: 1000 for k in range(1000, 1200)}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long"), small=small).count() == 0
    keys = spark.createDataFrame([(b"\x80x", b"a"), (b"a", b"\xff"), (b"q", b"r")], "a binary, b binary")
    assert {bytes(r.node): bytes(r.root) for r in graph.connected_components(keys, small=small).collect()} == {b"\x80x": b"a", b"a": b"a", b"\xff": b"a", b"q": b"q", b"r": b"q"}


def shuffle_files(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {found.apply(k).getName() for k in range(found.size()) if found.apply(k).getName().startswith("shuffle_")}


def test_written_tables_leave_no_shuffle_files(spark):
    before, kept = shuffle_files(spark), spark.conf.get(common.CLEANUP)
    table = common.written(spark.range(1000).repartition(3, "id"), "test")
    end = time.time() + 20
    while shuffle_files(spark) - before and time.time() < end:
        time.sleep(0.1)
    assert not shuffle_files(spark) - before and spark.conf.get(common.CLEANUP) == kept
    assert table.count() == 1000


def test_signatures_meet_in_parts(spark, monkeypatch):
    """Parts of about the same size, whose links are all links; the table of all signatures goes."""
    tables, gone = [], []
    write, drop = jaccard.written_at, jaccard.delete
    monkeypatch.setattr(jaccard, "PART_GRAMS", 100)
    monkeypatch.setattr(jaccard, "written_at", lambda df, name: tables.append((name, *write(df, name))) or tables[-1][1:])
    monkeypatch.setattr(jaccard, "delete", lambda session, folder: gone.append(folder) or drop(session, folder))
    rng = random.Random(7)
    words = [f"w{k}" for k in range(400)]
    texts = [rng.choices(words, k=40) for _ in range(12)]
    rows = [(k, " ".join([*texts[k % 12][: 40 - k % 3], *["new"] * (k % 3)])) for k in range(60)]
    check(spark, rows, 3, 80, pool=1)
    assert [name for name, *_ in tables] == ["signed"] + ["shared"] * (1 + jaccard.PARTS)
    assert sorted(gone) == sorted(folder for *_, folder in tables)
