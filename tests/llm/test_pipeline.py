import os
from collections import Counter

import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline
from flowgauge.llm import mixing, pieces, quality
from flowgauge.llm.common import written
from flowgauge.llm.queries import PIECES, SEED, WEIGHTS
from tests.llm.conftest import brute_components
from tests.llm.test_mixing import brute as brute_mix

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], SF), name.replace(" ", "-")))
    return out


def ids(df):
    return Counter(r.doc_id for r in df.select("doc_id").collect())


def test_stages(spark, steps):
    docs, known, good, single, mixed, encoded = steps
    for df in steps[1:5]:
        assert df.dtypes == docs.dtypes
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert ids(known) == Counter(i for i, t in texts.items() if any(map(str.isalpha, t or "")))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(known, labels)
    keep = lambda t: (lambda f: model.score(np.array([f[1]]))[0] >= 0.5 and not (f[0][0] < 10 or 100 * f[0][4] > 20 * f[0][0]))(quality.features(t))
    assert ids(good) == Counter(i for i in ids(known) if keep(texts[i]))
    order = sorted(ids(good))
    _, comps = brute_components([texts[i] for i in order], 5, 80)
    assert ids(single) == Counter(i for k, i in enumerate(order) if comps[k] == k)
    rows = [(r.doc_id, r.text, r.source) for r in single.collect()]
    assert ids(mixed) == Counter(dict(zip([r[0] for r in rows], brute_mix(rows, WEIGHTS, None, SEED), strict=True))) + Counter()
    enc = pieces.Encoder(PIECES, 1)
    got = encoded.collect()
    assert Counter(r.doc_id for r in got) == ids(mixed)
    for r in got:
        assert enc.lattice.decode(r.ids) == texts[r.doc_id]


def test_n_best_segmentations(steps):
    """The last stage does the whole operator: N-best lists, each decoded again."""
    enc, texts = pieces.Encoder(PIECES), {r.doc_id: r.text for r in steps[0].collect()}
    rows = steps[-1].collect()
    assert max(len(r.nbest) for r in rows) == pieces.N_BEST
    for r in rows:
        want = enc.encode(texts[r.doc_id])[0]
        assert [s.score for s in r.nbest] == pytest.approx([s for s, _ in want])
        assert [s.ids for s in r.nbest] == [np.frombuffer(b, "<u4").tolist() for _, b in want]
        assert r.ids == r.nbest[0].ids and r.exact and {enc.lattice.decode(s.ids) for s in r.nbest} == {texts[r.doc_id]}


def test_clean_documents_stay(spark, steps):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = ids(steps[2])
    clean = [i for i, q in labels.items() if q == 1]
    assert sum(i in kept for i in clean) >= 0.95 * len(clean)


def test_run(spark, steps):
    assert ids(corpus_pipeline.run(spark, SF)) == ids(steps[-1])


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and sum(n.startswith("op") and n[2].isdigit() for n in names) == 10
    assert mixing.oracle(WEIGHTS, SEED) in __spark_entry__.oracle_sql()["op2_poisson_mixing"]
