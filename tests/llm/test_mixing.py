import hashlib
import math

import pytest
from pyspark.sql import functions as F

from flowgauge.llm import mixing


def brute(rows, weights, size, seed):
    """Copies per row, from the definition."""
    chars = {}
    for _, t, s in rows:
        chars[s] = chars.get(s, 0) + len(t or "")
    weight = {s: float(weights.get(s, 1.0)) if c else 0.0 for s, c in chars.items()}
    target = sum(chars.values()) if size is None else size
    out = []
    for i, _, s in rows:
        rate = weight[s] / sum(weight.values()) * target / chars[s] if weight[s] else 0.0
        parts = max(1, math.ceil(rate / 16))
        n = 0
        for part in range(1, parts + 1):
            u = (int(hashlib.md5(f"{seed}:{part}:{'' if i is None else i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            p = cdf = math.exp(-rate / parts)
            k = 0
            while cdf <= u and k < 200:
                k += 1
                p *= rate / parts / k
                cdf += p
                n += 1
        out.append(n)
    return out


ROWS = [(k, "x" * (k % 7), ("a", "b", None)[k % 3]) for k in range(300)] + [(None, "no id", "a"), (5, None, "c"), (6, "", "c"), (7, "tiny source", "d"), (7, "tiny source", "d")]


@pytest.mark.parametrize("size", [None, 3000, 40_000])
@pytest.mark.parametrize("joined", [False, True])
def test_counts(spark, monkeypatch, size, joined):
    if joined:
        monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 1)
    weights = {"a": 3.0, None: 0.5, "d": 0.25}
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string").repartition(3)
    got = {}
    for r in mixing.mix(df, weights, size, 11).groupBy("doc_id", "text", "source").count().collect():
        got[r.doc_id, r.text, r.source] = r["count"]
    want = {}
    for row, n in zip(ROWS, brute(ROWS, weights, size, 11), strict=True):
        if n:
            want[row] = want.get(row, 0) + n
    assert got == want


def test_shares_and_order(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("word").alias("text"), F.when(F.col("id") % 10 < 9, "big").otherwise("small").alias("source"))
    rows = mixing.mix(df, {"big": 1.0, "small": 1.0}, None, 3).select("doc_id", "source", "copy", "order_key").collect()
    small = sum(r.source == "small" for r in rows)
    assert abs(small - 10_000) < 500 and abs(len(rows) - 20_000) < 700
    assert [r.order_key for r in rows] == sorted(r.order_key for r in rows)
    assert abs(sum(r.source == "small" for r in rows[: len(rows) // 2]) / small - 0.5) < 0.03
    assert rows == mixing.mix(df.repartition(7), {"big": 1.0, "small": 1.0}, None, 3).select("doc_id", "source", "copy", "order_key").collect()


def test_odd_rows(spark, odd_docs):
    out = mixing.mix(odd_docs, {}, 10**7, 1)
    assert set(odd_docs.columns) - {"mix_n", "mix_cdf"} <= set(out.columns)
    assert dict(out.dtypes)["copy"] == "bigint" and out.where("source = 's'").count() > 0
    assert mixing.mix(odd_docs.limit(0), {}).count() == 0


def test_no_python_in_the_plan(spark, odd_docs):
    plan = mixing.mix(odd_docs, {})._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
