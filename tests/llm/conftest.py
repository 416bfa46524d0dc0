import public_tokenizers
import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def bpe():
    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def pieces_model():
    return public_tokenizers.path("piece_bpe_32k.model")


ODD = [
    (1, "The cat sat on the mat.\nThe cat ate."), (2, None), (3, ""), (None, "no id at all, but some words"), (5, "   \n\t "), (6, "x" * 70_000), (7, "Ünïcode ▁ 日本語 \U0001f600 <|endoftext|>"),
    (8, "again and again and again"), (8, "again and again and again"), (9, "again and again and again"), (10, "word " * 30_000), (-4, "\r\n \x0b a  b "),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, repeated rows, and further columns."""
    rows = spark.createDataFrame(ODD, "doc_id long, text string")
    names = ["kept", "score", "h1", "first", "copy", "order_key", "mix_n", "mix_cdf", "term", "level", "ids", "media", "lang_pred", "node", "block"]
    return rows.withColumn("lang", F.when(F.col("doc_id") > 5, "en")).withColumn("source", F.when(F.col("doc_id") != 7, "s")).withColumns({c: F.lit("z") for c in names}).repartition(3)


def brute_components(texts, n, percent):
    """Component of each position by comparing all pairs."""
    import re

    word = re.compile(r"[^\x20\x09-\x0D]+")
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for t in texts:
        w = word.findall((t or "").translate(lower))
        k = min(n, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sets, [find(i) for i in range(len(sets))]
