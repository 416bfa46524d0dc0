"""Connected components of a graph by alternating star contraction, in DataFrame operations."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from flowgauge.llm.common import delete, written_at

#: Edges that one task may hold (some 200 bytes each): so small a graph isn't worth any rounds.
SMALL = 250_000


def connected_components(edges: DataFrame, name: str = "components", small: int = SMALL) -> DataFrame:
    """``(node, root)`` of every node of ``edges`` (columns a, b); root is the smallest node.

    Each round links all neighbours of a node to its smallest neighbour, first the larger
    ones, then the smaller ones, until nothing changes: a number of rounds that grows with
    the logarithm of the graph. Each round is written to the shared folder, and deleted once
    the next one is. Minima are pre-aggregated before the shuffle, so a hub costs one row per
    task. A graph of at most ``small`` edges is done in one task instead, with the same result.
    Null ends and loops are ignored; an empty graph has no components.
    """
    spark = edges.sparkSession
    pairs = edges.where("a is not null and b is not null and a <> b")
    star, at = written_at(pairs.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), name)
    state = _state(star)
    if state[0] <= small:
        return _in_one_task(star)
    while True:
        both = star.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(star.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        least, least_at = written_at(least, name)  # so that Spark can split the neighbours of a hub over tasks
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        under = large.join(low, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        star, new_at = written_at(low.select("hi", F.col("m").alias("lo")).union(under).distinct(), name)
        for old in (at, least_at):
            delete(spark, old)
        at = new_at
        before, state = state, _state(star)
        if state == before:
            break
    nodes = star.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return nodes.union(star.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())


def _in_one_task(star: DataFrame) -> DataFrame:
    kind = star.schema["hi"].dataType
    schema = T.StructType([T.StructField("node", kind), T.StructField("root", kind)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict = {}

        def find(x):
            while (y := up.setdefault(x, x)) != x:
                up[x] = x = up.setdefault(y, y)
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = find(a), find(b)
                if a != b:
                    up[max(a, b)] = min(a, b)
        nodes = list(up)
        for k in range(0, len(nodes), 10_000):
            part = nodes[k : k + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((part, map(find, part)), arrow, strict=True)], schema=arrow)

    return star.repartition(1).mapInArrow(run, schema)


def _state(star: DataFrame) -> tuple:
    row = star.agg(F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("s")).head()
    return row.n, row.s
