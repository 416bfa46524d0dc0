"""Operator 2: mixing sources to target weights by Poisson replication, in DataFrame functions.

A source's rate is the mean number of copies of its documents that gives the source its
share of the mixture. A document's uniform number comes from a hash of seed and doc_id; the
inverse Poisson distribution at that number is its count of copies. Copies are exploded and
sorted by a hash of seed, doc_id and copy, which is a global shuffle that any run repeats.

Sizes are counted in characters, over all rows. Sources without a stated weight have
weight 1. Nulls and edge cases: a null source is a source of its own; null texts have size
0; a source of size 0 has rate 0; a null doc_id hashes as an empty string; repeated rows
draw the same count; an empty table gives an empty mixture; further columns are carried
along, but for ``copy``, ``order_key`` and names that begin with ``mix_``, which are replaced.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgauge.llm.common import written

#: A rate is split into equal parts of at most this; sums of Poisson numbers are Poisson.
PART = 16.0
#: Beyond this count the distribution at PART lacks less than the spacing of the uniform numbers.
TOP = 80
#: Sources whose rates may be broadcast.
BROADCAST_SOURCES = 10_000
#: Parts into which each source is dealt when rates aren't broadcast.
SALTS = 64


def uniform(*parts):
    """A number in (0, 1) from the first 52 bits of a hash of ``parts``."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / F.lit(float(1 << 52))


def source_rates(docs: DataFrame, weights: Mapping[str | None, float], size: float | None) -> DataFrame:
    """source, parts, cdf: how many Poisson numbers to add and their distribution function."""
    chars = F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("long"))
    stats = written(docs.groupBy("source").agg(chars.alias("chars")), "sources")  # one pass over the texts
    weight = F.lit(1.0)
    for name, w in weights.items():
        weight = F.when(F.col("source").isNull() if name is None else F.col("source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(weight)
    stats = stats.select("source", "chars", F.when(F.col("chars") > 0, weight).otherwise(0.0).alias("weight"))
    total = stats.agg(F.sum("weight").alias("weight"), F.sum("chars").alias("chars")).first()
    target = F.lit(float(total.chars or 0) if size is None else float(size))
    rate = F.when(F.col("weight") > 0, F.col("weight") / F.lit(float(total.weight or 0)) * target / F.col("chars")).otherwise(0.0)
    rates = stats.select("source", rate.alias("rate"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / PART)).cast("int")
    rates = rates.select("source", "rate", parts.alias("parts"), (F.col("rate") / parts).alias("mean"))
    term = F.aggregate(
        F.sequence(F.lit(1), F.lit(TOP)),
        F.struct(F.exp(-F.col("mean")).alias("p"), F.array(F.exp(-F.col("mean"))).alias("cdf")),
        lambda a, k: F.struct((a["p"] * F.col("mean") / k).alias("p"), F.concat(a["cdf"], F.array(F.element_at(a["cdf"], -1) + a["p"] * F.col("mean") / k)).alias("cdf")),
    )
    return rates.select("source", "rate", "parts", term["cdf"].alias("cdf"))


def mix(docs: DataFrame, weights: Mapping[str | None, float], size: float | None = None, seed: int = 0) -> DataFrame:
    """The mixture of about ``size`` characters (as many as ``docs`` has, if None): the columns of
    ``docs``, the number of the ``copy`` and the ``order_key`` by which rows are sorted."""
    columns = [c for c in docs.columns if c.lower() not in ("copy", "order_key") and not c.lower().startswith("mix_")]
    docs = docs.select(columns)
    rates = source_rates(docs, weights, size)
    few = rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    if few:
        joined = docs.join(F.broadcast(rates.withColumnsRenamed({c: f"mix_{c}" for c in rates.columns})), F.col("source").eqNullSafe(F.col("mix_source")))
    else:  # a large source is dealt over SALTS partitions
        salted = rates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnsRenamed({c: f"mix_{c}" for c in rates.columns} | {"salt": "mix_salt"})
        salt = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(SALTS)).cast("int")
        joined = docs.join(salted, F.col("source").eqNullSafe(F.col("mix_source")) & (salt == F.col("mix_salt")))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    numbers = F.transform(F.sequence(F.lit(1), F.col("mix_parts")), lambda part: uniform(F.lit(str(seed)), part.cast("string"), key))
    count = F.aggregate(numbers, F.lit(0), lambda n, u: n + F.size(F.filter("mix_cdf", lambda c: c <= u)))
    copies = joined.withColumn("mix_n", count).where("mix_n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix_n").cast("long"))))
    order = F.substring(F.md5(F.concat_ws(":", F.lit(f"order {seed}"), key, F.col("copy").cast("string"))), 1, 16)
    return copies.select(*columns, "copy", order.alias("order_key")).orderBy("order_key", "doc_id", "copy")


def oracle(weights: Mapping[str, float], seed: int, table: str = "documents") -> str:
    """DuckDB SQL for doc_id, source, copy and order_key of the mixture of ``table``."""
    cases = " ".join(f"WHEN source = '{k}' THEN {float(v)!r}" for k, v in weights.items())
    weight = f"CASE {cases} ELSE 1.0 END" if cases else "1.0"
    u = f"((('0x' || substr(md5(concat_ws(':', '{seed}', part::VARCHAR, coalesce(doc_id::VARCHAR, ''))), 1, 13))::BIGINT)::DOUBLE + 0.5) / {1 << 52}.0::DOUBLE"
    return f"""
WITH stats AS (SELECT source, sum(coalesce(length(text), 0)) AS chars FROM {table} GROUP BY source),
weighed AS (SELECT source, chars, CASE WHEN chars > 0 THEN ({weight})::DOUBLE ELSE 0.0 END AS weight FROM stats),
rated AS (SELECT source, CASE WHEN weight > 0 THEN weight / (SELECT sum(weight) FROM weighed) * (SELECT sum(chars) FROM weighed)::DOUBLE / chars::DOUBLE ELSE 0.0 END AS rate FROM weighed),
means AS (SELECT source, greatest(1, ceil(rate / {PART}))::INTEGER AS parts, rate / greatest(1, ceil(rate / {PART})) AS mean FROM rated),
terms AS (SELECT source, k, list_reduce(list_prepend(exp(-mean), range(1, k + 1)::DOUBLE[]), lambda a, i: a * mean / i) AS p FROM means, range(0, {TOP + 1}) t(k)),
cdf AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms),
drawn AS (SELECT doc_id, d.source, part, {u} AS u FROM {table} d JOIN means m ON d.source IS NOT DISTINCT FROM m.source, unnest(range(1, parts + 1)) x(part)),
counted AS (SELECT doc_id, source, sum(n) AS n FROM (SELECT doc_id, source, part, (SELECT count(*) FROM cdf WHERE cdf.source IS NOT DISTINCT FROM drawn.source AND c <= u) AS n FROM drawn) GROUP BY doc_id, source)
SELECT doc_id, source, copy, substr(md5(concat_ws(':', 'order {seed}', coalesce(doc_id::VARCHAR, ''), copy::VARCHAR)), 1, 16) AS order_key
FROM counted, unnest(range(1, n::BIGINT + 1)) y(copy)"""
