"""Two prompt variants side by side, scored in one plan."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgauge.operators.metrics import metric
from flowgauge.plans.evaluate import Options, evaluate

VARIANTS = ("enhanced", "standard")


def compare_metrics(micro: DataFrame, variants: tuple[str, str] = VARIANTS) -> DataFrame:
    """From micro metrics with ``variant``: both variants' metrics and their difference in F1."""
    a, b = variants
    pick = lambda v, t, c: F.max(F.when((F.col("variant") == v) & (F.col("target") == t), F.col(c)))
    both = {v: F.struct(*(metric(*(pick(v, t, c) for c in ("tp", "fp", "fn"))).alias(t) for t in ("entities", "relations"))) for v in variants}
    rows = micro.groupBy("threshold").agg(*(c.alias(v) for v, c in both.items()))
    gain = F.struct(*((F.col(f"{a}.{t}.f1") - F.col(f"{b}.{t}.f1")).alias(f"{t}_f1") for t in ("entities", "relations")))
    return rows.select("threshold", F.col(a), F.col(b), gain.alias("improvement"))


def compare(pred: DataFrame, gold: DataFrame, options: Options | None = None) -> DataFrame:
    """``pred`` has a ``variant`` column, one of VARIANTS; each is scored against the gold of the documents that it has."""
    each = gold.withColumn("variant", F.explode(F.array(*map(F.lit, VARIANTS))))
    scores = evaluate(pred, each, replace(options or Options(), carry=("variant",)))
    return compare_metrics(scores.micro())
