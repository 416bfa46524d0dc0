"""Command line: ``evaluate`` scores one model, ``compare`` two prompt variants."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgauge.functions import keywords
from flowgauge.plans.compare import VARIANTS, compare
from flowgauge.plans.evaluate import DEFAULT, SENSITIVITY, Options, evaluate, result_document
from flowgauge.session import session
from flowgauge.sources.predictions import missing_outputs, paired_docs, read_gold, read_outputs
from flowgauge.sources.sinks import write_result

KEYWORDS = {"none": None, "tokens": keywords.token_keywords, "lemmas": keywords.lemma_keywords}


def summary(micro: DataFrame) -> list[str]:
    """Lines for the threshold 0.7, or the first one if it wasn't run."""
    rows = {(r.threshold, r.target): r for r in micro.collect()}
    at = 0.7 if (0.7, "entities") in rows else min((t for t, _ in rows), default=None)
    return [f"{kind.capitalize()}: P={r.precision:.2f}, R={r.recall:.2f}, F1={r.f1:.2f}" for kind in ("entities", "relations") if (r := rows.get((at, kind)))]


def run_evaluate(spark: SparkSession, a: argparse.Namespace) -> list[str]:
    gold, outputs = read_gold(spark, a.ground_truth), read_outputs(spark, a.model_output, a.namespace_ids)
    said = [f"Warning: no model output for {r.file}" for r in missing_outputs(gold, outputs).orderBy("file").collect()]
    options = Options(SENSITIVITY if a.sensitivity else DEFAULT, KEYWORDS[a.keywords], a.dedup_predictions, a.direction)
    scores = evaluate(*paired_docs(gold, outputs), options).keep()
    try:
        write_result(result_document(scores, a.model_name), a.output)
        return [*said, "Aggregate results (threshold 0.7):", *summary(scores.micro())]
    finally:
        scores.release()


def run_compare(spark: SparkSession, a: argparse.Namespace) -> list[str]:
    gold = read_gold(spark, a.ground_truth)
    sides = [paired_docs(gold, read_outputs(spark, folder)) for folder in (a.enhanced, a.standard)]
    pred = sides[0][0].withColumn("variant", F.lit(VARIANTS[0])).unionByName(sides[1][0].withColumn("variant", F.lit(VARIANTS[1])))
    result = compare(pred, gold.withColumnRenamed("file", "doc_id"), Options(keywords=KEYWORDS[a.keywords]))
    write_result(result.drop("threshold"), f"{a.output_dir.rstrip('/')}/comparison")
    r = result.first()
    if r is None:
        return ["No document has an output"]
    return [f"{v} entity F1: {r[v].entities.f1:.4f}" for v in VARIANTS] + [f"Improvement: {r.improvement.entities_f1:.4f}"]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="flowgauge")
    sub = p.add_subparsers(required=True)
    e = sub.add_parser("evaluate")
    e.add_argument("--model_output", required=True)
    e.add_argument("--ground_truth", required=True)
    e.add_argument("--output", default="evaluation_results")
    e.add_argument("--model_name", default="VLM")
    e.add_argument("--sensitivity", action="store_true")
    e.add_argument("--namespace_ids", action="store_true")
    e.add_argument("--dedup_predictions", action="store_true")
    e.add_argument("--direction", choices=("directed", "either"), default="directed")
    e.set_defaults(run=run_evaluate)
    c = sub.add_parser("compare")
    for name in ("--enhanced", "--standard", "--ground_truth"):
        c.add_argument(name, required=True)
    c.add_argument("--output_dir", default=".")
    c.set_defaults(run=run_compare)
    for x in (e, c):
        x.add_argument("--keywords", choices=sorted(KEYWORDS), default="tokens")
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    print("\n".join(a.run(session(), a)))


if __name__ == "__main__":
    main()
