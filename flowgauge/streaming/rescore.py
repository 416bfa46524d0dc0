"""Scores of predictions as their files arrive.

A document's output is one file, so each micro-batch holds complete documents and no state is
kept between batches: a batch scores what has arrived and writes counts per document; micro
totals are sums over the last counts of each document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from flowgauge.operators.metrics import micro
from flowgauge.plans.evaluate import Options, evaluate
from flowgauge.sources.predictions import parsed_outputs


def arriving_outputs(spark: SparkSession, folder: str) -> DataFrame:
    """Streaming file and value of ``*.json`` in ``folder``."""
    rows = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.json").load(folder)
    return rows.select(F.col("_metadata.file_name").alias("doc_id"), "value")


def rescore(spark: SparkSession, folder: str, gold: DataFrame, out: str, checkpoint: str, options: Options | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Append ``batch`` and the counts of each arriving document to the table at ``out``.

    A batch that is repeated after a failure overwrites its own folder. ``trigger`` has the
    arguments of Spark's trigger, as ``{"processingTime": "1 minute"}`` for a query that goes on;
    without it the query scores what is there and ends.
    """

    def batch(rows: DataFrame, number: int) -> None:
        pred = parsed_outputs(rows.withColumnRenamed("doc_id", "file")).withColumnRenamed("file", "doc_id")
        evaluate(pred, gold, options).per_doc.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return arriving_outputs(spark, folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def totals(spark: SparkSession, out: str) -> DataFrame:
    """Micro metrics over the last counts of each document."""
    rows = spark.read.parquet(out)
    newest = Window.partitionBy("threshold", "target", "doc_id").orderBy(F.desc("batch"))
    return micro(rows.withColumn("n", F.row_number().over(newest)).where("n = 1"))
