"""Page images and the pluggable model call."""

from __future__ import annotations

import hashlib
import traceback
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgauge.functions.text import page_file
from flowgauge.schemas import EXTRACTED

#: Makes the model once in each Python worker; the model turns image bytes and a prompt into text.
ModelFactory = Callable[[], Callable[[bytes, str], str]]

#: Prompt variants: what to extract, without and with notes on the visual conventions.
PROMPTS = {
    "standard": "List the steps of this flowchart page as JSON: entities (id, type of Action, Condition or Decision, text) and relations (source, target, type isPreceededBy). Answer with JSON only.",
    "enhanced": "List the steps of this flowchart page as JSON: entities (id, type of Action, Condition or Decision, text) and relations (source, target, type isPreceededBy). Rounded boxes start a procedure, branching shapes are decisions, boxes are actions or conditions, arrows are relations, numbers continue on other pages. Answer with JSON only.",
}


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, page, path, content of ``<doc>_page_<n>.png`` files; others are left out."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(folder)
    doc, page = page_file(F.regexp_extract("path", "[^/]*$", 0))
    return rows.select(doc.alias("doc_id"), page.alias("page"), "path", "content").where("doc_id is not null")


_models: dict[str, Callable[[bytes, str], str]] = {}


def kept_model(key: str, make_model: ModelFactory) -> Callable[[bytes, str], str]:
    if key not in _models:
        _models.clear()
        _models[key] = make_model()
    return _models[key]


def extract(pages: DataFrame, make_model: ModelFactory, prompt: str, partitions: int | None = None) -> DataFrame:
    """doc_id, page, raw, error, traceback. A page that fails is a row with its error.

    A Python worker makes the model once and keeps it for its later tasks, until it is asked
    for another one.
    """
    key = hashlib.sha256(cloudpickle.dumps(make_model)).hexdigest()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = kept_model(key, make_model)
        for batch in batches:
            out = []
            for doc, page, content in zip(batch["doc_id"], batch["page"], batch["content"], strict=True):
                try:
                    out.append((doc, page, model(content, prompt), None, None))
                except Exception as e:
                    out.append((doc, page, None, str(e), traceback.format_exc()))
            yield pd.DataFrame(out, columns=["doc_id", "page", "raw", "error", "traceback"])

    rows = pages.select("doc_id", "page", "content")
    return (rows.repartition(partitions) if partitions else rows).mapInPandas(run, EXTRACTED)
