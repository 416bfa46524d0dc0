"""Recovery of JSON graphs from raw model text, under three policies.

``strict`` deletes fences, takes the first balanced object and wants both keys. ``span``
takes a fenced object, else all from the first to the last brace. ``repair`` takes the first
balanced object, fenced text first, and mends or harvests what doesn't parse. Braces inside
string values count like others. Results are canonical JSON texts; parse failures are null.
"""

from __future__ import annotations

import json
import re
import traceback
from collections.abc import Callable
from itertools import accumulate
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowgauge.functions.text import tail
from flowgauge.schemas import JSON_OPTIONS, LOOSE_GRAPH

POLICIES = ("strict", "span", "repair")
FENCES = [re.compile(r"```json\s*"), re.compile(r"```\s*")]
FENCED = re.compile(r"```json\s*(\{.*?\})\s*```", re.DOTALL)
BRACE = re.compile(r"[{}]")
#: A comma before a closing brace or bracket, a list's first stretch, and its complete elements.
COMMAS = [(re.compile(r",\s*}"), "}"), (re.compile(r",\s*]"), "]")]
ENTITIES = re.compile(r'"entities"\s*:\s*\[(.*?)\]', re.DOTALL)
ENTITY = re.compile(r'\{\s*"id"\s*:\s*"([^"]+)"\s*,\s*"type"\s*:\s*"([^"]+)"\s*,\s*"text"\s*:\s*"([^"]+)"')
RELATIONS = re.compile(r'"relations"\s*:\s*\[(.*?)\]', re.DOTALL)
RELATION = re.compile(r'\{\s*"source"\s*:\s*"([^"]+)"\s*,\s*"target"\s*:\s*"([^"]+)"\s*,\s*"type"\s*:\s*"([^"]+)"')
HARVEST = {"entities": (ENTITIES, ENTITY, ("id", "type", "text")), "relations": (RELATIONS, RELATION, ("source", "target", "type"))}


def parsed(text: str) -> Any:
    try:
        return json.loads(text)
    except ValueError:
        return None


def depth_of(text: str) -> int:
    return text.count("{") - text.count("}")


def closes_at(text: str, start: int, depth: int = 0) -> int | None:
    """Behind the closing brace that brings ``depth`` to zero from ``start`` on."""
    marks = [(m.end(), 1 if m[0] == "{" else -1) for m in BRACE.finditer(text, start)]
    levels = accumulate((d for _, d in marks), initial=depth)
    next(levels)
    return next((end for (end, step), level in zip(marks, levels, strict=True) if step < 0 and level == 0), None)


def harvest(text: str) -> dict | None:
    """Complete elements in the first stretch of each list, up to its first closing bracket."""
    out: dict[str, list[dict[str, str]]] = {}
    for name, (stretch, element, keys) in HARVEST.items():
        found = stretch.search(text)
        out[name] = [dict(zip(keys, values, strict=True)) for values in element.findall(found[1])] if found else []
    return out if any(out.values()) else None


def mend(text: str) -> Any:
    """Close open brackets, then open braces, and drop commas before either; else harvest."""
    body = text.rstrip()
    if not body:
        return None
    body += "]" * (body.count("[") - body.count("]")) + "}" * depth_of(body)
    for commas, closing in COMMAS:
        body = commas.sub(closing, body)
    got = parsed(body)
    return harvest(body) if got is None else got


def parse_or_mend(text: str) -> Any:
    got = parsed(text)
    return mend(text) if got is None else got


def strict(raw: str) -> Any:
    text = raw
    for fence in FENCES:
        text = fence.sub("", text)
    text = text.strip()
    start = text.find("{")
    end = closes_at(text, start) if start >= 0 else None
    got = parsed(text[start:end]) if end else None
    return got if isinstance(got, dict) and {"entities", "relations"} <= got.keys() else None


def span(raw: str) -> Any:
    fenced = FENCED.search(raw)
    if fenced and (got := parsed(fenced[1])) is not None:
        return got
    start, end = raw.find("{"), raw.rfind("}")
    return parsed(raw[start : end + 1]) if 0 <= start < end else None


def repair(raw: str) -> Any:
    start = raw.find("{")
    if start < 0:
        return None
    fence = raw.find("```", start)
    if fence >= 0:
        inner = raw[start:fence].rstrip()
        depth = depth_of(inner)
        if depth == 0 and (got := parsed(inner)) is not None:
            return got
        if depth > 0:
            end = closes_at(raw, start + len(inner), depth)
            return parse_or_mend(raw[start:end]) if end else mend(inner)
    end = closes_at(raw, start)
    return parse_or_mend(raw[start:end]) if end else mend(raw[start:])


RECOVER: dict[str, Callable[[str], Any]] = {"strict": strict, "span": span, "repair": repair}


def recover_text(raw: str | None, policy: str) -> tuple[str | None, str | None, str | None]:
    """Canonical JSON of an object, error, traceback; never raises."""
    if not raw:
        return None, None, None
    try:
        got = RECOVER[policy](raw)
        return (json.dumps(got, ensure_ascii=False) if isinstance(got, dict) else None), None, None
    except Exception as e:  # one bad page must not stop the batch
        return None, str(e) or type(e).__name__, traceback.format_exc()


def recover_json(raw: Column, policy: str) -> Column:
    """Struct of json, error and traceback."""
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {POLICIES}")

    @F.pandas_udf("json string, error string, traceback string")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([recover_text(t, policy) for t in texts], columns=["json", "error", "traceback"])

    return run(raw)


def normalize_relations(relations: Column) -> Column:
    """``from`` and ``to`` stand in for a missing ``source`` and ``target``."""
    return F.transform(
        relations,
        lambda r: F.struct(F.coalesce(r["source"], r["from"]).alias("source"), F.coalesce(r["target"], r["to"]).alias("target"), r["type"].alias("type"), r["label"].alias("label")),
    )


def recovered_pages(pages: DataFrame, policy: str = "strict", rename: bool = True) -> DataFrame:
    """Adds to pages with ``raw``: ``json`` (a graph, null on failure), ``error`` and ``traceback``, the
    numbers of entities and relations (null on failure), and on failure the end of the raw text."""
    got = pages.withColumn("_r", recover_json(F.col("raw"), policy)).withColumn("_g", F.from_json("_r.json", LOOSE_GRAPH, JSON_OPTIONS))
    ends = normalize_relations(F.col("_g.relations")) if rename else F.transform("_g.relations", lambda r: r.dropFields("from", "to"))
    graph = F.when(F.col("_r.json").isNotNull(), F.struct(F.col("_g.entities").alias("entities"), ends.alias("relations")))
    old = lambda c: F.coalesce(c, f"_r.{c}") if c in pages.columns else F.col(f"_r.{c}")
    got = got.withColumns({"json": graph, "error": old("error"), "traceback": old("traceback")}).drop("_r", "_g")
    number = lambda key: F.when(F.col("json").isNotNull(), F.coalesce(F.array_size(f"json.{key}"), F.lit(0)))
    return got.withColumns({"n_entities": number("entities"), "n_relations": number("relations"), "raw_tail": F.when(F.col("json").isNull(), tail(F.col("raw")))})


def page_success(pages: DataFrame) -> DataFrame:
    """Pages with a graph, of all pages."""
    return pages.agg(F.count("json").alias("ok"), F.count("*").alias("total"))
