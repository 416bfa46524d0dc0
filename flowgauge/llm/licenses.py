"""Operator 6: license scans, in DataFrame functions.

Units of a file are compared with template texts, which are headers, titles and opening
paragraphs of licences, by the cosine of sparse TF-IDF vectors without stop words. The weights are those of the
template collection; a term that it lacks weighs as the rarest. Units are the sentences of
each line, and, for text that is wrapped, those of each run of consecutive lines with a heavy
term, and runs of at most HEADER characters as a whole; marks of comments count as spaces. A
unit is scored only if it holds one of a template's heaviest terms: those that the others'
joint weight can't replace at the threshold, so no unit over the threshold is missed. Equal
units are scored once.

A file's own license is that of its best unit, but for a license that another one found in
the file refines. Else it inherits from the licence file (LICENSE, COPYING and the like) in
the nearest directory upwards, by joins of paths; a licence file that isn't recognised leaves
what is below it unknown, rather than under the license of a farther directory.

Nulls and edge cases: a null path is an unnamed file of the root; a null or empty text has no
units; rows of equal path share one result, the best of their units; equal scores go to the
license first in order; several licence files of a directory: the best score, then the first
in order; an empty table gives no rows; other columns are carried along where asked for.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgauge.llm.common import written

#: License and template text.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "you may not use this file except in compliance with the License"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions'),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("GPL-2.0", "either version 2 of the License, or (at your option) any later version"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("LGPL-3.0", "licensed under the GNU Lesser General Public License, version 3"),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
]
#: A license whose text holds that of another, and the other.
REFINES = {"BSD-3-Clause": "BSD-2-Clause"}
#: Stop words, which no vector has.
STOP = "a all an and any are as at be by can do for from he her his i in is it its may my no not of on or other our she so that the their they this to under was we were which with without you your".split()
THRESHOLD = 0.7
#: Characters of a run of lines that is also scored as a whole: an opening paragraph isn't longer.
HEADER = 1200
#: Distinct licensed units that may be broadcast (some hundred bytes each).
BROADCAST_UNITS = 50_000
TERM = "[^a-z0-9]+"
SENTENCE = r"[.;]\s+"
LICENCE_FILE = r"(?i)^(LICEN[SC]E|COPYING|UNLICENSE)([.-].*)?$"


class Model:
    """TF-IDF of the templates."""

    def __init__(self, templates=TEMPLATES, threshold: float = THRESHOLD):
        self.templates, self.threshold = list(templates), threshold
        terms = [Counter(t for t in re.split(TERM, text.lower()) if t and t not in STOP) for _, text in self.templates]
        found = Counter(t for c in terms for t in c)
        n = len(terms)
        self.idf = {t: math.log((1 + n) / (1 + k)) + 1 for t, k in found.items()}
        self.rare = math.log(1 + n) + 1
        self.weights: list[tuple[int, str, float]] = []  # template, term, weight of unit length
        self.anchors: set[str] = set()
        for k, c in enumerate(terms):
            w = {t: m * self.idf[t] for t, m in c.items()}
            norm = math.sqrt(sum(x * x for x in w.values()))
            self.weights += [(k, t, x / norm) for t, x in w.items()]
            left = 1.0
            for t in sorted(w, key=lambda t: (not t.isalpha(), -w[t], t)):
                if left < threshold**2 - 1e-9:
                    break
                self.anchors.add(t)
                left -= (w[t] / norm) ** 2

    @property
    def vectors(self) -> list[tuple[str, list[tuple[int, float]]]]:
        """term, and its weight in each template that has it."""
        out: dict[str, list[tuple[int, float]]] = {}
        for k, t, w in self.weights:
            out.setdefault(t, []).append((k, w))
        return sorted(out.items())

    @property
    def pattern(self) -> str:
        """Any of the anchors as a term; by first character, so that most are never tried."""
        by_first: dict[str, list[str]] = {}
        for t in sorted(self.anchors):
            by_first.setdefault(t[0], []).append(t[1:])
        tried = "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in by_first.items())
        return f"(?:^|[^a-z0-9])(?:{tried})(?:[^a-z0-9]|$)"


def units(text, pattern: str):
    """The units of a lower-case text that hold an anchor."""
    lines = F.split(text, "\n")
    marked = F.transform(lines, lambda x: F.when(x.rlike(pattern), x).otherwise("\x01"))
    runs = F.split(F.array_join(marked, " "), "\x01")
    cut = lambda many: F.flatten(F.transform(F.filter(many, lambda x: x.rlike(pattern)), lambda x: F.split(x, SENTENCE)))
    heads = F.filter(runs, lambda x: F.length(x) <= HEADER)
    return F.array_distinct(F.filter(F.concat(cut(lines), cut(runs), heads), lambda x: x.rlike(pattern)))


def own_licenses(files: DataFrame, model: Model) -> DataFrame:
    """path, license, score of the files with a unit over the threshold; reads the texts once."""
    spark = files.sparkSession
    low = files.select("path", F.lower("text").alias("text")).where(F.col("text").rlike(model.pattern))
    said = low.select("path", F.explode(units(F.col("text"), model.pattern)).alias("unit"))
    said = written(said.select("path", "unit", F.unhex(F.md5("unit")).alias("key")), "units")
    # a unit's vector and norm are made in its row; only its terms that a template has go on
    idf = F.create_map(*(F.lit(x) for pair in sorted(model.idf.items()) for x in pair))
    terms = F.filter(F.split("unit", TERM), lambda t: (t != "") & ~t.isin(STOP))
    weight = lambda t: F.size(F.filter("terms", lambda x: x == t)) * F.coalesce(F.try_element_at(idf, t), F.lit(model.rare))
    vector = F.transform(F.array_distinct("terms"), lambda t: F.struct(t.alias("term"), weight(t).alias("w")))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x["w"] * x["w"]))
    rows = said.select("key", terms.alias("terms")).select("key", vector.alias("vector")).select("key", norm.alias("norm"), F.inline("vector"))
    # the templates are a fixed list: a few hundred rows
    vectors = F.broadcast(spark.createDataFrame(model.vectors, "term string, vector array<struct<template: int, weight: double>>"))
    known = rows.where(F.col("term").isin(sorted(model.idf))).distinct()
    dots = known.join(vectors, "term").select("key", "norm", "w", F.inline("vector")).groupBy("key", "norm", "template").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    names = F.broadcast(spark.createDataFrame([(k, name) for k, (name, _) in enumerate(model.templates)], "template int, license string"))
    scored = dots.select("key", "template", F.round(F.col("dot") / F.col("norm"), 6).alias("score"))
    over = scored.where(F.col("score") >= model.threshold).join(names, "template")
    best = written(over.groupBy("key", "license").agg(F.max("score").alias("score")), "licensed")
    if best.limit(BROADCAST_UNITS + 1).count() <= BROADCAST_UNITS:
        best = F.broadcast(best)  # else a join that Spark can split where a unit is in very many files
    found = said.select("path", "key").join(best, "key").groupBy("path", "license").agg(F.max("score").alias("score"))
    order = F.struct((-F.col("score")).alias("s"), "license")
    refined = F.lit(False)
    for fine, coarse in REFINES.items():
        refined = refined | ((F.col("license") == coarse) & F.array_contains("all", fine))
    each = found.groupBy("path").agg(F.collect_set("license").alias("all"), F.collect_list(order).alias("found"))  # as many as there are licenses
    each = each.select("path", "all", F.inline("found")).where(~refined)
    return each.groupBy("path").agg(F.min(F.struct("s", "license")).alias("b")).select("path", F.col("b.license").alias("license"), (-F.col("b.s")).alias("score"))


def folder_of(path):
    return F.regexp_replace(path, "/?[^/]*$", "")


def scan(files: DataFrame, model: Model | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """The ``carry`` columns, path, license, score and ``origin``: own, the directory whose licence
    file holds (recognised or not), or null."""
    path = F.coalesce(F.col("path").cast("string"), F.lit(""))
    own = own_licenses(files.select(path.alias("path"), F.col("text").cast("string").alias("text")), model or Model())
    own = written(own, "own")
    is_licence = F.regexp_extract("path", "[^/]*$", 0).rlike(LICENCE_FILE)
    given = own.where(is_licence).groupBy(folder_of("path").alias("folder")).agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b"))
    given = given.select("folder", F.col("b.license").alias("given"))
    # nearest directory upwards with a licence file, of each distinct directory; files then join directories, never each other
    paths = files.select(*carry, path.alias("path"))
    folders = paths.groupBy(folder_of("path").alias("own_folder")).agg(F.max(is_licence).alias("stops"))
    stops = folders.where("stops").select(F.col("own_folder").alias("folder")).join(given, "folder", "left")
    parts = F.split("own_folder", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("folder")))
    chain = folders.select("own_folder", F.explode(F.array_distinct(above)).alias("a")).select("own_folder", "a.depth", "a.folder")
    nearest = chain.join(stops, "folder").groupBy("own_folder").agg(F.max_by(F.struct("given", "folder"), "depth").alias("near"))
    out = paths.join(own, "path", "left").withColumn("own_folder", folder_of("path")).join(nearest, "own_folder", "left")
    mine = F.col("license").isNotNull()
    return out.select(
        *carry, "path", F.coalesce("license", "near.given").alias("license"), "score",
        F.when(mine, F.lit("own")).when(F.col("near").isNotNull(), F.concat(F.lit("/"), F.col("near.folder"))).alias("origin"),
    )


def oracle(model: Model, files: str) -> str:
    """DuckDB SQL of ``scan`` over ``files``, SQL for (doc_id, path, text)."""
    rows = ", ".join(f"({k}, '{model.templates[k][0]}', '{t}', {w!r}::DOUBLE)" for k, t, w in model.weights)
    idf = ", ".join(f"('{t}', {x!r}::DOUBLE)" for t, x in sorted(model.idf.items()))
    stop = ", ".join(f"'{t}'" for t in STOP)
    has = lambda x: f"regexp_matches({x}, '{model.pattern}')"
    cut = lambda many: f"flatten(list_transform(list_filter({many}, lambda x: {has('x')}), lambda x: string_split_regex(x, '{SENTENCE}')))"
    refined = " OR ".join(f"license = '{coarse}' AND EXISTS (FROM found g WHERE g.path = f.path AND g.license = '{fine}')" for fine, coarse in REFINES.items())
    folder = "regexp_replace(path, '/?[^/]*$', '')"
    licence = f"regexp_matches(regexp_extract(path, '[^/]*$'), '{LICENCE_FILE}')"
    return rf"""
WITH files AS ({files}),
vectors(template, license, term, weight) AS (VALUES {rows}),
idfs(term, idf) AS (VALUES {idf}),
lined AS (SELECT path, string_split(lower(text), chr(10)) AS lines FROM files WHERE {has("lower(text)")}),
ran AS (SELECT path, lines, string_split(array_to_string(list_transform(lines, lambda x: CASE WHEN {has("x")} THEN x ELSE chr(1) END), ' '), chr(1)) AS runs FROM lined),
said AS (SELECT DISTINCT path, unit FROM (SELECT path, unnest(list_concat({cut("lines")}, {cut("runs")}, list_filter(runs, lambda x: length(x) <= {HEADER}))) AS unit FROM ran) WHERE {has("unit")}),
terms AS (SELECT unit, unnest(string_split_regex(unit, '{TERM}')) AS term FROM (SELECT DISTINCT unit FROM said)),
counts AS (SELECT unit, term, count(*) AS tf FROM terms WHERE term <> '' AND term NOT IN ({stop}) GROUP BY ALL),
weighed AS (SELECT unit, c.term, tf * coalesce(idf, {model.rare!r}::DOUBLE) AS w FROM counts c LEFT JOIN idfs i ON c.term = i.term),
norms AS (SELECT unit, sqrt(sum(w * w)) AS norm FROM weighed GROUP BY 1),
dots AS (SELECT unit, template, license, sum(w * weight) AS dot FROM weighed JOIN vectors USING (term) GROUP BY ALL),
scored AS (SELECT unit, license, round(dot / norm, 6) AS score FROM dots JOIN norms USING (unit)),
found AS (SELECT path, license, max(score) AS score FROM said JOIN scored USING (unit) WHERE score >= {model.threshold} GROUP BY ALL),
own AS (SELECT path, license, score FROM (SELECT path, license, score, row_number() OVER (PARTITION BY path ORDER BY score DESC, license) AS n FROM found f WHERE NOT ({refined})) WHERE n = 1),
given AS (SELECT folder, license AS given FROM (SELECT {folder} AS folder, license, row_number() OVER (PARTITION BY {folder} ORDER BY score DESC, license) AS n FROM own WHERE {licence}) WHERE n = 1),
folders AS (SELECT {folder} AS own_folder, bool_or({licence}) AS stops FROM files GROUP BY 1),
stops AS (SELECT own_folder AS folder, given FROM folders LEFT JOIN given ON own_folder = folder WHERE stops),
chain AS (SELECT own_folder, k AS depth, array_to_string(list_slice(string_split(own_folder, '/'), 1, k), '/') AS folder FROM folders, unnest(range(0, len(string_split(own_folder, '/')) + 1)) t(k)),
nearest AS (SELECT own_folder, given, folder FROM (SELECT own_folder, given, folder, row_number() OVER (PARTITION BY own_folder ORDER BY depth DESC) AS n FROM chain JOIN stops USING (folder)) WHERE n = 1)
SELECT doc_id, f.path, coalesce(o.license, n.given) AS license, o.score,
  CASE WHEN o.license IS NOT NULL THEN 'own' WHEN n.folder IS NOT NULL THEN '/' || n.folder END AS origin
FROM files f LEFT JOIN own o ON f.path = o.path LEFT JOIN nearest n ON regexp_replace(f.path, '/?[^/]*$', '') = n.own_folder"""
