"""Licence scans: TF-IDF cosine of lines and files to licence templates, then inheritance along directories."""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import WORD, cut

# The standard notice or opening sentence of each licence, by SPDX identifier.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0-only": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "LGPL-3.0-only": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0-only": "This program is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0 Universal.",
}
_TOKEN = r"[a-z0-9]+(?:\.[0-9]+)*"


def _terms(text: str) -> list[str]:
    return re.findall(_TOKEN, text.lower())


def template_weights(templates: dict[str, str]) -> tuple[list[tuple[str, str, float]], dict[str, float], float]:
    """Normalised TF-IDF weights (term, licence, weight), the idf of each term, and the idf of any other term."""
    tf = {name: Counter(_terms(text)) for name, text in templates.items()}
    df = Counter(t for own in tf.values() for t in own)
    n = len(templates)
    idf = {t: 1 + math.log((1 + n) / (1 + k)) for t, k in df.items()}
    rows = []
    for name, own in tf.items():
        norm = math.sqrt(sum((k * idf[t]) ** 2 for t, k in own.items()))
        rows += [(t, name, k * idf[t] / norm) for t, k in own.items()]
    return rows, idf, 1 + math.log(1 + n)


def anchor_terms(weights: list[tuple[str, str, float]], threshold: float) -> list[str]:
    """Terms of which a line must hold one to reach threshold with any template.

    By Cauchy and Schwarz the squared cosine is at most the squared weight of the template's terms that the line has; the
    lightest terms of a template, as long as their squares stay below threshold**2, cannot reach it alone.
    """
    anchors = set()
    for name in {n for _, n, _ in weights}:
        mass = 0.0
        for w, t in sorted((w, t) for t, n, w in weights if n == name):
            mass += w * w
            if mass >= (threshold - 1e-5) ** 2:
                anchors.add(t)
    return sorted(anchors)


def license_scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    path_col: str = "path",
    templates: dict[str, str] | None = None,
    threshold: float = 0.75,
    file_share: float = 0.2,
) -> DataFrame:
    """One row per row of docs: id, path, license, score, origin, license_dir, n_license_lines, license_share.

    Each line is a sparse TF-IDF vector; its cosine to every template counts if it reaches threshold. A document's own
    licence is that of its best line (ties: the licence first by name), origin `own`. A document with file_share or more
    of its words on licence lines is a licence file and declares its licence for its directory. A document without its
    own takes that of the nearest ancestor directory with a licence file, origin `inherited`, else it has none (null
    license, score 0, origin `none`). A directory with several licence files takes the best score, then the first name.
    Null or empty texts and paths have no licence lines and no directory (""). Repeated rows with one id and path are one
    document for inheritance and stay separate rows. Extra columns are ignored; no rows give no rows. Idf comes from the
    templates alone, a list of fixed size, which is also all that is broadcast. Only lines with an anchor term (see
    anchor_terms) and enough mass in the templates' terms leave the scan; no other line can reach the threshold. A row with a null id has no licence of its own.
    """
    spark = docs.sparkSession
    weights, idf, other = template_weights(templates or TEMPLATES)
    table = F.broadcast(spark.createDataFrame(weights, "term string, license string, weight double"))
    known = F.broadcast(spark.createDataFrame(list(idf.items()), "term string, idf double"))
    anchors = F.array(*[F.lit(t) for t in anchor_terms(weights, threshold)])
    folder = F.regexp_replace("_path", "/?[^/]*$", "")
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(path_col), F.lit("")).alias("_path"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    light = cut(rows.select("_id", "_path", folder.alias("_folder"), F.regexp_count("_text", F.lit(WORD)).cast("long").alias("_n")))
    # the terms leave the generator as a column: in a projection, each of the filters would extract them again
    terms = F.transform(F.split("_text", "\n"), lambda s: F.regexp_extract_all(F.lower(s), F.lit(_TOKEN), F.lit(0)))
    lines = rows.select("_id", "_path", F.posexplode(terms).alias("_line", "_t")).filter(F.arrays_overlap("_t", anchors))
    # what a line holds besides the templates' terms only lengthens it: the mass inside must allow the threshold
    vocabulary, idfs = F.array(*[F.lit(t) for t in sorted(idf)]), F.create_map(*[F.lit(x) for pair in sorted(idf.items()) for x in pair])
    inside = F.aggregate(F.array_intersect("_t", vocabulary), F.lit(0.0), lambda m, t: m + F.pow((F.size("_t") - F.size(F.array_remove("_t", t))) * F.element_at(idfs, t), F.lit(2.0)))
    outside = F.size(F.array_except("_t", vocabulary)) * F.lit(other**2)
    least = (threshold - 1e-5) ** 2
    lines = lines.filter(inside * F.lit(1 - least) >= outside * F.lit(least))
    tf = lines.select("_id", "_path", "_line", F.size("_t").alias("_words"), F.explode("_t").alias("term")).groupBy("_id", "_path", "_line", "_words", "term").agg(F.count(F.lit(1)).alias("_tf"))
    tf = cut(tf.join(known, "term", "left").withColumn("_w", F.col("_tf") * F.coalesce("idf", F.lit(other))))
    line = ["_id", "_path", "_line"]
    norms = tf.groupBy(*line).agg(F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_norm"), F.max("_words").alias("_words"))
    dots = tf.join(table, "term").groupBy(*line, "license").agg(F.sum(F.col("_w") * F.col("weight")).alias("_dot"))
    scored = dots.join(norms, line).select(*line, "_words", "license", F.round(F.col("_dot") / F.col("_norm"), 6).alias("score")).filter(F.col("score") >= threshold)
    best = scored.groupBy(*line).agg(F.max("_words").alias("_words"), F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("_b"))
    own = cut(best.groupBy("_id", "_path").agg(F.min("_b").alias("_b"), F.count(F.lit(1)).alias("n_license_lines"), F.sum("_words").alias("_words")))
    found = cut(light.join(own, ["_id", "_path"], "left").withColumn("license_share", F.coalesce(F.col("_words") / F.greatest("_n", F.lit(1)), F.lit(0.0))))
    files = found.filter(F.col("_words") >= F.lit(file_share) * F.greatest("_n", F.lit(1)))
    declared = files.groupBy(F.col("_folder").alias("_dir")).agg(F.min("_b").alias("_d"))
    # from each directory up to the root: one row per ancestor, joined by path
    parts = F.split("_folder", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    homes = found.select("_folder").distinct().select("_folder", F.posexplode(F.array_distinct(F.concat(F.array(F.lit("")), up))).alias("_depth", "_dir"))
    nearest = cut(homes.join(declared, "_dir").groupBy("_folder").agg(F.max_by(F.struct("_dir", "_d"), "_depth").alias("_near")))
    out = found.join(nearest, "_folder", "left")
    mine = F.col("_b").isNotNull()
    origin = F.when(mine, "own").when(F.col("_near").isNotNull(), "inherited").otherwise("none")
    return out.select(
        F.col("_id").alias(id_col),
        F.col("_path").alias(path_col),
        F.coalesce("_b.license", "_near._d.license").alias("license"),
        F.coalesce(-F.col("_b.s"), -F.col("_near._d.s"), F.lit(0.0)).alias("score"),
        origin.alias("origin"),
        F.when(origin == "inherited", F.col("_near._dir")).alias("license_dir"),
        F.coalesce("n_license_lines", F.lit(0)).cast("long").alias("n_license_lines"),
        F.round("license_share", 6).alias("license_share"),
    )
