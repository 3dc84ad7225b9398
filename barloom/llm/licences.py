"""Licence scan: Dice coefficient over word bigrams between normalised text and licence templates, in SQL functions.

A text is looked at as a whole, by paragraphs and by lines. Two bounds keep most of it out: a segment of n distinct
bigrams can reach the coefficient with a template of m only if n lies between m * t / (2 - t) and m * (2 - t) / t;
and a segment that reaches it holds more than the rest of the template's bigrams, so it holds an anchor, one of enough
bigrams of each template. Texts and segments without any anchor are dropped before they are cut into bigrams.
Templates are literals of the plan, so there is no join, and rows never leave the JVM.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

#: Short notices of public licences by SPDX identifier.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


def bigrams_of(text: str) -> list[str]:
    """Distinct word bigrams of a template, in order."""
    words = re.sub(r"[\W_]+", " ", text.lower()).split()
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


def size_bounds(m: int, threshold: float) -> tuple[int, int]:
    """Fewest and most bigrams of a segment that can reach ``threshold`` with a template of m bigrams."""
    return math.ceil(m * threshold / (2 - threshold) - 1e-9), math.floor(m * (2 - threshold) / threshold + 1e-9)


def anchors(templates: list[tuple[str, str]], threshold: float) -> list[str]:
    """Bigrams of which every segment that reaches ``threshold`` with a template has one.

    A match shares at least m * t / (2 - t) of a template's m bigrams, so one more than the remaining ones can't all
    be missing. The longest are taken, after those that other templates have taken already.
    """
    chosen: list[str] = []
    for _, text in templates:
        grams = bigrams_of(text)
        enough = len(grams) - size_bounds(len(grams), threshold)[0] + 1
        own = [g for g in grams if g in chosen]
        more = sorted((g for g in grams if g not in chosen), key=lambda g: (-len(g), g))
        chosen += more[: max(0, enough - len(own))]
    return sorted(chosen)


def _any_anchor(templates: list[tuple[str, str]], threshold: float) -> str:
    """A pattern for lower-cased text: an anchor's two words with only other characters between and a break before."""
    gap = r"[^\p{L}\p{N}]+"
    return r"(?<![\p{L}\p{N}])(?:" + "|".join(gap.join(map(re.escape, g.split())) for g in anchors(templates, threshold)) + ")"


def _bigrams(segment: Column) -> Column:
    words = F.filter(F.split(F.regexp_replace(F.lower(segment), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(pairs)


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (doc_id, licence, dice, segments) for each doc_id and licence that it names, by the best coefficient.

    ``segments`` counts the distinct segments (whole text, paragraphs, lines) whose best licence it is; of equal
    coefficients the licence later by name counts. ``docs`` has (doc_id, text), other columns are unread. Null, empty
    and one-word texts match nothing; rows of equal doc_id count together, null doc_ids too; an empty table gives an
    empty result. Texts of any length are read whole.
    """
    templates = TEMPLATES if templates is None else templates
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.where(F.lower("text").rlike(_any_anchor(templates, threshold)))
    parts = F.array_distinct(F.concat(F.array("text"), F.split("text", "\n\n"), F.split("text", "\n")))
    rows = rows.select("doc_id", F.explode(parts).alias("segment"))
    bounds = [(name, b, *size_bounds(len(b), threshold)) for name, b in ((n, bigrams_of(t)) for n, t in templates)]
    widest = max(hi for *_, hi in bounds)
    rows = rows.where(F.lower("segment").rlike(_any_anchor(templates, threshold))).withColumn("grams", _bigrams(F.col("segment"))).withColumn("n", F.size("grams"))
    rows = rows.where((F.col("n") > 0) & (F.col("n") <= widest))
    options = []
    for name, grams, lo, hi in bounds:
        both = F.size(F.array_intersect(F.col("grams"), F.array(*[F.lit(g) for g in grams])))
        dice = 2.0 * both / (F.col("n") + len(grams))
        options.append(F.when(F.col("n").between(lo, hi), F.struct(dice.alias("dice"), F.lit(name).alias("licence"))))
    rows = rows.withColumn("best", F.greatest(*options) if len(options) > 1 else options[0]).where(F.col("best.dice") >= threshold)
    return rows.groupBy("doc_id", F.col("best.licence").alias("licence")).agg(F.max("best.dice").alias("dice"), F.count(F.lit(1)).alias("segments"))


def scan_sql(templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> str:
    """What scan() computes over the table ``documents``, for DuckDB, without the two bounds."""
    templates = TEMPLATES if templates is None else templates
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quote(n)}, [{', '.join(map(quote, bigrams_of(t)))}])" for n, t in templates)
    return f"""
WITH templates(licence, grams) AS (VALUES {values}),
segments AS (
  SELECT DISTINCT doc_id, unnest(list_concat([text], string_split(text, chr(10) || chr(10)), string_split(text, chr(10)))) AS segment
  FROM documents WHERE text IS NOT NULL),
words AS (
  SELECT doc_id, segment, list_filter(string_split(regexp_replace(lower(segment), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> '') AS w
  FROM segments),
grams AS (
  SELECT doc_id, segment, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM words WHERE len(w) > 1),
scored AS (
  SELECT doc_id, segment, 2.0 * len(list_intersect(g, t.grams)) / (len(g) + len(t.grams)) AS dice, t.licence FROM grams, templates t),
best AS (
  SELECT doc_id, segment, max({{'dice': dice, 'licence': licence}}) AS b FROM scored WHERE dice >= {threshold} GROUP BY doc_id, segment)
SELECT doc_id, b.licence AS licence, max(b.dice)::DOUBLE AS dice, count(*) AS segments FROM best GROUP BY doc_id, b.licence
"""
