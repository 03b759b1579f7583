"""Licence scan: lines, paragraphs, whole texts and windows of words against licence templates.

Normalised words (lower case, letters and digits) give sets of word bigrams; a unit of text
matches a template by the Dice coefficient 2|A∩B| / (|A| + |B|). A coefficient of t needs
|B| t / (2 - t) <= |A| <= |B| (2 - t) / t, so most units are ruled out by their number of words
alone, before any bigram is built, and most templates by the number of bigrams.

A notice may also stand inside longer text. Every run of as many words as a template has, over line
breaks too, that begins with one of its bigrams is compared with it as well. By the same bound a
text must hold t / (2 - t) of a template's bigrams for that; the others have no such runs.

A projection of column expressions without a shuffle; the templates are a declared, small set
and stand in the plan as constants.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom.llm.common import bind, missing_columns, q

# The usual notices of public licences, as published.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file '
                   "except in compliance with the License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are "
                     "permitted provided that the following conditions are met:"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or "
                "neighboring rights to this work."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the "
                         "terms of the GNU General Public License as published by the Free Software Foundation, "
                         "either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without "
            "fee is hereby granted, provided that the above copyright notice and this permission notice appear "
            "in all copies."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            'associated documentation files (the "Software"), to deal in the Software without restriction, '
            "including without limitation the rights to use, copy, modify, merge, publish, distribute, "
            "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
            "furnished to do so, subject to the following conditions:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)

BREAKS = r"[^\p{L}\p{N}]+"


def template_words(text: str) -> list[str]:
    import regex

    return [w for w in regex.split(BREAKS, text.lower()) if w]


def template_bigrams(text: str) -> list[str]:
    ws = template_words(text)
    return sorted({f"{a} {b}" for a, b in zip(ws, ws[1:])})


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), BREAKS), lambda w: w != "")


def _pairs(ws: Column) -> Column:
    return F.transform(
        F.sequence(F.lit(0), F.size(ws) - 2), lambda i: F.concat_ws(" ", F.get(ws, i), F.get(ws, i + 1))
    )


def _bigrams(ws: Column) -> Column:
    return F.array_distinct(_pairs(ws))


def best_window(text: Column, first: Column, templates=TEMPLATES, threshold: float = 0.8) -> Column:
    """struct(dice, whole, rank, at, unit) of the best run of words as long as its template; windows are
    numbered from ``first`` by their first word, and given as their words."""
    words = [template_words(t) for _, t in templates]
    sets = [template_bigrams(t) for _, t in templates]
    every = F.array(*map(F.lit, sorted(set().union(*sets))))

    def slid(ws: Column, pairs: Column, k: int) -> Column:
        own = F.array(*map(F.lit, sets[k]))
        starts = F.filter(
            F.sequence(F.lit(0), F.size(ws) - len(words[k])), lambda i: F.array_contains(own, F.get(pairs, i))
        )

        def scored(i: Column) -> Column:
            return bind(
                F.array_distinct(F.slice(pairs, i + 1, len(words[k]) - 1)),
                lambda a: F.struct(
                    (2.0 * F.size(F.array_intersect(a, own)) / (F.size(a) + len(sets[k]))).alias("dice"),
                    F.lit(0).alias("whole"), F.lit(-k).alias("rank"), (-first - i).alias("at"),
                    F.concat_ws(" ", F.slice(ws, i + 1, len(words[k]))).alias("unit"),
                ),
            )

        return F.array_max(F.transform(starts, scored))

    def searched(ws: Column, pairs: Column, met: Column) -> Column:
        found = []
        for k, own in enumerate(sets):
            enough = F.size(F.array_intersect(met, F.array(*map(F.lit, own)))) >= len(own) * threshold / (2 - threshold) - 1e-9
            found.append(F.when(enough & (F.size(ws) >= len(words[k])), slid(ws, pairs, k)))
        return F.array_max(F.array(*found))

    return bind(
        _words(text),
        lambda ws: F.when(
            F.size(ws) > 1,
            bind(_pairs(ws), lambda pairs: bind(F.array_intersect(pairs, every), lambda met: F.when(F.size(met) > 0, searched(ws, pairs, met)))),
        ),
    )


def best_match(text: Column, templates=TEMPLATES, threshold: float = 0.8) -> Column:
    """struct(dice, whole, rank, at, unit): the best pair of a unit or window and a template, null where
    none reaches the threshold. Ties go to units before windows, to the earlier template, to the earlier place."""
    sets = [template_bigrams(t) for _, t in templates]
    low = [len(s) * threshold / (2 - threshold) for s in sets]
    high = [len(s) * (2 - threshold) / threshold for s in sets]
    lines = F.split(text, "\n")
    paragraphs = F.split(text, r"\n[ \t\r]*\n")
    units = F.concat(
        lines,
        F.when(F.size(lines) > 1, paragraphs).otherwise(F.array().cast("array<string>")),
        F.when(F.size(paragraphs) > 1, F.array(text)).otherwise(F.array().cast("array<string>")),
    )

    def against(unit: Column, at: Column, grams: Column) -> Column:
        n = F.size(grams)
        found = [
            F.when(
                n.between(low[k], high[k]),
                F.struct(
                    (2.0 * F.size(F.array_intersect(grams, F.array(*map(F.lit, s)))) / (n + len(s))).alias("dice"),
                    F.lit(1).alias("whole"), F.lit(-k).alias("rank"), (-at).alias("at"), unit.alias("unit"),
                ),
            )
            for k, s in enumerate(sets)
        ]
        return F.array_max(F.array(*found))

    def compared(unit: Column, at: Column) -> Column:
        # n words make n - 1 bigrams at most, and d distinct words d - 1 at least
        return bind(
            _words(unit),
            lambda ws: F.when(
                (F.size(ws) - 1 >= min(low)) & (F.size(F.array_distinct(ws)) - 1 <= max(high)) & (F.size(ws) > 1),
                bind(_bigrams(ws), lambda grams: against(unit, at, grams)),
            ),
        )

    # a coefficient within one part in 1e9 of the threshold counts as reaching it
    best = F.array_max(
        F.array(F.array_max(F.transform(units, compared)), best_window(text, F.size(units), templates, threshold))
    )
    return bind(best, lambda m: F.when(m["dice"] >= threshold - 1e-9, m))


def scan_licenses(
    docs: DataFrame, key: str = "doc_id", text: str = "text", templates=TEMPLATES, threshold: float = 0.8
) -> DataFrame:
    """(key, license, dice, matched) for every row; the last three are null without a match.

    ``matched`` is the line, paragraph or text as it stands, or the words of a window. Null and empty texts match nothing;
    repeated rows come back as often; other columns are ignored, whatever their names.
    """
    missing_columns(docs, key, text)
    names = F.array(*[F.lit(name) for name, _ in templates])
    found = docs.select(q(key).alias("id"), best_match(q(text).cast("string"), templates, threshold).alias("m"))
    m = F.col("m")
    return found.select(
        F.col("id").alias(key), F.get(names, -m["rank"]).alias("license"), m["dice"].alias("dice"),
        m["unit"].alias("matched"),
    )


def oracle(templates=TEMPLATES, threshold: float = 0.8) -> str:
    """The same in SQL, every unit and window against every template without size bounds."""
    rows = ", ".join(
        f"({k}, '{name}', {len(template_words(t))}, ['" + "', '".join(template_bigrams(t)) + "'])"
        for k, (name, t) in enumerate(templates)
    )
    return rf"""
WITH t(k, license, n, grams) AS (VALUES {rows}),
d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines,
             regexp_split_to_array(text, '\n[ \t\r]*\n') AS paragraphs FROM documents),
u AS (SELECT doc_id, unnest(units) AS unit, generate_subscripts(units, 1) AS pos FROM (
  SELECT doc_id, list_concat(lines, CASE WHEN len(lines) > 1 THEN paragraphs ELSE [] END,
                             CASE WHEN len(paragraphs) > 1 THEN [text] ELSE [] END) AS units FROM d)),
w AS (SELECT *, list_filter(regexp_split_to_array(lower(unit), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS ws FROM u),
g AS (SELECT *, list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS a
      FROM w WHERE len(ws) > 1 AND len(ws) < 400),
s AS (SELECT doc_id, k, license, unit, pos, 2.0::DOUBLE * len(list_intersect(a, grams)) / (len(a) + len(grams)) AS dice
      FROM g, t),
x AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS ws FROM documents),
y AS (SELECT doc_id, ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) AS pairs FROM x WHERE len(ws) > 1),
p AS (SELECT doc_id, unnest(pairs) AS gram, generate_subscripts(pairs, 1) AS i FROM y),
v AS (SELECT p.doc_id, p.i, k, license, n, grams FROM p JOIN (SELECT *, unnest(grams) AS gram FROM t) AS o USING (gram)),
r AS (SELECT v.doc_id, k, license, v.i, list_distinct(pairs[v.i:v.i + n - 2]) AS a, grams, array_to_string(ws[v.i:v.i + n - 1], ' ') AS unit
      FROM v JOIN y USING (doc_id) WHERE v.i + n - 1 <= len(ws)),
z AS (SELECT doc_id, 0 AS run, k, license, unit, pos, dice FROM s UNION ALL
      SELECT r.doc_id, 1, k, license, unit, last + r.i, 2.0::DOUBLE * len(list_intersect(a, grams)) / (len(a) + len(grams))
      FROM r JOIN (SELECT doc_id, max(pos) AS last FROM u GROUP BY 1) AS e USING (doc_id)),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, run, k, pos) AS n FROM z WHERE dice >= {threshold} - 1e-9)
SELECT documents.doc_id, license, round(dice, 9) + 0.0 AS dice, unit AS matched
FROM documents LEFT JOIN b ON b.doc_id = documents.doc_id AND n = 1
"""
