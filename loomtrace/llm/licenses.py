"""License scan: Dice coefficient over word bigrams against templates, as one projection without a shuffle.

Units are lines, paragraphs and the whole text.  A unit reaches the threshold t with a template of b bigrams only
if it has between t/(2-t)*b and (2-t)/t*b distinct bigrams (size bounds) and holds one of any b-o+1 of the
template's bigrams, o being the least overlap; for each template those with the longest words are chosen, and a text
without any of their longer words is passed over.  Both bounds are exact.

Inline, all runs of words of up to the upper bound are units too, whatever lines they stand on.  The best run for a
template starts and ends with one of its bigrams, so only those are compared, and only in texts that hold as many of
the template's bigrams as the least overlap.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

#: Public licence notices and the operative paragraphs of short licences.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
#: Further notices, for the inline scan.
MORE_TEMPLATES = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-SA-4.0-short": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
THRESHOLD = 0.6


def bigrams(text: str) -> list[str]:
    """Distinct word bigrams of a normalised text: A-Z lower-cased, words are runs of a-z and 0-9."""
    w = re.findall("[a-z0-9]+", text.translate(str.maketrans(UPPER, LOWER)))
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:], strict=False)))


def bounds(size: int, threshold: float) -> tuple[int, int]:
    """Fewest and most bigrams of a unit that can reach the threshold."""
    return math.ceil(threshold / (2 - threshold) * size - 1e-9), math.floor((2 - threshold) / threshold * size + 1e-9)


def marker_words(templates: dict[str, str], threshold: float) -> list[str]:
    """Words of which a text with a match has one."""
    out = set()
    for text in templates.values():
        b = bigrams(text)
        need = math.ceil(threshold / (2 - threshold) * len(b) - 1e-9)
        chosen = sorted(b, key=lambda x: -max(map(len, x.split())))[: len(b) - need + 1]
        out |= {max(x.split(), key=len) for x in chosen}
    return sorted(out)


def _units(text: Column) -> Column:
    lines, paragraphs = F.split(text, "\n"), F.split(text, r"\n[ \t\r]*\n")
    return F.array_distinct(F.concat(lines, paragraphs, F.array(text)))


def _pairs(unit: Column) -> Column:
    words = F.filter(F.split(unit, "[^a-z0-9]+"), lambda w: w != "")
    pairs = lambda w: F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(1))), lambda a, b: F.when(b.isNotNull(), F.concat_ws(" ", a, b)))
    # an array of one binds the words, so that a unit is split once
    return F.get(F.transform(F.array(words), pairs), F.lit(0))


def _best_run(p: Column, t: Column) -> Column:
    """The highest coefficient with a template of the runs of at most ``most`` of the text's bigrams; null if none."""
    at = F.filter(F.transform(p, lambda x, i: F.when(F.array_contains(t["b"], x), i)), lambda i: i.isNotNull())

    def dice(run: Column) -> Column:
        return F.lit(2.0) * F.size(F.array_intersect(run, t["b"])) / (F.size(F.array_distinct(run)) + t["n"])

    def from_(at: Column, i: Column, k: Column) -> Column:
        ends = F.filter(F.slice(at, k + 1, t["most"]), lambda j: j < i + t["most"])
        return F.when(F.size(ends) >= t["least"], F.array_max(F.transform(ends, lambda j: F.transform(F.array(F.slice(p, i + 1, j - i + 1)), dice)[0])))

    return F.transform(F.array(at), lambda at: F.array_max(F.transform(at, lambda i, k: from_(at, i, k))))[0]


def scan(docs: DataFrame, *, text: str = "text", templates: dict[str, str] | None = None, threshold: float = THRESHOLD, inline: bool = False) -> tuple[DataFrame, str]:
    """The documents with one struct column added, and its name: ``license`` (best template, ties by name; null if
    none), ``dice`` (0 if none), ``licenses`` (all templates reached, sorted, comma-joined).

    ``inline`` looks for notices inside longer lines and paragraphs too, among MORE_TEMPLATES besides unless templates
    are given.  Null and empty texts match nothing.  Rows are kept, repeated ones too; other columns pass through whatever their
    names.
    """
    templates = (TEMPLATES | MORE_TEMPLATES if inline else TEMPLATES) if templates is None else templates
    table = F.array(*(F.struct(F.lit(k).alias("id"), F.array(*map(F.lit, b)).alias("b"), F.lit(len(b)).alias("n"), *(F.lit(x).alias(c) for c, x in zip(("least", "most"), bounds(len(b), threshold), strict=True))) for k, t in sorted(templates.items()) if (b := bigrams(t))))
    fewest = min(bounds(len(bigrams(t)), threshold)[0] for t in templates.values())
    lower = F.translate(F.col(text), UPPER, LOWER)

    def reached(unit: Column) -> Column:
        return F.filter(F.array(F.array_distinct(_pairs(unit))), lambda p: F.size(p) > fewest)

    sets = F.flatten(F.transform(_units(lower), reached))
    sets = F.transform(sets, lambda p: F.filter(p, lambda x: x.isNotNull()))
    hits = F.flatten(F.transform(sets, lambda p: F.transform(
        F.filter(table, lambda t: (F.size(p) >= t["least"]) & (F.size(p) <= t["most"])),
        lambda t: F.struct((F.lit(2.0) * F.size(F.array_intersect(p, t["b"])) / (F.size(p) + t["n"])).alias("dice"), t["id"].alias("id")))))
    if inline:
        every = F.array(*map(F.lit, sorted({x for t in templates.values() for x in bigrams(t)})))
        within = lambda p, held: F.transform(F.filter(table, lambda t: F.size(F.array_intersect(held, t["b"])) >= t["least"]), lambda t: F.struct(_best_run(p, t).alias("dice"), t["id"].alias("id")))
        runs = F.transform(F.array(_pairs(lower)), lambda p: F.transform(F.array(F.array_intersect(p, every)), lambda held: within(p, held))[0])[0]
        hits = F.concat(hits, runs)
    hits = F.filter(hits, lambda h: h["dice"] >= threshold)
    pattern = "|".join(marker_words(templates, threshold))
    found = F.when(lower.rlike(pattern), hits).otherwise(F.array().cast("array<struct<dice:double,id:string>>"))
    held, name = free_name(docs, "hits"), free_name(docs, "scan")
    best = F.array_max(F.transform(F.col(held), lambda h: h["dice"]))
    ids = F.array_sort(F.array_distinct(F.transform(F.col(held), lambda h: h["id"])))
    first = F.array_min(F.transform(F.filter(F.col(held), lambda h: h["dice"] == best), lambda h: h["id"]))
    out = F.struct(first.alias("license"), F.coalesce(best, F.lit(0.0)).alias("dice"), F.array_join(ids, ",").alias("licenses"))
    return docs.withColumn(held, found).withColumn(name, out).drop(held), name


def oracle(templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> str:
    """DuckDB SQL for (doc_id, license, dice, licenses) of every document."""
    templates = TEMPLATES if templates is None else templates
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({quote(k)}, [{', '.join(map(quote, bigrams(t)))}])" for k, t in sorted(templates.items()))
    return f"""
WITH t(id, b) AS (VALUES {values}),
d AS (SELECT row_number() OVER () AS r, doc_id, translate(text, '{UPPER}', '{LOWER}') AS x FROM documents),
u AS (SELECT DISTINCT r, unnest(list_concat(string_split(x, chr(10)), regexp_split_to_array(x, '\\n[ \\t\\r]*\\n'), [x])) AS x FROM d),
w AS (SELECT r, regexp_extract_all(x, '[a-z0-9]+') AS w FROM u),
p AS (SELECT r, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS p FROM w WHERE len(w) > 1),
h AS (SELECT r, id, max(2.0 * len(list_intersect(p, b)) / (len(p) + len(b))) AS dice FROM p JOIN t ON len(p) >= {threshold} / {2 - threshold} * len(b) - 1e-9 AND len(p) <= {2 - threshold} / {threshold} * len(b) + 1e-9 GROUP BY ALL),
best AS (SELECT r, first(id ORDER BY dice DESC, id) AS license, max(dice) AS dice, string_agg(id, ',' ORDER BY id) AS licenses FROM h WHERE dice >= {threshold} GROUP BY r)
SELECT doc_id, license, coalesce(dice, 0.0)::DOUBLE AS dice, coalesce(licenses, '') AS licenses FROM d LEFT JOIN best USING (r)"""
