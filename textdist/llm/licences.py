"""Licence scan, in DataFrame functions only: Dice coefficient over word bigrams.

A text is cut into units: its lines, and its paragraphs of two or more lines. A unit and a template are normalised (lower case, runs
of other signs than letters and digits become one space) and compared as multisets of word bigrams:
2 * shared / (size + size). A coefficient of ``least`` needs sizes within a factor (2 - least) / least, so only
templates within those bounds are candidates for a unit. Before any unit is cut, texts are passed over that lack all of a few
words, chosen so that no match can do without them. Only bigrams that some template has are shuffled.

Edges: null and empty texts, and units of one word, have no bigrams and match nothing. A unit that meets several
templates keeps the best, the first by name of equals. Repeated equal rows give one set of matches. A null key stays null.
"""

import math
import re
from collections import Counter
from functools import reduce
from operator import or_

from pyspark.sql import functions as F

#: Licence notices and short licences as published (fixed values).
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-2-Clause-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-notice": "Licensed under the BSD License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BLANK = r"\n[ \t\r\f]*\n"
#: templates are a parameter, compared with each unit in memory: at most so many
MOST_TEMPLATES = 2000


def _bigrams(text):
    """Word bigrams of a text in their order, as strings."""
    words = F.array_remove(F.split(F.translate(text, UPPER, LOWER), GAP), "")
    pairs = lambda w: F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
    return F.get(F.transform(F.array(words), pairs), F.lit(0))  # the words are worked out once


def _counted(df, text):
    """Adds grams (one element too many: the last word alone) and n, the number of bigrams."""
    return df.withColumn("grams", _bigrams(F.col(text))).withColumn("n", F.greatest(F.size("grams") - 1, F.lit(0)))


def templates_table(spark, templates):
    """Rows (template, tn, gram, tc): bigrams of the templates with their counts."""
    if len(templates) > MOST_TEMPLATES:
        raise ValueError(f"at most {MOST_TEMPLATES} templates")
    rows = _counted(spark.createDataFrame(sorted(templates.items()), "template string, text string"), "text").where("n > 0")
    grams = rows.select("template", F.col("n").alias("tn"), F.explode(F.slice("grams", 1, F.col("n"))).alias("gram"))
    return grams.groupBy("template", "tn", "gram").agg(F.count(F.lit(1)).alias("tc"))


def probes(templates, least):
    """Words of which any text with a match has at least one.

    A unit that matches a template lacks at most size - ceil(size * least / (2 - least)) of its bigrams. So words that stand in more
    of its bigrams than that cannot all be missing. Chosen greedily over all templates, long words first."""
    grams = {}
    for name, text in templates.items():
        words = re.findall(r"[0-9a-z\x80-\U0010ffff]+", text.translate(str.maketrans(UPPER, LOWER)))
        grams[name] = list(zip(words, words[1:]))
    lack = {t: len(g) - math.ceil(len(g) * least / (2 - least) - 1e-9) + 1 for t, g in grams.items() if g}
    chosen = []
    while open_ := {t: n for t, n in lack.items() if n > 0}:
        gain = Counter()
        for t, n in open_.items():
            for w, c in Counter(w for pair in grams[t] for w in set(pair)).items():
                gain[w] += min(c, n)
        word = max(gain, key=lambda w: (len(w) > 5, gain[w], w))
        chosen.append(word)
        for t in open_:
            lack[t] -= sum(word in pair for pair in grams[t])
            grams[t] = [pair for pair in grams[t] if word not in pair]
    return chosen


def _units(df, key, text):
    rows = df.select(F.col(key).alias("_k"), F.xxhash64(F.col(text)).alias("_x"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_t"))
    lines = F.transform(F.split("_t", "\n"), lambda x, i: F.struct(F.lit("line").alias("kind"), i.alias("unit"), x.alias("body")))
    parts = F.transform(F.split("_t", BLANK), lambda x, i: F.struct(F.lit("paragraph").alias("kind"), i.alias("unit"), x.alias("body")))
    many = F.filter(parts, lambda p: F.instr(p["body"], "\n") > 0)
    return rows.select("_k", "_x", F.explode(F.concat(lines, many)).alias("u")).select("_k", "_x", "u.kind", "u.unit", "u.body")


def scan(df, key="doc_id", text="text", least=0.8, templates=None):
    """Rows (key, kind, unit, licence, dice, n_bigrams): units whose best template has a coefficient of ``least``.
    ``unit`` counts the lines, or the paragraphs, of the text from 0."""
    templates = templates or TEMPLATES
    grams = templates_table(df.sparkSession, templates)
    low = F.lower(F.col(text).cast("string"))
    df = df.where(reduce(or_, [low.contains(w) for w in probes(templates, least)], F.lit(False)))
    sizes = grams.agg(F.min("tn").alias("low"), F.max("tn").alias("high")).first()
    wide = (2 - least) / least
    units = _counted(_units(df, key, text), "body").where((F.col("n") > 0) & (F.col("n") * wide >= (sizes.low or 1)) & (F.col("n") <= (sizes.high or 0) * wide))
    each = units.select("_k", "_x", "kind", "unit", "n", F.posexplode(F.slice("grams", 1, F.col("n"))).alias("p", "gram"))
    known = each.join(F.broadcast(grams.select("gram").distinct()), "gram")
    counts = known.groupBy("_k", "_x", "kind", "unit", "n", "gram").agg(F.count_distinct("p").alias("c"))
    fits = (F.col("tn") <= F.col("n") * wide) & (F.col("n") <= F.col("tn") * wide)
    shared = counts.join(F.broadcast(grams), "gram").where(fits).groupBy("_k", "_x", "kind", "unit", "n", "template", "tn").agg(F.sum(F.least("c", "tc")).alias("s"))
    scored = shared.select("*", (F.col("s") * 2.0 / (F.col("n") + F.col("tn"))).alias("dice")).where(F.col("dice") >= least)
    best = scored.groupBy("_k", "_x", "kind", "unit", "n").agg(F.min(F.struct((-F.col("dice")).alias("d"), "template")).alias("b"))
    return best.select(F.col("_k").alias(key), "kind", F.col("unit").cast("int").alias("unit"), F.col("b.template").alias("licence"),
                       F.round(-F.col("b.d"), 6).alias("dice"), F.col("n").cast("int").alias("n_bigrams"))


def _quoted(x):
    return "'" + x.replace("'", "''") + "'"


SQL = rf"""
WITH t(template, text) AS (VALUES {", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in sorted(TEMPLATES.items()))}),
u AS (SELECT doc_id, 'line' AS kind, i - 1 AS unit, l[i] AS body FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l, unnest(range(1, len(l) + 1)) AS i FROM documents)
      UNION ALL SELECT * FROM (SELECT doc_id, 'paragraph' AS kind, i - 1 AS unit, l[i] AS body FROM (SELECT doc_id, string_split_regex(coalesce(text, ''), '\n[ \t\r\f]*\n') AS l, unnest(range(1, len(l) + 1)) AS i FROM documents)) WHERE contains(body, chr(10))),
w AS (SELECT *, regexp_extract_all(translate(body, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM u),
tw AS (SELECT template, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM t),
g AS (SELECT doc_id, kind, unit, n, gram, count(*) AS c FROM (SELECT doc_id, kind, unit, len(w) - 1 AS n, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM w WHERE len(w) > 1) GROUP BY ALL),
tg AS (SELECT template, tn, gram, count(*) AS tc FROM (SELECT template, len(w) - 1 AS tn, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM tw) GROUP BY ALL),
s AS (SELECT doc_id, kind, unit, n, template, sum(least(c, tc)) * CAST(2.0 AS DOUBLE) / (n + tn) AS dice FROM g JOIN tg USING (gram) GROUP BY doc_id, kind, unit, n, template, tn)
SELECT doc_id, kind, CAST(unit AS INT) AS unit, template AS licence, round(dice, 6) AS dice, CAST(n AS INT) AS n_bigrams
FROM s WHERE dice >= 0.8 QUALIFY row_number() OVER (PARTITION BY doc_id, kind, unit ORDER BY dice DESC, template) = 1
"""
