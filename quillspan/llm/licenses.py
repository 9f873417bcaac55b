"""Licence scans: Dice coefficients of word bigrams against templates, with DataFrame functions alone."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Short statements and notices of public licences, by SPDX identifier. Fixed values.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
_GNU = "This {0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1} Public License as published by the Free Software Foundation, either version {2} of the License, or (at your option) any later version."
_BSD = TEMPLATES[10][1] + " 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. {}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
#: Notices and full texts that are looked for inside texts only; the SQL is made of TEMPLATES alone.
MORE_TEMPLATES = [
    ("GPL-2.0", _GNU.format("program", "General", "2")),
    ("LGPL-3.0", _GNU.format("library", "Lesser General", "3")),
    ("AGPL-3.0", _GNU.format("program", "Affero General", "3")),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("MIT", TEMPLATES[4][1] + " The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("BSD-2-Clause", _BSD.format("")),
    ("BSD-3-Clause", _BSD.format("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. ")),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
]
AROUND = "[^a-z0-9]+"
#: Words that tell little; they stand for a bigram only where nothing else is in it.
COMMON = set("a all an and any are as at be by can can't do for form from has have if in is it may not of on one or so that the this to use was which with work you".split())


def words_of(text: str) -> list[str]:
    return re.sub(AROUND, " ", text.lower()).split()


def bigrams_of(text: str) -> list[str]:
    words = words_of(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def needed_words(templates: list[tuple[str, str]], least: float) -> list[str]:
    """Words of which every text as similar as least to a template has one.

    Such a text shares at least least / (2 - least) of a template's bigrams, so it has one of any set that leaves fewer
    than that; the set is of the bigrams with the longest words other than COMMON, and each stands for such a word.
    """
    out = set()
    for _, text in templates:
        telling = {g: max(g.split(), key=lambda w: (w not in COMMON, len(w))) for g in bigrams_of(text)}
        grams = sorted(telling, key=lambda g: (telling[g] in COMMON, -len(telling[g]), g))
        share = math.ceil(round(least * len(grams) / (2 - least), 9))
        out |= {telling[g] for g in grams[: len(grams) - share + 1]}
    return sorted(out)


def _bigrams(unit: Column, distinct: bool = True) -> Column:
    words = F.filter(F.split(F.regexp_replace(F.lower(unit), AROUND, " "), " "), lambda w: w != "")
    pairs = lambda w: F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b))
    # a list of one binds the words, which would else be made again for each use
    return F.transform(F.array(words), lambda w: F.when(F.size(w) > 1, F.array_distinct(pairs(w)) if distinct else pairs(w)).otherwise(F.array().cast("array<string>")))[0]


def _best_run(g: Column, t: Column, least: float) -> Column:
    """The run of a text's bigrams g that has most of a template's; null if none is similar. Each begins and ends with one of them."""

    def among(h: Column) -> Column:
        def run(j: Column) -> Column:
            ends = F.filter(F.sequence(j + t["share"] - 1, F.least(F.size(h), j + t["longest"] - 1)), lambda k: h[k - 1] - h[j - 1] < t["longest"])
            # repeats counted on both sides
            end = F.array_max(F.transform(ends, lambda k: F.struct((2 * (k - j + 1) / (h[k - 1] - h[j - 1] + 1 + t["length"])).alias("d"), (-h[k - 1]).alias("to"))))
            part = F.array_distinct(F.slice(g, h[j - 1], 1 - end["to"] - h[j - 1]))
            return F.transform(F.array(part), lambda p: F.transform(F.array(F.size(F.array_intersect(p, t["grams"]))), lambda c: F.struct(c.alias("common"), (2 * c / (F.size(p) + t["n"])).alias("dice"), (-t["k"]).alias("k"), t["name"].alias("name")))[0])[0]

        dense = F.filter(F.sequence(F.lit(1), F.size(h) - t["share"] + 1), lambda j: h[j + t["share"] - 2] - h[j - 1] < t["longest"])
        return F.array_max(F.filter(F.transform(dense, run), lambda e: e["dice"] >= least))

    places = F.filter(F.sequence(F.lit(1), F.size(g)), lambda i: F.array_contains(t["grams"], g[i - 1]))
    return F.transform(F.array(places), among)[0]


def _inside(text: Column, templates: list[tuple[str, str]], least: float) -> Column:
    """The best run of a text's words, over line ends and inside lines; null if none is similar to a template."""
    rows = []
    for k, (name, words) in enumerate(templates):
        grams, length = bigrams_of(words), len(words_of(words)) - 1
        share, longest = math.ceil(round(least * len(grams) / (2 - least), 9)), math.floor(round((2 - least) * length / least, 9))
        rows.append(F.struct(F.lit(k).alias("k"), F.lit(name).alias("name"), F.lit(len(grams)).alias("n"), F.lit(length).alias("length"), F.lit(share).alias("share"), F.lit(longest).alias("longest"), F.array(*map(F.lit, grams)).alias("grams")))

    def best(g: Column) -> Column:
        near = F.filter(F.array(*rows), lambda t: F.size(F.array_intersect(g, t["grams"])) >= t["share"])
        return F.array_max(F.filter(F.transform(near, lambda t: _best_run(g, t, least)), lambda e: e.isNotNull()))

    return F.when(text.rlike(_probe(templates, least)), F.transform(F.array(_bigrams(text, distinct=False)), best)[0])


def _probe(templates: list[tuple[str, str]], least: float) -> str:
    return r"(?i)(?<![a-z0-9])(?:" + "|".join(needed_words(templates, least)) + r")(?![a-z0-9])"


def scan_licenses(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] = TEMPLATES, inside: list[tuple[str, str]] = MORE_TEMPLATES, least: float = 0.7) -> DataFrame:
    """The best licence template for each row: doc_id, license, dice, unit and n_units.

    Units are the whole text (0) and, if there are several, each of its lines (from 1). Lower-cased words of a-z and 0-9
    form bigrams; a unit's set is compared by 2 * common / (both sizes) with the templates that the sizes allow: with a
    coefficient of least or more, a set has from least / (2 - least) to (2 - least) / least times the template's size.
    The greatest coefficient of least or more counts, of equal ones that of the first unit and then of the first
    template; n_units is how many units have one. Only texts that hold a word that each similar one must have are
    compared, and only such units of them.

    Runs of the whole text's words are compared with templates and inside too, over line ends and within lines: of the
    runs that begin and end with bigrams of a template and are at most (2 - least) / least times as long, for each
    beginning the one whose end gives the greatest coefficient with repeats counted. Of those similar by their sets the
    one with most common bigrams is taken, then that of the greatest coefficient, then of the first template. It counts
    where its coefficient is greater than the units'; unit is 0 then, and n_units still of units alone.

    A null or empty text, and one with no similar template, has license and dice null, unit -1 and n_units 0. Rows that
    repeat are judged alike. An empty table gives an empty table. Other columns are not read. No shuffle, no Python; the
    templates are a literal of a few kilobytes.
    """
    grams = [(name, bigrams_of(text)) for name, text in templates]
    listed = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(name).alias("name"), F.lit(len(g)).alias("n"), F.array(*map(F.lit, g)).alias("grams")) for k, (name, g) in enumerate(grams)])
    probe = _probe(templates, least)
    text = F.col("text")
    lines = F.split(text, "\n", -1)
    units = F.concat(F.array(text), F.when(F.size(lines) > 1, lines).otherwise(F.array().cast("array<string>")))
    numbered = F.filter(F.transform(units, lambda u, i: F.struct(i.alias("i"), u.alias("u"))), lambda x: x["u"].rlike(probe))
    with_grams = F.transform(numbered, lambda x: F.struct(x["i"].alias("i"), _bigrams(x["u"]).alias("g")))

    def best(x: Column) -> Column:
        size = F.size(x["g"])
        close = F.filter(listed, lambda t: (size * (2 - least) >= least * t["n"]) & (size * least <= (2 - least) * t["n"]))
        each = F.transform(close, lambda t: F.struct((2 * F.size(F.array_intersect(x["g"], t["grams"])) / (size + t["n"])).alias("dice"), (-x["i"]).alias("i"), (-t["k"]).alias("k"), t["name"].alias("name")))
        return F.array_max(F.filter(each, lambda e: e["dice"] >= least))

    found = F.when(text.rlike(probe), F.filter(F.transform(with_grams, best), lambda e: e.isNotNull())).otherwise(F.array().cast("array<struct<dice:double,i:int,k:int,name:string>>"))
    rows = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).select("doc_id", "text", F.coalesce(found, F.array()).alias("found"))
    rows = rows.select("doc_id", "found", _inside(text, [*templates, *inside], least).alias("part"))
    top, part = F.array_max("found"), F.col("part")
    rows = rows.select("doc_id", "found", top.alias("top"), F.when(top.isNull() | (part["dice"] > top["dice"]), part).alias("part"))
    unit = F.when(F.col("part").isNotNull(), 0).otherwise(F.coalesce(-F.col("top.i"), F.lit(-1)))
    return rows.select("doc_id", F.coalesce("part.name", "top.name").alias("license"), F.coalesce("part.dice", "top.dice").alias("dice"), unit.alias("unit"), F.size("found").alias("n_units"))


def scan_sql(templates: list[tuple[str, str]] = TEMPLATES, least: float = 0.7) -> str:
    """The scan of documents as DuckDB's SQL, with each unit compared to each template."""
    rows = ", ".join(f"({k}, '{name}', [{', '.join(repr(g) for g in bigrams_of(text))}])" for k, (name, text) in enumerate(templates))
    return f"""
WITH templates(k, name, grams) AS (VALUES {rows}),
units AS (
  SELECT doc_id, unnest(range(len(us))) AS i, unnest(us) AS u
  FROM (SELECT doc_id, CASE WHEN contains(text, chr(10)) THEN list_concat([text], string_split(text, chr(10))) ELSE [text] END AS us FROM documents)),
worded AS (SELECT doc_id, i, list_filter(string_split(regexp_replace(lower(u), '{AROUND}', ' ', 'g'), ' '), lambda w: w <> '') AS w FROM units),
gramed AS (SELECT doc_id, i, list_distinct(list_transform(range(1, len(w)), lambda j: w[j] || ' ' || w[j + 1])) AS g FROM worded WHERE len(w) > 1),
scored AS (SELECT doc_id, i, k, name, 2 * len(list_intersect(g, grams)) / (len(g) + len(grams)) AS dice FROM gramed, templates),
best AS (SELECT doc_id, i, max({{'dice': dice, 'i': -i, 'k': -k, 'name': name}}) AS e FROM scored WHERE dice >= {least} GROUP BY ALL),
top AS (SELECT doc_id, max(e) AS e, count(*) AS n FROM best GROUP BY 1)
SELECT doc_id, e.name AS license, e.dice AS dice, CAST(coalesce(-e.i, -1) AS INTEGER) AS unit, CAST(coalesce(n, 0) AS INTEGER) AS n_units
FROM documents LEFT JOIN top USING (doc_id)"""
