"""Licence scans: windows of a text against licence templates by Dice coefficient.

Texts and templates are normalised (lower case; everything but ASCII letters
and digits becomes one blank) and compared as bags of word bigrams:
2 * |common| / (|window| + |template|). A window is a run of words of the whole
text, over line ends, so a wrapped notice, one in a comment block and one in
the middle of a paragraph are the same. The sizes of two bags alone bound the
coefficient: with threshold t and a template of n bigrams a window has at most
n * (2 - t) / t bigrams, and n * t / (2 - t) of them at least are the
template's, so a template meets only places where that many of its bigrams
stand that close together; most texts have none.

At every such place all windows of up to the largest size are tried that start
and end with a bigram of the template (others have a smaller coefficient than
the windows without their ends). One running count for a start gives the common
bags of all its ends: a bigram that the template has c times is common to a
window if the c-th one before it is outside.

All of it is column expressions over one row at a time: one scan, no shuffle,
no join, and templates (a short list) as literals in the plan.

NULL and empty texts match nothing. Ties go to the larger template,
then the earlier one, then the earlier window, then the shorter one. Texts of any length are searched whole.
Repeated rows repeat; extra columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

# Licence notices and full texts as they are commonly written.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    "BSD-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. "
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
        "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
        "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
        "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
        "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
        "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "ISC-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH "
        "REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
        "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF "
        "CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
        "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
        "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
        "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "Zlib": (
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising "
        "from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to "
        "alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must "
        "not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be "
        "appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the "
        "original software. 3. This notice may not be removed or altered from any source distribution."
    ),
}


def grams(text: str) -> list[str]:
    words = re.sub("[^a-z0-9]+", " ", text.lower()).split()
    return [f"{a} {b}" for a, b in zip(words, words[1:])]


def bounds(n: int, threshold: float) -> tuple[int, int]:
    """Fewest bigrams of a template of ``n`` that a matching window has, and most bigrams of such a window."""
    return math.ceil(n * threshold / (2 - threshold) - 1e-9), math.floor(n * (2 - threshold) / threshold + 1e-9)


def _words(text: Column) -> Column:
    plain = F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))
    return F.filter(F.split(plain, " "), lambda w: w != "")


def _within(bag: Counter):
    return lambda x: x["g"].isin(sorted(bag))


def _best(own: Column, order: int, name: str, bag: Counter, threshold: float) -> Column:
    """Best window for one template: ``own`` are the places (at, g) of its bigrams in the text."""
    n = sum(bag.values())
    need, most = bounds(n, threshold)
    starts = F.filter(
        F.transform(own, lambda x, i: F.struct(x["at"].alias("at"), (F.get(own, i + need - 1)["at"] - x["at"] < most).alias("near"), i.alias("i"))), lambda x: x["near"]
    )

    def before(x: Column, k: Column) -> Column:
        """Number of the place whose bigram is the c-th before place ``k`` (-1: none within reach)."""
        reach = F.slice(own, F.greatest(k - most, F.lit(0)) + 1, F.least(k, F.lit(most)))
        same = F.filter(F.transform(reach, lambda y, j: F.struct(y["g"].alias("g"), (F.greatest(k - most, F.lit(0)) + j).alias("k"))), lambda y: y["g"] == x["g"])
        c = F.lit(1)
        for gram, times in sorted(bag.items()):
            c = F.when(x["g"] == gram, times).otherwise(c) if times > 1 else c
        return F.coalesce(F.get(same, F.size(same) - c)["k"], F.lit(-1))

    placed = F.transform(own, lambda x, k: F.struct(x["at"].alias("at"), before(x, k).alias("back")))

    def best_end(p: Column, x: Column) -> Column:
        """The best window that starts at ``x``; of equal ones the shorter."""

        def longer(seen: Column, y: Column) -> Column:
            common = seen["common"] + F.when(y["back"] < x["i"], 1).otherwise(0)
            length = y["at"] - x["at"] + 1
            dice = 2.0 * common / (length + n)
            better = (length <= most) & (dice > seen["dice"])
            return F.struct(common.alias("common"), F.when(better, dice).otherwise(seen["dice"]).alias("dice"), F.when(better, length).otherwise(seen["length"]).alias("length"))

        none = F.struct(F.lit(0).alias("common"), F.lit(0.0).alias("dice"), F.lit(0).alias("length"))
        got = F.aggregate(F.slice(p, x["i"] + 1, F.lit(most)), none, longer)
        return F.struct(got["dice"].alias("dice"), F.lit(n).alias("n"), F.lit(-order).alias("order"), (-x["at"]).alias("at"), (-got["length"]).alias("length"), F.lit(name).alias("license"))

    bound = F.transform(F.array(placed), lambda p: F.array_max(F.filter(F.transform(starts, lambda x: best_end(p, x)), lambda m: m["dice"] >= threshold)))
    return F.when(F.size(starts) > 0, F.get(bound, F.lit(0)))


def license_matches(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, threshold: float = THRESHOLD
) -> DataFrame:
    """``(doc_id, n_words, n_matches, license, dice, first_word, n_bigrams)`` for every row of ``docs``.

    ``n_matches`` counts the templates that some window reaches ``threshold``
    with; ``license`` is the best of them, ``first_word`` and ``n_bigrams``
    tell its window (words are counted from 0; -1 and 0: none). Templates of
    fewer than two words cannot match.
    """
    bags = {name: c for name, text in (TEMPLATES if templates is None else templates).items() if (c := Counter(grams(text)))}
    every = sorted({g for c in bags.values() for g in c})
    words = docs.select(F.col(id_col).alias("doc_id"), _words(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("w"))
    pairs = F.zip_with("w", F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
    known = F.filter(F.transform(pairs, lambda g, i: F.struct(i.alias("at"), g.alias("g"))), lambda x: x["g"].isin(every)) if every else F.array()
    found = words.select("doc_id", F.size("w").alias("n_words"), known.alias("known"))
    if not bags:
        return found.select(
            "doc_id", "n_words", F.lit(0).alias("n_matches"), F.lit(None).cast("string").alias("license"), F.lit(None).cast("double").alias("dice"),
            F.lit(-1).alias("first_word"), F.lit(0).alias("n_bigrams"),
        )
    own = {
        name: F.when(F.size("known") >= bounds(sum(bag.values()), threshold)[0], F.filter("known", _within(bag))).otherwise(F.slice("known", 1, 0))
        for name, bag in bags.items()
    }
    found = found.select("doc_id", "n_words", *(c.alias(f"k{i}") for i, c in enumerate(own.values())))
    best = [_best(F.col(f"k{i}"), i, name, bag, threshold) for i, (name, bag) in enumerate(bags.items())]
    top = F.array_max("m")
    return (
        found.select("doc_id", "n_words", F.filter(F.array(*best), lambda m: m.isNotNull()).alias("m"))
        .select(
            "doc_id", "n_words", F.size("m").alias("n_matches"), top["license"].alias("license"), F.round(top["dice"], 6).alias("dice"),
            F.coalesce(-top["at"], F.lit(-1)).alias("first_word"), F.coalesce(-top["length"], F.lit(0)).alias("n_bigrams"),
        )
    )


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    return license_matches(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _values() -> str:
    rows = ", ".join("({}, '{}', '{}', {})".format(k, n, t.replace("'", "''"), bounds(len(grams(t)), THRESHOLD)[1]) for k, (n, t) in enumerate(TEMPLATES.items()))
    return f"(VALUES {rows}) t(ord, license, body, most)"


#: Every window of a size that can match, between any two bigrams of a template, without any pruning.
SQL = f"""
    WITH tw AS (
      SELECT ord, license, most, list_filter(string_split(regexp_replace(lower(body), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '') AS w FROM {_values()}
    ), ts AS (SELECT ord, license, len(w) - 1 AS size, most FROM tw),
    tp AS (SELECT ord, unnest(w[1:len(w) - 1]) || ' ' || unnest(w[2:]) AS gram FROM tw),
    tg AS (SELECT ord, gram, count(*) AS c FROM tp GROUP BY ALL),
    d AS (
      SELECT row_number() OVER () AS rid, doc_id,
             list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '') AS w FROM documents
    ), p AS (SELECT rid, unnest(w[1:len(w) - 1]) || ' ' || unnest(w[2:]) AS gram, unnest(range(len(w) - 1)) AS pos FROM d WHERE len(w) > 1),
    k AS (SELECT rid, ord, pos, gram, c, row_number() OVER (PARTITION BY rid, ord, gram ORDER BY pos) AS nth FROM p JOIN tg USING (gram)),
    s AS (
      SELECT a.rid, a.ord, a.pos, b.pos AS final, b.gram, b.c, count(*) OVER (PARTITION BY a.rid, a.ord, a.pos, b.gram ORDER BY b.pos) AS times
      FROM k a JOIN k b ON b.rid = a.rid AND b.ord = a.ord AND b.pos >= a.pos JOIN ts ON ts.ord = a.ord AND b.pos < a.pos + ts.most
    ), m AS (
      SELECT rid, ord, pos, size, final - pos + 1 AS length,
             2.0 * sum(CASE WHEN times <= c THEN 1 ELSE 0 END) OVER (PARTITION BY rid, ord, pos ORDER BY final) / (final - pos + 1 + size) AS dice
      FROM s JOIN ts USING (ord)
    ), hit AS (
      SELECT m.*, row_number() OVER (PARTITION BY rid ORDER BY dice DESC, size DESC, ord, pos, length) AS r FROM m WHERE dice >= {THRESHOLD}
    ), n AS (SELECT rid, count(DISTINCT ord) AS n FROM hit GROUP BY rid)
    SELECT d.doc_id, CAST(len(d.w) AS INTEGER) AS n_words, CAST(coalesce(n.n, 0) AS INTEGER) AS n_matches, ts.license,
           CAST(round(hit.dice, 6) AS DOUBLE) AS dice, CAST(coalesce(hit.pos, -1) AS INTEGER) AS first_word, CAST(coalesce(hit.length, 0) AS INTEGER) AS n_bigrams
    FROM d LEFT JOIN n ON n.rid = d.rid LEFT JOIN hit ON hit.rid = d.rid AND hit.r = 1 LEFT JOIN ts ON ts.ord = hit.ord
"""
