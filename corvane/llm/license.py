"""Licence scans: normalised lines against licence templates by the Dice coefficient of word bigrams.

Every line of a text is a unit, and so is the whole text: lower-cased, everything
but letters, digits and dots within numbers turned into single spaces.  A unit
with x distinct bigrams can pass a coefficient d against a template with y only
where x lies between y*d/(2-d) and y*(2-d)/d, exclusive; units outside every template's bounds are
dropped before their bigrams are made, and the rest meet only the templates
whose bounds they are in.

Lines that reach no template are read again as one run of words (a text that does reach one as a
whole is not): windows that begin at a bigram of a template and are within its bounds are
units too, so a notice wrapped over lines or inside a long line is found.  All windows of a
document are unit -2.

Everything is DataFrame expressions; the templates are a fixed table of literals.

Cases: null and empty text, and units of one word, match nothing; equal scores are
decided by template name; repeated rows give repeated results; a null id is kept;
an empty table gives an empty result; further columns do not matter.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Scratch

DICE = 0.8

_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must
    retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and
    the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND
    FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
    (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
    CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

#: Licence notices and texts by SPDX-like name.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-3.0-line": "Licensed under the GNU General Public License v3.0.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction.',
    "MIT-line": "Licensed under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "proprietary": "All rights reserved.",
    # whole texts of the short licences
    "MIT-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
        in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to
        permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or
        substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
        FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
        CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "BSD-2-Clause-text": f"{_BSD_HEAD} {_BSD_TAIL}",
    "BSD-3-Clause-text": f"{_BSD_HEAD} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_TAIL}",
    "ISC-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this
        permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
        MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA
        OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    # the titles of the long ones
    "Apache-2.0-title": "Apache License Version 2.0, January 2004",
    "GPL-2.0-title": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "GPL-3.0-title": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "LGPL-2.1-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "LGPL-3.0-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "AGPL-3.0-title": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "MPL-2.0-title": "Mozilla Public License Version 2.0",
}

#: The usual wordings of a notice, and what each licence is called in them.
WORDINGS = {"released": "Released under {}.", "licensed": "Licensed under {}.", "distributed": "Distributed under {}.", "work": "This work is licensed under {}."}
NAMES = {
    "MIT": ["the MIT License"], "ISC": ["the ISC License"], "Unlicense": ["the Unlicense"], "BSD-2-Clause": ["the BSD 2-Clause License"], "BSD-3-Clause": ["the BSD 3-Clause License"],
    "Apache-2.0": ["the Apache License, Version 2.0"], "MPL-2.0": ["the Mozilla Public License, version 2.0"], "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal"],
    "GPL-2.0": ["the GNU General Public License, version 2"], "GPL-3.0": ["the GNU General Public License, version 3", "the GNU General Public License v3.0"],
    "LGPL-2.1": ["the GNU Lesser General Public License, version 2.1"], "LGPL-3.0": ["the GNU Lesser General Public License, version 3"], "AGPL-3.0": ["the GNU Affero General Public License, version 3"],
    "CC-BY-4.0": ["CC BY 4.0"], "CC-BY-SA-4.0": ["CC BY-SA 4.0"], "CC-BY-NC-4.0": ["CC BY-NC 4.0"],
}
for _name, _called in NAMES.items():
    for _how, _wording in WORDINGS.items():
        for _i, _as in enumerate(_called):
            if _wording.format(_as) not in TEMPLATES.values():
                TEMPLATES[f"{_name}-{_how}{_i + 1 if _i else ''}"] = _wording.format(_as)


def normalise(text: str) -> str:
    """The Python twin of the expression below, for the templates."""
    return re.sub(r"[^a-z0-9.]+|\.(?![0-9])", " ", re.sub("[A-Z]", lambda m: m[0].lower(), text)).strip(" ")


def bigrams(text: str) -> list[str]:
    words = [w for w in normalise(text).split(" ") if w]
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def _literal(dice: float) -> str:
    rows = []
    for name, text in sorted(TEMPLATES.items()):
        grams = bigrams(text)
        n = len(grams)
        listed = ",".join(f"'{g}'" for g in grams)
        rows.append(f"named_struct('name','{name}','low',{n * dice / (2 - dice) + 1e-9}D,'high',{n * (2 - dice) / dice - 1e-9}D,'size',{n},'grams',array({listed}))")
    return f"array({','.join(rows)})"


def probe_words(dice: float) -> list[str]:
    """Words of which every unit that reaches ``dice`` against some template holds one.

    Such a unit shares y*d/(2-d) of a template's y bigrams at least, so it has one of any
    set of bigrams that leaves fewer out.  Words are taken greedily, those first that cover most
    of what the templates still lack; short ones only where nothing else is left.
    """
    open_ = {}
    for text in sorted(set(TEMPLATES.values())):
        grams = [frozenset(g.split(" ")) for g in bigrams(text)]
        open_[text] = (grams, math.ceil(len(grams) * dice / (2 - dice) - 1e-9) - 1)
    out: list[str] = []
    while open_ := {t: (g, most) for t, (g, most) in open_.items() if len(g) > most}:
        gain: dict[str, float] = {}
        for grams, most in open_.values():
            for w in {w for g in grams for w in g}:
                gain[w] = gain.get(w, 0) + min(sum(w in g for g in grams) / (len(grams) - most), 1.0)
        best = min(gain, key=lambda w: (len(w) < 6 and "." not in w, -round(gain[w], 9), -len(w), w))
        out.append(best)
        open_ = {t: ([g for g in grams if best not in g], most) for t, (grams, most) in open_.items()}
    # a text that holds a word holds its parts too
    return sorted(w for w in out if not any(x != w and x in w for x in out))


_LOWER = "translate(unit, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _any_of(column: str, dice: float) -> Column:
    """Whether a text holds a probe word: plain byte searches over the lower-cased text, which the lambda makes once."""

    def holds(low: Column) -> Column:
        out = F.lit(False)
        for w in probe_words(dice):
            out = out | F.contains(low, F.lit(w))
        return out

    return F.exists(F.array(F.lower(column)), holds)


def _words(unit: str) -> Column:
    """The normalised words of a column's text."""
    return F.filter(F.split(F.regexp_replace(F.expr(_LOWER.replace("unit", unit)), r"[^a-z0-9.]+|\.(?![0-9])", " "), " +"), lambda w: w != "")


def _in_order(w: Column) -> Column:
    # filters may run after this, so no length may be negative
    pairs = F.greatest(F.size(w) - 1, F.lit(0))
    return F.zip_with(F.slice(w, F.lit(1), pairs), F.slice(w, F.lit(2), pairs), lambda a, b: F.concat_ws(" ", a, b))


def _unit_scores(units: DataFrame, dice: float) -> DataFrame:
    """(row, unit_no, license, dice) of the units that reach ``dice``, with the other columns of ``units``."""
    sizes = [len(bigrams(t)) for t in TEMPLATES.values()]
    most = int(max(sizes) * (2 - dice) / dice)
    least = min(sizes) * dice / (2 - dice)
    union = sorted({g for t in TEMPLATES.values() for g in bigrams(t)})
    keep = [c for c in units.columns if c != "unit"]
    units = units.where(_any_of("unit", dice)).select(*keep, _words("unit").alias("w"))
    # repeats only lower the number of distinct bigrams, so just the lower bound prunes by words
    units = units.where(F.size("w") - 1 >= least)
    units = units.select(*keep, F.array_distinct(_in_order(F.col("w"))).alias("g")).where(F.size("g").between(int(least), most))
    units = units.where(F.arrays_overlap("g", F.array(*[F.lit(g) for g in union])))
    fits = F.expr(f"filter({_literal(dice)}, t -> size(g) >= t.low AND size(g) <= t.high)")
    pairs = units.select(*keep, "g", F.explode(fits).alias("t"))
    score = 2.0 * F.size(F.array_intersect("g", F.col("t.grams"))) / (F.size("g") + F.col("t.size"))
    return pairs.select(*keep, F.col("t.name").alias("license"), F.round(score, 6).alias("dice")).where(F.col("dice") > dice)


def _window_scores(rows: DataFrame, dice: float) -> DataFrame:
    """(doc_id, unit_no, license, dice) of the best window of each template in ``text``."""
    union = sorted({g for t in TEMPLATES.values() for g in bigrams(t)})
    rows = rows.where(_any_of("text", dice)).select("doc_id", _in_order(_words("text")).alias("o"))
    rows = rows.select("doc_id", "o", F.array_intersect("o", F.array(*[F.lit(g) for g in union])).alias("d")).where(F.size("d") > 0)
    # a window that reaches `dice` shares low = y*d/(2-d) bigrams at least
    near = F.expr(f"filter({_literal(dice)}, t -> size(array_intersect(d, t.grams)) >= t.low)")
    pairs = rows.select("doc_id", "o", F.explode(near).alias("t"))
    # the first occurrences in a window keep their order, so every prefix of them is a shorter window's set
    best = F.expr("""
        array_max(transform(
            filter(sequence(0, size(o) - 1), i -> array_contains(t.grams, o[i]) AND size(array_intersect(slice(o, i + 1, int(2 * t.high)), t.grams)) >= t.low),
            i -> aggregate(array_distinct(slice(o, i + 1, int(2 * t.high))), named_struct('x', 0, 'c', 0, 'best', 0.0D),
                (a, e) -> named_struct('x', a.x + 1, 'c', a.c + int(array_contains(t.grams, e)), 'best', greatest(a.best, 2.0D * (a.c + int(array_contains(t.grams, e))) / (a.x + 1 + t.size))),
                a -> a.best)))
        """)
    return pairs.select("doc_id", F.lit(-2).alias("unit_no"), F.col("t.name").alias("license"), F.round(best, 6).alias("dice")).where(F.col("dice") > dice)


def license_matches(docs: DataFrame, dice: float = DICE) -> DataFrame:
    """(doc_id, unit_no, license, dice) of every unit above ``dice``; unit_no -1 is the whole text, -2 its windows."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "license")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where(_any_of("text", dice))
    # few of all texts, and all the work is in them: dealt evenly, and numbered, as ids may be repeated or null
    base = base.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).withColumn("number", F.monotonically_increasing_id())
    base = scratch.put(base, "base")
    units = base.select("doc_id", "number", F.posexplode(F.concat(F.split("text", "\n"), F.array("text"))).alias("unit_no", "unit"), F.size(F.split("text", "\n")).alias("n"))
    units = units.withColumn("unit_no", F.when(F.col("unit_no") == F.col("n"), -1).otherwise(F.col("unit_no"))).where("n > 1 or unit_no >= 0").drop("n")
    hits = scratch.put(_unit_scores(units, dice), "hits")
    # a text that is a licence as a whole is not read again, nor are lines that are notices
    whole = F.when((F.col("unit_no") == 0) & (F.col("lines") == 1), -1).otherwise(F.col("unit_no"))
    lines = base.select(F.col("number").alias("of"), F.size(F.split("text", "\n")).alias("lines"))
    taken = hits.join(lines, F.col("number") == F.col("of")).groupBy("number").agg(F.collect_set(whole).alias("hit"))
    rest = base.join(taken, "number", "left").where("not coalesce(array_contains(hit, -1), false)")
    kept = F.filter(F.split("text", "\n"), lambda _, i: ~F.coalesce(F.array_contains("hit", i), F.lit(False)))
    return hits.select("doc_id", "unit_no", "license", "dice").unionByName(_window_scores(rest.select("doc_id", F.array_join(kept, "\n").alias("text")), dice))


def license_report(docs: DataFrame, dice: float = DICE) -> DataFrame:
    """Per document: matched units, the distinct licences in order, the best one and its coefficient."""
    hits = license_matches(docs, dice)
    best = hits.groupBy("doc_id").agg(
        F.countDistinct("unit_no").alias("n_units"), F.array_join(F.sort_array(F.collect_set("license")), ",").alias("licenses"),
        F.max("dice").alias("best_dice"), F.min_by("license", F.struct((-F.col("dice")).alias("d"), F.col("license"))).alias("best_license"),
    )
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    out = ids.join(best, "doc_id", "left")
    return out.select("doc_id", F.coalesce("n_units", F.lit(0)).alias("n_units"), F.coalesce("licenses", F.lit("")).alias("licenses"), "best_license", "best_dice")


def oracle_sql(dice: float = DICE) -> str:
    rows = []
    for name, text in sorted(TEMPLATES.items()):
        grams = bigrams(text)
        listed = ",".join(f"'{g}'" for g in grams)
        rows.append(f"('{name}', [{listed}])")
    return rf"""
WITH t(name, grams) AS (VALUES {",".join(rows)}),
u AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS unit, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS unit_no FROM documents
    UNION ALL SELECT doc_id, text, -1 FROM documents WHERE contains(text, chr(10))
),
w AS (SELECT doc_id, unit_no, list_filter(string_split(regexp_replace(regexp_replace(translate(unit, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || ' ', '[^a-z0-9.]+', ' ', 'g'), '\.([^0-9])', ' \1', 'g'), ' '), lambda x: x <> '') AS w FROM u),
g AS (SELECT doc_id, unit_no, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM w WHERE len(w) > 1),
hits AS (SELECT doc_id, unit_no, name, round(2.0::DOUBLE * len(list_intersect(g, grams)) / (len(g) + len(grams)), 6) AS dice FROM g, t WHERE len(g) <= 100 AND list_has_any(g, grams)),
best AS (
    SELECT doc_id, count(DISTINCT unit_no) AS n_units, array_to_string(list_sort(list(DISTINCT name)), ',') AS licenses, max(dice) AS best_dice, arg_min(name, (-dice, name)) AS best_license
    FROM hits WHERE dice > {dice} GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_units, 0) AS n_units, coalesce(licenses, '') AS licenses, best_license, best_dice FROM documents d LEFT JOIN best USING (doc_id)
"""
