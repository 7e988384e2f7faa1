"""Licence scan: lines compared with licence templates by the Dice coefficient of their word bigrams.

Dice d = 2 * common / (a + b) can only reach t if the sizes lie within a factor of t / (2 - t) of each other, so most
lines meet no template at all. Everything is a Column over the row: templates are literals of the plan, texts are never
shuffled, and only documents with a finding leave the scan.
"""

from __future__ import annotations

import math
import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import text_of

# Usual short notices of public licences: (name, text).
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "This software is released under the MIT License."),
    ("BSD-3-Clause", "Redistribution and use are permitted under the BSD 3-Clause License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("proprietary", "All rights reserved. No part may be reproduced without permission."),
)


def bigrams(text: str) -> list[str]:
    w = re.findall(r"[^\W_]+", text.lower())
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:])))


def _bigrams(line: Column) -> Column:
    words = F.filter(F.split(F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")
    return F.transform(F.array(words), lambda w: F.array_distinct(
        F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))))[0]


def scan_licenses(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, at_least: float = 0.8) -> DataFrame:
    """(doc_id, licence, dice): the best line of each document for every template that it reaches ``at_least`` with.

    Text is lowered, and all but letters and digits separates words. A template or line of fewer than two words has no
    bigrams and matches nothing. Templates are a short list that becomes part of the plan.

    * Null and empty texts and texts without a match give no row. Several templates may match; each gives its row.
    * Repeated rows of an id give one row per licence, the best; a null doc_id counts as an id.
    * Long texts are read whole. An empty table gives no rows. Other columns are ignored whatever their names.
    """
    known = [(name, bigrams(text)) for name, text in templates]
    known = [(name, b) for name, b in known if b]
    if not known:
        return docs.select("doc_id", F.lit("").alias("licence"), F.lit(0.0).alias("dice")).limit(0)
    least = at_least / (2 - at_least)
    low, high = min(len(b) for _, b in known) * least, max(len(b) for _, b in known) / least

    def found(b: Column) -> Column:
        n = F.size(b)

        def dice(name, own):
            score = F.lit(2.0) * F.size(F.array_intersect(b, F.array(*[F.lit(x) for x in own]))) / (n + len(own))
            fits = (n >= len(own) * least) & (n <= len(own) / least)
            return F.when(fits, F.struct(F.lit(name).alias("licence"), score.alias("dice")))

        return F.filter(F.array(*[dice(name, own) for name, own in known]), lambda x: x["dice"] >= at_least)

    # a line of n words has at most n - 1 bigrams; by its blanks alone most lines are too long or too short
    lines = F.filter(F.array_distinct(F.split(text_of(), "\n")), lambda x: F.length(x) >= 2 * int(low))
    pieces = F.filter(F.transform(lines, _bigrams), lambda b: F.size(b).between(low, high))
    hits = docs.select("doc_id", F.flatten(F.transform(pieces, found)).alias("hits")).where(F.size("hits") > 0)
    return hits.select("doc_id", F.explode("hits").alias("h")).groupBy("doc_id", F.col("h.licence").alias("licence")).agg(F.max("h.dice").alias("dice"))


# Full texts and headers as they are published, without the names and years that differ.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE
OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions
are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution."""
_BSD3 = """ 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from
this software without specific prior written permission."""
_BSD_END = """ THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER
OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF
ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the
above copyright notice and this permission notice appear in all copies."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may
obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/2.0/."""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell,
or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""


def _gnu(library: str, version: str) -> str:
    return f"""This program is free software: you can redistribute it and/or modify it under the terms of the GNU {library} General Public License as
published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."""


def _creative(code: str, words: str, spdx: str) -> list[tuple]:
    return [(spdx, f"CC {code} 4.0", tuple(bigrams(f"CC {code} 4.0")), ()), (spdx, f"Creative Commons {words} 4.0 International", tuple(bigrams(f"{words} 4.0")), ())]


def _notices() -> tuple[tuple, ...]:
    # titles stand alone: a run may leave out the words that introduce them
    out = [("BSD-3-Clause", TEMPLATES[2][1], ("3 clause",), ()), ("proprietary", TEMPLATES[7][1], ("rights reserved",), ()), ("proprietary", "All rights reserved.", ("rights reserved",), ())]
    out += [("MIT", "MIT License", ("mit license",), ())] + [("MIT", _MIT, ("hereby granted",), ())]
    out += [("Apache-2.0", "Apache License, Version 2.0", ("apache license", "version 2"), ())] + [("Apache-2.0", "Apache License 2.0", ("apache license", "license 2"), ())]
    out += [("Apache-2.0", "Apache 2.0 License", ("apache 2",), ())] + [("Apache-2.0", _APACHE, ("apache license", "version 2"), ())]
    for n in "23":
        for title in (f"BSD {n}-Clause License", f"{n}-Clause BSD License"):
            out.append((f"BSD-{n}-Clause", title, (f"{n} clause",), ()))
    out += [("BSD-3-Clause", _BSD + _BSD3 + _BSD_END, ("or promote",), ()), ("BSD-2-Clause", _BSD + _BSD_END, ("redistribution and",), ("or promote",))]
    out += [("ISC", "ISC License", ("isc license",), ())] + [("ISC", _ISC, ("hereby granted",), ())]
    for spdx, library, versions in (("GPL", "", ("2", "3")), ("LGPL", "Lesser", ("2.1", "3")), ("AGPL", "Affero", ("3",))):
        kind = ("lesser general",) if library == "Lesser" else ("affero general",) if library else ("gnu general",)
        for v in versions:
            name, number = f"{spdx}-{v if '.' in v else v + '.0'}", tuple(bigrams(f"version {v}"))
            out += [(name, _gnu(library, v), (*kind, *number), ())]
            for form in (f"version {v}", f"v{v}"):
                must = (*kind, *(bigrams(form) or [f"license v{v}"]))
                out.append((name, f"GNU {library} General Public License, {form}", must, ()))
            out += [(name, TEMPLATES[3][1].replace("version 3", f"version {v}").replace("General", f"{library} General"), (*kind, *number), ())]
    out += [("MPL-2.0", "Mozilla Public License, version 2.0", ("mozilla public", "version 2"), ())] + [("MPL-2.0", "Mozilla Public License 2.0", ("mozilla public", "license 2"), ())]
    out += [("MPL-2.0", _MPL, ("mozilla public",), ()), ("Unlicense", _UNLICENSE, ("unencumbered software",), ())]
    for code, words in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"),
                        ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")):
        out += _creative(code, words, f"CC-{code}-4.0")
    for name in ("MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "Unlicense", "CC0-1.0", *(f"CC-{c}-4.0" for c in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND")),
                 "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0"):
        out.append((name, f"SPDX-License-Identifier: {name}", tuple(bigrams(f"Identifier: {name}")), ()))
    return tuple(dict.fromkeys(out))


#: Notices in use: (licence, text, word pairs that must be there, word pairs that must not). The pairs tell versions and variants apart.
NOTICES = _notices()


_COMMON = {"by", "general", "public", "software", "version"}  # words of other texts, the last choice as anchors


def _anchors(known: list[tuple]) -> list[str]:
    """Words of which every text with a match holds one: a match holds all pairs that must be there and ``need`` pairs in all."""
    chosen: list[str] = []

    def held(own, must, need) -> bool:
        got = lambda pairs: sum(any(a in w for a in chosen for w in p.split()) for p in pairs)
        return got(must) > 0 or len(own) - got(own) < need

    for own, must, need in sorted(known, key=lambda k: len(k[0])):
        for word in sorted({w for p in must or own for w in p.split()}, key=lambda w: (w in _COMMON, -len(w), w)):
            if held(own, must, need):
                break
            chosen.append(word)
    return chosen


def _holds(text: Column, word: str) -> Column:
    # short words are common inside others
    return text.contains(word) if len(word) > 4 else text.rlike(rf"(?<![\p{{L}}\p{{N}}]){word}(?![\p{{L}}\p{{N}}])")


def scan_notices(docs: DataFrame, notices: tuple[tuple, ...] = NOTICES, at_least: float = 0.8) -> DataFrame:
    """(doc_id, licence, dice): the best run of words of each document for every licence with a notice that it reaches ``at_least`` with.

    A run may stand anywhere: inside a line, wrapped over lines or behind comment marks, since all but letters and digits
    only separates words. It is as long as may match at all, t / (2 - t) of the notice upwards and downwards. The best
    run begins with a pair of the notice, and its pairs are the first distinct ones from there, so each such place needs one pass.

    Nulls, empty texts, repeated ids and empty tables are treated as by ``scan_licenses``.
    """
    least = at_least / (2 - at_least)
    known = []
    for name, text, must, lacks in notices:
        if own := bigrams(text):
            words = len(re.findall(r"[^\W_]+", text))
            known.append((name, own, must, lacks, math.ceil(len(own) * least - 1e-9), math.floor((words - 1) / least + 1e-9)))
    if not known:
        return docs.select("doc_id", F.lit("").alias("licence"), F.lit(0.0).alias("dice")).limit(0)
    lit = lambda pairs: F.split(F.lit("\n".join(pairs)), "\n")  # noqa: E731  (one literal in the plan)
    every = list(dict.fromkeys(p for k in known for p in k[1]))

    def best(p: Column, present: Column, name, own, must, lacks, need, span) -> Column:
        mine = lit(own)
        near = lambda i: F.slice(p, i, F.lit(span))
        starts = F.filter(F.sequence(F.lit(1), F.size(p)), lambda i: F.array_contains(mine, F.get(p, i - 1)))
        runs = F.array_distinct(F.transform(F.filter(starts, lambda i: F.size(F.array_intersect(near(i), mine)) >= need), lambda i: F.array_join(near(i), "\n")))

        def further(s: Column, x: Column) -> Column:
            c = s["c"] + F.array_contains(mine, x).cast("int")
            m = s["m"] + (F.array_contains(lit(must), x).cast("int") if must else F.lit(0)) - (F.array_contains(lit(lacks), x).cast("int") * 1000 if lacks else F.lit(0))
            dice = F.lit(2.0) * c / (s["a"] + 1 + len(own))
            return F.struct((s["a"] + 1).alias("a"), c.alias("c"), m.alias("m"), F.when(m == len(must), F.greatest(s["best"], dice)).otherwise(s["best"]).alias("best"))

        zero = F.struct(F.lit(0).alias("a"), F.lit(0).alias("c"), F.lit(0).alias("m"), F.lit(0.0).alias("best"))
        top = F.array_max(F.transform(runs, lambda r: F.aggregate(F.array_distinct(F.split(r, "\n")), zero, further, lambda s: s["best"])))
        return F.when(F.size(F.array_intersect(present, mine)) >= need, F.struct(F.lit(name).alias("licence"), top.alias("dice")))

    def found(p: Column) -> Column:
        # pairs of any notice first: almost all notices are out by them
        return F.transform(F.array(F.array_intersect(lit(every), p)), lambda here: F.filter(F.array(*[best(p, here, *k) for k in known]), lambda x: x["dice"] >= at_least))[0]

    low = F.lower(text_of())
    held = reduce(or_, [_holds(low, w) for w in _anchors([(k[1], k[2], k[4]) for k in known])])
    words = F.filter(F.split(F.regexp_replace(low, r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")
    pairs = F.transform(F.array(words), lambda w: F.zip_with(
        F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b)))
    # a text of one word has no pairs, and no sequence of their places
    hits = docs.where(held).select("doc_id", F.flatten(F.transform(F.filter(pairs, lambda p: F.size(p) > 0), found)).alias("hits"))
    return hits.select("doc_id", F.explode("hits").alias("h")).groupBy("doc_id", F.col("h.licence").alias("licence")).agg(F.max("h.dice").alias("dice"))


def oracle(at_least: float = 0.8) -> str:
    rows = ", ".join(f"('{n}', [{', '.join(repr(b) for b in bigrams(t))}])" for n, t in TEMPLATES)
    return f"""
WITH t(licence, own) AS (VALUES {rows}), l AS (SELECT doc_id, unnest(list_distinct(string_split(coalesce(text, ''), chr(10)))) AS line FROM documents),
w AS (SELECT doc_id, list_filter(string_split(regexp_replace(lower(line), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda x: x <> '') AS ws FROM l),
b AS (SELECT doc_id, list_distinct([ws[i] || ' ' || ws[i + 1] FOR i IN range(1, len(ws))]) AS bs FROM w WHERE len(ws) BETWEEN 2 AND 60)
SELECT doc_id, licence, max(dice) AS dice FROM (
  SELECT doc_id, licence, 2.0::DOUBLE * len(list_intersect(bs, own)) / (len(bs) + len(own)) AS dice FROM b, t) WHERE dice >= {at_least} GROUP BY 1, 2"""
