"""Licence scans: normalised text against licence templates by Dice coefficient over word bigrams.

A text's words are lower-cased runs of letters and digits. The Dice coefficient of two bigram sets of sizes a and
b is at most 2 min(a, b) / (a + b), so a passage (a line, a paragraph, the whole text) is compared with a template
only if its size lies within bounds. A template inside a longer passage is found by windows over the words of the
whole text, whatever its line breaks: as many words as the template has, laid so that one of its bigrams stands
where the template has it.

A passage that reaches the least Dice coefficient has at least two thirds (at 0.8) of a template's bigrams. A few
words are chosen so that no template keeps as many without them. A text without these words is compared with
nothing, and another one only with templates of which it has two thirds of the bigrams. The templates are one
literal table, so their number doesn't change the plan. Each template keeps its best match alone, so the work grows
with a text's length, and not with its square, however many matches it has.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST = 0.8

#: Names of public licences, as their notices write them.
NAMES = (
    ("0BSD", "BSD Zero Clause License"),
    ("AGPL-3.0", "GNU Affero General Public License, version 3"),
    ("Apache-2.0", "Apache License, Version 2.0"),
    ("Artistic-2.0", "Artistic License 2.0"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSL-1.0", "Boost Software License, Version 1.0"),
    ("CC-BY-3.0", "Creative Commons Attribution 3.0 Unported License"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International License"),
    ("CC-BY-4.0", "CC BY 4.0"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-NC-4.0", "CC BY-NC 4.0"),
    ("CC-BY-NC-SA-4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    ("CC-BY-NC-SA-4.0", "CC BY-NC-SA 4.0"),
    ("CC-BY-ND-4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("CC-BY-SA-3.0", "Creative Commons Attribution-ShareAlike 3.0 Unported License"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-SA-4.0", "CC BY-SA 4.0"),
    ("CDDL-1.0", "Common Development and Distribution License, Version 1.0"),
    ("EPL-2.0", "Eclipse Public License, Version 2.0"),
    ("EUPL-1.2", "European Union Public Licence, version 1.2"),
    ("GFDL-1.3", "GNU Free Documentation License, Version 1.3"),
    ("GPL-2.0", "GNU General Public License, version 2"),
    ("GPL-3.0", "GNU General Public License, version 3"),
    ("ISC", "ISC License"),
    ("LGPL-2.1", "GNU Lesser General Public License, version 2.1"),
    ("LGPL-3.0", "GNU Lesser General Public License, version 3"),
    ("MIT", "MIT License"),
    ("MPL-2.0", "Mozilla Public License, Version 2.0"),
    ("ODbL-1.0", "Open Database License, Version 1.0"),
    ("Zlib", "zlib License"),
)
#: How notices of one sentence name a licence.
NOTICES = ("Licensed under {}", "Licensed under the {}", "Released under the {}", "This work is licensed under a {}", "This work is licensed under the {}", "Distributed under the terms of the {}")

#: Whole texts of public licences, and notices that they ask to be used.
NO_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
    "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
BSD_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
    "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
    "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
    "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
    "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
BSD_CONDITIONS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution.",
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission.",
)
MIT_GRANT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
)
TEXTS = (
    ("MIT", MIT_GRANT),
    ("MIT", f"{MIT_GRANT} The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {NO_WARRANTY}"),
    ("BSD-3-Clause", BSD_CONDITIONS[0]),
    ("BSD-2-Clause", " ".join([*BSD_CONDITIONS[:3], BSD_WARRANTY])),
    ("BSD-3-Clause", " ".join([*BSD_CONDITIONS, BSD_WARRANTY])),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "0BSD",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
        "MERCHANTABILITY AND FITNESS.",
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising "
        "from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to "
        "alter it and redistribute it freely, subject to the following restrictions:",
    ),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or '
        "implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


def default_texts() -> tuple[tuple[str, str], ...]:
    """(licence, text): every notice with every name, then the texts above."""
    return tuple((spdx, notice.format(name)) for spdx, name in NAMES for notice in NOTICES) + TEXTS


@dataclass(frozen=True)
class Template:
    """A licence with one of its texts: its number of words, and its distinct bigrams with where each stands first."""

    name: str
    n_words: int
    bigrams: tuple[str, ...]
    places: tuple[int, ...]

    def bounds(self, least: float) -> tuple[int, int]:
        """Sizes of the bigram sets that can reach `least`: b t / (2 - t) to b (2 - t) / t, in whole numbers."""
        b, t = len(self.bigrams), Fraction(str(least))
        return math.ceil(b * t / (2 - t)), math.floor(b * (2 - t) / t)


#: Letters from which on a word counts as rare.
LONG = 6
COMMON = ("a", "and", "as", "be", "by", "for", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "under", "with", "work", "you")


def anchor_words(known: list[Template], least: float) -> list[str]:
    """Few words, so that a passage without any of them can't reach `least` with any template.

    Greedy: each turn takes the word of most bigrams that templates still share with such a passage; words of
    LONG letters or more go first, as they are rarer in other texts, and COMMON ones last.
    """
    out: list[str] = []
    left = {k: set(t.bigrams) for k, t in enumerate(known)}
    while left := {k: g for k, g in left.items() if g and 2 * len(g) >= least * (len(g) + len(known[k].bigrams)) - 1e-9}:
        gain: dict[str, float] = {}
        for k, grams in left.items():
            for gram in grams:
                for word in set(gram.split()):
                    gain[word] = gain.get(word, 0.0) + 1 / len(known[k].bigrams)
        best = max(gain, key=lambda w: (len(w) >= LONG, w not in COMMON, gain[w], w))
        out.append(best)
        left = {k: {g for g in grams if best not in g.split()} for k, grams in left.items()}
    return out


def templates(texts: tuple[tuple[str, str], ...] | None = None) -> list[Template]:
    """Templates from (licence, text), by default the ones above; texts of fewer than two words have no bigrams and are left out."""
    out = {}
    for name, text in default_texts() if texts is None else texts:
        words = "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()
        first: dict[str, int] = {}
        for k, (a, b) in enumerate(zip(words, words[1:], strict=False)):
            first.setdefault(f"{a} {b}", k)
        if first:
            out[name, tuple(words)] = Template(name, len(words), tuple(first), tuple(first.values()))
    return list(out.values())


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def _grams(words: Column) -> Column:
    """A bigram for each word but the last."""
    return F.transform(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), lambda x, i: F.concat(x, F.lit(" "), F.get(words, i + 1)))


def passages(text: Column) -> Column:
    """The words of lines, of paragraphs of several lines, and of the whole text; those without a bigram are left out."""
    lines = F.split(text, "\n")
    blocks = F.filter(F.split(text, r"\n[\x20\t\r]*\n"), lambda b: F.instr(b, "\n") > 0)
    return F.array_distinct(F.filter(F.transform(F.concat(lines, blocks, F.array(text)), _words), lambda w: F.size(w) > 1))


TABLE = "array<struct<name:string,n_words:int,low:int,high:int,bigrams:array<string>,places:array<int>>>"
FOUND = "array<struct<license:string,dice:double,passage:string>>"


def scan(docs: DataFrame, text: str = "text", known: list[Template] | None = None, least: float = LEAST, into: str = "licenses") -> DataFrame:
    """Add an array of (license, dice, passage): for each licence its best passage that reaches `least`, best first.

    A passage is its words with spaces between. Of passages with one coefficient the first by code point is taken,
    and licences of one coefficient are in the order of their names. Null and empty texts have none. Rows aren't
    moved, repeated ones come back as they are, and each whole text is read once. Input columns stay, but for one
    named `into`.
    """
    known = templates() if known is None else known
    none, nothing = F.array().cast(FOUND), F.array().cast("array<struct<k:double,license:string,passage:string>>")
    if not known:
        return docs.withColumn(into, none)
    first_words, rows = anchor_words(known, least), []
    for t in known:
        low, high = t.bounds(least)
        rows.append({"name": t.name, "n_words": t.n_words, "low": low, "high": high, "bigrams": t.bigrams, "places": t.places})
    table = F.from_json(F.lit(json.dumps(rows)), TABLE)  # folded to a literal before the query runs
    all_bigrams = sorted({g for t in known for g in t.bigrams})
    literal = lambda items: F.from_json(F.lit(json.dumps(items)), "array<string>")

    def compared(t: Column, words: Column, grams: Column, size: Column) -> Column:
        """The match of some words with a template, the better one the smaller; null if there is none."""
        dice = 2.0 * F.size(F.array_intersect(grams, t["bigrams"])) / (size + F.size(t["bigrams"]))
        hit = lambda d: F.struct((-d).alias("k"), t["name"].alias("license"), F.array_join(words, " ").alias("passage"))
        return _let(dice, lambda d: F.when(d >= least, hit(d)))

    def whole(t: Column, found: Column) -> Column:
        sized = F.filter(found, lambda p: p["size"].between(t["low"], t["high"]))
        return F.transform(sized, lambda p: compared(t, p["words"], p["grams"], p["size"]))

    def windows(t: Column, words: Column, grams: Column, hits: Column) -> Column:
        # where a window would begin if this bigram stood at its place; null for bigrams that the template lacks
        begin = lambda h: _let(F.array_position(t["bigrams"], h["gram"]), lambda at: F.when(at > 0, h["at"] - F.get(t["places"], at.cast("int") - 1)))
        begins = F.array_distinct(F.filter(F.transform(hits, begin), lambda b: b.isNotNull()))

        def one(b: Column) -> Column:
            first = F.greatest(b, F.lit(0))
            n = F.least(b + t["n_words"], F.size(words)) - first
            part = _let(F.slice(grams, first + 1, n - 1), lambda g: compared(t, F.slice(words, first + 1, n), g, F.size(F.array_distinct(g))))
            return F.when((n - 1) >= t["low"], part)

        return F.transform(begins, one)

    def searched(words: Column, grams: Column) -> Column:
        parts = F.transform(passages(F.col(text)), lambda w: _let(_grams(w), lambda g: F.struct(w.alias("words"), g.alias("grams"), F.size(F.array_distinct(g)).alias("size"))))

        def matches(candidates: Column, hits: Column) -> Column:
            best_of = lambda t, found: F.array_min(F.concat(whole(t, found), windows(t, words, grams, hits)))
            return _let(parts, lambda found: F.filter(F.transform(candidates, lambda t: best_of(t, found)), lambda x: x.isNotNull()))

        def counted(here: Column) -> Column:
            # a passage shares no more bigrams with a template than the whole text does
            candidates = F.filter(table, lambda t: F.size(F.array_intersect(t["bigrams"], here)) >= t["low"])
            hits = F.filter(F.transform(grams, lambda g, i: F.struct(g.alias("gram"), i.alias("at"))), lambda h: h["gram"].isin(all_bigrams))
            return _let(candidates, lambda c: F.when(F.size(c) > 0, _let(hits, lambda h: matches(c, h))).otherwise(nothing))

        return _let(F.array_intersect(grams, literal(all_bigrams)), lambda here: F.when(F.size(here) > 0, counted(here)).otherwise(nothing))

    def best(found: Column) -> Column:
        # one match a template at most
        ordered = F.array_sort(found)
        names = F.transform(ordered, lambda x: x["license"])
        first = F.filter(ordered, lambda x, i: F.array_position(names, x["license"]) == i + 1)
        return F.transform(first, lambda x: F.struct(x["license"].alias("license"), (-x["k"]).alias("dice"), x["passage"].alias("passage")))

    asked = lambda w: F.when(F.arrays_overlap(w, literal(first_words)), _let(_grams(w), lambda g: _let(searched(w, g), best))).otherwise(none)
    return docs.withColumn(into, F.when(F.col(text).isNotNull(), _let(_words(F.col(text)), asked)).otherwise(none))
