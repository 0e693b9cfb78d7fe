"""License scans: parts of a text compared to licence templates by the Dice
coefficient over their sets of word bigrams.

A text's parts are its lines, its paragraphs (runs of lines without an empty line)
if they have more than one line, and the whole text if it has more than one
paragraph.  Parts and templates are normalised alike: lower case, and every run of
characters other than letters and digits becomes one space.

A part of n words is only compared with templates whose number of words m lets the
coefficient reach the threshold t: m and n (each less one, the number of bigrams)
differ at most by the factor (2 - t) / t.

A notice may also stand within a longer line or paragraph, on one line with other
notices, or in a comment whose marks leave no empty line.  So windows of each template's
number of words slide over the words of the whole text.  A part or window of coefficient t
has at least t / (2 - t) of the template's bigrams, which gives two exact filters: a text or
part is left alone unless it has one of a few words that no match can do without, and only
windows that hold so many of the positions of the template's bigrams are compared.

All of it is DataFrame expressions on one row; nothing is shuffled.

Defined cases: a null, empty or one-word text matches nothing (license null, dice
0, 0 matches); of equal coefficients the first template in code point order wins;
rows that repeat an id are documents of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import let, own_columns

THRESHOLD = 0.8
#: Notices by which the licences ask to be named, as published.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License."],
    "BSD": [
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met:",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: 1. Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must "
        "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright "
        "holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND "
        "CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED "
        "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
        "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR "
        "CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF "
        "USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
        "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
        "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."],
    "CC-BY-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions:",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all copies "
        "or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, "
        "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
        "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, "
        "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be "
        "held liable for any damages arising from the use of this software. Permission is granted to anyone to use "
        "this software for any purpose, including commercial applications, and to alter it and redistribute it "
        "freely, subject to the following restrictions:"],
}


def template_words(template: str) -> list[str]:
    return re.sub(r"[^a-z0-9]+", " ", template.lower()).split()  # templates are ASCII


def _part_words(part: Column) -> Column:
    clean = F.regexp_replace(F.lower(part), r"[^\p{L}\p{N}]+", " ")
    return F.array_remove(F.split(clean, " ", -1), "")


def _parts(text: Column) -> Column:
    def several(parts: Column, separator: str) -> Column:
        return F.filter(parts, lambda p: F.regexp_count(p, F.lit(separator)) > 0)

    paragraphs = F.split(text, r"\n(?:[\x20\x09\x0B-\x0D]*\n)+", -1)
    whole = F.array(text)
    return F.concat(F.split(text, "\n", -1), several(paragraphs, "\n"),
                    several(whole, r"\n(?:[\x20\x09\x0B-\x0D]*\n)+"))


def matches(text: Column, threshold: float = THRESHOLD, templates: dict[str, list[str]] | None = None) -> Column:
    """Array of ``(dice, license)``: the best template of each part that reaches the threshold.  Parts without
    the words that a match needs are not cut into words."""
    known = []
    for name, texts in sorted((templates or TEMPLATES).items()):
        for t in texts:
            ws = template_words(t)
            known.append(F.struct(F.lit(name).alias("license"), F.lit(len(ws) - 1).alias("n"),
                                  F.array(*[F.lit(b) for b in dict.fromkeys(map(" ".join, zip(ws, ws[1:], strict=False)))])
                                  .alias("bigrams")))
    table, factor = F.array(*known), (2 - threshold) / threshold
    sizes = sorted({len(template_words(t)) - 1 for ts in (templates or TEMPLATES).values() for t in ts})

    def in_bounds(n: Column) -> Column:
        close = F.lit(False)
        for m in sizes:
            close = close | ((n * factor >= m) & (n <= m * factor))
        return close

    def compare(own: Column) -> Column:
        n = F.size(own) - 1
        bigrams = F.array_distinct(F.transform(F.sequence(F.lit(0), n - 1),
                                               lambda i: F.concat(own[i], F.lit(" "), own[i + 1])))

        def scored(bs: Column) -> Column:
            near = F.filter(table, lambda t: (n * factor >= t["n"]) & (n <= t["n"] * factor))
            each = F.transform(near, lambda t: F.struct(
                (2.0 * F.size(F.array_intersect(t["bigrams"], bs)) / (F.size(t["bigrams"]) + F.size(bs))).alias("dice"),
                t["license"].alias("license")))
            return F.filter(each, lambda m: m["dice"] >= threshold)

        return F.when((n >= 1) & in_bounds(n), _best(let(bigrams, scored)))

    parts = F.filter(_parts(text), lambda p: (F.length(p) > 2) & let(F.lower(p), lambda low: _may_match(low, threshold, templates)))
    found = F.transform(parts, lambda p: let(_part_words(p), compare))
    return F.filter(found, lambda m: m.isNotNull())


def _best(found: Column) -> Column:
    """The greatest coefficient; of equal ones the first licence name."""
    return F.aggregate(found, F.lit(None).cast("struct<dice:double,license:string>"), lambda best, m: F.when(
        best.isNull() | (m["dice"] > best["dice"]) | ((m["dice"] == best["dice"]) & (m["license"] < best["license"])),
        m).otherwise(best))


def least_shared(bigrams: int, threshold: float) -> int:
    """How many of its bigrams a template shares with any window that reaches the threshold."""
    return math.ceil(bigrams * threshold / (2 - threshold) - 1e-9)


def needed_words(words: list[str], threshold: float) -> list[str]:
    """Words of which a text has one if a window of it reaches the threshold with the template: so many of the
    longest that the bigrams without any of them are too few."""
    left, chosen = set(zip(words, words[1:], strict=False)), []
    least = least_shared(len(left), threshold)
    for word in sorted(set(words), key=lambda w: (-len(w), w)):
        if len(left) < least:
            break
        chosen.append(word)
        left = {b for b in left if word not in b}
    return chosen


def needed_bigrams(words: list[str], threshold: float) -> list[tuple[str, str]]:
    """The longest bigrams of a template, so many that a window which reaches the threshold has one of them."""
    every = sorted(set(zip(words, words[1:], strict=False)), key=lambda b: (-len(b[0]) - len(b[1]), b))
    return every[:len(every) - least_shared(len(every), threshold) + 1]


#: Templates that need a shorter word are sought by bigrams, as such words are in many texts.
RARE_LETTERS = 6


def _may_match(text: Column, threshold: float, templates: dict[str, list[str]] | None) -> Column:
    """Whether a lower-cased text has what a match of some template cannot do without."""
    words, bigrams = set(), set()
    for ws in [template_words(t) for ts in (templates or TEMPLATES).values() for t in ts]:
        needed = needed_words(ws, threshold)
        if min(map(len, needed), default=0) >= RARE_LETTERS:
            words |= set(needed)
        else:
            bigrams |= set(needed_bigrams(ws, threshold))
    some = F.lit(False)
    for word in sorted(words):
        some = some | F.contains(text, F.lit(word))
    return some | text.rlike("|".join(rf"{a}[^\p{{L}}\p{{N}}]+{b}" for a, b in sorted(bigrams))) if bigrams else some


def window_matches(text: Column, threshold: float = THRESHOLD, templates: dict[str, list[str]] | None = None) -> Column:
    """Array of ``(dice, license)``: for each template the best window of its number of words, if it reaches
    the threshold."""
    known = [(name, template_words(t)) for name, texts in sorted((templates or TEMPLATES).items()) for t in texts]
    sets = [list(dict.fromkeys(map(" ".join, zip(ws, ws[1:], strict=False)))) for _, ws in known]
    table = F.array(*[F.struct(F.lit(name).alias("license"), F.lit(len(ws) - 1).alias("m"), F.lit(least_shared(len(bs), threshold)).alias("least"),
                               F.array(*[F.lit(b) for b in bs]).alias("bigrams")) for (name, ws), bs in zip(known, sets, strict=True)])
    any_bigram = sorted({b for bs in sets for b in bs})
    some = let(F.lower(text), lambda low: _may_match(low, threshold, templates))

    def best_window(own: Column, hits: Column, t: Column) -> Column:
        places = F.transform(F.filter(hits, lambda h: F.array_contains(t["bigrams"], h["b"])), lambda h: h["i"])

        def of(p: Column) -> Column:
            first = F.filter(F.sequence(F.lit(0), F.size(p) - t["least"]), lambda j: p[j + t["least"] - 1] - p[j] < t["m"])
            spans = F.transform(first, lambda j: F.struct(F.greatest(F.lit(0), p[j + t["least"] - 1] - t["m"] + 1).alias("low"),
                                                          F.least(p[j], F.size(own) - t["m"]).alias("high")))
            starts = F.array_distinct(F.flatten(F.transform(F.filter(spans, lambda s: s["low"] <= s["high"]),
                                                            lambda s: F.sequence(s["low"], s["high"]))))
            each = F.transform(starts, lambda s: let(F.array_distinct(F.slice(own, s + 1, t["m"])), lambda w: F.struct(
                (2.0 * F.size(F.array_intersect(t["bigrams"], w)) / (F.size(t["bigrams"]) + F.size(w))).alias("dice"),
                t["license"].alias("license"))))
            return F.when(F.size(p) >= t["least"], _best(F.filter(each, lambda m: m["dice"] >= threshold)))

        return let(places, of)

    def of_words(words: Column) -> Column:
        bigrams = F.transform(F.sequence(F.lit(0), F.size(words) - 2), lambda i: F.concat(words[i], F.lit(" "), words[i + 1]))

        def of(own: Column) -> Column:
            hits = F.filter(F.transform(own, lambda b, i: F.when(b.isin(any_bigram), F.struct(i.alias("i"), b.alias("b")))), lambda h: h.isNotNull())
            return let(hits, lambda hs: F.transform(table, lambda t: best_window(own, hs, t)))

        return F.when(F.size(words) >= 2, let(bigrams, of))

    found = F.when(some, let(_part_words(text), of_words))
    return F.coalesce(F.filter(found, lambda m: m.isNotNull()), F.array().cast("array<struct<dice:double,license:string>>"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
         templates: dict[str, list[str]] | None = None) -> DataFrame:
    """``doc_id, license, dice, n_matches, n_windows`` of every document: its best match of a part or a window, how
    many of its parts match a template, and how many templates match a window."""
    rows = own_columns(docs, id_col, text_col).toDF("doc_id", "text").withColumn("low", F.lower("text"))
    # each text is lower-cased once, and only those that may match (null: not) go into the functions on arrays
    rows = rows.select("doc_id", F.when(_may_match(F.col("low"), threshold, templates), F.col("text")).alias("sought"))
    none = F.array().cast("array<struct<dice:double,license:string>>")
    found = rows.select("doc_id", *[F.when(F.col("sought").isNotNull(), f(F.col("sought"), threshold, templates)).otherwise(none).alias(name)
                                    for f, name in ((matches, "found"), (window_matches, "windows"))])
    found = found.select("doc_id", _best(F.concat("found", "windows")).alias("best"), F.size("found").cast("long").alias("n_matches"),
                         F.size("windows").cast("long").alias("n_windows"))
    return found.select("doc_id", "best.license", F.coalesce("best.dice", F.lit(0.0)).alias("dice"), "n_matches", "n_windows")
