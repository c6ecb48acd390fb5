"""Licence scans: Dice coefficient over word bigrams, DataFrame functions only.

Every line of a text, a text of several lines as a whole, and every run of
words inside lines or across them is normalised to lower-case words and
compared with licence templates.  Bigrams are counted with repeats, so a
segment of n bigrams can reach coefficient d with a template of m only if
d / (2 - d) * m <= n <= (2 - d) / d * m: other templates are skipped, as are
those that share no bigram.  The best runs begin and end with a bigram of
their template, so only those are tried.  Templates are a parameter of
bounded size and travel inside the expression; nothing is joined or
shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import let

LEAST = 0.8
NOT_WORD = r"[^\p{L}\p{N}]+"
#: Poor telltales of a notice: ordinary texts hold them.
COMMON = set("a all and any as at be but by for from if in is it may not of on or other than that the their this to under "
             "whom with without work you".split())

#: Public licence notices and texts.
TEMPLATES = [
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
                   "compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
                   'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR '
                   "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
                   "permissions and limitations under the License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
                "option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
            "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
            "to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
     "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
     "later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
     "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any "
     "later version."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General "
     "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
     "later version."),
    # Full texts of the short licences, the opening passages of the long ones.
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. "
     "<https://fsf.org/> Everyone is permitted to copy and distribute verbatim copies of this license document, but "
     "changing it is not allowed. Preamble The GNU Affero General Public License is a free, copyleft license for "
     "software and other kinds of works, specifically designed to ensure cooperation with the community in the case of "
     "network server software. The licenses for most software and other practical works are designed to take away your "
     "freedom to share and change the works. By contrast, our General Public Licenses are intended to guarantee your "
     "freedom to share and change all versions of a program--to make sure it remains free software for all its users."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, "
     'REPRODUCTION, AND DISTRIBUTION 1. Definitions. "License" shall mean the terms and conditions for use, '
     'reproduction, and distribution as defined by Sections 1 through 9 of this document. "Licensor" shall mean the '
     'copyright owner or entity authorized by the copyright owner that is granting the License. "Legal Entity" shall '
     "mean the union of the acting entity and all other entities that control, are controlled by, or are under common "
     'control with that entity. For the purposes of this definition, "control" means (i) the power, direct or '
     "indirect, to cause the direction or management of such entity, whether by contract or otherwise, or (ii) "
     "ownership of fifty percent (50%) or more of the outstanding shares, or (iii) beneficial ownership of such "
     'entity. "You" (or "Your") shall mean an individual or Legal Entity exercising permissions granted by this '
     "License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
     "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this "
     "list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above "
     "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
     "materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "
     '"AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF '
     "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
     "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
     "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR "
     "BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR "
     "TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF "
     "THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
     "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this "
     "list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above "
     "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
     "materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its "
     "contributors may be used to endorse or promote products derived from this software without specific prior "
     'written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS '
     "OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR "
     "A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
     "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
     "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER "
     "CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR "
     "OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH "
     "DAMAGE."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc., 51 "
     "Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA Everyone is permitted to copy and distribute verbatim "
     "copies of this license document, but changing it is not allowed. Preamble The licenses for most software are "
     "designed to take away your freedom to share and change it. By contrast, the GNU General Public License is "
     "intended to guarantee your freedom to share and change free software--to make sure the software is free for all "
     "its users. This General Public License applies to most of the Free Software Foundation's software and to any "
     "other program whose authors commit to using it. (Some other Free Software Foundation software is covered by the "
     "GNU Lesser General Public License instead.) You can apply it to your programs, too."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. "
     "<https://fsf.org/> Everyone is permitted to copy and distribute verbatim copies of this license document, but "
     "changing it is not allowed. Preamble The GNU General Public License is a free, copyleft license for software and "
     "other kinds of works. The licenses for most software and other practical works are designed to take away your "
     "freedom to share and change the works. By contrast, the GNU General Public License is intended to guarantee your "
     "freedom to share and change all versions of a program--to make sure it remains free software for all its users. "
     "We, the Free Software Foundation, use the GNU General Public License for most of our software; it applies also "
     "to any other work released this way by its authors. You can apply it to your programs, too."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
     "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE "
     'IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
     "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
     "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
     "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE "
     "USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. "
     "<https://fsf.org/> Everyone is permitted to copy and distribute verbatim copies of this license document, but "
     "changing it is not allowed. This version of the GNU Lesser General Public License incorporates the terms and "
     "conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed "
     'below. 0. Additional Definitions. As used herein, "this License" refers to version 3 of the GNU Lesser General '
     'Public License, and the "GNU GPL" refers to version 3 of the GNU General Public License. "The Library" refers to '
     "a covered work governed by this License, other than an Application or a Combined Work as defined below. An "
     '"Application" is any work that makes use of an interface provided by the Library, but which is not otherwise '
     "based on the Library. Defining a subclass of a class defined by the Library is deemed a mode of using an "
     "interface provided by the Library."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
     "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
     "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
     "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
     'Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT '
     "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
     "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION "
     "OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
     "DEALINGS IN THE SOFTWARE."),
    ("MPL-2.0", 'Mozilla Public License Version 2.0 1. Definitions 1.1. "Contributor" means each individual or legal entity that '
     'creates, contributes to the creation of, or owns Covered Software. 1.2. "Contributor Version" means the '
     "combination of the Contributions of others (if any) used by a Contributor and that particular Contributor's "
     'Contribution. 1.3. "Contribution" means Covered Software of a particular Contributor. 1.4. "Covered Software" '
     "means Source Code Form to which the initial Contributor has attached the notice in Exhibit A, the Executable "
     "Form of such Source Code Form, and Modifications of such Source Code Form, in each case including portions "
     'thereof. 1.5. "Incompatible With Secondary Licenses" means (a) that the initial Contributor has attached the '
     "notice described in Exhibit B to the Covered Software; or (b) that the Covered Software was made available under "
     "the terms of version 1.1 or earlier of the License, but not also under the terms of a Secondary License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, "
     "use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
     "purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the "
     "author or authors of this software dedicate any and all copyright interest in the software to the public domain."),
]


def prepared(templates=TEMPLATES, least: float = LEAST) -> list[tuple[str, int, int, int, list[tuple[str, int]]]]:
    """(name, bigrams, fewest, most, counted bigrams) of each template."""
    out = []
    d = Fraction(str(least))
    for name, text in templates:
        words = [w for w in re.split(r"[^a-z0-9]+", text.lower()) if w]
        grams = Counter(f"{a} {b}" for a, b in zip(words, words[1:]))
        m = len(words) - 1
        low, high = d / (2 - d) * m, (2 - d) / d * m
        out.append((name, m, -int(-low // 1), int(high // 1), sorted(grams.items())))
    return out


def _strings(values) -> Column:
    """An array of strings without bars, folded into one constant."""
    return F.split(F.lit("|".join(values)), "[|]")


def _literal(templates) -> Column:
    return F.array(*[F.struct(
        F.lit(name).alias("name"), F.lit(m).alias("m"), F.lit(low).alias("low"), F.lit(high).alias("high"),
        _strings([g for g, _ in grams]).alias("grams"),
        _strings([str(c) for _, c in grams]).cast("array<int>").alias("counts")) for name, m, low, high, grams in templates])


def telling(known) -> list[str]:
    """Words of which a text holds at least one wherever a run of its words
    reaches a template: without them more bigrams lack than may."""
    out: set[str] = set()
    for _, m, low, _, grams in known:
        left, lacking = dict(grams), 0
        for w in sorted({w for g in left for w in g.split()}, key=lambda w: (w in COMMON, w not in out, -len(w), w)):
            if lacking > m - low:
                break
            touched = [g for g in left if w in g.split()]
            lacking += sum(left.pop(g) for g in touched)
            out.update([w] if touched else [])
    return sorted(out)


def _clash(a: Column, b: Column) -> Column:
    return (a["first"] <= b["last"]) & (b["first"] <= a["last"])


def _apart(ranked: Column) -> Column:
    """The runs that meet no better one; ``ranked`` has the best first."""
    return F.aggregate(ranked, F.slice(ranked, 1, 0), lambda kept, x: F.when(
        F.exists(kept, lambda y: _clash(x, y)), kept).otherwise(F.concat(kept, F.array(x))))


def runs(words: Column, known, least: float) -> Column:
    """Array of (name, dice, shared, first, last): runs of ``words`` that
    reach a template, first and last word counted from 0.  Each bigram of a
    template begins at most one run of it, the best.  Where runs of one
    template meet, the highest coefficient stays (ties: the most shared
    bigrams, then the first); of several templates, the most shared bigrams
    (ties: the highest coefficient, the first, the name)."""
    vocabulary = sorted({g for *_, grams in known for g, _ in grams})
    run = lambda x: F.struct(*[x[c] for c in ("name", "dice", "shared", "first", "last")])
    by = lambda some, *key: F.transform(F.array_sort(F.transform(
        some, lambda x: F.struct(*[(-x[c[1:]] if c[0] == "-" else x[c]).alias(f"k{i}") for i, c in enumerate(key)],
                                 run(x).alias("run")))), lambda x: x["run"])

    def of(t: Column, mine: Column) -> Column:
        # A run from anchor k holds t.low anchors within t.high bigrams.
        starts = F.filter(F.transform(mine, lambda x, k: F.struct(k.alias("k"), x["at"].alias("at"))),
                          lambda s: F.get(mine, s["k"] + t["low"] - 1)["at"] < s["at"] + t["high"])

        # An anchor counts in a run from s if the one as many repeats back as
        # the template has of its bigram lies before s.
        def capped(x: Column, k: Column) -> Column:
            before = F.filter(F.slice(mine, F.greatest(F.lit(1), k + 1 - t["high"]), F.least(k, t["high"])),
                              lambda y: y["gram"] == x["gram"])
            repeats = F.get(t["counts"], F.array_position(t["grams"], x["gram"]).cast("int") - 1)
            return F.struct(x["at"].alias("at"),
                            F.coalesce(F.get(before, F.size(before) - repeats)["at"], F.lit(-1)).alias("past"))

        def best(s: Column, anchors: Column) -> Column:
            def step(a: Column, x: Column) -> Column:
                shared = a["hits"] + (x["past"] < s["at"]).cast("int")
                n = x["at"] - s["at"] + 1
                dice = 2.0 * shared / (n + t["m"])
                better = (n <= t["high"]) & (dice > a["dice"])
                keep = lambda new, c: F.when(better, new).otherwise(a[c]).alias(c)
                return F.struct(shared.alias("hits"), keep(dice, "dice"), keep(shared, "shared"), keep(x["at"], "end"))
            zero = F.struct(F.lit(0).alias("hits"), F.lit(0.0).alias("dice"), F.lit(0).alias("shared"), F.lit(-1).alias("end"))
            top = F.aggregate(F.slice(anchors, s["k"] + 1, t["high"]), zero, step)
            return let(top, lambda b: F.struct(t["name"].alias("name"), b["dice"].alias("dice"), b["shared"].alias("shared"),
                                               s["at"].alias("first"), (b["end"] + 1).alias("last")))

        def found(starts: Column) -> Column:
            each = let(F.transform(mine, capped), lambda anchors: F.transform(starts, lambda s: best(s, anchors)))
            hits = F.filter(F.when(F.size(starts) > 0, each), lambda x: x["dice"] >= least)
            return let(by(hits, "-dice", "-shared", "first"), _apart)
        return let(starts, found)

    def all_of(grams: Column) -> Column:
        def tried(seen: Column) -> Column:
            near = F.filter(_literal(known), lambda t: F.size(F.array_intersect(t["grams"], seen))
                            >= t["low"] - t["m"] + F.size(t["grams"]))
            each = F.transform(near, lambda t: let(
                F.filter(grams, lambda x: F.array_contains(t["grams"], x["gram"])), lambda mine: of(t, mine)))
            return let(by(F.flatten(F.filter(each, lambda x: x.isNotNull())), "-shared", "-dice", "first", "name"), _apart)
        return let(F.array_distinct(F.transform(grams, lambda x: x["gram"])), tried)

    every = F.transform(words, lambda w, i: F.concat_ws(" ", w, F.get(words, i + 1)))
    known_grams = _strings(vocabulary)
    pairs = let(every, lambda every: let(F.array_intersect(every, known_grams), lambda seen: F.filter(
        F.transform(every, lambda g, i: F.struct(i.alias("at"), g.alias("gram"))),
        lambda x: F.array_contains(seen, x["gram"]))))
    return F.when(F.arrays_overlap(words, _strings(telling(known))), let(pairs, all_of))


def notices(text: Column, templates=TEMPLATES, least: float = LEAST) -> Column:
    """Array of (name, dice, line): the best template of each segment that
    reaches ``least``; line numbers count from 1, the whole text is 0.

    Runs of words that are no whole line have the number of the line they
    begin in.  A run is left out where it meets a line with as many shared
    bigrams or the whole text is a notice of the same licence, and a line
    where a run of the same licence that meets it shares more."""
    known = prepared(templates, least)
    fewest, most = min(t[2] for t in known), max(t[3] for t in known)
    words = lambda t: F.filter(F.split(F.lower(t), NOT_WORD), lambda w: w != "")
    fits = lambda n: (n >= fewest) & (n <= most)

    def against(segment: Column) -> Column:
        def scored(grams: Column) -> Column:
            n = F.size(grams)
            near = F.filter(_literal(known), lambda t: (n >= t["low"]) & (n <= t["high"]) & F.arrays_overlap(grams, t["grams"]))

            def dice(t: Column) -> Column:
                shared = F.aggregate(F.transform(t["grams"], lambda g, i: F.least(
                    F.get(t["counts"], i), F.size(F.filter(grams, lambda x: x == g)))), F.lit(0), lambda a, x: a + x)
                return F.struct((2.0 * shared / (n + t["m"])).alias("dice"), t["m"].alias("m"), t["name"].alias("name"))
            hits = F.filter(F.transform(near, dice), lambda x: x["dice"] >= least)
            best = F.array_max(F.transform(hits, lambda x: F.struct(x["dice"], x["m"])))
            names = F.transform(F.filter(hits, lambda x: F.struct(x["dice"], x["m"]) == best), lambda x: x["name"])
            return F.struct(F.array_min(names).alias("name"), best["dice"].alias("dice"), segment["line"].alias("line"),
                            F.round(best["dice"] * (n + best["m"]) / 2).cast("int").alias("shared"))
        pairs = F.slice(F.transform(segment["words"], lambda w, i: F.concat_ws(" ", w, F.get(segment["words"], i + 1))),
                        1, F.size(segment["words"]) - 1)
        return let(pairs, scored)

    def segments(lines: Column) -> Column:
        each = F.filter(F.transform(lines, lambda w, i: F.struct((i + 1).alias("line"), w.alias("words"))),
                        lambda s: fits(F.size(s["words"]) - 1) & F.arrays_overlap(s["words"], _strings(telling(known))))
        total = F.aggregate(lines, F.lit(0), lambda a, w: a + F.size(w))
        whole = F.when((F.size(lines) > 1) & fits(total - 1),
                       F.array(F.struct(F.lit(0).alias("line"), F.flatten(lines).alias("words"))))
        return F.concat(each, F.coalesce(whole, F.slice(each, 1, 0)))

    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), words)
    notice = lambda x, line: F.struct(x["name"].alias("name"), x["dice"].alias("dice"), line.alias("line"))
    plain = lambda found: F.transform(found, lambda x: notice(x, x["line"]))

    def merged(lines: Column, found: Column, others: Column) -> Column:
        count = lambda some: F.aggregate(some, F.lit(0), lambda a, w: a + F.size(w))
        placed = F.transform(F.filter(found, lambda h: h["line"] > 0), lambda h: let(
            count(F.slice(lines, 1, h["line"] - 1)), lambda at: F.struct(
                h["name"].alias("name"), h["line"].alias("line"), h["shared"].alias("shared"), at.alias("first"),
                (at + F.size(F.get(lines, h["line"] - 1)) - 1).alias("last"))))

        def line_of(x: Column) -> Column:
            zero = F.struct(F.lit(0).alias("seen"), F.lit(1).alias("line"))
            return F.aggregate(lines, zero, lambda a, w: F.struct(
                (a["seen"] + F.size(w)).alias("seen"),
                (a["line"] + (a["seen"] + F.size(w) <= x["first"]).cast("int")).alias("line")))["line"]

        def joined(placed: Column) -> Column:
            kept = F.filter(others, lambda x: ~F.exists(placed, lambda h: _clash(h, x) & (h["shared"] >= x["shared"]))
                            & ~F.exists(found, lambda h: (h["line"] == 0) & (h["name"] == x["name"])))
            return let(kept, lambda kept: F.concat(
                plain(F.filter(found, lambda f: ~F.exists(placed, lambda h: (h["line"] == f["line"]) & F.exists(
                    kept, lambda x: _clash(h, x) & (h["name"] == x["name"]))))),
                F.transform(kept, lambda x: notice(x, line_of(x)))))
        return let(placed, joined)

    def both(lines: Column, words: Column) -> Column:
        found = F.filter(F.transform(segments(lines), against), lambda x: x["name"].isNotNull())
        others = runs(words, known, least)
        return let(found, lambda found: let(others, lambda others: F.when(
            F.size(others) > 0, merged(lines, found, others)).otherwise(plain(found))))

    # a text without a telling word has no notice: no line, no run, nor the whole
    none = F.array().cast("array<struct<name:string,dice:double,line:int>>")
    return let(lines, lambda lines: let(F.flatten(lines), lambda words: F.when(
        F.arrays_overlap(words, _strings(telling(known))), both(lines, words)).otherwise(none)))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES,
         least: float = LEAST) -> DataFrame:
    """One row per row of ``docs``: id, licence and dice of the best notice
    (ties: the first line, the whole text last of all; null if there is
    none), licences (sorted names, joined by commas; empty if none) and the
    notices themselves.  Null, empty and wordless texts have none; equal
    rows give equal rows; an empty table gives an empty one; other columns
    are not read."""
    rows = docs.select(F.col(f"`{id_col}`"), notices(F.col(f"`{text_col}`"), templates, least).alias("notices"))
    order = lambda x: F.struct(x["dice"], -F.when(x["line"] == 0, 2**31 - 1).otherwise(x["line"]), x["name"])
    rows = rows.withColumn("best", F.array_max(F.transform("notices", order)))
    names = F.array_sort(F.array_distinct(F.transform("notices", lambda x: x["name"])))
    return rows.select(F.col(f"`{id_col}`"), F.col("best")["name"].alias("licence"), F.col("best")["dice"].alias("dice"),
                       F.size("notices").cast("long").alias("n_notices"), F.array_join(names, ",").alias("licences"),
                       "notices")
