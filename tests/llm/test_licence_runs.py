"""Licence notices that are neither a whole line nor a whole text."""

import os
import random
import re
import textwrap
from collections import Counter

from tallyframe.llm import license_scan as S

PROSE = "alpha beta gamma delta of the end and the use of this work. " * 40


def scanned(spark, texts, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    return [r.notices for r in S.scan(docs, **options).orderBy("doc_id").collect()]


def names(found):
    return [sorted(x.name for x in r) for r in found]


def test_wrapped_and_inline_notices(spark):
    """A wrapped header over a longer text, a notice that shares its line,
    wrapped comments, two notices of one text, and prose without any."""
    header = next(t for n, t in S.TEMPLATES if n == "Apache-2.0" and len(t) > 100)
    found = scanned(spark, [
        textwrap.fill(header, 80) + "\n\n" + PROSE, "Copyright (c) 2020 Foo Bar. Released under the MIT License.",
        "# " + textwrap.fill(header, 70).replace("\n", "\n# ") + f"\n{PROSE} Released under the BSD 3-Clause License. {PROSE}",
        f"{PROSE}\nHere: licensed under CC BY-SA 4.0, and this work is licensed under the GNU General\nPublic License, version 2.",
        PROSE, None])
    assert names(found) == [["Apache-2.0"], ["MIT"], ["Apache-2.0", "BSD-3-Clause"], ["CC-BY-SA-4.0", "GPL-2.0"], [], []]
    assert all(x.dice == 1.0 for r in found for x in r) and {x.line for x in found[3]} == {2}


def test_full_text_over_lines(spark):
    grant = next(t for n, t in S.TEMPLATES if n == "MIT" and len(t) > 100)
    full = f"MIT License\n\nCopyright (c) 2020 Foo Bar\n\n{textwrap.fill(grant, 78)}\n\n" + textwrap.fill(
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
        "the Software. " + PROSE, 78)
    assert names(scanned(spark, [full])) == [["MIT"]]


def test_runs_against_brute_force(spark):
    """Every text in which some run of words reaches a template has a
    notice, at the highest coefficient of all runs where there is one
    template; other texts have none."""
    rng, template = random.Random(7), "to be or not to be that is the question to be"
    known = S.prepared([("X", template)])
    (_, m, _, high, grams), = known
    texts = []
    for _ in range(150):
        words = template.split()
        for _ in range(rng.randint(0, 4)):
            i = rng.randrange(len(words))
            words[i:i + rng.randint(0, 1)] = rng.choice([["to", "be"], ["stray"], [], ["is"]])
        around = lambda: [rng.choice("to be or not that a b c d e".split()) for _ in range(rng.randint(0, 12))]  # noqa: E731,B023
        texts.append("".join(w + rng.choice("   \n") for w in around() + words + around()))

    def best(text):
        w = re.findall("[a-z]+", text)
        top = 0
        for i in range(len(w)):
            for j in range(i + 1, min(len(w), i + high + 1)):
                got = Counter(zip(w[i:j + 1], w[i + 1:j + 1]))
                top = max(top, 2.0 * sum(min(c, got[tuple(g.split())]) for g, c in grams) / (j - i + m))
        return top if top >= S.LEAST else 0
    found = scanned(spark, texts, templates=[("X", template)])
    assert [bool(r) for r in found] == [best(t) > 0 for t in texts] and 30 < sum(map(bool, found)) < 140
    # a line stands for a run in it with as many shared bigrams, so compare on lines too long for the template
    flat = [" ".join(t.split()) + " end of it" * 20 for t in texts]
    assert [max((x.dice for x in r), default=0) for r in scanned(spark, flat, templates=[("X", template)])] == list(map(best, flat))


BSD = """Copyright (c) The Regents of the University of California.
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions
are met:
1. Redistributions of source code must retain the above copyright
   notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright
   notice, this list of conditions and the following disclaimer in the
   documentation and/or other materials provided with the distribution.
3. Neither the name of the University nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE REGENTS AND CONTRIBUTORS ``AS IS'' AND
ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
ARE DISCLAIMED.  IN NO EVENT SHALL THE REGENTS OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS
OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY
OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF
SUCH DAMAGE.
"""


def test_licence_bodies(spark):
    """The texts of licences themselves, alone and inside a longer text."""
    two = re.sub(r"3\. Neither.*?permission\.\n", "", BSD, flags=re.S)
    texts = [("BSD-3-Clause", BSD), ("BSD-3-Clause", PROSE + "\n" + BSD + PROSE), ("BSD-2-Clause", two + PROSE)]
    shelf = "/usr/share/common-licenses"
    for name, file in [("Apache-2.0", "Apache-2.0"), ("GPL-2.0", "GPL-2"), ("GPL-3.0", "GPL-3"), ("LGPL-3.0", "LGPL-3"),
                       ("MPL-2.0", "MPL-2.0")]:
        if os.path.exists(f"{shelf}/{file}"):
            texts.append((name, open(f"{shelf}/{file}", encoding="utf-8").read()))
    found = scanned(spark, [t for _, t in texts])
    assert [set(r) for r in names(found)] == [{n} for n, _ in texts]


def test_whole_texts_without_telling_words_are_not_compared(spark, monkeypatch):
    """A notice over several lines is found as a whole text, and only where
    the text holds a telling word: others are not compared at all."""
    text = "Released under\nthe MIT\nLicense."
    df = spark.createDataFrame([(1, text), (2, "of no\nweight at all"), (3, None)], "doc_id int, text string")
    got = lambda: [r["licences"] for r in S.scan(df).orderBy("doc_id").collect()]
    assert got() == ["MIT", "", ""]
    monkeypatch.setattr(S, "telling", lambda known: ["zzz"])
    assert got() == ["", "", ""]
