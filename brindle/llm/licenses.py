"""License scans with SQL functions only.

Texts are read in overlapping windows of words, of several sizes.  MinHash bands over the shingles of a window near a
word that a match must have retrieve license templates of its size, and those are verified shingle by shingle.
Everything happens within a row, so nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import permutations

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import LOWER, UPPER, lower_ascii

SHINGLE = 5
LEAST = 0.8
#: How likely a window that holds a template may at most be missed.
MISS = 1e-6

#: Kinds of Creative Commons licenses, and their versions with what the publisher puts behind the number.
CC_KINDS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
CC_VERSIONS = {"4.0": "International", "3.0": "Unported"}


def _creative_commons() -> list[tuple[str, str]]:
    """The sentence and the short form of each license; the older ones say NoDerivs.  Some are listed below."""
    out = []
    for number, place in CC_VERSIONS.items():
        for kind, title in CC_KINDS.items():
            title = title.replace("NoDerivatives", "NoDerivs") if number == "3.0" else title
            if (kind, number) not in (("BY", "4.0"), ("BY-SA", "4.0")):
                out.append((f"CC-{kind}-{number}", f"This work is licensed under a Creative Commons {title} {number} {place} License."))
            if (kind, number) != ("BY-NC", "4.0"):
                out.append((f"CC-{kind}-{number}", f"Licensed under CC {kind} {number}."))
    return out


#: The notices that publishers ask for or print over their licenses, paragraph by paragraph.
NOTICES: tuple[tuple[str, str], ...] = (
    ("MIT", """
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("BSD", """
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    # the holder's name is a blank
    ("BSD-3-Clause", "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-4-Clause", "All advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("ISC", """
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("Zlib", """
This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software."""),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("BSL-1.0", """
Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"""),
    ("Apache-2.0", """
Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("Apache-2.0", "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("GPL-2.0", "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "The GNU General Public License is a free, copyleft license for software and other kinds of works. The licenses for most software and other practical works are designed to take away your freedom to share and change the works."),
    ("GPL", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("LGPL-2.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL", "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"),
    ("Unlicense", """
This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."""),
    ("CC0-1.0", "has waived all copyright and related or neighboring rights to"),
    ("CC0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide."),
    ("CC0-1.0", "This work is licensed under CC0 1.0 Universal"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
)

#: Single lines by which texts name a license.  They are no publisher's wording; several stand in the
#: tables that come with this engine's task.
LINES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("BSD", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("proprietary", "All rights reserved."),
)

#: Sentences of so many words are templates of their own, besides their paragraph.
SENTENCE = 12


def _passages(text: str) -> list[str]:
    """Paragraphs, and the long sentences of those that have several."""
    out = []
    for paragraph in text.strip().split("\n\n"):
        sentences = [x for x in re.split(r"(?<=\.) ", paragraph) if len(x.split()) >= SENTENCE]
        out += [paragraph, *(x for x in sentences if x != paragraph)]
    return out


TEMPLATES: tuple[tuple[str, str], ...] = (*((name, passage) for name, text in NOTICES for passage in _passages(text)), *LINES, *_creative_commons())

#: What isn't part of a word: ASCII but letters and digits.
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: str) -> list[str]:
    return [w for w in re.split(_GAP, text.translate(str.maketrans(UPPER, LOWER))) if w]


@dataclass(frozen=True)
class Kind:
    """Templates with equal shingle length and ``least`` to ``size`` shingles.  Windows of ``width`` shingles start
    every ``stride`` shingles, so that any ``size`` shingles in a row, and a quarter more, lie within one."""

    shingle: int
    size: int
    least: int

    @property
    def stride(self) -> int:
        return max(1, self.size // 4)

    @property
    def width(self) -> int:
        return self.size + self.size // 4 + self.stride - 1

    def resemblance(self, n: int) -> float:
        """Of a window that holds a match of a template of n shingles, and that template: at least ceil(LEAST * n)
        shingles in common, out of all that both have."""
        common = math.ceil(LEAST * n)
        return common / (self.width + n - common)

    @property
    def bands(self) -> int:
        """Bands of one hash each, so many that one agrees but for a chance of MISS."""
        least = min(self.resemblance(n) for n in range(self.least, self.size + 1))
        return 1 if least >= 1 else math.ceil(math.log(MISS) / math.log(1 - least))


def shingles_of(words: Sequence[str], k: int) -> list[str]:
    return [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]


def _class_of(n: int) -> int:
    """The least of 1, 2, 3, 4, 6, 8, 12, 16 and so on that isn't under n."""
    power = 1 << max(0, (n - 1).bit_length())
    return power * 3 // 4 if power >= 4 and n <= power * 3 // 4 else power


def kinds_of(templates: Sequence[tuple[str, str]]) -> dict[Kind, list[tuple[str, list[str]]]]:
    """Templates by kind: name and distinct shingles.  Shorter ones than a shingle are one shingle of their own; of
    templates with the same words and name one stays."""
    found: dict[tuple[int, int], dict[tuple[str, str], list[str]]] = defaultdict(dict)
    for name, text in templates:
        if words := words_of(text):
            k = min(SHINGLE, len(words))
            own = list(dict.fromkeys(shingles_of(words, k)))
            found[k, _class_of(len(own))][name, " ".join(words)] = own
    return {Kind(k, size, min(map(len, group.values()))): [(name, own) for (name, _), own in group.items()] for (k, size), group in sorted(found.items())}


def signature_of(shingles: Sequence[str], bands: int) -> list[int]:
    """The least hash of the shingles in each band, as the query's xxhash64 makes them."""
    raw = [xxhash.xxh64_digest(s.encode(), 42)[::-1] for s in shingles]
    return [min(_signed(xxhash.xxh64_intdigest(band.to_bytes(8, "little"), xxhash.xxh64_intdigest(x, 42))) for x in raw) for band in range(bands)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def screen_words(kinds: dict[Kind, list[tuple[str, list[str]]]]) -> list[str]:
    """Words that every match has one of: without them, too many of a template's shingles can't be there."""
    chosen: list[str] = []
    for templates in kinds.values():
        for _, shingles in templates:
            left = list(shingles)
            for w in sorted({w for s in shingles for w in s.split()}, key=lambda w: (w not in chosen, -len(w), w)):
                if len(left) < LEAST * len(shingles):
                    break
                rest = [s for s in left if w not in s.split()]
                if len(rest) < len(left):
                    left = rest
                    chosen += [w] * (w not in chosen)
    return chosen


def _starts(places: Column, shingles: Column, kind: Kind) -> Column:
    """Where those windows start, from 0, that hold a word at one of the given places: others can't match."""

    def around(p: Column) -> Column:
        reach = F.greatest(F.lit(0), p - (kind.width + kind.shingle - 2))
        low, high = F.ceil(reach / kind.stride).cast("int") * kind.stride, F.least(p, F.size(shingles) - 1)
        return F.when(low <= high, F.sequence(low, F.greatest(low, high), F.lit(kind.stride))).otherwise(F.array().cast("array<int>"))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(places, around))))


def _joined(words: Column, k: int):
    return lambda i: F.array_join(F.slice(words, i, k), " ")


def number_of(own: list[str]) -> int:
    """A number for a template, by its shingles."""
    return int.from_bytes(hashlib.sha256("\n".join(own).encode()).digest()[:7])


_RETRIEVED = "array<struct<name:string,number:bigint,n:int,bands:array<bigint>,shingles:array<string>>>"


def _table(kind: Kind, templates: list[tuple[str, list[str]]]) -> Column:
    """The templates of a kind with their bands, as one constant."""
    rows = [{"name": name, "number": number_of(own), "n": len(own), "bands": signature_of(own, kind.bands), "shingles": own} for name, own in templates]
    return F.from_json(F.lit(json.dumps(rows)), _RETRIEVED)


def _signed_windows(kind: Kind, hashes: Column):
    """A window's start and the least hash of its shingles in each band."""

    def sign(i: Column) -> Column:
        window = F.slice(hashes, i + 1, kind.width)
        bands = F.sequence(F.lit(0).cast("long"), F.lit(kind.bands - 1).cast("long"))
        return F.struct(i.alias("i"), F.transform(bands, lambda b: F.array_min(F.transform(window, lambda x: F.xxhash64(x, b)))).alias("bands"))

    return sign


def _verified(kind: Kind, shingles: Column, table: Column):
    """Templates that agree with a window in some band, with the share of their shingles that it has."""

    def verify(w: Column) -> Column:
        window = F.slice(shingles, w["i"] + 1, kind.width)
        n_words = (F.size(window) + kind.shingle - 1).cast("long")
        retrieved = F.filter(table, lambda t: F.arrays_overlap(t["bands"], w["bands"]))
        return F.transform(
            retrieved,
            lambda t: F.struct(t["name"].alias("license"), w["i"].cast("long").alias("first_word"), n_words.alias("n_words"), (F.size(F.array_intersect(t["shingles"], window)) / t["n"]).alias("containment"), t["number"].alias("template")),
        )

    return verify


def with_licenses(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, *, text: str = "text", out: str = "licenses", keep: list[str] | None = None) -> DataFrame:
    """docs (its columns ``keep``, by default all) with an array ``out`` of matches: license, first_word and n_words
    of the window, containment (the share of the template's shingles that the window has), the template's number, in order.

    A window matches a template if it has at least LEAST of the template's distinct shingles of five words (templates
    with fewer words are one shingle).  Words are lower-cased runs of letters and digits; anything but ASCII counts as
    a letter.  Null and empty texts have no matches, repeated rows are judged alike, very long texts are read whole, and
    a column named as ``out`` is replaced.  Without templates or rows there are no matches.  MinHash bands retrieve the
    templates of a window, missing one that matches with a chance of MISS at most, and the shingles verify them.
    """
    keep = [c for c in keep or docs.columns if c.lower() != out.lower()]
    rows = docs.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.col(text).cast("string").alias("t"))
    kinds = kinds_of(templates)
    if not kinds:
        nothing = F.array().cast("array<struct<license:string,first_word:bigint,n_words:bigint,containment:double,template:bigint>>")
        return rows.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), nothing.alias(out))
    telling = {kind: screen_words({kind: own}) for kind, own in kinds.items()}
    some = sorted({w for words in telling.values() for w in words})
    # texts without a word that every match of some template has aren't cut into words
    screen = F.coalesce(F.rlike(F.lower("t"), F.lit("|".join(some))), F.lit(False))
    words = F.filter(F.split(lower_ascii(F.col("t")), _GAP), lambda w: w != "")
    rows = rows.withColumn("w", F.when(screen, words).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("p", F.filter(F.transform("w", lambda w, i: F.when(w.isin(*some), F.struct(i.alias("i"), w.alias("w")))), lambda x: x.isNotNull()))
    rows = rows.withColumn("w", F.when(F.size("p") > 0, F.col("w")).otherwise(F.array().cast("array<string>")))
    for k in sorted({x.shingle for x in kinds}):
        at = F.when(F.size("w") >= k, F.sequence(F.lit(1), F.size("w") - k + 1)).otherwise(F.array().cast("array<int>"))
        rows = rows.withColumn(f"s{k}", F.transform(at, _joined(F.col("w"), k))).withColumn(f"h{k}", F.transform(f"s{k}", lambda s: F.xxhash64(s)))
    for n, (kind, own) in enumerate(kinds.items()):
        shingles = F.col(f"s{kind.shingle}")
        places = F.transform(F.filter("p", _telling(telling[kind])), lambda x: x["i"])
        rows = rows.withColumn(f"a{n}", _starts(places, shingles, kind))
        rows = rows.withColumn(f"b{n}", F.transform(f"a{n}", _signed_windows(kind, F.col(f"h{kind.shingle}"))))
        found = F.flatten(F.transform(f"b{n}", _verified(kind, shingles, _table(kind, own))))
        rows = rows.withColumn(f"m{n}", F.filter(found, lambda m: m["containment"] >= LEAST))
    matches = F.array_sort(F.concat(*(f"m{n}" for n in range(len(kinds)))), lambda a, b: _order(a, b))
    return rows.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), matches.alias(out))


def _telling(words: list[str]):
    return lambda x: x["w"].isin(*words)


def _order(a: Column, b: Column) -> Column:
    out = F.lit(0)
    for c in ("n_words", "license", "first_word"):
        out = F.when(a[c] < b[c], -1).when(a[c] > b[c], 1).otherwise(out)
    return out


def rivals_of(templates: Sequence[tuple[str, str]]) -> list[tuple[int, int, float]]:
    """Pairs of templates of different licenses (a, b) where a's words alone make b match, and b's containment in a."""
    own = [(name, k, x) for k, group in kinds_of(templates).items() for name, x in group]
    out = []
    for (a, j, x), (b, k, y) in permutations(own, 2):
        in_a = set(shingles_of(_words(x), k.shingle)) if j.shingle >= k.shingle else set()
        share = sum(s in in_a for s in y) / len(y)
        if a != b and share >= LEAST and (share < 1 or len(x) > len(y)):
            out.append((number_of(x), number_of(y), share))
    return out


def _words(shingles: list[str]) -> list[str]:
    """The words that distinct shingles in order were cut from, but for repeats."""
    return shingles[0].split() + [s.split()[-1] for s in shingles[1:]]


def best(matches: Column, templates: Sequence[tuple[str, str]] = TEMPLATES) -> Column:
    """Of matches whose windows overlap and whose templates share words, those that aren't explained by another.

    A match goes if an overlapping one has a rival template with no less containment and all that was found of its own
    template can be the rival's words.  Others stay, near as they may lie, so that no notice is lost to a neighbour.
    """
    rivals = rivals_of(templates)
    if not rivals:
        return matches
    pairs = F.array(*(F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b"), F.lit(s).alias("s")) for a, b, s in rivals))

    def explained(m: Column, o: Column) -> Column:
        near = (o["first_word"] < m["first_word"] + m["n_words"]) & (m["first_word"] < o["first_word"] + o["n_words"])
        rival = F.exists(pairs, lambda p: (p["a"] == o["template"]) & (p["b"] == m["template"]) & (m["containment"] <= p["s"] + 1e-9))
        return near & (o["containment"] >= m["containment"]) & rival

    return F.filter(matches, lambda m: ~F.exists(matches, lambda o: explained(m, o)))
