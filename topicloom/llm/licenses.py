"""License scans: normalised text against licence templates by Dice coefficient over word bigrams.

DataFrame functions only. A text is cut into units (the whole text, its paragraphs, its lines). The
distinct word bigrams A of a unit match a template with bigrams B when 2|A and B| / (|A| + |B|) >= t.
Such a match needs |B| t/(2-t) <= |A| <= |B| (2-t)/t, so the sizes alone rule most templates out.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

#: Words that any English text holds: never a reason to look closer.
COMMON = "a an and any are as at be but by can for from has have if in is it its may no not of on or other such that the their this to under use was which will with without work you your".split()

# Notices and whole short licences, as their licences word them.
_WARRANTY = "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
_BSD_CONDITIONS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
    "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
    "distribution."
)
_BSD_THIRD = (
    " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission."
)
_BSD_DISCLAIMER = (
    " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, "
    "EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF "
    "USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
    "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED "
    "OF THE POSSIBILITY OF SUCH DAMAGE."
)
_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
    "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
    "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and "
    "this permission notice shall be included in all copies or substantial portions of the Software."
)
_MIT_DISCLAIMER = (
    " THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
    "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_GRANT = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
    "provided that the above copyright notice and this permission notice appear in all copies."
)
TEMPLATES = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required "
        "by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License."
    ),
    "MIT-line": "Released under the MIT License.",
    "MIT": _MIT_GRANT,
    "MIT-full": _MIT_GRANT + _MIT_DISCLAIMER,
    "BSD-line": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "BSD-2-Clause": _BSD_CONDITIONS,
    "BSD-2-Clause-full": _BSD_CONDITIONS + _BSD_DISCLAIMER,
    "BSD-3-Clause": _BSD_CONDITIONS + _BSD_THIRD,
    "BSD-3-Clause-full": _BSD_CONDITIONS + _BSD_THIRD + _BSD_DISCLAIMER,
    "ISC": _ISC_GRANT,
    "ISC-full": (
        _ISC_GRANT + " THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL "
        "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, "
        "OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF "
        "CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This "
        f"program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; {_WARRANTY} See the GNU General Public "
        "License for more details. You should have received a copy of the GNU General Public License along with this program; if "
        "not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."
    ),
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        f"version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; {_WARRANTY} See the GNU "
        "General Public License for more details."
    ),
    "LGPL-2.1": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
        "License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later "
        f"version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; {_WARRANTY} See the GNU "
        "Lesser General Public License for more details."
    ),
    "LGPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        f"version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; {_WARRANTY} See the GNU "
        "Lesser General Public License for more details."
    ),
    "AGPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        f"version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; {_WARRANTY} See the GNU "
        "Affero General Public License for more details."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "EPL-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which "
        "is available at https://www.eclipse.org/legal/epl-2.0/"
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for "
        "any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, "
        "including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The "
        "origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this "
        "software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered "
        "source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This "
        "notice may not be removed or altered from any source distribution."
    ),
    "BSL-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
        "accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and "
        "transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is "
        "furnished to do so, all subject to the following:"
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
        "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial "
        "or non-commercial, and by any means."
    ),
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
}


def template_bigrams(text: str) -> list[str]:
    words = re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def necessary_words(bigrams: list[str], threshold: float, chosen=()) -> list[str]:
    """Words of which a match must hold one.

    A match lacks at most |B| (1 - t/(2-t)) of the template's bigrams B, so words that stand in more of
    them than that cannot all be missing. Greedy: words ``chosen`` for
    another template and words of most bigrams first, common and short ones last.
    """
    left, out, spare = set(bigrams), [], len(bigrams) * (1 - threshold / (2 - threshold)) + 1e-9
    while len(bigrams) - len(left) <= spare:
        words = sorted({w for b in left for w in b.split()})
        best = max(words, key=lambda w: (w not in COMMON, w in chosen, len(w) > 3, sum(w in b.split() for b in left), len(w)))
        left = {b for b in left if best not in b.split()}
        out.append(best)
    return out


def unit_bigrams(unit: Column) -> Column:
    """Distinct word bigrams of a unit: A-Z lower-cased, all but a-z and 0-9 a separator."""
    plain = F.trim(F.regexp_replace(F.translate(unit, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[^a-z0-9]+", " "))
    words = F.split(plain, " ")
    pairs = F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.when(F.size(words) > 1, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each input row: ``(key, license, dice, n_matches)``.

    ``license`` and ``dice`` are those of the best match of any unit with any template (ties: the
    smaller name) and null without one; ``n_matches`` counts distinct pairs of matching unit text and
    template. Null and empty texts have no match. Rows that share a key stay apart, and other columns
    of the input, whatever they are called, are left out. No shuffle: everything happens in the row.
    The templates (tens, a parameter) travel as literals.
    """
    spread = {name: b for name, b in ((n, template_bigrams(t)) for n, t in sorted((templates or TEMPLATES).items())) if b}
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    found = F.array().cast("array<struct<dice:double,license:string>>")
    every = F.array(*[F.lit(b) for b in sorted({b for bs in spread.values() for b in bs})])
    lit = {name: F.array(*[F.lit(b) for b in bs]) for name, bs in spread.items()}

    whole = F.coalesce(F.col(text), F.lit(""))
    needed: list[str] = []
    for b in sorted(spread.values(), key=len):
        needed += [w for w in necessary_words(b, threshold, needed) if w not in needed]
    needed = [w for w in needed if not any(v != w and v in w for v in needed)]  # who holds the longer word holds the shorter

    def may(unit):
        def any_of(lower):
            out = F.lit(False)
            for word in needed:
                out |= F.contains(lower, F.lit(word))
            return out

        return F.exists(F.array(F.lower(unit)), any_of)  # lower case once, not once a word

    # units of texts without a necessary word are not cut, and those without one not turned into bigrams
    units = F.array_distinct(F.concat(F.array(whole), F.split(whole, r"\n[\x20\x09-\x0D]*\n"), F.split(whole, r"\n")))
    units = F.filter(units, may)
    least, most = min((len(b) for b in spread.values()), default=0) * low, max((len(b) for b in spread.values()), default=0) * high
    grams = F.filter(F.transform(units, unit_bigrams), lambda a: F.size(a).between(least, most))
    # a match needs |A and B| >= t/(2-t) |A|, and so as large a share of A among all templates' bigrams
    grams = F.filter(grams, lambda a: F.size(F.array_intersect(a, every)) >= low * F.size(a) - 1e-9)
    held = df.select(F.col(key), F.when(may(whole), F.array_distinct(F.transform(grams, lambda a: F.array_sort(a)))).otherwise(F.array().cast("array<array<string>>")).alias("_grams"))

    def against(name: str):
        def dice(a):
            n, b = F.size(a), len(spread[name])
            shared = F.when(n.between(b * low - 1e-9, b * high + 1e-9), F.size(F.array_intersect(a, lit[name]))).otherwise(0)
            return F.struct((2 * shared / (n + b)).alias("dice"), F.lit(name).alias("license"))

        return F.filter(F.transform(F.col("_grams"), dice), lambda x: x.dice >= threshold)

    hits = F.concat(found, *[against(name) for name in spread])
    hits = F.when(F.size("_grams") > 0, hits).otherwise(found)
    best = F.element_at(F.array_sort(F.transform("_hits", lambda x: F.struct((-x.dice).alias("minus"), x.license.alias("license")))), 1)
    return (
        held.select(key, hits.alias("_hits"))
        .select(key, F.when(F.size("_hits") > 0, best).alias("_best"), F.size("_hits").cast("long").alias("n_matches"))
        .select(key, F.col("_best.license").alias("license"), (-F.col("_best.minus")).alias("dice"), "n_matches")
    )


def oracle(templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> str:
    """The same scan as DuckDB SQL, without the pruning."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({quote(n)}, {quote(t)})" for n, t in sorted((templates or TEMPLATES).items()))
    grams = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    words = "string_split(trim(regexp_replace(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g')), ' ')"
    return f"""
WITH t AS (SELECT license, {grams} b FROM (SELECT license, {words.format("body")} w FROM (VALUES {rows}) x(license, body))),
u AS (SELECT doc_id, unnest(list_distinct([coalesce(text, '')] || regexp_split_to_array(coalesce(text, ''), '\\n[\\x20\\x09-\\x0D]*\\n') || string_split(coalesce(text, ''), chr(10)))) unit FROM documents),
g AS (SELECT DISTINCT doc_id, list_sort({grams}) a FROM (SELECT doc_id, {words.format("unit")} w FROM u) WHERE len(w) > 1),
m AS (SELECT doc_id, license, 2 * len(list_intersect(a, b)) / (len(a) + len(b)) dice FROM g JOIN t ON len(a) BETWEEN len(b) * {threshold / (2 - threshold)} - 1e-9 AND len(b) * {(2 - threshold) / threshold} + 1e-9),
r AS (SELECT doc_id, license, dice, row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, license) k, count(*) OVER (PARTITION BY doc_id) n FROM m WHERE dice >= {threshold})
SELECT d.doc_id, r.license, r.dice, coalesce(r.n, 0) n_matches FROM documents d LEFT JOIN r ON d.doc_id = r.doc_id AND r.k = 1
"""
