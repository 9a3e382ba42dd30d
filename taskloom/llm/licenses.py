"""Licence texts and notices in documents: Dice coefficient over word bigrams against templates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load

_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_DISCLAIMER = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE '
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE "
    "LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
    "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
    "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution. "
)


def _gnu(kind: str, version: str) -> str:
    return (
        f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the "
        f"Free Software Foundation, either version {version} of the License, or (at your option) any later version. This program is distributed in the hope that it "
        "will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
        f"GNU {kind}General Public License for more details."
    )


#: (licence, text): public licence texts and the headers that stand in files.
TEXTS = [
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the "
     "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
     "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all "
     "copies or substantial portions of the Software. " + _WARRANTY),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
     "permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES "
     "OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS "
     "OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-2-Clause", _BSD + _DISCLAIMER),
    ("BSD-3-Clause", _BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without "
     "specific prior written permission. " + _DISCLAIMER),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
     "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
     "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-2.0-or-later", _gnu("", "2")),
    ("GPL-3.0-or-later", _gnu("", "3")),
    ("LGPL-2.1-or-later", _gnu("Lesser ", "2.1")),
    ("AGPL-3.0-or-later", _gnu("Affero ", "3")),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at "
     "http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in "
     "source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of "
     "this software dedicate any and all copyright interest in the software to the public domain."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
     "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
     "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the "
     "product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. "
     "3. This notice may not be removed or altered from any source distribution."),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "
     "\"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the "
     "Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and "
     "the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are "
     "solely in the form of machine-executable object code generated by a source language processor."),
]
#: (licence, notice): short public notices; a caller gives others.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "All rights reserved."),
]
#: A passage is a licence from this likeness on.
LEAST = 0.8
_BETWEEN = r"[^\p{L}\p{N}]+"


def _grams(text: str) -> list[str]:
    import regex

    words = regex.sub(_BETWEEN, " ", text.lower()).split()
    return [f"{a} {b}" for a, b in zip(words, words[1:])]


def _templates(texts: list[tuple[str, str]], least: float) -> list[tuple[str, list[str], int, int]]:
    """(name, distinct bigrams, bigrams, bigrams that a passage must share): of m bigrams a passage of Dice `least`
    shares c with 2 c >= least * (m + |passage|) and |passage| >= c, so c >= least * m / (2 - least)."""
    found = [(name, g) for name, text in texts if (g := _grams(text))]
    return [(name, d, len(g), -int(-least * len(d) / (2 - least) // 1)) for name, g in found for d in [list(dict.fromkeys(g))]]


def license_scan(docs: DataFrame, texts: list[tuple[str, str]] = TEXTS + NOTICES, least: float = LEAST, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_licenses, licenses, license, dice, start): the licences of which each text holds a passage of its own, and
    the best.

    Texts are lower-cased and all but letters and digits is one space, so line breaks mean nothing. A passage is as many
    word bigrams as the template has, from one of the template's on, and at most to the text's end; its set of bigrams P
    and the template's T are alike by 2 |P and T| / (|P| + |T|). A template is only tried on texts that share as many
    bigrams with it as any passage of `least` must. Templates of one family are alike, so of passages that share a bigram
    only the likest counts, and the next ones only where they share none with those before; ties go to the earlier
    template, then the earlier passage. licenses are the names of those passages, in order, joined by commas; license is
    the likest one's, start its first word (0-based). Null and empty texts, and texts without a licence, have n_licenses 0, "" and nulls. Whole texts
    are read, however long; repeated rows each have a row; other columns are not read. No shuffle, no Python.
    """
    templates = _templates(texts, least)
    words = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), _BETWEEN, " ")), " ")
    none = F.array().cast("array<string>")
    two = lambda w: F.when(F.size(w) > 1, F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda k: F.concat_ws(" ", F.get(w, k), F.get(w, k + 1)))).otherwise(none)
    let = lambda value, f: F.transform(F.array(value), f)[0]
    union = F.array(*map(F.lit, dict.fromkeys(g for _, d, _, _ in templates for g in d)))
    known = F.array(*[F.struct(F.lit(-i).alias("no"), F.lit(name).alias("name"), F.array(*map(F.lit, d)).alias("g"), F.lit(n).alias("n"), F.lit(need).alias("need")) for i, (name, d, n, need) in enumerate(templates)])

    def passages(g: Column, t: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(g) - 1), lambda k: F.array_contains(t["g"], F.get(g, k)))
        dice = lambda p: F.lit(2.0) * F.size(F.array_intersect(p, t["g"])) / (F.size(F.array_distinct(p)) + F.size(t["g"]))
        made = F.transform(starts, lambda k: F.struct((-dice(F.slice(g, k + 1, t["n"]))).alias("dice"), (-t["no"]).alias("no"), k.alias("at"), (k + t["n"]).alias("end"), t["name"].alias("name")))
        return F.filter(made, lambda m: m["dice"] <= -least)

    def apart(kept: Column, m: Column) -> Column:
        meets = F.exists(kept, lambda x: (x["at"] < m["end"]) & (m["at"] < x["end"]))
        return F.when(meets, kept).otherwise(F.array_append(kept, m))

    def found(g: Column) -> Column:
        near = let(F.array_intersect(g, union), lambda hits: F.filter(known, lambda t: F.size(F.array_intersect(hits, t["g"])) >= t["need"]))
        all_ = F.array_sort(F.flatten(F.transform(near, lambda t: passages(g, t))))  # the likest first
        return F.aggregate(all_, F.array().cast("array<struct<dice:double,no:int,at:int,end:int,name:string>>"), apart)

    out = docs.select(F.col(key), let(let(words, two), found).alias("_found")).withColumn("_best", F.get("_found", F.lit(0)))
    names = F.array_sort(F.array_distinct(F.transform("_found", lambda m: m["name"])))
    return out.select(key, F.size(names).cast("long").alias("n_licenses"), F.array_join(names, ",").alias("licenses"), F.col("_best.name").alias("license"), (-F.col("_best.dice")).alias("dice"), F.col("_best.at").cast("long").alias("start"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(load(spark, sf_dir, "documents"))


def oracle() -> str:
    """The same over DuckDB's view of documents."""
    sql = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ",\n".join(f"({i}, {sql(name)}, [{', '.join(map(sql, d))}], {n}, {need})" for i, (name, d, n, need) in enumerate(_templates(TEXTS + NOTICES, LEAST)))
    return rf"""
WITH t(no, name, tg, n, need) AS (VALUES {rows}),
w AS (SELECT doc_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS w FROM documents),
g AS (SELECT doc_id, [w[k] || ' ' || w[k + 1] for k in range(1, len(w))] AS g FROM w),
near AS (SELECT doc_id, g, t.no, t.name, t.tg, t.n FROM g, t WHERE len(list_intersect(list_distinct(g), tg)) >= need),
p AS (SELECT doc_id, no, name, tg, n, s - 1 AS start, g[s:s + n - 1] AS p FROM near, unnest([k for k in range(1, len(g) + 1) if list_contains(tg, g[k])]) u(s)),
m AS (SELECT doc_id, no, name, start, start + n AS stop, CAST(2.0 AS DOUBLE) * len(list_intersect(list_distinct(p), tg)) / (len(list_distinct(p)) + len(tg)) AS dice FROM p),
hit AS (SELECT doc_id, list(struct_pack(dice := dice, start := start, stop := stop, name := name) ORDER BY dice DESC, no, start) AS h FROM m WHERE dice >= {LEAST} GROUP BY doc_id),
kept AS (SELECT doc_id, list_reduce([[x] for x in h], lambda a, x: CASE WHEN len([y for y in a if y.start < x[1].stop AND x[1].start < y.stop]) > 0 THEN a ELSE list_concat(a, x) END) AS k FROM hit)
SELECT d.doc_id, CAST(coalesce(len(list_distinct([x.name for x in k])), 0) AS BIGINT) AS n_licenses, coalesce(array_to_string(list_sort(list_distinct([x.name for x in k])), ','), '') AS licenses, k[1].name AS license, k[1].dice AS dice, CAST(k[1].start AS BIGINT) AS start FROM documents d LEFT JOIN kept USING (doc_id)
"""
