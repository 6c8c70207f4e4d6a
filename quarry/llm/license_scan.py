"""License scans: canonical digests of whole texts and lines, hash-joined to known licences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import table, text_or_empty

# Public licence texts and notices, and equivalent spellings.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."""
BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_NAME = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
GPL_NOTICE = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""
MPL_NOTICE = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
ZERO_BSD = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org>"""
#: Licences by the names that sentences give them, and by their identifiers.
NAMES = (
    ("MIT", "the MIT License"), ("Apache-2.0", "the Apache License, Version 2.0"), ("GPL-3.0", "the GNU General Public License, version 3"), ("GPL-2.0", "the GNU General Public License, version 2"),
    ("LGPL-3.0", "the GNU Lesser General Public License, version 3"), ("AGPL-3.0", "the GNU Affero General Public License, version 3"), ("BSD-3-Clause", "the BSD 3-Clause License"),
    ("BSD-2-Clause", "the BSD 2-Clause License"), ("MPL-2.0", "the Mozilla Public License, version 2.0"), ("ISC", "the ISC License"), ("CC-BY-4.0", "CC BY 4.0"), ("CC-BY-SA-4.0", "CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "CC BY-NC 4.0"), ("CC-BY-ND-4.0", "CC BY-ND 4.0"), ("CC-BY-NC-SA-4.0", "CC BY-NC-SA 4.0"), ("CC-BY-NC-ND-4.0", "CC BY-NC-ND 4.0"), ("CC0-1.0", "CC0 1.0"),
)
SENTENCES = ("Licensed under", "Released under", "This work is licensed under")
KNOWN = (
    *((name, f"{lead}{text}") for name, title, text in (
        ("MIT", "MIT License", MIT), ("ISC", "ISC License", ISC), ("Zlib", "zlib License", ZLIB), ("BSD-2-Clause", "BSD 2-Clause License", f"{BSD_2} {BSD_END}"),
        ("BSD-3-Clause", "BSD 3-Clause License", f"{BSD_2} {BSD_NAME} {BSD_END}"), ("0BSD", "Zero-Clause BSD", ZERO_BSD), ("Unlicense", "The Unlicense", UNLICENSE),
    ) for lead in ("", f"{title}\n", f"The {title}\n")),
    ("Apache-2.0", APACHE_NOTICE), ("GPL-3.0", GPL_NOTICE), ("MPL-2.0", MPL_NOTICE), ("MPL-2.0", MPL_NOTICE.split(" If ")[0]),
    *((name, f"{sentence} {title}.") for name, title in NAMES for sentence in SENTENCES),
    *((name, f"SPDX-License-Identifier: {name}{ending}") for name, _ in NAMES for ending in (("", "-only", "-or-later") if "GPL" in name else ("",))),
    ("Zlib", "SPDX-License-Identifier: Zlib"), ("0BSD", "SPDX-License-Identifier: 0BSD"), ("Unlicense", "SPDX-License-Identifier: Unlicense"),
)
#: A line that begins with copyright and names a year, a sign or authors, or that is nothing else; not one of a licence's own words.
COPYRIGHT_LINE = r"^[^a-z0-9]*(?:copyright[^a-z0-9]*$|copyright\b.*(?:\b(?:19|20)[0-9][0-9]\b|\(c\)|©|<year>|\[yyyy\]|\bauthors[^a-z0-9]*$)|\(c\)|©|all rights reserved).*$"
SPELLINGS = (
    ("licence", "license"), ("licenced", "licensed"), ("acknowledgement", "acknowledgment"), ("organisation", "organization"),
    ("noncommercial", "non commercial"), ("non infringement", "noninfringement"), ("merchantibility", "merchantability"),
    ("sub license", "sublicense"), ("copyright owner", "copyright holder"), ("per cent", "percent"), ("https", "http"),
)


def bare(line: Column) -> Column:
    """A line's letters and digits in lower case, one space between words; nothing of a copyright line."""
    low = F.lower(line)
    words = F.trim(F.regexp_replace(low, r"[^\p{L}\p{N}]+", " "))
    return F.when(low.rlike(COPYRIGHT_LINE), "").otherwise(words)


def spelt(words: Column) -> Column:
    """One spelling of words with a space between them."""
    out = F.concat(F.lit(" "), words, F.lit(" "))
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(f" {a} "), F.lit(f" {b} "))
    return F.trim(out)


def canonical(bare_lines: Column) -> Column:
    """The canonical form of a whole text from its lines' bare ones."""
    return spelt(F.array_join(F.filter(bare_lines, lambda x: x != ""), " "))


def bare_lines(text: Column) -> Column:
    return F.transform(F.split(text, "\n", -1), bare)


def known_digests(spark: SparkSession, known=KNOWN) -> DataFrame:
    """Rows (digest, license); two known texts of one canonical form count as the alphabetically first."""
    rows = spark.createDataFrame(list(known), "license string, text string").select("license", canonical(bare_lines(F.col("text"))).alias("c"))
    return rows.groupBy(F.sha2("c", 256).alias("digest")).agg(F.min("license").alias("license"))


def scan_licenses(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (id, scope, line, license): whole texts (line -1) and lines (from 0) equal to a known text.

    Equality is of sha-256 digests of canonical forms over entire texts and
    entire lines, which one scan makes: a whole text's form is put together
    from its lines'. ``known`` is a fixed list (its rows don't grow with the
    corpus) and is broadcast; nothing is shuffled. Null and empty texts match
    nothing. Repeated rows give repeated matches, rows with a null id matches
    with a null id. The columns of ``keep`` are carried along, others ignored.
    """
    carried = tuple(F.col(c).alias(f"k{i}") for i, c in enumerate(keep))
    text = docs.select(F.col(id_col).alias("id"), *carried, bare_lines(text_or_empty(text_col)).alias("lines"))
    whole = F.struct(F.lit("text").alias("scope"), F.lit(-1).alias("line"), canonical(F.col("lines")).alias("c"))
    each = F.transform(F.when(F.size("lines") > 1, F.col("lines")), lambda x, i: F.struct(F.lit("line").alias("scope"), i.alias("line"), spelt(x).alias("c")))
    units = text.select("id", *(f"k{i}" for i in range(len(keep))), F.explode(F.filter(F.concat(F.array(whole), F.coalesce(each, F.array())), lambda u: u["c"] != "")).alias("u"))
    found = units.withColumn("digest", F.sha2("u.c", 256)).join(F.broadcast(known.select("digest", "license")), "digest")
    return found.select(F.col("id").alias(id_col), F.col("u.scope").alias("scope"), F.col("u.line").alias("line"), "license", *(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (doc_id, whole_license, licenses, n_lines, first_line), one for each row of ``documents``.

    Rows meet their matches by id and text, so rows with a null id keep
    theirs, and repeated rows have the same ones, each line counted once.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.md5(text_or_empty("text")).alias("version"))
    hits = scan_licenses(docs, known_digests(spark), keep=("version",))
    by_doc = hits.groupBy(F.col("doc_id").alias("k"), F.col("version").alias("v")).agg(
        F.min(F.when(F.col("scope") == "text", F.col("license"))).alias("whole_license"),
        F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"),
        F.count_distinct(F.when(F.col("scope") == "line", F.col("line"))).alias("n_lines"),
        F.min(F.when(F.col("scope") == "line", F.col("line"))).cast("long").alias("first_line"),
    )
    rows = docs.select("doc_id", "version")
    return rows.join(by_doc, F.col("doc_id").eqNullSafe(F.col("k")) & (F.col("version") == F.col("v")), "left").select(
        "doc_id", "whole_license", F.coalesce("licenses", F.lit("")).alias("licenses"),
        F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"), "first_line",
    )


def _sql() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"

    def canon(x: str) -> str:
        line = f"CASE WHEN regexp_matches(l, {q(COPYRIGHT_LINE)}) THEN '' ELSE trim(regexp_replace(l, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) END"
        lines = f"list_filter(list_transform(string_split(lower({x}), chr(10)), lambda l: {line}), lambda l: l <> '')"
        out = f"' ' || array_to_string({lines}, ' ') || ' '"
        for a, b in SPELLINGS:
            out = f"replace({out}, {q(f' {a} ')}, {q(f' {b} ')})"
        return f"trim({out})"

    rows = ", ".join(f"({q(a)}, {q(b)})" for a, b in KNOWN)
    return f"""
WITH known AS (SELECT {canon("t")} AS c, min(license) AS license FROM (VALUES {rows}) AS v(license, t) GROUP BY 1),
units AS (SELECT doc_id, -1 AS line, {canon("coalesce(text, '')")} AS c FROM documents
  UNION ALL SELECT doc_id, pos - 1, {canon("x")} FROM (
    SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS x
    FROM documents WHERE contains(text, chr(10)))),
hits AS (SELECT doc_id, line, license FROM units JOIN known USING (c) WHERE c <> ''),
by_doc AS (SELECT doc_id, min(license) FILTER (WHERE line < 0) AS whole_license,
  string_agg(DISTINCT license, ',' ORDER BY license) AS licenses,
  count(*) FILTER (WHERE line >= 0) AS n_lines, min(line) FILTER (WHERE line >= 0) AS first_line FROM hits GROUP BY doc_id)
SELECT d.doc_id, whole_license, coalesce(licenses, '') AS licenses, coalesce(n_lines, 0) AS n_lines, first_line
FROM documents d LEFT JOIN by_doc USING (doc_id)
"""


SQL = _sql()
