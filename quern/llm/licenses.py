"""License scan: canonical digests of entire texts, joined with the digests of known license texts.

A text is made canonical by lower-casing, one spelling for equivalent ones, no copyright lines, no punctuation and
single spaces; its SHA-256 is looked up. A unit is the whole text of a document and each of its lines, each taken
entire, so that a document that is a license and a license notice inside another document are both found.

A copyright line begins with copyright, (c) or the sign, followed by a year, another of them or "by"; a line of the
license's own text that happens to begin with the word stays. A notice of several lines inside a longer text is no unit.

Defined results: null, empty or punctuation-only units match nothing. Each row of docs has a result of its own, and equal
rows equal ones. The table of known texts is a parameter; texts that become equal are one entry, whose smallest license
id counts.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import let

#: Public notices and texts, as printed by their publishers.
KNOWN: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", 'MIT License Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("ISC", 'ISC License Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
    ("LicenseRef-all-rights-reserved", "All rights reserved."),
]
#: Equivalent spellings: (as written, as canonical), whole words, lower case.
SPELLINGS = [("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("organisation", "organization"), ("behaviour", "behavior"), ("favour", "favor"), ("whilst", "while"), ("https", "http")]
#: A copyright line in lower case, and punctuation beyond ASCII: blanks, angle and curly quotes, dashes, dots.
NOTICE = "[^a-z0-9\\n]*(?:copyright|\\(c\\)|\u00a9)[ \\t]*(?:[:,][ \\t]*)?(?:copyright|\\(c\\)|\u00a9|by |(?:19|20)[0-9][0-9])[^\\n]*"
MARKS = "\u00a0\u00ab\u00bb\u2010-\u2015\u2018-\u201f\u2026"
#: Known digests that are broadcast (under 20 MB); beyond that the join shuffles the units' digests, no texts.
MAX_KNOWN = 100_000


def _lines(text: Column) -> Column:
    """The canonical text, line by line: lower case, no copyright lines, one spelling, no punctuation."""
    marked = lambda x: x.contains("copyright") | x.contains("(c)") | x.contains("\u00a9")
    unsigned = lambda x: F.regexp_replace(x, f"(?m)^{NOTICE}$", "")

    def spelled(x: Column) -> Column:
        for old, new in SPELLINGS:
            x = F.regexp_replace(x, f"(?<![^ \\n]){old}(?![^ \\n])", new)
        return x

    any_old = lambda x: reduce(or_, (x.contains(old) for old, _ in SPELLINGS))
    plain = let(F.lower(F.coalesce(text, F.lit(""))), lambda x: F.when(marked(x), unsigned(x)).otherwise(x))
    plain = F.regexp_replace(plain, f"[\\x00-\\x09\\x0b-\\x2f\\x3a-\\x60\\x7b-\\x7f{MARKS}]+", " ")
    return let(plain, lambda x: F.when(any_old(x), spelled(x)).otherwise(x))


def canonical(text: Column) -> Column:
    """The canonical form of an entire text."""
    return F.trim(F.regexp_replace(_lines(text), "[ \\n]+", " "))


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """(digest, license_id, size), one row for each canonical text."""
    rows = F.array(*(F.struct(F.lit(i).alias("license_id"), F.lit(t).alias("known_text")) for i, t in (KNOWN if known is None else known)))
    table = spark.range(1).select(F.explode(rows).alias("k")).select("k.license_id", canonical(F.col("k.known_text")).alias("c")).filter("c <> ''")
    return table.groupBy(F.sha2("c", 256).alias("digest"), F.length("c").alias("size")).agg(F.min("license_id").alias("license_id"))


def license_hits(docs: DataFrame, known: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, th: a hash of the text, unit, license_id) of each unit that is a known text; unit 0 is the whole text, i its i-th line."""
    n, low, high = known.agg(F.count("*"), F.min("size"), F.max("size")).first()
    known = F.broadcast(known) if n <= MAX_KNOWN else known
    whole = docs.select(F.col(f"`{key}`").alias("key"), F.xxhash64(F.col(f"`{text}`")).alias("th"), _lines(F.col(f"`{text}`")).alias("_x"))
    units = F.concat(F.array(F.trim(F.regexp_replace("_x", "[ \n]+", " "))), F.transform(F.split("_x", "\n"), lambda u: F.trim(u)))
    rows = whole.select("key", "th", F.posexplode(units).alias("unit", "_u")).filter(F.length("_u").between(low or 0, high or 0))
    return rows.select("key", "th", "unit", F.sha2("_u", 256).alias("digest")).join(known, "digest").select("key", "th", "unit", "license_id")


def scan_licenses(docs: DataFrame, known: DataFrame | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row of docs: key, n_hits (units), licenses (distinct ids, sorted), whole_license (of the entire text, else null)."""
    known = known_digests(docs.sparkSession) if known is None else known
    hits = license_hits(docs, known, text, key).groupBy(F.col("key").alias("_k"), F.col("th").alias("_th")).agg(
        F.count_distinct("unit").alias("n_hits"),
        F.array_sort(F.collect_set("license_id")).alias("licenses"),
        F.min(F.when(F.col("unit") == 0, F.col("license_id"))).alias("whole_license"),
    )
    rows = docs.select(F.col(f"`{key}`"), F.xxhash64(F.col(f"`{text}`")).alias("th"))
    found = rows.join(hits, F.col(f"`{key}`").eqNullSafe(F.col("_k")) & (F.col("th") == F.col("_th")), "left").drop("_k", "_th", "th")
    return found.withColumns({"n_hits": F.coalesce("n_hits", F.lit(0)), "licenses": F.coalesce("licenses", F.array().cast("array<string>"))})


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan_licenses(docs).select("doc_id", "n_hits", F.concat_ws(",", "licenses").alias("licenses"), "whole_license")


def _sql() -> str:
    q = lambda x: "'" + x.replace("'", "''") + "'"
    spell = "CASE w " + " ".join(f"WHEN {q(a)} THEN {q(b)}" for a, b in SPELLINGS) + " ELSE w END"
    line = f"regexp_replace(regexp_replace(lower({{}}), '^{NOTICE}$', ''), '[\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f{MARKS}]+', ' ', 'g')"
    canon = f"list_aggregate(list_transform(list_filter(string_split({line}, ' '), lambda w: w <> ''), lambda w: {spell}), 'string_agg', ' ')"
    return f"""
WITH known AS (SELECT {canon.format("t")} AS c, min(i) AS license_id FROM (VALUES {", ".join(f"({q(i)}, {q(t)})" for i, t in KNOWN)}) v(i, t) GROUP BY 1),
l AS (SELECT doc_id, list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {canon.format("x")}) AS ls FROM documents),
u AS (SELECT doc_id, 0 AS unit, list_aggregate(list_filter(ls, lambda x: x IS NOT NULL AND x <> ''), 'string_agg', ' ') AS c FROM l
      UNION ALL SELECT doc_id, 1 AS unit, unnest(ls) AS c FROM l),
h AS (SELECT doc_id, unit, license_id FROM u JOIN known USING (c))
SELECT d.doc_id, count(h.license_id) AS n_hits, coalesce(string_agg(DISTINCT h.license_id, ',' ORDER BY h.license_id), '') AS licenses,
       min(CASE WHEN h.unit = 0 THEN h.license_id END) AS whole_license
FROM documents d LEFT JOIN h ON h.doc_id = d.doc_id GROUP BY d.doc_id
"""


SQL = _sql()
