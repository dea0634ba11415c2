"""License scan: texts normalised to a canonical form, looked up by digest among known license texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremorline.llm.common import table, text_of
from tremorline.llm.registry import query

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# License texts and notices, by SPDX identifier.
LICENSES = (
    ("MIT", """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("ISC", """ISC License

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("0BSD", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
)

# Spellings that count as equal, applied in this order to words in lower case.
EQUIVALENT = (
    ("licence", "license"), ("licenced", "licensed"), ("copyright owner", "copyright holder"),
    ("copyright owners", "copyright holders"), ("non infringement", "noninfringement"), ("organisation", "organization"),
    ("programme", "program"), ("behaviour", "behavior"), ("favour", "favor"), ("judgement", "judgment"),
    ("per cent", "percent"), ("while", "whilst"), ("sublicence", "sublicense"), ("https", "http"), ("version", "v"),
)

COPYRIGHT_LINE = r"(^|\n)[ \t]*(copyright|\(c\)|©)[^\n]*([0-9]{4}|\(c\)|©|all rights reserved)[^\n]*"
OTHER_CHARACTERS = r"[^a-z0-9\x{80}-\x{10FFFF}\n]+"


def canonical_lines(text: Column) -> Column:
    """Lower case (ASCII), without copyright lines, two spaces for anything but letters and digits, equivalent spellings
    made equal; line breaks stay. The doubled spaces let neighbouring words be replaced alike."""
    out = F.translate(text, UPPER, LOWER)
    out = F.regexp_replace(out, COPYRIGHT_LINE, "$1")
    out = F.regexp_replace(out, OTHER_CHARACTERS, "  ")
    out = F.concat(F.lit(" "), F.replace(out, F.lit("\n"), F.lit(" \n ")), F.lit(" "))
    for old, new in EQUIVALENT:
        out = F.replace(out, F.lit(_spaced(old)), F.lit(_spaced(new)))
    return out


def _spaced(words: str) -> str:
    return f" {words.replace(' ', '  ')} "


def digest(lines: Column) -> Column:
    """MD5 of the words joined by single spaces."""
    return F.md5(F.trim(F.regexp_replace(lines, r"[ \n]+", " ")))


def known_licenses(spark: SparkSession, licenses=LICENSES) -> DataFrame:
    """(digest, license) of the canonical texts; one row per different text."""
    schema = T.StructType([T.StructField("license", T.StringType()), T.StructField("text", T.StringType())])
    rows = spark.createDataFrame(list(licenses), schema)
    known = rows.select("license", digest(canonical_lines(F.col("text"))).alias("digest"))
    return known.groupBy("digest").agg(F.min("license").alias("license"))


def scan_licenses(docs: DataFrame, licenses=LICENSES) -> DataFrame:
    """doc_id, digest, license, notices: one row per row of ``docs``.

    ``license`` belongs to the whole text, ``notices`` (comma-joined, sorted, each once; empty if none) to single lines of
    it, each looked up as a text of its own. Null and empty texts, and texts of nothing but copyright lines, have the
    digest of the empty text and no license. Rows repeat as given; null doc_ids are kept; an empty table gives no rows;
    other columns are ignored. The known licenses are a parameter of a few rows: whole texts meet them in a broadcast
    join, lines in a constant map, so that no line leaves its row.
    """
    known = known_licenses(docs.sparkSession, licenses)
    entries = known.collect()  # the parameter itself
    by_digest = F.create_map(*[F.lit(v) for r in entries for v in (r["digest"], r["license"])])
    rows = docs.select("doc_id", canonical_lines(text_of()).alias("lines"))
    digests = F.transform(F.split("lines", "\n"), digest)
    found = F.transform(F.filter(digests, lambda d: F.map_contains_key(by_digest, d)), lambda d: F.element_at(by_digest, d))
    rows = rows.select(
        "doc_id", digest(F.col("lines")).alias("digest"),
        F.array_join(F.sort_array(F.array_distinct(found)), ",").alias("notices"),
    )
    return rows.join(F.broadcast(known), "digest", "left").select("doc_id", "digest", "license", "notices")


def _sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    lines = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
    lines = f"regexp_replace({lines}, {quote(COPYRIGHT_LINE)}, '\\1', 'g')"
    lines = f"regexp_replace({lines}, {quote(OTHER_CHARACTERS)}, '  ', 'g')"
    lines = f"' ' || replace({lines}, chr(10), ' ' || chr(10) || ' ') || ' '"
    for old, new in EQUIVALENT:
        lines = f"replace({lines}, {quote(_spaced(old))}, {quote(_spaced(new))})"
    of = lambda x: f"md5(trim(regexp_replace({x}, '[ \\n]+', ' ', 'g')))"
    values = ", ".join(f"({quote(name)}, {quote(text)})" for name, text in LICENSES)
    return f"""WITH given(license, text) AS (VALUES {values}),
known AS (SELECT digest, min(license) AS license FROM (SELECT license, {of(f'({lines})')} AS digest FROM given) GROUP BY 1),
docs AS (SELECT row_number() OVER () AS row, doc_id, {lines} AS lines FROM documents),
single AS (SELECT row, unnest(string_split(lines, chr(10))) AS line FROM docs),
noticed AS (SELECT row, string_agg(DISTINCT license, ',' ORDER BY license) AS notices
  FROM (SELECT row, {of('line')} AS digest FROM single) JOIN known USING (digest) GROUP BY 1)
SELECT doc_id, {of('lines')} AS digest, known.license AS license, coalesce(notices, '') AS notices
FROM docs LEFT JOIN noticed USING (row) LEFT JOIN known ON known.digest = {of('lines')}"""


@query("op1_licenses", _sql())
def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses of all documents."""
    return scan_licenses(table(spark, sf_dir, "documents"))
