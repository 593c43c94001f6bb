"""Licence scan by canonical digests.

A text is brought into a canonical form - lower case, punctuation and blanks as single
blanks, copyright notices gone, spellings that licences use alike made one - and its
digest is joined with those of known licences.  Two units are looked up: the entire
text, which names the document's licence, and each of its lines, which finds notices.
Known licences are a table, canonicalised by the same expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Known texts up to this many bytes are broadcast; a larger table is joined by shuffle.
BROADCAST_BYTES = 8 << 20

#: Spellings that count as equal, the second put for the first.
SPELLINGS = [
    ("licence", "license"),
    ("sub license", "sublicense"),
    ("non commercial", "noncommercial"),
    ("copyright holder", "copyright owner"),
    ("authorisation", "authorization"),
    ("organisation", "organization"),
    ("favour", "favor"),
    ("whilst", "while"),
    ("per cent", "percent"),
    ("https", "http"),
]

#: Public licence texts and the notices that stand for them.
KNOWN = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
]

#: Licence, the titles it goes by (none among them), and its public text.
TEXTS = [
    (
        "MIT",
        ("", "MIT License", "The MIT License", "The MIT License (MIT)"),
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "ISC",
        ("", "ISC License", "The ISC License"),
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    (
        "0BSD",
        ("", "BSD Zero Clause License", "Zero-Clause BSD"),
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    (
        "BSD-2-Clause",
        ("", "BSD 2-Clause License", "The 2-Clause BSD License", "Simplified BSD License"),
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
    (
        "BSD-3-Clause",
        ("", "BSD 3-Clause License", "The 3-Clause BSD License", "New BSD License"),
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
    (
        "Unlicense",
        ("", "The Unlicense"),
        """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>""",
    ),
    (
        "Zlib",
        ("", "zlib License", "The zlib/libpng License"),
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.""",
    ),
    (
        "Apache-2.0-notice",
        ("",),
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    ),
]
KNOWN += [(name, f"{title}\n\n{text}" if title else text) for name, titles, text in TEXTS for title in titles]

#: A copyright notice, in lower case: its sign, its years, and a holder of some words whose dots end no
#: sentence; and words that make a line more than a notice.
_SIGN = r"(?:copyright[ \t]*(?:\(c\)|©)?|\(c\)[ \t]*(?:copyright)?|©[ \t]*(?:copyright)?)"
_YEARS = r"(?:(?:19|20)[0-9][0-9]|\[yyyy\]|\[year\]|<year>)(?:[ \t]*[-–,][ \t]*(?:(?:19|20)[0-9][0-9]|present))*"
_TOKEN = r"(?:(?:inc|ltd|co|corp|llc|jr|sr|al|[a-z])\.,?|[^ \t\r\n.]+(?:\.[^ \t\r\n.]+)*)"
_HOLDER = rf"(?:(?:by[ \t]+)?{_TOKEN}(?:[ \t]+{_TOKEN}){{0,9}})?"
_START = rf"[^\p{{L}}\p{{N}}\n(©]*{_SIGN}"
NOTICE = rf"^{_START}[ \t:]*{_YEARS}[ \t,.:;]*{_HOLDER}[ \t]*\.?[ \t]*(?:all rights reserved\.?)?[^\p{{L}}\p{{N}}\n]*$"
TERMS = r"\b(?:may|must|not|no|shall|will|can|cannot|prohibited|forbidden|permission|permitted|licensed|licence|license|without|only|pay|fee|proprietary|confidential|use|copy|copied)\b"

# the same in a text, without lines of these words; few lines begin like a notice, and only these are searched for words
NOTICES = rf"(?md)^(?={_START})(?!.*{TERMS}){NOTICE}"


def canonical_lines(text: Column) -> Column:
    """Array of canonical lines that are neither blank nor a copyright notice; null for null.

    Notices go while punctuation still tells them from sentences that begin alike.
    """
    plain = F.regexp_replace(F.lower(text), NOTICES, "")
    plain = F.regexp_replace(plain, r"[^\p{L}\p{N}\n]+", " ")
    for a, b in SPELLINGS:
        plain = F.replace(plain, F.lit(a), F.lit(b))
    lines = F.transform(F.split(plain, "\n"), lambda x: F.trim(x))
    return F.filter(lines, lambda x: (x != "") & (x != "all rights reserved"))


def digest_of(lines: Column) -> Column:
    """Digest of the lines as one; spellings of two words may have stood across a line's end."""
    text = F.array_join(lines, " ")
    for a, b in SPELLINGS:
        if " " in a:
            text = F.replace(text, F.lit(a), F.lit(b))
    return F.md5(text)


def known_licences(spark: SparkSession, folder: str | None = None) -> DataFrame:
    """(license_id, text) of the built-in list and, if given, of the files of a folder, named by licence.

    The folder (on any file system Spark reads) adds long public texts, such as those of
    the GPL, LGPL, MPL or Creative Commons, without a copy of them here.
    """
    known = spark.createDataFrame(KNOWN, "license_id string, text string")
    if folder:
        files = spark.read.text(folder, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("license_id"), F.col("value").alias("text"))
        known = known.union(files)
    return known


def scan(docs: DataFrame, licences: DataFrame) -> DataFrame:
    """(doc_id, digest, license_id, notices) for each row of `docs` (doc_id, text).

    license_id: the licence whose canonical text is the document's entire text, else
    null; the least if licences share a text.  notices: licences found in a line of the
    document, ascending, joined by commas; empty if none.  A null text, and one with
    nothing but copyright notices, matches nothing; the first has a null digest.  Rows
    may repeat, each has its result; texts may have any length; an empty table gives no
    rows.  Other columns are not read, whatever their names.  `licences` (license_id,
    text) may hold null texts, which match nothing.
    """
    listed = licences.select("license_id", canonical_lines(F.col("text")).alias("lines")).where(F.size("lines") > 0)
    known = listed.groupBy(digest_of(F.col("lines")).alias("known")).agg(F.min("license_id").alias("name"))
    size = licences.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    if size <= BROADCAST_BYTES:
        known = F.broadcast(known)
    # a row's units come from one task, so the number binds them whatever task computes them again
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", canonical_lines(F.col("text")).alias("lines"))
    # named before the units come out: beside them it would be made of the whole text for each of its lines
    rows = rows.withColumn("digest", digest_of(F.col("lines")))
    whole = F.array(F.struct(F.lit(True).alias("entire"), F.col("digest").alias("unit")))
    each = F.transform(F.array_distinct("lines"), lambda x: F.struct(F.lit(False).alias("entire"), F.md5(x).alias("unit")))
    # the entire text is a unit of each row; without lines it matches nothing
    units = F.when(F.size("lines") > 0, F.concat(whole, each)).otherwise(F.array(F.struct(F.lit(True).alias("entire"), F.lit("").alias("unit"))))
    found = rows.select("row", "doc_id", "digest", F.inline(units)).join(known, F.col("unit") == known.known, "left")
    return (
        found.groupBy("row", "doc_id", "digest")
        .agg(
            F.min(F.when(F.col("entire"), F.col("name"))).alias("license_id"),
            F.array_join(F.array_sort(F.collect_set(F.when(~F.col("entire"), F.col("name")))), ",").alias("notices"),
        )
        .drop("row")
    )


def _sql_lines(text: str) -> str:
    plain = f"regexp_replace(x, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')"
    for a, b in SPELLINGS:
        plain = f"replace({plain}, '{a}', '{b}')"
    kept = f"list_filter(string_split(lower({text}), chr(10)), lambda x: NOT regexp_matches(x, '{NOTICE}') OR regexp_matches(x, '{TERMS}'))"
    return f"list_filter(list_transform({kept}, lambda x: trim({plain})), lambda x: x <> '' AND x <> 'all rights reserved')"


def _sql_digest(lines: str) -> str:
    text = f"array_to_string({lines}, ' ')"
    for a, b in SPELLINGS:
        text = f"replace({text}, '{a}', '{b}')" if " " in a else text
    return f"md5({text})"


_VALUES = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in KNOWN)
ORACLE = f"""
WITH k AS (SELECT license_id, {_sql_lines("text")} AS ls FROM (VALUES {_VALUES}) AS v(license_id, text)),
kd AS (SELECT {_sql_digest("ls")} AS known, min(license_id) AS name FROM k WHERE len(ls) > 0 GROUP BY 1),
d AS (SELECT doc_id, {_sql_lines("text")} AS ls FROM documents),
w AS (SELECT doc_id, {_sql_digest("ls")} AS digest, len(ls) AS n FROM d),
u AS (SELECT doc_id, md5(x) AS digest FROM (SELECT doc_id, unnest(list_distinct(ls)) AS x FROM d)),
n AS (SELECT doc_id, string_agg(DISTINCT name, ',' ORDER BY name) AS notices FROM u JOIN kd ON digest = known GROUP BY doc_id)
SELECT w.doc_id, w.digest, kd.name AS license_id, coalesce(n.notices, '') AS notices
FROM w LEFT JOIN kd ON w.digest = kd.known AND w.n > 0 LEFT JOIN n ON n.doc_id = w.doc_id
"""
