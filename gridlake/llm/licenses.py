"""Licence texts by canonical digest.

A text's canonical form has A-Z lower-cased, copyright lines removed, equivalent
spellings made one, and every run of punctuation and white space made one blank.
Its SHA-256 is joined by hash with the digests of known licence texts. The same
is done for each line of a text, which finds the one-line notices in documents.

Everything is a DataFrame expression. The table of known texts is given by the
caller or KNOWN below, so its size is known before it is broadcast; a larger
table than BROADCAST_ROWS is joined by shuffle instead.

Defined results: a null text has a null digest and no licence; an empty one, or
one of copyright lines only, has the digest of the empty text and no licence;
known texts with equal forms report the id that sorts first; rows are kept as
they are, repeated ones too. Column names to be added must be new.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 5000

#: Equivalent spellings, made equal in this order (fixed values).
SPELLINGS = [
    ("licence", "license"),
    ("sub-license", "sublicense"),
    ("organisation", "organization"),
    ("acknowledgement", "acknowledgment"),
    ("authorisation", "authorization"),
    ("favour", "favor"),
    ("whilst", "while"),
    ("non-commercial", "noncommercial"),
    ("copyright holder", "copyright owner"),
    ("https:", "http:"),
]

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

"""
_0BSD = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

"""
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

"""
_BSD3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

"""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""

#: Known public licence texts and one-line notices: (id, text) (fixed values).
KNOWN = [
    ("0BSD", _0BSD + _ISC_END),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-2-Clause", _BSD + _BSD_END),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", _BSD + _BSD3 + _BSD_END),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", _GPL),
    ("ISC", _ISC + _ISC_END),
    ("MIT", _MIT),
    ("MIT", "MIT License\n\n" + _MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "All rights reserved."),
    ("Zlib", _ZLIB),
]

#: Digests of whole public licence texts, too long to keep here (fixed values; a GPL text names no "or later").
FULL = [
    ("Apache-2.0", "ff7be961361eda3cd2a76927dd0d9482cf45defafde2045befedf77400d98100"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GPL-1.0-only", "88c0d32b6685976f91edcbb228c50498a7324b47880b82b90b4b86377ca82e38"),
    ("GPL-2.0-only", "5147a46525fc36b30edbb3469564d4930add19b5b86c56d8d58e084575fd474a"),
    ("GPL-3.0-only", "44ab9faa2710e701e5bf01d35505a460bcc74f29e108f844fcb015f4feafe4b5"),
    ("LGPL-2.0-only", "11e3c6b677207da4051366e158907dd6f7209ed89198cf2dcbadb81b40ad29b1"),
    ("LGPL-2.1-only", "0ef3b42e72472128abbdf18e99fa5bc9e149587020f3081179d818e4ad7abb3f"),
    ("LGPL-3.0-only", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "f77c59051c0127d677dcce7ba0d4733294974749a7b4155250912498d92767d6"),
    ("MPL-2.0", "95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9"),
]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_COPYRIGHT = r"\n[^a-z0-9\n]*(copyright[^a-z\n]|\(c\)|©)[^\n]*"
_BLANK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F\x{A0}\x{A9}\x{2010}-\x{2015}\x{2018}-\x{201F}]+"


def canonical(text: Column) -> Column:
    """The canonical form of a text."""
    out = F.regexp_replace(F.concat(F.lit("\n"), F.translate(text, _UPPER, _LOWER)), _COPYRIGHT, "\n")
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(out, _BLANK, " "))


def canonical_sql(text: str) -> str:
    """canonical() in DuckDB SQL."""
    out = f"regexp_replace(chr(10) || translate({text}, '{_UPPER}', '{_LOWER}'), '{_COPYRIGHT}', chr(10), 'g')"
    for a, b in SPELLINGS:
        out = f"replace({out}, '{a}', '{b}')"
    return f"trim(regexp_replace({out}, '{_BLANK}', ' ', 'g'), ' ')"


def known_digests(spark: SparkSession, known: DataFrame | None = None) -> DataFrame:
    """(digest, license_id): one row for each form; known has columns license_id and text."""
    own = known is None
    if own:
        known = spark.createDataFrame(KNOWN, "license_id string, text string")
    form = canonical(F.col("text"))
    table = known.where(form != "").select(F.sha2(form, 256).alias("digest"), "license_id")
    if own:
        table = table.union(spark.createDataFrame(FULL, "license_id string, digest string").select("digest", "license_id"))
    return table.groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan(df: DataFrame, known: DataFrame | None = None, text: str = "text") -> DataFrame:
    """df with digest, license_id (of the whole text, or null) and notices (licences of single lines, sorted, distinct)."""
    if taken := {"digest", "license_id", "notices"} & set(df.columns):
        raise ValueError(f"column names taken: {sorted(taken)}")
    table = known_digests(df.sparkSession, known)
    rows = table.limit(BROADCAST_ROWS + 1).collect()
    digest = F.sha2(canonical(F.col(text)), 256)
    if len(rows) <= BROADCAST_ROWS:
        pairs = [x for r in rows for x in (F.lit(r.digest), F.lit(r.license_id))]
        of_line = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
        line = F.transform(F.split(text, "\n"), lambda x: F.element_at(of_line, F.sha2(canonical(x), 256)))
        df = df.withColumn("digest", digest).withColumn("notices", F.coalesce(F.array_sort(F.array_distinct(F.filter(line, lambda x: x.isNotNull()))), F.array().cast("array<string>")))
        return df.join(F.broadcast(table), "digest", "left").select(*[c for c in df.columns if c != "notices"], "license_id", "notices")
    # many known texts: lines meet them by shuffle, as distinct digests of each row's own key, a digest of the whole row
    row = next(x for x in (f"_row{i}" for i in range(len(df.columns) + 1)) if x not in df.columns)
    keyed = df.withColumn("digest", digest).withColumn(row, F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])), 256))
    lines = keyed.select(row, F.explode(F.split(text, "\n")).alias("line")).select(row, F.sha2(canonical(F.col("line")), 256).alias("digest")).distinct()
    notices = lines.join(table, "digest").groupBy(row).agg(F.array_sort(F.collect_set("license_id")).alias("notices"))
    out = keyed.join(table, "digest", "left").join(notices, row, "left")
    return out.select(*df.columns, "digest", "license_id", F.coalesce("notices", F.array().cast("array<string>")).alias("notices"))


def oracle() -> str:
    """The query over documents in DuckDB SQL."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({quote(a)}, {quote(b)})" for a, b in KNOWN)
    return f"""
WITH known AS (SELECT sha256({canonical_sql("t")}) AS digest, min(license_id) AS license_id FROM (VALUES {rows}) k(license_id, t) WHERE {canonical_sql("t")} <> '' GROUP BY 1),
docs AS (SELECT row_number() OVER () AS r, doc_id, text, sha256({canonical_sql("text")}) AS digest FROM documents),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs),
noted AS (SELECT r, array_to_string(list_sort(list(DISTINCT license_id)), ',') AS notices FROM (SELECT r, sha256({canonical_sql("line")}) AS digest FROM lines) l JOIN known USING (digest) GROUP BY r)
SELECT doc_id, docs.digest AS digest, license_id, coalesce(notices, '') AS notices
FROM docs LEFT JOIN known ON docs.digest = known.digest LEFT JOIN noted ON docs.r = noted.r"""
