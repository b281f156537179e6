"""Licence scan by canonical digests (DataFrame functions only).

A text is normalised (case, punctuation, copyright statements, equivalent spellings, white
space) and its digest looked up by a hash join among the digests of known licences:
the whole text once, and each of its paragraphs and lines for notices. The known table
holds one row a licence text and is broadcast; it is a fixed list, not data. Licences
known in full are those of KNOWN and FULL; the Creative Commons BY family is known by
its notices only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import row_keys, stored, table

# Equivalent spellings (from, to), as whole words.
SPELLINGS = [
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"), ("artefact", "artifact"), ("behaviour", "behavior"), ("cancelled", "canceled"),
    ("favour", "favor"), ("fulfil", "fulfill"), ("initialise", "initialize"), ("judgement", "judgment"),
    ("labelling", "labeling"), ("merchantability", "merchantability"), ("noncommercial", "non commercial"),
    ("organisation", "organization"), ("owner", "holder"), ("per cent", "percent"), ("programme", "program"),
    ("recognised", "recognized"), ("sub licence", "sublicense"), ("sub license", "sublicense"), ("whilst", "while"),
    ("wilful", "willful"), ("v2 0", "version 2 0"), ("http", "https"),
]
# Public licence texts and their customary notices.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

"""
BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

"""
APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
UNLICENSE_END = "\n\nFor more information, please refer to <https://unlicense.org>"
MPL_NOTICE = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."
MPL_END = " If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
GPL_NOTICE = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""
KNOWN = [
    ("MIT", MIT), ("MIT", "The MIT License (MIT)\n" + MIT), ("MIT", "MIT License\n" + MIT), ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", ISC), ("ISC", "ISC License\n" + ISC), ("ISC", "SPDX-License-Identifier: ISC"),
    ("BSD-2-Clause", BSD_2 + BSD_END), ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"), ("BSD-2-Clause", "BSD 2-Clause License\n" + BSD_2 + BSD_END),
    ("BSD-3-Clause", BSD_2 + BSD_3 + BSD_END), ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"), ("BSD-3-Clause", "BSD 3-Clause License\n" + BSD_2 + BSD_3 + BSD_END),
    ("Apache-2.0", APACHE_NOTICE), ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0", "Licensed under the GNU General Public License, version 3."), ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-NC-4.0", "This work is licensed under CC BY-NC 4.0."), ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("Unlicense", UNLICENSE + UNLICENSE_END), ("Unlicense", UNLICENSE), ("Unlicense", "SPDX-License-Identifier: Unlicense"),
    ("MPL-2.0", MPL_NOTICE), ("MPL-2.0", MPL_NOTICE + MPL_END), ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("Apache-2.0", APACHE_NOTICE.split("\n\n")[0]), ("GPL-3.0", GPL_NOTICE),
]
# Digests of the canonical form of whole licences, as published.
FULL = [
    ("Apache-2.0", "94ab2db69513be8875470e3a4d39d5a437c91da93f172411d69d7552938f539a"),
    ("CC0-1.0", "6e4a79b7eaf2cdc3879a899ef330c98026c9d697ee87d41a28ac5159e8e53348"),
    ("GFDL-1.2", "5379e6f33e826ba185b23fd11a414555c2161fda481478babd1e73a3ae098a71"),
    ("GFDL-1.3", "93d6108daecdddc5f284cf8f2512fb0d72f6e9ee12381feb9704ba194b00c3e6"),
    ("GPL-1.0", "ec8a6b7d70e9f225b63d3962ed5b4721373f5535d7b967a06722b0d621f6892a"),
    ("GPL-2.0", "331b500eb3c5ee796906547305df82fff4a35b3aa03c1d3ea84d32078292b2e6"),
    ("GPL-3.0", "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "e59e85b00d6cbe503aa5e15f4a860598dddc4b3457dede33d10dd344396ee3fc"),
    ("MPL-2.0", "3dacd2c104719e7227969cbdcc7d581518827199e830b9379627eec0a32f8ab7"),
    ("Artistic-1.0-Perl", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
]
#: A line that begins with OWNER and holds a SIGN of a statement is one of copyright; REST may follow in the same line.
OWNER, SIGN, REST = r"[^a-z0-9©\n]*(?:copyright|©|\(c\))", r"(?:\(c\)|©|[0-9]{4}|all rights reserved)", r"\b(?:licensed|released|permission|this|spdx)\b"
SIGNS = r"[^0-9a-zà-ɏ\n]+"


def canonical(text: Column) -> Column:
    """A text in canonical words, a blank between them; its lines stay, those of copyright and without words empty."""
    low = F.lower(F.coalesce(text.cast("string"), F.lit("")))
    owned = low.contains("copyright") | low.contains("©") | low.contains("(c)")
    words = F.when(owned, F.regexp_replace(low, rf"(?md)^(?={OWNER})(?=[^\n]*{SIGN}){OWNER}[^\n]*?({REST}[^\n]*)?$", "$1")).otherwise(low)
    words = F.concat(F.lit(" "), F.replace(F.regexp_replace(words, SIGNS, "  "), F.lit("\n"), F.lit(" \n ")), F.lit(" "))
    for a, b in SPELLINGS:  # every word has a blank of its own on either side
        if a != b:
            words = F.replace(words, F.lit(f" {a} ".replace(" ", "  ")[1:-1]), F.lit(f" {b} ".replace(" ", "  ")[1:-1]))
    return F.btrim(F.regexp_replace(F.replace(words, F.lit("  "), F.lit(" ")), " *\n *", "\n"), F.lit(" \n"))


def lines_of(words: Column) -> Column:
    return F.array_remove(F.split(words, "\n"), "")


def paragraphs_of(words: Column) -> Column:
    return F.array_remove(F.transform(F.split(words, "\n\n+"), lambda p: F.replace(p, F.lit("\n"), F.lit(" "))), "")


def digest(words: Column) -> Column:
    return F.sha2(words, 256)


def whole(words: Column) -> Column:
    return digest(F.array_join(lines_of(words), " "))


def known_digests(spark: SparkSession) -> DataFrame:
    """(license, digest) of the fixed lists."""
    rows = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(n).alias("license"), F.lit(t).alias("text")) for n, t in KNOWN])))
    rows = rows.select("license", whole(canonical(F.col("text"))).alias("digest"))
    full = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(n).alias("license"), F.lit(d).alias("digest")) for n, d in FULL])))
    return rows.unionByName(full).distinct()


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a document: doc_id, digest (of the canonical text), license (of the whole text, else null), notices (licences of its paragraphs and lines, sorted and joined by commas, '' if none).

    Null and empty texts, and those of copyright lines alone, have the digest of ''
    and no licence; texts of any length are read whole; repeated rows and texts that tie are all
    returned; other columns, whatever their names, aren't read; an empty table gives no rows.
    """
    table_ = stored(known_digests(docs.sparkSession))
    known = F.broadcast(table_)
    fixed = F.array(*[F.lit(d) for d in sorted({r["digest"] for r in table_.collect()})])
    rows = docs.select(F.col(id_col).alias("doc_id"), canonical(F.col(text_col)).alias("words"))
    parts = F.concat(F.transform(lines_of(F.col("words")), digest), F.transform(paragraphs_of(F.col("words")), digest))
    rows = rows.select("doc_id", whole(F.col("words")).alias("digest"), F.array_intersect(parts, fixed).alias("hits"))
    keyed = stored(rows.select("doc_id", "digest", "hits", *row_keys("doc_id", "digest", "hits")))  # texts are normalised once
    hits = keyed.select("k1", "k2", F.explode("hits").alias("line")).join(known.withColumnRenamed("digest", "line"), "line")
    notices = hits.groupBy("k1", "k2").agg(F.array_join(F.array_sort(F.collect_set("license")), ",").alias("notices"))
    out = keyed.drop("hits").join(notices, ["k1", "k2"], "left").join(known, "digest", "left")
    return out.select("doc_id", "digest", "license", F.coalesce("notices", F.lit("")).alias("notices"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`scan` of all of documents, one row a row: doc_id, digest, license, notices."""
    return scan(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    def canon(x: str) -> str:
        low = f"lower({x})"
        owned = f"regexp_matches({low}, '^{OWNER}') AND regexp_matches({low}, '{SIGN}')"
        bare = f"CASE WHEN {owned} THEN regexp_replace({low}, '^{OWNER}.*?({REST}.*)?$', '\\1') ELSE {low} END"
        words = f"(' ' || regexp_replace({bare}, '[^0-9a-z\\x{{00e0}}-\\x{{024f}}]+', '  ', 'g') || ' ')"
        for a, b in SPELLINGS:
            if a != b:
                words = "replace({}, '{}', '{}')".format(words, *(f" {w} ".replace(" ", "  ")[1:-1] for w in (a, b)))
        return f"trim(regexp_replace({words}, ' +', ' ', 'g'))"

    def words(text: str) -> str:
        return f"trim(array_to_string(list_transform(string_split(coalesce({text}, ''), chr(10)), lambda x: {canon('x')}), chr(10)), ' ' || chr(10))"

    lines = "list_filter(string_split({}, chr(10)), lambda y: y <> '')"
    paragraphs = "list_filter(list_transform(string_split_regex({}, '\n\n+'), lambda p: replace(p, chr(10), ' ')), lambda y: y <> '')"
    known = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in KNOWN)
    full = ", ".join(f"('{n}', '{d}')" for n, d in FULL)
    return f"""
WITH k AS (SELECT DISTINCT license, sha256(array_to_string({lines.format(words('t'))}, ' ')) AS digest FROM (VALUES {known}) v(license, t) UNION SELECT * FROM (VALUES {full}) f(license, digest)),
c AS (SELECT doc_id, row_number() OVER () AS r, {words('text')} AS w FROM documents),
d AS (SELECT doc_id, r, {lines.format('w')} AS ls, {paragraphs.format('w')} AS ps FROM c),
h AS (SELECT r, string_agg(DISTINCT license, ',' ORDER BY license) AS notices FROM (SELECT r, unnest(list_concat(ls, ps)) AS line FROM d) JOIN k ON sha256(line) = k.digest GROUP BY r)
SELECT d.doc_id, sha256(array_to_string(ls, ' ')) AS digest, k.license, coalesce(notices, '') AS notices
FROM d LEFT JOIN h USING (r) LEFT JOIN k ON k.digest = sha256(array_to_string(ls, ' '))
"""


ORACLE = _oracle()
