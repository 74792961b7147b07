"""Licence texts found by the digest of their canonical form.

The canonical form ignores case, punctuation, white space, copyright lines and equivalent
spellings. Entire texts, and every line as a text of its own, are looked up by digest in a
table of known licences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loomgraph.llm.common import broadcastable, saved

# Known texts. Copyright lines are left out, as the canonical form drops them.
KNOWN_TEXTS = (
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("0BSD", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
)

# Spellings that count as equal, as words of the canonical form.
EQUAL_SPELLINGS = (
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("copyright owner", "copyright holder"),
    ("favour", "favor"),
    ("fulfilment", "fulfillment"),
    ("initialise", "initialize"),
    ("labelled", "labeled"),
    ("licence", "license"),
    ("licenced", "licensed"),
    ("merchantability", "merchantability"),
    ("non commercial", "noncommercial"),
    ("non infringement", "noninfringement"),
    ("organisation", "organization"),
    ("recognised", "recognized"),
    ("sub licence", "sublicense"),
    ("sub license", "sublicense"),
    ("sublicence", "sublicense"),
    ("whilst", "while"),
    ("wilful", "willful"),
)

COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}\n]*(copyright\s|©|\(c\)|all rights reserved)[^\n]*$"
NOT_WORD = r"[^\p{L}\p{N}]+"


def canonical(text: Column) -> Column:
    """Words of a text in one case, one space apart, without copyright lines; null counts as empty."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, "")
    plain = F.trim(F.regexp_replace(plain, NOT_WORD, " "))
    replaced = plain
    for one, other in EQUAL_SPELLINGS:
        replaced = F.regexp_replace(replaced, rf"\b{one}\b", other)
    # Few texts hold any of the spellings; the others take one look.
    return F.when(plain.rlike(rf"\b({'|'.join(a for a, _ in EQUAL_SPELLINGS)})\b"), replaced).otherwise(plain)


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_licences(spark: SparkSession, texts=KNOWN_TEXTS) -> DataFrame:
    """(digest, licence) of known texts, one row per digest."""
    rows = spark.createDataFrame(list(texts), "licence string, text string")
    return rows.select(digest(F.col("text")).alias("known"), "licence").groupBy("known").agg(F.min("licence").alias("licence"))


def licence_lookup(docs: DataFrame, known: DataFrame, broadcast_limit: int = 1_000_000) -> DataFrame:
    """One row per row of ``docs``: doc_id, digest, licence, n_notices, notices.

    ``licence`` is that of the entire text, null if unknown; ``notices`` names, comma-joined
    in order, the licences of single lines that are a known text, ``n_notices`` counts
    those lines. ``docs`` needs doc_id and text; other columns are ignored. A null text
    counts as an empty one, whose digest is that of no words and no licence's. Rows that
    repeat an id are told apart by their text. The table of known digests is broadcast
    while it is small; a digest's many copies then meet no shuffle.
    """
    known = broadcastable(saved(known), broadcast_limit)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("text_key"))
    lines = rows.select("doc_id", "text_key", F.posexplode(F.split("text", "\n")).alias("line", "content"))
    found = lines.where(F.length("content") > 0).join(known, digest(F.col("content")) == known["known"])
    found = found.groupBy("doc_id", "text_key").agg(F.countDistinct("line").alias("n"), F.array_join(F.sort_array(F.collect_set("licence")), ",").alias("names"))
    found = found.select(F.col("doc_id").alias("found_id"), F.col("text_key").alias("found_key"), "n", "names")
    whole = rows.select("doc_id", "text_key", digest(F.col("text")).alias("digest"))
    whole = whole.join(known, whole["digest"] == known["known"], "left")
    return whole.join(found, whole["doc_id"].eqNullSafe(found["found_id"]) & (whole["text_key"] == found["found_key"]), "left").select(
        "doc_id", "digest", "licence", F.coalesce("n", F.lit(0)).alias("n_notices"), F.coalesce("names", F.lit("")).alias("notices"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def lookup_sql(texts=KNOWN_TEXTS) -> str:
    """The same query as SQL over documents."""
    def canon(column: str) -> str:
        plain = f"regexp_replace(lower(coalesce({column}, '')), {_quoted(COPYRIGHT_LINE)}, '', 'g')"
        plain = f"trim(regexp_replace({plain}, {_quoted(NOT_WORD)}, ' ', 'g'))"
        for one, other in EQUAL_SPELLINGS:
            plain = f"regexp_replace({plain}, '\\b{one}\\b', '{other}', 'g')"
        return f"sha256({plain})"

    values = ", ".join(f"({_quoted(name)}, {_quoted(text)})" for name, text in texts)
    return f"""
        with known as (select {canon('t')} known, min(n) licence from (values {values}) v(n, t) group by 1),
        d as (select row_number() over () r, doc_id, coalesce(text, '') t from documents),
        l as (select r, licence from (select r, unnest(string_split(t, chr(10))) line from d)
              join known on known = {canon('line')} where line <> ''),
        f as (select r, count(*) n, string_agg(distinct licence, ',' order by licence) names from l group by r)
        select doc_id, {canon('t')} digest, licence, coalesce(n, 0) n_notices, coalesce(names, '') notices
        from d left join known on known = {canon('t')} left join f using (r)
    """
