"""Licence scans: whole texts, brought to a canonical form, looked up by digest among known licences.

DataFrame functions only; the same steps in SQL are in CANONICAL_SQL, for any engine with RE2-like expressions.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The licences' own words, and words that are spelt in two ways.
KNOWN = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "notice-Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "notice-MIT": "Released under the MIT License.",
    "notice-GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "notice-CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
}
SPELLINGS = {"licence": "license", "licences": "licenses", "licenced": "licensed", "sub license": "sublicense", "non infringement": "noninfringement", "merchantibility": "merchantability", "acknowledgement": "acknowledgment", "authorise": "authorize", "authorised": "authorized", "organisation": "organization", "favour": "favor", "honour": "honor", "per cent": "percent", "copyright owner": "copyright holder", "copyright owners": "copyright holders", "https": "http"}
# End of fixed values.

#: Full texts by licence, besides KNOWN; the driver reads them.
TEXTS = {p.stem: p.read_text() for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}

# What license files have around and within a text, whatever its wrapping.
COMMENT = r"(?im)^[^\S\n]*(?:rem|dnl)(?=\s)"
STATEMENT = r"(?m)^[^\p{L}\p{N}\n]*?(?:(?:(?i:portions )?(?i:copyright)[^\S\n]*(?:(?i:\(c\)|by\b)|[©:<\[]|[0-9]{4})|(?:\([cC]\)|©)[^\S\n]*[0-9]{4}|Copyright (?!(?:Notice|Holder|Owner|License|Law|Act)s?\b)\p{Lu})[^\n]*|(?i:all rights reserved)[^\p{L}\p{N}\n]*)$"
TITLE = r"(?i)\A(?:[^\p{L}\p{N}]*(?:(?:the )?(?:mit|expat|isc|0bsd|zlib(?:/libpng)?|(?:new |revised |modified |simplified )?bsd|(?:bsd )?[023][- ]clause(?: bsd)?|bsd zero[- ]clause|zero[- ]clause bsd)(?: licen[sc]e)?(?:[^\S\n]*\([^)\n]{1,40}\))?)[^\p{L}\p{N}\n]*(?:\n|\z))+"
BULLET = r"(?m)^[^\p{L}\p{N}\n]*[0-9][.)][^\S\n]"

#: A line of a copyright statement, and lines that only name a licence's reservation or title.
NOTICE = r"(?m)^[^\S\n]*(?:copyright\b|\(c\)|©|all rights reserved\b|portions copyright\b)[^\n]*$"
PUNCTUATION = r"[^\p{L}\p{N}]+"


def canonical(text: Column) -> Column:
    """Lower case, without copyright lines, each run of other than letters and digits one space, one spelling of each word."""
    return _plain(F.regexp_replace(F.lower(text), NOTICE, " "))


def _plain(text: Column) -> Column:
    text = F.concat(F.lit(" "), F.trim(F.regexp_replace(text, PUNCTUATION, " ")), F.lit(" "))
    for word, other in SPELLINGS.items():
        text = F.replace(text, F.lit(f" {word} "), F.lit(f" {other} "))
    return F.trim(text)


def bare(text: Column) -> Column:
    """canonical() of a licence file: without comment marks, copyright statements and titles, but with every line of the
    body, wherever it is wrapped."""
    text = F.regexp_replace(text, COMMENT, " ")
    text = F.regexp_replace(F.regexp_replace(text, STATEMENT, ""), TITLE, "")
    return _plain(F.lower(text))


def canonical_sql(text: str) -> str:
    """canonical() as a DuckDB expression over the SQL expression `text`."""
    sql = f"regexp_replace(lower({text}), '{NOTICE}', ' ', 'g')"
    sql = f"' ' || trim(regexp_replace({sql}, '{PUNCTUATION}', ' ', 'g')) || ' '"
    for word, other in SPELLINGS.items():
        sql = f"replace({sql}, ' {word} ', ' {other} ')"
    return f"trim({sql})"


def known_digests(spark, licenses: dict[str, str] | None = None) -> DataFrame:
    """digest, license_id: of a given set of licences, KNOWN by default; of two with one text the first id stays."""
    rows = list((KNOWN if licenses is None else licenses).items())
    if licenses is None:
        rows += TEXTS.items()
    rows = spark.createDataFrame(rows, "license_id string, text string")
    forms = [canonical(F.col("text")), bare(F.col("text")), bare(F.regexp_replace("text", BULLET, " "))]
    found = rows.select("license_id", F.explode(F.array(*[F.sha2(x, 256) for x in forms])).alias("digest"))
    return found.groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan_licenses(docs: DataFrame, licenses: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, canonical_chars, digest, license_id (null if no known licence has that digest).

    licenses: (digest, license_id), known_digests() by default, a list of fixed length; other lists are joined as
    Spark's statistics say. A null text is empty; texts without a letter or digit match nothing; a licence followed by
    anything but copyright lines matches nothing; repeated rows each give a row, an empty table none; long texts are
    digested whole. A text that speaks of a licence or of permission and is not known as it stands is looked up in its
    bare() form too; canonical_chars and digest stay those of canonical(). Other columns are neither read nor returned.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    form = docs.select(F.col(id_col), canonical(text).alias("canonical"), F.when(text.rlike("(?i)licen|permi"), F.nullif(bare(text), F.lit(""))).alias("bare"))
    form = form.select(id_col, F.length("canonical").cast("long").alias("canonical_chars"), F.sha2("canonical", 256).alias("digest"), F.sha2("bare", 256).alias("bare"))
    form = form.withColumn("bare", F.coalesce("bare", "digest"))
    known = F.broadcast(known_digests(docs.sparkSession)) if licenses is None else licenses.select("digest", "license_id")
    form = form.join(known, "digest", "left").join(known.select(F.col("digest").alias("bare"), F.col("license_id").alias("bare_id")), "bare", "left")
    return form.select(id_col, "canonical_chars", "digest", F.when(F.col("canonical_chars") > 0, F.coalesce("license_id", "bare_id")).alias("license_id"))
