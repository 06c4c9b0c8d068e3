"""Licence scans (operator 9): canonical digest lookup.

A text is put into a canonical form (A-Z lower-cased, copyright lines dropped,
equivalent spellings unified, punctuation and white space to one space), hashed
whole, and hash-joined to the digests of known licences. The units looked up are
each whole document and each of its whole lines, so a notice that stands on a
line of its own is found too. Nothing is matched by prefix or by parts.

The known licences are the notices below and the whole texts in ``license_texts``,
each as published and with every paragraph on one line, with and without its title and
what follows its terms.

Defined results: null or empty texts, or texts of nothing but copyright lines and
punctuation, match nothing; a licence named by several lines is listed once;
repeated rows give a row each; an empty table gives an empty result.
"""

from __future__ import annotations

import pkgutil
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.tables import write_once

# Notices and short licence texts as published.
KNOWN = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN
AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.""",
}
# Spellings that licence matching guidelines treat as the same word.
EQUIVALENT = [
    ("licence", "license"), ("sub-license", "sublicense"), ("non-commercial", "noncommercial"),
    ("organisation", "organization"), ("favour", "favor"), ("fulfil ", "fulfill "), ("per cent", "percent"),
    ("http://", "https://"),
]
# The whole texts in ``license_texts``; two wordings of one licence.
TEXTS = ("Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSD-3-Clause-UC", "CC0-1.0", "GPL-2.0", "GPL-3.0", "ISC",
         "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0")
SAME = {"BSD-3-Clause-UC": "BSD-3-Clause"}
# A copyright statement: the word with a symbol, year or holder behind it. Words of prose
# behind it (a line of a wrapped text may begin with "copyright notice and") and items "(c)"
# of a list are no statement.
COPYRIGHT_LINE = (
    "(?md)^[^a-z0-9\\n]*(?:copyright(?![a-z-])(?![ \\t]*[.,;)]|[ \\t]+(?:notices?|holders?|owners?|ownership|laws?|licen[cs]es?"
    "|interests?|and|or|in|is|on|of|to|for|that|which|disclaimers?|statements?|doctrines?|treat(?:y|ies)|protection"
    "|permission|patents?|line|terms?|the[ \\t]+(?:software|library|program))(?![a-z]))"
    "|\\(c\\)[^a-z0-9\\n]*(?:copyright|[0-9]{4}|year)|©|all rights reserved)[^\\n]*$")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def canonical(text: Column) -> Column:
    """The canonical form; an empty string where nothing is left."""
    t = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    t = F.regexp_replace(t, COPYRIGHT_LINE, "")
    for old, new in EQUIVALENT:
        t = F.replace(t, F.lit(old), F.lit(new))
    return F.trim(F.regexp_replace(t, "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", " "))


def unwrapped(text: str) -> str:
    """``text`` with every paragraph on one line."""
    return "\n\n".join(" ".join(p.split()) for p in re.split(r"\n[ \t]*\n", text.strip()))


def variants(text: str) -> list[str]:
    """A text as published and unwrapped, with and without a title above its copyright
    statement and what follows its terms."""
    out = {text}
    end = re.search(r"END OF TERMS AND CONDITIONS", text)
    if end:
        out.add(text[:end.end()])
    title = re.match(r"(?:MIT|ISC|BSD [23]-Clause) License\n", text)
    if title:
        out.add(text[title.end():])
    return sorted(out | {unwrapped(t) for t in out})


def license_text(name: str) -> str:
    """One of TEXTS, as published."""
    return pkgutil.get_data(__package__, f"license_texts/{name}.txt").decode()


def known_licenses(spark: SparkSession, texts: dict[str, str] | None = None) -> DataFrame:
    """(license_id, digest) of known texts; a fixed list of a few rows."""
    rows = sorted((texts or KNOWN).items())
    if texts is None:
        rows += [(SAME.get(name, name), t) for name in TEXTS for t in variants(license_text(name))]
    rows = spark.createDataFrame(rows, "license_id string, text string")
    return rows.select("license_id", F.sha2(canonical(F.col("text")), 256).alias("digest"))


def license_scan(docs: DataFrame, known: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, digest (of the whole text), license_id (whose whole text it is, or
    null), n_license_lines, line_licenses (distinct, sorted, comma-joined).

    Lines are exploded with a hash of their text, joined on the digest and counted;
    only matched lines are shuffled, never a text. ``known`` carries no hint: Spark
    broadcasts it while it is below its threshold and shuffles beyond it.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    one = known.groupBy("digest").agg(F.min("license_id").alias("license_id"))
    lines = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(body).alias("key"),
                        F.posexplode(F.split(body, "\n")).alias("line", "unit"))
    lines = lines.withColumn("unit", canonical(F.col("unit"))).where(F.col("unit") != "")
    matched = (lines.withColumn("digest", F.sha2("unit", 256)).join(one, "digest")
               .groupBy("doc_id", "key").agg(
                   F.countDistinct("line").alias("n_license_lines"),
                   F.concat_ws(",", F.array_sort(F.collect_set("license_id"))).alias("line_licenses")))
    matched = write_once(matched, "license-lines")
    whole = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(body).alias("key"),
                        F.sha2(canonical(F.col(text)), 256).alias("digest"))
    out = whole.join(one, "digest", "left").join(
        matched, whole["doc_id"].eqNullSafe(matched["doc_id"]) & (whole["key"] == matched["key"]), "left")
    return out.select(whole["doc_id"], "digest", "license_id",
                      F.coalesce("n_license_lines", F.lit(0).cast("long")).alias("n_license_lines"),
                      F.coalesce("line_licenses", F.lit("")).alias("line_licenses"))
