"""Licence scans by canonical digests of entire texts.

A text is brought to a canonical form: A-Z in lower case, lines of copyright
holders dropped, spellings unified, everything but letters and digits turned into
single spaces. Two texts with the same SHA-256 of that form carry the same licence.
Entire documents, their paragraphs (runs of lines between empty lines) and their
lines are looked up among the digests of the known licences. All of it is built-in
expressions in one narrow stage; only the known digests are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Fixed values: (spelling, the one it is replaced by), whole words, in this order.
SPELLINGS = (
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("sublicence", "sublicense"),
    ("sub license", "sublicense"),
    ("organisation", "organization"),
    ("authorised", "authorized"),
    ("acknowledgement", "acknowledgment"),
    ("per cent", "percent"),
    ("copyright owner", "copyright holder"),
    ("non infringement", "noninfringement"),
    ("merchantibility", "merchantability"),
    ("gnu gpl", "gnu general public license"),
    ("v2", "version 2"),
    ("v3", "version 3"),
)

#: Licence notices by identifier.
NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0-only", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0-only", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0 Universal."),
)

#: Digests that are broadcast; a larger table of known licences is joined by a shuffle.
MOST_BROADCAST = 200_000
#: Marking words by which texts are sorted out before their digests are made; with more words all digests are.
MOST_WORDS = 64
_HOLDER = r"^ *(copyright|\(c\)|©|all rights reserved)[^\n]*$"


def canonical(text: Column) -> Column:
    """Canonical form of a text; null counts as empty."""
    plain = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    # only texts that mention a holder pay for the line pattern
    held = F.regexp_replace(plain, f"(?m){_HOLDER}", "")
    plain = F.when(F.regexp_like(plain, F.lit(r"copyright|\(c\)|©|all rights")), held).otherwise(plain)
    # letters beyond ASCII belong to words as they are
    form = F.regexp_replace(plain, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")
    form = F.concat(F.lit(" "), F.trim(form), F.lit(" "))
    for old, new in SPELLINGS:
        form = F.replace(form, F.lit(f" {old} "), F.lit(f" {new} "))
    return F.trim(form)


def digest(text: Column) -> Column:
    """SHA-256 of the canonical form."""
    return F.sha2(canonical(text), 256)


def notices(spark: SparkSession) -> DataFrame:
    """license_id, text of the notices above."""
    return spark.createDataFrame(NOTICES, "license_id string, text string")


def known_digests(known: DataFrame, id_col: str = "license_id", text_col: str = "text") -> DataFrame:
    """digest, license_id: one row per distinct canonical text; of several identifiers, the smallest."""
    form = canonical(F.col(f"`{text_col}`"))
    rows = known.filter(F.col(f"`{id_col}`").isNotNull() & (form != "")).select(F.sha2(form, 256).alias("digest"), F.col(f"`{id_col}`").alias("license_id"))
    return rows.groupBy("digest").agg(F.min("license_id").alias("license_id"))


def marking_words(known: DataFrame, text_col: str = "text") -> list[str] | None:
    """Words of which a text has at least one if it is a known licence: of each, the longest that no spelling changes.

    None if a licence has no such word, or if there are too many words to look for.
    """
    forms = known.select(canonical(F.col(f"`{text_col}`")).alias("form")).filter("form <> ''").distinct().limit(MOST_WORDS + 1).collect()
    changed = {w for pair in SPELLINGS for text in pair for w in text.split()}
    words = {max((w for w in r.form.split() if w.isascii() and w not in changed), key=len, default="") for r in forms}
    return None if "" in words or len(forms) > MOST_WORDS else sorted(words)


def _marked(text: Column, words: list[str] | None) -> Column:
    if words is None:
        return F.lit(True)
    low, found = F.lower(text), F.lit(False)
    for word in words:
        found = found | low.contains(word)
    return found


def scan_licenses(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: bool = True) -> DataFrame:
    """doc_id, scope, part, license_id, digest: one row for every text unit that is a known licence.

    ``scope`` is document, paragraph or line, ``part`` its number from 0 within the
    document. A document of one paragraph, or a paragraph of one line, is reported
    as document or paragraph, and again as its parts. With ``parts`` false only
    entire documents are looked up. Empty and null texts match nothing; rows
    without doc_id and repeated rows are scanned like others. Other columns are
    not read.
    """
    words = marking_words(known)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("_text")).filter("_text is not null and _text <> ''")
    rows = rows.filter(_marked(F.col("_text"), words))
    units = F.array(F.struct(F.lit("document").alias("scope"), F.lit(0).alias("part"), F.col("_text").alias("text")))
    if parts:
        units = F.concat(units, _units("paragraph", r"\n[ \t\r]*\n\s*"), _units("line", r"\n"))
    units = rows.select("doc_id", F.explode(units).alias("u")).filter(_marked(F.col("u.text"), words)).select("doc_id", "u.scope", "u.part", digest(F.col("u.text")).alias("digest"))
    table = known_digests(known)
    if table.count() <= MOST_BROADCAST:
        table = F.broadcast(table)
    return units.join(table, "digest").select("doc_id", "scope", "part", "license_id", "digest")


def _units(scope: str, separator: str) -> Column:
    texts = F.split("_text", separator)
    return F.transform(texts, lambda t, i: F.struct(F.lit(scope).alias("scope"), i.alias("part"), t.alias("text")))
