"""Licences found by the digest of their canonical text."""

from __future__ import annotations

import re
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage
from .common import text_or_empty

# Spellings that count as equal, as pattern and common form.
SPELLINGS = (
    ("licenc", "licens"),
    ("acknowledgement", "acknowledgment"),
    ("authoris", "authoriz"),
    ("organis", "organiz"),
    ("recognis", "recogniz"),
    ("utilis", "utiliz"),
    ("favour", "favor"),
    ("non commercial", "noncommercial"),
    ("sub licens", "sublicens"),
    ("copyright owner", "copyright holder"),
    ("http ", "https "),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# A line that states who holds the rights by a mark, a year or a name, whatever marks it starts with.
# "copyright notice", "COPYRIGHT HOLDERS" and list items (c) at the start of a wrapped line are text.
COPYRIGHT = (
    r"(?:^|\n)[^A-Za-z0-9\n©]*(?:(?i:copyright)[^A-Za-z\n]*(?:[cC]\)|[0-9]{4}|[<\[{©])"
    r"|Copyright (?:by )?(?!Notice|Holder|Owner|Law|Licen|Disclaimer|Act|Treat|Statement|And |Or )[A-Z]"
    r"|\([cC]\)[^A-Za-z\n]*[0-9]{4}|©)[^\n]*"
)
RESERVED = r"all rights reserved"
MARKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F\x{00A0}-\x{00BF}\x{2000}-\x{206F}]+"

# Licence texts and notices as their publishers word them.
_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
    "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
    "to permit persons to whom the Software is furnished to do so"
)
_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO '
    "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
    "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, "
    "TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL '
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
    "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN "
    "AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
    "PERFORMANCE OF THIS SOFTWARE."
)
TEXTS = (
    ("MIT", f"MIT License\n\nCopyright (c) <year> <holder>\n\n{_MIT_GRANT}, subject to the following conditions:\n\n"
     "The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
     f"the Software.\n\n{_AS_IS}"),
    ("MIT-0", f"MIT No Attribution\n\nCopyright <year> <holder>\n\n{_MIT_GRANT}.\n\n{_AS_IS}"),
    ("ISC", f"ISC License\n\nCopyright (c) <year> <holder>\n\n{_ISC_GRANT}, provided that the above copyright notice and "
     f"this permission notice appear in all copies.\n\n{_ISC_AS_IS}"),
    ("0BSD", f"BSD Zero Clause License\n\nCopyright (c) <year> <holder>\n\n{_ISC_GRANT}.\n\n{_ISC_AS_IS}"),
)
NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
# Identifiers whose tag lines and "Licensed under ..." lines follow one rule.
IDENTIFIERS = (
    "MIT", "MIT-0", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-2.0", "GPL-2.0-only",
    "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-2.0",
    "Unlicense", "Zlib", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC-BY-ND-4.0", "CC-BY-NC-SA-4.0",
)


# Names that stand above the short texts.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "Expat License"),
    "MIT-0": ("MIT No Attribution", "MIT No Attribution License"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The 2-Clause BSD License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The 3-Clause BSD License", "New BSD License", "Modified BSD License"),
    "Zlib": ("zlib License", "The zlib License"),
}
# Whole texts as their publishers word them, a file each; a second wording has a further suffix.
FOLDER = Path(__file__).with_name("license_texts")
END = "END OF TERMS AND CONDITIONS"


def whole_texts() -> list[tuple[str, str]]:
    """(licence, text), with and without the title of a short text and the appendix of a long one."""
    files = [(p.name.removesuffix(".txt").removesuffix(".spdx"), p.read_text(encoding="utf-8")) for p in sorted(FOLDER.glob("*.txt"))]
    rows = [*TEXTS, *files]
    for name, text in [*rows]:
        if name in TITLES:
            body = text.split("\n", 1)[1]
            rows += [(name, body), *((name, f"{x}\n{body}") for x in TITLES[name])]
        if END in text:
            terms = text.split(END)[0]
            rows += [(name, terms), (name, terms + END)]
    return rows


def known_texts() -> list[tuple[str, str]]:
    """(licence, text) of the built-in licences."""
    rows = [*whole_texts(), *NOTICES]
    for name in IDENTIFIERS:
        rows += [(name, f"SPDX-License-Identifier: {name}"), (name, f"Licensed under {name}.")]
    return rows


def canonical(text: Column) -> Column:
    """Words in one case and spelling, without punctuation and without copyright lines."""
    t = F.regexp_replace(text, COPYRIGHT, "")
    t = F.translate(t, _UPPER, _LOWER)
    t = F.regexp_replace(t, MARKS, " ")
    t = F.regexp_replace(t, RESERVED, "")
    t = reduce(lambda a, s: F.replace(a, F.lit(s[0]), F.lit(s[1])), SPELLINGS, t)
    return F.trim(F.regexp_replace(t, " +", " "))


def known_forms(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """(license, form): canonical known texts, a few hundred at most."""
    rows = known_texts() if known is None else known
    return spark.createDataFrame(rows, "license string, text string").select("license", canonical(F.col("text")).alias("form"))


def known_digests(forms: DataFrame) -> DataFrame:
    """(digest, license): one row per canonical text.

    A digest of two licences takes the name that sorts first.
    """
    return forms.where("form != ''").groupBy(F.sha2("form", 256).alias("digest")).agg(F.min("license").alias("license"))


def line_marks(forms: list[str]) -> str:
    """A pattern that every line with one of the canonical forms holds before it is folded.

    Each form gives "licen" or its longest word that no common spelling has changed.
    """
    changed = [x for _, form in SPELLINGS for x in form.split()]
    marks = set()
    for form in forms:
        words = [w for w in form.split() if not any(x in w for x in changed)]
        if "licens" in form:
            marks.add("licen")
        elif form:
            marks.add(max(words, key=lambda w: (len(w), w), default=""))
    if "" in marks:
        return ""
    return "(?i)" + "|".join(re.escape(x) for x in sorted(marks)) if marks else "(?!)"


def scan_licenses(docs: DataFrame, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """doc_id, digest, license, n_license_lines and line_licenses, one row per row of `docs`.

    `license` names the licence that the whole text is. A text that only carries a
    notice is found by the digests of its lines: their number and the licences named.
    Null texts are empty; texts without words match nothing. Equal rows get equal
    results. The known digests are a fixed list, so broadcasting them is bounded;
    all-text and line digests are joined to them by hash.
    """
    spark = docs.sparkSession
    forms = known_forms(spark, known)
    known_rows = F.broadcast(known_digests(forms))
    marks = line_marks([r.form for r in forms.select("form").collect()])
    text = text_or_empty()
    rows = docs.select(
        "doc_id", F.xxhash64(text).alias("text_hash"), F.sha2(canonical(text), 256).alias("digest"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(marks)).alias("lines"),
    )
    whole = stage(rows.join(known_rows, "digest", "left"), "digests")
    lines = (
        whole.where(F.size("lines") > 0)
        .select("doc_id", "text_hash", "lines").distinct()
        .select("doc_id", "text_hash", F.explode("lines").alias("line"))
        .select("doc_id", "text_hash", F.sha2(canonical(F.col("line")), 256).alias("digest"))
        .join(known_rows, "digest")
        .groupBy("doc_id", "text_hash")
        .agg(
            F.count("*").alias("n_license_lines"),
            F.array_join(F.array_sort(F.collect_set("license")), ",").alias("line_licenses"),
        )
        .select(F.col("doc_id").alias("l_id"), F.col("text_hash").alias("l_hash"), "n_license_lines", "line_licenses")
    )
    return whole.join(
        lines, F.col("doc_id").eqNullSafe(F.col("l_id")) & (F.col("text_hash") == F.col("l_hash")), "left"
    ).select(
        "doc_id", "digest", "license",
        F.coalesce("n_license_lines", F.lit(0)).cast("long").alias("n_license_lines"),
        F.coalesce("line_licenses", F.lit("")).alias("line_licenses"),
    )
