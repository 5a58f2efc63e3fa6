"""Licence scans by canonical digest, in SQL functions only.

A text is brought to a canonical form (letter case, punctuation, copyright lines and
spellings that count as the same), and its SHA-256 is joined to the digests of known ones.

* Notices (one line each) are known by the whole document, one of its paragraphs (between
  blank lines) or one of its lines.
* Licence texts are found whole wherever they stand, however their lines and paragraphs are
  broken: the canonical text is cut where the first words of a known text begin, and from
  each such place as many characters as that text has are hashed.

The known licence texts lie in ``license_texts``, one file each, named by SPDX identifier;
the terms alone, up to a line "END OF TERMS AND CONDITIONS", count as well.  ``known``
takes a table of one's own.  Documents without any of the words that every known text has
are not hashed; none that could match is lost by that.

The table of known texts does not grow with the data and is broadcast; what is shuffled is
one short row per document.

Defined cases: NULL text is empty and matches nothing; several licences of one text are
all listed, each once, in order; rows of one id (NULL too) are one document; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from importlib.resources import files

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO
EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR
ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are
permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of
conditions and the following disclaimer in the documentation and/or other materials provided
with the distribution.
"""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may
be used to endorse or promote products derived from this software without specific prior written
permission.
"""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY
EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE
GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON
ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR
OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY
OF SUCH DAMAGE."""
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this
software and associated documentation files (the "Software"), to deal in the Software without
restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or
substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT
NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM,
DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT
OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

# Known notices by SPDX identifier.
NOTICES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "This project is licensed under the Apache License, Version 2.0"),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "Licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0-only", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
]
# Short licence texts; longer ones lie in ``license_texts``.
SHORT_TEXTS = [
    ("MIT", _MIT),
    ("MIT", "MIT License\n\n" + _MIT),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
            "without fee is hereby granted, provided that the above copyright notice and this permission "
            "notice appear in all copies.\n\n" + _WARRANTY),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
             "without fee is hereby granted.\n\n" + _WARRANTY),
    ("BSD-2-Clause", _BSD + _BSD_END),
    ("BSD-3-Clause", _BSD + _BSD_THIRD + _BSD_END),
]
TERMS_END = "END OF TERMS AND CONDITIONS"


def stored_texts() -> list[tuple[str, str]]:
    """(spdx, text) of the files in ``license_texts`` and of their terms alone."""
    out = []
    for f in sorted(files(__package__).joinpath("license_texts").iterdir(), key=lambda f: f.name):
        spdx, text = f.name.removesuffix(".txt"), f.read_text(encoding="utf-8")
        out.append((spdx, text))
        if TERMS_END in text:
            out.append((spdx, text[: text.index(TERMS_END)]))
    return out


#: (spdx, text, whether it is found inside other texts too)
KNOWN = [(i, t, False) for i, t in NOTICES] + [(i, t, True) for i, t in SHORT_TEXTS + stored_texts()]
# Spellings that count as the same.
SAME = [
    ("licence", "license"), ("licenced", "licensed"), ("sub license", "sublicense"),
    ("non infringement", "noninfringement"), ("non commercial", "noncommercial"), ("organisation", "organization"),
    ("favour", "favor"), ("acknowledgement", "acknowledgment"), ("fulfilment", "fulfillment"),
    ("merchantibility", "merchantability"), ("per cent", "percent"), ("copyright owner", "copyright holder"),
    ("copyright owners", "copyright holders"), ("v2 0", "version 2 0"), ("v3", "version 3"),
]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Lines that name a holder: they differ from copy to copy.
COPYRIGHT = r"(^|\n)[ \t/*#;-]*(copyright[ \t]+(\(c\)|©|[0-9]{4})|\(c\)[ \t]*[0-9]{4}|©|all rights reserved)[^\n]*"
PUNCTUATION = r"[\x00-\x2f\x3a-\x60\x7b-\x7f“”‘’–—•]+"
MARK = "licen[sc]e|permission|redistribution"  # every known text has one of these words
START_WORDS = 5  # by which the beginning of a known text is recognised
PARAGRAPHS, LINES = r"\n[ \t\r]*\n", r"\n"


def canonical(text: Column) -> Column:
    out = F.regexp_replace(F.translate(text, UPPER, LOWER), COPYRIGHT, "\n")
    out = F.regexp_replace(out, PUNCTUATION, " ")
    for old, new in SAME:
        out = F.regexp_replace(out, rf"\b{old}\b", new)
    return F.trim(out)


def known_texts(spark, known: Sequence[tuple[str, str, bool]] = KNOWN) -> DataFrame:
    """(spdx, body, inside) of the known texts in canonical form, as many rows as there are
    texts."""
    rows = spark.createDataFrame(list(known), "spdx string, text string, inside boolean")
    return rows.select("spdx", canonical(F.col("text")).alias("body"), "inside").distinct()


def _runs(canon: Column, bodies: Sequence[str]) -> Column:
    """Digests of all stretches of ``canon`` that begin like one of ``bodies`` and are as
    long.  A cut at every such beginning makes the stretch a few neighbouring pieces: as
    many as the known text has itself, and those that begin in its last words."""
    start = {b: " ".join(b.split(" ")[:START_WORDS]) for b in bodies}
    cut = f"(?<![^ ])(?=(?:{'|'.join(sorted(set(start.values())))})(?![^ ]))"
    options: dict[str, set[tuple[int, int]]] = {}
    for b in bodies:
        options.setdefault(start[b], set()).add((len(re.findall(cut, b)) + START_WORDS, len(b)))
    pieces = F.split(canon, cut)

    def digests(piece: Column, at: Column) -> Column:
        def one(n: int, length: int) -> Column:
            text = F.array_join(F.slice(pieces, at + 1, F.lit(n)), "")
            # One character more than the text has: none or a space, or its last word goes on.
            return F.sha2(F.rtrim(F.substring(text, 1, length + 1)), 256)

        out = F.array().cast("array<string>")
        for s, sizes in options.items():
            out = F.when(F.startswith(piece, F.lit(s)), F.array(*[one(n, k) for n, k in sorted(sizes)])).otherwise(out)
        return out

    return F.flatten(F.transform(pieces, digests))


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: Sequence[tuple[str, str, bool]] = KNOWN
) -> DataFrame:
    """Per id: whole (licence that the whole text is, or NULL), found (array of all
    licences in the text) and n_texts (known texts and notices found, each once)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    marked = rf"(?i){MARK}"
    texts = known_texts(spark, known)
    bodies = sorted({r["body"] for r in texts.where("inside").select("body").collect()})  # as many as are given
    mine = docs.select(
        F.col(f"`{id_col}`").alias("id"),
        F.when(text.rlike(marked), text).alias("text"),
        F.when(text.rlike(marked), canonical(text)).alias("canon"),
    )
    lines = F.array_distinct(F.concat(F.split("text", PARAGRAPHS), F.split("text", LINES)))
    parts = F.transform(F.filter(lines, lambda u: u.rlike(marked)), lambda u: F.sha2(canonical(u), 256))
    if bodies:
        parts = F.concat(parts, _runs(F.col("canon"), bodies))
    units = mine.select("id", F.sha2("canon", 256).alias("whole"), F.array_distinct(F.concat(F.array(F.sha2("canon", 256)), parts)).alias("digests"))
    each = units.select("id", "whole", F.explode_outer("digests").alias("digest"))
    digests = texts.select("spdx", F.sha2("body", 256).alias("digest")).distinct()
    matched = each.join(F.broadcast(digests), "digest", "left")
    out = matched.groupBy(F.col("id").alias(id_col)).agg(
        F.min(F.when(F.col("whole") == F.col("digest"), F.col("spdx"))).alias("whole"),
        F.sort_array(F.collect_set("spdx")).alias("found"),
        F.collect_set(F.when(F.col("spdx").isNotNull(), F.col("digest"))).alias("n_texts"),
    )
    return out.withColumn("n_texts", F.size("n_texts").cast("bigint"))
