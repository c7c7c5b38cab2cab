"""Operator 8: licence scan by canonical digest."""

from __future__ import annotations

import functools
import hashlib
import pkgutil
import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.llm.text import LOWER, UPPER, ascii_lower
from tidemark.tables import small, table

#: The canonical form in steps of (pattern, replacement), in order, without look-around, so that Spark and SQL state one rule.
#: A line of the terms may begin with 'Copyright Notice' or 'Copyright Holders': a small letter tells it from an owner's name.
#: Then lines that name an owner go, after comment marks if any, with the lines after them while one ends with a comma, 'and' or '&';
#: lines of 'all rights reserved' alone (twice, as two may follow each other); and a short first paragraph whose first two lines name a licence.
_MARKS = r"[ \t#/*;%!<>|\"'.-]*"
_BLANK, _FILLED = r"[^A-Za-z0-9\n]*\n", r"[^A-Za-z0-9\n]{0,60}[A-Za-z0-9][^\n]{0,90}\n"
OWNERS = [
    (r"\bCopyright([ \t:,]+(the[ \t]+)?(License|Licence|Notice|Holder|Owner|Statement|Law|Act|Interest|And|Or|In)s?\b)", "copyright$1"),
    (
        rf"(?i)(^|\n){_MARKS}((portions|parts)[ \t]+(of[ \t]+this[ \t]+\w+[ \t]+)?(are[ \t]+)?)?("
        r"copyright[ \t:,]*(\(c\)|©|&copy;|[0-9]|[\[<{]|by\b)|(?-i:Copyright[ \t:,]+(the[ \t]+)?[A-Z])|\(c\)[ \t]*(copyright\b|[0-9]|by\b)|©)"
        r"([^\n]*(,|\band|&)[ \t\r]*\n)*[^\n]*", "$1",
    ),
    *[(rf"(?i)(^|\n){_MARKS}all rights reserved[ \t.*/#-]*\r?(\n|\z)", "$1$2")] * 2,
    (rf"(?i)^({_BLANK})*({_FILLED}){{0,1}}?[^\n]{{0,60}}\blicen[cs]e\b[^\n]{{0,60}}\n({_FILLED}){{0,4}}?{_BLANK}", ""),
]
#: What a text may name in place of the holder, within one spelling.
HOLDER = (r"\bneither the names? of .{1,200}? nor the names? of (its|the|their|any) contributors?\b", "neither the name of holder nor the names of its contributors")
#: ASCII but letters and digits, blanks that do not break, angle quotes, and the dashes, quotes, points and marks of general punctuation.
PUNCTUATION = r"[\x01-\x2F\x3A-\x60\x7B-\x7F\x{A0}\x{AB}\x{BB}\x{2010}-\x{2027}\x{2030}-\x{205E}]+"
#: Known texts whose digests may be broadcast.
KNOWN_ROWS = 100_000
#: Equivalent spellings, applied in order between word boundaries.
SPELLINGS = [
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("sub license", "sublicense"),
    ("organisation", "organization"), ("favour", "favor"), ("authorised", "authorized"), ("non infringement", "noninfringement"),
    ("https", "http"), ("v2", "version 2"), ("v3", "version 3"), ("behaviour", "behavior"), ("honour", "honor"), ("recognised", "recognized"), ("utilisation", "utilization"),
    ("judgement", "judgment"), ("non commercial", "noncommercial"), ("per cent", "percent"), ("copyright owner", "copyright holder"), ("copyright owners", "copyright holders"), ("wilful", "willful"),
    ("regents and contributors", "copyright holders and contributors"), ("author and contributors", "copyright holders and contributors"), ("authors and contributors", "copyright holders and contributors"),
]

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
#: Public licence texts and one-line notices (licence id, entire text).
NOTICED = [
    ("MIT", MIT),
    ("MIT", "MIT License\n\n" + MIT),
    ("MIT", "The MIT License (MIT)\n\n" + MIT),
    ("ISC", ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n\n" + ISC_WARRANTY),
    ("0BSD", ISC_GRANT + ".\n\n" + ISC_WARRANTY),
    ("Zlib", ZLIB),
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
]
#: Licences whose entire texts stand in the folder licenses, with the titles they may have.
ENTIRE = {
    "Apache-2.0": [], "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", 'BSD 2-Clause "Simplified" License'],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License'], "CC0-1.0": [], "GPL-1.0": [],
    "GPL-2.0": [], "GPL-3.0": [], "LGPL-2.0": [], "LGPL-2.1": [], "LGPL-3.0": [], "MPL-1.1": [], "MPL-2.0": [], "Unlicense": [], "Artistic-1.0": [], "BSL-1.0": [], "GFDL-1.2": [], "GFDL-1.3": [],
}
TERMS_END = "END OF TERMS AND CONDITIONS"


def _entire() -> list[tuple[str, str]]:
    """Each entire text as it is, under its titles, without what follows TERMS_END, and with unnumbered conditions (BSD)."""
    out = []
    for name, titles in ENTIRE.items():
        text = pkgutil.get_data(__package__, f"licenses/{name}.txt").decode()
        forms = [text]
        if TERMS_END in text:
            before = text[: text.index(TERMS_END)]
            forms += [before + TERMS_END, before]
        if name.startswith("BSD"):
            forms.append(re.sub(r"(?m)^\d\. ", "* ", text))
        out += [(name, x) for f in forms for x in [f, *(f"{t}\n\n{f}" for t in titles)]]
    return out


#: All known texts (licence id, entire text).
KNOWN = [
    *NOTICED,
    *((i, f"{title}\n\n{t}") for i, t in NOTICED if "\n" in t for title in {"ISC": ["ISC License", "The ISC License"], "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD"], "Zlib": ["zlib License"]}.get(i, [])),
    *_entire(),
]


def _spelled(plain: Column) -> Column:
    """``plain`` in one spelling: the replacements run only where one of the old spellings stands."""
    replaced = plain
    for old, new in SPELLINGS:
        replaced = F.regexp_replace(replaced, rf"\b{old}\b", new)
    one = F.when(plain.rlike(rf"\b({'|'.join(old for old, _ in SPELLINGS)})\b"), replaced).otherwise(plain)
    return F.when(plain.contains("neither the name"), F.regexp_replace(one, *HOLDER)).otherwise(one)


def canonical(text: Column) -> Column:
    """Lower-cased text without owner lines, title and punctuation, in one spelling, single-spaced, any holder's name as one word."""
    def unowned(x: Column) -> Column:
        """The steps of OWNERS, each where a word stands without which it does nothing."""
        has = lambda *found: functools.reduce(Column.__or__, [x.low.contains(f) for f in found])
        out = x.text
        for (pattern, replacement), words in zip(OWNERS, [("copyright",), ("copyright", "(c)", "©"), *[("all rights reserved",)] * 2, ("licen",)], strict=True):
            out = F.when(has(*words), F.regexp_replace(out, pattern, replacement)).otherwise(out)
        return out

    whole = F.coalesce(text, F.lit(""))
    # each step's value is computed once for the next
    steps = F.transform(F.array(F.struct(whole.alias("text"), F.lower(whole).alias("low"))), unowned)
    steps = F.transform(steps, lambda x: F.regexp_replace(ascii_lower(x), PUNCTUATION, " "))
    return F.trim(F.get(F.transform(steps, _spelled), F.lit(0)))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def scan_licenses(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``' ids with digest, license_id of the entire text, and notices: ids of entire lines.

    Both a document's whole text and each of its lines are brought to canonical form, hashed
    and joined to the digests of ``known`` (license_id, text), a fixed reference list. Equal
    digests in ``known`` resolve to the smallest license_id. notices is a sorted, distinct,
    comma-joined string.

    Null and empty texts have the digest of '' and match nothing, as do texts of punctuation
    or owner lines only. Rows repeating an id are scanned alike, one row each; rows sharing
    id and text share notices. An empty table gives an empty result.
    """
    ident, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    empty = F.sha2(F.lit(""), 256)
    listed = small(
        known.select(digest(F.col("text")).alias("known"), "license_id").where(F.col("known") != empty)
        .groupBy("known").agg(F.min("license_id").alias("license_id")), KNOWN_ROWS
    )
    rows = docs.select(ident.alias(id_col), F.xxhash64(text).alias("r"), digest(text).alias("digest"))
    lines = docs.select(ident.alias("d"), F.xxhash64(text).alias("r"), F.explode(F.split(text, "\n", -1)).alias("line"))
    found = (
        lines.where("line rlike '[A-Za-z]'").select("d", "r", digest(F.col("line")).alias("known"))
        .join(listed, "known").groupBy("d", F.col("r").alias("r1"))
        .agg(F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("notices"))
    )
    whole = rows.join(listed, F.col("digest") == F.col("known"), "left")
    return whole.join(found, F.col(id_col).eqNullSafe(F.col("d")) & (F.col("r") == F.col("r1")), "left").select(
        id_col, "digest", "license_id", F.coalesce("notices", F.lit("")).alias("notices")
    )


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: doc_id, digest, license_id (null: none), notices."""
    known = spark.createDataFrame(KNOWN, "license_id string, text string")
    return scan_licenses(table(spark, sf_dir, "documents"), known)


def canonical_plain(text: str) -> str:
    """The same steps in plain Python, for ORACLE's digests and the tests."""
    for pattern, replacement in OWNERS:
        text = re.sub(pattern.replace(r"\z", r"\Z"), lambda m, r=replacement: re.sub(r"\$(\d)", lambda n: m[int(n[1])] or "", r), text)
    text = re.sub(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), PUNCTUATION), " ", re.sub("[A-Z]+", lambda m: m[0].lower(), text))
    for old, new in SPELLINGS:
        text = re.sub(rf"\b{old}\b", new, text)
    return re.sub(*HOLDER, text).strip(" ")


def _canonical_sql(x: str) -> str:
    quoted = lambda t: t.replace("'", "''")
    out = f"coalesce({x}, '')"
    for pattern, replacement in OWNERS:
        out = f"regexp_replace({out}, '{quoted(pattern)}', '{replacement.replace('$', chr(92))}', 'g')"
    out = f"regexp_replace(translate({out}, '{UPPER}', '{LOWER}'), '{PUNCTUATION}', ' ', 'g')"
    for old, new in SPELLINGS:
        out = f"regexp_replace({out}, '\\b{old}\\b', '{new}', 'g')"
    return f"trim(regexp_replace({out}, '{HOLDER[0]}', '{HOLDER[1]}', 'g'))"


def _digests() -> str:
    found = {}
    for name, text in KNOWN:
        found.setdefault(hashlib.sha256(canonical_plain(text).encode()).hexdigest(), set()).add(name)
    return ", ".join(f"('{d}', '{min(names)}')" for d, names in found.items())


ORACLE = f"""
WITH known(dg, license_id) AS (VALUES {_digests()}),
d AS (SELECT row_number() OVER () AS r, doc_id, text, sha256({_canonical_sql('text')}) AS digest FROM documents),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
m AS (SELECT DISTINCT l.r, k.license_id FROM l JOIN known k ON sha256({_canonical_sql('l.line')}) = k.dg),
n AS (SELECT r, string_agg(license_id, ',' ORDER BY license_id) AS notices FROM m GROUP BY r)
SELECT d.doc_id, d.digest, k.license_id, coalesce(n.notices, '') AS notices
FROM d LEFT JOIN known k ON d.digest = k.dg LEFT JOIN n ON d.r = n.r
"""
