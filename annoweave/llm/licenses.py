"""Licence scans by canonical digest lookup.

A whole text is normalised - case, punctuation, copyright lines, equivalent spellings -
and its SHA-256 looked up in the digests of known licence texts. DataFrame expressions
only; the known digests are a few rows, broadcast from this module.
"""

from __future__ import annotations

import re
from functools import cache
from importlib import resources

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annoweave.llm.base import ASCII_SPACE, text_of

# Spellings that licence matching treats as one, by whole words after normalisation.
EQUIVALENT_WORDS = {
    "acknowledgement": "acknowledgment",
    "analogue": "analog",
    "analyse": "analyze",
    "artefact": "artifact",
    "authorisation": "authorization",
    "authorised": "authorized",
    "calibre": "caliber",
    "cancelled": "canceled",
    "capitalisations": "capitalizations",
    "catalogue": "catalog",
    "categorise": "categorize",
    "centre": "center",
    "emphasised": "emphasized",
    "favour": "favor",
    "favourite": "favorite",
    "fulfil": "fulfill",
    "fulfilment": "fulfillment",
    "initialise": "initialize",
    "judgement": "judgment",
    "labelling": "labeling",
    "labour": "labor",
    "licence": "license",
    "licenced": "licensed",
    "licences": "licenses",
    "maximise": "maximize",
    "modelled": "modeled",
    "modelling": "modeling",
    "offence": "offense",
    "optimise": "optimize",
    "organisation": "organization",
    "organise": "organize",
    "practise": "practice",
    "programme": "program",
    "realise": "realize",
    "recognise": "recognize",
    "signalling": "signaling",
    "sublicence": "sublicense",
    "utilisation": "utilization",
    "whilst": "while",
    "wilful": "willful",
}

# Words that are written in several ways, and names that licence matching treats as one.
EQUIVALENT_PHRASES = {
    "copyright owner": "copyright holder",
    "copyright owners": "copyright holders",
    "non commercial": "noncommercial",
    "per cent": "percent",
    "sub licence": "sublicense",
    "sub license": "sublicense",
}

# Well-known licence texts and notices.
_MIT_BODY = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"""
_ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_NAMES = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_WARRANTY = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
KNOWN_TEXTS: list[tuple[str, str]] = [
    ("MIT", _MIT_BODY),
    ("MIT", "MIT License\n\n" + _MIT_BODY),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT_BODY),
    ("MIT", "The MIT License\n\n" + _MIT_BODY),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC_WARRANTY),
    ("ISC", "ISC License\n\n" + _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC_WARRANTY),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("0BSD", _ISC_GRANT + ".\n" + _ISC_WARRANTY),
    ("0BSD", "BSD Zero Clause License\n\n" + _ISC_GRANT + ".\n" + _ISC_WARRANTY),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_WARRANTY),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD_HEAD + _BSD_WARRANTY),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_NAMES + _BSD_WARRANTY),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _BSD_HEAD + _BSD_NAMES + _BSD_WARRANTY),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""),
]

# Postal addresses by which the GNU licences of different years name their publisher.
_ADDRESS = re.compile(r"51 Franklin St(?:reet)?, Fifth Floor, Boston,? MA\s+02110-1301\s+USA")
_ADDRESSES = ("51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA", "51 Franklin St, Fifth Floor, Boston, MA 02110-1301 USA", "59 Temple Place, Suite 330, Boston, MA 02111-1307 USA", "59 Temple Place - Suite 330, Boston, MA 02111-1307, USA", "675 Mass Ave, Cambridge, MA 02139, USA")
#: Where a licence's terms end and advice on applying it begins; the line itself stays or goes.
_END = re.compile(r"\n[ \t]*END OF TERMS AND CONDITIONS[ \t]*(?=\n)|\n(?=Exhibit A - Source Code Form|ADDENDUM: How to use)")
#: Where a text begins if its title is left out.
_STARTS = {"Apache-2.0": r"TERMS AND CONDITIONS FOR USE|1\. Definitions", "CC0-1.0": r"CC0 1\.0 Universal|Statement of Purpose", "MPL-1.1": r"1\. Definitions", "MPL-2.0": r"1\. Definitions", "Artistic-1.0-Perl": "Preamble|The intent of this"}
_GNU_STARTS = r"(?<=\n)[ \t]*Everyone is permitted|(?<=\n)[ \t]*(?:0\. )?P(?:reamble|REAMBLE)\n|(?<=\n)  This version of the GNU Lesser"


def full_text_variants(license_id: str, text: str) -> list[str]:
    """A whole licence as it is found: with and without title, advice at its end, in http or https, by each address."""
    out = [text]
    if _ADDRESS.search(text):
        # lines by which the header alone, or header and advice, carry each address, or none
        out += [_ADDRESS.sub(a, text) for a in _ADDRESSES] + [_ADDRESS.sub("<https://fsf.org/>", text, count=1), _ADDRESS.sub("", text, count=1)]
    out += [t.replace("https://", "http://") for t in out] + [t.replace("http://", "https://") for t in out]
    for t in list(dict.fromkeys(out)):
        if end := _END.search(t):
            out += [t[: end.end()], t[: end.start()]]
    for t in list(dict.fromkeys(out)):
        out += [t[m.start() :] for m in re.finditer(_STARTS.get(license_id, _GNU_STARTS), t[:4000])]
    return list(dict.fromkeys(out))


@cache
def full_texts() -> list[tuple[str, str]]:
    """(license_id, text) of the whole licences in license_texts, in all their variants."""
    files = sorted((f for f in resources.files("annoweave.llm").joinpath("license_texts").iterdir() if f.name.endswith(".txt")), key=lambda f: f.name)
    return [(i, v) for f in files for i in [f.name.removesuffix(".txt")] for v in full_text_variants(i, f.read_text("utf-8"))]


#: The oracle's lines that name a holder, not terms: copyright with a sign, year or name slot, or all rights reserved.
COPYRIGHT_LINE = r"(^|\n)[ \t*#/;]*(copyright[ \t:]+(\(c\)|©|[0-9]|by |<|\[)|\(c\)[ \t]|©|all rights reserved)[^\n]*"
#: What follows "copyright" or "(c)" where a line starts with terms, not with a holder.
_TERMS = (
    "and|are|disclaimers?|doctrines|holders?|if|infringements?|interests?|is|laws?|licen[sc]e[ds]?|notices?|of|on|or|owners?|ownership|permissions?"
    "|protection|resulting|rights|statements?|treaty|treaties|the(?:[ ](?:software|library|program)[ ]*,|(?=[ ]*\n))"
)
_ITEM_TERMS = "representations|the[ ]licenses|under|you"
#: Lines dropped from a text: those of a holder, told by a sign, a year, a name slot or a name.
HOLDER_LINE = (
    rf"(^|\n)[ \t*#/;]*(copyright[ \t:]+(\(c\)|©|[0-9]|by |[<\[{{]|(?!(?:{_TERMS})(?![\p{{L}}\p{{N}}]))\p{{L}})"
    rf"|\(c\)[ \t]+(?!(?:{_ITEM_TERMS})(?![\p{{L}}\p{{N}}]))|©|all rights reserved)[^\n]*"
)
#: Every mark, and white space, becomes one space.
SEPARATORS = r"[^\p{L}\p{N}]+"


def canonical(text: Column) -> Column:
    """The canonical form of a text: words in lower case with one space between."""
    lines = F.regexp_replace(F.lower(text), "\r\n?", "\n")
    # each copyright line leaves its line break, so that the next line's start is still seen
    words = F.regexp_replace(F.regexp_replace(lines, HOLDER_LINE, "\n"), SEPARATORS, "  ")
    # a word has a space of its own on either side, so neighbours that are both replaced don't share one
    spaced = F.concat(F.lit(" "), F.trim(words), F.lit(" "))
    same = {f" {a.replace(' ', '  ')} ": f" {b.replace(' ', '  ')} " for a, b in (EQUIVALENT_PHRASES | EQUIVALENT_WORDS).items()}
    spelt = spaced
    for one, other in same.items():
        spelt = F.replace(spelt, F.lit(one), F.lit(other))
    # one look for all of them spares most texts the replacements
    found = spaced.rlike(" (?:" + "|".join(a[1:-1] for a in same) + ") ")
    return F.trim(F.replace(F.when(found, spelt).otherwise(spaced), F.lit("  "), F.lit(" ")))


def known_digests(docs: DataFrame, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """(known_digest, license_id): one row for each known canonical form."""
    rows = docs.sparkSession.createDataFrame([*KNOWN_TEXTS, *full_texts()] if known is None else known, "license_id string, t string")
    form = canonical(F.col("t"))
    return rows.select(F.sha2(form, 256).alias("known_digest"), "license_id").groupBy("known_digest").agg(F.min("license_id").alias("license_id"))


def closing_line(text: Column) -> Column:
    """The last line that isn't blank."""
    return F.substring_index(F.rtrim(text, F.lit(ASCII_SPACE)), "\n", -1)


def scan_licenses(docs: DataFrame, known: list[tuple[str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Which rows' whole texts are known licence texts, and whose closing lines are known notices.

    Null and blank texts have the digest of the empty form and no licence. A whole text
    is a licence whatever its length; a text that ends with a notice is none, but
    closing_license_id names it. Null ids and repeated rows stay as they are; an empty
    table gives no rows; other columns are ignored.

    Returns doc_id, canonical_sha256, license_id (null if unknown), is_license, closing_license_id.
    """
    digests = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.sha2(canonical(text_of(text_col)), 256).alias("canonical_sha256"),
        F.sha2(canonical(closing_line(text_of(text_col))), 256).alias("closing_sha256"),
    )
    # as many rows as there are known texts: a constant of this module
    digest = known_digests(docs, known)
    closing = digest.select(F.col("known_digest").alias("closing_digest"), F.col("license_id").alias("closing_license_id"))
    found = digests.join(F.broadcast(digest), F.col("canonical_sha256") == F.col("known_digest"), "left")
    found = found.join(F.broadcast(closing), F.col("closing_sha256") == F.col("closing_digest"), "left")
    return found.select("doc_id", "canonical_sha256", "license_id", F.col("license_id").isNotNull().alias("is_license"), "closing_license_id")


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_canonical(t: str) -> str:
    """The same form by lists: words are looked up one by one."""
    lines = f"regexp_replace(lower({t}), '\\r\\n?', chr(10), 'g')"
    words = f"trim(regexp_replace(regexp_replace({lines}, {_sql_text(COPYRIGHT_LINE)}, chr(10), 'g'), {_sql_text(SEPARATORS)}, ' ', 'g'))"
    for one, other in EQUIVALENT_PHRASES.items():
        words = f"regexp_replace({words}, '\\b{one}\\b', '{other}', 'g')"
    spelt = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in EQUIVALENT_WORDS.items()) + "}"
    return f"array_to_string(list_transform(string_split({words}, ' '), lambda w: coalesce({spelt}[w], w)), ' ')"


_SQL_CLOSING = "string_split(rtrim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), chr(10))[-1]"
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, sha256({_sql_canonical("coalesce(text, '')")}) AS canonical_sha256, sha256({_sql_canonical(_SQL_CLOSING)}) AS closing_sha256 FROM documents),
k AS (
  SELECT sha256({_sql_canonical("t")}) AS known_digest, min(license_id) AS license_id
  FROM (VALUES {", ".join(f"({_sql_text(i)}, {_sql_text(t)})" for i, t in KNOWN_TEXTS)}) AS x(license_id, t) GROUP BY ALL)
SELECT doc_id, canonical_sha256, k.license_id, k.license_id IS NOT NULL AS is_license, c.license_id AS closing_license_id
FROM d LEFT JOIN k ON canonical_sha256 = k.known_digest LEFT JOIN k c ON closing_sha256 = c.known_digest
"""
