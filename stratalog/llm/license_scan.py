"""License scans: a canonical digest of the entire text, hash-joined to known licences.

Two texts are the same licence if they agree after lower-casing A-Z (other
letters keep their case), dropping lines that are copyright notices, unifying
listed spellings, and turning every run of what is neither letter nor digit into
one space. A notice is a line that begins with "copyright" and a year, a sign or
a short name, with a sign and a year, or that reserves all rights. Native
functions only.

Null and empty texts have the digest of the empty text and match nothing; a very
long text is digested whole. A licence list is a small table of texts given by
the caller; it is broadcast only up to MOST_BROADCAST entries and hash-joined
beyond. Repeated rows give repeated results; an empty table gives an empty
result. Extra columns are left out unless kept; one kept under a result's name
is refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_BROADCAST = 10_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Spellings that licences use one for the other.
SPELLINGS = [
    ("licence", "license"), ("sublicence", "sublicense"), ("authorisation", "authorization"), ("organisation", "organization"),
    ("favour", "favor"), ("behaviour", "behavior"), ("programme", "program"), ("acknowledgement", "acknowledgment"),
    ("judgement", "judgment"), ("fulfilment", "fulfillment"), ("per cent", "percent"), ("non commercial", "noncommercial"), ("merchantibility", "merchantability"),
]
#: Words of sentences, on lower-cased text: a line that begins as a notice and has one speaks of copyright without stating one.
_SENTENCE = (
    "notices?|holders?|owners?|laws?|licen[sc]es?|statements?|interests?|is|are|was|be|been|shall|will|must|may|can|cannot|should|has|have|requires?|required|lapses?|expires?|claims?|pay|pays|paid|payments?|fees?|grants?|granted"
    "|permits?|permitted|permission|apply|applies|uses?|used|using|copying|modify|modified|distributed?|provided|subject|unless|if|when|until|after|before|except|only|not|without|you|your|they|this|that|these|which|who|to|in|or|pass|days?")
#: What follows is set apart so that it is no name.
_SPEECH = rf"(?m)^([^a-z0-9\n]*(?:copyright|\(c\)|©))([^\n]*\b(?:{_SENTENCE})\b)"
_SIGN, _YEARS = r"(?:\(c\)|©)", r"[0-9]{4}(?:[ \t]*[-–,][ \t]*(?:[0-9]{2,4}|present|now))*"
#: A holder: some words up to the line's end, without the end of a sentence.
_HOLDER = r"(?:[ \t,]+[^ \t\n;?!$%]+){0,12}?(?:[^.\n;?!$%]|[ \t.,](?:inc|ltd|co|corp|al|jr|sr|llc|gmbh)\.|reserved\.)?"
#: A line of its own that states a copyright with a sign or a year at once, or reserves rights.
_NOTICE = (
    rf"(?m)^[^a-z0-9\n]*(?:copyright[ \t]*{_SIGN}?[ \t,]*{_YEARS}{_HOLDER}|{_SIGN}[ \t]*(?:copyright[ \t]*)?{_YEARS}{_HOLDER}|copyright[ \t]*{_SIGN}{_HOLDER}|all rights reserved[^a-z0-9\n]*)[ \t]*$")
#: One without sign and year, on the first line or under a heading.
_YEARLESS = r"\A((?:[^\n]{0,80}\n+)?)[^a-z0-9\n]*copyright(?:[ \t]+[^ \t\n;?!$%]+){0,4}?[ \t]+[^ \t\n;?!$%]*[^ \t\n.;?!$%][ \t]*(\n|\z)"
#: The licences that the registered query knows.
LICENSES = {
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org>""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
}


#: First lines that stand above a licence's text.
HEADINGS = {
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The 2-Clause BSD License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The 3-Clause BSD License", "New BSD License"],
    "ISC": ["ISC License", "The ISC License"],
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"],
    "Zlib": ["zlib License", "The zlib/libpng License"],
}


def _cut(low: Column) -> Column:
    # d: a line ends at \n alone, as in the twin; every word has a space of its own on either side
    lines = F.regexp_replace(F.regexp_replace(low, r"\r\n?", "\n"), _SPEECH.replace("(?m)", "(?md)"), "$1:$2")
    lines = F.regexp_replace(F.regexp_replace(lines, _NOTICE.replace("(?m)", "(?md)"), ""), _YEARLESS, "$1$2")
    return F.concat(F.lit(" "), F.regexp_replace(lines, r"[^\p{L}\p{N}]+", "  "), F.lit(" "))


def canonical(text: Column) -> Column:
    out = _cut(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER))
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(f" {old.replace(' ', '  ')} "), F.lit(f" {new} "))
    return F.btrim(F.replace(out, F.lit("  "), F.lit(" ")), F.lit(" "))


def scan(docs: DataFrame, licenses: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(kept columns, digest, license): licenses (license, text); null where no licence is the entire text."""
    if clash := set(keep) & {"digest", "license"}:
        raise ValueError(f"columns of the result: {sorted(clash)}")
    known = licenses.where(F.length(canonical(F.col("text"))) > 0).select(F.sha2(canonical(F.col("text")), 256).alias("digest"), "license").groupBy("digest").agg(F.min("license").alias("license"))
    if licenses.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        known = F.broadcast(known)
    return docs.select(*keep, F.sha2(canonical(F.col(text)), 256).alias("digest")).join(known, "digest", "left").select(*keep, "digest", "license")


def texts() -> list[tuple[str, str]]:
    """Known (license, text), without and with each heading."""
    return [(name, text) for name, body in sorted(LICENSES.items()) for text in [body, *(f"{h}\n\n{body}" for h in HEADINGS.get(name, []))]]


def known_licenses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(texts(), "license string, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), known_licenses(spark))


def _sql(text: str) -> str:
    out = f"translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}')"
    for pattern, new in ((r"\r\n?", "\n"), (_SPEECH, r"\1:\2"), (_NOTICE, ""), (_YEARLESS, r"\1\2"), (r"[^\p{L}\p{N}]+", "  ")):
        out = f"regexp_replace({out}, '{pattern}', '{new}', 'g')"
    out = f"' ' || {out} || ' '"
    for old, new in SPELLINGS:
        out = f"replace({out}, ' {old.replace(' ', '  ')} ', ' {new} ')"
    return f"trim(replace({out}, '  ', ' '), ' ')"


ORACLE = (
    "WITH known AS (SELECT sha256(" + _sql("text") + ") AS digest, min(license) AS license FROM (VALUES "
    + ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in texts())
    + ") v(license, text) GROUP BY 1), d AS (SELECT doc_id, sha256(" + _sql("text") + ") AS digest FROM documents) SELECT doc_id, digest, license FROM d LEFT JOIN known USING (digest)"
)
