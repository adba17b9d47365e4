"""Licence scans by canonical digest.

A text is normalised: lower case, lines that state a copyright removed, lines joined,
equivalent spellings unified, everything but letters and digits turned into single spaces. The
SHA-256 of what is left is joined to the digests of known licences, so a document matches
if its entire text is a known licence text up to these differences.

The join is a hash join on the digest: Spark broadcasts the known side if it measures it
to be small, or else shuffles, where it splits a digest that holds a third of the
documents. Defined cases: null and empty texts, and texts of which nothing is left, have
the digest of the empty text and match no licence; repeated rows give repeated results; of
known texts with equal digests the smallest licence id counts; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from importlib import resources

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The lines the SQL of the query removes, also inside a licence body.
COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}\n]*(copyright|\(c\)|©|all rights reserved)[^\n]*$"
#: What follows the word inside a sentence, where a holder would follow in a statement.
_NO_HOLDER = (
    r"notices?|holders?|owners?|ownership|laws?|licen[sc]es?|licensing|statements?|treat(?:y|ies)|doctrines?|permissions?"
    r"|disclaimers?|interests?|protections?|rights?|infringements?|claims?|acts?|terms|grants?|conditions|and|are|as|can|for"
    r"|if|in|is|it|may|of|on|or|shall|that|to|under|which|with|the\s+(?:software|program|library|work)|the$"
)
_STATED = (
    # A year or sign after the word, or a holder.
    r"copyright[ \t,:;.<\[-]*(?:\(c\)|©|[0-9]{4}|year\b|yyyy\b)[^\n]*"
    rf"|copyright[ \t:]+(?!(?:{_NO_HOLDER})(?![\p{{L}}\p{{N}}]))[\p{{L}}\p{{N}}][^\n]*"
    r"|©[^\n]*|\(c\)[ \t,:-]*[0-9]{4}[^\n]*"
    r"|all rights reserved(?:[^\p{L}\p{N}\n]*|[ \t]+by\b[^\n]*)"
)
#: Lines that state a copyright, wherever the text around them is wrapped.
STATEMENT = rf"(?m)^[^\p{{L}}\p{{N}}\n]*(?:{_STATED})$"
#: The same and lines that begin with a bare "(c)", for texts in which it is no third item.
STATEMENT_OR_SIGN = rf"(?m)^[^\p{{L}}\p{{N}}\n]*(?:{_STATED}|\(c\)[^\n]*)$"
#: Spellings that count as equal: (pattern on lower-case text, replacement).
SPELLINGS = (
    (r"http:", "https:"),
    (r"&", " and "),
    (r"©|\(c\)", " copyright "),
    (r"licence", "license"),
    (r"sub-?\s?license", "sublicense"),
    (r"non-?\s?infringement", "noninfringement"),
    (r"acknowledgement", "acknowledgment"),
    (r"judgement", "judgment"),
    (r"favour", "favor"),
    (r"organis", "organiz"),
    (r"authoris", "authoriz"),
    (r"recognis", "recogniz"),
    (r"modif(y|ies) and/or", "modif$1 and or"),
    (r"per cent", "percent"),
    (r"copyright owner", "copyright holder"),
    (r"\bv(er|ersion)?[. ]*([0-9])", "version $2"),
    (r"the mit licen[sc]e", "mit license"),
)

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this
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
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or
without fee is hereby granted, provided that the above copyright notice and this permission notice
appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS
SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE
AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE
OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
SOFTWARE."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event
will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial
applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the
original software. If you use this software in a product, an acknowledgment in the product
documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being
the original software.
3. This notice may not be removed or altered from any source distribution."""
APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use
this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License
is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or
implied. See the License for the specific language governing permissions and limitations under the
License."""

#: Licence id and text. Grants in one sentence are texts of their own.
KNOWN = (
    ("MIT", MIT),
    ("MIT", "MIT License\n\n" + MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("ISC", ISC),
    ("ISC", "ISC License\n\n" + ISC),
    ("Zlib", ZLIB),
    ("Zlib", "zlib License\n\n" + ZLIB),
    ("Apache-2.0", APACHE_NOTICE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
)


def _full_texts() -> tuple[tuple[str, str], ...]:
    folder = resources.files("plumbline.llm") / "license_texts"
    names = ("Apache-2.0", "CC0-1.0", "GPL-2.0-only", "GPL-3.0-only", "LGPL-2.1-only", "LGPL-3.0-only", "MPL-2.0")
    texts = [(name, (folder / f"{name}.txt").read_text("utf-8")) for name in names]
    end = "END OF TERMS AND CONDITIONS"
    # Often copied without the advice that follows the terms.
    texts += [(name, text[: text.index(end) + len(end)]) for name, text in texts if end in text]
    three = "{}Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n"
    for marks in (("1. ", "2. ", "3. "), ("* ", "* ", "* ")):
        first = _BSD_CONDITIONS.format(*marks)
        for name, title, body in (
            ("BSD-2-Clause", "BSD 2-Clause License", first + _BSD_DISCLAIMER),
            ("BSD-3-Clause", "BSD 3-Clause License", first + three.format(marks[2]) + _BSD_DISCLAIMER),
        ):
            texts += [(name, body), (name, f"{title}\n\n{body}")]
    return tuple(texts)


_BSD_CONDITIONS = """Redistribution and use in source and binary forms, with or without modification, are
permitted provided that the following conditions are met:

{}Redistributions of source code must retain the above copyright notice, this list of conditions
and the following disclaimer.

{}Redistributions in binary form must reproduce the above copyright notice, this list of conditions
and the following disclaimer in the documentation and/or other materials provided with the
distribution.

"""
_BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY
EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT
HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH
DAMAGE."""

#: Entire texts of other common licences.
FULL_TEXTS = _full_texts()


def canonical(column):
    """The normalised text."""
    text = F.regexp_replace(F.lower(F.coalesce(column, F.lit(""))), r"\r\n?", "\n")
    stated = F.when(F.contains(text, F.lit("(b)")), F.regexp_replace(text, STATEMENT, ""))
    text = stated.otherwise(F.regexp_replace(text, STATEMENT_OR_SIGN, ""))
    text = F.regexp_replace(text, r"\s+", " ")
    for pattern, replacement in SPELLINGS:
        text = F.regexp_replace(text, pattern, replacement)
    return F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " "))


def known_licenses(spark: SparkSession, texts=KNOWN + FULL_TEXTS) -> DataFrame:
    """(digest, license_id) of ``texts``, pairs of id and text."""
    rows = spark.createDataFrame(list(texts), "license_id string, text string")
    return (
        rows.select(canonical(F.col("text")).alias("canon"), "license_id")
        .where("canon != ''")
        .groupBy(F.sha2(F.col("canon").cast("binary"), 256).alias("digest"))
        .agg(F.min("license_id").alias("license_id"))
    )


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """One row per document: (doc_id, digest, license_id), the last null without a match."""
    if known is None:
        known = known_licenses(docs.sparkSession)
    texts = docs.select(
        "doc_id", F.sha2(canonical(F.col("text")).cast("binary"), 256).alias("digest")
    )
    return texts.join(known, "digest", "left").select("doc_id", "digest", "license_id")
