"""Licence scan by canonical digests.

A text is brought to canonical form: lower case, copyright lines cut, equivalent spellings made one, punctuation and white
space reduced to single spaces. The digest of the whole form is joined to the digests of known licences; no part of a text
is enough. Whole documents are looked up, and each of their lines, which is where notices stand. DataFrame functions only.

The known table has full texts (``licence_texts`` and below) and usual notices; ``scan`` takes any other.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000
#: Full texts of longer licences, as published, each in a file of its name.
TEXTS = Path(__file__).with_name("licence_texts")
#: Every licence of the known table has one of these words.
TRIGGER = r"(?i)licen[cs]|permission|redistribution|public domain|released|distributed"
#: Equivalent spellings: fixed values.
SPELLINGS = [
    (r"\blicence", "license"), (r"\bsublicence", "sublicense"), (r"\bsub-licen[cs]e", "sublicense"), (r"\bnon-commercial", "noncommercial"),
    (r"\bno-derivatives", "noderivatives"), (r"\bshare-alike", "sharealike"), (r"\bfavour", "favor"), (r"\bmerchantibility", "merchantability"),
    (r"\bwhilst\b", "while"), (r"\bper cent\b", "percent"), (r"&", " and "), (r"https://", "http://"), (r"\bversion\b|\bver\. ?|\bv\. ?|\bv([0-9])", r"v \1"),
]
COPYRIGHT = r"(?m)^[ \t*#/;-]*(copyright[ \t]*(\(c\)|©|:|by |[0-9\[<{])|copyright [^\n]{0,60}[12][0-9]{3}|\(c\)|©)[^\n]*$"

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
BSD_NAMES = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""


UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
MPL_NOTICE = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
GNU_NOTICE = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} License as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} License for more details.

You should have received a copy of the GNU {name} License along with this program. If not, see <https://www.gnu.org/licenses/>."""
GNU = [("General Public", "GPL", ("2", "3")), ("Lesser General Public", "LGPL", ("2.1", "3")), ("Affero General Public", "AGPL", ("3",))]


def _identifiers() -> list[tuple[str, str]]:
    """(licence, SPDX identifier)."""
    found = [(n, n) for n in ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Unlicense", "Zlib", "Apache-2.0", "MPL-1.1", "MPL-2.0", "EPL-1.0", "EPL-2.0", "CC0-1.0")]
    found += [(n, n) for terms in ("", "-SA", "-ND", "-NC", "-NC-SA", "-NC-ND") for v in ("2.0", "2.5", "3.0", "4.0") for n in [f"CC-BY{terms}-{v}"]]
    return found + [(f"{short}-{v}", f"{short}-{v if '.' in v else v + '.0'}{tail}") for _, short, versions in GNU for v in versions for tail in ("", "-only", "-or-later")]


def known_texts() -> list[tuple[str, str]]:
    """(licence, text) of the known table: full texts, and notices made by rule from names."""
    found = [("MIT", MIT), ("MIT", "MIT License\n\n" + MIT), ("MIT", "The MIT License (MIT)\n\n" + MIT), ("ISC", ISC), ("ISC", "ISC License\n\n" + ISC), ("BSD-2-Clause", BSD_HEAD + BSD_TAIL), ("BSD-3-Clause", BSD_HEAD + BSD_NAMES + BSD_TAIL)]
    found += [("Unlicense", UNLICENSE), ("Zlib", ZLIB), ("Zlib", "zlib License\n\n" + ZLIB), ("Apache-2.0", APACHE_NOTICE), ("MPL-2.0", MPL_NOTICE)]
    found += [(f.stem, f.read_text(encoding="utf-8")) for f in sorted(TEXTS.glob("*.txt"))]
    found += [(f"{short}-{v}", GNU_NOTICE.format(name=name, version=v)) for name, short, versions in GNU for v in versions]
    named = [("MIT", "the MIT License"), ("MIT", "MIT License"), ("MIT", "MIT"), ("ISC", "the ISC License"), ("Unlicense", "the Unlicense"), ("Zlib", "the zlib License")]
    named += [(f"BSD-{n}-Clause", f"the BSD {n}-Clause License") for n in (2, 3)]
    for name, versions in (("Apache", ("2.0",)), ("Mozilla Public", ("1.1", "2.0")), ("Eclipse Public", ("1.0", "2.0"))):
        short = {"Apache": "Apache", "Mozilla Public": "MPL", "Eclipse Public": "EPL"}[name]
        named += [(f"{short}-{v}", f"the {name} License{form}{v}") for v in versions for form in (", Version ", " Version ", " ", " v")]
    for name, short in (("General Public", "GPL"), ("Lesser General Public", "LGPL"), ("Affero General Public", "AGPL")):
        for v in ("2", "2.1", "3"):
            named += [(f"{short}-{v}", f"the GNU {name} License{form}{v}{tail}") for form in (", version ", " version ", " v") for tail in ("", ".0")]
    for terms in ("", "-SA", "-ND", "-NC", "-NC-SA", "-NC-ND"):
        named += [(f"CC-BY{terms}-{v}", f"{word} BY{terms} {v}{tail}") for v in ("2.0", "2.5", "3.0", "4.0") for word in ("CC", "Creative Commons") for tail in ("", " International", " license")]
    for verb in ("Licensed under", "Released under", "This work is licensed under", "This software is licensed under", "This project is licensed under", "Distributed under"):
        found += [(short, f"{verb} {name}.") for short, name in named]
    return found + [(short, f"SPDX-License-Identifier: {name}") for short, name in _identifiers()]


def canonical(text: Column) -> Column:
    """The form of a text of which the digest is taken."""
    out = F.regexp_replace(F.lower(text), COPYRIGHT, "")
    for old, new in SPELLINGS:
        out = F.regexp_replace(out, old, new.replace("\\1", "$1"))
    return F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "))


def known(spark: SparkSession, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """Rows (digest, license), one for each digest."""
    rows = spark.createDataFrame(texts or known_texts(), "license string, text string")
    return rows.select(F.sha2(canonical(F.col("text")).cast("binary"), 256).alias("digest"), "license").groupBy("digest").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, digests: DataFrame, trigger: str | None = None) -> DataFrame:
    """Rows (doc_id, line, license): a whole text (line 0) or a line (from 1) whose canonical form is a known licence's.

    trigger: a pattern that every text with a digest of ``digests`` matches, to pass others over quickly; without one every
    text and line is looked up. A null or empty text matches nothing; a null id stays null; repeated rows each give their
    rows; a text of one line gives a row for itself and one for its line. A very long text is brought to canonical form
    whole, in memory that grows with it. Other columns are not read; an empty table gives an empty result.
    """
    fits = lambda c: F.col(c).rlike(trigger) if trigger else F.col(c) != ""
    some = docs.select("doc_id", "text").filter(fits("text"))
    units = F.concat(F.array("text"), F.split("text", "\n", -1))
    units = some.select("doc_id", F.posexplode(units).alias("line", "unit")).filter(fits("unit"))
    units = units.select("doc_id", F.col("line").cast("long").alias("line"), F.sha2(canonical(F.col("unit")).cast("binary"), 256).alias("digest"))
    small = F.broadcast(digests) if digests.count() <= BROADCAST_ROWS else digests
    return units.join(small, "digest").select("doc_id", "line", "license")


def op2_licenses(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), known(spark), TRIGGER)


def _canonical_sql(text: str) -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    out = f"regexp_replace(lower({text}), {quoted(COPYRIGHT)}, '', 'g')"
    for old, new in SPELLINGS:
        out = f"regexp_replace({out}, {quoted(old)}, {quoted(new)}, 'g')"
    return f"trim(regexp_replace({out}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


ORACLE_SQL = f"""
with known as (
  select digest, min(license) as license from (
    select license, sha256({_canonical_sql('text')}) as digest from (values {', '.join("('%s', '%s')" % (a, b.replace("'", "''")) for a, b in known_texts())}) as k(license, text)) group by 1),
units as (
  select doc_id, 0 as line, text as unit from documents
  union all
  select doc_id, i as line, lines[i] as unit from (select doc_id, string_split(text, chr(10)) as lines from documents where text is not null), unnest(range(1, len(lines) + 1)) u(i))
select doc_id, line::bigint as line, license from (select doc_id, line, sha256({_canonical_sql('unit')}) as digest from units where unit is not null) join known using (digest)
"""
