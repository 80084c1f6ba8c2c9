"""License scans by canonical digests, in DataFrame operations only.

A text is brought to a canonical form: A-Z to lower case, equivalent spellings to one, lines
that only state a copyright out, all but letters and digits to single spaces. The digest of the
entire canonical text is looked up among those of the known licences by a hash join. The same is done
for each line of a text, which finds licence notices.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, table, written

# Texts of public licences and usual notices; copyright lines are left out, as they are when scanned.
_PERMIT = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
)
_ISC_END = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
    "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
    "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
    "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
    "conditions are met: {0}Redistributions of source code must retain the above copyright notice, this list of conditions and the "
    "following disclaimer. {1}Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
    "the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_NAME = (
    "{2}Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
    "from this software without specific prior written permission. "
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT '
    "NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL "
    "THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
    "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
    "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE "
    "OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
    "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product "
    "documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. "
    "3. This notice may not be removed or altered from any source distribution."
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form "
    "or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any "
    "and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend "
    "this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. "
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND '
    "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
    "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org>"
)
_BSL = (
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, "
    "reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all "
    "subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in "
    "all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code "
    'generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER "
    "IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
KNOWN = (
    ("MIT", _MIT),
    ("MIT", "MIT License " + _MIT),
    ("ISC", f"{_PERMIT}, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_END}"),
    ("0BSD", f"{_PERMIT}. {_ISC_END}"),
    ("BSD-2-Clause", (_BSD_HEAD + _BSD_END).format("1. ", "2. ")),
    ("BSD-2-Clause", (_BSD_HEAD + _BSD_END).format("", "")),
    ("BSD-3-Clause", (_BSD_HEAD + _BSD_NAME + _BSD_END).format("1. ", "2. ", "3. ")),
    ("BSD-3-Clause", (_BSD_HEAD + _BSD_NAME + _BSD_END).format("", "", "")),
    ("Zlib", _ZLIB),
    ("Unlicense", _UNLICENSE),
    ("BSL-1.0", _BSL),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003 " + _BSL),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
)
#: Equivalent spellings, applied to lower-cased text in this order.
SPELLINGS = (("licence", "license"), ("sub-license", "sublicense"), ("non-infringement", "noninfringement"), ("merchantibility", "merchantability"), ("acknowledgement", "acknowledgment"), ("per cent", "percent"), ("https://", "http://"))
#: A line that states a copyright: it begins with the word or the sign (in any comment dress) and has a year, a name or the sign after it.
COPYRIGHT = r"(?m)^[^\p{L}\p{N}\n]*(?:copyright|\(c\)|©)[ \t]*(?:\(c\)|©|[0-9]{4}|by |<)[^\n]*$|^[^\p{L}\p{N}\n]*all rights reserved[. \t\r]*$"


def canonical(text):
    """The canonical form of a text column, in one line; null texts are empty."""
    low = lower_ascii(F.coalesce(text, F.lit("")))
    low = reduce(lambda t, s: F.replace(t, F.lit(s[0]), F.lit(s[1])), SPELLINGS, low)
    bare = F.when(F.contains(low, F.lit("copyright")) | F.contains(low, F.lit("(c)")) | F.contains(low, F.lit("©")) | F.contains(low, F.lit("all rights reserved")), F.regexp_replace(low, COPYRIGHT, "")).otherwise(low)
    return F.trim(F.regexp_replace(bare, r"[^\p{L}\p{N}]+", " "))


def known(spark: SparkSession, texts=KNOWN) -> DataFrame:
    """(digest, license_id) of the known texts: one row per text given."""
    return spark.createDataFrame(list(texts), "license_id string, text string").select(F.md5(canonical(F.col("text"))).alias("digest"), "license_id").distinct()


def scan(docs: DataFrame, licenses: DataFrame) -> DataFrame:
    """(doc_id, license_id, scope, n): licences that the entire text is ("text"), or that n of its lines are ("line").

    licenses has a row per known text and is broadcast: its size is that of the list given. An
    empty canonical form (null, blank or punctuation only) is no licence. Rows of one doc_id
    are counted together.
    """
    known_ = F.broadcast(licenses)
    whole = docs.select("doc_id", F.md5(canonical(F.col("text"))).alias("digest"), F.lit("text").alias("scope"))
    line = docs.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    lines = line.select("doc_id", F.md5(canonical(F.col("line"))).alias("digest"), F.lit("line").alias("scope"))
    return whole.unionByName(lines).join(known_, "digest").groupBy("doc_id", "license_id", "scope").agg(F.count(F.lit(1)).alias("n"))


def op6_license_scan(spark, sf_dir: str) -> DataFrame:
    """One row per document, licence and scope; see scan() for null, empty and repeated rows.

    MIT, ISC, 0BSD, BSD, Zlib, Unlicense and BSL-1.0 are known by their entire texts, Apache, GPL
    and Creative Commons by usual notices only; a caller passes other texts to known().
    """
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"), written(known(spark), "licenses"))


def _sql_canonical(x: str) -> str:
    low = f"translate(coalesce({x}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    for a, b in SPELLINGS:
        low = f"replace({low}, '{a}', '{b}')"
    return rf"trim(regexp_replace(regexp_replace({low}, '{COPYRIGHT}', '', 'g'), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


#: The rows of op6_license_scan.
SQL = f"""
WITH known AS (SELECT DISTINCT license_id, md5({_sql_canonical("text")}) AS digest FROM (VALUES {", ".join("('%s', '%s')" % (i, t.replace("'", "''")) for i, t in KNOWN)}) AS v(license_id, text)),
units AS (
  SELECT doc_id, 'text' AS scope, md5({_sql_canonical("text")}) AS digest FROM documents
  UNION ALL
  SELECT doc_id, 'line' AS scope, md5({_sql_canonical("line")}) AS digest FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents))
SELECT doc_id, license_id, scope, count(*) AS n FROM units JOIN known USING (digest) GROUP BY ALL
"""
