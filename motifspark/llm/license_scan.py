"""Licence texts found by the digest of their canonical form."""

import re
from pathlib import Path

from pyspark.sql import functions as F

#: Spellings that count as equal, the second standing for the first.
SPELLINGS = [
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("licencing", "licensing"), ("sublicence", "sublicense"),
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("artefact", "artifact"), ("authorisation", "authorization"),
    ("authorised", "authorized"), ("behaviour", "behavior"), ("centre", "center"), ("colour", "color"), ("favour", "favor"),
    ("fulfil", "fulfill"), ("judgement", "judgment"), ("noncommercial", "non commercial"),
    ("organisation", "organization"), ("organise", "organize"), ("recognise", "recognize"), ("whilst", "while"), ("wilful", "willful"),
    ("https", "http"), ("holder", "owner"), ("holders", "owners"),
]

#: Fixed values: (licence, kind, text). Notices are the lines by which a document states its licence; texts are whole.
KNOWN = [
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "notice", "Released under the MIT License."),
    ("MIT", "notice", "Licensed under the MIT License."),
    ("GPL-3.0", "notice", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "notice", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "notice", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "notice", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "notice", "Licensed under CC0 1.0."),
    ("BSD-3-Clause", "notice", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("reserved", "notice", "All rights reserved."),
    ("MIT", "text", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR
ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH
THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", "text", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY
DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION,
ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("Unlicense", "text", """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the
software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and
successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software
under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR
OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR
OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""),
]

#: Lines that stand above whole texts, or not.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", "The 2-Clause BSD License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", "The 3-Clause BSD License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License", "BSD License"],
    "Unlicense": ["The Unlicense"],
}
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution.
"""
BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this
software without specific prior written permission.
"""
BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT
HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT
LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY
THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
#: Whole texts in the folder `licenses`, by the number of title lines they begin with.
FILES = {"Apache-2.0": 3, "CC0-1.0": 2, "GPL-2.0": 2, "GPL-3.0": 2, "LGPL-2.1": 2, "LGPL-3.0": 2, "MPL-2.0": 1}
TERMS_END = "END OF TERMS AND CONDITIONS"
APPENDIX_FIELDS = "Copyright [yyyy] [name of copyright owner]"


def whole_texts():
    """(licence, kind, text) of every form in which a whole text is known: with and without titles and what may follow."""
    texts = [(name, text) for name, kind, text in KNOWN if kind == "text"]
    texts += [("ISC", text.replace("and/or distribute", "and distribute")) for name, text in texts if name == "ISC"]
    for name, text in (("BSD-2-Clause", BSD + BSD_END), ("BSD-3-Clause", BSD + BSD_THIRD + BSD_END)):
        for body in (text, re.sub(r"(?m)^[123]\. ", "", text)):
            texts += [(name, body), (name, "All rights reserved.\n\n" + body)]
    texts += [(name, f"{title}\n\n{text}") for name, text in texts for title in TITLES[name]]
    for name, titles in FILES.items():
        text = (Path(__file__).parent / "licenses" / f"{name}.txt").read_text()
        bodies = [text, text.replace(APPENDIX_FIELDS, "")]
        if TERMS_END in text:
            bodies.append(text[: text.index(TERMS_END)])
            bodies.append(bodies[-1] + TERMS_END)
        for body in bodies:
            lines = [line for line in body.split("\n") if re.search("[A-Za-z0-9]", line)]
            texts += [(name, "\n".join(lines[k:])) for k in range(titles + 1)]
    return [(name, "text", text) for name, text in dict.fromkeys(texts)]


KNOWN += [row for row in whole_texts() if row not in KNOWN]

#: A line that holds a copyright statement and no more is dropped.
COPYRIGHT = r"^[ \t]*(copyright|\(c\)|©)[^\n]*[0-9]{4}[^\n]*$"
PUNCTUATION = r"[^a-z0-9\x{80}-\x{10ffff}]+"


def canonical_line(line):
    """Lower case, nothing for a copyright line, punctuation as single spaces, one spelling for equal words."""
    c = F.regexp_replace(F.lower(line), COPYRIGHT, "")
    c = F.concat(F.lit(" "), F.trim(F.regexp_replace(c, PUNCTUATION, " ")), F.lit(" "))
    for one, other in SPELLINGS:
        c = F.replace(c, F.lit(f" {one} "), F.lit(f" {other} "))
    return F.trim(c)


def canonical_lines(text):
    """Canonical form of every line of a text that keeps any letter or digit."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), canonical_line), lambda x: x != "")


def known(spark):
    """(license, kind, digest) of the known texts; one licence per digest."""
    rows = spark.createDataFrame(KNOWN, "license string, kind string, text string")
    return rows.select("license", "kind", F.sha2(F.array_join(canonical_lines(F.col("text")), " "), 256).alias("digest")).dropDuplicates(["digest"])


def scan(docs, licenses=None):
    """doc_id, digest, license, n_notices and licenses of every row.

    `digest` is that of the canonical whole text, `license` the known text it equals or null. Every line is looked up as
    well: n_notices counts the lines that are a known licence, `licenses` has their names, in order and comma-joined.
    `licenses` as an argument are the known (license, digest), by default `known`. Null text is empty; texts and lines
    without letters or digits match nothing. Repeated rows stay, and other columns are not read.
    """
    licenses = (known(docs.sparkSession) if licenses is None else licenses).select("license", "digest").where("digest is not null").dropDuplicates(["digest"])
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", F.sha2(text, 256).alias("copy"), canonical_lines(text).alias("lines"))
    some = F.size("lines") > 0
    whole = rows.select("doc_id", "copy", F.sha2(F.array_join("lines", " "), 256).alias("digest"), some.alias("any"))
    whole = whole.join(licenses, "digest", "left")
    lines = rows.select("copy", F.posexplode("lines").alias("at", "line")).select("copy", "at", F.sha2("line", 256).alias("digest"))
    lines = lines.join(licenses, "digest").groupBy("copy").agg(F.count_distinct("at").alias("n_notices"), F.collect_set("license").alias("names"))
    out = whole.join(lines, "copy", "left")
    return out.select("doc_id", "digest", F.when(F.col("any"), F.col("license")).alias("license"), F.coalesce("n_notices", F.lit(0)).alias("n_notices"),
                      F.coalesce(F.array_join(F.array_sort("names"), ","), F.lit("")).alias("licenses"))
