"""Licence scan by canonical digests: normalise a whole text, hash it, join it to the digests of known licences.

Normalising lower-cases, drops copyright lines, maps equivalent spellings to one, and turns every run of other
characters than letters and digits into one space. Equal digests then mean equal wording. Texts that are null or
normalise to nothing have a null digest and match no licence. Rows are kept as they are, with repeated and null ids; the known texts are a parameter
table (name, text), which may hold several texts of one licence; a text that equals several names takes the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spellings that mean the same word, as in the licence matching guidelines of the SPDX project.
SPELLINGS = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact", "authorisation": "authorization",
    "authorised": "authorized", "calibre": "caliber", "cancelled": "canceled", "capitalisations": "capitalizations", "catalogue": "catalog",
    "categorise": "categorize", "centre": "center", "copyright holder": "copyright owner", "emphasised": "emphasized", "favour": "favor",
    "favourite": "favorite", "fulfil": "fulfill", "fulfilment": "fulfillment", "initialise": "initialize", "judgement": "judgment",
    "labelling": "labeling", "labour": "labor", "licence": "license", "licenced": "licensed", "maximise": "maximize", "modelled": "modeled",
    "modelling": "modeling", "non commercial": "noncommercial", "offence": "offense", "optimise": "optimize", "organisation": "organization",
    "organise": "organize", "per cent": "percent", "practise": "practice", "programme": "program", "realise": "realize", "recognise": "recognize",
    "signalling": "signaling", "sub license": "sublicense", "sublicence": "sublicense", "utilisation": "utilization", "whilst": "while", "wilful": "willful",
}

#: Wordings of short public licences and of the notices by which texts name one.
KNOWN = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "notice-MIT": "Released under the MIT License.",
    "notice-Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "notice-GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "notice-CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
}

BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
#: More wordings. The enumeration of BSD conditions is by number, asterisk or hyphen.
MORE = {
    "BSD-2-Clause": BSD_HEAD + BSD_TAIL,
    "BSD-3-Clause": BSD_HEAD + BSD_NAMES + BSD_TAIL,
    "Unlicense": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org>""",
}
#: Title lines with which a licence's text is published.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"), "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "Zlib": ("zlib License", "The zlib License", "The zlib/libpng License"), "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "BSD Zero-Clause License (0BSD)"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", 'BSD 2-Clause "Simplified" License'), "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License'),
    "Unlicense": ("The Unlicense",),
}


#: Digests of the canonical wording of long licences as published; where there are two, the second is of
#: the text up to and with the line END OF TERMS AND CONDITIONS, without the appendix.
LONG = {
    "Apache-2.0": ("045649cdaf85384ba827242062f2f3b36409835c98d297e25177cb1faf7c2847", "108490d21e2d3edc9128233e48fabc169818d0c7c5f0bbdd58231a367d2d6c87"),
    "CC0-1.0": ("96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f",),
    "GFDL-1.3": ("961b6d8afa12e353079f8676ad28084c800a46123e76f7f4f7e7f81df82289dc",),
    "GPL-2.0": ("cf74dfa78ca9ac981c7ae9e50c4ecfb828df2e5ef2f1646368388676215766b5", "c33d2f29477d94c3f3e48ae230c47966a4f4c05a0f6087cf607e1589848d2986"),
    "GPL-3.0": ("50d4bc7394c6bd89b2ec17ed7bbe4d2135d9f88685bbb3c7e130dd23a31ddaff", "f26652974b5fa996c37c31bfe06e91058b0a6e0e25fd201082f3016dc97810e8"),
    "LGPL-2.1": ("ac0856eb11aebb30c08445444c942c1ddcde9d0a0447c9ed2b8a19ab7d51eba5", "2858f5a00f6672bd47f63b69b9bf4e1bc31f3541b08a5a263e59d9b384f72fdc"),
    "LGPL-3.0": ("aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",),
    "MPL-1.1": ("fbe9a0b96f52e03cb474f9a7083781399c011279e85b548118563ec96e659354",),
    "MPL-2.0": ("95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9",),
}


def known_texts() -> list[tuple[str, str]]:
    """(name, text) of all built-in wordings, with and without a title."""
    rows = []
    for name, text in (KNOWN | MORE).items():
        for one in {text, text.replace("\n1. ", "\n* ").replace("\n2. ", "\n* ").replace("\n3. ", "\n* ")} if name.startswith("BSD-") else {text}:
            rows += [(name, one), *((name, f"{title}\n\n{one}") for title in TITLES.get(name, ()))]
    return rows


#: A copyright line: after marks and blanks it begins with the word or sign, or is a rights notice.
COPYRIGHT_LINE = r"^[ \t#*/;>-]*(?:copyright(?: \(c\)| ©)?(?: |:)[^\n]*|\(c\) [^\n]*|© ?[^\n]*|all rights reserved\.?[ \t]*)$"
#: The same without body lines that happen to begin with the word, as wrapped licence texts have them.
BODY = r" +(?:notice|holder|owner|law|license|licence|statement|interest|and|or|in|is|of|to)s?\b"
NOTICE_LINE = COPYRIGHT_LINE.replace("copyright(?:", rf"copyright(?!{BODY})(?:", 1)
OTHER = r"[^\p{L}\p{N}]+"


def canonical(text: Column | str) -> Column:
    """The normalised wording of a text (null: null)."""
    text = F.lower(F.col(text) if isinstance(text, str) else text)
    text = F.regexp_replace(text, f"(?dm){NOTICE_LINE}", "")  # d: only \n ends a line
    # Two spaces between words, so that neighbouring words don't share one when they are looked up.
    text = F.concat(F.lit(" "), F.regexp_replace(text, OTHER, "  "), F.lit(" "))
    for one, other in SPELLINGS.items():
        text = F.replace(text, F.lit(f" {one} ".replace(" ", "  ")[1:-1]), F.lit(f" {other} ".replace(" ", "  ")[1:-1]))
    return F.trim(F.regexp_replace(text, " +", " "))


def digest(text: Column | str) -> Column:
    return F.sha2(F.nullif(canonical(text), F.lit("")), 256)


def known_digests(spark: SparkSession, known: DataFrame | None = None) -> DataFrame:
    """(license_id, digest), one row per digest. ``known``: a table (name, text); the built-in wordings by default."""
    texts = known if known is not None else spark.createDataFrame(known_texts(), "name string, text string")
    rows = texts.select(F.col("name").alias("license_id"), digest("text").alias("digest")).where("digest is not null")
    if known is None:
        rows = rows.unionByName(spark.createDataFrame([(name, x) for name, some in LONG.items() for x in some], "license_id string, digest string"))
    return rows.groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, digest of its canonical wording, licence of that wording (null: none known)."""
    mine = docs.select(F.col(id_col).alias(id_col), digest(text_col).alias("digest"))
    return mine.join(known_digests(docs.sparkSession, known), "digest", "left").select(id_col, "digest", "license_id")


def canonical_sql(text: str) -> str:
    """The same normalising as DuckDB SQL. Its patterns can't look ahead, so lines are tested one by one."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    body = "^[ \\t#*/;>-]*copyright" + BODY
    sql = f"array_to_string(list_filter(string_split(lower({text}), chr(10)), lambda line: NOT regexp_matches(line, {quoted(COPYRIGHT_LINE)}) OR regexp_matches(line, {quoted(body)})), chr(10))"
    sql = f"concat(' ', regexp_replace({sql}, {quoted(OTHER)}, '  ', 'g'), ' ')"
    for one, other in SPELLINGS.items():
        sql = f"replace({sql}, {quoted(f' {one} '.replace(' ', '  ')[1:-1])}, {quoted(f' {other} '.replace(' ', '  ')[1:-1])})"
    return f"trim(regexp_replace({sql}, ' +', ' ', 'g'))"


def scan_sql(docs: str = "documents", id_col: str = "doc_id", text_col: str = "text") -> str:
    """``scan`` with the built-in wordings as DuckDB SQL."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    texts = ", ".join(f"({quoted(name)}, {quoted(text)})" for name, text in known_texts())
    long = ", ".join(f"({quoted(name)}, {quoted(x)})" for name, some in LONG.items() for x in some)
    digest_of = lambda c: f"CASE WHEN {c} IS NOT NULL THEN sha256(nullif({canonical_sql(c)}, '')) END"
    return f"""WITH named AS (SELECT name, {digest_of("text")} AS digest FROM (VALUES {texts}) AS k(name, text) UNION ALL SELECT * FROM (VALUES {long}) AS l(name, digest)),
known AS (SELECT digest, min(name) AS license_id FROM named WHERE digest IS NOT NULL GROUP BY digest),
mine AS (SELECT {id_col}, {digest_of(text_col)} AS digest FROM {docs})
SELECT mine.{id_col}, mine.digest, known.license_id FROM mine LEFT JOIN known ON mine.digest = known.digest"""
