"""Licence scans by canonical digest.

A text is brought to a canonical form and its SHA-256 is joined to the digests of
known licence texts. The form drops what varies between copies of one licence: case,
punctuation of any script's quotes and dashes, line breaks and comment marks, copyright lines (a line that begins with a copyright mark and has a year, a
sign or a name; the words "copyright notice" at a wrapped line's start are text), "all rights reserved", a title ("MIT License") at the head, and spellings
that licences treat as equal ("licence"/"license", "noncommercial"/"non-commercial"). It is a list of steps that both Spark and DuckDB run.

Only entire texts match; a licence quoted inside a document is another text.

Edge cases: null and empty texts have the digest of the empty form and match
nothing; repeated rows stay rows of their own; an empty table gives no rows; a very long text is brought to its form whole. Only the two named columns are
read. The known texts are a fixed list of a few rows, so they are broadcast.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The parts of the BSD texts.
BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
BSD_SOURCE = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
BSD_BINARY = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
# Published texts of short public licences and notices, without their copyright lines.
KNOWN = {
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "Apache-2.0 notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "MIT-0": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "BSD-1-Clause": BSD_HEAD + BSD_SOURCE + BSD_TAIL,
    "BSD-2-Clause": BSD_HEAD + BSD_SOURCE + BSD_BINARY + BSD_TAIL,
    "BSD-3-Clause": BSD_HEAD + BSD_SOURCE + BSD_BINARY + "3. " + BSD_NAMES + BSD_TAIL,
    "Unlicense": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org>""",
    "BSL-1.0": """Boost Software License - Version 1.0 - August 17th, 2003
Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "WTFPL": """DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
Version 2, December 2004
Copyright (C) 2004 Sam Hocevar <sam@hocevar.net>
Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.
DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION
0. You just DO WHAT THE FUCK YOU WANT TO.""",
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0.",
    "MIT line": "Released under the MIT License.",
    "GPL-3.0 line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 line": "Licensed under CC BY-NC 4.0.",
}
#: The same with marks instead of numbers before their clauses, which leave nothing in the form.
UNNUMBERED = {name: KNOWN[name].replace("1. ", "").replace("2. ", "").replace("3. ", "") for name in ("BSD-2-Clause", "BSD-3-Clause")}
# SHA-256 of the forms of the whole texts in Debian's /usr/share/common-licenses (Apache-2.0 with its appendix and without) -> SPDX name.
FULL: dict[str, str] = {
    "ded3ea6b0db12d61282638699c151f69bf8e8237755603f95e3d24ca4959d707": "Apache-2.0",
    "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702": "Artistic-1.0-Perl",
    "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651": "BSD-3-Clause-UC",
    "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f": "CC0-1.0",
    "fdbd790ae9850ae81a2c777de181b7ceb77f56f8916bab9409c3a7724c8f131a": "GFDL-1.2",
    "9af8b09a25e07e574718758cdf5a64581433b2e9f0cd27bd6665cce5b182563b": "GFDL-1.3",
    "7878062f794b46596688d78e1045d354ccd347d0bfe6c5c557ba7db789180abe": "GPL-1.0",
    "72b4215107895cc5d84fa72777e9663242c462bbf98ca94191cb3717b79fcbd8": "GPL-2.0",
    "ab0ff01b5102d67da216e91690a50504aebf46513a85db94155933b2db63283f": "GPL-3.0",
    "b64047590f42a52d46a8a93fad9485df2e189694e4b51288546e57ce10e59769": "LGPL-2.0",
    "bc7898eef7d53923eff574c7a898468049b8e1e90eef19ba0b8132904dd70a66": "LGPL-2.1",
    "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be": "LGPL-3.0",
    "118b2c814d7e3fa57c85f71b240c6a47d353e8acce9164ed6f28305ba85202b2": "MPL-1.1",
    "2ae5d4417f09cff2e3412d0e35c4ee2439f6c18ca69d7d9cc799b33614c368a5": "MPL-2.0",
    "72e03ef603383ce8aa9e1eb496515a41b702608af74be9a430293ff315796337": "Apache-2.0",
}
# Fixed values: (spelling, canonical spelling), on canonical words, in the order in which they apply.
EQUIVALENT = [
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("authorisation", "authorization"), ("authorised", "authorized"), ("favour", "favor"), ("fulfil", "fulfill"), ("initialise", "initialize"),
    ("judgement", "judgment"), ("labour", "labor"), ("licence", "license"), ("licences", "licenses"), ("noncommercial", "non commercial"), ("noninfringement", "non infringement"), ("organisation", "organization"), ("percent", "per cent"), ("sub license", "sublicense"), ("sublicence", "sublicense"),
    ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"), ("https", "http"), ("copyright owner", "copyright holder"), ("copyright owners", "copyright holder"), ("copyright holders", "copyright holder"), ("all rights reserved", ""),
]
_FROM = "‘’‚‛“”„‟«»‐‑‒–—―−\u00a0\u2002\u2003\u2009\u202f…•·\ufeff\r"
_TO = "'" * 4 + '"' * 6 + "-" * 7 + " " * 9 + "\n"
#: Words behind "Copyright" that make a sentence of it, and no line of a holder.
SENTENCE = "(Holder|Notice|Owner|Licen|Law|Act|Statement|And|Or|In)"
YEAR = r"([0-9]{4}|<year>|\[year\]|\[yyyy\]|\{yyyy\})"
COPYRIGHT = rf"(^|\n)[ \t#*/;%-]*(Copyright[ \t]+[A-Z][^\n]*|(?i:copyright|\(c\)|©)[^\n]*{YEAR}[^\n]*|(?i:©|copyright[ \t]*(\(c\)|©|:|by[ \t]))[^\n]*)"
_CLAUSES = "(zero|one|two|three|four|[0-4])"
TITLE = rf"^(the )?(mit no attribution|mit 0|mit|expat|isc|zlib|x11|0bsd|(original |new |revised |simplified |modified )?bsd( {_CLAUSES} clause| zero clause)?|{_CLAUSES} clause bsd|unlicense)( or)?( new| revised| simplified| modified| original| or)* license( mit| isc| zlib| expat| 0bsd| mit 0| bsd {_CLAUSES} clause)? "
#: (kind, what, by): the steps from a text to its form. Words stand between two spaces each, so that neighbours are both replaced.
STEPS = [
    ("translate", _FROM, _TO),
    ("regex", rf"Copyright([ \t]+){SENTENCE}", "copyright{1}{2}"),
    ("regex", COPYRIGHT, "\n"),
    ("translate", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"),
    ("wrap", "\n", "\n"),
    ("regex", "[\\x00-/:-@\\[-`{-\\x7f]+", "  "),
    *(("replace", f" {a.replace(' ', '  ')} ", f" {b.replace(' ', '  ')} ") for a, b in EQUIVALENT),
    ("regex", " +", " "),
    ("trim", "", ""),
    ("regex", TITLE, ""),
]


def canonical(text: Column) -> Column:
    """The canonical form of a text column."""
    out = F.coalesce(text, F.lit(""))
    for kind, what, by in STEPS:
        if kind == "translate":
            out = F.translate(out, what, by)
        elif kind == "regex":
            out = F.regexp_replace(out, F.lit(what), F.lit(by.replace("{1}", "$1").replace("{2}", "$2")))
        elif kind == "replace":
            out = F.replace(out, F.lit(what), F.lit(by))
        else:
            out = F.concat(F.lit(what), out, F.lit(by)) if kind == "wrap" else F.trim(out)
    return out


def canonical_sql(text: str) -> str:
    """The same form in DuckDB SQL."""
    quote = lambda s: "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '").replace("\r", "' || chr(13) || '") + "'"
    out = f"coalesce({text}, '')"
    for kind, what, by in STEPS:
        if kind == "translate":
            out = f"translate({out}, {quote(what)}, {quote(by)})"
        elif kind == "regex":
            out = f"regexp_replace({out}, {quote(what)}, {quote(by.replace('{1}', chr(92) + '1').replace('{2}', chr(92) + '2'))}, 'g')"
        elif kind == "replace":
            out = f"replace({out}, {quote(what)}, {quote(by)})"
        else:
            out = f"({quote(what)} || {out} || {quote(by)})" if kind == "wrap" else f"trim({out}, ' ')"
    return out


def known_licences(spark: SparkSession) -> DataFrame:
    """(digest, licence) of the known texts, in canonical form."""
    texts = spark.createDataFrame([*KNOWN.items(), *UNNUMBERED.items()], "licence string, text string")
    own = texts.select(F.sha2(canonical(F.col("text")), 256).alias("digest"), "licence")
    return own.unionByName(spark.createDataFrame([(d, n) for d, n in FULL.items()], "digest string, licence string"))


def digests(texts: DataFrame) -> DataFrame:
    """(digest, licence) of further texts (licence, text), for scan()."""
    return texts.select(F.sha2(canonical(F.col("text")), 256).alias("digest"), "licence").dropDuplicates(["digest"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: DataFrame | None = None) -> DataFrame:
    """One row per document: doc_id, digest (of the whole canonical text), canonical_chars, licence (null: none known).

    ``known``: (digest, licence) with distinct digests, instead of the fixed list; Spark chooses its join by size.
    """
    form = docs.select(F.col(id_col).cast("long").alias("doc_id"), canonical(F.col(text_col)).alias("form"))
    rows = form.select("doc_id", F.sha2("form", 256).alias("digest"), F.length("form").cast("long").alias("canonical_chars"))
    table = F.broadcast(known_licences(docs.sparkSession)) if known is None else known.select("digest", "licence")
    return rows.join(table, "digest", "left").select("doc_id", "digest", "canonical_chars", "licence")
