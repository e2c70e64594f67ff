"""License scans by canonical digest.

A text is brought to a canonical form (letters folded, punctuation and white space as single spaces, title
and copyright lines left out, spelling variants made equal) that doesn't depend on where lines were
wrapped. Its digest is looked up among those of known licences by a hash join; each line is looked up among the
known one-line notices. All of it is DataFrame expressions: one pass over the texts, no shuffle of them, and a
lookup table of fixed size.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# fixed values: words that licence matching treats as equal
SPELLINGS = [
    ("acknowledgement", "acknowledgment"),
    ("acknowledgements", "acknowledgments"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("copyright holder", "copyright owner"),
    ("copyright holders", "copyright owners"),
    ("favour", "favor"),
    ("fulfil", "fulfill"),
    ("https", "http"),
    ("licence", "license"),
    ("licences", "licenses"),
    ("merchantibility", "merchantability"),
    ("non commercial", "noncommercial"),
    ("non infringement", "noninfringement"),
    ("organisation", "organization"),
    ("organisations", "organizations"),
    ("per cent", "percent"),
    ("sub license", "sublicense"),
    ("sub licence", "sublicense"),
]

NOT_A_WORD = "[^\\p{L}\\p{N}\\n]+"
# fixed values: lines of this form, in canonical words, name the holder and not the licence
HOLDER_LINE = "^((c )?(portions )?copyright (c|year|yyyy|[0-9]{4})|all rights reserved|c [0-9]{4})( |$)"
# and these do where a paragraph begins, or below a title or another such line, unless they go on as a body does
HOLDER_NAME = "^(c )?(portions )?copyright ."
NO_NAME = "^(c )?(portions )?copyright ((notice|holder|owner|law|licen[cs]e|statement|interest|permission|disclaimer)s?( |$)|(and|or|in|on|is|of|to|for)( |$))"
ABOVE_HOLDER = "^$|^all rights reserved( |$)|^([^ ]+ ){0,5}licen[cs]e( [^ ]+)?$"
# fixed values: first lines that are a licence's title
TITLE = (
    "^(the )?((new|modified|revised|simplified|free) )?(mit|expat|x11|isc|bsd|freebsd|zlib|libpng|zlib libpng|apache|boost software|0bsd)"
    "( ([0-4]|zero|two|three)( clause)?)?( software)? licen[cs]e( (mit|expat|isc|bsd|0bsd|zlib|bsd [0-4] clause))?$|^(the )?([0-4]|two|three) clause bsd licen[cs]e$"
)

# fixed values: known licence texts
_WARRANTY_MIT = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_WARRANTY_ISC = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_PERMISSION_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

"""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""

TEXTS = [
    ("MIT", _PERMISSION_MIT + _WARRANTY_MIT),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _WARRANTY_ISC),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _WARRANTY_ISC),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + "\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n" + _BSD_TAIL),
    ("Zlib", _ZLIB),
    ("Apache-2.0", _APACHE_NOTICE),
]
# the same with bullets instead of numbers
TEXTS += [(name, "\n".join(line[3:] if line[1:3] == ". " else line for line in text.split("\n"))) for name, text in TEXTS if "\n1. " in text]

# fixed values: one-line notices
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Released under the ISC License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
]

#: What the canonical form of every one-line notice contains, whatever its spelling.
IN_NOTICES = "licen"

# fixed values: digests of the canonical forms of longer licences, as they are commonly distributed; of those that end
# with advice on how to apply them, also without it
DIGESTS = [
    ("Apache-2.0", "d711f2e1f1a0c8a5ca17e04167d59ac7b855cdd2bb99a9c7b6a8179bedd754c9"),
    ("Apache-2.0", "5792cda8f223cf3e87d9017905b9c47d0ee85ae03e873648472da2425f818c33"),
    ("Artistic-1.0-Perl", "bc4d0c00d493021b9f3b1041689fa28b4bf980cf2e37601f7cb475a7265e3b93"),
    ("CC0-1.0", "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e"),
    ("GFDL-1.2-only", "66919c3537107c2c9f5219f6ba4c41fe9c0d7c14d885087e3db69494463a778e"),
    ("GFDL-1.2-only", "34738b9a072492708a34dddfc9f2baa861ec80e1ff253c2560619abc4cea967b"),
    ("GFDL-1.3-only", "525fd4384869c81c4cbd264822942ae15202284aed28fb120ba01fc119dda9ff"),
    ("GFDL-1.3-only", "045715bb0fee0c933adcaaa9eba95b71a133fefd13049e27bf6ff019ba15dc72"),
    ("GPL-1.0-only", "37f380f152339f34a15db620545eb53f0b5c7d9e6a9542aa09ed0d22f186920f"),
    ("GPL-1.0-only", "3b5b36de4a3801680b9eb44e80739b3aeb71c4bf6ca623ee5f87b2e2b03d3ed9"),
    ("GPL-2.0-only", "ae2be2aaa68f5e52ef402874fc8c7c691879b445cb12e49d84f88168cc2d7dd6"),
    ("GPL-2.0-only", "a76cc6ce70778ba70e43b9b1838f9e3f88b3fc7c5acbb3b8a9847918003b63e0"),
    ("GPL-3.0-only", "f261b435eb8567cdf85af2d75ff64fc410ffd6736a25e4e3decf53444c84954b"),
    ("GPL-3.0-only", "37c56603f4e31b2543cd5b0af6f397ee80a8395704359e942e53728d5c3a84ff"),
    ("LGPL-2.0-only", "bea988245c65edbddad6f43ff12ca2472c232324e916d42648b90eac944d833e"),
    ("LGPL-2.0-only", "7d5246cc24a9d78fffd01a07fbc2e71edd1e94ad8d403f3180a4cf5fef43d389"),
    ("LGPL-2.1-only", "ed875dac9045cba09a17867210991f3a4a82f80b82096b054560a3a8dae9d692"),
    ("LGPL-2.1-only", "65484d3c9f900f96945bd4e6c5397aaa24f93bdc8f720eae06fbd377c62cfe97"),
    ("LGPL-3.0-only", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "cbbde7eeab9b4d180dc00b34252f800e97fb1cddbab38ed8c0c73b956dc2cbf6"),
    ("MPL-1.1", "80cd52a1836f5ea3706bd2afa402fc448999d4a22581ee62d4041bd8a08efd87"),
    ("MPL-2.0", "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),
    ("MPL-2.0", "075fcdf87448c49dbad8c5f7963f0eb6907a3d8eae1b431ba2988508499ec0de"),
]


def canonical_lines(text: Column) -> Column:
    """The words of each line, without empty lines, those that name the holder and a title; none of a null."""
    text = F.coalesce(text, F.lit(""))
    text = F.when(F.contains(text, F.lit("\u00a9")), F.replace(text, F.lit("\u00a9"), F.lit("(c)"))).otherwise(text)
    plain = F.regexp_replace(F.translate(text, UPPER, LOWER), NOT_A_WORD, " ")
    lines = F.transform(F.split(plain, "\n", -1), lambda x: F.trim(x))
    lines = _once(lines, lambda xs: F.when(F.exists(xs, lambda x: x.rlike(HOLDER_NAME)), _unnamed(xs)).otherwise(xs))
    lines = F.filter(lines, lambda x: (x != "") & ~x.rlike(HOLDER_LINE))
    return _once(lines, lambda xs: F.when(F.get(xs, F.lit(0)).rlike(TITLE), F.slice(xs, F.lit(2), F.size(xs))).otherwise(xs))


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of the value, which is evaluated once however often f looks at it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _unnamed(lines: Column) -> Column:
    """The lines with '' for those that name a holder without a year."""

    def names(x: Column) -> Column:
        return x.rlike(HOLDER_NAME) & ~x.rlike(NO_NAME)

    def kept(x: Column, k: Column) -> Column:
        above = F.coalesce(F.get(lines, k - 1), F.lit(""))
        return F.when(names(x) & (above.rlike(ABOVE_HOLDER) | names(above)), "").otherwise(x)

    return F.transform(lines, kept)


def _apart(words: str) -> str:
    """Words with two spaces between and one around them, as `spelled` finds them."""
    return f" {words.replace(' ', '  ')} "


def spelled(words: Column) -> Column:
    """Words with single spaces between, variants replaced by the chosen spelling where they are whole words."""
    variants = [x for x, _ in SPELLINGS]
    some = F.contains(words, F.lit(variants[0]))
    for x in variants[1:]:
        some = some | F.contains(words, F.lit(x))
    out = F.concat(F.lit(" "), F.replace(words, F.lit(" "), F.lit("  ")), F.lit(" "))
    for variant, chosen in SPELLINGS:
        out = F.replace(out, F.lit(_apart(variant)), F.lit(_apart(chosen)))
    return F.when(some, F.trim(F.replace(out, F.lit("  "), F.lit(" ")))).otherwise(words)


def canonical(lines: Column) -> Column:
    """The canonical form of canonical lines, wherever they were wrapped."""
    return spelled(F.array_join(lines, " "))


def _literals(spark: SparkSession, pairs: list[tuple[str, str]]) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(a).alias("license"), F.lit(b).alias("text")) for a, b in pairs))).alias("x")).select("x.*")


def known_digests(spark: SparkSession, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """(canonical_sha256, license) of known texts; by default the built-in ones and DIGESTS."""
    known = _literals(spark, TEXTS + NOTICES if texts is None else texts)
    digests = known.select(F.sha2(canonical(canonical_lines(F.col("text"))), 256).alias("canonical_sha256"), "license")
    if texts is None:
        digests = digests.union(_literals(spark, DIGESTS).select("text", "license"))
    return digests.groupBy("canonical_sha256").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_canonical, canonical_sha256, license, n_license_lines and line_licenses for each row.

    license: that of the entire text, null if it isn't a known one (the empty text never is).
    line_licenses: the licences of known one-line notices among the lines, sorted and joined by commas
    ('' if none). `known` (canonical_sha256, license) is joined by hash; Spark broadcasts it if it is small.
    Null texts are empty; repeated rows are scanned each; other columns of docs are left out.
    """
    spark = docs.sparkSession
    known = known_digests(spark) if known is None else known
    notices = {b: a for a, b in reversed(NOTICES)}
    keys = spark.range(1).select(F.array(*(canonical(canonical_lines(F.lit(b))) for b in notices))).first()[0]  # as literals: Spark would work them out again for each line
    table = F.map_from_arrays(F.array(*map(F.lit, keys)), F.array(*map(F.lit, notices.values())))
    lines = docs.select(F.col(id_col).alias("doc_id"), canonical_lines(F.col(text_col)).alias("_lines"))
    likely = F.filter("_lines", lambda x: F.contains(x, F.lit(IN_NOTICES)))
    found = F.filter(F.transform(likely, lambda x: F.try_element_at(table, spelled(x))), lambda x: x.isNotNull())
    digests = lines.select("doc_id", canonical(F.col("_lines")).alias("_whole"), found.alias("_found"))
    digests = digests.select("doc_id", F.length("_whole").cast("long").alias("n_canonical"), F.sha2("_whole", 256).alias("canonical_sha256"), F.size("_found").cast("long").alias("n_license_lines"), F.array_join(F.array_sort(F.array_distinct("_found")), ",").alias("line_licenses"))
    return digests.join(known, "canonical_sha256", "left").select("doc_id", "n_canonical", "canonical_sha256", "license", "n_license_lines", "line_licenses")


def oracle() -> str:
    """DuckDB SQL for scan(documents)."""

    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    def canon(lines: str) -> str:
        out = f"' ' || replace(array_to_string({lines}, ' '), ' ', '  ') || ' '"
        for variant, chosen in SPELLINGS:
            out = f"replace({out}, '{_apart(variant)}', '{_apart(chosen)}')"
        return f"trim(replace({out}, '  ', ' '))"

    plain = f"regexp_replace(translate(replace(coalesce(text, ''), chr(169), '(c)'), '{UPPER}', '{LOWER}'), '{NOT_A_WORD}', ' ', 'g')"
    above = "CASE WHEN i > 1 THEN ls[i - 1] ELSE '' END"

    def names(x: str) -> str:
        return f"regexp_matches({x}, '{HOLDER_NAME}') AND NOT regexp_matches({x}, '{NO_NAME}')"

    unnamed = f"list_transform(ls, lambda x, i: CASE WHEN {names('x')} AND (regexp_matches({above}, '{ABOVE_HOLDER}') OR {names(above)}) THEN '' ELSE x END)"
    body = f"list_filter({unnamed}, lambda x: x <> '' AND NOT regexp_matches(x, '{HOLDER_LINE}'))"
    values = ", ".join(f"({quoted(a)}, {quoted(b)}, {int(k >= len(TEXTS))})" for k, (a, b) in enumerate(TEXTS + NOTICES))
    digests = ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in DIGESTS)

    def lines_of(source: str, columns: str) -> str:
        split = f"SELECT {columns}, list_transform(string_split({plain}, chr(10)), lambda x: trim(x)) AS ls FROM {source}"
        kept = f"SELECT {columns}, {body} AS b FROM ({split})"
        return f"SELECT {columns}, CASE WHEN len(b) > 0 AND regexp_matches(b[1], '{TITLE}') THEN b[2:] ELSE b END AS lines FROM ({kept})"

    return f"""
WITH given AS (SELECT * FROM (VALUES {values}) AS t(license, text, notice)),
named AS (SELECT license, notice, {canon("lines")} AS canon FROM ({lines_of("given", "license, notice")})),
known AS (SELECT sha, min(license) AS license FROM (SELECT sha256(canon) AS sha, license FROM named UNION ALL SELECT * FROM (VALUES {digests}) AS d(license, sha)) GROUP BY sha),
notices AS (SELECT canon, min(license) AS license FROM named WHERE notice = 1 GROUP BY canon),
docs AS (SELECT doc_id, lines, {canon("lines")} AS canon FROM ({lines_of("documents", "doc_id")})),
hits AS (SELECT d.doc_id, n.license FROM (SELECT doc_id, {canon("[line]")} AS line FROM (SELECT doc_id, unnest(lines) AS line FROM docs)) d JOIN notices n ON n.canon = d.line),
per_doc AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS names FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(length(d.canon) AS BIGINT) AS n_canonical, sha256(d.canon) AS canonical_sha256,
  k.license, CAST(coalesce(p.n, 0) AS BIGINT) AS n_license_lines, coalesce(p.names, '') AS line_licenses
FROM docs d LEFT JOIN known k ON k.sha = sha256(d.canon) LEFT JOIN per_doc p ON p.doc_id = d.doc_id
"""
