"""License scans by canonical digest, in DataFrame functions only.

A text is made canonical: lower case, without copyright lines, one spelling for
words that have several, punctuation and white space as single spaces.  Its SHA-256
digest is joined with the digests of known licenses.  Two kinds of text are looked
up: whole documents, and every whole line of a document, which finds short notices
within other prose.  Nothing is matched in part.  Long licenses are known by their
digests alone; these are compared with whole documents only.

The known digests are broadcast while there are at most ``BROADCAST_LICENSES`` of
them; beyond that Spark joins by shuffle.

Defined results: a null text has a null digest and no license; texts and lines
without letters or digits match nothing; of several licenses with one canonical
text the least id counts for a whole document, and all are listed for lines;
repeated rows are each listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import storage

BROADCAST_LICENSES = 100_000

# Stems with two spellings, and phrases that mean the same (from, to).
SPELLINGS = [
    ("licenc", "licens"),
    ("sub licens", "sublicens"),
    ("sub-licens", "sublicens"),
    ("authoris", "authoriz"),
    ("organis", "organiz"),
    ("recognis", "recogniz"),
    ("initialis", "initializ"),
    ("utilis", "utiliz"),
    ("favour", "favor"),
    ("honour", "honor"),
    ("artefact", "artifact"),
    ("fulfil ", "fulfill "),
    ("whilst", "while"),
    ("per cent", "percent"),
    ("non commercial", "noncommercial"),
    ("copyright owner", "copyright holder"),
    ("acknowledgement", "acknowledgment"),
    ("judgement", "judgment"),
]

_COPYRIGHT_LINE = r"(^|\n)[^\p{L}\p{N}\n(©]*(copyright|\(c\)|©|all[ \t]+rights[ \t]+reserved)[^\n]*"
_PUNCTUATION = r"[^\p{L}\p{N}]+"


def _marked(low: Column) -> Column:
    return low.contains("copyright") | low.contains("(c)") | low.contains("©") | low.contains("rights")


def spelled(x: Column) -> Column:
    """One spelling for words that have several."""
    for old, new in SPELLINGS:
        x = F.replace(x, F.lit(old), F.lit(new))
    return F.trim(x)


def with_digest(rows: DataFrame, text: str, name: str = "digest") -> DataFrame:
    """A column with the SHA-256 of a text's canonical form; an empty string if nothing is left of it.

    Each step has a column of its own, so that nothing is worked out twice; the
    digest is never null, so that no join asks for it once more.
    """
    x = F.col("__low")
    rows = rows.withColumn("__low", F.lower(F.coalesce(text, F.lit(""))))
    rows = rows.withColumn("__kept", F.when(_marked(x), F.regexp_replace(x, _COPYRIGHT_LINE, "$1")).otherwise(x))
    rows = rows.withColumn("__canon", spelled(F.regexp_replace("__kept", _PUNCTUATION, " ")))
    rows = rows.withColumn(name, F.when(F.col("__canon") == "", F.lit("")).otherwise(F.sha2(F.col("__canon").cast("binary"), 256)))
    return rows.withColumn(name, F.coalesce(name, F.lit(""))).drop("__low", "__kept", "__canon")


def opening(text: Column) -> Column:
    """Up to three characters of a text's first word; no change of spelling alters them."""
    return F.lower(F.regexp_extract(text, r"^[^\p{L}\p{N}]*([\p{L}\p{N}]{1,3})", 1))


def known_digests(licenses: DataFrame) -> DataFrame:
    """(digest, license_id, opening) of a table (license_id, text); a license may have several texts."""
    rows = with_digest(licenses.select("license_id", "text"), "text").where("digest <> ''")
    # The canonical text may begin behind copyright lines.
    begin = opening(F.regexp_replace(F.lower("text"), _COPYRIGHT_LINE, "$1"))
    return rows.select("digest", "license_id", begin.alias("opening")).distinct()


def scan(docs: DataFrame, licenses: DataFrame, doc_id: str = "doc_id", text: str = "text", broadcast_licenses: int = BROADCAST_LICENSES, digests: DataFrame | None = None) -> DataFrame:
    """One row per document: (doc_id, digest, license_id, notices): the whole text's digest and license, and the sorted licenses of its lines.

    ``digests`` is a table (license_id, digest) of further canonical texts, for whole documents.
    """
    spark = docs.sparkSession
    known = storage.materialise(known_digests(licenses), spark, "licenses")
    texts = known.select("digest", "license_id")
    if digests is not None:
        texts = storage.materialise(texts.union(digests.select("digest", "license_id")), spark, "license-digests")
    small = texts.count() <= broadcast_licenses
    near = (lambda df: F.broadcast(df)) if small else (lambda df: df)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    # A line can only be a license that opens as it does: most go before they are made canonical.
    lines = rows.select("doc_id", F.xxhash64("text").alias("key"), F.explode(F.split("text", "\n")).alias("line"))
    lines = lines.withColumn("opening", F.coalesce(opening(F.col("line")), F.lit(""))).join(near(known.select("opening").distinct()), "opening", "left_semi")
    # Those left meet the known digests where they are read; only the few that match are shuffled.
    found = with_digest(lines, "line").join(near(known.select("digest", "license_id").distinct()), "digest").groupBy("doc_id", "key").agg(F.array_sort(F.collect_set("license_id")).alias("notices"))
    found = found.select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), "notices")
    least = texts.groupBy("digest").agg(F.min("license_id").alias("license_id"))
    whole = with_digest(rows.select("doc_id", "text", F.xxhash64("text").alias("key")), "text").join(near(least), "digest", "left")
    joined = whole.join(found, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("key") == F.col("__key")), "left")
    return joined.select("doc_id", F.when(F.col("digest") != "", F.col("digest")).alias("digest"), "license_id", F.coalesce("notices", F.array().cast("array<string>")).alias("notices"))


def known_licenses(spark: SparkSession) -> DataFrame:
    """The built-in table (license_id, text)."""
    return spark.createDataFrame(LICENSES, "license_id string, text string")


def whole_texts(spark: SparkSession) -> DataFrame:
    """The built-in table (license_id, digest) of long licenses."""
    return spark.createDataFrame(DIGESTS, "license_id string, digest string")


# Public license texts and customary notices.
LICENSES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "MIT License"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("BSD-3-Clause", "Released under the 3-Clause BSD License."),
    (
        "MIT",
        """MIT License

Copyright (c) <year> <holders>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "ISC",
        """ISC License

Copyright (c) <year> <holders>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    (
        "0BSD",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    (
        "BSD-2-Clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
    (
        "BSD-3-Clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
    (
        "Unlicense",
        """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org/>""",
    ),
]
# SHA-256 of the canonical forms of further public license texts, whole, with their appendices;
# of MIT and ISC, without a title.
DIGESTS = [
    ("Apache-2.0", "ebc600199db9838b4fc2d5288a12598c2702142177a89b3443f5cc87b137d94b"),
    ("Artistic-1.0-Perl", "ddb49d591ecc4f65a223b9f53f330918100c323532a653c090d21b38e35a3a42"),
    ("BSD-3-Clause", "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "835e93c269f96ffb287b3c8c1c5d41482a48fe84971237b192ae3d0f85299142"),
    ("GFDL-1.3", "2d23a1792689607291f114da9fdb3b413c6ef2346dfb9e4fafe0c5cf9b969da3"),
    ("GPL-1.0", "9e12a40a9b22c45d116f19e1746b08ea0b853519de3e03ceb780f2a36d5f388c"),
    ("GPL-2.0", "b866f5427b78991db8012466b32f51c907f5e974fde5129a47372d0d0552e3a1"),
    ("GPL-3.0", "5272fb2d9117cba4ebb1b4a6612e61ab05ddddeff56bd30c3ac3798e23821b30"),
    ("ISC", "217da0747cec63a2e734185db11cbaa819bcd9e5b83cd12f812128fffe66e26a"),
    ("LGPL-2.0", "b4114daa3dfa52e27e78b2c4e17acd58bf4381e812762f4ded0bcb8eabd1092c"),
    ("LGPL-2.1", "294fb9ec58649c7eb0cf90fc2900ac1b28b82fb6da9d40d7599d6b7d399d4d2e"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MIT", "0cf21bdfd1964a97a8615e128534845826afbc887edc95aa5c925cbf64386b5c"),
    ("MPL-1.1", "1cfb6cca26abe2169c9c61164807107b2d4a0b64955a2cf2de46fad3483acda1"),
    ("MPL-2.0", "9e79a7d513376f6fa1500e4df4f6276c6e7e61c5c3e28dcdb1acee24033acc56"),
]
