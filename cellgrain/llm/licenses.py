"""Licence scan: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Units of a text are compared with templates of statements, headers and whole licence texts, on three levels:
the whole text; its blocks, which are runs of adjacent comment lines, block comments, and runs of
adjacent lines that are mostly made of the headers' words; and its single lines and sentences. Only units that bear
one of the words every template bears one of (``TRIGGER``) are compared; the whole text is looked through. A unit
becomes a sparse vector of word weights, ``(1 + ln tf) * (ln((1 + n) / (1 + df)) + 1)``, and is compared with
each template by cosine, through a join on words. n and df count the templates and the distinct texts that bear
a trigger word, not texts without one. The best template at ``THRESHOLD`` or above is the unit's licence. The best score decides for the document (origin
``header``, or ``file`` for a licence file), lines and sentences only where neither a block nor the whole
text has a licence, so that a line of a wrapped header doesn't speak for the header.

A licence file (``LICENSE``, ``COPYING``, ... by its name) speaks for its directory. A document
without a licence of its own inherits (origin ``inherited``) from the nearest directory above it that has one:
directories, not documents, are joined with their ancestors, and documents join
their directory's answer, by joins whose hot keys (a directory of very many files, a text that recurs, the root) AQE can split. Of several files in one directory the best score decides, then the name.

Only SQL functions are used. Equal units are weighed once: their words are
taken from distinct units, so a line that very many documents share is one vector.
Templates are a constant list and the only side that is broadcast.

Defined results: a null text counts as empty; a null path is a document in no directory
that never inherits; ties between templates go to the first by name; repeated rows each have
their result; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import pkgutil
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import apart, checkpoint, let

THRESHOLD = 0.55

# Statements by which licences are given, as (SPDX name, text).
TEMPLATES = (
    ("AGPL-3.0", "This program is free software under the terms of the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause Simplified License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause New or Revised License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following license conditions are met."),
    ("CC-BY-4.0", "This work is licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License."),
    ("CC0-1.0", "CC0 1.0 Universal license, dedicated to the public domain."),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "You can redistribute it and modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3."),
    ("ISC", "Released under the ISC license."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software, to deal in the software without restriction, under this license."),
    ("MPL-2.0", "This source code form is subject to the terms of the Mozilla Public License, version 2.0."),
    ("proprietary", "All rights reserved."),
    ("proprietary", "Copyright. All rights reserved."),
    ("Unlicense", "This is free and unencumbered software released into the public domain, the Unlicense license."),
)

_WARRANTY = "This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1} Public License for more details. You should have received a copy of the GNU {1} Public License along with this {0}"
_REDISTRIBUTE = "This {0} is free software; you can redistribute it and/or modify it under the terms of the GNU {1} Public License as published by the Free Software Foundation; either version {2} of the License, or (at your option) any later version."
_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_BSD = "Copyright (c). All rights reserved. Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_GNU = (("GPL-2.0", "program", "General", "2"), ("GPL-3.0", "program", "General", "3"), ("LGPL-2.1", "library", "Lesser General", "2.1"), ("LGPL-3.0", "library", "Lesser General", "3"), ("AGPL-3.0", "program", "Affero General", "3"))

# Whole headers and short licence texts. A GNU header comes with and without its paragraph on warranty.
HEADERS = (
    *((name, _REDISTRIBUTE.format(what, kind, version)) for name, what, kind, version in _GNU),
    *((name, _REDISTRIBUTE.format(what, kind, version) + " " + _WARRANTY.format(what, kind)) for name, what, kind, version in _GNU),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-2-Clause", f"{_BSD} {_AS_IS}"),
    ("BSD-2-Clause", _BSD),
    ("BSD-3-Clause", f"{_BSD} {_BSD_3} {_AS_IS}"),
    ("BSD-3-Clause", f"{_BSD} {_BSD_3}"),
    ("ISC", "ISC License. Copyright (c). Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("MIT", "MIT License. Copyright (c). Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
)

#: Licences whose whole texts lie in ``texts/``.
TEXTS = ("Apache-2.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0")

TRIGGER = r"(?i)licen[sc]e|copyright|all\W+rights\W+reserved|public domain|redistribut|permission\W+is\W+hereby"
SENTENCE = r"[\r\n]+|(?<=[\p{L}\p{N})]\.)\s+(?=\p{Lu})"
LICENCE_FILE = r"(?i)^(un)?licen[sc]es?([.-].*)?$|^copying([.-].*)?$|^copyright([.-].*)?$|^notice([.-].*)?$"


def _tokens(statement: Column) -> Column:
    return F.filter(F.split(F.lower(statement), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _words(text: str) -> list[str]:
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


#: The words of statements and headers. A line is a licence line if at least this share of its words is among them.
HEADER_WORDS, HEADER_SHARE = tuple(sorted({w for _, text in (*TEMPLATES, *HEADERS) for w in _words(text)})), 0.6

COMMENT = r"[ \t]*(?:/{2,}|/\*|\*|#|;|--|<!--|%)"
BLOCK_COMMENT = r'(?s)/\*.*?\*/|<!--.*?-->|""".*?"""'


def templates() -> list[tuple[str, str]]:
    """(name, text) of statements, headers and whole licence texts."""
    return [*TEMPLATES, *HEADERS, *((name, pkgutil.get_data(__package__, f"texts/{name}.txt").decode()) for name in TEXTS)]


def _first() -> Column:
    """Orders licences: those of blocks and whole texts before those of lines, by score, the best first, then by name."""
    return F.struct(F.col("level") == 0, -F.col("score"), F.col("license"))


def _runs(lines: Column, belongs) -> Column:
    """Runs of adjacent lines that belong together, joined; lines that don't are left out."""
    marked = F.transform(lines, lambda x: F.when(belongs(x), x).otherwise(F.lit("\x00")))
    return F.split(F.array_join(marked, "\n"), "\x00")


def _licence_line(line: Column) -> Column:
    known = F.array(*[F.lit(w) for w in HEADER_WORDS])
    return let(_tokens(line), lambda words: F.size(F.filter(words, lambda w: F.array_contains(known, w))) >= HEADER_SHARE * F.size(words))


def units(docs: DataFrame, key: str) -> DataFrame:
    """key, level (2 the whole text, 1 blocks, 0 lines and sentences) and unit: the distinct ones of each row's whole ``text``, as words."""
    lines = F.split("text", r"\r\n|\r|\n")
    runs = F.concat(_runs(lines, lambda x: x.rlike("^" + COMMENT)), _runs(lines, _licence_line))
    blocks = F.concat(F.regexp_extract_all("text", F.lit(BLOCK_COMMENT), F.lit(0)), runs)
    levels = (F.split("text", SENTENCE), blocks, F.array("text"))
    found = docs.where(F.col("text").rlike(TRIGGER))

    def at(level: int, parts: Column) -> Column:
        return F.transform(F.array_distinct(F.filter(parts, lambda u: u.rlike(TRIGGER))), lambda u: F.struct(F.lit(level).alias("level"), u.alias("unit")))

    found = found.select(key, F.inline(F.concat(*[at(i, x) for i, x in enumerate(levels)])))
    return found.select(key, "level", F.array_join(_tokens(F.col("unit")), " ").alias("unit"))


def match(distinct: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """unit (its digest), license and score for each of the distinct ``unit`` that has a template.

    ``distinct`` has digest, unit, and ``bearers``: how many distinct texts are this unit as a whole. Their words give df.
    """
    import pyarrow as pa

    spark = distinct.sparkSession
    every = templates()
    known = spark.createDataFrame(pa.table({"template": pa.array(range(len(every)), pa.int32()), "license": [name for name, _ in every], "text": [text for _, text in every]}))
    own = known.select("template", "license", F.explode(_tokens(F.col("text"))).alias("word"))
    own = own.groupBy("template", "license", "word").agg(F.count(F.lit(1)).alias("tf"))
    # A unit's words are counted within its row: no shuffle of words for it.
    sorted_words = F.array_sort(F.split("unit", " "))
    last = let(sorted_words, lambda ws: F.filter(F.transform(ws, lambda w, i: F.when(F.get(ws, i + 1).isNull() | (F.get(ws, i + 1) != w), F.struct(w.alias("word"), (i + 1).alias("upto")))), lambda x: x.isNotNull()))
    counted = let(last, lambda xs: F.transform(xs, lambda x, i: F.struct(x["word"].alias("word"), (x["upto"] - F.coalesce(F.get(xs, i - 1)["upto"], F.lit(0))).alias("tf"))))
    words = checkpoint(distinct.select("digest", "bearers", F.inline(counted)))
    n = distinct.agg(F.coalesce(F.sum("bearers"), F.lit(0)).alias("n")).first()["n"] + len(templates())
    df = words.where("bearers > 0").select("word", F.col("bearers").alias("c")).unionByName(own.select("word", F.lit(1).cast("long").alias("c")))
    df = df.groupBy("word").agg(F.sum("c").alias("df"))
    weight = (1 + F.log("tf")) * (F.log((F.lit(float(n)) + 1) / (F.col("df") + 1)) + 1)
    weighed = words.select("digest", "tf", apart("word").alias("at")).join(df.select(apart("word").alias("at"), "df"), "at")
    weighed = weighed.select("digest", F.col("at.k0").alias("word"), weight.alias("w"))
    of_template = own.join(df, "word").select("template", "license", "word", weight.alias("v"))
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy("template")))
    of_template = of_template.select("template", "license", "word", (F.col("v") / norm).alias("v"))
    norms = weighed.groupBy("digest").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = weighed.join(F.broadcast(of_template), "word").groupBy("digest", "template", "license").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    scored = dots.join(norms, "digest").select("digest", "license", F.round(F.col("dot") / F.col("norm"), 9).alias("score"))
    best = scored.where(F.col("score") >= threshold).groupBy("digest")
    return best.agg(F.min_by("license", F.struct(-F.col("score"), F.col("license"))).alias("license"), F.max("score").alias("score")).withColumnRenamed("digest", "unit")


def _split_path(path: Column) -> tuple[Column, Column]:
    """Directory (without a slash at its end, '' for the root) and name."""
    return F.regexp_replace(path, r"/?[^/]*\z", ""), F.regexp_extract(path, r"[^/]*\z", 0)


def scan(docs: DataFrame, path: Column, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, path, license, score, origin (header, file, inherited or null) and origin_directory, a row for each document."""
    rows = docs.select(F.col(id_col).alias("doc_id"), path.cast("string").alias("path"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    key = F.unhex(F.sha2(F.col("text"), 256)).alias("digest")
    # Units hang on the text, so a text that recurs is looked through in each task but weighed once.
    found = units(rows.select(key, "text"), "digest").select("digest", "level", "unit", F.unhex(F.sha2("unit", 256)).alias("unit_digest"))
    found = checkpoint(found.dropDuplicates(["digest", "level", "unit_digest"]))
    distinct = found.groupBy(F.col("unit_digest").alias("digest")).agg(F.first("unit").alias("unit"), F.count_if(F.col("level") == 2).alias("bearers"))
    matched = match(checkpoint(distinct), threshold)
    by_unit = matched.select(apart("unit").alias("at"), "license", "score")
    by_text = found.select("digest", "level", apart("unit_digest").alias("at")).join(by_unit, "at").groupBy("digest")
    by_text = by_text.agg(F.min_by(F.struct("license", "score"), _first()).alias("best")).select("digest", "best.license", "best.score")
    directory, name = _split_path(F.col("path"))
    own = rows.select("doc_id", "path", directory.alias("directory"), name.alias("name"), key).withColumn("at", apart("digest")).drop("digest")
    own = checkpoint(own.join(by_text.select(apart("digest").alias("at"), "license", "score"), "at", "left").drop("at"))

    files = own.where(F.col("name").rlike(LICENCE_FILE) & F.col("license").isNotNull())
    granted = files.groupBy("directory").agg(F.min_by("license", F.struct(-F.col("score"), F.col("license"))).alias("given"), F.max("score").alias("given_score"))
    asking = own.where(F.col("license").isNull() & F.col("directory").isNotNull()).select("directory").distinct()
    parts = F.split("directory", "/")
    ancestors = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, 1, i), "/").alias("ancestor")))
    up = asking.select("directory", F.inline(ancestors)).where((F.col("depth") > 0) | (F.col("ancestor") == "")).distinct()
    # The root is an ancestor of very many directories.
    giving = granted.select(apart("directory").alias("at"), "given", "given_score")
    nearest = up.withColumn("at", apart("ancestor")).join(giving, "at").groupBy("directory")
    nearest = nearest.agg(F.max(F.struct("depth", "ancestor", "given", "given_score")).alias("up"))
    out = own.withColumn("at", apart("directory")).join(nearest.select(apart("directory").alias("at"), "up"), "at", "left")
    is_file = F.col("name").rlike(LICENCE_FILE)
    has = F.col("license").isNotNull()
    origin = F.when(has & is_file, "file").when(has, "header").when(F.col("up").isNotNull(), "inherited")
    return out.select(
        "doc_id", "path", F.coalesce("license", "up.given").alias("license"), F.coalesce("score", "up.given_score").alias("score"),
        origin.alias("origin"), F.when(has, F.col("directory")).otherwise(F.col("up.ancestor")).alias("origin_directory"),
    )
