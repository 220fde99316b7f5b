"""Licence scans, in DataFrame expressions only.

Parts of files are scored against licence templates - notices, source headers, titles and texts of licences - by sparse TF-IDF cosine.  Document
frequencies of the templates' terms are counted over all files; a term outside the templates weighs as one that no file holds.  The parts of any file are
each line with a cue term, the sentences of such a line, windows of two and three lines around it, and the whole comment block (a run of comment
lines) that it stands in; of a licence file also its paragraphs and its whole text, with or without cues.  Files and lines without any cue
term are set aside before that: cue terms are chosen so that a part without one cannot reach the least cosine with any notice or title (the weights
it could share sum to less), so no notice is lost; every longer template holds cue terms of its own.

Files without a licence of their own inherit from the nearest ancestor directory that declares one: by its licence files, else by the most
frequent licence of the files directly inside.  Directories are made distinct before ancestors are joined, and the files of a directory that holds many
are joined in several tasks.

Defined cases: null or empty texts have no licence of their own and can inherit; a null path has no directory and inherits nothing; rows of one path
are one file, whose licence is the best of all its rows; ties go to the alphabetically first licence.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_unique, materialise, table

# Licence identifiers with their notices, titles, source headers and texts, as published by their authors.
NOTICES = [
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("ISC", "Released under the ISC License."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
TITLES = [
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
]
_AS_IS = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD_2 = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_FSF_WARRANTY = "is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the"
LONG = [
    ("AGPL-3.0", f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program {_FSF_WARRANTY} GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-2-Clause", _BSD_2 + _AS_IS),
    ("BSD-3-Clause", _BSD_2 + _BSD_3 + _AS_IS),
    ("GPL-2.0", f"This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program {_FSF_WARRANTY} GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."),
    ("GPL-3.0", f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program {_FSF_WARRANTY} GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("LGPL-3.0", f"This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version. This library {_FSF_WARRANTY} GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library. If not, see <https://www.gnu.org/licenses/>."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
]
TEMPLATES = NOTICES + TITLES + LONG
LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|unlicense|notice)([.-][^/]*)?$"
COMMENT = r"^\s*(//|#|\*|/\*|;|--|%|<!--|rem\b|dnl\b)"
LEAST = 0.7


def terms(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def _split(text: str) -> list[str]:
    return [w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()]


def vectors(templates: list[tuple[str, str]], idf: dict[str, float]) -> list[tuple[str, int, dict[str, float]]]:
    """(licence, template number, unit vector)."""
    out = []
    for k, (licence, text) in enumerate(templates):
        words = _split(text)
        w = {t: words.count(t) * idf[t] for t in set(words)}
        norm = math.sqrt(sum(x * x for x in w.values()))
        out.append((licence, k, {t: x / norm for t, x in w.items()}))
    return out


def cue_terms(units: list[tuple[str, int, dict[str, float]]], least: float) -> list[str]:
    """Terms of which every line within ``least`` of any template holds at least one; rarest first."""
    cues: set[str] = set()
    for _, _, unit in units:
        rest = sum(x * x for t, x in unit.items() if t not in cues)
        for t, x in sorted(unit.items(), key=lambda p: (-p[1], p[0])):
            if rest < least * least * 0.999:
                break
            if t not in cues:
                cues.add(t)
                rest -= x * x
    return sorted(cues)


def fit_idf(files: DataFrame, text_col: str, templates: list[tuple[str, str]]) -> tuple[dict[str, float], float]:
    """Inverse document frequencies of the templates' terms over all files, and that of a term in none."""
    vocabulary = sorted({w for _, t in templates for w in _split(t)})
    literal = F.array(*[F.lit(w) for w in vocabulary])
    held = files.select(F.array_intersect(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), "[^a-z0-9]+"), literal).alias("t"))
    counted = held.select(F.explode(F.concat("t", F.array(F.lit("")))).alias("t")).groupBy("t").agg(F.count("*").alias("n"))  # "" counts files
    df = {r["t"]: r["n"] for r in counted.collect()}  # at most the templates' terms
    n = df.pop("", 0)
    return {w: math.log((1 + n) / (1 + df.get(w, 0))) + 1 for w in vocabulary}, math.log(1 + n) + 1


def parts_of(files: DataFrame, cues: list[str]) -> DataFrame:
    """(path, row, kind, at, text): the parts of ``files`` (path, row, text) that are scored."""
    lines = files.select("path", "row", F.split("text", "\n", -1).alias("lines"))
    lines = lines.select("path", "row", F.posexplode("lines").alias("at", "line"), "lines")
    lines = lines.where(F.arrays_overlap(F.split(F.lower("line"), "[^a-z0-9]+"), F.array(*[F.lit(c) for c in cues])))
    part = lambda kind, at, text: F.struct(F.lit(kind).alias("kind"), at.cast("int").alias("at"), text.alias("text"))
    window = lambda first, n: F.array_join(F.slice("lines", F.greatest(F.col("at") + 1 + first, F.lit(1)), F.least(F.lit(n), F.col("at") + 1 + first + n - 1)), " ")
    around = [(0, 2), (0, 3), (-1, 2), (-1, 3), (-2, 3)]
    windows = [part(f"{n} lines from {first}", F.col("at"), window(first, n)) for first, n in around]
    sentences = F.split("line", r"(?<=[.!?;:])\s+")
    sentences = F.when(F.size(sentences) > 1, F.transform(sentences, lambda x, i: part("sentence", F.col("at") * 10_000 + i, x))).otherwise(F.array().cast("array<struct<kind:string,at:int,text:string>>"))
    flags = F.array_join(F.transform("lines", lambda x: F.when(F.rlike(x, F.lit(COMMENT)), "1").otherwise("0")), "")
    before = F.length(F.regexp_extract(F.substring(flags, F.lit(1), F.col("at")), "1*$", 0))
    after = F.length(F.regexp_extract(F.substring(flags, F.col("at") + 1, F.length(flags)), "^1*", 0))
    cue = lambda x: F.arrays_overlap(F.split(F.lower(x), "[^a-z0-9]+"), F.array(*[F.lit(c) for c in cues]))
    leads = F.rlike("line", F.lit(COMMENT)) & ~F.exists(F.slice("lines", F.col("at") - before + 1, before), cue)  # the first line of the block with a cue
    block = F.when(leads, F.array(part("block", F.col("at") - before, F.array_join(F.slice("lines", F.col("at") - before + 1, before + after), " ")))).otherwise(F.array().cast("array<struct<kind:string,at:int,text:string>>"))
    near = lines.select("path", "row", F.explode(F.concat(F.array(part("line", F.col("at"), F.col("line")), *windows), sentences, block)).alias("p")).select("path", "row", "p.*")
    whole = files.where(F.rlike("path", F.lit(LICENCE_FILE)))
    paragraphs = F.transform(F.split("text", r"\n\s*\n"), lambda x, i: part("paragraph", i, x))
    whole = whole.select("path", "row", F.explode(F.concat(F.array(part("file", F.lit(0), F.col("text"))), paragraphs)).alias("p")).select("path", "row", "p.*")
    return near.unionByName(whole)


def promising(words: Column, vocabulary: list[str], least: float) -> Column:
    """Whether a part can reach ``least``: its terms outside the templates weigh most, so their number bounds the cosine from above."""
    known = F.array(*[F.lit(w) for w in vocabulary])

    def bound(w: Column) -> Column:
        inside = lambda ins: F.aggregate(F.array_distinct(ins), F.lit(0.0), lambda acc, t: acc + F.pow(F.size(F.filter(ins, lambda x: x == t)), 2))
        squares = F.transform(F.array(F.filter(w, lambda x: F.array_contains(known, x))), inside)[0]
        return F.size(F.array_except(w, known)) <= squares * F.lit((1 / least**2 - 1) * 1.001)

    return F.transform(F.array(words), bound)[0]


def own_licences(files: DataFrame, path_col: str, text_col: str, templates=TEMPLATES, least: float = LEAST) -> DataFrame:
    """(path, licence, score) of the files that carry a notice, a header or a licence text."""
    spark = files.sparkSession
    idf, unseen = fit_idf(files, text_col, templates)
    units = vectors(templates, idf)
    cues = cue_terms([u for u, t in zip(units, templates, strict=True) if t not in LONG], least)
    low = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    some = F.rlike(F.col(path_col), F.lit(LICENCE_FILE))
    for c in cues:
        some = some | F.contains(low, F.lit(c))
    given = files.where(F.col(path_col).isNotNull() & some).select(F.col(path_col).alias("path"), F.xxhash64(text_col).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    key = ["path", "row", "kind", "at"]
    parts = parts_of(given, cues).where(promising(terms(F.col("text")), sorted(idf), least))
    # All that is done with a part is done where its words meet.
    words = parts.select(*key, F.explode(terms(F.col("text"))).alias("term")).repartition(*key)  # repeated rows of a path multiply all counts of a part: the same cosine
    tf = words.groupBy(*key, "term").agg(F.count("*").alias("tf"))
    known = spark.createDataFrame([(t, float(x)) for t, x in idf.items()], "term string, idf double")
    model = spark.createDataFrame([(k, lic, t, float(x)) for lic, k, unit in units for t, x in unit.items()], "template int, licence string, term string, unit double")
    weighted = tf.join(F.broadcast(known), "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(unseen)))  # both tables: the templates' terms
    whole = weighted.groupBy(*key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = weighted.join(F.broadcast(model), "term").groupBy(*key, "template", "licence").agg(F.sum(F.col("w") * F.col("unit")).alias("dot"))
    scored = dots.join(whole, key).withColumn("score", F.round(F.col("dot") / F.col("norm"), 9)).where(F.col("score") >= least)
    best = scored.groupBy("path").agg(F.min(F.struct((-F.col("score")).alias("s"), "licence")).alias("b"))
    return best.select("path", F.col("b.licence").alias("licence"), (-F.col("b.s")).alias("score"))


def directory(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).when(path.isNotNull(), F.lit(""))


def scan_licences(files: DataFrame, path_col: str = "path", text_col: str = "text", templates=TEMPLATES, least: float = LEAST) -> DataFrame:
    """(path, licence, score, origin, declared_in) of every path; origin: own, inherited or null."""
    own = materialise(own_licences(files, path_col, text_col, templates, least), "licences")
    named = own.withColumn("dir", directory(F.col("path"))).withColumn("file", F.rlike("path", F.lit(LICENCE_FILE)).cast("int"))
    votes = named.groupBy("dir", "licence").agg(F.sum("file").alias("files"), F.count("*").alias("n"))
    declared = votes.groupBy("dir").agg(F.min(F.struct((-F.col("files")).alias("f"), (-F.col("n")).alias("n"), "licence")).alias("b")).select(F.col("dir").alias("declared_in"), F.col("b.licence").alias("inherited"))
    paths = files.select(F.col(path_col).alias("path")).distinct().withColumn("dir", directory(F.col("path")))
    parts = F.split("dir", "/")
    every = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, 1, i), "/").alias("declared_in"), i.alias("depth")))
    above = paths.select("dir").where("dir is not null").distinct().select("dir", F.explode(F.array_distinct(every)).alias("a")).select("dir", "a.*")
    nearest = above.join(declared, "declared_in").groupBy("dir").agg(F.max(F.struct("depth", "declared_in", "inherited")).alias("b")).select("dir", "b.declared_in", "b.inherited")
    out = join_unique(paths.join(own, "path", "left"), nearest.join(paths.groupBy("dir").agg(F.count("*").alias("n")), "dir"), "dir", "n", ["path"])
    mine = F.col("licence").isNotNull()
    origin = F.when(mine, "own").when(F.col("inherited").isNotNull(), "inherited")
    return out.select("path", F.coalesce("licence", "inherited").alias("licence"), "score", origin.alias("origin"), F.when(~mine, F.col("declared_in")).alias("declared_in"))


def document_path(doc_id: Column, source: Column) -> Column:
    """A path for each row of ``documents``: source, then two levels of directories by id."""
    level = lambda size: F.floor(doc_id / F.lit(size)).cast("string")
    return F.concat_ws("/", F.coalesce(source, F.lit("none")), level(2000), level(200), F.concat(doc_id.cast("string"), F.lit(".txt")))


def op2_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    files = docs.select(document_path(F.col("doc_id"), F.col("source")).alias("path"), "text")
    out = scan_licences(files)
    return out.select(F.regexp_extract("path", r"(-?[0-9]+)\.txt$", 1).cast("long").alias("doc_id"), "path", "licence", "score", "origin", "declared_in")
