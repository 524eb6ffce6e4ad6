"""Operator 2 [native]: licences of files, by TF-IDF cosine to templates and inheritance along directories.

Method. Every run of one to ``wrap`` lines of every whole text (a notice may be wrapped), and every whole text, is a unit. A unit is a sparse TF-IDF vector over its words
other than stop words (idf from the template collection; a word of no template has the idf of document frequency 0 and counts in the norm). Its
cosine to each template comes from an equi-join of its terms with the template terms; the best one at ``least`` or above is
its licence. A run of lines names the licence of its file (a header); a whole text that is a template makes its file a licence
file of its directory. A file without a header takes the licence of the nearest ancestor directory with a licence file,
by an equi-join of its ancestor paths with those directories.

Each line is split into words once. A unit without an *anchor* word is left out, and rightly: anchors are chosen so that what a
template weighs outside its anchors is below ``least`` of its length; by Cauchy-Schwarz no unit without an anchor reaches
``least``. So is a unit whose words of no template outweigh the others, by their counts and the same inequality. Nothing is capped or
sampled.

Scale. DataFrame functions only. The text is read once and goes no further than its first projection: what is written are the words
of the units left, with the row's number, id and path. Template terms (a constant) are broadcast. Aggregates are keyed by unit and
term, by file, or by directory, with partial sums. Inheritance joins on the directory without a hint: a hot directory is split by
AQE, a small side is broadcast by its measured size.

Defined cases. A null or empty text has no header. A null path is treated as the file of no directory: it inherits nothing.
Repeated rows are scanned each. Equal cosines go to the smaller licence name, then to the shorter and earlier run; of several licence files in a directory, the
best cosine, then the smaller name, counts. Columns besides the path, the text and the id are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import discard, written

#: Licence notices and short licence texts, as they stand in headers and licence files. Fixed values.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work (CC0 1.0)."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("proprietary", "All rights reserved."),
    # Identifier lines and the usual notices above source code.
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("MIT", "Licensed under the MIT License. See LICENSE in the project root for license information."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    # Whole licence files.
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("MIT", "MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
)
TOKEN = r"[a-z0-9]+"
#: Stop words, which no vector counts. Fixed values.
STOP = frozenset("a all an and any are as at be by can for from has have in is it its may no not of on or that the these this to under use was with work you".split())


class Templates:
    """The template vectors: idf of each term, unit weights, and anchors for ``least``."""

    def __init__(self, least: float, templates=TEMPLATES):
        self.least = least
        counts = [Counter(t for t in re.findall(TOKEN, text.lower()) if t not in STOP) for _, text in templates]
        df = Counter(t for c in counts for t in c)
        n = len(counts)
        self.unknown = math.log(1.0 + n) + 1
        self.idf = {t: math.log((1 + n) / (1 + d)) + 1 for t, d in sorted(df.items())}
        self.weights, anchors = [], set()
        for i, ((name, _), count) in enumerate(zip(templates, counts, strict=True)):
            raw = {t: c * self.idf[t] for t, c in count.items()}
            length = math.sqrt(sum(w * w for w in raw.values()))
            self.weights += [(t, i, name, w / length) for t, w in sorted(raw.items())]
            rest = 1.0
            for t, w in sorted(raw.items(), key=lambda x: (x[0] not in anchors, x[0].isdigit(), -x[1], x[0])):
                if rest < (0.99 * least) ** 2:
                    break
                anchors.add(t)
                rest -= (w / length) ** 2
        self.anchors = sorted(anchors)

    def anchored(self, text):
        """Whether a text has an anchor at all; words are tried by their first letters, most texts fail there."""
        by_letter: dict[str, list[str]] = {}
        for word in self.anchors:
            by_letter.setdefault(word[0], []).append(word[1:])
        words = "|".join(f"{c}(?:{'|'.join(sorted(rest))})" for c, rest in sorted(by_letter.items()))
        return F.lower(text).rlike(f"(?<![a-z0-9])(?:{words})(?![a-z0-9])")

    def counted(self, line):
        """A line's words, and how many of them are anchors, words of a template, and neither these nor stop words."""
        words = F.regexp_extract_all(F.lower(line), F.lit(f"({TOKEN})"))
        words = F.filter(words, lambda t: ~t.isin(sorted(STOP)))
        return F.struct(words.alias("words"), F.size(F.filter(words, lambda t: t.isin(self.anchors))).alias("anchors"), F.size(F.filter(words, lambda t: t.isin(list(self.idf)))).alias("own"))

    def may_match(self, anchors, own, words):
        """False only where a unit can't reach ``least``: it has no anchor, or words of no template outweigh the others.

        With v template words and o others, the others' squares sum to ``o * unknown ** 2`` at least and the
        template words' length is ``v * top`` at most.
        """
        most = (1 / self.least**2 - 1) * (max(self.idf.values()) / self.unknown) ** 2
        return (anchors > 0) & (words - own <= most * own * own)


def matches(units: DataFrame, templates: Templates) -> DataFrame:
    """``units(unit, words)`` -> unit, licence, cosine (6 decimals) of the best template at ``least`` or above."""
    spark = units.sparkSession
    idf = spark.createDataFrame(list(templates.idf.items()), "term string, idf double")
    weights = spark.createDataFrame(templates.weights, "term string, template int, licence string, weight double")
    counted = units.select("unit", F.explode("words").alias("term")).groupBy("unit", "term").agg(F.count("*").alias("tf"))
    counted = counted.join(F.broadcast(idf), "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(templates.unknown)))
    norms = counted.groupBy("unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.collect_list(F.when(F.col("idf").isNotNull(), F.struct("term", "w"))).alias("known"))
    known = norms.select("unit", "norm", F.explode("known").alias("k")).select("unit", "norm", "k.*")
    dots = known.join(F.broadcast(weights), "term").groupBy("unit", "template", "licence").agg((F.sum(F.col("w") * F.col("weight")) / F.first("norm")).alias("cosine"))
    dots = dots.withColumn("cosine", F.round("cosine", 6)).where(F.col("cosine") >= templates.least)
    best = dots.groupBy("unit").agg(F.min(F.struct(-F.col("cosine"), F.col("licence"))).alias("b"))
    return best.select("unit", F.col("b.licence").alias("licence"), (-F.col("b.col1")).alias("cosine"))


def license_scan(files: DataFrame, *, key: str = "doc_id", least: float = 0.75, templates=TEMPLATES, wrap: int = 4) -> DataFrame:
    """``files(<key>, path, text)`` -> key, path, header, header_cosine, is_licence_file, inherited_from, licence."""
    model = Templates(least, templates)

    def unit(i, n, of):
        """A run of lines as (i, n, words), or an empty list where it can't match."""
        none = F.struct(F.lit(0).alias("anchors"), F.lit(0).alias("own"), F.lit(0).alias("words"))
        sums = F.aggregate(of, none, lambda a, x: F.struct((a["anchors"] + x["anchors"]).alias("anchors"), (a["own"] + x["own"]).alias("own"), (a["words"] + F.size(x["words"])).alias("words")), lambda a: model.may_match(a["anchors"], a["own"], a["words"]))
        whole = F.array(F.struct(i.alias("i"), n.alias("n"), F.flatten(F.transform(of, lambda x: x["words"])).alias("words")))
        return F.when(sums, whole).otherwise(F.slice(whole, 1, 0))

    def runs(lines, n: int):
        """Runs of n lines; their first lines' numbers are told by where they begin."""
        at = F.sequence(F.lit(0), F.greatest(F.size(lines) - n, F.lit(0)))
        return F.flatten(F.transform(at, lambda i: F.when(i + n <= F.size(lines), unit(i, F.lit(n), F.slice(lines, i + 1, n)))))

    def units_of(lines):
        some = F.concat(unit(F.lit(-1), F.lit(0), lines), *[F.coalesce(runs(lines, n), F.array()) for n in range(1, wrap + 1)])
        return F.when(F.exists(lines, lambda x: x["anchors"] > 0), some)

    # The lines are bound to a name by the outer transform, so that they are split once for all that reads them.
    units = F.transform(F.array(F.transform(F.split("text", "\n"), model.counted)), units_of)[0]
    units = F.when(model.anchored(F.col("text")), units)
    # Written with their numbers, so that a number is one row's however often it is read; the text stays behind.
    rows = written(files.select(F.col(key), "path", units.alias("units"), F.monotonically_increasing_id().alias("row")), "files")
    found = rows.select("row", F.explode("units").alias("u"))
    units = found.select(F.struct("row", F.col("u.i").alias("i"), F.col("u.n").alias("n")).alias("unit"), "u.words")
    hit = matches(units, model).select("unit.row", "unit.i", "unit.n", "licence", "cosine")
    best = lambda cond: F.min(F.when(cond, F.struct((-F.col("cosine")).alias("c"), "licence", "n", "i")))
    hit = hit.groupBy("row").agg(best(F.col("i") >= 0).alias("h"), best(F.col("i") < 0).alias("f"))
    keyed = written(rows.drop("units").join(hit, "row", "left"), "licences")
    discard(rows)
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    of_folder = keyed.where("f is not null and path is not null").groupBy(folder.alias("folder")).agg(F.min(F.struct("f.c", "f.licence"))["licence"].alias("of_folder"))
    # a/b/c.txt -> a/b, a and the root, deepest first.
    parts = F.split("path", "/")
    ups = F.transform(F.sequence(F.size(parts) - 1, F.lit(0), F.lit(-1)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("folder")))
    need = keyed.where("h is null and path is not null").select("row", F.explode(ups).alias("u")).select("row", "u.*")
    near = need.join(of_folder, "folder").groupBy("row").agg(F.max(F.struct("depth", "folder", "of_folder")).alias("n"))
    out = keyed.join(near, "row", "left")
    return out.select(
        key,
        "path",
        F.col("h.licence").alias("header"),
        (-F.col("h.c")).alias("header_cosine"),
        F.col("f").isNotNull().alias("is_licence_file"),
        F.col("n.folder").alias("inherited_from"),
        F.coalesce("h.licence", "n.of_folder").alias("licence"),
    )


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    # The corpus has no paths: a source is a repository, a language a folder in it.
    files = docs.select("doc_id", F.concat_ws("/", "source", F.coalesce("lang", F.lit("-")), F.col("doc_id").cast("string")).alias("path"), "text")
    return license_scan(files)
