"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Native: built-in functions only. Templates are wordings, by which headers name a licence, and full texts. Passages of a whole text
are its lines and pairs of neighbouring lines, which are held against the wordings, and its blocks of BLOCK lines, begun every half
block, and the whole text, which are held against the full texts. Passages and templates are sparse vectors of (1 + ln count) times
idf; document frequencies are those of every term over all files, so the same corpus many times over scores the same. A passage takes
the template of largest cosine, if that reaches LEAST; a file takes its best passage. A licence file is one with a telling name, or
one half of whose text is licence lines or one licence passage. Files without a licence of their own inherit from the licence file
in the nearest directory above them.

No cosine exceeds the norm of the template's terms that the passage has (Cauchy-Schwarz, template of norm 1). So passages that hold
too little of every template are left before anything is exploded; this changes no result. The weights that the test needs are
those of the templates, a fixed list. Inheritance works on distinct directories, each joined with its own ancestors by path, so
a directory with a third of all files is one row there.

Edge cases: null or empty text has no licence of its own; a null path has no ancestors and inherits nothing; of several licence
files in a directory the one of largest score, then smallest path counts; equal scores take the template first by name. Repeated
rows all stay and inherit alike. Very long texts are read whole, a very long line is one passage.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

LEAST, BLOCK = 0.6, 24
NAMES = r"(?i)(^|/)(licen[cs]e|copying|unlicense|notice|copyright)([.-][^/]*)?$"

#: Wordings by which headers name licences.
WORDINGS = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", "you may not use this file except in compliance with the License"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC0-1.0", "To the extent possible under law all copyright is waived, CC0 1.0 Universal, public domain"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
)

#: Public licence texts and notices, in parts that several share.
_WARRANTY = "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} General Public License as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} General Public License for more details. You should have received a copy of the GNU {0} General Public License along with this program."
TEXTS = (
    ("AGPL-3.0", _GPL.format("Affero", "3")),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION. Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form. Grant of Patent License. Each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable patent license to make, have made, use, offer to sell, sell, import, and otherwise transfer the Work. Redistribution. You may reproduce and distribute copies of the Work or Derivative Works thereof in any medium, with or without modifications, and in Source or Object form. Submission of Contributions. Trademarks. Disclaimer of Warranty. Limitation of Liability. Accepting Warranty or Additional Liability."),
    ("BSD-2-Clause", f"{_BSD} {_BSD_END}"),
    ("BSD-3-Clause", f"{_BSD} {_BSD_3} {_BSD_END}"),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003. Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following."),
    ("GPL-2.0", _GPL.format("", "2")),
    ("GPL-3.0", _GPL.format("", "3")),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("LGPL-3.0", _GPL.format("Lesser", "3")),
    ("MIT", f"Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_WARRANTY}"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", f"This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. {_WARRANTY}"),
    ("Zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution."),
)
#: (number, licence, whether it is a full text, terms).
TEMPLATES = tuple((n, name, full, re.findall("[a-z0-9]+", text.lower())) for n, (name, text, full) in enumerate([*((*w, False) for w in WORDINGS), *((*t, True) for t in TEXTS)]))
VOCABULARY = tuple(sorted({t for *_, terms in TEMPLATES for t in terms}))


def _terms(c):
    return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda t: t != "")


def _values(spark: SparkSession, names: str, rows: list[tuple]) -> DataFrame:
    """A table of literals; its strings hold no quotes."""
    one = lambda x: f"'{x}'" if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else f"{x}D" if isinstance(x, float) else str(x)
    return spark.sql(f"SELECT * FROM VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)} AS t({names})")


def _weights(spark: SparkSession, df: DataFrame, n: int) -> list:
    """(tid, license, full, term, w) of all templates, norm 1 each: rows in number bounded by the fixed templates."""
    counted = [(tid, name, full, t, float(terms.count(t))) for tid, name, full, terms in TEMPLATES for t in sorted(set(terms))]
    idf = df.where(F.col("term").isin(*VOCABULARY))
    template = _values(spark, "tid, license, full, term, tf", counted).join(F.broadcast(idf), "term", "left")
    template = template.withColumn("v", (1 + F.log("tf")) * (F.log(F.lit(n + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1))
    norms = template.groupBy("tid").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    return template.join(F.broadcast(norms), "tid").select("tid", "license", "full", "term", (F.col("v") / F.col("norm")).alias("w")).collect()


def _mass(terms, mass):
    return F.aggregate(terms, F.lit(0.0), lambda a, t: a + F.element_at(mass, t))


def _may(terms, weights: list, full: bool):
    """Whether a passage with these terms can reach LEAST with a template of that sort."""
    by: dict[int, dict[str, float]] = {}
    for r in weights:
        if r["full"] == full:
            by.setdefault(r["tid"], {})[r["term"]] = r["w"] ** 2
    ways, first = [], set()
    for terms_ in by.values():
        ranked = sorted(terms_.items(), key=lambda x: -x[1])
        rest = 1.0
        for t, w in ranked:  # the lighter terms alone cannot reach it, so one of these must be there
            if rest < LEAST**2 - 1e-6:
                break
            first.add(t)
            rest -= w
        mass = F.create_map(*(F.lit(x) for t, w in ranked for x in (t, w)))
        own = F.array(*(F.lit(t) for t, _ in ranked))
        ways.append(_mass(F.array_intersect(own, terms), mass) >= LEAST**2 - 1e-6)
    any_ = ways[0]
    for w in ways[1:]:
        any_ = any_ | w
    return F.arrays_overlap(terms, F.array(*(F.lit(t) for t in sorted(first)))) & any_


def license_scan(files: DataFrame, key: str, path: str = "path", text: str = "text") -> DataFrame:
    """One row for each row of files: key, path, license, score, license_file, inherited, effective.

    license is the file's own (null: none), inherited that of the nearest licence file above (null: none), effective the
    first that is not null.
    """
    spark = files.sparkSession
    files = files.select(F.col(key).alias("key"), F.col(path).alias("path"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n = files.count()
    df = cut(files.select(F.explode(F.array_distinct(_terms(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df")))
    weights = _weights(spark, df, n)
    lines = F.split("text", "\n")
    every = F.sequence(F.lit(1), F.size("lines"))
    joined = lambda at, many: F.array_join(F.slice("lines", at, many), " ")
    texts = files.select("key", "text", F.length("text").alias("size"), lines.alias("lines"))
    short = F.concat(F.col("lines"), F.transform(F.slice(every, 1, F.size("lines") - 1), lambda i: joined(i, F.lit(2))))
    starts = F.filter(every, lambda i: (i % (BLOCK // 2) == 1) & ((i == 1) | (i + BLOCK // 2 <= F.size("lines"))))
    long = F.concat(F.array("text"), F.transform(starts, lambda i: joined(i, F.lit(BLOCK))))
    passages = texts.select("key", "size", F.size("lines").alias("n"), F.lit(False).alias("full"), F.posexplode(short).alias("no", "passage"))
    blocks = texts.select("key", "size", F.lit(0).alias("n"), F.lit(True).alias("full"), F.posexplode(long).alias("no", "passage"))
    kept = []
    for part, full in ((passages, False), (blocks, True)):
        part = part.withColumn("terms", _terms(F.col("passage")))
        part = part.where(_may(F.col("terms"), weights, full))
        kept.append(part.select("key", "size", "full", "no", (F.col("full") | (F.col("no") < F.col("n"))).alias("alone"), F.length("passage").alias("chars"), "terms"))
    found = cut(kept[0].unionByName(kept[1]))
    at = ["key", "full", "no"]
    tf = found.select(*at, F.explode("terms").alias("term")).groupBy(*at, "term").agg(F.count("*").alias("tf"))
    tf = tf.join(df, "term", "left").withColumn("v", (1 + F.log("tf")) * (F.log(F.lit(n + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1))
    tf = cut(tf.select(*at, "term", "v"))
    length = tf.groupBy(*at).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    template = _values(spark, "tid, license, full, term, w", [(r["tid"], r["license"], r["full"], r["term"], r["w"]) for r in weights])
    dot = tf.join(F.broadcast(template), ["full", "term"]).groupBy(*at, "tid", "license").agg(F.sum(F.col("v") * F.col("w")).alias("dot"))
    scored = dot.join(length, at).withColumn("score", F.round(F.col("dot") / F.col("norm"), 6)).where(F.col("score") >= LEAST)
    best = scored.groupBy(*at).agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("license"))).alias("b")).join(found.select(*at, "alone", "size", "chars").distinct(), at)
    half = F.greatest(F.sum(F.when(~F.col("full") & F.col("alone"), F.col("chars")).otherwise(0)), F.max(F.when(F.col("full"), F.col("chars")).otherwise(0))) * 2 >= F.max("size")
    own = best.groupBy("key").agg(F.min("b").alias("b"), half.alias("mostly")).select("key", F.col("b.license").alias("license"), (-F.col("b.s")).alias("score"), "mostly")
    named = files.select("key", "path").join(own, "key", "left")
    named = named.withColumn("license_file", F.col("license").isNotNull() & (F.col("mostly") | F.coalesce(F.regexp("path", F.lit(NAMES)), F.lit(False))))
    named = named.withColumn("dir", F.regexp_extract(F.coalesce("path", F.lit("")), "^(.*)/[^/]*$", 1))
    given = named.where("license_file and path is not null").groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("s"), "path", "license")).alias("b")).select(F.col("dir").alias("above"), F.col("b.license").alias("given"))
    dirs = named.where("path is not null").select("dir").distinct()
    parts = F.split("dir", "/")
    ups = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("above"))
    near = ups.join(given, "above").groupBy("dir").agg(F.max(F.struct(F.length("above").alias("depth"), "given")).alias("m")).select("dir", F.col("m.given").alias("inherited"))
    out = named.join(near, "dir", "left")
    inherited = F.when(F.col("path").isNotNull(), F.col("inherited"))
    return out.select(F.col("key").alias(key), "path", "license", "score", "license_file", inherited.alias("inherited"), F.coalesce("license", inherited).alias("effective"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document, filed by its source and in folders by hundreds and tens: its own licence, the inherited one, the one that holds."""
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "text")
    folder = lambda n: F.floor(F.col("doc_id") / n).cast("string")
    return license_scan(docs.withColumn("path", F.concat_ws("/", "source", folder(100), folder(10), F.col("doc_id").cast("string"))), "doc_id")


_T = ", ".join(f"({n}, '{name}', {str(full).lower()}, '{' '.join(terms)}')" for n, name, full, terms in TEMPLATES)
ORACLE = {
    "op7_license_scan": f"""
WITH f AS (SELECT doc_id AS key, concat_ws('/', source, CAST(doc_id // 100 AS VARCHAR), CAST(doc_id // 10 AS VARCHAR), CAST(doc_id AS VARCHAR)) AS path, coalesce(text, '') AS text FROM documents),
t(tid, license, full_, terms) AS (VALUES {_T}),
n AS (SELECT count(*) AS n FROM f),
df AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT key, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM f) GROUP BY term),
tt AS (SELECT tid, license, full_, term, count(*) AS tf FROM (SELECT tid, license, full_, unnest(string_split(terms, ' ')) AS term FROM t) GROUP BY ALL),
tv AS (SELECT tid, license, full_, term, (1 + ln(tf)) * (ln((n + 1) / (coalesce(df, 0) + 1)) + 1) AS v FROM tt LEFT JOIN df USING (term), n),
tw AS (SELECT tid, license, full_, term, v / sqrt(sum(v * v) OVER (PARTITION BY tid)) AS w FROM tv),
l AS (SELECT key, length(text) AS size, text, string_split(text, chr(10)) AS lines FROM f),
p AS (SELECT key, size, false AS full_, unnest(range(len(lines))) AS no, true AS alone, unnest(lines) AS passage FROM l
  UNION ALL SELECT key, size, false, len(lines) + i - 1, false, lines[i] || ' ' || lines[i + 1] FROM (SELECT *, unnest(range(1, len(lines))) AS i FROM l)
  UNION ALL SELECT key, size, true, 0, true, text FROM l
  UNION ALL SELECT key, size, true, 1 + (i - 1) // {BLOCK // 2}, true, array_to_string(lines[i:i + {BLOCK - 1}], ' ') FROM (SELECT *, unnest(range(1, len(lines) + 1, {BLOCK // 2})) AS i FROM l) WHERE i = 1 OR i + {BLOCK // 2} <= len(lines)),
pt AS (SELECT key, size, full_, no, alone, length(passage) AS chars, unnest(regexp_extract_all(lower(passage), '[a-z0-9]+')) AS term FROM p),
tf AS (SELECT key, size, full_, no, alone, chars, term, (1 + ln(count(*))) * (ln((max(n) + 1) / (coalesce(max(df), 0) + 1)) + 1) AS v FROM pt LEFT JOIN df USING (term), n GROUP BY ALL),
len AS (SELECT key, full_, no, sqrt(sum(v * v)) AS norm FROM tf GROUP BY ALL),
s AS (SELECT key, size, full_, no, alone, chars, license, round(sum(v * w) / max(norm), 6) AS score FROM tf JOIN tw USING (full_, term) JOIN len USING (key, full_, no) GROUP BY key, size, full_, no, alone, chars, tid, license),
b AS (SELECT key, size, full_, no, alone, chars, max(score) AS score, arg_min(license, struct_pack(a := -score, b := license)) AS license FROM s WHERE score >= {LEAST} GROUP BY ALL),
o AS (SELECT key, max(score) AS score, arg_min(license, struct_pack(a := -score, b := license)) AS license,
  greatest(coalesce(sum(chars) FILTER (NOT full_ AND alone), 0), coalesce(max(chars) FILTER (full_), 0)) * 2 >= max(size) AS mostly FROM b GROUP BY key),
m AS (SELECT f.key, f.path, o.license, o.score, o.license IS NOT NULL AND (mostly OR regexp_matches(f.path, '{NAMES}')) AS license_file, regexp_extract(f.path, '^(.*)/[^/]*$', 1) AS dir FROM f LEFT JOIN o USING (key)),
g AS (SELECT dir AS above, arg_min(license, struct_pack(a := -score, b := path)) AS given FROM m WHERE license_file GROUP BY dir),
u AS (SELECT DISTINCT dir, array_to_string(string_split(dir, '/')[1:k], '/') AS above FROM (SELECT dir, unnest(range(0, len(string_split(dir, '/')) + 1)) AS k FROM m)),
h AS (SELECT u.dir, arg_max(given, length(u.above)) AS given FROM u JOIN g USING (above) GROUP BY u.dir)
SELECT key AS doc_id, path, license, score, license_file, given AS inherited, coalesce(license, given) AS effective
FROM m LEFT JOIN h ON m.dir = h.dir""",
}
QUERIES = {"op7_license_scan": op7_license_scan}
