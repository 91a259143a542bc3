"""License scans: TF-IDF cosines of notices to templates, and inheritance by directories.

Whole files, their blocks (headers, paragraphs) and their lines, as far as they
speak of licences, are compared with template texts, headers and notices as sparse
TF-IDF vectors, by joins on terms. A file of which a good part is such text is a
licence file and speaks for its directory; a file without a licence of its own
inherits from the nearest ancestor directory that has one. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dropped, saved, table

# Paragraphs of short licences.
_MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_MIT_WARRANTY = "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC_WARRANTY = "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_BSD_OPENING = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_TWO = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_WARRANTY = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
#: Template texts, headers, notices, sentences and identifiers.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    ("MPL-2.0", "This file is subject to the terms of the Mozilla Public License, version 2.0."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("proprietary", "All rights reserved."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", "you may not use this file except in compliance with the License."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL", "GNU General Public License"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("MIT", f"{_MIT_GRANT} {_MIT_NOTICE}"),
    ("MIT", _MIT_GRANT),
    ("MIT", f"{_MIT_GRANT} {_MIT_NOTICE} {_MIT_WARRANTY}"),
    ("ISC", _ISC_GRANT),
    ("ISC", f"{_ISC_GRANT} {_ISC_WARRANTY}"),
    ("BSD-2-Clause", f"{_BSD_OPENING} {_BSD_TWO} {_BSD_WARRANTY}"),
    ("BSD-3-Clause", f"{_BSD_OPENING} {_BSD_TWO} {_BSD_THIRD} {_BSD_WARRANTY}"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
]
#: What a passage must hold to be compared.
CUE = r"(?i)licen[sc]e|copyright|rights reserved|spdx|redistribution|permission|public domain"
#: What parts blocks: a line without letters or digits.
BLANK = r"\n[^\p{L}\p{N}\n]*\n"
#: Least cosine of a passage.
SIMILAR = 0.75
#: Share of a text's characters that notices must make for a licence file.
NOTICE_SHARE = 0.1


def _terms(text: Column) -> Column:
    """Lower-case runs of ASCII letters, digits and dots, without outer dots."""
    parts = F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9]+(?:\.[a-z0-9]+)*)"), 1)
    return parts


def passages(files: DataFrame) -> DataFrame:
    """(path, chars, kind, key, line, size): the whole text (kind 0), blocks (1) and lines (2) that speak of licences.

    A block ends where a line has neither letters nor digits, as between the paragraphs
    of a header comment. ``key`` is a digest of the passage, ``size`` its characters.
    """
    kinds = F.concat(F.array("text"), F.split("text", BLANK)), F.split("text", "\n")
    of = F.concat(F.transform(kinds[0], lambda x, i: F.struct(F.least(i, F.lit(1)).alias("kind"), x.alias("line"))), F.transform(kinds[1], lambda x: F.struct(F.lit(2).alias("kind"), x.alias("line"))))
    found = files.where(F.col("text").rlike(CUE)).select("path", F.length("text").alias("chars"), F.explode(F.filter(of, lambda x: x["line"].rlike(CUE))).alias("p"))
    line = F.trim("p.line")
    return found.select("path", "chars", "p.kind", F.md5(line).alias("key"), line.alias("line"), F.length(line).alias("size"))


def cosines(texts: DataFrame, templates: DataFrame, similar: float) -> DataFrame:
    """(key, license, score): TF-IDF cosines of ``similar`` or more of texts (key, line) to templates (license, line), as a scratch table.

    Inverse document frequencies count the distinct texts and templates.
    """
    keyed = templates.select("license", "line", F.md5("line").alias("key"))
    every = texts.select("key", "line").union(keyed.select("key", "line")).dropDuplicates(["key"])
    tf = saved(every.select("key", F.explode(_terms(F.col("line"))).alias("term")).groupBy("key", "term").agg(F.count("*").alias("tf")), "terms")
    n = every.agg(F.count("*").alias("n"))
    idf = tf.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(n)).select("term", (F.log(F.col("n") / F.col("df")) + 1.0).alias("idf"))  # one row of n
    w = tf.join(idf, "term").select("key", "term", (F.col("tf") * F.col("idf")).alias("w"))
    norm = w.groupBy("key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    of_template = w.join(keyed.select("key", "license"), "key").join(norm, "key").select(F.col("key").alias("template"), "license", "term", (F.col("w") / F.col("norm")).alias("v"))
    dot = w.join(of_template, "term").groupBy("key", "template", "license").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    near = saved(dot.join(norm, "key").select("key", "license", F.round(F.col("dot") / F.col("norm"), 6).alias("score")).where(F.col("score") >= similar), "cosines")
    dropped(tf)
    return near


def scan(files: DataFrame, templates: DataFrame, similar: float = SIMILAR, share: float = NOTICE_SHARE) -> DataFrame:
    """License of each file: path, own_license, own_score, license, origin, from_dir.

    ``files`` has path (a key, parts joined by /) and text, ``templates`` license
    and line, any number of texts a licence (a few thousand in all). Passages are whole
    files, blocks and lines with a word of licences, of any length. Each distinct
    passage takes its best template, of equal ones the first by licence, if the cosine is ``similar`` or more; a file
    takes its widest passages that found one (the whole text, then blocks, then lines), of these the best. A file is a licence file if its
    passages of one kind that found a template make ``share`` of its characters.
    origin is own, inherited or none; from_dir is the directory that
    was inherited from ("" is the root). A null or empty text has no licence of
    its own; a null path inherits nothing; other columns are ignored.
    """
    rows = saved(passages(files.select("path", "text")), "passages")
    near = cosines(rows.select("key", "line"), templates, similar)
    best = near.groupBy("key").agg(F.min_by(F.struct("license", "score"), F.struct(-F.col("score"), F.col("license"))).alias("b")).select("key", "b.*")
    found = rows.select("path", "chars", "kind", "key", "size").join(best, "key")
    order = F.struct(F.col("kind"), -F.col("score"), F.col("license"))
    kinds = found.groupBy("path", "kind").agg(F.min_by(F.struct("license", "score"), order).alias("b"), F.sum("size").alias("noticed"), F.max("chars").alias("chars")).select("path", "kind", "b.*", "noticed", "chars")
    own = kinds.groupBy("path").agg(F.min_by(F.struct("license", "score"), order).alias("b"), F.max("noticed").alias("noticed"), F.max("chars").alias("chars"))
    own = saved(own.select("path", F.col("b.license").alias("own_license"), F.col("b.score").alias("own_score"), (F.col("noticed") >= share * F.col("chars")).alias("is_license_file")), "own")
    dropped(rows, near)

    directory = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.when(F.col("path").isNotNull(), F.lit("")))
    votes = own.where("is_license_file").select(directory.alias("dir"), F.col("own_license").alias("license")).groupBy("dir", "license").agg(F.count("*").alias("n"))
    speaks = votes.groupBy("dir").agg(F.min_by("license", F.struct(-F.col("n"), F.col("license"))).alias("dir_license"))
    # Ancestors are looked up once for each directory, not for each file.
    dirs = files.select(directory.alias("of")).where("of is not null").distinct()
    parts = F.split("of", "/")
    depth = F.when(F.col("of") == "", 0).otherwise(F.size(parts))
    up = dirs.select("of", F.explode(F.transform(F.sequence(F.lit(0), depth), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, F.lit(1), k), "/").alias("dir")))).alias("a")).select("of", "a.*")
    nearest = up.join(speaks, "dir").groupBy("of").agg(F.max_by(F.struct("dir", "dir_license"), "depth").alias("b")).select("of", F.col("b.dir").alias("from_dir"), "b.dir_license")
    out = files.select("path", directory.alias("of")).join(own, "path", "left").join(nearest, "of", "left")
    has = F.col("own_license").isNotNull()
    return out.select("path", "own_license", "own_score", F.coalesce("own_license", "dir_license").alias("license"), F.when(has, "own").when(F.col("dir_license").isNotNull(), "inherited").otherwise("none").alias("origin"), F.when(~has, F.col("from_dir")).alias("from_dir"))


def document_paths(docs: DataFrame) -> DataFrame:
    """Documents as files: source/lang/shelf/doc_id, a hundred ids on a shelf; without an id, the text's hash is the name."""
    shelf = F.coalesce(F.floor(F.col("doc_id") / 100).cast("string"), F.lit("none"))
    return docs.select("doc_id", F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("unknown")), shelf, F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("none-"), F.xxhash64("text").cast("string")))).alias("path"), "text")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence of every document, its own or that of its shelf, language or source."""
    files = document_paths(table(spark, sf_dir, "documents"))
    templates = spark.sql(" UNION ALL ".join(f"SELECT '{k}' AS license, '{v}' AS line" for k, v in TEMPLATES))
    found = scan(files.select("path", "text"), templates)
    return found.withColumn("doc_id", F.expr("try_cast(regexp_extract(path, '([^/]*)$', 1) AS BIGINT)"))


_LIST = " UNION ALL ".join(f"SELECT '{k}' AS license, '{v}' AS line" for k, v in TEMPLATES)
_TERMS = r"regexp_extract_all(lower({0}), '([a-z0-9]+(?:\.[a-z0-9]+)*)', 1)"
OP3_SQL = f"""
WITH f AS (SELECT doc_id, concat_ws('/', coalesce(source, 'unknown'), coalesce(lang, 'unknown'), CAST(CAST(floor(doc_id / 100.0) AS BIGINT) AS VARCHAR), CAST(doc_id AS VARCHAR)) AS path, text FROM documents),
tpl AS ({_LIST}),
raw AS (SELECT path, length(text) AS chars, text FROM f WHERE regexp_matches(text, '{CUE}')),
parts AS (SELECT path, chars, 0 AS kind, text AS line FROM raw
  UNION ALL SELECT path, chars, 1, unnest(string_split_regex(text, '{BLANK}')) FROM raw
  UNION ALL SELECT path, chars, 2, unnest(string_split(text, chr(10))) FROM raw),
rows_ AS (SELECT path, chars, kind, trim(line, ' ') AS line, md5(trim(line, ' ')) AS key FROM parts WHERE regexp_matches(line, '{CUE}')),
al AS (SELECT key, any_value(line) AS line FROM (SELECT key, line FROM rows_ UNION ALL SELECT md5(line), line FROM tpl) GROUP BY key),
tf AS (SELECT key, term, count(*) AS tf FROM (SELECT key, unnest({_TERMS.format('line')}) AS term FROM al) GROUP BY key, term),
idf AS (SELECT term, ln((SELECT count(*) FROM al) / count(*)::DOUBLE) + 1.0 AS idf FROM tf GROUP BY term),
w AS (SELECT key, term, tf * idf AS w FROM tf JOIN idf USING (term)),
nrm AS (SELECT key, sqrt(sum(w * w)) AS norm FROM w GROUP BY key),
tw AS (SELECT license, tpl.line AS template, w.term, w / norm AS v FROM tpl JOIN w ON w.key = md5(tpl.line) JOIN nrm ON nrm.key = w.key),
cs AS (SELECT w.key, license, template, round(sum(w * v) / any_value(norm), 6) AS score FROM w JOIN tw USING (term) JOIN nrm USING (key) GROUP BY w.key, license, template),
best AS (SELECT key, license, score FROM cs WHERE score >= {SIMILAR} QUALIFY row_number() OVER (PARTITION BY key ORDER BY score DESC, license) = 1),
kinds AS (SELECT path, kind, first(license ORDER BY score DESC, license) AS license, max(score) AS score, sum(length(line)) AS noticed, max(chars) AS chars FROM rows_ JOIN best USING (key) GROUP BY path, kind),
own AS (SELECT path, first(license ORDER BY kind) AS own_license, first(score ORDER BY kind) AS own_score, max(noticed) >= {NOTICE_SHARE}e0 * max(chars) AS notice FROM kinds GROUP BY path),
votes AS (SELECT regexp_replace(path, '/[^/]*$', '') AS dir, own_license AS license, count(*) AS n FROM own WHERE notice GROUP BY 1, 2),
speaks AS (SELECT dir, license FROM votes QUALIFY row_number() OVER (PARTITION BY dir ORDER BY n DESC, license) = 1),
dirs AS (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS dof FROM f),
up AS (SELECT dof, k AS depth, array_to_string(string_split(dof, '/')[1:k], '/') AS dir FROM dirs, (VALUES (0), (1), (2), (3)) v(k)),
near AS (SELECT dof, up.dir, license FROM up JOIN speaks ON up.dir = speaks.dir QUALIFY row_number() OVER (PARTITION BY dof ORDER BY depth DESC) = 1)
SELECT f.path, own_license, own_score, coalesce(own_license, near.license) AS license,
  CASE WHEN own_license IS NOT NULL THEN 'own' WHEN near.license IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
  CASE WHEN own_license IS NULL THEN near.dir END AS from_dir, f.doc_id
FROM f LEFT JOIN own USING (path) LEFT JOIN near ON near.dof = regexp_replace(f.path, '/[^/]*$', '')
"""
