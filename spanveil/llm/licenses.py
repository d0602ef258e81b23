"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest directory. SQL functions only.

A text is compared in units, the larger before the smaller:

0. an SPDX tag;
1. the whole file, comment marks and line breaks taken out, as licence files are;
2. a block between blank lines, as headers and the paragraphs of licences are;
3. a sentence of a block, 4. a line, or a sentence within a line, for statements amid other text.

But for the whole file, units need a cue word; a file without any is not compared. Each distinct unit is scored
once: its TF-IDF vector against every template's. Document frequencies are counted over all distinct units of the
corpus; terms that no template has weigh as the rarest ones, so that a cue word inside ordinary prose stays far from
every template. A text's licence is its best template at ``least_cosine`` or more in the largest kind of unit that has
one; of several units of a kind the best cosine, ties to the earlier, then the licence's name.

A licence file is one named so (LICENSE, LICENCE, COPYING, NOTICE, UNLICENSE), or one whose matching unit makes up at
least half of its words. A file without a licence of its own inherits that of the nearest ancestor
directory which has a licence file; of several there, the best cosine decides, then the smallest path.

Null or empty texts state nothing but inherit. A null path is in no directory. Repeated rows give repeated
results. Input columns are kept, those named like the added ones are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, staged, without

#: Licence names and the public texts that state them: headers, titles and the short licences as a whole.
MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
MIT_WARRANTY = "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
BSD_CLAUSES = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_WARRANTY = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
APACHE_HEADER = "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."
GNU_TITLE = "Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
GNU_HEADER = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
TEMPLATES = [
    ("MIT", "MIT License"),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license."),
    ("MIT", MIT_GRANT),
    ("MIT", f"MIT License Copyright (c) {MIT_GRANT} {MIT_NOTICE} {MIT_WARRANTY}"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", APACHE_HEADER),
    ("Apache-2.0", f"{APACHE_HEADER} You may obtain a copy of the License at"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", GNU_HEADER.format("General Public License", 3)),
    ("GPL-3.0", f"GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 {GNU_TITLE}"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", GNU_HEADER.format("General Public License", 2)),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", GNU_HEADER.format("Lesser General Public License", 3)),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", GNU_HEADER.format("Lesser General Public License", 2.1)),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", GNU_HEADER.format("Affero General Public License", 3)),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-3-Clause", BSD_NAMES),
    ("BSD-3-Clause", f"BSD 3-Clause License Copyright (c) {BSD_GRANT} {BSD_CLAUSES} {BSD_NAMES} {BSD_WARRANTY}"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-2-Clause", BSD_GRANT),
    ("BSD-2-Clause", f"BSD 2-Clause License Copyright (c) {BSD_GRANT} {BSD_CLAUSES} {BSD_WARRANTY}"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("ISC", "Licensed under the ISC License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", "This is free and unencumbered software released into the public domain under the Unlicense."),
]
TEMPLATES += [(name, f"SPDX-License-Identifier: {name}{end}") for name in sorted({n for n, _ in TEMPLATES}) for end in (("", "-only", "-or-later") if "GPL" in name else ("",))]
CUE = r"(?i)licen[sc]e|copyright|copyleft|spdx|public domain|all rights reserved|permission is hereby granted|permission to use|redistribution and use|neither the name|free software"
TAG = r"(?i)spdx-license-identifier:[ \t]*[a-z0-9.+-]+"
#: Comment marks at the two ends of a line, and the spaces next to them.
OPENS = r"(?m)^[ \t]*(?:/\*+|\*+/|\*+|//+!?|#+!?|--+|;+|%+|<!--)?[ \t]*"
CLOSES = r"(?m)[ \t]*(?:\*+/|-->)?[ \t]*$"
BLANKS = r"[ \t\n\x0B\f\r]+"
FILE_NAME = r"(?i)(^|/)(licen[sc]e|copying|notice|unlicense)[^/]*$"
MOST_DIRS_SENT = 1 << 17
WORD = r"[^a-z0-9.\-]+|\.+(?:[^a-z0-9]|$)"


def terms_of(text: str) -> str:
    """SQL for the words of a statement: versions like 2.0 and names like by-nc stay whole."""
    pattern = WORD.replace("\\", "\\\\")
    return f"filter(split(lower({text}), '{pattern}'), w -> w <> '')"


def units_of(text: Column) -> Column:
    """A text's distinct units in their order: array of (kind, body); null without a cue word."""
    one_space = lambda x: F.trim(F.regexp_replace(x, BLANKS, " "))
    lines = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), OPENS, ""), CLOSES, "")
    blocks = F.transform(F.split(lines, r"\n\n+", -1), one_space)
    # A full stop, or the like, and a space end a sentence.
    sentences = lambda x: F.split(F.regexp_replace(x, r"([.!?]) ", "$1\n"), r"\n", -1)
    each_line = F.transform(F.split(lines, r"\n", -1), one_space)
    kinds = [
        F.transform(F.regexp_extract_all(text, F.lit(TAG), F.lit(0)), one_space),
        F.array(F.trim(F.array_join(F.filter(blocks, lambda b: b != ""), " "))),
        blocks,
        F.flatten(F.transform(blocks, sentences)),
        F.flatten(F.transform(each_line, sentences)),
    ]
    cued = [F.transform(F.array_distinct(F.filter(F.transform(k, F.trim), lambda b: b.rlike(CUE))), lambda b, n=n: F.struct(F.lit(n).alias("kind"), b.alias("body"))) for n, k in enumerate(kinds)]
    return F.when(text.rlike(CUE), F.concat(*cued))


def score_units(units: DataFrame, least_cosine: float) -> DataFrame:
    """units(unit, body), distinct, to (unit, licence, cosine) of the best template at least_cosine or more."""
    spark = units.sparkSession
    templates = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(TEMPLATES)], "template int, licence string, body string")
    of_templates = templates.select("template", "licence", F.explode(F.expr(terms_of("body"))).alias("term")).groupBy("template", "licence", "term").agg(F.count(F.lit(1)).alias("tf"))
    vocabulary = of_templates.select("term").distinct()  # the fixed templates' words

    words = units.select("unit", F.explode(F.expr(terms_of("body"))).alias("term")).groupBy("unit", "term").agg(F.count(F.lit(1)).alias("tf"))
    size = units.count()
    df = words.join(F.broadcast(vocabulary), "term").groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # at most the vocabulary
    idf = vocabulary.join(df, "term", "left").select("term", (F.log((1.0 + size) / (1 + F.coalesce("df", F.lit(0)))) + 1).alias("idf"))
    rarest = math.log(1.0 + size) + 1

    weighted = of_templates.join(idf, "term").withColumn("weight", F.col("tf") * F.col("idf"))
    norms = weighted.groupBy("template").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    weighted = weighted.join(norms, "template").select("template", "licence", "term", (F.col("weight") / F.col("norm")).alias("template_weight"))

    words = words.join(F.broadcast(idf), "term", "left").withColumn("weight", F.col("tf") * F.coalesce("idf", F.lit(rarest)))
    lengths = words.groupBy("unit").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("length"))
    dots = words.join(F.broadcast(weighted), "term").groupBy("unit", "template", "licence").agg(F.sum(F.col("weight") * F.col("template_weight")).alias("dot"))
    scored = dots.join(lengths, "unit").withColumn("cosine", F.round(F.col("dot") / F.col("length"), 6)).filter(F.col("cosine") >= least_cosine)
    best = scored.groupBy("unit").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "licence")).alias("best"))
    return best.select("unit", F.col("best.licence").alias("licence"), (-F.col("best.c")).alias("cosine"))


def directory(path: str):
    return F.when(F.col(path).contains("/"), F.regexp_extract(path, "^(.*)/[^/]*$", 1)).when(F.col(path).isNotNull(), F.lit(""))


def nearest(directories: DataFrame, holders: DataFrame) -> DataFrame:
    """directories(dir) and holders(dir, licence, ...), distinct dirs each, to (dir, licence, from_dir) of the nearest ancestor, itself included."""
    parts = F.split("dir", "/")
    depths = F.sequence(F.lit(0), F.when(F.col("dir") == "", F.lit(0)).otherwise(F.size(parts)))
    up = directories.select("dir", F.explode(depths).alias("depth")).withColumn("from_dir", F.array_join(F.slice(F.split("dir", "/"), F.lit(1), F.col("depth")), "/"))
    met = up.join(holders.withColumnRenamed("dir", "from_dir"), "from_dir")
    return met.groupBy("dir").agg(F.max_by(F.struct("licence", "from_dir"), "depth").alias("x")).select("dir", F.col("x.licence").alias("inherited"), F.col("x.from_dir").alias("inherited_from"))


def scan(files: DataFrame, path_col: str = "path", text_col: str = "text", least_cosine: float = 0.75) -> DataFrame:
    """files without the text, with licence, cosine, basis (file, header, inherited or none) and inherited_from."""
    files = without(files, "licence", "cosine", "basis", "inherited_from")
    kept = [c for c in files.columns if c != text_col]
    text = F.col(text_col)
    n_words = F.size(F.filter(F.split(F.when(text.rlike(CUE), text), BLANKS), lambda w: w != ""))
    rows = files.select(*[F.col(c).alias(f"in_{c}") for c in kept], units_of(text).alias("units"), n_words.alias("n_words"))
    rows = rows.withColumn("row_key", F.struct(F.xxhash64(*[f"in_{c}" for c in kept]).alias("h"), F.hash("units").alias("g"))).withColumn("dir", directory(f"in_{path_col}"))
    rows = staged(rows, "license-rows")
    each = rows.filter(F.size("units") > 0).dropDuplicates(["row_key"]).select("row_key", "dir", F.col(f"in_{path_col}").alias("path"), "n_words", F.posexplode("units").alias("at", "u"))
    each = each.select("row_key", "dir", "path", "n_words", "at", "u.kind", "u.body", F.md5(F.col("u.body").cast("binary")).alias("unit"))
    distinct = staged(each.groupBy("unit").agg(F.any_value("body").alias("body")), "units")
    scored = staged(score_units(distinct, least_cosine), "licenses")
    own = each.join(scored, "unit").withColumn("share", F.size(F.split("body", " ")) / F.greatest(F.col("n_words"), F.lit(1)))
    own = own.groupBy("row_key", "dir", "path").agg(F.min(F.struct("kind", (-F.col("cosine")).alias("c"), "at", "licence")).alias("best"), F.max("share").alias("share"))
    own = own.withColumn("is_file", F.coalesce(F.col("path").rlike(FILE_NAME), F.lit(False)) | (F.col("share") >= 0.5))
    own = staged(own.select("row_key", "dir", "path", "is_file", F.col("best.licence").alias("own"), (-F.col("best.c")).alias("own_cosine")), "own-licenses")

    holders = own.filter(F.col("is_file") & F.col("dir").isNotNull()).groupBy("dir").agg(F.min(F.struct((-F.col("own_cosine")).alias("c"), "path", "own")).alias("x")).select("dir", F.col("x.own").alias("licence"))
    inherited = staged(nearest(rows.select("dir").filter(F.col("dir").isNotNull()).distinct(), holders), "inherited")
    # One row a directory: sent to all tasks if counted as few, so that a directory with a third of all files is no hot key.
    inherited = F.broadcast(inherited) if inherited.count() <= MOST_DIRS_SENT else inherited
    out = rows.join(own.select("row_key", "own", "own_cosine", "is_file"), "row_key", "left").join(inherited, "dir", "left")
    basis = F.when(F.col("is_file"), "file").when(F.col("own").isNotNull(), "header").when(F.col("inherited").isNotNull(), "inherited").otherwise("none")
    return out.select(*[F.col(f"in_{c}").alias(c) for c in kept], F.coalesce("own", "inherited").alias("licence"), F.coalesce("own_cosine", F.lit(0.0)).alias("cosine"), basis.alias("basis"), F.when(basis == "inherited", F.col("inherited_from")).alias("inherited_from"))


def oracle() -> str:
    """The query as SQL for DuckDB."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({i}, {quoted(name)}, {quoted(body)})" for i, (name, body) in enumerate(TEMPLATES))
    one_space = lambda x: f"trim(regexp_replace({x}, {quoted(BLANKS)}, ' ', 'g'))"
    sentences = lambda x: f"regexp_split_to_array(regexp_replace({x}, '([.!?]) ', '\\1' || chr(10), 'g'), '\\n')"
    bare = f"regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), {quoted(OPENS)}, '', 'g'), {quoted(CLOSES)}, '', 'g')"
    of_kind = lambda k, x: f"list_transform({x}, lambda x: {{'kind': {k}, 'body': trim(x)}})"
    terms = lambda x: f"unnest(list_filter(regexp_split_to_array(lower({x}), {quoted(WORD)}), lambda w: w <> ''))"
    return f"""
WITH templates(template, licence, body) AS (VALUES {values}),
d AS (SELECT doc_id, concat_ws('/', source, CAST(doc_id AS VARCHAR)) AS path, text FROM documents),
dirs AS (SELECT doc_id, path, CASE WHEN path LIKE '%/%' THEN regexp_extract(path, '^(.*)/[^/]*$', 1) ELSE '' END AS dir FROM d),
l AS (SELECT doc_id, text, {bare} AS lines, len(list_filter(regexp_split_to_array(text, {quoted(BLANKS)}), lambda w: w <> '')) AS n_words FROM d WHERE regexp_matches(text, {quoted(CUE)})),
b AS (SELECT doc_id, text, n_words, list_transform(regexp_split_to_array(lines, '\\n\\n+'), lambda x: {one_space("x")}) AS blocks, list_transform(regexp_split_to_array(lines, '\\n'), lambda x: {one_space("x")}) AS each_line FROM l),
k AS (SELECT doc_id, n_words, list_concat(list_concat(list_concat(
    {of_kind(0, f"regexp_extract_all(text, {quoted(TAG)})")}, {of_kind(1, "[array_to_string(list_filter(blocks, lambda x: x <> ''), ' ')]")}),
    list_concat({of_kind(2, "blocks")}, {of_kind(3, f"flatten(list_transform(blocks, lambda x: {sentences('x')}))")})),
    {of_kind(4, f"flatten(list_transform(each_line, lambda x: {sentences('x')}))")}) AS units FROM b),
e AS (SELECT doc_id, n_words, generate_subscripts(units, 1) AS place, unnest(units) AS u FROM k),
each AS (SELECT doc_id, n_words, place, u.kind AS kind, u.body AS body FROM e WHERE regexp_matches(u.body, {quoted(CUE)})),
units AS (SELECT DISTINCT body FROM each),
n AS (SELECT count(*) AS size FROM units),
tt AS (SELECT template, licence, term, count(*) AS tf FROM (SELECT template, licence, {terms("body")} AS term FROM templates) GROUP BY ALL),
w AS (SELECT body, term, count(*) AS tf FROM (SELECT body, {terms("body")} AS term FROM units) GROUP BY ALL),
idf AS (SELECT v.term, ln((1.0 + any_value(size)) / (1 + count(w.body))) + 1 AS idf FROM (SELECT DISTINCT term FROM tt) v CROSS JOIN n LEFT JOIN w ON w.term = v.term GROUP BY v.term),
tw AS (SELECT template, licence, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY template)) AS weight FROM tt JOIN idf USING (term)),
ww AS (SELECT body, term, tf * coalesce(idf, (SELECT ln(1.0 + size) + 1 FROM n)) AS weight FROM w LEFT JOIN idf USING (term)),
len AS (SELECT body, sqrt(sum(weight * weight)) AS length FROM ww GROUP BY body),
dots AS (SELECT body, template, licence, sum(ww.weight * tw.weight) AS dot FROM ww JOIN tw USING (term) GROUP BY ALL),
scored AS (SELECT body, licence, round(dot / length, 6) AS cosine FROM dots JOIN len USING (body) WHERE round(dot / length, 6) >= 0.75),
best AS (SELECT body, licence, cosine FROM scored QUALIFY row_number() OVER (PARTITION BY body ORDER BY cosine DESC, licence) = 1),
own AS (SELECT doc_id, licence, cosine, max(len(string_split(body, ' ')) / greatest(n_words, 1)) OVER (PARTITION BY doc_id) AS share FROM each JOIN best USING (body)
    QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY kind, cosine DESC, place, licence) = 1),
mine AS (SELECT doc_id, path, dir, licence, cosine, own.doc_id IS NOT NULL AND (regexp_matches(path, {quoted(FILE_NAME)}) OR share >= 0.5) AS is_file FROM dirs LEFT JOIN own USING (doc_id)),
holders AS (SELECT dir, licence FROM mine WHERE is_file QUALIFY row_number() OVER (PARTITION BY dir ORDER BY cosine DESC, path, licence) = 1),
up AS (SELECT dir, unnest(range(0, CASE WHEN dir = '' THEN 1 ELSE len(string_split(dir, '/')) + 1 END)) AS depth FROM (SELECT DISTINCT dir FROM dirs)),
inherited AS (SELECT up.dir, h.licence, h.dir AS from_dir FROM up JOIN holders h ON h.dir = array_to_string(string_split(up.dir, '/')[1:depth], '/') QUALIFY row_number() OVER (PARTITION BY up.dir ORDER BY depth DESC) = 1)
SELECT doc_id, path, coalesce(m.licence, i.licence) AS licence, coalesce(m.cosine, 0.0) AS cosine,
    CASE WHEN m.is_file THEN 'file' WHEN m.licence IS NOT NULL THEN 'header' WHEN i.licence IS NOT NULL THEN 'inherited' ELSE 'none' END AS basis,
    CASE WHEN m.licence IS NULL THEN i.from_dir END AS inherited_from
FROM mine m LEFT JOIN inherited i USING (dir)
"""


def op6_license_scan(spark, sf_dir: str) -> DataFrame:
    """Every document is a file of its source's directory: its path is source/doc_id."""
    docs = documents(spark, sf_dir)
    return scan(docs.select("doc_id", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), "text"))
