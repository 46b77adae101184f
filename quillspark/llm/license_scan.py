"""Licences of files: TF-IDF cosine to templates, then inheritance by path.

Lines that speak of licences or rights are compared with short templates as
sparse TF-IDF vectors (equal lines once, however many files hold them; the
document frequencies count all of them).  A file's own licence is the best
template of its lines; a file that is little more than such lines is a licence
file and speaks for its directory.  A file without a licence of its own takes
that of the nearest directory above it that has one; this is settled once for
every distinct directory by joining its ancestors' paths to the licence files'
directories, then joined to the files.

A line with an ``SPDX-License-Identifier`` has its identifiers as terms and
nothing else, and each identifier is a template; of an expression of several
the licence is the expression.  So has a line of a file named as a licence file
that is nothing but a name ("MIT", "Zlib License").  A line of more than
``LONG`` words is compared sentence by sentence, and a sentence of more in windows
of ``WIDE`` words, so that what follows on a line does not hide a licence.

Only DataFrame operations are used.

Rows: a null or empty text, or one without such a line, has no licence of its
own; a null path is in no directory; ties go to the better score, then to the
template's name; a file is known by its id, path and text, so rows of one id or
of none are files of their own, and repeated rows get equal results; further
columns are not read, whatever they are called; an empty table gives no rows.
A line is carried by its hash, so its length is of no account.

Whole texts, and their heads of comments with the lines joined, are compared in
the same way with full licence texts and notices.  A text that a full one fits,
and a file that is named as one and has a licence, is a licence file; what a
whole text or head is like goes before what its lines are like.
"""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import by_key, cut, salted

# Names and short texts of licences.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD License",
    "CC-BY-4.0": "Licensed under CC BY 4.0, the Creative Commons Attribution License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "CC0-1.0": "CC0 public domain dedication, no rights reserved",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "ISC": "Permission to use, copy, modify, and distribute this software under the ISC License",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3",
    "MIT": "Released under the MIT License",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "Proprietary": "All rights reserved",
    "Unlicense": "This is free and unencumbered software released into the public domain",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3",
    "BSD-2-Clause": "Licensed under the BSD 2-Clause License",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "EUPL-1.2": "Licensed under the EUPL, Version 1.2",
    "Zlib": "Released under the zlib License",
}
# Identifiers of licences.
IDENTIFIERS = (
    "0BSD AFL-3.0 AGPL-3.0-only AGPL-3.0-or-later AGPL-3.0 Apache-1.1 Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSD-4-Clause BSL-1.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 EPL-1.0 EPL-2.0 EUPL-1.2 "
    "GPL-2.0 GPL-2.0+ GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0+ GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1 LGPL-2.1+ LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later "
    "MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL NCSA OFL-1.1 OpenSSL PostgreSQL PSF-2.0 Python-2.0 Unicode-3.0 Unlicense UPL-1.0 Vim W3C WTFPL Zlib"
).split()
#: Identifiers may be of later lists too; one that is not here fits no template.
_ONE = r"\(?[A-Za-z0-9.+-]+\)?"
SPDX = rf"(?i)SPDX-License-Identifier:\s*({_ONE}(?:\s+(?:OR|AND|WITH)\s+{_ONE})*)"
BARE = r"^\s*(?:The )?([A-Za-z0-9.+-]{2,40})(?: [Ll]icen[cs]e)?\.?\s*$"
LONG = 40  # words of a line that is compared as a whole
WIDE = 24  # words of a window of a sentence that is longer
ABOUT = r"(?i)licen[cs]|rights reserved|public domain|redistribution and use|permission to use|SPDX-|source code form"

#: Full licence texts, and the notices that stand at the head of files.
FULL = {f.name.removesuffix(".txt"): f.read_text() for f in sorted((Path(__file__).parent / "licences").glob("*.txt"))}
#: A word of these is in every one of them; a text without any is compared with none.
MARK = r"(?i)licen[cs]|warrant|permission|copyright|redistribut|public domain"
NAMED = r"(?i)(^|/)(un)?(licen[cs]e|copying)([.-][^/]*)?$"
COMMENT = r"^\s*(#|//|/?\*|--|;|%|<!--|\(\*)"


def _terms(line: str | Column) -> Column:
    """Lower-cased words of ASCII letters and digits."""
    return F.filter(F.split(F.lower(line), "[^a-z0-9]+"), lambda x: x != "")


def _line_terms(line: str | Column) -> Column:
    """The words of a line; of one with identifiers these alone, each as a whole."""
    col = F.col(line) if isinstance(line, str) else line
    ids = F.split(F.lower(F.regexp_replace(F.regexp_extract(col, SPDX, 1), "[()]", "")), r"\s+(?:or|and|with)\s+")
    return F.when(col.rlike(SPDX), F.transform(ids, lambda x: F.concat(F.lit("id:"), x))).otherwise(_terms(col))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _pieces(line: Column) -> Column:
    """A line, or what of it is compared by itself."""
    windows = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 1, F.lit(WIDE // 2)), lambda k: F.array_join(F.slice(w, k + 1, F.lit(WIDE)), " "))
    piece = lambda x: _let(F.split(F.trim(x), r"\s+"), lambda w: F.when(F.size(w) <= LONG, F.array(F.trim(x))).otherwise(windows(w)))
    sentences = F.split(F.regexp_replace(line, r"([.;!?])\s+", "$1\n"), "\n")
    return F.when(F.size(F.split(F.trim(line), r"\s+")) <= LONG, F.array(F.trim(line))).otherwise(F.flatten(F.transform(sentences, piece)))


def match_lines(lines: DataFrame, spark: SparkSession, least: float = 0.6) -> DataFrame:
    """(h, license, score) of the lines (h, line, n) that a template fits."""
    known = [(k, k, v) for k, v in TEMPLATES.items()] + [(k, f"{k} id", f"SPDX-License-Identifier: {k}") for k in IDENTIFIERS]
    templates = spark.createDataFrame(known, "license string, template string, line string")  # a fixed table
    words = lines.select("h", "n", F.explode(_line_terms("line")).alias("term")).groupBy("h", "n", "term").agg(F.count("*").alias("tf"))
    held = templates.select("license", "template", F.explode(_line_terms("line")).alias("term")).groupBy("license", "template", "term").agg(F.count("*").alias("tf"))
    total = (lines.agg(F.sum("n")).first()[0] or 0) + len(known)
    seen = words.select("term", F.col("n").alias("m")).unionByName(held.select("term", F.lit(1).cast("long").alias("m"))).groupBy("term").agg(F.sum("m").alias("df"))
    idf = seen.select("term", (F.log(F.lit(1.0 + total) / (1.0 + F.col("df"))) + 1).alias("idf"))
    words = words.join(idf, "term").select("h", "term", (F.col("tf") * F.col("idf")).alias("w"))
    held = held.join(idf, "term").select("license", "template", "term", (F.col("tf") * F.col("idf")).alias("v"))
    size = words.groupBy("h").agg(F.sqrt(F.sum(F.col("w") ** 2)).alias("size"))
    held_size = held.groupBy("template").agg(F.sqrt(F.sum(F.col("v") ** 2)).alias("held_size"))
    dots = words.join(F.broadcast(held), "term").groupBy("h", "license", "template").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    score = dots.join(size, "h").join(F.broadcast(held_size), "template").select("h", "license", F.round(F.col("dot") / (F.col("size") * F.col("held_size")), 6).alias("score"))
    best = score.where(F.col("score") >= least).groupBy("h").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b"))
    said = lines.select("h", F.regexp_replace(F.regexp_extract("line", SPDX, 1), r"\s+", " ").alias("said")).where("said like '% %'")
    told = best.join(said, "h", "left")
    return told.select("h", F.coalesce("said", "b.license").alias("license"), (-F.col("b.s")).alias("score"))


def match_texts(units: DataFrame, spark: SparkSession, least: float) -> DataFrame:
    """(file, license, score) of the texts (file, part, text) that a full
    text or a notice fits; term counts weigh by their logarithm, so that the
    words of all prose don't make texts alike."""
    count = lambda df, *keys: df.select(*keys, F.explode(_terms("text")).alias("term")).groupBy(*keys, "term").agg((1 + F.log(F.count("*"))).alias("tf"))
    words = count(units, "file", "part")
    held = count(spark.createDataFrame(list(FULL.items()), "full string, text string"), "full")  # a fixed table
    total = units.count() + len(FULL)
    seen = words.select("term").unionByName(held.select("term")).groupBy("term").agg(F.count("*").alias("df"))
    idf = seen.select("term", (F.log(F.lit(1.0 + total) / (1.0 + F.col("df"))) + 1).alias("idf"))
    words = words.join(idf, "term").select("file", "part", "term", (F.col("tf") * F.col("idf")).alias("w"))
    held = held.join(idf, "term").select("full", "term", (F.col("tf") * F.col("idf")).alias("v"))
    size = words.groupBy("file", "part").agg(F.sqrt(F.sum(F.col("w") ** 2)).alias("size"))
    held_size = held.groupBy("full").agg(F.sqrt(F.sum(F.col("v") ** 2)).alias("held_size"))
    rows = held.groupBy("term").agg(F.collect_list(F.struct("full", "v")).alias("in"))  # at most one for each text
    dots = words.join(F.broadcast(rows), "term").select("file", "part", "w", F.explode("in").alias("i")).groupBy("file", "part", "i.full").agg(F.sum(F.col("w") * F.col("i.v")).alias("dot"))
    score = dots.join(size, ["file", "part"]).join(F.broadcast(held_size), "full").select("file", "part", F.regexp_replace("full", r"\.header$", "").alias("license"), F.round(F.col("dot") / (F.col("size") * F.col("held_size")), 6).alias("score"), F.col("full").endswith(".header").alias("notice"))
    fits = score.where(F.col("score") >= least)
    best = fits.groupBy("file").agg(F.min(F.struct((-F.col("score")).alias("s"), "license", (F.col("notice") | (F.col("part") == "head")).alias("head"))).alias("b"))
    return best.select("file", F.col("b.license").alias("text_license"), (-F.col("b.s")).alias("text_score"), (~F.col("b.head")).alias("full"))


def scan(files: DataFrame, file_id: str = "file_id", path: str = "path", text: str = "text", least: float = 0.6, mostly: float = 0.5, alike: float = 0.8) -> DataFrame:
    """(file_id, path, own_license, own_score, license, origin, from_dir) of each file.

    ``origin``: ``file`` (a licence file), ``header``, ``inherited`` or ``none``.
    ``mostly``: share of a file's words in matched lines from which it is a licence file.
    ``alike``: least cosine of a whole text, or of its head of comments, to a full text.
    """
    spark = files.sparkSession
    src = files.select(F.col(file_id).alias("file_id"), F.col(path).cast("string").alias("path"), F.col(text).cast("string").alias("text"))
    known = F.md5(F.to_json(F.struct("file_id", "path", F.md5("text").alias("text"))))
    named_line = lambda x: F.when(F.col("path").rlike(NAMED) & x.rlike(BARE), F.concat(F.lit("SPDX-License-Identifier: "), F.regexp_extract(x, BARE, 1))).otherwise(x)
    told = F.filter(F.transform(F.split("text", "\r?\n"), named_line), lambda x: x.rlike(ABOUT))
    about = F.filter(F.flatten(F.transform(told, _pieces)), lambda x: x.rlike(ABOUT))
    dirs = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    src = src.select("file_id", "path", known.alias("file"), F.when(F.col("path").isNotNull(), dirs).alias("dir"), "text", about.alias("lines"))
    held = src.where(F.size("lines") > 0).select("file", "dir", F.size(F.split("text", r"\s+")).alias("n_words"), F.explode("lines").alias("line"))
    held = cut(held.withColumn("h", F.md5("line")), "lines")  # the texts are read once
    lines = held.groupBy("h").agg(F.count("*").alias("n"), F.any_value("line").alias("line"))
    found = held.select("file", "dir", "n_words", "h", F.size(F.split("line", r"\s+")).alias("n_line")).join(match_lines(lines, spark, least), "h")
    own = found.groupBy("file", "dir", "n_words").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b"), F.sum("n_line").alias("n_about"))
    own = own.select("file", "dir", F.col("b.license").alias("own_license"), (-F.col("b.s")).alias("own_score"), (F.col("n_about") >= mostly * F.col("n_words")).alias("speaks"))
    marked = src.where(F.col("text").rlike(MARK)).select("file", "text").dropDuplicates(["file"])
    row = F.split("text", "\r?\n")
    past = F.array_position(F.transform(row, lambda x: x.rlike(COMMENT)), False)
    head = F.array_join(F.when(past > 0, F.slice(row, F.lit(1), (past - 1).cast("int"))).otherwise(row), "\n")
    units = marked.select("file", F.explode(F.array(F.struct(F.lit("whole").alias("part"), "text"), F.struct(F.lit("head").alias("part"), head.alias("text")))).alias("u")).select("file", "u.part", "u.text").where("text <> ''")
    texts = cut(match_texts(units, spark, alike), "alike")
    each = cut(src.select("file_id", "path", "file", "dir"), "files")
    where = each.join(texts.select("file"), "file", "left_semi").select("file", "dir").distinct()
    own = own.unionByName(where.join(own, "file", "left_anti"), allowMissingColumns=True)
    own = own.join(texts, "file", "left")
    named = each.where(F.col("path").rlike(NAMED)).select("file").distinct().withColumn("named", F.lit(True))
    own = own.join(named, "file", "left").select(
        "file", "dir", F.coalesce("text_license", "own_license").alias("own_license"), F.coalesce("text_score", "own_score").alias("own_score"),
        (F.coalesce("speaks", F.lit(False)) | F.coalesce("full", F.lit(False)) | F.coalesce("named", F.lit(False))).alias("speaks"),
    )
    own = cut(own, "own")
    spoken = own.where("speaks and dir is not null").groupBy("dir").agg(F.min(F.struct((-F.col("own_score")).alias("s"), "own_license")).alias("b")).select(F.col("dir").alias("from_dir"), F.col("b.own_license").alias("dir_license"))
    dirs_ = each.where("dir is not null").groupBy("dir").agg(F.count("*").alias("many"))
    parts = F.split("dir", "/")
    up = dirs_.select("dir", F.explode(F.sequence(F.lit(0), F.size(parts))).alias("k")).select("dir", "k", F.array_join(F.slice(parts, F.lit(1), F.col("k")), "/").alias("from_dir"))
    nearest = salted(up, spoken, ["from_dir"]).groupBy("dir").agg(F.max(F.struct("k", "from_dir", "dir_license")).alias("b")).select("dir", F.col("b.from_dir").alias("from_dir"), F.col("b.dir_license").alias("dir_license"))
    out = each.join(own.select("file", "own_license", "own_score", "speaks"), "file", "left")
    out = by_key(out, nearest.join(dirs_, "dir"), "dir", "many", each.count())
    origin = F.when(F.col("speaks"), "file").when(F.col("own_license").isNotNull(), "header").when(F.col("dir_license").isNotNull(), "inherited").otherwise("none")
    return out.select("file_id", "path", "own_license", "own_score", F.coalesce("own_license", "dir_license").alias("license"), origin.alias("origin"), F.when(origin == "inherited", F.col("from_dir")).alias("from_dir"))


_VALUES = ", ".join(f"('{k}', '{k}', '{v}')" for k, v in TEMPLATES.items())
_IDS = ", ".join(f"('{k}', '{k} id', 'SPDX-License-Identifier: {k}')" for k in IDENTIFIERS)
_SPLIT = "regexp_split_to_array(trim(x, ' '), '\\s+')"
_SQL_TERMS = rf"""CASE WHEN regexp_matches(line, '{SPDX}') THEN list_transform(regexp_split_to_array(lower(regexp_replace(regexp_extract(line, '{SPDX}', 1), '[()]', '', 'g')), '\s+(?:or|and|with)\s+'), lambda x: 'id:' || x)
  ELSE list_filter(regexp_split_to_array(lower(line), '[^a-z0-9]+'), lambda x: x <> '') END"""
#: DuckDB's rows for the query over ``documents`` (see queries.py).
SQL = rf"""
WITH f AS (SELECT doc_id, concat_ws('/', source, lang, 'd' || doc_id) AS path, text FROM documents),
s AS (
  SELECT doc_id, path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, len(regexp_split_to_array(text, '\s+')) AS n_words,
         list_filter(list_transform(regexp_split_to_array(text, '\r?\n'), lambda x: CASE WHEN regexp_matches(path, '{NAMED}') AND regexp_matches(x, '{BARE}') THEN 'SPDX-License-Identifier: ' || regexp_extract(x, '{BARE}', 1) ELSE x END), lambda x: regexp_matches(x, '{ABOUT}')) AS told
  FROM f),
b1 AS (SELECT doc_id, dir, n_words, unnest(told) AS x FROM s),
b2 AS (SELECT doc_id, dir, n_words, unnest(CASE WHEN len({_SPLIT}) <= {LONG} THEN [trim(x, ' ')] ELSE string_split(regexp_replace(x, '([.;!?])\s+', '\1' || chr(10), 'g'), chr(10)) END) AS x FROM b1),
b3 AS (SELECT doc_id, dir, n_words, unnest(CASE WHEN len({_SPLIT}) <= {LONG} THEN [trim(x, ' ')] ELSE list_transform(range(0, len({_SPLIT}), {WIDE // 2}), lambda k: array_to_string({_SPLIT}[k + 1:k + {WIDE}], ' ')) END) AS line FROM b2),
h AS (SELECT * FROM b3 WHERE regexp_matches(line, '{ABOUT}')),
l AS (SELECT line, count(*) AS n FROM h GROUP BY line),
t(license, template, line) AS (VALUES {_VALUES}, {_IDS}),
lw AS (SELECT line, n, term, count(*) AS tf FROM (SELECT line, n, unnest({_SQL_TERMS}) AS term FROM l) GROUP BY ALL),
tw AS (SELECT license, template, term, count(*) AS tf FROM (SELECT license, template, unnest({_SQL_TERMS}) AS term FROM t) GROUP BY ALL),
df AS (SELECT term, sum(m) AS df FROM (SELECT term, n AS m FROM lw UNION ALL SELECT term, 1 FROM tw) GROUP BY term),
idf AS (SELECT term, ln((1.0::DOUBLE + (SELECT coalesce(sum(n), 0) FROM l) + {len(TEMPLATES) + len(IDENTIFIERS)}) / (1.0::DOUBLE + df)) + 1 AS idf FROM df),
a AS (SELECT line, term, tf * idf AS w FROM lw JOIN idf USING (term)),
b AS (SELECT license, template, term, tf * idf AS v FROM tw JOIN idf USING (term)),
c AS (
  SELECT line, license, round(dot / (sa.n * sb.n), 6) AS score
  FROM (SELECT line, license, template, sum(w * v) AS dot FROM a JOIN b USING (term) GROUP BY ALL)
  JOIN (SELECT line, sqrt(sum(w * w)) AS n FROM a GROUP BY line) sa USING (line)
  JOIN (SELECT template, sqrt(sum(v * v)) AS n FROM b GROUP BY template) sb USING (template)),
m AS (SELECT line, CASE WHEN regexp_extract(line, '{SPDX}', 1) LIKE '% %' THEN regexp_replace(regexp_extract(line, '{SPDX}', 1), '\s+', ' ', 'g') ELSE license END AS license, score FROM c WHERE score >= 0.6 QUALIFY row_number() OVER (PARTITION BY line ORDER BY score DESC, c.license) = 1),
o AS (
  SELECT doc_id, dir, first(license ORDER BY score DESC, license) AS own_license, max(score) AS own_score,
         sum(len(regexp_split_to_array(line, '\s+'))) >= 0.5 * n_words AS speaks
  FROM h JOIN m USING (line) GROUP BY doc_id, dir, n_words),
d AS (SELECT dir AS from_dir, first(own_license ORDER BY own_score DESC, own_license) AS dir_license FROM o WHERE speaks GROUP BY dir),
u AS (SELECT DISTINCT dir FROM s),
n AS (
  SELECT dir, k, array_to_string(string_split(dir, '/')[1:k], '/') AS from_dir
  FROM (SELECT dir, unnest(range(0, len(string_split(dir, '/')) + 1)) AS k FROM u)),
r AS (SELECT dir, from_dir, dir_license FROM n JOIN d USING (from_dir) QUALIFY row_number() OVER (PARTITION BY dir ORDER BY k DESC) = 1)
SELECT s.doc_id, s.path, own_license, own_score, coalesce(own_license, dir_license) AS license,
       CASE WHEN speaks THEN 'file' WHEN own_license IS NOT NULL THEN 'header' WHEN dir_license IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
       CASE WHEN own_license IS NULL THEN r.from_dir END AS from_dir
FROM s LEFT JOIN o USING (doc_id) LEFT JOIN r ON s.dir = r.dir
"""
