"""Licence scans with DataFrame functions only.

Units are the lines of a file that speak of a licence (anywhere in the whole
text), comments of several lines that do, and licence files as a whole. Units
and templates become sparse TF-IDF vectors and meet by term; the best cosine
names the licence. Lines are compared with notices, comments and licence files
also with headers and full texts. Documents are counted for the weights over
lines, licence files and notices, so the others don't change what a line gets.
Files without a licence
inherit that of the nearest ancestor directory with a licence file, found by
joining the ancestors of each directory (not of each file) with the
directories of licence files.
"""

from __future__ import annotations

import pkgutil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

#: Usual notices of well-known licences.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is granted under the ISC License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain under the Unlicense."),
]
_GNU = "This {0} is free software{1} you can redistribute it and/or modify it under the terms of the GNU {2} as published by the Free Software Foundation; either version {3} of the License, or (at your option) any later version. This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {2} for more details. You should have received a copy of the GNU {2} along with this {0}."
#: The usual headers of several lines.
HEADERS = [
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("GPL-2.0", _GNU.format("program", ";", "General Public License", "2")),
    ("GPL-3.0", _GNU.format("program", ":", "General Public License", "3")),
    ("AGPL-3.0", _GNU.format("program", ":", "Affero General Public License", "3")),
    ("LGPL-2.1", _GNU.format("library", ";", "Lesser General Public License", "2.1")),
    ("LGPL-3.0", _GNU.format("library", ":", "Lesser General Public License", "3")),
]
#: Full texts, from license_texts.
TEXTS = ["Apache-2.0", "Artistic-1.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "GPL-1.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-1.1", "MPL-2.0", "Unlicense"]
#: What AGPL-3.0 says in section 13, where GPL-3.0 speaks of it.
_REMOTE = "13. Remote Network Interaction; Use with the GNU General Public License. Notwithstanding any other provision of this License, if you modify the Program, your modified version must prominently offer all users interacting with it remotely through a computer network (if your version supports such interaction) an opportunity to receive the Corresponding Source of your version by providing access to the Corresponding Source from a network server at no charge, through some standard or customary means of facilitating copying of software.\n\n  "
#: Comments of several lines: C, HTML, docstrings, lines with a mark each.
COMMENT = r'''(?m)/\*(?:[^*]|\*(?!/))*+\*/|<!--(?:[^-]|-(?!->))*+-->|"""(?:[^"]|"(?!""))*+"""|(?:^[ \t]*(?:#|//|\*|--|;|%|dnl\b|REM\b)[^\n]*(?:\n|\z)){2,}+'''
MARKS = r'''(?m)^[ \t]*(?:#+|//+|/\*+|\*+/?|--+|;+|%+|dnl\b|REM\b)|\*/|<!--|-->|"""'''
#: A line that may be a notice.
NOTICE = r"(?i)licen[cs]|copyright|spdx|public domain|permission|redistribut"
#: Base names of licence files.
LICENSE_FILE = r"(?i)^(licen[cs]e|copying|unlicense)([-._].*)?$"


def _terms(text) -> F.Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}.]+|\.+(?=\s|$)"), lambda t: t != "")


def _vectors(units: DataFrame) -> DataFrame:
    """(unit, term, tf) of (unit, text)."""
    return units.select("unit", F.explode(_terms(F.col("text"))).alias("term")).groupBy("unit", "term").agg(F.count("*").alias("tf"))


def _best(rows: DataFrame, *by: str) -> DataFrame:
    """The license of the greatest similarity, first by name of equals, for each of by."""
    order = F.struct((-F.col("similarity")).alias("s"), "license")
    return rows.groupBy(*by).agg(F.min(order).alias("x")).select(*by, F.col("x.license").alias("license"), (-F.col("x.s")).alias("similarity"))


def full_texts() -> list[tuple[str, str]]:
    """HEADERS and the full texts; that of AGPL-3.0 is made of GPL-3.0's, from which it differs in names and section 13."""
    texts = [(lic, pkgutil.get_data(__package__, f"license_texts/{lic}.txt").decode()) for lic in TEXTS]
    gpl = dict(texts)["GPL-3.0"]
    start, end = gpl.index("13. Use with the GNU Affero"), gpl.index("14. Revised Versions")
    affero = (gpl[:start] + _REMOTE + gpl[end:]).replace("GNU General Public", "GNU Affero General Public").replace("GNU GENERAL PUBLIC", "GNU AFFERO GENERAL PUBLIC")
    return [*HEADERS, *texts, ("AGPL-3.0", affero)]


def scan_licenses(spark: SparkSession, files: DataFrame, threshold: float = 0.5, templates: list = TEMPLATES, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text") -> DataFrame:
    """(doc_id, license, similarity, origin) of every row of files.

    origin: 'own' for a notice, comment or licence file of at least `threshold` cosine
    (ties go to the first license by name), 'inherited' from the nearest
    ancestor directory (its own first) that has a licence file with a licence,
    'none' otherwise with null license and similarity. In a directory with
    several licence files the most similar counts, then the first by name. Null
    and empty texts have no notices; a null path has no directory; repeated and
    null ids are files of their own; an empty table gives no rows.
    """
    path = F.coalesce(F.col(path_col), F.lit(""))
    files = files.select(F.col(id_col).alias("doc_id"), path.alias("path"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    name = F.element_at(F.split("path", "/"), -1)
    files = files.withColumn("dir", F.regexp_replace("path", r"/?[^/]*$", "")).withColumn("is_license", name.rlike(LICENSE_FILE))
    lines = F.when(F.col("is_license"), F.array("text")).otherwise(F.filter(F.split("text", "\n"), lambda x: x.rlike(NOTICE)))
    comments = F.filter(F.regexp_extract_all("text", F.lit(COMMENT), F.lit(0)), lambda x: x.contains("\n") & x.rlike(NOTICE))
    comments = F.when(F.col("is_license"), F.array().cast("array<string>")).otherwise(F.transform(comments, lambda x: F.regexp_replace(x, MARKS, " ")))
    as_units = lambda texts, kind: F.transform(texts, lambda x: F.struct(kind.alias("kind"), x.alias("text")))
    units = F.array_distinct(F.concat(as_units(lines, F.when(F.col("is_license"), "file").otherwise("line")), as_units(comments, F.lit("comment"))))
    units = F.when(F.col("is_license") | F.col("text").rlike(NOTICE), units)
    # texts are read once: what goes on is a number for each file, its directory, and the few units
    files = materialize(files.select(F.monotonically_increasing_id().alias("row"), "doc_id", "dir", "is_license", units.alias("units")), "files")
    spoken = files.select("row", "dir", "is_license", F.explode("units").alias("u")).select("row", "dir", "is_license", "u.kind", "u.text")
    notices = spoken.select("kind", "text").distinct().withColumn("unit", F.concat("kind", F.sha2("text", 256)))

    whole = full_texts() if templates is TEMPLATES else []
    known = spark.createDataFrame([(f"{k:03d}", lic, text, k >= len(templates)) for k, (lic, text) in enumerate([*templates, *whole])], "unit string, license string, text string, whole boolean")
    terms = _vectors(notices)
    model = _vectors(known)
    counted = notices.where("kind != 'comment'")
    total = counted.select("text").distinct().count() + len(templates)  # distinct notices; every number below is over all of them
    seen = terms.join(counted.select("unit", F.sha2("text", 256).alias("same")), "unit").select("same", "term").distinct()
    short = known.where("not whole").select("unit")
    frequency = seen.select("term").union(model.join(short, "unit").select("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = F.col("tf") * (F.log((1 + F.lit(total)) / (1 + F.coalesce("df", F.lit(0)))) + 1)
    terms, model = (x.join(frequency, "term", "left").withColumn("w", weight).select("unit", "term", "w") for x in (terms, model))
    norms, model_norms = (x.groupBy("unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias(n)) for x, n in ((terms, "norm"), (model, "model_norm")))
    met = model.join(known.select("unit", F.explode(F.when(F.col("whole"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))).alias("is_line")), "unit")
    dots = terms.withColumn("is_line", F.col("unit").startswith("line")).join(met.select(F.col("unit").alias("template"), "is_line", "term", F.col("w").alias("v")), ["is_line", "term"]).groupBy("unit", "template").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    cosine = dots.join(norms, "unit").join(model_norms.withColumnRenamed("unit", "template"), "template").join(known.select(F.col("unit").alias("template"), "license"), "template")
    cosine = cosine.withColumn("similarity", F.round(F.col("dot") / (F.col("norm") * F.col("model_norm")), 6)).where(F.col("similarity") >= threshold)
    named = _best(cosine, "unit").join(notices, "unit").select("kind", "text", "license", "similarity")

    own = _best(spoken.join(named, ["kind", "text"]), "row", "dir", "is_license")
    holders = _best(own.where("is_license"), "dir").select(F.col("dir").alias("holder"), F.col("similarity").alias("up_similarity"), F.col("license").alias("up_license"))
    dirs = files.select("dir").distinct()
    parts = F.split("dir", "/")
    up = dirs.select("dir", F.explode(F.sequence(F.lit(0), F.when(F.col("dir") == "", 0).otherwise(F.size(parts)))).alias("depth")).withColumn("holder", F.array_join(F.slice(parts, 1, F.col("depth")), "/"))
    up = up.join(holders, "holder").groupBy("dir").agg(F.max_by(F.struct("up_license", "up_similarity"), "depth").alias("up"))

    out = files.select("doc_id", "dir", "row").join(own.select("row", "license", "similarity"), "row", "left").join(up, "dir", "left")
    return out.select(
        "doc_id",
        F.coalesce("license", "up.up_license").alias("license"),
        F.coalesce("similarity", "up.up_similarity").alias("similarity"),
        F.when(F.col("license").isNotNull(), "own").when(F.col("up").isNotNull(), "inherited").otherwise("none").alias("origin"),
    )
