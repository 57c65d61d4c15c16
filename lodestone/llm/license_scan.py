"""License scans with DataFrame functions alone.

What is compared are each line of a file, and each header block: a run of two or more neighbouring lines that the tests below leave, as a statement that is wrapped over lines makes one. Lines and blocks are compared with
license templates, sentences and whole headers, by the cosine of sparse TF-IDF vectors: tf counts words, idf = ln((1 + T) / (1 + df)) + 1 over the T templates, and words in no template have the largest idf and count
once each. Of each template the most frequent common words are set apart, as many as hold less than threshold^2 of its squared length, so a line that meets it in these alone stays below the threshold
(Cauchy-Schwarz), and lines without any other template word are out before their words are counted, as are lines with too many words outside for the few inside; no line that reaches the threshold is out. A file's own
license is that of its best line or block of at least `threshold` (ties: earlier begin, then earlier end, then template name). Texts are cut into words once.

A file is a license file if its name says so (LICENSE, LICENCE, COPYING, UNLICENSE, NOTICE, with any ending) or if lines that carry a license hold at least FILE_SHARE of its characters. A directory's license
is that of its license files (the best, then the first path). Files without a license of their own inherit that of the nearest directory above, by a join on their ancestor paths.

Cases: null and empty texts have no license of their own and may inherit; whole texts are read, however long; repeated rows each get a row; null paths neither give nor inherit; without any license every
file is `none`; other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import cut

FILE_SHARE = 0.8
THRESHOLD = 0.7

# Statements by which files name their license: sentences, whole headers, and the titles of the licenses' own texts where no single word of them would do.
TEMPLATES = [
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0."),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3 or later."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-2.1", "SPDX-License-Identifier: LGPL-2.1"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
# Words of the templates that most prose holds, the most frequent first.
COMMON = ["the", "of", "and", "to", "a", "in", "is", "that", "it", "for", "as", "with", "be", "this", "by", "are", "or", "not", "at", "you", "all", "has", "can", "may", "any", "use", "its", "on", "from", "was", "have", "one", "if", "so", "an", "do", "no", "out", "above", "see", "either", "more"]
WORD = "[a-z0-9]+"
FILE_NAME = "(?i)^(licen[cs]e|copying|unlicense|notice)([._-].*)?$"


def _tokens(text):
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def template_weights(spark) -> DataFrame:
    """(template, license, word, weight): each template's TF-IDF vector at length 1."""
    rows = spark.createDataFrame([(i, *t) for i, t in enumerate(TEMPLATES)], "template int, license string, text string")
    tf = rows.select("template", "license", F.explode(_tokens("text")).alias("word")).groupBy("template", "license", "word").agg(F.count("*").alias("tf"))
    df = tf.groupBy("word").agg(F.count("*").alias("df"))
    raw = tf.join(df, "word").select("template", "license", "word", (F.col("tf") * (F.log(F.lit((1 + len(TEMPLATES)) * 1.0) / (1 + F.col("df"))) + 1)).alias("w"))
    norm = raw.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, "template").select("template", "license", "word", (F.col("w") / F.col("norm")).alias("weight"))


def _idf() -> dict[str, float]:
    """idf of the templates' words, from the fixed texts."""
    import math
    import re

    df: dict[str, int] = {}
    for _, text in TEMPLATES:
        for w in set(re.findall(WORD, text.lower())):
            df[w] = df.get(w, 0) + 1
    return {w: math.log((1 + len(TEMPLATES)) / (1 + n)) + 1 for w, n in sorted(df.items())}


def strong_words(threshold: float) -> list[str]:
    """Words of which a line of at least `threshold` holds one: of each template those but the most frequent COMMON words, as many as hold less than threshold^2 of its squared length."""
    import re

    idf, strong = _idf(), set()
    for _, text in TEMPLATES:
        words = re.findall(WORD, text.lower())
        v = {w: (words.count(w) * idf[w]) ** 2 for w in set(words)}
        left = threshold * threshold * 0.999 * sum(v.values())
        for w in [w for w in COMMON if w in v]:
            left -= v[w]
            if left <= 0:
                break
            del v[w]
        strong |= set(v)
    return sorted(strong)


def likely_lines(files: DataFrame, threshold: float) -> DataFrame:
    """(rid, line, chars, file_chars, words) of the lines of files(rid, text) that may reach the threshold."""
    known = F.array(*[F.lit(w) for w in _idf()])
    strong = F.array(*[F.lit(w) for w in strong_words(threshold)])
    lines = files.select("rid", F.length("text").alias("file_chars"), F.posexplode(F.split("text", "\n")).alias("line", "value"))
    lines = lines.select("rid", "line", F.length("value").alias("chars"), "file_chars", _tokens("value").alias("words")).where(F.arrays_overlap("words", strong))
    # n words inside have a squared length of n^2 largest^2 at most, m outside of m largest^2
    inside = F.size(F.filter("words", lambda w: F.array_contains(known, w)))
    return lines.where(inside * inside * (1 - threshold * threshold) >= threshold * threshold * 0.999 * (F.size("words") - inside))


def licensed(units: DataFrame, threshold: float) -> DataFrame:
    """units(rid, line, last, words array<array<string>>) that carry a license, with it and its similarity in place of the words."""
    import math

    idf = _idf()
    largest = math.log(1 + len(TEMPLATES)) + 1
    keys = ["rid", "line", "last"]
    words = units.select(*keys, F.explode(F.flatten("words")).alias("word")).groupBy(*keys, "word").agg(F.count("*").alias("c"))
    spark = units.sparkSession
    table = spark.createDataFrame(list(idf.items()), "word string, idf double")
    # both tables come from the fixed templates: some hundred rows
    terms = words.join(F.broadcast(table), "word", "left")
    length = F.sum(F.when(F.col("idf").isNull(), F.col("c") * largest * largest).otherwise(F.col("c") * F.col("c") * F.col("idf") * F.col("idf")))
    lengths = terms.groupBy(*keys).agg(F.sqrt(length).alias("length"))
    dots = terms.join(F.broadcast(template_weights(spark)), "word").groupBy(*keys, "template", "license").agg(F.sum(F.col("c") * F.col("idf") * F.col("weight")).alias("dot"))
    scores = dots.join(lengths, keys).select(*keys, "license", F.round(F.col("dot") / F.col("length"), 6).alias("similarity")).where(F.col("similarity") >= threshold)
    best = scores.groupBy(*keys).agg(F.min(F.struct((-F.col("similarity")).alias("s"), "license")).alias("b"))
    return best.select(*keys, F.col("b.license").alias("license"), (-F.col("b.s")).alias("similarity"))


def line_licenses(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(rid, line, license, similarity) of the single lines of files(rid, text) that carry a license."""
    lines = likely_lines(files, threshold)
    return licensed(lines.select("rid", "line", F.col("line").alias("last"), F.array("words").alias("words")), threshold).drop("last")


def licenses_of(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(rid, line, last, license, similarity, licensed_chars, chars): of each of files(rid, text) with a license its best line or header block, and the characters of all lines that carry one."""
    lines = cut(likely_lines(files, threshold), "license-lines")  # read four times below, so that texts are cut into words once
    # neighbouring lines have one difference between their number and their place among the likely ones; a file's own lines
    run = lines.withColumn("run", F.col("line") - F.row_number().over(Window.partitionBy("rid").orderBy("line")))
    inner = F.transform(F.array_sort(F.collect_list(F.struct("line", "words"))), lambda x: x["words"])
    blocks = run.groupBy("rid", "run").agg(F.min("line").alias("line"), F.max("line").alias("last"), inner.alias("words")).where("last > line").drop("run")
    singles = lines.select("rid", "line", F.col("line").alias("last"), F.array("words").alias("words"))
    found = cut(licensed(singles.unionByName(blocks), threshold), "license-units")
    best = found.groupBy("rid").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "line", "last", "license")).alias("b"))
    covered = found.select("rid", F.explode(F.sequence("line", "last")).alias("line")).distinct().join(lines.select("rid", "line", "chars", "file_chars"), ["rid", "line"])
    sizes = covered.groupBy("rid").agg(F.sum("chars").alias("licensed_chars"), F.max("file_chars").alias("chars"))
    return best.join(sizes, "rid").select("rid", "b.line", "b.last", "b.license", (-F.col("b.s")).alias("similarity"), "licensed_chars", "chars")


def ancestors(path):
    """All directories above a path, the root '' included."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def scan(files: DataFrame, id_column: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """(id, path, license, similarity, via, from_path) of each row of files(id, path, text); via is own, inherited or none."""
    files = files.select(F.col(id_column).alias("id"), "path", "text").withColumn("rid", F.xxhash64("id", "path", "text"))
    own = licenses_of(files.dropDuplicates(["rid"]), threshold)
    found = files.select("id", "path", "rid").join(own, "rid", "left").select("id", "path", "license", "similarity", "chars", "licensed_chars")
    found = cut(found, "license-own")  # read three times below
    name = F.element_at(F.split("path", "/"), -1)
    is_file = F.col("license").isNotNull() & (name.rlike(FILE_NAME) | (F.col("licensed_chars") >= FILE_SHARE * F.col("chars")))
    directory = F.array_join(F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1), "/")
    givers = found.where(F.col("path").isNotNull() & is_file).groupBy(directory.alias("dir")).agg(F.min(F.struct((-F.col("similarity")).alias("s"), "path", "license")).alias("g"))
    without = found.where("license is null and path is not null").select("path").distinct()
    reach = without.select("path", F.explode(ancestors(F.col("path"))).alias("dir")).join(givers, "dir")
    near = reach.groupBy("path").agg(F.max(F.struct(F.when(F.col("dir") == "", 0).otherwise(F.size(F.split("dir", "/"))).alias("depth"), "g")).alias("n"))
    near = near.select("path", F.col("n.g.license").alias("given"), (-F.col("n.g.s")).alias("given_similarity"), F.col("n.g.path").alias("from_path"))
    out = found.join(near, "path", "left")
    mine = F.col("license").isNotNull()
    return out.select(
        F.col("id").alias(id_column),
        "path",
        F.coalesce("license", "given").alias("license"),
        F.coalesce("similarity", "given_similarity").alias("similarity"),
        F.when(mine, "own").when(F.col("given").isNotNull(), "inherited").otherwise("none").alias("via"),
        F.when(mine, F.col("path")).otherwise(F.col("from_path")).alias("from_path"),
    )
