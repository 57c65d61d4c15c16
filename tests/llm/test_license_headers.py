"""Headers that are wrapped over lines, license files, and the registered query against its SQL."""

from lodestone.llm import license_scan as S
from lodestone.llm import queries

from ..oracle import both, connect

GPL = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version."""
LGPL = """ * This library is free software; you can redistribute it and/or
 * modify it under the terms of the GNU Lesser General Public
 * License as published by the Free Software Foundation; either
 * version 2.1 of the License, or (at your option) any later version."""
APACHE = """// Licensed under the Apache License, Version 2.0 (the "License");
// you may not use this file except in compliance with the License.
// You may obtain a copy of the License at
//
//     http://www.apache.org/licenses/LICENSE-2.0
//
// Unless required by applicable law or agreed to in writing, software
// distributed under the License is distributed on an "AS IS" BASIS,
// WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""
MIT = """MIT License

Copyright (c) 2024 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:
"""


def test_wrapped_headers_and_license_file(spark):
    code = "\n\nint main() { return 0; }\n" + "x = y\n" * 40
    files = [(1, "a/g.py", GPL + code), (2, "a/l.c", LGPL + code), (3, "a/p.js", APACHE + code), (4, "a/LICENSE", MIT), (5, "a/deep/er/q.py", code), (6, "b/r.py", code)]
    rows = {r["doc_id"]: (r["license"], r["via"]) for r in S.scan(spark.createDataFrame(files, "doc_id long, path string, text string")).collect()}
    assert rows == {1: ("GPL-3.0", "own"), 2: ("LGPL-2.1", "own"), 3: ("Apache-2.0", "own"), 4: ("MIT", "own"), 5: ("MIT", "inherited"), 6: (None, "none")}


def test_ties_go_to_the_earlier_line_then_the_name(spark):
    text = "Released under the MIT License.\nnothing of that kind\nReleased under the MIT License."
    rows = S.licenses_of(spark.createDataFrame([(1, text)], "rid long, text string")).collect()
    assert [(r["line"], r["last"], r["license"], r["similarity"]) for r in rows] == [(0, 0, "MIT", 1.0)]


def test_query_against_sql(spark):
    mine, theirs = both(spark, connect("/root/testdata/sf0.001"), queries.op1_license_scan, queries.oracle_sql()["op1_license_scan"], "/root/testdata/sf0.001")
    assert mine == theirs


AGPL_FILE = """                    GNU AFFERO GENERAL PUBLIC LICENSE
                       Version 3, 19 November 2007

 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>
 Everyone is permitted to copy and distribute verbatim copies
 of this license document, but changing it is not allowed."""
BSD = """Copyright (c) 2024, Somebody
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
"""


def test_kin_and_the_licenses_own_texts(spark):
    gpl = AGPL_FILE.replace("AFFERO ", "").replace("19 November", "29 June")
    apache = "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"
    wanted = {
        "AGPL-3.0": [GPL.replace("GNU General", "GNU Affero General"), AGPL_FILE, "# SPDX-License-Identifier: AGPL-3.0-or-later"],
        "GPL-3.0": [GPL, gpl, "# SPDX-License-Identifier: GPL-3.0-or-later", "// SPDX-License-Identifier: GPL-3.0-only"],
        "GPL-2.0": [gpl.replace("3, 29 June 2007", "2, June 1991"), "/* SPDX-License-Identifier: GPL-2.0 */"],
        "LGPL-3.0": [gpl.replace("GNU GENERAL", "GNU LESSER GENERAL")],
        "LGPL-2.1": [LGPL, gpl.replace("GNU GENERAL", "GNU LESSER GENERAL").replace("3, 29 June 2007", "2.1, February 1999")],
        "Apache-2.0": [APACHE, apache],
        "BSD-2-Clause": ["BSD 2-Clause License\n\n" + BSD],
        "BSD-3-Clause": ["BSD 3-Clause License\n\n" + BSD, BSD],
        "EPL-2.0": ["Eclipse Public License - v 2.0\n\n    THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE"],
        "MPL-2.0": ["// SPDX-License-Identifier: MPL-2.0"],
    }
    cases = [(name, text) for name, texts in wanted.items() for text in texts]
    files = spark.createDataFrame([(i, text) for i, (_, text) in enumerate(cases)], "rid long, text string")
    assert {r["rid"]: r["license"] for r in S.licenses_of(files).collect()} == {i: name for i, (name, _) in enumerate(cases)}


def test_no_single_word_is_a_license():
    import re

    from .test_license_scan import similarity

    for _, text in S.TEMPLATES:
        for word in set(re.findall(S.WORD, text.lower())):
            assert similarity(word)[0] < S.THRESHOLD, word
