"""Licence scans of real licence files and headers, and the pruning against all sentences."""

import os

import pytest

from fundloom.llm import licences
from fundloom.llm.licence_texts import SENTENCES

MIT = """The MIT License (MIT)

Copyright (c) 2020 A Person

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
BSD = """Copyright (c) 2020, A Person
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
"""
NEITHER = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
APACHE_HEADER = """#!/usr/bin/env python
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
import os
"""


def scan(spark, rows):
    files = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, path string, text string")
    return {r.path: (r.licence, r.origin) for r in licences.scan_licences(files).collect()}


def test_licence_files_headers_and_identifiers(spark):
    filler = [(f"x/{i}.py", f"the value of this file is {i} and it is used for the other software in all places") for i in range(30)]
    got = scan(
        spark,
        [
            ("p/LICENSE", MIT),
            ("p/x.py", "print(1)"),
            ("q/a.py", "# SPDX-License-Identifier: Apache-2.0\nimport os"),
            ("q2/b.py", "# SPDX-License-Identifier: Proprietary-1.0\nimport os"),
            ("r/LICENSE.txt", BSD),
            ("s/LICENSE.txt", BSD + NEITHER),
            ("s/deep/down/x.c", "int x;"),
            ("t/x.py", APACHE_HEADER),
            ("u/x.c", "/* SPDX-License-Identifier: GPL-2.0 */\r\nint x;"),
            ("v/none.py", "this permission is not a licence of any kind"),
            *filler,
        ],
    )
    assert got["p/LICENSE"] == ("MIT", "own") and got["p/x.py"] == ("MIT", "inherited")
    assert got["q/a.py"] == ("Apache-2.0", "own") and got["q2/b.py"] == (None, "none")
    assert got["r/LICENSE.txt"][0] == "BSD-2-Clause" and got["s/LICENSE.txt"][0] == "BSD-3-Clause"
    assert got["s/deep/down/x.c"] == ("BSD-3-Clause", "inherited")
    assert got["t/x.py"] == ("Apache-2.0", "own") and got["u/x.c"] == ("GPL-2.0", "own")
    assert got["v/none.py"] == (None, "none") and all(got[p] == (None, "none") for p, _ in filler)


@pytest.mark.skipif(not os.path.isdir("/usr/share/common-licenses"), reason="no licence files here")
def test_whole_licence_files_of_the_system(spark):
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0"}
    rows = []
    for name in names:
        with open(f"/usr/share/common-licenses/{name}", encoding="utf-8") as f:
            rows.append((f"{name}/COPYING", f.read()))
    rows += [(f"x/{i}.py", f"the value of this file is {i} and it is used for the other software in all places") for i in range(30)]
    got = scan(spark, rows)
    assert {n: got[f"{n}/COPYING"][0] for n in names} == names


def test_common_words_weigh_little(spark):
    header = "Licensed under the Apache License, Version 2.0 - see the LICENSE file for details"
    rows = [(0, "a/0.txt", header)]
    rows += [(i, f"b/{i}.txt", "We see this file for all the details of it.\n" + ("Licensed under the Apache License, Version 2.0." if i % 3 == 0 else "No more of it.")) for i in range(1, 301)]
    files = spark.createDataFrame(rows, "doc_id long, path string, text string")
    for times in (1, 20):
        more = files.crossJoin(spark.range(times).toDF("t")).where("doc_id > 0 OR t = 0")
        got = licences.scan_licences(more).where("doc_id = 0").first()
        assert (got.licence, got.origin) == ("Apache-2.0", "own")


def test_frequencies_of_all_terms(spark):
    docs = spark.createDataFrame([("the cat and the dog",), ("a dog",), (None,)], "text string")
    assert {r.term: r.df for r in licences.document_frequencies(docs).collect()} == {"the": 1, "cat": 1, "and": 1, "dog": 2, "a": 1}


def test_pruning_loses_no_sentence_that_is_near_enough():
    import math
    import random
    from collections import Counter

    rng = random.Random(3)
    rows = [(licence, text, None) for licence, text in SENTENCES]
    vocabulary = sorted({t for _, text, _ in rows for t in licences._plain_terms(text)})
    idf = {t: 1 + 8 * rng.random() for t in vocabulary}
    keys = set(licences.key_terms(rows, idf, 0.6))
    assert len(keys) < len(vocabulary)
    levels = licences.share_levels(rows, idf)
    assert sorted(t for level, _ in levels for t in level) == vocabulary

    def vector(terms):
        return {t: n * idf.get(t, 6.0) for t, n in Counter(terms).items()}

    near = 0
    for _ in range(3000):
        base = licences._plain_terms(rng.choice(rows)[1])
        kept = [t for t in base if rng.random() < 0.5] + ["other"] * rng.randint(0, 3)
        if not kept:
            continue
        u = vector(kept)
        for _, text, _ in rows:
            w = vector(licences._plain_terms(text))
            cosine = sum(u[t] * w.get(t, 0) for t in u) / math.sqrt(sum(x * x for x in u.values()) * sum(x * x for x in w.values()))
            if cosine >= 0.6:
                near += 1
                assert keys & set(kept)
                assert sum(len(set(level) & set(kept)) * most for level, most in levels) >= 0.999 * 0.36
    assert near > 1000


def test_nulls_long_texts_repeats_and_clashing_columns(spark):
    rows = [(None, None, None, "a"), (1, "d/x", "", "b"), (2, "d/LICENSE", MIT, "c"), (2, "d/LICENSE", MIT, "d"), (3, "d/y", "word " * 250_000 + "\nReleased under the MIT License.", "e")]
    files = spark.createDataFrame(rows, "doc_id long, path string, text string, licence string")
    got = sorted((str(r.doc_id), r.licence or "", r.origin) for r in licences.scan_licences(files).collect())
    assert got == [("1", "MIT", "inherited"), ("2", "MIT", "own"), ("2", "MIT", "own"), ("3", "MIT", "own"), ("None", "", "none")]
    assert licences.scan_licences(files.where("false")).count() == 0
