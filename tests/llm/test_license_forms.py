"""Licences that short notices alone don't find."""

import pytest
from pyspark.sql import functions as F

from spanloom.llm import licenses

PROSE = "the text of a file that is for all and to be in any of the folders or on the use of it\n" * 20
FILES = {
    "a/1": ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"),
    "a/2": ("x\n# SPDX-License-Identifier: MIT\n", "MIT"),
    "a/3": ("/* SPDX-License-Identifier: GPL-2.0 OR MIT */", "GPL-2.0 OR MIT"),
    "a/4": ("// Permission is hereby granted, free of charge, to any person obtaining a copy", "MIT"),
    "a/5": (PROSE, None),
    "a/6": ("mit\nmit the\nmit mit", None),
    "a/7": ("Released under MIT", "MIT"),
    "b/LICENSE": ("Copyright (c) 2020 Someone\n\n" + licenses.BODIES["MIT"], "MIT"),
    "c/LICENSE": ("Copyright (c) 2020 Someone\n" + licenses.BODIES["BSD-3-Clause"], "BSD-3-Clause"),
    "d/LICENSE": ("Copyright (c) 2020 Someone\n" + licenses.BODIES["BSD-2-Clause"], "BSD-2-Clause"),
    "e/COPYING": ("                    GNU AFFERO GENERAL PUBLIC LICENSE\n                       Version 3, 19 November 2007\n\n Preamble", "AGPL-3.0"),
    "f/COPYING": ("GNU GENERAL PUBLIC LICENSE\n\nVersion 3, 29 June 2007\n", "GPL-3.0"),
    "g/LICENSE": (PROSE, None),
}


def test_forms(spark):
    df = spark.createDataFrame([(p, t) for p, (t, _) in FILES.items()] + [("c/x.c", "code")], "path string, text string")
    got = {r.path: r.licence for r in licenses.scan(df, "path").collect()}
    assert got == {p: n for p, (_, n) in FILES.items()} | {"c/x.c": "BSD-3-Clause"}


def test_gate_loses_no_line():
    vectors, _, _ = licenses.weights(licenses.TEMPLATES)
    kept = set(licenses.rarer(vectors, licenses.THRESHOLD))
    for v in vectors.values():
        assert sum(w * w for t, w in v.items() if t not in kept) < licenses.THRESHOLD**2
