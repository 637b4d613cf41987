"""Licence scan: sparse TF-IDF cosine of text lines to licence templates, and inheritance along the path.

Every line of a file that holds one of the templates' rarer words is compared
with the templates, an SPDX tag is taken as it stands, and a licence file is
also compared as a whole with licence bodies. A licence file speaks for its
folder; a file that states no licence itself takes that of the nearest folder
above it that has one.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import ship
from spanloom.session import settle

THRESHOLD = 0.6
#: Short notices by which files state their licence; what follows a space tells notices of one licence apart.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": "Use of this source code is governed by the BSD 2-Clause Simplified License.",
    "BSD-3-Clause": "Use of this source code is governed by the BSD 3-Clause License.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright under CC0 1.0 Universal public domain dedication.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "AGPL-3.0 title": "GNU Affero General Public License Version 3, 19 November 2007",
    "Apache-2.0 title": "Apache License Version 2.0, January 2004",
    "BSD-2-Clause title": "BSD 2-Clause License",
    "BSD-3-Clause title": "BSD 3-Clause License",
    "CC0-1.0 short": "Licensed under CC0 1.0.",
    "GPL-2.0 title": "GNU General Public License Version 2, June 1991",
    "GPL-3.0 title": "GNU General Public License Version 3, 29 June 2007",
    "ISC": "Released under the ISC License.",
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-2.1 title": "GNU Lesser General Public License Version 2.1, February 1999",
    "LGPL-3.0 title": "GNU Lesser General Public License Version 3, 29 June 2007",
    "MIT grant": "Permission is hereby granted, free of charge, to any person obtaining a copy",
    "MIT title": "The MIT License (MIT)",
    "ISC grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "MPL-2.0 title": "Mozilla Public License Version 2.0",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
for _short, _long in {"": "", "-NC": "-NonCommercial", "-SA": "-ShareAlike", "-ND": "-NoDerivatives", "-NC-SA": "-NonCommercial-ShareAlike", "-NC-ND": "-NonCommercial-NoDerivatives"}.items():
    TEMPLATES[f"CC-BY{_short}-4.0"] = f"This work is licensed under a Creative Commons Attribution{_long} 4.0 International License."
    TEMPLATES[f"CC-BY{_short}-4.0 short"] = f"Licensed under CC BY{_short} 4.0."
_AS_IS = """This software is provided by the copyright holders and contributors "as is" and any express or implied warranties, including, but not
limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. In no event shall the copyright holder or
contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement
of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in
contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the
possibility of such damage."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in
binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
materials provided with the distribution."""
#: Whole licences that need not name themselves.
BODIES = {
    "BSD-2-Clause": f"{_BSD} {_AS_IS}",
    "BSD-3-Clause": f"""{_BSD} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission. {_AS_IS}""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the
above copyright notice and this permission notice appear in all copies. The software is provided "as is" and the author disclaims all warranties with
regard to this software including all implied warranties of merchantability and fitness. In no event shall the author be liable for any special,
direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract,
negligence or other tortious action, arising out of or in connection with the use or performance of this software.""",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute,
sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. The software is
provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a
particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other liability,
whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the
software.""",
}
#: Fixed value: words any text may hold; a whole file isn't compared by them.
_COMMON = "a all an and any are be by for from have in is it its may no not of on or that the their this to under was will with you".split()
_TERM = r"[A-Za-z0-9]+(?:\.[0-9]+)*"
_TERMS = re.compile(_TERM).findall
_FILE_NAMES = re.compile(r"(?i)^(licen[cs]e|copying|notice|unlicense)([._-].*)?$", re.ASCII)
#: A line with none of these words needs three terms of a template, since one rare word alone (German "mit") may come to the threshold.
_WORDS = re.compile(r"(?i)licen[cs]e|permission|public domain|redistribution", re.ASCII)
_TAG = re.compile(r"(?i)SPDX-License-Identifier:\s*([A-Za-z0-9.+()-]+(?:\s+(?:AND|OR|WITH)\s+[A-Za-z0-9.+()-]+)*)", re.ASCII)


def terms(text: str) -> Counter:
    return Counter(re.findall(_TERM, text.lower()))


def weights(templates: dict[str, str]) -> tuple[dict[str, dict[str, float]], dict[str, float], float]:
    """Unit TF-IDF vectors of the templates, the idf of their terms, and that of a term in none of them."""
    counts = {name: terms(text) for name, text in templates.items()}
    n, df = len(counts), Counter(t for c in counts.values() for t in c)
    idf = {t: math.log((1 + n) / (1 + d)) + 1 for t, d in df.items()}
    vectors = {}
    for name, c in counts.items():
        norm = math.sqrt(sum((k * idf[t]) ** 2 for t, k in c.items()))
        vectors[name] = {t: k * idf[t] / norm for t, k in c.items()}
    return vectors, idf, math.log(1 + n) + 1


def rarer(vectors: dict[str, dict[str, float]], threshold: float) -> list[str]:
    """Terms of which every line at the threshold holds one.

    By the terms it shares with a template alone, a line's cosine is at most
    the root of their squared weights, so common words may be left out as long
    as those of no template come to the threshold.
    """
    left_out: set[str] = set()
    for t in _COMMON:
        if all(sum(v.get(x, 0.0) ** 2 for x in (*left_out, t)) < threshold**2 * 0.999 for v in vectors.values()):
            left_out.add(t)
    return sorted({t for v in vectors.values() for t in v} - left_out)


class Scorer:
    """Sparse TF-IDF cosines of texts to a set of templates, neither with the words of ``without``.

    A text meets only templates with which it shares a term, by way of an
    index from terms to templates, and only if it holds one of the rarer terms.
    """

    def __init__(self, templates: dict[str, str], threshold: float, without: Iterable[str] = ()) -> None:
        self.without = set(without)
        kept = {name: " ".join(t for t in re.findall(_TERM, text.lower()) if t not in self.without) for name, text in templates.items()}
        vectors, self.idf, self.unknown = weights(kept)
        self.rarer = set(rarer(vectors, threshold))
        self.index: dict[str, list[tuple[str, float]]] = {}
        for name, vector in vectors.items():
            for term, weight in vector.items():
                self.index.setdefault(term, []).append((name, weight))

    def cosines(self, text: str) -> dict[str, float]:
        found = _TERMS(text.lower())
        met = self.index.keys() & found
        if self.rarer.isdisjoint(met):
            return {}
        named = _WORDS.search(text) is not None
        # Without one of the words three terms of one template are needed.
        if len(met) < 3 and not named:
            return {}
        counts = Counter(t for t in found if t not in self.without)
        norm = math.sqrt(sum((k * self.idf.get(t, self.unknown)) ** 2 for t, k in counts.items()))
        dots, shared = Counter(), Counter()
        for term in sorted(met):
            for name, weight in self.index[term]:
                dots[name] += counts[term] * self.idf[term] * weight
                shared[name] += 1
        return {name: dot / norm for name, dot in dots.items() if named or shared[name] >= 3}


@lru_cache(maxsize=8)
def _scorer(templates: tuple[tuple[str, str], ...], threshold: float, without: tuple[str, ...] = ()) -> Scorer:
    """One for all tasks of a worker process."""
    return Scorer(dict(templates), threshold, without)


def own_licence(name: str, text: str, templates: dict[str, str], threshold: float) -> tuple[str, float] | None:
    """The licence a file states itself: by an SPDX tag, one of its lines or, for a licence file, two of them or the whole.

    The best cosine at or above the threshold counts, ties to the first name.
    """
    lines, known = text.split("\n"), _scorer(tuple(templates.items()), threshold)
    found = [(1.0, tag) for tag in _TAG.findall(text)] if "-" in text else []
    scored = [known.cosines(line) for line in lines]
    if _FILE_NAMES.search(name):
        full = [line for line in lines if line.strip(" ")]
        scored += [known.cosines(f"{one} {two}" if two else one) for one, two in zip(full, [*full[1:], ""])]
        scored.append(_scorer(tuple(BODIES.items()), threshold, tuple(_COMMON)).cosines(text))
    # What follows a space tells notices of one licence apart.
    found += [(cosine, template.partition(" ")[0]) for cosines in scored for template, cosine in cosines.items() if cosine >= threshold]
    cosine, licence = min(found, key=lambda f: (-round(f[0], 9), f[1]), default=(None, None))
    return licence and (licence, cosine)


def line_scores(files: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(file, line, licence, cosine) for every line that may come to the threshold."""
    ship(files.sparkSession)
    fixed = tuple(templates.items())

    def score(batches):
        known = _scorer(fixed, threshold)
        for batch in batches:
            for file, text in zip(*(c.to_pylist() for c in batch.columns)):
                rows = [(file, n, name, c) for n, line in enumerate((text or "").split("\n")) for name, c in known.cosines(line).items()]
                yield pa.RecordBatch.from_pylist([dict(zip(("_file", "line", "licence", "cosine"), r)) for r in rows], _SCORED)

    return files.select(F.col("_file").cast("string"), F.col("text").cast("string")).mapInArrow(score, "_file string, line int, licence string, cosine double")


_SCORED = pa.schema([("_file", pa.string()), ("line", pa.int32()), ("licence", pa.string()), ("cosine", pa.float64())])


def stated(files: DataFrame, templates: dict[str, str], threshold: float) -> DataFrame:
    """(path, own, cosine) of every row of (path, text): a row is scored where it lies, nothing is moved."""
    ship(files.sparkSession)

    def judge(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                paths, texts = (c.to_pylist() for c in batch.slice(lo, 512).columns)
                own = [own_licence((p or "").rsplit("/", 1)[-1], t or "", templates, threshold) or (None, None) for p, t in zip(paths, texts)]
                columns = [pa.array(paths, pa.string()), pa.array([o[0] for o in own], pa.string()), pa.array([o[1] for o in own], pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, ["path", "own", "cosine"])

    return files.mapInArrow(judge, "path string, own string, cosine double")


def folders(path: Column) -> Column:
    """All folders above a path, the nearest first; the last is the root ''."""
    parts = F.split(path, "/")
    depth = F.size(parts)
    return F.transform(F.sequence(F.lit(1), depth), lambda up: F.array_join(F.slice(parts, 1, depth - up), "/"))


def scan(files: DataFrame, path_col: str, text_col: str = "text", threshold: float = THRESHOLD, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """Licence of every file: its own, or that of the nearest folder above with a licence file.

    Adds to the path: ``own`` (best template of its lines at or above the
    threshold, ties to the first name), ``cosine``, ``licence``, ``origin``
    (own, inherited, none) and ``from_folder``. Of several licence files in a
    folder the one with the best cosine counts, ties to the first name. Paths
    that are null inherit nothing; repeated paths are files of their own; null
    texts state nothing; an empty table gives no rows; other columns are kept
    out, so clashing names do no harm.

    Folders are joined by name: a file brings as many rows as it has folders
    above it, licence folders are one row each.
    """
    rows = files.select(F.col(path_col).cast("string").alias("path"), F.col(text_col).cast("string").alias("text"))
    # Licence folders, files that seek one and the result are read from this narrow table, the texts once.
    known = settle(stated(rows, templates, threshold))
    name = F.substring_index("path", "/", -1)
    licensed = (
        known.filter(F.col("own").isNotNull() & name.rlike(_FILE_NAMES.pattern))
        .groupBy(folders(F.col("path"))[0].alias("folder"))
        .agg(F.min_by("own", F.struct(-F.round("cosine", 9), "own")).alias("folder_licence"))
    )
    # Files without a path or with a licence of their own need no look-up.
    seeking = known.filter("own is null and path is not null").select("path").distinct()
    asked = seeking.select("path", F.posexplode(folders(F.col("path"))).alias("up", "folder"))
    nearest = asked.join(licensed, "folder").groupBy("path").agg(F.min_by(F.struct("folder", "folder_licence"), "up").alias("_near"))
    out = known.join(nearest.withColumnRenamed("path", "_p"), F.col("path") == F.col("_p"), "left")
    inherits = F.col("own").isNull() & F.col("_near").isNotNull()
    return out.select(
        "path",
        "own",
        "cosine",
        F.coalesce("own", F.col("_near.folder_licence")).alias("licence"),
        F.when(F.col("own").isNotNull(), "own").when(inherits, "inherited").otherwise("none").alias("origin"),
        F.when(inherits, F.col("_near.folder")).alias("from_folder"),
    )
