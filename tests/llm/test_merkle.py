"""The Merkle manifest against a plain tree, proofs included."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from spanloom.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, root string, pos string"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def shown(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(nodes):
    """Root of a run of nodes and, per node, its siblings (before, after) on every level."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for path, (n, k) in zip(paths, enumerate(at)):
            run = level[k // 3 * 3 : k // 3 * 3 + 3]
            path.append((run[: k % 3], run[k % 3 + 1 :]))
            at[n] = k // 3
        level = [digest(*level[k : k + 3]) for k in range(0, len(level), 3)]
    return level[0], paths


def plain(rows):
    groups = {}
    for doc_id, source, lang, n_chars, text in rows:
        leaf = digest(*map(shown, (doc_id, source, lang, n_chars, text)))
        hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0
        cut = text.replace("\n", "") if hit and text is not None else text
        groups.setdefault(source, []).append(((doc_id is not None, doc_id or 0, leaf), doc_id, leaf, digest(*map(shown, (doc_id, source, lang, n_chars, cut)))))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    inner = {s: tree([leaf for _, _, leaf, _ in sorted(groups[s])]) for s in names}
    root, above = tree([inner[s][0] for s in names]) if names else (None, [])
    out = []
    for name, further in zip(names, above):
        for (_, doc_id, leaf, changed), path in zip(sorted(groups[name]), inner[name][1]):
            folded = changed
            for before, after in path + further:
                folded = digest(*before, folded, *after)
            proof = digest(*(d for before, after in path + further for d in before + after))
            out.append((doc_id, leaf, inner[name][0], root, proof, folded, folded == root))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(5)


def run(spark, rows):
    return sorted(map(tuple, merkle.check_documents(frame(spark, rows)).collect()), key=str)


def test_odd_rows_hot_group_and_repeats(spark):
    rows = [(i, "hot", "en", i, f"line {i}\nnext\n") for i in range(90)]
    rows += [(1000 + i, f"s{i}", None, None, None if i % 2 else "\n\n") for i in range(7)]
    rows += [(5, "hot", "en", 5, "line 5\nnext\n")] * 4 + [(6, "hot", "de", 6, "other text of one id")]
    rows += [(None, "hot", "en", 1, "a\n"), (None, None, None, None, None), (2000, None, "en", 3, ""), (2001, "", "en", 3, "é" * 70000), (2002, "é", "en", 0, "-")]
    assert run(spark, rows) == plain(rows)


@pytest.mark.parametrize("rows", [[], [(3, "a", "en", 1, "one\nrow")]], ids=["empty", "single"])
def test_small_tables(spark, rows):
    assert run(spark, rows) == plain(rows)


def test_general_manifest_folds_to_the_root(spark):
    rows = spark.range(40).select(
        F.when(F.col("id") % 3 > 0, F.concat(F.lit("g"), F.col("id") % 7)).alias("group"),
        "id",
        merkle.leaf_digest(F.col("id")).alias("digest"),
        F.struct("id").alias("load"),
    )
    got = merkle.manifest(rows).select("load.id", "root", merkle.fold(F.col("digest"), F.col("steps")).alias("folded")).collect()
    assert {r.id for r in got} == set(range(40)) and {r.folded for r in got} == {bytes(got[0].root).hex()}
