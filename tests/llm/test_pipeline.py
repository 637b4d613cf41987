"""The pipeline on a small table: every stage's decisions hold and all tokens of the rest are packed."""

import os
import zlib

import numpy as np
import pytest

import corpus_pipeline
from spanloom.llm import hyperminhash, packing, quality, secrets


def test_pipeline(spark):
    pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    sf_dir = "/root/testdata/sf0.001"
    if not os.path.isdir(sf_dir):
        pytest.skip("no test data")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = quality.classify(docs, labels).filter("predicted = 1").select("doc_id")
    kept = docs.join(good, "doc_id")
    single = hyperminhash.near_duplicates(kept, share=80).filter("kept").select("doc_id")
    rest = {r.doc_id: r.text for r in kept.join(single, "doc_id").collect()}
    for r in secrets.scan(kept).filter("is_secret").collect():
        if r.doc_id in rest:
            rest[r.doc_id] = rest[r.doc_id].replace(r.token, secrets.MASK)
    assert 0 < len(rest) < docs.count()
    tokenizer = Tokenizer.from_file(corpus_pipeline.vocabulary())
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in got} == set(rest)
    for i, text in rest.items():
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 0], "<u4")
        for r in (r for r in got if r.doc_id == i):
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        assert sum(r.length for r in got if r.doc_id == i) == len(ids)
    assert max(r.sequence_id for r in got) == (sum(r.length for r in got) - 1) // packing.LENGTH
