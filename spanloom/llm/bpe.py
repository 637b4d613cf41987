"""Byte-level BPE over a table of distinct words.

A *word* here is a run of white space with the run of other characters behind
it. No token crosses the border between a character and white space after it,
so a text's ids are the ids of its words in order, and every distinct word
needs to be encoded only once.

1. Texts are split block by block (a block is a bounded number of characters
   of one input partition). A block yields its distinct words, dealt into
   buckets by a hash, and each document as numbers into the block's word list.
2. A bucket gathers one share of all blocks' words, encodes each distinct word
   once and sends ids back to each block in the order its words came.
3. A block joins ids to its documents by position and decodes them through
   the id-to-piece table of the vocabulary.

Texts themselves are never shuffled; what moves are distinct words, their ids
and about two bytes for each word of text.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import ship, spans

SPECIAL = "<|endoftext|>"
#: The characters with Unicode's White_Space property.
WHITE = "\t-\r \x85\xa0  -     　"
KNOWN_WORDS = 1 << 20
_UNIT = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
_TANGLED = re.compile(f"[{WHITE}] ")


def units(text: str) -> list[str]:
    """Words of a text as keys: a key that starts with a space stands for the rest of it, any other for a space and itself.

    Words with one space before them are by far the most, so a plain split
    does it unless white space stands before a space.
    """
    if SPECIAL in text:
        out = []
        for i, part in enumerate(text.split(SPECIAL)):
            out += [f" {SPECIAL}"] * (i > 0) + units(part)
        return out
    if not text:
        return []
    if _TANGLED.search(text) or text[-1] == " ":
        return [" " + u for u in _UNIT.findall(text)]
    first, *rest = text.split(" ")
    return [" " + first, *rest] if first else rest


def spelled(key: str) -> str:
    return key[1:] if key[0] == " " else " " + key


@lru_cache(maxsize=2)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def pieces(path: str) -> list[bytes]:
    """The bytes of every id. Byte-level vocabularies spell the 188 printable bytes as themselves and the others as U+0100 onwards."""
    with open(path) as file:
        model = json.load(file)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in printable}
    byte_of |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
    spelling = {i: bytes(byte_of[c] for c in s) for s, i in model["model"]["vocab"].items()}
    spelling |= {t["id"]: t["content"].encode() for t in model["added_tokens"]}
    return [spelling.get(i, b"") for i in range(max(spelling) + 1)]


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers as four compressed byte planes, the low one first: the upper ones are nearly constant."""
    return _small(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unplaned(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(_full(data), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _small(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def _full(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


class _Numbers(dict):
    def __missing__(self, key: str) -> int:
        self[key] = number = len(self)
        return number


def _split_blocks(batches, buckets: int, block_chars: int, wanted: str):
    """Rows of the wanted kind for each block of documents."""
    for batch in batches:
        ends = np.cumsum(pc.utf8_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            past = ends[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(ends, past + block_chars, "right")))
            part = batch.slice(at, end - at)
            place = struct.pack("<q", part.column(2)[0].as_py())
            yield from _block_rows(place, part.column(0).to_pylist(), part.column(1).to_pylist(), buckets, wanted)
            at = end


def _block_rows(place: bytes, ids: list, texts: list, buckets: int, wanted: str):
    numbers, mark, coded = _Numbers(), hashlib.blake2b(place, digest_size=16), []
    for doc_id, text in zip(ids, texts):
        data = (text or "").encode()
        # The block's name comes from its place and from what it holds: equal blocks have names of their own,
        # and both readings of the input give a block the same one.
        mark.update(struct.pack("<qq", -1 if doc_id is None else doc_id, len(data)))
        mark.update(data)
        words = units(text or "")
        coded.append(np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words)))
    block = mark.digest()
    keys = list(numbers)
    raw = [k.encode() for k in keys]
    bucket_of = np.fromiter((zlib.crc32(r) % buckets for r in raw), np.uint32, len(raw))
    if wanted == "words":
        order = np.argsort(bucket_of, kind="stable")
        for lo, hi in spans(bucket_of[order]):
            chosen = [raw[i] for i in order[lo:hi]]
            sizes = np.fromiter(map(len, chosen), np.uint32, len(chosen))
            yield block, int(bucket_of[order[lo]]), _planes(sizes), _small(b"".join(chosen))
    else:
        yield block, 1, None, _planes(bucket_of), b""
        for doc_id, code in zip(ids, coded):
            yield block, 2, doc_id, _planes(code), b""


def _batched(rows, names: list[str], kinds: list[pa.DataType], most_bytes: int = 4 << 20):
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row if isinstance(v, bytes))
        if size > most_bytes or len(held) >= 5000:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)


def encode(docs: DataFrame, path: str, block_chars: int = 8 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of every text, as an array of 32-bit numbers in little-endian bytes, and the decoded bytes.

    Ids are those of the tokenizer file at ``path`` without added special
    tokens; the text of a special token in a document gives that token. Null
    texts are empty and give no ids. Ids of documents are passed through, also
    null and repeated ones; an empty table gives no rows; other columns are
    ignored. The input is read twice, so it must give the same rows in the
    same partitions both times: a table, or a DataFrame settled before.

    Words are dealt to ``spark.sql.shuffle.partitions`` buckets. A task holds
    one block, or at most ``KNOWN_WORDS`` words of one bucket and those of one
    block, however large the vocabulary of the corpus is.
    """
    ship(docs.sparkSession)
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The number of a row is that of its place in the input, also where both readings run as one job.
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("_row"))

    def words(batches):
        rows = _split_blocks(batches, buckets, block_chars, "words")
        yield from _batched(rows, ["block", "bucket", "sizes", "data"], [pa.binary(), pa.int32(), pa.binary(), pa.binary()])

    def numbered(batches):
        rows = _split_blocks(batches, buckets, block_chars, "documents")
        yield from _batched(
            rows, ["block", "kind", "doc_id", "sizes", "data"], [pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
        )

    def encode_bucket(batches):
        known, now = {}, None

        def rows():
            nonlocal known, now
            for batch in batches:
                for block, bucket, sizes, data in zip(*(c.to_pylist() for c in batch.columns)):
                    # A bucket with more distinct words than that forgets them now and then, which costs time only.
                    if bucket != now or len(known) > KNOWN_WORDS:
                        known, now = {}, bucket
                    ends, data = np.cumsum(_unplaned(sizes)).tolist(), _full(data)
                    listed = [data[a:b] for a, b in zip([0, *ends], ends)]
                    fresh = [w for w in listed if w not in known]
                    if fresh:
                        coded = tokenizer(path).encode_batch_fast([spelled(w.decode()) for w in fresh], add_special_tokens=False)
                        known.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(fresh, coded))
                    found = [known[w] for w in listed]
                    lengths = np.fromiter(map(len, found), np.uint32, len(found)) // 4
                    yield block, 0, bucket, _planes(lengths), _planes(np.frombuffer(b"".join(found), "<u4"))

        yield from _batched(
            rows(), ["block", "kind", "doc_id", "sizes", "data"], [pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
        )

    table = source.mapInArrow(words, "block binary, bucket int, sizes binary, data binary")
    table = table.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(
        encode_bucket, "block binary, kind int, doc_id long, sizes binary, data binary"
    )
    both = table.union(source.mapInArrow(numbered, "block binary, kind int, doc_id long, sizes binary, data binary"))
    # Per block: the ids of its words by bucket, then the bucket of each word, then the documents.
    placed = both.repartition(buckets, "block").sortWithinPartitions("block", "kind", F.when(F.col("kind") == 0, F.col("doc_id")))

    def join_back(batches):
        at, lengths, ids, starts, counts = None, [], [], None, None

        def rows():
            nonlocal at, lengths, ids, starts, counts
            for batch in batches:
                for block, kind, doc_id, sizes, data in zip(*(c.to_pylist() for c in batch.columns)):
                    if block != at:
                        at, lengths, ids = block, [], []
                    if kind == 0:
                        lengths.append(_unplaned(sizes))
                        ids.append(_unplaned(data))
                    elif kind == 1:
                        bucket_of = _unplaned(sizes)
                        order = np.argsort(bucket_of, kind="stable")
                        size = np.concatenate(lengths).astype(np.int64) if lengths else np.zeros(0, np.int64)
                        if len(size) != len(bucket_of):
                            raise ValueError("the input changed between its two readings; settle it before encoding")
                        counts, starts = np.empty_like(size), np.empty_like(size)
                        counts[order], starts[order] = size, np.cumsum(size) - size
                        ids = [np.concatenate(ids) if ids else np.zeros(0, np.uint32)]
                    else:
                        code = _unplaned(sizes)
                        many = counts[code]
                        begin = np.cumsum(many) - many
                        where = np.repeat(starts[code] - begin, many) + np.arange(int(many.sum()))
                        yield doc_id, ids[0][where].astype("<u4").tobytes()

        yield from _batched(rows(), ["doc_id", "ids"], [pa.int64(), pa.binary()])

    return placed.mapInArrow(join_back, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds ``decoded``: the text of each row's ``ids``, special tokens included.

    The id-to-piece table is the vocabulary, whose size is fixed by the file;
    each task holds it and joins by id.
    """

    def join_pieces(batches):
        table = pieces(path)
        for batch in batches:
            for row in range(0, batch.num_rows, 256):
                part = batch.slice(row, 256)
                ids = part.column(1).to_pylist()
                texts = [
                    b"".join(map(table.__getitem__, np.frombuffer(i, "<u4").tolist())).decode("utf-8", "replace") for i in ids
                ]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    ship(encoded.sparkSession)
    return encoded.select("doc_id", "ids").mapInArrow(join_pieces, "doc_id long, ids binary, decoded string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Per document: number of ids, digests of the ids and of the decoded text. Rules as in ``encode``."""
    return decode(encode(docs, path), path).select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
