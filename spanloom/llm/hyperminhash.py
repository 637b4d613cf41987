"""Near-duplicates by HyperMinHash.

A document's set of shingle hashes is summarised in 256 registers: the upper
byte of a hash names its register, and of the smallest hash there the register
keeps the number of leading zeros and ten mantissa bits. Bands of registers,
as wide as the asked similarity allows, give candidate groups. Inside these, collision-corrected Jaccard
estimates join documents that may be similar into loose groups, and within a
loose group links are confirmed on the full sets.

Documents with equal sets are one class from the start. Groups of any size are
cut into blocks; a task compares two blocks and returns no more links than it
has documents, so neither a group nor its pairs are ever in one place.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import components, ship, spans
from spanloom.session import settle

WORDS = 5
REGISTERS = 256
MANTISSA = 10
#: A link, unless a caller asks for another share: 100 * intersection >= 85 * union.
SHARE = 85
#: Most pairs at the limit that may share no band.
MISSED = 1e-5
SMALL = 64
BLOCK_DOCUMENTS = 1024
BLOCK_SHINGLES = 1 << 20
#: Classes in loose groups, 40 bytes each, that are broadcast to the texts.
BROADCAST_ROWS = 1 << 21

_rng = np.random.default_rng(11)
_WORD_FACTORS = _rng.integers(1, 1 << 63, WORDS, np.uint64) * np.uint64(2) + np.uint64(1)
_BAND_FACTORS = _rng.integers(1, 1 << 63, REGISTERS, np.uint64) * np.uint64(2) + np.uint64(1)
_PROBES = np.array([_rng.permutation(REGISTERS) for _ in range(REGISTERS)])
#: Chance that two different minima fill a register alike: both have as many leading zeros (1/3) and the same mantissa.
_COLLISION = 1 / 3 / (1 << MANTISSA)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the runs of five words, A-Z lower-cased; with fewer words the whole sequence is one."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(hashed) - WORDS + 1
    total = np.zeros(n, np.uint64)
    for i in range(WORDS):
        total += hashed[i : i + n] * _WORD_FACTORS[i]
    return np.unique(_mix(total))


def signature(hashes: np.ndarray) -> np.ndarray:
    """Registers of a non-empty set; an empty register repeats the first filled one on its own way through the registers."""
    places, first = np.unique(hashes >> np.uint64(56), return_index=True)
    rest = (hashes[first] & np.uint64((1 << 56) - 1)) >> np.uint64(4)
    length = np.frexp(rest.astype(np.float64))[1]
    down = length - 1 - MANTISSA
    bits = np.where(down >= 0, rest >> np.maximum(down, 0).astype(np.uint64), rest << np.maximum(-down, 0).astype(np.uint64))
    value = (52 - length).astype(np.uint16) << np.uint16(MANTISSA) | (bits & np.uint64((1 << MANTISSA) - 1)).astype(np.uint16)
    out, filled = np.zeros(REGISTERS, np.uint16), np.zeros(REGISTERS, bool)
    out[places.astype(np.int64)], filled[places.astype(np.int64)] = value, True
    empty = np.flatnonzero(~filled)
    if len(empty):
        out[empty] = out[_PROBES[empty, filled[_PROBES[empty]].argmax(1)]]
    return out


def band_width(share: int) -> int:
    """Registers of a band: the most with which a pair at the limit shares one of the bands all but surely."""
    return max((w for w in range(1, 17) if (1 - (share / 100) ** w) ** (REGISTERS // w) <= MISSED), default=1)


def cuts(share: int) -> tuple[float, float]:
    """Estimates from here on are verified: at 256 registers more than six standard deviations below the limit, and for small sets twice that."""
    spread = 0.42 * math.sqrt(share * (100 - share)) / 100
    return share / 100 - spread, share / 100 - 2 * spread


def bands(signatures: np.ndarray, share: int = SHARE) -> np.ndarray:
    """One key per band for each row of registers."""
    width = band_width(share)
    n = REGISTERS // width
    parts = signatures[:, : n * width].reshape(-1, n, width).astype(np.uint64)
    return _mix((parts * _BAND_FACTORS[: n * width].reshape(n, width)).sum(2) + np.arange(n, dtype=np.uint64))


def estimates(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Jaccard similarity of one signature to many, without the share of registers that agree by collision."""
    agree = (many == one).mean(1)
    return np.maximum(0.0, (agree - _COLLISION) / (1 - _COLLISION))


class _Groups:
    """Union-find over the rows of one task, which are sorted: a group's root is its first row."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)

    def links(self, ids: np.ndarray) -> list[tuple[int, int]]:
        return [(int(ids[r]), int(ids[i])) for i in range(len(self.up)) if (r := self.find(i)) != i]


def candidate_rows(i: int, signatures: np.ndarray, sizes: np.ndarray, side: np.ndarray, crossed: bool, share: int = SHARE) -> np.ndarray:
    """Earlier rows that may be similar to row i, likeliest first; between two blocks only rows of the other one."""
    near = estimates(signatures[i], signatures[:i])
    large, small = cuts(share)
    cut = np.where(np.minimum(sizes[:i], sizes[i]) < SMALL, small, large)
    ok = (near >= cut) & (100 * np.minimum(sizes[:i], sizes[i]) >= share * np.maximum(sizes[:i], sizes[i]))
    if crossed:
        ok &= side[:i] != side[i]
    rows = np.flatnonzero(ok)
    return rows[np.argsort(-near[rows], kind="stable")]


def similar(a: np.ndarray, b: np.ndarray, share: int = SHARE) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= share * (len(a) + len(b) - both)


def summaries(docs: DataFrame) -> DataFrame:
    """Per row: id, size of its shingle set, class (a 64-bit digest of the set, null if empty) and registers."""
    ship(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def measure(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                sets = [shingles(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([class_of(s) for s in sets], pa.int64()),
                        pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "cid", "registers"],
                )

    return source.mapInArrow(measure, "doc_id long, n_shingles long, cid long, registers binary")


def class_of(hashes: np.ndarray) -> int | None:
    if not len(hashes):
        return None
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True)


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[list]]:
    """Columns of the rows of each run of equal keys, also where it goes on in the next batch."""
    held: list[list] | None = None
    for batch in batches:
        columns = batch.columns
        at = [c.to_numpy(zero_copy_only=False) for c in columns[:keys]]
        for lo, hi in spans(*at):
            part = [c.slice(lo, hi - lo).to_pylist() for c in columns]
            if held is not None and all(h[0] == p[0] for h, p in zip(held[:keys], part[:keys])):
                for h, p in zip(held, part):
                    h += p
            else:
                if held is not None:
                    yield held
                held = part
    if held is not None:
        yield held


def _block_pairs(rows: DataFrame, group: str, block: Column, blocks: Column) -> DataFrame:
    """Each row once for every pair of blocks its own block is part of, those of a pair by class."""
    spread = rows.withColumns({"_b": block, "_nb": blocks})
    spread = spread.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
    spread = spread.withColumns({"_i": F.least("_b", "_o"), "_j": F.greatest("_b", "_o")})
    return spread.repartition(group, "_i", "_j").sortWithinPartitions(group, "_i", "_j", "cid")


def _stars(links: DataFrame) -> DataFrame:
    """Links (a, b) with a < b that connect the same nodes, about one for each node.

    A node of many groups is linked with the smallest head it has, and its
    other heads with that one; these are few and alike for many nodes, so
    what is left is near a tree. A node has at most one head for each of its
    bands and blocks.
    """
    heads = links.groupBy("b").agg(F.array_sort(F.collect_set("a")).alias("heads"))
    low = F.get("heads", F.lit(0)).alias("a")
    others = F.explode(F.concat(F.array("b"), F.slice("heads", F.lit(2), F.size("heads")))).alias("b")
    return heads.select(low, others).distinct()


def loose_links(classes: DataFrame, share: int = SHARE) -> DataFrame:
    """Links between classes of one band bucket whose estimate allows a similarity at the limit."""

    def keys_of(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, REGISTERS)
            keys = bands(rows, share).astype(np.int64)
            cids = np.repeat(batch.column(0).to_numpy(), keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(cids)], ["key", "cid"])

    members = classes.select("cid", "registers").mapInArrow(keys_of, "key long, cid long").repartition("key")
    mark = F.xxhash64("cid")
    buckets = members.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(mark).alias("x"), F.min("cid").alias("low"), F.max("cid").alias("high")
    )
    # Copies meet in many bands; buckets with the same members are compared once.
    kept = buckets.filter("n > 1").groupBy("n", "x", "low", "high").agg(F.min("key").alias("key")).select("key", "n")
    rows = members.join(kept, "key").join(classes.select("cid", "n_shingles", "registers"), "cid")
    blocks = F.ceil(F.col("n") / BLOCK_DOCUMENTS).cast("int")
    placed = _block_pairs(
        rows.select("key", "cid", "n_shingles", "registers", "n"), "key", F.pmod(mark, F.ceil(F.col("n") / BLOCK_DOCUMENTS)).cast("int"), blocks
    ).select("key", "_i", "_j", "_b", "cid", "n_shingles", "registers")

    def compare(batches):
        out: list[tuple[int, int]] = []
        for _, i, j, side, cids, sizes, registers in _grouped(batches, 3):
            if len(cids) < 2:
                continue
            ids, n, b = np.array(cids), np.array(sizes), np.array(side)
            rows = np.frombuffer(b"".join(registers), np.uint16).reshape(-1, REGISTERS)
            groups = _Groups(len(ids))
            for r in range(1, len(ids)):
                for x in candidate_rows(r, rows, n, b, i[0] != j[0], share).tolist():
                    groups.join(x, r)
            out += groups.links(ids)
            if len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], ["a", "b"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    return _stars(placed.mapInArrow(compare, "a long, b long"))


def confirmed_links(docs: DataFrame, classes: DataFrame, loose: DataFrame, share: int = SHARE) -> DataFrame:
    """Links confirmed on full sets, enough of them to connect whatever is connected inside each loose group."""
    heavy = F.greatest("n_shingles", F.lit(BLOCK_SHINGLES // BLOCK_DOCUMENTS))
    wanted = settle(classes.select("cid", "rep", "n_shingles").join(loose.withColumnRenamed("node", "cid"), "cid"))
    # A class falls into a block by its digest, so a large group needs its total only and no order.
    sizes = wanted.groupBy("root").agg(F.ceil(F.sum(heavy) / BLOCK_SHINGLES).cast("int").alias("blocks"))
    wanted = settle(wanted.join(sizes, "root").withColumn("block", F.pmod(F.xxhash64("cid"), "blocks").cast("int")))
    # Up to a size that suits a broadcast the texts stay where they are; beyond it they are shuffled to meet the classes.
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text")).join(wanted, "rep")

    def gather(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                cids = part.column(1).to_pylist()
                sets = [shingles(t) for t in part.column(0).to_pylist()]
                # A repeated id may bring a text of another class.
                keep = [k for k, s in enumerate(sets) if class_of(s) == cids[k]]
                part = part.take(pa.array(keep, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(1), part.column(2), part.column(3), part.column(4), pa.array([sets[k].tobytes() for k in keep], pa.binary())],
                    ["cid", "root", "block", "blocks", "hashes"],
                )

    sets = texts.select("text", "cid", "root", "block", "blocks").mapInArrow(gather, "cid long, root long, block int, blocks int, hashes binary")
    placed = _block_pairs(sets, "root", F.col("block"), F.col("blocks")).select("root", "_i", "_j", "_b", "cid", "hashes")

    def verify(batches):
        for _, i, j, side, cids, data in _grouped(batches, 3):
            # Rows come by class; of repeated ones the first is kept.
            kept = [k for k, c in enumerate(cids) if k == 0 or c != cids[k - 1]]
            if len(kept) < 2:
                continue
            ids, b = np.array([cids[k] for k in kept]), np.array([side[k] for k in kept])
            found = [np.frombuffer(data[k], np.uint64) for k in kept]
            rows, n = np.array([signature(s) for s in found]), np.array([len(s) for s in found])
            groups = _Groups(len(ids))
            for r in range(1, len(ids)):
                for x in candidate_rows(r, rows, n, b, i[0] != j[0], share).tolist():
                    if groups.find(r) != groups.find(x) and similar(found[r], found[x], share):
                        groups.join(x, r)
            links = groups.links(ids)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in links], pa.int64()) for k in (0, 1)], ["a", "b"])

    return _stars(placed.mapInArrow(verify, "a long, b long"))


def near_duplicates(docs: DataFrame, share: int = SHARE) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest id reachable over links, itself included) and kept.

    Documents are linked from a Jaccard similarity of ``share`` hundredths on.
    Sets hold the distinct runs of five words of the whole text. Null and
    empty texts, and texts of white space, have empty sets and are linked with
    nothing. Rows of a repeated id are separate documents that share the id. A
    null id has no component and is kept. An empty table gives no rows; other
    columns are ignored.

    A pair at the limit shares no band with a probability of about one in a
    million at 85 (36 bands of 7) and three at 80 (42 bands of 6), computed,
    and fewer the more alike it is.
    """
    rows = settle(summaries(docs))
    filled = rows.filter("cid is not null and doc_id is not null")
    classes = settle(
        filled.groupBy("cid").agg(
            F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers"), F.count(F.lit(1)).alias("documents")
        )
    )
    loose = components(loose_links(classes, share))
    joined = components(confirmed_links(docs, classes, loose, share)).withColumnRenamed("node", "cid")
    named = joined.join(classes.select("cid", "rep"), "cid")
    smallest = named.groupBy("root").agg(F.min("rep").alias("component"))
    component = named.join(smallest, "root").select("cid", "component")
    # A class of one document that is linked with nothing needs no look-up.
    of_class = classes.select("cid", "rep", "documents").join(component, "cid", "left").filter("documents > 1 or component is not null")
    of_class = settle(of_class.select("cid", F.coalesce("component", "rep").alias("component")))
    out = rows.select("doc_id", "n_shingles", "cid").join(of_class, "cid", "left")
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, share: int = SHARE) -> DataFrame:
    """The documents kept, one of each group, with all their columns."""
    kept = near_duplicates(docs, share).filter("kept").select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(F.col("_kept")), "left_semi")


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE [array_to_string(w[i:i+4], ' ') FOR i IN range(1, len(w) - 3)] END) AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r(a, b) AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT a, min(b) AS low FROM r GROUP BY a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(c.low, s.doc_id)) AS component_id,
  s.doc_id = least(s.doc_id, coalesce(c.low, s.doc_id)) AS kept
FROM s LEFT JOIN c ON c.a = s.doc_id"""
