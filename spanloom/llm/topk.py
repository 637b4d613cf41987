"""Exact top-k by inner product on a bit-sliced index.

A block of rows keeps, for every attribute, one bitmap per bit of its
quantised value. A query's weighted sum over the attributes is computed for
all rows of the block at once by adding these bitmaps with carry-save adders.
The sum's own slices are then walked from the most significant one down, which
gives the k-th largest sum; rows that could still reach it within the error of
the quantisation are the boundary, and only these are scored exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import ship, spans

#: Components are exact up to this size after scaling, scores up to 64 bits; what is larger counts as these.
LIMIT = 1 << 61
WIDEST = (1 << 63) - 1


def digits(weight: int) -> list[tuple[int, int]]:
    """Non-adjacent signed binary digits: (position, sign)."""
    out, at = [], 0
    while weight:
        if weight & 1:
            sign = 2 - (weight & 3)
            out.append((at, sign))
            weight -= sign
        weight >>= 1
        at += 1
    return out


def add_slices(columns: dict[int, np.ndarray], words: int) -> list[np.ndarray]:
    """Sum of bitmaps weighted by powers of two, as the slices of the sum, least significant first."""
    out, at = [], 0
    while columns:
        maps = columns.pop(at, np.zeros((0, words), np.uint64))
        carried = [columns[at + 1]] if at + 1 in columns else []
        while len(maps) > 1:
            third = len(maps) // 3
            if third:
                a, b, c = maps[:third], maps[third : 2 * third], maps[2 * third : 3 * third]
                either = a ^ b
                carried.append((a & b) | (c & either))
                maps = np.concatenate((either ^ c, maps[3 * third :]))
            else:
                carried.append(maps[:1] & maps[1:])
                maps = maps[:1] ^ maps[1:]
        out.append(maps[0] if len(maps) else np.zeros(words, np.uint64))
        if carried:
            columns[at + 1] = np.concatenate(carried)
        at += 1
    return out


class BlockIndex:
    """Bit slices of one block of rows with the exact values behind them."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, bits: int) -> None:
        self.ids, self.values = ids, values
        n, dims = values.shape
        self.largest = int(np.abs(values).max()) if values.size else 0
        self.low = values.min(0) if n else np.zeros(dims, np.int64)
        offset = values - self.low
        widest = int(offset.max()).bit_length() if offset.size else 0
        self.shift = max(0, widest - bits)
        self.bits = min(bits, widest)
        self.words = -(-n // 64)
        self.valid = self._bitmap(np.ones(n, bool))
        coarse = offset >> self.shift
        self.slices = [[self._bitmap((coarse[:, d] >> j) & 1 > 0) for j in range(self.bits)] for d in range(dims)]

    def _bitmap(self, flags: np.ndarray) -> np.ndarray:
        packed = np.packbits(flags, bitorder="little")
        return np.pad(packed, (0, self.words * 8 - len(packed))).view(np.uint64)

    def top(self, query_id: int, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows, best first, ties to smaller ids."""
        own = self.ids == query_id
        need = k + int(own.sum())
        rows = np.arange(len(self.ids)) if len(self.ids) <= need else self._boundary(weights, need)
        rows = rows[~own[rows]]
        scores = self._scores(rows, weights)
        order = np.lexsort((self.ids[rows], -scores))[:k]
        return self.ids[rows][order], scores[order]

    def _scores(self, rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Exact inner products; where 64 bits may not hold a sum on the way, in whole numbers of any size."""
        if self.largest * sum(map(abs, weights.tolist())) <= WIDEST:
            return self.values[rows] @ weights
        whole = self.values[rows].astype(object) @ weights.astype(object)
        return np.array([max(-WIDEST, min(WIDEST, s)) for s in whole.tolist()], np.int64)

    def _boundary(self, weights: np.ndarray, need: int) -> np.ndarray:
        maps: dict[int, list[np.ndarray]] = {}
        for d, weight in enumerate(weights.tolist()):
            for at, sign in digits(weight):
                for j, bitmap in enumerate(self.slices[d]):
                    # Subtraction is the addition of the complement; the constant drops out.
                    maps.setdefault(at + j, []).append(bitmap if sign > 0 else ~bitmap)
        total = add_slices({p: np.array(m) for p, m in maps.items()}, self.words)
        above, equal, kth = np.zeros(self.words, np.uint64), self.valid, 0
        for p in range(len(total) - 1, -1, -1):
            with_bit = equal & total[p]
            if int(np.bitwise_count(above | with_bit).sum()) >= need:
                equal, kth = with_bit, kth | (1 << p)
            else:
                above, equal = above | with_bit, equal & ~total[p]
        # What the dropped low bits can add differs between two rows by at most sum |w| * (2^shift - 1).
        slack = sum(map(abs, weights.tolist())) * ((1 << self.shift) - 1) >> self.shift
        floor = kth - slack
        if floor <= 0:
            return np.arange(len(self.ids))
        more, same = np.zeros(self.words, np.uint64), self.valid
        for p in range(len(total) - 1, -1, -1):
            if floor >> p & 1:
                same = same & total[p]
            else:
                more, same = more | (same & total[p]), same & ~total[p]
        flags = np.unpackbits((more | same).view(np.uint8), bitorder="little")[: len(self.ids)]
        return np.flatnonzero(flags)


def exact_topk(
    vectors: DataFrame,
    k: int = 10,
    query_every: int = 100,
    scale: int = 1024,
    bits: int = 6,
    block_rows: int = 1 << 14,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """The k rows with the highest integer inner product for each query row.

    Components become floor(scale * x). Queries are the rows whose id is
    divisible by ``query_every``; every other row is a candidate. Ties go to
    the smaller id; fewer candidates give fewer rows.

    Vectors that are null, hold a null or a non-finite component, or have no
    id take no part. Vectors are compared with those of equal length only; an
    empty vector scores 0. Components beyond 2^61 after scaling count as 2^61,
    scores beyond 64 bits as the greatest or least number of 64 bits.
    A repeated id is one query (its smallest vector); its rows are never its
    own candidates, and remain separate candidates of other queries. An empty
    table gives no rows; other columns are ignored.

    Rows are dealt to blocks of about ``block_rows`` by a hash of their id. A
    task indexes one block and streams the queries past it, so it holds one
    block whatever the table's size; k rows per query and block are shuffled.
    """
    ship(vectors.sparkSession)
    x = F.col(vector_col).cast("array<double>")
    sound = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    whole = F.transform(x, lambda e: F.floor(F.greatest(F.least(e * float(scale), F.lit(float(LIMIT))), F.lit(-float(LIMIT)))))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.when(sound, whole).alias("v")).filter("id is not null and v is not null")
    blocks = max(1, -(-vectors.count() // block_rows))
    indexed = rows.select(
        F.size("v").alias("dims"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("kind"), "id", "v"
    )
    asked = rows.filter(F.col("id") % query_every == 0).groupBy("id").agg(F.min("v").alias("v"))
    asked = asked.select(
        F.size("v").alias("dims"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), "id", "v"
    )
    placed = indexed.union(asked).repartition(2 * blocks, "dims", "block").sortWithinPartitions("dims", "block", "kind", "id")

    def search(batches):
        at, parts, index = None, [], None
        for batch in batches:
            dims, block, kind, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            lists = batch.column(4)
            flat, begin = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            for lo, hi in spans(dims, block, kind):
                here = (int(dims[lo]), int(block[lo]))
                if here != at:
                    at, parts, index = here, [], None
                values = flat[begin[lo] : begin[hi]].reshape(hi - lo, here[0]).astype(np.int64)
                if kind[lo] == 0:
                    parts.append((ids[lo:hi].copy(), values))
                    continue
                if not parts:
                    continue
                if index is None:
                    index = BlockIndex(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), bits)
                found = [index.top(int(q), w, k) for q, w in zip(ids[lo:hi], values)]
                sizes = np.array([len(f[0]) for f in found])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(ids[lo:hi], sizes), pa.int64()),
                        pa.array(np.concatenate([f[0] for f in found]), pa.int64()),
                        pa.array(np.concatenate([f[1] for f in found]), pa.int64()),
                    ],
                    ["query_id", "vec_id", "score"],
                )

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = placed.mapInArrow(search, "query_id long, vec_id long, score long")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""
