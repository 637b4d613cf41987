"""Mixture-controlled packing by deficit round-robin over source queues.

Each source is a queue of tokens, its documents one after the other. Every
window of ``length`` tokens gives each queue its share; a share is seldom
whole, so what a queue is owed is carried as its deficit from window to window.

Without targets a queue's weight is its own token count. Queues are then the
leaves of a binary tree whose forks each pass tokens to their two sides in
proportion and owe a side less than one token (``Forks``). A queue's share of
any window follows from the forks above it, a number of rows that grows with
the logarithm of the number of queues, so there may be any number of queues,
each document finds its pieces by itself in any partition, and a queue's
deficit stays below one token a fork.

With given targets, few by nature, round j serves queue s
F_s(j) - F_{s-1}(j) tokens by then, where F_s(j) is the whole part of the first
queues' share of j windows (``Rounds``). A queue that has run dry is passed over
and the others fill the window in their proportions.
"""

from __future__ import annotations

import json
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.bpe import pieces, spelled, units
from spanloom.llm.common import ship
from spanloom.operators.sequence import scan, sequence
from spanloom.operators.sequence import total as sum_to
from spanloom.session import settle

LENGTH = 1024
#: The queue of sources without a target.
REST = ""
#: A table of partitions' places in queues of up to so many rows, some ten megabytes, is broadcast.
BROADCAST_ROWS = 1 << 17
TOKENS_AT_ONCE = 1 << 19
CACHED_WORDS = 300_000


@lru_cache(maxsize=1)
def _encoder(path: str):
    """The tokenizer file's vocabulary behind an encoder that is quicker on single words; ids are the same."""
    import tiktoken

    with open(path) as file:
        model = json.load(file)
    special = {t["content"]: t["id"] for t in model["added_tokens"]}
    # Fixed value: the byte-level pre-tokenizer's pattern.
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    ranks = {p: i for i, p in enumerate(pieces(path)) if i not in special.values()}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)


class _Coded(dict):
    """Ids of words as bytes. When it is full, words not met since it was last full are forgotten, which costs time only."""

    def __init__(self, path: str) -> None:
        super().__init__()
        self.earlier: dict[str, bytes] = {}
        self.encoder = _encoder(path)
        self.kind = "H" if len(pieces(path)) <= 1 << 16 else "I"
        self.special = set(self.encoder.special_tokens_set)

    def __missing__(self, key: str) -> bytes:
        if len(self) >= CACHED_WORDS:
            self.earlier = dict(self)
            self.clear()
        data = self.earlier.get(key)
        if data is None:
            word = spelled(key)
            ids = self.encoder.encode(word, allowed_special="all") if word in self.special else self.encoder.encode_ordinary(word)
            data = array(self.kind, ids).tobytes()
        self[key] = data
        return data


@lru_cache(maxsize=1)
def _coded(path: str) -> _Coded:
    """One for all tasks of a worker process."""
    return _Coded(path)


def tokens(docs: DataFrame, path: str, end_id: int = 0) -> DataFrame:
    """Ids of every document with ``end_id`` behind them, and the document's place among its task's documents of one source.

    Written once to the shared folder: later steps read ids, not texts.
    """
    ship(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), "text")

    def encode(batches):
        coded, part, before = _coded(path), TaskContext.get().partitionId(), {}
        end = array(coded.kind, [end_id]).tobytes()
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                ids, names, texts = (c.to_pylist() for c in batch.slice(lo, 512).columns)
                data = [b"".join([*map(coded.__getitem__, units(t or "")), end]) for t in texts]
                sizes, starts = [len(d) // len(end) for d in data], []
                for name, size in zip(names, sizes):
                    starts.append(before.get(name, 0))
                    before[name] = starts[-1] + size
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, pa.int64()),
                        pa.array(names, pa.string()),
                        pa.array([part] * len(ids), pa.int32()),
                        pa.array(starts, pa.int64()),
                        pa.array(sizes, pa.int64()),
                        pa.array(data, pa.binary()),
                    ],
                    ["doc_id", "source", "part", "start", "n", "ids"],
                )

    return settle(source.mapInArrow(encode, "doc_id long, source string, part int, start long, n long, ids binary"))


class Rounds:
    """Where the rounds put each token of each queue."""

    def __init__(self, totals: list[int], weights: list[int], length: int) -> None:
        self.totals, self.length, self.weight = totals, length, sum(weights)
        self.upto = [0]
        for w in weights:
            self.upto.append(self.upto[-1] + w)
        # Rounds before any queue runs dry; in these a place follows from the cumulated shares alone.
        low, high = 0, sum(totals) // length + 2
        while low < high:
            j = (low + high + 1) // 2
            low, high = (j, high) if all(self._owed(s, j) <= n for s, n in enumerate(totals)) else (low, j - 1)
        self.full_rounds = low

    def served(self, s: int, j: int) -> int:
        """Tokens queue s has been served before round j, as long as it lasts."""
        return min(self.totals[s], self._owed(s, j))

    def _owed(self, s: int, j: int) -> int:
        return j * self.length * self.upto[s + 1] // self.weight - j * self.length * self.upto[s] // self.weight

    def before(self, s: int, j: int) -> int:
        """Tokens all queues have been served when queue s has its turn in round j."""
        if j < self.full_rounds:
            share = self.length * self.upto[s]
            return j * self.length + (j + 1) * share // self.weight - j * share // self.weight
        return sum(self.served(x, j + (x < s)) for x in range(len(self.totals)))

    def pieces(self, s: int, start: int, stop: int):
        """(position in the queue, length, position in the packed stream) of the tokens [start, stop) of queue s."""
        share = self.upto[s + 1] - self.upto[s]
        j = max(0, start * self.weight // (share * self.length) - 2)
        while self.served(s, j + 1) <= start:
            j += 1
        at, begun, ended = start, self.served(s, j), self.served(s, j + 1)
        while at < stop:
            end = min(stop, ended)
            if end > at:
                place = self.before(s, j) + at - begun
                while at < end:
                    size = min(end - at, self.length - place % self.length)
                    yield at, size, place
                    at, place = at + size, place + size
            j += 1
            begun, ended = ended, self.served(s, j + 1)


def _floor(a: np.ndarray, b: np.ndarray, c: np.ndarray, plus: np.ndarray | int = 0) -> np.ndarray:
    """floor((a * b + plus) / c) without overflow, for results below 2**50.

    The quotient of doubles is off by one at most; the remainder, right modulo
    2**64, tells.
    """
    q = np.floor((a.astype(np.float64) * b + plus) / c).astype(np.int64)
    r = a * b + plus - q * c
    return q + (r >= c) - (r < 0)


class Forks:
    """Queues as the leaves of a binary tree; ``n``, ``left`` and ``right`` have a row for each leaf and a column for each fork above it, the root's last.

    A fork that has passed on c tokens has passed floor(c * left / n) of them
    to its left side and the others to its right side, so neither side is ever
    owed more than a token by it, and what a queue is owed after any number of
    tokens, in any partition, follows from the forks above it.
    """

    def __init__(self, n: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
        self.n, self.left, self.right = n, left, right

    def positions(self, leaf: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where in the order of all tokens the tokens ``at`` of the leaves' queues come."""
        for k in range(self.n.shape[1]):
            n, left, right = self.n[leaf, k], self.left[leaf, k], self.right[leaf, k]
            at = _floor(np.where(right, at, at + 1), n, np.where(right, n - left, left), np.where(right, 0, -1))
        return at

    def served(self, leaf: np.ndarray, now: np.ndarray, then: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of the leaf's queue among the first ``now`` and the first ``then``, and those of queues to its left between the two."""
        before = np.zeros_like(now)
        for k in reversed(range(self.n.shape[1])):
            n, left, right = self.n[leaf, k], self.left[leaf, k], self.right[leaf, k]
            passed_now, passed_then = _floor(now, left, n), _floor(then, left, n)
            before = before + np.where(right, passed_then - passed_now, 0)
            now, then = np.where(right, now - passed_now, passed_now), np.where(right, then - passed_then, passed_then)
        return now, then, before


def _ranges(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges of these sizes end to end: the range of each member and its place in it."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def window_pieces(forks: Forks, everything: int, length: int, leaf: np.ndarray, starts: np.ndarray, stops: np.ndarray):
    """Pieces of the tokens [start, stop) of the leaves' queues, one for each window that holds some of them.

    Window w holds the tokens w * length and on of the order of all tokens,
    queue by queue. A row's windows are those from its first token's to its
    last one's, or, where these are more than its tokens, those of its tokens.
    Gives arrays (row, position in the queue, length, position in the packed
    stream).
    """
    sizes, first = stops - starts, forks.positions(leaf, starts) // length
    many = forks.positions(leaf, stops - 1) // length - first + 1
    row, at = _ranges(np.where(many <= sizes, many, 0))
    window = first[row] + at
    thin, at = _ranges(np.where(many <= sizes, 0, sizes))
    met = forks.positions(leaf[thin], starts[thin] + at) // length
    new = np.ones(len(thin), bool)
    new[1:] = (thin[1:] != thin[:-1]) | (met[1:] != met[:-1])
    row, window = np.concatenate((row, thin[new])), np.concatenate((window, met[new]))
    now = window * length
    begun, ended, before = forks.served(leaf[row], now, np.minimum(now + length, everything))
    begin, end = np.maximum(begun, starts[row]), np.minimum(ended, stops[row])
    some = end > begin
    return row[some], begin[some], (end - begin)[some], (now + before + begin - begun)[some]


def _forks(totals: DataFrame, height: int) -> DataFrame:
    """(queue, fork, left, right): for each queue the tokens below the forks above it, those on their left side, and whether it lies on the right.

    Queues are numbered by name; a fork holds those whose numbers agree but for
    their last bits. However many queues there are, each brings one row a level.
    """
    numbered = scan(sequence(totals, "queue"), [], "seq", {"number": sum_to(F.lit(1).cast("long"), before=True)})
    numbered = settle(numbered.select("queue", F.coalesce("number", F.lit(0).cast("long")).alias("number"), "total"))
    if height == 0:
        none = F.array().cast("array<long>")
        return numbered.select("queue", none.alias("fork"), none.alias("left"), F.array().cast("array<boolean>").alias("right"))
    each = numbered.select("queue", "number", "total", F.explode(F.sequence(F.lit(0), F.lit(height))).alias("level"))
    each = each.withColumn("node", F.expr("shiftright(number, level)"))
    sums = settle(each.groupBy("level", "node").agg(F.sum("total").alias("sum")))
    forks = sums.select((F.col("level") - 1).alias("level"), F.col("node").alias("up"), F.col("sum").alias("n"))
    lefts = sums.filter("node % 2 = 0").select("level", F.shiftright("node", 1).alias("up"), F.col("sum").alias("left"))
    met = each.filter(F.col("level") < height).withColumn("up", F.shiftright("node", 1)).join(forks, ["level", "up"]).join(lefts, ["level", "up"])
    path = met.groupBy("queue").agg(F.sort_array(F.collect_list(F.struct("level", "n", "left", (F.col("node") % 2 == 1).alias("right")))).alias("path"))
    return path.select("queue", F.col("path.n").alias("fork"), F.col("path.left").alias("left"), F.col("path.right").alias("right"))


def pack(
    docs: DataFrame,
    path: str,
    length: int = LENGTH,
    end_id: int = 0,
    targets: dict[str, int] | None = None,
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of all documents in sequences of ``length`` tokens, each mixed in the target proportions.

    ``targets`` gives whole-number weights by source; a source without one
    goes to a common queue for the rest (weight ``targets['']``, else 1).
    Without targets every source is a queue of its own, weighted by its token
    count, so all queues last to the end and each window has each source's
    share of all tokens. Every token lies in exactly one piece and all
    sequences but the last are full.

    Null texts are empty and give the end id alone. A null source is the
    source ''. Null and repeated ids are passed through: each row is a
    document of its own. An empty table gives no rows; other columns are
    ignored.

    Texts are encoded once. A queue's order is that of the input's partitions.
    Where each partition begins in each queue is a table that meets the ids in
    a broadcast if it is small, else in a join. With targets the driver reads
    the totals of the queues it was given weights for, else one number.
    """
    coded = tokens(docs, path, end_id)
    queue = F.col("source")
    if targets is not None:
        kept = [s for s in targets if s != REST]
        queue = F.when(queue.isin(kept), queue).otherwise(F.lit(REST)) if kept else F.lit(REST)
    parts = settle(coded.groupBy("part", "source").agg(F.sum("n").alias("n")).withColumn("queue", queue))
    totals = parts.groupBy("queue").agg(F.sum("n").alias("total"))
    # A queue holds partition after partition and, within one, source after source.
    along = Window.partitionBy("queue").orderBy("part", "source").rowsBetween(Window.unboundedPreceding, -1)
    begins = parts.select("part", "source", "queue", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("base"))
    rounds = None
    if targets is None:
        found = totals.agg(F.sum("total").alias("total"), F.count(F.lit(1)).alias("queues")).first()
        everything = found["total"] or 0
        queues = _forks(totals, max(found["queues"] - 1, 0).bit_length())
    else:
        known = {r["queue"]: r["total"] for r in totals.collect()}
        names = sorted(known)
        rounds = Rounds([known[q] for q in names], [max(1, targets.get(q, 1)) for q in names], length)
        queues = docs.sparkSession.createDataFrame([(q, i) for i, q in enumerate(names)], "queue string, leaf int")
    begins = settle(begins.join(queues, "queue"))
    if begins.count() <= BROADCAST_ROWS:
        begins = F.broadcast(begins)
    placed = coded.join(begins, ["part", "source"]).select("doc_id", "queue", (F.col("base") + F.col("start")).alias("at"), "n", "ids", *queues.columns[1:])
    width = 2 if len(pieces(path)) <= 1 << 16 else 4
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "queue", "ids"][: 9 if with_ids else 8]

    def cut(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                at, n = part.column("at").to_numpy(), part.column("n").to_numpy()
                ids = [memoryview(np.frombuffer(d, f"<u{width}").astype("<u4").tobytes()) for d in part.column("ids").to_pylist()]
                for row, begin, size, place in placed_pieces(part, at, n):
                    found = [ids[r][a:b] for r, a, b in zip(row.tolist(), (4 * begin).tolist(), (4 * (begin + size)).tolist())]
                    arrays = [
                        part.column("doc_id").take(pa.array(row)),
                        pa.array(begin),
                        pa.array(size),
                        pa.array(list(map(zlib.crc32, found)), pa.int64()),
                        pa.array(n[row]),
                        pa.array(place // length),
                        pa.array(place % length),
                        part.column("queue").take(pa.array(row)),
                        pa.array([f.tobytes() for f in found] if with_ids else [], pa.binary()),
                    ]
                    yield pa.RecordBatch.from_arrays(arrays[: len(columns)], columns)

    def placed_pieces(part, at, n):
        """(row, first token of the document, length, place) of the pieces of these documents, a bounded number of tokens at once."""
        if rounds is not None:
            leaf = part.column("leaf").to_numpy()
            found = [(i, p[0] - at[i], *p[1:]) for i in range(len(at)) for p in rounds.pieces(int(leaf[i]), int(at[i]), int(at[i] + n[i]))]
            yield np.array(found, np.int64).reshape(-1, 4).T
            return
        forks = Forks(*(np.array(part.column(c).to_pylist()).reshape(len(at), -1) for c in ("fork", "left", "right")))
        cuts = [(i, a, min(int(n[i]), a + TOKENS_AT_ONCE)) for i in range(len(at)) for a in range(0, int(n[i]), TOKENS_AT_ONCE)]
        while cuts:
            some, held = [], 0
            while cuts and held < TOKENS_AT_ONCE:
                some.append(cuts.pop(0))
                held += some[-1][2] - some[-1][1]
            row, a, b = np.array(some, np.int64).T
            which, begin, size, place = window_pieces(forks, everything, length, row, at[row] + a, at[row] + b)
            yield row[which], begin - at[row[which]], size, place

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue string"
    return placed.mapInArrow(cut, schema + (", ids binary" if with_ids else ""))
