"""Repair of conversations at least cost, by Four-Russians block tables.

A sound conversation is ``(system? (user assistant)+)?`` by the initials of its
roles. Rows may be kept, deleted, given another role, or new empty rows may be
inserted, each at its price. The cost to go from a point on is a vector of four
numbers, one for each state of that grammar. These vectors, less their first
entry, are few: whatever rows follow, the states differ by at most a few edits.

1. A row is one of a few symbols (role initial and fault). For every vector and
   every block of ``BLOCK`` symbols a table holds the vector before the block
   and what the block adds to the cost.
2. Conversations are cut into segments of at most ``2**SPAN_BITS`` rows. A
   segment looks up its blocks from the last to the first, for every vector
   that may stand behind it, so segments need not wait for each other; what
   they hand over is put together by conversation.
3. With the vector behind it known, a segment expands its blocks backward, each
   from the vector at its right end, and reads the edits off forward: at every
   point the first letter, in ASCII order, among the edits that still lead to
   the least cost. A letter decides state and row, so this gives the least text
   of all cheapest edits. Expanded blocks are kept, so this is a lookup too.

Rows are placed by a range sort, so a conversation that holds a third of all
rows is spread over many tasks; texts take no part in the search.

Defined results: a null role or text counts as one space, a null turn comes
first, rows without a conversation id form one conversation; rows of one turn
go by role, then text; repeated rows are duplicates of each other; an empty or
unknown role cannot stay, a role that begins with s, u or a counts as system,
user or assistant; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import ship
from spanloom.llm.merkle import CRC_SQL, field
from spanloom.operators.sequence import sequence
from spanloom.session import settle

RETYPE, DELETE, INSERT, CUT = 3, 4, 3, 3
BLOCK = 4
SPAN_BITS = 16
BLANKS = " \t\n\x0b\x0c\r"
#: States: nothing yet, after system, after user, after assistant; and the state behind the row that each of them calls for.
START, SYSTEM, USER, ASSISTANT = range(4)
FOLLOWS = (USER, USER, ASSISTANT, USER)
#: Symbols: 0 must go; 1 to 4 begins with s, u, a or anything else; 5 to 8 the same with a text cut off; 9 fills a block up.
FILL = 9
#: Rows as letters, role initial by fault (sound, blank, duplicate, truncated), and the symbol of each.
LETTERS = "abcdefghijklmnop"
_SYMBOL = bytes.maketrans(LETTERS.encode(), b"1005200630074008")


def _kept(state: int, symbol: int) -> int | None:
    """The state after keeping a row as it is, None if it can't stay."""
    role = (SYSTEM, USER, ASSISTANT, None)[(symbol - 1) % 4]
    return role if role == FOLLOWS[state] or (state == START and role == SYSTEM) else None


def _edits(state: int, symbol: int):
    """Ways to use up a row, least letter first: letter, cost, next state."""
    yield "D", DELETE, state
    if symbol:
        extra = CUT if symbol > 4 else 0
        after = _kept(state, symbol)
        if after is not None:
            yield "K", extra, after
        yield "R", RETYPE + extra, FOLLOWS[state]


def _inserted(costs: list[int]) -> list[int]:
    for _ in range(3):
        costs = [min(c, INSERT + costs[FOLLOWS[s]]) for s, c in enumerate(costs)]
    return costs


def _before(costs: tuple[int, ...], symbol: int) -> tuple[int, ...]:
    """Costs to go in front of a row, from those behind it."""
    if symbol == FILL:
        return costs
    return tuple(_inserted([min(cost + costs[after] for _, cost, after in _edits(s, symbol)) for s in range(4)]))


END = (0, 2 * INSERT, INSERT, 0)


@lru_cache(maxsize=1)
def tables() -> tuple[list[tuple[int, ...]], np.ndarray, np.ndarray]:
    """All vectors that occur; per vector and block the vector before it, and the cost it adds."""
    found, steps = {END: 0}, []
    for vector in found_in_order(found):
        row = []
        for symbol in range(10):
            costs = _before(vector, symbol)
            row.append((found.setdefault(tuple(c - costs[START] for c in costs), len(found)), costs[START]))
        steps.append(row)
    to, cost = (np.array([[cell[k] for cell in row] for row in steps], np.int32) for k in (0, 1))
    before, added = np.arange(len(found), dtype=np.int32)[:, None], np.zeros((len(found), 1), np.int32)
    for _ in range(BLOCK):
        # The new symbol stands in front of the block, so it is the block number's highest digit.
        added = (added[:, None, :] + cost[before].transpose(0, 2, 1)).reshape(len(found), -1)
        before = to[before].transpose(0, 2, 1).reshape(len(found), -1)
    return list(found), before, added


def found_in_order(found: dict):
    """Keys of a dictionary that grows meanwhile."""
    at = 0
    while at < len(found):
        yield list(found)[at]
        at += 1


def block_numbers(letters: bytes) -> np.ndarray:
    """Symbols of a segment as block numbers, filled up in front."""
    symbols = letters.translate(_SYMBOL)
    symbols = b"9" * (-len(symbols) % BLOCK) + symbols
    return (np.frombuffer(symbols, np.uint8).reshape(-1, BLOCK) - 48) @ (10 ** np.arange(BLOCK - 1, -1, -1))


def moves(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every vector that may stand behind a segment, the one before it and the cost between."""
    vectors, before, added = tables()
    at, cost = np.arange(len(vectors)), np.zeros(len(vectors), np.int64)
    for block in blocks[::-1]:
        cost += added[at, block]
        at = before[at, block]
    return at, cost


@lru_cache(maxsize=1 << 18)
def _traced(vector: int, block: int, state: int) -> tuple[str, int]:
    """Edits of a block's rows when ``vector`` stands behind it, and the state after them."""
    symbols = [int(d) for d in f"{block:0{BLOCK}d}"]
    costs = [tables()[0][vector]]
    for symbol in reversed(symbols):
        costs.insert(0, _before(costs[0], symbol))
    out = []
    for k, symbol in enumerate(symbols):
        while symbol != FILL:
            left, behind = costs[k], costs[k + 1]
            fits = [(letter, after) for letter, cost, after in _edits(state, symbol) if cost + behind[after] == left[state]]
            if INSERT + left[FOLLOWS[state]] == left[state]:
                fits.append(("I", FOLLOWS[state]))
            letter, after = min(fits)
            if letter in "IR":
                letter = {"I": "ua", "R": "UA"}[letter][after == ASSISTANT]
            out.append(letter)
            state = after
            if letter not in "ua":
                break
    return "".join(out), state


def trace(blocks: np.ndarray, vector: int, state: int, last: bool) -> tuple[str, int]:
    """Edits of a segment: D, K, U and A (role changed to user, assistant) use up a row, u and a insert one."""
    _, before, _ = tables()
    behind = []
    for block in blocks[::-1]:
        behind.append(vector)
        vector = before[vector, block]
    out = []
    for block, right in zip(blocks.tolist(), reversed(behind)):
        edits, state = _traced(int(right), block, state)
        out.append(edits)
    while last and END[state]:
        state = FOLLOWS[state]
        out.append("a" if state == ASSISTANT else "u")
    return "".join(out), state


def faults(rows: DataFrame) -> DataFrame:
    """Rows of conversations (``conv_id``, ``turn``, ``role``, ``text``) in order, each with its first fault.

    Adds ``seq``, a position that rises along each conversation, and
    ``fault``: 0 none, 1 blank, 2 duplicate, 3 truncated.
    """
    plain = rows.select(
        F.col("conv_id").cast("long"),
        F.col("turn").cast("long"),
        F.coalesce(F.col("role"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text"), F.lit(" ")).alias("text"),
        F.monotonically_increasing_id().alias("_tie"),
    )
    placed = sequence(plain, "conv_id", "turn", "role", "text", "_tie").drop("_tie")
    end = F.rtrim("text", F.lit(BLANKS))
    own = F.when(end == "", 1).when(~F.right(end, F.lit(1)).isin(".", "!", "?"), 3).otherwise(0)
    slim = placed.select("seq", own.alias("own"), F.unhex(F.sha2(F.concat(*map(field, map(F.col, ("conv_id", "role", "text")))), 256)).alias("same"))
    repeated = slim.groupBy("same").agg(F.min("seq").alias("earliest"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    marked = slim.join(repeated, "same", "left").select(
        "seq", F.when((F.col("own") != 1) & (F.col("seq") > F.col("earliest")), 2).otherwise(F.col("own")).alias("fault")
    )
    return settle(placed.join(marked, "seq"))


def letter(role: Column, fault: Column) -> Column:
    """A row as one letter: role initial by fault."""
    initial = F.left(role, F.lit(1))
    at = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return F.substring(F.lit(LETTERS), at * 4 + fault + 1, 1)


def _map(df: DataFrame, schema: str, work) -> DataFrame:
    """``work`` on every row (a dictionary), which gives any number of tuples."""
    ship(df.sparkSession)
    names = [part.split()[0] for part in schema.split(", ")]
    kinds = df.sparkSession.createDataFrame([], schema).schema

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        form = to_arrow_schema(kinds)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                found = [out for row in batch.slice(lo, 256).to_pylist() for out in work(row)]
                yield pa.RecordBatch.from_pylist([dict(zip(names, out)) for out in found], form)

    return df.mapInArrow(run, schema)


_LEGAL = {(0, 1), (1, 2), (2, 1)}


def _summary(row):
    """A segment's moves, with the roles at its ends and the misplaced neighbours between."""
    letters = row["letters"].encode()
    initials = [(c - 97) // 4 for c in letters]
    at, cost = moves(block_numbers(letters))
    wrong = sum(pair not in _LEGAL for pair in zip(initials, initials[1:]))
    yield row["conv_id"], row["first"], at.tolist(), cost.tolist(), initials[0], initials[-1], wrong


def _handed(row):
    """The vector behind each segment of a conversation, from the last segment to the first."""
    parts = row["parts"]
    vector, cost, wrong = 0, 0, sum(p["wrong"] for p in parts)
    wrong += sum((a["right"], b["left"]) not in _LEGAL for a, b in zip(parts, parts[1:]))
    out = []
    for k in range(len(parts) - 1, -1, -1):
        out.append((parts[k]["first"], vector, k == 0, k == len(parts) - 1))
        cost += parts[k]["cost"][vector]
        vector = parts[k]["to"][vector]
    for first, behind, heads, ends in out:
        yield first, behind, heads, ends, cost, wrong


def _followed(row):
    """Edits of a segment for every state before it; the first one of a conversation has one only."""
    blocks = block_numbers(row["letters"].encode())
    ways = [trace(blocks, row["vector"], state, row["ends"]) for state in ((START,) if row["heads"] else range(4))]
    yield row["conv_id"], row["first"], [w[0] for w in ways], [w[1] for w in ways], row["cost"], row["illegal"]


def _entered(row):
    state = 0
    for part in row["parts"]:
        yield part["first"], state
        state = part["exits"][state if len(part["exits"]) > 1 else 0]


def plan(rows: DataFrame) -> DataFrame:
    """Cheapest edits for rows as ``faults`` gives them, one row a segment.

    ``first`` is the ``seq`` of the segment's first row; ``edits`` has for
    every row any u and a (insert user, assistant) and then D, K, U or A
    (delete, keep, change to user, to assistant); inserts behind the last row
    of a conversation end its last segment. ``cost`` and ``illegal`` (rows
    whose role must not follow the one before) are the conversation's.
    """
    slim = rows.select("conv_id", "seq", letter(F.col("role"), F.col("fault")).alias("letter"))
    parts = slim.groupBy("conv_id", F.shiftright("seq", SPAN_BITS).alias("cut")).agg(
        F.min("seq").alias("first"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "letter"))), lambda r: r["letter"]), "").alias("letters"),
    )
    segments = settle(parts.select("conv_id", "first", "letters"))
    known = _map(segments, "conv_id long, first long, to array<int>, cost array<long>, left int, right int, wrong long", _summary)
    gathered = known.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("first", "to", "cost", "left", "right", "wrong"))).alias("parts"))
    behind = _map(gathered, "first long, vector int, heads boolean, ends boolean, cost long, illegal long", _handed)
    traced = settle(
        _map(segments.join(behind, "first"), "conv_id long, first long, ways array<string>, exits array<int>, cost long, illegal long", _followed)
    )
    exits = traced.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("first", "exits"))).alias("parts"))
    entries = _map(exits, "first long, state int", _entered)
    way = F.get("ways", F.when(F.size("ways") > 1, F.col("state")).otherwise(0))
    return traced.join(entries, "first").select("conv_id", "first", way.alias("edits"), "cost", "illegal")


def repaired(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """The rows that the edits leave, with ``seq`` and ``place`` as their order in a conversation."""
    each = plans.select("first", F.posexplode(F.regexp_extract_all("edits", F.lit("[ua]*[DKUA](?:[ua]+$)?"), 0)).alias("at", "edit"))
    edits = each.select((F.col("first") + F.col("at")).alias("seq"), "edit")

    def made(c: Column) -> Column:
        role = F.when(c == "K", F.col("role")).when(F.lower(c) == "u", "user").when(F.lower(c) == "a", "assistant")
        return F.struct(role.alias("role"), F.when(c.isin("u", "a"), "").otherwise(F.col("text")).alias("text"))

    left = F.transform(F.split(F.replace("edit", F.lit("D"), F.lit("")), ""), made)
    some = rows.join(edits, "seq").filter("edit <> 'D'")
    return some.select("conv_id", "seq", F.posexplode(left).alias("place", "row")).select("conv_id", "seq", "place", "row.*")


def text_digests(rows: DataFrame) -> DataFrame:
    """SHA-256 of each conversation's ``role:text`` lines in order.

    Rows pass by one at a time, sorted by Spark, which spills; a digest is
    sequential by nature, so a conversation's rows meet in one task here alone.
    """
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "seq", "place").select("conv_id", "role", "text")

    def run(batches):
        current, known = None, None
        for batch in batches:
            done = []
            for conv_id, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if known is None or conv_id != current:
                    if known is not None:
                        done.append((current, known.hexdigest()))
                    current, known = conv_id, hashlib.sha256()
                    known.update(f"{role}:{text}".encode())
                else:
                    known.update(f"\n{role}:{text}".encode())
            yield _digest_rows(done)
        if known is not None:
            yield _digest_rows([(current, known.hexdigest())])

    ship(rows.sparkSession)
    return ordered.mapInArrow(run, "conv_id long, sha string")


def _digest_rows(found):
    return pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), pa.array([d for _, d in found], pa.string())], ["conv_id", "sha"])


def damaged(rows: DataFrame) -> DataFrame:
    """The damage the check asks for, decided by the CRC of conversation and turn: a row is dropped, emptied, robbed of its stops, repeated or made the user's."""
    at = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(at[0], F.lit(":"), at[1]).cast("binary")) % 20
    text = F.coalesce("text", F.lit(" "))
    return (
        rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"), kind.alias("kind"))
        .filter("kind <> 0")
        .select(
            "conv_id",
            "turn",
            F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
            F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
            F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1).cast("int"))).alias("_"),
        )
        .drop("_")
    )


def report(conversations: DataFrame) -> DataFrame:
    """Faults, cheapest edits and repaired digest of every conversation after damage."""
    rows = faults(damaged(conversations))
    plans = settle(plan(rows))
    counted = rows.groupBy(F.col("conv_id").alias("id")).agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).alias("gaps"),
        *[F.count_if(F.col("fault") == k).alias(name) for k, name in ((1, "blank"), (2, "duplicate"), (3, "truncated"))],
    )
    audits = plans.groupBy(F.col("conv_id").alias("planned")).agg(
        F.max("illegal").alias("illegal"),
        F.max("cost").alias("cost"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "edits"))), lambda p: p["edits"]), "").alias("edits"),
    )
    digests = text_digests(repaired(rows, plans)).withColumnRenamed("conv_id", "kept")
    everyone = conversations.select(F.col("conv_id").cast("long")).distinct()
    found = (
        everyone.join(counted, F.col("conv_id").eqNullSafe(F.col("id")), "left")
        .join(audits, F.col("conv_id").eqNullSafe(F.col("planned")), "left")
        .join(digests, F.col("conv_id").eqNullSafe(F.col("kept")), "left")
    )
    numbers = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    audit = F.translate(F.coalesce("edits", F.lit("")), "uaUA", "IIRR").alias("audit")
    return found.select("conv_id", *numbers, audit, F.coalesce("sha", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def _sql() -> str:
    """The same report by a plain search over suffixes: per state the least (cost, audit), with the rows it leaves."""

    def put(cost: str, mark: str, line: str, behind: str) -> str:
        tail = f"CASE WHEN {behind}.t = '' THEN '' ELSE chr(10) || {behind}.t END"
        return f"{{'c': {behind}.c + {cost}, 'w': '{mark}' || {behind}.w, 't': {line} || {tail}}}"

    names, kept = ("h0", "hs", "hu", "ha"), "role || ':' || text"
    steps = []
    for state, own in enumerate(names):
        to = FOLLOWS[state]
        role = "'user:'" if to == USER else "'assistant:'"
        ways = [put(str(RETYPE) + " + cut", "R", f"{role} || text", names[to])]
        for initial, after in (("s", SYSTEM), ("u", USER), ("a", ASSISTANT)):
            if after == to or (state == START and after == SYSTEM):
                ways.append(f"CASE WHEN left(role, 1) = '{initial}' THEN {put('cut', 'K', kept, names[after])} END")
        free = ", ".join(f"CASE WHEN fault < 2 THEN {way} END" for way in ways)
        gone = f"{{'c': {own}.c + {DELETE}, 'w': 'D' || {own}.w, 't': {own}.t}}"
        steps.append(f"list_min(list_filter([{gone}, {free}], lambda x: x IS NOT NULL)) AS g{own[1]}")
    user, assistant = put(str(INSERT), "I", "'user:'", "gu"), put(str(INSERT), "I", "'assistant:'", "ga")
    return f"""
WITH RECURSIVE hit AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {CRC_SQL.format(text="coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind
  FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE kind WHEN 0 THEN []::INT[] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM hit),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM damaged),
marked AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 2
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 3
      WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 1 ELSE 0 END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) || left(role, 1) AS pair
  FROM numbered),
search AS (
  SELECT conv_id, max(n) AS n, {{'c': 0, 'w': '', 't': ''}} AS h0, {{'c': 6, 'w': 'II', 't': 'user:' || chr(10) || 'assistant:'}} AS hs,
    {{'c': 3, 'w': 'I', 't': 'assistant:'}} AS hu, {{'c': 0, 'w': '', 't': ''}} AS ha
  FROM marked GROUP BY conv_id
  UNION ALL
  SELECT conv_id, n - 1, least(g0, {user}), least(gs, {user}), least(gu, {assistant}), least(ga, {user})
  FROM (SELECT conv_id, n, g0, gs, least(gu, {assistant}) AS gu, ga
    FROM (SELECT s.conv_id, s.n, {', '.join(steps)}
      FROM search s JOIN (SELECT *, CASE fault WHEN 1 THEN {CUT} ELSE 0 END AS cut FROM marked) r ON s.conv_id IS NOT DISTINCT FROM r.conv_id AND s.n = r.n))),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 2) AS blank,
    count(*) FILTER (fault = 3) AS duplicate, count(*) FILTER (fault = 1) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au') OR length(pair) < 2) AS illegal
  FROM marked GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(coalesce(h0.c, 0) AS BIGINT) AS cost, coalesce(h0.w, '') AS audit, sha256(coalesce(h0.t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) e
LEFT JOIN counted c ON e.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN (SELECT * FROM search WHERE n = 0) s ON e.conv_id IS NOT DISTINCT FROM s.conv_id
"""


ORACLE_SQL = _sql()
