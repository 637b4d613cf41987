"""Conversation repair against a plain search over whole suffixes, on damaged tables and on tables with every odd case."""

import hashlib
import random
import re
import zlib
from pathlib import Path

import pytest

from spanloom.llm import dialogs

SCHEMA = "conv_id long, turn long, role string, text string, seq string, fault string"
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}


def cheapest(rows):
    """(cost, audit, repaired) from every state on, suffix by suffix: letters put in front keep the order of texts of one cost."""
    best = {"": (0, "", ()), "s": (6, "II", ("user:", "assistant:")), "u": (3, "I", ("assistant:",)), "a": (0, "", ())}
    full = {"u": "user", "a": "assistant"}
    for role, text, fault in reversed(rows):
        found = {}
        for state in best:
            to = NEXT[state]
            ways = [(4, "D", (), state)]
            if fault not in ("blank", "duplicate"):
                cut = 3 * (fault == "truncated")
                ways.append((3 + cut, "R", (f"{full[to]}:{text}",), to))
                if role[:1] == to or (state == "" and role[:1] == "s"):
                    ways.append((cut, "K", (f"{role}:{text}",), role[:1]))
            found[state] = min((c + best[s][0], w + best[s][1], t + best[s][2]) for c, w, t, s in ways)
        for _ in range(4):
            for state in found:
                c, w, t = found[NEXT[state]] if NEXT[state] in found else (10**9, "", ())
                found[state] = min(found[state], (c + 3, "I" + w, (f"{full[NEXT[state]]}:",) + t))
        best = found
    return best[""]


def plain(table):
    conversations, out = {}, set()
    for conv_id, turn, role, text in table:
        rows = conversations.setdefault(conv_id, [])
        shown = [" " if v is None else v for v in (conv_id, turn)]
        kind = zlib.crc32(f"{shown[0]}:{shown[1]}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        rows += [(turn is not None, turn or 0, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for conv_id, rows in conversations.items():
        seen, faulty, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0, None: 0}
        for _, _, role, text in sorted(rows):
            black = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not black else "duplicate" if (role, text) in seen else "truncated" if black[-1] not in ".!?" else None
            seen.add((role, text))
            counts[fault] += 1
            faulty.append((role, text, fault))
        turns = {r[1] for r in rows if r[0]}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(faulty, faulty[1:]))
        cost, audit, left = cheapest(faulty)
        out.add((conv_id, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return out


def table(seed):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "cut off", " \t\n", "", None, "Why? ", "a ", "long. " * 3000]
    roles = ["system", "user", "assistant", "tool", "", None, "u", "assistant\n"]
    rows = []
    for conv_id in [*range(60), None]:
        for turn in range(rng.randrange(1, 9)):
            rows.append((conv_id, rng.choice([turn, turn, turn, turn + 1, None]), rng.choices(roles, [2, 6, 6, 1, 1, 1, 1, 1])[0], rng.choice(texts)))
    rows += [(1000, t, "user" if t % 2 else "assistant", f"turn {t % 50}." if t % 7 else "broken") for t in range(400)]
    rows += rows[:20]
    return rows


@pytest.mark.parametrize("bits", [2, 16])
def test_report(spark, monkeypatch, bits):
    monkeypatch.setattr(dialogs, "SPAN_BITS", bits)
    rows = table(bits)
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(5)
    got = dialogs.report(df).collect()
    assert len(got) == 62 and set(map(tuple, got)) == plain(rows)


def test_test_table(spark):
    path = "/root/testdata/sf0.001/conversations.parquet"
    if not Path(path).exists():
        pytest.skip("no test data")
    df = spark.read.parquet(path)
    assert set(map(tuple, dialogs.report(df).collect())) == plain([(r.conv_id, r.turn, r.role, r.text) for r in df.collect()])


def test_empty(spark):
    assert dialogs.report(spark.createDataFrame([], SCHEMA)).collect() == []


def test_repaired_rows_are_sound(spark):
    rows = [(1, 1, "assistant", "Hello."), (1, 2, "assistant", "Hello."), (1, 3, "user", "What"), (2, 0, "system", "Be kind.")]
    marked = dialogs.faults(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    left = dialogs.repaired(marked, dialogs.plan(marked)).orderBy("conv_id", "seq", "place").collect()
    assert [(r.conv_id, r.role, r.text) for r in left] == [(1, "user", ""), (1, "assistant", "Hello.")]


def test_tables_hold_all_vectors():
    vectors, before, added = dialogs.tables()
    assert len(set(vectors)) == len(vectors) < 100 and before.shape == added.shape == (len(vectors), 10**dialogs.BLOCK)
    assert before.max() < len(vectors)
    rng = random.Random(3)
    for _ in range(200):
        block, at = rng.randrange(10**dialogs.BLOCK), rng.randrange(len(vectors))
        costs = vectors[at]
        for digit in reversed(f"{block:0{dialogs.BLOCK}d}"):
            costs = dialogs._before(costs, int(digit))
        assert added[at, block] == costs[0] and vectors[before[at, block]] == tuple(c - costs[0] for c in costs)
