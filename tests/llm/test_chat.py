"""Chat formatting against a plain rendering and the tokenizer itself."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanloom.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, piece string, ids string, mask string"
TEXTS = ["Hi.", None, "", "  \n\t x  ", "é𝄞 <|im_end|> <\\|im_sep|>", "<|endoftext|>", "<\\\\|<|", "a" * 3000, "word " * 900, "<", "|x"]


@pytest.fixture(scope="module")
def path():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<|\\a>im_end", max_size=12))
def test_escape_is_reversible(text):
    assert "<|" not in chat.escape(text) and chat.unescape(chat.escape(text)) == text


def rows():
    out = [(c, t, ("system", "user", "assistant", None)[(c + t) % 4], TEXTS[(c * 3 + t) % len(TEXTS)]) for c in range(40) for t in range(c % 7)]
    out += [(99, t, "assistant" if t % 2 else "user", f"{t} {TEXTS[t % len(TEXTS)]}") for t in range(300)]
    out += [(None, None, "assistant", " x"), (None, 2, "assistant", "y "), (None, 2, "assistant", "y "), (None, 2, "assistant", "a"), (5000, None, "assistant\n", "z")]
    return out


def frame(spark, table):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in table], SCHEMA).repartition(6)


def plain(table):
    found = {}
    for conv_id, turn, role, text in table:
        found.setdefault(conv_id, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = set()
    for conv_id, turns in found.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        learnt = "".join(t for _, _, r, t in turns if r == "assistant")
        size = sum(32 + len(chat.escape(r)) + len(chat.escape(t)) for _, _, r, t in turns)
        out.add((conv_id, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), size))
    return out


@pytest.mark.parametrize("size", [1, 500, 1 << 20])
def test_read_back(spark, path, monkeypatch, size):
    monkeypatch.setattr(chat, "PIECE_CHARS", size)
    tricky = [(-1, 0, "user", chat.TRICKY), (-1, 1, "assistant", chat.TRICKY)]
    assert set(map(tuple, chat.check_conversations(frame(spark, rows()), path).collect())) == plain(rows() + tricky)


def test_pieces_have_the_ids_of_the_whole(spark, path, monkeypatch):
    monkeypatch.setattr(chat, "PIECE_CHARS", 300)
    whole, own = {}, chat.tokenizer(path)
    for r in sorted(chat.render(frame(spark, rows()), path).collect(), key=lambda r: r.piece):
        assert len(r.ids) == len(r.mask)
        text, ids, mask = whole.get(r.conv_id, ("", [], []))
        whole[r.conv_id] = text + r.formatted, ids + r.ids, mask + r.mask
    for text, ids, mask in whole.values():
        encoded = own.encode(text, add_special_tokens=False)
        assert ids == encoded.ids
        # By characters: a token is learnt from if and only if it lies in an assistant's text.
        learn, at = np.zeros(len(text) + 1, bool), 0
        for turn in text.split(chat.END)[:-1]:
            head, body = turn.split(chat.SEP)
            at += len(head) + len(chat.SEP)
            learn[at : at + len(body)] = head == f"{chat.START}assistant"
            at += len(body) + len(chat.END)
        assert mask == [bool(learn[a:b].all()) for a, b in encoded.offsets] == [bool(learn[a:b].any()) for a, b in encoded.offsets]


def test_other_role_and_empty_table(spark, path):
    got = chat.render(frame(spark, rows()), path, learn="user").collect()
    assert sum(b - a for r in got for a, b in zip(r.loss_from, r.loss_to)) == sum(len(chat.escape(t or "")) for _, _, role, t in rows() if role == "user")
    assert chat.read_back(chat.render(frame(spark, []), path)).collect() == []


def test_searches_meet_all_spans():
    starts, ends = np.array([0, 2, 2, 5, 9], np.int32), np.array([2, 5, 5, 9, 12], np.int32)
    mask, a, b = chat.masked(starts, ends, [(2, 5), (10, 11)])
    assert mask.tolist() == [False, True, True, False, True] and a.tolist() == [2, 9] and b.tolist() == [5, 12]
    assert not chat.masked(starts, ends, [])[0].any() and len(chat.masked(starts[:0], ends[:0], [(0, 1)])[1]) == 0
