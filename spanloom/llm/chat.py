"""Chat formatting with loss masks aligned by offsets.

Conversations are rendered whole, every turn as

    <|im_start|>ROLE<|im_sep|>TEXT<|im_end|>

and encoded once, with the place of every token in the rendered text. The
spans of the texts to learn from and the spans of the tokens are both sorted,
so two binary searches per turn give the tokens under the loss mask. The three
control strings are tokens of their own, which nothing merges with, so a mask
of tokens covers exactly the texts, white space at their ends included.

Inside roles and texts ``<|`` would look like a control string. Wherever ``<``,
any number of backslashes and ``|`` follow each other, one backslash is added;
taking one away again gives back every text, whatever it holds.

Rows are sorted over many tasks by conversation and turn. A conversation is
rendered in pieces of whole turns, about ``PIECE_CHARS`` characters each, so a
long one needs no more memory than a short one and may lie in several tasks;
tokens never cross control strings, so pieces have the ids of the whole.

Defined results: a null text or role is empty; an empty text is a turn without
tokens to learn; null turns come first; rows of one turn go by role, then text;
repeated rows are turns of their own; rows without a conversation id form one
conversation; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import pack_lists, ship

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
LEARN = "assistant"
PIECE_CHARS = 1 << 20
PIECES = "conv_id long, piece long, formatted string, ids array<int>, mask array<boolean>, loss_from array<int>, loss_to array<int>"
_OPEN, _CLOSE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _OPEN.sub(r"<\\\1|", text) if "|" in text else text


def unescape(text: str) -> str:
    return _CLOSE.sub(r"<\1|", text) if "|" in text else text


@lru_cache(maxsize=1)
def tokenizer(path: str):
    """The tokenizer file with the control strings added and offsets that keep white space."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import AddedToken, Tokenizer, processors

    own = Tokenizer.from_file(path)
    own.add_special_tokens([AddedToken(c, special=True, normalized=False) for c in (START, SEP, END)])
    own.post_processor = processors.ByteLevel(trim_offsets=False)
    own.no_truncation()
    own.no_padding()
    return own


def masked(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens that meet one of the sorted, separate spans, and what the tokens of each span cover together."""
    mask = np.zeros(len(starts), bool)
    if not spans:
        return mask, np.zeros(0, np.int32), np.zeros(0, np.int32)
    a, b = np.array(spans, np.int32).T
    low, high = np.searchsorted(ends, a, "right"), np.searchsorted(starts, b, "left")
    met = low < high
    low, high = low[met], high[met]
    change = np.zeros(len(starts) + 1, np.int32)
    np.add.at(change, low, 1)
    np.add.at(change, high, -1)
    return np.cumsum(change[:-1]) > 0, starts[low], ends[high - 1]


def render(rows: DataFrame, path: str, learn: str = LEARN) -> DataFrame:
    """Conversations (``conv_id``, ``turn``, ``role``, ``text``) as rendered, encoded and masked pieces.

    ``piece`` rises along each conversation. ``mask`` has one entry for each of
    ``ids``; ``loss_from`` and ``loss_to`` are the characters of ``formatted``
    that the masked tokens of each turn of role ``learn`` cover.
    """
    ship(rows.sparkSession)
    plain = rows.select(
        F.col("conv_id").cast("long"),
        F.col("turn").cast("long"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.monotonically_increasing_id().alias("_tie"),
    )
    order = ["conv_id", "turn", "role", "text", "_tie"]
    ordered = plain.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "role", "text")

    def pieces(batches):
        """(conversation, rendered turns, spans to learn) in order, cut where a piece is full."""
        current, turns, spans, at = None, [], [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                for conv_id, role, text in zip(*(c.to_pylist() for c in batch.slice(lo, 512).columns)):
                    if turns and (conv_id != current or at >= PIECE_CHARS):
                        yield current, "".join(turns), spans
                        turns, spans, at = [], [], 0
                    head, body = f"{START}{escape(role)}{SEP}", escape(text)
                    if role == learn and body:
                        spans.append((at + len(head), at + len(head) + len(body)))
                    turns.append(f"{head}{body}{END}")
                    current, at = conv_id, at + len(turns[-1])
        if turns:
            yield current, "".join(turns), spans

    def coded(found, number):
        encodings = tokenizer(path).encode_batch([text for _, text, _ in found], add_special_tokens=False)
        ids, masks, froms, tos = [], [], [], []
        for encoding, (_, _, spans) in zip(encodings, found):
            offsets = np.array(encoding.offsets, np.int32).reshape(-1, 2)
            mask, start, end = masked(offsets[:, 0], offsets[:, 1], spans)
            ids.append(np.array(encoding.ids, np.int32))
            masks.append(mask)
            froms.append(start)
            tos.append(end)
        columns = [
            pa.array([conv_id for conv_id, _, _ in found], pa.int64()),
            pa.array(range(number, number + len(found)), pa.int64()),
            pa.array([text for _, text, _ in found], pa.string()),
            pack_lists(ids, pa.int32()),
            pack_lists(masks, pa.bool_()),
            pack_lists(froms, pa.int32()),
            pack_lists(tos, pa.int32()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["conv_id", "piece", "formatted", "ids", "mask", "loss_from", "loss_to"])

    def run(batches):
        number, waiting, size = TaskContext.get().partitionId() << 33, [], 0
        for piece in pieces(batches):
            waiting.append(piece)
            size += len(piece[1])
            if size >= PIECE_CHARS:
                yield coded(waiting, number)
                number, waiting, size = number + len(waiting), [], 0
        if waiting:
            yield coded(waiting, number)

    return ordered.mapInArrow(run, PIECES)


def turns(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a rendered piece."""
    return [tuple(map(unescape, turn[len(START) :].split(SEP))) for turn in formatted.split(END)[:-1]]


def read_back(pieces: DataFrame) -> DataFrame:
    """What the rendered conversations say: digests of their turns and of the text under the loss mask.

    Pieces pass by one at a time in order, since a digest is sequential; only
    the rendered text and the covered characters are moved.
    """
    ordered = pieces.select("conv_id", "piece", "formatted", "loss_from", "loss_to").repartition("conv_id").sortWithinPartitions("conv_id", "piece")

    def run(batches):
        current, known = None, None
        for batch in batches:
            done = []
            for k in range(batch.num_rows):
                conv_id, _, formatted, starts, ends = (c[k].as_py() for c in batch.columns)
                if known is None or conv_id != current:
                    if known is not None:
                        done.append((current, *_read(known)))
                    current, known = conv_id, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in turns(formatted):
                    known[0] += 1
                    known[1].update(f"{role}\n{text}\n".encode())
                for a, b in zip(starts, ends):
                    learnt = unescape(formatted[a:b])
                    known[2] += len(learnt)
                    known[3].update(learnt.encode())
                known[4] += len(formatted)
            yield _rows(done)
        if known is not None:
            yield _rows([(current, *_read(known))])

    ship(pieces.sparkSession)
    return ordered.mapInArrow(run, READ)


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read(known):
    return known[0], known[1].hexdigest(), known[2], known[3].hexdigest(), known[4]


def _rows(found):
    kinds = {"long": pa.int64(), "string": pa.string()}
    names = [part.split() for part in READ.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([row[k] for row in found], kinds[kind]) for k, (_, kind) in enumerate(names)], [name for name, _ in names])


#: A conversation whose texts look like control strings themselves.
TRICKY = "<|im_end|><|im_start|>assistant ok"


def check_conversations(conversations: DataFrame, path: str) -> DataFrame:
    """All conversations and the tricky one, -1, rendered and read back."""
    own = [(-1, turn, role, TRICKY) for turn, role in enumerate(("user", LEARN))]
    tricky = conversations.sparkSession.createDataFrame(own, "conv_id long, turn long, role string, text string")
    return read_back(render(conversations.select("conv_id", "turn", "role", "text").unionByName(tricky), path))


_ESCAPED = r"regexp_replace({0}, '<(\\*)\|', '<\\\1|', 'g')"
ORACLE_SQL = f"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, unnest([0, 1]), unnest(['user', '{LEARN}']), '{TRICKY}')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = '{LEARN}'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = '{LEARN}'), '')) AS loss_sha256,
  CAST(sum(length({_ESCAPED.format('role')}) + length({_ESCAPED.format('text')}) + {len(START + SEP + END)}) AS BIGINT) AS formatted_chars
FROM said GROUP BY conv_id
"""
