"""Column functions on event ids, packed words, clocks and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom import fixed_values as fv


def long_lit(value: int) -> Column:
    """A literal LONG; values from 2**63 up keep their bit pattern."""
    return F.lit(value - (1 << 64) if value >= 1 << 63 else value).cast("long")


def bits(column: Column, mask: int) -> Column:
    return column.bitwiseAND(long_lit(mask))


# debugid ---------------------------------------------------------------


def event_class(debugid: Column) -> Column:
    return bits(F.shiftright(debugid, 24), 0xFF)


def event_subclass(debugid: Column) -> Column:
    return bits(F.shiftright(debugid, 16), 0xFF)


def class_subclass(debugid: Column) -> Column:
    return bits(F.shiftright(debugid, 16), 0xFFFF)


def event_code(debugid: Column) -> Column:
    return bits(F.shiftright(debugid, 2), 0x3FFF)


def event_id(debugid: Column) -> Column:
    return bits(debugid, fv.EVENTID_MASK)


def qualifier(debugid: Column) -> Column:
    return bits(debugid, 3)


def is_start(debugid: Column) -> Column:
    return bits(debugid, fv.START_BIT) != 0


def is_end_only(debugid: Column) -> Column:
    """END without START: a record with both bits counts as START."""
    return qualifier(debugid) == fv.END_BIT


def encode_event_id(cls: Column, subclass: Column, code: Column) -> Column:
    return (
        F.shiftleft(bits(cls, 0xFF), 24)
        .bitwiseOR(F.shiftleft(bits(subclass, 0xFF), 16))
        .bitwiseOR(F.shiftleft(bits(code, 0x3FFF), 2))
    )


def split_class_subclass(csc: Column) -> tuple[Column, Column]:
    return bits(F.shiftright(csc, 8), 0xFF), bits(csc, 0xFF)


def join_class_subclass(cls: Column, subclass: Column) -> Column:
    return F.shiftleft(bits(cls, 0xFF), 8).bitwiseOR(bits(subclass, 0xFF))


def class_name(cls: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in fv.CLASS_NAMES.items() for x in pair])
    return F.try_element_at(names, cls.cast("int"))


# clocks ----------------------------------------------------------------


def clock_divisor(numer: int = 1, denom: int = 1, frequency: int | None = None) -> float:
    """Clock ticks per microsecond, from a timebase fraction or a frequency in Hz."""
    return frequency / 1_000_000 if frequency else denom / numer * 1000


def ticks_to_us(ticks: Column, divisor: float) -> Column:
    return ticks.cast("double") / F.lit(float(divisor))


def cpu_from_clock(ts: Column) -> Column:
    """CPU number in the top byte of a 32-bit system's timestamp."""
    return F.shiftrightunsigned(ts, 56)


def clock_without_cpu(ts: Column) -> Column:
    return bits(ts, 0x00FFFFFFFFFFFFFF)


# packed 64-bit words ---------------------------------------------------


def high_half(word: Column) -> Column:
    return F.shiftrightunsigned(word, 32)


def low_half(word: Column) -> Column:
    return bits(word, 0xFFFFFFFF)


def pack_halves(high: Column, low: Column) -> Column:
    return F.shiftleft(high.cast("long"), 32).bitwiseOR(low_half(low.cast("long")))


def is_mig(msg_id: Column) -> Column:
    return bits(F.shiftrightunsigned(msg_id, fv.MIG_BIT), 1) == 1


def from_kernel(msg_id: Column) -> Column:
    return bits(F.shiftrightunsigned(msg_id, fv.FROM_KERNEL_BIT), 1) == 1


def plain_msg_id(msg_id: Column) -> Column:
    return bits(msg_id, ~((1 << fv.MIG_BIT) | (1 << fv.FROM_KERNEL_BIT)) & 0xFFFFFFFFFFFFFFFF)


def wakeup_kind(kind: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in fv.WAKEUP_KINDS.items() for x in pair])
    return F.try_element_at(names, kind.cast("int"))


def word_hex(word: Column) -> Column:
    """The 8 bytes of a word in memory order (little endian) as 16 hex digits."""
    big = F.lpad(F.hex(word), 16, "0")
    return F.concat(*[F.substring(big, 15 - 2 * i, 2) for i in range(8)])


def text_of_hex(digits: Column) -> Column:
    """UTF-8 text of the bytes before the first NUL; broken bytes become U+FFFD."""
    before_nul = F.regexp_extract(digits, "^((?:(?!00)[0-9A-Fa-f]{2})*)", 1)
    return F.make_valid_utf8(F.unhex(before_nul).cast("string"))


def words_bytes(*words: Column) -> Column:
    return F.unhex(F.concat(*[word_hex(w) for w in words]))


def words_text(*words: Column) -> Column:
    return text_of_hex(F.concat(*[word_hex(w) for w in words]))


def text_word(text: Column, index: int | Column) -> Column:
    """Word ``index`` (0-based, 8 bytes) of a text, zero filled; inverse of ``words_text``."""
    digits = F.hex(F.encode(text, "UTF-8"))
    at = F.lit(index) * 16 + 1
    part = F.rpad(F.substring(digits, at, F.lit(16)), 16, "0")
    flipped = F.concat(*[F.substring(part, 15 - 2 * i, 2) for i in range(8)])
    # A negative target base makes conv read the 64 bits as signed.
    return F.conv(flipped, 16, -10).cast("long")


# text ------------------------------------------------------------------


def tail_text(text: Column, length: int = fv.PATH_TAIL) -> Column:
    return F.right(text, F.lit(length))


def command16(command: Column) -> Column:
    return F.substring(command, 1, fv.COMMAND_LENGTH)


def hex_text(value: Column) -> Column:
    return F.lower(F.hex(value))


def parse_hex(text: Column) -> Column:
    """Hex digits, with or without 0x, as a LONG bit pattern."""
    digits = F.regexp_replace(F.lower(F.trim(text)), "^0x", "")
    return F.conv(digits, 16, -10).cast("long")


def space_to_underscore(text: Column) -> Column:
    return F.translate(text, " ", "_")


def symbol_of(line: Column) -> Column:
    """Symbol in a debugger thread line: what stands behind the last backtick, up to the offset or else the queue."""
    behind = F.substring_index(line, "`", -1)
    ends = [F.instr(behind, mark) for mark in (fv.OFFSET_MARK, fv.QUEUE_MARK)]
    end = F.when(ends[0] > 1, ends[0]).when(ends[1] > 1, ends[1])
    known = F.contains(line, F.lit("`")) & end.isNotNull()
    return F.when(known, F.trim(F.left(behind, end - 1))).otherwise(fv.NO_SYMBOL)


def trailing_hex(line: Column) -> Column:
    """Value of the ``0x`` number that ends a line, null if there is none."""
    return parse_hex(F.nullif(F.regexp_extract(line, "0x([0-9a-fA-F]+)$", 1), F.lit("")))


def palette(gid: Column) -> Column:
    colours = F.array(*[F.lit(c) for c in fv.PALETTE])
    return F.element_at(colours, (F.pmod(gid, F.lit(len(fv.PALETTE))) + 1).cast("int"))


def duration_label(duration: Column) -> Column:
    return F.format_string("%.4fms", duration.cast("double") / fv.LABEL_DIVISOR)


def arrow_style(lane_from: Column, lane_to: Column, label: Column) -> Column:
    quiet = label.contains("wait") | label.contains("recv")
    return F.when(lane_from != lane_to, "line").when(quiet, "label").otherwise("curve")


def message_arrow(op: Column, delay: Column) -> Column:
    """Arrow of a logged message; a receive has none, a create is never slow."""
    slow = F.when(delay > fv.SLOW_DELAY, fv.SLOW_ARROW).otherwise(fv.NORMAL_ARROW)
    return (
        F.when(op.isin("mach_msg_send", "mach_msg_kernel_request"), slow)
        .when(op == "voucher_create", fv.NORMAL_ARROW)
    )


def gap_label(gap: Column) -> Column:
    return F.when(gap < fv.SHORT_GAP, F.concat(F.lit("||"), gap.cast("string"), F.lit("||"))).otherwise(
        F.concat(F.lit("... "), gap.cast("string"), F.lit("micro seconds later ..."))
    )
