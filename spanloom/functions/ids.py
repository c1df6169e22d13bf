"""Trace and span ids as numbers.

Senders spell one id in several ways (case, ``0x``, dashes, blanks around, leading zeros cut). In
shuffles an id is one or two bigint columns (the bits, two's complement), which costs a quarter of
the text; ``trace_hex`` and ``span_hex`` give the canonical text back.

Defined results: null, blank and ``0x`` alone give null, and so does text that is no hexadecimal
number of at most 128 (trace) or 64 (span) bits.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TRACE_DIGITS, SPAN_DIGITS = 32, 16


#: What is taken out of a spelling, and what must be left behind as many zeros as an id has digits: zeros, then the digits.
_EXTRA = r"^[\s\pZ]*0[xX]|[\s\pZ\-]"
_LEFT = r"^0+([0-9a-fA-F]{%d})$"


def _text(c: Column, width: int) -> Column:
    """``width`` hexadecimal digits of either case, or null. Well-formed text takes the short way, without a pattern."""
    padded = F.concat(F.lit("0" * width), F.regexp_replace(c, _EXTRA, ""))
    mended = F.nullif(F.regexp_extract(padded, _LEFT % width, 1), F.lit(""))
    return F.when((F.length(c) == width) & F.unhex(c).isNotNull(), c).otherwise(mended)


def trace_text(c: Column) -> Column:
    """32 hexadecimal digits of a trace id, of either case; null where it is none."""
    return _text(c, TRACE_DIGITS)


def span_text(c: Column) -> Column:
    """16 hexadecimal digits of a span id, of either case; null where it is none."""
    return _text(c, SPAN_DIGITS)


def _bits(digits: Column) -> Column:
    return F.conv(digits, 16, -10).cast("bigint")


def text_bits(c: Column) -> tuple[Column, Column]:
    """High and low 64 bits of what ``trace_text`` returned."""
    return _bits(F.substring(c, 1, 16)), _bits(F.substring(c, 17, 16))


def trace_bits(c: Column) -> tuple[Column, Column]:
    """High and low 64 bits of a trace id; both null where it is none."""
    return text_bits(trace_text(c))


def span_bits(c: Column) -> Column:
    """The 64 bits of a span id; null where it is none."""
    return _bits(span_text(c))


def parent_bits(c: Column) -> Column:
    """As ``span_bits``; zero also gives null (no parent)."""
    b = span_bits(c)
    return F.when(b != 0, b)


def _hex64(c: Column) -> Column:
    return F.lower(F.lpad(F.hex(c), 16, "0"))


def trace_hex(hi: Column, lo: Column) -> Column:
    """Canonical 32-digit text of a trace id."""
    return F.concat(_hex64(hi), _hex64(lo))


def span_hex(c: Column) -> Column:
    """Canonical 16-digit text of a span id."""
    return _hex64(c)


# The same as SQL text, for queries that are SQL throughout.


def text_sql(c: str, width: int) -> str:
    """``_text`` of the expression ``c``, for SQL that is formatted once more."""
    left = (_LEFT % width).replace("{", "{{").replace("}", "}}")
    mended = f"nullif(regexp_extract(concat('{'0' * width}', regexp_replace({c}, r'{_EXTRA}', '')), r'{left}', 1), '')"
    return f"CASE WHEN length({c}) = {width} AND unhex({c}) IS NOT NULL THEN {c} ELSE {mended} END"


def bits_sql(digits: str) -> str:
    return f"CAST(conv({digits}, 16, -10) AS BIGINT)"


def hex_sql(*words: str) -> str:
    """Canonical text of an id from its 64-bit words."""
    parts = [f"lower(lpad(hex({w}), 16, '0'))" for w in words]
    return f"concat({', '.join(parts)})" if len(parts) > 1 else parts[0]
