"""Event time of a span in microseconds, whatever unit its sender used."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: True instants lie in 2024 to 2027; bounds in seconds since 1970, the end excluded.
FIRST_S, END_S = 1_704_067_200, 1_830_297_600
PERIOD_US = 15 * 60 * 1_000_000
CUTOFF_US = 60 * 60 * 1_000_000
#: Units per second of s, ms, us and ns. The ranges of a four-year window never overlap.
UNITS_PER_S = (1, 1_000, 1_000_000, 1_000_000_000)


def event_us(c: Column) -> Column:
    """Microseconds since 1970, by the one unit that puts the instant into 2024 to 2027.

    Null, zero and negative values, and values that no unit puts there, give null."""
    out = None
    for u in UNITS_PER_S:
        inside = (c >= F.lit(FIRST_S * u)) & (c < F.lit(END_S * u))
        # whole division: a quotient in doubles would lose digits beyond 2**53
        us = c * F.lit(1_000_000 // u) if u <= 1_000_000 else F.call_function("div", c, F.lit(u // 1_000_000))
        out = F.when(inside, us) if out is None else out.when(inside, us)
    return out


def event_us_sql(c: str) -> str:
    """``event_us`` of the expression ``c`` as SQL text."""
    whens = []
    for u in UNITS_PER_S:
        us = f"{c} * {1_000_000 // u}L" if u <= 1_000_000 else f"{c} div {u // 1_000_000}L"
        whens.append(f"WHEN {c} >= {FIRST_S * u}L AND {c} < {END_S * u}L THEN {us}")
    return f"CASE {' '.join(whens)} END"


def period_start(us: Column, width: int = PERIOD_US) -> Column:
    """Start of the period that holds an instant (both in microseconds)."""
    return us - F.pmod(us, F.lit(width))
