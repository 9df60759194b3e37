"""Null-safe numeric expressions.

The engine keeps one missing value, NULL: source numbers pass ``number`` or
``finite`` and every division is ``ratio``, so neither NaN nor an infinity reaches an aggregate.
"""

from __future__ import annotations


# Plain decimal notation; Spark's cast would also take suffixes and names such as 12.5d and Infinity.
NUMBER = "^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def finite(x: str) -> str:
    """A double with NaN and infinities turned into NULL."""
    return f"CASE WHEN abs({x}) < double('Infinity') THEN {x} END"


def number(text: str) -> str:
    """Text to double; ``#N/A``, values out of range and any other text that is no number give NULL."""
    value = f"try_cast({text} AS DOUBLE)"
    return f"CASE WHEN trim({text}) RLIKE '{NUMBER}' AND abs({value}) < double('Infinity') THEN {value} END"


def ratio(numerator: str, denominator: str) -> str:
    """Division whose result is NULL when the denominator is zero or NULL."""
    return f"try_divide({numerator}, {denominator})"


def total(x: str, over: str = "") -> str:
    """Sum, grouped or over a window, that is 0 when there is nothing to add."""
    return f"coalesce(sum({x}) {over}, 0.0D)"


def clip_negative(x: str) -> str:
    """Values not above zero become 0; NULL stays NULL."""
    return f"CASE WHEN {x} > 0 THEN {x} WHEN {x} IS NOT NULL THEN 0.0D END"


def clamp(x: str, low: str, high: str) -> str:
    """``x`` pulled into [low, high]; NULL when any of the three is NULL.

    ``least`` and ``greatest`` skip NULL, hence the guard.
    """
    known = f"{x} IS NOT NULL AND {low} IS NOT NULL AND {high} IS NOT NULL"
    return f"CASE WHEN {known} THEN least(greatest({x}, {low}), {high}) END"


def at_least(x: str, bound: float) -> str:
    """``x`` raised to ``bound`` where it is lower; NULL stays NULL."""
    return f"CASE WHEN {x} < {bound} THEN {float(bound)!r}D ELSE {x} END"
