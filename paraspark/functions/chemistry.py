"""Formula parsing and chlorinated-paraffin constants."""

from __future__ import annotations

# Fixed values of the method.
CHLORINE_MASS = 35.5
CARBON_MASS = 12
HYDROGEN_MASS = 1
SHORT_CHAINS = (10, 11, 12, 13)
MEDIUM_CHAINS = (14, 15, 16, 17)
SHORT_CLASS = "SCCPs"
MEDIUM_CLASS = "MCCPs"
LONG_CLASS = "LCCPs"

FORMULA_MODES = ("element", "as_coded")


def quoted(text: str) -> str:
    """A SQL string literal."""
    escaped = text.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def mz_key(mz: str) -> str:
    """Nominal m/z of the identity key, rounded half to even."""
    return f"CAST(rint({mz}) AS BIGINT)"


def identity_key(formula: str, mz: str) -> str:
    """``formula-round(mz)``; NULL when either part is missing."""
    return f"concat({formula}, '-', {mz_key(mz)})"


def carbon_count(formula: str) -> str:
    """Carbons at the start of the formula; a label mark (``C'``) is allowed."""
    return f"try_cast(regexp_extract({formula}, '^C\\'?([0-9]+)', 1) AS INT)"


def chlorine_count(formula: str, mode: str = "element") -> str:
    """Chlorines of the formula.

    ``element`` reads the number behind ``Cl`` wherever it stands. ``as_coded``
    takes all text behind the first ``Cl`` as the number, so it only knows
    formulas that end with the chlorine count.
    """
    if mode not in FORMULA_MODES:
        raise ValueError(f"formula mode must be one of {FORMULA_MODES}, got {mode!r}")
    pattern = "Cl([0-9]+)" if mode == "element" else "^(?:(?!Cl).)*Cl([1-9][0-9]*)$"
    return f"try_cast(regexp_extract({formula}, '{pattern}', 1) AS INT)"


def in_domain(chlorines: str, low: int, high: int) -> str:
    """The chlorine count, or NULL outside the evaluated range."""
    return f"CASE WHEN {chlorines} BETWEEN {low} AND {high} THEN {chlorines} END"


def chlorine_percent(carbons: str, chlorines: str) -> str:
    """Theoretical chlorine content (% by mass) of C(n)H(2n+2-m)Cl(m)."""
    chlorine = f"{chlorines} * {CHLORINE_MASS}D"
    hydrogen = f"(2 * {carbons} + 2 - {chlorines}) * {HYDROGEN_MASS}"
    return f"{chlorine} / ({chlorine} + {carbons} * {CARBON_MASS} + {hydrogen}) * 100"


def paraffin_class(carbons: str) -> str:
    """Short, medium or long chain class; every other chain counts as long."""
    return (
        f"CASE WHEN {carbons} IN {SHORT_CHAINS} THEN '{SHORT_CLASS}'"
        f" WHEN {carbons} IN {MEDIUM_CHAINS} THEN '{MEDIUM_CLASS}' ELSE '{LONG_CLASS}' END"
    )


def facet_label(carbons: str) -> str:
    return f"concat('C', {carbons})"
