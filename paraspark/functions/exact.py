"""Sums of doubles that are the same in any order.

Floating-point addition depends on its order, so two samples with equal peaks could get totals that
differ in their last bits, and ``distinct`` would keep both. Here each double is
cut into whole numbers of 32 bits, limbs, on a fixed grid; limbs are added up as integers,
which is exact and combines on the map side like any sum, and only the total becomes
a double again. Equal inputs give equal totals, different totals stay apart.
"""

from __future__ import annotations

from dataclasses import dataclass

BITS = 32
_BASE = f"{float(1 << BITS)!r}D"


@dataclass(frozen=True)
class Grid:
    """``limbs`` whole numbers of 32 bits above two to the power of ``low``.

    Values are rounded to that power, once each. Numbers from ``bound`` on do not fit and are added as
    ordinary doubles. A limb holds the sum of two billion values.
    """

    low: int
    limbs: int

    @property
    def bound(self) -> float:
        return 2.0 ** (self.low + BITS * self.limbs - 1)

    def scaled(self, x: str, limb: int) -> str:
        return f"rint({x} * {2.0 ** -(self.low + BITS * limb)!r}D)"

    def limb(self, x: str, limb: int) -> str:
        """What limb ``limb`` holds of ``x``: scaling, rounding and the difference are exact."""
        if limb == self.limbs - 1:
            return f"CAST({self.scaled(x, limb)} AS BIGINT)"
        return f"CAST({self.scaled(x, limb)} - {self.scaled(x, limb + 1)} * {_BASE} AS BIGINT)"


#: Peak areas: down to 5e-20, up to 4e28.
AREAS = Grid(-64, 5)
#: Ratios of areas: down to 7e-49, up to 2e38.
RATIOS = Grid(-160, 9)


def exact_sum(x: str, grid: Grid, where: str = "true") -> str:
    """Aggregate SQL: the sum of a double expression, NULL when there is nothing to add.

    Carries between limbs make their digits unique for a value; digits are put together from the
    highest down, so the result depends on the exact total alone.
    """
    fits = f"({where}) AND abs({x}) < {grid.bound!r}D"
    sums = [f"sum({grid.limb(x, k)}) FILTER (WHERE {fits})" for k in range(grid.limbs)]
    held = "l + c.up"
    carried = (
        f"aggregate(array({', '.join(sums)}), named_struct('up', 0L, 'digits', CAST(array() AS ARRAY<BIGINT>)),"
        f" (c, l) -> named_struct('up', ({held} - pmod({held}, {1 << BITS}L)) DIV {1 << BITS}L,"
        f" 'digits', concat(array(pmod({held}, {1 << BITS}L)), c.digits)),"
        f" c -> aggregate(c.digits, CAST(c.up AS DOUBLE), (s, d) -> s * {_BASE} + d) * {2.0 ** grid.low!r}D)"
    )
    beyond = f"sum({x}) FILTER (WHERE ({where}) AND abs({x}) >= {grid.bound!r}D)"
    present = f"count({x}) FILTER (WHERE {where}) > 0"
    return f"CASE WHEN {present} THEN coalesce({carried}, 0.0D) + coalesce({beyond}, 0.0D) END"
