"""Wide layouts: one column per sample.

A wide sheet can only hold so many columns. For any number of samples the
engine writes numbered sheets of fixed width; a layout table names the sample
behind each (sheet, slot). Samples that the caller names can also be laid out on
a single sheet with their names as column names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paraspark.functions.chemistry import quoted
from paraspark.operators.joins import aggregate, attach
from paraspark.schema import BATCH

SHEET_WIDTH = 24
# A sheet's slots are checked with one bit each of a long.
MAX_SHEET_WIDTH = 63
# Characters that tell runs of names apart.
RUN_CHARS = 2


def slot_names(width: int = SHEET_WIDTH) -> list[str]:
    return [f"s{i:02d}" for i in range(width)]


def sheet_layout(samples: DataFrame, group: Sequence[str], width: int = SHEET_WIDTH) -> DataFrame:
    """Give every sample of a group its sheet and slot, in name order.

    Names are numbered within runs and shifted by the sizes of the group's earlier runs, so no group
    is sorted in one task. A run is the names that agree in the ``RUN_CHARS`` characters behind
    the beginning which all names of their group share: runs stand in name order, whatever the
    names, and an aggregate of the group's first and last name finds that beginning.
    """
    if not 1 <= width <= MAX_SHEET_WIDTH:
        raise ValueError(f"sheet width must lie in 1..{MAX_SHEET_WIDTH}")
    order, group = [*group, "sample_name"], list(group)
    names = samples.select(*order).distinct()
    shared = (
        "size(filter(sequence(0, least(length(low), length(high))),"
        " i -> i > 0 AND substring(low, 1, i) = substring(high, 1, i)))"
    )
    ends = aggregate(samples, group, low="min(sample_name)", high="max(sample_name)").selectExpr(
        *group, f"{shared} AS shared"
    )
    placed = attach(names, ends, group, null_safe=group).selectExpr(
        *order, f"substring(sample_name, shared + 1, {RUN_CHARS}) AS run"
    )
    runs = [*group, "run"]
    keys = ", ".join(runs)
    numbered = placed.selectExpr("*", f"row_number() OVER (PARTITION BY {keys} ORDER BY sample_name) - 1 AS place")
    starts = aggregate(placed, runs, n="count(*)").selectExpr(
        *runs,
        f"coalesce(sum(n) OVER (PARTITION BY {', '.join(group)} ORDER BY run"
        " ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start",
    )
    return attach(numbered, starts, runs, null_safe=runs).selectExpr(
        *order,
        f"CAST((start + place) DIV {width} AS INT) AS sheet",
        f"CAST((start + place) % {width} AS INT) AS slot",
    )


def _single(condition: str, value: str, what: str) -> str:
    message = quoted(f"several values of {what} for one sample and row; see duplicate_keys")
    return f"CASE WHEN {condition} THEN raise_error({message}) ELSE {value} END"


def to_sheets(rows: DataFrame, keys: Sequence[str], value: str, width: int = SHEET_WIDTH) -> DataFrame:
    """Long to wide on the ``sheet`` and ``slot`` of each row, in one aggregation.

    A wide row takes at most one value per slot, so combining on the map side
    would only blow every value up to a row of empty slots: the narrow rows are
    shuffled to their wide row instead. Two values for one cell stop the job:
    the number of values of a wide row must equal the number of its slots.
    """
    columns = slot_names(width)
    target = [*keys, "sheet"]
    wide = aggregate(
        rows.select(*target, "slot", value).repartition(*target),
        target,
        cells="count(*)",
        slots="bit_count(bit_or(shiftleft(1L, slot)))",
        **{name: f"max({value}) FILTER (WHERE slot = {i})" for i, name in enumerate(columns)},
    )
    sheet = _single("cells > coalesce(slots, 0)", "sheet", value)
    return wide.selectExpr(*keys, f"CAST({sheet} AS INT) AS sheet", *columns)


def with_positions(sheets: DataFrame, group: Sequence[str], order: Sequence[str], run: Sequence[str]) -> DataFrame:
    """Each row's place, from 1, in the order its group is written in.

    A run, the first columns of the order, is a sheet: as many rows as the mass list has
    targets. Rows are numbered within their run and shifted by the sizes of the group's earlier ones.
    """
    keys, within = ", ".join([*group, *run]), ", ".join(c for c in order if c not in (*group, *run))
    numbered = sheets.selectExpr("*", f"row_number() OVER (PARTITION BY {keys} ORDER BY {within}) AS nth")
    starts = aggregate(sheets, [*group, *run], n="count(*)").selectExpr(
        *group,
        *run,
        f"coalesce(sum(n) OVER (PARTITION BY {', '.join(group)} ORDER BY {', '.join(run)}"
        " ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start",
    )
    joined = attach(numbered, starts, [*group, *run])
    return joined.selectExpr("* EXCEPT (nth, start)", "start + nth AS position")


def to_named_sheet(rows: DataFrame, keys: Sequence[str], value: str, names: Sequence[str]) -> DataFrame:
    """Long to wide with the given sample names as columns, for the samples of one batch."""
    chosen = rows.filter(F.col("sample_name").isin(*names))
    once = aggregate(chosen, [*keys, "sample_name"], cell=f"max({value})", cells="count(*)")
    checked = once.selectExpr(*keys, "sample_name", f"{_single('cells > 1', 'cell', value)} AS cell")
    return checked.groupBy(*keys).pivot("sample_name", list(names)).agg(F.first("cell"))


def sheet_names(layout: DataFrame, batch_id: int, sheet: int = 0, sample_type: str | None = None) -> list[str]:
    """Sample names of one sheet in column order: as many as a sheet is wide at most."""
    chosen = layout.filter((F.col(BATCH) == batch_id) & (F.col("sheet") == sheet))
    if sample_type is not None:
        chosen = chosen.filter(F.col("sample_type") == sample_type)
    return [r["sample_name"] for r in chosen.select("sample_name", "slot").orderBy("slot").collect()]
