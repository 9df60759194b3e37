"""Blank assignment and subtraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paraspark.functions.numeric import clip_negative
from paraspark.operators.identify import of_type
from paraspark.operators.joins import aggregate, attach
from paraspark.schema import BATCH, BLANK, CALIBRATION, AssayParams


def blank_means(rows: DataFrame) -> DataFrame:
    """Mean ratio per (formula, blank injection); 0 when it has no value.

    Chain and Cl% follow from the formula and change no group. As keys they
    make this branch read the same columns as the rows it is subtracted from,
    so that both share one exchange of the peaks.
    """
    return aggregate(
        of_type(rows, BLANK),
        [BATCH, "molecular_formula", "chain_length", "cl_degree", "sample_name", "blank_label"],
        blank_ratio="coalesce(avg(ratio), 0.0D)",
    )


def blanks_of(blank_injections: DataFrame, injections: DataFrame) -> DataFrame:
    """Blank injections that share their label, also a missing one, with any of the others."""
    used = injections.selectExpr(f"{BATCH} AS __batch", "blank_label AS __label")
    return blank_injections.join(used, F.expr(f"{BATCH} = __batch AND blank_label <=> __label"), "left_semi")


def subtract_blanks(rows: DataFrame, means: DataFrame, params: AssayParams) -> DataFrame:
    """Ratio minus the assigned blank's mean, not below zero.

    Labels match null-safely: rows and blanks without a label belong together.
    Calibration rows are not subtracted, only clipped. Without a blank value
    the result is NULL; ``passthrough`` keeps the ratio of samples that have no
    blank assigned. Rows without a sample type have no result.
    """
    joined = attach(
        rows,
        means.select(BATCH, "molecular_formula", "blank_label", "blank_ratio"),
        [BATCH, "molecular_formula", "blank_label"],
        null_safe=["blank_label"],
    )
    kept = f"sample_type = '{CALIBRATION}'"
    if params.unassigned_blank == "passthrough":
        kept += " OR (sample_type IS NOT NULL AND blank_label IS NULL)"
    net = f"CASE WHEN {kept} THEN ratio WHEN sample_type IS NOT NULL THEN ratio - blank_ratio END"
    return joined.selectExpr("* EXCEPT (blank_ratio)", f"{net} AS net").selectExpr(
        "* EXCEPT (net)", f"{clip_negative('net')} AS ratio_bs"
    )
