"""Concentrations per chain and per class, and the report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paraspark.functions import chemistry as chem
from paraspark.functions.numeric import at_least, clamp, ratio, total
from paraspark.operators.joins import aggregate, attach
from paraspark.schema import BATCH, VARIANTS, AssayParams


def quantifiable(summary: DataFrame) -> DataFrame:
    """Everything but calibration samples; rows without a type are dropped."""
    return summary.filter("NOT is_calibration")


def quantify_chains(
    summary: DataFrame,
    chain_calibration: DataFrame,
    params: AssayParams,
    variants: Sequence[str] = VARIANTS,
) -> DataFrame:
    """Response factor at the sample's Cl% and the resulting concentration.

    ``summary`` holds the samples to quantify, without calibration. Cl% is pulled into the calibrated range and the factor is floored. A chain
    without calibration has no factor and no concentration.
    """
    results = attach(summary, chain_calibration, [BATCH, "chain_length"])
    contents, factors, concentrations = [], [], []
    for v in variants:
        content = clamp(f"chain_cl_degree{v}", "min_cl_degree", "max_cl_degree")
        contents.append(f"{content} AS cl_degree_f{v}")
        factors.append(f"{at_least(f'(intercept + slope * cl_degree_f{v})', params.response_floor)} AS rf{v}")
        concentrations.append(f"{ratio(f'chain_total{v}', f'rf{v}')} AS conc{v}")
    return (
        results.selectExpr("*", f"{chem.paraffin_class('chain_length')} AS cp_type", *contents)
        .selectExpr("*", *factors)
        .selectExpr("*", *concentrations)
    )


def with_class_totals(results: DataFrame, variants: Sequence[str] = VARIANTS) -> DataFrame:
    """Each chain row with its class total.

    Rows are at (sample, chain) grain here, so a window group is never larger
    than the number of chains of a class.
    """
    over = f"OVER (PARTITION BY {BATCH}, sample_name, cp_type)"
    return results.selectExpr(
        "*", *[f"coalesce(sum(conc{v}) {over}, 0.0D) AS class_conc{v}" for v in variants]
    )


def class_totals(results: DataFrame, variants: Sequence[str] = VARIANTS) -> DataFrame:
    """One row per (sample, class)."""
    return aggregate(
        results,
        [BATCH, "sample_name", "cp_type"],
        **{f"class_conc{v}": total(f"conc{v}") for v in variants},
    )


def concentration_report(
    results: DataFrame, volume: float, variant: str = "", run_params: DataFrame | None = None
) -> DataFrame:
    """Chain rows and class rows of every sample, scaled to the extract volume.

    The union of both levels is written as two grouping sets, so the results
    feed it once. Class sums treat a missing concentration as 0.
    """
    conc = f"sum(conc{variant})"
    is_class = "grouping(chain_length) = 1"
    keys = [BATCH, "sample_name", "cp_type"]
    rows = results.groupingSets([[*keys, "chain_length"], keys], *keys, "chain_length").agg(
        F.expr(f"CASE WHEN {is_class} THEN cp_type ELSE CAST(chain_length AS STRING) END AS label"),
        F.expr(f"CASE WHEN {is_class} THEN coalesce({conc}, 0.0D) ELSE {conc} END AS conc"),
    )
    scale = f"{float(volume)!r}D"
    if run_params is not None:
        rows = attach(rows, run_params.selectExpr(BATCH, "extract_volume AS run_volume"), [BATCH])
        scale = f"coalesce(run_volume, {scale})"
    return rows.selectExpr(BATCH, "sample_name", "label", f"conc * {scale} AS amount")
