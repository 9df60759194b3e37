"""Registered queries over the test tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from paraspark.operators import quantify, views
from paraspark.operators.identify import IDENTIFIED_COLUMNS
from paraspark.operators.wide import with_positions
from paraspark.plans.assay import EXPORT_ORDER, REPORT_ORDER, Assay
from paraspark.plans.stage import stage_assay
from paraspark.schema import BATCH, INPUT_TABLES, AssayParams
from paraspark.session import shared_folder
from paraspark.sources import readers
from paraspark.sources.driver_tables import assay_tables

DIGITS = 6
ROW_KEYS = (BATCH, "sample_name", "sample_type", "row_identity", "molecular_formula", "chain_length", "cl_no")


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles rounded for comparison, as the order of summation is not fixed.

    The inner rounding removes the noise of the last bits, so that exact
    decimals ending in 5 are rounded alike by any engine.
    """
    return df.selectExpr(
        *[
            f"round(round({f.name}, {digits + 3}), {digits}) AS {f.name}" if f.dataType == T.DoubleType() else f.name
            for f in df.schema
        ]
    )


def _chain(assay: Assay, bs: bool) -> DataFrame:
    v = "_bs" if bs else ""
    return assay.results(bs).select(
        BATCH,
        "sample_name",
        "sample_type",
        "chain_length",
        "cp_type",
        f"cl_degree_f{v}",
        f"rf{v}",
        f"conc{v}",
    )


def _class(assay: Assay, bs: bool) -> DataFrame:
    v = "_bs" if bs else ""
    return quantify.class_totals(assay.results(bs), [v])


def _chain_measure(assay: Assay, bs: bool, measure: str) -> DataFrame:
    v = "_bs" if bs else ""
    return assay.summary(bs).select(BATCH, "sample_name", "sample_type", "chain_length", f"{measure}{v}")


def _shares(assay: Assay, bs: bool) -> DataFrame:
    v = "_bs" if bs else ""
    return assay.distribution(bs).select(
        *ROW_KEYS, f"ratio{v}", f"chain_total{v}", f"share_pct{v}", "cl_degree", f"chain_cl_degree{v}"
    )


def _subtracted(assay: Assay) -> DataFrame:
    return assay.subtracted.select(*ROW_KEYS, "ratio", "ratio_bs")


HOMOLOGUE_COLUMNS = (
    BATCH, "sample_name", "sample_type", "row_identity", "molecular_formula", "mz", "retention_time",
    "chain_length", "cl_no", "peak_area", "istd_area", "ratio", "ratio_bs", "chain_total", "chain_total_bs",
    "share_pct", "share_pct_bs", "cl_degree", "chain_cl_degree", "chain_cl_degree_bs",
)

# Fixed value: the chains of the usual calibration report.
REPORT_CHAINS = range(10, 18)
NAMED = ("S1", "S7", "S8")
PASSTHROUGH = AssayParams(unassigned_blank="passthrough")

_ON_ASSAY: dict[str, Callable[[Assay], DataFrame]] = {
    "identified_peaks": lambda a: a.rows.select(*IDENTIFIED_COLUMNS),
    "normalized_ratio": lambda a: a.rows.select(*ROW_KEYS, "peak_area", "istd_area", "ratio"),
    "istd_control_limits": lambda a: a.istd_limits,
    "istd_control_chart": lambda a: a.istd_chart(),
    "blank_means": lambda a: a.blank_means.select(
        BATCH, "molecular_formula", "sample_name", "blank_label", "blank_ratio"
    ),
    "blank_subtracted": _subtracted,
    "homologues": lambda a: a.homologues.select(*HOMOLOGUE_COLUMNS),
    "chain_totals": lambda a: _chain_measure(a, False, "chain_total"),
    "chain_totals_bs": lambda a: _chain_measure(a, True, "chain_total"),
    "relative_distribution": lambda a: _shares(a, False),
    "relative_distribution_bs": lambda a: _shares(a, True),
    "cl_degree": lambda a: _chain_measure(a, False, "chain_cl_degree"),
    "cl_degree_bs": lambda a: _chain_measure(a, True, "chain_cl_degree"),
    "calibration_points": lambda a: a.calibration_points,
    "response_fit": lambda a: a.mixture_fits.select(BATCH, "calibration_type", "chain_length", "slope", "r_squared"),
    "response_vs_level": lambda a: a.response_vs_level(),
    "mixture_points": lambda a: a.mixture_fits,
    "factor_vs_content": lambda a: a.factor_vs_content(),
    "chain_calibration": lambda a: a.chain_calibration,
    "calibration_report": lambda a: a.calibration_report(REPORT_CHAINS),
    "calibration_report_all": lambda a: a.calibration_report(),
    "calibration_page": lambda a: a.calibration_report([12]),
    "concentration_chain": lambda a: _chain(a, False),
    "concentration_chain_bs": lambda a: _chain(a, True),
    "concentration_class": lambda a: _class(a, False),
    "concentration_class_bs": lambda a: _class(a, True),
    "class_windows": lambda a: quantify.with_class_totals(a.results(True)).select(
        BATCH, "sample_name", "chain_length", "cp_type", "conc", "conc_bs", "class_conc", "class_conc_bs"
    ),
    "concentration_report": lambda a: a.report(False),
    "concentration_report_bs": lambda a: a.report(True),
    "concentration_report_wide": lambda a: a.report_wide(False),
    "concentration_report_wide_bs": lambda a: a.report_wide(True),
    "raw_export_wide": lambda a: a.raw_export(),
    "raw_export_ordered": lambda a: with_positions(
        a.raw_export(), [BATCH], EXPORT_ORDER, ["sample_type", "sheet"]
    ),
    "concentration_report_ordered": lambda a: with_positions(a.report_wide(False), [BATCH], REPORT_ORDER, ["sheet"]),
    "normalized_export_wide": lambda a: a.normalized_export(False),
    "normalized_export_wide_bs": lambda a: a.normalized_export(True),
    "sheet_layout": lambda a: a.type_layout,
    "export_preview": lambda a: views.preview(
        a.raw_export().filter("sample_type = 'Sample' AND sheet = 0"),
        [BATCH, "row_identity"],
        columns=12,
    ),
    "report_preview": lambda a: views.preview(a.report_wide(True), [], rows=None, columns=7),
    "profile_relative": lambda a: a.profile_relative(False),
    "profile_relative_bs": lambda a: a.profile_relative(True),
    "profile_absolute": lambda a: a.profile_absolute(False),
    "profile_absolute_bs": lambda a: a.profile_absolute(True),
    "profile_named": lambda a: a.profile_relative(False, NAMED),
    "profile_named_bs": lambda a: a.profile_relative(True, NAMED),
    "profile_absolute_named": lambda a: a.profile_absolute(False, NAMED),
    "sample_list": lambda a: a.sample_list(),
    "class_bars": lambda a: a.class_bars(False),
    "class_bars_bs": lambda a: a.class_bars(True),
    "chain_bars": lambda a: a.chain_bars(False),
    "chain_bars_bs": lambda a: a.chain_bars(True),
    "mixture_table": lambda a: a.tables.calibration,
    "sample_types_present": lambda a: a.sample_types_present(),
    "qc_key_summary": lambda a: a.key_summary(),
    "qc_unmatched_peaks": lambda a: a.unmatched_peaks(),
}
# On the tables that hold what a clean run does not.
_ON_IRREGULAR: dict[str, Callable[[Assay], DataFrame]] = {
    "qc_duplicate_keys": lambda a: a.duplicate_keys(),
    "qc_istd_missing": lambda a: a.istd_missing(),
    "irregular_key_summary": lambda a: a.key_summary(),
    "irregular_peaks": lambda a: a.rows.select(*IDENTIFIED_COLUMNS),
    "irregular_homologues": lambda a: a.homologues.select(*HOMOLOGUE_COLUMNS),
    "irregular_calibration_points": lambda a: a.calibration_points,
    "irregular_chain_calibration": lambda a: a.chain_calibration,
    "irregular_concentrations": lambda a: a.results(True).select(
        BATCH, "sample_name", "sample_type", "chain_length", "cp_type", "cl_degree_f", "rf", "conc",
        "cl_degree_f_bs", "rf_bs", "conc_bs",
    ),
    "irregular_report": lambda a: a.report(False),
    "irregular_report_bs": lambda a: a.report(True),
}
# On a stage that is written first.
_ON_STAGE: dict[str, Callable[[Assay], DataFrame]] = {
    "staged_raw_export_wide": lambda a: a.raw_export(),
    "staged_normalized_export_wide_bs": lambda a: a.normalized_export(True),
    "staged_homologues": lambda a: a.homologues.select(*HOMOLOGUE_COLUMNS),
    "staged_calibration_report": lambda a: a.calibration_report(REPORT_CHAINS),
    "staged_concentration_report": lambda a: a.report(False),
    "staged_concentration_report_bs": lambda a: a.report(True),
    "staged_chain_bars_bs": lambda a: a.chain_bars(True),
}
_ON_PASSTHROUGH: dict[str, Callable[[Assay], DataFrame]] = {
    "blank_subtracted_passthrough": _subtracted,
    "concentration_report_bs_passthrough": lambda a: a.report(True),
}


def _query(
    build: Callable[[Assay], DataFrame], params: AssayParams | None = None, irregular: bool = False
) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(build(Assay(assay_tables(spark, sf_dir, irregular), params)))

    return run


def _folder(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/{what}/{uuid.uuid4().hex}"


def _staged(build: Callable[[Assay], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(build(stage_assay(Assay(assay_tables(spark, sf_dir)), _folder(spark, "assay-stages"))))

    return run


def csv_copy(spark: SparkSession, sf_dir: str, irregular: bool = False) -> str:
    """The assay tables written as CSV files; returns their folder."""
    tables, folder = assay_tables(spark, sf_dir, irregular), _folder(spark, "assay-csv")
    for name in INPUT_TABLES:
        getattr(tables, name).write.option("header", True).csv(f"{folder}/{name}")
    return folder


def _from_csv(build: Callable[[Assay], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(build(Assay(readers.read_assay(spark, csv_copy(spark, sf_dir)))))

    return run


def _bad_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = readers.bad_cells(spark, csv_copy(spark, sf_dir, irregular=True))
    return found.groupBy("table_name", "column_name", "value").count().withColumnRenamed("count", "cells")


def _shared_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = assay_tables(spark, sf_dir)
    targets = tables.mass_list.filter(f"{BATCH} = 1").drop(BATCH)
    return rounded(Assay(replace(tables, mass_list=targets)).report(False))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: _query(build) for name, build in _ON_ASSAY.items()}
    found |= {name: _query(build, PASSTHROUGH) for name, build in _ON_PASSTHROUGH.items()}
    found |= {name: _query(build, irregular=True) for name, build in _ON_IRREGULAR.items()}
    found |= {name: _staged(build) for name, build in _ON_STAGE.items()}
    return found | {
        "csv_concentration_report": _from_csv(lambda a: a.report(False)),
        "csv_identified_peaks": _from_csv(lambda a: a.rows.select(*IDENTIFIED_COLUMNS)),
        "qc_bad_cells": _bad_cells,
        "shared_list_report": _shared_list,
    }
