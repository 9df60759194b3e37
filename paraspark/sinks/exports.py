"""Writers for the exports and reports.

Wide exports are written for any number of batches and samples as numbered
sheets next to their layout table; only batches and sample types that have
rows get a folder. ``named_*`` writes the sheets of one batch with sample names
as columns. Every variant has its own folder, so none replaces another. Missing
values are empty cells in CSV and NULL in Parquet.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paraspark.operators import identify, wide
from paraspark.plans.assay import Assay
from paraspark.plans.stage import stage_assay
from paraspark.schema import BATCH, EXPORT_KEYS, SAMPLE_TYPES

FORMATS = ("parquet", "csv")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    """Write one table; refuses to replace an existing one."""
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}, got {fmt!r}")
    writer = df.write.mode("error").partitionBy(*partition_by)
    if fmt == "csv":
        writer.option("header", True).option("nullValue", "").csv(path)
    else:
        writer.parquet(path)


def _suffix(bs: bool) -> str:
    return "subtracted" if bs else "not_subtracted"


def export_long(assay: Assay, folder: str, fmt: str = "parquet") -> None:
    """The homologue table in long form, by batch and sample type."""
    write_table(assay.homologues, f"{folder}/homologues", fmt, [BATCH, "sample_type"])


def export_raw(assay: Assay, folder: str, fmt: str = "parquet") -> None:
    """Peak areas, one sheet row per ion, by batch and sample type."""
    write_table(assay.raw_export(), f"{folder}/raw", fmt, [BATCH, "sample_type"])
    write_table(assay.type_layout, f"{folder}/raw_layout", fmt)


def export_normalized(assay: Assay, folder: str, bs: bool = True, fmt: str = "parquet") -> None:
    """Ratios to the standard, with or without blank subtraction."""
    name = f"{folder}/normalized_{_suffix(bs)}"
    write_table(assay.normalized_export(bs), name, fmt, [BATCH, "sample_type"])
    write_table(assay.type_layout, f"{name}_layout", fmt)


def export_concentrations(assay: Assay, folder: str, bs: bool = True, fmt: str = "parquet") -> None:
    """Concentration report per chain and class."""
    name = f"{folder}/concentrations_{_suffix(bs)}"
    write_table(assay.report_wide(bs), name, fmt, [BATCH])
    write_table(assay.report_layout, f"{name}_layout", fmt)


def export_calibration(assay: Assay, folder: str, fmt: str = "parquet") -> None:
    """Calibration panels, one folder per chain."""
    write_table(assay.calibration_report(), f"{folder}/calibration_report", fmt, ["chain_length"])


def named_report(assay: Assay, batch_id: int, names: Sequence[str], bs: bool = True) -> DataFrame:
    """Concentration report of one batch with the given sample names as columns."""
    rows = assay.report(bs).filter(F.col(BATCH) == batch_id)
    return wide.to_named_sheet(rows, ["label"], "amount", names).orderBy("label")


def named_export(
    assay: Assay, batch_id: int, sample_type: str, names: Sequence[str], value: str = "peak_area"
) -> DataFrame:
    """Sheet of the named samples of one batch and type: ``peak_area``, ``ratio`` or ``ratio_bs``."""
    rows = assay.typed_rows if value == "peak_area" else assay.variant_rows(value == "ratio_bs")
    rows = identify.of_type(rows.filter(F.col(BATCH) == batch_id), sample_type)
    return wide.to_named_sheet(rows, list(EXPORT_KEYS), value, names).orderBy("row_identity")


def named_exports(
    assay: Assay,
    batch_id: int,
    names: Mapping[str, Sequence[str]],
    folder: str,
    value: str = "peak_area",
    fmt: str = "csv",
) -> list[str]:
    """Write a sheet of one batch for each sample type in ``names`` that has rows; returns those types."""
    present = assay.sample_types_present().filter(F.col(BATCH) == batch_id).first()
    written = [t for t in SAMPLE_TYPES if names.get(t) and present is not None and present[f"has_{t.lower()}"]]
    for sample_type in written:
        sheet = named_export(assay, batch_id, sample_type, names[sample_type], value)
        write_table(sheet, f"{folder}/{value}/{sample_type}", fmt)
    return written


def export_all(assay: Assay, folder: str, fmt: str = "parquet", stage: str | None = None) -> None:
    """Every export and report of an assay, each in its own folder.

    All read one stage, by default a folder beside them; the peak source is read once, to write
    it. A run after a lost one goes on with the stage if that was finished; outputs
    that exist are not replaced.
    """
    assay = stage_assay(assay, stage or f"{folder.rstrip('/')}/stage")
    export_raw(assay, folder, fmt)
    for bs in (True, False):
        export_normalized(assay, folder, bs, fmt)
        export_concentrations(assay, folder, bs, fmt)
    export_calibration(assay, folder, fmt)
