"""Table schemas and run parameters.

``batch_id`` is the outermost key everywhere: one batch is one analytical run,
and any number of batches goes through one job.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

BATCH = "batch_id"

# Sample types and the row identity of the internal standard.
SAMPLE = "Sample"
BLANK = "Blank"
QC = "QC"
CALIBRATION = "Calibration"
SAMPLE_TYPES = (BLANK, SAMPLE, CALIBRATION, QC)
ISTD_IDENTITY = "000_ISTD"
ISTD_LABEL = "ISTD"


def _table(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    columns = [T.StructField(BATCH, T.IntegerType(), False)]
    columns += [T.StructField(name, kind, nullable) for name, kind, nullable in fields]
    return T.StructType(columns)


PEAKS = _table(
    ("replicate", T.StringType(), False),
    ("formula", T.StringType(), False),
    ("mz", T.DoubleType(), True),
    ("area_raw", T.StringType(), True),
)
SEQUENCE = _table(
    ("replicate", T.StringType(), False),
    ("sample_name", T.StringType(), False),
    ("sample_type", T.StringType(), True),
)
MASS_LIST = _table(
    ("molecular_formula", T.StringType(), False),
    ("mz", T.DoubleType(), True),
    ("adduct", T.StringType(), True),
    ("retention_time", T.DoubleType(), True),
    ("row_identity", T.StringType(), False),
)
CALIBRATION_MIXTURES = _table(
    ("sample_name", T.StringType(), False),
    ("calibration_type", T.StringType(), False),
    ("calibration_level", T.DoubleType(), False),
    ("chain_length_info", T.StringType(), True),
)
BLANK_MAP = _table(
    ("sample_name", T.StringType(), False),
    ("blank_sample", T.StringType(), True),
)
RUN_PARAMS = _table(
    ("istd_formula", T.StringType(), False),
    ("extract_volume", T.DoubleType(), False),
)

INPUT_TABLES = {
    "peaks": PEAKS,
    "sequence": SEQUENCE,
    "mass_list": MASS_LIST,
    "calibration": CALIBRATION_MIXTURES,
    "blank_map": BLANK_MAP,
}

# Long-form column sets, by name; both variants carry the suffix where one applies.
ION_KEYS = ("mz", "retention_time", "row_identity", "molecular_formula")
EXPORT_KEYS = (*ION_KEYS, "sample_type", "chain_length", "cl_no")
VARIANTS = ("", "_bs")


@dataclass(frozen=True)
class AssayParams:
    """Settings of a run. ``run_params`` of :class:`AssayTables` overrides the
    standard's formula and the volume per batch."""

    istd_formula: str = "C'10Cl6H16"
    extract_volume: float = 100.0
    cl_min: int = 4
    cl_max: int = 12
    formula_mode: str = "element"
    unassigned_blank: str = "null"
    response_floor: float = 1.0

    def __post_init__(self) -> None:
        if self.unassigned_blank not in ("null", "passthrough"):
            raise ValueError("unassigned_blank must be 'null' or 'passthrough'")
        if self.cl_min > self.cl_max:
            raise ValueError("cl_min must not exceed cl_max")


@dataclass(frozen=True)
class AssayTables:
    """The input tables of an assay."""

    peaks: DataFrame
    sequence: DataFrame
    mass_list: DataFrame
    calibration: DataFrame
    blank_map: DataFrame
    run_params: DataFrame | None = None
