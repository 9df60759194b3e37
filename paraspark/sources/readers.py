"""Readers for the peak report and the metadata tables (CSV or Parquet).

Columns are cast to fixed schemas; Parquet files say their own types, CSV is read as
text. Columns are found by name, in the
vendor's spelling ("Product Mz"), its mangled form ("Product.Mz") or ours.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paraspark import schema as S
from paraspark.functions.numeric import number

# Input column names, without case and punctuation, and ours.
HEADER_NAMES = {
    "precursorneutralformula": "formula",
    "productmz": "mz",
    "area": "area_raw",
    "arearaw": "area_raw",
    "adduct": "adduct",
    "molecularformula": "molecular_formula",
    "retentiontime": "retention_time",
    "rowidentity": "row_identity",
    "samplename": "sample_name",
    "sampletype": "sample_type",
    "calibrationtype": "calibration_type",
    "calibrationlevel": "calibration_level",
    "chainlengthinfo": "chain_length_info",
    "blanksample": "blank_sample",
    "istdformula": "istd_formula",
    "extractvolume": "extract_volume",
    "batchid": S.BATCH,
}


_CORRUPT = "__corrupt_line"


def column_name(header: str) -> str:
    """Our name of an input column."""
    bare = re.sub(r"[^a-z0-9]", "", header.lower())
    return HEADER_NAMES.get(bare, bare)


def _csv(spark: SparkSession, paths: Sequence[str], corrupt: str | None = None) -> DataFrame:
    """CSV files as text; ``corrupt`` names a column for lines with another number of cells."""
    plain = spark.read.option("header", True).csv(paths)
    text = T.StructType([T.StructField(c, T.StringType()) for c in plain.columns])
    # Headers are checked against the first file's, so a file with another
    # column order fails instead of being read under wrong names.
    reader = spark.read.option("header", True).option("enforceSchema", False)
    if corrupt is not None:
        text.add(corrupt, T.StringType())
        reader = reader.option("columnNameOfCorruptRecord", corrupt)
    return reader.schema(text).csv(paths)


def _found(raw: DataFrame) -> dict[str, str]:
    """{our name: the input's} of all columns."""
    found: dict[str, str] = {}
    for c in raw.columns:
        name = column_name(c)
        if name in found:
            raise ValueError(f"columns {found[name]!r} and {c!r} both stand for {name!r}")
        found[name] = c
    return found


def bad_cells(spark: SparkSession, folder: str, tables: Sequence[str] = tuple(S.INPUT_TABLES)) -> DataFrame:
    """What the CSV tables under ``folder`` hold that the readers turn into NULL.

    One row for each cell that is no value of its column, with file, column, text and the whole line,
    and one without column for each line with too many or too few cells. An empty cell is
    bad only where a value is needed; ``#N/A`` is a known way to write a missing area.
    """
    parts = []
    for name in tables:
        raw = _csv(spark, [f"{folder.rstrip('/')}/{name}"], _CORRUPT)
        found = _found(raw.drop(_CORRUPT))
        cells = [F.struct(F.lit(None).cast("string").alias("column_name"), F.col(_CORRUPT).alias("value"), F.col(_CORRUPT).isNotNull().alias("bad"))]
        for field in S.INPUT_TABLES[name].fields:
            if field.name not in found:
                continue
            text = F.col(f"`{found[field.name]}`")
            if field.name == "area_raw":
                known = text.isNull() | (text == "#N/A") | F.expr(number(f"`{found[field.name]}`")).isNotNull()
            elif field.dataType == T.DoubleType():
                known = F.expr(number(f"`{found[field.name]}`")).isNotNull()
            else:
                known = text.try_cast(field.dataType).isNotNull()
            if field.nullable:
                known |= text.isNull()
            # A line of the wrong length is reported as such, not cell by cell.
            bad = ~known & F.col(_CORRUPT).isNull()
            cells.append(F.struct(F.lit(field.name).alias("column_name"), text.alias("value"), bad.alias("bad")))
        line = F.concat_ws(",", *[F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in found.values()])
        parts.append(
            raw.select(
                F.lit(name).alias("table_name"),
                F.col("_metadata.file_name").alias("file_name"),
                F.coalesce(F.col(_CORRUPT), line).alias("line"),
                F.explode(F.filter(F.array(*cells), lambda c: c["bad"])).alias("cell"),
            ).select("table_name", "file_name", "line", "cell.column_name", "cell.value")
        )
    return reduce(DataFrame.unionByName, parts)


def _read(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType,
    fmt: str,
    batch_id: int | str | None,
) -> DataFrame:
    paths = [path] if isinstance(path, str) else list(path)
    if fmt == "csv":
        raw = _csv(spark, paths)
    elif fmt == "parquet":
        raw = spark.read.parquet(*paths)
    else:
        raise ValueError(f"format must be 'csv' or 'parquet', got {fmt!r}")

    found = _found(raw)
    columns = []
    for field in schema.fields:
        if field.name == S.BATCH and isinstance(batch_id, str):
            columns.append(F.regexp_extract("_metadata.file_name", batch_id, 1).try_cast("int").alias(S.BATCH))
        elif field.name == S.BATCH and batch_id is not None:
            columns.append(F.lit(batch_id).cast("int").alias(S.BATCH))
        elif field.name in found:
            source = F.col(f"`{found[field.name]}`")
            same = raw.schema[found[field.name]].dataType == field.dataType
            columns.append((source if same else source.try_cast(field.dataType)).alias(field.name))
        elif field.nullable:
            columns.append(F.lit(None).cast(field.dataType).alias(field.name))
        else:
            raise ValueError(f"column {field.name!r} is missing; found {sorted(found)}")
    return raw.select(*columns)


def read_peaks(spark: SparkSession, path, fmt: str = "csv", batch_id: int | str | None = None) -> DataFrame:
    """Peak report, any number of files. The batch is given, a column, a ``batch_id=…`` folder
    in the path, or, where ``batch_id`` is a pattern, its first group in the file's name. Areas stay
    text until they are parsed."""
    return _read(spark, path, S.PEAKS, fmt, batch_id)


def read_sequence(spark: SparkSession, path, fmt: str = "csv", batch_id: int | str | None = None) -> DataFrame:
    return _read(spark, path, S.SEQUENCE, fmt, batch_id)


def read_mass_list(spark: SparkSession, path, fmt: str = "csv", batch_id: int | str | None = None) -> DataFrame:
    return _read(spark, path, S.MASS_LIST, fmt, batch_id)


def read_calibration(spark: SparkSession, path, fmt: str = "csv", batch_id: int | str | None = None) -> DataFrame:
    return _read(spark, path, S.CALIBRATION_MIXTURES, fmt, batch_id)


def read_blank_map(spark: SparkSession, path, fmt: str = "csv", batch_id: int | str | None = None) -> DataFrame:
    return _read(spark, path, S.BLANK_MAP, fmt, batch_id)


def read_run_params(spark: SparkSession, path, fmt: str = "csv", batch_id: int | str | None = None) -> DataFrame:
    return _read(spark, path, S.RUN_PARAMS, fmt, batch_id)


def read_assay(
    spark: SparkSession, folder: str, fmt: str = "csv", batch_id: int | str | None = None, run_params: bool = False
) -> S.AssayTables:
    """All tables of an assay from ``folder/<table>``; ``run_params`` says that there is one of that name, too."""
    def at(name: str) -> str:
        return f"{folder.rstrip('/')}/{name}"

    return S.AssayTables(
        peaks=read_peaks(spark, at("peaks"), fmt, batch_id),
        sequence=read_sequence(spark, at("sequence"), fmt, batch_id),
        mass_list=read_mass_list(spark, at("mass_list"), fmt, batch_id),
        calibration=read_calibration(spark, at("calibration"), fmt, batch_id),
        blank_map=read_blank_map(spark, at("blank_map"), fmt, batch_id),
        run_params=read_run_params(spark, at("run_params"), fmt, batch_id) if run_params else None,
    )


def example_peaks(spark: SparkSession) -> DataFrame:
    """The three-row example of a peak report."""
    rows = [
        (1, "Spike_10ng", "C10Cl5H18", 314.98275, "120000"),
        (1, "Spike_10ng", "C10Cl6H17", 346.94669, "180000"),
        (1, "Spike_10ng", "C10Cl7H16", 382.90479, "150000"),
    ]
    return spark.createDataFrame(rows, S.PEAKS)
