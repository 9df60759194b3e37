"""Input checks. Each returns rows instead of stopping the job."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame

from paraspark.functions.chemistry import identity_key
from paraspark.operators.identify import label_blanks, of_type
from paraspark.operators.joins import aggregate
from paraspark.schema import BATCH, BLANK, EXPORT_KEYS, SAMPLE_TYPES, AssayTables

# A cell of a wide export, and the hash that stands for it.
PIVOT_KEYS = (*EXPORT_KEYS, "sample_name")
HASHED = [BATCH, "h1", "h2"]


def _key_text(keys: Sequence[str]) -> str:
    parts = ", ".join(f"coalesce(CAST({k} AS STRING), '<null>')" for k in keys) or "''"
    return f"concat_ws('|', {parts}) AS key"


def _counts(df: DataFrame, check: str, keys: Sequence[str]) -> DataFrame:
    return aggregate(df, [BATCH, *keys], n="count(*)").selectExpr(
        f"'{check}' AS check_name", BATCH, _key_text(keys), "n"
    )


def table_counts(tables: AssayTables) -> DataFrame:
    """How often each key of the tables beside the peaks occurs, over all checks."""
    # A list that holds for all batches is checked under none.
    batch = BATCH if BATCH in tables.mass_list.columns else f"CAST(NULL AS INT) AS {BATCH}"
    targets = tables.mass_list.selectExpr(batch, f"{identity_key('molecular_formula', 'mz')} AS ion")
    blanks = label_blanks(of_type(tables.sequence, BLANK), tables.blank_map)
    parts = [
        _counts(tables.sequence, "replicates_per_sample", ["sample_name"]),
        _counts(tables.sequence, "sequence_replicate", ["replicate"]),
        _counts(targets.filter("ion IS NOT NULL"), "mass_list_ion", ["ion"]),
        _counts(tables.calibration, "calibration_sample", ["sample_name"]),
        _counts(tables.blank_map, "blank_map_sample", ["sample_name"]),
        _counts(blanks, "blanks_per_label", ["blank_label"]),
    ]
    if tables.run_params is not None:
        parts.append(_counts(tables.run_params, "run_params_batch", []))
    return reduce(DataFrame.unionByName, parts)


def _with_hash(rows: DataFrame) -> DataFrame:
    """Rows with 128 bits that stand for their wide key. Missing parts count with their place."""
    columns = ", ".join(PIVOT_KEYS)
    missing = ", ".join(f"{c} IS NULL" for c in PIVOT_KEYS)
    return rows.selectExpr("*", f"xxhash64({columns}, {missing}) AS h1", f"xxhash64('key', {columns}, {missing}) AS h2")


def pivot_key_counts(rows: DataFrame) -> DataFrame:
    """How often each key of a wide row's cell occurs, by its hash: 20 bytes a key are shuffled, not nine columns."""
    return aggregate(_with_hash(rows).select(BATCH, "h1", "h2"), HASHED, n="count(*)")


def repeated_cells(rows: DataFrame) -> DataFrame:
    """The wide keys that occur more than once; only their rows are grouped by them."""
    repeated = pivot_key_counts(rows).filter("n > 1").select(*HASHED)
    found = _with_hash(rows).join(repeated, HASHED, "left_semi")
    return _counts(found, "pivot_key", PIVOT_KEYS)


def duplicate_keys(tables: AssayTables, rows: DataFrame) -> DataFrame:
    """Keys that occur more than once."""
    return repeated_cells(rows).unionByName(table_counts(tables)).filter("n > 1")


def key_summary(tables: AssayTables, rows: DataFrame) -> DataFrame:
    """Keys and duplicated keys per check and batch."""
    cells = pivot_key_counts(rows).selectExpr("'pivot_key' AS check_name", BATCH, "n")
    return aggregate(
        cells.unionByName(table_counts(tables).select("check_name", BATCH, "n")),
        ["check_name", BATCH],
        keys_checked="count(*)",
        duplicate_keys="count_if(n > 1)",
    )


def istd_missing(injections: DataFrame) -> DataFrame:
    """Injections whose internal standard is missing or zero."""
    return injections.filter("istd_area IS NULL OR istd_area = 0").select(
        BATCH, "replicate", "sample_name", "sample_type", "istd_area"
    )


def sample_types_present(rows: DataFrame) -> DataFrame:
    """Whether each of the four sample types occurs in a batch."""
    flags = {f"has_{t.lower()}": f"coalesce(bool_or(sample_type = '{t}'), false)" for t in SAMPLE_TYPES}
    return aggregate(rows, [BATCH], **flags)
