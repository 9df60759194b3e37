"""Assay tables derived from the order-line test tables.

A (supplier, order parity) pair plays an injection and a part an ion, so that
every query runs over all order lines. The irregular tables come from the same rows and hold what
a clean run does not: injections without a standard, repeated peaks, unreadable areas, a target
without a usable retention time, samples without a type, a blank without a label, mixtures of
some chains only, a chain with a response factor below its floor, and a batch with parameters of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paraspark.functions.chemistry import quoted
from paraspark.operators.joins import aggregate
from paraspark.schema import RUN_PARAMS, AssayTables

ISTD_FORMULA = "C'10Cl6H16"
ISTD_MZ = 355.97185
CHAINS = range(10, 19)
CHLORINES = range(3, 13)

# Key columns of an assay are declared not null, but the files do not say so.
# With coalesce Catalyst knows it too and adds no null filters on the texts
# built from them, which would otherwise be evaluated for every order line.
_BATCH = "coalesce(CAST(1 + l_orderkey % 2 AS INT), 0) AS batch_id"
_SUPPLIER = "coalesce(l_suppkey, -1L) AS s"
# The columns used, so that no file is opened to infer a schema.
_LINEITEM = "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_quantity DOUBLE, l_extendedprice DOUBLE"
_PART = "p_partkey BIGINT, p_size INT"
_SUPPLIERS = "s_suppkey BIGINT"

_BATCHES = "explode(array(1, 2)) AS batch_id"
_FORMULA = "concat('C', n, 'H', 2 * n + 2 - m, 'Cl', m)"
_MZ = "n * 12.0D + m * 34.96885D + (n * 2 + 2 - m) * 1.007825D"
_NAME = "concat('S', s)"
_TYPE = (
    "CASE WHEN s % 10 = 1 THEN 'Blank' WHEN s % 10 BETWEEN 2 AND 5 THEN 'Calibration'"
    " WHEN s % 10 = 6 THEN 'QC' ELSE 'Sample' END"
)


# What the irregular tables change.
_IRREGULAR_TYPE = f"CASE WHEN s % 10 = 0 AND batch_id = 2 THEN NULL ELSE {_TYPE} END"
_MIXTURES = {2: "10,11,12,13", 3: "12,13,14,15", 4: "10,11,12,13,14,15,16,17,18", 5: "10,12,14,16"}


def peaks(spark: SparkSession, sf_dir: str, irregular: bool = False) -> DataFrame:
    lines = spark.read.schema(_LINEITEM).parquet(f"{sf_dir}/lineitem.parquet")
    parts = spark.read.schema(_PART).parquet(f"{sf_dir}/part.parquet")

    ions = lines.join(parts.selectExpr("p_partkey AS l_partkey", "p_size"), "l_partkey").selectExpr(
        _BATCH,
        _SUPPLIER,
        "coalesce(CAST(10 + p_size % 9 AS INT), 0) AS n",
        "coalesce(CAST(3 + l_partkey % 11 AS INT), 0) AS m",
        "CAST(round(l_extendedprice * 100) AS BIGINT) AS cents",
    )
    cells = aggregate(ions, ["batch_id", "s", "n", "m"], cents="sum(cents)")
    area = "cents * (10 + m * (s % 4)) / 1000"
    unreadable = "WHEN (s + n + m) % 37 = 0 THEN '#N/A'"
    if irregular:
        unreadable += " WHEN (s + n + m) % 31 = 0 THEN 'NaN' WHEN (s + n + m) % 29 = 0 THEN 'n.d.'"
        unreadable += f" WHEN n = 16 AND s % 10 BETWEEN 2 AND 5 THEN CAST({area} / 1000000 AS STRING)"
        cells = cells.withColumn("copies", F.expr("if(s % 10 = 3 AND n = 11, array(1, 2), array(1))"))
        cells = cells.select("batch_id", "s", "n", "m", "cents", F.explode("copies")).drop("col")
    homologues = cells.selectExpr(
        "batch_id",
        f"{_NAME} AS replicate",
        f"{_FORMULA} AS formula",
        f"{_MZ} AS mz",
        f"CASE {unreadable}"
        f" WHEN s % 10 = 1 THEN CAST({area} / 50 AS STRING) ELSE CAST({area} AS STRING) END AS area_raw",
    )
    amounts = lines.selectExpr(_BATCH, _SUPPLIER, "CAST(l_quantity AS BIGINT) AS quantity")
    sums = aggregate(amounts, ["batch_id", "s"], quantity="sum(quantity)")
    if irregular:
        # No standard in the first batch, an empty one in the second.
        sums = sums.filter("NOT (s % 10 = 7 AND batch_id = 1)").selectExpr(
            "batch_id", "s", "if(s % 10 = 7, 0L, quantity) AS quantity"
        )
    standards = sums.selectExpr(
        "batch_id",
        f"{_NAME} AS replicate",
        f"{quoted(ISTD_FORMULA)} AS formula",
        f"{ISTD_MZ}D AS mz",
        "CAST(CAST(quantity AS DOUBLE) AS STRING) AS area_raw",
    )
    return homologues.unionByName(standards)


def mass_list(spark: SparkSession, irregular: bool = False) -> DataFrame:
    """Every (chain, chlorine) target and the standard, for both batches.

    The row past the last homologue becomes the standard.
    """
    targets = len(CHAINS) * len(CHLORINES)
    cells = spark.range(targets + 1).selectExpr(
        f"id = {targets} AS standard",
        f"CAST({CHAINS.start} + id DIV {len(CHLORINES)} AS INT) AS n",
        f"CAST({CHLORINES.start} + id % {len(CHLORINES)} AS INT) AS m",
    )
    retention = "if(standard, 7.5D, n * 0.5D + m * 0.25D)"
    if irregular:
        retention = f"if(NOT standard AND n = 13 AND m = 5, double('NaN'), {retention})"
    return cells.selectExpr(
        _BATCHES,
        f"if(standard, {quoted(ISTD_FORMULA)}, {_FORMULA}) AS molecular_formula",
        f"if(standard, {ISTD_MZ}D, {_MZ}) AS mz",
        "'[M]-' AS adduct",
        f"{retention} AS retention_time",
        "if(standard, '000_ISTD', concat('C', n, '_Cl', lpad(m, 2, '0'))) AS row_identity",
    )


def assay_tables(spark: SparkSession, sf_dir: str, irregular: bool = False) -> AssayTables:
    suppliers = spark.read.schema(_SUPPLIERS).parquet(f"{sf_dir}/supplier.parquet")
    injections = suppliers.selectExpr(
        _BATCHES, "coalesce(s_suppkey, -1L) AS s"
    ).selectExpr("*", f"{_NAME} AS sample_name"
    )
    info, run_params = quoted(",".join(str(n) for n in CHAINS)), None
    if irregular:
        info = "CASE s % 10 " + " ".join(f"WHEN {k} THEN {quoted(v)}" for k, v in _MIXTURES.items()) + " END"
        run_params = spark.createDataFrame([(2, ISTD_FORMULA, 50.0)], RUN_PARAMS)
    unlabelled = "s % 10 = 9 OR s = 1" if irregular else "s % 10 = 9"
    return AssayTables(
        peaks=peaks(spark, sf_dir, irregular),
        sequence=injections.selectExpr(
            "batch_id", "sample_name AS replicate", "sample_name", f"{_IRREGULAR_TYPE if irregular else _TYPE} AS sample_type"
        ),
        mass_list=mass_list(spark, irregular),
        calibration=injections.filter("s % 10 BETWEEN 2 AND 5").selectExpr(
            "batch_id",
            "sample_name",
            "concat('MIX', s % 10) AS calibration_type",
            "CAST(1 + s DIV 10 % 5 AS DOUBLE) AS calibration_level",
            f"{info} AS chain_length_info",
        ),
        blank_map=injections.filter(f"NOT ({unlabelled})").selectExpr(
            "batch_id", "sample_name", "concat('BLK', s DIV 10) AS blank_sample"
        ),
        run_params=run_params,
    )
