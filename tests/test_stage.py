"""The stored stage: same results, one scan of the peaks, and what runs after a lost one do."""

from __future__ import annotations

import os
import re

import pytest
from pyspark.sql import functions as F

from paraspark import Assay, AssayParams
from paraspark import schema as S
from paraspark.plans import stage
from paraspark.plans.queries import rounded
from paraspark.sinks import exports
from tests.conftest import rows
from tests.random_assay import merged, random_batch


@pytest.fixture(scope="module")
def tables(make_tables):
    return make_tables(**merged(random_batch(5, 1), random_batch(6, 2)), run_params=[(2, "C'10Cl6H16", 50.0)])


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return str(tmp_path_factory.mktemp("stage"))


@pytest.fixture(scope="module")
def both(tables, folder):
    assay = Assay(tables, sheet_width=4)
    return assay, stage.stage_assay(assay, folder)


OUTPUTS = {
    "raw": lambda a: a.raw_export(),
    "normalized": lambda a: a.normalized_export(False),
    "normalized_bs": lambda a: a.normalized_export(True),
    "homologues": lambda a: a.homologues,
    "report": lambda a: a.report(False),
    "report_bs": lambda a: a.report(True),
    "report_wide": lambda a: a.report_wide(True),
    "calibration": lambda a: a.calibration_report(),
    "points": lambda a: a.calibration_points,
    "chart": lambda a: a.istd_chart(),
    "bars": lambda a: a.class_bars(True, 3),
    "bars_plain": lambda a: a.chain_bars(False, 3),
    "named": lambda a: a.chain_bars(True, ["name01", "name07"]),
    "profile": lambda a: a.profile_relative(True),
    "profile_named": lambda a: a.profile_absolute(True, ["name01"]),
    "keys": lambda a: a.key_summary(),
    "missing": lambda a: a.istd_missing(),
    "types": lambda a: a.sample_types_present(),
    "layout": lambda a: a.type_layout,
}


@pytest.mark.parametrize("name", OUTPUTS)
def test_outputs_are_the_same(both, name):
    plain, staged = (rounded(OUTPUTS[name](a)) for a in both)
    columns = sorted(plain.columns)
    assert sorted(staged.columns) == columns
    assert rows(staged, *columns) == rows(plain, *columns)


def test_outputs_read_the_stage_alone(both, folder):
    for build in (OUTPUTS["normalized_bs"], OUTPUTS["report_bs"], OUTPUTS["homologues"]):
        text = build(both[1])._jdf.queryExecution().optimizedPlan().toString()
        files = [f for f in build(both[1]).inputFiles()]
        assert files and all("attempt=" in f for f in files), text


def test_stage_is_written_once(both, tables, folder):
    again = stage.stage_assay(Assay(tables), folder)
    assert len([d for d in os.listdir(folder) if d.startswith("attempt=")]) == 1
    assert rows(again.stage.injections) == rows(both[1].stage.injections)


def test_other_settings_are_refused(both, tables, folder):
    with pytest.raises(ValueError, match="other settings"):
        stage.stage_assay(Assay(tables, AssayParams(unassigned_blank="passthrough")), folder)


def test_a_run_after_a_lost_one_starts_anew(spark, tables, tmp_path, monkeypatch):
    """A write fails midway: no commit, nothing is read of that attempt, the next run is whole."""
    path, assay, write = str(tmp_path), Assay(tables), stage._write

    def failing(df, target, folders=()):
        if target.endswith("/rows"):
            raise RuntimeError("lost")
        return write(df, target, folders)

    monkeypatch.setattr(stage, "_write", failing)
    with pytest.raises(RuntimeError):
        stage.stage_assay(assay, path)
    assert stage.committed(spark, path) is None
    monkeypatch.undo()
    staged = stage.stage_assay(assay, path)
    attempts = [d for d in os.listdir(path) if d.startswith("attempt=")]
    assert len(attempts) == 2 and f"attempt={stage.committed(spark, path)[0]}" in attempts
    assert rows(rounded(staged.report(True))) == rows(rounded(assay.report(True)))


def test_the_first_of_two_commits_counts(spark, tables, tmp_path):
    path = str(tmp_path)
    stage.stage_assay(Assay(tables), path)
    first = stage.committed(spark, path)
    late = spark.range(1).select(
        F.lit("later").alias("attempt"), F.current_timestamp().alias("written_at"), F.lit("{}").alias("settings")
    )
    late.write.mode("append").json(f"{path}/commits")
    assert stage.committed(spark, path) == first


def test_export_all_reads_the_peak_source_once(spark, tables, tmp_path, monkeypatch):
    """Every other table an output reads is the stage's."""
    source = f"{tmp_path}/peaks"
    tables.peaks.write.partitionBy(S.BATCH).parquet(source)
    kept = S.AssayTables(**(vars(tables) | {"peaks": spark.read.parquet(source)}))
    seen, write, export = [], stage._write, exports.write_table

    def files(df):
        text = df._jdf.queryExecution().optimizedPlan().toString()
        scans = len(re.findall(r"Relation \[[^\]]*area_raw", text))
        seen.append(scans)

    monkeypatch.setattr(stage, "_write", lambda df, *a: (files(df), write(df, *a))[1])
    monkeypatch.setattr(exports, "write_table", lambda df, *a, **k: (files(df), export(df, *a, **k))[1])
    exports.export_all(Assay(kept, sheet_width=4), f"{tmp_path}/out")
    # Three tables of the stage, raw with its layout, two times (normalized, concentrations) with theirs, calibration.
    assert len(seen) == 3 + 2 + 8 + 1
    assert sum(seen) == 1
    assert spark.read.parquet(f"{tmp_path}/out/raw").count() == Assay(tables, sheet_width=4).raw_export().count()


def test_a_hot_injection_is_dealt_to_several_writers(spark, make_tables, tmp_path):
    """A rebalance cuts what is too large for one task, also within an injection."""
    ions = [(f"C{n}H{2 * n + 2 - m}Cl{m}", 12.0 * n + 35.0 * m) for n in range(10, 18) for m in range(4, 13)]
    base = make_tables(
        sequence=[(1, "hot", "hot", "Sample")],
        mass_list=[(1, f, mz, None, 5.0, f) for f, mz in ions] + [(1, "C'10Cl6H16", 356.0, None, 5.0, "000_ISTD")],
    )
    hot = spark.range(60000).selectExpr(
        "1 AS batch_id", "'hot' AS replicate",
        "element_at(array(" + ",".join(f"'{f}'" for f, _ in ions) + f"), CAST(1 + id % {len(ions)} AS INT)) AS formula",
        "element_at(array(" + ",".join(f"{mz}D" for _, mz in ions) + f"), CAST(1 + id % {len(ions)} AS INT)) AS mz",
        "CAST(rand(7) AS STRING) AS area_raw",
    )
    tables = S.AssayTables(**(vars(base) | {"peaks": hot.repartition(8)}))
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "64k")
    try:
        staged = stage.stage_assay(Assay(tables), str(tmp_path))
    finally:
        spark.conf.set(key, before)
    assert staged.stage.matched.count() == 60000
    assert len(staged.stage.matched.inputFiles()) > 1
