"""What the physical plans must and must not contain."""

from __future__ import annotations

import contextlib
import random
import re

import pytest

from paraspark import Assay
from paraspark import schema as S
from paraspark.operators import views
from paraspark.plans.queries import queries
from paraspark.session import RUNTIME_CONF, tune
from paraspark.sources.driver_tables import ISTD_FORMULA, ISTD_MZ, assay_tables
from paraspark.sources.storage import store_peaks, stored_peaks
from tests.conftest import rows

SF = "/root/testdata/sf0.001"


@contextlib.contextmanager
def settings(spark, **conf):
    names = {k.replace("__", "."): v for k, v in conf.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


NO_BROADCAST = {
    "spark__sql__autoBroadcastJoinThreshold": "-1",
    "spark__sql__adaptive__autoBroadcastJoinThreshold": "-1",
}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df) -> str:
    df.collect()
    return plan(df).split("== Initial Plan ==")[0]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """The test tables as files, peaks by batch, as an assay would have them."""
    folder = str(tmp_path_factory.mktemp("assay"))
    names = ("peaks", "sequence", "mass_list", "calibration", "blank_map")
    tables = assay_tables(spark, SF)
    for name in names:
        writer = getattr(tables, name).write
        (writer.partitionBy(S.BATCH) if name == "peaks" else writer).parquet(f"{folder}/{name}")
    return S.AssayTables(**{name: spark.read.parquet(f"{folder}/{name}") for name in names})


@pytest.mark.parametrize("name", sorted(queries()))
def test_no_python_and_no_cross_join(spark, name):
    text = plan(queries()[name](spark, SF))
    assert not re.search(r"Python|Pandas|Arrow|Cartesian|NestedLoop", text)


def test_plain_report_reads_peaks_once(stored):
    text = final_plan(Assay(stored).report(False))
    assert text.count("FileScan parquet [replicate") == 1
    assert "ReusedExchange" in text


def test_raw_export_reads_areas_once_and_shuffles_narrow_rows(stored):
    """The second scan finds the samples that have rows, by keys alone."""
    text = final_plan(Assay(stored).raw_export())
    scans = re.findall(r"FileScan parquet \[(replicate[^\]]*)\]", text)
    assert [("area_raw" in s) for s in sorted(scans, key=len)] == [False, True]
    wide = next(l for l in text.splitlines() if "Exchange hashpartitioning" in l and "row_identity" in l)
    assert "REPARTITION_BY_COL" in wide


def test_blanks_and_samples_share_the_peak_exchange(spark, stored):
    with settings(spark, **NO_BROADCAST):
        text = final_plan(Assay(stored).report(True))
    assert re.search(r"ReusedExchange \[batch_id#\d+, replicate#\d+, peak_area", text) or re.search(
        r"ReusedExchange \[[^\]]*replicate#[^\]]*cl_degree", text
    )


def test_scan_reads_needed_columns_of_one_batch(stored):
    df = Assay(stored).rows.filter("batch_id = 2").select("sample_name", "peak_area")
    scan = re.search(r"FileScan parquet \[(.*?)\].*?PartitionFilters: \[(.*?)\].*?ReadSchema: struct<(.*?)>", plan(df))
    assert "batch_id" in scan.group(2) and "2" in scan.group(2)
    assert {c.split(":")[0] for c in scan.group(3).split(",")} == {"replicate", "formula", "mz", "area_raw"}


def test_formulas_are_not_parsed_per_peak(stored):
    text = Assay(stored).rows._jdf.queryExecution().optimizedPlan().toString()
    depth = {}
    for line in text.splitlines():
        if "regexp_extract" in line:
            depth.setdefault("regex", len(line) - len(line.lstrip(" :+-")))
        if "Join Inner" in line:
            depth.setdefault("join", len(line) - len(line.lstrip(" :+-")))
    assert depth["regex"] > depth["join"]


def peak_scans(df) -> list[str]:
    """Columns of each scan of the peak files that the finished plan ran."""
    return re.findall(r"FileScan parquet \[(replicate[^\]]*)\]", final_plan(df))


def test_shares_read_the_rows_once(spark, stored):
    """One scan for the rows, one narrower for their standards; totals are a window on the rows' one exchange."""
    with settings(spark, **NO_BROADCAST):
        for df in (Assay(stored).distribution(False), Assay(stored).distribution(True), Assay(stored).homologues):
            assert len(peak_scans(df)) <= 2
            windows = [l for l in plan(df).splitlines() if re.search(r"[+:]- Window \[", l)]
            assert windows and all("sample_name" in l and "chain_length" in l for l in windows)


def test_calibration_reads_the_peaks_of_its_injections(stored):
    """The semi-join stands below the first aggregate of the peaks, and below the mass list."""
    text = Assay(stored).chain_calibration._jdf.queryExecution().optimizedPlan().toString()
    depth = lambda pattern: [len(re.match(r"[\s:+-]*", l).group()) for l in text.splitlines() if re.search(pattern, l)]
    # The only aggregate of injections and the mass-list join are both above it.
    aggregates, matches, semi = depth(r"Aggregate \[batch_id#\d+, replicate"), depth(r"Join Inner.*formula"), depth("LeftSemi")
    assert aggregates and matches and max(semi) > max(aggregates) and max(semi) > max(matches)
    assert len(peak_scans(Assay(stored).chain_calibration)) == 1


def test_shared_and_reduced_calibration_agree(stored):
    assay = Assay(stored)
    assert rows(assay.chain_calibration) == rows(assay._shared_calibration)


def test_chosen_samples_reduce_the_peaks(stored):
    """First samples are chosen among injections; the rows of others never reach the subtraction."""
    assay = Assay(stored)
    text = assay.class_bars(True)._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("LeftSemi") >= 2
    assert len(peak_scans(Assay(stored).class_bars(False))) == 1


def test_control_chart_joins_no_peaks(spark, stored):
    with settings(spark, **NO_BROADCAST):
        df = Assay(stored).istd_chart()
        assert len(peak_scans(df)) == 1
    below = Assay(stored).istd_points._jdf.queryExecution().optimizedPlan().toString()
    joins = [l for l in below.splitlines() if "Join" in l]
    assert len([l for l in joins if "replicate" in l]) == 1  # the injections to their sequence


def test_key_checks_shuffle_hashes(spark, stored):
    """Cells are counted by 128 bits; their wide keys are grouped for repeated ones alone."""
    text = plan(Assay(stored).key_summary())
    assert not re.search(r"Exchange hashpartitioning\([^)]*row_identity", text)
    assert re.search(r"Exchange hashpartitioning\(batch_id#\d+, h1#\d+L, h2#\d+L", text)


def test_a_mass_list_without_batches_is_broadcast(spark, stored):
    targets = stored.mass_list.filter("batch_id = 1").drop("batch_id")
    shared = S.AssayTables(**(vars(stored) | {"mass_list": targets}))
    text = plan(Assay(shared).matched)
    assert "BroadcastHashJoin" in text and "strategy=broadcast" not in text
    assert rows(Assay(shared).rows) == rows(Assay(stored).rows)


def test_no_window_runs_over_peak_rows(stored):
    """But for shares, which stand beside their chain's total."""
    assay = Assay(stored)
    for df in (assay.subtracted, assay.istd_chart()):
        assert "Window" not in plan(df)
    below = plan(assay.plain_summary).split("Window", 1)[1].splitlines()[1:4]
    assert ["Sort" in below[0], "Exchange" in below[1], "HashAggregate(keys=" in below[2]] == [True] * 3


def test_first_samples_are_cut_before_the_shuffle(stored):
    assert "WindowGroupLimit" in plan(views.first_samples(Assay(stored).sample_list(), 6))


def test_bucketed_peaks_are_not_shuffled(spark):
    tables = assay_tables(spark, SF)
    store_peaks(tables.peaks, "bucketed_peaks", 4)
    try:
        kept = S.AssayTables(**(vars(tables) | {"peaks": stored_peaks(spark, "bucketed_peaks")}))
        with settings(spark, spark__sql__adaptive__autoBroadcastJoinThreshold="-1"):
            text = final_plan(Assay(kept).rows)
            expected = rows(Assay(tables).rows)
        assert not re.search(r"Exchange hashpartitioning\(batch_id#\d+, replicate", text)
        assert rows(Assay(kept).rows) == expected
    finally:
        spark.sql("DROP TABLE bucketed_peaks")


@pytest.mark.parametrize("name", ["concentration_report_bs", "relative_distribution_bs", "profile_relative_bs", "class_bars"])
def test_results_do_not_depend_on_broadcasts(spark, name):
    expected = rows(queries()[name](spark, SF))
    with settings(spark, **NO_BROADCAST):
        assert rows(queries()[name](spark, SF)) == expected


def test_no_computed_table_is_hinted(stored):
    for df in (Assay(stored).results(True), Assay(stored).class_bars(False), Assay(stored).profile_relative(True)):
        assert "strategy=broadcast" not in df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in queries() if not n.startswith(("staged", "csv", "qc_bad"))))
def test_building_a_query_starts_no_job(spark, name):
    """Save those that write a stage or files first."""
    tracker, group = spark.sparkContext.statusTracker(), f"build-{name}"
    spark.sparkContext.setJobGroup(group, name)
    try:
        queries()[name](spark, SF)
        assert not tracker.getJobIdsForGroup(group)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_hot_injection_is_split(spark, make_tables):
    """One injection holds a third of all peaks; its join partition is split
    and no row is lost."""
    rng = random.Random(3)
    ions = [(f"C{n}H{2 * n + 2 - m}Cl{m}", 12.0 * n + 35.0 * m) for n in range(10, 18) for m in range(4, 13)]
    small = [(1, f"r{i}", f, mz, str(rng.uniform(1, 9))) for i in range(200) for f, mz in ions]
    standards = [(1, r, ISTD_FORMULA, ISTD_MZ, "10") for r in ["hot"] + [f"r{i}" for i in range(200)]]
    hot = spark.range(len(small) // 2).selectExpr(
        "1 AS batch_id", "'hot' AS replicate",
        "element_at(array(" + ",".join(f"'{f}'" for f, _ in ions) + f"), CAST(1 + id % {len(ions)} AS INT)) AS formula",
        "element_at(array(" + ",".join(f"{mz}D" for _, mz in ions) + f"), CAST(1 + id % {len(ions)} AS INT)) AS mz",
        "'2' AS area_raw",
    )
    base = make_tables(
        peaks=small + standards,
        sequence=[(1, r, r, "Sample") for r in ["hot"] + [f"r{i}" for i in range(200)]],
        mass_list=[(1, f, mz, None, 5.0, f) for f, mz in ions] + [(1, ISTD_FORMULA, ISTD_MZ, None, 5.0, "000_ISTD")],
    )
    peaks = base.peaks.repartition(16).unionByName(hot.repartition(16))
    tables = S.AssayTables(**(vars(base) | {"peaks": peaks}))
    with settings(
        spark,
        **NO_BROADCAST,
        spark__sql__shuffle__partitions="16",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="1k",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="2",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="16k",
    ):
        df = Assay(tables).rows.select("sample_name", "ratio")
        assert df.count() == len(small) + len(small) // 2 + 201
        assert "skew=true" in final_plan(df)
        hot_total = Assay(tables).plain_summary.filter("sample_name = 'hot'").selectExpr("sum(chain_total)").first()[0]
        assert round(hot_total, 6) == round(len(small) // 2 * 0.2, 6)


def test_settings_of_the_session_win(spark):
    key = "spark.sql.adaptive.forceOptimizeSkewedJoin"
    with settings(spark, **{key.replace(".", "__"): "false"}):
        assert tune(spark).conf.get(key) == "false"
    spark.conf.unset(key)
    assert tune(spark).conf.get(key) == RUNTIME_CONF[key]
