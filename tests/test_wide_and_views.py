from __future__ import annotations

import math
import random

import pytest

from paraspark import Assay, AssayParams
from paraspark.operators import views, wide
from paraspark.plans.assay import EXPORT_ORDER
from paraspark.plans.queries import rounded
from paraspark.sinks import exports
from tests.conftest import rows
from tests.random_assay import merged, random_batch


@pytest.fixture(scope="module")
def assay(make_tables):
    return Assay(make_tables(**merged(random_batch(5, 1), random_batch(6, 2))), sheet_width=3)


@pytest.mark.parametrize("width", [1, 7, 63])
def test_layout_is_the_exact_rank(spark, width):
    rng = random.Random(1)
    names = {f"{rng.choice('xyz')}{rng.randrange(5000)}" for _ in range(1500)}
    samples = [(1 if rng.random() < 0.8 else 2, n) for n in names]
    df = spark.createDataFrame(samples * 2, "batch_id int, sample_name string").repartition(7)
    layout = wide.sheet_layout(df, ["batch_id"], width)
    got = {(r["batch_id"], r["sample_name"]): (r["sheet"], r["slot"]) for r in layout.collect()}
    want = {}
    for b in (1, 2):
        for i, n in enumerate(sorted(n for k, n in samples if k == b)):
            want[b, n] = divmod(i, width)
    assert got == want


@pytest.mark.parametrize(
    "names",
    [
        [f"Sample_{i:05d}" for i in range(300)],
        ["a", "ab", "abc", "abcd", "abce", "b"],
        ["only"],
        ["same", "same_", "same__1", "same_é", "same_😀", "sameZ"],
        ["", "x"],
    ],
)
def test_layout_of_names_with_a_common_beginning(spark, names):
    df = spark.createDataFrame([(1, n) for n in names], "batch_id int, sample_name string").repartition(5)
    got = {r["sample_name"]: (r["sheet"], r["slot"]) for r in wide.sheet_layout(df, ["batch_id"], 4).collect()}
    assert got == {n: divmod(i, 4) for i, n in enumerate(sorted(names, key=str.encode))}


def test_positions_follow_the_written_order(assay):
    sheets = assay.raw_export()
    placed = wide.with_positions(sheets, ["batch_id"], EXPORT_ORDER, ["sample_type", "sheet"])
    written = [tuple(r) for r in sheets.select(*EXPORT_ORDER).collect()]
    for b in (1, 2):
        found = {r["position"]: tuple(r[c] for c in EXPORT_ORDER) for r in placed.filter(f"batch_id = {b}").collect()}
        assert [found[i + 1] for i in range(len(found))] == [r for r in written if r[0] == b]
    report = assay.report_wide(True)
    labels = [(r["sheet"], r["label"]) for r in report.filter("batch_id = 1").collect()]
    assert labels == sorted(labels)


def test_sheet_width_bounds(spark):
    with pytest.raises(ValueError):
        wide.sheet_layout(spark.range(1), [], 64)


def test_sheets_hold_every_value(assay):
    names = {(r["batch_id"], r["sample_type"], r["sheet"], r["slot"]): r["sample_name"] for r in assay.type_layout.collect()}
    cells = {}
    for r in assay.raw_export().collect():
        for i, c in enumerate(wide.slot_names(3)):
            if r[c] is not None:
                sample = names[r["batch_id"], r["sample_type"], r["sheet"], i]
                cells[r["batch_id"], sample, r["molecular_formula"]] = r[c]
    want = {
        (r["batch_id"], r["sample_name"], r["molecular_formula"]): r["peak_area"]
        for r in assay.rows.filter("sample_type IS NOT NULL").collect()
        if r["peak_area"] is not None
    }
    assert cells == want


def test_named_sheets_match_the_long_form(assay):
    report = {(r["sample_name"], r["label"]): r["amount"] for r in assay.report(True).filter("batch_id = 1").collect()}
    names = sorted({n for n, _ in report})
    sheet = exports.named_report(assay, 1, names, bs=True)
    assert sheet.columns[1:] == names
    assert wide.sheet_names(assay.report_layout, 1) == names[:3]
    for r in sheet.collect():
        for n in names:
            got, want = r[n], report.get((n, r["label"]))
            assert got is want or math.isclose(got, want, rel_tol=1e-9)
    labels = [r["label"] for r in sheet.collect()]
    assert labels == sorted(labels)

    export = exports.named_export(assay, 2, "Sample", names, "ratio")
    assert export.columns[:7] == ["mz", "retention_time", "row_identity", "molecular_formula", "sample_type",
                                  "chain_length", "cl_no"]
    assert export.filter("row_identity = '000_ISTD'").count() == 0
    assert exports.named_export(assay, 2, "Sample", names, "peak_area").filter("sample_type != 'Sample'").count() == 0


def test_profile_of_a_selection(assay):
    """Both shares run over all selected samples together."""
    chosen = ["name00", "name01"]
    rows = assay.profile_relative(True, chosen).collect()
    absolute = {(r["batch_id"], r["sample_name"], r["chain_length"], r["cl_no"]): r["value"]
                for r in assay.profile_absolute(True, chosen).collect()}
    assert {r["sample_name"] for r in rows} == set(chosen)
    for b in (1, 2):
        batch_sum = sum(v for k, v in absolute.items() if k[0] == b)
        for r in (r for r in rows if r["batch_id"] == b):
            chain_sum = sum(v for k, v in absolute.items() if k[0] == b and k[2] == r["chain_length"])
            value = absolute[b, r["sample_name"], r["chain_length"], r["cl_no"]]
            assert r["facet"] == f"C{r['chain_length']}" and 4 <= r["cl_no"] <= 12
            for got, total in ((r["profile_total"], batch_sum), (r["profile_chain"], chain_sum)):
                assert got is None if total == 0 else math.isclose(got, value / total * 100, abs_tol=1e-9)


def test_bars_take_the_first_samples_or_named_ones(assay):
    first = {(r["batch_id"], r["sample_name"]) for r in assay.chain_bars(False, 2).collect()}
    everyone = sorted({(r["batch_id"], r["sample_name"]) for r in assay.sample_list().collect()})
    assert first == {k for b in (1, 2) for k in [e for e in everyone if e[0] == b][:2]}
    named = {r["sample_name"] for r in assay.class_bars(True, ["name01"]).collect()}
    assert named == {"name01"}
    assert {(r["batch_id"], r["sample_name"]) for r in assay.class_bars(False, None).collect()} == set(everyone)


def test_narrowed_selections_equal_filtered_results(spark, assay):
    """Peaks of the chosen samples and their blanks give what a filter on all results gives."""
    table = spark.createDataFrame([(1, "name00"), (2, "name02"), (2, "name07")], "batch_id int, sample_name string")
    for samples in (["name01", "name05", "name07"], table):
        for bs in (False, True):
            pairs = [
                (assay.results_of(bs, samples), assay.results(bs)),
                (assay.chosen_rows(bs, samples), assay.variant_rows(bs)),
            ]
            for narrowed, whole in pairs:
                want = rows(views.select_samples(rounded(whole), samples), *sorted(whole.columns))
                assert want and rows(rounded(narrowed), *sorted(whole.columns)) == want


def test_first_samples_skip_those_without_rows(make_tables):
    batch = random_batch(5, 1)
    lost = [r[1] for r in batch["sequence"] if r[2] in ("name00", "name02")]
    batch["peaks"] = [p for p in batch["peaks"] if p[1] not in lost]
    few = Assay(make_tables(**batch))
    names = sorted(r["sample_name"] for r in few.sample_list().collect())
    assert not {"name00", "name02"} & set(names)
    for bs in (False, True):
        assert sorted({r["sample_name"] for r in few.chain_bars(bs, 3).collect()}) == names[:3]


def test_selection_by_table_and_long_list(spark, assay):
    table = spark.createDataFrame([(1, "name00")], "batch_id int, sample_name string")
    picked = views.select_samples(assay.sample_list(), table)
    assert [tuple(r) for r in picked.collect()] == [(1, "name00")]
    many = ["name00"] + [f"other{i}" for i in range(1500)]
    assert views.select_samples(assay.sample_list(), many).count() == 2


def test_istd_chart(assay):
    points = [r["istd_area"] for r in assay.istd_points.filter("batch_id = 1").collect()]
    mean = sum(points) / len(points)
    sd = math.sqrt(sum((p - mean) ** 2 for p in points) / (len(points) - 1))
    chart = assay.istd_chart().filter("batch_id = 1").collect()
    assert len(chart) == len(points)
    for r in chart:
        for c, want in (("mean_area", mean), ("sd_area", sd), ("lower_1sd", mean - sd), ("upper_1sd", mean + sd),
                        ("lower_2sd", mean - 2 * sd), ("upper_2sd", mean + 2 * sd), ("axis_max", max(points) * 1.2)):
            assert math.isclose(r[c], want, rel_tol=1e-9), c


def test_calibration_report_pages(assay):
    whole = assay.calibration_report().collect()
    assert {r["panel"] for r in whole} == {"response_vs_level", "factor_vs_content"}
    usual = assay.calibration_report(range(10, 18)).collect()
    assert len(usual) == sum(10 <= r["chain_length"] <= 17 for r in whole)
    key = lambda r: (r["panel"], r["batch_id"], str(r["calibration_type"]), r["x"], r["y"])
    page = sorted(assay.calibration_report([12]).collect(), key=key)
    want = sorted((r for r in whole if r["chain_length"] == 12), key=key)
    assert len(page) == len(want) > 0
    for a, b in zip(page, want, strict=True):
        for c in a.asDict():
            same = a[c] == b[c] or math.isclose(a[c], b[c], rel_tol=1e-9, abs_tol=1e-12)
            assert same, (c, a, b)


def test_as_coded_formulas_lose_the_other_spelling(make_tables):
    batch = random_batch(5, 1)
    coded = Assay(make_tables(**batch), AssayParams(formula_mode="as_coded")).rows.collect()
    assert all(r["cl_no"] is None for r in coded if "H" in r["molecular_formula"].split("Cl")[-1])
    assert any(r["cl_no"] is not None for r in coded)
