"""Hand-made fixtures for single rules."""

from __future__ import annotations

import dataclasses
import math

import pytest

from paraspark import Assay, AssayParams
from tests.conftest import rows

ISTD = "C'10Cl6H16"
ISTD_TARGET = (1, ISTD, 356.0, None, 7.5, "000_ISTD")


def target(formula, mz, rt=5.0, identity=None):
    return (1, formula, mz, None, rt, identity or f"id_{formula}")


def test_missing_mz_matches_nothing(make_tables):
    t = make_tables(
        peaks=[(1, "r", "C10H17Cl5", None, "5"), (1, "r", "C10H16Cl6", 347.4, "6")],
        sequence=[(1, "r", "n", "Sample")],
        mass_list=[target("C10H17Cl5", None), target("C10H16Cl6", 346.9)],
    )
    a = Assay(t)
    assert rows(a.rows, "molecular_formula", "peak_area") == [("C10H16Cl6", 6.0)]
    assert rows(a.unmatched_peaks(), "formula", "peaks") == [("C10H17Cl5", 1)]


def test_istd_area_rules(make_tables):
    """The standard counts although its own row has no retention time; without
    one, or with area 0, the area is 0 and ratios are missing."""
    ion = "C10H17Cl5"
    t = make_tables(
        peaks=[(1, r, ion, 312.0, "50") for r in ("a", "b", "c")]
        + [(1, "a", ISTD, 356.0, "200"), (1, "c", ISTD, 356.0, "0"), (1, "d", ISTD, 356.0, "#N/A")],
        sequence=[(1, r, f"s{r}", "Sample") for r in "abcd"],
        mass_list=[target(ion, 312.0), (1, ISTD, 356.0, None, None, "000_ISTD")],
    )
    a = Assay(t)
    assert rows(a.rows, "sample_name", "istd_area", "ratio") == [("sa", 200.0, 0.25), ("sb", 0.0, None), ("sc", 0.0, None)]
    assert rows(a.istd_missing(), "replicate", "istd_area") == [("b", 0.0), ("c", 0.0), ("d", None)]
    assert rows(a.plain_summary, "sample_name", "chain_total") == [("sa", 0.25), ("sb", 0.0), ("sc", 0.0)]


def test_standard_and_volume_per_batch(make_tables):
    other = "C'12Cl6H20"
    t = make_tables(
        peaks=[(1, "r", ISTD, 356.0, "10"), (2, "r", other, 380.0, "20"), (1, "r", "C10H17Cl5", 312.0, "30"),
               (2, "r", "C10H17Cl5", 312.0, "30")],
        sequence=[(b, "r", "n", "Sample") for b in (1, 2)],
        mass_list=[(b, f, mz, None, 5.0, i) for b in (1, 2) for f, mz, i in
                   ((ISTD, 356.0, "x1"), (other, 380.0, "x2"), ("C10H17Cl5", 312.0, "x3"))],
        run_params=[(2, other, 50.0)],
    )
    a = Assay(t)
    got = {(r["batch_id"], r["molecular_formula"]): r["istd_area"] for r in a.rows.collect()}
    assert got[1, "C10H17Cl5"] == 10.0 and got[2, "C10H17Cl5"] == 20.0
    assert (1, "ISTD") in got and (2, "ISTD") in got



def test_volume_per_batch(make_tables):
    """Half the volume gives half the amount; the other batch keeps the run's."""
    five, six = "C10H17Cl5", "C10H16Cl6"
    areas = [("c5", five, "10"), ("c6", six, "20"), ("s", five, "15"), ("s", six, "5")]
    tables = make_tables(
        peaks=[(b, n, ISTD, 356.0, "1") for b in (1, 2) for n in ("c5", "c6", "s")]
        + [(b, n, f, 312.0 if f == five else 347.0, x) for b in (1, 2) for n, f, x in areas],
        sequence=[(b, n, n, "Sample" if n == "s" else "Calibration") for b in (1, 2) for n in ("c5", "c6", "s")],
        mass_list=[(b, *t[1:]) for b in (1, 2) for t in (ISTD_TARGET, target(five, 312.0), target(six, 347.0))],
        calibration=[(b, n, f"M{n}", 1.0, "10") for b in (1, 2) for n in ("c5", "c6")],
    )
    halved = dataclasses.replace(tables, run_params=make_tables(run_params=[(2, ISTD, 50.0)]).run_params)
    plain, other = (
        {(r["batch_id"], r["label"]): r["amount"] for r in Assay(t).report(False).collect()} for t in (tables, halved)
    )
    assert plain.keys() == other.keys() and {b for b, _ in plain} == {1, 2}
    known = {key: amount for key, amount in plain.items() if amount}
    assert known and all(other[k] == v for k, v in plain.items() if not v)
    for (batch, label), amount in known.items():
        assert math.isclose(other[batch, label], amount / batch)


def test_repeated_run_parameters_are_reported(make_tables):
    tables = make_tables(run_params=[(1, ISTD, 50.0), (1, ISTD, 60.0), (2, ISTD, 50.0)])
    found = [tuple(r) for r in Assay(tables).duplicate_keys().collect()]
    assert found == [("run_params_batch", 1, "", 2)]
    assert ("run_params_batch", 1, 1, 1) in [tuple(r) for r in Assay(tables).key_summary().collect()]


def test_one_bad_area_leaves_other_points_alone(make_tables):
    points = [("M1", 1.0, "10"), ("M1", 2.0, "20"), ("M1", 3.0, "31")]
    [want] = Assay(calibration_case(make_tables, points[:2])).mixture_fits.collect()
    for bad in ("Infinity", "1e999", "12.5d"):
        spoilt = [*points[:2], ("M1", 3.0, bad)]
        [got] = Assay(calibration_case(make_tables, spoilt)).mixture_fits.filter("slope IS NOT NULL").collect()
        assert math.isfinite(got["slope"])
    assert math.isclose(want["slope"], 10.0)


def test_chlorine_outside_domain_counts_in_total_only(make_tables):
    t = make_tables(
        peaks=[(1, "r", ISTD, 356.0, "10")] + [(1, "r", f"C10H{22 - m}Cl{m}", 300.0 + m, "20") for m in (3, 5, 13)],
        sequence=[(1, "r", "n", "Sample")],
        mass_list=[ISTD_TARGET] + [target(f"C10H{22 - m}Cl{m}", 300.0 + m) for m in (3, 5, 13)],
    )
    [r] = Assay(t).full_summary.collect()
    five = 5 * 35.5 / (5 * 35.5 + 120 + 17) * 100
    assert r["chain_total"] == 6.0 and math.isclose(r["chain_cl_degree"], five / 3)


def calibration_case(make_tables, points, info="10,11"):
    """One ion on chain 10; each point is (mixture, level, area); standard 1."""
    ion = "C10H17Cl5"
    names = [f"c{i}" for i in range(len(points))]
    return make_tables(
        peaks=[(1, n, ISTD, 356.0, "1") for n in names] + [(1, n, ion, 312.0, str(p[2])) for n, p in zip(names, points)],
        sequence=[(1, n, n, "Calibration") for n in names],
        mass_list=[ISTD_TARGET, target(ion, 312.0)],
        calibration=[(1, n, p[0], float(p[1]), info) for n, p in zip(names, points)],
    )


@pytest.mark.parametrize("extra", [[], [("M", 3, 7)]])
def test_fit_through_origin(make_tables, extra):
    a = Assay(calibration_case(make_tables, [("M", 1, 2), ("M", 2, 4), ("M", 3, 7), *extra]))
    [r] = a.mixture_fits.collect()
    assert math.isclose(r["slope"], 31 / 14) and math.isclose(r["r_squared"], 961 / 966)
    assert a.calibration_points.count() == 3
    [line] = a.chain_calibration.collect()
    assert math.isclose(line["intercept"], 31 / 14) and line["slope"] is None and line["r_squared"] == 0.0


def test_mixture_chain_list(make_tables):
    assert Assay(calibration_case(make_tables, [("M", 1, 2)], info="11,12")).mixture_fits.count() == 0
    assert Assay(calibration_case(make_tables, [("M", 1, 2)], info=None)).mixture_fits.count() == 0


def test_quantification_clamps_and_floors(spark):
    from paraspark.operators.quantify import concentration_report, quantify_chains, with_class_totals

    summary = spark.createDataFrame(
        [("low", 10, 6.0, 40.0), ("inside", 10, 6.0, 55.0), ("high", 10, 6.0, 90.0), ("floor", 11, 6.0, 50.0),
         ("none", 12, 6.0, 50.0)],
        "sample_name string, chain_length int, chain_total double, chain_cl_degree double",
    ).selectExpr("1 AS batch_id", "*", "'Sample' AS sample_type")
    lines = spark.createDataFrame(
        [(1, 10, 50.0, 60.0, -97.0, 2.0, 1.0), (1, 11, 50.0, 60.0, 0.4, 0.0, 1.0)],
        "batch_id int, chain_length int, min_cl_degree double, max_cl_degree double, intercept double, slope double,"
        " r_squared double",
    )
    results = quantify_chains(summary, lines, AssayParams(), [""])
    got = {r["sample_name"]: (r["cl_degree_f"], r["rf"], r["conc"]) for r in results.collect()}
    assert got == {
        "low": (50.0, 3.0, 2.0), "inside": (55.0, 13.0, 6.0 / 13), "high": (60.0, 23.0, 6.0 / 23),
        "floor": (50.0, 1.0, 6.0), "none": (None, None, None),
    }
    report = {(r["sample_name"], r["label"]): r["amount"] for r in concentration_report(results, 100.0).collect()}
    assert report["low", "10"] == 200.0 and report["low", "SCCPs"] == 200.0
    assert report["none", "12"] is None and report["none", "SCCPs"] == 0.0
    assert {r["class_conc"] for r in with_class_totals(results, [""]).collect()} == {2.0, 6.0 / 13, 6.0 / 23, 6.0, 0.0}


def blank_case(make_tables, labels, unassigned="null"):
    """Two ions; the blank has a value for the first only."""
    ions = [("C10H17Cl5", 312.0), ("C10H16Cl6", 346.0)]
    t = make_tables(
        peaks=[(1, r, ISTD, 356.0, "10") for r in ("s", "q", "b", "c")]
        + [(1, r, f, mz, a) for r, a in (("s", "50"), ("q", "1"), ("c", "50")) for f, mz in ions]
        + [(1, "b", *ions[0], "20"), (1, "b", *ions[1], "#N/A")],
        sequence=[(1, "s", "s", "Sample"), (1, "q", "q", "QC"), (1, "b", "b", "Blank"), (1, "c", "c", "Calibration")],
        mass_list=[ISTD_TARGET] + [target(f, mz) for f, mz in ions],
        blank_map=[(1, n, l) for n, l in labels.items()],
    )
    a = Assay(t, AssayParams(unassigned_blank=unassigned))
    found = a.subtracted.filter("row_identity != '000_ISTD'").collect()
    return {(r["sample_name"], r["molecular_formula"]): r["ratio_bs"] for r in found}


def test_blank_subtraction(make_tables):
    got = blank_case(make_tables, {"s": "B", "q": "B", "b": "B"})
    assert got["s", "C10H17Cl5"] == 3.0 and got["s", "C10H16Cl6"] == 5.0
    assert got["q", "C10H17Cl5"] == 0.0 and got["c", "C10H17Cl5"] == 5.0
    assert got["b", "C10H17Cl5"] == 0.0 and got["b", "C10H16Cl6"] is None


def test_blank_and_sample_without_label_belong_together(make_tables):
    got = blank_case(make_tables, {"q": "B"})
    assert got["s", "C10H17Cl5"] == 3.0 and got["q", "C10H17Cl5"] is None


def test_unassigned_samples(make_tables):
    labels = {"q": "B", "b": "B"}
    assert blank_case(make_tables, labels)["s", "C10H17Cl5"] is None
    assert blank_case(make_tables, labels, "passthrough")["s", "C10H17Cl5"] == 5.0


def test_duplicates_are_reported_and_stop_the_pivot(make_tables):
    ion = ("C10H17Cl5", 312.0)
    t = make_tables(
        peaks=[(1, r, ISTD, 356.0, "10") for r in "ab"] + [(1, r, *ion, "5") for r in "ab"],
        sequence=[(1, "a", "same", "Blank"), (1, "b", "same", "Blank")],
        mass_list=[ISTD_TARGET, target(*ion)],
        blank_map=[(1, "same", "B")],
    )
    a = Assay(t)
    assert {r["check_name"] for r in a.duplicate_keys().collect()} == {
        "pivot_key", "replicates_per_sample", "blanks_per_label",
    }
    with pytest.raises(Exception, match="duplicate_keys"):
        a.raw_export().collect()


def test_params_are_checked():
    with pytest.raises(ValueError):
        AssayParams(unassigned_blank="zero")
    with pytest.raises(ValueError):
        AssayParams(cl_min=5, cl_max=4)
