"""The engine against the row-by-row definition, on irregular random assays."""

from __future__ import annotations

import math

import pytest

from paraspark import Assay, AssayParams
from tests import brute_force
from tests.random_assay import merged, random_batch

SEEDS = {1: 11, 2: 12, 3: 13}
MEASURES = (
    "peak_area", "istd_area", "ratio", "ratio_bs", "chain_total", "chain_total_bs", "share_pct", "share_pct_bs",
    "cl_degree", "chain_cl_degree", "chain_cl_degree_bs",
)


def close(a, b):
    if a is None or b is None:
        return a is b
    return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)


@pytest.fixture(scope="module")
def batches():
    return {b: random_batch(seed, b) for b, seed in SEEDS.items()}


@pytest.fixture(scope="module", params=["null", "passthrough"])
def case(request, make_tables, batches):
    """All batches in one job on one side, each batch alone on the other."""
    assay = Assay(make_tables(**merged(*batches.values())), AssayParams(unassigned_blank=request.param))
    expected = {b: brute_force.homologues(t, passthrough=request.param == "passthrough") for b, t in batches.items()}
    return assay, expected


def test_homologues(case):
    assay, expected = case
    found = {
        (r["batch_id"], r["sample_name"], r["molecular_formula"]): r for r in assay.homologues.collect()
    }
    wanted = {(b, r["sample_name"], r["molecular_formula"]): r for b, rows in expected.items() for r in rows}
    assert found.keys() == wanted.keys()
    assert any(r["ratio_bs"] is None for r in wanted.values()) and any(r["ratio_bs"] == 0 for r in wanted.values())
    for key, want in wanted.items():
        got = found[key]
        for c in ("sample_type", "row_identity", "chain_length", "cl_no"):
            assert got[c] == want[c], (key, c)
        for c in MEASURES:
            assert close(got[c], want[c]), (key, c, got[c], want[c])


def test_calibration(case, batches):
    assay, expected = case
    wanted = {}
    for b, rows in expected.items():
        for (kind, n), f in brute_force.mixture_fits(batches[b], rows).items():
            wanted[b, kind, n] = f
    found = {(r["batch_id"], r["calibration_type"], r["chain_length"]): r for r in assay.mixture_fits.collect()}
    assert found.keys() == wanted.keys()
    for key, want in wanted.items():
        for c in ("cl_degree", "slope", "r_squared"):
            assert close(found[key][c], want[c]), (key, c)


@pytest.mark.parametrize("bs", [False, True])
def test_results_and_report(case, batches, bs):
    assay, expected = case
    v = "_bs" if bs else ""
    wanted, amounts = {}, {}
    for b, rows in expected.items():
        lines = brute_force.chain_calibration(brute_force.mixture_fits(batches[b], rows))
        found = brute_force.results(rows, lines)
        wanted |= {(b, *key): r for key, r in found.items()}
        amounts |= {(b, *key): a for key, a in brute_force.report(found, v).items()}
    got = {(r["batch_id"], r["sample_name"], r["chain_length"]): r for r in assay.results(bs).collect()}
    assert got.keys() == wanted.keys()
    for key, want in wanted.items():
        assert got[key]["cp_type"] == want["cp_type"]
        for c in (f"rf{v}", f"conc{v}"):
            assert close(got[key][c], want[c]), (key, c, got[key][c], want[c])
    report = {(r["batch_id"], r["sample_name"], r["label"]): r["amount"] for r in assay.report(bs).collect()}
    assert report.keys() == amounts.keys()
    for key, want in amounts.items():
        assert close(report[key], want), key


def test_early_and_row_level_summaries_agree(case):
    assay, _ = case
    late = {tuple(r)[:4]: r for r in assay.full_summary.collect()}
    early = {tuple(r)[:4]: r for r in assay.plain_summary.collect()}
    assert early.keys() == late.keys()
    for key, r in early.items():
        assert close(r["chain_total"], late[key]["chain_total"])
        assert close(r["chain_cl_degree"], late[key]["chain_cl_degree"])


def test_invariants(case):
    assay, _ = case
    rows = [r for r in assay.homologues.collect()]
    shares = {}
    for r in rows:
        if r["share_pct"] is not None:
            key = r["batch_id"], r["sample_name"], r["chain_length"]
            shares[key] = shares.get(key, 0.0) + r["share_pct"]
        if r["ratio_bs"] is not None and r["sample_type"] != "Calibration":
            assert r["ratio_bs"] <= r["ratio"] + 1e-12
    assert shares and all(math.isclose(s, 100.0, rel_tol=1e-9) for s in shares.values())
    for r in assay.results(True).collect():
        if r["cl_degree_f"] is not None:
            assert r["min_cl_degree"] <= r["cl_degree_f"] <= r["max_cl_degree"]
        assert r["rf"] is None or r["rf"] >= 1
