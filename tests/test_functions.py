from __future__ import annotations

import math
import random
from functools import reduce
from operator import add

import pytest
from pyspark.sql import functions as F

from paraspark.functions import chemistry as chem
from paraspark.functions import exact
from paraspark.functions import numeric as num


def evaluate(spark, schema, values, *expressions):
    df = spark.createDataFrame([v if isinstance(v, tuple) else (v,) for v in values], schema)
    return [tuple(r) for r in df.selectExpr(*expressions).collect()]


def test_mz_key_rounds_half_to_even(spark):
    got = evaluate(spark, "f string, mz double", [("A", 314.5), ("A", 315.5), ("A", 314.98), (None, 1.0), ("A", None)],
                   chem.identity_key("f", "mz"))
    assert got == [("A-314",), ("A-316",), ("A-315",), (None,), (None,)]


def test_area_text(spark):
    got = evaluate(spark, "x string", ["#N/A", "", "1e5", " 12.5 ", "abc", "NaN", None], num.number("x"))
    assert [v for (v,) in got] == [None, None, 1e5, 12.5, None, None, None]
    odd = ["Infinity", "-inf", "inf", "1e999", "12.5d", "3f", "0x10", "1_000", "-.5", "+2.", "1E-3", "."]
    got = evaluate(spark, "x string", odd, num.number("x"))
    assert [v for (v,) in got] == [None] * 8 + [-0.5, 2.0, 1e-3, None]


def test_finite(spark):
    values = [1.5, float("nan"), float("inf"), float("-inf"), None, -0.0]
    assert [v for (v,) in evaluate(spark, "x double", values, num.finite("x"))] == [1.5, None, None, None, None, 0.0]


@pytest.mark.parametrize(
    "formula, carbons, element, as_coded",
    [
        ("C10H17Cl5", 10, 5, 5),
        ("C10Cl5H18", 10, 5, None),
        ("C9H15Cl5", 9, 5, 5),
        ("C'10Cl6H16", 10, 6, None),
        ("C12H26", 12, None, None),
        ("C10Cl3H2Cl5", 10, 3, None),
        ("ISTD", None, None, None),
        (None, None, None, None),
    ],
)
def test_formula_spellings(spark, formula, carbons, element, as_coded):
    [got] = evaluate(spark, "f string", [formula], chem.carbon_count("f"), chem.chlorine_count("f"),
                     chem.chlorine_count("f", "as_coded"))
    assert got == (carbons, element, as_coded)


def test_unknown_formula_mode():
    with pytest.raises(ValueError):
        chem.chlorine_count("f", "other")


def test_chlorine_domain_and_percent(spark):
    got = evaluate(spark, "n int, m int", [(10, 3), (10, 6), (10, 12), (10, 13), (None, 6)],
                   chem.in_domain("m", 4, 12), chem.chlorine_percent("n", "m"))
    assert [d for d, _ in got] == [None, 6, 12, None, 6]
    assert math.isclose(got[1][1], 213 / (213 + 120 + 22 - 6) * 100)
    assert round(got[1][1], 4) == 61.0315
    assert got[4][1] is None


def test_chain_classes(spark):
    got = evaluate(spark, "n int", [9, 10, 13, 14, 17, 18, None], chem.paraffin_class("n"))
    assert [v for (v,) in got] == ["LCCPs", "SCCPs", "SCCPs", "MCCPs", "MCCPs", "LCCPs", "LCCPs"]


def test_null_rules(spark):
    got = evaluate(
        spark, "x double, lo double, hi double",
        [(1.0, 2.0, 3.0), (2.5, 2.0, 3.0), (9.0, 2.0, 3.0), (None, 2.0, 3.0), (2.5, None, 3.0), (2.5, 2.0, None)],
        num.clamp("x", "lo", "hi"), num.at_least("x", 2), num.clip_negative("x - 2"),
    )
    assert [g[0] for g in got] == [2.0, 2.5, 3.0, None, None, None]
    assert [g[1] for g in got] == [2.0, 2.5, 9.0, None, 2.5, 2.5]
    assert [g[2] for g in got] == [0.0, 0.5, 7.0, None, 0.5, 0.5]


def test_division_and_sum_of_nothing(spark):
    df = spark.createDataFrame([(1.0, 0.0), (None, 2.0)], "a double, b double")
    assert [r[0] for r in df.selectExpr(num.ratio("a", "b")).collect()] == [None, None]
    assert df.filter("a > 5").agg(F.expr(num.total("a"))).first()[0] == 0.0


GRIDS = {"areas": exact.AREAS, "ratios": exact.RATIOS}


def exact_sums(df, grid, where="true"):
    return df.groupBy("k").agg(F.expr(exact.exact_sum("x", grid, where)).alias("s")).collect()


@pytest.mark.parametrize("grid", GRIDS.values(), ids=GRIDS)
def test_exact_sum_depends_on_values_alone(spark, grid):
    rng = random.Random(4)
    values = [rng.uniform(-1, 1) * 10 ** rng.randrange(-4, 9) for _ in range(400)]
    orders = [(k, x) for k in range(8) for x in rng.sample(values, len(values))]
    got = {r["s"] for parts in (1, 3, 16) for r in exact_sums(spark.createDataFrame(orders, "k int, x double").repartition(parts), grid)}
    assert len({reduce(add, rng.sample(values, len(values))) for _ in range(50)}) > 1  # plain sums do differ
    assert len(got) == 1
    assert math.isclose(got.pop(), math.fsum(values), rel_tol=1e-15)


@pytest.mark.parametrize("grid", GRIDS.values(), ids=GRIDS)
def test_exact_sum_of_equal_totals_in_other_parts(spark, grid):
    """Carries: the same total from numbers whose limbs differ."""
    rows = [(1, 2.0**31)] * 4 + [(2, 2.0**33)] + [(3, 2.0**40), (3, 2.0**33 - 2.0**40)] + [(4, -1.5), (4, 2.0**33), (4, 1.5)]
    got = {r["s"] for r in exact_sums(spark.createDataFrame(rows, "k int, x double"), grid)}
    assert got == {2.0**33}


def test_exact_sum_keeps_the_thirteenth_digit(spark):
    rows = [(1, 0.1), (1, 0.2), (2, 0.2), (2, 0.1), (3, 0.1), (3, 0.2000000000001)]
    got = {r["k"]: r["s"] for r in exact_sums(spark.createDataFrame(rows, "k int, x double"), exact.AREAS)}
    assert got[1] == got[2] != got[3]


def test_exact_sum_of_nothing_and_of_huge_numbers(spark):
    rows = [(1, None), (2, 5.0), (3, 1e300), (3, 1.0), (4, None), (4, -0.0), (5, -7.25), (6, 1e-30)]
    df = spark.createDataFrame(rows, "k int, x double")
    got = {r["k"]: r["s"] for r in exact_sums(df, exact.RATIOS)}
    assert got == {1: None, 2: 5.0, 3: 1e300, 4: 0.0, 5: -7.25, 6: 1e-30}
    assert {r["k"]: r["s"] for r in exact_sums(df, exact.AREAS, "x > 5")} == {1: None, 2: None, 3: 1e300, 4: None, 5: None, 6: None}
