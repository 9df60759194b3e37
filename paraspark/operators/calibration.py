"""Two-stage response-factor calibration on built-in aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame

from paraspark.functions.numeric import ratio
from paraspark.operators.identify import of_type
from paraspark.operators.joins import aggregate
from paraspark.schema import BATCH, CALIBRATION

# Fixed value: relative spread below which least squares calls a column constant.
RANK_TOLERANCE = 1e-7

MIXTURE_KEYS = (BATCH, "calibration_type", "chain_length")


def calibration_injections(sequence: DataFrame, mixtures: DataFrame) -> DataFrame:
    """Injections of the calibration samples that the mixture table knows.

    They are few beside the samples; a semi-join with them reduces the peaks before anything is
    done with those.
    """
    known = mixtures.select(BATCH, "sample_name")
    return of_type(sequence, CALIBRATION).join(known, [BATCH, "sample_name"], "left_semi")


def calibration_rows(summary: DataFrame, mixtures: DataFrame) -> DataFrame:
    """Chain totals of calibration samples, for the chains their mixture holds.

    A sample that is not in the mixture table has no chain list and is dropped.
    """
    info = mixtures.select(
        BATCH, "sample_name", "calibration_type", "calibration_level", "chain_length_info"
    )
    return (
        summary.filter("is_calibration")
        .join(info, [BATCH, "sample_name"])
        .filter("contains(chain_length_info, CAST(chain_length AS STRING))")
        .select(*MIXTURE_KEYS, "sample_name", "calibration_level", "chain_total", "chain_cl_degree")
    )


def calibration_points(rows: DataFrame) -> DataFrame:
    """Distinct (mixture, chain, level, total).

    Totals are exact sums, so samples with equal peaks have one point and others one each.
    """
    return rows.select(*MIXTURE_KEYS, "calibration_level", "chain_total").distinct()


def fit_mixtures(rows: DataFrame) -> DataFrame:
    """Per (mixture, chain): line through the origin and mean Cl%.

    The line uses distinct (level, total) pairs and the mean distinct Cl%
    values. Both sets are de-duplicated in one pass by giving each row one
    entry for either set. R-squared is the uncentred one of a fit without
    intercept.
    """
    entries = rows.selectExpr(
        *MIXTURE_KEYS,
        "stack(2, true, calibration_level, chain_total, false, CAST(NULL AS DOUBLE), chain_cl_degree)"
        " AS (is_point, x, y)",
    )
    unique = entries.distinct()
    usable = "is_point AND x IS NOT NULL AND y IS NOT NULL"
    sums = aggregate(
        unique,
        MIXTURE_KEYS,
        xy=f"sum(x * y) FILTER (WHERE {usable})",
        xx=f"sum(x * x) FILTER (WHERE {usable})",
        yy=f"sum(y * y) FILTER (WHERE {usable})",
        cl_degree="avg(y) FILTER (WHERE NOT is_point)",
    )
    return sums.selectExpr(
        *MIXTURE_KEYS,
        "cl_degree",
        f"{ratio('xy', 'xx')} AS slope",
        f"{ratio('xy * xy', 'xx * yy')} AS r_squared",
    )


def calibrate_chains(fits: DataFrame) -> DataFrame:
    """Per chain: calibrated Cl% range and the line response factor ~ Cl%.

    With one mixture, or mixtures of equal Cl%, there is no slope and the
    intercept is the mean response factor. Equal means a spread below
    ``RANK_TOLERANCE`` of the values: what is left is rounding, not content.
    """
    both = "response IS NOT NULL AND cl_degree IS NOT NULL"
    sums = aggregate(
        fits.withColumnRenamed("slope", "response"),
        [BATCH, "chain_length"],
        min_cl_degree="min(cl_degree)",
        max_cl_degree="max(cl_degree)",
        mean_response=f"avg(response) FILTER (WHERE {both})",
        spread="regr_sxx(response, cl_degree)",
        squares=f"sum(cl_degree * cl_degree) FILTER (WHERE {both})",
        fit_intercept="regr_intercept(response, cl_degree)",
        fit_slope="regr_slope(response, cl_degree)",
        fit_r_squared="regr_r2(response, cl_degree)",
    )
    varies = f"spread >= {RANK_TOLERANCE}D * {RANK_TOLERANCE}D * squares AND spread > 0"
    return sums.selectExpr(
        BATCH,
        "chain_length",
        "min_cl_degree",
        "max_cl_degree",
        f"CASE WHEN {varies} THEN fit_intercept ELSE mean_response END AS intercept",
        f"CASE WHEN {varies} THEN fit_slope END AS slope",
        f"CASE WHEN {varies} THEN fit_r_squared WHEN mean_response IS NOT NULL THEN 0.0D END AS r_squared",
    )
