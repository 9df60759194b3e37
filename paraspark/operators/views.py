"""Tables behind the charts, and the row selections they use."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paraspark.functions.chemistry import facet_label
from paraspark.functions.numeric import ratio
from paraspark.operators.joins import aggregate, attach
from paraspark.schema import BATCH, AssayParams


def sample_list(rows: DataFrame) -> DataFrame:
    """Distinct sample names per batch."""
    return rows.select(BATCH, "sample_name").distinct()


def first_samples(names: DataFrame, k: int) -> DataFrame:
    """The first ``k`` names of each batch, in name order.

    The rank filter lets Spark cut every task to ``k`` rows per batch before
    the shuffle, so a large batch is never sorted in one task.
    """
    rank = f"row_number() OVER (PARTITION BY {BATCH} ORDER BY sample_name) AS position"
    return names.selectExpr("*", rank).filter(f"position <= {int(k)}").drop("position")


def first_sample_rows(rows: DataFrame, k: int) -> DataFrame:
    """The rows of the first ``k`` names of each batch, in name order.

    Ranks are those of the names, so no list of them is derived and joined back. Every task is cut
    to the rows of its own first ``k`` names per batch before the shuffle.
    """
    rank = f"dense_rank() OVER (PARTITION BY {BATCH} ORDER BY sample_name) AS position"
    return rows.selectExpr("*", rank).filter(f"position <= {int(k)}").drop("position")


def select_samples(rows: DataFrame, samples: Sequence[str] | DataFrame | None) -> DataFrame:
    """Rows of the chosen samples: names, a (batch, name) table, or all named ones.

    Names are a literal filter, whatever their number; a large selection is a table.
    """
    if samples is None:
        return rows.filter("sample_name IS NOT NULL")
    if isinstance(samples, DataFrame):
        chosen = samples.select(*[c for c in (BATCH, "sample_name") if c in samples.columns])
        return rows.join(chosen, chosen.columns, "left_semi")
    return rows.filter(F.col("sample_name").isin(*samples))


def istd_points(injections: DataFrame) -> DataFrame:
    """Distinct standard areas of the injections that have identified rows."""
    seen = injections.filter("identified > 0")
    return seen.select(BATCH, "sample_name", "istd_area", "sample_type").distinct()


def istd_limits(points: DataFrame) -> DataFrame:
    """Control limits of the standard area per batch and the chart's axis end."""
    stats = aggregate(
        points,
        [BATCH],
        mean_area="avg(istd_area)",
        sd_area="stddev_samp(istd_area)",
        axis_max="max(istd_area) * 1.2D",
    )
    return stats.selectExpr(
        BATCH,
        "mean_area",
        "sd_area",
        "mean_area - sd_area AS lower_1sd",
        "mean_area + sd_area AS upper_1sd",
        "mean_area - 2 * sd_area AS lower_2sd",
        "mean_area + 2 * sd_area AS upper_2sd",
        "axis_max",
    )


def istd_chart(points: DataFrame, limits: DataFrame) -> DataFrame:
    """Control chart: every point with the limits of its batch."""
    return attach(points, limits, [BATCH])


def response_vs_level(points: DataFrame, fits: DataFrame) -> DataFrame:
    """Calibration points with the line of their (mixture, chain)."""
    return attach(
        points,
        fits.select(BATCH, "calibration_type", "chain_length", "slope", "r_squared"),
        [BATCH, "calibration_type", "chain_length"],
        null_safe=["calibration_type"],
    )


def factor_vs_content(fits: DataFrame, chain_calibration: DataFrame) -> DataFrame:
    """Response factors over Cl% with the line of their chain."""
    lines = chain_calibration.selectExpr(
        BATCH,
        "chain_length",
        "intercept AS fit_intercept",
        "slope AS fit_slope",
        "r_squared AS fit_r_squared",
    )
    factors = fits.selectExpr(
        BATCH, "chain_length", "calibration_type", "cl_degree", "slope AS response_factor"
    )
    return attach(factors, lines, [BATCH, "chain_length"])


def calibration_report(
    points: DataFrame, factors: DataFrame, chains: Sequence[int] | None = None
) -> DataFrame:
    """Both calibration panels in one table keyed by chain, for the given chains or all calibrated ones."""
    level = points.selectExpr(
        BATCH,
        "chain_length",
        "'response_vs_level' AS panel",
        "calibration_type",
        "calibration_level AS x",
        "chain_total AS y",
        "0.0D AS fit_intercept",
        "slope AS fit_slope",
        "r_squared AS fit_r_squared",
    )
    content = factors.selectExpr(
        BATCH,
        "chain_length",
        "'factor_vs_content' AS panel",
        "calibration_type",
        "cl_degree AS x",
        "response_factor AS y",
        "fit_intercept",
        "fit_slope",
        "fit_r_squared",
    )
    panels = level.unionByName(content)
    return panels if chains is None else panels.filter(F.col("chain_length").isin(*chains))


def class_bars(class_rows: DataFrame, variant: str = "") -> DataFrame:
    """One bar per (sample, class); class rows are unique already."""
    return class_rows.select(BATCH, "sample_name", "cp_type", f"class_conc{variant}")


def chain_bars(results: DataFrame, variant: str = "") -> DataFrame:
    """One bar segment per (sample, chain); result rows are unique already."""
    return results.select(BATCH, "sample_name", "chain_length", f"conc{variant}")


def _profile_rows(rows: DataFrame, variant: str, params: AssayParams) -> DataFrame:
    return rows.filter(f"cl_no BETWEEN {params.cl_min} AND {params.cl_max}").selectExpr(
        BATCH, "sample_name", "chain_length", "cl_no", f"coalesce(ratio{variant}, 0.0D) AS value"
    )


def profile_relative(rows: DataFrame, variant: str, params: AssayParams) -> DataFrame:
    """Share of each homologue in its batch's selection and in its chain there.

    Both totals run over all selected samples. They are grouped first and
    joined back: batch and chain are few, large groups.
    """
    chosen = _profile_rows(rows, variant, params)
    totals = aggregate(chosen, [BATCH, "chain_length"], chain_sum="sum(value)").selectExpr(
        "*", f"sum(chain_sum) OVER (PARTITION BY {BATCH}) AS batch_sum"
    )
    joined = attach(chosen, totals, [BATCH, "chain_length"], null_safe=["chain_length"])
    return joined.selectExpr(
        BATCH,
        "sample_name",
        f"{facet_label('chain_length')} AS facet",
        "chain_length",
        "cl_no",
        f"{ratio('value', 'batch_sum')} * 100 AS profile_total",
        f"{ratio('value', 'chain_sum')} * 100 AS profile_chain",
    )


def profile_absolute(rows: DataFrame, variant: str, params: AssayParams) -> DataFrame:
    """Homologue ratios of the selection; a missing one is drawn as 0."""
    return _profile_rows(rows, variant, params).selectExpr(
        BATCH, "sample_name", f"{facet_label('chain_length')} AS facet", "chain_length", "cl_no", "value"
    )


def preview(wide: DataFrame, order: Sequence[str], rows: int | None = 5, columns: int = 10) -> DataFrame:
    """Head of a wide table: its first rows and columns."""
    head = wide if rows is None else wide.orderBy(*order).limit(rows)
    return head.select(*wide.columns[:columns])
