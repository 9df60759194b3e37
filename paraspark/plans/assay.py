"""The whole quantification as lazily composed DataFrames."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paraspark.operators import blanks, calibration, contracts, distribution, identify, quantify, views, wide
from paraspark.operators.joins import attach
from paraspark.schema import BATCH, BLANK, CALIBRATION, EXPORT_KEYS, SAMPLE_TYPES, VARIANTS, AssayParams, AssayTables

Samples = Sequence[str] | DataFrame | None
# Row order of the exports and of the report.
EXPORT_ORDER = (BATCH, "sample_type", "sheet", "row_identity", "molecular_formula", "mz")
REPORT_ORDER = (BATCH, "sheet", "label")
from paraspark.session import tune


def _variant(bs: bool) -> str:
    return "_bs" if bs else ""


class Assay:
    """Views of one set of input tables.

    Every property is a plan, not data. Plain results and the calibration need
    no row-level blank handling and use the early-aggregated chain summary;
    only results with blank subtraction join peak rows to their injections.
    """

    def __init__(self, tables: AssayTables, params: AssayParams | None = None, sheet_width: int = wide.SHEET_WIDTH):
        self.tables = tables
        self.params = params or AssayParams()
        self.sheet_width = sheet_width
        tune(tables.peaks.sparkSession)

    # identification

    @cached_property
    def targets(self) -> DataFrame:
        return identify.prepare_targets(self.tables.mass_list, self.params, self.tables.run_params)

    @cached_property
    def matched(self) -> DataFrame:
        return identify.match_targets(self.tables.peaks, self.targets, self.params, self.tables.run_params)

    @cached_property
    def injections(self) -> DataFrame:
        return identify.describe_injections(
            identify.istd_areas(self.matched), self.tables.sequence, self.tables.blank_map
        )

    @cached_property
    def typed_rows(self) -> DataFrame:
        """Identified peaks with sample and type, without their standard."""
        return identify.identified_rows(
            self.matched, identify.injection_types(self.tables.sequence), how="left"
        )

    @cached_property
    def rows(self) -> DataFrame:
        """Identified peaks with their ratio to the internal standard."""
        return identify.normalize(identify.identified_rows(self.matched, self.injections))

    def matched_of(self, injections: DataFrame) -> DataFrame:
        """Matched peaks of the given injections alone."""
        peaks = identify.peaks_of(self.tables.peaks, injections)
        return identify.match_targets(peaks, self.targets, self.params, self.tables.run_params)

    def unmatched_peaks(self) -> DataFrame:
        return identify.unmatched_peaks(self.tables.peaks, self.targets)

    # blanks

    @cached_property
    def blank_means(self) -> DataFrame:
        return blanks.blank_means(self.rows)

    @cached_property
    def subtracted(self) -> DataFrame:
        return blanks.subtract_blanks(self.rows, self.blank_means, self.params)

    @cached_property
    def homologue_rows(self) -> DataFrame:
        return identify.without_istd(self.rows)

    def _subtract(self, rows: DataFrame) -> DataFrame:
        """Blank subtraction among homologue rows; the standard's own blank
        values play no part there."""
        return blanks.subtract_blanks(rows, self._homologue_means, self.params)

    @cached_property
    def _homologue_means(self) -> DataFrame:
        return blanks.blank_means(self.homologue_rows)

    def variant_rows(self, bs: bool, where: str = "true") -> DataFrame:
        """Homologue rows with the plain ratio, or with both; of the rows that meet the condition."""
        rows = self.homologue_rows.filter(where)
        return self._subtract(rows) if bs else rows

    def narrowed(self, samples: Sequence[str] | DataFrame, bs: bool) -> Assay:
        """The assay on the peaks of the chosen samples and, for subtraction, of their blanks.

        The choice is made among injections and reduces the peaks before anything is done with them.
        """
        chosen = views.select_samples(self.tables.sequence, samples)
        if bs:
            labelled = identify.label_blanks(self.tables.sequence, self.tables.blank_map)
            wanted = views.select_samples(labelled, samples)
            used = blanks.blanks_of(identify.of_type(labelled, BLANK), wanted)
            chosen = chosen.unionByName(used.select(*chosen.columns))
        return Assay(
            replace(self.tables, peaks=identify.peaks_of(self.tables.peaks, chosen)), self.params, self.sheet_width
        )

    def chosen_rows(self, bs: bool, samples: Samples) -> DataFrame:
        """Homologue rows of the chosen samples, or of all that have a name."""
        assay = self if samples is None else self.narrowed(samples, bs)
        return views.select_samples(assay.variant_rows(bs), samples)

    # distribution

    @cached_property
    def plain_summary(self) -> DataFrame:
        return distribution.summarize_chains_early(self.matched, self.tables.sequence)

    @cached_property
    def full_summary(self) -> DataFrame:
        return distribution.summarize_chains(self.variant_rows(True))

    def summary(self, bs: bool) -> DataFrame:
        return self.full_summary if bs else self.plain_summary

    def distribution(self, bs: bool) -> DataFrame:
        v = _variant(bs)
        return distribution.distribute(self.variant_rows(bs), [v])

    @cached_property
    def homologues(self) -> DataFrame:
        """The main frame with every column of both variants."""
        return distribution.distribute(self.variant_rows(True))

    # calibration: on plain values in either variant

    @cached_property
    def calibration_summary(self) -> DataFrame:
        """Chain totals of the calibration samples, whose injections reduce the peaks first."""
        injections = calibration.calibration_injections(self.tables.sequence, self.tables.calibration)
        return distribution.summarize_chains_early(self.matched_of(injections), injections)

    @cached_property
    def calibration_rows(self) -> DataFrame:
        return calibration.calibration_rows(self.calibration_summary, self.tables.calibration)

    @cached_property
    def calibration_points(self) -> DataFrame:
        return calibration.calibration_points(self.calibration_rows)

    @cached_property
    def mixture_fits(self) -> DataFrame:
        return calibration.fit_mixtures(self.calibration_rows)

    @cached_property
    def chain_calibration(self) -> DataFrame:
        return calibration.calibrate_chains(self.mixture_fits)

    @cached_property
    def _shared_calibration(self) -> DataFrame:
        """The same from the summary of all samples, for plain results: one pass over the peaks gives both."""
        rows = calibration.calibration_rows(self.plain_summary, self.tables.calibration)
        return calibration.calibrate_chains(calibration.fit_mixtures(rows))

    # quantification

    def quantifiable(self, bs: bool) -> DataFrame:
        """Chain summary of all but the calibration samples.

        The plain one is the summary the calibration uses as well, and shares
        its exchange. With blank subtraction the calibration rows are left out
        before the row-level joins.
        """
        if not bs:
            return quantify.quantifiable(self.plain_summary)
        return distribution.summarize_chains(self.variant_rows(True, f"sample_type != '{CALIBRATION}'"))

    def results(self, bs: bool = True) -> DataFrame:
        """Concentrations per (sample, chain): plain only, or both variants."""
        calibrated = self.chain_calibration if bs else self._shared_calibration
        return quantify.quantify_chains(self.quantifiable(bs), calibrated, self.params, VARIANTS if bs else [""])

    def results_of(self, bs: bool, samples: Samples | int) -> DataFrame:
        """Concentrations of the chosen samples: names, a (batch, name) table, the first k, or all named ones.

        The first k of the plain results are cut from the summary that all share. Otherwise the names
        are known before the peaks are read for them.
        """
        if samples is None:
            return views.select_samples(self.results(bs), None)
        if isinstance(samples, int) and not bs:
            summary, calibrated = views.first_sample_rows(self.quantifiable(False), samples), self._shared_calibration
        else:
            chosen = views.first_samples(self.sample_list(), samples) if isinstance(samples, int) else samples
            summary, calibrated = self.chosen_summary(bs, chosen), self.chain_calibration
        return quantify.quantify_chains(summary, calibrated, self.params, VARIANTS if bs else [""])

    def chosen_summary(self, bs: bool, samples: Sequence[str] | DataFrame) -> DataFrame:
        return views.select_samples(self.narrowed(samples, bs).quantifiable(bs), samples)

    def class_results(self, bs: bool = True) -> DataFrame:
        return quantify.class_totals(self.results(bs), VARIANTS if bs else [""])

    def report(self, bs: bool = False) -> DataFrame:
        return quantify.concentration_report(
            self.results(bs), self.params.extract_volume, _variant(bs), self.tables.run_params
        )

    # wide layouts

    @cached_property
    def type_layout(self) -> DataFrame:
        """Sheets of the exports: one run of sheets per batch and sample type.

        Only samples with identified rows have a slot.
        """
        named = self.injections.filter("identified > 0 AND sample_name IS NOT NULL")
        named = named.filter(F.col("sample_type").isin(*SAMPLE_TYPES))
        return wide.sheet_layout(named, [BATCH, "sample_type"], self.sheet_width)

    @cached_property
    def report_layout(self) -> DataFrame:
        """Sheets of the report: one run of sheets per batch, for samples with results."""
        return wide.sheet_layout(self.sample_list(), [BATCH], self.sheet_width)

    def _placed(self, injections: DataFrame) -> DataFrame:
        """Injections with the sheet and slot of their sample, which so reach
        the peaks in the join that is made anyway."""
        return injections.join(self.type_layout, [BATCH, "sample_type", "sample_name"])

    def placed_rows(self, bs: bool | None) -> DataFrame:
        """Rows on sheets: all identified ones (None), or the homologues of a variant."""
        if bs is None:
            return identify.identified_rows(self.matched, self._placed(identify.injection_types(self.tables.sequence)))
        rows = identify.identified_rows(self.matched, self._placed(self.injections))
        rows = identify.without_istd(identify.normalize(rows))
        return self._subtract(rows) if bs else rows

    def _export(self, rows: DataFrame, value: str) -> DataFrame:
        keys = [BATCH, *EXPORT_KEYS]
        return wide.to_sheets(rows, keys, value, self.sheet_width).orderBy(*EXPORT_ORDER)

    def raw_export(self) -> DataFrame:
        return self._export(self.placed_rows(None), "peak_area")

    def normalized_export(self, bs: bool = True) -> DataFrame:
        return self._export(self.placed_rows(bs), f"ratio{_variant(bs)}")

    def report_wide(self, bs: bool = True) -> DataFrame:
        placed = attach(self.report(bs), self.report_layout, [BATCH, "sample_name"])
        return wide.to_sheets(placed, [BATCH, "label"], "amount", self.sheet_width).orderBy(*REPORT_ORDER)

    # chart tables

    @cached_property
    def istd_points(self) -> DataFrame:
        return views.istd_points(self.injections)

    @cached_property
    def istd_limits(self) -> DataFrame:
        return views.istd_limits(self.istd_points)

    def istd_chart(self) -> DataFrame:
        return views.istd_chart(self.istd_points, self.istd_limits)

    def sample_list(self) -> DataFrame:
        """Samples with results: those of any type but calibration that have homologue rows."""
        return views.sample_list(self.injections.filter(f"homologues > 0 AND sample_type != '{CALIBRATION}'"))

    def class_bars(self, bs: bool, samples: Samples | int = 6) -> DataFrame:
        """Class concentrations of the chosen samples: names, first k, or all."""
        variant = _variant(bs)
        return views.class_bars(quantify.class_totals(self.results_of(bs, samples), [variant]), variant)

    def chain_bars(self, bs: bool, samples: Samples | int = 6) -> DataFrame:
        return views.chain_bars(self.results_of(bs, samples), _variant(bs))

    def response_vs_level(self) -> DataFrame:
        return views.response_vs_level(self.calibration_points, self.mixture_fits)

    def factor_vs_content(self) -> DataFrame:
        return views.factor_vs_content(self.mixture_fits, self.chain_calibration)

    def calibration_report(self, chains: Sequence[int] | None = None) -> DataFrame:
        """Both panels of the given chains, or of every calibrated one."""
        return views.calibration_report(self.response_vs_level(), self.factor_vs_content(), chains)

    def profile_relative(self, bs: bool, samples: Samples = None) -> DataFrame:
        return views.profile_relative(self.chosen_rows(bs, samples), _variant(bs), self.params)

    def profile_absolute(self, bs: bool, samples: Samples = None) -> DataFrame:
        return views.profile_absolute(self.chosen_rows(bs, samples), _variant(bs), self.params)

    # checks

    def duplicate_keys(self) -> DataFrame:
        return contracts.duplicate_keys(self.tables, self.typed_rows)

    def key_summary(self) -> DataFrame:
        return contracts.key_summary(self.tables, self.typed_rows)

    def istd_missing(self) -> DataFrame:
        return contracts.istd_missing(self.injections)

    def sample_types_present(self) -> DataFrame:
        return contracts.sample_types_present(self.typed_rows)
