"""Match peaks to the mass list and to injections."""

from __future__ import annotations

from pyspark.sql import DataFrame

from paraspark.functions import chemistry as chem
from paraspark.functions.numeric import finite, number, ratio
from paraspark.operators.joins import aggregate, attach
from paraspark.schema import BATCH, ISTD_IDENTITY, ISTD_LABEL, AssayParams

IDENTIFIED_COLUMNS = (
    BATCH,
    "sample_name",
    "sample_type",
    "mz",
    "retention_time",
    "row_identity",
    "molecular_formula",
    "peak_area",
    "istd_area",
    "chain_length",
    "cl_no",
)

# A matched peak's contribution to the standard area of its injection.
ISTD_CANDIDATE = "CASE WHEN is_istd THEN peak_area ELSE 0.0D END"
# What a target's formula says.
_PARSED = ("chain_length", "cl_no", "cl_degree")


def prepare_targets(
    mass_list: DataFrame, params: AssayParams, run_params: DataFrame | None = None
) -> DataFrame:
    """Mass list with its join key and everything that depends on the formula.

    Carbons, chlorines and Cl% follow from the target alone, so the text is
    parsed once per target here and never per peak. A list without batches holds for all of them and
    stays as small however many there are; which of its targets is the standard of a batch with
    a formula of its own is told by :func:`match_targets`.
    """
    istd = chem.quoted(params.istd_formula)
    targets = mass_list
    if run_params is not None and BATCH in mass_list.columns:
        targets = attach(targets, run_params.selectExpr(BATCH, "istd_formula AS run_istd"), [BATCH])
        istd = f"coalesce(run_istd, {istd})"
    labelled = targets.selectExpr(
        *[c for c in (BATCH,) if c in targets.columns],
        "molecular_formula AS formula",
        f"{chem.mz_key('mz')} AS mz_key",
        f"molecular_formula = {istd} AS is_istd",
        "molecular_formula",
        f"{finite('retention_time')} AS retention_time",
        "row_identity",
    )
    chlorines = chem.chlorine_count("molecular_formula", params.formula_mode)
    parsed = labelled.selectExpr(
        "*",
        f"{chem.carbon_count('molecular_formula')} AS chain_length",
        f"{chem.in_domain(chlorines, params.cl_min, params.cl_max)} AS cl_no",
    ).selectExpr("*", f"{chem.chlorine_percent('chain_length', 'cl_no')} AS cl_degree")
    if BATCH in targets.columns or run_params is None:
        parsed = _label_istd(parsed)
    # Said of the label, which all branches join on, so that none adds it on its own.
    return parsed.filter("molecular_formula IS NOT NULL")


def _label_istd(targets: DataFrame) -> DataFrame:
    """The standard under its label; it has neither chain nor chlorines."""
    homologue = "CASE WHEN NOT is_istd THEN {0} END AS {0}"
    kept = [c for c in targets.columns if c not in ("molecular_formula", *_PARSED)]
    return targets.selectExpr(
        *kept,
        f"CASE WHEN is_istd THEN '{ISTD_LABEL}' ELSE molecular_formula END AS molecular_formula",
        *[homologue.format(c) for c in _PARSED],
    )


def match_targets(
    peaks: DataFrame, targets: DataFrame, params: AssayParams | None = None, run_params: DataFrame | None = None
) -> DataFrame:
    """Peaks found on the mass list, one row per (peak, target).

    Peaks without a target have no retention time and leave the pipeline
    anyway, so the join is an inner one. A missing m/z matches nothing.
    """
    keyed = peaks.selectExpr(
        BATCH,
        "replicate",
        "formula",
        "mz",
        f"{chem.mz_key('mz')} AS mz_key",
        f"{number('area_raw')} AS peak_area",
    )
    keys = [c for c in (BATCH, "formula", "mz_key") if c in targets.columns]
    found = keyed.join(targets, keys)
    if BATCH not in keys and run_params is not None:
        runs = run_params.selectExpr(BATCH, "istd_formula AS run_istd")
        istd = f"coalesce(run_istd, {chem.quoted((params or AssayParams()).istd_formula)})"
        own = attach(found, runs, [BATCH]).selectExpr("* EXCEPT (is_istd, run_istd)", f"formula = {istd} AS is_istd")
        found = _label_istd(own)
    return found.drop("formula", "mz_key")


def unmatched_peaks(peaks: DataFrame, targets: DataFrame) -> DataFrame:
    """Peaks without any mass-list entry, counted per ion."""
    keyed = peaks.selectExpr(BATCH, "formula", "mz", f"{chem.mz_key('mz')} AS mz_key")
    keys = [c for c in (BATCH, "formula", "mz_key") if c in targets.columns]
    lost = keyed.join(targets.select(*keys), keys, "left_anti")
    return aggregate(lost, [BATCH, "formula", "mz"], peaks="count(*)")


def peaks_of(peaks: DataFrame, injections: DataFrame) -> DataFrame:
    """Peaks of the given injections, reduced before they meet the mass list."""
    return peaks.join(injections.select(BATCH, "replicate"), [BATCH, "replicate"], "left_semi")


def istd_areas(matched: DataFrame) -> DataFrame:
    """What the peaks say of their injection, in one aggregate.

    The internal standard's area, 0 when there is none, runs over all matched peaks, before the
    retention-time filter; ``identified`` and ``homologues`` count the rows that pass it, with
    and without the standard. All combine on the map side, so a hot injection costs one row per task.
    """
    kept = "retention_time IS NOT NULL"
    return aggregate(
        matched,
        [BATCH, "replicate"],
        istd_area=f"max({ISTD_CANDIDATE})",
        identified=f"count_if({kept})",
        homologues=f"count_if({kept} AND row_identity != '{ISTD_IDENTITY}')",
    )


def injection_types(sequence: DataFrame) -> DataFrame:
    return sequence.select(BATCH, "replicate", "sample_name", "sample_type")


def label_blanks(injections: DataFrame, blank_map: DataFrame) -> DataFrame:
    """Injections with the label of their assigned blank."""
    labels = blank_map.selectExpr(BATCH, "sample_name", "blank_sample AS blank_label")
    return attach(injections, labels, [BATCH, "sample_name"])


def describe_injections(istd: DataFrame, sequence: DataFrame, blank_map: DataFrame) -> DataFrame:
    """One row per injection with sample, type, standard area, row counts and blank label."""
    injections = attach(istd, injection_types(sequence), [BATCH, "replicate"])
    return label_blanks(injections, blank_map)


def identified_rows(matched: DataFrame, injections: DataFrame, how: str = "inner") -> DataFrame:
    """Peaks with a retention time and the columns of their injection.

    All injection-level columns arrive in this one join of the large table.
    ``injections`` may be anything at injection grain: the described ones hold
    every injection with a matched peak, the plain sequence (joined ``left``)
    spares the pass over the peaks that finds their standard.
    """
    known = matched.filter("retention_time IS NOT NULL").drop("is_istd")
    return attach(known, injections.drop("identified", "homologues"), [BATCH, "replicate"], how=how)


def normalize(rows: DataFrame) -> DataFrame:
    """Area relative to the injection's internal standard."""
    return rows.selectExpr("*", f"{ratio('peak_area', 'istd_area')} AS ratio")


def without_istd(rows: DataFrame) -> DataFrame:
    """Homologue rows; a row without identity is dropped too."""
    return rows.filter(f"row_identity != '{ISTD_IDENTITY}'")


def of_type(rows: DataFrame, sample_type: str) -> DataFrame:
    return rows.filter(f"sample_type = {chem.quoted(sample_type)}")
