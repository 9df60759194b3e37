"""Chain totals, homologue shares and chlorine content.

The share-weighted chlorine content of a chain is the ratio of two sums, so one
grouped aggregation yields it together with the total. Summaries never hold peak rows
together: a hot (sample, chain) is combined on the map side. Shares need a row beside its chain's
total; that window's groups are what the mass list has for one chain.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from paraspark.functions.exact import AREAS, RATIOS, exact_sum
from paraspark.functions.numeric import ratio, total
from paraspark.operators.identify import ISTD_CANDIDATE, injection_types
from paraspark.operators.joins import aggregate, attach
from paraspark.schema import BATCH, CALIBRATION, ISTD_IDENTITY, VARIANTS

CHAIN_KEYS = (BATCH, "sample_name", "sample_type", "chain_length")

# Filtering on this aggregate instead of the type key keeps the filter above
# the aggregation, so calibration and quantification share its exchange.
# NULL for rows without a type, which neither of them uses.
_IS_CALIBRATION = f"bool_or(sample_type = '{CALIBRATION}')"


def _content(v: str) -> str:
    """Cl% from the weighted sum; 0 when the chain has no total."""
    return f"coalesce({ratio(f'weighted{v}', f'chain_total{v}')}, 0.0D) AS chain_cl_degree{v}"


def summarize_chains(rows: DataFrame, variants: Sequence[str] = VARIANTS) -> DataFrame:
    """Total ratio and Cl% per (sample, chain) of homologue rows.

    A name has one sample type (a contract check); carrying it as a key keeps
    the aggregation on the hash path. Homologues outside the chlorine range
    count in the total only.
    """
    measures = {"is_calibration": _IS_CALIBRATION}
    for v in variants:
        measures[f"chain_total{v}"] = total(f"ratio{v}")
        measures[f"weighted{v}"] = f"sum(cl_degree * ratio{v})"
    grouped = aggregate(rows, CHAIN_KEYS, **measures)
    return grouped.selectExpr(
        *CHAIN_KEYS,
        "is_calibration",
        *[f"chain_total{v}" for v in variants],
        *[_content(v) for v in variants],
    )


def summarize_chains_early(matched: DataFrame, sequence: DataFrame) -> DataFrame:
    """The plain variant of :func:`summarize_chains`, aggregated before any join
    to injections.

    The standard's area is one number per injection, so areas are added up per
    (injection, chain) first and divided afterwards: peaks are read once and
    only chain-level rows are shuffled. The window runs on those rows, where an
    injection has no more rows than the mass list has chains. Both sums are exact, so equal
    samples have equal totals, which the calibration tells apart.
    """
    kept = f"retention_time IS NOT NULL AND row_identity != '{ISTD_IDENTITY}'"
    per_injection = aggregate(
        matched,
        [BATCH, "replicate", "chain_length"],
        area=exact_sum("peak_area", AREAS, kept),
        weighted_area=exact_sum("cl_degree * peak_area", AREAS, kept),
        istd_candidate=f"max({ISTD_CANDIDATE})",
        homologues=f"count_if({kept})",
    )
    chains = per_injection.selectExpr(
        "*", f"max(istd_candidate) OVER (PARTITION BY {BATCH}, replicate) AS istd_area"
    ).filter("homologues > 0")
    named = attach(chains, injection_types(sequence), [BATCH, "replicate"])
    grouped = aggregate(
        named,
        CHAIN_KEYS,
        is_calibration=_IS_CALIBRATION,
        chain_total=f"coalesce({exact_sum(ratio('area', 'istd_area'), RATIOS)}, 0.0D)",
        weighted=exact_sum(ratio("weighted_area", "istd_area"), RATIOS),
    )
    return grouped.selectExpr(*CHAIN_KEYS, "is_calibration", "chain_total", _content(""))


def distribute(rows: DataFrame, variants: Sequence[str] = VARIANTS) -> DataFrame:
    """Homologue rows with their chain's totals and their share in percent.

    The rows are exchanged once, by chain, and read once: totals are sums over the rows beside
    them. One sample's chain has as many rows as the mass list has homologues of it; where a name
    is used again or rows repeat, which the contract checks report, groups are larger and spill.
    Exact duplicates are not removed: the pivot key check rejects them before, as the wide raw
    export does.
    """
    over = f"OVER (PARTITION BY {', '.join(CHAIN_KEYS)})"
    totals, contents, shares = [], [], []
    for v in variants:
        totals += [f"{total(f'ratio{v}', over)} AS chain_total{v}", f"sum(cl_degree * ratio{v}) {over} AS weighted{v}"]
        contents.append(_content(v))
        shares.append(f"{ratio(f'ratio{v}', f'chain_total{v}')} * 100 AS share_pct{v}")
    dropped = ", ".join(f"weighted{v}" for v in variants)
    return (
        rows.selectExpr("*", *totals)
        .selectExpr("*", *contents, *shares)
        .selectExpr(f"* EXCEPT ({dropped})")
    )
