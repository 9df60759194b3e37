"""The registered queries as plain SQL over the test tables.

Written for an engine without Spark: step-by-step CTEs with window functions,
independent of how the plans are composed.
"""

from __future__ import annotations

from paraspark.operators.wide import SHEET_WIDTH, slot_names

_INPUT = """
cells AS (
  SELECT CAST(1 + l_orderkey % 2 AS INTEGER) AS batch_id, l_suppkey AS s,
         10 + p_size % 9 AS n, 3 + l_partkey % 11 AS m,
         SUM(CAST(ROUND(l_extendedprice * 100) AS BIGINT)) AS cents
  FROM lineitem JOIN part ON l_partkey = p_partkey
  GROUP BY 1, 2, 3, 4
),
standards AS (
  SELECT CAST(1 + l_orderkey % 2 AS INTEGER) AS batch_id, l_suppkey AS s,
         CAST(SUM(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS istd_area
  FROM lineitem GROUP BY 1, 2
),
injections AS (
  SELECT b.batch_id, s_suppkey AS s, 'S' || s_suppkey AS sample_name,
         CASE WHEN s_suppkey % 10 = 1 THEN 'Blank'
              WHEN s_suppkey % 10 BETWEEN 2 AND 5 THEN 'Calibration'
              WHEN s_suppkey % 10 = 6 THEN 'QC' ELSE 'Sample' END AS sample_type,
         CASE WHEN s_suppkey % 10 <> 9 THEN 'BLK' || (s_suppkey // 10) END AS blank_label
  FROM supplier, (VALUES (1), (2)) AS b(batch_id)
),
mixtures AS (
  SELECT batch_id, sample_name, 'MIX' || (s % 10) AS calibration_type,
         CAST(1 + (s // 10) % 5 AS DOUBLE) AS calibration_level,
         '10,11,12,13,14,15,16,17,18' AS chain_length_info
  FROM injections WHERE sample_type = 'Calibration'
),
all_peaks AS (
  SELECT batch_id, s, n, m,
         'C' || n || 'H' || (2 * n + 2 - m) || 'Cl' || m AS formula,
         n * 12.0e0 + m * 34.96885e0 + (n * 2 + 2 - m) * 1.007825e0 AS mz,
         CASE WHEN (s + n + m) % 37 = 0 THEN NULL
              WHEN s % 10 = 1 THEN CAST(cents * (10 + m * (s % 4)) AS DOUBLE) / 1000 / 50
              ELSE CAST(cents * (10 + m * (s % 4)) AS DOUBLE) / 1000 END AS peak_area
  FROM cells
),
peaks AS (
  SELECT batch_id, s, CAST(n AS INTEGER) AS chain_length,
         CASE WHEN m BETWEEN 4 AND 12 THEN CAST(m AS INTEGER) END AS cl_no, mz,
         n * 0.5e0 + m * 0.25e0 AS retention_time,
         'C' || n || '_Cl' || lpad(CAST(m AS VARCHAR), 2, '0') AS row_identity,
         formula AS molecular_formula, peak_area
  FROM all_peaks WHERE m <= 12
  UNION ALL
  SELECT batch_id, s, NULL, NULL, 355.97185e0, 7.5e0, '000_ISTD', 'ISTD', istd_area FROM standards
),
rows_ AS (
  SELECT p.batch_id, i.sample_name, i.sample_type, i.blank_label, p.mz, p.retention_time, p.row_identity,
         p.molecular_formula, p.peak_area, st.istd_area, p.chain_length, p.cl_no,
         p.peak_area / NULLIF(st.istd_area, 0) AS ratio
  FROM peaks p
  JOIN injections i ON i.batch_id = p.batch_id AND i.s = p.s
  JOIN standards st ON st.batch_id = p.batch_id AND st.s = p.s
)"""

# The same over the irregular tables: see the data's module for what differs.
_IRREGULAR = """
cells AS (
  SELECT CAST(1 + l_orderkey % 2 AS INTEGER) AS batch_id, l_suppkey AS s,
         10 + p_size % 9 AS n, 3 + l_partkey % 11 AS m,
         SUM(CAST(ROUND(l_extendedprice * 100) AS BIGINT)) AS cents
  FROM lineitem JOIN part ON l_partkey = p_partkey
  GROUP BY 1, 2, 3, 4
),
standards AS (
  SELECT CAST(1 + l_orderkey % 2 AS INTEGER) AS batch_id, l_suppkey AS s,
         CASE WHEN l_suppkey % 10 = 7 THEN 0 ELSE CAST(SUM(CAST(l_quantity AS BIGINT)) AS DOUBLE) END AS istd_area
  FROM lineitem WHERE NOT (l_suppkey % 10 = 7 AND l_orderkey % 2 = 0) GROUP BY 1, 2
),
injections AS (
  SELECT b.batch_id, s_suppkey AS s, 'S' || s_suppkey AS sample_name,
         CASE WHEN s_suppkey % 10 = 0 AND b.batch_id = 2 THEN NULL
              WHEN s_suppkey % 10 = 1 THEN 'Blank'
              WHEN s_suppkey % 10 BETWEEN 2 AND 5 THEN 'Calibration'
              WHEN s_suppkey % 10 = 6 THEN 'QC' ELSE 'Sample' END AS sample_type,
         CASE WHEN s_suppkey % 10 <> 9 AND s_suppkey <> 1 THEN 'BLK' || (s_suppkey // 10) END AS blank_label
  FROM supplier, (VALUES (1), (2)) AS b(batch_id)
),
mixtures AS (
  SELECT batch_id, sample_name, 'MIX' || (s % 10) AS calibration_type,
         CAST(1 + (s // 10) % 5 AS DOUBLE) AS calibration_level,
         CASE s % 10 WHEN 2 THEN '10,11,12,13' WHEN 3 THEN '12,13,14,15'
                     WHEN 4 THEN '10,11,12,13,14,15,16,17,18' ELSE '10,12,14,16' END AS chain_length_info
  FROM injections WHERE s % 10 BETWEEN 2 AND 5
),
once AS (
  SELECT batch_id, s, n, m,
         'C' || n || 'H' || (2 * n + 2 - m) || 'Cl' || m AS formula,
         n * 12.0e0 + m * 34.96885e0 + (n * 2 + 2 - m) * 1.007825e0 AS mz,
         CASE WHEN (s + n + m) % 37 = 0 THEN NULL
              WHEN (s + n + m) % 31 = 0 THEN 'NaN'
              WHEN (s + n + m) % 29 = 0 THEN 'n.d.' END AS unreadable,
         CASE WHEN (s + n + m) % 37 = 0 OR (s + n + m) % 31 = 0 OR (s + n + m) % 29 = 0 THEN NULL
              WHEN n = 16 AND s % 10 BETWEEN 2 AND 5 THEN CAST(cents * (10 + m * (s % 4)) AS DOUBLE) / 1000 / 1000000
              WHEN s % 10 = 1 THEN CAST(cents * (10 + m * (s % 4)) AS DOUBLE) / 1000 / 50
              ELSE CAST(cents * (10 + m * (s % 4)) AS DOUBLE) / 1000 END AS peak_area
  FROM cells
),
all_peaks AS (
  SELECT * FROM once UNION ALL SELECT * FROM once WHERE s % 10 = 3 AND n = 11
),
peaks AS (
  SELECT batch_id, s, CAST(n AS INTEGER) AS chain_length,
         CASE WHEN m BETWEEN 4 AND 12 THEN CAST(m AS INTEGER) END AS cl_no, mz,
         n * 0.5e0 + m * 0.25e0 AS retention_time,
         'C' || n || '_Cl' || lpad(CAST(m AS VARCHAR), 2, '0') AS row_identity,
         formula AS molecular_formula, peak_area
  FROM all_peaks WHERE m <= 12 AND NOT (n = 13 AND m = 5)
  UNION ALL
  SELECT batch_id, s, NULL, NULL, 355.97185e0, 7.5e0, '000_ISTD', 'ISTD', istd_area FROM standards
),
rows_ AS (
  SELECT p.batch_id, i.sample_name, i.sample_type, i.blank_label, p.mz, p.retention_time, p.row_identity,
         p.molecular_formula, p.peak_area, COALESCE(st.istd_area, 0) AS istd_area, p.chain_length, p.cl_no,
         p.peak_area / NULLIF(COALESCE(st.istd_area, 0), 0) AS ratio
  FROM peaks p
  JOIN injections i ON i.batch_id = p.batch_id AND i.s = p.s
  LEFT JOIN standards st ON st.batch_id = p.batch_id AND st.s = p.s
)"""

_BLANKS = """,
means AS (
  SELECT batch_id, molecular_formula, sample_name, blank_label, COALESCE(AVG(ratio), 0) AS blank_ratio
  FROM rows_ WHERE sample_type = 'Blank' GROUP BY ALL
)"""

_SUBTRACTED = """,
net AS (
  SELECT r.*,
         CASE WHEN r.sample_type = 'Calibration' THEN r.ratio {passthrough}
              WHEN r.sample_type IS NOT NULL THEN r.ratio - b.blank_ratio END AS net
  FROM rows_ r LEFT JOIN means b
    ON b.batch_id = r.batch_id AND b.molecular_formula = r.molecular_formula
   AND b.blank_label IS NOT DISTINCT FROM r.blank_label
),
subtracted AS (
  SELECT * EXCLUDE (net), CASE WHEN net IS NULL THEN NULL WHEN net > 0 THEN net ELSE 0.0 END AS ratio_bs FROM net
)"""
_PASS = "WHEN r.blank_label IS NULL THEN r.ratio"

_HOMOLOGUES = """,
totals AS (
  SELECT *,
    COALESCE(SUM(ratio) OVER w, 0) AS chain_total, COALESCE(SUM(ratio_bs) OVER w, 0) AS chain_total_bs,
    cl_no * 35.5e0 / (cl_no * 35.5e0 + chain_length * 12 + (chain_length * 2 + 2) - cl_no) * 100 AS cl_degree
  FROM subtracted WHERE row_identity <> '000_ISTD'
  WINDOW w AS (PARTITION BY batch_id, sample_name, chain_length)
),
shares AS (
  SELECT *, ratio / NULLIF(chain_total, 0) * 100 AS share_pct,
            ratio_bs / NULLIF(chain_total_bs, 0) * 100 AS share_pct_bs FROM totals
),
homologues AS (
  SELECT *, COALESCE(SUM(cl_degree * share_pct / 100) OVER w, 0) AS chain_cl_degree,
            COALESCE(SUM(cl_degree * share_pct_bs / 100) OVER w, 0) AS chain_cl_degree_bs
  FROM shares WINDOW w AS (PARTITION BY batch_id, sample_name, chain_length)
),
chains AS (
  SELECT batch_id, sample_name, sample_type, chain_length,
         ANY_VALUE(chain_total) AS chain_total, ANY_VALUE(chain_total_bs) AS chain_total_bs,
         ANY_VALUE(chain_cl_degree) AS chain_cl_degree, ANY_VALUE(chain_cl_degree_bs) AS chain_cl_degree_bs
  FROM homologues GROUP BY 1, 2, 3, 4
)"""

_CALIBRATION = """,
cal AS (
  SELECT c.*, x.calibration_type, x.calibration_level
  FROM chains c JOIN mixtures x ON x.batch_id = c.batch_id AND x.sample_name = c.sample_name
  WHERE c.sample_type = 'Calibration' AND contains(x.chain_length_info, CAST(c.chain_length AS VARCHAR))
),
points AS (
  SELECT batch_id, calibration_type, chain_length, calibration_level, MAX(chain_total) AS chain_total
  FROM cal GROUP BY 1, 2, 3, 4, chain_total
),
lines AS (
  SELECT batch_id, calibration_type, chain_length,
         SUM(calibration_level * chain_total) / NULLIF(SUM(calibration_level * calibration_level), 0) AS slope,
         POW(SUM(calibration_level * chain_total), 2)
           / NULLIF(SUM(calibration_level * calibration_level) * SUM(chain_total * chain_total), 0) AS r_squared
  FROM points GROUP BY 1, 2, 3
),
contents AS (
  SELECT batch_id, calibration_type, chain_length, AVG(chain_cl_degree) AS cl_degree FROM (
    SELECT batch_id, calibration_type, chain_length, MAX(chain_cl_degree) AS chain_cl_degree
    FROM cal GROUP BY 1, 2, 3, chain_cl_degree
  ) GROUP BY 1, 2, 3
),
mix AS (
  SELECT l.batch_id, l.calibration_type, l.chain_length, c.cl_degree, l.slope, l.r_squared
  FROM lines l JOIN contents c USING (batch_id, calibration_type, chain_length)
),
chain_fits AS (
  SELECT batch_id, chain_length, MIN(cl_degree) AS min_cl_degree, MAX(cl_degree) AS max_cl_degree,
         REGR_SXX(slope, cl_degree) >= 1e-14 * SUM(cl_degree * cl_degree) AND REGR_SXX(slope, cl_degree) > 0 AS varies, AVG(slope) AS mean_response,
         REGR_INTERCEPT(slope, cl_degree) AS a, REGR_SLOPE(slope, cl_degree) AS b, REGR_R2(slope, cl_degree) AS r2
  FROM mix GROUP BY 1, 2
),
chain_cal AS (
  SELECT batch_id, chain_length, min_cl_degree, max_cl_degree,
         CASE WHEN varies THEN a ELSE mean_response END AS intercept, CASE WHEN varies THEN b END AS slope,
         CASE WHEN varies THEN r2 ELSE 0 END AS r_squared
  FROM chain_fits
)"""

_RESULTS = """,
clamped AS (
  SELECT c.*, k.intercept, k.slope,
         CASE WHEN chain_length BETWEEN 10 AND 13 THEN 'SCCPs'
              WHEN chain_length BETWEEN 14 AND 17 THEN 'MCCPs' ELSE 'LCCPs' END AS cp_type,
         CASE WHEN chain_cl_degree < min_cl_degree THEN min_cl_degree
              WHEN chain_cl_degree > max_cl_degree THEN max_cl_degree
              WHEN min_cl_degree IS NOT NULL THEN chain_cl_degree END AS cl_degree_f,
         CASE WHEN chain_cl_degree_bs < min_cl_degree THEN min_cl_degree
              WHEN chain_cl_degree_bs > max_cl_degree THEN max_cl_degree
              WHEN min_cl_degree IS NOT NULL THEN chain_cl_degree_bs END AS cl_degree_f_bs
  FROM chains c LEFT JOIN chain_cal k USING (batch_id, chain_length)
  WHERE sample_type <> 'Calibration'
),
factors AS (
  SELECT *, CASE WHEN intercept + slope * cl_degree_f < 1 THEN 1 ELSE intercept + slope * cl_degree_f END AS rf,
            CASE WHEN intercept + slope * cl_degree_f_bs < 1 THEN 1
                 ELSE intercept + slope * cl_degree_f_bs END AS rf_bs FROM clamped
),
results AS (
  SELECT *, chain_total / rf AS conc, chain_total_bs / rf_bs AS conc_bs FROM factors
),
classes AS (
  SELECT batch_id, sample_name, cp_type,
         COALESCE(SUM(conc), 0) AS class_conc, COALESCE(SUM(conc_bs), 0) AS class_conc_bs
  FROM results GROUP BY 1, 2, 3
),
report AS (
  SELECT batch_id, sample_name, CAST(chain_length AS VARCHAR) AS label,
         conc * 100 AS amount, conc_bs * 100 AS amount_bs FROM results
  UNION ALL
  SELECT batch_id, sample_name, cp_type, class_conc * 100, class_conc_bs * 100 FROM classes
)"""


def _layout(group: str, source: str) -> str:
    return f""",
ranked AS (
  SELECT DISTINCT batch_id, {group} sample_name FROM {source}
),
positions AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY {group} batch_id ORDER BY sample_name) - 1 AS pos FROM ranked
),
layout AS (
  SELECT * EXCLUDE (pos), CAST(pos // {SHEET_WIDTH} AS INTEGER) AS sheet,
         CAST(pos % {SHEET_WIDTH} AS INTEGER) AS slot FROM positions
)"""


_TYPE_LAYOUT = _layout("sample_type,", "rows_")
_REPORT_LAYOUT = _layout("", "results")

_THROUGH_BLANKS = _INPUT + _BLANKS
_THROUGH_SUBTRACTED = _THROUGH_BLANKS + _SUBTRACTED.format(passthrough="")
_THROUGH_PASSTHROUGH = _THROUGH_BLANKS + _SUBTRACTED.format(passthrough=_PASS)
_THROUGH_CHAINS = _THROUGH_SUBTRACTED + _HOMOLOGUES
_THROUGH_CALIBRATION = _THROUGH_CHAINS + _CALIBRATION
_THROUGH_RESULTS = _THROUGH_CALIBRATION + _RESULTS
_IRREGULAR_SUBTRACTED = _IRREGULAR + _BLANKS + _SUBTRACTED.format(passthrough="")
_IRREGULAR_CHAINS = _IRREGULAR_SUBTRACTED + _HOMOLOGUES
_IRREGULAR_CALIBRATION = _IRREGULAR_CHAINS + _CALIBRATION
_VOLUME = "* CASE WHEN batch_id = 2 THEN 50 ELSE 100 END"
_IRREGULAR_RESULTS = _IRREGULAR_CALIBRATION + _RESULTS.replace("* 100", _VOLUME)
_THROUGH_PASSTHROUGH_RESULTS = _THROUGH_PASSTHROUGH + _HOMOLOGUES + _CALIBRATION + _RESULTS

_ROW_KEYS = "batch_id, sample_name, sample_type, row_identity, molecular_formula, chain_length, cl_no"


def _round(expression: str) -> str:
    """Two steps, as on the Spark side: first the float noise, then the digits."""
    return f"ROUND(ROUND({expression}, 9), 6)"


def _r(*names: str) -> str:
    """Select list with doubles rounded like the Spark side; ``a=b`` renames."""
    items = []
    for name in names:
        alias, _, source = name.partition("=")
        items.append(f"{_round(source or alias)} AS {alias}")
    return ", ".join(items)


def _sql(ctes: str, select: str) -> str:
    return f"WITH {ctes.strip()}\n{select}"


def _slots(value: str, width: int = SHEET_WIDTH) -> str:
    names = slot_names()[:width]
    return ", ".join(f"{_round(f'MAX(CASE WHEN slot = {i} THEN {value} END)')} AS {c}" for i, c in enumerate(names))


_EXPORT_KEYS = (
    "batch_id, ROUND(mz, 6) AS mz, ROUND(retention_time, 6) AS retention_time, row_identity,"
    " molecular_formula, sample_type, chain_length, cl_no, sheet"
)


def _wide(ctes: str, source: str, value: str, where: str = "TRUE", width: int = SHEET_WIDTH, tail: str = "") -> str:
    return _sql(
        ctes + _TYPE_LAYOUT,
        f"SELECT {_EXPORT_KEYS}, {_slots(value, width)} FROM {source}"
        f" JOIN layout USING (batch_id, sample_type, sample_name) WHERE {where}"
        f" GROUP BY batch_id, mz, retention_time, row_identity, molecular_formula, sample_type,"
        f" chain_length, cl_no, sheet {tail}",
    )


def _report_wide(value: str, width: int = SHEET_WIDTH) -> str:
    return _sql(
        _THROUGH_RESULTS + _REPORT_LAYOUT,
        f"SELECT batch_id, label, sheet, {_slots(value, width)} FROM report"
        f" JOIN layout USING (batch_id, sample_name) GROUP BY batch_id, label, sheet",
    )


def _profile(v: str, where: str = "TRUE") -> str:
    value = f"COALESCE(ratio{v}, 0)"
    batch_share = f"{value} / NULLIF(SUM({value}) OVER (PARTITION BY batch_id), 0) * 100"
    chain_share = f"{value} / NULLIF(SUM({value}) OVER (PARTITION BY batch_id, chain_length), 0) * 100"
    return _sql(
        _THROUGH_SUBTRACTED,
        f"SELECT batch_id, sample_name, 'C' || chain_length AS facet, chain_length, cl_no,"
        f" {_round(batch_share)} AS profile_total, {_round(chain_share)} AS profile_chain"
        f" FROM subtracted WHERE row_identity <> '000_ISTD' AND cl_no BETWEEN 4 AND 12 AND {where}",
    )


def _absolute(v: str, where: str = "TRUE") -> str:
    return _sql(
        _THROUGH_SUBTRACTED,
        f"SELECT batch_id, sample_name, 'C' || chain_length AS facet, chain_length, cl_no,"
        f" {_round(f'COALESCE(ratio{v}, 0)')} AS value"
        f" FROM subtracted WHERE row_identity <> '000_ISTD' AND cl_no BETWEEN 4 AND 12 AND {where}",
    )


_FIRST_SIX = """,
chosen AS (
  SELECT batch_id, sample_name FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY batch_id ORDER BY sample_name) AS pos
    FROM (SELECT DISTINCT batch_id, sample_name FROM results)
  ) WHERE pos <= 6
)"""


def _class_bars(v: str) -> str:
    return _sql(
        _THROUGH_RESULTS + _FIRST_SIX,
        f"SELECT batch_id, sample_name, cp_type, {_r(f'class_conc{v}')}"
        " FROM classes JOIN chosen USING (batch_id, sample_name)",
    )


def _chain_bars(v: str) -> str:
    return _sql(
        _THROUGH_RESULTS + _FIRST_SIX,
        f"SELECT batch_id, sample_name, chain_length, {_r(f'conc{v}')}"
        " FROM results JOIN chosen USING (batch_id, sample_name)",
    )


_ISTD = """,
istd AS (SELECT DISTINCT batch_id, sample_name, sample_type, istd_area FROM rows_),
limits AS (
  SELECT batch_id, AVG(istd_area) AS mean_area, STDDEV_SAMP(istd_area) AS sd_area,
         MAX(istd_area) * 1.2e0 AS axis_max FROM istd GROUP BY 1
)"""
_LIMITS = _r(
    "mean_area",
    "sd_area",
    "lower_1sd=mean_area - sd_area",
    "upper_1sd=mean_area + sd_area",
    "lower_2sd=mean_area - 2 * sd_area",
    "upper_2sd=mean_area + 2 * sd_area",
    "axis_max",
)


def _chain(v: str) -> str:
    return _sql(
        _THROUGH_RESULTS,
        "SELECT batch_id, sample_name, sample_type, chain_length, cp_type,"
        f" {_r(f'cl_degree_f{v}', f'rf{v}', f'conc{v}')} FROM results",
    )


def _shares(v: str) -> str:
    measures = _r(f"ratio{v}", f"chain_total{v}", f"share_pct{v}", "cl_degree", f"chain_cl_degree{v}")
    return _sql(_THROUGH_CHAINS, f"SELECT {_ROW_KEYS}, {measures} FROM homologues")


def _chain_measure(name: str) -> str:
    return _sql(_THROUGH_CHAINS, f"SELECT batch_id, sample_name, sample_type, chain_length, {_r(name)} FROM chains")


def _text(*columns: str) -> str:
    return " || '|' || ".join(f"COALESCE(CAST({c} AS VARCHAR), '<null>')" for c in columns)


_PIVOT_KEYS = (
    "mz", "retention_time", "row_identity", "molecular_formula", "sample_type", "chain_length", "cl_no", "sample_name",
)


def _qc_keys(unlisted: str) -> str:
    """Counts of every key that must be unique; ``unlisted`` injections have no assigned blank."""
    return f""",
listed AS (SELECT * FROM injections WHERE NOT ({unlisted})),
key_counts AS (
  SELECT 'pivot_key' AS check_name, batch_id, {_text(*_PIVOT_KEYS)} AS key, COUNT(*) AS n
    FROM rows_ GROUP BY batch_id, {", ".join(_PIVOT_KEYS)}
  UNION ALL SELECT 'replicates_per_sample', batch_id, {_text("sample_name")}, COUNT(*) FROM injections
    GROUP BY batch_id, sample_name
  UNION ALL SELECT 'sequence_replicate', batch_id, {_text("sample_name")}, COUNT(*) FROM injections
    GROUP BY batch_id, sample_name
  UNION ALL SELECT 'mass_list_ion', b.batch_id, n || ' ' || m, COUNT(*)
    FROM range(10, 19) AS c(n), range(3, 13) AS k(m), (VALUES (1), (2)) AS b(batch_id) GROUP BY b.batch_id, n, m
  UNION ALL SELECT 'mass_list_ion', b.batch_id, 'standard', 1 FROM (VALUES (1), (2)) AS b(batch_id)
  UNION ALL SELECT 'calibration_sample', batch_id, {_text("sample_name")}, COUNT(*) FROM mixtures
    GROUP BY batch_id, sample_name
  UNION ALL SELECT 'blank_map_sample', batch_id, {_text("sample_name")}, COUNT(*) FROM listed
    GROUP BY batch_id, sample_name
  UNION ALL SELECT 'blanks_per_label', batch_id, {_text("blank_label")}, COUNT(*) FROM injections
    WHERE sample_type = 'Blank' GROUP BY batch_id, blank_label
)"""


_QC_KEYS = _qc_keys("s % 10 = 9")
_IRREGULAR_QC_KEYS = _qc_keys("s % 10 = 9 OR s = 1")


_NAMED = "sample_name IN ('S1', 'S7', 'S8')"


def _calibration_report(where: str) -> str:
    return _sql(
        _THROUGH_CALIBRATION,
        "SELECT batch_id, chain_length, 'response_vs_level' AS panel, calibration_type, "
        + _r("x=calibration_level", "y=chain_total", "fit_intercept=0.0e0", "fit_slope=slope", "fit_r_squared=r_squared")
        + " FROM points JOIN lines USING (batch_id, calibration_type, chain_length)"
        f" WHERE {where} UNION ALL"
        " SELECT m.batch_id, m.chain_length, 'factor_vs_content', m.calibration_type, "
        + _r(
            "x=m.cl_degree", "y=m.slope", "fit_intercept=k.intercept", "fit_slope=k.slope",
            "fit_r_squared=k.r_squared",
        )
        + f" FROM mix m JOIN chain_cal k USING (batch_id, chain_length) WHERE {where.replace('chain_length', 'm.chain_length')}",
    )


# Queries on a stored stage, or on files written and read again, and those they must equal.
STAGED = {
    "staged_raw_export_wide": "raw_export_wide",
    "staged_normalized_export_wide_bs": "normalized_export_wide_bs",
    "staged_homologues": "homologues",
    "staged_calibration_report": "calibration_report",
    "staged_concentration_report": "concentration_report",
    "staged_concentration_report_bs": "concentration_report_bs",
    "staged_chain_bars_bs": "chain_bars_bs",
    "csv_concentration_report": "concentration_report",
    "csv_identified_peaks": "identified_peaks",
    "shared_list_report": "concentration_report",
}


def oracle_sql() -> dict[str, str]:
    sql = {
        "identified_peaks": _sql(
            _INPUT,
            f"SELECT {_ROW_KEYS}, {_r('mz', 'retention_time', 'peak_area', 'istd_area')} FROM rows_",
        ),
        "normalized_ratio": _sql(_INPUT, f"SELECT {_ROW_KEYS}, {_r('peak_area', 'istd_area', 'ratio')} FROM rows_"),
        "istd_control_limits": _sql(_INPUT + _ISTD, f"SELECT batch_id, {_LIMITS} FROM limits"),
        "istd_control_chart": _sql(
            _INPUT + _ISTD,
            f"SELECT batch_id, sample_name, sample_type, {_r('istd_area')}, {_LIMITS}"
            " FROM istd JOIN limits USING (batch_id)",
        ),
        "blank_means": _sql(
            _THROUGH_BLANKS,
            f"SELECT batch_id, molecular_formula, sample_name, blank_label, {_r('blank_ratio')} FROM means",
        ),
        "blank_subtracted": _sql(
            _THROUGH_SUBTRACTED, f"SELECT {_ROW_KEYS}, {_r('ratio', 'ratio_bs')} FROM subtracted"
        ),
        "blank_subtracted_passthrough": _sql(
            _THROUGH_PASSTHROUGH, f"SELECT {_ROW_KEYS}, {_r('ratio', 'ratio_bs')} FROM subtracted"
        ),
        "homologues": _sql(
            _THROUGH_CHAINS,
            f"SELECT {_ROW_KEYS}, "
            + _r(
                "mz", "retention_time", "peak_area", "istd_area", "ratio", "ratio_bs", "chain_total",
                "chain_total_bs", "share_pct", "share_pct_bs", "cl_degree", "chain_cl_degree", "chain_cl_degree_bs",
            )
            + " FROM homologues",
        ),
        "calibration_points": _sql(
            _THROUGH_CALIBRATION,
            "SELECT batch_id, calibration_type, chain_length, calibration_level,"
            f" {_r('chain_total')} FROM points",
        ),
        "response_fit": _sql(
            _THROUGH_CALIBRATION,
            f"SELECT batch_id, calibration_type, chain_length, {_r('slope', 'r_squared')} FROM lines",
        ),
        "response_vs_level": _sql(
            _THROUGH_CALIBRATION,
            "SELECT batch_id, calibration_type, chain_length, calibration_level,"
            f" {_r('chain_total', 'slope', 'r_squared')}"
            " FROM points JOIN lines USING (batch_id, calibration_type, chain_length)",
        ),
        "mixture_points": _sql(
            _THROUGH_CALIBRATION,
            f"SELECT batch_id, calibration_type, chain_length, {_r('cl_degree', 'slope', 'r_squared')} FROM mix",
        ),
        "factor_vs_content": _sql(
            _THROUGH_CALIBRATION,
            "SELECT m.batch_id, m.chain_length, m.calibration_type, "
            + _r(
                "cl_degree=m.cl_degree", "response_factor=m.slope", "fit_intercept=k.intercept",
                "fit_slope=k.slope", "fit_r_squared=k.r_squared",
            )
            + " FROM mix m JOIN chain_cal k USING (batch_id, chain_length)",
        ),
        "chain_calibration": _sql(
            _THROUGH_CALIBRATION,
            "SELECT batch_id, chain_length,"
            f" {_r('min_cl_degree', 'max_cl_degree', 'intercept', 'slope', 'r_squared')} FROM chain_cal",
        ),
        "calibration_report": _calibration_report("chain_length BETWEEN 10 AND 17"),
        "calibration_report_all": _calibration_report("TRUE"),
        "calibration_page": _calibration_report("chain_length = 12"),
        "class_windows": _sql(
            _THROUGH_RESULTS,
            f"SELECT batch_id, sample_name, chain_length, cp_type, {_r('conc', 'conc_bs')},"
            f" {_round('COALESCE(SUM(conc) OVER w, 0)')} AS class_conc,"
            f" {_round('COALESCE(SUM(conc_bs) OVER w, 0)')} AS class_conc_bs"
            " FROM results WINDOW w AS (PARTITION BY batch_id, sample_name, cp_type)",
        ),
        "concentration_report_bs_passthrough": _sql(
            _THROUGH_PASSTHROUGH_RESULTS,
            f"SELECT batch_id, sample_name, label, {_r('amount=amount_bs')} FROM report",
        ),
        "raw_export_wide": _wide(_INPUT, "rows_", "peak_area"),
        "normalized_export_wide": _wide(_INPUT, "rows_", "ratio", "row_identity <> '000_ISTD'"),
        "normalized_export_wide_bs": _wide(
            _THROUGH_SUBTRACTED, "subtracted", "ratio_bs", "row_identity <> '000_ISTD'"
        ),
        "sheet_layout": _sql(_INPUT + _TYPE_LAYOUT, "SELECT * FROM layout"),
        "export_preview": _wide(
            _INPUT,
            "rows_",
            "peak_area",
            "sample_type = 'Sample' AND sheet = 0",
            width=3,
            tail="ORDER BY batch_id, row_identity LIMIT 5",
        ),
        "report_preview": _report_wide("amount_bs", 4),
        "sample_list": _sql(_THROUGH_RESULTS, "SELECT DISTINCT batch_id, sample_name FROM results"),
        "mixture_table": _sql(_INPUT, "SELECT * FROM mixtures"),
        "sample_types_present": _sql(
            _INPUT,
            "SELECT batch_id, bool_or(sample_type = 'Blank') AS has_blank, bool_or(sample_type = 'Sample') AS has_sample,"
            " bool_or(sample_type = 'Calibration') AS has_calibration, bool_or(sample_type = 'QC') AS has_qc"
            " FROM rows_ GROUP BY batch_id",
        ),
        "qc_duplicate_keys": _sql(
            _IRREGULAR + _IRREGULAR_QC_KEYS, "SELECT check_name, batch_id, key, n FROM key_counts WHERE n > 1"
        ),
        "irregular_key_summary": _sql(
            _IRREGULAR + _IRREGULAR_QC_KEYS
            + ", all_counts AS (SELECT check_name, batch_id, n FROM key_counts"
            " UNION ALL SELECT 'run_params_batch', 2, 1)",
            "SELECT check_name, batch_id, COUNT(*) AS keys_checked, COUNT(*) FILTER (WHERE n > 1) AS duplicate_keys"
            " FROM all_counts GROUP BY 1, 2",
        ),
        "qc_key_summary": _sql(
            _INPUT + _QC_KEYS,
            "SELECT check_name, batch_id, COUNT(*) AS keys_checked, COUNT(*) FILTER (WHERE n > 1) AS duplicate_keys"
            " FROM key_counts GROUP BY 1, 2",
        ),
        "qc_istd_missing": _sql(
            _IRREGULAR,
            "SELECT DISTINCT batch_id, sample_name AS replicate, sample_name, sample_type, istd_area"
            " FROM rows_ WHERE istd_area IS NULL OR istd_area = 0",
        ),
        "qc_unmatched_peaks": _sql(
            _INPUT,
            "SELECT batch_id, formula, ROUND(mz, 6) AS mz, COUNT(*) AS peaks FROM all_peaks"
            " WHERE m > 12 GROUP BY batch_id, formula, mz",
        ),
    }
    sql["profile_absolute_named"] = _absolute("", _NAMED)
    sql |= {
        "irregular_peaks": _sql(
            _IRREGULAR, f"SELECT {_ROW_KEYS}, {_r('mz', 'retention_time', 'peak_area', 'istd_area')} FROM rows_"
        ),
        "irregular_homologues": _sql(
            _IRREGULAR_CHAINS,
            f"SELECT {_ROW_KEYS}, "
            + _r(
                "mz", "retention_time", "peak_area", "istd_area", "ratio", "ratio_bs", "chain_total",
                "chain_total_bs", "share_pct", "share_pct_bs", "cl_degree", "chain_cl_degree", "chain_cl_degree_bs",
            )
            + " FROM homologues",
        ),
        "irregular_calibration_points": _sql(
            _IRREGULAR_CALIBRATION,
            f"SELECT batch_id, calibration_type, chain_length, calibration_level, {_r('chain_total')} FROM points",
        ),
        "irregular_chain_calibration": _sql(
            _IRREGULAR_CALIBRATION,
            "SELECT batch_id, chain_length,"
            f" {_r('min_cl_degree', 'max_cl_degree', 'intercept', 'slope', 'r_squared')} FROM chain_cal",
        ),
        "irregular_concentrations": _sql(
            _IRREGULAR_RESULTS,
            "SELECT batch_id, sample_name, sample_type, chain_length, cp_type,"
            f" {_r('cl_degree_f', 'rf', 'conc', 'cl_degree_f_bs', 'rf_bs', 'conc_bs')} FROM results",
        ),
        "qc_bad_cells": _sql(
            _IRREGULAR,
            "SELECT 'peaks' AS table_name, 'area_raw' AS column_name, unreadable AS value, COUNT(*) AS cells"
            " FROM all_peaks WHERE unreadable IS NOT NULL GROUP BY unreadable"
            " UNION ALL SELECT 'mass_list', 'retention_time', 'NaN', 2",
        ),
        "irregular_report": _sql(_IRREGULAR_RESULTS, f"SELECT batch_id, sample_name, label, {_r('amount')} FROM report"),
        "irregular_report_bs": _sql(
            _IRREGULAR_RESULTS, f"SELECT batch_id, sample_name, label, {_r('amount=amount_bs')} FROM report"
        ),
    }
    positions = "ROW_NUMBER() OVER (PARTITION BY batch_id ORDER BY {}) AS position"
    sql["raw_export_ordered"] = sql["raw_export_wide"].replace(
        f"SELECT {_EXPORT_KEYS}",
        f"SELECT {positions.format('sample_type, sheet, row_identity, molecular_formula, mz')}, {_EXPORT_KEYS}",
    )
    sql["concentration_report_ordered"] = _report_wide("amount").replace(
        "SELECT batch_id, label, sheet", f"SELECT {positions.format('sheet, label')}, batch_id, label, sheet"
    )
    for v in ("", "_bs"):
        sql |= {
            f"profile_named{v}": _profile(v, _NAMED),
            f"chain_totals{v}": _chain_measure(f"chain_total{v}"),
            f"cl_degree{v}": _chain_measure(f"chain_cl_degree{v}"),
            f"relative_distribution{v}": _shares(v),
            f"concentration_chain{v}": _chain(v),
            f"concentration_class{v}": _sql(
                _THROUGH_RESULTS, f"SELECT batch_id, sample_name, cp_type, {_r(f'class_conc{v}')} FROM classes"
            ),
            f"concentration_report{v}": _sql(
                _THROUGH_RESULTS, f"SELECT batch_id, sample_name, label, {_r(f'amount=amount{v}')} FROM report"
            ),
            f"concentration_report_wide{v}": _report_wide(f"amount{v}"),
            f"profile_relative{v}": _profile(v),
            f"profile_absolute{v}": _absolute(v),
            f"class_bars{v}": _class_bars(v),
            f"chain_bars{v}": _chain_bars(v),
        }
    for staged, same in STAGED.items():
        sql[staged] = sql[same]
    return sql
