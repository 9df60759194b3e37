"""The quantification on Python lists, one batch and one step at a time.

Small and slow on purpose: it follows the definitions row by row and shares no
code with the engine.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict


def _number(text):
    try:
        return float(text)
    except (TypeError, ValueError):
        return None


def _half_even(x):
    return None if x is None else round(x)


def _div(a, b):
    return None if a is None or b is None or b == 0 else a / b


def _sum(values):
    return math.fsum(v for v in values if v is not None)


def _same(x):
    return None if x is None else f"{x:.11e}"


def _content(n, m):
    if n is None or m is None:
        return None
    return m * 35.5 / (m * 35.5 + n * 12 + (2 * n + 2 - m)) * 100


def homologues(t, istd="C'10Cl6H16", passthrough=False):
    """Identified homologue rows with both ratios, totals, shares and Cl%."""
    targets = defaultdict(list)
    for _, formula, mz, _, rt, identity in t["mass_list"]:
        if mz is not None:
            targets[formula, _half_even(mz)].append((formula, rt, identity))
    injections = {r: (name, kind) for _, r, name, kind in t["sequence"]}
    labels = {name: label for _, name, label in t["blank_map"]}

    matched = []
    for _, replicate, formula, mz, area in t["peaks"]:
        for target in targets.get((formula, _half_even(mz)), []):
            matched.append((replicate, mz, _number(area), *target))
    standard = {}
    for replicate, _, area, formula, *_ in matched:
        value = area if formula == istd else 0.0
        if value is not None:
            standard[replicate] = max(standard.get(replicate, value), value)

    rows = []
    for replicate, mz, area, formula, rt, identity in matched:
        if rt is None:
            continue
        name, kind = injections.get(replicate, (None, None))
        label = "ISTD" if formula == istd else formula
        n = re.match(r"C'?(\d+)", label)
        m = re.search(r"Cl(\d+)", label)
        n = int(n.group(1)) if n else None
        m = int(m.group(1)) if m and 4 <= int(m.group(1)) <= 12 else None
        rows.append(
            dict(
                sample_name=name, sample_type=kind, mz=mz, retention_time=rt, row_identity=identity,
                molecular_formula=label, peak_area=area, istd_area=standard.get(replicate), chain_length=n,
                cl_no=m, label=labels.get(name), ratio=_div(area, standard.get(replicate)), cl_degree=_content(n, m),
            )
        )

    blank = defaultdict(list)
    for r in rows:
        if r["sample_type"] == "Blank":
            blank[r["molecular_formula"], r["sample_name"]].append(r["ratio"])
    by_label = {}
    for (formula, name), values in blank.items():
        values = [v for v in values if v is not None]
        by_label[formula, labels.get(name)] = math.fsum(values) / len(values) if values else 0.0
    for r in rows:
        mean = by_label.get((r["molecular_formula"], r["label"]))
        if r["sample_type"] is None or r["ratio"] is None:
            net = None
        elif r["sample_type"] == "Calibration" or (passthrough and r["label"] is None):
            net = r["ratio"]
        else:
            net = None if mean is None else r["ratio"] - mean
        r["ratio_bs"] = None if net is None else max(net, 0.0)

    rows = [r for r in rows if r["row_identity"] != "000_ISTD"]
    groups = defaultdict(list)
    for r in rows:
        groups[r["sample_name"], r["chain_length"]].append(r)
    for group in groups.values():
        for v in ("", "_bs"):
            total = _sum(r[f"ratio{v}"] for r in group)
            for r in group:
                r[f"chain_total{v}"] = total
                share = _div(r[f"ratio{v}"], total)
                r[f"share_pct{v}"] = None if share is None else share * 100
            content = _sum(
                r["cl_degree"] * r[f"share_pct{v}"] / 100
                for r in group
                if r["cl_degree"] is not None and r[f"share_pct{v}"] is not None
            )
            for r in group:
                r[f"chain_cl_degree{v}"] = content
    return rows


def mixture_fits(t, rows):
    info = {name: (kind, level, chains) for _, name, kind, level, chains in t["calibration"]}
    points, contents = defaultdict(dict), defaultdict(dict)
    for r in rows:
        if r["sample_type"] != "Calibration" or r["sample_name"] not in info:
            continue
        kind, level, chains = info[r["sample_name"]]
        if chains is None or str(r["chain_length"]) not in chains:
            continue
        key = kind, r["chain_length"]
        points[key][level, _same(r["chain_total"])] = (level, r["chain_total"])
        contents[key][_same(r["chain_cl_degree"])] = r["chain_cl_degree"]
    fits = {}
    for key, found in points.items():
        xy = math.fsum(x * y for x, y in found.values())
        xx = math.fsum(x * x for x, _ in found.values())
        yy = math.fsum(y * y for _, y in found.values())
        mean = math.fsum(contents[key].values()) / len(contents[key])
        fits[key] = dict(cl_degree=mean, slope=_div(xy, xx), r_squared=_div(xy * xy, xx * yy))
    return fits


def chain_calibration(fits):
    chains = defaultdict(list)
    for (_, n), f in fits.items():
        chains[n].append(f)
    lines = {}
    for n, group in chains.items():
        x = [f["cl_degree"] for f in group if f["slope"] is not None]
        y = [f["slope"] for f in group if f["slope"] is not None]
        line = dict(min=min(f["cl_degree"] for f in group), max=max(f["cl_degree"] for f in group))
        line.update(intercept=None, slope=None)
        if y:
            mx, my = math.fsum(x) / len(x), math.fsum(y) / len(y)
            sxx = math.fsum((a - mx) ** 2 for a in x)
            line["intercept"] = my
            if math.sqrt(sxx) >= 1e-7 * math.sqrt(math.fsum(a * a for a in x)) and sxx > 0:
                line["slope"] = math.fsum((a - mx) * (b - my) for a, b in zip(x, y)) / sxx
                line["intercept"] = my - line["slope"] * mx
        lines[n] = line
    return lines


def results(rows, lines):
    out = {}
    for r in rows:
        if r["sample_type"] in (None, "Calibration"):
            continue
        n = r["chain_length"]
        line = lines.get(n)
        kind = "SCCPs" if n in (10, 11, 12, 13) else "MCCPs" if n in (14, 15, 16, 17) else "LCCPs"
        res = dict(cp_type=kind)
        for v in ("", "_bs"):
            rf = None
            if line and line["slope"] is not None and line["intercept"] is not None:
                content = min(max(r[f"chain_cl_degree{v}"], line["min"]), line["max"])
                rf = max(line["intercept"] + line["slope"] * content, 1.0)
            res[f"rf{v}"] = rf
            res[f"conc{v}"] = _div(r[f"chain_total{v}"], rf)
        out[r["sample_name"], n] = res
    return out


def report(found, variant, volume=100.0):
    out, classes = {}, defaultdict(list)
    for (name, n), r in found.items():
        conc = r[f"conc{variant}"]
        out[name, None if n is None else str(n)] = None if conc is None else conc * volume
        classes[name, r["cp_type"]].append(conc)
    for key, values in classes.items():
        out[key] = _sum(values) * volume
    return out
