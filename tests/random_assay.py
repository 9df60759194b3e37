"""Random assays with every irregularity the rules speak about."""

from __future__ import annotations

import random

ISTD = "C'10Cl6H16"


def random_batch(seed: int, batch: int = 1) -> dict[str, list[tuple]]:
    rng = random.Random(seed)
    chains, chlorines = range(9, 19), range(3, 14)
    ions = {}
    for n in chains:
        for m in chlorines:
            if rng.random() < 0.6:
                formula = rng.choice([f"C{n}H{2 * n + 2 - m}Cl{m}", f"C{n}Cl{m}H{2 * n + 2 - m}"])
                ions[formula] = 12 * n + 34.97 * m + 1.008 * (2 * n + 2 - m)
    mass_list = [(batch, ISTD, 356.0, "x", rng.choice([None, 7.5]), "000_ISTD")]
    for formula, mz in ions.items():
        if rng.random() < 0.9:
            mass_list.append((batch, formula, mz, "x", None if rng.random() < 0.1 else rng.random() * 20, f"id_{formula}"))

    types = ["Sample"] * 5 + ["Blank"] * 2 + ["QC"] + ["Calibration"] * 9 + [None]
    sequence, blank_map, calibration, peaks = [], [], [], []
    blanks = 0
    for i, kind in enumerate(types):
        name, replicate = f"name{i:02d}", f"file{i:02d}"
        sequence.append((batch, replicate, name, kind))
        if kind == "Blank":
            if blanks == 0:
                blank_map.append((batch, name, "B1"))
            blanks += 1  # the second blank has no label
        elif rng.random() < 0.7:
            blank_map.append((batch, name, rng.choice(["B1", "unused", None])))
        if kind == "Calibration":
            mixture = i % 3
            info = rng.choice(["10,11,12,13", "9,10,11,12,13,14,15,16", "10,11,12,13,14,15,16,17", None])
            if rng.random() < 0.95:
                calibration.append((batch, name, f"MIX{mixture}", float(rng.choice([0, 1, 2, 5])), info))
        standard = rng.choice(["1000", "850.5", "0", "#N/A", None]) if rng.random() < 0.2 else str(rng.uniform(500, 1500))
        if rng.random() < 0.95:
            peaks.append((batch, replicate, ISTD, 356.2, standard))
        for formula, mz in ions.items():
            if rng.random() < 0.1:
                continue
            area = rng.choice(["#N/A", "", "abc", None, "0"]) if rng.random() < 0.1 else str(rng.uniform(0, 5000))
            peaks.append((batch, replicate, formula, None if rng.random() < 0.02 else mz, area))
    peaks.append((batch, "unlisted", ISTD, 356.0, "900"))
    peaks += [(batch, "unlisted", f, mz, "120") for f, mz in ions.items()]
    rng.shuffle(peaks)
    return dict(peaks=peaks, sequence=sequence, mass_list=mass_list, calibration=calibration, blank_map=blank_map)


def merged(*batches: dict[str, list[tuple]]) -> dict[str, list[tuple]]:
    return {name: [row for b in batches for row in b[name]] for name in batches[0]}
