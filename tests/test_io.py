from __future__ import annotations

import os

import pytest

from paraspark import Assay
from paraspark import schema as S
from paraspark.schema import PEAKS
from paraspark.sinks import exports
from paraspark.sources import readers
from tests.conftest import rows
from tests.random_assay import merged, random_batch

LINES = ["C10Cl5H18,314.98275,120000,Spike_10ng", "C10Cl6H17,346.94669,#N/A,Spike_10ng"]
WANT = [(1, "Spike_10ng", "C10Cl5H18", 314.98275, "120000"), (1, "Spike_10ng", "C10Cl6H17", 346.94669, "#N/A")]


def write(path, header, lines):
    path.write_text("\n".join([header, *lines]) + "\n")
    return str(path)


@pytest.mark.parametrize(
    "header",
    [
        "Precursor Neutral Formula,Product Mz,Area,Replicate",
        "Precursor.Neutral.Formula,Product.Mz,Area,Replicate",
        "formula,mz,area_raw,replicate",
    ],
)
def test_peak_report_headers(spark, tmp_path, header):
    df = readers.read_peaks(spark, write(tmp_path / "p.csv", header, LINES), batch_id=1)
    assert rows(df) == WANT
    assert [f.name for f in df.schema] == [f.name for f in PEAKS]


def test_columns_are_found_by_name(spark, tmp_path):
    lines = ["x,Spike_10ng,120000,314.98275,C10Cl5H18"]
    path = write(tmp_path / "p.csv", "Protein,Replicate,Area,Product Mz,Precursor Neutral Formula", lines)
    assert rows(readers.read_peaks(spark, path, batch_id=1)) == WANT[:1]


def test_files_of_another_layout_fail(spark, tmp_path):
    first = write(tmp_path / "a.csv", "Precursor Neutral Formula,Product Mz,Area,Replicate", LINES)
    second = write(tmp_path / "b.csv", "Product Mz,Precursor Neutral Formula,Area,Replicate", ["1,C1,2,r"])
    with pytest.raises(Exception, match="header"):
        readers.read_peaks(spark, [first, second], batch_id=1).collect()


def test_missing_and_ambiguous_columns(spark, tmp_path):
    with pytest.raises(ValueError, match="formula"):
        readers.read_peaks(spark, write(tmp_path / "a.csv", "Area,Replicate", ["1,r"]), batch_id=1)
    with pytest.raises(ValueError, match="both"):
        readers.read_peaks(spark, write(tmp_path / "b.csv", "Product Mz,Product.Mz,Area", ["1,2,3"]), batch_id=1)
    with pytest.raises(ValueError, match="format"):
        readers.read_peaks(spark, str(tmp_path / "a.csv"), fmt="xlsx")


def test_batch_from_folder(spark, tmp_path):
    for b in (1, 2):
        (tmp_path / f"batch_id={b}").mkdir()
        write(tmp_path / f"batch_id={b}" / "p.csv", "Precursor Neutral Formula,Product Mz,Area,Replicate", LINES)
    got = readers.read_peaks(spark, str(tmp_path)).groupBy("batch_id").count().collect()
    assert sorted(map(tuple, got)) == [(1, 2), (2, 2)]


def test_example_table(spark):
    got = rows(readers.example_peaks(spark), "formula", "mz", "area_raw")
    assert got == [
        ("C10Cl5H18", 314.98275, "120000"), ("C10Cl6H17", 346.94669, "180000"), ("C10Cl7H16", 382.90479, "150000"),
    ]


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_assay_from_files_gives_the_same_report(spark, make_tables, tmp_path, fmt):
    tables = make_tables(**merged(random_batch(5, 1), random_batch(6, 2)), run_params=[(2, "C'10Cl6H16", 50.0)])
    for name in ("peaks", "sequence", "mass_list", "calibration", "blank_map", "run_params"):
        exports.write_table(getattr(tables, name), f"{tmp_path}/{name}", fmt)
    read = readers.read_assay(spark, str(tmp_path), fmt, run_params=True)
    assert rows(Assay(read).rows) == rows(Assay(tables).rows)
    assert rows(read.run_params) == rows(tables.run_params)
    assert readers.read_assay(spark, str(tmp_path), fmt).run_params is None


def test_export_folders(spark, make_tables, tmp_path):
    out = str(tmp_path / "out")
    assay = Assay(make_tables(**random_batch(5, 1)), sheet_width=4)
    exports.export_all(assay, out)
    exports.export_long(assay, out)
    assert {d for d in os.listdir(f"{out}/raw/batch_id=1") if "=" in d} == {
        "sample_type=Blank", "sample_type=Sample", "sample_type=Calibration", "sample_type=QC",
    }
    assert spark.read.parquet(f"{out}/raw").count() == assay.raw_export().count()
    assert spark.read.parquet(f"{out}/homologues").count() == assay.homologues.count()
    a = spark.read.parquet(f"{out}/concentrations_subtracted")
    b = spark.read.parquet(f"{out}/concentrations_not_subtracted")
    assert a.count() == b.count() > 0 and rows(a) != rows(b)
    assert "chain_length=12" in os.listdir(f"{out}/calibration_report")
    with pytest.raises(Exception, match="(?i)exist"):
        exports.export_raw(assay, out)


def test_csv_sheets_have_empty_cells(make_tables, tmp_path):
    batch = random_batch(5, 1)
    batch["sequence"] = [r for r in batch["sequence"] if r[3] != "QC"]
    assay = Assay(make_tables(**batch))
    everyone = sorted({r[2] for r in batch["sequence"] if r[2] is not None})
    written = exports.named_exports(assay, 1, dict.fromkeys(S.SAMPLE_TYPES, everyone), str(tmp_path))
    assert written == ["Blank", "Sample", "Calibration"]
    folder = tmp_path / "peak_area" / "Sample"
    text = "\n".join(p.read_text() for p in folder.iterdir() if p.suffix == ".csv")
    assert ",," in text and "null" not in text.lower() and "NaN" not in text


def test_bad_cells_are_rows(spark, tmp_path):
    for name in S.INPUT_TABLES:
        (tmp_path / name).mkdir()
    write(
        tmp_path / "peaks" / "run7.csv",
        "batch_id,Precursor Neutral Formula,Product Mz,Area,Replicate",
        ["1,C10Cl5H18,314.98,120,a", "1,C10Cl5H18,wide,#N/A,a", "1,C10Cl5H18,,12.5d,a", "x,C1,1,1,a", "1,C1,1", "1,C1,1,1,a,extra"],
    )
    write(tmp_path / "sequence" / "s.csv", "batch_id,Replicate,Sample name,Sample type", ["1,a,A,"])
    write(
        tmp_path / "mass_list" / "m.csv",
        "batch_id,molecular formula,m/z,adduct,retention time,row identity".replace("m/z", "mz"),
        ["1,C1,314.98,,NaN,C1", "1,,314.98,,7.5,C2"],
    )
    write(tmp_path / "calibration" / "c.csv", "batch_id,Sample name,Calibration type,Calibration level,Chain length info", ["1,A,M,high,10"])
    write(tmp_path / "blank_map" / "b.csv", "batch_id,Sample name,Blank sample", ["1,A,B"])
    found = readers.bad_cells(spark, str(tmp_path))
    assert rows(found, "table_name", "column_name", "value") == sorted(
        [
            ("calibration", "calibration_level", "high"),
            ("mass_list", "molecular_formula", None),
            ("mass_list", "retention_time", "NaN"),
            ("peaks", "area_raw", "12.5d"),
            ("peaks", "batch_id", "x"),
            ("peaks", "mz", "wide"),
            ("peaks", None, "1,C1,1"),
            ("peaks", None, "1,C1,1,1,a,extra"),
        ],
        key=lambda r: [(v is None, str(v)) for v in r],
    )
    assert {r["file_name"] for r in found.filter("table_name = 'peaks'").collect()} == {"run7.csv"}
    assert "1,C10Cl5H18,wide,#N/A,a" in {r["line"] for r in found.collect()}


def test_batch_from_file_name(spark, tmp_path):
    for b in (3, 14):
        write(tmp_path / f"run{b}_a.csv", "Precursor Neutral Formula,Product Mz,Area,Replicate", LINES)
    df = readers.read_peaks(spark, str(tmp_path), batch_id=r"run(\d+)")
    assert sorted(map(tuple, df.groupBy("batch_id").count().collect())) == [(3, 2), (14, 2)]


def test_shared_mass_list_with_a_standard_per_batch(spark, make_tables):
    """One list for all batches; a batch's own standard is the standard there and a homologue elsewhere."""
    other = "C11H18Cl6"
    targets = [(1, "C'10Cl6H16", 356.0, None, 7.5, "000_ISTD"), (1, other, 371.0, None, 5.0, "C11"), (1, "C12H20Cl6", 385.0, None, 6.0, "C12")]
    peaks = [(b, f"r{b}", f, mz, str(area)) for b in (1, 2) for (_, f, mz, *_), area in zip(targets, (10, 20, 30), strict=True)]
    sequence = [(b, f"r{b}", "A", "Sample") for b in (1, 2)]
    listed = make_tables(peaks=peaks, sequence=sequence, run_params=[(2, other, 50.0)],
                         mass_list=targets + [(2, *t[1:]) for t in targets])
    shared = S.AssayTables(**(vars(listed) | {"mass_list": listed.mass_list.filter("batch_id = 1").drop("batch_id")}))
    want = rows(Assay(listed).rows)
    assert rows(Assay(shared).rows.select(*Assay(listed).rows.columns)) == want
    assert {(r["batch_id"], r["istd_area"]) for r in Assay(shared).rows.collect()} == {(1, 10.0), (2, 20.0)}
    assert rows(Assay(shared).key_summary().filter("check_name = 'mass_list_ion'"), "batch_id", "duplicate_keys") == [(None, 0)]
