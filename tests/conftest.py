from __future__ import annotations

import pytest
from pyspark.sql import SparkSession

from paraspark import schema as S


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("paraspark-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_tables(spark):
    """Assay tables from lists of tuples in schema order."""

    def make(peaks=(), sequence=(), mass_list=(), calibration=(), blank_map=(), run_params=None):
        def frame(rows, schema):
            return spark.createDataFrame([tuple(r) for r in rows], schema)

        return S.AssayTables(
            peaks=frame(peaks, S.PEAKS),
            sequence=frame(sequence, S.SEQUENCE),
            mass_list=frame(mass_list, S.MASS_LIST),
            calibration=frame(calibration, S.CALIBRATION_MIXTURES),
            blank_map=frame(blank_map, S.BLANK_MAP),
            run_params=None if run_params is None else frame(run_params, S.RUN_PARAMS),
        )

    return make


def rows(df, *columns):
    """Rows as sorted tuples, NULL last."""
    chosen = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in chosen.collect()), key=lambda r: [(v is None, str(v)) for v in r])
