"""One stored stage that every export, report and chart of an assay reads.

The peak source is read once, to match it to the mass list; from what is stored then follow the
injections and the main frame, every identified row with its sample, ratio and subtracted ratio.
Outputs read these tables: none matches, normalises or subtracts again.

A stage is a folder the caller names, on storage that all nodes share:

- ``attempt=<id>/matched``: peaks on the mass list, by batch and injection bucket,
- ``attempt=<id>/injections``: one row per injection,
- ``attempt=<id>/rows``: the main frame, by batch and sample type, injections together,
- ``commits``: one small file for each finished attempt, written last.

Only what a commit names is ever read. A run that lost a write, or its driver, has no commit: the
next one starts a new attempt beside the unfinished one, which nothing reads and its owner may
delete. A run that finds a commit reads that attempt and writes nothing; where two runs raced, all
readers take the commit that was written first. The settings that change numbers are kept in
the commit, and a stage of other settings is refused. The input tables are not compared: a stage is as
old as its commit.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass
from functools import cached_property

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paraspark.operators import blanks, distribution, identify, views, wide
from paraspark.operators.joins import attach
from paraspark.plans.assay import Assay, Samples
from paraspark.schema import BATCH, CALIBRATION, AssayParams, AssayTables

BUCKETS = 16
COMMIT = "attempt string, written_at timestamp, settings string"


@dataclass(frozen=True)
class Stage:
    """The tables of a committed attempt."""

    matched: DataFrame
    injections: DataFrame
    rows: DataFrame


class StagedAssay(Assay):
    """An assay whose outputs read a stage. Results are those of :class:`Assay`."""

    def __init__(
        self,
        tables: AssayTables,
        stage: Stage,
        params: AssayParams | None = None,
        sheet_width: int = wide.SHEET_WIDTH,
    ):
        super().__init__(tables, params, sheet_width)
        self.stage = stage

    @cached_property
    def matched(self) -> DataFrame:
        return self.stage.matched.drop("bucket")

    def matched_of(self, injections: DataFrame) -> DataFrame:
        return identify.peaks_of(self.matched, injections)

    @cached_property
    def injections(self) -> DataFrame:
        return self.stage.injections

    @cached_property
    def subtracted(self) -> DataFrame:
        return self.stage.rows.drop("bucket")

    @cached_property
    def rows(self) -> DataFrame:
        return self.subtracted.drop("ratio_bs")

    @cached_property
    def typed_rows(self) -> DataFrame:
        return self.rows.drop("istd_area", "blank_label", "ratio")

    def variant_rows(self, bs: bool, where: str = "true") -> DataFrame:
        return identify.without_istd(self.subtracted if bs else self.rows).filter(where)

    def chosen_rows(self, bs: bool, samples: Samples) -> DataFrame:
        return views.select_samples(self.variant_rows(bs), samples)

    def chosen_summary(self, bs: bool, samples: Sequence[str] | DataFrame) -> DataFrame:
        rows = self.variant_rows(bs, f"sample_type != '{CALIBRATION}'")
        return distribution.summarize_chains(views.select_samples(rows, samples), ["", "_bs"] if bs else [""])

    def placed_rows(self, bs: bool | None) -> DataFrame:
        rows = self.rows if bs is None else self.variant_rows(bs)
        return rows.join(self.type_layout, [BATCH, "sample_type", "sample_name"])


def _settings(params: AssayParams) -> str:
    return json.dumps(asdict(params), sort_keys=True)


def committed(spark: SparkSession, path: str) -> tuple[str, str] | None:
    """(attempt, settings) of the stage under ``path``; None while no attempt has finished."""
    try:
        first = spark.read.schema(COMMIT).json(f"{path}/commits").orderBy("written_at", "attempt").first()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return None if first is None else (first["attempt"], first["settings"])


def _dealt(rows: DataFrame, folders: Sequence[str], buckets: int) -> DataFrame:
    """Rows dealt to writers by folder and injection bucket, injections together within a file.

    A rebalance cuts what is too large for one writer, be it a batch or a single injection, and puts
    small ones together.
    """
    bucketed = rows.withColumn("bucket", F.pmod(F.xxhash64("replicate"), F.lit(buckets)).cast("int"))
    keys = list(dict.fromkeys([*folders, "bucket"]))
    return bucketed.hint("rebalance", *[F.col(c) for c in keys]).sortWithinPartitions(*keys, "replicate")


def _write(rows: DataFrame, path: str, folders: Sequence[str] = ()) -> DataFrame:
    """Write a table of a new attempt and read it back with its own schema."""
    rows.write.mode("errorifexists").partitionBy(*folders).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _open(assay: Assay, folder: str, buckets: int, write: bool) -> Stage:
    """The tables of an attempt, written in turn, each from the one before, or just opened."""
    spark = assay.tables.peaks.sparkSession

    def table(rows: DataFrame, name: str, folders: Sequence[str] = ()) -> DataFrame:
        if write:
            return _write(rows, f"{folder}/{name}", folders)
        return spark.read.schema(rows.schema).parquet(f"{folder}/{name}")

    matched = table(_dealt(assay.matched, [BATCH, "bucket"], buckets), "matched", [BATCH, "bucket"])
    injections = table(
        identify.describe_injections(
            identify.istd_areas(matched.drop("bucket")), assay.tables.sequence, assay.tables.blank_map
        ),
        "injections",
    )
    rows = identify.normalize(identify.identified_rows(matched.drop("bucket"), injections))
    net = blanks.subtract_blanks(rows, blanks.blank_means(rows), assay.params)
    frame = table(_dealt(net, [BATCH, "sample_type"], buckets), "rows", [BATCH, "sample_type"])
    return Stage(matched, injections, frame)


def stage_assay(assay: Assay, path: str, buckets: int = BUCKETS) -> StagedAssay:
    """The assay on its stage under ``path``, which is written first if there is none."""
    spark, path = assay.tables.peaks.sparkSession, path.rstrip("/")
    found = committed(spark, path)
    if found is None:
        attempt = uuid.uuid4().hex
        _open(assay, f"{path}/attempt={attempt}", buckets, write=True)
        commit = spark.range(1).select(
            F.lit(attempt).alias("attempt"),
            F.current_timestamp().alias("written_at"),
            F.lit(_settings(assay.params)).alias("settings"),
        )
        commit.coalesce(1).write.mode("append").json(f"{path}/commits")
        found = committed(spark, path)
    attempt, settings = found
    if settings != _settings(assay.params):
        raise ValueError(f"the stage under {path} was written with other settings: {settings}")
    stage = _open(assay, f"{path}/attempt={attempt}", buckets, write=False)
    return StagedAssay(assay.tables, stage, assay.params, assay.sheet_width)
