"""Helpers that several operators of this package share."""

from __future__ import annotations

import math
import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paraspark.session import decided_settings, shared_folder

PREFIX_BLOCK = 128
ROWS_PER_BATCH = 500
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Only a session that runs on this machine alone may do without: it gets a folder of its own.
    Elsewhere the setting is needed, as executors could not see such a folder.
    """
    return shared_folder(spark)


def cut_lineage(frame: DataFrame) -> DataFrame:
    """``frame`` written once to the shared folder as a table and read from there.

    Unlike a checkpoint, what is read has neither the constraints nor the estimates of the
    plan before it, which grow from round to round in loops.
    """
    spark = frame.sparkSession
    path = f"{shared_dir(spark)}/stages/{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def prepare(spark: SparkSession) -> None:
    """Let Python workers find this package, and give them long rows in small batches.

    The batch size is only set where the session has none of its own. On a cluster
    whose nodes do not share the package's path it is shipped as usual.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if key not in decided_settings(spark):
        spark.conf.set(key, str(ROWS_PER_BATCH))
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in known:
        environment["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, *known) if x)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def lower_ascii(text: Column) -> Column:
    """``text`` with A-Z, and nothing else, in lower case."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_of(frame: DataFrame, name: str) -> Column:
    """The column as a string; NULL is the empty text."""
    return F.coalesce(frame[name].cast("string"), F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is derived once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def _before_each(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """``op`` over the elements before each element of an array of numbers, from 0 on.

    Blocks keep the work near linear for arrays of any size.
    """
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), op)

    def block_starts(items: Column) -> Column:
        blocks = F.when(F.size(items) > 0, F.sequence(F.lit(0), ((F.size(items) - 1) / PREFIX_BLOCK).cast("int")))
        sums = F.transform(blocks, lambda b: total(F.slice(items, b * PREFIX_BLOCK + 1, PREFIX_BLOCK)))
        return F.aggregate(
            sums,
            F.array(F.lit(0).cast("long")),
            lambda acc, x: F.concat(acc, F.array(op(F.element_at(acc, -1), x))),
        )

    def placed(items: Column, before: Column) -> Column:
        return F.transform(
            items,
            lambda _, i: op(
                F.get(before, (i / PREFIX_BLOCK).cast("int")),
                total(F.slice(items, (i / PREFIX_BLOCK).cast("int") * PREFIX_BLOCK + 1, i % PREFIX_BLOCK)),
            ),
        )

    return let(values, lambda items: let(block_starts(items), lambda before: placed(items, before)))


def prefix_sums(lengths: Column) -> Column:
    """Sums of the elements before each element."""
    return _before_each(lengths, lambda s, x: s + x)


def prefix_maxima(values: Column) -> Column:
    """Largest of the elements before each element, 0 before the first."""
    return _before_each(values, lambda s, x: F.greatest(s, x))


def tree_depth(items: int, fan_in: int) -> int:
    """Levels that bring ``items`` groups down to one, ``fan_in`` at a time."""
    return max(0, math.ceil(math.log(max(items, 1), fan_in) - 1e-9))
