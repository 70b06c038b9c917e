"""Helpers shared by the operators: input tables, written intermediate tables, Arrow tasks."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import bazaar
from bazaar.session import shared_path

#: Rows in one Arrow batch handed to a Python task: whole texts travel in them, so few.
ROWS_PER_BATCH = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back.

    This cuts the lineage and survives the loss of an executor.  Each call takes a
    folder of its own, so two drivers never share one.
    """
    spark = df.sparkSession
    path = shared_path(spark, "llm", f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(sc: SparkContext) -> None:
    """Let Python workers import this package.

    They find it in PYTHONPATH, in the working folder or in a ``--py-files`` archive; where the
    driver has it from elsewhere, Spark's file server gives it to them once per application.
    """
    root = os.path.dirname(os.path.dirname(os.path.realpath(bazaar.__file__)))
    known = [os.path.realpath(p) for p in [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()] if p]
    linked = os.path.realpath(os.path.join(os.getcwd(), "bazaar")) == os.path.join(root, "bazaar")
    if root in known or linked or not os.path.isdir(root) or "bazaar_package.zip" in sc._python_includes:
        return
    sc.addPyFile(shutil.make_archive(os.path.join(tempfile.mkdtemp(), "bazaar_package"), "zip", root, "bazaar"))


def in_batches(df: DataFrame, each: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
               schema: str) -> DataFrame:
    """``mapInArrow`` over small batches."""
    ship(df.sparkSession.sparkContext)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    return df.mapInArrow(each, schema)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc_of_id(doc_id: Column) -> Column:
    """crc32 of the id written as decimal text; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def bounded(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than it must."""
    return df.limit(rows + 1).count() <= rows


def bit_field(hashes: DataFrame, max_bits: int) -> np.ndarray:
    """A bit field, in words of 64 bits, that marks the column ``hash`` (long) by its highest bits.

    It has some 16 bits for each hash, and 2 ** ``max_bits`` at most; no more rows than it has words reach the driver.
    """
    bits = min(max_bits, max(16, (16 * hashes.count()).bit_length()))
    bit = F.shiftrightunsigned("hash", 64 - bits)
    words = (hashes.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("at"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("set")).toArrow())
    field = np.zeros(1 << bits - 6, np.int64)
    field[words.column("at").to_numpy()] = words.column("set").to_numpy()
    return field
