"""Scans. Nothing reads rows on the driver but the header of a numpy file, whose rows tasks read by runs."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FORMATS = ("csv", "parquet", "npy", "json", "orc")
#: Bytes of a numpy file that a task reads, and that it holds at a time.
NPY_RUN = 1 << 26
NPY_HELD = 1 << 22


def read(spark: SparkSession, format: str, path: str, **options: Any) -> DataFrame:
    """A table of one of FORMATS; ``options`` are the reader's."""
    if format not in FORMATS:
        raise ValueError(f"unsupported format {format!r}: expected one of {', '.join(FORMATS)}")
    if format == "npy":
        return read_npy(spark, path)
    if format == "csv":
        options = {"header": True, "inferSchema": "schema" not in options} | options
    schema = options.pop("schema", None)
    reader = spark.read.options(**options)
    return (reader.schema(schema) if schema else reader).format(format).load(path)


def _opened(path: str):
    """A file of any store that Arrow knows, to read from any place."""
    store, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    return store.open_input_file(at)


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """row_id and value, which is an array for matrices. Driver and tasks read the file at its path."""
    with _opened(path) as file:
        version = np.lib.format.read_magic(file)
        shape, by_column, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(file)
        start = file.tell()
    if len(shape) not in (1, 2) or by_column and min(shape) > 1 or dtype.hasobject or dtype.kind not in "iufb":
        raise ValueError(f"{path} must have numbers in one or two dimensions, by row: it has {dtype} of shape {shape}")
    width = int(np.prod(shape[1:]))
    whole, size = dtype.kind in "ib" or dtype.kind == "u" and dtype.itemsize < 8, max(1, width * dtype.itemsize)
    kind, run, held = "bigint" if whole else "double", max(1, NPY_RUN // size), max(1, NPY_HELD // size)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _opened(path) as file:
            for first in (r for b in batches for r in b.column("id").to_pylist()):
                for at in range(first * run, min((first + 1) * run, shape[0]), held):
                    n = min(held, (first + 1) * run - at, shape[0] - at)
                    file.seek(start + at * size)
                    values = pa.array(np.frombuffer(file.read(n * size) if width else b"", dtype).astype(np.int64 if whole else np.float64))
                    if len(shape) == 2:
                        values = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), values)
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + n)), values], ["row_id", "value"])

    runs = -(-shape[0] // run)
    return spark.range(runs, numPartitions=max(1, runs)).mapInArrow(rows, f"row_id bigint, value {kind if len(shape) == 1 else f'array<{kind}>'}")


def with_row_id(df: DataFrame, keys: list[str], name: str = "__row_id") -> DataFrame:
    """Adds 0-based positions in the order of ``keys`` without a sort in one task: ranges, their sizes, ranks within.

    Equal keys may be in several ranges, in any order.
    """
    from planloom.plans.runtime import settled

    order = [*keys, "__tie"]
    ranged = settled(df.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    sizes = sorted((r["__part"], r["count"]) for r in ranged.groupBy("__part").count().collect())  # one row for each partition
    offsets, at = {}, 0
    for part, n in sizes:
        offsets[part] = at
        at += n
    rank = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    base = F.element_at(F.create_map(*[F.lit(x) for p, o in offsets.items() for x in (p, o)]), F.col("__part")) if offsets else F.lit(0)
    return ranged.withColumn(name, (rank + base).cast("bigint")).drop("__part", "__tie")
