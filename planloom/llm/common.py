"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch: what a worker holds at a time follows these, not the partition. A longer row is a batch.
BATCH_ROWS = 2048
BATCH_BYTES = 4 << 20
#: Bits of the bitmap that sieve() broadcasts: 2 MB as 2 ** 18 rows of 64.
SIEVE_BITS = 1 << 24

_roots: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir`` that driver and executors share; one is set only where none is."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        where = spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="planloom-")  # driver and executors are one process
        spark.sparkContext.setCheckpointDir(where)
    return where


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, in a folder of the application that goes when the driver ends."""
    root = f"{shared_dir(spark).rstrip('/')}/planloom-{spark.sparkContext.applicationId}"
    if root not in _roots:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _roots.add(root)
    return f"{root}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` once as Parquet in the shared folder and reads it back: read by column, several times."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with its columns named c0, c1, ..., which can't clash with an operator's own, and the new name of each."""
    names = {name: f"c{i}" for i, name in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def in_batches(df: DataFrame, run, schema, together: int = 0) -> DataFrame:
    """``df.mapInArrow(run, schema)`` over batches of bounded size. The bound is a setting of the session, lowered if it is higher.

    With ``together`` narrow batches are put together until they have so many rows.
    """
    conf = df.sparkSession.conf
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = str(conf.get(name)).lower().removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            conf.set(name, str(most))
    return df.mapInArrow(_frugal(_together(run, together) if together else run), schema)


def trim() -> None:
    """Gives memory that was freed back to the system."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def _frugal(run):
    """``run``, whose worker gives back the memory that it no longer needs; workers live on from task to task."""

    def kept(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return kept


def _together(run, rows: int):
    def joined(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= rows:
                yield pa.concat_batches(held)
                held, n = [], 0
        if held:
            yield pa.concat_batches(held)

    return lambda batches: run(joined(batches))


def sieve(rows: DataFrame, key: list[str], wanted: DataFrame, inside: bool = True, bits: int = SIEVE_BITS) -> DataFrame:
    """``rows`` whose ``key`` may be one of ``wanted``, or those whose key certainly is none of them; nothing is shuffled.

    A bitmap of ``bits`` hashed keys is broadcast, whatever the size of ``wanted``; the fuller it is, the more rows may be
    wanted, so a join must decide about these.
    """
    place = F.pmod(F.xxhash64(*key), F.lit(bits))
    marks = wanted.select(place.alias("_place")).groupBy(F.shiftright("_place", 6).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_place & 63 as int))")).alias("_bits"))
    found = rows.withColumn("_place", place).withColumn("_word", F.shiftright("_place", 6)).join(F.broadcast(marks), "_word", "left")
    hit: Column = F.expr("_bits is not null and (shiftrightunsigned(_bits, cast(_place & 63 as int)) & 1L) = 1L")
    return found.where(hit if inside else ~hit).select(*rows.columns)
