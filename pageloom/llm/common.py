"""What the operators of this subpackage share: the shared folder, written tables, bit filters."""

from __future__ import annotations

import atexit
import math
import tempfile
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of one bitmap of Spark's bitmap_construct_agg.
BITMAP_BITS = 32768
#: Spark's switch to remove a query's shuffle files when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: A filter up to this size is broadcast; above it the callers shuffle instead.
FILTER_BROADCAST_BYTES = 16 << 20

#: Rows that a Python worker gets at once while a table is written: texts may be long.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}

# Python workers live on from task to task, and Arrow's own pools keep what the largest batch took
pa.set_memory_pool(pa.system_memory_pool())

_own_folder: list[str] = []
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one in local mode."""
    set_by_cluster = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if set_by_cluster:
        return set_by_cluster.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
    if not _own_folder:
        _own_folder.append("file://" + tempfile.mkdtemp(prefix="pageloom-"))
    return _own_folder[0]


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it is removed when the driver exits."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            delete(spark, path)
        except Exception:  # the session has ended: nothing to delete with
            return


def stored(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """df written as Parquet to the shared folder and read back: lineage ends there, and lost executors cost nothing.

    The shuffle files that the write needed go with it; nothing reads them again.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    settings = BATCH | {SHUFFLE_CLEANUP: "true"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        writer.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def drop(*tables: DataFrame) -> None:
    """Delete tables as stored() returned them, once nothing reads them any more."""
    for table in tables:
        delete(table.sparkSession, table.stored_at)


def as_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null counts as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    return [x or b"" for x in pc.cast(column, kind).to_pylist()]


def filter_slots(n_keys: int, bits_per_key: int, filters: int = 1) -> int | None:
    """Bitmaps that a filter of n_keys takes; None if they may not be broadcast, and the caller shuffles instead."""
    slots = max(1, math.ceil(n_keys * bits_per_key / BITMAP_BITS))
    return slots if slots * filters * BITMAP_BITS // 8 <= FILTER_BROADCAST_BYTES else None


def bit_filter(keys: DataFrame, slots: int, *by: str) -> DataFrame:
    """One-hash filters over the long column `h`, one for each value of `by`: rows (slot, *by, bits)."""
    return keys.groupBy(filter_slot(F.col("h"), slots).alias("slot"), *by).agg(F.bitmap_construct_agg(filter_bit(F.col("h"))).alias("bits"))


def filter_slot(hashed: Column, slots: int) -> Column:
    return F.pmod(hashed, F.lit(slots)).cast("int")


def filter_bit(hashed: Column) -> Column:
    """Taken from other bits than the slot as long as there are fewer than 2^20 slots."""
    return F.pmod(F.shiftrightunsigned(hashed, 20), F.lit(BITMAP_BITS)).cast("bigint")


def has_bit(bits: Column, bit: Column) -> Column:
    """Whether a bitmap of bitmap_construct_agg holds a bit position; null bitmaps hold none."""
    byte = F.conv(F.hex(F.substring(bits, (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, F.pmod(bit, F.lit(8)).cast("int")) == 1, F.lit(False))
