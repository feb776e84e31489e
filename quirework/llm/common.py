"""Helpers that the operators share: tables, durable cuts of lineage, Arrow batches."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: UTF-8 bytes of text that one Python step holds at a time.
STEP_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of the cluster; a temporary one only where none is set and all runs on this machine, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (root or _own_root()).rstrip("/")


@functools.cache
def _own_root() -> str:
    return "file://" + tempfile.mkdtemp(prefix="quirework-")


def cut(df: DataFrame, hint: str = "cut") -> DataFrame:
    """Write ``df`` as Parquet to the shared checkpoint folder and read it back.

    The files replace the lineage, so a lost executor costs no earlier step.
    They go when the driver ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/{hint}-{uuid.uuid4().hex}"
    clean = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(clean, "false")
    spark.conf.set(clean, "true")  # the table replaces the plan, so its shuffle files can go when it is written
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(clean, before)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def drop(*cuts: DataFrame) -> None:
    """Delete tables that ``cut`` wrote and nothing reads any more.

    The driver then collects its garbage: Spark lets go of broadcasts and shuffles of finished plans only when their
    objects are gone, and there are many small plans in a row here, whose broadcasts would fill a small driver.
    """
    for df in cuts:
        _remove(df.sparkSession, df._cut_path)
    if cuts:
        gc.collect()
        pa.default_memory_pool().release_unused()
        cuts[0].sparkSession.sparkContext._jvm.System.gc()
        give_back(cuts[0].sparkSession)


def give_back(spark: SparkSession) -> str | None:
    """Have both processes of the driver return freed memory to the system; what the JVM said, if it can.

    Some 600 threads and the compiler take C memory in the JVM, in arenas that glibc keeps when all in them is free:
    250 MB were kept so after one run of op6. Java has no call for it but the diagnostic command that jcmd sends.
    """
    with contextlib.suppress(AttributeError, OSError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)
    try:
        gateway, jvm = spark.sparkContext._gateway, spark.sparkContext._jvm
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServerConnection").getMethods() if m.getName() == "invoke")
        args = gateway.new_array(jvm.java.lang.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        return invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Exception:  # noqa: BLE001  a JVM without the command keeps its memory, which harms no result
        return None


def rest(spark: SparkSession) -> int:
    """Have each executor collect its garbage, so that its heap goes back to what is in use; how many were asked.

    A heap that grew in one stage keeps its memory until a full collection, which none of the tasks here brings about, and
    the Python workers of the next stage come on top. SQL's ``reflect`` is what runs a static method in an executor; as
    many tasks as executors, all idle, are dealt out one to each.
    """
    n = max(1, spark.sparkContext._jsc.sc().getExecutorMemoryStatus().size() - 1)
    spark.range(0, n, 1, n).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).collect()
    return n


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session has ended; the folder goes with the cluster
        pass


def only(df: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """The columns that an operator works on, under fixed names, whatever else the table has."""
    return df.select(df[id_col].alias("doc_id"), df[text_col].cast("string").alias("text"), *[df[c] for c in more])


def most_frequent(df: DataFrame, n: Column, most: int) -> DataFrame:
    """Rows of ``df`` with the highest counts ``n``: all from a count on, such that these are at most ``most``.

    A histogram of counts (about 10,000 bars at most, whatever the table's size) gives that count, so nothing is sorted
    and no task or driver gathers candidates.
    """
    bar = F.when(n < 1024, n).otherwise(1024 + F.floor(F.log(n) * 256)).cast("long")
    low, total = None, 0
    for row in sorted(df.groupBy(bar.alias("bar")).agg(F.count("*").alias("rows")).collect(), key=lambda r: -r["bar"]):
        total += row["rows"]
        if total > most:
            break
        low = row["bar"]
    return df.filter(bar >= low) if low is not None else df.limit(0)


def steps(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about ``most`` bytes of ``column`` or one row."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, size in enumerate(sizes):
            if held and held + size > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(size) + 1
        yield batch.slice(start, n - start)
