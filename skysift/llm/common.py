"""What the corpus operators share: work tables, skew-safe group minima, null-safe inputs."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import materialize, shared_dir  # noqa: F401

#: A key's rows are dealt over this many sub-keys before the key's final value is formed.
SALTS = 64


def _give_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows as they are; the worker's garbage and free native memory go back to the system first."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim is not None:
        trim(0)
    yield from batches


def release_workers(spark: SparkSession) -> int:
    """Let the executors' Python workers give back their memory: one task a core; their number. For stages that run Python anyway."""
    tasks = spark.sparkContext.defaultParallelism
    return spark.range(0, tasks, 1, tasks).mapInArrow(_give_back, "id long").count()


def release_executors(spark: SparkSession) -> int:
    """Let the executors' JVMs give back theirs: one task a core collects its JVM; their number. No Python runs there.

    A full collection is what makes a heap smaller, and what unloads the classes of earlier plans. With all cores free, as between
    stages, each executor gets a task; one that gets none just keeps what it has."""
    tasks = spark.sparkContext.defaultParallelism
    return len(spark.range(0, tasks, 1, tasks).selectExpr("java_method('java.lang.System', 'gc') as done").collect())


def release_unused(spark: SparkSession) -> bool:
    """Give the garbage and free native memory of the executors' JVMs and the driver back to the system; false if the driver's JVM cannot do the latter.

    A JVM that plans hundreds of queries keeps what its compilers and threads have allocated and freed, and a heap as large as the
    last stage's: this adds up over stages, whatever they hold. So does an executor's JVM; its Python workers: see release_workers."""
    jvm = getattr(spark, "_jvm", None)
    gc.collect()
    if jvm is None:
        return False
    release_executors(spark)
    jvm.System.gc()
    try:
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        # Its class is hidden, so the method is taken from the interface.
        methods = jvm.java.lang.Class.forName("javax.management.MBeanServerConnection").getMethods()
        values = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
        values[0], values[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        next(m for m in methods if m.getName() == "invoke").invoke(server, values)
    except Py4JError:  # a JVM without this command
        return False
    return True


def fresh(taken: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores behind it as keep it from clashing with a column."""
    used, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def salt_of(col: Column | str, n: int = SALTS) -> Column:
    return F.pmod(F.xxhash64(col), F.lit(n)).cast("int")


def with_group_min(df: DataFrame, keys: list[str], value: str, out: str, by: str) -> DataFrame:
    """Add ``out`` = min(value) per key. ``by`` (a unique-ish column) spreads a hot key over SALTS sub-keys,
    so that neither the aggregation nor the join back brings a key's rows to one task."""
    salted = df.withColumn("_salt", salt_of(by))
    part = salted.groupBy(*keys, "_salt").agg(F.min(value).alias("_m"))
    total = part.groupBy(*keys).agg(F.min("_m").alias(out))
    found = part.drop("_m").join(total, keys).select(*keys, "_salt", out)
    return salted.join(found, [*keys, "_salt"]).drop("_salt")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Written tables of at most this many rows, or items of their lists, may be broadcast.
BROADCAST_ROWS = 1_000_000


def checked_broadcast(df: DataFrame, items: str | None = None) -> DataFrame:
    """Broadcast a written table of at most BROADCAST_ROWS rows (or items of its list column); else leave it to a shuffle."""
    size = df.limit(BROADCAST_ROWS + 1).count() if items is None else df.agg(F.sum(F.size(items) + 1)).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_ROWS else df
