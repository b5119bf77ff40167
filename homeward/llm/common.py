"""What the operators of this folder share: tables, intermediate results, Arrow loops."""

from __future__ import annotations

import ctypes
import gc
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from homeward.shared import deleted, ended, shared_dir

#: Raw text bytes that one step of a Python worker holds as Python objects.
SLICE_BYTES = 4 << 20
#: Bits that tell which texts need to be looked at again.
MARKS = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Intermediate tables of one query, in the shared folder.

    Writing a table cuts the lineage: a lost executor costs the tasks of one step. Once a
    table is written, the shuffle files of the step behind it are released. A result may read
    tables until it is written itself, so the folder goes when the driver ends, or with ``clear``.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/homeward/{name}-{uuid.uuid4().hex}"
        ended(spark, self.root)

    def clear(self) -> None:
        """All tables go; results that read them must have been written."""
        deleted(self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration(), self.root)

    def path(self, step: str) -> str:
        return f"{self.root}/{step}"

    def release(self) -> None:
        """Lets go of the shuffle files of finished jobs, which otherwise stay until the driver
        happens to collect its garbage, and of the driver's free native memory."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
        trimmed(self.spark)

    def written(self, df: DataFrame, step: str) -> DataFrame:
        schema = df.schema
        self.release()  # by now nothing holds the tables before the last one
        df.write.mode("overwrite").parquet(self.path(step))
        self.release()
        return self.spark.read.schema(schema).parquet(self.path(step))

    def drop(self, step: str) -> None:
        deleted(self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration(), self.path(step))


def trimmed(spark: SparkSession) -> str:
    """Has the driver's JVM give free native memory back to the system; what it says of that.

    Each of its hundreds of threads allocates from one of many arenas of the C library, which keep
    what compilers, codecs and broadcasts have freed. Nothing happens on a JVM that cannot do so."""
    jvm, new = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    args = new(jvm.Object, 4)
    try:
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        args[2], args[3] = new(jvm.Object, 0), new(jvm.String, 0)
        beans = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        # by the interface's method: the class behind it is not open to others
        methods = jvm.java.lang.Class.forName("javax.management.MBeanServerConnection").getMethods()
        return str(next(m for m in methods if m.getName() == "invoke").invoke(beans, args))
    except Py4JError:
        return ""


def input_bytes(df: DataFrame, text: str) -> int:
    """Catalyst's size of a file scan; sources without one are measured."""
    n = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if n > 1 << 50:
        n = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return n


def pieces(n_bytes: int, each: int, least: int) -> int:
    """Partitions of about ``each`` bytes: their number follows the input."""
    return max(least, math.ceil(n_bytes / each))


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % folds


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``most`` bytes of text (a longer row stays whole)."""
    import pyarrow.compute as pc

    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    start = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    yield batch.slice(start)


def small_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches have SLICE_BYTES at most, or less where it says so.

    Spark's own bound is 64 MB, so a partition of texts can be one batch, which the executor and
    the Python worker both hold whole, for each core. A step takes SLICE_BYTES of it anyway."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if held > SLICE_BYTES:
        spark.conf.set(key, SLICE_BYTES)


def marks(rows: DataFrame) -> np.ndarray:
    """A bit for each value of ``th`` modulo MARKS, set for those in ``rows``: which texts need to be
    looked at again. A text more costs time and changes nothing, so the bits may be few."""
    found = rows.select(F.pmod("th", F.lit(MARKS)).cast("int").alias("i")).distinct().toArrow()  # at most MARKS numbers
    out = np.zeros(MARKS, bool)
    out[found.column("i").to_numpy()] = True
    return np.packbits(out, bitorder="little")


def marked(batch: pa.RecordBatch, bits: np.ndarray) -> pa.RecordBatch:
    """The rows whose ``th`` has its bit in ``marks``."""
    i = batch.column("th").to_numpy() & np.int64(MARKS - 1)
    return batch.filter(pa.array((bits[i >> 3] >> (i & 7).astype(np.uint8) & 1).astype(bool)))


def giving_back(run):
    """``run`` over Arrow batches, giving free memory back to the system when a task ends. Workers
    are used again by later tasks, and what an idle one holds is missing to the others."""

    def wrapped(*batches):
        try:
            yield from run(*batches)
        finally:
            give_back()

    return wrapped


def then_back(solve):
    """The same for a function of one whole group or of two."""

    def one(group):
        try:
            return solve(group)
        finally:
            give_back()

    def two(left, right):
        try:
            return solve(left, right)
        finally:
            give_back()

    return one if solve.__code__.co_argcount == 1 else two  # Spark looks at the number of arguments


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of the GNU C library
        trim(0)


def schema_of(*fields: tuple[str, str]) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in fields)


def fresh(base: str, taken) -> str:
    """A column name that clashes with none of ``taken``."""
    taken = {t.lower() for t in taken}
    name = base
    while name.lower() in taken:
        name = "_" + name
    return name


def typed(df: DataFrame, name: str, kind: str) -> Column:
    """The column, cast if it has another type (a void column of an empty table, say)."""
    c = F.col(name)
    return c if df.schema[name].dataType.simpleString() == kind else c.cast(kind)


LONG, STRING = T.LongType(), T.StringType()
