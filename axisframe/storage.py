"""Intermediate tables in the folder that the cluster shares, size-checked broadcasts, and the package on executors."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import sys
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of a side that may be broadcast; beyond them the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 1 << 26
#: What bounds the bytes of an Arrow batch, Spark's own bound, and ours: a Python worker and its task each hold a few batches at a time.
BATCH_SETTING, BATCH_DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8388608b"

#: The driver's heap is collected between tables once it has grown to the first share of its bound, and then by the second since the last time.
HEAP_SHARE, HEAP_STEP = 0.45, 0.1

_ROOT = str(Path(__file__).resolve().parents[1])
_shipped: set = set()
_collected: dict = {}


def one_machine(spark: SparkSession) -> bool:
    """Whether the driver is the only executor, as in tests."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def ready(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package: by its path where there is one machine, else from an archive that Spark sends to them.

    Arrow batches are bounded by BATCH_BYTES, whatever the length of texts,
    unless the session has a bound of its own.
    """
    context = spark.sparkContext
    if spark.conf.get(BATCH_SETTING, None) == BATCH_DEFAULT:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)
    if one_machine(spark):
        env = context.environment
        if _ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
            env["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, env.get("PYTHONPATH", "")) if x)
    elif context.applicationId not in _shipped:
        _shipped.add(context.applicationId)
        own = tempfile.mkdtemp(prefix="axisframe-package-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        context.addPyFile(shutil.make_archive(f"{own}/axisframe-package", "zip", _ROOT, Path(__file__).resolve().parent.name))
    if _ROOT not in sys.path:
        sys.path.append(_ROOT)
    return spark


def folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a temporary one only where it names none and there is one machine."""
    if named := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return named
    if not one_machine(spark):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="axisframe-checkpoints-"))
    return spark.sparkContext.getCheckpointDir()


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes a table in the shared folder."""
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended: whoever owns the shared folder clears it
        pass


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{folder(spark)}/axisframe/{name}-{uuid.uuid4().hex}"
    atexit.register(dropped, spark, path)
    return path


def tidied(spark: SparkSession, always: bool = False) -> None:
    """Collects the driver's garbage if its heap has grown to HEAP_SHARE of its bound, or ``always``.

    Plans, broadcasts and shuffles of finished jobs stay until the driver's
    JVM happens to collect them, and until then its heap grows to its bound,
    whatever the tables' size.  Spark deletes the files of shuffles with them.
    """
    runtime, of = spark._jvm.java.lang.Runtime.getRuntime(), spark.sparkContext.applicationId
    size, most = runtime.totalMemory(), runtime.maxMemory()
    if always or size > max(HEAP_SHARE * most, _collected.get(of, 0) + HEAP_STEP * most):
        gc.collect()  # Python's references to what the JVM may drop
        spark._jvm.java.lang.System.gc()
        _collected[of] = runtime.totalMemory()


def saved(df: DataFrame, name: str, path: str | None = None, **options) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: cut lineage that outlives lost executors.

    A ``path`` of one's own, from ``new_path``, can be ``dropped`` before the session ends.
    """
    spark, path = df.sparkSession, path or new_path(df.sparkSession, name)
    df.write.options(compression="zstd", **options).parquet(path)
    tidied(spark)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, most: int = BROADCAST_ROWS, size: Column | None = None) -> DataFrame:
    """``df`` with a broadcast hint if it has no more than ``most`` rows, and no more than BROADCAST_BYTES by the bytes ``size`` of a row, else as it is.

    The count stops at the bound, and ``df`` should be cheap to compute twice
    (a saved table or a scan of two columns).
    """
    n, total = df.select((size if size is not None else F.lit(0)).cast("long").alias("size")).limit(most + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    return F.broadcast(df) if n <= most and total <= BROADCAST_BYTES else df


def numbered(df: DataFrame, order: list, name: str = "pos") -> DataFrame:
    """``df`` with the 0-based place of each row in ``order``.

    Rows are range-partitioned and sorted within partitions; a place is the
    row's number in its partition plus the sizes of the partitions before it.
    No task sees more than its range, unlike with a window without partitions.
    The ranges are written once, so both passes see the same ones.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = saved(ranged.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id() % F.lit(1 << 33)}), "ranged")
    sizes = sorted((r["_part"], r["n"]) for r in ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect())
    before, offsets = 0, []
    for part, n in sizes:
        offsets.append((part, before))
        before += n
    spark = df.sparkSession
    table = F.broadcast(spark.createDataFrame(offsets, "_part int, _before long"))
    return ranged.join(table, "_part").select(*df.columns, (F.col("_before") + F.col("_at")).alias(name))
