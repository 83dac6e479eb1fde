"""Session settings, table access and durable lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: A side is broadcast by hint only below this many bytes of its optimised plan.
BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024


def build_session(app: str = "sluiceway", cpus: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benches; on a cluster the submitter's session is used as it is."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")  # small inputs still use all cores
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts.

    ``spark.checkpoint.dir`` of the session wins. Where it is unset, a plain local master
    gets a temporary folder, which its one process can always read back; a cluster gets a
    folder under its warehouse, which its executors share, never a machine's own.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.checkpoint.dir", "")
    current = sc.getCheckpointDir()
    if current:
        return current
    if not named:
        if sc.master == "local" or sc.master.startswith("local["):
            named = "file://" + os.path.join(tempfile.gettempdir(), f"sluiceway-{uuid.uuid4().hex}")
        else:
            named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + f"/_checkpoints/{uuid.uuid4().hex}"
    sc.setCheckpointDir(named)
    return named


def ship_code(spark: SparkSession) -> None:
    """Gives the executors this package, once for each context, for workers that don't find it by themselves."""
    import zipfile

    sc = spark.sparkContext
    if getattr(sc, "_sluiceway_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="sluiceway-code-")  # on the driver only; Spark sends the file on
    path = os.path.join(folder, "sluiceway_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for at, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(at, name)
                    z.write(full, os.path.join("sluiceway", os.path.relpath(full, root)))
    sc.addPyFile(path)
    sc._sluiceway_shipped = True


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so that a lost executor costs no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a compressed table in the shared checkpoint folder and read back, for large intermediate results.

    Against ``cut`` it takes less room, later reads prune columns, and its size is known to the optimiser. The folder is
    removed when the driver's process ends."""
    spark = df.sparkSession
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(folder)


def plan_bytes(df: DataFrame) -> int:
    """The optimiser's estimate of the size of ``df`` (file sizes scaled by column width)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


#: A side is broadcast by ``broadcast_if_few`` only up to so many rows, counted.
BROADCAST_ROWS = 1_000_000


def broadcast_if_few(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only when ``df``, written before, is counted to hold at most ``rows`` rows of a few short columns. For sides that
    a function or an ``explode`` has widened, whose size the optimiser can't see."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.count() <= rows else df


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Hint a broadcast only when the optimiser's size estimate is under ``limit``; otherwise leave the join to Spark."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if plan_bytes(df) <= limit else df
