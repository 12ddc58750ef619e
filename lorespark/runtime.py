"""Session helpers: cutting lineage through the shared folder, and sizes of plans.

The shared folder is the one the cluster names in ``spark.checkpoint.dir``. Only where that setting is
absent (tests, a laptop) a temporary folder is made, because there driver and executors share one machine.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; made up only where the session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder all executors of {master} share")
        named = "file://" + tempfile.mkdtemp(prefix="lorespark-")
        spark.sparkContext.setCheckpointDir(named)
        spark.conf.set("spark.checkpoint.dir", named) if spark.conf.isModifiable("spark.checkpoint.dir") else None
    return named.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # noqa: BLE001 - the session may be gone already
        pass


@atexit.register
def sweep() -> None:
    """Delete all intermediate files written so far; results that were not collected or written yet can't be read after."""
    while _written:
        _delete(*_written.pop())


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder for files of this session."""
    path = f"{shared_dir(spark)}/lorespark/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` once as compressed Parquet into the shared folder and read it back.

    Unlike a block kept on an executor the files outlive any executor, and unlike ``checkpoint()`` they are
    columnar and compressed and carry sizes for the optimizer.
    """
    spark = df.sparkSession
    path = scratch_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(scan: DataFrame) -> DataFrame:
    """A scan with at least as many tasks as cores before heavy Python work.

    Only a scan of fewer splits than cores, one small file say, is redistributed; beyond, nothing is moved.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
