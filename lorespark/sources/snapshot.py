"""Versions of a whole store on disk: tables are written beside those they replace, then a pointer of a higher number is put down.

A pointer is written under another name and renamed to ``CURRENT-<number>``, which no pointer bore before, so there
is a whole one at any time; the highest counts. Of two writers of one number the second fails and nothing is lost.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def _files(spark: SparkSession, path: str):  # noqa: ANN202
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _latest(spark: SparkSession, root: str) -> int:
    name, files = _files(spark, f"{root}/CURRENT-*")
    return max((int(f.getPath().getName().split("-")[1]) for f in files.globStatus(name) or []), default=0)


def current(spark: SparkSession, root: str) -> str | None:
    """The folder the latest pointer names; None before the first commit."""
    number = _latest(spark, root)
    return spark.read.text(f"{root}/CURRENT-{number}").first()["value"] if number else None


def commit(spark: SparkSession, root: str, tables: dict[str, DataFrame], partition_by: dict[str, str] | None = None) -> str:
    """All tables written into a new folder, the pointer swapped last. Readers see the old or the new version whole."""
    folder = f"{root}/v-{uuid.uuid4().hex}"
    for name, df in tables.items():
        writer = df.write.option("compression", "zstd")
        if partition_by and name in partition_by:
            writer = writer.partitionBy(partition_by[name])
        writer.parquet(f"{folder}/{name}.parquet")
    number = _latest(spark, root) + 1
    new, files = _files(spark, f"{root}/pointer-{uuid.uuid4().hex}")
    out = files.create(new, True)
    out.write(bytearray(folder.encode()))
    out.close()
    target, _ = _files(spark, f"{root}/CURRENT-{number}")
    if files.exists(target) or not files.rename(new, target):
        files.delete(new, False)
        raise RuntimeError(f"another writer has put down version {number} of {root}")
    return folder


def load(spark: SparkSession, root: str, name: str) -> DataFrame:
    folder = current(spark, root)
    if folder is None:
        raise FileNotFoundError(f"no snapshot under {root}")
    return spark.read.parquet(f"{folder}/{name}.parquet")
