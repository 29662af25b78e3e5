"""Versions of tables and models: written aside, published by one rename.

A version is a new folder below ``<root>/data``. Once all of it is written, a manifest file that names the folder is moved
to its number below ``<root>/manifest``. Readers take the highest number, so they see the whole of the last published
version or of the one before, whatever becomes of a run that writes. A number is taken once: of two writers that publish
at the same time the second one goes on to the next number.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the published versions, in order."""
    folder, files = _files(spark, f"{root}/manifest")
    if not files.exists(folder):
        return []
    return sorted(int(name) for name in (s.getPath().getName() for s in files.listStatus(folder)) if name.isdigit())


def folder_of(spark: SparkSession, root: str, version: int | None = None) -> str:
    """The folder of a version, by default of the last one."""
    known = versions(spark, root)
    if not known or version not in (None, *known):
        raise FileNotFoundError(f"no version {'' if version is None else version} below {root}".replace("  ", " "))
    # one short line
    return f"{root}/data/" + spark.read.text(f"{root}/manifest/{(known[-1] if version is None else version):012d}").first()[0]


def publish(spark: SparkSession, root: str, write: Callable[[str], None]) -> int:
    """Let ``write`` fill a new folder and make it the last version; returns the number."""
    name = uuid.uuid4().hex
    write(f"{root}/data/{name}")
    draft, files = _files(spark, f"{root}/manifest/draft-{name}")
    out = files.create(draft, False)
    out.write(bytearray(name + "\n", "ascii"))
    out.close()
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
    keep_others = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    keep_others[0] = getattr(jvm.org.apache.hadoop.fs.Options.Rename, "NONE")
    while True:
        number = (versions(spark, root) or [0])[-1] + 1
        target = jvm.org.apache.hadoop.fs.Path(f"{root}/manifest/{number:012d}")
        try:
            context.rename(files.makeQualified(draft), files.makeQualified(target), keep_others)
            return number
        except Exception:
            if number not in versions(spark, root):
                raise


def publish_table(df: DataFrame, root: str) -> int:
    return publish(df.sparkSession, root, lambda folder: df.write.parquet(folder))


def read_table(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    return spark.read.parquet(folder_of(spark, root, version))
