"""Session helpers: builder for local use and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from threading import get_ident

from pyspark.sql import DataFrame, SparkSession


def tune(spark: SparkSession) -> SparkSession:
    """Session settings the jobs rely on.

    The wide projections compile to methods the JVM refuses to optimise
    (more than 8000 bytes of code). Below that limit Spark splits them into
    small methods instead, which long scans gain from most.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark


def local_session(cores: int | str = "*", app: str = "flowlake", memory: str = "8g",
                  shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    return tune(
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session, where driver and executors are one process, may
    leave it unset; it then gets one folder that stays for the session.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="flowlake-"))
        named = context.getCheckpointDir()
    return named.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark)}/flowlake/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, name: str, partition_by: list[str] | None = None, outlives: bool = False,
                per_file: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder, at most ``per_file`` rows a file, and read it back.

    The written table survives the loss of any executor and gives later jobs
    a plain columnar scan with pruning instead of a replay of the whole plan.
    ``drop_scratch`` removes it once nothing reads it any more, as does the
    end of the innermost ``temporary_tables`` around it, or of the one around that if it ``outlives`` it.
    """
    path = scratch_path(df.sparkSession, name)
    open_lists = _written.get(get_ident(), [])
    if len(open_lists) > outlives:
        open_lists[-1 - outlives].append(path)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if per_file:
        writer = writer.option("maxRecordsPerFile", per_file)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: By thread, paths written within each open ``temporary_tables``, the innermost last.
_written: dict[int, list[list[str]]] = {}


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Delete at its end what ``cut_lineage`` wrote meanwhile in this thread, but for tables that outlive it."""
    paths: list[str] = []
    _written.setdefault(get_ident(), []).append(paths)
    try:
        yield
    finally:
        _written[get_ident()].pop()
        for path in paths:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def drop_scratch(df: DataFrame) -> None:
    """Delete the files of a table that ``cut_lineage`` wrote."""
    spark = df.sparkSession
    own = f"{shared_folder(spark).split(':', 1)[-1].rstrip('/')}/flowlake/".replace("//", "/")
    folders = {file.rsplit("/", 1)[0] for file in df.inputFiles()}
    for folder in folders:
        if own in folder.split(":", 1)[-1].replace("//", "/"):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for an input with fewer splits than the session has cores.

    Large inputs have many splits and are returned as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
