"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("riskloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; a machine-local one only for a
    local master that names none."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


_written: list[str] = []


def new_folder(spark: SparkSession, name: str) -> str:
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(folder)
    return folder


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables written inside the block when it ends. Results must be written or collected by then.

    For one thread: folders are told apart by when they were named.
    """
    mark = len(_written)
    try:
        yield
    finally:
        for folder in _written[mark:]:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        del _written[mark:]


def checkpoint(df: DataFrame) -> DataFrame:
    """Write the rows as a table in the shared folder and read them back.

    Used where a result is read several times or must not change between reads. Lost executors
    reread the files, later plans start from a short lineage, and readers prune columns.
    """
    folder = new_folder(df.sparkSession, "table")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


# Rows a slice of a table that is read many times holds.
FEWEST_IN_SLICE = 4_000
MOST_IN_SLICE = 200_000


def slices(n: int, cores: int) -> int:
    """Number of slices of ``n`` training rows: one a core as long as each has some thousand rows, more of a large table."""
    return max(1, min(cores, n // FEWEST_IN_SLICE), -(-n // MOST_IN_SLICE))


def side_by_side(calls: Sequence[Callable[[], object]], most: int = 8) -> list:
    """Results of independent calls in their order. Each waits for Spark jobs of its own, many of them short, so their waits overlap."""
    if not calls:
        return []
    with ThreadPoolExecutor(min(most, len(calls))) as pool:
        return [f.result() for f in [pool.submit(c) for c in calls]]
