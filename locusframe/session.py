"""Session settings and the shared-folder helpers used by iterative jobs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(app: str = "locusframe", cores: str | int = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by the session.

    A machine-local folder is made only for a local master, where the driver
    and the executors share one disk.
    """
    named = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that every executor can reach")
    made = tempfile.mkdtemp(prefix="locusframe-")
    spark.sparkContext.setCheckpointDir(made)
    return made


_OPEN: list[list[str]] = []


def _new_folder(spark: SparkSession, label: str) -> str:
    path = f"{shared_folder(spark)}/locusframe/{label}-{uuid.uuid4().hex}"
    if _OPEN:
        _OPEN[-1].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove, at the end of the block, the tables that were written in it to the shared folder.

    A DataFrame made in the block reads those tables, so store or collect it there::

        with scratch(spark):
            merge_segments(df).write.parquet(out)
    """
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder once and read it back.

    This cuts lineage (the files outlive a lost executor), computes the input
    one time only however often the result is used, and gives the planner the
    true size of the table, so it broadcasts the result only while that size is
    under ``spark.sql.autoBroadcastJoinThreshold`` and shuffles it beyond.
    """
    spark = df.sparkSession
    path = _new_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Ledger:
    """An append-only table in the shared folder, written one round at a time.

    Iterative jobs add the rows of each round and read all rounds back; no
    round is ever rewritten and no plan grows with the number of rounds.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = _new_folder(spark, label)
        self.paths: list[str] = []
        self.schema = None

    def append(self, df: DataFrame) -> DataFrame:
        """Write one round and return just that round."""
        path = f"{self.root}/{len(self.paths):05d}"
        df.write.parquet(path)
        self.paths.append(path)
        self.schema = self.schema or df.schema
        return self.spark.read.schema(self.schema).parquet(path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*self.paths)
