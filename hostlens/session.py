"""Session defaults and stage materialisation."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

# Settings that hold from a laptop to a large cluster.  AQE sizes reduce partitions from real
# shuffle sizes, so shuffle.partitions only has to be large enough for the biggest stage.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Call-site capture per column expression only slows the building of wide feature plans.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.dataFrameQueryContext.enabled": "false",
}


def build_session(app: str = "hostlens", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _conf(spark: SparkSession, key: str) -> str | None:
    return spark.conf.get(key, None) or spark.sparkContext.getConf().get(key, None)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Only a local-mode session (one machine) may fall back to a temporary folder.
    """
    folder = _conf(spark, "spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="hostlens-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


_owner: ContextVar[Stages | None] = ContextVar("owner", default=None)
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is run inside leaves no shuffle files: else they stay until the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a stage once to the shared folder and continue from the written table.

    Cuts lineage in a way that survives the loss of executors, and spares every later branch
    the recomputation of an expensive stage (parsing, scoring).  Inside a ``Stages`` block the
    stage is removed at its end.  The shuffles that made a stage are removed once it stands.
    """
    path = fresh_path(df.sparkSession, name)
    owner = _owner.get()
    if owner is not None:  # noted first: a write that fails leaves files as well
        owner.paths.append((df.sparkSession, path))
    with _shuffles_removed(df.sparkSession):
        df.write.mode("overwrite").parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[written] = path
    return written


def _file_system(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def path_exists(spark: SparkSession, path: str) -> bool:
    store, place = _file_system(spark, path)
    return store.exists(place)


def is_folder(spark: SparkSession, path: str) -> bool:
    store, place = _file_system(spark, path)
    return store.getFileStatus(place).isDirectory()


def file_names(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """``path`` of a folder's files, as a table: no file is opened."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path")


def remove_path(spark: SparkSession, path: str) -> None:
    store, place = _file_system(spark, path)
    store.delete(place, True)


def discard(*stages: DataFrame) -> None:
    """Remove written stages that nothing reads any more; frames that are no stages are left alone."""
    for stage in stages:
        if stage in _paths:
            remove_path(stage.sparkSession, _paths.pop(stage))


class Stages:
    """Owner of the stages that are written inside its block: they are removed at its end, also after an error.

    What leaves the block must not read them: ``result`` writes it for whoever owns the block (or nobody).
    """

    def __init__(self) -> None:
        self.paths: list[tuple[SparkSession, str]] = []

    def __enter__(self) -> Stages:
        self._outer = _owner.set(self)
        return self

    def result(self, df: DataFrame, name: str) -> DataFrame:
        outer = self._outer.old_value if self._outer.old_value is not self._outer.MISSING else None
        inner = _owner.set(outer)
        try:
            return materialize(df, name)
        finally:
            _owner.reset(inner)

    def __exit__(self, *_problem) -> None:
        _owner.reset(self._outer)
        for spark, path in self.paths:
            remove_path(spark, path)


#: Input of one parsing task, and the most tasks a core is dealt: parsing is slow and its rows are uneven, so tasks are small and many.
TASK_BYTES = 1 << 20
TASKS_PER_CORE = 64


def parsing_tasks(scan: DataFrame) -> int:
    """How many tasks the rows of a scan are worth, by its bytes; 1 where they are not known."""
    size = int(str(scan._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = size < 1 << 60  # sources without statistics name the largest number
    return max(1, min(size // TASK_BYTES, TASKS_PER_CORE * scan.sparkSession.sparkContext.defaultParallelism)) if known else 1


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a scan out evenly: as many tasks as the cores at least, more by its bytes.

    Parsing costs far more than reading.  The splits of a scan say little about its rows: small or unsplittable
    files are few splits, and a large row group falls to one split whatever their number.  A scan that
    already has as many partitions as it is worth, as one of very many files, is left alone: no shuffle is added.
    """
    if df.isStreaming:
        return df
    wanted = max(df.sparkSession.sparkContext.defaultParallelism, parsing_tasks(df))
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df
