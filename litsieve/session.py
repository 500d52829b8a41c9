"""Session settings and durable intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession

#: Written tables of this process, and the files that each was made from.
_SOURCES: dict[str, frozenset[str]] = {}
#: Folders in use instead of the cluster's, the innermost last.
_FOLDERS: list[str] = []
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: int = 8, app: str = "litsieve") -> SparkSession:
    """Session for tests and the bench; on a cluster the caller brings one.

    Python workers find this package wherever the driver was started.
    """
    home = str(Path(__file__).resolve().parents[1])
    known = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if home not in known:
        os.environ["PYTHONPATH"] = os.pathsep.join([home, *filter(None, known)])
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    if _FOLDERS:
        return _FOLDERS[-1]
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    _FOLDERS.append(tempfile.mkdtemp(prefix="litsieve-"))
    return _FOLDERS[-1]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage, survives executor loss, and gives later joins a true size.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    schema = df.schema
    _SOURCES[plain_path(path)] = frozenset(sources_of(df))
    # The write is the only reader of its shuffles, so their files go when it ends.
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before else spark.conf.unset(CLEANUP)
    return spark.read.schema(schema).parquet(path)


def plain_path(path: str) -> str:
    """The path without its scheme, decoded when it is a URI, absolute when it isn't."""
    if "://" in path or path.startswith("file:"):
        return unquote(urlparse(path).path)
    return os.path.abspath(path)


def sources_of(df: DataFrame) -> set[str]:
    """Files that ``df`` is made from; tables written on the way count as theirs."""
    found: set[str] = set()
    for file in map(plain_path, df.inputFiles()):
        made_of = _SOURCES.get(os.path.dirname(file))
        found |= {file} if made_of is None else made_of
    return found


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A folder for the tables written inside, deleted at the end.

    Results must be written or collected inside. Deleting goes through the file
    system of the folder, which all executors share.
    """
    inner = os.path.join(shared_dir(spark), f"run-{uuid.uuid4().hex}")
    _FOLDERS.append(inner)
    try:
        yield inner
    finally:
        _FOLDERS.remove(inner)
        path = spark._jvm.org.apache.hadoop.fs.Path(inner)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """Share out a scan that has fewer partitions than there are cores.

    For inputs of a few unsplittable files; larger scans pass through as is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt out by ``keys`` to as many tasks as the session shuffles to, however few
    bytes they have: for a join's result when much work per row follows, since the tasks
    of a join are merged by bytes."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
