"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession

#: Settings the library relies on. They are defaults for sessions built here; a
#: session handed in by the caller keeps its own.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.ui.enabled": "false",
}


def get_session(
    app: str = "plumbline", master: str | None = None, **settings: str
) -> SparkSession:
    """Build (or fetch) a session. ``settings`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and intermediate tables.

    It is the one the cluster names in ``spark.checkpoint.dir``. Only a local
    session may fall back to a temporary folder of this machine: on a cluster
    another executor could not read it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="plumbline-")
    context.setCheckpointDir(folder)
    return folder


#: The folder of the innermost ``temporary`` block.
_block: ContextVar[str | None] = ContextVar("block", default=None)


def fresh_path(spark: SparkSession, name: str, lasting: bool = False) -> str:
    """A new path in the shared folder; nothing is written there yet.

    Inside a ``temporary`` block it is in the folder of the block, unless it is to be ``lasting``.
    """
    folder = (None if lasting else _block.get()) or shared_dir(spark)
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def temporary(spark: SparkSession, name: str) -> Iterator[None]:
    """Tables stored inside are deleted at its end; what is to be read later has to be ``lasting``."""
    folder = fresh_path(spark, name)
    token = _block.set(folder)
    try:
        yield
    finally:
        _block.reset(token)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Whether Spark deletes the shuffle files of a query when it ends, and not only when the driver finds them unused.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """What is written inside is read from its files later, so its shuffle files go at its end."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def stored(df: DataFrame, name: str, lasting: bool = False, codec: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    For results several later steps read: they start from the files, so nothing is
    computed twice and a lost executor costs no recomputation. ``codec`` names another compression.
    """
    path = fresh_path(df.sparkSession, name, lasting)
    with _shuffles_deleted(df.sparkSession):
        df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucket_count(spark: SparkSession) -> int:
    """As many as shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of files for each part a table is dealt into, and the most parts.
PART_BYTES = 4 << 20
MOST_PARTS = 4000


def part_count(df: DataFrame) -> int | None:
    """Parts to deal ``df`` into so that they stay small however large its files are; None if it comes from no files.

    Spark's own choice goes by bytes as they are shuffled, which is a small part of what a task holds where values are alike.
    """
    files = df.inputFiles()
    if not files:
        return None
    context = df.sparkSession.sparkContext
    java, conf = context._jvm, context._jsc.hadoopConfiguration()
    paths = (java.org.apache.hadoop.fs.Path(java.java.net.URI(f)) for f in files)
    size = sum(p.getFileSystem(conf).getFileStatus(p).getLen() for p in paths)
    return max(context.defaultParallelism, min(-(-size // PART_BYTES), MOST_PARTS))


def dealt(df: DataFrame, keys: Sequence[str | Column], parts: int | None) -> DataFrame:
    """``df`` dealt by ``keys`` to so many partitions, or as many as Spark chooses."""
    return df.repartition(*keys) if parts is None else df.repartition(parts, *keys)


def bucketed(df: DataFrame, name: str, keys: Sequence[str], dealt: bool = False) -> DataFrame:
    """Like ``stored``, dealt into buckets by ``keys``: joins on all of them need no shuffle of this table.

    There are ``bucket_count`` buckets; ``dealt`` says that ``df`` has as many partitions by ``keys``. The catalog only lends its writer: the
    table is outside of it, and its entry goes at once.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    table = path.rpartition("/")[2].replace("-", "_")
    buckets = bucket_count(spark)
    rows = df if dealt else df.repartition(buckets, *keys)
    with _shuffles_deleted(spark):
        rows.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(table, format="parquet")
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return out
