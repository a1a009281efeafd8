"""Session helpers: a local session for tests and benchmarks, and durable staging of intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", memory: str = "8g") -> SparkSession:
    """Session for tests and benchmarks; a cluster brings its own session and settings."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("sigeval")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.local.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def stage_root(spark: SparkSession) -> str:
    """Shared folder for staged tables: the cluster's `spark.checkpoint.dir`.

    A temporary folder is used only on a local master (tests), where driver and executors share the disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder")
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


_STAGED: list[str] = []


#: Shuffle files go when the execution that wrote them ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged_tables() -> int:
    """Number of tables that this process has staged and not dropped."""
    return len(_STAGED)


def drop_staged(first: int = 0, last: int | None = None) -> int:
    """Delete the tables staged by this process so far, once no result that reads them is needed; returns their number.

    `first` and `last` are values of `staged_tables()` between which the tables were staged.
    """
    from pyarrow.fs import FileSystem

    dropped, uris = 0, _STAGED[first:last]
    del _STAGED[first:last]
    for uri in uris:
        files, path = FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and "://" not in uri else uri)
        files.delete_dir(path)
        dropped += 1
    return dropped


def stage(df: DataFrame) -> DataFrame:
    """Write a result that several branches read, and read it back. `drop_staged` deletes such tables.

    The table is durable, so a lost executor never recomputes the branches above it, and the branches
    get column pruning and real size statistics instead of repeating the upstream joins. Its shuffle files are removed with the write.
    """
    spark = df.sparkSession
    path = f"{stage_root(spark)}/stage-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    _STAGED.append(path)
    return spark.read.schema(df.schema).parquet(path)


ROWS_PER_TASK = 1 << 17


def tasks_for(staged: DataFrame) -> int:
    """As many partitions as keep a task at about ROWS_PER_TASK rows of a staged table; the number of shuffle partitions is the least.

    Counting a staged table reads file footers only.
    """
    least = int(staged.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-staged.count() // ROWS_PER_TASK))


def spread(staged: DataFrame, *keys: str) -> DataFrame:
    """A staged table by hash of the keys, in `tasks_for(staged)` partitions."""
    return staged.repartition(tasks_for(staged), *keys)
