"""Session settings and the shared folder that intermediate tables go to."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows of names and counts up to this number are sent to every task; more are shuffled.
SMALL_ROWS = 50_000
# Bytes of files behind a partition of steps that sort or hash all of it: names and keys in memory
# take up to a hundred times what they take in columns of files.
FILE_BYTES = 4 << 20
# Bytes of files behind a slice of a job whose shuffles would else lie on disk all at once, and the most slices.
SLICE_BYTES = 64 << 20
MOST_SLICES = 2
# How files are written that are large and sorted: names of a graph take their common beginnings once, and no
# dictionary of names, which are mostly different, is tried before.
NAMES = ("full_name", "table_name", "src", "dst")
PACKED = {"compression": "zstd", "parquet.writer.version": "v2"}
PACKED |= {f"parquet.enable.dictionary#{name}": "false" for name in NAMES}
# Files that are looked at to estimate the bytes of many.
FILES_ASKED = 100

_written: list[str] = []


def build_session(app_name: str = "cartulary", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the library is tuned for.

    Shuffle partitions are left to the cluster: AQE coalesces small ones and splits skewed
    ones, so only a starting number matters and that depends on the cluster's size. Skewed joins
    are split even where that costs another shuffle. AQE also hashes instead of sorting where every partition of the smaller side stays below a bound.
    Tables laid out by a column of a few values are written without sorting by it.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "64m")
        .config("spark.sql.maxConcurrentOutputFileWriters", "16")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """Folder shared by all executors, as the cluster names it in ``spark.checkpoint.dir``.

    A local session without that setting uses a folder in its warehouse; a cluster must name one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir().rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"


def stamped_name() -> str:
    """A name of its own that sorts by time."""
    return f"{time.time_ns():020d}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage, survives lost executors, and gives the optimizer real sizes to choose
    join strategies from. ``by`` names columns of few values to lay the files out by, so that
    a filter on them opens no others.
    """
    path = f"{scratch_root(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.partitionBy(list(by)).parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(df.columns)


def materialize_slices(slices: Iterable[tuple[str, DataFrame]], label: str, by: str) -> DataFrame:
    """Slices of a table, written one after the other to one folder and read back as a whole.

    Each comes with its value of the column ``by``, which files are laid out by. What a slice has
    shuffled is deleted before the next one begins.
    """
    path = None
    for value, df in slices:
        spark = df.sparkSession
        if path is None:
            path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
            _written.append(path)
        with shuffles_dropped(spark):
            df.drop(by).write.mode("append").options(**PACKED).parquet(f"{path}/{by}={value}")
    return spark.read.schema(df.schema).parquet(path).select(df.columns)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Writes inside it delete their shuffle files when they end, not when the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def starting_partitions(spark: SparkSession) -> int:
    """How many partitions the session's shuffles start with."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def partitions_for(*frames: DataFrame, least: int | None = None) -> int:
    """Partitions for steps that hold a whole one: as many as the files behind the rows ask for.

    The session's number at least, or the one that is given, so a larger table means more
    partitions, not larger ones.
    """
    return extent_of(*frames, least=least)[0]


def extent_of(*frames: DataFrame, least: int | None = None) -> tuple[int, int]:
    """Partitions for steps that hold a whole one, and slices that a job over all rows is cut into.

    Slices are a power of two and few: each reads all rows again to pick its own.
    """
    spark = frames[0].sparkSession
    read = _bytes_of(spark, {f for df in frames for f in df.inputFiles()})
    slices = 1
    while slices < MOST_SLICES and slices * SLICE_BYTES < read:
        slices *= 2
    return max(least or starting_partitions(spark), -(-read // FILE_BYTES)), slices


def _bytes_of(spark: SparkSession, files: set[str]) -> int:
    """The size of all files, estimated from some if they are many."""
    listed = sorted(files)
    asked = listed[:: -(-len(listed) // FILES_ASKED) or 1]
    java, conf, total = spark._jvm, spark._jsc.hadoopConfiguration(), 0
    for name in asked:
        path = java.org.apache.hadoop.fs.Path(java.java.net.URI(name))
        total += path.getFileSystem(conf).getFileStatus(path).getLen()
    return total * len(listed) // max(len(asked), 1)


def spread(df: DataFrame, *keys: str, number: int | None = None) -> DataFrame:
    """Rows dealt out by keys, for steps that sort or hash their whole partition.

    AQE merges partitions by their compressed bytes, and names that differ in a few digits take up
    many times as much in memory; a number that is asked for is left as it is.
    """
    return df.repartition(number or partitions_for(df), *keys)


def sorted_by(df: DataFrame, *keys: str, number: int | None = None) -> DataFrame:
    """All rows in order, by ranges that are as many as ``spread`` has partitions."""
    ranges = df.repartitionByRange(number or partitions_for(df), *keys)
    return ranges.sortWithinPartitions(*keys)


def written_small(df: DataFrame, label: str, limit: int = SMALL_ROWS) -> DataFrame:
    """``df`` written aside and marked for broadcast if it has few rows.

    Counting what was written reads only file footers. Beyond the limit the plain table is
    returned, and joins with it are shuffled as usual.
    """
    staged = materialize(df, label)
    return F.broadcast(staged) if staged.count() <= limit else staged


def drop_written(spark: SparkSession) -> int:
    """Deletes the tables this process wrote aside; results that still read them are lost.

    Returns how many there were.
    """
    count = len(_written)
    while _written:
        delete(spark, _written.pop())
    return count


def newest() -> str:
    """The folder of the table that was written aside last."""
    return _written[-1]


def drop_one(spark: SparkSession, path: str) -> None:
    """Deletes one table that was written aside; results that still read it are lost."""
    _written.remove(path)
    delete(spark, path)


def children(spark: SparkSession, path: str) -> list[str]:
    """The names of what lies in a folder, in order; none if there is no such folder."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    return sorted(status.getPath().getName() for status in files.listStatus(folder))


def make_folder(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder, on whatever file system it is."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def discarding(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes at its end what was written aside inside it, but for the tables to keep.

    Yields a function that marks the table written last as one to keep and returns it. For steps
    whose result is read from a few of the many tables they write on the way.
    """
    start, kept = len(_written), []

    def keep(staged: DataFrame) -> DataFrame:
        kept.append(_written[-1])
        return staged

    try:
        yield keep
    finally:
        inside = _written[start:]
        _written[start:] = kept
        for path in inside:
            if path not in kept:
                delete(spark, path)
