"""Written tables between stages, in the folder that spark.checkpoint.dir names."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only where that is unset, as in tests, one of this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        set_already = spark.sparkContext.getCheckpointDir()
        if not set_already and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = set_already or "file://" + tempfile.mkdtemp(prefix="tidemark-")
        if not set_already:
            spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


#: What keep() and keep_buckets() wrote and clean() may delete: paths, and names of tables.
_paths: list[str] = []
_tables: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def free_names(taken: list[str], names: list[str]) -> list[str]:
    """The names with as many underscores as it takes until none is taken; Spark tells names apart without their case."""
    held = {x.lower() for x in taken}
    while held & {x.lower() for x in names}:
        names = [x + "_" for x in names]
    return names


def keep(df: DataFrame, name: str) -> DataFrame:
    """The rows as a written table, reread: cuts the lineage and survives the loss of executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    _paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keep_table(df: DataFrame, name: str, column: str, *order: str, dealt: bool = False) -> str:
    """The name of a written table of the rows, in buckets of a column, as many as a shuffle has partitions, each in order of the
    column and of those in `order`: joins by the column don't move them. dealt: they lie by the column already, as after a
    groupBy."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = new_path(spark, name)
    table = _table_of(path)
    rows = df if dealt else df.repartition(n, column)
    rows.write.bucketBy(n, column).sortBy(column, *order).option("path", path).format("parquet").saveAsTable(table)
    _paths.append(path)
    _tables.append(table)
    return table


def _table_of(path: str) -> str:
    return path.rsplit("/", 1)[1].replace("-", "_")


def keep_buckets(df: DataFrame, name: str, column: str, *order: str, dealt: bool = False) -> DataFrame:
    """The rows of keep_table()."""
    return df.sparkSession.table(keep_table(df, name, column, *order, dealt=dealt))


def drop_table(spark: SparkSession, table: str) -> None:
    """Delete a table that keep_table() wrote, with its files."""
    for path in [p for p in _paths if _table_of(p) == table]:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        drop_path(spark, path)
        _paths.remove(path)
        _tables.remove(table)


def released(tables: set[str]) -> None:
    """Let clean() leave what keep(), keep_buckets() and keep_table() wrote under these names of tables."""
    _paths[:] = [p for p in _paths if _table_of(p) not in tables]
    _tables[:] = [t for t in _tables if t not in tables]


def folders(df: DataFrame) -> set[str]:
    """Where the files of a written table lie."""
    return {f.rsplit("/", 1)[0] for f in df.inputFiles()}


def clean(spark: SparkSession) -> None:
    """Delete every working table so far; call it once the results that read them are written."""
    while _tables:
        spark.sql(f"DROP TABLE IF EXISTS {_tables.pop()}")
    while _paths:
        drop_path(spark, _paths.pop())


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let Arrow batches of texts have so many rows at most: texts can be long and a batch is held in memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def give_back() -> None:
    """Return freed memory to the system: Python workers live on between tasks, beside the executor's other processes."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def free_shuffles(spark: SparkSession) -> None:
    """Let the driver's collector find shuffles that no table refers to any more: Spark then deletes their files, which else stay
    until the driver happens to collect."""
    gc.collect()
    spark.sparkContext._jvm.java.lang.System.gc()


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table that keep() wrote, once nothing reads it any more."""
    for folder in folders(df):
        drop_path(df.sparkSession, folder)
