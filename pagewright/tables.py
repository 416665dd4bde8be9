"""Tables between the steps of a job: written to the shared folder, with their size known, broadcast only within a bound."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes up to which a side whose size has been measured is broadcast; beyond it the join shuffles.
BROADCAST_BYTES = 32 << 20
#: Bytes that a row takes in a broadcast besides its values.
ROW_BYTES = 32
#: Rows for each task, and so for each file, of a small table that is written after a shuffle.
TASK_ROWS = 50_000

_own_scratch: list[str] = []
#: Tables of the innermost workspace of this thread, and those written outside any.
_inside: ContextVar[list[str] | None] = ContextVar("tables of the workspace", default=None)
_loose: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``. Only a local session may go without: it gets a local one."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_scratch:
        _own_scratch.append(tempfile.mkdtemp(prefix="spark-scratch-"))
    return _own_scratch[0]


def width(name: Column, kind: T.DataType) -> Column:
    """About how many bytes a value takes."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(name), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType)):
            return F.coalesce(F.aggregate(name, F.lit(0).cast("long"), lambda a, x: a + width(x, kind.elementType)), F.lit(0)) + 16
        return F.greatest(F.size(name), F.lit(0)) * 8 + 16
    if isinstance(kind, T.StructType):
        return sum((width(name[f.name], f.dataType) for f in kind.fields), F.lit(8))
    return F.lit(8)


def measures(df: DataFrame) -> list[Column]:
    """Aggregates for the number of rows and their bytes."""
    each = sum((width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(ROW_BYTES))
    return [F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(each.cast("long")), F.lit(0)).alias("bytes")]


def saved(df: DataFrame, rows: int | None = None, sized: bool = True, codec: str | None = None, level: int | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts lineage, survives lost executors.

    Rows and bytes are taken from the write; ``rows_of`` and ``small_side`` read them without another job. ``rows``,
    if known to be the most that can come, keeps small tables in few files. Without ``sized`` the bytes are not taken,
    for wide tables that are never broadcast. ``codec`` is Parquet's, and ``level`` that of
    zstd.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/table-{uuid.uuid4().hex}"
    _own().append(path)
    seen = Observation()
    out = df if rows is None else df.coalesce(max(1, -(-rows // TASK_ROWS)))
    writer = out.observe(seen, *measures(df)[: 1 + sized]).write
    if level is not None:
        writer = writer.option("parquet.compression.codec.zstd.level", level)
    writer.parquet(path, compression=codec)
    got = seen.get
    back = spark.read.schema(df.schema).parquet(path)
    back._pagewright = (got["n"], got.get("bytes", BROADCAST_BYTES + 1), path)
    return back


def buckets_of(spark: SparkSession) -> int:
    """Buckets of a table unless told otherwise: as many as a shuffle has partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucketed(df: DataFrame, key: str, buckets: int | None = None, dealt: bool = False, codec: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder, dealt into buckets by ``key``, and read it back.

    Grouping, windows and joins on ``key`` (between tables of as many buckets) then need no exchange, however often
    and by whatever step the table is read. ``buckets`` should keep one bucket's rows within a task's memory. ``dealt``:
    the rows already come from a table of as many buckets, or dealt into as many parts, so they are not shuffled once more.
    ``codec`` is Parquet's.
    """
    spark = df.sparkSession
    name = f"bucketed_{uuid.uuid4().hex}"
    path = f"{scratch_dir(spark)}/{name}"
    n = buckets or buckets_of(spark)
    _own().append(path)
    seen = Observation()
    out = df if dealt else df.repartition(n, key)
    writer = out.observe(seen, measures(df)[0]).write.bucketBy(n, key).option("path", path)
    if codec is not None:
        writer = writer.option("compression", codec)
    writer.format("parquet").saveAsTable(name)
    back = spark.table(name)
    back._pagewright = (seen.get["n"], BROADCAST_BYTES + 1, path)
    return back


def rows_of(df: DataFrame) -> int:
    """Number of rows of a table from ``saved``."""
    return df._pagewright[0]


def new_folder(spark: SparkSession, kind: str) -> str:
    """The path of a new folder in the shared folder, deleted when tables saved now would be."""
    path = f"{scratch_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    _own().append(path)
    return path


def _own() -> list[str]:
    inside = _inside.get()
    return _loose if inside is None else inside


def _delete(spark: SparkSession, paths: list[str]) -> int:
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    n = 0
    for name in paths:
        table = name.rpartition("/")[2]
        if table.startswith("bucketed_"):
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        n += bool(path.getFileSystem(conf).delete(path, True))
    return n


def drop_saved(spark: SparkSession) -> int:
    """Delete the tables that ``saved`` wrote in this process outside workspaces or that workspaces kept, once no result
    needs them; returns how many."""
    gone = _loose[:]
    del _loose[: len(gone)]
    return _delete(spark, gone)


@contextmanager
def workspace(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Tables that this thread saves inside go at its end, but for those put into the list it gives.

    What is kept belongs to the workspace around this one, if there is one. After an error nothing is kept. Tables of
    other threads, and of workspaces around this one, are never touched.
    """
    mine, keep = [], []
    token = _inside.set(mine)
    try:
        yield keep
    except BaseException:
        keep.clear()
        raise
    finally:
        _inside.reset(token)
        kept = {df._pagewright[2] for df in keep}
        _own().extend(p for p in mine if p in kept)
        _delete(spark, [p for p in mine if p not in kept])


def small_side(df: DataFrame, limit: int = BROADCAST_BYTES, size_of: DataFrame | None = None) -> DataFrame:
    """``df`` with a broadcast hint if its measured bytes stay within ``limit``, else unchanged (shuffle join).

    ``size_of`` is a table from ``saved`` that ``df`` is no wider and no longer than.
    """
    known = getattr(df if size_of is None else size_of, "_pagewright", None)
    size = known[1] if known else df.agg(*measures(df)).first()["bytes"]
    return F.broadcast(df) if size <= limit else df


def is_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether a table from ``saved`` may be broadcast."""
    return df._pagewright[1] <= limit
