"""Small helpers that several training-data operators use."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than these six.
SPACES = r"[\x20\x09-\x0D]"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Only a local session may do without that setting; it then gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as its own."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends here.

    The files outlive any executor, so a lost one costs no recomputation of what came before.
    They go when the application ends, or with ``discard``.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, at = _file_system(df.sparkSession, path)
    files.deleteOnExit(at)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``materialize`` wrote; nothing reads it any more."""
    names = {name.rsplit("/", 1)[0] for name in df.inputFiles()}
    for name in names:
        if name.rsplit("/", 1)[1].startswith("table-"):
            files, at = _file_system(df.sparkSession, name)
            files.delete(at, True)


#: Rows of a table that may be broadcast.
HOT = 10_000


def join_hot(rows: DataFrame, table: DataFrame, keys: list[str], n: str) -> DataFrame:
    """``rows`` joined with their key's row of ``table``, which has each key once and its rows' number ``n``.

    A table of up to HOT rows is broadcast. Beyond that its keys with more than one in HOT of all
    rows are, fewer than HOT of them, and the others' rows are shuffled: no key that is shuffled
    has more than one in HOT of all rows.
    """
    total, count = table.agg(F.sum(n), F.count(F.lit(1))).first()
    if count <= HOT:
        return rows.join(F.broadcast(table), keys)
    hot = (F.col(n) > total / HOT).alias("hot")
    often = F.broadcast(table.filter(hot))
    return rows.join(often, keys).unionByName(rows.join(often.select(keys), keys, "left_anti").join(table.filter(~hot), keys))


def hash60(text: Column) -> Column:
    """60-bit non-negative integer from MD5, the same in Spark and in other SQL engines."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def key_text(key: Column) -> Column:
    """A non-null text for a key of any type: null and the empty text stay apart."""
    return F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit(""))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once however often ``use`` mentions it."""
    return F.transform(F.array(value), use)[0]


def words_of(text: Column) -> Column:
    """The words of a text; null and blank texts have none."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACES + "+")
    return F.filter(parts, lambda w: w != "")
