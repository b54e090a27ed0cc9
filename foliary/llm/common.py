"""Shared helpers: scratch tables in the cluster's shared folder, and column guards."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: the ASCII characters that the contracts name.
SPACES = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: ``spark.checkpoint.dir``.

    Where the setting is absent and the master is local (tests on one machine), a temporary folder
    takes its place and is registered with the context, so later calls find the same one. On a
    cluster a missing setting is an error: executors would not see each other's folders.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not sc._jsc.sc().isLocal():
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="foliary-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def _folder(spark: SparkSession, path: str):
    """The path and its file system, as Hadoop has them."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(sc._jsc.hadoopConfiguration())


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder; unique, so that reruns never meet old files.

    All paths of an application lie in one folder, which goes when the application ends.
    """
    top = f"{shared_dir(spark)}/foliary/{spark.sparkContext.applicationId}"
    at, fs = _folder(spark, top)
    if not fs.exists(at):
        fs.mkdirs(at)
        fs.deleteOnExit(at)
    return f"{top}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Remove a table that nothing reads any more."""
    at, fs = _folder(spark, path)
    fs.delete(at, True)


#: Bytes of an Arrow batch that goes to Python.
BATCH_BYTES = 4 << 20
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def texts_of(docs: DataFrame, *columns: Column | str) -> DataFrame:
    """Columns of ``docs`` for an Arrow function, in batches of bounded size.

    A batch is 10,000 rows unless bytes end it, and so many long texts would take hundreds of MB on
    either side. The session's own bound stays, if it has one.
    """
    conf = docs.sparkSession.conf
    if conf.get(BATCH, None) is None:
        conf.set(BATCH, str(BATCH_BYTES))
    return docs.select(*columns)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This ends the lineage: a lost executor costs a re-read, not a recomputation.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it any number of times in ``body``."""
    return F.transform(F.array(value), body)[0]


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that other columns can never clash with working ones."""
    return df.select(*[F.col(f"`{n}`") for n in names])


#: Columns that ``locate`` adds: where a row's content lies.
FILE, ROW = "__foliary_file", "__foliary_row"


def locate(docs: DataFrame) -> DataFrame:
    """``docs`` with a locator of each row: its Parquet file and its number within it.

    A table read from Parquet has them already; anything else is written to the shared folder
    first. Repeated rows have locators of their own.
    """
    try:
        if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
            raise ValueError("rows of a derived table share or lack locators")
        at = docs.metadataColumn("_metadata")
        return docs.select("*", at["file_path"].alias(FILE), at["row_index"].alias(ROW))
    except (AnalysisException, AttributeError, ValueError):
        held = cut(docs, "located")
        at = held.metadataColumn("_metadata")
        return held.select("*", at["file_path"].alias(FILE), at["row_index"].alias(ROW))


def without(located: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of a located table whose locators aren't among ``gone``, without the locators."""
    names = [c for c in located.columns if c not in (FILE, ROW)]
    return pick(located.join(gone.select(FILE, ROW), [FILE, ROW], "left_anti"), *names)
