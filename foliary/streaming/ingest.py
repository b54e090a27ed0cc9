"""Streaming: files as they arrive, deduplicated by digest, and the latest revision of each document.

An extension of the batch engine; the same section parsers run on the arriving files.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..sources.pdf import parse, rows

FILES = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, path: str, per_trigger: int = 1000) -> DataFrame:
    """New PDF files below a path, as a stream of binary rows."""
    return (
        spark.readStream.format("binaryFile")
        .schema(FILES)
        .option("pathGlobFilter", "*.pdf")
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", per_trigger)
        .load(path)
    )


def distinct_files(files: DataFrame, delay: str = "1 hour") -> DataFrame:
    """One row for each content within the watermark; state older than that is dropped."""
    keyed = files.withColumn("sha256", F.sha2("content", 256)).withWatermark("modificationTime", delay)
    return keyed.dropDuplicatesWithinWatermark(["sha256"])


def append_sections(files: DataFrame, target: str, checkpoint: str, names: tuple[str, ...] = ("documents", "pages")):
    """Parse each batch once for every section and append it; a repeated batch overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        parsed = parse(batch, names).persist()
        try:
            for name in names:
                rows(parsed, name).write.mode("overwrite").parquet(f"{target}/{name}/batch={number}")
        finally:
            parsed.unpersist()

    return files.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def counts_by_window(events: DataFrame, time: str, key: str, size: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Events by tumbling window and key; late ones count until the watermark passes."""
    return (
        events.withWatermark(time, delay)
        .groupBy(F.window(time, size).alias("w"), key)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("start"), key, "n")
    )


class Latest(StatefulProcessor):
    """Keeps each key's newest row, by (order, tie), as state without expiry; gives it whenever it changes."""

    def __init__(self, schema: StructType, order: str, tie: str):
        self.schema, self.names, self.at = schema, schema.names, [schema.names.index(c) for c in (order, tie)]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("latest", self.schema)

    def handleInputRows(self, key, rows, timerValues):
        best = self.held.get() if self.held.exists() else None
        newest = best
        for row in rows:
            mine = tuple(row[n] for n in self.names)
            if newest is None or tuple(mine[i] for i in self.at) > tuple(newest[i] for i in self.at):
                newest = mine
        if newest is not best:
            self.held.update(newest)
            yield Row(**dict(zip(self.names, newest, strict=True)))

    def close(self) -> None:
        pass


def latest_by_state(stream: DataFrame, key: str, order: str, tie: str) -> DataFrame:
    """A stream of each key's newest row whenever a newer one arrives; needs RocksDB state stores."""
    schema = StructType([f for f in stream.schema.fields])
    return stream.groupBy(key).transformWithState(Latest(schema, order, tie), schema, "Update", "None")


def latest_revisions(history: DataFrame, key: str = "path", order: str = "modificationTime") -> DataFrame:
    """The newest row of each key in a table that a stream has appended to."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return history.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def tagged_sessions(events: DataFrame, key: str, time: str, gap: str = "30 minutes", delay: str = "2 hours") -> DataFrame:
    """Events by session window and key: a session ends after a gap without events."""
    return (
        events.withWatermark(time, delay)
        .groupBy(F.session_window(time, gap).alias("w"), key)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")
    )


def rows_arriving(spark: SparkSession, folder: str, files: str = "*.parquet") -> DataFrame:
    """Parquet files of a folder, and those added to it, as a stream; times of no zone are those of the session's."""
    reader = spark.readStream.schema(spark.read.option("pathGlobFilter", files).parquet(folder).schema)
    stream = reader.option("pathGlobFilter", files).parquet(folder)
    return stream.withColumns({c: F.col(c).cast("timestamp") for c, kind in stream.dtypes if kind == "timestamp_ntz"})


#: What streams with state of their own need; set while they run. A batch's changes are written, not every file of the store.
STORES = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which goes when the application ends; on one machine without that setting, a temporary one."""
    sc = spark.sparkContext
    top = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not sc._jsc.sc().isLocal():
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        top = tempfile.mkdtemp(prefix="foliary-")
    path = f"{top.rstrip('/')}/drained-{uuid.uuid4().hex}"
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(sc._jsc.hadoopConfiguration())
    files.mkdirs(at)
    files.deleteOnExit(at)
    return path


def drained(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """The result of a stream over what is there, as a Parquet table in the shared folder.

    Executors write it and nothing is gathered by the driver. In complete mode the last batch is
    the result, in others all batches are.
    """
    spark, top = stream.sparkSession, shared_folder(stream.sparkSession)
    numbers: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{top}/rows/{number}")
        numbers.append(number)

    before = {k: spark.conf.get(k, None) for k in STORES}
    for k, v in STORES.items():
        spark.conf.set(k, v)
    try:
        stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{top}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    found = sorted(set(numbers))[-1:] if mode == "complete" else sorted(set(numbers))
    if not found:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(*[f"{top}/rows/{n}" for n in found])
