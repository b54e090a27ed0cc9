"""Exact deduplication by a stateful stream over content digests.

The stream's keyed state lives in RocksDB on the executors' disks and is backed up to the shared
folder; it has no expiry. For each digest it retains the largest doc_id (the stable identifier),
the locator of that row's content (Parquet file and row number), and the number of rows. Digests
seen more than once are hits; for those the full texts are compared, and digests shared by
different texts are regrouped by text. ``deduplicate`` keeps the rows at the retained locators.

Native DataFrame and streaming operations only.

Edge cases: null text counts as empty; a null doc_id ranks below any other and stays only when its
whole group has null ids; of rows repeating both doc_id and text one stays, the one with the
largest locator; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FILE, ROW, cut, locate, pick, scratch, without

#: Disk-backed state under a bound of memory for all stores of an executor. Stores close when a
#: batch is done, and without fallocate they take the disk that they fill, not 4 MB ahead of need.
STORE = "spark.sql.streaming.stateStore"
STATE = {
    f"{STORE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{STORE}.unloadOnCommit": "true",
    f"{STORE}.rocksdb.allowFAllocate": "false",
    f"{STORE}.rocksdb.boundedMemoryUsage": "true",
    f"{STORE}.rocksdb.maxMemoryUsageMB": "96",
    f"{STORE}.rocksdb.writeBufferSizeMB": "4",
    f"{STORE}.rocksdb.maxWriteBufferNumber": "2",
}
#: Rows for each state store, which fixes their number when a stream begins.
STORE_ROWS = 500_000
#: Texts take part in the full comparison if their digest falls into a cell with a hit. Cells are
#: broadcast, at most so many numbers however many hits there are.
HIT_CELLS = 1 << 18


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _content(docs: DataFrame, digest) -> DataFrame:
    """doc_id, text, digest and locator of the rows of a located table."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = pick(docs, "doc_id", "text", FILE, ROW)
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), digest(text).alias("digest"), FILE, ROW)


def _best() -> Column:
    """The row that stays: the largest doc_id, then the largest locator."""
    return F.max(F.struct("doc_id", FILE, ROW)).alias("best")


def update_state(spark: SparkSession, keys_path: str, state_path: str, out_path: str) -> None:
    """Feed what is new under ``keys_path`` to the stream whose state lives at ``state_path``.

    Calling again after files were added resumes from the stored state. Each batch writes the
    digests that it touched, with its batch number, under ``out_path``; a batch that is retried
    after a failure overwrites its own folder.
    """
    keys = spark.read.parquet(keys_path)
    stores = max(spark.sparkContext.defaultParallelism, -(-keys.count() // STORE_ROWS))
    touched = spark.readStream.schema(keys.schema).parquet(keys_path).groupBy("digest").agg(_best(), F.count(F.lit(1)).alias("group_size"))

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_path}/batch={number}")

    settings = STATE | {"spark.sql.shuffle.partitions": str(stores)}  # a stream that resumes keeps its number
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, setting in settings.items():
        spark.conf.set(name, setting)
    try:
        query = (
            touched.writeStream.outputMode("update")
            .option("checkpointLocation", state_path)
            .trigger(availableNow=True)
            .foreachBatch(sink)
            .start()
        )
        query.awaitTermination()
    finally:
        for name, setting in before.items():
            spark.conf.unset(name) if setting is None else spark.conf.set(name, setting)


def read_state(spark: SparkSession, out_path: str) -> DataFrame:
    """The latest entry of each digest over all batches."""
    entry = F.struct("group_size", "best")  # a digest's count only grows
    schema = f"digest binary, best struct<doc_id: long, {FILE}: string, {ROW}: long>, group_size long, batch int"
    rows = spark.read.schema(schema).parquet(out_path)
    return rows.groupBy("digest").agg(F.max(entry).alias("e")).select("digest", "e.*")


def _cell(digest: str) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(HIT_CELLS))


def mark(docs: DataFrame, digest=sha256) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row.

    ``digest`` maps a text column to a binary column; a weak one exercises the full-text check.
    """
    return _mark(locate(docs), digest).drop(FILE, ROW)


def _mark(located: DataFrame, digest) -> DataFrame:
    """``mark`` with the rows' locators."""
    spark = located.sparkSession
    content = _content(located, digest)
    keys_path, out_path = scratch(spark, "dedup-keys"), scratch(spark, "dedup-out")
    sha = F.sha2("text", 256) if digest is not sha256 else F.lit(None).cast("string")
    content.select("doc_id", "digest", sha.alias("sha"), FILE, ROW).write.parquet(keys_path)
    keys = spark.read.parquet(keys_path)
    if keys.isEmpty():
        return _marked(keys.withColumns({"best": F.struct("doc_id", FILE, ROW), "group_size": F.lit(1).cast("long")}))
    update_state(spark, keys_path, scratch(spark, "dedup-state"), out_path)
    state = cut(read_state(spark, out_path), "dedup-held")

    # Full bytes are compared on hits. Grouping by the text itself combines a group's copies in
    # each task before the shuffle, so a group with a third of all rows travels as a few.
    cells = state.filter("group_size > 1").select(_cell("digest").alias("cell")).distinct()
    seen = content.select("digest", "text").join(F.broadcast(cells), _cell("digest") == F.col("cell"), "left_semi")
    texts = seen.groupBy("digest", "text").agg(F.lit(1).alias("one"))
    clash = cut(texts.groupBy("digest").count().filter("count > 1").select("digest"), "dedup-clash")

    same = keys.join(state.withColumnRenamed("digest", "__d"), F.col("digest") == F.col("__d"), "inner").drop("__d")
    if clash.isEmpty():
        return _marked(same)
    odd = content.join(clash, "digest", "left_semi")
    groups = odd.groupBy(F.col("digest").alias("__d"), F.col("text").alias("__t")).agg(_best(), F.count(F.lit(1)).alias("group_size"))
    apart = odd.join(groups, (F.col("digest") == F.col("__d")) & (F.col("text") == F.col("__t")), "inner").select(
        "doc_id", "digest", F.sha2("text", 256).alias("sha"), FILE, ROW, "best", "group_size"
    )
    return _marked(same.join(clash, "digest", "left_anti").unionByName(apart))


def _marked(rows: DataFrame) -> DataFrame:
    return rows.select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        ((F.col(FILE) == F.col(f"best.{FILE}")) & (F.col(ROW) == F.col(f"best.{ROW}"))).alias("kept"),
        F.coalesce("sha", F.lower(F.hex("digest"))).alias("text_sha256"),
        FILE,
        ROW,
    )


def deduplicate(docs: DataFrame) -> DataFrame:
    """The input rows that stay, all columns: one of each text."""
    located = locate(docs)
    return without(located, _mark(located, sha256).filter("not kept"))
