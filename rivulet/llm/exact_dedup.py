"""Exact deduplication by a stateful stream.

Each row becomes a small record: digest of its normalised text, its id, and a locator (file and row)
of its content. A structured stream folds the records into keyed state that lives on disk (RocksDB) and
never expires: for each digest the largest id with its locator, and the number of rows. Spark combines
the records of a digest within each task before the shuffle, so a group with a third of all rows sends
one record per task. Afterwards the full bytes of all rows that hit another one's digest are compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import ascii_lower, shared_dir, stable, with_locator, written

#: Groups with more rows than 1 / HOT of all, and than LEAST_HOT, are joined by broadcast.
HOT, LEAST_HOT = 5000, 1000
#: Micro-batches that the stream takes the records in, about: keyed state is met again by all but the first.
BATCHES = 4
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def sha256(norm: Column) -> Column:
    # known not to be null, so that no filter computes it a second time
    return F.coalesce(F.unhex(F.sha2(norm.cast("binary"), 256)), F.lit(b""))


def _sieved(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """The rows whose digest begins with the same 24 bits as one of ``hits``: most others need no shuffle then.

    The bits are a bitmap of 2 ** 24 places in at most 513 rows, 2 MB at any size of the corpus.
    """
    place = (F.coalesce(F.conv(F.hex(F.substring("digest", 1, 3)), 16, 10).cast("long"), F.lit(0)) + 1).alias("place")
    bits = hits.select(place).groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bitmap"))
    at = F.bitmap_bit_position("place")
    byte = F.conv(F.hex(F.substring(F.col("bitmap"), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    set_bit = F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
    found = rows.withColumn("place", place).withColumn("bucket", F.bitmap_bucket_number("place")).join(F.broadcast(bits), "bucket").where(set_bit)
    return found.select(*rows.columns)


def fold(records: DataFrame, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """The state after all records: digest, keep_id, keep_file, keep_row, group_size.

    ``records`` (digest, id, _file, _row) are the Parquet files in ``folder``, which the stream reads. Every
    batch writes the keys that it changed to a folder of its own, anew if it runs again. As a group only
    grows and its id only rises, the largest values are the last ones. By default the files come in BATCHES
    micro-batches, or as many as there are files, whatever the size of the corpus.
    """
    make = records.sparkSession._jvm.org.apache.hadoop.fs.Path(f"{folder}/part-*")
    files = len(make.getFileSystem(records.sparkSession._jsc.hadoopConfiguration()).globStatus(make))
    files_per_batch = files_per_batch or max(1, -(-files // BATCHES))
    spark = records.sparkSession.newSession()
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        spark.conf.set(name, records.sparkSession.conf.get(name))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage", "true")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    # each state partition else reserves megabytes of disk that it never fills
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")
    base = shared_dir(spark, "state")
    out = f"{base}/updates"
    best = F.max(F.struct("id", "_file", "_row")).alias("top")
    reader = spark.readStream.schema(records.schema).option("maxFilesPerTrigger", files_per_batch)
    state = reader.parquet(folder).groupBy("digest").agg(best, F.count(F.lit(1)).alias("group_size"))

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = state.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", f"{base}/stream").trigger(availableNow=True).start()
    query.awaitTermination()
    updates = records.sparkSession.read.schema(state.schema).parquet(out)
    updates = updates.groupBy("digest").agg(F.max("top").alias("top"), F.max("group_size").alias("group_size"))
    return written(updates, "state").select("digest", F.col("top.id").alias("keep_id"), F.col("top._file").alias("keep_file"), F.col("top._row").alias("keep_row"), "group_size")


def exact_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = sha256, files_per_batch: int | None = None) -> DataFrame:
    """One row per row of ``docs``: its id, _file and _row, digest, keep_id, group_size and is_kept.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. The row with the largest
    id stays (a null id is the smallest); of rows with that same id, the last by file and row. ``digest``
    may be any function of the normalised text: rows of one digest whose bytes differ are found by the
    full comparison and are then grouped by the text itself.
    """
    rows = with_locator(docs, F.col(doc_id).alias("id"), ascii_lower(F.col(text)).alias("norm"))
    folder = shared_dir(docs.sparkSession, "records")
    rows.select("id", "_file", "_row", digest(F.col("norm")).alias("digest")).write.parquet(folder)
    records = docs.sparkSession.read.parquet(folder)
    state = fold(records, folder, files_per_batch)

    # no more than HOT groups can be larger than this: they are broadcast, so that their rows stay where they are
    large = max(LEAST_HOT, records.count() // HOT)
    hot, cold = F.broadcast(state.where(F.col("group_size") > large)), state.where(F.col("group_size") <= large)
    others = lambda df: df.join(hot.select("digest"), "digest", "left_anti")

    # full bytes on hits (inner joins with distinct digests: Spark would move a semi-join below the sieve): equal texts of a large group collapse in each task before the shuffle
    both = _sieved(rows.select(digest(F.col("norm")).alias("digest"), "norm"), state.where("group_size > 1"))
    texts = both.join(hot.select("digest"), "digest").groupBy("digest", "norm").count()
    texts = texts.union(others(both).join(cold.where("group_size > 1").select("digest"), "digest").groupBy("digest", "norm").count())
    clash = written(texts.groupBy("digest").count().where("count > 1").select("digest"), "clashes")
    keep = [F.col("keep_id"), F.col("keep_file"), F.col("keep_row"), F.col("group_size")]
    if clash.isEmpty():
        out = records.join(hot, "digest").union(others(records).join(cold, "digest")).select("id", "_file", "_row", "digest", *keep)
    else:
        good = records.join(state.join(clash, "digest", "left_anti"), "digest").select("id", "_file", "_row", "digest", *keep)
        mixed = rows.withColumn("digest", digest(F.col("norm"))).join(clash, "digest", "left_semi")
        classes = mixed.groupBy("digest", "norm").agg(F.max(F.struct("id", "_file", "_row")).alias("top"), F.count(F.lit(1)).alias("group_size"))
        classes = classes.select("digest", "norm", F.col("top.id").alias("keep_id"), F.col("top._file").alias("keep_file"), F.col("top._row").alias("keep_row"), "group_size")
        out = good.unionByName(mixed.join(classes, ["digest", "norm"]).select("id", "_file", "_row", "digest", *keep))
    same = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("_file") == F.col("keep_file")) & (F.col("_row") == F.col("keep_row"))
    return out.withColumn("is_kept", same)


def drop_exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all its columns, one for each distinct text (see ``exact_classes``)."""
    docs = stable(docs)
    kept = exact_classes(docs, doc_id, text).where("is_kept").select("_file", "_row")
    return with_locator(docs).join(kept, ["_file", "_row"], "left_semi").select("row.*")
