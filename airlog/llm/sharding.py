"""Sharding by a two-pass external shuffle, with DataFrame operations only.

Pass one scatters records by seeded hashes: a record's shard is the one with the highest hash of (id, shard), so a further shard
takes records from all others and none moves otherwise; inside its shard a further hash puts it into one of so many buckets that
each fits in memory. Pass two gathers one bucket at a time, permutes it (Spark's `shuffle` is a Fisher-Yates shuffle) and writes
it as a stretch of its shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airlog.llm.common import shared_folder, shuffle_partitions, written

#: Buckets that a task gathers, one after the other.
BUCKETS_A_TASK = 8


def shard_of(ident: Column, shards: int, seed: int = 0) -> Column:
    """The shard of an id among so many: decided by the id and the count alone. A null id is an id."""
    scores = F.array(*[F.xxhash64(F.lit(seed), F.lit(s), ident) for s in range(shards)])
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def write_shards(docs: DataFrame, path: str, shards: int = 16, seed: int = 0, bucket_bytes: int = 16 << 20,
                 id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write (id, text, size, slot, grown_shard) below path, one folder shard=0.. for each shard.

    size is the UTF-8 bytes of the text plus 1 (null: 1). slot numbers a shard's records from 0 without gaps, in the order they
    are written. grown_shard is the shard that the record would have if there were one more. Null and empty texts and repeated
    rows are records like others; a null id is an id. An empty table writes an empty folder.

    The number of buckets follows from the total size, so that one holds about bucket_bytes; one record larger than that has a
    bucket to itself or makes one larger by its own size. Rows that are repeated beyond bucket_bytes are counted first and their
    copies dealt evenly over all buckets of their shard.
    """
    records = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn(
        "size", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long"))
    hashed = records.withColumn("hash", F.xxhash64(F.lit(seed), F.lit("bucket"), F.col("id"), F.col("text")))
    repeats = hashed.groupBy("hash", "size").agg(F.count(F.lit(1)).alias("copies"))
    # a row for every bucket_bytes of input at most; written, so that its size is known before the records meet it
    heavy = written(repeats.where((F.col("copies") > 1) & (F.col("copies") * F.col("size") > bucket_bytes)).select(
        "hash", "size"), "repeated")
    total = records.agg(F.sum("size")).first()[0] or 0
    buckets = max(1, -(-total // (shards * bucket_bytes)))
    columns = ["id", "text", "size", "hash"]
    single = hashed.join(heavy, ["hash", "size"], "left_anti").select(
        *columns, F.pmod("hash", F.lit(buckets)).cast("int").alias("bucket"), F.lit(1).cast("long").alias("copies"))
    each = hashed.join(heavy, ["hash", "size"], "left_semi").groupBy(*columns).agg(F.count(F.lit(1)).alias("all"))
    dealt = each.select(*columns, "all", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"))
    dealt = dealt.withColumn("copies", F.floor((F.col("all") + F.lit(buckets - 1) - F.col("bucket")) / buckets)).where(
        "copies > 0").select(*columns, "bucket", "copies")
    scattered = single.unionByName(dealt).withColumn("shard", shard_of(F.col("id"), shards, seed))
    starts = scattered.groupBy("shard", "bucket").agg(F.sum("copies").alias("count")).select(
        "shard", "bucket", (F.sum("count").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("count")).alias("start"))
    # a number of partitions that the input decides, and sorted buckets: what shuffle() draws is the same whenever a task is run again
    tasks = max(shuffle_partitions(docs.sparkSession), shards * buckets // BUCKETS_A_TASK)
    gathered = scattered.repartition(tasks, "shard", "bucket").groupBy("shard", "bucket").agg(
        F.sort_array(F.collect_list(F.struct("hash", "id", "text", "size", "copies"))).alias("records"))
    spread = F.flatten(F.transform("records", lambda r: F.array_repeat(r, r["copies"].cast("int"))))
    # before the join, which may deal the buckets anew
    shuffled = gathered.sortWithinPartitions("shard", "bucket").select("shard", "bucket", F.shuffle(spread, F.lit(seed)).alias("records")).join(
        starts, ["shard", "bucket"])
    placed = shuffled.select("shard", "start", F.posexplode("records").alias("at", "record"))
    placed.select(
        F.col("record.id").alias("id"), F.col("record.text").alias("text"), F.col("record.size").alias("size"),
        (F.col("start") + F.col("at")).cast("long").alias("slot"),
        shard_of(F.col("record.id"), shards + 1, seed).alias("grown_shard"), "shard",
    ).write.partitionBy("shard").parquet(path)


def read_shards(spark, path: str, id_type: str = "long") -> DataFrame:
    """All records that write_shards wrote, with their shard. id_type is the type of their ids."""
    return spark.read.schema(f"id {id_type}, text string, size long, slot long, grown_shard int, shard int").parquet(path)


def sharded(docs: DataFrame, **options) -> DataFrame:
    """Write the shards to a new shared folder and read them back."""
    path = shared_folder(docs.sparkSession, "shards")
    write_shards(docs, path, **options)
    return read_shards(docs.sparkSession, path, docs.schema[options.get("id_col", "doc_id")].dataType.simpleString())
