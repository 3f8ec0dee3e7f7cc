"""Sharding by a two-pass external shuffle (DataFrame functions only).

Pass one scatters the records, texts included, by a seeded hash over buckets of a bounded expected size.
Pass two numbers each bucket's records in the order of their hashes, gives number k the k-th place of a
Fisher-Yates shuffle of the bucket's places (Spark's ``shuffle`` with a seed) and writes the records with
their shard and slot. Only a bucket's places are in memory at once; its texts pass in a stream. The
buckets, one behind the other, are the global order. Shard ``s`` of ``S`` takes the ranks from ``s * N / S``
on, so row counts differ by at most one and a shard is a run of whole buckets but for its ends. Sizes and
checksums are read from the written records.

A row's key is its id and a 128-bit hash of its text. Rows that repeat a key are numbered, and each is
scattered by key and number, so the places do not depend on how the input is cut. Repeated rows travel
once, with their count, and are unfolded in chunks in many tasks.

Cases with a defined result: null ids and null texts are ordinary values (a null text has no bytes
and checksum 0); repeated rows each have a slot of their own and are scattered over the buckets; very long texts are records like others
(a bucket may outgrow its expected size by one); no rows give no rows; other columns are not touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clientele.llm.inputs import texts, whole
from clientele.session import stage

BUCKET_ROWS = 16384
BUCKET_BYTES = 32 << 20
OVERHEAD = 16
#: Copies of one row that a task unfolds at once.
CHUNK = 4096
#: Buckets share tasks beyond this many.
MAX_TASKS = 20_000
#: Keys of repeated rows are sent to every executor up to this many (about 64 MB).
BROADCAST_ROWS = 1_000_000
KEY = ["doc_id", "d1", "d2"]


def _size() -> Column:
    return (F.octet_length(whole(F.col("text"))) + OVERHEAD).cast("long")


def _same(keys: DataFrame) -> Column:
    return F.col("doc_id").eqNullSafe(keys.k_id) & (F.col("d1") == keys.k1) & (F.col("d2") == keys.k2)


def _unfolded(counted: DataFrame) -> DataFrame:
    """One row for each of the ``n`` copies, with its number ``copy`` from 1 on; ``n`` is dropped."""
    chunks = counted.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.expr(f"(n - 1) div {CHUNK}"))))
    chunks = chunks.repartition(*KEY, "chunk")
    last = F.least(F.col("n"), (F.col("chunk") + 1) * CHUNK)
    return chunks.withColumn("copy", F.explode(F.sequence(F.col("chunk") * CHUNK + 1, last))).drop("chunk", "n")


def _scattered(rows: DataFrame, seed: int, buckets: int) -> DataFrame:
    hashed = rows.withColumn("h", F.xxhash64(F.lit(seed), *KEY, "copy"))
    return hashed.withColumn("bucket", F.pmod("h", F.lit(buckets)))


def placed_records(df: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", seed: int = 20240229, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The records in their shuffled buckets, as written: ``doc_id, text, shard, slot``."""
    keyed = texts(df, id_col, text_col).withColumn("d1", F.xxhash64("text")).withColumn("d2", F.xxhash64(F.lit(seed + 1), "text"))
    copies = stage(keyed.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.max(_size()).alias("size")), "copies")
    whole_table = copies.agg(F.sum("n"), F.sum(F.col("n") * F.col("size")), F.count_if(F.col("n") > 1)).first()
    total, size, n_repeated = (x or 0 for x in whole_table)
    buckets = max(1, -(-total // bucket_rows), -(-size // BUCKET_BYTES))
    tasks = min(buckets, MAX_TASKS)

    singles, repeated = copies.filter("n = 1").select(*KEY, F.lit(1).cast("long").alias("copy")), copies.filter("n > 1").select(*KEY, "n")
    records = keyed.withColumn("copy", F.lit(1).cast("long"))
    numbered = singles
    if n_repeated:
        numbered = singles.unionByName(_unfolded(repeated))
        keys = repeated.select(F.col("doc_id").alias("k_id"), F.col("d1").alias("k1"), F.col("d2").alias("k2"), "n")
        keys = F.broadcast(keys) if n_repeated <= BROADCAST_ROWS else keys
        once = keyed.join(keys.drop("n"), _same(keys), "left_semi").groupBy(*KEY).agg(F.any_value("text").alias("text"))
        counted = once.join(keys, _same(keys)).select(*KEY, "text", "n")
        records = records.join(keys.drop("n"), _same(keys), "left_anti").unionByName(_unfolded(counted))

    # pass two's orders first: they need only the number of records in each bucket
    sizes = _scattered(numbered, seed, buckets).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")))
    # the order of buckets inside a task is fixed, so a task that runs again shuffles alike
    fixed = starts.repartition(tasks, "bucket").sortWithinPartitions("bucket")
    orders = stage(fixed.select("bucket", "start", F.shuffle(F.sequence(F.lit(0), (F.col("n") - 1).cast("int")), seed).alias("places")), "bucket_orders")

    gathered = _scattered(records, seed, buckets).repartition(tasks, "bucket")
    numbers = F.row_number().over(Window.partitionBy("bucket").orderBy("h", *KEY, "copy"))
    ranked = gathered.withColumn("number", numbers).join(orders, "bucket").withColumn("rank", F.col("start") + F.element_at("places", F.col("number")))
    return stage(_slots(ranked, shards, total), "shuffled_buckets")


def shard_rows(df: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", seed: int = 20240229, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Every row's ``doc_id, size, text_crc32, shard, slot`` under the law that row counts are equal, read from the written records."""
    written = placed_records(df, shards, id_col, text_col, seed, bucket_rows)
    return written.select("doc_id", _size().alias("size"), F.crc32(whole(F.col("text")).cast("binary")).alias("text_crc32"), "shard", "slot")


def _slots(ranked: DataFrame, shards: int, total: int) -> DataFrame:
    """Shard ``s`` holds the ranks r with ``s = r * shards div total``, numbered from 0."""
    n = max(total, 1)
    shard = F.expr(f"cast((rank * {shards}L) div {n}L as int)")
    first = F.expr(f"(shard * {n}L + {shards - 1}L) div {shards}L")
    return ranked.withColumn("shard", shard).withColumn("slot", F.col("rank") - first).select("doc_id", "text", "shard", "slot")


def write_shards(df: DataFrame, path: str, shards: int, id_col: str = "doc_id", text_col: str = "text", **options) -> None:
    """Write ``doc_id, slot, text`` to one folder per shard, each file sorted by slot; texts do not move again."""
    written = placed_records(df, shards, id_col, text_col, **options)
    written.select("shard", "slot", "doc_id", "text").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
