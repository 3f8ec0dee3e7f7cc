"""Token ids in training order: a keyed permutation of all sequences, written as fixed-stride binary shards.

1. Texts become token ids (16 bits each, little endian); each text is cut into sequences of ``length``
   ids, the last one filled up with the padding id. The sequences are staged.
2. A staged file's rows are numbered by Spark (``_metadata.row_index``); with the sizes of the files
   before it every sequence has an index from 0 to N - 1, without a shuffle and however often a
   text or an id repeats.
3. A keyed Feistel permutation sends the index to a slot. It permutes the smallest power of four that
   is at least N; a value beyond N - 1 walks on along its cycle until it is inside.
4. Shard ``k`` holds the slots from ``k * shard_sequences`` on, in order. A record is the sequence and
   a line feed, so record ``s`` of a shard starts at byte ``s * stride``: a reader that stops at a slot goes on
   there, and any slot is one seek away. The shards are written in a few passes, each of which shuffles
   only its own records.

Cases with a defined result: null and empty texts, and texts without tokens, have no sequence; repeated
rows have sequences of their own; null ids are ordinary; an empty table gives no rows and no files;
other columns are not read. The order depends on the key and on how the staged files are cut, so it
is fixed once written.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

from clientele.llm.bpe import encoder, read_vocabulary
from clientele.llm.inputs import pieces, texts
from clientele.session import new_path, shuffles_dropped

LENGTH = 512
#: 8 MB with the stride below, which a task holds when it reads a shard.
SHARD_SEQUENCES = 8192
PARTITIONS = 100_000
#: So many parts of the shards are shuffled and written one after the other; a part's shuffle files go before the next begins.
PASSES = 3
ROUNDS = 6
KEY = 0x5EED0F7A1D3C
END = b"\n"


def stride(length: int) -> int:
    """Bytes of a record."""
    return 2 * length + len(END)


def tokenise(df: DataFrame, vocabulary: str, length: int = LENGTH, padding: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, part, n_tokens, ids``: the sequences of every text, ids as 16-bit numbers."""
    docs = texts(df, id_col, text_col)
    shared = df.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    fields = [docs.schema["doc_id"], StructField("part", IntegerType()), StructField("n_tokens", IntegerType()), StructField("ids", BinaryType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(shared.value)
        for batch in pieces(batches, 2 << 20):
            ids, counts = own.packed_all([text or "" for text in batch.column("text").to_pylist()])
            sequences = -(-counts // length)
            first = np.cumsum(sequences) - sequences
            rows = np.repeat(np.arange(len(counts)), sequences)
            part = np.arange(len(rows)) - first[rows]
            records = np.full(len(rows) * length, padding, "<u2")
            records[np.arange(len(ids)) + np.repeat(first * length - (np.cumsum(counts) - counts), counts)] = ids
            borders = np.arange(len(rows) + 1, dtype=np.int32) * (2 * length)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id").take(pa.array(rows)), "part": pa.array(part, pa.int32()),
                "n_tokens": pa.array(np.minimum(counts[rows] - part * length, length), pa.int32()),
                "ids": pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(borders), pa.py_buffer(records)]),
            })
        # the worker waits while other stages run
        pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, StructType(fields))


def feistel(index: np.ndarray, total: int, key: int = KEY) -> np.ndarray:
    """The slots of indexes below ``total``: a permutation of 0 to ``total - 1`` that the key decides."""
    half = np.uint64(max(1, (max(total - 1, 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)

    def permuted(x: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & mask
        for r in range(ROUNDS):
            mixed = (right + np.uint64((key * (2 * r + 1) + r) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            left, right = right, left ^ ((mixed ^ (mixed >> np.uint64(32))) & mask)
        return left << half | right

    slots = permuted(index.astype(np.uint64))
    while (outside := slots >= np.uint64(total)).any():
        slots[outside] = permuted(slots[outside])
    return slots.astype(np.int64)


def numbered(sequences: DataFrame) -> tuple[DataFrame, int]:
    """Staged ``sequences`` with ``index`` from 0 to N - 1, and N."""
    rows = sequences.withColumn("file", F.col("_metadata.file_name")).withColumn("row", F.col("_metadata.row_index"))
    sizes = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    # a name and a number per file, and a file per task that wrote sequences: under 100 MB for a million tasks
    counted = sorted((r.file, r.n) for r in sizes.collect())
    starts = np.cumsum([0, *(n for _, n in counted)])
    total = int(starts[-1])
    # from an Arrow table no Python worker is needed for it
    offsets = sequences.sparkSession.createDataFrame(pa.table({"file": pa.array([f for f, _ in counted], pa.string()), "start": pa.array(starts[:-1], pa.int64())}))
    return rows.join(F.broadcast(offsets), "file").withColumn("index", F.col("start") + F.col("row")).drop("file", "row", "start"), total


def placed(df: DataFrame, vocabulary: str, length: int = LENGTH, shard_sequences: int = SHARD_SEQUENCES, key: int = KEY, **options) -> DataFrame:
    """``shard, place, slot, doc_id, part, n_tokens, ids`` of every sequence; staged, so it can be read again."""
    sequences, path = tokenise(df, vocabulary, length, **options), new_path(df.sparkSession, "sequences")
    sequences.write.option("compression", "zstd").parquet(path)
    rows, total = numbered(df.sparkSession.read.schema(sequences.schema).parquet(path))

    # only the index goes to Python; the ids stay where they are
    @F.pandas_udf("long")
    def slots(index: pd.Series) -> pd.Series:
        return pd.Series(feistel(index.to_numpy(), total, key))

    # else a filter on the shard would compute the slot once more, in more workers
    found = rows.withColumn("slot", slots.asNondeterministic()("index")).drop("index")
    shard = F.expr(f"cast(slot div {shard_sequences}L as int)")
    found = found.withColumn("shard", shard).withColumn("place", F.col("slot") % shard_sequences)
    return found.select("shard", "place", "slot", "doc_id", "part", "n_tokens", "ids")


def in_order(df: DataFrame, vocabulary: str, length: int = LENGTH, shard_sequences: int = SHARD_SEQUENCES, key: int = KEY, **options) -> DataFrame:
    """``placed``, range-partitioned by shard and sorted by slot."""
    return by_shard(placed(df, vocabulary, length, shard_sequences, key, **options))


def shard_count(rows: DataFrame) -> int:
    """How many shards the rows of ``placed`` fill; one if there are no rows."""
    return (rows.agg(F.max("shard")).first()[0] or 0) + 1


def by_shard(rows: DataFrame, first: int = 0, last: int | None = None) -> DataFrame:
    """Rows with ``shard`` and ``slot`` in range partitions of whole shards, sorted; shards have equal sizes, so the ranges are known without a sample.

    Only the shards from ``first`` up to ``last``, excluded, if ``last`` is given.
    """
    if last is None:
        last = shard_count(rows)
    shards = last - first
    partitions = min(shards, PARTITIONS)
    part = F.expr(f"cast((shard - {first}) * {partitions}L div {shards}L as int)")
    wanted = rows.filter(F.col("shard").between(first, last - 1))
    return wanted.repartitionById(partitions, part).sortWithinPartitions("shard", "slot")


def write_shards(ordered: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write the records of ``in_order``: one folder ``shard=k`` per shard with one binary file.

    A record leaves a task as raw bytes and the writer's line end; the writer commits whole files, so
    a lost executor leaves none half written.
    """
    records = ordered.select("shard", F.col("ids").cast("string").alias("value"))
    records.write.mode(mode).partitionBy("shard").option("lineSep", END.decode()).text(path)


def written_records(spark: SparkSession, path: str, length: int = LENGTH, shard_sequences: int = SHARD_SEQUENCES) -> DataFrame:
    """``slot, shard, byte_offset, ids_crc32`` of every record in the files of ``path``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    if "shard" not in files.columns:  # nothing was written
        return spark.createDataFrame([], "slot long, shard int, byte_offset long, ids_crc32 long")
    size = stride(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column("shard").to_pylist(), batch.column("content")):
                data = content.as_buffer()
                if data.size % size:
                    raise ValueError(f"shard {shard} is not a whole number of records")
                at = np.arange(data.size // size, dtype=np.int64)
                view = memoryview(data)
                sums = [zlib.crc32(view[k : k + 2 * length]) for k in (at * size).tolist()]
                yield pa.RecordBatch.from_pydict({
                    "slot": pa.array(at + shard * shard_sequences), "shard": pa.array(np.full(len(at), shard, np.int32)),
                    "byte_offset": pa.array(at * size), "ids_crc32": pa.array(sums, pa.int64()),
                })

    return files.select("shard", "content").mapInArrow(run, "slot long, shard int, byte_offset long, ids_crc32 long")


def written(df: DataFrame, vocabulary: str, path: str, length: int = LENGTH, shard_sequences: int = SHARD_SEQUENCES, key: int = KEY, **options) -> DataFrame:
    """Write the shards to ``path``; per sequence ``doc_id, part, n_tokens`` and what its record in the files says.

    The shards are written in ``PASSES`` parts, so the disk never holds the shuffle of all records. A
    sequence without a record would have nulls.
    """
    rows = placed(df, vocabulary, length, shard_sequences, key, **options)
    shards = shard_count(rows)
    passes = min(PASSES, shards)
    for k in range(passes):
        with shuffles_dropped(df.sparkSession):
            write_shards(by_shard(rows, shards * k // passes, shards * (k + 1) // passes), path, "append" if k else "errorifexists")
    return rows.select("slot", "doc_id", "part", "n_tokens").join(written_records(df.sparkSession, path, length, shard_sequences), "slot", "left")


def read_slots(spark: SparkSession, path: str, first: int, last: int, length: int = LENGTH, shard_sequences: int = SHARD_SEQUENCES) -> DataFrame:
    """``slot, ids`` (numbers) for the slots from ``first`` up to ``last``, excluded: only their shards are read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    wanted = files.filter(F.col("shard").between(first // shard_sequences, (last - 1) // shard_sequences))
    size = stride(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column("shard").to_pylist(), batch.column("content")):
                data, begin = content.as_buffer(), shard * shard_sequences
                if data.size % size:
                    raise ValueError(f"shard {shard} is not a whole number of records")
                for slot in range(max(first, begin), min(last, begin + data.size // size)):
                    at = (slot - begin) * size
                    ids = np.frombuffer(data, "<u2", length, at).tolist()
                    yield pa.RecordBatch.from_pydict({"slot": pa.array([slot], pa.int64()), "ids": pa.array([ids], pa.list_(pa.int32()))})

    return wanted.select("shard", "content").mapInArrow(run, "slot long, ids array<int>")
