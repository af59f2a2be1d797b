"""Whole-corpus questions about hashes, asked in packed form.

Rows of a table are dealt into chunks of a bounded number of rows and bytes and
written, bucketed by chunk, to the shared folder. A round then has two halves:
every chunk sends each shard one binary cell with its (already distinct) hashes
of that range, and every shard answers each cell. A hot hash is thus one entry a
chunk, never a row an occurrence, and shards are even because hashes are. The
text itself is never shuffled: chunks are read back from their buckets.

Chunks and shards follow the bytes of text, not the session: see Sizes.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..sources.shared import shared_dir, written
from .memory import freed, freeing

U64 = np.uint64
CELLS = "chunk long, shard int, kind int, payload binary"
SCHEMA = pa.schema([("chunk", pa.int64()), ("shard", pa.int32()), ("kind", pa.int32()), ("payload", pa.binary())])
#: Rows of a chunk, at most.
CHUNK_ROWS = 4096
#: Bytes of text of a chunk, of a shard and of a bucket, for corpora of up to 1024 shards.
CHUNK_BYTES, SHARD_BYTES, BUCKET_BYTES = 4 << 20, 4 << 20, 128 << 20
#: The same for the largest corpora; and the tasks of a stage, which then take several shards or chunks, one by one.
MOST_CHUNK, MOST_SHARD, MOST_TASKS = 64 << 20, 256 << 20, 20_000


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shards_of(spark: SparkSession, total: int, each: int, most: int) -> tuple[int, int]:
    """Shards and tasks for so much: `each` to a shard up to 1024 shards, then more of it, up to `most`."""
    least = max(8, shuffle_partitions(spark))
    shards = max(least, -(-total // min(max(each, total // 1024), most)))
    return shards, min(shards, max(least, MOST_TASKS))


def by_shard(cells: DataFrame, tasks: int):
    """Rows grouped by shard: a task has one shard at a time, and several only in the largest corpora."""
    return cells.withColumn("task", F.col("shard") % tasks).repartitionById(tasks, F.col("task")).groupBy("task", "shard")


class Sizes:
    """How a corpus of so many bytes of text is dealt.

    A task holds one chunk or one shard at a time, so both are bounded. Their
    product is what a cell comes from: cells are chunks times shards, and to
    keep them from getting too small, chunks and shards grow with the corpus
    from 4 GB on, up to 64 and 256 MB."""

    def __init__(self, spark: SparkSession, total: int):
        least = max(8, shuffle_partitions(spark))
        self.chunk = min(max(CHUNK_BYTES, total // 4096), MOST_CHUNK)
        self.shards, self.tasks = shards_of(spark, total, SHARD_BYTES, MOST_SHARD)
        self.buckets = max(least, min(-(-total // BUCKET_BYTES), MOST_TASKS))


def text_bytes(df: DataFrame, column: str) -> int:
    return df.agg(F.sum(F.octet_length(column)) + F.count("*") * 16).first()[0] or 0


class Chunks:
    """A table dealt into chunks: the input's columns and `chunk`, bucketed by it.

    total: about how many bytes of text there are, if that is known."""

    def __init__(self, df: DataFrame, text_col: str = "text", total: int | None = None):
        spark = df.sparkSession
        sizes = Sizes(spark, text_bytes(df, text_col) if total is None else total)
        self.buckets, self.shards, self.tasks = sizes.buckets, sizes.shards, sizes.tasks
        text, most = df.columns.index(text_col), sizes.chunk

        def deal(batches):
            # a chunk ends where the next text would make it too large
            chunk, rows, size = TaskContext.get().partitionId() << 24, 0, 0
            for batch in batches:
                ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16)
                own, i = np.empty(len(ends), np.int64), 0
                while i < len(ends):
                    done = ends[i - 1] if i else 0
                    j = min(int(np.searchsorted(ends, done + most - size, "right")), i + CHUNK_ROWS - rows)
                    if j <= i and not rows:
                        j = i + 1
                    own[i:j] = chunk
                    if j > i:
                        rows, size, i = rows + j - i, size + int(ends[j - 1] - done), j
                    if i < len(ends):
                        chunk, rows, size = chunk + 1, 0, 0
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own)], names=[*batch.schema.names, "chunk"])

        name = f"yearbook_{uuid.uuid4().hex}"
        dealt = df.mapInArrow(freeing(deal), StructType([*df.schema.fields, StructField("chunk", LongType())]))
        (dealt.write.format("parquet").option("compression", "zstd").option("path", shared_dir(spark))
         .bucketBy(self.buckets, "chunk").sortBy("chunk").saveAsTable(name))
        self.table = spark.table(name)
        # the plan knows its files and buckets; the external files stay
        spark.sql(f"DROP TABLE {name}")

    def send(self, send: Callable, replies: DataFrame | None = None, columns: tuple[str, ...] = ()) -> DataFrame:
        """The cells of a round. send(table, replies, shards) gives (shard, kind,
        bytes) of a chunk. Of the table, it sees the columns named, or all."""
        shards = self.shards

        def cells(chunk: int, table: pa.Table, got) -> pa.Table:
            rows = list(send(table, got, shards))
            return pa.table([pa.array([chunk] * len(rows), pa.int64()), *(pa.array([r[k] for r in rows], f.type) for k, f in enumerate(list(SCHEMA)[1:]))], schema=SCHEMA)

        return self.apply(cells, CELLS, replies, columns)

    def by_shard(self, cells: DataFrame):
        return by_shard(cells, self.tasks)

    def ask(self, send: Callable, answer: Callable, replies: DataFrame | None = None, columns: tuple[str, ...] = ()) -> DataFrame:
        """One round: answer(list of (chunk, kind, bytes)) gives (chunk, kind, bytes)
        of a shard. The result has a row for each answer, written to the shared
        folder."""

        def shard(table: pa.Table) -> pa.Table:
            rows = list(answer(list(zip(table["chunk"].to_pylist(), table["kind"].to_pylist(), table["payload"].to_pylist()))))
            return replied(table["shard"][0].as_py(), rows)

        return written(self.by_shard(self.send(send, replies, columns)).applyInArrow(lambda t: freed(shard(t)), CELLS))

    def apply(self, f: Callable, schema: str, replies: DataFrame | None = None, columns: tuple[str, ...] = ()) -> DataFrame:
        """f(chunk, table, replies) for each chunk; replies: {kind: {shard: bytes}}."""
        table = self.table.select("chunk", *columns) if columns else self.table
        if replies is None:
            return table.groupBy("chunk").applyInArrow(lambda key, t: freed(f(key[0].as_py(), t, {})), schema)

        def both(key, t: pa.Table, r: pa.Table) -> pa.Table:
            got: dict[int, dict[int, bytes]] = {}
            for shard, kind, payload in zip(r["shard"].to_pylist(), r["kind"].to_pylist(), r["payload"].to_pylist()):
                got.setdefault(kind, {})[shard] = payload
            return f(key[0].as_py(), t, got)

        return table.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(lambda key, t, r: freed(both(key, t, r)), schema)


def replied(shard: int, rows: list[tuple[int, int, bytes]]) -> pa.Table:
    """A shard's answers: (chunk, kind, bytes)."""
    return pa.table([pa.array([r[0] for r in rows], pa.int64()), pa.array([shard] * len(rows), pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], schema=SCHEMA)


def cuts(ascending: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard's range begins in ascending 64-bit hashes, and the end.

    The two low bits, in which some hashes carry flags, never decide."""
    limits = np.array([(s << 64) // shards & ~3 for s in range(shards)], dtype=U64)
    return np.append(np.searchsorted(ascending, limits, "left"), len(ascending))


def ranges(ascending: np.ndarray, shards: int) -> Iterator[tuple[int, slice]]:
    """(shard, its slice) of ascending hashes, without empty ones."""
    at = cuts(ascending, shards)
    for s in range(shards):
        if at[s + 1] > at[s]:
            yield s, slice(int(at[s]), int(at[s + 1]))


def low_bytes(values: np.ndarray, n: int = 6) -> bytes:
    """The n low bytes of each 64-bit value."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8)[:, :n].tobytes()


def from_low_bytes(data: bytes, n: int = 6) -> np.ndarray:
    out = np.zeros((len(data) // n, 8), np.uint8)
    out[:, :n] = np.frombuffer(data, np.uint8).reshape(-1, n)
    return out.view(U64).ravel()


def bits(mask: np.ndarray) -> bytes:
    return np.packbits(mask).tobytes()


def from_bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def runs(ascending: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values."""
    if not len(ascending):
        return np.empty(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], ascending[1:] != ascending[:-1]]))
