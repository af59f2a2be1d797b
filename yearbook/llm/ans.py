"""Token-ID files coded by a static range asymmetric numeral system.

One table of frequencies, counted over the whole corpus, serves all blocks. A
block holds whole documents and is coded by itself: its ids are dealt out to
LANES interleaved coders, row by row, each with a state of its own, and what
the coders put out shares one stream of 32-bit words. A block's row keeps the
final states (where a decoder starts), a checkpoint of states and stream place
every CHECKPOINT rows (where others start, side by side), its documents' lengths, and
the crc32 of its ids. Blocks are rows of Parquet files, one file a range of
ascending ids, so any reader of the store can open them and decode in parallel.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .exchange import U64, shared_dir, shuffle_partitions, written
from .textbytes import parts
from .tokens import encoder, tokenizer

LANES, CHECKPOINT = 1024, 64
#: Segments of a block that are decoded side by side.
SIDE = 16
#: Ids of a block, at least (but for a file's last); a longer document is a block by itself.
BLOCK_IDS = 1 << 18
LOW, WORD, MASK = U64(1 << 31), U64(32), U64(0xFFFFFFFF)
BLOCKS = "file int, block int, first long, n long, crc32 long, doc_ids array<long>, lengths array<long>, states binary, checkpoints binary, stream binary"


class Table:
    """Frequencies that sum to 2**bits; every id that occurs has at least 1."""

    def __init__(self, counts: np.ndarray):
        seen = np.flatnonzero(counts)
        self.bits = max(16, int(np.ceil(np.log2(max(2, len(seen))))) + 4)
        size = 1 << self.bits
        self.freq = np.zeros(max(1, len(counts)), np.int64)
        if len(seen):
            share = counts[seen] / counts[seen].sum() * size
            f = np.maximum(1, np.floor(share)).astype(np.int64)
            spare = size - int(f.sum())
            while spare:  # to or from the most frequent first, never below 1
                order = np.argsort(-f, kind="stable")[: abs(spare)]
                if spare < 0:
                    order = order[f[order] > 1]
                f[order] += np.sign(spare)
                spare = size - int(f.sum())
            self.freq[seen] = f
        self.cum = np.cumsum(self.freq) - self.freq
        self.f, self.c = self.freq.astype(U64), self.cum.astype(U64)
        self.ids = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq)
        self.most = (self.f << U64(63 - self.bits))

    def encode(self, ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
        """States, checkpoints and stream of one block."""
        rows = -(-len(ids) // LANES)
        x = np.full(LANES, LOW, U64)
        out, marks, shift = [], [], U64(self.bits)
        for r in range(rows - 1, -1, -1):
            row = ids[r * LANES : (r + 1) * LANES]
            y = x[: len(row)]
            f = self.f[row]
            big = y >= self.most[row]
            out.append((y[big] & MASK).astype(np.uint32))
            y[big] >>= WORD
            q = y // f
            y[:] = (q << shift) + (y - q * f) + self.c[row]
            if r and r % CHECKPOINT == 0:
                marks.append((r, sum(map(len, out)), x.copy()))
        stream = np.concatenate(out[::-1]) if out else np.empty(0, np.uint32)
        # a place is counted from the front, as the decoder reads
        points = b"".join(np.array([r, len(stream) - n], U64).tobytes() + s.tobytes() for r, n, s in reversed(marks))
        return x.tobytes(), points, stream.astype("<u4").tobytes()

    def decode(self, n: int, states: bytes, stream: bytes, row: int = 0, place: int = 0) -> np.ndarray:
        """The ids from a row on; states are those at that row, place the stream's."""
        x = np.frombuffer(states, U64).copy()
        words = np.frombuffer(stream, "<u4").astype(U64)
        out = np.empty(n, np.uint32)
        slot, shift = U64((1 << self.bits) - 1), U64(self.bits)
        for at in range(row * LANES, n, LANES):
            y = x[: min(LANES, n - at)]
            low = y & slot
            ids = self.ids[low]
            out[at : at + len(ids)] = ids
            y[:] = self.f[ids] * (y >> shift) + low - self.c[ids]
            few = np.flatnonzero(y < LOW)
            y[few] = (y[few] << WORD) | words[place : place + len(few)]
            place += len(few)
        return out[row * LANES :]

    def decode_block(self, n: int, states: bytes, points: bytes, stream: bytes) -> np.ndarray:
        """The ids of a whole block: from its checkpoints on, SIDE segments of it are decoded side by side."""
        step = 16 + 8 * LANES
        marks = [(0, 0, states)] + [(*np.frombuffer(points, "<u8", 2, i).tolist(), points[i + 16 : i + step]) for i in range(0, len(points), step)]
        rows = -(-n // LANES)
        out = np.empty((rows, LANES), np.uint32)
        if not rows:
            return out.ravel()
        words = np.frombuffer(stream, "<u4").astype(U64)
        slot, shift = U64((1 << self.bits) - 1), U64(self.bits)
        for i in range(0, len(marks), SIDE):
            some = marks[i : i + SIDE]
            row, place = np.array([m[0] for m in some], np.int64), np.array([m[1] for m in some], np.int64)
            stop = np.array([*(m[0] for m in marks[i + 1 : i + SIDE + 1]), rows][: len(some)], np.int64)
            x = np.stack([np.frombuffer(m[2], U64) for m in some])
            while len(x):
                low = x & slot
                ids = self.ids[low]
                out[row] = ids
                x = self.f[ids] * (x >> shift) + low - self.c[ids]
                few = x < LOW
                if row[-1] == rows - 1:
                    few[-1, n - (rows - 1) * LANES :] = False  # the last row may not use all lanes
                at = np.cumsum(few, axis=1) + (place - 1)[:, None]
                x[few] = (x[few] << WORD) | words[at[few]]
                place, row = place + few.sum(axis=1), row + 1
                live = row < stop
                if not live.all():
                    x, row, place, stop = x[live], row[live], place[live], stop[live]
        return out.ravel()[:n]


def id_type(path: str) -> str:
    """How ids travel between stages: in two bytes where the vocabulary allows it."""
    return "<u2" if tokenizer(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"


def counted(tokens: DataFrame, kind: str) -> np.ndarray:
    """How often each id occurs, over all rows: as many numbers as the vocabulary has."""

    def count(batches):
        total = np.zeros(0, np.int64)
        for b in batches:
            for data in b.column(0).to_pylist():
                c = np.bincount(np.frombuffer(data, kind))
                if len(c) > len(total):
                    c[: len(total)] += total
                    total = c
                else:
                    total[: len(c)] += c
        seen = np.flatnonzero(total)
        yield pa.record_batch({"id": pa.array(seen, pa.int64()), "n": pa.array(total[seen], pa.int64())})

    rows = tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(max((r["id"] for r in rows), default=0) + 1, np.int64)
    for r in rows:
        out[r["id"]] = r["n"]
    return out


def tokenized(docs: DataFrame, path: str, end_id: int | None, id_col: str, text_col: str) -> DataFrame:
    """doc_id and ids (of id_type) of every whole text, the end id last."""
    kind = np.dtype(id_type(path))
    tail = b"" if end_id is None else int(end_id).to_bytes(kind.itemsize, "little")

    def encode(batches):
        for batch in batches:
            for rows, texts in parts(batch, 1):
                got, n = encoder(path).encode(texts)
                data, at = got.astype(kind).tobytes(), np.concatenate([[0], np.cumsum(n * kind.itemsize)]).tolist()
                yield pa.record_batch({"doc_id": rows.column(0), "ids": pa.array([data[a:b] + tail for a, b in zip(at, at[1:])], pa.binary())})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(encode, "doc_id long, ids binary")


def write_tokens(docs: DataFrame, path: str, path_of_tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the coded ids of all documents, in ascending doc_id order, to `path`.

    `path`/blocks has the blocks (see BLOCKS), `path`/table the counts. A null
    text is empty: its ids are the end id alone. A null doc_id comes first;
    rows with equal ids come in any order. Other columns are not kept; of an
    empty table only an empty file and table are written.
    """
    spark, kind = docs.sparkSession, id_type(path_of_tokenizer)
    tokens = written(tokenized(docs, path_of_tokenizer, end_id, id_col, text_col))
    counts = counted(tokens, kind)
    wide = np.dtype(kind).itemsize
    spark.createDataFrame([(json.dumps({int(i): int(counts[i]) for i in np.flatnonzero(counts)}),)], "counts string").coalesce(1).write.parquet(f"{path}/table")
    table = Table(counts)

    def encode(batches):
        held: list[tuple[int | None, bytes]] = []
        state = {"block": 0, "first": 0, "size": 0, "file": 0}

        def block():
            ids = np.frombuffer(b"".join(x for _, x in held), kind)
            states, points, stream = table.encode(ids)
            n = len(ids)
            row = {"file": [state["file"]], "block": [state["block"]], "first": [state["first"]], "n": [n], "crc32": [zlib.crc32(ids.astype("<u4").tobytes())], "doc_ids": [[d for d, _ in held]], "lengths": [[len(x) // wide for _, x in held]], "states": [states], "checkpoints": [points], "stream": [stream]}
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
            state.update(block=state["block"] + 1, first=state["first"] + n, size=0)
            held.clear()
            return pa.record_batch([pa.array(v, t) for v, t in zip(row.values(), types)], names=list(row))

        for batch in batches:
            for doc, ids, file in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                state["file"] = file
                held.append((doc, ids))
                state["size"] += len(ids) // wide
                if state["size"] >= BLOCK_IDS:
                    yield block()
        if held:
            yield block()

    ranged = tokens.repartitionByRange(max(8, shuffle_partitions(spark)), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    ranged.withColumn("file", F.spark_partition_id()).mapInArrow(encode, BLOCKS).write.parquet(f"{path}/blocks")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (binary), decoded from the files.

    Every block is checked against its crc32; a damaged one raises ValueError."""
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    counts = {int(k): v for k, v in json.loads(spark.read.parquet(f"{path}/table").first()["counts"]).items()}
    dense = np.zeros(max(counts, default=0) + 1, np.int64)
    dense[list(counts)] = list(counts.values())
    totals = {r["file"]: r["n"] for r in blocks.groupBy("file").agg(F.sum("n").alias("n")).collect()}  # as many rows as files
    base, before = {}, 0
    for file in sorted(totals):
        base[file], before = before, before + totals[file]
    tables: list[Table] = []  # built once in each worker's task

    def decode(batches):
        if not tables:
            tables.append(Table(dense))
        for b in batches:
            for r in range(b.num_rows):
                x = {k: b.column(k)[r].as_py() for k in b.schema.names}
                ids = tables[0].decode_block(x["n"], x["states"], x["checkpoints"], x["stream"]).astype("<u4").tobytes()
                if zlib.crc32(ids) != x["crc32"]:
                    raise ValueError(f"block {x['block']} of file {x['file']} is damaged")
                n = np.array(x["lengths"], np.int64)
                at = np.concatenate([[0], np.cumsum(n)])
                yield pa.record_batch({"doc_id": pa.array(x["doc_ids"], pa.int64()), "start": pa.array(base[x["file"]] + x["first"] + at[:-1], pa.int64()), "n_tokens": pa.array(n, pa.int64()), "ids": pa.array([ids[a * 4 : c * 4] for a, c in zip(at.tolist(), at[1:].tolist())], pa.binary())})

    return blocks.select("file", "block", "first", "n", "crc32", "doc_ids", "lengths", "states", "checkpoints", "stream").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")


def coded_tokens(docs: DataFrame, path_of_tokenizer: str, end_id: int = 2, path: str | None = None) -> DataFrame:
    """Write the files (to a new shared folder unless given) and read them back."""
    path = path or shared_dir(docs.sparkSession)
    write_tokens(docs, path, path_of_tokenizer, end_id)
    return read_tokens(docs.sparkSession, path)
