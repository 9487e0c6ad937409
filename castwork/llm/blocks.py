"""Packed blocks of documents and the packed exchange between blocks and buckets.

Documents are packed into blocks of about ``BLOCK_BYTES`` of text, written once as a table bucketed by block, so
that later passes join small per-block answers to the texts without shuffling the texts again. A pass emits for
each (block, bucket) one row with the block's distinct keys of that bucket, sorted and delta coded; a bucket's
task sees every distinct key once per block at most (copies inside a block are pre-aggregated), and answers with
one row for each (block, bucket) in the same order. No key, however common, sends more than one entry per block.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_count, shared_dir, ship, text_bytes, trim, written

BLOCK_BYTES = 2 << 20

#: Buckets (sized for 4 MB of text each) whose answers one task writes.
BUCKETS_A_FILE = 4

BLOCK_SCHEMA = "block bigint, n int, lens binary, data binary, rest binary"
PAYLOAD_SCHEMA = "bucket int, block bigint, n int, payload binary"
ANSWER_SCHEMA = "block bigint, bucket int, answer binary"


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays as byte planes, compressed: sorted keys become deltas in `deltas`, whose high planes vanish."""
    c = zstandard.ZstdCompressor(level=1)
    parts = []
    for a in arrays:
        planes = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes() if len(a) else b""
        z = c.compress(planes)
        parts += [len(z).to_bytes(8, "little"), z]
    return b"".join(parts)


def unsqueeze(data: bytes, *dtypes) -> list[np.ndarray]:
    d, out, at = zstandard.ZstdDecompressor(), [], 0
    for t in dtypes:
        n = int.from_bytes(data[at : at + 8], "little")
        raw = np.frombuffer(d.decompress(data[at + 8 : at + 8 + n]), np.uint8)
        at += 8 + n
        width = np.dtype(t).itemsize
        out.append(np.ascontiguousarray(raw.reshape(width, -1).T).view(t).ravel() if len(raw) else np.empty(0, t))
    return out


def deltas(keys: np.ndarray) -> np.ndarray:
    return np.diff(keys, prepend=np.uint64(0)) if len(keys) else keys


def undeltas(d: np.ndarray) -> np.ndarray:
    return np.cumsum(d, dtype=np.uint64)


def bounds(keys: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, first index) of the runs of sorted 64-bit keys; a bucket is a range of the key space."""
    bucket = ((keys >> np.uint64(32)) * np.uint64(n_buckets)) >> np.uint64(32)
    first = np.flatnonzero(np.diff(bucket, prepend=np.uint64(2**63))) if len(keys) else np.empty(0, np.int64)
    return bucket[first].astype(np.int64), first


def pack(docs: DataFrame, text: str = "text") -> tuple[DataFrame, int]:
    """Write `docs` as a table of blocks bucketed by block; returns it and the buckets of later exchanges.

    Null texts have length -1. All other columns travel in `rest` (Arrow IPC), whatever their names.
    """
    spark = docs.sparkSession
    ship(spark)
    n_buckets = bucket_count(text_bytes(docs, text))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        held, size = [], 0

        def flush():
            nonlocal held, size, seq
            t = pa.Table.from_batches(held).combine_chunks()
            col = t.column(text)
            values = [None if v is None else v.encode() for v in col.to_pylist()]
            lens = np.array([-1 if v is None else len(v) for v in values], np.int64)
            sink = pa.BufferOutputStream()
            rest = t.drop_columns([text])
            with pa.ipc.new_stream(sink, rest.schema) as w:
                w.write_table(rest)
            z = zstandard.ZstdCompressor(level=3)
            out = pa.record_batch(
                [pa.array([part << 32 | seq], pa.int64()), pa.array([len(lens)], pa.int32()), pa.array([lens.tobytes()], pa.binary()),
                 pa.array([z.compress(b"".join(v for v in values if v))], pa.binary()),
                 pa.array([z.compress(sink.getvalue().to_pybytes())], pa.binary())],
                names=["block", "n", "lens", "data", "rest"],
            )
            held, size, seq = [], 0, seq + 1
            return out

        import pyarrow.compute as pc

        for b in batches:
            if not b.num_rows:
                continue
            ends = np.cumsum(np.nan_to_num(pc.binary_length(b.column(text)).to_numpy(zero_copy_only=False)))
            at = 0
            while at < b.num_rows:
                room = BLOCK_BYTES - size + (ends[at - 1] if at else 0)
                to = min(b.num_rows, max(at + 1, int(np.searchsorted(ends, room, "right"))))
                held.append(b.slice(at, to - at))
                size += int(ends[to - 1] - (ends[at - 1] if at else 0))
                at = to
                if size >= BLOCK_BYTES or at < b.num_rows:
                    yield flush()
        if held:
            yield flush()

    name = f"castwork_blocks_{uuid.uuid4().hex}"
    blocks = docs.mapInArrow(build, BLOCK_SCHEMA)
    # No fewer buckets than shuffle partitions: a join would else shuffle the texts to have more.
    table_buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_buckets // 4)
    (blocks.write.bucketBy(table_buckets, "block").format("parquet").option("compression", "uncompressed")
     .option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name))
    return spark.table(name), n_buckets


class Block:
    """A block's texts as one byte array with document bounds."""

    def __init__(self, row: dict):
        self.id = row["block"]
        self.lens = np.frombuffer(row["lens"], np.int64)
        self.data = zstandard.ZstdDecompressor().decompress(row["data"]) if row["data"] else b""
        self.sizes = np.maximum(self.lens, 0)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self._rest = row["rest"]

    @property
    def rest(self) -> pa.Table:
        return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(self._rest)).read_all()

    def texts(self) -> list[str | None]:
        return [None if n < 0 else self.data[s:e].decode() for n, s, e in zip(self.lens.tolist(), self.starts.tolist(), self.ends.tolist(), strict=True)]


def with_answers(blocks: DataFrame, **answers: DataFrame) -> DataFrame:
    """The blocks with, for each named answer, its rows as a list in bucket order (blocks are not shuffled)."""
    for name, a in answers.items():
        own = a.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("bucket", "answer"))).alias(name))
        blocks = blocks.join(own, "block", "left")
    return blocks


def written_answers(answers: DataFrame, n_buckets: int, name: str) -> DataFrame:
    """The answers written by a task for each BUCKETS_A_FILE buckets at most, however many the shuffle partitions:
    answers are small, and where Hadoop has no native library each file starts processes beside the executor."""
    return written(answers.coalesce(-(-n_buckets // BUCKETS_A_FILE)), name)


def answers_of(row: dict, name: str) -> list[bytes]:
    return [x["answer"] for x in row[name] or []]


def per_block(frame: DataFrame, fn: Callable[[Block, dict], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """Run `fn` on every block row, one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                yield from fn(Block(row), row)
        trim()

    return frame.mapInArrow(run, schema)


def payload_rows(block: int, rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    b, n, p = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.record_batch(
        [pa.array(b, pa.int32()), pa.array([block] * len(b), pa.int64()), pa.array(n, pa.int32()), pa.array(p, pa.binary())],
        names=["bucket", "block", "n", "payload"],
    )


def key_rows(block: int, n_buckets: int, keys: np.ndarray, *more: np.ndarray) -> pa.RecordBatch:
    """One payload for each bucket that has some of the block's sorted keys, with what goes along with each key."""
    bucket, first = bounds(keys, n_buckets)
    ends = np.append(first, len(keys))[1:]
    return payload_rows(block, [(k, e - s, squeeze(deltas(keys[s:e]), *(m[s:e] for m in more))) for k, s, e in zip(bucket.tolist(), first.tolist(), ends.tolist(), strict=True)])


def per_bucket(payloads: DataFrame, fn: Callable[[int, list[int], list[bytes]], list[bytes]]) -> DataFrame:
    """For each bucket, `fn(bucket, blocks, payloads)` gives one answer for each payload, in order."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("block")
        blocks, bucket = t.column("block").to_pylist(), t.column("bucket")[0].as_py()
        out = fn(bucket, blocks, t.column("payload").to_pylist())
        return pa.table({"block": pa.array(blocks, pa.int64()), "bucket": pa.array([bucket] * len(blocks), pa.int32()), "answer": pa.array(out, pa.binary())})

    return payloads.groupBy("bucket").applyInArrow(run, ANSWER_SCHEMA)
