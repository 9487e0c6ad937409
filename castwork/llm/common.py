"""Helpers shared by the training-data operators: the shared folder, written tables, hashing, word splitting."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes a shuffle partition or a bucket of the packed exchange is sized for.
BUCKET_TEXT_BYTES = 4 << 20


def ship(spark: SparkSession) -> None:
    """Make this package importable on the executors (once for each application)."""
    sc = spark.sparkContext
    if getattr(sc, "_castwork_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="castwork-"), "castwork_pkg.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    sc._castwork_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a fresh local one is set only where none is named (tests)."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        option = sc._jsc.sc().getCheckpointDir()
        found = option.get() if option.isDefined() else None
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="castwork-shared-"))
        found = sc._jsc.sc().getCheckpointDir().get()
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write the frame as Parquet into the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/castwork-{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of text in the table, one small aggregate."""
    return int(docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0)


def bucket_count(n_bytes: int, least: int = 128) -> int:
    """Buckets of the packed exchange: in proportion to the text, so that a bucket has a bounded size."""
    return max(least, -(-n_bytes // BUCKET_TEXT_BYTES))


def slices(b: pa.RecordBatch, size: int, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of about `size` bytes of text, at least a row each."""
    held = np.cumsum(np.nan_to_num(pc.binary_length(b.column(text)).to_numpy(zero_copy_only=False)))
    at = 0
    while at < b.num_rows:
        to = max(at + 1, int(np.searchsorted(held, (held[at - 1] if at else 0) + size, "right")))
        yield b.slice(at, to - at)
        at = to


def trim() -> None:
    """Give freed memory back to the system at the end of a task: workers outlive tasks, and what one operator has
    used must not count against the next."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not every C library has it
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (xor-shift and multiply rounds), as a new array."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Rolling:
    """Hashes of all substrings of a fixed length in O(1) each, from prefix sums modulo 2**64.

    h(i, L) = sum of T[b(i + t)] * B**-t over t < L, where T maps symbols to random odd-looking words.
    Symbols over 255 (code points) are first folded by a multiplicative mix.
    """

    _tables: dict[int, tuple] = {}

    def __init__(self, seed: int):
        if seed not in self._tables:
            rng = np.random.Generator(np.random.PCG64(seed))
            table = rng.integers(0, 2**64, 256, dtype=np.uint64)
            base = int(rng.integers(0, 2**63)) * 4 + 5 & (2**64 - 1)
            self._tables[seed] = (table, base, pow(base, -1, 2**64), {})
        self.table, self.base, self.inverse, self.powers = self._tables[seed]

    def _power(self, base: int, n: int) -> np.ndarray:
        had = self.powers.get(base)
        if had is None or len(had) < n:
            size = 1 << max(16, (n - 1).bit_length())
            had = np.full(size, np.uint64(base), np.uint64)
            had[0] = 1
            had = np.cumprod(had, dtype=np.uint64)
            if size <= 1 << 23:  # very long texts do not stay in the worker
                self.powers[base] = had
        return had[:n]

    def prefix(self, symbols: np.ndarray) -> np.ndarray:
        out = np.zeros(len(symbols) + 1, np.uint64)
        words = self.table[symbols] if symbols.dtype == np.uint8 else mix(symbols.astype(np.uint64) + self.table[0])
        words *= self._power(self.inverse, len(symbols) + 1)[: len(symbols)]
        np.cumsum(words, out=out[1:])
        return out

    def at(self, prefix: np.ndarray, start: np.ndarray, end) -> np.ndarray:
        """Mixed hashes of [start, end) for arrays of positions (end: an array or start plus a constant)."""
        h = prefix[end]
        h -= prefix[start]
        h *= self._power(self.base, len(prefix) + 1)[start]
        return mix(h)
