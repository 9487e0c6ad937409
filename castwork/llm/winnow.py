"""Document fingerprints by winnowing.

Hashes of all k-grams of code points; in every window of `window` consecutive hashes the smallest is chosen, the
rightmost of equals; chosen hashes are kept with their positions. Any common substring of at least
window + k - 1 code points is then sure to share a chosen hash. Texts are taken as they are. A text of fewer than
k code points has one hash, of the whole (an empty or null text has none); one of fewer than `window` hashes is one
window. Likeness of two fingerprints is the Jaccard index of their sets of hashes (1 if both are empty).

The fingerprint string is `hash@position` in hexadecimal, 8 digits of hash, comma-joined in order of position.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructType

from .common import Rolling, bucket_count, ship, text_bytes

#: Passages of K + WINDOW - 1 = 27 code points or more are sure to be met.
K, WINDOW = 12, 16
AT_ONCE = 1 << 18


def select(text: str, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(chosen 32-bit hashes, their positions), in order of position."""
    if not text:
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    roll = Rolling(271)
    if len(c) <= k:
        h = roll.at(roll.prefix(c), np.array([0]), np.array([len(c)]))
        return (h >> np.uint64(32)).astype(np.uint32), np.zeros(1, np.int64)
    chosen = []
    n = len(c) - k + 1  # hashes in all
    for at in range(0, max(1, n - window + 1), AT_ONCE):  # windows that start in [at, at + AT_ONCE)
        m = min(n - at, AT_ONCE + window - 1)
        prefix = roll.prefix(c[at : at + m + k - 1])
        h = roll.at(prefix, np.arange(m), np.arange(k, m + k))
        # the smallest hash first, then the largest position: one comparison decides both
        key = (h & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - np.arange(m, dtype=np.uint64))
        w, have = min(window, m), 1
        while have < w:
            step = min(have, w - have)
            key = np.minimum(key[:-step], key[step:])
            have += step
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
        chosen.append(np.stack([key >> np.uint64(32), np.uint64(0xFFFFFFFF) - (key & np.uint64(0xFFFFFFFF)) + np.uint64(at)]))
    both = np.concatenate(chosen, axis=1)
    keep = np.concatenate([[True], both[1, 1:] != both[1, :-1]])
    return both[0, keep].astype(np.uint32), both[1, keep].astype(np.int64)


def as_string(hashes: np.ndarray, positions: np.ndarray) -> str:
    return ",".join(f"{h:08x}@{p:x}" for h, p in zip(hashes.tolist(), positions.tolist(), strict=True))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard index of two sorted arrays of distinct hashes."""
    if not len(a) and not len(b):
        return 1.0
    common = len(a) + len(b) - len(np.union1d(a, b))
    return common / (len(a) + len(b) - common)


def edited(text: str, following: str) -> str:
    """The last quarter (floor) replaced by the first as many code points, or all, of the following text."""
    q = len(text) // 4
    return text[: len(text) - q] + following[:q]


def fingerprints(docs: DataFrame, *, k: int = K, window: int = WINDOW) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next per row of `docs`.

    "Next" is by ascending doc_id (nulls first; equal ids by a hash of the text; the first after the last). Documents
    are dealt to ranges of doc_id, each with a copy of the row that follows its last, and read in order: every text
    is shuffled once and no task sees more than its ranges.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"))
    # Range bounds are quantiles of doc_id; their number follows the bytes of text.
    n_ranges = bucket_count(4 * text_bytes(docs), 64)
    cuts = docs.agg(F.percentile_approx("doc_id", [i / n_ranges for i in range(1, n_ranges)], F.lit(20 * n_ranges))).first()[0] or []
    splits = [float("-inf"), *sorted({float(c) for c in cuts}), float("inf")]
    rows = rows.withColumn("_d", F.col("doc_id").cast("double"))
    if len(splits) > 2:
        rows = Bucketizer(splits=splits, inputCol="_d", outputCol="_r", handleInvalid="keep").transform(rows)
    else:
        rows = rows.withColumn("_r", F.lit(0.0))
    rows = rows.withColumn("range", F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(F.col("_r").cast("bigint")).cast("bigint"))
    firsts = {r.range: r.k for r in rows.groupBy("range").agg(F.min(F.struct("doc_id", "th")).alias("k")).collect()}  # a row for each range
    ranges = sorted(firsts)
    plan = spark.createDataFrame([(r, ranges[i - 1], firsts[r]["doc_id"], firsts[r]["th"]) for i, r in enumerate(ranges)],
                                 "range bigint, back bigint, first_id bigint, first_th bigint")
    rows = rows.join(F.broadcast(plan), "range")
    is_first = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("th") == F.col("first_th"))
    own = F.struct(F.col("range").alias("r"), F.lit(0).alias("tail"))
    copy = F.struct(F.col("back").alias("r"), F.lit(1).alias("tail"))
    rows = rows.withColumn("to", F.explode(F.when(is_first, F.array(own, copy)).otherwise(F.array(own)))).select(
        F.col("to.r").alias("r"), F.col("to.tail").alias("tail"), "doc_id", "th", "text")
    parts = max(1, min(len(ranges), max(int(spark.conf.get("spark.sql.shuffle.partitions")), len(ranges) // 8)))
    placed = rows.repartition(parts, "r").sortWithinPartitions("r", "tail", F.col("doc_id").asc_nulls_first(), "th")
    schema = StructType([docs.schema["doc_id"]]).add("n_chars", LongType())
    for name in ("edited_sha256", "fingerprint", "edited_fingerprint"):
        schema = schema.add(name, StringType())
    schema = schema.add("near_edited", DoubleType()).add("near_next", DoubleType())

    def finish(row: tuple, following: tuple) -> tuple:
        i, text, (h, p), own = row
        new = edited(text, following[1])
        eh, ep = select(new, k, window)
        return (i, len(text), hashlib.sha256(new.encode()).hexdigest(), as_string(h, p), as_string(eh, ep), likeness(own, np.unique(eh)), likeness(own, following[3]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        had, at, ended = None, None, False

        def table(out: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kinds, strict=True)], names=[f.name for f in kinds])

        kinds = [pa.field("doc_id", pa.int64()), pa.field("n_chars", pa.int64()), *(pa.field(n, pa.string()) for n in ("edited_sha256", "fingerprint", "edited_fingerprint")),
                 pa.field("near_edited", pa.float64()), pa.field("near_next", pa.float64())]
        for b in batches:
            out = []
            for r, tail, i, text in zip(*(b.column(n).to_pylist() for n in ("r", "tail", "doc_id", "text")), strict=True):
                if r != at:
                    had, at, ended = None, r, False
                if ended:  # further copies of the row that follows
                    continue
                f = select(text, k, window)
                row = (i, text, f, np.unique(f[0]))
                if had is not None:
                    out.append(finish(had, row))
                had, ended = row, tail == 1
                if len(out) >= 512:
                    yield table(out)
                    out = []
            if out:
                yield table(out)

    return placed.mapInArrow(run, schema)
