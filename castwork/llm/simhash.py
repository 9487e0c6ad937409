"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Every distinct fingerprint emits all variants within half the radius. For an even radius 2m that is the ball of
radius m. For an odd radius 2m+1 two fingerprints at an odd distance differ in parity, so it is enough that the
even-parity side emits the ball of radius m and the odd-parity side adds its variants with m+1 flipped bits; of
2m+1 differing bits, m+1 lie in one half of the word, so only flips inside one half are needed. Variants are
shuffled as packed blocks; in each bucket equal variants meet, pairs are verified by bit distance and the links
found are reduced to a spanning forest before they leave the task (all links in one variant's group are implied
by those to one member, so no group emits its pairs). A variant belongs to a bounded number of distinct
fingerprints (its ball), so no variant can be hot; exact copies are one fingerprint before anything is emitted.

Null and empty texts have fingerprint zero and are linked like any other. Rows with a null doc_id take part; the
component id is the smallest non-null doc_id reachable (null if there is none). Repeated rows give repeated rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, ship, written

SHINGLES_AT_ONCE = 1 << 15


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """64-bit SimHash over word shingles: a bit is 1 if it is set in over half the shingle hashes."""
    if not text:
        return 0
    w = text.encode().lower().split()  # bytes: A-Z only, and split at x20 and x09-x0D
    if not w:
        return 0
    joined, h = b" ".join(w), xxhash.xxh64_intdigest
    if len(w) <= words:
        return h(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
    n = len(w) - words + 1
    a, b = [0, *ends[: n - 1].tolist()], (ends[words - 1 :] - 1).tolist()
    total = np.zeros(64, np.int64)
    for i in range(0, n, SHINGLES_AT_ONCE):
        hs = np.array([h(joined[s:e], seed) for s, e in zip(a[i : i + SHINGLES_AT_ONCE], b[i : i + SHINGLES_AT_ONCE], strict=True)], np.uint64)
        bits = np.unpackbits(hs.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += np.add.reduce(bits, axis=0, dtype=np.uint32)
    return int((2 * total > n).astype(np.uint64) @ (np.uint64(1) << np.arange(64, dtype=np.uint64)))


def with_fingerprint(docs: DataFrame, words: int, seed: int, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns, `fp` (the fingerprint as a signed long) and `th`, a hash of the text that orders equal ids."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, words, seed) for t in b.column("_text").to_pylist()], np.uint64).view(np.int64)
            yield pa.record_batch([*b.columns[1:], pa.array(fps, pa.int64())], names=[*b.schema.names[1:], "fp"])

    frame = docs.select(F.col(text).alias("_text"), *keep, F.xxhash64(F.col(text)).alias("th"))
    schema = frame.drop("_text").schema.add("fp", "long", False)
    return frame.mapInArrow(run, schema)


@lru_cache(maxsize=8)
def flip_masks(max_distance: int) -> tuple[np.ndarray, np.ndarray]:
    """(masks for every fingerprint, further masks for odd parity)."""
    def of(positions, k):
        return [sum(1 << p for p in c) for c in combinations(positions, k)]

    m, odd = divmod(max_distance, 2)
    both = [x for k in range(m + 1) for x in of(range(64), k)]
    more = [*of(range(32), m + 1), *of(range(32, 64), m + 1)] if odd else []
    return np.array(both, np.uint64), np.array(more, np.uint64)


def _spanning_forest(u: np.ndarray, v: np.ndarray) -> tuple[list[int], list[int]]:
    """Union-find over one task's links: the links that joined two trees."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    a, b = [], []
    for x, y in zip(u.tolist(), v.tolist(), strict=True):
        rx, ry = root(x), root(y)
        if rx != ry:
            parent[max(rx, ry)] = min(rx, ry)
            a.append(x)
            b.append(y)
    return a, b


def links(fps: DataFrame, n_fps: int, max_distance: int) -> DataFrame:
    """(u, v): links between distinct fingerprints at `max_distance` or fewer bits; enough of them to connect
    everything that all links would connect. `fps` has one column fp, distinct."""
    n_both, n_more = map(len, flip_masks(max_distance))
    per_bucket = 1 << 20
    n_buckets = max(128, -(-n_fps * (n_both + n_more // 2) // per_bucket))
    chunk = max(1, (1 << 20) // (n_both + n_more))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, more = flip_masks(max_distance)
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for i in range(0, len(fp), chunk):
                x = fp[i : i + chunk]
                odd = x[(np.bitwise_count(x) & 1) == 1]
                v = [(x[:, None] ^ both).ravel(), (odd[:, None] ^ more).ravel() if len(more) else x[:0]]
                k = [np.tile(np.arange(len(both), dtype=np.uint16), len(x)), np.tile(np.arange(len(both), len(both) + len(more), dtype=np.uint16), len(odd))]
                v, k = np.concatenate(v), np.concatenate(k)
                bucket = ((mix(v) >> np.uint64(32)) * np.uint64(n_buckets)) >> np.uint64(32)
                order = np.argsort(bucket, kind="stable")
                v, k, bucket = v[order], k[order], bucket[order]
                first = np.flatnonzero(np.diff(bucket, prepend=np.uint64(2**63)))
                last = [*first[1:], len(v)]
                yield pa.record_batch(
                    [pa.array(bucket[first].astype(np.int32)), pa.array([v[s:e].tobytes() for s, e in zip(first, last, strict=True)], pa.binary()),
                     pa.array([k[s:e].tobytes() for s, e in zip(first, last, strict=True)], pa.binary())],
                    names=["bucket", "variants", "flips"],
                )

    def meet(t: pa.Table) -> pa.Table:
        both, more = flip_masks(max_distance)
        masks = np.concatenate([both, more])
        v = np.frombuffer(b"".join(t.column("variants").to_pylist()), np.uint64)
        k = np.frombuffer(b"".join(t.column("flips").to_pylist()), np.uint16)
        order = np.lexsort((k, v))  # members that flipped fewest bits first
        v, k = v[order], k[order]
        fp = v ^ masks[k]
        start = np.concatenate([[True], v[1:] != v[:-1]]) if len(v) else np.empty(0, bool)
        head = fp[start][np.cumsum(start) - 1] if len(v) else fp
        near = ~start & (np.bitwise_count(head ^ fp) <= max_distance)
        pairs = np.unique(np.stack([np.minimum(head[near], fp[near]), np.maximum(head[near], fp[near])], 1), axis=0)
        pairs = pairs[np.argsort(np.bitwise_count(pairs[:, 0] ^ pairs[:, 1]), kind="stable")]
        u, w = _spanning_forest(pairs[:, 0].view(np.int64), pairs[:, 1].view(np.int64))
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(w, pa.int64())})

    out = fps.mapInArrow(emit, "bucket int, variants binary, flips binary")
    return out.groupBy("bucket").applyInArrow(meet, "u bigint, v bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each node's component, by alternating large-star and small-star rounds.

    Neighbour minima are hash aggregates (partial on the map side) joined back, so that a node with very many
    links is split by the engine's skew handling rather than held in one task. Every round is written.
    """

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = state(edges)
    while seen[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        edges = written(small.where("u <> v").distinct(), "small")
        now = state(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _grouped(docs: DataFrame, words: int, max_distance: int, seed: int, keep: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Two written tables: the rows (kept columns, th, fp), and for each distinct fp its root (the smallest
    fingerprint of its component)."""
    rows = written(with_fingerprint(docs, words, seed, keep=keep), "fingerprints")
    fps = written(rows.select("fp").distinct(), "distinct")
    found = components(links(fps.select("fp"), fps.count(), max_distance))
    roots = fps.join(found, fps.fp == found.node, "left").select("fp", F.coalesce("root", "fp").alias("root"))
    return rows, written(roots, "roots")


def _least(rows: DataFrame, roots: DataFrame, value) -> DataFrame:
    """(root, value): the least `value` of each component, first for each fingerprint, so that copies and groups
    meet as partial sums and no join stands on top of an aggregate of a crowded key."""
    each = rows.groupBy("fp").agg(F.min(value).alias("value"))
    return written(each.join(roots, "fp").groupBy("root").agg(F.min("value").alias("value")), "least")


def near_duplicates(docs: DataFrame, *, words: int = 3, max_distance: int = 3, seed: int = 42) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, fingerprint (16 hex digits), component_id."""
    rows, roots = _grouped(docs, words, max_distance, seed, ("doc_id",))
    named = written(roots.join(_least(rows, roots, F.col("doc_id")), "root").select("fp", F.col("value").alias("component_id")), "named")
    return rows.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, *, words: int = 3, max_distance: int = 3, seed: int = 42) -> DataFrame:
    """The rows of `docs` that stay, all columns: of each component the row with the smallest (non-null first)
    doc_id, ties by a hash of the text, then by one of all columns; of wholly equal rows one stays."""
    every = [x for c in docs.columns for x in (F.col(c), F.col(c).isNull())]  # a hash alone skips nulls
    row = F.xxhash64(*every)
    rows, roots = _grouped(docs.withColumn("_row", row), words, max_distance, seed, ("doc_id", "_row"))
    first = _least(rows, roots, F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "th", "_row")).select(
        F.col("value.doc_id").alias("_id"), F.col("value.th").alias("_th"), F.col("value._row").alias("_is"))
    kept = docs.join(first, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_th")) & (row == F.col("_is")), "left_semi")
    repeated = rows.groupBy("doc_id", "th", "_row").count().where("count > 1").limit(1).count()
    return kept.dropDuplicates() if repeated else kept
