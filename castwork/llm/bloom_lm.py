"""N-gram language-model scores from a log-frequency Bloom filter.

Tokens are words of the text (A-Z lower-cased) and one end token for each document. Exact unigram counts come from
the packed exchange (each block sends its distinct words once, with training counts, and gets the totals back).
Bigram counts of the training documents are summed per bucket, quantised to q = 1 + floor(log2 c) and stored in
the bucket's segment of a Bloom filter as the events (bigram, 1) ... (bigram, q). A bigram's level is read back by
repeated membership probes, 1, 2, ... until one fails; its count is then taken as 1.5 * 2**(q-1), rounded down to
1 for q = 1 and held to the context's exact count. The smoothed probability is

    P(w | v) = (c'(vw) + mu * P1(w)) / (c(v) + mu),   P1(w) = (c(w) + 1) / (N + V + 1)

The filter is broadcast while its size is at most `broadcast_bytes` (its exact size is known before it is
collected). Beyond that it stays a table of segments, and each block sends its distinct bigrams to the segments and
gets their levels back: the same bits are probed, so both ways give the same scores.

Words and bigrams are identified by 64-bit hashes (``word_hashes``). A null text is the empty text (its one token is the end token);
a null doc_id counts as the empty string where documents are divided. Repeated rows each count.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .blocks import PAYLOAD_SCHEMA, Block, answers_of, bounds, key_rows, pack, per_block, per_bucket, squeeze, undeltas, unsqueeze, with_answers
from .common import mix, written

END = np.uint64(0x5851F42D4C957F2D)  # hash of the end token; no word has it but by collision
BEGIN = np.uint64(0x14057B7EF767814F)
WORD_SEED = np.uint64(0x8CB92BA72F3D8DD7)
LENGTH_STEP = np.uint64(0x9E3779B97F4A7C15)
HASHES = 5
BITS_PER_EVENT = 9
BROADCAST_BYTES = 96 << 20
MU = 2.0

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def held_out(doc_id, folds: int, fold: int) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds == fold


def word_hashes(letters: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hash of each word, given the bytes of all words end to end: the sum modulo 2**64 of a mixed value for every
    (byte, position in its word). No power of a base is involved, so words built to make polynomial hashes modulo
    2**64 collide (a Thue-Morse word and its complement) differ here."""
    first = np.cumsum(sizes) - sizes
    if not len(sizes):
        return np.empty(0, np.uint64)
    keys = (np.arange(len(letters), dtype=np.uint64) - np.repeat(first, sizes).astype(np.uint64)) << np.uint64(8)
    keys |= letters
    keys += WORD_SEED
    return mix(np.add.reduceat(mix(keys), first) + sizes.astype(np.uint64) * LENGTH_STEP)


def tokens(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes in order, an end token closing each document; tokens of each document)."""
    data = _LOWER[np.frombuffer(block.data, np.uint8)]
    inside = ~_SPACE[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    full = block.starts[block.sizes > 0]
    before[full] = False  # a document's first byte starts a word
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    after[full[full > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    h = word_hashes(data[inside], ends - starts)
    cut = np.searchsorted(starts, block.ends)
    return np.insert(h, cut, END), np.diff(cut, prepend=0) + 1


def bigrams(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hash of each token with the one before it (the begin mark for a document's first)."""
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[np.cumsum(sizes) - sizes] = BEGIN
    return mix(before * np.uint64(0x9E3779B97F4A7C15) + h), before


def segment_bits(n_events: int) -> int:
    return max(64, -(-n_events * BITS_PER_EVENT // 64) * 64)


def _slots(keys: np.ndarray, level: int, m: int) -> np.ndarray:
    """Bit positions (len(keys), HASHES) of the event (key, level) in a segment of m bits, by double hashing."""
    a = mix(keys + np.uint64(level * 0x632BE59BD9B4E019 & (2**64 - 1)))
    b = mix(a) | np.uint64(1)
    return ((a[:, None] + np.arange(HASHES, dtype=np.uint64) * b[:, None]) >> np.uint64(1)) % np.uint64(m)


def build_segment(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The bucket's part of the filter: every key under all levels up to its own."""
    q = np.frexp(counts.astype(np.float64))[1]  # 1 + floor(log2 c)
    m = segment_bits(int(q.sum()))
    bits = np.zeros(m, bool)
    for level in range(1, int(q.max(initial=0)) + 1):
        bits[_slots(keys[q >= level], level, m).ravel()] = True
    return np.packbits(bits)


def levels(keys: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """Level of each key: probes at 1, 2, ... until one fails."""
    q, at, level, m = np.zeros(len(keys), np.uint8), np.arange(len(keys)), 1, len(segment) * 8
    while len(at) and level < 64:
        s = _slots(keys[at], level, m)
        hit = np.ones(len(at), bool)
        for j in range(HASHES):
            hit &= (segment[s[:, j] >> np.uint64(3)] >> (np.uint8(7) - (s[:, j] & np.uint64(7)).astype(np.uint8))) & 1 == 1
        at, level = at[hit], level + 1
        q[at] += 1
    return q


class Filter:
    """All segments; a key's segment is its bucket (a range of the key space)."""

    def __init__(self, segments: list[bytes]):
        self.segments = [np.frombuffer(s, np.uint8) for s in segments]

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Levels of sorted keys."""
        out = np.zeros(len(keys), np.uint8)
        bucket, first = bounds(keys, len(self.segments))
        for k, s, e in zip(bucket.tolist(), first.tolist(), np.append(first, len(keys))[1:].tolist(), strict=True):
            out[s:e] = levels(keys[s:e], self.segments[k])
        return out


def _totals(payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    got = [unsqueeze(p, np.uint64, np.uint32) for p in payloads]
    keys, inverse = np.unique(np.concatenate([undeltas(d) for d, _ in got]), return_inverse=True)
    counts = np.bincount(inverse, np.concatenate([c for _, c in got]), len(keys)).astype(np.uint64)
    return keys, counts, inverse, np.cumsum([0, *(len(d) for d, _ in got)])


def _unigram_totals(_: int, blocks: list[int], payloads: list[bytes]) -> list[bytes]:
    """Totals in each payload's order; the first answer is preceded by the bucket's sum and number of trained words."""
    keys, counts, inverse, at = _totals(payloads)
    stats = [int(counts.sum()), int((counts > 0).sum())]
    out = []
    for i, (s, e) in enumerate(zip(at[:-1], at[1:], strict=True)):
        n, v = stats if i == 0 else (0, 0)
        out.append(n.to_bytes(8, "big") + v.to_bytes(8, "big") + squeeze(counts[inverse[s:e]]))
    return out


@lru_cache(maxsize=1)
def _opened(shared) -> Filter:
    return Filter(shared.value)


def score(docs: DataFrame, *, folds: int = 7, fold: int = 2, mu: float = MU, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of `docs` (doc_id, text).

    Trained on the documents whose crc32(doc_id as text) modulo `folds` is not `fold`.
    """
    spark = docs.sparkSession
    blocks, n_buckets = pack(docs.select("doc_id", "text"))

    def trained(b: Block) -> np.ndarray:
        return ~np.array([held_out(i, folds, fold) for i in b.rest.column("doc_id").to_pylist()], bool)

    def words(b: Block, row: dict) -> Iterator[pa.RecordBatch]:
        h, sizes = tokens(b)
        keys, inverse = np.unique(h, return_inverse=True)
        yield key_rows(b.id, n_buckets, keys, np.bincount(inverse, np.repeat(trained(b), sizes), len(keys)).astype(np.uint32))

    unigrams = written(per_bucket(per_block(blocks, words, PAYLOAD_SCHEMA), _unigram_totals), "unigrams")
    whole = unigrams.select(*(F.conv(F.hex(F.substring("answer", s, 8)), 16, 10).cast("bigint").alias(n) for s, n in ((1, "n"), (9, "v"))))
    n_all, v_all = (int(x or 0) for x in whole.agg(F.sum("n"), F.sum("v")).first())

    def pairs(b: Block, row: dict) -> Iterator[pa.RecordBatch]:
        h, sizes = tokens(b)
        keys, counts = np.unique(bigrams(h, sizes)[0][np.repeat(trained(b), sizes)], return_counts=True)
        yield key_rows(b.id, n_buckets, keys, counts.astype(np.uint32))

    def segment(t: pa.Table) -> pa.Table:
        keys, counts, _, _ = _totals(t.column("payload").to_pylist())
        bits = build_segment(keys, counts)
        return pa.table({"bucket": t.column("bucket")[:1].cast(pa.int32()), "n": pa.array([len(bits)], pa.int64()), "bits": pa.array([bits.tobytes()], pa.binary())})

    segments = written(per_block(blocks, pairs, PAYLOAD_SCHEMA).groupBy("bucket").applyInArrow(segment, "bucket int, n bigint, bits binary"), "filter")
    size = int(segments.agg(F.sum("n")).first()[0] or 0)
    n_docs_trained = int(docs.select(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("c")).where(F.expr(f"c % {folds} <> {fold}")).count())

    shared = levelled = None
    if size <= broadcast_bytes:
        have = {r.bucket: bytes(r.bits) for r in segments.toLocalIterator()}
        empty = np.zeros(8, np.uint8).tobytes()
        shared = spark.sparkContext.broadcast([have.get(i, empty) for i in range(n_buckets)])
    else:
        levelled = _levels_by_segment(blocks, segments, n_buckets)

    def final(b: Block, row: dict) -> Iterator[pa.RecordBatch]:
        h, sizes = tokens(b)
        keys, inverse = np.unique(h, return_inverse=True)
        c = np.concatenate([unsqueeze(a[16:], np.uint64)[0] for a in answers_of(row, "unigrams")] or [np.empty(0, np.uint64)])
        c1 = c[inverse].astype(np.float64)
        own, before = bigrams(h, sizes)
        pair_keys, pair_inverse = np.unique(own, return_inverse=True)
        if shared is not None:
            q = _opened(shared).levels(pair_keys)
        else:
            q = np.concatenate([np.frombuffer(a, np.uint8) for a in answers_of(row, "levels")] or [np.empty(0, np.uint8)])
        q = q[pair_inverse].astype(np.float64)
        context = np.empty_like(c1)
        context[1:] = c1[:-1]
        context[np.cumsum(sizes) - sizes] = n_docs_trained
        c2 = np.minimum(np.where(q > 0, np.maximum(1.0, np.floor(1.5 * 2.0 ** (q - 1))), 0.0), context)
        p1 = (c1 + 1) / (n_all + v_all + 1)
        p = (c2 + mu * p1) / (context + mu)
        first = np.cumsum(sizes) - sizes
        base = np.add.reduceat(np.log10(c1 + 1), first) - sizes * np.log10(n_all + v_all + 1) if len(sizes) else p1
        known = np.add.reduceat((c1 > 0).astype(np.int64), first) if len(sizes) else sizes
        out = b.rest
        n = out.num_rows
        out = out.append_column("held_out", pa.array(~trained(b)))
        out = out.append_column("n_tokens", pa.array(sizes.astype(np.int64))).append_column("n_known", pa.array(known.astype(np.int64)))
        out = out.append_column("train_tokens", pa.array([n_all] * n, pa.int64())).append_column("base_score", pa.array(base))
        yield from out.append_column("score", pa.array(np.add.reduceat(np.log10(p), first) if n else p)).to_batches()

    schema = StructType([docs.schema["doc_id"]]).add("held_out", "boolean").add("n_tokens", "long").add("n_known", "long")
    schema = schema.add("train_tokens", "long").add("base_score", "double").add("score", "double")
    answers = {"unigrams": unigrams} | ({"levels": levelled} if levelled is not None else {})
    return per_block(with_answers(blocks, **answers), final, schema)


def _levels_by_segment(blocks: DataFrame, segments: DataFrame, n_buckets: int) -> DataFrame:
    """Beyond the broadcast bound: blocks send their distinct bigrams to the segments, which answer with levels."""

    def probes(b: Block, row: dict) -> Iterator[pa.RecordBatch]:
        h, sizes = tokens(b)
        yield key_rows(b.id, n_buckets, np.unique(bigrams(h, sizes)[0]))

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        bits = np.frombuffer(right.column("bits")[0].as_py(), np.uint8) if right.num_rows else np.zeros(8, np.uint8)
        out = [levels(undeltas(unsqueeze(p, np.uint64)[0]), bits).tobytes() for p in left.column("payload").to_pylist()]
        return pa.table({"block": left.column("block"), "bucket": left.column("bucket"), "answer": pa.array(out, pa.binary())})

    sent = per_block(blocks, probes, PAYLOAD_SCHEMA).groupBy("bucket")
    return written(sent.cogroup(segments.groupBy("bucket")).applyInArrow(answer, "block bigint, bucket int, answer binary"), "levels")
