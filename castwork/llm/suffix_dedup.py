"""Exact-substring deduplication by difference-cover blockwise suffix sorting.

Every byte covered by a string of `length` bytes that also starts anywhere else goes. What is needed of the suffix
array is which suffixes tie on their first `length` bytes; any fixed order that puts such suffixes side by side
serves, so suffixes are ordered by fingerprints of their prefixes instead of letter by letter (80 bits decide
equality, which shuffles 10 bytes for a suffix in place of 200).

1. Cover sample. Positions whose offset in the document is in a difference cover D modulo `period` are sorted by
   their prefix of `length - period + 1` bytes, one bucket at a time. For two suffixes that tie on `length` bytes
   some shift below `period` brings both to cover positions that tie on that shorter prefix, so a suffix with no
   tied cover position within `period` bytes is unique and is never sorted.
2. Long ties. Cover positions that tied are ranked by their prefix of `length + period - 1` bytes. A tie there
   settles the `period` suffixes at and behind the position without sorting them; only the first member of each
   class (by block, then position) stands for the class in the next step.
3. The suffixes left are sorted by their `length`-byte prefix, one bucket at a time.

Keys of a block are distinct and delta coded; a bucket answers with one or two bits for each key. Texts are written
once, in blocks, and never shuffled. Strings shorter than `length`, null and empty texts lose nothing; repeated
rows are copies like any other. All columns of the input are kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, LongType, StructType

from .blocks import (PAYLOAD_SCHEMA, Block, answers_of, key_rows, pack, per_block, per_bucket, undeltas, unsqueeze,
                     with_answers, written_answers)
from .common import Rolling

#: A perfect difference set modulo 133 (every residue is a difference of two members).
COVER_PERIOD = 133
COVER = (0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109)


def is_cover(cover: tuple[int, ...], period: int) -> bool:
    return {(a - b) % period for a in cover for b in cover} == set(range(period))


class _Pass:
    """What each pass computes anew from a block: hashes, cover positions and, given answers, ties."""

    def __init__(self, block: Block, length: int, period: int, cover: tuple[int, ...]):
        self.block, self.length, self.period = block, length, period
        self.short, self.long = length - period + 1, length + period - 1
        self.bytes = np.frombuffer(block.data, np.uint8)
        self.first = Rolling(811)
        self.prefix = self.first.prefix(self.bytes)
        whole = np.flatnonzero(block.sizes >= length)
        self.docs = list(zip(block.starts[whole].tolist(), block.ends[whole].tolist(), strict=True))
        most = max((e - s for s, e in self.docs), default=0)
        grid = (np.arange(0, most, period, dtype=np.int64)[:, None] + np.array(cover, np.int64)).ravel()
        parts = [s + grid[: np.searchsorted(grid, e - s - self.short, "right")] for s, e in self.docs]
        self.positions = np.concatenate(parts) if parts else np.empty(0, np.int64)
        self.doc_start = np.repeat([s for s, _ in self.docs], [len(p) for p in parts]).astype(np.int64)
        self.doc_end = np.repeat([e for _, e in self.docs], [len(p) for p in parts]).astype(np.int64)

    def short_keys(self) -> tuple[np.ndarray, np.ndarray]:
        h = self.first.at(self.prefix, self.positions, self.positions + self.short)
        return np.unique(h >> np.uint64(16) << np.uint64(16), return_inverse=True)

    def tied(self, answers: list[bytes]) -> None:
        """Keep the cover positions whose short prefix is tied."""
        keys, inverse = self.short_keys()
        keep = _bits(answers, keys)[inverse]
        self.positions, self.doc_start, self.doc_end = self.positions[keep], self.doc_start[keep], self.doc_end[keep]

    def double(self) -> tuple[Rolling, np.ndarray]:
        if not hasattr(self, "second"):
            other = Rolling(977)
            self.second = other, other.prefix(self.bytes)
        return self.second

    def keyed(self, at: np.ndarray, length: int):
        """Distinct 80-bit keys of [at, at + length): (64 bits sorted, 16 bits, first occurrence, inverse, counts)."""
        h = self.first.at(self.prefix, at, at + length)
        keys, index, inverse, counts = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
        other, prefix = self.double()
        low = (other.at(prefix, at[index], at[index] + length) >> np.uint64(48)).astype(np.uint16)
        return keys, low, index, inverse, counts

    def long_at(self) -> np.ndarray:
        return self.positions[self.positions + self.long <= self.doc_end]

    def settled(self, answers: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(settled, silent): suffixes known to tie; those of them for which another member of a class stands."""
        at, n = self.long_at(), len(self.bytes)
        keys, _, index, inverse, counts = self.keyed(at, self.long)
        tied, rep = _two_bits(answers, keys)
        is_rep = np.zeros(len(at), bool)
        is_rep[index] = rep
        known = tied[inverse]
        return _cover(at[known], 0, self.period, n), _cover(at[known & ~is_rep], 0, self.period, n)

    def candidates(self) -> np.ndarray:
        """Suffixes with a tied cover position at or up to period - 1 bytes after them."""
        lo = np.maximum(self.positions - (self.period - 1), self.doc_start)
        hi = np.minimum(self.positions, self.doc_end - self.length)
        ok = lo <= hi
        return _marked(lo[ok], hi[ok] + 1, len(self.bytes))


def _marked(lo: np.ndarray, hi: np.ndarray, n: int) -> np.ndarray:
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, lo, 1)
    np.add.at(step, hi, -1)
    return np.cumsum(step[:n]) > 0


def _cover(at: np.ndarray, before: int, after: int, n: int) -> np.ndarray:
    return _marked(at - before, np.minimum(at + after, n), n)


def _bits(answers: list[bytes], keys: np.ndarray) -> np.ndarray:
    """The tie bit of each key; answers come in bucket order, which is key order."""
    out, at = np.zeros(len(keys), bool), 0
    for a in answers:
        n = int.from_bytes(a[:4], "little")
        out[at : at + n] = np.unpackbits(np.frombuffer(a, np.uint8, offset=4), count=n)
        at += n
    assert at == len(keys)
    return out


def _two_bits(answers: list[bytes], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = []
    for a in answers:
        n = int.from_bytes(a[:4], "little")
        size = (n + 7) // 8
        both.append((a[:4] + a[4 : 4 + size], a[:4] + a[4 + size : 4 + 2 * size]))
    return _bits([x for x, _ in both], keys), _bits([y for _, y in both], keys)


def _answer(*bits: np.ndarray) -> bytes:
    return len(bits[0]).to_bytes(4, "little") + b"".join(np.packbits(b).tobytes() for b in bits)


def _short_ties(_: int, blocks: list[int], payloads: list[bytes]) -> list[bytes]:
    """Sort the bucket's cover positions by their short prefix; a key met twice, in one block or two, is tied."""
    got = [unsqueeze(p, np.uint64, np.uint8) for p in payloads]
    each = [undeltas(d) for d, _ in got]
    keys, inverse, counts = np.unique(np.concatenate(each), return_inverse=True, return_counts=True)
    tied = counts > 1
    tied[inverse[np.concatenate([m for _, m in got]) > 0]] = True
    at = np.cumsum([0, *map(len, each)])
    return [_answer(tied[inverse[s:e]]) for s, e in zip(at[:-1], at[1:], strict=True)]


def _long_ties(_: int, blocks: list[int], payloads: list[bytes]) -> list[bytes]:
    """Sort by 80-bit key; ties within a class, and the block (first in order) that stands for it."""
    got = [unsqueeze(p, np.uint64, np.uint16, np.uint8) for p in payloads]
    sizes = [len(d) for d, _, _ in got]
    keys, low = np.concatenate([undeltas(d) for d, _, _ in got]), np.concatenate([x for _, x, _ in got])
    multi = np.concatenate([m for _, _, m in got]) > 0
    order = np.lexsort((low, keys))  # stable: blocks stay in order
    k, x = keys[order], low[order]
    head = np.ones(len(k), bool)
    head[1:] = (k[1:] != k[:-1]) | (x[1:] != x[:-1])
    group = np.cumsum(head) - 1
    tied_group = np.bincount(group) > 1
    tied_group[group[multi[order]]] = True
    tied, rep = np.empty(len(k), bool), np.empty(len(k), bool)
    tied[order], rep[order] = tied_group[group], head
    at = np.cumsum([0, *sizes])
    return [_answer(tied[s:e], rep[s:e]) for s, e in zip(at[:-1], at[1:], strict=True)]


def _decide(docs: DataFrame, length: int, period: int, cover: tuple[int, ...], finish, schema) -> DataFrame:
    if not is_cover(cover, period) or length <= period:
        raise ValueError("cover must be a difference cover of a period below the length")
    blocks, n_buckets = pack(docs)

    def cover_sample(b: Block, row: dict) -> Iterator[pa.RecordBatch]:
        p = _Pass(b, length, period, cover)
        keys, inverse = p.short_keys()
        yield key_rows(b.id, n_buckets, keys, (np.bincount(inverse, minlength=len(keys)) > 1).astype(np.uint8))

    short = written_answers(per_bucket(per_block(blocks, cover_sample, PAYLOAD_SCHEMA), _short_ties), n_buckets, "short")

    def ranked(b: Block, row: dict) -> Iterator[pa.RecordBatch]:
        p = _Pass(b, length, period, cover)
        p.tied(answers_of(row, "short"))
        keys, low, _, _, counts = p.keyed(p.long_at(), p.long)
        yield key_rows(b.id, n_buckets, keys, low, (counts > 1).astype(np.uint8))

    long = written_answers(per_bucket(per_block(with_answers(blocks, short=short), ranked, PAYLOAD_SCHEMA), _long_ties), n_buckets, "long")

    def suffixes(p: _Pass, row: dict) -> tuple[np.ndarray, np.ndarray]:
        p.tied(answers_of(row, "short"))
        settled, silent = p.settled(answers_of(row, "long"))
        return settled, np.flatnonzero(p.candidates() & ~silent)

    def left(b: Block, row: dict) -> Iterator[pa.RecordBatch]:
        p = _Pass(b, length, period, cover)
        _, at = suffixes(p, row)
        keys, low, _, _, counts = p.keyed(at, length)
        yield key_rows(b.id, n_buckets, keys, low, (counts > 1).astype(np.uint8))

    own = written_answers(per_bucket(per_block(with_answers(blocks, short=short, long=long), left, PAYLOAD_SCHEMA), _long_ties), n_buckets, "own")

    def last(b: Block, row: dict) -> Iterator[pa.RecordBatch]:
        p = _Pass(b, length, period, cover)
        settled, at = suffixes(p, row)
        keys, inverse = np.unique(p.first.at(p.prefix, at, at + length), return_inverse=True)
        starts = settled
        starts[at[_two_bits(answers_of(row, "own"), keys)[0][inverse]]] = True
        at = np.flatnonzero(starts)
        yield from finish(b, _cover(at, 0, length, len(p.bytes)))

    return per_block(with_answers(blocks, short=short, long=long, own=own), last, schema)


def repeated_spans(docs: DataFrame, *, length: int = 200, period: int = COVER_PERIOD, cover: tuple[int, ...] = COVER) -> DataFrame:
    """The columns of `docs` but text, and n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, and
    spans (array of [start, end) byte offsets removed) under those names (which replace clashing columns)."""
    new = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
    docs = docs.drop(*new)
    schema = StructType([f for f in docs.schema if f.name != "text"])
    for name, kind in zip(new, ("long", "long", "long", "string", ArrayType(ArrayType(LongType()))), strict=True):
        schema = schema.add(name, kind)

    def finish(b: Block, gone: np.ndarray) -> Iterator[pa.RecordBatch]:
        cols: list[list] = [[], [], [], [], []]
        for s, e in zip(b.starts.tolist(), b.ends.tolist(), strict=True):
            g = gone[s:e]
            edge = np.flatnonzero(np.diff(g.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
            text = b.data[s:e]
            kept = text if not len(edge) else np.frombuffer(text, np.uint8)[~g].tobytes()
            for c, v in zip(cols, (e - s, e - s - len(kept), len(edge), hashlib.sha256(kept).hexdigest(), edge.tolist()), strict=True):
                c.append(v)
        rest = b.rest
        types = [pa.int64()] * 3 + [pa.string(), pa.list_(pa.list_(pa.int64()))]
        for name, c, t in zip(new, cols, types, strict=True):
            rest = rest.append_column(name, pa.array(c, t))
        yield from rest.to_batches()

    return _decide(docs, length, period, cover, finish, schema)


def remove_repeats(docs: DataFrame, *, length: int = 200, period: int = COVER_PERIOD, cover: tuple[int, ...] = COVER) -> DataFrame:
    """`docs` with the repeated bytes taken out of text (a character that loses a byte goes whole); n_chars, if
    there is such a column, is counted anew where the text changed. Other columns are as they were."""
    order, has_n = docs.columns, "n_chars" in docs.columns

    def finish(b: Block, gone: np.ndarray) -> Iterator[pa.RecordBatch]:
        texts, changed = [], []
        for n, s, e in zip(b.lens.tolist(), b.starts.tolist(), b.ends.tolist(), strict=True):
            g = gone[s:e]
            cut = bool(g.any())
            kept = np.frombuffer(b.data[s:e], np.uint8)[~g].tobytes() if cut else b.data[s:e]
            texts.append(None if n < 0 else kept.decode(errors="ignore"))
            changed.append(cut)
        rest = b.rest
        if has_n:
            i = rest.schema.get_field_index("n_chars")
            had = rest.column(i).to_pylist()
            rest = rest.set_column(i, rest.schema.field(i), pa.array([len(t) if c else h for t, c, h in zip(texts, changed, had, strict=True)], rest.schema.field(i).type))
        rest = rest.append_column("text", pa.array(texts, pa.string()))
        yield from rest.select(order).to_batches()

    return _decide(docs, length, period, cover, finish, docs.schema)
