"""Packing token sequences by Karmarkar-Karp multiway differencing.

A document's ids are cut into full windows of `capacity`, each a sequence of its own, and a rest that is cut into
pieces of at most `piece` ids. Rests are gathered in blocks of about `block_items` pieces in the order the tasks
read them (so no key decides a block and none can be hot) and each block is dealt to windows by the largest
differencing method: partial partitions are merged, the two of the largest spread first, heavy windows of one
against light windows of the other, which leaves near-equal windows. The window count starts at the least possible
and rises while a window is over capacity. Only piece descriptions are shuffled, never ids.

Null and empty texts are the end id alone. Repeated rows are packed like any other; a null doc_id stays null.
"""

from __future__ import annotations

import heapq
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from string import ascii_lowercase

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructType

from .common import ship, slices, trim

CACHE_WORDS = 400_000
TOGETHER = 256
TEXT_AT_ONCE = 6 << 20
#: Trailing marks that never join with a letter before them.
MARKS = ",.;:!?#$%&*)]}\""
#: Latin letters are below; what any table of letters knows as such, however old.
LATIN_END = "\u0250"
#: Every letter behind every other: what leaves this whole and as it is does so with any word of these letters up to its length.
PAIRS = "".join(a + b for a in ascii_lowercase for b in ascii_lowercase)


class WordIds:
    """ids of a text as unsigned 32-bit bytes, each distinct word encoded once while it stays in a bounded cache.

    For tokenizers that fold case and drop white space between words: nothing they do looks across it. Words of
    letters alone are one pre-token each, so many are encoded in one call and told apart by their end-of-word ids.
    Where the tokenizer's steps before its model leave words of a to z as they are, these go to the model by spaces only.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        t = self.tokenizer = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        vocab = t.get_vocab()
        self.closes = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.closes[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        self.special = {x.content[:2] for x in t.get_added_tokens_decoder().values()}
        self.by_spaces = None
        folded = t.normalizer.normalize_str(PAIRS) if t.normalizer else PAIRS
        if t.pre_tokenizer and folded == PAIRS and [w for w, _ in t.pre_tokenizer.pre_tokenize_str(PAIRS)] == [PAIRS]:
            self.by_spaces = Tokenizer(t.model)
            self.by_spaces.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.known: dict[str, bytes] = {"": b""}

    def _single(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _letters(self, words: list[str], by_spaces: bool = False) -> list[bytes]:
        out: list[bytes] = []
        groups = [words[i : i + TOGETHER] for i in range(0, len(words), TOGETHER)]
        tokenizer = self.by_spaces if by_spaces and self.by_spaces else self.tokenizer
        for g, e in zip(groups, tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            ends = (np.flatnonzero(self.closes[ids]) + 1).tolist()
            if len(ends) == len(g) and ends[-1] == len(ids):
                raw = ids.tobytes()
                out += [raw[4 * s : 4 * e] for s, e in zip([0, *ends[:-1]], ends, strict=True)]
            else:
                out += self._single(g)
        return out

    def _learn(self, new: list[str]) -> None:
        known = self.known
        spelt = pa.array(new, pa.string())
        trimmed = pc.utf8_rtrim(spelt, MARKS)
        plain = pc.ascii_is_alpha(trimmed).to_numpy(zero_copy_only=False)
        ends_in_mark = plain & pc.not_equal(trimmed, spelt).to_numpy(zero_copy_only=False)
        stems = trimmed.to_numpy(zero_copy_only=False)
        marked = [(new[i], stems[i]) for i in np.flatnonzero(ends_in_mark).tolist()]
        letters, other = {}, []
        for i in np.flatnonzero(~plain).tolist():
            w, stem = new[i], stems[i]
            if w.isalpha():
                letters[w] = None
            # A letter whose normal form ends in a mark (as that of İ does) would join the marks behind it.
            elif stem.isalpha() and max(stem) < LATIN_END and stem.lower().isalpha():
                letters[stem] = None
                marked.append((w, stem))
            else:
                other.append(w)
        marks = dict.fromkeys(w[len(stem) :] for w, stem in marked)
        ascii_words = dict.fromkeys(stems[plain].tolist())
        short = [w for w in ascii_words if len(w) <= len(PAIRS)]
        letters |= dict.fromkeys(w for w in ascii_words if len(w) > len(PAIRS))
        for words, encode in ((short, lambda x: self._letters(x, by_spaces=True)), (letters, self._letters), (marks, self._single), (other, self._single)):
            unmet = [w for w in words if w not in known]
            known.update(zip(unmet, encode(unmet), strict=True))
        for w, stem in marked:
            known[w] = known[stem] + known[w[len(stem) :]]

    def __call__(self, texts: pa.Array) -> list[bytes]:
        texts = pc.fill_null(texts, "")
        # A special token is met as it is spelt: texts that may hold one are encoded by themselves, case and all.
        odd = np.zeros(len(texts), bool)
        for x in self.special:
            odd |= pc.match_substring(texts, x).to_numpy(zero_copy_only=False)
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.if_else(pa.array(odd), "", texts)))
        coded = pc.list_flatten(lists).dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) > CACHE_WORDS:
            self.known = {"": b""}
        self._learn([w for w in words if w not in self.known])
        # Arrow lays the words' ids end to end in the order of the text; its offsets are where each word ends.
        laid = pa.array(list(map(self.known.__getitem__, words)), pa.large_binary()).take(coded.indices)
        _, offsets, data = laid.buffers()
        raw = data.to_pybytes() if data else b""
        ends = np.frombuffer(offsets, np.int64, len(laid) + 1) if len(laid) else np.zeros(1, np.int64)
        cut = ends[np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)]
        out = [raw[s:e] for s, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        for i in np.flatnonzero(odd).tolist():
            out[i] = self._single([texts[i].as_py()])[0]
        return out


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def differencing(sizes: np.ndarray, windows: int) -> np.ndarray:
    """Window of each item by the largest differencing method for `windows` ways."""
    n = len(sizes)
    if windows == 1 or n <= windows:
        return np.arange(n) if windows > 1 else np.zeros(n, np.int64)
    left, right = [], []  # children of the merged sets; leaves are -1 - item, empty is `none`
    none = np.iinfo(np.int64).max
    heap = []
    for i, s in enumerate(sizes.tolist()):
        heap.append((-s, i, np.array([s], np.int64), np.array([-1 - i], np.int64), 0))
    heapq.heapify(heap)
    tie = n
    made = 0
    while len(heap) > 1:
        _, _, a, x, low_a = heapq.heappop(heap)
        _, _, b, y, low_b = heapq.heappop(heap)
        # a and b hold the loads above the lowest window, heavy first; windows beyond their length are empty of items
        k = max(len(a), len(b), min(windows, len(a) + len(b)))
        loads, sets = np.zeros(k, np.int64), np.full(k, none)
        loads[: len(a)], sets[: len(a)] = a, x
        at = slice(k - len(b), k)
        both = slice(k - len(b), len(a))
        over = len(a) - (k - len(b))
        loads[at] += b[::-1]
        if over > 0:
            left.append(sets[both].copy())
            right.append(y[::-1][:over])
            sets[both] = made + np.arange(over)
            made += over
            sets[len(a) : k] = y[::-1][over:]
        else:
            sets[at] = y[::-1]
        order = np.argsort(-loads, kind="stable")
        loads, sets = loads[order], sets[order]
        spread = loads[0] - (loads[-1] if k == windows else 0)
        heapq.heappush(heap, (-int(spread), tie, loads, sets, 0))
        tie += 1
    _, _, _, sets, _ = heap[0]
    lefts, rights = (np.concatenate(z) if z else np.empty(0, np.int64) for z in (left, right))
    out = np.empty(n, np.int64)
    for w, root in enumerate(sets.tolist()):
        todo = [root]
        while todo:
            s = todo.pop()
            if s < 0:
                out[-1 - s] = w
            elif s != none:
                todo += [int(lefts[s]), int(rights[s])]
    return out


def windows_of(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Window of each item, no window over capacity; the count rises until that holds."""
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        w = differencing(sizes, k)
        if np.bincount(w, sizes).max(initial=0) <= capacity:
            return w
        k += max(1, k // 400)


PIECES = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint"


def pack_documents(docs: DataFrame, path: str, *, capacity: int = 2048, piece: int = 256, block_items: int = 2048, end_id: int = 1) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    ship(docs.sparkSession)
    longs = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id"]
    doc_id = docs.schema["doc_id"]
    schema = StructType([doc_id])
    for name in longs:
        schema = schema.add(name, LongType())
    schema = schema.add("_block", LongType())
    end = int(end_id).to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, part = word_ids(path), TaskContext.get().partitionId()
        full = block = held = 0
        for batch in batches:
            for b in slices(batch, TEXT_AT_ONCE):
                keys, rows = [], []
                for j, ids in enumerate(ids_of(b.column("text"))):
                    ids += end
                    n = len(ids) // 4
                    at = 0
                    while at < n:
                        size = capacity if n - at >= capacity else min(piece, n - at)
                        crc = zlib.crc32(ids[4 * at : 4 * (at + size)])
                        if size == capacity:
                            rows.append((at, size, crc, n, (part << 40 | full) * 2, None))
                            full += 1
                        else:
                            rows.append((at, size, crc, n, None, part << 20 | block))
                            held += 1
                        keys.append(j)
                        at += size
                    if held >= block_items:
                        block, held = block + 1, 0
                cols = [b.column("doc_id").take(pa.array(keys, pa.int64())), *(pa.array(c, pa.int64()) for c in zip(*rows, strict=True))]
                yield pa.record_batch(cols, names=["doc_id", *longs, "_block"])
        trim()

    def deal(t: pa.Table) -> pa.Table:
        t = t.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("length", "ascending"), ("ids_crc32", "ascending")])
        sizes = t.column("length").to_numpy()
        w = windows_of(sizes, capacity)
        order = np.argsort(w, kind="stable")
        ends = np.cumsum(sizes[order])
        first = np.concatenate([[True], np.diff(w[order]) > 0])
        offset = np.empty(len(w), np.int64)
        begin = ends - sizes[order]
        offset[order] = begin - begin[first][np.cumsum(first) - 1]
        seq = (t.column("_block").to_numpy() << 20 | w) * 2 + 1
        out = t.drop_columns(["_block"])
        out = out.set_column(out.schema.get_field_index("sequence_id"), "sequence_id", pa.array(seq, pa.int64()))
        return out.append_column("offset", pa.array(offset, pa.int64()))

    pieces = docs.select("text", "doc_id").mapInArrow(cut, schema)
    # Full windows pass through the same grouping, spread by their own numbers, so that texts are tokenized once.
    done = StructType([*schema.fields[:-1]]).add("offset", LongType())

    def either(t: pa.Table) -> pa.Table:
        if t.column("_block")[0].as_py() is not None:
            return deal(t)
        return t.drop_columns(["_block", "_key"]).append_column("offset", pa.array(np.zeros(t.num_rows, np.int64)))

    from pyspark.sql import functions as F

    keyed = pieces.withColumn("_key", F.coalesce("_block", -1 - F.floor(F.col("sequence_id") / 8192)))

    def grouped(t: pa.Table) -> pa.Table:
        return either(t if t.column("_block")[0].as_py() is None else t.drop_columns(["_key"]))

    return keyed.groupBy("_key").applyInArrow(grouped, done)
