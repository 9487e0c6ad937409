"""Byte-level BPE encoding and decoding through a distinct-word table.

Texts are split into pre-tokens ("words") inside Spark's tasks. Each block sends its distinct words, in buckets by
hash, to the word table, which encodes every distinct word of the corpus once and answers with ids; a block joins
the ids back by position. Decoding looks ids up in the worker's copy of the vocabulary, whose size is fixed by the
tokenizer file.

A null text is encoded as the empty text (no ids). Special tokens met in a text
are encoded as the library does (one id each). Texts with letters outside the Latin blocks are split by the
library's own pre-tokenizer, so that its Unicode tables decide.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from .blocks import PAYLOAD_SCHEMA, Block, answers_of, pack, payload_rows, per_block, per_bucket, squeeze, unsqueeze, with_answers

#: Fixed value: the byte-level pre-tokenization pattern.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
#: Beyond Latin, general punctuation and currency the library splits.
OTHER = regex.compile(r"[^\x00-ɏ -⁯₠-₿]")


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    special = {a.content: i for i, a in t.get_added_tokens_decoder().items()}
    cut = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
    return t, special, cut


@lru_cache(maxsize=2)
def _pieces(path: str) -> pa.Array:
    """The bytes of every id at its place (ids that the vocabulary lacks: null), undoing the printable alphabet of byte-level vocabularies (a rule: printable bytes stand for
    themselves, the others follow from 256 on)."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    back = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    t, special, _ = _tokenizer(path)
    piece = {i: w.encode() if w in special else bytes(back[c] for c in w) for w, i in t.get_vocab(with_added_tokens=True).items()}
    return pa.array([piece.get(i) for i in range(max(piece, default=-1) + 1)], pa.large_binary())


def split(text: str, path: str) -> list[str]:
    """The pre-tokens of a text in order; special tokens are words of their own."""
    t, special, cut = _tokenizer(path)
    if cut is not None and cut.search(text):
        out, at = [], 0
        for m in cut.finditer(text):
            out += _split(text[at : m.start()], t)
            out.append(m.group())
            at = m.end()
        return out + _split(text[at:], t)
    return _split(text, t)


def _split(text: str, t) -> list[str]:
    if text.isascii() or not OTHER.search(text):
        return WORDS.findall(text)
    return [text[a:b] for _, (a, b) in t.pre_tokenizer.pre_tokenize_str(text)]


def encode_words(words: list[str], path: str) -> list[list[int]]:
    t, special, _ = _tokenizer(path)
    return [e.ids for e in t.encode_batch(words, add_special_tokens=False)]


def _send(words: list[bytes]) -> bytes:
    z = zstandard.ZstdCompressor(level=3)
    body = z.compress(b"".join(words))
    sizes = squeeze(np.fromiter(map(len, words), np.uint32, len(words)))
    return len(sizes).to_bytes(8, "little") + sizes + body


def _receive(data: bytes) -> list[bytes]:
    n = int.from_bytes(data[:8], "little")
    ends = np.cumsum(unsqueeze(data[8 : 8 + n], np.uint32)[0], dtype=np.int64).tolist()
    body = zstandard.ZstdDecompressor().decompress(data[8 + n :])
    return [body[s:e] for s, e in zip([0, *ends[:-1]], ends, strict=True)]


def _distinct(block: Block, path: str, n_buckets: int) -> tuple[list[list[str]], dict[int, list[bytes]]]:
    """(words of each document, the block's distinct words by bucket in sorted order)."""
    docs = [split(t, path) if t else [] for t in block.texts()]
    distinct: set[str] = set()
    for d in docs:
        distinct.update(d)
    by: dict[int, list[bytes]] = {}
    h = xxhash.xxh64_intdigest
    for w in sorted(x.encode() for x in distinct):
        by.setdefault(h(w) % n_buckets, []).append(w)
    return docs, by


def encode(docs: DataFrame, path: str, finish, schema: StructType) -> DataFrame:
    """Encode whole texts. `finish(block, ids)` gets, for each document of a block, its ids as little-endian
    unsigned 32-bit bytes and yields record batches of `schema`."""
    blocks, n_buckets = pack(docs)

    def words(b: Block, row: dict) -> Iterator[pa.RecordBatch]:
        _, by = _distinct(b, path, n_buckets)
        yield payload_rows(b.id, [(k, len(w), _send(w)) for k, w in sorted(by.items())])

    def table(_: int, ids: list[int], payloads: list[bytes]) -> list[bytes]:
        each = [_receive(p) for p in payloads]
        known = dict.fromkeys(w for ws in each for w in ws)
        for chunk in _chunks(list(known), 1 << 14):
            known.update(zip(chunk, (np.array(x, np.uint32) for x in encode_words([w.decode() for w in chunk], path)), strict=True))
        out = []
        for ws in each:
            found = [known[w] for w in ws]
            out.append(squeeze(np.fromiter(map(len, found), np.uint32, len(found)), np.concatenate(found)))
        return out

    # The answers are read once, by the join below: they go straight to it through the shuffle, without a table.
    answers = per_bucket(per_block(blocks, words, PAYLOAD_SCHEMA), table)

    def joined(b: Block, row: dict) -> Iterator[pa.RecordBatch]:
        texts, by = _distinct(b, path, n_buckets)
        ids: dict[str, bytes] = {}
        for (_, ws), a in zip(sorted(by.items()), answers_of(row, "ids"), strict=True):
            sizes, flat = unsqueeze(a, np.uint32, np.uint32)
            ends, raw = (np.cumsum(sizes, dtype=np.int64) * 4).tolist(), flat.tobytes()
            ids.update((w.decode(), raw[s:e]) for w, s, e in zip(ws, [0, *ends[:-1]], ends, strict=True))
        yield from finish(b, [b"".join(map(ids.__getitem__, d)) for d in texts])

    return per_block(with_answers(blocks, ids=answers), joined, schema)


def _chunks(items: list, n: int) -> Iterator[list]:
    for i in range(0, len(items), n):
        yield items[i : i + n]


def decode(ids: bytes, path: str) -> str:
    """Ids (unsigned 32-bit bytes) to text; bytes that are not UTF-8 become replacement characters."""
    laid = _pieces(path).take(pa.array(np.frombuffer(ids, "<u4")))  # Arrow lays the pieces end to end
    if laid.null_count:
        raise KeyError("an id that the vocabulary lacks")
    data = laid.buffers()[2]
    return data.to_pybytes().decode(errors="replace") if data else ""


def token_digests(docs: DataFrame, path: str) -> DataFrame:
    """The columns of `docs` but text, and n_tokens, ids_sha256, decoded_sha256 (these replace clashing columns)."""
    new = ["n_tokens", "ids_sha256", "decoded_sha256"]
    docs = docs.drop(*new)
    schema = StructType([f for f in docs.schema if f.name != "text"]).add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")

    def finish(b: Block, ids: list[bytes]) -> Iterator[pa.RecordBatch]:
        out = b.rest.append_column(new[0], pa.array([len(x) // 4 for x in ids], pa.int64()))
        out = out.append_column(new[1], pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()))
        out = out.append_column(new[2], pa.array([hashlib.sha256(decode(x, path).encode()).hexdigest() for x in ids], pa.string()))
        yield from out.to_batches()

    return encode(docs, path, finish, schema)


def token_ids(docs: DataFrame, path: str) -> DataFrame:
    """The columns of `docs` but text, and ids (array of int) of the whole text."""
    docs = docs.drop("ids")
    schema = StructType([f for f in docs.schema if f.name != "text"])
    schema = StructType.fromDDL(", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in schema] + ["ids array<int>"]))

    def finish(b: Block, ids: list[bytes]) -> Iterator[pa.RecordBatch]:
        values = [np.frombuffer(x, "<u4").astype(np.int32) for x in ids]
        yield from b.rest.append_column("ids", pa.array(values, pa.list_(pa.int32()))).to_batches()

    return encode(docs, path, finish, schema)


def decoded(encoded: DataFrame, path: str) -> DataFrame:
    """`encoded` with its ids column replaced by text: ids looked up in the worker's copy of the vocabulary."""
    schema = StructType([f for f in encoded.schema if f.name != "ids"]).add("text", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i = b.schema.get_field_index("ids")
            texts = [decode(np.array(x or [], "<u4").tobytes(), path) for x in b.column(i).to_pylist()]
            names = [n for n in b.schema.names if n != "ids"]
            yield pa.record_batch([*(b.column(b.schema.get_field_index(n)) for n in names), pa.array(texts, pa.string())], names=[*names, "text"])

    return encoded.mapInArrow(run, schema)
