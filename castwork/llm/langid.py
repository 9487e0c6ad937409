"""Language identification of mixed text: script ranges, per-word scores, Viterbi with a switching penalty.

Training sums, for each language, the hashed letter n-grams (2 and 3, with word bounds) and the scripts of the
letters of all training documents; sums are merged in Spark in two levels of packed rows. Words are cut where the
script of their letters changes, and runs of scripts written without spaces into pieces of RUN letters; "word" below
is such a piece. A word's candidates are the languages that use its script; its score for each is the sum of smoothed log frequencies of its n-grams, less
the best candidate's (so that scores are log ratios). Viterbi over the words of a document, where changing the
language costs `switch`, labels spans. A document's language is the one whose spans hold most letters (the first
in sorted order of equals), its score their share of the letters.

`und` with score 0: text is null or has no letter, or nothing could be learned. A text whose letters fit no learned
script gets the most frequent training language with score 0. Repeated rows count each time.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import ship, slices, trim

FEATURES = 1 << 16
GRAMS = (2, 3)
SWITCH = 12.0
CHUNK = 256
TEXT_AT_ONCE = 2 << 20
#: Multipliers of the n-gram hash (multiply-shift), by n-gram kind and letter.
_ODD = np.random.Generator(np.random.PCG64(29)).integers(0, 2**62, (len(GRAMS), max(GRAMS))) * 2 + 1

#: First and last code point of the letter ranges of each script.
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF), (0xFB1D, 0xFB4F)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F), (0xA8E0, 0xA8FF)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF), (0x1C90, 0x1CBF), (0x2D00, 0x2D2F)],
    "ethiopic": [(0x1200, 0x139F)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9D)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)],
}
OTHER_SCRIPT = len(SCRIPTS)
#: Letters of a piece where a script has no spaces between words (Lao, Khmer and others are among the other scripts).
RUN = 8
_UNSPACED = np.array([s in ("thai", "kana", "han") for s in SCRIPTS] + [True])
_RANGES = sorted((a, b, i) for i, rs in enumerate(SCRIPTS.values()) for a, b in rs)
_FIRST, _LAST, _SCRIPT = (np.array(x, np.int64) for x in zip(*_RANGES, strict=True))

#: Whether a code point of the basic plane is a letter; beyond it, all but the symbol blocks are taken as letters.
_LETTER = np.fromiter((chr(c).isalpha() for c in range(0x10000)), bool, 0x10000)


class Model(NamedTuple):
    langs: list[str]
    scores: np.ndarray  # (FEATURES, languages) log frequencies
    scripts: np.ndarray  # (scripts, languages) whether a language uses a script
    prior: int  # the most frequent language


class Words(NamedTuple):
    """Distinct words, side by side: letters as code points, all else as bounds (0), a bound after each word."""

    grams: np.ndarray  # (positions, len(GRAMS)) hashed n-grams; FEATURES where there is none
    first: np.ndarray  # first position of each word
    letters: np.ndarray  # letters of each word
    script: np.ndarray  # script of each word's letters


def _is_letter(c: np.ndarray) -> np.ndarray:
    return _LETTER[np.minimum(c, 0xFFFF)] | ((c >= 0x10000) & ((c < 0x1D800) | (c >= 0x20000)) & (c < 0xE0000))


def _script_of(c: np.ndarray) -> np.ndarray:
    c = c.astype(np.int64)
    k = np.maximum(np.searchsorted(_FIRST, c, "right") - 1, 0)
    return np.where((c >= _FIRST[k]) & (c <= _LAST[k]), _SCRIPT[k], OTHER_SCRIPT)


def piece_starts(c: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Positions where pieces start: the words' own (`first`) and their cuts; code points of words on end."""
    at = np.flatnonzero(_is_letter(c))
    if not len(at):
        return first
    script, word = _script_of(c[at]), np.searchsorted(first, at, "right")
    begins = np.concatenate([[True], word[1:] != word[:-1]])  # the first letter of a word
    run = begins | np.concatenate([[True], script[1:] != script[:-1]])
    place = np.arange(len(at)) - np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
    cut = (run | (_UNSPACED[script] & (place % RUN == 0))) & ~begins
    return np.sort(np.concatenate([first, at[cut]]))


def _cut(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(pieces of the words in order, pieces of each word)."""
    count = np.ones(len(words), np.int64)
    odd = np.flatnonzero(pc.not_equal(pc.utf8_length(words), pc.binary_length(words)).to_numpy(zero_copy_only=False))  # ASCII has one script
    if not len(odd):
        return words, count
    texts = words.take(pa.array(odd)).to_pylist()
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    first, joined = np.cumsum(sizes) - sizes, "".join(texts)
    starts = piece_starts(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), first)
    if len(starts) == len(odd):
        return words, count
    parts = pa.array([joined[a:b] for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(joined)], strict=True)], pa.string())
    count[odd] = np.diff(np.searchsorted(starts, first), append=len(starts))
    begin = np.cumsum(count) - count
    take = np.repeat(np.arange(len(words)), count)
    own = np.arange(len(words), len(words) + len(parts))  # the parts' places after the whole words
    take[np.arange(count[odd].sum()) + np.repeat(begin[odd] - np.cumsum(count[odd]) + count[odd], count[odd])] = own
    return pa.concat_arrays([words.cast(pa.string()), parts]).take(pa.array(take)), count


def distinct_words(words: pa.Array) -> Words:
    sizes = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.cumsum(sizes + 1) - sizes - 1 + 1
    joined = "\0" + "\0".join(words.to_pylist()) + "\0"
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _is_letter(c)
    c = np.where(letter, c, 0).astype(np.uint64)
    m = len(c) - 1
    grams = np.full((m, len(GRAMS)), FEATURES, np.int32)
    for j, n in enumerate(GRAMS):
        k = len(c) - n + 1
        if k <= 0:
            continue
        h = np.zeros(k, np.uint64)
        for i in range(n):
            h += c[i : i + k] * np.uint64(_ODD[j][i])
        inner = letter[1:k + 1].copy() if n > 2 else letter[:k] | letter[1 : k + 1]
        for i in range(2, n - 1):
            inner &= letter[i : i + k]
        grams[:k, j] = np.where(inner, (h >> np.uint64(48)).astype(np.int32), np.int32(FEATURES))
    at = np.flatnonzero(letter)
    count = np.searchsorted(at, first + sizes) - np.searchsorted(at, first)
    lead = c[at[np.minimum(np.searchsorted(at, first), max(0, len(at) - 1))]].astype(np.int64) if len(at) else np.zeros(len(sizes), np.int64)
    return Words(grams, first - 1, count, _script_of(lead))  # a word owns the bound before it


def is_held_out(doc_id, folds: int, fold: int) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds == fold


def _distinct(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct lower-cased words, cut by script; index of each word in order, words of each document)."""
    lists = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
    enc = pc.list_flatten(lists).dictionary_encode()
    index = enc.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    pieces, count = _cut(enc.dictionary)
    if len(pieces) == len(enc.dictionary):
        return enc.dictionary, index, sizes
    begin, n = np.cumsum(count) - count, count[index]
    enc = pieces.dictionary_encode()
    code = enc.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    index = code[np.arange(int(n.sum())) + np.repeat(begin[index] - np.cumsum(n) + n, n)]
    return enc.dictionary, index, np.bincount(np.repeat(np.arange(len(sizes)), sizes), n, len(sizes)).astype(np.int64)


def fit(docs: DataFrame, *, folds: int = 4, fold: int = 2) -> Model:
    """Learn from text and non-null lang of the documents whose crc32(doc_id as text) modulo `folds` is not `fold`."""
    ship(docs.sparkSession)
    width = FEATURES + OTHER_SCRIPT + 1 + 1  # n-grams, scripts, documents

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for b in slices(batch, TEXT_AT_ONCE):
                langs = b.column("lang").to_pylist()
                names = sorted(set(langs))
                words, index, sizes = _distinct(b.column("text"))
                w = distinct_words(words)
                per_word = np.diff(w.first, append=len(w.grams))
                code = np.array([names.index(x) for x in langs], np.int64)
                for j, lang in enumerate(names):
                    s = sums.setdefault(lang, np.zeros(width, np.int64))
                    s[-1] += int((code == j).sum())
                    n = np.bincount(index[np.repeat(code == j, sizes)], minlength=len(words))
                    use = n > 0
                    at = np.repeat(use, per_word)
                    weight = np.repeat(n[use], per_word[use])
                    for g in w.grams[at].T:
                        s[:FEATURES] += np.bincount(g, weight, FEATURES + 1)[:FEATURES].astype(np.int64)
                    s[FEATURES:-1] += np.bincount(w.script, n * w.letters, OTHER_SCRIPT + 1).astype(np.int64)
        c = zstandard.ZstdCompressor()
        trim()
        if sums:
            yield pa.record_batch([pa.array(list(sums)), pa.array([c.compress(v.tobytes()) for v in sums.values()], pa.binary())], names=["lang", "sums"])

    def add(t: pa.Table) -> pa.Table:
        d, total = zstandard.ZstdDecompressor(), np.zeros(width, np.int64)
        for x in t.column("sums"):
            total += np.frombuffer(d.decompress(x.as_py()), np.int64)
        return pa.table({"lang": t.column("lang")[:1], "sums": pa.array([zstandard.ZstdCompressor().compress(total.tobytes())], pa.binary())})

    train = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", F.col("lang").cast("string").alias("lang"), "doc_id")
    train = train.where(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds != fold).drop("doc_id")
    sums = train.mapInArrow(count, "lang string, sums binary")
    merged = sums.withColumn("salt", F.spark_partition_id() % 64).groupBy("lang", "salt").applyInArrow(lambda k, t: add(t.drop_columns(["salt"])), "lang string, sums binary")
    rows = merged.groupBy("lang").applyInArrow(add, "lang string, sums binary").collect()  # a row for each language
    langs = sorted(r.lang for r in rows)
    by = {r.lang: np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(r.sums)), np.int64) for r in rows}
    if not langs:
        return Model([], np.zeros((FEATURES, 0), np.float32), np.zeros((OTHER_SCRIPT + 1, 0), bool), 0)
    counts = np.stack([by[x] for x in langs], 1).astype(np.float64)
    grams, script, n = counts[:FEATURES], counts[FEATURES:-1], counts[-1]
    scores = np.log((grams + 0.5) / (grams.sum(0) + 0.5 * FEATURES)).astype(np.float32)
    return Model(langs, scores, script >= 0.01 * np.maximum(1, script.sum(0)), int(np.argmax(n)))


def word_scores(model: Model, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """((words, languages) log ratios to the best candidate, whether a word has a candidate); the ratios are neutral
    (zero) for words of no learned script."""
    table = np.concatenate([model.scores, np.zeros((1, len(model.langs)), np.float32)])
    each = table[words.grams[:, 0]]
    for g in words.grams.T[1:]:
        each += table[g]
    total = np.add.reduceat(each, words.first, axis=0)
    can = model.scripts[words.script] & (words.letters > 0)[:, None]
    some = can.any(1)
    total = np.where(can, total, -np.inf)
    total -= np.where(some[:, None], total.max(1, keepdims=True), 0)
    total = np.maximum(total, -40.0)  # one word, however long or odd, cannot outweigh a sentence
    total[~some] = 0
    return total.astype(np.float32), some


def viterbi(scores: np.ndarray, sizes: np.ndarray, switch: float) -> np.ndarray:
    """Best label of each word, for documents of `sizes` words on end.

    Texts are cut into chunks whose (max, +) transfer matrices are found side by side, chained for each document,
    and traced back the same way, so that the work is on arrays however long a text is; the labels are those of
    the plain recursion (of equal scores, staying, then the first language, wins)."""
    n_docs, k = len(sizes), scores.shape[1]
    per_doc = -(-sizes // CHUNK)
    n = int(per_doc.sum())
    if not n or not k:
        return np.zeros(int(sizes.sum()), np.int64)
    first = np.cumsum(per_doc) - per_doc
    begin = np.cumsum(sizes) - sizes
    s = np.zeros((n * CHUNK, k), np.float32)
    place = np.arange(len(scores)) + np.repeat(first * CHUNK - begin, sizes)
    s[place] = scores
    s = np.ascontiguousarray(s.reshape(n, CHUNK, k).transpose(1, 0, 2))
    enter = np.zeros((n, k), np.float32)
    passed = np.ones(n, bool)  # chunks that another of their document follows
    passed[(first + per_doc - 1)[per_doc > 0]] = False
    row = np.cumsum(passed) - 1
    onward = s[:, passed]
    through = np.full((onward.shape[1], k, k), -np.inf, np.float32)
    through[:, np.arange(k), np.arange(k)] = 0
    for t in range(CHUNK if onward.shape[1] else 0):
        through = np.maximum(through, through.max(2, keepdims=True) - switch)
        through += onward[t][:, None, :]
    for j in range(1, int(per_doc.max())):
        c = first[per_doc > j] + j
        v = (enter[c - 1][:, :, None] + through[row[c - 1]]).max(1)
        enter[c] = v - v.max(1, keepdims=True)
    back = np.empty((CHUNK, n, k), np.uint8 if k < 256 else np.uint16)
    v, own = enter, np.arange(k)
    for t in range(CHUNK):
        best, top = v.argmax(1), v.max(1, keepdims=True) - switch
        back[t] = np.where(v >= top, own, best[:, None])
        v = np.maximum(v, top) + s[t]
    path = np.empty((CHUNK, n, k), back.dtype)
    cur = np.tile(own, (n, 1))
    for t in range(CHUNK - 1, -1, -1):
        path[t] = cur
        cur = np.take_along_axis(back[t], cur.astype(np.int64), 1)
    end = np.zeros(n, np.int64)
    has = per_doc > 0
    last = first[has] + per_doc[has] - 1
    end[last] = v[last].argmax(1)
    for j in range(int(per_doc.max()) - 1, 0, -1):
        c = first[per_doc > j] + j
        end[c - 1] = cur[c, end[c]]
    labels = path[:, np.arange(n), end].T.ravel()
    return labels[place].astype(np.int64)


def _label(model: Model, words: pa.Array, index: np.ndarray, sizes: np.ndarray, switch: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(label, letters, whether any language claims it) of each word."""
    if not len(words):
        return index, index, index.astype(bool)
    w = distinct_words(words)
    if not model.langs:
        return np.zeros_like(index), w.letters[index], np.zeros(len(index), bool)
    scores, some = word_scores(model, w)
    return viterbi(scores[index], sizes, switch), w.letters[index], some[index]


def identify(docs: DataFrame, model: Model, *, folds: int = 4, fold: int = 2, switch: float = SWITCH) -> DataFrame:
    """All columns of `docs`, and held_out, lang_pred, score (these replace clashing columns)."""
    ship(docs.sparkSession)
    docs = docs.drop("held_out", "lang_pred", "score")
    schema = StructType(list(docs.schema.fields)).add("held_out", "boolean").add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.langs)
        for batch in batches:
            for b in slices(batch, TEXT_AT_ONCE):
                words, index, sizes = _distinct(b.column("text"))
                labels, lens, claimed = _label(model, words, index, sizes, switch)
                doc = np.repeat(np.arange(len(sizes)), sizes)
                total = np.bincount(doc, lens, len(sizes))
                if k:
                    share = np.bincount(doc * k + labels, np.where(claimed, lens, 0), len(sizes) * k).reshape(-1, k)
                    pred = np.where(share.max(1) > 0, share.argmax(1), model.prior)
                    score = np.where(total > 0, share.max(1) / np.maximum(total, 1), 0.0)
                    name = [model.langs[p] if t > 0 else "und" for p, t in zip(pred.tolist(), total.tolist(), strict=True)]
                else:
                    score, name = np.zeros(len(sizes)), ["und"] * len(sizes)
                held = [is_held_out(i, folds, fold) for i in b.column("doc_id").to_pylist()]
                yield pa.record_batch([*b.columns, pa.array(held), pa.array(name, pa.string()), pa.array(score)], names=[*b.schema.names, "held_out", "lang_pred", "score"])
        trim()

    return docs.mapInArrow(run, schema)


def spans(text: str, model: Model, switch: float = SWITCH) -> list[tuple[str, int, int]]:
    """(language, start, end) of the labelled spans of one text, in code points."""
    words = [m.span() for m in re.finditer(r"\S+", text)]
    lower = "".join(x if len(x := c.lower()) == 1 else c for c in text)  # as long as the text
    c = np.frombuffer("".join(lower[a:b] for a, b in words).encode("utf-32-le", "surrogatepass"), np.uint32)
    place = np.concatenate([np.empty(0, np.int64), *(np.arange(a, b) for a, b in words)])
    size = np.array([b - a for a, b in words], np.int64)
    starts = piece_starts(c, np.cumsum(size) - size)
    ends = np.append(starts[1:], len(c)) - 1
    found = list(zip(place[starts].tolist(), (place[ends] + 1).tolist(), strict=True)) if words else []
    enc = pa.array([text[a:b].lower() for a, b in found], pa.string()).dictionary_encode()
    labels, _, _ = _label(model, enc.dictionary, enc.indices.to_numpy().astype(np.int64), np.array([len(found)]), switch)
    out: list[tuple[str, int, int]] = []
    for (a, b), x in zip(found, labels.tolist(), strict=True):
        if out and out[-1][0] == model.langs[x]:
            out[-1] = (out[-1][0], out[-1][1], b)
        else:
            out.append((model.langs[x], a, b))
    return out
