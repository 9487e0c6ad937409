"""The whole pipeline against plain Python versions of its five stages, on a small corpus with the odd cases: null,
empty and very long texts, repeated rows, copies, shared passages, a null id and columns that the stages use themselves."""

from __future__ import annotations

import collections
import random
import re
import struct
import zlib

import numpy as np
import pytest

import corpus_pipeline

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
xxhash = pytest.importorskip("xxhash")

SCHEMA = "doc_id bigint, text string, lang string, source string, start bigint, block bigint, score double, spans string, _row string, held_out boolean"


def corpus():
    rng = random.Random(11)

    def words(letters, n):
        return ["".join(rng.choice(letters) for _ in range(rng.randrange(2, 9))) for _ in range(n)]

    latin, cyrillic = "abcdefghijklmnopqrstuvwxyz", "абвгдежзиклмнопрстуфхцчшя"
    en, ru = words(latin, 400), words(cyrillic, 200)
    some = lambda v, n: " ".join(rng.choice(v) for _ in range(n))
    passage = some(en, 70)
    rows = [(i, some(en, rng.randrange(30, 90)), "en") for i in range(1, 25)]
    rows += [(i, some(ru, rng.randrange(30, 60)), "ru") for i in range(30, 38)]
    rows += [(40, None, "en"), (41, "", "en"), (42, " \t\n", None), (43, "12 34 !?", "en")]
    rows += [(50, rows[3][1], "en"), (2, *rows[3][1:]), (51, rows[30][1], "ru"), (None, rows[5][1], "en")]  # copies
    rows += [(n, rows[7][1].replace(" ", "  ", n - 51), "en") for n in (52, 53)]  # the same words
    rows += [(n, some(en, 20) + " " + passage + " " + some(en, 25), "en") for n in (60, 61, 62)]  # a shared passage
    rows += [(63, some(en, 40) + " write to ann.lee@mail.example.com or host 10.20.30.40, and ann.lee@mail.example.com again", "en")]
    rows += [(64, some(words(latin, 9000), 20_000), None)]  # a very long text without a label
    rows += [rows[9], rows[9], (65, "one", "en"), (None, some(en, 45), None)]
    return [(i, t, g, "s", 5, 7, 0.25, "x", "r", None) for i, t, g in rows]


def with_letters(rows):
    return [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]


def one_of_each_group(rows):
    def fingerprint(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    marks = [fingerprint(r[1]) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (marks[i] ^ marks[j]).bit_count() <= 3:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    best = {}
    for r, g in zip(rows, group, strict=True):
        if g not in best or (r[0] is None, r[0] or 0) < (best[g][0] is None, best[g][0] or 0):
            best[g] = r
    return list(best.values())


def without_repeats(rows, length=200):
    data = [r[1].encode() for r in rows]
    count = collections.Counter(b[j : j + length] for b in data for j in range(len(b) - length + 1))
    out = []
    for r, b in zip(rows, data, strict=True):
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - length + 1):
            if count[b[j : j + length]] > 1:
                gone[j : j + length] = True
        out.append((r[0], bytes(c for c, g in zip(b, gone, strict=True) if not g).decode()))
    return out


def without_private_data(rows):
    out = []
    for i, t in rows:
        t = re.sub(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "[EMAIL]", t)
        out.append((i, re.sub(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "[IP]", t)))
    return out


@pytest.fixture(scope="module")
def stages():
    kept = with_letters(corpus())
    single = one_of_each_group(kept)
    cut = without_repeats(single)
    return kept, single, cut, without_private_data(cut)


def _ids(rows):
    return sorted((r[0] is None, r[0] or 0) for r in rows)


def test_every_stage_equals_its_plain_version(spark, stages, tmp_path):
    kept, single, cut, clean = stages
    assert len(corpus()) > len(kept) > len(single) and cut != [(r[0], r[1]) for r in single] and clean != cut
    docs = spark.createDataFrame(corpus(), SCHEMA).repartition(4)
    wants = ([r[:2] for r in kept], [r[:2] for r in single], cut, clean)
    for (name, stage), want in zip(corpus_pipeline.STAGES, wants):
        columns = docs.columns
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == columns
        got = docs.collect()
        assert sorted((str(r.doc_id), r.text) for r in got) == sorted((str(i), t) for i, t in want), name
        assert {tuple(r[3:]) for r in got} == {("s", 5, 7, 0.25, "x", "r", None)}


def test_the_run_gives_the_plain_pieces(spark, stages, tmp_path):
    clean = stages[-1]
    spark.createDataFrame(corpus(), SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    library = tokenizers.Tokenizer.from_file(P.path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    ids = [(i, [*library.encode(t, add_special_tokens=False).ids, 1]) for i, t in clean]
    of = collections.defaultdict(list)
    for p in pieces:
        of[p.doc_id, p.doc_tokens].append(p)
    assert _ids([(p.doc_id,) for p in pieces if p.start == 0]) == _ids(clean)
    for i, tokens in ids:
        at = 0
        for p in sorted(of[i, len(tokens)], key=lambda p: p.start):
            part = tokens[p.start : p.start + p.length]
            assert p.start == at and p.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
            at += p.length
        assert at == len(tokens)
    sequences = collections.defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append(p)
    for ps in sequences.values():
        ps.sort(key=lambda p: p.offset)
        assert [p.offset for p in ps] == [sum(q.length for q in ps[:k]) for k in range(len(ps))]
        assert sum(p.length for p in ps) <= 2048
