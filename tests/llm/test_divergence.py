"""The divergence audit against a plain version over whole columns."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from castwork.llm import divergence

SCHEMA = "doc_id bigint, text string, lang string, source string, term string, row string, place int, occ bigint"


def table(spark, rows):
    return spark.createDataFrame([(i, *r, "x", "y", 0, 1) for i, r in enumerate(rows)], SCHEMA).repartition(5)


def brute(rows, least_docs, most=10):
    langs = {}
    for text, lang, source in rows:
        terms = ["".join(c.lower() if c.isascii() else c for c in w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        langs.setdefault(lang or "", []).append((source or "", terms))
    out = []
    for lang, docs in langs.items():
        df = Counter(t for _, terms in docs for t in set(terms))
        vocab = sorted((t for t, n in df.items() if n >= least_docs), key=str.encode)
        cols = {s: Counter() for s, _ in docs}
        for s, terms in docs:
            cols[s].update(t for t in terms if df[t] >= least_docs)
        whole = sum(cols.values(), Counter())
        p = lambda c, t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(vocab))
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s, c in cols.items():
            pairs = [(sum(f(p(c, t), p(d, t)) for t in vocab), o) for o, d in cols.items() if o != s]
            terms = [(f(p(c, t), p(whole, t)), t) for t in vocab if c[t] and p(c, t) > p(whole, t)]
            for part, found in (("pair", pairs), ("term", terms)):
                for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode())), 1):
                    if part == "pair" or rank <= most:
                        out.append((lang, s, part, item, value, rank))
    return sorted(out)


def corpus(seed, n):
    rng = random.Random(seed)
    vocab = {"en": ["the", "The", "cat", "dog's", "naïve", "x1y", "rare"], "zh": ["猫", "狗 鱼", "Кот", "İ", "ß"], None: ["one"]}
    rows = []
    for i in range(n):
        lang = rng.choice(["en", "en", "zh", None])
        source = rng.choice([None, "", *"abcdefg"]) if i % 3 else "hot"
        words = rng.choices(vocab[lang], k=rng.randrange(12)) + ["only"] * (i == 7) + [f"{source}mark"] * rng.randrange(2)
        rows.append((" ".join(words), lang, source))
    rows += rows[:10] + [(None, "en", "nulls"), ("", "en", "empties"), ("12 !? \x7f", "xx", "a"), ("word", "xx", "b"), ("lonely", "yy", "a")]
    rows += [("long " * 50_000 + "text", "en", "a"), ("the " * 3, "en", "a")]
    return rows


@pytest.mark.parametrize(("least", "tile", "held"), [(10, 64, 1 << 18), (2, 3, 5)])
def test_audit(spark, monkeypatch, least, tile, held):
    monkeypatch.setattr(divergence, "TILE", tile)
    monkeypatch.setattr(divergence, "HELD_TERMS", held)
    rows = corpus(least, 300)
    found = divergence.audit(table(spark, rows), least_docs=least)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, found.collect())) == brute(rows, least)


def test_no_documents(spark):
    assert divergence.audit(table(spark, [])).collect() == []


def test_intersected_runs_are_the_whole_column():
    rng = np.random.default_rng(3)
    for _ in range(50):
        a, b = rng.integers(0, 3, 200), rng.integers(0, 2, 200)
        runs = []
        for c in (a, b):
            starts = np.r_[0, np.flatnonzero(np.diff(c)) + 1]
            runs.append((np.r_[starts[1:], 200], divergence.shares(c[starts], 400, 200)))
        p, q = divergence.shares(a, 400, 200), divergence.shares(b, 400, 200)
        assert divergence.run_divergence(*runs) == int(((p - q) ** 2 // (p + q)).sum())


def test_shares_are_exact_beyond_64_bits():
    n = 10**15
    assert divergence.shares(np.array([10**14, 0]), n, 7).tolist() == [1 + 10**9 * (10**14 + 2) // (n + 14), 1]


def test_jvm_shares_are_exact(spark):
    from pyspark.sql import functions as F

    n, counts = 10**15, [10**14, 0, 123_456_789_012_345]
    rows = spark.createDataFrame([(c, n, 7) for c in counts], "c long, n long, v long")
    got = [r[0] for r in rows.select(divergence._share(F.col("c"), F.col("n"), F.col("v"))).collect()]
    assert got == [1 + 10**9 * (c + 2) // (n + 14) for c in counts]
