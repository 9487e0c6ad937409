"""Mixing against a plain version: targets by resharing, quotas seat by seat, blocks one by one."""

from __future__ import annotations

import hashlib
import random
from fractions import Fraction

import pytest

from castwork.llm import mixing

SCHEMA = "doc_id bigint, text string, source string, size bigint, target double, pos bigint, copies bigint, shard bigint"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2.0, 3, 4, 5) for r in rows], SCHEMA).repartition(4)


def words(rows):
    out = {}
    for _, text, source in rows:
        out[source] = out.get(source, 0) + len((text or "").encode().split())
    return out


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, at_cap = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in at_cap]
        rest = total - sum(most * sizes[s] for s in at_cap)
        share = {s: Fraction(weight[s] * rest, sum(weight[x] for x in free)) for s in free}
        above = {s for s in free if share[s] > most * sizes[s]}
        if not above:
            return {s: float(most * sizes[s] if s in at_cap else share[s]) for s in order}
        at_cap |= above


def brute_seats(votes, seats):
    given = [0] * len(votes)
    for _ in range(seats):
        quotient = [v / (2 * g + 1) for v, g in zip(votes, given, strict=True)]
        given[quotient.index(max(quotient))] += 1
    return given


def corpus(seed, n):
    rng = random.Random(seed)
    text = lambda: " ".join("w" for _ in range(rng.choice([0, 3, 40, 150, 700])))
    rows = [(i, text(), rng.choice(["a", "a", "a", "a", "b", "c", "ü", "", None])) for i in range(n)]
    rows += [(n, None, "b"), (n + 1, "\t \n\x0b\x0c\r", "b"), (None, "no id", "c"), (None, "no id either", "c"), (5, "rare source", "z")]
    rows += [(7, "the same row", "b")] * 2500 + [(n + 2, "long " * 30_000, "c"), (n + 3, None, "only nulls")]
    return rows


def test_targets_and_taken_words(spark):
    rows = corpus(1, 400)
    sizes = words(rows)
    aims = brute_targets(sizes)
    found = mixing.mix(table(spark, rows)).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.size) for r in found) == sorted((i is not None, i or 0, len((t or "").encode().split())) for i, t, _ in rows)
    by_aim = {}
    for r in found:
        assert 0 <= r.taken <= 3 * r.size
        by_aim.setdefault((r.source_size, round(r.target, 6)), []).append(r.taken)
    assert set(by_aim) == {(sizes[s], round(aims[s], 6)) for s in sizes}
    assert sum(map(sum, by_aim.values())) == pytest.approx(sum(sizes.values()), abs=mixing.BLOCK)
    for (_, target), taken in by_aim.items():
        assert abs(sum(taken) - target) <= mixing.BLOCK


def test_quotas_over_many_shards(spark, monkeypatch):
    for name, value in (("SHARD_WORDS", 9000), ("SHARD_ROWS", 300), ("PART_WORDS", 3000), ("PART_ROWS", 100)):
        monkeypatch.setattr(mixing, name, value)
    rows = corpus(2, 900)
    sizes = words(rows)
    aims = brute_targets(sizes)
    frame = mixing.mix(table(spark, rows), block=16)
    found = frame.collect()
    assert len(found) == len(rows) and all(0 <= r.taken <= 3 * r.size for r in found)
    for s, z in sizes.items():
        taken = sum(r.taken for r in found if r.source_size == z and r.target == pytest.approx(aims[s]))
        assert abs(taken - aims[s]) <= max(0.05 * aims[s], 32)
    again = mixing.mix(table(spark, rows[::-1]).repartition(9), block=16).collect()
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted(map(tuple, found), key=key) == sorted(map(tuple, again), key=key)


def test_spans_are_the_words_taken(spark):
    rows = [r for r in corpus(3, 200) if r[0] != 7]
    for r in mixing.mix(table(spark, rows), spans=True).collect():
        assert r.passes * r.size + sum(x.length for x in r.spans) == r.taken
        ends = [0]
        for x in r.spans:
            assert x.start >= ends[-1] and x.length > 0
            ends.append(x.start + x.length)
        assert ends[-1] <= r.size


def test_highest_quotients():
    rng = random.Random(4)
    for _ in range(200):
        votes = [rng.choice([0.0, 64.0, rng.random() * 5000]) for _ in range(rng.randrange(1, 8))]
        seats = int(sum(votes) / 64 + 0.5)
        assert mixing.sainte_lague(votes, seats, 64) == (brute_seats(votes, seats) if any(votes) else [0] * len(votes))


def test_blocks_are_seeded():
    passes, more = mixing.chosen(1000, 2300, 64, "key")
    assert passes == 2 and more.sum() == 300 and (more == 64).sum() >= 3
    assert (mixing.chosen(1000, 2300, 64, "key")[1] == more).all()
    assert (mixing.chosen(1000, 2300, 64, "other")[1] != more).any()
    first = min(range(16), key=lambda j: _mixed(int(hashlib.md5(b"key").hexdigest()[:15], 16) + j))
    assert more[first] == min(64, 1000 - 64 * first)


def _mixed(x):
    for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        x = ((x ^ (x >> shift)) * times) % 2**64
    return x


def test_empty_and_wordless_tables(spark):
    assert mixing.mix(table(spark, [])).collect() == []
    found = mixing.mix(table(spark, [(1, None, "a"), (2, "", None)])).collect()
    assert sorted((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in found) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
