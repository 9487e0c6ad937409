"""The conversation trie against brute force: shared openings, odd rows, trees over many tasks."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from castwork.llm import prefix_trie as pt

SCHEMA = "conv_id bigint, turn bigint, role string, text string, path string, part int, depth bigint, open boolean"


def brute_lists(rows):
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}


def brute_rebuilt(lists):
    out = {}
    for c, turns in lists.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = lists.get(c - c % 5, [])[:h] + turns[h:]
    return out


def brute_nodes(lists):
    members, ends = {}, {}
    for c, turns in lists.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    kids = {}
    for k in members:
        if k:
            kids.setdefault(k[:-1], []).append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        own = (len(members[k]) - 1) * len(k[-1][1].encode()) if k else 0
        leaves[k] = sum(leaves[x] for x in kids.get(k, [])) or 1
        saved[k] = own + sum(saved[x] for x in kids.get(k, []))
    return sorted(
        (min(m), len(k), min(members[k[:-1]]) if k else -1, len(m), len(kids.get(k, [])), leaves[k], saved[k],
         hashlib.sha256(",".join(map(str, sorted(ends.get(k, [])))).encode()).hexdigest())
        for k, m in members.items()
    )


def found(frame):
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted(tuple(-1 if r[c] is None else r[c] for c in names) for r in frame.collect())


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, True) for r in rows], SCHEMA)


@pytest.fixture()
def parts(spark):
    had = spark.conf.get("spark.sql.shuffle.partitions")
    yield lambda n: spark.conf.set("spark.sql.shuffle.partitions", str(n))
    spark.conf.set("spark.sql.shuffle.partitions", had)


def random_rows(seed, n, turns, texts):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        rows += [(c, t, rng.choice(["user", "tool"]), rng.choice(texts)) for t in range(rng.randrange(turns + 1))]
    return rows


@pytest.mark.parametrize("tasks", [1, 7, 40])
def test_nodes_over_any_number_of_trees(spark, parts, tasks):
    parts(tasks)
    rows = random_rows(tasks, 60, 5, ["a", "bé", "日本 c"])
    rows += [(100 + c, t, "user", "same") for c in range(30) for t in range(3)]
    rows += [(200 + c, t, "user", f"hot opening {min(t, 1) * c}") for c in range(40) for t in range(2)]
    lists = brute_lists(rows)
    assert found(pt.prefix_nodes(pt.turn_lists(table(spark, rows)))) == brute_nodes(lists)


def test_rebuilt_openings_and_odd_rows(spark, parts):
    parts(9)
    long = "word " * 40_000
    rows = random_rows(3, 50, 9, ["x", "y", ""]) + [
        (60, None, None, None), (60, None, "user", None), (60, 1, "user", long), (61, 5, "user", long), (61, 5, "user", long),
        (63, 2, "b", "tie"), (63, 2, "a", "tie"), (None, 0, "user", "no conversation"), (70, 0, "user", "alone"), (74, 0, "user", "short"),
        (2**40, 0, "user", "far"), (2**40 + 1, 0, "us", "erfar"),
    ]
    # Turns of equal number follow their ids, not their texts: put the brute-force rows in that order.
    ids = {r: hashlib.sha256(f"{len(r[2] or '')}:{r[2] or ''}{r[3] or ''}".encode()).digest()[:16] for r in rows}
    tied = [r for r in rows if r[0] in (60, 63)]
    ordered = [r for r in rows if r not in tied]
    for at, r in enumerate(sorted(tied, key=lambda r: (r[0], r[1] is not None, r[1] or 0, ids[r]))):
        ordered.append((r[0], at, r[2], r[3]))
    lists = brute_rebuilt(brute_lists(ordered))
    assert any(not t for t in lists.values())
    assert found(pt.prefix_nodes(pt.rebuilt(pt.turn_lists(table(spark, rows))))) == brute_nodes(lists)


def test_long_conversations_do_not_recurse(spark, parts):
    parts(3)
    rows = [(c, t, "user", f"turn {t if t < 700 * c else -t}") for c in range(4) for t in range(3000)]
    assert found(pt.prefix_nodes(pt.turn_lists(table(spark, rows)))) == brute_nodes(brute_lists(rows))


def test_no_conversations(spark):
    assert found(pt.prefix_nodes(pt.rebuilt(pt.turn_lists(table(spark, []))))) == []


def test_radix_nodes_grow_and_split():
    rng = random.Random(5)
    keys = sorted({bytes(rng.choice([rng.randrange(256), 7]) for _ in range(rng.randrange(0, 5))) for _ in range(3000)})
    root = pt.Node(b"")
    for k in rng.sample(keys, len(keys)):
        pt.insert(root, k, k)
    rooms, back, stack = set(), [], [root]
    while stack:
        node = stack.pop()
        rooms.add(node.room)
        if node.end is not None:
            back.append(node.end)
        kids = list(node.items())
        assert [b for b, _ in kids] == sorted(b for b, _ in kids)
        assert all(node.child(b) is k for b, k in kids)
        stack += [k for _, k in kids]
    assert sorted(back) == keys and rooms == {4, 16, 48, 256}
