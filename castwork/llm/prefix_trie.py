"""Conversation prefix trie: adaptive radix trees over fixed-width big-endian turn ids.

A turn is named by the first 128 bits of the SHA-256 of its role and text, so a conversation is a byte string of 16
bytes a turn and a trie node a prefix of whole ids. Equal conversations are counted together first, the distinct keys
are range-partitioned and every task builds one adaptive radix tree (nodes of 4, 16, 48 and 256 slots that grow as
children come, compressed paths). Only byte depths that are a multiple of 16 emit a node; a split inside an id
belongs to the turn above it.

All of a node's keys are neighbours in key order. A node on the path of its task's first or last key may go on in
the next task and is *open*: its task emits what it saw of it, without other open nodes. All other nodes are done.
Open nodes are merged by the hash of their path. In the order of the whole trie an open node's subtree is one run of
open nodes, so the sums over it are differences of prefix sums over (task, path of the first or of the last key),
two totals a task. A first turn that a third of all conversations share is thus many tasks' work.

The members that end at a node are listed as text in blocks of 4,096 ids and hashed block after block as a stream.

Rows with a null conversation take no part. Null roles and texts are empty. Turns are ordered by number, null first;
turns of equal number by their id, repeated rows stay. Other columns are not read. Without conversations there is
no node, not even a root. A conversation is one row of about 24 bytes a turn, whatever the length of its texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, written

#: Bytes of a turn id.
WIDTH = 16
#: Bytes of keys that one tree is sized for.
TREE_BYTES = 2 << 20
#: Members of a node are listed in blocks of 2 to this power of ids.
MEMBER_BITS = 12

NOTHING = hashlib.sha256(b"").hexdigest()


class Node:
    """A radix node: the compressed path after its edge's byte, what ends here, and children in the smallest layout.

    4 and 16 slots: sorted labels beside the children. 48 slots: a 256-byte index of slots. 256: a slot a byte.
    """

    __slots__ = ("path", "end", "room", "labels", "kids")

    def __init__(self, path: bytes, end=None):
        self.path, self.end, self.room, self.labels, self.kids = path, end, 4, bytearray(), []

    def child(self, byte: int) -> Node | None:
        if self.room <= 16:
            at = self.labels.find(byte)
            return self.kids[at] if at >= 0 else None
        if self.room == 48:
            at = self.labels[byte]
            return self.kids[at - 1] if at else None
        return self.kids[byte]

    def add(self, byte: int, kid: Node) -> None:
        if self.room < 256 and len(self.kids) == self.room:
            self._grow()
        if self.room <= 16:
            at = sum(x < byte for x in self.labels)
            self.labels.insert(at, byte)
            self.kids.insert(at, kid)
        elif self.room == 48:
            self.kids.append(kid)
            self.labels[byte] = len(self.kids)
        else:
            self.kids[byte] = kid

    def _grow(self) -> None:
        had = list(self.items())
        self.room = {4: 16, 16: 48, 48: 256}[self.room]
        if self.room == 48:
            self.labels, self.kids = bytearray(256), [k for _, k in had]
            for at, (byte, _) in enumerate(had):
                self.labels[byte] = at + 1
        elif self.room == 256:
            self.labels, self.kids = bytearray(), [None] * 256
            for byte, kid in had:
                self.kids[byte] = kid

    def items(self) -> Iterator[tuple[int, Node]]:
        """Children in byte order."""
        if self.room <= 16:
            yield from zip(self.labels, self.kids, strict=True)
        elif self.room == 48:
            yield from ((b, self.kids[at - 1]) for b, at in enumerate(self.labels) if at)
        else:
            yield from ((b, k) for b, k in enumerate(self.kids) if k is not None)

    def split(self, at: int) -> None:
        """Cut the path: this node keeps its first `at` bytes, all the rest goes to a new child."""
        low = Node(self.path[at + 1 :], self.end)
        low.room, low.labels, low.kids = self.room, self.labels, self.kids
        byte, self.path, self.end = self.path[at], self.path[:at], None
        self.room, self.labels, self.kids = 4, bytearray(), []
        self.add(byte, low)


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def insert(root: Node, key: bytes, end) -> None:
    """Hang `end` at `key`; a key comes once."""
    node, at = root, 0
    while True:
        n = len(node.path)
        if not key.startswith(node.path, at):
            same = _common(node.path, key[at : at + n])
            node.split(same)
            n = same
        at += n
        if at == len(key):
            node.end = end
            return
        kid = node.child(key[at])
        if kid is None:
            node.add(key[at], Node(key[at + 1 :], end))
            return
        node, at = kid, at + 1


def _path_hashes(key: bytes) -> list[bytes]:
    h, out = hashlib.sha256(), [hashlib.sha256().digest()[:WIDTH]]
    for i in range(0, len(key), WIDTH):
        h.update(key[i : i + WIDTH])
        out.append(h.digest()[:WIDTH])
    return out


class _Visit:
    """A node being walked: where it lies, its turn-aligned prefixes, and the sums over the children seen so far."""

    __slots__ = ("node", "above", "state", "start", "stop", "hashes", "todo", "n", "conv", "sizes", "kids", "leaves", "saved")

    def __init__(self, node: Node, edge: bytes, above: _Visit | None):
        self.node, self.above, path = node, above, edge + node.path
        self.start = above.stop if above else 0
        self.stop = self.start + len(path)
        self.state = above.state.copy() if above else hashlib.sha256()
        self.hashes, done = [], 0  # of the prefixes that end at a whole turn within this node's bytes
        for depth in range(self.start // WIDTH + 1, self.stop // WIDTH + 1):
            cut = depth * WIDTH - self.start
            self.state.update(path[done:cut])
            self.hashes.append(self.state.digest()[:WIDTH])
            done = cut
        self.state.update(path[done:])
        self.todo = node.items()
        self.n, self.conv, self.sizes = 0, None, None
        self.kids, self.leaves, self.saved = [], 0, 0
        if node.end:
            self.sizes, self.n, self.conv, _ = node.end

    def take(self, other: _Visit) -> None:
        self.n += other.n
        self.conv = other.conv if self.conv is None else min(self.conv, other.conv)
        self.sizes = other.sizes if self.sizes is None else self.sizes
        self.kids += other.kids
        self.leaves += other.leaves
        self.saved += other.saved

    def last_hash(self) -> bytes | None:
        """Hash of the deepest whole-turn prefix at or above the end of this node."""
        at = self
        while at is not None and not at.hashes:
            at = at.above
        return at.hashes[-1] if at else None


#: Columns of the table that trees write; `open` rows carry parts to be merged.
PART_SCHEMA = (
    "open boolean, part int, first boolean, last boolean, path binary, parent binary, depth long, conv_id long, parent_conv_id long,"
    " n_convs long, n_children long, n_leaves long, saved_tokens long, bytes long, ends_sha256 string"
)


def tree_rows(root: Node, first: bytes, last: bytes, part: int) -> dict[str, list]:
    """Rows of PART_SCHEMA of one tree whose keys run from `first` to `last`, as columns."""
    names = [c.split()[0] for c in PART_SCHEMA.split(",")]
    out = {c: [] for c in names}
    on_first, on_last = _path_hashes(first), _path_hashes(last)
    root_visit = _Visit(root, b"", None)
    root_visit.hashes = [on_first[0]]
    stack = [root_visit]
    while stack:
        v = stack[-1]
        step = next(v.todo, None)
        if step is not None:
            stack.append(_Visit(step[1], bytes([step[0]]), v))
            continue
        stack.pop()
        up = v.above.last_hash() if v.above else None
        depth = v.stop // WIDTH
        for i in range(len(v.hashes) - 1, -1, -1):
            path, parent = v.hashes[i], v.hashes[i - 1] if i else up
            size = v.sizes[depth - 1] if depth else 0
            at_first = depth < len(on_first) and on_first[depth] == path
            at_last = depth < len(on_last) and on_last[depth] == path
            own = (v.n - 1) * size
            if at_first or at_last:
                n_children = sum(not out["open"][k] for k in v.kids)
            else:
                n_children = len(v.kids)
                v.leaves, v.saved = v.leaves if v.kids else 1, v.saved + own
                for k in v.kids:
                    out["parent_conv_id"][k] = v.conv
            ends = v.node.end[3] if v.node.end and depth * WIDTH == v.stop else NOTHING
            row = (at_first or at_last, part, at_first, at_last, path, parent, depth, v.conv, None, v.n, n_children, v.leaves, v.saved, size, ends)
            for c, x in zip(names, row, strict=True):
                out[c].append(x)
            v.kids = [len(out["open"]) - 1]
            depth -= 1
        if v.above:
            v.above.take(v)
    return out


def turn_lists(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id and `turns`, its turns in order: array of (id, bytes of the text). Only hashes of texts are shuffled."""
    role_, text_ = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    name = F.concat(F.octet_length(role_).cast("string"), F.lit(":"), role_, text_)
    rows = conversations.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), F.unhex(F.substring(F.sha2(name, 256), 1, 2 * WIDTH)).alias("id"), F.octet_length(text_).cast("long").alias("bytes")).alias("t"),
    )
    lists = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return lists.select("conv_id", F.transform("t", lambda x: F.struct(x["id"].alias("id"), x["bytes"].alias("bytes"))).alias("turns"))


def _keys(lists: DataFrame) -> DataFrame:
    """conv_id, key, sizes of the texts, and the hash of the whole path, in the shared folder."""
    keys = lists.select(
        "conv_id",
        F.unhex(F.array_join(F.transform("turns", lambda x: F.hex(x["id"])), "")).alias("key"),
        F.transform("turns", lambda x: x["bytes"]).alias("sizes"),
    )
    return written(keys.select("*", F.unhex(F.substring(F.sha2("key", 256), 1, 2 * WIDTH)).alias("path")), "keys")


def _ends(keys: DataFrame) -> DataFrame:
    """path and the SHA-256 of its conversations' ids, ascending, comma-joined."""
    blocks = keys.groupBy("path", F.shiftright("conv_id", MEMBER_BITS).alias("block")).agg(
        F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for b in batches:
            paths, shas = [], []
            for path, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if path != at:
                    if state is not None:
                        paths.append(at)
                        shas.append(state.hexdigest())
                    at, state = path, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.record_batch([pa.array(paths, pa.binary()), pa.array(shas, pa.string())], names=["path", "ends_sha256"])
        if state is not None:
            yield pa.record_batch([pa.array([at], pa.binary()), pa.array([state.hexdigest()])], names=["path", "ends_sha256"])

    dealt = blocks.repartition("path").sortWithinPartitions("path", "block")
    return dealt.select("path", "ids").mapInArrow(run, "path binary, ends_sha256 string")


def _trees(keys: DataFrame) -> DataFrame:
    """Rows of PART_SCHEMA of all trees, in the shared folder."""
    spark = keys.sparkSession
    ship(spark)
    held = keys.agg(F.sum(F.octet_length("key"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-held // TREE_BYTES))
    distinct = keys.groupBy("path", "key", "sizes").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id"))
    dealt = distinct.join(_ends(keys), "path").select("key", "sizes", "n", "conv_id", "ends_sha256")
    dealt = dealt.repartitionByRange(parts, "key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, first, last = Node(b""), None, None
        for b in batches:
            for key, *end in zip(*(c.to_pylist() for c in b.columns), strict=True):
                insert(root, key, end)
                first, last = key if first is None else first, key
        if first is None:
            return
        columns = tree_rows(root, first, last, TaskContext.get().partitionId())
        yield from pa.table(columns, schema=schema).to_batches(max_chunksize=1 << 14)

    schema = pa.schema([(c.split()[0], _ARROW[c.split()[1]]) for c in PART_SCHEMA.split(",")])
    return written(dealt.mapInArrow(run, PART_SCHEMA), "trees")


_ARROW = {"boolean": pa.bool_(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}


def _settled(parts: DataFrame) -> DataFrame:
    """The open nodes, merged over their tasks, with whole subtree sums.

    `side` is 0 for nodes on the path of the first key of the task they start in, else 1. Ordered by (task, side,
    depth) the open nodes are in trie order, and a subtree goes on to the end of a side of the node's last task: to
    the end of side 1 if the node is on the path of that task's last key, else of side 0.
    """
    side = F.when(F.col("first"), 0).otherwise(1)
    merged = parts.groupBy("path", "parent", "depth", "bytes").agg(
        F.min("part").alias("start"), F.max("part").alias("stop"), F.min_by(side, "part").alias("side"),
        F.when(F.max_by("last", "part"), 1).otherwise(0).alias("stop_side"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("done_children"), F.sum("n_leaves").alias("done_leaves"), F.sum("saved_tokens").alias("done_saved"),
        # A key lies in one task, so at most one part knows of members that end here.
        F.coalesce(F.max(F.when(F.col("ends_sha256") != NOTHING, F.col("ends_sha256"))), F.lit(NOTHING)).alias("ends_sha256"),
    )
    open_kids = merged.where("parent is not null").groupBy(F.col("parent").alias("path")).agg(F.count(F.lit(1)).alias("open_children"))
    nodes = merged.join(open_kids, "path", "left").withColumn("n_children", F.col("done_children") + F.coalesce("open_children", F.lit(0)))
    nodes = nodes.withColumn("leaf", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long")).withColumn("own", (F.col("n_convs") - 1) * F.col("bytes"))
    nodes = written(nodes, "open")

    totals = nodes.groupBy(F.col("start").alias("at"), F.col("side").alias("at_side")).agg(F.sum("leaf").alias("leaf"), F.sum("own").alias("own"))
    grid = parts.select(F.col("part").alias("at")).distinct().select("at", F.explode(F.array(F.lit(0), F.lit(1))).alias("at_side"))
    w = Window.orderBy("at", "at_side")  # two rows a task of the trees
    sums = grid.join(totals, ["at", "at_side"], "left").select(
        "at", "at_side", *(F.sum(F.coalesce(c, F.lit(0))).over(w).alias(f"{c}_to") for c in ("leaf", "own")),
        *((F.sum(F.coalesce(c, F.lit(0))).over(w) - F.coalesce(c, F.lit(0))).alias(f"{c}_from") for c in ("leaf", "own")),
    )
    inner = Window.partitionBy("start", "side").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(F.col("at").alias("start"), F.col("at_side").alias("side"), "leaf_from", "own_from")
    after = sums.select(F.col("at").alias("stop"), F.col("at_side").alias("stop_side"), "leaf_to", "own_to")
    within = {c: F.coalesce(F.sum(c).over(inner), F.lit(0)) for c in ("leaf", "own")}
    ahead = nodes.withColumns({f"{c}_ahead": x for c, x in within.items()})
    whole = ahead.join(before, ["start", "side"]).join(after, ["stop", "stop_side"])
    return whole.select(
        "path", "parent", "depth", "conv_id", "n_convs", "n_children",
        (F.col("done_leaves") + F.col("leaf_to") - F.col("leaf_from") - F.col("leaf_ahead")).alias("n_leaves"),
        (F.col("done_saved") + F.col("own_to") - F.col("own_from") - F.col("own_ahead")).alias("saved_tokens"), "ends_sha256",
    )


NODE_COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "path")


def prefix_nodes(lists: DataFrame) -> DataFrame:
    """A row per node of the trie over `turn_lists`: conv_id (smallest member), depth, parent_conv_id, n_convs (members),
    n_children, n_leaves (childless nodes in the subtree), saved_tokens (over the subtree, bytes of a node's last text
    times its members but one), ends_sha256 (members that end here) and path (128-bit hash that names the node).

    Keys, trees and open nodes are written to the shared folder while the frame is being built."""
    trees = _trees(_keys(lists))
    parts = trees.where("open")
    opened = written(_settled(parts), "settled")
    whose = opened.select(F.col("path").alias("parent"), F.col("conv_id").alias("of_parent"))
    top = opened.join(whose, "parent", "left").withColumn("parent_conv_id", F.col("of_parent"))
    done = trees.where("not open")
    # A finished child of an open node: its parent's smallest member is known only now. By task, so that no parent is hot.
    here = parts.select("part", F.col("path").alias("parent")).join(whose, "parent")
    hung = done.where("parent_conv_id is null").drop("parent_conv_id").join(here.withColumnRenamed("of_parent", "parent_conv_id"), ["part", "parent"])
    known = done.where("parent_conv_id is not null")
    return known.select(*NODE_COLUMNS).unionByName(hung.select(*NODE_COLUMNS)).unionByName(top.select(*NODE_COLUMNS))


def rebuilt(lists: DataFrame, family: int = 5, modulus: int = 9) -> DataFrame:
    """`turn_lists` in which every conversation c opens with the first h turns of conversation c - c % family (all if
    fewer, none if it is not there), followed by its own turns after its first h; h = crc32(decimal c) % modulus.

    The conversations of a family meet by one shuffle of turn ids; a family has at most 2 * family - 1 members."""
    c, h = F.col("conv_id"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % modulus).cast("int")
    lead = lists.where(c % family == 0).select(c.alias("first_id"), F.slice("turns", 1, modulus - 1).alias("lead"))
    joined = lists.withColumn("first_id", c - c % family).join(lead, "first_id", "left")
    opening = F.coalesce(F.slice("lead", F.lit(1), h), F.slice("turns", 1, 0))
    own = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    return joined.select("conv_id", F.concat(opening, own).alias("turns"))


#: Every number as a BIGINT; a prefix is the list of its turns. crc32 bit by bit, reflected polynomial 0xEDB88320.
SQL = """
    WITH t AS (SELECT conv_id, turn, {'r': coalesce(role, ''), 't': coalesce(text, '')} AS x FROM conversations WHERE conv_id IS NOT NULL),
         own AS (SELECT conv_id, list(x ORDER BY turn NULLS FIRST, x.r, x.t) AS xs FROM t GROUP BY conv_id),
         h AS (SELECT conv_id, xs, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ascii(substr(conv_id::VARCHAR, i::INTEGER, 1))::BIGINT)),
                   lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda y, i: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384::BIGINT) ELSE y >> 1 END)), 4294967295::BIGINT) % 9 AS h FROM own),
         built AS (SELECT h.conv_id, list_concat(coalesce(lead.xs[1:h.h], []), h.xs[h.h + 1:]) AS xs
                   FROM h LEFT JOIN own lead ON lead.conv_id = h.conv_id - h.conv_id % 5),
         p AS (SELECT conv_id, d, xs[1:d] AS k, d = len(xs) AS ends FROM built, unnest(range(0, len(xs) + 1)) u(d)),
         n AS (SELECT k, d, min(conv_id) AS conv_id, count(*) AS n_convs,
                      sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM p GROUP BY k, d),
         m AS (SELECT n.*, up.conv_id AS parent_conv_id, up.k AS up,
                      CASE WHEN n.d = 0 THEN 0 ELSE (n.n_convs - 1) * strlen(n.k[n.d].t) END AS own
               FROM n LEFT JOIN n up ON n.d > 0 AND up.d = n.d - 1 AND up.k = n.k[1:n.d - 1]),
         c AS (SELECT m.*, coalesce(x.kids, 0) AS kids FROM m LEFT JOIN (SELECT up, d, count(*) AS kids FROM m WHERE d > 0 GROUP BY up, d) x ON x.d = m.d + 1 AND x.up = m.k),
         s AS (SELECT a.k, a.d, count(*) FILTER (WHERE b.kids = 0) AS leaves, sum(b.own) AS saved FROM c a JOIN c b ON b.d >= a.d AND b.k[1:a.d] = a.k GROUP BY a.k, a.d)
    SELECT c.conv_id, c.d AS depth, c.parent_conv_id, c.n_convs, c.kids AS n_children, s.leaves AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, c.ends_sha256
    FROM c JOIN s ON s.k = c.k AND s.d = c.d
"""
