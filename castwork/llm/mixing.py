"""Mixing sources to target weights by Sainte-Laguë apportionment.

The words of a source are laid end to end in shards and cut into equal blocks. Every shard has as many blocks to give
as its sources' targets add up to; they go to sources by the highest quotients votes / (2 * given + 1), a source's
votes being its part of the target. A source's quota of blocks in a shard is then taken: whole passes over its words
where the quota exceeds them, and for the rest blocks in the order of a seeded hash.

Targets: the weights share all words; a target stops at `most` times its source's words and the excess is shared by
weight again, until none is above. That is a water level, found by rounds of a one-row aggregate over the sources.

A source lies in as few shards as its words and rows need (so that its quotas lose nothing to rounding) and a large
one in all shards (so that none is hot). Rows that are wholly equal are counted together before any shuffle and dealt
out in runs of 1,024.

Null and empty texts have size 0 and nothing is taken of them. A null source is a source of its own, the last one.
Null and repeated ids stand for themselves; rows of equal id, source and size are interchangeable. Other columns are
not read. An empty table gives no rows. Texts are only counted, whole, a batch at a time.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from castwork.operators.ranks import numbered

from .common import mix as mixed_bits
from .common import ship, slices, written

#: Words of a block.
BLOCK = 64
#: Words and rows that a shard is sized for, and those of one source from which it takes a further shard.
SHARD_WORDS, SHARD_ROWS, PART_WORDS, PART_ROWS = 1 << 22, 1 << 15, 1 << 18, 1 << 13
#: Wholly equal rows that are dealt out together.
RUN = 1024
#: Parts that the rows of a source are split into where they meet its target.
SALTS = 16


def sized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source, size (words) and copies (rows that are equal in these)."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, 8 << 20, "_text"):
                n = [len(t.split()) if t else 0 for t in b.column("_text").to_pylist()]  # bytes: split at x20 and x09-x0D
                yield pa.record_batch([b.column(0), b.column(1), pa.array(n, pa.int64())], names=["doc_id", "source", "size"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(text).cast("binary").alias("_text"))
    schema = StructType(rows.schema.fields[:2]).add("size", LongType())
    return rows.mapInArrow(run, schema).groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("copies"))


def targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """`sources` (source, source_size, n_rows) with pos (place by code point, null last), weight and target."""
    ordered = written(numbered(sources, [F.col("source").asc_nulls_last()], "pos"), "sources")
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("pos") % len(weights) + 1).cast("int"))
    weighed = ordered.withColumn("weight", w.cast("long"))
    exact = lambda c: c.cast("decimal(38,0)")
    cap = F.col("source_size") * most
    total = int(ordered.agg(F.sum("source_size")).first()[0] or 0)
    held, left = 0, int(weighed.agg(F.sum("weight")).first()[0] or 0)  # words of the sources at their cap, weight of the others
    above: Column = F.lit(False)
    while left:
        above = exact(F.col("weight")) * F.lit(total - held).cast("decimal(19,0)") > exact(cap) * F.lit(left).cast("decimal(19,0)")
        row = weighed.agg(F.sum(F.when(above, cap).otherwise(0)), F.sum(F.when(above, 0).otherwise(F.col("weight")))).first()
        if (row[0], row[1]) == (held, left):
            break
        held, left = int(row[0]), int(row[1])
    even = (F.col("weight") * F.lit(total - held)).cast("double") / F.lit(float(left or 1))
    return weighed.withColumn("target", F.when(above if left else F.lit(True), cap.cast("double")).otherwise(even))


def sainte_lague(votes: list[float], seats: int, unit: float) -> list[int]:
    """Seats by the highest quotients votes / (2 * given + 1); of equal quotients the earlier one's comes first.

    Starts from the seats with a quotient of at least unit / 2 and adds or takes back the few that differ."""
    given = [math.floor(v / unit + 0.5) for v in votes]
    short = seats - sum(given)
    if short > 0:
        heap = [(-v / (2 * g + 1), i) for i, (v, g) in enumerate(zip(votes, given, strict=True)) if v > 0]
        heapq.heapify(heap)
        while short and heap:
            _, i = heap[0]
            given[i] += 1
            heapq.heapreplace(heap, (-votes[i] / (2 * given[i] + 1), i))
            short -= 1
    elif short < 0:
        heap = [(v / (2 * g - 1), -i) for i, (v, g) in enumerate(zip(votes, given, strict=True)) if g]
        heapq.heapify(heap)
        for _ in range(-short):
            i = -heapq.heappop(heap)[1]
            given[i] -= 1
            if given[i]:
                heapq.heappush(heap, (votes[i] / (2 * given[i] - 1), -i))
    return given


def _number(text: str) -> int:
    """The first 15 hex digits of the text's MD5."""
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def chosen(words: int, quota: int, block: int, key: str) -> tuple[int, np.ndarray]:
    """Whole passes over `words`, and the words taken once more from the head of each block: in the order of a hash
    seeded by `key`, until the quota is met."""
    passes, rest = divmod(quota, words)
    n = -(-words // block)
    size = np.full(n, block, np.int64)
    size[-1] = words - (n - 1) * block
    order = np.argsort(mixed_bits(np.arange(n, dtype=np.uint64) + np.uint64(_number(key))), kind="stable")
    before = np.cumsum(size[order]) - size[order]
    more = np.zeros(n, np.int64)
    more[order] = np.clip(rest - before, 0, size[order])
    return passes, more


def _shard(t: pa.Table, shard: int, most: int, block: int, seed: int) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray, dict]:
    """The shard's rows in the order in which they are laid end to end, their sizes, starts, words taken, and the
    passes and block heads by source."""
    t = t.sort_by([("pos", "ascending"), ("doc_id", "ascending"), ("size", "ascending"), ("run", "ascending")])
    nulls = t.column("doc_id").is_null().to_numpy()  # null ids come first
    t = t.take(np.lexsort((np.arange(t.num_rows), ~nulls, t.column("pos").to_numpy())))
    t = t.take(np.repeat(np.arange(t.num_rows), t.column("copies").to_numpy()))
    pos, size = t.column("pos").to_numpy(), t.column("size").to_numpy()
    heads = np.flatnonzero(np.r_[True, pos[1:] != pos[:-1]])
    words = np.add.reduceat(size, heads)
    goal, whole = t.column("target").to_numpy()[heads], t.column("source_size").to_numpy()[heads]
    votes = [g * float(w) / float(z) if w else 0.0 for g, w, z in zip(goal.tolist(), words.tolist(), whole.tolist(), strict=True)]
    seats = math.floor(math.floor(math.fsum(votes) + 0.5) / block + 0.5)
    start, taken, picks = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64), {}
    for at, to, w, k in zip(heads, np.r_[heads[1:], len(size)], words.tolist(), sainte_lague(votes, seats, block), strict=True):
        if not w:
            continue
        passes, more = chosen(w, min(k * block, most * w), block, f"{seed}:{shard}:{pos[at]}")
        upto = np.r_[0, np.cumsum(more)]
        end = np.cumsum(size[at:to])
        start[at:to] = end - size[at:to]
        def picked(x, more=more, upto=upto):  # words taken once more among the first x
            j = np.minimum(x // block, len(more) - 1)
            return upto[j] + np.minimum(more[j], x - j * block)
        taken[at:to] = passes * size[at:to] + picked(end) - picked(start[at:to])
        picks[int(pos[at])] = (passes, more)
    return t, size, start, taken, picks


def _spans(start: int, size: int, more: np.ndarray, block: int) -> list[dict]:
    """The parts of one document that are taken once more, by word, with the parts that touch joined."""
    out: list[dict] = []
    for j in range(start // block, -(-(start + size) // block)):
        a, b = max(start, j * block) - start, min(start + size, j * block + int(more[j])) - start
        if b <= a:
            continue
        if out and out[-1]["start"] + out[-1]["length"] == a:
            out[-1]["length"] += b - a
        else:
            out.append({"start": a, "length": b - a})
    return out


def mix(docs: DataFrame, *, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, block: int = BLOCK, seed: int = 17, spans: bool = False) -> DataFrame:
    """A row per document: doc_id, size (words), source_size, target (its source's), taken (words that the mix takes,
    repeats counted). With `spans` also passes (times the whole text is taken) and spans (start and length, in words,
    of what is taken once more). Sizes and targets are worked out while the frame is being built."""
    rows = written(sized(docs), "sizes")
    sources = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.sum("copies").alias("n_rows"))
    aims = written(targets(sources, weights, most), "targets")
    all_words, all_rows = aims.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("n_rows"), F.lit(0))).first()
    n_shards = max(1, -(-all_words // SHARD_WORDS), -(-all_rows // SHARD_ROWS))
    number = lambda c: F.conv(F.substring(F.md5(c.cast("binary")), 1, 15), 16, 10).cast("long")

    runs = rows.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {RUN}"))))
    runs = runs.withColumn("copies", F.least(F.lit(RUN), F.col("copies") - F.col("run") * RUN))
    name = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "size", "run", F.coalesce("source", F.lit("")))
    runs = runs.withColumn("h", number(name)).withColumn("salt", (F.col("h") % SALTS).cast("int"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("source_size") / PART_WORDS), F.ceil(F.col("n_rows") / PART_ROWS))
    aim = aims.select(F.col("source").alias("of"), "pos", "source_size", "target", F.least(F.lit(n_shards), parts).cast("long").alias("parts"))
    aim = aim.withColumn("salt_of", F.explode(F.array(*map(F.lit, range(SALTS)))))
    placed = runs.join(aim, F.col("source").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("salt_of")))
    first = number(F.concat_ws(":", F.lit(str(seed)), "pos"))
    placed = placed.withColumn("shard", (first % n_shards + F.col("h") % F.col("parts")) % n_shards)
    placed = placed.select("shard", "doc_id", "pos", "size", "run", "copies", "source_size", "target")

    fields = [f for f in placed.schema.fields if f.name in ("doc_id", "size", "source_size", "target")]
    schema = StructType(list(fields)).add("taken", LongType())
    if spans:
        part = StructType().add("start", LongType()).add("length", LongType())
        schema = schema.add("passes", LongType()).add("spans", ArrayType(part))

    def run(key: tuple, t: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        t, size, start, taken, picks = _shard(t, shard, most, block, seed)
        out = t.select([f.name for f in fields]).append_column("taken", pa.array(taken))
        if spans:
            pos = t.column("pos").to_pylist()
            of = [picks.get(p) for p in pos]
            out = out.append_column("passes", pa.array([p[0] if p and n else 0 for p, n in zip(of, size.tolist(), strict=True)], pa.int64()))
            parts = [_spans(a, n, p[1], block) if p and n else [] for p, a, n in zip(of, start.tolist(), size.tolist(), strict=True)]
            out = out.append_column("spans", pa.array(parts, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))))
        return out

    return placed.groupBy("shard").applyInArrow(run, schema)


#: The same mix in DuckDB: quotients are ranked one by one, blocks and documents meet block by block.
SQL = f"""
    WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
    s0 AS (SELECT source, sum(size)::BIGINT AS z, count(*) AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS pos FROM d GROUP BY source),
    s AS (SELECT *, [5, 2, 1][pos % 3 + 1] AS w, (SELECT sum(z) FROM s0)::BIGINT AS total FROM s0),
    level AS (
        SELECT 0 AS round, 0::BIGINT AS held, (SELECT sum(w) FROM s)::BIGINT AS free
        UNION ALL
        SELECT round + 1, held2, free2 FROM (
            SELECT l.round, l.held, l.free, sum(CASE WHEN s.w * (s.total - l.held) > 3 * s.z * l.free THEN 3 * s.z ELSE 0 END)::BIGINT AS held2,
                   sum(CASE WHEN s.w * (s.total - l.held) > 3 * s.z * l.free THEN 0 ELSE s.w END)::BIGINT AS free2
            FROM level l, s WHERE l.free > 0 GROUP BY l.round, l.held, l.free) WHERE held2 <> held OR free2 <> free),
    top AS (SELECT held, free FROM level ORDER BY round DESC LIMIT 1),
    aim AS (SELECT s.*, CASE WHEN top.free = 0 OR s.w * (s.total - top.held) > 3 * s.z * top.free THEN (3 * s.z)::DOUBLE
                             ELSE (s.w * (s.total - top.held))::DOUBLE / top.free::DOUBLE END AS target,
                   greatest(1, ceil((SELECT sum(z) FROM s) / {SHARD_WORDS}), ceil((SELECT sum(n) FROM s) / {SHARD_ROWS}))::BIGINT AS shards
            FROM s, top),
    r AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, source, size) - 1) // {RUN} AS run FROM d),
    placed AS (SELECT r.doc_id, r.size, r.run, a.pos, a.z, a.target,
                      (('0x' || substr(md5('17:' || a.pos), 1, 15))::BIGINT % a.shards
                       + ('0x' || substr(md5('17:' || coalesce(r.doc_id::VARCHAR, '') || ':' || r.size || ':' || r.run || ':' || coalesce(r.source, '')), 1, 15))::BIGINT
                         % least(a.shards, greatest(1, ceil(a.z / {PART_WORDS}), ceil(a.n / {PART_ROWS}))::BIGINT)) % a.shards AS shard
               FROM r JOIN aim a ON a.source IS NOT DISTINCT FROM r.source),
    laid AS (SELECT *, sum(size) OVER (PARTITION BY shard, pos ORDER BY doc_id NULLS FIRST, size, run ROWS UNBOUNDED PRECEDING)::BIGINT AS stop FROM placed),
    cell AS (SELECT shard, pos, sum(size)::BIGINT AS words, CASE WHEN sum(size) > 0 THEN any_value(target) * sum(size)::DOUBLE / any_value(z)::DOUBLE ELSE 0 END AS votes
             FROM placed GROUP BY shard, pos),
    house AS (SELECT shard, floor(floor(sum(votes) + 0.5) / {BLOCK} + 0.5)::BIGINT AS seats, count(*) AS n FROM cell GROUP BY shard),
    quot AS (SELECT c.shard, c.pos, h.seats, row_number() OVER (PARTITION BY c.shard ORDER BY c.votes / (2 * k + 1) DESC, c.pos) AS place
             FROM cell c JOIN house h USING (shard), unnest(range(0, floor(c.votes / {BLOCK})::BIGINT + h.n + 2)) u(k) WHERE c.votes > 0),
    quota AS (SELECT c.shard, c.pos, c.words, least({BLOCK} * count(q.place), 3 * c.words) AS quota
              FROM cell c LEFT JOIN quot q ON q.shard = c.shard AND q.pos = c.pos AND q.place <= q.seats WHERE c.words > 0 GROUP BY c.shard, c.pos, c.words),
    b0 AS (SELECT shard, pos, words, quota, j, least({BLOCK}, words - j * {BLOCK}) AS size,
                  (('0x' || substr(md5('17:' || shard || ':' || pos), 1, 15))::UBIGINT + j::UBIGINT)::UHUGEINT AS x0
           FROM quota, unnest(range(0, (words + {BLOCK} - 1) // {BLOCK})) u(j)),
    b1 AS (SELECT *, (xor(x0, x0 // 1073741824::UHUGEINT) * 13787848793156543929::UHUGEINT) % 18446744073709551616::UHUGEINT AS x1 FROM b0),
    b2 AS (SELECT *, (xor(x1, x1 // 134217728::UHUGEINT) * 10723151780598845931::UHUGEINT) % 18446744073709551616::UHUGEINT AS x2 FROM b1),
    b3 AS (SELECT *, xor(x2, x2 // 2147483648::UHUGEINT) AS x3 FROM b2),
    b AS (SELECT *, greatest(0, least(size, quota % words - (sum(size) OVER (PARTITION BY shard, pos ORDER BY x3, j ROWS UNBOUNDED PRECEDING) - size)))::BIGINT AS more FROM b3),
    part AS (SELECT l.*, row_number() OVER () AS id FROM laid l),
    hit AS (SELECT p.id, sum(greatest(0, least(p.stop, b.j * {BLOCK} + b.more) - greatest(p.stop - p.size, b.j * {BLOCK})))::BIGINT AS more
            FROM (SELECT id, shard, pos, size, stop, unnest(range((stop - size) // {BLOCK}, (stop - 1) // {BLOCK} + 1)) AS j FROM part WHERE size > 0) p
            JOIN b USING (shard, pos, j) GROUP BY p.id)
    SELECT p.doc_id, p.size, p.z AS source_size, p.target, CAST(coalesce(q.quota // q.words, 0) * p.size + coalesce(hit.more, 0) AS BIGINT) AS taken
    FROM part p LEFT JOIN quota q USING (shard, pos) LEFT JOIN hit USING (id)
"""
