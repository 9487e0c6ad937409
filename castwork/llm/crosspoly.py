"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables.

Vectors are scaled to unit length, turned by fast Hadamard pseudo-rotations (random signs and a Walsh-Hadamard
transform, three times) and hashed to the nearest signed axis, `functions` hashes to a code, in `tables` tables.
Every vector is indexed once in each table; a query probes the codes nearest to its rotated point in every table;
candidates are reranked by their exact Euclidean distance in double precision on the original vectors. The number
of probes is fitted for each length of vectors on a bounded sample of that length (at most about SAMPLE vectors,
QUERIES of them as queries) to reach TARGET recall against brute force there; neighbours in the whole table are nearer than in a sample, so recall only gains.

Equal vectors are one class, indexed once, with the k + 1 smallest ids (more cannot be among the nearest k besides
the query). Buckets larger than BUCKET are split, and probes go to all parts, so a crowded bucket is never one
task's. Each part returns its nearest k + 1 for a query, from which the nearest overall are taken: no cap is lossy.
A query that finds fewer than k candidates while there are more probes every code of one table, which is exact.

Vectors null, empty, zero or with null or non-finite components, and rows with a null id, take no part. Vectors of
different lengths are compared with their own length only. A repeated id counts once, at its nearest vector.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ship, written

TABLES = 4
SAMPLE = 16384
QUERIES = 200
TARGET = 0.97
BUCKET = 8192


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the rows (length a power of two), orthonormal."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, -1, 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def axes(x: np.ndarray, table: int, function: int) -> np.ndarray:
    """(n, 2d) inner products of the rotated unit vectors with the signed axes."""
    x = x.astype(np.float64)
    big = np.abs(x).max(1, keepdims=True)
    x = x / big  # before squares can overflow
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    d = 1 << max(0, (x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, d - x.shape[1])))
    rng = np.random.Generator(np.random.PCG64([7, table, function, d]))
    for _ in range(3):
        x = hadamard(x * (rng.integers(0, 2, d) * 2 - 1))
    return np.concatenate([x, -x], 1)


def codes(x: np.ndarray, table: int, functions: int) -> np.ndarray:
    out = np.zeros(len(x), np.int64)
    for f in range(functions):
        z = axes(x, table, f)
        out = out * z.shape[1] + z.argmax(1)
    return out


def probes(x: np.ndarray, table: int, functions: int, count: int) -> np.ndarray:
    """(n, up to count) codes for each query, the likeliest first: least loss against the nearest axes."""
    loss, code = np.zeros((len(x), 1)), np.zeros((len(x), 1), np.int64)
    for f in range(functions):
        z = axes(x, table, f)
        own = (z.max(1, keepdims=True) - z) ** 2
        both = (loss[:, :, None] + own[:, None, :]).reshape(len(x), -1)
        names = (code[:, :, None] * z.shape[1] + np.arange(z.shape[1])).reshape(len(x), -1)
        keep = np.argsort(both, 1, kind="stable")[:, :count]
        loss, code = np.take_along_axis(both, keep, 1), np.take_along_axis(names, keep, 1)
    return code


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.sqrt(((x.astype(np.float64) - q.astype(np.float64)) ** 2).sum(1))


def _axes_count(dim: int) -> int:
    return 2 * (1 << max(0, (dim - 1).bit_length()))


def fit_probes(x: np.ndarray, k: int, tables: int, functions: int) -> int:
    """Least number of probes that reaches TARGET recall among the sample's own vectors."""
    if len(x) < 2:
        return 1
    queries = x[:: max(1, len(x) // QUERIES)][:QUERIES]
    every = _axes_count(x.shape[1]) ** functions
    near = np.stack([np.argsort(distances(x, q), kind="stable")[: k + 1] for q in queries])
    rank = np.full(near.shape, every)  # the probe that first finds a neighbour
    for t in range(tables):
        c = np.concatenate([codes(x[i : i + 2048], t, functions) for i in range(0, len(x), 2048)])
        order = probes(queries, t, functions, every if functions == 1 else 4096)
        for i in range(len(queries)):
            place = {p: r for r, p in enumerate(order[i].tolist())}
            rank[i] = np.minimum(rank[i], [place.get(y, every) for y in c[near[i]].tolist()])
    ranks = np.sort(rank[:, 1:].ravel())
    return int(min(every, ranks[min(len(ranks) - 1, int(np.ceil(TARGET * len(ranks))))] + 1)) if len(ranks) else 1


def _by_length(ids: list, vectors: list) -> Iterator[tuple[list, np.ndarray]]:
    by: dict[int, list[int]] = {}
    for i, v in enumerate(vectors):
        by.setdefault(len(v), []).append(i)
    for rows in by.values():
        yield [ids[i] for i in rows], np.array([vectors[i] for i in rows], np.float64)


def nearest(vectors: DataFrame, *, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding", tables: int = TABLES) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by `every`, its k nearest other rows."""
    spark = vectors.sparkSession
    ship(spark)
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(
        F.col("id").isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & (F.abs(c) < F.lit(float("inf")))) & F.exists(v, lambda c: c != 0))
    rows = written(rows.distinct(), "vectors")
    order = Window.partitionBy("v").orderBy("id")
    firsts = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    asked = rows.where(F.col("id") % every == 0).select("v").distinct().withColumn("asked", F.lit(True))
    classes = written(firsts.join(asked, "v", "left").select(F.col("ids")[0].alias("class"), "ids", "v", F.coalesce("asked", F.lit(False)).alias("asked")), "classes")
    by_dim = written(classes.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.sum(F.size("ids")).alias("there")), "lengths")
    functions = {r.dim: max(1, int(np.ceil(np.log(max(2, r.n / BUCKET)) / np.log(_axes_count(r.dim))))) for r in by_dim.collect()}  # a row for each length
    if not functions:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")

    def fit(key: tuple, t: pa.Table) -> pa.Table:
        d = key[0].as_py()
        x = t.sort_by("class").column("v").combine_chunks().flatten().to_numpy().reshape(-1, d)
        return pa.table({"dim": pa.array([d], pa.int32()), "count": pa.array([fit_probes(x, k, tables, functions[d])], pa.int64())})

    sample = classes.withColumn("dim", F.size("v")).join(F.broadcast(by_dim), "dim").where(F.pmod(F.xxhash64("class"), F.ceil(F.col("n") / SAMPLE)) == 0)
    counts = {r.dim: r["count"] for r in sample.select("dim", "class", "v").groupBy("dim").applyInArrow(fit, "dim int, count bigint").collect()}

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for members, x in _by_length(list(zip(*(b.column(n).to_pylist() for n in ("class", "ids")), strict=True)), b.column("v").to_pylist()):
                for t in range(tables):
                    c = codes(x, t, functions[x.shape[1]])
                    for code in np.unique(c).tolist():
                        at = np.flatnonzero(c == code).tolist()
                        yield _entry([(t, x.shape[1], code, [members[i][1] for i in at], x[at].tobytes(), len(at))])

    def _entry(rows: list[tuple]) -> pa.RecordBatch:
        t, dim, code, ids, data, n = zip(*rows, strict=True)
        return pa.record_batch([pa.array(t, pa.int32()), pa.array(dim, pa.int32()), pa.array(code, pa.int64()), pa.array(ids, pa.list_(pa.list_(pa.int64()))),
                                pa.array(data, pa.binary()), pa.array(n, pa.int32())], names=["t", "dim", "code", "ids", "data", "n"])

    entries = written(classes.select("class", "ids", "v").mapInArrow(index, "t int, dim int, code bigint, ids array<array<bigint>>, data binary, n int"), "index")
    # Running totals inside a code split it into parts of about BUCKET vectors; entries hold a batch's share at most.
    sizes = entries.groupBy("t", "dim", "code").agg(F.sum("n").alias("total")).withColumn("parts", F.ceil(F.col("total") / BUCKET).cast("int"))
    sizes = written(sizes, "sizes")
    placed = entries.join(sizes.select("t", "dim", "code", "parts"), ["t", "dim", "code"]).withColumn("part", F.pmod(F.xxhash64("data"), F.col("parts")).cast("int")).drop("parts")

    def search(asking: DataFrame, tables: int, counts: dict[int, int] | None) -> DataFrame:
        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for ids, x in _by_length(b.column("class").to_pylist(), b.column("v").to_pylist()):
                    fs = functions[x.shape[1]]
                    for t in range(tables):
                        p = probes(x, t, fs, counts.get(x.shape[1], 1) if counts is not None else _axes_count(x.shape[1]) ** fs)
                        order = np.argsort(p.ravel(), kind="stable")
                        code, first = np.unique(p.ravel()[order], return_index=True)
                        rows = [(t, x.shape[1], int(c), [[ids[i // p.shape[1]]] for i in o.tolist()], x[o // p.shape[1]].tobytes(), len(o)) for c, o in zip(code, np.split(order, first[1:]), strict=True)]
                        for i in range(0, len(rows), 64):
                            yield _entry(rows[i : i + 64])

        sent = asking.mapInArrow(probe, "t int, dim int, code bigint, ids array<array<bigint>>, data binary, n int")
        sent = sent.join(sizes.select("t", "dim", "code", "parts"), ["t", "dim", "code"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        keys = ["t", "dim", "code", "part"]

        def rerank(members: pa.Table, queries: pa.Table) -> pa.Table:
            out: tuple[list, list, list] = ([], [], [])
            if members.num_rows and queries.num_rows:
                dim = members.column("dim")[0].as_py()
                x = np.frombuffer(b"".join(members.column("data").to_pylist())).reshape(-1, dim)
                ids = [i for e in members.column("ids").to_pylist() for i in e]
                for e, data in zip(queries.column("ids").to_pylist(), queries.column("data").to_pylist(), strict=True):
                    for (qc,), q in zip(e, np.frombuffer(data).reshape(-1, dim), strict=True):
                        s = distances(x, q)
                        if len(s) > k + 1:  # all that tie with the last are kept until ids decide
                            at = np.flatnonzero(s <= np.partition(s, k)[k])
                        else:
                            at = np.arange(len(s))
                        best = sorted((s[j], i) for j in at.tolist() for i in ids[j])[: k + 1]
                        out[0].extend([qc] * len(best))
                        out[1].extend(i for _, i in best)
                        out[2].extend(float(y) for y, _ in best)
            return pa.table({"class": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

        found = placed.where(F.col("t") < tables).groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(rerank, "class bigint, vec_id bigint, score double")
        best = found.groupBy("class", "vec_id").agg(F.min("score").alias("score"))
        ranked = Window.partitionBy("class").orderBy("score", "vec_id")
        return best.withColumn("n", F.row_number().over(ranked)).where(F.col("n") <= k + 1).drop("n")

    asking = classes.where("asked").select("class", "v")
    found = written(search(asking, tables, counts), "found")
    got = found.groupBy("class").agg(F.count("*").alias("got"))
    short = asking.join(got, "class", "left").join(by_dim.select("dim", "there"), F.size("v") == F.col("dim")).where(F.coalesce("got", F.lit(0)) < F.least(F.lit(k + 1), "there")).select("class", "v")
    short = written(short, "short")
    if short.limit(1).count():
        found = found.join(short.select("class"), "class", "left_anti").unionByName(search(short, 1, None))
    queries = rows.where(F.col("id") % every == 0).join(classes.where("asked").select("class", "v"), "v").select(F.col("id").alias("query_id"), "class")
    ranked = Window.partitionBy("query_id").orderBy("score", "vec_id")
    pairs = queries.join(found, "class").where("query_id <> vec_id").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return pairs.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
