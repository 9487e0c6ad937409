"""Source divergence audit on run-length columns.

For each language the terms that enough of its documents use are the vocabulary; every (language, source) group is a
column of counts over it. The vocabulary is reordered by its whole rows of counts, so that terms which every source
uses equally often are neighbours: equal rows become one row with a length, and neighbouring rows agree in most
columns. Blocks of this order are run-length encoded column by column; for a pair of groups the run boundaries are
intersected and the divergence f of two counts is multiplied by the length of the run, zeros included.

    p = 1 + floor(10^9 (count + 2) / (N + 2 V)),  f = floor((p - q)^2 / (p + q))

for V terms in the vocabulary and N words of the group among them. All arithmetic is on integers.

Texts are split where they lie, with counts combined in the task; what is shuffled is a row per (language, source,
term) and task. No task holds a language or a source: blocks are ranges of the vocabulary, pairs are worked out for
64 x 64 sources of a block at a time, and the joins of a hot group's terms to its totals are salted. Sums of pairs are
combined before they are shuffled; the pairs themselves are the result.

Null and empty texts make a group and no terms; null languages and sources are ''. Every row is a document, repeated
ones too. Other columns are not read. A language without vocabulary has value 0 for its pairs; a language of one
source has none. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, slices, written

SCALE = 1_000_000_000
#: Distinct (group, term) counts that a task holds before it sends them on.
HELD_TERMS = 1 << 18
#: Sources on each side of a tile of pairs.
TILE = 64
#: Parts of a group where its terms meet its totals.
SALTS = 16

#: Letters A-Z fold, other bytes below 0x80 that are no letters part words; bytes of longer characters stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, term, occ (occurrences) and docs (documents with it), combined. A null term counts the group."""
    ship(docs.sparkSession)
    names = ["lang", "source", "term", "occ", "docs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Counter, Counter, list]] = {}

        def emit() -> Iterator[pa.RecordBatch]:
            for (g, s), (occ, docs, n) in held.items():
                terms = pa.array([*occ, None], pa.binary()).cast(pa.string())
                size = len(occ) + 1
                counts = pa.array([*occ.values(), 0], pa.int64()), pa.array([*map(docs.__getitem__, occ), n[0]], pa.int64())
                yield pa.record_batch([pa.array([g] * size), pa.array([s] * size), terms, *counts], names=names)
            held.clear()

        size = 0
        for batch in batches:
            for b in slices(batch, 4 << 20, "_text"):
                for g, s, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    occ, docs, n = held.setdefault((g, s), (Counter(), Counter(), [0]))
                    n[0] += 1
                    if t:
                        words, had = t.translate(_FOLD).split(), len(occ)
                        occ.update(words)
                        docs.update(set(words))
                        size += len(occ) - had
                if size > HELD_TERMS:
                    yield from emit()
                    size = 0
        yield from emit()

    rows = docs.select(F.coalesce(lang, F.lit("")).alias("lang"), F.coalesce(source, F.lit("")).alias("source"), F.col(text).cast("binary").alias("_text"))
    parts = rows.mapInArrow(run, "lang string, source string, term string, occ long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("occ").alias("occ"), F.sum("docs").alias("docs"))


def vocabulary(counts: DataFrame, least_docs: int = 10) -> DataFrame:
    """lang, term, total and `row` (array of (source, occ), by source): the terms that enough documents use."""
    rows = counts.where("term is not null").groupBy("lang", "term").agg(
        F.sum("docs").alias("_docs"), F.sum("occ").alias("total"), F.sort_array(F.collect_list(F.struct("source", "occ"))).alias("row")
    )
    return rows.where(F.col("_docs") >= least_docs).drop("_docs")


def groups(counts: DataFrame, terms: DataFrame) -> DataFrame:
    """Every (lang, source): n (its words in the vocabulary), v (terms), lang_n, and place (by source)."""
    every = counts.where("term is null").select("lang", "source")
    own = terms.select("lang", F.explode("row").alias("x")).groupBy("lang", F.col("x.source").alias("source")).agg(F.sum("x.occ").alias("n"))
    whole = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("lang_n"))
    zero = F.lit(0).cast("long")
    joined = every.join(own, ["lang", "source"], "left").join(whole, "lang", "left")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1  # a row a source
    return joined.select("lang", "source", *(F.coalesce(c, zero).alias(c) for c in ("n", "v", "lang_n")), place.alias("place"))


def run_lengths(terms: DataFrame) -> DataFrame:
    """lang, block, source, lengths and counts: the reordered vocabulary's columns, run-length encoded block by block.
    A null source has the length of the whole block; a source that a block lacks is one run of zeros there."""
    spark = terms.sparkSession
    ship(spark)
    equal = terms.groupBy("lang", "total", "row").agg(F.count(F.lit(1)).alias("weight"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Ranges are cut by short keys (what Spark samples for them goes to the driver); rows order what lies in a range.
    ordered = equal.repartitionByRange(n, "lang", "total", F.xxhash64("row")).sortWithinPartitions("lang", "total", "row").drop("total")
    longs = pa.list_(pa.int64())
    names = ["lang", "block", "source", "lengths", "counts"]

    def encode(lang: str, block: int, weight: np.ndarray, rows: pa.ListArray) -> pa.RecordBatch:
        flat = rows.flatten()
        sources = flat.field("source").dictionary_encode()
        code, occ = sources.indices.to_numpy(), flat.field("occ").to_numpy()
        at = np.repeat(np.arange(len(rows)), np.diff(rows.offsets.to_numpy()))
        upto = np.r_[0, np.cumsum(weight)]
        by = np.argsort(code, kind="stable")
        cuts = np.searchsorted(code[by], np.arange(len(sources.dictionary) + 1))
        lengths, counts = [[int(upto[-1])]], [[0]]
        for i in range(len(sources.dictionary)):
            mine = by[cuts[i] : cuts[i + 1]]
            column = np.zeros(len(rows), np.int64)
            column[at[mine]] = occ[mine]
            starts = np.r_[0, np.flatnonzero(np.diff(column)) + 1]
            counts.append(column[starts])
            lengths.append(np.diff(upto[np.r_[starts, len(rows)]]))
        size = len(counts)
        source = pa.array([None, *sources.dictionary.to_pylist()], pa.string())
        return pa.record_batch([pa.array([lang] * size), pa.array([block] * size, pa.int64()), source, pa.array(lengths, longs), pa.array(counts, longs)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for b in batches:
            langs = b.column("lang").to_numpy(zero_copy_only=False)
            heads = np.flatnonzero(np.r_[True, langs[1:] != langs[:-1]]) if len(langs) else []
            for at, to in zip(heads, [*heads[1:], len(langs)], strict=True):
                part = b.slice(at, to - at)
                rows = pa.concat_arrays([part.column("row")])  # offsets from zero
                yield encode(langs[at], block, part.column("weight").to_numpy(), rows)
                block += 1

    return ordered.mapInArrow(run, "lang string, block long, source string, lengths array<long>, counts array<long>")


def shares(counts: np.ndarray, n: int, v: int) -> np.ndarray:
    """p of each count, exactly; Python's integers do the product, once a distinct count."""
    distinct, back = np.unique(counts, return_inverse=True)
    return np.array([1 + SCALE * (int(c) + 2) // (n + 2 * v) for c in distinct], np.int64)[back]


def run_divergence(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> int:
    """Sum of f over two columns given as (ends of runs, p of runs): boundaries intersected, f times length."""
    ends = np.union1d(a[0], b[0])
    p, q = a[1][np.searchsorted(a[0], ends)], b[1][np.searchsorted(b[0], ends)]
    return int(((p - q) ** 2 // (p + q) * np.diff(ends, prepend=0)).sum())


def pair_sums(columns: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, a, b (a before b) and value: sum of f over the vocabulary."""
    ship(columns.sparkSession)
    blocks = columns.where("source is null").select("lang", "block", F.element_at("lengths", 1).alias("size"))
    bare = totals.where("v = 0").select("lang").distinct().select("lang", F.lit(-1).cast("long").alias("block"), F.lit(0).cast("long").alias("size"))
    tiles = totals.withColumn("tile", F.expr(f"place div {TILE}"))
    tiles = tiles.withColumn("tiles", F.max("tile").over(Window.partitionBy("lang")) + 1)
    grid = blocks.unionByName(bare).join(tiles, "lang")
    cells = grid.join(columns.where("source is not null"), ["lang", "block", "source"], "left")
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    dealt = cells.withColumn("other", other).withColumns({"ta": F.least("tile", "other"), "tb": F.greatest("tile", "other")})
    dealt = dealt.select("lang", "block", "ta", "tb", "tile", "place", "source", "size", "n", "v", "lengths", "counts")

    def run(key: tuple, t: pa.Table) -> pa.Table:
        lang, ta, tb = key[0].as_py(), key[2].as_py(), key[3].as_py()
        cols = []
        for r in t.sort_by("place").select(["tile", "source", "size", "n", "v", "lengths", "counts"]).to_batches():
            for tile, source, size, n, v, lengths, counts in zip(*(c if c.type == longs else c.to_pylist() for c in r.columns), strict=True):
                ends = np.cumsum(lengths.values.to_numpy()) if lengths.is_valid else np.array([size])
                p = shares(counts.values.to_numpy() if counts.is_valid else np.zeros(1, np.int64), n, v) if size else np.zeros(1, np.int64)
                cols.append((tile, source, (ends, p), size))
        left = [c for c in cols if c[0] == ta]
        right = [c for c in cols if c[0] == tb]
        found = [(x[1], y[1], run_divergence(x[2], y[2]) if x[3] else 0) for i, x in enumerate(left) for y in (right if ta != tb else right[i + 1 :])]
        a, b, value = zip(*found, strict=True) if found else ((), (), ())
        return pa.table([pa.array([lang] * len(a), pa.string()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(value, pa.int64())], names=["lang", "a", "b", "value"])

    longs = pa.list_(pa.int64())
    parts = dealt.groupBy("lang", "block", "ta", "tb").applyInArrow(run, "lang string, a string, b string, value long")
    return parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def _share(count: Column, n: Column, v: Column) -> Column:
    """p in the JVM, exactly."""
    return F.lit(1) + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (count + 2).cast("decimal(20,0)"), (n + 2 * v).cast("decimal(20,0)"))


def term_values(terms: DataFrame, totals: DataFrame, most: int = 10) -> DataFrame:
    """lang, source, item, value, rank: the terms that a group uses most above its language."""
    used = terms.select("lang", "term", "total", F.explode("row").alias("x")).select("lang", "x.source", "term", "total", "x.occ")
    used = used.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int"))
    salted = totals.drop("place").withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    scored = used.join(salted, ["lang", "source", "salt"]).select(
        "lang", "source", F.col("term").alias("item"), _share(F.col("occ"), F.col("n"), F.col("v")).alias("p"), _share(F.col("total"), F.col("lang_n"), F.col("v")).alias("q")
    )
    value = F.expr("(p - q) * (p - q) div (p + q)")
    ranked = scored.where("p > q").select("lang", "source", "item", value.alias("value")).withColumn("rank", _rank())
    return ranked.where(F.col("rank") <= most)


def _rank() -> Column:
    return F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item").asc()))


def audit(docs: DataFrame, *, least_docs: int = 10, most: int = 10, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank: `pair` has every other source of the language by divergence, `term` the
    terms that set the group apart from its language. Counts, vocabulary, totals and columns are written to the shared
    folder while the frame is being built."""
    counts = written(term_counts(docs, text, lang, source), "counts")
    terms = written(vocabulary(counts, least_docs), "terms")
    totals = written(groups(counts, terms), "groups")
    columns = written(run_lengths(terms), "columns")
    sums = pair_sums(columns, totals)
    both = sums.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x"), "value")
    pairs = both.select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value").withColumn("rank", _rank())
    named = term_values(terms, totals, most).withColumn("part", F.lit("term"))
    return pairs.unionByName(named)


SQL = """
    WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                      regexp_extract_all(coalesce(text, ''), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS words FROM documents),
         t AS (SELECT id, lang, source, translate(unnest(words), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
         kept AS (SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
         tot AS (SELECT lang, count(*) AS v, sum(total)::BIGINT AS lang_n FROM kept GROUP BY lang),
         c AS (SELECT t.lang, t.source, t.term, count(*) AS occ FROM t JOIN kept USING (lang, term) GROUP BY t.lang, t.source, t.term),
         n AS (SELECT lang, source, sum(occ)::BIGINT AS n FROM c GROUP BY lang, source),
         g AS (SELECT x.lang, x.source, coalesce(n.n, 0) AS n, coalesce(tot.v, 0) AS v, coalesce(tot.lang_n, 0) AS lang_n
               FROM (SELECT DISTINCT lang, source FROM d) x LEFT JOIN n USING (lang, source) LEFT JOIN tot USING (lang)),
         p AS (SELECT g.lang, g.source, k.term, coalesce(c.occ, 0) AS occ,
                      (1 + 1000000000::HUGEINT * (coalesce(c.occ, 0) + 2) // (g.n + 2 * g.v)) AS p,
                      (1 + 1000000000::HUGEINT * (k.total + 2) // (g.lang_n + 2 * g.v)) AS q
               FROM g JOIN kept k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
         pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0)::BIGINT AS value
                  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
                  LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
                             FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source) x
                  ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
         term AS (SELECT lang, source, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM p WHERE occ > 0 AND p > q),
         ranked AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pair
                    UNION ALL
                    SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM term) WHERE rank <= 10)
    SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked
"""
