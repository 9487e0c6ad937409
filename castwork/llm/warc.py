"""WARC archives of pages, read back through an external index merge.

Writing: every page becomes a WARC/1.1 record; of records with equal payloads of at least `least` bytes the one with
the smallest page id is a response and the others are revisits of it (without payload). Records are put together
and written by Spark's own writer (record text, its last line end as the line separator, gzip), so archives can
be in any store Spark writes.

Reading: an archive is parsed by its Content-Length headers; response payloads are hashed again and checked. Each
archive gives one capture run, sorted locally by URL key (host names reversed), time and page id. Runs are cut at
range splitters (quantiles of regular samples of the runs), and each range merges its pieces of the runs with a
loser tree, which gives capture histories in global order: by range, then by position in it.

Nulls: html null is the empty payload; url null has no target header and the empty key; a null page id never wins a
group and is kept (null) throughout. Repeated rows of the smallest page id are all responses.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from bisect import bisect_right
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, ship, written

LEAST = 100
RECORDS_PER_FILE = 4096
RANGE_CAPTURES = 8192
RUN_SAMPLE = 256
EPOCH = 1577836800  # pages carry no time: captures are a second apart, by page id
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
NULL = "-"


def _urn(page_id: Column) -> Column:
    h = F.md5(F.concat(F.lit("page:"), F.coalesce(page_id.cast("string"), F.lit(NULL))).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), *[x for i, (a, n) in enumerate(((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) for x in ([F.lit("-")] if i else []) + [F.substring(h, a, n)]], F.lit(">"))


def write(pages: DataFrame, *, least: int = LEAST) -> str:
    """Write the archives of `pages` (page_id, url, html) into the shared folder; returns their path."""
    spark = pages.sparkSession
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256)).withColumn("bytes", F.octet_length("html").cast("bigint"))
    # Only payloads met more than once take part in the join, as a written table: it is small enough to be broadcast
    # as a rule, and beyond that the join of a crowded payload can be split (not so on top of an aggregate).
    firsts = rows.where(F.col("bytes") >= least).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = rows.join(written(firsts, "firsts"), "digest", "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    url = F.col("url")
    for c in "\r\n\t ":
        url = F.replace(url, F.lit(c), F.lit(f"%{ord(c):02X}"))
    when = F.date_format(F.timestamp_seconds(F.lit(EPOCH) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(10**10))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    block = F.when(revisit, F.lit(HTTP)).otherwise(F.concat(F.lit(HTTP), F.col("html")))
    head = [
        F.when(revisit, "WARC/1.1\r\nWARC-Type: revisit\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n")
        .otherwise("WARC/1.1\r\nWARC-Type: response\r\n"),
        F.lit("WARC-Record-ID: "), _urn(F.col("page_id")),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Refers-To: "), _urn(F.col("first_id")), F.lit("\r\nX-Refers-To-Page: "), F.col("first_id").cast("string"))).otherwise(""),
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), url), F.lit("")),
        F.lit("\r\nWARC-Date: "), when,
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("digest"),
        F.lit("\r\nX-Payload-Length: "), F.col("bytes").cast("string"),
        F.lit("\r\nX-Page: "), F.coalesce(F.col("page_id").cast("string"), F.lit(NULL)),
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"),
        F.lit("\r\n\r\n"), block, F.lit("\r\n"),
    ]
    path = f"{shared_dir(spark)}/castwork-{uuid.uuid4().hex}/warc"
    out = rows.select(F.concat(*head).alias("value"))
    out.write.option("compression", "gzip").option("lineSep", "\r\n").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)
    return path


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes, int]]:
    """(headers, block, offset) of the records of one uncompressed archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        head = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(head["content-length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) != size or data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"broken WARC record at byte {at}")
        yield head, block, at
        at = end + 8 + size


def url_key(url: str | None) -> str:
    """Sort key of a URL: host names reversed and comma-joined, then port, path and query."""
    if not url:
        return ""
    try:
        u = urlsplit(url)
        host = ",".join(reversed((u.hostname or "").split(".")))
        return f"{host}{f':{u.port}' if u.port else ''}){u.path.lower() or '/'}{f'?{u.query}' if u.query else ''}"
    except ValueError:
        return url.lower()


def loser_tree(runs: list[list]) -> Iterator:
    """Merge sorted runs: each inner node keeps the loser of its match, so an item costs one match a level."""
    k = len(runs)
    if not k:
        return
    end = object()
    its = [iter(r) for r in runs]
    head = [next(i, end) for i in its]

    def beats(a: int, b: int) -> bool:
        if head[a] is end or head[b] is end:
            return head[b] is end and (head[a] is not end or a < b)
        return head[a] < head[b] or (head[a] == head[b] and a < b)

    tree = [-1] * k  # 1..k-1: losers; 0: the winner
    winner = [0] * (2 * k)
    for i in range(k):
        winner[k + i] = i
    for i in range(k - 1, 0, -1):
        a, b = winner[2 * i], winner[2 * i + 1]
        winner[i], tree[i] = (a, b) if beats(a, b) else (b, a)
    tree[0] = winner[1] if k > 1 else 0
    while head[tree[0]] is not end:
        w = tree[0]
        yield head[w]
        head[w] = next(its[w], end)
        i = (k + w) // 2
        while i:
            if beats(tree[i], w):
                tree[i], w = w, tree[i]
            i //= 2
        tree[0] = w


CAPTURE = [("key", pa.string()), ("time", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
           ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("offset", pa.int64())]
CAPTURE_DDL = "key string, time string, page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string, offset bigint"
_RUN_DDL = ", ".join(f"{n} array<{t}>" for n, t in (x.split(" ") for x in CAPTURE_DDL.split(", ")))


def _sort_key(c: tuple) -> tuple:
    return c[0], c[1], c[2] is not None, c[2] or 0


def captures(spark: SparkSession, path: str) -> DataFrame:
    """All captures of the archives in global order: range, position, file and the capture's columns."""
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                out, http = [], HTTP.encode()
                data = gzip.decompress(b.column("content")[i].as_py())
                for head, block, at in parse(data):
                    digest, kind = head["warc-payload-digest"].removeprefix("sha256:"), head["warc-type"]
                    payload = block[len(http) :]
                    if kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != int(head["x-payload-length"])):
                        raise ValueError(f"payload of record at byte {at} does not match its digest")
                    page, url = head["x-page"], head.get("warc-target-uri")
                    out.append((url_key(url), head["warc-date"], None if page == NULL else int(page), int(head["x-payload-length"]), digest, kind,
                                int(head["x-refers-to-page"]) if "x-refers-to-page" in head else None, url, at))
                out.sort(key=_sort_key)
                cols = [pa.array([list(c)], pa.list_(t)) for c, (_, t) in zip(zip(*out, strict=True), CAPTURE, strict=True)] if out else [pa.array([[]], pa.list_(t)) for _, t in CAPTURE]
                yield pa.record_batch([b.column("path").slice(i, 1), *cols], names=["file", *(n for n, _ in CAPTURE)])

    run_table = written(files.mapInArrow(runs, f"file string, {_RUN_DDL}"), "runs")
    n = int(run_table.agg(F.sum(F.size("page_id"))).first()[0] or 0)
    n_ranges = max(16, -(-n // RANGE_CAPTURES))
    # Regular samples of the sorted runs, thinned to a number bounded by the ranges, give the splitters.
    step = F.greatest(F.lit(1), F.floor(F.size("page_id") / RUN_SAMPLE)).cast("int")
    points = run_table.select(F.explode(F.expr("filter(arrays_zip(key, time, page_id, sequence(0, greatest(0, size(page_id) - 1))), x -> x.page_id is not null or x.key is not null)")).alias("x"), step.alias("step"))
    points = points.where((F.expr("x['3']") % F.col("step")) == 0)
    total = points.count()
    thin = max(1, total // (64 * n_ranges))
    sample = sorted(_sort_key((r.k, r.t, r.p)) for r in points.where(F.pmod(F.xxhash64("x.key", "x.time", "x.page_id"), F.lit(thin)) == 0).select(
        F.col("x.key").alias("k"), F.col("x.time").alias("t"), F.col("x.page_id").alias("p")).collect())
    splitters = [sample[i * len(sample) // n_ranges] for i in range(1, n_ranges)] if sample else []

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                cols = [b.column(n)[i].as_py() for n, _ in CAPTURE]
                rows = list(zip(*cols, strict=True))
                at = [bisect_right(splitters, _sort_key(r)) for r in rows]
                cut = [j for j in range(len(at)) if j == 0 or at[j] != at[j - 1]] + [len(at)]
                for s, e in zip(cut[:-1], cut[1:], strict=True):
                    yield pa.record_batch([pa.array([at[s]], pa.int32()), b.column("file").slice(i, 1), *(pa.array([c[s:e]], pa.list_(t)) for c, (_, t) in zip(cols, CAPTURE, strict=True))],
                                          names=["range", "file", *(n for n, _ in CAPTURE)])

    def merge(t: pa.Table) -> pa.Table:
        t = t.sort_by("file")
        files = t.column("file").to_pylist()
        cols = [t.column(n).to_pylist() for n, _ in CAPTURE]
        each = [[(_sort_key(row), f, row) for row in zip(*(c[f] for c in cols), strict=True)] for f in range(len(files))]
        merged = list(loser_tree(each))
        out = {"range": pa.array([t.column("range")[0].as_py()] * len(merged), pa.int32()), "position": pa.array(range(len(merged)), pa.int64()),
               "file": pa.array([files[f] for _, f, _ in merged], pa.string())}
        rows = list(zip(*(r for _, _, r in merged), strict=True))
        return pa.table(out | {n: pa.array(rows[i], k) for i, (n, k) in enumerate(CAPTURE)})

    pieces = run_table.mapInArrow(segments, f"range int, file string, {_RUN_DDL}")
    return pieces.groupBy("range").applyInArrow(merge, f"range int, position bigint, file string, {CAPTURE_DDL}")


def round_trip(pages: DataFrame, *, least: int = LEAST) -> DataFrame:
    """Write the pages, read the archives back: the captures in global order."""
    return captures(pages.sparkSession, write(pages, least=least))
