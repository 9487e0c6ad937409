"""Relation browser (C01-C03): catalogue with exact row counts, columns,
and paging over an allowlist of relations.

The allowlist is the catalogue itself: a relation name that is not in it is
rejected before any Spark job runs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from castwork.operators import bridges
from castwork.operators.joins import prefix_join
from castwork.operators.pages import PageIndex
from castwork.sources.tables import SYSTEM_OF, TABLE_NAMES, Tables

MAX_LIMIT = 100
# Rows up to which a page is a top-k (every task keeps that many); deeper pages go through a rank index.
TOP_ROWS = 10_000
DEFAULT_LIMIT = 50

VIEWS: dict[str, Callable[[Tables], DataFrame]] = {
    "job_window": bridges.job_window,
    "job_pattern": bridges.job_pattern,
    "job_heat": bridges.job_heat,
    "job_board_item": bridges.job_board_item,
    "wc_tag_resolved": bridges.wc_tag_resolved,
    "match_rate": bridges.match_rate,
    "unmatched": bridges.unmatched,
}

def _samples_resolved(t: Tables) -> DataFrame:
    """Rows of wc_tag_resolved: each tag's samples times the prefixes that own it."""
    per_tag = t.tag_history.groupBy("tag_path").agg(F.count(F.lit(1)).alias("n"))
    return prefix_join(per_tag, "tag_path", t.wc_tag.select("wc_code", "tag_prefix", "signal_role")) \
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))


# Views with one row per job, samples counted per tag.
COUNTS: dict[str, Callable[[Tables], DataFrame]] = {
    "job_window": lambda t: t.job_head.agg(F.count(F.lit(1)).alias("rows")),
    "wc_tag_resolved": _samples_resolved,
    # A row a bridge, by construction.
    "match_rate": lambda t: t.part.sparkSession.range(1).select(F.lit(bridges.RATED_PAIRS).alias("rows")),
}

# Unique ordering key per relation, so a page is the same page every time.
PAGE_KEYS = {
    "part": ["part_num"], "work_center": ["wc_code"], "scrap_reason": ["reason_code"], "job_head": ["job_num"],
    "job_oper": ["job_num", "oper_seq"], "board_item": ["item_id"], "wc_tag": ["wc_code", "tag_prefix"],
    "part_pattern": ["part_num", "pattern_code"], "heat": ["heat_num"], "job_window": ["job_num"],
}


def relations(t: Tables) -> dict[str, tuple[str, str, DataFrame]]:
    """name -> (schema, kind, DataFrame)."""
    out = {n: (SYSTEM_OF[n], "table", df) for n, df in t.items()}
    for n, fn in VIEWS.items():
        out[n] = ("xref", "view", fn(t))
    return out


def catalog(t: Tables) -> DataFrame:
    """Every relation with its kind and exact row count (one union of
    count aggregates; Parquet tables answer from footers). A view whose count
    follows from less than its rows has its own count in ``COUNTS``."""
    parts = [(COUNTS[n](t) if k == "view" and n in COUNTS else df.agg(F.count(F.lit(1)).alias("rows"))).select(
        F.lit(s).alias("schema"), F.lit(n).alias("name"), F.lit(k).alias("kind"), F.col("rows").cast("bigint").alias("rows"))
        for n, (s, k, df) in relations(t).items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def columns(t: Tables, relation: str) -> list[tuple[str, str]]:
    """(name, type) in ordinal order."""
    rels = relations(t)
    if relation not in rels:
        raise KeyError(f'Unknown relation "{relation}".')
    return [(f.name, f.dataType.simpleString()) for f in rels[relation][2].schema.fields]


def page(t: Tables, relation: str, *, limit: int = DEFAULT_LIMIT, offset: int = 0,
         order_by: list[str] | None = None) -> DataFrame:
    """One page of an allowlisted relation, limit clamped to 1..100,
    offset >= 0, in a stable key order (the reference had none). A page
    beyond ``TOP_ROWS`` reads only its own range of the relation's rank index."""
    rels = relations(t)
    if relation not in rels:
        raise KeyError(f'Unknown relation "{relation}".')
    limit = min(max(int(limit or DEFAULT_LIMIT), 1), MAX_LIMIT)
    offset = max(int(offset or 0), 0)
    df = rels[relation][2]
    keys = order_by or PAGE_KEYS.get(relation) or df.columns
    if offset + limit <= TOP_ROWS:
        return df.orderBy(*keys).offset(offset).limit(limit)
    return page_index(t, relation, keys).page(offset, limit)


def page_index(t: Tables, relation: str, keys: list[str]) -> PageIndex:
    """The rank index of a relation, built at the first deep page and kept with the model."""
    built = t.__dict__.setdefault("_page_indexes", {})
    key = (relation, tuple(keys))
    if key not in built:
        built[key] = PageIndex(relations(t)[relation][2], keys)
    return built[key]


def page_after(t: Tables, relation: str, after: tuple, *, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Keyset paging: the page after the row with key ``after``. A filter and
    a top-k (no global sort and no offset scan) - the way to page deep."""
    rels = relations(t)
    if relation not in rels:
        raise KeyError(f'Unknown relation "{relation}".')
    keys = PAGE_KEYS[relation]
    df = rels[relation][2]
    cond = None
    for i in range(len(keys) - 1, -1, -1):
        here = F.col(keys[i]) > F.lit(after[i])
        for j in range(i):
            here = here & (F.col(keys[j]) == F.lit(after[j]))
        cond = here if cond is None else cond | here
    return df.where(cond).orderBy(*keys).limit(min(max(limit, 1), MAX_LIMIT))


__all__ = ["catalog", "columns", "page", "page_after", "page_index", "relations", "TABLE_NAMES"]
