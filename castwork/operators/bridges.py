"""Reconciliation layer (B02-B13): the bridges between systems that share no
keys, the resolved views built on them, and what failed to match and why.

Every view is a lazy function of ``Tables``; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from castwork.functions.exprs import normalize_ref, quote_literal, round_half_up, small
from castwork.operators import segments
from castwork.operators.joins import day_span, path_prefixes, prefix_join, range_join
from castwork.sources.tables import Tables

# Fixed names of the four bridged source pairs and the reasons reported.
PAIR_PART_PATTERN = "erp.part -> melt.pattern_code"
PAIR_PATTERN_PART = "melt.pattern_code -> erp.part"
PAIR_BOARD_JOB = "board.board_item -> erp.job_head"
PAIR_TAG_WC = "historian.tag_path -> erp.work_center"
PAIR_JOB_HEAT = "erp.job_head -> melt.heat"
RATED_PAIRS = 4  # pairs with a match rate: all but pattern -> part
REASON_NO_PATTERN = "part has no pattern mapping in part_pattern"
REASON_NO_PART = "pattern poured in the melt system has no ERP part mapping"
REASON_BLANK = "Job # column is blank"
REASON_NO_TAG = "tag path is not mapped to any work center in wc_tag"
JOB_REF_TITLE = "Job #"


def job_window(t: Tables) -> DataFrame:
    """Per job, first clock-in (else created_at) to last clock-out (else
    created_at + 14 days). Labour is aggregated to one row per job first."""
    lab = t.labor_dtl.groupBy("job_num").agg(F.min("clock_in").alias("first_in"),
                                             F.max("clock_out").alias("last_out"))
    return (t.job_head.select("job_num", "created_at").join(lab, "job_num", "left")
            .select("job_num",
                    F.coalesce("first_in", "created_at").alias("started_at"),
                    F.coalesce("last_out", F.col("created_at") + F.make_dt_interval(F.lit(14))).alias("ended_at")))


def job_pattern(t: Tables) -> DataFrame:
    """Job -> pattern through its part; NULL pattern when unmapped; one
    row per pattern when a part has several."""
    return (t.job_head.select("job_num", "part_num")
            .join(t.part_pattern.select("part_num", "pattern_code"), "part_num", "left")
            .select("job_num", "part_num", "pattern_code"))


def job_heat(t: Tables) -> DataFrame:
    """Distinct (job, part, pattern, heat, poured_at) where a pour of the
    job's pattern falls inside the job's window, both ends inclusive.

    Both sides are made distinct before they meet (repeated pours of a heat
    would else be joined and dropped afterwards), so the pairs need no distinct."""
    pours = t.pour_record.select("pattern_code", "heat_num", "poured_at").distinct()
    pairs = range_join(_pattern_windows(t), pours, key="pattern_code", lo="started_at", hi="ended_at", t="poured_at")
    return pairs.select("job_num", "part_num", "pattern_code", "heat_num", "poured_at")


def _pattern_windows(t: Tables) -> DataFrame:
    """(job, part, pattern, window): one row per job and mapped pattern."""
    mapped = t.part_pattern.select("part_num", "pattern_code").where(F.col("pattern_code").isNotNull()).distinct()
    return t.job_head.select("job_num", "part_num").join(mapped, "part_num").join(job_window(t), "job_num")


def heats_of_jobs(t: Tables, heats: DataFrame) -> DataFrame:
    """Rows of ``heats`` once per job that has the heat in B04: job_num, then the columns of ``heats``.

    A pour knows the one before it of its pattern and heat, so of a heat's pours in a window only the first makes a
    pair, and the pairs of a job with one window need no distinct. Those of a job with several patterns (or rows) do."""
    poured = t.pour_record.select("pattern_code", "heat_num", "poured_at").where(F.col("poured_at").isNotNull()).distinct()
    in_time = Window.partitionBy("pattern_code", "heat_num").orderBy("poured_at")
    pours = poured.withColumn("_earlier", F.lag("poured_at").over(in_time)).join(heats.withColumnRenamed("poured_at", "_melted_at"), "heat_num")
    windows = _pattern_windows(t).withColumn("_windows", F.count(F.lit(1)).over(Window.partitionBy("job_num")))
    first = F.col("_earlier").isNull() | (F.col("_earlier") < F.col("started_at"))

    def met(w: DataFrame, p: DataFrame) -> DataFrame:
        return range_join(w.select("job_num", "pattern_code", "started_at", "ended_at"), p, key="pattern_code", lo="started_at", hi="ended_at", t="poured_at").where(first)

    once = met(windows.where(F.col("_windows") == 1), pours).withColumn("poured_at", F.col("_melted_at"))
    named = pours.select("pattern_code", "heat_num", "poured_at", "_earlier").distinct()
    several = met(windows.where(F.col("_windows") > 1), named).select("job_num", "heat_num").distinct().join(heats, "heat_num")
    cols = ["job_num", *heats.columns]
    return once.select(*cols).unionByName(several.select(*cols))


def job_heat_sizes(t: Tables) -> DataFrame:
    """How many rows of B04 each (job, part, pattern) has, without building them: the pours of a pattern are rolled
    up into time segments, and a job's window meets the few that cover it. Only windows with pours are returned."""
    pours = t.pour_record.select("pattern_code", "heat_num", "poured_at").distinct()
    rollup = segments.rolled_up(pours, "poured_at", ["pattern_code"], "heat_num")
    met = segments.within(_pattern_windows(t), rollup.select("pattern_code", "unit", "segment", "instant", "n"), "pattern_code", "started_at", "ended_at")
    return met.groupBy("job_num", "part_num", "pattern_code").agg(F.sum("n").alias("pours"))


def _jobs_with_heat(t: Tables) -> DataFrame:
    """Jobs that have some row in B04: a semi join, which stops at the first pour
    met and never builds the (job, heat) pairs."""
    w = _pattern_windows(t).withColumn("_day", F.explode(day_span(F.col("started_at"), F.col("ended_at"))))
    p = t.pour_record.select(F.col("pattern_code").alias("_pattern"), "poured_at").distinct() \
        .withColumn("_poured_day", F.col("poured_at").cast("date"))
    met = ((F.col("pattern_code") == F.col("_pattern")) & (F.col("_day") == F.col("_poured_day"))
           & (F.col("poured_at") >= F.col("started_at")) & (F.col("poured_at") <= F.col("ended_at")))
    return w.join(p, met, "left_semi").select("job_num").distinct()


def job_board_item(t: Tables) -> DataFrame:
    """Board items with their 'Job #' text, raw and normalised."""
    cv = t.column_value.where(F.col("column_title") == JOB_REF_TITLE).select("item_id", "text_value")
    return (cv.join(t.board_item, "item_id")
            .select(normalize_ref(F.col("text_value"), t.job_ref_digits).alias("resolved_job_num"),
                    F.col("text_value").alias("raw_job_ref"),
                    "item_id", "board_name", "item_name", "status", "customer", "promised_date", "created_at"))


def wc_tag_resolved(t: Tables) -> DataFrame:
    """Historian samples under a work centre's tag prefix.

    Paths are split once per distinct tag, not per sample; the samples then meet
    a (tag, centre, role) map. The map grows with the number of tags, so it is
    broadcast behind a size check like any other side."""
    tags = t.tag_history.select("tag_path").distinct()
    owners = prefix_join(tags, "tag_path", t.wc_tag.select("wc_code", "tag_prefix", "signal_role"))
    return (t.tag_history.join(small(owners.select("tag_path", "wc_code", "signal_role")), "tag_path")
            .select("wc_code", "signal_role", "tag_path", "ts", "value_float", "quality"))


def _tags_mapped(t: Tables) -> DataFrame:
    """(tag_path, mapped) for every distinct tag path of the historian. The
    group by tag_path reuses the partitioning of the distinct before it."""
    owned = t.wc_tag.select(F.col("tag_prefix").alias("_pfx")).distinct().withColumn("_owned", F.lit(True))
    tags = t.tag_history.select("tag_path").distinct()
    return (tags.withColumn("_pfx", F.explode_outer(path_prefixes(F.col("tag_path"))))
            .join(small(owned), "_pfx", "left")
            .groupBy("tag_path").agg(F.coalesce(F.max("_owned"), F.lit(False)).alias("mapped")))


def match_rate(t: Tables) -> DataFrame:
    """(source_pair, matched, total) for the four bridges.

    part->pattern counts the LEFT JOIN (a part with two patterns counts
    twice); board item->job needs a resolved ref that exists; tag paths are
    distinct; job->heat runs over all jobs.
    """
    pp = t.part.select("part_num").join(t.part_pattern.select("part_num", "pattern_code"), "part_num", "left")
    r1 = pp.agg(F.lit(PAIR_PART_PATTERN).alias("source_pair"),
                F.count_if(F.col("pattern_code").isNotNull()).alias("matched"),
                F.count(F.lit(1)).alias("total"))
    jobs = t.job_head.select(F.col("job_num").alias("_job"))
    items = job_board_item(t).join(jobs, F.col("resolved_job_num") == F.col("_job"), "left")
    r2 = items.agg(F.lit(PAIR_BOARD_JOB).alias("source_pair"),
                   F.count_if(F.col("_job").isNotNull()).alias("matched"),
                   F.count(F.lit(1)).alias("total"))
    r3 = _tags_mapped(t).agg(
        F.lit(PAIR_TAG_WC).alias("source_pair"),
        F.count_if(F.col("mapped")).alias("matched"),
        F.count(F.lit(1)).alias("total"))
    with_heat = _jobs_with_heat(t).select(F.col("job_num").alias("_hj"))
    r4 = t.job_head.select("job_num").join(with_heat, F.col("job_num") == F.col("_hj"), "left").agg(
        F.lit(PAIR_JOB_HEAT).alias("source_pair"),
        F.count_if(F.col("_hj").isNotNull()).alias("matched"),
        F.count(F.lit(1)).alias("total"))
    return r1.unionByName(r2).unionByName(r3).unionByName(r4) \
        .select("source_pair", F.col("matched").cast("bigint"), F.col("total").cast("bigint"))


def match_pct(t: Tables) -> DataFrame:
    """B13 (= D10): match rates with ``round(100 * matched / total, 1)``."""
    m = match_rate(t)
    return m.withColumn("match_pct", F.when(F.col("total") != 0, round_half_up(
        F.lit(100.0) * F.col("matched") / F.col("total"), 1)))


def unmatched(t: Tables) -> DataFrame:
    """Every record that failed to reconcile, with the reason."""
    parts = t.part.select("part_num").join(t.part_pattern.select("part_num"), "part_num", "left_anti") \
        .select(F.lit(PAIR_PART_PATTERN).alias("source_pair"), F.col("part_num").alias("identifier"),
                F.lit(REASON_NO_PATTERN).alias("reason"))
    poured = t.pour_record.select("pattern_code").distinct() \
        .join(t.part_pattern.select("pattern_code").distinct(), "pattern_code", "left_anti") \
        .select(F.lit(PAIR_PATTERN_PART).alias("source_pair"), F.col("pattern_code").alias("identifier"),
                F.lit(REASON_NO_PART).alias("reason"))
    items = job_board_item(t)
    blank = F.col("raw_job_ref").isNull() | (F.trim(F.col("raw_job_ref")) == "")
    bad_ref = items.where(F.col("resolved_job_num").isNull()).select(
        F.lit(PAIR_BOARD_JOB).alias("source_pair"), F.col("item_id").cast("string").alias("identifier"),
        F.when(blank, F.lit(REASON_BLANK))
         .otherwise(F.concat(F.lit("Job # value "), quote_literal(F.col("raw_job_ref")), F.lit(" could not be parsed")))
         .alias("reason"))
    no_job = items.where(F.col("resolved_job_num").isNotNull()) \
        .join(t.job_head.select(F.col("job_num").alias("resolved_job_num")), "resolved_job_num", "left_anti") \
        .select(F.lit(PAIR_BOARD_JOB).alias("source_pair"), F.col("item_id").cast("string").alias("identifier"),
                F.concat(F.lit("Job # parsed to "), F.col("resolved_job_num"),
                         F.lit(" but no such job exists in the ERP")).alias("reason"))
    tags = _tags_mapped(t).where(~F.col("mapped")).select(
        F.lit(PAIR_TAG_WC).alias("source_pair"), F.col("tag_path").alias("identifier"),
        F.lit(REASON_NO_TAG).alias("reason"))
    return parts.unionByName(poured).unionByName(bad_ref).unionByName(no_job).unionByName(tags)


def unmatched_summary(t: Tables) -> DataFrame:
    """Unmatched count per source pair."""
    return unmatched(t).groupBy("source_pair").agg(F.count(F.lit(1)).alias("unmatched_count"))


def multi_mapped_patterns(t: Tables) -> DataFrame:
    """Patterns serving more than one part."""
    return (t.part_pattern.groupBy("pattern_code").agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") > 1))


def ref_formats(t: Tables, limit: int = 5) -> DataFrame:
    """Per resolved job, its distinct raw spellings (first ``limit`` in
    sorted order, ' | '-joined) and how many there are. The per-job window
    ranks distinct rows, so no unbounded list is collected."""
    d = job_board_item(t).where(F.col("resolved_job_num").isNotNull()) \
        .select("resolved_job_num", "raw_job_ref").distinct()
    w = Window.partitionBy("resolved_job_num").orderBy("raw_job_ref")
    ranked = d.withColumn("_i", F.row_number().over(w))
    firsts = ranked.where(F.col("_i") <= limit).groupBy("resolved_job_num").agg(
        F.array_join(F.array_sort(F.collect_list("raw_job_ref")), " | ").alias("formats"))
    counts = d.groupBy("resolved_job_num").agg(F.count(F.lit(1)).alias("n_formats"))
    return firsts.join(counts, "resolved_job_num")


def reconciliation_report(t: Tables) -> DataFrame:
    """Match rates with the unmatched count of each pair (pairs without
    a rate, i.e. pattern -> part, appear with NULL rates)."""
    return match_pct(t).join(unmatched_summary(t), "source_pair", "full") \
        .select("source_pair", "matched", "total", "match_pct",
                F.coalesce("unmatched_count", F.lit(0)).cast("bigint").alias("unmatched_count"))
