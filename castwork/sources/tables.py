"""The plant model: one DataFrame per source table, under neutral names.

Operators take a ``Tables`` and never read files themselves. Two providers
exist: ``binding.bind`` derives the model from the driver's TPC-H-like tables,
and ``Tables.from_parquet`` reads a model that was written to a shared folder
(``materialize``), which is how a deployment would run: the source systems'
extracts land as Parquet and every query prunes and pushes down into them.
"""

from __future__ import annotations

import dataclasses
import hashlib
import os
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import BooleanType, DateType, IntegralType, NumericType, StringType, TimestampNTZType

# Model tables in a stable order (catalogue order).
TABLE_NAMES = (
    "part", "work_center", "scrap_reason", "job_head", "job_oper", "labor_dtl", "scrap_dtl",
    "heat", "pour_record", "inspect_result", "tag_history", "downtime_event", "board_item", "column_value",
    "part_pattern", "wc_tag", "request_event",
)

# Which source system each table belongs to (provenance, R05).
SYSTEM_OF = {
    "part": "erp", "work_center": "erp", "scrap_reason": "erp", "job_head": "erp",
    "job_oper": "erp", "labor_dtl": "erp", "scrap_dtl": "erp",
    "heat": "melt", "pour_record": "melt", "inspect_result": "melt",
    "tag_history": "historian", "downtime_event": "historian",
    "board_item": "board", "column_value": "board",
    "part_pattern": "xref", "wc_tag": "xref",
    "request_event": "app",
}

# How a materialized table is laid out: sort keys inside files so Parquet
# min/max statistics prune range and equality predicates.
SORT_KEYS = {
    "job_head": ["job_num"],
    "job_oper": ["job_num", "oper_seq"],
    "labor_dtl": ["job_num", "oper_seq"],
    "scrap_dtl": ["logged_at"],
    "pour_record": ["pattern_code", "poured_at"],
    "heat": ["heat_num"],
    "inspect_result": ["pattern_code", "inspected_at"],
    "tag_history": ["tag_path", "ts"],
    "downtime_event": ["started_at"],
    "column_value": ["item_id"],
    "request_event": ["ts"],
}


# ERP tables keyed (and joined) by job number, with their in-bucket sort.
JOB_KEYED = {
    "job_head": ["job_num"],
    "job_oper": ["job_num", "oper_seq"],
    "labor_dtl": ["job_num", "oper_seq"],
    "scrap_dtl": ["job_num", "oper_seq"],
}


# Columns of the model by kind of value: text, whole numbers, numbers, dates, times, flags.
MODEL = {
    "part": "part_num:s description:s alloy:s process:s pattern_num:s cavities:i target_wt_lbs:n customer_code:s industry:s",
    "work_center": "wc_code:s description:s dept:s shifts_per_day:i hrs_per_shift:n resources:i",
    "scrap_reason": "reason_code:s description:s category:s",
    "job_head": "job_num:s part_num:s qty_ordered:i qty_completed:i req_due_date:d job_closed:b created_at:t",
    "job_oper": "job_num:s oper_seq:i wc_code:s est_setup_hrs:n est_prod_hrs:n act_setup_hrs:n act_prod_hrs:n qty_completed:i scrap_qty:i",
    "labor_dtl": "employee_num:s job_num:s oper_seq:i clock_in:t clock_out:t labor_hrs:n shift:i",
    "scrap_dtl": "job_num:s oper_seq:i scrap_qty:i reason_code:s logged_at:t",
    "heat": "heat_num:s furnace_id:s alloy_spec:s pour_date:d poured_at:t lbs_charged:n lbs_poured:n lbs_returns:n degas_minutes:n rpt_density:n",
    "pour_record": "heat_num:s pattern_code:s molds_poured:i poured_at:t",
    "inspect_result": "inspect_seq:i pattern_code:s heat_num:s sample_qty:i pass_qty:i fail_qty:i defect_code:s inspected_at:t",
    "tag_history": "tag_id:i tag_path:s ts:t value_float:n quality:i",
    "downtime_event": "event_id:i tag_path:s started_at:t ended_at:t reason_text:s",
    "board_item": "item_id:i board_name:s item_name:s status:s customer:s promised_date:d created_at:t",
    "column_value": "item_id:i column_title:s text_value:s",
    "part_pattern": "part_num:s pattern_code:s",
    "wc_tag": "wc_code:s tag_prefix:s signal_role:s",
    "request_event": "event_id:i ts:t x_forwarded_for:s x_real_ip:s channel:s input_tokens:i output_tokens:i",
}
KINDS = {"s": (StringType,), "i": (IntegralType,), "n": (NumericType,), "d": (DateType,), "t": (TimestampNTZType,), "b": (BooleanType,)}


def checked(df: DataFrame, name: str) -> DataFrame:
    """``df`` with the model's columns of table ``name``; a ValueError that names every column that is missing or
    holds another kind of value."""
    want = dict(c.split(":") for c in MODEL[name].split())
    types = {f.name: f.dataType for f in df.schema.fields}
    wrong = [f"{c} is missing" if c not in types else f"{c} is {types[c].simpleString()}"
             for c, kind in want.items() if c not in types or not isinstance(types[c], KINDS[kind])]
    if wrong:
        raise ValueError(f"table {name}: " + ", ".join(wrong))
    return df.select(*want)


@dataclasses.dataclass(frozen=True)
class Tables:
    part: DataFrame
    work_center: DataFrame
    scrap_reason: DataFrame
    job_head: DataFrame
    job_oper: DataFrame
    labor_dtl: DataFrame
    scrap_dtl: DataFrame
    heat: DataFrame
    pour_record: DataFrame
    inspect_result: DataFrame
    tag_history: DataFrame
    downtime_event: DataFrame
    board_item: DataFrame
    column_value: DataFrame
    part_pattern: DataFrame
    wc_tag: DataFrame
    request_event: DataFrame
    job_ref_digits: int = 6  # longest job number that a typed reference may hold (B01)

    def items(self):
        return [(n, getattr(self, n)) for n in TABLE_NAMES]

    def register_views(self, prefix: str = "") -> None:
        """Register every table as a temp view so ``spark.sql`` works too."""
        for name, df in self.items():
            df.createOrReplaceTempView(prefix + name)

    @staticmethod
    def from_parquet(spark: SparkSession, root: str, job_ref_digits: int = 6) -> "Tables":
        """The model written to ``root``. Columns that are missing or of another type fail here, all of them named,
        and not in some query later; columns that the model does not have are left out."""
        return Tables(**{n: checked(spark.read.parquet(os.path.join(root, n)), n) for n in TABLE_NAMES}, job_ref_digits=job_ref_digits)

    def materialize(self, root: str, files_per_table: int | None = None,
                    job_buckets: int | None = None, database: str | None = None,
                    parallel_writes: int = 4) -> "Tables":
        """Write every table to ``root`` (a shared folder) and read it back.

        Cuts lineage (the written table survives executor loss) and gives the
        queries a columnar, sorted source to prune against. ``root`` must be a
        cluster-visible path, e.g. under ``spark.checkpoint.dir``.

        ``job_buckets`` writes the job-keyed ERP tables bucketed (and sorted)
        on ``job_num`` as catalogue tables of ``database`` located at
        ``root``: joins and aggregates on the job key then read co-partitioned
        buckets instead of shuffling the largest tables.
        """
        spark = self.part.sparkSession
        if job_buckets:
            db = database or f"castwork_{hashlib.md5(root.encode()).hexdigest()[:12]}"  # one database for each root
            spark.sql(f"CREATE DATABASE IF NOT EXISTS {db} LOCATION '{root}'")
            tables = {}
            for name, df in self.items():
                w = df.write.mode("overwrite").format("parquet")
                if name in JOB_KEYED:
                    w = w.bucketBy(job_buckets, "job_num").sortBy(*JOB_KEYED[name])
                w.saveAsTable(f"{db}.{name}")
                tables[name] = spark.table(f"{db}.{name}")
            return Tables(**tables, job_ref_digits=self.job_ref_digits)

        def write(item) -> None:
            name, df = item
            out = df
            if files_per_table:
                out = out.repartition(files_per_table)
            keys = SORT_KEYS.get(name)
            if keys:
                out = out.sortWithinPartitions(*keys)
            out.write.mode("overwrite").parquet(os.path.join(root, name))

        # Independent writes run as concurrent Spark jobs.
        with ThreadPoolExecutor(max_workers=parallel_writes) as pool:
            list(pool.map(write, self.items()))
        return Tables.from_parquet(spark, root, self.job_ref_digits)
