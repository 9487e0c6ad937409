"""SQL surface: the model as temp views and B01 as a SQL function, so the
same data answers ``spark.sql`` (the reference exposes tools only)."""

from __future__ import annotations

from pyspark.sql import SparkSession

from castwork.functions.exprs import JOB_REF_PATTERN
from castwork.operators.catalog import VIEWS
from castwork.sources.tables import Tables


def register_sql(spark: SparkSession, t: Tables, prefix: str = "") -> list[str]:
    """Create temp views for every table and resolved view, and the SQL
    function ``normalize_job_ref(raw)``. Returns the view names."""
    t.register_views(prefix)
    names = [prefix + n for n, _ in t.items()]
    for n, fn in VIEWS.items():
        fn(t).createOrReplaceTempView(prefix + n)
        names.append(prefix + n)
    pattern = JOB_REF_PATTERN.replace("\\", "\\\\")
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION {prefix}normalize_job_ref(raw STRING) RETURNS STRING
        RETURN CASE WHEN raw IS NULL OR trim(raw) = '' THEN NULL
                    ELSE concat('J-', nullif(regexp_extract(upper(trim(raw)), '{pattern}', 1), '')) END""")
    return names
