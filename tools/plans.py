"""Write ``explain("formatted")`` of selected queries on a materialized model.

    python tools/plans.py <sf_dir> <out_dir> key [key ...]

Paths of the scratch model are replaced by ``<model>`` so the files diff
cleanly between runs.
"""

from __future__ import annotations

import os
import re
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main() -> None:
    sf_dir, out_dir, keys = sys.argv[1], sys.argv[2], sys.argv[3:]
    from castwork.plans.queries import QUERIES
    from castwork.session import local_session
    from castwork.sources.binding import bind

    spark = local_session(8, shuffle_partitions=16, app="castwork-plans")
    root = tempfile.mkdtemp(prefix="castwork-plans-")
    plain = bind(spark, sf_dir).materialize(os.path.join(root, "plain"))
    bucketed = bind(spark, sf_dir).materialize(os.path.join(root, "bucketed"), job_buckets=16)
    for key in keys:
        for label, t in (("", plain), ("_bucketed", bucketed)):
            if label and key not in ("job_cost", "job_labor_by_shift", "job_window"):
                continue
            df = QUERIES[key](t)
            df.write.format("noop").mode("overwrite").save()  # AQE: show the final plan
            text = df._jdf.queryExecution().explainString(
                spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
            text = re.sub(r"file:/[^\]\s,]*castwork-plans-[^/\]\s,]*", "<model>", text)
            with open(os.path.join(out_dir, f"{key}{label}.txt"), "w") as fh:
                fh.write(text)


if __name__ == "__main__":
    main()
