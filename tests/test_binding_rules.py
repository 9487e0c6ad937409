"""The binding's column rules at keys beyond six digits."""

from pyspark.sql import functions as F

from castwork.functions.exprs import normalize_ref
from castwork.sources.binding import AS_OF, _job_num, _part_num
from castwork.operators.bridges import job_board_item


def test_large_keys_stay_apart(spark):
    keys = spark.createDataFrame([(1,), (999_999,), (10**6,), (10**7,), (10**7 + 1,)], "k bigint")
    got = keys.select(_job_num(F.col("k")).alias("j"), _part_num(F.col("k")).alias("p")).collect()
    assert len({r.j for r in got}) == len({r.p for r in got}) == 5
    assert got[0].p == "P-000001" and got[3].p == "P-10000000" and got[3].j == "J-10100000"


def test_typed_references_beyond_six_digits(spark):
    refs = spark.createDataFrame([("Job 10100000",), ("  j-123456 ",), ("12345",), ("1234567890123",)], "raw string")
    assert [r.v for r in refs.select(normalize_ref(F.col("raw"), 12).alias("v")).collect()] == ["J-10100000", "J-123456", None, None]
    assert [r.v for r in refs.select(normalize_ref(F.col("raw")).alias("v")).collect()] == [None, "J-123456", None, None]


def test_furnace_day_and_unknown_references(bound):
    kinds = dict(bound.heat.dtypes)
    assert all(kinds[c] == "decimal(18,2)" for c in ("lbs_charged", "lbs_poured", "lbs_returns"))
    assert bound.job_ref_digits == 12 and AS_OF.year == 2001
    unknown = job_board_item(bound).join(bound.job_head.select("job_num"), F.col("resolved_job_num") == F.col("job_num"), "left_anti")
    assert unknown.where(F.col("resolved_job_num").startswith("J-000")).count() > 0
