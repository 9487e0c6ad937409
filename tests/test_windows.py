import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from castwork.operators.windows import prefix_count, prefix_sum


def test_prefix_sum_equals_single_window(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice("abc"), rnd.randint(0, 20), i, rnd.randint(-5, 50)) for i in range(800)]
    df = spark.createDataFrame(rows, "k string, b int, o int, v long").repartition(7)
    got = prefix_sum(df, F.col("v"), partition=["k"], bucket=F.col("b"), order=["b", "o"], out="s")
    w = Window.partitionBy("k").orderBy("b", "o").rowsBetween(Window.unboundedPreceding, 0)
    ref = df.withColumn("s", F.sum("v").over(w))
    assert sorted(got.collect()) == sorted(ref.collect())
    ex = prefix_sum(df, F.col("v"), partition=["k"], bucket=F.col("b"), order=["b", "o"], out="s", inclusive=False)
    w2 = Window.partitionBy("k").orderBy("b", "o").rowsBetween(Window.unboundedPreceding, -1)
    ref2 = df.withColumn("s", F.coalesce(F.sum("v").over(w2), F.lit(0).cast("long")))
    assert sorted(ex.collect()) == sorted(ref2.collect())


def test_prefix_count_is_row_number(spark):
    rows = [("x", i // 10, i) for i in range(95)]
    df = spark.createDataFrame(rows, "k string, b int, o int")
    got = prefix_count(df, partition=["k"], bucket=F.col("b"), order=["o"], out="n")
    assert sorted(r["n"] for r in got.collect()) == list(range(1, 96))


def _hot(spark):
    """A third of all rows in one bucket of one key."""
    rnd = random.Random(11)
    rows = [("hot" if i % 3 == 0 else rnd.choice("abcd"), 7 if i % 3 == 0 else rnd.randint(0, 20), i * 7919 % 9001, rnd.randint(-5, 50)) for i in range(9000)]
    return spark.createDataFrame(rows, "k string, b int, o int, v long").repartition(5)


def test_a_hot_bucket_is_split_by_ranges(spark):
    df = _hot(spark)
    kw = dict(partition=["k"], bucket=F.col("b"), order=["o"], out="s")
    w = Window.partitionBy("k").orderBy("b", "o")
    for inclusive, end in ((True, 0), (False, -1)):
        ref = df.withColumn("s", F.coalesce(F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, end)), F.lit(0).cast("long")))
        got = prefix_sum(df, F.col("v"), inclusive=inclusive, split_bytes=0, **kw)
        assert sorted(got.collect()) == sorted(ref.collect())
    ranks = prefix_count(df, split_bytes=0, **kw)
    assert sorted(r["s"] for r in ranks.where("k = 'hot'").collect()) == list(range(1, 3001))


def test_no_task_is_above_its_share(spark):
    """What the inner windows of the ranged form sort: groups of at most a range, far less than the hot bucket."""
    from castwork.operators.ranks import numbered

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = numbered(_hot(spark), ["k", "b", "o"], "p")
    assert sorted(r["p"] for r in at.collect()) == list(range(9000))
    ranged = _hot(spark).repartitionByRange(n, "k", "b", "o").withColumn("r", F.spark_partition_id())
    largest = ranged.groupBy("r", "k").count().agg(F.max("count")).first()[0]
    assert largest <= 2 * 9000 / n < 3000
