"""Binding: derive the plant model from the driver's TPC-H-like tables.

The driver's tables hold no foundry data, so every model table is a fixed
function of them (FIXTURES.md section 2). The same rules are written once as
SQL for the DuckDB oracle (``oracles.binding``) and here with the DataFrame
API. Keys stay numeric for as long as possible (order key, line number) so the
heavy lineitem/orders joins are on integers; the string job number is made
once at the end.

``AS_OF`` is the pinned "today" of the bound data set.
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from castwork.functions.exprs import ts_ntz, small
from castwork.operators.windows import spread
from castwork.sources.tables import Tables

AS_OF = dt.date(2001, 8, 1)
# Orders placed from this instant on are still open (unless fully shipped).
OPEN_SINCE = "2001-06-02 00:00:00"
# Furnace 3 drops four minutes of degassing from this date.
DEGAS_DROP_FROM = dt.date(2001, 6, 6)
# The event stream is moved back this many days to end at AS_OF.
EVENT_SHIFT_DAYS = 8217
# Planted signals, so that every detector has rows that it flags and rows that it does not (FIXTURES.md section 2):
# scrap of one reason grows twelvefold from a day on; one order in 40 makes part 7 and takes twice its standard, one
# in 40 makes part 8 and keeps it; one centre slows down; historian and downtime events go back 300 days, those of
# two cells pile up at the end, the samples of a third halve there; returns rise; some parts have two patterns.
SCRAP_SPIKE_FROM = "2001-07-04 00:00:00"
RETURNS_RISE_FROM = dt.date(2001, 5, 1)
SLOW_CENTRE = "NATION_3"
# Parts over which the lines of one supplier are dealt to meet it.
SUPPLIER_DEALS = 8

# Fixed scrap reason lookup (the driver data has codes RC1-RC7 only).
SCRAP_REASONS = [
    ("RC1", "Gas porosity", "MELT"),
    ("RC2", "Shrinkage porosity", "MELT"),
    ("RC3", "Cold shut", "MOLD"),
    ("RC4", "Misrun", "MOLD"),
    ("RC5", "Inclusion", "MELT"),
    ("RC6", "Core break or shift", "CORE"),
    ("RC7", "Dimensional out of tolerance", "MACHINE"),
]

_cache: dict[tuple[int, str], tuple[SparkSession, Tables]] = {}


def _alive(spark: SparkSession) -> bool:
    """False once the session's context has been stopped (its DataFrames are dead)."""
    try:
        return spark.sparkContext._jsc is not None
    except Exception:  # noqa: BLE001 - a remote session has no local context
        return True


def _job_num(orderkey) -> F.Column:
    return F.concat(F.lit("J-"), (F.lit(100000) + orderkey).cast("string"))


def _part_num(partkey) -> F.Column:
    text = partkey.cast("string")
    return F.concat(F.lit("P-"), F.when(F.length(text) < 6, F.lpad(text, 6, "0")).otherwise(text))


def _hours(n) -> F.Column:
    return F.make_dt_interval(F.lit(0), n.cast("int"), F.lit(0), F.lit(0))


def bind(spark: SparkSession, sf_dir: str) -> Tables:
    """Lazy model over the driver tables in ``sf_dir`` (memoised per session)."""
    key = (id(spark), sf_dir)
    hit = _cache.get(key)
    if hit is not None and hit[0] is spark and _alive(spark):
        return hit[1]

    def read(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    p = read("part")
    nation = read("nation")
    orders = read("orders")
    li = read("lineitem")
    supplier = read("supplier")
    events = read("events")

    part = p.select(
        "p_partkey",
        _part_num(F.col("p_partkey")).alias("part_num"),
        F.col("p_name").alias("description"),
        F.col("p_type").alias("alloy"),
        F.when(F.col("p_partkey") % 2 == 0, "SAND").otherwise("PERM_MOLD").alias("process"),
        F.concat(F.lit("PN-"), (F.col("p_partkey") % 50).cast("string")).alias("pattern_num"),
        (F.lit(1) + F.col("p_partkey") % 4).cast("int").alias("cavities"),
        F.col("p_size").cast("decimal(8,2)").alias("target_wt_lbs"),
        F.col("p_brand").alias("customer_code"),
        F.col("p_type").alias("industry"),
    )

    region_dept = (F.when(F.col("n_regionkey") == 0, "MELT").when(F.col("n_regionkey") == 1, "MOLD")
                   .when(F.col("n_regionkey") == 2, "CORE").when(F.col("n_regionkey") == 3, "CLEAN")
                   .otherwise("MACHINE"))
    work_center = nation.select(
        "n_nationkey",
        F.col("n_name").alias("wc_code"),
        F.col("n_name").alias("description"),
        region_dept.alias("dept"),
        (F.lit(1) + F.col("n_nationkey") % 3).cast("int").alias("shifts_per_day"),
        F.lit(8).cast("decimal(4,2)").alias("hrs_per_shift"),
        (F.lit(1) + F.col("n_nationkey") % 2).cast("int").alias("resources"),
    )

    # As inline values Catalyst knows its size, so that scrap is not shuffled by its few reasons to meet it.
    scrap_reason = spark.sql("SELECT * FROM VALUES " + ", ".join(map(str, SCRAP_REASONS)) + " AS r(reason_code, description, category)")

    # -- job_head: one job per order that has lines --------------------------
    # Lines are grouped by order, and meet it, in parts whose number grows with them.
    lines = spread(li, "l_orderkey")
    per_order = lines.groupBy("l_orderkey").agg(
        F.when(F.col("l_orderkey") % 40 == 0, F.lit(7)).when(F.col("l_orderkey") % 40 == 1, F.lit(8))
         .otherwise(F.min("l_partkey")).cast("bigint").alias("pk"),
        F.sum("l_quantity").cast("bigint").alias("qty"),
        F.sum(F.when(F.col("l_linestatus") == "F", F.col("l_quantity")).otherwise(F.lit(0))).cast("bigint").alias("good"),
    )
    job_head = orders.join(per_order, orders.o_orderkey == per_order.l_orderkey).select(
        _job_num(F.col("o_orderkey")).alias("job_num"),
        _part_num(F.col("pk")).alias("part_num"),
        F.col("qty").alias("qty_ordered"),
        F.col("good").alias("qty_completed"),
        F.date_add(F.col("o_orderdate").cast("date"), (F.lit(10) + F.col("o_orderkey") % 35).cast("int")).alias("req_due_date"),
        ((F.col("o_orderstatus") == "F") | (F.col("o_orderdate") < ts_ntz(OPEN_SINCE))).alias("job_closed"),
        F.col("o_orderdate").alias("created_at"),
    )

    # -- job_oper: one operation per (order, line number) --------------------
    # Operations are grouped where their lines met their order. Lines meet their supplier before in such parts too, those
    # of one supplier in several, so that no task grows with a supplier that has many.
    li_o = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    centre_of = (supplier.join(small(work_center.select("n_nationkey", "wc_code")), F.col("n_nationkey") == F.col("s_nationkey"))
                 .withColumn("of_deal", F.explode(F.lit(list(range(SUPPLIER_DEALS))))))
    dealt = spread(li.withColumn("deal", F.pmod(F.hash("l_orderkey"), F.lit(SUPPLIER_DEALS))), "l_suppkey", "deal")
    ops = (spread(dealt.join(centre_of, (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("deal") == F.col("of_deal"))), "l_orderkey")
           .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
           .groupBy("l_orderkey", "l_linenumber").agg(
               F.min("wc_code").alias("wc_code"),
               F.sum("l_quantity").alias("q"),
               F.max("l_returnflag").alias("max_rf"),
               F.min("o_orderdate").alias("min_od"),
               F.min("o_orderstatus").alias("min_os"),
               F.sum(F.when(F.col("l_linestatus") == "F", F.col("l_quantity")).otherwise(F.lit(0))).alias("good"),
               F.sum(F.when(F.col("l_returnflag") == "R", F.ceil(F.col("l_quantity") * 0.1)).otherwise(F.lit(0))).alias("scrap")))
    not_started = ((F.col("max_rf") == "N") & (F.col("min_od") >= ts_ntz(OPEN_SINCE)) & (F.col("min_os") != "F"))
    slow = (F.col("wc_code") == SLOW_CENTRE) & (F.col("min_od") >= ts_ntz(OPEN_SINCE))
    times = F.when(F.col("l_orderkey") % 40 == 0, 2).otherwise(1) * F.when(slow, 2).otherwise(1)
    act_prod = (F.when(not_started, F.lit(0))
                .otherwise(F.col("q") * ((F.lit(92) + F.col("l_orderkey") % 37) * times) / F.lit(1000))
                .cast("decimal(9,3)"))
    est_setup = (F.lit(0.5) + F.col("l_linenumber") * F.lit(0.25)).cast("decimal(7,2)")
    job_oper = ops.select(
        _job_num(F.col("l_orderkey")).alias("job_num"),
        (F.col("l_linenumber") * 10).alias("oper_seq"),
        "wc_code",
        est_setup.alias("est_setup_hrs"),
        (F.col("q") * 0.1).cast("decimal(7,2)").alias("est_prod_hrs"),
        F.when(act_prod > 0, est_setup).otherwise(F.lit(0)).cast("decimal(7,2)").alias("act_setup_hrs"),
        act_prod.alias("act_prod_hrs"),
        F.col("good").cast("bigint").alias("qty_completed"),
        F.col("scrap").cast("bigint").alias("scrap_qty"),
    )

    # -- labor and scrap detail ------------------------------------------------
    labor_dtl = li_o.where(F.col("l_returnflag").isin("A", "R")).select(
        F.concat(F.lit("E-"), (F.lit(1000) + F.col("l_suppkey") % 40).cast("string")).alias("employee_num"),
        _job_num(F.col("l_orderkey")).alias("job_num"),
        (F.col("l_linenumber") * 10).alias("oper_seq"),
        (F.col("o_orderdate") + _hours(F.col("l_linenumber") * 12)).alias("clock_in"),
        (F.col("o_orderdate") + _hours((F.col("l_linenumber") + 1) * 12)).alias("clock_out"),
        (F.col("l_quantity") * 0.1).cast("decimal(6,2)").alias("labor_hrs"),
        (F.lit(1) + F.col("l_suppkey") % 3).cast("int").alias("shift"),
    )
    scrap_dtl = li_o.where(F.col("l_returnflag") == "R").select(
        _job_num(F.col("l_orderkey")).alias("job_num"),
        (F.col("l_linenumber") * 10).alias("oper_seq"),
        (F.ceil(F.col("l_quantity") * 0.1) * F.when((F.col("l_linenumber") == 3) & (F.col("o_orderdate") >= ts_ntz(SCRAP_SPIKE_FROM)), 12)
         .otherwise(1)).cast("bigint").alias("scrap_qty"),
        F.concat(F.lit("RC"), F.col("l_linenumber").cast("string")).alias("reason_code"),
        (F.col("o_orderdate") + _hours(F.lit(9))).alias("logged_at"),
    )

    # -- pattern bridge, pours and heats ---------------------------------------
    pattern = lambda k: F.concat(F.lit("PTN-"), F.lpad((k % 150).cast("string"), 4, "0"))
    part_pattern = part.where(F.col("p_partkey") % 12 != 0).select(
        "part_num",
        F.explode(F.when(F.col("p_partkey") % 40 == 9, F.array(pattern(F.col("p_partkey")), pattern(F.col("p_partkey") + 75)))
                  .otherwise(F.array(pattern(F.col("p_partkey"))))).alias("pattern_code"),
    )
    furnace_no = (F.lit(1) + F.col("l_suppkey") % 3)
    pour_date = F.col("o_orderdate").cast("date")
    heat_num = F.concat(F.lit("H-"), pour_date.cast("string"), F.lit("-F"), furnace_no.cast("string"))
    li_a = li_o.where(F.col("l_returnflag") == "A")
    pours = (li_a.join(per_order.select(F.col("l_orderkey").alias("ok"), "pk"), F.col("l_orderkey") == F.col("ok"))
             .withColumn("job_part", _part_num(F.col("pk")))
             .join(part_pattern, F.col("job_part") == part_pattern.part_num))
    pour_record = pours.select(
        heat_num.alias("heat_num"),
        F.when(F.col("l_orderkey") % 50 == 0, F.lit("PTN-9999")).otherwise(F.col("pattern_code")).alias("pattern_code"),
        F.col("l_quantity").cast("int").alias("molds_poured"),
        (F.col("o_orderdate") + _hours(F.col("l_linenumber") * 12)).alias("poured_at"),
    )
    fails = F.expr("(cast(l_quantity as int) * cast(round(l_discount * 100) as int)) div 100").cast("int")
    inspect_result = pours.where(F.col("l_orderkey") % 4 == 0).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("bigint").alias("inspect_seq"),
        F.when(F.col("l_orderkey") % 50 == 0, F.lit("PTN-9999")).otherwise(F.col("pattern_code")).alias("pattern_code"),
        F.when(F.col("l_orderkey") % 16 != 0, heat_num).alias("heat_num"),
        F.col("l_quantity").cast("int").alias("sample_qty"),
        (F.col("l_quantity").cast("int") - fails).alias("pass_qty"),
        fails.alias("fail_qty"),
        F.when(fails > 0, F.concat(F.lit("DEF-"), (F.lit(1) + F.col("l_partkey") % 6).cast("string"))).alias("defect_code"),
        (F.col("o_orderdate") + _hours(F.col("l_linenumber") * 12 + 24)).alias("inspected_at"),
    )
    min_disc = F.min("l_discount").cast("decimal(4,2)")
    heat = (li_a.groupBy(pour_date.alias("pour_date"), furnace_no.alias("f"))
            .agg(F.min("o_orderdate").alias("first_order"),
                 F.sum("l_quantity").alias("q"),
                 min_disc.alias("disc"),
                 F.min("l_orderkey").alias("min_ok"))
            .select(
                F.concat(F.lit("H-"), F.col("pour_date").cast("string"), F.lit("-F"), F.col("f").cast("string")).alias("heat_num"),
                F.concat(F.lit("FURN-"), F.col("f").cast("string")).alias("furnace_id"),
                F.lit("A356").alias("alloy_spec"),
                "pour_date",
                (F.col("first_order") + _hours(F.lit(6))).alias("poured_at"),
                (F.col("q") * 40).cast("decimal(18,2)").alias("lbs_charged"),
                (F.col("q") * (F.lit(32) + F.dayofmonth("pour_date") % 5)).cast("decimal(18,2)").alias("lbs_poured"),
                (F.col("q") * F.when(F.col("pour_date") >= F.lit(RETURNS_RISE_FROM), 6).otherwise(4)).cast("decimal(18,2)").alias("lbs_returns"),
                (F.lit(12) - F.col("disc") * 8
                 - F.when((F.col("f") == 3) & (F.col("pour_date") >= F.lit(DEGAS_DROP_FROM)), F.lit(4)).otherwise(F.lit(0))
                 ).cast("decimal(5,2)").alias("degas_minutes"),
                F.when(F.col("min_ok") % 8 == 0, F.lit(None))
                 .otherwise(F.lit(Decimal("2.62")) - F.col("disc") / 10).cast("decimal(5,3)").alias("rpt_density"),
            ))

    # -- historian -----------------------------------------------------------
    shift = F.make_dt_interval(F.lit(EVENT_SHIFT_DAYS))
    cell, turn = F.col("user_id") % 30, F.col("event_id") % 10
    back = F.make_dt_interval((F.lit(EVENT_SHIFT_DAYS) + F.when(cell.isin(3, 11), F.when(turn == 9, 270).otherwise(0)).otherwise(turn * 30)).cast("int"))
    halves = (cell == 4) & (turn == 0)
    tag_path = F.concat(F.lit("Plant/Cell"), (F.col("user_id") % 30).cast("string"), F.lit("/"), F.col("event_type"))
    tag_history = events.select(
        F.col("event_id").alias("tag_id"),
        tag_path.alias("tag_path"),
        (F.col("ts") - back).alias("ts"),
        F.when(halves, F.col("value") / 2).otherwise(F.col("value")).alias("value_float"),
        F.lit(192).alias("quality"),
    )
    eid = F.col("event_id")
    reason = (F.when(eid % 8 == 0, "die change").when(eid % 8 == 1, "PM - scheduled")
              .when(eid % 8 == 2, "spindle fault").when(eid % 8 == 3, "SPINDLE FAULT - waiting")
              .when(eid % 8 == 4, F.lit(None).cast("string")).when(eid % 8 == 5, "sand jam")
              .when(eid % 8 == 6, "unscheduled stop").otherwise("coolant pump failure"))
    downtime_event = events.where(F.col("event_type") == "error").select(
        "event_id",
        tag_path.alias("tag_path"),
        (F.col("ts") - back).alias("started_at"),
        F.when(eid % 25 == 0, F.lit(None))
         .otherwise(F.col("ts") - back + _hours(F.lit(1) + eid % 6)).alias("ended_at"),
        reason.alias("reason_text"),
    )
    wc_tag = nation.select(
        F.col("n_name").alias("wc_code"),
        F.concat(F.lit("Plant/Cell"), F.col("n_nationkey").cast("string")).alias("tag_prefix"),
        F.when(F.col("n_nationkey") % 3 == 0, "CYCLE").when(F.col("n_nationkey") % 3 == 1, "TEMP")
         .otherwise("STATE").alias("signal_role"),
    )

    # -- customer board (entity-attribute-value) ------------------------------
    k = F.col("o_orderkey")
    items = orders.where(F.col("o_orderpriority") == "1-URGENT").select(
        (F.lit(7700000000) + k).alias("item_id"),
        F.when(k % 3 == 0, "Expedites").when(k % 3 == 1, "Holds").otherwise("Launches").alias("board_name"),
        F.concat(F.lit("Order "), k.cast("string")).alias("item_name"),
        F.when(k % 4 == 0, "Stuck").when(k % 4 == 1, "Done").otherwise("Working on it").alias("status"),
        F.concat(F.lit("CUST"), (F.col("o_custkey") % 12).cast("string")).alias("customer"),
        F.when(k % 5 == 0, F.lit(None))
         .otherwise(F.date_add(F.col("o_orderdate").cast("date"), (F.lit(8) + k % 35).cast("int"))).alias("promised_date"),
        F.col("o_orderdate").alias("created_at"),
        k,
    )
    board_item = items.drop("o_orderkey")
    ref = F.lit(100000) + k
    job_ref = (F.when(k % 12 == 0, "").when(k % 24 == 13, "O'Neil's \\ old order").when(k % 12 == 1, "TBD")
               .when(k % 12 == 2, F.concat(F.lit("J"), ref.cast("string")))
               .when(k % 12 == 3, ref.cast("string"))
               .when(k % 12 == 4, F.concat(F.lit("Job "), ref.cast("string")))
               .when(k % 12 == 5, F.concat(F.lit("J-000"), F.lpad((k % 1000).cast("string"), 3, "0")))
               .when(k % 12 == 6, F.concat(F.lit("  j-"), ref.cast("string"), F.lit(" ")))
               .otherwise(F.concat(F.lit("J-"), ref.cast("string"))))
    priority = (F.when(k % 4 == 0, "Low").when(k % 4 == 1, "Medium").when(k % 4 == 2, "High").otherwise("Critical"))
    column_value = (
        items.select("item_id", F.lit("Job #").alias("column_title"), job_ref.alias("text_value"))
        .unionByName(items.select("item_id", F.lit("Notes").alias("column_title"),
                                  F.concat(F.lit("note "), (k % 6).cast("string")).alias("text_value")))
        .unionByName(items.select("item_id", F.lit("Priority").alias("column_title"), priority.alias("text_value")))
    )

    # -- request events for usage metering ------------------------------------
    uid = F.col("user_id")
    addr = F.concat(F.lit("10.0.0."), (uid % 7).cast("string"))
    request_event = events.select(
        "event_id",
        (F.col("ts") - shift).alias("ts"),
        F.when(eid % 3 == 0, F.lit(None)).otherwise(F.concat(addr, F.lit(", 192.168.1.1"))).alias("x_forwarded_for"),
        F.when((eid % 3 == 0) & (eid % 2 == 0), F.lit(None)).otherwise(addr).alias("x_real_ip"),
        F.when(F.col("event_type").isin("view", "click"), "mcp").otherwise("chat").alias("channel"),
        F.floor(F.col("value") * 10).cast("bigint").alias("input_tokens"),
        F.floor(F.col("value") * 3).cast("bigint").alias("output_tokens"),
    )

    t = Tables(
        part=part.drop("p_partkey"), work_center=work_center.drop("n_nationkey"), scrap_reason=scrap_reason,
        job_head=job_head, job_oper=job_oper, labor_dtl=labor_dtl, scrap_dtl=scrap_dtl,
        heat=heat, pour_record=pour_record, inspect_result=inspect_result, tag_history=tag_history, downtime_event=downtime_event,
        board_item=board_item, column_value=column_value, part_pattern=part_pattern, wc_tag=wc_tag,
        request_event=request_event, job_ref_digits=12,  # order keys go beyond six digits
    )
    _cache[key] = (spark, t)
    return t
