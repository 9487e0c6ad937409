"""The binding as DuckDB SQL: driver tables -> plant model views.

Every oracle string is ``WITH <needed views>, <operator CTEs> SELECT ...``.
The view names end in ``_b`` so they never clash with the driver's tables.
Written from FIXTURES.md section 2 (plus the few columns the model adds there:
work-centre description, cavities, actual setup, per-operation quantities,
alloy spec, item name, scrap reasons and request events).
"""

from __future__ import annotations

AS_OF = "DATE '2001-08-01'"

VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {
    "part_b": ("""
SELECT p_partkey, concat('P-', lpad(CAST(p_partkey AS VARCHAR), greatest(6, length(CAST(p_partkey AS VARCHAR)))::INT, '0')) AS part_num, p_name AS description, p_type AS alloy,
  CASE WHEN p_partkey % 2 = 0 THEN 'SAND' ELSE 'PERM_MOLD' END AS process, concat('PN-', CAST(p_partkey % 50 AS VARCHAR)) AS pattern_num,
  CAST(1 + p_partkey % 4 AS INTEGER) AS cavities,
  CAST(p_size AS DECIMAL(8,2)) AS target_wt_lbs, p_brand AS customer_code, p_type AS industry FROM part""", ()),
    "work_center_b": ("""
SELECT n_nationkey, n_name AS wc_code, n_name AS description, CASE n_regionkey WHEN 0 THEN 'MELT' WHEN 1 THEN 'MOLD' WHEN 2 THEN 'CORE' WHEN 3 THEN 'CLEAN' ELSE 'MACHINE' END AS dept,
  CAST(1 + n_nationkey % 3 AS INTEGER) AS shifts_per_day, CAST(8 AS DECIMAL(4,2)) AS hrs_per_shift, CAST(1 + n_nationkey % 2 AS INTEGER) AS resources FROM nation""", ()),
    "scrap_reason_b": ("""
SELECT * FROM (VALUES ('RC1', 'Gas porosity', 'MELT'), ('RC2', 'Shrinkage porosity', 'MELT'), ('RC3', 'Cold shut', 'MOLD'),
  ('RC4', 'Misrun', 'MOLD'), ('RC5', 'Inclusion', 'MELT'), ('RC6', 'Core break or shift', 'CORE'),
  ('RC7', 'Dimensional out of tolerance', 'MACHINE')) AS v(reason_code, description, category)""", ()),
    "job_head_b": ("""
SELECT concat('J-', CAST(100000 + o.o_orderkey AS VARCHAR)) AS job_num, concat('P-', lpad(CAST(l.pk AS VARCHAR), greatest(6, length(CAST(l.pk AS VARCHAR)))::INT, '0')) AS part_num,
  l.qty AS qty_ordered, l.good AS qty_completed, CAST(CAST(o.o_orderdate AS DATE) + CAST(10 + o.o_orderkey % 35 AS INT) AS DATE) AS req_due_date,
  (o.o_orderstatus = 'F' OR o.o_orderdate < TIMESTAMP '2001-06-02 00:00:00') AS job_closed, o.o_orderdate AS created_at
  FROM orders o JOIN (SELECT l_orderkey, CAST(CASE WHEN l_orderkey % 40 = 0 THEN 7 WHEN l_orderkey % 40 = 1 THEN 8 ELSE min(l_partkey) END AS BIGINT) AS pk, CAST(sum(l_quantity) AS BIGINT) AS qty,
    CAST(sum(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0 END) AS BIGINT) AS good FROM lineitem GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey""", ()),
    "job_oper_b": ("""
SELECT job_num, oper_seq, wc_code, est_setup_hrs, est_prod_hrs,
  CAST(CASE WHEN act_prod_hrs > 0 THEN est_setup_hrs ELSE 0 END AS DECIMAL(7,2)) AS act_setup_hrs, act_prod_hrs, qty_completed, scrap_qty
FROM (SELECT concat('J-', CAST(100000 + l.l_orderkey AS VARCHAR)) AS job_num, l.l_linenumber * 10 AS oper_seq, min(w.wc_code) AS wc_code,
  CAST(0.5 + l.l_linenumber * 0.25 AS DECIMAL(7,2)) AS est_setup_hrs, CAST(sum(l.l_quantity) * 0.1 AS DECIMAL(7,2)) AS est_prod_hrs,
  CAST(CASE WHEN max(l.l_returnflag) = 'N' AND min(o.o_orderdate) >= TIMESTAMP '2001-06-02 00:00:00' AND min(o.o_orderstatus) <> 'F' THEN 0
       ELSE sum(l.l_quantity) * ((92 + l.l_orderkey % 37) * CASE WHEN l.l_orderkey % 40 = 0 THEN 2 ELSE 1 END * CASE WHEN min(w.wc_code) = 'NATION_3' AND min(o.o_orderdate) >= TIMESTAMP '2001-06-02 00:00:00' THEN 2 ELSE 1 END) / 1000 END AS DECIMAL(9,3)) AS act_prod_hrs,
  CAST(sum(CASE WHEN l.l_linestatus = 'F' THEN l.l_quantity ELSE 0 END) AS BIGINT) AS qty_completed,
  CAST(sum(CASE WHEN l.l_returnflag = 'R' THEN ceil(l.l_quantity * 0.1) ELSE 0 END) AS BIGINT) AS scrap_qty
  FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN supplier s ON s.s_suppkey = l.l_suppkey JOIN work_center_b w ON w.n_nationkey = s.s_nationkey
  GROUP BY l.l_orderkey, l.l_linenumber) x""", ("work_center_b",)),
    "labor_dtl_b": ("""
SELECT concat('E-', CAST(1000 + l.l_suppkey % 40 AS VARCHAR)) AS employee_num, concat('J-', CAST(100000 + l.l_orderkey AS VARCHAR)) AS job_num,
  l.l_linenumber * 10 AS oper_seq, o.o_orderdate + l.l_linenumber * INTERVAL '12' HOUR AS clock_in, o.o_orderdate + (l.l_linenumber + 1) * INTERVAL '12' HOUR AS clock_out,
  CAST(l.l_quantity * 0.1 AS DECIMAL(6,2)) AS labor_hrs, CAST(1 + l.l_suppkey % 3 AS INT) AS shift
  FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey WHERE l.l_returnflag IN ('A', 'R')""", ()),
    "scrap_dtl_b": ("""
SELECT concat('J-', CAST(100000 + l.l_orderkey AS VARCHAR)) AS job_num, l.l_linenumber * 10 AS oper_seq, CAST(ceil(l.l_quantity * 0.1) * CASE WHEN l.l_linenumber = 3 AND o.o_orderdate >= TIMESTAMP '2001-07-04 00:00:00' THEN 12 ELSE 1 END AS BIGINT) AS scrap_qty,
  concat('RC', CAST(l.l_linenumber AS VARCHAR)) AS reason_code, o.o_orderdate + INTERVAL '9' HOUR AS logged_at
  FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey WHERE l.l_returnflag = 'R'""", ()),
    "part_pattern_b": ("""
SELECT part_num, concat('PTN-', lpad(CAST(p_partkey % 150 AS VARCHAR), 4, '0')) AS pattern_code FROM part_b WHERE p_partkey % 12 <> 0
  UNION ALL SELECT part_num, concat('PTN-', lpad(CAST((p_partkey + 75) % 150 AS VARCHAR), 4, '0')) FROM part_b WHERE p_partkey % 12 <> 0 AND p_partkey % 40 = 9""", ("part_b",)),
    "pour_record_b": ("""
SELECT concat('H-', CAST(CAST(o.o_orderdate AS DATE) AS VARCHAR), '-F', CAST(1 + l.l_suppkey % 3 AS VARCHAR)) AS heat_num,
  CASE WHEN l.l_orderkey % 50 = 0 THEN 'PTN-9999' ELSE pp.pattern_code END AS pattern_code, CAST(l.l_quantity AS INT) AS molds_poured,
  o.o_orderdate + l.l_linenumber * INTERVAL '12' HOUR AS poured_at
  FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN job_head_b j ON j.job_num = concat('J-', CAST(100000 + l.l_orderkey AS VARCHAR))
  JOIN part_pattern_b pp ON pp.part_num = j.part_num WHERE l.l_returnflag = 'A'""", ("job_head_b", "part_pattern_b")),
    "inspect_result_b": ("""
SELECT CAST(o.o_orderkey * 10 + l.l_linenumber AS BIGINT) AS inspect_seq, CASE WHEN o.o_orderkey % 50 = 0 THEN 'PTN-9999' ELSE pp.pattern_code END AS pattern_code,
  CASE WHEN o.o_orderkey % 16 <> 0 THEN concat('H-', CAST(CAST(o.o_orderdate AS DATE) AS VARCHAR), '-F', CAST(1 + l.l_suppkey % 3 AS VARCHAR)) END AS heat_num,
  CAST(l.l_quantity AS INT) AS sample_qty, CAST(CAST(l.l_quantity AS INT) - (CAST(l.l_quantity AS INT) * CAST(round(l.l_discount * 100) AS INT)) // 100 AS INT) AS pass_qty,
  CAST((CAST(l.l_quantity AS INT) * CAST(round(l.l_discount * 100) AS INT)) // 100 AS INT) AS fail_qty,
  CASE WHEN (CAST(l.l_quantity AS INT) * CAST(round(l.l_discount * 100) AS INT)) // 100 > 0 THEN concat('DEF-', CAST(1 + l.l_partkey % 6 AS VARCHAR)) END AS defect_code,
  o.o_orderdate + (l.l_linenumber * 12 + 24) * INTERVAL '1' HOUR AS inspected_at
  FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN job_head_b j ON j.job_num = concat('J-', CAST(100000 + l.l_orderkey AS VARCHAR))
  JOIN part_pattern_b pp ON pp.part_num = j.part_num WHERE l.l_returnflag = 'A' AND o.o_orderkey % 4 = 0""", ("job_head_b", "part_pattern_b")),
    "heat_b": ("""
SELECT concat('H-', CAST(CAST(o.o_orderdate AS DATE) AS VARCHAR), '-F', CAST(1 + l.l_suppkey % 3 AS VARCHAR)) AS heat_num,
  concat('FURN-', CAST(1 + l.l_suppkey % 3 AS VARCHAR)) AS furnace_id, 'A356' AS alloy_spec, CAST(o.o_orderdate AS DATE) AS pour_date, min(o.o_orderdate) + INTERVAL '6' HOUR AS poured_at,
  CAST(sum(l.l_quantity) * 40 AS DECIMAL(18,2)) AS lbs_charged, CAST(sum(l.l_quantity) * (32 + day(CAST(o.o_orderdate AS DATE)) % 5) AS DECIMAL(18,2)) AS lbs_poured, CAST(sum(l.l_quantity) * CASE WHEN CAST(o.o_orderdate AS DATE) >= DATE '2001-05-01' THEN 6 ELSE 4 END AS DECIMAL(18,2)) AS lbs_returns,
  CAST(12 - CAST(min(l.l_discount) AS DECIMAL(4,2)) * 8 - CASE WHEN 1 + l.l_suppkey % 3 = 3 AND CAST(o.o_orderdate AS DATE) >= DATE '2001-06-06' THEN 4 ELSE 0 END AS DECIMAL(5,2)) AS degas_minutes,
  CASE WHEN min(l.l_orderkey) % 8 = 0 THEN NULL ELSE CAST(2.62 - CAST(min(l.l_discount) AS DECIMAL(4,2)) / 10 AS DECIMAL(5,3)) END AS rpt_density
  FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey WHERE l.l_returnflag = 'A' GROUP BY CAST(o.o_orderdate AS DATE), 1 + l.l_suppkey % 3, l.l_suppkey % 3""", ()),
    "tag_history_b": ("""
SELECT event_id AS tag_id, concat('Plant/Cell', CAST(user_id % 30 AS VARCHAR), '/', event_type) AS tag_path, ts - (8217 + CASE WHEN user_id % 30 IN (3, 11) THEN CASE WHEN event_id % 10 = 9 THEN 270 ELSE 0 END ELSE event_id % 10 * 30 END) * INTERVAL '1' DAY AS ts, CASE WHEN user_id % 30 = 4 AND event_id % 10 = 0 THEN value / 2 ELSE value END AS value_float, 192 AS quality FROM events""", ()),
    "downtime_event_b": ("""
SELECT event_id, concat('Plant/Cell', CAST(user_id % 30 AS VARCHAR), '/', event_type) AS tag_path, ts - (8217 + CASE WHEN user_id % 30 IN (3, 11) THEN CASE WHEN event_id % 10 = 9 THEN 270 ELSE 0 END ELSE event_id % 10 * 30 END) * INTERVAL '1' DAY AS started_at,
  CASE WHEN event_id % 25 = 0 THEN NULL ELSE ts - (8217 + CASE WHEN user_id % 30 IN (3, 11) THEN CASE WHEN event_id % 10 = 9 THEN 270 ELSE 0 END ELSE event_id % 10 * 30 END) * INTERVAL '1' DAY + (1 + event_id % 6) * INTERVAL '1' HOUR END AS ended_at,
  CASE event_id % 8 WHEN 0 THEN 'die change' WHEN 1 THEN 'PM - scheduled' WHEN 2 THEN 'spindle fault' WHEN 3 THEN 'SPINDLE FAULT - waiting' WHEN 4 THEN NULL
    WHEN 5 THEN 'sand jam' WHEN 6 THEN 'unscheduled stop' ELSE 'coolant pump failure' END AS reason_text FROM events WHERE event_type = 'error'""", ()),
    "wc_tag_b": ("""
SELECT n_name AS wc_code, concat('Plant/Cell', CAST(n_nationkey AS VARCHAR)) AS tag_prefix, CASE n_nationkey % 3 WHEN 0 THEN 'CYCLE' WHEN 1 THEN 'TEMP' ELSE 'STATE' END AS signal_role FROM nation""", ()),
    "board_item_b": ("""
SELECT 7700000000 + o_orderkey AS item_id, CASE o_orderkey % 3 WHEN 0 THEN 'Expedites' WHEN 1 THEN 'Holds' ELSE 'Launches' END AS board_name,
  concat('Order ', CAST(o_orderkey AS VARCHAR)) AS item_name,
  CASE o_orderkey % 4 WHEN 0 THEN 'Stuck' WHEN 1 THEN 'Done' ELSE 'Working on it' END AS status, concat('CUST', CAST(o_custkey % 12 AS VARCHAR)) AS customer,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) + CAST(8 + o_orderkey % 35 AS INT) AS DATE) END AS promised_date, o_orderdate AS created_at, o_orderkey
  FROM orders WHERE o_orderpriority = '1-URGENT'""", ()),
    "column_value_b": ("""
SELECT item_id, 'Job #' AS column_title, CASE o_orderkey % 12 WHEN 0 THEN '' WHEN 1 THEN CASE WHEN o_orderkey % 24 = 13 THEN 'O''Neil''s \\ old order' ELSE 'TBD' END WHEN 2 THEN concat('J', CAST(100000 + o_orderkey AS VARCHAR))
    WHEN 3 THEN CAST(100000 + o_orderkey AS VARCHAR) WHEN 4 THEN concat('Job ', CAST(100000 + o_orderkey AS VARCHAR)) WHEN 5 THEN concat('J-000', lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0'))
    WHEN 6 THEN concat('  j-', CAST(100000 + o_orderkey AS VARCHAR), ' ') ELSE concat('J-', CAST(100000 + o_orderkey AS VARCHAR)) END AS text_value FROM board_item_b
  UNION ALL SELECT item_id, 'Notes', concat('note ', CAST(o_orderkey % 6 AS VARCHAR)) FROM board_item_b
  UNION ALL SELECT item_id, 'Priority', CASE o_orderkey % 4 WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' WHEN 2 THEN 'High' ELSE 'Critical' END FROM board_item_b""",
                       ("board_item_b",)),
    "request_event_b": ("""
SELECT event_id, ts - INTERVAL '8217' DAY AS ts,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE concat('10.0.0.', CAST(user_id % 7 AS VARCHAR), ', 192.168.1.1') END AS x_forwarded_for,
  CASE WHEN event_id % 3 = 0 AND event_id % 2 = 0 THEN NULL ELSE concat('10.0.0.', CAST(user_id % 7 AS VARCHAR)) END AS x_real_ip,
  CASE WHEN event_type IN ('view', 'click') THEN 'mcp' ELSE 'chat' END AS channel,
  CAST(floor(value * 10) AS BIGINT) AS input_tokens, CAST(floor(value * 3) AS BIGINT) AS output_tokens FROM events""", ()),
}


def _closure(names) -> list[str]:
    seen: list[str] = []

    def visit(n: str) -> None:
        for dep in VIEWS[n][1]:
            visit(dep)
        if n not in seen:
            seen.append(n)

    for n in names:
        visit(n)
    return seen


def with_views(names, body: str) -> str:
    """``WITH`` the named binding views (plus their dependencies), then ``body``.

    ``body`` is either a bare ``SELECT`` or more CTEs (``x AS (...) SELECT``).
    """
    parts = [f"{n} AS ({VIEWS[n][0].strip()})" for n in _closure(names)]
    b = body.strip()
    if b.upper().startswith("SELECT"):
        return "WITH " + ",\n".join(parts) + "\n" + b
    return "WITH " + ",\n".join(parts) + ",\n" + b
