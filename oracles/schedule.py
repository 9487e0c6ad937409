"""The weekly dispatch as one recursive query: each step settles one operation of every centre's queue.

Time is counted in hundredths of an hour from Monday's first; a queue is a list of structs in due order.
"""

from __future__ import annotations


def plan(capacity: str, pending: str, as_of: str) -> str:
    """CTEs ending in ``seg``, ``uns`` and ``cen``. ``capacity`` and ``pending`` are bare SELECTs."""
    return f"""
cap AS MATERIALIZED ({capacity}),
pend AS MATERIALIZED ({pending}),
monday AS (SELECT CAST(date_trunc('week', {as_of}) AS DATE) AS d0),
queue AS MATERIALIZED (SELECT wc_code, list({{'job': job_num, 'part': part_num, 'seq': oper_seq, 'fee': CAST(round(setup_hrs * 100) AS BIGINT),
    'run': CAST(round(prod_hrs * 100) AS BIGINT), 'due': due_date, 'fam': family}} ORDER BY due_date, job_num, oper_seq) AS q FROM pend GROUP BY wc_code),
step AS (
  SELECT c.wc_code, 0 AS n, CAST(round(c.effective_per_day * 100) AS BIGINT) AS e,
         CASE WHEN round(c.effective_per_day * 100) <= 1 THEN 5 * CAST(round(c.effective_per_day * 100) AS BIGINT) ELSE 0 END AS used,
         CASE WHEN round(c.effective_per_day * 100) <= 1 THEN 5 * CAST(round(c.effective_per_day * 100) AS BIGINT) ELSE 0 END AS lost,
         CAST(NULL AS VARCHAR) AS fam, coalesce(k.q, []) AS q, 0 AS paid, 0 AS saved, 0 AS early,
         CAST(NULL AS STRUCT(job VARCHAR, part VARCHAR, seq INTEGER, fee BIGINT, run BIGINT, due DATE, fam VARCHAR)) AS op,
         CAST(0 AS BIGINT) AS t0, CAST(0 AS BIGINT) AS t1, CAST(0 AS BIGINT) AS charged, false AS placed
  FROM cap c LEFT JOIN queue k USING (wc_code)
  UNION ALL
  SELECT wc_code, n + 1, e, used2 + crumb, lost + crumb, CASE WHEN ok THEN o.fam ELSE fam END, list_concat(q[:p - 1], q[p + 1:]),
         paid + CAST(ok AND fam IS NOT NULL AND charge > 0 AS INTEGER), saved + CAST(ok AND fam IS NOT NULL AND charge = 0 AS INTEGER),
         early + CAST(p > 1 AS INTEGER), o, used, used2, charge, ok
  FROM (SELECT *, CASE WHEN used2 % e > 0 AND e - used2 % e <= 1 THEN e - used2 % e ELSE 0 END AS crumb
    FROM (SELECT *, CASE WHEN NOT ok OR need <= 1 THEN used
                     WHEN least(used + need, 5 * e) % e = 1 AND (least(used + need, 5 * e) // e) * e > used THEN least(used + need, 5 * e) - 1
                     ELSE least(used + need, 5 * e) END AS used2
      FROM (SELECT *, charge + o.run AS need, (charge + o.run <= 1 OR used + charge + o.run - 5 * e <= 1) AS ok
        FROM (SELECT *, q[p] AS o, CASE WHEN q[p].fam = fam THEN 0 ELSE q[p].fee END AS charge
          FROM (SELECT *, CASE WHEN same > 1 AND q[same].due - q[1].due <= 4 THEN same ELSE 1 END AS p
            FROM (SELECT *, coalesce(list_position(list_transform(q, lambda x: x.fam), fam), 0) AS same
              FROM (SELECT wc_code, n, e, used, lost, fam, q, paid, saved, early FROM step) WHERE used < 5 * e AND len(q) > 0)))))) z),
final AS (SELECT * FROM step QUALIFY row_number() OVER (PARTITION BY wc_code ORDER BY n DESC) = 1),
done AS (SELECT s.*, s.charged + s.op.run AS need FROM step s WHERE s.op IS NOT NULL),
pieces AS (
  SELECT wc_code, op, charged, g.d AS day, least(t1, (g.d + 1) * e) - greatest(t0, g.d * e) AS cents, t0, t1, e
  FROM done, (SELECT unnest([0, 1, 2, 3, 4]) AS d) g WHERE placed AND t1 > t0 AND least(t1, (g.d + 1) * e) > greatest(t0, g.d * e)
  UNION ALL SELECT wc_code, op, charged, t0 // e, 0, t0, t0 + 1, e FROM done WHERE placed AND t1 = t0),
seg AS (SELECT wc_code, CAST(day AS INTEGER) AS day, CAST(m.d0 + CAST(day AS INTEGER) AS DATE) AS day_date, op.job AS job_num, op.part AS part_num, op.seq AS oper_seq,
    cents / 100.0 AS hours, (charged > 0 AND day = t0 // e) AS changeover, op.fam AS family, op.due AS due_date,
    (m.d0 + CAST((t1 - 1) // e AS INTEGER) > op.due) AS late FROM pieces, monday m),
missed AS (SELECT wc_code, op, (need + 5) // 10 AS tenths, (5 * e - t0 + lost + 5) // 10 AS free FROM done WHERE NOT placed
  UNION ALL SELECT wc_code, o, (o.fee + o.run + 5) // 10, NULL FROM (SELECT wc_code, unnest(q) AS o FROM final)),
uns AS (SELECT op.job AS job_num, op.part AS part_num, op.seq AS oper_seq, wc_code, tenths / 10.0 AS hours_needed, op.due AS due_date,
    CASE WHEN free IS NULL THEN wc_code || ' is fully committed for the week before this operation is reached.'
         ELSE wc_code || ' has no remaining capacity this week — ' || {_num('tenths')} || ' hrs needed, ' || {_num('free')} || ' hrs free across the week.' END AS reason
  FROM missed),
cen AS (SELECT c.wc_code, c.description, c.dept, c.capacity_per_day, c.effective_per_day, c.downtime_discount_pct, h.hours_scheduled,
    CASE WHEN c.effective_per_day > 0 THEN floor(h.hours_scheduled / (c.effective_per_day * 5) * 100 * 10.0 + 0.5) / 10.0 ELSE 0.0 END AS utilization_pct,
    CAST(f.paid AS INTEGER) AS changeovers, CAST(f.saved AS INTEGER) AS setups_saved, CAST(f.early AS INTEGER) AS resequenced, h.hours_scheduled > 0 AS active
  FROM cap c JOIN final f USING (wc_code)
  JOIN (SELECT c2.wc_code, CAST(floor(coalesce(sum(round(s.hours * 100)), 0) / 10 + 0.5) AS BIGINT) / 10.0 AS hours_scheduled
        FROM cap c2 LEFT JOIN seg s USING (wc_code) GROUP BY 1) h USING (wc_code))
"""


def _num(tenths: str) -> str:
    return f"(CASE WHEN {tenths} % 10 = 0 THEN CAST({tenths} // 10 AS VARCHAR) ELSE CAST({tenths} // 10 AS VARCHAR) || '.' || CAST({tenths} % 10 AS VARCHAR) END)"


_TOTALS = """SELECT CAST((SELECT sum(CAST(hours_scheduled AS DECIMAL(18,1))) FROM cen) AS DOUBLE) AS hours_scheduled,
        CAST(u.h AS DOUBLE) AS hours_unscheduled, u.n AS operations_unscheduled, s.n AS operations_scheduled, s.late AS late_operations,
        CAST(u.h AS DOUBLE) AS overtime_hours_needed
      FROM (SELECT coalesce(sum(CAST(hours_needed AS DECIMAL(18,1))), 0) AS h, count(*) AS n FROM uns) u,
           (SELECT count(*) AS n, count(*) FILTER (WHERE late) AS late FROM (SELECT wc_code, job_num, oper_seq, max(late) AS late FROM seg GROUP BY ALL)) s"""

#: Query key -> what it selects from the plan.
SELECTS = {
    "schedule_segments": "SELECT * FROM seg",
    "schedule_centres": "SELECT * FROM cen",
    "schedule_unscheduled": "SELECT * FROM uns",
    "schedule_totals": _TOTALS,
    "schedule_day_usage": """SELECT s.wc_code, s.day, s.day_date, CAST(sum(CAST(s.hours AS DECIMAL(18,2))) AS DOUBLE) AS used_hrs, any_value(c.effective_per_day) AS effective_per_day
      FROM seg s JOIN cap c USING (wc_code) GROUP BY 1, 2, 3""",
    "schedule_families": "SELECT DISTINCT family FROM seg",
    "schedule_fingerprint": """SELECT CAST(sum(CAST(('0x' || substr(h, 1, 15)) AS HUGEINT)) AS VARCHAR) AS digest, count(*) AS rows FROM (
        SELECT sha256(concat_ws('|', 'segment', wc_code, CAST(day AS VARCHAR), job_num, CAST(oper_seq AS VARCHAR), CAST(CAST(hours AS DOUBLE) AS VARCHAR), CAST(changeover AS VARCHAR), CAST(late AS VARCHAR))) AS h FROM seg
        UNION ALL
        SELECT sha256(concat_ws('|', 'centre', wc_code, dept, CAST(CAST(hours_scheduled AS DOUBLE) AS VARCHAR), CAST(CAST(utilization_pct AS DOUBLE) AS VARCHAR), CAST(CAST(effective_per_day AS DOUBLE) AS VARCHAR),
            CAST(CAST(capacity_per_day AS DOUBLE) AS VARCHAR), CAST(CAST(downtime_discount_pct AS DOUBLE) AS VARCHAR), CAST(changeovers AS VARCHAR), CAST(setups_saved AS VARCHAR), CAST(resequenced AS VARCHAR))) FROM cen
        UNION ALL
        SELECT sha256(concat_ws('|', 'total', CAST(operations_scheduled AS VARCHAR), CAST(hours_scheduled AS VARCHAR), CAST(operations_unscheduled AS VARCHAR), CAST(hours_unscheduled AS VARCHAR), CAST(late_operations AS VARCHAR)))
        FROM (""" + _TOTALS + """)
        UNION ALL
        SELECT sha256(concat_ws('|', 'unscheduled', job_num, CAST(oper_seq AS VARCHAR), wc_code, CAST(CAST(hours_needed AS DOUBLE) AS VARCHAR), CAST(due_date AS VARCHAR))) FROM uns)""",
}
