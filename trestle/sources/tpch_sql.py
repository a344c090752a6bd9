"""SQL twin of ``trestle.sources.tpch`` for the DuckDB oracle.

The oracle only sees the raw test tables, so every oracle string starts with
these CTEs.  The text runs unchanged in DuckDB and Spark SQL.
"""

from __future__ import annotations

from trestle.sources.tpch import KPI_BY_BRAND

ADAPTER_CTES = """
ctx AS (
  SELECT c.c_custkey, c.c_acctbal, r.r_name AS region, n.n_name AS projectManager,
         c.c_mktsegment AS office_name, concat('PgM ', r.r_name) AS program_manager,
         CASE WHEN c.c_acctbal < 0 THEN 'Closeout' WHEN c.c_acctbal < 3000 THEN 'Construction'
              WHEN c.c_acctbal < 6000 THEN 'Preconstruction' ELSE 'Bidding' END AS project_stage,
         concat('Lead', CAST(n.n_nationkey AS string), ' (7-', CAST(c.c_custkey % 9 AS string), ') Ann, ',
                'Reed', CAST(r.r_regionkey AS string), ' Bo, Cher') AS people,
         c.c_custkey % 2 AS name_flag,
         concat('$', CAST(CAST(round(abs(c.c_acctbal)) AS int) AS string), ',000') AS projValueText
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
       JOIN region r ON n.n_regionkey = r.r_regionkey
),
kpis AS (
  SELECT concat('P-', repeat('0', greatest(0, 8 - length(CAST(o.o_custkey AS string)))), CAST(o.o_custkey AS string)) AS projectId,
         x.region, x.projectManager, x.office_name, x.program_manager, x.project_stage,
         CASE o.o_orderpriority WHEN '1-URGENT' THEN 'Schedule' WHEN '2-HIGH' THEN 'Cost'
              WHEN '3-MEDIUM' THEN 'Safety' WHEN '4-NOT SPECIFIED' THEN 'GL Insurance'
              ELSE 'WC Insurance' END AS impact_category,
         CASE WHEN l.l_linenumber <= 2 THEN 'bidding' WHEN l.l_linenumber <= 4 THEN 'preconstruction'
              WHEN l.l_linenumber <= 6 THEN 'construction' ELSE 'closeout' END AS phase,
         l.l_returnflag AS process_code,
         CASE WHEN l.l_linenumber <= 2 THEN
                CASE l.l_returnflag WHEN 'A' THEN 'bidreview' WHEN 'N' THEN 'estimating' WHEN 'R' THEN 'compliance' END
              WHEN l.l_linenumber <= 4 THEN
                CASE l.l_returnflag WHEN 'A' THEN 'financialSetup' WHEN 'N' THEN 'designReview' WHEN 'R' THEN 'compliance' END
              WHEN l.l_linenumber <= 6 THEN
                CASE l.l_returnflag WHEN 'A' THEN 'operations' WHEN 'N' THEN 'quality' WHEN 'R' THEN 'safety' END
              ELSE
                CASE l.l_returnflag WHEN 'A' THEN 'finalDocumentation' WHEN 'N' THEN 'punchlistCompletion'
                     WHEN 'R' THEN 'financialReconciliation' END
         END AS process_name,
         CASE p.p_brand @KPI_BY_BRAND@ ELSE p.p_brand END AS kpi_name,
         CASE WHEN l.l_discount = 0 THEN 'n/a'
              ELSE concat(CAST(CAST(round(l.l_discount * 100) AS int) AS string), ' %') END AS actual,
         CASE WHEN p.p_brand < 'Brand#2' THEN '%' ELSE 'days' END AS unit,
         concat('>= ', substr(p.p_brand, 7)) AS bp_range_display,
         l.l_quantity * 2 AS score,
         100 - l.l_quantity * 2 AS unrealized_value,
         (100 - l.l_quantity * 2) * l.l_tax AS process_level_unrealized_value,
         (100 - l.l_quantity * 2) * l.l_tax / 4 AS phase_level_unrealized_value,
         l.l_linenumber AS kpi_wt,
         x.projValueText AS ProjValue,
         CAST(CAST(o.o_orderdate AS date) AS string) AS startDate,
         CAST(CAST(l.l_shipdate AS date) AS string) AS endDate,
         x.people, x.name_flag,
         l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
       JOIN ctx x ON o.o_custkey = x.c_custkey
       JOIN part p ON l.l_partkey = p.p_partkey
),
scorecard AS (
  SELECT projectId, region, projectManager, office_name, program_manager, project_stage,
         people AS project_managers, name_flag, impact_category,
         avg(score) AS score,
         avg(CASE WHEN phase = 'bidding' THEN score END)         AS phaseScore_bidding,
         avg(CASE WHEN phase = 'preconstruction' THEN score END) AS phaseScore_precon,
         avg(CASE WHEN phase = 'construction' THEN score END)    AS phaseScore_construction,
         avg(CASE WHEN phase = 'closeout' THEN score END)        AS phaseScore_closeout
  FROM kpis GROUP BY projectId, region, projectManager, office_name, program_manager, project_stage,
                     people, name_flag, impact_category
),
processes AS (
  SELECT projectId, phase, process_name, impact_category, name_flag, avg(score) AS score
  FROM kpis GROUP BY projectId, phase, process_name, impact_category, name_flag
),
action_items AS (
  SELECT e.event_id, CASE WHEN e.user_id IS NOT NULL THEN concat('P-', repeat('0', greatest(0, 8 - length(CAST(e.user_id AS string)))), CAST(e.user_id AS string)) END AS projectId,
         x.region, x.projectManager, x.office_name, x.program_manager, x.project_stage,
         x.people AS project_managers, x.projectManager AS project_manager, x.name_flag,
         CASE WHEN hour(e.ts) < 8 THEN 'Schedule' WHEN hour(e.ts) < 16 THEN 'Cost' ELSE 'Safety' END AS impact_category,
         CASE e.event_type WHEN 'click' THEN 'rfi' WHEN 'view' THEN 'submittal' WHEN 'error' THEN 'incident'
              WHEN 'purchase' THEN 'prime_contract_change_order' ELSE 'punch_item' END AS item_type,
         concat(CAST(e.event_id AS string), ' - ', e.event_type, ' - Open') AS risky_id,
         e.value AS risk_value, e.value AS weight,
         concat('Resolve open ', e.event_type, ' item') AS required_action
  FROM events e LEFT JOIN ctx x ON e.user_id = x.c_custkey
)
"""


ADAPTER_CTES = ADAPTER_CTES.replace("@KPI_BY_BRAND@", " ".join(f"WHEN '{b}' THEN '{n}'" for b, n in KPI_BY_BRAND))


def with_adapter(body: str) -> str:
    """Prefix a query body (which may start with more CTEs) with the adapter.

    ``body`` is either ``"SELECT ..."`` or ``", extra AS (...) SELECT ..."``.
    """
    body = body.strip()
    if body.startswith(","):
        return "WITH " + ADAPTER_CTES.strip() + "\n" + body
    return "WITH " + ADAPTER_CTES.strip() + "\n" + body
