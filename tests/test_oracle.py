"""Every registered query against its DuckDB oracle on the sf0.001 tables.

Same comparison as the driver's correctness gate: column names, row count
and the order-insensitive multiset of (normalised) rows.
"""

import math

import duckdb
import pytest

import __spark_entry__ as E
from trestle.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def canon(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        return (1, "nan") if math.isnan(v) else (2, repr(round(v, 6)))
    if isinstance(v, (list, tuple)):
        return (3, repr([canon(x) for x in v]))
    return (4, str(v))


@pytest.mark.parametrize("name", sorted(k for k in E.oracle_sql() if k in registry.ENTRIES))
def test_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    idx = [ocols.index(c) for c in df.columns]
    assert sorted(tuple(canon(v) for v in r) for r in rows) == sorted(tuple(canon(r[i]) for i in idx) for r in orows)


COMPOSITES = ("executive_summary", "portfolio_scoreboard", "phase_summary", "process_kpi_table",
              "process_kpi_report_card", "legacy_category_card", "cost_improvement_card", "action_item_list",
              "propagate_projects", "scoreboard", "project_meta")


@pytest.fixture()
def no_broadcast(spark):
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    old = {k: spark.conf.get(k, None) for k in keys}
    for k in keys:
        spark.conf.set(k, "-1")
    yield spark
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


@pytest.mark.parametrize("name", COMPOSITES)
def test_matches_oracle_with_shuffle_joins(no_broadcast, con, name):
    """The plans a large cluster runs (no side small enough to broadcast)."""
    test_matches_oracle(no_broadcast, con, name)
    plan = E.queries()[name](no_broadcast, SF)._jdf.queryExecution().executedPlan().toString()
    if name == "propagate_projects":
        assert "SortMergeJoin" in plan and "LeftSemi" in plan


def test_the_rollup_by_part_leaves_no_project_out(spark):
    kpis = registry.raw_model(spark, SF).kpis
    out = E.queries()["kpi_rollup_by_part"](spark, SF)
    assert out.select("l_partkey").distinct().count() == kpis.where("process_name is not null").select("l_partkey").distinct().count()
    assert {r["is_averaged"] for r in out.select("is_averaged").distinct().collect()} == {True, False}
