"""Physical plan properties and the driver contract."""

import re
from pathlib import Path

import pytest

import __spark_entry__ as E
from trestle.config import Selection
from trestle.operators import aggregates as A
from trestle.operators import filters as FL
from trestle.operators import ranking as R
from trestle.plans import composites as Q
from trestle.plans import registry
from trestle.sources import staging

SF = "/root/testdata/sf0.001"


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def qs():
    return {k: f for k, f in E.queries().items() if k in registry.ENTRIES}


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["section", "name", "rank", "value", "detail"]


def test_every_query_has_an_oracle(qs):
    sqls = {k: s for k, s in E.oracle_sql().items() if k in registry.ENTRIES}
    assert set(sqls) <= set(E.queries())
    missing = set(qs) - set(sqls)
    assert not missing, missing


@pytest.mark.parametrize("name", sorted(registry.ENTRIES))
def test_no_python_udf_anywhere(spark, qs, name):
    plan = executed(qs[name](spark, SF))
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan and "PythonUDF" not in plan


def test_project_propagation_is_a_semi_join(spark, qs):
    plan = executed(qs["propagate_projects"](spark, SF))
    assert "LeftSemi" in plan


def test_top_k_uses_take_ordered(spark, qs):
    for name in ("top_performing_kpis", "top_items_by_risk"):
        assert "TakeOrderedAndProject" in executed(qs[name](spark, SF)), name


def test_per_group_top_k_is_limited_before_the_shuffle(spark, qs):
    plan = executed(qs["top_items_by_risk_per_phase"](spark, SF))
    assert "WindowGroupLimit" in plan


def test_dimension_joins_are_broadcast(spark, qs):
    for name in ("processes_with_default", "attach_definition", "category_impact"):
        assert "BroadcastHashJoin" in executed(qs[name](spark, SF)), name


def test_filters_reach_the_scan(spark, qs):
    plan = executed(qs["filter_process"](spark, SF))
    assert "PushedFilters: [IsNotNull(process_name), EqualTo(process_name,quality)]" in plan


def test_phase_partition_pruning(spark):
    facts = registry.raw_model(spark, SF)
    meta = A.project_meta(facts.phase_kpis("construction"), facts.row_order)  # as it is staged
    plan = executed(meta)
    assert "PartitionFilters: [isnotnull(phase" in plan and "(phase" in plan and "= construction)" in plan
    assert "SortAggregate" not in plan


def test_building_a_page_writes_nothing(spark, qs):
    root = staging.staging_root(spark)
    qs["project_meta"](spark, SF)  # loads the model

    def files():
        return sorted(str(p) for p in Path(root.removeprefix("file:")).rglob("*"))

    before = files()
    for name in ("portfolio_scoreboard", "project_meta", "process_kpi_table", "filter_value_range"):
        qs[name](spark, SF)
    assert files() == before


ROLLUPS = ("kpi_rollup", "kpi_coverage", "attach_coverage", "process_kpi_table", "process_kpi_report_card")


@pytest.mark.parametrize("broadcast", [True, False])
@pytest.mark.parametrize("name", ROLLUPS)
def test_rollups_read_the_facts_twice_and_hash(spark, qs, name, broadcast):
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for k in () if broadcast else keys:
        spark.conf.set(k, "-1")
    try:
        df = qs[name](spark, SF)
        df.collect()
        plan = executed(df)
    finally:
        for k in keys:
            spark.conf.unset(k)
    final = plan.split("== Initial Plan ==")[0]
    assert len(re.findall(r"FileScan parquet \[[^\]]*process_name", final)) == 2  # of the facts
    assert "SortAggregate" not in plan


def test_no_query_takes_a_subset_of_projects():
    for key in registry.ENTRIES:
        sql = E.oracle_sql()[key]
        for n in re.findall(r"LIMIT (\d+)", sql):
            assert int(n) in (5, 50), (key, n)  # top-5 lists and pages


def test_column_pruning(spark, qs):
    plan = executed(qs["parse_value"](spark, SF))
    assert "ReadSchema: struct<actual:string>" in plan


def test_scoreboard_reads_the_staged_meta(spark, qs):
    qs["project_meta"](spark, SF).count()  # staged at the first use
    for name in ("portfolio_scoreboard", "project_meta", "filter_value_range", "filter_start_date"):
        assert "SortAggregate" not in executed(qs[name](spark, SF)), name


def test_one_scan_for_all_facets_and_improvements(spark, qs):
    for name in ("facet_values", "phase_improvement", "phase_improvement_helper"):
        assert executed(qs[name](spark, SF)).count("FileScan") == 1, name


def test_people_lists_are_parsed_at_staging_only(spark, qs):
    m = registry.main_model(spark, SF)
    page = Q.executive_summary(spark, m, registry.MAIN, Selection(category="Schedule", person=registry.PERSON))
    for df in (page, qs["filter_person"](spark, SF), qs["facet_people"](spark, SF)):
        assert "lambda" not in executed(df)
    parsed = FL.filter_person(m.scorecard, registry.PERSON)
    assert "lambda" in executed(parsed)
    assert sorted(map(repr, parsed.collect())) == sorted(map(repr, FL.filter_person(m.scorecard, registry.PERSON, people=m.people).collect()))
    assert FL.filter_person(m.scorecard, "Nobody Here", people=m.people).count() == 0


def test_pages_merge_partial_states(spark, qs):
    for name in ("executive_summary", "phase_summary", "legacy_category_card"):
        plan = executed(qs[name](spark, SF))
        assert "weighted_sum" in plan or "_value_sum" in plan, name
        assert "kpi_wt" not in plan and "row_order" not in plan, name  # columns of the facts
    m = registry.raw_model(spark, SF)
    merged = R.kpi_metrics(m.states, ("phase",)).collect()
    direct = {(r.phase, r.kpi_name): r for r in R.kpi_metrics(m.kpis, ("phase",)).collect()}
    assert len(merged) == len(direct) > 10
    for r in merged:
        d = direct[r.phase, r.kpi_name]
        assert r.score_weighted == pytest.approx(d.score_weighted) and r.priority_metric == pytest.approx(d.priority_metric)
