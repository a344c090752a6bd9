"""Operator semantics: the pandas traps and shape tests (§5)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from trestle.config import Selection
from trestle.operators import aggregates as A
from trestle.operators import cleaning as C
from trestle.operators import filters as FL
from trestle.operators import joins as J
from trestle.operators import ranking as R
from trestle.operators.scoreboard import scoreboard


KPI_SCHEMA = ("projectId string, phase string, process_name string, kpi_name string, actual string, unit string, "
              "bp_range_display string, score double, unrealized_value double, rk int")


def kpis(spark, rows):
    return spark.createDataFrame(rows, KPI_SCHEMA)


def test_t1_nan_is_skipped_like_null(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,)], "score double")
    assert A.overall_score(df).first()[0] == 2.0


def test_t2_null_keys_dropped(spark):
    df = spark.createDataFrame([("p", "a", 1.0), ("p", None, 5.0)], "phase string, process_name string, score double")
    got = A.process_scores(df, ("phase",)).collect()
    assert [(r.process_name, r.process_score) for r in got] == [("a", 1.0)]


def test_t3_ties_break_on_kpi_name(spark):
    df = kpis(spark, [("P1", "x", "a", k, "1", "", "", 10.0, 1.0, i) for i, k in enumerate("EDCBAF")])
    top = R.top_performing_kpis(df)
    assert [r.kpi_name for r in top.orderBy("rank").collect()] == ["A", "B", "C", "D", "E"]


def test_t6_t7_first_is_per_column_first_non_null(spark):
    df = spark.createDataFrame(
        [("P1", None, "2020-01-01", None, 1), ("P1", "$5", "2020-02-01", "2020-03-01", 2),
         ("P2", "$1,000", None, None, 1)],
        "projectId string, ProjValue string, startDate string, endDate string, rk int")
    meta = {r.projectId: r for r in A.project_meta(df, ("rk",)).collect()}
    assert meta["P1"].projValue == 5.0 and meta["P1"].startDate == dt.date(2020, 1, 1)
    assert meta["P1"].endDate == dt.date(2020, 3, 1)
    assert meta["P2"].projValue == 1000.0 and meta["P2"].startDate is None


def test_t11_exclude_in_process_keeps_nulls(spark):
    df = spark.createDataFrame(
        [("construction", "safety", "Near Miss Rate "), ("construction", "quality", "near miss rate"),
         ("construction", None, "near miss rate"), ("construction", "Safety", None)],
        "phase string, process_name string, kpi_name string")
    out = C.exclude_kpis_in_process(df, "construction", "safety", ("near miss rate", "near miss detail quality"))
    assert out.count() == 3
    assert out.where(F.col("kpi_name") == "Near Miss Rate ").count() == 0


def test_t12_zero_fill_vs_null_skip(spark):
    df = kpis(spark, [("P1", "p", "a", "K", "1", "", "", 10.0, 1.0, 1), ("P2", "p", "a", "K", "1", "", "", None, 1.0, 2)])
    a8 = R.top_performing_kpis(df).first()
    assert a8.score_weighted == 5.0
    a5 = A.kpi_rollup(df, ("phase", "process_name"), ("rk",)).first()
    assert a5.score == 10.0


def test_t13_search_is_regex_and_case_insensitive(spark):
    df = spark.createDataFrame([("North-East",), ("south",), (None,)], "Segment string")
    assert [r[0] for r in FL.search_segments(df, "^NORTH.*east$").collect()] == ["North-East"]
    assert FL.search_segments(df, "  ").count() == 3


def test_t14_nan_grades_f(spark):
    from trestle.functions.scoring import grade

    df = spark.createDataFrame([(float("nan"),)], "s double")
    assert df.select(grade("s")).first()[0] == "F"


def test_t17_t18_extract_and_power_edges(spark):
    from trestle.functions.scoring import phase_improvement

    df = spark.createDataFrame([(-4.0,)], "s double")
    assert df.select(phase_improvement("s", "construction", "power")).first()[0] is None


def test_t21_na_words_at_csv_ingest(spark, tmpdir_path):
    from trestle.sources import files

    path = f"{tmpdir_path}/t.csv"
    with open(path, "w") as fh:
        fh.write("projectId,score,score,note\nP1,NA,7,N/A\nP2,3.5,8,ok\nP3,1d,9,null\n")
    df = files.read_csv(spark, path, files.SCORECARD_SCHEMA)
    assert df.columns == ["projectId", "score", "note"]  # C1: first of repeated names
    got = [tuple(r) for r in df.orderBy("projectId").collect()]
    assert got == [("P1", None, None), ("P2", 3.5, "ok"), ("P3", None, None)]


def test_t22_process_default_absent_vs_all_null(spark):
    means = spark.createDataFrame(
        [("bidding", "bidreview", 7.0), ("bidding", "estimating", None)], "phase string, process_name string, process_score double")
    got = {r.process_name: r.process_score for r in J.processes_with_default(spark, means, ("bidding",)).collect()}
    assert got == {"bidreview": 7.0, "estimating": None, "compliance": 0.0, "bidresults": 0.0}


@pytest.mark.parametrize(
    "n,expected",
    [
        (0, []),
        (1, ["High"]),
        (2, ["High", "Low"]),
        (4, ["High", "Average", "Average", "Low"]),
        (5, ["High", "High", "Average", "Low", "Low"]),
        (6, ["High", "High", "Average", "Average", "Low", "Low"]),
    ],
)
def test_w2_priority_labels(spark, n, expected):
    rows = [("K%02d" % i, float(100 - i)) for i in range(n)]
    df = spark.createDataFrame(rows, "kpi_name string, unrealized_value double")
    got = [r.impact_label for r in R.priority_label(df).orderBy("position").collect()]
    assert got == expected


def test_w2_labels_per_group_and_nulls_as_zero(spark):
    df = spark.createDataFrame([("g1", "a", None), ("g1", "b", 3.0), ("g2", "c", 1.0)],
                               "g string, kpi_name string, unrealized_value double")
    got = {(r.g, r.kpi_name): (r.impact_label, r.unrealized_value) for r in R.priority_label(df, ("g",)).collect()}
    assert got == {("g1", "b"): ("High", 3.0), ("g1", "a"): ("Low", 0.0), ("g2", "c"): ("High", 1.0)}


def test_w1_priority_rank(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None), ("c", 5.0), ("d", 5.0)], "kpi_name string, unrealized_value double")
    got = [(r.kpi_name, r.priority) for r in R.priority_rank(df).orderBy("priority").collect()]
    assert got == [("c", 1), ("d", 2), ("a", 3), ("b", 4)]


@pytest.mark.parametrize("n,page,rows_on_page,clamped",
                         [(0, 0, 0, 0), (1, 0, 1, 0), (50, 0, 50, 0), (51, 1, 1, 1), (51, 9, 1, 1), (120, -3, 50, 0)])
def test_l1_paging(spark, n, page, rows_on_page, clamped):
    df = spark.createDataFrame([(f"S{i:03d}",) for i in range(n)], "Segment string").orderBy("Segment")
    assert R.page_bounds(n, page)[0] == clamped
    assert R.page(df, page, n).count() == rows_on_page


def test_a6_coverage_rows_vs_projects(spark):
    rows = [("P1", "p", "a", "K1", "1", "", "", 1.0, 1.0, 1), ("P1", "p", "a", "K1", "2", "", "", 1.0, 1.0, 2),
            ("P2", "p", "a", "K1", "3", "", "", 1.0, 1.0, 3)]
    df = kpis(spark, rows)
    by_rows = A.kpi_rollup(df, ("phase", "process_name"), ("rk",), with_coverage=True).first()
    by_projects = A.kpi_rollup(df, ("phase", "process_name"), ("rk",), with_coverage=True, coverage_basis="projects").first()
    assert by_rows.percent_of_projects == 150.0 and by_projects.percent_of_projects == 100.0


def test_a5_single_project_keeps_rows(spark):
    rows = [("P1", "p", "a", "K1", "10%", "%", ">=1", 0.5, 2.0, 1), ("P1", "p", "a", "K1", "20%", "%", ">=1", 0.7, 1.0, 2)]
    out = A.kpi_rollup(kpis(spark, rows), ("phase", "process_name"), ("rk",)).collect()
    assert len(out) == 2 and all(not r.is_averaged for r in out)
    assert sorted(r.actual_numeric for r in out) == [10.0, 20.0]


def test_a5_three_projects_some_without_names(spark):
    rows = [("P1", "p", "a", "K1", "1", "%", "A", 1.0, 1.0, 1), ("P2", "p", "a", "K1", "3", None, "B", 2.0, 1.0, 2),
            ("P2", "p", "a", None, "9", "%", "C", 3.0, 1.0, 3), ("P3", "p", "b", "K1", "4", "d", "D", 4.0, 1.0, 4),
            ("P3", "p", "b", None, "5", None, None, 5.0, 1.0, 5), ("P3", "p", "b", "K1", "6", "d", "D", 6.0, 1.0, 6)]
    df = kpis(spark, rows)
    wanted = [("a", "K1", 2.0, 1.5, "%", "A", True), ("b", "K1", 4.0, 4.0, "d", "D", False),
              ("b", "K1", 6.0, 6.0, "d", "D", False), ("b", None, 5.0, 5.0, None, None, False)]
    for words in (None, A.text_words(df, ("bp_range_display", "unit"))):
        out = A.kpi_rollup(df, ("phase", "process_name"), ("rk",), words=words).collect()
        got = [(r.process_name, r.kpi_name, r.actual_numeric, r.score, r.unit, r.bp_range_display, r.is_averaged) for r in out]
        assert sorted(got, key=repr) == sorted(wanted, key=repr)
        alone = A.kpi_rollup(df.where("projectId = 'P2'"), (), ("rk",), words=words).collect()
        assert [(r.kpi_name, r.is_averaged) for r in sorted(alone, key=lambda r: r.score)] == [("K1", False), (None, False)]


def test_a5_first_unit_in_row_order(spark):
    rows = [("P1", "p", "a", "K1", "1", None, "B", 1.0, 1.0, 5), ("P2", "p", "a", "K1", "2", "days", "A", 3.0, 1.0, 9),
            ("P2", "p", "a", "K1", "2", "%", "C", 3.0, 1.0, 7)]
    r = A.kpi_rollup(kpis(spark, rows), ("phase", "process_name"), ("rk",)).first()
    assert (r.unit, r.bp_range_display, r.score, r.actual_numeric) == ("%", "B", 7.0 / 3, 5.0 / 3)


def test_a10_a12_top_gap_suppressed_when_zero(spark):
    df = spark.createDataFrame([("K1", 0.0), ("K2", 0.0), ("K3", None)], "kpi_name string, phase_level_unrealized_value double")
    assert R.top_gap(df, "phase_level_unrealized_value").count() == 0
    df2 = spark.createDataFrame([("K1", 2.0), ("K2", None)], "kpi_name string, phase_level_unrealized_value double")
    assert [r.kpi_name for r in R.top_gap(df2, "phase_level_unrealized_value").collect()] == ["K1"]


def test_a9_without_metric_column_is_none(spark):
    df = spark.createDataFrame([("K1", 1.0)], "kpi_name string, score double")
    assert R.top_priority_kpis(df) is None


def test_a8_weight_falls_back_to_one(spark):
    df = spark.createDataFrame([("K1", 4.0), ("K1", None)], "kpi_name string, score double")
    assert R.top_performing_kpis(df).first().score_weighted == 2.0


def test_a14_scoreboard_counts_each_project_once(spark):
    sc = spark.createDataFrame(
        [("P1", "N", 10.0), ("P1", "N", 20.0), ("P2", "N", 30.0), ("P3", "S", 40.0)],
        "projectId string, region string, score double")
    meta = spark.createDataFrame(
        [("P1", 100.0, dt.date(2020, 1, 1), dt.date(2021, 1, 1)), ("P2", None, dt.date(2019, 1, 1), None)],
        "projectId string, projValue double, startDate date, endDate date")
    got = {r.Segment: r for r in scoreboard(sc, meta, "Region").collect()}
    assert got["N"].cr_score == 20.0 and got["N"].est_project_value == 100.0
    assert got["N"].est_start_date == dt.date(2019, 1, 1) and got["N"].est_end_date == dt.date(2021, 1, 1)
    assert got["S"].est_project_value is None and got["S"].est_start_date is None


def test_o1_sort_nulls_last_both_ways(spark):
    df = spark.createDataFrame([("a", None), ("b", 2.0), ("c", 1.0)], "Segment string, est_project_value double")
    asc = [r.Segment for r in R.sort_scoreboard(df, "est_project_value", True).collect()]
    desc = [r.Segment for r in R.sort_scoreboard(df, "est_project_value", False).collect()]
    assert asc == ["c", "b", "a"] and desc == ["b", "c", "a"]


def test_filters_and_selection(spark):
    sc = spark.createDataFrame(
        [("P1", "N", "M1", "Cost", 1, "Stone (1-1) Ann", 10.0), ("P2", "S", "M2", "Cost", 0, None, 20.0),
         ("P3", "N", "M1", "Safety", 0, "Reed Bo", 30.0)],
        "projectId string, region string, projectManager string, impact_category string, name_flag int, "
        "project_managers string, score double")
    assert FL.apply_selection(sc, Selection(region="N")).count() == 2
    assert FL.apply_selection(sc, Selection(person="Ann Stone")).count() == 1
    assert FL.apply_selection(sc, Selection(person="Bo Reed", region="N")).count() == 1
    assert FL.apply_selection(sc, Selection(name_flag="exclude")).count() == 2
    assert FL.apply_selection(sc, Selection(name_flag="only")).count() == 1
    assert FL.filter_category(FL.apply_selection(sc, Selection()), "Cost").count() == 2
    # value filter without meta keeps nothing (the newest dashboard's behaviour)
    assert FL.apply_selection(sc, Selection(strict_value_range=True)).count() == 0
    meta = spark.createDataFrame([("P1", 5.0e6, dt.date(2020, 1, 1)), ("P2", None, dt.date(2021, 1, 1))],
                                 "projectId string, projValue double, startDate date")
    assert FL.apply_selection(sc, Selection(value_range=(1e6, None)), meta).count() == 1
    assert FL.apply_selection(sc, Selection(start_range=(dt.date(2020, 6, 1), dt.date(2021, 6, 1))), meta).count() == 1
    facts = spark.createDataFrame([("P1", 1), ("P3", 2), ("P9", 3)], "projectId string, v int")
    kept = FL.propagate_projects(facts, FL.apply_selection(sc, Selection(region="N")))
    assert sorted(r.v for r in kept.collect()) == [1, 2]
    assert FL.propagate_projects(facts, sc.where("false")).count() == 0


def test_c2_c3_c4_c6_c7(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("b", "x")], "project_id string, kpi_name string")
    assert C.drop_dup_rows(df).count() == 2
    assert C.canonical_names(df).columns[0] == "projectId"
    assert C.tag_phase(df, "bidding").first().phase_label == "Bidding"
    kept = C.exclude_kpis(df, ("x",))
    assert kept.count() == 2  # null names kept
    flagged = spark.createDataFrame([(0,), (1,), (None,)], "name_flag int")
    assert C.exclude_flagged(flagged).count() == 1
    assert C.exclude_flagged(df).count() == 3  # no flag column: no-op


def test_u1_union_needs_every_phase(spark):
    a = spark.createDataFrame([("P1", 1.0), ("P1", 1.0)], "projectId string, score double")
    b = spark.createDataFrame([("P2", "x")], "projectId string, unit string")
    assert R.all_phase_kpis({"a": a}, ("a", "b")) is None
    u = R.all_phase_kpis({"a": a, "b": b}, ("a", "b"))
    assert u.count() == 2 and set(u.columns) == {"projectId", "score", "unit"}


def test_hand_golden_schedule_means(spark):
    """FIXTURES §2 'schedule means', on re-created rows of our own."""
    from trestle.config import PHASE_SCORE_COLUMNS_MAIN

    rows = [
        ("P1", "Schedule", 40.0, 30.0, 48.0, 41.0, 42.0),
        ("P2", "Schedule", 42.63335, 34.6, 49.733, 42.7204, 42.48),
        ("P3", "Cost", 99.0, 99.0, 99.0, 99.0, 99.0),
    ]
    sc = spark.createDataFrame(
        rows, "projectId string, impact_category string, score double, phaseScore_bidding double, "
              "phaseScore_precon double, phaseScore_construction double, phaseScore_closeout double")
    summary = FL.filter_category(sc, "Schedule")
    assert round(A.overall_score(summary).first()[0], 6) == 41.316675
    phases = {r.phase: round(r.phase_score, 6) for r in A.phase_components(summary, PHASE_SCORE_COLUMNS_MAIN).collect()}
    assert phases == {"bidding": 32.3, "preconstruction": 48.8665, "construction": 41.8602, "closeout": 42.24}


def test_f10_main_item_filter_and_counts(spark):
    from trestle.operators import items as IT

    items = spark.createDataFrame(
        [("P1", "N", "M1", "Cost", 3.0, 1), ("P2", "N", "M2", "Cost", 5.0, 2), ("P3", "S", "M1", "Safety", 9.0, 3)],
        "projectId string, region string, projectManager string, impact_category string, weight double, event_id long")
    kept = IT.filter_items_main(items, Selection(region="N"), "Cost")
    assert sorted(r.projectId for r in kept.collect()) == ["P1", "P2"]
    counts = IT.filter_counts(items, kept).first()
    assert (counts.original_count, counts.filtered_count) == (3, 2)
    top = IT.top_items_by_weight(items, k=2).orderBy("rank").collect()
    assert [r.event_id for r in top] == [3, 2]


def test_f10_optional_columns_are_skipped(spark):
    from trestle.operators import items as IT

    items = spark.createDataFrame([("P1", "A"), ("P2", "B")], "projectId string, office_name string")
    # no project_stage column: that filter is silently disabled
    got = IT.filter_items_optional(items, Selection(office="A", stage="Closeout"))
    assert [r.projectId for r in got.collect()] == ["P1"]


def test_value_slider_labels():
    from trestle.config import value_label_to_number, value_options

    opts = value_options()
    assert opts[0] == "$0" and opts[3] == "$1,000,000" and opts[-1] == "> $1,000,000,000"
    assert value_label_to_number("$5,000,000") == 5e6 and value_label_to_number(opts[-1]) is None


def test_j4_definition_lookup_modes(spark):
    df = spark.createDataFrame([("RFIs Lead Time",), ("rfis lead time",), ("Unknown KPI",)], "kpi_name string")
    lower = {r.kpi_name: r.definition for r in J.attach_definition(spark, df).collect()}
    assert lower["RFIs Lead Time"] == lower["rfis lead time"] != lower["Unknown KPI"]
    assert "Unknown KPI" in lower["Unknown KPI"]
    from trestle.sources import dims

    # the cloud dashboards look names up as written; this one is in the longer of their lists
    for more in (False, True):
        rows = J.attach_definition(spark, df, fallback="fixed", exact_case=True, more_names=more).collect()
        exact = {r.kpi_name: r.definition for r in rows}
        assert (exact["RFIs Lead Time"] != dims.NO_DEFINITION) == more and exact["rfis lead time"] == dims.NO_DEFINITION


def test_kpi_texts_reach_every_branch(spark):
    from trestle.sources import dims
    from trestle.sources.tpch import KPI_BY_BRAND

    assert len(dims.KPI_NAMES) == len(set(dims.KPI_NAMES)) == 69
    names = [n for _, n in KPI_BY_BRAND] + ["Brand#13"]
    df = spark.createDataFrame([(n,) for n in names], "kpi_name string")
    got = {r.kpi_name: r.guidance for r in J.attach_guidance(spark, df).collect()}
    rules = {text for *_, text in dims.GUIDANCE_RULES}
    assert rules <= set(got.values()) and got["Brand#13"] == dims.DEFAULT_GUIDANCE
    exact = [n for n in names if n.lower() in dims.KPI_NAMES]
    assert len(exact) == 3 and all(got[n] not in rules for n in exact)


def test_a_deployments_own_texts(spark, tmpdir_path):
    from trestle.sources import dims

    with open(f"{tmpdir_path}/kpi_texts.csv", "w") as fh:
        fh.write('kpi_key,definition,guidance\n Cost Variance ,"our own, quoted",ours\ncost variance,second,two\n')
    own = dims.kpi_text_from_csv(spark, f"{tmpdir_path}/kpi_texts.csv")
    df = spark.createDataFrame([("COST VARIANCE",), ("other",)], "kpi_name string")
    got = {r.kpi_name: r for r in J.attach_strength(spark, J.attach_guidance(spark, df, texts=own), texts=own).collect()}
    assert len(got) == 2 and got["COST VARIANCE"].guidance in ("ours", "two")
    assert got["COST VARIANCE"].strength == got["other"].strength == dims.DEFAULT_STRENGTH


def test_a5_coverage_without_projects_is_null_not_an_error(spark):
    rows = [(None, "p", "a", "K1", "1", "", "", 1.0, 1.0, 1)]
    r = A.kpi_rollup(kpis(spark, rows), ("phase", "process_name"), ("rk",), with_coverage=True).first()
    assert r.percent_of_projects is None and not r.is_averaged


def test_l1_pages_in_one_plan(spark):
    df = spark.range(123).withColumn("id", F.col("id")).orderBy(F.col("id").desc())

    def ids(n):
        return [r.id for r in R.page(df, n, rows_per_page=50).collect()]

    assert ids(0) == list(range(122, 72, -1)) and ids(1) == list(range(72, 22, -1))
    assert ids(2) == ids(9) == list(range(22, -1, -1))  # clamped to the last page
    assert [r.id for r in R.page(spark.range(100).orderBy("id"), 7, rows_per_page=50).collect()] == list(range(50, 100))
    assert R.page(df.where("id < 0"), 3).collect() == []
