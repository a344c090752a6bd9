"""Column helpers on the hand-made frames of FIXTURES.md §2."""

import datetime as dt

from pyspark.sql import functions as F

from trestle.functions import display, parse, scoring


def one_col(spark, values, typ="string"):
    return spark.createDataFrame([(v,) for v in values], f"x {typ}")


def test_parse_value(spark):
    df = one_col(spark, ["85%", " 12.5 ", "abc", "", None, "1d", "1,000"])
    got = [r[0] for r in df.select(parse.parse_value("x")).collect()]
    assert got == [85.0, 12.5, None, None, None, None, None]


def test_parse_money(spark):
    df = one_col(spark, ["$1,234.50", "900", "n/a"])
    got = [r[0] for r in df.select(parse.parse_money("x")).collect()]
    assert got == [1234.5, 900.0, None]


def test_parse_people(spark):
    df = one_col(spark, ["Stone (11-2) Ann, Reed Bo, Cher, De La Cruz Ana", None, "", "Bowen (110-31100) James"])
    got = [r[0] for r in df.select(parse.parse_people("x")).collect()]
    assert got == [["Ann Stone", "Bo Reed", "De La Cruz Ana"], [], [], ["James Bowen"]]


def test_parse_people_two_parts_with_parentheses(spark):
    # Two words with parentheses: the last word is the first name.
    df = one_col(spark, ["Smith (x)"])
    assert df.select(parse.parse_people("x")).first()[0] == ["(x) Smith"]


def test_item_display(spark):
    df = one_col(spark, ["12 - Roof leak - Open", "no number", "7 - Door"])
    got = [r[0] for r in df.select(parse.item_display("x")).collect()]
    assert got == ["12 - Roof leak", "no number", "7 - Door"]


def test_parse_date(spark):
    df = one_col(spark, ["2021-03-04", "03/05/2021", "junk", None, " 2021/03/06 "])
    got = [r[0] for r in df.select(parse.parse_date("x")).collect()]
    assert got == [dt.date(2021, 3, 4), dt.date(2021, 3, 5), None, None, dt.date(2021, 3, 6)]


def test_grade(spark):
    df = one_col(spark, [80.0, 79.999, 60.0, 40.0, 20.0, 19.9, None, float("nan")], "double")
    got = [r[0] for r in df.select(scoring.grade("x")).collect()]
    assert got == ["A", "B", "B", "C", "D", "F", "F", "F"]


def test_ratio_band(spark):
    df = spark.createDataFrame([(1.0, 10.0), (3.0, 10.0), (5.0, 10.0), (7.0, 10.0), (9.0, 10.0), (5.0, 0.0), (5.0, None)],
                               "a double, p double")
    got = [r[0] for r in df.select(scoring.ratio_band("a", "p")).collect()]
    assert got == [1, 2, 3, 4, 5, 1, 1]


def test_bar_and_meter(spark):
    df = one_col(spark, [45.9, None, float("nan"), 120.0, -3.0], "double")
    got = df.select(scoring.bar_score("x"), scoring.meter_score("x")).collect()
    assert [r[0] for r in got] == [45, 0, 0, 120, -3]
    assert [r[1] for r in got][:2] == [45.9, 0.0]
    assert got[3][1] == 100.0 and got[4][1] == 0.0


def test_impact_estimates(spark):
    df = one_col(spark, [41.316675], "double")
    est = scoring.impact_estimates("x")
    row = df.select(*[v.alias(k) for k, v in est.items()]).first()
    assert round(row["cost"], 7) == 7.4370015
    assert round(row["schedule"], 7) == 12.3950025
    assert round(row["incidents"], 6) == 24.790005


def test_improvement_models(spark):
    df = one_col(spark, [50.0, None, -1.0], "double")
    power = [r[0] for r in df.select(scoring.phase_improvement("x", "construction", "power")).collect()]
    assert abs(power[0] - 0.0228 * 50 ** 0.4875 * 100) < 1e-9 and power[1] is None and power[2] is None
    mixed = [r[0] for r in df.select(scoring.phase_improvement("x", "estimating", "mixed")).collect()]
    assert mixed[0] == 50.0 * 0.06
    helper = [r[0] for r in df.select(scoring.phase_improvement("x", "construction", "helper")).collect()]
    assert abs(helper[0] - 0.0228 * (100 * 50) ** 0.4875) < 1e-9 and helper[1] == 0.0


def test_format_actual_half_even(spark):
    df = spark.createDataFrame([(0.125, "%"), (2.25, "days"), (0.025, "%"), (None, "%"), (3.0, None)],
                               "v double, u string")
    got = [r[0] for r in df.select(display.format_actual("v", "u")).collect()]
    assert got == ["12%", "2.2", "2%", "nan%", "3.0"]


def test_format_money_and_date(spark):
    df = spark.createDataFrame([(1234567.5, dt.date(2020, 1, 5)), (None, None)], "v double, d date")
    got = df.select(display.format_money("v"), display.format_date("d")).collect()
    assert tuple(got[0]) == ("$1,234,568", "01/05/2020")
    assert tuple(got[1]) == ("N/A", "N/A")


def test_title_and_display_names(spark):
    df = one_col(spark, ["punch_item", "prime_contract_change_order", "o&m manuals"])
    got = [r[0] for r in df.select(display.title_item_type("x")).collect()]
    assert got == ["Punch Item", "Prime Contract Change Order", "O&M Manuals"]
    p = one_col(spark, ["financialSetup", "bidreview", "safety", "subcontractorPlanning"])
    got = [r[0] for r in p.select(display.process_display_name("x")).collect()]
    assert got == ["Financial Setup", "Bid Review", "Safety", "Subcontractor Planning"]
    k = one_col(spark, ["rfi lead time", None, ""])
    assert [r[0] for r in k.select(display.kpi_display_name("x")).collect()] == ["RFI LEAD TIME", "N/A", "N/A"]


def test_no_python_udf_in_parsers(spark):
    df = one_col(spark, ["a, b c"])
    plan = df.select(parse.parse_people("x"), parse.parse_value("x"), parse.parse_date("x"))._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    assert F is not None
