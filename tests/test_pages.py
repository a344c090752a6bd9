"""Positions over all partitions, deep pages, pages by key, definitions as written."""

import pytest
from pyspark.sql import functions as F

from trestle.operators import joins as J
from trestle.operators import ranking as R
from trestle.sources import dims

#: Ties, missing values in both keys, a key that a third of the rows share.
ROWS = [(None if i % 17 == 0 else float(i % 3 and i % 40), None if i == 99 else f"S{i * 37 % 401:03d}") for i in range(401)]


@pytest.fixture(scope="module")
def board(spark):
    return spark.createDataFrame(ROWS, "cr_score double, Segment string").repartition(7)


def in_order(ascending):
    def key(r):
        score = 0.0 if r[0] is None else (r[0] if ascending else -r[0])
        return (r[0] is None, score, r[1] is None, r[1] or "")

    return sorted(ROWS, key=key)


@pytest.mark.parametrize("ascending", [True, False])
def test_positions_and_pages(spark, board, ascending):
    keys = R.scoreboard_keys("CR-Score", ascending)
    wanted = in_order(ascending)
    numbered, total = R.with_positions(board, R.sort_order(keys))
    assert total == 401
    got = sorted(numbered.collect(), key=lambda r: r.pos)
    assert [r.pos for r in got] == list(range(1, 402)) and [(r.cr_score, r.Segment) for r in got] == wanted
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    for page_no in (0, 3, 7, 8, 99, -1):
        at = min(max(page_no, 0), 8)
        rows = R.page_at(board, keys, page_no).collect()
        assert [(r.cr_score, r.Segment) for r in rows] == wanted[at * 50 : at * 50 + 50]
    token, seen = (), []
    while rows := R.page_after(board, keys, token, 60).collect():
        seen += [(r.cr_score, r.Segment) for r in rows]
        token = tuple(rows[-1].token)
    assert seen == wanted


def test_a_page_by_key_is_a_top_n_selection(board):
    keys = R.scoreboard_keys("CR-Score", False)
    plan = R.page_after(board, keys, (12.0, "S100"))._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject(limit=50" in plan and "Window" not in plan


def test_no_rows(spark, board):
    none = board.limit(0)
    keys = R.scoreboard_keys("Segment", True)
    assert R.with_positions(none, R.sort_order(keys))[1] == 0
    assert R.page_at(none, keys, 5).count() == 0 and R.page_after(none, keys).count() == 0


def test_definitions_as_written(spark, tmpdir_path):
    df = spark.createDataFrame([("Incident Rate",), ("incident rate",), ("RFIs Lead Time",), (None,)], "kpi_name string")

    def found(**kw):
        rows = J.attach_definition(spark, df, fallback="fixed", exact_case=True, **kw).collect()
        return {r.kpi_name: r.definition for r in rows}

    short, long_ = found(), found(more_names=True)
    assert short["Incident Rate"] == "How often, or how large a part: Incident Rate."
    assert short["incident rate"] == short[None] == short["RFIs Lead Time"] == dims.NO_DEFINITION
    assert long_["RFIs Lead Time"] != dims.NO_DEFINITION and long_["Incident Rate"] == short["Incident Rate"]
    with open(f"{tmpdir_path}/kpi_texts.csv", "w") as fh:
        fh.write("kpi_key,definition,strength\nIncident Rate,as written,good\nINCIDENT RATE,capitals,good\n")
    own = dims.kpi_text_from_csv(spark, f"{tmpdir_path}/kpi_texts.csv")
    assert found(texts=own) == {"Incident Rate": "as written", "incident rate": dims.NO_DEFINITION, "RFIs Lead Time": dims.NO_DEFINITION, None: dims.NO_DEFINITION}
    assert J.attach_strength(spark, df.where(F.col("kpi_name").isNotNull()), texts=own).count() == 3
