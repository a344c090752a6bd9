"""The adapter's tables are staged when a query asks for them, and their rows numbered without a shuffle."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from trestle.operators import cleaning as C
from trestle.sources import model as M
from trestle.sources import staging, tpch

TABLES = {
    "region": "SELECT i AS r_regionkey, 'R' || i AS r_name FROM range(2) t(i)",
    "nation": "SELECT i AS n_nationkey, 'NATION_' || i AS n_name, i % 2 AS n_regionkey FROM range(4) t(i)",
    "customer": "SELECT i AS c_custkey, i * 100.0 AS c_acctbal, i % 4 AS c_nationkey, 'BUILDING' AS c_mktsegment FROM range(6) t(i)",
    "orders": "SELECT i - 3 + {shift} AS o_orderkey, i % 6 AS o_custkey, '1-URGENT' AS o_orderpriority, "
    "TIMESTAMP '1995-01-01' + to_days(CAST(i AS INT)) AS o_orderdate FROM range(20) t(i)",
    # each order has line 2 before line 1 and one row twice
    "lineitem": "SELECT i - 3 + {shift} AS l_orderkey, i % 5 AS l_partkey, i % 3 AS l_suppkey, line AS l_linenumber, 10.0 + line AS l_quantity, "
    "0.1 AS l_tax, 0.05 AS l_discount, 'A' AS l_returnflag, TIMESTAMP '1996-01-01' AS l_shipdate "
    "FROM range(20) t(i), (VALUES (2), (1), (1), (5)) l(line)",
    "part": "SELECT i AS p_partkey, 'Brand#' || (i + 1) AS p_brand FROM range(5) t(i)",
    "events": "SELECT i AS event_id, TIMESTAMP '2024-01-01 09:00:00' AS ts, i % 6 AS user_id, 'click' AS event_type, i * 1.5 AS value FROM range(9) t(i)",
}


@pytest.fixture()
def tables(tmpdir_path):
    def write(shift: int = 0) -> str:
        for name, sql in TABLES.items():
            duckdb.sql(f"COPY ({sql.format(shift=shift)}) TO '{tmpdir_path}/{name}.parquet' (FORMAT parquet)")
        return tmpdir_path

    return write


def _staged(spark, base):
    sig = staging.input_signature(spark, [f"{base}/{t}.parquet" for t in tpch.SOURCE_TABLES])
    root = f"{staging.staging_root(spark)}/tpch-{staging.STAGE_VERSION}-{sig}".removeprefix("file:")
    return set(os.listdir(root)) if os.path.isdir(root) else set()


def test_a_query_stages_only_what_it_reads(spark, tables):
    base, qs = tables(), E.queries()
    assert qs["scan_object_store"](spark, base).count() == 9 and _staged(spark, base) == set()
    assert qs["top_items_by_weight"](spark, base).count() == 5 and _staged(spark, base) == {"action_items"}
    assert {r.phase: r.n_rows for r in qs["tag_phase"](spark, base).collect()} == {"bidding": 60, "construction": 20}
    for name in ("parse_date", "scoreboard", "category_scores", "canonical_names"):
        qs[name](spark, base).collect()
    assert _staged(spark, base) == {"action_items", "kpis", "words"}
    qs["phase_summary"](spark, base).collect()
    assert _staged(spark, base) == {"action_items", "kpis", "words", "states"}


def test_csv_parts_rollup_writes_little_csv(spark, tables):
    root = staging.staging_root(spark).removeprefix("file:")
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    got = E.queries()["csv_parts_rollup"](spark, tables()).collect()
    assert sum(r.n_rows for r in got) == 80
    (made,) = [d for d in set(os.listdir(root)) - before if d.startswith("csv-")]
    names = [f for _, _, found in os.walk(f"{root}/{made}") for f in found if f.startswith("part-")]
    assert len(names) >= 9 and all(f.endswith(".csv.gz") for f in names)


ITEMS, FACTS = {"action_items"}, {"kpis", "words"}
READS = {
    "action_item_counts": ITEMS,
    "top_items_by_risk_per_phase": ITEMS,
    "top_items_by_risk": ITEMS,
    "top_items_by_weight": ITEMS,
    "filter_action_items": ITEMS | FACTS | {"people"},
    "parse_people": FACTS,
    "portfolio_scoreboard": FACTS,
    "project_meta_columns": FACTS,
    "canonical_names": FACTS,
    "kpi_display_name": FACTS,
}


@pytest.mark.parametrize("name", READS)
def test_a_query_alone_stages_its_own_tables(spark, tables, name):
    base = tables()
    assert E.queries()[name](spark, base).collect()
    assert _staged(spark, base) == READS[name]


@pytest.mark.parametrize("shift", [0, 1 << 40])
def test_rows_are_numbered_in_the_order_of_their_key(spark, tables, shift):
    base = tables(shift)
    rows = M.from_tpch(spark, base).kpis.orderBy(M.ROW_ORDER).select(M.ROW_ORDER, *tpch.ROW_KEY).collect()
    assert len({r[0] for r in rows}) == len(rows) == 80  # equal rows too
    keys = [tuple(r)[1:] for r in rows]
    assert keys == sorted(keys) and keys[0][0] == shift - 3


def test_numbering_shuffles_no_row_of_the_facts(spark, tables):
    plan = tpch.in_row_order(spark, tables())._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan
    merged = plan[: plan.index("SortMergeJoin")]  # what runs on the joined rows
    assert "Exchange" not in merged


def test_rows_are_numbered_before_they_are_wide(spark, tables):
    plan = tpch.in_row_order(spark, tables())._jdf.queryExecution().executedPlan().toString()
    above, below = plan.split("SortMergeJoin", 1)
    # the join's own shuffle and sort number the lines; the texts of a project are made after it
    assert "Window" not in above and "Sort " not in above and "concat(P-" in above
    assert "concat(" not in below


def test_copies_of_orders_customers_and_nations_have_numbers_of_their_own(spark, tables):
    base = tables()
    for name in ("orders", "customer", "nation"):
        twice = f"SELECT * FROM ({TABLES[name].format(shift=0)}) UNION ALL ({TABLES[name].format(shift=0)})"
        duckdb.sql(f"COPY ({twice}) TO '{base}/{name}.parquet' (FORMAT parquet)")
    rows = tpch.in_row_order(spark, base).orderBy(M.ROW_ORDER).select(M.ROW_ORDER, *tpch.ROW_KEY).collect()
    assert len(rows) == 80 * 8 and len({r[0] for r in rows}) == len(rows)
    keys = [tuple(r)[1:] for r in rows]
    assert keys == sorted(keys) and [r[0] & 0xFFFFFFFF for r in rows if r.l_orderkey == 3] == list(range(32))


def test_only_rows_that_share_a_hash_are_compared(spark, monkeypatch):
    rows = [(1, "a", None), (1, "a", None), (1, None, "a"), (2, "b", "c"), (2, "b", "c"), (2, "b", "c"), (3, "x", "y")]
    zeros = [(i, s, t, z) for i, s, t in rows for z in (0.0, -0.0)]
    df = spark.createDataFrame(zeros, "i int, s string, t string, z double")
    repeated = C.repeated_hashes(df)
    exact = sorted(map(repr, df.dropDuplicates().withColumn("z", F.abs("z")).collect()))
    found = C.distinct_rows(df, repeated)
    assert sorted(map(repr, found.withColumn("z", F.abs("z")).collect())) == exact and len(exact) == 4
    assert found._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin") == 2
    # rows whose hashes collide are told apart: all hashes listed as repeated
    every = df.select(F.xxhash64(*df.columns).alias(C._ROW_HASH)).distinct()
    assert C.distinct_rows(df, every).count() == 4
    monkeypatch.setattr(C, "MOST_REPEATED", 1)
    assert "BroadcastHashJoin" not in C.distinct_rows(df, every)._jdf.queryExecution().executedPlan().toString()
    assert C.distinct_rows(df, every).count() == 4


def test_all_phase_kpis_shuffles_no_row_without_a_copy(spark, tables):
    df = E.queries()["all_phase_kpis"](spark, tables())
    assert {r.phase: r.n_rows for r in df.collect()} == {"bidding": 40, "construction": 20}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and "LeftSemi" in plan


def test_what_a_profile_changes_comes_as_late(spark):
    made = []
    model = M.Model(*[M.Later(lambda n=n: made.append(n)) for n in M.STAGED_TABLES], (), "event_id", ())
    changed = model.replace(item_key="x").mapped(("kpis", "scorecard"), lambda df: df)
    assert made == [] and changed.kpis is None and changed.kpis is None and made == ["kpis"]
