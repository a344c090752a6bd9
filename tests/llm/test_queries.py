"""The registered queries: SQL where there is one, and the shape of every result."""

import pytest

import __spark_entry__ as E
from trestle.llm import queries

from .conftest import SF

COLUMNS = {
    1: "page_id url text n_chars",
    2: "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    4: "doc_id held_out lang_pred score",
    5: "doc_id n_words n_hit n_items items_sha256 contaminated",
    6: "doc_id fingerprint component_id",
    7: "doc_id held_out score predicted",
    8: "doc_id held_out n_tokens n_known train_tokens base_score score",
    9: "page_id payload_bytes payload_digest record_type refers_to",
    10: "doc_id n_lines n_dropped kept_sha256",
    11: "item_id rank doc_id score",
    12: "page_id host path rule verdict",
    13: "lang rank phrase a l r n score",
}


def test_one_query_per_operator():
    numbers = sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES)
    assert numbers == list(range(1, 14))
    assert set(queries.QUERIES) | {"pipeline"} <= set(E.queries())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, con, name):
    df = E.queries()[name](spark, SF)
    rows = sorted(map(repr, (tuple(r[c] for c in sorted(df.columns)) for r in df.collect())))
    res = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == sorted(df.columns)
    at = [names.index(c) for c in sorted(df.columns)]
    assert rows == sorted(repr(tuple(r[i] for i in at)) for r in res.fetchall())


@pytest.mark.parametrize("number", [1, 2, 4, 6, 7, 8, 9])
def test_shape(spark, con, number):
    name = next(k for k in queries.QUERIES if k.startswith(f"op{number}_"))
    df = E.queries()[name](spark, SF)
    wanted = COLUMNS[number].split()
    assert df.columns[: len(wanted)] == wanted
    rows = df.collect()
    table, key = ("pages", "page_id") if number in (1, 9) else ("documents", "doc_id")
    assert sorted(r[key] for r in rows) == [r[0] for r in con.execute(f"SELECT {key} FROM {table} ORDER BY 1").fetchall()]
    for c in {"score", "near_edited", "near_next"} & set(wanted) if number != 8 else ():
        assert all(0 <= r[c] <= 1 for r in rows)


@pytest.mark.parametrize("number", [2, 3, 12])
def test_native_queries_run_no_python(spark, number):
    name = next(k for k in queries.QUERIES if k.startswith(f"op{number}_"))
    plan = E.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "MapInArrow", "Arrow"))
