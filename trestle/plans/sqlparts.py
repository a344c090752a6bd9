"""SQL text shared by the DuckDB oracle strings (``registry.py``).

These are the SQL twins of the Column helpers in ``trestle.functions``; they
are only used to *check* the Spark results, never to run them.
"""

from __future__ import annotations

from trestle.functions.parse import NUMERIC_PATTERN


def num(x: str) -> str:
    """``to_number``: trimmed text that is a plain number, else null."""
    t = f"trim(CAST({x} AS VARCHAR))"
    return f"(CASE WHEN regexp_matches({t}, '{NUMERIC_PATTERN}') THEN TRY_CAST({t} AS DOUBLE) END)"


def parse_value(x: str) -> str:
    return num(f"replace(CAST({x} AS VARCHAR), '%', '')")


def parse_money(x: str) -> str:
    return num(f"regexp_replace(CAST({x} AS VARCHAR), '[$,]', '', 'g')")


# Same layouts, in the same order, as trestle.functions.parse.DATE_FORMATS.
DATE_FORMATS_SQL = (
    "%Y-%m-%d",
    "%Y-%m-%d %H:%M:%S",
    "%Y-%m-%dT%H:%M:%S",
    "%Y/%m/%d",
    "%m/%d/%Y",
    "%-m/%-d/%Y",
    "%m-%d-%Y",
    "%d %b %Y",
    "%b %-d, %Y",
)


def parse_date(x: str) -> str:
    t = f"trim(CAST({x} AS VARCHAR))"
    tries = ", ".join(f"try_strptime({t}, '{f}')" for f in DATE_FORMATS_SQL)
    return f"CAST(coalesce({tries}) AS DATE)"


def title(x: str) -> str:
    """Python ``str.title`` for space-separated words."""
    return (
        f"array_to_string(list_transform(string_split({x}, ' '), "
        f"lambda w: upper(w[1]) || lower(w[2:])), ' ')"
    )


def people(x: str) -> str:
    """Comma list of people -> list of display names."""
    entries = f"list_filter(list_transform(string_split(coalesce(CAST({x} AS VARCHAR), ''), ','), lambda s: trim(s)), lambda s: s <> '')"
    parts = "list_filter(regexp_split_to_array(e, '\\s+'), lambda w: w <> '')"
    name = (
        f"CASE WHEN len({parts}) < 2 THEN NULL "
        f"WHEN contains(e, '(') AND contains(e, ')') THEN trim(concat_ws(' ', "
        f"CASE WHEN len({parts}) > 2 THEN array_to_string(({parts})[3:], ' ') ELSE ({parts})[-1] END, ({parts})[1])) "
        f"WHEN len({parts}) = 2 THEN ({parts})[2] || ' ' || ({parts})[1] "
        f"ELSE e END"
    )
    return f"list_filter(list_transform({entries}, lambda e: {name}), lambda n: n IS NOT NULL)"


def first_by(value: str, order: str) -> str:
    """pandas ``first``: first non-null value in row order (value breaks ties)."""
    return f"arg_min({value}, struct_pack({order}, _v := {value})) FILTER (WHERE {value} IS NOT NULL)"


ROW_ORDER = "a := l_orderkey, b := l_linenumber, c := l_partkey, d := l_suppkey"


def grade(x: str) -> str:
    return (
        f"CASE WHEN {x} >= 80 THEN 'A' WHEN {x} >= 60 THEN 'B' WHEN {x} >= 40 THEN 'C' "
        f"WHEN {x} >= 20 THEN 'D' ELSE 'F' END"
    )


def money(x: str) -> str:
    return f"CASE WHEN {x} IS NULL OR isnan({x}) THEN 'N/A' ELSE '$' || format('{{:,.0f}}', {x}) END"


def mdy(x: str) -> str:
    return f"coalesce(strftime({x}, '%m/%d/%Y'), 'N/A')"


def process_display(x: str, overrides: dict[str, str]) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in overrides.items())
    split = title(f"regexp_replace({x}, '(\\w)([A-Z])', '\\1 \\2', 'g')")
    return f"CASE {x} {cases} ELSE {split} END"


def impact_estimates(score: str) -> dict[str, str]:
    from trestle.config import IMPACT_FACTORS

    return {k: f"({score} / 100.0 * {f} * 100)" for k, f in IMPACT_FACTORS.items()}
