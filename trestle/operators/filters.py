"""Selections and filters.

A ``Selection`` is applied to the scorecard; the surviving project ids are
then pushed into the fact tables with a ``left_semi`` join (J1).  Catalyst
turns each equality into a parquet ``PushedFilters`` entry where the column
comes straight from a scan; AQE broadcasts the id set when it is small and
keeps a shuffle join (with skew splitting) when it is not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trestle.config import NAME_FLAG_ALL, NAME_FLAG_EXCLUDE, NAME_FLAG_ONLY, Selection
from trestle.functions.parse import parse_people
from trestle.operators.cleaning import flag_value


def allow_categories(df: DataFrame, categories: tuple[str, ...], col: str = "impact_category") -> DataFrame:
    """impact category in the variant's list (case-exact)."""
    return df.where(F.col(col).isin(*categories))


def _eq(df: DataFrame, col: str, value, as_string: bool) -> DataFrame:
    if value is None:  # the "All ..." sentinel
        return df
    c = F.col(col).cast("string") if as_string else F.col(col)
    return df.where(c == F.lit(value))


def filter_project_region_pm(df: DataFrame, sel: Selection, as_string: bool = False) -> DataFrame:
    """project / region / manager equality, each skipped on ``None``."""
    df = _eq(df, "projectId", sel.project, as_string)
    df = _eq(df, "region", sel.region, as_string)
    return _eq(df, "projectManager", sel.manager, as_string)


def filter_office_program_stage(df: DataFrame, sel: Selection) -> DataFrame:
    """office, program manager and stage, compared as text."""
    df = _eq(df, "office_name", sel.office, True)
    df = _eq(df, "program_manager", sel.program_manager, True)
    return _eq(df, "project_stage", sel.stage, True)


def people_index(frames: list[DataFrame], col: str = "project_managers") -> DataFrame:
    """(person, people_text): which people lists, as written, hold a person (C13); each distinct list is parsed once."""
    lists = [f.where(F.col(col).isNotNull()).select(F.col(col).alias("people_text")) for f in frames if col in f.columns]
    both = lists[0]
    for more in lists[1:]:
        both = both.unionAll(more)
    return both.distinct().select(F.explode(parse_people("people_text")).alias("person"), "people_text").distinct()


def filter_person(
    df: DataFrame, person: str | None, col: str = "project_managers", people: DataFrame | None = None
) -> DataFrame:
    """rows whose parsed people list holds the name; null list -> out.

    With ``people``, the staged ``people_index``, a semi join on the lists that
    hold the person; without it every row's list is parsed.
    """
    if person is None:
        return df
    if people is not None:
        return df.join(people.where(F.col("person") == F.lit(person)).select(F.col("people_text").alias(col)), col, "left_semi").select(*df.columns)
    return df.where(F.col(col).isNotNull() & F.array_contains(parse_people(col), F.lit(person)))


def filter_name_flag(df: DataFrame, choice: str, col: str = "name_flag") -> DataFrame:
    """three-way flag choice: all / flag 0 / flag 1 (no-op if absent)."""
    if choice == NAME_FLAG_ALL or col not in df.columns:
        return df
    if choice == NAME_FLAG_EXCLUDE:
        return df.where(flag_value(df, col) == 0)
    if choice == NAME_FLAG_ONLY:
        return df.where(flag_value(df, col) == 1)
    raise ValueError(f"unknown name-flag choice {choice!r}")


def filter_category(df: DataFrame, category: str | None, col: str = "impact_category") -> DataFrame:
    """one impact category."""
    return df if category is None else df.where(F.col(col) == F.lit(category))


def value_range_ids(meta: DataFrame, low: float, high: float | None) -> DataFrame:
    """projects whose parsed value lies in ``[low, high]`` (``high=None``
    unbounded); a null value is out."""
    v = F.col("projValue")
    cond = v >= F.lit(float(low)) if high is None else v.between(float(low), float(high))
    return meta.where(cond).select("projectId")


def start_date_ids(meta: DataFrame, start, end) -> DataFrame:
    """F8: projects whose start date lies in ``[start, end]``; null is out."""
    return meta.where(F.col("startDate").between(F.lit(start), F.lit(end))).select("projectId")


def filter_process(kpis: DataFrame, process: str) -> DataFrame:
    """KPI rows of one process."""
    return kpis.where(F.col("process_name") == F.lit(process))


def filter_item_phase(items: DataFrame, phase: str) -> DataFrame:
    """action items of one phase."""
    return items.where(F.col("phase") == F.lit(phase))


def search_segments(df: DataFrame, term: str | None, col: str = "Segment") -> DataFrame:
    """case-insensitive *regular expression* search (pandas
    ``str.contains`` default), blank term = no filter, null never matches."""
    if term is None or not term.strip():
        return df
    return df.where(F.coalesce(F.col(col).cast("string").rlike("(?i)" + term.strip()), F.lit(False)))


def project_meta_columns(kpis: DataFrame, cols: tuple[str, ...]) -> DataFrame | None:
    """Project the meta columns, all required, then distinct; ``None`` when
    one is missing (the dashboard then has no meta)."""
    if not set(cols).issubset(kpis.columns):
        return None
    return kpis.select(*cols).distinct()


def propagate_projects(facts: DataFrame, selected: DataFrame, key: str = "projectId") -> DataFrame:
    """Keep fact rows whose project survived the scorecard filters.

    ``left_semi`` never duplicates fact rows and needs only the key column of
    the selection; an empty selection gives an empty result.
    """
    return facts.join(selected.select(key).where(F.col(key).isNotNull()), key, "left_semi")


def apply_selection(
    scorecard: DataFrame,
    sel: Selection,
    meta: DataFrame | None = None,
    as_string: bool = False,
    people: DataFrame | None = None,
) -> DataFrame:
    """F2/F3/F4/F5 + F7/F8: the scorecard rows a selection keeps, *before* the
    category cut (what the scoreboard and the category card see).

    ``meta`` is the project meta (A13) with parsed ``projValue``/``startDate``.
    Without meta the value filter keeps nothing when it applies (the
    dashboard's behaviour when the construction KPIs lack those columns).
    """
    df = filter_project_region_pm(scorecard, sel, as_string)
    df = filter_office_program_stage(df, sel)
    df = filter_person(df, sel.person, people=people)
    df = filter_name_flag(df, sel.name_flag)
    value_range = sel.value_range
    if value_range is None and sel.strict_value_range:
        value_range = (0.0, None)
    if value_range is not None:
        if meta is None:
            return df.where(F.lit(False))
        df = df.join(value_range_ids(meta, *value_range), "projectId", "left_semi")
    if sel.start_range is not None and meta is not None:
        df = df.join(start_date_ids(meta, *sel.start_range), "projectId", "left_semi")
    return df
