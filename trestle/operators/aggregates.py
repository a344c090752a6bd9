"""Aggregations.

Every aggregate here is decomposable (avg / sum / count / min / max /
min_by), so Spark runs a partial aggregate before the shuffle and only one
row per key and map task crosses the network: a key that holds a third of all
rows costs one row per task, not a third of the data in one reducer.
Null keys are dropped before grouping (pandas ``groupby`` drops them, T2).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trestle.functions.parse import nan_to_null, parse_date, parse_money, parse_value


def first_non_null(col: str, order_cols: list[str] | tuple[str, ...]) -> Column:
    """pandas ``first`` (T6/T7): the first non-null value in row order.

    Row order is given by ``order_cols`` (a natural row key); the value itself
    is the last tie-breaker so that duplicated keys still give one answer.
    """
    c = F.col(col)
    return F.min_by(c, F.when(c.isNotNull(), F.struct(*[F.col(o) for o in order_cols], c)))


def overall_score(summary: DataFrame, score_col: str = "score") -> DataFrame:
    """A1: mean score of the selection (null when empty)."""
    return summary.agg(F.avg(nan_to_null(score_col)).alias("overall_score"))


def phase_components(summary: DataFrame, phase_columns: dict[str, str]) -> DataFrame:
    """A2: mean of every phase score column, one agg pass, then one row per
    phase (``unpivot``) in the configured order."""
    wide = summary.agg(*[F.avg(nan_to_null(c)).alias(p) for p, c in phase_columns.items()])
    long = wide.unpivot([], list(phase_columns), "phase", "phase_score")
    order = F.create_map(*[F.lit(x) for i, p in enumerate(phase_columns) for x in (p, i + 1)])
    return long.withColumn("position", F.element_at(order, F.col("phase")))


def category_scores(summary: DataFrame, categories: tuple[str, ...], dim: DataFrame) -> DataFrame:
    """A3: mean score per impact category over every allowed category; a
    category without rows gets 0 (``dict.get(c, 0)``).

    ``dim`` lists the allowed categories with a ``position``; the means are
    one row per category, so the planner broadcasts them.
    """
    means = (
        summary.where(F.col("impact_category").isNotNull())
        .groupBy("impact_category")
        .agg(F.avg(nan_to_null("score")).alias("category_score"), F.lit(True).alias("present"))
    )
    return (
        dim.where(F.col("impact_category").isin(*categories))
        .join(means, "impact_category", "left")
        .select(
            "impact_category",
            "position",
            F.when(F.col("present").isNull(), F.lit(0.0)).otherwise(F.col("category_score")).alias("category_score"),
        )
    )


def process_scores(processes: DataFrame, group_cols: tuple[str, ...] = ()) -> DataFrame:
    """A4: mean process score per process (all categories, all projects);
    ``group_cols`` (e.g. ``phase``) computes every phase in one pass."""
    keys = [*group_cols, "process_name"]
    src = processes
    for k in keys:
        src = src.where(F.col(k).isNotNull())
    return src.groupBy(*keys).agg(F.avg(nan_to_null("score")).alias("process_score"))


def project_count(kpis: DataFrame, group_cols: tuple[str, ...] = ()) -> DataFrame:
    """Distinct non-null projects (exact), per group."""
    src = kpis.where(F.col("projectId").isNotNull())
    if group_cols:
        return src.groupBy(*group_cols).agg(F.count_distinct("projectId").alias("n_projects"))
    return src.agg(F.count_distinct("projectId").alias("n_projects"))


def _several_projects(kpis: DataFrame, group_cols: list[str]) -> DataFrame:
    """Per group whether its rows name more than one project: the least and the greatest hash of the
    project ids differ.  Four numbers a group, so a hash aggregate (two hashes, as two projects may share one)."""
    hashes = [F.when(F.col("projectId").isNotNull(), F.xxhash64("projectId", F.lit(seed))) for seed in (0, 1)]
    ends = [f(h).alias(f"_{name}{i}") for i, h in enumerate(hashes) for name, f in (("min", F.min), ("max", F.max))]
    differ = (F.col("_min0") != F.col("_max0")) | (F.col("_min1") != F.col("_max1"))
    return kpis.groupBy(*group_cols).agg(*ends).select(*group_cols, F.coalesce(differ, F.lit(False)).alias("is_averaged"))


def kpi_rollup(
    kpis: DataFrame,
    group_cols: tuple[str, ...] = (),
    order_cols: tuple[str, ...] = (),
    with_coverage: bool = False,
    coverage_basis: str = "rows",
    words: DataFrame | None = None,
) -> DataFrame:
    """A5 (+A6/J3): the KPI table of one process, or of many processes at once
    when ``group_cols`` names them (e.g. ``phase, process_name``).

    Per group, when more than one project is present the rows are averaged
    per KPI (``actual_numeric``, ``score``, ``unrealized_value``; first
    ``bp_range_display`` and ``unit`` in row order; rows without a KPI name
    have no group); with a single project the rows pass unchanged.

    Two passes over the facts.  The first tells the groups with several
    projects (a join partner of one row per group, or a scalar subquery
    without groups).  The second is one aggregate for both kinds of group: by
    KPI where rows are averaged, by row where they pass as they are.

    ``order_cols`` is the row order and must tell rows apart.  With one
    bigint (``row_order`` of a staged model) and ``words``, the table of
    distinct texts by their hash (``text_words``), every buffer of the
    aggregate is of fixed width, so it is a hash aggregate, and the texts are
    looked up afterwards.  Without them the texts are carried along.

    Coverage (A6) = 100 x (rows with a numeric actual) / (projects in the
    group); ``basis="projects"`` counts distinct projects with a value
    instead (SURVEY defect 3).
    """
    gk = list(group_cols)
    src = kpis.withColumn("actual_numeric", parse_value("actual"))
    if with_coverage:
        groups = project_count(src, group_cols).withColumn("is_averaged", F.col("n_projects") > 1)
    else:
        groups = _several_projects(src, gk)
    facts = [c for c in groups.columns if c not in gk]
    if gk:
        # At most one row per group: AQE sees its real size and broadcasts it.
        src = src.join(groups, gk, "left")
    else:
        # Uncorrelated scalar subqueries, evaluated once.
        src = src.withColumns({c: groups.select(c).scalar() for c in facts})
    if with_coverage:
        src = src.withColumn("n_projects", F.coalesce("n_projects", F.lit(0)))
    averaged = F.coalesce("is_averaged", F.lit(False))
    src = src.withColumn("is_averaged", averaged).where(~F.col("is_averaged") | F.col("kpi_name").isNotNull())
    order = list(order_cols) or ["projectId"]
    src = src.withColumn("_row", F.when(~F.col("is_averaged"), F.col(order[0]) if len(order) == 1 else F.struct(*order)))

    def mean(col: str) -> Column:
        return F.avg(F.when(F.col("is_averaged"), nan_to_null(col)).otherwise(F.col(col))).alias(col)

    valued = F.col("actual_numeric").isNotNull()
    by_projects = coverage_basis == "projects"
    cov_num = F.count_distinct(F.when(valued, F.col("projectId"))) if by_projects else F.count(F.when(valued, F.lit(1)))
    by_number = words is not None and len(order) == 1
    texts = ("bp_range_display", "unit")
    first = [_first_word(c, order[0]) if by_number else first_non_null(c, order).alias(c) for c in texts]
    keys = [*gk, "kpi_name", "is_averaged", "_row", *(["n_projects"] if with_coverage else [])]
    rolled = src.groupBy(*keys).agg(
        mean("actual_numeric"), mean("score"), mean("unrealized_value"), *first, *([cov_num.alias("_valued")] if with_coverage else [])
    )
    out_cols = [*gk, "kpi_name", "actual_numeric", "score", "unrealized_value", "bp_range_display", "unit"]
    if with_coverage:
        of_kpi = Window.partitionBy(*gk, "kpi_name")  # the one averaged row, or the rows of one project
        total = (F.max if by_projects else F.sum)("_valued").over(of_kpi)
        share = F.when(F.col("kpi_name").isNotNull(), F.try_divide(total * 100.0, F.col("n_projects")))
        rolled = rolled.withColumn("percent_of_projects", share)
        out_cols.append("percent_of_projects")
    for c in texts if by_number else ():
        known = words.select(F.col("word_id").alias(c), F.col("word").alias(f"_{c}"))
        rolled = rolled.join(known, c, "left").drop(c).withColumnRenamed(f"_{c}", c)
    return rolled.select(*out_cols, "is_averaged")


def word_id(col: str, seed: int = 0) -> Column:
    """A text's number in ``text_words``; null for null."""
    return F.when(F.col(col).isNotNull(), F.xxhash64(F.col(col), F.lit(seed)))


def text_words(df: DataFrame, cols: tuple[str, ...]) -> DataFrame:
    """(word_id, word): the distinct texts of some columns and their hashes."""
    each = df.select(F.explode(F.array(*[F.col(c) for c in cols])).alias("word")).where(F.col("word").isNotNull()).distinct()
    return each.select(word_id("word").alias("word_id"), "word")


def _first_word(col: str, order: str) -> Column:
    return F.min_by(word_id(col), F.when(F.col(col).isNotNull(), F.col(order))).alias(col)


def project_meta(
    kpis: DataFrame,
    order_cols: tuple[str, ...],
    value_col: str = "ProjValue",
    start_col: str = "startDate",
    end_col: str | None = "endDate",
) -> DataFrame:
    """Per project the first non-null value / start / end text, column by
    column (pandas ``groupby().first()``, T7), parsed (C9, C10).

    It is the first *text* that counts, as in the dashboard: if it does not
    parse, the result is null even when a later one would.  What travels is
    the parsed value of fixed width; with one bigint as row order the
    aggregate is a hash aggregate.
    """
    src = kpis.where(F.col("projectId").isNotNull())

    def first(col: str, parsed: Column) -> Column:
        order = F.col(order_cols[0]) if len(order_cols) == 1 else F.struct(*[F.col(o) for o in order_cols], F.col(col))
        return F.min_by(parsed, F.when(F.col(col).isNotNull(), order))

    aggs = [first(value_col, parse_money(value_col)).alias("projValue"), first(start_col, parse_date(start_col)).alias("startDate")]
    if end_col:
        aggs.append(first(end_col, parse_date(end_col)).alias("endDate"))
    return src.groupBy("projectId").agg(*aggs)


def facet_values(df: DataFrame, col: str, as_string: bool = True) -> DataFrame:
    """Sorted distinct non-null values of a filter column."""
    c = F.col(col).cast("string") if as_string else F.col(col)
    return df.where(F.col(col).isNotNull()).select(c.alias("value")).distinct().orderBy("value")


def facet_table(df: DataFrame, facets: dict[str, str]) -> DataFrame:
    """A15 for several filters at once: sorted distinct (facet, value) rows.

    One scan: each row yields its (facet, value) pairs, which are made
    distinct before and after one shuffle; columns that ``df`` lacks are left out.
    """
    pairs = [
        F.struct(F.lit(name).alias("facet"), F.col(col).cast("string").alias("value"))
        for name, col in facets.items()
        if col in df.columns
    ]
    rows = df.select(F.explode(F.array(*pairs)).alias("x")).select("x.facet", "x.value")
    return rows.where(F.col("value").isNotNull()).distinct().orderBy("facet", "value")


def coverage(kpis: DataFrame, group_cols: tuple[str, ...], basis: str = "rows") -> DataFrame:
    """One row per group and KPI name with ``percent_of_projects``, for J3."""
    src = kpis.withColumn("actual_numeric", parse_value("actual"))
    valued = F.col("actual_numeric").isNotNull()
    by_kpi = src.where(F.col("kpi_name").isNotNull()).groupBy(*group_cols, "kpi_name")
    counted = by_kpi.agg(
        (F.count_distinct(F.when(valued, F.col("projectId"))) if basis == "projects" else F.count(F.when(valued, F.lit(1)))).alias("n")
    )
    return counted.join(project_count(src, group_cols), list(group_cols), "left").select(
        *group_cols, "kpi_name", F.try_divide(F.col("n") * 100.0, F.col("n_projects")).alias("percent_of_projects")
    )


def facet_people(df: DataFrame, col: str = "project_managers", people: DataFrame | None = None) -> DataFrame:
    """Sorted distinct parsed people names (after a partial distinct on
    the raw text, so each distinct list is parsed once; with ``people``, the
    staged index of lists by person, none is)."""
    from trestle.functions.parse import parse_people

    lists = df.where(F.col(col).isNotNull()).select(F.col(col).alias("people_text")).distinct()
    if people is not None:
        return people.join(lists, "people_text", "left_semi").select("person").distinct().orderBy("person")
    return lists.select(F.explode(parse_people("people_text")).alias("person")).distinct().orderBy("person")


def facet_date_bounds(meta: DataFrame) -> DataFrame:
    """Min / max start date over the project meta."""
    return meta.agg(F.min("startDate").alias("date_min"), F.max("startDate").alias("date_max"))

