"""The composite queries a dashboard user runs (Q1-Q8).

Each function takes a ``Model`` (lazy tables), a ``Profile`` (what differs
between dashboard variants) and a ``Selection`` (the sidebar filters) and
returns one lazy DataFrame.  Cards that show several lists return them in
one long frame ``(section, name, rank, value, detail)`` so that one action
computes the whole card and shared inputs are planned once.

Per-phase pages are computed for *every* phase in one pass (``phase`` is a
grouping key) rather than one query per phase.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trestle.config import Profile, Selection
from trestle.functions import display, scoring
from trestle.operators import aggregates as A
from trestle.operators import filters as FL
from trestle.operators import items as IT
from trestle.operators import joins as J
from trestle.operators import ranking as R
from trestle.operators.scoreboard import SORT_COLUMNS, scoreboard
from trestle.sources import dims
from trestle.sources.model import Model

def _card(df: DataFrame, section, name, rank, value, detail=None) -> DataFrame:
    return df.select(
        (F.lit(section) if isinstance(section, str) else section).alias("section"),
        (F.col(name) if isinstance(name, str) else name).cast("string").alias("name"),
        (F.col(rank) if isinstance(rank, str) else rank).cast("int").alias("rank"),
        (F.col(value) if isinstance(value, str) else value).cast("double").alias("value"),
        (F.col(detail) if isinstance(detail, str) else (detail if detail is not None else F.lit(None))).cast("string").alias("detail"),
    )


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def project_meta_of(model: Model, with_end: bool = True) -> DataFrame | None:
    """A13 over the construction KPIs of the *unfiltered* model; ``None``
    when the KPI table lacks one of the meta columns (P1: no meta)."""
    needed = {"projectId", "ProjValue", "startDate"} | ({"endDate"} if with_end else set())
    if not needed.issubset(model.kpis.columns):
        return None
    if model.meta is not None:  # staged when the model was loaded: one row per project, parsed
        return model.meta if with_end else model.meta.drop("endDate")
    return A.project_meta(model.phase_kpis("construction"), model.row_order, end_col="endDate" if with_end else None)


def selections(model: Model, sel: Selection) -> tuple[DataFrame, DataFrame]:
    """(rows before the category cut, rows after it)."""
    wants_meta = sel.value_range or sel.start_range or sel.strict_value_range
    meta = project_meta_of(model, with_end=False) if wants_meta else None
    before = FL.apply_selection(model.scorecard, sel, meta, people=model.people if sel.person is not None else None)
    return before, FL.filter_category(before, sel.category)


def all_kpis(model: Model, summary: DataFrame, profile: Profile | None = None) -> DataFrame:
    """J1 + U1: KPI rows of the selected projects, whole-row dedup on the
    data columns (the row-order columns are not data); no rows unless every
    phase of the profile was loaded.

    On a staged model the deduplicated rows were written once at load
    (row filters commute with the dedup), so this is a scan and a semi join;
    otherwise one ``dropDuplicates`` on the data columns.
    """
    src = model.kpis_unique if model.kpis_unique is not None else model.kpis
    k = FL.propagate_projects(src, summary)
    if profile is not None and not all(p in model.phases for p in profile.phases):
        return k.where(F.lit(False))
    if model.kpis_unique is not None:
        return k
    return k.dropDuplicates(model.data_columns(k))


def _states(model: Model, summary: DataFrame) -> DataFrame:
    """J1 over the staged states of the KPI means, or over the KPI rows of a model that isn't staged."""
    return FL.propagate_projects(model.kpis if model.states is None else model.states, summary)


def _all_states(model: Model, summary: DataFrame, profile: Profile | None = None) -> DataFrame:
    """The same over the deduplicated rows of all phases."""
    if model.unique_states is None:
        return all_kpis(model, summary, profile)
    found = FL.propagate_projects(model.unique_states, summary)
    return found if profile is None or all(p in model.phases for p in profile.phases) else found.where(F.lit(False))


# --- Q1 -------------------------------------------------------------------

def _summary_card(summary: DataFrame, phase_columns: dict[str, str], with_overall: bool = True) -> DataFrame:
    """A1 + X1 + A2 from one aggregation pass over the selected scorecard
    rows, as card rows (overall, impact estimates, phase components)."""
    from trestle.functions.parse import nan_to_null

    aggs = [F.avg(nan_to_null(c)).alias(f"_p{i}") for i, c in enumerate(phase_columns.values())]
    if with_overall:
        aggs.insert(0, F.avg(nan_to_null("score")).alias("_overall"))
    stats = summary.agg(*aggs)
    rows = []
    if with_overall:
        rows.append(F.struct(F.lit("overall").alias("section"), F.lit("cr_score").alias("name"),
                             F.lit(None).cast("int").alias("rank"), F.col("_overall").alias("value")))
        for i, (k, v) in enumerate(scoring.impact_estimates("_overall").items(), start=1):
            rows.append(F.struct(F.lit("impact").alias("section"), F.lit(k).alias("name"),
                                 F.lit(i).alias("rank"), v.alias("value")))
    for i, p in enumerate(phase_columns, start=1):
        rows.append(F.struct(F.lit("phase").alias("section"), F.lit(p).alias("name"),
                             F.lit(i).alias("rank"), F.col(f"_p{i - 1}").alias("value")))
    exploded = stats.select(F.explode(F.array(*rows)).alias("x")).select("x.*")
    return exploded.select(
        "section", F.col("name").cast("string"), F.col("rank").cast("int"), F.col("value").cast("double"),
        F.lit(None).cast("string").alias("detail"),
    )


def _top_lists(
    spark: SparkSession, metrics: DataFrame, group_cols: tuple[str, ...] = (), own: DataFrame | None = None
) -> DataFrame:
    """Both top-5 KPI lists of a page (A8 with strength text, A9 with
    guidance) from ONE metrics aggregate: the two metrics are unpivoted into
    (list, KPI, value) rows and ranked by one window partitioned by list (and
    ``group_cols``).  Separate top-k branches would each be column-pruned to
    one metric, so Spark could not share their scan and shuffle."""
    lists = [("top_performing", "score_weighted")]
    if "priority_metric" in metrics.columns:
        lists.append(("top_priority", "priority_metric"))
    rows = metrics.select(
        *group_cols,
        "kpi_name",
        F.explode(F.array(*[F.struct(F.lit(s).alias("section"), F.col(m).alias("value")) for s, m in lists])).alias("x"),
    ).select(*group_cols, "kpi_name", "x.section", "x.value")
    top = R.top_of(rows.withColumnRenamed("value", "metric"), "metric", (*group_cols, "section"))
    texts = J.attach_guidance(spark, J.attach_strength(spark, top, texts=own), texts=own)
    name = F.concat_ws("|", *group_cols, "kpi_name") if group_cols else F.col("kpi_name")
    detail = F.when(F.col("section") == "top_performing", F.col("strength")).otherwise(F.col("guidance"))
    return _card(texts, F.col("section"), name, "rank", "metric", detail)


def executive_summary(spark: SparkSession, model: Model, profile: Profile, sel: Selection) -> DataFrame:
    """Q1: CR-score, impact estimates, phase components, top-5 performing
    KPIs (with strength text) and top-5 priority KPIs (with guidance).

    One aggregation over the selected scorecard rows for every number of
    the card, and one aggregation over the selected KPI rows (semi-joined
    with the selected project ids) for both top-5 lists."""
    _, summary = selections(model, sel)
    kpis = FL.filter_category(_all_states(model, summary, profile), sel.category)
    return _union([_summary_card(summary, profile.phase_score_columns), _top_lists(spark, R.kpi_metrics(kpis), own=model.kpi_texts)])


# --- Q2 -------------------------------------------------------------------

def portfolio_scoreboard(
    spark: SparkSession,
    model: Model,
    profile: Profile,
    sel: Selection,
    segment_by: str = "Project",
    sort_by: str = "CR-Score",
    ascending: bool = False,
    search: str | None = None,
    page_no: int | None = 0,
    after: tuple | None = None,
) -> DataFrame:
    """Q2: scoreboard rows of the selection (all allowed categories), sorted,
    searched, one page (``page_no=None`` gives every row), formatted.

    ``after`` asks for the page behind a row instead, by that row's ``token``
    (an empty tuple: the first page); the result then has the ``token`` of each
    row.  Such a page costs the same at any depth.
    """
    before, _ = selections(model, sel)
    board = FL.search_segments(scoreboard(before, project_meta_of(model), segment_by), search)
    keys = R.scoreboard_keys(SORT_COLUMNS[sort_by], ascending)
    token = ()
    if after is not None:
        found, token = R.page_after(board, keys, after), ("token",)
    elif page_no is not None and page_no >= R.DEEP_PAGE:
        found = R.page_at(board, keys, page_no)
    else:
        found = board.orderBy(*R.sort_order(keys))
        found = found if page_no is None else R.page(found, page_no)
    return found.select(
        "Segment",
        "cr_score",
        "est_project_value",
        "est_start_date",
        "est_end_date",
        display.format_money("est_project_value").alias("value_display"),
        display.format_date("est_start_date").alias("start_display"),
        display.format_date("est_end_date").alias("end_display"),
        *token,
    )


# --- Q3 -------------------------------------------------------------------

def phase_summary(spark: SparkSession, model: Model, profile: Profile, sel: Selection) -> DataFrame:
    """Q3, every phase at once: phase score, the configured processes with
    their mean score (0 when absent) and bar value, and the top-5 lists over
    the phase's KPIs of all categories."""
    _, summary = selections(model, sel)
    phase_scores = A.phase_components(summary, profile.phase_score_columns)
    procs = FL.propagate_projects(model.processes, summary)
    means = A.process_scores(procs, ("phase",))
    listed = J.processes_with_default(spark, means, model.phases)
    kpis = _states(model, summary)
    parts = [
        _card(phase_scores, "phase_score", "phase", "position", "phase_score"),
        _card(
            listed, "process", F.concat_ws("|", "phase", "process_name"), "position", "process_score",
            F.concat(display.process_display_name("process_name"), F.lit("|"), scoring.bar_score("process_score").cast("string")),
        ),
        _top_lists(spark, R.kpi_metrics(kpis, ("phase",)), ("phase",), model.kpi_texts),
    ]
    return _union(parts)


# --- Q4 -------------------------------------------------------------------

def _configured(spark: SparkSession, model: Model, kpis: DataFrame) -> DataFrame:
    """KPI rows of the configured processes of each loaded phase (the pages
    show a KPI table only under a configured process).  The process list is
    configuration-sized, so it is broadcast."""
    proc = dims.process_dim(spark, model.phases).select("phase", "process_name")
    return kpis.join(F.broadcast(proc), ["phase", "process_name"], "left_semi")


def process_kpi_table(spark: SparkSession, model: Model, profile: Profile, sel: Selection) -> DataFrame:
    """Q4: the KPI table of every process of every phase (category cut,
    rollup when more than one project, labels, definitions, display text)."""
    _, summary = selections(model, sel)
    kpis = _configured(spark, model, FL.filter_category(FL.propagate_projects(model.kpis, summary), sel.category))
    groups = ("phase", "process_name")
    rolled = A.kpi_rollup(kpis, groups, model.row_order, words=model.words)
    labelled = R.priority_label(rolled, groups)
    with_def = J.attach_definition(spark, labelled, texts=model.kpi_texts)
    return with_def.select(
        "phase",
        "process_name",
        "position",
        "kpi_name",
        display.kpi_display_name("kpi_name").alias("kpi_display"),
        "bp_range_display",
        "actual_numeric",
        display.format_actual("actual_numeric", "unit").alias("actual_display"),
        "score",
        display.format_whole("score").alias("score_display"),
        "unrealized_value",
        "impact_label",
        "is_averaged",
        "definition",
    )


# --- Q5 -------------------------------------------------------------------

def process_kpi_report_card(spark: SparkSession, model: Model, profile: Profile, sel: Selection) -> DataFrame:
    """Q5 (cloud variants): per process, KPI rollup with coverage, score on
    0-100, priority rank by unrealized value, letter grade, definition by the
    name as written, and the values as they are shown."""
    _, summary = selections(model, sel)
    kpis = _configured(spark, model, FL.filter_category(FL.propagate_projects(model.kpis, summary), sel.category))
    groups = ("phase", "process_name")
    rolled = A.kpi_rollup(
        kpis, groups, model.row_order, with_coverage=True, coverage_basis=profile.coverage_basis, words=model.words
    )
    scaled = rolled.withColumn("score", F.col("score") * profile.kpi_score_scale)
    ranked = J.attach_definition(
        spark, R.priority_rank(scaled, groups), fallback="fixed", exact_case=True, texts=model.kpi_texts, more_names=profile.more_definitions
    )
    return ranked.select(
        "phase",
        "process_name",
        "priority",
        "kpi_name",
        "definition",
        "percent_of_projects",
        display.format_percent("percent_of_projects").alias("percent_display"),
        "bp_range_display",
        "actual_numeric",
        display.format_actual("actual_numeric", "unit").alias("actual_display"),
        "score",
        scoring.grade("score").alias("grade"),
        "unrealized_value",
        "is_averaged",
    )


# --- Q6 -------------------------------------------------------------------

def legacy_category_card(spark: SparkSession, model: Model, profile: Profile, sel: Selection) -> DataFrame:
    """Q6 (``app`` variant): category scores x multipliers, phase scores x
    phase multipliers, and the two top-gap lists (empty when they sum to 0)."""
    before, summary = selections(model, sel)
    cat_dim = dims.category_multiplier_dim(spark).select("impact_category", "position")
    cats = J.category_impact(spark, A.category_scores(before, profile.categories, cat_dim))
    phase_scores = A.phase_components(summary, profile.phase_score_columns)
    ph_imp = J.phase_impact(spark, phase_scores)
    gap_all, gap_phase = _gap_lists(model, profile, summary, sel.category)
    return _union([
        _card(cats, "category", "impact_category", "position", "category_score"),
        _card(cats, "category_impact", "impact_category", "position", "category_impact"),
        _card(ph_imp, "phase_impact", F.concat_ws("|", "phase", "impact_category"), "position", "phase_impact"),
        _card(gap_all, "gap_phase_level", "kpi_name", "rank", "gap"),
        _card(gap_phase, "gap_process_level", F.concat_ws("|", "phase", "kpi_name"), "rank", "gap"),
    ])


def _gap_lists(model: Model, profile: Profile, summary: DataFrame, category: str | None) -> tuple[DataFrame, DataFrame]:
    """A10 (phase-level gap over the deduplicated rows of every phase) and
    A11 (process-level gap per phase over all rows), each with A12."""
    gap_all = R.top_gap(FL.filter_category(_all_states(model, summary, profile), category), "phase_level_unrealized_value")
    k = FL.filter_category(_states(model, summary), category)
    return gap_all, R.top_gap(k, "process_level_unrealized_value", ("phase",))


# --- Q7 -------------------------------------------------------------------

def improvements(summary: DataFrame, cols: dict[str, str], model: str) -> tuple[DataFrame, dict]:
    """Every phase's mean score in one aggregate row (``_n`` rows in all), and X4 of each as an expression over it."""
    wide = summary.agg(*[F.avg(c).alias(p) for p, c in cols.items()], F.count(F.lit(1)).alias("_n"))
    return wide, {p: scoring.phase_improvement(F.col(p), p, model) for p in cols}


def phase_improvements(summary: DataFrame, cols: dict[str, str], model: str) -> DataFrame:
    """(phase, position, phase_score, improvement), one scan of the selection."""
    wide, imps = improvements(summary, cols, model)
    rows = [
        F.struct(F.lit(p).alias("phase"), F.lit(i).alias("position"), F.col(p).alias("phase_score"), imps[p].alias("improvement"))
        for i, p in enumerate(cols, start=1)
    ]
    return wide.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def cost_improvement_card(spark: SparkSession, model: Model, profile: Profile, sel: Selection) -> DataFrame:
    """Q7 (cloud variants): per phase mean score and cost improvement (the
    profile's model), and their total (0 when nothing is selected) -- one
    aggregation over the selected scorecard rows, one explode."""
    _, summary = selections(model, sel)
    cols = profile.phase_score_columns
    wide, imps = improvements(summary, cols, profile.improvement_model)
    total = None
    for v in imps.values():
        total = v if total is None else total + v
    total = F.when(F.col("_n") == 0, F.lit(0.0)).otherwise(total)

    def row(section: str, name: str, rank, value):
        return F.struct(
            F.lit(section).alias("section"), F.lit(name).alias("name"),
            (F.lit(rank) if rank is not None else F.lit(None)).cast("int").alias("rank"),
            value.cast("double").alias("value"),
        )

    rows = [row("phase_score", p, i, F.col(p)) for i, p in enumerate(cols, start=1)]
    rows += [row("improvement", p, i, imps[p]) for i, p in enumerate(cols, start=1)]
    rows.append(row("total", "total", None, total))
    return wide.select(F.explode(F.array(*rows)).alias("x")).select(
        "x.section", "x.name", "x.rank", "x.value", F.lit(None).cast("string").alias("detail")
    )


# --- Q8 -------------------------------------------------------------------

def action_item_list(spark: SparkSession, model: Model, profile: Profile, sel: Selection) -> DataFrame:
    """Q8: the top-5 action items of the selection.

    Main form: project, region, manager and category filters, then the items
    of the largest weight.  Other variants: the filters whose columns exist,
    then the largest risk over all phases and inside each phase.
    """
    items = IT.prepare_items(spark, model.action_items, profile.item_phase_map)
    if profile.main_items:
        return _main_items(model, IT.filter_items_main(items, sel, sel.category))
    items = IT.filter_items_optional(items, sel, people=model.people if sel.person is not None else None)
    overall = IT.top_items_by_risk(items, tie=model.item_key).withColumn("scope", F.lit("all"))
    per_phase = IT.top_items_by_risk_per_phase(items, tie=model.item_key).withColumn("scope", F.col("phase"))
    cols = ["scope", "rank", "projectId", "item_type_display", "item_display", "required_action", "risk_value", model.item_key]
    return overall.select(*cols).unionByName(per_phase.select(*cols))


def _main_items(model: Model, items: DataFrame) -> DataFrame:
    metric = "weight" if "weight" in items.columns else "risk_value"
    top = IT.shaped(R.top_items(items, metric, tie=model.item_key), model.item_key)
    return top.select(
        F.lit("all").alias("scope"), "rank", "projectId", "item_type_display", "item_display", "required_action",
        F.col(metric).cast("double").alias(metric), model.item_key,
    )


def action_item_counts(spark: SparkSession, model: Model, profile: Profile, sel: Selection) -> DataFrame:
    """F10's note under an empty list: items before and after the filters."""
    items = model.action_items
    after = IT.filter_items_main(items, sel, sel.category) if profile.main_items else IT.filter_items_optional(items, sel, people=model.people if sel.person is not None else None)
    return IT.filter_counts(items, after)
