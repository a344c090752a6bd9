"""Top-k lists, ranks, labels, sorting and paging (A8-A12, W1-W3, O1-O2,
L1-L4, U1).

Top-k without a partition key is ``orderBy(...).limit(k)``, which Spark plans
as ``TakeOrderedAndProject``: every task keeps its own k best rows and only
those reach the final merge.  Top-k per group is ``row_number() <= k`` over a
partitioned window, which Spark 3.5+ rewrites with a *partial*
``WindowGroupLimit`` below the shuffle, so a group holding a third of all rows
still ships only k rows per map task.  Ranks over rolled-up KPI tables run
after the aggregation (at most one row per KPI and group).

Ties: the dashboards sort with pandas (unstable for ties) or ``nlargest``
(first in row order).  Here every order ends with an explicit tie-breaker
(KPI name after a ``groupby``, the row key for raw rows), and averages are
rounded to ``RANK_DIGITS`` places before ranking so that engines that sum in
a different order agree on the order.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trestle.config import (
    LABEL_AVERAGE,
    LABEL_HIGH,
    LABEL_LOW,
    PRIORITY_METRIC_CANDIDATES,
    ROWS_PER_PAGE,
    WEIGHT_COLUMN_CANDIDATES,
)
from trestle.functions.parse import nan_to_null, to_number
from trestle.operators.cleaning import distinct_rows, pick_column

RANK_DIGITS = 6
TOP_K = 5


def _num0(df: DataFrame, col: str | None, default: float = 0.0) -> Column:
    """C15 for any column type; a missing column gives ``default``."""
    if col is None or col not in df.columns:
        return F.lit(float(default))
    dtype = dict(df.dtypes)[col]
    c = F.col(col)
    v = to_number(c) if dtype == "string" else nan_to_null(c.cast("double"))
    return F.coalesce(v, F.lit(0.0))


def _top(df: DataFrame, metric: str, group_cols: tuple[str, ...], k: int, tie: str = "kpi_name") -> DataFrame:
    rounded = F.round(F.col(metric), RANK_DIGITS)
    order = [rounded.desc_nulls_last(), F.col(tie).asc_nulls_last()]
    if not group_cols:
        ranked = df.orderBy(*order).limit(k)
        w = Window.orderBy(*order)  # over <= k rows
        return ranked.withColumn("rank", F.row_number().over(w))
    w = Window.partitionBy(*group_cols).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: What selections and profiles tell KPI rows apart by, beside the KPI itself.
STATE_KEYS = ("projectId", "phase", "process_name", "impact_category", "kpi_name", "name_flag")
GAP_COLUMNS = ("phase_level_unrealized_value", "process_level_unrealized_value")


def kpi_states(kpis: DataFrame) -> DataFrame:
    """Partial states of the KPI means (A8-A11): counts and sums per ``STATE_KEYS``.

    Staged once; ``kpi_metrics`` and ``top_gap`` take this frame in the place of
    the KPI rows and merge the states of whatever a page selects.
    """
    weight_col, metric_col = pick_column(kpis, WEIGHT_COLUMN_CANDIDATES), pick_column(kpis, PRIORITY_METRIC_CANDIDATES)
    w = _num0(kpis, weight_col) if weight_col else F.lit(1.0)
    aggs = [F.count(F.lit(1)).alias("n_rows"), F.sum(_num0(kpis, "score") * w).alias("weighted_sum")]
    if metric_col is not None:
        aggs.append(F.sum(_num0(kpis, metric_col)).alias("priority_sum"))
    for c in GAP_COLUMNS:
        if c in kpis.columns:
            aggs += [F.sum(nan_to_null(c)).alias(f"{c}_sum"), F.count(nan_to_null(c)).alias(f"{c}_n")]
    return kpis.groupBy(*[k for k in STATE_KEYS if k in kpis.columns]).agg(*aggs)


def _is_states(kpis: DataFrame) -> bool:
    return "weighted_sum" in kpis.columns


def kpi_metrics(kpis: DataFrame, group_cols: tuple[str, ...] = ()) -> DataFrame:
    """A8 + A9 inputs in one aggregation per KPI: ``score_weighted`` =
    mean(score x weight) and, when a priority column exists,
    ``priority_metric`` = mean(unrealized); missing values count as 0.

    Both top-5 lists of a page read this one aggregate (Spark reuses its
    exchange), so the KPI facts are scanned and shuffled once, not twice.
    ``kpis`` may be their partial states (``kpi_states``).
    """
    if _is_states(kpis):
        src = kpis.where(F.col("kpi_name").isNotNull())
        for g in group_cols:
            src = src.where(F.col(g).isNotNull())
        sums = [("weighted_sum", "score_weighted"), ("priority_sum", "priority_metric")]
        means = [F.try_divide(F.sum(c), F.sum("n_rows")).alias(name) for c, name in sums if c in kpis.columns]
        return src.groupBy(*group_cols, "kpi_name").agg(*means)
    weight_col = pick_column(kpis, WEIGHT_COLUMN_CANDIDATES)
    w = _num0(kpis, weight_col) if weight_col else F.lit(1.0)
    metric_col = pick_column(kpis, PRIORITY_METRIC_CANDIDATES)
    src = kpis.where(F.col("kpi_name").isNotNull())
    for g in group_cols:
        src = src.where(F.col(g).isNotNull())
    aggs = [F.avg(_num0(kpis, "score") * w).alias("score_weighted")]
    if metric_col is not None:
        aggs.append(F.avg(_num0(kpis, metric_col)).alias("priority_metric"))
    return src.groupBy(*group_cols, "kpi_name").agg(*aggs)


def top_of(metrics: DataFrame, metric: str, group_cols: tuple[str, ...] = (), k: int = TOP_K) -> DataFrame | None:
    """Top k KPIs of one column of ``kpi_metrics`` (``None`` if absent)."""
    if metric not in metrics.columns:
        return None
    return _top(metrics.select(*group_cols, "kpi_name", metric), metric, group_cols, k)


def top_performing_kpis(
    kpis: DataFrame, group_cols: tuple[str, ...] = (), k: int = TOP_K
) -> DataFrame:
    """mean(score x weight) per KPI, top k.  Missing score or weight
    counts as 0; the weight is the first present candidate column, else 1.0."""
    return top_of(kpi_metrics(kpis, group_cols), "score_weighted", group_cols, k)


def top_priority_kpis(
    kpis: DataFrame, group_cols: tuple[str, ...] = (), k: int = TOP_K
) -> DataFrame | None:
    """mean(unrealized, missing = 0) per KPI, top k; the metric is the
    first present of process-level, phase-level, plain.  No such column ->
    ``None`` (the dashboard shows an empty list)."""
    return top_of(kpi_metrics(kpis, group_cols), "priority_metric", group_cols, k)


def top_gap(
    kpis: DataFrame, metric_col: str, group_cols: tuple[str, ...] = (), k: int = TOP_K,
    suppress_zero: bool = True,
) -> DataFrame:
    """A10/A11 (+A12): mean of an unrealized-value column per KPI, nulls
    skipped, top k (``Series.nlargest`` drops NaN means).  With
    ``suppress_zero`` a list whose k values sum to 0 gives no rows (A12).
    A frame without the metric column gives an empty list."""
    if metric_col not in kpis.columns and f"{metric_col}_n" not in kpis.columns:
        empty = kpis.where(F.lit(False)).select(*group_cols, "kpi_name", F.lit(None).cast("double").alias("gap"))
        return empty.withColumn("rank", F.lit(None).cast("int"))
    src = kpis.where(F.col("kpi_name").isNotNull())
    for g in group_cols:
        src = src.where(F.col(g).isNotNull())
    if _is_states(kpis):
        mean = F.try_divide(F.sum(f"{metric_col}_sum"), F.sum(f"{metric_col}_n"))
    else:
        mean = F.avg(nan_to_null(metric_col))
    agg = src.groupBy(*group_cols, "kpi_name").agg(mean.alias("gap")).where(F.col("gap").isNotNull())
    return top_gap_of(agg, group_cols, k, suppress_zero)


def top_gap_of(gaps: DataFrame, group_cols: tuple[str, ...] = (), k: int = TOP_K,
               suppress_zero: bool = True) -> DataFrame:
    """Top k of a per-KPI ``gap`` frame (no nulls), with A12."""
    top = _top(gaps, "gap", group_cols, k)
    if not suppress_zero:
        return top
    # The window runs over the <= k rows of each list.
    total = F.sum("gap").over(Window.partitionBy(*group_cols)) if group_cols else F.sum("gap").over(Window.partitionBy())
    return top.withColumn("_t", total).where(F.col("_t") != 0).drop("_t")


def priority_rank(rolled: DataFrame, group_cols: tuple[str, ...] = ()) -> DataFrame:
    """1..n by ``unrealized_value`` descending (missing last), no ties."""
    order = [F.round(F.col("unrealized_value"), RANK_DIGITS).desc_nulls_last(), F.col("kpi_name").asc_nulls_last()]
    w = Window.partitionBy(*group_cols).orderBy(*order) if group_cols else Window.orderBy(*order)
    return rolled.withColumn("priority", F.row_number().over(w))


def priority_label(rolled: DataFrame, group_cols: tuple[str, ...] = ()) -> DataFrame:
    """Labels by position after sorting on ``unrealized_value`` (missing
    filled with 0 first, and shown as 0): n>=5 -> 2 High and 2 Low; 2<=n<=4
    -> 1 and 1; n=1 -> High; the rest Average."""
    filled = rolled.withColumn("unrealized_value", F.coalesce(nan_to_null("unrealized_value"), F.lit(0.0)))
    order = [F.round(F.col("unrealized_value"), RANK_DIGITS).desc(), F.col("kpi_name").asc_nulls_last()]
    part = Window.partitionBy(*group_cols)
    w = part.orderBy(*order) if group_cols else Window.orderBy(*order)
    n = F.count(F.lit(1)).over(part) if group_cols else F.count(F.lit(1)).over(Window.partitionBy())
    pos = F.row_number().over(w)
    high = F.when(n >= 5, 2).when(n >= 2, 1).otherwise(1)
    low = F.when(n >= 5, 2).when(n >= 2, 1).otherwise(0)
    out = filled.withColumn("_pos", pos).withColumn("_n", n)
    label = (
        F.when(F.col("_pos") <= high, F.lit(LABEL_HIGH))
        .when(F.col("_pos") > F.col("_n") - low, F.lit(LABEL_LOW))
        .otherwise(F.lit(LABEL_AVERAGE))
    )
    return out.withColumn("impact_label", label).withColumnRenamed("_pos", "position").drop("_n")


#: A sort key: its expression and whether it ascends; missing values come last both ways.
SortKey = tuple[Column, bool]


def scoreboard_keys(column: str = "CR-Score", ascending: bool = False) -> list[SortKey]:
    """O1: any scoreboard column, then ``Segment``."""
    if column == "CR-Score":
        column = "cr_score"
    c = F.col(f"`{column}`")
    return [(F.round(c, RANK_DIGITS) if column == "cr_score" else c, ascending), (F.col("Segment"), True)]


def sort_order(keys: list[SortKey]) -> list[Column]:
    return [c.asc_nulls_last() if up else c.desc_nulls_last() for c, up in keys]


def sort_scoreboard(board: DataFrame, column: str = "CR-Score", ascending: bool = False) -> DataFrame:
    """O1: sort on any scoreboard column, missing values last both ways;
    ``Segment`` breaks ties."""
    return board.orderBy(*sort_order(scoreboard_keys(column, ascending)))


def with_positions(df: DataFrame, order: list[Column], name: str = "pos") -> tuple[DataFrame, int]:
    """``df`` with each row's place (from 1) in a global order, and the number of rows.

    Rows are range-partitioned by the whole order and numbered inside their
    partitions, and each partition's number is raised by the rows of those
    before it: no task sees more than its partition, however often a key
    repeats.  The numbered rows are written to the shared folder first, so that
    both readings see one numbering; ``staging.clean_stages`` removes them.
    """
    from trestle.sources import staging

    spark = df.sparkSession
    path = f"{staging.staging_root(spark)}/positions-{uuid.uuid4().hex}"
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    kept = spark.read.parquet(path)
    bits = 33  # of the row's place in monotonically_increasing_id; above it the partition
    kept = kept.withColumn("_part", F.shiftright("_at", bits))
    counts = kept.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition
    before = counts.select("_part", "_n", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    total = before.agg(F.sum("_n")).first()[0] or 0
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << bits) - 1)) + 1
    return kept.join(F.broadcast(before.drop("_n")), "_part").withColumn(name, place).drop("_at", "_part", "_before"), total


def sort_kpis(rolled: DataFrame, group_cols: tuple[str, ...] = ()) -> DataFrame:
    """O2: the KPI tables sorted by ``unrealized_value`` descending, missing
    last; the KPI name breaks ties.  Tables of several groups follow each
    other in the order of ``group_cols``."""
    order = [F.col("unrealized_value").desc_nulls_last(), F.col("kpi_name").asc_nulls_last()]
    return rolled.orderBy(*[F.col(g).asc_nulls_last() for g in group_cols], *order)


def page_bounds(total_rows: int, page: int, rows_per_page: int = ROWS_PER_PAGE) -> tuple[int, int]:
    """L1: clamp a page number; returns (page, total_pages)."""
    pages = max(1, math.ceil(total_rows / rows_per_page))
    return min(max(page, 0), pages - 1), pages


def page(sorted_df: DataFrame, page_no: int, total_rows: int | None = None, rows_per_page: int = ROWS_PER_PAGE) -> DataFrame:
    """L1: one page of an ordered frame, page clamped to the last one, in one plan.

    The rows up to the page's end are taken as a top-n selection (never a full
    sort of the frame); if there are fewer, they are all there is, so their
    number tells the last page and no count runs beside it.
    """
    if page_no <= 0:
        return sorted_df.limit(rows_per_page)
    if total_rows is not None:
        p, _ = page_bounds(total_rows, page_no, rows_per_page)
        return sorted_df.offset(p * rows_per_page).limit(rows_per_page)
    top = sorted_df.limit((page_no + 1) * rows_per_page).withColumn("_at", F.monotonically_increasing_id())
    taken = Window.partitionBy(F.lit(0))  # the rows taken, in one task as any top-n result
    place = F.floor((F.row_number().over(taken.orderBy("_at")) - 1) / rows_per_page)
    last = F.floor((F.count(F.lit(1)).over(taken) - 1) / rows_per_page)
    numbered = top.withColumns({"_page": place, "_last": F.least(F.lit(page_no), last)})
    return numbered.where("_page = _last").orderBy("_at").drop("_at", "_page", "_last")


#: From this page on a page is cut by positions: a top-n selection would move all rows before it into one task.
DEEP_PAGE = 20


def page_at(df: DataFrame, keys: list[SortKey], page_no: int, rows_per_page: int = ROWS_PER_PAGE) -> DataFrame:
    """L1: a page at any depth, clamped to the last one, by the rows' positions."""
    numbered, total = with_positions(df, sort_order(keys), "_pos")
    at, _ = page_bounds(total, page_no, rows_per_page)
    mine = numbered.where((F.col("_pos") > at * rows_per_page) & (F.col("_pos") <= (at + 1) * rows_per_page))
    return mine.orderBy("_pos").drop("_pos")


def page_after(df: DataFrame, keys: list[SortKey], token: tuple = (), rows_per_page: int = ROWS_PER_PAGE) -> DataFrame:
    """L1 by key: the rows that follow the row with this ``token`` (none: the first rows), each with its own.

    A filter and a top-n selection of one page, whatever the depth.
    """
    after = F.lit(False)
    same = F.lit(True)
    for (c, up), value in zip(keys, token, strict=bool(token)):
        if value is not None:  # missing values are last, nothing follows them
            after = after | (same & ((c > F.lit(value)) if up else (c < F.lit(value))).eqNullSafe(True)) | (same & c.isNull())
        same = same & c.eqNullSafe(F.lit(value))
    rest = df.where(after) if token else df
    own = F.struct(*[c.alias(f"k{i}") for i, (c, _) in enumerate(keys)]).alias("token")
    return rest.select("*", own).orderBy(*sort_order(keys)).limit(rows_per_page)


def top_items(items: DataFrame, metric: str, k: int = TOP_K, tie: str = "event_id",
              group_cols: tuple[str, ...] = ()) -> DataFrame:
    """L2/L3/L4: ``nlargest(k, metric)``: missing values never win, ties go
    to the first row (``tie`` is the natural row key)."""
    number = to_number(metric) if dict(items.dtypes)[metric] == "string" else nan_to_null(F.col(metric).cast("double"))
    order = [number.desc_nulls_last(), F.col(tie).asc_nulls_last()]
    src = items.where(number.isNotNull())
    if not group_cols:
        top = src.orderBy(*order).limit(k)
        return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    w = Window.partitionBy(*group_cols).orderBy(*order)
    return src.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def all_phase_kpis(
    kpis_by_phase: dict[str, DataFrame], phases: tuple[str, ...], repeated: DataFrame | None = None
) -> DataFrame | None:
    """Union of every phase's KPI table (missing columns as null) and
    whole-row dedup (``repeated`` as in ``distinct_rows``); ``None`` unless
    every phase is loaded."""
    if not all(p in kpis_by_phase for p in phases):
        return None
    frames = [kpis_by_phase[p] for p in phases]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return distinct_rows(out, repeated)
