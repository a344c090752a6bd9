"""Action items.

The item source can be large (one row per open item across the portfolio);
every filter here is a plain predicate pushed to the scan, and the top-k
lists never sort the whole table (see ``ranking.top_items``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trestle.config import Selection
from trestle.functions.display import title_item_type
from trestle.functions.parse import item_display
from trestle.operators.cleaning import with_item_phase
from trestle.operators.ranking import TOP_K, top_items

# Optional item columns compared as text (cloud dashboards), in filter order.
ITEM_FILTER_COLUMNS = (
    ("project", "projectId"),
    ("office", "office_name"),
    ("program_manager", "program_manager"),
    ("manager", "project_manager"),
    ("stage", "project_stage"),
)
PEOPLE_COLUMN = "project_managers"


def prepare_items(spark: SparkSession, items: DataFrame, phase_map: dict[str, str]) -> DataFrame:
    """C11 + C12: ``item_display`` and ``phase`` columns."""
    with_phase = with_item_phase(spark, items, phase_map)
    return with_phase.withColumn("item_display", item_display("risky_id"))


def filter_items_main(items: DataFrame, sel: Selection, category: str | None) -> DataFrame:
    """F10 (main): project / region / manager equality, then the category."""
    df = items
    for value, col in ((sel.project, "projectId"), (sel.region, "region"), (sel.manager, "projectManager")):
        if value is not None:
            df = df.where(F.col(col) == F.lit(value))
    if category is not None:
        df = df.where(F.col("impact_category") == F.lit(category))
    return df


def filter_items_optional(
    items: DataFrame, sel: Selection, flag_col: str = "name_flag", people: DataFrame | None = None
) -> DataFrame:
    """F10 (cloud): each filter applies only when the item table has the
    column (a missing column silently disables that filter), compared as
    text; then the person of the parsed people list and the three-way
    name-flag choice, where their columns exist."""
    from trestle.operators.filters import filter_name_flag, filter_person

    df = items
    for attr, col in ITEM_FILTER_COLUMNS:
        value = getattr(sel, attr)
        if value is not None and col in df.columns:
            df = df.where(F.col(col).cast("string") == F.lit(str(value)))
    if PEOPLE_COLUMN in df.columns:
        df = filter_person(df, sel.person, PEOPLE_COLUMN, people)
    return filter_name_flag(df, sel.name_flag, flag_col)


def filter_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """F10's "filtered from N to M items" note as one aggregate row."""
    filtered = after.agg(F.count(F.lit(1))).scalar()  # scalar subquery
    return before.agg(F.count(F.lit(1)).alias("original_count")).withColumn("filtered_count", filtered)


def shaped(top: DataFrame, key: str = "event_id") -> DataFrame:
    """W3 + X13: rank, project, title-cased type, item, required action; the
    item's key ``key`` stays."""
    return top.select(
        "rank",
        "projectId",
        title_item_type("item_type").alias("item_type_display"),
        "item_display",
        "required_action",
        *[c for c in ("phase", "risk_value", "weight", key) if c in top.columns],
    )


def top_items_by_weight(items: DataFrame, k: int = TOP_K, tie: str = "event_id") -> DataFrame:
    """L2: top k items by weight (main); every item column is kept, plus
    ``rank``."""
    return top_items(items, "weight", k, tie)


def top_items_by_risk(items: DataFrame, k: int = TOP_K, tie: str = "event_id") -> DataFrame:
    """L3: top k by risk over all phases, shaped for display."""
    return shaped(top_items(items, "risk_value", k, tie), tie)


def top_items_by_risk_per_phase(items: DataFrame, k: int = TOP_K, tie: str = "event_id",
                                phase: str | None = None) -> DataFrame:
    """L4: top k by risk inside each phase (or one phase), in one pass."""
    src = items if phase is None else items.where(F.col("phase") == F.lit(phase))
    return shaped(top_items(src, "risk_value", k, tie, group_cols=("phase",)), tie)
