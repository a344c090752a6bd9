"""Portfolio scoreboard (A14 with J2; sort O1, search F11, page L1 in
``trestle.operators.ranking`` / ``filters``).

Per segment (project, region or manager): mean score over every scorecard
row of the segment, and over the segment's *projects*, each counted once:
sum of project value (null when no value), earliest start, latest end.

Plan: the scorecard rows are first reduced to one partial row per
(segment, project) (map-side partial aggregate, then one shuffle), joined
with the project meta on ``projectId`` (one row per project on both sides;
AQE broadcasts the meta when it is small and splits skewed partitions when
not), and finally grouped by segment.  That last shuffle carries one row per
(segment, project) after another partial aggregate, so a segment holding a
third of all projects (one big region) still costs one row per map task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trestle.config import SEGMENT_COLUMNS
from trestle.functions.parse import nan_to_null


def scoreboard(summary: DataFrame, meta: DataFrame | None, segment_by: str = "Project") -> DataFrame:
    """One row per segment value (null segments dropped).

    Columns: ``Segment``, ``cr_score``, ``est_project_value``,
    ``est_start_date``, ``est_end_date``.
    """
    seg = SEGMENT_COLUMNS.get(segment_by, segment_by)
    src = summary.where(F.col(seg).isNotNull()).select(
        F.col(seg).alias("Segment"), "projectId", nan_to_null("score").alias("score")
    )
    per_project = src.groupBy("Segment", "projectId").agg(
        F.sum("score").alias("_s"), F.count("score").alias("_n")
    )
    if meta is not None:
        m = meta.select("projectId", "projValue", "startDate", "endDate")
        # A project absent from the meta contributes nothing to the sums.
        per_project = per_project.join(m, "projectId", "left")
    else:
        per_project = (
            per_project.withColumn("projValue", F.lit(None).cast("double"))
            .withColumn("startDate", F.lit(None).cast("date"))
            .withColumn("endDate", F.lit(None).cast("date"))
        )
    return per_project.groupBy("Segment").agg(
        F.try_divide(F.sum("_s"), F.sum("_n")).alias("cr_score"),
        F.sum("projValue").alias("est_project_value"),
        F.min("startDate").alias("est_start_date"),
        F.max("endDate").alias("est_end_date"),
    )


SORT_COLUMNS = {
    "Segment": "Segment",
    "CR-Score": "cr_score",
    "Estimated Project Value": "est_project_value",
    "Est Proj Start Date": "est_start_date",
    "Est Proj End Date": "est_end_date",
}
