"""Lookup joins (J3-J7) and the impact multipliers.

Every right-hand side here is a *configuration* table (process list, KPI
texts, multipliers): its size is fixed by the code, not by the data, so the
``broadcast`` hint is safe at any scale and the fact side is never shuffled
for these joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trestle.sources import dims


def attach_coverage(rolled: DataFrame, coverage: DataFrame, keys: tuple[str, ...] = ("kpi_name",)) -> DataFrame:
    """Left join a per-KPI coverage frame; of a key that it holds more
    than once, one row is used, so no row of ``rolled`` is multiplied."""
    return rolled.join(coverage.dropDuplicates(list(keys)), list(keys), "left")


def segment_meta(summary: DataFrame, meta: DataFrame, segment_col: str) -> DataFrame:
    """(segment, project) pairs of the selection, each once, with the
    project's meta; projects without meta are left out."""
    pairs = summary.select(segment_col, "projectId").distinct()
    return pairs.join(meta, "projectId")


def _text_lookup(
    spark: SparkSession, df: DataFrame, kpi_col: str, text_col: str, own: DataFrame | None
) -> DataFrame:
    # The built-in texts are configuration-sized; a deployment's own table is
    # left to the planner's size check.
    texts = F.broadcast(dims.kpi_text_dim(spark)) if own is None else own.dropDuplicates(["kpi_key"])
    texts = texts.select("kpi_key", text_col)
    return df.withColumn("_kpi_key", dims.kpi_key(kpi_col)).join(texts, F.col("_kpi_key") == F.col("kpi_key"), "left").drop("kpi_key")


def _definition_as_written(
    spark: SparkSession, df: DataFrame, kpi_col: str, own: DataFrame | None, more: bool
) -> DataFrame:
    # The cloud dashboards' dictionaries are looked up without lower-casing.
    texts = F.broadcast(dims.cloud_definition_dim(spark, more)) if own is None else own
    texts = texts.select(F.col("kpi_name").alias("_written"), "definition")
    name = F.coalesce(F.col(kpi_col).cast("string"), F.lit(""))
    return df.withColumn("_kpi_key", name).join(texts, F.col("_kpi_key") == F.col("_written"), "left").drop("_written")


def attach_definition(
    spark: SparkSession,
    df: DataFrame,
    kpi_col: str = "kpi_name",
    fallback: str = "sentence",
    exact_case: bool = False,
    texts: DataFrame | None = None,
    more_names: bool = False,
) -> DataFrame:
    """Definition by lower-cased name (main) or by the name as written
    (``exact_case``, cloud variants; ``more_names``: the longer of their two
    lists); else a sentence holding the name (``fallback="sentence"``) or one
    fixed default text (``"fixed"``)."""
    if exact_case:
        j = _definition_as_written(spark, df, kpi_col, texts, more_names)
    else:
        j = _text_lookup(spark, df, kpi_col, "definition", texts)
    if fallback == "sentence":
        name = F.trim(F.coalesce(F.col(kpi_col).cast("string"), F.lit("")))
        default = F.concat(F.lit(dims.DEFAULT_DEFINITION_PREFIX), name, F.lit(dims.DEFAULT_DEFINITION_SUFFIX))
    else:
        default = F.lit(dims.NO_DEFINITION)
    return j.withColumn("definition", F.coalesce(F.col("definition"), default)).drop("_kpi_key")


def attach_guidance(
    spark: SparkSession, df: DataFrame, kpi_col: str = "kpi_name", texts: DataFrame | None = None
) -> DataFrame:
    """Exact lookup, else the ordered keyword rules, else the default."""
    j = _text_lookup(spark, df, kpi_col, "guidance", texts)
    return j.withColumn("guidance", F.coalesce(F.col("guidance"), dims.guidance_rule_text("_kpi_key"))).drop(
        "_kpi_key"
    )


def attach_strength(
    spark: SparkSession, df: DataFrame, kpi_col: str = "kpi_name", texts: DataFrame | None = None
) -> DataFrame:
    """Exact lookup else the default strength text."""
    j = _text_lookup(spark, df, kpi_col, "strength", texts)
    return j.withColumn("strength", F.coalesce(F.col("strength"), F.lit(dims.DEFAULT_STRENGTH))).drop("_kpi_key")


def processes_with_default(
    spark: SparkSession, means: DataFrame, phases: tuple[str, ...] | None = None
) -> DataFrame:
    """The configured process list of each phase, left joined with the
    process means; an absent process scores 0, one whose rows are all null
    stays null (T22).  Display order is kept in ``position``."""
    proc = dims.process_dim(spark, phases)
    m = means.withColumn("_present", F.lit(True))
    # the kept side of an outer join can't be broadcast; the means are one row per process
    out = proc.join(m, ["phase", "process_name"] if "phase" in means.columns else ["process_name"], "left")
    return out.select(
        "phase",
        "process_name",
        "position",
        F.when(F.col("_present").isNull(), F.lit(0.0)).otherwise(F.col("process_score")).alias("process_score"),
    )


def category_impact(spark: SparkSession, category_scores: DataFrame) -> DataFrame:
    """Category score x the category's multiplier (legacy card)."""
    mult = dims.category_multiplier_dim(spark).select("impact_category", "multiplier")
    return category_scores.join(F.broadcast(mult), "impact_category", "left").withColumn(
        "category_impact", F.col("category_score") * F.col("multiplier")
    )


def phase_impact(spark: SparkSession, phase_scores: DataFrame) -> DataFrame:
    """Each phase score x the per-phase, per-category multiplier."""
    mult = dims.phase_multiplier_dim(spark)
    return phase_scores.join(F.broadcast(mult), "phase", "inner").withColumn(
        "phase_impact", F.col("phase_score") * F.col("multiplier")
    )
