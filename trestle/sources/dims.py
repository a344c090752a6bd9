"""Dimension tables (S5, S6) and the KPI text lookups.

Dimensions are tiny and fixed by configuration; they are created with
``createDataFrame`` and joined with a ``broadcast`` hint (their size is
bounded by the configuration, not by the data).  The KPI texts are neutral
defaults; a deployment's own, from a CSV with the same columns
(``kpi_text_from_csv``), take their place where a model has them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trestle.config import PHASE_ALIASES, PHASE_CATEGORY_MULTIPLIERS, CATEGORY_MULTIPLIERS, PROCESSES_BY_PHASE
from trestle.functions.memo import plain_args_cache
from trestle.session import session_key

KPI_TEXT_SCHEMA = T.StructType(
    [
        T.StructField("kpi_key", T.StringType()),  # lower(trim(kpi_name))
        T.StructField("definition", T.StringType()),
        T.StructField("strength", T.StringType()),
        T.StructField("guidance", T.StringType()),
    ]
)

# FIXED VALUES: the KPI names (lower case) that have texts of their own.
KPI_NAMES = (
    "% of bids targeted", "as-built drawing accuracy", "avg days to submit bid", "avg insurance acquired cycle",
    "avg number of sub quotes per trade", "avg permit approval cycle", "avg selected sub emr",
    "avg sub coi received time", "avg sub quote variance", "avg sub response rate", "avg time to close punch item",
    "avg time to submit bid", "bid package completeness rate", "bid rate per $1m of acv", "bid win rate",
    "budget to bid variance", "budgets create date", "budgets usage rate", "change order time to close",
    "change order to budget ratio", "clash detection rate", "client satisfaction score",
    "client training completion", "compliance matrix completion rate", "contingency adequacy",
    "contract to budget ratio (deviation)", "cost variance", "daily logs delay", "daily logs rate",
    "days until sub contracts executed", "drawings usage", "equipment cost variance", "final payment received time",
    "gantt chart completion rate", "incident detail quality", "incident rate",
    "invoice to contract ratio (deviation)", "labor cost variance", "licensing & certification compliance rate",
    "materials cost variance", "meetings documentation", "meetings rate", "near miss detail quality",
    "near miss rate", "o&m manuals submitted timely", "observation rate", "observations closed on time",
    "payments to invoices ratio (deviation)", "permit submission timeliness", "photos usage",
    "prime contract to budget variance", "profit variance", "punch list items closed rate",
    "quality insp. attach. rate", "quality inspection rate", "rfis closed on time", "rfis lead time", "rfis rate",
    "safety insp. attach. rate", "safety inspection rate", "safety training", "schedule to bid variance",
    "schedule variance", "specifications usage", "sub prequal rate", "subcontractor final payments",
    "submittals closed on time", "submittals lead time", "submittals rate",
)

# FIXED VALUES: the names that the cloud dashboards have a definition for; they
# are looked up as written, capital letters included.
CLOUD_KPI_NAMES = (
    "RFI Avg Create Date",
    "RFI Avg Time to Resolution",
    "RFI % On Time",
    "RFI AverageLead Time",
    "RFI Usage Rate",
    "RFI Documentation Quality",
    "Submittals Avg Create Date",
    "Submittals Average Time to Resolution",
    "Submittals % Resolved on Time",
    "Submittals Average Lead Time",
    "Submittals Usage Rate",
    "Submittals Documentation Quality",
    "Daily Logs % with Issues",
    "Daily Logs Avg Create Date",
    "Daily Logs Avg Days until Created",
    "Daily Logs Rate",
    "Meetings Rate",
    "Meetings Documentation Quality",
    "Photos Usage",
    "Photos Avg Create Date",
    "Photos Avg Documentation Score",
    "Budgets Revision Rate",
    "Budgets Create Date",
    "Budgets Usage Rate",
    "Prime Contract Change Orders Documentation Quality",
    "Prime Contract Change Orders Project Percentage",
    "Prime Contract Estimated Average Payment Cycle",
    "Prime Contract Estimated Payment Ratio",
    "Prime Contract Invoices Rate",
    "Prime Contract Late Payment Rate",
    "Prime Contract Payment Error Rate",
    "Prime Contract Payment Rate",
    "Prime Contract to Budget Ratio",
    "Prime Contract to Invoice Ratio",
    "Prime Contract to Underpayment Rate",
    "Observations Average Days to Close",
    "Observations Average Lead Time",
    "Observations % Closed on Time",
    "Observations Documentation Quality",
    "Observations Rate",
    "Quality Inspection Rate",
    "Quality Inspections Conforming Rate",
    "Safety Inspection Rate",
    "Safety Inspection Conforming Rate",
    "Incident Detail Quality",
    "Incident Rate",
)

# FIXED VALUES: names that one of the cloud dashboards has besides.
MORE_CLOUD_KPI_NAMES = (
    "RFIs Avg Create Date",
    "RFIs Avg Days to Close",
    "RFIs Closed on Time",
    "RFIs Lead Time",
    "RFIs Usage Rate",
    "Submittals Avg Days to Close",
    "Submittals Closed on Time",
    "Submittals Lead Time",
    "Budget Revision Rate",
    "Observations Avg Days to Close",
    "Observations Avg Lead Time",
    "Observations Closed on Time",
    "Quality Inspections Deficiency Rate",
    "Safety Inspection Deficiency Rate",
    "Change Order Time to Close",
    "Change Order to Budget Ratio",
    "Contract to Budget Ratio (Deviation)",
    "Invoice to Contract Ratio (Deviation)",
    "Payments to Invoices Ratio (Deviation)",
)

# What kind of measure a name speaks of: the first kind with one of its words
# in the name.  The texts are neutral defaults; a deployment brings its own
# (``kpi_text_from_csv``).
MEASURE_KINDS = [
    (("variance", "deviation"), "Distance between what was agreed and what came out: {}.",
     "Agreement and outcome hardly differ here.", "Take the project that differs most and find out when it began to."),
    (("time", "days", "cycle", "delay", "date", "timel"), "How long it takes, or how late it is: {}.",
     "Little waiting shows up here.", "Write down where the days go, from the first to the last hand, and begin with the longest."),
    (("rate", "%", "ratio", "number"), "How often, or how large a part: {}.",
     "The count is where it ought to be.", "Compare the project with the best count to the one with the worst."),
    (("usage", "documentation", "training", "completion"), "How far it is put to use: {}.",
     "People do use it.", "Ask those who do without it what keeps them."),
    ((), "How well it is done: {}.", "It is done well.", "Pick one recent case and go through it together."),
]


def _kpi_texts() -> list[tuple[str, str, str, str]]:
    """(key, definition, strength, guidance) of every name, by its kind of measure."""
    rows = []
    for name in KPI_NAMES:
        _, definition, strength, guidance = next(k for k in MEASURE_KINDS if not k[0] or any(w in name for w in k[0]))
        rows.append((name, definition.format(name), f"{name}: {strength}", f"{name}: {guidance}"))
    return rows


KPI_TEXTS = _kpi_texts()


def cloud_definitions(more: bool = False) -> list[tuple[str, str]]:
    """(name as written, definition) of the cloud dashboards' names, by their kind of measure."""
    names = CLOUD_KPI_NAMES + (MORE_CLOUD_KPI_NAMES if more else ())
    kinds = [next(k for k in MEASURE_KINDS if not k[0] or any(w in n.lower() for w in k[0])) for n in names]
    return [(n, kind[1].format(n)) for n, kind in zip(names, kinds, strict=True)]

DEFAULT_DEFINITION_PREFIX = "No text is on record for "
DEFAULT_DEFINITION_SUFFIX = "."
DEFAULT_STRENGTH = "One of the best values in this selection."
DEFAULT_GUIDANCE = "Look at the projects with the lowest value of this KPI one by one."
NO_DEFINITION = "This KPI has no text."

# FIXED VALUES: the guidance keyword rules, in the dashboards' order (first
# match wins), checked on the lower-cased name; each rule is (all-of words,
# any-of words).  The texts are neutral defaults of this library.
GUIDANCE_RULES = [
    (("rfi", "lead time"), (), "Find out with whom unanswered RFIs lie."),
    (("rfi", "closed on time"), (), "Go through the late RFIs and ask what each one lacks."),
    (("rfi", "rate"), (), "See which drawings the most RFIs are about."),
    (("submittal", "lead time"), (), "Find out with whom pending submittals lie."),
    (("submittal", "rate"), (), "Read the returned submittals for what they have in common."),
    (("submittal", "closed on time"), (), "Go through the late submittals and ask what each one lacks."),
    ((), ("incident", "safety"), "Talk about the last reports with the crews they came from."),
    (("change order",), (), "See which kind of change order stays open longest."),
    (("punch",), (), "See which rooms and which trades the open entries belong to."),
    (("quality",), (), "Visit the place that most findings come from."),
    ((), ("cost", "budget"), "Split the figure by account and start with the largest share."),
    ((), ("schedule", "timeline"), "See which late activity holds up the most others."),
]


def kpi_key(name: Column | str) -> Column:
    c = F.col(name) if isinstance(name, str) else name
    return F.lower(F.trim(F.coalesce(c.cast("string"), F.lit(""))))


_DIM_FRAMES: dict[tuple[str, str], DataFrame] = {}


def _per_session(spark: SparkSession, name: str, build) -> DataFrame:
    # Small literal frames are immutable plans: build once per session.
    key = (session_key(spark), name)
    if key not in _DIM_FRAMES:
        for old in [k for k in _DIM_FRAMES if k[0] != key[0]]:
            del _DIM_FRAMES[old]
        _DIM_FRAMES[key] = build()
    return _DIM_FRAMES[key]


def kpi_text_dim(spark: SparkSession) -> DataFrame:
    """KPI text dimension keyed by ``lower(trim(kpi_name))``."""
    return _per_session(spark, "kpi_text", lambda: spark.createDataFrame(KPI_TEXTS, KPI_TEXT_SCHEMA))


def cloud_definition_dim(spark: SparkSession, more: bool = False) -> DataFrame:
    """S6 of the cloud dashboards: definitions keyed by the KPI name as written."""
    schema = "kpi_name string, definition string"
    return _per_session(spark, f"cloud_definitions{more}", lambda: spark.createDataFrame(cloud_definitions(more), schema))


def kpi_text_from_csv(spark: SparkSession, path: str) -> DataFrame:
    """S6 from a deployment's own CSV (columns as ``KPI_TEXT_SCHEMA``), one row per name as written (``kpi_name``)."""
    from trestle.sources.files import read_csv

    texts = read_csv(spark, path, KPI_TEXT_SCHEMA)
    columns = [F.col(f.name) if f.name in texts.columns else F.lit(None).cast("string").alias(f.name) for f in KPI_TEXT_SCHEMA]
    named = texts.select(*columns).withColumn("kpi_name", F.trim(F.coalesce("kpi_key", F.lit(""))))
    return named.withColumn("kpi_key", kpi_key("kpi_key")).dropDuplicates(["kpi_name"])


@plain_args_cache
def guidance_rule_text(key_col: str) -> Column:
    """Ordered keyword rules on a lower-cased KPI name column, then the default."""
    key = F.col(key_col)
    expr = None
    for all_of, any_of, text in GUIDANCE_RULES:
        cond = F.lit(True)
        for w in all_of:
            cond = cond & key.contains(w)
        if any_of:
            any_cond = F.lit(False)
            for w in any_of:
                any_cond = any_cond | key.contains(w)
            cond = cond & any_cond
        expr = F.when(cond, F.lit(text)) if expr is None else expr.when(cond, F.lit(text))
    return expr.otherwise(F.lit(DEFAULT_GUIDANCE))


def process_dim(spark: SparkSession, phases: tuple[str, ...] | None = None) -> DataFrame:
    """(phase, process_name, position) in configured display order, for
    the given phase names (an aliased phase takes its twin's list)."""
    rows = []
    for phase in phases if phases is not None else tuple(PROCESSES_BY_PHASE):
        procs = PROCESSES_BY_PHASE.get(phase) or PROCESSES_BY_PHASE.get(PHASE_ALIASES.get(phase, ""), ())
        rows.extend((phase, p, i) for i, p in enumerate(procs, start=1))
    schema = "phase string, process_name string, position int"
    return _per_session(spark, f"process:{phases}", lambda: spark.createDataFrame(rows, schema))


def category_multiplier_dim(spark: SparkSession) -> DataFrame:
    """Impact category multipliers (legacy card), in display order."""
    rows = [(c, m, i) for i, (c, m) in enumerate(CATEGORY_MULTIPLIERS.items(), start=1)]
    return _per_session(
        spark, "category", lambda: spark.createDataFrame(rows, "impact_category string, multiplier double, position int")
    )


def phase_multiplier_dim(spark: SparkSession) -> DataFrame:
    """Phase x category multipliers (legacy card)."""
    rows = [(p, c, m) for p, cm in PHASE_CATEGORY_MULTIPLIERS.items() for c, m in cm.items()]
    return _per_session(
        spark, "phase_mult", lambda: spark.createDataFrame(rows, "phase string, impact_category string, multiplier double")
    )
