"""Profiles (what differs between dashboard variants) and selections (filters).

All constants the results depend on are collected in the FIXED VALUES block
below, written out in the order the dashboards list them.
"""

from __future__ import annotations

import dataclasses
import datetime as dt
from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# FIXED VALUES — must equal the dashboards' own constants for equal results.
# ---------------------------------------------------------------------------

# Impact categories shown by the main dashboards, and by the cloud ones.
CATEGORIES_MAIN = ("Schedule", "Cost", "Safety")
CATEGORIES_CLOUD = ("cost",)

# Processes per phase, in display order (first phase is "bidding" in the main
# dashboards and "estimating" in the cloud ones; same process list).
PROCESSES_BY_PHASE = {
    "bidding": ("bidreview", "estimating", "compliance", "bidresults"),
    "preconstruction": ("financialSetup", "designReview", "compliance", "subcontractorPlanning"),
    "construction": ("operations", "quality", "safety", "financial", "communication"),
    "closeout": ("finalDocumentation", "punchlistCompletion", "financialReconciliation", "clientHandover"),
}

# The cloud dashboards name the first phase "estimating"; its process list is
# the one of "bidding".
PHASE_ALIASES = {"estimating": "bidding"}

# Display-name overrides for process keys; others are split on camelCase.
PROCESS_DISPLAY_OVERRIDES = {
    "bidreview": "Bid Review",
    "bidresults": "Bid Results",
    "finalDocumentation": "Final Documentation & As-Builts",
    "punchlistCompletion": "Punch List Completion",
    "financialReconciliation": "Financial Reconciliation",
    "clientHandover": "Client Handover & Satisfaction",
}

# Phase score columns of the scorecard, main dashboards / cloud dashboards.
PHASE_SCORE_COLUMNS_MAIN = {
    "bidding": "phaseScore_bidding",
    "preconstruction": "phaseScore_precon",
    "construction": "phaseScore_construction",
    "closeout": "phaseScore_closeout",
}
PHASE_SCORE_COLUMNS_CLOUD = {
    "estimating": "phaseScore_estimating",
    "preconstruction": "phaseScore_preconstruction",
    "construction": "phaseScore_construction",
    "closeout": "phaseScore_closeout",
}

# Executive impact estimate: score/100 x factor x 100.
IMPACT_FACTORS = {"cost": 0.18, "schedule": 0.30, "incidents": 0.60}

# Category multipliers and phase x category multipliers (legacy card).
CATEGORY_MULTIPLIERS = {"Schedule": 0.40, "Cost": 0.20, "Safety": 0.80}
PHASE_CATEGORY_MULTIPLIERS = {
    "bidding": {"Schedule": 0.02, "Cost": 0.06, "Safety": 0.08},
    "preconstruction": {"Schedule": 0.16, "Cost": 0.05, "Safety": 0.20},
    "construction": {"Schedule": 0.20, "Cost": 0.08, "Safety": 0.48},
    "closeout": {"Schedule": 0.02, "Cost": 0.01, "Safety": 0.04},
}

# Cost improvement models.  power: k * score^0.4875 * 100 for every phase.
IMPROVEMENT_EXPONENT = 0.4875
POWER_COEFFICIENTS = {"estimating": 0.0086, "preconstruction": 0.0129, "construction": 0.0228, "closeout": 0.0054}
# mixed: power for construction only, linear factors elsewhere.
LINEAR_FACTORS = {"estimating": 0.06, "preconstruction": 0.05, "closeout": 0.01}
LINEAR_FACTOR_DEFAULT = 0.03  # unknown phase, helper form only

# Letter grade lower bounds on a 0-100 score (else F).
GRADE_BOUNDS = (("A", 80.0), ("B", 60.0), ("C", 40.0), ("D", 20.0))

# Ratio bands of actual/possible: upper bounds of the first four bands.
RATIO_BAND_BOUNDS = (0.2, 0.4, 0.6, 0.8)

# Action item type -> phase; anything else -> construction.
ITEM_PHASE_MAP_CLOUD = {
    "rfi": "construction",
    "submittal": "construction",
    "observation": "construction",
    "incident": "construction",
    "punch_item": "closeout",
    "prime_contract_change_order": "construction",
    "prime_contract_invoice_payment": "construction",
}
ITEM_PHASE_MAP_LEGACY = {
    "rfi": "construction",
    "submittal": "construction",
    "observation": "construction",
    "incident": "construction",
    "punch_item": "closeout",
    "prime_contract_change_order": "preconstruction",
    "prime_contract_invoice_payment": "closeout",
}
ITEM_PHASE_DEFAULT = "construction"

# Header spellings of the 0/1 name-flag column in the input files; read as
# ``name_flag``.
FLAG_COLUMN_NAMES = ("VISTA_filter", "vista_filter")

# Candidate column names, first present wins.
WEIGHT_COLUMN_CANDIDATES = ("KPI wt", "kpi_wt", "kpi_weight", "importance_weight")
PRIORITY_METRIC_CANDIDATES = ("process_level_unrealized_value", "phase_level_unrealized_value", "unrealized_value")

# KPIs dropped inside one process only (phase construction, process safety),
# compared trimmed and lower-cased.
EXCLUDED_KPIS_IN_PROCESS = ("construction", "safety", ("near miss rate", "near miss detail quality"))

# Zero-weight KPIs dropped everywhere (exact match).
ZERO_WEIGHT_KPIS = ("Prime Contract Late Payment Rate", "Prime Contract Underpayment Rate")

# Value-range slider breakpoints (last label is unbounded).
VALUE_BREAKPOINTS = (0, 100000, 500000, 1000000, 5000000, 10000000, 25000000, 50000000, 100000000, 1000000000)

# Missing-value words read as null (the pandas CSV reader's default list).
NA_WORDS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Scoreboard paging and segment choices.
ROWS_PER_PAGE = 50
SEGMENT_COLUMNS = {"Project": "projectId", "Region": "region", "Project Manager": "projectManager"}

# Priority labels.
LABEL_HIGH, LABEL_AVERAGE, LABEL_LOW = "High", "Average", "Low"

# Name-flag three-way choice.
NAME_FLAG_ALL, NAME_FLAG_EXCLUDE, NAME_FLAG_ONLY = "all", "exclude", "only"

# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Profile:
    """What differs between the dashboard variants."""

    name: str
    categories: tuple[str, ...] = CATEGORIES_MAIN
    phase_score_columns: dict = field(default_factory=lambda: dict(PHASE_SCORE_COLUMNS_MAIN))
    # KPI ``score`` multiplier for display: 1 when stored 0-100, 100 when 0-1.
    kpi_score_scale: float = 1.0
    # improvement model: "power" | "mixed" | "helper"
    improvement_model: str = "power"
    item_phase_map: dict = field(default_factory=lambda: dict(ITEM_PHASE_MAP_CLOUD))
    # coverage denominator basis: "rows" (literal) | "projects"
    coverage_basis: str = "rows"
    excluded_kpis: tuple[str, ...] = ()
    exclude_flagged_at_load: bool = False
    # whole-row dedup of every table at load (the cloud download helper)
    dedup_at_load: bool = False
    # KPIs dropped at load inside one process of one phase: (phase, process, names)
    excluded_in_process: tuple | None = None
    # action items: category cut at load, plain equality filters and the
    # category filter on the page (main), or filters on the columns that exist
    main_items: bool = False
    # definitions in the cloud dashboards' longer list of names
    more_definitions: bool = False
    # a phase is loaded only when both its files have rows (object-store
    # variants) rather than merely exist (local variants)
    phase_files_nonempty: bool = False

    @property
    def phases(self) -> tuple[str, ...]:
        return tuple(self.phase_score_columns)

    def replace(self, **kw) -> "Profile":
        return dataclasses.replace(self, **kw)


PRESETS: dict[str, Profile] = {
    "main": Profile("main", excluded_in_process=EXCLUDED_KPIS_IN_PROCESS, main_items=True),
    "app": Profile("app", item_phase_map=dict(ITEM_PHASE_MAP_LEGACY)),
    "backup": Profile(
        "backup", item_phase_map=dict(ITEM_PHASE_MAP_LEGACY), dedup_at_load=True, phase_files_nonempty=True
    ),
    "actual": Profile(
        "actual",
        categories=CATEGORIES_CLOUD,
        phase_score_columns=dict(PHASE_SCORE_COLUMNS_CLOUD),
        kpi_score_scale=100.0,
        excluded_kpis=ZERO_WEIGHT_KPIS,
        more_definitions=True,
        dedup_at_load=True,
        phase_files_nonempty=True,
    ),
    "power": Profile(
        "power",
        categories=CATEGORIES_CLOUD,
        phase_score_columns=dict(PHASE_SCORE_COLUMNS_CLOUD),
        kpi_score_scale=100.0,
        improvement_model="power",
        item_phase_map=dict(ITEM_PHASE_MAP_LEGACY),
        dedup_at_load=True,
        phase_files_nonempty=True,
    ),
    "mixed": Profile(
        "mixed",
        categories=CATEGORIES_CLOUD,
        phase_score_columns=dict(PHASE_SCORE_COLUMNS_CLOUD),
        kpi_score_scale=100.0,
        improvement_model="mixed",
        exclude_flagged_at_load=True,
        dedup_at_load=True,
        phase_files_nonempty=True,
    ),
}


@dataclass(frozen=True)
class Selection:
    """Sidebar filters; ``None`` means the dashboard's "All ..." sentinel."""

    project: str | None = None
    region: str | None = None
    manager: str | None = None
    office: str | None = None
    program_manager: str | None = None
    stage: str | None = None
    person: str | None = None  # parsed people list membership
    name_flag: str = NAME_FLAG_ALL
    category: str | None = None
    # closed range on project value; high None = unbounded
    value_range: tuple[float, float | None] | None = None
    start_range: tuple[dt.date, dt.date] | None = None
    # literal behaviour of the newest dashboard: value filter always applied
    strict_value_range: bool = False

    def replace(self, **kw) -> "Selection":
        return dataclasses.replace(self, **kw)


def value_label_to_number(label: str) -> float | None:
    """``"$1,000,000"`` -> 1e6; the unbounded top label -> None."""
    if label.startswith(">"):
        return None
    return float(label.replace("$", "").replace(",", ""))


def value_options() -> list[str]:
    return [f"${v:,.0f}" for v in VALUE_BREAKPOINTS] + [f"> ${VALUE_BREAKPOINTS[-1]:,.0f}"]
