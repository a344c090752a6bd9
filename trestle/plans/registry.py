"""Registry of every implemented operator / query, with its DuckDB oracle.

Each entry is a Spark callable ``(spark, sf_dir) -> DataFrame`` over the
test tables (through the adapter in ``trestle.sources.tpch``) and, where the
operator is expressible in SQL, an equivalent DuckDB query over the raw
tables (through the SQL twin of the adapter).  Results of both sides are
normalised the same way: doubles rounded to 6 places, integers as 64-bit.
Every query runs over the whole tables; limits appear only where they are
the feature (top-5 lists, one scoreboard page).
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trestle.config import (
    CATEGORY_MULTIPLIERS,
    IMPROVEMENT_EXPONENT,
    ITEM_PHASE_MAP_CLOUD,
    ITEM_PHASE_MAP_LEGACY,
    LINEAR_FACTORS,
    PHASE_CATEGORY_MULTIPLIERS,
    POWER_COEFFICIENTS,
    PRESETS,
    PROCESS_DISPLAY_OVERRIDES,
    PROCESSES_BY_PHASE,
    Selection,
)
from trestle.functions import display, parse, scoring
from trestle.operators import aggregates as A
from trestle.operators import cleaning as C
from trestle.operators import filters as FL
from trestle.operators import items as IT
from trestle.operators import joins as J
from trestle.operators import ranking as R
from trestle.operators.scoreboard import scoreboard
from trestle.plans import composites as Q
from trestle.plans import sqlparts as S
from trestle.sources import dims, files, parts, staging
from trestle.sources.model import Model, cloud_layout, for_profile, from_tpch
from trestle.sources.tpch_sql import ADAPTER_CTES

MAIN = PRESETS["main"]
APP = PRESETS["app"]
MIXED = PRESETS["mixed"]
POWER = PRESETS["power"]
SEL = Selection(category="Schedule")
CLOUD_SEL = Selection(category="cost")

# Selection parameters of the filter queries (values present in the data).
REGION = "EUROPE"
OFFICE = "BUILDING"
STAGE = "Construction"
PERSON = "Ann Lead3"
VALUE_RANGE = (1_000_000.0, 5_000_000.0)
START_RANGE = (dt.date(1995, 1, 1), dt.date(1996, 12, 31))
EXCLUDE_IN_SAFETY = (" brand#13 ", "BRAND#21")
ZERO_WEIGHT = ("Brand#13", "Brand#21")
SEARCH = "P-000001[0-4]"


@dataclass(frozen=True)
class Entry:
    fn: Callable[[SparkSession, str], DataFrame]
    select: str | None = None  # final SELECT of the oracle
    ctes: str = ""  # extra CTEs (after the adapter), without a leading comma
    dbl: tuple[str, ...] = ()  # double columns to round
    ints: tuple[str, ...] = ()  # integer columns to widen


ENTRIES: dict[str, Entry] = {}


def reg(key: str, select: str | None = None, ctes: str = "", dbl=(), ints=()):
    def deco(fn):
        ENTRIES[key] = Entry(fn, select, ctes, tuple(dbl), tuple(ints))
        return fn

    return deco


def normalize(df: DataFrame) -> DataFrame:
    """Doubles rounded to 6 places, every integer type as bigint."""
    cols = []
    for name, typ in df.dtypes:
        c = F.col(f"`{name}`")
        if typ in ("double", "float") or typ.startswith("decimal"):
            c = F.round(c.cast("double"), 6)
        elif typ in ("tinyint", "smallint", "int", "bigint"):
            c = c.cast("bigint")
        cols.append(c.alias(name))
    return df.select(*cols)


def oracle(key: str) -> str | None:
    e = ENTRIES[key]
    if e.select is None:
        return None
    extra = ",\n" + e.ctes.strip() if e.ctes.strip() else ""
    repl = [f'round(CAST("{c}" AS DOUBLE), 6) AS "{c}"' for c in e.dbl]
    repl += [f'CAST("{c}" AS BIGINT) AS "{c}"' for c in e.ints]
    outer = f"SELECT * REPLACE ({', '.join(repl)}) FROM _r" if repl else "SELECT * FROM _r"
    return f"WITH {ADAPTER_CTES.strip()},\n{SQL_BASE.strip()}{extra},\n_r AS (\n{e.select.strip()}\n)\n{outer}"


# --- models -----------------------------------------------------------------

# Profile views of a model are immutable plans: build each once.  The entry
# keeps its base model alive, so the id in the key is never reused.
_VIEWS: dict[tuple[int, str, str], tuple[Model, Model]] = {}


def _view(base: Model, kind: str, profile) -> Model:
    key = (id(base), kind, profile.name)
    if key not in _VIEWS:
        src = cloud_layout(base) if kind == "cloud" else base
        _VIEWS[key] = (base, for_profile(src, profile))
    return _VIEWS[key][1]


def main_model(spark: SparkSession, sf_dir: str) -> Model:
    return _view(from_tpch(spark, sf_dir), "main", MAIN)


def raw_model(spark: SparkSession, sf_dir: str) -> Model:
    return from_tpch(spark, sf_dir)


def cloud_model(spark: SparkSession, sf_dir: str, profile=MIXED) -> Model:
    return _view(from_tpch(spark, sf_dir), "cloud", profile)


# SQL twins of the models: main scorecard (F1), cloud layout (C7, F1), the
# project meta (A13) and the KPI text dimension.
def _kpi_text_values() -> str:
    rows = ", ".join(
        "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in r) + ")" for r in dims.KPI_TEXTS
    )
    return f"kpi_text AS (SELECT * FROM (VALUES {rows}) t(kpi_key, definition, strength, guidance))"


def _guidance_case(key: str) -> str:
    parts = []
    for all_of, any_of, text in dims.GUIDANCE_RULES:
        conds = [f"contains({key}, '{w}')" for w in all_of]
        if any_of:
            conds.append("(" + " OR ".join(f"contains({key}, '{w}')" for w in any_of) + ")")
        parts.append(f"WHEN {' AND '.join(conds)} THEN '{text}'")
    return f"CASE {' '.join(parts)} ELSE '{dims.DEFAULT_GUIDANCE}' END"


KEY = "lower(trim(coalesce(CAST(kpi_name AS VARCHAR), '')))"
CATS_MAIN = ", ".join(f"'{c}'" for c in MAIN.categories)
DATA_COLS_EXCLUDE = "l_orderkey, l_linenumber, l_partkey, l_suppkey"

SQL_BASE = f"""
sc AS (SELECT * FROM scorecard WHERE impact_category IN ({CATS_MAIN})),
csc AS (
  SELECT * EXCLUDE (impact_category, phaseScore_bidding, phaseScore_precon),
         lower(impact_category) AS impact_category,
         phaseScore_bidding AS phaseScore_estimating, phaseScore_precon AS phaseScore_preconstruction
  FROM scorecard WHERE lower(impact_category) IN ('cost') AND name_flag = 0),
ckpis AS (
  SELECT * REPLACE (CASE phase WHEN 'bidding' THEN 'estimating' ELSE phase END AS phase,
                    lower(impact_category) AS impact_category, score / 100.0 AS score)
  FROM kpis WHERE name_flag = 0),
meta_raw AS (
  SELECT projectId,
         {S.first_by('ProjValue', S.ROW_ORDER)} AS v,
         {S.first_by('startDate', S.ROW_ORDER)} AS s,
         {S.first_by('endDate', S.ROW_ORDER)} AS e
  FROM kpis WHERE phase = 'construction' AND projectId IS NOT NULL GROUP BY projectId),
meta AS (SELECT projectId, {S.parse_money('v')} AS projValue, {S.parse_date('s')} AS startDate,
                {S.parse_date('e')} AS endDate FROM meta_raw),
{_kpi_text_values()}
"""


def _sel_sql(category: str = "Schedule", table: str = "sc") -> str:
    return f"SELECT * FROM {table} WHERE impact_category = '{category}'"


# =============================================================================
# Sources and ingest
# =============================================================================

SCORECARD_COLS = (
    "projectId, region, projectManager, office_name, program_manager, project_stage, "
    "project_managers, name_flag, impact_category, score, phaseScore_bidding, phaseScore_precon, "
    "phaseScore_construction, phaseScore_closeout"
)
SC_DBL = ("score", "phaseScore_bidding", "phaseScore_precon", "phaseScore_construction", "phaseScore_closeout")


def _through_csv(spark, df, schema):
    """``df`` written as CSV files and read by the library's reader."""
    path = f"{staging.staging_root(spark)}/csv-{uuid.uuid4().hex}"
    df.write.options(header=True, quote='"', escape='"').csv(path)
    return files.read_csv(spark, path, schema)


@reg("scan_scorecard", f"SELECT {SCORECARD_COLS} FROM scorecard", dbl=SC_DBL, ints=("name_flag",))
def scan_scorecard(spark, d):
    return _through_csv(spark, raw_model(spark, d).scorecard, files.SCORECARD_SCHEMA).withColumn("name_flag", F.col("name_flag").cast("long"))


NULL_ACTUAL = "nullif(actual, 'n/a') AS actual"
PHASE_TABLE_COLS = "phase, projectId, impact_category, process_name, kpi_name, actual, score, unrealized_value, ProjValue, startDate"


@reg("scan_phase_tables",
     f"SELECT 'kpis' AS file, {PHASE_TABLE_COLS.replace('actual', NULL_ACTUAL)} FROM kpis UNION ALL "
     "SELECT 'processes', phase, projectId, impact_category, process_name, NULL, NULL, score, NULL, NULL, NULL FROM processes",
     dbl=("score", "unrealized_value"))
def scan_phase_tables(spark, d):
    """The process and the KPI file of every phase through the reader; a phase counts only with both."""
    m = raw_model(spark, d)
    cols = PHASE_TABLE_COLS.split(", ")
    out = []
    for kind, df, schema in (("kpis", m.kpis, files.KPI_SCHEMA), ("processes", m.processes, files.PROCESS_SCHEMA)):
        # rows whose actual is a missing-value word come back as null
        read = _through_csv(spark, df.select(*[c for c in cols if c in df.columns]), schema)
        full = read.select(*[F.col(c) if c in read.columns else F.lit(None).cast("string").alias(c) for c in cols])
        typed = full.withColumns({c: F.col(c).cast("double") for c in ("score", "unrealized_value")})
        out.append(typed.select(F.lit(kind).alias("file"), *cols))
    both = out[0].select("phase").distinct().join(out[1].select("phase").distinct(), "phase")
    return out[0].unionByName(out[1]).join(F.broadcast(both), "phase", "left_semi").select("file", *cols)


ITEM_COLS = ("event_id, projectId, region, projectManager, office_name, program_manager, project_stage, "
             "project_managers, project_manager, name_flag, impact_category, item_type, risky_id, risk_value, "
             "weight, required_action")


@reg("scan_action_items", f"SELECT {ITEM_COLS} FROM action_items", dbl=("risk_value", "weight"), ints=("event_id", "name_flag"))
def scan_action_items(spark, d):
    read = _through_csv(spark, raw_model(spark, d).action_items, files.ACTION_ITEM_SCHEMA)
    return read.withColumns({c: F.col(c).cast("long") for c in ("event_id", "name_flag")})


@reg("csv_parts_rollup",
     "SELECT phase, kpi_name, avg(coalesce(score, 0) * coalesce(kpi_wt, 0)) AS score_weighted, count(*) AS n_rows "
     "FROM kpis WHERE kpi_name IS NOT NULL GROUP BY phase, kpi_name",
     dbl=("score_weighted",), ints=("n_rows",))
def csv_parts_rollup(spark, d):
    """The files of every phase staged file by file, and the partial states of the parts merged (A8 per phase)."""
    m, profile = raw_model(spark, d), PRESETS["app"]
    base = f"{staging.staging_root(spark)}/csv-{uuid.uuid4().hex}"
    cols = [c for c in m.data_columns(m.kpis) if c != "phase"]
    tables = {"executive_summary": m.scorecard}
    for phase in profile.phases:
        tables[f"{phase}_kpis"] = m.phase_kpis(phase).select(*cols)
        tables[f"{phase}_processes"] = m.phase_processes(phase).drop("phase")
    for name, df in tables.items():
        df.write.options(header=True, quote='"', escape='"', compression="gzip").csv(f"{base}/{name}.csv")
    staged = parts.load_csv_parts(spark, base, profile)
    counts = staged.states.where(F.col("kpi_name").isNotNull()).groupBy("phase", "kpi_name").agg(F.sum("n_rows").alias("n_rows"))
    return R.kpi_metrics(staged.states, ("phase",)).select("phase", "kpi_name", "score_weighted").join(counts, ["phase", "kpi_name"])


@reg("scan_object_store", "SELECT event_id, ts, user_id, event_type, value FROM events",
     dbl=("value",), ints=("event_id", "user_id"))
def scan_object_store(spark, d):
    """The rows of an object by bucket URI; a missing object adds none."""
    sch = T._parse_datatype_string("event_id bigint, ts timestamp, user_id bigint, event_type string, value double")
    got = files.read_or_empty(spark, files.object_uri(d, "", "events.parquet"), sch, fmt="parquet")
    missing = files.read_or_empty(spark, files.object_uri(d, "absent-prefix", "events.parquet"), sch, fmt="parquet")
    return got.select(*sch.names).unionByName(missing.select(*sch.names))


@reg("drop_dup_rows", f"SELECT DISTINCT * EXCLUDE ({DATA_COLS_EXCLUDE}) FROM kpis",
     dbl=("score", "unrealized_value", "process_level_unrealized_value", "phase_level_unrealized_value"),
     ints=("kpi_wt", "name_flag"))
def drop_dup_rows(spark, d):
    m = raw_model(spark, d)
    return C.drop_dup_rows(m.kpis.select(*m.data_columns(m.kpis)), repeated=m.repeated)


@reg("tag_phase",
     "SELECT phase, upper(substr(phase, 1, 1)) || lower(substr(phase, 2)) AS phase_label, count(*) AS n_rows "
     "FROM kpis GROUP BY phase", ints=("n_rows",))
def tag_phase(spark, d):
    k = raw_model(spark, d).kpis
    return k.groupBy("phase").agg(F.count(F.lit(1)).alias("n_rows")).select(
        "phase", C.phase_label("phase").alias("phase_label"), "n_rows"
    )


_EXCL = ", ".join(f"'{n.strip().lower()}'" for n in EXCLUDE_IN_SAFETY)


@reg("exclude_kpis_in_process",
     f"""SELECT phase, process_name, count(*) AS n_rows FROM kpis
         WHERE NOT (phase = 'construction'
                    AND coalesce(lower(trim(process_name)), 'nan') = 'safety'
                    AND coalesce(lower(trim(kpi_name)), 'nan') IN ({_EXCL}))
         GROUP BY phase, process_name""", ints=("n_rows",))
def exclude_kpis_in_process(spark, d):
    k = C.exclude_kpis_in_process(raw_model(spark, d).kpis, "construction", "safety", EXCLUDE_IN_SAFETY)
    return k.groupBy("phase", "process_name").agg(F.count(F.lit(1)).alias("n_rows"))


@reg("exclude_kpis",
     f"""SELECT phase, count(*) AS n_rows, count(DISTINCT kpi_name) AS n_kpis FROM kpis
         WHERE kpi_name IS NULL OR kpi_name NOT IN ({', '.join(f"'{n}'" for n in ZERO_WEIGHT)})
         GROUP BY phase""", ints=("n_rows", "n_kpis"))
def exclude_kpis(spark, d):
    k = C.exclude_kpis(raw_model(spark, d).kpis, ZERO_WEIGHT)
    return k.groupBy("phase").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("kpi_name").alias("n_kpis"))


@reg("exclude_flagged",
     "SELECT impact_category, count(*) AS n_rows, avg(score) AS mean_score FROM scorecard WHERE name_flag = 0 "
     "GROUP BY impact_category", dbl=("mean_score",), ints=("n_rows",))
def exclude_flagged(spark, d):
    sc = C.exclude_flagged(raw_model(spark, d).scorecard)
    return sc.groupBy("impact_category").agg(F.count(F.lit(1)).alias("n_rows"), F.avg("score").alias("mean_score"))


@reg("parse_value", f"SELECT DISTINCT actual, {S.parse_value('actual')} AS actual_numeric FROM kpis",
     dbl=("actual_numeric",))
def parse_value(spark, d):
    return raw_model(spark, d).kpis.select("actual", parse.parse_value("actual").alias("actual_numeric")).distinct()


@reg("parse_money", f"SELECT DISTINCT ProjValue, {S.parse_money('ProjValue')} AS proj_value FROM kpis",
     dbl=("proj_value",))
def parse_money(spark, d):
    return raw_model(spark, d).kpis.select("ProjValue", parse.parse_money("ProjValue").alias("proj_value")).distinct()


@reg("parse_date", f"SELECT DISTINCT startDate, {S.parse_date('startDate')} AS start_date FROM kpis")
def parse_date(spark, d):
    return raw_model(spark, d).kpis.select("startDate", parse.parse_date("startDate").alias("start_date")).distinct()


ITEM_DISPLAY_SQL = (
    f"coalesce(nullif(regexp_extract(risky_id, '{parse.ITEM_DISPLAY_PATTERN}', 1), ''), risky_id)"
)


@reg("item_display", f"SELECT event_id, risky_id, {ITEM_DISPLAY_SQL} AS item_display FROM action_items",
     ints=("event_id",))
def item_display(spark, d):
    it = raw_model(spark, d).action_items
    return it.select("event_id", "risky_id", parse.item_display("risky_id").alias("item_display"))


def _map_case(col: str, mapping: dict[str, str], default: str) -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + f" ELSE '{default}' END"


@reg("item_phase",
     f"""SELECT item_type, {_map_case('item_type', ITEM_PHASE_MAP_CLOUD, 'construction')} AS phase_cloud,
                {_map_case('item_type', ITEM_PHASE_MAP_LEGACY, 'construction')} AS phase_legacy,
                count(*) AS n_items
         FROM action_items GROUP BY item_type""", ints=("n_items",))
def item_phase(spark, d):
    it = raw_model(spark, d).action_items
    a = C.with_item_phase(spark, it, ITEM_PHASE_MAP_CLOUD).withColumnRenamed("phase", "phase_cloud")
    b = C.with_item_phase(spark, a, ITEM_PHASE_MAP_LEGACY).withColumnRenamed("phase", "phase_legacy")
    return b.groupBy("item_type", "phase_cloud", "phase_legacy").agg(F.count(F.lit(1)).alias("n_items"))


@reg("parse_people",
     f"SELECT DISTINCT project_managers, array_to_string({S.people('project_managers')}, ';') AS people FROM scorecard")
def parse_people(spark, d):
    sc = raw_model(spark, d).scorecard
    return sc.select("project_managers", F.array_join(parse.parse_people("project_managers"), ";").alias("people")).distinct()


@reg("zero_fill_numeric",
     f"SELECT DISTINCT actual, coalesce({S.num('actual')}, 0.0) AS actual_zero FROM kpis", dbl=("actual_zero",))
def zero_fill_numeric(spark, d):
    k = raw_model(spark, d).kpis
    return C.zero_filled(k.select("actual"), "actual", "actual_zero").distinct()


# =============================================================================
# Filters
# =============================================================================

@reg("allow_categories", "SELECT impact_category, count(*) AS n_rows FROM sc GROUP BY impact_category",
     ints=("n_rows",))
def allow_categories(spark, d):
    sc = FL.allow_categories(raw_model(spark, d).scorecard, MAIN.categories)
    return sc.groupBy("impact_category").agg(F.count(F.lit(1)).alias("n_rows"))


@reg("filter_project_region_pm",
     f"SELECT projectId, impact_category, score FROM sc WHERE region = '{REGION}' AND projectManager = 'NATION_8'",
     dbl=("score",))
def filter_project_region_pm(spark, d):
    sel = Selection(region=REGION, manager="NATION_8")
    return FL.filter_project_region_pm(main_model(spark, d).scorecard, sel).select("projectId", "impact_category", "score")


@reg("filter_office_program_stage",
     f"""SELECT projectId, impact_category, score FROM sc
         WHERE CAST(office_name AS VARCHAR) = '{OFFICE}' AND CAST(program_manager AS VARCHAR) = 'PgM {REGION}'
           AND CAST(project_stage AS VARCHAR) = '{STAGE}'""", dbl=("score",))
def filter_office_program_stage(spark, d):
    sel = Selection(office=OFFICE, program_manager=f"PgM {REGION}", stage=STAGE)
    return FL.filter_office_program_stage(main_model(spark, d).scorecard, sel).select("projectId", "impact_category", "score")


@reg("filter_person",
     f"""SELECT projectId, impact_category, score FROM sc
         WHERE project_managers IS NOT NULL AND list_contains({S.people('project_managers')}, '{PERSON}')""",
     dbl=("score",))
def filter_person(spark, d):
    m = main_model(spark, d)
    return FL.filter_person(m.scorecard, PERSON, people=m.people).select("projectId", "impact_category", "score")


@reg("filter_name_flag", "SELECT projectId, impact_category, score FROM sc WHERE name_flag = 1", dbl=("score",))
def filter_name_flag(spark, d):
    return FL.filter_name_flag(main_model(spark, d).scorecard, "only").select("projectId", "impact_category", "score")


@reg("filter_category", "SELECT projectId, score FROM sc WHERE impact_category = 'Cost'", dbl=("score",))
def filter_category(spark, d):
    return FL.filter_category(main_model(spark, d).scorecard, "Cost").select("projectId", "score")


@reg("filter_value_range",
     f"""SELECT projectId, impact_category, score FROM sc
         WHERE projectId IN (SELECT projectId FROM meta WHERE projValue BETWEEN {VALUE_RANGE[0]} AND {VALUE_RANGE[1]})""",
     dbl=("score",))
def filter_value_range(spark, d):
    m = main_model(spark, d)
    sel = Selection(value_range=VALUE_RANGE)
    return FL.apply_selection(m.scorecard, sel, Q.project_meta_of(m)).select("projectId", "impact_category", "score")


@reg("filter_start_date",
     f"""SELECT projectId, impact_category, score FROM sc
         WHERE projectId IN (SELECT projectId FROM meta
                             WHERE startDate BETWEEN DATE '{START_RANGE[0]}' AND DATE '{START_RANGE[1]}')""",
     dbl=("score",))
def filter_start_date(spark, d):
    m = main_model(spark, d)
    sel = Selection(start_range=START_RANGE)
    return FL.apply_selection(m.scorecard, sel, Q.project_meta_of(m)).select("projectId", "impact_category", "score")


@reg("filter_process",
     "SELECT projectId, phase, kpi_name, score, l_orderkey, l_linenumber FROM kpis WHERE process_name = 'quality'",
     dbl=("score",), ints=("l_orderkey", "l_linenumber"))
def filter_process(spark, d):
    k = FL.filter_process(raw_model(spark, d).kpis, "quality")
    return k.select("projectId", "phase", "kpi_name", "score", "l_orderkey", "l_linenumber")


@reg("filter_action_items",
     f"""SELECT 'columns' AS form, event_id, projectId, risk_value FROM action_items
         WHERE CAST(office_name AS VARCHAR) = '{OFFICE}' AND CAST(project_stage AS VARCHAR) = '{STAGE}'
         UNION ALL SELECT 'person', event_id, projectId, risk_value FROM action_items
         WHERE list_contains({S.people('project_managers')}, '{PERSON}') AND name_flag = 1
         UNION ALL SELECT 'main', event_id, projectId, risk_value FROM action_items
         WHERE region = '{REGION}' AND impact_category = 'Schedule'""",
     dbl=("risk_value",), ints=("event_id",))
def filter_action_items(spark, d):
    """filters on the columns that exist, the person and flag filters, and the main form."""
    m = raw_model(spark, d)
    it = m.action_items
    forms = {
        "columns": IT.filter_items_optional(it, Selection(office=OFFICE, stage=STAGE)),
        "person": IT.filter_items_optional(it, Selection(person=PERSON, name_flag="only"), people=m.people),
        "main": IT.filter_items_main(it, Selection(region=REGION), "Schedule"),
    }
    parts = [df.select(F.lit(k).alias("form"), "event_id", "projectId", "risk_value") for k, df in forms.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@reg("action_item_counts",
     f"""SELECT count(*) AS original_count, count(*) FILTER (WHERE region = '{REGION}' AND impact_category = 'Schedule') AS filtered_count
         FROM action_items""", ints=("original_count", "filtered_count"))
def action_item_counts(spark, d):
    """F10's note: items before and after the filters."""
    return Q.action_item_counts(spark, main_model(spark, d), MAIN, Selection(region=REGION, category="Schedule"))


@reg("filter_item_phase",
     f"""SELECT event_id, item_type FROM action_items
         WHERE {_map_case('item_type', ITEM_PHASE_MAP_CLOUD, 'construction')} = 'closeout'""", ints=("event_id",))
def filter_item_phase(spark, d):
    it = C.with_item_phase(spark, raw_model(spark, d).action_items, ITEM_PHASE_MAP_CLOUD)
    return FL.filter_item_phase(it, "closeout").select("event_id", "item_type")


BOARD_SQL = """
pp AS (SELECT {seg} AS Segment, projectId, sum(score) AS s, count(score) AS n
       FROM {src} WHERE {seg} IS NOT NULL GROUP BY {seg}, projectId),
board AS (SELECT Segment, sum(s) / sum(n) AS cr_score, sum(m.projValue) AS est_project_value,
                 min(m.startDate) AS est_start_date, max(m.endDate) AS est_end_date
          FROM pp LEFT JOIN meta m USING (projectId) GROUP BY Segment)
"""
BOARD_DBL = ("cr_score", "est_project_value")


@reg("search_segments",
     f"SELECT Segment, cr_score FROM board WHERE coalesce(regexp_matches(CAST(Segment AS VARCHAR), '(?i){SEARCH}'), false)",
     ctes=BOARD_SQL.format(seg="projectId", src="sc"), dbl=("cr_score",))
def search_segments(spark, d):
    m = main_model(spark, d)
    board = scoreboard(m.scorecard, Q.project_meta_of(m), "Project")
    return FL.search_segments(board, SEARCH).select("Segment", "cr_score")


@reg("project_meta_columns",
     "SELECT DISTINCT projectId, ProjValue, startDate FROM kpis WHERE phase = 'construction'")
def project_meta_columns(spark, d):
    return FL.project_meta_columns(raw_model(spark, d).phase_kpis("construction"), ("projectId", "ProjValue", "startDate"))


# =============================================================================
# Joins
# =============================================================================

@reg("propagate_projects",
     f"""SELECT phase, process_name, count(*) AS n_rows, count(DISTINCT projectId) AS n_projects FROM kpis
         WHERE projectId IN (SELECT projectId FROM sc WHERE impact_category = 'Schedule' AND region = '{REGION}')
         GROUP BY phase, process_name""", ints=("n_rows", "n_projects"))
def propagate_projects(spark, d):
    m = main_model(spark, d)
    _, summary = Q.selections(m, Selection(category="Schedule", region=REGION))
    k = FL.propagate_projects(m.kpis, summary)
    return k.groupBy("phase", "process_name").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("projectId").alias("n_projects")
    )


@reg("segment_to_meta",
     """SELECT p.region, p.projectId, m.projValue, m.startDate FROM (SELECT DISTINCT region, projectId FROM sc) p
        JOIN meta m USING (projectId)""", dbl=("projValue",))
def segment_to_meta(spark, d):
    m = main_model(spark, d)
    return J.segment_meta(m.scorecard, Q.project_meta_of(m), "region").select("region", "projectId", "projValue", "startDate")


def _rollup_sql(src: str, coverage: bool, scale: str = "1") -> str:
    """A5 (+A6): averaged rows for groups with more than one project, the
    rows themselves otherwise."""
    cov = ", count(actual_numeric) * 100.0 / max(n_projects) AS percent_of_projects" if coverage else ""
    cov1 = (", CASE WHEN kpi_name IS NOT NULL THEN count(actual_numeric) OVER (PARTITION BY phase, process_name, kpi_name) "
            "* 100.0 / n_projects END AS percent_of_projects") if coverage else ""
    return f"""
src AS (SELECT *, {S.parse_value('actual')} AS actual_numeric FROM {src} WHERE process_name IS NOT NULL),
np AS (SELECT phase, process_name, count(DISTINCT projectId) AS n_projects FROM src
       WHERE projectId IS NOT NULL GROUP BY phase, process_name),
j AS (SELECT src.*, coalesce(np.n_projects, 0) AS n_projects FROM src LEFT JOIN np USING (phase, process_name)),
rolled AS (
  SELECT phase, process_name, kpi_name, avg(actual_numeric) AS actual_numeric, avg(score) * {scale} AS score,
         avg(unrealized_value) AS unrealized_value,
         {S.first_by('bp_range_display', S.ROW_ORDER)} AS bp_range_display,
         {S.first_by('unit', S.ROW_ORDER)} AS unit{cov}, true AS is_averaged
  FROM j WHERE n_projects > 1 AND kpi_name IS NOT NULL GROUP BY phase, process_name, kpi_name
  UNION ALL
  SELECT phase, process_name, kpi_name, actual_numeric, score * {scale}, unrealized_value, bp_range_display,
         unit{cov1}, false FROM j WHERE n_projects <= 1)
"""


SEL_KPIS = "(SELECT * FROM kpis WHERE impact_category = 'Schedule' AND projectId IN (SELECT projectId FROM sc WHERE impact_category = 'Schedule'))"
CSEL_KPIS = "(SELECT * FROM ckpis WHERE impact_category = 'cost' AND projectId IN (SELECT projectId FROM csc WHERE impact_category = 'cost'))"
# the same, restricted to the configured processes of each phase (pages)
SEL_KPIS_CONF = f"(SELECT * FROM {SEL_KPIS} WHERE (phase, process_name) IN (SELECT phase, process_name FROM pdim))"
CSEL_KPIS_CONF = ("(SELECT * FROM " + CSEL_KPIS + " WHERE (CASE phase WHEN 'estimating' THEN 'bidding' ELSE phase END, "
                  "process_name) IN (SELECT phase, process_name FROM pdim))")


def _rolled_main(spark, d, coverage=False, basis="rows", scale=1.0):
    m = main_model(spark, d)
    _, summary = Q.selections(m, SEL)
    k = FL.filter_category(FL.propagate_projects(m.kpis, summary), "Schedule").where(F.col("process_name").isNotNull())
    r = A.kpi_rollup(k, ("phase", "process_name"), m.row_order, with_coverage=coverage, coverage_basis=basis, words=m.words)
    return r.withColumn("score", F.col("score") * scale)


@reg("attach_coverage",
     "SELECT phase, process_name, kpi_name, actual_numeric, score, percent_of_projects FROM rolled",
     ctes=_rollup_sql(SEL_KPIS, True), dbl=("actual_numeric", "score", "percent_of_projects"))
def attach_coverage(spark, d):
    return _rolled_main(spark, d, coverage=True).select(
        "phase", "process_name", "kpi_name", "actual_numeric", "score", "percent_of_projects"
    )


def _rollup_by_sql(key: str) -> str:
    """A5 + A6 over all KPI rows: groups of phase, process and ``key``; J3 gives their KPIs' coverage."""
    by = f"phase, process_name, {key}"
    return f"""
src AS (SELECT *, {S.parse_value('actual')} AS actual_numeric FROM kpis WHERE process_name IS NOT NULL),
np AS (SELECT {by}, count(DISTINCT projectId) AS n_projects FROM src WHERE projectId IS NOT NULL GROUP BY {by}),
j AS (SELECT src.*, coalesce(np.n_projects, 0) AS n_projects FROM src LEFT JOIN np USING ({by})),
rolled AS (
  SELECT {by}, kpi_name, avg(actual_numeric) AS actual_numeric, avg(score) AS score,
         count(actual_numeric) * 100.0 / max(n_projects) AS percent_of_projects, true AS is_averaged
  FROM j WHERE n_projects > 1 AND kpi_name IS NOT NULL GROUP BY {by}, kpi_name
  UNION ALL
  SELECT {by}, kpi_name, actual_numeric, score,
         CASE WHEN kpi_name IS NOT NULL THEN count(actual_numeric) OVER (PARTITION BY {by}, kpi_name) * 100.0 / n_projects END,
         false FROM j WHERE n_projects <= 1)
"""


def _rolled_by(m: Model, kpis: DataFrame, key: str) -> DataFrame:
    groups = ("phase", "process_name", key)
    rolled = A.kpi_rollup(kpis, groups, m.row_order, words=m.words)
    return J.attach_coverage(rolled, A.coverage(kpis, groups), (*groups, "kpi_name")).select(
        *groups, "kpi_name", "actual_numeric", "score", "percent_of_projects", "is_averaged"
    )


@reg("kpi_rollup_by_part",
     "SELECT phase, process_name, l_partkey, kpi_name, actual_numeric, score, percent_of_projects, is_averaged FROM rolled",
     ctes=_rollup_by_sql("l_partkey"), dbl=("actual_numeric", "score", "percent_of_projects"))
def kpi_rollup_by_part(spark, d):
    """A5 + J3 over all KPI rows by phase, process and part: many parts have a single project, the others several."""
    m = raw_model(spark, d)
    return _rolled_by(m, m.kpis.where(F.col("process_name").isNotNull()), "l_partkey")


@reg("kpi_rollup_single",
     "SELECT phase, process_name, projectId, kpi_name, actual_numeric, score, percent_of_projects, is_averaged FROM rolled",
     ctes=_rollup_by_sql("projectId"), dbl=("actual_numeric", "score", "percent_of_projects"))
def kpi_rollup_single(spark, d):
    """A5 + J3 over all KPI rows by phase, process and project: every group has one project, so all rows pass as they are."""
    m = raw_model(spark, d)
    return _rolled_by(m, m.kpis.where(F.col("process_name").isNotNull()), "projectId")


def _text_sql(col: str, default: str) -> str:
    return f"coalesce((SELECT t.{col} FROM kpi_text t WHERE t.kpi_key = {KEY}), {default})"


@reg("attach_definition",
     f"""SELECT kpi_name, coalesce(t.definition,
                '{dims.DEFAULT_DEFINITION_PREFIX}' || trim(coalesce(CAST(kpi_name AS VARCHAR), '')) || '{dims.DEFAULT_DEFINITION_SUFFIX}') AS definition
         FROM (SELECT DISTINCT kpi_name FROM kpis) k LEFT JOIN kpi_text t ON t.kpi_key = {KEY}""")
def attach_definition(spark, d):
    names = raw_model(spark, d).kpis.select("kpi_name").distinct()
    return J.attach_definition(spark, names).select("kpi_name", "definition")


def _cloud_definition_values(more: bool) -> str:
    rows = ", ".join("(" + ", ".join("'" + v.replace("'", "''") + "'" for v in r) + ")" for r in dims.cloud_definitions(more))
    return f"cdef AS (SELECT * FROM (VALUES {rows}) t(written, definition))"


@reg("attach_definition_as_written",
     f"""SELECT name, coalesce(c.definition, '{dims.NO_DEFINITION}') AS definition
         FROM (SELECT DISTINCT kpi_name AS name FROM kpis UNION SELECT lower(kpi_name) FROM kpis) k LEFT JOIN cdef c ON c.written = name""",
     ctes=_cloud_definition_values(True))
def attach_definition_as_written(spark, d):
    """J4 of the cloud variants: names as written (lower-cased ones don't count), else the fixed default."""
    names = raw_model(spark, d).kpis.select(F.col("kpi_name").alias("name"))
    both = names.union(names.select(F.lower("name"))).distinct()
    found = J.attach_definition(spark, both, "name", fallback="fixed", exact_case=True, more_names=True)
    return found.select("name", "definition")


@reg("attach_guidance",
     f"""SELECT kpi_name, coalesce(t.guidance, {_guidance_case(KEY)}) AS guidance
         FROM (SELECT DISTINCT kpi_name FROM kpis) k LEFT JOIN kpi_text t ON t.kpi_key = {KEY}""")
def attach_guidance(spark, d):
    names = raw_model(spark, d).kpis.select("kpi_name").distinct()
    return J.attach_guidance(spark, names).select("kpi_name", "guidance")


@reg("attach_strength",
     f"""SELECT kpi_name, coalesce(t.strength, '{dims.DEFAULT_STRENGTH}') AS strength
         FROM (SELECT DISTINCT kpi_name FROM kpis) k LEFT JOIN kpi_text t ON t.kpi_key = {KEY}""")
def attach_strength(spark, d):
    names = raw_model(spark, d).kpis.select("kpi_name").distinct()
    return J.attach_strength(spark, names).select("kpi_name", "strength")


def _process_dim_values() -> str:
    rows = ", ".join(
        f"('{ph}', '{p}', {i})" for ph, procs in PROCESSES_BY_PHASE.items() for i, p in enumerate(procs, start=1)
    )
    return f"pdim AS (SELECT * FROM (VALUES {rows}) t(phase, process_name, position))"


PROC_DEFAULT_SQL = f"""
{_process_dim_values()},
sel AS (SELECT projectId FROM sc WHERE impact_category = 'Schedule'),
pm AS (SELECT phase, process_name, avg(score) AS process_score FROM processes
       WHERE projectId IN (SELECT projectId FROM sel) AND phase IS NOT NULL AND process_name IS NOT NULL
       GROUP BY phase, process_name),
listed AS (SELECT d.phase, d.process_name, d.position,
                  CASE WHEN pm.phase IS NULL THEN 0.0 ELSE pm.process_score END AS process_score
           FROM pdim d LEFT JOIN pm ON d.phase = pm.phase AND d.process_name = pm.process_name)
"""


def _listed(spark, d):
    m = main_model(spark, d)
    _, summary = Q.selections(m, SEL)
    means = A.process_scores(FL.propagate_projects(m.processes, summary), ("phase",))
    return J.processes_with_default(spark, means, m.phases)


@reg("processes_with_default", "SELECT phase, process_name, position, process_score FROM listed",
     ctes=PROC_DEFAULT_SQL, dbl=("process_score",), ints=("position",))
def processes_with_default(spark, d):
    return _listed(spark, d)


# =============================================================================
# Aggregations
# =============================================================================

@reg("overall_score", "SELECT avg(score) AS overall_score FROM sc WHERE impact_category = 'Schedule'",
     dbl=("overall_score",))
def overall_score(spark, d):
    _, summary = Q.selections(main_model(spark, d), SEL)
    return A.overall_score(summary)


PHASES_MAIN = list(MAIN.phase_score_columns.items())


def _phase_rows_sql(src: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{p}' AS phase, avg({c}) AS phase_score, {i} AS position FROM {src}"
        for i, (p, c) in enumerate(PHASES_MAIN, start=1)
    )


@reg("phase_components", f"SELECT * FROM ({_phase_rows_sql('s')})",
     ctes=f"s AS ({_sel_sql()})", dbl=("phase_score",), ints=("position",))
def phase_components(spark, d):
    _, summary = Q.selections(main_model(spark, d), SEL)
    return A.phase_components(summary, MAIN.phase_score_columns)


def _cat_dim_sql() -> str:
    rows = ", ".join(f"('{c}', {i})" for i, c in enumerate(CATEGORY_MULTIPLIERS, start=1))
    return f"cdim AS (SELECT * FROM (VALUES {rows}) t(impact_category, position))"


CAT_SQL = f"""
{_cat_dim_sql()},
cm AS (SELECT impact_category, avg(score) AS category_score FROM sc WHERE impact_category IS NOT NULL GROUP BY 1),
cats AS (SELECT d.impact_category, d.position,
                CASE WHEN cm.impact_category IS NULL THEN 0.0 ELSE cm.category_score END AS category_score
         FROM cdim d LEFT JOIN cm USING (impact_category))
"""


def _cats(spark, d):
    m = main_model(spark, d)
    before, _ = Q.selections(m, SEL)
    cat_dim = dims.category_multiplier_dim(spark).select("impact_category", "position")
    return A.category_scores(before, APP.categories, cat_dim)


@reg("category_scores", "SELECT impact_category, position, category_score FROM cats", ctes=CAT_SQL,
     dbl=("category_score",), ints=("position",))
def category_scores(spark, d):
    return _cats(spark, d)


@reg("process_scores",
     "SELECT phase, process_name, avg(score) AS process_score FROM processes "
     "WHERE phase IS NOT NULL AND process_name IS NOT NULL GROUP BY phase, process_name",
     dbl=("process_score",))
def process_scores(spark, d):
    return A.process_scores(raw_model(spark, d).processes, ("phase",))


@reg("kpi_rollup",
     "SELECT phase, process_name, kpi_name, actual_numeric, score, unrealized_value, bp_range_display, unit FROM rolled",
     ctes=_rollup_sql(SEL_KPIS, False), dbl=("actual_numeric", "score", "unrealized_value"))
def kpi_rollup(spark, d):
    return _rolled_main(spark, d).drop("is_averaged")


@reg("kpi_coverage",
     "SELECT phase, process_name, kpi_name, percent_of_projects FROM rolled",
     ctes=_rollup_sql(SEL_KPIS, True), dbl=("percent_of_projects",))
def kpi_coverage(spark, d):
    return _rolled_main(spark, d, coverage=True).select("phase", "process_name", "kpi_name", "percent_of_projects")


@reg("project_count",
     "SELECT phase, process_name, count(DISTINCT projectId) AS n_projects FROM kpis "
     "WHERE projectId IS NOT NULL GROUP BY phase, process_name", ints=("n_projects",))
def project_count(spark, d):
    return A.project_count(raw_model(spark, d).kpis, ("phase", "process_name"))


ALL_KPIS_SQL = f"""
s AS ({_sel_sql()}),
ak AS (SELECT DISTINCT * EXCLUDE ({DATA_COLS_EXCLUDE}) FROM kpis WHERE projectId IN (SELECT projectId FROM s)),
k AS (SELECT * FROM ak WHERE impact_category = 'Schedule' AND kpi_name IS NOT NULL),
tp AS (SELECT kpi_name, avg(coalesce(score, 0) * coalesce(CAST(kpi_wt AS DOUBLE), 0)) AS score_weighted
       FROM k GROUP BY kpi_name),
tq AS (SELECT kpi_name, avg(coalesce(process_level_unrealized_value, 0)) AS priority_metric FROM k GROUP BY kpi_name),
tg AS (SELECT kpi_name, avg(phase_level_unrealized_value) AS gap FROM k GROUP BY kpi_name
       HAVING avg(phase_level_unrealized_value) IS NOT NULL)
"""


def _topn(src: str, metric: str, k: int = 5, part: str = "") -> str:
    p = f"PARTITION BY {part} " if part else ""
    return (
        f"SELECT * FROM (SELECT *, row_number() OVER ({p}ORDER BY round({metric}, 6) DESC NULLS LAST, kpi_name) AS rank "
        f"FROM {src}) WHERE rank <= {k}"
    )


def _exec_kpis(spark, d):
    m = main_model(spark, d)
    _, summary = Q.selections(m, SEL)
    return FL.filter_category(Q.all_kpis(m, summary), "Schedule")


@reg("top_performing_kpis", _topn("tp", "score_weighted"), ctes=ALL_KPIS_SQL, dbl=("score_weighted",), ints=("rank",))
def top_performing_kpis(spark, d):
    return R.top_performing_kpis(_exec_kpis(spark, d))


@reg("top_priority_kpis", _topn("tq", "priority_metric"), ctes=ALL_KPIS_SQL, dbl=("priority_metric",), ints=("rank",))
def top_priority_kpis(spark, d):
    return R.top_priority_kpis(_exec_kpis(spark, d))


@reg("top_gap_phase_level",
     f"SELECT * FROM ({_topn('tg', 'gap')}) WHERE (SELECT sum(gap) FROM ({_topn('tg', 'gap')})) <> 0",
     ctes=ALL_KPIS_SQL, dbl=("gap",), ints=("rank",))
def top_gap_phase_level(spark, d):
    return R.top_gap(_exec_kpis(spark, d), "phase_level_unrealized_value")


GAP_PHASE_SQL = f"""
pk AS (SELECT * FROM kpis WHERE impact_category = 'Schedule' AND kpi_name IS NOT NULL AND phase IS NOT NULL
         AND projectId IN (SELECT projectId FROM sc WHERE impact_category = 'Schedule')),
g AS (SELECT phase, kpi_name, avg(process_level_unrealized_value) AS gap FROM pk GROUP BY phase, kpi_name
      HAVING avg(process_level_unrealized_value) IS NOT NULL),
gt AS ({_topn('g', 'gap', part='phase')})
"""


@reg("top_gap_process_level",
     "SELECT * FROM gt WHERE phase IN (SELECT phase FROM gt GROUP BY phase HAVING sum(gap) <> 0)",
     ctes=GAP_PHASE_SQL, dbl=("gap",), ints=("rank",))
def top_gap_process_level(spark, d):
    m = main_model(spark, d)
    _, summary = Q.selections(m, SEL)
    k = FL.filter_category(FL.propagate_projects(m.kpis, summary), "Schedule")
    return R.top_gap(k, "process_level_unrealized_value", ("phase",))


@reg("project_meta", "SELECT projectId, projValue, startDate, endDate FROM meta", dbl=("projValue",))
def project_meta(spark, d):
    return Q.project_meta_of(raw_model(spark, d))


@reg("scoreboard",
     "SELECT Segment, cr_score, est_project_value, est_start_date, est_end_date FROM board",
     ctes=BOARD_SQL.format(seg="region", src="sc"), dbl=BOARD_DBL)
def scoreboard_q(spark, d):
    m = main_model(spark, d)
    return scoreboard(m.scorecard, Q.project_meta_of(m), "Region")


FACETS = {"project": "projectId", "region": "region", "manager": "projectManager", "category": "impact_category",
          "office": "office_name", "program_manager": "program_manager", "stage": "project_stage"}


@reg("facet_values",
     " UNION ".join(f"SELECT '{n}' AS facet, CAST({c} AS VARCHAR) AS value FROM sc WHERE {c} IS NOT NULL" for n, c in FACETS.items()))
def facet_values(spark, d):
    return A.facet_table(main_model(spark, d).scorecard, FACETS)


@reg("facet_people",
     f"SELECT DISTINCT unnest({S.people('project_managers')}) AS person FROM (SELECT DISTINCT project_managers FROM sc WHERE project_managers IS NOT NULL)")
def facet_people(spark, d):
    m = main_model(spark, d)
    return A.facet_people(m.scorecard, people=m.people)


@reg("facet_date_bounds", "SELECT min(startDate) AS date_min, max(startDate) AS date_max FROM meta")
def facet_date_bounds(spark, d):
    return A.facet_date_bounds(Q.project_meta_of(raw_model(spark, d)))


# =============================================================================
# Windows, sorting, paging, set operations
# =============================================================================

@reg("priority_rank",
     "SELECT phase, process_name, kpi_name, unrealized_value, row_number() OVER (PARTITION BY phase, process_name "
     "ORDER BY round(unrealized_value, 6) DESC NULLS LAST, kpi_name) AS priority FROM rolled",
     ctes=_rollup_sql(SEL_KPIS, False), dbl=("unrealized_value",), ints=("priority",))
def priority_rank(spark, d):
    return R.priority_rank(_rolled_main(spark, d), ("phase", "process_name")).select(
        "phase", "process_name", "kpi_name", "unrealized_value", "priority"
    )


LABEL_SQL = """
lab AS (SELECT phase, process_name, kpi_name, coalesce(unrealized_value, 0.0) AS unrealized_value,
               row_number() OVER (PARTITION BY phase, process_name ORDER BY round(coalesce(unrealized_value, 0.0), 6) DESC, kpi_name) AS position,
               count(*) OVER (PARTITION BY phase, process_name) AS n
        FROM rolled)
"""
LABEL_CASE = """CASE WHEN position <= (CASE WHEN n >= 5 THEN 2 ELSE 1 END) THEN 'High'
                     WHEN position > n - (CASE WHEN n >= 5 THEN 2 WHEN n >= 2 THEN 1 ELSE 0 END) THEN 'Low'
                     ELSE 'Average' END"""


@reg("priority_label",
     f"SELECT phase, process_name, kpi_name, unrealized_value, position, {LABEL_CASE} AS impact_label FROM lab",
     ctes=_rollup_sql(SEL_KPIS, False) + "," + LABEL_SQL, dbl=("unrealized_value",), ints=("position",))
def priority_label(spark, d):
    return R.priority_label(_rolled_main(spark, d), ("phase", "process_name")).select(
        "phase", "process_name", "kpi_name", "unrealized_value", "position", "impact_label"
    )


@reg("display_rank", _topn("tq", "priority_metric", 3), ctes=ALL_KPIS_SQL, dbl=("priority_metric",), ints=("rank",))
def display_rank(spark, d):
    return R.top_priority_kpis(_exec_kpis(spark, d), k=3)


@reg("scoreboard_sort",
     "SELECT Segment, est_project_value, row_number() OVER (ORDER BY est_project_value ASC NULLS LAST, Segment) AS pos FROM board",
     ctes=BOARD_SQL.format(seg="projectManager", src="sc"), dbl=("est_project_value",), ints=("pos",))
def scoreboard_sort(spark, d):
    m = main_model(spark, d)
    board = scoreboard(m.scorecard, Q.project_meta_of(m), "Project Manager")
    numbered, _ = R.with_positions(board, R.sort_order(R.scoreboard_keys("est_project_value", True)))
    return numbered.select("Segment", "est_project_value", "pos")


def _positions(ordered: DataFrame, group_cols: tuple[str, ...]) -> DataFrame:
    """``pos``: the place of each row of an ordered frame in its group, as it comes (one page's table a group)."""
    from pyspark.sql import Window

    numbered = ordered.withColumn("_at", F.monotonically_increasing_id())
    return numbered.withColumn("pos", F.row_number().over(Window.partitionBy(*group_cols).orderBy("_at"))).drop("_at")


@reg("kpi_sort",
     "SELECT phase, process_name, kpi_name, unrealized_value, row_number() OVER (PARTITION BY phase, process_name "
     "ORDER BY unrealized_value DESC NULLS LAST, kpi_name) AS pos FROM rolled",
     ctes=_rollup_sql(SEL_KPIS, False), dbl=("unrealized_value",), ints=("pos",))
def kpi_sort(spark, d):
    # O2: every process's KPI table in sorted order (position per table).
    groups = ("phase", "process_name")
    return _positions(R.sort_kpis(_rolled_main(spark, d), groups), groups).select(*groups, "kpi_name", "unrealized_value", "pos")


@reg("page",
     "SELECT Segment, cr_score FROM board ORDER BY Segment LIMIT 50 OFFSET 100",
     ctes=BOARD_SQL.format(seg="projectId", src="sc"), dbl=("cr_score",))
def page_q(spark, d):
    m = main_model(spark, d)
    board = scoreboard(m.scorecard, Q.project_meta_of(m), "Project")
    ordered = R.sort_scoreboard(board, "Segment", True)
    return R.page(ordered, 2).select("Segment", "cr_score")


@reg("page_deep",
     "SELECT Segment, cr_score FROM board ORDER BY Segment LIMIT 50 OFFSET (SELECT (count(*) - 1) // 50 * 50 FROM board)",
     ctes=BOARD_SQL.format(seg="projectId", src="sc"), dbl=("cr_score",))
def page_deep(spark, d):
    """L1 far behind the last page: clamped to it, by positions."""
    m = main_model(spark, d)
    board = scoreboard(m.scorecard, Q.project_meta_of(m), "Project")
    return R.page_at(board, R.scoreboard_keys("Segment", True), 10**6).select("Segment", "cr_score")


@reg("page_after",
     "SELECT Segment, cr_score FROM board ORDER BY round(cr_score, 6) DESC NULLS LAST, Segment LIMIT 50 OFFSET 50",
     ctes=BOARD_SQL.format(seg="projectId", src="sc"), dbl=("cr_score",))
def page_after(spark, d):
    """L1 by key: the second page, behind the last row of the first."""
    m = main_model(spark, d)
    board = scoreboard(m.scorecard, Q.project_meta_of(m), "Project")
    keys = R.scoreboard_keys("CR-Score", False)
    rows = R.page_after(board, keys).collect()  # a page
    return R.page_after(board, keys, tuple(rows[-1].token)).select("Segment", "cr_score")


ITEM_TOP_SQL = (
    "SELECT event_id, risk_value, row_number() OVER (ORDER BY {m} DESC, event_id) AS rank "
    "FROM action_items WHERE {m} IS NOT NULL AND NOT isnan({m}) ORDER BY {m} DESC, event_id LIMIT 5"
)


@reg("top_items_by_weight", ITEM_TOP_SQL.format(m="weight").replace("risk_value,", "weight,"),
     dbl=("weight",), ints=("event_id", "rank"))
def top_items_by_weight(spark, d):
    return IT.top_items_by_weight(raw_model(spark, d).action_items).select("event_id", "weight", "rank")


ITEM_TITLE_SQL = S.title("replace(item_type, '_', ' ')")
ITEMS_SHAPED_SQL = f"""
it AS (SELECT *, {_map_case('item_type', ITEM_PHASE_MAP_CLOUD, 'construction')} AS phase,
              {ITEM_DISPLAY_SQL} AS item_display FROM action_items
       WHERE risk_value IS NOT NULL AND NOT isnan(risk_value))
"""


@reg("top_items_by_risk",
     f"SELECT rank, projectId, {ITEM_TITLE_SQL} AS item_type_display, item_display, required_action, event_id "
     "FROM (SELECT *, row_number() OVER (ORDER BY risk_value DESC, event_id) AS rank FROM it) WHERE rank <= 5",
     ctes=ITEMS_SHAPED_SQL, ints=("rank", "event_id"))
def top_items_by_risk(spark, d):
    it = IT.prepare_items(spark, raw_model(spark, d).action_items, ITEM_PHASE_MAP_CLOUD)
    return IT.top_items_by_risk(it).select("rank", "projectId", "item_type_display", "item_display", "required_action", "event_id")


@reg("top_items_by_risk_per_phase",
     f"SELECT phase, rank, projectId, {ITEM_TITLE_SQL} AS item_type_display, item_display, event_id "
     "FROM (SELECT *, row_number() OVER (PARTITION BY phase ORDER BY risk_value DESC, event_id) AS rank FROM it) WHERE rank <= 5",
     ctes=ITEMS_SHAPED_SQL, ints=("rank", "event_id"))
def top_items_by_risk_per_phase(spark, d):
    it = IT.prepare_items(spark, raw_model(spark, d).action_items, ITEM_PHASE_MAP_CLOUD)
    return IT.top_items_by_risk_per_phase(it).select("phase", "rank", "projectId", "item_type_display", "item_display", "event_id")


@reg("all_phase_kpis",
     f"SELECT phase, count(*) AS n_rows FROM (SELECT DISTINCT * EXCLUDE ({DATA_COLS_EXCLUDE}) FROM kpis) GROUP BY phase",
     ints=("n_rows",))
def all_phase_kpis(spark, d):
    m = raw_model(spark, d)
    by_phase = {p: m.phase_kpis(p).select(*m.data_columns(m.kpis)) for p in m.phases}
    u = R.all_phase_kpis(by_phase, m.phases, m.repeated)
    return u.groupBy("phase").agg(F.count(F.lit(1)).alias("n_rows"))


# =============================================================================
# Scalar functions
# =============================================================================

@reg("impact_estimates",
     "SELECT " + ", ".join(f"{v} AS {k}" for k, v in S.impact_estimates("avg(score)").items())
     + " FROM sc WHERE impact_category = 'Schedule'", dbl=("cost", "schedule", "incidents"))
def impact_estimates(spark, d):
    o = A.overall_score(Q.selections(main_model(spark, d), SEL)[1])
    return o.select(*[v.alias(k) for k, v in scoring.impact_estimates("overall_score").items()])


@reg("category_impact",
     "SELECT c.impact_category, c.category_score * m.multiplier AS category_impact FROM cats c JOIN cmult m USING (impact_category)",
     ctes=CAT_SQL + ",\ncmult AS (SELECT * FROM (VALUES "
     + ", ".join(f"('{c}', {v})" for c, v in CATEGORY_MULTIPLIERS.items())
     + ") t(impact_category, multiplier))", dbl=("category_impact",))
def category_impact(spark, d):
    return J.category_impact(spark, _cats(spark, d)).select("impact_category", "category_impact")


PMULT_SQL = "pmult AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{p}', '{c}', {v})" for p, cm in PHASE_CATEGORY_MULTIPLIERS.items() for c, v in cm.items()
) + ") t(phase, impact_category, multiplier))"


@reg("phase_impact",
     "SELECT p.phase, m.impact_category, p.phase_score * m.multiplier AS phase_impact FROM ph p JOIN pmult m USING (phase)",
     ctes=f"s AS ({_sel_sql()}),\nph AS ({_phase_rows_sql('s')}),\n{PMULT_SQL}", dbl=("phase_impact",))
def phase_impact(spark, d):
    _, summary = Q.selections(main_model(spark, d), SEL)
    ph = A.phase_components(summary, MAIN.phase_score_columns)
    return J.phase_impact(spark, ph).select("phase", "impact_category", "phase_impact")


CLOUD_PHASES = list(POWER.phase_score_columns.items())


def _pow(x: str) -> str:
    return f"CASE WHEN {x} >= 0 THEN pow({x}, {IMPROVEMENT_EXPONENT}) END"


def _improvement_sql(phase: str, x: str, model: str) -> str:
    if model == "power" or (model == "mixed" and phase == "construction"):
        return f"({POWER_COEFFICIENTS[phase]} * {_pow(x)} * 100)"
    if model == "mixed":
        return f"({x} * {LINEAR_FACTORS[phase]})"
    if phase == "construction":
        v = f"({POWER_COEFFICIENTS['construction']} * {_pow(f'({x} * 100)')})"
    else:
        v = f"({x} * {LINEAR_FACTORS.get(phase, 0.03)})"
    return f"CASE WHEN {x} IS NULL THEN 0.0 ELSE {v} END"


def _improvement_rows_sql(model: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{p}' AS phase, {i} AS position, s AS phase_score, {_improvement_sql(p, 's', model)} AS improvement "
        f"FROM (SELECT avg({c}) AS s FROM cs)"
        for i, (p, c) in enumerate(CLOUD_PHASES, start=1)
    )


def _improvement_q(spark, d, model: str):
    m = cloud_model(spark, d, MIXED if model == "mixed" else POWER)
    _, summary = Q.selections(m, CLOUD_SEL)
    return Q.phase_improvements(summary, POWER.phase_score_columns, model)


CS_POWER = "cs AS (SELECT * FROM scorecard_c WHERE impact_category = 'cost')"
SC_C_POWER = """scorecard_c AS (
  SELECT * EXCLUDE (impact_category, phaseScore_bidding, phaseScore_precon),
         lower(impact_category) AS impact_category,
         phaseScore_bidding AS phaseScore_estimating, phaseScore_precon AS phaseScore_preconstruction
  FROM scorecard WHERE lower(impact_category) IN ('cost'))"""


@reg("phase_improvement", f"SELECT * FROM ({_improvement_rows_sql('power')})",
     ctes=SC_C_POWER + ",\n" + CS_POWER, dbl=("phase_score", "improvement"), ints=("position",))
def phase_improvement(spark, d):
    return _improvement_q(spark, d, "power")


@reg("phase_improvement_helper", f"SELECT * FROM ({_improvement_rows_sql('helper')})",
     ctes=SC_C_POWER + ",\n" + CS_POWER, dbl=("phase_score", "improvement"), ints=("position",))
def phase_improvement_helper(spark, d):
    return _improvement_q(spark, d, "helper")


@reg("total_improvement",
     "SELECT CASE WHEN (SELECT count(*) FROM csc WHERE impact_category = 'cost') = 0 THEN 0.0 ELSE sum(improvement) END AS total "
     f"FROM ({_improvement_rows_sql('mixed')})",
     ctes="cs AS (SELECT * FROM csc WHERE impact_category = 'cost')", dbl=("total",))
def total_improvement(spark, d):
    m = cloud_model(spark, d, MIXED)
    card = Q.cost_improvement_card(spark, m, MIXED, CLOUD_SEL)
    return card.where(F.col("section") == "total").select(F.col("value").alias("total"))


@reg("grade",
     f"SELECT phase, process_name, process_score, {S.grade('process_score')} AS grade FROM listed",
     ctes=PROC_DEFAULT_SQL, dbl=("process_score",))
def grade_q(spark, d):
    return _listed(spark, d).select("phase", "process_name", "process_score", scoring.grade("process_score").alias("grade"))


@reg("ratio_band",
     """SELECT score, possible, CASE WHEN r < 0.2 THEN 1 WHEN r < 0.4 THEN 2 WHEN r < 0.6 THEN 3 WHEN r < 0.8 THEN 4 ELSE 5 END AS band
        FROM (SELECT score, possible, CASE WHEN possible IS NULL OR possible = 0 THEN 0.0 ELSE score / possible END AS r
              FROM (SELECT DISTINCT score, CASE WHEN kpi_wt = 1 THEN 0.0 WHEN kpi_wt > 1 THEN 100.0 END AS possible FROM kpis))""",
     dbl=("score", "possible"), ints=("band",))
def ratio_band(spark, d):
    """X7 of every score there is, against 100, against 0 and against a missing value."""
    k = raw_model(spark, d).kpis
    possible = F.when(F.col("kpi_wt") == 1, F.lit(0.0)).when(F.col("kpi_wt") > 1, F.lit(100.0))
    pairs = k.select("score", possible.alias("possible")).distinct()
    return pairs.select("score", "possible", scoring.ratio_band("score", "possible").alias("band"))


@reg("bar_score",
     "SELECT phase, process_name, coalesce(CASE WHEN NOT isnan(process_score) THEN CAST(trunc(process_score) AS BIGINT) END, 0) AS bar, "
     "greatest(0.0, least(coalesce(process_score, 0.0), 100.0)) AS meter FROM listed",
     ctes=PROC_DEFAULT_SQL, dbl=("meter",), ints=("bar",))
def bar_score(spark, d):
    return _listed(spark, d).select(
        "phase", "process_name", scoring.bar_score("process_score").alias("bar"), scoring.meter_score("process_score").alias("meter")
    )


@reg("format_actual",
     """SELECT phase, process_name, kpi_name,
               CASE WHEN actual_numeric IS NULL OR isnan(actual_numeric) THEN (CASE WHEN coalesce(unit = '%', false) THEN 'nan%' ELSE 'nan' END)
                    WHEN coalesce(unit = '%', false) THEN printf('%.0f', actual_numeric * 100) || '%'
                    ELSE printf('%.1f', actual_numeric) END AS actual_display
        FROM rolled""", ctes=_rollup_sql(SEL_KPIS, False))
def format_actual(spark, d):
    r = _rolled_main(spark, d)
    return r.select("phase", "process_name", "kpi_name", display.format_actual("actual_numeric", "unit").alias("actual_display"))


@reg("format_money", f"SELECT Segment, {S.money('est_project_value')} AS value_display FROM board",
     ctes=BOARD_SQL.format(seg="region", src="sc"))
def format_money(spark, d):
    m = main_model(spark, d)
    b = scoreboard(m.scorecard, Q.project_meta_of(m), "Region")
    return b.select("Segment", display.format_money("est_project_value").alias("value_display"))


@reg("format_date",
     f"SELECT projectId, {S.mdy('startDate')} AS start_display, {S.mdy('endDate')} AS end_display FROM meta")
def format_date(spark, d):
    mt = Q.project_meta_of(raw_model(spark, d))
    return mt.select("projectId", display.format_date("startDate").alias("start_display"),
                     display.format_date("endDate").alias("end_display"))


@reg("title_item_type",
     f"SELECT DISTINCT item_type, {ITEM_TITLE_SQL} AS item_type_display FROM action_items")
def title_item_type(spark, d):
    it = raw_model(spark, d).action_items
    return it.select("item_type", display.title_item_type("item_type").alias("item_type_display")).distinct()


@reg("process_display_name",
     f"SELECT DISTINCT phase, process_name, {S.process_display('process_name', PROCESS_DISPLAY_OVERRIDES)} AS display_name "
     "FROM processes WHERE process_name IS NOT NULL")
def process_display_name(spark, d):
    p = raw_model(spark, d).processes.where(F.col("process_name").isNotNull())
    return p.select("phase", "process_name", display.process_display_name("process_name").alias("display_name")).distinct()


@reg("kpi_display_name",
     "SELECT DISTINCT kpi_name, upper(coalesce(nullif(kpi_name, ''), 'N/A')) AS kpi_display FROM kpis")
def kpi_display_name(spark, d):
    k = raw_model(spark, d).kpis
    return k.select("kpi_name", display.kpi_display_name("kpi_name").alias("kpi_display")).distinct()


# =============================================================================
# Composite queries (Q1-Q8)
# =============================================================================

CARD_DBL, CARD_INTS = ("value",), ("rank",)


def _strength_sql(src: str) -> str:
    return (f"SELECT x.*, coalesce(t.strength, '{dims.DEFAULT_STRENGTH}') AS txt FROM ({src}) x "
            f"LEFT JOIN kpi_text t ON t.kpi_key = {KEY}")


def _guidance_sql(src: str) -> str:
    return (f"SELECT x.*, coalesce(t.guidance, {_guidance_case(KEY)}) AS txt FROM ({src}) x "
            f"LEFT JOIN kpi_text t ON t.kpi_key = {KEY}")


def _impact_rows_sql(src: str) -> str:
    return " UNION ALL ".join(
        f"SELECT 'impact', '{k}', {i}, {v}, NULL FROM {src}"
        for i, (k, v) in enumerate(S.impact_estimates("avg(score)").items(), start=1)
    )


@reg("executive_summary",
     f"""SELECT 'overall' AS section, 'cr_score' AS name, CAST(NULL AS BIGINT) AS rank, avg(score) AS value,
                CAST(NULL AS VARCHAR) AS detail FROM s
         UNION ALL {_impact_rows_sql('s')}
         UNION ALL SELECT 'phase', phase, position, phase_score, NULL FROM ({_phase_rows_sql('s')})
         UNION ALL SELECT 'top_performing', kpi_name, rank, score_weighted, txt FROM ({_strength_sql(_topn('tp', 'score_weighted'))})
         UNION ALL SELECT 'top_priority', kpi_name, rank, priority_metric, txt FROM ({_guidance_sql(_topn('tq', 'priority_metric'))})""",
     ctes=ALL_KPIS_SQL, dbl=CARD_DBL, ints=CARD_INTS)
def executive_summary(spark, d):
    """Q1 executive summary card (main variant, category Schedule)."""
    return Q.executive_summary(spark, main_model(spark, d), MAIN, SEL)


@reg("portfolio_scoreboard",
     f"""SELECT Segment, cr_score, est_project_value, est_start_date, est_end_date,
                {S.money('est_project_value')} AS value_display, {S.mdy('est_start_date')} AS start_display,
                {S.mdy('est_end_date')} AS end_display
         FROM board ORDER BY round(cr_score, 6) DESC NULLS LAST, Segment LIMIT 50""",
     ctes=BOARD_SQL.format(seg="projectId", src="sc"), dbl=BOARD_DBL)
def portfolio_scoreboard(spark, d):
    """Q2 portfolio scoreboard, by project, default sort, first page."""
    return Q.portfolio_scoreboard(spark, main_model(spark, d), MAIN, SEL)


PHASE_PAGE_SQL = PROC_DEFAULT_SQL + f""",
s AS ({_sel_sql()}),
pk AS (SELECT * FROM kpis WHERE projectId IN (SELECT projectId FROM s) AND kpi_name IS NOT NULL AND phase IS NOT NULL),
ptp AS (SELECT phase, kpi_name, avg(coalesce(score, 0) * coalesce(CAST(kpi_wt AS DOUBLE), 0)) AS m FROM pk GROUP BY phase, kpi_name),
ptq AS (SELECT phase, kpi_name, avg(coalesce(process_level_unrealized_value, 0)) AS m FROM pk GROUP BY phase, kpi_name)
"""
BAR_SQL = "coalesce(CASE WHEN NOT isnan(process_score) THEN CAST(trunc(process_score) AS BIGINT) END, 0)"


@reg("phase_summary",
     f"""SELECT 'phase_score' AS section, phase AS name, CAST(position AS BIGINT) AS rank, phase_score AS value,
                CAST(NULL AS VARCHAR) AS detail FROM ({_phase_rows_sql('s')})
         UNION ALL SELECT 'process', phase || '|' || process_name, position, process_score,
                {S.process_display('process_name', PROCESS_DISPLAY_OVERRIDES)} || '|' || CAST({BAR_SQL} AS VARCHAR) FROM listed
         UNION ALL SELECT 'top_performing', phase || '|' || kpi_name, rank, m, txt
                FROM ({_strength_sql(_topn('ptp', 'm', part='phase'))})
         UNION ALL SELECT 'top_priority', phase || '|' || kpi_name, rank, m, txt
                FROM ({_guidance_sql(_topn('ptq', 'm', part='phase'))})""",
     ctes=PHASE_PAGE_SQL, dbl=CARD_DBL, ints=CARD_INTS)
def phase_summary(spark, d):
    """Q3 phase pages, every phase in one pass."""
    return Q.phase_summary(spark, main_model(spark, d), MAIN, SEL)


@reg("process_kpi_table",
     f"""SELECT phase, process_name, position, kpi_name, upper(coalesce(nullif(kpi_name, ''), 'N/A')) AS kpi_display,
                bp_range_display, actual_numeric,
                CASE WHEN actual_numeric IS NULL OR isnan(actual_numeric) THEN (CASE WHEN coalesce(unit = '%', false) THEN 'nan%' ELSE 'nan' END)
                     WHEN coalesce(unit = '%', false) THEN printf('%.0f', actual_numeric * 100) || '%'
                     ELSE printf('%.1f', actual_numeric) END AS actual_display,
                score, CASE WHEN score IS NULL OR isnan(score) THEN 'nan' ELSE printf('%.0f', score) END AS score_display, unrealized_value, {LABEL_CASE} AS impact_label, is_averaged,
                coalesce(t.definition, '{dims.DEFAULT_DEFINITION_PREFIX}' || trim(coalesce(CAST(kpi_name AS VARCHAR), ''))
                         || '{dims.DEFAULT_DEFINITION_SUFFIX}') AS definition
         FROM lab2 LEFT JOIN kpi_text t ON t.kpi_key = {KEY}""",
     ctes=_process_dim_values() + ",\n" + _rollup_sql(SEL_KPIS_CONF, False) + """,
lab2 AS (SELECT *, coalesce(unrealized_value, 0.0) AS uv0,
                row_number() OVER (PARTITION BY phase, process_name ORDER BY round(coalesce(unrealized_value, 0.0), 6) DESC, kpi_name) AS position,
                count(*) OVER (PARTITION BY phase, process_name) AS n
         FROM rolled)""".replace("SELECT *, coalesce(unrealized_value, 0.0) AS uv0,",
                                 "SELECT * REPLACE (coalesce(unrealized_value, 0.0) AS unrealized_value),"),
     dbl=("actual_numeric", "score", "unrealized_value"), ints=("position",))
def process_kpi_table(spark, d):
    """Q4 KPI tables of every process (main variant)."""
    return Q.process_kpi_table(spark, main_model(spark, d), MAIN, SEL)


@reg("process_kpi_report_card",
     f"""SELECT phase, process_name,
                row_number() OVER (PARTITION BY phase, process_name ORDER BY round(unrealized_value, 6) DESC NULLS LAST, kpi_name) AS priority,
                kpi_name, coalesce(c.definition, '{dims.NO_DEFINITION}') AS definition, percent_of_projects,
                (CASE WHEN percent_of_projects IS NULL THEN 'nan' ELSE printf('%.0f', percent_of_projects) END) || '%' AS percent_display,
                bp_range_display, actual_numeric,
                CASE WHEN actual_numeric IS NULL OR isnan(actual_numeric) THEN (CASE WHEN coalesce(unit = '%', false) THEN 'nan%' ELSE 'nan' END)
                     WHEN coalesce(unit = '%', false) THEN printf('%.0f', actual_numeric * 100) || '%'
                     ELSE printf('%.1f', actual_numeric) END AS actual_display,
                score, {S.grade('score')} AS grade, unrealized_value, is_averaged
         FROM rolled LEFT JOIN cdef c ON c.written = kpi_name""",
     ctes=_process_dim_values() + ",\n" + _cloud_definition_values(False) + ",\n" + _rollup_sql(CSEL_KPIS_CONF, True, "100.0"),
     dbl=("percent_of_projects", "actual_numeric", "score", "unrealized_value"), ints=("priority",))
def process_kpi_report_card(spark, d):
    """Q5 KPI report card (cloud variant with coverage, rank and grade)."""
    return Q.process_kpi_report_card(spark, cloud_model(spark, d, MIXED), MIXED, CLOUD_SEL)


LEGACY_SQL = CAT_SQL + ",\ncmult AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{c}', {v})" for c, v in CATEGORY_MULTIPLIERS.items()
) + ") t(impact_category, multiplier)),\n" + PMULT_SQL + ",\n" + ALL_KPIS_SQL + ",\nph AS (" + _phase_rows_sql("s") + "),\n" + """
pk2 AS (SELECT * FROM kpis WHERE impact_category = 'Schedule' AND kpi_name IS NOT NULL AND phase IS NOT NULL
          AND projectId IN (SELECT projectId FROM s)),
g AS (SELECT phase, kpi_name, avg(process_level_unrealized_value) AS gap FROM pk2 GROUP BY phase, kpi_name
      HAVING avg(process_level_unrealized_value) IS NOT NULL),
gt AS (""" + _topn("g", "gap", part="phase") + "),\ngta AS (" + _topn("tg", "gap") + ")"


@reg("legacy_category_card",
     """SELECT 'category' AS section, impact_category AS name, CAST(position AS BIGINT) AS rank, category_score AS value,
               CAST(NULL AS VARCHAR) AS detail FROM cats
        UNION ALL SELECT 'category_impact', c.impact_category, c.position, c.category_score * m.multiplier, NULL
               FROM cats c JOIN cmult m USING (impact_category)
        UNION ALL SELECT 'phase_impact', p.phase || '|' || m.impact_category, p.position, p.phase_score * m.multiplier, NULL
               FROM ph p JOIN pmult m USING (phase)
        UNION ALL SELECT 'gap_phase_level', kpi_name, rank, gap, NULL FROM gta WHERE (SELECT sum(gap) FROM gta) <> 0
        UNION ALL SELECT 'gap_process_level', phase || '|' || kpi_name, rank, gap, NULL FROM gt
               WHERE phase IN (SELECT phase FROM gt GROUP BY phase HAVING sum(gap) <> 0)""",
     ctes=LEGACY_SQL, dbl=CARD_DBL, ints=CARD_INTS)
def legacy_category_card(spark, d):
    """Q6 legacy category / phase impact card (``app`` variant)."""
    return Q.legacy_category_card(spark, main_model(spark, d), APP, SEL)


@reg("cost_improvement_card",
     f"""SELECT 'phase_score' AS section, phase AS name, CAST(position AS BIGINT) AS rank, phase_score AS value,
                CAST(NULL AS VARCHAR) AS detail FROM imp
         UNION ALL SELECT 'improvement', phase, position, improvement, NULL FROM imp
         UNION ALL SELECT 'total', 'total', NULL,
                CASE WHEN (SELECT count(*) FROM cs) = 0 THEN 0.0 ELSE (SELECT sum(improvement) FROM imp) END, NULL""",
     ctes=f"cs AS (SELECT * FROM csc WHERE impact_category = 'cost'),\nimp AS ({_improvement_rows_sql('mixed')})",
     dbl=CARD_DBL, ints=CARD_INTS)
def cost_improvement_card(spark, d):
    """Q7 cost improvement card (cloud variant, mixed model)."""
    return Q.cost_improvement_card(spark, cloud_model(spark, d, MIXED), MIXED, CLOUD_SEL)


ITEM_SEL = Selection(category="cost", stage=STAGE, name_flag="exclude")


@reg("action_item_list",
     f"""SELECT 'all' AS scope, rank, projectId, {ITEM_TITLE_SQL} AS item_type_display, item_display, required_action,
                risk_value, event_id
         FROM (SELECT *, row_number() OVER (ORDER BY risk_value DESC, event_id) AS rank FROM chosen) WHERE rank <= 5
         UNION ALL
         SELECT phase, rank, projectId, {ITEM_TITLE_SQL}, item_display, required_action, risk_value, event_id
         FROM (SELECT *, row_number() OVER (PARTITION BY phase ORDER BY risk_value DESC, event_id) AS rank FROM chosen)
         WHERE rank <= 5""",
     ctes=ITEMS_SHAPED_SQL.rstrip() + f",\nchosen AS (SELECT * FROM it WHERE project_stage = '{STAGE}' AND name_flag = 0)",
     dbl=("risk_value",), ints=("rank", "event_id"))
def action_item_list(spark, d):
    """Q8 top action items of a stage without flagged projects, overall and per phase (cloud variant)."""
    return Q.action_item_list(spark, cloud_model(spark, d, MIXED), MIXED, ITEM_SEL)


@reg("action_item_list_main",
     f"""SELECT 'all' AS scope, rank, projectId, {ITEM_TITLE_SQL} AS item_type_display, item_display, required_action, weight, event_id
         FROM (SELECT *, row_number() OVER (ORDER BY weight DESC, event_id) AS rank FROM it
               WHERE region = '{REGION}' AND impact_category = 'Schedule' AND weight IS NOT NULL) WHERE rank <= 5""",
     ctes=ITEMS_SHAPED_SQL, dbl=("weight",), ints=("rank", "event_id"))
def action_item_list_main(spark, d):
    """Q8 of the main variant: equality filters, largest weights."""
    return Q.action_item_list(spark, main_model(spark, d), MAIN, Selection(region=REGION, category="Schedule"))


# =============================================================================
# Dimensions against the data
# =============================================================================

@reg("dim_tables",
     """SELECT d.phase, d.process_name, d.position, count(p.projectId) AS n_score_rows
        FROM pdim d LEFT JOIN processes p ON p.phase = d.phase AND p.process_name = d.process_name
        GROUP BY d.phase, d.process_name, d.position""",
     ctes=_process_dim_values(), ints=("position", "n_score_rows"))
def dim_tables(spark, d):
    """The configured process dimension and how many score rows each
    process has in the data (0 for processes the data lacks)."""
    counts = raw_model(spark, d).processes.groupBy("phase", "process_name").agg(F.count(F.lit(1)).alias("n"))
    dim = dims.process_dim(spark)
    return dim.join(counts, ["phase", "process_name"], "left").select(
        "phase", "process_name", "position", F.coalesce(F.col("n"), F.lit(0)).alias("n_score_rows")
    )


@reg("dim_kpi_text",
     f"""SELECT k.kpi_name, t.kpi_key IS NOT NULL AS has_text
         FROM (SELECT DISTINCT kpi_name FROM kpis) k LEFT JOIN kpi_text t ON t.kpi_key = {KEY}""")
def dim_kpi_text(spark, d):
    """Every KPI name of the data and whether the text dimension has it."""
    names = raw_model(spark, d).kpis.select("kpi_name").distinct()
    texts = dims.kpi_text_dim(spark).select("kpi_key")
    j = names.join(F.broadcast(texts), dims.kpi_key("kpi_name") == F.col("kpi_key"), "left")
    return j.select("kpi_name", F.col("kpi_key").isNotNull().alias("has_text"))


@reg("suppress_zero_gap",
     """SELECT * FROM gz WHERE (projectId, phase) IN (SELECT projectId, phase FROM gz GROUP BY projectId, phase HAVING sum(gap) <> 0)""",
     ctes="""gp AS (SELECT projectId, phase, kpi_name, avg(process_level_unrealized_value) AS gap FROM kpis
       WHERE kpi_name IS NOT NULL AND projectId IS NOT NULL AND phase IS NOT NULL GROUP BY projectId, phase, kpi_name
       HAVING avg(process_level_unrealized_value) IS NOT NULL),
gz AS (""" + _topn("gp", "gap", part="projectId, phase") + ")",
     dbl=("gap",), ints=("rank",))
def suppress_zero_gap(spark, d):
    """The process-level gap list of every (project, phase) at once -- the
    A11 answer for each single-project selection -- with lists whose top-5
    values sum to 0 suppressed."""
    k = raw_model(spark, d).kpis.where(F.col("projectId").isNotNull())
    return R.top_gap(k, "process_level_unrealized_value", ("projectId", "phase"))


# =============================================================================
# Schema-level ingest rules on frames derived from the test tables
# =============================================================================

@reg("canonical_names",
     "SELECT projectId, phase, count(*) AS n_rows FROM processes GROUP BY projectId, phase",
     ints=("n_rows",))
def canonical_names(spark, d):
    """Process scores whose key column is spelled ``project_id`` (as some
    dashboard files spell it) are read back under ``projectId``."""
    p = raw_model(spark, d).processes.withColumnRenamed("projectId", "project_id")
    return C.canonical_names(p).groupBy("projectId", "phase").agg(F.count(F.lit(1)).alias("n_rows"))


@reg("drop_dup_columns",
     """SELECT k.kpi_name, k.impact_category, count(*) AS n_rows, avg(k.score) AS mean_score
        FROM kpis k JOIN scorecard s ON k.projectId = s.projectId AND k.impact_category = s.impact_category
        GROUP BY k.kpi_name, k.impact_category""", dbl=("mean_score",), ints=("n_rows",))
def drop_dup_columns(spark, d):
    """A frame with repeated column names (KPI rows joined with their
    scorecard row, both carrying ``projectId``, ``impact_category`` and
    ``score``) keeps the first column of each name."""
    m = raw_model(spark, d)
    k = m.kpis.select("projectId", "impact_category", "kpi_name", "score")
    s = m.scorecard.select("projectId", "impact_category", "score")
    joined = k.join(s, (k.projectId == s.projectId) & (k.impact_category == s.impact_category))
    deduped = C.drop_dup_columns(joined)
    return deduped.groupBy("kpi_name", "impact_category").agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg("score").alias("mean_score")
    )


@reg("pick_column",
     """SELECT kpi_name, avg(CAST(kpi_wt AS DOUBLE)) AS weight, avg(process_level_unrealized_value) AS metric
        FROM kpis WHERE kpi_name IS NOT NULL GROUP BY kpi_name""", dbl=("weight", "metric"))
def pick_column(spark, d):
    """C14: the first present candidate column is used: the weight column of
    A8 and the priority metric of A9, averaged per KPI."""
    k = raw_model(spark, d).kpis.where(F.col("kpi_name").isNotNull())
    from trestle.config import PRIORITY_METRIC_CANDIDATES, WEIGHT_COLUMN_CANDIDATES

    w = C.pick_column(k, WEIGHT_COLUMN_CANDIDATES)
    mcol = C.pick_column(k, PRIORITY_METRIC_CANDIDATES)
    return k.groupBy("kpi_name").agg(
        F.avg(F.col(w).cast("double")).alias("weight"), F.avg(F.col(mcol)).alias("metric")
    )
