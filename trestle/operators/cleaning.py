"""Ingest-time cleaning.

All row work is a Column expression or a join; the only plan-time decisions
are schema checks (``col in df.columns``), which cost nothing on the cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trestle.config import ITEM_PHASE_DEFAULT
from trestle.functions.parse import nan_to_null, to_number


def drop_dup_columns(df: DataFrame) -> DataFrame:
    """Keep the first of equal-named columns (case-sensitive names)."""
    seen, keep = set(), []
    for i, name in enumerate(df.columns):
        if name not in seen:
            seen.add(name)
            keep.append(i)
    if len(keep) == len(df.columns):
        return df
    # Positional selection: rename every column to a unique name first.
    tmp = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    return tmp.select(*[F.col(f"_c{i}").alias(df.columns[i]) for i in keep])


_ROW_HASH = "_row_hash"
#: So many hashes are broadcast at most (8 bytes each); where more repeat, all rows are compared.
MOST_REPEATED = 1_000_000


def repeated_hashes(df: DataFrame) -> DataFrame:
    """The 64-bit row hashes that more than one row has; numbers are all that is shuffled."""
    hashes = df.select(F.xxhash64(*df.columns).alias(_ROW_HASH))
    return hashes.groupBy(_ROW_HASH).count().where("count > 1").select(_ROW_HASH)


def distinct_rows(df: DataFrame, repeated: DataFrame | None = None) -> DataFrame:
    """Whole-row dedup (C2, U1), exact.  With ``repeated``, the ``repeated_hashes`` of ``df`` or of a frame
    that holds its rows, only rows that share a hash are shuffled and compared: equal rows have equal
    hashes, so a row whose hash is its own has no copy."""
    if repeated is None or repeated.count() > MOST_REPEATED:
        return df.dropDuplicates()
    hashed = df.withColumn(_ROW_HASH, F.xxhash64(*df.columns))
    alone, shared = [hashed.join(F.broadcast(repeated), _ROW_HASH, how).select(*df.columns) for how in ("left_anti", "left_semi")]
    return alone.unionByName(shared.dropDuplicates())


def drop_dup_rows(df: DataFrame, order_cols: tuple[str, ...] = (), repeated: DataFrame | None = None) -> DataFrame:
    """Whole-row dedup; null equals null as in pandas.

    One hash shuffle on all columns with a map-side partial dedup, so a value
    repeated millions of times is collapsed before it is shuffled.  With
    ``order_cols`` (the row-order columns, which are not data) the first copy
    in row order is the one kept, so a later ``first`` still sees it first.
    """
    if not order_cols:
        return distinct_rows(df, repeated)
    data = [c for c in df.columns if c not in order_cols]
    if len(order_cols) == 1:  # one number: a hash aggregate
        return df.groupBy(*data).agg(F.min(order_cols[0]).alias(order_cols[0])).select(*df.columns)
    first = F.min(F.struct(*[F.col(c) for c in order_cols])).alias("_first")
    return df.groupBy(*data).agg(first).select(*data, *[F.col(f"_first.{c}").alias(c) for c in order_cols]).select(
        *df.columns
    )


def canonical_names(df: DataFrame) -> DataFrame:
    """``project_id`` -> ``projectId`` when only the former exists."""
    if "project_id" in df.columns and "projectId" not in df.columns:
        return df.withColumnRenamed("project_id", "projectId")
    return df


def tag_phase(df: DataFrame, phase: str) -> DataFrame:
    """C4: constant, capitalised phase label (``'bidding'`` -> ``'Bidding'``)."""
    return df.withColumn("phase_label", F.lit(phase.capitalize()))


def phase_label(phase_col: str = "phase") -> F.Column:
    """C4 for a frame that holds every phase: Python ``str.capitalize``."""
    c = F.col(phase_col)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substr(c, F.lit(2))))


def _norm(col: str) -> F.Column:
    # Never-null lower-cased trimmed text, so a missing value compares
    # unequal instead of turning the predicate null.
    return F.coalesce(F.lower(F.trim(F.col(col).cast("string"))), F.lit("nan"))


def exclude_kpis_in_process(
    kpis: DataFrame,
    phase: str,
    process: str,
    kpi_names: tuple[str, ...],
    phase_col: str = "phase",
) -> DataFrame:
    """Drop the named KPIs, but only inside one process of one phase.

    Names compare trimmed and case-insensitive; rows of other phases or
    processes, and rows whose process or name is null, are kept.
    """
    names = [n.strip().lower() for n in kpi_names]
    in_scope = _norm("process_name") == process.strip().lower()
    if phase_col in kpis.columns:
        in_scope = in_scope & (F.col(phase_col) == phase)
    return kpis.where(~(in_scope & _norm("kpi_name").isin(*names)))


def exclude_kpis(kpis: DataFrame, kpi_names: tuple[str, ...]) -> DataFrame:
    """Drop KPIs by exact name everywhere; a null name is kept."""
    if not kpi_names:
        return kpis
    return kpis.where(F.col("kpi_name").isNull() | ~F.col("kpi_name").isin(*kpi_names))


def exclude_flagged(df: DataFrame, flag_col: str = "name_flag") -> DataFrame:
    """Keep rows whose flag is 0, when the frame has the flag column.

    A null flag fails ``== 0`` and is dropped, as in the dashboard.
    """
    if flag_col not in df.columns:
        return df
    return df.where(flag_value(df, flag_col) == 0)


def flag_value(df: DataFrame, col: str) -> F.Column:
    """A 0/1 flag as a number; text such as ``0.0`` counts, other text is null."""
    return to_number(col) if dict(df.dtypes)[col] == "string" else F.col(col)


def pick_column(df: DataFrame, candidates: tuple[str, ...]) -> str | None:
    """C14: first candidate name present in the frame (plan time)."""
    return next((c for c in candidates if c in df.columns), None)


def zero_filled(df: DataFrame, col: str, out: str) -> DataFrame:
    """Numeric value of ``col`` with missing -> 0.0, as ``out``."""
    c = F.col(col)
    dtype = dict(df.dtypes)[col]
    if dtype == "string":
        from trestle.functions.parse import zero_fill

        return df.withColumn(out, zero_fill(c))
    return df.withColumn(out, F.coalesce(nan_to_null(c.cast("double")), F.lit(0.0)))


def with_item_phase(
    spark: SparkSession,
    items: DataFrame,
    mapping: dict[str, str],
    default: str = ITEM_PHASE_DEFAULT,
) -> DataFrame:
    """Action-item type -> phase, default ``construction``.

    The mapping is configuration (a handful of entries), so it is inlined as a
    map literal rather than joined: no exchange, no broadcast, and it stays
    inside whole-stage codegen.
    """
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return items.withColumn("phase", F.coalesce(F.try_element_at(m, F.col("item_type")), F.lit(default)))

