"""Presentation values (X10-X15) as Column expressions.

The dashboards format with Python's ``format``, which rounds the exact binary
value, ties to even: ``2.5`` shows as ``2``, ``0.35`` (a little less than its
text) as ``0.3``.  Whole numbers need ``bround`` only, as halves are exact.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trestle.functions.memo import plain_args_cache

from trestle.config import PROCESS_DISPLAY_OVERRIDES


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _one_decimal(v: Column) -> Column:
    """The value rounded to one decimal as Python's ``.1f`` does: by the exact binary value.

    ``k / 10`` is the tenth below, ``mid`` the double next to the midpoint of
    ``k`` and ``k + 1`` tenths.  At ``mid`` itself the exact midpoint lies on
    the side that ``(2 k + 1) - 20 mid`` tells; both differences below are
    exact, as their operands are within a factor of two.
    """
    a = F.abs(v)
    k = F.floor(a * 10).cast("double")
    k = F.when(k / 10 > a, k - 1).otherwise(k)
    odd = k * 2 + 1
    mid = odd / 20
    over = (odd - mid * 16) - mid * 4
    up = (a > mid) | ((a == mid) & ((over < 0) | ((over == 0) & (k % 2 == 1))))
    rounded = F.when(a >= 1e15, a).otherwise((k + F.when(up, 1.0).otherwise(0.0)) / 10)
    return F.when(v == 0, v).when(v < 0, -rounded).otherwise(rounded)


@plain_args_cache
def format_actual(value: Column | str, unit: Column | str) -> Column:
    """Unit ``%`` -> value x 100, no decimals, ``%``; else one decimal.

    A missing value prints as ``nan`` like the dashboard's f-string.
    """
    v, u = _c(value), _c(unit)
    pct = F.concat(F.format_string("%.0f", F.bround(v * 100, 0)), F.lit("%"))
    one = F.format_string("%.1f", _one_decimal(v))
    shown = F.when(F.coalesce(u == "%", F.lit(False)), pct).otherwise(one)
    nan_text = F.when(F.coalesce(u == "%", F.lit(False)), F.lit("nan%")).otherwise(F.lit("nan"))
    return F.when(v.isNull() | F.isnan(v), nan_text).otherwise(shown)


@plain_args_cache
def format_money(value: Column | str) -> Column:
    """X11: ``$1,234`` (no decimals) or ``N/A``."""
    v = _c(value)
    return F.when(v.isNull() | F.isnan(v), F.lit("N/A")).otherwise(
        F.concat(F.lit("$"), F.format_number(F.bround(v, 0), 0))
    )


@plain_args_cache
def format_date(value: Column | str) -> Column:
    """``MM/dd/yyyy`` or ``N/A``."""
    return F.coalesce(F.date_format(_c(value), "MM/dd/yyyy"), F.lit("N/A"))


@plain_args_cache
def title_case(text: Column | str) -> Column:
    """Python ``str.title``: upper-case a letter that follows a non-letter,
    lower-case every other letter (``'o&m manuals'`` -> ``'O&M Manuals'``)."""
    chars = F.split(_c(text), "")

    def fix(ch: Column, i: Column) -> Column:
        prev = F.try_element_at(chars, i)  # 1-based: element i is the previous char
        starts = (i == 0) | ~prev.rlike(r"^\p{L}$")
        return F.when(starts, F.upper(ch)).otherwise(F.lower(ch))

    return F.array_join(F.transform(chars, fix), "")


@plain_args_cache
def title_item_type(item_type: Column | str) -> Column:
    """``'punch_item'`` -> ``'Punch Item'``."""
    return title_case(F.regexp_replace(_c(item_type), "_", " "))


@plain_args_cache
def process_display_name(process: Column | str) -> Column:
    """Override table, else camelCase split + title case."""
    p = _c(process)
    overrides = F.create_map(*[F.lit(x) for kv in PROCESS_DISPLAY_OVERRIDES.items() for x in kv])
    split = title_case(F.regexp_replace(p, r"(\w)([A-Z])", "$1 $2"))
    return F.coalesce(F.try_element_at(overrides, p), split)


@plain_args_cache
def kpi_display_name(kpi_name: Column | str) -> Column:
    """Upper case; null or empty -> ``N/A``."""
    return F.upper(F.coalesce(F.nullif(_c(kpi_name), F.lit("")), F.lit("N/A")))


@plain_args_cache
def format_whole(value: Column | str) -> Column:
    """``f"{x:.0f}"``: no decimals, half-to-even; missing -> ``nan``."""
    v = _c(value)
    return F.when(v.isNull() | F.isnan(v), F.lit("nan")).otherwise(F.format_string("%.0f", F.bround(v, 0)))


@plain_args_cache
def format_percent(value: Column | str) -> Column:
    """``f"{x:.0f}%"`` of a value that is in percent already; missing -> ``nan%``."""
    return F.concat(format_whole(value), F.lit("%"))
