"""Lenient parsing of loosely typed text fields, as native Column expressions.

Spark runs with ANSI mode on, where a bad ``cast`` raises; the dashboards
coerce bad values to missing instead.  Every parser here is therefore
"validate with a pattern, then ``try_cast``", which also rejects strings that
Spark's own cast would accept but the dashboards would not (``'1d'``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trestle.functions.memo import plain_args_cache

# A plain decimal number with optional sign and exponent.
NUMERIC_PATTERN = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"

# Date / timestamp layouts tried in order for lenient date parsing.
DATE_FORMATS = (
    "yyyy-MM-dd",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy/MM/dd",
    "MM/dd/yyyy",
    "M/d/yyyy",
    "MM-dd-yyyy",
    "dd MMM yyyy",
    "MMM d, yyyy",
)


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


@plain_args_cache
def nan_to_null(col: Column | str) -> Column:
    """Floating NaN becomes null, so aggregates skip it like pandas does."""
    c = _c(col)
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


@plain_args_cache
def to_number(col: Column | str) -> Column:
    """String -> double, or null when the trimmed text is not a plain number."""
    s = F.trim(_c(col).cast("string"))
    return F.when(s.rlike(NUMERIC_PATTERN), s.try_cast("double"))


@plain_args_cache
def parse_value(col: Column | str) -> Column:
    """Drop every ``%``, trim, then numeric or null (``'85%'`` -> 85.0)."""
    return to_number(F.regexp_replace(_c(col).cast("string"), "%", ""))


@plain_args_cache
def parse_money(col: Column | str) -> Column:
    """Drop ``$`` and ``,``, then numeric or null (``'$1,234.50'`` -> 1234.5)."""
    return to_number(F.regexp_replace(_c(col).cast("string"), r"[$,]", ""))


@plain_args_cache
def parse_date(col: Column | str, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    """First layout that parses, else null; returns a date."""
    s = F.trim(_c(col).cast("string"))
    tries = [F.try_to_timestamp(s, F.lit(f)) for f in formats]
    return F.to_date(F.coalesce(*tries))


@plain_args_cache
def zero_fill(col: Column | str) -> Column:
    """Numeric coercion with missing -> 0.0."""
    return F.coalesce(to_number(col), F.lit(0.0))


# FIXED VALUE (C11, the dashboards' pattern): "<number> - <title>" at the
# start of the first match, up to the next " - <letter>" or the end.
ITEM_DISPLAY_PATTERN = r"(\d+\s*-\s*.+?)(?:\s*-\s*[A-Za-z]|$)"


@plain_args_cache
def item_display(risky_id: Column | str) -> Column:
    """C11: ``'12 - Roof leak - Open'`` -> ``'12 - Roof leak'``; no match -> the id."""
    rid = _c(risky_id)
    return F.coalesce(F.nullif(F.regexp_extract(rid, ITEM_DISPLAY_PATTERN, 1), F.lit("")), rid)


@plain_args_cache
def parse_people(col: Column | str) -> Column:
    """Comma list of people -> array of display names.

    ``'Last (ID) First Middle'`` -> ``'First Middle Last'`` (text with both
    parentheses); two words ``'Last First'`` -> ``'First Last'``; three or more
    words without parentheses are kept as written; single words are dropped.
    Null or empty input gives an empty array.
    """
    raw = F.coalesce(_c(col).cast("string"), F.lit(""))
    entries = F.filter(F.transform(F.split(raw, ","), lambda s: F.trim(s)), lambda s: s != "")

    def to_name(entry: Column) -> Column:
        parts = F.filter(F.split(entry, r"\s+"), lambda w: w != "")
        n = F.size(parts)
        has_parens = entry.contains("(") & entry.contains(")")
        last = F.try_element_at(parts, F.lit(1))
        first_paren = F.when(n > 2, F.array_join(F.slice(parts, F.lit(3), F.greatest(n - 2, F.lit(0))), " ")).otherwise(F.try_element_at(parts, F.lit(-1)))
        paren_name = F.trim(F.concat_ws(" ", first_paren, last))
        two_word = F.concat_ws(" ", F.try_element_at(parts, F.lit(2)), F.try_element_at(parts, F.lit(1)))
        return (
            F.when(n < 2, F.lit(None))
            .when(has_parens, paren_name)
            .when(n == 2, two_word)
            .otherwise(entry)
        )

    return F.filter(F.transform(entries, to_name), lambda x: x.isNotNull())
