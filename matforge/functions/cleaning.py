"""Scalar cleaning and feature expressions.

All functions return ``Column`` expressions built from ``pyspark.sql.functions``
so they stay in whole-stage codegen; ``try_*`` variants keep ANSI mode from
failing a job on one dirty row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matforge.config import DATE_FORMATS

__all__ = [
    "col_or_null", "is_numeric_type", "numeric_text", "clean_currency", "safe_to_numeric", "to_numeric",
    "plan_qty", "link_qty", "canonical_item_key", "master_item_int", "parse_date", "calendar_features",
    "day_diff", "safe_ratio", "clean_text", "short_label", "timeline_task_name", "blank_to_null",
    "zero_to_null", "empty_to_null", "round_half_even", "first_truthy",
]

# A number as Python's float() accepts it (ASCII digits only, documented divergence).
_NUMBER_RE = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def col_or_null(df: DataFrame, name: str, dtype: T.DataType = T.StringType()) -> Column:
    """The column if present, else a typed null: absent columns are legal input."""
    if name in df.columns:
        return F.col(name)
    return F.lit(None).cast(dtype)


def is_numeric_type(df: DataFrame, name: str) -> bool:
    return name in df.columns and isinstance(df.schema[name].dataType, T.NumericType)


def blank_to_null(c: Column) -> Column:
    """'' and all-blank text become null."""
    return F.when(F.trim(c) != "", c)


def empty_to_null(c: Column) -> Column:
    """Only '' becomes null: Python treats '' (not '  ') as false in ``a or b`` chains."""
    return F.when(c.cast("string") != "", c)


def zero_to_null(c: Column) -> Column:
    return F.when(c != 0, c)


def numeric_text(c: Column) -> Column:
    """Parse text the way ``float()`` would; anything else is null."""
    t = F.trim(c.cast("string"))
    return F.when(t.rlike(_NUMBER_RE), t.try_cast("double"))


def _strip_to_number(c: Column) -> Column:
    # keep digits, dots and minus signs only, then parse; '', '.', '-', '-.', '1-2', '1.2.3' -> null.
    # Only [0-9.-] survive the strip, so the cast alone rejects every malformed number.
    return F.regexp_replace(c.cast("string"), r"[^0-9.\-]", "").try_cast("double")


def clean_currency(c: Column, numeric_input: bool = False) -> Column:
    """C1: '$ 1,234.50' -> 1234.5; numbers pass through as double."""
    if numeric_input:
        return c.cast("double")
    return _strip_to_number(c)


def safe_to_numeric(c: Column, numeric_input: bool = False) -> Column:
    """Same stripping rule for quantity-like columns."""
    return clean_currency(c, numeric_input)


def to_numeric(c: Column, numeric_input: bool = False) -> Column:
    """Strict numeric coercion; unparsable -> null."""
    if numeric_input:
        return c.cast("double")
    return numeric_text(c)


def round_half_even(c: Column) -> Column:
    """Half-to-even rounding to an integer value (2.5 -> 2, 3.5 -> 4)."""
    return F.rint(c)


def plan_qty(c: Column, min_qty: int = 1) -> Column:
    """C4: number, else number without thousands commas, else 1; then max(min, round half-even); beyond bigint: min."""
    q = F.coalesce(numeric_text(c), numeric_text(F.regexp_replace(c.cast("string"), ",", "")), F.lit(1.0))
    return F.coalesce(F.greatest(F.lit(float(min_qty)), round_half_even(q)).try_cast("bigint"), F.lit(min_qty).cast("bigint"))


def first_truthy(*cols: Column) -> Column:
    """First value that is neither null, '' nor 0 (Python ``a or b or c``)."""
    return F.coalesce(*[F.when((c.isNotNull()) & (c.cast("string") != "") & (F.coalesce(c.try_cast("double"), F.lit(1.0)) != 0), c)
                        for c in cols])


def link_qty(*candidates: Column) -> Column:
    """First truthy of the candidates, commas stripped, truncated to an integer; failure -> 1."""
    q = first_truthy(*candidates)
    num = numeric_text(F.regexp_replace(q.cast("string"), ",", ""))
    return F.coalesce(F.when(F.abs(num) < 9.2e18, num.try_cast("bigint")), F.lit(1).cast("bigint"))


def master_item_int(c: Column) -> Column:
    """C6 (integer form): strip blanks and commas; digits or an integral number -> bigint, else null."""
    s = F.regexp_replace(c.cast("string"), r"[,\s]", "")
    d = F.when(s.rlike(_NUMBER_RE), s.try_cast("double"))
    as_int = F.when(s.rlike(r"^\d+$"), s.try_cast("bigint"))
    integral = F.when((d == F.rint(d)) & (F.abs(d) < 9.2e18), d.try_cast("bigint"))
    return F.coalesce(as_int, integral)


def canonical_item_key(c: Column) -> Column:
    """C6 (key form): one string key per item on every side of a join.

    Only what a number format adds is taken off: thousands commas, '.0', and the exponent that a double's text has
    from ten million on ('258.0', ' 258 ', '12,345', '1.2E7' -> '258', '258', '12345', '12000000'). All else is kept
    trimmed, so that '007', '1E5' and '12 34' stay different from '7', '100000' and '1234'.
    """
    t = F.trim(c.cast("string"))
    formatted = t.contains(".") | t.contains(",")  # all that is taken off has one of them; a plain number meets no pattern
    bare = F.when(t.rlike(r"^[+-]?\d{1,3}(,\d{3})+(\.0*)?$"), F.regexp_replace(t, ",", "")).otherwise(t)
    bare = F.when(bare.rlike(r"^[+-]?\d+\.0*$"), F.regexp_replace(bare, r"\.0*$", "")).when(
        bare.rlike(r"^-?\d\.\d+E\d+$") & (bare.try_cast("double") == F.rint(bare.try_cast("double"))),
        F.coalesce(bare.try_cast("double").try_cast("bigint").cast("string"), bare)).otherwise(bare)
    return F.when(t != "", F.when(formatted, bare).otherwise(t))


def _shape(fmt: str) -> str:
    """Pattern of the texts that a date format can read, so that no other text is tried with it."""
    parts = {"yyyy": r"\d{4}", "yy": r"\d{2}", "SSSSSS": r"\d{6}", "SSS": r"\d{3}", "XXX": r"(Z|[+-]\d\d:\d\d)", "'T'": "T"}
    out = re.sub(r"yyyy|yy|S+|XXX|'T'|([MdHms])\1?", lambda m: parts.get(m[0], r"\d{2}" if len(m[0]) == 2 else r"\d{1,2}"), fmt)
    return f"^{out}$"


def parse_timestamp(c: Column, formats=DATE_FORMATS) -> Column:
    """Month-first or ISO date text (or a timestamp) with its time of day; bad input -> null.

    The formats are tried inside a lambda, of which Spark makes no code: written out for a few columns they make a method of all columns too large
    for the JVM to compile, and every column beside them slow.
    """
    read = lambda s: F.coalesce(*[F.when(s.rlike(_shape(f)), F.try_to_timestamp(s, F.lit(f))) for f in formats])
    return F.get(F.transform(F.array(F.trim(c.cast("string"))), read), F.lit(0))


def parse_date(c: Column, formats=DATE_FORMATS) -> Column:
    """The day of ``parse_timestamp``."""
    return F.to_date(parse_timestamp(c, formats))


def calendar_features(d: Column, prefix: str) -> dict[str, Column]:
    """Month, day of week (Monday = 0), ISO week, quarter."""
    return {
        f"{prefix}_month": F.month(d),
        f"{prefix}_dow": F.weekday(d),
        f"{prefix}_week": F.weekofyear(d),
        f"{prefix}_quarter": F.quarter(d),
    }


def day_diff(end: Column, start: Column) -> Column:
    """Whole days between two timestamps, rounded down as a time difference's days are."""
    return F.floor((F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 86_400_000_000).cast("int")


def safe_ratio(num: Column, den: Column) -> Column:
    """Num / den with a zero denominator treated as missing."""
    return F.try_divide(num, zero_to_null(den))


def clean_text(c: Column) -> Column:
    """Lower, non [a-z0-9 ] -> space, collapse blanks, trim; null -> ''."""
    s = F.lower(F.coalesce(c.cast("string"), F.lit("")))
    s = F.regexp_replace(s, r"[^a-z0-9 ]", " ")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def short_label(desc: Column, key: Column, words: int = 5) -> Column:
    """First words of the description, else 'Item <key>'."""
    d = F.coalesce(desc, F.concat(F.lit("Item "), key.cast("string")))
    parts = F.filter(F.split(F.trim(d), r"\s+"), lambda w: w != "")
    return F.array_join(F.slice(parts, 1, words), " ")


def timeline_task_name(desc: Column, key: Column, row_id: Column, prefix: str = "Procure: ", length: int = 40) -> Column:
    """Prefix + first characters of the description, else of the key, else 'row_<id>'."""
    d = empty_to_null(F.substring(desc.cast("string"), 1, length))
    k = empty_to_null(F.substring(key.cast("string"), 1, length))
    return F.concat(F.lit(prefix), F.coalesce(d, k, F.concat(F.lit("row_"), row_id.cast("string"))))
