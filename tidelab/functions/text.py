"""Column expressions for text cells. All are built-in Spark expressions (no Python UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The whitespace set that ECMAScript's String.prototype.trim removes
# (WhiteSpace + LineTerminator: TAB, LF, VT, FF, CR, SPACE, NBSP, OGHAM SPACE MARK,
# U+2000..U+200A, LINE SEPARATOR, PARAGRAPH SEPARATOR, NARROW NBSP, MEDIUM MATH SPACE,
# IDEOGRAPHIC SPACE, BOM). Written in a syntax both Java regex and RE2 accept.
JS_SPACE_CLASS = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
TRIM_PATTERN = rf"^{JS_SPACE_CLASS}+|{JS_SPACE_CLASS}+$"

# The inference patterns for integer-like and real-like text.
INT_PATTERN = r"^-?[0-9]+$"
REAL_PATTERN = r"^-?[0-9]+(\.[0-9]+)?$"
NUMBER_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
DATE_PATTERN = r"^[0-9]{4}[-/][0-9]{2}[-/][0-9]{2}"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def js_trim(c) -> Column:
    """Trim the same characters as JavaScript's ``trim`` (Spark's ``trim`` only strips spaces)."""
    return F.regexp_replace(_c(c), TRIM_PATTERN, "")


def is_blank(c) -> Column:
    """Null, or empty after trimming."""
    col = _c(c)
    return col.isNull() | (js_trim(col) == F.lit(""))


def safe_string(c) -> Column:
    """Null → ''. Casts first: under ANSI mode ``coalesce(int_col, '')`` fails at run time."""
    return F.coalesce(_c(c).cast("string"), F.lit(""))


def to_number(c) -> Column:
    """Numbers as double. Text counts as a number only if, trimmed, it is a plain or scientific
    decimal; anything else (``1d``, ``NaN``, ``Infinity``, words) is null, and so is a NaN or infinite
    number."""
    col = _c(c)
    text = js_trim(col.cast("string"))
    value = F.when(text.rlike(NUMBER_PATTERN), text).try_cast("double")
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def is_date_like(c) -> Column:
    """Text that starts with ``YYYY-MM-DD`` or ``YYYY/MM/DD``; real date/timestamp values always match."""
    return _c(c).cast("string").rlike(DATE_PATTERN)


def round_value(c, digits: int = 2) -> Column:
    """Round half away from zero on the binary value: ``round(x * 10^d) / 10^d``.

    Spark's ``round(x, d)`` on doubles rounds the shortest decimal rendering (so 1.005 → 1.01),
    whereas SQLite and DuckDB round the binary value (1.005 → 1.0). Scaling first and rounding to
    an integer gives the binary behaviour in both engines bit for bit.
    """
    scale = float(10 ** digits)
    return F.round(_c(c).cast("double") * F.lit(scale), 0) / F.lit(scale)
