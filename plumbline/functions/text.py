"""Text reading, conversion and masking expressions.

Every conversion yields null where the text does not convert; none can fail.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions import fixed

_ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})?)?$"
_SLASH_ISO = r"^(\d{4})/(\d{2})/(\d{2})$"
_MONTH_FIRST = r"^(\d{2})[/-](\d{2})[/-](\d{4})$"


def is_numeric_text(c: Column) -> Column:
    return c.rlike(fixed.NUMERIC_TEXT)


def is_date_text(c: Column) -> Column:
    return c.rlike(fixed.DATE_TEXT)


def converts_to_number(c: Column) -> Column:
    """Numeric text that a column conversion accepts: no NaN, no digit separators."""
    return is_numeric_text(c) & ~F.lower(c).contains("nan") & ~c.contains("_")


def to_number(c: Column) -> Column:
    """Text to double; text that is no number, and NaN, become null."""
    return F.when(converts_to_number(c), F.trim(c).try_cast("double"))


def to_integer(c: Column) -> Column:
    """Text to bigint where it is a whole number, else null."""
    return F.coalesce(F.trim(c).try_cast("bigint"), whole(to_number(c)))


def whole(number: Column) -> Column:
    """A number as bigint where it has no fraction, else null."""
    return F.when(number == F.floor(number), number.try_cast("bigint"))


def to_timestamp(c: Column) -> Column:
    """Text to timestamp by an explicit list of shapes.

    ISO dates and date-times, ``yyyy/MM/dd``, ``MM/dd/yyyy`` and ``MM-dd-yyyy``.
    """
    text = F.trim(c)
    iso = (
        F.when(F.length(text) < 10, F.lit(None))
        .when(text.rlike(_ISO), text)
        .when(text.rlike(_SLASH_ISO), F.regexp_replace(text, _SLASH_ISO, "$1-$2-$3"))
        .when(text.rlike(_MONTH_FIRST), F.regexp_replace(text, _MONTH_FIRST, "$3-$1-$2"))
    )
    return iso.try_cast("timestamp")


def mask(c: Column) -> Column:
    """First three characters and stars; only stars for short values."""
    text = c.cast("string")
    return F.when(F.length(text) > 3, F.concat(F.substring(text, 1, 3), F.lit("***"))).otherwise(
        F.lit("***")
    )


def shorten(c: Column, length: int = 100) -> Column:
    return F.substring(c.cast("string"), 1, length)


def matches_pii(c: Column, pii_type: str, pattern: str) -> Column:
    """Pattern search, after a cheap test for what every match must contain.

    The test goes with the known patterns; a caller's own pattern of the same name is searched as it is.
    """
    text = c.cast("string")
    found = text.rlike(pattern)
    known = [fixed.RISK_PII_PATTERNS.get(pii_type), fixed.GOVERNANCE_PII_PATTERNS.get(pii_type), fixed.STRICT_IP_PATTERN]
    if pattern.removeprefix("(?U)") not in known:
        return found
    literal = fixed.PII_REQUIRED_LITERAL.get(pii_type)
    digits = fixed.PII_REQUIRED_DIGITS.get(pii_type)
    if literal:
        return text.contains(literal) & found
    if digits and not pattern.startswith("(?U)"):
        return text.rlike(rf"\d{{{digits}}}") & found
    return found


def plain_number(c: Column) -> Column:
    """A double as text without an exponent below 1e16, as people write numbers."""
    text = c.cast("string")
    size = F.abs(c)
    digits = F.regexp_replace(text.try_cast("decimal(38,10)").cast("string"), "0+$", "")
    return F.when((size >= 1e7) & (size < 1e16), F.regexp_replace(digits, r"\.$", ".0")).otherwise(text)


def risk_patterns(strict_ip: bool = False, unicode_classes: bool = False) -> dict[str, str]:
    patterns = dict(fixed.RISK_PII_PATTERNS)
    if strict_ip:
        patterns["ip_address"] = fixed.STRICT_IP_PATTERN
    if unicode_classes:
        patterns = {name: "(?U)" + p for name, p in patterns.items()}
    return patterns


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def report_number(c: Column) -> Column:
    """A number as report text: NaN is null, infinities are spelled out."""
    value = c.cast("double")
    return (
        F.when(F.isnan(value), F.lit(None).cast("string"))
        .when(value == float("inf"), F.lit("Infinity"))
        .when(value == float("-inf"), F.lit("-Infinity"))
        .otherwise(value.cast("string"))
    )
