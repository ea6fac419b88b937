"""Name keys, blank handling and flags on text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters stripped from both ends of a name.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(value: Column | str) -> Column:
    """Remove leading and trailing whitespace (``trim`` alone would remove spaces only)."""
    return F.btrim(_column(value), F.lit(WHITESPACE))


def name_key(value: Column | str) -> Column:
    """The comparison form of a team or venue name. Stored values are never changed."""
    return strip(F.upper(_column(value)))


def blank_to_null(value: Column | str) -> Column:
    return F.nullif(strip(value), F.lit(""))


def contains_ignore_case(value: Column | str, needle: str) -> Column:
    """Case-insensitive substring flag; null text is false."""
    return F.coalesce(F.lower(_column(value)).contains(needle.lower()), F.lit(False))


def neutral_flag(home: Column | str, away: Column | str, country: Column | str) -> Column:
    """Played in a known country that is neither side's name. Unknown country is false."""
    where = name_key(country)
    other_than_home = ~where.eqNullSafe(name_key(home))
    other_than_away = ~where.eqNullSafe(name_key(away))
    return _column(country).isNotNull() & other_than_home & other_than_away


def query_parameter(url: Column | str, key: str) -> Column:
    """First non-blank value of a URL query parameter, decoded; null when absent.

    A regular expression rather than ``parse_url``: links with characters a strict URI
    parser refuses (spaces, ``|``) still carry their parameter.
    """
    raw = F.regexp_extract(_column(url), rf"^[^?#]*\?(?:[^#]*?&)?{key}=([^&#]+)", 1)
    plain = F.translate(raw, "+", " ")
    return F.nullif(F.coalesce(F.try_url_decode(raw), plain), F.lit(""))


def percent_text(value: Column | str, digits: int = 1) -> Column:
    """A share as percent; null stays null."""
    value = _column(value)
    return F.when(value.isNotNull(), F.format_string(f"%.{digits}f%%", value * 100))


def points_text(value: Column | str, digits: int = 1) -> Column:
    """A margin in points; null stays null."""
    value = _column(value)
    return F.when(value.isNotNull(), F.format_string(f"%.{digits}f pts", value))
