"""White space, blank tests and cleaning as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Characters removed at the ends: Unicode white space and the separators 1C-1F.
EDGES = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
_SPACES = r"(?U)[\s\x1c-\x1f]+"


def strip(col: Column) -> Column:
    return F.regexp_replace(col, EDGES, "")


def not_blank(col: Column) -> Column:
    """True only for text that has a visible character; NULL counts as blank."""
    return F.coalesce(F.length(strip(col)) > 0, F.lit(False))


def filled(col: Column) -> Column:
    """NULL for NULL and for the empty string (not for spaces)."""
    return F.nullif(col, F.lit(""))


def words(col: Column) -> Column:
    """Lower-case terms between white space, empty ones dropped."""
    return F.filter(F.split(F.lower(col), _SPACES), lambda t: t != "")


def squeeze(col: Column) -> Column:
    return strip(F.regexp_replace(col, _SPACES, " "))


def sanitize(col: Column) -> Column:
    """Drop characters a text column of a database refuses; keep tab, LF and CR."""
    return F.regexp_replace(F.make_valid_utf8(col), r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")


def truncate_markdown(col: Column, limit: int = 200_000) -> Column:
    return F.when(F.length(col) > limit, F.concat(F.substring(col, 1, limit), F.lit("\n\n[TRUNCATED]"))).otherwise(col)


def strip_tags(col: Column) -> Column:
    return F.coalesce(F.regexp_replace(col, r"<[^>]+>", ""), F.lit(""))


def escape_html(col: Column) -> Column:
    out = F.replace(F.coalesce(col, F.lit("")), F.lit("&"), F.lit("&amp;"))
    out = F.replace(out, F.lit("<"), F.lit("&lt;"))
    return F.replace(out, F.lit(">"), F.lit("&gt;"))
