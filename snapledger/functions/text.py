"""Text predicates and renderings, all as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# These characters, patterns and words decide which rows match, so they are stated
# as they are. `\z` is the end of the text; Java's `$` would also match before a final line end.
SEPARATORS = (
    " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
BLANK = r"^[\t\n\f\r \p{Z}\x{200B}\x{FEFF}]*\z"
ISO_DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
UNSAFE = r"[\x00-\x1f\x7f-\x9f\x{2028}\x{2029}]"
SAFE_TEXT_CHARS = 200
DRAFT_HEAD_CHARS = 200
DRAFT_WORD_TH = "ร่าง"
DRAFT_WORD_EN = "draft"
DRAFT_LABEL = "ร่าง (DRAFT)"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def is_blank(col: Column | str) -> Column:
    """NULL, empty or nothing but white space, zero-width space and byte-order marks."""
    c = _c(col)
    return c.isNull() | c.rlike(BLANK)


def is_real_iso_date(col: Column | str) -> Column:
    """Exactly YYYY-MM-DD and an existing calendar day; never NULL."""
    c = _c(col)
    parsed = F.when(c.rlike(ISO_DATE), F.try_to_date(c, "yyyy-MM-dd"))
    return parsed.isNotNull()


def has_control(*cols: Column | str) -> Column:
    """A control character other than TAB, LF or CR in any of the columns."""
    return F.concat(*[F.coalesce(_c(c), F.lit("")) for c in cols]).rlike(CONTROL)


def sanitize(col: Column | str, limit: int = SAFE_TEXT_CHARS) -> Column:
    """Control characters to spaces, edges trimmed, first `limit` characters."""
    spaced = F.regexp_replace(_c(col), UNSAFE, " ")
    return F.substring(F.btrim(spaced, F.lit(SEPARATORS)), 1, limit)


def with_draft_label(col: Column | str) -> Column:
    """Prepend the draft label line unless the head of the text already carries one."""
    c = _c(col)
    head = F.substring(c, 1, DRAFT_HEAD_CHARS)
    labelled = head.contains(DRAFT_WORD_TH) | F.lower(head).contains(DRAFT_WORD_EN)
    return F.when(labelled, c).otherwise(F.concat(F.lit(f"[{DRAFT_LABEL}]\n"), c))


def render_count(col: Column | str) -> Column:
    """Thousands separators; '-' for NULL."""
    return F.coalesce(F.format_number(_c(col), 0), F.lit("-"))


def render_percent(col: Column | str) -> Column:
    """One-decimal percentage; '-' for NULL."""
    return F.coalesce(F.concat(F.format_number(_c(col) * 100, 1), F.lit("%")), F.lit("-"))
