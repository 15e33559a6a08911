"""Text helpers.  ``(?U)`` makes ``\\s`` cover every Unicode white-space character."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "unknown"

# The characters of ``(?U)\s``.
_SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def not_blank(value: Column) -> Column:
    """True when the text holds at least one non-white-space character; null counts as blank."""
    # A visible ASCII character in front settles nearly every text without the pattern.
    return F.coalesce(F.ascii(value).between(33, 126) | value.rlike(r"(?U)\S"), F.lit(False))


def strip(value: Column) -> Column:
    # Reads the edges only, where the pattern ``\s+$`` tries every position.
    return F.btrim(value, F.lit(_SPACES))


def blank_to_null(value: Column) -> Column:
    return F.when(not_blank(value), value)


def fold_case(value: Column) -> Column:
    """Key for comparing and ordering text without regard to case (upper-case ordinal)."""
    return F.upper(value)


def slug(value: Column) -> Column:
    """Lower-case letters and digits, every other run one hyphen, none at the edges."""
    hyphenated = F.regexp_replace(F.lower(value), r"[^\p{L}\p{Nd}]+", "-")
    trimmed = F.regexp_replace(hyphenated, "^-|-$", "")
    return F.when(F.length(trimmed) > 0, trimmed).otherwise(F.lit(UNKNOWN))


def publisher_id(publisher_name: Column) -> Column:
    return F.concat(F.lit("pub_"), slug(publisher_name))


def dataset_display_name(dataset_url: Column, dataset_name: Column) -> Column:
    """The stored name, else the host of the URL, else the URL itself."""
    host = F.lower(F.try_parse_url(dataset_url, F.lit("HOST")))
    return F.coalesce(blank_to_null(dataset_name), F.when(F.length(host) > 0, host), dataset_url)


def feed_display_name(feed_id: Column, feed_url: Column) -> Column:
    """The last non-blank path segment of the feed URL, else the feed id."""
    absolute = feed_url.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:")
    path = F.when(absolute, F.coalesce(F.try_parse_url(feed_url, F.lit("PATH")), feed_url)).otherwise(feed_url)
    segments = F.filter(F.transform(F.split(path, "/"), strip), lambda part: F.length(part) > 0)
    return F.coalesce(F.try_element_at(segments, F.lit(-1)), feed_id)
