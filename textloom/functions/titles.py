"""Page titles and their URL form, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c, collapse_whitespace, trim
from .unicode import capitalize_first


def normalize_title(s) -> Column:
    """Underscores as spaces, runs of spaces as one, cut at the first #, trimmed, first letter a capital."""
    t = collapse_whitespace(F.replace(_c(s), F.lit("_"), F.lit(" ")))
    return capitalize_first(trim(F.substring_index(t, "#", 1)))


def normalize_for_comparison(s) -> Column:
    """First letter in lower case."""
    return F.concat(F.lower(F.left(_c(s), F.lit(1))), F.substring(_c(s), 2, 2147483647))


def title_to_url(s) -> Column:
    """Spaces as underscores; all but letters, digits and -_.~ as %XX."""
    t = F.url_encode(F.replace(_c(s), F.lit(" "), F.lit("_")))
    return F.replace(F.replace(t, F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def url_to_title(s) -> Column:
    """%XX decoded, underscores as spaces, + kept. Escapes that are no escapes stay."""
    t = F.replace(F.replace(_c(s), F.lit("_"), F.lit(" ")), F.lit("+"), F.lit("%2B"))
    t = F.regexp_replace(t, r"%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(t), F.replace(_c(s), F.lit("_"), F.lit(" ")))


def full_title(namespace_name, title) -> Column:
    return F.when(F.coalesce(_c(namespace_name), F.lit("")) == "", _c(title)).otherwise(F.concat(_c(namespace_name), F.lit(":"), _c(title)))


def base_page_name(title) -> Column:
    return F.when(F.contains(_c(title), F.lit("/")), F.regexp_replace(_c(title), r"/[^/]*\z", "")).otherwise(_c(title))


def sub_page_name(title) -> Column:
    return F.substring_index(_c(title), "/", -1)


def root_page_name(title) -> Column:
    return F.substring_index(_c(title), "/", 1)


def safe_file_name(title) -> Column:
    """For a file of its own: characters that file systems refuse become underscores."""
    return F.translate(_c(title), '/\\:*?"<>|', "_________")
