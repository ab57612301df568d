"""Date expressions. All results are UTC timestamps (session zone UTC)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions.binding import let
from newsloom.functions.text import non_blank, strip

# North American zone names and their fixed offsets (fixed values).
ZONE_OFFSETS = (
    ("EST", "-0500"), ("EDT", "-0400"), ("CST", "-0600"), ("CDT", "-0500"),
    ("MST", "-0700"), ("MDT", "-0600"), ("PST", "-0800"), ("PDT", "-0700"),
)
_MAIL_PATTERNS = (
    "d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm:ss xx", "d MMM yyyy HH:mm z",
    "d MMM yyyy HH:mm xx", "d MMM yyyy HH:mm:ss",
)
_ISO = (
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"
    r"([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]{1,6})?)?(Z|[+-][0-9]{2}:?[0-9]{2})?)?$"
)


def parse_iso(text: Column) -> Column:
    """ISO date or date-time to a timestamp; anything else to null."""
    value = strip(text)
    return F.when(value.rlike(_ISO), F.try_to_timestamp(value))


def parse_feed_date(text: Column) -> Column:
    """RFC-822 or ISO date text to a timestamp; unreadable text to null."""
    value = strip(text)
    read = let(_plain_mail(value), lambda mail: F.coalesce(*[F.try_to_timestamp(mail, F.lit(p)) for p in _MAIL_PATTERNS]))
    return F.when(value.rlike("^[0-9]{4}-"), parse_iso(value)).otherwise(read)


def _plain_mail(value: Column) -> Column:
    """``d MMM yyyy time zone`` of the ways feeds write mail dates.

    The weekday is optional, short or long, with or without a comma; a trailing comment goes;
    day, month and year may be joined by hyphens; long months are cut to three letters, and
    years of two digits lie in 1969 to 2068.
    """
    bare = F.regexp_replace(value, r"\s*\([^()]*\)\s*$", "")
    bare = F.regexp_replace(bare, r"^[A-Za-z]{3,9}\s*[,.]?\s+(?=[0-9])|^[A-Za-z]{3,9},", "")
    bare = F.regexp_replace(bare, r"^\s*([0-9]{1,2})[\s-]+([A-Za-z]{3})[a-z]*[.,]?[\s-]+([0-9]{2,4})\s+", "$1 $2 $3 ")
    bare = F.regexp_replace(bare, r"^([0-9]{1,2} [A-Za-z]{3}) (69|[7-9][0-9]) ", "$1 19$2 ")
    bare = F.regexp_replace(bare, r"^([0-9]{1,2} [A-Za-z]{3}) ([0-9]{2}) ", "$1 20$2 ")
    bare = F.regexp_replace(bare, r"\s(?:UTC?|Z)$", " GMT")
    for name, offset in ZONE_OFFSETS:
        bare = F.regexp_replace(bare, rf"\b{name}$", offset)
    return bare


def date_status(text: Column, parsed: Column) -> Column:
    """'missing' and 'ok' are acceptable; 'bad' is present but unreadable."""
    return (
        F.when(non_blank(text).isNull(), "missing").when(parsed.isNull(), "bad").otherwise("ok")
    )


def parse_query_date(text: Column) -> Column:
    """A user-supplied bound: blank or unreadable means no bound."""
    return parse_iso(non_blank(text))
