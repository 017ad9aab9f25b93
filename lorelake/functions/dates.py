"""Written dates as timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MARKED = r"^(\d{4}-\d{1,2}-\d{1,2})\s*@\s*(\d{1,2})h\s*(\d{1,2})m\s*(\d{1,2})s"


def parsed_date(c: Column) -> Column:
    """Microseconds since 1970 (UTC) of a written date: ISO, ``2024-03-01@00h27m21s``, ``March 1, 2024 1:01am``, or digits of
    a Unix time in seconds or milliseconds; null if unreadable."""
    s = F.trim(c)
    iso = F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}([T ]|$)"), F.try_to_timestamp(F.regexp_replace(s, "Z$", "+00:00")))
    marked = F.when(s.rlike(_MARKED), F.try_to_timestamp(F.regexp_replace(s, _MARKED + ".*", "$1 $2:$3:$4"), F.lit("yyyy-M-d H:m:s")))
    spelled = F.regexp_replace(F.regexp_replace(F.initcap(F.regexp_replace(F.lower(s), r"(:\d{2})\s?([ap]m)$", "$1 $2")), r" Am$", " AM"), r" Pm$", " PM")
    written = F.when(s.rlike(r"(?i)^[a-z]+ \d{1,2}, \d{4} \d{1,2}:\d{2}\s?[ap]m$"), F.try_to_timestamp(spelled, F.lit("MMMM d, yyyy h:mm a")))
    digits = F.when(s.rlike(r"^\d{12,14}$"), s.cast("long") * 1000).when(s.rlike(r"^\d{9,10}$"), s.cast("long") * 1_000_000)
    return F.coalesce(digits, F.unix_micros(F.coalesce(iso, marked, written)))
