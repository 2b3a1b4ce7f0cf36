"""Authored times and durations, kept as strings and read where they are compared."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"
_DATE = r"^\d{4}-\d{2}-\d{2}$"


def instant(value: Column) -> Column:
    """A strict RFC 3339 time, else null."""
    return F.when(value.rlike(_RFC3339), F.try_to_timestamp(value))


def instant_or_date(value: Column) -> Column:
    """As ``instant``, and a bare date as its midnight in UTC."""
    return F.when(value.rlike(f"{_RFC3339}|{_DATE}"), F.try_to_timestamp(value))


def applicability(as_of: Column, valid_from: Column, valid_until: Column, observed_at: Column, occurred_at: Column) -> Column:
    """true or false whether a row holds at a time, null where that is not known. Intervals include both ends."""
    given = lambda c: F.coalesce(c, F.lit("")) != ""
    start, end = instant(valid_from), instant(valid_until)
    seen = F.when(given(observed_at), observed_at).when(given(occurred_at), occurred_at)
    early = F.when(given(valid_from), F.when(start.isNull(), F.lit("unknown")).when(as_of < start, F.lit("no")))
    late = F.when(given(valid_until), F.when(end.isNull(), F.lit("unknown")).when(as_of > end, F.lit("no")))
    state = F.coalesce(early, late, F.lit("yes"))
    return F.when(given(valid_from) | given(valid_until), F.when(state == "yes", True).when(state == "no", False)).when(seen.isNotNull(), instant(seen) <= as_of)


def staleness_time(observed_at: Column, valid_until: Column, valid_from: Column, occurred_at: Column, committed_at: Column) -> Column:
    """The first time, in this order, that can be read."""
    return F.coalesce(*[instant_or_date(c) for c in (observed_at, valid_until, valid_from, occurred_at, committed_at)])


def seconds_of(duration: str) -> float:
    """Seconds of a duration such as 24h, 1h30m or 1.5s."""
    import re

    units = {"h": 3600, "m": 60, "s": 1, "ms": 1e-3, "us": 1e-6, "µs": 1e-6, "ns": 1e-9}
    parts = re.findall(r"(\d+(?:\.\d*)?|\.\d+)(ms|us|µs|ns|h|m|s)", duration)
    if not parts or "".join(a + b for a, b in parts) != duration.lstrip("+-"):
        raise ValueError(f"not a duration: {duration!r}")
    return (-1 if duration.startswith("-") else 1) * sum(float(n) * units[u] for n, u in parts)
