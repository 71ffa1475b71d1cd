"""Event predicates: what an entry is matched on and whether it matches.

An entry is matched on its payload's ``event`` value when the payload has that
key (a non-string value never matches), otherwise on its message.  Steps may
also require payload properties whose string values match their own patterns.
All predicates are null-free booleans built from literal-pattern ``RLIKE``.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .payload import string_prop
from .regex import search

__all__ = ["match_subject", "matches_pattern", "has_properties", "matches_step", "EVENT_KEY"]

# Fixed value: the payload key that names the event.
EVENT_KEY = "event"


def match_subject(message: Column, payload: Column) -> Column:
    """The text patterns are matched against; NULL means "never matches"."""
    no_event = payload.isNull() | ~F.map_contains_key(payload, F.lit(EVENT_KEY))
    return F.when(no_event, message).otherwise(string_prop(payload, EVENT_KEY))


def matches_pattern(subject: Column, pattern: str) -> Column:
    """Unanchored, case-sensitive RE2 search of ``pattern`` in ``subject``."""
    return F.coalesce(search(subject, pattern), F.lit(False))


def has_properties(payload: Column, required: Mapping[str, str]) -> Column:
    """Every required key exists in the payload, is a string, and matches its pattern."""
    cond = F.lit(True)
    for key, pattern in required.items():
        cond = cond & F.coalesce(search(string_prop(payload, key), pattern), F.lit(False))
    return cond


def matches_step(subject: Column, payload: Column, step) -> Column:
    """Step predicate: the event pattern and all required properties."""
    pred = matches_pattern(subject, step.event_pattern)
    if step.required_properties:
        pred = pred & has_properties(payload, step.required_properties)
    return pred
