"""Column-level building blocks (all JVM-side expressions)."""

from .match import has_properties, match_subject, matches_pattern, matches_step
from .payload import json_object, string_prop
from .regex import RegexSyntaxError, translate
from .text import unicode_trim

__all__ = [
    "translate",
    "RegexSyntaxError",
    "unicode_trim",
    "json_object",
    "string_prop",
    "match_subject",
    "matches_pattern",
    "has_properties",
    "matches_step",
]
