"""JSON payloads: strict object parsing and typed key lookup.

A payload is ``MAP<STRING, VARIANT>``: only top-level keys are ever looked up,
and only string values ever match, so the map keeps each value's JSON type.

Spark's variant parser refuses an object that repeats a key unless the session says otherwise; log
writers do repeat keys, and the last value stands.  A text that the parser refuses is therefore
read once more with every key numbered, which makes all keys differ; the numbers are taken off the map
afterwards.  No session setting is read, and a text that parses at once never pays for this.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["PAYLOAD_TYPE", "json_object", "parse_parts", "plain_json", "payload_of", "string_prop", "null_payload"]

PAYLOAD_TYPE = "map<string,variant>"
# Fixed value: the white space a JSON decoder skips around a value.
JSON_SPACE = " \t\n\r"
# A JSON string, a key with its colon, or a stretch of anything else; possessive, so no text is too long for it.
_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_TOKEN = rf'(?s){_STRING}(?:[ \t\n\r]*+:)?|[^"]++'
_DIGITS = 9  # of a key's number
# Only texts that show an exponent of three digits, or so many digits, can hold a number beyond the range of a double.
_EXPONENT = r"[eE]\+?[0-9]{3}"
_DIGITS_OF_MAX = 309
_NUMBER = r"[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"


def null_payload() -> Column:
    return F.lit(None).cast(PAYLOAD_TYPE)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _keyed(token: Column) -> Column:
    return token.startswith('"') & token.endswith(":")


def _numbered(s: Column) -> Column:
    """``s`` with each key's place in front of the key; null if the text does not fall into tokens."""

    def told(t, i):
        return F.when(_keyed(t), F.concat(F.lit('"'), F.lpad(i.cast("string"), _DIGITS, "0"), F.substring(t, 2, 2**31 - 1))).otherwise(t)

    tokens = F.regexp_extract_all(s, F.lit(_TOKEN), F.lit(0))
    return _let(tokens, lambda t: F.when(F.array_join(t, "") == s, F.array_join(F.transform(t, told), "")))


def _restored(v: Column) -> Column:
    """A value without the numbers in its own keys; if these repeat, an empty container of its kind."""

    def told(t):
        return F.when(_keyed(t), F.concat(F.lit('"'), F.substring(t, 2 + _DIGITS, 2**31 - 1))).otherwise(t)

    kind = F.schema_of_variant(v)
    text = F.array_join(F.transform(F.regexp_extract_all(F.to_json(v), F.lit(_TOKEN), F.lit(0)), told), "")
    empty = F.when(kind.startswith("OBJECT"), F.parse_json(F.lit("{}"))).otherwise(F.parse_json(F.lit("[]")))
    return F.when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), F.coalesce(F.try_parse_json(text), empty)).otherwise(v)


def _last_of_each(m: Column) -> Column:
    """The map of a numbered object: keys without numbers, the last value of each.  A variant's keys are sorted, here by place."""
    pairs = F.array_sort(F.transform(F.map_keys(m), lambda k, i: F.struct(F.substring(k, 1 + _DIGITS, 2**31 - 1).alias("name"), i.alias("at"))))

    def lasts(p):
        def is_last(x, j):
            return (j == F.size(p) - 1) | (F.get(p, j + 1)["name"] != x["name"])

        return F.filter(p, is_last)

    def built(last, values):
        return F.map_from_arrays(F.transform(last, lambda x: x["name"]), F.transform(last, lambda x: _restored(F.get(values, x["at"]))))

    return _let(F.map_values(m), lambda values: _let(_let(pairs, lasts), lambda last: built(last, values)))


def _in_range(s: Column) -> Column:
    """No number of ``s`` lies beyond the range of a double."""
    numbers = F.regexp_extract_all(F.regexp_replace(s, F.lit(f"(?s){_STRING}"), F.lit("")), F.lit(_NUMBER), F.lit(0))
    return ~F.exists(numbers, lambda n: n.try_cast("double") == float("inf"))


def parse_parts(s: Column) -> tuple[Column, Column]:
    """``(elements, closed)``, the parses behind ``plain_json``; stored as columns they are made once, in generated code.

    Spark's variant parser stops after the first complete value, so trailing
    text would be accepted.  Wrapping the text as an array element and as an
    object value rejects any tail: after a complete value the array needs
    ``]`` or ``,`` and the object needs ``}`` or ``,``; a ``,`` adds a second
    array element, and no tail satisfies both closers.  Only text containing
    ``]`` can close the array early, so only that text pays the second parse.
    """
    elements = F.try_parse_json(F.concat(F.lit("["), s, F.lit("]"))).try_cast("array<variant>")
    return elements, (F.instr(s, "]") == 0) | F.try_parse_json(F.concat(F.lit('{"v":'), s, F.lit("}"))).isNotNull()


def looks_like_object(s: Column) -> Column:
    return F.coalesce(F.ltrim(s, F.lit(JSON_SPACE)).startswith("{"), F.lit(False))


def plain_json(s: Column, elements: Column, closed: Column) -> Column:
    """Whether ``s`` is exactly one JSON object with nothing special about it, or ``null``, from its ``parse_parts``.

    No lambda, so generated code evaluates it.  What looks like an object but is not plain (the parser refused it, or a number
    may be too large) is for ``numbered_object`` to decide."""
    single = F.coalesce((F.size(elements) == 1) & closed, F.lit(False))
    usual = ~s.rlike(_EXPONENT) & ~((F.octet_length(s) > _DIGITS_OF_MAX) & s.rlike(f"[0-9]{{{_DIGITS_OF_MAX}}}"))
    return single & F.when(looks_like_object(s), usual).otherwise(F.coalesce(F.is_variant_null(F.get(elements, F.lit(0))), F.lit(False)))


def payload_of(s: Column, elements: Column, plain: Column) -> Column:
    """The payload of ``s``, given ``plain_json``; a JSON ``null`` has none."""
    value = F.get(elements, F.lit(0))
    return F.when(plain, F.when(looks_like_object(s), value.try_cast(PAYLOAD_TYPE))).when(looks_like_object(s), numbered_object(s))


def numbered_object(s: Column) -> Column:
    """The payload of an object that may repeat keys, the last value of each; null if ``s`` is no object or holds a number beyond double."""

    def of(elements, closed):
        fine = (F.size(elements) == 1) & closed & _in_range(s)
        return F.when(fine, _let(F.get(elements, F.lit(0)).try_cast(PAYLOAD_TYPE), _last_of_each))

    return _let(_numbered(s), lambda text: _let(parse_parts(text)[0], lambda e: of(e, parse_parts(text)[1])))


def json_object(s: Column) -> tuple[Column, Column]:
    """``(ok, payload)``: whether ``s`` is exactly one JSON object, or ``null``, and the object as a map.

    ``ok`` is true where a strict decoder of a JSON object would succeed (``null`` included, which yields a null payload).  Of a
    repeated key the last value stands.  A number beyond the range of a double fails the text.  For per-row use on large data
    prefer the staged form in ``parse_entries``."""

    def both(elements):
        plain = plain_json(s, elements, parse_parts(s)[1])
        payload = payload_of(s, elements, plain)
        return F.struct((plain | payload.isNotNull()).alias("ok"), payload.alias("payload"))

    found = _let(parse_parts(s)[0], both)
    return found["ok"], found["payload"]


def string_prop(payload: Column, key: str) -> Column:
    """The payload value under ``key`` if it is a JSON string, else NULL."""
    v = F.element_at(payload, F.lit(key))
    return F.when(F.schema_of_variant(v) == "STRING", v.cast("string"))
