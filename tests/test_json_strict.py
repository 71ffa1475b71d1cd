"""Strict JSON-object decoding against a strict Python decoder."""

import json
import random
import re

from pyspark.sql import functions as F

from logweave.functions.payload import json_object, string_prop


def strict(s):
    """(ok, keys, string value of "event") the way a strict object decoder sees ``s``."""

    def no_constants(name):
        raise ValueError(name)

    try:
        v = json.loads(s, parse_constant=no_constants)
    except (ValueError, RecursionError):
        return False, None, None
    if v is None:
        return True, None, None
    if not isinstance(v, dict):
        return False, None, None
    if re.search(r"Infinity", json.dumps(v).replace('"Infinity"', "")):
        return False, None, None  # a number beyond the range of a double
    ev = v.get("event")
    return True, sorted(v), ev if isinstance(ev, str) else None


CASES = [
    '{"a":1}', ' {"a":1} ', '\t{"a":1}\n', '{"a":1} x', '{"a":1}}', '{"a":1}]', '{"a":1},{"b":2}', '[{"a":1}]',
    '{"a":1}] {"b":2}', '{"a":1}, "b":2}', 'null', ' null ', 'nul', '"str"', '5', 'true', '[]', '{}', '{ }',
    '{"event":"x","event":"y"}', '{"event":5}', '{"event":null}', '{"event":"v","n":{"m":[1,2]}}', "{'a':1}",
    '{"a":NaN}', '{"a":Infinity}', '{"a":01}', '{"a":1,}', '{"a" 1}', '{"a":"\\u00e9"}', '{"a":"x\\"y"}',
    '{"a":-0.5e3}', '{"é":"ü"}', '', ' ', '{"a":[1,2,]}', '{"a":1} ', ' {"a":1}', '{"a":tru}',
    '{"event":"a\\"b:","event":"c\\\\","x":"event\\":1"}', '{"event":1,"event" : "y"}', '{"event":"y","event":[1,{"event":2}]}', '{"event":"x","event":"y"}]',
    '{"n":{"x":1,"x":2},"event":"z"}', '{"event":"x","event":"y"', '{"event":"x",,"event":"y"}', '{"event":"x","event":"y"} {}', '{"event":"x":"event"}',
    '{"event":"x","event":1"}', '{"\\u0065vent":"x","event":"y"}', '{"a":1,"a":2,"event":"x","a":3,"event":"w","b":[],"b":{}}', '{"a":1e400}', '{"a":[-1E+999]}',
    '{"a":"1e400","event":"1E999"}', '{"a":1e308,"b":1e-400}', '{"a":1e0400}', '{"event":"x","event":1e999}', '{"":1,"":2}', '{"a":"line\\nbreak"}', '{"event":"a"}{"event":"b"}', '{"a":{"b":{"c":{}}}}', '{"a":1}//c', '{"a":"\t"}',
]


def mutate(rng, s):
    ops = [lambda t: t[: rng.randint(0, len(t))], lambda t: t + rng.choice(["}", "]", ",", " x", "\n", "{"]),
           lambda t: rng.choice(["[", " ", "x"]) + t, lambda t: t.replace('"', "'", 1), lambda t: t.replace(":", "", 1)]
    return rng.choice(ops)(s) if s else s


def test_json_object_matches_strict_decoder(spark):
    rng = random.Random(99)
    texts = CASES + [mutate(rng, rng.choice(CASES)) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    ok, payload = json_object(F.col("s"))
    rows = df.select(ok.alias("ok"), F.sort_array(F.map_keys(payload)).alias("keys"),
                     string_prop(payload, "event").alias("event")).collect()
    bad = []
    for t, r in zip(texts, rows):
        want = strict(t)
        got = (r.ok, list(r["keys"]) if r["keys"] is not None else None, r.event)
        if got != want:
            bad.append((t, got, want))
    assert not bad, bad[:8]


def test_repeated_keys_without_session_settings(spark):
    """The last value of a key stands, with its JSON kind; values keep what they hold."""
    assert spark.conf.get("spark.sql.variant.allowDuplicateKeys") == "false"
    texts = ['{"a":1,"b":{"x":[1,"y:",{"z":null}]},"a":"s"}', '{"a":{"k":1,"k":2},"b":[{"k":1,"k":2}],"c":true}', '{"b":2.50,"b":null}']
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    got = [r[0] for r in df.select(F.to_json(json_object(F.col("s"))[1])).collect()]
    assert [json.loads(g) for g in got] == [{"a": "s", "b": {"x": [1, "y:", {"z": None}]}}, {"a": {}, "b": [], "c": True}, {"b": None}]


def test_long_payloads_with_repeated_keys(spark):
    many = ",".join(f'"k{i % 500}":"v{i}"' for i in range(20_000))
    long = '{"event":"first","t":"' + "x\\n" * 200_000 + '","event":"last",' + many + "}"
    df = spark.createDataFrame([(long,)], "s string")
    ok, payload = json_object(F.col("s"))
    row = df.select(ok.alias("ok"), F.size(payload).alias("n"), string_prop(payload, "event").alias("event"), string_prop(payload, "k499").alias("k")).first()
    assert (row.ok, row.n, row.event, row.k) == (True, 502, "last", "v19999")
