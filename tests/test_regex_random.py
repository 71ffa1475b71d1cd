"""Random differential test: translated patterns on Spark vs RE2 (DuckDB)."""

import random

import duckdb
from pyspark.sql import functions as F

from logweave.functions.regex import search

# Building blocks of the random patterns and texts.
ATOMS = ["a", "b", "k", "s", "é", " ", "\\.", ".", "[a-c]", "[^a]", "\\d", "\\w", "\\W", "\\s", "\\S", "1",
         "\\b", "\\B", "^", "$", "[[:alpha:]]", "[[:^space:]]", "\\pL", "x", "_", "\\Qa.\\E", "[-.]", "[\\d_]"]
QUANTS = ["", "", "", "*", "+", "?", "{1,2}", "{2}", "*?", "+?"]
ALPHABET = "abksé .1x_-\nKſK9A"


def random_pattern(rng, depth=0):
    parts = []
    for _ in range(rng.randint(1, 4)):
        r = rng.random()
        if r < 0.15 and depth < 2:
            inner = random_pattern(rng, depth + 1)
            if rng.random() < 0.4:
                inner += "|" + random_pattern(rng, depth + 1)
            atom = rng.choice(["(", "(?:", "(?i:"]) + inner + ")"
        else:
            atom = rng.choice(ATOMS)
        q = rng.choice(QUANTS)
        if atom in ("^", "$", "\\b", "\\B") and q:
            q = ""
        parts.append(atom + q)
    prefix = rng.choice(["", "", "", "(?i)", "(?m)", "(?s)"])
    return prefix + "".join(parts)


def test_random_patterns_match_re2(spark):
    rng = random.Random(2024)
    patterns = []
    while len(patterns) < 250:
        p = random_pattern(rng)
        try:
            duckdb.execute("SELECT regexp_matches('', ?)", [p])
        except duckdb.Error:
            continue  # not valid RE2 either
        patterns.append(p)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 8))) for _ in range(60)]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    cols = [F.coalesce(search(F.col("s"), p), F.lit(False)).alias(f"p{i}") for i, p in enumerate(patterns)]
    got = [tuple(r) for r in df.select(*cols).collect()]
    mismatches = []
    for ti, t in enumerate(texts):
        for pi, p in enumerate(patterns):
            if "\\B" in p and not t.isascii():
                # RE2/C++ (DuckDB) tests \B between the bytes of a multi-byte
                # UTF-8 character; Go's engine, the target, only at code points
                continue
            want = duckdb.execute("SELECT regexp_matches(?, ?)", [t, p]).fetchone()[0]
            if got[ti][pi] != want:
                mismatches.append((p, t, got[ti][pi], want))
    assert not mismatches, mismatches[:10]
