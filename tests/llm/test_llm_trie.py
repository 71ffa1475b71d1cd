"""Prefix tries against a plain trie in memory."""

import hashlib
import random
import zlib

import pytest

from logweave.llm import prefix_trie as pt
from logweave.llm.common import Scratch
from logweave.llm.ordered import in_order

COLUMNS = "conv_id bigint, turn bigint, role string, text string, depth string, key string, size int"


def key(row):
    _, turn, role, text = row
    role, text = role or "", text or ""
    return turn is not None, turn or 0, role, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()


def rebuilt(rows):
    own = {}
    for r in sorted((r for r in rows if r[0] is not None), key=key):
        own.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        out[c] = own.get(base, [])[:h] + own[c][h:]
    return out


def trie(convs):
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        ends = sorted(c for c in members if len(convs[c]) == len(path))
        out.append((
            min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), sum(len(p) == len(path) + 1 for p in below),
            sum(not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below) for p in below),
            sum((len(nodes[p]) - 1) * len(p[-1][1]) for p in below if p), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def found(spark, rows):
    scratch = Scratch(spark, "test")
    said = scratch.save(pt.turn_rows(spark.createDataFrame([(*r, "x", "y", 1) for r in rows], COLUMNS).repartition(3)), "said")
    turns, ids = pt.share_openings(in_order(said, "conv_id", ["turn", "role", "digest"], scratch, "placed"))
    nodes = pt.prefix_trie(turns, ids, ["part", "place"], scratch)
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in nodes.select(*names).collect()), key=repr)


@pytest.fixture
def many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_random_conversations(spark, many_ranges):
    rng = random.Random(11)
    ids = [0, 100, 200, -100, *range(1, 40), *range(101, 120), -3, -150, 307, 10**15]
    said = ["", None, "hi", "yes", "é😀", "no no"]
    rows = [(c, rng.choice([None, *range(4)]), rng.choice(["user", "assistant", None]), rng.choice(said)) for c in ids for _ in range(rng.randint(1, 9))]
    rows += [(None, 0, "user", "no conversation"), (500, None, "a", "x" * 100_000), (500, None, "a", "x" * 100_000)]
    rows += [(1000 + c, t, "user", f"turn {t}") for c in range(60) for t in range(7)]  # copies
    assert found(spark, rows) == trie(rebuilt(rows))


def test_one_long_conversation_and_many_that_end_alike(spark, many_ranges):
    rows = [(700, t, "user", f"long {t % 7}") for t in range(400)] + [(701, t, "user", f"long {t % 7}") for t in range(400)]
    rows += [(c, 0, "user", "only") for c in range(800, 1500)]
    assert found(spark, rows[:405] + rows[800:]) == trie(rebuilt(rows[:405] + rows[800:]))


def test_no_conversations(spark):
    assert found(spark, []) == [] and found(spark, [(None, 1, "user", "x")]) == []


def test_conversations_without_turns_end_at_the_root(spark):
    silent = [c for c in range(1, 400) if zlib.crc32(str(c).encode()) % 6 == 5 and c % 100][:3]  # their base is absent and all their turns are replaced
    got = found(spark, [(c, 0, "user", "gone") for c in silent])
    assert got == [(min(silent), 0, None, 3, 0, 1, 0, hashlib.sha256(",".join(map(str, silent)).encode()).hexdigest())]
