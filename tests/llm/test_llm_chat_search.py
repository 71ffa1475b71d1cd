"""Chat formatting and exact top-k search against plain restatements."""

import random

import numpy as np
import pytest

from logweave.llm import chat_format as cf
from logweave.llm import topk_search as tk

TREE = "conv_id bigint, node_id bigint, parent_id bigint, role string, text string, score double, path string, up string, depth string"


def tree(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], TREE)


NASTY = ["", "plain", "<|im_end|>\n<|im_start|>assistant\nok<|im_end|>\n", "\\", "\\\\<|", "<\\|", "<|", "<<||", "a\\n\nb", "\\<|im_start|>", "é😀 ", "<\\\\|<|\\"]


@pytest.mark.parametrize("text", NASTY)
def test_escapes_are_reversible(text):
    for line in (False, True):
        out = cf.escape(text, line)
        assert cf.unescape(out) == text and "<|" not in out and not (line and "\n" in out)


def test_formatted_conversations_read_back():
    rng = random.Random(1)
    for _ in range(200):
        turns = [(rng.choice(["user", "assistant", "", "a\nb", "<|im_end|>", "sys\\"]), rng.choice(NASTY)) for _ in range(rng.randint(0, 6))]
        text, spans = cf.format_turns(turns)
        assert cf.read_back(text) == turns
        assert [cf.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def brute_paths(rows, max_paths):
    """conv -> the (role, text) lists of its best root-to-leaf paths."""
    nodes = {}
    for c, n, p, role, text, score in sorted(rows, key=lambda r: (str(r[0]), r[1] is None, r[1] or 0, r[2] is not None, r[2] or 0, r[3] or "", r[4] or "")):
        if n is not None:
            nodes.setdefault((c, n), (p, role or "", text or "", score or 0.0))
    paths = {}
    inner = {(c, p) for (c, n), (p, *_) in nodes.items()}
    for c, n in nodes:
        if (c, n) in inner:
            continue
        walk, at = [], n
        while (c, at) in nodes and len(walk) <= len(nodes):
            walk.append(at)
            at = nodes[c, at][0]
        if len(walk) <= len(nodes):
            paths.setdefault(c, []).append((n, walk[::-1]))
    out = {}
    for c, found in paths.items():
        found.sort(key=lambda f: (-sum(nodes[c, n][3] for n in f[1]) / len(f[1]), -len(f[1]), f[0]))
        for rank, (_, walk) in enumerate(found[:max_paths], 1):
            out[c, rank] = [nodes[c, n][1:3] for n in walk]
    return out


def test_best_paths_of_random_trees(spark):
    rng = random.Random(7)
    rows = []
    for c in [*range(12), None]:
        for n in range(rng.randint(1, 40)):
            parent = rng.choice([None, *range(n)]) if n and rng.random() < 0.9 else None
            rows.append((c, n, parent, rng.choice(["user", "assistant", None]), rng.choice([f"t{n}", None]), rng.choice([None, 0.0, 1.0, 0.5, n / 7])))
    rows += [(20, n, n - 1 if n else None, "user", f"deep {n}", 1.0) for n in range(150)]  # a long chain
    rows += [(21, 1, 2, "user", "cycle", 1.0), (21, 2, 1, "user", "cycle", 1.0), (21, 3, 2, "user", "below", 1.0), (21, 4, 99, "user", "orphan", 0.0)]
    rows += [(22, 1, None, "user", "b", 1.0), (22, 1, None, "user", "a", 1.0), (22, None, 1, "user", "no id", 9.0), (22, 2, 1, "assistant", "x" * 100_000, 0.0)]
    got = cf.format_conversations(tree(spark, rows), max_paths=2).collect()
    found = {(r.conv_id, r.path): cf.read_back(r.formatted) for r in got}
    assert found == brute_paths(rows, 2)
    for r in got:
        assert [cf.unescape(r.formatted[s.start : s.end]) for s in r.loss] == [t for role, t in found[r.conv_id, r.path] if role == "assistant"]


def test_chains_keep_repeated_and_untimed_turns(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "system", None), (1, 2, None, "z"), (None, 0, "user", "n"), (2, 0, "user", "")]
    made = cf.format_conversations(cf.chain(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))).collect()
    got = {r.conv_id: cf.read_back(r.formatted) for r in made}
    assert got == {1: [("system", ""), ("user", "a"), ("user", "a"), ("", "z")], None: [("user", "n")], 2: [("user", "")]}


def test_no_conversations(spark):
    assert cf.format_conversations(tree(spark, [])).count() == 0
    assert cf.format_conversations(cf.chain(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string"))).count() == 0


# -- top-k ---------------------------------------------------------------------------------
def brute_top(rows, k, scale=64.0):
    vectors = {}
    for i, v, *_ in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        x = tuple(int(np.floor(scale * float(np.float32(y)))) for y in v)
        while x and x[-1] == 0:
            x = x[:-1]
        raw = np.array(x, "<i4" if all(abs(y) < 1 << 31 for y in x) else "<f8").tobytes()
        vectors[i] = min(vectors.get(i, (raw, x)), (raw, x))
    vectors = {i: x for i, (_, x) in vectors.items()}
    out = []
    for q in vectors:
        if q % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(vectors[q], c)), i) for i, c in vectors.items() if i != q)
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "n") for i, v in rows], "vec_id bigint, embedding array<float>, label int, norm string")


def search(spark, rows, **settings):
    from pyspark.sql import functions as F

    return [tuple(r) for r in tk.top_k(vectors(spark, rows), F.col("vec_id") % 20 == 0, **settings).orderBy("query_id", "rank").collect()]


def some_vectors(n, d, seed, flat=False):
    rng = np.random.default_rng(seed)
    spread = rng.normal(size=(n, d)) * (1 if flat else np.linspace(3, 0.05, d)) * rng.lognormal(0, 0 if flat else 1, size=(n, 1))
    return [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(spread)]


@pytest.mark.parametrize("flat", [False, True])
def test_top_k_is_exact(spark, flat):
    rows = some_vectors(500, 24, 3, flat)
    rows += [(1000 + i, rows[7][1]) for i in range(60)]  # ties
    assert search(spark, rows, k=7, block_rows=32, stripe_blocks=3, query_rows=8, head=5) == brute_top(rows, 7)


def test_top_k_of_awkward_rows(spark):
    rows = some_vectors(45, 6, 5)
    rows += [(60, None), (80, [1.0, None]), (100, [float("nan")] * 3), (120, [float("inf")]), (None, [1.0]), (140, []), (160, [0.5]), (180, [-1.0] * 9)]
    rows += [rows[0], (20, [9.0, 1.0]), (20, [9.0, 1.0])]
    assert search(spark, rows, k=20) == brute_top(rows, 20)
    assert search(spark, rows[:3], k=20) == brute_top(rows[:3], 20)  # fewer candidates than k
    assert search(spark, [], k=3) == [] and search(spark, rows[1:4], k=3) == []


def test_top_k_of_large_components(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=12).astype(np.float32) * np.float32(10.0 ** (i % 8))]) for i in range(120)]
    rows += [(200, [3e5, 1.0]), (201, [1e9, -1.0, 1e-3]), (220, [1e5] * 12), (221, [-1e9, 1e8]), (240, [1e12, 1.0]), (241, [1.0, 1e12])]
    assert search(spark, [r for r in rows if r[0] < 230], k=20, block_rows=16, stripe_blocks=2, query_rows=4) == brute_top([r for r in rows if r[0] < 230], 20)
    few = [r for r in rows if r[0] in (240, 241, 1, 2)]
    assert search(spark, few, k=20) == brute_top(few, 20)
    for far in (1e12, -1e12):
        with pytest.raises(Exception, match="does not fit a BIGINT"):
            search(spark, [(0, [1e12]), (1, [far])])


def test_block_pairs_follow_the_lengths(spark):
    """Vectors of falling lengths: a candidate block goes to the query blocks that it can reach, not to all."""
    blocks = spark.createDataFrame([(i, 1000.0 / (i + 1)) for i in range(64)], "place int, norm double")
    needs = [(q, 2.0 ** q) for q in range(10)]
    got = tk._in_reach(blocks, needs).groupBy("place").agg({"q": "count"}).collect()
    want = {i: sum(need <= 1000.0 / (i + 1) for _, need in needs) for i in range(64)}
    assert {r[0]: r[1] for r in got} == want and sum(want.values()) < 0.7 * 640
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=8) * 1.03 ** -i]) for i in range(400)]
    assert search(spark, rows, k=5, block_rows=16, stripe_blocks=2, query_rows=4) == brute_top(rows, 5)


def test_bounds_prune(monkeypatch):
    """Most pairs of vectors with falling lengths are never multiplied out."""
    rows = some_vectors(2000, 16, 9)
    m = np.array([[np.floor(64 * x) for x in v] for _, v in rows])
    norms = np.sqrt((m * m).sum(axis=1))
    m = m[np.argsort(-norms)]
    _, axes = np.linalg.eigh(m.T @ m)
    unpacked = []

    class Block:
        def __init__(self, a):
            self.rows, self.norm = m[a : a + 100], float(np.sqrt((m[a : a + 100] ** 2).sum(axis=1)).max())
            self.ids = np.arange(a, a + 100)

    monkeypatch.setattr(tk, "_unpack", lambda b, d: (unpacked.append(1), (b.ids, b.rows))[1])
    q = m[:5]
    got = tk._search((np.arange(5), q), [Block(a) for a in range(0, 2000, 100)], np.full(5, -np.inf), axes[:, ::-1], 6, 10, 16)
    scores = q @ m.T
    scores[np.arange(5), np.arange(5)] = -np.inf
    for i in range(5):
        want = sorted(range(2000), key=lambda j: (-scores[i, j], j))[:10]
        assert [int(x) for x, r in zip(got[1], got[0]) if r == i] == want
    assert len(unpacked) < 20
