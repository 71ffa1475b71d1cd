"""The n-gram join against all pairs."""

import random

import numpy as np
import pytest
from brute import components as brute

from logweave.llm.common import Scratch
from logweave.llm.components import components
from logweave.llm.ngram_join import keep_one, near_duplicates, shingle_hashes

SCHEMA = "doc_id bigint, text string, node string, n string, place string, text_hash string"


def table(spark, rows):
    return spark.createDataFrame([(d, t, "x", "y", "z", "h") for d, t in rows], SCHEMA)


def awkward():
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(300)]
    base = [rng.choice(vocab) for _ in range(120)]
    passage = " ".join(rng.choice(vocab) for _ in range(60))
    rows = [(1000 - i, " ".join(base)) for i in range(5)]  # exact copies
    for i in range(40):  # near copies, some too far from the base but near to each other
        copy = list(base)
        for _ in range(rng.randint(0, 6)):
            copy[rng.randrange(len(copy))] = rng.choice(vocab)
        rows.append((i, " ".join(copy)))
    rows += [(100 + i, f"{passage} " + " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 40)))) for i in range(30)]
    rows += [(200, None), (201, ""), (202, " \t\n "), (203, "One  two"), (204, "one\ttwo\n"), (205, "one"), (None, "one two"), (None, None)]
    rows += [(206, " ".join(vocab * 400)), (207, " ".join(vocab * 401))]  # long texts, few distinct shingles
    rows += [rows[0], rows[7], (203, "One  two"), (41, "É é È"), (42, "é é È")]  # repeated rows; only A-Z fold
    rows += [(300, " ".join(base)), (300, "another text under the same id")]
    return rows


def test_matches_all_pairs(spark):
    rows = awkward()
    got = near_duplicates(table(spark, rows), k=4, threshold=(85, 100))
    assert got.columns == ["doc_id", "n_shingles", "component_id", "text_hash"]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted((tuple(r)[:3] for r in got.collect()), key=key) == sorted(brute(rows, 4, 85, 100), key=key)


def test_random_tables_match_all_pairs(spark):
    rng = random.Random(9)
    rows = []
    for i in range(250):
        w = [rng.choice("abcdef") for _ in range(rng.randint(0, 30))] if rng.random() < 0.5 else rows[rng.randrange(len(rows))][1].split() if rows else []
        if w and rng.random() < 0.7:
            w[rng.randrange(len(w))] = rng.choice("abcdefgh")
        rows.append((i, " ".join(w)))
    got = near_duplicates(table(spark, rows), k=5, threshold=(80, 100))
    assert sorted(tuple(r)[:3] for r in got.collect()) == sorted(brute(rows, 5, 80, 100))


def test_keep_one_document_of_each_component(spark):
    rows = awkward()
    kept = keep_one(table(spark, rows), k=4, threshold=(85, 100))
    assert kept.columns == ["doc_id", "text", "node", "n", "place", "text_hash"]
    got = [(r.doc_id, r.text) for r in kept.collect()]
    comps = brute(rows, 4, 85, 100)
    assert sorted({d for d, _, c in comps if d is not None and d == c}) == sorted(d for d, _ in got if d is not None)
    assert sum(d is None for d, _ in got) == 2
    assert all(r.node == "x" and r.text_hash == "h" for r in kept.limit(5).collect())


def test_unlike_texts_under_one_id_both_stay(spark):
    one, two = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    near = one + " more"
    rows = [(1, one), (1, two), (1, two), (1, near), (2, near), (3, two), (4, "few words"), (4, "other words"), (4, "few words"), (4, None)]
    got = sorted((r.doc_id, r.text or "") for r in keep_one(table(spark, rows), k=4, threshold=(85, 100)).collect())
    assert got in ([(1, x), (1, two), (4, ""), (4, "few words"), (4, "other words")] for x in (one, near))


def test_empty_table(spark):
    empty = table(spark, [])
    assert near_duplicates(empty).count() == 0 and keep_one(empty).count() == 0


def test_word_hashes_do_not_depend_on_how_texts_are_grouped(monkeypatch):
    from logweave.llm import hashing

    texts = [b"a b c d e", b"", None, b"  lead and trail ", "é ü\n\nx".encode(), b"one two", b"w " * 500]
    whole, bounds = shingle_hashes(texts, 4)
    monkeypatch.setattr(hashing, "_PIECE", 7)
    again, bounds2 = shingle_hashes(texts, 4)
    assert np.array_equal(whole, again) and np.array_equal(bounds, bounds2)
    assert np.diff(bounds).tolist() == [2, 0, 0, 1, 1, 1, 497]
    for i, t in enumerate(texts):
        alone, _ = shingle_hashes([t], 4)
        assert np.array_equal(alone, whole[bounds[i] : bounds[i + 1]])


@pytest.mark.parametrize("shape", ["path", "star", "random"])
def test_components(spark, shape):
    rng = random.Random(5)
    n = 60
    edges = {"path": [(i, i + 1) for i in range(n)], "star": [(n, i) for i in range(n)],
             "random": [(rng.randrange(n), rng.randrange(n)) for _ in range(40)]}[shape]
    edges = [(-a, -b) for a, b in edges if a != b]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    scratch = Scratch(spark, "components")
    got = components(spark.createDataFrame(edges, "a bigint, b bigint"), scratch, "t").collect()
    assert sorted((r.node, r.root) for r in got) == sorted((x, find(x)) for x in root)
    scratch.close()
