"""Merkle manifests against a plain tree, and the appender step by step."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from logweave.llm import merkle as mk
from logweave.llm.common import Scratch
from logweave.llm.ordered import BASE, PRIME, in_order

COLUMNS = "doc_id bigint, lang string, text string, source string, n_chars bigint, pos string, root string, leaf int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def up(level):
    return [sha("".join(level[i : i + 8])) for i in range(0, len(level), 8)]


def tree(level):
    levels = [level]
    while len(levels[-1]) > 1:
        levels.append(up(levels[-1]))
    return levels


def others(levels, i):
    out = []
    for level in levels[:-1]:
        first = i // 8 * 8
        out += [level[k] for k in range(first, min(first + 8, len(level))) if k != i]
        i //= 8
    return out


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def brute(rows):
    """(lang, doc_id, leaf, subroot, root, siblings), sorted."""
    groups = {}
    for d, lang, text, source, n, *_ in rows:
        groups.setdefault(lang, []).append((d is not None, d or 0, sha("".join(map(field, (d, source, lang, n, text))))))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x[2] for x in sorted(groups[g])]) for g in names}
    top = tree([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for i, (known, d, leaf) in enumerate(sorted(groups[g])):
            out.append((g, d if known else None, leaf, trees[g][-1][0], top[-1][0], "".join(others(trees[g], i) + others(top, k))))
    return sorted(out, key=repr)


def manifest(spark, rows, **settings):
    docs = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], COLUMNS).repartition(3)
    leaf = mk.leaf_hash([F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")])
    return mk.manifest(docs.withColumn("leaf", leaf).withColumn("changed", F.upper("leaf")), group="lang", order="doc_id", carry=["changed"], **settings)


@pytest.fixture
def many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.mark.parametrize("depth", [1, 4])
def test_manifest_of_random_rows(spark, many_ranges, depth):
    rng = random.Random(depth)
    langs = ["en"] * 12 + ["de", "de", "fr", None, "é", "zz", "😀"] + [f"l{i}" for i in range(12)]
    rows = [(i, rng.choice(langs), rng.choice([None, "", f"Text {i} é", "same"]), rng.choice([None, "web"]), i) for i in range(700)]
    rows += [(None, "en", "no id", None, None), (3, "en", "again", "web", 1), (3, "en", "again", "web", 1)] + [(9, "en", "hot", "", 0)] * 70
    got = manifest(spark, rows, depth=depth).collect()
    assert sorted(((r.lang, r.doc_id, r.leaf, r.subroot, r.root, r.siblings) for r in got), key=repr) == brute(rows)
    for r in got:
        assert mk.fold(r.leaf, r.slots, r.widths, r.siblings) == r.root
        assert mk.fold(sha("other"), r.slots, r.widths, r.siblings) != r.root
        assert r.changed == r.leaf.upper() and len(r.siblings) == 64 * sum(w - 1 for w in r.widths)
    places = {}
    for r in got:
        places.setdefault(r.lang, []).append(r.pos)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


@pytest.mark.parametrize("n", [1, 9, 64])
def test_one_group(spark, n):
    rows = [(i, None, "x" * (100_000 if i == 0 else 3), None, None) for i in range(n)]
    got = manifest(spark, rows, depth=1).collect()
    assert sorted(((r.lang, r.doc_id, r.leaf, r.subroot, r.root, r.siblings) for r in got), key=repr) == brute(rows)
    assert n > 1 or (got[0].root == got[0].subroot == got[0].leaf and got[0].siblings == "")


def test_no_rows(spark):
    assert manifest(spark, []).count() == 0


def test_folded_roots_tell_changed_rows(spark):
    made = manifest(spark, [(i, "en", f"t{i}", None, None) for i in range(20)])
    seen = mk.folded(made.withColumn("start", F.when(F.col("doc_id") % 2 == 0, F.col("leaf")).when(F.col("doc_id") > 9, "00")), "start").collect()
    for r in seen:
        assert (r.folded_root == r.root) if r.doc_id % 2 == 0 else (r.folded_root is None if r.doc_id <= 9 else r.folded_root != r.root)


def test_witnesses_grow_with_each_append():
    rng = random.Random(5)
    leaves = [sha(str(i)) for i in range(100)]
    tree_ = mk.Appender()
    for n, leaf in enumerate(leaves, 1):
        tree_.append(leaf)
        i = rng.randrange(n)
        slots, widths, siblings = tree_.witness(i)
        known = [siblings[k : k + 64] for k in range(0, len(siblings), 64)]
        run = i // 8 * 8
        first = [leaves[k] for k in range(run, min(run + 8, n)) if k != i]
        assert known[: len(first)] == first and slots[0] == i % 8 and widths[0] == len(first) + 1
    assert tree_.close() == tree(leaves)[-1][0]
    for i in range(100):
        assert tree_.witness(i)[2] == "".join(others(tree(leaves), i))


def test_places_and_keys_across_ranges(spark, many_ranges):
    rng = random.Random(2)
    rows = [(rng.choice([1, 1, 1, 1, 2, 3, None]), i, f"{rng.getrandbits(256):064x}") for i in range(900)]
    scratch = Scratch(spark, "test")
    stored = scratch.save(spark.createDataFrame(rows, "g bigint, t bigint, x string").repartition(5), "rows")
    got = in_order(stored, "g", ["t"], scratch, "placed", "x").collect()
    assert len(got) == len(rows) and set(got[0].asDict()) == {"g", "t", "x", "_at", "_up", "_key"}
    at, key = {}, {}
    for r in sorted(got, key=lambda r: r.t):
        assert r["_at"] == at.get(r.g, 0) and int(r["_up"], 16) == key.get(r.g, 0)
        at[r.g], key[r.g] = r["_at"] + 1, (key.get(r.g, 0) * BASE + int(r.x, 16)) % PRIME
        assert int(r["_key"], 16) == key[r.g]
