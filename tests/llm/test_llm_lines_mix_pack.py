"""Line dedup, mixing and packing against plain restatements."""

import random
import struct
import zlib
from collections import Counter

import pytest
from brute import dedup, mix_targets, sainte_lague, words
from pyspark.sql import functions as F

from logweave.llm import mixing, packing
from logweave.llm.line_dedup import dedup_lines

EXTRA = "doc_id bigint, text string, source string, size string, h1 string, pos string, taken string, n_lines string, _doc string, n_chars bigint"


def table(spark, rows):
    """rows of (doc_id, text, source)."""
    return spark.createDataFrame([(d, t, s, "a", "b", "c", "d", "e", "f", 0) for d, t, s in rows], EXTRA)


def texts(seed=3, n=60):
    rng = random.Random(seed)
    pool = [f"line {i} of the pool" for i in range(12)] + ["", " "]
    rows = []
    for i in range(n):
        t = "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 14)))
        rows.append((i, t, rng.choice(["a", "b", "c", None, "é"])))
    rows += [(n, None, "a"), (n + 1, "", None), (n + 2, " \n\t\n ", "b"), (None, rows[4][1], "a"), (None, None, None)]
    rows += [rows[5], (5, "other\ntext\nunder\nthe id", "b"), (n + 3, "\n\n\n\n", "c")]
    rows += [(n + 4, "\n".join(f"long {i % 900}" for i in range(20_000)), "hot"), (n + 5, "w " * 50_000, "hot")]
    return rows


def order(r):
    return tuple((x is None, str(x)) for x in r)


def test_line_dedup_matches_brute_force(spark):
    rows = texts()
    got = dedup_lines(table(spark, rows))
    assert [c for c in got.columns if c in ("size", "h1", "pos", "_doc", "n_removed")] == ["size", "h1", "pos", "_doc", "n_removed"]
    found = [(r.doc_id, r.text, r.n_lines, r.n_removed) for r in got.collect()]
    assert sorted(found, key=order) == sorted(dedup([r[:2] for r in rows]), key=order)
    assert sum(r[3] for r in found) > 100
    assert got.select("h1", "_doc").distinct().collect()[0] == ("b", "f")


def test_line_dedup_of_an_empty_table(spark):
    assert dedup_lines(table(spark, [])).count() == 0


def test_targets_share_the_excess_again(spark):
    rng = random.Random(2)
    for sizes in ({"a": 10, "b": 1000, "c": 500}, {"a": 0, "b": 7, None: 3}, {str(i): rng.randint(0, 300) for i in range(23)}, {"x": 0}):
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
        got = {r.source: r.target for r in mixing.targets(df, (5, 2, 1)).collect()}
        want = mix_targets(sizes, (5, 2, 1))
        assert got.keys() == want.keys()
        assert all(abs(got[s] - want[s]) < 1e-6 * (1 + want[s]) for s in want)


def test_sainte_lague_is_the_seat_by_seat_result(spark):
    rng = random.Random(6)
    rows, want = [], {}
    for g in range(12):
        votes = [rng.choice([0, 1, rng.randint(1, 10**6), 500]) for _ in range(rng.randint(1, 9))]
        seats = rng.choice([0, 1, 3, 50, 1000])
        want[g] = sainte_lague(votes, seats) if sum(votes) else [0] * len(votes)
        rows += [(g, i, v, seats) for i, v in enumerate(votes)]
    df = spark.createDataFrame(rows, "g int, i int, votes bigint, seats bigint")
    got = mixing.sainte_lague(df, ["g"], "votes", F.col("seats"), [F.col("i")]).collect()
    assert {(r.g, r.i): r.quota for r in got} == {(g, i): q for g, qs in want.items() for i, q in enumerate(qs)}


def test_mix_plan_and_documents(spark):
    rows = [r for r in texts(8, 300) if r[1] is None or len(r[1]) < 5000] + [(900 + i, "x y z " * 300, "hot") for i in range(40)]
    settings = dict(block_words=16, shard_words=2000)
    plan = mixing.mix_plan(table(spark, rows), **settings).collect()
    sizes = Counter()
    for d, t, s in rows:
        sizes[s] += len(words(t))
    want = mix_targets(dict(sizes), (5, 2, 1))
    assert Counter((r.doc_id, r.source, r["size"]) for r in plan) == Counter((d, s, len(words(t))) for d, t, s in rows)
    taken = Counter()
    for r in plan:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * (1 + r.target)
        assert 0 <= r.taken <= 3 * r["size"]
        assert r.taken == r.passes * r["size"] + sum(s["to"] - s["from"] for s in r.spans)
        taken[r.source] += r.taken
    for s in sizes:  # a block per shard of slack at most
        assert abs(taken[s] - want[s]) <= 16 * (2 + sizes[s] // 2000 + 1)
    again = mixing.mix_plan(table(spark, rows[::-1]), **settings).collect()
    assert sorted(map(str, plan)) == sorted(map(str, again))

    mixed = mixing.mixed_documents(table(spark, rows), **settings)
    assert mixed.columns == table(spark, rows).columns
    out = mixed.collect()
    assert sum(len(words(r.text)) for r in out) == sum(r.taken for r in plan)
    by_id = {(d, s): words(t) for d, t, s in rows if t and d is not None and d >= 900}
    for r in out:
        assert r.n_chars == len(r.text) and r._doc == "f"
        if r.doc_id is not None and r.doc_id >= 900:
            assert not Counter(words(r.text)) - Counter(by_id[r.doc_id, r.source])


def test_mixing_an_empty_table(spark):
    assert mixing.mix_plan(table(spark, [])).count() == 0 and mixing.mixed_documents(table(spark, [])).count() == 0


def best_fit(lengths, capacity, max_docs, max_cost):
    """Vector best-fit one piece at a time, longest first."""
    bins = []
    for m in sorted(lengths, reverse=True):
        fits = [
            (((b[0] - m) / capacity) ** 2 + ((b[1] - 1) / max_docs) ** 2 + ((b[2] - m * m) / max_cost) ** 2, i)
            for i, b in enumerate(bins) if b[0] >= m and b[1] >= 1 and b[2] >= m * m
        ]
        if fits:
            b = bins[min(fits)[1]]
            b[0], b[1], b[2] = b[0] - m, b[1] - 1, b[2] - m * m
        else:
            bins.append([capacity - m, max_docs - 1, max_cost - m * m])
    return Counter(map(tuple, bins))


@pytest.mark.parametrize("seed", range(30))
@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_the_plan_on_lengths_is_best_fit_piece_by_piece(seed, rule):
    rng = random.Random(seed)
    capacity, max_docs = rng.choice([16, 64, 100]), rng.choice([3, 100])
    max_cost = rng.choice([capacity**2, capacity**2 + 50])
    counts = Counter(rng.randint(1, capacity) for _ in range(rng.randint(0, 200)))
    bins, placed = {}, Counter()
    for m, a, b, per, seq, offset in packing.plan_bins(counts, capacity, max_docs, max_cost, rule=rule).tolist():
        for i in range(b - a):
            bins.setdefault(seq + i // per, []).append((offset + i % per * m, m))
            placed[m] += 1
    assert placed == counts
    left = Counter()
    for pieces in bins.values():
        at = 0
        for start, m in sorted(pieces):
            assert start == at
            at += m
        left[capacity - at, max_docs - len(pieces), max_cost - sum(m * m for _, m in pieces)] += 1
    assert all(min(b) >= 0 for b in left)
    if rule == "norm":
        assert left == best_fit(counts.elements(), capacity, max_docs, max_cost)


@pytest.mark.parametrize("seed", range(10))
def test_a_cost_limit_below_the_square_of_the_capacity_binds(seed):
    rng = random.Random(seed)
    capacity, max_docs, max_cost = 100, 100, 2500
    counts = Counter(rng.randint(1, 50) for _ in range(200))
    bins = {}
    for m, a, b, per, seq, _ in packing.plan_bins(counts, capacity, max_docs, max_cost).tolist():
        for i in range(b - a):
            bins.setdefault(seq + i // per, []).append(m)
    assert Counter(m for v in bins.values() for m in v) == counts
    left = Counter((capacity - sum(v), max_docs - len(v), max_cost - sum(m * m for m in v)) for v in bins.values())
    assert left == best_fit(counts.elements(), capacity, max_docs, max_cost)
    assert all(min(b) >= 0 for b in left)
    # the limit binds
    assert len(bins) > sum(best_fit(counts.elements(), capacity, max_docs, capacity**2).values())


def test_packing_holds_a_cost_limit(spark):
    rows = [(i, 0, 0, 5 + i % 40) for i in range(300)]
    placed = packing.pack_pieces(spark.createDataFrame(rows, "doc_id bigint, piece int, start bigint, length bigint"), capacity=100, max_docs=8, max_cost=2500)
    costs = [r.cost for r in placed.groupBy("sequence_id").agg(F.sum(F.col("length") ** 2).alias("cost")).collect()]
    assert sum(costs) == sum(m * m for *_, m in rows) and max(costs) <= 2500


def vocabulary():
    P = pytest.importorskip("public_tokenizers")
    return P.path("byte_bpe_50k.tiktoken"), P.PATTERN


def reference_ids(text):
    from tokenizers import Tokenizer

    P = pytest.importorskip("public_tokenizers")
    return Tokenizer.from_file(P.path("byte_bpe_50k.json")).encode(text or "", add_special_tokens=False).ids + [0]


def test_pieces_and_sequences_round_trip(spark):
    rows = texts(5, 40) + [(500, "<|endoftext|> inside <|endoftext|>", "a"), (501, "Zwölf  Größen\r\n\n 'tis don't  ", "b"), (502, "😀é x" * 300, "c")]
    rows = [r for r in rows if r[1] is None or len(r[1]) < 60_000]
    pieces = packing.token_pieces(table(spark, rows), *vocabulary())
    placed = packing.pack_pieces(pieces.withColumn("offset", F.lit("old")).withColumn("_row", F.lit(1)))
    got = placed.collect()
    assert placed.columns == ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"]
    ids = Counter()
    for d, t, _ in rows:
        own = reference_ids(t)
        first = min(len(own), len(own) % 2048 or 2048)
        for k, (a, b) in enumerate([(0, first)] + [(x, x + 2048) for x in range(first, len(own), 2048)]):
            ids[d, k, a, b - a, struct.pack(f"<{b - a}I", *own[a:b])] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, bytes(r.ids)) for r in got) == ids
    assert placed.select(F.crc32("ids").alias("c"), "ids").first()["c"] == zlib.crc32(bytes(placed.first().ids))
    sequences = packing.packed_sequences(table(spark, rows), *vocabulary()).collect()
    assert len(sequences) == len({r.sequence_id for r in got})
    assert len(sequences) <= -(-sum(r.length for r in got) // 2048) + 1
    by_seq = {}
    for r in got:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by_seq.values():
        spans.sort()
        assert [o for o, _ in spans] == [sum(m for _, m in spans[:i]) for i in range(len(spans))]
        assert sum(m for _, m in spans) <= 2048
    assert sum(s.n_tokens for s in sequences) == sum(r.length for r in got)
    assert Counter(len(s.ids) // 4 for s in sequences) == Counter(sum(m for _, m in v) for v in by_seq.values())


def test_long_runs_of_white_space_are_tokenised_whole(spark):
    long = {1: " " * 2_000_000, 2: "a <|endoftext|>" + "\n" * 1_500_000 + "b's", 3: "short"}
    got = packing.token_pieces(table(spark, [(d, t, "a") for d, t in long.items()]), *vocabulary()).collect()
    for d, t in long.items():
        made = b"".join(bytes(r.ids) for r in sorted((r for r in got if r.doc_id == d), key=lambda r: r.piece))
        own = reference_ids(t)
        assert made == struct.pack(f"<{len(own)}I", *own)


def test_packing_an_empty_table(spark):
    pieces = packing.token_pieces(table(spark, []), *vocabulary())
    assert packing.pack_pieces(pieces).count() == 0


def test_long_texts_take_linear_work(spark):
    """Tens of thousands of removed runs, or of mixed blocks, in one text: minutes to hours when each of them scans the text anew."""
    import time

    runs = 24_000
    cut = ["\n".join(f"same {k} {j}" if j < 3 else f"own {i} {k}" for k in range(runs) for j in range(4)) for i in range(2)]
    began = time.monotonic()
    got = {r.doc_id: r for r in dedup_lines(table(spark, [(i, t, "a") for i, t in enumerate(cut)])).collect()}
    assert (got[0].n_removed, got[1].n_removed) == (0, 3 * runs) and got[1].text == "\n".join(f"own 1 {k}" for k in range(runs))
    long = [(i, " ".join(f"w{i}x{k}" for k in range(300_000)), s) for i, s in enumerate("ab")]
    mixed = mixing.mixed_documents(table(spark, long)).select("doc_id", "text").collect()
    plan = {r.doc_id: r.taken for r in mixing.mix_plan(table(spark, long)).select("doc_id", "taken").collect()}
    for d, _, _ in long:
        assert sum(len(r.text.split()) for r in mixed if r.doc_id == d) == plan[d]
    assert time.monotonic() - began < 120
