"""Vector best-fit packing of token pieces into sequences.

A document's token ids, closed by an end id, are cut into pieces of at most
``capacity`` tokens (only the first piece may be shorter).  A piece asks for a
vector of resources - tokens, one document, attention cost (length squared) - and a
sequence offers a capacity of each.  Pieces are placed longest first; among the
sequences with room in every dimension, ``rule`` picks the one whose residual after
placing has the smallest weighted norm (``norm``, the default), or the one
whose residual has the smallest weighted dot product with the demand (``dot``); with
no room anywhere a new sequence opens.

A piece's demand is a function of its length, so pieces of one length are alike,
and sequences in the same state are alike.  The plan is therefore made on the
histogram of lengths (``capacity`` rows at most, whatever the input): equal pieces
fill runs of equal sequences at once, which gives the very placement that
taking the pieces one by one would.  What the plan holds is ranges - pieces
``from..to`` of a length go to the sequences from ``seq`` on, ``per`` in each, at ``offset`` -
whose number is bounded by the capacity too; it is broadcast, and each piece finds
its place from its rank among the pieces of its length.  Ranks come from counts per
(length, hash bucket), so a hot length is spread over ``rank_buckets`` tasks.

Only rows of numbers are shuffled; the token ids stay where they were made, and
``packed_sequences`` brings them together when the sequences themselves are wanted.

Defined results: a null text is empty and yields the end id alone; an empty table
gives no rows; rows repeated with equal doc_id are packed each for itself; extra
columns are left out; texts of any length are tokenised whole, those ``tiktoken``
refuses by ``tokenizers`` and the JSON file beside the rank file.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["token_pieces", "plan_bins", "pack_pieces", "packed_sequences"]

END_OF_TEXT = "<|endoftext|>"
_ENCODERS: dict = {}


def _encoder(vocabulary: str, pattern: str):
    """A byte-level BPE encoder for a public vocabulary file (ranks, one per line).

    ``<|endoftext|>`` inside a text is the special id after the ranks, as the JSON form of the same vocabulary has it."""
    if (vocabulary, pattern) not in _ENCODERS:
        import base64

        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        own = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={END_OF_TEXT: len(ranks)})
        _ENCODERS[vocabulary, pattern] = own
    return _ENCODERS[vocabulary, pattern]


def _whole_encoder(vocabulary: str):
    """The same vocabulary by ``tokenizers``, from the JSON file beside the rank file; it splits texts of any length."""
    if vocabulary not in _ENCODERS:
        import os

        from tokenizers import Tokenizer

        _ENCODERS[vocabulary] = Tokenizer.from_file(os.path.splitext(vocabulary)[0] + ".json")
    return _ENCODERS[vocabulary]


def encode_text(text: str, vocabulary: str, pattern: str) -> list[int]:
    """Ids of a whole text.

    The split pattern backtracks over a run of white space, and ``tiktoken`` refuses runs of about
    a million characters; such a text goes to ``tokenizers``, which gives the same ids."""
    try:
        return _encoder(vocabulary, pattern).encode(text, allowed_special="all")
    except ValueError:
        return _whole_encoder(vocabulary).encode(text, add_special_tokens=False).ids


def piece_bounds(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: full pieces at the end, the rest first."""
    first = n % capacity or capacity
    first = min(first, n)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def _piece_task(vocabulary: str, pattern: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, piece, start, length, ids = [], [], [], [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                own = np.array([*encode_text(text, vocabulary, pattern), end_id] if text else [end_id], "<u4")
                for k, (s, m) in enumerate(piece_bounds(len(own), capacity)):
                    at.append(row), piece.append(k), start.append(s), length.append(m)
                    ids.append(own[s : s + m].tobytes())
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id").take(pa.array(at, pa.int64())),
                "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()),
                "length": pa.array(length, pa.int64()), "ids": pa.array(ids, pa.binary()),
            })

    return run


def token_pieces(docs: DataFrame, vocabulary: str, pattern: str, *, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """``doc_id, piece INT, start BIGINT, length BIGINT, ids BINARY`` (little-endian unsigned 32-bit ids)."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        _piece_task(vocabulary, pattern, end_id, capacity),
        f"doc_id {id_type}, piece int, start bigint, length bigint, ids binary",
    )


def plan_bins(
    counts: dict[int, int], capacity: int, max_docs: int, max_cost: int, weights=(1.0, 1.0, 1.0), rule: str = "norm"
) -> np.ndarray:
    """Ranges ``(length, from, to, per, seq, offset)`` that place ``counts[length]`` pieces of each length.

    State: runs of consecutive sequences with equal residuals.  A piece length
    tries the fitting states in the order of the rule, as vector best-fit does
    for each piece; a sequence that took one piece stays the best fit for
    the next of the same length until it has no room, so each run takes
    ``per`` pieces in every sequence before the next state is tried.
    """
    scale = (weights[0] / capacity, weights[1] / max_docs, weights[2] / max_cost)
    states: dict[tuple[int, int, int], list[list[int]]] = {}  # residual (tokens, docs, cost) -> [[first seq, how many, offset]]
    plan, opened = [], 0

    def fit(room, m):
        return min(room[0] // m, room[1], room[2] // (m * m))

    def badness(room, m):
        if rule == "dot":
            return sum(r * d * s * s for r, d, s in zip(room, (m, 1, m * m), scale))
        return sum(((r - d) * s) ** 2 for r, d, s in zip(room, (m, 1, m * m), scale))

    whole = (capacity, max_docs, max_cost)
    for m in sorted(counts, reverse=True):
        left, rank = counts[m], 0
        if fit(whole, m) < 1:
            raise ValueError(f"a piece of {m} tokens exceeds an empty sequence")
        fitting = sorted((s for s in states if fit(s, m) >= 1), key=lambda s: (badness(s, m), s))
        for room in [*fitting, whole]:
            per = fit(room, m)
            runs = states.pop(room, []) if room != whole else [[opened, -(-left // per), 0]]
            if room == whole:
                opened += runs[0][1] if left else 0
            stay = []
            for seq, n, offset in runs:
                full = min(n, left // per)
                if full:
                    plan.append((m, rank, rank + full * per, per, seq, offset))
                    key = (room[0] - per * m, room[1] - per, room[2] - per * m * m)
                    states.setdefault(key, []).append([seq, full, offset + per * m])
                    rank, left, seq, n = rank + full * per, left - full * per, seq + full, n - full
                if n and left:  # the last pieces of this length, fewer than a sequence takes
                    plan.append((m, rank, rank + left, left, seq, offset))
                    key = (room[0] - left * m, room[1] - left, room[2] - left * m * m)
                    states.setdefault(key, []).append([seq, 1, offset + left * m])
                    rank, left, seq, n = rank + left, 0, seq + 1, n - 1
                if n:
                    stay.append([seq, n, offset])
            if stay and room != whole:
                states.setdefault(room, []).extend(stay)
            if not left:
                break
    return np.array(plan, np.int64).reshape(-1, 6)


def _place_task(plan):
    def run(batches):
        rows = plan.value
        table = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        length_of, from_of = table[:, 0], table[:, 1]
        starts = {int(m): (int(np.searchsorted(length_of, m)), int(np.searchsorted(length_of, m, "right"))) for m in np.unique(length_of)}
        for pdf in batches:
            m, rank = pdf["length"].to_numpy(), pdf["rank"].to_numpy()
            at = np.empty(len(pdf), np.int64)
            for one in np.unique(m):
                a, b = starts[int(one)]
                mine = m == one
                at[mine] = a + np.searchsorted(from_of[a:b], rank[mine], "right") - 1
            hit = table[at] if len(pdf) else table[:0]
            past = rank - hit[:, 1]
            out = pdf.drop(columns=["rank"])
            out["sequence_id"] = hit[:, 4] + past // hit[:, 3]
            out["offset"] = hit[:, 5] + (past % hit[:, 3]) * m
            yield out

    return run


def pack_pieces(
    pieces: DataFrame,
    *,
    capacity: int = 2048,
    max_docs: int = 2048,
    max_cost: int = 2048 * 2048,
    weights=(1.0, 1.0, 1.0),
    rule: str = "norm",
    rank_buckets: int = 64,
) -> DataFrame:
    """``pieces[doc_id, piece, start, length, ...]`` plus ``sequence_id BIGINT, offset BIGINT``.

    Columns of these names, or of the helper columns', are replaced."""
    scratch = Scratch(pieces.sparkSession, "pack")
    pieces = pieces.drop("sequence_id", "offset", "rank", "_bucket", "_row", "_len", "_b", "_base")
    bucket = F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(rank_buckets))
    held = scratch.save(pieces.withColumn("_bucket", bucket), "pieces")
    sizes = scratch.save(held.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n")), "sizes")
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # capacity rows at most
    plan = pieces.sparkSession.sparkContext.broadcast(plan_bins(counts, capacity, max_docs, max_cost, weights, rule))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select(
        F.col("length").alias("_len"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0).cast("bigint")).alias("_base")
    )
    within = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "start", F.xxhash64(*pieces.columns))
    ranked = held.withColumn("_row", F.row_number().over(within) - 1)
    ranked = ranked.join(base, (F.col("length") == F.col("_len")) & (F.col("_bucket") == F.col("_b")))
    ranked = ranked.select(*pieces.columns, (F.col("_base") + F.col("_row")).alias("rank"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.mapInPandas(_place_task(plan), f"{schema}, sequence_id bigint, offset bigint")


def packed_sequences(docs: DataFrame, vocabulary: str, pattern: str, *, end_id: int = 0, capacity: int = 2048, **settings) -> DataFrame:
    """One row per sequence: ``sequence_id, n_tokens, doc_ids, starts, ids BINARY``, pieces in place order."""
    pieces = token_pieces(docs, vocabulary, pattern, end_id=end_id, capacity=capacity)
    placed = pack_pieces(pieces, capacity=capacity, **settings)
    rows = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "length", "ids")))  # capacity pieces at most
    grouped = placed.groupBy("sequence_id").agg(rows.alias("_p"))
    joined = F.aggregate("_p", F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["ids"]))
    return grouped.select(
        "sequence_id", (F.octet_length(joined) / 4).cast("bigint").alias("n_tokens"),
        F.transform("_p", lambda p: p["doc_id"]).alias("doc_ids"), F.transform("_p", lambda p: p["offset"]).alias("starts"), joined.alias("ids"),
    )
