"""Exact n-gram Jaccard join by vertical partitioning.

A document is the set of its distinct k-word shingles, as 64-bit hashes.  A count
of all shingles of all documents, hashed into ``2^18`` buckets, gives the global
order: rare buckets first.  A shingle's place in that order is one 64-bit number
(bucket rank, then the rest of its hash), so a document is a sorted array of
places, and the order is cut by pivots of equal mass into ``FRAGMENTS`` fragments.

1. Documents with equal sets are one class (a 128-bit digest of the set).
   From here on a class is one row, however many copies it has.
2. Candidates: two sets that reach the threshold t share one of the first
   ``n - ceil(t n) + 1`` places of each (prefix principle; any global order will do,
   a frequency order makes it selective: a passage that many documents share comes last).
   Only prefixes are shuffled, about ``1 - t`` of the shingles.
3. Overlaps: each document of a candidate pair is cut at the pivots; pairs meet
   fragment by fragment, each fragment counts its partial overlap alone, and
   the parts are summed per pair and compared exactly in integers.
4. The classes' links are followed to components.  To emit no quadratic number
   of pairs in a large group of near copies, each prefix place first joins its
   documents with three leaders of its own (chosen by hash).  Only documents
   that share a place and still lie in different components after that are compared with each other, all of
   them, so that no link between components is lost.

Defined results: texts null or without words have the empty set, link with
nothing and are their own component; fewer than k words give one shingle, the
whole sequence; repeated rows are copies; rows with a null doc_id are counted,
but give no component an id (a component of such rows alone has null); an empty
table gives no rows.  Hashes are 64 bits wide and taken as the shingles.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, text_hash
from .components import components
from .hashing import MULTIPLY, groups, mix, words_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["near_duplicates", "keep_one", "shingle_hashes", "shingle_sets", "Order"]

BUCKET_BITS = 18
FRAGMENTS = 8
_REST = np.uint64(64 - BUCKET_BITS)
_CHUNK = 4096  # counters per row of a task's partial count


def shingle_hashes(texts: list, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): text i's k-word shingles, in order with repeats, are ``hashes[bounds[i]:bounds[i + 1]]``.

    A-Z are folded.  Fewer than k words make one shingle, the whole sequence."""
    w, owner, n_words, _ = words_of(texts, lower=True)
    counts = np.where(n_words >= k, n_words - k + 1, np.minimum(n_words, 1))
    bounds = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(bounds[-1], np.uint64)
    long = np.repeat(n_words >= k, counts)
    if len(w) >= k:
        h = np.full(len(w) - k + 1, k, np.uint64)
        for i in range(k):
            h = h * MULTIPLY + w[i : len(w) - k + 1 + i]
        out[long] = h[owner[: len(owner) - k + 1] == owner[k - 1 :]]
    firsts = np.concatenate([[0], np.cumsum(n_words)])
    for i in np.flatnonzero((n_words > 0) & (n_words < k)):
        h = n_words[i : i + 1].astype(np.uint64)
        for j in range(firsts[i], firsts[i + 1]):
            h = h * MULTIPLY + w[j : j + 1]
        out[bounds[i]] = h[0]
    return mix(out), bounds


class Order(NamedTuple):
    """The global order: each bucket's rank by ascending count, and the pivots that cut it."""

    rank: np.ndarray
    pivots: np.ndarray


def order_of(counts: np.ndarray, fragments: int = FRAGMENTS) -> Order:
    by_count = np.argsort(counts, kind="stable")
    rank = np.empty(len(counts), np.uint64)
    rank[by_count] = np.arange(len(counts), dtype=np.uint64)
    mass = np.cumsum(counts[by_count])
    shares = np.arange(1, fragments)
    cuts = np.searchsorted(mass, mass[-1] * shares / fragments) if mass[-1] else shares
    return Order(rank, np.unique(cuts).astype(np.uint64) << _REST)


def shingle_sets(texts: list, k: int, order: Order) -> list[np.ndarray]:
    """The set of each text, as sorted places."""
    hashes, bounds = shingle_hashes(texts, k)
    bucket = (hashes & np.uint64((1 << BUCKET_BITS) - 1)).astype(np.int64)
    places = (order.rank[bucket] << _REST) | (hashes >> np.uint64(BUCKET_BITS))
    return [_distinct(places[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    new = x[1:] != x[:-1]
    return x if new.all() else np.concatenate([x[:1], x[1:][new]])


def digest(places: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums over the set, as signed numbers."""
    one = mix(places + np.uint64(0x8CB92BA72F3D8DD7)).sum(dtype=np.uint64)
    two = mix(mix(places ^ np.uint64(0xA24BAED4963EE407))).sum(dtype=np.uint64)
    return int(one.astype(np.int64)), int(two.astype(np.int64))


def _count_task(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, mask = np.zeros(1 << BUCKET_BITS, np.int64), np.uint64((1 << BUCKET_BITS) - 1)
        for _, _, texts in groups(batches):
            counts += np.bincount((shingle_hashes(texts, k)[0] & mask).astype(np.int64), minlength=len(counts))
        chunks = range(0, len(counts), _CHUNK)
        yield pa.RecordBatch.from_pydict({
            "chunk": pa.array([c // _CHUNK for c in chunks], pa.int32()),
            "counts": pa.array([counts[c : c + _CHUNK].tobytes() for c in chunks], pa.binary()),
        })

    return run


def _add_counts(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(_CHUNK, np.int64)
    for raw in pdf["counts"]:
        total += np.frombuffer(raw, np.int64)
    return pd.DataFrame({"chunk": pdf["chunk"].iloc[:1], "counts": [total.tobytes()]})


def global_order(docs: DataFrame, k: int) -> Order:
    """Counts every shingle of every document into 2^18 counters (2 MB a task, whatever the input)."""
    parts = docs.select("text").mapInArrow(_count_task(k), "chunk int, counts binary")
    rows = parts.groupBy("chunk").applyInPandas(_add_counts, "chunk int, counts binary").collect()  # 2 MB in all
    counts = np.zeros(1 << BUCKET_BITS, np.int64)
    for row in rows:
        counts[row["chunk"] * _CHUNK : (row["chunk"] + 1) * _CHUNK] = np.frombuffer(row["counts"], np.int64)
    return order_of(counts)


def _long_lists(parts: list) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
    values = np.concatenate(parts).view(np.int64) if parts else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int64()))


def _prefix_task(k: int, top: int, whole: int, order):
    def run(batches):
        ranks = Order(*order.value)
        for batch, first, texts in groups(batches):
            sets = shingle_sets(texts, k, ranks)
            sizes = [len(x) for x in sets]
            marks = [digest(x) if n else (None, None) for x, n in zip(sets, sizes)]
            part = batch.slice(first, len(texts))
            yield pa.RecordBatch.from_pydict({
                "doc_id": part.column("doc_id"), "text_hash": part.column("text_hash"), "n": pa.array(sizes, pa.int64()),
                "node": pa.array([m[0] for m in marks], pa.int64()), "node2": pa.array([m[1] for m in marks], pa.int64()),
                "prefix": _long_lists([x[: n - (-(-top * n // whole)) + 1] if n else x for x, n in zip(sets, sizes)]),
            })

    return run


_BLOOM_SEEDS = (1, 2, 3)


def _bloom_task(bits: int):
    """Task bit maps over node ids, as chunks."""

    def run(batches):
        seen = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            _bloom_add(seen, batch.column("node").to_numpy(zero_copy_only=False).view(np.uint64))
        size = 1 << 16
        used = [c for c in range(0, len(seen), size) if seen[c : c + size].any()]
        yield pa.RecordBatch.from_pydict({
            "chunk": pa.array([c // size for c in used], pa.int32()),
            "bits": pa.array([seen[c : c + size].tobytes() for c in used], pa.binary()),
        })

    return run


def _bloom_slots(bits: int, nodes: np.ndarray):
    for s in _BLOOM_SEEDS:
        yield mix(nodes + np.uint64(s * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) % np.uint64(bits)


def _bloom_add(seen: np.ndarray, nodes: np.ndarray) -> None:
    for slot in _bloom_slots(len(seen) * 8, nodes):
        np.bitwise_or.at(seen, (slot >> np.uint64(3)).astype(np.int64), np.uint8(1) << (slot & np.uint64(7)).astype(np.uint8))


def _bloom_has(seen: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    out = np.ones(len(nodes), bool)
    for slot in _bloom_slots(len(seen) * 8, nodes):
        out &= (seen[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    return out


def _or_bits(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(1 << 16, np.uint8)
    for raw in pdf["bits"]:
        total[: len(raw)] |= np.frombuffer(raw, np.uint8)
    return pd.DataFrame({"chunk": pdf["chunk"].iloc[:1], "bits": [total.tobytes()]})


def _node_filter(nodes: DataFrame):
    """A Bloom filter over the keys in ``node``, broadcast: 16 bits a key, 2^20 at least and 2^30 (128 MB) at most.

    It only spares the segments of documents in no pair from being written;
    where it lets others through, the joins drop them."""
    bits = 1 << min(30, max(20, (16 * nodes.count()).bit_length()))
    parts = nodes.mapInArrow(_bloom_task(bits), "chunk int, bits binary")
    seen = np.zeros(bits // 8, np.uint8)
    for row in parts.groupBy("chunk").applyInPandas(_or_bits, "chunk int, bits binary").collect():
        seen[row["chunk"] << 16 : (row["chunk"] + 1) << 16] = np.frombuffer(row["bits"], np.uint8)
    return nodes.sparkSession.sparkContext.broadcast(seen)


def _select_task(wanted):
    def run(batches):
        for batch in batches:
            nodes = batch.column("node").to_numpy(zero_copy_only=False).view(np.uint64)
            yield batch.filter(pa.array(_bloom_has(wanted.value, nodes)))

    return run


def _segment_task(k: int, order, wanted):
    def run(batches):
        ranks, seen, done = Order(*order.value), wanted.value, set()
        for batch, first, texts in groups(batches):
            keys = batch.column("node").slice(first, len(texts)).to_numpy(zero_copy_only=False).view(np.uint64)
            node, n, frag, seg = [], [], [], []
            for places in shingle_sets([texts[i] for i in np.flatnonzero(_bloom_has(seen, keys))], k, ranks):
                if not len(places) or (own := digest(places)[0]) in done:
                    continue
                if len(done) < 1_000_000:
                    done.add(own)
                cuts = [0, *np.searchsorted(places, ranks.pivots).tolist(), len(places)]
                for f, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                    if a < b:
                        node.append(own), n.append(len(places)), frag.append(f), seg.append(places[a:b])
            yield pa.RecordBatch.from_pydict({
                "node": pa.array(node, pa.int64()), "n": pa.array(n, pa.int64()), "frag": pa.array(frag, pa.int32()), "seg": _long_lists(seg),
            })

    return run


def _segments(docs: DataFrame, k: int, order, representatives: DataFrame) -> DataFrame:
    """``node, n, frag, seg``: rows per class and fragment, from the row of ``docs`` that represents the class.

    ``representatives[node]`` holds row keys; rows that repeat a key, or slip through the filter, give a
    class's segment more than once."""
    rows = docs.select("text", _row_key().alias("node"))
    return rows.mapInArrow(_segment_task(k, order, _node_filter(representatives)), "node bigint, n bigint, frag int, seg array<bigint>")


def _row_key():
    return F.xxhash64("doc_id", "text_hash")


def _linked(pairs: DataFrame, segments: DataFrame, top: int, whole: int, scratch: Scratch, name: str) -> DataFrame:
    """The pairs ``a, b`` that reach the threshold: partial overlaps per fragment, summed per pair.

    The leader of a large group is a hot key of these joins.  The partial overlaps are written before they are summed, so
    that no aggregate relies on how the join is dealt out and adaptive execution may split the leader's pairs."""
    left = segments.select(F.col("node").alias("a"), F.col("n").alias("n_a"), "frag", F.col("seg").alias("seg_a"))
    right = segments.select(F.col("node").alias("_b"), F.col("n").alias("n_b"), F.col("frag").alias("_f"), F.col("seg").alias("seg_b"))
    # the same joins at every size: a few pairs more would turn a broadcast into a shuffle anyway
    met = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), (F.col("b") == F.col("_b")) & (F.col("frag") == F.col("_f")))
    met = met.filter(whole * F.least("n_a", "n_b") >= top * F.greatest("n_a", "n_b"))
    parts = met.select("a", "b", "n_a", "n_b", "frag", F.size(F.array_intersect("seg_a", "seg_b")).cast("bigint").alias("part"))
    parts = scratch.save(parts, name)
    parts = parts.groupBy("a", "b", "n_a", "n_b", "frag").agg(F.max("part").alias("part"))  # a segment may be there twice
    sums = parts.groupBy("a", "b", "n_a", "n_b").agg(F.sum("part").alias("shared"))
    return sums.filter(whole * F.col("shared") >= top * (F.col("n_a") + F.col("n_b") - F.col("shared"))).select("a", "b")


def _verified(docs, k, order, classes, pairs, top, whole, scratch, label) -> DataFrame:
    """The linked ones of ``pairs``.

    First their prefixes are counted against each other: besides the places that both hold, only those behind
    the prefix that ends first can be shared.  The documents that represent the classes of what is left are
    cut into segments."""
    nodes = pairs.select(F.col("a").alias("_n")).unionByName(pairs.select(F.col("b").alias("_n"))).distinct()
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema.fields)
    likely = classes.mapInArrow(_select_task(_node_filter(nodes.withColumnRenamed("_n", "node"))), schema)
    known = scratch.save(likely.join(nodes.hint("merge"), F.col("node") == F.col("_n")).drop("_n"), f"known-{label}")
    sides = [known.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("prefix").alias(f"p_{c}")) for c in ("a", "b")]
    met = pairs.join(sides[0].hint("merge"), "a").join(sides[1].hint("merge"), "b")
    most = F.size(F.array_intersect("p_a", "p_b")) + F.greatest(F.col("n_a") - F.size("p_a"), F.col("n_b") - F.size("p_b"))
    close = scratch.save(met.filter((whole + top) * most >= top * (F.col("n_a") + F.col("n_b"))).select("a", "b"), f"close-{label}")
    nodes = close.select(F.col("a").alias("_n")).unionByName(close.select(F.col("b").alias("_n"))).distinct()
    keys = known.select("node", "key").join(nodes, F.col("node") == F.col("_n")).select(F.col("key").alias("node"))
    segments = scratch.save(_segments(docs, k, order, keys), f"segments-{label}")
    return _linked(close, segments, top, whole, scratch, f"parts-{label}")


def near_duplicates(docs: DataFrame, *, k: int = 4, threshold: tuple[int, int] = (85, 100)) -> DataFrame:
    """``doc_id, n_shingles BIGINT, component_id, text_hash BIGINT``: one row per row of ``docs[doc_id, text]``.

    ``threshold`` (p, q): two documents link when ``q * |A & B| >= p * |A | B|``.
    ``component_id`` is the smallest doc_id that links lead to.
    """
    return _near(docs, k, threshold).drop("root")


def _near(docs: DataFrame, k: int = 4, threshold: tuple[int, int] = (85, 100)) -> DataFrame:
    """The columns of ``near_duplicates`` and ``root BIGINT``, which tells components under one id apart
    (null for documents without shingles, each a component of its own)."""
    top, whole = threshold
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram")
    docs = docs.select("doc_id", "text", text_hash(F.col("text")).alias("text_hash"))
    order = spark.sparkContext.broadcast(tuple(global_order(docs, k)))  # fixed size: 2^18 ranks
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = scratch.save(
        docs.mapInArrow(_prefix_task(k, top, whole, order), f"doc_id {id_type}, text_hash bigint, n bigint, node bigint, node2 bigint, prefix array<bigint>"),
        "prefixes",
    )
    # one row per class; then the prefix places that two classes or more share
    classes = rows.filter("n > 0").groupBy("node").agg(
        F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.min(_row_key()).alias("key")
    )
    classes = scratch.save(classes, "classes")
    shared = classes.select(F.explode("prefix").alias("_p")).groupBy("_p").agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1").select("_p")
    placed = classes.select("node", "n", F.posexplode("prefix").alias("pos", "place"))
    meeting = scratch.save(placed.join(shared, F.col("place") == F.col("_p")).drop("_p"), "meeting")

    def may_link(x: DataFrame, y: DataFrame, also=F.lit(True)) -> DataFrame:
        """Pairs ``a, b`` of documents that share a prefix place and leave room for the threshold.

        At the first place that a linked pair shares, at most n - pos places can still agree."""
        room = F.least(F.col("n_x") - F.col("pos_x"), F.col("n_y") - F.col("pos_y"))
        met = x.join(
            y,
            (F.col("place") == F.col("_p")) & also & (F.col("node_x") != F.col("node_y"))
            & (whole * F.least("n_x", "n_y") >= top * F.greatest("n_x", "n_y"))
            & ((whole + top) * room >= top * (F.col("n_x") + F.col("n_y"))),
        )
        return met.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct()

    def renamed(df: DataFrame, side: str, names=("node", "n", "pos"), key: str = "place") -> DataFrame:
        return df.select(F.col("place").alias(key), *[F.col(c).alias(f"{c}_{side}") for c in names])

    # leaders: the document with the fewest rarer places of its own is the likeliest centre of a group; two more by
    # a hash of the document alone, so that the many places which a group shares name the same few
    keys = [F.struct("pos", F.xxhash64("node")), F.struct(F.xxhash64("node", F.lit(1))), F.struct(F.xxhash64("node", F.lit(2)))]
    chosen = meeting.groupBy("place").agg(*[F.min_by(F.struct("node", "n", "pos"), key).alias(f"l{i}") for i, key in enumerate(keys)])
    chosen = chosen.select("place", F.explode(F.array_distinct(F.array("l0", "l1", "l2"))).alias("l")).select("place", "l.*")
    pairs = scratch.save(may_link(renamed(meeting, "x"), renamed(chosen, "y", key="_p")), "pairs")
    links = scratch.save(_verified(docs, k, order, classes, pairs, top, whole, scratch, "first"), "links")
    scratch.drop("known-first", "close-first", "segments-first", "parts-first")
    roots = components(links, scratch, "first")

    # what leaders left apart: documents that share a place in different components
    marked = meeting.join(roots, "node", "left").select("place", "node", "n", "pos", F.coalesce("root", "node").alias("root"))
    marked = scratch.save(marked, "marked")
    split = marked.groupBy("place").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi")).filter("_lo <> _hi").select("place")
    apart, names = marked.join(split, "place"), ("node", "n", "pos", "root")
    across = may_link(renamed(apart, "x", names), renamed(apart, "y", names, "_p"), F.col("root_x") < F.col("root_y"))
    rest = scratch.save(across.join(pairs, ["a", "b"], "left_anti"), "rest")
    late = scratch.save(_verified(docs, k, order, classes, rest, top, whole, scratch, "second"), "late")
    scratch.drop("classes", "meeting", "marked", "pairs", "rest", "known-second", "close-second", "segments-second", "parts-second")
    final = components(links.unionByName(late), scratch, "final")

    # the smallest doc_id per class, then per component
    firsts = rows.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("_least"))
    named = firsts.join(final.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left")
    named = named.select("node", "_least", F.coalesce("root", "node").alias("_root"))
    least = named.groupBy("_root").agg(F.min("_least").alias("component")).withColumnRenamed("_root", "_r")
    named = named.join(least, F.col("_root") == F.col("_r")).select(F.col("node").alias("_node"), "component", "_root")
    out = rows.select("doc_id", "text_hash", "n", "node").join(named, F.col("node") == F.col("_node"), "left")
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"), "text_hash",
        F.when(F.col("n") > 0, F.col("_root")).alias("root"),
    )


def keep_one(docs: DataFrame, **settings) -> DataFrame:
    """``docs``, all columns, with one document of each component: the one whose doc_id names it.

    Of rows that repeat its id and text one stays, of different texts under that
    id in one component the one with the smallest hash; texts of different components
    stay each, also under one id.  Rows with a null doc_id stay."""
    near = _near(docs, **settings).filter(F.col("doc_id") == F.col("component_id"))
    alone = F.when(F.col("root").isNull(), F.col("text_hash"))  # no shingles: a text is its own component
    chosen = near.groupBy(F.col("doc_id").alias("_id"), "root", alone.alias("_alone")).agg(F.min("text_hash").alias("_hash"))
    chosen = chosen.select("_id", "_hash")
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_doc"))
    rows = rows.withColumn("_key", F.col("_doc.doc_id")).withColumn("_th", text_hash(F.col("_doc.text")))
    met = rows.join(chosen.hint("merge"), (F.col("_key") == F.col("_id")) & (F.col("_th") == F.col("_hash")))
    first = Window.partitionBy("_key", "_th").orderBy(F.lit(0))
    met = met.withColumn("_row", F.row_number().over(first)).filter("_row = 1").select("_doc.*")
    return met.unionByName(docs.filter(F.col("doc_id").isNull()))
