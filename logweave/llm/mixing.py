"""Mixing sources to target weights by Sainte-Lague apportionment [native].

The mix is made of equal-token blocks.  Each source gets a target number of
words: its weight's share of the total, at most ``max_repeat`` times its own
size, what lies above being shared again by weight (water filling).  The total,
cut into blocks of ``block_words`` words, is apportioned by highest quotients:
block number j+1 of a source costs ``target / (2j + 1)``.  A source's documents
are dealt by hash into shards of about ``shard_words`` words, and the source's
quota is apportioned to its shards in the same way, giving one integer quota
per shard.  Within a shard, laid out as one stream of words in seeded order, a
quota of q blocks of n takes every block ``q div n`` times and ``q mod n``
blocks, chosen by a seeded permutation, once more.

Only rows of numbers cross a shuffle: (doc_id, source, size), cut out of the
text scan once.  A hot source is spread over its shards; the windows over
sources and shards see one row per source or shard.

Defined results: a null text has size 0; size-0 documents take 0 words; a null
source is a source of its own, last in the order; equal rows get the same
treatment up to their order, so the result is the same multiset in each run; an
empty table gives no rows.  A rounded-up quota is cut at ``max_repeat`` times the
shard's blocks, so no document is taken more often than that.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE, WORD, Scratch, word_count

__all__ = ["targets", "sainte_lague", "shard_quotas", "mix_plan", "mixed_documents"]

# The largest primes below 2^31.  Each is coprime to any smaller block
# count, so j -> (j * prime + offset) mod n permutes the n blocks of a shard.
PRIMES = [2147483647, 2147483629, 2147483587, 2147483579, 2147483563, 2147483549, 2147483543, 2147483497]


def targets(sources: DataFrame, weights: Sequence[float], max_repeat: int = 3) -> DataFrame:
    """``sources[source, source_size]`` plus ``target DOUBLE``.

    Weights repeat over the sources in code-point order, null last.  Sorted by
    size per weight, the sources that stop at their cap are a prefix, so the
    water level follows from running sums instead of a loop.
    """
    w = F.array(*[F.lit(float(x)) for x in weights])
    order = Window.orderBy(F.col("source").asc_nulls_last())  # one row per source
    ranked = sources.withColumn("_w", F.element_at(w, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("_cap", F.lit(float(max_repeat)) * F.col("source_size"))
    level = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    after = level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything).cast("double")
    share = (total - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(after)
    capped = ranked.withColumn("_level", share).withColumn("_full", F.col("_cap") <= F.col("_w") * F.col("_level"))
    water = F.max(F.when(~F.col("_full"), F.struct(-F.col("_cap") / F.col("_w"), F.col("_level")))).over(everything)
    return capped.withColumn("_water", water["_level"]).select(
        "source", "source_size",
        F.when(F.col("_full"), F.col("_cap")).otherwise(F.col("_w") * F.col("_water")).alias("target"),
    )


def sainte_lague(rows: DataFrame, group: Sequence[str], votes: str, seats: Column, ties: Sequence[Column]) -> DataFrame:
    """``rows`` plus ``quota BIGINT``: ``seats`` of each group by highest quotients votes / (2j + 1).

    The divisor that fills the seats lies within ``S / 2`` of the ideal one for S
    rows, so each row's quota lies within ``ideal * S / (2 * seats) + 1/2`` of its
    ideal share: only the quotients in between (about five per row in all) are
    ranked, however many seats there are.
    """
    everyone = Window.partitionBy(*group)
    base = rows.withColumn("_seats", seats).withColumn("_sum", F.sum(votes).over(everyone))
    base = base.withColumn("_n", F.count(F.lit(1)).over(everyone)).withColumn("_row", F.row_number().over(everyone.orderBy(*ties)))
    ideal = F.when((F.col("_sum") > 0) & (F.col("_seats") > 0), F.col("_seats") * F.col(votes) / F.col("_sum")).otherwise(0.0)
    base = base.withColumn("_ideal", ideal).withColumn(
        "_slack", F.when(F.col("_seats") > 0, F.col("_ideal") * F.col("_n") / (2.0 * F.col("_seats"))).otherwise(0.0)
    )
    base = base.withColumn("_lo", F.greatest(F.lit(0), F.ceil(F.col("_ideal") - F.col("_slack") - 0.5) - 1).cast("bigint"))
    base = base.withColumn("_hi", (F.floor(F.col("_ideal") + F.col("_slack") + 0.5) + 1).cast("bigint"))
    base = base.withColumn("_free", F.col("_seats") - F.sum("_lo").over(everyone))
    open_seats = base.select(
        "*", F.explode(F.sequence(F.col("_lo"), F.greatest(F.col("_hi"), F.col("_lo")))).alias("_j")
    )
    rank = F.row_number().over(everyone.orderBy((F.col(votes) / (2 * F.col("_j") + 1)).desc(), "_row", "_j"))
    won = open_seats.withColumn("_won", (rank <= F.col("_free")) & (F.col(votes) > 0))
    keep = [c for c in rows.columns]
    return won.groupBy(*keep, "_row", "_lo").agg(F.count_if("_won").alias("_more")).select(
        *keep, (F.col("_lo") + F.col("_more")).alias("quota")
    )


def shard_quotas(sizes: DataFrame, weights, max_repeat: int, block_words: int, shard_words: int, seed: int):
    """(documents with their shard, one row per shard with its quota) from ``sizes[doc_id, source, size]``."""
    sources = targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_repeat)
    seats = F.round(F.sum("target").over(Window.partitionBy(F.lit(0))) / block_words).cast("bigint")
    sources = sainte_lague(sources, [], "target", seats, [F.col("source").asc_nulls_last()])
    sources = sources.select(F.col("source").alias("_src"), "source_size", "target", F.col("quota").alias("_quota"))
    placed = sizes.join(sources, F.col("source").eqNullSafe(F.col("_src")))
    shards = F.greatest(F.ceil(F.col("source_size") / shard_words), F.lit(1))
    placed = placed.withColumn("_shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size"), shards)).drop("_src")
    by_shard = placed.groupBy("source", "source_size", "target", "_quota", "_shard").agg(F.sum("size").alias("_size"))
    quotas = sainte_lague(by_shard, ["source"], "_size", F.col("_quota"), [F.col("_shard")])
    blocks = F.ceil(F.col("_size") / block_words)
    quotas = quotas.withColumn("_blocks", blocks).withColumn("quota", F.least("quota", max_repeat * F.col("_blocks")))
    return placed.drop("_quota"), quotas.select(F.col("source").alias("_src"), F.col("_shard").alias("_sh"), "_blocks", "quota")


def _taken_spans(block_words: int, seed: int) -> Column:
    """Of a placed document: the (from, to) word ranges that the extra blocks take, in order."""
    n, start, end = F.col("_blocks"), F.col("_start"), F.col("_start") + F.col("size")
    prime = F.element_at(
        F.array(*[F.lit(p).cast("bigint") for p in PRIMES]),
        (F.pmod(F.xxhash64(F.lit(seed + 1), "source", "_shard"), F.lit(len(PRIMES))) + 1).cast("int"),
    )
    offset = F.pmod(F.xxhash64(F.lit(seed + 2), "source", "_shard"), n)
    blocks = F.sequence((start / block_words).cast("bigint"), ((end - 1) / block_words).cast("bigint"))
    chosen = F.filter(blocks, lambda j: F.pmod(j * prime + offset, n) < F.col("_extra"))
    spans = F.transform(
        chosen,
        lambda j: F.struct(
            (F.greatest(start, j * block_words) - start).alias("from"),
            (F.least(end, (j + 1) * block_words) - start).alias("to"),
        ),
    )
    empty = F.array().cast("array<struct<from:bigint,to:bigint>>")
    return F.when((F.col("size") > 0) & (F.col("_extra") > 0), spans).otherwise(empty)


def mix_plan(
    docs: DataFrame,
    *,
    weights: Sequence[float] = (5, 2, 1),
    max_repeat: int = 3,
    block_words: int = 64,
    shard_words: int = 1 << 19,
    seed: int = 20,
) -> DataFrame:
    """One row per document: ``doc_id, source, size, source_size, target, taken, passes, spans``.

    The mix takes the whole document ``passes`` times and, once more, the word
    ranges ``spans`` (from inclusive, to exclusive); ``taken`` is the number of
    words of both.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    sizes = scratch.save(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    placed, quotas = shard_quotas(sizes, weights, max_repeat, block_words, shard_words, seed)
    stream = Window.partitionBy("source", "_shard").orderBy(F.xxhash64(F.lit(seed + 3), "doc_id"), "doc_id", "size")
    laid = placed.withColumn(
        "_start", F.coalesce(F.sum("size").over(stream.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("bigint"))
    )
    joined = laid.join(quotas, F.col("source").eqNullSafe(F.col("_src")) & (F.col("_shard") == F.col("_sh")))
    rows = joined.withColumn("passes", F.when(F.col("_blocks") > 0, F.expr("quota div _blocks")).otherwise(F.lit(0).cast("bigint")))
    rows = rows.withColumn("_extra", F.when(F.col("_blocks") > 0, F.col("quota") - F.col("passes") * F.col("_blocks")).otherwise(0))
    rows = rows.withColumn("spans", _taken_spans(block_words, seed))
    more = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["to"] - s["from"])
    return rows.select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("passes") * F.col("size") + more).alias("taken"), "passes", "spans",
    )


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: documents (all their columns) repeated and cut as ``mix_plan`` says.

    A whole pass repeats the row; the extra pass keeps the words of the taken
    ranges with the white space that follows them.  Rows without words, and documents
    the mix does not take, are not in it.  ``n_chars`` is set anew where the
    table has it.  Rows that share doc_id, source and size share one plan: the
    repeated row's plans are dealt out by rank.
    """
    keys = ["_id", "_no_id", "_src", "_no_src", "_size"]  # without nulls, so that windows and join share one exchange

    def keyed(df: DataFrame, doc_id: Column, source: Column, size: Column) -> DataFrame:
        return df.withColumns({
            "_id": F.coalesce(doc_id.cast("string"), F.lit("")), "_no_id": doc_id.isNull(),
            "_src": F.coalesce(source, F.lit("")), "_no_src": source.isNull(), "_size": size,
        })

    rank = Window.partitionBy(*keys)
    plan = mix_plan(docs, **settings).filter("taken > 0")
    plan = keyed(plan, F.col("doc_id"), F.col("source"), F.col("size"))
    plan = plan.withColumn("_rank", F.row_number().over(rank.orderBy("passes", F.col("spans").cast("string"))))
    plan = plan.select(*keys, "_rank", F.col("passes").alias("_passes"), F.col("spans").alias("_spans"))
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_doc"))
    rows = keyed(rows, F.col("_doc.doc_id"), F.col("_doc.source"), word_count(F.col("_doc.text")))
    rows = rows.withColumn("_rank", F.row_number().over(rank.orderBy(F.xxhash64("_doc.text"))))
    rows = rows.join(plan.hint("merge"), [*keys, "_rank"])
    # the words are bound to a lambda variable, so a text that is cut is taken apart once, not once per span; they are fetched by index
    words = F.array(F.regexp_extract_all(F.col("_doc.text"), F.lit(f"({WORD}(?:{WHITE})?)"), F.lit(1)))
    taken = F.flatten(F.transform("_spans", lambda s: F.sequence(s["from"].cast("int"), s["to"].cast("int") - 1)))
    cut = F.get(F.transform(words, lambda w: F.array_join(F.transform(taken, lambda i: F.get(w, i)), "")), F.lit(0))
    copies = F.concat(
        F.array_repeat(F.col("_doc.text"), F.col("_passes").cast("int")),
        F.when(F.size("_spans") > 0, F.array(cut)).otherwise(F.array().cast("array<string>")),
    )
    rows = rows.select("_doc", F.explode(copies).alias("_text"))
    new = {"text": F.col("_text"), "n_chars": F.length("_text").cast("bigint")}
    return rows.select(*[new.get(c, F.col(f"_doc.`{c}`")).alias(c) for c in names])
