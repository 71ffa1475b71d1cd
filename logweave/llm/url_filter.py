"""URL filter: host/path rules, then gradient-boosted trees on lexical features [native].

Rules (``host + path``) judge the pages they fit; the longest fitting rule wins.
The pages that a rule judged are the labelled URLs.  Trees are boosted on lexical
features of those URLs - lengths, depth, digit ratio, character entropy, parameter
counts, and block rates of the host's suffixes - and judge every other page.

These statistics are counted over all labelled pages, one row per string and fold
however many there are, and joined back to the pages by the string.  A URL that the trees are fitted on
sees the rates of the other folds only (folds by a hash of the URL): rates that counted its own label would
be copied by the trees in place of learning anything.  A counted table
of at most ``BROADCAST_BYTES`` is broadcast, a larger one meets the pages in a
sort-merge join, whose hot suffixes adaptive execution splits.  The trees are fitted
on at most ``max_train_rows`` distinct labelled URLs, weighted by their pages: of each
label those whose hash comes first, in proportion and at least one (a bounded,
documented sample); Spark ML fits and applies them in the JVM.

Defined results: a null url, or one without ``://``, has empty host and path and is
judged by the method on its empty features; with labels of one class only, the
method gives that class; with none it allows; an empty table gives no rows; equal
urls get equal verdicts; extra columns pass through unless they clash with a result
column, which then replaces them.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

__all__ = ["host_of", "path_of", "best_rule", "url_features", "judge_urls", "BROADCAST_BYTES"]

BROADCAST_BYTES = 8 << 20  # of suffix strings and counts, as counted
_FEATURES = [
    "f_length", "f_host_length", "f_path_length", "f_depth", "f_labels", "f_digits", "f_host_digits", "f_entropy",
    "f_host_entropy", "f_params", "f_equals", "f_hyphens", "f_fragment", "f_secure", "f_suffix1", "f_suffix2", "f_suffix2_n",
]
FOLDS = 5
RESULTS = ("host", "path", "rule", "score", "verdict")


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    host = F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def best_rule(host: Column, path: Column, rules: Mapping[str, str]) -> Column:
    """The longest of ``rules`` that fits, else null.

    A rule's text up to its first ``/`` is a host, which fits itself and all its
    subdomains; the rest must start the path."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        rule_host, slash, rest = rule.partition("/")
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(slash + rest))
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def _once(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """``df`` plus ``columns``, from a one-element generator: each is computed once per row, not
    copied into every expression that reads it."""
    return df.select("*", F.inline(F.array(F.struct(*[v.alias(k) for k, v in columns.items()]))))


def _entropy(text: Column) -> Column:
    """Bits per character: -sum p log2 p over the distinct characters."""
    chars = F.split(text, "")
    n = F.greatest(F.length(text), F.lit(1))
    counts = F.transform(F.array_distinct(chars), lambda c: F.length(text) - F.length(F.replace(text, c)))
    return -F.aggregate(
        F.filter(counts, lambda k: k > 0), F.lit(0.0), lambda a, k: a + (k / n) * F.log2(k / n)
    )


def url_features(df: DataFrame) -> DataFrame:
    """``df[url, host, path]`` plus the plain lexical features and the host's last label ``_s1`` and last two ``_s2``."""
    url = F.coalesce("url", F.lit(""))
    labels = F.split("host", r"\.")

    def ratio(text, keep):
        return (F.length(text) - F.length(F.translate(text, keep, ""))) / F.greatest(F.length(text), F.lit(1))

    def count(text, c):
        return F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))

    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    digits = "0123456789"
    columns = {
        "f_length": F.length(url), "f_host_length": F.length("host"), "f_path_length": F.length("path"),
        "f_depth": count(F.col("path"), "/"), "f_labels": F.size(labels), "f_digits": ratio(url, digits),
        "f_host_digits": ratio(F.col("host"), digits), "f_entropy": _entropy(url), "f_host_entropy": _entropy(F.col("host")),
        "f_params": F.when(query == "", 0).otherwise(count(query, "&") + 1), "f_equals": count(query, "="),
        "f_hyphens": count(F.col("host"), "-"), "f_fragment": F.contains(url, F.lit("#")).cast("int"),
        "f_secure": F.startswith(F.lower(url), F.lit("https:")).cast("int"),
    }
    return _once(df, {k: v.cast("double") for k, v in columns.items()} | {"_s1": _suffix(F.col("host"), 1), "_s2": _suffix(F.col("host"), 2)})


def _suffix(host: Column, n: int) -> Column:
    """The last ``n`` labels of a host, all of them if it has fewer."""
    return F.substring_index(host, ".", -n)


def _fold(seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed + 1), "url"), F.lit(FOLDS)).cast("int")


def statistics(labelled: DataFrame, scratch: Scratch, seed: int) -> dict[str, tuple[DataFrame, bool]]:
    """``_k, _fold, _s, _n`` (block labels and pages per string and fold) for host suffixes of one and two labels,
    each with whether it is small enough to broadcast.  ``labelled`` has ``url, host, label``."""
    sums = F.sum("_s").alias("_s"), F.sum("_n").alias("_n")
    pages = labelled.withColumns({"_fold": _fold(seed), "_s": F.col("label"), "_n": F.lit(1).cast("bigint")})
    two = scratch.save(pages.groupBy(_suffix(F.col("host"), 2).alias("_k"), "_fold").agg(*sums), "suffix2")
    # the last label is a function of the last two, so the pages are counted once for both
    one = scratch.save(two.groupBy(_suffix(F.col("_k"), 1).alias("_k"), "_fold").agg(*sums), "suffix1")
    out = {}
    for name, table in (("1", one), ("2", two)):
        size = table.agg(F.sum(F.octet_length("_k") + 20)).first()[0]
        out[name] = table, (size or 0) <= BROADCAST_BYTES
    return out


def with_statistics(df: DataFrame, tables: Mapping[str, tuple[DataFrame, bool]], fold: str | None = None) -> DataFrame:
    """``df[_s1, _s2, _st, ...]`` plus the smoothed rates and log counts; a string without labelled pages has rate 0.5 and count 0.

    ``fold`` names a column whose fold of the counts a row does not see."""
    for k, (table, small) in tables.items():
        whole = table.groupBy(F.col("_k").alias(f"_k{k}")).agg(F.sum("_s").alias(f"_a{k}"), F.sum("_n").alias(f"_b{k}"))
        df = df.join(F.broadcast(whole) if small else whole.hint("merge"), F.col(f"_s{k}") == F.col(f"_k{k}"), "left")
        if fold:
            own = table.select(F.col("_k").alias(f"_o{k}"), F.col("_fold").alias(f"_f{k}"), F.col("_s").alias(f"_c{k}"), F.col("_n").alias(f"_d{k}"))
            df = df.join(F.broadcast(own) if small else own.hint("merge"), (F.col(f"_s{k}") == F.col(f"_o{k}")) & (F.col(fold) == F.col(f"_f{k}")), "left")

    def seen(k, total, part):
        out = F.coalesce(F.col(f"{total}{k}"), F.lit(0))
        return out - F.coalesce(F.col(f"{part}{k}"), F.lit(0)) if fold else out

    def rate(k):
        return (seen(k, "_a", "_c") + 1.0) / (seen(k, "_b", "_d") + 2.0)

    return df.withColumns({
        "f_suffix1": rate("1"), "f_suffix2": rate("2"), "f_suffix2_n": F.log1p(seen("2", "_b", "_d")),
    })


def training_urls(labelled: DataFrame, distinct: Mapping[float, int], max_rows: int, seed: int) -> DataFrame:
    """``url, label, weight DOUBLE``: at most ``max_rows`` (two at least) distinct URLs of ``labelled[url, label]``
    with their row counts.

    ``distinct`` is the (approximate) number of URLs per label; both labels occur.  Rows that a hash of
    the URL puts far behind the places to be had are left out before the URLs are ranked by it."""
    max_rows, total = max(2, max_rows), sum(distinct.values())
    first = min(max(1, round(max_rows * distinct[1.0] / total)), max_rows - 1)
    key, out = F.pmod(F.xxhash64(F.lit(seed), "url"), F.lit(1 << 30)), None
    for label, places in ((1.0, first), (0.0, max_rows - first)):
        share = min(1.0, (2 * places + 100) / max(1, distinct[label]))
        near = labelled.filter((F.col("label") == label) & (key < int(share * (1 << 30))))
        counted = near.groupBy("url", "label").agg(F.count(F.lit(1)).cast("double").alias("weight"))
        taken = counted.orderBy(key, "url").limit(places)
        out = taken if out is None else out.unionByName(taken)
    return out


_ASSEMBLER = {"inputCols": _FEATURES, "outputCol": "_vector"}


def fit(labelled: DataFrame, distinct: Mapping[float, int], scratch: Scratch, max_rows: int, trees: int, depth: int, seed: int):
    """(model, statistics) from ``labelled[url, host, path, label]``, which has both labels."""
    tables = statistics(labelled, scratch, seed)
    picked = training_urls(labelled, distinct, max_rows, seed).withColumn("_own", _fold(seed))
    picked = url_features(_once(picked, {"host": host_of(F.col("url")), "path": path_of(F.col("url"))}))
    train = VectorAssembler(**_ASSEMBLER).transform(with_statistics(picked, tables, "_own"))
    train = scratch.save(train.select("label", "weight", F.col("_vector").alias("features")), "train")  # the fit reads it many times
    model = GBTClassifier(maxIter=trees, maxDepth=depth, seed=seed, subsamplingRate=1.0, weightCol="weight").fit(train)
    scratch.drop("train")
    model.setFeaturesCol("_vector").setProbabilityCol("_probability").setPredictionCol("_prediction").setRawPredictionCol("_raw")
    return model, tables


def apply(model, tables: Mapping[str, tuple[DataFrame, bool]], urls: DataFrame) -> DataFrame:
    """``urls[url, host, path, ...]`` plus the features and ``score``, the block probability."""
    scored = model.transform(VectorAssembler(**_ASSEMBLER).transform(with_statistics(url_features(urls), tables)))
    return scored.withColumn("score", vector_to_array("_probability")[1])


def judge_urls(
    pages: DataFrame,
    rules: Mapping[str, str],
    *,
    max_train_rows: int = 20_000,
    trees: int = 10,
    depth: int = 4,
    cut: float = 0.5,
    seed: int = 2,
) -> DataFrame:
    """``pages`` plus ``host, path, rule, score DOUBLE, verdict``.

    ``score`` is the trees' block probability; ``verdict`` is the rule's, else
    ``block`` where ``score >= cut``.
    """
    keep = [c for c in pages.columns if c not in RESULTS]
    # the row travels as one column, so its own names cannot clash with the features'
    located = pages.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_page"), F.col("url").alias("url"))
    located = _once(located, {"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    located = _once(located, {"rule": best_rule(F.col("host"), F.col("path"), rules)})
    said = F.lit(None).cast("string")
    for rule, verdict in rules.items():
        said = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(said)

    urls = located.select("url", "host", "path", "rule").filter(F.col("rule").isNotNull())
    labelled = urls.withColumn("label", (said == "block").cast("double"))
    kinds = [F.approx_count_distinct(F.when(F.col("label") == v, F.col("url"))).alias(f"d{v}") for v in (0, 1)]
    known = labelled.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("s"), *kinds).first()
    n, blocked = known["n"], known["s"] or 0.0
    if n == 0 or blocked in (0.0, float(n)):
        score = F.lit(1.0 if n and blocked else 0.0)
        verdict = F.coalesce(said, F.when(score >= cut, "block").otherwise("allow"))
        return located.withColumn("score", score).withColumn("verdict", verdict).select("_page.*", *RESULTS)

    scratch = Scratch(pages.sparkSession, "urls")
    model, tables = fit(labelled, {0.0: known["d0"], 1.0: known["d1"]}, scratch, max_train_rows, trees, depth, seed)
    scored = apply(model, tables, located)
    verdict = F.coalesce(said, F.when(F.col("score") >= cut, "block").otherwise("allow"))
    return scored.withColumn("verdict", verdict).select("_page.*", *RESULTS)
