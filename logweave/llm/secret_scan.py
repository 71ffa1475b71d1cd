"""Secret scan: patterns, and password guess costs for values in a credential context.

Three patterns give the base spans: assignments to credential names, access key ids and long
hexadecimal runs.  The method adds spans of kind ``guess``: values that follow a
credential word and a ``:`` or ``=``, wider than the assignment pattern allows, whose guess cost is
high.  The cost, in decimal digits of guesses, is the minimum over all segmentations of the value
into dictionary words (with capitals and digit look-alikes), dates, repeats, keyboard
or alphabet walks and brute-force characters; a dynamic program over
positions finds it in time linear in the value's length.  A value that is easily guessed (a
placeholder, a word, a walk) is not taken for a secret by the method.

Each task scans its own whole texts; nothing is shuffled.  Cheap byte tests skip the patterns
where they cannot match.

Defined results: a null text is empty and has no spans; spans are code-point offsets, end exclusive; a
guess span inside a base span is left out; repeated rows get equal spans; an empty table gives no rows;
extra columns are left out.
"""

from __future__ import annotations

import math
import re
import string
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["guess_cost", "find_secrets", "scan_documents", "KINDS"]

# The span kinds in the order of the report, and the base patterns.
KINDS = ("assign", "access", "hex", "guess")
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
# Words that announce a credential, for the added spans.
CONTEXT = r"""(?:pass(?:word|wd|phrase|code)?|pwd|pin|secret|token|api[_ -]?key|access[_ -]?key|private[_ -]?key|credentials?|auth)["']?[\x20\t]*[:=]+[\x20\t]*["']?([^\s"'<>]{6,})"""
# Common words of guessed passwords, most common first.
WORDS = (
    "password 123456 qwerty admin welcome letmein login monkey dragon master hello secret shadow sunshine princess football baseball "
    "superman batman trustno1 iloveyou test guest root user default changeme example sample demo temp dummy placeholder none null "
    "token apikey key value string here your my the this that pass word secure private public access system server database "
    "service account manager office company summer winter spring autumn january february march april june july august september "
    "october november december monday tuesday friday love money star angel flower cookie pepper ginger tiger lion eagle "
    "freedom whatever computer internet google apple windows linux oracle mysql postgres redis docker github"
).split()
LOOK_ALIKES = str.maketrans("@4310$57!", "aaeiosstl"[:9])
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
DATES = re.compile(
    r"(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d|(?:19|20)\d\d"
)

_KEY = {c: (r, k) for r, row in enumerate(ROWS) for k, c in enumerate(row)}
_CREDENTIAL = re.compile(CONTEXT, re.I | re.A)
_ASSIGN, _ACCESS, _HEX = re.compile(ASSIGN, re.I | re.A), re.compile(ACCESS), re.compile(HEX)
_HEX_MAP = bytes(ord("h") if chr(c) in "0123456789abcdef" else ord(" ") for c in range(256))
SEGMENT = math.log10(2)  # every further segment doubles the guesses


def _brute(c: str) -> float:
    return math.log10(10 if "0" <= c <= "9" else 26 if c.isalpha() and c.isascii() else 33)


RUN = math.log10(16)  # the guesses for the length of a walk or of a repeat


class Words:
    """The log10 guesses of each known word, most common first."""

    def __init__(self, more=()):
        words = list(dict.fromkeys([*WORDS, *more]))
        self.rank = {w: math.log10(i + 2) for i, w in enumerate(words)}
        self.lengths = sorted({len(w) for w in words})

    def cost(self, value: str, low: str, plain: str, i: int, j: int) -> float | None:
        """Of ``value[i:j]`` as a word, perhaps spelt with look-alikes or capitals."""
        word = low[i:j]
        found, extra = self.rank.get(word), 0.0
        if found is None:
            found, extra = self.rank.get(plain[i:j]), math.log10(4)
        if found is None:
            return None
        return found + extra + (math.log10(2) if value[i:j] != word else 0.0)


def _step(a: str, b: str):
    """How a walk goes from one character to the next: letters or digits in a row, or neighbouring keys; None if it does not."""
    if a.isalnum() and b.isalnum() and abs(ord(a) - ord(b)) == 1:
        return "order", ord(b) - ord(a)
    p, q = _KEY.get(a), _KEY.get(b)
    if p and q and p != q and abs(p[0] - q[0]) <= 1 and abs(p[1] - q[1]) <= 1:
        return "keys", 0
    return None


class _Runs:
    """The cheapest start of a walk, or of a repeat, that ends at the position reached.

    Starts lie in the stretch that has lasted so far; each joins it once, when the segment from it is long enough."""

    def __init__(self, least: int):
        self.least, self.first, self.best = least, None, math.inf

    def reach(self, end: int, first: int | None, starts: list[float]) -> float:
        """``first``: where the stretch that holds the last characters begins, None if there is none; ``starts``: cost of a segment's start."""
        if first != self.first:
            self.first, self.best = first, math.inf
        if first is not None and end - self.least >= first:
            self.best = min(self.best, starts[end - self.least])
        return self.best


def guess_cost(value: str, words: Words = Words(), limit: float = 10.0) -> float:  # noqa: B008 - read only
    """log10 of the guesses that the cheapest segmentation of ``value`` takes; exact below ``limit``.

    Every stretch is a candidate: words; dates; walks of three characters or more in one direction, wherever they begin and
    end; repeats of any unit, three characters and two rounds or more (a unit of ``limit`` characters costs ``limit`` by itself, so longer
    ones are left out); brute force for the rest.  Linear in the length of the value."""
    n = len(value)
    low = value.lower()
    if len(low) != n:  # a few letters change length when lowered
        low = value
    plain = low.translate(LOOK_ALIKES)
    cost, starts = [0.0] + [math.inf] * n, [0.0] + [math.inf] * n
    brute = [_brute(c) for c in value]
    walk, walk_first, move = _Runs(3), None, None
    units = range(1, min(n // 2, math.ceil(limit)) + 1)
    repeats = {u: _Runs(max(3, 2 * u)) for u in units}
    firsts: dict[int, int | None] = dict.fromkeys(units)
    spent: dict[int, float] = {}
    for j in range(1, n + 1):
        # brute force goes on character by character without a new segment
        best = cost[j - 1] + brute[j - 1]
        for size in words.lengths:
            if size > j:
                break
            found = words.cost(value, low, plain, j - size, j)
            if found is not None:
                best = min(best, starts[j - size] + found)
        if "0" <= low[j - 1] <= "9":
            for i in (j - 4, j - 8, j - 9, j - 10):
                if i >= 0 and DATES.fullmatch(low, i, j):
                    best = min(best, starts[i] + math.log10(120 if j - i == 4 else 365 * 120))
        if j > 1:
            step = _step(low[j - 2], low[j - 1])
            if step is None:
                walk_first = None
            elif step != move or walk_first is None:
                walk_first = j - 2
            move = step
            best = min(best, walk.reach(j, walk_first, starts) + math.log10(94) + RUN)
        for u in units:
            if j <= u or value[j - 1] != value[j - 1 - u]:
                firsts[u] = None
                continue
            if firsts[u] is None:
                firsts[u] = j - 1 - u
                spent[u] = sum(brute[j - 1 - u : j - 1])
            best = min(best, repeats[u].reach(j, firsts[u], starts) + spent[u] + RUN)
        cost[j], starts[j] = best, best + SEGMENT
    return cost[n]


def corpus_words(docs: DataFrame, most: int) -> list[str]:
    """Words of three to twenty letters a-z (either case) by the number of documents they occur in, two at least, most common first.

    All words down to the lowest count at which there are no more than ``most`` of them; the driver sees these alone."""
    low = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    found = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(low, F.lit(r"(?<![a-z])[a-z]{3,20}(?![a-z])"), F.lit(0)))).alias("w"))
    counted = found.groupBy("w").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    scratch = Scratch(docs.sparkSession, "words")
    counted = scratch.save(counted, "counted")
    levels = counted.groupBy("n").agg(F.count(F.lit(1)).alias("words"))  # a row per count that occurs
    levels = levels.withColumn("upto", F.sum("words").over(Window.orderBy(F.col("n").desc())))
    cut = levels.filter(F.col("upto") <= most).agg(F.min("n")).first()[0]
    kept = [] if cut is None else counted.filter(F.col("n") >= cut).collect()
    scratch.close()
    return [r["w"] for r in sorted(kept, key=lambda r: (-r["n"], r["w"]))]


def find_secrets(raw: bytes | None, min_cost: float = 10.0, words: Words = Words()) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) of a whole UTF-8 text, by start, then kind."""
    if not raw:
        return []
    low = raw.lower()
    named = any(k in low for k in (b"passw", b"secret", b"token", b"api_key", b"apikey"))
    context = named or any(k in low for k in (b"pass", b"pwd", b"pin", b"key", b"credential", b"auth"))
    context = context and (b"=" in raw or b":" in raw)
    access, hexed = b"AKIA" in raw, b"h" * 16 in raw.translate(_HEX_MAP)
    if not (named or context or access or hexed):
        return []
    text, spans = raw.decode("utf-8", "replace"), []
    if named:
        spans += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if access:
        spans += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 18]
    if hexed:
        spans += [("hex", m.start(), m.end()) for m in _HEX.finditer(text) if len(m[0]) >= 16]
    base = list(spans)
    if context:
        for m in _CREDENTIAL.finditer(text):
            value = m[1].rstrip(".,;:)]}")
            a, b = m.start(1), m.start(1) + len(value)
            if len(value) >= 6 and not any(s <= a and b <= e for _, s, e in base) and guess_cost(value, words, min_cost) >= min_cost:
                spans.append(("guess", a, b))
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _scan_task(min_cost, words):
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            known = words.value
            found = [find_secrets(t, min_cost, known) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"),
                "spans": pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in spans] for spans in found], kind),
            })

    return run


def scan_documents(docs: DataFrame, *, min_cost: float = 10.0, max_words: int = 20_000) -> DataFrame:
    """``doc_id, spans ARRAY<STRUCT<kind, start, end>>`` per row of ``docs[doc_id, text]``.

    The words of guess costs are the fixed ones and the corpus's own ``max_words`` commonest, some 300 KB to broadcast."""
    known = docs.sparkSession.sparkContext.broadcast(Words(corpus_words(docs, max_words)))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        _scan_task(min_cost, known), f"doc_id {id_type}, spans array<struct<kind:string,start:bigint,end:bigint>>"
    )
