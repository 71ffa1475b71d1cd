"""RE2 dialect on java.util.regex: the translated pattern must behave like RE2."""

import duckdb
import pytest
from pyspark.sql import functions as F

from logweave.functions.growth import growth
from logweave.functions.regex import RegexSyntaxError, search, translate


def matches(spark, text, pattern):
    return spark.range(1).select(F.coalesce(search(F.lit(text), pattern), F.lit(False))).first()[0]


@pytest.mark.parametrize(
    "pattern,text,expected",
    [
        ("^abc$", "abc\n", False),  # $ is end of text, not before a final newline
        ("^abc$", "abc", True),
        ("(?m)^b$", "a\nb\nc", True),
        ("(?m)^$", "a\n", True),  # RE2 begins a line after a final newline
        ("^a.$", "a ", True),  # . excludes only \n
        ("^a.$", "a\n", False),
        ("(?s)^a.$", "a\n", True),
        ("^\\s$", "\x0b", False),  # \s is [\t\n\f\r ]
        ("^\\s$", "\t", True),
        ("^[[:alpha:]]+$", "ab:", False),  # POSIX class, not a set of ':' 'a' ...
        ("^[[:alpha:]]+$", "ab", True),
        ("^[[:^digit:]]+$", "ab", True),
        ("caf\\b", "café ", True),  # ASCII word boundary: é is not a word char
        ("\\bé", "xé", True),
        ("\\bé", " é", False),
        ("(?i)étÉ", "ÉTé", True),  # case folding is Unicode-aware
        ("(?P<year>\\d{4})-(?P<m>\\d\\d)", "on 2024-03", True),
        ("x{", "ax{b", True),  # a brace that is not a repeat is a literal
        ("a{2,3}$", "caaa", True),
        ("\\Qa.b\\E", "a.b", True),
        ("\\Qa.b\\E", "axb", False),
        ("\\101", "A", True),  # octal escape
        ("\\x{41}\\x42", "AB", True),
        ("[]a]+", "]", True),
        ("[a-c-]+$", "-", True),
        ("[\\d\\-]+", "-", True),
        ("[^\\S]", " ", True),
        ("\\pL", "é", True),
        ("\\p{Greek}", "λ", True),
        ("\\PL", "é", False),
        ("a|", "zzz", True),
        ("(?i)abc(?-i)D", "ABCD", True),
        ("(?i)abc(?-i)D", "ABCd", False),
        ("a(?i)b|c", "C", True),  # flags persist across alternatives of the group
        ("(?:a(?i)b)c", "aBC", False),  # and end with the group
        ("(?U)a+", "aaa", True),
        ("[&&a]", "&", True),
        ("[[]", "[", True),
    ],
)
def test_re2_semantics(spark, pattern, text, expected):
    assert matches(spark, text, pattern) is expected
    # the expectation itself is what a real RE2 engine answers
    assert duckdb.execute("SELECT regexp_matches(?, ?)", [text, pattern]).fetchone()[0] is expected


def test_ungreedy_flag_swaps_greediness(spark):
    rx = translate("(?U)(a+)")
    got = spark.range(1).select(F.regexp_extract(F.lit("aaa"), rx.pattern, 1)).first()[0]
    assert got == "a"
    rx = translate("(?U)(a+?)")
    assert spark.range(1).select(F.regexp_extract(F.lit("aaa"), rx.pattern, 1)).first()[0] == "aaa"


@pytest.mark.parametrize(
    "pattern",
    ["(a)\\1", "(?=a)", "(?!a)", "(?<=a)b", "(?>a)", "a**", "a++", "*a", "a{1001}", "a{3,2}", "(a", "a)", "[a",
     "\\Z", "\\G", "\\k<x>", "\\y", "[z-a]", "\\8", "(?P<>a)", "(?i-)a", "\\x{110000}", "a{2}{3}"],
)
def test_rejects_what_re2_rejects(pattern):
    with pytest.raises(RegexSyntaxError):
        translate(pattern)


def test_group_count():
    assert translate("(a)(?:b)(?P<n>c)(?i:d)(e(f))").groups == 4
    assert translate("abc").groups == 0
    assert translate("\\(a\\)").groups == 0
    assert translate("[(]").groups == 0


@pytest.mark.parametrize(
    "pattern,required",
    [
        ("[a-z]+@[a-z]+\\.com", ".com"),
        ("[a-z]+@[a-z]+", "@"),
        ("Analytics: (.*)$", "Analytics: "),
        ("error|fail", ""),
        ("(?i)abc", ""),
        ("ab?c", "a"),
        ("x(ab)*yz", "yz"),
        ("a{0,2}bc", "bc"),
    ],
)
def test_required_literal(pattern, required):
    assert translate(pattern).required == required


def test_prefilter_does_not_change_results(spark):
    texts = ["mail a@b.com here", "no at sign", "@@", "x@y", None]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    rx = translate("[a-z]+@[a-z]+\\.com")
    got = [r[0] for r in df.select(F.coalesce(search(F.col("s"), rx), F.lit(False))).collect()]
    plain = [r[0] for r in df.select(F.coalesce(F.col("s").rlike(rx.pattern), F.lit(False))).collect()]
    assert got == plain == [True, False, False, False, False]


DIFF_PATTERNS = [
    r"\ble\b", r"\bé", r"é\b", r"\Bx\B", r"\b\d+\b", r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b", r"[0-9]\b",
    r"\s\b", r"\W\b", r"x\b ", r"(?i)\bk\b", r"(?i)s\b", r"(?i)licen[cs]e", r"(?i)ERROR", r"(?i)status",
    r"(?i)ß", r"(?i)σ", r"ab?c", r"a{0,2}bc", r"(?i)K", r"\bthe\b|\ban\b", r"x*\b", r"[[:punct:]]\b",
    r"(?m)^\w+$", r"^\s*$", r"\d{2}:\d{2}", r"[^\x00-\x7F]+", r"(?i)ǅ",
    r"(?i)\W", r"(?i)[^a-z]", r"(?i)\w\b", r"(?i)\bk", r"(?i)[[:alpha:]]", r"(?i)[^k]", r"\W", r"\D\b",
    r"\b(ab|c)", r"\b(?:x)?y", r"\b((a)b)", r"(?:a|\b)x", r"\b(?i)x", r"\b(?:\.\d)", r"\B(?:[0-9]+)",
    r"x(?:\b)y", r"\b(?:t)he\b",
]
DIFF_TEXTS = [
    "le chat", "leé", "éle", "café le", "xx", "a x b", "123 456", "10.0.0.1", "1.2.3.4.5", "x y", "xK",
    "K", "ok k", "ſ", "bus ", "LICENSE", "Licence", "errOR", "STATUS", "ſtatus", "ß", "SS", "Σ", "ς",
    "abc", "ac", "bc", "aabc", "the end", "an", "first\nsecond", "  ", "", "ǆ", "Ǆ", "日本 語", "x.",
    "\u212a", "a\u212a b", "\u212a\u212a", "s\u017f", "\u017fk", "ab", "c", "xy", "y", ".5", "a.5", "a5",
    "the", "other", "x y",
]


@pytest.mark.parametrize("pattern", DIFF_PATTERNS)
def test_differential_against_re2(spark, pattern):
    df = spark.createDataFrame([(t,) for t in DIFF_TEXTS], "s string")
    got = [r[0] for r in df.select(F.coalesce(search(F.col("s"), pattern), F.lit(False))).collect()]
    want = [duckdb.execute("SELECT regexp_matches(?, ?)", [t, pattern]).fetchone()[0] for t in DIFF_TEXTS]
    assert got == want


@pytest.mark.parametrize(
    "pattern,text,expected",
    [
        (r"^(?:\w|-)*$", "a-" * 500_000, True),
        (r"^(?:\w|-)*$", "a-" * 500_000 + " ", False),
        (r"^(?:a|b)*$", "ab" * 500_000, True),
        (r"(\w+\s?)+$", "word " * 200_000, True),
        (r"^(a+)+$", "a" * 1_000_000 + "b", False),
        (r"(?:ab)+$", "ab" * 500_000, True),  # flat: Java loops
        (r"(?:.x)+$", "é😀x" * 100_000, True),
        (r"^\w+$", "w" * 1_000_000, True),
        (r".*a.*b.*c$", "ab" * 500_000, False),  # several repeats that can trade characters
        (r".*a.*b.*c$", "ab" * 500_000 + "c", True),
        (r"(\w*)(\d*)z", "7" * 1_000_000, False),
        (r"\d+x", "7" * 1_000_000, False),  # one repeat, tried from every start
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "a." * 300_000 + "@" + "b." * 300_000, False),
        (r"^(.*) (.*)x$", "a " * 500_000, False),
    ],
)
def test_long_lines_neither_overflow_nor_stall(spark, pattern, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(F.coalesce(search(F.col("t"), pattern), F.lit(False))).first()[0] is expected


@pytest.mark.parametrize("pattern", [r"^(\d+)\s+([^:]+):\s*(.*)$", r"(?:\d{1,3}\.){3}\d", r"(?i)licen[cs]e", r"(?:a|b)?c", r"(ab)+"])
def test_common_patterns_stay_in_java(pattern):
    assert translate(pattern).flat


@pytest.mark.parametrize(
    "pattern,power",
    [
        ("abc", 1), ("a.*", 1), ("^(.*)$", 1), (r"^\d+x", 1), (r"\d+x", 2), ("^(.*) (.*)$", 1), ("^(.*) (.*)x$", 2), (".*a.*b.*c$", 4), ("a*a*a*b", 4), ("(a|b)+c", 2),
        (r"^(\S+) (\S+) \[(\d+)\] (.*)$", 1), (r"key\s*=\s*[0-9]{16,}", 1), ("x(?s:.{0,500})y", 2), ("x.{0,20}y", 1), (r"^a|b+c", 2), ("(?i)K+\u212a", 2),
        ("[^]a]+]", 2), (r"(?m)^a+$", 2), (r"\Qa.b\E+c", 2), ("(?:a+,){3}x", 2), ("^(?:a+,){3}x", 1), (r"\x{41}+\x41", 2), ("[[:alpha:]]+[[:digit:]]x", 2), ("^[[:alpha:]]+[[:digit:]]x", 1),
    ],
)
def test_growth_of_a_backtracking_search(pattern, power):
    assert growth(pattern) == power


def test_patterns_too_large_for_re2_are_run_by_java(spark):
    pattern = r"\pL*x\pL*y|\pL{900}\pN{900}\pS{900}"
    assert growth(pattern) > 1 and translate(pattern).java
    assert matches(spark, "aaxbby", pattern) is True and matches(spark, "aab", pattern) is False


def test_groups_of_long_lines(spark):
    from logweave.operators.parse import parse_entries
    from logweave.specs import ParserSpec

    line = "a b " * 250_000 + "end"
    df = spark.createDataFrame([(line,), ("x y",), ("none",)], "value string")
    got = [r.message for r in parse_entries(df, ParserSpec(log_line_regex=r"^(.*) (.*) ?(\w+)$")).collect()]
    assert got == ["d", "y"]


@pytest.mark.parametrize("pattern", [r"\p{Foo}", r"[\p{greek}]", "(a{500}){500}", "(?:(?:a{10}){10}){11}", "(?P<n>a)(?P<n>b)"])
def test_what_re2_refuses_is_refused_up_front(pattern):
    with pytest.raises(RegexSyntaxError):
        translate(pattern)


def test_scripts_newer_than_the_jdk_are_left_to_re2(spark):
    assert not translate(r"\p{Kawi}").flat
    assert matches(spark, "x", r"\p{Kawi}") is False
