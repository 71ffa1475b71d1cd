"""Go-style (RE2) regular expressions for Spark.

Every pattern the library accepts (line format, payload locator, count patterns,
step patterns, property patterns) is written in the RE2 dialect that log tools
conventionally use.  Spark evaluates ``RLIKE``/``regexp_extract``/
``regexp_replace`` with ``java.util.regex``, whose dialect differs in ways that
silently change results (``$`` before a final newline, ``.`` and Unicode line
separators, ASCII-only ``(?i)``, POSIX bracket classes, ``\\s`` with VT,
Unicode-aware ``\\b``).  ``translate`` rewrites a pattern once on the driver into
an equivalent Java pattern, counts its capture groups and rejects what RE2
rejects, so the Spark expressions built from it behave like RE2 and the
pattern is compiled once per task as a literal.

``java.util.regex`` matches by recursion and backtracking where RE2 is linear: a
repeated group with alternatives or repeats inside it overflows the stack on a
long line, or takes exponential time; several repeats that can trade characters take polynomial
time.  ``translate`` marks a pattern ``flat`` when every unbounded (or
long) repeat in it runs in Java as a loop, and bounds the power of the line's length that its search can take
(``growth``).  Java runs the flat patterns of power 1, and those of power 2 on texts of up to ``LONG_TEXT`` bytes.  The
rest is evaluated, over Arrow batches, by the RE2 engine that ships with ``pyarrow``, so
every pattern is searched in time linear in the line, with the same matches.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import functions as F

from .growth import MOST, growth

__all__ = ["JavaRegex", "RegexSyntaxError", "translate", "first_match_groups_pattern", "search", "extract_groups", "extract_group"]


class RegexSyntaxError(ValueError):
    """The pattern is not valid RE2 syntax (or uses a feature RE2 lacks)."""


@dataclass(frozen=True)
class JavaRegex:
    source: str  # the pattern as written (RE2 syntax)
    pattern: str  # equivalent java.util.regex pattern
    groups: int  # number of capturing groups
    required: str = ""  # a literal every match contains ("" if none is known)
    flat: bool = True  # Java runs it without recursion per character
    named: str = ""  # the source with its groups named g1, g2, ...
    power: int = 1  # bound of Java's time, as a power of the text's length

    @property
    def java(self) -> bool:
        """Java alone evaluates it, in linear time."""
        return self.flat and self.power == 1


@dataclass
class _Body:
    """What is known of a group's inside (or of the whole pattern)."""

    choice: bool = False  # has alternatives
    varies: bool = False  # has a repeat of no fixed count
    bmp: bool = True  # matches code points below 0x10000 only, so each character is one Java char
    loops: int = 1  # rounds that Java recurses through at most
    repeats: int = 1  # product of nested repeat counts


# RE2's ASCII character classes, as inclusive code point ranges.
_DIGIT = [(0x30, 0x39)]
_SPACE_PERL = [(0x09, 0x0A), (0x0C, 0x0D), (0x20, 0x20)]  # \s = [\t\n\f\r ]
_WORD = [(0x30, 0x39), (0x41, 0x5A), (0x5F, 0x5F), (0x61, 0x7A)]
_POSIX = {
    "alnum": [(0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A)],
    "alpha": [(0x41, 0x5A), (0x61, 0x7A)],
    "ascii": [(0x00, 0x7F)],
    "blank": [(0x09, 0x09), (0x20, 0x20)],
    "cntrl": [(0x00, 0x1F), (0x7F, 0x7F)],
    "digit": [(0x30, 0x39)],
    "graph": [(0x21, 0x7E)],
    "lower": [(0x61, 0x7A)],
    "print": [(0x20, 0x7E)],
    "punct": [(0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E)],
    "space": [(0x09, 0x0D), (0x20, 0x20)],
    "upper": [(0x41, 0x5A)],
    "word": _WORD,
    "xdigit": [(0x30, 0x39), (0x41, 0x46), (0x61, 0x66)],
}
# Unicode general categories RE2 accepts after \p.
_CATEGORIES = {
    "C", "Cc", "Cf", "Co", "Cs", "L", "Ll", "Lm", "Lo", "Lt", "Lu", "M", "Mc", "Me",
    "Mn", "N", "Nd", "Nl", "No", "P", "Pc", "Pd", "Pe", "Pf", "Pi", "Po", "Ps", "S",
    "Sc", "Sk", "Sm", "So", "Z", "Zl", "Zp", "Zs",
}
# The Unicode scripts RE2 accepts after \p, and those that JDK 17 does not know.
_SCRIPTS = set(
    "Adlam Ahom Anatolian_Hieroglyphs Arabic Armenian Avestan Balinese Bamum Bassa_Vah Batak Bengali Bhaiksuki Bopomofo Brahmi Braille "
    "Buginese Buhid Canadian_Aboriginal Carian Caucasian_Albanian Chakma Cham Cherokee Chorasmian Common Coptic Cuneiform Cypriot Cyrillic "
    "Deseret Devanagari Dives_Akuru Dogra Duployan Egyptian_Hieroglyphs Elbasan Elymaic Ethiopic Georgian Glagolitic Gothic Grantha Greek "
    "Gujarati Gunjala_Gondi Gurmukhi Han Hangul Hanifi_Rohingya Hanunoo Hatran Hebrew Hiragana Imperial_Aramaic Inherited "
    "Inscriptional_Pahlavi Inscriptional_Parthian Javanese Kaithi Kannada Katakana Kayah_Li Kharoshthi Khitan_Small_Script Khmer Khojki "
    "Khudawadi Lao Latin Lepcha Limbu Linear_A Linear_B Lisu Lycian Lydian Mahajani Makasar Malayalam Mandaic Manichaean Marchen "
    "Masaram_Gondi Medefaidrin Meetei_Mayek Mende_Kikakui Meroitic_Cursive Meroitic_Hieroglyphs Miao Modi Mongolian Mro Multani Myanmar "
    "Nabataean Nandinagari New_Tai_Lue Newa Nko Nushu Nyiakeng_Puachue_Hmong Ogham Ol_Chiki Old_Hungarian Old_Italic Old_North_Arabian "
    "Old_Permic Old_Persian Old_Sogdian Old_South_Arabian Old_Turkic Oriya Osage Osmanya Pahawh_Hmong Palmyrene Pau_Cin_Hau Phags_Pa "
    "Phoenician Psalter_Pahlavi Rejang Runic Samaritan Saurashtra Sharada Shavian Siddham SignWriting Sinhala Sogdian Sora_Sompeng Soyombo "
    "Sundanese Syloti_Nagri Syriac Tagalog Tagbanwa Tai_Le Tai_Tham Tai_Viet Takri Tamil Tangut Telugu Thaana Thai Tibetan Tifinagh Tirhuta "
    "Ugaritic Vai Wancho Warang_Citi Yezidi Yi Zanabazar_Square".split()
)
_NEWER_SCRIPTS = set("Cypro_Minoan Kawi Nag_Mundari Old_Uyghur Tangsa Toto Vithkuqi".split())
_MAX_CODE_POINT = 0x10FFFF
_MAX_REPEAT = 1000
_LONG_LOOP = 250  # rounds of a group that Java may recurse through
LONG_TEXT = 1024  # bytes of text on which Java may take quadratic time
_ASCII_WORD = "[0-9A-Za-z_]"
# RE2's \b and \B are ASCII word boundaries; Java's are Unicode-aware.
_WORD_BOUNDARY = f"(?:(?<={_ASCII_WORD})(?!{_ASCII_WORD})|(?<!{_ASCII_WORD})(?={_ASCII_WORD}))"
_NOT_WORD_BOUNDARY = f"(?:(?<={_ASCII_WORD})(?={_ASCII_WORD})|(?<!{_ASCII_WORD})(?!{_ASCII_WORD}))"


_WORD_CLASS_TEXT = "[0-9A-Za-z_]"


def _is_word(ch: str) -> bool:
    return ch.isascii() and (ch.isalnum() or ch == "_")


def _flags_only(rest: str) -> bool:
    """``rest`` starts with ``(?flags)``, which sets flags without opening a group."""
    if not rest.startswith("(?"):
        return False
    j = 2
    while j < len(rest) and rest[j] in "imsU-":
        j += 1
    return j < len(rest) and rest[j] == ")"


def _kind_of(ranges) -> str | None:
    """"word" if every code point in ``ranges`` is an ASCII word character,
    "nonword" if none is, else None."""
    inside = outside = False
    for lo, hi in ranges:
        for wlo, whi in _WORD:
            if lo <= whi and wlo <= hi:
                inside = True
        covered = sum(max(0, min(hi, whi) - max(lo, wlo) + 1) for wlo, whi in _WORD)
        if covered < hi - lo + 1:
            outside = True
    if inside and not outside:
        return "word"
    if outside and not inside:
        return "nonword"
    return None


def _boundary(word_boundary: bool, prev: str | None, nxt: str | None) -> str:
    """ASCII \\b / \\B; one-sided when a neighbouring character is known."""
    w = _WORD_CLASS_TEXT
    if prev is not None:
        after_word = prev == "word"
        # boundary iff the next character's kind differs from the previous one
        return f"(?!{w})" if after_word == word_boundary else f"(?={w})"
    if nxt is not None:
        before_word = nxt == "word"
        return f"(?<!{w})" if before_word == word_boundary else f"(?<={w})"
    return _WORD_BOUNDARY if word_boundary else _NOT_WORD_BOUNDARY


def _hex(cp: int) -> str:
    return "\\x{%X}" % cp


def _ranges_text(ranges) -> str:
    return "".join(_hex(lo) if lo == hi else f"{_hex(lo)}-{_hex(hi)}" for lo, hi in ranges)


def _complement(ranges):
    out, nxt = [], 0
    for lo, hi in sorted(ranges):
        if lo > nxt:
            out.append((nxt, lo - 1))
        nxt = max(nxt, hi + 1)
    if nxt <= _MAX_CODE_POINT:
        out.append((nxt, _MAX_CODE_POINT))
    return out


def _class_of(ranges, negate: bool) -> str:
    # "[^...]" rather than explicit complement ranges: under (?i) Java then
    # negates the case-folded class, as RE2 does
    return "[" + ("^" if negate else "") + _ranges_text(ranges) + "]"


def _java_property(name: str, negate: bool, where: str) -> str:
    if name == "Any":
        rng = [] if negate else [(0, _MAX_CODE_POINT)]
        if not rng:
            return "" if where == "class" else "[^\\x{0}-\\x{10FFFF}]"
        return _ranges_text(rng) if where == "class" else "[" + _ranges_text(rng) + "]"
    if not name or not all(c.isalnum() or c == "_" for c in name):
        raise RegexSyntaxError(f"invalid character class range: \\p{{{name}}}")
    letter = "P" if negate else "p"
    if name in _CATEGORIES:
        return f"\\{letter}{{{name}}}"
    if name not in _SCRIPTS and name not in _NEWER_SCRIPTS:
        raise RegexSyntaxError(f"invalid character class range: \\p{{{name}}}")
    return f"\\{letter}{{Is{name}}}"  # a script name such as Greek or Han


def _power(src: str) -> int:
    if "\\B" in src:  # the RE2 of pyarrow tests it inside characters too; Java stays right
        return 1
    try:
        return growth(src)
    except (ValueError, IndexError):  # something the analysis cannot read: left to RE2
        return MOST


def _fits_re2(source: str) -> bool:
    """Whether the RE2 of pyarrow takes the pattern; it refuses programs beyond a few megabytes, which Java runs."""
    import pyarrow as pa
    import pyarrow.compute as pc

    try:
        pc.match_substring_regex(pa.array([""]), source)
    except pa.ArrowInvalid:
        return False
    return True


class _Translator:
    def __init__(self, src: str):
        self.src = src
        self.i = 0
        self.out: list[str] = []
        self.groups = 0
        self.flags = {"i": False, "m": False, "s": False, "U": False}
        self.stack: list[tuple[dict, int]] = []  # saved flags, output index of "("
        self.atom_start: int | None = None  # output index where the last atom begins
        self.last_quantified = False
        # required-literal tracking at the top level of the pattern
        self.runs: list[str] = []
        self.cur_run = ""
        self.last_literal: str | None = None  # the top-level literal atom just emitted
        self.top_alternation = False
        # shape of the bodies being read (innermost last) and of the last atom, for ``flat``
        self.bodies = [_Body()]
        self.last_body: _Body | None = None  # of a group; None for a single character
        self.last_bmp = True
        self.flat = True
        self.openers: list[tuple[int, int]] = []  # source spans that open a capturing group
        self.names: set[str] = set()
        # what the character before the current position is known to be:
        # "word", "nonword" or None (unknown), for the \b rewrite
        self.prev_kind: str | None = None
        # \b / \B whose neighbours were unknown when met: resolved by the next atom
        self.pending: list[dict] = []
        self.assertion_at: int | None = None  # output index of the last bare zero-width item
        self.wrapped: set[int] = set()  # output indexes of zero-width items grouped for a quantifier

    # -- helpers -----------------------------------------------------------
    def err(self, msg: str):
        raise RegexSyntaxError(f"{msg} in pattern {self.src!r}")

    def peek(self, k: int = 0) -> str:
        j = self.i + k
        return self.src[j] if j < len(self.src) else ""

    def atom(self, text: str, literal: str | None = None, kind: str | None = None, bmp: bool = False):
        self.atom_start = len(self.out)
        self.out.append(text)
        self.last_quantified = False
        self.last_body, self.last_bmp = None, ord(literal) < 0x10000 if literal is not None else bmp
        self.bodies[-1].bmp &= self.last_bmp
        if literal is not None:
            kind = "word" if _is_word(literal) else "nonword"
            if self.flags["i"] and literal.lower() in ("k", "s"):
                kind = None  # also matches the Kelvin sign / long s, which are not ASCII word characters
        self.prev_kind = kind
        for p in self.pending:
            if p["state"] == "await" and len(self.stack) == p["target"]:
                p.update(state="resolved", kind=kind, atom=self.atom_start)
        if literal is not None and not self.stack and not self.flags["i"]:
            self.cur_run += literal
            self.last_literal = literal
        else:
            self.end_run()

    def end_run(self):
        if self.cur_run:
            self.runs.append(self.cur_run)
        self.cur_run = ""
        self.last_literal = None

    def assertion(self, text: str):
        self.atom(text, bmp=True)
        self.assertion_at = self.atom_start

    # -- escapes -------------------------------------------------------------
    def read_escape_char(self) -> int | None:
        """Parse the escape after a backslash that denotes one code point.

        Returns the code point, or None if the escape is not a character escape.
        """
        c = self.peek()
        if c == "":
            self.err("trailing backslash at end of expression")
        if c in "1234567":
            nxt = self.peek(1)
            if not ("0" <= nxt <= "7"):
                self.err("invalid escape sequence (backreferences are not supported)")
        if c in "01234567":
            val = int(c)
            self.i += 1
            for _ in range(2):
                d = self.peek()
                if "0" <= d <= "7":
                    val = val * 8 + int(d)
                    self.i += 1
                else:
                    break
            return val
        if c == "x":
            self.i += 1
            if self.peek() == "{":
                end = self.src.find("}", self.i)
                digits = self.src[self.i + 1 : end] if end >= 0 else ""
                if end < 0 or not digits or any(d not in "0123456789abcdefABCDEF" for d in digits):
                    self.err("invalid escape sequence")
                val = int(digits, 16)
                if val > _MAX_CODE_POINT:
                    self.err("invalid escape sequence")
                self.i = end + 1
                return val
            digits = self.src[self.i : self.i + 2]
            if len(digits) != 2 or any(d not in "0123456789abcdefABCDEF" for d in digits):
                self.err("invalid escape sequence")
            self.i += 2
            return int(digits, 16)
        simple = {"a": 7, "f": 12, "t": 9, "n": 10, "r": 13, "v": 11}
        if c in simple:
            self.i += 1
            return simple[c]
        if ord(c) < 0x80 and not c.isalnum():
            self.i += 1
            return ord(c)
        return None

    def read_property(self) -> tuple[str, bool]:
        negate = self.peek() == "P"
        self.i += 1
        if self.peek() == "{":
            end = self.src.find("}", self.i)
            if end < 0:
                self.err("invalid character class range")
            name = self.src[self.i + 1 : end]
            self.i = end + 1
        else:
            name = self.peek()
            if not name:
                self.err("invalid character class range")
            self.i += 1
        if name.startswith("^"):
            negate, name = not negate, name[1:]
        if name in _NEWER_SCRIPTS:
            self.flat = False  # left to RE2
        return name, negate

    # -- classes ---------------------------------------------------------------
    def parse_class(self):
        self.i += 1  # past "["
        negate = False
        if self.peek() == "^":
            negate = True
            self.i += 1
        parts: list[str] = []
        ranges: list[tuple[int, int]] | None = []  # None once a part has unknown extent
        first = True
        while True:
            c = self.peek()
            if c == "":
                self.err("missing closing ]")
            if c == "]" and not first:
                self.i += 1
                break
            first = False
            if c == "[" and self.peek(1) == ":":
                end = self.src.find(":]", self.i + 2)
                if end >= 0:
                    name = self.src[self.i + 2 : end]
                    neg = name.startswith("^")
                    if neg:
                        name = name[1:]
                    if name not in _POSIX:
                        self.err(f"invalid character class range: [:{name}:]")
                    rng = _POSIX[name]
                    rng = _complement(rng) if neg else rng
                    parts.append(_ranges_text(rng))
                    if ranges is not None:
                        ranges.extend(rng)
                    self.i = end + 2
                    continue
            if c == "\\":
                self.i += 1
                e = self.peek()
                if e in "dDsSwW" and e:
                    base = {"d": _DIGIT, "s": _SPACE_PERL, "w": _WORD}[e.lower()]
                    base = _complement(base) if e.isupper() else base
                    parts.append(_ranges_text(base))
                    if ranges is not None:
                        ranges.extend(base)
                    self.i += 1
                    continue
                if e in "pP" and e:
                    name, neg = self.read_property()
                    parts.append(_java_property(name, neg, "class"))
                    ranges = None
                    continue
                lo = self.read_escape_char()
                if lo is None:
                    self.err(f"invalid escape sequence: \\{e}")
            else:
                lo = ord(c)
                self.i += 1
            # a range lo-hi?
            if self.peek() == "-" and self.peek(1) not in ("]", ""):
                self.i += 1
                h = self.peek()
                if h == "\\":
                    self.i += 1
                    hi = self.read_escape_char()
                    if hi is None:
                        self.err("invalid character class range")
                else:
                    hi = ord(h)
                    self.i += 1
                if hi < lo:
                    self.err("invalid character class range")
                parts.append(f"{_hex(lo)}-{_hex(hi)}")
                if ranges is not None:
                    ranges.append((lo, hi))
            else:
                parts.append(_hex(lo))
                if ranges is not None:
                    ranges.append((lo, lo))
        body = "".join(parts)
        if not body:
            # e.g. [^\x00-\x{10FFFF}] or an empty property set: matches nothing
            self.atom("(?!)" if not negate else "(?s:.)")
            return
        kind = None
        if ranges is not None and not self.flags["i"]:
            kind = _kind_of(_complement(ranges) if negate else ranges)
        bmp = ranges is not None and not negate and all(hi < 0x10000 for _, hi in ranges)
        self.atom("[" + ("^" if negate else "") + body + "]", kind=kind, bmp=bmp)

    # -- repetition ------------------------------------------------------------
    def quantifier(self, q: str):
        if self.atom_start is None:
            self.err(f"missing argument to repetition operator: {q}")
        if self.last_quantified:
            self.err(f"invalid nested repetition operator: {q}")
        lazy = False
        if self.peek() == "?":
            lazy = True
            self.i += 1
        if self.flags["U"]:
            lazy = not lazy
        if self.assertion_at is not None and self.assertion_at == self.atom_start:
            # RE2 lets zero-width items repeat; Java needs them grouped first
            self.out[self.atom_start] = "(?:" + self.out[self.atom_start] + ")"
            self.wrapped.add(self.atom_start)
        self.out.append(q + ("?" if lazy else ""))
        self.last_quantified = True
        self.note_repeat(q)
        optional = q in ("*", "?") or q.startswith("{0")
        if optional:
            self.prev_kind = None
            for p in self.pending:
                if p["state"] == "resolved" and (self.atom_start == p["atom"] or self.atom_start in p["entered"]):
                    p["state"] = "unknown"
        if self.last_literal is not None and self.cur_run.endswith(self.last_literal):
            if optional:
                self.cur_run = self.cur_run[: -len(self.last_literal)]
            self.end_run()  # a repeated literal is required at most once
        elif not self.stack:
            self.end_run()

    def note_repeat(self, q: str):
        """Track what a repeat of the last atom means for ``flat``, and check nested counts."""
        if q in "*+?":
            lo, hi = (1 if q == "+" else 0), (1 if q == "?" else None)
        else:
            low, comma, high = q[1:-1].partition(",")
            lo, hi = int(low), int(high) if high else None if comma else int(low)
        outer, inner = self.bodies[-1], self.last_body
        long = hi is None or hi > _LONG_LOOP
        if inner is None:
            # Java loops over * and + of a character; a counted repeat recurses when char widths change
            if long and q not in "*+" and not self.last_bmp:
                self.flat = False
        elif long and (inner.choice or inner.varies or not inner.bmp):
            self.flat = False
        elif inner.choice or inner.varies:
            outer.loops = max(outer.loops, inner.loops * max(hi, 1))
            self.flat &= outer.loops <= _LONG_LOOP
        outer.varies |= lo != hi
        if q not in "*+?":
            nested = 1 if hi == 0 else max(1, lo if hi is None else hi) * (inner.repeats if inner else 1)
            if nested > _MAX_REPEAT and (lo > 1 or (hi or 0) > 1):
                self.err(f"invalid repeat count: {q}")
            outer.repeats = max(outer.repeats, nested)

    def try_repeat(self) -> str | None:
        """Parse {n}, {n,} or {n,m} at self.i; None if it is a literal brace."""
        end = self.src.find("}", self.i)
        if end < 0:
            return None
        body = self.src[self.i + 1 : end]
        lo, comma, hi = body.partition(",")
        if not lo.isdigit() or (hi and not hi.isdigit()) or not lo.isascii() or not hi.isascii():
            return None
        n = int(lo)
        m = int(hi) if hi else None
        if n > _MAX_REPEAT or (m is not None and (m > _MAX_REPEAT or m < n)):
            self.err(f"invalid repeat count: {{{body}}}")
        self.i = end + 1
        return "{" + body + "}"

    # -- groups ------------------------------------------------------------------
    def java_flag_text(self, on: set, off: set) -> str:
        on_j = "iu" if "i" in on else ""
        off_j = "iu" if "i" in off else ""
        return on_j + ("-" + off_j if off_j else "")

    def open_group(self):
        if not self.stack:
            self.end_run()
        self.prev_kind = None
        rest = self.src[self.i :]
        saved = dict(self.flags)
        for p in self.pending:
            if p["state"] == "await" and len(self.stack) == p["target"] and not _flags_only(rest):
                p["entered"].append(len(self.out))
                p["target"] += 1
        if rest.startswith("(?P<") or (rest.startswith("(?<") and not rest.startswith(("(?<=", "(?<!"))):
            start = self.i + (4 if rest.startswith("(?P<") else 3)
            end = self.src.find(">", start)
            name = self.src[start:end] if end >= 0 else ""
            if end < 0 or not name or not all(ch.isalnum() or ch == "_" for ch in name):
                self.err("invalid named capture")
            if name in self.names:
                self.err("duplicate capture group name")
            self.names.add(name)
            self.openers.append((self.i, end + 1))
            self.i = end + 1
            self.groups += 1
            self.bodies.append(_Body())
            self.stack.append((saved, len(self.out)))
            self.out.append("(")  # Java names are stricter; the name is not needed
            self.atom_start = None
            return
        if rest.startswith("(?"):
            j = self.i + 2
            on, off, sign, saw = set(), set(), 1, False
            while True:
                c = self.src[j] if j < len(self.src) else ""
                if c in ("i", "m", "s", "U"):
                    (on if sign > 0 else off).add(c)
                    saw = True
                elif c == "-":
                    if sign < 0:
                        self.err("invalid or unsupported Perl syntax")
                    sign, saw = -1, False
                elif c in (":", ")"):
                    if sign < 0 and not saw:
                        self.err("invalid or unsupported Perl syntax")
                    break
                else:
                    self.err(f"invalid or unsupported Perl syntax: {rest[:4]}")
                j += 1
            jflags = self.java_flag_text(on, off)
            if c == ")":  # flags for the rest of the current group
                for f in on:
                    self.flags[f] = True
                for f in off:
                    self.flags[f] = False
                if jflags:
                    self.out.append("(?" + jflags + ")")
                self.i = j + 1
                self.atom_start = None
                return
            self.bodies.append(_Body())
            self.stack.append((saved, len(self.out)))
            for f in on:
                self.flags[f] = True
            for f in off:
                self.flags[f] = False
            self.out.append("(?" + jflags + ":")
            self.i = j + 1
            self.atom_start = None
            return
        self.groups += 1
        self.openers.append((self.i, self.i + 1))
        self.bodies.append(_Body())
        self.stack.append((saved, len(self.out)))
        self.out.append("(")
        self.i += 1
        self.atom_start = None

    def close_group(self):
        if not self.stack:
            self.err("unexpected )")
        for p in self.pending:
            if p["state"] == "await" and p["target"] >= len(self.stack):
                p["state"] = "unknown"
        saved, start = self.stack.pop()
        self.last_body, outer = self.bodies.pop(), self.bodies[-1]
        outer.choice |= self.last_body.choice
        outer.varies |= self.last_body.varies
        outer.bmp &= self.last_body.bmp
        outer.loops = max(outer.loops, self.last_body.loops)
        outer.repeats = max(outer.repeats, self.last_body.repeats)
        self.flags = saved
        self.out.append(")")
        self.i += 1
        self.atom_start = start
        self.last_quantified = False
        self.prev_kind = None

    # -- main loop ---------------------------------------------------------------
    def run(self) -> JavaRegex:
        src = self.src
        while self.i < len(src):
            c = src[self.i]
            if c == "(":
                self.open_group()
            elif c == ")":
                self.close_group()
            elif c == "|":
                if not self.stack:
                    self.top_alternation = True
                self.end_run()
                self.prev_kind = None
                depth = len(self.stack)
                for p in self.pending:
                    if (p["state"] == "await" and depth <= p["target"]) or (
                        p["state"] == "resolved" and p["depth"] < depth <= p["target"]
                    ):
                        p["state"] = "unknown"
                self.bodies[-1].choice = True
                self.out.append("|")
                self.i += 1
                self.atom_start = None
                self.last_quantified = False
            elif c == "[":
                self.parse_class()
            elif c in "*+?":
                self.i += 1
                self.quantifier(c)
            elif c == "{":
                rep = self.try_repeat()
                if rep is None:
                    self.atom("\\{")
                    self.i += 1
                else:
                    self.quantifier(rep)
            elif c == ".":
                self.atom("(?s:.)" if self.flags["s"] else ".")  # (?d): . excludes only \n
                self.i += 1
            elif c == "^":
                self.assertion("(?<![^\\n])" if self.flags["m"] else "\\A")
                self.i += 1
            elif c == "$":
                self.assertion("(?![^\\n])" if self.flags["m"] else "\\z")
                self.i += 1
            elif c == "\\":
                self.i += 1
                self.escape()
            else:
                self.atom(_hex(ord(c)) if not (c.isalnum() or c in " _-,:;'\"/<>=!@#%&~`") else c, literal=c)
                self.i += 1
        if self.stack:
            self.err("missing closing )")
        for p in self.pending:
            if p["state"] == "resolved" and p["kind"] is not None:
                text = _boundary(p["word"], None, p["kind"])
                text = f"(?-iu:{text})" if p["ci"] else text
                self.out[p["idx"]] = "(?:" + text + ")" if p["idx"] in self.wrapped else text
        self.end_run()
        required = "" if self.top_alternation or not self.runs else max(self.runs, key=len)
        # (?d): Java's . then excludes only \n, like RE2's (the pattern emits no Java ^ $ in
        # multi-line mode, the only other thing the flag changes)
        named, at = [], 0
        for g, (start, end) in enumerate(self.openers, 1):
            named += [src[at:start], f"(?P<g{g}>"]
            at = end
        source = "".join(named) + src[at:]
        flat, power = self.flat, _power(self.src)
        if not (flat and power == 1) and not _fits_re2(source):
            flat, power = True, 1  # only Java can run it
        return JavaRegex(self.src, "(?d)" + "".join(self.out), self.groups, required, flat, source, power)

    def next_kind(self) -> str | None:
        """What the next character of every match is, if the pattern fixes it."""
        c = self.peek()
        if c == "" or c in "()|[.^$*+?{":
            return None
        if self.flags["i"] and c.lower() in ("k", "s"):
            return None  # may match the Kelvin sign / long s
        if self.peek(1) in ("?", "*") or (self.peek(1) == "{" and self.src.startswith("{0", self.i + 1)):
            return None
        if c == "\\":
            e = self.peek(1)
            if e == "d" or (e == "w" and not self.flags["i"]):
                return None if self.peek(2) in ("?", "*", "{") else "word"
            if e in ("D", "W", "s", "S", "p", "P", "b", "B", "A", "z", "Q", "E", "x", "") or e.isdigit():
                return None
            if e.isalpha():
                return "nonword" if e in "aftnrv" and self.peek(2) not in ("?", "*", "{") else None
            return "nonword" if self.peek(2) not in ("?", "*", "{") else None
        return "word" if _is_word(c) else "nonword"

    def escape(self):
        e = self.peek()
        if e == "":
            self.err("trailing backslash at end of expression")
        if e == "A":
            self.i += 1
            self.assertion("\\A")
        elif e == "z":
            self.i += 1
            self.assertion("\\z")
        elif e in "bB":
            self.i += 1
            prev, nxt = self.prev_kind, self.next_kind()
            text = _boundary(e == "b", prev, nxt)
            # word boundaries are ASCII even under (?i): no case folding inside
            self.assertion(f"(?-iu:{text})" if self.flags["i"] else text)
            if prev is None and nxt is None:
                # decided once the next atom (possibly inside a group) is known
                self.pending.append(dict(idx=self.atom_start, word=e == "b", ci=self.flags["i"], state="await",
                                         depth=len(self.stack), target=len(self.stack), entered=[], kind=None,
                                         atom=None))
            self.prev_kind = prev  # zero-width: the previous character is unchanged
        elif e in "dDwW":
            self.i += 1
            base = _DIGIT if e in "dD" else _WORD
            kind = _kind_of(_complement(base) if e.isupper() else base)
            if self.flags["i"] and e in "wW":
                kind = None  # folded \w also matches the Kelvin sign and long s
                text = _class_of(base, e.isupper())
            else:
                text = "\\" + e  # Java's own \d \w are ASCII too, and faster than a range class
            self.atom(text, kind=kind, bmp=e.islower())
        elif e in "sS":
            self.i += 1
            self.atom(_class_of(_SPACE_PERL, e == "S"), kind="nonword" if e == "s" else None, bmp=e == "s")
        elif e in "pP":
            name, neg = self.read_property()
            self.atom(_java_property(name, neg, "atom"))
        elif e == "Q":
            end = self.src.find("\\E", self.i + 1)
            lit = self.src[self.i + 1 :] if end < 0 else self.src[self.i + 1 : end]
            self.i = len(self.src) if end < 0 else end + 2
            if lit:
                # each literal character is its own atom, so a quantifier that
                # follows applies to the last one only, as in RE2
                for ch in lit:
                    self.atom(_hex(ord(ch)), literal=ch)
        elif e == "E":
            self.i += 1  # a stray \E is ignored
        else:
            cp = self.read_escape_char()
            if cp is None:
                self.err(f"invalid escape sequence: \\{e}")
            self.atom(_hex(cp), literal=chr(cp))


@functools.lru_cache(maxsize=4096)
def translate(pattern: str) -> JavaRegex:
    """Translate an RE2 pattern into a java.util.regex pattern with the same matches."""
    if not isinstance(pattern, str):
        raise TypeError("pattern must be a string")
    return _Translator(pattern).run()


def first_match_groups_pattern(rx: JavaRegex) -> str:
    """A Java pattern matching the whole input whose groups are those of the
    leftmost match of ``rx`` (what ``Matcher.find`` and RE2's
    ``FindStringSubmatch`` report), for a single ``regexp_replace`` pass."""
    return "\\A(?s:.*?)(?:" + rx.pattern + ")(?s:.*)\\z"


@functools.lru_cache(maxsize=1024)
def _linear_search(pattern: str):
    """Whether RE2 finds ``pattern``, batch by batch (null stays null)."""

    @F.arrow_udf("boolean")
    def found(texts):
        import pyarrow.compute as pc

        return pc.match_substring_regex(texts, pattern)

    return found


@functools.lru_cache(maxsize=1024)
def _linear_groups(pattern: str, groups: int):
    """The groups of RE2's leftmost match of ``pattern``, empty texts where there is none."""

    @F.arrow_udf("array<string>")
    def extract(texts):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        found = pc.extract_regex(texts, pattern)
        columns = [pc.fill_null(found.field(i), "") for i in range(groups)]
        interleaved = pa.chunked_array(columns).combine_chunks() if columns else pa.array([], pa.string())
        n = len(texts)
        order = pa.array((np.arange(groups)[None, :] * n + np.arange(n)[:, None]).ravel())
        offsets = pa.array(np.arange(0, (n + 1) * groups, groups, dtype=np.int32))
        return pa.ListArray.from_arrays(offsets, interleaved.take(order))

    return extract


def search(col, rx: JavaRegex | str):
    """Unanchored RE2 search as a Spark predicate.

    When every match must contain a known literal, a byte-level ``contains``
    runs first and the regex engine only sees rows that can match."""
    if isinstance(rx, str):
        rx = translate(rx)
    can = col.contains(rx.required) if rx.required else None
    if rx.java:
        pred = col.rlike(rx.pattern)
    elif rx.flat and rx.power == 2:
        long = F.octet_length(col) > LONG_TEXT
        pred = F.when(long, _linear_search(rx.named)(F.when(long if can is None else long & can, col))).otherwise(col.rlike(rx.pattern))
    else:
        pred = _linear_search(rx.named)(col if can is None else F.when(can, col))
    return pred if can is None else can & pred


def extract_groups(col, rx: JavaRegex):
    """All groups of the leftmost match as an array, for patterns that are not Java's."""
    return _linear_groups(rx.named, rx.groups)(col)


def extract_group(col, rx: JavaRegex, i: int):
    """Group ``i`` of the leftmost match, ``''`` where there is none."""
    return F.regexp_extract(col, rx.pattern, i) if rx.java else F.get(extract_groups(col, rx), i - 1)
