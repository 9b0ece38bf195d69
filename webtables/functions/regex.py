"""RE2 patterns in the spelling of the JVM's regular expressions.

Rules are written in RE2's dialect; Spark runs them with ``java.util.regex``. A pattern is read once on the driver,
token by token with the flags that hold at each place, and written again so that the JVM finds the same
matches in the same groups:

* flags ``i m s U`` and their scopes are followed while reading. Only ``i`` is written as a flag, with Unicode case
  folding; ``.``, ``^``, ``$`` and greediness are written as what they mean at their place;
* ``\\Q..\\E`` is a literal; ``\\b`` and ``\\B`` are ASCII borders; escapes with another meaning in the JVM are code points;
* a class is read as ranges of code points and Unicode properties and written from these, so that nested brackets,
  ``&&``, POSIX names and negated escapes inside it keep RE2's meaning;
* braces that are no repetition are literals; stacked repetitions, look-around, back-references, atomic groups and other
  things that RE2 does not have are refused with a ``ValueError``.
"""

from __future__ import annotations

import re
from functools import lru_cache

LAST = 0x10FFFF

# The code points of the ASCII classes, as ranges.
DIGIT = ((0x30, 0x39),)
SPACE = ((0x09, 0x0A), (0x0C, 0x0D), (0x20, 0x20))
WORD = ((0x30, 0x39), (0x41, 0x5A), (0x5F, 0x5F), (0x61, 0x7A))
POSIX = {
    "alnum": ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A)),
    "alpha": ((0x41, 0x5A), (0x61, 0x7A)),
    "ascii": ((0x00, 0x7F),),
    "blank": ((0x09, 0x09), (0x20, 0x20)),
    "cntrl": ((0x00, 0x1F), (0x7F, 0x7F)),
    "digit": DIGIT,
    "graph": ((0x21, 0x7E),),
    "lower": ((0x61, 0x7A),),
    "print": ((0x20, 0x7E),),
    "punct": ((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E)),
    "space": ((0x09, 0x0D), (0x20, 0x20)),
    "upper": ((0x41, 0x5A),),
    "word": WORD,
    "xdigit": ((0x30, 0x39), (0x41, 0x46), (0x61, 0x66)),
}
# Escapes that stand for one character, and the general categories of Unicode.
CONTROLS = {"a": 0x07, "f": 0x0C, "n": 0x0A, "r": 0x0D, "t": 0x09, "v": 0x0B}
CATEGORIES = "C Cc Cf Co Cs L Ll Lm Lo Lt Lu M Mc Me Mn N Nd Nl No P Pc Pd Pe Pf Pi Po Ps S Sc Sk Sm So Z Zl Zp Zs".split()
#: Repetitions of at most this many (fixed value).
MOST = 1000

_ASCII_WORD = "[0-9A-Z_a-z]"
_EDGE = f"(?:(?<!{_ASCII_WORD})(?={_ASCII_WORD})|(?<={_ASCII_WORD})(?!{_ASCII_WORD}))"
_NO_EDGE = f"(?:(?<!{_ASCII_WORD})(?!{_ASCII_WORD})|(?<={_ASCII_WORD})(?={_ASCII_WORD}))"
_COUNT = re.compile(r"\{([0-9]+)(,([0-9]*))?\}")
_FLAGS = re.compile(r"\(\?([imsU]*)(-([imsU]+))?([:)])")
_NAME = re.compile(r"\(\?P?<([0-9A-Z_a-z]+)>")
_HEX = re.compile(r"x(?:([0-9A-Fa-f]{2})|\{([0-9A-Fa-f]+)\})")
_OCTAL = re.compile(r"0[0-7]{0,2}|[1-7][0-7]{1,2}")
_POSIX = re.compile(r"\[:(\^?)([a-z]+):\]")
_PROPERTY = re.compile(r"([pP])(?:([A-Z])|\{(\^?)([A-Za-z_]+)\})")


def literal(code: int) -> str:
    """A character that means itself, in a class or outside."""
    ch = chr(code)
    if ch.isascii() and (ch.isalnum() or ch in " _,:;<>=!\"'%/@`"):
        return ch
    return ch if code >= 0xA0 and ch.isprintable() else f"\\x{{{code:X}}}" if not (ch.isascii() and ch.isprintable()) else "\\" + ch


def complement(ranges) -> tuple:
    out, at = [], 0
    for a, b in sorted(ranges):
        if a > at:
            out.append((at, a - 1))
        at = max(at, b + 1)
    return (*out, (at, LAST)) if at <= LAST else tuple(out)


def class_text(ranges, properties=(), negated: bool = False) -> str:
    """A class of these ranges and properties (already in the JVM's spelling)."""
    items = [literal(a) if a == b else f"{literal(a)}-{literal(b)}" for a, b in ranges]
    if not items and not properties:  # nothing, or anything
        return r"(?s:.)" if negated else r"(?!)"
    return "[" + "^" * negated + "".join([*items, *properties]) + "]"


class _Reader:
    def __init__(self, pattern: str):
        self.pattern, self.at, self.groups = pattern, 0, 0
        self.names: set[str] = set()

    def fail(self, what: str):
        return ValueError(f"{what} in {self.pattern!r}")

    def take(self, rule: re.Pattern):
        found = rule.match(self.pattern, self.at)
        if found:
            self.at = found.end()
        return found

    def starts(self, text: str) -> bool:
        return self.pattern.startswith(text, self.at)

    def alternatives(self, flags: frozenset, depth: int) -> str:
        """Up to the end of the group; ``flags`` may change on the way, and the change ends with the group."""
        out: list[str] = []
        repeatable = False
        while self.at < len(self.pattern):
            ch = self.pattern[self.at]
            if ch == ")":
                if not depth:
                    raise self.fail("unmatched )")
                return "".join(out)
            if ch == "|":
                self.at += 1
                out.append("|")
                repeatable = False
            elif ch in "*+?" or (ch == "{" and _COUNT.match(self.pattern, self.at)):
                if not repeatable:
                    raise self.fail("nothing to repeat, or repeated twice,")
                out.append(self.repetition(flags))
                repeatable = False
            elif ch == "(":
                text, flags, repeatable = self.group(flags, depth)
                out.append(text)
            elif self.starts("\\Q"):
                body, _, rest = self.pattern[self.at + 2 :].partition("\\E")
                self.at = len(self.pattern) - len(rest)
                out += [literal(ord(c)) for c in body]
                repeatable = repeatable or bool(body)
            else:
                out.append(self.single(ch, flags))
                repeatable = True
        if depth:
            raise self.fail("missing )")
        return "".join(out)

    def repetition(self, flags: frozenset) -> str:
        counted = self.take(_COUNT)
        if counted:
            low, high = int(counted[1]), counted[3]
            if low > MOST or (high and (int(high) > MOST or int(high) < low)):
                raise self.fail("bad repetition count")
            text = counted[0]
        else:
            text = self.pattern[self.at]
            self.at += 1
        lazy = self.starts("?")
        self.at += lazy
        return text + "?" * (lazy != ("U" in flags))

    def group(self, flags: frozenset, depth: int) -> tuple[str, frozenset, bool]:
        """A group as (text, flags after it, whether it can be repeated)."""
        named = self.take(_NAME)
        if named:
            if named[1] in self.names:
                raise self.fail("repeated group name")
            self.names.add(named[1])
            self.groups += 1
            own = f"(?<{named[1]}>" if re.fullmatch("[A-Za-z][A-Za-z0-9]*", named[1]) else "("
            return self.closed(own, flags, depth), flags, True
        set_ = self.take(_FLAGS)
        if set_:
            now = (flags | set(set_[1])) - set(set_[3] or "")
            fold = "" if ("i" in now) == ("i" in flags) else "iu" if "i" in now else "-iu"
            if set_[4] == ")":
                if not set_[1] and not set_[3]:
                    raise self.fail("missing flags")
                return (f"(?{fold})" if fold else ""), frozenset(now), False
            return self.closed(f"(?{fold}:", frozenset(now), depth), flags, True
        if self.starts("(?"):
            raise self.fail("look-around or another group that RE2 does not have")
        self.at += 1
        self.groups += 1
        return self.closed("(", flags, depth, opened=True), flags, True

    def closed(self, own: str, flags: frozenset, depth: int, opened: bool = True) -> str:
        inside = self.alternatives(flags, depth + 1)
        self.at += 1
        return own + inside + ")"

    def single(self, ch: str, flags: frozenset) -> str:
        self.at += 1
        if ch == ".":
            return "(?s:.)" if "s" in flags else r"[^\n]"
        if ch == "^":
            return r"(?:\A|(?<=\n))" if "m" in flags else r"\A"
        if ch == "$":
            return r"(?=\n|\z)" if "m" in flags else r"\z"
        if ch == "[":
            return self.brackets()
        if ch != "\\":
            return literal(ord(ch))
        nxt = self.pattern[self.at : self.at + 1]
        if nxt in ("A", "z"):
            self.at += 1
            return "\\" + nxt
        if nxt in ("b", "B"):
            self.at += 1
            return _EDGE if nxt == "b" else _NO_EDGE
        known = self.escaped_class()
        if known:
            # RE2 does not fold the case of these.
            text = class_text(*known)
            return f"(?-iu:{text})" if "i" in flags else text
        return literal(self.code())

    def escaped_class(self) -> tuple[tuple, tuple] | None:
        """``\\d \\s \\w``, their negations and ``\\p`` as (ranges, properties); the backslash is behind us."""
        nxt = self.pattern[self.at : self.at + 1]
        if nxt and nxt in "dswDSW":
            self.at += 1
            ranges = {"d": DIGIT, "s": SPACE, "w": WORD}[nxt.lower()]
            return (ranges if nxt.islower() else complement(ranges)), ()
        if nxt and nxt in "pP":
            found = self.take(_PROPERTY)
            if not found:
                raise self.fail("bad property")
            name = found[2] or found[4]
            out = (found[1] == "P") != bool(found[3])
            if name == "Any":
                return ((), ()) if out else (((0, LAST),), ())
            kind = name if name in CATEGORIES else f"Is{name}"
            return (), (f"\\{'P' if out else 'p'}{{{kind}}}",)
        return None

    def code(self) -> int:
        """The one code point of an escape; the backslash is behind us."""
        found = self.take(_HEX)
        if found:
            code = int(found[1] or found[2], 16)
            if code > LAST:
                raise self.fail("no such character")
            return code
        found = self.take(_OCTAL)
        if found:
            return int(found[0], 8)
        ch = self.pattern[self.at : self.at + 1]
        self.at += 1
        if ch in CONTROLS and ch:
            return CONTROLS[ch]
        if ch and ch in "123456789":
            raise self.fail("back-reference")
        if ch and ch.isascii() and not ch.isalnum():
            return ord(ch)
        raise self.fail(f"unknown escape \\{ch}")

    def brackets(self) -> str:
        """A class; its opening bracket is behind us."""
        negated = self.starts("^")
        self.at += negated
        ranges, properties, first = [], [], True
        while first or not self.starts("]"):
            if self.at >= len(self.pattern):
                raise self.fail("missing ]")
            first = False
            posix = self.take(_POSIX)
            if posix:
                if posix[2] not in POSIX:
                    raise self.fail("unknown class name")
                ranges += complement(POSIX[posix[2]]) if posix[1] else POSIX[posix[2]]
                continue
            if self.starts("\\"):
                self.at += 1
                known = self.escaped_class()
                if known:
                    ranges += known[0]
                    properties += known[1]
                    continue
                low = self.code()
            else:
                low = self.one()
            high = low
            if self.starts("-") and not self.starts("-]"):
                self.at += 1
                if self.starts("\\"):
                    self.at += 1
                    high = self.code()
                else:
                    high = self.one()
                if high < low:
                    raise self.fail("bad range")
            ranges.append((low, high))
        self.at += 1
        return class_text(ranges, properties, negated)

    def one(self) -> int:
        if self.at >= len(self.pattern):
            raise self.fail("missing ]")
        self.at += 1
        return ord(self.pattern[self.at - 1])


@lru_cache(maxsize=4096)
def compile_regex(pattern: str) -> tuple[str, int]:
    """The JVM's spelling of an RE2 pattern, and the number of its groups; a bad pattern is a ``ValueError``."""
    reader = _Reader(pattern)
    text = reader.alternatives(frozenset(), 0)
    return "(?d)" + text, reader.groups
