"""RE2-style patterns on Spark's Java regex engine."""

from __future__ import annotations

import re
from functools import lru_cache
from re import _constants as sc
from re import _parser as sre

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = r"\t\n\f\r "
_BOUNDARY = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
# whitespace as Unicode defines it, for trimming and collapsing
_SPACES = "\t\n\x0b\x0c\r \x85\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
UNICODE_SPACE = "[\\t\\n\\x0B\\f\\r \\x85\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]"


def _edge(items, at_end: bool) -> tuple[str | None, bool]:
    """Class text of the word characters a sequence opens (or ends) with, None when others may; and whether it may be empty."""
    found = ""
    for op, arg in reversed(items) if at_end else items:
        empty = False
        if op is sc.LITERAL:
            one = chr(arg) if re.fullmatch(r"[A-Za-z0-9_]", chr(arg)) else None
        elif op is sc.IN:
            one = ""
            for kind, value in arg:
                word = {sc.CATEGORY_DIGIT: "0-9", sc.CATEGORY_WORD: r"\w"}.get(value) if kind is sc.CATEGORY else None
                if kind is sc.LITERAL and re.fullmatch(r"[A-Za-z0-9_]", chr(value)):
                    word = chr(value)
                elif kind is sc.RANGE and re.fullmatch(r"09|az|AZ", "".join(map(chr, value))):
                    word = "-".join(map(chr, value))
                one = None if word is None or one is None else one + word
        elif op is sc.SUBPATTERN:
            one, empty = _edge(arg[3], at_end)
        elif op is sc.MAX_REPEAT:
            one, empty = _edge(arg[2], at_end)
            empty = empty or arg[0] == 0
        elif op is sc.BRANCH:
            sides = [_edge(branch, at_end) for branch in arg[1]]
            one = None if any(c is None for c, _ in sides) else "".join(c for c, _ in sides)
            empty = any(e for _, e in sides)
        else:
            return None, False
        if one is None:
            return None, False
        found += one
        if not empty:
            return found, False
    return found, True


def _boundaries(items, out: list[str]) -> list[str]:
    """Java spelling of every word boundary, in their order: one look where a word surely follows or ends there."""
    for i, (op, arg) in enumerate(items):
        if op is sc.AT and arg is sc.AT_BOUNDARY:
            first, may_end = _edge(items[i + 1:], False)
            last, may_open = _edge(items[:i], True)
            if first and not may_end:
                # the characters are looked at first: that is cheaper than looking behind at every place
                letters = "".join(sorted({c + c.swapcase() if c.isalpha() else c for c in re.findall(r"\\w|.-.|.", first)}))
                letters += "a-zA-Z" if re.search("a-z|A-Z", first) else ""
                out.append(f"(?=[{letters}])(?<!\\w)")
            elif last and not may_open:
                out.append(r"(?!\w)")
            else:
                out.append(_BOUNDARY)
        elif op is sc.SUBPATTERN:
            _boundaries(arg[3], out)
        elif op in (sc.MAX_REPEAT, sc.MIN_REPEAT):
            _boundaries(arg[2], out)
        elif op is sc.BRANCH:
            for branch in arg[1]:
                _boundaries(branch, out)
    return out


@lru_cache(maxsize=None)
def to_java(pattern: str) -> str:
    r"""Spell ``\s``, ``\S``, ``\b``, ``.`` and ``$`` so Java reads them as RE2 does."""
    marks = _boundaries(list(sre.parse(pattern)), []) if r"\b" in pattern else []
    if len(marks) != pattern.count(r"\b"):
        marks = [_BOUNDARY] * pattern.count(r"\b")
    marks = iter(marks)
    out, i, in_class = [], 0, False
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            nxt = pattern[i + 1]
            if nxt == "s":
                out.append(_SPACE if in_class else f"[{_SPACE}]")
            elif nxt == "S":
                out.append(f"[^{_SPACE}]")
            elif nxt == "b" and not in_class:
                out.append(next(marks))
            elif nxt == "_":
                out.append("_")
            else:
                out.append(ch + nxt)
            i += 2
            continue
        if in_class:
            in_class = ch != "]"
            # a bare & or [ has a meaning of its own inside a Java class
            out.append("\\" + ch if ch in "&[" else ch)
        elif ch == "[":
            in_class = True
            out.append(ch)
            if pattern[i + 1] == "^":
                out.append("^")
                i += 1
        elif ch == ".":
            out.append(r"[^\n]")
        elif ch == "$":
            out.append(r"\z")
        else:
            out.append(ch)
        i += 1
    return "".join(out)


def matches(col: Column, pattern: str) -> Column:
    return F.regexp_like(col, F.lit(to_java(pattern)))


def extract(col: Column, pattern: str, group: int = 1) -> Column:
    """Group of the first match, '' when there is none."""
    return F.regexp_extract(col, to_java(pattern), group)


def extract_all(col: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(col, F.lit(to_java(pattern)), F.lit(group))


def replace(col: Column, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(col, to_java(pattern), by)


def position(col: Column, pattern: str) -> Column:
    """1-based start of the first match, 0 when there is none."""
    return F.regexp_instr(col, F.lit(to_java(pattern)))


def to_int(text: Column) -> Column:
    return text.try_cast("int")


def non_empty(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def first_rule(col: Column, rules, default: str = "") -> Column:
    """Value of the first (pattern, value) rule that matches."""
    out = None
    for rule in rules:
        cond = matches(col, rule[0])
        out = F.when(cond, F.lit(rule[1])) if out is None else out.when(cond, F.lit(rule[1]))
    return out.otherwise(F.lit(default))


def trim_space(col: Column) -> Column:
    return F.btrim(col, F.lit(_SPACES))


def collapse_space(col: Column) -> Column:
    return F.regexp_replace(col, f"{UNICODE_SPACE}+", " ")


def any_of(words) -> str:
    """Pattern for a list of literal words."""
    special = set("\\.+*?()[]{}|^$-")
    return "|".join("".join("\\" + c if c in special else c for c in w) for w in words)
