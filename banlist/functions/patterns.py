"""Python regular expressions in Java's spelling.

Column functions search with Java's engine. A pattern written for Python is
read sign by sign and put down so that Java finds the same; what has no
counterpart (conditional groups, verbose mode, some flags) is refused here and
left to Python's own engine.
"""

from __future__ import annotations

import re
import unicodedata
import warnings
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = r"\p{L}\p{N}_"
_ASCII_WORD = "A-Za-z0-9_"
_SPACE = r"\x{1c}-\x{1f}\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_ASCII_SPACE = r"\t-\r "
_QUANTIFIER = re.compile(r"\{(\d*)(,?)(\d*)\}")
_GROUP = re.compile(r"\(\?P<(\w+)>|\(\?P=(\w+)\)|\(\?([a-zA-Z]*)(-[a-zA-Z]+)?([:)])|\(\?\(|\(\?#")


class UntranslatablePattern(ValueError):
    """The pattern means something that Java's engine cannot say."""


def java_regex(pattern: str) -> str:
    """The Java spelling of a pattern for Python's ``re`` on texts."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore", FutureWarning)
            re.compile(pattern)
    except re.error as error:
        raise ValueError(f"not a regular expression: {pattern!r}: {error}") from error
    return _Translator(pattern).whole()


def python_test(pattern: str, from_start: bool = False) -> Callable[[Column], Column]:
    """A test by Python's engine: search, or match at the start. Null stays null."""

    # Nested, so that executors need no copy of this package.
    def test(texts: pd.Series) -> pd.Series:
        import re

        compiled = re.compile(pattern)
        find = compiled.match if from_start else compiled.search
        return pd.Series([None if t is None else find(t) is not None for t in texts], dtype="object")

    return F.pandas_udf(test, "boolean")


class _Translator:
    def __init__(self, pattern: str) -> None:
        self.pattern = pattern
        self.at = 0
        self.ascii = False
        self.names: dict[str, str] = {}

    def refuse(self, what: str) -> UntranslatablePattern:
        return UntranslatablePattern(f"{what} in {self.pattern!r} has no counterpart")

    def whole(self) -> str:
        # Only a newline ends a line, and case folds beyond ASCII.
        out = ["(?du)"]
        while self.at < len(self.pattern):
            sign = self.pattern[self.at]
            if sign == "\\":
                out.append(self.escape(inside=False))
            elif sign == "[":
                out.append(self.char_set())
            elif self.pattern.startswith("(?", self.at):
                out.append(self.group())
            elif sign == "{":
                out.append(self.quantifier())
            else:
                out.append("\\" + sign if sign in "]}" else sign)
                self.at += 1
        return "".join(out)

    def classes(self) -> dict[str, str]:
        if self.ascii:
            return {"w": _ASCII_WORD, "d": "0-9", "s": _ASCII_SPACE}
        return {"w": _WORD, "d": r"\p{Nd}", "s": _SPACE}

    def escape(self, inside: bool) -> str:
        sign = self.pattern[self.at + 1]
        start = self.at
        self.at += 2
        members = self.classes()
        if sign in members:
            return members[sign] if inside else f"[{members[sign]}]"
        if sign.lower() in members:
            return f"[^{members[sign.lower()]}]"
        if sign in "bB" and not inside:
            w = f"[{members['w']}]"
            other = ("?!", "?=") if sign == "b" else ("?=", "?!")
            return f"(?:(?<={w})({other[0]}{w})|(?<!{w})({other[1]}{w}))"
        if sign == "b":
            return r"\x08"
        if sign == "Z":
            return r"\z"
        if sign == "v":
            return r"\x0b"
        if sign == "N":
            end = self.pattern.index("}", start)
            name = self.pattern[start + 3 : end]
            self.at = end + 1
            return f"\\x{{{ord(unicodedata.lookup(name)):x}}}"
        if sign == "U":
            self.at = start + 10
            return f"\\x{{{int(self.pattern[start + 2 : self.at], 16):x}}}"
        if sign.isdigit():
            digits = re.match(r"0[0-7]{0,2}|[0-3][0-7]{2}|\d{1,2}", self.pattern[start + 1 :])[0]
            self.at = start + 1 + len(digits)
            if digits[0] == "0" or len(digits) == 3 or inside:
                return f"\\x{{{int(digits, 8):x}}}"
            # Brackets keep a digit behind a back reference out of it.
            return f"(?:\\{digits})"
        if sign in "afnrtxuA":
            return "\\" + sign
        return "\\" + sign if ord(sign) < 128 else sign

    def char_set(self) -> str:
        out = ["["]
        self.at += 1
        if self.pattern.startswith("^", self.at):
            out.append("^")
            self.at += 1
        first = True
        while first or self.pattern[self.at] != "]":
            sign = self.pattern[self.at]
            if sign == "\\":
                out.append(self.escape(inside=True))
            else:
                out.append("\\" + sign if sign in "[]&^" or (first and sign == "-") else sign)
                self.at += 1
            first = False
        self.at += 1
        return "".join(out) + "]"

    def group(self) -> str:
        found = _GROUP.match(self.pattern, self.at)
        if not found:
            # Look-around, atomic and plain groups are spelled alike.
            end = re.compile(r"\(\?(?:<?[=!]|[:>])").match(self.pattern, self.at)
            if not end:
                raise self.refuse(self.pattern[self.at : self.at + 4])
            self.at = end.end()
            return end[0]
        text = found[0]
        at, self.at = self.at, found.end()
        if found[1]:
            # Java allows no underscore in names.
            self.names[found[1]] = f"named{len(self.names)}"
            return f"(?<{self.names[found[1]]}>"
        if found[2]:
            return f"\\k<{self.names[found[2]]}>"
        if text == "(?(":
            raise self.refuse("a conditional group")
        if text == "(?#":
            self.at = self.pattern.index(")", self.at) + 1
            return ""
        flags, off = found[3], found[4] or ""
        if set(flags + off) & set("xL") or ("a" in flags and at) or (found[5] == ":" and "a" in flags):
            raise self.refuse(f"the flags of {text}")
        self.ascii |= "a" in flags
        kept = "".join(f for f in flags if f in "ims")
        own = "(?" + kept + off
        if found[5] == ")":
            folded = own + ")" if kept else ""
            return folded + ("(?-u)" if "a" in flags else "")
        return own + ":"

    def quantifier(self) -> str:
        found = _QUANTIFIER.match(self.pattern, self.at)
        if not found or found[0] == "{}":
            self.at += 1
            return "\\{"
        self.at = found.end()
        low, comma, high = found.groups()
        return "{" + (low or "0") + comma + high + "}"
