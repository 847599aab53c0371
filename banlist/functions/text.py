"""Scalar text functions as Spark columns.

All of them are built-in expressions: no Python runs per row. They work the
same on batch and on streaming DataFrames.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from banlist.functions.fixed_values import (
    ANSWER_MARKER,
    INTEGER,
    JUDGE_HEAD,
    JUDGE_PROPOSED,
    JUDGE_QUESTION,
    JUDGE_REFERENCE,
    JUDGE_TAIL,
    LINE_END,
    NEWLINE_MARKER,
    NEXT_QUESTION_MARKER,
    NO_ANSWER,
    NUMBER_WHITESPACE,
    SPACE_MARKER,
    WHITESPACE,
)
from banlist.functions.patterns import UntranslatablePattern, java_regex, python_test


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(text: Column | str) -> Column:
    """Trim Unicode white space at both ends (linear time, unlike a regex)."""
    return F.trim(_col(text), F.lit(WHITESPACE))


def strip_space_marker(token: Column | str) -> Column:
    """Drop the leading word-start markers of a vocabulary token."""
    return F.ltrim(_col(token), F.lit(SPACE_MARKER))


def remove_space_marker(token: Column | str) -> Column:
    """Drop every word-start marker of a vocabulary token."""
    return F.replace(_col(token), F.lit(SPACE_MARKER), F.lit(""))


def regex_search(text: Column | str, pattern: str) -> Column:
    """Whether the pattern is found anywhere. Java's engine searches where it can say
    what Python's pattern means, else Python's, batch by batch."""
    try:
        return _col(text).rlike(java_regex(pattern))
    except UntranslatablePattern:
        return python_test(pattern)(_col(text))


def regex_match_start(text: Column | str, pattern: str) -> Column:
    """True where the pattern matches from the first character on."""
    try:
        return _col(text).rlike(rf"\A(?:{java_regex(pattern)})")
    except UntranslatablePattern:
        return python_test(pattern, from_start=True)(_col(text))


def _after_last_marker(text: Column) -> Column:
    # Split from the left: in "a#####b" the marker is the first four signs.
    return F.element_at(F.split(text, ANSWER_MARKER, -1), -1)


def final_answer(text: Column | str) -> Column:
    """The text after the last answer marker, or else the last line with text."""
    text = _col(text)
    # A stripped text ends in a visible character, so its last line is the
    # last non-blank one.
    last_line = F.element_at(F.split(strip(text), LINE_END, -1), -1)
    return F.when(
        F.contains(text, F.lit(ANSWER_MARKER)), strip(_after_last_marker(text))
    ).otherwise(strip(last_line))


def same_final_answer(left: Column | str, right: Column | str) -> Column:
    return F.lower(final_answer(left)) == F.lower(final_answer(right))


def marked_answer(text: Column | str) -> Column:
    """Answer text of a raw output: cut at the next question, take what
    follows the last answer marker; a fixed text when there is no marker."""
    text = _col(text)
    own_part = F.element_at(F.split(text, NEXT_QUESTION_MARKER, 2), 1)
    return F.when(
        F.contains(text, F.lit(ANSWER_MARKER)), _after_last_marker(own_part)
    ).otherwise(F.lit(NO_ANSWER))


@functools.cache
def _digits() -> tuple[str, str]:
    """Every script's decimal digits, and their ASCII counterparts."""
    signs = [c for c in map(chr, range(0x80, sys.maxunicode + 1)) if c.isdecimal()]
    return "".join(signs), "".join(str(unicodedata.decimal(c)) for c in signs)


def parse_int(text: Column | str) -> Column:
    """The whole number a text spells, as canonical decimal text, else null.

    Sign, outer white space, single underscores between digits and any
    script's digits are accepted, at any length. Equal numbers have equal
    texts: ASCII digits without leading zeros, a minus only before non-zero.
    """
    bare = F.trim(_col(text), F.lit(NUMBER_WHITESPACE))
    plain = F.replace(bare, F.lit("_"), F.lit(""))
    plain = F.when(plain.rlike("[^0-9+-]"), F.translate(plain, *_digits())).otherwise(plain)
    core = F.ltrim(F.ltrim(plain, F.lit("+-")), F.lit("0"))
    sign = F.when(F.startswith(plain, F.lit("-")), F.lit("-")).otherwise(F.lit(""))
    number = F.when(core == "", F.lit("0")).otherwise(F.concat(sign, core))
    return F.when(bare.rlike(INTEGER), number)


def number_matches(output: Column | str, truth: Column | str) -> Column:
    """Whether two numbers from ``parse_int`` are equal; a missing one never is."""
    return F.coalesce(_col(truth) == _col(output), F.lit(False))


def judge_says_yes(response: Column | str) -> Column:
    return F.startswith(F.upper(strip(response)), F.lit("YES"))


def verdict(direct: Column, judge: Column | None = None) -> Column:
    if judge is None:
        return direct
    return direct | F.coalesce(judge, F.lit(False))


def is_chat_model(name: Column | str) -> Column:
    return F.lower(_col(name)).rlike("instruct|chat")


def example_text(question: Column | str, answer: Column | str) -> Column:
    return F.concat(
        F.lit("Question: "), strip(question), F.lit("\nAnswer: "), strip(answer), F.lit("\n")
    )


def judge_prompt(
    question: Column | str, reference: Column | str, proposed: Column | str
) -> Column:
    return F.concat(
        F.lit(JUDGE_HEAD),
        F.lit(JUDGE_QUESTION), _col(question),
        F.lit(JUDGE_REFERENCE), _col(reference),
        F.lit(JUDGE_PROPOSED), _col(proposed),
        F.lit(JUDGE_TAIL),
    )


def normalise_for_containment(text: Column | str) -> Column:
    return strip(F.lower(_col(text)))


def words(text: Column | str) -> Column:
    """Split a text into words without losing anything.

    A word after a space carries the space marker; a newline is a word of its
    own. ``unwords`` restores the text.
    """
    return F.filter(raw_words(text), lambda w: w != "")


def raw_words(text: Column | str) -> Column:
    """``words`` with empty entries in between."""
    marked = F.replace(_col(text), F.lit(" "), F.lit(" " + SPACE_MARKER))
    marked = F.replace(marked, F.lit("\n"), F.lit(f" {NEWLINE_MARKER} "))
    return F.split(marked, " ", -1)


def unwords(pieces: Column | str) -> Column:
    joined = F.array_join(_col(pieces), "")
    joined = F.replace(joined, F.lit(SPACE_MARKER), F.lit(" "))
    return F.replace(joined, F.lit(NEWLINE_MARKER), F.lit("\n"))
