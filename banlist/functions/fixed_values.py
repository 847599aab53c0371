"""Texts, patterns and formats that results must agree on.

Everything here is data. Changing a character changes results.
"""

from __future__ import annotations

# Exclusion patterns used when criteria name none.
DEFAULT_EXCLUDE_REGEXES = [r"^<\|.*?\|>$", r"^\|\|\|.*?\|\|\|$"]

# Markers.
SPACE_MARKER = "Ġ"
NEWLINE_MARKER = "Ċ"
ANSWER_MARKER = "####"
NEXT_QUESTION_MARKER = "Question"
NO_ANSWER = "[NULL]"
BLOCK_SEPARATOR = "\n###\n"
STOP_MARKERS = ["##", "####", "Answer:"]

# Sampling and selection defaults.
SAMPLE_SEED = 42
DEFAULT_ORDER = "least_frequent"

# Prompt texts.
SYSTEM_MESSAGE = "You are a helpful reasoning model."
QA_HEAD = "You are a helpful reasoning model.\n\n"
QA_BEFORE_QUESTION = "\n\nNow here is a new question:\n"
QA_TAIL = "\nThink step-by-step and provide your final short answer:\n"
JUDGE_HEAD = (
    "You are a strict judge of correctness. I will give you:\n"
    "1) A question.\n"
    "2) A 'correct' reference answer.\n"
    "3) A proposed answer from another model.\n\n"
    "Decide if the proposed answer is correct.\n"
    "Answer ONLY with 'YES' or 'NO'.\n\n"
)
JUDGE_QUESTION = "Question: "
JUDGE_REFERENCE = "\nReference Answer: "
JUDGE_PROPOSED = "\nProposed Answer: "
JUDGE_TAIL = "\nIs the proposed answer correct? Only respond 'YES' or 'NO'."

# Summary texts of a selection.
SUMMARY_FREQUENCY = "Frequency criterion: selected {n} tokens (leaf filter: {leaf}; order: {order})."
SUMMARY_SYNTHETIC = "Synthetic criterion: selected {n} tokens matching POS tags: {pos}."
SUMMARY_CUSTOM = "Custom criterion: selected {n} tokens."
SUMMARY_REGEX = "Regex criterion: selected {n} tokens matching pattern '{pattern}'."
SUMMARY_COMBINED = "Combined criterion: {n} tokens satisfy all sub-criteria."
SUMMARY_NO_PATTERN = "No regex pattern provided."
SUMMARY_NO_SUB_CRITERIA = "No sub-criteria provided."

# The characters Python's str.strip() removes, those int() ignores
# around a number, and the line ends str.splitlines() knows.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
NUMBER_WHITESPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
LINE_END = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\u2028\u2029]"
INTEGER = r"^[+-]?\p{Nd}+(?:_\p{Nd}+)*$"
