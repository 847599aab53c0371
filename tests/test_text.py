from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from banlist.functions import text
from banlist.functions.patterns import UntranslatablePattern, java_regex

# text, its final answer, its marked answer, the whole number it spells: worked by hand.
CASES = [
    ("", "", "[NULL]", None),
    ("   ", "", "[NULL]", None),
    ("####", "", "", None),
    ("a####", "", "", None),
    ("a#####b", "#b", "#b", None),
    ("1####2#### 3 ", "3", " 3 ", None),
    ("l1\r\nl2\n\n", "l2", "[NULL]", None),
    ("l1\x0bl2", "l2", "[NULL]", None),
    ("a\x85b", "b", "[NULL]", None),
    ("a\u2028b\u00a0 ", "b", "[NULL]", None),
    ("one\x1ctwo\x1dthree\x1e", "three", "[NULL]", None),
    ("x\n \n\t", "x", "[NULL]", None),
    ("no answer\r", "no answer", "[NULL]", None),
    ("####\n12\n", "12", "\n12\n", None),
    ("Q #### 5 Question: 6 #### 7", "7", " 5 ", None),
    ("Question #### 5", "5", "", None),
    ("a\n#### 4\nQuestion", "4\nQuestion", " 4\n", None),
    (" 1_000 ", "1_000", "[NULL]", "1000"),
    ("+5", "+5", "[NULL]", "5"),
    ("-7", "-7", "[NULL]", "-7"),
    ("-0", "-0", "[NULL]", "0"),
    ("000", "000", "[NULL]", "0"),
    ("-0012", "-0012", "[NULL]", "-12"),
    ("\u0661\u0662", "\u0661\u0662", "[NULL]", "12"),
    ("-\U0001d7d9\u0967", "-\U0001d7d9\u0967", "[NULL]", "-11"),
    ("\x1c 4 \x1f", "4", "[NULL]", None),
    ("9" * 40, "9" * 40, "[NULL]", "9" * 40),
    ("0" * 50 + "1", "0" * 50 + "1", "[NULL]", "1"),
    ("1,000", "1,000", "[NULL]", None),
    ("7.0", "7.0", "[NULL]", None),
    ("__1", "__1", "[NULL]", None),
    ("1__0", "1__0", "[NULL]", None),
    ("_1", "_1", "[NULL]", None),
    ("1_", "1_", "[NULL]", None),
    ("1 2", "1 2", "[NULL]", None),
    ("+", "+", "[NULL]", None),
    ("- 3", "- 3", "[NULL]", None),
    ("\u00b2", "\u00b2", "[NULL]", None),
]


@pytest.fixture(scope="module")
def scored(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, t string")
    return df.select(
        "i",
        "t",
        text.final_answer("t").alias("final"),
        text.marked_answer("t").alias("marked"),
        text.parse_int("t").alias("number"),
    ).orderBy("i").collect()


def test_answers_and_numbers(scored):
    for row, (given, final, marked, number) in zip(scored, CASES):
        assert (row.final, row.marked, row.number) == (final, marked, number), repr(given)


def test_final_answer_properties(spark):
    texts = _random_texts(300, 7)
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(
        "t",
        text.final_answer("t").alias("a"),
        text.final_answer(F.concat(F.lit("head#### "), "t")).alias("b"),
        text.final_answer(F.concat("t", F.lit("\n\n tail "))).alias("c"),
    ).collect()
    for row in got:
        assert row.a == row.a.strip()
        assert "####" not in row.a and row.a in row.t
        # The last marker wins over lines, and else the last line with text.
        assert row.b == (row.t.strip() if "####" not in row.t else row.a)
        assert "####" in row.t or row.c == "tail"


def _random_texts(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    bits = ["#", "####", "Question", "Question: ", " ", "\n", "\r\n", "\t", "\u00a0", "\x1e", "7",
            "42", "_", "-", "+", "a", "\u00c9", "\u00df", "\u2028", "\x85", "\u0663", ",", "."]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 9))) for _ in range(n)]


@pytest.fixture(scope="module")
def rows(spark):
    texts = [c[0] for c in CASES] + ["\u0130x", "\u0391\u03a3"] + _random_texts(400, 9)
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    return df.select(
        "t",
        text.strip("t").alias("stripped"),
        text.unwords(text.words("t")).alias("again"),
        F.lower("t").alias("low"),
    ).collect()


def test_strip_lower_and_words(rows):
    for r in rows:
        assert r.stripped == r.t.strip()
        assert r.low == r.t.lower()
        assert r.again == r.t


def test_long_numbers_compare(spark):
    df = spark.createDataFrame([("9" * 40, " +" + "9" * 40), ("9" * 40, "9" * 39 + "8")], "a string, b string")
    same = text.number_matches(text.parse_int("a"), text.parse_int("b"))
    assert [r[0] for r in df.select(same).collect()] == [True, False]


def test_scalars(spark):
    df = spark.createDataFrame(
        [(" yes ok", "Foo-Instruct", 3, 3), ("no", "base", None, 3), (None, "my-CHAT", 4, None)],
        "response string, model string, out int, gt int",
    )
    got = df.select(
        text.judge_says_yes("response").alias("yes"),
        text.is_chat_model("model").alias("chat"),
        text.number_matches("out", "gt").alias("right"),
        text.verdict(F.lit(False), text.judge_says_yes("response")).alias("verdict"),
    ).collect()
    assert [tuple(r) for r in got] == [
        (True, True, True, True),
        (False, False, False, False),
        (None, True, False, False),
    ]


def test_python_patterns(spark):
    values = ["<|x|>", "<|x|>\n", "<|a\nb|>", "|||IP|||", "x<|y|>", "a1", "a١"]
    df = spark.createDataFrame([(v,) for v in values], "t string")
    from banlist.operators.selection import not_excluded

    kept = [r[0] for r in df.where(not_excluded(None, "t")).collect()]
    assert kept == ["<|a\nb|>", "x<|y|>", "a1", "a١"]
    digits = [r[0] for r in df.where(text.regex_search("t", r"(?P<d>\d)\Z")).collect()]
    assert digits == ["a1", "a١"]


PATTERNS = [
    r"a\sb", r"[a&&b]", r"\\Z", r"[[x]", r"a{,2}b", r"(?a)\w", r"a{x}", r"a{", r"[]a]", r"[^]a]", r"\bw\b",
    r"(?P<my_name>a)(?P=my_name)", r"(?i)STRASSE|\u00c9", r"\d+", r"[\d_-]+$", r"\S", r"[\s,]", r"\Bb",
    r"(?#note)b", r"\v", r"x\Z", r"[a-c--]", r"(a)\1", r"\x41", r"\N{DIGIT ONE}", r"a|b|", r"(?<=a)b", r"}", r"]",
    r"[^\W\d_]", r"\.", r"(?s:a.b)", r"a.b", r"$", r"b$", r"[|~^]", r"(?a)\s\d",
]
SUBJECTS = [
    "", "a b", "a\x1cb", "a\x85b", "a\u00a0b", "&", "[", "x", "aab", "ab", "b", "a{x}", "a{", "]", "w", "w\u0301", "aa",
    "stra\u00dfe", "Strasse", "\u00e9", "\u0661", "1", "\u00bd", "_", "-", "\\", "Z", "\\Z", "x\n", "x", "A", "c\u0327b",
    "\x0b", "a\nb", "}", "^", "~", "\u4e00", "\u00b2", " 7", "\u2028",
]


def test_patterns_against_python(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(SUBJECTS)], "i int, t string")
    found = df.select(
        "i",
        F.array(*[text.regex_search("t", p) for p in PATTERNS]).alias("search"),
        F.array(*[text.regex_match_start("t", p) for p in PATTERNS]).alias("start"),
    ).orderBy("i").collect()
    for row, subject in zip(found, SUBJECTS):
        for k, p in enumerate(PATTERNS):
            assert row.search[k] == bool(re.search(p, subject)), (p, subject)
            assert row.start[k] == bool(re.match(p, subject)), (p, subject)


def test_patterns_without_counterpart():
    for p in (r"(a)?(?(1)b|x)", "(?x)a b"):
        with pytest.raises(UntranslatablePattern):
            java_regex(p)
    with pytest.raises(ValueError):
        java_regex("(")


def test_row_scoring_on_a_stream(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    df = spark.createDataFrame([("a\n#### 5", "5"), ("b", "c")], "output string, truth string")
    df.write.json(source)
    stream = spark.readStream.schema(df.schema).json(source)
    scored = stream.withColumn("right", text.same_final_answer("output", "truth"))
    q = (
        scored.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination(120)
    assert sorted(r.right for r in spark.read.parquet(out).collect()) == [False, True]
