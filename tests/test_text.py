import re

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from termpulse.functions import arrays, text
from termpulse.functions.python import CHARACTERS, TEXTS, python_tokenizer

X = F.col("x")


def test_cleaning(values):
    cases = {
        "看http://t.cn/abc好 再见": "看 再见",
        "天气好@小明 你好": "你好",
        "@小明 你好": "@小明 你好",
        "a\u3000\u3000b": "a b",
        " x https://a.b/c?d=e\ty ": "x y",
        "me@you @ @@a a@": "@ a@",
        "a\x1cb\x85c": "a b c",
        "": "",
    }
    assert values(cases, text.clean_text(X)) == list(cases.values())


def test_cleaning_null(values):
    assert values([None], text.clean_text(X)) == [None]


SPACES = "[ \t\n\r\f\v\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def plain_clean(s: str) -> str:
    s = re.sub(r"http[s]?://\S+", "", s)
    s = re.sub(r"\S+@\S+", "", s)
    return re.sub(r"\s+", " ", s).strip()


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab@ @ \u3000\n:/.http天好\U0001f60a"), max_size=30), min_size=1, max_size=30))
def test_cleaning_like_plain_regexes(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string")
    got = [r.v for r in df.select("i", text.clean_text(X).alias("v")).orderBy("i").collect()]
    assert got == [plain_clean(t) for t in texts]


@pytest.mark.parametrize(
    "token, kept",
    [
        ("12", False), ("٣٤", False), ("²²", False), ("①②", False),
        ("ⅣⅤ", True), ("一二", True),
        ("!!", False), ("😊😊", False),
        ("__", True), ("a1", True), ("café", True),
        ("x", False),
    ],
)
def test_token_filters(values, token, kept):
    assert values([token], text.keep_word(X)) == [kept]
    assert kept == (len(token) >= 2 and not token.isdigit() and bool(re.search(r"\w", token)))


# Digits that Unicode gained after the version the JVM's regular expressions know.
NEWER_DIGITS = [*range(0x11F50, 0x11F5A), *range(0x16AC0, 0x16ACA), *range(0x1E4F0, 0x1E4FA)]


def test_digit_class_is_complete(values):
    """Every code point: all-digit words are those Python calls digits."""
    points = [chr(c) for c in range(0x110000) if chr(c).isdigit() and c not in NEWER_DIGITS]
    near = [chr(c) for c in range(0x110000) if chr(c).isnumeric() and not chr(c).isdigit()]
    assert all(values(points, text.is_number(X)))
    assert not any(values(near, text.is_number(X)))


def test_single_letters_need_min_length_one(values):
    assert values(["a", "é", "好", "7"], text.keep_word(X, min_len=1)) == [False, True, True, False]


def test_stopwords_are_exact_and_case_sensitive(values):
    got = values(["The the then of 12 cat"], text.tokenize(X, ["the", "of"]))
    assert got == [["The", "then", "cat"]]


def test_tokenize_keeps_order_and_repeats(values):
    assert values(["b a1 b, 天气真好 b_c!"], text.tokenize(X)) == [["a1", "天气", "气真", "真好", "b_c"]]
    assert values(["bb aa bb"], text.tokenize(X)) == [["bb", "aa", "bb"]]


def test_tokenize_cuts_cjk_from_latin(values):
    assert values(["abc天气ñ_1x"], text.tokenize(X)) == [["abc", "天气", "ñ_1x"]]
    assert values(["abc天气好ñ_1x"], text.tokenize(X, cjk="run")) == [["abc", "天气好", "ñ_1x"]]
    assert values(["a好b 天"], text.tokenize(X, min_len=1)) == [["好", "天"]]
    assert values(["天气好 abcd"], text.tokenize(X, min_len=3)) == [["abcd"]]


def test_tokenize_null_and_empty(values):
    assert values([None, "", "  ", "!"], text.tokenize(X)) == [[], [], [], []]


def test_tokenize_lowercase_is_optional(values):
    assert values(["The CAT"], text.tokenize(X)) == [["The", "CAT"]]
    assert values(["The CAT"], text.tokenize(X, lowercase=True)) == [["the", "cat"]]


def test_whitespace_tokenizer_only_checks_length(values):
    assert values(["a the 12 !!\u3000http://x.y"], text.tokenize_whitespace(X)) == [
        ["the", "12", "!!", "http://x.y"]
    ]


def test_bigrams(values):
    assert values(["今天a好 天气好"], text.cjk_bigrams(X)) == [["今天", "天气", "气好"]]
    assert values(["abc", ""], text.cjk_bigrams(X)) == [[], []]


def test_windows_respect_code_points(values):
    got = values(["a😊bc"], text.char_windows(X, F.lit(2), F.lit(3)))
    assert got == [["a😊b", "😊bc", "bc"]]


def test_python_tokenizer(spark, values):
    tok = python_tokenizer(lambda s: s.split("-"))
    assert values(["a-b", None, ""], tok(X)) == [["a", "b"], [], []]


def test_word_counts_inside_a_row(values):
    words = F.split(X, " ")
    got = values(["b a b c b"], arrays.count_words(words))[0]
    assert [(w.word, w.tf) for w in got] == [("a", 1), ("b", 3), ("c", 1)]
    got = values(["b a b"], arrays.word_positions(words))[0]
    assert [(w.word, w.at) for w in got] == [("a", [1]), ("b", [0, 2])]


def test_empty_arrays_inside_a_row(values):
    none = F.filter(F.split(X, " "), lambda w: F.lit(False))
    assert values(["a"], arrays.count_words(none)) == [[]]
    assert values(["a"], arrays.word_positions(none)) == [[]]


def test_python_tokenizer_holds_the_words_of_few_texts():
    split = python_tokenizer(lambda s: s.split("-")).func
    texts = [f"a-{i}" for i in range(1000)] + ["b" * (CHARACTERS // 2), "", None] * 4
    made = list(split(iter([pa.array(texts, pa.string())])))
    assert max(map(len, made)) <= TEXTS
    assert max(sum(len(w) for words in part.to_pylist() for w in words) for part in made) <= 1.5 * CHARACTERS
    assert [w for part in made for w in part.to_pylist()] == [t.split("-") if t else [] for t in texts]
