"""Terms looked up in texts by their bytes."""

import random

import pyarrow as pa
import pytest
from conftest import physical

from termpulse.functions import substrings
from termpulse.operators import matching


def found(texts, terms):
    index = substrings.TermIndex(pa.array(terms, pa.string()))
    return [row for part in index.found(texts) for row in part.to_pylist()]


def same(got, texts, terms):
    assert len(got) == len(texts)
    for row, text in zip(got, texts):
        assert len(row) == len(set(row)) and set(row) == {w for w in terms if text and w in text}


@pytest.mark.parametrize("piece", [7, 64, 1 << 18])
@pytest.mark.parametrize("marks", [0, 1 << 23])
@pytest.mark.parametrize("alphabet", ["ab", "aab😊天é ", "abcdefgh天地玄"])
def test_lookup_against_a_scan(monkeypatch, piece, marks, alphabet):
    """Texts longer than a piece, terms of all classes of lengths, nulls, a slice of an array."""
    monkeypatch.setattr(substrings, "BYTES", piece)
    monkeypatch.setattr(substrings, "MARKS", marks)
    rng = random.Random(3)
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.choice([0, 3, 40, 200]))) for _ in range(40)]
    texts += [None, "", "a" * 300]
    sizes = (1, 2, 3, 4, 5, 7, 8, 9, 12, 15, 16, 17, 23, 31, 32, 33, 40, 64, 65, 130)
    terms = sorted({t[i : i + k] for t in texts if t for i in (0, 3, 11) for k in sizes} - {""})
    terms = [t for t in terms if rng.random() < 0.5] + ["zz", "q" * 20]
    same(found(pa.array(["cut", *texts, "cut"]).slice(1, len(texts)), terms), texts, terms)


def test_windows_end_with_their_text():
    texts = ["ab", "cd", "abcd", None, "abcdefgh", "ij"]
    terms = ["bc", "abc", "cdab", "abcdefghij", "hij", "d"]
    for cast in (pa.string(), pa.large_string()):
        same(found(pa.array(texts, cast), terms), texts, terms)


def test_few_terms_and_no_texts():
    for terms in ([], ["a"], ["abc" * 30]):
        same(found(pa.array(["a", None, "abc" * 31]), terms), ["a", None, "abc" * 31], terms)
    assert found(pa.array([], pa.string()), ["a"]) == []


def test_a_small_table_makes_no_windows(spark, make_posts):
    """The windows of a text were sorted in its row, a few microseconds for each character."""
    table = spark.createDataFrame([("ab", 1), ("bc", 2), (None, 3), ("", 4)], "word string, n int")
    hits = matching.terms_in_posts(make_posts("abc abc", None, "b c"), table, "word")
    plan = physical(hits)
    assert plan.count("ArrowEvalPython [") == 1 and "regexp_extract_all" not in plan
    assert sorted(map(tuple, hits.collect())) == [(1, "ab", 1), (1, "bc", 2)]
