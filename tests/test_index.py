"""The stored index of n-grams: the same rows as a scan, from fewer blocks."""

import random
import re
from pathlib import Path

import pytest

from termpulse.operators import filters
from termpulse.plans.drilldown import word_trend
from termpulse.sinks import index

WORDS = ["good", "bad", "天气", "很好", "去公园", "a.b", "😀x", "day", "q"]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rng = random.Random(4)
    rows = [(i, f"2024-01-{i % 9 + 1:02}", " ".join(rng.choices(WORDS, k=rng.randint(0, 5)))) for i in range(200)]
    rows += [(200, "2024-01-01", None), (201, None, "rare bird\nz"), (202, "2024-01-02", "x" * 50_000 + "rare")]
    posts = spark.createDataFrame(rows, "id long, date string, content string").repartition(3).sortWithinPartitions("id")
    folder = str(tmp_path_factory.mktemp("store") / "index")
    index.write_index(posts, folder, block_rows=10, buckets=5)
    return posts.cache(), folder


@pytest.mark.parametrize("word", [*WORDS, "rare", "z", "good bad", "很", "oo", "nothing", "", "ｘ", "x" * 40])
def test_same_posts_as_a_scan(spark, stored, word):
    posts, folder = stored
    found = index.posts_with(spark, folder, word)
    assert found.columns == posts.columns
    assert sorted(found.collect()) == sorted(filters.containing(posts, word).collect())


@pytest.mark.parametrize("word", ["go+d", "b[aeiou]d", "ra.e", "天.", "(good|bad) day", "d.*q", "z$", "(?i)RARE", r"a\.b", "x{30}", "colou?r"])
def test_same_posts_as_a_scan_by_regex(spark, stored, word):
    posts, folder = stored
    want = filters.containing(posts, word, regex=True)
    assert sorted(index.posts_with(spark, folder, word, regex=True).collect()) == sorted(want.collect())


def test_drill_down_over_the_index(spark, stored):
    posts, folder = stored
    for word in ("good", "天气"):
        found = index.posts_with(spark, folder, word)
        assert word_trend(found, word).series.orderBy("day").collect() == word_trend(posts, word).series.orderBy("day").collect()
        assert filters.word_context(found, word, 7).collect() == filters.word_context(posts, word, 7).collect()


def test_other_blocks_are_not_read(spark, tmp_path):
    rows = [(i, "rare" if i == 57 else f"common text {i}") for i in range(100)]
    folder = tmp_path / "index"
    index.write_index(spark.createDataFrame(rows, "id long, content string").coalesce(1), str(folder), block_rows=10)
    blocks = sorted(Path(folder, "posts").glob("_block=*"))
    assert len(blocks) == 10
    assert [r[0] for r in index.candidate_blocks(spark, str(folder), ["ra", "ar", "re"]).collect()] == [5]
    for block in blocks:
        if block.name != "_block=5":
            for file in block.glob("*.parquet"):
                file.write_bytes(b"a task that reads this fails")
    assert [r.id for r in index.posts_with(spark, str(folder), "rare").collect()] == [57]
    with pytest.raises(Exception):
        index.posts_with(spark, str(folder), "common").collect()


def test_required_text_is_in_every_match():
    rng = random.Random(5)
    atoms = ["a", "b", "ab", ".", "[ab]", "[^a]", "a*", "b?", "a+", "b{1,2}", "a{0,1}", "(ab)", "(a)?", r"\.", r"\w", "a+?", "(a(b)c)*", "c", "[a[b]]"]
    held = 0
    for _ in range(3000):
        pattern = "".join(rng.choices(atoms, k=rng.randint(1, 5)))
        pieces = index.required_text(pattern)
        if "[a[b]]" in pattern:
            continue  # a class of Java's own
        for _ in range(5):
            text = "".join(rng.choices("abc.", k=rng.randint(0, 8)))
            if re.search(pattern, text):
                held += bool(pieces)
                assert all(p in text for p in pieces), (pattern, text, pieces)
    assert held > 300
    assert index.required_text("go+d [xy]weather") == ["go", "d ", "weather"]
    assert index.required_text("a|b") == index.required_text("(?i)ab") == index.required_text(r"\Qab\E") == []
