import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import physical
from termpulse import settings as S
from termpulse.functions.python import python_tokenizer
from termpulse.operators import frequency as freq
from termpulse.operators import tokens
from termpulse.operators.lookup import WordTable, lookup_words
from termpulse.sources.stopwords import stopwords_of_lines


def as_dict(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r.n for r in df.collect()}


def test_counting_by_date(make_posts):
    posts = make_posts("北方天气转凉", "天气预报说有雨", "周末天气晴朗", dates=["2024-01-01"] * 2 + ["2024-01-02"])
    counts = as_dict(freq.word_frequency(posts), "date", "word")
    assert counts[("2024-01-01", "天气")] == 2
    assert counts[("2024-01-02", "天气")] == 1


def test_missing_dates_count_as_unknown(make_posts):
    posts = make_posts("aa", "aa bb", dates=[None, "d"])
    assert as_dict(freq.word_frequency(posts), "date", "word") == {
        ("unknown", "aa"): 1, ("d", "aa"): 1, ("d", "bb"): 1,
    }
    assert {r.date for r in freq.word_frequency(posts.drop("date")).collect()} == {"unknown"}
    assert {r.date for r in freq.top_words_by_date(freq.word_frequency(posts)).collect()} == {"d", "unknown"}
    kept = freq.word_frequency(posts, missing=None)
    assert {r.date for r in kept.collect()} == {"d", None}
    assert as_dict(freq.name_missing_dates(kept), "date", "word")[("unknown", "aa")] == 1


@pytest.mark.parametrize("by_date, columns", [(True, ["date", "word", "n"]), (False, ["word", "n"])])
def test_no_tokens_give_an_empty_table(make_posts, by_date, columns):
    counts = freq.word_frequency(make_posts("", None, "!", "7"), by_date)
    assert counts.columns == columns and counts.count() == 0
    assert freq.top_words_by_date(counts).count() == 0


def test_rollup_equals_total(make_posts):
    posts = make_posts("aa bb aa", "bb cc", "aa", dates=["x", "y", None])
    assert as_dict(freq.roll_up(freq.word_frequency(posts)), "word") == as_dict(
        freq.word_frequency(posts, False), "word"
    ) == {"aa": 3, "bb": 2, "cc": 1}


def test_stopword_table_and_list_agree(spark, make_posts):
    posts = make_posts("the cat the", "of cat")
    table = stopwords_of_lines(spark.createDataFrame([("the",), (" of ",)], "value string"))
    by_table = as_dict(freq.word_frequency(posts, False, table), "word")
    assert by_table == as_dict(freq.word_frequency(posts, False, ["the", "of"]), "word") == {"cat": 2}


def test_anti_join_is_broadcast_when_small(spark, make_posts):
    stop = spark.createDataFrame([("the",)], "word string")
    rows = tokens.remove_stopwords(tokens.word_rows(make_posts("the cat the")), stop)
    assert [r.word for r in rows.collect()] == ["cat"]
    assert "BroadcastHashJoin" in physical(rows) and "LeftAnti" in physical(rows)


def test_custom_tokenizer(make_posts):
    posts = make_posts("a-b-a", None)
    counts = freq.word_frequency(posts, False, ["b"], tokenizer=python_tokenizer(lambda s: s.split("-")))
    assert as_dict(counts, "word") == {"a": 2}
    counts = freq.word_frequency(posts, False, tokenizer=lambda c: F.split(c, "-"))
    assert as_dict(counts, "word") == {"a": 2, "b": 1}


def test_ties_go_by_word(make_posts):
    counts = freq.word_frequency(make_posts("zz aa mm", "bb bb"), False)
    assert [r.word for r in freq.top_words(counts, 3).collect()] == ["bb", "aa", "mm"]
    assert freq.top_words(counts, 0).count() == freq.top_words(counts, None).count() == 4


def test_top_words_by_date_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(f"d{rng.choice('aaaab')}", f"w{rng.randint(0, 60)}") for _ in range(3000)]
    counts = Counter(rows)
    df = spark.createDataFrame([(d, w, n) for (d, w), n in counts.items()], "date string, word string, n long")
    want = set()
    for d in ("da", "db"):
        mine = sorted(((-n, w) for (x, w), n in counts.items() if x == d))[:7]
        want |= {(d, i, w, -n) for i, (n, w) in enumerate(mine, 1)}
    for parts in (1, 16):
        got = freq.top_words_by_date(df.repartition(parts), 7)
        assert {tuple(r) for r in got.collect()} == want


def test_group_limit_runs_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).cast("string").alias("date"), F.col("id").cast("string").alias("word"), F.col("id").alias("n"))
    plan = physical(freq.top_words_by_date(df.repartition(4), 3))
    assert "WindowGroupLimit" in plan and "Partial" in plan and "Final" in plan


def test_top_words_is_a_top_k(make_posts):
    assert "TakeOrderedAndProject" in physical(freq.top_words(freq.word_frequency(make_posts("aa bb"), False)))


def test_no_python_in_core_plans(make_posts):
    plan = physical(freq.top_words_by_date(freq.word_frequency(make_posts("aa bb"))))
    assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan


def test_nested_lists(make_posts):
    lists = freq.top_words_by_date(freq.word_frequency(make_posts("aa bb aa", "cc", dates=["x", "y"])))
    nested = {r.date: [tuple(p) for p in r.words] for r in freq.as_nested_lists(lists).collect()}
    assert nested == {"x": [("aa", 2), ("bb", 1)], "y": [("cc", 1)]}


def test_cloud_weights(make_posts):
    rows = freq.cloud_weights(freq.word_frequency(make_posts("aa bb aa aa bb cc"), False), 2).collect()
    assert {r.word: r.weight for r in rows} == {"aa": 1.0, "bb": 0.666667}


def test_trend_matrix(make_posts):
    posts = make_posts("aa aa bb", "bb cc cc cc", "!", "aa", dates=["x", "y", "z", None])
    lists = freq.top_words_by_date(freq.word_frequency(posts), 1)
    got = {(r.date, r.word): r.n for r in freq.trend_matrix(lists, posts, 2).collect()}
    # bb is outside both lists of length one; z has no words; null is no date.
    assert got == {
        ("x", "aa"): 2, ("x", "cc"): 0, ("y", "aa"): 0, ("y", "cc"): 3, ("z", "aa"): 0, ("z", "cc"): 0,
    }


def test_long_lists_are_ranked_in_slices(spark, monkeypatch):
    df = spark.range(400).select((F.col("id") % 2).cast("string").alias("date"), F.col("id").cast("string").alias("word"), (F.col("id") % 7).alias("n"))
    want = {tuple(r) for r in freq.top_words_by_date(df, 150).collect()}
    monkeypatch.setattr(S, "GROUP_LIMIT", 100)
    assert {tuple(r) for r in freq.top_words_by_date(df, 150).collect()} == want
    assert len(want) == 300


@pytest.mark.parametrize("small", [True, False])
@pytest.mark.parametrize("hot", [0, 1, 1000])
def test_lookup_with_and_without_broadcast(spark, small, hot):
    words = ["hot"] * 300 + [f"w{i % 40}" for i in range(200)] + ["absent"] * 5
    rows = spark.createDataFrame(list(enumerate(words)), "id long, word string")
    values = [(w, float(len(w)), n) for w, n in Counter(words).items() if w != "absent"]
    table = spark.createDataFrame(values, "word string, v double, n long")
    got = lookup_words(rows, WordTable(table, "n", small), ["v"], hot=hot).collect()
    assert sorted((r.id, r.word, r.v) for r in got) == [
        (i, w, float(len(w))) for i, w in enumerate(words) if w != "absent"
    ]


def test_big_lookup_spreads_the_hot_word(spark):
    rows = spark.range(8000).select("id", F.when(F.col("id") < 7000, "hot").otherwise(F.col("id").cast("string")).alias("word"))
    table = rows.groupBy("word").agg(F.count(F.lit(1)).alias("n")).withColumn("v", F.col("n") * 2)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = lookup_words(rows, WordTable(table, "n", False), ["v"], hot=10)
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert sum(sizes) == 8000
    assert max(sizes) < 3 * 8000 / len(sizes)
