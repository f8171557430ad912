import random

import pytest
from pyspark.sql import functions as F

from catalog import posts_view as V
from conftest import physical
from termpulse import settings as S
from termpulse.functions import score
from termpulse.operators import filters, matching, sampling
from termpulse.operators import sentiment as sent
from termpulse.plans.drilldown import word_trend
from termpulse.plans.report import hot_word_report

SENTENCES = [
    "这家面馆味道好，值得推荐",
    "房间隔音差，住得很失望",
    "列车九点整从北站出发",
    "孩子们在海边玩得很快乐",
    "那条短信是骗人的",
]


def test_lexicon_scores(make_posts):
    rows = sent.score_posts(make_posts(*SENTENCES)).orderBy("id").collect()
    assert [tuple(r)[-4:] for r in rows] == [
        (1.0, 10.0, "positive", 1), (0.0, 1.0, "negative", 0), (0.5, 5.5, "neutral", -1),
        (1.0, 10.0, "positive", 1), (0.0, 1.0, "negative", 0),
    ]


def test_overlapping_terms_count_each(make_posts):
    assert sent.score_posts(make_posts("好 糟糕")).first().sentiment_raw_score == 0.3333


@pytest.mark.parametrize(
    "positive, negative, expected",
    [(1, 7, (0.125, 2.12, "negative", 0)), (3, 2, (0.6, 6.4, "positive", 1)), (2, 3, (0.4, 4.6, "negative", 0))],
)
def test_rounding_and_inclusive_thresholds(make_posts, positive, negative, expected):
    pick = ("棒", "赞", "喜欢")[:positive] + ("差", "烂", "坏", "讨厌", "失望", "难过", "垃圾")[:negative]
    assert tuple(sent.score_posts(make_posts(" ".join(pick))).first())[-4:] == expected


@pytest.mark.parametrize("blank", [None, "", "   ", "　\n"])
def test_blank_text_is_neutral(make_posts, blank):
    assert tuple(sent.score_posts(make_posts(blank)).first())[-4:] == (0.5, 5.5, "neutral", -1)


def test_loaded_label_is_replaced(make_posts):
    posts = make_posts("好").withColumn("sentiment_label", F.lit(0))
    scored = sent.score_posts(posts)
    assert scored.columns.count("sentiment_label") == 1 and scored.first().sentiment_label == 1


def test_distribution(make_posts):
    rows = sent.sentiment_distribution(sent.narrow_scores(make_posts(*SENTENCES))).collect()
    assert {r.sentiment: (r.n, r.ratio, r.avg_score) for r in rows} == {
        "positive": (2, 0.4, 5.5), "negative": (2, 0.4, 5.5), "neutral": (1, 0.2, 5.5),
    }


def test_distribution_of_nothing(make_posts):
    rows = sent.sentiment_distribution(sent.narrow_scores(make_posts("x").limit(0))).collect()
    assert {tuple(r) for r in rows} == {(c, 0, 0.0, 5.5) for c in ("positive", "negative", "neutral")}


def test_shares_hide_empty_classes(make_posts):
    dist = sent.sentiment_distribution(sent.narrow_scores(make_posts("好", "好", "差")))
    assert {tuple(r) for r in sent.distribution_shares(dist).collect()} == {("正面", 2, 66.7), ("负面", 1, 33.3)}


def test_lexicon_table_gives_the_same_scores(spark, make_posts):
    posts = make_posts(*SENTENCES, "好 糟糕", None, " ", "无")
    rows = [(t, 1) for t in S.POSITIVE_TERMS] + [(t, -1) for t in S.NEGATIVE_TERMS]
    lexicon = spark.createDataFrame(rows, "term string, polarity int")
    got = {r.id: r.raw for r in sent.lexicon_scores_by_join(posts, lexicon).collect()}
    want = {r.id: r.raw for r in sent.with_raw_score(posts).collect()}
    assert got == want


# --- matching ---------------------------------------------------------------------------


def random_texts(seed, n=120, alphabet="aab😊天 ", longest=40):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, longest))) for _ in range(n)]


@pytest.mark.parametrize("broadcast", [True, False])
def test_all_ways_of_matching_agree(spark, make_posts, monkeypatch, broadcast):
    monkeypatch.setattr(matching, "fits_broadcast", lambda df: broadcast)
    texts = [*random_texts(1), None]
    words = sorted({t[i : i + k] for t in random_texts(2, 15) for i in (0, 3) for k in (1, 2, 3, 4, 5, 7, 8, 9, 17)} - {""})
    posts = make_posts(*texts)
    want = {(w, i) for i, t in enumerate(texts, 1) if t for w in words if w in t}
    table = spark.createDataFrame([(w,) for w in words], "word string")
    for asked, ranked in ((words, False), (table, False), (table, True)):
        rows = [tuple(r) for r in matching.word_post_matches(posts, asked, ranked=ranked).collect()]
        assert len(rows) == len(set(rows)) and set(rows) == want


def test_long_word_lists_take_the_join(make_posts):
    posts = make_posts("w7 w650", "w12")
    words = [f"w{i}" for i in range(S.INLINE_WORDS + 200)]
    found = matching.word_post_matches(posts, words)
    assert {tuple(r) for r in found.collect()} >= {("w7", 1), ("w650", 1), ("w12", 2)}
    assert {tuple(r) for r in found.collect()} == {
        (w, i) for i, t in ((1, "w7 w650"), (2, "w12")) for w in words if w in t
    }


@pytest.mark.parametrize("letters", [50, 90])
def test_terms_with_few_and_many_initials(spark, make_posts, letters):
    assert 50 < matching.CLASS_CHARACTERS < 90
    initials = [chr(0x4E00 + i) for i in range(letters)]
    words = [c + tail for c in initials for tail in ("", "]x", "-ab^")]
    table = spark.createDataFrame([(w,) for w in words], "word string")
    texts = [initials[0] + "]x", "q" + initials[-1] + "-ab^", "]x", "\\x{4E00}"]
    found = {tuple(r) for r in matching.word_post_matches(make_posts(*texts), table).collect()}
    assert found == {(w, i) for i, t in enumerate(texts, 1) for w in words if w in t}


def test_no_cross_join_in_matching(spark, make_posts):
    table = spark.createDataFrame([("a", 1)], "word string, n long")
    for df in (
        matching.word_post_matches(make_posts("a"), ["a"]),
        matching.word_post_matches(make_posts("a"), table, ranked=True),
        matching.word_post_matches(make_posts("a"), table),
    ):
        assert "NestedLoop" not in physical(df) and "Cartesian" not in physical(df)


def test_regex_is_an_option(make_posts):
    posts = make_posts("a+b", "aab", None)
    ids = lambda df: {r.id for r in df.collect()}
    assert ids(filters.containing(posts, "a+b")) == {1}
    assert ids(filters.containing(posts, "a+b", regex=True)) == {2}
    assert {tuple(r) for r in matching.word_post_matches(posts, ["a+b"], regex=True).collect()} == {("a+b", 2)}


# --- sampling -----------------------------------------------------------------------------


def test_sample_keeps_small_groups_and_caps_big_ones(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") < 2000, "big").when(F.col("id") < 2050, "fits").otherwise(F.concat(F.lit("g"), F.col("id"))).alias("word"))
    draws = [
        {(r.word, r.id) for r in sampling.sample_per_group(rows.repartition(p), ["word"], 50).collect()}
        for p in (1, 16)
    ]
    assert draws[0] == draws[1]
    sizes = {}
    for word, _ in draws[0]:
        sizes[word] = sizes.get(word, 0) + 1
    assert sizes["big"] == 50 and sizes["fits"] == 50 and sizes["g2999"] == 1
    other = {(r.word, r.id) for r in sampling.sample_per_group(rows, ["word"], 50, seed=43).collect()}
    assert other != draws[0]
    assert sampling.sample_per_group(rows, ["word"], None).count() == 3000


def test_sample_is_cut_before_the_shuffle(spark):
    rows = spark.range(100).select("id", (F.col("id") % 2).alias("word")).repartition(4)
    plan = physical(sampling.sample_per_group(rows, ["word"], 5))
    assert "WindowGroupLimit" in plan and "Partial" in plan


# --- words ---------------------------------------------------------------------------------


def test_word_sentiment_golden(spark):
    posts = filters.filter_by_date(V.posts(spark, "/root/testdata/sf0.01"), V.START, V.END)
    rows = sent.analyze_words(posts, V.WORDS, V.LEXICON, max_samples=S.SAMPLES_PER_WORD).collect()
    got = {
        r.word: (r.total_count, r.avg_score, r.positive_count, r.negative_count, r.positive_ratio) for r in rows
    }
    assert got == {
        "der": (322, 8.38, 35, 6, 0.7),
        "scum": (25, 3.13, 0, 25, 0.0),
        "the": (431, 7.93, 30, 7, 0.6),
        "zzzz": (0, 5.5, 0, 0, 0.0),
    }


def test_majority_ignores_neutral_posts(make_posts):
    rows = sent.analyze_words(make_posts("w 好", "w 好", "w 差", "w", "w", "w", "v 好", "v 差"), ["w", "v", "u"]).collect()
    got = {r.word: (r.sentiment, r.positive_count, r.negative_count, r.neutral_count, r.positive_ratio, r.negative_ratio) for r in rows}
    assert got == {
        "w": ("positive", 2, 1, 3, 0.3333, 0.1667),
        "v": ("neutral", 1, 1, 0, 0.5, 0.5),
        "u": ("neutral", 0, 0, 0, 0.0, 0.0),
    }


def test_exact_mode_scores_all_matches(make_posts):
    posts = make_posts(*(["w 好"] * 60 + ["w 差"] * 60))
    capped = sent.analyze_words(posts, ["w"], max_samples=50).first()
    exact = sent.analyze_words(posts, ["w"]).first()
    assert capped.total_count == exact.total_count == 120
    assert capped.positive_count + capped.negative_count == 50
    assert (exact.positive_count, exact.negative_count, exact.avg_score) == (60, 60, 5.5)


def test_word_count_and_total_count_differ(spark, make_posts):
    ranked = spark.createDataFrame([("cat", 3)], "word string, n long")
    row = sent.top_words_sentiment(make_posts("cat cat cat", "concatenate"), ranked).first()
    assert (row.word_count, row.total_count) == (3, 2)


def test_rankings_of_any_length(spark, make_posts):
    ranked = spark.createDataFrame([(f"w{i:03d}", i) for i in range(S.INLINE_WORDS + 50)], "word string, n long")
    rows = sent.top_words_sentiment(make_posts("w003 好", "w549 差 w003"), ranked).collect()
    assert len(rows) == S.INLINE_WORDS + 50
    assert {r.word: (r.word_count, r.total_count) for r in rows if r.total_count} == {"w003": (3, 2), "w549": (549, 1)}


def test_exact_scores_take_one_scan(spark, sf):
    posts = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    assert physical(sent.analyze_words(posts, ["the", "and"])).count("FileScan") == 1


def test_samples_are_an_option_of_the_pipelines(make_posts):
    posts = make_posts(*["热词 好"] * 30, dates=["2024-01-01"] * 30)
    with hot_word_report(posts) as exact, hot_word_report(posts, max_samples=5) as capped:
        assert exact.words.first().total_count == capped.words.first().total_count == 30
    assert word_trend(posts, "热.", regex=True, max_samples=5).series.count() == 1


def test_word_days(make_posts):
    posts = make_posts(
        "w 好", "w 差", "w 好", "w", "x 好",
        dates=["2024-01-02", "2024-01-02 10:00:00", "2024-01-01", "bad", "2024-01-03"],
    )
    trend = word_trend(posts, "w")
    assert {(r.day, r.avg_score, r.side) for r in trend.series.collect()} == {
        ("2024-01-02", 5.5, "positive"), ("2024-01-01", 10.0, "positive"),
    }
    s = trend.summary.first()
    assert (s.points, s.mean_score, s.max_score, s.max_day, s.min_score, s.min_day) == (
        2, 7.75, 10.0, "2024-01-01", 5.5, "2024-01-02",
    )
    assert {(r.day, r.is_max, r.is_min) for r in trend.marked().collect()} == {
        ("2024-01-01", 1, 0), ("2024-01-02", 0, 1),
    }
    assert word_trend(posts, "nothing").series.count() == 0
    assert word_trend(posts, "nothing").summary.count() == 0


def test_first_day_of_equal_extremes(make_posts):
    posts = make_posts("w 好", "w 好", "w 差", "w 差", dates=["2024-01-04", "2024-01-02", "2024-01-03", "2024-01-01"])
    s = word_trend(posts, "w").summary.first()
    assert (s.max_day, s.min_day) == ("2024-01-02", "2024-01-01")


@pytest.mark.parametrize(
    "value, band, side",
    [(6.5, "positive", "positive"), (6.4, "neutral", "positive"), (5.5, "neutral", "positive"), (5.4, "neutral", "negative"), (4.6, "neutral", "negative"), (4.5, "negative", "negative")],
)
def test_display_bands(spark, value, band, side):
    row = spark.range(1).select(score.score_band(F.lit(value)), score.trend_side(F.lit(value))).first()
    assert tuple(row) == (band, side)


def test_hot_word_table(spark):
    words = spark.createDataFrame([(1, "a", 5, 6.25, "positive"), (2, "b", 4, 5.5, "odd")], "rank int, word string, word_count long, avg_score double, sentiment string")
    assert [tuple(r) for r in sent.hot_word_table(words).orderBy("rank").collect()] == [
        (1, "a", 5, "6.2", "正面"), (2, "b", 4, "5.5", "中性"),
    ]


# --- the whole report --------------------------------------------------------------------------


def test_report_of_an_empty_range(make_posts):
    with hot_word_report(make_posts("aa bb"), start="2030-01-01") as report:
        assert report.words.count() == report.daily.count() == report.frequencies.count() == 0
        assert {r.n for r in report.distribution.collect()} == {0}


def test_report_does_not_depend_on_partitioning(spark, sf):
    results = []
    for parts in (1, 16):
        posts = V.posts(spark, sf).repartition(parts)
        with hot_word_report(posts, V.START, V.END, 10, V.STOPWORDS, V.LEXICON) as report:
            results.append(sorted(tuple(r) for r in report.words.collect()))
    assert results[0] == results[1] and len(results[0]) == 10


def test_long_reports_take_the_join(make_posts, monkeypatch):
    posts = make_posts("aa bb 好", "bb cc 差")
    with hot_word_report(posts) as report:
        want = sorted(tuple(r) for r in report.words.collect())
    monkeypatch.setattr(S, "INLINE_WORDS", 1)
    with hot_word_report(posts) as report:
        assert sorted(tuple(r) for r in report.words.collect()) == want


def test_report_keeps_no_text_on_the_executors(make_posts):
    with hot_word_report(make_posts("aa")) as report:
        plan = report.words._jdf.queryExecution().optimizedPlan().toString()
        relations = [line for line in plan.splitlines() if "InMemoryRelation" in line]
        assert relations and not any("content" in line for line in relations)


def test_repeats_of_a_term_are_not_gathered(spark, make_posts):
    table = spark.createDataFrame([("ab",), ("abc",), ("b",)], "word string")
    found = matching.terms_in_posts(make_posts("abcababxabcb", "b"), table, "word")
    assert "hashpartitioning(id" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == [(1, "ab"), (1, "abc"), (1, "b"), (2, "b")]
