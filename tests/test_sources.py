import codecs
import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import physical
from termpulse import read_custom_posts, read_labelled_posts
from termpulse.functions.dates import parse_bound, parse_timestamp
from termpulse.plans.drilldown import word_trend
from termpulse.plans.report import hot_word_report
from termpulse.plans.summary import corpus_summary, date_range
from termpulse.operators.filters import filter_by_date, non_empty, word_context
from termpulse.sinks import reports
from termpulse.sinks.posts import write_posts
from termpulse.sources import posts as src
from termpulse.sources.stopwords import default_stopwords, read_stopwords


def write(path, content, encoding="utf-8"):
    path.write_bytes(content.encode(encoding))
    return str(path)


LABELLED = (
    "text,label,label_name,date\n"
    '"今天, 很好",3,happy,2020-01-21\n'
    '"two\nlines ""quoted""",1,surprise,2020-02-01 13:45:00\n'
    "NA,0,angry,NaN\n"
    "x,2,strange,2020-03-01\n"
)


def test_labelled_csv(spark, tmp_path):
    df = read_labelled_posts(spark, write(tmp_path / "a.csv", LABELLED))
    assert df.columns == ["id", "date", "content", "label", "emotion", "sentiment_label", "source"]
    rows = df.orderBy("id").collect()
    assert [r.id for r in rows] == [1, 2, 3, 4]
    assert [r.content for r in rows] == ["今天, 很好", 'two\nlines "quoted"', None, "x"]
    assert [r.date for r in rows] == ["2020-01-21", "2020-02-01 13:45:00", None, "2020-03-01"]
    assert [r.label for r in rows] == [3, 1, 0, 2]
    assert [r.sentiment_label for r in rows] == [1, -1, 0, None]
    assert {r.source for r in rows} == {"微博-疫情"}


def test_missing_files(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        read_labelled_posts(spark, str(tmp_path / "none.csv"))
    with pytest.raises(FileNotFoundError):
        read_custom_posts(spark, str(tmp_path / "none.csv"))
    with pytest.warns(UserWarning):
        assert read_stopwords(spark, str(tmp_path / "none.txt")).count() == 0


@pytest.mark.parametrize("content", ["content", "text", "review", "comment", "内容", "文本", "评论"])
@pytest.mark.parametrize("date", ["date", "日期"])
def test_custom_aliases(spark, tmp_path, content, date):
    path = write(tmp_path / "a.csv", f"{date},{content},extra\n2024-01-01,你好,1\n")
    row = read_custom_posts(spark, path).first()
    assert row.asDict() == {
        "id": 1, "date": "2024-01-01", "content": "你好", "label": None, "source": "自定义数据",
    }


def test_first_alias_wins_and_given_columns_stay(spark):
    df = spark.createDataFrame([("c", "r", "d", "t", "s", 5)], "text string, review string, date string, time string, source string, label int")
    row = src.normalize_custom(df).first()
    assert (row.content, row.date, row.source, row.label) == ("c", "d", "s", 5)


def test_required_columns(spark):
    with pytest.raises(ValueError, match="content"):
        src.normalize_custom(spark.createDataFrame([("a",)], "date string"))
    with pytest.raises(ValueError, match="date"):
        src.normalize_custom(spark.createDataFrame([("a",)], "content string"))


CUSTOM = "内容,日期\n天气好,2024-01-01\n\"第二,行\n换行\",2024-01-02\n"


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "gbk", "gb2312"])
def test_charsets(spark, tmp_path, encoding):
    before = spark.conf.get("spark.sql.legacy.javaCharsets", None)
    df = read_custom_posts(spark, write(tmp_path / "a.csv", CUSTOM, encoding))
    assert [(r.id, r.content) for r in df.orderBy("id").collect()] == [(1, "天气好"), (2, "第二,行\n换行")]
    assert spark.conf.get("spark.sql.legacy.javaCharsets", None) == before


def test_directory_with_both_charsets(spark, tmp_path):
    write(tmp_path / "a.csv", CUSTOM, "gbk")
    write(tmp_path / "b.csv", CUSTOM)
    write(tmp_path / "c.csv", CUSTOM, "gbk")
    rows = read_custom_posts(spark, str(tmp_path)).orderBy("id").collect()
    assert [r.id for r in rows] == [1, 2, 3, 4, 5, 6]
    assert [r.content for r in rows] == ["天气好", "第二,行\n换行"] * 3


def test_unknown_charset(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"content,date\n\xff\xff\x81,2024-01-01\n")
    with pytest.raises(ValueError, match="UTF-8"):
        read_custom_posts(spark, str(tmp_path / "a.csv"))


def test_ids_over_many_files(spark, tmp_path):
    for f in range(5):
        lines = "".join(f"t{f}-{i},2024-01-01\n" for i in range(f * 7 + 1))
        write(tmp_path / f"part{f}.csv", "text,date\n" + lines)
    rows = read_custom_posts(spark, str(tmp_path)).collect()
    want = [f"t{f}-{i}" for f in range(5) for i in range(f * 7 + 1)]
    assert {r.id: r.content for r in rows} == dict(enumerate(want, 1))


@pytest.mark.parametrize("encoding", ["utf-8", "gbk"])
def test_ids_over_file_splits(spark, tmp_path, encoding):
    write(tmp_path / "a.csv", "text,date\n" + "".join(f"天{i},2024-01-01\n" for i in range(3000)), encoding)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        df = read_custom_posts(spark, str(tmp_path), multi_line=False)
        if encoding == "utf-8":
            assert df.rdd.getNumPartitions() > 3
        assert {r.id: r.content for r in df.collect()} == {i + 1: f"天{i}" for i in range(3000)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_charset_check_can_be_skipped(spark, tmp_path, monkeypatch):
    path = write(tmp_path / "a.csv", CUSTOM, "utf-8-sig")
    monkeypatch.setattr(src, "split_by_charset", None)
    assert read_custom_posts(spark, path, utf8=True).count() == 2


def test_stopwords(spark, tmp_path):
    path = write(tmp_path / "s.txt", "的\n 了 \n\n的\n\u3000是\n")
    assert sorted(r.word for r in read_stopwords(spark, path).collect()) == sorted(["的", "了", "是"])
    assert {"the", "nicht", "一个"} <= set(default_stopwords())


def test_pandas(spark):
    pdf = pd.DataFrame({"date": ["2024-01-01", None], "content": ["a", "b"]})
    assert [tuple(r) for r in src.posts_from_pandas(spark, pdf).collect()] == [("2024-01-01", "a"), (None, "b")]


# --- dates -------------------------------------------------------------------------


def test_parse_timestamp(values):
    texts = ["2020-01-05", "2020-1-5", "2020/1/5 13:45", "20200105", " 2020-01-05T01:02:03 ", "x", "", None, "2020-13-01"]
    day = dt.datetime(2020, 1, 5)
    assert values(texts, parse_timestamp(F.col("x"))) == [
        day, day, day.replace(hour=13, minute=45), day, day.replace(hour=1, minute=2, second=3),
        None, None, None, None,
    ]


def test_parse_bound():
    assert parse_bound("") is None and parse_bound(None) is None
    assert parse_bound("2020-1-5") == parse_bound("20200105") == dt.datetime(2020, 1, 5)
    assert parse_bound("2020/01/05 13:45") == dt.datetime(2020, 1, 5, 13, 45)
    for bad in ("x", "2020-13-01", "2020-01"):
        with pytest.raises(ValueError):
            parse_bound(bad)


DATES = ["2024-01-01", "2024-01-02", "2024-01-02 00:00:01", "2024-01-03", "bad", None]


@pytest.fixture
def dated(make_posts):
    return make_posts(*"abcdef", dates=DATES)


def ids(df):
    return sorted(r.id for r in df.collect())


def test_date_filter(dated):
    assert ids(filter_by_date(dated, "2024-01-02", "2024-01-02")) == [2]
    assert ids(filter_by_date(dated, "2024-01-02", "2024-01-02", end_of_day=True)) == [2, 3]
    assert ids(filter_by_date(dated, end="2024-01-02 00:00:01")) == [1, 2, 3]
    assert ids(filter_by_date(dated, start="2024-01-02")) == [2, 3, 4]
    assert ids(filter_by_date(dated)) == ids(filter_by_date(dated, "", "")) == [1, 2, 3, 4, 5, 6]


def test_bad_bounds(dated):
    assert ids(filter_by_date(dated, "2024-01-02", "soon")) == [1, 2, 3, 4, 5, 6]
    with pytest.raises(ValueError):
        filter_by_date(dated, "2024-01-02", "soon", strict=True)
    with pytest.raises(ValueError):
        hot_word_report(dated, "soon")


def test_no_date_column(dated):
    bare = dated.drop("date")
    assert filter_by_date(bare, "2024-01-02") is bare
    assert tuple(date_range(bare).first()) == (None, None)
    assert tuple(corpus_summary(bare).first()) == (6, None, None)


def test_stored_timestamps_are_pushed_down(spark, tmp_path, dated):
    path = str(tmp_path / "t")
    dated.select("id", parse_timestamp(F.col("date")).alias("date")).write.parquet(path)
    df = filter_by_date(spark.read.parquet(path), "2024-01-02", "2024-01-02")
    assert ids(df) == [2]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(date), GreaterThanOrEqual(date,2024-01-02T00:00)" in plan


def test_day_partitions_are_pruned(spark, tmp_path, dated):
    path = str(tmp_path / "t")
    typed = dated.select("id", parse_timestamp(F.col("date")).alias("date"))
    typed.withColumn("day", F.col("date").cast("date")).write.partitionBy("day").parquet(path)
    stored = spark.read.parquet(path)
    df = filter_by_date(stored, "2024-01-02", "2024-01-02", end_of_day=True, day_col="day")
    assert ids(df) == [2, 3]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


def test_summary(dated):
    assert tuple(corpus_summary(dated).first()) == (6, "2024-01-01", "2024-01-03")
    assert tuple(date_range(dated).first()) == (dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 3))


def test_non_empty(make_posts):
    assert ids(non_empty(make_posts("a", "", None, " "))) == [1, 4]


def test_word_context(make_posts):
    posts = make_posts("xa", None, "b", "ya", "a.a")
    assert [r.content for r in word_context(posts, "a", 2).collect()] == ["xa", "ya"]
    assert [r.content for r in word_context(posts, "a.", 5).collect()] == ["a.a"]
    assert word_context(posts.drop("content"), "a", 2).count() == 0


# --- report files --------------------------------------------------------------------


def test_report_file(spark, tmp_path, make_posts):
    with hot_word_report(make_posts("好天气 好天气", "天气差"), top_n=2) as report:
        reports.write_report(report.words, str(tmp_path / "r"))
    data = (tmp_path / "r").read_bytes()
    assert data.startswith(codecs.BOM_UTF8) and not data.startswith(codecs.BOM_UTF8 * 2)
    assert data.decode("utf-8-sig").splitlines() == [
        "排名,热词,词频,情感评分,情感倾向,正面比例,负面比例",
        "1,天气,3,5.5,neutral,0.5,0.5",
        "2,好天,2,10.0,positive,1.0,0.0",
    ]


def test_report_count_falls_back(spark):
    base = spark.createDataFrame([(1, "a", 7, 5.5, "neutral", 0.0, 0.0)], "rank int, word string, total_count long, avg_score double, sentiment string, positive_ratio double, negative_ratio double")
    assert reports.report_table(base).first()["词频"] == 7
    assert reports.report_table(base.drop("total_count")).first()["词频"] == 0


def test_trend_file(tmp_path, make_posts):
    posts = make_posts("好天", "天差", "天", dates=["2024-01-02", "2024-01-01", "bad"])
    trend = word_trend(posts, "天")
    reports.write_trend(trend.series, str(tmp_path / "t"))
    rows = ["2024-01-01,1.0", "2024-01-02,10.0"]
    lines = (tmp_path / "t").read_bytes().decode("utf-8-sig").splitlines()
    assert lines == ["日期,情感评分,热词", *(f"{r},天" for r in rows)]
    reports.write_trend(trend.series, str(tmp_path / "t"), "天")
    assert (tmp_path / "t").read_bytes().decode("utf-8-sig").splitlines() == ["日期,情感评分", *rows]
    assert not list(tmp_path.glob("*.writing"))
    assert reports.trend_file_name("天") == "天_sentiment_trend.csv"


def test_another_header_is_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text("date,content\n2020-01-01,hello\n")
    (tmp_path / "b.csv").write_text("content,date\nworld,2020-01-02\n")
    with pytest.raises(Exception, match="header"):
        read_custom_posts(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("utf8", [True, False])
def test_partition_folders_give_columns(spark, tmp_path, utf8):
    for day in ("2020-01-01", "2020-01-02"):
        (tmp_path / f"date={day}").mkdir()
        (tmp_path / f"date={day}" / "p.csv").write_text(f"content,label\nof {day},1\n")
    rows = read_custom_posts(spark, str(tmp_path), utf8=utf8).collect()
    assert {(r.date, r.content, r.label) for r in rows} == {(d, f"of {d}", 1) for d in ("2020-01-01", "2020-01-02")}


def test_partition_folders_with_gbk(spark, tmp_path):
    for day, code in (("2020-01-01", "gbk"), ("2020-01-02", "utf-8")):
        (tmp_path / f"date={day}").mkdir()
        (tmp_path / f"date={day}" / "p.csv").write_bytes("content\n好天\n".encode(code))
    rows = read_custom_posts(spark, str(tmp_path)).collect()
    assert {(r.date, r.content) for r in rows} == {("2020-01-01", "好天"), ("2020-01-02", "好天")}


def test_labels_are_whole_numbers(spark):
    given = spark.createDataFrame([("a", "2020-01-01", "1"), ("b", "2020-01-01", "x")], "content string, date string, label string")
    assert dict(src.normalize_custom(given).dtypes)["label"] == "int"
    assert [r.label for r in src.normalize_custom(given).orderBy("content").collect()] == [1, None]


@pytest.mark.parametrize("arrow", ["true", "false"])
def test_pandas_integers_with_gaps(spark, arrow):
    before = spark.conf.get("spark.sql.execution.arrow.pyspark.enabled")
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", arrow)
    try:
        table = pd.DataFrame({"id": [1, 2], "content": ["a", None], "label": [1, None]})
        assert [tuple(r) for r in src.posts_from_pandas(spark, table).collect()] == [(1, "a", 1), (2, None, None)]
    finally:
        spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", before)


def test_numbering_moves_no_texts(spark, sf):
    numbered = src.with_sequential_id(src.with_file_position(spark.read.parquet(f"{sf}/documents.parquet")))
    numbered.collect()
    plan = physical(numbered)
    assert "BroadcastHashJoin" in plan
    shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line or "Exchange Single" in line]
    assert shuffles and not any("text" in line for line in shuffles)


@pytest.mark.parametrize(
    "text, day",
    [
        ("Mon Jan 20 13:45:00 +0800 2020", "2020-01-20 13:45:00"), ("01/20/2020", "2020-01-20 00:00:00"),
        ("20/01/2020 07:05", "2020-01-20 07:05:00"), ("20 Jan 2020", "2020-01-20 00:00:00"),
        ("5 September 2020 10:00:01", "2020-09-05 10:00:01"), ("2020年1月20日", "2020-01-20 00:00:00"),
        ("2020.01.20 01:02:03", "2020-01-20 01:02:03"), ("2020/1/2", "2020-01-02 00:00:00"),
        ("20200120", "2020-01-20 00:00:00"), ("20 Foo 2020", None), ("13/13/2020", None), ("tomorrow", None),
    ],
)
def test_forms_of_dates(spark, text, day):
    df = spark.createDataFrame([(text,)], "t string").select(parse_timestamp(F.col("t")).cast("string").alias("ts"))
    assert df.first().ts == day
    if day is None:
        with pytest.raises(ValueError):
            parse_bound(text)
    else:
        assert str(parse_bound(text)) == day


def test_stored_days_prune(spark, tmp_path, make_posts):
    given = make_posts("a", "b", "c", dates=["2024-01-01 10:00:00", "2024-01-02", "bad"])
    write_posts(given, str(tmp_path / "days"))
    stored = spark.read.parquet(str(tmp_path / "days"))
    assert stored.count() == 3
    chosen = filter_by_date(stored, "2024-01-02", None, "ts", day_col="day")
    assert [r.content for r in chosen.collect()] == ["b"]
    assert "PartitionFilters: [isnotnull(day" in physical(chosen)
