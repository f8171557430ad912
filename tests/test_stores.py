"""Stored models and stored counts."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from termpulse.functions.text import lexicon_tokenizer, tokenize_whitespace
from termpulse.operators import bayes, keywords, models
from termpulse.operators import sentiment as sent
from termpulse.operators.lookup import WordTable, lookup_words
from termpulse.plans.summary import corpus_summary, date_range, stored_date_range, stored_days, stored_summary
from termpulse.sinks import counts, cube
from termpulse.sinks.posts import write_posts


def train_posts(spark):
    rows = [(1, "good fine day", 1), (2, "bad awful day", 0), (3, "fine fine work", 1), (4, "awful trash", 0)]
    return spark.createDataFrame(rows, "id long, content string, train_label int")


def test_a_loaded_model_scores_alike(spark, tmp_path):
    posts = train_posts(spark)
    model = bayes.train(posts, stopwords=["day"])
    folder = str(tmp_path / "model")
    models.save_bayes(model, folder, ["day"])
    want = bayes.predict(posts, model, ["day"]).orderBy("id").collect()
    model.table.release()
    loaded = models.load_bayes(spark.newSession(), folder, ["day"])
    assert loaded.log_prior == model.log_prior
    assert bayes.predict(posts, loaded, ["day"]).orderBy("id").collect() == want


def test_other_words_are_refused(spark, tmp_path):
    folder = str(tmp_path / "model")
    models.save_bayes(bayes.train(train_posts(spark)), folder)
    for kwargs in ({"stopwords": ["day"]}, {"tokenizer": tokenize_whitespace}, {"tokenizer": lexicon_tokenizer(["研究"])}):
        with pytest.raises(models.ModelMismatch):
            models.load_bayes(spark, folder, **kwargs)
    with pytest.raises(models.ModelMismatch):
        models.load_idf(spark, folder)
    with pytest.raises(models.ModelMismatch):
        models.load_bayes(spark, str(tmp_path / "nothing"))
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        models.save_bayes(bayes.train(train_posts(spark)), folder)


def test_incomplete_and_later_stores_are_refused(spark, tmp_path, monkeypatch):
    posts, folder = train_posts(spark), str(tmp_path / "idf")
    idf = keywords.fit_idf(posts, tokenizer=tokenize_whitespace)
    models.save_idf(idf, folder, tokenizer=tokenize_whitespace)
    loaded = models.load_idf(spark, folder, tokenizer=tokenize_whitespace)
    found = [keywords.keywords_by_tfidf(posts, t, tokenizer=tokenize_whitespace).orderBy("id", "rank").collect() for t in (idf, loaded)]
    assert found[0] == found[1]
    monkeypatch.setattr(models, "FORMAT", 2)
    with pytest.raises(models.ModelMismatch, match="format"):
        models.load_idf(spark, folder, tokenizer=tokenize_whitespace)
    monkeypatch.undo()
    idf.words.limit(1).write.mode("overwrite").parquet(f"{folder}/words")
    with pytest.raises(models.ModelMismatch, match="complete"):
        models.load_idf(spark, folder, tokenizer=tokenize_whitespace)


def day_posts(spark, rows):
    return spark.createDataFrame(rows, "id long, date string, content string")


ROWS = [(1, "2024-01-01", "apple pear"), (2, "2024-01-01 10:00:00", "apple"), (3, "2024-01-02", "pear fig"), (4, None, "lost"), (5, "2024-01-03", "")]


def listed(df):
    return sorted((str(r.day), r.word, r.n) for r in df.collect())


def test_counts_follow_the_posts(spark, tmp_path):
    stored, folder = str(tmp_path / "posts"), str(tmp_path / "counts")
    assert listed(counts.read_counts(spark, folder)) == []
    write_posts(day_posts(spark, ROWS), stored)
    counts.update_counts(spark.read.parquet(stored), folder)
    first = [("2024-01-01", "apple", 2), ("2024-01-01", "pear", 1), ("2024-01-02", "fig", 1), ("2024-01-02", "pear", 1)]
    assert listed(counts.read_counts(spark, folder)) == first
    # A day comes in, twice.
    write_posts(day_posts(spark, [(6, "2024-01-04", "kiwi apple")]), stored, mode="append")
    for _ in range(2):
        counts.update_counts(spark.read.parquet(stored), folder, [date(2024, 1, 4)])
    want = [*first, ("2024-01-04", "apple", 1), ("2024-01-04", "kiwi", 1)]
    assert listed(counts.read_counts(spark, folder)) == want
    assert listed(counts.read_counts(spark, folder, "2024-01-02", "2024-01-03")) == first[2:]
    assert {r.word: r.n for r in counts.word_totals(counts.read_counts(spark, folder)).collect()} == {"apple": 3, "pear": 2, "fig": 1, "kiwi": 1}
    # Posts of a day are gone.
    counts.update_counts(spark.read.parquet(stored).where("id <> 3"), folder, [date(2024, 1, 2)])
    assert listed(counts.read_counts(spark, folder)) == [*first[:2], *want[4:]]
    days = {str(r.day): (r.n_posts, r.n_words) for r in counts.counted_days(spark, folder).collect()}
    assert days == {"2024-01-01": (2, 2), "2024-01-02": (0, 0), "2024-01-03": (1, 0), "2024-01-04": (1, 2)}
    assert counts.drop_old_generations(spark, folder) == 2 and counts.drop_old_generations(spark, folder) == 0
    assert listed(counts.read_counts(spark, folder)) == [*first[:2], *want[4:]]


def test_only_the_days_wanted_are_read(spark, tmp_path, monkeypatch):
    stored, folder = str(tmp_path / "posts"), str(tmp_path / "counts")
    write_posts(day_posts(spark, ROWS), stored)
    seen = []
    real = counts.word_rows
    monkeypatch.setattr(counts, "word_rows", lambda df, *a, **b: seen.append(df) or real(df, *a, **b))
    counts.update_counts(spark.read.parquet(stored), folder, [date(2024, 1, 2)])
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "2024-01-02" in plan
    assert listed(counts.read_counts(spark, folder)) == [("2024-01-02", "fig", 1), ("2024-01-02", "pear", 1)]


def test_a_failed_update_leaves_the_counts_before(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "counts")
    posts = day_posts(spark, ROWS).withColumn("day", F.to_date(F.substring("date", 1, 10)))
    counts.update_counts(posts, folder, [date(2024, 1, 1)])
    before = listed(counts.read_counts(spark, folder))

    def broken(*a, **b):
        raise RuntimeError("lost")

    monkeypatch.setattr(counts, "_read", lambda s, f, schema, real=counts._read: broken() if f.endswith("counts") else real(s, f, schema))
    with pytest.raises(RuntimeError):
        counts.update_counts(posts.withColumn("content", F.lit("changed")), folder, [date(2024, 1, 1)])
    monkeypatch.undo()
    assert listed(counts.read_counts(spark, folder)) == before
    counts.update_counts(posts.withColumn("content", F.lit("changed")), folder, [date(2024, 1, 1)])
    assert listed(counts.read_counts(spark, folder)) == [("2024-01-01", "changed", 2)]
    with pytest.raises(models.ModelMismatch):
        counts.update_counts(posts, folder, stopwords=["apple"])


def dated_posts(spark):
    rows = [
        (1, "2024-01-02 10:00", "good fine day"), (2, "2024-01-02", "bad day"), (3, "2024-01-05 23:59:59", None),
        (4, "2024-01-03", ""), (5, "never", "fine bad day"), (6, None, "fine"), (7, "2024-01-01 00:00:01", "day day 天气"),
    ]
    return spark.createDataFrame(rows, "id long, date string, content string")


LEXICON = (["good", "fine"], ["bad"])


@pytest.mark.parametrize("inline", [500, 2])
@pytest.mark.parametrize("empty", [False, True])
def test_cube_gives_the_rows_of_a_scan(spark, tmp_path, monkeypatch, inline, empty):
    posts = dated_posts(spark).where(F.lit(not empty))
    words = ["day", "fine", "天", "nothing", "day"]
    monkeypatch.setattr(sent.S, "INLINE_WORDS", inline)
    folder = str(tmp_path / "cube")
    cube.write_cube(cube.sentiment_cube(posts, words, LEXICON), folder)
    stored = cube.read_cube(spark, folder)
    scored = sent.narrow_scores(posts, LEXICON)
    asked = spark.createDataFrame([(w, i) for i, w in enumerate(dict.fromkeys(words))], "word string, word_count long")

    def rows(df):
        return sorted(map(tuple, df.collect()))

    assert rows(cube.distribution(stored)) == rows(sent.sentiment_distribution(scored))
    assert rows(cube.words_sentiment(stored, asked.select("word"))) == rows(sent.analyze_words(posts, words, LEXICON))
    ranked = asked.withColumnRenamed("word_count", "n")
    assert rows(cube.words_sentiment(stored, asked)) == rows(sent.top_words_sentiment(posts, ranked, LEXICON))
    assert rows(cube.words_sentiment_by_date(stored)) == rows(sent.word_sentiment_by_date(posts, words, LEXICON))
    plan = cube.distribution(stored)._jdf.queryExecution().executedPlan().toString()
    assert empty or "PartitionFilters: [isnotnull(by_day" in plan


def test_cube_searches_each_text_once(spark):
    plan = cube.sentiment_cube(dated_posts(spark), ["day", "fine"], LEXICON)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("filter(") == 1


def test_summary_reads_metadata_only(spark, tmp_path):
    posts, folder = dated_posts(spark), str(tmp_path / "posts")
    write_posts(posts, folder)
    assert stored_summary(spark, folder).collect() == corpus_summary(posts).collect()
    assert stored_date_range(spark, folder).collect() == date_range(posts).collect()
    days = {r.day: r.posts for r in stored_days(spark, folder).collect()}
    assert days == {None: 2, date(2024, 1, 1): 1, date(2024, 1, 2): 2, date(2024, 1, 3): 1, date(2024, 1, 5): 1}
    plan = stored_days(spark, folder)._jdf.queryExecution().toString()
    assert "PushedAggregation: [COUNT(*)]" in plan and "content" not in plan.split("Physical Plan")[1]
    # The caller's session keeps its reader.
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"


def test_summary_without_dates_and_without_posts(spark, tmp_path):
    for name, posts in {"undated": dated_posts(spark).where("id = 6"), "none": dated_posts(spark).limit(0)}.items():
        folder = str(tmp_path / name)
        write_posts(posts, folder)
        assert stored_summary(spark, folder).collect() == corpus_summary(posts).collect()
        assert stored_date_range(spark, folder).collect() == date_range(posts).collect()


def test_copies_of_a_big_stored_table_are_not_broadcast(spark, tmp_path):
    """The file is small; sixteen copies of each of its rows need not be."""
    folder = str(tmp_path / "words")
    spark.range(2000).select(F.concat(F.lit("w"), "id").alias("word"), F.lit(1).alias("n"), F.lit(0.5).alias("v")).write.parquet(folder)
    rows = spark.createDataFrame([(1, "w7"), (1, "none"), (2, "w1999")], "id int, word string")
    joined = lookup_words(rows, WordTable(spark.read.parquet(folder), "n", False), ["v"], hot=1)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan
    assert {tuple(r) for r in joined.collect()} == {(1, "w7", 0.5), (2, "w1999", 0.5)}
