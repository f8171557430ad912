"""One query per operator, each over whole tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import posts_view as V
from termpulse import settings as S
from termpulse.functions import text as X
from termpulse.functions.dates import parse_timestamp
from termpulse.functions.python import python_tokenizer
from termpulse.operators import bayes, filters, keywords, models, newwords, segment, tokens
from termpulse.operators import frequency as freq
from termpulse.operators import sentiment as sent
from termpulse.operators.matching import word_post_matches
from termpulse.plans.drilldown import word_trend
from termpulse.plans.report import hot_word_report
from termpulse.plans.summary import corpus_summary, date_range, stored_date_range, stored_summary
from termpulse.sinks import counts as stored_counts
from termpulse.sinks import cube as stored_cube
from termpulse.sinks.index import posts_with, write_index
from termpulse.sinks.posts import write_posts
from termpulse.sinks.reports import report_table, trend_file_name, trend_table, write_report, write_trend
from termpulse.sources import posts as src
from termpulse.sources.stopwords import stopwords_of_lines
from termpulse.storage import new_folder

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}

TREND_WORD = "the"


def query(func: Query) -> Query:
    """Register under the function's name; a final underscore only avoids clashes."""
    _QUERIES[func.__name__.rstrip("_")] = func
    return func


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _range(posts: DataFrame) -> DataFrame:
    return filters.filter_by_date(posts, V.START, V.END)


def _moment(name: str):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


# --- sources -----------------------------------------------------------------------


@query
def load_posts(spark, sf):
    raw = V.raw_posts(spark, sf).select(
        F.col("content").alias("text"),
        (F.col("id") % 3).cast("string").alias("label"),
        F.col("emotion").alias("label_name"),
        "date",
        "id",
    )
    return src.normalize_labelled(raw)


def _written_csv(posts: DataFrame, label: str) -> str:
    folder = new_folder(posts.sparkSession, label) + "/posts"
    posts.write.csv(
        folder, header=True, escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )
    return folder


@query
def csv_labelled(spark, sf):
    """Posts written to CSV files and read back."""
    raw = V.raw_posts(spark, sf).select(
        F.col("content").alias("text"), (F.col("id") % 3).alias("label"), F.col("emotion").alias("label_name"), "date"
    )
    return src.read_labelled_posts(spark, _written_csv(raw, "labelled")).drop("id")


@query
def csv_custom(spark, sf):
    """Posts written to CSV in a folder per source and read back."""
    posts = V.posts(spark, sf).select("content", F.col("date").alias("时间"), (F.col("id") % 4).alias("label"))
    return src.read_custom_posts(spark, _written_csv(posts, "custom")).drop("id")


@query
def csv_split(spark, sf):
    """The same files, read by many tasks though fields hold line breaks."""
    posts = V.posts(spark, sf).select("content", F.col("date").alias("时间"), (F.col("id") % 4).alias("label"))
    return src.read_custom_posts(spark, _written_csv(posts, "split"), split=True).drop("id")


def _csv_with_long_rows(spark, sf) -> str:
    """A CSV file for each part of the documents; every seventh row has a field too many."""
    more = F.when(F.col("doc_id") % 7 == 0, ",one more").otherwise("")
    line = F.concat_ws(",", F.lit("post"), F.lit("2020-01-01"), F.col("doc_id").cast("string"))
    folder = new_folder(spark, "long") + "/posts"
    lines = V.documents(spark, sf).select(F.concat(line, more).alias("value"), F.lit(1).alias("at"))
    names = spark.range(1).select(F.lit("content,date,label").alias("value"), F.lit(0).alias("at"))
    lines.unionByName(names).repartition(1).sortWithinPartitions("at").select("value").write.text(folder)
    return folder


@query
def csv_dropped(spark, sf):
    return src.read_custom_posts(spark, _csv_with_long_rows(spark, sf), malformed="drop").drop("id")


@query
def csv_rejected(spark, sf):
    return src.rejected_rows(spark, _csv_with_long_rows(spark, sf)).drop("file")


@query
def posts_by_day(spark, sf):
    """Posts stored by day, and a range of days read back."""
    folder = new_folder(spark, "days") + "/posts"
    write_posts(V.posts(spark, sf).select("id", "date"), folder)
    stored = spark.read.parquet(folder)
    chosen = filters.filter_by_date(stored, V.START, V.END, "ts", day_col="day")
    return chosen.select("id", _moment("ts"), F.date_format("day", "yyyy-MM-dd").alias("day"))


@query
def load_custom_posts(spark, sf):
    raw = V.posts(spark, sf).select(
        "id", F.col("content").alias("评论"), F.col("date").alias("created_at")
    )
    return src.normalize_custom(raw)


@query
def stopwords_load(spark, sf):
    lines = V.posts(spark, sf).select(F.explode(F.split("content", "\n")).alias("value"))
    return stopwords_of_lines(lines)


@query
def post_ids(spark, sf):
    documents = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    return src.with_sequential_id(src.with_file_position(documents)).select("id", "doc_id")


@query
def emotion_map(spark, sf):
    return V.raw_posts(spark, sf).select(
        "id", "emotion", src.emotion_label(F.col("emotion")).alias("sentiment_label")
    )


# --- dates and filters ---------------------------------------------------------------


@query
def parse_dates(spark, sf):
    return V.posts(spark, sf).select("id", parse_timestamp(F.col("date")).alias("ts")).select("id", _moment("ts"))


@query
def parse_date_forms(spark, sf):
    """One day of each post, written in eight ways by turns."""
    day = F.expr("date_add(date'2020-01-20', cast(id % 102 as int))")
    form = lambda f: F.date_format(day, f)
    texts = F.array(
        form("yyyy-MM-dd HH:mm:ss"), form("yyyyMMdd"), form("yyyy/M/d"), form("yyyy.MM.dd"), form("yyyy年M月d日"),
        form("MM/dd/yyyy"), form("d MMM yyyy"), F.concat(form("EEE MMM dd"), F.lit(" 13:45:00 +0800 "), form("yyyy")),
    )
    posts = V.posts(spark, sf).select("id", F.element_at(texts, (F.col("id") % 8 + 1).cast("int")).alias("date"))
    return posts.select("id", parse_timestamp(F.col("date")).alias("ts")).select("id", _moment("ts"))


@query
def strict_bounds(spark, sf):
    """What strict and tolerant filters make of an unreadable bound."""
    posts = V.posts(spark, sf)
    rows = filters.filter_by_date(posts, "not-a-date").agg(F.count(F.lit(1)).alias("posts"))
    try:
        filters.filter_by_date(posts, "not-a-date", strict=True)
        outcome = "taken"
    except ValueError:
        outcome = "refused"
    return rows.select(F.lit(outcome).alias("strict"), "posts")


@query
def required_columns(spark, sf):
    """Which layouts are read, one row per case."""
    posts = V.posts(spark, sf).select("id", "content", "date")
    cases = {
        "as named": posts,
        "aliases": posts.withColumnsRenamed({"content": "review", "date": "time"}),
        "no content": posts.drop("content"),
        "no date": posts.drop("date"),
    }
    found = []
    for name, case in cases.items():
        try:
            columns = ",".join(src.normalize_custom(case).columns)
        except ValueError:
            columns = "refused"
        found.append(case.agg(F.count(F.lit(1)).alias("posts")).select(F.lit(name).alias("case"), F.lit(columns).alias("columns"), "posts"))
    return reduce(DataFrame.unionByName, found)


@query
def filter_by_date(spark, sf):
    return _range(V.posts(spark, sf)).select("id", "date")


@query
def filter_open_ended(spark, sf):
    return filters.filter_by_date(V.posts(spark, sf), start="2020-03-01").select("id", "date")


@query
def non_empty_posts(spark, sf):
    return filters.non_empty(V.posts(spark, sf)).select("id", "date", F.length("content").alias("chars"))


@query
def contains_literal(spark, sf):
    return filters.containing(V.posts(spark, sf), "scum").select("id")


@query
def contains_regex(spark, sf):
    return filters.containing(V.posts(spark, sf), "sc[aou]m|idiots?", regex=True).select("id")


@query
def date_range_(spark, sf):
    return date_range(V.posts(spark, sf)).select(_moment("first_ts"), _moment("last_ts"))


@query
def corpus_summary_(spark, sf):
    return corpus_summary(V.posts(spark, sf))


# --- text ----------------------------------------------------------------------------


@query
def clean_text(spark, sf):
    return V.posts(spark, sf).select("id", X.clean_text(F.col("content")).alias("content"))


def _listed(name: str):
    return F.array_join(name, " ").alias("tokens"), F.size(name).alias("n_tokens")


@query
def tokenize(spark, sf):
    return tokens.with_tokens(V.posts(spark, sf), V.STOPWORDS).select("id", *_listed("tokens"))


@query
def tokenize_whitespace(spark, sf):
    return V.posts(spark, sf).select(
        "id", X.tokenize_whitespace(F.col("content")).alias("tokens")
    ).select("id", *_listed("tokens"))


@query
def tokenize_custom(spark, sf):
    split_lower = python_tokenizer(lambda text: text.lower().split())
    counts = freq.word_frequency(V.posts(spark, sf), False, V.STOPWORDS, tokenizer=split_lower)
    return counts.select("word", "n")


def _pieces(spark, sf) -> DataFrame:
    return V.posts(spark, sf).select("id", F.explode(F.split("content", f"[{X.SPACE}]+")).alias("word"))


@query
def token_filters(spark, sf):
    kept = _pieces(spark, sf).where(X.keep_word(F.col("word")))
    return kept.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query
def token_filters_len1(spark, sf):
    kept = _pieces(spark, sf).where(X.keep_word(F.col("word"), min_len=1))
    return kept.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query
def remove_stopwords(spark, sf):
    rows = tokens.word_rows(V.posts(spark, sf))
    stop = spark.range(1).select(F.explode(F.array(*map(F.lit, V.STOPWORDS))).alias("word"))
    return tokens.remove_stopwords(rows, stop).groupBy("id").agg(
        F.count(F.lit(1)).alias("n"), F.min("word").alias("first_word"), F.max("word").alias("last_word")
    )


@query
def explode_tokens(spark, sf):
    return tokens.explode_tokens(V.posts(spark, sf), stopwords=V.STOPWORDS)


@query
def cjk_bigrams(spark, sf):
    rows = V.han_posts(spark, sf).select(F.explode(X.cjk_bigrams(F.col("content"))).alias("word"))
    return rows.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query
def cjk_lexicon(spark, sf):
    runs = segment.cjk_run_counts(V.han_posts(spark, sf)).persist()
    short = runs.where(F.length("run").between(2, 4)).withColumnRenamed("run", "word")
    terms = short.select(F.col("word").alias("term"))
    return segment.segmented_word_counts(runs, terms)


@query
def mixed_terms(spark, sf):
    """Terms that mix scripts, found by the longest match."""
    runs = segment.mixed_run_counts(V.han_posts(spark, sf)).persist()
    short = runs.where(F.size(X.atoms(F.col("run"))).between(2, 4) & F.col("run").rlike(rf"[^{X.CJK}]"))
    return segment.segmented_word_counts(runs, short.select(F.col("run").alias("term")))


@query
def new_words(spark, sf):
    return newwords.new_words(V.han_posts(spark, sf), min_count=20)


@query
def lattice_segment(spark, sf):
    """The most likely words of the texts, with the words found in them as terms."""
    runs = segment.mixed_run_counts(V.han_posts(spark, sf)).persist()
    terms = newwords.term_table(runs, newwords.new_words_of_runs(runs, min_count=20)).persist()
    return segment.segmented_word_counts(runs, terms, "n")


# --- counts and rankings ---------------------------------------------------------------


def _dated(spark, sf) -> DataFrame:
    return freq.word_frequency(V.posts(spark, sf), True, V.STOPWORDS)


def _total(spark, sf) -> DataFrame:
    return freq.word_frequency(V.posts(spark, sf), False, V.STOPWORDS)


@query
def stored_word_counts(spark, sf):
    """Counts per day from a store: all days, then the days of a range once more."""
    folder = new_folder(spark, "counts")
    write_posts(V.posts(spark, sf).select("id", "date", "content"), f"{folder}/posts")
    posts = spark.read.parquet(f"{folder}/posts")
    stored_counts.update_counts(posts, f"{folder}/words", stopwords=V.STOPWORDS)
    first = dt.date.fromisoformat(V.START)
    stored_counts.update_counts(posts, f"{folder}/words", [first + dt.timedelta(k) for k in range(7)], V.STOPWORDS)
    found = stored_counts.read_counts(spark, f"{folder}/words")
    return found.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "word", "n")


@query
def word_freq_by_date(spark, sf):
    return _dated(spark, sf)


@query
def word_freq_total(spark, sf):
    return _total(spark, sf)


@query
def word_freq_empty(spark, sf):
    nothing = filters.filter_by_date(V.posts(spark, sf), start="2031-01-01")
    return freq.word_frequency(nothing, True, V.STOPWORDS)


@query
def word_freq_rollup(spark, sf):
    return freq.roll_up(_dated(spark, sf))


@query
def top_words(spark, sf):
    return freq.with_rank(freq.top_words(freq.word_frequency(V.posts(spark, sf), False, V.STOPWORDS)))


@query
def top_words_by_date(spark, sf):
    dated = V.posts(spark, sf).where(F.col("date").isNotNull())
    return freq.top_words_by_date(freq.word_frequency(dated, True, V.STOPWORDS))


@query
def top_words_by_table(spark, sf):
    return freq.top_words_by_date(_dated(spark, sf))


@query
def top_words_all(spark, sf):
    return freq.top_words_by_date(_total(spark, sf))


@query
def bar_top15(spark, sf):
    return freq.bar_words(_total(spark, sf))


@query
def cloud_weights(spark, sf):
    return freq.cloud_weights(_total(spark, sf))


@query
def trend_pivot(spark, sf):
    posts = V.posts(spark, sf)
    posts = posts.where(F.col("date").isNotNull())
    lists = freq.top_words_by_date(freq.word_frequency(posts, True, V.STOPWORDS))
    return freq.trend_matrix(lists, posts)


@query
def word_context(spark, sf):
    return filters.word_context(V.posts(spark, sf), "scum", 10).select("id", "content")


# --- matching -----------------------------------------------------------------------


@query
def word_post_matches_(spark, sf):
    return word_post_matches(V.posts(spark, sf), V.WORDS)


@query
def word_post_matches_table(spark, sf):
    """The equi-join on n-grams, inside the tasks as the table fits a broadcast; the table
    holds every distinct benchmark word."""
    words = (
        spark.read.parquet(f"{sf}/benchmark.parquet")
        .select(F.explode(F.split("text", f"[{X.SPACE}]+")).alias("word"))
        .where(F.length("word") > 0)
        .distinct()
    )
    found = word_post_matches(V.posts(spark, sf), words)
    return found.groupBy("word").agg(F.count(F.lit(1)).alias("posts"))


# --- sentiment ------------------------------------------------------------------------


@query
def lexicon_score(spark, sf):
    return sent.with_raw_score(V.posts(spark, sf), V.LEXICON).select("id", F.bround("raw", 6).alias("raw"))


def _lexicon_table(spark) -> DataFrame:
    rows = [F.struct(F.lit(t).alias("term"), F.lit(p).alias("polarity")) for p, ts in ((1, V.POSITIVE), (-1, V.NEGATIVE)) for t in ts]
    return spark.range(1).select(F.inline(F.array(*rows)))


@query
def lexicon_score_join(spark, sf):
    scores = sent.lexicon_scores_by_join(V.posts(spark, sf), _lexicon_table(spark))
    return scores.select("id", F.bround("raw", 6).alias("raw"))


@query
def score_posts(spark, sf):
    return sent.score_posts(V.posts(spark, sf), V.LEXICON).select(
        "id", "sentiment_raw_score", "sentiment_score", "sentiment", "sentiment_label"
    )


@query
def score_blank(spark, sf):
    blank = V.posts(spark, sf).where(X.is_blank(F.col("content")))
    return sent.score_posts(blank, V.LEXICON).select(
        "id", "sentiment_raw_score", "sentiment_score", "sentiment", "sentiment_label"
    )


def _distribution(posts: DataFrame) -> DataFrame:
    return sent.sentiment_distribution(sent.narrow_scores(posts, V.LEXICON))


@query
def sentiment_distribution(spark, sf):
    return _distribution(V.posts(spark, sf))


@query
def sentiment_distribution_empty(spark, sf):
    return _distribution(filters.filter_by_date(V.posts(spark, sf), start="2031-01-01"))


@query
def distribution_share(spark, sf):
    return sent.distribution_shares(_distribution(V.posts(spark, sf)))


@query
def word_sentiment(spark, sf):
    return sent.analyze_words(V.posts(spark, sf), V.WORDS, V.LEXICON)


@query
def word_sentiment_sampled(spark, sf):
    return sent.analyze_words(V.posts(spark, sf), V.WORDS, V.LEXICON, max_samples=S.SAMPLES_PER_WORD)


@query
def word_sentiment_no_match(spark, sf):
    return sent.analyze_words(V.posts(spark, sf), ["zzzz"], V.LEXICON)


@query
def top_words_sentiment(spark, sf):
    posts = V.posts(spark, sf)
    ranked = freq.top_words(freq.word_frequency(posts, False, V.STOPWORDS))
    return sent.top_words_sentiment(posts, ranked, V.LEXICON)


@query
def word_sentiment_by_date(spark, sf):
    return sent.word_sentiment_by_date(V.posts(spark, sf), V.WORDS, V.LEXICON).orderBy("word", "day")


@query
def word_sentiment_by_date_sampled(spark, sf):
    return sent.word_sentiment_by_date(V.posts(spark, sf), V.WORDS, V.LEXICON, max_samples=S.SAMPLES_PER_WORD_DAY)


@query
def trend_sides(spark, sf):
    return sent.trend_sides(sent.word_sentiment_by_date(V.posts(spark, sf), V.WORDS, V.LEXICON))


@query
def trend_summary(spark, sf):
    return sent.trend_summary(sent.word_sentiment_by_date(V.posts(spark, sf), V.WORDS, V.LEXICON))


# --- Naive Bayes -----------------------------------------------------------------------


@query
def nb_train(spark, sf):
    counts = bayes.train_counts(V.labelled_posts(spark, sf), stopwords=V.STOPWORDS)
    return bayes.log_probabilities(counts).select(
        "word", "pos_n", "neg_n", F.bround("log_pos", 6).alias("log_pos"), F.bround("log_neg", 6).alias("log_neg")
    )


@query
def nb_score(spark, sf):
    posts = V.labelled_posts(spark, sf)
    model = bayes.train(posts, stopwords=V.STOPWORDS)
    return bayes.predict(V.posts(spark, sf), model, V.STOPWORDS)


@query
def nb_loaded(spark, sf):
    """Scores by a stored model, loaded in a session of its own."""
    folder = new_folder(spark, "model") + "/bayes"
    model = bayes.train(V.labelled_posts(spark, sf), stopwords=V.STOPWORDS)
    models.save_bayes(model, folder, V.STOPWORDS)
    model.table.release()
    own = spark.newSession()
    return bayes.predict(V.posts(own, sf), models.load_bayes(own, folder, V.STOPWORDS), V.STOPWORDS)


# --- keywords ---------------------------------------------------------------------------


@query
def keywords_freq(spark, sf):
    return keywords.keywords_by_frequency(V.posts(spark, sf), stopwords=V.STOPWORDS)


@query
def keywords_tfidf(spark, sf):
    posts = V.posts(spark, sf)
    return keywords.keywords_by_tfidf(posts, keywords.fit_idf(posts, V.STOPWORDS), stopwords=V.STOPWORDS)


@query
def keywords_tfidf_whitespace(spark, sf):
    """The same with a tokeniser of the caller's."""
    posts = V.posts(spark, sf)
    idf = keywords.fit_idf(posts, V.STOPWORDS, tokenizer=X.tokenize_whitespace)
    return keywords.keywords_by_tfidf(posts, idf, stopwords=V.STOPWORDS, tokenizer=X.tokenize_whitespace)


@query
def nb_train_whitespace(spark, sf):
    posts = V.labelled_posts(spark, sf)
    return bayes.train_counts(posts, stopwords=V.STOPWORDS, tokenizer=X.tokenize_whitespace)


@query
def keywords_textrank(spark, sf):
    return keywords.keywords_by_textrank(V.posts(spark, sf), stopwords=V.STOPWORDS)


# --- reports ----------------------------------------------------------------------------


def report(spark: SparkSession, sf: str):
    return hot_word_report(V.posts(spark, sf), V.START, V.END, stopwords=V.STOPWORDS, lexicon=V.LEXICON)


@query
def hot_word_report_(spark, sf):
    return report(spark, sf).words


@query
def hot_word_report_daily(spark, sf):
    return report(spark, sf).daily


@query
def hot_word_report_distribution(spark, sf):
    return report(spark, sf).distribution


@query
def hot_word_table(spark, sf):
    return sent.hot_word_table(report(spark, sf).words)


@query
def score_bands(spark, sf):
    return sent.score_bands(report(spark, sf).words)


@query
def export_report(spark, sf):
    return report_table(report(spark, sf).words)


def _trend(spark, sf):
    return word_trend(V.posts(spark, sf), TREND_WORD, V.START, V.END, V.LEXICON)


@query
def word_trend_(spark, sf):
    return _trend(spark, sf).marked()


@query
def export_trend(spark, sf):
    return trend_table(_trend(spark, sf).series, TREND_WORD)


def _lines(spark, path: str) -> DataFrame:
    whole = spark.read.format("binaryFile").load(path).select(F.decode("content", "UTF-8").alias("text"))
    return whole.select(F.explode(F.split("text", "\n")).alias("line")).where("line <> ''")


@query
def export_trend_file(spark, sf):
    """The file itself, byte-order mark included, line by line."""
    path = f"{new_folder(spark, 'trend')}/{trend_file_name(TREND_WORD)}"
    write_trend(_trend(spark, sf).series, path, TREND_WORD)
    return _lines(spark, path)


@query
def export_report_file(spark, sf):
    path = f"{new_folder(spark, 'report')}/report.csv"
    write_report(report(spark, sf).words, path)
    return _lines(spark, path)


# --- stored tables -----------------------------------------------------------------


def _stored_posts(spark, sf) -> str:
    folder = f"{new_folder(spark, 'posts')}/table"
    write_posts(V.posts(spark, sf), folder)
    return folder


@query
def corpus_summary_stored(spark, sf):
    return stored_summary(spark, _stored_posts(spark, sf))


@query
def date_range_stored(spark, sf):
    return stored_date_range(spark, _stored_posts(spark, sf)).select(_moment("first_ts"), _moment("last_ts"))


def _indexed(spark, sf, word: str) -> DataFrame:
    folder = f"{new_folder(spark, 'index')}/table"
    write_index(V.posts(spark, sf), folder)
    return posts_with(spark, folder, word)


@query
def word_trend_indexed(spark, sf):
    return word_trend(_indexed(spark, sf, TREND_WORD), TREND_WORD, V.START, V.END, V.LEXICON).marked()


@query
def word_context_indexed(spark, sf):
    return filters.word_context(_indexed(spark, sf, "scum"), "scum", 10).select("id", "content")


def _cube(spark, sf, words) -> DataFrame:
    folder = f"{new_folder(spark, 'cube')}/table"
    stored_cube.write_cube(stored_cube.sentiment_cube(V.posts(spark, sf), words, V.LEXICON), folder)
    return stored_cube.read_cube(spark, folder)


@query
def cube_distribution(spark, sf):
    return stored_cube.distribution(_cube(spark, sf, V.WORDS))


@query
def cube_word_sentiment(spark, sf):
    asked = spark.createDataFrame([(w,) for w in V.WORDS], "word string")
    return stored_cube.words_sentiment(_cube(spark, sf, V.WORDS), asked)


@query
def cube_word_sentiment_by_date(spark, sf):
    return stored_cube.words_sentiment_by_date(_cube(spark, sf, V.WORDS))


@query
def cube_top_words_sentiment(spark, sf):
    ranked = freq.top_words(freq.word_frequency(V.posts(spark, sf), False, V.STOPWORDS))
    words = ranked.select("word", F.col("n").alias("word_count"))
    return stored_cube.words_sentiment(_cube(spark, sf, words), words)
