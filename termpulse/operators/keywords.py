"""Keywords of each post: by frequency, by TF-IDF, by TextRank."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termpulse import settings as S
from termpulse.functions.arrays import count_words, heaviest, let, word_positions
from termpulse.functions.python import leading_words
from termpulse.functions.text import Tokenizer, tokens_of
from termpulse.operators.filters import non_empty
from termpulse.operators.lookup import FrequentWords, WordTable, lookup_rest
from termpulse.operators.ranking import first_per_group

WINDOW = 5
DAMPING = 0.85
ROUNDS = 10


def _ranked(posts: DataFrame, keywords: Column, key: str) -> DataFrame:
    """``key, rank, word, weight`` from an array of ranked keywords."""
    return posts.select(key, F.posexplode(keywords).alias("_pos", "_kw")).select(
        key,
        (F.col("_pos") + 1).alias("rank"),
        F.col("_kw.word").alias("word"),
        F.col("_kw.weight").alias("weight"),
    )


def keywords_by_frequency(
    posts: DataFrame,
    k: int = S.KEYWORDS_K,
    stopwords: Iterable[str] = (),
    key: str = "id",
    content: str = "content",
    tokenizer: Tokenizer | None = None,
) -> DataFrame:
    """``key, rank, word, weight`` with the count as weight.

    A post's words are counted and ranked inside its row: no shuffle at all.
    """
    counts = count_words(tokens_of(F.col(content), stopwords, tokenizer))
    weighted = F.transform(counts, lambda c: F.struct(c["word"].alias("word"), c["tf"].alias("weight")))
    return _ranked(posts, heaviest(weighted, k), key)


# --- TF-IDF ----------------------------------------------------------------------


def fit_idf(
    posts: DataFrame,
    stopwords: Iterable[str] = (),
    key: str = "id",
    content: str = "content",
    tokenizer: Tokenizer | None = None,
) -> WordTable:
    """Document frequency and ``ln((D + 1) / (df + 1))`` of every word of a corpus.

    ``D`` is the number of non-empty posts. Words are made distinct inside each
    post's row, so only one partial count per word and task is shuffled.
    """
    docs = non_empty(posts, content).agg(F.count(F.lit(1)).alias("d")).scalar()
    distinct = F.array_distinct(tokens_of(F.col(content), stopwords, tokenizer))
    df = (
        posts.select(F.explode(distinct).alias("word"))
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("df"))
        .withColumn("_d", docs)
    )
    return WordTable.fit(
        df.select("word", "df", F.log((F.col("_d") + 1) / (F.col("df") + 1)).alias("idf")), "df"
    )


def keywords_by_tfidf(
    posts: DataFrame,
    idf: WordTable,
    k: int = S.KEYWORDS_K,
    stopwords: Iterable[str] = (),
    key: str = "id",
    content: str = "content",
    tokenizer: Tokenizer | None = None,
) -> DataFrame:
    """``key, rank, word, weight`` with ``tf / length * idf``, six decimals.

    Use the stopwords and the tokeniser the table was fitted with; words it lacks are skipped.
    Python counts the words of each post, looks up the frequent words of the table and leaves
    those that can be among the first ``k``. Shuffled are these and, if the table is too big
    to broadcast, the post's words that are not among its frequent ones, unless even the
    highest idf leaves them behind the ``k`` words found.
    """
    frequent = FrequentWords.of(idf, "idf")
    tokens = tokens_of(F.col(content), stopwords, tokenizer)
    near = leading_words(frequent.entries, k, frequent.highest if frequent.rest is not None else None)(tokens)

    def first(words: Column) -> Column:
        """The first ``k`` of the words found."""
        found = F.filter(words, lambda x: x["weight"].isNotNull())
        top = heaviest(
            F.transform(found, lambda x: F.struct(x["word"].alias("word"), F.bround(x["weight"], 6).alias("weight"))), k
        )
        return F.transform(
            top, lambda x: F.struct(x["word"].alias("word"), F.lit(None).cast("double").alias("share"), x["weight"].alias("weight"))
        )

    def cut(words: Column) -> Column:
        if frequent.rest is None:
            return first(words)
        return F.concat(first(words), F.filter(words, lambda x: x["weight"].isNull()))

    # For the outer form Spark infers no filter, which would work the array out again.
    rows = posts.select(key, near.alias("_near")).select(key, F.inline_outer(let(F.col("_near"), cut)))
    if frequent.rest is not None:
        # No word of the rest is in many of the posts that the table was fitted on, so one
        # copy will do; for other posts Spark splits the tasks that get too many rows.
        joined = lookup_rest(rows, frequent.rest, ["idf"], F.col("weight").isNotNull(), key, slices=1)
        rows = joined.withColumn("weight", F.coalesce("weight", F.bround(F.col("share") * F.col("_rest.idf"), 6)))
    found = rows.where(F.col("weight").isNotNull()).select(key, "word", "weight")
    ranked = first_per_group(found, [key], [F.desc("weight"), "word"], k, "rank", ["word"])
    return ranked.select(key, "rank", "word", "weight")


# --- TextRank --------------------------------------------------------------------


def keywords_by_textrank(
    posts: DataFrame,
    k: int = S.KEYWORDS_K,
    stopwords: Iterable[str] = (),
    window: int = WINDOW,
    damping: float = DAMPING,
    rounds: int = ROUNDS,
    key: str = "id",
    content: str = "content",
    tokenizer: Tokenizer | None = None,
) -> DataFrame:
    """``key, rank, word, weight`` from each post's own co-occurrence graph.

    Different words less than ``window`` tokens apart are linked, weighted by how
    often. All ranks start at 1 and ``rounds`` synchronous updates follow
    (Mihalcea and Tarau, 2004). Words without a link are not ranked.

    The graph of a post follows from the post alone, so everything runs as
    array expressions inside the post's row, without any shuffle. Each token
    has at most ``2 * (window - 1)`` neighbours: the graph grows with the text,
    not with its square, and rounds add no lineage.
    """
    return _ranked(
        posts,
        heaviest(textrank(tokens_of(F.col(content), stopwords, tokenizer), window, damping, rounds), k),
        key,
    )


def textrank(
    tokens: Column, window: int = WINDOW, damping: float = DAMPING, rounds: int = ROUNDS
) -> Column:
    """``array<struct<word, weight>>`` of a token array, weights to six decimals."""
    reach = window - 1

    def neighbours(nodes: Column) -> Column:
        """Per word the numbers of the words near any of its places, with repeats."""
        in_order = F.sort_array(
            F.flatten(
                F.transform(
                    nodes,
                    lambda n, g: F.transform(n["at"], lambda p: F.struct(p.alias("p"), g.alias("g"))),
                )
            )
        )

        def near(seq: Column, p: Column) -> Column:
            first = F.greatest(p + 1 - reach, F.lit(1))
            return F.slice(seq, first, p + 2 + reach - first)

        return let(
            F.transform(in_order, lambda x: x["g"]),
            lambda seq: F.transform(
                nodes,
                lambda n, g: F.flatten(
                    F.transform(n["at"], lambda p: F.filter(near(seq, p), lambda x: x != g))
                ),
            ),
        )

    # The running state is each word's rank divided by its number of links,
    # which is what it passes on along every one of them.
    def links(ns: Column) -> Column:
        return F.greatest(F.size(ns), F.lit(1))

    def rank(ns: Column, passed: Column) -> Column:
        inflow = F.aggregate(ns, F.lit(0.0), lambda total, j: total + F.get(passed, j))
        return F.lit(1.0 - damping) + F.lit(damping) * inflow

    def spread(near: Column, n: int) -> Column:
        start = F.transform(near, lambda ns: F.lit(1.0) / links(ns))
        if n == 0:
            return start
        return F.aggregate(
            F.sequence(F.lit(1), F.lit(n)),
            start,
            lambda passed, _: F.transform(near, lambda ns: rank(ns, passed) / links(ns)),
        )

    def solve(nodes: Column, near: Column) -> Column:
        weights = let(
            spread(near, rounds - 1),
            lambda passed: F.transform(
                near, lambda ns: F.when(F.size(ns) > 0, F.bround(rank(ns, passed), 6))
            ),
        )
        pairs = F.zip_with(
            nodes, weights, lambda n, w: F.struct(n["word"].alias("word"), w.alias("weight"))
        )
        return F.filter(pairs, lambda x: x["weight"].isNotNull())

    return let(
        word_positions(tokens), lambda nodes: let(neighbours(nodes), lambda near: solve(nodes, near))
    )


def extract_keywords(
    posts: DataFrame,
    k: int = S.KEYWORDS_K,
    method: str = "tfidf",
    stopwords: Iterable[str] = (),
    idf: WordTable | None = None,
    tokenizer: Tokenizer | None = None,
) -> DataFrame:
    """Keywords by ``method``: ``textrank``, ``frequency``, and TF-IDF for any other name.

    Without a fitted ``idf`` the posts themselves are the corpus.
    """
    if method == "textrank":
        return keywords_by_textrank(posts, k, stopwords, tokenizer=tokenizer)
    if method == "frequency":
        return keywords_by_frequency(posts, k, stopwords, tokenizer=tokenizer)
    idf = idf or fit_idf(posts, stopwords, tokenizer=tokenizer)
    return keywords_by_tfidf(posts, idf, k, stopwords, tokenizer=tokenizer)
