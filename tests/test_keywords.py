import math
import random
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import physical
from termpulse import settings as S
from termpulse.functions import python
from termpulse.functions.text import lexicon_tokenizer, tokenize_whitespace
from termpulse.operators import bayes, keywords, matching, segment
from termpulse.operators import frequency as freq
from termpulse.operators.lookup import WordTable
from termpulse.plans.report import hot_word_report

TEXTS = ["aa bb aa cc dd bb aa", "bb cc", "ee", None, "", "aa ff gg hh ii jj kk aa ll"]


def by_id(df):
    out = defaultdict(list)
    for r in df.orderBy("id", "rank").collect():
        out[r.id].append((r.word, r.weight))
    return dict(out)


def top(weights, k):
    return sorted(weights.items(), key=lambda x: (-x[1], x[0]))[:k]


def tokens_of(text):
    return text.split() if text else []


def test_frequency(make_posts):
    got = by_id(keywords.keywords_by_frequency(make_posts(*TEXTS), 3))
    assert got == {i: top(Counter(tokens_of(t)), 3) for i, t in enumerate(TEXTS, 1) if t}


@pytest.mark.parametrize("small", [True, False])
def test_tfidf(make_posts, small):
    posts = make_posts(*TEXTS)
    docs = [tokens_of(t) for t in TEXTS if t]
    df = Counter(w for d in docs for w in set(d))
    want = {}
    for i, t in enumerate(TEXTS, 1):
        ts = tokens_of(t)
        if ts:
            want[i] = top({w: round(n / len(ts) * math.log((len(docs) + 1) / (df[w] + 1)), 6) for w, n in Counter(ts).items()}, 4)
    fitted = keywords.fit_idf(posts)
    table = WordTable(fitted.words, fitted.weight, small)
    assert by_id(keywords.keywords_by_tfidf(posts, table, 4)) == want
    fitted.release()


def shuffled_rows(df):
    """Rows that a query's exchanges have written."""

    def below(node):
        yield node
        for i in range(node.children().size()):
            yield from below(node.children().apply(i))

    counts = (n.metrics().get("shuffleRecordsWritten") for n in below(df._jdf.queryExecution().executedPlan()))
    return sum(c.get().value() for c in counts if c.isDefined())


@pytest.mark.parametrize("most", [0, 700, 3000])
def test_tfidf_of_a_big_table_shuffles_few_words(spark, make_posts, monkeypatch, most):
    """Frequent words, as many as a broadcast holds, are looked up and cut in the post's row."""
    rng = random.Random(5)
    common = [f"c{i:03}" for i in range(600)]
    texts = [" ".join([*common, *rng.choices(common, k=50), *(f"r{n}x{i}" for i in range(5))]) for n in range(100)]
    posts = make_posts(*texts, "", None, "r1x1 r1x1 c000", "unknown")
    fitted = keywords.fit_idf(posts)
    table = fitted.words.where("word NOT IN ('unknown', 'r2x2', 'c001')")
    want = by_id(keywords.keywords_by_tfidf(posts, WordTable(table, "df", True), 8))
    idf = {r.word: r.idf for r in table.collect()}
    for i in (1, 3, 103):
        ts = [*texts, "", "", "r1x1 r1x1 c000"][i - 1].split()
        plain = top({w: round(n / len(ts) * idf[w], 6) for w, n in Counter(ts).items() if w in idf}, 8)
        assert [w for w, _ in want[i]] == [w for w, _ in plain] and len(want[i]) == len(plain)
        assert [x for _, x in want[i]] == pytest.approx([x for _, x in plain], abs=2e-6)
    assert 104 not in want
    monkeypatch.setattr(S, "BROADCAST_ROWS", most)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = keywords.keywords_by_tfidf(posts, WordTable(table, "df", False), 8)
        found = defaultdict(list)
        for r in sorted(got.collect(), key=lambda r: (r.id, r.rank)):
            found[r.id].append((r.word, r.weight))
        assert dict(found) == want
        if most:
            # The copies of the rest of the table, and not the 60,000 words of the posts.
            assert shuffled_rows(got) < 20_000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    fitted.release()


def test_tfidf_of_a_big_table_shuffles_no_copies_of_it(spark, make_posts, monkeypatch):
    """One row for each word that is not broadcast, and work on a post's words outside lambdas."""
    rng = random.Random(6)
    words = [f"w{i:04}" for i in range(3000)]
    posts = make_posts(*(" ".join(rng.choices(words, k=60)) for _ in range(80)))
    fitted = keywords.fit_idf(posts)
    n = fitted.words.count()
    monkeypatch.setattr(S, "BROADCAST_ROWS", 500)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = keywords.keywords_by_tfidf(posts, WordTable(fitted.words, "df", False), 5)
        got.collect()
        assert shuffled_rows(got) < n + 2 * 80 * 60
        plan = physical(got)
        assert plan.count("ArrowEvalPython [") == 1 and "map_from_entries" not in plan
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert by_id(got) == by_id(keywords.keywords_by_tfidf(posts, WordTable(fitted.words, "df", True), 5))
    fitted.release()


@pytest.mark.parametrize("highest", [None, 3.0])
def test_leading_words_against_a_count(monkeypatch, highest):
    monkeypatch.setattr(python, "WORDS", 20)
    rng = random.Random(8)
    values = {f"w{i}": rng.choice([0.5, 1.0, rng.random() * 3]) for i in range(30)}
    lists = [rng.choices([*values, "x1", "x2", None], k=rng.choice([0, 1, 5, 60])) for _ in range(50)] + [None]
    arrays = pa.array([["cut off"], *lists], pa.list_(pa.string())).slice(1)
    parts = list(python._parts(arrays))
    assert len(parts) > 10 and sum(map(len, parts)) == 51
    got = [
        row
        for part in parts
        for row in python._leading(part, pa.array(list(values)), pa.array(list(values.values())), 4, highest).to_pylist()
    ]
    for row, ts in zip(got, lists):
        counts = Counter(t for t in ts or () if t is not None)
        weights = {w: n / len(ts) * values[w] for w, n in counts.items() if w in values}
        least = sorted(weights.values())[-4] - 2e-6 if len(weights) >= 4 else -math.inf
        want = {(w, counts[w] / len(ts), x) for w, x in weights.items() if x >= least}
        if highest is not None:
            want |= {(w, n / len(ts), None) for w, n in counts.items() if w not in values and n / len(ts) * highest >= least}
        assert {tuple(r.values()) for r in row} == want and len(row) == len(want)


def textrank(tokens, rounds=10):
    w = defaultdict(Counter)
    for i, a in enumerate(tokens):
        for b in tokens[i + 1 : i + 5]:
            if a != b:
                w[a][b] += 1
                w[b][a] += 1
    r = {a: 1.0 for a in w}
    for _ in range(rounds):
        r = {a: 0.15 + 0.85 * sum(n / sum(w[b].values()) * r[b] for b, n in w[a].items()) for a in w}
    return {a: round(v, 6) for a, v in r.items()}


@pytest.mark.parametrize("rounds", [1, 2, 10])
def test_textrank(make_posts, rounds):
    rng = random.Random(3)
    texts = [*TEXTS, *(" ".join(f"w{rng.randint(0, 12)}" for _ in range(rng.randint(1, 60))) for _ in range(15))]
    got = by_id(keywords.keywords_by_textrank(make_posts(*texts), 5, rounds=rounds))
    want = {i: top(textrank(tokens_of(t), rounds), 5) for i, t in enumerate(texts, 1)}
    want = {i: v for i, v in want.items() if v}
    assert {i: [w for w, _ in v] for i, v in got.items()} == {i: [w for w, _ in v] for i, v in want.items()}
    for i, v in want.items():
        assert [x for _, x in got[i]] == pytest.approx([x for _, x in v], abs=2e-6)


def test_per_post_keywords_need_no_shuffle(make_posts):
    for df in (
        keywords.keywords_by_frequency(make_posts(*TEXTS)),
        keywords.keywords_by_textrank(make_posts(*TEXTS)),
    ):
        assert "Exchange" not in physical(df) and "Python" not in physical(df)


def test_method_names(make_posts):
    posts = make_posts(*TEXTS)
    assert by_id(keywords.extract_keywords(posts, 2, "textrank")) == by_id(keywords.keywords_by_textrank(posts, 2))
    assert by_id(keywords.extract_keywords(posts, 2, "anything")) == by_id(keywords.extract_keywords(posts, 2))
    assert by_id(keywords.extract_keywords(posts, 2, "frequency")) == by_id(keywords.keywords_by_frequency(posts, 2))


# --- Naive Bayes -----------------------------------------------------------------------------


@pytest.mark.parametrize("small", [True, False])
def test_bayes_against_plain_python(spark, small):
    rows = [
        (1, "good good fine", 1), (2, "bad fine", 0), (3, "good new", -1), (4, "bad bad awful good", 0),
        (5, "unseen only", None), (6, None, 1), (7, "fine good bad", None), (8, " ", None), (9, "good " * 3000, None),
    ]
    posts = spark.createDataFrame(rows, "id long, content string, train_label int")
    counts = {1: Counter(), 0: Counter()}
    for _, text, label in rows:
        if label in (0, 1):
            counts[label].update(tokens_of(text))
    vocabulary = set(counts[1]) | set(counts[0])
    prior = math.log(2 / 2)

    def log_p(word, c):
        return math.log((counts[c][word] + 1) / (sum(counts[c].values()) + len(vocabulary)))

    want = {}
    for i, text, _ in rows:
        known = [w for w in tokens_of(text) if w in vocabulary]
        margin = sum(log_p(w, 0) - log_p(w, 1) for w in known) - prior
        want[i] = round(1 / (1 + math.exp(max(min(margin, 700), -700))), 4) if known else 0.5
    model = bayes.train(posts)
    model = bayes.BayesModel(WordTable(model.table.words, model.table.weight, small), model.log_prior)
    got = {r.id: r.sentiment_raw_score for r in bayes.predict(posts, model).collect()}
    assert got == pytest.approx(want, abs=1e-4)
    assert got[9] == 1.0 and got[5] == got[6] == got[8] == 0.5


def test_bayes_needs_both_classes(spark):
    posts = spark.createDataFrame([(1, "aa", 1)], "id long, content string, train_label int")
    with pytest.raises(ValueError):
        bayes.train(posts)


def test_bayes_prediction_shuffles_no_text(spark, make_posts):
    posts = make_posts("aa bb", "bb cc").withColumn("train_label", F.col("id").cast("int") - 1)
    model = bayes.train(posts)
    plan = bayes.predict(posts.drop("train_label"), model)._jdf.queryExecution().optimizedPlan().toString()
    assert "content" not in plan.split("Join LeftOuter")[1].splitlines()[1]


# --- segmentation -----------------------------------------------------------------------------


def walk(run, terms):
    out, i = [], 0
    while i < len(run):
        size = next((k for k in range(len(run) - i, 1, -1) if run[i : i + k] in terms), 1)
        out.append(run[i : i + size])
        i += size
    return out


@pytest.mark.parametrize("broadcast", [True, False])
def test_segmentation_against_a_walk(spark, monkeypatch, broadcast):
    monkeypatch.setattr(segment, "fits_broadcast", lambda df: broadcast)
    rng = random.Random(11)
    runs = sorted({"".join(rng.choice("天地玄黄宇") for _ in range(rng.randint(1, 40))) for _ in range(150)} | {"天" * 600})
    terms = sorted({"".join(rng.choice("天地玄黄宇") for _ in range(rng.choice([1, 2, 2, 3, 4, 5, 9]))) for _ in range(40)} | {"天天"})
    df = segment.segment_runs(
        spark.createDataFrame([(r,) for r in runs], "run string"),
        spark.createDataFrame([(t,) for t in terms], "term string"),
    )
    assert {r.run: r.words for r in df.collect()} == {r: walk(r, set(terms)) for r in runs}


def test_segments_of_posts(spark, make_posts):
    posts = make_posts("今天天气真好 ok 天气", None, "abc", "今天天气真好")
    terms = spark.createDataFrame([("今天",), ("天气",), ("天天气",)], "term string")
    got = segment.with_segments(posts, terms).orderBy("id", "run_no", "word_no").collect()
    assert [(r.id, r.run_no, r.word) for r in got] == [
        *((1, 0, w) for w in ("今天", "天气", "真", "好")), (1, 1, "天气"),
        *((4, 0, w) for w in ("今天", "天气", "真", "好")),
    ]
    counts = segment.segmented_word_counts(segment.cjk_run_counts(posts), terms)
    assert {r.word: r.n for r in counts.collect()} == {"今天": 2, "天气": 3, "真": 2, "好": 2}


def test_counting_segmented_rows(spark, make_posts):
    posts = make_posts("今天天气真好 ok 12 天气", None, "天气ok x", dates=["d1", "d1", None])
    terms = ["今天", "天气", "天天气"]
    table = spark.createDataFrame([(t,) for t in terms], "term string")
    rows = segment.segmented_rows(posts, table, ["date"], ["今天"])
    want = {("d1", "天气"): 2, ("d1", "ok"): 1, ("unknown", "天气"): 1, ("unknown", "ok"): 1}
    assert {(r.date, r.word): r.n for r in freq.count_rows(rows).collect()} == want
    inline = freq.word_frequency(posts, stopwords=["今天"], tokenizer=lexicon_tokenizer(terms))
    assert {(r.date, r.word): r.n for r in inline.collect()} == want


def test_lexicon_tokenizer_against_a_walk(spark, make_posts):
    rng = random.Random(7)
    runs = ["".join(rng.choice("天地玄黄") for _ in range(rng.randint(1, 30))) for _ in range(60)]
    terms = {"".join(rng.choice("天地玄黄") for _ in range(rng.choice([2, 2, 3, 4]))) for _ in range(20)}
    words = lexicon_tokenizer(terms, min_len=1)(F.col("content"))
    rows = make_posts(*runs).select("id", words.alias("w")).orderBy("id").collect()
    assert [r.w for r in rows] == [walk(r, terms) for r in runs]
    with pytest.raises(ValueError):
        lexicon_tokenizer([f"天{chr(0x4E00 + i)}" for i in range(501)])


def test_a_list_and_a_table_of_terms_agree(spark, make_posts):
    rng = random.Random(11)
    texts = ["".join(rng.choice("天地玄黄Ab股") for _ in range(rng.randint(1, 25))) for _ in range(60)]
    terms = ["天气", "A股", "abc", "玄黄天", "天地", "b", "股"]
    posts = make_posts("A股天气abcd", *texts)
    table = spark.createDataFrame([(t,) for t in terms], "term string")
    for min_len in (1, 2):
        listed = freq.word_frequency(posts, False, tokenizer=lexicon_tokenizer(terms, min_len=min_len))
        tabled = freq.word_frequency(posts, False, min_len=min_len, terms=table)
        assert {(r.word, r.n) for r in listed.collect()} == {(r.word, r.n) for r in tabled.collect()}


def test_terms_reach_the_report(spark, make_posts):
    posts = make_posts("北京天气好", "天气差")
    table = spark.createDataFrame([("北京",), ("天气",)], "term string")
    with hot_word_report(posts, terms=table) as report:
        assert {r.word: r.word_count for r in report.words.collect()} == {"天气": 2, "北京": 1}


def test_keywords_by_a_tokeniser(make_posts):
    posts = make_posts("x-y x-y b", "b")
    for method in ("frequency", "tfidf"):
        found = keywords.extract_keywords(posts, 1, method, tokenizer=tokenize_whitespace).where("id = 1").first()
        assert found.word == "x-y"


def test_no_terms(spark, make_posts):
    none = spark.createDataFrame([], "term string")
    counts = segment.segmented_word_counts(segment.cjk_run_counts(make_posts("天气")), none)
    assert {r.word: r.n for r in counts.collect()} == {"天": 1, "气": 1}
    assert matching.terms_in_posts(make_posts("天气"), none).count() == 0
