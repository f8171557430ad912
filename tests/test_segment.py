"""Cuts by weighted terms, terms that mix scripts, and words found in the texts."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from termpulse.functions.text import lexicon_tokenizer
from termpulse.operators import frequency as freq
from termpulse.operators import newwords, segment
from termpulse.plans.report import hot_word_report

ATOM = re.compile(r"[一-鿿]|[^一-鿿]+")


def cheapest(run, counts):
    """Every path from the end back; costs as the operator rounds them."""
    atoms = ATOM.findall(run)
    total = sum(counts.values())

    def cost(word):
        return round(math.log(total / max(1, counts.get(word, 1))) * segment.COST_UNIT)

    best = {len(atoms): (0, 0, [])}
    for i in range(len(atoms) - 1, -1, -1):
        options = []
        for j in range(i + 1, len(atoms) + 1):
            word = "".join(atoms[i:j])
            if j == i + 1 or word in counts:
                options.append((cost(word) + best[j][0], i - j, [word, *best[j][2]]))
        best[i] = min(options, key=lambda o: o[:2])
    return best[0][2]


def longest(run, terms):
    atoms, out, i = ATOM.findall(run), [], 0
    while i < len(atoms):
        size = next((k for k in range(len(atoms) - i, 1, -1) if "".join(atoms[i : i + k]) in terms), 1)
        out.append("".join(atoms[i : i + size]))
        i += size
    return out


def random_runs(rng, n):
    return sorted({"".join(rng.choice(["天", "地", "玄", "黄", "A", "b", "7"]) for _ in range(rng.randint(1, 30))) for _ in range(n)})


@pytest.mark.parametrize("broadcast", [True, False])
def test_the_most_likely_cut_by_trying_all(spark, monkeypatch, broadcast):
    monkeypatch.setattr(segment, "fits_broadcast", lambda df: broadcast)
    monkeypatch.setattr(segment, "FOLD", 4)
    rng = random.Random(3)
    runs = random_runs(rng, 150)
    counts = {}
    for _ in range(60):
        atoms = ATOM.findall(rng.choice(runs))
        at = rng.randrange(len(atoms))
        counts["".join(atoms[at : at + rng.choice([1, 2, 2, 3, 4, 6])])] = rng.choice([0, 1, 3, 3, 40, 1000])
    rows = [(t, n) for t, n in counts.items()] + [("天地", 5), ("", 9)]
    counts["天地"] = counts.get("天地", 0) + 5
    counts = {t: max(1, n) for t, n in counts.items()}
    # The total is of the rows as they are; a term seen never counts as seen once.
    real = sum(n for t, n in rows if t)
    terms = spark.createDataFrame(rows, "term string, n long")
    found = segment.segment_runs(spark.createDataFrame([(r,) for r in runs], "run string"), terms, "n").collect()
    assert {r.run: r.words for r in found} == {r: _with_total(r, counts, real) for r in runs}


def _with_total(run, counts, total):
    padded = dict(counts)
    padded["\0"] = total - sum(counts.values())
    return cheapest(run, padded)


def test_longest_match_of_mixed_runs(spark):
    rng = random.Random(5)
    runs = random_runs(rng, 200)
    terms = sorted({"".join(ATOM.findall(rng.choice(runs))[:k]) for k in (1, 2, 2, 3, 4, 7) for _ in range(6)})
    table = spark.createDataFrame([(t,) for t in terms], "term string")
    found = segment.segment_runs(spark.createDataFrame([(r,) for r in runs], "run string"), table).collect()
    assert {r.run: r.words for r in found} == {r: longest(r, set(terms)) for r in runs}


def test_mixed_terms_are_found_by_list_and_table_alike(spark, make_posts):
    posts = make_posts("今天A股大涨", "买T恤和iPhone手机", "去卡拉OK唱歌 卡拉OKAY", "B2B平台", "BA股", None, "plain words")
    terms = ["A股", "T恤", "卡拉OK", "手机", "iPhone手机", "B2B平台"]
    table = spark.createDataFrame([(t,) for t in terms], "term string")
    listed = freq.word_frequency(posts, False, tokenizer=lexicon_tokenizer(terms)).collect()
    tabled = freq.word_frequency(posts, False, terms=table).collect()
    want = {"A股": 1, "T恤": 1, "iPhone手机": 1, "卡拉OK": 1, "OKAY": 1, "B2B平台": 1, "BA": 1, "plain": 1, "words": 1}
    assert {r.word: r.n for r in listed} == {r.word: r.n for r in tabled} == want
    with pytest.raises(ValueError):
        lexicon_tokenizer(["天气", "new york"])


def test_frequencies_decide_in_counts_and_report(spark, make_posts):
    posts = make_posts("研究生命起源", "研究生命")
    rows = [("研究", 900), ("研究生", 90), ("生命", 800), ("命", 10), ("起源", 500)]
    terms = spark.createDataFrame(rows, "term string, n long")
    likely = freq.word_frequency(posts, False, terms=terms, weight="n")
    assert {r.word: r.n for r in likely.collect()} == {"研究": 2, "生命": 2, "起源": 1}
    assert {r.word for r in freq.word_frequency(posts, False, terms=terms).collect()} == {"研究生", "起源"}
    with hot_word_report(posts, terms=terms, weight="n") as report:
        assert {r.word: r.word_count for r in report.words.collect()} == {"研究": 2, "生命": 2, "起源": 1}
    order = segment.with_segments(posts, terms, weight="n").orderBy("id", "run_no", "word_no").collect()
    assert [r.word for r in order] == ["研究", "生命", "起源", "研究", "生命"]


@pytest.mark.parametrize("weight", [None, "n"])
def test_very_long_runs(spark, weight):
    laugh, prose = "哈" * 40_001, "天地玄黄A" * 60_000
    runs = spark.createDataFrame([(laugh,), (prose,)], "run string")
    terms = spark.createDataFrame([("哈哈", 50), ("天地", 9), ("黄A", 3)], "term string, n long")
    found = {r.run: r.words for r in segment.segment_runs(runs, terms, weight).collect()}
    assert found[prose] == ["天地", "玄", "黄A"] * 60_000
    assert Counter(found[laugh]) == {"哈哈": 20_000, "哈": 1} and found[laugh][0] == "哈哈"


def test_no_terms_leave_atoms(spark):
    runs = spark.createDataFrame([("天气A1",), ("天",)], "run string")
    none = spark.createDataFrame([], "term string, n long")
    for weight in (None, "n"):
        assert {r.run: r.words for r in segment.segment_runs(runs, none, weight).collect()} == {"天气A1": ["天", "气", "A1"], "天": ["天"]}
    assert segment.segment_runs(runs.limit(0), none, "n").count() == 0


def test_new_words_by_brute_force(spark, make_posts):
    rng = random.Random(2)
    words, single = ["天地", "玄黄宇", "A股", "洪荒日月"], list("东南西北中 ")
    texts = ["".join(rng.choice(words + single * 2) for _ in range(rng.randint(5, 60))) for _ in range(60)]
    runs = Counter(r for t in texts for r in re.findall(r"\w+", t) if re.search("[一-鿿]", r))
    counts, before, after = Counter(), {}, {}
    for run, n in runs.items():
        atoms = ATOM.findall(run)
        for k in range(1, 5):
            for i in range(len(atoms) - k + 1):
                gram = tuple(atoms[i : i + k])
                counts[gram] += n
                before.setdefault(gram, Counter())[atoms[i - 1] if i else ""] += n
                after.setdefault(gram, Counter())[atoms[i + k] if i + k < len(atoms) else ""] += n
    total = sum(n for g, n in counts.items() if len(g) == 1)

    def entropy(found):
        whole = sum(found.values())
        return round(-sum(m / whole * math.log(m / whole) for m in found.values()), 6)

    want = {}
    for gram, n in counts.items():
        if len(gram) > 1 and n >= 5:
            bits = min(math.log2(n * total / (counts[gram[:k]] * counts[gram[k:]])) for k in range(1, len(gram)))
            if round(bits, 6) >= 1 and min(entropy(before[gram]), entropy(after[gram])) >= 0.5:
                want["".join(gram)] = (n, round(bits, 6), entropy(before[gram]), entropy(after[gram]))
    found = newwords.new_words(make_posts(*texts, None, "no such text")).collect()
    assert {r.term: r.n for r in found} == {t: w[0] for t, w in want.items()}
    for r in found:
        assert (r.information, r.before_entropy, r.after_entropy) == pytest.approx(want[r.term][1:], abs=2e-6)
    assert set(words) <= set(want)
    assert newwords.new_words(make_posts("plain words")).count() == 0


def test_found_words_feed_the_cut(spark, make_posts):
    rng = random.Random(4)
    words = ["天地", "玄黄", "宇宙"]
    texts = ["".join(rng.choice([*words, "东", "西", "南"]) for _ in range(30)) for _ in range(40)]
    runs = segment.mixed_run_counts(make_posts(*texts))
    terms = newwords.term_table(runs, newwords.new_words_of_runs(runs, max_length=2))
    counts = {r.word: r.n for r in segment.segmented_word_counts(runs, terms, "n").collect()}
    joined = "".join(texts)
    assert all(abs(counts[w] - joined.count(w)) <= 0.05 * joined.count(w) for w in words)


def test_windows_of_a_small_table_are_not_shuffled(spark):
    runs = spark.createDataFrame([("天地A",), ("A天地",)], "run string")
    cut = segment.segment_runs(runs, spark.createDataFrame([("天地",)], "term string"))
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "REPARTITION_BY_COL" not in plan
    assert {r.run: r.words for r in cut.collect()} == {"天地A": ["天地", "A"], "A天地": ["A", "天地"]}
