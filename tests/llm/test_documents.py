"""Operators on documents against brute force."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from termpulse.llm import components as comp
from termpulse.llm import decontam, exact_dedup, importance, langid, minhash, suffix_tree, wordhash
from termpulse.llm.common import table


def some_texts(seed=1, n=120):
    """Texts that share passages, and near and exact copies in groups."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["the", "of"] * 40
    passages = [rng.choices(words, k=rng.randint(10, 40)) for _ in range(6)]
    texts = []
    for _ in range(n):
        kind = rng.random()
        if texts and kind < 0.15:
            texts.append(list(rng.choice(texts)))
        elif texts and kind < 0.5:
            copy = list(rng.choice(texts))
            for _ in range(rng.randint(1, 4)):
                if copy:
                    copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(copy)
        else:
            new = rng.choices(words, k=rng.randint(0, 80))
            for _ in range(rng.randint(0, 2)):
                at = rng.randint(0, len(new))
                new[at:at] = rng.choice(passages)
            texts.append(new)
    return [(i, " ".join(t).replace("w7 ", "W7\n")) for i, t in enumerate(texts)]


def test_word_hashes_tell_words_apart():
    raw = "a b  a\tbb b\x0cé é x".encode()
    starts, ends, hashes = wordhash.words(raw)
    found = [raw[s:e] for s, e in zip(starts, ends, strict=True)]
    assert found == raw.split()
    assert len(set(hashes.tolist())) == len(set(found)) and hashes[0] == hashes[2]
    big = b"x" * 3_000_000 + b" y " + b"z" * 10
    assert [int(e - s) for s, e in zip(*wordhash.words(big)[:2], strict=True)] == [3_000_000, 1, 10]
    assert len(wordhash.words(b"")[0]) == 0 and len(wordhash.runs(hashes, 9)) == 0


def thue_morse(n, letters):
    """Words that every polynomial modulo 2^64 takes for its complement."""
    return "".join(letters[bin(k).count("1") % 2] for k in range(n))


MORSE = (thue_morse(4096, "ab"), thue_morse(4096, "ba"))


def test_thue_morse_words_are_different(make_docs):
    assert len({int(wordhash.words(w.encode())[2][0]) for w in (*MORSE, MORSE[0][:2048], MORSE[1][:2048])}) == 4
    tail = " ".join(f"w{k}" for k in range(12))
    docs = make_docs([(k, f"{w} {tail}") for k, w in enumerate(MORSE)] + [(2 + k, f"{w} p q r") for k, w in enumerate(MORSE)])
    assert {r.doc_id: r.n_removed for r in suffix_tree.remove_repeats(docs).collect()} == dict.fromkeys(range(4), 0)
    found = {r.doc_id: r.component_id for r in minhash.find_near_copies(docs).collect()}
    # The long ones share nine of eleven runs of words, the short ones none.
    assert found == {0: 0, 1: 0, 2: 2, 3: 3}
    assert not np.array_equal(*(importance.bins_of(w) for w in MORSE))


def test_word_hashes_are_the_polynomials():
    raw = ("x é " + "word " * 3 + "y" * 3000 + " " + "ab " * 50_000).encode()
    for w, h in list(zip(raw.split(), wordhash.words(raw)[2], strict=True))[:40]:
        value = 0
        for at, byte in enumerate(w):
            value = (value + (byte + 1) * pow(wordhash._BASE, at, wordhash.PRIME)) % wordhash.PRIME
        assert wordhash.mix(np.array([value], np.uint64))[0] == h


def near_components(rows):
    sets = {}
    for i, text in rows:
        words = text.lower().split()
        sets[i] = {tuple(words[k : k + 4]) for k in range(len(words) - 3)} or ({tuple(words)} if words else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if j < i and both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("block", [1024, 2])
def test_near_copies(make_docs, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = some_texts(4, 150)
    found = minhash.find_near_copies(make_docs(rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == near_components(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def _one_word_changed(n, changes, base):
    """Two texts of ``n`` distinct words that differ in ``changes`` isolated ones."""
    words = [f"b{base}w{i}" for i in range(n)]
    other = list(words)
    for c in range(changes):
        other[n * (2 * c + 1) // (2 * changes)] = f"b{base}x{c}"
    return " ".join(words), " ".join(other)


def test_the_pipeline_compares_runs_of_five_words(spark, make_docs, sf):
    pairs = [_one_word_changed(n, c, k) for k, (n, c) in enumerate([(40, 1), (80, 2), (200, 5), (60, 1)])]
    docs = make_docs([(2 * k + j, t) for k, pair in enumerate(pairs) for j, t in enumerate(pair)])
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, sf).collect()}
    # Only 60 words with one change reach 0.8 with five words; with four words all do.
    assert kept == {0, 1, 2, 3, 4, 5, 6}
    by_four = {r.doc_id for r in minhash.find_near_copies(docs).filter("kept").collect()}
    assert by_four == {0, 2, 4, 6}


def near_components_by(rows, size):
    """``near_components`` over runs of ``size`` words."""
    sets = {}
    for i, text in rows:
        words = text.lower().split()
        sets[i] = {tuple(words[k : k + size]) for k in range(len(words) - size + 1)} or ({tuple(words)} if words else set())
    root = {i: i for i in sets}
    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if j < i and both and 100 * both >= 80 * len(sets[i] | sets[j]):
                low, high = sorted((root[i], root[j]))
                root = {k: low if r == high else r for k, r in root.items()}
    return root


@pytest.mark.parametrize("block", [1024, 2])
def test_near_copies_of_the_pipeline(spark, make_docs, sf, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = some_texts(4, 150)
    root = near_components_by(rows, 5)
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, make_docs(rows), sf).collect()}
    assert kept == {i for i, r in root.items() if i == r}


def test_pruning_keeps_pairs_at_the_threshold():
    for n in (16, 64, 128):
        fewest = minhash.fewest_matches(n)
        assert 0 < fewest < 0.8 * n
    assert minhash.fewest_matches(128) > minhash.fewest_matches(16)


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)]
    root = {i: i for pair in links for i in pair}
    for _ in range(500):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    found = comp.components(spark.createDataFrame(links, "u long, v long")).collect()
    assert {r.u: r.v for r in found} == {i: r for i, r in root.items() if i != r}


@pytest.mark.parametrize("group", [10_000, 1])
def test_repeated_passages(make_docs, group):
    rows = some_texts(9)
    first, words = {}, {i: t.split() for i, t in rows}
    for i, ws in words.items():
        for k in range(len(ws) - 12):
            first.setdefault(tuple(ws[k : k + 13]), i)
    expected = {}
    for i, ws in words.items():
        gone = set()
        for k in range(len(ws) - 12):
            if first[tuple(ws[k : k + 13])] < i:
                gone |= set(range(k, k + 13))
        expected[i] = (len(ws), len(gone), " ".join(w for k, w in enumerate(ws) if k not in gone))
    found = suffix_tree.remove_repeats(make_docs(rows), group=group).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, bytes(r.kept_text).decode()) for r in found} == expected
    spans = suffix_tree.maximal_spans(make_docs(rows), group=group).collect()
    total = Counter()
    for r in spans:
        assert r.end - r.start >= 13
        total[r.doc_id] += r.end - r.start
    assert total == Counter({i: n for i, (_, n, _) in expected.items() if n})


@pytest.mark.parametrize("entries, bits", [(500_000, 64), (3, 64), (3, 6), (500_000, 1)])
def test_exact_copies(make_docs, entries, bits):
    rows = some_texts(6) + [(900, "AÉ"), (901, "aÉ"), (902, "aé")]
    groups = defaultdict(list)
    for i, t in rows:
        groups["".join(c.lower() if c.isascii() else c for c in t)].append(i)
    found = exact_dedup.find_copies(make_docs(rows), bucket_entries=entries, hash_bits=bits).collect()
    assert {r.doc_id: (r.keep_id, r.group_size) for r in found} == {i: (max(g), len(g)) for g in groups.values() for i in g}
    by_bucket = Counter({(r.bucket, r.keep_id) for r in found})
    if entries == 3 and bits == 64:
        assert max(Counter(b for b, _ in by_bucket).values()) <= 3 and len({b for b, _ in by_bucket}) > 20
    # Texts that share a hash are told apart in its chain.
    assert (max(r.chain for r in found) > 1) == (bits < 64)
    if bits == 1:
        assert len({(r.bucket, r.chain) for r in found}) < len(groups) == len({(r.keep_id, r.chain) for r in found})


def test_owners_decide(make_docs):
    """Copies, also of a hot text, meet in the task that owns their bucket; nothing is
    shuffled between routing and the written entry but what goes to the owner."""
    rows = exact_dedup.keyed(make_docs([(i, "hot" if i % 3 else f"text {i}") for i in range(300)]))
    placed = rows.withColumn("_bucket", F.col("_hash") % 2)
    entries = exact_dedup.owned_entries(placed)
    assert sorted((r._size, r._keep) for r in entries.collect())[-1] == (200, 299)
    plan = entries._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    owners, slices = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert "REPARTITION_BY_COL" in owners and "_text" not in owners and "_text" in slices


QUESTION = "A train leaves Boston at 3 pm and travels 120 km in 2 hours, so how fast does it go, Alice asks Bob today."


def test_leaks(spark, make_docs):
    items = [(1, QUESTION), (2, "too short"), (3, "six words are here for you"), (4, "1 2 3 4 5 6 7 8 9 10")]
    texts = [
        "Intro. " + QUESTION.replace("Boston", "Denver").replace("3", "5").replace("120", "300").replace("Alice", "Carol"),
        "now SIX words, are here for you",
        QUESTION.replace("km in 2", "km in 2 or 3"),
        "A train of thought that has nothing to do with any of it, but is long enough for windows.",
        "1 2 3 4 5 6 7 8 9 10",
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {r.doc_id: (r.item, r.changed) for r in decontam.find_leaks(make_docs(list(enumerate(texts))), bench).collect()}
    # The words put in shift the rest: there, 3 hours stand for 2.
    assert found == {0: (1, True), 1: (3, False), 2: (1, True), 4: (4, False)}


def test_inconsistent_slots_are_no_leak(spark, make_docs):
    item = "tell me if Anna pays 5 dollars and then Anna pays 5 dollars again how much Anna has paid by then"
    same = item.replace("Anna", "Clara").replace("5", "9")
    mixed = "tell me if Clara pays 5 dollars and then Maria pays 6 dollars again how much Sophie has paid by then"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    found = decontam.find_leaks(make_docs([(1, same), (2, mixed)]), bench).collect()
    assert [(r.doc_id, r.changed) for r in found] == [(1, True)]


def test_repeated_and_scattered_phrases_are_no_leak(spark, make_docs):
    item = " ".join(f"w{chr(97 + i)}" for i in range(26)) + " " + " ".join(f"v{chr(97 + i)}" for i in range(26))
    words, fill = item.split(), " filler" * 30 + " "
    texts = [
        (fill + " ".join(words[4:12])) * 9,
        " ".join(words[4:12] * 9),
        fill.join(" ".join(words[k : k + 8]) for k in range(0, 48, 8)),
        fill + " ".join(words[4:17]) + fill,
        fill + " ".join([*words[4:14], "one", "two", *words[14:24]]),
    ]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    found = {r.doc_id: r.windows for r in decontam.find_leaks(make_docs(list(enumerate(texts))), bench).collect()}
    assert found == {3: 6, 4: 6}


def test_copies_are_found_wherever_names_begin(spark, make_docs):
    items = [(1, "Paris lies on the river"), (2, "we heard that Anna Berta Clara Doris Emma and Frida never came back from there")]
    texts = [
        "and then Paris lies on the river as ever",
        "x " + items[1][1].lower(),
        items[1][1].replace(" ", "\n"),
        "and then London lies on the bridge",
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item) for r in decontam.find_leaks(make_docs(list(enumerate(texts))), bench).collect()}
    assert found == {(0, 1), (1, 2), (2, 2)}


def test_items_poor_in_words_and_short_items(spark, make_docs):
    items = [(1, "What is 12 plus seven"), (2, "3 4 5 6 7 8 9 10 11"), (3, "Capital of France?"), (4, "天气很好我们去公园")]
    texts = [
        "now what is 12 plus seven or so",
        "count 3 4 5 6 7 8 9 10 11 up",
        "Quiz\ncapital of france\nParis",
        "今天天气很好我们去公园玩",
        "the capital of France is big, what is 13 plus seven, 3 4 5 6 8",
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item) for r in decontam.find_leaks(make_docs(list(enumerate(texts))), bench).collect()}
    assert found == {(0, 1), (1, 2), (2, 3), (3, 4)}


def test_everyday_phrases_need_a_second_sign(spark, make_docs):
    items = [(1, "Python"), (2, "the answer is yes"), (3, QUESTION)]
    texts = [
        "Languages we use\nPython\nJava\nand some others that came later",
        "I asked them twice and they think that the answer is yes but nobody knows for sure",
        "The answer is yes.",
        "Python",
        QUESTION + "\nPython\nand some more words, the answer is yes, on top of it all",
        "a\nPython\nlist, and they think that the answer is yes but nobody knows",
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item) for r in decontam.find_leaks(make_docs(list(enumerate(texts))), bench).collect()}
    assert found == {(2, 2), (3, 1), (4, 1), (4, 2), (4, 3)}


def test_languages_of_held_out_documents(spark, sf):
    docs = table(spark, sf, "documents")
    # Without the declaration and the host of every other document the text must do.
    half = F.col("doc_id") % 2 == 0
    found = langid.identify(docs, F.col("text"), F.when(half, F.col("lang")), F.when(half, F.col("source")))
    rows = found.join(docs, "doc_id").select("doc_id", "language", "lang", "kept").collect()
    held_out = [r for r in rows if r.doc_id % 2]
    assert sum(r.language == r.lang for r in held_out) >= 0.98 * len(held_out)
    assert all(r.kept for r in rows)


def test_evidence_from_addresses_and_markup(spark):
    rows = [("http://user@WWW.Example.de:80/x?y", '<!DOCTYPE html><HTML class=a LANG="de-AT">'), ("nothing", "<p lang=fr>")]
    df = spark.createDataFrame(rows, "url string, html string")
    host = langid.host_of(F.col("url"))
    found = df.select(host, langid.suffix_of(host), langid.declared_in(F.col("html"))).collect()
    assert [tuple(r) for r in found] == [("www.example.de", "de", "de"), (None, None, None)]


def test_pages(spark, sf):
    pages = table(spark, sf, "pages").withColumn("doc_id", F.col("page_id"))
    text = F.regexp_replace("html", "<[^>]*>", " ")
    found = langid.identify(pages, text, langid.declared_in(F.col("html")), langid.host_of(F.col("url"))).collect()
    assert len(found) == pages.count() and all(r.kept for r in found)


def test_hosts_decide_where_texts_cannot(make_docs):
    rows = [(i, f"bonjour le monde et la maison {i}", "fr", "a.fr") for i in range(60)]
    rows += [(100 + i, f"hello the world and the house {i}", "en", "b.com") for i in range(60)]
    rows += [(500, "xyz", None, "a.fr"), (501, "xyz", None, "b.com")]
    found = langid.identify(make_docs(rows), F.col("text"), F.col("lang"), F.col("source"))
    got = {r.doc_id: r.language for r in found.filter("doc_id >= 500").collect()}
    assert got == {500: "fr", 501: "en"}


def test_the_sample_counts_distinct_texts(spark):
    rows = [("aa", f"text {chr(97 + i % 20)}{chr(97 + i // 20)} of many") for i in range(100)]
    docs = spark.createDataFrame(rows, "_declared string, _text string")
    copies = docs.crossJoin(spark.range(400)).drop("id")
    texts = [r._piece for r in langid.sample(copies, per_language=80).collect()]
    assert len(set(texts)) == len(texts) == 80


def many_languages(n):
    """Texts of ``n`` made-up languages, each with letters of its own."""
    rng = random.Random(8)
    for code in range(n):
        letters = [chr(0x4E00 + 20 * code + k) for k in range(20)]
        for k in range(6):
            text = " ".join("".join(rng.choices(letters, k=5)) for _ in range(12))
            yield code * 10 + k, text, f"l{code:03}" if k < 5 else None, f"h{code}.s{code % 3}"


def test_every_declared_language_is_known(make_docs):
    rows = list(many_languages(90))
    docs = make_docs(rows)
    found = langid.identify(docs, F.col("text"), F.col("lang"), F.col("source")).collect()
    assert {r.doc_id: r.language for r in found} == {i: f"l{i // 10:03}" for i, *_ in rows}
    kept = langid.keep_identified(docs, F.col("text"), F.col("lang"), F.col("source"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r[0] for r in rows)


def test_fusion_by_brute_force(make_docs):
    """Bayes' rule in plain Python over the same n-grams."""
    rng = random.Random(4)
    vocabulary = {"de": "der die und das haus baum", "en": "the and house tree of on", "nl": "de het en huis boom van"}
    rows = []
    for i in range(150):
        true = rng.choice(sorted(vocabulary))
        words = rng.choices(vocabulary[true].split(), k=rng.randint(1, 6))
        declared = rng.choice([true, true, "en", "xx", None])
        rows.append((i, " ".join(words) if i % 17 else "12 34", declared, rng.choice([f"a.{true}", "b.com", "plain", None])))
    grams = defaultdict(Counter)

    def bins(text):
        letters = "".join(c.lower() if c.isalpha() else " " for c in text)
        raw = f" {' '.join(letters.split())} ".encode() if letters.strip() else b"  "
        found = Counter()
        for order in langid.ORDERS:
            for at in range(len(raw) - order + 1):
                key = order
                for byte in raw[at : at + order]:
                    key = key * 0x01000193 % 2**32 ^ byte
                key ^= key >> 15
                found[key * 0x9E3779B1 % 2**32 >> 17] += 1
        return found

    for text, declared in {(t, d) for _, t, d, _ in rows if d and any(c.isalpha() for c in t)}:
        grams[declared] += bins(text)
    languages = sorted(grams)
    size = {x: sum(grams[x].values()) + langid.BINS for x in languages}

    def scores(text):
        return [sum(n * math.log((grams[x][b] + 1) / size[x]) for b, n in bins(text).items()) / langid.TEMPERING for x in languages]

    best = {i: scores(t).index(max(scores(t))) for i, t, _, _ in rows if any(c.isalpha() for c in t)}
    n = len(languages)
    everywhere = [sum(b == k for b in best.values()) + 1 for k in range(n)]
    everywhere = [x / sum(everywhere) for x in everywhere]

    def smoothed(ids, parent, weight):
        counts = [sum(best[i] == k for i in ids) for k in range(n)]
        return [(c + p * weight) / (len(ids) + weight) for c, p in zip(counts, parent, strict=True)]

    def suffix(host):
        return host.rsplit(".", 1)[1] if host and "." in host else None

    def prior(host):
        same = [i for i, _, _, h in rows if h == host and i in best]
        if host is None or not same:
            return everywhere
        parent = everywhere
        if suffix(host):
            parent = smoothed([i for i, _, _, h in rows if suffix(h) == suffix(host) and i in best], everywhere, langid.SUFFIX_WEIGHT)
        return smoothed(same, parent, langid.HOST_WEIGHT)

    said = {x: [sum(best[i] == k for i, _, d, _ in rows if d == x and i in best) + langid.DECLARED_PRIOR for k in range(n)] for x in languages}
    want = {}
    for i, text, declared, host in rows:
        logs = [a + math.log(p) for a, p in zip(scores(text), prior(host), strict=True)]
        if declared in said:
            logs = [x + math.log(said[declared][k] / sum(said[c][k] for c in languages)) for k, x in enumerate(logs)]
        total = sum(math.exp(x - max(logs)) for x in logs)
        sure = i in best and 1 / total >= langid.MIN_POSTERIOR
        want[i] = (languages[logs.index(max(logs))] if sure else "und", 1 / total if i in best else 0.0)
    found = langid.identify(make_docs(rows), F.col("text"), F.col("lang"), F.col("source")).collect()
    assert {r.doc_id: r.language for r in found} == {i: w[0] for i, w in want.items()}
    assert all(abs(r.probability - want[r.doc_id][1]) < 1e-4 for r in found)
    assert {w[0] for w in want.values()} >= {"de", "en", "nl", "und"}


@pytest.mark.parametrize("k", [1, 7, 2_999, 3_000])
def test_cut_is_the_kth_largest(spark, k):
    rng = random.Random(3)
    values = [rng.choice([rng.gauss(0, 1), 5.0, -1e6]) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert importance.cut(df, "v", k) == sorted(values, reverse=True)[k - 1]
    assert importance.cut(df, "v", 3001) is None


def test_resampling_prefers_the_target(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    found = importance.resample(docs, labels.filter("quality = 1 AND toxic = 0 AND doc_id % 2 = 0"), 0.8)
    again = importance.resample(docs.repartition(7), labels.filter("quality = 1 AND toxic = 0 AND doc_id % 2 = 0"), 0.8)
    kept = {r.doc_id for r in found.filter("kept").collect()}
    assert kept == {r.doc_id for r in again.filter("kept").collect()} and len(kept) == round(0.8 * docs.count())
    held_out = [r for r in labels.filter("doc_id % 2 = 1 AND toxic = 0").collect()]
    share = {q: [r.doc_id in kept for r in held_out if r.quality == q] for q in (0, 1)}
    assert sum(share[1]) / len(share[1]) > sum(share[0]) / len(share[0]) + 0.3


def test_pipeline_by_brute_force_with_runs_of_five_words(spark, sf):
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect() if any(c.isalpha() for c in r.text)]
    lowered = {i: "".join(c.lower() if c.isascii() else c for c in t) for i, t in rows}
    last = {t: i for i, t in sorted(lowered.items())}
    rows = [(i, t) for i, t in rows if last[lowered[i]] == i]
    root = near_components_by([(i, lowered[i]) for i, _ in rows], corpus_pipeline.SHINGLE)
    items = [r.text for r in table(spark, sf, "benchmark").collect()]
    want = {i for i, t in rows if root[i] == i and not any(x in t for x in items)}
    found = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in found} == want
    assert all(r.n_tokens * 4 == len(r.ids) for r in found)
