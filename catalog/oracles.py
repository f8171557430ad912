"""SQL counterparts of the registered queries, for DuckDB.

Written from the meaning of each operator, not from its Spark plan: the plain
regular expressions, nested loops over word lists and full windows here are the
independent check.
"""

from __future__ import annotations

from catalog import posts_view as V
from termpulse import settings as S
from termpulse.functions.text import DIGIT_EXTRAS

SPACE = r"\s\p{Z}\x{0B}\x{1C}-\x{1F}\x{85}"
WORD = r"\p{L}\p{N}_"
CJK = r"\x{4E00}-\x{9FFF}"
DIGITS = rf"^[\p{{Nd}}{DIGIT_EXTRAS}]+$"


def _list(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


POSTS = f"""
posts AS MATERIALIZED (
  SELECT doc_id AS id,
    CASE WHEN doc_id % 97 = 5 THEN 'not-a-date'
         WHEN doc_id % 89 = 7 THEN NULL
         WHEN doc_id % 11 = 3 THEN strftime(DATE '2020-01-20' + CAST(doc_id % 102 AS INTEGER), '%Y-%m-%d') || ' 13:45:00'
         ELSE strftime(DATE '2020-01-20' + CAST(doc_id % 102 AS INTEGER), '%Y-%m-%d') END AS date,
    CASE WHEN doc_id % 101 = 11 THEN NULL
         WHEN doc_id % 103 = 13 THEN ''
         WHEN doc_id % 107 = 17 THEN '   '
         WHEN doc_id % 5 = 0 THEN text || ' http://t.co/x' || CAST(doc_id AS VARCHAR) || ' tail'
         ELSE text END AS content,
    list_extract([{_list(V.EMOTIONS)}], CAST(doc_id % 7 + 1 AS BIGINT)) AS emotion,
    source
  FROM documents)"""

RANGE = f"""
ranged AS MATERIALIZED (
  SELECT * FROM posts
  WHERE try_cast(date AS TIMESTAMP) >= TIMESTAMP '{V.START} 00:00:00'
    AND try_cast(date AS TIMESTAMP) <= TIMESTAMP '{V.END} 00:00:00')"""

EMPTY = """
nothing AS MATERIALIZED (
  SELECT * FROM posts WHERE try_cast(date AS TIMESTAMP) >= TIMESTAMP '2031-01-01 00:00:00')"""


def _clean(text: str) -> str:
    no_url = rf"regexp_replace({text}, 'https?://[^{SPACE}]+', '', 'g')"
    no_mail = rf"regexp_replace({no_url}, '[^{SPACE}]+@[^{SPACE}]+', '', 'g')"
    return rf"trim(regexp_replace({no_mail}, '[{SPACE}]+', ' ', 'g'))"


def _words(text: str, stop: bool = True) -> str:
    no_stop = f" AND w NOT IN ({_list(V.STOPWORDS)})" if stop else ""
    return (
        rf"list_filter(regexp_extract_all({_clean(text)}, '[{WORD}]+'), "
        rf"lambda w: length(w) >= 2 AND NOT regexp_matches(w, '{DIGITS}'){no_stop})"
    )


def _tokens(table: str = "posts", name: str = "tokens") -> str:
    return f"""
{name} AS MATERIALIZED (
  SELECT id, date, unnest({_words('content')}) AS word FROM {table}
  WHERE content IS NOT NULL AND content <> '')"""


def _dated(table: str = "posts") -> str:
    return _tokens(table) + """,
dated AS MATERIALIZED (
  SELECT coalesce(date, 'unknown') AS date, word, count(*) AS n FROM tokens GROUP BY ALL)"""


def _total(table: str = "posts") -> str:
    return _tokens(table) + """,
total AS MATERIALIZED (SELECT word, count(*) AS n FROM tokens GROUP BY word)"""


def _present(terms) -> str:
    return " + ".join(f"CAST(contains(content, '{t}') AS INTEGER)" for t in terms)


_BLANK = rf"(content IS NULL OR NOT regexp_matches(content, '[^{SPACE}]'))"


def _classed(table: str, raw: str, name: str) -> str:
    """Scores, class and label from a raw score expression."""
    return f"""
{name} AS MATERIALIZED (
  SELECT *, round_even(raw, 4) AS sentiment_raw_score,
    round_even(raw * 9 + 1, 2) AS sentiment_score,
    CASE WHEN raw >= 0.6::DOUBLE THEN 'positive' WHEN raw <= 0.4::DOUBLE THEN 'negative' ELSE 'neutral' END AS sentiment,
    CASE WHEN raw >= 0.6::DOUBLE THEN 1 WHEN raw <= 0.4::DOUBLE THEN 0 ELSE -1 END AS sentiment_label,
    CAST(round_even(round_even(raw * 9 + 1, 2) * 100, 0) AS BIGINT) AS cents
  FROM (SELECT *, {raw} AS raw FROM {table}))"""


def _scored(table: str = "posts", name: str = "scored") -> str:
    counted = f"(SELECT *, {_present(V.POSITIVE)} AS pos, {_present(V.NEGATIVE)} AS neg FROM {table})"
    raw = (
        f"CASE WHEN {_BLANK} OR pos + neg = 0 THEN 0.5::DOUBLE "
        "ELSE CAST(pos AS DOUBLE) / (pos + neg) END"
    )
    return _classed(counted, raw, name)


_SCORE_COLUMNS = "id, sentiment_raw_score, sentiment_score, sentiment, sentiment_label"


def _avg(total: str, n: str) -> str:
    return f"CASE WHEN {n} > 0 THEN round_even({total} / ({n} * 100.0::DOUBLE), 2) ELSE 5.5::DOUBLE END"


def _ratio(part: str, n: str) -> str:
    return f"CASE WHEN {n} > 0 THEN round_even(CAST({part} AS DOUBLE) / {n}, 4) ELSE 0.0::DOUBLE END"


def _distribution(table: str = "scored") -> str:
    return f"""
dist AS (
  SELECT c.sentiment, count(s.cents) AS n,
    {_ratio('count(s.cents)', f'(SELECT count(*) FROM {table})')} AS ratio,
    {_avg(f'(SELECT sum(cents)::DOUBLE FROM {table})', f'(SELECT count(*) FROM {table})')} AS avg_score
  FROM (VALUES ('positive'), ('negative'), ('neutral')) c(sentiment)
  LEFT JOIN {table} s ON s.sentiment = c.sentiment GROUP BY c.sentiment)"""


def _word_stats(words: str, scored: str = "scored", name: str = "stats", cap: int | None = None) -> str:
    """Statistics of the rows of ``words`` (with a ``word`` column)."""
    drawn = f"draw <= {cap}" if cap else "TRUE"
    return f"""
hits AS MATERIALIZED (
  SELECT w.word, s.id, s.cents, s.sentiment,
    row_number() OVER (PARTITION BY w.word ORDER BY md5(CAST(s.id AS VARCHAR) || '|42'), s.id) AS draw
  FROM {words} w JOIN {scored} s ON contains(s.content, w.word)),
sums AS (
  SELECT word, count(*) AS total_count, count(*) FILTER ({drawn}) AS k,
    sum(cents) FILTER ({drawn})::DOUBLE AS cents,
    count(*) FILTER ({drawn} AND sentiment = 'positive') AS pos,
    count(*) FILTER ({drawn} AND sentiment = 'negative') AS neg,
    count(*) FILTER ({drawn} AND sentiment = 'neutral') AS neu
  FROM hits GROUP BY word),
{name} AS (
  SELECT w.*, coalesce(total_count, 0) AS total_count,
    {_avg('cents', 'coalesce(k, 0)')} AS avg_score,
    CASE WHEN pos > neg THEN 'positive' WHEN neg > pos THEN 'negative' ELSE 'neutral' END AS sentiment,
    coalesce(pos, 0) AS positive_count, coalesce(neg, 0) AS negative_count, coalesce(neu, 0) AS neutral_count,
    {_ratio('pos', 'coalesce(k, 0)')} AS positive_ratio, {_ratio('neg', 'coalesce(k, 0)')} AS negative_ratio
  FROM {words} w LEFT JOIN sums USING (word))"""


def _asked(words) -> str:
    return "asked(word) AS (VALUES " + ", ".join(f"('{w}')" for w in words) + ")"


def _top(n: int, table: str = "total", name: str = "top") -> str:
    return f"""
{name} AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY n DESC, word) AS rank, word, n FROM {table} ORDER BY n DESC, word LIMIT {n})"""


_LISTS = """
lists AS MATERIALIZED (
  SELECT date, rank, word, n FROM (
    SELECT *, row_number() OVER (PARTITION BY date ORDER BY n DESC, word) AS rank
    FROM dated WHERE date <> 'unknown') WHERE rank <= 20)"""
_TABLE_LISTS = _LISTS.replace("WHERE date <> 'unknown'", "")


def _series(table: str, words, cap: int | None = None) -> str:
    drawn = f"draw <= {cap}" if cap else "TRUE"
    return _scored(table) + f""",
{_asked(words)},
series AS MATERIALIZED (
  SELECT word, day, {_avg('sum(cents)::DOUBLE', 'count(*)')} AS avg_score FROM (
    SELECT a.word, s.cents, strftime(try_cast(date AS TIMESTAMP), '%Y-%m-%d') AS day,
      row_number() OVER (PARTITION BY a.word, strftime(try_cast(date AS TIMESTAMP), '%Y-%m-%d')
                         ORDER BY md5(CAST(s.id AS VARCHAR) || '|42'), s.id) AS draw
    FROM asked a JOIN scored s ON contains(s.content, a.word)
    WHERE try_cast(date AS TIMESTAMP) IS NOT NULL)
  WHERE {drawn} GROUP BY word, day)"""


_SUMMARY = f"""
summary AS (
  SELECT word, count(*) AS points,
    {_avg('sum(round_even(avg_score * 100, 0))', 'count(*)')} AS mean_score,
    max(avg_score) AS max_score,
    (SELECT min(day) FROM series i WHERE i.word = o.word AND i.avg_score = max(o.avg_score)) AS max_day,
    min(avg_score) AS min_score,
    (SELECT min(day) FROM series i WHERE i.word = o.word AND i.avg_score = min(o.avg_score)) AS min_day
  FROM series o GROUP BY word)"""

_SIDE = "CASE WHEN avg_score >= 5.5 THEN 'positive' ELSE 'negative' END AS side"
_TITLE = "CASE sentiment WHEN 'positive' THEN '正面' WHEN 'negative' THEN '负面' ELSE '中性' END AS title"


def _report() -> str:
    return ", ".join(
        [
            POSTS,
            RANGE,
            _total("ranged"),
            _top(20).replace("word, n FROM", "word, n AS word_count FROM"),
            _scored("ranged"),
            _word_stats("top"),
        ]
    )


LABELLED = """
labelled AS MATERIALIZED (
  SELECT p.*, CASE WHEN l.doc_id IS NULL THEN NULL WHEN l.toxic = 1 THEN 0 WHEN l.quality = 1 THEN 1 ELSE -1 END AS train_label
  FROM posts p LEFT JOIN labels l ON l.doc_id = p.id)"""

NB = f"""
{_tokens()},
counts AS MATERIALIZED (
  SELECT word, count(*) FILTER (train_label = 1) AS pos_n, count(*) FILTER (train_label = 0) AS neg_n
  FROM tokens JOIN labelled USING (id) WHERE train_label IN (0, 1) GROUP BY word),
model AS MATERIALIZED (
  SELECT word, pos_n, neg_n,
    ln((pos_n + 1)::DOUBLE / ((SELECT sum(pos_n) FROM counts) + (SELECT count(*) FROM counts))) AS log_pos,
    ln((neg_n + 1)::DOUBLE / ((SELECT sum(neg_n) FROM counts) + (SELECT count(*) FROM counts))) AS log_neg
  FROM counts)"""

_TOP_K = """
SELECT id, CAST(rank AS INTEGER) AS rank, word, weight FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY weight DESC, word) AS rank FROM weighted)
WHERE rank <= 10"""


def _with(*ctes: str) -> str:
    return "WITH " + ",".join(c.strip("\n") for c in ctes) + "\n"


def _textrank(rounds: int = 10) -> str:
    parts = [
        POSTS,
        f"""
seq AS MATERIALIZED (
  SELECT id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM (
    SELECT id, {_words('content')} AS ws FROM posts WHERE content IS NOT NULL AND content <> ''))""",
        """
links AS MATERIALIZED (
  SELECT id, a, b, count(*) AS w FROM (
    SELECT x.id, x.word AS a, y.word AS b FROM seq x JOIN
      (SELECT id, word, pos, unnest([-4, -3, -2, -1, 1, 2, 3, 4]) AS d FROM seq) y
      ON x.id = y.id AND x.pos = y.pos + y.d WHERE x.word <> y.word)
  GROUP BY ALL)""",
        """
shares AS MATERIALIZED (
  SELECT id, a, b, w::DOUBLE / sum(w) OVER (PARTITION BY id, a) AS share FROM links)""",
        "r0 AS MATERIALIZED (SELECT DISTINCT id, a AS word, 1.0::DOUBLE AS r FROM links)",
    ]
    for i in range(1, rounds + 1):
        parts.append(f"""
r{i} AS MATERIALIZED (
  SELECT s.id, s.b AS word, 0.15::DOUBLE + 0.85::DOUBLE * sum(s.share * p.r) AS r
  FROM shares s JOIN r{i - 1} p ON p.id = s.id AND p.word = s.a GROUP BY s.id, s.b)""")
    parts.append(f"weighted AS (SELECT id, word, round_even(r, 6) AS weight FROM r{rounds})")
    return _with(*parts) + _TOP_K


_HAN = f"""
han AS MATERIALIZED (SELECT id, translate(lower(content), '{V.LATIN}', '{V.HAN}') AS content FROM posts),
runs AS MATERIALIZED (
  SELECT run, count(*) AS n FROM (
    SELECT unnest(regexp_extract_all({_clean('content')}, '[{CJK}]+')) AS run FROM han
    WHERE content IS NOT NULL AND content <> '') GROUP BY run)"""


# Runs of word characters with a CJK character, as lists of their atoms.
_MIXED = f"""
han AS MATERIALIZED (SELECT id, translate(lower(content), '{V.LATIN}', '{V.HAN}') AS content FROM posts),
runs AS MATERIALIZED (
  SELECT run, n, regexp_extract_all(run, '[{CJK}]|[^{CJK}]+') AS atoms
  FROM (SELECT run, count(*) AS n FROM (
    SELECT unnest(regexp_extract_all({_clean('content')}, '[{WORD}]+')) AS run FROM han
    WHERE content IS NOT NULL AND content <> '') WHERE regexp_matches(run, '[{CJK}]') GROUP BY run))"""

# Every n-gram of one to four atoms, with what stands beside it.
_NEW_WORDS = """
grams AS MATERIALIZED (
  SELECT k, n, array_to_string(atoms[i : i + k - 1], '') AS gram,
         CASE WHEN i > 1 THEN atoms[i - 1] ELSE '' END AS before,
         CASE WHEN i + k <= len(atoms) THEN atoms[i + k] ELSE '' END AS after, atoms[i : i + k - 1] AS parts
  FROM (SELECT n, atoms, k, unnest(range(1, len(atoms) - k + 2)) AS i
        FROM runs, (VALUES (1), (2), (3), (4)) t(k) WHERE len(atoms) >= k)),
frequent AS MATERIALIZED (
  SELECT k, gram, any_value(parts) AS parts, sum(n) AS c FROM grams GROUP BY k, gram HAVING sum(n) >= 20),
total AS (SELECT sum(n) AS t FROM grams WHERE k = 1),
cuts AS (
  SELECT k, gram, c, array_to_string(parts[1 : j], '') AS head, array_to_string(parts[j + 1 : k], '') AS tail
  FROM (SELECT *, unnest(range(1, k)) AS j FROM frequent WHERE k > 1)),
information AS (
  SELECT x.gram, any_value(x.c) AS n, min(log2(CAST(x.c AS DOUBLE) * t / (CAST(h.c AS DOUBLE) * CAST(l.c AS DOUBLE)))) AS information
  FROM cuts x JOIN frequent h ON h.gram = x.head JOIN frequent l ON l.gram = x.tail CROSS JOIN total GROUP BY x.gram),
befores AS (
  SELECT gram, ln(sum(m)) - sum(m * ln(m)) / sum(m) AS h
  FROM (SELECT gram, before, CAST(sum(n) AS DOUBLE) AS m FROM grams WHERE k > 1 GROUP BY gram, before) GROUP BY gram),
afters AS (
  SELECT gram, ln(sum(m)) - sum(m * ln(m)) / sum(m) AS h
  FROM (SELECT gram, after, CAST(sum(n) AS DOUBLE) AS m FROM grams WHERE k > 1 GROUP BY gram, after) GROUP BY gram),
found AS MATERIALIZED (
  SELECT * FROM (
    SELECT gram AS term, CAST(n AS BIGINT) AS n, round(information, 6) AS information,
           round(greatest(b.h, 0.0), 6) AS before_entropy, round(greatest(a.h, 0.0), 6) AS after_entropy
    FROM information JOIN befores b USING (gram) JOIN afters a USING (gram))
  WHERE information >= 1.0 AND least(before_entropy, after_entropy) >= 0.5)"""


def _greedy(longest: int) -> str:
    """Words of ``runs`` by the longest match with ``terms``, up to some atoms."""
    tries = " ".join(
        f"WHEN place + {k - 1} <= len(atoms) AND array_to_string(atoms[place : place + {k - 1}], '') IN (FROM terms) THEN {k}"
        for k in range(longest, 1, -1)
    )
    return f"""
path AS (
  SELECT run, n, atoms, 1 AS place, 0 AS size FROM runs
  UNION ALL
  SELECT run, n, atoms, place, CASE {tries} ELSE 1 END
  FROM (SELECT run, n, atoms, place + size AS place FROM path) WHERE place <= len(atoms))"""


def _likeliest(longest: int) -> str:
    """Words of ``runs`` by the least sum of costs in ``priced``, from the last atom back;
    of equal sums the longer word."""
    joins = " ".join(
        f"LEFT JOIN priced p{k} ON p{k}.term = array_to_string(atoms[d.place - 1 : d.place + {k - 2}], '')"
        for k in range(1, longest + 1)
    )
    options = ", ".join(f"8 * (p{k}.cost + costs[{k}]) + {7 - k}" for k in range(1, longest + 1))
    return f"""
dp AS (
  SELECT run, n, atoms, len(atoms) + 1 AS place, [CAST(0 AS BIGINT)] AS costs, CAST([] AS BIGINT[]) AS picks FROM runs
  UNION ALL
  SELECT run, n, atoms, place, list_prepend(best // 8, costs), list_prepend(7 - best % 8, picks)
  FROM (SELECT d.run, d.n, d.atoms, d.place - 1 AS place, d.costs, d.picks, least({options}) AS best
        FROM dp d {joins} WHERE d.place > 1)),
path AS (
  SELECT run, n, atoms, picks, CAST(1 AS BIGINT) AS place, CAST(0 AS BIGINT) AS size FROM dp WHERE place = 1
  UNION ALL
  SELECT run, n, atoms, picks, place + size, picks[place + size] FROM path WHERE place + size <= len(atoms))"""


_PATH_WORDS = """
SELECT array_to_string(atoms[place : place + size - 1], '') AS word, CAST(sum(n) AS BIGINT) AS n FROM path WHERE size > 0 GROUP BY 1"""


def oracle_sql() -> dict[str, str]:
    sql: dict[str, str] = {}

    # sources
    emotion = (
        "CASE emotion "
        + " ".join(f"WHEN '{k}' THEN {v}" for k, v in S.EMOTION_LABELS.items())
        + " END AS sentiment_label"
    )
    sql["load_posts"] = _with(POSTS) + (
        "SELECT id, date, content, CAST(id % 3 AS INTEGER) AS label, emotion, "
        f"{emotion}, '{S.LABELLED_SOURCE}' AS source FROM posts"
    )
    sql["load_custom_posts"] = _with(POSTS) + (
        f"SELECT id, date, content, CAST(NULL AS INTEGER) AS label, '{S.CUSTOM_SOURCE}' AS source FROM posts"
    )
    sql["stopwords_load"] = _with(POSTS) + rf"""
SELECT DISTINCT word FROM (
  SELECT regexp_replace(regexp_replace(line, '^[{SPACE}]+', ''), '[{SPACE}]+$', '') AS word
  FROM (SELECT unnest(string_split(content, chr(10))) AS line FROM posts))
WHERE word <> ''"""
    sql["post_ids"] = "SELECT row_number() OVER (ORDER BY doc_id) AS id, doc_id FROM documents"
    sql["emotion_map"] = _with(POSTS) + f"SELECT id, emotion, {emotion} FROM posts"

    # dates and filters
    sql["parse_dates"] = _with(POSTS) + (
        "SELECT id, strftime(try_cast(date AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS ts FROM posts"
    )
    form = " ".join(
        f"WHEN {k} THEN {moment}"
        for k, moment in ((0, "day"), (7, "day + INTERVAL '13 hours 45 minutes'"))
    )
    sql["parse_date_forms"] = _with(POSTS) + f"""
SELECT id, strftime(CASE id % 8 {form} ELSE day END, '%Y-%m-%d %H:%M:%S') AS ts
FROM (SELECT id, TIMESTAMP '2020-01-20' + to_days(CAST(id % 102 AS INTEGER)) AS day FROM posts)"""
    sql["strict_bounds"] = _with(POSTS) + "SELECT 'refused' AS strict, count(*) AS posts FROM posts"
    sql["required_columns"] = _with(POSTS) + """
SELECT "case", columns, (SELECT count(*) FROM posts) AS posts FROM (VALUES
  ('as named', 'id,date,content,label,source'), ('aliases', 'id,date,content,label,source'),
  ('no content', 'refused'), ('no date', 'refused')) cases("case", columns)"""
    missing = ", ".join(f"'{t}'" for t in S.MISSING_TEXTS)
    present = lambda c: f"CASE WHEN {c} IN ({missing}) THEN NULL ELSE {c} END AS {c}"
    sql["csv_labelled"] = _with(POSTS) + (
        f"SELECT {present('date')}, {present('content')}, CAST(id % 3 AS INTEGER) AS label, {present('emotion')}, "
        f"{emotion}, '{S.LABELLED_SOURCE}' AS source FROM posts"
    )
    sql["csv_custom"] = _with(POSTS) + (
        f"SELECT {present('date')}, {present('content')}, CAST(id % 4 AS INTEGER) AS label, "
        f"'{S.CUSTOM_SOURCE}' AS source FROM posts"
    )
    sql["csv_split"] = sql["csv_custom"]
    sql["csv_dropped"] = (
        "SELECT '2020-01-01' AS date, 'post' AS content, CAST(doc_id AS INTEGER) AS label, "
        f"'{S.CUSTOM_SOURCE}' AS source FROM documents WHERE doc_id % 7 <> 0"
    )
    sql["csv_rejected"] = (
        "SELECT 'post,2020-01-01,' || CAST(doc_id AS VARCHAR) || ',one more' AS record, CAST(4 AS INTEGER) AS n_fields, "
        "'more fields than the header' AS fault FROM documents WHERE doc_id % 7 = 0"
    )
    sql["posts_by_day"] = _with(POSTS, RANGE) + (
        "SELECT id, strftime(try_cast(date AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS ts, "
        "strftime(try_cast(date AS TIMESTAMP), '%Y-%m-%d') AS day FROM ranged"
    )
    sql["date_range"] = _with(POSTS) + (
        "SELECT strftime(min(try_cast(date AS TIMESTAMP)), '%Y-%m-%d %H:%M:%S') AS first_ts, "
        "strftime(max(try_cast(date AS TIMESTAMP)), '%Y-%m-%d %H:%M:%S') AS last_ts FROM posts"
    )
    sql["corpus_summary"] = _with(POSTS) + (
        "SELECT count(*) AS posts, strftime(min(try_cast(date AS TIMESTAMP)), '%Y-%m-%d') AS first_day, "
        "strftime(max(try_cast(date AS TIMESTAMP)), '%Y-%m-%d') AS last_day FROM posts"
    )
    sql["filter_by_date"] = _with(POSTS, RANGE) + "SELECT id, date FROM ranged"
    sql["filter_open_ended"] = _with(POSTS) + (
        "SELECT id, date FROM posts WHERE try_cast(date AS TIMESTAMP) >= TIMESTAMP '2020-03-01 00:00:00'"
    )
    sql["non_empty_posts"] = _with(POSTS) + (
        "SELECT id, date, CAST(length(content) AS INTEGER) AS chars FROM posts "
        "WHERE content IS NOT NULL AND content <> ''"
    )
    sql["contains_literal"] = _with(POSTS) + "SELECT id FROM posts WHERE content LIKE '%scum%'"
    sql["contains_regex"] = _with(POSTS) + (
        "SELECT id FROM posts WHERE regexp_matches(content, 'sc[aou]m|idiots?')"
    )

    # text
    sql["clean_text"] = _with(POSTS) + f"SELECT id, {_clean('content')} AS content FROM posts"
    listed = "array_to_string(ws, ' ') AS tokens, CAST(len(ws) AS INTEGER) AS n_tokens"
    sql["tokenize"] = _with(POSTS) + (
        f"SELECT id, {listed} FROM (SELECT id, coalesce({_words('content')}, []) AS ws FROM posts)"
    )
    sql["tokenize_whitespace"] = _with(POSTS) + rf"""
SELECT id, {listed} FROM (
  SELECT id, coalesce(list_filter(regexp_extract_all(content, '[^{SPACE}]+'), lambda w: length(w) >= 2), []) AS ws
  FROM posts)"""
    sql["tokenize_custom"] = _with(POSTS) + rf"""
SELECT word, count(*) AS n FROM (
  SELECT unnest(regexp_extract_all(lower(content), '[^{SPACE}]+')) AS word FROM posts)
WHERE word NOT IN ({_list(V.STOPWORDS)}) GROUP BY word"""
    pieces = rf"""
pieces AS (SELECT unnest(regexp_extract_all(content, '[^{SPACE}]+')) AS word FROM posts)"""
    good = rf"NOT regexp_matches(word, '{DIGITS}') AND regexp_matches(word, '[{WORD}]')"
    sql["token_filters"] = _with(POSTS, pieces) + (
        f"SELECT word, count(*) AS n FROM pieces WHERE length(word) >= 2 AND {good} GROUP BY word"
    )
    sql["token_filters_len1"] = _with(POSTS, pieces) + (
        f"SELECT word, count(*) AS n FROM pieces WHERE {good} "
        "AND NOT regexp_matches(word, '^[A-Za-z]$') GROUP BY word"
    )
    sql["remove_stopwords"] = _with(POSTS, _tokens()) + (
        "SELECT id, count(*) AS n, min(word) AS first_word, max(word) AS last_word FROM tokens GROUP BY id"
    )
    sql["explode_tokens"] = _with(POSTS) + f"""
SELECT id, date, CAST(unnest(range(len(ws))) AS INTEGER) AS pos, unnest(ws) AS word FROM (
  SELECT id, date, {_words('content')} AS ws FROM posts WHERE content IS NOT NULL AND content <> '')"""
    sql["cjk_bigrams"] = _with(POSTS, _HAN) + """
SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT n, unnest(list_transform(range(1, length(run)), lambda i: substring(run, i, 2))) AS word FROM runs)
GROUP BY word"""
    sql["cjk_lexicon"] = (
        "WITH RECURSIVE " + ",".join([POSTS, _HAN]) + """,
terms AS MATERIALIZED (
  SELECT run AS term FROM runs WHERE length(run) BETWEEN 2 AND 4),
walk AS (
  SELECT run, n, 1 AS pos, 0 AS len FROM runs
  UNION ALL
  SELECT run, n, pos + len, CASE
      WHEN pos + len + 3 <= length(run) AND substring(run, pos + len, 4) IN (FROM terms) THEN 4
      WHEN pos + len + 2 <= length(run) AND substring(run, pos + len, 3) IN (FROM terms) THEN 3
      WHEN pos + len + 1 <= length(run) AND substring(run, pos + len, 2) IN (FROM terms) THEN 2
      ELSE 1 END
  FROM walk WHERE pos + len <= length(run))
SELECT substring(run, pos, len) AS word, CAST(sum(n) AS BIGINT) AS n FROM walk WHERE len > 0 GROUP BY 1"""
    )

    mixed = f"terms AS MATERIALIZED (SELECT run AS term FROM runs WHERE len(atoms) BETWEEN 2 AND 4 AND regexp_matches(run, '[^{CJK}]'))"
    sql["mixed_terms"] = "WITH RECURSIVE " + ",".join([POSTS, _MIXED, mixed, _greedy(4)]) + _PATH_WORDS
    sql["new_words"] = _with(POSTS, _MIXED, _NEW_WORDS) + "SELECT * FROM found"
    priced = """
terms AS MATERIALIZED (
  SELECT term, n FROM found
  UNION ALL SELECT gram, sum(n) FROM grams WHERE k = 1 GROUP BY gram),
priced AS MATERIALIZED (
  SELECT term, CAST(round(ln(CAST((SELECT sum(n) FROM terms) AS DOUBLE) / CAST(sum(n) AS DOUBLE)) * 1000000) AS BIGINT) AS cost
  FROM terms GROUP BY term)"""
    sql["lattice_segment"] = "WITH RECURSIVE " + ",".join([POSTS, _MIXED, _NEW_WORDS, priced, _likeliest(4)]) + _PATH_WORDS

    # counts and rankings
    sql["word_freq_by_date"] = _with(POSTS, _dated()) + "SELECT date, word, n FROM dated"
    sql["stored_word_counts"] = _with(POSTS, _dated()) + (
        "SELECT strftime(try_cast(date AS TIMESTAMP), '%Y-%m-%d') AS day, word, CAST(sum(n) AS BIGINT) AS n "
        "FROM dated WHERE try_cast(date AS TIMESTAMP) IS NOT NULL GROUP BY 1, 2"
    )
    sql["word_freq_total"] = _with(POSTS, _total()) + "SELECT word, n FROM total"
    sql["word_freq_rollup"] = sql["word_freq_total"]
    sql["word_freq_empty"] = _with(POSTS, EMPTY, _dated("nothing")) + "SELECT date, word, n FROM dated"
    rank_int = "CAST(rank AS INTEGER) AS rank"
    sql["top_words"] = _with(POSTS, _total(), _top(20)) + f"SELECT {rank_int}, word, n FROM top"
    sql["top_words_by_date"] = _with(POSTS, _dated(), _LISTS) + f"SELECT date, {rank_int}, word, n FROM lists"
    sql["top_words_by_table"] = _with(POSTS, _dated(), _TABLE_LISTS) + f"SELECT date, {rank_int}, word, n FROM lists"
    sql["top_words_all"] = _with(POSTS, _total(), _top(20)) + f"SELECT 'all' AS date, {rank_int}, word, n FROM top"
    sql["bar_top15"] = _with(POSTS, _total(), _top(15)) + f"SELECT {rank_int}, word, n FROM top"
    sql["cloud_weights"] = _with(POSTS, _total(), _top(100)) + (
        "SELECT word, n, round_even(n::DOUBLE / max(n) OVER (), 6) AS weight FROM top"
    )
    sql["trend_pivot"] = _with(POSTS, _dated(), _LISTS) + """,
lead_words AS (SELECT word FROM lists GROUP BY word ORDER BY sum(n) DESC, word LIMIT 5)
SELECT d.date, t.word, CAST(coalesce(l.n, 0) AS BIGINT) AS n
FROM (SELECT DISTINCT date FROM posts WHERE date IS NOT NULL) d CROSS JOIN lead_words t
LEFT JOIN lists l ON l.date = d.date AND l.word = t.word"""
    sql["word_context"] = _with(POSTS) + (
        "SELECT id, content FROM posts WHERE contains(content, 'scum') ORDER BY id LIMIT 10"
    )

    # matching
    sql["word_post_matches"] = _with(POSTS, _asked(V.WORDS)) + (
        "SELECT word, id FROM asked JOIN posts ON contains(content, word)"
    )
    sql["word_post_matches_table"] = _with(POSTS) + rf""",
wanted AS MATERIALIZED (
  SELECT DISTINCT word FROM (SELECT unnest(regexp_extract_all(text, '[^{SPACE}]+')) AS word FROM benchmark)
  WHERE length(word) > 0)
SELECT word, count(*) AS posts FROM wanted JOIN posts ON contains(content, word) GROUP BY word"""

    # sentiment
    sql["lexicon_score"] = _with(POSTS, _scored()) + "SELECT id, round_even(raw, 6) AS raw FROM scored"
    sql["lexicon_score_join"] = sql["lexicon_score"]
    sql["score_posts"] = _with(POSTS, _scored()) + f"SELECT {_SCORE_COLUMNS} FROM scored"
    sql["score_blank"] = sql["score_posts"] + f" WHERE {_BLANK}"
    sql["sentiment_distribution"] = _with(POSTS, _scored(), _distribution()) + "SELECT * FROM dist"
    sql["sentiment_distribution_empty"] = (
        _with(POSTS, EMPTY, _scored("nothing"), _distribution()) + "SELECT * FROM dist"
    )
    sql["distribution_share"] = _with(POSTS, _scored(), _distribution()) + (
        f"SELECT {_TITLE}, n, CAST(round_even(n * 100::DOUBLE / sum(n) OVER (), 1) AS DOUBLE) AS percent "
        "FROM dist WHERE n > 0"
    )
    sql["word_sentiment"] = (
        _with(POSTS, _scored(), _asked(V.WORDS), _word_stats("asked")) + "SELECT * FROM stats"
    )
    sql["word_sentiment_sampled"] = (
        _with(POSTS, _scored(), _asked(V.WORDS), _word_stats("asked", cap=S.SAMPLES_PER_WORD)) + "SELECT * FROM stats"
    )
    sql["word_sentiment_no_match"] = (
        _with(POSTS, _scored(), _asked(["zzzz"]), _word_stats("asked")) + "SELECT * FROM stats"
    )
    top = _top(20).replace("word, n FROM", "word, n AS word_count FROM")
    sql["top_words_sentiment"] = (
        _with(POSTS, _total(), top, _scored(), _word_stats("top")) + "SELECT * EXCLUDE (rank) FROM stats"
    )
    sql["word_sentiment_by_date"] = _with(POSTS, _series("posts", V.WORDS)) + "SELECT * FROM series"
    sampled = _series("posts", V.WORDS, cap=S.SAMPLES_PER_WORD_DAY)
    sql["word_sentiment_by_date_sampled"] = _with(POSTS, sampled) + "SELECT * FROM series"
    sql["trend_sides"] = _with(POSTS, _series("posts", V.WORDS)) + f"SELECT *, {_SIDE} FROM series"
    sql["trend_summary"] = _with(POSTS, _series("posts", V.WORDS), _SUMMARY) + "SELECT * FROM summary"

    # Naive Bayes
    sql["nb_train"] = _with(POSTS, LABELLED, NB) + (
        "SELECT word, pos_n, neg_n, round_even(log_pos, 6) AS log_pos, round_even(log_neg, 6) AS log_neg FROM model"
    )
    sql["nb_score"] = (
        _with(
            POSTS,
            LABELLED,
            NB,
            """
margins AS (
  SELECT id, sum(log_neg - log_pos) - (SELECT ln(count(*) FILTER (train_label = 1)::DOUBLE
    / count(*) FILTER (train_label = 0)) FROM labelled) AS m
  FROM tokens JOIN model USING (word) GROUP BY id),
joined AS (SELECT p.*, m FROM posts p LEFT JOIN margins USING (id))""",
            _classed(
                "joined",
                f"CASE WHEN {_BLANK} OR m IS NULL THEN 0.5::DOUBLE "
                "ELSE 1 / (1 + exp(greatest(least(m, 700.0::DOUBLE), -700.0::DOUBLE))) END",
                "scored",
            ),
        )
        + f"SELECT {_SCORE_COLUMNS} FROM scored"
    )

    pieces = rf"""
tokens AS MATERIALIZED (
  SELECT id, date, word FROM (
    SELECT id, date, unnest(regexp_extract_all(content, '[^{SPACE}]+')) AS word FROM posts)
  WHERE length(word) >= 2 AND word NOT IN ({_list(V.STOPWORDS)}))"""
    sql["nb_train_whitespace"] = _with(POSTS, LABELLED, pieces) + """
SELECT word, count(*) FILTER (train_label = 1) AS pos_n, count(*) FILTER (train_label = 0) AS neg_n
FROM tokens JOIN labelled USING (id) WHERE train_label IN (0, 1) GROUP BY word"""

    # keywords
    sql["keywords_freq"] = (
        _with(POSTS, _tokens(), "weighted AS (SELECT id, word, count(*) AS weight FROM tokens GROUP BY ALL)") + _TOP_K
    )
    tf_idf = """
tf AS (SELECT id, word, count(*) AS tf FROM tokens GROUP BY ALL),
lens AS (SELECT id, count(*) AS n FROM tokens GROUP BY id),
df AS (SELECT word, count(*) AS df FROM tf GROUP BY word),
weighted AS (
  SELECT id, word, round_even(tf::DOUBLE / n * ln(
      ((SELECT count(*) FROM posts WHERE content IS NOT NULL AND content <> '') + 1)::DOUBLE / (df + 1)), 6) AS weight
  FROM tf JOIN lens USING (id) JOIN df USING (word))"""
    sql["nb_loaded"] = sql["nb_score"]
    sql["keywords_tfidf"] = _with(POSTS, _tokens(), tf_idf) + _TOP_K
    sql["keywords_tfidf_whitespace"] = _with(POSTS, pieces, tf_idf) + _TOP_K
    sql["keywords_textrank"] = _textrank()

    # reports
    shown = "rank, word, word_count, total_count, avg_score, sentiment, positive_ratio, negative_ratio"
    stats = "WITH " + _report()
    sql["hot_word_report"] = stats + f" SELECT {shown.replace('rank,', rank_int + ',')} FROM stats"
    sql["hot_word_report_daily"] = (
        _with(POSTS, RANGE, _dated("ranged"), _LISTS) + f"SELECT date, {rank_int}, word, n FROM lists"
    )
    sql["hot_word_report_distribution"] = (
        _with(POSTS, RANGE, _scored("ranged"), _distribution()) + "SELECT * FROM dist"
    )
    sql["hot_word_table"] = stats + (
        f" SELECT {rank_int}, word, word_count, printf('%.1f', round_even(avg_score, 1)) AS score, {_TITLE} FROM stats"
    )
    sql["score_bands"] = stats + (
        f" SELECT {rank_int}, word, avg_score, CASE WHEN avg_score >= 6.5 THEN 'positive' "
        "WHEN avg_score <= 4.5 THEN 'negative' ELSE 'neutral' END AS band FROM stats WHERE rank <= 15"
    )
    fields = ("CAST(rank AS INTEGER)", "word", "word_count", "avg_score", "sentiment", "positive_ratio", "negative_ratio")
    sql["export_report"] = (
        stats + " SELECT " + ", ".join(f'{f} AS "{h}"' for f, h in zip(fields, S.REPORT_HEADERS)) + " FROM stats"
    )
    trend = _with(POSTS, RANGE, _series("ranged", ["the"]), _SUMMARY)
    sql["word_trend"] = trend + f"""
SELECT word, day, avg_score, {_SIDE}, points, mean_score,
  CAST(day = max_day AS INTEGER) AS is_max, CAST(day = min_day AS INTEGER) AS is_min
FROM series JOIN summary USING (word)"""
    sql["export_trend"] = trend + 'SELECT day AS "日期", avg_score AS "情感评分" FROM series'
    # Whole numbers of a DOUBLE column are written with one decimal by both engines.
    sql["export_trend_file"] = trend + f"""
SELECT day || ',' || CAST(avg_score AS VARCHAR) AS line FROM series
UNION ALL SELECT chr(65279) || '{S.TREND_HEADERS[0]},{S.TREND_HEADERS[1]}'"""
    cells = ["CAST(rank AS VARCHAR)", "word", *(f"CAST({c} AS VARCHAR)" for c in ("word_count", "avg_score", "sentiment", "positive_ratio", "negative_ratio"))]
    sql["export_report_file"] = stats + f"""
SELECT {" || ',' || ".join(cells)} AS line FROM stats
UNION ALL SELECT chr(65279) || '{','.join(S.REPORT_HEADERS)}'"""
    # What is read from stored tables has the rows of a scan.
    for name, same in {
        "corpus_summary_stored": "corpus_summary",
        "date_range_stored": "date_range",
        "word_trend_indexed": "word_trend",
        "word_context_indexed": "word_context",
        "cube_distribution": "sentiment_distribution",
        "cube_word_sentiment": "word_sentiment",
        "cube_word_sentiment_by_date": "word_sentiment_by_date",
        "cube_top_words_sentiment": "top_words_sentiment",
    }.items():
        sql[name] = sql[same]
    return sql
