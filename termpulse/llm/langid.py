"""Language identification by fusing evidence as Bayes' rule says.

For every document and language the posterior is proportional to

    prior(language | host) * P(text | language)^(1 / tempering) * P(declared | language)

* **Text**: a generative model of hashed byte n-grams per language, trained here on
  a bounded sample of the rows of every declared language. N-grams overlap and are not
  independent, so the log-likelihood counts by ``TEMPERING`` only. The model takes
  ``BINS`` numbers per language, whatever the number of rows; no language is left out.
* **Declared language** (a column, or the ``lang`` attribute of markup): how often a
  page in one language declares another is estimated over all rows.
* **Address**: the host's prior is a smoothed mixture of its own counts and those
  of its address suffix, which are smoothed towards the global counts. A host seen
  once says little, a host seen a million times says much.

All three tables of counts come from grouped aggregations over all rows, of the
languages that the text alone suggests. They start inside each task, so a host
with a third of all rows costs one row per task, language and declaration.

A document is rejected when its text holds fewer than ``MIN_LETTERS`` letters, or
when no language reaches ``MIN_POSTERIOR``.

Defined cases: a null or empty text, or one without letters, has no language
(``und``) and is rejected; a null host or declaration is no evidence; repeated rows
are judged row by row; of equally likely languages the first in the alphabet counts;
a very long text is counted in parts of ``PART`` bytes; without training rows all
documents are ``und``; an empty table gives an empty table; other columns are left out
by ``identify`` and kept by ``keep_identified``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termpulse.llm.common import written
from termpulse.storage import broadcast_if_small

#: Texts of each language, by the smallest hashes, that train the text model.
TRAINING_ROWS = 400
TRAINING_CHARS = 4_000
PART = 1 << 20
BINS = 1 << 15
ORDERS = (1, 2, 3, 4)
TEMPERING = 20.0
HOST_WEIGHT = 20.0
SUFFIX_WEIGHT = 50.0
MIN_LETTERS = 1
MIN_POSTERIOR = 0.5
UNKNOWN = "und"
#: Added to every count of a declaration.
DECLARED_PRIOR = 1.0

_URL_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
_NO_LETTERS = re.compile(r"[\W\d_]+")
_MARKUP_LANG = r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})"


def host_of(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, _URL_HOST, 1))
    return F.when(host != "", host)


def suffix_of(host: Column) -> Column:
    """The last label of a dotted host; null for a name without dots."""
    return F.when(F.contains(host, F.lit(".")), F.substring_index(host, ".", -1))


def declared_in(html: Column) -> Column:
    """The language that markup declares for itself."""
    code = F.lower(F.regexp_extract(html, _MARKUP_LANG, 1))
    return F.when(code != "", code)


def _bins(raw: np.ndarray, order: int) -> np.ndarray:
    """Bin of the n-gram that starts at each byte."""
    n = len(raw) - order + 1
    if n <= 0:
        return np.empty(0, np.int64)
    key = np.full(n, order, np.uint32)
    for i in range(order):
        key = key * np.uint32(0x01000193) ^ raw[i : i + n]
    key ^= key >> np.uint32(15)
    return (key * np.uint32(0x9E3779B1) >> np.uint32(32 - 15)).astype(np.int64)


def counts_in(text: str) -> tuple[np.ndarray, int]:
    """How many n-grams of the text fall into each bin, and its number of letters."""
    raw, letters = prepared(text)
    total = np.zeros(BINS, np.int64)
    for at in range(0, max(1, len(raw) - 1), PART):
        for order in ORDERS:
            # An n-gram belongs to the part in which it starts.
            total += np.bincount(_bins(raw[at : at + PART + order - 1], order), minlength=BINS)
    return total, letters


@dataclass
class TextModel:
    """Log-probabilities, one row per bin and one column per language."""

    languages: list[str]
    weights: np.ndarray

    @classmethod
    def of(cls, counts: dict[str, np.ndarray]) -> TextModel:
        languages = sorted(counts)
        table = np.array([counts[x] for x in languages]).reshape(len(languages), BINS) + 1.0
        return cls(languages, np.log(table / table.sum(axis=1, keepdims=True)).T.astype(np.float32))

    def score(self, text: str) -> tuple[np.ndarray, int]:
        """Tempered log-likelihood per language, and the number of letters."""
        counts, letters = counts_in(text)
        used = np.flatnonzero(counts)
        return counts[used].astype(np.float64) @ self.weights[used].astype(np.float64) / TEMPERING, letters


def prepared(text: str) -> tuple[np.ndarray, int]:
    """Bytes in lower case, a space for each run without letters; number of letters."""
    plain = _NO_LETTERS.sub(" ", text.lower())
    return np.frombuffer(f" {plain} ".encode(), np.uint8), len(plain) - plain.count(" ")


def sample(rows: DataFrame, per_language: int = TRAINING_ROWS, chars: int = TRAINING_CHARS) -> DataFrame:
    """``_declared, _piece``: of each declared language the ``per_language`` distinct
    texts with the smallest hashes, ``chars`` characters of each."""
    labelled = rows.filter(F.col("_declared").isNotNull() & F.col("_text").rlike(r"\p{L}"))
    key = F.xxhash64("_text")
    # Copies count once: they leave one hash per task.
    texts = labelled.select("_declared", key.alias("_key")).distinct()
    found = texts.groupBy("_declared").agg(F.count(F.lit(1)).alias("_n"))
    # Hashes below this share hold twenty times the texts wanted, give or take little.
    share = found.select("_declared", F.least(F.lit(1.0), 20 * per_language / F.col("_n")).alias("_share"))
    place = F.shiftrightunsigned(key, 33) / float(1 << 31)
    few = (
        labelled.select("_declared", place.alias("_place"), key.alias("_key"), F.substring("_text", 1, chars).alias("_piece"))
        .join(broadcast_if_small(written(share, "shares")), "_declared")
        .filter(F.col("_place") < F.col("_share"))
        .groupBy("_declared", "_place", "_key")
        .agg(F.first("_piece").alias("_piece"))
    )
    order = Window.partitionBy("_declared").orderBy("_place", "_key")
    return few.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= per_language).select("_declared", "_piece")


def train(texts: DataFrame) -> TextModel:
    """The text model of ``_declared, _piece``: the driver gets ``BINS`` counts per language."""

    def run(batches):
        language, total = None, None

        def row():
            return pa.RecordBatch.from_arrays([pa.array([language]), pa.array([total.tobytes()], pa.binary())], names=["language", "counts"])

        for batch in batches:
            for declared, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if declared != language:
                    if total is not None:
                        yield row()
                    language, total = declared, np.zeros(BINS, np.int64)
                total += counts_in(piece)[0]
        if total is not None:
            yield row()

    dealt = texts.repartition("_declared").sortWithinPartitions("_declared")
    found = dealt.mapInArrow(run, "language string, counts binary").collect()
    return TextModel.of({r.language: np.frombuffer(r.counts, np.int64) for r in found})


def evidence(docs: DataFrame, row: Column, text: Column, declared: Column, host: Column) -> DataFrame:
    """``_row, _text, _declared, _host, _suffix``: what is judged, and by what."""
    return docs.select(
        row.alias("_row"),
        F.coalesce(text, F.lit("")).alias("_text"),
        F.lower(declared).alias("_declared"),
        host.alias("_host"),
        suffix_of(host).alias("_suffix"),
    )


def _text_scores(rows: DataFrame, model: TextModel) -> DataFrame:
    """The narrow columns and the text's score per language.

    Only texts go to Python; ``_row``, which may be a whole row, stays behind.
    """

    @F.arrow_udf("struct<scores:array<double>,letters:bigint>")
    def score(texts: pa.Array) -> pa.Array:
        found = []
        for at in range(0, len(texts), 64):  # few texts at a time as Python strings
            found += [model.score(t) for t in texts.slice(at, 64).to_pylist()]
        scores = pa.array([s.tolist() for s, _ in found], pa.list_(pa.float64()))
        return pa.StructArray.from_arrays([scores, pa.array([n for _, n in found], pa.int64())], ["scores", "letters"])

    # Not to be worked out again where it is used more than once.
    scored = rows.withColumn("_s", score.asNondeterministic()("_text"))
    return scored.select(
        "_row", "_declared", "_host", "_suffix", F.col("_s.scores").alias("_scores"), F.col("_s.letters").alias("_letters")
    )


def _best(scores: Column) -> Column:
    """Position of the highest value, the first of equals; from 0."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def counts_of(scored: DataFrame) -> DataFrame:
    """Rows per host, suffix, declaration and language of the text alone."""
    return (
        scored.filter(F.col("_letters") >= MIN_LETTERS)
        .groupBy("_host", "_suffix", "_declared", _best(F.col("_scores")).alias("_language"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )


def _vector(n_languages: int) -> list[Column]:
    return [F.sum(F.when(F.col("_language") == k, F.col("_n")).otherwise(0)).cast("double") for k in range(n_languages)]


def priors(counts: DataFrame, n: int) -> tuple[DataFrame, list[float]]:
    """Log-prior per host, and the global one.

    Host counts are smoothed towards the suffix, the suffix towards all rows, all
    rows towards equal shares.
    """
    totals = counts.agg(*(v.alias(f"l{k}") for k, v in enumerate(_vector(n)))).first()
    everywhere = np.array([x or 0.0 for x in totals]) + 1.0
    everywhere = (everywhere / everywhere.sum()).tolist()
    overall = F.array(*map(F.lit, everywhere))

    def smoothed(counted: Column, parent: Column, weight: float) -> Column:
        total = F.aggregate(counted, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(counted, parent, lambda c, p: (c + p * weight) / (total + weight))

    by_suffix = counts.filter(F.col("_suffix").isNotNull()).groupBy("_suffix").agg(F.array(*_vector(n)).alias("_c"))
    by_suffix = by_suffix.select("_suffix", smoothed(F.col("_c"), overall, SUFFIX_WEIGHT).alias("_parent"))
    by_host = counts.filter(F.col("_host").isNotNull()).groupBy("_host", "_suffix").agg(F.array(*_vector(n)).alias("_c"))
    by_host = by_host.join(by_suffix, "_suffix", "left")
    prior = smoothed(F.col("_c"), F.coalesce("_parent", overall), HOST_WEIGHT)
    return by_host.select("_host", F.transform(prior, lambda p: F.log(p)).alias("_prior")), np.log(everywhere).tolist()


def declarations(counts: DataFrame, languages: list[str]) -> DataFrame:
    """``_declared, _said``: log P(declared | language) of the codes that are a known
    language, a table of languages times languages. Another declaration is no evidence.
    """
    known = counts.filter(F.col("_declared").isin(languages)).groupBy("_declared").agg(F.array(*_vector(len(languages))).alias("c"))
    found = {r._declared: np.array(r.c) for r in known.collect()}
    table = np.stack([found.get(code, np.zeros(len(languages))) for code in languages]) + DECLARED_PRIOR
    rows = list(zip(languages, np.log(table / table.sum(axis=0)).tolist(), strict=True))
    return counts.sparkSession.createDataFrame(rows, "_declared string, _said array<double>")


def _verdict(scored: DataFrame, hosts: DataFrame, overall: list[float], says: DataFrame, languages: list[str]) -> DataFrame:
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    # AQE splits a host that holds many rows when the table is not broadcast.
    joined = scored.join(broadcast_if_small(hosts), "_host", "left").join(broadcast_if_small(says), "_declared", "left")
    prior = F.coalesce("_prior", F.array(*map(F.lit, overall)))
    said = F.coalesce("_said", F.array(*[F.lit(0.0)] * len(languages)))
    joined = joined.withColumn("_logs", add(add(F.col("_scores"), prior), said))
    top = F.array_max("_logs")
    norm = F.aggregate("_logs", F.lit(0.0), lambda a, x: a + F.exp(x - top))
    joined = joined.withColumn("_posterior", F.lit(1.0) / norm).withColumn("_at", _best(F.col("_logs")))
    sure = (F.col("_letters") >= MIN_LETTERS) & (F.col("_posterior") >= MIN_POSTERIOR)
    named = F.element_at(F.array(*map(F.lit, languages)), F.col("_at") + 1)
    return joined.select(
        "_row",
        F.when(sure, named).otherwise(UNKNOWN).alias("_language"),
        F.when(F.col("_letters") >= MIN_LETTERS, F.col("_posterior")).otherwise(0.0).alias("_probability"),
        sure.alias("_sure"),
    )


def _judged(model: TextModel, scored: DataFrame, counts: DataFrame) -> DataFrame:
    """``_row, _language, _probability, _sure`` of scored rows."""
    if not model.languages:
        return scored.select("_row", F.lit(UNKNOWN).alias("_language"), F.lit(0.0).alias("_probability"), F.lit(False).alias("_sure"))
    counts = written(counts, "hosts")
    hosts, overall = priors(counts, len(model.languages))
    return _verdict(scored, hosts, overall, declarations(counts, model.languages), model.languages)


def identify(
    docs: DataFrame,
    text: Column,
    declared: Column,
    host: Column,
    id_col: str = "doc_id",
    per_language: int = TRAINING_ROWS,
    chars: int = TRAINING_CHARS,
) -> DataFrame:
    """``id_col, language, probability, kept`` of every row.

    ``declared`` and ``host`` may be null columns; ``declared_in(html)`` and
    ``host_of(url)`` take them from raw pages. The bounds are those of ``sample``.
    """
    rows = evidence(docs, F.col(id_col), text, declared, host)
    model = train(sample(rows, per_language, chars))
    scored = written(_text_scores(rows, model), "language")  # narrow: the texts are read once for scores
    return _judged(model, scored, counts_of(scored)).select(
        F.col("_row").alias(id_col),
        F.col("_language").alias("language"),
        F.col("_probability").alias("probability"),
        F.col("_sure").alias("kept"),
    )


def keep_identified(
    docs: DataFrame,
    text: Column,
    declared: Column,
    host: Column,
    per_language: int = TRAINING_ROWS,
    chars: int = TRAINING_CHARS,
) -> DataFrame:
    """The rows whose language is sure, with all columns of ``docs``.

    Rows are scored twice, for the counts and for the verdict, so that no text is
    shuffled.
    """
    rows = evidence(docs, F.lit(0), text, declared, host)
    model = train(sample(rows, per_language, chars))
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    scored = _text_scores(evidence(docs, whole, text, declared, host), model)
    return _judged(model, scored, counts_of(_text_scores(rows, model))).filter("_sure").select("_row.*")
