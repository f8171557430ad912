"""Personal data: patterns propose spans, checksums confirm, context adjusts the score.

All in DataFrame operations. Each kind has a pattern that proposes leftmost,
non-overlapping spans, a check that drops false ones without another try, a base
score, and words that raise the score when they stand near the span. Kinds with a
threshold above their base score need such a word.

==========  ============================================  =================================
kind        proposed                                      confirmed by
==========  ============================================  =================================
``email``   local part, ``@``, dotted domain              its form
``ip``      four dotted numbers                           each at most 255
``card``    14 to 19 digits, single separators            Luhn
``phone``   ``+`` and digits with separators              10 to 15 digits
``iban``    country, check digits, groups of four         mod 97 = 1
``ssn``     3-2-4 digits                                  number ranges, and a context word
==========  ============================================  =================================

The patterns start a match only where a run starts or the last match ended, and
use possessive loops, so their time is linear in the text and they need no stack.
Positions are code points, the end exclusive.

Defined cases: a null text counts as empty; an empty text has no spans; repeated
rows are searched row by row; an empty table gives an empty table; other columns
are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTEXT_CHARS = 40
CONTEXT_GAIN = 0.3
#: Cumulative sums are taken in blocks of so many spans.
BLOCK = 256


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    hint: str  # a text without it has no span; plain text, or a pattern in the case of "[0-9]"
    score: float
    words: str
    threshold: float = 0.0


KINDS = (
    Kind(
        "email",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        "@",
        0.9,
        "e-?mail|contact|write|correo|courriel|adresse",
    ),
    Kind(
        "ip",
        r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}+",
        ".",
        0.6,
        "ip|host|server|address|adresse",
    ),
    Kind(
        "card",
        r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){13,18}+(?![\x20-]?[0-9])",
        "[0-9]",
        0.7,
        "card|credit|visa|master|karte|carte|tarjeta",
    ),
    Kind(
        "phone",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        "+",
        0.6,
        "phone|call|tel|mobile|fax|telefon",
    ),
    Kind(
        "iban",
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?+[A-Z0-9]{4}){2,7}+(?:\x20?+[A-Z0-9]{1,3})?+(?![A-Za-z0-9])",
        "[0-9]",
        0.7,
        "iban|account|bank|konto|compte|cuenta",
    ),
    Kind(
        "ssn",
        r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
        "-",
        0.3,
        "ssn|social|security",
        threshold=0.5,
    ),
)
#: Kinds whose spans are always kept once confirmed.
BASE = ("email", "ip", "card", "phone")
SPAN = "struct<start:int,kind_no:int,end:int,kind:string,score:double>"


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def add(total: Column, i: Column) -> Column:
        digit = number.substr(F.length(number) - i + 1, F.lit(1)).cast("int")
        twice = digit * 2 - F.when(digit > 4, 9).otherwise(0)
        return total + F.when(i % 2 == 0, twice).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), add) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an IBAN's remainder is 1, letters counting 10 to 35."""
    plain = F.replace(code, F.lit(" "), F.lit(""))
    moved = F.concat(plain.substr(F.lit(5), F.length(plain)), plain.substr(1, 4))

    def add(rest: Column, c: Column) -> Column:
        value = F.when(c.between("0", "9"), c.cast("int")).otherwise(F.ascii(c) - 55)
        return (rest * F.when(value > 9, 100).otherwise(10) + value) % 97

    return F.aggregate(F.split(moved, ""), F.lit(0), lambda rest, c: F.when(c == "", rest).otherwise(add(rest, c))) == 1


def confirmed(kind: str, span: Column) -> Column:
    if kind == "ip":
        low = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return span.rlike(rf"\A{low}\.{low}\.{low}\.{low}\z")
    if kind == "card":
        return luhn(digits(span))
    if kind == "phone":
        return F.length(digits(span)).between(10, 15)
    if kind == "iban":
        return mod97(span)
    if kind == "ssn":
        return ~span.rlike(r"\A(?:000|666|9)|-00-|-0000\z")
    return F.lit(True)


def running_sum(values: Column) -> Column:
    """Sum of all values before each one; block by block, so that long arrays stay cheap."""
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")),
        lambda b: F.slice(values, b * BLOCK + 1, BLOCK),
    )
    total = lambda x: F.aggregate(x, F.lit(0), lambda a, v: a + v)
    firsts = F.aggregate(
        blocks,
        F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("before")),
        lambda s, x: F.struct((s["sum"] + total(x)).alias("sum"), F.array_append(s["before"], s["sum"]).alias("before")),
        lambda s: s["before"],
    )
    inside = F.zip_with(
        blocks, firsts, lambda x, first: F.transform(x, lambda _, i: first + total(F.slice(x, F.lit(1), i)))
    )
    return F.flatten(inside)


def propose(docs: DataFrame, kinds: tuple[Kind, ...], keep: list[str]) -> DataFrame:
    """``_found_<kind>``: the matches; a text without the kind's hint is not searched."""

    def matches(kind: Kind) -> Column:
        text = F.col("_text")
        hinted = text.rlike(kind.hint) if kind.hint[0] == "[" else F.contains(text, F.lit(kind.hint))
        found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
        return F.when(hinted, found).otherwise(F.array().cast("array<string>"))

    return docs.select(*keep, *(matches(k).alias(f"_found_{k.name}") for k in kinds))


def _between(kind: Kind) -> Column:
    """The texts before, between and after the matches, where there are any."""
    gaps = F.split("_text", kind.pattern, -1)
    return F.when(F.size(f"_found_{kind.name}") > 0, gaps).otherwise(F.array().cast("array<string>"))


def _spans(kind: Kind, number: int) -> Column:
    found, gaps = F.col(f"_found_{kind.name}"), F.col(f"_gaps_{kind.name}")
    starts = F.col(f"_starts_{kind.name}")
    n = F.size(found)
    near = F.arrays_zip(
        found.alias("span"),
        starts.alias("start"),
        F.slice(gaps, F.lit(1), n).alias("left"),
        F.slice(gaps, F.lit(2), n).alias("right"),
    )
    word = rf"(?i)(?<![A-Za-z])(?:{kind.words})(?![A-Za-z])"

    def span(x: Column) -> Column:
        around = F.concat_ws(" ", F.right(x["left"], F.lit(CONTEXT_CHARS)), F.left(x["right"], F.lit(CONTEXT_CHARS)))
        score = F.lit(kind.score) + F.when(around.rlike(word), CONTEXT_GAIN).otherwise(0.0)
        return F.struct(
            x["start"].alias("start"),
            F.lit(number).alias("kind_no"),
            (x["start"] + F.length(x["span"])).alias("end"),
            F.lit(kind.name).alias("kind"),
            F.least(score, F.lit(1.0)).alias("score"),
        )

    spans = F.transform(F.filter(near, lambda x: confirmed(kind.name, x["span"])), span)
    if kind.threshold:
        spans = F.filter(spans, lambda s: s["score"] >= kind.threshold)
    return F.when(n > 0, spans).otherwise(F.array().cast(f"array<{SPAN}>"))


def _starts(kind: Kind) -> Column:
    """Start of each match: what stands before it, matches and gaps alike."""
    found, gaps = F.col(f"_found_{kind.name}"), F.col(f"_gaps_{kind.name}")
    lengths = F.transform(F.arrays_zip(gaps.alias("g"), found.alias("m")), lambda x: F.length(x["g"]) + F.coalesce(F.length(x["m"]), F.lit(0)))
    firsts = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), running_sum(lengths), lambda g, s: s + F.length(g))
    return F.when(F.size(found) > 0, F.slice(firsts, F.lit(1), F.size(found))).otherwise(F.array().cast("array<int>"))


def find(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds: tuple[Kind, ...] = KINDS
) -> DataFrame:
    """``id_col`` and ``spans`` of every row, by start and kind; nothing is shuffled.

    A span is ``start, kind_no, end, kind, score``.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = propose(rows, kinds, ["_id", "_text"])
    found = [f"_found_{k.name}" for k in kinds]
    rows = rows.select("_id", *found, *(_between(k).alias(f"_gaps_{k.name}") for k in kinds))
    rows = rows.select("*", *(_starts(k).alias(f"_starts_{k.name}") for k in kinds))
    spans = F.concat(*(_spans(k, i) for i, k in enumerate(kinds)))
    return rows.select(F.col("_id").alias(id_col), F.sort_array(spans).alias("spans"))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of the spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """``id_col`` and the text with every span replaced by its kind in brackets.

    Of spans that overlap, the one that starts first is replaced, and what another
    has beyond its end.
    """
    found = find(docs.select(F.struct(id_col, text_col).alias("_row"), F.col(text_col)), "_row", text_col, kinds)
    text = F.coalesce(F.col(f"_row.{text_col}"), F.lit(""))

    def add(done: Column, s: Column) -> Column:
        start = F.greatest(s["start"], done["at"])
        new = F.concat(done["out"], F.substring(text, done["at"] + 1, start - done["at"]), F.lit("["), s["kind"], F.lit("]"))
        fresh = s["end"] > done["at"]
        return F.struct(
            F.when(fresh, s["end"]).otherwise(done["at"]).alias("at"), F.when(fresh, new).otherwise(done["out"]).alias("out")
        )

    whole = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        add,
        lambda done: F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text))),
    )
    return found.select(F.col(f"_row.{id_col}").alias(id_col), whole.alias("redacted"))
