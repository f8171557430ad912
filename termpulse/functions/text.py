"""Cleaning and tokenising as column expressions.

Everything here is ``Column -> Column`` and runs inside the JVM. Character
classes are spelled out because Java's ``\\w``/``\\s`` are ASCII-only while the
behaviour to match is Unicode-aware.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termpulse import settings as S

SPACE = r"\s\p{Z}\x{0B}\x{1C}-\x{1F}\x{85}"
WORD = r"\p{L}\p{N}_"
CJK = r"\x{4E00}-\x{9FFF}"
# The same for patterns of this process, which writes code points in another way.
_CJK_HERE = re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), CJK)

# Code points that count as digits although they are not \p{Nd}
# (superscripts, circled and other enclosed digits).
DIGIT_EXTRAS = (
    r"\x{B2}-\x{B3}\x{B9}\x{1369}-\x{1371}\x{19DA}\x{2070}\x{2074}-\x{2079}"
    r"\x{2080}-\x{2089}\x{2460}-\x{2468}\x{2474}-\x{247C}\x{2488}-\x{2490}"
    r"\x{24EA}\x{24F5}-\x{24FD}\x{24FF}\x{2776}-\x{277E}\x{2780}-\x{2788}"
    r"\x{278A}-\x{2792}\x{10A40}-\x{10A43}\x{10E60}-\x{10E68}"
    r"\x{11052}-\x{1105A}\x{1F100}-\x{1F10A}"
)
DIGITS_ONLY = rf"^[\p{{Nd}}{DIGIT_EXTRAS}]+$"

URL = rf"https?://[^{SPACE}]+"
# An unspaced run holding an inner '@' goes as a whole; '@name' at the start of
# a run stays. Anchoring at the start of a run and stopping at the first '@'
# keeps this linear: a plain \S+@\S+ backtracks quadratically over long
# unspaced text, which is what Chinese posts are.
EMAIL = rf"(?<![^{SPACE}])[^{SPACE}][^@{SPACE}]*+@[^{SPACE}]+"

# Text column to a column of string arrays; ``functions.python`` wraps Python callables.
Tokenizer = Callable[[Column], Column]


def strip_noise(text: Column) -> Column:
    """Remove URLs, then e-mail-like runs; rows holding neither skip the regex."""
    no_url = F.when(F.contains(text, F.lit("://")), F.regexp_replace(text, URL, "")).otherwise(text)
    return F.when(F.contains(text, F.lit("@")), F.regexp_replace(no_url, EMAIL, "")).otherwise(no_url)


def clean_text(text: Column) -> Column:
    """URLs, then e-mails, then collapse and trim whitespace."""
    return F.trim(F.regexp_replace(strip_noise(text), rf"[{SPACE}]+", " "))


def is_blank(text: Column) -> Column:
    """True for null, empty and whitespace-only text."""
    return text.isNull() | ~text.rlike(rf"[^{SPACE}]")


def is_number(word: Column) -> Column:
    # What begins with an ASCII letter or an underscore needs no regular expression.
    return ((word < "A") | (word >= "\x80")) & word.rlike(DIGITS_ONLY)


def keep_word(
    word: Column,
    min_len: int = S.MIN_WORD_LENGTH,
    stopwords: Iterable[str] = (),
    word_runs: bool = False,
) -> Column:
    """Filter predicate for tokens of any tokeniser.

    Short words, stopwords, all-digit words, runs without a word character and
    single Latin letters go. Lengths are in code points, case is significant.
    ``word_runs`` says that ``raw_words`` made the tokens, so that length and
    word characters need no second look.
    """
    keep = ~is_number(word)
    if not word_runs:
        keep = (F.length(word) >= min_len) & keep & word.rlike(rf"[{WORD}]")
    if min_len <= 1:
        keep = keep & ~word.rlike("^[A-Za-z]$")
    stop = sorted(set(stopwords))
    return keep & ~word.isin(stop) if stop else keep


def raw_words(text: Column, min_len: int = S.MIN_WORD_LENGTH, cjk: str = "bigram") -> Column:
    """Word runs of cleaned text, in order, before word filters.

    Latin and other alphabetic runs come out whole. CJK runs are cut off from
    their neighbours and come out as overlapping character bigrams
    (``cjk="bigram"``) or whole (``cjk="run"``). Only rows that hold a CJK
    character pay for the heavier pattern.
    """
    if cjk not in ("bigram", "run"):
        raise ValueError(f"cjk must be 'bigram' or 'run', not {cjk!r}")
    least = max(int(min_len), 1)
    other = rf"[{WORD}&&[^{CJK}]]"
    if cjk == "run":
        mixed, group = rf"{other}{{{least},}}+|[{CJK}]{{{least},}}+", 0
    else:
        # The lookahead captures a whole run or a bigram; the part after it
        # moves on by the run, or by one character so that bigrams overlap.
        single = rf"|(?<![{CJK}])[{CJK}](?![{CJK}])" if least == 1 else ""
        gram = rf"|[{CJK}]{{2}}" if least <= 2 else ""
        mixed, group = rf"(?=({other}{{{least},}}+{gram}{single}))(?:[{CJK}]|{other}++)", 1
    body = strip_noise(text)
    return F.when(
        text.rlike(rf"[{CJK}]"), F.regexp_extract_all(body, F.lit(mixed), F.lit(group))
    ).otherwise(F.regexp_extract_all(body, F.lit(rf"[{WORD}]{{{least},}}+"), F.lit(0)))


def tokenize(
    text: Column,
    stopwords: Iterable[str] = (),
    min_len: int = S.MIN_WORD_LENGTH,
    cjk: str = "bigram",
    lowercase: bool = False,
) -> Column:
    """Clean, split and filter; null text gives an empty array.

    Order and repeats are kept. A stopword list of more than ten entries becomes
    one hash-set test per word.
    """
    words = raw_words(F.lower(text) if lowercase else text, min_len, cjk)
    kept = F.filter(words, lambda w: keep_word(w, min_len, stopwords, word_runs=True))
    return F.coalesce(kept, F.array().cast(T.ArrayType(T.StringType())))


def lexicon_tokenizer(
    terms: Iterable[str], stopwords: Iterable[str] = (), min_len: int = S.MIN_WORD_LENGTH
) -> Tokenizer:
    """A tokeniser that cuts runs into the given terms, longest match first.

    CJK characters that no term takes stand alone, stretches of other characters stay
    whole, and the usual word filters follow. Terms may mix scripts (``A股``, ``卡拉OK``),
    but begin and end where such stretches do. A term with a character that no run
    holds (a space, a hyphen) cannot occur and is an error. The terms become one
    regular expression, which suits some hundreds of them; ``operators.segment`` gives
    the same words for term tables of any size, and the most likely ones with their
    frequencies.
    """
    longest_first = sorted(set(terms), key=lambda t: (-len(t), t))
    impossible = [t for t in longest_first if not re.fullmatch(r"\w+", t)]
    if impossible:
        raise ValueError(f"terms that no run of word characters holds: {impossible[:5]}")
    if len(longest_first) > S.INLINE_WORDS:
        raise ValueError(f"more than {S.INLINE_WORDS} terms: use operators.segment with a table")
    other = rf"[{WORD}&&[^{CJK}]]"
    whole = {True: "", False: f"(?!{other})"}  # no term ends inside a stretch
    # A term without a CJK character is a stretch, which stays whole anyway.
    mixed = [t for t in longest_first if re.search(f"[{_CJK_HERE}]", t)]
    known = "".join(f"{re.escape(t)}{whole[bool(re.match(f'[{_CJK_HERE}]', t[-1]))]}|" for t in mixed)
    pattern = rf"{known}[{CJK}]|{other}++"

    def words(text: Column) -> Column:
        found = F.regexp_extract_all(strip_noise(text), F.lit(pattern), F.lit(0))
        return F.filter(found, lambda w: keep_word(w, min_len, stopwords))

    return words


def tokens_of(
    text: Column, stopwords: Iterable[str] = (), tokenizer: Tokenizer | None = None
) -> Column:
    """Tokens by a tokeniser of the caller's, less the stopwords, or by ``tokenize``."""
    if tokenizer is None:
        return tokenize(text, stopwords)
    words = F.coalesce(tokenizer(text), F.array().cast(T.ArrayType(T.StringType())))
    stop = sorted(set(stopwords))
    return F.filter(words, lambda w: ~w.isin(stop)) if stop else words


def tokenize_whitespace(text: Column, min_len: int = S.MIN_WORD_LENGTH) -> Column:
    """Split on whitespace and keep long enough pieces; no cleaning, no stopwords."""
    pieces = F.filter(F.split(text, rf"[{SPACE}]+"), lambda w: F.length(w) >= max(min_len, 1))
    return F.coalesce(pieces, F.array().cast(T.ArrayType(T.StringType())))


def word_runs(text: Column) -> Column:
    """Maximal runs of word characters of cleaned text, whatever their scripts."""
    return F.regexp_extract_all(strip_noise(text), F.lit(rf"[{WORD}]+"), F.lit(0))


def mixed_runs(text: Column) -> Column:
    """Those runs of word characters that hold a CJK character."""
    pattern = rf"[{WORD}&&[^{CJK}]]*+[{CJK}][{WORD}]*+"
    # A run without one would be tried again from each of its characters.
    return F.when(
        text.rlike(rf"[{CJK}]"),
        F.regexp_extract_all(strip_noise(text), F.lit(rf"(?<![{WORD}]){pattern}"), F.lit(0)),
    ).otherwise(F.array().cast(T.ArrayType(T.StringType())))


ATOM = rf"(?:[{CJK}]|[{WORD}&&[^{CJK}]]++)"


def atoms(run: Column) -> Column:
    """What a run of word characters is made of: single CJK characters, and stretches
    of other characters, which stay whole."""
    return F.regexp_extract_all(run, F.lit(ATOM), F.lit(0))


def atom_windows(run: Column, size: Column) -> Column:
    """The ``size`` atoms from each atom on, where there are as many. One pass over the
    run: a slice of an array per place would copy the whole array each time."""
    pattern = F.concat(F.lit(f"(?=({ATOM}{{"), size.cast("string"), F.lit(f"}})){ATOM}"))
    return F.regexp_extract_all(run, pattern, F.lit(1))


def cjk_runs(text: Column) -> Column:
    """Maximal CJK runs of cleaned text."""
    return F.regexp_extract_all(strip_noise(text), F.lit(rf"[{CJK}]+"), F.lit(0))


def cjk_bigrams(text: Column) -> Column:
    """Overlapping character bigrams of every CJK run."""
    return F.regexp_extract_all(
        strip_noise(text), F.lit(rf"(?=([{CJK}]{{2}}))[{CJK}]"), F.lit(1)
    )


def char_windows(text: Column, least: Column, most: Column, head: Column | None = None) -> Column:
    """The substring at every offset: ``most`` characters, fewer near the end.

    Offsets with fewer than ``least`` characters left give none. The match
    consumes one full code point at a time, so surrogate pairs are never cut and
    the array index is the character offset. With a regular expression ``head``
    only offsets where it matches give a window.
    """
    lookahead = F.concat(F.lit("(?="), head, F.lit(")")) if head is not None else F.lit("")
    size = F.concat(least.cast("string"), F.lit(","), most.cast("string"))
    pattern = F.concat(F.lit("(?s)"), lookahead, F.lit("(?=(.{"), size, F.lit("}))."))
    return F.regexp_extract_all(text, pattern, F.lit(1))
