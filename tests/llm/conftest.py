import public_tokenizers
import pytest

from termpulse.llm.common import let_workers_import

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")

BASE = " ".join(f"word{i} goes{i % 7} here{i % 5}" for i in range(40))
#: Every awkward row at once; the last columns clash with names used inside operators.
ODD = [
    (1, BASE, "en", "src0"),
    (2, BASE, "en", "src0"),
    (2, BASE, "en", "src0"),
    (3, BASE + " and one more", "en", None),
    (4, None, "en", "src0"),
    (5, "", None, "src1"),
    (6, " \t\n ", "de", None),
    (7, "short", "de", "src1"),
    (8, "Ünïcödé ß 日本語 😀 �", "de", "a.example.org"),
    (9, "x" * 70_000, "en", "src2"),
    (10, "ab " * 30_000, "en", "src2"),
    (None, "no id at all but a text", "en", "src3"),
    (None, BASE, "en", "src3"),
]
CLASHES = ("_id", "_text", "id", "ids", "class", "bucket", "kept", "_row", "sig", "item", "_hash", "twin", "key")


@pytest.fixture(scope="session", autouse=True)
def importable(spark):
    let_workers_import(spark)


@pytest.fixture(scope="session")
def make_docs(spark):
    def build(rows):
        rows = [(*r, *[None] * (4 - len(r)), *["x"] * len(CLASHES)) for r in rows]
        names = ["doc_id long", "text string", "lang string", "source string", *(f"{c} string" for c in CLASHES)]
        return spark.createDataFrame(rows, ", ".join(names)).repartition(3)

    return build


@pytest.fixture(scope="session")
def odd(make_docs):
    return make_docs(ODD)


@pytest.fixture(scope="session")
def no_docs(make_docs):
    return make_docs([])
