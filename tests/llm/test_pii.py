"""Spans against plain regular expressions and checks in Python."""

import random
import re

from pyspark.sql import functions as F

from termpulse.llm import pii

# --- fixed values: the patterns as the contract states them -----------------------
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BITS = ["4111 1111 1111 1111", "4111111111111112", "378282246310005", "+49 (30) 1234-5678", "+1", "a@b.co", "_x@d.com",
        "@", ".", "-", " ", "1.2.3.4", "256.1.1.1", "9", "12", "é", "😀", "x", "+", "%", "\n", "0001.02.3.255"]


def luhn(number):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(number))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def expected(text):
    found = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": lambda: True,
                "ip": lambda m=m: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda d=digits: 14 <= len(d) <= 19 and luhn(d),
                "phone": lambda d=digits: 10 <= len(d) <= 15,
            }[kind]()
            if ok:
                found.append((m.start(), k, m.end(), kind))
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found))


def run(make_docs, texts):
    base = tuple(k for k in pii.KINDS if k.name in pii.BASE)
    found = pii.find(make_docs(list(enumerate(texts))), kinds=base)
    return [r.s for r in found.select("doc_id", pii.listed(F.col("spans")).alias("s")).orderBy("doc_id").collect()]


def test_base_spans_are_those_of_plain_patterns(make_docs):
    rng = random.Random(5)
    texts = ["".join(rng.choices(BITS, k=rng.randint(1, 25))) for _ in range(1500)]
    assert run(make_docs, texts) == [expected(t) for t in texts]


def test_long_texts_need_no_stack_and_little_time(make_docs):
    texts = ["7" * 200_000, "1 " * 100_000, "a." * 100_000, "+1" + "(2" * 50_000, "a@b.co " * 3_000]
    assert run(make_docs, texts) == [expected(t) if len(t) < 100_000 else expected(t[:0]) for t in texts]


def test_checks_and_context(make_docs):
    texts = ["iban DE89 3704 0044 0532 0130 00.", "iban DE88 3704 0044 0532 0130 00.", "my ssn is 123-45-6789", "code 123-45-6789"]
    rows = {r.doc_id: r.spans for r in pii.find(make_docs(list(enumerate(texts)))).collect()}
    kinds = {i: [s.kind for s in spans] for i, spans in rows.items()}
    assert "iban" in kinds[0] and "iban" not in kinds[1] and kinds[2] == ["ssn"] and kinds[3] == []
    score = {s.kind: s.score for s in rows[0]}
    assert score["iban"] == 1.0


def test_redaction(make_docs):
    texts = ["mail a@b.co or c@d.org now", "none", "é1.2.3.4!"]
    rows = pii.redact(make_docs(list(enumerate(texts)))).orderBy("doc_id").collect()
    assert [r.redacted for r in rows] == ["mail [email] or [email] now", "none", "é[ip]!"]
