"""Conversation repair and the prefix trie against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from termpulse.llm import conversation_repair, conversation_trie
from termpulse.llm.common import table

SPACE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string, conv string, kind string, place string"


def odd_rows(seed, n=150):
    """Few distinct turns, so that ties, repeats and nulls of all kinds occur."""
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        conv = rng.choice([0, 1, 2, 5, 9, 100, 101, 150, 203, 307, 100_000_000_007])
        role = rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None])
        text = rng.choice(["Yes.", "No!", "maybe", "", " \n", "so? ", "Ünï. ", None, "a.b"])
        rows.append((conv, rng.choice([None, 0, 1, 2, 3, 4, 7]), role, text, "x", "x", "x"))
    return [*rows, (None, 1, "user", "Hi."), (None, None, None, None), (77, 5, "user", "x" * 50_000)]


def filled(rows):
    return [(*r, *["x"] * (7 - len(r))) for r in rows]


# --- repair -------------------------------------------------------------------------


def damage(rows):
    """Rows after damage by conversation; every conversation has a list."""
    found = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        found[conv]
        named = ":".join(" " if x is None else str(x) for x in (conv, turn))
        d = zlib.crc32(named.encode()) % 20
        text = " " if text is None else text
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        role = "user" if d == 4 else " " if role is None else role
        found[conv] += [(turn, role, text)] * {0: 0, 3: 2}.get(d, 1)
    return found


def cheapest(turns):
    """Cost, initials and lines of the best edits, by trying all of them."""

    @lru_cache(maxsize=None)
    def best(at, said):
        # ``said`` is what counts of the roles so far: "" (none), "s", "u" or "a".
        options = []
        if at == len(turns):
            if said in ("", "a"):
                return 0, "", ()
        else:
            role, text, fault = turns[at]
            extra = 3 if fault == "truncated" else 0
            cost, edits, lines = best(at + 1, said)
            options.append((4 + cost, "D" + edits, lines))
            if fault not in ("blank", "duplicate"):
                if role[:1] in {"": ("s", "u"), "s": ("u",), "u": ("a",), "a": ("u",)}[said]:
                    cost, edits, lines = best(at + 1, role[:1])
                    options.append((extra + cost, "K" + edits, (f"{role}:{text}", *lines)))
                new = "assistant" if said == "u" else "user"
                cost, edits, lines = best(at + 1, new[0])
                options.append((3 + extra + cost, "R" + edits, (f"{new}:{text}", *lines)))
        depth = 0
        new = said
        before = ()
        while depth < 3:  # turns put in before this one
            new = "a" if new == "u" else "u"
            depth += 1
            before = (*before, "assistant:" if new == "a" else "user:")
            for cost, edits, lines in without_insert(at, new):
                options.append((3 * depth + cost, "I" * depth + edits, (*before, *lines)))
        return min(options)

    @lru_cache(maxsize=None)
    def without_insert(at, said):
        if at == len(turns):
            return [(0, "", ())] if said in ("", "a") else []
        role, text, fault = turns[at]
        extra, options = 3 if fault == "truncated" else 0, []
        cost, edits, lines = best(at + 1, said)
        options.append((4 + cost, "D" + edits, lines))
        if fault not in ("blank", "duplicate"):
            if role[:1] in {"": ("s", "u"), "s": ("u",), "u": ("a",), "a": ("u",)}[said]:
                cost, edits, lines = best(at + 1, role[:1])
                options.append((extra + cost, "K" + edits, (f"{role}:{text}", *lines)))
            new = "assistant" if said == "u" else "user"
            cost, edits, lines = best(at + 1, new[0])
            options.append((3 + extra + cost, "R" + edits, (f"{new}:{text}", *lines)))
        return options

    return best(0, "")


def repaired(rows):
    out = []
    for conv, turns in damage(rows).items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
        seen, judged = set(), []
        for _, role, text in turns:
            ended = text.rstrip(SPACE)
            fault = "blank" if not ended else "duplicate" if (role, text) in seen else "" if ended[-1] in ".!?" else "truncated"
            seen.add((role, text))
            judged.append((role, text, fault))
        numbers = {t[0] for t in turns} - {None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        pairs = ["".join((a[0][:1], b[0][:1])) for a, b in zip(judged, judged[1:], strict=False)]
        cost, edits, lines = cheapest(tuple(judged))
        counts = [sum(j[2] == f for j in judged) for f in ("blank", "duplicate", "truncated")]
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv, gaps, *counts, sum(p not in ("su", "ua", "au") for p in pairs), cost, edits, digest))
    return sorted(out, key=str)


def spark_repaired(df, **options):
    rows = conversation_repair.damaged(df)
    return sorted(map(tuple, conversation_repair.repair(rows, present=F.col("present"), **options).collect()), key=str)


def test_repair_of_the_table(spark, sf):
    df = table(spark, sf, "conversations")
    assert spark_repaired(df) == repaired([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


@pytest.mark.parametrize("seed, n", [(1, 60), (2, 150), (3, 400)])
def test_repair_by_brute_force(spark, seed, n):
    rows = odd_rows(seed, n)
    df = spark.createDataFrame(filled(rows), SCHEMA).repartition(3)
    assert spark_repaired(df) == repaired(rows)


def test_repair_of_long_conversations_spills_and_crosses_batches(spark):
    rng = random.Random(9)
    rows = [(c, t, rng.choice(["user", "assistant", "tool"]), f"turn {rng.randint(0, 400)}.") for c in (4, 8) for t in range(400)]
    df = spark.createDataFrame(filled(rows), SCHEMA)
    want = repaired(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 17)
    try:
        assert spark_repaired(df, spill=16) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_backpointers_come_back_from_the_file():
    back = conversation_repair.Backpointers(spill=100)
    values = [(k * 7 + k // 251) % 256 for k in range(200_000)]
    for v in values:
        back.add(v)
    assert list(back.reversed()) == values[::-1]
    back.close()


def test_edits_give_the_repaired_turns(spark, sf):
    rows = conversation_repair.damaged(table(spark, sf, "conversations"))
    edits = conversation_repair.repair(rows, present=F.col("present"), whole=True).orderBy("conv_id", "place").collect()
    lines, audits = defaultdict(list), defaultdict(str)
    for r in edits:
        audits[r.conv_id] += r.edit
        if r.edit != "D":
            lines[r.conv_id].append(f"{r.role}:{r.text}")
    for r in conversation_repair.repair(rows, present=F.col("present")).collect():
        assert audits[r.conv_id] == r.audit
        assert hashlib.sha256("\n".join(lines[r.conv_id]).encode()).hexdigest() == r.repaired_sha256
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines[r.conv_id]))


# --- trie -----------------------------------------------------------------------------


def trie(rows):
    turns = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            turns[conv].append((turn, role or "", text or ""))
    for conv in turns:
        turns[conv].sort(key=lambda t: (t[0] is not None, t[0] or 0, hashlib.sha256(f"{len(t[1])}:{t[1]}{t[2]}".encode()).hexdigest()))
    said = {}
    for conv in turns:
        h = zlib.crc32(str(conv).encode()) % 6
        said[conv] = tuple(t[1:] for t in turns.get(conv - conv % 100, [])[:h] + turns[conv][h:])
    members, children = defaultdict(list), defaultdict(set)
    for conv, s in said.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(conv)
            if d:
                children[s[: d - 1]].add(s[:d])
    leaves, saved = defaultdict(int), defaultdict(int)
    for s, m in members.items():
        for d in range(len(s) + 1):
            leaves[s[:d]] += not children[s]
            saved[s[:d]] += (len(m) - 1) * len(s[-1][1]) if s else 0
    out = []
    for s, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(said[c]) == len(s))))
        parent = min(members[s[:-1]]) if s else None
        out.append((min(m), len(s), parent, len(m), len(children[s]), leaves[s], saved[s], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def spark_trie(df, block=conversation_trie.BLOCK):
    found = conversation_trie.sharing_heads(conversation_trie.sequences(df))
    return sorted(map(tuple, conversation_trie.prefix_trie(found, block).collect()), key=str)


@pytest.mark.parametrize("block", [conversation_trie.BLOCK, 3, 1])
def test_trie_by_brute_force(spark, block, monkeypatch):
    rows = odd_rows(5, 200)
    rows += [(1000 + k, t, "user", "the same") for k in range(40) for t in range(8)]
    df = spark.createDataFrame(filled(rows), SCHEMA).repartition(4)
    assert spark_trie(df, block) == trie(rows)


def test_trie_of_the_table(spark, sf):
    df = table(spark, sf, "conversations")
    want = trie([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
    assert spark_trie(df) == want == spark_trie(df.repartition(5), 4)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert spark_trie(none) == [] and spark_repaired(none) == []
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    empty = hashlib.sha256(b"").hexdigest()
    df = spark.createDataFrame(filled([(gone, 0, "user", "x")]), SCHEMA)
    assert spark_repaired(df) == [(gone, 0, 0, 0, 0, 0, 0, "", empty)]
