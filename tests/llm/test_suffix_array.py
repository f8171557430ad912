"""Repeated byte strings against brute force, and the sort against Python's."""

import hashlib
import os
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from termpulse.llm import suffix_array
from termpulse.llm.common import text_batches

W = suffix_array.WINDOW


def brute(rows):
    raws = [(i, (text or "").encode()) for i, text in rows]
    seen = Counter(raw[p : p + W] for _, raw in raws for p in range(len(raw) - W + 1))
    out = []
    for i, raw in raws:
        gone = bytearray(len(raw))
        for p in range(len(raw) - W + 1):
            if seen[raw[p : p + W]] > 1:
                gone[p : p + W] = b"\1" * W
        spans = sum(1 for k in range(len(raw)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out.append((i, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept))
    return sorted(out, key=str)


def texts(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(300)]

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n))

    passages = [prose(70) for _ in range(4)]
    rows = []
    for i in range(70):
        text = prose(rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, 100)
            text += rng.choice(passages)[at : at + rng.randint(150, 320)] + prose(rng.randint(0, 20))
        rows.append((i, text))
    rows += [(100, rows[3][1]), (100, rows[3][1]), (101, rows[5][1] + "x"), (102, None), (103, ""), (104, "x" * 3000)]
    rows += [(105, "ab " * 300), (106, "é" * 150), (107, "é" * 99 + passages[0]), (108, rows[7][1][:-1] + "y")]
    rows += [(109, "z" * 199), (110, "z" * 200), (None, passages[1]), (111, "\0" * 210 + prose(5)), (112, prose(5) + "\0" * 209)]
    return rows


@pytest.mark.parametrize("seed, group", [(1, 20_000), (2, 1), (3, 3)])
def test_repeats_by_brute_force(make_docs, monkeypatch, seed, group):
    rows = texts(seed)
    found = suffix_array.remove_repeats(make_docs(rows), whole=True, group=group).collect()
    got = [(r.doc_id, r.n_bytes, r.n_removed, len(r.spans) // 2, r.kept_sha256, bytes(r.kept)) for r in found]
    want = brute(rows)
    assert sorted(got, key=str) == want
    assert any(0 < w[2] < w[1] for w in want) and any(w[3] > 1 for w in want)


def test_units_do_not_hang_on_blocks(monkeypatch):
    raw = "".join(text or "" for _, text in texts(5)).encode()
    data, ends = np.frombuffer(raw, np.uint8), np.full(len(raw), len(raw))

    def windows():
        place, anchor, n, key = suffix_array.units_of(data, ends)
        return {(p + k, a, h) for p, a, m, h in zip(*map(np.ndarray.tolist, (place, anchor, n, key)), strict=True) for k in range(m)}

    whole = windows()
    monkeypatch.setattr(suffix_array, "BLOCK", 1000)
    assert windows() == whole and len(whole) == len(raw) - W + 1


def test_deep_shallow_sort_is_a_sort():
    rng = random.Random(6)
    for _ in range(40):
        base = bytes(rng.choice(b"ab\0") for _ in range(250))
        strings = [base[: rng.randint(0, 250)] + bytes(rng.choice(b"ab\0") for _ in range(rng.randint(0, 5))) for _ in range(rng.randint(1, 200))]
        group = np.array([rng.randint(0, 3) for _ in strings])
        order, lcp = suffix_array.deep_shallow_sort(strings, group)
        assert [(group[i], strings[i]) for i in order] == sorted(zip(group, strings, strict=True))
        for a, b, shared in zip(order, order[1:], lcp[1:], strict=False):
            assert shared == (-1 if group[a] != group[b] else len(os.path.commonprefix([strings[a], strings[b]])))


def test_batches_of_texts_hold_few_bytes():
    short, long = ["x"] * 1000, ["y" * 1_000_000] * 5
    batch = pa.RecordBatch.from_pydict({"id": list(range(1005)), "text": short + long})
    parts = list(text_batches(iter([batch.slice(3)]), rows=400, size=2_500_000))
    assert sum(p.num_rows for p in parts) == 1002
    assert pa.Table.from_batches(parts).column("text").to_pylist() == (short + long)[3:]
    assert max(sum(map(len, p.column("text").to_pylist())) for p in parts) <= 2_500_000
    alone = list(text_batches(iter([batch]), size=10))
    assert [p.num_rows for p in alone[-5:]] == [1] * 5
