"""Repeated byte strings: suffix arrays built by deep-shallow sorting.

A window of ``WINDOW`` bytes repeats if it starts anywhere else, in the same text or
in another. A suffix array of every byte would carry each byte some two hundred
times; here the sorted suffixes are those that can decide something.

* **Copies.** Equal texts are one text with a count: with two or more of it, all its
  windows repeat.
* **Anchors.** Of the ``GRAM``-byte strings inside a window the one with the smallest
  hash is its anchor, the first of equals. Equal windows have the same anchor at the
  same place, so they can only meet in the group of that anchor. Windows that follow
  each other and share an anchor are one **unit**: the bytes of all of them, about
  285, one unit for about 85 bytes of text.
* **Units.** Each task sends a row per unit with the anchor's hash and a digest of its
  bytes. An anchor that stands once is done with; equal units repeat as a whole. Only
  where an anchor has different units (at the ends of a passage, around a changed
  word) do their bytes travel, one unit for each that differs.
* **Deep-shallow sorting.** A task takes such units, ``UNITS`` or more at a time. The
  suffixes that start at the anchors, and the reversed strings that end there, are
  sorted by multikey quicksort on eight bytes at a time, all groups at once, down to
  ``SHALLOW`` bytes; what is still equal there goes through a blind trie, which looks
  at one byte per branch and compares one string per insertion. Neighbours give the
  longest common prefixes (LCP) of both arrays. A window that begins t bytes before
  the anchor repeats if another suffix shares WINDOW - t bytes to the right and t to
  the left: two nodes, cut out of the LCPs at these depths.
* **Hot anchors**, of more than ``GROUP`` different units (the edges of a passage that
  very many texts share): there the prefix is the whole window, and single windows
  are dealt out by their digest.

Units and texts are told apart by 128 and 96 bits of digests, hot windows by 128.

Defined cases: a null or empty text has no bytes; texts shorter than a window keep
all; equal texts of a window or more go whole, the same id or not; rows without an id
are rows like others; a very long text is worked on in blocks of ``BLOCK`` bytes, and
in a task that holds it; an empty table gives an empty table; other columns are left
out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termpulse.llm.common import text_batches, text_edges, written
from termpulse.llm.wordhash import mix
from termpulse.storage import broadcast_if_small

WINDOW = 200
GRAM = 32
#: Grams of a window.
STARTS = WINDOW - GRAM + 1
BLOCK = 1 << 22
SHALLOW = 64
#: Units a task compares with each other before it sends them, and sorts at once.
CHUNK = 200_000
UNITS = 20_000
GROUP = 20_000
#: A mark is a byte position times 256 and a number of windows that start from there.
COUNT = 256
NOTHING = hashlib.sha256(b"").hexdigest()


# --- units ------------------------------------------------------------------------


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` neighbours."""
    low, reach = values, 1
    while reach * 2 <= width:
        low, reach = np.minimum(low[:-reach], low[reach:]), reach * 2
    rest = width - reach
    return np.minimum(low[:-rest], low[rest:]) if rest else low


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each place on."""
    n = len(data) - GRAM + 1
    eights = np.ndarray(len(data) - 7, "<u8", np.ascontiguousarray(data), strides=(1,)).copy()
    total = np.zeros(n, np.uint64)
    for at in range(0, GRAM, 8):
        total = mix(total ^ eights[at : at + n]) + np.uint64(0x9E3779B97F4A7C15)
    return total


def units_of(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Units of texts that stand one after another: place, anchor, windows and hash.

    ``ends`` holds, for each byte, where its text ends.
    """
    found = []
    for block in range(0, max(0, len(data) - WINDOW + 1), BLOCK):
        part = data[block : block + BLOCK + WINDOW - 1]
        hashes = gram_hashes(part)
        # The upper bits order the grams, the lower ones tell where the smallest is.
        places = np.arange(len(hashes), dtype=np.uint64)
        low = sliding_min(hashes & ~np.uint64(0xFFFFFF) | places, STARTS) & np.uint64(0xFFFFFF)
        start = np.arange(len(low)) + block
        whole = start + WINDOW <= ends[start]
        anchor = np.where(whole, low.astype(np.int64), -1)
        # A new text starts where the one before ends: the windows across are not whole.
        first = np.flatnonzero(np.diff(anchor, prepend=-2))
        windows = np.diff(np.append(first, len(anchor)))
        first, windows = first[anchor[first] >= 0], windows[anchor[first] >= 0]
        at = anchor[first]
        found.append((first + block, at + block, windows, hashes[at]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else tuple(np.empty(0, t) for t in (int, int, int, np.uint64))


_UNIT = "deal long, known boolean, key long, unit long, doc long, twin int, place long"


def _packed(place: np.ndarray, anchor: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Start of a unit, offset of its anchor and number of its windows in one number."""
    return (place << 16 | (anchor - place) << 8 | windows).astype(np.int64)


def _texts(batches, columns: tuple[int, ...]):
    """Batches of (id, text, ...): some columns, the bytes of the texts, and their edges."""
    for batch in text_batches(batches):
        edges, whole = text_edges(batch.column(1)), batch.column(1).buffers()[2]
        data = np.frombuffer(whole, np.uint8)[edges[0] : edges[-1]] if whole is not None else np.empty(0, np.uint8)
        yield [batch.column(c) for c in columns], data, edges - edges[0]


def _sent_units(rows: DataFrame) -> DataFrame:
    """Units of the texts of ``doc, text, twin``, each text once per task and chunk.

    Units that the task sees more than once are known to repeat: all of them are
    listed as such, and one goes on.
    """
    names = [c.split()[0] for c in _UNIT.split(", ")]

    def batch_of(deal, known, key, unit, doc, twin, place):
        columns = (deal.view(np.int64), np.full(len(key), known), key.view(np.int64), unit.view(np.int64), doc, twin, place)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    def flush(waiting):
        key, unit, doc, twin, place = map(np.concatenate, zip(*waiting, strict=True))
        order = np.lexsort((place, twin, doc, unit, key))
        key, unit, doc, twin, place = (c[order] for c in (key, unit, doc, twin, place))
        same = (key[1:] == key[:-1]) & (unit[1:] == unit[:-1])
        first = np.append(True, ~same)
        twice = ~first | np.append(same, False)
        k = np.flatnonzero(twice)
        if len(k):  # any task will do for these
            yield batch_of(doc[k], True, key[k], unit[k], doc[k], twin[k], place[k])
        # Of several the first two go on, so that others learn that there are two.
        k = np.flatnonzero(first | np.append(False, first[:-1]))
        yield batch_of(key[k], False, key[k], unit[k], doc[k], twin[k], place[k])

    def run(batches):
        waiting, n_waiting, seen = [], 0, set()
        for (docs, twins), data, edges in _texts(batches, (0, 2)):
            docs, twins = docs.to_numpy(), twins.to_numpy()
            names = list(zip(docs.tolist(), twins.tolist(), strict=True))
            new = np.array([n not in seen and not seen.add(n) for n in names], bool)
            lengths = np.diff(edges)
            # A text that the task has seen has no windows here.
            ends = np.repeat(np.where(new, edges[1:], 0), lengths)
            place, anchor, windows, key = units_of(data, ends)
            owner = np.searchsorted(edges, place, "right") - 1
            raw = data.tobytes()
            unit = b"".join(
                hashlib.blake2b(raw[p : p + n], digest_size=8).digest()
                for p, n in zip(place.tolist(), (windows + WINDOW - 1).tolist(), strict=True)
            )
            start = edges[owner]
            waiting.append((key, np.frombuffer(unit, np.uint64), docs[owner], twins[owner], _packed(place - start, anchor - start, windows)))
            n_waiting += len(place)
            if n_waiting >= CHUNK:
                yield from flush(waiting)
                waiting, n_waiting = [], 0
            if len(seen) > CHUNK:
                seen = set()
        if n_waiting:
            yield from flush(waiting)

    return rows.select("doc", "text", "twin").mapInArrow(run, _UNIT)


REPEATS, WANTED, HOT = range(3)
_MET = "kind int, key long, doc long, twin int, place long, known boolean"


def _met(sent: DataFrame, group: int) -> DataFrame:
    """What becomes of the units where they meet: those that repeat, those whose bytes
    are wanted (``known``: they repeat, others may repeat parts of them), and the
    anchors with more than ``group`` different units.

    Rows stream by in order; what a row becomes hangs on the rows beside it only.
    """
    names = [c.split()[0] for c in _MET.split(", ")]
    dealt = sent.repartition("deal").sortWithinPartitions("known", "key", "unit", "doc", "twin", "place")

    def batch_of(kind, key, doc, twin, place, known):
        columns = (np.full(len(key), kind, np.int32), key, doc, twin, place, known)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    def judged(columns, follows, state):
        """Rows whose successor is known; ``follows`` are key and unit after the last."""
        key, unit, doc, twin, place = columns
        before = state.get("last")
        key_prev = np.append(before[0] if before else ~key[0], key[:-1])
        unit_prev = np.append(before[1] if before else 0, unit[:-1])
        key_next = np.append(key[1:], follows[0] if follows else ~key[-1])
        unit_next = np.append(unit[1:], follows[1] if follows else 0)
        begins = (key != key_prev) | (unit != unit_prev)
        stops = (key != key_next) | (unit != unit_next)
        repeats = ~(begins & stops)
        # A run of equal units has others beside it if its anchor goes on before or after.
        run = np.cumsum(begins)
        others = np.append(state.get("others", False), (key == key_prev)[begins])
        mixed = others[run] | (key == key_next)
        state["others"], state["last"] = bool(others[-1]), (key[-1], unit[-1])
        ones = np.zeros(len(key), bool)
        yield batch_of(REPEATS, *(c[repeats] for c in (key, doc, twin, place)), ones[repeats])
        wanted = stops & mixed
        yield batch_of(WANTED, *(c[wanted] for c in (key, doc, twin, place)), repeats[wanted])
        # Different units of each anchor, across batches.
        at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        counts = np.add.reduceat(stops.astype(np.int64), at)
        if before and before[0] == key[0]:
            counts[0] += state.get("units", 0)
        state["units"] = int(counts[-1])
        done = key[at][counts > group] if not follows or follows[0] != key[-1] else key[at[:-1]][counts[:-1] > group]
        if len(done):
            empty = np.zeros(len(done), np.int64)
            yield batch_of(HOT, done, empty, empty.astype(np.int32), empty, empty.astype(bool))

    def run(batches):
        state: dict = {}
        held, last = None, None
        for batch in batches:
            known = batch.column("known").to_numpy(zero_copy_only=False)
            columns = [batch.column(c).to_numpy() for c in ("key", "unit", "doc", "twin", "place")]
            if known.any():
                key, _, doc, twin, place = (c[known] for c in columns)
                yield batch_of(REPEATS, key, doc, twin, place, np.zeros(len(key), bool))
                columns = [c[~known] for c in columns]
            if not len(columns[0]):
                continue
            # Tasks that met the same text send the same rows.
            prior = [np.append(l, c[:-1]) for l, c in zip(last, columns, strict=True)] if last else [np.append(c[:1], c[:-1]) for c in columns]
            same = np.logical_and.reduce([c == p for c, p in zip(columns, prior, strict=True)])
            if not last:
                same[0] = False
            last = [c[-1] for c in columns]
            columns = [c[~same] for c in columns]
            if not len(columns[0]):
                continue
            if held:
                yield from judged(held, (columns[0][0], columns[1][0]), state)
            held = columns
        if held:
            yield from judged(held, None, state)

    return dealt.mapInArrow(run, _MET)


# --- deep-shallow sorting -----------------------------------------------------------


def multikey_quicksort(words: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by group and then by the columns of ``words``, and where rows differ.

    Every group is split by one of its words into smaller, equal and greater ones, all
    groups at once; equal ones go on with the next word.
    """
    order = np.argsort(group, kind="stable")
    starts = np.append(True, group[order][1:] != group[order][:-1])
    depth = np.zeros(len(order), np.int64)
    while True:
        label = np.cumsum(starts) - 1
        size = np.bincount(label)
        active = np.flatnonzero((size[label] > 1) & (depth < words.shape[1]))
        if not len(active):
            return order, starts
        first = np.flatnonzero(starts)
        word = words[order[active], depth[active]]
        middle = first[label[active]] + size[label[active]] // 2
        pivot = words[order[middle], depth[active]]
        side = (word > pivot).astype(np.int8) - (word < pivot).astype(np.int8)
        by = np.lexsort((side, label[active]))
        order[active] = order[active][by]
        # A part's label stays; only the sides inside it are set apart.
        side = side[by]
        depth[active] = depth[active][by] + (side == 0)
        starts[active[1:]] |= (label[active][1:] == label[active][:-1]) & (side[1:] != side[:-1])


def blind_trie_order(strings: list[bytes]) -> list[int]:
    """The order of strings by a blind trie; the shorter of two comes first.

    An inner node knows how deep its branches part and the byte of each branch, not
    the bytes above. A string goes down blindly to some leaf and is compared with that
    one only; the first difference tells where it belongs.
    """
    width = max(map(len, strings))
    numbers = [int.from_bytes(s.ljust(width, b"\0"), "big") for s in strings]
    root: list | int = 0  # a leaf is the number of a string, a node is [depth, branches]
    equal: dict[int, list[int]] = {0: [0]}
    for i in range(1, len(strings)):
        s, node = strings[i], root
        while not isinstance(node, int):
            branches = node[1]
            node = branches.get(s[node[0]] if node[0] < len(s) else -1)
            if node is None:
                node = next(iter(branches.values()))
        t = strings[node]
        same = width - ((numbers[i] ^ numbers[node]).bit_length() + 7) // 8
        same = min(same, len(s), len(t))
        if same == len(s) == len(t):
            equal[node].append(i)
            continue
        equal[i] = [i]
        new, old = s[same] if same < len(s) else -1, t[same] if same < len(t) else -1
        above, node = None, root
        while not isinstance(node, int) and node[0] < same:
            above, node = node, node[1][s[node[0]]]
        if not isinstance(node, int) and node[0] == same:
            node[1][new] = i
        elif above is None:
            root = [same, {old: node, new: i}]
        else:
            above[1][s[above[0]]] = [same, {old: node, new: i}]
    out, waiting = [], [root]
    while waiting:
        node = waiting.pop()
        if isinstance(node, int):
            out += equal[node]
        else:
            waiting += [node[1][b] for b in sorted(node[1], reverse=True)]
    return out


def deep_shallow_sort(strings: list[bytes], group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by group and string, and each one's LCP with the one before it; -1 at the
    start of a group."""
    n, width = len(strings), max(SHALLOW, max(map(len, strings)))
    width += -width % 8
    table = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), np.uint8).reshape(n, width)
    words = table[:, :SHALLOW].copy().view(">u8").astype(np.uint64)
    order, starts = multikey_quicksort(words, group)
    edges = np.append(np.flatnonzero(starts), n)
    for k in np.flatnonzero(np.diff(edges) > 1):
        part = order[edges[k] : edges[k + 1]]
        order[edges[k] : edges[k + 1]] = part[blind_trie_order([strings[i] for i in part])]
    lengths = np.array([len(s) for s in strings])[order]
    lcp = np.full(n, -1)
    for at in range(1, n, 1 << 14):  # few rows of the table at a time
        a, b = table[order[at - 1 : at - 1 + (1 << 14)]], table[order[at : at + (1 << 14)]]
        apart = a[: len(b)] != b
        lcp[at : at + len(b)] = np.where(apart.any(axis=1), apart.argmax(axis=1), width)
    lcp[1:] = np.minimum(lcp[1:], np.minimum(lengths[1:], lengths[:-1]))
    lcp[np.append(True, group[order][1:] != group[order][:-1])] = -1
    return order, lcp


def repeated_windows(key: np.ndarray, anchor: np.ndarray, windows: np.ndarray, bodies: list[bytes]) -> np.ndarray:
    """Which windows of each unit also stand in another unit; one row per unit."""
    n = len(bodies)
    right, right_lcp = deep_shallow_sort([b[a:] for b, a in zip(bodies, anchor, strict=True)], key)
    left, left_lcp = deep_shallow_sort([b[:a][::-1] for b, a in zip(bodies, anchor, strict=True)], key)

    def longest(order, lcp):
        best = np.empty(n, np.int64)
        best[order] = np.maximum(lcp, np.append(lcp[1:], -1))
        return best

    # Bytes before the anchor at which a window of the unit can be shared.
    least = np.maximum(anchor - windows + 1, WINDOW - longest(right, right_lcp))
    most = np.minimum(anchor, longest(left, left_lcp))
    found = np.zeros((n, STARTS), bool)
    if not (least <= most).any():
        return found
    right_node, left_node = np.empty(n, np.int64), np.empty(n, np.int64)
    for t in range(int(least[least <= most].min()), int(most[least <= most].max()) + 1):
        has = np.flatnonzero((least <= t) & (t <= most))
        if len(has) < 2:
            continue
        right_node[right] = np.cumsum(right_lcp < WINDOW - t)
        left_node[left] = np.cumsum(left_lcp < t)
        node = right_node[has] * (n + 1) + left_node[has]
        by = np.argsort(node, kind="stable")
        same = node[by][1:] == node[by][:-1]
        twice = has[by[np.append(same, False) | np.append(False, same)]]
        found[twice, anchor[twice] - t] = True
    return found


# --- from units to texts --------------------------------------------------------------

_BODY = "key long, high long, doc long, twin int, place long, known boolean, body binary"


def _bodies(texts: DataFrame) -> DataFrame:
    """The bytes of the units wanted of each text; of hot anchors the digests of single
    windows, which then are the key."""
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.binary())
    names = [c.split()[0] for c in _BODY.split(", ")]

    def run(batches):
        for batch in batches:
            for part in text_batches(iter([batch.select(["doc", "text", "twin", "wanted"])]), rows=64):
                rows, size = [], 0
                for doc, text, twin, wanted in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    raw = text.encode()
                    for unit in wanted:
                        place, windows = unit["place"] >> 16, unit["place"] & 255
                        if unit["hot"]:
                            for p in range(place, place + windows):
                                digest = hashlib.blake2b(raw[p : p + WINDOW], digest_size=16).digest()
                                high, low = (int.from_bytes(digest[k : k + 8], "little", signed=True) for k in (0, 8))
                                rows.append((low, high, doc, twin, p << 16 | 1, unit["known"], None))
                                size += 64
                        else:
                            rows.append((unit["key"], 0, doc, twin, unit["place"], unit["known"], raw[place : place + windows + WINDOW - 1]))
                            size += WINDOW + windows + 64
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return texts.mapInArrow(run, _BODY)


def _whole_keys(batches, enough: int):
    """Tables of whole groups of equal keys, which stand together, of ``enough`` rows or
    more, but for the last."""
    waiting: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column("key").to_numpy()
        if rows >= enough and waiting[-1].column("key")[-1].as_py() != keys[0]:
            yield pa.Table.from_batches(waiting)
            waiting, rows = [], 0
        start = 0
        for cut in (np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist():
            if rows + cut - start >= enough:
                yield pa.Table.from_batches([*waiting, batch.slice(start, cut - start)])
                waiting, rows, start = [], 0, cut
        waiting.append(batch.slice(start))
        rows += batch.num_rows - start
    if waiting:
        yield pa.Table.from_batches(waiting)


def _repeating(bodies: DataFrame) -> DataFrame:
    """``doc, twin, mark`` of the windows of different units that repeat."""
    names = ["doc", "twin", "mark"]

    def run(batches):
        for table in _whole_keys(batches, UNITS):
            key, high, doc, twin, place = (table.column(c).to_numpy() for c in ("key", "high", "doc", "twin", "place"))
            known = table.column("known").to_numpy()
            single = np.array(table.column("body").is_null().to_pylist())
            k = np.flatnonzero(single)
            if len(k):
                by = k[np.lexsort((high[k], key[k]))]
                same = (key[by][1:] == key[by][:-1]) & (high[by][1:] == high[by][:-1])
                by = by[np.append(same, False) | np.append(False, same)]
                yield pa.RecordBatch.from_arrays([pa.array(doc[by]), pa.array(twin[by]), pa.array((place[by] >> 16) * COUNT + 1)], names=names)
            k = np.flatnonzero(~single)
            if not len(k):
                continue
            bodies = table.column("body").take(pa.array(k)).to_pylist()
            found = repeated_windows(key[k], place[k] >> 8 & 255, place[k] & 255, bodies)
            found[known[k]] = False
            edges = np.diff(np.pad(found.astype(np.int8), ((0, 0), (1, 1))), axis=1)
            (row, begin), (_, end) = np.nonzero(edges == 1), np.nonzero(edges == -1)
            at = k[row]
            yield pa.RecordBatch.from_arrays([pa.array(doc[at]), pa.array(twin[at]), pa.array(((place[at] >> 16) + begin) * COUNT + end - begin)], names=names)

    dealt = bodies.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "doc long, twin int, mark long")


def spans_of(marks: list[int]) -> np.ndarray:
    """Maximal runs of covered bytes, as rows (start, end)."""
    packed = np.sort(np.array(marks, np.int64))
    start, end = packed // COUNT, np.maximum.accumulate(packed // COUNT + packed % COUNT + WINDOW - 1)
    first = np.append(True, start[1:] > end[:-1])
    return np.stack([start[first], end[np.append(np.flatnonzero(first)[1:] - 1, len(end) - 1)]], axis=1)


def _cut(texts: DataFrame, whole: bool) -> DataFrame:
    """``doc, twin, n_removed, spans, kept_sha256`` and, if ``whole``, the kept bytes."""
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.string(), pa.binary()]
    names = ["doc", "twin", "n_removed", "spans", "kept_sha256", "kept"]

    def run(batches):
        for batch in text_batches(batches, rows=64):
            rows = []
            for doc, text, twin, copies, marks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = text.encode()
                spans = np.array([[0, len(raw)]]) if copies > 1 else spans_of(marks)
                edges = [0, *spans.ravel().tolist(), len(raw)]
                kept = [raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]
                digest = hashlib.sha256()
                for piece in kept:
                    digest.update(piece)
                rows.append((doc, twin, int((spans[:, 1] - spans[:, 0]).sum()), spans.ravel().tolist(), digest.hexdigest(), b"".join(kept) if whole else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    columns = texts.filter("copies > 1 OR marks IS NOT NULL").select("doc", "text", "twin", "copies", "marks")
    return columns.mapInArrow(run, "doc long, twin int, n_removed long, spans array<long>, kept_sha256 string, kept binary")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole: bool = False, group: int = GROUP) -> DataFrame:
    """Per row: ``id_col, n_bytes, n_removed, spans, kept_sha256`` and, with ``whole``,
    ``kept``: the bytes that stay. ``spans`` are starts and ends of the maximal removed
    runs, in bytes, one after the other."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    sha = F.sha2(text, 256)
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"), sha.alias("sha"))
    rows = rows.withColumns({"doc": F.xxhash64("sha"), "twin": F.hash("sha")})
    long = rows.filter(F.col("n_bytes") >= WINDOW)

    met = written(_met(_sent_units(long), group), "units")
    hot = met.filter(F.col("kind") == HOT).select("key", F.lit(True).alias("hot"))
    wanted = met.filter(F.col("kind") == WANTED).join(broadcast_if_small(hot), "key", "left")
    unit = F.struct("key", "place", "known", F.coalesce("hot", F.lit(False)).alias("hot"))
    wanted = wanted.groupBy("doc", "twin").agg(F.collect_list(unit).alias("wanted"))

    # Each different text travels once; both joins find it dealt out by the same keys.
    texts = long.groupBy("doc", "twin").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    bodies = _bodies(texts.join(wanted.hint("shuffle_hash"), ["doc", "twin"]).select("doc", "text", "twin", "wanted", "copies"))
    marks = _repeating(bodies)
    covered = met.filter(F.col("kind") == REPEATS).select("doc", "twin", (F.shiftright("place", 16) * COUNT + F.col("place").bitwiseAND(255)).alias("mark"))
    marks = marks.unionByName(covered).groupBy("doc", "twin").agg(F.collect_set("mark").alias("marks"))
    cut = _cut(texts.join(marks.hint("shuffle_hash"), ["doc", "twin"], "left").select("doc", "text", "twin", "copies", "marks"), whole)

    found = rows.select("id", "n_bytes", "sha", "doc", "twin", *(["text"] if whole else [])).join(cut, ["doc", "twin"], "left")
    out = found.select(
        F.col("id").alias(id_col),
        "n_bytes",
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("spans", F.array().cast("array<long>")).alias("spans"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"),
        *([F.coalesce("kept", F.encode("text", "UTF-8")).alias("kept")] if whole else []),
    )
    return out
