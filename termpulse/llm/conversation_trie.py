"""The prefix trie of conversations: which turns many of them begin with.

1. A turn is named by 128 bits of the SHA-256 of its role and text; a conversation is
   the string of its names. Texts stay where they are: only names and lengths move.
2. The strings are dealt out by ranges and sorted (ties by id), so that one sequence
   shared by a third of all conversations is spread over as many tasks as it needs.
3. **Blocks.** Each task takes ``BLOCK`` strings at a time. Neighbours are linked by
   the length of their common prefix (LCP), and a **union-find over these links, in
   descending depth**, joins components: every merge of components creates a
   branching node, or adds to the one of that depth. Between branching nodes the trie
   is a chain, which is written out when its component merges.
4. **Boundaries.** Only the prefixes of the first and of the last string of a block
   can go on in another block. A block's forest is contracted to these two spines,
   with sums over what hangs from them. Spines of all blocks meet by node; a pass over
   the merged spines, deepest first, completes their sums. That is the only step in
   one task: at most two spines for ``BLOCK`` conversations.
5. A node's ids are hashed in order: whole runs of equal strings in their block, runs
   that touch the block's ends piece by piece, in pieces of up to ``PIECE`` bytes.

Defined cases: a null role or text is empty; turns of one number are taken by their
names; a conversation without turns ends in the root; rows without a conversation id
are left out; repeated rows are turns like others; a very long text is hashed where
it is read; an empty table has no node; other columns are left out. Sixteen bytes and
a length per turn of a conversation must fit into one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termpulse.llm.common import written
from termpulse.storage import broadcast_if_small

NAME = 16
BLOCK = 20_000
BLOCK_BYTES = 16 << 20
PIECE = 1 << 20
HEAD = 6
FAMILY = 100

NODE, SPINE, IDS = range(3)
_FOUND = (
    "kind int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, ends_sha256 string, node binary, parent binary, chars long, ids binary"
)
_COLUMNS = [c.split()[0] for c in _FOUND.split(", ")]
_KINDS = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
_SCHEMA = pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in _FOUND.split(", ")])
OUT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


# --- sequences --------------------------------------------------------------------


def sequences(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, names, chars``: per conversation the hex names of its turns in order,
    and the code points of their texts."""
    said, role = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(role), F.lit(""))
    # The length of the role tells where the text begins.
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, said)
    item = F.struct(
        F.col(turn).alias("turn"),
        F.substring(F.sha2(whole, 256), 1, 2 * NAME).alias("name"),
        F.length(said).cast("long").alias("chars"),
    )
    rows = turns.filter(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv_id"), item.alias("t"))
    # Structs sort by turn, nulls first, then by name.
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t")).select(
        "conv_id", F.col("t.name").alias("names"), F.col("t.chars").alias("chars")
    )


def sharing_heads(found: DataFrame) -> DataFrame:
    """Sequences that begin like the first conversation of their hundred.

    Conversation c takes the first ``h`` turns of c - c % 100 (as many as there are)
    in place of its own first ``h``, h being the checksum of c modulo ``HEAD``. At
    most a hundred rows meet each head, of at most five turns.
    """
    heads = found.filter(F.col("conv_id") % FAMILY == 0).select(
        F.col("conv_id").alias("_base"),
        F.slice("names", 1, HEAD - 1).alias("_names"),
        F.slice("chars", 1, HEAD - 1).alias("_chars"),
    )
    h = (F.crc32(F.col("conv_id").cast("string")) % HEAD).cast("int")
    rows = found.withColumn("_h", h).withColumn("_base", F.col("conv_id") - F.col("conv_id") % FAMILY)
    joined = rows.join(heads, "_base", "left")

    def spliced(own: str, head: str):
        taken = F.coalesce(F.slice(head, F.lit(1), F.col("_h")), F.slice(own, 1, 0))
        return F.concat(taken, F.slice(own, F.col("_h") + 1, F.greatest(F.size(own) - F.col("_h"), F.lit(0)))).alias(own)

    return joined.select("conv_id", spliced("names", "_names"), spliced("chars", "_chars"))


# --- one block --------------------------------------------------------------------


def common_depth(a: bytes, b: bytes) -> int:
    """Names that two strings have in common from the start."""
    n = min(len(a), len(b))
    apart = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return (n - (apart.bit_length() + 7) // 8) // NAME


def joined_ids(ids: list[int]) -> bytes:
    return ",".join(map(str, ids)).encode()


NO_IDS = hashlib.sha256(b"").hexdigest()


def spine_names(key: bytes) -> list[bytes]:
    """Name of the node at each depth of a string."""
    chain = hashlib.sha256()
    names = [chain.digest()[:NAME]]
    for at in range(0, len(key), NAME):
        chain.update(key[at : at + NAME])
        names.append(chain.digest()[:NAME])
    return names


class Forest:
    """The trie of one block of sorted strings, by union-find over neighbours."""

    def __init__(self, keys: list[bytes], chars: list[list[int]], ids: list[int]):
        # Runs of equal strings.
        self.keys, self.chars, self.ids = [], [], []
        for k, key in enumerate(keys):
            if not self.keys or key != self.keys[-1]:
                self.keys.append(key)
                self.chars.append(chars[k])
                self.ids.append([])
            self.ids[-1].append(ids[k])
        m = len(self.keys)
        self.root = list(range(m))
        self.low, self.high = list(range(m)), list(range(m))
        # What is known of each component's highest node, at depth ``top``.
        self.top = [len(k) // NAME for k in self.keys]
        self.n = [len(i) for i in self.ids]
        self.least = [i[0] for i in self.ids]
        self.children = [0] * m
        self.leaves = [0] * m
        self.saved = [0] * m
        self.own = list(range(m))  # the string that ends in the node, or None
        self.waiting: list[list[int]] = [[] for _ in range(m)]  # children to be told their parent
        self.first, self.last = spine_names(self.keys[0]), spine_names(self.keys[-1])
        self.out: list[tuple] = []

    def find(self, k: int) -> int:
        while self.root[k] != k:
            self.root[k] = self.root[self.root[k]]
            k = self.root[k]
        return k

    def spine(self, k: int) -> list[bytes] | None:
        """Names of the spine that the component's node lies on, if it may go on elsewhere."""
        if self.low[k] == 0:
            return self.first
        return self.last if self.high[k] == len(self.keys) - 1 else None

    def close(self, k: int) -> None:
        """Write the component's highest node, and make its parent the highest."""
        depth, spine, own = self.top[k], self.spine(k), self.own[k]
        ids = self.ids[own] if own is not None else []
        chars = self.chars[self.low[k]][depth - 1] if depth else 0
        for row in self.waiting[k]:
            child = list(self.out[row])
            child[3], child[10] = (self.least[k], None) if spine is None else (None, spine[depth])
            self.out[row] = tuple(child)
        self.waiting[k] = []
        if spine is None:
            if not self.children[k]:
                self.leaves[k] = 1
            self.saved[k] += (self.n[k] - 1) * chars
            ends = hashlib.sha256(joined_ids(ids)).hexdigest() if ids else NO_IDS
            self.waiting[k] = [len(self.out)]
            self.out.append((NODE, self.least[k], depth, None, self.n[k], self.children[k], self.leaves[k], self.saved[k], ends, None, None, None, None))
            self.children[k] = 1
        else:
            above = spine[depth - 1] if depth else None
            self.out.append((SPINE, self.least[k], depth, None, self.n[k], self.children[k], self.leaves[k], self.saved[k], None, spine[depth], above, chars, None))
            for at in range(0, len(ids), PIECE // 20):
                part = ids[at : at + PIECE // 20]
                self.out.append((IDS, part[0], None, None, None, None, None, None, None, spine[depth], None, None, joined_ids(part)))
            self.children[k] = 0  # children on a spine are counted where spines meet
        self.top[k], self.own[k] = depth - 1, None

    def climb(self, k: int, depth: int) -> None:
        while self.top[k] > depth:
            self.close(k)

    def union(self, a: int, b: int, depth: int) -> None:
        a, b = self.find(a), self.find(b)
        self.climb(a, depth)
        self.climb(b, depth)
        if self.high[a] - self.low[a] < self.high[b] - self.low[b]:
            a, b = b, a
        self.root[b] = a
        self.low[a], self.high[a] = min(self.low[a], self.low[b]), max(self.high[a], self.high[b])
        self.n[a] += self.n[b]
        self.least[a] = min(self.least[a], self.least[b])
        self.children[a] += self.children[b]
        self.leaves[a] += self.leaves[b]
        self.saved[a] += self.saved[b]
        self.own[a] = self.own[b] if self.own[a] is None else self.own[a]
        self.waiting[a] += self.waiting[b]

    def rows(self) -> list[tuple]:
        links = [(common_depth(a, b), k) for k, (a, b) in enumerate(zip(self.keys, self.keys[1:], strict=False))]
        for depth, k in sorted(links, key=lambda x: -x[0]):
            self.union(k, k + 1, depth)
        self.climb(self.find(0), -1)
        return self.out


def _batch(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(rows), 10_000):
        columns = zip(*rows[at : at + 10_000], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA)


def _blocks(sorted_rows: DataFrame, block: int) -> DataFrame:
    def run(batches):
        keys, chars, ids, size = [], [], [], 0
        for batch in batches:
            for i, key, c in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "key", "chars")), strict=True):
                keys.append(key)
                chars.append(c)
                ids.append(i)
                size += len(key)
                if len(keys) >= block or size >= BLOCK_BYTES:
                    yield from _batch(Forest(keys, chars, ids).rows())
                    keys, chars, ids, size = [], [], [], 0
        if keys:
            yield from _batch(Forest(keys, chars, ids).rows())

    return sorted_rows.select("conv_id", "key", "chars").mapInArrow(run, _FOUND)


# --- where blocks meet --------------------------------------------------------------


def _completed(spines: DataFrame) -> DataFrame:
    """Merged spine nodes with the sums of their subtrees; deepest first, in one task."""

    def run(batches):
        above: dict[bytes, list[int]] = {}
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                # A node's own sums hold all that hangs from its part of the spine;
                # what the spine itself adds comes from below.
                children, leaves, saved = above.pop(row["node"], (0, 0, 0))
                children += row["n_children"]
                leaves += not children
                saved += (row["n_convs"] - 1) * row["chars"]
                out.append((children, row["n_leaves"] + leaves, row["saved_tokens"] + saved))
                if row["parent"] is not None:
                    total = above.setdefault(row["parent"], [0, 0, 0])
                    total[0] += 1
                    total[1] += leaves
                    total[2] += saved
            columns = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 3
            same = ("node", "parent", "conv_id", "depth", "n_convs")
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in same), *columns], names=[*same, "n_children", "n_leaves", "saved_tokens"])

    schema = "node binary, parent binary, conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long"
    return spines.repartition(1).sortWithinPartitions(F.desc("depth")).mapInArrow(run, schema)


def _hashed(pieces: DataFrame) -> DataFrame:
    """``node, ends_sha256`` of ids in pieces; a piece holds the ids between its first
    and the next piece's first."""

    def run(batches):
        node, digest = None, None
        for batch in batches:
            done = []
            rows = zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True)
            for key, parts in groupby(rows, key=lambda r: r[0]):
                if key != node:
                    if node is not None:
                        done.append((node, digest.hexdigest()))
                    node, digest, started = key, hashlib.sha256(), False
                for _, part in parts:
                    digest.update(b"," + part if started else part)
                    started = True
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), (pa.binary(), pa.string()), strict=True)], names=["node", "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([digest.hexdigest()])], names=["node", "ends_sha256"])

    dealt = pieces.select("node", "conv_id", "ids").repartition("node").sortWithinPartitions("node", "conv_id")
    return dealt.mapInArrow(run, "node binary, ends_sha256 string")


def prefix_trie(found: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per node of the trie of ``conv_id, names, chars``: ``conv_id, depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    A node is named by the smallest id that begins with it and by its depth.
    ``saved_tokens`` are the code points that its subtree stores once instead of once
    per conversation. ``ends_sha256`` is the digest of the ids that end in it.
    """
    rows = found.select("conv_id", F.unhex(F.array_join("names", "")).alias("key"), "chars")
    # Written, as dealing out by ranges reads its input twice.
    rows = written(rows, "sequences").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    parts = written(_blocks(rows, block), "forests")

    spines = parts.filter(F.col("kind") == SPINE).groupBy("node").agg(
        F.first("parent").alias("parent"),
        F.min("conv_id").alias("conv_id"),
        F.first("depth").alias("depth"),
        F.first("chars").alias("chars"),
        *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")),
    )
    spines = written(_completed(spines), "spines")
    named = spines.select(F.col("node").alias("parent"), F.col("conv_id").alias("_parent_id"))
    ends = _hashed(parts.filter(F.col("kind") == IDS))
    merged = spines.join(ends, "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_IDS)))
    merged = merged.withColumn("parent_conv_id", F.lit(None).cast("long"))
    whole = parts.filter(F.col("kind") == NODE)
    # What hangs from a spine learns there which id names its parent.
    columns = [*OUT, "parent"]
    everything = whole.select(columns).unionByName(merged.select(columns)).join(broadcast_if_small(named), "parent", "left")
    return everything.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_parent_id")).select(OUT)
