"""Exact dedup over an extendible-hash index, in DataFrame operations only.

1. Every row gets a 64-bit hash of its normalised text. One pass counts rows per hash;
   only hashes are shuffled.
2. The directory: the leading ``depth`` bits of the hash name a slot. It starts
   with few slots and is doubled as long as a slot holds more hashes than a bucket
   may, up to 2^MAX_DEPTH slots; a bucket is the shortest prefix that is not
   overfull, so slots share a bucket where there is nothing to split. Copies never
   overfill a bucket, as they share their hash. The directory is broadcast: it has at
   most 2^MAX_DEPTH rows of 16 bytes.
3. Routing: each row finds its bucket in the directory. Before rows go to their owner,
   copies within a slice of the ids are put together, beginning inside each task; a text
   that makes up a third of all rows reaches its owner as ``SLICES`` rows at most.
4. Owner tasks: each bucket, a range of hashes, goes to one task, which sorts it by hash
   and text. Entries of one hash form a chain; the texts of neighbours in it are
   compared byte by byte, and an entry that differs takes the next place in the chain.
   Which texts are copies is decided here and nowhere else. The index is written to the
   shared folder.
5. Every row looks up its bucket, hash and digest. Entries with more than a
   ``HOT``-th of all rows, fewer than ``HOT`` by their number, are broadcast; no key of
   the other join has more rows than that.

Texts are equal when identical after lower-casing A-Z. Of equal texts the row with
the largest id stays.

Defined cases: a null text counts as empty, and empty texts equal each other; null
ids count in ``group_size`` and stay only if all ids of the group are null; rows
that repeat an id and a text are members of their own, with the same verdict; a long
text is hashed and compared whole, as one value of a row; an empty table gives an empty
table; other columns are left out.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termpulse.llm.common import ascii_lower, written

#: Hashes per bucket before it is split.
BUCKET_ENTRIES = 5_000
#: At most 65,536 slots.
MAX_DEPTH = 16
#: Rows per text that may reach an owner.
SLICES = 8
#: An entry is hot with more than this part of all rows.
HOT = 1_000


def _slot(depth: int):
    return F.shiftrightunsigned("_hash", 64 - depth) if depth else F.lit(0).cast("long")


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_bits: int = 64) -> DataFrame:
    """``id_col``, the normalised text and the leading ``hash_bits`` bits of its hash."""
    text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_text"))
    return rows.withColumn("_hash", F.xxhash64("_text").bitwiseAND(F.lit(-1 << (64 - hash_bits))))


def directory(hashes: DataFrame, bucket_entries: int = BUCKET_ENTRIES) -> tuple[int, DataFrame]:
    """The depth, and for each slot in use its bucket, named by the first slot of its range.

    ``hashes`` has a row per hash. A slot count is one number per slot and task.
    """
    total = hashes.count()
    depth = min(MAX_DEPTH, max(0, ceil(log2(max(1, total / bucket_entries)))))
    while True:
        slots = hashes.groupBy(_slot(depth).alias("_slot")).agg(F.count(F.lit(1)).alias("_n"))
        most = slots.agg(F.max("_n")).first()[0] or 0
        if most <= bucket_entries or depth >= MAX_DEPTH:
            break
        depth += 1
    # Every prefix of every slot, by the number of bits that it leaves out.
    prefixes = slots.select("_slot", "_n", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("_gap"))
    prefixes = prefixes.withColumn("_first", F.expr("shiftleft(shiftrightunsigned(_slot, _gap), _gap)"))
    inside = F.sum("_n").over(Window.partitionBy("_gap", "_first"))
    fitting = prefixes.withColumn("_inside", inside).filter((F.col("_inside") <= bucket_entries) | (F.col("_gap") == 0))
    return depth, fitting.groupBy("_slot").agg(F.max_by("_first", "_gap").alias("_bucket"))


def routed(rows: DataFrame, depth: int, slots: DataFrame) -> DataFrame:
    """Add the bucket that the directory names."""
    if not depth:
        return rows.withColumn("_bucket", _slot(0))
    return rows.withColumn("_slot", _slot(depth)).join(F.broadcast(slots), "_slot").drop("_slot")


def owned_entries(rows: DataFrame) -> DataFrame:
    """``_bucket, _hash, _chain, _sha, _keep, _size`` from routed rows, by the owner of each bucket."""
    in_slices = rows.groupBy("_bucket", "_hash", "_text", F.pmod(F.xxhash64("_id"), F.lit(SLICES)).alias("_slice")).agg(
        F.max("_id").alias("_keep"), F.count(F.lit(1)).alias("_size")
    )
    owned = in_slices.repartition("_bucket")
    place = F.dense_rank().over(Window.partitionBy("_bucket", "_hash").orderBy("_text"))
    chained = owned.select("_bucket", "_hash", place.alias("_chain"), F.sha2("_text", 256).alias("_sha"), "_keep", "_size")
    return chained.groupBy("_bucket", "_hash", "_chain").agg(
        F.first("_sha").alias("_sha"), F.max("_keep").alias("_keep"), F.sum("_size").alias("_size")
    )


def find_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_entries: int = BUCKET_ENTRIES, hash_bits: int = 64
) -> DataFrame:
    """Per row: ``id_col, keep_id, group_size, kept, text_sha256, bucket, chain``.

    ``keep_id`` is the id of the row that stays. Fewer ``hash_bits`` make longer chains,
    not other results.
    """
    rows = keyed(docs, id_col, text_col, hash_bits)
    hashes = written(rows.groupBy("_hash").agg(F.count(F.lit(1)).alias("_rows")), "hashes")
    total = hashes.agg(F.sum("_rows")).first()[0] or 0
    depth, slots = directory(hashes, bucket_entries)
    slots = written(slots, "directory")
    index = written(owned_entries(routed(rows, depth, slots)), "index")

    key, entry = ["_bucket", "_hash", "_sha"], F.struct("_keep", "_size", "_chain")
    is_hot = F.col("_size") > total / HOT
    hot = index.filter(is_hot).select(*key, entry.alias("_hot"))
    cold = index.filter(~is_hot).select("_bucket", "_hash", F.col("_sha").alias("_probe"), entry.alias("_cold"))
    asked = routed(rows.withColumn("_sha", F.sha2("_text", 256)).drop("_text"), depth, slots)
    asked = asked.join(F.broadcast(hot), key, "left")
    # Rows that are answered meet nothing in the second join, spread by their ids.
    spread = F.concat_ws("#", F.lit(""), "_id", F.spark_partition_id())
    asked = asked.withColumn("_probe", F.when(F.col("_hot").isNull(), F.col("_sha")).otherwise(spread))
    answered = asked.join(cold, ["_bucket", "_hash", "_probe"], "left").withColumn("_entry", F.coalesce("_hot", "_cold"))
    return answered.select(
        F.col("_id").alias(id_col),
        F.col("_entry._keep").alias("keep_id"),
        F.col("_entry._size").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_entry._keep")).alias("kept"),
        F.col("_sha").alias("text_sha256"),
        F.col("_bucket").alias("bucket"),
        F.col("_entry._chain").alias("chain"),
    )
