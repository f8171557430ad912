"""Posts stored with an index of character n-grams, for one word after another.

A store holds three tables. ``posts``: the posts, in blocks of at most ``block_rows`` rows
with a folder each. ``grams``: per n-gram and block the places of the posts that hold it,
in buckets named by the n-gram's first character. ``about``: one row, written last.

A word is looked up by its n-grams: their places are intersected within each block, only
blocks with a post that holds all n-grams are read, and the posts are verified on their
text. Of a regular expression the pieces of plain text that every match must hold are
looked up; an expression without any reads all blocks. A block is written by one task as
rows come in, so that posts are not shuffled, and the places of an n-gram in a block are
one row of bounded size however frequent it is.

Defined cases: posts with null or empty text are stored, and found by no word; a long text
is one row and gives each n-gram once; an empty word is held by every text; further posts
go into a store of their own.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from termpulse.functions.text import char_windows
from termpulse.operators.filters import containing
from termpulse.storage import broadcast_if_small

#: Characters of an n-gram; a text's last one is shorter.
GRAM = 2
BLOCK_ROWS = 50_000
BUCKETS = 256
#: N-grams looked up for a word; with fewer than it has, more posts are verified.
LOOKUPS = 16

_GRAMS = "gram string, _block long, places array<int>, _bucket int"
# A row's number holds its task above these bits.
_TASK_BITS, _BLOCK_BITS = 33, 20


def _bucket_of(gram: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.substring(gram, 1, 1)), F.lit(buckets)).cast("int")


def write_index(
    posts: DataFrame, folder: str, content: str = "content", block_rows: int = BLOCK_ROWS, buckets: int = BUCKETS
) -> None:
    """Store posts and their index in a new folder."""
    spark = posts.sparkSession
    in_task = F.col("_row").bitwiseAND(F.lit((1 << _TASK_BITS) - 1))
    numbered = posts.withColumn("_row", F.monotonically_increasing_id())
    task = F.shiftright("_row", _TASK_BITS) * (1 << _BLOCK_BITS)
    stored = numbered.withColumns(
        {"_block": task + F.floor(in_task / block_rows), "_place": (in_task % block_rows).cast("int")}
    ).drop("_row")
    stored.write.partitionBy("_block").parquet(f"{folder}/posts")
    schema = StructType([f for f in stored.schema if f.name != "_block"]).add("_block", "long")
    # Read back, so that places stay right whatever task is run again.
    written = spark.read.schema(schema).parquet(f"{folder}/posts")
    held = F.array_distinct(char_windows(F.col(content), F.lit(1), F.lit(GRAM)))
    grams = written.select("_block", "_place", F.explode(held).alias("gram"))
    lists = grams.groupBy("gram", "_block").agg(F.sort_array(F.collect_list("_place")).alias("places"))
    lists = lists.withColumn("_bucket", _bucket_of(F.col("gram"), buckets))
    ordered = lists.hint("rebalance", "_bucket").sortWithinPartitions("_bucket", "gram")
    ordered.write.partitionBy("_bucket").parquet(f"{folder}/grams")
    about = [(schema.json(), content, buckets)]
    spark.createDataFrame(about, "posts string, content string, buckets int").write.parquet(f"{folder}/about")


def required_text(pattern: str) -> list[str]:
    """Pieces of plain text that every match of a Java regular expression holds.

    Careful rather than clever: what is not understood counts as any text, and an
    expression with alternatives, flags or quoting has no pieces.
    """
    if "(?" in pattern or "|" in pattern or "[]" in pattern or "[^]" in pattern:
        return []
    pieces, piece, i, groups, classes = [], "", 0, 0, 0

    def close() -> str:
        if piece:
            pieces.append(piece)
        return ""

    while i < len(pattern):
        c, plain = pattern[i], False
        if c == "\\":
            i += 1
            c = pattern[i : i + 1]
            if c in tuple("QEpPxuNck0"):
                return []
            plain = not c.isalnum()
        elif c == "[":
            classes += 1
        elif c == "]" and classes:
            classes -= 1
        elif classes:
            pass
        elif c == "(":
            groups += 1
        elif c == ")":
            groups -= 1
        elif c == "{":
            i = pattern.find("}", i)
            if i < 0:
                return []
            piece = piece[:-1]
        elif c in "*?":
            piece = piece[:-1]
        else:
            plain = c not in ".^$+"
        if plain and not groups and not classes:
            piece += c
        else:
            piece = close()
        i += 1
    close()
    return pieces


def _lookups(pieces: list[str]) -> list[str]:
    """N-grams to look up; single characters only where there is nothing longer."""
    grams = list(dict.fromkeys(p[i : i + GRAM] for p in pieces for i in range(len(p) - GRAM + 1)))
    grams = grams or list(dict.fromkeys(c for p in pieces for c in p))
    return grams[:: -(-len(grams) // LOOKUPS)] if grams else []


def candidate_blocks(spark: SparkSession, folder: str, grams: list[str]) -> DataFrame:
    """``_block`` of the blocks where some post holds all ``grams``, all of one length."""
    about = _about(spark, folder)
    lists = spark.read.schema(_GRAMS).parquet(f"{folder}/grams")

    def wanted(gram: str) -> Column:
        same = F.col("gram") == gram if len(gram) == GRAM else F.startswith(F.col("gram"), F.lit(gram))
        return (F.col("_bucket") == _bucket_of(F.lit(gram), about.buckets)) & same

    chosen = wanted(grams[0])
    for gram in grams[1:]:
        chosen = chosen | wanted(gram)
    key = F.substring("gram", 1, len(grams[0])).alias("key")
    # Both groups hold at most a list per n-gram of a block, and no list is longer than the block.
    by_key = lists.where(chosen).groupBy("_block", key).agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"))
    by_block = by_key.groupBy("_block").agg(F.collect_list("places").alias("lists")).where(F.size("lists") == len(grams))
    common = F.reduce("lists", F.get("lists", F.lit(0)), lambda a, b: F.array_intersect(a, b))
    return by_block.where(F.size(common) > 0).select("_block")


def _about(spark: SparkSession, folder: str):
    return spark.read.parquet(f"{folder}/about").first()


def posts_with(spark: SparkSession, folder: str, word: str, regex: bool = False) -> DataFrame:
    """The stored posts that hold ``word``, literally or as a Java regular expression."""
    about = _about(spark, folder)
    schema = StructType.fromJson(json.loads(about.posts))
    posts = spark.read.schema(schema).parquet(f"{folder}/posts")
    grams = _lookups(required_text(word) if regex else [word])
    if grams:
        blocks = candidate_blocks(spark, folder, grams)
        # The key is a folder: Spark prunes the other blocks while it runs.
        posts = posts.join(broadcast_if_small(blocks), "_block", "left_semi")
    return containing(posts, word, about.content, regex).drop("_block", "_place")
