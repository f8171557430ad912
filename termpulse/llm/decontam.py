"""Benchmark decontamination by template windows, in DataFrame operations only.

1. Canonical form: numbers, capitalised names inside a sentence, and units after a
   number become typed placeholders that remember their value; all other words are
   lower-cased. A question with other parameters has the same template.
2. Windows of ``WINDOW`` template tokens, at least ``MIN_LITERALS`` of them words,
   are hashed and joined with those of the benchmark, which is broadcast when
   measured small. Windows that hold a placeholder, whatever their number of words,
   are joined by their exact lower-cased tokens, too: whether a word is a name
   depends on what stands before it, on its case and on line breaks. An item with fewer tokens is one window of its own length.
3. Windows of a document and an item with the same distance between their
   positions stand in one place. Its slots are consistent if the same value of the
   item always stands for the same value in the document. Places whose distances
   differ by at most ``SHIFT`` tokens, as words put in or left out make them, are
   one occurrence.
4. An item has leaked into a document when one consistent occurrence holds windows
   at ``LEAK_WINDOWS`` different positions of the item (13 tokens in a row), or at
   all positions of a shorter item. Repeats of a phrase, and phrases scattered over
   the text, do not add up.
5. An item of fewer than ``WINDOW`` tokens may be an everyday phrase. It counts only with
   a second sign: it makes up at least ``SHORT_SHARE`` of the document's tokens, or the
   document holds another item that counts by itself.

Nothing is grouped by window: a window that a third of all documents share costs a
row per document.

Defined cases: a null or empty text has no windows and stays; an item with fewer
than ``MIN_TOKENS`` tokens is looked for in texts that are, or have a line that is,
these tokens and nothing else; a long text is one value of a row, as are its tokens, and
gives a row per window that meets the benchmark; an item whose windows are all poor in words is found
by its exact tokens only; scripts written without spaces have a token per character;
an item without tokens is not looked for; rows that
repeat an id are one document; rows without an id stay; an empty table gives an
empty table, an empty benchmark keeps everything; other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termpulse.storage import broadcast_if_small

WINDOW = 8
MIN_LITERALS = 5
MIN_TOKENS = 4
LEAK_WINDOWS = 6
SHIFT = 8
SHORT_SHARE = 0.5

# --- fixed values: placeholders, from the private-use area, and units ------------
NUMBER, NAME, UNIT = "\ue001", "\ue002", "\ue003"
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg ton tons pound pounds ounce ounces "
    "ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days "
    "week weeks month months year years cent cents dollar dollars euro euros percent degrees mph kmh"
).split()

# A capitalised word that follows a word or comma and one space.
_NAME = r"(?<=[\p{L}\p{N},;:]\x20)[A-Z][a-z]+(?![\p{L}\p{N}])"
_NUMBER = r"(?<![\p{L}\p{N}.,])[0-9]++(?:[.,][0-9]++)*+"
_UNIT = rf"({NUMBER}[0-9.,]*[0-9]\x20?+)({'|'.join(sorted(UNITS, key=lambda u: (-len(u), u)))})(?![\p{{L}}\p{{N}}])"
# Scripts that are written without spaces.
_UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
_TOKEN = rf"{NUMBER}[0-9.,]*[0-9]|[\p{{L}}&&[{_UNSPACED}]]|[{NAME}{UNIT}]?[\p{{L}}\p{{N}}&&[^{_UNSPACED}]]+"


def tokens(text: Column) -> Column:
    """Template tokens; a placeholder is followed by its value."""
    named = F.regexp_replace(text, _NAME, f"{NAME}$0")
    low = F.lower(named)
    numbered = F.when(low.rlike("[0-9]"), F.regexp_replace(F.regexp_replace(low, _NUMBER, f"{NUMBER}$0"), _UNIT, f"$1\x20{UNIT}$2"))
    return F.regexp_extract_all(F.coalesce(numbered, low), F.lit(_TOKEN), F.lit(0))


def is_slot(token: Column) -> Column:
    return token.between(NUMBER, UNIT + "\uffff")


def plain(tokens: Column) -> Column:
    """Tokens without their placeholders."""
    return F.transform(tokens, lambda t: F.when(is_slot(t), F.substring(t, 2, 1 << 30)).otherwise(t))


def windows(rows: DataFrame, key: str, lengths: list[int]) -> DataFrame:
    """``key, total, length, pos, hash, slots, exact, rich``: every window of the given
    lengths, by its template if that is ``rich`` in words, and by its exact tokens
    if they differ from the template. ``slots`` holds the values in a template, and
    is null without any; ``exact`` tells that the hash stands for the tokens; ``total``
    is the number of tokens of the row."""
    kinds = F.transform("_tokens", lambda t: F.xxhash64(F.when(is_slot(t), F.substring(t, 1, 1)).otherwise(t)))
    rows = rows.withColumn("_kinds", kinds).withColumn("_any", F.exists("_tokens", is_slot))
    rows = rows.withColumn("_plain", F.when(F.col("_any"), F.transform(plain(F.col("_tokens")), lambda t: F.xxhash64(t))))

    def of(length: int) -> Column:
        def window(i: Column) -> Column:
            values = F.filter(F.slice("_tokens", i, length), is_slot)
            return F.struct(
                i.alias("pos"),
                F.xxhash64(F.slice("_kinds", i, length)).alias("hash"),
                F.when(F.col("_any"), values).alias("slots"),
                F.when(F.col("_any"), F.xxhash64(F.slice("_plain", i, length))).alias("plain"),
            )

        enough = F.size("_tokens") >= length
        return F.when(enough, F.transform(F.sequence(F.lit(1), F.size("_tokens") - length + 1), window))

    total = F.size("_tokens").alias("total")
    parts = [rows.select(key, total, F.explode(of(n)).alias("w")).select(key, "total", F.lit(n).alias("length"), "w.*") for n in lengths]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    n_slots = F.coalesce(F.size("slots"), F.lit(0))
    rich = n_slots <= F.col("length") - F.least(F.lit(MIN_LITERALS), F.col("length"))
    by_template = F.struct("hash", "slots", (n_slots == 0).alias("exact"))
    by_tokens = F.struct(F.col("plain").alias("hash"), F.lit(None).cast(found.schema["slots"].dataType).alias("slots"), F.lit(True).alias("exact"))
    # A window without placeholders is the same in both.
    forms = F.when(n_slots == 0, F.array(by_template)).when(rich, F.array(by_template, by_tokens)).otherwise(F.array(by_tokens))
    found = found.select(key, "total", "length", "pos", rich.alias("rich"), F.explode(forms).alias("f"))
    return found.select(key, "total", "length", "pos", "f.hash", "f.slots", "f.exact", "rich")


def _short_leaks(docs: DataFrame, items: DataFrame, text: Column) -> DataFrame:
    """``_id, _item, _total, _length, windows, n_slots, changed`` for items of a few
    tokens: each is compared with whole lines and whole texts."""
    passages = F.explode(F.array_append(F.split(text, r"\R"), text))
    lines = docs.select("_id", F.size(tokens(text)).alias("_total"), passages.alias("_line"))
    lines = lines.select("_id", "_total", plain(tokens(F.col("_line"))).alias("_words"))
    asked = items.select("_item", plain(F.col("_tokens")).alias("_words")).distinct()
    lines = lines.filter(F.size("_words").between(1, MIN_TOKENS - 1))
    met = lines.join(broadcast_if_small(asked), "_words").select("_id", "_item", "_total", F.size("_words").alias("_length")).distinct()
    return met.select("_id", "_item", "_total", "_length", F.lit(1).cast("long").alias("windows"), F.lit(0).alias("n_slots"), F.lit(False).alias("changed"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``id_col, item, windows, n_slots, changed``: the items that leaked into each
    document. ``changed`` tells that some slot has another value than in the item."""
    empty = F.lit("")
    items = benchmark.select(F.col(item_col).alias("_item"), tokens(F.coalesce(F.col(item_text_col), empty)).alias("_tokens"))
    items = items.withColumn("_length", F.least(F.size("_tokens"), F.lit(WINDOW))).filter(F.col("_length") > 0)
    # At most WINDOW different lengths.
    found = sorted(r[0] for r in items.select("_length").distinct().collect())
    lengths = [n for n in found if n >= MIN_TOKENS] or [WINDOW]
    asked = [windows(items.filter(F.col("_length") == n), "_item", [n]) for n in lengths]
    wanted = asked[0]
    for more in asked[1:]:
        wanted = wanted.unionByName(more)
    wanted = wanted.drop("total").toDF("_item", "length", "_at", "hash", "_values", "_exact", "_rich").dropDuplicates(["_item", "length", "_at", "_exact"])
    # By templates an item needs its windows rich in words, by its tokens any.
    rich_at = F.when(F.col("_rich"), F.col("_at"))
    needed = wanted.groupBy("_item").agg(
        F.least(F.count_distinct(rich_at), F.lit(LEAK_WINDOWS)).alias("_need_rich"),
        F.least(F.count_distinct("_at"), F.lit(LEAK_WINDOWS)).alias("_need"),
        F.max("length").alias("_length"),
    )

    rows = docs.filter(F.col(id_col).isNotNull())
    rows = rows.select(F.col(id_col).alias("_id"), tokens(F.coalesce(F.col(text_col), empty)).alias("_tokens"))
    asked = wanted.withColumnRenamed("_exact", "exact")
    met = windows(rows, "_id", lengths).drop("rich").join(broadcast_if_small(asked), ["length", "hash", "exact"])
    met = met.select("_id", "total", "_item", "_at", "_rich", "exact", (F.col("pos") - F.col("_at")).alias("_offset"), "slots", "_values")
    met = met.dropDuplicates(["_id", "_item", "_offset", "_at", "exact"])
    # A place has at most as many rows as its item has windows.
    pairs = F.transform(F.arrays_zip(F.col("_values").alias("b"), F.col("slots").alias("d")), lambda p: F.struct(p["b"].alias("b"), p["d"].alias("d")))
    seen = met.groupBy("_id", "_item", "_offset").agg(
        F.min("total").alias("_total"), F.collect_list(F.struct("_at", "_rich", "exact")).alias("_ats"), F.array_distinct(F.flatten(F.collect_list(pairs))).alias("_pairs")
    )
    values = F.array_distinct(F.transform("_pairs", lambda p: p["b"]))
    # Where slots are inconsistent, windows that agree token by token still count.
    consistent = F.size(values) == F.size("_pairs")
    seen = seen.select(
        "_id",
        "_item",
        "_offset",
        "_total",
        F.when(consistent, F.col("_ats")).otherwise(F.filter("_ats", lambda a: a["exact"])).alias("_ats"),
        F.when(consistent, F.size("_pairs")).otherwise(0).alias("_slots"),
        (consistent & F.exists("_pairs", lambda p: p["b"] != p["d"])).alias("_changed"),
    )
    near = Window.partitionBy("_id", "_item").orderBy("_offset").rangeBetween(-SHIFT, SHIFT)
    ats = F.flatten(F.collect_list("_ats").over(near))
    occurrences = seen.select(
        "_id",
        "_item",
        F.min("_total").over(near).alias("_total"),
        ats.alias("_ats"),
        F.max("_slots").over(near).alias("_slots"),
        F.max("_changed").over(near).alias("_changed"),
    )

    def positions(kept) -> Column:
        return F.size(F.array_distinct(F.transform(F.filter("_ats", kept), lambda a: a["_at"]))).cast("long")

    occurrences = occurrences.select(
        "_id",
        "_item",
        "_total",
        positions(lambda a: a["_rich"]).alias("_rich"),
        positions(lambda a: a["exact"]).alias("_exact"),
        positions(lambda a: F.lit(True)).alias("_windows"),
        "_slots",
        "_changed",
    )
    leaks = occurrences.join(broadcast_if_small(needed), "_item").filter("(_need_rich > 0 AND _rich >= _need_rich) OR _exact >= _need").groupBy("_id", "_item").agg(
        F.min("_total").alias("_total"), F.max("_length").alias("_length"), F.max("_windows").alias("windows"), F.max("_slots").alias("n_slots"), F.max("_changed").alias("changed")
    )
    if found and found[0] < MIN_TOKENS:
        texts = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), empty).alias("_t"))
        leaks = leaks.unionByName(_short_leaks(texts, items.filter(F.col("_length") < MIN_TOKENS), F.col("_t")))
        worst = (F.max(c).alias(c) for c in ("_length", "windows", "n_slots", "changed"))
        leaks = leaks.groupBy("_id", "_item").agg(F.min("_total").alias("_total"), *worst)  # ids of items may repeat
    if found and found[0] < WINDOW:
        alone = (F.col("_length") == WINDOW) | (F.col("_length") >= SHORT_SHARE * F.col("_total"))
        leaks = leaks.withColumn("_alone", alone).withColumn("_any", F.max("_alone").over(Window.partitionBy("_id"))).filter("_any")
    return leaks.select(F.col("_id").alias(id_col), F.col("_item").alias("item"), "windows", "n_slots", "changed")


def flag(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per row: ``id_col, n_items, items, kept``."""
    leaks = find_leaks(docs, benchmark, id_col, text_col, item_col, item_text_col)
    listed = leaks.groupBy(id_col).agg(F.count(F.lit(1)).alias("n_items"), F.sort_array(F.collect_list("item")).alias("items"))
    found = docs.select(id_col).join(listed, id_col, "left")
    no_items = F.array().cast(listed.schema["items"].dataType)
    return found.select(
        id_col,
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items", no_items).alias("items"),
        F.col("n_items").isNull().alias("kept"),
    )
