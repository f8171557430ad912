"""Post tables from CSV files, parquet files and pandas.

The result always has the columns of the two post layouts, in their fixed
order: labelled posts are ``id, date, content, label, emotion,
sentiment_label, source``, custom posts ``id, date, content, label, source``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termpulse import settings as S
from termpulse.functions.python import decodes_as_gbk
from termpulse.storage import new_folder

LABELLED_COLUMNS = ("id", "date", "content", "label", "emotion", "sentiment_label", "source")
CUSTOM_COLUMNS = ("id", "date", "content", "label", "source")

POST_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("date", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("label", T.IntegerType()),
        T.StructField("source", T.StringType()),
    ]
)

_FILE, _BLOCK, _ROW = "_file", "_block", "_row"
_POSITION = (_FILE, _BLOCK, _ROW)


# --- parquet -------------------------------------------------------------------


def read_table(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """A parquet table with at least as many partitions as there are cores.

    A big table has far more splits than cores and is read as it is. A small
    file with one row group would otherwise be tokenised by a single task. The
    shuffle this takes moves less than one file split per core.
    """
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() > cores:
        return df
    return df.repartition(cores, key) if key else df.repartition(cores)


# --- CSV -----------------------------------------------------------------------


def _not_missing(name: str) -> Column:
    c = F.col(f"`{name}`").cast("string")  # a partition folder's value may be typed
    return F.when(~c.isin(*S.MISSING_TEXTS), c)


_CSV = {"escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
# One field after its comma; a quoted one may hold anything but a lone quote.
_FIELD = r',(?:"(?:[^"]|"")*+"[^,]*|[^,]*)'
_RECORD = "_record"
FAIL, DROP = "fail", "drop"


def _fields(record: Column) -> Column:
    return F.size(F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(_FIELD), F.lit(0)))


def _quotes(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit('"'), F.lit("")))


def _fault(record: Column, names: Sequence[str]) -> Column:
    """Why a record that does not fit is no row: null for one with too few fields, which
    are missing values."""
    return F.when(_fields(record) > len(names), "more fields than the header").when(
        _quotes(record) % 2 == 1, "a quote that is not closed"
    )


def _touched(df: DataFrame) -> Column:
    """Always true: Spark does not read the record alone, as a mere count would."""
    return F.length(F.concat_ws("", F.col(f"`{df.columns[0]}`"))) >= 0


def _accepted(df: DataFrame, names: Sequence[str], malformed: str) -> DataFrame:
    """Rows without those that do not fit, or an error when one is read."""
    touched = _touched(df)
    if malformed not in (FAIL, DROP):
        raise ValueError(f"malformed must be {FAIL!r} or {DROP!r}, not {malformed!r}")
    record = F.col(_RECORD)
    fault = F.when(record.isNotNull() & touched, _fault(record, names))
    if malformed == DROP:
        return df.where(fault.isNull())
    message = F.concat(F.lit("malformed CSV row, "), fault, F.lit(": "), F.substring(record, 1, 200))
    return df.where(F.when(fault.isNotNull(), F.raise_error(message).cast("boolean")).otherwise(True))


def _raw_csv(
    spark: SparkSession, paths: Sequence[str], multi_line: bool, encoding: str, base: str | None
) -> tuple[DataFrame, list[str]]:
    """All columns as text and, where the number of fields is not that of the header, the
    record as it stands in the file; and the names of the columns of the file."""
    reader = spark.read.option("basePath", base) if base else spark.read
    common = {**_CSV, "header": True, "multiLine": multi_line, "encoding": encoding, "enforceSchema": False}
    columns = reader.csv(list(paths), **common).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in (*columns, _RECORD)])
    # Without all columns the parser would not see that a row has too many.
    df = reader.option("columnPruning", False).csv(
        list(paths), schema=schema, columnNameOfCorruptRecord=_RECORD, **common
    )
    folders = set(df.columns) - {f.name for f in _data_fields(df)}
    return df, [c for c in columns if c not in folders]


def _data_fields(df: DataFrame) -> list:
    """Fields that stand in the files, without those that partition folders give."""
    relation = df._jdf.queryExecution().analyzed().relation()
    return list(T.StructType.fromJson(json.loads(relation.dataSchema().json())).fields)


def _read_csv(
    spark: SparkSession,
    paths: Sequence[str],
    multi_line: bool,
    encoding: str = "UTF-8",
    base: str | None = None,
    malformed: str = FAIL,
) -> DataFrame:
    """All columns as text, missing markers as nulls, plus the row's position.

    Quoted fields may hold commas, doubled quotes and line breaks. Several files
    must share one header: Spark names columns by position, so a file with
    another header is an error when it is read. ``base`` is the folder below
    which partition folders such as ``date=2020-01-01`` give columns. A row with
    more fields than the header is an error when it is read, or left out
    (``malformed="drop"``); missing fields at the end of a row are nulls.
    """
    df, names = _raw_csv(spark, paths, multi_line, encoding, base)
    df = _accepted(df, names, malformed)
    return df.select(
        *[_not_missing(c).alias(c) for c in df.columns if c != _RECORD],
        F.col("_metadata.file_path").alias(_FILE),
        F.col("_metadata.file_block_start").alias(_BLOCK),
        F.monotonically_increasing_id().alias(_ROW),
    )


def rejected_rows(spark: SparkSession, path: str, multi_line: bool = True, encoding: str = "UTF-8") -> DataFrame:
    """``file, record, n_fields, fault`` of the CSV rows that ``malformed="drop"`` leaves out.

    The readers fail on the first of them by default; this table tells which they are,
    to be counted or kept aside.
    """
    _existing(spark, path)
    df, names = _raw_csv(spark, [path], multi_line, encoding, None)
    record = F.regexp_replace(_RECORD, r"[\r\n]+\z", "")
    found = df.where(F.col(_RECORD).isNotNull() & _touched(df)).select(
        F.col("_metadata.file_path").alias("file"), record.alias("record"), _fields(record).alias("n_fields"), _fault(record, names).alias("fault")
    )
    return found.where(F.col("fault").isNotNull())


# --- CSV records that span lines, read by many tasks ---------------------------------


def _splits(lines: DataFrame) -> DataFrame:
    """``_split, _open, _from``: of each byte range whether it starts inside a quoted
    field, and the range in which that record began.

    Only one row per range is summed, file by file: the number of quotes tells whether
    a field is open at its end.
    """
    odd = _quotes(F.col("value")) % 2
    found = lines.groupBy(_FILE, _BLOCK).agg(F.sum(odd).alias("_odd"))
    before = Window.partitionBy(_FILE).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("_open", F.coalesce(F.sum("_odd").over(before), F.lit(0)) % 2 == 1)
    # A range without an odd line that starts inside a record lies inside it as a whole.
    begins = F.when(~F.col("_open") | (F.col("_odd") > 0), F.col(_BLOCK))
    found = found.withColumn("_begins", begins).withColumn("_from", F.last("_begins", ignorenulls=True).over(before))
    return found.select(F.xxhash64(_FILE, _BLOCK).alias("_split"), "_open", "_from")


def _records(lines: DataFrame) -> DataFrame:
    """``_file, _block, _row, part, text``: the records that begin in each byte range, in
    order; pieces of a record that goes on in another range have its number in ``part``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [_FILE, _BLOCK, _ROW, "part", "text"]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        now, row, waiting, head = None, 0, [], False
        out: list[tuple] = []

        def closed():
            """The range ends: what is open goes on elsewhere."""
            if waiting:
                out.append((now[0], start if head else now[1], None if head else row, now[1], "\n".join(waiting)))

        for batch in batches:
            for file, block, opened, begun, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != (file, block):
                    if now is not None:
                        closed()
                    now, row, waiting, head, start = (file, block), 0, [], opened, begun
                    inside = opened
                    if block == 0:
                        line = line.removeprefix("\ufeff")
                if not inside and not line.strip():
                    continue  # a blank line is no record
                waiting.append(line)
                inside ^= line.count('"') % 2 == 1
                if not inside:
                    text = "\n".join(waiting)
                    out.append((file, start, None, block, text) if head else (file, block, row, None, text))
                    row += not head
                    waiting, head = [], False
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                out = []
        if now is not None:
            closed()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    keyed = lines.withColumn("_split", F.xxhash64(_FILE, _BLOCK))
    # Two values per byte range, as for the ids.
    known = keyed.join(F.broadcast(_splits(lines)), "_split").select(_FILE, _BLOCK, "_open", "_from", "value")
    return known.mapInArrow(run, f"{_FILE} string, {_BLOCK} long, {_ROW} long, part long, text string")


def _read_split_csv(spark: SparkSession, path: str) -> DataFrame:
    """Like ``_read_csv``, but for files too big for one task each, in UTF-8.

    Files are read line by line in byte ranges. Whether a line starts inside a quoted
    field follows from the parity of the quotes before it, summed over ranges; lines
    become records in the task that reads them, and only records that cross a range's
    end are put together by a shuffle. Quotes must stand as the format has them: around
    fields, doubled inside.
    """
    names = spark.read.csv(path, header=True, multiLine=True, **_CSV).columns
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias(_FILE), F.col("_metadata.file_block_start").alias(_BLOCK)
    )
    found = _records(lines)
    pieces = found.where("part IS NOT NULL").groupBy(_FILE, _BLOCK).agg(
        F.max(_ROW).alias(_ROW), F.array_join(F.sort_array(F.collect_list(F.struct("part", "text")))["text"], "\n").alias("text")
    )
    whole = found.where("part IS NULL").select(_FILE, _BLOCK, _ROW, "text").unionByName(pieces)
    # Like Spark's reader in files with such line ends.
    bare = F.replace(F.regexp_replace("text", r"\r\z", ""), F.lit("\r\n"), F.lit("\n"))
    whole = whole.withColumn("text", F.when(F.endswith(F.col("text"), F.lit("\r")), bare).otherwise(F.col("text")))
    schema = T.StructType([T.StructField(f"f{k}", T.StringType()) for k in range(len(names))])
    options = {k: str(v).lower() if isinstance(v, bool) else v for k, v in _CSV.items()}
    rows = whole.withColumn("f", F.from_csv("text", schema.simpleString()[7:-1].replace(":", " "), options))
    # The first record of each file names the columns, as in the other files.
    header = (F.col(_BLOCK) == 0) & (F.col(_ROW) == 0)
    same = F.array(*[F.coalesce(F.col(f"f.f{k}"), F.lit("")) for k in range(len(names))]) == F.array(*map(F.lit, names))
    other = F.concat(F.lit("another header: "), F.substring("text", 1, 200))
    rows = rows.where(F.when(header & ~same, F.raise_error(other).cast("boolean")).otherwise(~header))
    rows = _accepted(rows.withColumn(_RECORD, F.col("text")), names, FAIL)
    fields = [F.when(~F.col(f"f.f{k}").isin(*S.MISSING_TEXTS), F.col(f"f.f{k}")).alias(c) for k, c in enumerate(names)]
    return rows.select(*fields, *_POSITION)


def _existing(spark: SparkSession, path: str) -> None:
    try:
        spark.read.text(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"no such data file: {path}") from e
        raise


def with_file_position(df: DataFrame) -> DataFrame:
    """Add the hidden position columns to a DataFrame read straight from files."""
    return df.select(
        "*",
        F.col("_metadata.file_path").alias(_FILE),
        F.col("_metadata.file_block_start").alias(_BLOCK),
        F.monotonically_increasing_id().alias(_ROW),
    )


def with_sequential_id(df: DataFrame, name: str = "id") -> DataFrame:
    """Number rows 1..n in file order, replacing any existing ``name``.

    ``monotonically_increasing_id`` rises by one inside each file split, so the
    id is the split's starting number plus the distance from the split's first
    row. Only one summary row per split is summed, file by file; posts themselves
    are neither shuffled nor sorted. What is broadcast is two numbers per split:
    13 MB for 100 TB in splits of 128 MB.
    """
    per_split = df.groupBy(_FILE, _BLOCK).agg(F.min(_ROW).alias("_first"), F.count(F.lit(1)).alias("_n"))
    in_file = Window.partitionBy(_FILE).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    # One row per file meets in the window without a partition.
    files = per_split.groupBy(_FILE).agg(F.sum("_n").alias("_total"))
    by_file = Window.orderBy(_FILE).rowsBetween(Window.unboundedPreceding, -1)
    files = files.select(_FILE, F.coalesce(F.sum("_total").over(by_file), F.lit(0)).alias("_files_before"))
    before = F.coalesce(F.sum("_n").over(in_file), F.lit(0))
    splits = per_split.withColumn("_before", before).join(files, _FILE)
    offset = (F.col("_files_before") + F.col("_before") - F.col("_first") + 1).alias("_offset")
    splits = splits.select(F.xxhash64(_FILE, _BLOCK).alias("_split"), offset)
    rest = [c for c in df.columns if c not in (name, *_POSITION)]
    return df.withColumn("_split", F.xxhash64(_FILE, _BLOCK)).join(F.broadcast(splits), "_split").select(
        (F.col("_offset") + F.col(_ROW)).alias(name), *rest
    )


def emotion_label(emotion: Column) -> Column:
    """Sentiment label of an emotion name; unknown names give null."""
    table = F.create_map([F.lit(x) for pair in S.EMOTION_LABELS.items() for x in pair])
    return table[emotion].cast("int")


def _ordered(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Fixed column order; columns the input lacks are left out."""
    extra = [c for c in _POSITION if c in df.columns]
    return df.select(*[c for c in order if c in df.columns], *extra)


def normalize_labelled(df: DataFrame) -> DataFrame:
    """Names, constant source tag and sentiment labels of the labelled layout."""
    df = df.withColumnsRenamed({"text": "content", "label_name": "emotion"})
    df = df.withColumns(
        {"source": F.lit(S.LABELLED_SOURCE), "sentiment_label": emotion_label(F.col("emotion"))}
    )
    if "label" in df.columns:
        df = df.withColumn("label", F.col("label").try_cast("int"))
    return _ordered(df, LABELLED_COLUMNS)


def _resolve(df: DataFrame, name: str, accepted: Sequence[str]) -> DataFrame:
    found = next((c for c in accepted if c in df.columns), None)
    if found is None:
        raise ValueError(f"the input needs a {name!r} column, one of: {', '.join(accepted)}")
    return df if found == name else df.withColumnRenamed(found, name)


def normalize_custom(df: DataFrame) -> DataFrame:
    """Resolve column aliases and fill defaults of the custom layout.

    Raises ``ValueError`` when no content or no date column is there.
    """
    df = _resolve(df, "content", S.CONTENT_NAMES)
    df = _resolve(df, "date", S.DATE_NAMES)
    label = F.col("label") if "label" in df.columns else F.lit(None)
    df = df.withColumn("label", label.cast("string").try_cast("int"))
    if "source" not in df.columns:
        df = df.withColumn("source", F.lit(S.CUSTOM_SOURCE))
    return _ordered(df, CUSTOM_COLUMNS)


def read_labelled_posts(
    spark: SparkSession, path: str, multi_line: bool = True, malformed: str = FAIL, split: bool = False
) -> DataFrame:
    """Labelled posts from one CSV file or a directory of them.

    Fields may hold line breaks, which ties each file to one task, unless ``split`` has
    big files read by many tasks. Where fields never hold any, ``multi_line=False`` lets
    files be read in splits, too. A row with more fields than the header fails the read;
    with ``malformed="drop"`` it is left out, and ``rejected_rows`` shows it.
    """
    _existing(spark, path)
    raw = _read_by(spark, [path], multi_line, malformed, split)
    return _ordered(with_sequential_id(normalize_labelled(raw)), LABELLED_COLUMNS)


def _read_by(
    spark: SparkSession, paths: Sequence[str], multi_line: bool, malformed: str, split: bool, base: str | None = None
) -> DataFrame:
    if not split:
        return _read_csv(spark, paths, multi_line, base=base, malformed=malformed)
    if malformed != FAIL or base or len(paths) > 1:
        raise ValueError("split reading takes UTF-8 files of one path and fails on malformed rows")
    return _read_split_csv(spark, paths[0])


def read_custom_posts(
    spark: SparkSession,
    path: str,
    multi_line: bool = True,
    utf8: bool = False,
    malformed: str = FAIL,
    split: bool = False,
) -> DataFrame:
    """Custom posts from CSV in UTF-8 (with or without BOM) or GBK.

    A directory may mix both encodings, and hold partition folders. GBK files are
    staged once as parquet in the shared scratch folder, because Spark's GBK
    support hangs on a session setting, which is set in a session of its own.
    ``utf8=True`` vouches for UTF-8 and saves the pass that checks it; for the other
    options see ``read_labelled_posts``.
    """
    _existing(spark, path)
    as_utf8, as_gbk = ([path], []) if utf8 else split_by_charset(spark, path)
    base = path if as_gbk and _is_folder(spark, path) else None
    parts = [_read_by(spark, as_utf8, multi_line, malformed, split, base)] if as_utf8 else []
    if as_gbk:
        parts.append(_stage_gbk(spark, as_gbk, multi_line, base, malformed))
    if not parts:
        raise ValueError(f"no CSV data in {path}")
    parts = [normalize_custom(p) for p in parts]
    df = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return _ordered(with_sequential_id(df), CUSTOM_COLUMNS)


# --- charset --------------------------------------------------------------------


def _is_folder(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(place) and fs.getFileStatus(place).isDirectory()


def split_by_charset(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """Paths of UTF-8 files and of GBK files; ``ValueError`` if a file is neither.

    Checks raw lines, so big files are checked by many tasks and each task sends
    on one row per file. A line break byte never occurs inside a GBK character.
    Where all files are UTF-8 the path comes back as it is, and no file is listed.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("value")
    )
    verdicts = lines.groupBy("path").agg(F.bool_and(F.is_valid_utf8("value")).alias("ok"))
    other = sorted(r.path for r in verdicts.where("NOT ok").collect())
    utf8 = [path]
    if other:
        utf8 = sorted(r.path for r in verdicts.where("ok").collect())
        decodes = decodes_as_gbk()
        raw = spark.read.text(other).select(
            F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary").alias("raw")
        )
        bad = [
            r.path
            for r in raw.groupBy("path").agg(F.bool_and(decodes("raw")).alias("ok")).collect()
            if not r.ok
        ]
        if bad:
            raise ValueError(f"neither UTF-8 nor GBK: {', '.join(sorted(bad))}")
    return utf8, other


def _stage_gbk(spark: SparkSession, paths: Sequence[str], multi_line: bool, base: str | None, malformed: str) -> DataFrame:
    target = f"{new_folder(spark, 'gbk')}/posts"
    own = spark.newSession()  # the same cluster, other settings
    own.conf.set("spark.sql.legacy.javaCharsets", "true")
    _read_csv(own, paths, multi_line, "GBK", base, malformed).write.parquet(target)
    return spark.read.parquet(target)


# --- pandas ---------------------------------------------------------------------


def posts_from_pandas(spark: SparkSession, pdf, schema: T.StructType | None = None) -> DataFrame:
    """A pandas table as posts; ``schema`` defaults to the matching post columns."""
    if schema is None:
        known = {f.name: f for f in POST_SCHEMA.fields}
        if all(c in known for c in pdf.columns):
            schema = T.StructType([known[c] for c in pdf.columns])
    if schema is not None:
        # pandas turns integers with a missing value into floats.
        whole = {f.name: "Int64" for f in schema.fields if isinstance(f.dataType, T.IntegralType)}
        pdf = pdf.astype(whole)
        for name in whole:
            pdf[name] = pdf[name].astype(object).where(pdf[name].notna(), None)
    return spark.createDataFrame(pdf, schema=schema)
